"""Operators of a training-data pipeline. Nothing else in formline imports this subpackage."""
