"""The corpus pipeline, part of subpackage llm: its stages, their SQL (None) and the whole run."""

from formline.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
