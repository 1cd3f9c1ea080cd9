"""A session with the settings that the wide aggregates and windows of this library want."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: codegen.maxFields: one pass over 131 aggregates stays in whole-stage code only above the default of 100.
SETTINGS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.codegen.maxFields": "400",
}


def session(app: str = "formline", **more: str) -> SparkSession:
    """The active session or a new one; more: settings with _ for dots."""
    builder = SparkSession.builder.appName(app)
    for k, v in {**SETTINGS, **{k.replace("_", "."): v for k, v in more.items()}}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
