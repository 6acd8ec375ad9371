"""Session defaults shared by tests, benchmark and driver entry points."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Options every tarnflow session expects.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.timeType.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str = "local[*]", app_name: str = "tarnflow", **conf: str) -> SparkSession:
    """Create (or fetch) a session with :data:`DEFAULTS`; ``conf`` overrides them (dots as ``__``)."""
    builder = SparkSession.builder.master(master).appName(app_name)
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
