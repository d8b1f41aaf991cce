"""The Spark session of the engine."""

from __future__ import annotations

from pyspark.sql import SparkSession

from millrace.config import Settings


def create_session(settings: Settings | None = None, extra: dict[str, str] | None = None, jars: list[str] | None = None) -> SparkSession:
    """UTC, adaptive execution, and CSV rows parsed whole, so that the corrupt-record column can be trusted.

    `jars`: those of the document store's connector (sources.documents.connector_jars), where it is used.
    """
    settings = settings or Settings()
    builder = SparkSession.builder.master(settings.spark_master).appName(settings.app_name)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.csv.parser.columnPruning.enabled": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | ({"spark.jars": ",".join(jars)} if jars else {}) | (extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
