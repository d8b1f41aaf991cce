"""Continuous loading: each micro-batch of CSV files is a raw run of its own, classified and upserted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from millrace.config import LARGE
from millrace.plans.pipeline import run_quality
from millrace.schema import CORRUPT, csv_schema
from millrace.sources.ingest import raw_rows
from millrace.sources.storage import Storage


def read_stream(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    options = {"header": "true", "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "maxFilesPerTrigger": str(files_per_trigger)}
    return spark.readStream.options(**options).schema(csv_schema()).csv(folder)


def start(spark: SparkSession, folder: str, storage: Storage, checkpoint: str, name: str = "orders", available_now: bool = True) -> StreamingQuery:
    """Starts the query. A batch that is run again after a failure finds its run in the raw table and only upserts, which
    is idempotent, so every record counts once. Duplicate ids are those within a batch, as within a run."""

    def load(batch: DataFrame, number: int) -> None:
        run_id = f"{name}-{number:09d}"
        if storage.raw(run_id).isEmpty():
            rows = batch.persist()
            try:
                if rows.isEmpty():
                    return
                storage.append_raw(raw_rows(rows, folder, run_id, LARGE))
            finally:
                rows.unpersist()
        run_quality(storage, run_id)

    writer = read_stream(spark, folder).writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(load)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
