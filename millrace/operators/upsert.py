"""Documents for the validated and quarantine tables, and idempotent upserts by key and fingerprint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.config import QUARANTINE, VALIDATED
from millrace.operators.dedup import normalized_id
from millrace.schema import CORRECTED, QUARANTINED, RAW_COLUMNS, VALID
from millrace.sources.storage import KEYS

ACTIONS = ("inserted", "updated", "unchanged")


def fingerprint(*parts: F.Column) -> F.Column:
    """SHA-256 of the parts as JSON, nulls included, members in their fixed order."""
    return F.sha2(F.to_json(F.struct(*(p.alias(f"p{k}") for k, p in enumerate(parts))), {"ignoreNullFields": "false"}), 256)


def validated_documents(classified: DataFrame, run_id: str | F.Column, now: F.Column | None = None) -> DataFrame:
    """Valid and corrected records as documents keyed by order_id."""
    now = F.current_timestamp() if now is None else now
    rows = classified.where(F.col("quality_status").isin(VALID, CORRECTED))
    lineage = F.struct(F.col("run_id").alias("raw_run_id"), "source_file", "source_path", "source_row_number", F.col("ingested_at").alias("raw_ingested_at"), "engine_used")
    return rows.select(
        *(F.col(f"cleaned_record.{c}").alias(c) for c in RAW_COLUMNS), "quality_status", "corrections", fingerprint(F.col("cleaned_record"), F.col("quality_status"), F.col("corrections")).alias("record_fingerprint"),
        lineage.alias("lineage"), F.lit(run_id).alias("last_processing_run_id"), now.alias("first_processed_at"), now.alias("last_updated_at"),
    )


def quarantine_documents(classified: DataFrame, run_id: str, now: F.Column | None = None) -> DataFrame:
    """Quarantined records as documents keyed by run and row number."""
    now = F.current_timestamp() if now is None else now
    rows = classified.where(F.col("quality_status") == QUARANTINED)
    state = ("raw_record", "cleaned_record", "corrections", "codes_error", "details_error")
    return rows.select(
        F.concat("run_id", F.lit(":"), F.col("source_row_number").cast("string")).alias("quarantine_key"), F.nullif(normalized_id(), F.lit("")).alias("order_id"), "quality_status", "raw_record",
        F.col("cleaned_record").alias("cleaned_preview"), "corrections", F.col("codes_error").alias("error_codes"), F.col("details_error").alias("error_details"), fingerprint(*map(F.col, state)).alias("record_fingerprint"),
        F.col("run_id").alias("source_run_id"), "source_file", "source_path", "source_row_number", F.col("ingested_at").alias("raw_ingested_at"), "engine_used", F.lit(run_id).alias("last_processing_run_id"),
        now.alias("first_processed_at"), now.alias("last_updated_at"),
    )


def actions(new: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """`new` with `action`: inserted, unchanged (same fingerprint) or updated. Only key, fingerprint and first time of
    `existing` are read and shuffled."""
    old = existing.select(F.col(key).alias("_key"), F.col("record_fingerprint").alias("_print"), F.col("first_processed_at").alias("_first"))
    action = F.when(F.col("_key").isNull(), "inserted").when(F.col("_print") == F.col("record_fingerprint"), "unchanged").otherwise("updated")
    return new.join(old, F.col(key) == F.col("_key"), "left").withColumn("action", action).withColumn("first_processed_at", F.coalesce("_first", "first_processed_at")).drop("_key", "_print", "_first")


def merged(ruled: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """The next snapshot: existing rows whose key is not written, and the rows inserted or updated. Unchanged rows stay as
    they were, last_updated_at included."""
    written = ruled.where("action <> 'unchanged'").drop("action")
    return existing.join(written.select(key), key, "left_anti").select(*existing.columns).unionByName(written.select(*existing.columns))


__all__ = ["ACTIONS", "KEYS", "QUARANTINE", "VALIDATED", "actions", "fingerprint", "merged", "quarantine_documents", "validated_documents"]
