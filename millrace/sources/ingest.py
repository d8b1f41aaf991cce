"""Loading a CSV into the raw table, with its run's metadata and the gates around it."""

from __future__ import annotations

import re
import time
import uuid
from datetime import datetime, timezone
from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from millrace.config import LARGE, QUARANTINE, RAW, SMALL, VALIDATED
from millrace.schema import CORRUPT, RAW_COLUMNS
from millrace.sources.csv import check_schema, count_rows, numbered, read_large, read_small
from millrace.sources.storage import TEST_PREFIX, Storage


class GateError(RuntimeError):
    """A consistency gate failed."""


def new_run_id(prefix: str) -> str:
    """<prefix>-<UTC time>-<8 hex digits>"""
    return f"{prefix}-{datetime.now(timezone.utc):%Y%m%dT%H%M%SZ}-{uuid.uuid4().hex[:8]}"


def check_run_id(run_id: str) -> str:
    run_id = run_id.strip()
    if not run_id or len(run_id) > 128 or re.search(r"\s", run_id):
        raise ValueError(f"not a run id: {run_id!r}")
    return run_id


def raw_rows(df: DataFrame, path: str, run_id: str, engine: str, numbers: bool = True) -> DataFrame:
    """The raw table's rows for a CSV that was read. A local path is made absolute."""
    path = str(path) if urlparse(str(path)).scheme else str(Path(path).resolve())
    df = numbered(df) if numbers else df.withColumn("source_row_number", F.lit(None).cast("long"))
    extra = F.col("extra_values") if "extra_values" in df.columns else F.lit(None).cast("array<string>")
    return df.select(
        F.lit(run_id).alias("run_id"), F.lit(Path(path).name).alias("source_file"), F.lit(path).alias("source_path"), F.col("source_row_number").cast("long"),
        F.lit(numbers).alias("source_row_number_available"), F.current_timestamp().alias("ingested_at"), F.lit(engine).alias("engine_used"), F.spark_partition_id().alias("spark_partition_id"),
        F.col(CORRUPT).alias("csv_corrupt_record"), extra.alias("extra_values"), F.struct(*RAW_COLUMNS).alias("raw_record"),
    )


def load_csv(spark: SparkSession, storage: Storage, path: str, engine: str = LARGE, run_id: str | None = None, expected_rows: int | None = None, on_malformed: str = "fail", table: str = RAW) -> dict:
    """Appends a CSV to the raw table as one run, and returns the run's report.

    Gates: the run is new; the columns are the contracted ones; no corrupt rows before anything is written (unless
    on_malformed is "permissive"); as many rows stored as read; the expected number where it is stated; other runs
    untouched, and the tables made from them too; a stored row has its metadata and fields. A table other than the raw table is one of a test: named
    TEST_PREFIX*, and empty.
    """
    if on_malformed not in ("fail", "permissive"):
        raise ValueError("on_malformed is fail or permissive")
    run_id = check_run_id(run_id or new_run_id("run" if engine == SMALL else "spark"))
    before = storage.raw(name=table).groupBy((F.col("run_id") == run_id).alias("own")).count().collect()
    before = {r["own"]: r["count"] for r in before}
    if table != RAW and not table.startswith(TEST_PREFIX):
        raise GateError(f"rows go to {RAW}, or to a test table named {TEST_PREFIX}*, not to {table}")
    if table != RAW and before:
        raise GateError(f"the test table {table} is not empty")
    if before.get(True):
        raise GateError(f"run {run_id} is in the raw table already")
    others = _others(storage, table)
    began = time.perf_counter()
    df = (read_small if engine == SMALL else read_large)(spark, path, places=True)
    if not df.columns:
        raise ValueError(f"{path} is empty")
    check_schema(df)
    read, corrupt = count_rows(df)
    if corrupt and on_malformed == "fail":
        raise GateError(f"{corrupt} corrupt CSV rows")
    if expected_rows is not None and read != expected_rows:
        raise GateError(f"{read} rows, not the {expected_rows} expected")
    storage.append_raw(raw_rows(df, path, run_id, engine), table)
    after = {r["own"]: r["count"] for r in storage.raw(name=table).groupBy((F.col("run_id") == run_id).alias("own")).count().collect()}
    if after.get(True, 0) != read or after.get(False, 0) != before.get(False, 0):
        raise GateError(f"read {read} rows, stored {after.get(True, 0)}; others {before.get(False, 0)} and {after.get(False, 0)}")
    if _others(storage, table) != others:
        raise GateError(f"other tables changed while {table} was loaded")
    _check_stored(storage.raw(run_id, table).first(), engine, read)
    elapsed = time.perf_counter() - began
    return {"run_id": run_id, "engine": engine, "rows_read": read, "inserted": after.get(True, 0), "corrupt_rows": corrupt, "elapsed_seconds": round(elapsed, 4), "records_per_second": round(read / elapsed, 2) if elapsed > 0 else 0}


def _others(storage: Storage, table: str) -> dict:
    """What a load must leave as it is: the snapshots that count and, where the rows go to a test table, the raw table's size."""
    return {t: storage.current(t) for t in (VALIDATED, QUARANTINE)} | ({} if table == RAW else {RAW: storage.raw().count()})


def _check_stored(row: Row | None, engine: str, read: int) -> None:
    """A row that was stored names its source, row, time and engine, and holds every contracted field."""
    if row is None:
        if read:
            raise GateError("no stored row of the run")
        return
    lacking = [c for c in ("run_id", "source_file", "source_path", "source_row_number", "ingested_at", "spark_partition_id") if row[c] is None]
    fields = [c for c in RAW_COLUMNS if c not in row["raw_record"].asDict()]
    if lacking or fields or row["engine_used"] != engine:
        raise GateError(f"a stored row lacks {', '.join(lacking + fields) or 'nothing'} and was read by {row['engine_used']}")
