"""Tables of the engine, as Parquet under one folder of any file system that Spark reads.

orders_raw is appended to, a partition for each run. orders_validated and orders_quarantine are snapshots: a new one is
written beside the old, and a pointer file of the next number is then renamed into place. The pointer of the highest
number counts, and none is replaced, so readers see one snapshot or the other, and a job that dies at any point leaves
the old table or the new one. A table has one writer at a time; of two, the second to set a pointer fails.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.config import QUARANTINE, RAW, VALIDATED, Settings
from millrace.schema import CORRECTION, ERROR, RAW_COLUMNS, RAW_SCHEMA

_RECORD = "struct<" + ", ".join(f"{c}: string" for c in RAW_COLUMNS) + ">"
_LINEAGE = "struct<raw_run_id: string, source_file: string, source_path: string, source_row_number: bigint, raw_ingested_at: timestamp, engine_used: string>"
SCHEMAS = {
    RAW: RAW_SCHEMA,
    VALIDATED: ", ".join(f"{c} string" for c in RAW_COLUMNS) + f", quality_status string, corrections array<{CORRECTION}>, record_fingerprint string, lineage {_LINEAGE}, last_processing_run_id string, first_processed_at timestamp, last_updated_at timestamp",
    QUARANTINE: f"quarantine_key string, order_id string, quality_status string, raw_record {_RECORD}, cleaned_preview {_RECORD}, corrections array<{CORRECTION}>, error_codes array<string>, error_details array<{ERROR}>,"
    " record_fingerprint string, source_run_id string, source_file string, source_path string, source_row_number bigint, raw_ingested_at timestamp, engine_used string, last_processing_run_id string, first_processed_at timestamp, last_updated_at timestamp",
}
KEYS = {VALIDATED: "order_id", QUARANTINE: "quarantine_key"}
TEST_PREFIX = "_spark_"


class Storage:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _exists(self, path: str) -> bool:
        fs, at = self._fs(path)
        return fs.exists(at)

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def append_raw(self, rows: DataFrame, name: str = RAW) -> None:
        rows.write.mode("append").partitionBy("run_id").parquet(self.path(name))

    def raw(self, run_id: str | None = None, name: str = RAW) -> DataFrame:
        """The raw table; with a run, only that run's partition is read."""
        if not self._exists(self.path(name)):
            return self.spark.createDataFrame([], RAW_SCHEMA)
        found = self.spark.read.schema(RAW_SCHEMA).parquet(self.path(name))
        return found if run_id is None else found.where(F.col("run_id") == run_id)

    def _pointers(self, name: str) -> dict[int, str]:
        """The snapshot that each pointer names, by number; one cut off while it was written is left out."""
        fs, folder = self._fs(self.path(name))
        if not fs.exists(folder):
            return {}
        found = {}
        for status in fs.listStatus(folder):
            head, _, number = status.getPath().getName().partition(".")
            if head == "_CURRENT" and (number.isdigit() or not number):  # one without a number is of an older layout
                stream = fs.open(status.getPath())
                try:
                    snapshot = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
                finally:
                    stream.close()
                if snapshot and self._exists(f"{self.path(name)}/{snapshot}"):
                    found[int(number or 0)] = snapshot
        return found

    def current(self, name: str) -> str | None:
        """The name of the snapshot that counts, which changes whenever the table does; null if never written."""
        pointers = self._pointers(name)
        return pointers[max(pointers)] if pointers else None

    def snapshot(self, name: str) -> DataFrame:
        """The table as it stands, empty if never written."""
        current = self.current(name)
        if current is None:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path(name)}/{current}")

    def replace(self, name: str, rows: DataFrame) -> None:
        """Writes `rows` as the new snapshot and points to it; the one before is kept, older ones are removed."""
        number, new = max(self._pointers(name), default=0) + 1, f"snapshot-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path(name)}/{new}")
        self._point(name, number, new)
        self._clean(name)

    def _point(self, name: str, number: int, snapshot: str) -> None:
        fs, temp = self._fs(f"{self.path(name)}/_NEXT.{snapshot}")
        out = fs.create(temp, True)
        out.write(bytearray(snapshot.encode()))
        out.close()
        _, pointer = self._fs(f"{self.path(name)}/_CURRENT.{number:08d}")
        if fs.exists(pointer) or not fs.rename(temp, pointer):
            raise RuntimeError(f"another writer has replaced {name} meanwhile")

    def _clean(self, name: str) -> None:
        """Removes pointers below the last two, and every snapshot that no pointer names, once there is a pointer."""
        pointers = self._pointers(name)
        kept = set(sorted(pointers)[-2:])
        if not kept:
            return
        fs, folder = self._fs(self.path(name))
        for status in fs.listStatus(folder):
            found = status.getPath().getName()
            head, _, number = found.partition(".")
            old = head == "_CURRENT" and (number.isdigit() or not number) and int(number or 0) < min(kept)
            if old or head == "_NEXT" or found.startswith("snapshot-") and found not in {pointers[k] for k in kept}:
                fs.delete(status.getPath(), True)

    def drop_test_table(self, name: str) -> None:
        """Removes a table, if its name marks it as one of a test."""
        if not name.startswith(TEST_PREFIX):
            raise RuntimeError(f"only tables named {TEST_PREFIX}* may be dropped, not {name}")
        fs, at = self._fs(self.path(name))
        fs.delete(at, True)

    def latest_run(self) -> str:
        """The run that was loaded last."""
        row = self.raw().agg(F.max_by("run_id", F.struct("ingested_at", "run_id")).alias("run_id")).first()
        if row is None or row["run_id"] is None:
            raise RuntimeError("the raw table is empty")
        return row["run_id"]

    def require_run(self, run_id: str) -> str:
        run_id = run_id.strip()
        if self.raw(run_id).limit(1).count() == 0:
            raise RuntimeError(f"no raw rows of run {run_id}")
        return run_id

