"""CSV sources: the distributed scan, the record-faithful scan of small files, and the sample writer."""

from __future__ import annotations

import csv
import io
import itertools
import warnings
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.schema import CORRUPT, RAW_COLUMNS, csv_schema


class SchemaError(RuntimeError):
    """The data does not have the contracted columns."""


#: Where a row stands: its file, and the offset of the part of the file it was read from.
PLACE = ("_file", "_block")


def read_large(spark: SparkSession, path: str, places: bool = False) -> DataFrame:
    """The 17 columns and the corrupt record, from splittable files: one record a line, explicit schema, no inference.

    With `places` also the columns of PLACE, by which numbered() goes.
    """
    options = {"header": "true", "encoding": "UTF-8", "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "multiLine": "false", "maxCharsPerColumn": "-1", "enforceSchema": "true", "columnPruning": "false"}
    return _placed(spark.read.options(**options).schema(csv_schema()).csv(path), places)


def _placed(rows: DataFrame, places: bool) -> DataFrame:
    return rows.select("*", F.col("_metadata.file_path").alias(PLACE[0]), F.col("_metadata.file_block_start").alias(PLACE[1])) if places else rows


def read_small(spark: SparkSession, path: str, places: bool = False) -> DataFrame:
    """Like read_large(), with fields that span lines; records of another width are taken as they are.

    A short record's missing fields are null; a long one's surplus is in extra_values; unquoted empty fields are empty
    texts, as they are in the file. A file is read by one task, so this is the profile of small files.
    """
    options = {"header": "true", "encoding": "UTF-8", "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "multiLine": "true", "maxCharsPerColumn": "-1", "enforceSchema": "true", "columnPruning": "false", "emptyValue": ""}
    rows = _placed(spark.read.options(**options).schema(csv_schema()).csv(path), places)
    wide = ", ".join(f"{c} string" for c in RAW_COLUMNS)
    again = F.from_csv(F.col(CORRUPT), wide, {"quote": '"', "escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1", "mode": "PERMISSIVE"})
    rows = rows.withColumn("_again", F.when(F.col(CORRUPT).isNotNull(), again)).withColumn("_surplus", _surplus(len(RAW_COLUMNS))(CORRUPT))
    bad = F.col(CORRUPT).isNotNull()
    columns = [F.when(bad, F.col(f"_again.{c}")).otherwise(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in RAW_COLUMNS]
    return rows.select(*columns, F.lit(None).cast("string").alias(CORRUPT), F.col("_surplus").alias("extra_values"), *(PLACE if places else ()))


def _surplus(width: int) -> Callable:
    """A function of a record: its fields beyond `width`, however many, the empty ones null; null if there are none."""

    def fields(record: str | None) -> list[str | None] | None:
        if record is None:
            return None
        csv.field_size_limit(2**31 - 1)
        return [x or None for x in next(csv.reader(io.StringIO(record, newline="")), [])[width:]] or None

    return F.udf(fields, "array<string>")


def corrupt_rows(df: DataFrame, column: str = CORRUPT) -> DataFrame:
    return df.where(F.col(column).isNotNull() & (F.length(F.trim(column)) > 0))


def count_rows(df: DataFrame, column: str = CORRUPT) -> tuple[int, int]:
    """(rows, corrupt rows) in one pass. Spark refuses to read the corrupt record alone, so a field is read along."""
    rows, corrupt, _ = df.agg(F.count("*"), F.count_if(F.length(F.trim(column)) > 0), F.max(F.hash("order_id"))).first()
    return rows, corrupt


def check_schema(df: DataFrame) -> None:
    """Every contracted column is there, as a string."""
    types = dict(df.dtypes)
    wrong = [c for c in (*RAW_COLUMNS, CORRUPT) if types.get(c) != "string"]
    if wrong:
        raise SchemaError(f"not strings, or missing: {', '.join(wrong)}")


def numbered(df: DataFrame, column: str = "source_row_number", first: int = 2) -> DataFrame:
    """Adds contiguous row numbers in file order (the header is row 1), and drops the columns of PLACE.

    Rows are numbered within the parts of files they were read from, and parts by their files' paths, their offsets and
    their sizes: Spark deals parts to tasks by size, so the order of tasks is not that of the files. Rows without PLACE go by
    partition. Two numbers for each part are broadcast; there is no shuffle of the rows, but the source is read twice.
    """
    place = [c for c in PLACE if c in df.columns]
    tagged = df.withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33).cast("int"))
    parts = tagged.groupBy(*place, "_part").agg(F.count("*").alias("_rows"), F.min("_id").alias("_low"))
    before = Window.orderBy(*place, "_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("_part", F.struct("_low", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before")).alias("_start"))
    starts = offsets.groupBy("_part").agg(F.sort_array(F.collect_list("_start")).alias("_starts"))
    start = F.element_at(F.filter("_starts", lambda s: s["_low"] <= F.col("_id")), -1)
    return tagged.join(F.broadcast(starts), "_part").withColumn("_start", start).withColumn(column, F.col("_start._before") + F.col("_id") - F.col("_start._low") + first).drop(*place, "_id", "_part", "_starts", "_start")


class _Stream(io.RawIOBase):
    """A file of any file system that Spark reads, as a stream of bytes."""

    def __init__(self, spark: SparkSession, path: str):
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(at):
            raise FileNotFoundError(f"no such file: {path}")
        self._stream = fs.open(at)

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        got = bytes(self._stream.readNBytes(len(buffer)))
        buffer[: len(got)] = got
        return len(got)

    def close(self) -> None:
        if not self.closed and hasattr(self, "_stream"):
            self._stream.close()
        super().close()


def create_sample(spark: SparkSession, source: str, target: str | Path, rows: int = 100_000) -> int:
    """Copies the header and the first `rows` records of a CSV file into one local CSV file, with a byte order mark as
    spreadsheets want it; returns how many there were, with a warning if they are fewer.

    Only the head of the source is read, as a stream: a job would read all of it to number its rows.
    """
    if rows <= 0:
        raise ValueError("rows must be positive")
    csv.field_size_limit(2**31 - 1)
    with io.TextIOWrapper(io.BufferedReader(_Stream(spark, str(source)), 1 << 20), encoding="utf-8-sig", newline="") as records:
        reader = csv.reader(records)
        header = next(reader, None)
        if header is None:
            raise ValueError(f"{source} is empty")
        Path(target).parent.mkdir(parents=True, exist_ok=True)
        copied = 0
        with open(target, "w", encoding="utf-8-sig", newline="") as out:
            writer = csv.writer(out)
            writer.writerow(header)
            for record in itertools.islice(reader, rows):
                writer.writerow(record)
                copied += 1
    if copied < rows:
        warnings.warn(f"{source} has {copied} records, fewer than the {rows} asked for", stacklevel=2)
    return copied
