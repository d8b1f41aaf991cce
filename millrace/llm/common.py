"""Helpers shared by the operators: the shared folder, lineage cuts, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Rows that a Python step holds as Python objects at a time.
SLICE_ROWS = 256


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a temporary one only where that is unset, as in tests."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        made = named or tempfile.mkdtemp(prefix="millrace-")
        sc.setCheckpointDir(made)
        if named is None:
            delete_on_exit(spark, made)
    return named or sc.getCheckpointDir()


def delete_on_exit(spark: SparkSession, path: str) -> None:
    """Has the driver's JVM remove `path`, which must exist, when it ends, be the session stopped before or not."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)


def delete_now(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def free_shuffles(spark: SparkSession) -> None:
    """Lets the driver notice which shuffles nothing refers to any more, so that executors delete their files."""
    spark.sparkContext._jvm.System.gc()


def cut(df: DataFrame) -> DataFrame:
    """`df`, computed once and read back from the shared folder, so that a lost executor costs no recomputation. Removed when the driver ends."""
    shared_dir(df.sparkSession)
    done = df.checkpoint(eager=True)
    file = done._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if file.isDefined():
        delete_on_exit(df.sparkSession, file.get())
    return done


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Like cut(), as a Parquet table, of which later steps read only the columns they need. Removed when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    delete_on_exit(spark, path)
    free_shuffles(spark)
    return spark.read.schema(df.schema).parquet(path)


def quoted(name: str) -> F.Column:
    """The column of that name, dots and back-quotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(name: str, taken: list[str]) -> str:
    """`name`, with underscores before it until no column is called so."""
    while name.lower() in {t.lower() for t in taken}:
        name = "_" + name
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket_of(column: str, modulus: int) -> F.Column:
    """crc32 of the value as text, modulo `modulus`; null for null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


def drawn(rows: DataFrame, group: str, k: int, salts: int = 64, middle: int = 8) -> DataFrame:
    """The `k` rows of each group with the smallest hashes of doc_id, the same in every run.

    Each group is ranked in `salts` parts first, then in `middle` of them, so that a group of most rows is dealt over as
    many tasks, and the last ranking sees `middle` times k rows of a group at most.
    """
    hashed = rows.withColumn("_h", F.xxhash64("doc_id")).withColumn("_part", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(salts)))
    for by in ([group, "_part"], [group, F.col("_part") % middle], [group]):
        hashed = hashed.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy("_h", "doc_id"))).where(F.col("_k") <= k)
    return hashed.drop("_h", "_part", "_k")


def one_text(rows: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    """`keys` and text, one row for each of `ids` (distinct, broadcast): of several rows the text with the smallest hash."""
    found = rows.select(*keys, "text").join(F.broadcast(ids), keys, "left_semi")
    least = found.groupBy(*keys).agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("least"))
    return least.select(*keys, F.col("least.text").alias("text"))


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most `rows` rows, which bounds what a Python step holds."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def slices_by_bytes(batches: Iterator[pa.RecordBatch], place: int, most: int) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of which the texts in column `place` have about `most` bytes, a single longer text alone."""
    for batch in batches:
        start = held = 0
        for at, size in enumerate(pc.fill_null(pc.binary_length(batch.column(place)), 0).to_pylist()):
            if held and held + size > most:
                yield batch.slice(start, at - start)
                start, held = at, 0
            held += size + 64
        if batch.num_rows > start:
            yield batch.slice(start)


def map_rows(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType) -> DataFrame:
    """mapInArrow for columns of any names, dots included; `run` meets them, and is met, by place."""
    inner = StructType([StructField(f"c{k}", f.dataType) for k, f in enumerate(schema.fields)])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in run(batches):
            yield part.rename_columns(inner.names)

    return df.toDF(*(f"c{k}" for k in range(len(df.columns)))).mapInArrow(placed, inner).toDF(*schema.names)


def map_slices(df: DataFrame, function: Callable[[pa.RecordBatch], dict], schema: str, names: list[str], types: list[pa.DataType], rows: int = SLICE_ROWS) -> DataFrame:
    """Applies `function` (slice -> lists by column name) within each task, by Arrow batches."""
    out = pa.schema(list(zip(names, types, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, rows):
            yield pa.RecordBatch.from_pydict(function(part), schema=out)

    return df.mapInArrow(run, schema)


class Held:
    """What each worker builds once from picklable parts and keeps for its later tasks; to be broadcast."""

    def __init__(self, make: Callable, *parts: object):
        self.make, self.parts, self.made = make, parts, None

    def __getstate__(self) -> tuple:
        return self.make, self.parts

    def __setstate__(self, state: tuple) -> None:
        (self.make, self.parts), self.made = state, None

    def __call__(self):  # noqa: ANN204
        if self.made is None:
            self.made = self.make(*self.parts)
        return self.made
