"""Duplicate order ids within a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import strip


def normalized_id(column: str = "raw_record.order_id") -> F.Column:
    """The stripped order id; empty for null."""
    return F.coalesce(strip(F.col(column)), F.lit(""))


def duplicate_groups(raw: DataFrame) -> DataFrame:
    """order_id, record_count of ids that more than one row has; blank ids form no group. Partial counts go before the shuffle."""
    return raw.select(normalized_id().alias("order_id")).where("order_id <> ''").groupBy("order_id").agg(F.count("*").alias("record_count")).where("record_count > 1")


def group_sizes(groups: DataFrame) -> DataFrame:
    """record_count, groups: how many groups have each size."""
    return groups.groupBy("record_count").agg(F.count("*").alias("groups"))


MOST_BROADCAST, HOT_ROWS = 64 << 20, 1_000_000


def flag_duplicates(raw: DataFrame, column: str = "is_duplicate", most_broadcast: int = MOST_BROADCAST, hot_rows: int = HOT_ROWS) -> DataFrame:
    """`raw` with a boolean: its order id is in a duplicate group.

    The groups' ids are counted first, which reads the id column alone. Up to MOST_BROADCAST bytes of them are broadcast, and
    no row is shuffled. Beyond, rows are shuffled by id, but for those that would gather: blank ids, which form no group, and
    ids of HOT_ROWS rows or more, which are marked first by a broadcast (a run of n rows has at most n / HOT_ROWS of them)
    and then, like the blank ones, spread.
    """
    groups = duplicate_groups(raw)
    ids = groups.select(F.col("order_id").alias("_dup"))
    if (ids.agg(F.sum(F.octet_length("_dup") + 32)).first()[0] or 0) <= most_broadcast:
        return raw.withColumn("_id", normalized_id()).join(F.broadcast(ids), F.col("_id") == F.col("_dup"), "left").withColumn(column, F.col("_dup").isNotNull()).drop("_id", "_dup")
    hot = groups.where(F.col("record_count") >= hot_rows).select(F.col("order_id").alias("_hot"))
    marked = raw.withColumn("_id", normalized_id()).join(F.broadcast(hot), F.col("_id") == F.col("_hot"), "left")
    alone = F.concat(F.lit("\x00"), F.xxhash64(F.monotonically_increasing_id()).cast("string"))
    marked = marked.withColumn("_key", F.when((F.col("_id") == "") | F.col("_hot").isNotNull(), alone).otherwise(F.col("_id")))
    found = marked.join(ids, F.col("_key") == F.col("_dup"), "left")
    return found.withColumn(column, F.col("_hot").isNotNull() | F.col("_dup").isNotNull()).drop("_id", "_hot", "_key", "_dup")
