"""Counts over classified records: by status, rule, code, combination and size; top-k; samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def status_counts(classified: DataFrame) -> DataFrame:
    return classified.groupBy("quality_status").agg(F.count("*").alias("n"))


def rule_counts(classified: DataFrame) -> DataFrame:
    """One for each correction entry."""
    return classified.select(F.explode(F.transform("corrections", lambda c: F.coalesce(c["rule_code"], F.lit("UNKNOWN_RULE")))).alias("rule_code")).groupBy("rule_code").agg(F.count("*").alias("n"))


def error_code_counts(classified: DataFrame) -> DataFrame:
    """One for each distinct code of a record."""
    return classified.select(F.explode(F.array_distinct("codes_error")).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


def error_combinations(classified: DataFrame) -> DataFrame:
    joined = F.array_join(F.array_sort(F.array_distinct("codes_error")), " + ")
    return classified.where(F.size("codes_error") > 0).groupBy(joined.alias("combination")).agg(F.count("*").alias("n"))


def corrections_histogram(classified: DataFrame) -> DataFrame:
    return classified.groupBy(F.size("corrections").alias("corrections")).agg(F.count("*").alias("n"))


def errors_histogram(classified: DataFrame) -> DataFrame:
    return classified.groupBy(F.size(F.array_distinct("codes_error")).alias("errors")).agg(F.count("*").alias("n"))


def top(counts: DataFrame, k: int) -> DataFrame:
    """The k most frequent, ties by name."""
    name = next(c for c in counts.columns if c != "n")
    return counts.orderBy(F.desc("n"), F.asc(name)).limit(k)


def status_samples(classified: DataFrame, order: str, k: int = 5, entries: int = 8) -> DataFrame:
    """The first k records of each status by `order`, with at most `entries` audit entries. The limit is applied in each
    task before the shuffle, so a status of most rows gathers k rows of each task at most."""
    by = Window.partitionBy("quality_status").orderBy(order)
    picked = classified.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return picked.withColumn("corrections", F.slice("corrections", 1, entries)).withColumn("details_error", F.slice("details_error", 1, entries))


def as_dict(counts: DataFrame) -> dict[str, int]:
    """A small table of counts, most frequent first. Codes, rules and statuses are closed sets; combinations are of these."""
    name = next(c for c in counts.columns if c != "n")
    return {str(r[name]): r["n"] for r in counts.orderBy(F.desc("n"), F.asc(name)).collect()}
