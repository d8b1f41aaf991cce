"""A corpus pipeline of five stages: language, near copies, benchmark passages, personal data, mixture.

Each stage takes (spark, docs, sf_dir), works on all documents that the one before kept, and returns documents with the
columns of the table; the last returns the mixture, a row for each copy that it takes. A row is a document: the stages for
near copies and the mixture tell rows apart by keys of their own, so a null doc_id, or one that repeats, changes no
decision. Extra columns go through, whatever their names. SQL can't express the learned and drawn stages, so there is no oracle; tests compare with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import cut, free_name, quoted, stage_table, table
from millrace.llm.decontam import remove_contamination
from millrace.llm.langid import identify, learn
from millrace.llm.mixing import mix
from millrace.llm.ngram_join import link_groups
from millrace.llm.pii_crf import redacted

#: A language is recognised when its posterior probability is at least this.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose language isn't recognised, go; a missing lang is filled in. Without any labelled
    document no language is learned, none is recognised, and every document goes."""
    named, score = free_name("lang_pred", docs.columns), free_name("score", docs.columns)
    found = identify(docs, learn(docs), (named, score))
    kept = found.where((F.col(named) != "und") & (F.col(score) >= LEAST_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", named)).select(*map(quoted, docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest doc_id stays, one with a null doc_id only where there is no other.

    Rows are told apart by a key of their own, written with them once, as doc_id may be null or repeat. Different texts
    under one doc_id all stay. Of rows without words, which are no near copies, those that repeat doc_id and text make one.
    """
    key = free_name("_row", docs.columns)
    keyed = stage_table(docs.withColumn(key, F.monotonically_increasing_id()), "near_copies_input")
    linked = link_groups(keyed.select(F.col(key).alias("doc_id"), "text")).select(F.col("doc_id").alias(key), "group_id")
    text = F.coalesce("text", F.lit(""))
    bare = F.when(F.col("doc_id").isNotNull() & ~text.rlike(r"[0-9A-Za-z]|[^\x00-\x7F]"), text)
    named = cut(linked.join(keyed.select(key, "doc_id", bare.alias("_bare")), key))
    group = [F.when(F.col("_bare").isNull(), F.col("group_id")), F.when(F.col("_bare").isNotNull(), F.col("doc_id")), F.col("_bare")]
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", key))[key]
    stays = named.groupBy(*(g.alias(f"_g{k}") for k, g in enumerate(group))).agg(first.alias(key)).select(key)
    gone = named.select(key).join(stays, key, "left_anti")
    return keyed.join(gone, key, "left_anti").select(*map(quoted, docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are mostly benchmark items, of any length, go; of the others passages of eight words or more are cut."""
    return remove_contamination(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return redacted(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy of a document that the mixture takes, with its size in words and the copy's number.

    All columns of `docs` are carried; one named as what the mixture adds gives way to that.
    """
    carried = [c for c in docs.columns if c not in ("doc_id", "source", "size", "source_size", "target", "copies", "taken", "copy")]
    taken = mix(docs, carry=tuple(carried)).where("copies > 0")
    columns = [quoted(c) for c in docs.columns if c in ("doc_id", "source", *carried)]
    return taken.select(*columns, "size", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))


STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("decontaminate", decontaminate),
    ("personal_data", personal_data),
    ("mixture", mixture),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage_table(stage(spark, docs, sf_dir), name)
    return docs
