"""The queries op1_ to op10_ over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import chat_tree, decontam, quality_rules, warc_zst
from millrace.llm.common import table
from millrace.llm.decontam import contamination_digest
from millrace.llm.langid import held_out_languages
from millrace.llm.mixing import mix
from millrace.llm.ngram_join import link_groups
from millrace.llm.pii_crf import pii_digest
from millrace.llm.quality_bt import held_out_quality
from millrace.llm.quality_rules import rule_verdicts
from millrace.llm.token_counts import count_tokens
from millrace.llm.warc_zst import archive_round_trip

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str) -> Callable:
    def register(function: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = function
        return function

    return register


@query("op1_mix_sources")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


@query("op2_language_id")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return held_out_languages(table(spark, sf_dir, "documents"))


@query("op3_decontaminate")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL["op3_decontaminate"] = decontam.SQL


@query("op4_quality_rank")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return held_out_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op6_token_counts")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


@query("op5_ngram_join")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_groups(table(spark, sf_dir, "documents"))


@query("op8_quality_rules")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_verdicts(table(spark, sf_dir, "documents"))


SQL["op8_quality_rules"] = quality_rules.SQL


@query("op10_warc_zst")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages"))


SQL["op10_warc_zst"] = warc_zst.SQL


@query("op7_pii")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(table(spark, sf_dir, "documents"))


@query("op9_chat_tree")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_tree.read_back(chat_tree.packs(chat_tree.with_trap(spark, table(spark, sf_dir, "conversations"))))


SQL["op9_chat_tree"] = chat_tree.SQL
