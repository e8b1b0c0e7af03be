"""The registered queries of this subpackage: one for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, language_id, line_dedup, minhash, mixing, pii, quality_model, quality_rules, sharding, substring_dedup


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies and the document that each is a copy of. Null and empty texts are no copies; rows that share an id are one document; no rows for an empty table. Further columns of the table are not read."""
    return minhash.duplicates(_table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with an earlier line within one word. Lines without a word stay; texts under one id are told apart by their key; ties go to the smallest (id, key, line). Further columns of the table are not read."""
    return line_dedup.repeats(_table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with its statistics, distance and verdict. Null languages and sources are groups of their own, null and empty texts have neutral statistics, repeated rows are each judged. Further columns of the table are not read."""
    return quality_rules.judge(_table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places and kinds of personal data. Null and empty texts have none; each repeated row is reported. Further columns of the table are not read."""
    return pii.spans(_table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated stretches of lines, but for the earliest. Null, empty and short texts have none; texts under one id are told apart by their key; equal rows are one document. Further columns of the table are not read."""
    return substring_dedup.repeats(_table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with its perplexity, contrast, thresholds and verdict. Null languages are one of their own; null and empty texts are kept, as is a language without trusted text; repeated rows are each judged. Further columns of the table are not read."""
    return quality_model.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each id with its region, rack and shard. A null id counts as ''; repeated ids have one place. Further columns of the table are not read."""
    return sharding.assign(_table(spark, sf_dir, "documents").select("doc_id"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the language of the network and whether its label may stay. Null and empty texts have no language and are kept; repeated rows are each judged. Further columns of the table are not read."""
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of benchmark items. Null and empty texts and items match nothing; items of one or two words are not searched for; each repeated row is reported. Further columns of the table are not read."""
    return decontaminate.spans(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's place in the mix. A null source counts as ''; null ids come first; rows that share an id have a place each. Further columns of the table are not read."""
    return mixing.mix(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup,
        op2_line_dedup,
        op3_quality_rules,
        op4_pii,
        op5_substring_dedup,
        op6_quality_classifier,
        op7_sharding,
        op8_language_id,
        op9_decontamination,
        op10_source_mixing,
    )
}

ORACLES: dict[str, str] = {
    "op2_line_dedup": line_dedup.oracle(),
    "op5_substring_dedup": substring_dedup.oracle(),
    "op9_decontamination": decontaminate.oracle(),
    "op10_source_mixing": mixing.oracle(),
    "op7_sharding": sharding.oracle(),
}
