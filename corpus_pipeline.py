"""From raw documents to a sharded training mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's docs. All but the last return the
columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.llm import decontaminate, minhash, mixing, quality_rules, sharding
from quadloom.storage import shared_folder


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose statistics are not outliers of their language and source.

    Null languages and sources are groups of their own, null and empty texts are judged by their statistics, rows without
    an id are judged too, repeated rows alike; an empty table stays empty.
    """
    return quality_rules.accept(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    Null and empty texts and rows without an id are no copies and stay; of rows that share an id one stays.
    """
    return minhash.keep_first(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of the benchmark; documents that are mostly such passages go.

    Null texts, empty texts and items match nothing; each repeated row is treated alike; rows without an id too.
    """
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix; null sources count as '', null ids come first in their source."""
    return mixing.reorder(docs)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with region, rack and shard, and slot in the mix; columns of these names are replaced.

    Files are not read in the order they were written in, so the slot is worked
    out again; it follows from the ids and sources alone. Null ids and sources, ties
    and repeated rows each have a place; an empty table gives an empty one.
    """
    return mixing.placed(sharding.assign(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", accept_quality),
    ("near_copies", drop_near_copies),
    ("benchmark", remove_benchmark),
    ("mix", mix_sources),
    ("shards", assign_shards),
]

#: Minimum covariance determinants and automata are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents, each result written and read again; the rows are in the order of the mix.

    The last stage's files keep the slot, the result has only the order. A stage's
    files are deleted once the next stage has written its own.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if k:
            before = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
            before.getFileSystem(spark._jsc.hadoopConfiguration()).delete(before, True)
    return docs.orderBy("slot", F.coalesce("source", F.lit("")), "doc_id").drop("slot")
