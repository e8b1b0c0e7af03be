"""Joins of values that repeat on both sides."""

import pytest
from pyspark.sql import functions as F

from quadloom import queries
from quadloom.operators import joins
from quadloom.plans.relation import Rel, V

from .test_oracles import FOLDER, _rows, duck  # noqa: F401


def _sides(spark):
    """Value 7 in 400 and 300 rows (some of them equal), values 0 to 39 in few, others on one side only."""
    left = spark.range(400).select(F.lit(7).cast("bigint").alias("v_n"), (F.col("id") % 390).alias("v_a")).unionByName(spark.range(60).select((F.col("id") % 50).alias("v_n"), F.col("id").alias("v_a")))
    right = spark.range(300).select(F.lit(7).cast("bigint").alias("v_n"), F.col("id").alias("v_b")).unionByName(spark.range(80).select((F.col("id") % 40).alias("v_n"), F.col("id").alias("v_b")))
    return Rel(left, {"n": V("item", repeats=True), "a": V("item", repeats=True)}), Rel(right, {"n": V("item", repeats=True), "b": V("item", repeats=True)})


def test_pairs_of_a_frequent_value_are_spread(spark, monkeypatch):
    monkeypatch.setattr(joins, "BLOCK", 20)
    left, right = _sides(spark)
    got = joins.join(left, right).df
    want = left.df.join(right.df, "v_n")
    assert sorted(map(tuple, got.select("v_n", "v_a", "v_b").collect())) == sorted(map(tuple, want.select("v_n", "v_a", "v_b").collect()))
    sizes = sorted(r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect())
    assert len(sizes) == 4 and sizes[-1] < 0.6 * sum(sizes)


@pytest.mark.parametrize("name", ["join_groups"])
def test_groups_equal_sql_in_blocks(spark, duck, monkeypatch, name):  # noqa: F811
    monkeypatch.setattr(joins, "BLOCK", 2)
    got, want = queries.QUERIES[name](spark, FOLDER), duck.execute(queries.ORACLES[name])
    assert _rows(got.columns, got.collect()) == _rows([d[0] for d in want.description], want.fetchall())


def test_what_multiplies_rows_comes_last(spark, monkeypatch):
    a, b = _sides(spark)
    c = Rel(spark.range(5).select(F.col("id").alias("v_n"), F.col("id").alias("v_r")), {"n": V("item"), "r": V("item", repeats=True)})
    order, join = [], joins.join
    monkeypatch.setattr(joins, "join", lambda left, right: order.append(sorted(right.vars)) or join(left, right))
    out = joins.join_all([a, b, c])
    assert order == [["n", "r"], ["b", "n"]] and list(out.vars) == ["n", "a", "b", "r"]


def test_joins_on_keys_stay_plain(spark):
    plan = queries.QUERIES["bgp_path3"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64" not in plan
