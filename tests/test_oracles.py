"""Every registered core query against DuckDB on the same tables."""

import math
from datetime import datetime
from pathlib import Path

import duckdb
import pytest

from quadloom import queries, queries_quads

QUERIES, ORACLES = queries.QUERIES | queries_quads.QUERIES, queries.ORACLES | queries_quads.ORACLES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents labels".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


def _cell(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, datetime):
        return x.isoformat()
    return x


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(_cell(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    want = duck.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert _rows(df.columns, df.collect()) == _rows(names, want.fetchall())


def test_plan_is_one_scan_for_a_statement(spark):
    plan = QUERIES["statement_qualifiers"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan and "Exchange" not in plan
    assert "l_extendedprice" not in plan and "PushedFilters" in plan and "GreaterThan(l_quantity,45.0)" in plan


def test_constants_reach_the_scan(spark):
    plan = QUERIES["lookup_subject"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(c_custkey,1)" in plan


@pytest.mark.parametrize(("name", "tables"), [("region_customers", {"customer", "nation", "region"}), ("wildcard_predicates", {"customer"}), ("supplier_nations", {"lineitem", "supplier", "nation"}), ("label_service", {"nation", "region"})])
def test_only_tables_of_possible_classes_are_read(spark, name, tables):
    read = QUERIES[name](spark, FOLDER).inputFiles()
    assert {t for t in TABLES if any(f"/{t}.parquet" in f for f in read)} == tables
