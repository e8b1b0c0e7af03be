"""The registered queries over quads: nothing is stored for them, and over a stored table they answer the same."""

import pytest

from quadloom import queries_quads
from quadloom.engine import Engine
from quadloom.sources import dumps, quads

from .test_oracles import FOLDER, TABLES, _rows, duck  # noqa: F401


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stored") / "quads")
    queries_quads.dump_lines(spark, FOLDER).write.text(path + "-dump")
    quads.write(dumps.read(spark, path + "-dump"), path, path + "-o")
    return quads.QuadSource(quads.read(spark, path), quads.read(spark, path + "-o"))


@pytest.mark.parametrize("name", ["by_object", "by_statement", "about_subject", "same_variable_in_two", "qualifiers", "qualifiers_as_direct", "pricing", "times", "optional", "minus_unbound", "label_service", "path_seq", "path_star_inverse", "path_neg", "all_by_predicate"])
def test_stored_table_equals_sql(spark, duck, stored, name):  # noqa: F811
    text, sql = queries_quads.TEXTS[f"quads_{name}"]
    df = Engine(stored).sparql(text)
    want = duck.execute(sql)
    names = [d[0] for d in want.description]
    assert _rows(df.columns, df.collect()) == _rows(names, want.fetchall())


@pytest.mark.parametrize(("name", "tables"), [("quads_label_of_language", {"region", "nation", "supplier", "customer", "part", "orders"}), ("quads_objects_of", {"customer"}), ("quads_path_neg", {"nation"}), ("quads_pricing", {"lineitem"}), ("quads_path_seq", {"orders", "customer", "supplier", "nation"})])
def test_nothing_is_stored_and_only_tables_that_state_it_are_read(spark, name, tables):
    read = queries_quads.QUERIES[name](spark, FOLDER).inputFiles()
    assert {t for t in TABLES if any(f"/{t}.parquet" in f for f in read)} == tables
    assert all(f.removeprefix("file://").startswith(FOLDER) for f in read)


@pytest.mark.parametrize("name", ["quads_pricing", "quads_qualifiers", "quads_qualifiers_as_direct", "quads_all", "quads_about_subject"])
def test_a_statement_is_one_pass(spark, name):
    plan = queries_quads.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "quads-" not in plan


def test_rows_without_order_are_facts_too(spark, duck, tmp_path):  # noqa: F811
    for t in TABLES:
        df = spark.read.parquet(f"{FOLDER}/{t}.parquet")
        (df.where("o_orderkey > 700") if t == "orders" else df).write.parquet(str(tmp_path / f"{t}.parquet"))
    got = queries_quads.QUERIES["quads_pricing"](spark, str(tmp_path))
    text, sql = queries_quads.TEXTS["quads_pricing"]
    want = duck.execute(sql)
    assert _rows(got.columns, got.collect()) == _rows([d[0] for d in want.description], want.fetchall())
