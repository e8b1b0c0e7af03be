"""Triple patterns over the small quad fixtures."""

import pytest

from quadloom.engine import Engine
from quadloom.sources.quads import QuadSource, fixture
from quadloom.terms import SparqlError

ONE = "wd:Q1, wdt:P2, wd:Q3, wds:4"
Q, P, ST = "http://www.wikidata.org/entity/Q", "http://www.wikidata.org/prop/", "http://www.wikidata.org/entity/statement/"


@pytest.fixture(scope="module")
def ask(spark):
    def run(pattern, quads=ONE, head="*"):
        df = Engine(QuadSource(fixture(spark, quads))).sparql(f"SELECT {head} WHERE {{ {pattern} }}")
        return sorted(tuple(r) for r in df.collect())

    return run


@pytest.mark.parametrize(
    ("pattern", "want"),
    [
        ("wd:Q1 wdt:P2 ?o", [(Q + "3",)]),
        ("wd:Q1 p:P2 ?st", [("4",)]),
        ("?s wdt:P2 wd:Q3", [(Q + "1",)]),
        ("?s p:P2 wd:Q3", []),
        ("?s p:P2 wds:4", [(Q + "1",)]),
        ("?s wdt:P2 wds:4", []),
        ("?s p:P2 ?st", [(Q + "1", "4")]),
        ("?s wdt:P2 ?o", [(Q + "1", Q + "3")]),
        ("?s ?p wd:Q3", [(Q + "1", P + "direct/P2")]),
        ("?s ?p wds:4", [(Q + "1", P + "P2")]),
        ("wd:Q1 ?p wd:Q3", [(P + "direct/P2",)]),
        ("wd:Q1 ?p wds:4", [(P + "P2",)]),
        ("wd:Q1 ?p ?o", [(P + "P2", ST + "4"), (P + "direct/P2", Q + "3")]),
        ("?s ?p ?o", [(Q + "1", P + "direct/P2", Q + "3")]),
        ("?st ps:P2 ?v", [("4", Q + "3")]),
        ("?x wdt:P2 ?x", []),
        ("_:a wdt:P2 ?o", [(Q + "3",)]),
        ("?s rdfs:label ?o", []),
        ("?s <http://example.org/x> ?o", []),
    ],
)
def test_shapes(ask, pattern, want):
    assert ask(pattern) == want


@pytest.mark.parametrize(("pattern", "there"), [("wd:Q1 wdt:P2 wd:Q3", True), ("wd:Q1 p:P2 wds:4", True), ("wd:Q1 wdt:P2 wd:Q18", False), ("wd:Q1 p:P3 wds:4", False)])
def test_ask(spark, pattern, there):
    assert Engine(QuadSource(fixture(spark, ONE))).ask(f"ASK {{ {pattern} }}") is there


def test_two_quads_and_duplicates(ask):
    two = "wd:Q1, wdt:P2, wd:Q3, wds:4; wd:Q11, wdt:P12, wd:Q13, wds:14"
    assert ask("?s ?p ?o", two, "?s") == [(Q + "1",), (Q + "11",)]
    # A fact that is stated twice counts twice.
    same = "wd:Q1, wdt:P2, wd:Q3, wds:4; wd:Q1, wdt:P2, wd:Q3, wds:5; wd:Q1, wdt:P2, wd:Q11, wds:6"
    assert ask("wd:Q1 wdt:P2 ?o", same) == [(Q + "11",), (Q + "3",), (Q + "3",)]
    assert ask("wd:Q1 p:P2 ?st . ?st ps:P2 wd:Q3", same) == [("4",), ("5",)]


def test_join_with_constant_and_cycle(ask):
    loop = "wd:Q1, wdt:P2, wd:Q2, wds:1; wd:Q2, wdt:P2, wd:Q1, wds:2; wd:Q2, wdt:P2, wd:Q3, wds:3"
    assert ask("wd:Q1 wdt:P2 ?b . ?b wdt:P2 wd:Q1", loop) == [(Q + "2",)]
    assert ask("?a wdt:P2 ?b . ?b wdt:P2 ?a", loop) == [(Q + "1", Q + "2"), (Q + "2", Q + "1")]


CYCLE = "wd:Q1, wdt:P2, wd:Q2, wds:1; wd:Q2, wdt:P2, wd:Q3, wds:2; wd:Q3, wdt:P2, wd:Q1, wds:3; wd:Q3, wdt:P5, wd:Q9, wds:4"


@pytest.mark.parametrize(
    ("pattern", "want"),
    [
        ("wd:Q1 wdt:P2+ ?o", ["1", "2", "3"]),
        ("wd:Q1 wdt:P2* ?o", ["1", "2", "3"]),
        ("?o wdt:P2+ wd:Q1", ["1", "2", "3"]),
        ("wd:Q77 wdt:P2* ?o", ["77"]),
        ("wd:Q77 wdt:P2+ ?o", []),
        ("wd:Q1 wdt:P2? ?o", ["1", "2"]),
        ("wd:Q1 wdt:P2/wdt:P2 ?o", ["3"]),
        ("wd:Q1 ^wdt:P2 ?o", ["3"]),
        ("wd:Q3 (wdt:P2|wdt:P5) ?o", ["1", "9"]),
        ("wd:Q3 !wdt:P2 ?o", ["9"]),
        ("wd:Q1 !^wdt:P5 ?o", ["3"]),
        ("wd:Q1 (wdt:P2/wdt:P2)+ ?o", ["1", "2", "3"]),
        ("wd:Q2 ^(wdt:P2/wdt:P2) ?o", ["3"]),
    ],
)
def test_paths(ask, pattern, want):
    assert [r[0].removeprefix(Q) for r in ask(pattern, CYCLE)] == want


def test_path_between_variables(ask):
    assert len(ask("?a wdt:P2+ ?b", CYCLE)) == 9
    # Zero steps hold for every node of the graph, Q9 included.
    assert len(ask("?a wdt:P2* ?b", CYCLE)) == 10
    assert len(ask("?a wdt:P2+ ?a", CYCLE)) == 3


@pytest.mark.parametrize(
    "text",
    [
        "SELECT ?x WHERE { ?x wdt:P1 }",
        "SELECT WHERE { ?x wdt:P1 ?y }",
        "SELECT ?x WHERE { ?x nope:P1 ?y }",
        "SELECT ?x WHERE { ?x wdt:P1 ?y } LIMIT x",
        "SELECT ?y (COUNT(?x) AS ?n) WHERE { ?x wdt:P1 ?y }",
        "SELECT ?x WHERE { GRAPH ?g { ?x wdt:P1 ?y } }",
        "SELECT ?x WHERE { SERVICE <http://example.org/> { ?x wdt:P1 ?y } }",
        'SELECT ?x WHERE { ?x wdt:P1 ?y FILTER(REGEX(?y, "(")) }',
        "SELECT ?x WHERE { ?x wdt:P1 ?y FILTER(<http://example.org/f>(?y)) }",
        "SELECT ?x WHERE { ?x wdt:P1 ?y BIND(1 AS ?y) }",
        "DESCRIBE wd:Q1",
        "SELECT ?x WHERE { ?x wdt:P1 ?y",
    ],
)
def test_errors(spark, text):
    with pytest.raises(SparqlError):
        Engine(QuadSource(fixture(spark, ONE))).sparql(text)


def test_upper_and_lower_case_variables_differ(ask):
    assert ask("?x wdt:P2 ?X", head="?x ?X") == [(Q + "1", Q + "3")]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


LOOSE = "wd:Q1, wdt:P1, wd:Q11, wds:1; wd:Q2, wdt:P1, wd:Q12, wds:2; wd:Q1, wdt:P2, wd:Q21, wds:3; wd:Q3, wdt:P1, wd:Q11, wds:4; wd:Q9, wdt:P3, wd:Q21, wds:5; wd:Q8, wdt:P3, wd:Q22, wds:6; wd:Q9, wdt:P4, wd:Q1, wds:7; wd:Q8, wdt:P4, wd:Q2, wds:8"


@pytest.mark.parametrize(
    ("query", "want"),
    [
        # ?y is bound for Q1 alone; the other rows are compatible with any.
        ("SELECT ?x ?y ?z WHERE { ?x wdt:P1 ?a OPTIONAL { ?x wdt:P2 ?y } OPTIONAL { ?z wdt:P3 ?y } }", [(1, 21, 9), (2, 21, 9), (2, 22, 8), (3, 21, 9), (3, 22, 8)]),
        ("SELECT ?x WHERE { ?x wdt:P1 ?a OPTIONAL { ?x wdt:P2 ?y } MINUS { ?z wdt:P3 ?y } }", [(2,), (3,)]),
        ("SELECT ?x WHERE { ?x wdt:P1 ?a OPTIONAL { ?x wdt:P2 ?y } MINUS { ?x wdt:P1 wd:Q11 OPTIONAL { ?x wdt:P2 ?y } } }", [(2,)]),
        ("SELECT ?x WHERE { ?x wdt:P1 ?a OPTIONAL { ?x wdt:P2 ?y } FILTER EXISTS { ?z wdt:P3 ?y ; wdt:P4 ?x } }", [(1,), (2,)]),
        ("SELECT ?x WHERE { ?x wdt:P1 ?a OPTIONAL { ?x wdt:P2 ?y } FILTER NOT EXISTS { ?z wdt:P3 ?y ; wdt:P4 ?x } }", [(3,)]),
        ("SELECT ?x ?z WHERE { ?x wdt:P1 ?a OPTIONAL { ?x wdt:P2 ?y } OPTIONAL { ?z wdt:P4 ?x OPTIONAL { ?x wdt:P2 ?y } } }", [(1, 9), (2, 8), (3, None)]),
        ("SELECT ?x ?e WHERE { ?x wdt:P1 ?a OPTIONAL { ?x wdt:P2 ?y } BIND(EXISTS { ?z wdt:P3 ?y ; wdt:P4 ?x } AS ?e) }", [(1, True), (2, True), (3, False)]),
        ("SELECT ?x ?b WHERE { ?x wdt:P1 ?a OPTIONAL { ?z wdt:P4 ?x . ?z wdt:P3 ?b FILTER EXISTS { ?x wdt:P2 ?b } } }", [(1, 21), (2, None), (3, None)]),
        ("SELECT ?x ?z WHERE { ?x wdt:P1 ?a OPTIONAL { ?z wdt:P4 ?x FILTER(?a = wd:Q11) FILTER(?z = wd:Q9) } }", [(1, 9), (2, None), (3, None)]),
        # A filter on the outer row inside an expression, an OPTIONAL and a UNION.
        ("SELECT ?x ?e WHERE { ?x wdt:P1 ?a BIND(IF(EXISTS { ?z wdt:P4 ?x FILTER(?a = wd:Q11) }, 1, 0) AS ?e) }", [(1, 1), (2, 0), (3, 0)]),
        ("SELECT ?x WHERE { ?x wdt:P1 ?a FILTER(EXISTS { ?z wdt:P4 ?x FILTER(?a = wd:Q12) } || ?x = wd:Q3) }", [(2,), (3,)]),
        ("SELECT ?x WHERE { ?x wdt:P1 ?a FILTER EXISTS { { ?z wdt:P4 ?x FILTER(?a = wd:Q11) } UNION { ?x wdt:P2 ?b FILTER(?a = wd:Q12) } } }", [(1,)]),
        ("SELECT ?x WHERE { ?x wdt:P1 ?a FILTER EXISTS { ?z wdt:P4 ?x OPTIONAL { ?z wdt:P3 ?u FILTER(?a = wd:Q11) } FILTER(BOUND(?u)) } }", [(1,)]),
    ],
)
def test_variables_that_may_be_unbound(spark, query, want):
    df = Engine(QuadSource(fixture(spark, LOOSE))).sparql(query)
    number = lambda v: int(v.rsplit("Q", 1)[1]) if isinstance(v, str) else v
    assert sorted((tuple(map(number, r)) for r in df.collect()), key=repr) == sorted(want, key=repr)
    if "?x } }" in query:
        assert "BroadcastNestedLoopJoin" not in _plan(df)


def test_no_nested_loop_for_unbound_variables(spark):
    for kind in ("MINUS {", "FILTER EXISTS {", "FILTER NOT EXISTS {", "OPTIONAL {"):
        df = Engine(QuadSource(fixture(spark, LOOSE))).sparql(f"SELECT ?x WHERE {{ ?x wdt:P1 ?a OPTIONAL {{ ?x wdt:P2 ?y }} {kind} ?x wdt:P1 ?b OPTIONAL {{ ?x wdt:P2 ?y }} }} }}")
        assert "BroadcastNestedLoopJoin" not in _plan(df) and "CartesianProduct" not in _plan(df)


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("SELECT ?x ?y WHERE { ?x wdt:P9 wd:Q100 . ?x wdt:P1+ ?y }", [(1, 2), (1, 3), (1, 4)]),
        ("SELECT ?x ?y WHERE { ?x wdt:P1* ?y . ?x wdt:P9 wd:Q100 }", [(1, 1), (1, 2), (1, 3), (1, 4)]),
        ("SELECT ?x ?y WHERE { ?x wdt:P1+ ?y . ?y wdt:P9 wd:Q101 }", [(1, 4), (2, 4), (3, 4)]),
        ("SELECT ?x ?y WHERE { ?x wdt:P1* ?y . ?y wdt:P9 wd:Q101 }", [(1, 4), (2, 4), (3, 4), (4, 4)]),
        ("SELECT ?x ?y ?z WHERE { ?x wdt:P9 wd:Q100 . ?y wdt:P1* ?z . ?x wdt:P1+ ?y . ?z wdt:P9 ?c }", [(1, 2, 4), (1, 3, 4), (1, 4, 4)]),
        ("SELECT (COUNT(*) AS ?n) WHERE { ?x wdt:P1+ ?y }", [(6 + 1,)]),
    ],
)
def test_closures_start_from_what_is_bound(spark, query, want):
    quads = "wd:Q1, wdt:P1, wd:Q2, wds:1; wd:Q2, wdt:P1, wd:Q3, wds:2; wd:Q3, wdt:P1, wd:Q4, wds:3; wd:Q7, wdt:P1, wd:Q8, wds:4; wd:Q1, wdt:P9, wd:Q100, wds:5; wd:Q4, wdt:P9, wd:Q101, wds:6"
    df = Engine(QuadSource(fixture(spark, quads))).sparql(query)
    number = lambda v: int(v.rsplit("Q", 1)[1]) if isinstance(v, str) else v
    assert sorted(tuple(map(number, r)) for r in df.collect()) == want
