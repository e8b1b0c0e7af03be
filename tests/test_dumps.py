"""Dump lines to quads, the quad table on disk, labels, streaming, results, server and command line."""

import json
import threading
import urllib.error
import urllib.parse
import urllib.request

import pytest

from quadloom import cli, server
from quadloom.engine import Engine
from quadloom.sources import dumps, quads
from quadloom.streaming import ingest

WIKI = "http://www.wikidata.org/entity/"


def snak(p, datatype, value, kind="string"):
    return {"snaktype": "value", "property": p, "datatype": datatype, "datavalue": {"value": value, "type": kind}}


def claim(p, datatype, value, number, **more):
    return {"mainsnak": snak(p, datatype, value), "type": "statement", "id": f"Q1$A{number}", "rank": "normal", "references": [], **more}


def time(text, precision=11, calendar="Q1985727"):
    return {"time": text, "timezone": 0, "before": 0, "after": 0, "precision": precision, "calendarmodel": WIKI + calendar}


VALUES = {
    "P1": ("external-id", "X-1", "X-1"),
    "P2": ("string", "plain", "plain"),
    "P3": ("geo-shape", "Data:A.map", "http://commons.wikimedia.org/data/main/Data:A.map"),
    "P4": ("commonsMedia", "A.jpg", "http://commons.wikimedia.org/wiki/Special:FilePath/A.jpg"),
    "P5": ("url", "http://x.org/", "http://x.org/"),
    "P6": ("math", "E=mc^2", "E=mc^2"),
    "P7": ("musical-notation", "\\relative", "\\relative"),
    "P8": ("tabular-data", "Data:A.tab", "http://commons.wikimedia.org/data/main/Data:A.tab"),
    "P9": ("globe-coordinate", {"latitude": 1.5, "longitude": -2.25, "altitude": None, "precision": 0.1, "globe": WIKI + "Q2"}, "Point(-2.25 1.5)"),
    "P10": ("wikibase-item", {"entity-type": "item", "numeric-id": 42, "id": "Q42"}, WIKI + "Q42"),
    "P11": ("wikibase-property", {"id": "P7"}, "http://www.wikidata.org/prop/direct/P7"),
    "P12": ("wikibase-lexeme", {"id": "L5"}, WIKI + "L5"),
    "P13": ("wikibase-sense", {"id": "L5-S2"}, WIKI + "L5"),
    "P14": ("wikibase-form", {"id": "L5-F1"}, WIKI + "L5"),
    "P15": ("quantity", {"amount": "+12.5", "unit": WIKI + "Q11573", "upperBound": "+13"}, "12.5"),
    "P16": ("time", time("+1879-03-14T00:00:00Z"), "1879-03-14T00:00:00Z"),
    "P17": ("monolingualtext", {"text": "bonjour", "language": "fr"}, "bonjour"),
}


@pytest.fixture(scope="module")
def dump(tmp_path_factory):
    claims = {p: [claim(p, d, v, k)] for k, (p, (d, v, _)) in enumerate(VALUES.items())}
    claims["P18"] = [{"mainsnak": {"snaktype": "somevalue", "property": "P18", "datatype": "string"}, "id": "Q1$B1", "rank": "normal"}, {"mainsnak": {"snaktype": "novalue", "property": "P18", "datatype": "string"}, "id": "Q1$B2", "rank": "normal"}]
    claims["P10"].append(claim("P10", "wikibase-item", {"id": "Q43"}, "Q", rank="deprecated", qualifiers={"P16": [snak("P16", "time", time("-0044-03-15T00:00:00Z"))], "P15": [snak("P15", "quantity", {"amount": "3", "unit": "1"})]}))
    claims["P16"].append(claim("P16", "time", time("-13798000000-00-00T00:00:00Z", 3), "BIG"))
    one = {"id": "Q1", "type": "item", "labels": {"en": {"language": "en", "value": "universe"}, "de": {"language": "de", "value": "Universum"}}, "descriptions": {"en": {"language": "en", "value": "all there is"}}, "aliases": {"en": [{"language": "en", "value": "world"}, {"language": "en", "value": "cosmos"}]}, "claims": claims, "sitelinks": {"enwiki": {"site": "enwiki", "title": "Universe"}}}
    two = {"id": "Q42", "type": "item", "labels": {"de": {"language": "de", "value": "Zweiundvierzig"}}, "claims": {}}
    lexeme = {"id": "L5", "type": "lexeme", "lemmas": {"en": {"language": "en", "value": "go"}}, "claims": {"P2": [{"mainsnak": snak("P2", "string", "verb"), "id": "L5$C", "rank": "normal"}]}}
    path = tmp_path_factory.mktemp("dump") / "lines.json"
    path.write_text("[\n" + ",\n".join(map(json.dumps, (one, two, lexeme))) + ",\nnot json\n\n]\n")
    return path


@pytest.fixture(scope="module")
def table(spark, dump, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("table") / "quads")
    quads.write(dumps.read(spark, str(dump)), path, path + "-o")
    return path


@pytest.fixture(scope="module")
def engine(spark, table):
    return Engine(quads.QuadSource(quads.read(spark, table), quads.read(spark, table + "-o")))


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("p", list(VALUES))
def test_datatypes(engine, p):
    got = {r[0] for r in engine.sparql(f"SELECT (STR(?v) AS ?s) WHERE {{ wd:Q1 wdt:{p} ?v }}").collect()}
    assert VALUES[p][2] in got


def test_missing_values_state_nothing_but_stay_statements(engine):
    assert rows(engine.sparql("SELECT ?v WHERE { wd:Q1 wdt:P18 ?v }")) == []
    assert rows(engine.sparql("SELECT ?st WHERE { wd:Q1 p:P18 ?st }")) == [("Q1-B1",), ("Q1-B2",)]


def test_statement_with_qualifiers(engine):
    got = engine.sparql("SELECT ?st ?v ?n (YEAR(?t) AS ?y) (MONTH(?t) AS ?m) WHERE { wd:Q1 p:P10 ?st . ?st ps:P10 ?v ; pq:P16 ?t ; pq:P15 ?n }")
    assert rows(got) == [("Q1-AQ", WIKI + "Q43", "3", -44, 3)]


def test_values_of_time_and_quantity(engine):
    assert rows(engine.sparql('SELECT (STR(?t) AS ?s) WHERE { wd:Q1 wdt:P16 ?t FILTER(?t < "1879-01-01"^^xsd:date) }')) == [("-13798000000-00-00T00:00:00Z",)]
    assert rows(engine.sparql("SELECT (?q * 2 AS ?d) WHERE { wd:Q1 wdt:P15 ?q FILTER(?q > 12 && ISNUMERIC(?q)) }")) == [(25.0,)]
    assert rows(engine.sparql("SELECT ?s WHERE { ?s wdt:P15 12.5 }")) == [(WIKI + "Q1",)]
    assert rows(engine.sparql('SELECT ?s WHERE { ?s wdt:P17 "bonjour"@fr }')) == [(WIKI + "Q1",)]
    assert rows(engine.sparql('SELECT ?s WHERE { ?s wdt:P17 "bonjour" }')) == []


def test_labels(engine):
    q = 'SELECT ?v ?vLabel ?vAltLabel ?vDescription WHERE { VALUES ?v { wd:Q1 wd:Q42 wd:Q99 } SERVICE wikibase:label { bd:serviceParam wikibase:language "en, de" } }'
    assert {r["vLabel"]: r["vAltLabel"] for r in engine.sparql(q).collect()} == {"universe": "cosmos,world", "Zweiundvierzig": None, None: None}
    assert rows(engine.sparql('SELECT ?x WHERE { ?x rdfs:label "Universum"@de }')) == [(WIKI + "Q1",)]
    assert rows(engine.sparql('SELECT ?l WHERE { wd:Q1 skos:altLabel ?l FILTER(LANG(?l) = "en") }')) == [("cosmos",), ("world",)]


def test_language_filter_and_no_qualifiers(spark, dump):
    q = dumps.read(spark, str(dump), ["de"], qualifiers=False)
    assert q.where("pkey = 'label'").count() == 2 and q.where("pkey = 'alias'").count() == 0
    assert q.where(f"s.k = {24}").count() == 0
    assert dumps.read(spark, str(dump), []).where("pkey = 'label'").count() == 0


def test_lookup_reads_one_partition(engine):
    plan = engine.sparql("SELECT ?v WHERE { wd:Q1 wdt:P10 ?v }")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(pkey" in plan and "EqualTo(s.i,1)" in plan


def test_a_dump_is_read_once(spark, dump):
    plan = dumps.read(spark, str(dump))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan text") == 1 and plan.count("Generate") == 1 and "Exchange" not in plan


def test_lookup_by_object_reads_the_copy(engine, table):
    df = engine.sparql("SELECT ?s WHERE { ?s wdt:P10 wd:Q42 }")
    assert rows(df) == [(WIKI + "Q1",)] and all("quads-o/" in f for f in df.inputFiles())


def test_a_frequent_predicate_has_many_files(spark, tmp_path):
    many = quads.fixture(spark, "wd:Q1, wdt:P2, wd:Q3, wds:4").crossJoin(spark.range(20_000).toDF("n")).selectExpr("struct(s.k, n AS i, s.d, s.s, s.l) AS s", "p", "o", "cast(n AS string) AS id", "claim", "rank", "pkey")
    rare = quads.fixture(spark, "; ".join(f"wd:Q{n}, wdt:P{n}, wd:Q3, wds:{n}" for n in range(10, 20)))
    path = str(tmp_path / "t")
    quads.write(many.unionByName(rare), path)
    files = [f.split("pkey=")[1].split("/")[0] for f in quads.read(spark, path).inputFiles()]
    assert files.count("P2") >= 3 and all(files.count(f"P{n}") == 1 for n in range(10, 20))
    assert quads.read(spark, path).count() == 20_010


def test_label_function(engine):
    got = engine.sparql('SELECT ?v (wikibase:label(?v, "fr", "de") AS ?l) WHERE { VALUES ?v { wd:Q1 wd:Q42 wd:Q99 } }')
    assert {r["l"] for r in got.collect()} == {"Universum", "Zweiundvierzig", None}
    assert rows(engine.sparql('SELECT ?v WHERE { VALUES ?v { wd:Q1 wd:Q42 } FILTER(wikibase:label(?v, "en") = "universe") }')) == [(1,)]


def test_labels_are_reduced_before_they_are_aggregated(engine):
    plan = engine.sparql('SELECT ?v ?vLabel WHERE { VALUES ?v { wd:Q1 } SERVICE wikibase:label { bd:serviceParam wikibase:language "en,de" } }')._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate [s") < plan.index("LeftSemi")


def test_json(engine):
    out = json.loads("".join(engine.json('SELECT ?v ?n ?nothing WHERE { wd:Q1 wdt:P17 ?v ; wdt:P15 ?n }')))
    assert out["head"]["vars"] == ["v", "n", "nothing"]
    assert out["results"]["bindings"] == [{"v": {"type": "literal", "value": "bonjour", "xml:lang": "fr"}, "n": {"type": "literal", "value": "12.5", "datatype": "http://www.w3.org/2001/XMLSchema#decimal"}}]
    assert json.loads("".join(engine.json("ASK { wd:Q1 wdt:P10 wd:Q42 }")))["boolean"] is True
    assert json.loads("".join(engine.json("SELECT ?v WHERE { wd:Q1 wdt:P10 ?v . ?v rdfs:label ?l }")))["results"]["bindings"] == [{"v": {"type": "uri", "value": WIKI + "Q42"}}]


def test_server(engine):
    web = server.serve(engine, 0)
    threading.Thread(target=web.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{web.server_port}"
    try:
        with urllib.request.urlopen(f"{base}/query?" + urllib.parse.urlencode({"query": "SELECT ?v WHERE { wd:Q1 wdt:P2 ?v }"})) as r:
            assert r.headers["Access-Control-Allow-Origin"] == "*"
            assert json.load(r)["results"]["bindings"] == [{"v": {"type": "literal", "value": "plain"}}]
        assert b"<form" in urllib.request.urlopen(base).read()
        for bad in ("/query", "/query?query=nonsense"):
            with pytest.raises(urllib.error.HTTPError) as e:
                urllib.request.urlopen(base + bad)
            assert e.value.code == 400
        late = urllib.parse.urlencode({"query": 'SELECT ?v WHERE { wd:Q1 wdt:P2 ?v ; wdt:P7 ?p FILTER(REGEX(?v, CONCAT("(", ?p)))}'})
        with pytest.raises(urllib.error.HTTPError) as e:
            urllib.request.urlopen(f"{base}/query?{late}")
        assert e.value.code == 500
    finally:
        web.shutdown()


def test_stream_equals_batch(spark, dump, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(dump.read_text())
    ingest.ingest(ingest.quads(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
    got = {(r.id, r.pkey) for r in quads.read(spark, str(tmp_path / "out")).collect()}
    assert got == {(r.id, r.pkey) for r in dumps.read(spark, str(dump)).collect()}


def test_command_line(spark, dump, tmp_path, capsys):
    db = str(tmp_path / "db")
    assert cli.main(["-d", db, "create-db", "-f", str(dump), "-l", "en"]) == 0
    assert cli.main(["-d", db, "create-index", "--by-object", db + "-o"]) == 0
    assert quads.read(spark, db + "-o").count() == quads.read(spark, db).count()
    cli.repl(Engine(quads.QuadSource(quads.read(spark, db))), ["SELECT ?v", "WHERE { wd:Q1 wdt:P2 ?v }", "", "nonsense", "", "exit"])
    by_object = cli.open_engine(spark, db, db + "-o").sparql("SELECT ?s WHERE { ?s wdt:P10 wd:Q42 }")
    assert by_object.count() == 1 and all("db-o/" in f for f in by_object.inputFiles())
    out = capsys.readouterr().out
    assert "plain" in out and "error:" in out
