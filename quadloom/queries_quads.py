"""Registered queries over a dump.

The star schema is turned into a dump, JSON entities in lines, the dump into quads, and these are
queried. Lines and quads are made while they are read, so that none of them lies on disk.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .queries import C, N, O_, P, R, S, _q
from .sources.dumps import once
from .sources.quads import DumpSource

WD = "http://www.wikidata.org/"


def _json(x: Column) -> Column:
    """A value as JSON."""
    one = F.to_json(F.struct(x.alias("v")))
    return F.substring(one, F.lit(6), F.length(one) - 6)


def _number(key: str, cls: int) -> Column:
    return ((F.col(key).cast("bigint") + 1) * 16 + cls).cast("string")


def _snak(p: int, datatype: str, value: Column) -> Column:
    return F.concat(F.lit(f'{{"snaktype":"value","property":"P{p}","datatype":"{datatype}","datavalue":{{"value":'), value, F.lit(',"type":"t"}}'))


def _value(kind: str, column: str, cls: int = 0) -> tuple[str, Column]:
    """Datatype and JSON of a column's values."""
    c = F.col(column)
    if kind == "item":
        return "wikibase-item", F.concat(F.lit('{"id":"Q'), _number(column, cls), F.lit('"}'))
    if kind == "quantity":
        return "quantity", F.concat(F.lit('{"unit":"1","amount":"+'), c.cast("string"), F.lit('"}'))
    if kind == "time":
        return "time", F.concat(F.lit('{"precision":11,"calendarmodel":"' + WD + 'entity/Q1985727","time":"+'), F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('"}'))
    return "string", _json(c)


#: table: class, key, name, {property: (kind, column, class of items)}
_ENTITIES: dict[str, tuple[int, str, str | None, dict[int, tuple]]] = {
    "region": (1, "r_regionkey", "r_name", {}),
    "nation": (2, "n_nationkey", "n_name", {11: ("item", "n_regionkey", 1)}),
    "supplier": (3, "s_suppkey", "s_name", {10: ("item", "s_nationkey", 2), 12: ("quantity", "s_acctbal")}),
    "customer": (4, "c_custkey", "c_name", {10: ("item", "c_nationkey", 2), 12: ("quantity", "c_acctbal"), 13: ("string", "c_mktsegment")}),
    "part": (5, "p_partkey", "p_name", {20: ("string", "p_brand"), 22: ("quantity", "p_size")}),
    "orders": (6, "o_orderkey", None, {30: ("item", "o_custkey", 4), 32: ("string", "o_orderstatus"), 34: ("time", "o_orderdate")}),
}
_QUALIFIERS = {41: ("item", "l_suppkey", 3), 43: ("quantity", "l_quantity"), 47: ("string", "l_returnflag"), 49: ("time", "l_shipdate")}


def dump_lines(spark: SparkSession, sf_dir: str, keys: set[str] | None = None, subject: int | None = None) -> DataFrame:
    """The tables as dump lines (column value): labels in English and German, descriptions and aliases of nations, order lines as statements with qualifiers.

    An order has one line for itself and one for each order line, so that nothing is shuffled. keys: only tables and
    columns that state one of these predicates (None: all); subject: only the entity of this number.
    """
    wanted = lambda key: keys is None or key in keys

    def rows(name: str, key: str, cls: int) -> DataFrame | None:
        if subject is not None and subject % 16 != cls:
            return None
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return df if subject is None else df.where(F.col(key) == subject // 16 - 1)

    lines = []

    def add(df: DataFrame, q: Column, texts: list[Column], claims: list[Column]) -> None:
        line = F.concat(F.lit('{"type":"item","id":"Q'), q, F.lit('",'), F.concat_ws(",", *texts, F.concat(F.lit('"claims":{'), F.concat_ws(",", *claims), F.lit("}"))), F.lit("},"))
        lines.append(df.select(once(line).alias("value")))

    for name, (cls, key, label, properties) in _ENTITIES.items():
        q = _number(key, cls)
        claims = [F.concat(F.lit(f'"P{p}":[{{"mainsnak":'), _snak(p, *_value(*v)), F.lit(',"type":"statement","rank":"normal","id":"Q'), q, F.lit(f'$P{p}"}}]')) for p, v in properties.items() if wanted(f"P{p}")]
        if wanted("P31"):
            kind = F.concat(F.lit('{"id":"Q'), F.lit(f"{cls}"), F.lit('"}'))
            claims.append(F.concat(F.lit('"P31":[{"mainsnak":'), _snak(31, "wikibase-item", kind), F.lit(f',"type":"statement","rank":"normal","id":"Q{cls}$'), q, F.lit('"}]')))
        texts = []
        if label and wanted("label"):
            text = lambda language, value: F.concat(F.lit(f'"{language}":{{"language":"{language}","value":'), _json(value), F.lit("}"))
            texts.append(F.concat(F.lit('"labels":{'), F.concat_ws(",", text("en", F.col(label)), text("de", F.lower(label))), F.lit("}")))
        if name == "nation" and wanted("description"):
            texts.append(F.concat(F.lit('"descriptions":{"en":{"language":"en","value":'), _json(F.concat(F.lit("nation "), F.col("n_nationkey").cast("string"))), F.lit("}}")))
        if name == "nation" and wanted("alias"):
            alias = lambda value: F.concat(F.lit('{"language":"en","value":'), _json(value), F.lit("}"))
            texts.append(F.concat(F.lit('"aliases":{"en":['), alias(F.upper(label)), F.lit(","), alias(F.reverse(F.col(label))), F.lit("]}")))
        if (claims or texts) and (df := rows(name, key, cls)) is not None:
            add(df, q, texts, claims)

    sides = [F.concat(F.lit(f'"P{p}":['), _snak(p, *_value(*v)), F.lit("]")) for p, v in _QUALIFIERS.items() if wanted(f"P{p}")]
    if (sides or wanted("P40")) and (df := rows("lineitem", "l_orderkey", 6)) is not None:
        q = _number("l_orderkey", 6)
        row = F.md5(F.to_json(F.struct(*sorted(df.columns))))
        statement = F.concat(F.lit('"P40":[{"mainsnak":'), _snak(40, *_value("item", "l_partkey", 5)), F.lit(',"type":"statement","rank":"normal","id":"Q'), q, F.lit("$"), row, F.lit('","qualifiers":{'), F.concat_ws(",", *sides), F.lit("}}]"))
        add(df, q, [], [statement])
    return reduce(DataFrame.unionByName, lines) if lines else spark.createDataFrame([], "value string")


def source(spark: SparkSession, sf_dir: str) -> DumpSource:
    """The quads of a folder's tables: they pass through dump lines and are read as a dump, and nothing is stored."""
    return DumpSource(spark, lambda keys, subject: dump_lines(spark, sf_dir, keys, subject))


TEXTS: dict[str, tuple[str, str]] = {}


def _add(name: str, sparql: str, sql: str) -> None:
    TEXTS[f"quads_{name}"] = (sparql, sql)


def _iri(number: str) -> str:
    return f"'{WD}entity/Q' || {number}"


def _direct(p: int) -> str:
    return f"'{WD}prop/direct/P{p}'"


_NR, _CN, _SN = _q("n_regionkey", 1), _q("c_nationkey", 2), _q("s_nationkey", 2)
#: How many facts there are of each predicate.
_COUNTS = {
    _direct(10): "(SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier)",
    _direct(11): "(SELECT count(*) FROM nation)",
    _direct(12): "(SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier)",
    _direct(13): "(SELECT count(*) FROM customer)",
    _direct(20): "(SELECT count(*) FROM part)",
    _direct(22): "(SELECT count(*) FROM part)",
    _direct(30): "(SELECT count(*) FROM orders)",
    _direct(31): " + ".join(f"(SELECT count(*) FROM {t})" for t in _ENTITIES),
    _direct(32): "(SELECT count(*) FROM orders)",
    _direct(34): "(SELECT count(*) FROM orders)",
    **{_direct(p): "(SELECT count(*) FROM lineitem)" for p in (40, *_QUALIFIERS)},
}
_NAMED = " + ".join(f"(SELECT count(*) FROM {t})" for t, (_, _, label, _) in _ENTITIES.items() if label)

# ---- shapes of one pattern
_add("all", "SELECT (COUNT(*) AS ?n) WHERE { ?s ?p ?o }", f"SELECT {' + '.join(_COUNTS.values())} + 2 * ({_NAMED}) + 3 * (SELECT count(*) FROM nation) AS n")
_add("all_by_predicate", "SELECT ?p (COUNT(*) AS ?n) WHERE { ?s ?p ?o FILTER(STRSTARTS(STR(?p), \"http\")) } GROUP BY ?p", " UNION ALL ".join(f"SELECT {p} AS p, {n} AS n" for p, n in _COUNTS.items()))
_add("by_object", "SELECT ?s ?p WHERE { ?s ?p wd:Q50 }", f"SELECT s, p FROM (SELECT {_iri(C)} AS s, {_direct(10)} AS p, {_CN} AS o FROM customer UNION ALL SELECT {_iri(S)}, {_direct(10)}, {_SN} FROM supplier) WHERE o = 50")
_add("by_statement", "SELECT ?s ?p WHERE { ?s ?p wds:Q34-P11 }", f"SELECT '{WD}entity/Q34' AS s, '{WD}prop/P11' AS p")
_add("scan_direct", "SELECT ?c ?seg WHERE { ?c wdt:P13 ?seg }", f"SELECT {_iri(C)} AS c, c_mktsegment AS seg FROM customer")
_add("scan_statements", "SELECT ?c ?st WHERE { ?c p:P13 ?st }", f"SELECT {_iri(C)} AS c, 'Q' || {C} || '-P13' AS st FROM customer")
_add("subjects_of", 'SELECT ?c WHERE { ?c wdt:P13 "BUILDING" }', f"SELECT {_iri(C)} AS c FROM customer WHERE c_mktsegment = 'BUILDING'")
_add("subject_of_statement", "SELECT ?s WHERE { ?s p:P11 wds:Q34-P11 }", f"SELECT '{WD}entity/Q34' AS s")
_add("kinds_never_meet", "SELECT ?s WHERE { { ?s p:P11 wd:Q17 } UNION { ?s wdt:P11 wds:Q34-P11 } }", "SELECT 'x' AS s WHERE false")
_add("about_subject", "SELECT ?p ?o WHERE { wd:Q34 ?p ?o }", f"SELECT v.p, v.o FROM nation, LATERAL (VALUES ({_direct(11)}, {_iri(_NR)}), ({_direct(31)}, '{WD}entity/Q2'), ('{WD}prop/P11', '{WD}entity/statement/Q34-P11'), ('{WD}prop/P31', '{WD}entity/statement/Q2-34'), ('en', n_name), ('de', lower(n_name)), ('en', 'nation ' || n_nationkey), ('en', upper(n_name)), ('en', reverse(n_name))) v(p, o) WHERE {N} = 34")
_add("between", "SELECT ?p ?q WHERE { wd:Q36 wdt:P10 ?n . wd:Q36 ?p ?n . wd:Q36 ?q wds:Q36-P10 }", f"SELECT {_direct(10)} AS p, '{WD}prop/P10' AS q FROM customer WHERE {C} = 36")
_add("objects_of", "SELECT ?seg ?n WHERE { wd:Q36 wdt:P13 ?seg ; wdt:P10 ?n }", f"SELECT c_mktsegment AS seg, {_iri(_CN)} AS n FROM customer WHERE {C} = 36")
_add("statements_of", "SELECT ?st WHERE { wd:Q36 p:P13 ?st }", "SELECT 'Q36-P13' AS st")
_add("fact_holds", "ASK { wd:Q34 p:P11 wds:Q34-P11 . wd:Q34 wdt:P31 wd:Q2 }", "SELECT true AS answer")
_add("fact_does_not_hold", "ASK { wd:Q34 p:P12 wds:Q34-P11 }", "SELECT false AS answer")
_add("same_variable_twice", "SELECT (COUNT(*) AS ?n) WHERE { ?x ?p ?x }", "SELECT 0::BIGINT AS n")
_add("same_variable_in_two", "SELECT ?x WHERE { ?x wdt:P10 ?y . ?x wdt:P31 wd:Q3 . ?x p:P10 ?st . ?st ps:P10 ?y }", f"SELECT {_iri(S)} AS x FROM supplier")
_add("blank_node", "SELECT ?c ?r WHERE { ?c wdt:P31 wd:Q4 ; wdt:P10 [ wdt:P11 ?r ] }", f"SELECT {_iri(C)} AS c, {_iri(_NR)} AS r FROM customer JOIN nation ON c_nationkey = n_nationkey")

# ---- statements, literals, times
_L = f"{_iri(_q('l_orderkey', 6))} AS o, {_iri(_q('l_partkey', 5))} AS part"
_add("qualifiers", "SELECT ?o ?part ?flag WHERE { ?o p:P40 ?st . ?st ps:P40 ?part ; pq:P43 ?qty ; pq:P47 ?flag FILTER(?qty > 45) }", f"SELECT {_L}, l_returnflag AS flag FROM lineitem WHERE l_quantity > 45")
_add("qualifiers_as_direct", "SELECT ?o ?part WHERE { ?o p:P40 ?st . ?st ps:P40 ?part ; wdt:P41 wd:Q35 }", f"SELECT {_L} FROM lineitem WHERE {_q('l_suppkey', 3)} = 35")
_add("pricing", 'SELECT ?flag (SUM(?qty) AS ?sum_qty) (COUNT(*) AS ?n) WHERE { ?o p:P40 [ pq:P47 ?flag ; pq:P43 ?qty ; pq:P49 ?date ] FILTER(?date <= "1998-09-02T00:00:00Z"^^xsd:dateTime) } GROUP BY ?flag', "SELECT l_returnflag AS flag, sum(l_quantity) AS sum_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1")
_add("quantities", "SELECT ?b (SUM(?z) AS ?total) (AVG(?z) AS ?mean) (COUNT(*) AS ?n) WHERE { ?p wdt:P20 ?b ; wdt:P22 ?z FILTER(?z > 10) } GROUP BY ?b", "SELECT p_brand AS b, sum(p_size)::DOUBLE AS total, avg(p_size) AS mean, count(*) AS n FROM part WHERE p_size > 10 GROUP BY 1")
_add("times", 'SELECT ?y (COUNT(*) AS ?n) WHERE { ?o wdt:P34 ?t FILTER(?t >= "1994-01-01"^^xsd:date) } GROUP BY (YEAR(?t) AS ?y)', "SELECT year(o_orderdate) AS y, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1994-01-01' GROUP BY 1")
_add("labels_in_languages", 'SELECT ?n ?a ?b WHERE { ?n wdt:P31 wd:Q2 ; rdfs:label ?a, ?b FILTER(LANG(?a) = "en" && LANG(?b) = "de") }', f"SELECT {_iri(N)} AS n, n_name AS a, lower(n_name) AS b FROM nation")
_add("label_of_language", 'SELECT ?n WHERE { ?n rdfs:label ?a ; wdt:P31 wd:Q2 FILTER(LANG(?a) = "de" && STRSTARTS(?a, "nation")) }', f"SELECT {_iri(N)} AS n FROM nation WHERE starts_with(lower(n_name), 'nation')")

# ---- joins
_add("two_patterns", "SELECT ?c ?n ?r WHERE { ?c wdt:P10 ?n . ?n wdt:P11 ?r }", f"SELECT {_iri(C)} AS c, {_iri(_CN)} AS n, {_iri(_NR)} AS r FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT {_iri(S)}, {_iri(_SN)}, {_iri(_NR)} FROM supplier JOIN nation ON s_nationkey = n_nationkey")
_add("count_by_subject", "SELECT ?c (COUNT(?o) AS ?n) (COUNT(DISTINCT ?s) AS ?kinds) WHERE { ?o wdt:P30 ?c ; wdt:P32 ?s } GROUP BY ?c", f"SELECT {_iri(_q('o_custkey', 4))} AS c, count(*) AS n, count(DISTINCT o_orderstatus) AS kinds FROM orders GROUP BY o_custkey")
_add("concat_by_object", 'SELECT ?r (COUNT(?n) AS ?many) (GROUP_CONCAT(?name; SEPARATOR=", ") AS ?names) (SAMPLE(?n) AS ?one) WHERE { ?n wdt:P11 ?r ; rdfs:label ?name FILTER(LANG(?name) = "en") } GROUP BY ?r', f"SELECT {_iri(_NR)} AS r, count(*) AS many, string_agg(n_name, ', ' ORDER BY n_name) AS names, {_iri(f'min({N})')} AS one FROM nation GROUP BY n_regionkey")
_add("optional", 'SELECT ?c ?d WHERE { ?c wdt:P13 "BUILDING" OPTIONAL { ?c wdt:P10 ?n . ?n schema:description ?d } }', f"SELECT {_iri(C)} AS c, 'nation ' || n_nationkey AS d FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING'")
_add("minus_unbound", "SELECT ?c ?n WHERE { ?c wdt:P13 \"BUILDING\" OPTIONAL { ?c wdt:P10 ?n . ?n wdt:P11 wd:Q17 } MINUS { ?s wdt:P31 wd:Q3 ; wdt:P10 ?n } }", f"SELECT {_iri(C)} AS c, CASE WHEN {_NR} = 17 THEN {_iri(N)} END AS n FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING' AND NOT coalesce({_NR} = 17 AND n_nationkey IN (SELECT s_nationkey FROM supplier), false)")
_add("exists_unbound", "SELECT ?c WHERE { ?c wdt:P13 \"BUILDING\" OPTIONAL { ?c wdt:P10 ?n . ?n wdt:P11 wd:Q17 } FILTER EXISTS { ?s wdt:P31 wd:Q3 ; wdt:P10 ?n } }", f"SELECT {_iri(C)} AS c FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING' AND (coalesce({_NR} <> 17, true) OR n_nationkey IN (SELECT s_nationkey FROM supplier))")
_add("exists_in_expression", "SELECT ?n ?x WHERE { ?n wdt:P11 ?r BIND(IF(EXISTS { ?s wdt:P10 ?n ; wdt:P31 wd:Q3 FILTER(?r = wd:Q17) }, 1, 0) AS ?x) }", f"SELECT {_iri(N)} AS n, ({_NR} = 17 AND n_nationkey IN (SELECT s_nationkey FROM supplier))::BIGINT AS x FROM nation")

# ---- label service and paths
_add("label_service", 'SELECT ?n ?nLabel ?nDescription ?nAltLabel WHERE { ?n wdt:P31 wd:Q2 SERVICE wikibase:label { bd:serviceParam wikibase:language "fr, de, en" } }', f"SELECT {_iri(N)} AS n, lower(n_name) AS \"nLabel\", 'nation ' || n_nationkey AS \"nDescription\", array_to_string(list_sort(list_distinct([upper(n_name), reverse(n_name)])), ',') AS \"nAltLabel\" FROM nation")
_add("label_service_explicit", 'SELECT ?c ?d WHERE { ?c wdt:P10 ?n ; wdt:P13 "BUILDING" SERVICE wikibase:label { bd:serviceParam wikibase:language "en" . ?n schema:description ?d } }', f"SELECT {_iri(C)} AS c, 'nation ' || c_nationkey AS d FROM customer WHERE c_mktsegment = 'BUILDING'")
_add("label_function", 'SELECT ?n (wikibase:label(?r, "fr", "de") AS ?name) WHERE { ?n wdt:P11 ?r }', f"SELECT {_iri(N)} AS n, lower(r_name) AS name FROM nation JOIN region ON n_regionkey = r_regionkey")
_add("path_seq", "SELECT ?c ?r WHERE { ?c wdt:P30/wdt:P10/wdt:P11 ?r }", f"SELECT {_iri(O_)} AS c, {_iri(_NR)} AS r FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
_UP = f"SELECT {S} AS x, {_SN} AS y FROM supplier UNION ALL SELECT {C}, {_CN} FROM customer UNION ALL SELECT {N}, {_NR} FROM nation"
_PLUS = f"WITH RECURSIVE e AS ({_UP}), r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x) "
_add("path_plus", "SELECT ?x ?y WHERE { ?x (wdt:P10|wdt:P11)+ ?y }", _PLUS + f"SELECT {_iri('x')} AS x, {_iri('y')} AS y FROM r")
_add("path_star_inverse", "SELECT ?x WHERE { wd:Q17 ^(wdt:P10|wdt:P11)* ?x }", _PLUS + f"SELECT {_iri('x')} AS x FROM r WHERE y = 17 UNION SELECT '{WD}entity/Q17'")
_add("path_neg", "SELECT ?o WHERE { wd:Q34 !(wdt:P31|rdfs:label|schema:description|skos:altLabel) ?o }", f"SELECT {_iri(_NR)} AS o FROM nation WHERE {N} = 34")


def run(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Engine(source(spark, sf_dir)).sparql(TEXTS[name][0])

    return query


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: run(name) for name in TEXTS}
ORACLES: dict[str, str] = {name: sql for name, (_, sql) in TEXTS.items()}
