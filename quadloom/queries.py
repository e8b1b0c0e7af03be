"""The registered queries: SPARQL over the virtual graph of the star schema, each with the SQL that it must equal."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .engine import Engine
from .sources.relational import RelationalSource

#: name: (SPARQL, SQL or None)
TEXTS: dict[str, tuple[str, str | None]] = {}


def _add(name: str, sparql: str, sql: str | None) -> None:
    TEXTS[name] = (sparql, sql)


def _q(key: str, cls: int) -> str:
    return f"(({key}::BIGINT + 1) * 16 + {cls})"


C, N, R, S, P, O_, E_, D = (_q(k, c) for k, c in (("c_custkey", 4), ("n_nationkey", 2), ("r_regionkey", 1), ("s_suppkey", 3), ("p_partkey", 5), ("o_orderkey", 6), ("event_id", 7), ("doc_id", 9)))

# ---- basic graph patterns
_add(
    "region_customers",
    "SELECT ?region (COUNT(?c) AS ?n) WHERE { ?c wdt:P31 wd:Q4 ; wdt:P10 ?nat . ?nat wdt:P11 ?r . ?r rdfs:label ?region } GROUP BY ?region",
    "SELECT r_name AS region, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
)
_add("scan_direct", "SELECT ?c ?seg WHERE { ?c wdt:P13 ?seg }", f"SELECT {C} AS c, c_mktsegment AS seg FROM customer")
_add("lookup_object", 'SELECT ?p ?name WHERE { ?p wdt:P20 "Brand#11" ; rdfs:label ?name }', f"SELECT {P} AS p, p_name AS name FROM part WHERE p_brand = 'Brand#11'")
_add("lookup_subject", "SELECT ?seg ?bal WHERE { wd:Q36 wdt:P13 ?seg ; wdt:P12 ?bal }", f"SELECT c_mktsegment AS seg, c_acctbal AS bal FROM customer WHERE {C} = 36")
_add("bgp_star", "SELECT ?p ?name ?brand ?size WHERE { ?p wdt:P31 wd:Q5 ; rdfs:label ?name ; wdt:P20 ?brand ; wdt:P22 ?size }", f"SELECT {P} AS p, p_name AS name, p_brand AS brand, p_size AS size FROM part")
_add(
    "bgp_path3",
    "SELECT ?o ?region WHERE { ?o wdt:P30 ?c . ?c wdt:P10 ?n . ?n wdt:P11 ?r . ?r rdfs:label ?region }",
    f"SELECT {O_} AS o, r_name AS region FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
)
_add("bgp_class_union", "SELECT ?who ?nat WHERE { ?who wdt:P10 ?nat }", f"SELECT {S} AS who, {_q('s_nationkey', 2)} AS nat FROM supplier UNION ALL SELECT {C}, {_q('c_nationkey', 2)} FROM customer")
_add("bgp_blank_node", "SELECT ?c ?r WHERE { ?c wdt:P31 wd:Q4 ; wdt:P10 [ wdt:P11 ?r ] }", f"SELECT {C} AS c, {_q('n_regionkey', 1)} AS r FROM customer JOIN nation ON c_nationkey = n_nationkey")
_add("instance_of", "SELECT ?class (COUNT(*) AS ?n) WHERE { ?x wdt:P31 ?class } GROUP BY ?class", " UNION ALL ".join(f"SELECT {c}::BIGINT AS class, count(*) AS n FROM {t}" for c, t in ((1, "region"), (2, "nation"), (3, "supplier"), (4, "customer"), (5, "part"), (6, "orders"), (7, "events"), (8, "(SELECT DISTINCT user_id FROM events)"), (9, "documents"))))
_add("wildcard_subject", "SELECT ?p ?o WHERE { wd:Q34 ?p ?o }", f"SELECT p, o FROM (SELECT {N} AS q, n_regionkey, n_name FROM nation) t, LATERAL (VALUES ('http://www.wikidata.org/prop/direct/P11', 'http://www.wikidata.org/entity/Q' || {_q('n_regionkey', 1)}), ('en', n_name), ('http://www.wikidata.org/prop/direct/P31', 'http://www.wikidata.org/entity/Q2'), ('http://www.wikidata.org/prop/P11', 'http://www.wikidata.org/entity/statement/Q34-P11')) v(p, o) WHERE q = 34")
_add("wildcard_object", "SELECT ?s ?p WHERE { ?s ?p wd:Q17 }", f"SELECT {N} AS s, 'http://www.wikidata.org/prop/direct/P11' AS p FROM nation WHERE {_q('n_regionkey', 1)} = 17")
_add("wildcard_predicates", "SELECT ?p (COUNT(*) AS ?n) WHERE { ?s wdt:P31 wd:Q4 . ?s ?p ?o } GROUP BY ?p", "SELECT p, count(*) AS n FROM customer, (VALUES ('http://www.wikidata.org/prop/direct/P10'), ('http://www.wikidata.org/prop/direct/P12'), ('http://www.wikidata.org/prop/direct/P13'), ('http://www.wikidata.org/prop/direct/P31'), ('en')) v(p) GROUP BY p")
_add("reverse_lookup", 'SELECT ?s ?p WHERE { ?s ?p "BUILDING" }', f"SELECT {C} AS s, 'http://www.wikidata.org/prop/direct/P13' AS p FROM customer WHERE c_mktsegment = 'BUILDING'")
_add("repeated_variable", "SELECT (COUNT(*) AS ?n) WHERE { ?o wdt:P32 ?x ; wdt:P35 ?x }", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = o_orderpriority")

# ---- statements and qualifiers
_add(
    "statement_qualifiers",
    "SELECT ?o ?part ?qty ?flag WHERE { ?o p:P40 ?st . ?st ps:P40 ?part ; pq:P43 ?qty ; pq:P47 ?flag FILTER(?qty > 45) }",
    f"SELECT {_q('l_orderkey', 6)} AS o, {_q('l_partkey', 5)} AS part, l_quantity AS qty, l_returnflag AS flag FROM lineitem WHERE l_quantity > 45",
)
_add("statement_simple", "SELECT ?c ?nat WHERE { ?c p:P10 ?st . ?st ps:P10 ?nat . ?c wdt:P31 wd:Q4 }", f"SELECT {C} AS c, {_q('c_nationkey', 2)} AS nat FROM customer")
_add("direct_multi_valued", "SELECT ?brand (COUNT(*) AS ?n) WHERE { ?o wdt:P40 ?p . ?p wdt:P20 ?brand } GROUP BY ?brand", "SELECT p_brand AS brand, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand")
_add(
    "pricing_summary",
    "SELECT ?flag ?status (SUM(?qty) AS ?sum_qty) (AVG(?qty) AS ?avg_qty) (COUNT(*) AS ?n) WHERE { ?o p:P40 [ pq:P47 ?flag ; pq:P48 ?status ; pq:P43 ?qty ; pq:P49 ?date ] FILTER(?date <= \"1998-09-02T00:00:00Z\"^^xsd:dateTime) } GROUP BY ?flag ?status",
    "SELECT l_returnflag AS flag, l_linestatus AS status, sum(l_quantity) AS sum_qty, avg(l_quantity) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2",
)
_add(
    "supplier_nations",
    "SELECT ?nation (COUNT(*) AS ?n) (SUM(?qty) AS ?sum_qty) WHERE { ?o p:P40 [ pq:P41 ?s ; pq:P43 ?qty ] . ?s wdt:P10 ?nat . ?nat rdfs:label ?nation } GROUP BY ?nation ORDER BY DESC(?n) ?nation",
    "SELECT n_name AS nation, count(*) AS n, sum(l_quantity) AS sum_qty FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name",
)

# ---- filters
_add("filter_compare", "SELECT ?p ?size WHERE { ?p wdt:P22 ?size FILTER(?size >= 10 && ?size < 20) }", f"SELECT {P} AS p, p_size::BIGINT AS size FROM part WHERE p_size >= 10 AND p_size < 20")
_add("filter_logic", 'SELECT ?o WHERE { ?o wdt:P32 ?s ; wdt:P33 ?t FILTER(?s = "F" || !(?t > 1000.5)) }', f"SELECT {O_} AS o FROM orders WHERE o_orderstatus = 'F' OR NOT o_totalprice > 1000.5")
_add("filter_in", 'SELECT ?c ?seg WHERE { ?c wdt:P13 ?seg FILTER(?seg IN ("BUILDING", "MACHINERY")) }', f"SELECT {C} AS c, c_mktsegment AS seg FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
_add("filter_not_in", 'SELECT ?c ?seg WHERE { ?c wdt:P13 ?seg FILTER(?seg NOT IN ("BUILDING", "MACHINERY")) }', f"SELECT {C} AS c, c_mktsegment AS seg FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
_add("filter_bound", "SELECT ?d WHERE { ?d wdt:P61 ?src OPTIONAL { ?d wdt:P63 ?q } FILTER(!BOUND(?q)) }", f"SELECT {D} AS d FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
_add("filter_iri", "SELECT ?c WHERE { ?c wdt:P31 wd:Q4 ; wdt:P10 ?n FILTER(?n = wd:Q50) }", f"SELECT {C} AS c FROM customer WHERE {_q('c_nationkey', 2)} = 50")
_add("filter_date", 'SELECT ?o WHERE { ?o wdt:P34 ?d FILTER(?d >= "1995-01-01"^^xsd:date && ?d < "1995-02-01"^^xsd:date) }', f"SELECT {O_} AS o FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1995-02-01'")
_add("same_term", "SELECT ?c WHERE { ?c wdt:P31 wd:Q4 ; wdt:P10 ?n FILTER(SAMETERM(?n, wd:Q66)) }", f"SELECT {C} AS c FROM customer WHERE {_q('c_nationkey', 2)} = 66")
_add("exists_semi", "SELECT ?c WHERE { ?c wdt:P31 wd:Q4 FILTER EXISTS { ?o wdt:P30 ?c ; wdt:P32 \"F\" } }", f"SELECT {C} AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
_add("not_exists_anti", "SELECT ?c WHERE { ?c wdt:P31 wd:Q4 FILTER NOT EXISTS { ?o wdt:P30 ?c } }", f"SELECT {C} AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
_add("exists_correlated", "SELECT ?c WHERE { ?c wdt:P13 ?seg ; wdt:P12 ?bal FILTER EXISTS { ?o wdt:P30 ?c ; wdt:P33 ?t FILTER(?t > ?bal * 30) } }", f"SELECT {C} AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 30)")
_add("exists_nested", "SELECT ?c ?x WHERE { ?c wdt:P13 ?seg BIND(IF(EXISTS { ?o wdt:P30 ?c }, 1, 0) AS ?x) }", f"SELECT {C} AS c, (c_custkey IN (SELECT o_custkey FROM orders))::BIGINT AS x FROM customer")

# ---- joins and sets
_add("optional", "SELECT ?d ?src ?q WHERE { ?d wdt:P61 ?src OPTIONAL { ?d wdt:P63 ?q } }", f"SELECT {D} AS d, source AS src, quality::BIGINT AS q FROM documents LEFT JOIN labels USING (doc_id)")
_add("optional_filter", "SELECT ?c ?o ?t WHERE { ?c wdt:P13 ?seg OPTIONAL { ?o wdt:P30 ?c ; wdt:P33 ?t FILTER(?t > 400000) } }", f"SELECT {C} AS c, {O_} AS o, o_totalprice AS t FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 400000")
_add("optional_chain", "SELECT ?d ?q ?l WHERE { ?d wdt:P62 ?n OPTIONAL { ?d wdt:P63 ?q } OPTIONAL { ?d wdt:P63 ?q . ?d wdt:P64 ?l } FILTER(?n < 900) }", f"SELECT {D} AS d, quality::BIGINT AS q, toxic::BIGINT AS l FROM documents LEFT JOIN labels USING (doc_id) WHERE n_chars < 900")
_add("cross_join", "SELECT ?a ?b WHERE { ?a wdt:P31 wd:Q1 . ?b wdt:P31 wd:Q2 }", f"SELECT {R} AS a, {N} AS b FROM region, nation")
_add("join_groups", "SELECT ?n ?c ?s WHERE { { ?c wdt:P31 wd:Q4 ; wdt:P10 ?n } { ?s wdt:P31 wd:Q3 ; wdt:P10 ?n } { ?n wdt:P11 wd:Q17 } }", f"SELECT {N} AS n, {C} AS c, {S} AS s FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey WHERE {_q('n_regionkey', 1)} = 17")
_add("union_bag", 'SELECT ?x WHERE { { ?x wdt:P13 "BUILDING" } UNION { ?x wdt:P13 "BUILDING" } UNION { ?x wdt:P22 7 } }', f"SELECT {C} AS x FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT {C} FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT {P} FROM part WHERE p_size = 7")
_add("union_mixed", "SELECT ?x ?v WHERE { { ?x wdt:P13 ?v } UNION { ?x wdt:P22 ?v } }", f"SELECT {C} AS x, c_mktsegment AS v FROM customer UNION ALL SELECT {P}, p_size::VARCHAR FROM part")
_add("union_join_unbound", "SELECT ?d ?q ?src WHERE { { ?d wdt:P63 ?q } UNION { ?d wdt:P61 ?src } ?d wdt:P63 ?q }", f"SELECT {D} AS d, quality::BIGINT AS q, NULL::VARCHAR AS src FROM labels UNION ALL SELECT {D}, quality::BIGINT, source FROM documents JOIN labels USING (doc_id)")
_add("minus", "SELECT ?c WHERE { ?c wdt:P31 wd:Q4 MINUS { ?o wdt:P30 ?c ; wdt:P32 \"O\" } }", f"SELECT {C} AS c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')")
_add("minus_disjoint", "SELECT ?n WHERE { ?n wdt:P31 wd:Q2 MINUS { ?x wdt:P31 wd:Q1 } }", f"SELECT {N} AS n FROM nation")
_add("values_inline", 'SELECT ?c ?seg ?w WHERE { VALUES (?seg ?w) { ("BUILDING" 1) ("AUTOMOBILE" 2) } ?c wdt:P13 ?seg }', f"SELECT {C} AS c, c_mktsegment AS seg, CASE c_mktsegment WHEN 'BUILDING' THEN 1 ELSE 2 END::BIGINT AS w FROM customer WHERE c_mktsegment IN ('BUILDING', 'AUTOMOBILE')")
_add("values_undef", 'SELECT ?c ?seg ?n WHERE { ?c wdt:P13 ?seg ; wdt:P10 ?n VALUES (?seg ?n) { ("BUILDING" UNDEF) (UNDEF wd:Q50) } }', f"SELECT {C} AS c, c_mktsegment AS seg, {_q('c_nationkey', 2)} AS n FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT {C}, c_mktsegment, {_q('c_nationkey', 2)} FROM customer WHERE {_q('c_nationkey', 2)} = 50")
_add("subselect", "SELECT ?c ?n WHERE { { SELECT ?c (COUNT(?o) AS ?n) WHERE { ?o wdt:P30 ?c } GROUP BY ?c } ?c wdt:P13 \"MACHINERY\" }", f"SELECT {C} AS c, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'MACHINERY' GROUP BY c_custkey")
_add("empty_pattern", "SELECT (1 + 2 AS ?x) WHERE { }", "SELECT 3::BIGINT AS x")
_add("ask", 'ASK { ?c wdt:P13 "BUILDING" }', "SELECT count(*) > 0 AS answer FROM customer WHERE c_mktsegment = 'BUILDING'")
_add("unbound_select", "SELECT ?r ?nothing WHERE { ?r wdt:P31 wd:Q1 }", f"SELECT {R} AS r, NULL::VARCHAR AS nothing FROM region")
_add("star_select", "SELECT * WHERE { ?n wdt:P11 ?r . ?r rdfs:label ?name }", f"SELECT {N} AS n, {R} AS r, r_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey")

# ---- expressions
_add("bind_arith", "SELECT ?p ?a ?b ?c ?d ?e WHERE { ?p wdt:P22 ?z BIND(?z + 1 AS ?a) BIND(?z * 3 - 2 AS ?b) BIND(?z / 4 AS ?c) BIND(-?z AS ?d) BIND(+?z AS ?e) }", f"SELECT {P} AS p, p_size::BIGINT + 1 AS a, p_size::BIGINT * 3 - 2 AS b, p_size::DOUBLE / 4 AS c, -p_size::BIGINT AS d, p_size::BIGINT AS e FROM part")
_add("divide_by_zero", "SELECT ?p ?x WHERE { ?p wdt:P22 ?z BIND(1 / (?z - ?z) AS ?x) }", f"SELECT {P} AS p, NULL::DOUBLE AS x FROM part")
_add("if_coalesce", 'SELECT ?d ?x ?y WHERE { ?d wdt:P62 ?n OPTIONAL { ?d wdt:P63 ?q } BIND(IF(?n > 1000, "long", "short") AS ?x) BIND(COALESCE(?q, -1) AS ?y) }', f"SELECT {D} AS d, CASE WHEN n_chars > 1000 THEN 'long' ELSE 'short' END AS x, coalesce(quality, -1)::BIGINT AS y FROM documents LEFT JOIN labels USING (doc_id)")
_add("str_case", "SELECT ?n ?u ?l WHERE { ?n wdt:P31 wd:Q2 ; rdfs:label ?x BIND(UCASE(?x) AS ?u) BIND(LCASE(?x) AS ?l) }", f"SELECT {N} AS n, upper(n_name) AS u, lower(n_name) AS l FROM nation")
_add("str_substr", "SELECT ?p ?n ?a ?b WHERE { ?p wdt:P31 wd:Q5 ; rdfs:label ?x BIND(STRLEN(?x) AS ?n) BIND(SUBSTR(?x, 3) AS ?a) BIND(SUBSTR(?x, 2, 4) AS ?b) }", f"SELECT {P} AS p, length(p_name) AS n, substr(p_name, 3) AS a, substr(p_name, 2, 4) AS b FROM part")
_add("str_predicates", 'SELECT ?p WHERE { ?p wdt:P21 ?t FILTER(STRSTARTS(?t, "S") || STRENDS(?t, "L") && CONTAINS(?t, "A")) }', f"SELECT {P} AS p FROM part WHERE starts_with(p_type, 'S') OR (ends_with(p_type, 'L') AND contains(p_type, 'A'))")
_add("str_before_after", 'SELECT ?p ?a ?b WHERE { ?p wdt:P20 ?t BIND(STRBEFORE(?t, "#") AS ?a) BIND(STRAFTER(?t, "#") AS ?b) }', f"SELECT {P} AS p, split_part(p_brand, '#', 1) AS a, split_part(p_brand, '#', 2) AS b FROM part")
_add("encode_uri", "SELECT ?p ?u WHERE { ?p wdt:P20 ?t BIND(ENCODE_FOR_URI(CONCAT(?t, \" a/b~*\")) AS ?u) }", f"SELECT {P} AS p, url_encode(p_brand || ' a/b~*') AS u FROM part")
_add("concat", 'SELECT ?c ?x WHERE { ?c wdt:P13 ?seg ; rdfs:label ?n BIND(CONCAT(?n, "/", ?seg) AS ?x) }', f"SELECT {C} AS c, c_name || '/' || c_mktsegment AS x FROM customer")
_add("regex", 'SELECT ?p WHERE { ?p wdt:P20 ?t FILTER(REGEX(?t, "^brand#[12]", "i")) }', f"SELECT {P} AS p FROM part WHERE regexp_matches(p_brand, '^Brand#[12]')")
_add("replace", 'SELECT ?p ?x WHERE { ?p wdt:P20 ?t BIND(REPLACE(?t, "([0-9])([0-9])", "$2-$1") AS ?x) }', f"SELECT {P} AS p, regexp_replace(p_brand, '([0-9])([0-9])', '\\2-\\1', 'g') AS x FROM part")
_add("lang_functions", 'SELECT ?d ?l ?m WHERE { ?d wdt:P60 ?t BIND(LANG(?t) AS ?l) BIND(LANGMATCHES(LANG(?t), "EN") AS ?m) }', f"SELECT {D} AS d, lang AS l, lang = 'en' AS m FROM documents")
_add("str_lang", 'SELECT ?r ?x ?l WHERE { ?r wdt:P31 wd:Q1 ; rdfs:label ?n BIND(STRLANG(?n, "EN") AS ?t) BIND(STR(?t) AS ?x) BIND(LANG(?t) AS ?l) }', f"SELECT {R} AS r, r_name AS x, 'en' AS l FROM region")
_add("term_tests", "SELECT ?n ?a ?b ?c ?d WHERE { ?n wdt:P11 ?r BIND(ISIRI(?r) AS ?a) BIND(ISLITERAL(?r) AS ?b) BIND(ISNUMERIC(3.5) AS ?c) BIND(ISBLANK(?n) AS ?d) }", f"SELECT {N} AS n, true AS a, false AS b, true AS c, false AS d FROM nation")
_add("datatype_str", "SELECT ?p ?a ?b WHERE { ?p wdt:P22 ?z BIND(STR(?p) AS ?a) BIND(STR(DATATYPE(?z)) AS ?b) }", f"SELECT {P} AS p, 'http://www.wikidata.org/entity/Q' || {P} AS a, 'http://www.w3.org/2001/XMLSchema#integer' AS b FROM part")
_add("iri_function", 'SELECT ?n WHERE { ?n wdt:P11 ?r FILTER(?r = IRI("http://www.wikidata.org/entity/Q17")) }', f"SELECT {N} AS n FROM nation WHERE {_q('n_regionkey', 1)} = 17")
_add("numeric_fns", "SELECT ?c ?a ?r ?u ?d WHERE { ?c wdt:P31 wd:Q4 ; wdt:P12 ?b BIND(ABS(?b) AS ?a) BIND(ROUND(?b) AS ?r) BIND(CEIL(?b) AS ?u) BIND(FLOOR(?b) AS ?d) }", f"SELECT {C} AS c, abs(c_acctbal) AS a, floor(c_acctbal + 0.5) AS r, ceil(c_acctbal) AS u, floor(c_acctbal) AS d FROM customer")
_add("casts", 'SELECT ?p ?a ?b ?c ?d WHERE { ?p wdt:P22 ?z ; wdt:P20 ?t BIND(xsd:string(?z) AS ?a) BIND(xsd:integer(STRAFTER(?t, "#")) AS ?b) BIND(xsd:double(?z) AS ?c) BIND(xsd:integer(?t) AS ?d) }', f"SELECT {P} AS p, p_size::VARCHAR AS a, split_part(p_brand, '#', 2)::BIGINT AS b, p_size::DOUBLE AS c, NULL::BIGINT AS d FROM part")
_add("date_parts", "SELECT ?o ?y ?m ?d ?h ?mi ?s ?tz WHERE { ?o wdt:P34 ?t BIND(YEAR(?t) AS ?y) BIND(MONTH(?t) AS ?m) BIND(DAY(?t) AS ?d) BIND(HOURS(?t) AS ?h) BIND(MINUTES(?t) AS ?mi) BIND(SECONDS(?t) AS ?s) BIND(TZ(?t) AS ?tz) }", f"SELECT {O_} AS o, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, hour(o_orderdate) AS h, minute(o_orderdate) AS mi, second(o_orderdate) AS s, 'Z' AS tz FROM orders")
_add("hashes", "SELECT ?n ?a ?b ?c WHERE { ?n wdt:P31 wd:Q2 ; rdfs:label ?x BIND(MD5(?x) AS ?a) BIND(SHA1(?x) AS ?b) BIND(SHA256(?x) AS ?c) }", f"SELECT {N} AS n, md5(n_name) AS a, sha1(n_name) AS b, sha256(n_name) AS c FROM nation")
_add("hashes_long", "SELECT ?r (SHA384(?x) AS ?a) (SHA512(?x) AS ?b) WHERE { ?r wdt:P31 wd:Q1 BIND(\"a region of the world\" AS ?x) }", f"SELECT {R} AS r, '{hashlib.sha384(b'a region of the world').hexdigest()}' AS a, '{hashlib.sha512(b'a region of the world').hexdigest()}' AS b FROM region")
_add("random_and_now", "SELECT ?r (RAND() < 1 AS ?a) (STRLEN(STRUUID()) AS ?b) (STRLEN(STR(UUID())) AS ?c) (YEAR(NOW()) > 2000 AS ?d) WHERE { ?r wdt:P31 wd:Q1 }", f"SELECT {R} AS r, true AS a, 36::BIGINT AS b, 45::BIGINT AS c, true AS d FROM region")

_add("strdt", 'SELECT ?p ?x ?y WHERE { ?p wdt:P20 ?t BIND(STRDT(STRAFTER(?t, "#"), xsd:integer) + 1 AS ?x) BIND(YEAR(STRDT(CONCAT("19", SUBSTR(STR(?p), STRLEN(STR(?p))), "4-01-02T00:00:00Z"), xsd:dateTime)) AS ?y) }', f"SELECT {P} AS p, split_part(p_brand, '#', 2)::BIGINT + 1 AS x, 1904 + 10 * (({P}) % 10) AS y FROM part")
_add("bnode", 'SELECT ?r ?n ?same WHERE { ?r wdt:P31 wd:Q1 ; rdfs:label ?x BIND(STRLEN(STR(BNODE())) AS ?n) BIND(BNODE(?x) = BNODE(?x) AS ?same) }', f"SELECT {R} AS r, 38::BIGINT AS n, true AS same FROM region")
_add("time_with_offset", 'SELECT ?o WHERE { ?o wdt:P34 ?t FILTER(?t < "1993-01-01T02:00:00+02:00"^^xsd:dateTime) }', f"SELECT {O_} AS o FROM orders WHERE o_orderdate < TIMESTAMP '1993-01-01'")
_add("from_is_ignored", "SELECT ?r ?name FROM <http://example.org/graph> FROM NAMED <http://example.org/other> WHERE { ?r wdt:P31 wd:Q1 ; rdfs:label ?name }", f"SELECT {R} AS r, r_name AS name FROM region")
_add("service_silent", "SELECT ?r WHERE { ?r wdt:P31 wd:Q1 SERVICE SILENT <http://example.org/sparql> { ?r wdt:P1 ?x } }", f"SELECT {R} AS r FROM region")
_add("optional_exists", 'SELECT ?c ?o WHERE { ?c wdt:P13 "BUILDING" OPTIONAL { ?o wdt:P30 ?c ; wdt:P32 "F" FILTER EXISTS { ?o p:P40 [ pq:P47 "R" ] } } }', f"SELECT {C} AS c, {O_} AS o FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')) ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
_add("minus_unbound", "SELECT ?d ?q WHERE { ?d wdt:P61 ?s OPTIONAL { ?d wdt:P63 ?q } MINUS { ?e wdt:P64 1 ; wdt:P63 ?q } }", f"SELECT {D} AS d, quality::BIGINT AS q FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL OR quality NOT IN (SELECT quality FROM labels WHERE toxic = 1 AND quality IS NOT NULL)")
_add("exists_unbound", "SELECT ?d WHERE { ?d wdt:P61 ?s OPTIONAL { ?d wdt:P63 ?q } FILTER NOT EXISTS { ?d wdt:P64 1 ; wdt:P63 ?q } }", f"SELECT {D} AS d FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND quality IS NOT NULL)")
_add("path_plus_bound", 'SELECT ?c ?y WHERE { ?c wdt:P13 "BUILDING" . ?c (wdt:P10|wdt:P11)+ ?y }', f"SELECT {C} AS c, {_q('c_nationkey', 2)} AS y FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT {C}, {_q('n_regionkey', 1)} FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING'")

# ---- solution modifiers and aggregates
_add("distinct", "SELECT DISTINCT ?seg WHERE { ?c wdt:P13 ?seg }", "SELECT DISTINCT c_mktsegment AS seg FROM customer")
_add("reduced", "SELECT REDUCED ?r WHERE { ?r wdt:P31 wd:Q1 }", f"SELECT {R} AS r FROM region")
_add("order_limit", "SELECT ?o ?t WHERE { ?o wdt:P33 ?t } ORDER BY DESC(?t) ?o LIMIT 25", f"SELECT {O_} AS o, o_totalprice AS t FROM orders ORDER BY t DESC, o LIMIT 25")
_add("offset", "SELECT ?c WHERE { ?c wdt:P13 ?s } ORDER BY ?s ?c LIMIT 10 OFFSET 20", f"SELECT c FROM (SELECT {C} AS c, c_mktsegment AS s FROM customer) ORDER BY s, c LIMIT 10 OFFSET 20")
_add("distinct_order", "SELECT DISTINCT ?b WHERE { ?p wdt:P20 ?b } ORDER BY DESC(?b) LIMIT 5", "SELECT DISTINCT p_brand AS b FROM part ORDER BY b DESC LIMIT 5")
_add("order_unbound_first", "SELECT ?d ?q WHERE { ?d wdt:P61 ?s OPTIONAL { ?d wdt:P63 ?q } } ORDER BY ?q ?d LIMIT 7", f"SELECT {D} AS d, quality::BIGINT AS q FROM documents LEFT JOIN labels USING (doc_id) ORDER BY q NULLS FIRST, d LIMIT 7")
_add("count_star", "SELECT ?s (COUNT(*) AS ?n) WHERE { ?o wdt:P32 ?s } GROUP BY ?s", "SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1")
_add("count_var", "SELECT ?src (COUNT(?q) AS ?n) WHERE { ?d wdt:P61 ?src OPTIONAL { ?d wdt:P63 ?q } } GROUP BY ?src", "SELECT source AS src, count(quality) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
_add("count_distinct", "SELECT ?s (COUNT(DISTINCT ?c) AS ?n) WHERE { ?o wdt:P32 ?s ; wdt:P30 ?c } GROUP BY ?s", "SELECT o_orderstatus AS s, count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1")
_add("count_distinct_rows", "SELECT (COUNT(DISTINCT *) AS ?n) WHERE { { ?n wdt:P11 ?r } UNION { ?n wdt:P11 ?r } }", "SELECT count(*) AS n FROM nation")
_add("sum_avg_min_max", "SELECT ?b (SUM(?z) AS ?s) (AVG(?z) AS ?a) (MIN(?z) AS ?lo) (MAX(?z) AS ?hi) (SUM(DISTINCT ?z) AS ?sd) (AVG(DISTINCT ?z) AS ?ad) WHERE { ?p wdt:P20 ?b ; wdt:P22 ?z } GROUP BY ?b", "SELECT p_brand AS b, sum(p_size)::BIGINT AS s, avg(p_size) AS a, min(p_size)::BIGINT AS lo, max(p_size)::BIGINT AS hi, sum(DISTINCT p_size)::BIGINT AS sd, avg(DISTINCT p_size) AS ad FROM part GROUP BY 1")
_add("group_concat", 'SELECT ?r (GROUP_CONCAT(?name; SEPARATOR="|") AS ?names) WHERE { ?n wdt:P11 ?r ; rdfs:label ?name } GROUP BY ?r', f"SELECT {_q('n_regionkey', 1)} AS r, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
_add("group_concat_distinct", "SELECT (GROUP_CONCAT(DISTINCT ?seg) AS ?all) WHERE { ?c wdt:P13 ?seg }", "SELECT string_agg(DISTINCT c_mktsegment, ' ' ORDER BY c_mktsegment) AS \"all\" FROM customer")
_add("sample", "SELECT ?seg (SAMPLE(?c) AS ?one) WHERE { ?c wdt:P13 ?seg } GROUP BY ?seg", f"SELECT c_mktsegment AS seg, min({C}) AS one FROM customer GROUP BY 1")
_add("having", "SELECT ?c (COUNT(*) AS ?n) WHERE { ?o wdt:P30 ?c } GROUP BY ?c HAVING(COUNT(*) > 12)", f"SELECT {_q('o_custkey', 4)} AS c, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
_add("global_agg", "SELECT (COUNT(*) AS ?n) (MAX(?t) AS ?hi) (SUM(?q) AS ?s) WHERE { ?o wdt:P33 ?t . ?o p:P40 [ pq:P43 ?q ] }", "SELECT count(*) AS n, max(o_totalprice) AS hi, sum(l_quantity) AS s FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
_add("global_agg_empty", 'SELECT (COUNT(*) AS ?n) (SUM(?z) AS ?s) (MIN(?z) AS ?lo) WHERE { ?p wdt:P22 ?z ; wdt:P20 "none" }', "SELECT 0::BIGINT AS n, 0::BIGINT AS s, NULL::BIGINT AS lo")
_add("group_expression", "SELECT ?y (COUNT(*) AS ?n) WHERE { ?o wdt:P34 ?t } GROUP BY (YEAR(?t) AS ?y)", "SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1")
_add("min_max_time", "SELECT ?s (MIN(?t) AS ?lo) (MAX(?t) AS ?hi) WHERE { ?o wdt:P32 ?s ; wdt:P34 ?t } GROUP BY ?s", "SELECT o_orderstatus AS s, min(o_orderdate) AS lo, max(o_orderdate) AS hi FROM orders GROUP BY 1")
_add("events_by_type", "SELECT ?type (COUNT(DISTINCT ?u) AS ?users) (COUNT(*) AS ?n) WHERE { ?e wdt:P51 ?type ; wdt:P50 ?u } GROUP BY ?type", "SELECT event_type AS type, count(DISTINCT user_id) AS users, count(*) AS n FROM events GROUP BY 1")

# ---- label service and paths
_add("label_service", 'SELECT ?n ?nLabel ?r ?rLabel WHERE { ?n wdt:P11 ?r SERVICE wikibase:label { bd:serviceParam wikibase:language "de,en" } }', f"SELECT {N} AS n, n_name AS \"nLabel\", {R} AS r, r_name AS \"rLabel\" FROM nation JOIN region ON n_regionkey = r_regionkey")
_add("label_service_explicit", 'SELECT ?c ?name WHERE { ?c wdt:P13 "BUILDING" SERVICE wikibase:label { bd:serviceParam wikibase:language "en" . ?c rdfs:label ?name } }', f"SELECT {C} AS c, c_name AS name FROM customer WHERE c_mktsegment = 'BUILDING'")
_add("label_service_missing", 'SELECT ?n ?nLabel ?nDescription WHERE { ?n wdt:P31 wd:Q2 SERVICE wikibase:label { bd:serviceParam wikibase:language "fr" } }', f"SELECT {N} AS n, NULL::VARCHAR AS \"nLabel\", NULL::VARCHAR AS \"nDescription\" FROM nation")
_add("path_seq", "SELECT ?c ?r WHERE { ?c wdt:P10/wdt:P11 ?r }", f"SELECT {C} AS c, {_q('n_regionkey', 1)} AS r FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT {S}, {_q('n_regionkey', 1)} FROM supplier JOIN nation ON s_nationkey = n_nationkey")
_add("path_inverse", "SELECT ?r ?n WHERE { ?r ^wdt:P11 ?n }", f"SELECT {_q('n_regionkey', 1)} AS r, {N} AS n FROM nation")
_add("path_alt", "SELECT ?x ?y WHERE { ?x (wdt:P11|wdt:P10) ?y }", f"SELECT {N} AS x, {_q('n_regionkey', 1)} AS y FROM nation UNION ALL SELECT {C}, {_q('c_nationkey', 2)} FROM customer UNION ALL SELECT {S}, {_q('s_nationkey', 2)} FROM supplier")
_UP = f"SELECT {S} AS x, {_q('s_nationkey', 2)} AS y FROM supplier UNION ALL SELECT {C}, {_q('c_nationkey', 2)} FROM customer UNION ALL SELECT {N}, {_q('n_regionkey', 1)} FROM nation"
_PLUS = f"WITH RECURSIVE e AS ({_UP}), r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x) "
_add("path_plus", "SELECT ?x ?y WHERE { ?x (wdt:P10|wdt:P11)+ ?y }", _PLUS + "SELECT x, y FROM r")
_add("path_plus_end", "SELECT ?x WHERE { ?x (wdt:P10|wdt:P11)+ wd:Q17 }", _PLUS + "SELECT x FROM r WHERE y = 17")
_add("path_star", "SELECT ?y WHERE { wd:Q36 (wdt:P10|wdt:P11)* ?y }", _PLUS + "SELECT y FROM r WHERE x = 36 UNION SELECT 36")
_add("path_opt", "SELECT ?y WHERE { wd:Q36 wdt:P10? ?y }", f"SELECT 36::BIGINT AS y UNION SELECT {_q('c_nationkey', 2)} FROM customer WHERE {C} = 36")
_add("path_neg", "SELECT ?s ?o WHERE { ?s wdt:P31 wd:Q2 . ?s !(wdt:P31|rdfs:label) ?o }", f"SELECT {N} AS s, 'http://www.wikidata.org/entity/Q' || {_q('n_regionkey', 1)} AS o FROM nation")


def run(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Engine(RelationalSource.from_parquet(spark, sf_dir)).sparql(TEXTS[name][0])

    return query


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: run(name) for name in TEXTS}
ORACLES: dict[str, str] = {name: sql for name, (_, sql) in TEXTS.items() if sql}
