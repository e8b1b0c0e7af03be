"""Terms: kinds, their Spark representation, IRIs, literals and lexical forms.

A variable whose kind is known when the query is compiled is a native column:

=========  ==================================  =======================
kind       terms                               Spark type
=========  ==================================  =======================
item       entities Q...                       BIGINT
prop       direct properties P...              BIGINT
pstmt      statement properties p:P...         BIGINT
lexeme     L...                                BIGINT
stmt       statement ids                       STRING
string     plain strings (and identifiers)     STRING
text       strings with a language             STRUCT<s, l>
iri        other IRIs, URLs                    STRING
int        integers                            BIGINT
num        decimals, doubles, quantities       DOUBLE
bool       booleans                            BOOLEAN
time       points in time                      TIMESTAMP_NTZ
=========  ==================================  =======================

A variable of several kinds is a ``TERM`` struct (kind "term"), whose field k is
one of the codes below. Two terms are the same if all fields are.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

TERM = "struct<k:int,i:bigint,d:double,s:string,l:string>"

#: Codes of TERM.k.
CODE = {"item": 1, "prop": 2, "lexeme": 3, "string": 4, "text": 5, "iri": 6, "media": 7, "geoshape": 8, "tabular": 9, "math": 10, "music": 11, "quantity": 12, "time": 14, "coord": 15, "label": 16, "description": 17, "alias": 18, "identifier": 20, "int": 21, "num": 22, "bool": 23, "stmt": 24, "pstmt": 25}
KIND = {v: k for k, v in CODE.items()}
IRI_KINDS = ("item", "prop", "pstmt", "lexeme", "stmt", "iri")
NUMERIC = ("int", "num")
STRINGS = ("string", "media", "geoshape", "tabular", "math", "music", "identifier")

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF_LANG = "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString"
WD = "http://www.wikidata.org/"
PREFIXES = {
    "wd": WD + "entity/",
    "wds": WD + "entity/statement/",
    "wdv": WD + "value/",
    "wdt": WD + "prop/direct/",
    "p": WD + "prop/",
    "ps": WD + "prop/statement/",
    "psv": WD + "prop/statement/value/",
    "pq": WD + "prop/qualifier/",
    "pqv": WD + "prop/qualifier/value/",
    "pr": WD + "prop/reference/",
    "wdno": WD + "prop/novalue/",
    "wdtn": WD + "prop/direct-normalized/",
    "wikibase": "http://wikiba.se/ontology#",
    "bd": "http://www.bigdata.com/rdf#",
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "owl": "http://www.w3.org/2002/07/owl#",
    "xsd": XSD,
    "schema": "http://schema.org/",
    "skos": "http://www.w3.org/2004/02/skos/core#",
    "prov": "http://www.w3.org/ns/prov#",
    "geo": "http://www.opengis.net/ont/geosparql#",
    "dct": "http://purl.org/dc/terms/",
    "ontolex": "http://www.w3.org/ns/lemon/ontolex#",
    "fn": "http://www.w3.org/2005/xpath-functions#",
}
LABEL_IRIS = {PREFIXES["rdfs"] + "label": "label", PREFIXES["schema"] + "description": "description", PREFIXES["skos"] + "altLabel": "alias"}
_COMMONS = "http://commons.wikimedia.org/"

DATATYPE = {"string": XSD + "string", "text": RDF_LANG, "int": XSD + "integer", "num": XSD + "decimal", "quantity": XSD + "decimal", "bool": XSD + "boolean", "time": XSD + "dateTime", "coord": PREFIXES["geo"] + "wktLiteral", "math": "http://www.w3.org/1998/Math/MathML"}


class SparqlError(ValueError):
    """A query that is malformed or asks for something unsupported."""


@dataclass(frozen=True)
class Const:
    """A constant term: the Python value of its kind; lang for text."""

    kind: str
    value: object
    lang: str | None = None


_IRI_SHAPES = [
    (re.compile(re.escape(WD) + r"entity/Q(\d+)$"), "item"),
    (re.compile(re.escape(WD) + r"entity/L(\d+)$"), "lexeme"),
    (re.compile(re.escape(WD) + r"entity/P(\d+)$"), "prop"),
    (re.compile(re.escape(WD) + r"prop/direct/P(\d+)$"), "prop"),
    (re.compile(re.escape(WD) + r"prop/P(\d+)$"), "pstmt"),
]


def parse_iri(iri: str) -> Const:
    for shape, kind in _IRI_SHAPES:
        if m := shape.match(iri):
            return Const(kind, int(m[1]))
    if iri.startswith(PREFIXES["wds"]):
        return Const("stmt", iri[len(PREFIXES["wds"]) :])
    return Const("iri", iri)


def parse_literal(text: str, datatype: str | None = None, lang: str | None = None) -> Const:
    """The typed constant; an ill-formed number, date or truth value is an error term (kind "null")."""
    if lang:
        return Const("text", text, lang.lower())
    if datatype is None or datatype == XSD + "string":
        return Const("string", text)
    name = datatype.removeprefix(XSD)
    try:
        if name in ("integer", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger", "unsignedInt", "unsignedLong"):
            return Const("int", int(text))
        if name in ("decimal", "double", "float"):
            return Const("num", float(text))
        if name == "boolean":
            return Const("bool", {"true": True, "1": True, "false": False, "0": False}[text])
        if name in ("dateTime", "date"):
            if not re.match(r"[+-]?\d{4,}-\d\d-\d\d(T\d\d:\d\d:\d\d(\.\d+)?)?(Z|[+-]\d\d:\d\d)?$", text):
                raise ValueError(text)
            at = re.sub(r"(Z|[+-]\d\d:\d\d)$", "", text.removeprefix("+")) + ("" if "T" in text else "T00:00:00")
            zone = re.search(r"T.*([+-])(\d\d):(\d\d)$", text)
            if zone and re.match(r"\d{4}-", at):  # times are kept in UTC
                shift = timedelta(hours=int(zone[2]), minutes=int(zone[3])) * (-1 if zone[1] == "+" else 1)
                at = (datetime.fromisoformat(at) + shift).isoformat()
            return Const("time", at)
    except (ValueError, KeyError, OverflowError):
        return Const("null", None)
    return Const("string", text)


def iri_of(c: Const) -> str:
    return {"item": f"{WD}entity/Q{c.value}", "prop": f"{WD}prop/direct/P{c.value}", "pstmt": f"{WD}prop/P{c.value}", "lexeme": f"{WD}entity/L{c.value}", "stmt": f"{PREFIXES['wds']}{c.value}"}.get(c.kind, str(c.value))


def literal(c: Const) -> Column:
    """The constant as a native column."""
    if c.kind == "null":
        return F.lit(None)
    if c.kind == "text":
        return F.struct(F.lit(c.value).alias("s"), F.lit(c.lang).alias("l"))
    if c.kind == "time":
        return F.lit(c.value).cast("timestamp_ntz")
    kinds = {"item": "bigint", "prop": "bigint", "pstmt": "bigint", "lexeme": "bigint", "int": "bigint", "num": "double"}
    return F.lit(c.value).cast(kinds[c.kind]) if c.kind in kinds else F.lit(c.value)


def clock(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column) -> Column:
    """A sortable number for a point in time, for any year."""
    out = year.cast("bigint")
    for part, base in ((month, 13), (day, 32), (hour, 24), (minute, 60), (second, 61)):
        out = out * base + part.cast("bigint")
    return out


def make_term(k: Column | int, i: Column | None = None, d: Column | None = None, s: Column | None = None, l: Column | None = None) -> Column:  # noqa: E741
    null = F.lit(None)
    k = F.lit(k) if isinstance(k, int) else k
    return F.struct(k.cast("int").alias("k"), (null if i is None else i).cast("bigint").alias("i"), (null if d is None else d).cast("double").alias("d"), (null if s is None else s).cast("string").alias("s"), (null if l is None else l).cast("string").alias("l"))


def to_term(col: Column, kind: str) -> Column:
    """A native column as TERM; null stays null."""
    if kind == "term":
        return col
    if kind == "null":
        return F.lit(None).cast(TERM)
    if kind in ("item", "prop", "pstmt", "lexeme"):
        out = make_term(CODE[kind], i=col)
    elif kind == "int":
        out = make_term(21, i=col, d=col)
    elif kind == "num":
        out = make_term(22, d=col)
    elif kind == "bool":
        out = make_term(23, i=col.cast("int"))
    elif kind == "text":
        out = make_term(5, s=col["s"], l=col["l"])
    elif kind == "time":
        at = clock(F.year(col), F.month(col), F.dayofmonth(col), F.hour(col), F.minute(col), F.second(col))
        out = make_term(14, i=at, s=F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    else:
        out = make_term(CODE[kind], s=col)
    return F.when(col.isNotNull(), out)


def _entity(prefix: str, i: Column) -> Column:
    return F.concat(F.lit(prefix), i.cast("string"))


def _decimal(d: Column) -> Column:
    """The shortest plain form: integral values without a point."""
    whole = (d == F.floor(d)) & (F.abs(d) < F.lit(1e15))
    return F.when(whole, d.cast("bigint").cast("string")).otherwise(d.cast("string"))


def lexical(col: Column, kind: str) -> Column:
    """STR(): IRIs in full, literals without type and language."""
    if kind == "null":
        return F.lit(None).cast("string")
    prefix = {"item": WD + "entity/Q", "prop": WD + "prop/direct/P", "pstmt": WD + "prop/P", "lexeme": WD + "entity/L", "stmt": PREFIXES["wds"]}
    if kind in prefix:
        return _entity(prefix[kind], col)
    if kind == "text":
        return col["s"]
    if kind == "num":
        return _decimal(col)
    if kind == "time":
        return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    if kind != "term":
        return col.cast("string")
    k = col["k"]
    out = F.when(k == 21, col["i"].cast("string")).when(k == 22, _decimal(col["d"])).when(k == 12, F.regexp_replace(col["s"], r"^\+", "")).when(k == 23, F.when(col["i"] == 1, "true").otherwise("false"))
    for name, start in prefix.items():
        out = out.when(k == CODE[name], F.concat(F.lit(start), col["s"] if name == "stmt" else col["i"].cast("string")))
    out = out.when(k == CODE["media"], F.concat(F.lit(_COMMONS + "wiki/Special:FilePath/"), col["s"]))
    out = out.when(k.isin(CODE["geoshape"], CODE["tabular"]), F.concat(F.lit(_COMMONS + "data/main/"), col["s"]))
    return out.otherwise(col["s"])


def is_iri(col: Column, kind: str) -> Column:
    if kind == "term":
        return col["k"].isin([CODE[k] for k in IRI_KINDS])
    return F.when(col.isNotNull(), F.lit(kind in IRI_KINDS))


def datatype(col: Column, kind: str) -> Column:
    """The datatype IRI; null for IRIs."""
    if kind == "term":
        out = F.lit(None).cast("string")
        for name, iri in DATATYPE.items():
            out = F.when(col["k"] == CODE[name], F.lit(iri)).otherwise(out)
        return F.when(col["k"].isin([CODE[k] for k in STRINGS]) & (col["k"] != CODE["math"]), F.lit(XSD + "string")).otherwise(out)
    return F.when(col.isNotNull(), F.lit(DATATYPE.get(kind)))


def lang(col: Column, kind: str) -> Column:
    """The language tag, '' for other literals."""
    if kind == "text":
        return col["l"]
    if kind == "term":
        return F.when(col["k"] == 5, col["l"]).when(~is_iri(col, kind), F.lit(""))
    return F.when(col.isNotNull(), F.lit(None if kind in IRI_KINDS else ""))


def number(col: Column, kind: str) -> Column:
    """The numeric value as DOUBLE, null for what is no number."""
    if kind == "num":
        return col
    if kind == "int":
        return col.cast("double")
    if kind == "term":
        return F.when(col["k"].isin(12, 21, 22), col["d"])
    return F.lit(None).cast("double")


def plain(col: Column, kind: str) -> Column:
    """The text of a string or language-tagged string, null for other terms."""
    if kind in STRINGS:
        return col
    if kind == "text":
        return col["s"]
    if kind == "term":
        return F.when(col["k"].isin([CODE[k] for k in STRINGS] + [5]), col["s"])
    return F.lit(None).cast("string")


def effective_boolean(col: Column, kind: str) -> Column:
    """EBV; null is an error."""
    if kind == "bool":
        return col
    if kind == "int":
        return col != 0
    if kind == "num":
        return (col != 0) & ~F.isnan(col)
    if kind in (*STRINGS, "text"):
        return F.length(plain(col, kind)) > 0
    if kind == "term":
        return F.when(col["k"] == 23, col["i"] == 1).when(col["k"].isin(12, 21, 22), (col["d"] != 0) & ~F.isnan(col["d"])).when(col["k"].isin(4, 5), F.length(col["s"]) > 0)
    return F.lit(None).cast("boolean")
