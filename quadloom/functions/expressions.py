"""Expressions as Spark columns: operators and all scalar functions.

An error is null, so that FILTER drops it and BIND leaves it unbound; truth
values follow Kleene's logic, as SPARQL's do. Kinds are known when the query is
compiled; only columns of kind "term" are looked into at run time.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import terms as T
from ..plans import algebra as L


@dataclass
class E:
    """A column and its kind."""

    col: Column
    kind: str

    def term(self) -> Column:
        return T.to_term(self.col, self.kind)


NULL = "null"


def null() -> E:
    return E(F.lit(None), NULL)


def string(col: Column) -> E:
    return E(col, "string")


def boolean(col: Column) -> E:
    return E(col, "bool")


def ebv(e: E) -> Column:
    return T.effective_boolean(e.col, e.kind)


def unify(items: list[E]) -> tuple[list[Column], str]:
    """Columns of one kind for alternatives."""
    kinds = {e.kind for e in items} - {NULL}
    if not kinds:
        return [e.col for e in items], NULL
    if len(kinds) == 1:
        kind = kinds.pop()
        if kind == "text":
            return [e.col if e.kind != NULL else F.lit(None).cast("struct<s:string,l:string>") for e in items], kind
        return [e.col for e in items], kind
    if kinds == {"int", "num"}:
        return [e.col.cast("double") for e in items], "num"
    return [e.term() for e in items], "term"


def _comparable(a: E, b: E) -> tuple[Column, Column] | None:
    """Columns whose order is that of the terms, if the kinds are static and comparable."""
    if a.kind in T.NUMERIC and b.kind in T.NUMERIC:
        return (a.col, b.col) if a.kind == b.kind else (a.col.cast("double"), b.col.cast("double"))
    if a.kind == b.kind and a.kind not in ("term", "text", NULL):
        return a.col, b.col
    return None


def same(a: E, b: E) -> Column:
    """sameTerm."""
    if a.kind == b.kind and a.kind != "term":
        return a.col == b.col
    if "term" in (a.kind, b.kind):
        return a.term() == b.term()
    return F.when(a.col.isNotNull() & b.col.isNotNull(), F.lit(False))


def equal(a: E, b: E) -> Column:
    """=: numbers by value, times by their clock, everything else by identity; null if unbound."""
    if NULL in (a.kind, b.kind):
        return F.lit(None).cast("boolean")
    if pair := _comparable(a, b):
        return pair[0] == pair[1]
    if a.kind == b.kind == "text":
        return (a.col["s"] == b.col["s"]) & (a.col["l"] == b.col["l"])
    if "term" in (a.kind, b.kind):
        x, y = a.term(), b.term()
        numeric = x["k"].isin(12, 21, 22) & y["k"].isin(12, 21, 22)
        units = ~((x["k"] == 12) & (y["k"] == 12)) | (F.coalesce(x["l"], F.lit("")) == F.coalesce(y["l"], F.lit("")))
        times = x["k"].isin(13, 14) & y["k"].isin(13, 14)
        return F.when(numeric, (x["d"] == y["d"]) & units).when(times, x["i"] == y["i"]).otherwise(x == y)
    return F.when(a.col.isNotNull() & b.col.isNotNull(), F.lit(False))


def less(a: E, b: E, or_equal: bool) -> Column:
    """< or <=; incomparable terms give false, unbound ones null."""
    if NULL in (a.kind, b.kind):
        return F.lit(None).cast("boolean")
    op: Callable[[Column, Column], Column] = (lambda x, y: x <= y) if or_equal else (lambda x, y: x < y)
    if pair := _comparable(a, b):
        return op(*pair)
    if a.kind == b.kind == "text":
        return (a.col["l"] == b.col["l"]) & op(a.col["s"], b.col["s"])
    if "term" in (a.kind, b.kind):
        x, y = a.term(), b.term()
        numeric = x["k"].isin(12, 21, 22) & y["k"].isin(12, 21, 22)
        units = ~((x["k"] == 12) & (y["k"] == 12)) | (F.coalesce(x["l"], F.lit("")) == F.coalesce(y["l"], F.lit("")))
        calendars = F.coalesce(x["l"], F.lit("")) == F.coalesce(y["l"], F.lit(""))
        out = F.when(numeric, op(x["d"], y["d"]) & units)
        out = out.when(x["k"].isin(13, 14) & y["k"].isin(13, 14), op(x["i"], y["i"]) & (calendars | x["l"].isNull() | y["l"].isNull()))
        out = out.when((x["k"] == y["k"]) & x["k"].isin(1, 2, 3, 25), op(x["i"], y["i"]))
        out = out.when((x["k"] == y["k"]) & x["k"].isin(4, 6, 20, 24), op(x["s"], y["s"]))
        out = out.when((x["k"] == 5) & (y["k"] == 5) & (x["l"] == y["l"]), op(x["s"], y["s"]))
        return out.when(a.col.isNotNull() & b.col.isNotNull(), F.lit(False))
    return F.when(a.col.isNotNull() & b.col.isNotNull(), F.lit(False))


def order_keys(e: E, descending: bool) -> list[Column]:
    """Sort keys: unbound first, then IRIs, numbers, times, strings; exact order within a kind."""
    if e.kind == "term":
        group = F.when(T.is_iri(e.col, "term"), 0).when(e.col["k"].isin(12, 21, 22), 1).when(e.col["k"].isin(13, 14), 2).otherwise(3)
        keys = [F.when(e.col.isNotNull(), group), F.when(group == 1, e.col["d"]), F.when(group != 1, e.col["i"]), T.lexical(e.col, "term"), e.col["l"]]
    elif e.kind == "text":
        keys = [e.col["s"], e.col["l"]]
    else:
        keys = [e.col]
    return [k.desc_nulls_last() if descending else k.asc_nulls_first() for k in keys]


# ---- arithmetic


def arithmetic(op: str, a: E, b: E) -> E:
    if a.kind == b.kind == "int" and op != "/":
        return E({"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](a.col, b.col), "int")
    x, y = T.number(a.col, a.kind), T.number(b.col, b.kind)
    if op == "/":
        return E(F.try_divide(x, y), "num")
    return E({"+": x + y, "-": x - y, "*": x * y}[op], "num")


def _keep_kind(f: Callable[[Column], Column]) -> Callable[[E], E]:
    def run(e: E) -> E:
        if e.kind == "int":
            return E(f(e.col).cast("bigint"), "int")
        return E(f(T.number(e.col, e.kind)).cast("double"), "num")

    return run


# ---- strings


def _as(e: E, text: Column) -> E:
    """A changed string that keeps its language."""
    if e.kind == "text":
        return E(F.when(text.isNotNull(), F.struct(text.alias("s"), e.col["l"].alias("l"))), "text")
    if e.kind == "term":
        return E(F.when(text.isNotNull(), T.make_term(F.when(e.col["k"] == 5, 5).otherwise(4), s=text, l=F.when(e.col["k"] == 5, e.col["l"]))), "term")
    return string(text)


def _text(e: E) -> Column:
    return T.plain(e.col, e.kind)


def _substr(s: E, start: E, length: E | None = None) -> E:
    first = F.round(T.number(start.col, start.kind)).cast("int")
    text = _text(s)
    if length is None:
        end = F.length(text) + 1
    else:
        end = first + F.round(T.number(length.col, length.kind)).cast("int")
    begin = F.greatest(first, F.lit(1))
    return _as(s, F.when(end > begin, F.substring(text, begin, end - begin)).when(text.isNotNull() & end.isNotNull(), F.lit("")))


def _before(a: E, b: E) -> E:
    x, y = _text(a), _text(b)
    at = F.position(y, x)
    return _as(a, F.when(F.length(y) == 0, F.lit("")).when(at > 0, F.substring(x, F.lit(1), at - 1)).when(at == 0, F.lit("")))


def _after(a: E, b: E) -> E:
    x, y = _text(a), _text(b)
    at = F.position(y, x)
    return _as(a, F.when(F.length(y) == 0, x).when(at > 0, F.substring(x, at + F.length(y), F.length(x))).when(at == 0, F.lit("")))


def _encode(e: E) -> E:
    out = F.url_encode(_text(e))
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return string(out)


def _lang_matches(tag: E, want: E) -> E:
    t, r = F.lower(_text(tag)), F.lower(_text(want))
    return boolean(F.when(r == "*", F.length(t) > 0).otherwise((t == r) | t.startswith(F.concat(r, F.lit("-")))))


def _pattern(e: object, flags: object, kind: Callable[[object], E]) -> tuple[Column, bool]:
    """The Java pattern, and whether the flag q makes it literal. Constant patterns are checked now."""
    if flags is not None and not (isinstance(flags, T.Const) and re.fullmatch("[imsxq]*", str(flags.value))):
        raise T.SparqlError("regular expression flags must be a constant of i, m, s, x, q")
    f = str(flags.value) if flags is not None else ""
    quoted = "q" in f
    start = "".join(sorted(set(f) - {"q"}))
    start = f"(?{start})" if start else ""
    if isinstance(e, T.Const):
        text = str(e.value)
        if not quoted:
            try:
                re.compile(re.sub(r"\\p\{\w+\}", "x", text))
            except re.error as x:
                raise T.SparqlError(f"bad regular expression {text!r}: {x}") from x
        return F.lit(start + (_quote(text) if quoted else text)), quoted
    col = _text(kind(e))
    return F.concat(F.lit(start), F.regexp_replace(col, r"([\\^$.|?*+()\[\]{}])", r"\\$1") if quoted else col), quoted


def _quote(text: str) -> str:
    return re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", text)


# ---- times


def _part(name: str) -> Callable[[E], E]:
    function = {"YEAR": F.year, "MONTH": F.month, "DAY": F.dayofmonth, "HOURS": F.hour, "MINUTES": F.minute, "SECONDS": F.second}[name]
    place = ["YEAR", "MONTH", "DAY", "HOURS", "MINUTES", "SECONDS"].index(name)

    def run(e: E) -> E:
        if e.kind == "time":
            return E(function(e.col).cast("bigint"), "int")
        if e.kind == "term":
            # From the clock number: its digits are in mixed bases.
            bases = [13, 32, 24, 60, 61][place:]
            value = e.col["i"]
            for base in reversed(bases):
                value = F.call_function("div", value - F.pmod(value, F.lit(base)), F.lit(base))
            if place:
                value = F.pmod(value, F.lit([13, 32, 24, 60, 61][place - 1]))
            return E(F.when(e.col["k"].isin(13, 14), value), "int")
        return E(F.lit(None).cast("bigint"), "int")

    return run


# ---- terms


def _iri(e: E) -> E:
    if e.kind in T.IRI_KINDS:
        return e
    text = T.lexical(e.col, e.kind)
    shape = lambda p: F.regexp_extract(text, "^" + re.escape(p) + r"(\d+)$", 1)
    out = F.lit(None).cast(T.TERM)
    for kind, start in (("pstmt", T.WD + "prop/P"), ("prop", T.WD + "prop/direct/P"), ("lexeme", T.WD + "entity/L"), ("item", T.WD + "entity/Q")):
        out = F.when(shape(start) != "", T.make_term(T.CODE[kind], i=shape(start).try_cast("bigint"))).otherwise(out)
    return E(F.coalesce(out, F.when(text.isNotNull(), T.make_term(T.CODE["iri"], s=text))), "term")


def _strdt(e: E, datatype: object) -> E:
    if not isinstance(datatype, T.Const):
        raise T.SparqlError("STRDT needs a constant datatype")
    return cast(E(_text(e), "string"), str(datatype.value))


_CASTS = {"integer": "int", "int": "int", "long": "int", "decimal": "num", "double": "num", "float": "num", "boolean": "bool", "dateTime": "time", "date": "time", "string": "string"}


def cast(e: E, iri: str) -> E:
    """xsd:name(e)."""
    kind = _CASTS.get(iri.removeprefix(T.XSD))
    if kind is None:
        raise T.SparqlError(f"unsupported datatype {iri}")
    if kind == "string":
        return string(T.lexical(e.col, e.kind))
    if e.kind == "time" and kind == "time":
        return e
    if kind in ("int", "num") and e.kind in ("int", "num", "bool"):
        if kind == "int" and e.kind == "num":
            return E(F.when(F.abs(e.col) < F.lit(9.2e18), F.when(e.col >= 0, F.floor(e.col)).otherwise(F.ceil(e.col))).cast("bigint"), "int")
        return E(e.col.cast("bigint" if kind == "int" else "double"), kind)
    if kind == "bool" and e.kind in ("int", "num"):
        return boolean(ebv(e))
    text = F.trim(T.lexical(e.col, e.kind))
    if kind == "time":
        return E(F.regexp_replace(text, r"(Z|[+-]\d\d:\d\d)$", "").try_cast("timestamp_ntz"), "time")
    if kind == "int":
        text = F.when(text.rlike(r"^[+-]?\d+$") if e.kind == "string" else F.lit(True), text)
        return E(text.try_cast("double").try_cast("bigint") if e.kind == "term" else text.try_cast("bigint"), "int")
    return E(text.try_cast({"num": "double", "bool": "boolean"}[kind]), kind)


def _logic(name: str) -> Callable[[E, E], E]:
    return lambda a, b: boolean((ebv(a) & ebv(b)) if name == "&&" else (ebv(a) | ebv(b)))


def _numeric(e: E) -> E:
    if e.kind == "term":
        return boolean(e.col["k"].isin(12, 21, 22))
    return boolean(F.when(e.col.isNotNull(), F.lit(e.kind in T.NUMERIC)))


#: Functions of compiled arguments.
FUNCTIONS: dict[str, Callable[..., E]] = {
    "&&": _logic("&&"),
    "||": _logic("||"),
    "!": lambda a: boolean(~ebv(a)),
    "=": lambda a, b: boolean(equal(a, b)),
    "!=": lambda a, b: boolean(~equal(a, b)),
    "<": lambda a, b: boolean(less(a, b, False)),
    "<=": lambda a, b: boolean(less(a, b, True)),
    ">": lambda a, b: boolean(less(b, a, False)),
    ">=": lambda a, b: boolean(less(b, a, True)),
    "SAMETERM": lambda a, b: boolean(same(a, b)),
    "+": lambda a, b: arithmetic("+", a, b),
    "-": lambda a, b: arithmetic("-", a, b),
    "*": lambda a, b: arithmetic("*", a, b),
    "/": lambda a, b: arithmetic("/", a, b),
    "POS": _keep_kind(lambda x: x),
    "NEG": _keep_kind(lambda x: -x),
    "ABS": _keep_kind(F.abs),
    "CEIL": _keep_kind(F.ceil),
    "FLOOR": _keep_kind(F.floor),
    "ROUND": _keep_kind(lambda x: F.floor(x + F.lit(0.5))),
    "RAND": lambda: E(F.rand(), "num"),
    "STR": lambda e: string(T.lexical(e.col, e.kind)),
    "LANG": lambda e: string(T.lang(e.col, e.kind)),
    "DATATYPE": lambda e: E(T.datatype(e.col, e.kind), "iri"),
    "IRI": _iri,
    "URI": _iri,
    "BNODE": lambda e=None: E(F.concat(F.lit("_:"), F.md5(_text(e)) if e else F.uuid()), "iri"),
    "UUID": lambda: E(F.concat(F.lit("urn:uuid:"), F.uuid()), "iri"),
    "STRUUID": lambda: string(F.uuid()),
    "STRLANG": lambda a, b: E(F.when(_text(a).isNotNull() & _text(b).isNotNull(), F.struct(_text(a).alias("s"), F.lower(_text(b)).alias("l"))), "text"),
    "ISIRI": lambda e: boolean(T.is_iri(e.col, e.kind)),
    "ISURI": lambda e: boolean(T.is_iri(e.col, e.kind)),
    "ISBLANK": lambda e: boolean(F.when(e.col.isNotNull(), F.lit(False))),
    "ISLITERAL": lambda e: boolean(~T.is_iri(e.col, e.kind)),
    "ISNUMERIC": _numeric,
    "STRLEN": lambda e: E(F.length(_text(e)).cast("bigint"), "int"),
    "SUBSTR": _substr,
    "UCASE": lambda e: _as(e, F.upper(_text(e))),
    "LCASE": lambda e: _as(e, F.lower(_text(e))),
    "STRSTARTS": lambda a, b: boolean(_text(a).startswith(_text(b))),
    "STRENDS": lambda a, b: boolean(_text(a).endswith(_text(b))),
    "CONTAINS": lambda a, b: boolean(_text(a).contains(_text(b))),
    "STRBEFORE": _before,
    "STRAFTER": _after,
    "ENCODE_FOR_URI": _encode,
    "CONCAT": lambda *e: string(F.concat(*(_text(x) for x in e)) if e else F.lit("")),
    "LANGMATCHES": _lang_matches,
    "NOW": lambda: E(F.localtimestamp(), "time"),
    "TIMEZONE": lambda e: E(F.when(_is_time(e), F.make_dt_interval()), "interval"),
    "TZ": lambda e: string(F.when(_is_time(e), F.lit("Z"))),
    **{n: _part(n) for n in ("YEAR", "MONTH", "DAY", "HOURS", "MINUTES", "SECONDS")},
    "MD5": lambda e: string(F.md5(_text(e))),
    "SHA1": lambda e: string(F.sha1(_text(e))),
    **{f"SHA{n}": (lambda n: lambda e: string(F.sha2(_text(e), n)))(n) for n in (256, 384, 512)},
}

#: Further functions by IRI: callables of E arguments. Applications may add their own.
CUSTOM: dict[str, Callable[..., E]] = {}


def _is_time(e: E) -> Column:
    if e.kind == "term":
        return e.col["k"].isin(13, 14)
    return e.col.isNotNull() & F.lit(e.kind == "time")


class Scope:
    """Compiles expressions over named, kinded columns."""

    def __init__(self, lookup: Callable[[str], E], exists: Callable[[L.Exists], Column] | None = None, joined: Callable[[L.Call], E | None] | None = None):
        """joined gives the value of calls that were joined to the rows beforehand."""
        self.lookup, self.exists, self.joined = lookup, exists, joined

    def compile(self, node: object) -> E:
        if isinstance(node, L.Var):
            return self.lookup(node.name)
        if isinstance(node, T.Const):
            return E(T.literal(node), node.kind)
        if isinstance(node, L.Exists):
            if self.exists is None:
                raise T.SparqlError("EXISTS is not possible here")
            return boolean(self.exists(node))
        if not isinstance(node, L.Call):
            raise T.SparqlError(f"not an expression: {node!r}")
        name, args = node.name, node.args
        if self.joined and (e := self.joined(node)) is not None:
            return e
        if name == "BOUND":
            return boolean(self.compile(args[0]).col.isNotNull())
        if name == "IF":
            test = ebv(self.compile(args[0]))
            (a, b), kind = unify([self.compile(args[1]), self.compile(args[2])])
            return E(F.when(test, a).when(~test, b), kind)
        if name == "COALESCE":
            cols, kind = unify([self.compile(a) for a in args])
            return E(F.coalesce(*cols), kind) if cols else null()
        if name == "IN":
            left = self.compile(args[0])
            out = F.lit(False)
            for a in args[1:]:
                out = out | equal(left, self.compile(a))
            return boolean(out)
        if name in ("REGEX", "REPLACE"):
            text = self.compile(args[0])
            flags = args[2] if name == "REGEX" and len(args) > 2 else args[3] if len(args) > 3 else None
            pattern, quoted = _pattern(args[1], flags, self.compile)
            if name == "REGEX":
                return boolean(F.rlike(_text(text), pattern))
            with_ = _text(self.compile(args[2]))
            if quoted:
                with_ = F.regexp_replace(with_, r"([\\$])", r"\\$1")
            return _as(text, F.regexp_replace(_text(text), pattern, with_))
        if name == "STRDT":
            return _strdt(self.compile(args[0]), args[1])
        if name.startswith(T.XSD):
            return cast(self.compile(args[0]), name)
        function = FUNCTIONS.get(name) or CUSTOM.get(name)
        if function is None:
            raise T.SparqlError(f"unsupported function {name}")
        return function(*(self.compile(a) for a in args))
