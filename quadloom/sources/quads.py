"""Quad tables: (s, p, o, id) with terms as structs.

Columns: s, p, o TERM; id STRING, the statement's id; claim BOOLEAN, whether it is a
statement that can have qualifiers; rank STRING; pkey STRING, the name of the
predicate, by which the table is partitioned on disk. Within a file, rows are
sorted by subject, so that constants skip row groups.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import terms as T
from ..plans import algebra as L
from ..plans.relation import Rel, V, empty
from . import dumps
from .base import Part, Source, predicate

SCHEMA = f"s {T.TERM}, p {T.TERM}, o {T.TERM}, id string, claim boolean, rank string, pkey string"


#: Bytes of input that a file of the table is made of, about.
FILE_BYTES = 256 << 20


def _write(quads: DataFrame, path: str, key: str) -> None:
    """Ranges of (predicate, key), as many as the size of the input asks for: a frequent predicate has many files, rare ones share a task and have one each."""
    size = quads._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    parts = -(-size // FILE_BYTES) if 0 < size < 1 << 60 else 0
    ranges = quads.repartitionByRange(max(int(quads.sparkSession.conf.get("spark.sql.shuffle.partitions")), parts), "pkey", key)
    ranges.sortWithinPartitions("pkey", key).write.mode("overwrite").option("maxRecordsPerFile", 20_000_000).partitionBy("pkey").parquet(path)


def write(quads: DataFrame, path: str, by_object: str | None = None) -> None:
    """The table partitioned by predicate and clustered by subject; a second copy clustered by object if wanted."""
    _write(quads, path, "s")
    if by_object:
        write_by_object(quads, by_object)


def write_by_object(quads: DataFrame, path: str) -> None:
    """The copy that lookups by object read."""
    _write(quads, path, "o")


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def matches(col: Column, c: T.Const) -> Column:
    """Whether a TERM column is this constant, as tests on its fields that a scan can push down."""
    if c.kind in ("item", "prop", "pstmt", "lexeme"):
        return (col["k"] == T.CODE[c.kind]) & (col["i"] == int(c.value))
    if c.kind in T.NUMERIC:
        return col["k"].isin(12, 21, 22) & (col["d"] == float(c.value))
    if c.kind == "string":
        return col["k"].isin([T.CODE[k] for k in T.STRINGS]) & (col["s"] == c.value)
    if c.kind in ("iri", "stmt"):
        return (col["k"] == T.CODE[c.kind]) & (col["s"] == c.value)
    if c.kind == "text":
        return (col["k"] == 5) & (col["s"] == c.value) & (col["l"] == c.lang)
    if c.kind == "time":
        return col["k"].isin(13, 14) & (col["i"] == T.to_term(T.literal(c), "time")["i"])
    return F.lit(False)


def fixture(spark: SparkSession, text: str) -> DataFrame:
    """Quads from "wd:Q1, wdt:P2, wd:Q3, wds:4; ..." for tests and examples."""

    def term(x: str) -> Column:
        prefix, local = x.strip().split(":", 1)
        c = T.parse_iri(T.PREFIXES[prefix] + local)
        return T.to_term(T.literal(c), c.kind)

    rows = []
    for line in filter(str.strip, text.split(";")):
        s, p, o, st = (x.strip() for x in line.split(","))
        rows.append(F.struct(term(s).alias("s"), term(p).alias("p"), term(o).alias("o"), F.lit(st.split(":", 1)[1]).alias("id"), F.lit(True).alias("claim"), F.lit("normal").alias("rank"), F.lit(p.split(":", 1)[1]).alias("pkey")))
    return spark.range(1).select(F.explode(F.array(*rows)).alias("q")).select("q.*")


class QuadSource(Source):
    """A graph in a quad table; by_object, if given, is the copy that lookups by object read."""

    def __init__(self, quads: DataFrame, by_object: DataFrame | None = None):
        self.quads, self.by_object, self.spark = quads, by_object, quads.sparkSession

    def stars(self, triples: list[L.Triple]) -> list[Part]:
        return [Part(isinstance(t.s, T.Const) + isinstance(t.o, T.Const), lambda t=t: self._match(t)) for t in triples]

    def facts(self, keys: set[str] | None = None, subject: object = None, by_object: bool = False) -> DataFrame:
        """Quads that hold at least all facts of these predicates (None: of all) and this subject (if it is a constant)."""
        return self.by_object if by_object and self.by_object is not None else self.quads

    def _table(self, t: L.Triple, keys: set[str] | None = None) -> DataFrame:
        return self.facts(keys, t.s, isinstance(t.o, T.Const) and not isinstance(t.s, T.Const))

    def _match(self, t: L.Triple) -> Rel:
        s, o = (F.col("s"), "term"), (F.col("o"), "term")
        st = (F.col("id"), "stmt")
        if isinstance(t.p, L.Var):
            return self._wildcard(t)
        view, name = predicate(t.p.iri)
        q = self._table(t, {name if view == "label" else f"P{name}"})
        if view == "direct":
            q = q.where(F.col("pkey") == f"P{name}")
        elif view == "statement":
            q, o = q.where((F.col("pkey") == f"P{name}") & F.col("claim")), st
        elif view == "value":
            q, s = q.where((F.col("pkey") == f"P{name}") & F.col("claim")), st
        elif view == "qualifier":
            q, s = q.where((F.col("pkey") == f"P{name}") & (F.col("s.k") == T.CODE["stmt"])), (F.col("s.s"), "stmt")
        elif view == "label":
            q, o = q.where(F.col("pkey") == name), (F.struct(F.col("o.s").alias("s"), F.col("p.s").alias("l")), "text")
        else:
            return empty(self.spark, {n: V("iri") for n in sorted(L.variables((t.s, t.o)))})
        return self._bind(q, [(t.s, s), (t.o, o)])

    def _bind(self, q: DataFrame, places: list[tuple[object, tuple[Column, str]]]) -> Rel:
        out: dict[str, tuple[Column, V]] = {}
        for x, (col, kind) in places:
            if isinstance(x, T.Const):
                q = q.where(matches(col, x) if kind == "term" else (col == T.literal(x) if x.kind == kind else F.lit(False)))
            elif x.name in out:
                a, v = out[x.name]
                q = q.where(T.to_term(a, v.kind) == T.to_term(col, kind))
            else:
                q = q.where(col.isNotNull())
                out[x.name] = (col, V(kind))
        return Rel(q, {}).select(out)

    def _wildcard(self, t: L.Triple) -> Rel:
        """Direct facts; claims as statements too if the subject is constant, only they if the object is a statement."""
        direct = self._table(t).select("s", "p", "o")
        claims = self.facts(subject=t.s).where("claim").select("s", T.make_term(T.CODE["pstmt"], i=F.col("p.i")).alias("p"), T.to_term(F.col("id"), "stmt").alias("o"))
        if isinstance(t.o, T.Const) and t.o.kind == "stmt":
            q = claims
        elif isinstance(t.s, T.Const):
            q = direct.unionByName(claims)
        else:
            q = direct
        return self._bind(q, [(t.s, (F.col("s"), "term")), (t.p, (F.col("p"), "term")), (t.o, (F.col("o"), "term"))])

    def edges_except(self, iris: tuple[str, ...], subject: T.Const | None = None) -> Rel:
        keys = [f"P{n}" if view == "direct" else str(n) for view, n in map(predicate, iris)]
        q = self.facts(subject=subject)
        q = q.where(~F.col("pkey").isin(keys)) if keys else q
        return self._bind(q, [(L.Var(".s"), (F.col("s"), "term")), (L.Var(".o"), (F.col("o"), "term"))])

    def nodes(self) -> Rel:
        both = reduce(DataFrame.unionByName, [self.facts().select(F.col(c).alias("n")) for c in ("s", "o")])
        return Rel(both.where("n is not null").distinct(), {}).select({".s": (F.col("n"), V("term"))})

    def labels(self, what: str, languages: list[str], classes: frozenset[int] | None = None) -> Rel:
        q = self.facts({what}).where((F.col("pkey") == what) & F.col("p.s").isin(languages))
        return Rel(q, {}).select({".s": (F.col("s"), V("term")), ".lang": (F.col("p.s"), V("string")), ".value": (F.col("o.s"), V("string"))})


class DumpSource(QuadSource):
    """A graph in dump lines that are read as often as patterns ask for them; nothing is stored.

    lines(keys, subject) gives lines (column value) with at least all facts of these predicates (None: of all) about
    this entity (None: about all). A statement and its qualifiers are in one line, so the triples of
    one statement are one pass without a join.
    """

    def __init__(self, spark: SparkSession, lines: Callable[[set[str] | None, int | None], DataFrame]):
        self.spark, self.lines = spark, lines

    def _items(self, keys: set[str] | None, subject: object) -> DataFrame:
        number = int(subject.value) if isinstance(subject, T.Const) and subject.kind == "item" else None
        return dumps.entities(self.lines(keys, number))

    def facts(self, keys: set[str] | None = None, subject: object = None, by_object: bool = False) -> DataFrame:
        return dumps.quads(self._items(keys, subject), keys=keys)

    def stars(self, triples: list[L.Triple]) -> list[Part]:
        view = lambda t: predicate(t.p.iri)[0] if isinstance(t.p, L.Link) else None
        known = {t.o for t in triples if view(t) == "statement"} | {t.s for t in triples if view(t) in ("value", "qualifier")}
        stars: dict[object, list[L.Triple]] = {}
        rest = []
        for t in triples:
            if view(t) == "statement":
                stars.setdefault(t.o, []).append(t)
            elif view(t) in ("value", "qualifier", "direct") and t.s in known and (isinstance(t.s, L.Var) or t.s.kind == "stmt"):
                stars.setdefault(t.s, []).append(t)
            else:
                rest.append(t)
        rest += [own[0] for own in stars.values() if len(own) == 1]
        count = lambda own: sum(isinstance(x, T.Const) for t in own for x in (t.s, t.o))
        return super().stars(rest) + [Part(count(own), lambda st=st, own=own: self._statement(st, own)) for st, own in stars.items() if len(own) > 1]

    def _statement(self, st: object, triples: list[L.Triple]) -> Rel:
        """A statement with its subject, values and qualifiers, row by row of the claims."""
        views = [(t, *predicate(t.p.iri)) for t in triples]
        own = {n for _, view, n in views if view in ("statement", "value")}
        sides = {f"q{k}": n for k, (_, view, n) in enumerate(views) if view in ("qualifier", "direct")}
        subject = next((t.s for t, view, _ in views if view == "statement" and isinstance(t.s, T.Const)), None)
        q = dumps.statements(self._items({f"P{n}" for n in (*own, *sides.values())}, subject))
        for n in own:
            q = q.where(F.col("snak.property") == f"P{n}")
        of = lambda n: F.filter("qualifiers", lambda x: x["property"] == f"P{n}")
        q = q.select("s", "id", "snak", *(dumps.once(of(n)).alias(c) for c, n in sides.items()))
        for c in sides:
            q = q.withColumn(c, F.explode(c))
        q = dumps.snak_terms(q, "snak", *sides)
        places = [(t.s, (F.col("s"), "term")) if view == "statement" else (t.o, (F.col("snak" if view == "value" else f"q{k}"), "term")) for k, (t, view, _) in enumerate(views)]
        return self._bind(q, [(st, (F.col("id"), "stmt")), *places])
