"""A virtual graph over relational tables.

Each row of an entity table is an entity, numbered (key + 1) * 16 + class, each
column a property. Rows of a link table are statements of one property, whose
other columns are qualifiers. Patterns with one subject become one scan of the
table that holds their properties (no self-joins), constants become filters on
its columns, and only the columns that are asked for are read.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import terms as T
from ..operators import joins
from ..plans import algebra as L
from ..plans.relation import Rel, V, empty
from .base import Part, Source, predicate

BASE = 16


@dataclass(frozen=True)
class Column_:
    """A column and what its values are; cls: of items, the class they belong to."""

    name: str
    kind: str
    cls: int = 0
    language: str = ""  # of kind text: the column with the language

    def value(self) -> Column:
        if self.kind == "item":
            return (F.col(self.name).cast("bigint") + 1) * BASE + self.cls
        if self.kind == "text":
            return F.when(F.col(self.name).isNotNull(), F.struct(F.col(self.name).alias("s"), F.col(self.language).alias("l")))
        return F.col(self.name).cast({"int": "bigint", "num": "double", "time": "timestamp_ntz"}.get(self.kind, "string"))

    def equals(self, c: T.Const) -> Column | None:
        """A filter that the scan can push down; None: never."""
        if self.kind == "item" and c.kind == "item":
            return F.col(self.name) == int(c.value) // BASE - 1 if int(c.value) % BASE == self.cls and int(c.value) >= BASE else None
        if self.kind == "text" and c.kind == "text":
            return (F.col(self.name) == c.value) & (F.col(self.language) == c.lang)
        if self.kind == "num" and c.kind == "int" or self.kind == "num" == c.kind:
            return F.col(self.name) == float(c.value)  # a stored number matches any numeric constant of its value
        if self.kind == c.kind:
            return F.col(self.name) == T.literal(c)
        return None


@dataclass(frozen=True)
class Entities:
    """A table with one row for each subject of a class (several if not unique)."""

    table: str
    cls: int
    key: str
    properties: dict[int, Column_]
    label: str | None = None
    #: Whether this table says which entities there are (and thus gives P31).
    defines: bool = True
    distinct: bool = False


@dataclass(frozen=True)
class Links:
    """A table whose rows are statements of one property with qualifiers."""

    table: str
    cls: int
    key: str
    property: int
    value: Column_
    qualifiers: dict[int, Column_] = field(default_factory=dict)


INSTANCE_OF = 31

STAR_SCHEMA: tuple[Entities | Links, ...] = (
    Entities("region", 1, "r_regionkey", {}, "r_name"),
    Entities("nation", 2, "n_nationkey", {11: Column_("n_regionkey", "item", 1)}, "n_name"),
    Entities("supplier", 3, "s_suppkey", {10: Column_("s_nationkey", "item", 2), 12: Column_("s_acctbal", "num")}, "s_name"),
    Entities("customer", 4, "c_custkey", {10: Column_("c_nationkey", "item", 2), 12: Column_("c_acctbal", "num"), 13: Column_("c_mktsegment", "string")}, "c_name"),
    Entities("part", 5, "p_partkey", {20: Column_("p_brand", "string"), 21: Column_("p_type", "string"), 22: Column_("p_size", "int"), 23: Column_("p_retailprice", "num")}, "p_name"),
    Entities("orders", 6, "o_orderkey", {30: Column_("o_custkey", "item", 4), 32: Column_("o_orderstatus", "string"), 33: Column_("o_totalprice", "num"), 34: Column_("o_orderdate", "time"), 35: Column_("o_orderpriority", "string")}),
    Links(
        "lineitem",
        6,
        "l_orderkey",
        40,
        Column_("l_partkey", "item", 5),
        {41: Column_("l_suppkey", "item", 3), 42: Column_("l_linenumber", "int"), 43: Column_("l_quantity", "num"), 44: Column_("l_extendedprice", "num"), 45: Column_("l_discount", "num"), 46: Column_("l_tax", "num"), 47: Column_("l_returnflag", "string"), 48: Column_("l_linestatus", "string"), 49: Column_("l_shipdate", "time")},
    ),
    Entities("events", 7, "event_id", {50: Column_("user_id", "item", 8), 51: Column_("event_type", "string"), 52: Column_("value", "num"), 53: Column_("ts", "time"), 54: Column_("props", "string")}),
    Entities("events", 8, "user_id", {}, distinct=True),
    Entities("documents", 9, "doc_id", {60: Column_("text", "text", language="lang"), 61: Column_("source", "string"), 62: Column_("n_chars", "int")}),
    Entities("labels", 9, "doc_id", {63: Column_("quality", "int"), 64: Column_("toxic", "int")}, defines=False),
)


class RelationalSource(Source):
    one_label_each = True

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], schema: tuple[Entities | Links, ...] = STAR_SCHEMA):
        self.spark, self.tables = spark, tables
        self.schema = [v for v in schema if v.table in tables]

    @classmethod
    def from_parquet(cls, spark: SparkSession, folder: str, schema: tuple[Entities | Links, ...] = STAR_SCHEMA) -> RelationalSource:
        """The tables of a folder, each read when it is first asked for."""
        return cls(spark, _Lazy(spark, folder, {v.table for v in schema}), schema)

    # ---- scans

    def _key(self, v: Entities | Links) -> Column_:
        return Column_(v.key, "item", v.cls)

    def _rows(self, v: Entities | Links) -> DataFrame:
        df = self.tables[v.table]
        return df.select(v.key).distinct() if isinstance(v, Entities) and v.distinct else df

    def _statement_id(self, v: Entities | Links, number: int) -> Column:
        entity = F.concat(F.lit("Q"), self._key(v).value().cast("string"))
        if isinstance(v, Links):
            row = F.to_json(F.struct(*sorted(self.tables[v.table].columns)))
            return F.concat(entity, F.lit("-"), F.md5(row))
        return F.concat(entity, F.lit(f"-P{number}"))

    def _scan(self, v: Entities | Links, bound: list[tuple[object, Column_ | tuple[Column, str]]]) -> Rel:
        """One pass over a table: each (variable or constant, column or computed column with its kind) is bound or filtered; nulls state nothing."""
        df = self._rows(v)
        out: dict[str, tuple[Column, V]] = {}
        tests: list[Column] = []
        for x, c in bound:
            if isinstance(x, T.Const):
                test = c.equals(x) if isinstance(c, Column_) else (c[0] == x.value if x.kind == c[1] else None)
                tests.append(F.lit(False) if test is None else test)
                continue
            value, kind = (c.value(), c.kind) if isinstance(c, Column_) else c
            if isinstance(c, Column_):
                tests.append(F.col(c.name).isNotNull())
            if x.name in out:
                a, ka = out[x.name][0], out[x.name][1].kind
                tests.append(a == value if ka == kind else F.lit(False))
            else:
                out[x.name] = (value, V(kind, classes=frozenset({c.cls}) if kind == "item" and isinstance(c, Column_) else None, repeats=isinstance(c, Column_) and not (isinstance(v, Entities) and c.name == v.key)))
        if tests:
            df = df.where(reduce(lambda a, b: a & b, tests))
        return Rel(df, {}).select(out)

    # ---- patterns

    def stars(self, triples: list[L.Triple]) -> list[Part]:
        statements = {t.o for t in triples if isinstance(t.p, L.Link) and predicate(t.p.iri)[0] == "statement"}
        statements |= {t.s for t in triples if isinstance(t.p, L.Link) and predicate(t.p.iri)[0] in ("value", "qualifier")}
        classes = self._classes(triples)
        stars: dict[object, list[L.Triple]] = {}
        of_statement: dict[object, list[L.Triple]] = {}
        parts = []
        for t in triples:
            if isinstance(t.p, L.Var):
                parts.append(Part(isinstance(t.s, T.Const) + isinstance(t.o, T.Const), lambda t=t: self._wildcard(t, classes.get(t.s))))
            elif predicate(t.p.iri)[0] == "statement":
                of_statement.setdefault(t.o, []).append(t)
            elif t.s in statements or isinstance(t.s, T.Const) and t.s.kind == "stmt":
                of_statement.setdefault(t.s, []).append(t)
            else:
                stars.setdefault(t.s, []).append(t)
        count = lambda own: sum(isinstance(x, T.Const) for t in own for x in (t.s, t.o))
        parts += [Part(count(own), lambda s=s, own=own: self._star(s, own, classes.get(s))) for s, own in stars.items()]
        parts += [Part(count(own), lambda s=s, own=own: self._statement(s, own)) for s, own in of_statement.items()]
        return parts

    def _classes(self, triples: list[L.Triple]) -> dict[object, set[int]]:
        """The classes that each variable can have, from all triples of the pattern, so that no other table is read."""
        out: dict[object, set[int]] = {}

        def of(x: object) -> set[int]:
            if isinstance(x, T.Const):
                return {int(x.value) % BASE} if x.kind == "item" else set()
            return out.get(x, {v.cls for v in self.schema})

        before = None
        while before != out:
            before = {x: set(c) for x, c in out.items()}
            for t in triples:
                if not isinstance(t.p, L.Link):
                    continue
                view, name = predicate(t.p.iri)
                columns: list[Column_] = []
                if view in ("direct", "label"):
                    holders = [v for v in self.schema if v.cls in of(t.s) and self._holds(v, view, name, t.o)]
                    if isinstance(t.s, L.Var) and holders:
                        out[t.s] = of(t.s) & {v.cls for v in holders}
                    if view == "direct" and name != INSTANCE_OF:
                        columns = [v.value if isinstance(v, Links) else v.properties[name] for v in holders]
                elif view == "statement":
                    owners = {v.cls for v in self.schema if name in ({v.property} if isinstance(v, Links) else v.properties)}
                    if isinstance(t.s, L.Var) and owners:
                        out[t.s] = of(t.s) & owners
                elif view in ("value", "qualifier"):
                    columns = [c for v in self.schema for n, c in ({v.property: v.value} if isinstance(v, Links) else v.properties if view == "value" else {}).items() if view == "value" and n == name]
                    columns += [v.qualifiers[name] for v in self.schema if view == "qualifier" and isinstance(v, Links) and name in v.qualifiers]
                if isinstance(t.o, L.Var) and columns and all(c.kind == "item" for c in columns):
                    out[t.o] = of(t.o) & {c.cls for c in columns}
        return out

    def _nothing(self, triples: list[L.Triple]) -> Rel:
        names = dict.fromkeys(n for t in triples for n in sorted(L.variables((t.s, t.o))))
        return empty(self.spark, {n: V("item") for n in names})

    def _star(self, s: object, triples: list[L.Triple], possible: set[int] | None = None) -> Rel:
        """All direct triples of a subject: for each class that has all their properties, a scan of each table involved."""
        if isinstance(s, T.Const) and s.kind != "item":
            return self._nothing(triples)
        classes = {v.cls for v in self.schema} if possible is None else set(possible)
        if isinstance(s, T.Const):
            classes &= {int(s.value) % BASE} if int(s.value) >= BASE else set()
        found: list[Rel] = []
        for cls in sorted(classes):
            views = [v for v in self.schema if v.cls == cls]
            scans: dict[int, list[tuple[object, Column_ | tuple[Column, str]]]] = {}
            single: list[Rel] = []
            for t in triples:
                view, name = predicate(t.p.iri)
                holders = [v for v in views if self._holds(v, view, name, t.o)]
                if not holders:
                    break
                v = holders[0]
                if isinstance(v, Links):
                    single.append(self._scan(v, [(s, self._key(v)), (t.o, v.value)]))
                elif (view, name) == ("direct", INSTANCE_OF):
                    own = scans.setdefault(views.index(v), [])
                    if isinstance(t.o, L.Var):
                        own.append((t.o, (F.lit(cls).cast("bigint"), "item")))
                else:
                    c = Column_(v.label, "string") if view == "label" else v.properties[name]
                    scans.setdefault(views.index(v), []).append((t.o, c))
            else:
                rels = [self._scan(views[k], [(s, self._key(views[k])), *own]) for k, own in scans.items()] + single
                found.append(reduce(joins.join, rels))
        if not found:
            return self._nothing(triples)
        rel = reduce(joins.union, found)
        if isinstance(s, L.Var):
            rel.vars[s.name] = replace(rel.vars[s.name], classes=frozenset(classes))
        return rel

    def _holds(self, v: Entities | Links, view: str, name: object, o: object) -> bool:
        if isinstance(v, Links):
            return view == "direct" and name == v.property
        if view == "label":
            return name == "label" and v.label is not None
        if view != "direct":
            return False
        if name == INSTANCE_OF:
            return v.defines and (isinstance(o, L.Var) or o == T.Const("item", v.cls))
        return name in v.properties

    def _statement(self, st: object, triples: list[L.Triple]) -> Rel:
        """A statement with its subject, value and qualifiers: one scan of the table whose rows are the statements."""
        numbers = {predicate(t.p.iri)[1] for t in triples if predicate(t.p.iri)[0] in ("statement", "value")}
        found = []
        for v in self.schema:
            owned = {v.property} if isinstance(v, Links) else set(v.properties)
            for number in sorted(numbers or owned):
                if number not in owned or len(numbers) > 1:
                    continue
                qualifiers = v.qualifiers if isinstance(v, Links) else {}
                value = v.value if isinstance(v, Links) else v.properties[number]
                bound: list[tuple[object, Column_ | tuple[Column, str]]] = [(st, (self._statement_id(v, number), "stmt"))]
                for t in triples:
                    view, name = predicate(t.p.iri)
                    if view == "statement":
                        bound += [(t.s, self._key(v))] if isinstance(t.s, L.Var) or t.s.kind == "item" else [(t.s, Column_(v.key, "none"))]
                    elif view == "value":
                        bound.append((t.o, value))
                    elif view in ("qualifier", "direct") and name in qualifiers:
                        bound.append((t.o, qualifiers[name]))
                    else:
                        break
                else:
                    found.append(self._scan(v, [*bound, (L.Var(".value"), value)]).keep([n for n in dict.fromkeys(x for t in triples for x in sorted(L.variables((t.s, t.o))))]))
        return reduce(joins.union, found) if found else self._nothing(triples)

    # ---- unbound predicates

    def _facts(self, v: Entities | Links, statements: bool) -> DataFrame:
        """(s, p, o) of a table, as item and two terms, in one pass."""
        prop = lambda n: T.make_term(T.CODE["pstmt" if statements else "prop"], i=F.lit(n))
        pairs = []
        columns = {v.property: v.value} if isinstance(v, Links) else dict(v.properties)
        for number, c in columns.items():
            o = F.when(F.col(c.name).isNotNull(), T.to_term(self._statement_id(v, number), "stmt")) if statements else T.to_term(c.value(), c.kind)
            pairs.append(F.struct(prop(number).alias("p"), o.alias("o")))
        if not statements and isinstance(v, Entities):
            if v.label:
                pairs.append(F.struct(T.make_term(T.CODE["label"], s=F.lit("en")).alias("p"), T.to_term(F.col(v.label), "string").alias("o")))
            if v.defines:
                pairs.append(F.struct(prop(INSTANCE_OF).alias("p"), T.make_term(1, i=F.lit(v.cls)).alias("o")))
        if not pairs:
            return self.spark.createDataFrame([], f"s bigint, p {T.TERM}, o {T.TERM}")
        rows = self._rows(v).select(self._key(v).value().alias("s"), F.explode(F.array(*pairs)).alias("e"))
        return rows.select("s", "e.p", "e.o").where("o is not null")

    def _all(self, subject: object = None, statements: bool = False, possible: set[int] | None = None) -> DataFrame:
        views = [v for v in self.schema if (possible is None or v.cls in possible) and not (isinstance(subject, T.Const) and (subject.kind != "item" or int(subject.value) % BASE != v.cls))]
        frames = []
        for v in views:
            df = self._facts(v, statements)
            frames.append(df.where(F.col("s") == int(subject.value)) if isinstance(subject, T.Const) else df)
        return reduce(DataFrame.unionByName, frames) if frames else self.spark.createDataFrame([], f"s bigint, p {T.TERM}, o {T.TERM}")

    def _wildcard(self, t: L.Triple, possible: set[int] | None = None) -> Rel:
        """Direct facts; statements too if the subject is constant, only they if the object is a statement."""
        to_statement = isinstance(t.o, T.Const) and t.o.kind == "stmt"
        frames = [] if to_statement else [self._all(t.s, possible=possible)]
        if to_statement or isinstance(t.s, T.Const):
            frames.append(self._all(t.s, statements=True, possible=possible))
        df = reduce(DataFrame.unionByName, frames)
        if isinstance(t.o, T.Const):
            number = t.o.kind in T.NUMERIC
            df = df.where((F.col("o.k").isin(21, 22) & (F.col("o.d") == float(t.o.value))) if number else F.col("o") == T.to_term(T.literal(t.o), t.o.kind))
        out: dict[str, tuple[Column, V]] = {}
        for x, name, kind in ((t.s, "s", "item"), (t.p, "p", "term"), (t.o, "o", "term")):
            if not isinstance(x, L.Var):
                continue
            if x.name in out:
                a, v = out[x.name]
                df = df.where(T.to_term(a, v.kind) == T.to_term(F.col(name), kind))
            else:
                out[x.name] = (F.col(name), V(kind))
        return Rel(df, {}).select(out)

    def edges_except(self, iris: tuple[str, ...], subject: T.Const | None = None) -> Rel:
        names = [predicate(i) for i in iris]
        numbers = [n for view, n in names if view == "direct"]
        df = self._all(subject)
        if numbers:
            df = df.where(~((F.col("p.k") == 2) & F.col("p.i").isin(numbers)))
        if ("label", "label") in names:
            df = df.where(F.col("p.k") != T.CODE["label"])
        return Rel(df, {}).select({".s": (F.col("s"), V("item")), ".o": (F.col("o"), V("term"))})

    def nodes(self) -> Rel:
        """Subjects and objects of the entities' facts."""
        df = self._all()
        both = df.select(T.to_term(F.col("s"), "item").alias("n")).unionByName(df.select(F.col("o").alias("n"))).distinct()
        return Rel(both, {}).select({".s": (F.col("n"), V("term"))})

    def labels(self, what: str, languages: list[str], classes: frozenset[int] | None = None) -> Rel:
        frames = [self._rows(v).select(self._key(v).value().alias("s"), F.lit("en").alias("lang"), F.col(v.label).alias("value")) for v in self.schema if isinstance(v, Entities) and v.label and what == "label" and "en" in languages and (classes is None or v.cls in classes)]
        df = reduce(DataFrame.unionByName, frames).where("value is not null") if frames else self.spark.createDataFrame([], "s bigint, lang string, value string")
        return Rel(df, {}).select({".s": (F.col("s"), V("item")), ".lang": (F.col("lang"), V("string")), ".value": (F.col("value"), V("string"))})


class _Lazy(dict):
    """Parquet tables of a folder by name."""

    def __init__(self, spark: SparkSession, folder: str, names: set[str]):
        super().__init__()
        self.spark, self.folder, self.names = spark, folder, names

    def __contains__(self, name: object) -> bool:
        return name in self.names

    def __missing__(self, name: str) -> DataFrame:
        self[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self[name]
