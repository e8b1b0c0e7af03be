"""Joins and set operations over solutions.

Shared variables that can't be unbound are plain equalities, which Catalyst
turns into hash or merge joins. Where a shared variable may be unbound on a side, an
unbound value is compatible with anything: rows are joined in one pass per
pattern of unbound variables, each of them an equality join on the variables
bound in it, so that no nested loop is needed.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.relation import Rel, V, column_name, empty, spark_type
from ..terms import to_term

_RIGHT = "r@"
#: Rows of a side of one value that a block of a spread join has, about.
BLOCK = 2000


def _aligned(left: Rel, right: Rel) -> tuple[Rel, Rel, list[str], bool]:
    """Both sides with shared variables of equal kinds; whether some kinds can never meet."""
    shared = [n for n in left.vars if n in right.vars]
    disjoint = False
    for n in shared:
        a, b = left.vars[n], right.vars[n]
        if a.kind != b.kind:
            disjoint |= "term" not in (a.kind, b.kind) and not a.nullable and not b.nullable
            left, right = left.with_kind(n, "term"), right.with_kind(n, "term")
    return left, right, shared, disjoint


def _renamed(right: Rel, names: list[str]) -> DataFrame:
    """The right side with its shared columns under other names."""
    return right.df.select(*(F.col(f"`{c}`").alias((_RIGHT + c) if c in {column_name(n) for n in names} else c) for c in right.df.columns))


def _r(name: str) -> Column:
    return F.col(f"`{_RIGHT}{column_name(name)}`")


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def join(left: Rel, right: Rel) -> Rel:
    """Natural inner join; a cross join without shared variables."""
    left, right, shared, disjoint = _aligned(left, right)
    loose = [n for n in shared if left.vars[n].nullable or right.vars[n].nullable]
    out = {n: (V(v.kind, v.nullable and right.vars[n].nullable, v.classes) if n in shared else v) for n, v in left.vars.items()} | {n: v for n, v in right.vars.items() if n not in shared}
    if disjoint:
        return empty(left.df.sparkSession, out)
    if not shared:
        return Rel(left.df.crossJoin(right.df), out)
    firm = [n for n in shared if n not in loose]
    if not loose:
        return Rel(_spread(left, right, shared) if many_to_many(left, right) else left.df.join(right.df, [column_name(n) for n in shared]), out)
    parts = []
    for l_bound, l_part in _split(left, loose):
        for r_bound, r_part in _split(right, loose):
            both = [n for n in shared if n in firm or (n in l_bound and n in r_bound)]
            other = _renamed(Rel(r_part, right.vars), shared)
            joined = l_part.join(other, _equal(left, both)) if both else l_part.crossJoin(other)
            columns = [(F.coalesce(left.col(n), _r(n)) if n in loose else left.col(n)).alias(column_name(n)) for n in left.vars]
            parts.append(joined.select(*columns, *(right.col(n) for n in right.vars if n not in shared)))
    return Rel(reduce(DataFrame.unionByName, parts), out)


def many_to_many(left: Rel, right: Rel) -> bool:
    """Whether values of all shared variables are known to repeat on both sides."""
    shared = [n for n in left.vars if n in right.vars]
    return bool(shared) and all(left.vars[n].repeats and right.vars[n].repeats for n in shared)


def _spread(left: Rel, right: Rel, shared: list[str]) -> DataFrame:
    """An inner join in which the pairs of a frequent value are no task's burden.

    A value with more than BLOCK * BLOCK pairs is cut into blocks of about BLOCK rows of each side; each row goes to all blocks
    of its row or column. There are at most (rows of both sides) / BLOCK such values, so their table is broadcast. The number of
    partitions is given, as the pairs and not the bytes read are the work, by which Spark would put partitions together.
    """
    names = [column_name(n) for n in shared]
    counts = [rel.df.groupBy(*(F.col(f"`{c}`") for c in names)).agg(F.count(F.lit(1)).alias(n)) for rel, n in ((left, "n@l"), (right, "n@r"))]
    pieces = lambda n: F.ceil(F.col(f"`{n}`") / BLOCK).cast("int")
    frequent = counts[0].join(counts[1], names).where(F.col("`n@l`") * F.col("`n@r`") > BLOCK * BLOCK).select(*(F.col(f"`{c}`") for c in names), pieces("n@l").alias("b@l"), pieces("n@r").alias("b@r"))
    keys = [*names, "at@l", "at@r"]

    def placed(df: DataFrame, own: str, other: str) -> DataFrame:
        columns = [F.col(f"`{c}`") for c in df.columns]
        number = lambda side: F.coalesce(F.col(f"`b@{side}`"), F.lit(1))
        rows = df.join(F.broadcast(frequent), names, "left").select(*columns, F.pmod(F.xxhash64(*columns), number(own)).cast("int").alias(f"at@{own}"), F.explode(F.sequence(F.lit(0), number(other) - 1)).alias(f"at@{other}"))
        return rows.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *(F.col(f"`{c}`") for c in keys))

    return placed(left.df, "l", "r").join(placed(right.df, "r", "l"), keys).drop("at@l", "at@r")


def join_all(rels: list[Rel]) -> Rel:
    """Natural join of several solutions: those that multiply no rows first, cross joins last. Variables stay in order."""
    names = list(dict.fromkeys(n for r in rels for n in r.vars))
    shared = {n for n in names if sum(n in r.vars for r in rels) > 1}
    out, *rest = rels
    if any(r.vars[n].nullable for r in rels for n in shared & set(r.vars)):
        return reduce(join, rest, out)
    while rest:
        order = [(2 if not set(r.vars) & set(out.vars) else many_to_many(out, r), k) for k, r in enumerate(rest)]
        out = join(out, rest.pop(min(order)[1]))
    return out.keep(names)


def _split(rel: Rel, loose: list[str]) -> list[tuple[set[str], DataFrame]]:
    """The parts of a side by which of the loose variables are bound."""
    free = [n for n in loose if rel.vars[n].nullable]
    out = []
    for bits in product((True, False), repeat=len(free)):
        unbound = {n for n, b in zip(free, bits, strict=True) if not b}
        tests = [rel.col(n).isNull() if n in unbound else rel.col(n).isNotNull() for n in free]
        out.append(({n for n in loose if n not in unbound}, rel.df.where(_all(tests)) if tests else rel.df))
    return out


def _equal(left: Rel, names: list[str]) -> Column:
    return _all([left.col(n) == _r(n) for n in names])


def left_join(left: Rel, right: Rel, condition=None) -> Rel:
    """OPTIONAL: condition(lookup) gives the filter as a column over both sides, it is part of the join.

    Where a shared variable may be unbound, each pattern of unbound variables has a join of its own, as in join().
    """
    left, right, shared, disjoint = _aligned(left, right)
    loose = [n for n in shared if left.vars[n].nullable or right.vars[n].nullable]
    # A variable that is unbound on the left may stay unbound, as not every row has a partner.
    merged = dict(left.vars) | {n: V(v.kind, True) for n, v in right.vars.items() if n not in shared}
    test = None
    if condition is not None:
        both = {n: ((F.coalesce(left.col(n), _r(n)) if left.vars[n].nullable else left.col(n)) if n in left.vars and n in shared else (left.col(n) if n in left.vars else right.col(n)), merged[n].kind) for n in merged}
        test = F.coalesce(condition(both), F.lit(False))
    columns = [(F.coalesce(left.col(n), _r(n)) if n in shared and left.vars[n].nullable else left.col(n)).alias(column_name(n)) for n in left.vars]
    columns += [right.col(n) for n in right.vars if n not in shared]
    rights = [(set(loose), right.df.where("false"))] if disjoint else _split(right, loose)
    parts = []
    for l_bound, l_part in _split(left, loose):
        rest = l_part
        for k, (r_bound, r_part) in enumerate(rights):
            on = _equal(left, [n for n in shared if n not in loose or (n in l_bound and n in r_bound)])
            on = on if test is None else on & test
            other = _renamed(Rel(r_part, right.vars), shared)
            if k < len(rights) - 1:
                parts.append(l_part.join(other, on, "inner").select(*columns))
                rest = rest.join(other, on, "left_anti")
            elif k == 0:
                parts.append(l_part.join(other, on, "left").select(*columns))
            else:
                # Rows that have met a partner already don't count as unmatched here.
                parts.append(l_part.join(other, on, "inner").select(*columns))
                rest = rest.join(other, on, "left_anti")
                missing = [(left.col(n) if n in left.vars else F.lit(None).cast(spark_type(right.vars[n].kind))).alias(column_name(n)) for n in merged]
                parts.append(rest.select(*missing))
    return Rel(reduce(DataFrame.unionByName, parts), merged)


def semi_join(left: Rel, right: Rel, negated: bool = False, condition=None, some_bound: bool = False) -> Rel:
    """EXISTS and NOT EXISTS as a filter: rows of left with (without) a compatible row in right; some_bound: one that shares a bound variable."""
    kinds = dict(left.vars)
    aligned, right, shared, disjoint = _aligned(left, right)
    test = None
    # The test uses terms where the kinds differ, the result keeps native columns.
    key = {n: "k@" + column_name(n) for n in shared if kinds[n].kind != aligned.vars[n].kind}
    plain = [F.col(f"`{c}`") for c in left.df.columns]
    wide = left.df.select(*plain, *(to_term(left.col(n), kinds[n].kind).alias(c) for n, c in key.items())) if key else left.df
    col = lambda n: F.col(f"`{key[n]}`") if n in key else left.col(n)
    if condition is not None:
        both = {n: (col(n), aligned.vars[n].kind) for n in aligned.vars} | {n: (right.col(n), right.vars[n].kind) for n in right.vars if n not in shared}
        test = F.coalesce(condition(both), F.lit(False))
    else:
        right = right.keep(shared)
    if disjoint:
        return Rel(left.df if negated else left.df.where("false"), kinds)
    loose = [n for n in shared if kinds[n].nullable or right.vars[n].nullable]
    parts = []
    for l_bound, l_part in _split(Rel(wide, kinds), loose):
        rest = l_part
        for r_bound, r_part in _split(right, loose):
            same = [n for n in shared if n not in loose or (n in l_bound and n in r_bound)]
            if some_bound and not same:
                continue
            on = _all([col(n) == _r(n) for n in same])
            on = on if test is None else on & test
            other = _renamed(Rel(r_part, right.vars), shared)
            if not same and test is None:
                other = other.limit(1)  # any row will do
            if not negated:
                parts.append(rest.join(other, on, "left_semi"))
            rest = rest.join(other, on, "left_anti")
        if negated:
            parts.append(rest)
    return Rel(reduce(DataFrame.unionByName, parts).select(*plain), kinds) if parts else Rel(left.df.where("false"), kinds)


def minus(left: Rel, right: Rel) -> Rel:
    """MINUS: no effect without shared variables; rows that share no bound variable do not count as compatible."""
    shared = [n for n in left.vars if n in right.vars]
    if not shared:
        return left
    return semi_join(left, right.keep(shared), negated=True, some_bound=True)


def union(left: Rel, right: Rel) -> Rel:
    """Bag union; variables of one side only are unbound in the other."""
    names = list(dict.fromkeys([*left.vars, *right.vars]))
    kinds: dict[str, V] = {}
    for n in names:
        a, b = left.vars.get(n), right.vars.get(n)
        found = {v.kind for v in (a, b) if v} - {"null"}
        kind = "null" if not found else found.pop() if len(found) == 1 else "num" if found == {"int", "num"} else "term"
        known = not a or a.classes is not None, not b or b.classes is not None
        classes = frozenset().union(*(v.classes for v in (a, b) if v)) if all(known) else None
        kinds[n] = V(kind, not a or not b or a.nullable or b.nullable, classes)

    def shape(rel: Rel) -> DataFrame:
        for n in rel.vars:
            if rel.vars[n].kind not in ("null", kinds[n].kind):
                rel = rel.with_kind(n, kinds[n].kind)
        missing = lambda n: n not in rel.vars or rel.vars[n].kind == "null"
        return rel.df.select(*((F.lit(None).cast(spark_type(kinds[n].kind)) if missing(n) else rel.col(n)).alias(column_name(n)) for n in names))

    return Rel(shape(left).unionByName(shape(right)), kinds)
