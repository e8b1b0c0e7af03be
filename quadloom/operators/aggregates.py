"""Grouping and the set functions, as one hash aggregation with partial sums."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import terms as T
from ..functions.expressions import E, Scope
from ..plans import algebra as L
from ..plans.relation import Rel, V, column_name


def _orderable(e: E) -> tuple[Column, Callable[[Column], Column], str]:
    """A column that min and max can order, and the way back."""
    if e.kind == "term":
        key = F.struct(F.when(T.is_iri(e.col, "term"), 0).when(e.col["k"].isin(12, 21, 22), 1).when(e.col["k"].isin(13, 14), 2).otherwise(3).alias("g"), F.when(e.col["k"].isin(12, 21, 22), e.col["d"]).alias("d"), F.when(~e.col["k"].isin(12, 21, 22), e.col["i"]).alias("i"), e.col["s"].alias("s"), e.col.alias("t"))
        return F.when(e.col.isNotNull(), key), lambda c: c["t"], "term"
    return e.col, lambda c: c, e.kind


def aggregate(a: L.Aggregate, scope: Scope, visible: list[Column]) -> tuple[Column, V]:
    """The aggregate's column and kind. Unbound values and errors do not take part."""
    if a.name == "COUNT":
        if a.arg is None:
            if not a.distinct or not visible:
                return F.count(F.lit(1)), V("int")
            return F.count_distinct(F.struct(*visible)), V("int")
        col = scope.compile(a.arg).col
        return (F.count_distinct(col) if a.distinct else F.count(col)), V("int")
    if a.arg is None:
        raise T.SparqlError(f"{a.name} needs an expression")
    e = scope.compile(a.arg)
    if a.name in ("SUM", "AVG"):
        col = e.col if e.kind == "int" else T.number(e.col, e.kind)
        if a.name == "SUM":
            total = F.sum_distinct(col) if a.distinct else F.sum(col)
            return F.coalesce(total, F.lit(0).cast("bigint" if e.kind == "int" else "double")), V("int" if e.kind == "int" else "num")
        return F.call_function("avg", col) if not a.distinct else F.sum_distinct(col) / F.nullif(F.count_distinct(col), F.lit(0)), V("num", True)
    if a.name in ("MIN", "MAX", "SAMPLE"):
        col, back, kind = _orderable(e)
        return back(F.max(col) if a.name == "MAX" else F.min(col)), V(kind, True)
    if a.name == "GROUP_CONCAT":
        text = T.lexical(e.col, e.kind)
        items = F.array_sort(F.collect_set(text) if a.distinct else F.collect_list(text))
        return F.array_join(items, a.separator), V("string")
    raise T.SparqlError(f"unsupported aggregate {a.name}")


def group(child: Rel, node: L.Group, scope: Scope) -> Rel:
    """GROUP BY; without keys exactly one row."""
    keys, kinds = [], {}
    for name, expression in node.keys:
        e = scope.compile(expression)
        keys.append(e.col.alias(column_name(name)))
        inner = child.vars.get(expression.name) if isinstance(expression, L.Var) else None
        kinds[name] = V(e.kind, inner.nullable if inner else True)
    visible = [child.col(n) for n in child.vars if not n.startswith(".")]
    columns = []
    for name, a in node.aggregates:
        col, v = aggregate(a, scope, visible)
        columns.append(col.alias(column_name(name)))
        kinds[name] = v
    if not keys:
        return Rel(child.df.agg(*(columns or [F.count(F.lit(1)).alias("n")])).select(*(F.col(f"`{column_name(n)}`") for n in kinds)), kinds)
    df = child.df.groupBy(*keys).agg(*columns) if columns else child.df.select(*keys).distinct()
    return Rel(df, kinds)
