"""Property paths: alternatives, negated sets, optional steps and closures.

A path is evaluated to pairs (s, o) of one kind. Closures are semi-naive: each
round joins the pairs found last with the edges, drops those known, and cuts
the lineage, until no new pair comes. With a bound end only that end's
reachable set is followed. Rounds grow with the longest path, not with the data.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import terms as T
from ..plans import algebra as L
from ..plans.relation import Rel, V, column_name, empty, spark_type
from ..storage import cut_lineage
from . import joins

S, O = ".s", ".o"


def swap(rel: Rel) -> Rel:
    return rel.select({S: (rel.col(O), rel.vars[O]), O: (rel.col(S), rel.vars[S])})


def _same_kinds(rel: Rel) -> Rel:
    if rel.vars[S].kind != rel.vars[O].kind:
        rel = rel.with_kind(S, "term").with_kind(O, "term")
    return rel


def _pairs(rel: Rel) -> DataFrame:
    return rel.df.select(rel.col(S).alias("s"), rel.col(O).alias("o"))


def _rel(df: DataFrame, kind: str) -> Rel:
    return Rel(df.select(F.col("s").alias(column_name(S)), F.col("o").alias(column_name(O))), {S: V(kind), O: V(kind)})


def _grow(edges: DataFrame, start: DataFrame) -> DataFrame:
    """All (s, o) with a path of one step or more from a start pair's o along edges, start pairs included.

    Each round writes only the pairs that it found; what is known is the union of the rounds.
    """
    step = edges.select(F.col("s").alias("via"), F.col("o").alias("to"))
    rounds = [cut_lineage(start.distinct())]
    while not rounds[-1].isEmpty():
        last = rounds[-1]
        new = last.join(step, last["o"] == step["via"]).select("s", F.col("to").alias("o")).distinct()
        rounds.append(cut_lineage(new.join(reduce(DataFrame.unionByName, rounds), ["s", "o"], "left_anti")))
    return reduce(DataFrame.unionByName, rounds)


def closure(source, path: L.Repeat, start: T.Const | None = None, end: T.Const | None = None, seeds: Rel | None = None) -> Rel:
    """path* and path+, from a constant start or to a constant end if one is given, or from the values .s of seeds."""
    if start is None and end is not None:
        return swap(closure(source, L.Repeat(L.Inverse(path.path), path.low, path.many), end, None))
    rel = _same_kinds(evaluate(source, path.path))
    if seeds is not None:
        if seeds.vars[S].kind != rel.vars[S].kind:
            seeds, rel = seeds.with_kind(S, "term"), rel.with_kind(S, "term").with_kind(O, "term")
        begin = seeds.df.select(seeds.col(S).alias("s")).where("s is not null").distinct()
    kind = rel.vars[S].kind
    spark = rel.df.sparkSession
    edges = cut_lineage(_pairs(rel).distinct())
    one = edges
    if start is not None:
        value = T.to_term(T.literal(start), start.kind) if kind == "term" else T.literal(start)
        if kind != "term" and start.kind != kind:
            edges, one = edges.limit(0), edges.limit(0)
        else:
            one = edges.where(F.col("s") == value)
    if seeds is not None:
        begin = cut_lineage(begin)
        one = edges.join(begin, "s", "left_semi")
    found = _grow(edges, one)
    if path.low == 0:
        if start is not None:
            # The zero-length path holds for any constant, in the graph or not.
            if kind != "term" and start.kind != kind:
                kind = start.kind
                found = spark.createDataFrame([], f"s {spark_type(kind)}, o {spark_type(kind)}")
            value = T.to_term(T.literal(start), start.kind) if kind == "term" else T.literal(start)
            zero = spark.range(1).select(value.alias("s"), value.alias("o"))
        elif seeds is not None:
            zero = begin.select("s", F.col("s").alias("o"))
        else:
            nodes = source.nodes()
            if nodes.vars[S].kind != kind:
                nodes, found = nodes.with_kind(S, "term"), found.select(T.to_term(F.col("s"), kind).alias("s"), T.to_term(F.col("o"), kind).alias("o"))
                kind = "term"
            zero = nodes.df.select(nodes.col(S).alias("s"), nodes.col(S).alias("o"))
        found = found.unionByName(zero).distinct()
    return _rel(found, kind)


def evaluate(source, path: object, start: T.Const | None = None, end: T.Const | None = None) -> Rel:
    """The pairs of a path, as variables .s and .o."""
    if isinstance(path, L.Link):
        return source.edges(path.iri)
    if isinstance(path, L.Inverse):
        return swap(evaluate(source, path.path, end, start))
    if isinstance(path, L.Seq):
        a, b = evaluate(source, path.left, start), evaluate(source, path.right, None, end)
        m = ".via"
        a = a.select({S: (a.col(S), a.vars[S]), m: (a.col(O), a.vars[O])})
        b = b.select({m: (b.col(S), b.vars[S]), O: (b.col(O), b.vars[O])})
        return joins.join(a, b).keep([S, O])
    if isinstance(path, L.Alt):
        return joins.union(evaluate(source, path.left, start, end), evaluate(source, path.right, start, end))
    if isinstance(path, L.Negated):
        parts = []
        if path.forward or not path.backward:
            parts.append(source.edges_except(path.forward, start))
        if path.backward:
            parts.append(swap(source.edges_except(path.backward, end)))
        return parts[0] if len(parts) == 1 else joins.union(*parts)
    if isinstance(path, L.Repeat):
        if path.many:
            return closure(source, path, start, end)
        return _optional(source, path, start, end)
    raise T.SparqlError(f"unsupported path {path!r}")


def _optional(source, path: L.Repeat, start: T.Const | None, end: T.Const | None) -> Rel:
    """path?: the path, or nothing."""
    one = evaluate(source, path.path, start, end)
    spark = one.df.sparkSession
    at = start or end
    if at is not None:
        zero = empty(spark, {})
        lit: Column = T.literal(at)
        zero = Rel(spark.range(1).select(lit.alias(column_name(S)), lit.alias(column_name(O))), {S: V(at.kind), O: V(at.kind)})
    else:
        nodes = source.nodes()
        zero = nodes.select({S: (nodes.col(S), nodes.vars[S]), O: (nodes.col(S), nodes.vars[S])})
    both = joins.union(one, zero)
    return Rel(both.df.distinct(), both.vars)
