"""Sharding by a hierarchical weighted hash tree.

A document descends region, rack and shard. At each level every child draws
``-ln(u) / weight`` from a hash of (key, path of the child) and the smallest
draw wins (weighted rendezvous). A child's draw depends on its own path and
weight only: when a weight changes, a document moves only if the changed child
wins or loses it, and movement between shards of one rack, or racks of one
region, stays inside that subtree. An inner node weighs as much as its leaves.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: region -> rack -> shard -> weight
Tree = Mapping[str, Mapping[str, Mapping[str, float]]]

DEFAULT_TREE: Tree = {
    region: {f"rack{r}": {f"shard{s}": 1.0 + (s == 0) * (r % 2) for s in range(4)} for r in range(racks)}
    for region, racks in (("east", 3), ("north", 2), ("west", 2))
}


def _weight(node: Mapping | float) -> float:
    return sum(map(_weight, node.values())) if isinstance(node, Mapping) else float(node)


def _draw(key: Column, path: Column, weight: float) -> Column:
    """-ln(u) / weight with u in (0, 1) from 52 bits of an MD5 digest."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit("|"), path)), 1, 13), 16, 10).cast("double")
    return -F.log((bits + F.lit(0.5)) / F.lit(float(1 << 52))) / F.lit(weight)


def _choose(key: Column, prefix: str, children: Mapping[str, float]) -> Column:
    """The child with the smallest draw; ties go to the first name."""
    names = sorted(n for n, w in children.items() if w > 0)
    if not names:
        raise ValueError(f"no child of {prefix or 'the root'} has a weight above 0")
    if len(names) == 1:
        return F.lit(names[0])
    return F.array_min(F.array(*(F.struct(_draw(key, F.lit(f"{prefix}/{n}"), children[n]).alias("d"), F.lit(n).alias("n")) for n in names)))["n"]


def assign(df: DataFrame, key_col: str = "doc_id", tree: Tree = DEFAULT_TREE, names: tuple[str, str, str] = ("region", "rack", "shard")) -> DataFrame:
    """df with the three address columns, computed in the scan's own stage.

    The key's text form decides, so equal keys share a shard. A null key is
    placed as the empty text. Columns of df that bear the new names are
    replaced. An empty table gives an empty table with the three columns.
    """
    key = F.coalesce(df[key_col].cast("string"), F.lit(""))
    out = df.withColumn(names[0], _choose(key, "", {r: _weight(t) for r, t in tree.items()}))

    def per(parent: Column, table: Mapping[str, Column]) -> Column:
        column = F.lit(None).cast("string")
        for name in sorted(table):
            column = F.when(parent == name, table[name]).otherwise(column)
        return column

    key = F.coalesce(out[key_col].cast("string"), F.lit("")) if key_col not in names else key
    live = {r: {k: s for k, s in racks.items() if _weight(s) > 0} for r, racks in tree.items() if _weight(racks) > 0}
    out = out.withColumn(names[1], per(F.col(names[0]), {r: _choose(key, f"/{r}", {k: _weight(s) for k, s in racks.items()}) for r, racks in live.items()}))
    both = F.concat(F.col(names[0]), F.lit("/"), F.col(names[1]))
    return out.withColumn(names[2], per(both, {f"{r}/{k}": _choose(key, f"/{r}/{k}", s) for r, racks in live.items() for k, s in racks.items()}))


def oracle(table: str = "documents", key_col: str = "doc_id", tree: Tree = DEFAULT_TREE) -> str:
    """DuckDB SQL for the key and its address."""

    def rows(level: int) -> str:
        out = []
        for r, racks in tree.items():
            if level == 0:
                out.append(("", r, f"/{r}", _weight(racks)))
            for k, shards in racks.items():
                if level == 1:
                    out.append((f"/{r}", k, f"/{r}/{k}", _weight(shards)))
                if level == 2:
                    out += [(f"/{r}/{k}", s, f"/{r}/{k}/{s}", float(w)) for s, w in shards.items()]
        return ", ".join(f"('{p}', '{n}', '{path}', {w!r}::DOUBLE)" for p, n, path, w in out if w > 0)

    draw = "-ln((('0x' || substr(md5(k.s || '|' || c.path), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) / c.weight"
    step = lambda source, parent: f"SELECT k.key, k.s, min_by(c.name, {draw}) AS name, min_by(c.path, {draw}) AS path FROM {source} k JOIN c{parent} c ON c.parent = k.path GROUP BY k.key, k.s, k.path"
    return f"""
WITH c0(parent, name, path, weight) AS (VALUES {rows(0)}),
c1(parent, name, path, weight) AS (VALUES {rows(1)}),
c2(parent, name, path, weight) AS (VALUES {rows(2)}),
keys AS (SELECT DISTINCT {key_col} AS key, coalesce({key_col}::VARCHAR, '') AS s, '' AS path FROM {table}),
l0 AS ({step('keys', 0)}), l1 AS ({step('l0', 1)}), l2 AS ({step('l1', 2)})
SELECT d.{key_col}, l0.name AS region, l1.name AS rack, l2.name AS shard
FROM {table} d JOIN l0 ON l0.s = coalesce(d.{key_col}::VARCHAR, '') JOIN l1 ON l1.s = l0.s JOIN l2 ON l2.s = l0.s
"""
