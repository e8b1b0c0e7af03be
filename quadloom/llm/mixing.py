"""Mixing sources to target weights by Pfair scheduling.

A source's documents, in id order, are cut into blocks. With target weight w (its exact
share of all slots), block j = 1, 2, ... of a source is released at slot floor((j - 1) / w)
and due by slot ceil(j / w); in each slot the released block with the earliest deadline
goes next. As the weights add up to 1, no deadline is missed, and after any t slots a
source has more than w t - 1 and less than w t + 1 blocks. Once a source has run out,
the weights of the others are scaled up to 1 and their windows count from there, so
that no slot stays empty. Nothing is dropped and nothing repeated.

Weights are exact fractions, nothing is rounded. The schedule is worked out on the driver, so
its size must not grow with the data: a block is a fixed share of the corpus, and there
are at most ``BLOCKS`` and one for each source, whatever the number of documents.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping
from fractions import Fraction
from math import lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrowtext import session_checkpoint

BLOCKS = 1 << 16
#: Slots of sources without a weight begin here.
LATE = 1 << 60


def schedule(weights: Mapping[str, float], blocks: Mapping[str, int]) -> list[tuple[str, int, int, int, int]]:
    """(source, block, release, deadline, slot) of all blocks of the sources with a weight, by slot."""
    left = {s: n for s, n in blocks.items() if n > 0 and weights.get(s, 0) > 0}
    exact = {s: Fraction(weights[s]) for s in left}
    common = lcm(*(w.denominator for w in exact.values())) if exact else 1
    parts = {s: int(w * common) for s, w in exact.items()}
    done = dict.fromkeys(left, 0)
    out: list[tuple[str, int, int, int, int]] = []
    while left:
        start, whole = len(out), sum(parts[s] for s in left)
        begun = dict(done)
        waiting = [(0, s) for s in sorted(left)]
        ready: list[tuple[int, str, int]] = []  # deadline, source, release
        for t in range(sum(left.values())):
            while waiting and waiting[0][0] <= t:
                release, s = heapq.heappop(waiting)
                heapq.heappush(ready, (-(-(done[s] - begun[s] + 1) * whole // parts[s]), s, release))
            deadline, s, release = heapq.heappop(ready)
            out.append((s, done[s], start + release, start + deadline, start + t))
            done[s] += 1
            left[s] -= 1
            if not left[s]:
                del left[s]
                break
            heapq.heappush(waiting, ((done[s] - begun[s]) * whole // parts[s], s))
    return out


def ranked(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """(doc_id, source, rank from 0 within the source by id), without a window over a whole source.

    Rows are range partitioned by (source, id) and numbered within their
    partition; the counts of the partitions give each its offset.
    """
    ids = docs.select(F.coalesce(docs[source_col].cast("string"), F.lit("")).alias("source"), docs[id_col].cast("bigint").alias("doc_id"))
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    local = ids.repartitionByRange(parts, "source", "doc_id").sortWithinPartitions("source", "doc_id")
    # The id's high bits are the partition, the low 33 bits the row's place in it.
    local = session_checkpoint(local.withColumn("at", F.monotonically_increasing_id()))
    local = local.withColumn("part", F.shiftright("at", 33))
    counts = local.groupBy("source", "part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(Window.partitionBy("source").orderBy("part")) - F.col("n")
    return local.join(counts.select("source", "part", (before - F.col("first")).alias("shift")), ["source", "part"]).select("doc_id", "source", (F.col("at") + F.col("shift")).alias("rank"))


def default_weights(counts: Mapping[str, int]) -> dict[str, int]:
    """Square roots of the sources' document counts, in units of 1/1024: large sources lead, small ones are not drowned."""
    return {s: int(1024 * n**0.5) for s, n in counts.items()}


def _plan(docs: DataFrame, weights: Mapping[str, float] | None, id_col: str, source_col: str, blocks: int) -> tuple[DataFrame, DataFrame]:
    """The ranked rows with their block, and the schedule; both from counts over the whole table."""
    spark = docs.sparkSession
    r = ranked(docs, id_col, source_col)
    counts = {x["source"]: x["count"] for x in docs.groupBy(F.coalesce(docs[source_col].cast("string"), F.lit("")).alias("source")).count().collect()}
    size = max(1, -(-sum(counts.values()) // blocks))
    plan = schedule(default_weights(counts) if weights is None else weights, {s: -(-n // size) for s, n in counts.items()})
    names = ("source", "block", "release", "deadline", "slot")
    columns = list(zip(*plan, strict=True)) or [()] * 5
    table = spark.createDataFrame(pa.table({n: pa.array(c, pa.string() if n == "source" else pa.int64()) for n, c in zip(names, columns, strict=True)}))
    return r.withColumn("block", F.expr(f"rank div {size}L")).withColumn("position", F.expr(f"cast(rank % {size}L as int)")), table


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, id_col: str = "doc_id", source_col: str = "source", blocks: int = BLOCKS) -> DataFrame:
    """doc_id, source, block, release, deadline, slot, position for each row of docs.

    block counts from 0 within the source; release, deadline and slot are in
    slots of the whole schedule; (slot, position) is the place of the row in
    the mix. A null source counts as ''. Sources without a target weight, or
    with weight 0, follow after all others, one block each in turn. Rows that
    share an id each have a place; null ids come first in their source.
    An empty table gives an empty result.
    """
    r, plan = _plan(docs, weights, id_col, source_col, blocks)
    r = r.join(F.broadcast(plan), ["source", "block"], "left")  # at most blocks rows and one for each source
    place = lambda name: F.coalesce(name, F.lit(LATE) + F.col("block")).alias(name)
    return r.select("doc_id", "source", "block", place("release"), place("deadline"), place("slot"), "position")


def placed(docs: DataFrame, weights: Mapping[str, float] | None = None, id_col: str = "doc_id", source_col: str = "source", blocks: int = BLOCKS) -> DataFrame:
    """docs, all rows, with the column slot (replaced if docs has one), without a shuffle of the texts; (slot, source, id) is the mix.

    Each block's last id and slot are sent to all tasks, which look up a row's id
    among them; rows that share (id, source) take the first of their blocks.
    """
    r, plan = _plan(docs, weights, id_col, source_col, blocks)
    least = -(1 << 63)  # null ids come first
    ends = r.groupBy("source", "block").agg(F.coalesce(F.max("doc_id"), F.lit(least)).alias("last"))
    ends = ends.join(F.broadcast(plan), ["source", "block"], "left").select("source", "last", F.coalesce("slot", F.lit(LATE) + F.col("block")).alias("slot"))
    table = ends.sort("source", "last", "slot").toArrow()
    names = np.asarray(table.column("source").to_pylist(), object)
    last, slot = (table.column(c).to_numpy() for c in ("last", "slot"))
    cuts = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1]))) if len(names) else np.zeros(0, int)
    held = docs.sparkSession.sparkContext.broadcast({names[a]: (last[a:b], slot[a:b]) for a, b in zip(cuts, [*cuts[1:], len(names)][: len(cuts)], strict=True)})
    own = [c for c in docs.columns if c != "slot"]

    def run(batches):
        for batch in batches:
            ids = batch.column(len(own)).fill_null(least).to_numpy()
            source = np.asarray(batch.column(len(own) + 1).to_pylist(), object)
            out = np.zeros(batch.num_rows, np.int64)
            for name in set(source.tolist()):
                rows = np.flatnonzero(source == name)
                last, slot = held.value[name]
                out[rows] = slot[np.searchsorted(last, ids[rows])]
            yield pa.record_batch([*batch.columns[: len(own)], pa.array(out)], names=[*own, "slot"])

    schema = docs.select(*(f"`{c}`" for c in own), F.lit(0).cast("bigint").alias("slot")).schema
    keyed = docs.select(*(docs[f"`{c}`"] for c in own), docs[id_col].cast("bigint").alias("__ql_id"), F.coalesce(docs[source_col].cast("string"), F.lit("")).alias("__ql_source"))
    return keyed.mapInArrow(run, schema)


def reorder(docs: DataFrame, weights: Mapping[str, float] | None = None, id_col: str = "doc_id", source_col: str = "source", blocks: int = BLOCKS) -> DataFrame:
    """docs, all columns and rows, sorted into the mix; the sort is the one shuffle of the texts."""
    names = docs.columns
    inner = [f"c{k}" for k in range(len(names))]  # no name can clash with slot
    out = placed(docs.toDF(*inner), weights, inner[names.index(id_col)], inner[names.index(source_col)], blocks)
    return out.orderBy("slot", inner[names.index(source_col)], inner[names.index(id_col)]).select(*inner).toDF(*names)


def oracle(table: str = "documents", blocks: int = BLOCKS) -> str:
    """DuckDB SQL for mix() with default weights: a recursion over the slots."""
    return f"""
WITH RECURSIVE c AS (SELECT coalesce(source, '') AS source, count(*) AS n FROM {table} GROUP BY 1),
z AS (SELECT greatest(1, (sum(n) + {blocks} - 1) // {blocks})::BIGINT AS size FROM c),
k AS (SELECT list(source ORDER BY source) AS names, list(floor(1024 * sqrt(n))::BIGINT ORDER BY source) AS p, list(((n + size - 1) // size)::BIGINT ORDER BY source) AS b FROM c, z),
r AS (
  SELECT 0::BIGINT AS t, 0::BIGINT AS start, [0::BIGINT for x in b] AS begun, [0::BIGINT for x in b] AS done, 0::BIGINT AS pick, 0::BIGINT AS release, 0::BIGINT AS deadline FROM k
  UNION ALL
  SELECT t + 1, CASE WHEN done[pick] + 1 = b[pick] THEN t + 1 ELSE start END, CASE WHEN done[pick] + 1 = b[pick] THEN new ELSE begun END, new, pick,
    start + (done[pick] - begun[pick]) * whole // p[pick], start + ((done[pick] - begun[pick] + 1) * whole + p[pick] - 1) // p[pick]
  FROM (SELECT *, [done[i] + (i = pick)::BIGINT for i in range(1, len(p) + 1)] AS new FROM (
    SELECT *, list_min([((done[i] - begun[i] + 1) * whole + p[i] - 1) // p[i] * 65536 + i for i in range(1, len(p) + 1) if done[i] < b[i] and (done[i] - begun[i]) * whole // p[i] <= t - start]) % 65536 AS pick
    FROM (SELECT r.* EXCLUDE (pick, release, deadline), p, b, list_sum([p[i] for i in range(1, len(p) + 1) if done[i] < b[i]])::BIGINT AS whole FROM r, k) WHERE list_sum(done) < list_sum(b)))),
s AS (SELECT names[pick] AS source, done[pick] - 1 AS block, release, deadline, t - 1 AS slot FROM r, k WHERE t > 0),
d AS (SELECT doc_id, coalesce(source, '') AS source, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY doc_id NULLS FIRST) - 1 AS rank, size FROM {table}, z)
SELECT doc_id, source, block::BIGINT AS block, release::BIGINT AS release, deadline::BIGINT AS deadline, slot::BIGINT AS slot, (rank % size)::INTEGER AS position FROM d JOIN s USING (source) WHERE s.block = d.rank // d.size
"""
