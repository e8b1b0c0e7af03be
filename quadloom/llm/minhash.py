"""MinHash near-dedup with a multi-index Hamming join.

A text's word 2-grams give a signature of 60 symbols of 16 bits: the low bits of
60 minimum hashes. Two documents are near copies if their signatures differ in
at most ``RADIUS`` = 19 symbols (a Jaccard similarity of about 0.68 or more).
The symbols are split into 10 chunks of 6. By the pigeonhole principle two
signatures within 19 errors have a chunk with at most one, so for each chunk
each of its 6 possible error places is masked in turn and the other 5 symbols
become a key: every pair within the radius shares one of the 60 keys. Pairs
that share a key are verified on the whole signatures, and groups are the
connected components.

Identical signatures are collapsed first. In a bucket of many members the
components come from a search that compares an unvisited member only if the
triangle inequality leaves it in reach, so a bucket of n near copies takes
about n comparisons, not n squared, and no bucket is cut off.
"""

from __future__ import annotations

from hashlib import blake2b
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import arrowtext as A

SHINGLE = 2
CHUNKS, WIDTH = 10, 6
SYMBOLS = CHUNKS * WIDTH
RADIUS = 2 * CHUNKS - 1
#: Of rows that share a key, components that are followed one by one, and what is little enough to go on so.
PIVOTS, SMALL = 16, 256

_FACTORS = (A.mix(np.arange(1, SYMBOLS + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_SALTS = A.mix(np.arange(1001, SYMBOLS + 1001, dtype=np.uint64))


def signatures(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which texts have a word, and the symbols of those: uint16 of shape (texts, SYMBOLS)."""
    words = A.Words(raw, offsets)
    some = np.flatnonzero(words.count)
    if not len(some):
        return some, np.zeros((0, SYMBOLS), np.uint16)
    # One shingle starts at each word that has SHINGLE - 1 after it; a shorter text is one shingle.
    n = len(words.hash)
    end = np.repeat(words.first[1:], words.count)
    at = np.arange(n)
    shingle = np.zeros(n, np.uint64)
    for j in range(SHINGLE):
        there = at + j < end
        shingle = shingle * np.uint64(0x9E3779B97F4A7C15) + np.where(there, words.hash[np.minimum(at + j, n - 1)], 0)
    begin = np.repeat(words.first[:-1], words.count)
    use = (at + SHINGLE <= end) | ((at == begin) & (end - begin < SHINGLE))
    x = (A.mix(shingle[use]) >> np.uint64(32)).astype(np.uint32)
    count = np.maximum(words.count[some] - SHINGLE + 1, 1)
    first = np.concatenate(([0], np.cumsum(count)[:-1]))
    out = np.empty((len(some), SYMBOLS), np.uint16)
    for k in range(SYMBOLS):
        y = x * _FACTORS[k]
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        y ^= y >> np.uint32(13)
        low = np.minimum.reduceat(y, first)
        out[:, k] = (A.mix(low.astype(np.uint64) + _SALTS[k]) & np.uint64(0xFFFF)).astype(np.uint16)
    return some, out


def keys(symbols: np.ndarray) -> np.ndarray:
    """The SYMBOLS keys of each signature: a chunk without one of its symbols."""
    each = A.mix(symbols.astype(np.uint64) + _SALTS[None, :])
    whole = each.reshape(-1, CHUNKS, WIDTH).sum(axis=2, dtype=np.uint64)
    left = np.repeat(whole, WIDTH, axis=1) - each
    return A.mix(left ^ _SALTS[None, ::-1]).view(np.int64)


def _distance(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    return (one != many).sum(axis=-1)


def components(symbols: np.ndarray, radius: int = RADIUS, pivots: int = PIVOTS) -> np.ndarray:
    """For each row the first row of its component under distance <= radius.

    The components of the first rows are followed one after the other, which takes a pass over
    the rows for each. What is left after that many, rows that are near to few others,
    is divided by the keys of further chunks.
    """
    n = len(symbols)
    label = np.full(n, -1)
    done = 0
    for pivot in range(n):
        if label[pivot] >= 0:
            continue
        rest = np.flatnonzero(label < 0)
        if done == pivots and len(rest) > SMALL:
            label[rest] = rest[_by_further_chunks(symbols[rest], radius)]
            break
        done += 1
        label[pivot] = pivot
        rest = rest[1:]
        if not len(rest):
            break
        far = _distance(symbols[pivot], symbols[rest])
        queue = [(pivot, 0)]
        while queue and len(rest):
            x, d = queue.pop()
            reach = np.flatnonzero(np.abs(far - d) <= radius)
            if not len(reach):
                continue
            near = reach if x == pivot else reach[_distance(symbols[x], symbols[rest[reach]]) <= radius]
            if len(near):
                queue += zip(rest[near].tolist(), far[near].tolist(), strict=True)
                label[rest[near]] = pivot
                left = np.ones(len(rest), bool)
                left[near] = False
                rest, far = rest[left], far[left]
    return label


def _by_further_chunks(symbols: np.ndarray, radius: int) -> np.ndarray:
    """components() for rows of which most are near to few others.

    Chunks on which many rows agree but for one symbol tell little apart. Of the others, with at most
    radius errors in all, one has at most m, where m is the smallest number with (m + 1) chunks > radius: rows
    in the radius share a key of that chunk without m of its symbols. Where too few chunks are left, or where the keys
    divide so little that they would take more comparisons than all pairs, the rows are followed one after the other.
    """
    n = len(symbols)
    whole = np.arange(n)
    common = np.array([np.bincount(symbols[:, k]).max() for k in range(SYMBOLS)]) * 4 > n
    left = np.flatnonzero(common.reshape(CHUNKS, WIDTH).sum(axis=1) < WIDTH - 1)
    masked = next((m for m in range(WIDTH - 1) if len(left) * (m + 1) > radius), None)
    if masked is None:
        return components(symbols, radius, n)
    spent = 0
    each = A.mix(symbols.astype(np.uint64) + _SALTS[None, :]).reshape(n, CHUNKS, WIDTH)
    label = whole.copy()
    for c in left.tolist():
        total = each[:, c].sum(axis=1, dtype=np.uint64)
        for out in combinations(range(WIDTH), masked):
            key = total - each[:, c, list(out)].sum(axis=1, dtype=np.uint64)
            order = np.argsort(key, kind="stable")
            start = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1])))
            end = np.append(start[1:], n)
            mixed = np.minimum.reduceat(label[order], start) != np.maximum.reduceat(label[order], start)
            spent += int(((end - start)[mixed].astype(np.int64) ** 2).sum())
            if spent > n * n:
                return components(symbols, radius, n)
            parent: dict[int, int] = {}

            def top(x: int) -> int:
                while (y := parent.get(x, x)) != x:  # noqa: B023
                    parent[x] = x = parent.get(y, y)  # noqa: B023
                return x

            for a, e in zip(start[mixed].tolist(), end[mixed].tolist(), strict=True):
                own = np.sort(order[a:e])
                if e - a == 2:
                    found = [(own[1], own[0])] if _distance(symbols[own[0]], symbols[own[1]]) <= radius else []
                else:
                    first = components(symbols[own], radius, e - a)
                    found = [(own[k], own[first[k]]) for k in np.flatnonzero(first != np.arange(e - a)).tolist()]
                for u, v in found:
                    u, v = top(int(label[u])), top(int(label[v]))
                    if u != v:
                        parent[max(u, v)] = min(u, v)
            if parent:
                tops = np.array([top(x) for x in parent])
                moved = whole.copy()
                moved[list(parent)] = tops
                label = moved[label]
    return label


def _signature_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in A.chunks(batch, 1):
                some, symbols = signatures(*A.folded(part.column(1)))
                if len(some):
                    flat = pa.py_buffer(np.ascontiguousarray(symbols).tobytes())
                    offsets = pa.py_buffer((np.arange(len(some) + 1) * 2 * SYMBOLS).astype(np.int32).tobytes())
                    yield pa.record_batch([part.column(0).take(pa.array(some)), pa.Array.from_buffers(pa.binary(), len(some), [None, offsets, flat])], names=["doc_id", "sig"])

    return A.ids_and_texts(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, sig binary")


def _symbols(column: pa.Array) -> np.ndarray:
    raw = np.frombuffer(column.buffers()[2], np.uint8) if len(column) else np.zeros(0, np.uint8)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return raw[offsets[0] : offsets[-1]].view(np.uint16).reshape(-1, SYMBOLS) if len(column) else np.zeros((0, SYMBOLS), np.uint16)


def _key_rows(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            k = keys(_symbols(part.column(1)))
            yield pa.record_batch([pa.array(k.ravel()), pa.array(np.repeat(part.column(0).to_numpy(), SYMBOLS))], names=["key", "doc_id"])


def _buckets(batches):
    """From rows sorted by (key, doc_id): the distinct member lists of keys with several documents."""
    seen: set[bytes] = set()

    def members(key: np.ndarray, ids: np.ndarray):
        fresh = np.ones(len(ids), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])
        key, ids = key[fresh], ids[fresh]
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        end = np.append(start[1:], len(key))
        lists = []
        for a, b in zip(start[end - start > 1].tolist(), end[end - start > 1].tolist(), strict=True):
            mark = blake2b(ids[a:b].tobytes(), digest_size=16).digest()
            if mark in seen:
                continue
            if len(seen) < 200_000:  # this only saves work: a list that comes again is dropped later
                seen.add(mark)
            lists.append(ids[a:b])
        if lists:
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
            yield pa.record_batch([pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists)))], names=["members"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cut = int(np.searchsorted(key, key[-1]))  # the last key may go on in the next batch
        if cut == 0 and held and held[-1][0][-1] == key[0]:
            held.append((key, ids))
            continue
        done = [*held, (key[:cut], ids[:cut])]
        yield from members(np.concatenate([k for k, _ in done]), np.concatenate([i for _, i in done]))
        held = [(key[cut:], ids[cut:])]
    if held:
        yield from members(np.concatenate([k for k, _ in held]), np.concatenate([i for _, i in held]))


def _links(batches):
    """From (bucket, doc_id, sig) sorted by bucket and doc_id: (doc_id, first of its component) for verified members."""

    def linked(bucket: np.ndarray, ids: np.ndarray, symbols: np.ndarray):
        start = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        sizes = np.diff(np.append(start, len(bucket)))
        src, dst = [], []
        two = start[sizes == 2]
        near = two[_distance(symbols[two], symbols[two + 1]) <= RADIUS]
        src.append(ids[near + 1])
        dst.append(ids[near])
        for a, n in zip(start[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            label = components(symbols[a : a + n])
            moved = np.flatnonzero(label != np.arange(n))
            src.append(ids[a + moved])
            dst.append(ids[a + label[moved]])
        u, v = np.concatenate(src), np.concatenate(dst)
        return pa.record_batch([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], names=["u", "v"])

    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = (batch.column(0).to_numpy(), batch.column(1).to_numpy(), _symbols(batch.column(2)))
        cut = int(np.flatnonzero(np.concatenate(([True], columns[0][1:] != columns[0][:-1])))[-1])  # the last bucket may go on
        if cut == 0 and held and held[-1][0][-1] == columns[0][0]:
            held.append(columns)
            continue
        done = [*held, tuple(c[:cut] for c in columns)]
        whole = tuple(np.concatenate(c) for c in zip(*done, strict=True))
        if len(whole[0]):
            yield linked(*whole)
        held = [tuple(c[cut:] for c in columns)]
    if held:
        yield linked(*(np.concatenate(c) for c in zip(*held, strict=True)))


def connected(edges: DataFrame) -> DataFrame:
    """(u, v) with v the smallest node of u's component, for edges (u, v) with u > v, by alternating large and small stars."""

    def distinct(df: DataFrame) -> DataFrame:
        return df.where("u <> v").distinct()

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = A.session_checkpoint(distinct(edges))
    before = mark(edges)
    while before[0]:
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        large = distinct(both.withColumn("m", F.least("u", F.min("v").over(Window.partitionBy("u")))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        small = large.withColumn("m", F.min("v").over(Window.partitionBy("u")))
        edges = A.session_checkpoint(distinct(small.select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e")).select("e.u", F.col("e.m").alias("v"))))
        after = mark(edges)
        if after == before:
            break
        before = after
    return edges


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, duplicate_of) for each document that is not the smallest id of its group.

    Texts without a word are in no group. Rows that share an id count as one
    document that is near to all that any of its rows is near to. An empty
    table gives no rows.
    """
    # Equal signatures are one document from here on. The aggregation combines on the map side, so that a text which is
    # a third of the corpus is no task's burden; the join back to its copies is split by the skew join.
    sig = A.session_checkpoint(_signature_rows(docs, id_col, text_col))
    reps = A.session_checkpoint(sig.groupBy("sig").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "sig"))
    key_rows = reps.mapInArrow(_key_rows, "key bigint, doc_id bigint")
    buckets = key_rows.repartition("key").sortWithinPartitions("key", "doc_id").mapInArrow(_buckets, "members array<bigint>").distinct()
    buckets = A.session_checkpoint(buckets.withColumn("bucket", F.xxhash64("members", F.size("members"))))
    member = buckets.select("bucket", F.explode("members").alias("doc_id"))
    full = member.join(reps, "doc_id").select("bucket", "doc_id", "sig").repartition("bucket").sortWithinPartitions("bucket", "doc_id")
    near = full.mapInArrow(_links, "u bigint, v bigint")
    root = connected(near)
    tops = reps.join(root.select(F.col("u").alias("doc_id"), F.col("v").alias("root")), "doc_id", "left").select("sig", F.coalesce("root", "doc_id").alias("duplicate_of"))
    same = A.session_checkpoint(sig.join(tops, "sig").select("doc_id", "duplicate_of"))
    # An id with several texts belongs to several signatures: tie their groups together.
    firsts = same.groupBy("doc_id").agg(F.min("duplicate_of").alias("first"), F.max("duplicate_of").alias("last"))
    firsts = A.session_checkpoint(firsts)
    out = firsts.select("doc_id", F.col("first").alias("duplicate_of"))
    several = firsts.where("first <> last")
    if not several.isEmpty():
        ties = same.join(several.select("doc_id", "first"), "doc_id").where("duplicate_of <> first")
        again = connected(ties.select(F.col("duplicate_of").alias("u"), F.col("first").alias("v")))
        out = out.join(again.select(F.col("u").alias("duplicate_of"), F.col("v").alias("top")), "duplicate_of", "left").select("doc_id", F.coalesce("top", "duplicate_of").alias("duplicate_of"))
    return out.where("doc_id <> duplicate_of").distinct()


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each group: that of the smallest id, and of rows that share an id one.

    Rows without an id and texts without a word stay. Of several rows with one
    id, the one with the smallest (text, other columns) hash stays.
    """
    gone = duplicates(docs, id_col, text_col).select(F.col("doc_id").alias("__ql_id"))
    left = docs.join(gone, docs[id_col].cast("bigint") == gone["__ql_id"], "left_anti")
    ids = docs.select(docs[id_col].cast("bigint").alias("__ql_id")).where("__ql_id is not null")
    twice = ids.groupBy("__ql_id").count().where("count > 1").select("__ql_id")
    if twice.isEmpty():
        return left
    on = left[id_col].cast("bigint") == F.col("__ql_id")
    once = left.join(twice, on, "left_anti")
    order = Window.partitionBy(F.col(f"`{id_col}`")).orderBy(F.xxhash64(F.col(f"`{text_col}`")), F.xxhash64(*(F.col(f"`{c}`") for c, t in docs.dtypes if not t.startswith("map"))))
    return once.unionByName(left.join(twice, on, "left_semi").withColumn("__ql_n", F.row_number().over(order)).where("__ql_n = 1").drop("__ql_n"))
