"""Substring dedup by hashing stretches of lines.

A passage that two texts share seldom begins and ends with a line, so whole
lines as units miss most passages. Lines are therefore cut further, at places
that depend on the words around them alone: before a word whose value (``value``)
is smaller than those of the ``REACH`` words before it and not greater than those of
the ``REACH`` words after it, and inside a run of one repeated word. A unit begins at
a cut (the start of a line is one) and goes on to the first cut, or the end of
the text, that is ``min_words`` words or more away; units overlap.

Units are normalised (case folded, white space collapsed, a word for each
character in scripts without spaces) and reduced to a 96-bit digest, digests are
grouped over the whole corpus, and the occurrence with the smallest (id, text key,
offset) stays; the others go, with their offsets in the original text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrowtext as A
from .line_dedup import text_key

MIN_WORDS = 25
REACH = 4

UNITS = "doc_id bigint, text_key int, start int, length int, n_words int, h1 bigint, h2 int"
_UNITS = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int32()), ("start", pa.int32()), ("length", pa.int32()), ("n_words", pa.int32()), ("h1", pa.int64()), ("h2", pa.int32())])


def value(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """32 bits from the first and last two bytes and the length of each word."""
    b = raw.astype(np.uint64)
    size = (end - start).astype(np.uint64)
    one = size == 1
    head = np.where(one, b[start], b[start] * 256 + b[np.minimum(start + 1, len(b) - 1)])
    tail = np.where(one, b[start], b[end - 2] * 256 + b[end - 1])
    return ((head * 40503 + tail * 10007 + size * 97) * np.uint64(2654435761)) & np.uint64(0xFFFFFFFF)


def _cuts(words: A.Words, raw: np.ndarray, reach: int) -> np.ndarray:
    """For each word, whether a unit may begin there."""
    n = len(words.start)
    v = value(raw, words.start, words.end)
    text = words.text_of()
    new = np.ones(n, bool)
    new[1:] = text[1:] != text[:-1]
    lines = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(raw == 10, out=lines[1:])
    new[1:] |= lines[words.start[1:]] > lines[words.end[:-1]]
    least, same = np.ones(n, bool), np.ones(n, bool)
    for r in range(1, reach + 1):
        alike = text[r:] == text[: n - r] if n > r else np.zeros(0, bool)
        least[r:] &= ~alike | (v[r:] < v[: n - r])
        least[: n - r] &= ~alike | (v[: n - r] <= v[r:])
        same[r:] &= alike & (v[r:] == v[: n - r])
        same[:r] = False
    return new | least | same


def _unit_rows(ids: pa.Array, keys: pa.Array, raw: np.ndarray, offsets: np.ndarray, min_words: int, reach: int) -> pa.RecordBatch:
    words = A.Words(raw, offsets, A.IS_TOKEN, folded=raw)
    first = words.first
    cuts = np.flatnonzero(_cuts(words, raw, reach))
    bounds = np.union1d(cuts, first)
    doc = words.text_of()[cuts]
    at = np.searchsorted(bounds, cuts + min_words)
    end = bounds[np.minimum(at, len(bounds) - 1)]
    some = (at < len(bounds)) & (end <= first[doc + 1])
    a, b, doc = cuts[some], end[some], doc[some]
    sums = A.Sums(words.hash)
    chars = A.char_positions(raw)
    # A unit has the white space up to the next word.
    begins = np.append(words.start, len(raw))
    stop = np.where(b == first[doc + 1], offsets[doc + 1], begins[b])
    start = chars[words.start[a]]
    columns = [(start - chars[offsets[doc]]).astype(np.int32), (chars[stop] - start).astype(np.int32), (b - a).astype(np.int32), sums.digest(0, a, b).view(np.int64), (sums.digest(1, a, b) >> np.uint64(32)).astype(np.uint32).view(np.int32)]
    return pa.record_batch([ids.take(pa.array(doc)), keys.take(pa.array(doc)), *map(pa.array, columns)], schema=_UNITS)


def units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, reach: int = REACH) -> DataFrame:
    """A row for each unit: offset and length in characters (with the white space after it), words, digest."""

    def run(batches):
        for batch in batches:
            for part in A.chunks(batch, 1):
                yield _unit_rows(part.column(0), part.column(2), *A.folded(part.column(1)), min_words, reach)

    return A.ids_and_texts(docs, id_col, text_col).where(F.col("text") != "").withColumn("text_key", text_key(F.col("text"))).mapInArrow(run, UNITS)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, reach: int = REACH) -> DataFrame:
    """The units to remove: doc_id, text_key, start, length, n_words, first_doc_id, first_start.

    start and length count characters of the original text. Different texts under
    one id are told apart by text_key; equal rows are one document. A unit that
    overlaps the first of its own text stays. Texts of less than min_words words,
    null and empty texts and an empty table have no units.

    The first occurrences are aggregated on the map side before the shuffle, and
    only the join with digests that occur twice moves units, so that a unit that fills
    a third of the corpus is split by the skew join.
    """
    u = units(docs, id_col, text_col, min_words, reach)
    here = F.struct("doc_id", "text_key", "start", "length")
    firsts = u.groupBy("h1", "h2").agg(F.min(here).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    first = F.col("first")
    later = (F.col("doc_id") != first.doc_id) | (F.col("text_key") != first.text_key) | (F.col("start") >= first.start + first.length)
    again = u.join(firsts, ["h1", "h2"]).where(later)
    return again.select("doc_id", "text_key", "start", "length", "n_words", first.doc_id.alias("first_doc_id"), first.start.alias("first_start")).distinct()


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, reach: int = REACH) -> DataFrame:
    """docs without the repeated units; other columns, rows without an id and documents without repeats as they are."""
    cuts = repeats(docs, id_col, text_col, min_words, reach).groupBy(F.col("doc_id").alias("__ql_id"), F.col("text_key").alias("__ql_key")).agg(F.sort_array(F.collect_list(F.struct("start", "length"))).alias("__ql_cuts"))
    both = docs.join(cuts, (docs[id_col].cast("bigint") == cuts["__ql_id"]) & (text_key(docs[text_col].cast("string")) == cuts["__ql_key"]), "left")
    names = docs.columns
    at = names.index(text_col)

    def run(batches):
        for batch in batches:
            cuts = batch.column(len(names))
            hit = np.flatnonzero(cuts.is_valid().to_numpy(zero_copy_only=False))
            columns = batch.columns[: len(names)]
            if len(hit):
                texts = columns[at].to_pylist()
                for k in hit.tolist():
                    pieces, last = [], 0
                    for cut in cuts[k].as_py():
                        pieces.append(texts[k][last : max(last, cut["start"])])
                        last = max(last, cut["start"] + cut["length"])
                    texts[k] = "".join([*pieces, texts[k][last:]])
                columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.record_batch(columns, names=names)

    return both.select(*(docs[f"`{c}`"] for c in names), "__ql_cuts").mapInArrow(run, docs.schema)


def oracle(table: str = "documents", min_words: int = MIN_WORDS, reach: int = REACH) -> str:
    """DuckDB SQL for repeats(), with whole normalised units as keys."""
    alone, space = A.spaceless_class(), "\\x00-\\x20"
    over = "PARTITION BY doc_id, text_key ORDER BY k"
    number = "('0x' || {})::UBIGINT"
    head, tail = number.format("left(hex(word), 4)"), number.format("right(hex(word), 4)")
    return f"""
WITH l AS (SELECT DISTINCT doc_id, ('0x' || substr(md5(text), 1, 7))::INTEGER AS text_key, text FROM {table} WHERE doc_id IS NOT NULL AND text <> ''),
p AS (SELECT doc_id, text_key, unnest(regexp_extract_all(lower(text), '^[{space}]+|[{alone}][{space}]*|[^{space}{alone}]+[{space}]*')) AS piece, generate_subscripts(regexp_extract_all(lower(text), '^[{space}]+|[{alone}][{space}]*|[^{space}{alone}]+[{space}]*'), 1) AS pos FROM l),
w AS (SELECT doc_id, text_key, regexp_replace(piece, '[{space}]+$', '') AS word, row_number() OVER ({over.replace("BY k", "BY pos")}) - 1 AS k, start, after_line
  FROM (SELECT *, sum(length(piece)) OVER ({over.replace("BY k", "BY pos")}) - length(piece) AS start, lag(contains(piece, chr(10))) OVER ({over.replace("BY k", "BY pos")}) AS after_line FROM p) WHERE regexp_replace(piece, '[{space}]+$', '') <> ''),
x AS (SELECT *, (({head} * 40503 + {tail} * 10007 + strlen(word) * 97) * 2654435761) % 4294967296 AS value FROM w),
c AS (SELECT *, k = 0 OR coalesce(after_line, false)
    OR value < coalesce(min(value) OVER ({over} ROWS BETWEEN {reach} PRECEDING AND 1 PRECEDING), 4294967296) AND value <= coalesce(min(value) OVER ({over} ROWS BETWEEN 1 FOLLOWING AND {reach} FOLLOWING), 4294967296)
    OR k >= {reach} AND min(value) OVER ({over} ROWS BETWEEN {reach} PRECEDING AND CURRENT ROW) = max(value) OVER ({over} ROWS BETWEEN {reach} PRECEDING AND CURRENT ROW) AS cut FROM x),
b AS (SELECT doc_id, text_key, k, start FROM c WHERE cut UNION ALL SELECT doc_id, text_key, max(k) + 1, any_value(length(text)) FROM c JOIN l USING (doc_id, text_key) GROUP BY doc_id, text_key),
u AS (SELECT a.doc_id, a.text_key, a.k, a.start, b.k - a.k AS n_words, b.start - a.start AS length FROM (SELECT *, k + {min_words} AS least FROM c WHERE cut) a ASOF JOIN b ON a.doc_id = b.doc_id AND a.text_key = b.text_key AND a.least <= b.k),
n AS (SELECT doc_id, text_key, u.start, length, n_words, md5(string_agg(word, ' ' ORDER BY w.k)) AS h
  FROM (SELECT *, unnest(generate_series(k, k + n_words - 1)) AS each FROM u) u JOIN w USING (doc_id, text_key) WHERE w.k = each GROUP BY ALL),
f AS (SELECT h, min(struct_pack(d := doc_id, t := text_key, s := start, l := length)) AS first FROM n GROUP BY h HAVING count(*) > 1)
SELECT n.doc_id, n.text_key, n.start::INTEGER AS start, n.length::INTEGER AS length, n.n_words::INTEGER AS n_words, first.d AS first_doc_id, first.s::INTEGER AS first_start
FROM n JOIN f USING (h) WHERE n.doc_id <> first.d OR n.text_key <> first.t OR n.start >= first.s + first.l
"""
