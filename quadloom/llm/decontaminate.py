"""Benchmark decontamination with a generalised suffix automaton.

The normalised test items (case folded words) are put into one suffix
automaton. Training tokens are streamed through it; at each token the automaton
knows the longest suffix of the text read so far that occurs in some item. A
match becomes a span to remove if it has at least ``min_tokens`` tokens, or
covers at least ``min_item_share`` of an item (with ``min_short_tokens`` tokens
or more). A document whose removed spans cover more than ``max_doc_share`` of
its tokens is dropped as a whole.

Items of less than ``min_short_tokens`` tokens, down to ``MIN_ITEM_TOKENS``, are spans
where they occur as a whole; they are looked up by hash. An item of a word or
two says nothing about a text and is not searched for.

Every span that the automaton finds holds at least q = min(min_tokens, min_short_tokens) matched
tokens, so each place where a span can be has a q-gram that occurs in an item.
The automaton therefore only walks the stretches around such q-grams, which a
vectorised lookup finds; the outcome is that of walking the whole text.

The automaton is broadcast as arrays. Its size is checked: items are divided by id hash
into as many automata as keep each under ``max_automaton_tokens`` tokens (about
BYTES_A_TOKEN bytes each), and the spans of all are put together.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrowtext as A

MIN_ITEM_TOKENS = 3
BYTES_A_TOKEN = 100
MIN_TOKENS = 10
MIN_SHORT_TOKENS = 5
MIN_ITEM_SHARE = 0.8
MAX_DOC_SHARE = 0.5
MAX_AUTOMATON_TOKENS = 4_000_000

SPANS = "doc_id bigint, start bigint, length bigint, n_tokens int, item_id bigint, doc_share double, drop_document boolean"
_SPANS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("n_tokens", pa.int32()), ("item_id", pa.int64()), ("doc_share", pa.float64()), ("drop_document", pa.bool_())])


class Automaton:
    """Generalised suffix automaton over 64-bit token hashes."""

    def __init__(self, items: list[tuple[int, list[int]]], q: int):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.shortest, self.item = [1 << 30], [1 << 62]  # over the items that hold the state's strings
        q_grams = []
        for item, tokens in sorted(items):
            if len(tokens) < q:
                continue
            last = 0
            for token in tokens:
                last = self._extend(last, token)
                if len(tokens) < self.shortest[last]:
                    self.shortest[last] = len(tokens)
                self.item[last] = min(self.item[last], item)
            q_grams.append(A.grams(np.array(tokens, np.uint64), q))
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            p = self.link[s]
            self.shortest[p] = min(self.shortest[p], self.shortest[s])
            self.item[p] = min(self.item[p], self.item[s])
        self.q = q
        self.q_grams = np.unique(np.concatenate(q_grams)) if q_grams else np.zeros(0, np.uint64)
        # Whole short items by their length: sorted hashes and the smallest item of each.
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in range(MIN_ITEM_TOKENS, q):
            whole = {}
            for item, tokens in sorted(items):
                if len(tokens) == n:
                    whole.setdefault(int(A.grams(np.array(tokens, np.uint64), n)[0]), item)
            if whole:
                self.short[n] = (np.array(sorted(whole), np.uint64), np.array([whole[h] for h in sorted(whole)], np.int64))
        self._pack()

    def _pack(self) -> None:
        """The dictionaries of the construction as arrays: for each state a range of sorted tokens and their targets."""
        sizes = np.array([len(x) for x in self.next])
        self.first = np.concatenate(([0], np.cumsum(sizes))).tolist()
        edges = np.array([(k, v) for x in self.next for k, v in sorted(x.items())], np.uint64).reshape(-1, 2)
        self.token, self.to = np.ascontiguousarray(edges[:, 0]), edges[:, 1].astype(np.int32)
        self.link, self.length, self.shortest = (np.array(x, np.int32) for x in (self.link, self.length, self.shortest))
        self.item = np.array(self.item, np.int64)
        self.first = np.array(self.first, np.int64)
        del self.next

    def step(self, state: int, token: int) -> int:
        """The state after a token; -1 if there is none."""
        a, b = int(self.first[state]), int(self.first[state + 1])
        at = bisect_left(self.token, token, a, b)
        return int(self.to[at]) if at < b and self.token[at] == token else -1

    def _state(self, length: int, nexts: dict[int, int], link: int) -> int:
        self.next.append(nexts)
        self.link.append(link)
        self.length.append(length)
        self.shortest.append(1 << 30)
        self.item.append(1 << 62)
        return len(self.next) - 1

    def _split(self, p: int, token: int, target: int) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = clone
        while p >= 0 and self.next[p].get(token) == target:
            self.next[p][token] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, token: int) -> int:
        have = self.next[last].get(token)
        if have is not None:
            return have if self.length[have] == self.length[last] + 1 else self._split(last, token, have)
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        if p >= 0:
            have = self.next[p][token]
            self.link[new] = have if self.length[have] == self.length[p] + 1 else self._split(p, token, have)
        return new

    def candidates(self, grams: np.ndarray) -> np.ndarray:
        """Which of these q-grams occur in an item."""
        if not len(self.q_grams):
            return np.zeros(len(grams), bool)
        at = np.searchsorted(self.q_grams, grams)
        at[at == len(self.q_grams)] = 0
        return self.q_grams[at] == grams

    def spans(self, tokens: list[int], min_tokens: int, min_short: int, min_share: float) -> list[tuple[int, int, int]]:
        """(first, one past the last, item) of the removable matches in tokens, each position's longest."""
        state = length = 0
        link, longest = self.link, self.length
        out = []
        for i, token in enumerate(tokens):
            to = self.step(state, token)
            while state and to < 0:
                state = int(link[state])
                length = int(longest[state])
                to = self.step(state, token)
            if to >= 0:
                state, length = to, length + 1
            if length >= min_short:
                # A state also stands for its suffixes, whose items are those of its links.
                s, n = state, length
                while s > 0 and n >= min_short:
                    if n >= min_tokens or n >= min_share * self.shortest[s]:
                        out.append((i + 1 - n, i + 1, int(self.item[s])))
                        break
                    s = int(link[s])
                    n = int(longest[s])
        return out


class _Searcher:
    """Spans in chunks of texts, for a list of broadcast automata."""

    def __init__(self, automata: list, limits: tuple[int, int, float, float]):
        self.automata, self.limits = automata, limits

    def __call__(self, raw: np.ndarray, offsets: np.ndarray) -> list[tuple[int, list[tuple[int, int, int, int]], float]]:
        """For texts with spans: number of the text, merged (first byte, end byte, tokens, item), share of the tokens."""
        min_tokens, min_short, min_share, _ = self.limits
        words = A.Words(raw, offsets)
        q = min(min_tokens, min_short)
        found: dict[int, list[tuple[int, int, int]]] = {}
        text = words.text_of()
        grams = A.grams(words.hash, q)
        inside = text[: len(grams)] == text[q - 1 :] if len(grams) else np.zeros(0, bool)
        for held in self.automata:
            automaton = held.value
            for n, (hashes, items) in automaton.short.items():
                whole = A.grams(words.hash, n)
                if not len(whole):
                    continue
                at = np.minimum(np.searchsorted(hashes, whole), len(hashes) - 1)
                for k in np.flatnonzero((hashes[at] == whole) & (text[: len(whole)] == text[n - 1 :])):
                    found.setdefault(int(text[k]), []).append((int(k), int(k) + n, int(items[at[k]])))
            hits = np.flatnonzero(inside & automaton.candidates(grams))
            if not len(hits):
                continue
            new = np.flatnonzero((np.diff(hits) > q) | (text[hits[1:]] != text[hits[:-1]])) + 1
            for a, b in zip(hits[np.append(0, new)], hits[np.append(new - 1, len(hits) - 1)] + q, strict=True):
                for x, y, item in automaton.spans(words.hash[a:b].tolist(), min_tokens, min_short, min_share):
                    found.setdefault(int(text[a]), []).append((int(a) + x, int(a) + y, item))
        out = []
        for t in sorted(found):
            merged: list[list[int]] = []
            for x, y, item in sorted(found[t]):
                if merged and x <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], y)
                    merged[-1][2] = min(merged[-1][2], item)
                else:
                    merged.append([x, y, item])
            covered = sum(y - x for x, y, _ in merged)
            out.append((t, [(int(words.start[x]), int(words.end[y - 1]), y - x, item) for x, y, item in merged], covered / int(words.count[t])))
        return out


def _searcher(docs: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str, limits: tuple[int, int, float, float], max_automaton_tokens: int) -> _Searcher:
    spark = docs.sparkSession
    items = A.ids_and_texts(benchmark, item_col, item_text_col)
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = 1 + int(size) // (2 * max_automaton_tokens)  # a token and its space have two characters at least
    automata = []
    for k in range(shards):
        part = items if shards == 1 else items.where(F.pmod(F.xxhash64("doc_id"), F.lit(shards)) == k)
        rows = part.toArrow()
        raw, offsets = A.folded(rows.column("text"))
        words = A.Words(raw, offsets)
        hashes = words.hash.tolist()
        ids = rows.column("doc_id").to_pylist()
        tokens = [(i, hashes[a:b]) for i, a, b in zip(ids, words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)]
        automata.append(spark.sparkContext.broadcast(Automaton(tokens, min(limits[0], limits[1]))))
    return _Searcher(automata, limits)


def spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_tokens: int = MIN_TOKENS, min_short_tokens: int = MIN_SHORT_TOKENS, min_item_share: float = MIN_ITEM_SHARE, max_doc_share: float = MAX_DOC_SHARE, max_automaton_tokens: int = MAX_AUTOMATON_TOKENS) -> DataFrame:
    """The spans to remove, overlapping ones merged.

    start and length in characters of the original text, n_tokens, the smallest
    item_id met, doc_share = share of the document's tokens in its spans,
    drop_document = doc_share above max_doc_share. Null or empty texts and items
    match nothing; items without an id are left out; each row of a repeated
    document is reported; an empty benchmark or table gives no rows.
    """
    limits = (min_tokens, min_short_tokens, min_item_share, max_doc_share)
    search = _searcher(docs, benchmark, item_col, item_text_col, limits, max_automaton_tokens)

    def run(batches):
        for batch in batches:
            for part in A.chunks(batch, 1):
                raw, offsets = A.folded(part.column(1))
                found = search(raw, offsets)
                if not found:
                    continue
                ids = part.column(0).to_pylist()
                chars = A.char_positions(raw)
                rows = [(ids[t], int(chars[a] - chars[offsets[t]]), int(chars[b] - chars[a]), n, item, share, share > max_doc_share) for t, each, share in found for a, b, n, item in each]
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SPANS, strict=True)], schema=_SPANS)

    return A.ids_and_texts(docs, id_col, text_col).mapInArrow(run, SPANS)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", item_col: str = "item_id", item_text_col: str = "text", min_tokens: int = MIN_TOKENS, min_short_tokens: int = MIN_SHORT_TOKENS, min_item_share: float = MIN_ITEM_SHARE, max_doc_share: float = MAX_DOC_SHARE, max_automaton_tokens: int = MAX_AUTOMATON_TOKENS) -> DataFrame:
    """docs with the spans cut out and over-covered documents dropped, in one pass without a shuffle.

    All columns stay; length_col, if docs has it, is set to the new length of a
    text that was cut. Documents without a span are untouched, null texts stay null.
    """
    limits = (min_tokens, min_short_tokens, min_item_share, max_doc_share)
    search = _searcher(docs, benchmark, item_col, item_text_col, limits, max_automaton_tokens)
    names = docs.columns
    at = names.index(text_col)
    length_at = names.index(length_col) if length_col in names else -1

    def run(batches):
        for batch in batches:
            for part in A.chunks(batch, at):
                raw, offsets = A.folded(part.column(at))
                found = search(raw, offsets)
                if not found:
                    yield part
                    continue
                keep = np.ones(part.num_rows, bool)
                chars = A.char_positions(raw)
                texts, cut = part.column(at).to_pylist(), {}
                for t, each, share in found:
                    keep[t] = share <= max_doc_share
                    whole, pieces, last = texts[t], [], 0
                    for a, b, _, _ in each:
                        pieces.append(whole[last : chars[a] - chars[offsets[t]]])
                        last = chars[b] - chars[offsets[t]]
                    texts[t] = cut[t] = "".join([*pieces, whole[last:]])
                columns = [*part.columns]
                columns[at] = pa.array(texts, part.schema.field(at).type)
                if length_at >= 0:
                    lengths = part.column(length_at).to_pylist()
                    for t, text in cut.items():
                        lengths[t] = len(text)
                    columns[length_at] = pa.array(lengths, part.schema.field(length_at).type)
                yield pa.record_batch(columns, schema=part.schema).filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def oracle(table: str = "documents", benchmark: str = "benchmark") -> str:
    """DuckDB SQL for spans(): matches as runs of equal q-grams along each (document, item) diagonal."""
    alone = A.spaceless_class()
    edges = [0x80, *(x for a, b in A.SPACELESS for x in (a, b + 1)), 0x110000]
    inside = "0-9a-z" + "".join(f"\\x{{{a:X}}}-\\x{{{b - 1:X}}}" for a, b in zip(edges[::2], edges[1::2], strict=True))
    token = f"[{alone}]|[{inside}]+"
    pieces = f"regexp_extract_all(lower(text), '(?:[{alone}]|[{inside}]+)[^{alone}{inside}]*|^[^{alone}{inside}]+')"
    q = min(MIN_TOKENS, MIN_SHORT_TOKENS)
    grams = lambda n: " || ' ' || ".join("w" if k == 0 else f"lead(w, {k}) OVER o" for k in range(n))
    short = " UNION ALL ".join(
        f"SELECT d.row, d.k AS a, d.k + {n} AS b, i.item FROM (SELECT row, k, {grams(n)} AS g FROM t WINDOW o AS (PARTITION BY row ORDER BY k)) d JOIN (SELECT item, {grams(n)} AS g, k, n FROM v WINDOW o AS (PARTITION BY item ORDER BY k)) i ON d.g = i.g AND i.k = 0 AND i.n = {n}"
        for n in range(MIN_ITEM_TOKENS, q)
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, text FROM {table} WHERE doc_id IS NOT NULL AND text <> ''),
p AS (SELECT row, unnest({pieces}) AS piece, generate_subscripts({pieces}, 1) AS pos FROM d),
s AS (SELECT row, pos, regexp_extract(piece, '{token}') AS w, sum(length(piece)) OVER (PARTITION BY row ORDER BY pos) - length(piece) AS start FROM p),
t AS (SELECT row, row_number() OVER (PARTITION BY row ORDER BY pos) - 1 AS k, w, start, start + length(w) AS stop FROM s WHERE w <> ''),
c AS (SELECT row, count(*) AS total FROM t GROUP BY row),
i AS (SELECT item_id AS item, unnest(regexp_extract_all(lower(text), '{token}')) AS w, generate_subscripts(regexp_extract_all(lower(text), '{token}'), 1) - 1 AS k FROM {benchmark} WHERE item_id IS NOT NULL),
v AS (SELECT *, count(*) OVER (PARTITION BY item) AS n FROM i),
dg AS (SELECT row, k, {grams(q)} AS g FROM t WINDOW o AS (PARTITION BY row ORDER BY k)),
vg AS (SELECT item, k, n, {grams(q)} AS g FROM v WINDOW o AS (PARTITION BY item ORDER BY k)),
m AS (SELECT dg.row, vg.item, vg.n, dg.k, dg.k - vg.k AS diagonal FROM dg JOIN vg USING (g)),
r AS (SELECT *, k - row_number() OVER (PARTITION BY row, item, diagonal ORDER BY k) AS run FROM m),
e AS (SELECT row, item, n, k + {q} AS b, k + {q} - min(k) OVER (PARTITION BY row, item, diagonal, run) AS size FROM r),
f AS (SELECT row, b, max(size) AS size FROM e WHERE size >= {MIN_TOKENS} OR size >= {MIN_ITEM_SHARE} * n GROUP BY row, b),
x AS (SELECT row, f.b - f.size AS a, b, min(e.item) AS item FROM f JOIN e USING (row, b) WHERE e.size >= f.size GROUP BY ALL UNION ALL {short}),
g AS (SELECT *, max(b) OVER (PARTITION BY row ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM x),
h AS (SELECT *, sum(CASE WHEN before >= a THEN 0 ELSE 1 END) OVER (PARTITION BY row ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM g),
y AS (SELECT row, min(a) AS a, max(b) AS b, min(item) AS item FROM h GROUP BY row, island),
z AS (SELECT *, sum(b - a) OVER (PARTITION BY row) / total AS share FROM y JOIN c USING (row))
SELECT d.doc_id, t.start::BIGINT AS start, (u.stop - t.start)::BIGINT AS length, (z.b - z.a)::INTEGER AS n_tokens, z.item AS item_id, z.share AS doc_share, z.share > {MAX_DOC_SHARE} AS drop_document
FROM z JOIN d USING (row) JOIN t ON t.row = z.row AND t.k = z.a JOIN t u ON u.row = z.row AND u.k = z.b - 1
"""
