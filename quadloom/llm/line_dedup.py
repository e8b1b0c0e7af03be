"""Line dedup with a deletion-neighbourhood join.

Lines are compared by their normalised words (case folded, cut at white space)
and the Levenshtein distance counts whole words. Lines of ``min_words`` words or
more are near copies within one inserted, deleted or replaced word; shorter lines,
of which one word is much, only if equal. Each line emits itself and itself without each one
of its words as hashed keys; equal keys are joined, and the distance is verified:
two lines that share a variant are one edit apart if one of them is the variant
itself or both lost the word at the same place. A line goes if an earlier line,
by (id, text key, line number), is within the bound.

A line only emits variants if it can have a partner: one edit leaves the first or
the last half of the words as they are, so lines that share neither a first nor a
last half with another line have no near copy. Equal lines share their halves too,
so one grouping by halves finds the equal lines, the first of them and the lines
that may have a near copy. Texts are read three times: for their halves, for the
variants of the lines that may have a near copy, and for the lines to report.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrowtext as A

MIN_WORDS = 5

_Q = (np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
_LINES = "h1 bigint, h2 bigint, doc_id bigint, text_key int, line_no int"
_KEYS = f"key bigint, {_LINES}"
_MARKED = f"{_LINES}, able boolean, again boolean"
_VARIANTS = "v1 bigint, v2 int, place int, doc_id bigint, text_key int, line_no int"
_NEAR = "doc_id bigint, text_key int, line_no int, best_doc_id bigint, best_text_key int, best_line_no int"

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    if which not in _powers or len(_powers[which][0]) < n:
        size = max(n, 1 << 20)
        both = []
        for b in (_Q[which], np.uint64(pow(int(_Q[which]), -1, 1 << 64))):
            a = np.full(size, b, np.uint64)
            a[0] = 1
            both.append(np.multiply.accumulate(a))
        _powers[which] = (both[0], both[1])
    return _powers[which]


class _Lines:
    """Lines with a word: text number, line number, first and one past the last word."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        cuts = np.union1d(offsets[:-1], np.flatnonzero(raw == 10) + 1)
        cuts = cuts[cuts < offsets[-1]]
        words = A.Words(raw, offsets, A.IS_TOKEN, folded=raw)
        self.word = words.hash
        at = np.searchsorted(words.start, np.append(cuts, offsets[-1]))
        doc = np.searchsorted(offsets, cuts, "right") - 1
        number = np.arange(len(cuts)) - np.searchsorted(cuts, offsets[doc])
        some = np.diff(at) > 0
        self.doc, self.number, self.a, self.b = doc[some], number[some], at[:-1][some], at[1:][some]
        self.n = self.b - self.a
        self.sums = []
        for k in (0, 1):
            total = np.zeros(len(self.word) + 1, np.uint64)
            np.cumsum((A.mix(self.word + np.uint64(k)) if k else self.word) * _power(k, len(self.word) + 2)[0][: len(self.word)], out=total[1:])
            self.sums.append(total)

    def digest(self, k: int, at: np.ndarray | None = None) -> np.ndarray:
        rows = slice(None) if at is None else at
        back = _power(k, len(self.word) + 2)[1]
        a, b = self.a[rows], self.b[rows]
        return A.mix((self.sums[k][b] - self.sums[k][a]) * back[a] + (b - a).astype(np.uint64))

    def without(self, k: int, line: np.ndarray, word: np.ndarray) -> np.ndarray:
        """digest() of these lines without these words."""
        total, back = self.sums[k], _power(k, len(self.word) + 2)[1]
        a, b = self.a[line], self.b[line]
        return A.mix(((total[word] - total[a]) + (total[b] - total[word + 1]) * back[1]) * back[a] + (b - a - 1).astype(np.uint64))

    def part(self, a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
        """Hashes of the words from a up to b."""
        total, back = self.sums[0], _power(0, len(self.word) + 2)[1]
        return A.mix((total[b] - total[a]) * back[a] + (b - a).astype(np.uint64) * _Q[1] + np.uint64(salt))

    def halves(self, min_words: int) -> tuple[np.ndarray, np.ndarray]:
        """(line, key): first and last halves of the lines of min_words or more, for half the words rounded down and for
        half of one word less, as a line has to meet lines of one word more too."""
        line = np.flatnonzero(self.n >= min_words)
        even = line[self.n[line] % 2 == 0]
        lines, keys = [], []
        for rows, half in ((line, self.n[line] // 2), (even, self.n[even] // 2 - 1)):
            a, b = self.a[rows], self.b[rows]
            lines += [rows, rows]
            keys += [self.part(a, a + half, 1), self.part(b - half, b, 2)]
        return np.concatenate(lines), np.concatenate(keys)


def _line_rows(batches):
    for batch in batches:
        for part in A.chunks(batch, 1):
            lines = _Lines(*A.folded(part.column(1)))
            doc = pa.array(lines.doc)
            columns = [pa.array(lines.digest(0).view(np.int64)), pa.array(lines.digest(1).view(np.int64)), part.column(0).take(doc), part.column(2).take(doc), pa.array(lines.number.astype(np.int32))]
            yield pa.record_batch(columns, names=["h1", "h2", "doc_id", "text_key", "line_no"])


def _ends(h1: np.ndarray, h2: np.ndarray, place: tuple[np.ndarray, ...]) -> np.ndarray:
    """Of equal lines the first and the last by place, of all others the only one."""
    order = np.lexsort((h2, h1))
    same = np.concatenate(([False], (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1]), [False]))
    several = same[:-1] | same[1:]
    one, rest = order[~several], order[several]
    if len(rest):
        rest = rest[np.lexsort((*(x[rest] for x in place[::-1]), h2[rest], h1[rest]))]
        new = np.concatenate(([True], (h1[rest][1:] != h1[rest][:-1]) | (h2[rest][1:] != h2[rest][:-1]), [True]))
        rest = rest[new[:-1] | new[1:]]
    return np.concatenate([one, rest])


def _key_rows(min_words: int):
    """The lines under each key of theirs. A line of less than min_words words is its own key. Of the equal lines of a chunk
    only the first and the last go on, so that a line that is a third of all is no task's burden."""

    def run(batches):
        for batch in batches:
            for part in A.chunks(batch, 1):
                lines = _Lines(*A.folded(part.column(1)))
                if not len(lines.n):
                    continue
                h1, h2, number = lines.digest(0), lines.digest(1), lines.number.astype(np.int32)
                doc, text_key = (part.column(k).take(pa.array(lines.doc)).to_numpy() for k in (0, 2))
                kept = np.zeros(len(h1), bool)
                kept[_ends(h1, h2, (doc, text_key, number))] = True
                line, key = lines.halves(min_words)
                line, key = line[kept[line]], key[kept[line]]
                short = np.flatnonzero(kept & (lines.n < min_words))
                line, key = np.concatenate([line, short]), np.concatenate([key, A.mix(h1[short] + _Q[0])])
                columns = [key.view(np.int64), h1[line].view(np.int64), h2[line].view(np.int64), doc[line], text_key[line], number[line]]
                yield pa.record_batch([pa.array(c) for c in columns], names=["key", "h1", "h2", "doc_id", "text_key", "line_no"])

    return run


def _variant_rows(batches):
    """From (doc_id, text, text_key, line numbers): the variants of those lines; place -1 is the line itself."""
    for batch in batches:
        for part in A.chunks(batch, 1):
            lines = _Lines(*A.folded(part.column(1)))
            wanted = part.column(3)
            text = np.repeat(np.arange(part.num_rows), np.diff(np.asarray(wanted.offsets)))
            pack = lambda t, n: t.astype(np.int64) << 32 | n
            line = np.flatnonzero(np.isin(pack(lines.doc, lines.number), pack(text, wanted.flatten().to_numpy())))
            if not len(line):
                continue
            n = lines.n[line]
            row = np.repeat(line, n)
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            word = lines.a[row] + place
            both = [np.concatenate([lines.digest(k, line), lines.without(k, row, word)]) for k in (0, 1)]
            row, place = np.concatenate([line, row]), np.concatenate([np.full(len(line), -1), place])
            doc = pa.array(lines.doc[row])
            yield pa.record_batch(
                [pa.array(both[0].view(np.int64)), pa.array((both[1] >> np.uint64(32)).astype(np.uint32).view(np.int32)), pa.array(place.astype(np.int32)), part.column(0).take(doc), part.column(2).take(doc), pa.array(lines.number[row].astype(np.int32))],
                names=["v1", "v2", "place", "doc_id", "text_key", "line_no"],
            )


def _able_rows(batches):
    """From (key, h1, h2, place) sorted by all columns: the first place of each line, whether another line shares the key
    and whether the line is at a later place too; lines of which neither holds are left out.

    A group may go on in the next batch. Three rows of a key are kept for that, however many it has: the first one,
    and the first and the last of its last line.
    """
    held: list[np.ndarray] | None = None

    def marked(columns: list[np.ndarray], end: int) -> pa.RecordBatch:
        """Of the first rows up to end, where a line ends."""
        new_key, new_line = _news(columns, 1), _news(columns, 3)
        first = np.flatnonzero(new_line[:end])
        last = np.append(first, end)[1:] - 1
        key = np.cumsum(new_key)  # counts the rows that are held back, too
        several = np.bincount(key[np.flatnonzero(new_line)])[key[first]] > 1
        again = np.zeros(len(first), bool)
        for c in columns[3:]:
            again |= c[first] != c[last]
        out = several | again
        return pa.record_batch([pa.array(x[out]) for x in (*(c[first] for c in columns[1:]), several, again)], names=[*names[1:], "able", "again"])

    for b in batches:
        if not b.num_rows:
            continue
        names = b.schema.names
        columns = [c.to_numpy() for c in b.columns]
        if held is not None:
            columns = [np.concatenate(c) for c in zip(held, columns, strict=True)]
        top, line = (int(np.flatnonzero(_news(columns, k))[-1]) for k in (1, 3))
        yield marked(columns, line)
        held = [c[np.unique([top, line, len(c) - 1])] for c in columns]
    if held is not None:
        yield marked(held, len(held[0]))


def _news(columns: list[np.ndarray], n: int) -> np.ndarray:
    """The rows that differ from the one before in one of the first n columns."""
    out = np.zeros(len(columns[0]), bool)
    out[0] = True
    for c in columns[:n]:
        out[1:] |= c[1:] != c[:-1]
    return out


def _near_rows(batches):
    """From variants sorted by all columns, the line itself first: lines with an earlier line one edit away.

    A group of equal variants may go on in the next batch. Three of its rows are kept for that, however many it has:
    the line that is the variant itself, the first row of the last place and the earliest row.
    """
    held: list[np.ndarray] | None = None
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(k).to_numpy() for k in range(6)]
        if held is not None:
            columns = [np.concatenate(c) for c in zip(held, columns, strict=True)]
        v1, v2 = columns[:2]
        same = np.concatenate(([False], (v1[1:] == v1[:-1]) & (v2[1:] == v2[:-1]), [True]))
        columns = [c[same[:-1] | same[1:]] for c in columns]  # the last row always stays
        v1, v2, place, doc, key, number = columns
        n = len(v1)
        group = np.cumsum(np.concatenate(([0], (v1[1:] != v1[:-1]) | (v2[1:] != v2[:-1]))))
        run = np.cumsum(np.concatenate(([0], (group[1:] != group[:-1]) | (place[1:] != place[:-1]))))
        first_of_run = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
        first_of_group = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        # For lines that are the variant themselves, the earliest of all places; the runs' firsts suffice.
        by_rank = first_of_run[np.lexsort((number[first_of_run], key[first_of_run], doc[first_of_run], group[first_of_run]))]
        earliest = by_rank[np.concatenate(([True], group[by_rank][1:] != group[by_rank][:-1]))]
        best = first_of_run[run]
        whole = first_of_group[group]
        has_whole = place[whole] == -1

        def earlier(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return (doc[a] < doc[b]) | (doc[a] == doc[b]) & ((key[a] < key[b]) | (key[a] == key[b]) & (number[a] < number[b]))  # noqa: B023

        best = np.where(has_whole & earlier(whole, best), whole, best)
        best = np.where(place == -1, earliest[group], best)
        hit = np.flatnonzero(earlier(best, np.arange(n)))
        rank = (doc, key, number)
        yield pa.record_batch([pa.array(x[k]) for k in (hit, best[hit]) for x in rank], names=["doc_id", "text_key", "line_no", "best_doc_id", "best_text_key", "best_line_no"])
        keep = np.unique([*([whole[-1]] if has_whole[-1] else []), earliest[-1], first_of_run[-1]])
        held = [c[keep] for c in columns]


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The lines to remove: doc_id, text_key, line_no, first_doc_id, first_line_no, edits.

    first is the earliest line, by (id, text key, line number), within the bound; edits
    is 0 if it is equal and 1 otherwise. Lines count from 0. Lines without a word
    stay; null and empty texts and an empty table have none. Different texts under one
    id are told apart by text_key, 28 bits of the text's digest; equal rows are one document.
    The first places of the lines that matter are checkpointed when this is called.
    """
    texts = A.ids_and_texts(docs, id_col, text_col).withColumn("text_key", text_key(F.col("text")))
    place = ["doc_id", "text_key", "line_no"]
    here = F.struct(*place)
    keys = texts.mapInArrow(_key_rows(min_words), _KEYS).repartition("key").sortWithinPartitions("key", "h1", "h2", *place)
    marked = keys.mapInArrow(_able_rows, _MARKED).groupBy("h1", "h2", *place).agg(F.max("able").alias("able"), F.max("again").alias("again"))
    marked = A.session_checkpoint(marked)  # two parts of the plan go on from here
    places = marked.where("able").groupBy("doc_id", "text_key").agg(F.collect_set("line_no").alias("lines"))
    variants = texts.join(places, ["doc_id", "text_key"]).select("doc_id", "text", "text_key", "lines").mapInArrow(_variant_rows, _VARIANTS)
    near = variants.repartition("v1").sortWithinPartitions("v1", "v2", "place", *place).mapInArrow(_near_rows, _NEAR)
    near = near.groupBy(*place).agg(F.min(F.struct(*(F.col(f"best_{c}").alias(c) for c in place))).alias("best"))
    # Of all lines only those meet again that occur twice or have a near copy; the skew join splits frequent ones.
    known = marked.join(near, place, "left").where("again or best is not null").select("h1", "h2", here.alias("equal"), "best")
    out = texts.mapInArrow(_line_rows, _LINES).join(known, ["h1", "h2"])
    out = out.withColumn("first", F.least("best", "equal")).where(F.col("first") < here)
    edits = F.when(F.col("first") < F.col("equal"), 1).otherwise(0).alias("edits")
    return out.select(*place, F.col("first.doc_id").alias("first_doc_id"), F.col("first.line_no").alias("first_line_no"), edits).distinct()


def text_key(text: Column) -> Column:
    """28 bits that tell texts under one id apart."""
    return F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("bigint").cast("int")


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs without the lines of repeats(); other columns, rows without an id and documents without repeats as they are."""
    gone = repeats(docs, id_col, text_col, min_words).groupBy(F.col("doc_id").alias("__ql_id"), F.col("text_key").alias("__ql_key")).agg(F.collect_set("line_no").alias("__ql_gone"))
    both = docs.join(gone, (docs[id_col].cast("bigint") == gone["__ql_id"]) & (text_key(docs[text_col].cast("string")) == gone["__ql_key"]), "left")
    column = f"`{text_col}`"
    text = F.expr(f"concat_ws('\\n', transform(filter(transform(split({column}, '\\n', -1), (x, i) -> struct(x, i)), s -> not array_contains(__ql_gone, s.i)), s -> s.x))")
    return both.withColumn(text_col, F.when(F.col("__ql_gone").isNull(), F.col(column)).otherwise(text)).select(*(F.col(f"`{c}`") for c in docs.columns))


def oracle(table: str = "documents", min_words: int = MIN_WORDS) -> str:
    """DuckDB SQL for repeats(), with whole variants as keys."""
    return f"""
WITH l AS (SELECT DISTINCT doc_id, text, ('0x' || substr(md5(text), 1, 7))::BIGINT AS text_key FROM {table} WHERE doc_id IS NOT NULL AND text IS NOT NULL),
s AS (SELECT doc_id, text_key, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM l),
o AS (SELECT doc_id, text_key, line_no, trim(regexp_replace(regexp_replace(lower(line), '([{A.spaceless_class()}])', ' \\1 ', 'g'), '[\\x00-\\x20]+', ' ', 'g')) AS norm FROM s),
u AS (SELECT doc_id, text_key, line_no, struct_pack(d := doc_id, t := text_key, l := line_no) AS here, norm FROM o WHERE norm <> ''),
f AS (SELECT norm, min(here) AS first, string_split(norm, ' ') AS w FROM u GROUP BY norm),
p AS (SELECT norm, first, w, unnest(generate_series(1, len(w))) AS place FROM f WHERE len(w) >= {min_words}),
v AS (SELECT norm, first, place, array_to_string(list_concat(w[1:place - 1], w[place + 1:]), ' ') AS key FROM p
  UNION ALL SELECT norm, first, 0, norm FROM f WHERE len(w) >= {min_words}),
pair AS (SELECT a.norm, min(b.first) AS best FROM v a JOIN v b ON a.key = b.key AND b.first < a.first AND (a.place = b.place OR a.place = 0 OR b.place = 0) GROUP BY a.norm),
r AS (SELECT u.*, f.first AS equal, least(f.first, coalesce(pair.best, f.first)) AS first FROM u JOIN f USING (norm) LEFT JOIN pair USING (norm))
SELECT DISTINCT doc_id, text_key::INTEGER AS text_key, line_no::INTEGER AS line_no, first.d::BIGINT AS first_doc_id, first.l::INTEGER AS first_line_no, (first < equal)::INTEGER AS edits FROM r WHERE first < here
"""
