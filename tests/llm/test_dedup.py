"""Near-dedup, line dedup and substring dedup against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from quadloom.llm import arrowtext as A
from quadloom.llm import line_dedup, minhash, substring_dedup

from . import brute


def test_minhash_equals_brute_force(spark):
    rows = brute.messy()
    got = {(r.doc_id, r.duplicate_of) for r in minhash.duplicates(brute.table(spark, rows)).collect()}
    docs = sorted({(i, t) for i, t, *_ in rows if i is not None and brute.tokens(t)})
    _, sig = minhash.signatures(*A.folded(pa.array([t for _, t in docs])))
    top = brute.groups(len(docs), lambda a, b: docs[a][0] == docs[b][0] or (sig[a] != sig[b]).sum() <= minhash.RADIUS)
    want = {(docs[k][0], docs[t][0]) for k, t in enumerate(top) if docs[k][0] != docs[t][0]}
    assert got == want and {(105, 3), (106, 3), (104, 103), (108, 107)} <= got


def test_every_pair_in_the_radius_shares_a_key():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 16, (300, minhash.SYMBOLS)).astype(np.uint16)
    other = base.copy()
    for k in range(300):
        other[k, rng.choice(minhash.SYMBOLS, minhash.RADIUS, replace=False)] ^= 1
    a, b = minhash.keys(base), minhash.keys(other)
    assert all(set(x) & set(y) for x, y in zip(a.tolist(), b.tolist(), strict=True))


def test_components_equal_brute_force():
    rng = np.random.default_rng(2)
    s = rng.integers(0, 3, (60, minhash.SYMBOLS)).astype(np.uint16)
    s[30:] = s[:30]
    for k in range(30, 60):
        s[k, rng.choice(minhash.SYMBOLS, rng.integers(0, 40), replace=False)] = 9
    want = brute.groups(60, lambda a, b: (s[a] != s[b]).sum() <= minhash.RADIUS)
    assert minhash.components(s).tolist() == want


def edited(rng, s, low, high):
    """Copies with that many other symbols."""
    out = s.copy()
    for k in range(len(s)):
        at = rng.choice(minhash.SYMBOLS, rng.integers(low, high + 1), replace=False)
        out[k, at] = rng.integers(0, 1 << 16, len(at))
    return out


@pytest.mark.parametrize("shared", [0, 1, 5, 7, 9])
def test_components_by_further_chunks_equal_brute_force(monkeypatch, shared):
    """Rows that agree on some chunks, as those of one key do; copies of some within and around the radius."""
    monkeypatch.setattr(minhash, "SMALL", 3)
    rng = np.random.default_rng(shared)
    s = rng.integers(0, 1 << 16, (150, minhash.SYMBOLS)).astype(np.uint16)
    s[:, : shared * minhash.WIDTH] = s[0, : shared * minhash.WIDTH]
    s = np.concatenate([s, edited(rng, s[:60], 1, 25), edited(rng, s[:30], 15, 19), s[:5]])[rng.permutation(245)]
    want = brute.groups(len(s), lambda a, b: (s[a] != s[b]).sum() <= minhash.RADIUS)
    for pivots in (0, 2, 1000):
        assert minhash.components(s, pivots=pivots).tolist() == want


def test_a_key_of_a_hundred_thousand_members():
    """Half of them near copies of one text, half near to one other or none."""
    rng = np.random.default_rng(9)
    s = rng.integers(0, 1 << 16, (50_000, minhash.SYMBOLS)).astype(np.uint16)
    s[:, : minhash.WIDTH] = s[0, : minhash.WIDTH]
    s[25_000:] = s[:25_000]
    s[25_000:, -9:] = rng.integers(0, 1 << 16, (25_000, 9))
    near = np.repeat(s[:1], 50_000, axis=0)
    near[np.arange(50_000), rng.integers(0, minhash.SYMBOLS, 50_000)] = 7
    rows = np.concatenate([near, s[1:25_000], s[25_001:]])
    batch = pa.record_batch([pa.array(np.full(len(rows), 5)), pa.array(np.arange(len(rows))), pa.array([x.tobytes() for x in rows], pa.binary())], names=["bucket", "doc_id", "sig"])
    links = [(u, v) for b in minhash._links(batch.slice(k, 10_000) for k in range(0, len(rows), 10_000)) for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
    assert set(links) == {(k, 0) for k in range(1, 50_000)} | {(50_000 + 24_999 + k, 50_000 + k) for k in range(24_999)}


def test_minhash_recall_on_edited_copies(spark):
    r = random.Random(3)
    rows = []
    for k in range(60):
        w = brute.words_text(r, 80).split(" ")
        rows.append((2 * k, " ".join(w), "en", "a"))
        for at in r.sample(range(80), 3):
            w[at] = "other"
        rows.append((2 * k + 1, " ".join(w), "en", "a"))
    got = {(x.doc_id, x.duplicate_of) for x in minhash.duplicates(brute.table(spark, rows)).collect()}
    assert len(got) >= 57 and got <= {(2 * k + 1, 2 * k) for k in range(60)}


def test_keep_first(spark):
    rows = brute.messy()
    docs = brute.table(spark, rows)
    left = minhash.keep_first(docs)
    assert left.columns == docs.columns
    ids = [x.doc_id for x in left.collect()]
    gone = {x.doc_id for x in minhash.duplicates(docs).collect()}
    assert sorted(ids, key=str) == sorted({i for i, *_ in rows if i is not None} - gone, key=str) + [None] or sorted(map(str, ids)) == sorted(map(str, [*({i for i, *_ in rows if i is not None} - gone), None]))


@pytest.mark.parametrize("seed", [5, 6])
def test_line_dedup_equals_brute_force(spark, seed):
    rows = brute.messy(seed)
    r = random.Random(seed)
    lines = [brute.words_text(r, n) for n in (1, 3, 4, 5, 6, 7, 7, 12)] + ["a a a a a", "a a a a", "a a a a a a", "B  b b\tb b"]
    for k in range(40):  # texts of lines with no, one or two edits
        text = []
        for _ in range(4):
            w = r.choice(lines).split()
            for _ in range(r.choice((0, 0, 1, 1, 2))):
                at = r.randrange(len(w))
                w[at : at + r.randint(0, 1)] = r.choice(([], ["new"], [r.choice("ab")]))
                w = w or ["x"]
            text.append(" ".join(w))
        rows.append((200 + k, "\n".join(text), "en", "a"))
    rows = [x for x in rows if x[0] not in (103, 104)]
    rows += [(9, rows[0][1] + "\nanother text under an id that is taken once more", "en", "a"), (9, rows[0][1], "en", "b")]
    got = sorted(map(tuple, line_dedup.repeats(brute.table(spark, rows)).collect()))
    assert got == brute.line_repeats(rows, line_dedup.MIN_WORDS) and any(x[4] for x in got)


def test_line_dedup_long_texts_and_shared_ids(spark):
    got = line_dedup.repeats(brute.table(spark, brute.messy())).collect()
    assert (104, 0, 103, 0, 1) in {(x.doc_id, *x[2:]) for x in got}  # 30000 words and one more


def test_groups_of_equal_variants_go_over_batches():
    """A group cut anywhere has the same hits as in one piece."""
    rng = np.random.default_rng(4)
    rows = np.stack([rng.integers(0, 9, 600), rng.integers(0, 2, 600), rng.integers(-1, 4, 600), rng.integers(0, 40, 600), rng.integers(0, 2, 600), rng.integers(0, 3, 600)], 1)
    rows = np.unique(rows, axis=0)
    seen = set()
    rows = np.array([x for x in rows.tolist() if x[2] >= 0 or not (tuple(x[:2]) in seen or seen.add(tuple(x[:2])))])
    batch = pa.record_batch([pa.array(c.astype(t)) for c, t in zip(rows.T, (np.int64, np.int32, np.int32, np.int64, np.int32, np.int32), strict=True)], names=["v1", "v2", "place", "doc_id", "text_key", "line_no"])

    def best(batches):
        out = {}
        for b in line_dedup._near_rows(batches):
            for *line, d, k, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                out[tuple(line)] = min(out.get(tuple(line), (1 << 40,)), (d, k, n))
        return out

    want = {}
    for a in rows.tolist():
        near = [tuple(b[3:]) for b in rows.tolist() if a[:2] == b[:2] and b[3:] < a[3:] and (a[2] == b[2] or -1 in (a[2], b[2]))]
        if near:
            want[tuple(a[3:])] = min([*near, want.get(tuple(a[3:]), (1 << 40,))])
    assert best([batch]) == want
    for size in (1, 2, 7, 50):
        assert best([batch.slice(k, size) for k in range(0, batch.num_rows, size)]) == want


def test_lines_that_share_a_half_go_over_batches():
    rng = np.random.default_rng(5)
    rows = sorted((int(k), int(h)) for k, h in zip(rng.integers(0, 60, 300), rng.integers(0, 90, 300), strict=True))
    batch = pa.record_batch([pa.array([k for k, _ in rows], pa.int64()), pa.array([h for _, h in rows], pa.int64())], names=["key", "h1"])
    want = {h for k, h in rows if any(a == k and b != h for a, b in rows)}
    for size in (1, 3, 300):
        got = {h for b in line_dedup._able_rows([batch.slice(k, size) for k in range(0, len(rows), size)]) for h in b.column(0).to_pylist()}
        assert got == want


def test_first_places_of_lines_go_over_batches():
    """Of lines that share a key or occur again: the first place and which of both holds, wherever the batches are cut."""
    rng = np.random.default_rng(6)
    rows = sorted(zip(*(rng.integers(0, n, 400).tolist() for n in (80, 40, 2, 30, 2, 3)), strict=True))
    types = (np.int64, np.int64, np.int64, np.int64, np.int32, np.int32)
    batch = pa.record_batch([pa.array(np.array(c, t)) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["key", "h1", "h2", "doc_id", "text_key", "line_no"])
    want = {}
    for key, *line in {x[:3] for x in rows}:
        places = [x[3:] for x in rows if list(x[:3]) == [key, *line]]
        able, again = any(x[0] == key and list(x[1:3]) != line for x in rows), len(set(places)) > 1
        if able or again:
            old = want.get((*line, *min(places)), (False, False))
            want[(*line, *min(places))] = (old[0] or able, old[1] or again)
    for size in (1, 2, 5, 400):
        got = {}
        for b in line_dedup._able_rows([batch.slice(k, size) for k in range(0, len(rows), size)]):
            for *line, able, again in zip(*(c.to_pylist() for c in b.columns), strict=True):
                old = got.get(tuple(line), (False, False))
                got[tuple(line)] = (old[0] or able, old[1] or again)
        assert got == want


def test_a_frequent_line_sends_two_rows_of_a_chunk():
    """The first and the last place under each of its keys, though the ids are in no order and one text is null."""
    texts = ["a line of six words here\nshort\n\nshort" for _ in range(50)] + [None, "a line of five words"]
    ids = random.Random(7).sample(range(1000), len(texts))
    batch = pa.record_batch([pa.array(ids, pa.int64()), pa.array(texts), pa.array([None if t is None else 3 for t in texts], pa.int32())], names=["doc_id", "text", "text_key"])
    (rows,) = line_dedup._key_rows(5)([batch])
    places = sorted(zip(rows["doc_id"].to_pylist(), rows["line_no"].to_pylist(), strict=True))
    first, last = min(ids[:50]), max(ids[:50])
    assert places == sorted([(first, 0), (last, 0)] * 4 + [(first, 1), (last, 3)] + [(ids[-1], 0)] * 2)


def test_line_dedup_reads_texts_three_times(spark):
    read = spark.sparkContext.accumulator(0)
    docs = [(k, f"line number {k % 7} of this text\nand one more line of {k % 5} words\nend", "en", "a") for k in range(40)]

    def count(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    table = brute.table(spark, docs)
    assert line_dedup.repeats(table.mapInArrow(count, table.schema)).count() > 0
    assert read.value <= 3 * len(docs)


def test_removal_tells_texts_under_one_id_apart(spark):
    long = brute.words_text(random.Random(8), 60)
    other = brute.words_text(random.Random(9), 60)
    docs = brute.table(spark, [(1, long, "en", "a"), (2, long, "en", "a"), (2, "first line of the other text\n" + other, "en", "a"), (2, long, "en", "b")])
    for f in (line_dedup.remove, substring_dedup.remove):
        got = sorted((x.doc_id, x.text) for x in f(docs).collect())
        assert got == [(1, long), (2, ""), (2, ""), (2, "first line of the other text\n" + other)]


def test_line_removal_keeps_the_rest(spark):
    docs = brute.table(spark, [(1, "one two three four five\nstays here\n", "en", "a"), (2, "keep\n\none two 3 four five\nend", "en", "a"), (None, "one two three four five", "en", "a"), (3, None, "en", "a")])
    got = {x.doc_id: x.text for x in line_dedup.remove(docs).collect()}
    assert got == {1: "one two three four five\nstays here\n", 2: "keep\n\nend", None: "one two three four five", 3: None}


def test_substring_dedup_equals_brute_force(spark):
    rows = [x for x in brute.messy() if x[0] not in (103, 104)]
    r = random.Random(1)
    shared = brute.words_text(r, 60).replace(" no", "\nno")
    for k in range(30):  # passages inside lines, some cut short, self repeats, runs of one word
        words = shared.split(" ")
        a = r.randrange(30)
        part = " ".join(words[a : a + r.randint(10, 60)])
        rows.append((300 + k // 2, brute.words_text(r, r.randint(0, 20)) + " " + r.choice((part, part.upper(), part + "\n\n" + part, "the " * r.randint(0, 70))) + " " + brute.words_text(r, r.randint(0, 9)), "en", "a"))
    got = sorted(map(tuple, substring_dedup.repeats(brute.table(spark, rows)).collect()))
    assert got == brute.unit_repeats(rows, substring_dedup.MIN_WORDS, substring_dedup.REACH)
    assert {112, 114} <= {x[0] for x in got} and any(x[0] == x[5] for x in got)


def test_a_passage_of_fifty_words_is_found_wherever_it_begins(spark):
    r = random.Random(2)
    rows = []
    for k in range(100):
        passage = brute.words_text(r, 51)
        rows += [(2 * k, brute.words_text(r, 40) + " " + passage + " " + brute.words_text(r, 40), "en", "a"), (2 * k + 1, brute.words_text(r, 33) + " " + passage + "\n" + brute.words_text(r, 40), "en", "a")]
    got = {x.doc_id for x in substring_dedup.repeats(brute.table(spark, rows)).collect()}
    assert len(got) >= 98 and not [x for x in got if x % 2 == 0]


def test_substring_removal(spark):
    shared = brute.words_text(random.Random(1), 25)
    docs = brute.table(spark, [(1, shared, "en", "a"), (2, f"ü before\n{shared}\nafter", "en", "a"), (None, shared, "en", "a"), (4, None, "en", "a")])
    got = {x.doc_id: x.text for x in substring_dedup.remove(docs).collect()}
    assert got == {1: shared, 2: "ü before\nafter", None: shared, 4: None}


@pytest.mark.parametrize("f", [minhash.duplicates, minhash.keep_first, line_dedup.repeats, line_dedup.remove, substring_dedup.repeats, substring_dedup.remove])
def test_empty_tables(spark, f):
    assert f(brute.table(spark, [])).count() == 0
    f(brute.table(spark, [(None, None, None, None), (1, None, None, None), (2, "", "en", "a")])).collect()
