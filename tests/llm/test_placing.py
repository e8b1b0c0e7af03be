"""Sharding, decontamination, mixing and the pipeline."""

import hashlib
import math
import random
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from quadloom.llm import arrowtext as A
from quadloom.llm import decontaminate, minhash, mixing, quality_rules, queries, sharding

from . import brute

# ---- sharding


def address(key, tree):
    """The tree descent, with the smallest draw at each level."""
    path, node, out = "", tree, []
    weight = lambda x: sum(map(weight, x.values())) if isinstance(x, dict) else x
    while isinstance(node, dict):

        def draw(name):
            bits = int(hashlib.md5(f"{key}|{path}/{name}".encode()).hexdigest()[:13], 16)
            return -math.log((bits + 0.5) / 2**52) / weight(node[name])  # noqa: B023

        best = min((n for n in sorted(node) if weight(node[n]) > 0), key=draw)
        out.append(best)
        path, node = f"{path}/{best}", node[best]
    return tuple(out)


def test_sharding_equals_brute_force(spark):
    rows = brute.messy()
    got = sharding.assign(brute.table(spark, rows)).collect()
    tree = {r: {k: dict(s) for k, s in x.items()} for r, x in sharding.DEFAULT_TREE.items()}
    assert len(got) == len(rows)
    assert all((r.region, r.rack, r.shard) == address("" if r.doc_id is None else r.doc_id, tree) for r in got)
    assert sharding.assign(brute.table(spark, [])).count() == 0


def test_movement_stays_in_the_subtree_and_shares_follow_weights(spark):
    keys = spark.range(20_000).withColumnRenamed("id", "doc_id")
    tree = {r: {k: dict(s) for k, s in x.items()} for r, x in sharding.DEFAULT_TREE.items()}
    before = {r.doc_id: (r.region, r.rack, r.shard) for r in sharding.assign(keys, tree=tree).collect()}
    total = sum(w for x in tree.values() for s in x.values() for w in s.values())
    for (r, k, s), n in Counter(before.values()).items():
        want = 20_000 * tree[r][k][s] / total
        assert abs(n - want) < 5 * want**0.5
    a, b = tree["east"]["rack0"]["shard0"], tree["east"]["rack0"]["shard1"]
    tree["east"]["rack0"]["shard0"], tree["east"]["rack0"]["shard1"] = a + b - 0.25, 0.25  # the rack weighs the same
    after = {r.doc_id: (r.region, r.rack, r.shard) for r in sharding.assign(keys, tree=tree).collect()}
    moved = [k for k in before if before[k] != after[k]]
    assert moved and all(before[k][:2] == after[k][:2] == ("east", "rack0") for k in moved)


# ---- decontamination


def test_decontamination_equals_brute_force(spark):
    r = random.Random(4)
    items = [(k, brute.words_text(r, r.randint(3, 40))) for k in range(12)] + [(50, None), (51, ""), (None, "an item without id"), (52, "one two three four"), (53, "one two three four five"), (54, "nur drei Wörter"), (55, "zwei nur"), (56, "这是一个没有空格的测试题目"), (57, "ВОПРОС на другом языке без ответа")]
    rows = brute.messy(n=10)
    rows = [x for x in rows if x[0] not in (103, 104)]
    for k in range(40):
        w = brute.words_text(r, r.randint(0, 30)).split(" ")
        for _ in range(r.randint(0, 2)):
            v = (items[r.randrange(12)][1]).split(" ")
            a = r.randrange(len(v))
            at = r.randrange(len(w) + 1)
            w[at:at] = v[a : a + r.randint(2, 25)]
        rows.append((400 + k, " ".join(w).capitalize() + ".", "en", "a"))
    rows += [(501, "davor NUR drei WÖRTER danach zwei nur", "de", "a"), (502, "前面这是一个没有空格的测试题目后面", "zh", "a"), (503, "вопрос На Другом языке Без ОТВЕТА", "ru", "a"), (504, "nur drei one two three four", "en", "a")]
    rows.append((500, "Ünd ONE, two; three\nfour -- five six", "en", "a"))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    docs = brute.table(spark, rows)
    named = [(i, t) for i, t in items if i is not None]
    want = Counter()
    for i, t, *_ in rows:
        if i is not None:
            spans, share = brute.leaks(t, named, decontaminate.MIN_TOKENS, decontaminate.MIN_SHORT_TOKENS, decontaminate.MIN_ITEM_SHARE)
            want.update((i, a, b - a, n, round(share, 6)) for a, b, n in spans)
    for size in (decontaminate.MAX_AUTOMATON_TOKENS, 40):  # one automaton, and several
        got = Counter((x.doc_id, x.start, x.length, x.n_tokens, round(x.doc_share, 6)) for x in decontaminate.spans(docs, bench, max_automaton_tokens=size).collect())
        assert got == want and (500, 4, 28, 5, 0.714286) in got
    cleaned = {x.doc_id: x for x in decontaminate.clean(docs, bench).collect()}
    dropped = {i for i, *_ , share in want if share > decontaminate.MAX_DOC_SHARE}
    assert not dropped & set(cleaned) and None in cleaned and cleaned[100].text is None
    for i, t, *_ in rows:
        if i is not None and i >= 400 and i not in dropped:
            text = t
            for _, a, n, *_ in sorted((x for x in want if x[0] == i), reverse=True):
                text = text[:a] + text[a + n :]
            assert cleaned[i].text == text and cleaned[i].n_chars == len(text)


def test_automaton_finds_the_longest_match():
    r = random.Random(6)
    items = [(k, [r.randint(1, 3) for _ in range(r.randint(5, 12))]) for k in range(6)]
    a = decontaminate.Automaton(items, 2)
    text = [r.randint(1, 3) for _ in range(60)]
    have = {tuple(t[x:y]) for _, t in items for x in range(len(t)) for y in range(x + 1, len(t) + 1)}
    for first, end, _ in a.spans(text, 4, 4, 2.0):
        assert tuple(text[first:end]) in have and (first == 0 or tuple(text[first - 1 : end]) not in have)
    assert {e for _, e, _ in a.spans(text, 4, 4, 2.0)} == {e for e in range(4, 61) if tuple(text[e - 4 : e]) in have}


def test_decontamination_edges(spark):
    bench, none = spark.createDataFrame([(1, "x " * 20)], "item_id bigint, text string"), spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.spans(brute.table(spark, []), bench).count() == 0
    docs = brute.table(spark, brute.messy(n=10))
    assert decontaminate.spans(docs, none).count() == 0 and decontaminate.clean(docs, none).count() == docs.count()


# ---- mixing


def test_schedule_keeps_every_deadline_and_the_bound_of_the_exact_weights():
    r = random.Random(3)
    for _ in range(30):
        names = [f"s{k}" for k in range(r.randint(1, 25))]
        weights = {s: r.choice((1e-5, 0.1, 1 / 3, 2**0.5, 40, r.random())) for s in names}
        blocks = {s: r.randint(0, 400) for s in names}
        plan = mixing.schedule(weights, blocks)
        assert [x[4] for x in plan] == list(range(sum(blocks.values()))) and Counter(x[0] for x in plan) == Counter({s: n for s, n in blocks.items() if n})
        assert all(release <= slot < deadline for _, _, release, deadline, slot in plan)
        # Between two slots at which a source runs out, each live one is within a block of its exact share.
        left, count, live, t0 = dict(blocks), Counter(), None, 0
        for s, block, *_, slot in plan:
            now = sorted(x for x in names if left[x])
            if now != live:
                live, t0, count, total = now, slot, Counter(), sum(Fraction(weights[x]) for x in now)
            assert block == blocks[s] - left[s]
            left[s] -= 1
            count[s] += 1
            assert all(abs(count[x] - Fraction(weights[x]) / total * (slot + 1 - t0)) < 1 for x in live)


def test_tiny_weights_are_not_rounded_up():
    plan = mixing.schedule({"web": 0.99999, "tiny": 0.00001}, {"web": 300_000, "tiny": 9})
    slots = [x[4] for x in plan if x[0] == "tiny"]
    assert [k for k in range(3) if not k * 100_000 <= slots[k] < (k + 1) * 100_000 + 1] == []


def test_mixing_equals_brute_force(spark):
    r = random.Random(7)
    rows = brute.messy() + [(1000 + k, "t", "en", r.choice(["a", "b", "b", "c"])) for k in range(300)]
    weights = {"a": 0.5, "b": 0.3, "c": 0.2}
    got = mixing.mix(brute.table(spark, rows), weights, blocks=90).collect()
    size = -(-len(rows) // 90)
    by = {}
    for i, _, _, source in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)):
        by.setdefault(source or "", []).append(i)
    # In each slot, of the sources whose next block is released, the one with the earliest deadline.
    left = {s: [by[s][k : k + size] for k in range(0, len(by[s]), size)] for s in weights}
    want, t = Counter(), 0
    while any(left.values()):
        live = [s for s in weights if left[s]]
        total, t0, taken = sum(Fraction(weights[s]) for s in live), t, Counter()
        while all(left[s] for s in live):
            free = [s for s in live if taken[s] * total / Fraction(weights[s]) < t - t0 + 1 and taken[s] * total // Fraction(weights[s]) <= t - t0]
            s = min(free, key=lambda s: (math.ceil((taken[s] + 1) * total / Fraction(weights[s])), s))
            block = len(range(0, len(by[s]), size)) - len(left[s])
            want.update((i, s, block, p, t) for p, i in enumerate(left[s].pop(0)))
            taken[s] += 1
            t += 1
    assert len(got) == len(rows)
    assert Counter((x.doc_id, x.source, x.block, x.position, x.slot) for x in got if x.source in weights) == want
    assert all(x.slot > 1 << 59 for x in got if x.source not in weights)  # '' has no target weight
    assert all(x.release <= x.slot < x.deadline for x in got if x.source in weights)


def test_reorder_keeps_every_row(spark):
    docs = brute.table(spark, brute.messy())
    out = mixing.reorder(docs)
    assert out.columns == docs.columns and Counter(map(repr, out.collect())) == Counter(map(repr, docs.collect()))
    place = {}
    for x in mixing.mix(docs, blocks=12).collect():
        place[x.doc_id, x.source] = min(place.get((x.doc_id, x.source), 1 << 62), x.slot)
    assert all(x.slot == place[x.doc_id, x.source or ""] for x in mixing.placed(docs, blocks=12).collect())
    got = [place[x.doc_id, x.source or ""] for x in mixing.reorder(docs, blocks=12).collect()]
    assert got == sorted(got) and len(set(got)) > 8
    assert mixing.mix(brute.table(spark, [])).count() == 0 and mixing.reorder(brute.table(spark, [])).count() == 0


# ---- queries and pipeline

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(queries.ORACLES[name])
    names = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, SF).select(*names).collect()
    assert Counter(map(tuple, got)) == Counter(want.fetchall())


def test_pipeline_equals_brute_force(spark, tmp_path):
    """run() on a small table against the plain versions of its five stages, one after the other."""
    r = random.Random(12)
    clean = lambda k: ". ".join(brute.words_text(random.Random(k), 12).capitalize() for _ in range(random.Random(k).randint(3, 9))) + "."
    rows = [(k, clean(k), "en", "ab"[k % 2]) for k in range(200)]
    rows += [(300 + k, clean(k).replace(" ", " ### "), "en", "a") for k in range(6)]
    rows += [(400 + k, clean(k).replace("no", "No", 1), "en", "a") for k in range(15)]
    items = [(k, brute.words_text(r, 30)) for k in range(4)]
    rows += [(500 + k, clean(700 + k) + " " + items[k][1] + ". " + clean(900 + k), "en", "b") for k in range(4)] + [(510, items[0][1] + " and so on", "en", "b")]
    spark.createDataFrame([(i, t, lang, s, len(t)) for i, t, lang, s in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    kept = []
    for source in "ab":
        own = [x for x in rows if x[3] == source]
        d = brute.mcd_keep(quality_rules.statistics(*A.as_bytes(pa.array([x[1] for x in own]))), np.array(quality_rules.RESOLUTION), quality_rules.CUTOFF, quality_rules.SHARE, quality_rules.STEPS, quality_rules.chi_square, quality_rules._consistency)
        kept += [x for x, y in zip(own, d, strict=True) if y <= quality_rules.CUTOFF]
    kept.sort()
    assert not any(300 <= x[0] < 306 for x in kept)
    _, sig = minhash.signatures(*A.folded(pa.array([x[1] for x in kept])))
    top = brute.groups(len(kept), lambda a, b: (sig[a] != sig[b]).sum() <= minhash.RADIUS)
    kept = [x for k, x in enumerate(kept) if top[k] == k]
    assert not any(400 <= x[0] < 415 for x in kept)
    cleaned = []
    for i, t, lang, source in kept:
        spans, share = brute.leaks(t, items, decontaminate.MIN_TOKENS, decontaminate.MIN_SHORT_TOKENS, decontaminate.MIN_ITEM_SHARE)
        if share <= decontaminate.MAX_DOC_SHARE:
            for a, b, _ in reversed(spans):
                t = t[:a] + t[b:]
            cleaned.append((i, t, lang, source, len(t)))
    tree = {x: {k: dict(s) for k, s in y.items()} for x, y in sharding.DEFAULT_TREE.items()}
    want = Counter((*x, *address(x[0], tree)) for x in cleaned)
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter(map(tuple, got.collect())) == want and {500, 501, 502, 503} <= {x[0] for x in cleaned} and 510 not in {x[0] for x in cleaned}


def test_stages_return_the_columns_of_documents(spark, tmp_path):
    docs = brute.table(spark, brute.messy())
    spark.createDataFrame([(1, "x y z")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert (out.columns == docs.columns) == (name != "shards")
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_mix_stage_is_in_the_mix_order(spark, tmp_path):
    rows = [(k, f"text {k}", "en", "abc"[k % 3]) for k in range(200)]
    docs = brute.table(spark, rows)
    dict(corpus_pipeline.STAGES)["mix"](spark, docs, "").write.parquet(f"{tmp_path}/mix")
    got = [x.doc_id for x in spark.read.parquet(f"{tmp_path}/mix").collect()]
    place = {x.doc_id: (x.slot, x.source, x.doc_id) for x in mixing.mix(docs).collect()}
    assert got == sorted(got, key=place.get)


def test_run_is_in_the_mix_order_with_files_of_different_sizes(spark, tmp_path):
    size = lambda k: 2 + (k // 20) ** 2
    rows = [(k, ". ".join(brute.words_text(random.Random(10_000 * k + j), 12).capitalize() for j in range(size(k))) + ".", "en", "aaab"[k % 4]) for k in range(400)]
    spark.createDataFrame([(i, t, lang, s, len(t)) for i, t, lang, s in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "x y z")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs = corpus_pipeline.run(spark, str(tmp_path))
        got = [x.doc_id for x in docs.collect()]
        place = {x.doc_id: (x.slot, x.source, x.doc_id) for x in mixing.mix(docs).collect()}
        kept = {x.doc_id: (x.slot, x.source, x.doc_id) for x in corpus_pipeline.assign_shards(spark, docs, "").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) > 300 and got == sorted(got, key=place.get) and kept == place
