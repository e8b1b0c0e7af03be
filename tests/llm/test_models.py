"""Quality rules, personal data, perplexity and languages."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quadloom.llm import arrowtext as A
from quadloom.llm import language_id, pii, quality_model, quality_rules

from . import brute


def prose(seed, n, kind="clean"):
    r = random.Random(seed)
    text = ". ".join(brute.words_text(r, 12).capitalize() for _ in range(n)) + "."
    return {"clean": text, "marks": text.replace(" ", " ### "), "upper": text.upper(), "repeat": "The " * (12 * n)}[kind]


# ---- quality rules


def rules_table(spark, per=150):
    rows = []
    for g, (lang, source) in enumerate([("en", "a"), ("en", "b"), ("de", "a")]):
        for k in range(per):
            rows.append((1000 * g + k, prose(1000 * g + k, random.Random(k).randint(2, 12), "clean" if k % 15 else ("marks", "upper", "repeat")[k % 3]), lang, source))
    return rows


def test_quality_rules_equal_numpy(spark):
    rows = rules_table(spark)
    got = {r.doc_id: r for r in quality_rules.judge(brute.table(spark, rows)).collect()}
    for lang, source in {(x[2], x[3]) for x in rows}:
        own = [x for x in rows if x[2:] == (lang, source)]
        x = quality_rules.statistics(*A.as_bytes(pa.array([t for _, t, *_ in own])))
        want = brute.mcd_keep(x, np.array(quality_rules.RESOLUTION), quality_rules.CUTOFF, quality_rules.SHARE, quality_rules.STEPS, quality_rules.chi_square, quality_rules._consistency)
        assert np.allclose([got[i].distance for i, *_ in own], want, rtol=1e-3, atol=1e-6)
    junk = {x[0] for x in rows if x[0] % 1000 % 15 == 0}
    assert {i for i, r in got.items() if not r.keep} == junk


@pytest.mark.parametrize("kind", ["marks", "upper"])
def test_quality_rules_hold_where_much_of_a_group_is_junk(spark, kind):
    rows = [(k, prose(k, random.Random(k).randint(2, 12), kind if k % 5 < 2 else "clean"), "en", "a") for k in range(200)]
    got = quality_rules.judge(brute.table(spark, rows)).collect()
    assert {r.doc_id for r in got if not r.keep} == {k for k in range(200) if k % 5 < 2}


def test_quality_accept_equals_judge(spark):
    docs = brute.table(spark, rules_table(spark) + brute.messy())
    kept = quality_rules.accept(docs)
    want = Counter(r.doc_id for r in quality_rules.judge(docs).where("keep").collect())
    got = Counter(r.doc_id for r in kept.collect())
    assert got.pop(None) == 1 and got == want and kept.columns == docs.columns


def test_accept_with_very_many_pools_judges_each_row_by_its_own_text(spark, monkeypatch):
    rows = rules_table(spark) + brute.messy()
    junk = prose(3, 9, "marks")
    docs = brute.table(spark, [*rows, (1, junk, "en", "a"), (2, junk, "en", "a")])
    want = Counter(map(repr, quality_rules.accept(docs).collect()))
    monkeypatch.setattr(quality_rules, "MAX_BROADCAST_GROUPS", 0)
    got = quality_rules.accept(docs)
    assert Counter(map(repr, got.collect())) == want and got.columns == docs.columns
    assert {1, 2} <= {x.doc_id for x in got.collect()} and not [x for x in got.collect() if x.text == junk]


def test_quality_rules_small_and_empty(spark):
    few = quality_rules.judge(brute.table(spark, brute.messy(n=10))).collect()
    assert all(r.keep and r.distance is None for r in few) and few
    assert quality_rules.judge(brute.table(spark, [])).count() == 0 and quality_rules.accept(brute.table(spark, [])).count() == 0
    same = quality_rules.judge(brute.table(spark, [(k, "the same text", "en", "a") for k in range(80)])).collect()
    assert all(r.keep for r in same)  # ties: no spread at all


def test_chi_square():
    assert math.isclose(quality_rules.chi_square(0.975, 5), 12.8325, rel_tol=1e-4)


# ---- personal data


def test_field_on_held_out_sentences():
    field = pii.train()
    held = pii.labelled_table(300, seed=99)
    raw, offsets = A.as_bytes(pa.array([t for t, _ in held]))
    found = {(t, b, kind) for t, _, b, kind in pii.find(field, raw, offsets)}
    gold = {(t, int(offsets[t]) + e, kind) for t, (_, spans) in enumerate(held) for _, e, kind in spans}
    assert len(found & gold) / len(gold) > 0.95 and len(found & gold) / len(found) > 0.95


def test_viterbi_equals_enumeration():
    field = pii.train()
    rng = np.random.default_rng(1)
    labels = range(len(pii.LABELS))
    for size in (1, 2, 3):
        e = rng.normal(0, 3, (4, 3, len(pii.LABELS)))
        best = field.viterbi(e, np.full(4, size))
        for k in range(4):
            score = lambda y: pii._starts()[y[0]] + sum(e[k, t, y[t]] for t in range(len(y))) + sum(field.transitions[a, b] for a, b in itertools.pairwise(y))  # noqa: B023, E731
            want = max(itertools.product(labels, repeat=size), key=score)
            assert tuple(best[k, :size]) == want


def test_personal_data_is_found_and_clean_text_left_alone(spark):
    rows = [
        (1, "write to anna.smith@mail5.example.com or call +1 (017) 555-7713 today", "en", "a"),
        (2, "ü von 97.51.17.173 mit 9807915762804490 und token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\"", "de", "a"),
        (3, "in 1984 some 300 people paid 3.50 for version 4.0 of page 12", "en", "a"),
        (None, "x@y.com", "en", "a"),
        (4, None, "en", "a"),
        (5, "word " * 60_000 + "zoe@example.org", "en", "a"),
    ]
    docs = brute.table(spark, rows)
    got = [(r.doc_id, r.kind, dict((i, t) for i, t, *_ in rows)[r.doc_id][r.start : r.start + r.length]) for r in pii.spans(docs).collect()]
    assert sorted(got) == sorted([(1, "EMAIL", "anna.smith@mail5.example.com"), (1, "PHONE", "+1 (017) 555-7713"), (2, "IP", "97.51.17.173"), (2, "CARD", "9807915762804490"), (2, "SECRET", "04dbebab91ab85687d33eeaaf9ac699e1188f962"), (5, "EMAIL", "zoe@example.org")])
    red = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert red[1] == "write to [EMAIL] or call [PHONE] today" and red[3] == rows[2][1] and red[4] is None and red[None] == "[EMAIL]"


def whole_text_decoding(field, text):
    """Viterbi over all tokens of one text in plain Python, tokens that can only be O among them."""
    raw, offsets = A.as_bytes(pa.array([text]))
    tokens = pii.Tokens(raw, offsets)
    n, k = len(tokens.start), len(pii.LABELS)
    live = tokens.live.tolist()
    weights = dict(zip(field.known.tolist(), field.weights, strict=True))
    emit = {}
    for row, features in zip(np.flatnonzero(tokens.live), tokens.features(np.flatnonzero(tokens.live)).tolist(), strict=True):
        emit[row] = sum((weights[f] for f in features if f in weights), np.zeros(k))
    starts, best, back = pii._starts(), [], []
    for t in range(n):
        e = emit[t] if live[t] else np.where(np.arange(k) == 0, 0.0, -np.inf)
        if t == 0:
            best.append((starts if live[t] else 0) + e)
            back.append(None)
            continue
        # From a token that is O for sure, a chain begins anew; into one, any chain may end.
        step = field.transitions if live[t] and live[t - 1] else np.tile(starts, (k, 1)) if live[t] else np.zeros((k, k))
        score = best[-1][:, None] + step
        back.append(score.argmax(0))
        best.append(score.max(0) + e)
    labels = []
    if n:
        y = int(best[-1].argmax())
        for t in range(n - 1, -1, -1):
            labels.append(y)
            y = int(back[t][y]) if t else y
    labels.reverse()
    out, t = [], 0
    whole = raw.tobytes()
    while t < n:
        if labels[t] % 2 == 1:
            end = t
            while end + 1 < n and labels[end + 1] == labels[t] + 1:
                end += 1
            a, b = (len(whole[:x].decode()) for x in (tokens.start[t], tokens.end[end]))
            out.append((a, b - a, pii.KINDS[(labels[t] - 1) // 2]))
            t = end
        t += 1
    return out


def test_personal_data_query_equals_decoding_whole_texts(spark):
    r = random.Random(21)
    held = [t for t, _ in pii.labelled_table(120, seed=5)]
    rows = [x for x in brute.messy(n=12) if x[0] not in (103, 104)]
    rows += [(600 + k, r.choice(("", "ü ")) + " ".join(r.sample(held, r.randint(1, 4))) + brute.words_text(r, 20), "en", "a") for k in range(60)]
    got = Counter(map(tuple, pii.spans(brute.table(spark, rows)).collect()))
    field = pii.train()
    want = Counter((i, *x) for i, t, *_ in rows if i is not None and t for x in whole_text_decoding(field, t))
    assert got == want and len(want) > 60


def test_field_trained_on_a_given_table(spark):
    """A caller's labels, in characters: ticket numbers as SECRET."""
    r = random.Random(2)
    number = lambda: f"T{r.randint(100, 999)}-{r.randint(1000, 9999)}"
    rows = []
    for k in range(200):
        a, n = brute.words_text(r, r.randint(1, 6)) + " ü ", number()
        rows.append((a + n + " " + brute.words_text(r, 4) + f" {r.randint(10, 9999)}", [(len(a), len(n), "SECRET")]) if k % 3 else (brute.words_text(r, 5) + f" {r.randint(10, 9999)}", None))
    table = spark.createDataFrame([*rows, (None, None)], "text string, spans array<struct<start:int,length:int,kind:string>>")
    assert len(pii.labelled_rows(table)) == 200 and 40 < len(pii.labelled_rows(table, 100)) < 160
    field = pii.train(pii.labelled_rows(table), epochs=40)
    got = pii.spans(brute.table(spark, [(1, "see T123-4567 of 1984", "en", "a")]), field).collect()
    assert [(x.start, x.length, x.kind) for x in got] == [(4, 9, "SECRET")]


def test_personal_data_edges(spark):
    assert pii.spans(brute.table(spark, [])).count() == 0 and pii.redact(brute.table(spark, [])).count() == 0
    pii.spans(brute.table(spark, brute.messy())).collect()
    digits = brute.table(spark, [(1, "12 " * 20_000, "en", "a"), (1, "a@b.com", "en", "a"), (1, "a@b.com", "en", "a")])
    assert pii.spans(digits).where("kind = 'EMAIL'").count() == 2  # repeated rows are each reported


# ---- perplexity


def kneser_ney(texts, order):
    """Interpolated modified Kneser-Ney over bytes within tokens, as it is defined, in dictionaries."""
    counts = [Counter() for _ in range(order + 1)]
    for text in texts:
        for token in (text or "").encode().split():
            s = b"\x02" + token + b"\x03"
            for end in range(2, len(s) + 1):
                for n in range(1, order + 1):
                    if end - n >= 0 and (n == 1 or end - n >= 0):
                        counts[n][s[end - n : end]] += 1
    used = [Counter() for _ in range(order + 1)]
    for n in range(1, order + 1):
        for g, c in counts[n].items():
            if n < order and not g.startswith(b"\x02"):
                used[n][g] = sum(1 for x in counts[n + 1] if x[1:] == g) or c
            else:
                used[n][g] = c
    discounts, totals, gammas = {}, Counter(), Counter()
    for n in range(1, order + 1):
        of = Counter(used[n].values())
        y = of[1] / max(of[1] + 2 * of[2], 1)
        discounts[n] = [min(max(k - (k + 1) * y * of[k + 1] / of[k] if of[k] else 0.5, 0.05), k - 0.05) for k in (1, 2, 3)]
        for g, c in used[n].items():
            totals[g[:-1], n] += c
            gammas[g[:-1], n] += discounts[n][min(c, 3) - 1]

    def p(ctx, w):
        n = len(ctx) + 1
        lower = p(ctx[1:], w) if ctx else 1 / 256
        if not totals[ctx, n]:
            return lower
        c = used[n][ctx + w]
        own = c - discounts[n][min(c, 3) - 1] if c else 0
        return (own + gammas[ctx, n] * lower) / totals[ctx, n]

    def score(text):
        total = size = 0
        for token in (text or "").encode().split():
            s = b"\x02" + token + b"\x03"
            for end in range(1, len(s)):
                total += math.log(p(s[max(0, end - order + 1) : end], s[end : end + 1]))
                size += 1
        return total, size

    return score


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


@pytest.mark.parametrize("shard_rows", [quality_model.SHARD_ROWS, 200])
def test_perplexity_equals_brute_force(spark, shard_rows):
    r = random.Random(8)
    rows = [(k, brute.words_text(r, r.randint(1, 25)) + r.choice(["", ".", " Ü!"]), "en" if k % 3 else "de", "a") for k in range(30)] + [(40, "", "en", "a"), (41, None, "en", "a"), (42, "zzz ### qqq", "en", "a"), (43, "text", "xx", "a"), (44, "null language", None, "a"), (1, "id one again", "de", "a"), (2, rows2 := "twice", "en", "a"), (2, rows2, "en", "a")]
    labels = [(k, 1, 0) for k in range(0, 20)] + [(21, 1, 1), (22, 0, 0), (23, None, None), (None, 1, 0), (999, 1, 0), (3, 1, None), (3, 1, 0)]
    docs = brute.table(spark, rows)
    got = quality_model.judge(docs, labels_of(spark, labels), shard_rows=shard_rows).collect()
    good = {k for k, q, t in labels if q == 1 and t != 1}
    want = Counter()
    for lang in ("en", "de"):
        own = [x for x in rows if x[2] == lang]
        score = kneser_ney([t for i, t, *_ in own if i in good], quality_model.ORDER)
        scored = [(i, *score(t)) for i, t, *_ in own]
        trusted = [(a, n) for i, a, n in scored if i in good]
        mean = sum(a for a, _ in trusted) / sum(n for _, n in trusted)
        for i, a, n in scored:
            want[i, n, round(math.exp(-(a + quality_model.PRIOR * mean) / (n + quality_model.PRIOR)), 3)] += 1
    assert Counter((x.doc_id, x.n_bytes, round(x.perplexity, 3)) for x in got if x.perplexity is not None) == want
    assert all(x.keep for x in got if x.lang in ("xx", "") or x.n_bytes == 0) and {x.lang for x in got} == {"en", "de", "xx", ""}


def test_junk_is_rejected_and_clean_text_kept(spark):
    rows = [(k, prose(k, 6), "en", "a") for k in range(120)] + [(500 + k, prose(500 + k, 6, "marks"), "en", "a") for k in range(5)]
    out = quality_model.judge(brute.table(spark, rows), labels_of(spark, [(k, 1, 0) for k in range(60)])).collect()
    assert {x.doc_id for x in out if not x.keep} == {500 + k for k in range(5)}
    kept = quality_model.accept(brute.table(spark, rows), labels_of(spark, [(k, 1, 0) for k in range(60)]))
    assert kept.count() == 120


@pytest.mark.parametrize("shard_rows", [quality_model.SHARD_ROWS, 400])
def test_toxic_words_in_good_prose_are_rejected(spark, shard_rows):
    """Words of ordinary syllables, so that only how often toxic texts use them gives them away."""
    insults = ["retionno", "nothere", "theretion"]

    def insulting(k):
        w = prose(k, 6).split(" ")
        for j in range(6):
            w.insert(random.Random(10 * k + j).randrange(len(w)), insults[(k + j) % 3])
        return " ".join(w)

    rows = [(k, prose(k, 6), "en", "a") for k in range(120)] + [(500 + k, insulting(500 + k), "en", "a") for k in range(40)]
    labels = [(k, 1, 0) for k in range(60)] + [(500 + k, k % 2, 1) for k in range(20)]
    out = quality_model.judge(brute.table(spark, rows), labels_of(spark, labels), shard_rows=shard_rows).collect()
    gone = {x.doc_id for x in out if not x.keep}
    assert gone >= {520 + k for k in range(20)} and len(gone & set(range(60, 120))) <= 1
    ratio = {name: kneser_ney([t for i, t, *_ in rows if i in ids], quality_model.ORDER) for name, ids in (("good", set(range(60))), ("toxic", set(range(500, 520))))}
    excess = lambda text: sum(min(max(ratio["toxic"](w)[0] - ratio["good"](w)[0] - quality_model.EXCESS, 0), quality_model.MOST_EXCESS) for w in text.split())
    mean = sum(excess(t) for i, t, *_ in rows if i < 60) / sum(x.n_bytes for x in out if x.doc_id < 60)
    for x in out:
        want = (excess(dict((i, t) for i, t, *_ in rows)[x.doc_id]) + quality_model.CONTRAST_PRIOR * mean) / (x.n_bytes + quality_model.CONTRAST_PRIOR)
        assert math.isclose(x.contrast, want, rel_tol=1e-3, abs_tol=1e-6)


def test_perplexity_edges(spark):
    none = labels_of(spark, [])
    assert quality_model.judge(brute.table(spark, []), none).count() == 0
    got = quality_model.judge(brute.table(spark, brute.messy(n=10)), none).collect()
    assert all(x.keep and x.perplexity is None for x in got) and got


# ---- languages


def speech(lang, seed, n=60):
    syllables = {"en": "the ing and tion er re ed on".split(), "de": "sch und ein der keit ung ü ß".split(), "fr": "eau que les é è tion ou ai".split()}[lang]
    return brute.words_text(random.Random(seed), n, syllables)


def test_network_on_held_out_text(spark):
    rows = [(k, speech(lang, k), lang, "a") for k, lang in zip(range(240), itertools.cycle(("en", "de", "fr")), strict=False)]
    net = language_id.fit(brute.table(spark, rows))
    held = [(k, speech(lang, k + 5000), lang, "a") for k, lang in zip(range(90), itertools.cycle(("en", "de", "fr")), strict=False)]
    got = language_id.identify(brute.table(spark, held), net).collect()
    assert sum(x.lang == x.declared for x in got) >= 87
    wrong = language_id.identify(brute.table(spark, [(1, speech("de", 9000, 200), "en", "a"), (2, speech("en", 9001, 200), "en", "a")]), net)
    assert {x.doc_id: x.keep for x in wrong.collect()} == {1: False, 2: True}
    assert {x.doc_id for x in language_id.accept(brute.table(spark, [(1, speech("de", 9000, 200), "en", "a"), (None, "x", "en", "a")]), net).collect()} == {None}


def test_tables_equal_the_convolution():
    net = language_id.Network(["a", "b"], seed=3)
    x, _, _ = language_id.windows(*A.as_bytes(pa.array([speech("fr", 1, 300), "short"])))
    h, _ = net.pooled(x)
    z = h @ net.dense + net.shift
    want = z - np.log(np.exp(z).sum(1, keepdims=True))
    assert np.allclose(net.log_probabilities(x), want, atol=1e-4)


def test_languages_query_equals_brute_force(spark):
    """identify() against plain loops over windows, filters and places."""
    net = language_id.Network(["a", "b", "c"], seed=5)
    rows = [x for x in brute.messy(n=8) if x[0] not in (103, 104)] + [(700 + k, speech("de", k, 40), "abc"[k % 3], "x") for k in range(12)]

    def window(x):
        h = []
        for filters, bias in zip(net.filters, net.bias, strict=True):
            places = [sum(filters[j][x[at + j]] for j in range(len(filters))) for at in range(len(x) - len(filters) + 1)]
            h += np.maximum(np.max(places, axis=0) + bias, 0).tolist()
        z = np.array(h) @ net.dense + net.shift
        return z - math.log(sum(math.exp(v - z.max()) for v in z)) - z.max()

    want = []
    for i, t, declared, _ in rows:
        if i is None:
            continue
        low = A.fold(np.frombuffer((t or "").encode(), np.uint8))
        data = [max(32, int(v)) for v in low]
        parts = [data[a : a + language_id.WINDOW] for a in range(0, len(data), language_id.WINDOW)]
        total = sum((len(p) * window(p + [32] * (language_id.WINDOW - len(p))) for p in parts), np.zeros(3))
        p = math.exp(total.max() / len(data)) if data else None
        lang = net.languages[int(total.argmax())] if data else None
        want.append((i, lang, p and round(p, 4), len(parts), declared, lang is None or declared is None or lang == declared or p < language_id.CONFIDENT))
    got = [(x.doc_id, x.lang, x.probability and round(x.probability, 4), x.n_windows, x.declared, x.keep) for x in language_id.identify(brute.table(spark, rows), net).collect()]
    assert Counter(got) == Counter(want)
    kept = Counter(x.doc_id for x in language_id.accept(brute.table(spark, rows), net).collect() if x.doc_id is not None)
    assert kept == Counter(x[0] for x in want if x[-1])


def test_windows_cover_every_byte():
    texts = ["", "a" * 127, "b" * 128, "c" * 129, "d" * 1000]
    x, text, length = language_id.windows(*A.as_bytes(pa.array(texts)))
    assert np.bincount(text, length, len(texts)).tolist() == [0, 127, 128, 129, 1000] and len(x) == 0 + 1 + 1 + 2 + 8


def test_language_edges(spark):
    assert language_id.identify(brute.table(spark, [])).count() == 0
    got = language_id.identify(brute.table(spark, [(1, None, "en", "a"), (2, "", "en", "a"), (3, "text", None, "a")])).collect()
    assert [x.keep for x in got] == [True] * 3 and all(x.lang is None for x in got)
    rows = brute.messy()
    got = language_id.identify(brute.table(spark, rows)).collect()
    assert len(got) == sum(i is not None for i, *_ in rows)
