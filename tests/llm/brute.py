"""Plain versions of the operators, and small tables with everything that can be odd."""

import hashlib
import random
import re

import numpy as np

SPACELESS = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\ua4cf\uf900-\ufaff\U00020000-\U0003ffff"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, v1 int, run int, rank int, sig binary, g string, x0 double, slot int, position int, lines string, first int, text_key string, start string, length string, cuts int, region string, rack string, shard string"


def table(spark, rows):
    """Documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, lang, source, len(t) if t else None, "k", 1, 2, 3, b"s", "g", 0.5, 4, 5, "l", 6, "k", "s", "l", 7, "r", "k", "s") for i, t, lang, source in rows], SCHEMA)


def words_text(r, n, syllables="an be con der el fra gen ha in jo ka lu mi no or pa".split()):
    return " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 3))) for _ in range(n))


def messy(seed=5, n=40):
    """Null ids, texts, languages and sources, empty, blank and very long texts, ties, repeated rows, equal and near copies."""
    r = random.Random(seed)
    rows = [(i, words_text(r, r.randint(5, 60)).replace(" no", "\nno"), r.choice(["en", "de"]), r.choice(["a", "b"])) for i in range(n)]
    long = words_text(r, 30_000)
    near = rows[3][1].split(" ")
    near[len(near) // 2] = "changed"
    rows += [(None, "a text without id", "en", "a"), (100, None, "en", "a"), (101, "", "de", "b"), (102, "  \n\t\n", "en", None), (103, long, None, "a"), (104, long + " end", "en", "a"), (105, rows[3][1], "en", "a"), (106, " ".join(near), "en", "a"), (107, "word", "en", "b"), (108, "word", "en", "b"), rows[7], rows[7], (9, "another text under an id that is taken", "en", "a"), (110, "ünï çödé 你好 🙂 " * 20, "en", "a"), (111, "В НАЧАЛЕ было Слово и слово " * 9, "ru", "a"), (112, "\n в начале БЫЛО слово И слово" * 9, "ru", "a"), (113, "这是一个没有空格的句子。" * 5 + "另一个", "zh", "a"), (114, "前文" + "这是一个没有空格的句子。" * 5, "zh", "a"), (-5, "a negative id", "en", "a")]
    return rows


def norm_lines(text):
    return [" ".join(re.sub(f"([{SPACELESS}])", r" \1 ", x.lower()).split()) for x in (text or "").split("\n")]


def distance_at_most_one(a, b):
    """Word Levenshtein distance, as 0, 1 or 2 for more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > 1:
        return 2
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return 1 if a[k + 1 :] == b[k + 1 :] or a[k + 1 :] == b[k:] or a[k:] == b[k + 1 :] else 2


def key_of(text, digits):
    return int(hashlib.md5(text.encode()).hexdigest()[:digits], 16)


def line_repeats(rows, min_words):
    places = sorted({(i, key_of(t, 7), n, x) for i, t, *_ in rows if i is not None and t for n, x in enumerate(norm_lines(t)) if x})
    out = []
    for *here, x in places:
        w = x.split(" ")
        for *there, y in places:
            if there >= here:
                break
            v = y.split(" ")
            d = distance_at_most_one(w, v)
            if d == 0 or d == 1 and min(len(w), len(v)) >= min_words:
                first_equal = min(p for *p, z in places if z == x)
                out.append((*here, there[0], there[2], int(there < first_equal)))
                break
    return sorted(out)


def unit_repeats(rows, min_words, reach):
    """Substring dedup over stretches between cuts."""

    def value(w):
        b = w.encode()
        return (int.from_bytes(b[:2], "big") * 40503 + int.from_bytes(b[-2:], "big") * 10007 + len(b) * 97) * 2654435761 % 2**32

    units = []
    for i, t in sorted({(i, t) for i, t, *_ in rows if i is not None and t}, key=lambda x: (x[0], key_of(x[1], 7))):
        words = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(f"[{SPACELESS}]|[^\\x00-\\x20{SPACELESS}]+", t)]
        v = [value(w) for *_, w in words]
        n = len(v)
        cuts = [k for k in range(n) if not k or "\n" in t[words[k - 1][1] : words[k][0]] or all(v[k] < x for x in v[max(0, k - reach) : k]) and all(v[k] <= x for x in v[k + 1 : k + reach + 1]) or k >= reach and len(set(v[k - reach : k + 1])) == 1]
        for a in cuts:
            b = min((k for k in [*cuts, n] if k >= a + min_words), default=None)
            if b is not None:
                stop = len(t) if b == n else words[b][0]
                units.append((i, key_of(t, 7), words[a][0], stop - words[a][0], b - a, tuple(w for *_, w in words[a:b])))
    first = {}
    out = []
    for u in units:
        f = first.setdefault(u[5], u)
        if f[:2] != u[:2] or u[2] >= f[2] + f[3]:
            out.append((*u[:5], f[0], f[2]))
    return sorted(out)


def groups(n, near):
    """Components of the graph over n nodes."""
    label = list(range(n))

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(n):
        for b in range(a):
            if near(a, b):
                x, y = top(a), top(b)
                label[max(x, y)] = min(x, y)
    return [top(x) for x in range(n)]


def tokens(text):
    """(start, end, folded word) as the operators cut words: runs of ASCII letters and digits and of all beyond ASCII, characters without spaces alone."""
    return [(m.start(), m.end(), m[0].lower()) for m in re.finditer(f"[{SPACELESS}]|(?:(?![{SPACELESS}])[0-9A-Za-z\u0080-\U0010ffff])+", text or "")]


def leaks(text, items, min_tokens, min_short, min_share):
    """Merged (first, end, tokens, item, share) of the matches in a text, by trying every stretch."""
    t = tokens(text)
    w = [x for *_, x in t]
    lists = {i: [x for *_, x in tokens(s)] for i, s in items}
    spans = []
    for i, v in lists.items():
        for a in range(len(w)):
            for b in range(len(v)):
                n = 0
                while a + n < len(w) and b + n < len(v) and w[a + n] == v[b + n]:
                    n += 1
                for m in range(1, n + 1):
                    if m >= min_short and (m >= min_tokens or m >= min_share * len(v)) or 3 <= len(v) == m < min_short:
                        spans.append((a, a + m, i))
    covered = sorted({k for a, b, _ in spans for k in range(a, b)})
    merged = []
    for a, b, i in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return [(t[a][0], t[b - 1][1], b - a) for a, b in merged], len(covered) / max(1, len(w))


def mcd_keep(x, resolution, cutoff, share=0.75, steps=3, chi=None, consistency=None):
    """The deterministic estimate of quality_rules for one group, in numpy."""
    d = x.shape[1]
    res = np.diag(np.square(resolution))
    quantile = lambda v, q: np.sort(v)[max(0, int(np.ceil(q * len(v))) - 1)]
    med = np.array([quantile(x[:, k], 0.5) for k in range(d)])
    mad = np.array([quantile(np.abs(x[:, k] - med[k]), 0.5) for k in range(d)]) * 1.4826
    z = (x - med) / np.maximum(mad, resolution)
    scale = np.maximum(mad, 1e-3)

    def start(y):
        c = np.cov(y.T, bias=True)
        sd = np.sqrt(np.maximum(np.diag(c), 1e-9))
        return (0.9 * c / np.outer(sd, sd) + 0.1 * np.eye(d)) * np.outer(scale, scale)

    unit = z / np.maximum(np.sqrt((z**2).sum(1)), 1e-6)[:, None]
    fits = [(med, s + res) for s in (start(np.tanh(z)), start(unit), np.diag(scale**2))]
    dist = lambda m, s: np.einsum("ni,ij,nj->n", x - m, np.linalg.inv(s), x - m)

    def step(m, s):
        q = dist(m, s)
        own = x[q <= quantile(q, share)]
        return own.mean(0), consistency(share) * np.cov(own.T, bias=True) + res

    for _ in range(steps):
        fits = [step(*f) for f in fits]
    m, s = step(*min(fits, key=lambda f: np.linalg.slogdet(f[1])[1]))
    own = x[dist(m, s) <= chi(0.975, d)]
    m, s = own.mean(0), consistency(0.975) * np.cov(own.T, bias=True) + res
    return dist(m, s)
