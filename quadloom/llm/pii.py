"""Personal data by a linear-chain conditional random field over word shapes.

Tokens are runs of letters and digits, held together by single ``@ . _ -``
between them. Each has features of its own shape (with and without the lengths
of digit runs), its size and alphabet, and of its neighbours' shapes and cue
words. The field has a label O and B-/I- labels for each kind, is trained by
gradient ascent on a small labelled table (the caller's, or ``labelled_table``, generated
from templates), and is decoded by Viterbi in numpy batches.

One constraint of the field keeps the lattice small: a token without a digit,
without an ``@`` and shorter than ``LONG`` bytes can only be O. Such tokens cut
a text into independent chains, so decoding the stretches between them is
decoding the whole text.
"""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrowtext as A

KINDS = ("EMAIL", "PHONE", "IP", "CARD", "SECRET")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
LONG = 24
EPOCHS = 90
SENTENCES = 700
L2 = 2e-4
#: Labelled rows that a field is trained on, at most about.
MAX_LABELLED = 20_000

SPANS = "doc_id bigint, start bigint, length bigint, kind string"
_SPANS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("kind", pa.string())])

_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_HEX = _DIGIT.copy()
_HEX[65:71] = _HEX[97:103] = True
_JOIN = np.zeros(256, bool)
_JOIN[list(b"@._-")] = True
# Shape classes: upper 1, lower 2 (and all beyond ASCII), digit 3, others as they are.
_CLASS = np.arange(256, dtype=np.uint64)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 2
_B = np.uint64(0x9E3779B97F4A7C15)
_TEMPLATES = 9
_BLANK = -(10**6)


class Tokens:
    """start, end, text number, whether it may be other than O, of each token."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.raw = raw
        strong = A.IS_WORD[raw]
        before, after = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
        before[1:], after[:-1] = strong[:-1], strong[1:]
        cut = offsets[(offsets > 0) & (offsets < len(raw))]
        before[cut], after[cut - 1] = False, False
        digit = _DIGIT[raw]
        next_digit = np.zeros(len(raw), bool)
        next_digit[:-1] = digit[1:]
        next_digit[cut - 1] = False
        inside = strong | (_JOIN[raw] & before & after) | ((raw == 43) & ~before & next_digit)
        padded = np.zeros(len(raw) + 2, bool)
        padded[1:-1] = inside
        edge = np.zeros(len(raw) + 1, bool)
        edge[cut] = True
        self.start = np.flatnonzero(inside & (~padded[:-2] | edge[:-1]))
        self.end = np.flatnonzero(inside & (~padded[2:] | edge[1:])) + 1
        self.text = np.searchsorted(offsets, self.start, "right") - 1
        some = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(digit | (raw == 64), out=some[1:])
        self.live = (some[self.end] > some[self.start]) | (self.end - self.start >= LONG)

    def features(self, rows: np.ndarray) -> np.ndarray:
        """Feature hashes of these tokens, shape (rows, _TEMPLATES)."""
        own, around = self._own(rows), []
        for step in (-2, -1, 1):
            near = rows + step
            ok = (near >= 0) & (near < len(self.start))
            near = np.where(ok, near, 0)
            ok &= self.text[near] == self.text[rows]
            x = self._own(near)
            x[~ok] = np.uint64(_BLANK % 2**64)
            around.append(x)
        cols = [own[:, 0], own[:, 1], own[:, 2], own[:, 3], around[1][:, 0], around[2][:, 0], around[1][:, 3], around[0][:, 3], np.zeros(len(rows), np.uint64)]
        return np.stack([A.mix(c * _B + np.uint64(k + 1)) for k, c in enumerate(cols)], axis=1)

    def _own(self, rows: np.ndarray) -> np.ndarray:
        """Shape with digit lengths, shape, size and alphabet, folded word."""
        start, end = self.start[rows], self.end[rows]
        size = end - start
        first = np.cumsum(size) - size
        at = np.arange(size.sum()) - np.repeat(first - start, size)
        byte = self.raw[at]
        c = _CLASS[byte]
        token = np.repeat(np.arange(len(rows)), size)
        new = np.ones(len(c), bool)
        new[1:] = (c[1:] != c[:-1]) | (token[1:] != token[:-1])
        run = np.flatnonzero(new)
        run_token = token[run]
        length = np.diff(np.append(run, len(c)))
        order = np.arange(len(run)) - np.searchsorted(run_token, np.arange(len(rows)))[run_token] if len(rows) else run
        power = _B ** (order.astype(np.uint64) + np.uint64(1))
        kind = c[run]
        total = lambda v: np.add.reduceat(v, np.searchsorted(run_token, np.arange(len(rows)))) if len(rows) else np.zeros(0, np.uint64)
        lengths = np.where(kind == 3, np.minimum(length, 20), 0).astype(np.uint64)
        exact, plain = total((kind + lengths * np.uint64(512)) * power), total(kind * power)
        count = lambda flags: np.add.reduceat(flags.astype(np.int64), first) if len(rows) else np.zeros(0, np.int64)
        digits, hexes = count(_DIGIT[byte]), count(_HEX[byte])
        mixed = (digits > 0) & (digits < size)
        size_class = np.searchsorted([4, 8, 16, 24, 32, 48], size, "right")
        alphabet = (hexes == size) * 1 + (digits == size) * 2 + mixed * 4 + (count(_JOIN[byte]) > 0) * 8 + (size_class * 16)
        low = A.fold(byte).astype(np.uint64) + np.uint64(1)
        place = (at - np.repeat(start, size)).astype(np.uint64)
        word = np.add.reduceat(low * _B ** (place + np.uint64(1)), first) if len(rows) else np.zeros(0, np.uint64)
        word = np.where((digits == 0) & (size <= 16), word, np.uint64(1))
        return np.stack([exact, plain, alphabet.astype(np.uint64), word], axis=1)


def labelled_table(sentences: int = SENTENCES, seed: int = 11) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """(text, [(start, end, kind)]) from templates: the same table on every call."""
    r = random.Random(seed)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    syllables = "an be con der el fra gen ha in jo ka lu mi no or pa qui re sta ti un ver wo xi yu za tion keit mente ment".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    host = lambda: r.choice(["", f"mail{r.randint(1, 99)}.", "mx.", f"{word()}."]) + r.choice(["example", word(), "web" + digits(1)]) + "." + r.choice(["com", "org", "net", "de", "fr", "es", "io", "co.uk"])
    user = lambda: r.choice([word, lambda: f"{word()}.{word()}", lambda: f"{word()}.{digits(2)}", lambda: f"{word()}_{word()}", lambda: f"{word()}{digits(r.randint(1, 4))}", lambda: f"{word()}-{word()}", lambda: word().title() + "." + word().title()])()
    hexes = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    mixed = lambda n: digits(1) + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n - 1))
    make = {
        "EMAIL": lambda: f"{user()}@{host()}",
        "PHONE": lambda: r.choice([lambda: f"+{r.randint(1, 99)} ({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"+{r.randint(1, 99)} {digits(3)} {digits(3)} {digits(4)}", lambda: f"({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"{digits(3)}-{digits(3)}-{digits(4)}", lambda: f"+{r.randint(1, 99)}-{digits(3)}-{digits(3)}-{digits(4)}", lambda: f"+{digits(11)}", lambda: f"{digits(3)}.{digits(3)}.{digits(4)}", lambda: f"+{r.randint(10, 99)} {digits(2)} {digits(8)}"])(),
        "IP": lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)),
        "CARD": lambda: r.choice([lambda: digits(16), lambda: digits(16), lambda: " ".join(digits(4) for _ in range(4)), lambda: "-".join(digits(4) for _ in range(4)), lambda: digits(15)])(),
        "SECRET": lambda: r.choice([lambda: hexes(40), lambda: hexes(32), lambda: hexes(64), lambda: mixed(40), lambda: f"sk_live_{mixed(24)}", lambda: f"ghp_{mixed(36)}", lambda: "AKIA" + mixed(16).upper(), lambda: hexes(40).upper()])(),
    }
    cues = {"EMAIL": ["mail", "contact", "write to"], "PHONE": ["phone", "call", "tel"], "IP": ["from", "host", "ip"], "CARD": ["card", "paid with"], "SECRET": ['token = "', 'key: "', 'password = "', "secret "]}
    plain = [lambda: str(r.randint(0, 9)), lambda: str(r.randint(10, 9999)), lambda: f"{r.randint(0, 9)}.{r.randint(0, 9)}", lambda: f"{r.randint(1, 99)}.{digits(2)}", lambda: f"20{digits(2)}-{digits(2)}-{digits(2)}", lambda: f"{digits(1)}.{digits(1)}.{digits(1)}", lambda: f"{word()}{digits(1)}", lambda: digits(r.randint(5, 8)), lambda: f"{digits(2)}-{digits(2)}", lambda: f"{digits(4)}-{digits(4)}", lambda: f"v{digits(1)}.{digits(2)}", lambda: "".join(r.choice(syllables) for _ in range(11)), lambda: "".join(r.choice(syllables).title() for _ in range(11)), lambda: f"{word()}-{digits(2)}"]
    out = []
    for _ in range(sentences):
        text, spans = "", []
        for _ in range(r.randint(4, 9)):
            x = r.random()
            mark = r.choice(["", "", "", ",", ".", "!!", "###", "%%%", ";"])
            if x < 0.3:
                kind = r.choice(KINDS)
                if r.random() < 0.3 or kind == "SECRET" and r.random() < 0.8:
                    text += r.choice(cues[kind]) + ("" if text.endswith('"') else " ")
                text = text.rstrip() if text.endswith('" ') else text
                value = make[kind]()
                value = value.upper() if kind == "EMAIL" and r.random() < 0.35 else value
                spans.append((len(text), len(text) + len(value), kind))
                text += value + ('"' if r.random() < 0.1 else "") + mark + " "
            elif x < 0.45:
                text += r.choice(plain)() + mark + " "
            else:
                w = word()
                text += r.choice([w, w, w.title(), w.upper()]) + mark + " "
        out.append((text, spans))
    return out


class Field:
    """Weights by feature hash, transitions, start and end scores are zero."""

    def __init__(self, known: np.ndarray, weights: np.ndarray, transitions: np.ndarray):
        self.known, self.weights, self.transitions = known, weights, transitions

    def index(self, features: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.known, features)
        at[at == len(self.known)] = 0
        return np.where(self.known[at] == features, at, len(self.known))

    def viterbi(self, emission: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Best labels for chains padded to (chains, steps, labels)."""
        n, steps, _ = emission.shape
        score = emission[:, 0] + _starts()
        back = np.zeros((n, steps, len(LABELS)), np.int8)
        ends = np.where((size == 1)[:, None], score, 0)
        for t in range(1, steps):
            step = score[:, :, None] + self.transitions[None]
            back[:, t] = step.argmax(axis=1)
            score = step.max(axis=1) + emission[:, t]
            ends[size == t + 1] = score[size == t + 1]
        out = np.zeros((n, steps), np.int8)
        now = ends.argmax(axis=1)
        for t in range(steps - 1, -1, -1):
            now = np.where(size - 1 == t, ends.argmax(axis=1), now)
            out[:, t] = now
            if t:
                now = np.where(t < size, back[np.arange(n), t, now], now)
        return out

    def label(self, tokens: Tokens, rows: np.ndarray) -> np.ndarray:
        """Labels of these tokens, in order; neighbours in rows that are neighbours in the text are a chain."""
        if not len(rows):
            return np.zeros(0, np.int8)
        weights = np.vstack([self.weights, np.zeros((1, len(LABELS)))])
        emission = weights[self.index(tokens.features(rows))].sum(axis=1)
        new = np.ones(len(rows), bool)
        new[1:] = (np.diff(rows) != 1) | (np.diff(tokens.text[rows]) != 0)
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(rows)))
        out = np.zeros(len(rows), np.int8)
        order = np.argsort(size, kind="stable")
        a = 0
        while a < len(order):  # chains of about one length together
            most = size[order[a]] * 2
            b = int(np.searchsorted(size[order], most, "right"))
            b = min(b, a + max(1, 2_000_000 // int(size[order[b - 1]])))
            pick = order[a:b]
            steps = int(size[pick].max())
            at = first[pick][:, None] + np.minimum(np.arange(steps)[None], size[pick][:, None] - 1)
            best = self.viterbi(emission[at], size[pick])
            there = np.arange(steps)[None] < size[pick][:, None]
            out[at[there]] = best[there]
            a = b
        return out


def _starts() -> np.ndarray:
    """A chain begins with O or a B- label."""
    return np.array([-1e4 if x.startswith("I-") else 0.0 for x in LABELS])


def _allowed() -> np.ndarray:
    """0 where a label may follow, a large negative number where an I- label has no entity to go on with."""
    t = np.zeros((len(LABELS), len(LABELS)))
    for b, x in enumerate(LABELS):
        if x.startswith("I-"):
            for a, y in enumerate(LABELS):
                if y[2:] != x[2:]:
                    t[a, b] = -1e4
    return t


def labelled_rows(table: DataFrame, most: int = MAX_LABELLED) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """A labelled table (text string, spans array<struct<start, length, kind>>, in characters) for train().

    Of a larger table a hash sample of at most about most rows is used, the bound on what the driver
    holds. Null texts are left out; null spans are none; kinds other than KINDS are an error.
    """
    rows = table.where("text is not null").select("text", "spans")
    n = rows.count()
    if n > most:
        rows = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(most / n * (1 << 30)))
    out = []
    for r in rows.sort("text").toLocalIterator():
        places = np.append(0, np.cumsum([len(c.encode()) for c in r["text"]]))
        out.append((r["text"], [(int(places[x["start"]]), int(places[x["start"] + x["length"]]), x["kind"]) for x in sorted(r["spans"] or [], key=lambda x: x["start"])]))
    return out


@lru_cache(maxsize=1)
def _default() -> Field:
    return train(labelled_table())


def train(table: list[tuple[str, list[tuple[int, int, str]]]] | None = None, epochs: int = EPOCHS) -> Field:
    """The field fitted by Adam on the penalised log likelihood to a table of (text, [(first byte, end byte, kind)])."""
    if table is None:
        return _default()
    raw, offsets = A.as_bytes(pa.array([t for t, _ in table]))
    tokens = Tokens(raw, offsets)
    rows = np.flatnonzero(tokens.live)
    gold = np.zeros(len(rows), np.int64)
    a = tokens.start[rows] - offsets[tokens.text[rows]]
    for t, (_, spans) in enumerate(table):
        own = np.flatnonzero(tokens.text[rows] == t)
        for s, e, kind in spans:
            inside = own[(a[own] >= s) & (a[own] < e)]
            gold[inside] = LABELS.index(f"I-{kind}")
            gold[inside[:1]] = LABELS.index(f"B-{kind}")
    features = tokens.features(rows)
    known = np.unique(features)
    field = Field(known, np.zeros((len(known), len(LABELS))), _allowed())
    index = field.index(features)
    new = np.ones(len(rows), bool)
    new[1:] = (np.diff(rows) != 1) | (np.diff(tokens.text[rows]) != 0)
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(rows)))
    # Chains by length, the longest first: those that have a step t are the first active[t].
    longest = np.argsort(-size, kind="stable")
    first, size = first[longest], size[longest]
    steps = int(size.max())
    active = [int((size > t).sum()) for t in range(steps)]
    n, k = len(first), len(LABELS)
    one = np.zeros((len(rows), k))
    one[np.arange(len(rows)), gold] = 1
    pairs = np.zeros((k, k))
    for t in range(1, steps):
        at = first[: active[t]] + t
        np.add.at(pairs, (gold[at - 1], gold[at]), 1)
    hard = _allowed()
    free = hard == 0
    lse = lambda x, axis: (m := x.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis=axis))
    w, tr = field.weights, np.zeros((k, k))
    # All places of a feature, so that its gradient is one sum over a range.
    order = np.argsort(index, axis=None, kind="stable")
    feature, row = index.ravel()[order], order // index.shape[1]
    begin = np.flatnonzero(np.concatenate(([True], feature[1:] != feature[:-1])))
    moments = [[np.zeros_like(w), np.zeros_like(w)], [np.zeros_like(tr), np.zeros_like(tr)]]
    for epoch in range(1, epochs + 1):
        e = w[index].sum(axis=1)
        full = tr + hard
        alpha = np.zeros((len(rows), k))  # by token
        alpha[first] = e[first] + _starts()
        for t in range(1, steps):
            at = first[: active[t]] + t
            alpha[at] = lse(alpha[at - 1][:, :, None] + full[None], 1) + e[at]
        whole = lse(alpha[first + size - 1], 1)
        beta, expect = np.zeros((len(rows), k)), np.zeros((k, k))
        for t in range(steps - 2, -1, -1):
            at = first[: active[t + 1]] + t
            inner = full[None] + (e[at + 1] + beta[at + 1])[:, None, :]
            beta[at] = lse(inner, 2)
            expect += np.exp(alpha[at][:, :, None] + inner - whole[: active[t + 1], None, None]).sum(axis=0)
        z = np.zeros(len(rows))
        for t in range(steps):
            z[first[: active[t]] + t] = whole[: active[t]]
        flat = np.exp(alpha + beta - z[:, None])
        grad = np.zeros_like(w)
        diff = (one - flat) / n
        grad[feature[begin]] = np.add.reduceat(diff[row], begin, axis=0)
        grads = [grad - L2 * w, ((pairs - expect) / n - L2 * tr) * free]
        for p, g, (m, v) in zip((w, tr), grads, moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p += 0.15 * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.999**epoch)) + 1e-8)
    field.transitions = tr + hard
    return field


def find(field: Field, raw: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, str]]:
    """(text number, first byte, end byte, kind) of the entities."""
    tokens = Tokens(raw, offsets)
    rows = np.flatnonzero(tokens.live)
    label = field.label(tokens, rows)
    begin = np.flatnonzero(label % 2 == 1)  # B- labels are odd, the I- label of a kind follows its B- label
    out = []
    for k in begin.tolist():
        last = k
        while last + 1 < len(rows) and label[last + 1] == label[k] + 1 and rows[last + 1] == rows[last] + 1:
            last += 1
        out.append((int(tokens.text[rows[k]]), int(tokens.start[rows[k]]), int(tokens.end[rows[last]]), KINDS[(int(label[k]) - 1) // 2]))
    return out


def spans(docs: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length (characters of the text) and kind of each piece of personal data.

    The data itself is not in the result. Null and empty texts and an empty
    table have none; each row of a repeated document is reported.
    """
    held = docs.sparkSession.sparkContext.broadcast(field or train())  # some thousand weights, at any size of docs

    def run(batches):
        for batch in batches:
            for part in A.chunks(batch, 1):
                raw, offsets = A.as_bytes(part.column(1))
                found = find(held.value, raw, offsets)
                if not found:
                    continue
                chars = A.char_positions(raw)
                ids = part.column(0).to_pylist()
                rows = [(ids[t], int(chars[a] - chars[offsets[t]]), int(chars[b] - chars[a]), kind) for t, a, b, kind in found]
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SPANS, strict=True)], schema=_SPANS)

    return A.ids_and_texts(docs, id_col, text_col).mapInArrow(run, SPANS)


def redact(docs: DataFrame, field: Field | None = None, text_col: str = "text") -> DataFrame:
    """docs with each piece replaced by its kind in brackets; all rows and columns stay, null texts stay null."""
    held = docs.sparkSession.sparkContext.broadcast(field or train())
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for part in A.chunks(batch, at):
                raw, offsets = A.as_bytes(part.column(at))
                by: dict[int, list[tuple[int, int, str]]] = {}
                for t, a, b, kind in find(held.value, raw, offsets):
                    by.setdefault(t, []).append((a, b, kind))
                texts = part.column(at).to_pylist()
                for t, own in by.items():
                    pieces, last = [], int(offsets[t])
                    for a, b, kind in own:
                        pieces += [raw[last:a].tobytes(), f"[{kind}]".encode()]
                        last = b
                    texts[t] = b"".join([*pieces, raw[last : offsets[t + 1]].tobytes()]).decode()
                columns = [*part.columns]
                columns[at] = pa.array(texts, part.schema.field(at).type)
                yield pa.record_batch(columns, schema=part.schema)

    return docs.mapInArrow(run, docs.schema)
