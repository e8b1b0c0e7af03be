"""Language identification with a byte convolutional network.

Texts are read in consecutive windows of ``WINDOW`` bytes (the last one padded
with blanks), so every byte counts. Filters of several widths slide over the
bytes of a window, the maximum over its places goes through a softmax layer, and
a document's language has the largest sum of log probabilities over its
windows, weighted by their bytes.

The network is trained in numpy by Adam on labelled text, at most
``SAMPLE`` documents a language (a bound on the sample of labelled rows, picked by
hash from all of them). For inference a filter's weights are unfolded into tables over
byte pairs, so that a filter of width four costs two lookups a byte.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrowtext as A

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 8
#: Labelled documents a language from which the network is trained, and windows of each.
SAMPLE = 300
WINDOWS_EACH = 6
EPOCHS = 24
#: A label is doubted only if another language has at least this probability.
CONFIDENT = 0.8
#: Windows that are scored at once.
BATCH = 1024

_OUT = "doc_id bigint, lang string, probability double, n_windows int, declared string, keep boolean"


def windows(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded windows (n, WINDOW), their text numbers and their bytes."""
    low = A.fold(raw)
    low[low < 32] = 32
    sizes = np.diff(offsets)
    count = -(-sizes // WINDOW)
    text = np.repeat(np.arange(len(sizes)), count)
    place = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[text] + place * WINDOW
    length = np.minimum(WINDOW, offsets[text + 1] - start)
    out = np.full((len(text), WINDOW), 32, np.uint8)
    full = length == WINDOW
    out[full] = low[start[full, None] + np.arange(WINDOW)]
    for k in np.flatnonzero(~full):
        out[k, : length[k]] = low[start[k] : start[k] + length[k]]
    return out, text, length


class Network:
    """Weights: for each width an array (width, 256, FILTERS), biases, and the softmax layer."""

    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.filters = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.dense = rng.normal(0, 0.3, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32)
        self.shift = np.zeros(len(languages), np.float32)
        self.tables: list[list[np.ndarray]] = []

    def pooled(self, x: np.ndarray, places: bool = False):
        """Maxima over places, and where they are."""
        top, at = [], []
        for width, w, b in zip(WIDTHS, self.filters, self.bias, strict=True):
            n = WINDOW - width + 1
            y = w[0][x[:, :n]]
            for j in range(1, width):
                y = y + w[j][x[:, j : j + n]]
            where = y.argmax(axis=1)
            top.append(np.maximum(np.take_along_axis(y, where[:, None], 1)[:, 0] + b, 0))
            at.append(where)
        return np.concatenate(top, axis=1), at

    def unfold(self) -> None:
        """Tables over byte pairs for inference."""
        self.tables = []
        for width, w in zip(WIDTHS, self.filters, strict=True):
            own = []
            for j in range(0, width - 1, 2):
                own.append((w[j][:, None] + w[j + 1][None]).reshape(65536, FILTERS))
            if width % 2:
                own.append(w[-1])
            self.tables.append(own)

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        if not self.tables:
            self.unfold()
        pair = x[:, :-1].astype(np.int32) << 8 | x[:, 1:]
        hidden = []
        for width, tables, b in zip(WIDTHS, self.tables, self.bias, strict=True):
            n = WINDOW - width + 1
            y = tables[0].take(pair[:, :n], axis=0)
            if width == 3:
                y += tables[1].take(x[:, 2 : 2 + n], axis=0)
            elif width == 4:
                y += tables[1].take(pair[:, 2 : 2 + n], axis=0)
            hidden.append(np.maximum(y.max(axis=1) + b, 0))
        z = np.concatenate(hidden, axis=1) @ self.dense + self.shift
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def train(self, x: np.ndarray, label: np.ndarray, epochs: int = EPOCHS, batch: int = 256, rate: float = 0.01, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        params = [*self.filters, *self.bias, self.dense, self.shift]
        m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for a in range(0, len(order), batch):
                rows = order[a : a + batch]
                xb, n = x[rows], len(rows)
                h, at = self.pooled(xb)
                z = h @ self.dense + self.shift
                z -= z.max(axis=1, keepdims=True)
                p = np.exp(z)
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(n), label[rows]] -= 1
                p /= n
                back = (p @ self.dense.T) * (h > 0)
                grads = []
                for k, width in enumerate(WIDTHS):
                    g = np.zeros_like(self.filters[k])
                    part = back[:, k * FILTERS : (k + 1) * FILTERS]
                    for j in range(width):
                        byte = np.take_along_axis(xb, at[k] + j, 1)
                        np.add.at(g[j], (byte, np.arange(FILTERS)[None, :]), part)
                    grads.append(g)
                grads += [back[:, k * FILTERS : (k + 1) * FILTERS].sum(axis=0) for k in range(len(WIDTHS))]
                grads += [h.T @ p + 1e-4 * self.dense, p.sum(axis=0)]
                t += 1
                for w, g, mm, vv in zip(params, grads, m, v, strict=True):
                    mm += 0.1 * (g - mm)
                    vv += 0.001 * (g * g - vv)
                    w -= rate * (mm / (1 - 0.9**t)) / (np.sqrt(vv / (1 - 0.999**t)) + 1e-8)
        self.tables = []


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Network | None:
    """A network trained on a hash sample of about ``sample`` labelled documents a language; None without labelled text."""
    rows = A.ids_and_texts(labelled, id_col, text_col, lang_col, "lang").where("lang is not null and text <> ''")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    draw = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 40)).cast("double") / float(1 << 40)
    share = F.coalesce(*(F.when(F.col("lang") == k, F.lit(1.25 * sample / n)) for k, n in sorted(counts.items())))
    # The windows of a document are picked over its whole length.
    step = F.greatest(F.length("text") / WINDOWS_EACH, F.lit(float(WINDOW)))
    cut = F.transform(F.sequence(F.lit(0), F.lit(WINDOWS_EACH - 1)), lambda i: F.substring("text", (i * step + 1).cast("int"), F.lit(WINDOW)))
    got = rows.where(draw < share).select("lang", draw.alias("draw"), cut.alias("cut")).toArrow()
    languages = sorted(counts)
    xs, ys = [], []
    by: dict[str, list[tuple[float, list[str]]]] = {}
    for lang, d, c in zip(*(got.column(k).to_pylist() for k in range(3)), strict=True):
        by.setdefault(lang, []).append((d, c))
    for lang, own in by.items():
        pieces = [p for _, c in sorted(own)[:sample] for p in c if p]
        raw, offsets = A.as_bytes(pa.array(pieces, pa.string()))
        x, text, _ = windows(raw, offsets)
        first = np.concatenate(([True], text[1:] != text[:-1])) if len(text) else np.zeros(0, bool)
        xs.append(x[first])
        ys.append(np.full(int(first.sum()), languages.index(lang)))
    if not xs:
        return None
    x, y = np.concatenate(xs), np.concatenate(ys)
    net = Network(languages)
    net.train(x, y)
    return net


def _judged(net: Network | None, texts: pa.Array, declared: list[str | None]) -> tuple[pa.Array, pa.Array, pa.Array, pa.Array]:
    """lang, probability, number of windows and keep of each text."""
    n = len(texts)
    total, weight, count = np.zeros((n, len(net.languages) if net else 1)), np.zeros(n), np.zeros(n, np.int32)
    if net:
        x, text, length = windows(*A.as_bytes(texts))
        scores = np.concatenate([np.zeros((0, len(net.languages))), *(net.log_probabilities(x[a : a + BATCH]) for a in range(0, len(x), BATCH))])
        for k in range(total.shape[1]):
            total[:, k] = np.bincount(text, scores[:, k] * length, n)
        weight, count = np.bincount(text, length, n), np.bincount(text, minlength=n).astype(np.int32)
    best = total.argmax(axis=1)
    there = weight > 0
    lang = [net.languages[b] if t else None for b, t in zip(best.tolist(), there.tolist(), strict=True)]
    p = np.exp(total[np.arange(n), best] / np.maximum(weight, 1))
    keep = [x is None or d is None or x == d or q < CONFIDENT for x, d, q in zip(lang, declared, p.tolist(), strict=True)]
    return pa.array(lang, pa.string()), pa.array(p, mask=~there), pa.array(count), pa.array(keep)


def identify(docs: DataFrame, network: Network | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, lang, probability, n_windows, declared, keep for each row with an id.

    lang is the network's (trained on docs' own labels if none is given),
    probability the geometric mean of its windows' probabilities, declared the
    label in docs, keep is false if they differ and the network is CONFIDENT. A null or empty text has no window:
    lang and probability are null and keep is true, as it is without a label,
    and for every row where there is no labelled text to train on.
    """
    net = network or fit(docs, id_col, text_col, lang_col)
    held = docs.sparkSession.sparkContext.broadcast(net)  # a few tens of thousands of weights, at any size of docs

    def run(batches):
        for batch in batches:
            for part in A.chunks(batch, 1):
                lang, probability, count, keep = _judged(held.value, part.column(1), part.column(2).to_pylist())
                yield pa.record_batch([part.column(0), lang, probability, count, part.column(2), keep], names=["doc_id", "lang", "probability", "n_windows", "declared", "keep"])

    return A.ids_and_texts(docs, id_col, text_col, lang_col, "declared").mapInArrow(run, _OUT)


def accept(docs: DataFrame, network: Network | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs that identify() keeps, each judged by its own text, also if rows share an id; rows without an id stay."""
    net = network or fit(docs, id_col, text_col, lang_col)
    held = docs.sparkSession.sparkContext.broadcast(net)
    at = [docs.columns.index(c) for c in (text_col, lang_col, id_col)]

    def run(batches):
        for batch in batches:
            for part in A.chunks(batch, at[0]):
                *_, keep = _judged(held.value, part.column(at[0]), [None if x is None else str(x) for x in part.column(at[1]).to_pylist()])
                yield part.filter(pa.array(np.asarray(keep, bool) | np.asarray(part.column(at[2]).is_null())))

    return docs.mapInArrow(run, docs.schema)
