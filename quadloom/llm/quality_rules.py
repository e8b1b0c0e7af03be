"""Quality rules: robust multivariate outliers by the minimum covariance determinant.

Each text gives a vector of transformed statistics (``STATISTICS``). For each
(language, source) the location and scatter of the vectors are estimated by a
deterministic MCD: three robust starting scatters (MAD scales with the
correlations of tanh scores, of spatial signs, and none), then concentration
steps on the h = 50 % of rows with the smallest distances, the start with the
smallest determinant, a reweighting step. A document is rejected if its squared
Mahalanobis distance is above ``CUTOFF``.

All rows take part in every step: the steps are grouped aggregations of moments
and of approximate quantiles over a checkpointed table of vectors, so only
that narrow table is read again. A scatter gets a floor on its diagonal,
``RESOLUTION`` squared: differences below it do not count, so that a statistic
that is constant in clean text does not make every deviation infinite.
(Language, source) pairs with fewer than ``MIN_GROUP`` rows are pooled by
language, and languages that are then too small are pooled together; documents
of a pool that is too small even so are kept.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrowtext as A

STATISTICS = ("word_length", "symbols", "punctuation", "capitals", "repetition")
#: Spread below which differences do not count: of a logarithm, and of square roots of shares.
RESOLUTION = (0.08, 0.05, 0.05, 0.05, 0.06)
D = len(STATISTICS)
MIN_GROUP = 60
#: Share of a group that the steps concentrate on; the fit breaks down once more than the rest is junk.
SHARE = 0.5
STEPS = 3
#: Chance with which a normal vector is rejected.
FALSE_REJECTS = 1e-6
#: Group parameters are broadcast up to so many groups (about 40 numbers each), joined beyond.
MAX_BROADCAST_GROUPS = 20_000

_STARTS = 3
_X = [f"x{i}" for i in range(D)]
_PAIRS = [(i, j) for i in range(D) for j in range(i, D)]

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[0xC2:] = True
_VISIBLE = np.zeros(256, bool)
_VISIBLE[33:127] = _VISIBLE[0xC2:] = True
_MARKS = np.zeros(256, bool)
_MARKS[list(b".,;:!?'\"()-")] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[33:127] = True
_SYMBOL[48:58] = _SYMBOL[65:91] = _SYMBOL[97:123] = False
_SYMBOL[_MARKS] = False


def statistics(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The vectors of the texts, shape (texts, D). An empty text has the priors."""
    words = A.Words(raw, offsets)

    def count(flags: np.ndarray) -> np.ndarray:
        total = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return np.diff(total[offsets]).astype(float)

    upper = (raw >= 65) & (raw < 91)
    at = np.flatnonzero(raw[:-1] == 0xC3) if len(raw) else np.zeros(0, np.int64)
    upper[at[(raw[at + 1] >= 0x80) & (raw[at + 1] <= 0x9E)]] = True
    letters, visible = count(_LETTER[raw]), count(_VISIBLE[raw])
    n = words.count.astype(float)
    text = words.text_of().astype(np.uint64)
    grams = A.grams(words.hash, 3)
    inside = text[: len(grams)] == text[len(text) - len(grams) :]
    key = np.sort((text[: len(grams)][inside] << np.uint64(40)) | (grams[inside] >> np.uint64(24)))
    again = (key[1:][key[1:] == key[:-1]] >> np.uint64(40)).astype(np.int64)
    repeated = np.bincount(again, minlength=len(n)).astype(float)
    return np.column_stack(
        [
            np.log((letters + 100) / (n + 20)),
            np.sqrt(count(_SYMBOL[raw]) / (visible + 100)),
            np.sqrt((count(_MARKS[raw]) + 3) / (visible + 100)),
            np.sqrt((count(upper) + 3) / (letters + 100)),
            np.sqrt(repeated / (np.maximum(n - 2, 0) + 50)),
        ]
    )


def _vectors(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in A.chunks(batch, 1):
                x = statistics(*A.as_bytes(part.column(1)))
                yield pa.record_batch([part.column(0), part.column(2), part.column(3), *(pa.array(x[:, i]) for i in range(D))], names=["doc_id", "lang", "source", *_X])

    rows = A.ids_and_texts(docs, id_col, text_col, lang_col, "lang", source_col, "source").fillna("", ["lang", "source"])
    return rows.mapInArrow(run, "doc_id bigint, lang string, source string, " + ", ".join(f"{x} double" for x in _X))


def _chi_square_below(x: float, d: int) -> float:
    """Distribution function of the chi-square distribution."""
    a, y = d / 2, x / 2
    if y <= 0:
        return 0.0
    term = total = 1 / a
    for k in range(1, 1000):
        term *= y / (a + k)
        total += term
        if term < total * 1e-14:
            break
    return min(1.0, total * math.exp(-y + a * math.log(y) - math.lgamma(a)))


def chi_square(p: float, d: int) -> float:
    """Quantile of the chi-square distribution, by bisection."""
    low, high = 0.0, 10.0 * d + 200
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi_square_below(mid, d) < p else (low, mid)
    return low


#: Squared distance above which a document is rejected.
CUTOFF = chi_square(1 - FALSE_REJECTS, D)


def _consistency(share: float) -> float:
    """Factor by which the scatter of the central share of normal rows is too small."""
    return share / _chi_square_below(chi_square(share, D), D + 2)


def _groups(x: DataFrame, min_group: int) -> DataFrame:
    """(lang, source, g): the pool of each pair, null for pools that are too small."""
    n = x.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    small = n.where(F.col("n") < min_group)
    by_lang = small.groupBy("lang").agg(F.sum("n").alias("n_lang"))
    tiny = by_lang.where(F.col("n_lang") < min_group).agg(F.sum("n_lang").alias("n_rest"))
    name = lambda *parts: F.to_json(F.array(*parts))
    g = (
        F.when(F.col("n") >= min_group, name("lang", "source"))
        .when(F.col("n_lang") >= min_group, name("lang"))
        .when(F.col("n_rest") >= min_group, F.lit("*"))
    )
    return n.join(by_lang, "lang", "left").crossJoin(F.broadcast(tiny)).select("lang", "source", g.alias("g"))


def _distance(start: int) -> Column:
    """Squared Mahalanobis distance under the parameters m{start}_i and p{start}_i_j of the row."""
    out = F.lit(0.0)
    for i, j in _PAIRS:
        term = (F.col(_X[i]) - F.col(f"m{start}")[i]) * (F.col(_X[j]) - F.col(f"m{start}")[j])
        out = out + F.col(f"p{start}")[_PAIRS.index((i, j))] * term * F.lit(1.0 if i == j else 2.0)
    return out


def _moments(chosen: Column, y: list[Column], name: str) -> list[Column]:
    """Count, sums and sums of products over the chosen rows."""
    return [F.array(F.sum(F.when(chosen, 1.0).otherwise(0.0)), *(F.sum(F.when(chosen, v).otherwise(0.0)) for v in y), *(F.sum(F.when(chosen, y[i] * y[j]).otherwise(0.0)) for i, j in _PAIRS)).alias(name)]


def _square(flat: np.ndarray) -> np.ndarray:
    out = np.zeros((len(flat), D, D))
    for k, (i, j) in enumerate(_PAIRS):
        out[:, i, j] = out[:, j, i] = flat[:, k]
    return out


def _parameters(names: list[str], mean: np.ndarray, scatter: np.ndarray) -> list[tuple[str, pa.Array]]:
    """The mean, upper triangle of the inverse, and log determinant, as Arrow columns."""
    scatter = scatter + np.diag(np.square(RESOLUTION))
    inverse = np.linalg.inv(scatter)
    lists = lambda a: pa.array(list(a), pa.list_(pa.float64()))
    return [(names[0], lists(mean)), (names[1], lists(np.column_stack([inverse[:, i, j] for i, j in _PAIRS]))), (names[2], pa.array(np.linalg.slogdet(scatter)[1]))]


def _names(start: int) -> list[str]:
    return [f"m{start}", f"p{start}", f"l{start}"]


def _schema(starts: int) -> str:
    return "g string, " + ", ".join(f"m{s} array<double>, p{s} array<double>, l{s} double" for s in range(starts))


def _two(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), float)


def _first_scatters(batches):
    """Starting parameters from medians, MADs and the moments of tanh scores (t) and spatial signs (u)."""
    for b in batches:
        if not b.num_rows:
            continue
        col = lambda n: _two(b.column(b.schema.get_field_index(n)))  # noqa: E731,B023
        centre, scale = col("med"), np.maximum(col("mad"), 1e-3)
        out = [("g", b.column(b.schema.get_field_index("g")))]
        for start in range(_STARTS):
            if start == 2:
                r = np.tile(np.eye(D), (len(centre), 1, 1))
            else:
                s = col("tu"[start])
                mean = s[:, 1 : D + 1] / s[:, :1]
                c = _square(s[:, D + 1 :]) / s[:, :1, None] - mean[:, :, None] * mean[:, None, :]
                sd = np.sqrt(np.maximum(np.einsum("nii->ni", c), 1e-9))
                r = 0.9 * c / (sd[:, :, None] * sd[:, None, :]) + 0.1 * np.eye(D)
            out += _parameters(_names(start), centre, r * scale[:, :, None] * scale[:, None, :])
        yield pa.record_batch([a for _, a in out], names=[n for n, _ in out])


def _from_moments(starts: int, factor: float):
    """Parameters from the moments s0, s1, ... of each group."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            out = [("g", b.column(b.schema.get_field_index("g")))]
            for start in range(starts):
                s = _two(b.column(b.schema.get_field_index(f"s{start}")))
                n = np.maximum(s[:, :1], 1)
                mean = s[:, 1 : D + 1] / n
                scatter = _square(s[:, D + 1 :]) / n[:, :, None] - mean[:, :, None] * mean[:, None, :]
                out += _parameters(_names(start), mean, factor * scatter)
            yield pa.record_batch([a for _, a in out], names=[n for n, _ in out])

    return run


def fit(x: DataFrame, share: float = SHARE, steps: int = STEPS) -> DataFrame:
    """(g, m0, p0, l0): mean, inverse scatter and log determinant of each group of x(g, x0, ...)."""
    n_groups = x.select("g").distinct().count()
    small = F.broadcast if n_groups <= MAX_BROADCAST_GROUPS else (lambda df: df)
    centre = A.session_checkpoint(x.groupBy("g").agg(F.array(*(F.percentile_approx(v, 0.5, 5000) for v in _X)).alias("med")))
    joined = x.join(small(centre), "g")
    mad = A.session_checkpoint(joined.groupBy("g", "med").agg(F.array(*(F.percentile_approx(F.abs(F.col(v) - F.col("med")[i]), 0.5, 5000) * 1.4826 for i, v in enumerate(_X))).alias("mad")))
    z = [(F.col(v) - F.col("med")[i]) / F.greatest(F.col("mad")[i], F.lit(RESOLUTION[i])) for i, v in enumerate(_X)]
    length = F.greatest(F.sqrt(sum((v * v for v in z), F.lit(0.0))), F.lit(1e-6))
    every = F.lit(True)
    first = x.join(small(mad), "g").groupBy("g", "med", "mad").agg(*_moments(every, [F.tanh(v) for v in z], "t"), *_moments(every, [v / length for v in z], "u"))
    parameters = A.session_checkpoint(first.mapInArrow(_first_scatters, _schema(_STARTS)))

    def concentrate(parameters: DataFrame, starts: int) -> DataFrame:
        d = x.join(small(parameters), "g").select("g", *_X, *(_distance(s).alias(f"d{s}") for s in range(starts)))
        q = A.session_checkpoint(d.groupBy("g").agg(*(F.percentile_approx(f"d{s}", share, 5000).alias(f"q{s}") for s in range(starts))))
        sums = d.join(small(q), "g").groupBy("g").agg(*(m for s in range(starts) for m in _moments(F.col(f"d{s}") <= F.col(f"q{s}"), [F.col(v) for v in _X], f"s{s}")))
        return A.session_checkpoint(sums.mapInArrow(_from_moments(starts, _consistency(share)), _schema(starts)))

    for _ in range(steps):
        parameters = concentrate(parameters, _STARTS)
    best = F.array_min(F.array(*(F.struct(F.col(f"l{s}").alias("l"), F.lit(s).alias("s"), F.col(f"m{s}").alias("m"), F.col(f"p{s}").alias("p")) for s in range(_STARTS))))
    parameters = parameters.select("g", best.alias("b")).select("g", F.col("b.m").alias("m0"), F.col("b.p").alias("p0"), F.col("b.l").alias("l0"))
    parameters = concentrate(parameters, 1)
    near = _distance(0) <= chi_square(0.975, D)
    sums = x.join(small(parameters), "g").groupBy("g").agg(*_moments(near, [F.col(v) for v in _X], "s0"))
    return A.session_checkpoint(sums.mapInArrow(_from_moments(1, _consistency(0.975)), _schema(1)))


def _judged(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str, min_group: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vectors with their pool, pools by (lang, source), parameters by pool."""
    x = A.session_checkpoint(_vectors(docs, id_col, text_col, lang_col, source_col))
    groups = A.session_checkpoint(_groups(x, min_group))
    small = F.broadcast if groups.count() <= MAX_BROADCAST_GROUPS else (lambda df: df)
    x = x.join(small(groups), ["lang", "source"], "left")
    return x, groups, fit(A.session_checkpoint(x.where("g is not null").select("g", *_X)))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_group: int = MIN_GROUP, cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, lang, source, the statistics, distance (squared) and keep, a row for each row of docs with an id.

    Null and empty texts have the neutral vector and are judged like others;
    null languages and sources count as ''. distance is null, and keep true, in
    pools below min_group. An empty table gives no rows.
    """
    x, _, parameters = _judged(docs, id_col, text_col, lang_col, source_col, min_group)
    small = F.broadcast if parameters.count() <= MAX_BROADCAST_GROUPS else (lambda df: df)
    d = x.join(small(parameters), "g", "left").withColumn("distance", _distance(0))
    return d.select("doc_id", "lang", "source", *(F.col(v).alias(s) for v, s in zip(_X, STATISTICS, strict=True)), "distance", F.coalesce(F.col("distance") <= cutoff, F.lit(True)).alias("keep"))


def accept(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_group: int = MIN_GROUP, cutoff: float = CUTOFF) -> DataFrame:
    """The rows of docs that judge() keeps, all columns; rows without an id stay.

    With few pools their parameters travel to the scan and each row is judged
    there, without a shuffle of texts; with very many, they are joined to the
    rows. Either way each row is judged by its own text, also if rows share an id.
    """
    x, groups, parameters = _judged(docs, id_col, text_col, lang_col, source_col, min_group)
    if groups.count() > MAX_BROADCAST_GROUPS:
        return _accept_joined(docs, groups.join(parameters, "g"), id_col, text_col, lang_col, source_col, cutoff)
    known = {r["g"]: (np.array(r["m0"]), _square(np.array([r["p0"]]))[0]) for r in parameters.collect()}
    table = {(r["lang"], r["source"]): known[r["g"]] for r in groups.collect() if r["g"] in known}
    at = [docs.columns.index(c) for c in (text_col, id_col, lang_col, source_col)]

    def run(batches):
        for batch in batches:
            for part in A.chunks(batch, at[0]):
                text, ids, lang, source = (part.column(k) for k in at)
                v = statistics(*A.as_bytes(text))
                keep = np.ones(part.num_rows, bool)
                pairs = list(zip((str(k) if k is not None else "" for k in lang.to_pylist()), (str(k) if k is not None else "" for k in source.to_pylist()), strict=True))
                rows: dict[tuple[str, str], list[int]] = {}
                for k, pair in enumerate(pairs):
                    rows.setdefault(pair, []).append(k)
                for pair, own in rows.items():
                    if pair in table:
                        mean, inverse = table[pair]
                        away = v[own] - mean
                        keep[own] = np.einsum("ni,ij,nj->n", away, inverse, away) <= cutoff
                keep |= np.asarray(ids.is_null())
                yield part.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def _accept_joined(docs: DataFrame, pools: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str, cutoff: float) -> DataFrame:
    """accept() with the parameters of each row's pool joined to it."""
    names = docs.columns
    of = lambda c: F.coalesce(docs[f"`{c}`"].cast("string"), F.lit(""))
    pools = pools.select(F.col("lang").alias("__ql_lang"), F.col("source").alias("__ql_source"), F.col("m0").alias("__ql_m"), F.col("p0").alias("__ql_p"))
    both = docs.join(pools, (of(lang_col) == pools["__ql_lang"]) & (of(source_col) == pools["__ql_source"]), "left")
    text_at, id_at, n = names.index(text_col), names.index(id_col), len(names)

    def run(batches):
        for batch in batches:
            for part in A.chunks(batch, text_at):
                some = np.flatnonzero(part.column(n).is_valid().to_numpy(zero_copy_only=False) & part.column(id_at).is_valid().to_numpy(zero_copy_only=False))
                keep = np.ones(part.num_rows, bool)
                if len(some):
                    away = statistics(*A.as_bytes(part.column(text_at)))[some] - np.stack(part.column(n).take(pa.array(some)).to_numpy(zero_copy_only=False))
                    inverse = _square(np.stack(part.column(n + 1).take(pa.array(some)).to_numpy(zero_copy_only=False)))
                    keep[some] = np.einsum("ni,nij,nj->n", away, inverse, away) <= cutoff
                yield pa.record_batch(part.columns[:n], names=names).filter(pa.array(keep))

    return both.select(*(docs[f"`{c}`"] for c in names), "__ql_m", "__ql_p").mapInArrow(run, docs.schema)
