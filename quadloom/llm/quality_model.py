"""Quality by the perplexity of an interpolated modified Kneser-Ney n-gram model.

The model's symbols are UTF-8 bytes, its n-grams of up to ``ORDER`` bytes stay
within a token (a run without white space) between a begin and an end mark, and
there is one model for each language. It is trained on all trusted texts (labelled of
good quality and not toxic). Counts, continuation counts, discounts, context
totals and interpolated probabilities are grouped and joined as tables, sharded
by (language, n-gram).

A document's perplexity is that of its bytes, drawn towards its language's
mean by ``PRIOR`` bytes so that very short texts are not judged by chance. It is
rejected above a quantile of the trusted documents' perplexities of its language,
times ``MARGIN``.

A few toxic words in good prose don't move that average. A second model of each
language is therefore trained on the texts labelled toxic, and each token is
compared under both: what its log probability under the toxic model exceeds that
under the trusted one by, above ``EXCESS`` and up to ``MOST_EXCESS``, is summed.
The sum for each byte, drawn towards the language's mean by ``CONTRAST_PRIOR``
bytes, is the document's contrast, and it is rejected above the geometric mean of
the ``QUANTILE`` of the trusted and the ``TOXIC_QUANTILE`` of the toxic documents.

For scoring, the finished table is divided into shards by language and last byte of the
context, which are all that the places with that byte need; each shard has
a bounded number of rows, is joined as a broadcast array, and adds its part to
each document's sum. Small models have one shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrowtext as A

ORDER = 5
PRIOR = 60
QUANTILE = 0.99
MARGIN = 1.15
EXCESS = 2.0
MOST_EXCESS = 6.0
CONTRAST_PRIOR = 1000
TOXIC_QUANTILE = 0.1
#: Rows of the model that are broadcast at once (16 bytes each).
SHARD_ROWS = 4_000_000
#: Ids of trusted and toxic documents are broadcast up to so many.
MAX_BROADCAST_IDS = 2_000_000

# An n-gram of n symbols is the integer of its bytes, the latest lowest, with n above them.
# Begin and end marks are the bytes 2 and 3, which tokens don't hold.
_BEGIN, _END = 2, 3
_LEN = 8 * (ORDER + 1)

#: Follows the language's name in that of its toxic model.
_TOXIC = "\x01toxic"


def _pack(n: int) -> np.uint64:
    return np.uint64(n << _LEN)


class TokenGrams:
    """Distinct tokens of texts, and the n-grams at each of their places.

    token: for each occurrence its number among the distinct; text: the text of
    each occurrence; place: the distinct token of each place; grams[n]: packed n-gram that ends at
    each place, 0 where the token's beginning is nearer.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        words = A.Words(raw, offsets, A.IS_TOKEN, folded=raw)
        self.text = words.text_of()
        _, first, self.token = np.unique(words.hash, return_index=True, return_inverse=True)
        start, size = words.start[first], words.end[first] - words.start[first]
        places = size + 1
        self.place = np.repeat(np.arange(len(first)), places)
        begin = np.cumsum(places) - places
        at = np.arange(places.sum()) - np.repeat(begin, places)
        last = at == np.repeat(size, places)
        byte = np.where(last, _END, raw[np.minimum(np.repeat(start, places) + at, max(len(raw) - 1, 0))] if len(raw) else 0).astype(np.uint64)
        self.size = size
        self.grams: dict[int, np.ndarray] = {}
        value = np.zeros(len(byte), np.uint64)
        for n in range(1, ORDER + 1):
            back = n - 1  # the symbol that many places before; the begin mark stands before the first
            symbol = np.full(len(byte), _BEGIN, np.uint64)
            inside = at >= back
            symbol[inside] = byte[np.flatnonzero(inside) - back]
            value = value | (symbol << np.uint64(8 * back))
            self.grams[n] = np.where(at >= back - 1, value | _pack(n), 0)


def _count_rows(batches):
    """(lang, g, c): counts of the packed n-grams of each chunk."""
    for batch in batches:
        for part in A.chunks(batch, 1):
            langs = np.asarray(part.column(2).to_pylist(), object)
            for lang in sorted(set(langs)):
                own = part.filter(pa.array(langs == lang))
                t = TokenGrams(*A.as_bytes(own.column(1)))
                times = np.bincount(t.token, minlength=len(t.size))
                weight = times[t.place]
                for n in range(1, ORDER + 1):
                    g = t.grams[n]
                    use = g > 0
                    key, back = np.unique(g[use], return_inverse=True)
                    count = np.bincount(back, weight[use], len(key)).astype(np.int64)
                    yield pa.record_batch([pa.array([lang] * len(key), pa.string()), pa.array(key.view(np.int64)), pa.array(count)], names=["lang", "g", "c"])


def _n(g: Column) -> Column:
    return F.shiftright(g, _LEN)


def _suffix(g: Column) -> Column:
    """The n-gram (column g) without its first symbol."""
    low = F.expr(f"g & (shiftleft(1L, cast(8 * (shiftright(g, {_LEN}) - 1) as int)) - 1)")
    return low.bitwiseOR(F.shiftleft(_n(g) - 1, _LEN))


def _context(g: Column) -> Column:
    """The n-gram (column g) without its last symbol."""
    low = F.expr(f"shiftright(g & (shiftleft(1L, {_LEN}) - 1), 8)")
    return low.bitwiseOR(F.shiftleft(_n(g) - 1, _LEN))


def counts(texts: DataFrame) -> DataFrame:
    """(lang, g, c) over all texts(doc_id, text, lang)."""
    return texts.mapInArrow(_count_rows, "lang string, g bigint, c bigint").groupBy("lang", "g").agg(F.sum("c").alias("c"))


def estimate(counted: DataFrame) -> DataFrame:
    """(lang, g, p, back): log probability of each n-gram's last symbol, and log weight of its continuations.

    back is 0 where the n-gram is no context; p is null for a context that is
    no n-gram of its own (the begin mark).
    """
    g = F.col("g")
    counted = A.session_checkpoint(counted)
    begins = F.expr(f"(shiftright(g, cast(8 * (shiftright(g, {_LEN}) - 1) as int)) & 255) = {_BEGIN}")
    # Below the highest order, and where something can stand before, count what stands before.
    left = counted.where(_n(g) > 1).select("lang", _suffix(g).alias("g")).groupBy("lang", "g").agg(F.count(F.lit(1)).alias("left"))
    used = counted.join(left, ["lang", "g"], "left").select("lang", "g", F.when((_n(g) < ORDER) & ~begins, F.coalesce("left", "c")).otherwise(F.col("c")).alias("a"))
    used = A.session_checkpoint(used.withColumn("n", _n(g)).withColumn("ctx", _context(g)))
    n_of = lambda k: F.sum(F.when(F.col("a") == k, 1).otherwise(0)).cast("double").alias(f"n{k}")
    d = used.groupBy("lang", "n").agg(n_of(1), n_of(2), n_of(3), n_of(4))
    y = F.col("n1") / F.greatest(F.col("n1") + 2 * F.col("n2"), F.lit(1.0))
    ratio = lambda k: F.least(F.greatest(F.coalesce(k - (k + 1) * y * F.try_divide(F.col(f"n{k + 1}"), F.col(f"n{k}")), F.lit(0.5)), F.lit(0.05)), F.lit(k - 0.05))
    d = d.select("lang", "n", ratio(1).alias("d1"), ratio(2).alias("d2"), ratio(3).alias("d3"))
    d = F.broadcast(d)  # ORDER rows a language
    discount = F.when(F.col("a") == 1, F.col("d1")).when(F.col("a") == 2, F.col("d2")).otherwise(F.col("d3"))
    used = used.join(d, ["lang", "n"]).withColumn("discount", discount)
    contexts = used.groupBy("lang", "ctx").agg(F.sum("a").cast("double").alias("total"), (F.sum("discount") / F.sum("a")).alias("gamma"))
    rows = A.session_checkpoint(used.join(contexts, ["lang", "ctx"]).select("lang", "g", "n", "gamma", ((F.col("a") - F.col("discount")) / F.col("total")).alias("own"), "ctx"))
    done = rows.where("n = 1").select("lang", "g", (F.col("own") + F.col("gamma") / 256).alias("p"))
    levels = [done]
    for k in range(2, ORDER + 1):
        lower = levels[-1].select("lang", F.col("g").alias("low"), F.col("p").alias("p_low"))
        level = rows.where(F.col("n") == k).withColumn("low", _suffix(g)).join(lower, ["lang", "low"], "left")
        levels.append(A.session_checkpoint(level.select("lang", "g", (F.col("own") + F.col("gamma") * F.coalesce("p_low", F.lit(1 / 256))).alias("p"))))
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    back = rows.select("lang", F.col("ctx").alias("g"), "gamma").distinct()
    return every.join(back, ["lang", "g"], "full").select("lang", "g", F.log("p").alias("p"), F.coalesce(F.log("gamma"), F.lit(0.0)).alias("back"))


#: Of an n-gram, what its shard follows from: the byte before the last, or of a context its last byte; the empty context and single symbols go everywhere.
_TAIL_OF_GRAM = f"if(shiftright(g, {_LEN}) >= 2, (shiftright(g, 8) & 255), -1)"
_TAIL_OF_CONTEXT = f"if(shiftright(g, {_LEN}) >= 1, (g & 255), -1)"


class Shard:
    """Part of a model in arrays: for each language sorted n-grams with p, sorted contexts with their weight."""

    def __init__(self, table: pa.Table, tails: dict[str, np.ndarray] | None):
        self.tails = tails  # by language which bytes of contexts belong to this shard; None: all
        self.langs: dict[str, tuple[np.ndarray, ...]] = {}
        lang = np.asarray(table.column("lang").to_pylist(), object)
        g, p, back = (table.column(c).to_numpy() for c in ("g", "p", "back"))
        for name in sorted(set(lang)):
            own = np.flatnonzero(lang == name)
            own = own[np.argsort(g[own])]
            has_p, has_back = own[~np.isnan(p[own])], own[back[own] != 0]
            self.langs[name] = (g[has_p], p[has_p].astype(np.float32), g[has_back], back[has_back].astype(np.float32))

    def score(self, t: TokenGrams, lang: str) -> np.ndarray:
        """Log probability of each distinct token, of the places that belong to this shard."""
        keys, p, contexts, back = self.langs[lang]
        n_places = len(t.place)
        out, open_ = np.zeros(n_places), np.arange(n_places)
        if self.tails is not None:
            tail = ((t.grams[2] >> np.uint64(8)) & np.uint64(255)).astype(int)
            open_ = open_[self.tails[lang][tail]] if lang in self.tails else open_[:0]
        for n in range(ORDER, 0, -1):
            g = t.grams[n][open_].view(np.int64)
            at = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
            hit = (keys[at] == g) & (g > 0) if len(keys) else np.zeros(len(g), bool)
            out[open_[hit]] += p[at[hit]]
            miss = open_[~hit]
            # Where the n-gram is unknown, the weight of its context goes on to the shorter one.
            g = g[~hit]
            real = g > 0
            ctx = (((g[real] & ((1 << _LEN) - 1)) >> 8) | ((n - 1) << _LEN)) if real.any() else g[real]
            if len(contexts) and len(ctx):
                at = np.minimum(np.searchsorted(contexts, ctx), len(contexts) - 1)
                found = contexts[at] == ctx
                out[miss[real][found]] += back[at[found]]
            open_ = miss
        out[open_] += np.log(1 / 256)
        return np.bincount(t.place, out, len(t.size))


def shards(model: DataFrame, shard_rows: int = SHARD_ROWS) -> Iterator[Shard]:
    """The model as shards, of which the driver holds one at a time, of at most about shard_rows rows (a single (language, byte) apart)."""
    model = A.session_checkpoint(model.withColumn("gram_tail", F.expr(_TAIL_OF_GRAM)).withColumn("ctx_tail", F.expr(_TAIL_OF_CONTEXT)))
    size = model.groupBy("lang", "gram_tail").count().collect()  # 257 rows a language
    if sum(r["count"] for r in size) <= shard_rows:
        yield Shard(model.select("lang", "g", "p", "back").toArrow(), None)
        return
    out, group, total = [], [], 0
    for r in sorted((r for r in size if r["gram_tail"] >= 0), key=lambda r: (r["lang"], r["gram_tail"])):
        if group and total + r["count"] > shard_rows:
            out.append(group)
            group, total = [], 0
        group.append((r["lang"], r["gram_tail"]))
        total += r["count"]
    out.append(group)
    begun = set()
    known = {lang: np.zeros(256, bool) for lang, _ in sum(out, [])}
    for lang, tail in sum(out, []):
        known[lang][tail] = True
    for group in out:
        langs = sorted({x for x, _ in group})
        pairs = model.sparkSession.createDataFrame(group, "lang string, tail int")
        mine = model.join(F.broadcast(pairs), (model["lang"] == pairs["lang"]) & ((model["gram_tail"] == pairs["tail"]) | (model["ctx_tail"] == pairs["tail"])), "left_semi")
        single = model.where(F.col("lang").isin(langs) & (F.col("gram_tail") == -1))
        rows = mine.unionByName(single).select("lang", "g", "p", "back").distinct().toArrow()
        # A byte that is no context in the model belongs to the language's first shard.
        tails = {lang: np.zeros(256, bool) if lang in begun else ~known[lang] for lang in langs}
        begun |= set(langs)
        for lang, tail in group:
            tails[lang][tail] = True
        yield Shard(rows, tails)


def _excess(ratio: np.ndarray) -> np.ndarray:
    """What counts of tokens' log probability ratios of the toxic to the trusted model."""
    return np.clip(ratio - EXCESS, 0, MOST_EXCESS)


def scores(texts: DataFrame, parts: list[tuple[set[str], Broadcast]]) -> DataFrame:
    """(doc_id, lang, row, n_bytes, loglik, excess) of each row of texts(doc_id, text, lang, row); loglik is null without a model of the language, excess without both.

    A token's ratio needs the places of all shards, so with several each gives
    its part of every token's ratio, and the sums are cut off afterwards.
    """
    names = set().union(*(n for n, _ in parts))
    both = {x for x in names if x + _TOXIC in names}
    single = len(parts) == 1

    def scorer(held):
        def run(batches):
            shard = held.value
            for batch in batches:
                for part in A.chunks(batch, 1):
                    langs = np.asarray([x or "" for x in part.column(2).to_pylist()], object)
                    for lang in sorted(set(langs)):
                        own = part.filter(pa.array(langs == lang))
                        t = TokenGrams(*A.as_bytes(own.column(1)))
                        n = np.bincount(t.text, (t.size + 1)[t.token], own.num_rows).astype(np.int64)
                        known = lang in shard.langs
                        token = shard.score(t, lang) if known else np.zeros(len(t.size))
                        total = np.bincount(t.text, token[t.token], own.num_rows).astype(float)  # without words, counts are integers
                        compared = lang in both
                        ratio = (shard.score(t, lang + _TOXIC) if compared and lang + _TOXIC in shard.langs else 0) - token
                        if single:
                            excess = pa.array(np.bincount(t.text, _excess(ratio)[t.token], own.num_rows).astype(float), mask=np.full(own.num_rows, not compared))
                        elif compared:
                            ends = np.concatenate(([0], np.cumsum(np.bincount(t.text, minlength=own.num_rows)))).astype(np.int32)
                            excess = pa.ListArray.from_arrays(ends, pa.array(ratio[t.token].astype(np.float32)))
                        else:
                            excess = pa.nulls(own.num_rows, pa.list_(pa.float32()))
                        yield pa.record_batch([own.column(0), own.column(2), own.column(3), pa.array(n), pa.array(total, mask=np.full(own.num_rows, not known)), excess], names=["doc_id", "lang", "row", "n_bytes", "loglik", "excess"])

        return run

    schema = f"doc_id bigint, lang string, row string, n_bytes bigint, loglik double, excess {'double' if single else 'array<float>'}"
    frames = [texts.select("doc_id", "text", "lang", "row").mapInArrow(scorer(held), schema) for _, held in parts]
    if single:
        return frames[0]
    every = frames[0]
    for f in frames[1:]:
        every = every.unionByName(f)
    # Rows that repeat an id with another text are told apart by row, equal ones by their number.
    every = every.groupBy("doc_id", "lang", "row").agg((F.sum("n_bytes") / len(frames)).cast("bigint").alias("n_bytes"), F.sum("loglik").alias("loglik"), F.collect_list("excess").alias("excess"), (F.count(F.lit(1)) / len(frames)).cast("int").alias("times"))
    ratios = "aggregate(slice(excess, 2, size(excess) - 1), excess[0], (a, b) -> zip_with(a, b, (x, y) -> x + y))"
    excess = f"if(size(excess) = 0, null, aggregate({ratios}, 0D, (a, r) -> a + least(greatest(r / times - {EXCESS}D, 0D), {MOST_EXCESS}D)))"
    return every.withColumn("excess", F.expr(excess)).withColumn("loglik", F.col("loglik") / F.col("times")).withColumn("n_bytes", F.expr("n_bytes div times")).withColumn("times", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("times")


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = QUANTILE, margin: float = MARGIN, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """doc_id, lang, n_bytes, perplexity, threshold, contrast, contrast_threshold, keep for each row with an id.

    labels(doc_id, quality, toxic) name the trusted texts (quality 1, toxic not
    1) and the toxic ones (toxic 1, and no label of the same id that makes it trusted);
    other labels, nulls and unknown ids are ignored. A null language counts
    as ''. A language without trusted text has no model: perplexity and threshold are
    null and keep is true; without toxic text the contrast is null. Null and empty texts have the perplexity of the prior
    and are kept. An empty table gives no rows; repeated rows are each judged.
    """
    good = F.expr("coalesce(quality = 1, false) and coalesce(toxic, 0) <> 1")
    named = labels.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), good.alias("good"), F.expr("coalesce(toxic = 1, false)").alias("toxic"))
    named = A.session_checkpoint(named.where("good or toxic").groupBy("doc_id").agg(F.max("good").alias("trusted")))
    if named.count() <= MAX_BROADCAST_IDS:
        named = F.broadcast(named)
    texts = A.ids_and_texts(docs, id_col, text_col, lang_col, "lang").fillna("", ["lang"])
    model = F.when(F.col("trusted"), F.col("lang")).otherwise(F.concat("lang", F.lit(_TOXIC)))
    context = docs.sparkSession.sparkContext
    parts = [(set(s.langs), context.broadcast(s)) for s in shards(estimate(counts(texts.join(named, "doc_id").select("doc_id", "text", model.alias("lang")))), shard_rows)]
    row = F.lit(None).cast("string") if len(parts) == 1 else F.sha2(F.coalesce("text", F.lit("")), 256)
    x = A.session_checkpoint(scores(texts.withColumn("row", row), parts).select("doc_id", "lang", "n_bytes", "loglik", "excess"))
    marked = x.join(named, "doc_id", "left")
    prior = marked.where("trusted").groupBy("lang").agg((F.sum("loglik") / F.sum("n_bytes")).alias("mean"), (F.sum("excess") / F.sum("n_bytes")).alias("excess_mean"))
    prior = A.session_checkpoint(prior)  # one row a language, as are the thresholds
    perplexity = F.exp(-(F.col("loglik") + PRIOR * F.col("mean")) / (F.col("n_bytes") + PRIOR))
    contrast = (F.col("excess") + CONTRAST_PRIOR * F.col("excess_mean")) / (F.col("n_bytes") + CONTRAST_PRIOR)
    marked = marked.join(F.broadcast(prior), "lang", "left").withColumn("perplexity", perplexity).withColumn("contrast", contrast)
    of = lambda name, share, trusted: F.percentile_approx(F.when(F.col("trusted") == trusted, F.col(name)), share, 10000)
    limits = marked.where("trusted is not null").groupBy("lang").agg((of("perplexity", quantile, True) * margin).alias("threshold"), of("contrast", quantile, True).alias("high"), of("contrast", TOXIC_QUANTILE, False).alias("low"))
    # Between the two; not below the trusted quantile, and not 0 where no trusted document has an excess.
    between = F.when(F.col("low").isNotNull(), F.greatest(F.sqrt(F.col("high") * F.col("low")), F.col("high"), F.col("low") / 10))
    limits = A.session_checkpoint(limits.select("lang", "threshold", between.alias("contrast_threshold")))
    out = marked.join(F.broadcast(limits), "lang", "left")
    ordinary = F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)) & F.coalesce(F.col("contrast") <= F.col("contrast_threshold"), F.lit(True))
    return out.select("doc_id", "lang", "n_bytes", "perplexity", "threshold", "contrast", "contrast_threshold", (ordinary | (F.col("n_bytes") == 0)).alias("keep"))


def accept(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs that judge() keeps; rows without an id stay, and of rows that share an id all go if one does."""
    gone = judge(docs, labels, id_col, text_col, lang_col).where("not keep").select(F.col("doc_id").alias("__ql_id")).distinct()
    return docs.join(gone, docs[id_col].cast("bigint") == gone["__ql_id"], "left_anti")
