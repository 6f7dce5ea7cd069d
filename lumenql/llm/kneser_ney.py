"""Quality by perplexity under an interpolated modified Kneser-Ney model of characters.

The model is trained on trusted text, all of it; counts, continuation counts, discounts and back-off weights are
DataFrame aggregations and joins on the n-gram and its context, so they are sharded like any join. Documents
are then scored and judged against quantiles of their language.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import claim, cut, join_split, release, small_batches, swept

ORDER = 5
#: Trusted ids and model rows are broadcast up to these many; beyond, both become shuffled joins.
BROADCAST_IDS = 2_000_000
BROADCAST_GRAMS = 3_000_000
FLUSH = 100_000
BEGIN, END = "\x02", "\x03"
#: Characters the lowest order spreads its discount over.
ALPHABET = 2_000
#: How much wider the threshold is for a text of one character.
SHORT = 2.0
#: Characters of the window by which a text is judged as toxic.
TOXIC_WINDOW = 9
_MULT = np.uint64(0x9E3779B97F4A7C15)


def padded(text: str, order: int = ORDER) -> str:
    return BEGIN * (order - 1) + text + END


def _grams(docs: DataFrame, order: int) -> DataFrame:
    """(gram, n): counts of each task's texts, added up within the task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = claim(Counter())

        def out() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array([k.decode("utf-32-le", "surrogatepass") for k in total], pa.string()), pa.array(list(total.values()), pa.int64())], ["gram", "n"])
            total.clear()
            return got

        for b in batches:
            texts = [padded(t, order) for x in b.column(0) if (t := x.as_py())]
            i = 0
            while i < len(texts):
                part, size = [], 0
                while i < len(texts) and size < 1 << 18:
                    part.append(texts[i])
                    size += len(texts[i])
                    i += 1
                codes = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32)
                lens = np.array(list(map(len, part)))
                ok = np.ones(len(codes), bool)  # a gram does not reach over its text's end
                for k in range(1, order):
                    ok[np.cumsum(lens) - k] = False
                at = np.flatnonzero(ok)
                keys = _keys(codes, order)[at]
                _, first, n = np.unique(keys, return_index=True, return_counts=True)
                raw = codes.tobytes()
                for p, k in zip(at[first].tolist(), n.tolist()):
                    total[raw[4 * p : 4 * (p + order)]] += k
            if len(total) > FLUSH:
                yield out()
        if total:
            yield out()
        release()

    return docs.select("text").mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _keys(codes: np.ndarray, order: int) -> np.ndarray:
    """64-bit keys of the grams of ``order`` characters that start at each place (the last order-1 are meaningless)."""
    h = np.full(len(codes), order, np.uint64)
    c = codes.astype(np.uint64)
    for k in range(order):
        h = (h + np.concatenate([c[k:], np.zeros(k, np.uint64)])) * _MULT
        h ^= h >> np.uint64(29)
    return h


def _discounts(counts: DataFrame) -> tuple[float, float, float]:
    n = {r["n"]: r["k"] for r in swept(counts.where("n <= 4").groupBy("n").agg(F.count("*").alias("k"))).collect()}
    n1, n2, n3, n4 = (float(n.get(i, 0)) for i in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    d = [min(i, max(0.0, i - (i + 1) * y * b / a)) if a and b else i * 0.5 for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return d[0], d[1], d[2]


def train(trusted: DataFrame, order: int = ORDER) -> DataFrame:
    """The model as rows (gram, logp, backoff): logp is the interpolated log probability of a gram's last character
    behind its others (null where the gram is known as a context only), backoff the log weight a gram
    leaves, as a context, to the next lower order (null where it is no context).

    The highest order has raw counts, the others the numbers of different characters seen before a gram;
    each order has its own three discounts from counts of counts.
    """
    counts = cut(_grams(trusted.where("text is not null and text <> ''"), order))
    levels = {order: counts}
    for k in range(order - 1, 0, -1):
        levels[k] = cut(levels[k + 1].groupBy(F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("n")))
    lower = None
    out = []
    for k in range(1, order + 1):
        d1, d2, d3 = _discounts(levels[k])
        d = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        rows = levels[k].withColumn("ctx", F.substring("gram", 1, k - 1))
        sums = rows.groupBy("ctx").agg(F.sum("n").alias("total"), F.sum(d).alias("mass"))
        joined = rows.join(sums, "ctx").withColumn("seen", (F.col("n") - d) / F.col("total")).withColumn("gamma", F.col("mass") / F.col("total"))
        if lower is None:
            probs = joined.select("gram", (F.col("seen") + F.col("gamma") / ALPHABET).alias("p"))
        else:
            below = lower.select(F.col("gram").alias("suffix"), F.col("p").alias("q"))
            probs = joined.withColumn("suffix", F.substring("gram", 2, k - 1)).join(below, "suffix").select("gram", (F.col("seen") + F.col("gamma") * F.col("q")).alias("p"))
        probs = cut(probs)
        out.append(probs.select("gram", F.log("p").alias("logp"), F.lit(None).cast("double").alias("backoff")))
        out.append(sums.select(F.col("ctx").alias("gram"), F.lit(None).cast("double").alias("logp"), F.log(F.col("mass") / F.col("total")).alias("backoff")))
        lower = probs
    return cut(reduce(DataFrame.unionByName, out).groupBy("gram").agg(F.max("logp").alias("logp"), F.max("backoff").alias("backoff")))


class Table:
    """Open-addressing hash table from 64-bit keys to floats, probed for whole arrays at a time."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, int(len(keys) * 1.5).bit_length())
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.values = np.zeros(1 << self.bits, np.float64)
        left = np.arange(len(keys))
        slot = self._slot(keys)
        while len(left):
            s = slot[left]
            free = self.keys[s] == 0
            _, one = np.unique(np.where(free, s, -1 - np.arange(len(s))), return_index=True)
            put = np.zeros(len(s), bool)
            put[one] = True
            put &= free
            self.keys[s[put]] = keys[left[put]]
            self.values[s[put]] = values[left[put]]
            left = left[~put]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, found)"""
        slot = self._slot(keys)
        k = self.keys[slot]
        found = k == keys
        value = np.where(found, self.values[slot], 0.0)
        left = np.flatnonzero(~found & (k != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            k = self.keys[slot[left]]
            hit = k == keys[left]
            value[left[hit]] = self.values[slot[left[hit]]]
            found[left[hit]] = True
            left = left[~hit & (k != 0)]
        return value, found


class Scorer:
    def __init__(self, grams: pa.StringArray, logp: np.ndarray, backoff: np.ndarray, order: int) -> None:
        self.order = order
        by = pc.utf8_length(grams).to_numpy(zero_copy_only=False)
        self.probs, self.weights = {}, {}
        for k in range(0, order + 1):
            for into, of in ((self.probs, logp), (self.weights, backoff)):
                at = np.flatnonzero((by == k) & ~np.isnan(of))
                if k == 0:
                    continue
                codes = _codes(grams.take(pa.array(at)))
                into[k] = Table(_keys(codes, k)[::k] if len(at) else np.zeros(0, np.uint64), of[at])
        root = np.flatnonzero((by == 0) & ~np.isnan(backoff))
        self.floor = float((backoff[root[0]] if len(root) else 0.0) - np.log(ALPHABET))

    def logps(self, codes: np.ndarray) -> np.ndarray:
        """Log probability of every character from place order-1 on, given those before it."""
        n, top = len(codes) - self.order + 1, self.order
        out = np.zeros(n, np.float64)
        left = np.arange(n)
        for k in range(top, 0, -1):
            keys = _keys(codes, k)[top - k : top - k + n] if k == top else _keys_at(codes, k, left + top - k)
            v, found = self.probs[k].get(keys)
            out[left[found]] += v[found]
            left = left[~found]
            if not len(left):
                return out
            if k > 1:
                w, _ = self.weights[k - 1].get(_keys_at(codes, k - 1, left + top - k))
                out[left] += w
        out[left] += self.floor
        return out

    def total(self, text: str) -> float:
        codes = np.frombuffer(padded(text, self.order).encode("utf-32-le", "surrogatepass"), np.uint32)
        s = 0.0
        for i in range(0, len(codes) - self.order + 1, 1 << 20):
            s += float(self.logps(codes[i : i + (1 << 20) + self.order - 1]).sum())
        return s

    def worst(self, text: str, other: Scorer) -> float:
        codes = np.frombuffer(padded(text, self.order).encode("utf-32-le", "surrogatepass"), np.uint32)
        n, out = len(codes) - self.order + 1, -np.inf
        for i in range(0, max(1, n - TOXIC_WINDOW + 1), 1 << 20):  # slices overlap by a window less one
            part = codes[i : i + (1 << 20) + TOXIC_WINDOW - 1 + self.order - 1]
            out = max(out, worst(other.logps(part) - self.logps(part)))
        return out


def _keys_at(codes: np.ndarray, order: int, at: np.ndarray) -> np.ndarray:
    h = np.full(len(at), order, np.uint64)
    for k in range(order):
        h = (h + codes[at + k].astype(np.uint64)) * _MULT
        h ^= h >> np.uint64(29)
    return h


def _codes(grams: pa.StringArray) -> np.ndarray:
    """The code points of all grams in a row, from the array's own bytes."""
    _, ends, data = grams.buffers()
    if not len(grams) or data is None:
        return np.zeros(0, np.uint32)
    at = np.frombuffer(ends, np.int32)[grams.offset : grams.offset + len(grams) + 1]
    return np.frombuffer(data.to_pybytes()[at[0] : at[-1]].decode("utf-8").encode("utf-32-le"), np.uint32)


def load(model: DataFrame, order: int = ORDER) -> Scorer:
    """The model's tables, made from Arrow columns without an object for each gram."""
    rows = model.select(F.col("gram").cast("string").alias("gram"), "logp", "backoff").toArrow()
    grams = pa.concat_arrays([c.cast(pa.string()) for c in rows["gram"].chunks]) if rows.num_rows else pa.array([], pa.string())
    return Scorer(grams, rows["logp"].to_numpy(), rows["backoff"].to_numpy(), order)


def worst(diff: np.ndarray, window: int = TOXIC_WINDOW) -> float:
    """The largest sum over a run of ``window`` values, or over all where there are fewer."""
    sums = np.concatenate([[0.0], np.cumsum(diff)])
    k = min(window, len(diff))
    return float((sums[k:] - sums[:-k]).max())


def score(docs: DataFrame, model: DataFrame, order: int = ORDER, most: int = BROADCAST_GRAMS, keep_text: bool = False, toxic: DataFrame | None = None) -> DataFrame:
    """``docs`` (with or without its text at last), log_perplexity and toxicity: minus the mean log probability of the
    text's characters and its end, and the largest log likelihood ratio of ``toxic``, a second model, to the first in a window of
    TOXIC_WINDOW characters; null for null or empty text, toxicity also without a second model."""
    if model.count() + (toxic.count() if toxic is not None else 0) > most:
        return _score_sharded(docs, model, order, keep_text, toxic)
    shared = docs.sparkSession.sparkContext.broadcast((load(model, order), load(toxic, order) if toxic is not None else None))
    release()  # what loading took goes back to the system
    names = docs.columns
    at = names.index("text")
    keep = [i for i in range(len(names)) if keep_text or i != at]
    schema = ", ".join(f"`{docs.schema[i].name}` {docs.schema[i].dataType.simpleString()}" for i in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim({})
        scorer, other = shared.value
        for b in batches:
            values: list[float | None] = []
            worsts: list[float | None] = []
            group: list[str] = []

            def flush() -> None:
                if not group:
                    return
                pads = [padded(t, order) for t in group]
                codes = np.frombuffer("".join(pads).encode("utf-32-le", "surrogatepass"), np.uint32)
                logs = scorer.logps(codes)
                diff = other.logps(codes) - logs if other else None
                begin = np.cumsum([0, *map(len, pads)])
                sums = np.concatenate([[0.0], np.cumsum(logs)])
                for i, t in enumerate(group):
                    values.append(-(sums[begin[i] + len(t) + 1] - sums[begin[i]]) / (len(t) + 1))
                    worsts.append(worst(diff[begin[i] : begin[i] + len(t) + 1]) if other else None)
                group.clear()

            size = 0
            for t in b.column(at):
                t = t.as_py()
                if not t:
                    flush()
                    size = 0
                    values.append(None)
                    worsts.append(None)
                elif len(t) > 1 << 18:
                    flush()
                    size = 0
                    values.append(-scorer.total(t) / (len(t) + 1))
                    worsts.append(scorer.worst(t, other) if other else None)
                else:
                    group.append(t)
                    size += len(t)
                    if size > 1 << 17:
                        flush()
                        size = 0
            flush()
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), pa.array(values, pa.float64()), pa.array(worsts, pa.float64())], [*(names[i] for i in keep), "log_perplexity", "toxicity"])
        release()

    return docs.mapInArrow(run, f"{schema}, log_perplexity double, toxicity double")


def _joined(need: DataFrame, model: DataFrame, order: int, name: str) -> DataFrame:
    """``need`` and the log probability of each gram's last character. The different grams meet the model's shards, order by order, and what they
    give comes back to all rows. Parts of grams that many share, as single letters, and frequent grams are joined by broadcast of those few."""
    root = model.where("gram = ''").select("backoff").first()
    value = F.lit(float((root[0] if root and root[0] is not None else 0.0) - np.log(ALPHABET)))
    grams = cut(need.groupBy("gram").agg(F.count("*").alias("_held")))

    def looked_up(rows: DataFrame, key: str, part: Column, of: str, to: str) -> DataFrame:
        rows = rows.withColumn(key, part)
        known = model.where(F.col(of).isNotNull()).select(F.col("gram").alias(key), F.col(of).alias(to))
        return join_split(rows, cut(rows.groupBy(key).agg(F.count("*").alias("n")).join(known, key, "left")), key).drop("n", key)

    for k in range(1, order + 1):
        grams = looked_up(grams, "_g", F.substring("gram", order - k + 1, k), "logp", f"p{k}")
        if k > 1:
            grams = looked_up(grams, "_g", F.substring("gram", order - k + 1, k - 1), "backoff", f"w{k}")
            value = F.coalesce(F.col(f"p{k}"), F.coalesce(F.col(f"w{k}"), F.lit(0.0)) + value)
        else:
            value = F.coalesce(F.col("p1"), value)
    return join_split(need, cut(grams.select("gram", F.col("_held").alias("_n"), value.alias(name))), "gram", "_n").drop("_n")


def _score_sharded(docs: DataFrame, model: DataFrame, order: int, keep_text: bool = False, toxic: DataFrame | None = None) -> DataFrame:
    """The same by joins: each text's different grams meet the models' shards, and for the windows come back to the text."""
    rows = docs.withColumn("_row", F.monotonically_increasing_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, text in zip(b.column(0).to_pylist(), b.column(1)):
                if t := text.as_py():
                    t = padded(t, order)
                    c = Counter(t[i : i + order] for i in range(len(t) - order + 1))
                    yield pa.RecordBatch.from_arrays([pa.array([row] * len(c), pa.int64()), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["_row", "gram", "n"])

    @F.arrow_udf("double")
    def windows(texts: pa.Array, grams: pa.Array) -> pa.Array:
        out: list[float | None] = []
        for t, g in zip(texts, grams):
            t, g = t.as_py(), g.as_py()
            if t and g:
                t, by = padded(t, order), {x["gram"]: x["d"] for x in g}
                out.append(worst(np.array([by[t[i : i + order]] for i in range(len(t) - order + 1)])))
            else:
                out.append(None)
        return pa.array(out, pa.float64())

    need = _joined(cut(rows.select("_row", "text").mapInArrow(run, "_row long, gram string, n long")), model, order, "v")
    sums = [(-F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("log_perplexity")]
    if toxic is None:
        out = rows.join(need.groupBy("_row").agg(*sums), "_row", "left").withColumn("toxicity", F.lit(None).cast("double"))
    else:
        need = _joined(need, toxic, order, "t")
        per = need.groupBy("_row").agg(*sums, F.collect_list(F.struct("gram", (F.col("t") - F.col("v")).alias("d"))).alias("_grams"))
        out = rows.join(per, "_row", "left").withColumn("toxicity", windows("text", "_grams")).drop("_grams")
    return (out if keep_text else out.drop("text")).drop("_row")


def trusted_flags(docs: DataFrame, labels: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """``docs``, trusted: whether its doc_id is labelled as of quality 1 and toxic 0, and nowhere otherwise; and toxic: whether it is labelled so."""
    clean, bad = (F.col("quality") == 1) & (F.col("toxic") == 0), F.coalesce(F.col("toxic") == 1, F.lit(False))
    ids = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min(clean).alias("trusted"), F.max(bad).alias("toxic")).where("trusted or toxic")
    ids = ids.select(F.col("doc_id").cast("bigint").alias("_id"), "trusted", "toxic")
    if ids.count() <= most:
        ids = F.broadcast(ids)
    return docs.join(ids, F.col("doc_id").cast("bigint") == F.col("_id"), "left").drop("_id").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("trusted", "toxic")})


#: The fifth of the trusted documents that is kept from training, for limits that hold for texts the model hasn't seen.
HELD = "pmod(xxhash64(doc_id), 5) = 0"


def _limits(scored: DataFrame, upper: float, slack: float, least: int) -> tuple[DataFrame, DataFrame]:
    good = scored.where("trusted and log_perplexity is not null").where(HELD).withColumn("score", F.col("log_perplexity") - SHORT / F.sqrt(F.greatest("n_chars", F.lit(1))))
    q = F.percentile_approx("score", F.array(F.lit(0.5), F.lit(upper)), 10_000)
    limit = F.col("q")[0] + slack * (F.col("q")[1] - F.col("q")[0])
    per = good.groupBy(F.col("lang").alias("_lang")).agg(q.alias("q"), F.count("*").alias("n")).where(F.col("n") >= least)
    return per.select("_lang", limit.alias("_limit")), good.agg(q.alias("q")).select(limit.alias("_every"))


def _toxic_model(flagged: DataFrame, order: int) -> DataFrame | None:
    """The model of toxic text, from four fifths of what is labelled so; none where that is nothing."""
    bad = flagged.where("toxic and text is not null and text <> ''").where(f"NOT ({HELD})")
    return None if bad.isEmpty() else train(bad, order)


def _toxic_limit(scored: DataFrame, upper: float) -> DataFrame:
    """_most, one row: from the ``upper`` quantile of held-out trusted documents a quarter of the way to the median of held-out toxic
    ones; null, which rejects nothing, where that median isn't above."""
    held = scored.where(HELD)
    q = [F.percentile_approx(F.when(F.col(c), F.col("toxicity")), p, 10_000) for c, p in (("trusted", upper), ("toxic", 0.5))]
    return held.agg(q[0].alias("a"), q[1].alias("b")).select(F.when(F.col("b") > F.col("a"), F.col("a") + (F.col("b") - F.col("a")) / 4).alias("_most"))


def _threshold(scored: DataFrame, per: DataFrame, every: DataFrame, most: DataFrame) -> DataFrame:
    """Adds threshold and keep; the limits have one row for each language with enough trusted documents."""
    out = scored.join(F.broadcast(per), F.col("lang") == F.col("_lang"), "left").join(F.broadcast(every), F.lit(True), "left")
    out = out.withColumn("threshold", F.coalesce("_limit", "_every") + SHORT / F.sqrt(F.greatest("n_chars", F.lit(1)))).drop("_lang", "_limit", "_every")
    out = out.join(F.broadcast(most), F.lit(True), "left")
    fluent = F.coalesce(F.col("log_perplexity") <= F.col("threshold"), F.col("log_perplexity").isNotNull())
    return out.withColumn("keep", fluent & F.coalesce(F.col("toxicity") <= F.col("_most"), F.lit(True))).drop("_most")


def judge(docs: DataFrame, labels: DataFrame, order: int = ORDER, upper: float = 0.99, slack: float = 2.5, least: int = 30) -> DataFrame:
    """(doc_id, lang, n_chars, log_perplexity, threshold, keep) for each row of ``docs``.

    Four fifths of the trusted documents, by a hash of the id, train the model; the others set the limits. A language's threshold is the median of their log perplexity plus ``slack``
    times the distance from there to the ``upper`` quantile; languages with fewer than ``least`` such documents, and null, take that of
    all. Short texts, whose mean is uncertain, are held against a threshold wider by SHORT / sqrt(n_chars).
    A second model learns from documents labelled as toxic, four fifths of them again; a document's toxicity is the likelihood ratio of its worst window, and its
    limit comes from the held-out fifth.
    keep: at or below both. Documents without text have no perplexity and are not
    kept; with no trusted documents at all, everything with text is kept.
    """
    small_batches(docs.sparkSession)
    given = docs.select("doc_id", "lang", F.length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_chars"), "text")
    flagged = trusted_flags(given, labels)
    model = train(flagged.where("trusted").where(f"NOT ({HELD})"), order)
    scored = cut(score(flagged, model, order, toxic=_toxic_model(flagged, order)))
    return _threshold(scored, *_limits(scored, upper, slack, least), _toxic_limit(scored, upper)).select("doc_id", "lang", "n_chars", "log_perplexity", "threshold", "keep")


def keep_good(docs: DataFrame, labels: DataFrame, order: int = ORDER, upper: float = 0.99, slack: float = 2.5, least: int = 30) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, all columns as they are.

    Labelled texts are scored first, for the limits; then all, row by row where they are read, so that no text is shuffled.
    """
    small_batches(docs.sparkSession)
    names = docs.columns
    wrapped = docs.select("doc_id", "lang", F.length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_chars"), "text", F.struct(*[c for c in names if c != "text"]).alias("_rest"))
    flagged = trusted_flags(wrapped.drop("_rest"), labels)
    model, toxic = train(flagged.where("trusted").where(f"NOT ({HELD})"), order), _toxic_model(flagged, order)
    held = cut(score(flagged.where("trusted or toxic").where(HELD), model, order, toxic=toxic))
    per, every = _limits(held, upper, slack, least)
    out = _threshold(score(wrapped, model, order, keep_text=True, toxic=toxic), cut(per), cut(every), cut(_toxic_limit(held, upper))).where("keep")
    return out.select(*[F.col("text") if c == "text" else F.col(f"_rest.`{c}`").alias(c) for c in names])
