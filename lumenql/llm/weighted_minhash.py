"""Document fingerprints by consistent weighted sampling, in DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions

#: Samples of a fingerprint, the largest weight that is drawn as one, and how often each such part is drawn.
SAMPLES = 128
CHUNK = 4
DRAWS = 3
SEED = 20_011


def _unit(bits: Column) -> Column:
    """A number in (0, 1) from the lowest 31 bits."""
    return (bits.bitwiseAND(F.lit(0x7FFFFFFF)).cast("double") + F.lit(0.5)) * F.lit(2.0**-31)


def samples(terms: DataFrame, keys: list[str], weights: list[str], n: int = SAMPLES, chunk: int = CHUNK, facts: int = 0) -> DataFrame:
    """Signatures: for each ``keys`` a map from bin to sample for every weight column, as sig_<weight>, an array<long> of ``n``
    samples, null where no weight fell.

    ``terms`` has one row per keys and term, with a long column ``term`` and non-negative integer weights; a
    weight of 0 leaves the term out. A weight is split into chunks of ``chunk`` at most, the i-th of one document facing
    the i-th of another, which leaves sums of minima and maxima as they are. Each chunk is drawn DRAWS times, and a hash deals the draws to the bins, so that
    no heavy term has one bin's say alone, and short texts fill more bins. Each draw has r and c from Gamma(2, 1) and b from [0, 1), fixed by hashes:
    t = floor(ln w / r + b), ln a = ln c - r (t - b + 1). The chunk of least a is its bin's sample, together
    with its t; two weighted sets then have equal samples with the probability of the generalised Jaccard
    similarity of what the bin holds, whose mean over the bins is that of the sets. One long holds ln a
    in its upper and a hash of (chunk, t) in its lower half, so a sample is a plain minimum, combined before any shuffle,
    and each chunk is drawn DRAWS times and not once for each sample.

    With ``facts``, rows whose column ``kind`` is from 1 to that are no terms: they bring a number, their ``term``, through
    the same aggregations, to the column fact_<kind>; null where there was none.
    """
    kind = F.col("kind") if facts else F.lit(0)
    top = F.greatest(*weights, F.lit(1))
    # the j-th draw is that of chunk j / DRAWS
    last = F.when(kind == 0, (F.floor((top - 1) / chunk).cast("int") + 1) * DRAWS - 1).otherwise(0)
    rows = terms.select(*keys, kind.alias("kind"), "term", *weights, F.explode(F.sequence(F.lit(0), last)).alias("_j")).withColumn("_i", F.floor(F.col("_j") / DRAWS).cast("int"))
    right = F.shiftrightunsigned
    hashed = rows.select(
        *keys, "kind", "term", *[F.least(F.col(w) - F.col("_i") * chunk, F.lit(chunk)).alias(w) for w in weights],
        F.xxhash64("term", "_j", F.lit(SEED)).alias("_h"), F.xxhash64("term", "_j", F.lit(SEED + 1)).alias("_g"), F.xxhash64("term", "_j", F.lit(SEED + 2)).alias("_k"),
    )
    drawn = hashed.select(
        *keys, "kind", "term", *weights, F.when(F.col("kind") > 0, -F.col("kind")).otherwise(F.pmod("_k", F.lit(n))).cast("int").alias("_bin"), right("_k", 32).alias("_tag"),
        (-F.ln(_unit(F.col("_h")) * _unit(right("_h", 31)))).alias("_r"), F.ln(-F.ln(_unit(F.col("_g")) * _unit(right("_g", 31)))).alias("_c"), _unit(right("_k", 16)).alias("_b"),
    )
    aggs = []
    for w in weights:
        t = F.floor(F.ln(F.col(w).cast("double")) / F.col("_r") + F.col("_b"))
        lna = F.col("_c") - F.col("_r") * (t.cast("double") - F.col("_b") + F.lit(1.0))
        tag = F.col("_tag").bitwiseXOR(t.bitwiseAND(F.lit(0xFFFFFFFF)))
        # ln a lies between about -70 and 4; 22 bits behind the point
        packed = F.shiftleft(((lna + F.lit(200.0)) * F.lit(float(1 << 22))).cast("bigint"), 32).bitwiseOR(tag)
        aggs.append(F.min(F.when(F.col("kind") > 0, F.col("term")).when(F.col(w) > 0, packed)).alias(f"_s_{w}"))
    bins = drawn.groupBy(*keys, "_bin").agg(*aggs)
    whole = lambda w: F.map_from_entries(F.collect_list(F.struct("_bin", f"_s_{w}")))
    of = bins.groupBy(*keys).agg(*[whole(w).alias(f"_m_{w}") for w in weights])
    order = F.sequence(F.lit(0), F.lit(n - 1))
    listed = lambda m: F.transform(order, lambda k: F.try_element_at(m, k))
    return of.select(*keys, *[listed(F.col(f"_m_{w}")).alias(f"sig_{w}") for w in weights], *[F.try_element_at(f"_m_{weights[0]}", F.lit(-k)).alias(f"fact_{k}") for k in range(1, facts + 1)])


def likeness(a: Column, b: Column) -> Column:
    """Equal samples' share of the bins in which either has one; 1 for two empty signatures, 0 for one."""
    filled = F.size(F.filter(F.zip_with(a, b, lambda x, y: F.coalesce(x, y)), lambda x: x.isNotNull()))
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(same / filled)


def printed(sig: Column) -> Column:
    """A signature as text: its samples' hashes in hex, eight digits each, dashes for an empty bin; empty for no words."""
    digits = lambda x: F.coalesce(F.lpad(F.lower(F.hex(x.bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0"), F.lit("--------"))
    return F.coalesce(F.array_join(F.transform(sig, digits), ""), F.lit(""))


def _bounds(docs: DataFrame, key: Column, blocks: int) -> list[int]:
    got = docs.select(key.alias("k")).agg(F.percentile_approx("k", [i / blocks for i in range(1, blocks)] or [0.5], 10_000).alias("q"), F.min("k").alias("low")).first()
    return sorted({got["low"], *(got["q"] or [])}) if got["low"] is not None else []


def fingerprint_chain(docs: DataFrame, blocks: int | None = None) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row.

    The terms are the words (maximal runs without white space, lower-cased) with their counts. The next document is that of the next
    doc_id (null first; rows of one doc_id in order of a hash of the text, then the text), after the last the first.
    The edited text ends with the next one's beginning instead of its own last quarter. Null text counts as empty; two
    wordless texts are alike (1), a wordless and another are not (0). With one row, it is its own next.

    Plan: quantiles of the ids, found first, deal the rows into blocks of the key's order, about as many rows each. Each block also
    gets the rows with which the following begins, so that a window within the block sees every next
    row; the last block gets the first ones. So the order over all rows costs one shuffle of the texts,
    and all aggregations after it run on the same distribution.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63)))
    if blocks is None:
        blocks = 4 * shuffle_partitions(spark)
    bounds = _bounds(docs, key, blocks)
    if not bounds:
        bounds = [0]
    edges = F.lit(bounds).cast("array<bigint>")
    last = len(bounds)
    # the number of bounds at or below the key, of a list as long as there are blocks
    place = F.size(F.filter(edges, lambda x: x <= F.col("_key")))
    given = docs.select(key.alias("_key"), F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    first = F.array_contains(edges, F.col("_key"))
    at = given.withColumn("_at", place).withColumn("_first", first)
    copies = F.when(F.col("_first"), F.array(F.struct(F.col("_at").alias("block"), F.lit(False).alias("guest")), F.struct(F.when(F.col("_at") == 1, last).otherwise(F.col("_at") - 1).alias("block"), F.lit(True).alias("guest")))).otherwise(
        F.array(F.struct(F.col("_at").alias("block"), F.lit(False).alias("guest")))
    )
    dealt = at.select("_key", "doc_id", "text", F.xxhash64("text").alias("_th"), F.explode(copies).alias("_c")).select("_key", "doc_id", "text", "_th", F.col("_c.block").alias("block"), F.col("_c.guest").alias("guest"))
    dealt = dealt.repartition(blocks, "block")  # a fixed number: adaptive execution would merge blocks by the size of the texts, whose terms take more
    order = Window.partitionBy("block").orderBy("guest", "_key", F.col("doc_id").isNotNull(), "_th", "text")
    seen = dealt.select("*", F.lead("text").over(order).alias("_next"), F.row_number().over(order).alias("row"))
    n = F.length("text")
    q = F.floor(n / 4).cast("int")
    head = F.substring(F.col("text"), F.lit(1), n - q)
    new = F.substring(F.coalesce("_next", F.lit("")), F.lit(1), q)
    parts = seen.select("block", "row", "guest", "doc_id", n.cast("bigint").alias("n_chars"), F.col("text"), head.alias("head"), new.alias("new"))
    # what the result repeats of a row goes along as numbers: doc_id, n_chars, guest and the four quarters of the hash
    digest = F.sha2(F.concat("head", "new"), 256)
    given = [F.col("doc_id"), F.col("n_chars"), F.col("guest").cast("bigint"), *[F.conv(F.substring(digest, 16 * k + 1, 16), 16, -10).cast("bigint") for k in range(4)]]
    # head up to its last blank belongs to both texts; what follows is split anew for each
    tail = F.substring_index("head", " ", -1)
    shared = F.length("head") - F.length(tail)
    part = lambda s, a, b, kind=0, v=None: F.struct(s.alias("s"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(kind).alias("kind"), (F.lit(None).cast("bigint") if v is None else v).alias("v"))
    sliced = parts.select(
        "block", "row",
        F.array(
            part(F.substring(F.col("head"), F.lit(1), shared), 1, 1),
            part(F.substring(F.col("text"), shared + 1, F.length("text")), 1, 0),
            part(F.concat(tail, F.col("new")), 0, 1),
            *[part(F.lit(""), 0, 0, k, v) for k, v in enumerate(given, 1)],
        ).alias("p"),
    )
    words = sliced.select("block", "row", F.explode("p").alias("p")).select("block", "row", "p.a", "p.b", "p.kind", "p.v", F.explode(F.split(F.lower("p.s"), r"\s+")).alias("w"))
    words = words.where("kind > 0 and v is not null or kind = 0 and w <> ''").withColumn("term", F.when(F.col("kind") > 0, F.col("v")).otherwise(F.xxhash64("w")))
    terms = words.groupBy("block", "row", "kind", "term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    sig = samples(terms, ["block", "row"], ["a", "b"], facts=len(given))
    wordy = lambda s: F.when(F.exists(s, lambda x: x.isNotNull()), F.col(s)).alias(s)
    both = sig.select(
        "block", "row", F.col("fact_1").alias("doc_id"), F.col("fact_2").alias("n_chars"), (F.col("fact_3") == 1).alias("guest"),
        F.concat(*[F.lpad(F.lower(F.hex(f"fact_{k}")), 16, "0") for k in range(4, 8)]).alias("edited_sha256"), wordy("sig_a"), wordy("sig_b"),
    )
    after = Window.partitionBy("block").orderBy("row")
    out = both.select("*", F.lead("sig_a").over(after).alias("_sig_next")).where(~F.col("guest"))
    return out.select(
        "doc_id", "n_chars", "edited_sha256", printed(F.col("sig_a")).alias("fingerprint"), printed(F.col("sig_b")).alias("edited_fingerprint"),
        likeness(F.col("sig_a"), F.col("sig_b")).alias("near_edited"), likeness(F.col("sig_a"), F.col("_sig_next")).alias("near_next"),
    )
