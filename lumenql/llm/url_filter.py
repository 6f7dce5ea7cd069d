"""URL filter: a blocked Bloom filter of listed keys before an exact hash join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_split

#: The filter's size is 2^k blocks of eight 32-bit words, about BITS bits for each key, MAX_BLOCKS blocks at most
#: (64 MB); beyond, only the share of false hits that the join removes grows.
BITS = 16
MAX_BLOCKS = 1 << 21
#: Odd multipliers, one for each word of a block, of the split-block Bloom filter in the Parquet format (fixed values).
SALT = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], dtype=np.uint32)


def _place(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    u = h.view(np.uint64)
    block = ((u >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    bit = (u.astype(np.uint32)[:, None] * SALT[None, :]) >> np.uint32(27)
    return block.astype(np.int64), np.uint32(1) << bit


def bloom(keys: DataFrame, hash_col: str) -> np.ndarray:
    """The filter over long hashes, built where the keys are: each task sends its own non-empty blocks, OR-ed by block."""
    n = keys.count()
    blocks = 1
    while blocks < MAX_BLOCKS and blocks * 256 < n * BITS:
        blocks *= 2

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            at, bits = _place(p[hash_col].to_numpy(dtype=np.int64), blocks)
            yield pd.DataFrame({"block": at} | {f"w{i}": bits[:, i].astype(np.int64) for i in range(8)})

    schema = "block long, " + ", ".join(f"w{i} long" for i in range(8))
    rows = keys.select(hash_col).mapInPandas(run, schema).groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(8)])
    out = np.zeros((blocks, 8), dtype=np.uint32)
    for r in rows.toLocalIterator():
        out[r["block"]] = r[1:]
    return out


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """Behind the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict; columns of the caller with these names are replaced, all others stay.

    ``rules``: (host, path, verdict). A rule fits its host and all subdomains if the url's path starts with
    the rule's; of those that fit, the longest (host and path together, then host) wins, and ``rule`` names it; where a
    list holds one rule twice with different verdicts, block wins. Null rule means no listed key fits: the
    url's verdict is ``default``. Null urls have empty host and path, as empty urls do. Repeated rows each come back; an empty table gives no rows,
    and an empty list the default for all.

    Candidate keys of a url are its host's suffixes times its path's prefixes of listed lengths. The filter, whose
    size is bounded, passes possible hits only. Pages without one are not shuffled. Of the others each different url is
    settled once, by a join with the list on the whole key, and comes back to its pages; keys and urls that hold a large share of the rows
    are joined by broadcast of those few, all others by a shuffle.
    """
    spark = pages.sparkSession
    listed = rules.where("host is not null and path is not null").groupBy(F.col("host").alias("_h"), F.col("path").alias("_p")).agg(
        F.when(F.max((F.col("verdict") == "block").cast("int")) == 1, "block").otherwise("allow").alias("_verdict")
    ).withColumn("_key", F.xxhash64("_h", "_p"))
    lengths = sorted(r[0] for r in listed.select(F.length("_p")).distinct().collect())  # not more than the longest path has characters
    deepest = listed.agg(F.max(F.size(F.split("_h", r"\.")))).first()[0] or 0
    table = spark.sparkContext.broadcast(bloom(listed, "_key"))

    @F.arrow_udf("array<boolean>")
    def possible(keys: pa.Array) -> pa.Array:
        f = table.value
        at, bits = _place(keys.flatten().to_numpy(zero_copy_only=False), len(f))
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys)]).astype(np.int32)), pa.array(((f[at] & bits) == bits).all(axis=1)))

    names = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    url = F.coalesce(F.col("_rest.url"), F.lit(""))
    known = pages.select(F.struct(*names).alias("_rest")).withColumn("_url", url).withColumns({"host": host_of(F.col("_url")), "path": path_of(F.col("_url"))})
    labels = F.split("host", r"\.")
    n = F.least(F.size(labels), F.lit(max(deepest, 1)))
    hosts = F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(labels, F.size(labels) - k + 1, k), "."))
    keys = [F.array().cast("array<struct<h: string, p: string>>")]
    for size in lengths:
        keys.append(F.transform(hosts, lambda h: F.struct(h.alias("h"), F.substring("path", 1, size).alias("p"))))
    known = known.withColumn("_keys", F.concat(*keys))
    known = known.withColumn("_may", possible(F.transform("_keys", lambda k: F.xxhash64(k.h, k.p))))
    hit = known.where(F.exists("_may", lambda x: x))
    rest = known.where(~F.exists("_may", lambda x: x))

    kept = F.filter("_keys", lambda _, i: F.get("_may", i))
    urls = cut(hit.groupBy("_url").agg(F.count("*").alias("n"), F.first(kept).alias("_keys")))
    # the filter has passed what may be listed; the join on the whole key removes false hits
    cand = urls.select("_url", F.explode("_keys").alias("_k")).select("_url", F.col("_k.h").alias("h"), F.col("_k.p").alias("p"), F.xxhash64("_k.h", "_k.p").alias("_key"))
    many = cut(cand.groupBy("_key").agg(F.count("*").alias("n")).join(listed, "_key"))
    exact = join_split(cand, many, "_key").where("h = _h and p = _p")
    best = exact.groupBy("_url").agg(F.max(F.struct((F.length("h") + F.length("p")).alias("n"), F.length("h").alias("m"), F.concat("h", "p").alias("rule"), F.col("_verdict").alias("verdict"))).alias("_best"))
    settled = cut(urls.select("_url", "n").join(best, "_url", "left"))
    done = join_split(hit.select("_rest", "_url", "host", "path"), settled, "_url").select("_rest", "host", "path", "_best.rule", "_best.verdict")
    every = done.unionByName(rest.select("_rest", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict")))
    return every.select(*[F.col(f"_rest.`{c}`").alias(c) for c in names], "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
