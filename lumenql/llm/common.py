"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Only where it is unset, and only in local mode (tests, a laptop), one of the
    machine's own is made; on a cluster that is an error."""
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if got:
        return got
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir names no shared folder")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lumenql-ckpt-"))
    return spark.sparkContext.getCheckpointDir()


#: Whether Spark removes an action's shuffle files where it ends. A frame has the value of when it was made.
SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def swept(df: DataFrame) -> DataFrame:
    """``df`` for one action, at whose end its shuffle files go; else they stay until the driver happens to collect its garbage."""
    conf = df.sparkSession.conf
    before = conf.get(SWEEP, None)
    conf.set(SWEEP, "true")
    try:
        return df.select("*")
    finally:
        conf.unset(SWEEP) if before is None else conf.set(SWEEP, before)


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder; what was shuffled for it is removed."""
    shared_folder(df.sparkSession)
    return swept(df).checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def null_safe_key(*cols: str | Column) -> Column:
    """A 64-bit key of a row's values in which nulls take part."""
    parts = [F.col(c) if isinstance(c, str) else c for c in cols]
    return F.xxhash64(*[x for p in parts for x in (p, p.isNull())])


#: A key that holds more than one in HEAVY of the rows of a join is joined by broadcast; there are fewer than HEAVY of them.
HEAVY = 10_000
#: Rows of one key that any task may hold.
HEAVY_ROWS = 1_000


def join_split(rows: DataFrame, keyed: DataFrame, key: str, n: str = "n") -> DataFrame:
    """``rows`` joined with ``keyed`` on ``key``, its ``n`` being how many of the rows have the key. Rows of hot keys stay
    where they are and meet a broadcast of those keys, whose number is bounded by their share; all others are shuffled.
    ``keyed``, one row for each key, should be narrow and checkpointed."""
    limit = max(HEAVY_ROWS, (swept(keyed.agg(F.sum(n))).collect()[0][0] or 0) // HEAVY)
    heavy = F.broadcast(keyed.where(F.col(n) > limit))
    hot = rows.join(heavy, key)
    return hot.unionByName(rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(keyed.where(F.col(n) <= limit), key))


#: Bits of the filter behind maybe_in, 2^27 (16 MB) at most whatever the number of rows: then only more are joined for nothing.
FILTER_BITS = 27


def _filter(keys: DataFrame) -> np.ndarray:
    """A bit for each hash in the column h, by the hash's low bits."""
    n = swept(keys.agg(F.count("*"))).collect()[0][0]
    k = min(FILTER_BITS, max(10, (16 * n).bit_length()))
    at = F.col("h").bitwiseAND(F.lit((1 << k) - 1))
    words = swept(keys.groupBy(F.shiftright(at, 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63L as int))")).alias("b"))).toArrow()
    out = np.zeros(1 << (k - 6), np.int64)
    out[words["w"].to_numpy()] = words["b"].to_numpy()
    return out


def maybe_in(rows: DataFrame, keys: DataFrame, *on: str) -> tuple[DataFrame, DataFrame]:
    """(those of ``rows`` that ``keys`` may hold by the columns ``on``, the others for certain). The filter that tells them apart is of bounded
    size and read where the rows are, so the others need no shuffle; a join must settle the first."""
    shared = rows.sparkSession.sparkContext.broadcast(_filter(keys.select(F.xxhash64(*on).alias("h"))))

    @F.arrow_udf("boolean")
    def maybe(h: pa.Array) -> pa.Array:
        bits = shared.value
        x = h.to_numpy(zero_copy_only=False).view(np.uint64)
        return pa.array((bits.view(np.uint64)[(x & np.uint64(len(bits) * 64 - 1)) >> np.uint64(6)] >> (x & np.uint64(63))) & np.uint64(1) == 1)

    marked = rows.withColumn("_maybe", maybe(F.xxhash64(*on)))
    return marked.where("_maybe").drop("_maybe"), marked.where("not _maybe").drop("_maybe")


#: Rows of an Arrow batch where texts go to Python; with Spark's default of 10,000 a batch of long texts takes a few hundred MB.
BATCH_ROWS = 1_000
#: Bytes after which a batch ends, for very long texts; buffers of larger batches are kept by the executor's allocator.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on the session sends texts to Python in batches of ``BATCH_ROWS`` and about ``BATCH_BYTES`` at most."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


_caches: list[dict] = []


def claim(cache: dict, *more: dict) -> dict:
    """Makes these the only caches a worker process keeps: an operator that starts empties what others have remembered."""
    others = [c for c in _caches if all(c is not x for x in (cache, *more))]
    for c in others:
        c.clear()
    _caches[:] = [cache, *more]
    if others:
        _give_back()
    return cache


def release(*only: dict) -> None:
    """At the end of a task: empties what this worker has claimed, or ``only`` these of it. An executor has more reused workers than running
    tasks and uses them in turn, so that each would hold a cache of its own while idle."""
    for c in only or _caches:
        c.clear()
    _give_back()


def _give_back() -> None:
    """Returns freed memory to the system; reused workers would hold it otherwise."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass
