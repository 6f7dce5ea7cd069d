"""Change logs as bounded streams: replay, cursors, latest rows by key."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.recursive import shared_folder


def source(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream of the Parquet files at a path (a file or a folder)."""
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path) if not name.endswith(".parquet") else spark.readStream.schema(schema).parquet(f"{folder}/{name}*")


def replay(stream: DataFrame, after: int, key: str = "event_id") -> DataFrame:
    """Runs a stream over what is there, from behind a cursor, and returns what it wrote."""
    spark = stream.sparkSession
    base = os.path.join(shared_folder(spark), f"replay-{uuid.uuid4().hex}")
    run = stream.where(F.col(key) > after).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{base}/out")


def latest_by_key(stream: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key, kept by merging every micro-batch into a table of its own version."""
    spark = stream.sparkSession
    base = os.path.join(shared_folder(spark), f"latest-{uuid.uuid4().hex}")
    done: list[str] = []
    last = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])

    def merge(batch: DataFrame, n: int) -> None:
        rows = batch.sparkSession.read.parquet(done[-1]).unionByName(batch) if done else batch
        to = f"{base}/v{n}"
        rows.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r").write.mode("overwrite").parquet(to)
        if to not in done:
            done.append(to)

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(done[-1])


def gtid_set(events: DataFrame, domain: str, seq: str, pos: str) -> DataFrame:
    """The last sequence number of each domain in log order."""
    return events.groupBy(domain).agg(F.max_by(seq, pos).alias("seq"))


def lag(events: DataFrame, ts: str, now) -> DataFrame:
    """Seconds the newest event is behind; both times count as the nearest whole second, halves as the even one, like a cast of DuckDB's. Times without a zone
    are taken as of UTC, so that the session's zone doesn't matter."""
    local = events.schema[ts].dataType.typeName() == "timestamp_ntz"

    def seconds(t: Column) -> Column:
        at = F.concat(t.cast("timestamp_ntz").cast("string"), F.lit("Z")).cast("timestamp") if local else t.cast("timestamp")
        return F.bround(F.unix_micros(at).cast("decimal(20,0)") / 1_000_000).cast("bigint")

    return events.agg((seconds(F.lit(now)) - seconds(F.max(ts))).alias("seconds_behind"))


def interval(spark: SparkSession, start: str, seconds: int, n: int) -> DataFrame:
    """(tick): the first n times of a periodic timer, the first one period after its start."""
    first = F.unix_seconds(F.lit(start).cast("timestamp"))
    return spark.range(1, n + 1).select(F.timestamp_seconds(first + F.col("id") * seconds).alias("tick"))


def verified(log: DataFrame, seq: str, payload: str, crc: str) -> DataFrame:
    """The records before the first that fails: whose checksum isn't that of its payload, or before which a number is missing.

    Numbers are whole and begin at the least one. The first gap is found from counts by ranges of numbers, so no task sees the whole log in order.
    """
    bad = log.where(F.col(payload).isNull() | (F.crc32(F.col(payload).cast("binary")) != F.col(crc))).agg(F.min(seq).alias("x"))
    first = log.agg(F.min(seq).alias("low"))
    step = 4096
    ranges = log.crossJoin(F.broadcast(first)).groupBy(F.floor((F.col(seq) - F.col("low")) / step).alias("r")).agg(F.count_distinct(seq).alias("n"), F.min("low").alias("low"))
    known = ranges.select((F.col("r") + 1).alias("after"))
    # a range that is full, or whose follower is missing, needs no look inside
    gap_range = ranges.agg(F.min(F.when(F.col("n") < step, F.col("r"))).alias("r"), F.max("r").alias("top"), F.min("low").alias("low"))
    missing = ranges.join(known, ranges["r"] == known["after"], "left").where("after is null and r > 0").agg(F.min("r").alias("m"))
    inside = log.crossJoin(F.broadcast(gap_range)).where(F.floor((F.col(seq) - F.col("low")) / step) == F.col("r"))
    inside = inside.select(F.col(seq).alias("s"), (F.col("low") + F.col("r") * step).alias("begin"), (F.col("r") < F.col("top")).alias("more")).distinct()
    placed = inside.withColumn("k", F.row_number().over(Window.partitionBy("begin").orderBy("s")) - 1)
    skipped = F.min(F.when(F.col("s") != F.col("begin") + F.col("k"), F.col("begin") + F.col("k")))
    gap = placed.agg(F.coalesce(skipped, F.when(F.max("more"), F.max("s") + 1)).alias("x"))
    jump = missing.crossJoin(F.broadcast(first)).select((F.col("low") + F.col("m") * step).alias("x"))
    end = bad.unionAll(gap).unionAll(jump).agg(F.min("x").alias("_end"))
    return log.crossJoin(F.broadcast(end)).where(F.col("_end").isNull() | (F.col(seq) < F.col("_end"))).drop("_end")  # one row


def start_of(log: DataFrame, seq: str, start: str | int) -> int:
    """The cursor of a new subscription, the number before its first record: 'oldest', 'latest', or from a number on."""
    if start == "oldest":
        return (log.agg(F.min(seq)).first()[0] or 0) - 1
    if start == "latest":
        return log.agg(F.max(seq)).first()[0] or 0
    return int(start) - 1


def page(log: DataFrame, seq: str, cursor: int, size: int) -> DataFrame:
    """The next records behind a cursor."""
    return log.where(F.col(seq) > cursor).orderBy(seq).limit(size)


def acknowledged(acks: DataFrame, by: str, seq: str) -> DataFrame:
    """Each subscriber's cursor: the greatest number it has acknowledged."""
    return acks.groupBy(by).agg(F.max(seq).alias(seq))


def pruned(log: DataFrame, acks: DataFrame, by: str, seq: str) -> DataFrame:
    """What is left when records that every subscriber has acknowledged go."""
    least = acknowledged(acks, by, seq).agg(F.min(seq).alias("_least"))
    return log.crossJoin(F.broadcast(least)).where(F.col("_least").isNull() | (F.col(seq) > F.col("_least"))).drop("_least")  # one row
