"""Aggregates and subqueries the way the reference dialect has them."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import jsontext
from .recursive import cut


def total(x: Column) -> Column:
    """A sum that is always real, 0.0 for no rows."""
    return F.coalesce(F.sum(x.cast("double")), F.lit(0.0))


def bare_max(x: Column, *tie: Column, of: Column) -> Column:
    """The value of a bare column in the row that holds the maximum, which may be text, too (of equal ones, the least by ``tie``, numbers)."""
    return F.max_by(of, F.struct(x, *[-t for t in tie])) if tie else F.max_by(of, x)


def bare_min(x: Column, *tie: Column, of: Column) -> Column:
    return F.min_by(of, F.struct(x, *tie))


def concat_ordered(x: Column, *order: Column, sep: str = ",") -> Column:
    """group_concat(x ORDER BY ...): nulls are left out; null for none."""
    rows = F.array_sort(F.collect_list(F.when(x.isNotNull(), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], x.cast("string").alias("x")))))
    return F.when(F.count(x) > 0, F.array_join(F.transform(rows, lambda r: r["x"]), sep))


def concat_row_separator(x: Column, sep: Column, *order: Column) -> Column:
    """group_concat(x, sep) with a separator for each row, before every value but the first."""
    rows = F.array_sort(F.collect_list(F.when(x.isNotNull(), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], x.cast("string").alias("x"), sep.alias("s")))))
    joined = F.aggregate(rows, F.lit(None).cast("string"), lambda s, r: F.when(s.isNull(), r["x"]).otherwise(F.concat(s, F.coalesce(r["s"], F.lit("")), r["x"])))
    return joined


def concat_distinct_ordered(df: DataFrame, keys: list[str], x: str, order: list[str], out: str, sep: str = ",") -> DataFrame:
    """group_concat(DISTINCT x ORDER BY other columns): each x once, at its first place."""
    first = df.where(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.min(F.struct(*order)).alias("_o"))
    return first.groupBy(*keys).agg(concat_ordered(F.col(x), F.col("_o"), sep=sep).alias(out))


def percentile(y: Column, p: float) -> Column:
    """p from 0 to 100, linear between the neighbours."""
    if not 0 <= p <= 100:
        raise ValueError("percentile: P must be from 0 to 100")
    return F.percentile(y, F.lit(p / 100))


def percentiles(df: DataFrame, keys: list[str], x: str, of: dict[str, float]) -> DataFrame:
    """(keys, names): for each name the percentile of x, from 0 to 100, linear between the neighbours; null for groups without a value.

    Values are counted, then ranged over the tasks by key and value, so that no task holds a whole group: a rank is the count of a group's rows in
    the ranges before, known from one number for each range, and a running count within the range.
    """
    if bad := [p for p in of.values() if not 0 <= p <= 100]:
        raise ValueError(f"percentile: P must be from 0 to 100, not {bad[0]}")
    counts = df.where(F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double"))).groupBy(*keys, F.col(x).cast("double").alias("_x")).agg(F.count("*").alias("_n"))
    ranged = cut(counts.repartitionByRange(*keys, "_x").withColumn("_part", F.spark_partition_id()))
    per = ranged.groupBy(*keys, "_part").agg(F.sum("_n").alias("_in"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    named = [f"_k{i}" for i in range(len(keys))]
    per = per.select(*[F.col(k).alias(a) for k, a in zip(keys, named)], F.col("_part").alias("_p"), F.coalesce(F.sum("_in").over(before), F.lit(0)).alias("_before"), F.sum("_in").over(Window.partitionBy(*keys)).alias("_all"))
    same = [F.col(k).eqNullSafe(F.col(a)) for k, a in zip(keys, named)]
    rows = ranged.join(per, [*same, F.col("_part") == F.col("_p")]).drop(*named, "_p")
    running = Window.partitionBy(*keys, "_part").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_to", F.col("_before") + F.sum("_n").over(running)).withColumn("_from", F.col("_to") - F.col("_n"))
    aggs = []
    for name, p in of.items():
        at = F.lit(p / 100) * (F.col("_all") - 1)
        low, high = F.floor(at), F.ceil(at)
        holds = lambda k: (k >= F.col("_from")) & (k < F.col("_to"))
        aggs += [F.max(F.when(holds(low), F.col("_x"))).alias(f"_l_{name}"), F.max(F.when(holds(high), F.col("_x"))).alias(f"_h_{name}"), F.max(at - low).alias(f"_s_{name}")]
    got = rows.groupBy(*keys).agg(*aggs)
    value = lambda n: F.col(f"_l_{n}") + (F.col(f"_h_{n}") - F.col(f"_l_{n}")) * F.col(f"_s_{n}")
    every = df.select(*[F.col(k).alias(a) for k, a in zip(keys, named)]).distinct()
    return every.join(got, same, "left").select(*[F.col(a).alias(k) for k, a in zip(keys, named)], *[value(n).alias(n) for n in of])


def json_group_array(x: Column, *order: Column) -> Column:
    """Nulls stay, as null; no rows give []."""
    rows = F.array_sort(F.collect_list(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], x.alias("x"))))
    return F.to_json(F.transform(rows, lambda r: r["x"]), {"ignoreNullFields": "false"})


def json_group_object(k: Column, v: Column) -> Column:
    """Pairs in the order of key and value; a key that comes several times stays so, as text can hold it."""
    pairs = F.array_sort(F.collect_list(F.struct(k.cast("string").alias("k"), v.alias("v"))))
    text = F.transform(pairs, lambda p: F.concat(jsontext.quote(p["k"]), F.lit(":"), jsontext.quote(p["v"])))
    return F.concat(F.lit("{"), F.array_join(text, ","), F.lit("}"))


def geometric_mean(kind: str = "double"):
    """A window function of a user's own, over arrays of the frames' values (``collect_list(x).over(w)``): one call for a batch of rows, not one for each row."""

    @F.arrow_udf(kind)
    def run(frames: pa.Array) -> pa.Array:
        x = frames.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        ok = x > 0
        # of each frame, from the array's own ends: places in x behind which it ends
        ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(frames), 0).to_numpy())])
        n = np.concatenate([[0], np.cumsum(ok)])
        n = n[ends[1:]] - n[ends[:-1]]
        logs, some = np.log(np.where(ok, x, 1.0)), np.diff(ends) > 0
        total = np.zeros(len(frames))
        if some.any():  # frames side by side: a sum ends where the next frame that has values begins
            total[some] = np.add.reduceat(logs, ends[:-1][some])
        with np.errstate(all="ignore"):
            return pa.array(np.exp(total / n), mask=n == 0)

    return run


def outer_concat(outer: DataFrame, inner: DataFrame, value: str, sep: str, order: list[Column]) -> DataFrame:
    """SELECT (SELECT string_agg(value, sep ORDER BY ...) FROM inner) FROM outer, where the value is the outer row's: it stands once for each inner row, with
    the inner rows' separators between. The separators are joined once, then each row only repeats its value."""
    seps = inner.agg(F.transform(F.array_sort(F.collect_list(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.col(sep).alias("s")))), lambda r: r["s"]).alias("_seps"))
    tail = F.aggregate(F.slice(F.col("_seps"), 2, F.greatest(F.size("_seps") - 1, F.lit(0))), F.col(value), lambda s, x: F.concat(s, x, F.col(value)))
    return outer.join(F.broadcast(seps), F.lit(True), "left").withColumn("joined", F.when(F.size("_seps") > 0, tail)).drop("_seps")  # one row


def first_scalar(df: DataFrame, value: str, order: list[str]) -> Column:
    """A scalar subquery: the first row's value, null for no rows."""
    return df.orderBy(*order).limit(1).select(value).scalar()


def nearest_before(left: DataFrame, right: DataFrame, by: list[str], at: str, value: str, out: str) -> DataFrame:
    """As-of lookup: for each left row the right row's value of the greatest ``at`` not after its own.

    A union and one window by key, so a key's rows meet once and no pair is formed.
    """
    l = left.withColumn("_right", F.lit(False)).withColumn("_v", F.lit(None).cast(right.schema[value].dataType))
    r = right.select(*by, at, F.col(value).alias("_v")).withColumn("_right", F.lit(True))
    both = l.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(F.col(at), F.col("_right").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(out, F.last("_v", ignorenulls=True).over(w)).where(~F.col("_right")).drop("_right", "_v")


def range_join(points: DataFrame, ranges: DataFrame, x: str, lo: str, hi: str, width: float) -> DataFrame:
    """points joined with the ranges [lo, hi] that hold x: an equi-join on buckets of ``width``, then the exact condition."""
    p = points.withColumn("_b", F.floor(F.col(x) / width))
    r = ranges.withColumn("_b", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))
    return p.join(r, "_b").where((F.col(x) >= F.col(lo)) & (F.col(x) <= F.col(hi))).drop("_b")


def log_sum(kind: str = "double"):
    """A step of a user's aggregate over Arrow batches: the sum of the logarithms."""

    @F.pandas_udf(kind)
    def run(x: pd.Series) -> float:
        return float(np.log(x[x > 0]).sum())

    return run


def positive_count(kind: str = "bigint"):
    @F.pandas_udf(kind)
    def run(x: pd.Series) -> int:
        return int((x > 0).sum())

    return run


def evaluate(spark, sql: str, sep: str = " ", **frames: DataFrame) -> DataFrame:
    """eval(sql, sep): one row, ``result``, of all values of the SQL's rows in their order, joined. It is one value, so its rows come together."""
    rows = spark.sql(sql, **frames)
    text = F.concat_ws(sep, *[F.col(f"`{c}`").cast("string") for c in rows.columns])
    numbered = rows.select(F.monotonically_increasing_id().alias("_i"), text.alias("_t"))
    got = F.transform(F.array_sort(F.collect_list(F.struct("_i", "_t"))), lambda r: r["_t"])
    return numbered.agg(F.array_join(got, sep).alias("result"))
