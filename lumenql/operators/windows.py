"""Window frames that Spark has no syntax for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def groups_frame(df: DataFrame, partition: list[str], order: str, lo: int, hi: int, value: Column, out: str) -> DataFrame:
    """GROUPS BETWEEN lo AND hi: peers are numbered by dense_rank, and a RANGE over that number counts peer groups."""
    if lo > hi:
        raise ValueError("a frame may not end before it begins")
    ranked = df.withColumn("_g", F.dense_rank().over(Window.partitionBy(*partition).orderBy(order)))
    return ranked.withColumn(out, value.over(Window.partitionBy(*partition).orderBy("_g").rangeBetween(lo, hi))).drop("_g")


def sum_excluding(partition: list[str], order: str, x: str, what: str) -> Column:
    """sum(x) over the default frame with EXCLUDE what: no others, current row, group, ties."""
    w = Window.partitionBy(*partition).orderBy(order)
    whole = F.coalesce(F.sum(x).over(w), F.lit(0))
    peers = F.coalesce(F.sum(x).over(Window.partitionBy(*partition, order)), F.lit(0))
    n_whole, n_peers = F.count(x).over(w), F.count(x).over(Window.partitionBy(*partition, order))
    own, n_own = F.coalesce(F.col(x), F.lit(0)), F.col(x).isNotNull().cast("int")
    value, n = {
        "no others": (whole, n_whole),
        "current row": (whole - own, n_whole - n_own),
        "group": (whole - peers, n_whole - n_peers),
        "ties": (whole - peers + own, n_whole - n_peers + n_own),
    }[what]
    return F.when(n > 0, value)


def filtered(agg, x: Column, condition: Column, window) -> Column:
    """agg(x) FILTER (WHERE condition) OVER window."""
    return agg(F.when(condition, x)).over(window)


def rows_excluding(df: DataFrame, partition: list[str], order: list[str], tie: list[str], lo: int, hi: int, x: str, what: str, fold, out: str) -> DataFrame:
    """An aggregate over ROWS BETWEEN lo AND hi (negative for preceding) with EXCLUDE what: no others, current row, group, ties.

    Rows of equal ``order`` are peers, which ``tie`` puts in a row. ``fold`` makes the value of the array of what is left; a frame's rows, a bounded
    number, come together in an array beside each row.
    """
    if lo > hi:
        raise ValueError("a frame may not end before it begins")
    whole = Window.partitionBy(*partition).orderBy(*order, *tie)
    numbered = df.withColumn("_n", F.row_number().over(whole)).withColumn("_g", F.struct(*order))
    frame = F.collect_list(F.struct("_n", "_g", F.col(x).alias("x"))).over(whole.rowsBetween(lo, hi))
    own, peer = (lambda r: r["_n"] == F.col("_n")), (lambda r: r["_g"] == F.col("_g"))
    keep = {
        "no others": lambda r: F.lit(True),
        "current row": lambda r: ~own(r),
        "group": lambda r: ~peer(r),
        "ties": lambda r: own(r) | ~peer(r),
    }[what]
    left = F.transform(F.filter(F.col("_f"), keep), lambda r: r["x"])
    return numbered.withColumn("_f", frame).withColumn(out, fold(left)).drop("_n", "_g", "_f")
