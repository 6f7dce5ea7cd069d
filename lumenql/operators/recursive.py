"""Recursive queries as fixpoints of DataFrames."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for shared state. One of the machine's own is made only in local mode, as in tests."""
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if got:
        return got
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir names no shared folder")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lumenql-"))
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def fixpoint(seed: DataFrame, steps: list[Callable[[DataFrame], DataFrame]], distinct: bool = True) -> DataFrame:
    """WITH RECURSIVE: the seed and all that the steps (recursive terms, several allowed) derive.

    ``distinct`` is UNION: only rows not met yet go on, which ends on cycles; else UNION ALL, which ends when a step gives no row. Each round joins the
    frontier only and writes no more than its new rows, as a checkpoint.
    """
    rounds = [cut(seed.distinct() if distinct else seed)]
    while not rounds[-1].isEmpty():
        new = reduce(DataFrame.unionAll, [s(rounds[-1]) for s in steps])
        if distinct:
            new = new.distinct().subtract(reduce(DataFrame.unionAll, rounds))
        rounds.append(cut(new))
    return reduce(DataFrame.unionAll, rounds)
