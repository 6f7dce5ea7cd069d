"""Sources: CSV, separated values, series, arrays as tables, shards, archives, catalogue, ordered scans."""

from __future__ import annotations

import io
import os
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def csv(spark: SparkSession, path: str | None = None, data: list[str] | None = None, header: bool = False, schema: str | None = None, sep: str = ",") -> DataFrame:
    """A CSV file, or CSV text given as lines; column types come from the schema, names from the header or c0, c1, ..."""
    reader = spark.read.option("header", header).option("sep", sep)
    if schema:
        reader = reader.schema(schema)
    got = reader.csv(spark.sparkContext.parallelize(data)) if data is not None else reader.csv(path)
    if not header and not schema:
        got = got.toDF(*[f"c{i}" for i in range(len(got.columns))])
    return got


def generate_series(spark: SparkSession, start: int, stop: int, step: int = 1) -> DataFrame:
    """value from start to stop, both included; a negative step goes down."""
    if step == 0:
        step = 1
    return spark.range(start, stop + (1 if step > 0 else -1), step).select(F.col("id").alias("value"))


def wholenumber(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(1, n + 1).select(F.col("id").alias("value"))


def carray(spark: SparkSession, values: list) -> DataFrame:
    """A bound array as a table."""
    return spark.createDataFrame([(values,)], "v array<bigint>").select(F.explode("v").alias("value"))


def shards(spark: SparkSession, parts: dict[str, tuple[int, int]], key: str, lo: int | None = None, hi: int | None = None) -> DataFrame:
    """One table over many Parquet paths, each with the range of ``key`` it holds; paths outside [lo, hi] aren't read."""
    paths = [p for p, (a, b) in parts.items() if (hi is None or a <= hi) and (lo is None or b >= lo)]
    if not paths:
        return spark.read.parquet(*list(parts)[:1]).limit(0)
    got = spark.read.parquet(*paths)
    if lo is not None:
        got = got.where(F.col(key) >= lo)
    return got.where(F.col(key) <= hi) if hi is not None else got


def zip_entries(spark: SparkSession, path: str) -> DataFrame:
    """(archive, name, data) of every file in zip archives."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for archive, content in zip(p["path"], p["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for i in z.infolist():
                        if not i.is_dir():
                            yield pd.DataFrame({"archive": [archive], "name": [i.filename], "data": [z.read(i)]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "archive string, name string, data binary")


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, size, modified) below a folder; empty files, of which Spark plans no task, are left out."""
    got = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return got.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def catalog(spark: SparkSession) -> DataFrame:
    """(name, column, type, position) of the session's tables and views."""
    rows = [(t.name, c.name, c.dataType, i) for t in spark.catalog.listTables() for i, c in enumerate(spark.catalog.listColumns(t.name))]
    return spark.createDataFrame(rows, "name string, column string, type string, position int")


def range_scan(table: DataFrame, key: str, lo=None, hi=None, most: int | None = None) -> DataFrame:
    """Ordered key-value scan from lo to hi, both included."""
    if lo is not None:
        table = table.where(F.col(key) >= lo)
    if hi is not None:
        table = table.where(F.col(key) <= hi)
    table = table.orderBy(key)
    return table.limit(most) if most is not None else table


def values_under(table: DataFrame, key: str, value: str) -> DataFrame:
    """Several values under one key, in order."""
    return table.groupBy(key).agg(F.array_sort(F.collect_list(value)).alias("values"))


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, data): readfile for every file below a folder."""
    got = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return got.select("path", F.col("content").alias("data"))


class _Range(InputPartition):
    def __init__(self, first: int, last: int) -> None:
        self.first, self.last = first, last


class _SquaresReader(DataSourceReader):
    def __init__(self, first: int, last: int, parts: int) -> None:
        self.first, self.last, self.parts = first, last, parts

    def partitions(self) -> list[InputPartition]:
        n = self.last - self.first + 1
        cuts = [self.first + n * k // self.parts for k in range(self.parts + 1)]
        return [_Range(a, b - 1) for a, b in zip(cuts, cuts[1:])]

    def read(self, partition: _Range) -> Iterator[tuple]:
        return ((x, x * x) for x in range(partition.first, partition.last + 1))


class Squares(DataSource):
    """A table of a user's own: whole numbers and their squares, computed in partitions."""

    @classmethod
    def name(cls) -> str:
        return "lumenql_squares"

    def schema(self) -> str:
        return "value bigint, square bigint"

    def reader(self, schema) -> DataSourceReader:
        return _SquaresReader(int(self.options["first"]), int(self.options["last"]), int(self.options.get("parts", 1)))


class Attached:
    """ATTACH: the Parquet tables of a folder under an alias, alias.table in SQL text."""

    def __init__(self, spark: SparkSession, alias: str, folder: str) -> None:
        self.spark, self.alias, self.folder = spark, alias, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self.folder, f"{name}.parquet"))


def run_attached(spark: SparkSession, sql: str, *attached: Attached) -> DataFrame:
    """SQL over tables of several attached folders; names are taken where a table may stand."""
    by, frames = {a.alias: a for a in attached}, {}

    def one(m: re.Match) -> str:
        name = f"{m[2]}__{m[3]}"
        frames[name] = by[m[2]].table(m[3])
        return f"{m[1]}{{{name}}}"

    aliases = "|".join(map(re.escape, by))
    text = re.sub(rf"(\b(?:FROM|JOIN)\s+|,\s*)({aliases})\.(\w+)\b", one, sql, flags=re.I) if by else sql
    return spark.sql(text, **frames)


def explained(df: DataFrame, mode: str = "formatted") -> DataFrame:
    """(n, line) of a DataFrame's plan."""
    spark = df.sparkSession
    text = df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))
    return spark.createDataFrame(list(enumerate(text.splitlines())), "n int, line string")
