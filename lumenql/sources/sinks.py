"""Sinks: tables from queries, compacted copies, dumps, single files, compression."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a file in a compacted copy.
FILE_BYTES = 256 << 20


def create_as(rows: DataFrame, path: str, partition_by: list[str] = ()) -> DataFrame:
    """CREATE TABLE ... AS SELECT: written as Parquet, and read again."""
    rows.write.partitionBy(*partition_by).parquet(path)
    return rows.sparkSession.read.parquet(path)


def compact(rows: DataFrame, path: str) -> DataFrame:
    """A copy in few large files: tasks are merged to FILE_BYTES each by adaptive execution, whatever the number of input files."""
    hint = rows.hint("rebalance")
    hint.write.option("maxRecordsPerFile", 50_000_000).parquet(path)
    return rows.sparkSession.read.parquet(path)


def sorted_by(rows: DataFrame, key: str, path: str) -> None:
    """Files that each hold a range of the key, in its order."""
    rows.repartitionByRange(F.col(key)).sortWithinPartitions(key).write.parquet(path)


def dump(rows: DataFrame, name: str, path: str) -> None:
    """INSERT statements as text, one a row."""
    values = []
    for f in rows.schema:
        x = F.col(f.name)
        kind = f.dataType.simpleString()
        if kind == "binary":
            text = F.concat(F.lit("X'"), F.hex(x), F.lit("'"))
        elif kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
            text = x.cast("string")
        else:
            text = F.concat(F.lit("'"), F.replace(x.cast("string"), F.lit("'"), F.lit("''")), F.lit("'"))
        values.append(F.coalesce(text, F.lit("NULL")))
    line = F.concat(F.lit(f"INSERT INTO {name} VALUES("), F.concat_ws(",", *values), F.lit(");"))
    rows.select(line.alias("value")).write.text(path)


def write_files(rows: DataFrame, folder: str) -> None:
    """writefile for each row (name, data): one file of these bytes, through the file system that holds the folder.

    Every task writes its own rows; a task that is tried again writes the same files again.
    """
    folder = re.sub("^file:/+", "/", folder.rstrip("/"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        for p in parts:
            for name, data in zip(p["name"], p["data"]):
                to = f"{base}/{name}"
                system.create_dir(to.rpartition("/")[0], recursive=True)
                with system.open_output_stream(to) as out:
                    out.write(data or b"")
            yield pd.DataFrame({"n": [len(p)]})

    rows.select("name", "data").mapInPandas(run, "n long").agg(F.sum("n")).first()


def zipped(entries: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in entries.items():
            z.writestr(name, data)
    return out.getvalue()


def _compress(b: pa.Array) -> pa.Array:
    out = []
    for x in b:
        x = x.as_py()
        small = None if x is None else zlib.compress(x)
        out.append(x if x is None or len(small) >= len(x) else small)
    return pa.array(out, pa.binary())


def _uncompress(b: pa.Array) -> pa.Array:
    out = []
    for x in b:
        x = x.as_py()
        try:
            out.append(None if x is None else zlib.decompress(x))
        except zlib.error:
            out.append(x)
    return pa.array(out, pa.binary())


def compress(b: Column) -> Column:
    """Archive form of a blob: deflated, unless that isn't smaller."""
    return F.arrow_udf(_compress, T.BinaryType())(b)


def uncompress(b: Column) -> Column:
    """Blobs that aren't compressed come back as they are."""
    return F.arrow_udf(_uncompress, T.BinaryType())(b)
