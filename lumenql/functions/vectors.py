"""Distances of array<float> vectors and an inverted-file index, in DataFrame expressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def quantize8(v: Column) -> Column:
    """struct<q array<int>, alpha double, shift double>: x is about alpha * q + shift, q from 0 to 255."""
    lo, hi = F.array_min(v).cast("double"), F.array_max(v).cast("double")
    alpha = (hi - lo) / 255.0
    q = F.transform(v, lambda x: F.when(alpha == 0, 0).otherwise(F.floor((x.cast("double") - lo) / alpha + 0.5)).cast("int"))
    return F.struct(q.alias("q"), alpha.alias("alpha"), lo.alias("shift"))


def dequantize8(s: Column) -> Column:
    return F.transform(s["q"], lambda x: x * s["alpha"] + s["shift"])


def bits1(v: Column) -> Column:
    """One bit for each element, set where it is positive, in an array of longs of 63 bits each."""
    n = F.size(v)
    blocks = F.sequence(F.lit(0), F.floor((n - 1) / 63).cast("int"))
    one = lambda k: F.aggregate(
        F.slice(v, k * 63 + 1, F.lit(63)), F.lit(0).cast("bigint"), lambda s, x: s * 2 + F.when(x > 0, 1).otherwise(0)
    )
    return F.transform(blocks, one)


def hamming1(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def nearest(table: DataFrame, id_col: str, vec_col: str, query: list[float], k: int, distance=cosine_distance) -> DataFrame:
    """The k nearest rows, ties by id: a distance for each row and a top-k, no shuffle of the table."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return table.select(id_col, distance(F.col(vec_col), q).alias("distance")).orderBy("distance", id_col).limit(k)


def ivf_search(table: DataFrame, queries: DataFrame, id_col: str, vec_col: str, k: int = 10, lists: int = 16, probes: int = 14) -> DataFrame:
    """Approximate neighbours: (query, id, distance, rank).

    Centres are ``lists`` vectors drawn by a hash; each row belongs to its nearest centre, each query looks into
    its ``probes`` nearest lists. Rows are dealt to tasks by their id, each once, and queries come to every task, which keeps the k best of each; distances are
    those of ``l2_distance`` to the last bit. Vectors of another length, without an element or not finite, of which there are few, meet all others by a join.
    """
    spark = table.sparkSession
    centres = table.orderBy(F.xxhash64(id_col), id_col).limit(lists).select(F.col(id_col).alias("c"), F.col(vec_col).alias("cv"))
    each = F.broadcast(centres.agg(F.collect_list(F.struct("c", "cv")).alias("cs")))  # `lists` vectors
    far = lambda v: F.array_sort(F.transform("cs", lambda x: F.struct(l2_distance(v, x["cv"]).alias("d"), x["c"].alias("c"))))
    size = (centres.agg(F.max(F.size("cv"))).first()[0] or 0) if table.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long") else 0
    even = lambda v, i: i.isNotNull() & F.coalesce((F.size(v) == size) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < 1e150)), F.lit(False)) if size > 0 else F.lit(False)
    v, i = F.col(vec_col), F.col(id_col)
    rows = table.join(each, F.lit(True)).select(i.alias("id"), v.alias("v"), F.get(far(v), F.lit(0))["c"].alias("list"), even(v, i).alias("even"))
    asks = queries.join(each, F.lit(True)).select(i.alias("query"), v.alias("qv"), F.transform(F.slice(far(v), 1, probes), lambda x: x["c"]).alias("lists"), even(v, i).alias("even"))

    def paired(asks: DataFrame, rows: DataFrame) -> DataFrame:
        return asks.select("query", "qv", F.explode("lists").alias("list")).join(rows, "list").select("query", "id", l2_distance(F.col("v"), F.col("qv")).alias("distance"))

    found = paired(asks.where("not even"), rows).unionAll(paired(asks.where("even"), rows.where("not even")))
    if size > 0:
        # as many tasks whatever the bytes, and blocks of queries that a task can hold
        parts = 2 * spark.sparkContext.defaultParallelism
        blocks = -(-queries.count() // _HELD) or 1
        n = parts * blocks
        whole = lambda x: F.col(x).cast("bigint")
        here = rows.where("even").select(F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part"), F.lit(True).alias("passes"), whole("id").alias("id"), F.array(whole("list")).alias("lists"), "v")
        here = here.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))) if blocks > 1 else here.withColumn("block", F.lit(0))
        there = asks.where("even").select(F.explode(F.sequence(*[F.lit(x).cast("bigint") for x in (0, parts - 1)])).alias("part"), F.lit(False).alias("passes"), whole("query").alias("id"), F.transform("lists", lambda x: x.cast("bigint")).alias("lists"), F.col("qv").alias("v"))
        there = there.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
        met = here.unionByName(there).repartitionById(n, (F.col("part") * blocks + F.col("block")).cast("int")).sortWithinPartitions("passes", "lists").select("passes", "id", "lists", "v")
        kind = table.schema[id_col].dataType.simpleString()
        best = met.mapInArrow(lambda batches: _nearest(batches, k, size), "query bigint, id bigint, distance double")
        found = found.unionAll(best.select(F.col("query").cast(kind), F.col("id").cast(kind), "distance"))
    best = Window.partitionBy("query").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


#: So many queries a task holds, and so many of them and of rows it compares at once.
_HELD, _ASKS, _ROWS = 20_000, 256, 4096


def _nearest(batches: Iterator[pa.RecordBatch], k: int, size: int) -> Iterator[pa.RecordBatch]:
    """The k best of a task's rows for each of its queries, which come first; rows come list by list."""
    parts: list[tuple] = []
    held = None
    for batch in batches:
        ids, vectors = batch.column("id").to_numpy(), batch.column("v").flatten().to_numpy().astype(np.float64).reshape(-1, size)
        first = int(np.count_nonzero(~batch.column("passes").to_numpy(zero_copy_only=False)))
        lists = batch.column("lists")
        if first:
            parts.append((ids[:first], vectors[:first], lists.slice(0, first).to_pylist()))
        if first == len(ids) or not parts:
            continue
        held = held or _Held(parts, k)
        of = lists.slice(first).flatten().to_numpy()
        ends = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
        for s, e in zip(ends, ends[1:]):
            for at in range(s, e, _ROWS):
                piece = slice(first + at, first + min(e, at + _ROWS))
                held.see(int(of[s]), ids[piece], vectors[piece])
    if held is not None:
        for s in range(0, len(held.ids), 4096):
            known = held.best_id[s : s + 4096][ok := held.best[s : s + 4096] >= 0]
            yield pa.record_batch({"query": np.repeat(held.ids[s : s + 4096], ok.sum(axis=1)), "id": known, "distance": held.best[s : s + 4096][ok]})


class _Held:
    """Queries with the best rows that they have seen; -1 in place of a distance where there is none yet."""

    def __init__(self, parts: list[tuple], k: int) -> None:
        self.ids, self.v, self.k = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), k
        self.of: dict[int, list[int]] = {}
        for n, probed in enumerate(x for p in parts for x in p[2]):
            for c in probed:
                self.of.setdefault(c, []).append(n)
        self.best, self.best_id = np.full((len(self.ids), k), -1.0), np.zeros((len(self.ids), k), np.int64)
        self.norm = (self.v**2).sum(axis=1)

    def see(self, of: int, ids: np.ndarray, v: np.ndarray) -> None:
        norm = (v**2).sum(axis=1)
        asks = np.asarray(self.of.get(of, []), np.int64)
        for s in range(0, len(asks), _ASKS):
            q = asks[s : s + _ASKS]
            about = self.norm[q, None] + norm - 2 * (self.v[q] @ v.T)  # the square, but for rounding
            slack = 1e-11 * (self.norm[q] + norm.max())
            last = self.best[q, -1]
            limit = np.where(last < 0, np.inf, last**2)
            if len(ids) > self.k and (new := np.flatnonzero(last < 0)).size:
                limit[new] = np.partition(about[new], self.k - 1, axis=1)[:, self.k - 1] + slack[new]
            i, j = np.nonzero(about <= (limit + slack)[:, None])
            if not len(i):
                continue
            square = np.zeros(len(i))
            for x, y in zip(v.T, self.v[q].T):  # added in the order of l2_distance
                square += (x[j] - y[i]) ** 2
            self.keep(q, i, np.sqrt(square), ids[j])

    def keep(self, q: np.ndarray, i: np.ndarray, far: np.ndarray, ids: np.ndarray) -> None:
        """Merges rows (i: place of the query in q) with those that are held."""
        old = self.best[q] >= 0
        i = np.concatenate([i, np.nonzero(old)[0]])
        far, ids = np.concatenate([far, self.best[q][old]]), np.concatenate([ids, self.best_id[q][old]])
        order = np.lexsort((ids, far, i))
        i, far, ids = i[order], far[order], ids[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i, "left")
        top = rank < self.k
        self.best[q[i[top]], rank[top]], self.best_id[q[i[top]], rank[top]] = far[top], ids[top]


def vector(s: Column) -> Column:
    """A vector from text like [1, 2.5]; null for what is none."""
    return F.when(s.rlike(r"^\s*\[[-+0-9.,eE\s]*\]\s*$"), F.from_json(s, "array<float>"))


def vector_text(v: Column) -> Column:
    """Text of a vector: numbers in their shortest form, whole ones without a point."""
    one = lambda x: F.regexp_replace(x.cast("string"), r"\.0$", "")
    return F.concat(F.lit("["), F.array_join(F.transform(v, one), ","), F.lit("]"))
