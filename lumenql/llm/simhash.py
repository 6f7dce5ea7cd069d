"""SimHash fingerprints and exact near pairs through a sharded vantage-point tree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import claim, cut, null_safe_key, release, small_batches
from .components import connected_components

SEED = 42
SAMPLE_PER_SHARD, SAMPLE = 48, 1_000_000
LEAF = 192


def simhash64(text: str | bytes | None, shingle: int = 3) -> int:
    """Fingerprint of one text, or of its UTF-8; 0 where it has no word."""
    if not text:
        return 0
    words = (text if isinstance(text, bytes) else text.encode("utf-8")).lower().split()  # of bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter(
        (digest(b" ".join(t), SEED) for t in zip(*(words[i:] for i in range(shingle)))),
        dtype=np.uint64,
        count=len(words) - shingle + 1,
    )
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 1 << 16):  # very long texts in slices
        bits = np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text", extra: str | None = None) -> DataFrame:
    """(doc_id, fp): fp is the 64-bit fingerprint as a signed long; ``extra`` is a further long column to keep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim({})
        for b in batches:
            fps = [simhash64(t.as_py(), shingle) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, dtype=np.uint64).view(np.int64)), *b.columns[2:]], ["doc_id", "fp", *more])
        release()

    small_batches(docs.sparkSession)
    more = [extra] if extra else []
    given = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col), *more)
    return given.mapInArrow(run, ", ".join(["doc_id long", "fp long", *(f"{c} long" for c in more)]))


def build_tree(sample: np.ndarray, weight: float, per_shard: int, radius: int) -> list[tuple[int, int, int, int]]:
    """Nodes (pivot, mu, left, right) of a vantage-point tree whose leaves hold about ``per_shard`` fingerprints at most, of which a sample point stands
    for ``weight``.

    A child below zero is leaf ``-child - 1``. Each split puts the points within ``mu`` bits of the pivot left, and those beyond, with
    the overlap of ``radius`` bits that ``route`` copies, right. The pivot is the best of a few sample points by the sizes that result, so a dense ball of
    near copies is split from inside; what none splits well stays one leaf.
    """
    nodes: list[tuple[int, int, int, int]] = []
    rng = np.random.default_rng(7)
    leaves = 0
    # (points, parent, side); a stack, as a skewed tree may be deep
    todo: list[tuple[np.ndarray, int, int]] = [(np.unique(sample), -1, 0)]
    while todo:
        pts, parent, side = todo.pop()
        best = None
        if len(pts) * weight > per_shard and len(pts) > 8:
            for p in rng.choice(pts, size=min(8, len(pts)), replace=False):
                below = np.cumsum(np.bincount(np.bitwise_count(pts ^ p), minlength=65))
                middle = int(np.argmin(np.abs(below - len(pts) / 2)))
                for mu in range(max(0, middle - 1), middle + 3):
                    left, right = int(below[mu]), len(pts) - int(below[mu - radius] if mu >= radius else 0)
                    if max(left, right) <= 0.95 * len(pts) and (best is None or left**2 + right**2 < best[0]):
                        best = (left**2 + right**2, p, mu)
        if best is None:
            leaves += 1
            at = -leaves
        else:
            _, p, mu = best
            at = len(nodes)
            nodes.append((int(p), mu, 0, 0))
            d = np.bitwise_count(pts ^ p).astype(np.int64)
            todo += [(pts[d > mu - radius], at, 3), (pts[d <= mu], at, 2)]
        if parent >= 0:
            node = list(nodes[parent])
            node[side] = at
            nodes[parent] = tuple(node)
    return nodes


def route(fps: np.ndarray, nodes: list[tuple[int, int, int, int]], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(index, leaf) of every shard a fingerprint belongs to or whose boundary it overlaps.

    By the triangle bound, if x lies within ``radius`` of y, x is left of a split and y right, then
    x is more than ``mu - radius`` from the pivot; copying such x to the right keeps every pair
    together in one shard at least.
    """
    if not nodes:
        return np.arange(len(fps)), np.zeros(len(fps), dtype=np.int64)
    idx, leaf = [], []
    todo = [(0, np.arange(len(fps)))]
    while todo:
        at, who = todo.pop()
        if len(who) == 0:
            continue
        if at < 0:
            idx.append(who)
            leaf.append(np.full(len(who), -at - 1))
            continue
        p, mu, left, right = nodes[at]
        d = np.bitwise_count(fps[who] ^ np.uint64(p)).astype(np.int64)
        todo.append((left, who[d <= mu]))
        todo.append((right, who[d > mu - radius]))
    return np.concatenate(idx or [np.arange(0)]), np.concatenate(leaf or [np.arange(0)])


def near_forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Positions (i, root) that span the components of "at most ``radius`` bits apart" among distinct fps.

    A vantage-point recursion over the set; small sets, and sets that no pivot splits, are compared
    in blocks.
    """
    parent = np.arange(len(fps))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return int(x)

    def compare(who: np.ndarray) -> None:
        for i in range(0, len(who), 512):
            a = who[i : i + 512]
            for j in range(i, len(who), 4096):
                b = who[j : j + 4096]
                x, y = np.nonzero(np.bitwise_count(fps[a][:, None] ^ fps[b][None, :]) <= radius)
                for u, v in zip(a[x].tolist(), b[y].tolist()):
                    if u < v:
                        ru, rv = find(u), find(v)
                        if ru != rv:
                            parent[max(ru, rv)] = min(ru, rv)

    rng = np.random.default_rng(11)
    todo = [np.arange(len(fps))]
    while todo:
        who = todo.pop()
        if len(who) <= LEAF:
            compare(who)
            continue
        best = None
        for p in rng.choice(who, size=4, replace=False):
            d = np.bitwise_count(fps[who] ^ fps[p]).astype(np.int64)
            mu = int(np.partition(d, len(d) // 2)[len(d) // 2])
            for m in (mu, mu - 1):
                left, right = who[d <= m], who[d > m - radius]
                if len(left) < len(who) and len(right) < len(who):
                    cost = len(left) ** 2 + len(right) ** 2
                    if best is None or cost < best[0]:
                        best = (cost, left, right)
        if best is None or best[0] > 0.98 * len(who) ** 2:
            compare(who)
            continue
        todo += [best[1], best[2]]
    return [(i, r) for i in range(len(fps)) if (r := find(i)) != i]


def near_edges(fps: DataFrame, radius: int = 2, per_shard: int = 8192) -> DataFrame:
    """(a, b) edges that connect what is linked among distinct fingerprints in column ``fp``.

    Returns a spanning forest per shard, never all pairs: linked fingerprints, and no others, end
    in one component. The tree's pivots come from a bounded sample (SAMPLE_PER_SHARD for each
    shard, SAMPLE at most); every fingerprint is routed. A shard that holds over four times ``per_shard``, as a ball that no pivot splits or
    one of a table too large for the sample, is dealt into blocks by a hash, and each pair of blocks is a task of its own.
    """
    spark = fps.sparkSession
    n = fps.count()
    want = min(SAMPLE, SAMPLE_PER_SHARD * max(1, -(-n // per_shard)))
    share = min(1.0, 1.2 * want / max(1, n))
    picked = fps.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(2 * want).collect()
    nodes = build_tree(np.array([r["fp"] for r in picked], dtype=np.int64).view(np.uint64), n / max(1, len(picked)), per_shard, radius)
    tree = spark.sparkContext.broadcast(nodes)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(0).to_numpy(zero_copy_only=False)
            i, leaf = route(v.view(np.uint64), tree.value, radius)
            yield pa.RecordBatch.from_arrays([pa.array(leaf.astype(np.int64)), pa.array(v[i])], ["leaf", "fp"])

    def link(g: pa.Table) -> pa.Table:
        v = np.unique(g["fp"].to_numpy())
        pairs = near_forest(v.view(np.uint64), radius)
        i, r = np.array(pairs, np.int64).reshape(-1, 2).T
        return pa.table({"a": v[i], "b": v[r]})

    dealt = cut(fps.select("fp").mapInArrow(deal, "leaf long, fp long"))
    large = dealt.groupBy("leaf").agg(F.count("*").alias("_n")).where(F.col("_n") > 4 * per_shard).select("leaf", F.ceil(F.col("_n") / per_shard).alias("blocks"))
    dealt = dealt.join(F.broadcast(large), "leaf", "left")  # there are fewer leaves than sample points
    block = F.pmod(F.xxhash64("fp"), F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("i", block).withColumn("j", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
    dealt = dealt.select("leaf", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "fp")
    return dealt.groupBy("leaf", "i", "j").applyInArrow(lambda g: link(g.select(["fp"])), "a long, b long")


def simhash_components(
    docs: DataFrame, shingle: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text", extra: str | None = None
) -> DataFrame:
    """(doc_id, fp, component_id) per row: SimHash near-duplicate classes.

    Rows link where their fingerprints differ in at most ``radius`` bits; a class is what links
    reach, and is named by its smallest doc_id. Equal fingerprints are folded into one before any
    comparison, so groups of copies cost one entry. Null or wordless text has fingerprint 0 and
    links like any other; rows with null doc_id stay, and a class of those alone has a null name.
    Repeated rows each come back. An empty table gives no rows.
    """
    marked = cut(fingerprints(docs, shingle, id_col, text_col, extra))
    each = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = connected_components(near_edges(each.select("fp"), radius), "a", "b")
    named = each.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    name = named.groupBy("root").agg(F.min("first").alias("component_id"))
    of = named.join(name, "root").select("fp", "component_id")
    return marked.join(of, "fp").select("doc_id", "fp", "component_id", *([extra] if extra else []))


def deduplicate(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """``docs`` with one row of each class of ``simhash_components``: that of the smallest doc_id (nulls count as the
    largest), among rows of one id the text of smallest hash. All columns stay, whatever their names; an empty table gives no rows."""
    packed = docs.select("doc_id", "text", F.struct(*docs.columns).alias("_rest"))
    keyed = packed.withColumn("_who", F.coalesce(F.col("doc_id").cast("bigint"), F.lit((1 << 63) - 1))).withColumn("_key", null_safe_key("text"))
    got = simhash_components(keyed.select("_who", "_key", "text"), shingle, radius, id_col="_who", extra="_key")
    best = got.groupBy("component_id", "fp").agg(F.min(F.struct("doc_id", "_key")).alias("s")).groupBy("component_id").agg(F.min("s").alias("s"))
    best = best.select(F.col("s.doc_id").alias("_who"), F.col("s._key").alias("_key"))
    one = Window.partitionBy("_who", "_key").orderBy(F.lit(1))
    kept = keyed.join(best, ["_who", "_key"], "left_semi").withColumn("_i", F.row_number().over(one)).where("_i = 1")
    return kept.select("_rest.*")
