"""Best-fit packing of token sequences by linear grouping over the histogram of lengths."""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import claim, cut, release, shuffle_partitions, small_batches

CAPACITY = 4096
END_ID = 1
#: Words remembered by a worker; about 200 bytes each.
CACHE_WORDS = 700_000
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)")
_words: dict[str, dict[str, bytes]] = {}
_tools: dict[str, tuple] = {}


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the rest follow from 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


def tokenizer(path: str) -> tuple:
    if path not in _tools:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        _tools[path] = (t, t.model, _byte_letters())
    return _tools[path]


def _word_ids(word: str, path: str, memo: dict[str, bytes]) -> bytes:
    """Ids of what stands between two spaces.

    Lower-case Latin words with at most one full stop or comma behind them, nearly all words, go
    straight to the tokenizer's model, for they are one pre-token each; all else goes through the
    whole tokenizer. The vocabulary drops white space, so words are independent.
    """
    t, model, letters = tokenizer(path)
    if m := _PLAIN.fullmatch(word):
        core = m[1].lower()
        if (ids := memo.get(core) if core != word else None) is None:
            ids = np.array([x.id for x in model.tokenize("".join(letters[b] for b in core.encode()))], dtype="<u4").tobytes()
            if core != word:
                memo[core] = ids
        if m[2]:
            ids += np.array(t.encode(m[2], add_special_tokens=False).ids, dtype="<u4").tobytes()
        return ids
    return np.array(t.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()


class _Memo(dict):
    def __init__(self, path: str) -> None:
        self.path, self.most = path, CACHE_WORDS

    def __missing__(self, word: str) -> bytes:
        if len(self) > self.most:
            self.clear()
        ids = self[word] = _word_ids(word, self.path, self) if word else b""
        return ids


def token_bytes(text: str | None, path: str) -> bytes:
    """The text's ids, each as four little-endian bytes, without special tokens."""
    memo = _words.setdefault(path, _Memo(path))
    return b"".join(map(memo.__getitem__, text.replace("\n", " ").split(" "))) if text else b""


def _remembered(path: str, most: int) -> dict[str, bytes]:
    """The words that token_bytes remembers, ``most`` of them from now on. Tasks must ask for them here: a function within
    a function is sent to the workers with copies of the dictionaries it names."""
    memo = claim(_words.setdefault(path, _Memo(path)), _tools)
    memo.most = most
    return memo


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, cache_words: int = CACHE_WORDS, forget: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document's ids and the end id, cut at ``capacity``.

    ``forget``: workers empty their memory of words after each task. They keep the tokenizer: one that is dropped leaves
    the words its model remembers to the process, so that a worker would grow with every task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _remembered(path, cache_words)
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = token_bytes(text.as_py(), path) + end_id.to_bytes(4, "little")
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for col, v in zip(out, (doc, k, at // 4, len(part) // 4, zlib.crc32(part))):
                        col.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])
        if forget:
            release(memo)

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


# --- the plan, over counts of lengths only -------------------------------------------------


def configurations(sizes: list[int], need: list[int], capacity: int, rounds: int = 800) -> list[tuple[list[int], int]]:
    """Few-size bin configurations (items per size, how often), rounded down from the linear optimum.

    Column generation: a basis of one configuration per size, priced by a knapsack over the capacity.
    """
    n = len(sizes)
    basis = np.diag([capacity // s for s in sizes]).astype(float)
    d = np.array(need, dtype=float)
    for _ in range(rounds):
        inv = np.linalg.inv(basis)
        x = inv @ d
        duals = np.ones(n) @ inv
        best = np.zeros(capacity + 1)
        layers = []
        for s, y in zip(sizes, duals):
            layers.append(best)
            if y > 1e-12:
                best = best.copy()
                for _ in range(capacity // s):
                    more = best[:-s] + y
                    if not (more > best[s:] + 1e-15).any():
                        break
                    np.maximum(best[s:], more, out=best[s:])
        if best[capacity] <= 1 + 1e-7:
            break
        col, c = np.zeros(n), capacity
        value = best
        for i in range(n - 1, -1, -1):
            s, y = sizes[i], duals[i]
            while value[c] > layers[i][c] + 1e-13 and c >= s:
                col[i] += 1
                c -= s
            value = layers[i]
        if col @ duals <= 1 + 1e-7:
            break
        turn = inv @ col
        ok = turn > 1e-9
        if not ok.any():
            break
        ratio = np.where(ok, x / np.where(ok, turn, 1), np.inf)
        out = int(np.argmin(ratio))
        basis[:, out] = col
    x = np.linalg.solve(basis, d)
    return [([int(round(v)) for v in basis[:, j]], int(np.floor(x[j] + 1e-9))) for j in range(n) if x[j] >= 1]


class _Bins:
    """Classes of equal bins by what room they have left."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.by, self.rooms, self.done = capacity, defaultdict(list), [], []

    def add(self, many: int, items: list[tuple[int, int]], room: int) -> None:
        if many <= 0:
            return
        if room <= 0:
            self.done.append((many, items))
            return
        if not self.by[room]:
            insort(self.rooms, room)
        self.by[room].append((many, items))

    def take(self, size: int):
        i = bisect_left(self.rooms, size)
        if i == len(self.rooms):
            return None
        room = self.rooms[i]
        many, items = self.by[room].pop()
        if not self.by[room]:
            self.rooms.pop(i)
        return many, items, room

    def best_fit(self, size: int, n: int) -> None:
        while n:
            got = self.take(size)
            many, items, room = got or (-(-n // (self.capacity // size)), [], self.capacity)
            q = room // size
            full = min(many, n // q)
            self.add(full, [*items, (size, q)], room - q * size)
            n -= full * q
            many -= full
            if many and n:
                self.add(1, [*items, (size, n)], room - n * size)
                many, n = many - 1, 0
            if got:
                self.add(many, items, room)

    def all(self) -> list[tuple[int, list[tuple[int, int]]]]:
        return self.done + [x for room in self.rooms for x in self.by[room]]


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = 256, large: float = 0.4) -> list[tuple[int, list[tuple[int, int]]]]:
    """Classes (how many bins, [(length, items of it)]) that hold ``counts`` pieces of each length.

    Linear grouping: lengths above ``large`` of the capacity are put in ``groups`` groups of equal
    cardinality, longest first, and rounded up to the group's longest; the few-size problem is
    optimised; actual lengths then take the slots of their group, and what is left, with all small
    ones, goes best-fit, longest first. Works on counts, so its cost and result size depend on the
    capacity and not on the number of documents.
    """
    bins = _Bins(capacity)
    bins.add(counts.get(capacity, 0), [(capacity, 1)], 0)
    rest = {s: n for s, n in counts.items() if 0 < s < capacity and n > 0}
    big = sorted((s for s in rest if s > capacity * large), reverse=True)
    total = sum(rest[s] for s in big)
    if total:
        each = -(-total // groups)
        grouped: list[list[list[int]]] = [[]]  # per group: [length, count], longest first
        room = each
        for s in big:
            n = rest[s]
            while n:
                if not room:
                    grouped.append([])
                    room = each
                k = min(n, room)
                grouped[-1].append([s, k])
                n -= k
                room -= k
        tops: dict[int, list[list[int]]] = {}
        for g in grouped:
            tops.setdefault(g[0][0], []).extend(g)  # groups that round to one size are one
        sizes = list(tops)
        for slots, many in configurations(sizes, [sum(k for _, k in tops[s]) for s in sizes], capacity):
            left, use = many, [(tops[s], q) for s, q in zip(sizes, slots) if q]
            while left and all(pool for pool, _ in use):
                items: dict[int, int] = defaultdict(int)
                if all(pool[0][1] >= q for pool, q in use):
                    run = min(left, *(pool[0][1] // q for pool, q in use))
                    for pool, q in use:
                        items[pool[0][0]] += q
                        pool[0][1] -= q * run
                else:  # a length runs out inside this bin
                    run = 1
                    for pool, q in use:
                        while q and pool:
                            k = min(q, pool[0][1])
                            items[pool[0][0]] += k
                            pool[0][1] -= k
                            q -= k
                            if not pool[0][1]:
                                pool.pop(0)
                for pool, _ in use:
                    if pool and not pool[0][1]:
                        pool.pop(0)
                bins.add(run, list(items.items()), capacity - sum(a * b for a, b in items.items()))
                left -= run
        for s in big:
            rest.pop(s)
        for pool in tops.values():
            for length, k in pool:
                if k > 0:
                    rest[length] = rest.get(length, 0) + k
    for s in sorted(rest, reverse=True):
        bins.best_fit(s, rest[s])
    return bins.all()


def segments(classes: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, lo, hi, first_sequence, each, first_offset): ranks lo..hi-1 of a length go, ``each``
    to a sequence, to consecutive sequences from ``first_sequence`` on."""
    rank: dict[int, int] = defaultdict(int)
    rows, seq = [], 0
    for many, items in classes:
        at = 0
        for length, q in items:
            lo = rank[length]
            rank[length] = hi = lo + many * q
            rows.append((length, lo, hi, seq, q, at))
            at += length * q
        seq += many
    return rows


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY, groups: int = 256) -> DataFrame:
    """Adds sequence_id and offset to rows with a ``length`` between 1 and ``capacity``.

    Three passes over small rows: a histogram of lengths (at most ``capacity`` rows reach the
    driver); a rank of every row within its length, from counts per (length, bucket) so that no
    length, however common, is one task; a lookup in the plan's segments, whose number is bounded
    by the capacity and so may be broadcast. The rows must be deterministic (checkpointed).
    """
    spark = cut_pieces.sparkSession
    counts = {r["length"]: r["n"] for r in cut_pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows = segments(plan(counts, capacity, groups))
    table = spark.createDataFrame(
        rows, "s_length long, lo long, hi long, first_sequence long, each long, first_offset long"
    )
    keys = [c for c in cut_pieces.columns if c != "length"]
    buckets = 4 * shuffle_partitions(spark)
    dealt = cut_pieces.withColumn("_bucket", F.pmod(F.xxhash64("length", *keys), F.lit(buckets)))
    per = dealt.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = Window.partitionBy("length", "_bucket").orderBy(*[F.col(c).asc_nulls_first() for c in keys])
    ranked = dealt.withColumn("_row", F.row_number().over(within)).join(per, ["length", "_bucket"])
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_row") - 1)
    on = (F.col("length") == F.col("s_length")) & (F.col("_rank") >= F.col("lo")) & (F.col("_rank") < F.col("hi"))
    got = ranked.join(F.broadcast(table), on)
    return got.select(
        *cut_pieces.columns,
        (F.col("first_sequence") + F.expr("(_rank - lo) div each")).alias("sequence_id"),
        (F.col("first_offset") + (F.col("_rank") - F.col("lo")) % F.col("each") * F.col("length")).alias("offset"),
    )


def pack_documents(
    docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, groups: int = 256, cache_words: int = CACHE_WORDS, forget: bool = False
) -> DataFrame:
    """Packs all documents into as few sequences of ``capacity`` tokens as the plan finds.

    Null text counts as empty: the end id alone. Only longer documents are cut. Rows with null or
    repeated doc_id are packed like others. A worker remembers ``cache_words`` words, with ``forget`` until its task ends. Cost: one pass over the texts; what is shuffled is
    five numbers for each piece. An empty table gives no rows.
    """
    return pack(cut(pieces(docs, path, capacity, end_id, cache_words, forget)), capacity, groups)
