"""Benchmark decontamination with a generalised suffix automaton over the items' words."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, cut, release, small_batches

#: Words of one automaton; more items make more automata, each a pass of its own.
MAX_WORDS = 1_000_000
WINDOW = 13
_TABLE = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 0x80 or 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words of the text as UTF-8: runs of ASCII letters (lower-cased), digits and all other characters
    beyond ASCII."""
    return text.encode("utf-8").translate(_TABLE).split() if text else []


class Automaton:
    """Generalised suffix automaton: every run of words of any item leads from the root to a state."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int = WINDOW) -> None:
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        self.items: list[str] = []
        seqs = []
        for name, words in items:
            if words:
                self.items.append(name)
                seqs.append([self.vocab.setdefault(w, len(self.vocab)) for w in words])
        for seq in seqs:
            last = 0
            for c in seq:
                last = self._extend(last, c)
        self._label(seqs)
        self.least = min([window, *map(len, seqs)]) if seqs else 0

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        if (q := nxt[last].get(c)) is not None:
            if length[q] == length[last] + 1:
                return q
            return self._clone(last, c, q)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = new
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def _label(self, seqs: list[list[int]]) -> None:
        n, w = len(self.next), self.window
        self.owners: list[set[int]] = [set() for _ in range(n)]
        self.whole: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for k, seq in enumerate(seqs):
            v, ell = 0, 0
            for c in seq:
                v, ell = self.next[v][c], ell + 1
                # every state whose strings end here occurs in item k
                u = v
                while u > 0 and k not in self.owners[u]:
                    self.owners[u].add(k)
                    u = self.link[u]
            if len(seq) < w:
                self.whole[v].append((len(seq), k))
        order = sorted(range(1, n), key=self.len.__getitem__)
        self.windowed = [-1] * n  # the state of the last w words, where at least w are matched
        for v in order:
            p = self.link[v]
            if self.len[v] >= w:
                self.windowed[v] = v if self.len[p] < w else self.windowed[p]
            if self.whole[p] and p > 0:
                self.whole[v] = sorted(self.whole[v] + self.whole[p])

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit spans [from, to) in ascending order, which may overlap, and the items found."""
        if not self.least or len(words) < self.least:
            return [], set()
        ids = list(map(self.vocab.get, words))
        known = np.fromiter((i is not None for i in ids), dtype=bool, count=len(ids))
        edge = np.flatnonzero(np.diff(np.concatenate(([False], known, [False]))))
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        runs = edge.reshape(-1, 2)
        w, nxt, link, length = self.window, self.next, self.link, self.len
        for a, b in runs[runs[:, 1] - runs[:, 0] >= self.least].tolist():  # shorter runs hold no window
            v = ell = 0
            for i in range(a, b):
                c = ids[i]
                while (to := nxt[v].get(c)) is None and v:
                    v = link[v]
                    ell = length[v]
                if to is None:
                    continue
                v, ell = to, ell + 1
                if ell >= w:
                    spans.append((i + 1 - w, i + 1))
                    found |= self.owners[self.windowed[v]]
                for size, k in self.whole[v]:
                    if size <= ell:
                        spans.append((i + 1 - size, i + 1))
                        found.add(k)
        return spans, found


def merged(spans: Iterable[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def automata(benchmark: DataFrame, window: int = WINDOW, max_words: int = MAX_WORDS) -> Iterator[Automaton]:
    """Automata over all items, one after another, of ``max_words`` words or one item each; at least one. Items of null id or without words
    have no windows. Items stream through the driver, which holds one automaton at a time."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id is not null and text is not null").distinct()
    chunk, n, made = [], 0, 0
    for r in rows.orderBy("item_id", "text").toLocalIterator():
        words = words_of(r["text"])
        if chunk and n + len(words) > max_words:
            yield Automaton(chunk, window)
            chunk, n, made = [], 0, made + 1
        chunk.append((r["item_id"], words))
        n += len(words)
    if chunk or not made:
        yield Automaton(chunk, window)


_HITS = pa.struct([("a", pa.int64()), ("b", pa.int64())])


def _scanned(docs: DataFrame, benchmark: DataFrame, window: int, max_words: int, finish: Callable[[list], pa.RecordBatch], schema: str) -> DataFrame:
    """``finish`` of what all automata find. It gets columns: _rest (a struct of all others), text, and lists of each text's words, spans [a, b) and
    names of items.

    Every automaton is a pass over the texts, so that a worker holds one at a time, whatever the benchmark's size; the hits of those before are kept beside
    the texts in a checkpoint. A benchmark of up to ``max_words`` words takes one pass, from scan to result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema["text"].dataType.simpleString()
    state = docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("_rest"), "text", F.array().cast("array<struct<a: bigint, b: bigint>>").alias("spans"), F.array().cast("array<string>").alias("items"))
    rest = state.schema["_rest"].dataType.simpleString()

    def over(a: Automaton, last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        shared = spark.sparkContext.broadcast(a)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            claim({})
            machine = shared.value
            for b in batches:
                counts, spans, items = [], [], []
                for t, old, names in zip(b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist()):
                    words = words_of(t.as_py())
                    got, found = machine.scan(words)
                    counts.append(len(words))
                    spans.append(merged([*((x["a"], x["b"]) for x in old), *got]))
                    items.append(sorted({*names, *(machine.items[k] for k in found)}))
                if last:
                    yield finish([b.column(0), b.column(1), counts, spans, items])
                else:
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0), b.column(1), pa.array([[{"a": x, "b": y} for x, y in s] for s in spans], pa.list_(_HITS)), pa.array(items, pa.list_(pa.string()))], ["_rest", "text", "spans", "items"]
                    )
            release()

        return run

    machines = automata(benchmark, window, max_words)
    here = next(machines)
    for after in machines:
        state = cut(state.mapInArrow(over(here, False), f"_rest {rest}, text {kind}, spans array<struct<a: bigint, b: bigint>>, items array<string>"))
        here = after
    return state.mapInArrow(over(here, True), schema)


def contamination_report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, per_words: int = 20, max_words: int = MAX_WORDS) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) per document, for each row; null texts have no words.

    contaminated: some word is hit, and at least one in ``per_words``.
    """

    def finish(cols: list) -> pa.RecordBatch:
        rest, _, counts, spans, items = cols
        out: list[list] = [[], [], [], [], []]
        for n, cuts, names in zip(counts, spans, items):
            hit = sum(y - x for x, y in cuts)
            row = (n, hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), hit > 0 and per_words * hit >= n)
            for col, v in zip(out, row):
                col.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
        names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
        return pa.RecordBatch.from_arrays([rest.field(0), *(pa.array(c, k) for c, k in zip(out, kinds))], names)

    given = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return _scanned(given, benchmark, window, max_words, finish, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def remove_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = 0.5, max_words: int = MAX_WORDS) -> DataFrame:
    """``docs`` without what occurs in test items: hit spans are cut from the texts, and documents of
    which ``coverage`` or more of the words are hit go. Clean documents stay as they are, as do null
    texts; all columns stay (n_chars, if there is one, follows the text)."""

    def clean(text: str | None, n: int, cuts: list[list[int]]) -> str | None:
        if not cuts:
            return text
        if sum(b - a for a, b in cuts) >= coverage * n:
            return ""
        raw = text.encode("utf-8")
        inside = np.frombuffer(raw.translate(_TABLE), dtype=np.uint8) != 32
        edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])))).reshape(-1, 2)
        out, last = [], 0
        for a, b in cuts:
            out.append(raw[last : edges[a][0]])
            last = int(edges[b - 1][1])
        return b"".join([*out, raw[last:]]).decode("utf-8")

    def finish(cols: list) -> pa.RecordBatch:
        rest, texts, counts, spans, _ = cols
        out = dict(zip([c for c in names if c != "text"], rest.flatten())) | {"text": texts}
        old = texts.to_pylist()
        new = [clean(t, n, s) for t, n, s in zip(old, counts, spans)]
        keep = np.array([not (o and not n) for o, n in zip(old, new)], dtype=bool)
        out["text"] = pa.array(new, texts.type)
        if "n_chars" in out:
            was = out["n_chars"].to_pylist()
            out["n_chars"] = pa.array([w if n == o else len(n) for o, n, w in zip(old, new, was)], out["n_chars"].type)
        return pa.RecordBatch.from_arrays([out[c] for c in names], names).filter(pa.array(keep))

    names = docs.columns
    return _scanned(docs, benchmark, window, max_words, finish, docs.schema)
