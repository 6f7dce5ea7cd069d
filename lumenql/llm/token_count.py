"""Greedy word-piece lengths by a linear longest-match automaton."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHE_WORDS = 500_000
_machines: dict[str, "Matcher"] = {}


class Matcher:
    """Vocabulary trie with failure links; each link knows how many pieces it pops.

    Reading a character either goes down the trie or follows failure links: the link of a node leads to the
    node of what remains after the longest pieces at its front are taken off, and counts those pieces. So the
    number of pieces of a word comes from one pass, without trying or building any piece. A word that cannot be covered has ``unknown`` pieces.
    """

    def __init__(self, vocabulary: Iterable[str], unknown: int = 1) -> None:
        self.unknown = unknown
        self.next: list[dict[str, int]] = [{}]
        self.is_piece = [False]
        for piece in vocabulary:
            v = 0
            for c in piece:
                v = self.next[v].setdefault(c, len(self.next))
                if v == len(self.is_piece):
                    self.next.append({})
                    self.is_piece.append(False)
            if v:
                self.is_piece[v] = True
        self.fail = [-1] * len(self.next)
        self.pops = [0] * len(self.next)
        queue = deque([0])
        while queue:
            u = queue.popleft()
            for c, v in self.next[u].items():
                queue.append(v)
                if self.is_piece[v]:
                    self.fail[v], self.pops[v] = 0, 1
                    continue
                z, n = self.fail[u], self.pops[u]
                while z != -1 and c not in self.next[z]:
                    n += self.pops[z]
                    z = self.fail[z]
                if z != -1:
                    self.fail[v], self.pops[v] = self.next[z][c], n

    def count(self, word: str) -> int:
        """Pieces of greedy longest-match-first over ``word``; ``unknown`` if some of it is in no piece."""
        nxt, fail, pops = self.next, self.fail, self.pops
        u = n = 0
        for c in word:
            while (v := nxt[u].get(c)) is None:
                n += pops[u]
                u = fail[u]
                if u == -1:
                    return self.unknown
            u = v
        while u:
            n += pops[u]
            u = fail[u]
            if u == -1:
                return self.unknown
        return n


def matcher(path: str, mark: str = "</w>") -> Matcher:
    """The machine of a tokenizer file's vocabulary, made once per process. Pieces with the end-of-word mark
    count without it, so that any piece may end a word."""
    if path not in _machines:
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        _machines[path] = Matcher({p.removesuffix(mark) for p in vocab})
    return _machines[path]


class _Counts(dict):
    def __init__(self, m: Matcher, letters: dict[int, str]) -> None:
        self.m, self.letters = m, letters

    def __missing__(self, word: str) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        n = self[word] = self.m.count("".join(map(self.letters.__getitem__, word.lower().encode())))
        return n


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens) for every row.

    Words are runs without white space, lower-cased, in the vocabulary's byte alphabet;
    n_tokens adds up their greedy longest-match pieces. Null, empty and blank texts have none. No shuffle; the
    vocabulary file is read where the workers are, its path being a parameter.
    """
    from .packing import _byte_letters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts(matcher(path), _byte_letters())
        for b in batches:
            n_words, n_tokens = [], []
            for t in b.column(1):
                words = (t.as_py() or "").split()
                n_words.append(len(words))
                n_tokens.append(sum(map(counts.__getitem__, words)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col)).mapInArrow(run, "doc_id long, n_words long, n_tokens long")
