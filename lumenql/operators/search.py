"""Full-text and spatial search over derived tables."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import strings


def tokens(docs: DataFrame, id_col: str, text_col: str, kind: str = "ascii") -> DataFrame:
    """(id, pos, term): the ascii tokenizer takes runs of letters and digits, A-Z lower-cased; trigram all runs of three characters."""
    if kind == "trigram":
        t = F.lower(text_col)
        grams = F.when(F.length(t) >= 3, F.transform(F.sequence(F.lit(1), F.length(t) - 2), lambda i: F.substring(t, i, F.lit(3))))
        return docs.select(F.col(id_col).alias("id"), F.posexplode(grams).alias("pos", "term"))
    words = F.regexp_extract_all(F.lower(text_col), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    return docs.select(F.col(id_col).alias("id"), F.posexplode(words).alias("pos", "term"))


def with_term(index: DataFrame, term: str) -> DataFrame:
    """ids that hold the term; a final * asks for a prefix."""
    hit = F.col("term").startswith(term[:-1]) if term.endswith("*") else F.col("term") == term
    return index.where(hit).select("id").distinct()


def with_all(index: DataFrame, terms: list[str]) -> DataFrame:
    return index.where(F.col("term").isin(terms)).groupBy("id").agg(F.count_distinct("term").alias("n")).where(F.col("n") == len(set(terms))).select("id")


def with_any(index: DataFrame, terms: list[str]) -> DataFrame:
    return index.where(F.col("term").isin(terms)).select("id").distinct()


def without(found: DataFrame, other: DataFrame) -> DataFrame:
    return found.join(other, "id", "left_anti")


def phrase(index: DataFrame, terms: list[str]) -> DataFrame:
    """ids in which the terms stand in a row: places minus offsets that all terms share, by one aggregation."""
    place = reduce(lambda c, kv: c.when(F.col("term") == kv[1], F.col("pos") - kv[0]), list(enumerate(terms))[1:], F.when(F.col("term") == terms[0], F.col("pos")))
    if len(set(terms)) == len(terms):
        hits = index.where(F.col("term").isin(terms)).select("id", place.alias("at")).groupBy("id", "at").count().where(F.col("count") == len(terms))
        return hits.select("id").distinct()
    parts = [index.where(F.col("term") == t).select("id", (F.col("pos") - i).alias("at")) for i, t in enumerate(terms)]
    return reduce(lambda a, b: a.join(b, ["id", "at"]), parts).select("id").distinct()


def near(index: DataFrame, a: str, b: str, most: int) -> DataFrame:
    """NEAR(a b, most): at most so many tokens between. Per document, the places meet in arrays and no pairs are made."""
    places = index.where(F.col("term").isin(a, b)).groupBy("id").agg(*[F.array_sort(F.collect_list(F.when(F.col("term") == t, F.col("pos")))).alias(x) for x, t in (("x", a), ("y", b))])
    close = F.exists("x", lambda p: F.exists("y", lambda q: (F.abs(p - q) <= most + 1) & (p != q)))
    return places.where(close).select("id")


def bm25(docs: DataFrame, id_col: str, text_col: str, words: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score) of rows that hold a word: the sum over the words of idf * tf (k1 + 1) / (tf + k1 (1 - b + b len / mean len)).

    Each text is cut into tokens where it is read, and counted there; only one row of statistics is shuffled and comes back to all.
    """
    chosen = [w.lower() for w in dict.fromkeys(words)]
    each = docs.select(F.col(id_col).alias("id"), terms(F.col(text_col)).alias("_t")).where(F.size("_t") > 0)
    often = lambda w: F.size(F.filter("_t", lambda t: t == w))
    counted = each.select("id", F.size("_t").alias("len"), *[often(w).alias(f"tf{i}") for i, w in enumerate(chosen)])
    stats = counted.agg(F.count("*").alias("n"), F.avg("len").alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(chosen))])
    rows = counted.where(reduce(lambda x, y: x | y, [F.col(f"tf{i}") > 0 for i in range(len(chosen))])).join(F.broadcast(stats), F.lit(True))  # one row
    score = F.lit(0.0)
    for i in range(len(chosen)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log((F.col("n") - df + 0.5) / (df + 0.5) + 1)
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    return rows.select("id", score.alias("score"))


def vocabulary(index: DataFrame) -> DataFrame:
    """(term, doc, cnt): in how many rows, how often."""
    return index.groupBy("term").agg(F.count_distinct("id").alias("doc"), F.count("*").alias("cnt"))


def highlight(text: Column, terms: list[str], before: str = "[", after: str = "]") -> Column:
    return F.regexp_replace(text, r"(?i)(?<![\p{L}\p{N}])(" + "|".join(terms) + r")(?![\p{L}\p{N}])", f"{before}$1{after}")


_EDGES = ("x0", "x1", "y0", "y1")
#: The level of boxes that aren't finite or too large for a grid: it has a single cell.
_TOP = 1000


def overlap_join(a: DataFrame, b: DataFrame, cell: float, once: bool = False) -> DataFrame:
    """Pairs of boxes (id, x0, x1, y0, y1) that overlap, as a_id and b_id; with ``once`` only those with a_id < b_id.

    A grid of ``cell`` and, for larger boxes, ones of twice, four times, .. its width. A pair meets in the grid of its larger box: b lies in the cell of its lower
    corner, a comes to all cells that corners of boxes overlapping it can lie in, at most nine. So a pair meets once, and each row is shuffled about once for b and a
    few times for a. A cell's rows come to a task in the order of y0, a's first: it holds the a's of one cell, lets the b's pass by and forms no more pairs than agree in y.
    """
    spark = a.sparkSession
    wide = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    odd = reduce(lambda x, y: x | y, [F.isnan(c) | (F.abs(c) == float("inf")) for c in _EDGES])
    level = F.when(odd, _TOP).otherwise(F.least(F.greatest(F.ceil(F.log2(wide * 1.001 / cell)), F.lit(0)), F.lit(_TOP))).cast("int")

    def boxes(t: DataFrame) -> DataFrame:
        t = t.select(F.col("id").cast("bigint").alias("id"), *[F.col(c).cast("double").alias(c) for c in _EDGES])
        return t.where(reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in _EDGES])).withColumn("own", level)

    a, b = boxes(a), boxes(b)
    of_a = {r[0] for r in a.select("own").distinct().collect()}  # a few levels
    of_b = {r[0]: r[1:] for r in b.groupBy("own").agg(F.max(F.col("x1") - F.col("x0")), F.max(F.col("y1") - F.col("y0"))).collect()}

    def grids(mine: set[int], other: set[int]) -> Column:
        """The grids that a box of this side lies in: its own, if smaller boxes are on the other side, and those of larger boxes there."""
        low, found = min(other, default=_TOP), []
        for n in sorted(mine | other):
            size = cell * 2.0**n
            reach = [max([0.0, *(r[k] for m, r in of_b.items() if m <= n < _TOP)]) + 0.001 * size for k in (0, 1)]
            here = (F.col("own") == n) & F.lit(low <= n) | (F.col("own") < n) & F.lit(n in other)
            found.append(F.when(here, F.struct(F.lit(n).alias("l"), F.lit(size).alias("s"), F.lit(reach[0]).alias("w"), F.lit(reach[1]).alias("h"))))
        return F.explode(F.array_compact(F.array(*found)))

    def at(x: Column) -> Column:
        return F.when(F.col("g.l") == _TOP, F.lit(0)).otherwise(F.floor(x / F.col("g.s"))).cast("bigint")

    def cells(low: Column, high: Column) -> Column:
        return F.explode(F.when(at(low) <= at(high), F.sequence(at(low), at(high))))

    key = ["l", "cx", "cy"]
    rest = ["own", "id", *_EDGES]
    if not of_a or not of_b:
        return spark.createDataFrame([], "a_id bigint, b_id bigint")
    x0, x1, y0, y1 = map(F.col, _EDGES)
    asks = a.withColumn("g", grids(of_a, set(of_b))).withColumn("cx", cells(x0 - F.col("g.w"), x1)).withColumn("cy", cells(y0 - F.col("g.h"), y1)).select("g.l", "cx", "cy", F.lit(False).alias("passes"), *rest)
    held = b.withColumn("g", grids(set(of_b), of_a)).select("g.l", at(x0).alias("cx"), at(y0).alias("cy"), F.lit(True).alias("passes"), *rest)
    # work is in proportion to pairs, not to bytes: so a fixed number of tasks, which Spark doesn't put together
    n = max(8 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    met = asks.unionAll(held).repartition(n, *key).sortWithinPartitions(*key, "passes", "y0")
    return met.mapInArrow(lambda batches: _sweep(batches, once), "a_id bigint, b_id bigint")


#: So many pairs are looked at at once.
_PAIRS = 1 << 18


def _sweep(batches: Iterator[pa.RecordBatch], once: bool) -> Iterator[pa.RecordBatch]:
    cell, parts, held = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("l", "cx", "cy", "passes", "own", *_EDGES)}
        cols["id"], cols["known"] = batch.column("id").fill_null(0).to_numpy(), batch.column("id").is_valid().to_numpy(zero_copy_only=False)
        new = reduce(np.logical_or, [cols[c][1:] != cols[c][:-1] for c in ("l", "cx", "cy", "passes")])
        ends = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
        for s, e in zip(ends, ends[1:]):
            here = cols["l"][s], cols["cx"][s], cols["cy"][s]
            rows = {c: cols[c][s:e] for c in ("own", "id", "known", *_EDGES)}
            if not cols["passes"][s]:
                if here != cell:
                    cell, parts = here, []
                parts.append(rows)
                held = None
            elif here == cell:
                held = held or {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}
                parts = [held]
                yield from _meet(held, rows, here[0], once)


def _meet(a: dict, b: dict, level: int, once: bool) -> Iterator[pa.RecordBatch]:
    """The pairs of a cell, both sides in the order of y0: some b's at a time against the run of a's that may agree with them in y."""
    if level == _TOP:
        low, high = np.zeros(len(b["id"]), np.int64), np.full(len(b["id"]), len(a["id"]))
        le = lambda x, y: (x <= y) | np.isnan(y)  # noqa: E731  as in SQL, where NaN is the greatest
    else:
        tall = max(0.0, float((a["y1"] - a["y0"]).max()))
        low = np.searchsorted(a["y0"], b["y0"] - tall - 4 * np.spacing(np.abs(b["y0"]) + tall), "left")
        high = np.maximum(np.searchsorted(a["y0"], b["y1"], "right"), low)
        le = np.less_equal
    mixed = (a["own"] != level).any() and (b["own"] != level).any()
    some = np.flatnonzero(high > low)
    s = 0
    while s < len(some):
        g = min(256, max(1, _PAIRS // int(high[some[s]] - low[some[s]])))
        j = some[s : s + g]
        while len(j) > 1 and len(j) * int(high[j].max() - low[j].min()) > 2 * _PAIRS:
            j = j[: len(j) // 2]
        s += len(j)
        run = slice(int(low[j].min()), int(high[j].max()))
        p, q = {c: a[c][run] for c in a}, {c: b[c][j, None] for c in b}
        keep = le(p["x0"], q["x1"])
        for more in (le(q["x0"], p["x1"]), le(p["y0"], q["y1"]), le(q["y0"], p["y1"])):
            keep &= more
        if mixed:
            keep &= (p["own"] == level) | (q["own"] == level)
        if once:
            keep &= (p["id"] < q["id"]) & p["known"] & q["known"]
        k = np.count_nonzero(keep, axis=1)
        if k.any():
            i = np.flatnonzero(keep) - np.repeat(np.arange(len(j)) * keep.shape[1], k)
            yield pa.record_batch({"a_id": _ids(p["id"][i], p["known"][i]), "b_id": _ids(np.repeat(b["id"][j], k), np.repeat(b["known"][j], k))})


def _ids(ids: np.ndarray, known: np.ndarray) -> pa.Array:
    return pa.array(ids, mask=None if known.all() else ~known)


def in_circle(x: Column, y: Column, cx: float, cy: float, r: float) -> Column:
    return (x - cx) * (x - cx) + (y - cy) * (y - cy) <= r * r


def terms(text: Column, kind: str = "ascii", token_chars: str = "") -> Column:
    """The tokens of a text as an array, in order: ascii and simple (A-Z lower-cased), unicode61 (marks removed, too), trigram. ``token_chars`` are taken as
    letters."""
    t = F.lower(text)
    if kind == "trigram":
        return F.when(F.length(t) >= 3, F.transform(F.sequence(F.lit(1), F.length(t) - 2), lambda i: F.substring(t, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))
    if kind == "unicode61":
        t = strings.unaccent(t)
    more = re.sub(r"([\\\]\[^-])", r"\\\1", token_chars)
    return F.regexp_extract_all(t, F.lit(rf"([\p{{L}}\p{{N}}{more}]+)"), F.lit(1))


_QUERY = re.compile(r'\s*(?:(NEAR)\s*\(|([(){}:+^,])|(-)(?=\s*[\w{"])|"((?:[^"]|"")*)"(\*?)|([\w\u0080-\U0010ffff]+)(\*?))')


def _lex(query: str) -> list[tuple[str, str, bool]]:
    """(kind, text, whether a * follows): near, a mark as its own kind, word, phrase, and, or, not."""
    out, at = [], 0
    query = query.rstrip()
    while at < len(query):
        m = _QUERY.match(query, at)
        if not m:
            raise ValueError(f"syntax error near {query[at:at + 10]!r}")
        if m[1]:
            out.append(("near", "", False))
        elif m[2] or m[3]:
            out.append((m[2] or m[3], "", False))
        elif m[4] is not None:
            out.append(("phrase", m[4].replace('""', '"'), bool(m[5])))
        elif m[6] in ("AND", "OR", "NOT") and not m[7]:
            out.append((m[6].lower(), "", False))
        else:
            out.append(("word", m[6], bool(m[7])))
        at = m.end()
    return out


class _Query:
    """A parser of full-text queries, straight to conditions on token arrays: OR binds least, then AND (also between phrases side by side), then NOT."""

    def __init__(self, columns: dict[str, Column], query: str) -> None:
        self.columns, self.left = columns, _lex(query)

    def peek(self) -> str:
        return self.left[0][0] if self.left else ""

    def take(self, kind: str) -> tuple[str, str, bool]:
        if self.peek() != kind:
            raise ValueError(f"syntax error: {kind} expected")
        return self.left.pop(0)

    def disjunction(self, names: list[str]) -> Column:
        out = self.conjunction(names)
        while self.peek() == "or":
            self.take("or")
            out = out | self.conjunction(names)
        return out

    def conjunction(self, names: list[str]) -> Column:
        out = self.difference(names)
        while self.peek() and self.peek() not in ("or", ")"):
            if self.peek() == "and":
                self.take("and")
            out = out & self.difference(names)
        return out

    def difference(self, names: list[str]) -> Column:
        out = self.item(names)
        while self.peek() == "not":
            self.take("not")
            out = out & ~self.item(names)
        return out

    def item(self, names: list[str]) -> Column:
        kind = self.peek()
        if kind == "-" or kind == "{" or kind == "word" and len(self.left) > 1 and self.left[1][0] == ":":
            names = self.column_set(names)
            return self.item(names)
        if kind == "(":
            self.take("(")
            out = self.disjunction(names)
            self.take(")")
            return out
        if kind == "near":
            return self.near(names)
        first = kind == "^"
        if first:
            self.take("^")
        words = self.phrase()
        hits = [places(self.columns[n], words, first) for n in names]
        return reduce(lambda a, b: a | b, [F.size(h) > 0 for h in hits], F.lit(False))

    def column_set(self, names: list[str]) -> list[str]:
        other = self.peek() == "-"
        if other:
            self.take("-")
        if self.peek() == "{":
            self.take("{")
            chosen = []
            while self.peek() == "word":
                chosen.append(self.take("word")[1])
            self.take("}")
        else:
            chosen = [self.take("word")[1]]
        self.take(":")
        if unknown := set(chosen) - set(self.columns):
            raise ValueError(f"no such column: {unknown.pop()}")
        return [n for n in names if (n in chosen) != other]

    def phrase(self) -> list[tuple[str, bool]]:
        """Tokens, the last of which may be a prefix; + joins phrases."""
        out: list[tuple[str, bool]] = []
        while True:
            kind, text, star = self.left.pop(0) if self.left else ("", "", False)
            if kind not in ("word", "phrase"):
                raise ValueError("syntax error: a word expected")
            got = re.findall(r"[^\W_]+", text.lower())
            out += [(t, False) for t in got]
            if star and out:
                out[-1] = (out[-1][0], True)
            if self.peek() != "+":
                return out
            self.take("+")

    def near(self, names: list[str]) -> Column:
        self.take("near")
        parts = []
        while self.peek() in ("word", "phrase"):
            parts.append(self.phrase())
        most = 10
        if self.peek() == ",":
            self.take(",")
            most = int(self.take("word")[1])
        self.take(")")
        hits = []
        for n in names:
            at = [places(self.columns[n], p, False) for p in parts]
            # a window of places that holds all: for each start of any phrase, the first start of every one at or after it
            starts = reduce(F.array_union, at)
            ends = lambda s, at=at: reduce(F.greatest, [F.array_min(F.filter(a, lambda x: x >= s)) + len(p) for a, p in zip(at, parts)]) if len(at) > 1 else s + len(parts[0])
            whole = lambda s, at=at: reduce(lambda a, b: a & b, [F.exists(a, lambda x: x >= s) for a in at])
            total = sum(map(len, parts))
            hits.append(F.exists(starts, lambda s: whole(s) & (ends(s) - s - total <= most)))
        return reduce(lambda a, b: a | b, hits, F.lit(False))


def places(tokens_: Column, words: list[tuple[str, bool]], first: bool = False) -> Column:
    """0-based places in a token array at which a phrase stands; with ``first`` only the beginning."""
    if not words:
        return F.array().cast("array<int>")
    n = F.size(tokens_)
    at = F.when(n >= len(words), F.sequence(F.lit(0), n - len(words))).otherwise(F.array().cast("array<int>"))
    if first:
        at = F.slice(at, 1, 1)

    def here(i: Column) -> Column:
        tests = []
        for k, (w, prefix) in enumerate(words):
            t = F.get(tokens_, i + k)
            tests.append(t.startswith(w) if prefix else t == w)
        return reduce(lambda a, b: a & b, tests)

    return F.filter(at, here)


def matches(columns: dict[str, Column], query: str, kind: str = "ascii") -> Column:
    """Whether a row matches a full-text query: words, "phrases", prefix*, ^first, a + b, NEAR(a b, n), {column sets} : and - {..} :, NOT, AND, OR, (..).

    One condition on the row's own tokens, so a search is a scan with a filter: no index, no shuffle. Null text has no tokens.
    """
    arrays = {n: F.coalesce(terms(c, kind), F.array().cast("array<string>")) for n, c in columns.items()}
    parser = _Query(arrays, query)
    out = parser.disjunction(list(columns))
    if parser.left:
        raise ValueError(f"syntax error near {parser.left[0][0]!r}")
    return out


def offsets(text: Column, phrase_: str) -> Column:
    """Token places of a phrase in a text, from 0."""
    words = [(w, False) for w in re.findall(r"[^\W_]+", phrase_.lower())]
    return F.coalesce(places(terms(text), words), F.array().cast("array<int>"))


def snippet(text: Column, words: list[str], size: int, before: str = "[", after: str = "]", gap: str = "\u2026") -> Column:
    """``size`` tokens of the text with most hits marked, the first such run that begins with one; what is left out is a gap. Text without a hit comes back whole."""
    parts = F.split(F.trim(text), r"\s+")
    hit = lambda t: F.lower(F.regexp_replace(t, r"[^\p{L}\p{N}]", "")).isin([w.lower() for w in words])
    marked = F.transform(parts, lambda t: F.when(hit(t), F.concat(F.lit(before), t, F.lit(after))).otherwise(t))
    starts = F.filter(F.sequence(F.lit(1), F.size(parts)), lambda i: hit(F.element_at(parts, i)))
    scored = F.transform(starts, lambda i: F.struct((-F.size(F.filter(F.slice(parts, i, F.lit(size)), hit))).alias("s"), i.alias("i")))
    best = F.array_min(scored)["i"]
    body = F.array_join(F.slice(marked, best, F.lit(size)), " ")
    cut = F.concat(F.when(best > 1, gap).otherwise(""), body, F.when(best + size <= F.size(parts), gap).otherwise(""))
    return F.when(best.isNull(), text).otherwise(cut)


def spelling(words: DataFrame, wanted: str, most: int, top: int | None = None) -> DataFrame:
    """(word, distance) of vocabulary words at most so many edits from the wanted one, the nearest ``top`` of them; lengths alone rule most words out."""
    near = words.where(F.abs(F.length("word") - len(wanted)) <= most)
    got = near.select("word", F.levenshtein("word", F.lit(wanted)).alias("distance")).where(F.col("distance") <= most)
    return got if top is None else got.orderBy("distance", "word").limit(top)


def match_info(docs: DataFrame, id_col: str, text_col: str, words: list[str]) -> DataFrame:
    """(id, word, hits, hits_all, rows_all) for rows that hold a word: how often in the row, in all rows, and in how many rows."""
    each = docs.select(F.col(id_col).alias("id"), terms(F.col(text_col)).alias("_t"))
    often = lambda w: F.size(F.filter("_t", lambda t: t == w))
    counted = each.select("id", F.explode(F.array(*[F.struct(F.lit(w).alias("word"), often(w).alias("hits")) for w in words])).alias("x")).select("id", "x.*").where("hits > 0")
    every = counted.groupBy("word").agg(F.sum("hits").alias("hits_all"), F.count("*").alias("rows_all"))
    return counted.join(F.broadcast(every), "word").select("id", "word", "hits", "hits_all", "rows_all")  # as many rows as words


def fuzzed(word: str, rules: list[tuple[str, str, int]], most: int) -> list[tuple[str, int]]:
    """What rules (from, to, cost) make of a word, with the least cost of each up to ``most``, the cheapest first; rules cost more than nothing."""
    if any(cost <= 0 for *_, cost in rules):
        raise ValueError("rules cost more than 0")
    done: dict[str, int] = {}
    todo = [(0, word)]
    while todo:
        cost, w = heapq.heappop(todo)
        if w in done:
            continue
        done[w] = cost
        for a, b, c in rules:
            if cost + c > most:
                continue
            at = w.find(a)
            while at >= 0:
                heapq.heappush(todo, (cost + c, w[:at] + b + w[at + len(a) :]))
                at = w.find(a, at + 1) if a else (at + 1 if at < len(w) else -1)
    return sorted(done.items(), key=lambda x: (x[1], x[0]))


def approximate(words: DataFrame, word: str, rules: list[tuple[str, str, int]], most: int) -> DataFrame:
    """(word, distance) of vocabulary words that the rules make of one, up to a cost: a hash join of what they make with the vocabulary."""
    made = words.sparkSession.createDataFrame(fuzzed(word, rules, most), "word string, distance int")
    return words.select("word").join(made, "word")
