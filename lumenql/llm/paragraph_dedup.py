"""Substring dedup: near-equal paragraphs by MinHash banding, and passages that repeat at any place.

One pass over the distinct texts reads their words and leaves two kinds of signatures. Lines of MIN_WORDS words or
more get a MinHash signature of BANDS bands of ROWS rows over shingles of five words: lines that collide in a band are joined with the one of
them that meets most others, those that this leaves apart with all others of the band, exact Jaccard similarity is verified, and classes of
linked lines are the components. And, as passages are also spliced into the middle of other lines, where no whole line is
alike, every run of WINDOW words is a sliding paragraph with a one-row signature, the least hash of its shingles of SPAN
words; of those that collide in it all words are compared, by one hash of the whole run, and equal runs are a class.

Only texts with a collision are read again. They are found by a filter of bounded size and an exact join behind it, so that texts without
one are never shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import claim, cut, join_split, maybe_in, null_safe_key, release, small_batches
from .components import connected_components
from .simhash import near_edges, simhash64

MIN_WORDS = 51
SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 10, 3
WINDOW, SPAN = 51, 16
#: Bytes of texts that are read together, and words whose shingles are hashed at a time.
CHUNK, STEP = 1 << 16, 1 << 15
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE = 0xC2B2AE3D27D4EB4F
_MASK = (1 << 64) - 1
_SPACE = re.compile(rb"[ \t-\r]")
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _claimed() -> None:
    """Tasks claim the tables here: a function within a function is sent to the workers with copies of the dictionaries it names."""
    claim(_powers)


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2^64, and those of its inverse."""
    if base not in _powers or len(_powers[base][0]) < n:
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(1 << (n - 1).bit_length(), b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers[base] = (out[0], out[1])
    up, down = _powers[base]
    return up[:n], down[:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _slices(raw: bytes) -> Iterator[bytes]:
    """The bytes in parts that end at white space, of about four CHUNKs unless a word is longer."""
    at = 0
    while at < len(raw):
        m = _SPACE.search(raw, at + 4 * CHUNK)
        end = m.end() if m else len(raw)
        yield raw[at:end]
        at = end


def tokenise(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of all words, where each text's words end, where each line's do). Words are runs without ASCII white space, A-Z
    lower-cased; a hash is a polynomial in the bytes, by prefix sums. A text's last line ends with it."""
    size = np.cumsum([len(t) + 1 for t in texts])
    words, breaks, n, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0, 0
    ends = np.zeros(len(texts), np.int64)
    for raw in _slices(b"\n".join([*texts, b""]).lower()):
        data = np.frombuffer(raw, np.uint8)
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = (data != 32) & ((data - np.uint8(9)) > 4)
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        a, b = edges[::2], edges[1::2]
        up, down = _power(_BYTE, len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
        words.append(_mix((sums[b] - sums[a]) * down[a]))
        breaks.append(n + np.searchsorted(a, np.flatnonzero(data == 10)))
        here = (size > at) & (size <= at + len(data))
        ends[here] = n + np.searchsorted(a, size[here] - at)
        n, at = n + len(a), at + len(data)
    return np.concatenate(words), ends, np.concatenate(breaks)


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the text's words: runs without ASCII white space, A-Z lower-cased."""
    return tokenise([text.encode("utf-8")])[0]


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k words, by prefix sums of a polynomial modulo 2^64."""
    n = len(words)
    if n < k:
        return np.zeros(0, np.uint64)
    if n > 2 * STEP:  # very long texts in slices
        return np.concatenate([shingle_hashes(words[i : i + STEP + k - 1], k) for i in range(0, n - k + 1, STEP)])
    up, down = _power(_BASE, n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words * up[:n], out=sums[1:], dtype=np.uint64)
    return _mix((sums[k:] - sums[:-k]) * down[: n - k + 1])


def minima(words: np.ndarray, window: int = WINDOW, span: int = SPAN) -> np.ndarray:
    """For every run of ``window`` words the least hash of its shingles of ``span`` words."""
    low, size, want = shingle_hashes(words, span), 1, window - span + 1
    if len(low) < want:
        return np.zeros(0, np.uint64)
    while 2 * size <= want:
        low, size = np.minimum(low[:-size], low[size:]), 2 * size
    return np.minimum(low[: len(low) - (want - size)], low[want - size :]) if size < want else low


def _inside(n: int, ends: np.ndarray, window: int) -> np.ndarray:
    """Whether the run of ``window`` words from each place on lies in one text."""
    if n < window:
        return np.zeros(0, bool)
    who = np.repeat(np.arange(len(ends), dtype=np.int32), np.diff(ends, prepend=0))
    return who[: n - window + 1] == who[window - 1 :]


def _mixers() -> np.ndarray:
    return np.random.default_rng(5).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def signatures(shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A row of BANDS * ROWS minima for each section of the shingles; ``starts`` ascend, and a section ends where the next begins."""
    out = np.empty((len(starts), BANDS * ROWS), np.uint64)
    for k, a in enumerate(_mixers()):
        out[:, k] = np.minimum.reduceat(shingles * a, starts)
    return out


def _named(low: np.ndarray) -> list[int]:
    return [xxhash.xxh64_intdigest(low[k * ROWS : (k + 1) * ROWS].tobytes(), k) for k in range(BANDS)]


def bands_of(shingles: np.ndarray) -> list[int]:
    low = np.full(BANDS * ROWS, _MASK, np.uint64)
    for i in range(0, len(shingles), STEP):
        low = np.minimum(low, signatures(shingles[i : i + STEP], np.zeros(1, np.int64))[0])
    return _named(low)


def _lines(words: np.ndarray, ends: np.ndarray, breaks: np.ndarray, least: int, whole: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, end) of each line of ``least`` words or more, or of each whole text."""
    if whole:
        a, b, who = np.concatenate([[0], ends[:-1]]).astype(np.int64), ends, np.arange(len(ends))
    else:
        a, b = np.concatenate([[0], breaks[:-1]]).astype(np.int64), breaks
        who = np.searchsorted(ends, a, "right")
    ok = b - a >= least
    return who[ok], a[ok], b[ok]


def _bands(words: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[list[int]]:
    """The bands of each section [a, b) of the words; none where it is shorter than a shingle."""
    out: list[list[int]] = [[] for _ in a]
    ok = np.flatnonzero(b - a >= SHINGLE)
    i = 0
    while i < len(ok):
        j = i + 1
        while j < len(ok) and b[ok[j]] - a[ok[i]] <= STEP:
            j += 1
        part = ok[i:j]
        if j == i + 1:
            out[part[0]] = bands_of(shingle_hashes(words[a[part[0]] : b[part[0]]], SHINGLE))
        else:
            at = a[part[0]]
            s = shingle_hashes(words[at : b[part[-1]]], SHINGLE)
            # each section's own shingles, and a last section behind it of those that reach over its end
            cuts = np.stack([a[part] - at, np.minimum(b[part] - at - SHINGLE + 1, len(s))], axis=1).ravel()
            cuts = cuts[:-1] if cuts[-1] >= len(s) else cuts
            for p, low in zip(part, signatures(s, cuts)[::2]):
                out[p] = _named(low)
        i = j
    return out


def _chunks(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(place of the first, texts), of about CHUNK bytes in all; null is empty."""
    part: list[bytes] = []
    at = size = 0
    for i, t in enumerate(column.cast(pa.binary())):
        part.append(t.as_py() or b"")
        size += len(part[-1])
        if size >= CHUNK:
            yield at, part
            part, at, size = [], i + 1, 0
    if part:
        yield at, part


def _by_text(n: int, who: np.ndarray) -> pa.Array:
    """List offsets: ``who`` names, in ascending order, the text each value belongs to."""
    return pa.array(np.searchsorted(who, np.arange(n + 1)).astype(np.int32))


def _signed(x) -> pa.Array:
    return pa.array(np.asarray(x, dtype=np.uint64).view(np.int64))


_LINE = pa.struct([("line", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("bands", pa.list_(pa.int64()))])


def _read(docs: DataFrame, min_words: int, window: int, span: int, whole: bool = False) -> DataFrame:
    """(who, key, anchors, lines) of each text: the signatures of its sliding paragraphs, one for each run of equal ones, and its lines with
    their hashes, places, words and bands. With ``whole`` no anchors, the text is the only line, and fp is its SimHash fingerprint."""
    more = ["fp"] if whole else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _claimed()
        for b in batches:
            for first, texts in _chunks(b.column(2)):
                words, ends, breaks = tokenise(texts)
                low = np.zeros(0, np.uint64) if whole else minima(words, window, span)
                picked = np.zeros(0, np.int64)
                if len(low):
                    new = _inside(len(words), ends, window)
                    new[1:] &= (low[1:] != low[:-1]) | ~new[:-1]
                    picked = np.flatnonzero(new)
                anchors = pa.ListArray.from_arrays(_by_text(len(texts), np.searchsorted(ends, picked, "right")), _signed(low[picked]))
                who, a, z = _lines(words, ends, breaks, min_words, whole)
                bands = _bands(words, a, z)
                start = np.concatenate([[0], ends[:-1]])[who] if len(who) else a
                of = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, bands)]).astype(np.int32)), _signed([x for y in bands for x in y]))
                each = pa.StructArray.from_arrays(
                    [_signed([xxhash.xxh64_intdigest(words[i:j].tobytes(), 9) for i, j in zip(a.tolist(), z.tolist())]), pa.array((a - start).astype(np.int32)), pa.array((z - a).astype(np.int32)), of],
                    fields=list(_LINE),
                )
                lines = pa.ListArray.from_arrays(_by_text(len(texts), who), each)
                fps = [_signed([simhash64(t) for t in texts])] if whole else []
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(texts)), b.column(1).slice(first, len(texts)), anchors, lines, *fps], ["who", "key", "anchors", "lines", *more])
        release()

    return docs.select("_who", "_key", "text").mapInArrow(
        run, ", ".join(["who long, key long, anchors array<long>, lines array<struct<line: long, at: int, n: int, bands: array<long>>>", *(f"{c} long" for c in more)])
    )


def _again(docs: DataFrame, min_words: int, window: int, span: int, whole: bool = False) -> DataFrame:
    """(who, key, runs, lines): a second reading of the texts that have wanted anchors or lines, in columns of these names: for sliding paragraphs
    with a wanted anchor the hash of all their words and the place, and for wanted lines the set of shingle hashes, shortened to 32 bits."""
    runs = pa.struct([("run", pa.int64()), ("at", pa.int32())])
    sets = pa.struct([("line", pa.int64()), ("set", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _claimed()
        for b in batches:
            for first, texts in _chunks(b.column(2)):
                anchors, wanted = (b.column(k).slice(first, len(texts)) for k in (3, 4))
                words, ends, breaks = tokenise(texts)
                # an anchor that one text shares is wanted in each text of the chunk that has it
                shared = np.unique(anchors.flatten().to_numpy(zero_copy_only=False).view(np.uint64))
                picked = np.zeros(0, np.int64)
                if len(shared):
                    low = minima(words, window, span)
                    picked = np.flatnonzero(_inside(len(words), ends, window) & np.isin(low, shared)) if len(low) else picked
                who = np.searchsorted(ends, picked, "right")
                start = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                h = shingle_hashes(words, window)[picked] if len(picked) else np.zeros(0, np.uint64)
                found = pa.StructArray.from_arrays([_signed(h), pa.array((picked - start[who]).astype(np.int32))], fields=list(runs))
                ids = set(wanted.flatten().to_pylist())
                out: list[tuple[int, int, np.ndarray]] = []
                if ids:
                    done = set()
                    for i, x, z in zip(*(v.tolist() for v in _lines(words, ends, breaks, min_words, whole))):
                        line = xxhash.xxh64_intdigest(words[x:z].tobytes(), 9)
                        line -= (line >> 63) << 64
                        if line in ids and line not in done:
                            done.add(line)
                            out.append((i, line, np.unique(shingle_hashes(words[x:z], SHINGLE).astype(np.uint32)).view(np.int32)))
                every = pa.StructArray.from_arrays([pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.list_(pa.int32()))], fields=list(sets))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first, len(texts)), b.column(1).slice(first, len(texts)), pa.ListArray.from_arrays(_by_text(len(texts), who), found),
                     pa.ListArray.from_arrays(_by_text(len(texts), np.array([x[0] for x in out], np.int64)), every)],
                    ["who", "key", "runs", "lines"],
                )
        release()

    return docs.select("_who", "_key", "text", "anchors", "lines").mapInArrow(
        run, "who long, key long, runs array<struct<run: long, at: int>>, lines array<struct<line: long, set: array<int>>>"
    )


def _suspects(docs: DataFrame, wanted: DataFrame, min_words: int, window: int, span: int, whole: bool = False) -> DataFrame:
    """The second reading of those of ``docs`` (_who, _key, text) that ``wanted`` (who, key, anchors, lines) names."""
    w = wanted.select(F.col("who").alias("_who"), F.col("key").alias("_key"), "anchors", "lines")
    hit, _ = maybe_in(docs, w, "_who", "_key")
    return cut(_again(hit.select("_who", "_key", "text").join(w, ["_who", "_key"]), min_words, window, span, whole))


#: Lines of a block in which the lines of one band are compared with each other.
BLOCK = 256


def _links(alike: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Positions (i, j) that link whatever is linked by pairs of ``similarity`` or more; those marked ``alike`` are linked already."""
    n = len(sets)
    parent = np.arange(n)
    if alike.any():
        parent[alike] = np.flatnonzero(alike)[0]  # roots point at themselves, all others straight at their root
    size = np.array(list(map(len, sets)))
    words, ids = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(size)
    held = np.bincount(ids)[ids]
    weight = np.array([held[e - k : e].sum() for e, k in zip(ends, size)])
    out = []
    marked = np.zeros(len(words) + 1, np.int64)
    sums = np.zeros(len(ids) + 1, np.int64)
    rest = np.flatnonzero(~alike)
    for i in rest[np.argsort(-weight[rest], kind="stable")]:  # what shares most comes first: one such line may link all
        if (parent == parent[i]).all():
            continue
        mine = ids[ends[i] - size[i] : ends[i]]
        marked[mine] = 1
        np.cumsum(marked[ids], out=sums[1:])
        marked[mine] = 0
        both = sums[ends] - sums[ends - size]
        near = both / np.maximum(1, size + size[i] - both) >= similarity
        for j in np.flatnonzero(near & (parent != parent[i])):
            if parent[i] != parent[j]:
                parent[parent == parent[j]] = parent[i]
                out.append((int(i), int(j)))
    return out


def _settled(left: DataFrame, roots: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(line, rep): further links between the lines of each band that ``roots`` (node, root) doesn't hold as one class, exactly.

    In a band, the lines of its largest class are linked already; all others are compared with each other and with those. Bands are split into
    blocks of about BLOCK lines by a hash, and every block of other lines meets every block, so no task holds a whole band.
    """
    at = left.join(roots.select(F.col("node").alias("line"), "root"), "line", "left").select("band", "line", F.coalesce("root", "line").alias("root"))
    at = cut(at)
    held = at.groupBy("band", "root").agg(F.count("*").alias("k")).groupBy("band").agg(F.sum("k").alias("n"), F.max(F.struct("k", "root")).alias("s"))
    of = cut(held.where("n > s.k and n > 2").select("band", "n", (F.col("n") - F.col("s.k")).alias("n_unlike"), F.col("s.root").alias("main")))
    rows = join_split(at, of, "band").withColumn("alike", F.col("root") == F.col("main"))
    first = F.ceil(F.col("n_unlike") / BLOCK)
    every = first + F.ceil((F.col("n") - F.col("n_unlike")) / BLOCK)
    spot = F.xxhash64("line")
    rows = rows.withColumn("block", F.when(F.col("alike"), first + F.pmod(spot, every - first)).otherwise(F.pmod(spot, first)))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("alike"), first).otherwise(every) - 1)))
    rows = rows.select("band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "line", "alike").join(sets, "line")

    def link(g: pa.Table) -> pa.Table:
        lines, alike = g["line"].to_numpy(), g["alike"].to_numpy()
        pairs = _links(alike, [x.values.to_numpy() for x in g["set"]], similarity) if len(lines) > 1 else []
        i, j = np.array(pairs, np.int64).reshape(-1, 2).T
        return pa.table({"line": lines[i], "rep": lines[j]})

    return rows.select("band", "i", "j", "line", "alike", "set").groupBy("band", "i", "j").applyInArrow(link, "line long, rep long")


def _colliding(rows: DataFrame) -> DataFrame:
    """(band, line, rep) of the bands in which several lines meet, from different rows (band, line). rep is the line that has met most others in all of its
    bands, which of near copies of one text is the nearest to all."""
    shared = cut(rows.groupBy("band").agg(F.min("line").alias("low"), F.max("line").alias("high"), F.count("*").alias("n")).where("low <> high").select("band", "n"))
    met = cut(join_split(rows, shared, "band"))
    met = met.join(met.groupBy("line").agg(F.sum("n").alias("others")), "line")
    first = cut(met.groupBy("band").agg(F.max(F.struct("others", F.negative("line"), "line"))["line"].alias("rep"), F.count("*").alias("n")))
    return cut(join_split(met.select("band", "line"), first, "band").select("band", "line", "rep"))


def _banded(lines: DataFrame) -> DataFrame:
    return lines.select(F.explode("bands").alias("band"), "line").distinct()


#: Bits in which SimHash fingerprints of whole texts that are compared may differ.
RADIUS = 2


def _simhash_classes(read: DataFrame) -> DataFrame:
    """(band, line): the classes of texts whose SimHash fingerprints link, by vantage-point shards, in the form of bands. From (line, fp)."""
    rows = cut(read.select("line", "fp").distinct())
    fps = cut(rows.groupBy("fp").agg(F.count("*").alias("n")))
    roots = connected_components(near_edges(fps.select("fp"), RADIUS), "a", "b")
    named = cut(fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "n", F.coalesce("root", "fp").alias("root")))
    return join_split(rows, named, "fp").select(F.xxhash64(F.lit("simhash"), "root").alias("band"), "line")


def _alike(left: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(line, root) of lines that are linked, from colliding lines and the sets of all of them."""

    @F.arrow_udf(T.DoubleType())
    def jaccard(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a, b):
            x, y = x.values.to_numpy(zero_copy_only=False), y.values.to_numpy(zero_copy_only=False)
            n = len(np.intersect1d(x, y, assume_unique=True))
            out.append(n / max(1, len(x) + len(y) - n))
        return pa.array(out, pa.float64())

    met = left.where("line <> rep")
    pairs = met.select("line", "rep").distinct()
    # what many lines are compared with comes in as many copies as keeps each task's share small
    many = cut(pairs.groupBy("rep").agg(F.count("*").alias("n")).withColumn("copies", F.ceil(F.col("n") / SHARE)))
    pairs = join_split(pairs, many, "rep").withColumn("copy", F.pmod(F.xxhash64("line"), "copies"))
    reps = many.join(sets.withColumnsRenamed({"line": "rep", "set": "rep_set"}), "rep").select("rep", "rep_set", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    scored = cut(pairs.join(sets, "line").join(reps, ["rep", "copy"]).select("line", "rep", jaccard("set", "rep_set").alias("j")))
    roots = connected_components(scored.where(F.col("j") >= similarity), "line", "rep")
    more = cut(_settled(left.select("band", "line"), roots, sets, similarity))
    if not more.isEmpty():
        roots = connected_components(more.unionByName(roots.select(F.col("node").alias("line"), F.col("root").alias("rep"))), "line", "rep")
    return roots.select(F.col("node").alias("line"), "root")


#: Lines that are compared with one copy of their band's first.
SHARE = 1_000


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_who", F.coalesce(F.col("doc_id").cast("bigint"), F.lit((1 << 63) - 1))).withColumn("_key", null_safe_key("text"))


def similar_lines(docs: DataFrame, min_words: int = MIN_WORDS, similarity: float = SIMILARITY, whole: bool = False) -> DataFrame:
    """(line, root): components of lines whose shingle sets are alike, beside each one alone; of whole texts where ``whole`` is set.

    In a band, every line is compared with one of the band. Where that leaves several classes, the lines outside the largest are compared with all lines of the
    band, in blocks, so that each pair that meets in a band and is alike is linked. A band whose lines are of one class costs one comparison for each.
    """
    given = _keyed(docs).select("_who", "_key", "text")
    first = cut(_read(given, min_words, WINDOW, SPAN, whole=True) if whole else _read(given, min_words, WINDOW, SPAN))
    lines = first.select("who", "key", F.explode("lines").alias("l")).select("who", "key", "l.*")
    left = _colliding(_banded(lines))
    return _alike(left, _sets(given, lines, left, min_words, whole), similarity)


def _holders(lines: DataFrame, left: DataFrame) -> DataFrame:
    """(who, key, lines): for each colliding line one text that holds it, by text."""
    wanted = left.select("line").distinct()
    one = lines.join(wanted, "line", "left_semi").groupBy("line").agg(F.min(F.struct("who", "key")).alias("s"))
    return one.groupBy("s.who", "s.key").agg(F.collect_set("line").alias("lines"))


def _sets(given: DataFrame, lines: DataFrame, left: DataFrame, min_words: int, whole: bool) -> DataFrame:
    wanted = cut(_holders(lines, left).withColumn("anchors", F.array().cast("array<bigint>")))
    again = _suspects(given, wanted, min_words, WINDOW, SPAN, whole)
    return cut(again.select(F.explode("lines").alias("l")).select("l.*").dropDuplicates(["line"]))


def _copies(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(who, key, n) of each id and text with its rows, and (key, rep, n): the least id of each text that several ids hold and how many do."""
    pairs = cut(keyed.groupBy(F.col("_who").alias("who"), F.col("_key").alias("key")).agg(F.count("*").alias("rows")))
    many = cut(pairs.groupBy("key").agg(F.min("who").alias("rep"), F.count("*").alias("n")).where("n > 1"))
    return pairs, many


def _distinct_texts(keyed: DataFrame, copies: DataFrame) -> DataFrame:
    """``keyed`` without the rows that ``copies`` (who, key) names."""
    c = copies.select(F.col("who").alias("_who"), F.col("key").alias("_key"))
    hit, rest = maybe_in(keyed, c, "_who", "_key")
    return rest.unionByName(hit.join(c, ["_who", "_key"], "left_anti"))


def repeated_spans(keyed: DataFrame, min_words: int = MIN_WORDS, window: int = WINDOW, span: int = SPAN, similarity: float = SIMILARITY) -> DataFrame:
    """(who, key, a, b): word spans [a, b) that a document of smaller id holds too; the copies of a text have one of all words.

    ``keyed`` has _who (the id, by which the first holder is chosen), _key (of the row's text) and text.
    """
    # a text of fewer characters has no run of so many words
    keyed = keyed.where(F.length("text") >= 2 * min(window, min_words) - 1)
    pairs, many = _copies(keyed)
    copies = cut(join_split(pairs, many, "key").where("who > rep").select("who", "key"))
    texts = _distinct_texts(keyed, copies)
    first = cut(_read(texts, min_words, window, span))

    anchors = first.select("who", "key", F.explode("anchors").alias("anchor"))
    dup = cut(anchors.groupBy("anchor").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count("*").alias("n")).where("low <> high").select("anchor", "n"))
    by_anchor = join_split(anchors, dup, "anchor").groupBy("who", "key").agg(F.collect_set("anchor").alias("anchors"))

    lines = first.select("who", "key", F.explode("lines").alias("l")).select("who", "key", "l.*")
    left = _colliding(_banded(lines))
    wanted = by_anchor.join(_holders(lines, left), ["who", "key"], "full").select(
        "who", "key", *[F.coalesce(c, F.array().cast("array<bigint>")).alias(c) for c in ("anchors", "lines")]
    )
    again = _suspects(texts, cut(wanted), min_words, window, span)

    runs = again.select("who", "key", F.explode("runs").alias("r")).select("who", "key", "r.*")
    held = cut(runs.groupBy("run").agg(F.min("who").alias("first"), F.max("who").alias("last"), F.count("*").alias("n")).where("first < last").drop("last"))
    passages = join_split(runs, held, "run").where("who > first").select("who", "key", F.col("at").alias("a"), (F.col("at") + window).alias("b"))

    sets = cut(again.select(F.explode("lines").alias("l")).select("l.*").dropDuplicates(["line"]))
    roots = cut(_alike(left, sets, similarity))
    roots = roots.unionByName(roots.select(F.col("root").alias("line"), "root").distinct())  # a class's least line, too
    each = cut(lines.groupBy("line").agg(F.min("who").alias("first"), F.count("*").alias("n")).join(roots, "line"))
    top = each.groupBy("root").agg(F.min("first").alias("first"), F.sum("n").alias("n"))
    of = cut(join_split(each.select("line", "root", F.col("n").alias("of_line")), top, "root").select("line", "first", F.col("of_line").alias("n")))
    whole = join_split(lines.select("who", "key", "line", "at", F.col("n").alias("words")), of, "line").where("who > first")
    whole = whole.select("who", "key", F.col("at").alias("a"), (F.col("at") + F.col("words")).alias("b"))
    every = copies.select("who", "key", F.lit(0).alias("a"), F.lit(ALL).alias("b"))
    return passages.unionByName(whole).unionByName(every)


#: End of the span of a copy.
ALL = (1 << 31) - 1


def remove_spans(text: str, spans: list[tuple[int, int]]) -> tuple[str, int, int]:
    """The text without the words of the spans, and how many spans and characters that was; a blank line is not left."""
    lines, at, n_spans, gone = [], 0, 0, 0
    cuts: list[list[int]] = []
    for a, b in sorted(spans):
        if cuts and a <= cuts[-1][1]:
            cuts[-1][1] = max(b, cuts[-1][1])
        else:
            cuts.append([a, b])
    for line in text.split("\n"):
        raw = line.encode("utf-8")
        data = np.frombuffer(raw, np.uint8)
        inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
        edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])))).reshape(-1, 2)
        n = len(edges)
        out, last, hit = [], 0, False
        for a, b in cuts:
            a, b = max(a - at, 0), min(b - at, n)
            if a < b:
                out.append(raw[last : edges[a][0]])
                last, hit = (int(edges[b][0]) if b < n else len(raw)), True
        if hit:
            new = b"".join([*out, raw[last:]]).decode("utf-8").rstrip()
            if new:
                lines.append(new)
        else:
            lines.append(line)
        at += n
    new = "\n".join(lines)
    return new, len(cuts), len(text) - len(new)


def substring_dedup(docs: DataFrame, min_words: int = MIN_WORDS, window: int = WINDOW, span: int = SPAN, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with repeats cut from the texts, plus n_removed_spans and n_removed_chars.

    What repeats stays in the document of smallest doc_id that holds it and goes from the others: each word that lies in a run of ``window`` words
    which a document of smaller id holds, wherever it stands; and lines of ``min_words`` or more whose shingles are ``similarity`` alike, linked or
    not by others. Shorter repeats (boiler-plate lines, licences) and all other text stay untouched. Documents of one doc_id count as one; null
    ids come last, as one. Null and empty texts stay; every row comes back once, all columns kept; columns of the caller that are
    named n_removed_spans or n_removed_chars are replaced, those that begin with _ are not touched. n_chars, where there is one, follows the text. An
    empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    names = [c for c in docs.columns if c not in ("n_removed_spans", "n_removed_chars")]
    packed = docs.select("doc_id", "text", F.struct(*[c for c in names if c != "text"]).alias("_rest"))
    keyed = _keyed(packed)
    spans = repeated_spans(keyed.select("_who", "_key", "text"), min_words, window, span, similarity)
    per = cut(spans.groupBy(F.col("who").alias("_who"), F.col("key").alias("_key")).agg(F.collect_set(F.struct("a", "b")).alias("_spans")))

    @F.arrow_udf("text string, spans int, chars long")
    def clean(text: pa.Array, spans: pa.Array) -> pa.Array:
        cols: list[list] = [[], [], []]
        for t, s in zip(text, spans):
            t, s = t.as_py(), s.as_py()
            if t is None or not s:
                got = (t, 0, 0)
            elif any(x["b"] == ALL for x in s):  # a copy, if it has so many words
                got = ("", 1, len(t)) if len(t.encode("utf-8").split()) >= window else (t, 0, 0)
            else:
                got = remove_spans(t, [(x["a"], x["b"]) for x in s])
            for col, v in zip(cols, got):
                col.append(v)
        kinds = (pa.string(), pa.int32(), pa.int64())
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["text", "spans", "chars"])

    hit, rest = maybe_in(keyed, per, "_who", "_key")
    done = hit.join(per, ["_who", "_key"], "left").withColumn("_new", clean(F.col("text"), F.col("_spans")))
    done = done.select("_rest", F.col("_new.text").alias("text"), F.col("_new.spans").alias("n_removed_spans"), F.col("_new.chars").alias("n_removed_chars"))
    whole = rest.select("_rest", "text", F.lit(0).alias("n_removed_spans"), F.lit(0).cast("bigint").alias("n_removed_chars"))

    def value(c: str):
        if c == "text":
            return F.col(c)
        if c == "n_chars":
            return F.when(F.col("n_removed_spans") > 0, F.length("text").cast(docs.schema[c].dataType)).otherwise(F.col(f"_rest.`{c}`")).alias(c)
        return F.col(f"_rest.`{c}`").alias(c)

    return done.unionByName(whole).select(*map(value, names), "n_removed_spans", "n_removed_chars")


def deduplicate(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each class of near copies: that of the smallest doc_id (nulls count as the largest), among rows of one
    id the text of smallest hash. All columns stay, whatever their names.

    Texts are linked whose shingles of SHINGLE words are ``similarity`` alike, by exact comparison of those that meet, and texts of equal
    words; a class is what links reach. Texts meet in a class of SimHash fingerprints (three words, RADIUS bits; the pivots of query 6) and, as
    fingerprints of texts less alike are further apart than pivots can tell, in a band of MinHash too. Texts without words, null ones too, are equal. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    packed = docs.select("doc_id", "text", F.struct(*[c for c in docs.columns if c != "text"]).alias("_rest"))
    keyed = _keyed(packed)
    given = keyed.select("_who", "_key", "text")
    pairs, many = _copies(given)
    copies = cut(join_split(pairs, many, "key").where("who > rep").select("who", "key"))
    texts = _distinct_texts(given, copies)
    read = cut(_read(texts, 0, WINDOW, SPAN, whole=True).select("who", "key", "fp", F.explode("lines").alias("l")).select("who", "key", "fp", "l.*"))
    left = _colliding(_banded(read).unionByName(_simhash_classes(read)))
    roots = _alike(left, _sets(texts, read, left, 0, True), similarity)
    each = cut(read.groupBy("line").agg(F.min(F.struct("who", "key")).alias("s"), F.count("*").alias("n")).join(roots, "line", "left").withColumn("root", F.coalesce("root", "line")))
    top = each.groupBy("root").agg(F.min("s").alias("best"), F.sum("n").alias("n"))
    of = cut(join_split(each.select("line", "root", F.col("n").alias("of_line")), top, "root").select("line", "best", F.col("n").alias("texts"), F.col("of_line").alias("n")))
    state = join_split(read.select("who", "key", "line"), of, "line").select("who", "key", (F.struct("who", "key") == F.col("best")).alias("keep"), (F.col("texts") > 1).alias("known"))
    state = state.distinct().join(pairs, ["who", "key"]).where("known or rows > 1").select("who", "key", "keep")
    state = cut(state.unionByName(copies.withColumn("keep", F.lit(False))).withColumnsRenamed({"who": "_who", "key": "_key"}))
    hit, rest = maybe_in(keyed, state, "_who", "_key")
    one = Window.partitionBy("_who", "_key").orderBy(F.lit(1))
    hit = hit.join(state, ["_who", "_key"], "left").where(F.coalesce("keep", F.lit(True)))
    lone = hit.where("keep is null").drop("keep")
    kept = hit.where("keep").withColumn("_i", F.row_number().over(one)).where("_i = 1").drop("_i", "keep")
    every = rest.unionByName(lone).unionByName(kept)
    return every.select(*[F.col("text") if c == "text" else F.col(f"_rest.`{c}`").alias(c) for c in docs.columns])
