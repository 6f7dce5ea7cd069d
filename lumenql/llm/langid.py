"""Language identification by compression with per-language raw-content dictionaries."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bounds of the sample: documents drawn for each language, and bytes of each dictionary.
SAMPLE_DOCS = 400
DICT_BYTES = 96_000
PER_DOC = 1_500
LEVEL = 3


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, dict_bytes: int = DICT_BYTES) -> dict[str, bytes]:
    """{language: dictionary} from a bounded sample, alike for every language.

    Counts of all rows give each language's share; rows are drawn by a hash of the text, so that
    about ``sample_docs`` for each language, and at most twice as many, come to the driver, each with
    a slice of ``PER_DOC`` characters from its middle. Rows of null language or text teach nothing.
    """
    good = docs.where(F.col(lang_col).isNotNull() & (F.length(text_col) > 0))
    counts = {r[0]: r[1] for r in good.groupBy(lang_col).count().collect()}
    out: dict[str, bytes] = {}
    if not counts:
        return out
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, int(min(1.0, 1.5 * sample_docs / n) * (1 << 30)))])
    drawn = good.where(F.pmod(F.xxhash64(text_col), F.lit(1 << 30)) < share[F.col(lang_col)])
    n = F.length(text_col)
    part = F.substring(F.col(text_col), F.greatest(F.lit(1), F.floor((n - PER_DOC) / 2).cast("int")), F.lit(PER_DOC))
    rows = drawn.select(F.col(lang_col).alias("l"), part.alias("t"), F.xxhash64(text_col).alias("h")).distinct().limit(2 * sample_docs * len(counts)).collect()
    for lang in sorted(counts):
        texts = [r["t"] for r in sorted((r for r in rows if r["l"] == lang), key=lambda r: (r["h"], r["t"]))]
        data = "\n".join(texts).encode()
        out[lang] = data[-dict_bytes:]
    return out


def predict(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = 0.005, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and rejected; columns of the caller with these names are replaced.

    Every whole text is compressed once with each dictionary; the language that leaves the fewest
    bytes is chosen, of equal ones the first by name. score is the runner-up's excess over it, from 0 to 1 (1 with one language
    only). rejected: the score is below ``margin``. Null text, or text without a letter, is ``und`` with score 0,
    rejected. The dictionaries, of bounded size, are broadcast.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(dictionaries)
    docs = docs.drop("lang_pred", "score", "rejected")
    names = [f.name for f in docs.schema]
    at = names.index(text_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = []
        for lang, data in sorted(shared.value.items()):
            d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            tools.append((lang, zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False)))
        for b in batches:
            langs, scores = [], []
            for t in b.column(at):
                t = t.as_py()
                if not t or not tools or not any(map(str.isalpha, t)):
                    langs.append("und")
                    scores.append(0.0)
                    continue
                raw = t.encode()
                sizes = sorted((len(c.compress(raw)), lang) for lang, c in tools)
                langs.append(sizes[0][1])
                scores.append(1.0 if len(sizes) == 1 else 1 - sizes[0][0] / sizes[1][0])
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array([s < margin for s in scores], pa.bool_())],
                [*names, "lang_pred", "score", "rejected"],
            )

    return docs.mapInArrow(run, f"{schema}, lang_pred string, score double, rejected boolean")
