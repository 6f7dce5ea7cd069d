"""Pinned behaviour of single functions."""

import datetime

import pytest
from pyspark.sql import functions as F

from lumenql.functions import datetimes, dialect, jsons, strings
from lumenql.operators import changes, recursive, relational


def one(spark, col, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(col.alias("x")).first()[0]


@pytest.mark.parametrize(("args", "want"), [((2, 1), "b"), ((2,), "bcdefg"), ((0, 2), "a"), ((-2, 1), "f"), ((3, -2), "ab"), ((1, -1), ""), ((-1, -2), "ef"), ((20, -1), ""), ((-100, 98), "abcde"), ((-5, -3), "ab"), ((5, -5), "abcd")])
def test_substr(spark, args, want):
    got = one(spark, dialect.substr(F.col("s"), *args), s="abcdefg")
    assert got == want


def test_prefix_cast(spark):
    for text, want in ((" 876xyz", 876), ("456 abc", 456), ("none", 0), ("-3", -3)):
        assert one(spark, dialect.prefix_integer(F.col("s")), s=text) == want
    assert one(spark, dialect.prefix_real(F.col("s")), s="1.5e2x") == 150.0


def test_unhex_quote_glob(spark):
    assert one(spark, dialect.unhex(F.lit("61-62"), "-")) == bytearray(b"ab")
    assert one(spark, dialect.unhex(F.lit("6G"))) is None
    assert one(spark, dialect.quote(F.lit("it's"))) == "'it''s'"
    assert one(spark, dialect.glob(F.lit("abc"), "a[^x]?")) is True
    assert one(spark, dialect.glob(F.lit("ABC"), "a*")) is False


def test_distances():
    assert strings.osa_distance("ca", "abc") == 3
    assert strings.damerau_distance("ca", "abc") == 2
    assert round(strings.jaro_winkler_similarity("MARTHA", "MARHTA"), 4) == 0.9611
    assert strings.common_prefix("abc", "abd") == 2


def test_dates(spark):
    ts = F.lit(datetime.datetime(2004, 2, 29, 18, 16, 0)).cast("timestamp")
    assert one(spark, datetimes.strftime("%Y-%m-%d %j %w %u %p %l", ts)) == "2004-02-29 060 0 7 PM  6"
    assert one(spark, datetimes.julianday(F.lit("2000-01-01 12:00:00").cast("timestamp"))) == 2451545.0
    assert one(spark, F.date_format(datetimes.modify(F.lit("2023-01-31 00:00:00").cast("timestamp"), "+1 month"), "yyyy-MM-dd")) == "2023-03-03"


def test_json(spark):
    j = F.lit('{"a":1,"b":[1,[2,3],4],"c":99}')
    assert one(spark, jsons.json_extract(j, "$.b[#-1]")) == "4"
    assert one(spark, jsons.json_remove(j, "$.b[0]", "$.b[0]")) == '{"a":1,"b":[4],"c":99}'
    assert one(spark, jsons.json_set(j, "$.b[#]", 5)) == '{"a":1,"b":[1,[2,3],4,5],"c":99}'
    assert one(spark, jsons.json_insert(j, "$.a", 5)) == '{"a":1,"b":[1,[2,3],4],"c":99}'
    assert one(spark, jsons.json_patch(j, {"a": None, "d": {"e": 1}})) == '{"b":[1,[2,3],4],"c":99,"d":{"e":1}}'


def test_changes(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], ["k", "v"])
    u = spark.createDataFrame([(2, "x"), (3, "c"), (4, "d")], ["k", "v"])
    v = spark.createDataFrame([(1, "a"), (4, "e")], ["k", "v"])
    first, second = changes.diff(t, u, ["k"]), changes.diff(u, v, ["k"])
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(changes.apply(t, changes.concat(first, second, ["k"]), ["k"])) == [(1, "a"), (4, "e")]
    assert rows(changes.apply(u, changes.invert(first), ["k"])) == [(1, "a"), (2, "b"), (3, "c")]


def test_fixpoint(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 6)], ["a", "b"])
    seed = spark.createDataFrame([(1,)], ["n"])
    got = recursive.fixpoint(seed, [lambda f: f.join(e, f.n == e.a).select(F.col("b").alias("n"))])
    assert sorted(r[0] for r in got.collect()) == [1, 2, 3]


def test_null_keeping_json_array(spark):
    df = spark.createDataFrame([(1, 1), (2, None), (3, 3)], ["o", "x"])
    assert df.agg(relational.json_group_array(F.col("x"), F.col("o"))).first()[0] == "[1,null,3]"


@pytest.mark.parametrize("held", [20_000, 7])
def test_ann_finds_what_its_definition_says(spark, monkeypatch, held):
    """Copies, vectors without an element or an end, of another length, missing ones, and ids that come twice."""
    import random

    from pyspark.sql import Window

    from lumenql.functions import vectors

    rnd, nan, inf = random.Random(3), float("nan"), float("inf")
    some = [[rnd.gauss(0, 1) for _ in range(8)] for _ in range(300)]
    some[40:60] = [some[1]] * 20
    some[70:77] = [[1.0], None, [nan] * 8, [1.0, None] * 4, [inf] + [0.0] * 7, [], [1e30] * 8]
    t = spark.createDataFrame([*enumerate(some), (5, some[9]), (None, some[10])], "id long, v array<float>")
    q = t.where("id % 7 = 0 or id between 68 and 78 or id is null")

    centres = t.orderBy(F.xxhash64("id"), "id").limit(6).agg(F.collect_list(F.struct("id", "v")).alias("cs"))
    far = lambda v: F.array_sort(F.transform("cs", lambda x: F.struct(vectors.l2_distance(v, x["v"]).alias("d"), x["id"].alias("c"))))
    rows = t.crossJoin(centres).select("id", "v", F.get(far(F.col("v")), F.lit(0))["c"].alias("list"))
    asks = q.crossJoin(centres).select(F.col("id").alias("query"), F.col("v").alias("qv"), F.explode(F.slice(far(F.col("v")), 1, 4)["c"]).alias("list"))
    plain = asks.join(rows, "list").select("query", "id", vectors.l2_distance(F.col("v"), F.col("qv")).alias("distance"))
    plain = plain.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("distance", "id"))).where("rank <= 10")

    monkeypatch.setattr(vectors, "_HELD", held)
    got = vectors.ivf_search(t, q, "id", "v", 10, 6, 4)
    shown = lambda d: sorted(str(tuple(r)) for r in d.select("query", "id", "distance", "rank").collect())
    assert shown(got) == shown(plain)
    assert got.schema["id"].dataType == plain.schema["id"].dataType


def test_ann_looks_at_pairs_in_blocks():
    """No row for each pair: fifty thousand rows against a thousand queries in seconds, in pieces of bounded size."""
    import time

    import numpy as np
    import pyarrow as pa

    from lumenql.functions import vectors

    rng = np.random.default_rng(0)
    batch = lambda n, passes, at: pa.record_batch({"passes": pa.array([passes] * n), "id": np.arange(at, at + n), "lists": pa.array([[0]] * n), "v": pa.array(list(rng.normal(size=(n, 16)).astype(np.float32)))})
    asks, rows = batch(1000, False, 0), [batch(10_000, True, k * 10_000) for k in range(5)]
    began = time.time()
    (got,) = vectors._nearest(iter([asks, *rows]), 10, 16)
    assert time.time() - began < 30 and got.num_rows == 10_000
    a = np.array(asks.column("v").to_pylist()[17])
    v = np.concatenate([np.array(r.column("v").to_pylist()) for r in rows])
    assert got.column("id").to_pylist()[170:180] == np.argsort(((v - a) ** 2).sum(axis=1), kind="stable")[:10].tolist()
