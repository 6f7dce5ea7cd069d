"""Operators against plain versions, and their errors."""

import random

import pytest
from pyspark.sql import functions as F

from lumenql.functions import jsontext, numbers, strings
from lumenql.operators import changes, relational, search, tables, windows
from lumenql.streaming import changelog


def test_bare_maximum_of_text(spark):
    df = spark.createDataFrame([("g", "b", 1), ("g", "c", 3), ("g", "c", 2), ("g", None, 4)], "g string, x string, k int")
    assert df.groupBy("g").agg(relational.bare_max(F.col("x"), F.col("k"), of=F.col("k")).alias("k")).first()["k"] == 2


@pytest.mark.parametrize("partitions", ["1", "5"])
def test_percentiles(spark, partitions):
    r = random.Random(4)
    rows = [(g, r.choice([1.0, 2.0, 2.5, 7.0, r.random() * 50])) for g in ("a", "b", None) for _ in range(57)] + [("empty", None), ("one", 3.0), ("a", float("nan"))]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    got = {x["g"]: x for x in relational.percentiles(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", {"q": 25, "m": 50, "t": 99}).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", before)
    for g in {k for k, _ in rows}:
        values = sorted(x for k, x in rows if k == g and x is not None and x == x)
        for name, p in (("q", 25), ("m", 50), ("t", 99)):
            if not values:
                assert got[g][name] is None
                continue
            at = p / 100 * (len(values) - 1)
            low = int(at)
            want = values[low] + (values[min(low + 1, len(values) - 1)] - values[low]) * (at - low)
            assert abs(got[g][name] - want) < 1e-9
    with pytest.raises(ValueError):
        relational.percentiles(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", {"q": 101})


@pytest.mark.parametrize(("missing", "wrong", "end"), [([], [], None), ([50], [], 50), ([], [9000], 9000), ([4095], [], 4095), ([4096], [], 4096), (range(4096, 8192), [], 4096), (range(5000, 9000), [8900, 9100], 5000), ([9999], [], 9999), ([0], [], None)])
def test_verified_log(spark, missing, wrong, end):
    rows = spark.range(10_000).where(~F.col("id").isin([int(i) for i in missing] or [-1])).withColumn("p", F.col("id").cast("string"))
    rows = rows.withColumn("c", F.crc32(F.col("p").cast("binary")) + F.col("id").isin(wrong or [-1]).cast("int"))
    got = changelog.verified(rows, "id", "p", "c").agg(F.max("id"), F.count("*")).first()
    last = 10_000 if end is None else end
    assert got[1] == last - sum(i < last for i in missing)


def test_base85_round_trip():
    r = random.Random(5)
    for n in [0, 1, 2, 3, 4, 5, 63, 64, 65, 150, 1054]:
        data = bytes(r.randrange(256) for _ in range(n))
        text = strings.encode85(data)
        assert strings.decode85(" " + text) == data and strings.is_85(text) and all(len(line) <= 80 for line in text.split("\n"))


def test_order_keys():
    r, keys = random.Random(6), []
    for _ in range(400):
        i = r.randint(0, len(keys))
        keys.insert(i, changes.key_between(keys[i - 1] if i else None, keys[i] if i < len(keys) else None))
    assert keys == sorted(set(keys))
    with pytest.raises(ValueError):
        changes.key_between("B", "A")


@pytest.mark.parametrize(("text", "at"), [("", 1), ("{", 2), ('{"a"}', 5), ("[1,]x", 5), ("tru", 1), ('"a', 1), ("[1 2]", 4), ("{} {}", 4), ("[" * 1001, 1001)])
def test_json_errors(text, at):
    assert jsontext._position(text) == at


def test_json5_and_strict():
    assert jsontext.minified("[.5, +1, 0x1F, -Infinity, 'a\\'b', \"\\x41\", ] // end") == '[0.5,1,31,-9e999,"a\'b","A"]'
    for text in ("[1,]", "{a:1}", "'x'", "+1", "01", "[1]//c"):
        assert jsontext._position(text, json5=False) > 0


@pytest.mark.parametrize("query", ["", "(a", "a AND", "NEAR(a b", "x : ", "{q} : a", "a )", '"open'])
def test_query_errors(spark, query):
    with pytest.raises(ValueError):
        search.matches({"c": F.col("c")}, query)


def test_query_precedence(spark):
    """NOT binds tighter than AND, AND tighter than OR; words side by side are an AND."""
    texts = ["a", "a b", "a c", "b c", "a b c", "c"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    has = lambda t, w: w in t.split()
    for query, want in {
        "a OR b AND c": lambda t: has(t, "a") or has(t, "b") and has(t, "c"),
        "a b NOT c": lambda t: has(t, "a") and has(t, "b") and not has(t, "c"),
        "a NOT b OR c": lambda t: has(t, "a") and not has(t, "b") or has(t, "c"),
        "(a OR b) c": lambda t: (has(t, "a") or has(t, "b")) and has(t, "c"),
        '"b c" OR ^c': lambda t: "b c" in t or t.startswith("c"),
        "NEAR(a c, 0)": lambda t: t == "a c",
        "NEAR(a c, 1)": lambda t: has(t, "a") and has(t, "c"),
    }.items():
        got = {r["t"] for r in df.where(search.matches({"t": F.col("t")}, query)).collect()}
        assert got == {t for t in texts if want(t)}, query


def test_store_errors_and_savepoints(spark):
    one = spark.createDataFrame([(1, "x")], "k int, v string")
    s = tables.Store().create("p", one, key=("k",), not_null=("v",)).create("c", spark.createDataFrame([(7, 1)], "id int, k int"), key=("id",), foreign={"k": ("p", "k", "restrict")})
    for run in (
        lambda: s.insert("p", one), lambda: s.insert("p", spark.createDataFrame([(2, None)], "k int, v string")), lambda: s.delete("p", F.lit(True)),
        lambda: s.insert("c", spark.createDataFrame([(8, 9)], "id int, k int")), lambda: s.drop_column("p", "k"), lambda: s.create("x", one, checks={"t": "k < rand()"}),
    ):
        with pytest.raises(tables.ConstraintError):
            run()
    for run in (s.rollback, lambda: s.release("a"), lambda: s.savepoint("b").rollback("a")):
        with pytest.raises(ValueError):
            run()
    t = s.savepoint("a").insert("p", spark.createDataFrame([(2, "y")], "k int, v string"))
    assert t["p"].count() == 2 and t.rollback("a")["p"].count() == 1 and t.release("a").marks == ()
    nulled = tables.Store().create("p", one, key=("k",)).create("c", spark.createDataFrame([(7, 1)], "id int, k int"), foreign={"k": ("p", "k", "set null")}).delete("p", F.lit(True))
    assert nulled["c"].first()["k"] is None


def test_rounding_is_on_decimal_text(spark):
    r = random.Random(7)
    from decimal import ROUND_HALF_UP, Decimal

    rows = [(r.choice([-1, 1]) * round(r.random() * 10 ** r.randint(0, 5), r.randint(0, 8)), r.randint(0, 6)) for _ in range(500)]
    got = spark.createDataFrame([(float(x), n) for x, n in rows], "x double, n int").select("x", "n", numbers.round_half_away(F.col("x"), F.col("n")).alias("r")).collect()
    for row in got:
        assert row["r"] == float(Decimal(repr(row["x"])).quantize(Decimal(1).scaleb(-row["n"]), ROUND_HALF_UP)), row


@pytest.mark.parametrize("what", ["no others", "current row", "group", "ties"])
def test_rows_frame_with_exclusion(spark, what):
    r = random.Random(8)
    rows = [(i, r.choice("ab"), r.randrange(4), r.randrange(100)) for i in range(60)]
    got = windows.rows_excluding(spark.createDataFrame(rows, "i int, p string, o int, x int"), ["p"], ["o"], ["i"], -2, 3, "x", what, lambda a: F.array_join(F.array_sort(a), ","), "got")
    got = {x["i"]: x["got"] for x in got.collect()}
    for part in "ab":
        mine = sorted((x for x in rows if x[1] == part), key=lambda x: (x[2], x[0]))
        for at, row in enumerate(mine):
            left = []
            for k in range(max(0, at - 2), min(len(mine), at + 4)):
                peer = mine[k][2] == row[2]
                out = {"no others": False, "current row": k == at, "group": peer, "ties": peer and k != at}[what]
                if not out:
                    left.append(mine[k][3])
            assert got[row[0]] == ",".join(map(str, sorted(left)))


def test_overlap_of_boxes_of_all_sizes(spark):
    """Against SQL: points, large, empty and inverted boxes, ones without an edge or an end, several of one id or without one."""
    import random

    import duckdb
    import pandas as pd

    from lumenql.operators import search

    rnd, nan, inf = random.Random(5), float("nan"), float("inf")
    sides = lambda w: (x := rnd.choice([rnd.uniform(-40, 40), float(rnd.randint(-10, 10) * 4)]), x + w)
    wide = lambda: rnd.choice([0, 0, 1, 2, 3.9, 4, 8, 33, 1e6, 1e12, -1, -9])
    make = lambda n: [(rnd.choice([None, *range(n)]), *sides(wide()), *sides(wide())) for _ in range(n)]
    odd = [(1, None, 1.0, 0.0, 1.0), (2, nan, nan, 0.0, 9.0), (3, -inf, inf, -5.0, 5.0), (4, 0.0, nan, -inf, 0.0), (5, 1.0, inf, nan, nan), (6, 1e300, 1e300, 1e300, 1e305)]
    kind = "id long, x0 double, x1 double, y0 double, y1 double"
    for a, b in ((make(300), make(400)), (make(60) + odd, make(60) + odd), (make(5), []), ([(1, 0.0, 1.0, 0.0, 1.0)], [(2, -1e13, 1e13, 0.0, 1.0)])):
        c = duckdb.connect()
        for name, rows in (("a", a), ("b", b)):
            c.execute(f"CREATE TABLE {name} (id BIGINT, x0 DOUBLE, x1 DOUBLE, y0 DOUBLE, y1 DOUBLE)")
            if rows:
                c.executemany(f"INSERT INTO {name} VALUES (?, ?, ?, ?, ?)", rows)
        want = c.execute("SELECT a.id, b.id FROM a JOIN b ON a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1").fetchall()
        order = lambda rs: sorted(rs, key=lambda r: tuple((x is None, x or 0) for x in r))
        got = lambda once: order(map(tuple, search.overlap_join(spark.createDataFrame(a, kind), spark.createDataFrame(b, kind), 4.0, once).collect()))  # noqa: E731, B023
        assert got(False) == order(want)
        assert got(True) == order(r for r in want if None not in r and r[0] < r[1])


def test_overlap_is_spread_and_looks_at_few_pairs(spark, monkeypatch):
    """However small the tables, the pairs come from many tasks; a cell is looked at in pieces."""
    import numpy as np

    from lumenql.operators import search

    t = spark.range(2000).selectExpr("id", "id % 50 * 1.0 AS x0", "id % 50 + 2.0 AS x1", "id % 97 * 1.0 AS y0", "id % 97 + 1.0 AS y1")
    got = search.overlap_join(t, t, 4.0, once=True)
    assert got.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
    n = 3000
    y = np.sort(np.random.default_rng(1).uniform(0, 4, n))
    rows = {"own": np.zeros(n, np.int32), "id": np.arange(n), "known": np.ones(n, bool), "x0": np.zeros(n), "x1": np.ones(n), "y0": y, "y1": y + 0.1}
    sizes = [b.num_rows for b in search._meet(rows, rows, 0, False)]
    assert sum(sizes) == (np.abs(y[:, None] - y) <= 0.1).sum() and max(sizes) <= 2 * search._PAIRS


def test_overlap_writes_pairs_in_runs(spark, tmp_path):
    """Pairs of a row of b follow each other, so that a large result takes little disk."""
    from lumenql.operators import search

    t = spark.range(20000).selectExpr("xxhash64(id) AS id", "id * 7919 % 50 * 1.0 AS x0", "id * 7919 % 50 + 2.0 AS x1", "id * 104729 % 9973 / 200 AS y0", "id * 104729 % 9973 / 200 + 1 AS y1")
    search.overlap_join(t.where("xxhash64(id, 1) % 3 = 0"), t, 4.0).write.parquet(f"{tmp_path}/out")
    rows = spark.read.parquet(f"{tmp_path}/out").count()
    assert rows > 500_000 and sum(f.stat().st_size for f in tmp_path.glob("out/*.parquet")) < 2.2 * rows


def test_window_function_of_a_user_is_called_by_batches(spark):
    """Values that aren't positive and missing ones don't count; frames without any give null. One call sees many rows: fifty thousand in seconds."""
    import math
    import time

    import pyarrow as pa
    from pyspark.sql import Window

    xs = [None, 0.0, -1.0, 2.0, 8.0, float("nan"), None, None, None, 4.0, float("inf"), 1e-300, 1e300]
    t = spark.createDataFrame([(g, i, x) for g in (1, None) for i, x in enumerate(xs)], "g int, i int, x double")
    w = Window.partitionBy("g").orderBy("i").rowsBetween(-2, 0)
    got = {(r["g"], r["i"]): r["m"] for r in t.select("g", "i", relational.geometric_mean()(F.collect_list("x").over(w)).alias("m")).collect()}
    for i in range(len(xs)):
        logs = [math.log(x) for x in xs[max(0, i - 2) : i + 1] if x is not None and x > 0]
        want = math.exp(sum(logs) / len(logs)) if logs else None
        assert all(got[g, i] == (want if want is None else pytest.approx(want, rel=1e-12)) for g in (1, None)), i

    run = relational.geometric_mean().func
    assert run(pa.array([[], None, [1.0, 4.0], [9.0], []]).slice(1)).to_pylist() == pytest.approx([None, 2.0, 9.0, None])
    began = time.time()
    n = spark.range(50_000).selectExpr("id", "id % 500 AS g", "id + 1.0D AS x").select(relational.geometric_mean()(F.collect_list("x").over(Window.partitionBy("g").orderBy("id").rowsBetween(-2, 0))).alias("m")).where("m > 0").count()
    assert n == 50_000 and time.time() - began < 60
