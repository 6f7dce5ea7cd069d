"""Queries against their SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from lumenql.plans import catalogue

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in catalogue.TABLES:
        p = f"{D}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_equals_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, D)
    want = duck.sql(catalogue.ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda cols, rs: sorted(tuple(plain(x) for _, x in sorted(zip(cols, r))) for r in rs)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, D).count() > 0


def test_ann_recall(spark):
    from lumenql.functions import vectors

    e = catalogue.read(spark, D, "embeddings")
    found = {(r["query"], r["id"]) for r in catalogue.QUERIES["vec_ann"](spark, D).collect()}
    hit = n = 0
    for q in e.where("vec_id % 50 = 0").collect():
        for r in vectors.nearest(e, "vec_id", "embedding", q["embedding"], 10, vectors.l2_distance).collect():
            hit += (q["vec_id"], r["vec_id"]) in found
            n += 1
    assert hit / n >= 0.9


def test_closure_of_all_edges(spark):
    e = catalogue.read(spark, D, "lineitem").select("l_partkey", "l_suppkey").distinct().collect()
    seen, new = set(), {1}
    while new:
        seen |= new
        suppliers = {r["l_suppkey"] for r in e if r["l_partkey"] in new}
        new = {r["l_partkey"] for r in e if r["l_suppkey"] in suppliers} - seen
    assert sorted(r["p"] for r in catalogue.QUERIES["cte_recursive_union_closure_all"](spark, D).collect()) == sorted(seen)


def test_base64_of_long_urls(spark, tmp_path):
    import base64
    from urllib.parse import quote_plus

    urls = ["http://a.b/" + "x?y=\u00e9 " * n for n in (0, 5, 12, 200)] + ["", None]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: (r["b"], r["u"]) for r in catalogue.QUERIES["enc_base64_url_all"](spark, str(tmp_path)).collect()}
    assert got == {i: (None, None) if u is None else (base64.b64encode(u.encode()).decode(), quote_plus(u)) for i, u in enumerate(urls)}


def test_overlap_of_all_boxes(spark, tmp_path):
    catalogue.read(spark, D, "lineitem").where("l_orderkey % 20 = 0").write.parquet(f"{tmp_path}/lineitem.parquet")
    boxes = catalogue._boxes(spark, str(tmp_path), "IS NOT NULL").collect()
    want = sorted((a["id"], b["id"]) for a in boxes for b in boxes if a["id"] < b["id"] and a["x0"] <= b["x1"] and b["x0"] <= a["x1"] and a["y0"] <= b["y1"] and b["y0"] <= a["y1"])
    assert want and sorted(map(tuple, catalogue.QUERIES["rtree_overlap_all"](spark, str(tmp_path)).collect())) == want


@pytest.mark.parametrize("last", ["2024-01-30 23:59:25.5", "2024-01-30 23:59:26.5", "2024-07-30 23:59:25.499999", "2024-07-30 23:59:25.500001", "1969-12-31 23:59:58.5", "2024-03-31 02:30:00", None])
@pytest.mark.parametrize("zone", ["UTC", "Europe/Berlin"])
def test_lag_counts_whole_seconds_as_its_sql_does(spark, tmp_path, last, zone):
    to = f"{tmp_path}/events.parquet"
    spark.sql("SELECT v.ts FROM VALUES (TIMESTAMP_NTZ'1960-01-01 00:00:00.1'), (NULL) AS v(ts)" if last is None else f"SELECT TIMESTAMP_NTZ'{last}' AS ts").where("ts IS NULL" if last is None else "true").write.parquet(to)
    ((want,),) = duckdb.sql(catalogue.ORACLE["stream_lag"].replace("events", f"'{to}/*.parquet'")).fetchall()
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        assert [tuple(r) for r in catalogue.QUERIES["stream_lag"](spark, str(tmp_path)).collect()] == [(want,)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_entry_imports_without_a_session():
    """The driver imports the entry before it starts Spark."""
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=root, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    n, with_sql = map(int, said.stdout.split()[-2:])
    assert n >= with_sql > 200
