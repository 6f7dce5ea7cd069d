"""All queries of the catalogue, with their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dialect, jsons, strings, vectors
from ..functions import datetimes as dt
from ..operators import changes, recursive, relational, search, windows
from ..sources import readers
from ..streaming import changelog

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers a query by its function's name."""

    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return keep


def sql(name: str, text: str, oracle: str | None = None) -> None:
    """Registers a query that Spark SQL runs as it stands; the oracle is the same text unless it is given."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        used = {t: read(spark, d, t) for t in TABLES if f"{{{t}}}" in text}
        return spark.sql(text, **used)

    run.__name__ = name
    query(oracle or text.format(**{t: t for t in TABLES}))(run)


# --- scans and predicates ------------------------------------------------------------------

sql("scan_filter_project", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS revenue FROM {lineitem} WHERE l_shipdate >= TIMESTAMP '1995-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1996-01-01 00:00:00' AND l_quantity < 24")
sql("scan_covering", "SELECT c_mktsegment, count(*) AS n FROM {customer} GROUP BY c_mktsegment")
sql("scan_range_search", "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_orderkey BETWEEN 100 AND 900 AND o_orderstatus = 'F'")
sql("scan_partial_index", "SELECT s_suppkey, s_acctbal FROM {supplier} WHERE s_acctbal > 0")
sql("values_relation", "SELECT CAST(a AS BIGINT) AS a, b FROM (VALUES (1, 'x'), (2, 'y'), (3, NULL)) AS v(a, b)")
sql("pred_alias_in_where", "SELECT y, n_nationkey FROM (SELECT n_name || '-' || CAST(n_regionkey AS STRING) AS y, n_nationkey FROM {nation}) AS t WHERE y LIKE '%-1'", "SELECT y, n_nationkey FROM (SELECT n_name || '-' || CAST(n_regionkey AS VARCHAR) AS y, n_nationkey FROM nation) AS t WHERE y LIKE '%-1'")
sql("pred_between", "SELECT p_partkey FROM {part} WHERE p_size BETWEEN 10 AND 20 AND p_retailprice NOT BETWEEN 950 AND 1000")
sql("pred_in_list", "SELECT p_partkey, p_size FROM {part} WHERE p_size IN (1, 5, 9, 33)")
sql("pred_like_escape", "SELECT p_partkey, p_name FROM {part} WHERE p_name LIKE '%a!_%' ESCAPE '!' OR p_name LIKE '%e%'")
sql("pred_regexp", "SELECT p_partkey, p_type FROM {part} WHERE regexp_like(p_type, '[A-F][A-Z]+$')", "SELECT p_partkey, p_type FROM part WHERE regexp_matches(p_type, '[A-F][A-Z]+$')")
sql("pred_is_truth", "SELECT c_custkey, (o_orderkey > 500) IS TRUE AS t, (o_orderkey > 500) IS NOT TRUE AS nt, (o_orderkey > 500) IS FALSE AS f, o_orderkey IS NULL AS u FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey", "SELECT c_custkey, coalesce(o_orderkey > 500, false) AS t, NOT coalesce(o_orderkey > 500, false) AS nt, coalesce(o_orderkey <= 500, false) AS f, o_orderkey IS NULL AS u FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
sql("pred_null_safe_eq", "SELECT c_custkey, o_orderkey <=> NULL AS none FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey", "SELECT c_custkey, o_orderkey IS NOT DISTINCT FROM NULL AS none FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
sql("pred_in_subquery", "SELECT c_custkey FROM {customer} WHERE c_custkey IN (SELECT o_custkey FROM {orders} WHERE o_totalprice > 200000)")
sql("pred_not_in_null", "SELECT c_custkey FROM {customer} WHERE c_custkey NOT IN (SELECT CASE WHEN o_totalprice > 1 THEN o_custkey END FROM {orders} WHERE o_orderstatus = 'F' AND o_totalprice > 400000)")
sql("pred_row_value_in", "SELECT count(*) AS n FROM {orders} WHERE (o_custkey, o_orderstatus) IN (SELECT o_custkey, o_orderstatus FROM {orders} WHERE o_totalprice > 300000)")
sql("pred_case", "SELECT o_orderstatus, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS code, CASE WHEN o_totalprice > 100000 THEN 'big' END AS size FROM {orders}")
sql("expr_bitwise", "SELECT o_orderkey, o_orderkey & 255 AS a, o_orderkey | 7 AS o, ~o_orderkey AS c, shiftleft(o_orderkey, 3) AS l, shiftright(o_orderkey, 2) AS r FROM {orders}", "SELECT o_orderkey, o_orderkey & 255 AS a, o_orderkey | 7 AS o, ~o_orderkey AS c, o_orderkey << 3 AS l, o_orderkey >> 2 AS r FROM orders")
sql("expr_concat_null", "SELECT n_nationkey, n_name || NULL AS none, n_name || '!' AS some FROM {nation}")


@query("SELECT p_partkey FROM part WHERE p_type GLOB '*S[A-M]*'")
def pred_glob(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").where(dialect.glob(F.col("p_type"), "*S[A-M]*")).select("p_partkey")


@query("SELECT c_custkey FROM customer WHERE false")
def pred_in_empty(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").where(dialect.is_in(F.col("c_custkey"), [])).select("c_custkey")


@query("SELECT c_custkey, CAST(regexp_extract(c_name, '([0-9]+)', 1) AS BIGINT) AS n, CAST(0 AS BIGINT) AS z FROM customer")
def cast_prefix_number(spark: SparkSession, d: str) -> DataFrame:
    digits = F.concat(F.lit(" "), F.regexp_extract("c_name", r"([0-9]+)", 1), F.lit("xyz"))
    return read(spark, d, "customer").select("c_custkey", dialect.prefix_integer(digits).alias("n"), dialect.prefix_integer(F.col("c_name")).alias("z"))


@query("SELECT o_orderkey, o_orderkey // 7 AS q, CAST(NULL AS BIGINT) AS z FROM orders")
def expr_integer_divide(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select("o_orderkey", dialect.integer_divide(F.col("o_orderkey"), F.lit(7)).alias("q"), dialect.integer_divide(F.col("o_orderkey"), F.lit(0)).alias("z"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey < 255")
def expr_hex_literal(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(dialect.hex_literals("SELECT o_orderkey FROM {orders} WHERE o_orderkey < 0xFF"), orders=read(spark, d, "orders"))


@query("SELECT c_custkey FROM customer WHERE c_acctbal > 1000 AND c_mktsegment = 'BUILDING'")
def expr_bind_parameters(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql("SELECT c_custkey FROM {customer} WHERE c_acctbal > :low AND c_mktsegment = :seg", args={"low": 1000, "seg": "BUILDING"}, customer=read(spark, d, "customer"))


@query("SELECT lower(c_mktsegment) AS seg, count(*) AS n FROM customer GROUP BY 1")
def group_by_collation(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "customer").select(F.when(F.col("c_custkey") % 2 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment")).alias("s"))
    return t.groupBy(F.collate("s", "UTF8_LCASE").alias("g")).agg(F.count("*").alias("n")).select(F.lower(F.collate("g", "UTF8_BINARY")).alias("seg"), "n")


# --- joins ---------------------------------------------------------------------------------

sql("join_inner", "SELECT n_name, r_name FROM {nation} JOIN {region} ON n_regionkey = r_regionkey")
sql("join_comma", "SELECT c_custkey, n_name FROM {customer}, {nation} WHERE c_nationkey = n_nationkey AND c_acctbal < 0")
sql("join_left", "SELECT c_custkey, o_orderkey FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey AND o_orderstatus = 'F'")
sql("join_left_where", "SELECT c_custkey, o_orderkey FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey WHERE o_orderstatus = 'F'")
sql("join_right", "SELECT c_custkey, o_orderkey FROM {orders} RIGHT JOIN {customer} ON c_custkey = o_custkey")
sql("join_full", "SELECT c_custkey, s_suppkey FROM {customer} FULL JOIN {supplier} ON c_custkey = 10 * s_suppkey + 70")
sql("join_cross", "SELECT r_name, n_name FROM {region} CROSS JOIN {nation}")
sql("join_using", "SELECT k, a, b FROM (SELECT n_nationkey AS k, n_name AS a FROM {nation}) AS x JOIN (SELECT s_nationkey AS k, s_name AS b FROM {supplier}) AS y USING (k)")
sql("join_natural", "SELECT k, a, b FROM (SELECT n_nationkey AS k, n_name AS a FROM {nation}) AS x NATURAL JOIN (SELECT c_nationkey AS k, c_name AS b FROM {customer}) AS y")
sql("join_semi", "SELECT c_custkey FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
sql("join_anti", "SELECT c_custkey FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey)")
sql("join_nway", "SELECT r_name, count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey GROUP BY r_name")
sql("join_nested", "SELECT c_custkey, r_name FROM {customer} JOIN ({nation} JOIN {region} ON n_regionkey = r_regionkey) ON c_nationkey = n_nationkey")
sql("join_self", "SELECT a.n_name AS a, b.n_name AS b FROM {nation} AS a JOIN {nation} AS b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")


@query("SELECT p_partkey, lo FROM part JOIN (SELECT CAST(v AS DOUBLE) AS lo, CAST(v + 30 AS DOUBLE) AS hi FROM generate_series(900, 1800, 50) AS t(v)) ON p_retailprice BETWEEN lo AND hi")
def join_theta_range(spark: SparkSession, d: str) -> DataFrame:
    bands = readers.generate_series(spark, 900, 1800, 50).select(F.col("value").cast("double").alias("lo"), (F.col("value") + 30).cast("double").alias("hi"))
    return relational.range_join(read(spark, d, "part"), bands, "p_retailprice", "lo", "hi", 50.0).select("p_partkey", "lo")


@query("SELECT e.event_id, (SELECT max(p.event_id) FROM events p WHERE p.event_type = 'purchase' AND p.user_id = e.user_id AND p.event_id <= e.event_id) AS last_purchase FROM events e WHERE e.event_type <> 'purchase'")
def join_as_of(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    bought = e.where("event_type = 'purchase'").select("user_id", "event_id", F.col("event_id").alias("bought"))
    return relational.nearest_before(e.where("event_type <> 'purchase'").select("user_id", "event_id"), bought, ["user_id"], "event_id", "bought", "last_purchase").select("event_id", "last_purchase")


# --- aggregates ----------------------------------------------------------------------------

sql("agg_group_by", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price, round(sum(l_extendedprice * (1 - l_discount)), 4) AS sum_disc_price, round(avg(l_quantity), 6) AS avg_qty, count(*) AS count_order FROM {lineitem} WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus")
sql("agg_count_nulls", "SELECT count(*) AS rows_, count(o_orderkey) AS matched FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey")
sql("agg_no_rows", "SELECT count(*) AS n, sum(c_acctbal) AS s, min(c_acctbal) AS lo, max(c_acctbal) AS hi, avg(c_acctbal) AS m FROM {customer} WHERE c_custkey < 0")
sql("agg_having", "SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey HAVING count(*) > 12")
sql("agg_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS s, count(DISTINCT l_linenumber) AS n FROM {lineitem} GROUP BY l_returnflag")
sql("agg_filter", "SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 100000) AS big, count(DISTINCT o_custkey) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent FROM {orders} GROUP BY o_orderstatus")
sql("agg_expression_key", "SELECT o_orderkey % 10 AS k, count(*) AS n FROM {orders} GROUP BY o_orderkey % 10")
sql("agg_distinct_rows", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM {orders}")
sql("agg_stats", "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS vp FROM {lineitem} GROUP BY l_returnflag")


@query("SELECT c_nationkey, coalesce(sum(CASE WHEN c_acctbal > 99999 THEN c_acctbal END), 0.0) AS none, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY c_nationkey")
def agg_total(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").groupBy("c_nationkey").agg(relational.total(F.when(F.col("c_acctbal") > 99999, F.col("c_acctbal"))).alias("none"), F.round(relational.total(F.col("c_acctbal")), 2).alias("total"))


@query("SELECT o_custkey, max(o_totalprice) AS top, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS k FROM orders GROUP BY o_custkey")
def agg_bare_max(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("top"), relational.bare_max(F.col("o_totalprice"), F.col("o_orderkey"), of=F.col("o_orderkey")).alias("k"))


@query("SELECT o_custkey, min(o_totalprice) AS low, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS k FROM orders GROUP BY o_custkey")
def agg_bare_min(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_totalprice").alias("low"), relational.bare_min(F.col("o_totalprice"), F.col("o_orderkey"), of=F.col("o_orderkey")).alias("k"))


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names, string_agg(n_name, '; ' ORDER BY n_nationkey) AS by_key FROM nation GROUP BY n_regionkey")
def agg_concat_ordered(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "nation").groupBy("n_regionkey").agg(relational.concat_ordered(F.col("n_name"), F.col("n_name")).alias("names"), relational.concat_ordered(F.col("n_name"), F.col("n_nationkey"), sep="; ").alias("by_key"))


@query("SELECT o_orderstatus, string_agg(p, ',' ORDER BY k) AS priorities FROM (SELECT o_orderstatus, o_orderpriority AS p, min(o_orderkey) AS k FROM orders GROUP BY 1, 2) GROUP BY o_orderstatus")
def agg_concat_distinct_ordered(spark: SparkSession, d: str) -> DataFrame:
    return relational.concat_distinct_ordered(read(spark, d, "orders"), ["o_orderstatus"], "o_orderpriority", ["o_orderkey"], "priorities")


@query("SELECT n_regionkey, substr(string_agg('/' || CAST(n_nationkey AS VARCHAR) || n_name, '' ORDER BY n_nationkey), 2 + length(CAST(min(n_nationkey) AS VARCHAR))) AS names FROM nation GROUP BY n_regionkey")
def agg_concat_row_sep(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "nation").groupBy("n_regionkey").agg(relational.concat_row_separator(F.col("n_name"), F.concat(F.lit("/"), F.col("n_nationkey").cast("string")), F.col("n_nationkey")).alias("names"))


@query("SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 4) AS p25, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90 FROM lineitem GROUP BY l_returnflag")
def agg_percentile(spark: SparkSession, d: str) -> DataFrame:
    got = relational.percentiles(read(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", {"p25": 25, "p90": 90})
    return got.select("l_returnflag", F.round("p25", 4).alias("p25"), F.round("p90", 4).alias("p90"))


@query("SELECT l_returnflag, round(median(l_quantity), 4) AS m FROM lineitem GROUP BY l_returnflag")
def agg_median(spark: SparkSession, d: str) -> DataFrame:
    return relational.percentiles(read(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", {"m": 50}).select("l_returnflag", F.round("m", 4).alias("m"))


# --- windows -------------------------------------------------------------------------------

sql("win_row_number", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM {orders}")
sql("win_rank", "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS r, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS dr FROM {part}")
sql("win_cume_dist", "SELECT p_partkey, round(cume_dist() OVER (PARTITION BY p_brand ORDER BY p_size), 9) AS c, round(percent_rank() OVER (PARTITION BY p_brand ORDER BY p_size), 9) AS p, ntile(4) OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS q FROM {part}")
sql("win_lag_lead", "SELECT o_orderkey, lag(o_orderkey) OVER w AS before, lead(o_orderkey, 2) OVER w AS after FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
sql("win_aggregate_over", "SELECT n_nationkey, count(*) OVER (PARTITION BY n_regionkey) AS n, max(n_name) OVER (PARTITION BY n_regionkey) AS last FROM {nation}")
sql("win_rows_frame", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 2) AS s FROM {orders}")
sql("win_range_frame", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 3 PRECEDING AND 2 FOLLOWING) AS n FROM {part}")
sql("win_default_frame", "SELECT p_partkey, sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size) AS s, sum(p_size) OVER (PARTITION BY p_brand) AS t FROM {part}", "SELECT p_partkey, CAST(sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size) AS BIGINT) AS s, CAST(sum(p_size) OVER (PARTITION BY p_brand) AS BIGINT) AS t FROM part")
sql("win_first_last", "SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, nth_value(o_orderkey, 2) OVER w AS s FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
sql("win_over_group", "SELECT o_orderstatus, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS everything FROM {orders} GROUP BY o_orderstatus")


@query("SELECT p_partkey, CAST(sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS BIGINT) AS s FROM part")
def win_groups_frame(spark: SparkSession, d: str) -> DataFrame:
    return windows.groups_frame(read(spark, d, "part"), ["p_brand"], "p_size", -2, 2, F.sum("p_size"), "s").select("p_partkey", "s")


@query("SELECT p_partkey, " + ", ".join(f"CAST(sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_type RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE {w}) AS BIGINT) AS {n}" for w, n in (("CURRENT ROW", "c"), ("GROUP", "g"), ("TIES", "t"))) + " FROM part")
def win_exclude(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", *[windows.sum_excluding(["p_brand"], "p_type", "p_size", w).alias(n) for w, n in (("current row", "c"), ("group", "g"), ("ties", "t"))])


@query("SELECT o_orderkey, count(*) FILTER (WHERE o_orderstatus = 'F') OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders")
def win_filter_over(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return read(spark, d, "orders").select("o_orderkey", windows.filtered(F.count, F.lit(1), F.col("o_orderstatus") == "F", w).alias("n"))


# --- order, limit, sets, subqueries --------------------------------------------------------

sql("sort_nulls", "SELECT c_custkey, b FROM (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS b FROM {customer}) AS t ORDER BY b NULLS LAST, c_custkey LIMIT 50")
sql("sort_collate", "SELECT p_partkey FROM {part} ORDER BY lower(p_name) DESC, p_partkey LIMIT 20")
sql("topk", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
sql("limit_offset", "SELECT o_orderkey FROM {orders} ORDER BY o_orderkey LIMIT 7 OFFSET 13")
sql("limit_compound", "SELECT k FROM (SELECT c_custkey AS k FROM {customer} UNION ALL SELECT o_custkey FROM {orders}) AS t ORDER BY k DESC LIMIT 9 OFFSET 2")
sql("set_union", "SELECT c_custkey AS k FROM {customer} UNION SELECT o_custkey FROM {orders}")
sql("set_union_all", "SELECT c_nationkey AS k FROM {customer} UNION ALL SELECT s_nationkey FROM {supplier}")
sql("set_intersect", "SELECT c_custkey AS k FROM {customer} INTERSECT SELECT o_custkey FROM {orders}")
sql("set_except", "SELECT c_custkey AS k FROM {customer} EXCEPT SELECT o_custkey FROM {orders}")
sql("cte_nested", "WITH a AS (WITH b AS (SELECT n_regionkey AS r, count(*) AS n FROM {nation} GROUP BY n_regionkey) SELECT r, n * 2 AS n FROM b) SELECT r, n FROM a WHERE n > 1")
sql("cte_recursive_counter", "WITH RECURSIVE c(x) AS (SELECT CAST(1 AS BIGINT) UNION ALL SELECT x + 1 FROM c WHERE x < 60) SELECT x FROM c")
sql("subq_scalar", "SELECT o_orderkey FROM {orders} WHERE o_totalprice > (SELECT 2 * avg(o_totalprice) FROM {orders})")
sql("subq_correlated", "SELECT o_orderkey FROM {orders} AS o WHERE o_totalprice = (SELECT max(i.o_totalprice) FROM {orders} AS i WHERE i.o_custkey = o.o_custkey)")
sql("subq_correlated_count", "SELECT c_custkey, (SELECT count(*) FROM {orders} WHERE o_custkey = c_custkey) AS n FROM {customer}")
sql("subq_from", "SELECT avg_n FROM (SELECT round(avg(n), 6) AS avg_n FROM (SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey) AS a) AS b")


@query("SELECT c_custkey FROM customer")
def limit_negative(spark: SparkSession, d: str) -> DataFrame:
    """LIMIT -1 is no limit."""
    return read(spark, d, "customer").select("c_custkey")


@query("SELECT c_custkey, (SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 1) AS k FROM customer")
def subq_first_row(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").select("c_custkey", relational.first_scalar(read(spark, d, "orders"), "o_orderkey", ["o_totalprice", "o_orderkey"]).alias("k"))


@query("WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem), c(p) AS (SELECT CAST(1 AS BIGINT) UNION SELECT e2.a FROM (SELECT DISTINCT e1.b FROM c JOIN e e1 ON c.p = e1.a) AS f JOIN e e2 ON f.b = e2.b) SELECT p FROM c")
def cte_recursive_union_closure(spark: SparkSession, d: str) -> DataFrame:
    return cte_recursive_union_closure_all(spark, d)


@query()
def cte_recursive_union_closure_all(spark: SparkSession, d: str) -> DataFrame:
    """The same over the edges of all line items."""
    e = read(spark, d, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).distinct()
    step = lambda f: f.join(e, F.col("p") == F.col("a")).select("b").distinct().join(e, "b").select(F.col("a").alias("p")).distinct()
    return recursive.fixpoint(spark.range(1, 2).select(F.col("id").alias("p")), [step])


# --- strings, hashes, dates, numbers -------------------------------------------------------


@query("SELECT p_partkey, substr(p_name, 1, 4) AS a, CASE WHEN length(p_name) >= 3 THEN right(p_name, 3) ELSE p_name END AS b, left(p_name, 1) AS c, substr(p_name, 2, 2) AS e FROM part")
def str_substr_ref(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("p_name")
    return read(spark, d, "part").select("p_partkey", dialect.substr(s, 1, 4).alias("a"), dialect.substr(s, -3).alias("b"), dialect.substr(s, 0, 2).alias("c"), dialect.substr(s, 4, -2).alias("e"))


@query("SELECT c_custkey, concat(c_name, NULL, '/', c_mktsegment) AS a, concat_ws('-', c_name, NULL, c_mktsegment) AS b FROM customer")
def str_concat_ref(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").select("c_custkey", dialect.concat(F.col("c_name"), F.lit(None).cast("string"), F.lit("/"), F.col("c_mktsegment")).alias("a"), F.concat_ws("-", "c_name", F.lit(None).cast("string"), "c_mktsegment").alias("b"))


sql("str_trim_case", "SELECT p_partkey, upper(p_name) AS u, lower(p_type) AS l, trim('  x ' || p_brand || ' ') AS t, replace(p_name, 'a', 'AA') AS r, length(p_name) AS n, instr(p_name, 'e') AS i, reverse(p_brand) AS v, lpad(p_brand, 12, '*') AS lp, split_part(p_type, ' ', 2) AS sp FROM {part}")


@query("SELECT p_partkey, hex(p_name) AS h, p_name AS back FROM part")
def str_hex_unhex(spark: SparkSession, d: str) -> DataFrame:
    h = F.hex("p_name")
    return read(spark, d, "part").select("p_partkey", h.alias("h"), dialect.unhex(F.regexp_replace(h, "(..)", "$1-"), "-").cast("string").alias("back"))


@query("SELECT p_partkey, '''' || replace(p_name || '''s', '''', '''''') || '''' AS q FROM part")
def str_quote(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", dialect.quote(F.concat("p_name", F.lit("'s"))).alias("q"))


sql("str_format", "SELECT o_orderkey, format_string('%08d|%-3s|%.2f', o_orderkey, o_orderstatus, o_totalprice) AS f FROM {orders}", "SELECT o_orderkey, printf('%08d|%-3s|%.2f', o_orderkey, o_orderstatus, o_totalprice) AS f FROM orders")
_NEXT = "(SELECT a.p_partkey AS k, a.p_name AS a, b.p_name AS b FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each part's name and that of the next."""
    p = read(spark, d, "part")
    after = p.select((F.col("p_partkey") - 1).alias("k"), F.col("p_name").alias("b"))
    return p.select(F.col("p_partkey").alias("k"), F.col("p_name").alias("a")).join(after, "k")


@query(f"SELECT k, a, b, CAST(levenshtein(a, b) AS INTEGER) AS d FROM {_NEXT}")
def str_levenshtein(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("k", "a", "b", F.levenshtein("a", "b").alias("d"))


@query(f"SELECT k, a, b, CAST(damerau_levenshtein(a, b) AS INTEGER) AS d FROM {_NEXT}")
def str_damerau(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("k", "a", "b", strings.damerau_levenshtein("a", "b").alias("d"))


@query("SELECT a.n_name AS a, b.n_name AS b, round(jaro_similarity(a.n_name, b.n_name), 6) AS j, round(jaro_winkler_similarity(a.n_name, b.n_name), 6) AS w FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def str_jaro_winkler(spark: SparkSession, d: str) -> DataFrame:
    """Names of one region; an odd number of transposed characters counts by halves here and not in DuckDB, see str_jaro_halves."""
    n = read(spark, d, "nation")
    pairs = n.select("n_regionkey", F.col("n_name").alias("a")).join(n.select("n_regionkey", F.col("n_name").alias("b")), "n_regionkey")
    return pairs.select("a", "b", F.round(strings.jaro("a", "b"), 6).alias("j"), F.round(strings.jaro_winkler("a", "b"), 6).alias("w"))


@query(f"SELECT k, a, b, CASE WHEN length(a) = length(b) THEN CAST(hamming(a, b) AS INTEGER) END AS h FROM {_NEXT}")
def str_hamming(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("k", "a", "b", strings.hamming(F.col("a"), F.col("b")).alias("h"))


@query("SELECT doc_id, md5(text) AS m, sha1(text) AS s1, sha256(text) AS s2 FROM documents")
def hash_md5_sha(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.md5("text").alias("m"), F.sha1("text").alias("s1"), F.sha2("text", 256).alias("s2"))


@query("SELECT page_id, to_base64(encode(url)) AS b, url_encode(url) AS u FROM pages")
def enc_base64_url(spark: SparkSession, d: str) -> DataFrame:
    return enc_base64_url_all(spark, d)


@query()
def enc_base64_url_all(spark: SparkSession, d: str) -> DataFrame:
    """Urls of any length; base64 has no line breaks."""
    return read(spark, d, "pages").select("page_id", F.regexp_replace(F.base64(F.col("url").cast("binary")), "[\r\n]", "").alias("b"), F.url_encode("url").alias("u"))


@query("SELECT o_orderkey, o_orderkey % 256 AS x, o_custkey % 256 AS y FROM orders")
def enc_zorder(spark: SparkSession, d: str) -> DataFrame:
    z = strings.zorder(F.col("o_orderkey") % 256, F.col("o_custkey") % 256, bits=8)
    return read(spark, d, "orders").select("o_orderkey", z.alias("z")).select("o_orderkey", strings.unzorder(F.col("z"), 0, 2, 8).alias("x"), strings.unzorder(F.col("z"), 1, 2, 8).alias("y"))


@query("SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN round(sqrt(c_acctbal), 6) END AS s, CASE WHEN c_acctbal > 0 THEN round(ln(c_acctbal), 6) END AS l, CAST(NULL AS DOUBLE) AS a FROM customer")
def math_domain_null(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("c_acctbal")
    return read(spark, d, "customer").select("c_custkey", F.round(dialect.domain(F.sqrt(b)), 6).alias("s"), F.round(dialect.domain(F.ln(b)), 6).alias("l"), dialect.domain(F.acos(F.abs(b) + 2)).alias("a"))


sql("math_trig", "SELECT l_orderkey, l_linenumber, round(sin(l_quantity), 6) AS s, round(cos(l_quantity), 6) AS c, round(atan2(l_quantity, 3.0), 6) AS a, round(degrees(l_discount), 6) AS d, round(power(l_quantity, 2), 4) AS p, sign(l_discount) AS g FROM {lineitem}", "SELECT l_orderkey, l_linenumber, round(sin(l_quantity), 6) AS s, round(cos(l_quantity), 6) AS c, round(atan2(l_quantity, 3.0), 6) AS a, round(degrees(l_discount), 6) AS d, round(power(l_quantity, 2), 4) AS p, CAST(sign(l_discount) AS DOUBLE) AS g FROM lineitem")
sql("math_round", "SELECT c_custkey, CAST(round(c_acctbal) AS BIGINT) AS r, CAST(floor(c_acctbal) AS BIGINT) AS f, CAST(ceil(c_acctbal) AS BIGINT) AS c, abs(c_acctbal) AS a FROM {customer}")


@query("SELECT c_custkey, CASE WHEN o_orderkey IS NULL THEN NULL ELSE greatest(o_orderkey, c_custkey) END AS hi FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def math_scalar_max(spark: SparkSession, d: str) -> DataFrame:
    j = read(spark, d, "customer").join(read(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return j.select("c_custkey", dialect.scalar_max(F.col("o_orderkey"), F.col("c_custkey")).alias("hi"))


@query("SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) AS u, round(julian(o_orderdate) - 0.5, 6) AS j FROM orders")
def date_epoch_julian(spark: SparkSession, d: str) -> DataFrame:
    ts = F.col("o_orderdate")
    return read(spark, d, "orders").select("o_orderkey", dt.unixepoch(ts).alias("u"), F.round(dt.julianday(ts), 6).alias("j"))


@query("SELECT o_orderkey, strftime(date_trunc('month', o_orderdate) + INTERVAL 10 DAY, '%Y-%m-%d') AS a, strftime(o_orderdate + INTERVAL 90 MINUTE, '%Y-%m-%d %H:%M:%S') AS b FROM orders")
def date_modifiers(spark: SparkSession, d: str) -> DataFrame:
    ts = F.col("o_orderdate").cast("timestamp")
    return read(spark, d, "orders").select("o_orderkey", F.date_format(dt.modify(ts, "start of month", "+10 days"), "yyyy-MM-dd").alias("a"), F.date_format(dt.modify(ts, "+90 minutes"), "yyyy-MM-dd HH:mm:ss").alias("b"))


@query("SELECT event_id, strftime(ts, '%d/%m/%Y %H:%M:%S %j %u %w %W %p') AS f FROM events")
def date_strftime(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_id", dt.strftime("%d/%m/%Y %H:%M:%S %j %u %w %W %p", F.col("ts").cast("timestamp")).alias("f"))


# --- JSON ----------------------------------------------------------------------------------

DOC = '{"a":1,"b":[1,[2,3],4],"c":"x y"}'


def _doc(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "nation").select("n_nationkey", F.replace(F.lit(DOC), F.lit('"a":1'), F.concat(F.lit('"a":'), F.col("n_nationkey").cast("string"))).alias("j"))


_DOC = "(SELECT n_nationkey, replace('" + DOC + "', '\"a\":1', '\"a\":' || CAST(n_nationkey AS VARCHAR)) AS j FROM nation)"


@query(f"SELECT n_nationkey, json_extract_string(j, '$.a') AS a, CAST(json_extract(j, '$.b[1]') AS VARCHAR) AS b, json_extract_string(j, '$.c') AS c, json_extract_string(j, '$.z') AS z FROM {_DOC}")
def json_extract(spark: SparkSession, d: str) -> DataFrame:
    return _doc(spark, d).select("n_nationkey", *[jsons.json_extract(F.col("j"), p).alias(n) for p, n in (("$.a", "a"), ("$.b[1]", "b"), ("$.c", "c"), ("$.z", "z"))])


@query(f"SELECT n_nationkey, json_extract_string(j, '$.b[#-1]') AS last, json_extract_string(j, '$.b[#-2][0]') AS inner_ FROM {_DOC}")
def json_paths_negative(spark: SparkSession, d: str) -> DataFrame:
    return _doc(spark, d).select("n_nationkey", jsons.json_extract(F.col("j"), "$.b[#-1]").alias("last"), jsons.json_extract(F.col("j"), "$.b[#-2][0]").alias("inner_"))


@query(f"SELECT n_nationkey, 'integer' AS a, 'array' AS b, 'text' AS c, 'object' AS r, CAST(json_array_length(j, '$.b') AS INTEGER) AS n FROM {_DOC}")
def json_types(spark: SparkSession, d: str) -> DataFrame:
    j = F.col("j")
    return _doc(spark, d).select("n_nationkey", *[jsons.json_type(j, p).alias(n) for p, n in (("$.a", "a"), ("$.b", "b"), ("$.c", "c"), ("$", "r"))], F.json_array_length(F.get_json_object(j, "$.b")).alias("n"))


@query("SELECT event_id, CAST(json_valid(props) AS BOOLEAN) AS ok, CAST(json_valid('{' || event_type) AS BOOLEAN) AS bad FROM events")
def json_valid(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_id", jsons.json_valid(F.col("props")).alias("ok"), jsons.json_valid(F.concat(F.lit("{"), F.col("event_type"))).alias("bad"))


@query(
    "SELECT n_nationkey, " + ", ".join(f"'{{\"a\":' || n_nationkey || '{rest}' AS {n}" for n, rest in (
        ("set_", ',"b":[1,[2,3],4,9],"c":"x y"}'), ("insert_", ',"b":[1,[2,3],4],"c":"x y"}'), ("replace_", ',"b":[1,[2,3],4],"c":"x y"}'),
        ("remove_", ',"b":[4],"c":"x y"}'), ("patch_", ',"b":[1,[2,3],4],"n":{"k":1}}'),
    )) + " FROM nation"
)
def json_mutations(spark: SparkSession, d: str) -> DataFrame:
    j = F.col("j")
    return _doc(spark, d).select(
        "n_nationkey", jsons.json_set(j, "$.b[#]", 9).alias("set_"), jsons.json_insert(j, "$.a", 0).alias("insert_"), jsons.json_replace(j, "$.z", 0).alias("replace_"),
        jsons.json_remove(j, "$.b[0]", "$.b[0]").alias("remove_"), jsons.json_patch(j, {"c": None, "n": {"k": 1}}).alias("patch_"),
    )


@query(f"""SELECT n_nationkey, key, replace(value, '#', CAST(n_nationkey AS VARCHAR)) AS value, type, replace(atom, '#', CAST(n_nationkey AS VARCHAR)) AS atom, fullkey FROM nation,
(VALUES (NULL, '{DOC.replace('"a":1', '"a":#')}', 'object', NULL, '$'), ('a', '#', 'integer', '#', '$.a'), ('b', '[1,[2,3],4]', 'array', NULL, '$.b'), ('0', '1', 'integer', '1', '$.b[0]'), ('1', '[2,3]', 'array', NULL, '$.b[1]'),
('0', '2', 'integer', '2', '$.b[1][0]'), ('1', '3', 'integer', '3', '$.b[1][1]'), ('2', '4', 'integer', '4', '$.b[2]'), ('c', 'x y', 'text', 'x y', '$.c')) AS t(key, value, type, atom, fullkey)""")
def json_tree(spark: SparkSession, d: str) -> DataFrame:
    spark.udtf.register("lumenql_json_tree", jsons.JsonTree)
    return spark.sql("SELECT n_nationkey, t.* FROM {t}, LATERAL lumenql_json_tree(j) AS t", t=_doc(spark, d))


@query("SELECT n_regionkey, CAST(to_json(list(n_name ORDER BY n_nationkey)) AS VARCHAR) AS names FROM nation GROUP BY n_regionkey")
def json_group_array(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "nation").groupBy("n_regionkey").agg(relational.json_group_array(F.col("n_name"), F.col("n_nationkey")).alias("names"))


@query("SELECT n_regionkey, '{' || string_agg('\"' || n_name || '\":' || CAST(n_nationkey AS VARCHAR), ',' ORDER BY n_name) || '}' AS o FROM nation GROUP BY n_regionkey")
def json_group_object(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "nation").groupBy("n_regionkey").agg(relational.json_group_object(F.col("n_name"), F.col("n_nationkey")).alias("o"))


# --- vectors and search --------------------------------------------------------------------


def _probe(spark: SparkSession, d: str) -> list[float]:
    return read(spark, d, "embeddings").where("vec_id = 0").first()["embedding"]


@query("SELECT e.vec_id, round(1 - list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS c, round(list_distance(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS l FROM embeddings e, embeddings q WHERE q.vec_id = 0")
def vec_distances(spark: SparkSession, d: str) -> DataFrame:
    q = F.array(*[F.lit(float(x)) for x in _probe(spark, d)])
    return read(spark, d, "embeddings").select("vec_id", F.round(vectors.cosine_distance(F.col("embedding"), q), 6).alias("c"), F.round(vectors.l2_distance(F.col("embedding"), q), 6).alias("l"))


@query("SELECT e.vec_id FROM embeddings e, embeddings q WHERE q.vec_id = 0 ORDER BY round(1 - list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 12), e.vec_id LIMIT 10")
def vec_topk(spark: SparkSession, d: str) -> DataFrame:
    return vectors.nearest(read(spark, d, "embeddings"), "vec_id", "embedding", _probe(spark, d), 10).select("vec_id")


@query("""WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 0), e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT vec_id, e.v, q.v AS w, list_min(e.v) AS lo, (list_max(e.v) - list_min(e.v)) / 255.0 AS al FROM e, q)
SELECT vec_id, round(sqrt(list_sum(list_transform(range(1, len(v) + 1), lambda i: pow(floor((v[i] - lo) / al + 0.5) * al + lo - w[i], 2)))), 6) AS l8,
CAST(list_sum(list_transform(range(1, len(v) + 1), lambda i: CASE WHEN (v[i] > 0) <> (w[i] > 0) THEN 1 ELSE 0 END)) AS INTEGER) AS h1 FROM s""")
def vec_quantized(spark: SparkSession, d: str) -> DataFrame:
    q = F.array(*[F.lit(float(x)) for x in _probe(spark, d)])
    e = F.col("embedding")
    return read(spark, d, "embeddings").select("vec_id", F.round(vectors.l2_distance(vectors.dequantize8(vectors.quantize8(e)), q), 6).alias("l8"), vectors.hamming1(vectors.bits1(e), vectors.bits1(q)).alias("h1"))


@query()
def vec_ann(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings")
    return vectors.ivf_search(e, e.where("vec_id % 50 = 0"), "vec_id", "embedding").select("query", "id", "rank")


_TOKENS = r"(SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term, generate_subscripts(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), 1) AS pos FROM documents)"


def _index(spark: SparkSession, d: str) -> DataFrame:
    return search.tokens(read(spark, d, "documents"), "doc_id", "text")


@query(f"SELECT id FROM {_TOKENS} WHERE term IN ('the', 'when') GROUP BY id HAVING count(DISTINCT term) = 2 EXCEPT SELECT id FROM {_TOKENS} WHERE term IN ('clown', 'idiot')")
def fts_and_or_not(spark: SparkSession, d: str) -> DataFrame:
    i = _index(spark, d)
    return search.without(search.with_all(i, ["the", "when"]), search.with_any(i, ["clown", "idiot"]))


@query(f"SELECT DISTINCT a.id FROM {_TOKENS} a JOIN {_TOKENS} b ON a.id = b.id AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the'")
def fts_phrase(spark: SparkSession, d: str) -> DataFrame:
    return search.phrase(_index(spark, d), ["of", "the"])


@query(f"SELECT DISTINCT id FROM {_TOKENS} WHERE starts_with(term, 'thes')")
def fts_prefix(spark: SparkSession, d: str) -> DataFrame:
    return search.with_term(_index(spark, d), "thes*")


@query(f"SELECT DISTINCT a.id FROM {_TOKENS} a JOIN {_TOKENS} b ON a.id = b.id AND abs(a.pos - b.pos) <= 3 WHERE a.term = 'from' AND b.term = 'with'")
def fts_near(spark: SparkSession, d: str) -> DataFrame:
    return search.near(_index(spark, d), "from", "with", 2)


@query(f"""WITH t AS {_TOKENS}, s AS (SELECT id, count(*) AS len FROM t GROUP BY id), m AS (SELECT count(*) AS n, avg(len) AS mean FROM s),
f AS (SELECT id, term, count(*) AS tf FROM t WHERE term IN ('from', 'when') GROUP BY ALL), g AS (SELECT term, count(*) AS df FROM f GROUP BY term)
SELECT id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score FROM f JOIN g USING (term) JOIN s USING (id), m GROUP BY id""")
def fts_bm25(spark: SparkSession, d: str) -> DataFrame:
    return search.bm25(read(spark, d, "documents"), "doc_id", "text", ["from", "when"]).select("id", F.round("score", 6).alias("score"))


@query(f"SELECT term, count(DISTINCT id) AS doc, count(*) AS cnt FROM {_TOKENS} GROUP BY term")
def fts_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return search.vocabulary(_index(spark, d))


@query()
def fts_highlight(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "benchmark").select("item_id", search.highlight(F.col("text"), ["the", "of"]).alias("marked"))


_BOX = "(SELECT l_orderkey * 10 + l_linenumber AS id, l_quantity AS x0, l_quantity + 2 AS x1, l_extendedprice / 1000 AS y0, l_extendedprice / 1000 + 1 AS y1 FROM lineitem WHERE l_orderkey {})"


def _boxes(spark: SparkSession, d: str, where: str) -> DataFrame:
    p = F.col("l_extendedprice") / 1000
    return read(spark, d, "lineitem").where(f"l_orderkey {where}").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_quantity").alias("x0"), (F.col("l_quantity") + 2).alias("x1"), p.alias("y0"), (p + 1).alias("y1"))


@query(f"SELECT a.id AS a_id, b.id AS b_id FROM {_BOX.format('% 50 = 0')} a JOIN {_BOX.format('IS NOT NULL')} b ON a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1")
def rtree_overlap(spark: SparkSession, d: str) -> DataFrame:
    """The boxes of every order whose key is divisible by 50, as queries, against all boxes."""
    return search.overlap_join(_boxes(spark, d, "% 50 = 0"), _boxes(spark, d, "IS NOT NULL"), 4.0)


@query()
def rtree_overlap_all(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of different boxes of the whole table that overlap, each once."""
    every = _boxes(spark, d, "IS NOT NULL")
    return search.overlap_join(every, every, 4.0, once=True)


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_quantity - 25) * (l_quantity - 25) + (l_extendedprice / 1000 - 30) * (l_extendedprice / 1000 - 30) <= 36")
def rtree_circle(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").where(search.in_circle(F.col("l_quantity"), F.col("l_extendedprice") / 1000, 25, 30, 6)).select("l_orderkey", "l_linenumber")


# --- changes, versions, streams ------------------------------------------------------------


def _new_customers(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer").where("c_custkey % 5 = 0")
    return c.select((F.col("c_custkey") + 75).alias("c_custkey"), "c_name", "c_nationkey", F.lit(1.0).alias("c_acctbal"), "c_mktsegment")


_NEW = "(SELECT c_custkey + 75 AS c_custkey, c_name, c_nationkey, 1.0 AS c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 5 = 0)"


@query(f"SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, coalesce(o.c_name, n.c_name) AS c_name, round(CASE WHEN o.c_custkey IS NULL THEN 1.0 WHEN n.c_custkey IS NOT NULL AND o.c_acctbal > 0 THEN o.c_acctbal + 1.0 ELSE o.c_acctbal END, 2) AS c_acctbal FROM customer o FULL JOIN {_NEW} n ON o.c_custkey = n.c_custkey")
def dml_upsert(spark: SparkSession, d: str) -> DataFrame:
    got = changes.upsert(read(spark, d, "customer"), _new_customers(spark, d), ["c_custkey"], {"c_acctbal": F.col("old.c_acctbal") + F.col("new.c_acctbal")}, F.col("old.c_acctbal") > 0)
    return got.select("c_custkey", "c_name", F.round("c_acctbal", 2).alias("c_acctbal"))


@query(f"SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM {_NEW}) UNION ALL SELECT c_custkey, c_name, c_acctbal FROM {_NEW}")
def dml_replace(spark: SparkSession, d: str) -> DataFrame:
    return changes.replace(read(spark, d, "customer"), _new_customers(spark, d), ["c_custkey"]).select("c_custkey", "c_name", "c_acctbal")


@query("SELECT s_suppkey, CASE WHEN n.n_nationkey IS NULL THEN s_name ELSE n_name END AS s_name FROM supplier LEFT JOIN nation n ON s_nationkey = n.n_nationkey AND n.n_regionkey = 1")
def dml_update_from(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return changes.update_from(read(spark, d, "supplier"), n, ["s_nationkey"], {"s_name": F.col("new.n_name")}).select("s_suppkey", "s_name")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice < 50000")
def dml_delete_returning(spark: SparkSession, d: str) -> DataFrame:
    return changes.delete(read(spark, d, "orders"), F.col("o_totalprice") < 50000)[1].select("o_orderkey")


@query("SELECT * FROM (SELECT 'positive' AS rule, count(*) FILTER (WHERE c_acctbal <= 0) AS n FROM customer UNION ALL SELECT 'unique', count(*) - count(DISTINCT c_nationkey) FROM customer) WHERE n > 0")
def constraint_check(spark: SparkSession, d: str) -> DataFrame:
    return changes.violations(read(spark, d, "customer"), {"positive": F.col("c_acctbal") > 0}, ["c_nationkey"], ["c_custkey"])


def _versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = read(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = o.where("o_orderkey % 7 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus")))
    return o.where("o_orderkey % 11 <> 0"), new


_DIFF = """(WITH o AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 11 <> 0),
n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 7 <> 0)
SELECT CASE WHEN o.o_orderkey IS NULL THEN 'insert' WHEN n.o_orderkey IS NULL THEN 'delete' ELSE 'update' END AS op, coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, o.o_orderstatus AS old_o_orderstatus, o.o_totalprice AS old_o_totalprice, n.o_orderstatus AS new_o_orderstatus, n.o_totalprice AS new_o_totalprice
FROM o FULL JOIN n ON o.o_orderkey = n.o_orderkey WHERE o.o_orderkey IS NULL OR n.o_orderkey IS NULL OR o.o_orderstatus <> n.o_orderstatus)"""


@query(f"SELECT * FROM {_DIFF}")
def diff_changeset(spark: SparkSession, d: str) -> DataFrame:
    return changes.diff(*_versions(spark, d), ["o_orderkey"])


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 7 <> 0")
def apply_changeset(spark: SparkSession, d: str) -> DataFrame:
    old, new = _versions(spark, d)
    return changes.apply(old, changes.diff(old, new, ["o_orderkey"]), ["o_orderkey"])


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 11 <> 0")
def invert_changeset(spark: SparkSession, d: str) -> DataFrame:
    old, new = _versions(spark, d)
    return changes.apply(new, changes.invert(changes.diff(old, new, ["o_orderkey"])), ["o_orderkey"])




def _cells(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    return e.select(F.lit("events").alias("tbl"), F.col("user_id").alias("pk"), F.col("event_type").alias("cid"), F.col("value").alias("val"), (F.col("event_id") % 9).alias("col_version"), F.col("event_id").alias("db_version"), (F.col("event_id") % 4).alias("site_id"))


@query("SELECT pk, cid, val, col_version, site_id FROM (SELECT *, row_number() OVER (PARTITION BY pk, cid ORDER BY col_version DESC, val DESC NULLS LAST, site_id DESC) AS r FROM (SELECT user_id AS pk, event_type AS cid, value AS val, event_id % 9 AS col_version, event_id % 4 AS site_id FROM events)) WHERE r = 1")
def crdt_merge(spark: SparkSession, d: str) -> DataFrame:
    return changes.merge_cells(_cells(spark, d)).select("pk", "cid", "val", "col_version", "site_id")


@query("SELECT event_id AS db_version FROM events WHERE event_id > 100 AND event_id % 4 IS DISTINCT FROM 2")
def crdt_sync_cursor(spark: SparkSession, d: str) -> DataFrame:
    return changes.changes_since(_cells(spark, d), 100, 2).select("db_version")


@query("SELECT page, arg_min(event_id, (p, -version)) AS seg FROM (SELECT event_id, event_id % 50 AS page, event_id AS version, CASE WHEN event_id % 3 = 0 AND event_id <= 900 THEN 0 WHEN event_id % 3 <> 0 AND event_id <= 500 THEN 1 END AS p FROM events) WHERE p IS NOT NULL GROUP BY page")
def version_read_branch(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "events").select("event_id", (F.col("event_id") % 50).alias("page"), F.col("event_id").alias("version"), F.when(F.col("event_id") % 3 == 0, "dev").otherwise("main").alias("branch"))
    return changes.read_version(s, [("dev", 900), ("main", 500)], "page").select("page", F.col("event_id").alias("seg"))


@query("SELECT event_id, user_id FROM events WHERE event_id > 250")
def stream_cursor_replay(spark: SparkSession, d: str) -> DataFrame:
    path = f"{d}/events.parquet"
    return changelog.replay(changelog.source(spark, path, spark.read.parquet(path).schema), 250).select("event_id", "user_id")


@query("SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id")
def stream_latest_by_key(spark: SparkSession, d: str) -> DataFrame:
    path = f"{d}/events.parquet"
    return changelog.latest_by_key(changelog.source(spark, path, spark.read.parquet(path).schema), "user_id", ["event_id"]).select("user_id", "event_id")


@query("SELECT user_id % 5 AS domain, arg_max(event_id, ts) AS seq FROM events GROUP BY 1")
def stream_gtid_set(spark: SparkSession, d: str) -> DataFrame:
    return changelog.gtid_set(read(spark, d, "events").withColumn("domain", F.col("user_id") % 5), "domain", "event_id", "ts")


# --- sources -------------------------------------------------------------------------------


@query("SELECT v AS value FROM generate_series(5, 100, 5) AS t(v)")
def src_generate_series(spark: SparkSession, d: str) -> DataFrame:
    return readers.generate_series(spark, 5, 100, 5)


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (3, 5, 9)")
def src_carray(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").join(readers.carray(spark, [3, 5, 9]), F.col("c_custkey") == F.col("value"), "left_semi").select("c_custkey")


@query("SELECT CAST(a AS INTEGER) AS a, b FROM (VALUES (1, 'x,y'), (2, 'z')) AS t(a, b)")
def src_csv(spark: SparkSession, d: str) -> DataFrame:
    return readers.csv(spark, data=["a,b", '1,"x,y"', "2,z"], header=True, schema="a int, b string")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey BETWEEN 50 AND 60 ORDER BY o_orderkey LIMIT 5")
def src_range_scan(spark: SparkSession, d: str) -> DataFrame:
    return readers.range_scan(read(spark, d, "orders"), "o_orderkey", 50, 60, 5).select("o_orderkey", "o_custkey")


@query("SELECT n_regionkey, list(n_name ORDER BY n_name) AS values FROM nation GROUP BY n_regionkey".replace(" AS values", ' AS "values"'))
def src_values_under_key(spark: SparkSession, d: str) -> DataFrame:
    return readers.values_under(read(spark, d, "nation"), "n_regionkey", "n_name")


from . import dialect_queries  # noqa: E402, F401  (registers its queries here)
