"""More queries of the catalogue: dialect functions, changes of tables, files, user code."""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import datetimes as dt
from ..functions import dialect, jsons, jsontext, numbers, strings, vectors
from ..operators import changes, recursive, relational, search, tables, windows
from ..sources import readers, sinks
from ..streaming import changelog
from .catalogue import query, read, sql


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    if isinstance(v, float):
        return f"CAST('{v!r}' AS DOUBLE)"
    return str(v)


def pinned(name: str, schema: str, inputs: list[tuple], outputs: dict[str, tuple[str, Callable[[], Column]]], want: list[tuple]) -> None:
    """Registers a query of expressions over given inputs; the oracle is the table of the results they must have.

    ``outputs``: column name to (type in DuckDB, expression).
    """

    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = spark.createDataFrame([(i, *r) for i, r in enumerate(inputs)], f"i int, {schema}")
        return rows.select("i", *[f().alias(n) for n, (_, f) in outputs.items()])

    run.__name__ = name
    values = ", ".join(f"({i}, {', '.join(map(_literal, r))})" for i, r in enumerate(want))
    casts = ", ".join(f'CAST("{n}" AS {t}) AS "{n}"' for n, (t, _) in outputs.items())
    names = ", ".join(f'"{n}"' for n in outputs)
    query(f"SELECT CAST(i AS INTEGER) AS i, {casts} FROM (VALUES {values}) AS t(i, {names})")(run)


c = F.col  # a short name, as every query has it

# --- expressions ---------------------------------------------------------------------------

sql("expr_blob_literal", "SELECT n_nationkey, hex(X'0102FF') AS h FROM {nation}", "SELECT n_nationkey, '0102FF' AS h FROM nation")
sql("expr_coalesce_nullif", "SELECT c_custkey, coalesce(o_orderkey, -1) AS a, ifnull(o_orderstatus, 'none') AS b, nullif(o_orderstatus, 'F') AS n FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey AND o_totalprice > 400000")
sql("expr_scan_expression_index", "SELECT year(o_orderdate) AS y, count(*) AS n FROM {orders} WHERE year(o_orderdate) IN (1995, 1997) GROUP BY year(o_orderdate)", "SELECT CAST(year(o_orderdate) AS INTEGER) AS y, count(*) AS n FROM orders WHERE year(o_orderdate) IN (1995, 1997) GROUP BY 1")


@query("SELECT c_custkey FROM customer WHERE c_acctbal > 1000 AND c_mktsegment = 'BUILDING'")
def expr_planner_hints(spark: SparkSession, d: str) -> DataFrame:
    text = "SELECT c_custkey FROM {customer} INDEXED BY some_index WHERE likely(c_acctbal > 1000) AND likelihood(+c_mktsegment = 'BUILDING', 0.2) AND unlikely(c_custkey >= 0)"
    return spark.sql(dialect.without_hints(text), customer=read(spark, d, "customer"))


@query("WITH t AS (SELECT n_regionkey AS r, count(*) AS n FROM nation GROUP BY 1) SELECT a.r, a.n FROM t a JOIN t b USING (r)")
def cte_materialized_hint(spark: SparkSession, d: str) -> DataFrame:
    text = "WITH t AS MATERIALIZED (SELECT n_regionkey AS r, count(*) AS n FROM {nation} GROUP BY n_regionkey), u AS NOT MATERIALIZED (SELECT r FROM t) SELECT r, n FROM t JOIN u USING (r)"
    return spark.sql(dialect.without_hints(text), nation=read(spark, d, "nation"))


sql("cte_shadowing", "WITH t AS (SELECT 1 AS x) SELECT a.x, b.x AS y FROM t AS a JOIN (WITH t AS (SELECT 2 AS x) SELECT x FROM t) AS b ON true")
sql("join_natural_full", "SELECT k, a, b FROM (SELECT n_nationkey AS k, n_name AS a FROM {nation}) AS x NATURAL FULL JOIN (SELECT c_custkey AS k, c_name AS b FROM {customer}) AS y")
sql("join_using_chain", "SELECT k, a, b, z FROM (SELECT c_custkey AS k, c_name AS a FROM {customer}) AS x LEFT JOIN (SELECT s_suppkey AS k, s_name AS b FROM {supplier}) AS y USING (k) LEFT JOIN (SELECT n_nationkey AS k, n_name AS z FROM {nation}) AS w USING (k)")
sql("join_union_all_view", "SELECT r_name, count(*) AS n FROM (SELECT c_nationkey AS k FROM {customer} UNION ALL SELECT s_nationkey FROM {supplier}) AS v JOIN {nation} ON k = n_nationkey JOIN {region} ON n_regionkey = r_regionkey GROUP BY r_name")
sql("join_anti_keyed", "SELECT p_partkey FROM {part} WHERE NOT EXISTS (SELECT 1 FROM {lineitem} WHERE l_partkey = p_partkey AND l_quantity > 45 AND l_discount < 0.05)")
sql("set_except_rows", "SELECT l_partkey, l_suppkey FROM {lineitem} EXCEPT SELECT l_partkey, l_suppkey FROM {lineitem} WHERE l_quantity > 25")
sql("subq_scalar_rows", "SELECT o_orderkey FROM {orders} WHERE o_totalprice > (SELECT 1.5 * avg(o_totalprice) FROM {orders})")
sql("agg_bare_any", "SELECT c_custkey, any_value(c_name) AS c_name, count(*) AS n FROM {customer} JOIN {orders} ON c_custkey = o_custkey GROUP BY c_custkey")
sql("agg_concat_desc", "SELECT n_regionkey, listagg(n_name, '|') WITHIN GROUP (ORDER BY n_name DESC) AS names FROM {nation} GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey")
sql("win_range_text", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand, p_type) AS n, sum(p_size) OVER (PARTITION BY p_brand, p_type) AS s FROM {part}", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand, p_type) AS n, CAST(sum(p_size) OVER (PARTITION BY p_brand, p_type) AS BIGINT) AS s FROM part")


@query("SELECT p_partkey, " + ", ".join(f"CAST(sum(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_size ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING EXCLUDE {w}) AS BIGINT) AS {n}" for w, n in (("CURRENT ROW", "c"), ("GROUP", "g"), ("TIES", "t"))) + " FROM (SELECT DISTINCT ON (p_brand, p_size) * FROM part ORDER BY p_brand, p_size, p_partkey)")
def win_exclude_rows(spark: SparkSession, d: str) -> DataFrame:
    first = Window.partitionBy("p_brand", "p_size").orderBy("p_partkey")
    p = read(spark, d, "part").withColumn("_first", F.row_number().over(first)).where("_first = 1").drop("_first")
    total = lambda a: F.when(F.size(a) > 0, F.aggregate(a, F.lit(0).cast("bigint"), lambda s, x: s + x))
    for what, name in (("current row", "c"), ("group", "g"), ("ties", "t")):
        p = windows.rows_excluding(p, ["p_brand"], ["p_size"], ["p_partkey"], -3, 2, "p_partkey", what, total, name)
    return p.select("p_partkey", "c", "g", "t")


@query("SELECT * FROM (VALUES ('aaa', 'aaa/aaa'), ('bbb', 'bbb/bbb')) AS t(a, joined)")
def subq_correlated_aggregate(spark: SparkSession, d: str) -> DataFrame:
    outer, inner = spark.createDataFrame([("aaa",), ("bbb",)], "a string"), spark.createDataFrame([("/",), ("-",)], "d string")
    return relational.outer_concat(outer, inner, "a", "d", [c("d")])


@query("WITH RECURSIVE r(x) AS (SELECT CAST(1 AS BIGINT) UNION SELECT CASE WHEN k = 0 THEN (x * 2) % 97 ELSE (x + 5) % 97 END FROM r, (VALUES (0), (1)) AS t(k)) SELECT x FROM r")
def cte_recursive_two_terms(spark: SparkSession, d: str) -> DataFrame:
    seed = spark.range(1, 2).select(c("id").alias("x"))
    return recursive.fixpoint(seed, [lambda f: f.select((c("x") * 2 % 97).alias("x")), lambda f: f.select(((c("x") + 5) % 97).alias("x"))])


@query("SELECT k, n FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) WHERE n > 9")
def view_columns(spark: SparkSession, d: str) -> DataFrame:
    store = tables.Store().create("orders", read(spark, d, "orders")).view("busy", lambda s: s["orders"].groupBy(c("o_custkey").alias("k")).agg(F.count("*").alias("n")))
    return store["busy"].where("n > 9")


# --- strings -------------------------------------------------------------------------------


@query("SELECT doc_id, CAST(unicode(text) AS BIGINT) AS u, chr(unicode(text)) || chr(8364) AS c FROM documents WHERE text <> ''")
def str_char_unicode(spark: SparkSession, d: str) -> DataFrame:
    u = strings.unicode(c("text"))
    return read(spark, d, "documents").where("text <> ''").select("doc_id", u.alias("u"), strings.char(u, 8364).alias("c"))


@query("SELECT c_custkey, 'integer' AS a, CASE WHEN o_totalprice IS NULL THEN 'null' ELSE 'real' END AS b, 'text' AS e FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def str_typeof(spark: SparkSession, d: str) -> DataFrame:
    j = read(spark, d, "customer").join(read(spark, d, "orders"), c("c_custkey") == c("o_custkey"), "left")
    return j.select("c_custkey", dialect.type_of(c("c_custkey")).alias("a"), dialect.type_of(c("o_totalprice")).alias("b"), dialect.type_of(c("c_name")).alias("e"))


sql("str_regexp_groups", "SELECT p_partkey, regexp_extract(p_type, '([A-Z])([A-Z]+)', 2) AS e, regexp_replace(p_type, '([A-Z])([A-Z]+)', '$2-$1') AS r FROM {part}", r"SELECT p_partkey, regexp_extract(p_type, '([A-Z])([A-Z]+)', 2) AS e, regexp_replace(p_type, '([A-Z])([A-Z]+)', '\2-\1', 'g') AS r FROM part")
sql("str_runes", "SELECT p_partkey, substr(p_name, 3, 1) AS at_, reverse(p_name) AS rev, translate(p_name, 'aeiou', 'AEIOU') AS tr, lpad(p_name, 15, '.') AS l, rpad(p_name, 15, '.') AS r, repeat(p_brand, 2) AS rep, p_name LIKE '%ring' AS lk FROM {part}")


@query("SELECT p_partkey, starts_with(p_name, 's') AS p, ends_with(p_name, 'g') AS s, CAST((length(p_name) - length(replace(p_name, 'e', ''))) AS INTEGER) AS n, CAST(CASE WHEN instr(p_name, 'e') = 0 THEN 0 ELSE length(p_name) - instr(reverse(p_name), 'e') + 1 END AS INTEGER) AS last FROM part")
def str_bytes(spark: SparkSession, d: str) -> DataFrame:
    s = c("p_name")
    return read(spark, d, "part").select("p_partkey", strings.has_prefix(s, "s").alias("p"), F.endswith(s, F.lit("g")).alias("s"), strings.count_of(s, "e").alias("n"), strings.last_index(s, "e").alias("last"))


@query("SELECT doc_id, strip_accents(text) AS t FROM documents")
def str_unaccent(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", strings.unaccent(c("text")).alias("t"))


@query("SELECT p_partkey, CAST(list_max(list_filter(range(0, least(length(p_name), length(n)) + 1), lambda i: left(p_name, i) = left(n, i))) AS INTEGER) AS n FROM (SELECT p_partkey, p_name, lead(p_name, 1, '') OVER (ORDER BY p_partkey) AS n FROM part)")
def str_prefix_length(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    after = p.select((c("p_partkey") - 1).alias("p_partkey"), c("p_name").alias("n"))
    return p.join(after, "p_partkey", "left").select("p_partkey", strings.common_prefix_length(c("p_name"), F.coalesce("n", F.lit(""))).alias("n"))


pinned("str_phonetic_refined", "s string", [("Braz",), ("Caren",), ("Hayers",), ("Lambard",), ("Nolton",), ("a-b",), ("",)], {"r": ("VARCHAR", lambda: strings.refined_soundex("s")), "z": ("VARCHAR", lambda: F.soundex("s"))}, [("B1905", "B620"), ("C30908", "C650"), ("H093", "H620"), ("L7081096", "L516"), ("N807608", "N435"), ("A01", "A100"), ("", "")])
pinned("str_jaro_halves", "a string, b string", [("MARTHA", "MARHTA"), ("DIXON", "DICKSONX"), ("abcdefgh", "acdbefgh"), ("", "x"), (None, "x")], {"j": ("DOUBLE", lambda: F.round(strings.jaro("a", "b"), 6))}, [(0.944444,), (0.766667,), (0.9375,), (0.0,), (None,)])
pinned("str_printf", "a bigint, x double, s string", [(42, 3.14159, "it's"), (-7, 1e10, None), (1234567, 0.00001234, "abc")],
    {"f": ("VARCHAR", lambda: strings.mixed_format("%d|%5d|%-5d|%05d|%+d|%x", c("a"), c("a"), c("a"), c("a"), c("a"), F.abs("a"))), "g": ("VARCHAR", lambda: strings.mixed_format("%.2f|%g|%.3e", c("x"), c("x"), c("x"))),
     "q": ("VARCHAR", lambda: strings.mixed_format("%Q %5.2s|%c%%", c("s"), c("s"), c("s"))), "k": ("VARCHAR", lambda: strings.mixed_format("%,d %*d", c("a"), F.lit(9), c("a"))), "m": ("VARCHAR", lambda: strings.mixed_format("[%d][%s]"))},
    [("42|   42|42   |00042|+42|2a", "3.14|3.14159|3.142e+00", "'it''s'    it|i%", "42        42", "[0][]"), ("-7|   -7|-7   |-0007|-7|7", "10000000000.00|1e+10|1.000e+10", "NULL      |%", "-7        -7", "[0][]"),
     ("1234567|1234567|1234567|1234567|+1234567|12d687", "0.00|1.234e-05|1.234e-05", "'abc'    ab|a%", "1,234,567   1234567", "[0][]")])
pinned("str_uuid_canonical", "s string", [("a0EEBC99-9C0B-4EF8-BB6D-6BB9BD380A11",), ("{a0eebc999c0b4ef8bb6d6bb9bd380a11}",), ("a0ee-bc99-9c0b-4ef8-bb6d-6bb9-bd38-0a11",), ("zz",), (None,)], {"u": ("VARCHAR", lambda: strings.uuid_text(c("s"))), "b": ("VARCHAR", lambda: F.hex(strings.uuid_blob(c("s"))))},
    [("a0eebc99-9c0b-4ef8-bb6d-6bb9bd380a11", "A0EEBC999C0B4EF8BB6D6BB9BD380A11")] * 3 + [(None, None)] * 2)


@query("SELECT n_nationkey, true AS version4, true AS fresh, 16 AS n, '00000000' AS z FROM nation")
def str_random(spark: SparkSession, d: str) -> DataFrame:
    u = read(spark, d, "nation").select("n_nationkey", F.uuid().alias("u"), strings.randomblob(16).alias("b"), F.rand().alias("r"))
    pattern = "^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
    return u.select("n_nationkey", c("u").rlike(pattern).alias("version4"), c("r").between(0, 1).alias("fresh"), F.octet_length("b").alias("n"), F.hex(strings.zeroblob(4)).alias("z"))


_TEXTS = ["", "abc", "Ärger", "The quick brown fox jumps over the lazy dog"]
pinned("hash_sha2_long", "s string", [(t,) for t in _TEXTS], {"a": ("VARCHAR", lambda: F.sha2("s", 384)), "b": ("VARCHAR", lambda: F.sha2("s", 512)), "e": ("VARCHAR", lambda: F.sha2("s", 224))}, [tuple(getattr(hashlib, f"sha{n}")(t.encode()).hexdigest() for n in (384, 512, 224)) for t in _TEXTS])
pinned("enc_base85_blob", "h string", [("000102030405",), ("0001020304",), ("00010203",), ("",)], {"e": ("VARCHAR", lambda: strings.base85(F.unhex("h"))), "b": ("VARCHAR", lambda: F.hex(strings.unbase85(strings.base85(F.unhex("h"))))), "ok": ("BOOLEAN", lambda: strings.is_base85(F.concat(F.lit(" "), strings.base85(F.unhex("h"))))), "b64": ("VARCHAR", lambda: strings.base64_lines(F.unhex("h")))},
    [("##/2,#2/\n", "000102030405", True, "AAECAwQF\n"), ("##/2,#*\n", "0001020304", True, "AAECAwQ=\n"), ("##/2,\n", "00010203", True, "AAECAw==\n"), ("", "", True, "")])
pinned("enc_base32_rot13", "s string", [("foobar",), ("Hello, World",), ("",)], {"b": ("VARCHAR", lambda: strings.base32("s")), "r": ("VARCHAR", lambda: strings.rot13(c("s")))}, [("MZXW6YTBOI======", "sbbone"), ("JBSWY3DPFQQFO33SNRSA====", "Uryyb, Jbeyq"), ("", "")])
sql("enc_url_roundtrip", "SELECT page_id, url_encode(url) AS e, url_decode(url_encode(url)) AS b FROM {pages}")
pinned("sort_uint_collation", "s string", [("x9",), ("x10",), ("x00123y",), ("x0122z",), ("x100000000000000000000",)], {"r": ("INTEGER", lambda: F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(strings.uint_key(c("s")))))}, [(1,), (2,), (4,), (3,), (5,)])
pinned("sort_rtrim_collation", "a string, b string", [("x", "x  "), ("x", " x"), ("X", "x"), ("x", "y ")], {"same": ("BOOLEAN", lambda: F.collate("a", "UTF8_BINARY_RTRIM") == F.collate("b", "UTF8_BINARY_RTRIM")), "nocase": ("BOOLEAN", lambda: F.collate("a", "UTF8_LCASE") == F.collate("b", "UTF8_LCASE"))}, [(True, False), (False, False), (False, True), (False, False)])
pinned("sort_locale_collation", "s string", [("cote",), ("côte",), ("Cote",), ("coté",)], {"same": ("BOOLEAN", lambda: F.collate("s", "fr_CI_AI") == F.collate(F.lit("cote"), "fr_CI_AI"))}, [(True,)] * 4)
pinned("ip_addresses", "a string, n string", [("192.168.16.12", "192.168.16.3/24"), ("10.0.0.1", "192.168.16.0/24"), ("2001:db8::123", "2001:db8::/32"), ("nope", "1.2.3.4/8")],
    {"fam": ("INTEGER", lambda: numbers.ip_family("a")), "inside": ("BOOLEAN", lambda: numbers.ip_contains("n", "a")), "host": ("VARCHAR", lambda: numbers.ip_host("n")), "len": ("INTEGER", lambda: numbers.ip_mask_length("n")), "net": ("VARCHAR", lambda: numbers.ip_network("n"))},
    [(4, True, "192.168.16.3", 24, "192.168.16.0/24"), (4, False, "192.168.16.0", 24, "192.168.16.0/24"), (6, True, "2001:db8::", 32, "2001:db8::/32"), (None, None, "1.2.3.4", 8, "1.0.0.0/8")])


@query("SELECT string_agg(n_name, ' ' ORDER BY n_name) AS e FROM nation WHERE n_regionkey = 1")
def str_eval(spark: SparkSession, d: str) -> DataFrame:
    return relational.evaluate(spark, "SELECT n_name FROM {nation} WHERE n_regionkey = 1 ORDER BY n_name", " ", nation=read(spark, d, "nation")).select(c("result").alias("e"))


# --- numbers and dates ---------------------------------------------------------------------

sql("math_hyperbolic", "SELECT p_partkey, round(sinh(p_size / 25.0), 6) AS sh, round(cosh(p_size / 25.0), 6) AS ch, round(tanh(p_size / 25.0), 6) AS th, round(asinh(p_size), 6) AS ash, round(acosh(p_size), 6) AS ach, round(atanh(p_size / 100.0), 6) AS ath, round(radians(p_size), 6) AS r FROM {part}")


@query("SELECT l_orderkey, l_linenumber, CAST(l_quantity % 4 AS DOUBLE) AS m, CAST(trunc(-l_quantity / 7) AS DOUBLE) AS t FROM lineitem")
def math_mod_trunc(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", numbers.mod(c("l_quantity"), F.lit(4)).alias("m"), (dialect.truncate(-c("l_quantity") / 7) + F.lit(0.0)).alias("t"))


pinned("math_round_digits", "x double, n int", [(2.5, 0), (-2.5, 0), (0.15, 1), (1.005, 2), (1234.5678, -2), (None, 1), (2.675, 2)], {"r": ("DOUBLE", lambda: numbers.round_half_away(c("x"), c("n")))}, [(3.0,), (-3.0,), (0.2,), (1.01,), (1235.0,), (None,), (2.68,)])
pinned("math_ieee754", "x double", [(1.0,), (2.0,), (0.5,), (1.5,), (0.0,), (4.9406564584124654e-324,), (2.2250738585072014e-308,), (-1.5,), (45.25,)], {"t": ("VARCHAR", lambda: numbers.ieee754("x")), "m": ("BIGINT", lambda: numbers.mantissa("x")), "back": ("DOUBLE", lambda: numbers.from_ieee754(numbers.mantissa("x"), numbers.exponent("x")))},
    [("ieee754(1,0)", 1, 1.0), ("ieee754(2,0)", 2, 2.0), ("ieee754(1,-1)", 1, 0.5), ("ieee754(3,-1)", 3, 1.5), ("ieee754(0,-1075)", 0, 0.0), ("ieee754(1,-1074)", 1, 5e-324), ("ieee754(1,-1022)", 1, 2.2250738585072014e-308), ("ieee754(-3,-1)", -3, -1.5), ("ieee754(181,-2)", 181, 45.25)])
pinned("math_decimal_text", "a string, b string", [("1.10", "2.2"), ("100000000000000000000000000000000000000000.5", "0.5"), ("-3", "7"), ("x", "1"), ("1e3", "0.001")], {"s": ("VARCHAR", lambda: numbers.decimal_add("a", "b")), "d": ("VARCHAR", lambda: numbers.decimal_sub("a", "b")), "p": ("VARCHAR", lambda: numbers.decimal_mul("a", "b")), "o": ("INTEGER", lambda: numbers.decimal_cmp("a", "b"))},
    [("3.30", "-1.10", "2.420", -1), ("100000000000000000000000000000000000000001.0", "100000000000000000000000000000000000000000.0", "50000000000000000000000000000000000000000.25", 1), ("4", "-10", "-21", -1), (None, None, None, None), ("1000.001", "999.999", "1", 1)])


@query("SELECT c_nationkey, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS VARCHAR) AS s FROM customer GROUP BY c_nationkey")
def math_decimal_sum(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").groupBy("c_nationkey").agg(numbers.decimal_sum(F.format_string("%.2f", "c_acctbal"), 2).alias("s"))


pinned("date_text_inputs", "s string", [("2024-02-29",), ("2024-02-29 13:05",), ("2024-02-29T13:05:06.250",), ("2460369.5",), ("12:30",), ("2024-13-01",), ("now what",), (None,)],
    {"d": ("VARCHAR", lambda: dt.date(c("s"))), "t": ("VARCHAR", lambda: dt.time(c("s"))), "e": ("VARCHAR", lambda: dt.datetime(c("s"), "+1 day"))},
    [("2024-02-29", "00:00:00", "2024-03-01 00:00:00"), ("2024-02-29", "13:05:00", "2024-03-01 13:05:00"), ("2024-02-29", "13:05:06", "2024-03-01 13:05:06"), ("2024-02-29", "00:00:00", "2024-03-01 00:00:00"), ("2000-01-01", "12:30:00", "2000-01-02 12:30:00"), (None, None, None), (None, None, None), (None, None, None)])
pinned("date_number_inputs", "x double", [(1709211906.0,), (2460369.5,), (0.0,)], {"u": ("VARCHAR", lambda: dt.datetime(c("x"), "unixepoch")), "j": ("VARCHAR", lambda: dt.datetime(F.when(c("x").between(0, 5373484), c("x")), "julianday")), "a": ("VARCHAR", lambda: dt.datetime(c("x"), "auto"))},
    [("2024-02-29 13:05:06", None, "2024-02-29 13:05:06"), ("1970-01-29 11:26:09", "2024-02-29 00:00:00", "2024-02-29 00:00:00"), ("1970-01-01 00:00:00", "-4713-11-24 12:00:00", "-4713-11-24 12:00:00")])


@query("SELECT event_id, strftime(ts + INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M:%S') AS l, strftime(ts - INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M:%S') AS u FROM events")
def date_localtime_utc(spark: SparkSession, d: str) -> DataFrame:
    f = lambda x: F.date_format(x, "yyyy-MM-dd HH:mm:ss")
    ts = c("ts").cast("timestamp")
    return read(spark, d, "events").select("event_id", f(dt.localtime(ts, "+05:30")).alias("l"), f(dt.utc(ts, "+05:30")).alias("u"))


@query("SELECT event_id, event_id * 1500000 AS us, CAST(event_id * 1.5 AS DOUBLE) AS s, round(event_id * 1.5 / 60, 6) AS m, event_id * 1500000000 // 60000000000 * 60000000000 AS tr, (event_id * 1500000000 + 30000000000) // 60000000000 * 60000000000 AS r FROM events")
def date_durations(spark: SparkSession, d: str) -> DataFrame:
    ns = c("event_id") * dt.MILLISECOND * 1500
    return read(spark, d, "events").select("event_id", dt.to_micro(ns).alias("us"), F.round(dt.to_seconds(ns), 6).alias("s"), F.round(dt.to_minutes(ns), 6).alias("m"), dt.truncated(ns, dt.MINUTE).alias("tr"), dt.rounded(ns, dt.MINUTE).alias("r"))


# --- JSON ----------------------------------------------------------------------------------


@query("SELECT event_id, CAST(json(props) AS VARCHAR) AS m, json_extract_string(props, '$.k') AS k, CAST(json(props)->'k' AS VARCHAR) AS a, '[' || event_id || ',\"' || event_type || '\",' || json(props) || ']' AS l, '{\"e\":\"' || event_type || '\",\"n\":' || user_id || ',\"p\":' || json(props) || '}' AS o FROM events")
def json_constructors(spark: SparkSession, d: str) -> DataFrame:
    p = jsontext.Nested(jsontext.json(c("props")))
    return read(spark, d, "events").select(
        "event_id", p.column.alias("m"), jsons.arrow_text(c("props"), "k").alias("k"), jsons.arrow(c("props"), "k").alias("a"),
        jsontext.array(c("event_id"), c("event_type"), p).alias("l"), jsontext.object_(e=c("event_type"), n=c("user_id"), p=p).alias("o"),
    )


@query("SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '69'")
def json_expression_index(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").where(jsons.arrow_text(c("props"), "k") == "69").select("event_id")


pinned("json_json5", "s string", [("{a:0x10,'b':.5,c:[1,2,],}",), (' { "a" : [1, 2.50] } ',), ('{"a":null}',)], {"m": ("VARCHAR", lambda: jsontext.json(c("s"))), "v1": ("BOOLEAN", lambda: jsontext.json_valid(c("s"), 1)), "v2": ("BOOLEAN", lambda: jsontext.json_valid(c("s"), 2)), "v4": ("BOOLEAN", lambda: jsontext.json_valid(c("s"), 4))},
    [('{"a":16,"b":0.5,"c":[1,2]}', False, True, False), ('{"a":[1,2.50]}', True, True, False), ('{"a":null}', True, True, False)])
pinned("json_error_places", "s string", [('{a:null,{"h":[1,[1,2,3]],"j":"abc"}:true}',), ('{"a":1}',), ("[1",)], {"e": ("INTEGER", lambda: jsontext.json_error_position(c("s")))}, [(9,), (0,), (3,)])
pinned("json_quoted", "s string, n bigint", [("a\"b", 3), (None, None), ("é", -1)], {"t": ("VARCHAR", lambda: jsontext.quote(c("s"))), "n": ("VARCHAR", lambda: jsontext.quote(c("n"))), "j": ("VARCHAR", lambda: jsontext.quote(jsontext.Nested(F.lit("[1]"))))}, [('"a\\"b"', "3", "[1]"), ("null", "null", "[1]"), ('"é"', "-1", "[1]")])
pinned("json_several_paths", "j string", [('{"a":1,"b":[1,[2,3]],"c":"x"}',)], {"e": ("VARCHAR", lambda: jsons.json_extract_all(c("j"), "$.a", "$.b[1]", "$.c", "$.z")), "k": ("VARCHAR", lambda: jsons.arrow(c("j"), 0)), "s": ("VARCHAR", lambda: jsons.arrow(c("j"), "$.c")), "t": ("VARCHAR", lambda: jsons.arrow_text(c("j"), "c")), "x": ("VARCHAR", lambda: jsons.arrow(F.lit("[7,8]"), 1))}, [('[1,[2,3],"x",null]', None, '"x"', "x", "8")])
_J = '{"a":1,"b":[1,[2,3],4],"c":"x y"}'
pinned("json_mutated", "j string", [(_J,)], {"s": ("VARCHAR", lambda: jsons.json_set(c("j"), "$.b[#]", 9)), "n": ("VARCHAR", lambda: jsons.json_insert(c("j"), "$.a", 0)), "r": ("VARCHAR", lambda: jsons.json_replace(c("j"), "$.a", 0)), "d": ("VARCHAR", lambda: jsons.json_remove(c("j"), "$.b[0]", "$.b[0]")), "p": ("VARCHAR", lambda: jsons.json_patch(c("j"), {"c": None, "n": {"k": 1}}))},
    [('{"a":1,"b":[1,[2,3],4,9],"c":"x y"}', _J, '{"a":0,"b":[1,[2,3],4],"c":"x y"}', '{"a":1,"b":[4],"c":"x y"}', '{"a":1,"b":[1,[2,3],4],"n":{"k":1}}')])


@query("SELECT * FROM (VALUES (1, '{\"F\":1,\"F\":2,\"O\":3}')) AS t(g, o)")
def json_group_repeated_keys(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(1, "F", 1), (1, "O", 3), (1, "F", 2)], "g int, k string, v int").groupBy("g").agg(relational.json_group_object(c("k"), c("v")).alias("o"))


@query("""SELECT * FROM (VALUES (NULL, '{"a":[1,{"b":null}],"c d":"x"}', 'object', NULL, '$'), ('a', '[1,{"b":null}]', 'array', NULL, '$.a'), ('0', '1', 'integer', '1', '$.a[0]'), ('1', '{"b":null}', 'object', NULL, '$.a[1]'), ('b', NULL, 'null', NULL, '$.a[1].b'), ('c d', 'x', 'text', 'x', '$."c d"')) AS t("key", "value", "type", atom, fullkey)""")
def json_tree_nodes(spark: SparkSession, d: str) -> DataFrame:
    spark.udtf.register("lumenql_json_tree", jsons.JsonTree)
    doc = spark.createDataFrame([('{"a":[1,{"b":null}],"c d":"x"}',)], "j string")
    return spark.sql("SELECT t.key, t.value, t.type, t.atom, t.fullkey FROM {t}, LATERAL lumenql_json_tree(j) AS t", t=doc)


# --- search and vectors --------------------------------------------------------------------

_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"


@query(f"SELECT item_id FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE list_contains(w, 'the') AND (list_contains(w, 'of') OR len(list_filter(w, lambda x: starts_with(x, 'thes'))) > 0) AND NOT list_contains(w, 'and')")
def fts_grammar(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "benchmark").where(search.matches({"text": c("text")}, "the (of OR thes*) NOT and")).select("item_id")


@query(f"SELECT item_id FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'the')) > 0 OR w[1] = 'the'")
def fts_phrase_first(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "benchmark").where(search.matches({"text": c("text")}, '"of the" OR ^the')).select("item_id")


pinned("fts_columns", "a string, b string", [("one two", "three four"), ("three", "one"), ("x", "y")], {"m": ("BOOLEAN", lambda: search.matches({"a": c("a"), "b": c("b")}, "a : one")), "n": ("BOOLEAN", lambda: search.matches({"a": c("a"), "b": c("b")}, "{a b} : three + four")), "o": ("BOOLEAN", lambda: search.matches({"a": c("a"), "b": c("b")}, "- a : one")), "p": ("BOOLEAN", lambda: search.matches({"a": c("a"), "b": c("b")}, "NEAR(one two, 0) OR y"))},
    [(True, True, False, True), (False, False, True, False), (False, False, False, True)])


@query(f"SELECT item_id, CAST(len(list_filter({_WORDS}, lambda x: x = 'the')) AS INTEGER) AS n, coalesce(list_transform(list_filter(range(1, len({_WORDS}) + 1), lambda i: {_WORDS}[i] = 'the'), lambda i: CAST(i - 1 AS INTEGER)), []) AS places FROM benchmark")
def fts_offsets(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "benchmark").select("item_id", F.size(search.offsets(c("text"), "the")).alias("n"), search.offsets(c("text"), "the").alias("places"))


pinned("fts_snippet", "s string", [("a b c d the e f g h i j the of k l m",), ("nothing here",), ("the end",)], {"s": ("VARCHAR", lambda: search.snippet(c("s"), ["the", "of"], 4)), "h": ("VARCHAR", lambda: search.highlight(c("s"), ["the", "of"]))}, [("…[the] [of] k l…", "a b c d [the] e f g h i j [the] [of] k l m"), ("nothing here", "nothing here"), ("[the] end", "[the] end")])
pinned("fts_tokenizers", "s string", [("Running, thé CAT's x_1",)], {"u": ("VARCHAR", lambda: F.array_join(search.terms(c("s"), "unicode61"), " ")), "a": ("VARCHAR", lambda: F.array_join(search.terms(c("s"), "ascii"), " ")), "t": ("VARCHAR", lambda: F.array_join(search.terms(F.lit("abcd"), "trigram"), " ")), "k": ("VARCHAR", lambda: F.array_join(search.terms(c("s"), "unicode61", token_chars="_"), " "))}, [("running the cat s x 1", "running thé cat s x 1", "abc bcd", "running the cat s x_1")])


@query("SELECT n_name AS word, CAST(levenshtein(n_name, 'NATON_1') AS INTEGER) AS distance FROM nation WHERE levenshtein(n_name, 'NATON_1') <= 2")
def fts_spelling(spark: SparkSession, d: str) -> DataFrame:
    return search.spelling(read(spark, d, "nation").select(c("n_name").alias("word")), "NATON_1", 2)


pinned("vec_text", "s string", [("[1, 2.5,-3]",), ("[]",), ("nope",)], {"v": ("VARCHAR", lambda: vectors.vector_text(vectors.vector(c("s")))), "n": ("INTEGER", lambda: F.size(vectors.vector(c("s"))))}, [("[1,2.5,-3]", 3), ("[]", 0), (None, None)])


@query("SELECT e.vec_id, CAST(list_sum(list_transform(range(1, len(e.embedding) + 1), lambda i: CASE WHEN (e.embedding[i] > 0) <> (q.embedding[i] > 0) THEN 1 ELSE 0 END)) AS INTEGER) AS h FROM embeddings e, embeddings q WHERE q.vec_id = 0")
def vec_one_bit(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings")
    q = F.array(*[F.lit(float(x)) for x in e.where("vec_id = 0").first()["embedding"]])
    return e.select("vec_id", vectors.hamming1(vectors.bits1(c("embedding")), vectors.bits1(q)).cast("int").alias("h"))


pinned("vec_eight_bit", "i2 int", [(0,)], {"q": ("VARCHAR", lambda: F.to_json(vectors.quantize8(F.array(F.lit(0.0), F.lit(255.0), F.lit(100.4), F.lit(50.6)))["q"])), "b": ("VARCHAR", lambda: F.to_json(vectors.dequantize8(vectors.quantize8(F.array(F.lit(-1.0), F.lit(1.0))))))}, [("[0,255,100,51]", "[-1.0,1.0]")])


# --- changes of tables ---------------------------------------------------------------------


def _shop(spark: SparkSession, d: str) -> tables.Store:
    c_ = read(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_nationkey")
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    n = read(spark, d, "nation").select("n_nationkey", "n_name")
    s = tables.Store().create("nation", n, key=("n_nationkey",))
    s = s.create("customer", c_, key=("c_custkey",), defaults={"c_name": F.lit("new"), "c_acctbal": F.lit(0.0)}, generated={"c_level": "CAST(floor(c_acctbal / 1000) AS BIGINT)"}, checks={"balance": "c_acctbal >= -1000"}, foreign={"c_nationkey": ("nation", "n_nationkey", "cascade")})
    return s.create("orders", o, key=("o_orderkey",), foreign={"o_custkey": ("customer", "c_custkey", "cascade")})


_C = "SELECT c_custkey, c_name, c_acctbal, c_nationkey FROM customer"


@query(f"SELECT c_custkey, c_name, c_acctbal, c_nationkey, CAST(floor(c_acctbal / 1000) AS BIGINT) AS c_level FROM ({_C} UNION ALL SELECT -1, 'x', 2500.0, 3 UNION ALL SELECT -2, 'new', 0.0, 4)")
def dml_insert_values(spark: SparkSession, d: str) -> DataFrame:
    s = _shop(spark, d).insert("customer", spark.sql("SELECT -1 AS c_custkey, 'x' AS c_name, 2500.0 AS c_acctbal, 3 AS c_nationkey")).insert("customer", spark.sql("VALUES (-2, 4) AS t(c_custkey, c_nationkey)"))
    return s["customer"]


@query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT n_nationkey + 100, n_name || '!' FROM nation WHERE n_regionkey = 2")
def dml_insert_from_cte(spark: SparkSession, d: str) -> DataFrame:
    new = spark.sql("WITH t AS (SELECT n_nationkey + 100 AS n_nationkey, n_name || '!' AS n_name FROM {nation} WHERE n_regionkey = 2) SELECT * FROM t", nation=read(spark, d, "nation"))
    return _shop(spark, d).insert("nation", new)["nation"]


@query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT 90, 'a'")
def dml_insert_ignore(spark: SparkSession, d: str) -> DataFrame:
    new = spark.createDataFrame([(3, "z", 0), (90, "b", 2), (90, "a", 1)], "n_nationkey int, n_name string, _order int")
    return _shop(spark, d).insert("nation", new, on_conflict="ignore")["nation"]


@query("SELECT CAST(1 AS INTEGER) AS k, 'd' AS v UNION ALL SELECT NULL, 'd'")
def dml_insert_defaults(spark: SparkSession, d: str) -> DataFrame:
    s = tables.Store().create("t", spark.createDataFrame([(1, "d")], "k int, v string"), defaults={"v": F.lit("d")})
    return s.insert_defaults("t")["t"]


@query("SELECT * FROM (VALUES ('insert abort', true), ('check', true), ('foreign key', true), ('not in use', true)) AS t(what, refused)")
def dml_constraint_errors(spark: SparkSession, d: str) -> DataFrame:
    s = _shop(spark, d)
    tries = {
        "insert abort": lambda: s.insert("nation", spark.createDataFrame([(3, "z")], "n_nationkey int, n_name string")),
        "check": lambda: s.update("customer", {"c_acctbal": F.lit(-5000.0)}),
        "foreign key": lambda: s.insert("orders", spark.createDataFrame([(-5, -9, 1.0)], "o_orderkey bigint, o_custkey bigint, o_totalprice double")),
        "not in use": lambda: s.drop_column("customer", "c_acctbal"),
    }
    out = []
    for what, run in tries.items():
        try:
            run()
            out.append((what, False))
        except tables.ConstraintError:
            out.append((what, True))
    return spark.createDataFrame(out, "what string, refused boolean")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_totalprice < 200000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 25)")
def dml_delete_limit(spark: SparkSession, d: str) -> DataFrame:
    s = _shop(spark, d).delete("orders", c("o_totalprice") < 200000, order=[F.desc("o_totalprice"), c("o_orderkey")], limit=25)
    return s["orders"].select("o_orderkey")


@query("SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 9) THEN 0.0 ELSE o_totalprice END AS o_totalprice FROM orders")
def dml_update_limit(spark: SparkSession, d: str) -> DataFrame:
    s = _shop(spark, d).update("orders", {"o_totalprice": F.lit(0.0)}, order=[c("o_totalprice"), c("o_orderkey")], limit=9)
    return s["orders"].select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey <> 7")
def ddl_foreign_key_cascade(spark: SparkSession, d: str) -> DataFrame:
    return _shop(spark, d).delete("nation", c("n_nationkey") == 7)["orders"].select("o_orderkey")


@query(f"SELECT c_custkey, round(c_acctbal * 2, 2) AS balance, CAST(floor(c_acctbal * 2 / 1000) AS BIGINT) AS c_level, CAST(NULL AS VARCHAR) AS note FROM ({_C}) WHERE c_acctbal * 2 >= -1000")
def ddl_generated_and_altered(spark: SparkSession, d: str) -> DataFrame:
    s = _shop(spark, d).delete("customer", c("c_acctbal") * 2 < -1000).rename_column("customer", "c_acctbal", "balance").add_column("customer", "note", "string").drop_column("customer", "c_name")
    s = s.update("customer", {"balance": F.col("balance") * 2})
    return s["customer"].select("c_custkey", F.round("balance", 2).alias("balance"), "c_level", "note")


@query("SELECT n_nationkey AS k, 'gone ' || n_name AS what FROM nation WHERE n_regionkey = 0 UNION ALL SELECT 77, 'came v'")
def ddl_triggers(spark: SparkSession, d: str) -> DataFrame:
    log = spark.createDataFrame([], "k int, what string")
    s = _shop(spark, d).create("log", log)
    s = s.trigger("nation", "after delete", lambda st, rows: st.insert("log", rows.select(c("n_nationkey").alias("k"), F.concat(F.lit("gone "), "n_name").alias("what"))))
    s = s.view("names", lambda st: st["nation"].select("n_name")).trigger("names", "instead of insert", lambda st, rows: st.insert("log", rows.select(F.lit(77).alias("k"), F.concat(F.lit("came "), "n_name").alias("what"))))
    regions = read(spark, d, "nation").where("n_regionkey = 0").select("n_nationkey").collect()
    s = s.delete("nation", c("n_nationkey").isin([r[0] for r in regions]))
    return s.insert("names", spark.createDataFrame([("v",)], "n_name string"))["log"]


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey <> 1 AND n_nationkey <> 3")
def txn_savepoints(spark: SparkSession, d: str) -> DataFrame:
    s = _shop(spark, d).savepoint("begin").delete("nation", c("n_nationkey") == 1).savepoint("a").delete("nation", c("n_nationkey") == 2).rollback("a")
    s = s.delete("nation", c("n_nationkey") == 3).release("a").commit()
    return s["nation"]


@query("SELECT n_nationkey, n_name FROM nation")
def txn_rollback(spark: SparkSession, d: str) -> DataFrame:
    return _shop(spark, d).savepoint("begin").delete("nation", c("n_nationkey") > 1).rollback()["nation"]


@query("""SELECT 'n_nationkey' AS "column", count(*) AS n_rows, count(DISTINCT n_nationkey) AS n_distinct, count(*) FILTER (WHERE n_nationkey IS NULL) AS n_null FROM nation
UNION ALL SELECT 'n_name', count(*), count(DISTINCT n_name), 0 FROM nation UNION ALL SELECT 'n_regionkey', count(*), count(DISTINCT n_regionkey), 0 FROM nation""")
def ddl_analyze(spark: SparkSession, d: str) -> DataFrame:
    return tables.statistics(read(spark, d, "nation"))


@query("SELECT * FROM (VALUES ('customer', 'c_acctbal', 'sort', 1), ('orders', 'o_custkey', 'bucket', 2)) AS t(\"table\", \"column\", layout, uses)")
def ddl_index_advice(spark: SparkSession, d: str) -> DataFrame:
    texts = ["SELECT * FROM orders WHERE o_custkey = 5", "SELECT * FROM orders o WHERE o.o_custkey IN (1, 2)", "SELECT * FROM customer WHERE c_acctbal > 10 AND c_name <> 'x = 1'"]
    known = {t: read(spark, d, t).columns for t in ("orders", "customer")}
    return spark.createDataFrame(tables.advise(texts, known), "table string, column string, layout string, uses int")


@query()
def ddl_explain(spark: SparkSession, d: str) -> DataFrame:
    """EXPLAIN as rows of text, in order."""
    return readers.explained(read(spark, d, "orders").where("o_orderkey = 5").select("o_custkey"))


# --- files and sources ---------------------------------------------------------------------


def _folder(spark: SparkSession) -> str:
    return os.path.join(changelog.shared_folder(spark), f"files-{uuid.uuid4().hex}")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def sink_create_as_select(spark: SparkSession, d: str) -> DataFrame:
    return sinks.create_as(read(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice"), f"{_folder(spark)}/t")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def sink_compact_copy(spark: SparkSession, d: str) -> DataFrame:
    return sinks.compact(read(spark, d, "nation").repartition(8), f"{_folder(spark)}/copy")


@query("SELECT 'INSERT INTO nation VALUES(' || n_nationkey || ',''' || n_name || ''',' || n_regionkey || ');' AS line FROM nation")
def sink_dump(spark: SparkSession, d: str) -> DataFrame:
    to = f"{_folder(spark)}/dump"
    sinks.dump(read(spark, d, "nation"), "nation", to)
    return spark.read.text(to).select(c("value").alias("line"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey BETWEEN 5 AND 14")
def src_shards(spark: SparkSession, d: str) -> DataFrame:
    base, n = _folder(spark), read(spark, d, "nation")
    parts = {}
    for i in range(3):
        n.where(c("n_nationkey").between(10 * i, 10 * i + 9)).write.parquet(f"{base}/{i}")
        parts[f"{base}/{i}"] = (10 * i, 10 * i + 9)
    return readers.shards(spark, parts, "n_nationkey", 5, 14)


@query("SELECT * FROM (VALUES ('a/x.txt', 'one'), ('y.txt', 'two')) AS t(name, body)")
def src_zip(spark: SparkSession, d: str) -> DataFrame:
    to = f"{_folder(spark)}/z"
    sinks.write_files(spark.createDataFrame([("t.zip", sinks.zipped({"a/x.txt": b"one", "y.txt": b"two"}))], "name string, data binary"), to)
    return readers.zip_entries(spark, f"{to}/*.zip").select("name", c("data").cast("string").alias("body"))


@query("SELECT * FROM (VALUES ('a.txt', CAST(5 AS BIGINT), 'hello'), ('b.txt', 2, 'xy')) AS t(name, size, body)")
def src_files(spark: SparkSession, d: str) -> DataFrame:
    to = f"{_folder(spark)}/f"
    sinks.write_files(spark.createDataFrame([("a.txt", b"hello"), ("b.txt", b"xy")], "name string, data binary"), to)
    found = readers.files(spark, to, "*.txt").join(readers.read_files(spark, to), "path")
    return found.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "size", c("data").cast("string").alias("body"))


@query("SELECT doc_id, text FROM documents")
def src_archive_compress(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "documents")
    return t.select("doc_id", sinks.uncompress(sinks.compress(F.encode("text", "UTF-8"))).cast("string").alias("text"))


@query("SELECT * FROM (VALUES (1, 'x;y', CAST(2.5 AS DOUBLE)), (2, NULL, CAST(3.0 AS DOUBLE))) AS t(a, b, e)")
def src_separated_values(spark: SparkSession, d: str) -> DataFrame:
    return readers.csv(spark, data=['1;"x;y";2.5', "2;;3.0"], schema="a int, b string, e double", sep=";")


@query("SELECT v AS value FROM generate_series(1, 40) AS t(v)")
def src_wholenumber(spark: SparkSession, d: str) -> DataFrame:
    return readers.wholenumber(spark, 40)


@query("SELECT v AS value, v * v AS square FROM generate_series(1, 50) AS t(v)")
def src_user_defined(spark: SparkSession, d: str) -> DataFrame:
    """A data source of a user's own: a schema, options, partitions and rows of each."""
    spark.dataSource.register(readers.Squares)
    return spark.read.format("lumenql_squares").option("first", 1).option("last", 50).option("parts", 3).load()


@query("SELECT a.n_name, b.r_name FROM nation a JOIN region b ON a.n_regionkey = b.r_regionkey")
def src_attached(spark: SparkSession, d: str) -> DataFrame:
    one, two = readers.Attached(spark, "one", d), readers.Attached(spark, "two", d)
    return readers.run_attached(spark, "SELECT a.n_name, b.r_name FROM one.nation AS a JOIN two.region AS b ON a.n_regionkey = b.r_regionkey", one, two)


@query("SELECT * FROM (VALUES ('lumenql_seen', 'n_name', 'string', 1), ('lumenql_seen', 'n_nationkey', 'int', 0)) AS t(name, \"column\", type, position)")
def src_catalog(spark: SparkSession, d: str) -> DataFrame:
    read(spark, d, "nation").select("n_nationkey", "n_name").createOrReplaceTempView("lumenql_seen")
    return readers.catalog(spark).where("name = 'lumenql_seen'")


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey BETWEEN 20 AND 60")
def src_sorted_table(spark: SparkSession, d: str) -> DataFrame:
    """Key-value rows in sorted files, searched by a key range: the files' statistics leave out what lies outside."""
    to = f"{_folder(spark)}/kv"
    sinks.sorted_by(read(spark, d, "part").select("p_partkey", "p_name"), "p_partkey", to)
    return spark.read.parquet(to).where(c("p_partkey").between(20, 60))


@query("SELECT TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 30 SECOND * (v + 1) AS tick FROM generate_series(0, 9) AS t(v)")
def stream_timer(spark: SparkSession, d: str) -> DataFrame:
    return changelog.interval(spark, "2024-01-01 00:00:00", 30, 10).select(c("tick").cast("timestamp_ntz").alias("tick"))


@query("SELECT CAST(epoch(TIMESTAMP '2024-12-31 00:00:00') AS BIGINT) - CAST(epoch(max(ts)) AS BIGINT) AS seconds_behind FROM events")
def stream_lag(spark: SparkSession, d: str) -> DataFrame:
    return changelog.lag(read(spark, d, "events"), "ts", "2024-12-31 00:00:00")


# --- functions of a user's own -------------------------------------------------------------


@query("SELECT c_custkey, CAST(length(c_name) * 2 + c_nationkey AS BIGINT) AS x FROM customer")
def udf_scalar(spark: SparkSession, d: str) -> DataFrame:
    @F.arrow_udf("bigint")
    def lumenql_mix(s: pa.Array, n: pa.Array) -> pa.Array:
        return pa.array([None if x is None or k is None else 2 * len(x) + k for x, k in zip(s.to_pylist(), n.to_pylist())], pa.int64())

    spark.udf.register("lumenql_mix", lumenql_mix)
    return spark.sql("SELECT c_custkey, lumenql_mix(c_name, c_nationkey) AS x FROM {customer}", customer=read(spark, d, "customer"))


@query("SELECT l_returnflag, round(exp(avg(ln(l_quantity))), 6) AS g FROM lineitem GROUP BY l_returnflag")
def udf_aggregate(spark: SparkSession, d: str) -> DataFrame:
    got = read(spark, d, "lineitem").groupBy("l_returnflag", F.pmod(F.xxhash64("l_orderkey"), F.lit(64)).alias("part"))
    # step: a sum of logarithms and a count by slices, so that no group comes to one task; value: their quotient
    steps = got.agg(relational.log_sum()("l_quantity").alias("s"), relational.positive_count()("l_quantity").alias("n"))
    return steps.groupBy("l_returnflag").agg(F.round(F.exp(F.sum("s") / F.sum("n")), 6).alias("g"))


@query("SELECT o_orderkey, round(exp(avg(ln(o_totalprice)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)), 4) AS g FROM orders")
def udf_window(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(-2, 0)
    return read(spark, d, "orders").select("o_orderkey", F.round(relational.geometric_mean()(F.collect_list("o_totalprice").over(w)), 4).alias("g"))


@query("SELECT p_partkey, p_size * p_size + 1 AS x FROM part")
def udf_sql_scalar(spark: SparkSession, d: str) -> DataFrame:
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION lumenql_poly(x INT) RETURNS INT RETURN x * x + 1")
    return spark.sql("SELECT p_partkey, lumenql_poly(p_size) AS x FROM {part}", part=read(spark, d, "part"))


@query("SELECT r_regionkey, v AS n FROM region, generate_series(1, 3) AS t(v) WHERE v <= r_regionkey + 1")
def udf_sql_table(spark: SparkSession, d: str) -> DataFrame:
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION lumenql_upto(k INT) RETURNS TABLE(n BIGINT) RETURN SELECT id AS n FROM range(1, 4) WHERE id <= k + 1")
    return spark.sql("SELECT r_regionkey, t.n FROM {region}, LATERAL lumenql_upto(r_regionkey) AS t", region=read(spark, d, "region"))


# --- replication ---------------------------------------------------------------------------


@query("SELECT '{\"n_nationkey\":' || n_nationkey || '}' AS pk, cid, val, CAST(seq AS INTEGER) AS seq, CAST(8 AS INTEGER) AS db_version, CAST(cl AS INTEGER) AS cl FROM (SELECT n_nationkey, 'n_name' AS cid, n_name || '!' AS val, 0 AS seq, 1 AS cl FROM nation WHERE n_nationkey % 3 = 1 UNION ALL SELECT n_nationkey, '-1', NULL, 0, 2 FROM nation WHERE n_nationkey % 3 = 2 UNION ALL SELECT 99, 'n_name', 'x', 0, 1 UNION ALL SELECT 99, 'n_regionkey', '4', 1, 1)")
def crdt_capture(spark: SparkSession, d: str) -> DataFrame:
    old = read(spark, d, "nation")
    new = old.where("n_nationkey % 3 <> 2").withColumn("n_name", F.when(c("n_nationkey") % 3 == 1, F.concat("n_name", F.lit("!"))).otherwise(c("n_name")))
    new = new.unionByName(spark.createDataFrame([(99, "x", 4)], "n_nationkey int, n_name string, n_regionkey int"))
    got = changes.capture(changes.diff(old, new, ["n_nationkey"]), "nation", ["n_nationkey"], 7, 1)
    return got.select("pk", "cid", "val", "seq", "db_version", "cl")


@query("SELECT * FROM (VALUES (1, 'a', '7', 'integer'), (1, 'b', 'z', 'text'), (2, '-1', NULL, 'null')) AS t(pk, cid, val, val_type)")
def crdt_merge_typed(spark: SparkSession, d: str) -> DataFrame:
    rows = [("t", 1, "a", "9", "text", 3, 1, 1), ("t", 1, "a", "7", "integer", 3, 1, 2), ("t", 1, "b", None, "null", 1, 1, 3), ("t", 1, "b", "z", "text", 1, 1, 1), ("t", 2, "a", "x", "text", 9, 1, 1), ("t", 2, "-1", None, "null", 2, 2, 2)]
    cells = spark.createDataFrame(rows, "tbl string, pk int, cid string, val string, val_type string, col_version int, cl int, site_id int")
    return changes.merge_cells(cells).select("pk", "cid", "val", "val_type")


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def crdt_packed_keys(spark: SparkSession, d: str) -> DataFrame:
    blob = changes.pack_columns(c("o_orderkey"), c("o_orderstatus"), c("o_totalprice"))
    kinds = ["bigint", "string", "double"]
    packed = read(spark, d, "orders").select(blob.alias("b"))
    return packed.select(*[changes.unpack_column(c("b"), kinds, k).alias(n) for k, n in enumerate(("o_orderkey", "o_orderstatus", "o_totalprice"))])


pinned("crdt_fractional_order", "a string, b string", [(None, None), ("V", None), (None, "V"), ("A", "B"), ("A", "AV")], {"ok": ("BOOLEAN", lambda: changes.between(c("a"), c("b")).isNotNull() & F.coalesce(changes.between(c("a"), c("b")) > c("a"), F.lit(True)) & F.coalesce(changes.between(c("a"), c("b")) < c("b"), F.lit(True)))}, [(True,)] * 5)


@query("SELECT op, o_orderkey FROM (SELECT 'delete' AS op, o_orderkey FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 3 = 0 UNION ALL SELECT 'insert', o_orderkey FROM orders WHERE o_orderkey % 11 = 0 AND o_orderkey % 3 <> 0)")
def concat_changesets(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").select("o_orderkey", "o_totalprice")
    a, b, e = o.where("o_orderkey % 11 <> 0"), o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 3 <> 0")
    return changes.concat(changes.diff(a, b, ["o_orderkey"]), changes.diff(b, e, ["o_orderkey"]), ["o_orderkey"]).select("op", "o_orderkey")


# --- further search, text and change operators ---------------------------------------------

_COSTS = {("a", "e"): 40, ("ph", "f"): 20, ("", "h"): 10}
pinned("str_editdist3", "a string, b string", [("phone", "fone"), ("cat", "cet"), ("cat", "chat"), ("", "x"), (None, "x")], {"d": ("INTEGER", lambda: strings.edit_distance3("a", "b", _COSTS))}, [(20,), (40,), (10,), (100,), (None,)])
pinned("str_transliterate", "s string", [("Ελλάδα",), ("Москва",), ("Straße é",), ("漢",)], {"t": ("VARCHAR", lambda: strings.transliterate(c("s"))), "k": ("INTEGER", lambda: strings.script_code(c("s")))}, [("Ellada", 200), ("Moskva", 220), ("Strasse e", 215), ("?", 999)])
pinned("str_utf8_case", "s string", [("straße ÉTÉ",), ("ab Cd",)], {"t": ("VARCHAR", lambda: strings.title_case(c("s"))), "f": ("VARCHAR", lambda: strings.casefold(c("s"))), "v": ("BOOLEAN", lambda: F.is_valid_utf8("s")), "n": ("INTEGER", lambda: F.octet_length("s"))}, [("Straße Été", "strasse été", True, 13), ("Ab Cd", "ab cd", True, 5)])
sql("date_parts", "SELECT event_id, year(ts) AS y, month(ts) AS m, day(ts) AS d, hour(ts) AS h, minute(ts) AS mi, dayofyear(ts) AS dy, quarter(ts) AS q, CAST(date_trunc('hour', ts) AS TIMESTAMP_NTZ) AS tr FROM {events}", "SELECT event_id, CAST(year(ts) AS INTEGER) AS y, CAST(month(ts) AS INTEGER) AS m, CAST(day(ts) AS INTEGER) AS d, CAST(hour(ts) AS INTEGER) AS h, CAST(minute(ts) AS INTEGER) AS mi, CAST(dayofyear(ts) AS INTEGER) AS dy, CAST(quarter(ts) AS INTEGER) AS q, date_trunc('hour', ts) AS tr FROM events")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(json(props) AS VARCHAR) AS t FROM events")
def json_binary(spark: SparkSession, d: str) -> DataFrame:
    v = jsons.jsonb(c("props"))
    return read(spark, d, "events").select("event_id", F.variant_get(jsons.jsonb_extract(v, "$.k"), "$", "bigint").alias("k"), jsons.jsonb_text(v).alias("t"))


@query(f"""WITH t AS (SELECT doc_id AS id, unnest({_WORDS}) AS word FROM documents), h AS (SELECT id, word, count(*) AS hits FROM t WHERE word IN ('from', 'when') GROUP BY ALL)
SELECT id, word, CAST(hits AS INTEGER) AS hits, CAST(sum(hits) OVER (PARTITION BY word) AS BIGINT) AS hits_all, count(*) OVER (PARTITION BY word) AS rows_all FROM h""")
def fts_matchinfo(spark: SparkSession, d: str) -> DataFrame:
    return search.match_info(read(spark, d, "documents"), "doc_id", "text", ["from", "when"])


@query(f"SELECT item_id AS id FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE list_contains(w, 'the') AND list_contains(w, 'of')")
def fts_contentless(spark: SparkSession, d: str) -> DataFrame:
    """An index without the texts: terms and places, written by term, then searched alone."""
    to = f"{_folder(spark)}/index"
    sinks.sorted_by(search.tokens(read(spark, d, "benchmark"), "item_id", "text"), "term", to)
    return search.with_all(spark.read.parquet(to), ["the", "of"])


@query("SELECT * FROM (VALUES ('NATION_10', 60), ('NATION_1', 20)) AS t(word, distance)")
def fts_fuzzer(spark: SparkSession, d: str) -> DataFrame:
    words = read(spark, d, "nation").select(c("n_name").alias("word"))
    return search.approximate(words, "NASION_1", [("S", "T", 20), ("_1", "_10", 40), ("A", "E", 5)], 60)


@query("""WITH k AS (SELECT event_id AS key, event_type AS cid, event_id % 3 + 1 AS col_version, event_id AS db_version, user_id % 3 AS site FROM events WHERE event_type <> 'error'
UNION ALL SELECT event_id, '-1', 2 * (event_id % 2) + 1, event_id, user_id % 3 FROM events WHERE event_type = 'view' OR event_type = 'click')
SELECT 'events' AS tbl, 'p' || k.key AS pk, cid, col_version, db_version, CASE WHEN site = 0 THEN NULL ELSE 's' || site END AS site_id, CAST(0 AS INTEGER) AS seq, coalesce(s.cl, 1) AS cl
FROM k LEFT JOIN (SELECT key, col_version AS cl FROM k WHERE cid = '-1') AS s ON k.key = s.key""")
def crdt_change_feed(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").withColumn("site", c("user_id") % 3)
    cells = e.where("event_type <> 'error'").select(c("event_id").alias("key"), c("event_type").alias("cid"), (c("event_id") % 3 + 1).alias("col_version"), c("event_id").alias("db_version"), "site", F.lit(0).alias("seq"))
    marks = e.where("event_type IN ('view', 'click')").select(c("event_id").alias("key"), F.lit("-1").alias("cid"), (2 * (c("event_id") % 2) + 1).alias("col_version"), c("event_id").alias("db_version"), "site", F.lit(0).alias("seq"))
    pks = e.select(c("event_id").alias("key"), F.concat(F.lit("p"), "event_id").alias("pk"))
    sites = spark.createDataFrame([(1, "s1"), (2, "s2")], "site bigint, site_id string")
    return changes.feed(cells.unionByName(marks), pks, sites, "events")


@query("SELECT event_id, event_type FROM events WHERE event_id < 700")
def stream_verified_log(spark: SparkSession, d: str) -> DataFrame:
    """A log with a wrong checksum at 800 and a record missing at 700."""
    e = read(spark, d, "events").where("event_id <> 700")
    crc = F.crc32(c("event_type").cast("binary"))
    log = e.select("event_id", "event_type", F.when(c("event_id") == 800, crc + 1).otherwise(crc).alias("crc"))
    return changelog.verified(log, "event_id", "event_type", "crc").select("event_id", "event_type")


@query("(SELECT 'page' AS what, event_id FROM events WHERE event_id > 40 ORDER BY event_id LIMIT 5) UNION ALL SELECT 'left', event_id FROM events WHERE event_id > 90 UNION ALL SELECT 'oldest', CAST(-1 AS BIGINT) UNION ALL SELECT 'latest', max(event_id) FROM events")
def stream_subscription(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select("event_id")
    acks = spark.createDataFrame([("a", 40), ("a", 120), ("b", 90)], "who string, event_id bigint")
    starts = spark.createDataFrame([(s, changelog.start_of(e, "event_id", s)) for s in ("oldest", "latest")], "what string, event_id bigint")
    first = changelog.page(e, "event_id", changelog.start_of(e, "event_id", 41), 5).select(F.lit("page").alias("what"), "event_id")
    return first.unionByName(changelog.pruned(e, acks, "who", "event_id").select(F.lit("left").alias("what"), "event_id")).unionByName(starts)


@query("SELECT * FROM (VALUES ('now in check', true), ('random in generated', true), ('quoted', false)) AS t(what, refused)")
def ddl_deterministic(spark: SparkSession, d: str) -> DataFrame:
    n, out = read(spark, d, "nation"), []
    for what, options in (("now in check", {"checks": {"x": "n_nationkey < unix_seconds(now())"}}), ("random in generated", {"generated": {"g": "rand()"}}), ("quoted", {"checks": {"x": "n_name <> 'rand()'"}})):
        try:
            tables.Store().create("t", n, **options)
            out.append((what, False))
        except tables.ConstraintError:
            out.append((what, True))
    return spark.createDataFrame(out, "what string, refused boolean")
