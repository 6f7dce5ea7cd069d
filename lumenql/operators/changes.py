"""Changes of tables as DataFrames: upserts, change sets, replicated cells, versions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], update: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """INSERT ... ON CONFLICT(keys) DO UPDATE SET update WHERE where; DO NOTHING where ``update`` is None.

    Expressions see the stored row as ``old.x`` and the new as ``new.x``. ``rows`` has each key once. One full join on the key.
    """
    o, n = table.alias("old").withColumn("_o", F.lit(True)).alias("old"), rows.withColumn("_n", F.lit(True)).alias("new")
    both = o.join(n, [F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in keys], "full")
    hit = F.col("old._o").isNotNull() & F.col("new._n").isNotNull()
    if where is not None:
        hit = hit & F.coalesce(where, F.lit(False))
    out = []
    for c in table.columns:
        new = F.col(f"new.{c}") if c in rows.columns else F.lit(None)
        value = F.when(F.col("old._o").isNull(), new).otherwise(F.col(f"old.{c}"))
        if update and c in update:
            value = F.when(hit, update[c]).otherwise(value)
        out.append(value.alias(c))
    return both.select(*out)


def replace(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """INSERT OR REPLACE."""
    return table.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows)


def update_from(table: DataFrame, source: DataFrame, keys: list[str], update: dict[str, Column]) -> DataFrame:
    """UPDATE ... FROM: rows with a partner take the expressions (old.x, new.x), others stay."""
    n = source.withColumn("_n", F.lit(True)).alias("new")
    both = table.alias("old").join(n, [F.col(f"old.{k}") == F.col(f"new.{k}") for k in keys], "left")
    hit = F.col("new._n").isNotNull()
    return both.select(*[F.when(hit, update[c]).otherwise(F.col(f"old.{c}")).alias(c) if c in update else F.col(f"old.{c}") for c in table.columns])


def delete(table: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """(what stays, what RETURNING gives); a null condition deletes nothing."""
    hit = F.coalesce(condition, F.lit(False))
    return table.where(~hit), table.where(hit)


def violations(table: DataFrame, checks: dict[str, Column], unique: list[str] | None = None, not_null: list[str] = ()) -> DataFrame:
    """(rule, n) for every constraint with rows against it; a null CHECK holds."""
    rules = {k: F.coalesce(~c, F.lit(False)) for k, c in checks.items()} | {f"not_null_{c}": F.col(c).isNull() for c in not_null}
    counts = table.agg(*[F.count_if(c).alias(k) for k, c in rules.items()]) if rules else None
    out = counts.select(F.explode(F.create_map(*[x for k in rules for x in (F.lit(k), F.col(k))])).alias("rule", "n")) if counts is not None else None
    if unique:
        dup = table.groupBy(*unique).count().where("count > 1").agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n")).select(F.lit("unique").alias("rule"), "n")
        out = dup if out is None else out.unionByName(dup)
    return out.where("n > 0")


def diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Change set (op, keys, old_x, new_x for the other columns): insert, update, delete. One full join."""
    rest = [c for c in old.columns if c not in keys]
    o = old.select(*keys, F.lit(True).alias("_o"), *[F.col(c).alias(f"old_{c}") for c in rest])
    n = new.select(*keys, F.lit(True).alias("_n"), *[F.col(c).alias(f"new_{c}") for c in rest])
    same = F.lit(True)
    for c in rest:
        same = same & F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}"))
    op = F.when(F.col("_o").isNull(), "insert").when(F.col("_n").isNull(), "delete").when(~same, "update")
    both = o.join(n, keys, "full").withColumn("op", op).where("op is not null")
    return both.select("op", *keys, *[f"old_{c}" for c in rest], *[f"new_{c}" for c in rest])


def invert(changes: DataFrame) -> DataFrame:
    """The change set that undoes another."""
    swap = {"old_": "new_", "new_": "old_"}
    cols = [F.col(swap[c[:4]] + c[4:]).alias(c) if c[:4] in swap else F.col(c) for c in changes.columns if c != "op"]
    op = F.when(F.col("op") == "insert", "delete").when(F.col("op") == "delete", "insert").otherwise(F.col("op"))
    return changes.select(op.alias("op"), *cols)


def concat(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """One change set with the effect of two in a row; what comes to nothing is left out."""
    cols = [c for c in first.columns if c != "op" and c not in keys]
    a = first.select(*keys, F.struct("op", *cols).alias("a"))
    b = second.select(*keys, F.struct("op", *cols).alias("b"))
    both = a.join(b, keys, "full")
    began, ends = F.coalesce(F.col("a.op"), F.col("b.op")) != "insert", F.coalesce(F.col("b.op"), F.col("a.op")) != "delete"
    op = F.when(began & ends, "update").when(ends, "insert").when(began, "delete")
    out = []
    for c in cols:
        here, there = (F.col("a"), F.col("b")) if c.startswith("old_") else (F.col("b"), F.col("a"))
        out.append(F.when(here.isNotNull(), here[c]).otherwise(there[c]).alias(c))
    got = both.select(op.alias("op"), *keys, *out).where("op is not null")
    same = F.lit(True)
    for c in cols:
        if c.startswith("old_"):
            same = same & F.col(c).eqNullSafe(F.col("new_" + c[4:]))
    return got.where(~((F.col("op") == "update") & same))


def apply(table: DataFrame, changes: DataFrame, keys: list[str], on_conflict: str = "omit") -> DataFrame:
    """Applies a change set. A change conflicts where the stored row isn't the one it expects; ``omit`` leaves such rows, ``replace``
    takes the change, ``abort`` raises."""
    rest = [c for c in table.columns if c not in keys]
    t = table.select(*keys, F.lit(True).alias("_t"), *[F.col(c).alias(f"_{c}") for c in rest])
    both = t.join(changes, keys, "full")
    expected = F.when(F.col("op") == "insert", F.col("_t").isNull()).otherwise(F.col("_t").isNotNull())
    for c in rest:
        expected = expected & F.when(F.col("op") == "insert", True).otherwise(F.col(f"_{c}").eqNullSafe(F.col(f"old_{c}")))
    if on_conflict == "abort":
        if not both.where(F.col("op").isNotNull() & ~expected).isEmpty():
            raise ValueError("change set conflicts with the table")
    take = F.col("op").isNotNull() & (expected if on_conflict != "replace" else F.lit(True))
    kept = both.where(~(take & (F.col("op") == "delete")) & (F.col("_t").isNotNull() | take))
    return kept.select(*keys, *[F.when(take, F.col(f"new_{c}")).otherwise(F.col(f"_{c}")).alias(c) for c in rest])


#: The order of value types where versions are equal, least first.
TYPE_RANK = ["null", "blob", "text", "real", "integer"]


def merge_cells(changes: DataFrame) -> DataFrame:
    """Replicated cells: of all changes of (tbl, pk, cid), that of the greatest col_version, then value, then site_id. Values compare by type first where
    there is a column ``val_type`` (TYPE_RANK). Where there is one ``cl``, the causal length, only changes of a row's greatest one count, and
    of a row whose greatest one is even, which is deleted, only the sentinel (cid '-1') stays.
    """
    rows = changes
    if "cl" in changes.columns:
        row = Window.partitionBy("tbl", "pk")
        rows = rows.withColumn("_cl", F.max(F.coalesce("cl", F.lit(1))).over(row)).where(F.coalesce("cl", F.lit(1)) == F.col("_cl"))
        rows = rows.where((F.col("_cl") % 2 == 1) | (F.col("cid").cast("string") == "-1")).drop("_cl")
    rank = F.array_position(F.array(*map(F.lit, TYPE_RANK)), F.col("val_type")) if "val_type" in changes.columns else F.lit(0)
    best = Window.partitionBy("tbl", "pk", "cid").orderBy(F.desc("col_version"), rank.desc(), F.desc_nulls_last("val"), F.desc("site_id"))
    return rows.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")


def capture(changeset: DataFrame, table: str, keys: list[str], version: int, site: int) -> DataFrame:
    """Clock rows of a local transaction, from its change set (see diff): (tbl, pk, cid, val, col_version, db_version, seq, cl, site_id), all of the
    next db_version. An insert writes one row for each column, an update one for each column that changes, a delete the sentinel '-1' with an even
    causal length. ``seq`` counts the cells of each row of the table; col_version is 1 for new cells and 2 for changed ones, to be added to the stored.
    """
    rest = [c[4:] for c in changeset.columns if c.startswith("new_")]
    pk = F.to_json(F.struct(*keys))
    cells = F.array(*[
        F.when((F.col("op") == "insert") | ((F.col("op") == "update") & ~F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}"))),
               F.struct(F.lit(i).alias("n"), F.lit(c).alias("cid"), F.col(f"new_{c}").cast("string").alias("val")))
        for i, c in enumerate(rest)
    ])
    gone = F.array(F.struct(F.lit(0).alias("n"), F.lit("-1").alias("cid"), F.lit(None).cast("string").alias("val")))
    each = changeset.withColumn("_c", F.explode(F.when(F.col("op") == "delete", gone).otherwise(F.filter(cells, lambda c: c.isNotNull()))))
    each = each.withColumn("pk", pk)
    seq = F.row_number().over(Window.partitionBy("pk").orderBy("_c.n")) - 1
    return each.select(
        F.lit(table).alias("tbl"), "pk", "_c.cid", "_c.val", F.when(F.col("op") == "insert", 1).otherwise(2).alias("col_version"), F.lit(version + 1).alias("db_version"),
        seq.alias("seq"), F.when(F.col("op") == "delete", 2).otherwise(1).alias("cl"), F.lit(site).alias("site_id"),
    )


#: Digits of order keys, in the order of their code points.
ORDER_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def key_between(a: str | None, b: str | None) -> str:
    """A key strictly between two others in text order; None is before all, or behind all. Keys don't end in the least digit."""
    if a is not None and b is not None and a >= b:
        raise ValueError("keys out of order")
    out, low, high = "", a or "", b
    at = 0
    while True:
        x = ORDER_DIGITS.index(low[at]) if at < len(low) else 0
        y = ORDER_DIGITS.index(high[at]) if high is not None and at < len(high) else len(ORDER_DIGITS)
        if y - x > 1:
            return out + ORDER_DIGITS[(x + y) // 2]
        out += ORDER_DIGITS[x]
        if y > x:
            high = None  # from here on anything above the lower key will do
        at += 1


def between(a, b) -> Column:
    """key_between of two columns."""

    @F.arrow_udf("string")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([key_between(i, j) for i, j in zip(x.to_pylist(), y.to_pylist())], pa.string())

    return run(a, b)


def pack_columns(*cols: Column) -> Column:
    """One blob of several values: a count, then each value's type name, length and text, so that equal rows and no others have equal blobs."""
    parts = [F.concat(F.coalesce(F.typeof(c), F.lit("null")), F.lit(":"), F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-:"))) for c in cols]
    return F.encode(F.concat(F.lit(f"{len(cols)};"), *parts), "UTF-8")


def unpack_column(blob: Column, kinds: list[str], k: int) -> Column:
    """The k-th value of a packed blob whose columns have these types."""

    @F.arrow_udf("string")
    def run(b: pa.Array) -> pa.Array:
        out = []
        for x in b.to_pylist():
            if x is None:
                out.append(None)
                continue
            at, value = x.index(b";") + 1, None
            for _ in range(k + 1):
                name = x.index(b":", at) + 1
                size = x.index(b":", name)
                n = x[name:size]
                at = size + 1 + (0 if n == b"-" else int(n))
                value = None if n == b"-" else x[size + 1 : at].decode()
            out.append(value)
        return pa.array(out, pa.string())

    return run(blob).cast(kinds[k])


def changes_since(changes: DataFrame, version: int, not_site: int) -> DataFrame:
    """What a peer fetches: newer than its cursor, not its own."""
    return changes.where((F.col("db_version") > version) & ~F.col("site_id").eqNullSafe(F.lit(not_site)))


def read_version(segments: DataFrame, branches: list[tuple[str, int]], key: str) -> DataFrame:
    """Branch reads: of each ``key`` the newest segment not after the branch's version, else its parent's, and so on.

    ``branches``: (name, version) from the branch up to the root.
    """
    priority = F.lit(None).cast("int")
    for i, (name, v) in reversed(list(enumerate(branches))):
        priority = F.when((F.col("branch") == name) & (F.col("version") <= v), i).otherwise(priority)
    best = Window.partitionBy(key).orderBy("_p", F.desc("version"))
    return segments.withColumn("_p", priority).where("_p is not null").withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_p", "_r")


def feed(clock: DataFrame, pks: DataFrame, sites: DataFrame, table: str) -> DataFrame:
    """The change feed of a replicated table: (tbl, pk, cid, col_version, db_version, site_id, seq, cl).

    ``clock``: (key, cid, col_version, db_version, site, seq) with the sentinel of a row under cid '-1'; ``pks``: (key, pk); ``sites``: (site, site_id), null for
    the table's own. A row's causal length is its sentinel's version, 1 without one. Union the feeds of several tables for all.
    """
    lengths = clock.where("cid = '-1'").select("key", F.col("col_version").alias("cl"))
    rows = clock.join(pks, "key").join(sites, "site", "left").join(lengths, "key", "left")
    return rows.select(F.lit(table).alias("tbl"), "pk", "cid", "col_version", "db_version", "site_id", "seq", F.coalesce("cl", F.lit(1)).alias("cl"))
