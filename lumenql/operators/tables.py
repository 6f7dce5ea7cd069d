"""Tables that change: a store of named DataFrames in which every statement gives a new store.

Nothing is written until a caller does; a statement composes a plan over the tables before it. So a transaction is a
store kept aside, and rollback is going back to it.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from dataclasses import replace as changed

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: What has another value at another time.
_UNSTEADY = re.compile(r"\b(?:now|current_date|current_timestamp|current_time|rand|randn|random|uuid|unix_timestamp)\s*\(|'now'|\bcurrent_(?:date|time|timestamp)\b", re.I)


@dataclass(frozen=True)
class Table:
    rows: DataFrame
    key: tuple[str, ...] = ()
    defaults: dict[str, Column] = field(default_factory=dict)
    generated: dict[str, str] = field(default_factory=dict)  # column: SQL expression over the others
    checks: dict[str, str] = field(default_factory=dict)
    not_null: tuple[str, ...] = ()
    foreign: dict[str, tuple[str, str, str]] = field(default_factory=dict)  # column: (parent table, its column, on delete)

    @property
    def stored(self) -> list[str]:
        return [c for c in self.rows.columns if c not in self.generated]


class ConstraintError(ValueError):
    pass


@dataclass(frozen=True)
class Store:
    tables: dict[str, Table] = field(default_factory=dict)
    views: dict[str, Callable[[Store], DataFrame]] = field(default_factory=dict)
    triggers: dict[tuple[str, str], tuple] = field(default_factory=dict)  # (table, event): functions (store, rows) -> store
    marks: tuple[tuple[str, Store], ...] = ()

    # -- reading ---------------------------------------------------------------------------

    def __getitem__(self, name: str) -> DataFrame:
        return self.views[name](self) if name in self.views else self.tables[name].rows

    # -- definitions -----------------------------------------------------------------------

    def create(self, name: str, rows: DataFrame, **options) -> Store:
        """CREATE TABLE with rows (CTAS) and its options; generated columns are computed from the others."""
        t = Table(rows, **options)
        for e in [*t.generated.values(), *t.checks.values()]:
            if m := _UNSTEADY.search(re.sub(r"'(?:[^']|'')*'", lambda q: q[0] if q[0].lower() == "'now'" else "''", e)):
                raise ConstraintError(f"non-deterministic use of {m[0]} in a CHECK constraint or generated column")
        return self._put(name, changed(t, rows=_generate(rows, t.generated)))

    def _put(self, name: str, t: Table) -> Store:
        return changed(self, tables=self.tables | {name: t})

    def view(self, name: str, body: Callable[[Store], DataFrame]) -> Store:
        return changed(self, views=self.views | {name: body})

    def trigger(self, table: str, event: str, action: Callable[[Store, DataFrame], Store]) -> Store:
        """``event``: after insert, after delete, after update (rows as they are then), or instead of insert for a view. The action sees the rows
        as one DataFrame, once for the statement."""
        key = (table, event)
        return changed(self, triggers=self.triggers | {key: (*self.triggers.get(key, ()), action)})

    def _fire(self, table: str, event: str, rows: DataFrame) -> Store:
        out = self
        for action in self.triggers.get((table, event), ()):
            out = action(out, rows)
        return out

    def add_column(self, table: str, column: str, kind: str, default: Column | None = None) -> Store:
        t = self.tables[table]
        value = (F.lit(None) if default is None else default).cast(kind).alias(column)
        t = changed(t, rows=t.rows.select("*", value), defaults=t.defaults | ({} if default is None else {column: default}))
        return self._put(table, t)

    def rename_column(self, table: str, old: str, new: str) -> Store:
        t = self.tables[table]
        name = lambda c: new if c == old else c
        text = lambda e: re.sub(rf"(?<![\w`]){re.escape(old)}(?![\w`])", new, e)
        return self._put(table, Table(
            t.rows.withColumnRenamed(old, new), tuple(map(name, t.key)), {name(c): e for c, e in t.defaults.items()}, {name(c): text(e) for c, e in t.generated.items()},
            {c: text(e) for c, e in t.checks.items()}, tuple(map(name, t.not_null)), {name(c): f for c, f in t.foreign.items()},
        ))

    def drop_column(self, table: str, column: str) -> Store:
        t = self.tables[table]
        if column in t.key or any(re.search(rf"\b{re.escape(column)}\b", e) for e in [*t.generated.values(), *t.checks.values()]):
            raise ConstraintError(f"cannot drop column {column}: it is in use")
        return self._put(table, changed(t, rows=t.rows.drop(column)))

    def alter_column(self, table: str, column: str, kind: str) -> Store:
        """ALTER COLUMN ... TYPE; what can't be cast becomes null."""
        t = self.tables[table]
        return self._put(table, changed(t, rows=t.rows.withColumn(column, F.col(column).try_cast(kind))))

    def rename(self, old: str, new: str) -> Store:
        tables = {new if k == old else k: v for k, v in self.tables.items()}
        return changed(self, tables=tables)

    def drop(self, name: str) -> Store:
        return changed(self, tables={k: v for k, v in self.tables.items() if k != name}, views={k: v for k, v in self.views.items() if k != name})

    # -- statements ------------------------------------------------------------------------

    def insert(self, table: str, rows: DataFrame, on_conflict: str = "abort") -> Store:
        """INSERT of a relation (VALUES, SELECT or a CTE); columns that it lacks take their defaults.

        ``on_conflict``: abort, fail and rollback raise (all with nothing inserted; rollback also ends the transaction, as the caller keeps the store it began
        with), ignore leaves the stored row and the first new one of a key, replace the last new one. First and last are by the rows' order
        column ``_order`` where there is one, and by all columns otherwise.
        """
        if (table, "instead of insert") in self.triggers:
            return self._fire(table, "instead of insert", rows)
        t = self.tables[table]
        new = rows.select(*[
            F.col(c).cast(t.rows.schema[c].dataType).alias(c) if c in rows.columns else t.defaults.get(c, F.lit(None)).cast(t.rows.schema[c].dataType).alias(c) for c in t.stored
        ], *[c for c in ("_order",) if c in rows.columns])
        order = ["_order"] if "_order" in rows.columns else t.stored
        self._check(t, _generate(new, t.generated))
        self._check_parents(t, new)
        old = t.rows.select(*t.stored)
        if t.key:
            if on_conflict in ("abort", "fail", "rollback"):
                again = new.groupBy(*t.key).count().where("count > 1").select(*t.key).unionByName(new.join(old, list(t.key), "left_semi").select(*t.key))
                if not again.isEmpty():
                    raise ConstraintError(f"UNIQUE constraint failed: {table}.{', '.join(t.key)}")
            else:
                by = [F.desc(c) if on_conflict == "replace" else F.asc(c) for c in order]
                new = new.withColumn("_r", F.row_number().over(Window.partitionBy(*t.key).orderBy(*by))).where("_r = 1").drop("_r")
                if on_conflict == "replace":
                    old = old.join(new.select(*t.key), list(t.key), "left_anti")
                else:
                    new = new.join(old.select(*t.key), list(t.key), "left_anti")
        new = new.select(*t.stored)
        out = self._put(table, changed(t, rows=_generate(old.unionByName(new), t.generated)))
        return out._fire(table, "after insert", _generate(new, t.generated))

    def insert_defaults(self, table: str) -> Store:
        """INSERT ... DEFAULT VALUES."""
        t = self.tables[table]
        return self.insert(table, t.rows.sparkSession.range(1).select())

    def delete(self, table: str, condition: Column, order: list[Column] | None = None, limit: int | None = None) -> Store:
        """DELETE, of the first ``limit`` rows in ``order`` if these are given; rows that refer to deleted ones go too (cascade), lose the reference (set null)
        or forbid it (restrict)."""
        t = self.tables[table]
        hit = F.coalesce(condition, F.lit(False))
        if limit is not None:
            gone = t.rows.where(hit).orderBy(*order).limit(limit)
            stays = t.rows.join(F.broadcast(gone.select(*t.key)), list(t.key), "left_anti")
        else:
            gone, stays = t.rows.where(hit), t.rows.where(~hit)
        return self._put(table, changed(t, rows=stays))._orphaned(table, gone)._fire(table, "after delete", gone)

    def _orphaned(self, table: str, gone: DataFrame) -> Store:
        """Settles what refers to deleted rows, and what refers to that."""
        out = self
        for name, child in self.tables.items():
            for column, (parent, key, action) in child.foreign.items():
                if parent != table:
                    continue
                at = out.tables[name]
                keys = gone.select(F.col(key).alias("_k")).where("_k is not null").distinct()
                held = at.rows.join(keys, F.col(column) == F.col("_k"), "left")
                if action == "cascade":
                    out = out._put(name, changed(at, rows=held.where("_k is null").select(*at.rows.columns)))
                    out = out._orphaned(name, held.where("_k is not null").select(*at.rows.columns))
                elif action == "set null":
                    kept = held.withColumn(column, F.when(F.col("_k").isNull(), F.col(column))).select(*at.rows.columns)
                    out = out._put(name, changed(at, rows=kept))
                elif not held.where("_k is not null").isEmpty():
                    raise ConstraintError("FOREIGN KEY constraint failed")
        return out

    def update(self, table: str, values: dict[str, Column], condition: Column | None = None, order: list[Column] | None = None, limit: int | None = None) -> Store:
        """UPDATE: the values see the old row; generated columns follow."""
        t = self.tables[table]
        rows = t.rows
        if limit is not None:
            first = rows.where(condition if condition is not None else F.lit(True)).orderBy(*order).limit(limit).select(*t.key, F.lit(True).alias("_hit"))
            rows = rows.join(F.broadcast(first), list(t.key), "left")
            hit = F.coalesce("_hit", F.lit(False))
        else:
            hit = F.coalesce(condition, F.lit(False)) if condition is not None else F.lit(True)
        marked = rows.withColumn("_hit", hit)
        new = marked.select(*[F.when(F.col("_hit"), values[c]).otherwise(F.col(c)).cast(t.rows.schema[c].dataType).alias(c) if c in values else F.col(c) for c in t.stored], "_hit")
        full = _generate(new.drop("_hit"), t.generated)
        self._check(t, full)
        self._check_parents(t, new.where("_hit"))
        out = self._put(table, changed(t, rows=full))
        return out._fire(table, "after update", _generate(new.where("_hit").drop("_hit"), t.generated))

    def _check(self, t: Table, rows: DataFrame) -> None:
        rules = {n: F.coalesce(~F.expr(e), F.lit(False)) for n, e in t.checks.items()} | {f"NOT NULL {c}": F.col(c).isNull() for c in t.not_null}
        if rules:
            bad = rows.agg(*[F.count_if(c).alias(n) for n, c in rules.items()]).first().asDict()
            if any(bad.values()):
                raise ConstraintError("constraint failed: " + ", ".join(n for n, v in bad.items() if v))

    def _check_parents(self, t: Table, rows: DataFrame) -> None:
        for column, (parent, key, _) in t.foreign.items():
            known = self.tables[parent].rows.select(F.col(key).alias("_k"))
            if not rows.where(F.col(column).isNotNull()).join(known, F.col(column) == F.col("_k"), "left_anti").isEmpty():
                raise ConstraintError("FOREIGN KEY constraint failed")

    # -- transactions ----------------------------------------------------------------------

    def savepoint(self, name: str) -> Store:
        """Also BEGIN: remembers the store as it is."""
        return changed(self, marks=(*self.marks, (name, self)))

    def rollback(self, name: str | None = None) -> Store:
        """To the newest savepoint of the name, which stays; without a name, to the oldest, and the transaction ends."""
        if not self.marks:
            raise ValueError("no transaction is active")
        if name is None:
            return changed(self.marks[0][1], marks=())
        at = max((i for i, (n, _) in enumerate(self.marks) if n == name), default=-1)
        if at < 0:
            raise ValueError(f"no such savepoint: {name}")
        return changed(self.marks[at][1], marks=self.marks[: at + 1])

    def release(self, name: str) -> Store:
        """Forgets the savepoint and those after it; the changes stay."""
        at = max((i for i, (n, _) in enumerate(self.marks) if n == name), default=-1)
        if at < 0:
            raise ValueError(f"no such savepoint: {name}")
        return changed(self, marks=self.marks[:at])

    def commit(self) -> Store:
        return changed(self, marks=())


def _generate(rows: DataFrame, generated: dict[str, str]) -> DataFrame:
    return rows.select(*[c for c in rows.columns if c not in generated], *[F.expr(e).alias(c) for c, e in generated.items()]) if generated else rows


def statistics(table: DataFrame) -> DataFrame:
    """ANALYZE: (column, n_rows, n_distinct, n_null) of each column, in one pass over the table."""
    cols = table.columns
    got = table.agg(F.count("*").alias("n"), *[F.count_distinct(F.col(c)).alias(f"d{i}") for i, c in enumerate(cols)], *[F.count_if(F.col(c).isNull()).alias(f"z{i}") for i, c in enumerate(cols)])
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col("n").alias("n_rows"), F.col(f"d{i}").alias("n_distinct"), F.col(f"z{i}").alias("n_null")) for i, c in enumerate(cols)])
    return got.select(F.explode(each).alias("s")).select("s.*")


#: A predicate of one column against a value, in SQL text.
_PREDICATE = re.compile(r"(?<![\w.'])(?:\w+\.)?([A-Za-z_]\w*)\s*(=|<=|>=|<|>|\bIN\b|\bBETWEEN\b)\s*(?=['\d(:?])", re.I)


def advise(queries: list[str], tables: dict[str, list[str]]) -> list[tuple[str, str, str, int]]:
    """(table, column, layout, uses): for a set of queries, the columns they restrict to a value (bucket by it) or a range (sort by it)."""
    uses: dict[tuple[str, str, str], int] = {}
    for text in queries:
        bare = re.sub(r"'(?:[^']|'')*'", "''", text)
        for column, op in _PREDICATE.findall(bare):
            for table, columns in tables.items():
                if column in columns:
                    layout = "bucket" if op.upper() in ("=", "IN") else "sort"
                    uses[table, column, layout] = uses.get((table, column, layout), 0) + 1
    return sorted((*k, v) for k, v in uses.items())
