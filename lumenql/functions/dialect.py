"""Column expressions with the reference dialect's semantics where they differ from Spark's."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def substr(s: Column, start: Column | int, length: Column | int | None = None) -> Column:
    """1-based; 0 is the place before the first; a negative start counts from the end; a negative length takes the characters
    before the start."""
    i = (start if isinstance(start, Column) else F.lit(start)).cast("long")
    n = F.length(s).cast("long")
    z = (length if isinstance(length, Column) else F.lit(length)).cast("long") if length is not None else n + F.abs(i) + 1
    back = z < 0
    width = F.abs(z)
    # positions counted from 1; before the text they may be 0 or less
    begin = F.when(i < 0, n + i + 1).otherwise(i)
    width = F.when((i < 0) & ~back & (begin < 0), F.greatest(F.lit(0), width + begin - 1)).otherwise(width)
    begin = F.when((i < 0) & ~back & (begin < 0), F.lit(1)).otherwise(begin)
    lo = F.when(back, begin - width).otherwise(begin)
    hi = F.when(back, begin).otherwise(begin + width)
    lo, hi = F.greatest(lo, F.lit(1)), F.least(hi, n + 1)
    return F.when(s.isNull() | i.isNull() | z.isNull(), None).when(hi <= lo, "").otherwise(F.substring(s, lo.cast("int"), (hi - lo).cast("int")))


def prefix_integer(s: Column) -> Column:
    """CAST(text AS INTEGER): the longest integer prefix, 0 if there is none."""
    return F.when(s.isNotNull(), F.coalesce(F.regexp_extract(s, r"^\s*([+-]?\d+)", 1).try_cast("bigint"), F.lit(0)))


def prefix_real(s: Column) -> Column:
    """CAST(text AS REAL): the longest numeric prefix, 0.0 if there is none."""
    return F.when(s.isNotNull(), F.coalesce(F.regexp_extract(s, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double"), F.lit(0.0)))


def domain(x: Column) -> Column:
    """A mathematical result; what has none is null."""
    return F.when(F.isnan(x), None).otherwise(x)


def concat(*cols: Column) -> Column:
    """Nulls are skipped."""
    return F.concat_ws("", *cols)


def scalar_max(*cols: Column) -> Column:
    """Null if any argument is."""
    return F.when(_any_null(cols), None).otherwise(F.greatest(*cols))


def scalar_min(*cols: Column) -> Column:
    return F.when(_any_null(cols), None).otherwise(F.least(*cols))


def _any_null(cols: tuple[Column, ...]) -> Column:
    out = F.lit(False)
    for c in cols:
        out = out | c.isNull()
    return out


def integer_divide(a: Column, b: Column) -> Column:
    """Truncates towards zero; by zero it is null."""
    q = F.try_divide(a.cast("decimal(20,0)"), b.cast("decimal(20,0)"))
    return F.when(q < 0, F.ceil(q)).otherwise(F.floor(q)).cast("bigint")


def truncate(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")


def glob(s: Column, pattern: str) -> Column:
    """Case-sensitive shell pattern: ``*``, ``?``, ``[...]`` and ``[^...]``."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : end]
            neg = body.startswith("^")
            out.append(f"[{'^' if neg else ''}{body[neg:].replace(chr(92), chr(92) * 2).replace('[', chr(92) + '[')}]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return s.rlike("(?s)^" + "".join(out) + "$")


def is_in(x: Column, values: list) -> Column:
    """IN (list); an empty list holds nothing, not even null."""
    return x.isin(values) if values else F.lit(False)


def quote(x: Column, kind: str = "text") -> Column:
    """SQL literal of a value: text in single quotes, blobs as X'..', numbers plain, NULL."""
    plain = {"text": F.concat(F.lit("'"), F.replace(x.cast("string"), F.lit("'"), F.lit("''")), F.lit("'")), "blob": F.concat(F.lit("X'"), F.hex(x), F.lit("'"))}
    return F.coalesce(plain.get(kind, x.cast("string")), F.lit("NULL"))


#: Spark's type names and the dialect's five storage classes.
CLASSES = {"tinyint": "integer", "smallint": "integer", "int": "integer", "bigint": "integer", "boolean": "integer", "float": "real", "double": "real", "string": "text", "binary": "blob", "void": "null"}


def type_of(x: Column) -> Column:
    known = F.create_map(*[F.lit(v) for kv in CLASSES.items() for v in kv])
    return F.when(x.isNull(), "null").otherwise(F.coalesce(F.try_element_at(known, F.typeof(x)), F.lit("text")))


def unhex(s: Column, ignore: str = "") -> Column:
    """Bytes of hex digits; null if anything else, save the characters to ignore between pairs, is in it."""
    t = F.translate(s, ignore, "") if ignore else s
    return F.when(t.rlike(r"^(?:[0-9A-Fa-f]{2})*$"), F.unhex(t))


def hex_literals(sql: str) -> str:
    """SQL text with 0x.. integer literals in decimal, outside quotes."""
    parts = re.split(r"('(?:[^']|'')*')", sql)
    return "".join(p if i % 2 else re.sub(r"\b0[xX]([0-9a-fA-F]+)\b", lambda m: str(int(m[1], 16)), p) for i, p in enumerate(parts))


#: What a planner hint looks like in SQL text; the value is what stays.
_HINTS = [(r"\bAS\s+(?:NOT\s+)?MATERIALIZED\s*\(", "AS ("), (r"\bINDEXED\s+BY\s+\w+", ""), (r"\bNOT\s+INDEXED\b", ""), (r"(?<=[(=<>,])(\s*)\+(?=[A-Za-z_])", r"\1")]


def without_hints(sql: str) -> str:
    """SQL text without hints that don't change results: MATERIALIZED, INDEXED BY, likely(x), unlikely(x), likelihood(x, p), unary +. Quoted text stays."""
    parts = re.split(r"('(?:[^']|'')*')", sql)
    marks = [p for p in parts[1::2]]
    text = "\x00".join(parts[0::2])
    for pattern, instead in _HINTS:
        text = re.sub(pattern, instead, text, flags=re.I)
    while m := re.search(r"\b(likely|unlikely|likelihood)\s*\(", text, flags=re.I):
        depth, comma, at = 1, None, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(text[at], 0)
            if text[at] == "," and depth == 1:
                comma = at
            at += 1
        inner = text[m.end() : comma if comma and m[1].lower() == "likelihood" else at - 1]
        text = f"{text[: m.start()]}({inner.lstrip().removeprefix('+')}){text[at:]}"
    for p in marks:
        text = text.replace("\x00", p, 1)
    return text
