"""JSON as text: a reader of strict JSON and JSON5 that keeps numbers and key order as they stand, for minified and nested documents."""

from __future__ import annotations

import json as _json
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANK = re.compile(r"[ \t\n\r]*")
_BLANK5 = re.compile(r"(?:[\s\ufeff]|//[^\n\r\u2028\u2029]*|/\*.*?\*/)*", re.S)
_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])")
_NUMBER5 = re.compile(r"([+-]?)(?:(0[xX][0-9a-fA-F]+)|(Infinity|inf)|(NaN)|(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)(?![\w.])", re.I)
_STRING = re.compile(r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"')
_STRING5 = re.compile(r"\"(?:[^\"\\\n\r]|\\.)*\"|'(?:[^'\\\n\r]|\\.)*'", re.S)
_ESCAPE5 = re.compile(r"\\(?:x([0-9a-fA-F]{2})|u([0-9a-fA-F]{4})|(\r\n|[\s\S]))")
_NAME5 = re.compile(r"[^\W\d][\w$]*|[$_][\w$]*")
#: One-letter escapes.
_LETTERS = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v", "0": "\0", "\n": "", "\r": "", "\r\n": "", "\u2028": "", "\u2029": ""}
#: Levels of nesting a document may have.
DEPTH = 1000


class Malformed(ValueError):
    def __init__(self, at: int) -> None:
        super().__init__(f"malformed JSON at {at + 1}")
        self.at = at


def minified(text: str, json5: bool = True) -> str:
    """The document without white space, in strict JSON; Malformed with the place where it isn't one."""
    blank = _BLANK5 if json5 else _BLANK
    out: list[str] = []
    open_: list[str] = []  # closing brackets
    at = blank.match(text, 0).end()
    state = "value"  # value, first (a value or the end), key, firstkey, after
    while True:
        if at >= len(text):
            if state == "after" and not open_:
                return "".join(out)
            raise Malformed(at)
        c = text[at]
        if state == "after":
            if not open_:
                raise Malformed(at)
            if c == ",":
                at = blank.match(text, at + 1).end()
                state = "key" if open_[-1] == "}" else "value"
                if not (json5 and text[at : at + 1] == open_[-1]):  # JSON5 allows a comma behind the last
                    out.append(",")
                    continue
                c = text[at]
            if c != open_[-1]:
                raise Malformed(at)
            out.append(open_.pop())
            at = blank.match(text, at + 1).end()
            state = "after"
        elif state in ("key", "firstkey"):
            if state == "firstkey" and c == "}":
                state = "after"
                continue
            m = (_STRING5 if json5 else _STRING).match(text, at)
            if m:
                out.append(_string(m[0]))
            elif json5 and (m := _NAME5.match(text, at)):
                out.append(f'"{m[0]}"')
            else:
                raise Malformed(at)
            at = blank.match(text, m.end()).end()
            if text[at : at + 1] != ":":
                raise Malformed(at)
            out.append(":")
            at = blank.match(text, at + 1).end()
            state = "value"
        elif state == "first" and c == "]":
            state = "after"
        elif c in "{[":
            open_.append("}" if c == "{" else "]")
            if len(open_) > DEPTH:
                raise Malformed(at)
            out.append(c)
            at = blank.match(text, at + 1).end()
            state = "firstkey" if c == "{" else "first"
        else:
            at = blank.match(text, _scalar(text, at, json5, out)).end()
            state = "after"


def _scalar(text: str, at: int, json5: bool, out: list[str]) -> int:
    for word in ("true", "false", "null"):
        if text.startswith(word, at) and not text[at + len(word) : at + len(word) + 1].isalnum():
            out.append(word)
            return at + len(word)
    if m := (_STRING5 if json5 else _STRING).match(text, at):
        out.append(_string(m[0]))
        return m.end()
    if m := _NUMBER.match(text, at):
        out.append(m[0])
        return m.end()
    if json5 and (m := _NUMBER5.match(text, at)):
        sign = "-" if m[1] == "-" else ""
        if m[2]:
            out.append(sign + str(int(m[2], 16)))
        elif m[3]:
            out.append(sign + "9e999")
        elif m[4]:
            out.append("null")
        else:
            whole, dot, part = m[5].partition(".")
            out.append(sign + (whole.lstrip("0") or "0") + (f".{part or '0'}" if dot else "") + (m[6] or ""))
        return m.end()
    raise Malformed(at)


def _string(raw: str) -> str:
    """A quoted string as strict JSON has it."""
    if raw[0] == '"' and _STRING.fullmatch(raw):
        return raw

    def one(m: re.Match) -> str:
        if m[1] or m[2]:
            return chr(int(m[1] or m[2], 16))
        return _LETTERS.get(m[3], m[3])

    return _json.dumps(_ESCAPE5.sub(one, raw[1:-1]), ensure_ascii=False)


def _mapped(f, kind: str):
    types = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}

    @F.arrow_udf(kind)
    def run(j: pa.Array) -> pa.Array:
        return pa.array([None if x is None else f(x) for x in j.to_pylist()], types[kind])

    return run


def _position(text: str, json5: bool = True) -> int:
    try:
        minified(text, json5)
    except Malformed as e:
        return e.at + 1
    return 0


def json(j: Column) -> Column:
    """The document minified; JSON5 becomes strict JSON, anything else is an error."""
    return _mapped(minified, "string")(j)


def json_error_position(j: Column) -> Column:
    """1-based place of the first error, 0 for none."""
    return _mapped(_position, "int")(j)


def json_valid(j: Column, flags: int = 1) -> Column:
    """Flag 1: strict JSON; 2: JSON5. Text is never the binary form that 4 and 8 ask for."""
    if not 1 <= flags <= 15:
        raise ValueError("FLAGS parameter to json_valid() must be between 1 and 15")
    if not flags & 3:
        return F.when(j.isNotNull(), False)
    return _mapped(lambda t: _position(t, bool(flags & 2)) == 0, "boolean")(j)


class Nested:
    """Marks a column whose text is JSON already, so that it nests as it is."""

    def __init__(self, column: Column) -> None:
        self.column = column


def quote(x: Column | Nested, kind: str = "string") -> Column:
    """A SQL value as JSON: text quoted, numbers plain, null for null, nested JSON as it is. In the JVM."""
    if isinstance(x, Nested):
        return F.coalesce(x.column, F.lit("null"))
    listed = F.to_json(F.array(x), {"ignoreNullFields": "false"})
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def array(*values: Column | Nested) -> Column:
    return F.concat(F.lit("["), F.concat_ws(",", *map(quote, values)), F.lit("]"))


def object_(**values: Column | Nested) -> Column:
    return F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(quote(F.lit(k)), F.lit(":"), quote(v)) for k, v in values.items()]), F.lit("}"))
