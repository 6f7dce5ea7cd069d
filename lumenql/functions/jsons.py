"""JSON functions. Extraction is in the JVM; what rewrites documents runs on Arrow batches."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

_STEP = re.compile(r'\.(?:"((?:[^"\\]|\\.)*)"|([^.\[]+))|\[(#(?:-(\d+))?|\d+)\]')


def steps(path: str) -> list:
    """``$.a."b c"[0][#-1]`` as keys, indices, and (n,) for n from the end; (0,) is the place behind the last."""
    if not path.startswith("$"):
        raise ValueError(f"bad JSON path: {path}")
    out, at = [], 1
    while at < len(path):
        m = _STEP.match(path, at)
        if not m:
            raise ValueError(f"bad JSON path: {path}")
        if m[3] is None:
            out.append(json.loads(f'"{m[1]}"') if m[1] is not None else m[2])
        else:
            out.append((int(m[4] or 0),) if m[3].startswith("#") else int(m[3]))
        at = m.end()
    return out


def _dump(x) -> str:
    return json.dumps(x, separators=(",", ":"), ensure_ascii=False)


def _index(step, node: list) -> int:
    return len(node) - step[0] if isinstance(step, tuple) else step


def _edit(doc, path: list, value, create: bool, overwrite: bool):
    """The document with the value at the path; missing parents are made where ``create``."""
    if not path:
        return value if overwrite else doc
    s, rest = path[0], path[1:]
    if isinstance(s, str):
        if not isinstance(doc, dict):
            return doc
        if s in doc:
            return doc | {s: _edit(doc[s], rest, value, create, overwrite)}
        return doc | {s: _fresh(rest, value)} if create else doc
    if not isinstance(doc, list):
        return doc
    i = _index(s, doc)
    if 0 <= i < len(doc):
        return [*doc[:i], _edit(doc[i], rest, value, create, overwrite), *doc[i + 1 :]]
    return [*doc, _fresh(rest, value)] if create and i == len(doc) else doc


def _fresh(path: list, value):
    for s in reversed(path):
        value = {s: value} if isinstance(s, str) else [value]
    return value


def _drop(doc, path: list):
    if not path:
        return None
    s, rest = path[0], path[1:]
    if isinstance(s, str):
        if isinstance(doc, dict) and s in doc:
            return {k: v for k, v in doc.items() if k != s} if not rest else doc | {s: _drop(doc[s], rest)}
        return doc
    if isinstance(doc, list) and 0 <= (i := _index(s, doc)) < len(doc):
        return doc[:i] + doc[i + 1 :] if not rest else [*doc[:i], _drop(doc[i], rest), *doc[i + 1 :]]
    return doc


def _patch(doc, patch):
    if not isinstance(patch, dict):
        return patch
    out = dict(doc) if isinstance(doc, dict) else {}
    for k, v in patch.items():
        if v is None:
            out.pop(k, None)
        else:
            out[k] = _patch(out.get(k), v)
    return out


def _on_documents(f) -> object:
    @F.pandas_udf("string")
    def run(j: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else _dump(f(json.loads(x))) for x in j], dtype=object)

    return run


def json_set(j: Column, path: str, value) -> Column:
    """Creates or overwrites."""
    return _on_documents(lambda d: _edit(d, steps(path), value, True, True))(j)


def json_insert(j: Column, path: str, value) -> Column:
    """Creates only."""
    return _on_documents(lambda d: _edit(d, steps(path), value, True, False))(j)


def json_replace(j: Column, path: str, value) -> Column:
    """Overwrites only."""
    return _on_documents(lambda d: _edit(d, steps(path), value, False, True))(j)


def json_remove(j: Column, *paths: str) -> Column:
    """Removes one path after another; later ones see what earlier ones left."""

    def run(d):
        for p in paths:
            d = _drop(d, steps(p))
        return d

    return _on_documents(run)(j)


def json_patch(j: Column, patch: dict) -> Column:
    """RFC 7396 merge patch: null deletes."""
    return _on_documents(lambda d: _patch(d, patch))(j)


def json_extract(j: Column, path: str) -> Column:
    """The value as text, null where there is none; [#-k] counts from the end."""
    parts = steps(path)
    tail = next((i for i, s in enumerate(parts) if isinstance(s, tuple)), None)
    plain = lambda ps: "$" + "".join(f"['{s}']" if isinstance(s, str) else f"[{s}]" for s in ps)
    if tail is None:
        return F.get_json_object(j, plain(parts))
    array = F.get_json_object(j, plain(parts[:tail])) if tail else j
    items = F.from_json(array, "array<string>")
    item = F.try_element_at(items, F.lit(-parts[tail][0])) if parts[tail][0] else F.lit(None).cast("string")
    rest = parts[tail + 1 :]
    return F.get_json_object(item, plain(rest)) if rest else item


def _operand(step: str | int) -> str:
    """A path from the operand of an arrow: a path as it is, a key, an index (from the end if negative)."""
    if isinstance(step, int):
        return f"$[{step}]" if step >= 0 else f"$[#{step}]"
    return step if step.startswith("$") else '$."' + step.replace("\\", "\\\\").replace('"', '\\"') + '"'


def arrow(j: Column, step: str | int) -> Column:
    """``->``: the element as JSON, null where there is none."""
    path = _operand(step)
    text = json_extract(j, path)
    return F.when(json_type(j, path) == "text", F.substring(F.to_json(F.array(text)), F.lit(2), F.length(F.to_json(F.array(text))) - 2)).when(json_type(j, path) == "null", "null").otherwise(text)


def arrow_text(j: Column, step: str | int) -> Column:
    """``->>``: the element as a SQL value, here text."""
    return json_extract(j, _operand(step))


def json_extract_all(j: Column, *paths: str) -> Column:
    """Several paths: a JSON array of what they lead to, null for what isn't there."""
    return F.concat(F.lit("["), F.concat_ws(",", *[F.coalesce(arrow(j, p), F.lit("null")) for p in paths]), F.lit("]"))


def json_type(j: Column, path: str = "$") -> Column:
    """null, true, false, integer, real, text, array or object; null where the path leads nowhere."""
    v = F.try_variant_get(F.try_parse_json(j), "$" + path[1:], "variant")
    s = F.schema_of_variant(v)
    return (
        F.when(v.isNull(), None).when(s == "VOID", "null").when(s == "BOOLEAN", F.variant_get(v, "$", "string")).when(s == "BIGINT", "integer")
        .when(s.startswith("DECIMAL") | (s == "DOUBLE") | (s == "FLOAT"), "real").when(s == "STRING", "text").when(s.startswith("ARRAY"), "array").otherwise("object")
    )


def json_valid(j: Column) -> Column:
    return F.when(j.isNotNull(), F.try_parse_json(j).isNotNull())


@udtf(returnType="key: string, value: string, type: string, atom: string, fullkey: string")
class JsonTree:
    """Every node of a document, parents first."""

    def eval(self, j: str):
        if j is not None:
            yield from self.walk(None, json.loads(j), "$")

    def walk(self, key, x, full: str):
        kinds = {dict: "object", list: "array", str: "text", int: "integer", float: "real", type(None): "null", bool: "true" if x else "false"}
        kind = kinds[type(x)]
        atom = None if x is None or isinstance(x, dict | list) else x if isinstance(x, str) else _dump(x)
        yield key, _dump(x) if isinstance(x, dict | list) else atom, kind, atom, full
        if isinstance(x, dict):
            for k, v in x.items():
                yield from self.walk(k, v, f"{full}.{k}" if re.fullmatch(r"[A-Za-z_]\w*", k) else f'{full}."{k}"')
        elif isinstance(x, list):
            for i, v in enumerate(x):
                yield from self.walk(str(i), v, f"{full}[{i}]")


def jsonb(j: Column) -> Column:
    """The binary form: a Variant, which the JVM reads without parsing text again. Null for what is no JSON."""
    return F.try_parse_json(j)


def jsonb_extract(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def jsonb_text(v: Column) -> Column:
    """JSON text of a binary value; its keys are in their binary order."""
    return F.to_json(v)
