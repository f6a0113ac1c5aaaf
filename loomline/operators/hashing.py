"""Canonical form and content hashes of sessions and files."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.session import ship

PENDING = "<pending>"


def _number(x) -> str:
    """A number as ECMAScript prints it, which RFC 8785 asks for."""
    x = float(x)
    if not math.isfinite(x):
        raise ValueError("not a JSON number")
    if x == int(x) and abs(x) < 1e15:
        return str(int(x))
    digits, _, exp = repr(x).partition("e")
    sign, digits = ("-", digits[1:]) if digits.startswith("-") else ("", digits)
    whole, _, frac = digits.partition(".")
    frac = "" if frac == "0" else frac
    e = int(exp or 0) + len(whole) - 1
    body = (whole + frac).lstrip("0")
    if not exp and whole == "0":
        e = -1 - (len(frac) - len(frac.lstrip("0")))
    body = body.rstrip("0") or "0"
    if 0 > e >= -6:
        return f"{sign}0.{'0' * (-e - 1)}{body}"
    if 0 <= e < 21:
        return sign + (body.ljust(e + 1, "0") if len(body) <= e + 1 else f"{body[:e + 1]}.{body[e + 1:]}")
    return f"{sign}{body[0]}{'.' + body[1:] if len(body) > 1 else ''}e{'+' if e > 0 else '-'}{abs(e)}"


def canonical_json(value) -> str:
    """RFC 8785 text: keys in UTF-16 order, numbers as ECMAScript prints them."""
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical_json(value[k])}" for k in keys) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical_json, value)) + "]"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return _number(value)
    return json.dumps(value, ensure_ascii=False)


class _Unplain(Exception):
    """A number that the json module may print in another way than ECMAScript."""


def _unplain(_):
    raise _Unplain


def _short(digits: str) -> int:
    if len(digits) > 15:
        raise _Unplain
    return int(digits)


# Without escapes in ASCII text keys sort the same in UTF-16 and by code points, and short integers print alike.
_PLAIN = json.JSONDecoder(parse_float=_unplain, parse_int=_short, parse_constant=_unplain)
_SORTED = json.encoder.c_make_encoder(None, _unplain, json.encoder.encode_basestring, None, ":", ",", True, False, True)


def with_value(x: str | None) -> tuple[object, str | None]:
    """The value of JSON text and its canonical text; two nulls for null and for what is no JSON. Most lines are left to the json module's own loops."""
    if x is None:
        return None, None
    if x.isascii() and "\\u" not in x:
        try:
            value, end = _PLAIN.raw_decode(x)
            if end == len(x):
                return value, "".join(_SORTED(value, 0))
        except (_Unplain, ValueError):
            pass
    try:
        value = json.loads(x)
        return value, canonical_json(value)
    except ValueError:
        return None, None


def canonical_text(x: str | None) -> str | None:
    """Canonical text of JSON text; null for null and for what is no JSON."""
    return with_value(x)[1]


def canonical_texts(raw: pd.Series) -> pd.Series:
    """Canonical text of each JSON text."""
    return raw.map(canonical_text)


def with_canonical(records: DataFrame, raw: str, out: str = "canon") -> DataFrame:
    """`records` with the canonical text of the JSON text in `raw`, in Arrow batches."""
    ship(records.sparkSession)
    return records.withColumn(out, F.pandas_udf(canonical_texts, T.StringType())(raw))


def content_hash(lines: DataFrame, scope: list[str], text: str = "canon", order: str = "line") -> DataFrame:
    """(scope, content_hash): SHA-256 of a scope's canonical lines in order, each ended by a line feed.

    The lines of a scope meet in one group: a scope is a session or a file, which the
    format bounds. Headers must carry the pending hash in the text that is hashed.
    """
    rows = F.array_sort(F.collect_list(F.struct(order, text)))
    joined = F.concat(F.array_join(F.transform(rows, lambda x: x[text]), "\n"), F.lit("\n"))
    return lines.groupBy(*scope).agg(F.sha2(joined, 256).alias("content_hash"))


def verdict(expected: Column, actual: Column) -> Column:
    """match, mismatch, pending, missing or invalid."""
    return (F.when(expected.isNull(), "missing").when(expected == PENDING, "pending")
            .when(~expected.rlike("^[a-f0-9]{64}$"), "invalid").when(expected == actual, "match").otherwise("mismatch"))


def _elided(value, most: int) -> str:
    size = lambda v: len(json.dumps(v, ensure_ascii=False, separators=(",", ":")).encode())
    left = size(value)
    leaves: list[tuple[int, list]] = []

    def visit(v, path) -> None:
        for k, x in v.items() if isinstance(v, dict) else enumerate(v):
            if isinstance(x, (dict, list)) and x:
                visit(x, [*path, k])
            else:
                leaves.append((size(x), [*path, k]))

    if isinstance(value, (dict, list)):
        visit(value, [])
    for n, path in sorted(leaves, key=lambda x: -x[0]):
        if left <= most:
            break
        at = value
        for k in path[:-1]:
            at = at[k]
        at[path[-1]] = {"elided": True, "size_bytes": n}
        left = size(value)
    return json.dumps(value if left <= most else {"elided": True, "size_bytes": left}, ensure_ascii=False, separators=(",", ":"))


def with_elided(records: DataFrame, raw: str, out: str, most: int = 32_768) -> DataFrame:
    """`records` with JSON text of at most `most` bytes: the largest leaves give way to markers, at last the whole value.

    Texts within the limit stay in the JVM and as they are.
    """
    ship(records.sparkSession)
    shrink = F.pandas_udf(lambda s: s.map(lambda x: _elided(json.loads(x), most) if x is not None else None), T.StringType())
    large = F.octet_length(raw) > most
    return records.withColumn(out, F.when(large, shrink(F.when(large, F.col(raw)))).otherwise(F.col(raw)))
