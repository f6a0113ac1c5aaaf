"""Versions of sources, and which schema reads them.

A version is a struct that Spark orders as versions are ordered: numbers, then whether it is
released, then the parts of its prerelease. The ranges of a source become intervals that
don't overlap, and a version finds its interval by binary search, a tree of comparisons with one
level for each halving, so no join compares versions with ranges and nothing is shuffled.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"(?:0|[1-9][0-9]*)"
_PART = rf"(?:{_NUMBER}|[0-9]*[A-Za-z-][0-9A-Za-z-]*)"
VALID = rf"^v?({_NUMBER})\.({_NUMBER})\.({_NUMBER})(?:-({_PART}(?:\.{_PART})*))?(?:\+[0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*)?$"
#: The first number, or numbers with dots, of a text that is no version by itself.
COERCED = r"(?:^|[^0-9])([0-9]{1,16})(?:\.([0-9]{1,16}))?(?:\.([0-9]{1,16}))?(?:$|[^0-9])"
#: Largest number that a version may hold.
MOST = 2**53 - 1


class Version(NamedTuple):
    """A version outside Spark; tuples of these order like versions. A part of a prerelease is (text?, number, text)."""

    major: int
    minor: int
    patch: int
    released: bool
    pre: tuple[tuple[bool, int, str], ...]


class Ranges(NamedTuple):
    """A source's ranges, in the order in which they are tried, and what holds where none does."""

    ranges: tuple[tuple[str, str], ...]
    fallback: str | None


# The ranges of the sources.
SOURCES = {
    "claude-code": Ranges((("v1", ">=1.0.0 <2.0.0"),), "v1"),
    "codex": Ranges((("v0.128", ">=0.128.0 <0.129.0"),), "v0.128"),
    "pi": Ranges((("v1", ">=3.0.0 <4.0.0"),), "v1"),
}


def version(text: str) -> Version:
    """A valid version."""
    m = re.match(VALID, text.strip())
    if not m:
        raise ValueError(f"no version: {text}")
    pre = tuple((not p.isdigit(), int(p) if p.isdigit() else 0, "" if p.isdigit() else p) for p in m[4].split(".")) if m[4] else ()
    return Version(int(m[1]), int(m[2]), int(m[3]), not m[4], pre)


def parsed(text) -> Column:
    """A version column as an ordered struct: as it is if it is valid, else the first number in it; null if there is none."""
    raw = F.col(text) if isinstance(text, str) else text
    raw = raw.cast("string")
    trimmed = F.regexp_replace(raw, r"^\s+|\s+\z", "")
    number = lambda pattern, of, k: F.regexp_extract(of, pattern, k).try_cast("long")
    parts = F.filter(F.split(F.regexp_extract(trimmed, VALID, 4), r"\."), lambda p: p != "")
    digits = lambda p: p.rlike("^[0-9]+$")
    pre = F.transform(parts, lambda p: F.struct((~digits(p)).alias("named"), F.when(digits(p), p.try_cast("long")).otherwise(F.lit(0).cast("long")).alias("number"), F.when(digits(p), F.lit("")).otherwise(p).alias("text")))
    exact = F.struct(*[number(VALID, trimmed, k + 1).alias(n) for k, n in enumerate(("major", "minor", "patch"))], (F.size(parts) == 0).alias("released"), pre.alias("pre"))
    fits = lambda v: (v["major"] <= MOST) & (v["minor"] <= MOST) & (v["patch"] <= MOST)
    none = F.array().cast("array<struct<named: boolean, number: bigint, text: string>>")
    loose = F.struct(number(COERCED, raw, 1).alias("major"), *[F.coalesce(number(COERCED, raw, k), F.lit(0).cast("long")).alias(n) for k, n in ((2, "minor"), (3, "patch"))], F.lit(True).alias("released"), none.alias("pre"))
    return F.when(trimmed.rlike(VALID) & F.coalesce(fits(exact), F.lit(False)), exact).when(raw.rlike(COERCED) & F.coalesce(fits(loose), F.lit(False)), loose)


def _interval(clause: str) -> tuple[tuple, tuple | None]:
    """[low, high) of comparators that all hold; a bound is (version, after it?)."""
    low, high = (Version(0, 0, 0, False, ()), False), None
    for op, text in re.findall(r"(>=|<=|>|<|=)?\s*([^\s<>=]+)", clause):
        v = version(text)
        if op in (">=", ">", "=", ""):
            low = max(low, (v, op == ">"))
        if op in ("<", "<=", "=", ""):
            high = min(filter(None, (high, (v, op not in ("<",)))))
    return low, high


def intervals(ranges: Ranges) -> list[tuple[tuple, str | None]]:
    """(bound, schema) in order: from a bound on, up to the next, this schema holds; where ranges overlap the first one does."""
    spans = [(schema, *_interval(clause)) for schema, text in ranges.ranges for clause in text.split("||")]
    bounds = sorted({b for _, low, high in spans for b in (low, high) if b is not None})
    held = [next((s for s, low, high in spans if low <= b and (high is None or b < high)), ranges.fallback) for b in bounds]
    return [(b, s) for i, (b, s) in enumerate(zip(bounds, held)) if not i or s != held[i - 1]]


def _literal(v: Version) -> Column:
    pre = F.array(*[F.struct(F.lit(a).alias("named"), F.lit(b).cast("long").alias("number"), F.lit(c).alias("text")) for a, b, c in v.pre]).cast("array<struct<named: boolean, number: bigint, text: string>>")
    return F.struct(*[F.lit(x).cast("long").alias(n) for n, x in zip(("major", "minor", "patch"), v)], F.lit(v.released).alias("released"), pre.alias("pre"))


def _searched(v: Column, steps: list[tuple[tuple, str | None]], below: str | None) -> Column:
    """The schema of the last bound that is not above the version, by halves."""
    if not steps:
        return F.lit(below).cast("string")
    mid = len(steps) // 2
    (at, after), schema = steps[mid]
    here = v > _literal(at) if after else v >= _literal(at)
    return F.when(here, _searched(v, steps[mid + 1:], schema)).otherwise(_searched(v, steps[:mid], below))


def schema_version(agent, source_version, sources: dict[str, Ranges] = SOURCES) -> Column:
    """The schema that reads a source's version: of the first range that holds it, else the source's fallback.

    Null for a null version or a source without ranges. Texts that are no version are taken
    by the first number in them; a text without a number, and a version in no range, get the
    fallback. A prerelease comes before its release and may lie in any range.
    """
    agent = F.col(agent) if isinstance(agent, str) else agent
    source_version = F.col(source_version) if isinstance(source_version, str) else source_version
    out = None

    def search(ranges: Ranges):
        return lambda v: F.when(v.isNull(), F.lit(ranges.fallback)).otherwise(_searched(v, intervals(ranges), ranges.fallback))

    for name, ranges in sources.items():
        # The version is parsed once and searched as a bound variable.
        found = F.element_at(F.transform(F.array(parsed(source_version)), search(ranges)), 1)
        out = F.when(agent == name, found) if out is None else out.when(agent == name, found)
    return F.when(source_version.isNotNull(), out) if out is not None else F.lit(None).cast("string")
