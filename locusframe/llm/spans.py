"""Spans of regular-expression matches as native columns: (start, end) in code points, leftmost, not overlapping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_CHUNK = 256
SPAN = "array<struct<start:int,kind_no:int,end:int,kind:string,value:string>>"
IN_CONTEXT = "array<struct<span:struct<start:int,kind_no:int,end:int,kind:string,value:string>,before:string,after:string>>"


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0), lambda a, x: a + x)


def running_sums(array: Column) -> Column:
    """Sums of an int array up to and with each element, in chunks so that long arrays stay far from quadratic."""
    part = lambda c: F.slice(array, c * _CHUNK + 1, F.lit(_CHUNK))
    chunks = F.sequence(F.lit(0), F.ceil(F.size(array) / _CHUNK).cast("int") - 1)
    sums = F.transform(chunks, lambda c: _sum(part(c)))

    def within(c: Column) -> Column:
        start = F.struct(_sum(F.slice(sums, F.lit(1), c)).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(part(c), start, lambda a, x: F.struct((a["at"] + x).alias("at"), F.array_append(a["out"], a["at"] + x).alias("out")), lambda a: a["out"])

    return F.when(F.size(array) == 0, F.array().cast("array<int>")).otherwise(F.flatten(F.transform(chunks, within)))


def matches(text: Column, pattern: str, kind: str, kind_no: int, *, group: int = 0, probe: Column | None = None, original: Column | None = None) -> Column:
    """Spans of all matches of pattern, which must not match the empty string; value holds the group.

    A match's place follows from the lengths of the pieces between the matches.  ``probe`` is a cheap condition
    without which nothing can match; ``original`` gives values if text is a copy with other characters in place.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), F.length)
    ends = running_sums(F.zip_with(gaps, found, lambda g, m: g + F.length(m)))
    rows = F.zip_with(F.zip_with(ends, found, lambda e, m: F.struct(e.alias("e"), F.length(m).alias("n"))), values, lambda p, v: F.struct((p["e"] - p["n"]).alias("start"), F.lit(kind_no).alias("kind_no"), p["e"].alias("end"), F.lit(kind).alias("kind"), v.alias("value")))
    if original is not None:
        rows = F.transform(rows, lambda r: r.withField("value", F.substring(original, r["start"] + 1, r["end"] - r["start"])))
    condition = F.regexp_like(text, F.lit(pattern))
    if probe is not None:
        condition = probe & condition
    return F.when(condition, rows).otherwise(F.array()).cast(SPAN)


def in_context(text: Column, pattern: str, kind: str, kind_no: int, *, probe: Column | None = None, before: int = 40, after: int = 20) -> Column:
    """Spans as of ``matches`` in structs (span, before, after) with the text around, which ends at the next match."""
    pieces = F.split(text, pattern, -1)
    # pieces are found once for all matches, not for each
    near = F.flatten(F.transform(F.array(pieces), lambda p: F.transform(F.sequence(F.lit(0), F.size(p) - 2), lambda i: F.struct(F.substring(F.get(p, i), -before, before).alias("before"), F.substring(F.get(p, i + 1), 1, after).alias("after")))))
    spans = matches(text, pattern, kind, kind_no, probe=probe)
    both = F.zip_with(spans, near, lambda s, n: F.struct(s.alias("span"), n["before"].alias("before"), n["after"].alias("after")))
    condition = F.regexp_like(text, F.lit(pattern))
    return F.when(condition if probe is None else probe & condition, both).otherwise(F.array()).cast(IN_CONTEXT)


def below(sorted_values: Column, x: Column) -> Column:
    """How many of an array's ascending numbers are less than x, by bisection."""
    start = F.struct(F.lit(0).alias("lo"), F.size(sorted_values).alias("hi"))

    def step(a: Column, _: Column) -> Column:
        mid = F.floor((a["lo"] + a["hi"]) / 2).cast("int")
        less = (a["lo"] < a["hi"]) & (F.get(sorted_values, mid) < x)
        return F.struct(F.when(less, mid + 1).otherwise(a["lo"]).alias("lo"), F.when((a["lo"] < a["hi"]) & ~less, mid).otherwise(a["hi"]).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(31)), start, step, lambda a: a["lo"])


def rendered(spans: Column) -> Column:
    """kind:start:end of each span by start, then kind number, joined by commas."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")
