"""Column functions over variant fields: INFO and FORMAT access, vectors, genotypes, windows.

All of them are built-in expressions, so they stay in generated code or JVM-side higher-order functions.
Arrays are read with ``get``, never with ``[i]``: Catalyst may move an expression to rows where the index is out
of range, and ANSI mode raises there.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A number as the predicate language reads it; guards try_cast, which accepts more.
NUMBER = "^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?(?i:inf|infinity|nan)$"


def quoted(key: str) -> str:
    return re.sub(r"([^A-Za-z0-9_])", r"\\\1", key)


def present(value: Column) -> Column:
    """Neither null, empty nor '.'."""
    return F.coalesce(~value.isin("", "."), F.lit(False))


def number(value: Column) -> Column:
    """double, or null if the text is not a number. Value is mentioned once: each mention is evaluated in lambdas."""
    return F.regexp_extract(value, NUMBER, 0).try_cast("double")


def position(value: Column) -> Column:
    """bigint of plain digits, null otherwise."""
    return F.when(F.regexp_like(value, F.lit("^[0-9]+$")), value.try_cast("bigint"))


def info_value(info: Column, key: str) -> Column:
    """Text of the first KEY=... entry; null if there is none (a flag has no value)."""
    pattern = f"(?:^|;){quoted(key)}=([^;]*)"
    return F.when(F.regexp_like(info, F.lit(pattern)), F.regexp_extract(info, pattern, 1))


def vector(value: Column) -> Column:
    return F.split(value, ",")


def numbers(value: Column) -> Column:
    """The numeric elements of a comma-separated value; others are skipped."""
    return F.filter(F.transform(vector(value), number), lambda x: x.isNotNull())


def format_index(fmt: Column, key: str) -> Column:
    """0-based place of a FORMAT key; null if absent."""
    at = F.array_position(F.split(fmt, ":"), F.lit(key))
    return F.when(at > 0, (at - 1).cast("int"))


def sample_value(sample: Column, index: Column) -> Column:
    """Sub-value of a sample; null beyond its last."""
    return F.get(F.split(sample, ":"), index)


def alleles(ref: Column, alt: Column) -> Column:
    """REF and the ALT labels; an ALT of '.' is a label."""
    return F.concat(F.array(ref), F.split(alt, ","))


def genotype_slots(gt: Column) -> Column:
    """Allele tokens of a genotype text."""
    return F.split(gt, "[/|]")


def genotype(gt: Column) -> Column:
    """array<int> of called alleles; null if the genotype is absent or holds a missing allele.
    Tokens that are not digits are skipped, so 0/x reads as a single 0."""
    digits = lambda s: F.transform(F.filter(s, lambda a: F.regexp_like(a, F.lit("^[0-9]+$"))), lambda a: a.try_cast("int"))
    called = lambda s: let(digits(s), lambda c: F.when(F.size(c) > 0, c))
    return F.when(present(gt), let(genotype_slots(gt), lambda s: F.when(~F.exists(s, lambda a: a.isin("", ".")), called(s))))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once, however often body uses it: the optimiser inlines columns into
    filters and lambdas, where every mention would be evaluated again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def allele_counts(genotypes: Column, n_alleles: Column) -> Column:
    """Count of each allele over array<array<int>>; null genotypes and alleles beyond the labels are left out."""
    flat = F.flatten(F.filter(genotypes, lambda g: g.isNotNull()))
    return let(flat, lambda f: F.transform(F.sequence(F.lit(0), n_alleles - 1), lambda i: F.size(F.filter(f, lambda a: a == i)).cast("bigint")))


def total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, x: a + x)


def site_pi(counts: Column) -> Column:
    """n/(n-1) (1 - sum of squared frequencies); null below two alleles."""

    def known(s: Column) -> Column:
        n, c = s["n"], s["c"]
        return F.when(n >= 2, n / (n - 1) * (1 - F.aggregate(c, F.lit(0.0), lambda a, x: a + (x / n) * (x / n))))

    return let(counts, lambda c: let(F.struct(total(c).alias("n"), c.alias("c")), known))


def dosage(gt: Column) -> Column:
    """Number of 1 alleles; null if missing or an allele is above 1."""
    return F.when(F.forall(gt, lambda a: a <= 1), F.size(F.filter(gt, lambda a: a == 1)))


def window_start(pos: Column, size: int) -> Column:
    """First position of the 1-based window of a position."""
    return (F.expr(f"cast({size} as bigint)") * F.floor((pos - 1) / size) + 1).cast("bigint")


def window_start0(pos: Column, size: int) -> Column:
    """Start of the 0-based window of a position."""
    return (F.floor(pos / size) * size).cast("bigint")


def is_snp(ref: Column, alt: Column) -> Column:
    return (F.length(ref) == 1) & (F.length(alt) == 1)


def is_transition(ref: Column, alt: Column) -> Column:
    return F.concat(F.upper(ref), F.upper(alt)).isin("AG", "GA", "CT", "TC")
