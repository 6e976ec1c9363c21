"""The predicate language: text -> syntax tree -> Spark column.

    expr    = and { "||" and }            and = primary { "&&" primary }
    primary = "(" expr ")" | ("ANY" | "ALL") "(" test ")" | "N_PASS" "(" test ")" op number | test
    test    = field op literal            op  = > >= < <= == !=
    field   = CHROM | POS | QUAL | FILTER | DP | AF | INFO/KEY | FORMAT/KEY, the last four with an optional [i]

Missing values ('.', empty, absent, not numeric) make a test false, whatever the operator; CHROM and FILTER compare
as they are.  A number matches a vector if any element does; text compares with the whole value unless indexed.
"""

from __future__ import annotations

import operator
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from locusframe.functions import variant as v


class ExpressionError(ValueError):
    """A predicate that cannot be parsed or bound."""


@dataclass(frozen=True)
class Field:
    kind: str  # chrom, pos, qual, filter, info or format
    key: str | None = None
    index: int | None = None


@dataclass(frozen=True)
class Test:
    field: Field
    op: str
    literal: float | str


@dataclass(frozen=True)
class Quantified:
    how: str  # ANY or ALL
    test: Test


@dataclass(frozen=True)
class Passing:
    test: Test
    op: str
    literal: float


@dataclass(frozen=True)
class Both:
    left: object
    right: object


@dataclass(frozen=True)
class Either:
    left: object
    right: object


_SCAN = re.compile(r'\s+|(?P<and>&&)|(?P<or>\|\|)|(?P<open>\()|(?P<close>\))|(?P<op>>=|<=|==|!=|>|<)|(?P<text>"[^"]*")|(?P<number>-[0-9.]*|[0-9][0-9.]*)|(?P<name>[A-Za-z_][A-Za-z0-9_/\[\]]*)')
_COMPARE = {">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le, "==": operator.eq, "!=": operator.ne}


def _tokens(source: str) -> list[tuple[str, object]]:
    out, at = [], 0
    while at < len(source):
        m = _SCAN.match(source, at)
        if not m:
            c = source[at]
            raise ExpressionError("unterminated string literal" if c == '"' else "expected operator" if c in "=!" else f"unexpected character '{c}'")
        at = m.end()
        if m.lastgroup == "number":
            try:
                out.append(("number", float(m[0])))
            except ValueError:
                raise ExpressionError(f"invalid numeric literal '{m[0]}'") from None
        elif m.lastgroup == "text":
            out.append(("text", m[0][1:-1]))
        elif m.lastgroup:
            out.append((m.lastgroup, m[0]))
    return out


def _field(name: str) -> Field:
    if name in ("CHROM", "POS", "QUAL", "FILTER"):
        return Field(name.lower())
    if name in ("DP", "AF"):
        return Field("info", name)
    kind, raw = "info", None
    if name.startswith(("DP[", "AF[")):
        raw = name
    elif name.startswith("INFO/") and len(name) > 5:
        raw = name[5:]
    elif name.startswith("FORMAT/") and len(name) > 7:
        kind, raw = "format", name[7:]
    if raw is None:
        raise ExpressionError(f"unsupported field '{name}'")
    key, bracket, rest = raw.partition("[")
    if not bracket:
        return Field(kind, raw)
    if not raw.endswith("]") or not key:
        raise ExpressionError(f"malformed vector field '{raw}'")
    if not re.fullmatch("[0-9]+", rest[:-1]):
        raise ExpressionError(f"invalid vector index '{rest[:-1]}'")
    return Field(kind, key, int(rest[:-1]))


class _Reader:
    def __init__(self, source: str):
        self.left = _tokens(source)[::-1]

    def kind(self) -> str | None:
        return self.left[-1][0] if self.left else None

    def take(self, kind: str, what: str):
        if self.kind() != kind:
            raise ExpressionError(f"expected {what}")
        return self.left.pop()[1]

    def either(self):
        out = self.both()
        while self.kind() == "or":
            self.left.pop()
            out = Either(out, self.both())
        return out

    def both(self):
        out = self.primary()
        while self.kind() == "and":
            self.left.pop()
            out = Both(out, self.primary())
        return out

    def primary(self):
        if self.kind() == "open":
            self.left.pop()
            out = self.either()
            self.take("close", "')'")
            return out
        if self.kind() == "name" and self.left[-1][1] in ("ANY", "ALL", "N_PASS"):
            how = self.left.pop()[1]
            self.take("open", "'('")
            test = self.test()
            self.take("close", "')'")
            if test.field.kind != "format":
                raise ExpressionError(f"{'N_PASS' if how == 'N_PASS' else 'ANY/ALL'} predicates require a FORMAT field")
            if how != "N_PASS":
                return Quantified(how, test)
            op, literal = self.take("op", "operator"), self.literal()
            if not isinstance(literal, float):
                raise ExpressionError("N_PASS comparisons require a numeric literal")
            return Passing(test, op, literal)
        return self.test()

    def test(self) -> Test:
        return Test(_field(self.take("name", "field")), self.take("op", "operator"), self.literal())

    def literal(self) -> float | str:
        if self.kind() in ("number", "text"):
            return self.left.pop()[1]
        raise ExpressionError("expected literal")


def parse(source: str):
    """The syntax tree of a predicate."""
    reader = _Reader(source)
    out = reader.either()
    if reader.left:
        raise ExpressionError("unexpected trailing tokens")
    return out


def tests(tree) -> list[Test]:
    """All tests of a tree, those in quantifiers included."""
    if isinstance(tree, Test):
        return [tree]
    if isinstance(tree, (Quantified, Passing)):
        return [tree.test]
    return tests(tree.left) + tests(tree.right)


def needs_sample(tree) -> bool:
    """Whether a FORMAT test stands outside ANY, ALL and N_PASS."""
    if isinstance(tree, Test):
        return tree.field.kind == "format"
    return not isinstance(tree, (Quantified, Passing)) and (needs_sample(tree.left) or needs_sample(tree.right))


def required(tree) -> dict[str, object]:
    """Columns and keys that a predicate reads."""
    fields = [t.field for t in tests(tree)]
    kinds = {f.kind for f in fields}
    return {k: k in kinds for k in ("chrom", "pos", "qual", "filter")} | {k: sorted({f.key for f in fields if f.kind == k}) for k in ("info", "format")}


def compare(value: Column, op: str, literal: float) -> Column:
    """IEEE comparison: null is false, NaN only differs. Value is mentioned once: each mention is evaluated in lambdas."""
    instead = F.lit(None).cast("double") if op != "!=" else F.lit(0.0 if literal else 1.0)
    return F.coalesce(_COMPARE[op](F.nanvl(value, instead), F.lit(float(literal))), F.lit(False))


def _value_test(raw: Column, test: Test) -> Column:
    """A test of an INFO or FORMAT value."""
    value = raw if test.field.index is None else F.get(v.vector(raw), F.lit(test.field.index))
    if isinstance(test.literal, str):
        if test.op == "!=":
            return F.coalesce(~value.isin("", ".", test.literal), F.lit(False))
        return F.coalesce(value == F.lit(test.literal), F.lit(False)) if test.op == "==" and test.literal not in ("", ".") else F.lit(False)
    if test.field.index is not None:
        return compare(v.number(value), test.op, test.literal)
    return F.coalesce(F.exists(v.vector(value), lambda x: compare(v.number(x), test.op, test.literal)), F.lit(False))


def _core_test(test: Test) -> Column:
    column = {"chrom": F.col("chrom"), "filter": F.col("filter"), "pos": F.col("pos").cast("double"), "qual": v.number(F.col("qual"))}[test.field.kind]
    if test.field.kind in ("pos", "qual"):
        return F.lit(False) if isinstance(test.literal, str) else compare(column, test.op, test.literal)
    if not isinstance(test.literal, str) or test.op not in ("==", "!="):
        return F.lit(False)
    return F.coalesce(_COMPARE[test.op](column, F.lit(test.literal)), F.lit(False))


def compile_tree(tree, sample_index: int | None = None) -> Column:
    """The boolean column of a tree over the site columns; never null."""
    if isinstance(tree, Both):
        return compile_tree(tree.left, sample_index) & compile_tree(tree.right, sample_index)
    if isinstance(tree, Either):
        return compile_tree(tree.left, sample_index) | compile_tree(tree.right, sample_index)
    if isinstance(tree, Test):
        if tree.field.kind == "info":
            return _value_test(v.info_value(F.col("info"), tree.field.key), tree)
        if tree.field.kind == "format":
            if sample_index is None:
                raise ExpressionError("FORMAT predicates require --sample")
            sample = F.coalesce(F.get(F.col("samples"), F.lit(sample_index)), F.lit("."))
            return _value_test(v.sample_value(sample, v.format_index(F.col("format"), tree.field.key)), tree)
        return _core_test(tree)

    def over(row: Column) -> Column:
        passes = lambda s: _value_test(v.sample_value(s, row["at"]), tree.test)
        some = row["at"].isNotNull() & (F.size(row["samples"]) > 0)
        if isinstance(tree, Passing):
            n = F.when(some, F.size(F.filter(row["samples"], passes))).otherwise(0)
            return compare(n.cast("double"), tree.op, tree.literal)
        how = F.exists if tree.how == "ANY" else F.forall
        return F.coalesce(some & how(row["samples"], passes), F.lit(False))

    # the place of the key and the samples are bound once a row, outside the lambda
    return v.let(F.struct("samples", v.format_index(F.col("format"), tree.test.field.key).alias("at")), over)


def compile_text(source: str, sample_names: list[str] | None = None, sample: str | None = None) -> Column:
    """Parse, bind the chosen sample and compile."""
    tree = parse(source)
    index = None
    if sample is not None and needs_sample(tree):
        if sample not in (sample_names or []):
            raise ExpressionError(f"sample '{sample}' not found in the header")
        index = sample_names.index(sample)
    if required(tree)["format"] and sample_names is not None and not sample_names:
        raise ExpressionError("FORMAT predicates require a header with samples")
    return compile_tree(tree, index)
