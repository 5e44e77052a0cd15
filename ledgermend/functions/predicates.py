"""Missing-value tests, filters and hash sampling as columns."""

from __future__ import annotations

import ast
import operator
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SENTINELS = ("", "--")


def missing_exact(c: Column) -> Column:
    """Null, empty or ``--``, untrimmed: the matching rules' notion."""
    return c.isNull() | c.isin(*SENTINELS)


def missing_trimmed(c: Column) -> Column:
    """The same after trimming: the consensus rules' notion."""
    return c.isNull() | F.trim(c).isin(*SENTINELS)


def missing_placeholder(c: Column, placeholders: Sequence[str]) -> Column:
    """Null, blank, or one of the placeholders in any case: the branch rules' notion."""
    bare = F.lower(F.trim(c))
    return c.isNull() | (bare == "") | bare.isin(*placeholders)


def in_states(state: Column, eligible: Sequence[int]) -> Column:
    """Whether a routed state is eligible; an unknown state never is."""
    return F.coalesce(state.isin(*eligible), F.lit(False))


def hash_bucket(text: Column, digits: int = 8) -> Column:
    """The first hex digits of SHA-256 modulo 100: 8 for ingestion canaries, 4 for validation canaries."""
    return F.pmod(F.conv(F.substring(F.sha2(text.cast("string").cast("binary"), 256), 1, digits), 16, 10).cast("long"), F.lit(100))


def sampled(text: Column, percent: int, digits: int = 8) -> Column:
    return hash_bucket(text, digits) < percent


@dataclass
class ExportFilter:
    """Optional conditions that are all required: membership, a closed cycle range, a closed time range."""

    members: Mapping[str, Sequence[str]] = field(default_factory=dict)
    ranges: Mapping[str, tuple] = field(default_factory=dict)
    at_least: Mapping[str, object] = field(default_factory=dict)
    at_most: Mapping[str, object] = field(default_factory=dict)

    def condition(self) -> Column | None:
        """None when nothing is asked, so that no filter is planned."""
        parts = [F.col(c).isin(*v) for c, v in self.members.items() if v]
        parts += [F.col(c).between(*v) for c, v in self.ranges.items() if v]
        parts += [F.col(c) >= F.lit(v) for c, v in self.at_least.items() if v is not None]
        parts += [F.col(c) <= F.lit(v) for c, v in self.at_most.items() if v is not None]
        return reduce(Column.__and__, parts) if parts else None


#: Comparisons that a declarative rule may use.
_TESTS = {
    "eq": lambda a, b: a == b,
    "ne": lambda a, b: a != b,
    "lt": lambda a, b: a < b,
    "lte": lambda a, b: a <= b,
    "gt": lambda a, b: a > b,
    "gte": lambda a, b: a >= b,
}


def compiled(rule: Mapping) -> Column:
    """A rule tree as one column; whatever can't be compared is false.

    ``{"all": [...]}``, ``{"any": [...]}``, ``{"not": ...}``, or one test such as
    ``{"field": "facts.balance", "gt": 100}``.
    """
    if "all" in rule:
        return reduce(Column.__and__, (compiled(r) for r in rule["all"]), F.lit(True))
    if "any" in rule:
        return reduce(Column.__or__, (compiled(r) for r in rule["any"]), F.lit(False))
    if "not" in rule:
        return ~compiled(rule["not"])
    tests = [_TESTS[k](F.col(rule["field"]), F.lit(v)) for k, v in rule.items() if k in _TESTS]
    return F.coalesce(reduce(Column.__and__, tests, F.lit(True)), F.lit(False))


_COMPARISONS = {ast.Eq: operator.eq, ast.NotEq: operator.ne, ast.Gt: operator.gt, ast.GtE: operator.ge, ast.Lt: operator.lt, ast.LtE: operator.le}


def rule_text(expression: str, columns: Mapping[str, Column]) -> Column:
    """A rule such as ``balance > 0 and not (status == 'open')`` as a column; what can't be told is false.

    Allowed are and, or, not, signs, chained comparisons, constants and the names given, in any case.
    Anything else, and text that doesn't parse, makes the whole rule false.
    """

    def built(node: ast.AST) -> Column:
        if isinstance(node, ast.BoolOp):
            return reduce(Column.__and__ if isinstance(node.op, ast.And) else Column.__or__, [F.coalesce(built(v), F.lit(False)) for v in node.values])
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not):
            return ~F.coalesce(built(node.operand), F.lit(False))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.UAdd | ast.USub):
            return built(node.operand) if isinstance(node.op, ast.UAdd) else -built(node.operand)
        if isinstance(node, ast.Compare):
            sides = [built(x) for x in (node.left, *node.comparators)]
            return reduce(Column.__and__, [_COMPARISONS[type(op)](a, b) for op, a, b in zip(node.ops, sides, sides[1:], strict=False)])
        if isinstance(node, ast.Name):
            name = node.id.lower()
            return F.lit(name == "true") if name in ("true", "false") else columns[name]
        if isinstance(node, ast.Constant):
            return F.lit(node.value)
        raise ValueError(ast.dump(node))

    try:
        return F.coalesce(built(ast.parse(expression, mode="eval").body).cast("boolean"), F.lit(False))
    except (SyntaxError, ValueError, KeyError):
        return F.lit(False)
