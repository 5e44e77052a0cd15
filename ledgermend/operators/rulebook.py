"""A rulebook as columns: conditions, precedence, exclusions and effects, resolved when the plan is made."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermend.functions.predicates import compiled

#: How priorities rank.
PRIORITIES = {"High": 3, "Medium": 2, "Low": 1}


def in_precedence(rules: Sequence[Mapping], precedence: Sequence[str]) -> list[Mapping]:
    """Rules with a condition in the order that counts: by precedence, those that it doesn't name last and as they stand."""
    ids = [r["id"] for r in rules]
    if len(set(ids)) < len(ids):
        raise ValueError("two rules have one id")
    place = {rule: k for k, rule in enumerate(precedence)}
    return sorted((r for r in rules if r.get("when")), key=lambda r: place.get(r["id"], len(place)))


def strata(rules: Sequence[Mapping], exclusions: Mapping[str, Sequence[str]]) -> list[list[tuple[Mapping, list[str]]]]:
    """Rules of ``in_precedence`` by layers, each with the earlier rules that exclude it: whether it holds needs lower layers alone."""
    excluded = {r["id"]: {*r.get("effect", {}).get("excludes", ()), *exclusions.get(r["id"], ())} for r in rules}
    layers: list[list[tuple[Mapping, list[str]]]] = []
    level: dict[str, int] = {}
    for k, rule in enumerate(rules):
        against = [r["id"] for r in rules[:k] if rule["id"] in excluded[r["id"]]]
        level[rule["id"]] = own = max((level[a] + 1 for a in against), default=0)
        layers += [[] for _ in range(own + 1 - len(layers))]
        layers[own].append((rule, against))
    return layers


def _with_flags(rule: Mapping, flags: Mapping) -> Mapping | bool:
    """A condition whose tests of ``flags.`` are decided: flags are known when the plan is made."""
    for word in ("all", "any"):
        if word in rule:
            return {word: [_with_flags(r, flags) for r in rule[word]]}
    if not rule.get("field", "").startswith("flags."):
        return rule
    value = reduce(lambda at, part: at.get(part) if isinstance(at, Mapping) else None, rule["field"].split(".")[1:], flags)
    return _tested(value, rule)


def _tested(value, rule: Mapping) -> bool:
    for word, test in (("eq", "__eq__"), ("ne", "__ne__"), ("lt", "__lt__"), ("lte", "__le__"), ("gt", "__gt__"), ("gte", "__ge__")):
        if word in rule:
            if word in ("eq", "ne"):
                return (value == rule[word]) is (word == "eq")
            told = getattr(value, test)(rule[word]) if value is not None else NotImplemented
            return told is True
    return False


def condition(rule: Mapping | bool) -> Column:
    """As ``compiled``; ``ne`` holds for a missing value and a test without a comparison never holds."""
    if isinstance(rule, bool):
        return F.lit(rule)
    if "all" in rule:
        return reduce(Column.__and__, map(condition, rule["all"]), F.lit(True))
    if "any" in rule:
        return reduce(Column.__or__, map(condition, rule["any"]), F.lit(False))
    word = next((w for w in ("eq", "ne", "lt", "lte", "gt", "gte") if w in rule), None)
    if word is None:
        return F.lit(False)
    if word in ("eq", "ne"):
        same = F.col(rule["field"]).eqNullSafe(F.lit(rule[word]))
        return same if word == "eq" else ~same
    return compiled({"field": rule["field"], word: rule[word]})


def evaluated(facts: DataFrame, statement: str, rules: Sequence[Mapping], precedence: Sequence[str] = (), exclusions: Mapping[str, Sequence[str]] | None = None, flags: Mapping | None = None) -> DataFrame:
    """``facts`` with rule_hits, needs_evidence, red_flags, suggested_dispute_frame and action_tag.

    A rule that holds takes effect unless a rule of higher precedence that takes effect excludes it.  Hits and evidence are listed once, in the order of
    precedence; the first frame counts; so does the first action of the highest priority, else the first action of any.
    Conditions name columns of ``facts``, ``statement`` and ``flags.``; of each layer of exclusions there is one projection.
    """
    ordered = in_precedence(rules, precedence)
    names = {r["id"]: f"_rule_{k}" for k, r in enumerate(ordered)}
    active = facts.withColumns({"statement": F.coalesce(F.col(statement), F.lit(""))}) if statement != "statement" else facts
    for layer in strata(ordered, exclusions or {}):
        active = active.withColumns({names[r["id"]]: condition(_with_flags(r["when"], flags or {})) & ~reduce(Column.__or__, [F.col(names[a]) for a in against], F.lit(False)) for r, against in layer})
    holds = [(F.col(names[r["id"]]), r.get("effect", {}), r["id"]) for r in ordered]
    empty = F.array().cast("array<string>")
    texts = lambda values: F.array(*[F.lit(v) for v in values]) if values else empty
    listed = lambda field: F.array_distinct(F.concat(empty, *[F.when(on, texts(effect.get(field, [rule] if field == "rule_hits" else []))).otherwise(empty) for on, effect, rule in holds]))
    first = lambda field, some: F.coalesce(*[F.when(on, F.lit(effect[field])) for on, effect, _ in holds if effect.get(field) and some(effect)], F.lit(None).cast("string"))
    ranked = [first("action_tag", lambda e, p=p: PRIORITIES.get(str(e.get("priority", "Low")), 0) == p) for p in sorted(PRIORITIES.values(), reverse=True)]
    found = active.withColumns({
        "rule_hits": listed("rule_hits"), "needs_evidence": listed("needs_evidence"),
        "red_flags": F.when(F.contains(F.lower(statement), F.lit("late")), texts(["late_payment"])).otherwise(empty),
        "suggested_dispute_frame": F.coalesce(first("suggested_dispute_frame", lambda _: True), F.lit("")),
        "action_tag": F.coalesce(*ranked, first("action_tag", lambda _: True), F.lit("")),
    })
    return found.drop(*names.values(), *(["statement"] if statement != "statement" else []))
