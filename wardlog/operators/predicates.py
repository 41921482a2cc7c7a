"""Rule tests as boolean Columns that are never NULL (a test of a missing value is false)."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlog.functions.clock import iso_text
from wardlog.functions.text import text_array
from wardlog.operators.literals import any_hit, literal_hits
from wardlog.operators.rules import Branch, FieldTest, Rule, Selection

Probe = Callable[[FieldTest], Column]

# Cheap tests go first in a conjunction; the order does not change results.
_COST = {"exists": 0, "not_exists": 0, "bounds": 1, "equals": 2, "startswith": 3, "endswith": 3,
         "contains": 4, "re": 5}
_NUMBER = r"(?i)^\s*[+-]?((\d+(\.\d*)?|\.\d+)(e[+-]?\d+)?|inf|infinity|nan)\s*\z"


def value_of(records: DataFrame, name: str) -> Column:
    """A field by record column, else by raw name from ``extra``; NULL when unknown."""
    if name == "timestamp" and name in records.columns:
        return iso_text(F.col(name)) if dict(records.dtypes)[name].startswith("timestamp") else F.col(name)
    if name in records.columns:
        return F.col(f"`{name}`")
    if "extra" in records.columns:
        return F.try_element_at("extra", F.lit(name))
    return F.lit(None).cast("string")


def text_of(records: DataFrame, name: str) -> Column:
    return value_of(records, name).cast("string")


def java_pattern(pattern: str) -> str:
    """A Python pattern for the JVM: ignore case, Unicode classes, other spelling of named groups."""
    pattern = pattern.replace("(?P<", "(?<").replace("\\Z", "\\z")
    return "(?iU)" + re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", pattern)


def _within(records: DataFrame, test: FieldTest) -> Column:
    value = value_of(records, test.name)
    if dict(records.dtypes).get(test.name, "string") in ("string", "boolean"):
        text = value.cast("string")
        value = F.when(text.rlike(_NUMBER), text.try_cast("double"))
    compare = {"gte": lambda b: value >= b, "gt": lambda b: value > b,
               "lte": lambda b: value <= b, "lt": lambda b: value < b}
    return reduce(Column.__and__, [compare[op](F.lit(bound)) for op, bound in test.operands], value.isNotNull())


def _direct(records: DataFrame, test: FieldTest, lowered: Column) -> Column:
    if test.kind == "exists":
        return value_of(records, test.name).isNotNull()
    if test.kind == "not_exists":
        return value_of(records, test.name).isNull()
    if test.kind == "bounds":
        return _within(records, test)
    if test.kind == "re":
        text = text_of(records, test.name)
        return reduce(Column.__or__, [text.rlike(java_pattern(p)) for p in test.operands])
    wanted = list(dict.fromkeys(v.lower() for v in test.operands))
    if test.kind == "equals":
        return lowered == F.lit(wanted[0]) if len(wanted) == 1 else F.array_contains(text_array(wanted), lowered)
    if test.kind == "contains" and len(wanted) > 1:
        return F.exists(text_array(wanted), lambda literal: F.contains(lowered, literal))
    matches = {"contains": lowered.contains, "startswith": lowered.startswith, "endswith": lowered.endswith}
    return reduce(Column.__or__, [matches[test.kind](v) for v in wanted])


def direct_probe(records: DataFrame) -> Probe:
    """Tests straight on the record columns; right for a single rule."""
    return cache(lambda test: F.coalesce(_direct(records, test, F.lower(text_of(records, test.name))), F.lit(False)))


def staged_probe(records: DataFrame, tests: Iterable[FieldTest]) -> tuple[DataFrame, Probe]:
    """Helper columns shared by many tests (lower-case text, literals found) and a probe over them.

    Helper columns start with ``_low_`` or ``_hit_``.
    """
    tests = list(tests)
    lowered = {t.name for t in tests if t.kind in ("equals", "startswith", "endswith", "contains")}
    searched: dict[str, set[str]] = {}
    for test in tests:
        if test.kind == "contains":
            searched.setdefault(test.name, set()).update(v.lower() for v in test.operands if v)
    staged = records.withColumns({f"_low_{n}": F.lower(text_of(records, n)) for n in sorted(lowered)})
    staged = staged.withColumns({f"_hit_{n}": literal_hits(F.col(f"`_low_{n}`"), literals)
                                 for n, literals in sorted(searched.items()) if literals})

    @cache  # rules share many tests
    def probe(test: FieldTest) -> Column:
        if test.kind == "contains" and all(test.operands):
            found = any_hit(F.col(f"`_hit_{test.name}`"), [v.lower() for v in test.operands], searched[test.name])
        else:
            found = _direct(records, test, F.col(f"`_low_{test.name}`") if test.name in lowered else F.lit(None))
        return F.coalesce(found, F.lit(False))

    return staged, probe


def selection_holds(selection: Selection, probe: Probe) -> Column:
    """All tests of a selection; an empty one holds for every row."""
    ordered = sorted(selection, key=lambda t: _COST[t.kind])
    return reduce(Column.__and__, map(probe, ordered)) if ordered else F.lit(True)


def branch_holds(branch: Branch, probe: Probe) -> Column:
    held = reduce(Column.__and__, [selection_holds(s, probe) for s in branch.required])
    return held if branch.excluded is None else held & ~selection_holds(branch.excluded, probe)


def branch_tests(branches: Iterable[Branch]) -> list[FieldTest]:
    return [t for b in branches for s in (*b.required, b.excluded or ()) for t in s]


def matching(records: DataFrame, rule: Rule) -> DataFrame:
    """Records that a line rule matches."""
    probe = direct_probe(records)
    return records.where(reduce(Column.__or__, [branch_holds(b, probe) for b in rule.branches]))
