"""Multi-rule scan: every line rule against every record in one pass, 0..n findings per record."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlog.operators.predicates import branch_holds, branch_tests, staged_probe, text_of, value_of
from wardlog.operators.rules import Branch, Rule, line_rules, rule_catalog
from wardlog.schema import FINDING_COLUMNS, FINDING_RECORD_COLUMNS

# Beside the finding columns, findings carry these for ordering and grouping.
ORDER_COLUMNS = ("category", "rule_seq", "phase")
LINE_PHASE, WINDOW_PHASE, RARITY_PHASE = 0, 1, 2
TAKEN, SKIPPED = -1, -2  # kinds of lines beside the rules


def record_columns(records: DataFrame) -> list[Column]:
    """The part of a finding that comes from the record."""
    return [value_of(records, source).alias(target) for source, target in FINDING_RECORD_COLUMNS.items()]


def as_findings(matches: DataFrame, rules: Sequence[Rule], phase: int) -> DataFrame:
    """Add rule attributes; the catalog is the rule pack itself, a few rows of configuration."""
    catalog = rule_catalog(matches.sparkSession, rules).drop("type")
    return (matches.join(F.broadcast(catalog), "rule_seq").withColumn("phase", F.lit(phase))
            .select(*FINDING_COLUMNS, *ORDER_COLUMNS))


def _fired(records: DataFrame, rules: list[Rule], min_level: str) -> tuple[DataFrame, list[tuple[int, Branch]], Column]:
    """Records made ready for the rules, the numbered branches of the rules, and the branches that hold for a record: one a
    rule at most."""
    active = line_rules(rules, min_level)
    branches = [(rules.index(rule), branch) for rule in active for branch in rule.branches]
    staged, probe = staged_probe(records, branch_tests(branch for _, branch in branches))

    number = iter(range(len(branches)))
    verdicts = []
    for rule in active:
        verdict = F
        for branch in rule.branches:
            verdict = verdict.when(branch_holds(branch, probe), F.lit(next(number)))
        verdicts.append(verdict)
    return staged, branches, F.array_compact(F.array(*verdicts)) if verdicts else F.array().cast("array<int>")


def scan_counts(lines: DataFrame, rules: Sequence[Rule], min_level: str = "low") -> DataFrame:
    """log_file, kind, n: lines taken (TAKEN) and skipped (SKIPPED, those with a reason) and findings of every rule (kind is its
    number in the pack), from one pass over normalised lines that carry their ``reason``."""
    rules = list(rules)
    staged, branches, fired = _fired(lines, rules, min_level)
    rule_of = F.array(*[F.lit(seq) for seq, _ in branches]) if branches else F.array().cast("array<int>")
    kinds = F.when(F.col("reason").isNull(), F.concat(F.array(F.lit(TAKEN)), F.transform(fired, lambda b: F.get(rule_of, b)))).otherwise(F.array(F.lit(SKIPPED)))
    return staged.select("log_file", F.explode(kinds).alias("kind")).groupBy("log_file", "kind").agg(F.count(F.lit(1)).alias("n"))


def scan(records: DataFrame, rules: Sequence[Rule], min_level: str = "low") -> DataFrame:
    """Findings of all line rules at or above a level.

    Rules below the level are dropped before the scan. Of an ``or`` rule the first side that
    holds gives the evidence.
    """
    rules = list(rules)
    staged, branches, fired = _fired(records, rules, min_level)
    names = sorted({n for _, branch in branches for n in branch.evidence})
    texts = F.array(*[text_of(records, n) for n in names]) if names else F.array().cast("array<string>")
    hits = staged.select(*records.columns, F.explode(fired).alias("branch_no"))
    catalog = staged.sparkSession.createDataFrame(pa.Table.from_pylist(
        [{"branch_no": i, "rule_seq": seq, "matched_fields": list(branch.evidence),
          "positions": [names.index(n) for n in branch.evidence]}
         for i, (seq, branch) in enumerate(branches)],
        schema=pa.schema([("branch_no", pa.int32()), ("rule_seq", pa.int32()),
                          ("matched_fields", pa.list_(pa.string())), ("positions", pa.list_(pa.int32()))])))
    matches = hits.join(F.broadcast(catalog), "branch_no").select(
        "rule_seq", "matched_fields",
        F.transform("positions", lambda position: F.get(texts, position)).alias("matched_values"),
        *record_columns(records))
    return as_findings(matches, rules, LINE_PHASE)


def scan_order() -> tuple[Column, ...]:
    """Order of a row-by-row scan: by file and line, line rules before windowed ones, both in
    pack order; rarity findings at the end."""
    late = F.col("phase") == RARITY_PHASE
    return (late, F.when(~late, F.col("log_file")), F.when(~late, F.col("line_number")), F.col("phase"), F.col("rule_seq"),
            F.array_join("matched_values", ","))


def in_scan_order(findings: DataFrame) -> DataFrame:
    return findings.orderBy(*scan_order())
