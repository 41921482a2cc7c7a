"""The whole hunt: line rules and keyed rules over one set of records."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlog.lineage import settle
from wardlog.operators.normalize import normalize
from wardlog.operators.rules import Rule, load_rules
from wardlog.operators.scan import scan
from wardlog.operators.summary import REPORT_TOP_LIMIT, detail_rows, finding_counts, severity_rows
from wardlog.operators.windows import detect_keyed
from wardlog.sources.inputs import read_logs


@dataclass(frozen=True)
class LogHunt:
    """Frames of one hunt over log files, and the rule documents that were rejected."""

    records: DataFrame
    rejects: DataFrame
    findings: DataFrame
    rule_problems: list[str]


def hunt(records: DataFrame, rules: Sequence[Rule] | None = None, min_level: str = "low") -> DataFrame:
    """Findings of a rule pack (the bundled one by default) at or above a level."""
    if rules is None:
        rules, _ = load_rules()
    findings = scan(records, rules, min_level)
    keyed = detect_keyed(records, rules, min_level)
    return findings if keyed is None else findings.unionByName(keyed)


def hunt_logs(spark: SparkSession, inputs: str | Sequence[str], rules_path: str | None = None, zone: str = "UTC",
              min_level: str = "low", strict: bool = False, staging: str | None = None) -> LogHunt:
    """Read log files, normalise them and hunt.

    A hunt passes over the records several times. With ``staging`` (a folder that does not exist
    yet) the text is read once, rejects included, and kept there as Parquet, so later passes read only the columns
    they need.
    """
    rules, problems = load_rules(rules_path) if rules_path else load_rules()
    if not rules:
        raise ValueError(f"no valid rules in {rules_path}")
    source = read_logs(spark, inputs, strict)
    lines = normalize(source.lines, zone, carry=("reason",))
    if staging:
        lines.write.parquet(staging)
        lines = spark.read.parquet(staging)
    records = lines.where(F.col("reason").isNull()).drop("reason")
    rejects = lines.where(F.col("reason").isNotNull()).select(*source.notices.columns).unionByName(source.notices)
    return LogHunt(records, rejects, hunt(records, rules, min_level), problems)


def report_tables(findings: DataFrame) -> dict[str, DataFrame]:
    """The data of the analyst report, one frame per section; all counts come from one pass over the findings."""
    counts = settle(finding_counts(findings))

    def top(field: str) -> DataFrame:
        return (counts.where((F.col("section") == field) & F.col(field).isNotNull())
                .orderBy(F.desc("n"), field).limit(REPORT_TOP_LIMIT).select(field, F.col("n").alias("count")))

    detail = detail_rows(findings).select(
        "timestamp", "level", "rule_id", "src_ip", "method", "uri_path", "uri_query", "status_code",
        F.concat_ws(":", "log_file", F.col("line_number").cast("string")).alias("source_line"))
    return {
        "findings_by_severity": severity_rows(counts.where("section = 'level'").select("level", "n")),
        "top_source_ips": top("src_ip"),
        "top_uri_paths": top("uri_path"),
        "top_user_agents": top("user_agent"),
        "rule_hits": (counts.where("section = 'rule'").select("rule_id", "rule_title", "level", F.col("n").alias("hits"))
                      .orderBy(F.desc("hits"), "rule_id")),
        "detailed_findings": detail,
    }
