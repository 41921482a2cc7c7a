"""Writing findings, timelines and reports.

Every writer leaves a folder of part files. Findings are written as they come; with ``ordered`` they are sorted by
range first, so the parts in name order are in global order. Timelines are always ordered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlog.operators.scan import in_scan_order
from wardlog.operators.summary import timeline
from wardlog.plans.hunt import report_tables
from wardlog.schema import FINDING_COLUMNS, FINDING_LIST_COLUMNS, TIMELINE_COLUMNS


def finding_rows(findings: DataFrame, include_raw: bool = False) -> DataFrame:
    """The finding columns, without the raw line unless asked for."""
    return findings.select(*[c for c in FINDING_COLUMNS if include_raw or c != "raw_line"])


def flat_findings(findings: DataFrame, include_raw: bool = False) -> DataFrame:
    """Findings with lists joined by ``;``, as the CSV output has them."""
    rows = finding_rows(findings, include_raw)
    return rows.withColumns({c: F.concat_ws(";", c) for c in FINDING_LIST_COLUMNS})


def timeline_rows(records: DataFrame) -> DataFrame:
    """Timeline with its timestamp as text (the session runs in UTC)."""
    return timeline(records).withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def write_findings_json(findings: DataFrame, path: str, include_raw: bool = False, ordered: bool = False) -> None:
    """JSON lines; missing values are written as null."""
    findings = in_scan_order(findings) if ordered else findings
    finding_rows(findings, include_raw).write.option("ignoreNullFields", "false").json(path)


def write_findings_csv(findings: DataFrame, path: str, include_raw: bool = False, ordered: bool = False) -> None:
    findings = in_scan_order(findings) if ordered else findings
    _write_csv(flat_findings(findings, include_raw), path)


def write_timeline_csv(records: DataFrame, path: str) -> None:
    _write_csv(timeline_rows(records).select(*TIMELINE_COLUMNS), path)


def _write_csv(frame: DataFrame, path: str) -> None:
    frame.write.options(header=True, escape='"', emptyValue="", ignoreLeadingWhiteSpace=False,
                        ignoreTrailingWhiteSpace=False).csv(path)


def write_parquet(frame: DataFrame, path: str) -> None:
    """Records or findings as Parquet, one folder per day, for later pruning by day.

    Rows are brought together by day and a spread value, so a busy day is written by many tasks
    and a quiet one does not leave a file per task.
    """
    stamp = F.col("timestamp")
    day = F.coalesce(F.substring(F.date_format(stamp, "yyyy-MM-dd"), 1, 10)
                     if dict(frame.dtypes)["timestamp"] == "timestamp" else F.substring(stamp, 1, 10), F.lit("none"))
    (frame.withColumn("day", day).hint("rebalance", "day").write.partitionBy("day").parquet(path))


def write_report(findings: DataFrame, path: str) -> None:
    """One CSV folder per report section."""
    for section, frame in report_tables(findings).items():
        _write_csv(frame, f"{path.rstrip('/')}/{section}")
