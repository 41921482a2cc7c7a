"""Top-N counts, timeline, and summaries of findings."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlog.functions.severity import CATEGORY_ORDER, LEVELS, rank_of, review_rank
from wardlog.lineage import settle, sized
from wardlog.operators.numbering import in_order
from wardlog.operators.rules import Rule, rule_catalog
from wardlog.operators.scan import SKIPPED, TAKEN, in_scan_order, scan_counts, scan_order
from wardlog.schema import REVIEW_GROUPS, TIMELINE_COLUMNS, TOP_FIELDS

# What a report counts findings by.
COUNT_SECTIONS = {"level": ("level",), "src_ip": ("src_ip",), "uri_path": ("uri_path",), "user_agent": ("user_agent",),
                  "rule": ("rule_id", "rule_title", "level")}
# Default limits.
TOP_LIMIT, REPORT_TOP_LIMIT, REPORT_ROWS, REVIEW_ROWS = 20, 10, 200, 100


def top_counts(frame: DataFrame, field: str, limit: int = TOP_LIMIT) -> DataFrame:
    """Most frequent values of a column; ties by value text."""
    return (frame.where(F.col(field).isNotNull()).groupBy(field).agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), F.col(field).cast("string")).limit(limit))


def top_values(records: DataFrame, by: str, limit: int = TOP_LIMIT) -> DataFrame:
    """``top_counts`` of records by one of the offered fields."""
    if by not in TOP_FIELDS:
        raise ValueError(f"by must be one of {', '.join(TOP_FIELDS)}")
    return top_counts(records, by, limit)


TIMELINE_ORDER = ("timestamp", "line_number", "log_file")


def timeline(records: DataFrame) -> DataFrame:
    """Every record in time order; records without time come first."""
    return records.orderBy(*TIMELINE_ORDER).select(*TIMELINE_COLUMNS)


def numbered_timeline(records: DataFrame) -> DataFrame:
    """The timeline with the place of every record in it, for paging through a timeline of any length."""
    return in_order(records.select(*TIMELINE_COLUMNS), TIMELINE_ORDER, "position")


def findings_by_severity(findings: DataFrame) -> DataFrame:
    """Findings per level, most severe first, levels without findings included."""
    return severity_rows(findings.groupBy("level").agg(F.count(F.lit(1)).alias("n")))


def severity_rows(counted: DataFrame) -> DataFrame:
    """Counts (level, n) as a table of all levels, most severe first."""
    levels = counted.sparkSession.createDataFrame(
        pa.table({"level": list(reversed(LEVELS)), "rank": pa.array(range(len(LEVELS)), pa.int32())}))
    return (F.broadcast(levels).join(counted, "level", "left")
            .orderBy("rank").select("level", F.coalesce("n", F.lit(0)).alias("findings")))


def rule_hits(findings: DataFrame) -> DataFrame:
    """Findings per rule, most frequent first."""
    return (findings.groupBy("rule_id", "rule_title", "level").agg(F.count(F.lit(1)).alias("hits"))
            .orderBy(F.desc("hits"), "rule_id"))


def highest_severity(findings: DataFrame) -> DataFrame:
    """One row with the most severe level present (NULL when there are no findings)."""
    return (findings.groupBy("level").agg(F.count(F.lit(1)).alias("n"))
            .agg(F.min_by("level", review_rank(F.col("level"))).alias("highest_severity")))


def _review_group(findings: DataFrame, by: str) -> Column:
    if by in ("src_ip", "host"):
        return F.coalesce(F.nullif(F.col(by), F.lit("")), F.lit("(none)"))
    return F.col({"category": "category", "level": "level", "rule": "rule_id"}[by])


def _group_order(by: str) -> Column:
    if by == "category":
        return rank_of(F.col("review_group"), CATEGORY_ORDER, len(CATEGORY_ORDER))
    if by == "level":
        return review_rank(F.col("review_group"))
    return -F.col("group_size")


def grouped_review(findings: DataFrame, by: str = "category", rows: int = REVIEW_ROWS) -> DataFrame:
    """The first rows of every group of findings (all of them with ``rows`` 0), with the group's size and how many are hidden.

    Sizes come from a separate aggregation, so no group is gathered to count it; the row limit is
    taken before the shuffle as well. Without limit the rows are numbered over the whole order, not group by group.
    """
    if by not in REVIEW_GROUPS:
        raise ValueError(f"by must be one of {', '.join(REVIEW_GROUPS)}")
    grouped = findings.withColumn("review_group", _review_group(findings, by))
    size = F.count(F.lit(1)).alias("group_size")
    order = (review_rank(F.col("level")), F.coalesce("timestamp", F.lit("")),
             "phase", "log_file", "line_number", "rule_seq", F.array_join("matched_values", ","))
    if rows:
        in_group = Window.partitionBy("review_group").orderBy(*order)
        shown = grouped.withColumn("row_in_group", F.row_number().over(in_group)).where(F.col("row_in_group") <= rows)
        shown = shown.join(grouped.groupBy("review_group").agg(size), "review_group")
        hidden = F.greatest(F.col("group_size") - F.lit(rows), F.lit(0))
    else:
        placed = in_order(grouped, ("review_group", *order), "_place")
        groups = sized(settle(placed.groupBy("review_group").agg(size, F.min("_place").alias("_first"))))
        shown = placed.join(groups, "review_group").withColumn("row_in_group", F.col("_place") - F.col("_first") + 1).drop("_place", "_first")
        hidden = F.lit(0).cast("bigint")
    return (shown
            .withColumn("hidden", hidden)
            .withColumn("event_count", event_count())
            .orderBy(_group_order(by), "review_group", "row_in_group"))


def event_count() -> Column:
    """Count carried by a finding of a keyed rule, as text; NULL for other findings."""
    return F.try_element_at(F.col("matched_values"), F.nullif(
        F.array_position("matched_fields", F.lit("event_count")).cast("int"), F.lit(0)))


def detail_rows(findings: DataFrame, limit: int = REPORT_ROWS) -> DataFrame:
    """The first findings in scan order."""
    return in_scan_order(findings).limit(limit)


def numbered_detail(findings: DataFrame, limit: int = REPORT_ROWS) -> DataFrame:
    """The first findings in scan order, with their place in it."""
    return detail_rows(findings, limit).withColumn("position", F.row_number().over(Window.orderBy(*scan_order())))


def finding_counts(findings: DataFrame) -> DataFrame:
    """Findings per level, client, path, agent and rule: one aggregation for all sections of a report.

    Columns: section, the grouped columns (null where they do not belong to the section), and n.
    """
    columns = list(dict.fromkeys(c for names in COUNT_SECTIONS.values() for c in names))
    # the bit of a column, the first one highest, is set where it is not grouped by
    number = {name: sum(1 << k for k, c in enumerate(reversed(columns)) if c not in names) for name, names in COUNT_SECTIONS.items()}
    counted = findings.groupingSets([[F.col(c) for c in names] for names in COUNT_SECTIONS.values()], *columns).agg(F.grouping_id().alias("_set"), F.count(F.lit(1)).alias("n"))
    section = reduce(lambda chain, name: chain.when(F.col("_set") == number[name], F.lit(name)), COUNT_SECTIONS, F)
    return counted.select(section.alias("section"), *columns, "n")


def line_statistics(lines: DataFrame, notices: DataFrame, rules: Sequence[Rule], min_level: str = "low") -> DataFrame:
    """`run_statistics` of the line rules from one pass over the text: normalised lines that carry their reason, and the
    notices of their source."""
    kind = F.col("kind")
    counts = scan_counts(lines, rules, min_level).unionByName(
        notices.groupBy("log_file").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(SKIPPED)))

    def total(which: Column) -> Column:
        return F.coalesce(F.sum(F.when(which, F.col("n"))), F.lit(0))

    return counts.agg(F.count_distinct("log_file").alias("files_parsed"), total(kind == TAKEN).alias("lines_parsed"), total(kind == SKIPPED).alias("skipped"),
                      total(kind >= 0).alias("findings"), F.count_distinct(F.when(kind >= 0, kind)).alias("rules_hit"))


def run_statistics(records: DataFrame, rejects: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: files and lines parsed, lines skipped, findings, rules hit.

    Files count when they gave a record or a reject; ``sources.inputs`` lists empty ones too.
    """
    lines = records.groupBy("log_file").agg(F.count(F.lit(1)).alias("lines"))
    skips = rejects.groupBy("log_file").agg(F.count(F.lit(1)).alias("skips"))
    files = lines.join(skips, "log_file", "full").agg(
        F.count(F.lit(1)).alias("files_parsed"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines_parsed"),
        F.coalesce(F.sum("skips"), F.lit(0)).alias("skipped"))
    hits = findings.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("findings"), F.count(F.lit(1)).alias("rules_hit"))
    # one row each; brought together by aggregation, not by a join without a key
    shape = ("files_parsed", "lines_parsed", "skipped", "findings", "rules_hit")
    return files.unionByName(hits, allowMissingColumns=True).agg(*[F.max(c).alias(c) for c in shape])


def rule_listing(spark, rules: Sequence[Rule]) -> DataFrame:
    """Id, level, type, tags and title of every rule, by id."""
    return (rule_catalog(spark, rules)
            .select("rule_id", "level", "type", F.array_join("tags", ", ").alias("tags"), "rule_title")
            .orderBy("rule_id"))
