"""W3C extended log files. ``#Fields:`` lines set the layout of the rows below them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardlog.lineage import settle, sized
from wardlog.sources.lines import (FileRange, LogSource, file_ranges, line_at, listed_files, numbered, path_text, split_order,
                                   split_table, text_lines, unreadable)

FIELDS_MARK = "#Fields:"  # fixed value
FEW_LAYOUTS = 10_000


def _is_data(value: Column) -> Column:
    return ~value.startswith("#") & ~value.rlike(r"^\s*\z")


def _layout(value: Column, at: Column) -> Column:
    """What a header line declares: field names and, for repeated names, their last position."""
    names = F.filter(F.split(F.substring(value, len(FIELDS_MARK) + 1, 1 << 30), r"\s+"), lambda n: n != "")
    distinct = F.array_distinct(names)
    last = F.transform(distinct, lambda n: F.size(names) - F.array_position(F.reverse(names), n).cast("int"))
    return F.struct(at.alias("at"), F.size(names).alias("width"), distinct.alias("names"), last.alias("positions"))


def _changes_only(layouts: Column) -> Column:
    """Drop a layout that repeats the one before it (servers write one at every restart)."""
    return F.filter(layouts, lambda layout, i: (i == 0) | (layout["names"] != F.get(layouts, i - 1)["names"])
                    | (layout["width"] != F.get(layouts, i - 1)["width"]))


def _with_layouts(splits: DataFrame) -> DataFrame:
    """Layouts by line number for every split, the one in force at its start included, and the
    line where the file has data before any header."""
    own = splits.withColumn("layouts", F.transform(
        F.array_sort("headers"), lambda h: _layout(h["value"], line_at(h["id"]))))
    carried = F.last(F.try_element_at("layouts", F.lit(-1)), ignorenulls=True).over(
        split_order().rowsBetween(Window.unboundedPreceding, -1))
    whole_file = Window.partitionBy("file_path")
    first_data = F.min(line_at(F.col("first_data_id"))).over(whole_file)
    first_header = F.min(F.try_element_at("layouts", F.lit(1))["at"]).over(whole_file)
    return (own.withColumn("carried", carried)
            .withColumn("cut", F.when(first_header.isNull() | (first_data < first_header), first_data))
            .withColumn("empty_header", F.exists("layouts", lambda layout: layout["width"] == 0))
            .withColumn("layouts", _changes_only(F.array_compact(F.concat(F.array("carried"), "layouts"))))
            .drop("headers", "carried", "first_data_id"))


def _layout_id(names: Column) -> Column:
    return F.xxhash64(F.array_join(names, " "))


def _by_id(splits: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """Splits with layouts as (at, width, id), and the few different layouts by id: a split's row
    stays small however many fields the logs have. Last, whether there are at most FEW_LAYOUTS."""
    forms = settle(splits.select(F.explode("layouts").alias("layout")).select("layout.names", "layout.positions").distinct()
                   .withColumn("layout_id", _layout_id(F.col("names"))))
    counts = forms.agg(F.count(F.lit(1)).alias("forms"), F.countDistinct("layout_id").alias("ids")).first()
    if counts.forms != counts.ids:
        raise ValueError("two field layouts share one hash")
    return splits.withColumn("layouts", F.transform("layouts", lambda layout: F.struct(
        layout["at"].alias("at"), layout["width"].alias("width"), _layout_id(layout["names"]).alias("layout_id")))), forms, counts.forms <= FEW_LAYOUTS


def _in_force() -> Column:
    """Layout of the line, or NULL: the last one above it, if that names any field."""
    above = F.when(F.size("layouts") == 1, F.get("layouts", F.lit(0))).otherwise(
        F.try_element_at(F.filter("layouts", lambda layout: layout["at"] < F.col("line_number")), F.lit(-1)))
    return F.when((above["at"] < F.col("line_number")) & (above["width"] > 0), above)


def _cut_below_empty_headers(lines: DataFrame, splits: DataFrame) -> DataFrame:
    """A header without names also leaves data without layout; find the first such row per file."""
    affected = splits.where("empty_header").select("file_path").distinct()
    if affected.isEmpty():
        return splits
    orphans = (numbered(lines, splits).join(affected, "file_path", "left_semi")
               .where(_is_data(F.col("value")) & _in_force().isNull())
               .groupBy("file_path").agg(F.min("line_number").alias("orphan")))
    return settle(splits.join(orphans, "file_path", "left")
                  .withColumn("cut", F.least("cut", "orphan")).drop("orphan"))


def read_w3c(spark: SparkSession, paths: Sequence[str], name_glob: str | None = None) -> LogSource:
    """Rows of W3C log files, see `_read_range`."""
    return reduce(LogSource.union, [_read_range(spark, files) for files in file_ranges(spark, paths, name_glob)])


def _read_range(spark: SparkSession, files: FileRange) -> LogSource:
    """Rows of W3C log files.

    Skipped with a reason: rows whose number of values differs from the layout, headers without
    names, and everything from the first row without a layout on (one reject for the file).
    """
    lines = text_lines(spark, files)
    value = F.col("value")
    splits = split_table(
        lines,
        headers=F.collect_list(F.when(value.startswith(FIELDS_MARK), F.struct("id", "value"))),
        first_data_id=F.min(F.when(_is_data(value), F.col("id"))))
    splits, forms, few = _by_id(settle(_with_layouts(splits)))
    splits = _cut_below_empty_headers(lines, settle(splits))

    width, given = F.col("layout.width"), F.size("cells")
    problem = (F.when(~_is_data(value), F.when(value.rlike(rf"^{FIELDS_MARK}\s*\z"), F.lit("#Fields: line without names")))
               .when(F.col("layout").isNull(), F.lit("row without a layout; the file is not read beyond it"))
               .when(width != given, F.concat(given, F.lit(" values under "), width, F.lit(" field names"))))
    parsed = (numbered(lines, splits)
              .where(F.coalesce(F.col("line_number") <= F.col("cut"), F.lit(True)))
              .where(_is_data(value) | value.startswith(FIELDS_MARK))
              .withColumn("layout", _in_force())
              .withColumn("cells", F.split(value, " ", -1))
              .withColumn("reason", problem))
    cells = F.when(F.size("names") == width, F.col("cells")).otherwise(
        F.transform("positions", lambda p: F.get("cells", p)))
    where = [path_text(F.col("file_path")).alias("log_file"), F.col("line_number")]
    taken = F.col("reason").isNull()
    lines = (parsed.where(~taken | _is_data(value)).withColumn("layout_id", F.col("layout.layout_id"))
             .join(F.broadcast(forms) if few else sized(forms), "layout_id", "left")
             .select(*where, F.when(taken, value).alias("raw_line"), F.when(taken, F.map_from_arrays("names", cells)).alias("fields"), "reason"))
    return LogSource(lines, unreadable(listed_files(spark, files), splits))
