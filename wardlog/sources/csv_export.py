"""CSV exports of access logs: header names in common spellings, quoted commas and line breaks.

Lines are records unless a quoted cell holds a line break. Only files with a line that would leave a
quoted cell open take the path that joins lines. There every line is a function on two states (outside
or inside a quoted cell); the functions are composed along the splits of a file, so the state before
each line is known without reading a file in one task, and a stray quote inside a cell stays text.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardlog.functions.text import text_array
from wardlog.lineage import settle, sized
from wardlog.schema import W3C_COLUMNS
from wardlog.sources.lines import (FileRange, LogSource, file_ranges, line_at, listed_files, numbered, path_text, split_table,
                                   text_lines, unreadable)

# Header spellings (lower case, blanks and underscores as hyphens) -> W3C names.
# Beside these, every W3C name is recognised in any case.
HEADER_SPELLINGS = {
    "method": "cs-method",
    "client-ip": "c-ip",
    "clientip": "c-ip",
    "cs-user-agent": "cs(User-Agent)",
    "user-agent": "cs(User-Agent)",
    "useragent": "cs(User-Agent)",
    "cs-referer": "cs(Referer)",
    "referer": "cs(Referer)",
    "referrer": "cs(Referer)",
}
OTHER_W3C_NAMES = ("s-computername", "s-port", "cs-version")
# Ranges of joined lines are looked up by blocks of this many lines, whose marks are words of so many bits.
LINE_BLOCK, WORD = 4096, 64
# Load only: tables of ranges grow with the records over several lines and are sent to every task up to so many bytes of text; beyond
# that the lines inside ranges are sorted to them. Marks take about 1.5 KB of text a block of lines; beyond their bound all lines of
# files with such records are sorted to them.
RANGE_BYTES, MARK_BYTES = 16 << 20, 64 << 20

_CELL = r',("[^"]*+(?:""[^"]*+)*+"[^,]*|"[^"]*+(?:""[^"]*+)*+\z|[^,]*)'
_BLANK_LINE = r'^(\s*|"\s*")(,(\s*|"\s*"))*\z'


def header_names() -> dict[str, str]:
    """All recognised header spellings."""
    plain = {name.lower(): name for name in (*W3C_COLUMNS, *OTHER_W3C_NAMES)}
    return {**plain, **HEADER_SPELLINGS}


def canonical_name(name: Column) -> Column:
    """W3C name of a header cell; names that are not recognised stay as they are."""
    stripped = F.regexp_replace(F.regexp_replace(name, r"^\s+|\s+\z", ""), "^﻿+", "")
    key = F.regexp_replace(F.lower(stripped), "[_ ]", "-")
    names = header_names()
    known = F.map_from_arrays(text_array(names), text_array(names.values()))
    return F.coalesce(F.try_element_at(known, key), stripped)


def _raw_cells(record: Column) -> Column:
    return F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(_CELL), F.lit(1))


def _unquoted(cell: Column) -> Column:
    closed = F.regexp_extract(cell, r'(?s)^"([^"]*+(?:""[^"]*+)*+)"', 1)
    after = F.regexp_extract(cell, r'(?s)^"[^"]*+(?:""[^"]*+)*+"(.*)\z', 1)
    inner = F.when(cell.rlike(r'^"[^"]*+(?:""[^"]*+)*+"'),
                   F.concat(F.replace(closed, F.lit('""'), F.lit('"')), after)) \
        .otherwise(F.replace(F.substring(cell, 2, 1 << 30), F.lit('""'), F.lit('"')))
    return F.when(cell.startswith('"'), inner).otherwise(cell)


def cells_of(record: Column) -> Column:
    """Cells of one CSV record, quotes resolved; records without a quote are only split."""
    return F.when(record.contains('"'), F.transform(_raw_cells(record), _unquoted)).otherwise(F.split(record, ",", -1))


def cell_count(record: Column) -> Column:
    return F.when(record.contains('"'), F.size(_raw_cells(record))).otherwise(F.size(F.split(record, ",", -1)))


def left_open(record: Column) -> Column:
    """Whether a record, read from its start, ends inside a quoted cell."""
    last = F.element_at(_raw_cells(record), -1)
    # doubled quotes are text; any other quote after the first closes the cell
    closes = F.replace(F.substring(last, 2, 1 << 30), F.lit('""'), F.lit("")).contains('"')
    return record.contains('"') & last.startswith('"') & ~closes


def _turning_lines(lines: DataFrame) -> DataFrame:
    """Lines at which a quoted cell stays open or is closed at last, numbered through the file (`turn`).

    A line maps the state before it to the state after it: it keeps or flips it, or sets it. The state before a line
    is what the last setting line set, flipped as often as lines since then flip; first within the split, then over splits.
    """
    value = F.col("value")
    in_split = Window.partitionBy("file_path", "split_start").orderBy("line_number")
    so_far = in_split.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    effects = (lines.where(value.contains('"'))
               .select("file_path", "split_start", "line_number", "file_lines",
                       left_open(value).cast("int").alias("from_out"), left_open(F.concat(F.lit('"'), value)).cast("int").alias("from_in"))
               .withColumn("sets", F.when(F.col("from_out") == F.col("from_in"), F.col("from_out")))
               .withColumn("flips", ((F.col("from_out") == 1) & (F.col("from_in") == 0)).cast("int")))
    effects = settle(effects.withColumn("flipped", F.sum("flips").over(so_far))
                     .withColumn("setting", F.when(F.col("sets").isNotNull(), F.struct("sets", "flipped"))))
    by_split = effects.groupBy("file_path", "split_start").agg(
        F.max_by("setting", F.when(F.col("setting").isNotNull(), F.col("line_number"))).alias("set_at"), F.sum("flips").alias("all_flips"))
    before_split = Window.partitionBy("file_path").orderBy("split_start")
    running = before_split.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier_splits = before_split.rowsBetween(Window.unboundedPreceding, -1)
    starts = (by_split.withColumn("after", F.when(F.col("set_at").isNotNull(), (F.col("set_at.sets") + F.col("all_flips") - F.col("set_at.flipped")) % 2))
              .withColumn("total", F.sum("all_flips").over(running))
              .withColumn("fixed", F.when(F.col("after").isNotNull(), F.struct("after", "total")))
              .withColumn("known", F.last("fixed", ignorenulls=True).over(earlier_splits))
              .select("file_path", "split_start", ((F.coalesce("known.after", F.lit(0)) + F.col("total") - F.col("all_flips") - F.coalesce("known.total", F.lit(0))) % 2).alias("start_state")))
    known = F.last("setting", ignorenulls=True).over(in_split.rowsBetween(Window.unboundedPreceding, -1))
    state = (F.coalesce("known.sets", "start_state") + F.col("flipped") - F.col("flips") - F.coalesce("known.flipped", F.lit(0))) % 2
    turning = settle(effects.join(sized(settle(starts)), ["file_path", "split_start"]).withColumn("known", known).withColumn("state", state)
                     .where(F.col("state") != F.when(F.col("state") == 1, F.col("from_in")).otherwise(F.col("from_out")))
                     .select("file_path", "split_start", "line_number", "file_lines"))
    counts = turning.groupBy("file_path", "split_start").agg(F.count(F.lit(1)).alias("here"))
    offsets = counts.select("file_path", "split_start", F.coalesce(F.sum("here").over(earlier_splits), F.lit(0)).alias("turns_before"))
    return (turning.join(sized(settle(offsets)), ["file_path", "split_start"])
            .withColumn("turn", F.col("turns_before") + F.row_number().over(in_split) - 1))


def _ranges(lines: DataFrame) -> DataFrame:
    """The lines of records whose cells hold line breaks: file_path, first_line, last_line (settled).

    Opening and closing lines are numbered through the splits of a file, so each range is found
    from two rows; a range left open runs to the end of its file.
    """
    return settle(_turning_lines(lines).groupBy("file_path", F.floor(F.col("turn") / 2).alias("pair")).agg(
        F.min("line_number").alias("first_line"), F.count(F.lit(1)).alias("ends"),
        F.max("line_number").alias("last_line"), F.first("file_lines").alias("file_lines"))
        .select("file_path", "first_line", F.when(F.col("ends") == 2, F.col("last_line")).otherwise(F.col("file_lines")).alias("last_line")))


def _marks(spans: DataFrame) -> DataFrame:
    """For each block of lines that ranges touch, a bit for every line: whether it lies in one."""
    start = F.col("block") * LINE_BLOCK
    clipped = spans.select("in_file", "block", F.greatest(F.col("first_line") - start, F.lit(0)).cast("int").alias("low"),
                           F.least(F.col("last_line") - start, F.lit(LINE_BLOCK - 1)).cast("int").alias("high"))
    words = clipped.select("*", F.explode(F.expr(f"sequence(int(low div {WORD}), int(high div {WORD}))")).alias("word")).select(
        "in_file", "block", "word", F.greatest(F.col("low") - F.col("word") * WORD, F.lit(0)).alias("low"),
        F.least(F.col("high") - F.col("word") * WORD, F.lit(WORD - 1)).alias("high"))
    ones = F.expr(f"shiftleft(shiftrightunsigned(-1L, {WORD - 1} - high + low), low)")
    by_word = words.groupBy("in_file", "block", "word").agg(F.bit_or(ones).alias("bits"))
    by_block = by_word.groupBy("in_file", "block").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("given"))
    return by_block.select("in_file", "block", F.transform(
        F.sequence(F.lit(0), F.lit(LINE_BLOCK // WORD - 1)), lambda w: F.coalesce(F.try_element_at("given", w), F.lit(0).cast("bigint"))).alias("marks"))


def _placed(lines: DataFrame, ranges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lines outside all ranges, and those inside with the range they belong to.

    Most lines need only be told that they are outside, which takes a bit for each; the ranges meet the few lines that are inside.
    """
    line = F.col("line_number")
    block, place = F.floor(line / LINE_BLOCK), (line % LINE_BLOCK).cast("int")
    spans = settle(ranges.select(
        F.col("file_path").alias("in_file"), "first_line", "last_line",
        F.explode(F.sequence(F.floor(F.col("first_line") / LINE_BLOCK), F.floor(F.col("last_line") / LINE_BLOCK))).alias("block")))
    here = (F.col("file_path") == F.col("in_file")) & (block == F.col("block"))
    bit = F.getbit(F.get("marks", F.floor(place / WORD).cast("int")), place % WORD)
    told = (lines.join(sized(settle(_marks(spans)), MARK_BYTES), here, "left")
            .withColumn("inside", F.coalesce(bit == 1, F.lit(False))).drop("in_file", "block", "marks"))
    inside = told.where("inside").join(sized(spans, RANGE_BYTES), here & line.between(F.col("first_line"), F.col("last_line")))
    return told.where("not inside").drop("inside"), inside.drop("inside", "in_file", "block")


RANGE = ["file_path", "first_line", "last_line"]


def _pieces(inside: DataFrame) -> DataFrame:
    """The lines inside ranges, kept, each read as a record of its own: its cells, and the first of them."""
    alone = F.when(F.col("line_number") == F.col("first_line"), F.col("value")).otherwise(F.concat(F.lit('"'), "value"))
    cells = F.col("cells")
    return settle(inside.select(*RANGE, "line_number", "value", cells_of(alone).alias("cells"))
                  .select(*RANGE, "line_number", "value", F.size(cells).alias("cells_here"),
                          F.exists(cells, lambda c: ~c.rlike(r"^\s*\z")).alias("has_text"), F.regexp_replace(F.get(cells, F.lit(0)), r"^\s+", "").alias("lead")))


def _range_facts(pieces: DataFrame) -> DataFrame:
    """For each range its number of cells, whether any has text, and how the first one begins: known without joining text."""
    first_cell_told = (F.col("lead") != "") | (F.col("cells_here") > 1)
    return settle(pieces.groupBy(*RANGE).agg(
        (F.sum("cells_here") - F.count(F.lit(1)) + 1).cast("int").alias("given"), F.max("has_text").alias("has_text"),
        F.min_by(F.substring("lead", 1, 1), F.when(first_cell_told, F.col("line_number"))).alias("begins")))


def _whole(pieces: DataFrame, ranges: DataFrame) -> DataFrame:
    """The joined text of some ranges: file_path, first_line, last_line, value."""
    return (pieces.join(sized(settle(ranges.select(*RANGE)), RANGE_BYTES), RANGE).groupBy(*RANGE)
            .agg(F.array_sort(F.collect_list(F.struct("line_number", "value"))).alias("parts"))
            .select(*RANGE, F.array_join("parts.value", "\n").alias("value")))


def _joined_headers(files: DataFrame, outside: DataFrame, pieces: DataFrame, facts: DataFrame) -> DataFrame:
    """file_path, header_line, header_text of files with ranges. ``files`` has the first line of each that looks like a header.

    That line is the header unless it lies in a range: then the range is the header, or, if that is a comment or blank, the first
    record behind it that is neither.
    """
    inside = files.join(facts, "file_path").where(F.col("header_line").between(F.col("first_line"), F.col("last_line")))
    named = F.col("has_text") & (F.coalesce("begins", F.lit("")) != "#")
    inside = settle(inside.select(*RANGE, "header_line", named.alias("named"), (F.col("header_line") == F.col("first_line")).alias("starts")))
    plain = files.join(sized(inside.select("file_path")), "file_path", "left_anti")
    spanning = inside.where("named and starts")
    unknown = inside.where("not (named and starts)").select("file_path", F.col("last_line").alias("after"))
    if not unknown.isEmpty():
        behind = outside.join(sized(unknown), "file_path").where((F.col("line_number") > F.col("after")) & _heads(F.col("value")))
        single = behind.groupBy("file_path").agg(F.min(F.struct("line_number", "value")).alias("line")).select(
            "file_path", F.col("line.line_number").alias("starts_at"), F.col("line.line_number").alias("header_line"), F.col("line.value").alias("header_text"))
        wider = facts.where(named).join(sized(unknown), "file_path").where(F.col("first_line") > F.col("after")).groupBy("file_path").agg(
            F.min(F.struct("first_line", "last_line")).alias("range")).select("file_path", "range.*")
        wider = _whole(pieces, wider).select("file_path", F.col("first_line").alias("starts_at"), F.col("last_line").alias("header_line"), F.col("value").alias("header_text"))
        found = single.unionByName(wider).groupBy("file_path").agg(F.min(F.struct("starts_at", "header_line", "header_text")).alias("header"))
        plain = plain.unionByName(found.select("file_path", "header.header_line", "header.header_text"))
    return settle(plain.unionByName(_whole(pieces, spanning).select("file_path", F.col("last_line").alias("header_line"), F.col("value").alias("header_text"))))


def _heads(value: Column) -> Column:
    """Whether a record can be a header: neither blank nor a comment."""
    return ~value.rlike(_BLANK_LINE) & ~value.rlike(r'^(\s*|"\s*|"\s*"\s*)#')


def _empty_files(spark: SparkSession, source: FileRange) -> DataFrame:
    """Rejects for files of no bytes, which are known to a source but are not part of its scan."""
    known = spark.createDataFrame(pa.table({"file_path": pa.array(source.load(spark, "text").inputFiles(), pa.string())}))
    log_file = path_text(F.col("file_path")).alias("log_file")
    return (known.select(log_file).join(listed_files(spark, source).select(log_file), "log_file", "left_anti")
            .select("log_file", F.lit(0).cast("bigint").alias("line_number"), F.lit("file without a header record").alias("reason")))


def read_csv(spark: SparkSession, paths: Sequence[str], name_glob: str | None = None) -> LogSource:
    """Rows of CSV exports, see `_read_range`."""
    ranges = file_ranges(spark, paths, name_glob)
    source = reduce(LogSource.union, [_read_range(spark, files) for files in ranges])
    return LogSource(source.lines, source.notices.unionByName(_empty_files(spark, replace(ranges[0], first=None, last=None))))


def _read_range(spark: SparkSession, source: FileRange) -> LogSource:
    """Rows of CSV exports.

    The first record that is neither blank nor a comment names the columns, on one line or several. Skipped with a reason:
    records with another number of cells, files without header. Repeated header names are reported
    and their last column counts. Empty cells become ``-``.
    """
    lines = text_lines(spark, source)
    value = F.col("value")
    splits = split_table(
        lines,
        header=F.min_by(F.struct("id", "value"), F.when(_heads(value), F.col("id"))),
        opens=F.count(F.when(left_open(value), 1)),
        # Keeps the aggregation hash-based although the header is text.
        sample=F.collect_list(F.lit(None).cast("int"))).drop("sample")
    splits = splits.withColumn("header", F.when(F.col("header").isNotNull(), F.struct(line_at(F.col("header.id")).alias("at"), "header.value")))
    files = settle(splits.groupBy("file_path").agg(
        F.min("header").alias("header"), (F.sum("opens") > 0).alias("joins"), F.sum("lines").alias("file_lines"))
        .select("file_path", "joins", "file_lines", F.col("header.at").alias("header_line"), F.col("header.value").alias("header_text")))
    numbered_lines = numbered(lines, settle(splits.drop("header", "opens").join(files.select("file_path", "joins", "file_lines"), "file_path")))
    outside = pieces = facts = None
    if not files.where("joins").isEmpty():
        outside, inside = _placed(numbered_lines.where("joins"), _ranges(numbered_lines.where("joins")))
        pieces = _pieces(inside)
        facts = _range_facts(pieces)
        headers = _joined_headers(files.where("joins").select("file_path", "header_line", "header_text"), outside, pieces, facts)
        files = files.where("not joins").unionByName(
            files.where("joins").drop("header_line", "header_text").join(headers, "file_path", "left"))
    files = settle(files.withColumn("all_names", F.transform(cells_of(F.col("header_text")), canonical_name))
                   .withColumn("names", F.array_distinct("all_names"))
                   .withColumn("positions", F.transform("names", lambda n: F.size("all_names") - F.array_position(F.reverse("all_names"), n).cast("int")))
                   .select("file_path", "header_line", "all_names", "names", "positions"))
    records = numbered_lines.where("not joins").select("file_path", "line_number", "value", cell_count(value).alias("given"))
    if facts is not None:
        alone = outside.select("file_path", "line_number", "value", cell_count(value).alias("given"))
        fits = F.col("given") == F.size("all_names")
        judged = settle(facts.join(files.select("file_path", "all_names"), "file_path").select(*RANGE, "given", "has_text", F.coalesce(fits, F.lit(False)).alias("fits")))
        whole = _whole(pieces, judged.where("fits")).join(sized(judged.select(*RANGE, "given"), RANGE_BYTES), RANGE)
        refused = judged.where("has_text and not fits").withColumn("value", F.lit(None).cast("string"))
        for joined in (whole, refused):
            alone = alone.unionByName(joined.select("file_path", F.col("last_line").alias("line_number"), "value", "given"))
        records = records.unionByName(alone)
    records = records.join(F.broadcast(files), "file_path")  # bounded by SPLITS_PER_RANGE

    width, given = F.size("all_names"), F.col("given")
    parsed = (records.where(F.col("header_line").isNotNull() & (F.col("line_number") > F.col("header_line")))
              .where(F.coalesce(~F.col("value").rlike(_BLANK_LINE), F.lit(True)))
              .withColumn("reason", F.when(given != width, F.concat(given, F.lit(" cells under "), width, F.lit(" column names")))))
    filled = F.transform("cells", lambda c: F.when(c.rlike(r"^\s*\z"), F.lit("-")).otherwise(c))
    picked = F.when(F.size("names") == width, filled).otherwise(F.transform("positions", lambda p: F.get(filled, p)))
    log_file = path_text(F.col("file_path")).alias("log_file")
    taken = F.col("reason").isNull()
    lines = parsed.withColumn("cells", F.when(taken, cells_of(F.col("value")))).select(
        log_file, "line_number", F.array_join("cells", ",").alias("raw_line"),
        F.when(taken, F.map_from_arrays("names", picked)).alias("fields"), "reason")
    notices = (files.where(F.size("names") < F.size("all_names")).select(
                   log_file, F.col("header_line").alias("line_number"),
                   F.lit("header repeats a column name").alias("reason"))
               .unionByName(files.where(F.col("header_line").isNull()).select(
                   log_file, F.lit(0).cast("bigint").alias("line_number"),
                   F.lit("file without a header record").alias("reason")))
               .unionByName(unreadable(listed_files(spark, source), splits)))
    return LogSource(lines, notices)
