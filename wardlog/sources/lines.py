"""Text files as numbered lines, without sending a file through one task.

Spark cuts large files into splits. A first pass summarises every split (how many lines, where its
ids start, what a source wants to know); running sums over the splits of a file give the number of
its first line. The second pass only looks its split up. Both passes plan the same scan, so ids
agree; a line that finds no fitting split fails the job instead of getting a wrong number.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardlog.lineage import settle

SPLIT = ["file_path", "split_start"]
SPLITS_PER_RANGE = 200_000  # a few hundred bytes each
LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
ROW_COLUMNS = "log_file string, line_number bigint, raw_line string, fields map<string,string>"
LINE_COLUMNS = f"{ROW_COLUMNS}, reason string"
REJECT_COLUMNS = "log_file string, line_number bigint, reason string"


class SourceError(Exception):
    """Input that the strict mode refuses before it reads a line."""


@dataclass(frozen=True)
class LogSource:
    """What the files hold, in one frame: rows, and the lines that are skipped, which have a reason
    instead of text and fields. Both come out of the same pass over the text. ``notices`` are rejects known without
    that pass: files without a header, repeated names, missing files."""

    lines: DataFrame
    notices: DataFrame

    @property
    def rows(self) -> DataFrame:
        """Raw rows: ``log_file, line_number, raw_line, fields``."""
        return self.lines.where(F.col("reason").isNull()).drop("reason")

    @property
    def rejects(self) -> DataFrame:
        """What was skipped: ``log_file, line_number, reason``."""
        return self.lines.where(F.col("reason").isNotNull()).select(*self.notices.columns).unionByName(self.notices)

    def strict(self) -> "LogSource":
        """The same, but nothing may be skipped: a notice raises at once, a skipped line fails the job that meets it."""
        first = self.notices.orderBy("log_file", "line_number").first()
        if first is not None:
            raise SourceError(f"{first.log_file}:{first.line_number}: {first.reason}")
        place = F.concat_ws(":", "log_file", F.col("line_number").cast("string"))
        refused = F.raise_error(F.concat_ws(": ", place, "reason")).cast("boolean")
        return LogSource(self.lines.where(F.when(F.col("reason").isNull(), True).otherwise(refused)), self.notices)

    def union(self, other: "LogSource") -> "LogSource":
        return LogSource(self.lines.unionByName(other.lines), self.notices.unionByName(other.notices))


def from_files(spark: SparkSession, file_format: str, paths: Sequence[str], name_glob: str | None) -> DataFrame:
    """A file source over files, or over folders searched recursively for names like ``name_glob``. A file that fails while it
    is read ends there; `unreadable` tells which."""
    # Spark lists many paths in a job with a task for each, and the driver keeps a record of every task.
    if spark.conf.get(LISTING_TASKS, None) is None:
        spark.conf.set(LISTING_TASKS, str(4 * spark.sparkContext.defaultParallelism))
    reader = spark.read.format(file_format).option("ignoreCorruptFiles", "true")
    if name_glob:
        reader = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", name_glob)
    return reader.load(list(paths))


@dataclass(frozen=True)
class FileRange:
    """Files of an input, or those of them whose path lies between two others. An input is listed once for each format: the
    driver holds every list of files it has made, some KB a file."""

    paths: tuple[str, ...]
    name_glob: str | None = None
    first: str | None = None
    last: str | None = None
    sources: dict[str, DataFrame] = field(default_factory=dict, compare=False, repr=False)

    def load(self, spark: SparkSession, file_format: str) -> DataFrame:
        """The files as a source; Spark leaves the others out when it plans the scan."""
        if file_format not in self.sources:
            self.sources[file_format] = from_files(spark, file_format, self.paths, self.name_glob)
        frame = self.sources[file_format]
        return frame if self.first is None else frame.where(F.col("_metadata.file_path").between(self.first, self.last))


def file_ranges(spark: SparkSession, paths: Sequence[str], name_glob: str | None) -> list[FileRange]:
    """The input in ranges of files with about SPLITS_PER_RANGE splits at most (a very large file may have more).

    Whatever is looked up for a line, by split or by file, is then a table that fits every task, so text is never shuffled to
    meet it. Ranges are cut inside Spark; only their ends come to the driver.
    """
    whole = FileRange(tuple(paths), name_glob)
    length = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    listed = listed_files(spark, whole).select("file_path", F.ceil(F.greatest(F.col("file_size"), F.lit(1)) / length).alias("splits"))
    total = listed.agg(F.sum("splits")).first()[0] or 0
    if total <= SPLITS_PER_RANGE:
        return [whole]
    ends = (listed.repartitionByRange(-(-2 * total // SPLITS_PER_RANGE), "file_path").groupBy(F.spark_partition_id())
            .agg(F.min("file_path").alias("first"), F.max("file_path").alias("last")).orderBy("first"))
    return [replace(whole, first=r["first"], last=r["last"]) for r in ends.collect()]


def text_lines(spark: SparkSession, files: FileRange) -> DataFrame:
    """Lines with their file, split, an id that grows within a split, and their bytes. Bad UTF-8 is replaced."""
    # Both passes must cut the files alike, whatever executors join in between.
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    return files.load(spark, "text").select(
        F.make_valid_utf8("value").alias("value"),
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("split_start"),
        F.monotonically_increasing_id().alias("id"),
        F.octet_length("value").alias("bytes"))


def listed_files(spark: SparkSession, files: FileRange) -> DataFrame:
    """file_path and file_size of all files of a source; nothing is read from them, and the list stays in Spark."""
    return files.load(spark, "binaryFile").select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_size").alias("file_size"))


def unreadable(listed: DataFrame, splits: DataFrame) -> DataFrame:
    """Rejects for files of which fewer bytes were read than they have: more than ends of lines and a mark at the start explain."""
    read = splits.groupBy("file_path").agg(F.sum(F.col("bytes_read") + 2 * F.col("lines")).alias("bytes_read"))
    short = F.col("file_size") > F.coalesce("bytes_read", F.lit(0)) + 3
    return listed.join(read, "file_path", "left").where(short).select(
        path_text(F.col("file_path")).alias("log_file"), F.lit(0).cast("bigint").alias("line_number"), F.lit("cannot be read to its end").alias("reason"))


def path_text(file_path: Column) -> Column:
    """A file URI as a readable path: percent escapes resolved, local scheme dropped."""
    plain = F.try_url_decode(F.replace(file_path, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(F.coalesce(plain, file_path), r"^file:(//)?(?=/)", "")


def split_order() -> Window:
    return Window.partitionBy("file_path").orderBy("split_start")


def earlier(column: str) -> Column:
    """Sum of a per-split number over the file's earlier splits."""
    return F.coalesce(F.sum(column).over(split_order().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def split_table(lines: DataFrame, **facts: Column) -> DataFrame:
    """One row per split: first id, number of lines, lines before it in the file, and the facts."""
    per_split = lines.groupBy(*SPLIT).agg(
        F.min("id").alias("first_id"), F.count(F.lit(1)).alias("lines"), F.sum("bytes").alias("bytes_read"),
        *[fact.alias(name) for name, fact in facts.items()])
    return settle(per_split.withColumn("lines_before", earlier("lines")))


def line_at(identifier: Column) -> Column:
    """Line number of an id, on a frame that has the split's columns."""
    return identifier - F.col("first_id") + F.col("lines_before") + 1


def numbered(lines: DataFrame, splits: DataFrame) -> DataFrame:
    """Lines with ``line_number`` and the columns of their split."""
    known = F.col("first_id").isNotNull() & F.col("id").between(F.col("first_id"), F.col("first_id") + F.col("lines") - 1)
    moved = F.raise_error(F.concat(F.lit("input changed between passes: "), F.col("file_path"))).cast("bigint")
    return (lines.join(F.broadcast(splits), SPLIT, "left")  # bounded by SPLITS_PER_RANGE
            .withColumn("line_number", F.when(known, line_at(F.col("id"))).otherwise(moved)))
