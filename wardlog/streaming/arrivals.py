"""Raw log files that arrive in a folder, parsed once each.

A file source lists what arrived (names only, contents are not read by it); every micro-batch hands its files, at most
`files_per_batch`, to the batch readers, so a large file is still split over many tasks, header changes and rejects included. Every
batch costs some jobs, however little it holds, so files that are there at the start come in at most BACKLOG_BATCHES batches. A
batch writes to folders of its own number. After a failure the engine repeats the last batch with the same files: folders that
are complete are left as they are, others are written anew, so no row comes twice and streams over the records see each file once.

Files must be complete when they get their name (written elsewhere and moved in): what is appended later is not seen.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from wardlog.operators.normalize import normalize
from wardlog.sources.inputs import read_logs
from wardlog.sources.lines import ROW_COLUMNS, FileRange, listed_files

FILE_COLUMNS = "path string, modificationTime timestamp, length bigint, content binary"
RECORDS, REJECTS = "records", "rejects"
#: Load only: batches that the files of a folder come in when the stream starts, if `files_per_batch` would give more.
BACKLOG_BATCHES = 4


def arriving_files(spark: SparkSession, folder: str, name_glob: str = "*.{log,csv}", files_per_batch: int = 1000) -> DataFrame:
    """Stream of path and length of the files that arrive below a folder."""
    return (spark.readStream.format("binaryFile").schema(FILE_COLUMNS)
            .options(pathGlobFilter=name_glob, recursiveFileLookup=True, maxFilesPerTrigger=files_per_batch)
            .load(folder).select("path", "length"))


def _complete(spark: SparkSession, folder: str) -> bool:
    """Whether a write to the folder was committed."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def _parse_into(target: str, zone: str) -> Callable[[DataFrame, int], None]:
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        missing = [kind for kind in (RECORDS, REJECTS) if not _complete(spark, f"{target}/{kind}/batch={batch_id}")]
        if not missing:
            return
        paths = [r["path"] for r in batch.select("path").collect()]
        if paths:
            source = read_logs(spark, paths)
            frames = {RECORDS: normalize(source.rows, zone), REJECTS: source.rejects}
            for kind in missing:
                frames[kind].write.mode("overwrite").parquet(f"{target}/{kind}/batch={batch_id}")

    return run


def ingest_logs(spark: SparkSession, folder: str, target: str, name_glob: str = "*.{log,csv}", zone: str = "UTC",
                files_per_batch: int = 1000) -> DataStreamWriter:
    """Writer of a stream that parses every arriving file to `target`/records and `target`/rejects; the caller chooses the
    trigger and starts it. Its progress is kept below `target` as well, so starting it again goes on where it stopped."""
    there = listed_files(spark, FileRange((folder,), name_glob)).count()
    files = arriving_files(spark, folder, name_glob, max(files_per_batch, -(-there // BACKLOG_BATCHES)))
    return files.writeStream.option("checkpointLocation", f"{target}/progress").foreachBatch(_parse_into(target, zone))


def record_schema(spark: SparkSession, zone: str = "UTC") -> StructType:
    """Columns of normalised records of log files."""
    return normalize(spark.createDataFrame([], ROW_COLUMNS), zone).schema


def ingested(spark: SparkSession, target: str, kind: str = RECORDS) -> DataFrame:
    """What has been parsed up to now, `batch` (the number of the micro-batch) included."""
    return spark.read.option("basePath", f"{target}/{kind}").parquet(f"{target}/{kind}/batch=*")


def record_stream(spark: SparkSession, target: str) -> DataFrame:
    """The parsed records as a stream, for `scan`, `windowed_stream` and running counts."""
    return spark.readStream.schema(record_schema(spark)).parquet(f"{target}/{RECORDS}/batch=*")
