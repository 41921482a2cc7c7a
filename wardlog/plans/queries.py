"""The registered queries: every operator over all events of a table folder.

Results are scalars only (lists joined with ``;``, times as text) so that they compare by value.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wardlog.functions.clock import iso_text
from wardlog.lineage import checkpoint_dir
from wardlog.operators.normalize import normalize
from wardlog.operators.predicates import matching
from wardlog.operators.rules import Rule, load_rules, rule_catalog, rule_from
from wardlog.operators.scan import scan
from wardlog.operators.summary import (REPORT_TOP_LIMIT, REVIEW_ROWS, detail_rows, event_count, findings_by_severity,
                                       grouped_review, highest_severity, line_statistics, numbered_detail, numbered_timeline,
                                       rule_hits, timeline, top_counts, top_values)
from wardlog.operators.windows import detect_keyed
from wardlog.plans.access_tables import access_records, burst_records, event_stream, request_fields
from wardlog.plans.hunt import hunt, report_tables
from wardlog.schema import FINDING_LIST_COLUMNS, REVIEW_GROUPS, TOP_FIELDS
from wardlog.sinks.writers import (finding_rows, flat_findings, timeline_rows, write_findings_csv, write_findings_json, write_parquet,
                                   write_timeline_csv)
from wardlog.sources.csv_export import read_csv
from wardlog.sources.inputs import read_logs
from wardlog.sources.lines import LogSource
from wardlog.sources.w3c import read_w3c
from wardlog.streaming.arrivals import REJECTS, ingest_logs, ingested, record_stream
from wardlog.streaming.live import running_counts, running_rule_hits, running_severities, running_top, windowed_stream

Query = Callable[[SparkSession, str], DataFrame]

PACK, _ = load_rules()
ZONE = "+03:30"
LINES_PER_FILE = 4000  # events per written log file
FILES_PER_BATCH = 8  # arriving files in a micro-batch
PARQUET_FROM = "2024-01-10"
W3C_ORDERS = (
    ("date", "time", "c-ip", "cs-method", "cs-uri-stem", "cs-uri-query", "sc-status", "cs(User-Agent)"),
    ("date", "time", "cs-method", "sc-status", "cs-uri-stem", "cs-uri-query", "c-ip", "time-taken", "cs-host"),
)
CSV_HEADER = "Date,Time,client_ip,Method,cs_uri_stem,CS URI Query,SC_Status,User-Agent,x-note"
SPREAD_HEADER = '#export,"of\n2 lines"\n' + CSV_HEADER.replace("x-note", '"x\nnote"')
CSV_FIELDS = ("date", "time", "c-ip", "cs-method", "cs-uri-stem", "cs-uri-query", "sc-status", "cs(User-Agent)")


def _line_rule(rule_id: str, condition: str = "selection", **selections: dict) -> Rule:
    return rule_from({"id": rule_id, "title": rule_id, "level": "low",
                      "detection": {**selections, "condition": condition}})


def _keyed_rule(rule_id: str, level: str = "medium", **aggregation) -> Rule:
    return rule_from({"id": rule_id, "title": rule_id, "level": level, "type": "aggregation",
                      "aggregation": aggregation})


# One rule per predicate and condition form.
PREDICATES = {
    "pred_equals": _line_rule("pred_equals", selection={"method": "post"}),
    "pred_equals_list": _line_rule("pred_equals_list", selection={"status": [401, "404"]}),
    "pred_contains": _line_rule("pred_contains", selection={"uri_path_decoded|contains": "UPLOAD"}),
    "pred_contains_any": _line_rule("pred_contains_any", selection={
        "uri_query_decoded|contains_any": ["utm_", "cmd=", "' OR 1=1", "zz&b"]}),
    "pred_startswith": _line_rule("pred_startswith", selection={"uri_path|startswith": "/EN/"}),
    "pred_startswith_any": _line_rule("pred_startswith_any", selection={"uri_path|startswith_any": ["/fr", "/ES/", "/wp-"]}),
    "pred_endswith": _line_rule("pred_endswith", selection={"uri_path|endswith": ".ASPX"}),
    "pred_endswith_any": _line_rule("pred_endswith_any", selection={"uri_path|endswith_any": [".html", ".php", "/"]}),
    "pred_regex": _line_rule("pred_regex", selection={"uri_path_decoded|re": [r"/[0-9]{3}\.HTML$", r"^/(fr|es)/\d+1/?$"]}),
    "pred_in": _line_rule("pred_in", selection={"extension|in": [".ASPX", ".html"]}),
    "pred_exists": _line_rule("pred_exists", selection={"uri_query|exists": True}),
    "pred_not_exists": _line_rule("pred_not_exists", selection={"referer|not_exists": True}),
    "pred_numeric": _line_rule("pred_numeric", selection={"status": {"gte": 400, "lt": 404}, "time_taken": {"gt": 50, "lte": 900.5}}),
    "pred_numeric_raw_field": _line_rule("pred_numeric_raw_field", selection={"s-port": {"gte": 443}, "status": {"gte": 500}}),
    "cond_selection": _line_rule("cond_selection", selection={"method": "GET", "status": 404}),
    "cond_and": _line_rule("cond_and", "a and b", a={"method": "POST"}, b={"extension|in": [".aspx"]}),
    "cond_or": _line_rule("cond_or", "a or b", a={"status": 500}, b={"uri_path|contains": "login"}),
    "cond_and_not": _line_rule("cond_and_not", "a and not b", a={"uri_query|exists": True}, b={"user_agent|contains_any": ["curl", "sqlmap"]}),
}

FAILED = {"status": {"gte": 400}}
KEYED = {
    "threshold": _keyed_rule("threshold", group_by=["src_ip"], filter=FAILED, count_gte=3, window_minutes=4320),
    "threshold_short_window": _keyed_rule("threshold_short_window", group_by=["user_agent"], count_gte=4, window_minutes=32.5),
    "threshold_path": _keyed_rule("threshold_path", "low", group_by=["uri_path"], count_gte=2, window_minutes=1440),
    "threshold_composite_key": _keyed_rule("threshold_composite_key", group_by=["src_ip", "method"],
                                           filter={"method": "POST"}, count_gte=2, window_minutes=2880),
    "sequence": _keyed_rule("sequence", "high", group_by=["src_ip"], filter=FAILED,
                            followed_by={"status": {"gte": 200, "lt": 300}}, count_gte=2, window_minutes=7200),
    "rarity": _keyed_rule("rarity", group_by=["src_ip", "uri_path"], filter={"status": {"gte": 200, "lt": 300}},
                          count_lte=1, window_minutes=1440),
}


def _joined(column: str) -> Column:
    return F.concat_ws(";", column).alias(column)


def _folder(spark: SparkSession, purpose: str) -> str:
    return f"{checkpoint_dir(spark)}/{purpose}-{uuid.uuid4().hex}"


# --- normalisation ---------------------------------------------------------------------------

def normalize_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = access_records(spark, sf_dir)
    return r.select("line_number", iso_text(F.col("timestamp")).alias("timestamp"), "date", "time", "site_name",
                    "method", "uri_path", "uri_query", "src_ip", "username", "user_agent", "referer", "status",
                    "substatus", "time_taken", "host", F.try_element_at("extra", F.lit("s-port")).alias("s_port"))


def url_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access_records(spark, sf_dir).select("line_number", "url_original", "uri_path_decoded",
                                                "uri_query_decoded", "url_decoded")


def url_parts_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access_records(spark, sf_dir).select("line_number", "host", "uri_path", "uri_query", "url_original", "extension")


def status_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access_records(spark, sf_dir).groupBy("status", "is_success_status", "is_error_status").agg(
        F.count(F.lit(1)).alias("n"))


def timestamp_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access_records(spark, sf_dir, ZONE).select("line_number", iso_text(F.col("timestamp")).alias("timestamp"))


# --- sources ---------------------------------------------------------------------------------

def write_w3c_logs(spark: SparkSession, sf_dir: str, header_faults: bool = False) -> str:
    """All events as W3C files: a header per file, another layout from the middle on, bad rows.

    With `header_faults` every third file has no header, and every third one an empty header in the middle.
    """
    fields = request_fields(spark, sf_dir)
    event = F.col("event_id")
    place = event % LINES_PER_FILE
    half = (place >= LINES_PER_FILE // 2)
    row = F.when(half, F.concat_ws(" ", *[f"`{c}`" for c in W3C_ORDERS[1]])) \
        .otherwise(F.concat_ws(" ", *[f"`{c}`" for c in W3C_ORDERS[0]]))
    row = F.when(event % 101 == 5, F.concat(row, F.lit(" extra"))).otherwise(row)
    first, second = (F.lit("#Fields: " + " ".join(order)) for order in W3C_ORDERS)
    if header_faults:
        kind = F.floor(event / LINES_PER_FILE) % 3
        first, second = F.when(kind == 1, "#Remark: none").otherwise(first), F.when(kind == 2, "#Fields: ").otherwise(second)
    head = F.array(F.lit("#Software: test"), first, row)
    again = F.array(F.lit(""), second, row)
    lines = (fields.select(F.floor(event / LINES_PER_FILE).alias("file_no"), event.alias("event_id"),
                           F.posexplode(F.when(place == 0, head).when(place == LINES_PER_FILE // 2, again)
                                        .otherwise(F.array(row))).alias("part", "value")))
    folder = _folder(spark, "w3c")
    (lines.repartitionByRange("file_no").sortWithinPartitions("file_no", "event_id", "part")
     .select("file_no", "value").write.partitionBy("file_no").text(folder))
    return folder


def write_csv_exports(spark: SparkSession, sf_dir: str, header: str | None = None) -> str:
    """All events as CSV exports: other header names, quotes, line breaks in cells, bad rows."""
    fields = request_fields(spark, sf_dir)
    event = F.col("event_id")
    cells = [F.when(F.col(f"`{c}`") == "-", "").otherwise(F.col(f"`{c}`")) for c in CSV_FIELDS]
    note = F.when(event % 40 == 3, F.lit('"two\nlines, ""quoted"""')).when(event % 7 == 0, F.lit('"a,b"')).otherwise("")
    quoted_query = F.concat(F.lit('"'), cells[5], F.lit('"'))
    row = F.concat_ws(",", *cells[:5], quoted_query, *cells[6:], note)
    row = F.when(event % 101 == 5, F.concat(row, F.lit(",more"))).otherwise(row)
    value = F.when(event % LINES_PER_FILE == 0, F.concat(F.lit((header or "#export\n" + CSV_HEADER) + "\n"), row)).otherwise(row)
    folder = _folder(spark, "csv")
    (fields.select(F.floor(event / LINES_PER_FILE).alias("file_no"), "event_id", value.alias("value"))
     .repartitionByRange("file_no").sortWithinPartitions("file_no", "event_id")
     .select("file_no", "value").write.partitionBy("file_no").text(folder))
    return folder


def _file_no() -> Column:
    return F.regexp_extract("log_file", r"file_no=(\d+)", 1).cast("bigint").alias("file_no")


def _parsed(records: DataFrame) -> DataFrame:
    return records.select(_file_no(), "line_number", iso_text(F.col("timestamp")).alias("timestamp"), "src_ip", "method",
                    "uri_path", "uri_query", "status", "user_agent", "time_taken", "host")


def _w3c_source(spark: SparkSession, sf_dir: str) -> LogSource:
    return read_w3c(spark, [write_w3c_logs(spark, sf_dir)], "*.txt")


def _csv_source(spark: SparkSession, sf_dir: str) -> LogSource:
    return read_csv(spark, [write_csv_exports(spark, sf_dir)], "*.txt")


def w3c_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(normalize(_w3c_source(spark, sf_dir).rows))


def w3c_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _w3c_source(spark, sf_dir).rejects.select(_file_no(), "line_number", "reason")


def w3c_header_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejects of files without header and of files with an empty one."""
    source = read_w3c(spark, [write_w3c_logs(spark, sf_dir, header_faults=True)], "*.txt")
    return source.rejects.select(_file_no(), "line_number", "reason")


def csv_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = _csv_source(spark, sf_dir)
    r = normalize(source.rows)
    return r.select(_file_no(), "line_number", "src_ip", "method", "uri_path", "uri_query", "status", "user_agent",
                    F.try_element_at("extra", F.lit("x-note")).alias("note"))


def csv_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _csv_source(spark, sf_dir).rejects.select(_file_no(), "line_number", "reason")


def _named(spark: SparkSession, folder: str, extension: str) -> str:
    """Give the text files of a folder another extension; the glob that matches them."""
    system = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for status in system.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/*/*.txt")):
        system.rename(status.getPath(), status.getPath().suffix(extension))
    return f"{folder}/*/*{extension}"


def _broken_log(spark: SparkSession, folder: str) -> str:
    """A log whose checksum is wrong, so that reading it fails (on file systems that keep checksums beside files)."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}-broken/u.log")
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    for path, text in ((at, "#Fields: date time\n2025-01-01 00:00:00\n"), (system.getChecksumFile(at), "crc\0 not the sum of anything")):
        out = (system if path is at else system.getRaw()).create(path, True)
        out.write(bytearray(text.encode()))
        out.close()
    return at.toString()


def read_logs_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log files, CSV exports, a file that cannot be read and one that is missing, in one input: lines taken and skipped by kind."""
    logs, exports = write_w3c_logs(spark, sf_dir), write_csv_exports(spark, sf_dir)
    source = read_logs(spark, [_named(spark, logs, ".log"), _named(spark, exports, ".csv"), _broken_log(spark, logs), f"{logs}/gone.log"])
    kind = F.when(F.col("reason").isNull(), F.concat(F.element_at(F.split("log_file", r"\."), -1), F.lit(" row"))).otherwise(F.col("reason"))
    seen = source.lines.select("log_file", "reason").unionByName(source.notices.select("log_file", "reason"))
    return seen.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def csv_multiline_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV exports whose header record, and a comment before it, run over several lines."""
    source = read_csv(spark, [write_csv_exports(spark, sf_dir, SPREAD_HEADER)], "*.txt")
    fields = F.col("fields")
    return source.rows.select(_file_no(), "line_number", F.element_at(fields, F.lit("c-ip")).alias("src_ip"), F.element_at(fields, F.lit("x\nnote")).alias("note"))


# --- predicates and scan -----------------------------------------------------------------------

def _matching(rule: Rule) -> Query:
    return lambda spark, sf_dir: matching(access_records(spark, sf_dir), rule).select("line_number", "src_ip")


def scan_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(access_records(spark, sf_dir), PACK).select("rule_id", "line_number")


def scan_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(access_records(spark, sf_dir), PACK).select(
        "rule_id", "line_number", _joined("matched_fields"), _joined("matched_values"))


def findings_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_findings(scan(access_records(spark, sf_dir), PACK), include_raw=True)


def findings_json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "findings")
    findings = scan(access_records(spark, sf_dir), PACK)
    write_findings_json(findings, folder)
    shape = finding_rows(findings).schema
    return spark.read.schema(shape).json(folder).withColumns({c: F.concat_ws(";", c) for c in FINDING_LIST_COLUMNS})


def findings_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "findings-csv")
    findings = scan(access_records(spark, sf_dir), PACK)
    write_findings_csv(findings, folder, include_raw=True)
    return spark.read.schema(flat_findings(findings, include_raw=True).schema).csv(folder, header=True, escape='"')


def parquet_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the days from PARQUET_FROM on, from folders by day."""
    folder = _folder(spark, "findings-parquet")
    write_parquet(scan(access_records(spark, sf_dir), PACK), folder)
    return spark.read.parquet(folder).where(F.col("day") >= PARQUET_FROM).select(F.col("day").cast("string").alias("day"), "rule_id", "line_number", "timestamp", "src_ip")


def min_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(access_records(spark, sf_dir), PACK, "critical").groupBy("rule_id", "level").agg(F.count(F.lit(1)).alias("n"))


# --- keyed detections --------------------------------------------------------------------------

def _keyed_shape(findings: DataFrame) -> DataFrame:
    return findings.select("rule_id", "level", "timestamp", "line_number", _joined("matched_fields"),
                           _joined("matched_values"))


def _keyed(*rules: Rule) -> Query:
    return lambda spark, sf_dir: _keyed_shape(detect_keyed(access_records(spark, sf_dir), rules))


def pack_hunt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole bundled pack, keyed rules included, counted per rule."""
    return rule_hits(hunt(access_records(spark, sf_dir), PACK))


def pack_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keyed rules of the bundled pack over bursts of requests."""
    return _keyed_shape(detect_keyed(burst_records(spark, sf_dir), PACK))


# --- summaries ---------------------------------------------------------------------------------

def _top(field: str) -> Query:
    return lambda spark, sf_dir: top_values(access_records(spark, sf_dir), field, 20).select(
        F.col(field).cast("string").alias("value"), "count")


def timeline_rows_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline_rows(access_records(spark, sf_dir))


def timeline_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "timeline")
    records = access_records(spark, sf_dir)
    write_timeline_csv(records, folder)
    written = spark.read.schema(timeline(records).schema).csv(folder, header=True, escape='"')
    return written.withColumn("timestamp", iso_text(F.col("timestamp")))


def timeline_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = numbered_timeline(access_records(spark, sf_dir))
    return placed.select("position", iso_text(F.col("timestamp")).alias("timestamp"), "line_number", "src_ip", "uri_path")


def _line_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(access_records(spark, sf_dir), PACK)


def severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings_by_severity(_line_findings(spark, sf_dir))


def _top_findings(field: str) -> Query:
    return lambda spark, sf_dir: top_counts(_line_findings(spark, sf_dir), field, REPORT_TOP_LIMIT).select(
        F.col(field).alias("value"), "count")


def rule_hit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_hits(_line_findings(spark, sf_dir))


def category_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_findings(spark, sf_dir).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def rule_catalog_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = rule_catalog(spark, PACK).select("rule_id", "level", "type", "category", _joined("tags"))
    hits = rule_hits(_line_findings(spark, sf_dir)).select("rule_id", "hits")
    return catalog.join(hits, "rule_id", "left").orderBy("rule_id")


def _review(by: str, rows: int = REVIEW_ROWS) -> Query:
    return lambda spark, sf_dir: grouped_review(_line_findings(spark, sf_dir), by, rows).select(
        "review_group", "group_size", "hidden", "row_in_group", "rule_id", "level", "timestamp", "line_number")


def most_severe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return highest_severity(_line_findings(spark, sf_dir))


def run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = _w3c_source(spark, sf_dir)
    return line_statistics(normalize(source.lines, carry=("reason",)), source.notices, PACK)


def report_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counted sections of the report, one under the other."""
    tables = report_tables(_line_findings(spark, sf_dir))
    shapes = {"findings_by_severity": ("level", "findings"), "top_source_ips": ("src_ip", "count"), "top_uri_paths": ("uri_path", "count"),
              "top_user_agents": ("user_agent", "count"), "rule_hits": ("rule_id", "hits")}
    return reduce(DataFrame.unionByName, [tables[name].select(F.lit(name).alias("section"), F.col(value).alias("value"), F.col(n).alias("n"))
                                          for name, (value, n) in shapes.items()])


def report_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered_detail(_line_findings(spark, sf_dir)).select("position", "rule_id", "line_number")


def report_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detail_rows(_line_findings(spark, sf_dir)).select(
        "timestamp", "level", "rule_id", "src_ip", "method", "uri_path", "uri_query", "status_code", "line_number")


def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    findings = hunt(access_records(spark, sf_dir), [*PREDICATES.values(), KEYED["threshold"], KEYED["rarity"]])
    return findings.groupBy("rule_id", event_count().alias("event_count")).agg(F.count(F.lit(1)).alias("n"))


# --- streams -----------------------------------------------------------------------------------

def _run_stream(spark: SparkSession, frame: DataFrame) -> DataFrame:
    """Run a stream over everything there is and read what it wrote."""
    folder = _folder(spark, "stream")
    (frame.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/state")
     .trigger(availableNow=True).start(f"{folder}/rows").awaitTermination())
    return spark.read.schema(frame.schema).parquet(f"{folder}/rows")


def _stream_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access_records(spark, sf_dir, events=event_stream(spark, sf_dir))


def stream_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run_stream(spark, scan(_stream_records(spark, sf_dir), PACK).select("rule_id", "line_number"))


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that stateful processors need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _stream_keyed(*rules: Rule) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        use_rocksdb(spark)
        return _keyed_shape(_run_stream(spark, windowed_stream(_stream_records(spark, sf_dir), rules, "0 seconds")))
    return run


def stream_running_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running count per client, kept as the latest complete table."""
    return _latest(spark, running_counts(_stream_records(spark, sf_dir), "src_ip"))


def _ingested_w3c(spark: SparkSession, sf_dir: str) -> str:
    """Folder of the records and rejects of log files that arrive one batch after the other."""
    target = _folder(spark, "arrivals")
    logs = write_w3c_logs(spark, sf_dir)
    ingest_logs(spark, logs, target, "*.txt", files_per_batch=FILES_PER_BATCH).trigger(availableNow=True).start().awaitTermination()
    return target


def stream_w3c_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(ingested(spark, _ingested_w3c(spark, sf_dir)))


def stream_w3c_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingested(spark, _ingested_w3c(spark, sf_dir), REJECTS).select(_file_no(), "line_number", "reason")


def stream_files_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line rules on the stream of records that come out of arriving files."""
    records = record_stream(spark, _ingested_w3c(spark, sf_dir))
    return _run_stream(spark, scan(records, PACK).select("rule_id", _file_no(), "line_number"))


def stream_state_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed findings of a stream, and the rows its state holds once time has passed every window."""
    use_rocksdb(spark)
    folder = _folder(spark, "expiry")
    records = access_records(spark, sf_dir)
    records.write.parquet(f"{folder}/in/part=0")
    rules = [KEYED["threshold"], KEYED["threshold_composite_key"], KEYED["sequence"]]

    def run() -> StreamingQuery:
        stream = spark.readStream.schema(records.schema).parquet(f"{folder}/in/part=*")
        query = (windowed_stream(stream, rules, "1 hour").writeStream.option("checkpointLocation", f"{folder}/state")
                 .trigger(availableNow=True).start(f"{folder}/rows", format="parquet"))
        query.awaitTermination()
        return query

    run()
    # A last record that no rule counts, in a far future; the second run goes on from the state of the first.
    last = records.agg(F.max(F.timestamp_add("YEAR", F.lit(70), F.col("timestamp"))).alias("timestamp")).withColumn("status", F.lit(302).cast("bigint"))
    records.where("false").unionByName(last, allowMissingColumns=True).write.parquet(f"{folder}/in/part=1")
    left = run().lastProgress["stateOperators"][0]["numRowsTotal"]
    return spark.read.parquet(f"{folder}/rows").groupBy("rule_id").agg(F.count(F.lit(1)).alias("findings")).withColumn("state_rows", F.lit(left).cast("bigint"))


def _latest(spark: SparkSession, frame: DataFrame) -> DataFrame:
    """Run a stream in complete mode and read the last table it gave."""
    folder = _folder(spark, "running")
    (frame.writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/state")
     .foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{folder}/rows"))
     .trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(frame.schema).parquet(f"{folder}/rows")


def _stream_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of line rules and keyed rules in one stream: counting them is a second stateful operator behind the first."""
    use_rocksdb(spark)
    records = _stream_records(spark, sf_dir)
    keyed = windowed_stream(records, [KEYED["threshold"], KEYED["threshold_composite_key"], KEYED["sequence"]], "0 seconds")
    return scan(records, PACK).unionByName(keyed)


def stream_top_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _latest(spark, running_rule_hits(_stream_findings(spark, sf_dir), REPORT_TOP_LIMIT))


def stream_findings_by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _latest(spark, running_severities(_stream_findings(spark, sf_dir)))


def stream_top_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _latest(spark, running_top(_stream_records(spark, sf_dir), "src_ip", REPORT_TOP_LIMIT))


def all_queries() -> dict[str, Query]:
    return {
        "normalize_fields": normalize_fields,
        "url_decode": url_decode,
        "url_parts_extension": url_parts_extension,
        "status_flags": status_flags,
        "timestamp_offset": timestamp_offset,
        "w3c_parse": w3c_parse,
        "w3c_rejects": w3c_rejects,
        "w3c_header_rejects": w3c_header_rejects,
        "csv_parse": csv_parse,
        "csv_rejects": csv_rejects,
        "csv_multiline_header": csv_multiline_header,
        "read_logs_mixed": read_logs_mixed,
        **{name: _matching(rule) for name, rule in PREDICATES.items()},
        "scan_pack": scan_pack,
        "scan_evidence": scan_evidence,
        "findings_flat": findings_flat,
        "findings_json_roundtrip": findings_json_roundtrip,
        "findings_csv_roundtrip": findings_csv_roundtrip,
        "parquet_roundtrip": parquet_roundtrip,
        "min_level": min_level,
        **{name: _keyed(rule) for name, rule in KEYED.items()},
        "multi_agg": _keyed(*KEYED.values()),
        "pack_hunt": pack_hunt,
        "pack_keyed": pack_keyed,
        **{f"top_{field}": _top(field) for field in TOP_FIELDS},
        "timeline": timeline_rows_query,
        "timeline_csv_roundtrip": timeline_csv_roundtrip,
        "timeline_positions": timeline_positions,
        "findings_by_severity": severity,
        "top_finding_sources": _top_findings("src_ip"),
        "top_finding_paths": _top_findings("uri_path"),
        "top_finding_agents": _top_findings("user_agent"),
        "rule_hits": rule_hit_summary,
        "category_summary": category_summary,
        "rule_catalog_hits": rule_catalog_hits,
        **{f"grouped_review_{by}": _review(by) for by in REVIEW_GROUPS},
        "review_without_limit": _review("level", 0),
        "highest_severity": most_severe,
        "run_stats": run_stats,
        "report_detail": report_detail,
        "report_positions": report_positions,
        "report_tables": report_sections,
        "event_counts": event_counts,
        "stream_scan": stream_scan,
        "stream_threshold": _stream_keyed(KEYED["threshold"], KEYED["threshold_composite_key"]),
        "stream_sequence": _stream_keyed(KEYED["sequence"]),
        "stream_running_counts": stream_running_counts,
        "stream_w3c_files": stream_w3c_files,
        "stream_w3c_rejects": stream_w3c_rejects,
        "stream_files_scan": stream_files_scan,
        "stream_state_expiry": stream_state_expiry,
        "stream_top_findings": stream_top_findings,
        "stream_findings_by_severity": stream_findings_by_severity,
        "stream_top_sources": stream_top_sources,
    }
