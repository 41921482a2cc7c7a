import os.path
import random
from urllib.parse import unquote_plus

import pytest
from pyspark.sql import functions as F

from wardlog.functions.clock import event_time, iso_text, offset_seconds
from wardlog.functions.text import file_extension, url_decode
from wardlog.operators.normalize import normalize


def raw(spark, *fields):
    return spark.createDataFrame([("x.log", i + 1, "raw", f) for i, f in enumerate(fields)],
                                 "log_file string, line_number bigint, raw_line string, fields map<string,string>")


def test_types_dash_and_unknown_fields(spark):
    row = normalize(raw(spark, {"date": "2026-07-03", "time": "10:22:01", "cs-method": "GET", "sc-status": "200", "c-ip": "-",
                                "time-taken": "4x", "sc-bytes": " +12 ", "x-custom": "v", "x-none": "-", "timestamp": "zzz"})).first()
    assert (row.method, row.status, row.src_ip, row.time_taken, row.bytes_sent) == ("GET", 200, None, None, 12)
    assert row.extra == {"x-custom": "v", "x-none": None}
    assert row.timestamp.isoformat() == "2026-07-03T10:22:01" and row.is_success_status and not row.is_error_status
    assert (row.log_file, row.line_number, row.raw_line) == ("x.log", 1, "raw")


def test_schema_names_are_accepted_and_derived_ones_recomputed(spark):
    flat = spark.createDataFrame([("1.2.3.4", "404", ".zzz", "a", 7)], "src_ip string, status string, extension string, "
                                                                       "`x y` string, line_number bigint")
    row = normalize(flat).first()
    assert (row.src_ip, row.status, row.extension, row.extra, row.line_number) == ("1.2.3.4", 404, None, {"x y": "a"}, 7)
    assert row.timestamp is None and row.is_error_status


@pytest.mark.parametrize("path,query,original,decoded", [
    ("/a.aspx", "q=%2527x", "/a.aspx?q=%2527x", "/a.aspx?q='x"),
    ("/a", None, "/a", "/a"), (None, "q", None, None), ("/%252e%252e/", "%zz+%", "/%252e%252e/?%zz+%", "/../?%zz %"),
    ("/a%", "3Fb", "/a%?3Fb", "/a%?3Fb"),
])
def test_urls(spark, path, query, original, decoded):
    row = normalize(raw(spark, {"cs-uri-stem": path or "-", "cs-uri-query": query or "-"})).first()
    assert (row.url_original, row.url_decoded) == (original, decoded)


def test_decode_and_extension_on_random_text(spark):
    rng = random.Random(5)
    pieces = ["%", "%2", "%25", "%2e", "%252F", "%c3%a9", "%ff", "+", "a", "/", ".", "?", "é", "%00", "..", "x.Y", "%E2%82"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 9))) for _ in range(3000)]

    def decode(text):
        for _ in range(3):
            text = unquote_plus(text)
        return text

    frame = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", url_decode(F.col("t")).alias("d"), file_extension(F.col("t")).alias("e"))
    for row in frame.collect():
        assert row.d == decode(row.t), row.t
        assert (row.e or "") == os.path.splitext(row.t.split("?", 1)[0])[1].lower(), row.t


def test_times(spark):
    cases = [("2026-07-03", "10:00:01", "2026-07-03T10:00:01Z"), ("2026-7-3", "1:2:3", "2026-07-03T01:02:03Z"),
             ("2026-02-30", "10:00:00", None), ("26-02-03", "10:00:00", None), ("2026-07-03", "10:00", None),
             (None, "10:00:00", None), ("2026-07-03", "24:00:00", None), ("x", "y", None)]
    frame = spark.createDataFrame(cases, "d string, t string, e string")
    for row in frame.select("e", iso_text(event_time(F.col("d"), F.col("t"))).alias("g"),
                            iso_text(event_time(F.col("d"), F.col("t"), "+03:00")).alias("z")).collect():
        assert row.g == row.e
    assert frame.select(iso_text(event_time(F.col("d"), F.col("t"), "-0530"))).first()[0] == "2026-07-03T15:30:01Z"
    assert [offset_seconds(z) for z in ("UTC", "z", "", "+03:00", "-0530", "02", "+14:59")] == \
        [0, 0, 0, 10800, -19800, 7200, 53940]
    for wrong in ("+15:00", "03:60", "abc", "+3", "+"):
        with pytest.raises(ValueError):
            offset_seconds(wrong)
