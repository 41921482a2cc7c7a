import random

import pytest
from keyed_model import run
from pyspark.sql import functions as F

from wardlog.lineage import settle
from wardlog.operators import windows
from wardlog.operators.rules import rule_from
from wardlog.operators.windows import detect_keyed

COUNTED = {"status|in": ["401", "403"]}
FOLLOW = {"status": {"gte": 200, "lt": 300}}
T0 = 1_700_000_000


def keyed_rule(rule_id="r", **aggregation):
    return rule_from({"id": rule_id, "title": rule_id.upper(), "level": "medium", "type": "aggregation",
                      "aggregation": {"group_by": ["src_ip"], **aggregation}})


def records(spark, rows):
    """rows: (sec or None, src_ip, status, uri_path, file, line)"""
    frame = spark.createDataFrame(rows, "sec bigint, src_ip string, status bigint, uri_path string, "
                                        "log_file string, line_number bigint")
    empty = F.lit(None).cast("string")
    return frame.select(F.timestamp_seconds("sec").alias("timestamp"), "src_ip", "status", "uri_path",
                        "log_file", "line_number", F.lit("GET").alias("method"),
                        F.element_at(F.split("uri_path", r"(?=\.)"), -1).alias("extension"),
                        *[empty.alias(c) for c in ("uri_query", "user_agent", "referer", "host", "raw_line")])


def fired(findings):
    return sorted((r.src_ip, r.sec, r.log_file, r.line_number, int(r.matched_values[-1]))
                  for r in findings.select("*", F.unix_timestamp("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'")
                                           .alias("sec")).collect())


def probe(spark, *offsets, status=404, ip="1.1.1.1"):
    return records(spark, [(T0 + o, ip, status, "/probe", "t.log", i + 1) for i, o in enumerate(offsets)])


def test_threshold_fires_once_at_the_bound(spark):
    rule = keyed_rule(filter={"status": 404}, count_gte=5, window_minutes=10)
    rows = detect_keyed(probe(spark, *range(6)), [rule]).collect()
    assert [(r.line_number, r.matched_fields, r.matched_values) for r in rows] == \
        [(5, ["src_ip", "event_count"], ["1.1.1.1", "5"])]
    assert rows[0].rule_title == "R" and rows[0].status_code == 404


def test_threshold_window_expires(spark):
    rule = keyed_rule(filter={"status": 404}, count_gte=5, window_minutes=10)
    assert detect_keyed(probe(spark, *[60 * m for m in (0, 1, 2, 3, 30, 31, 32, 33)]), [rule]).count() == 0


def test_threshold_window_is_closed(spark):
    rule = keyed_rule(count_gte=2, window_minutes=10)
    assert detect_keyed(probe(spark, 0, 600), [rule]).count() == 1
    assert detect_keyed(probe(spark, 0, 601), [rule]).count() == 0


def test_threshold_filter_and_key(spark):
    rule = keyed_rule(filter={"status": 404}, count_gte=3, window_minutes=10)
    assert detect_keyed(probe(spark, *range(5), status=200), [rule]).count() == 0
    spread = records(spark, [(T0 + i, f"10.0.0.{i}", 404, "/p", "t.log", i) for i in range(4)])
    assert detect_keyed(spread, [rule]).count() == 0


def test_rows_without_time_or_key_are_ignored(spark):
    rule = keyed_rule(count_gte=1, window_minutes=1)
    rows = records(spark, [(None, "1.1.1.1", 404, "/p", "t.log", 1), (T0, None, 404, "/p", "t.log", 2)])
    assert detect_keyed(rows, [rule]).count() == 0


def test_sequence(spark):
    rule = keyed_rule(filter=COUNTED, followed_by=FOLLOW, count_gte=3, window_minutes=30)
    enough = records(spark, [(T0 + i, "1.1.1.1", s, "/l", "t.log", i) for i, s in enumerate((401, 401, 403, 200))])
    assert fired(detect_keyed(enough, [rule])) == [("1.1.1.1", T0 + 3, "t.log", 3, 3)]
    short = records(spark, [(T0 + i, "1.1.1.1", s, "/l", "t.log", i) for i, s in enumerate((401, 200))])
    assert detect_keyed(short, [rule]).count() == 0


def test_sequence_order_within_a_second(spark):
    rule = keyed_rule(filter=COUNTED, followed_by=FOLLOW, count_gte=2, window_minutes=30)
    before = records(spark, [(T0, "1.1.1.1", s, "/l", "t.log", i) for i, s in enumerate((200, 401, 401))])
    assert detect_keyed(before, [rule]).count() == 0
    after = records(spark, [(T0, "1.1.1.1", s, "/l", "t.log", i) for i, s in enumerate((401, 200, 401, 200))])
    assert fired(detect_keyed(after, [rule])) == [("1.1.1.1", T0, "t.log", 3, 2)]


def test_rarity_counts_the_whole_input(spark):
    rule = rule_from({"id": "rare", "title": "R", "level": "low", "type": "aggregation", "aggregation": {
        "group_by": ["uri_path"], "filter": {"extension|in": [".aspx"], "status": {"gte": 200, "lt": 300}},
        "count_lte": 2, "window_minutes": 1}})
    rows = records(spark, [(T0 + 9000 * i, "1.1.1.1", 200, "/common.aspx", "t.log", i) for i in range(5)]
                   + [(T0 + 7, "2.2.2.2", 200, "/shell.aspx", "u.log", 1), (T0 + 9, "3.3.3.3", 200, "/shell.aspx", "t.log", 8)])
    found = detect_keyed(rows, [rule]).collect()
    assert [(r.uri_path, r.src_ip, r.matched_values) for r in found] == [("/shell.aspx", "3.3.3.3", ["/shell.aspx", "2"])]


def test_composite_key(spark):
    rule = rule_from({"id": "two", "title": "R", "level": "low", "type": "aggregation", "aggregation": {
        "group_by": ["src_ip", "uri_path"], "count_gte": 2, "window_minutes": 1}})
    rows = records(spark, [(T0, "1.1.1.1", 200, "/a", "t.log", 1), (T0 + 1, "1.1.1.1", 200, "/b", "t.log", 2),
                           (T0 + 2, "1.1.1.1", 200, "/a", "t.log", 3)])
    assert [r.matched_values for r in detect_keyed(rows, [rule]).collect()] == [["1.1.1.1", "/a", "2"]]


SETTINGS = [(5, 10.0, False), (1, 0.5 / 60, False), (8, 90.5 / 60, False), (3, 0.5, False), (40, 600.0, False),
            (5, 10.0, True), (1, 0.5 / 60, True), (8, 90.5 / 60, True), (3, 0.5, True)]


@pytest.mark.parametrize("seed,block_lines,key_seconds", [(1, 4096, 100_000), (2, 3, 20), (3, 1, 0)])
def test_random_events_match_the_step_by_step_model(spark, seed, block_lines, key_seconds, monkeypatch):
    """All rules in one run, short slots so that windows cross slot borders, ties and several files; crowded seconds and busy keys."""
    monkeypatch.setattr(windows, "SLOT_SECONDS", 100 * seed)
    monkeypatch.setattr(windows, "BLOCK_LINES", block_lines)
    monkeypatch.setattr(windows, "KEY_SECONDS", key_seconds)
    rng = random.Random(seed)
    rows, sec = [], T0
    for i in range(4000):
        sec += rng.choice([0, 0, 0, 1, 1, 2, 7, 40]) if rng.random() < 0.995 else 3000
        rows.append((sec, f"ip{rng.choice([0, 0, 0, 0, 1, 2, 3])}", rng.choice([200, 401, 403, 404, 204]), "/p",
                     f"f{rng.randrange(3)}", i))
    rng.shuffle(rows)
    rules = [keyed_rule(f"r{i}", filter=COUNTED, count_gte=need, window_minutes=minutes,
                        **({"followed_by": FOLLOW} if sequence else {}))
             for i, (need, minutes, sequence) in enumerate(SETTINGS)]
    found = detect_keyed(records(spark, rows).repartition(7), rules).persist()
    model = [{"key": ip, "sec": s, "file": f, "line": n, "counted": status in (401, 403),
              "follow": 200 <= status < 300} for s, ip, status, _, f, n in rows]
    total = 0
    for i, (need, minutes, sequence) in enumerate(SETTINGS):
        expected = run(model, need, minutes * 60, sequence)
        assert fired(found.where(F.col("rule_id") == f"r{i}")) == expected, (need, minutes, sequence)
        total += len(expected)
    assert total > 500
    found.unpersist()


def test_windows_without_a_common_range_run_apart(spark, monkeypatch):
    monkeypatch.setattr(windows, "MAX_COMMON_WINDOW", 1000)
    rules = [keyed_rule(f"r{m}", count_gte=2, window_minutes=m) for m in (7, 11, 13)]
    assert len(windows._window_batches(rules)) > 1
    assert sorted(r.rule_id for r in detect_keyed(probe(spark, 0, 500, 1200), rules).collect()) == ["r11", "r13"]


def test_rarity_counts_without_payload(spark):
    rule = rule_from({"id": "rare", "title": "R", "level": "low", "type": "aggregation", "aggregation": {
        "group_by": ["uri_path"], "count_lte": 2, "window_minutes": 1}})
    rows = records(spark, [(T0 + i, "1.1.1.1", 200, f"/p{i % 7}", "t.log", i) for i in range(15)])
    found = detect_keyed(rows, [rule])
    assert sorted(r.line_number for r in found.collect()) == [1, 2, 3, 4, 5, 6]
    assert "SortAggregate" not in found._jdf.queryExecution().toString()


def test_a_second_with_very_many_rows(spark):
    """100,000 rows of one key in one second, in three files: the row that fires is found by blocks of lines."""
    many = 100_000
    numbers = spark.range(many).select(F.lit(T0).alias("sec"), F.lit("ip").alias("src_ip"), F.when(F.col("id") % 50_000 == 49_999, 200).otherwise(401).alias("status").cast("bigint"),
                                       F.lit("/p").alias("uri_path"), F.concat(F.lit("f"), F.floor(F.col("id") / 40_000)).alias("log_file"), (F.col("id") % 40_000).alias("line_number"))
    empty = F.lit(None).cast("string")
    frame = numbers.withColumns({"timestamp": F.timestamp_seconds("sec"), "method": F.lit("GET"), "extension": empty,
                                 **{c: empty for c in ("uri_query", "user_agent", "referer", "host", "raw_line")}}).drop("sec")
    rules = [keyed_rule("t", filter=COUNTED, count_gte=70_000, window_minutes=1), keyed_rule("s", filter=COUNTED, followed_by=FOLLOW, count_gte=60_000, window_minutes=1)]
    found = {r.rule_id: (r.log_file, r.line_number, r.matched_values[-1]) for r in detect_keyed(frame, rules).collect()}
    assert found == {"t": ("f1", 30_000, "70000"), "s": ("f2", 19_999, "99998")}


@pytest.mark.parametrize("key_seconds", [100_000, 1000, 0])
def test_cool_down_over_slots(spark, key_seconds):
    """Fires of the slots are those of a walk along each key; one key holds most rows, times go back before 1970."""
    rng = random.Random(3)
    rows, expected = [], []
    for seq, (pause, slot) in enumerate(((7, 60), (60, 60), (200, 60), (1, 5), (61, 1000))):
        for key, many in (("hot", 20000), ("warm", 300), ("cold", 3)):
            free_at = None
            for sec in sorted(rng.sample(range(-15000, 15000), many)):
                rows.append((seq, [key], sec, pause, sec // slot, slot))
                if free_at is None or sec >= free_at:
                    expected.append((seq, key, sec))
                    free_at = sec + pause
    rng.shuffle(rows)
    reaching = spark.createDataFrame(rows, "rule_seq int, key array<string>, sec bigint, pause bigint, home bigint, slot bigint").selectExpr(
        "*", "0L AS prior", "1L AS need", "false AS sequence", "1L AS rows_here")
    got = [(r.rule_seq, r.key[0], r.sec) for r in windows.firing_seconds(reaching, key_seconds).collect()]
    assert sorted(got) == sorted(expected)
    none = windows.firing_seconds(reaching.where("sec > 99999"), key_seconds)
    assert none.count() == 0


def test_tables_that_grow_with_the_records_do_not_go_through_the_driver(spark):
    """Keys of 20 MB of text: not broadcast, and not a hash table that has to fit a task."""
    def keys(rows):
        return spark.range(rows).select((F.col("id") % 2).cast("int").alias("rule_seq"), F.array(F.concat(F.lit("10.0.0."), "id"), F.lit("/some/path")).alias("key"))

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = keys(1000).join(windows._sized(settle(keys(350_000))), windows.GROUP)
        plan = joined._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan and "ShuffledHash" not in plan and joined.count() == 1000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
