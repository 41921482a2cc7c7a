import json
import random
import shutil
from math import ceil, floor

import pandas as pd
import pytest
from keyed_model import run as keyed_walk
from pyspark.sql import functions as F
from test_windows import COUNTED, FOLLOW, T0, keyed_rule, records

from wardlog.operators.rules import load_rules
from wardlog.operators.scan import scan
from wardlog.operators.summary import findings_by_severity, rule_hits
from wardlog.operators.windows import COUNTED as COUNTED_ROW
from wardlog.operators.windows import FOLLOW_UP, detect_keyed
from wardlog.schema import FINDING_RECORD_COLUMNS
from wardlog.streaming import live
from wardlog.streaming.arrivals import REJECTS, ingest_logs, ingested, record_stream
from wardlog.streaming.live import (SlidingCount, fold_rows, running_counts, running_rule_hits, running_severities,
                                    running_top, windowed_stream)

SHAPE = ["rule_id", "timestamp", "log_file", "line_number", "matched_values"]


def rows_of(frame):
    return sorted(map(str, frame.select(*SHAPE).collect()))


@pytest.fixture(scope="module")
def three_files(spark, tmp_path_factory):
    """600 records in three Parquet files that arrive one after the other; the borders overlap."""
    rng = random.Random(3)
    rows, sec = [], T0
    for i in range(600):
        sec += rng.choice([0, 0, 1, 1, 2, 7, 40])
        rows.append((sec, f"ip{rng.choice([0, 0, 0, 1, 2])}", rng.choice([200, 401, 403, 404]), "/p", f"f{rng.randrange(3)}", i))
    arrival = sorted(rows, key=lambda r: r[0] + rng.randrange(100))
    work, folder = tmp_path_factory.mktemp("work"), tmp_path_factory.mktemp("stream")
    for k in range(3):
        records(spark, arrival[k * 200:(k + 1) * 200]).coalesce(1).write.parquet(f"{work}/{k}")
        part, = work.glob(f"{k}/*.parquet")
        shutil.copy(part, folder / f"{k}.parquet")
    return records(spark, rows), str(folder)


def run(spark, frame, folder, mode="append"):
    (frame.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{folder}/state")
     .trigger(availableNow=True).start(f"{folder}/rows").awaitTermination())
    return spark.read.schema(frame.schema).parquet(f"{folder}/rows")


def stream(spark, folder):
    return spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_windowed_stream_equals_batch(spark, three_files, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    batch, folder = three_files
    rules = [keyed_rule(f"r{i}", filter=COUNTED, count_gte=need, window_minutes=minutes, **({"followed_by": FOLLOW} if seq else {}))
             for i, (need, minutes, seq) in enumerate([(5, 2.0, False), (1, 0.5 / 60, False), (3, 1.0, True), (2, 0.5, True)])]
    expected = rows_of(detect_keyed(batch, rules))
    # Rows arrive up to 100 seconds late. A last file, far in the future, lets the watermark pass all others.
    late = records(spark, [(T0 + 10**7, "other", 404, "/p", "z", 1)])
    late.coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "end"))
    part, = (tmp_path / "end").glob("*.parquet")
    shutil.copy(part, f"{folder}/9.parquet")
    found = run(spark, windowed_stream(stream(spark, folder), rules, "200 seconds"), str(tmp_path))
    assert rows_of(found) == expected and len(expected) > 100


def test_stateless_scan_on_a_stream(spark, three_files, tmp_path):
    batch, folder = three_files
    extra = {c: F.lit(None).cast("string") for c in ("uri_path_decoded", "uri_query_decoded", "url_decoded", "url_original", "username")}
    rules, _ = load_rules()
    found = run(spark, scan(stream(spark, folder).where("log_file != 'z'").withColumns(extra), rules), str(tmp_path))
    assert rows_of(found) == rows_of(scan(batch.withColumns(extra), rules)) and found.count() == 600


def test_running_counts(spark, three_files, tmp_path):
    batch, folder = three_files
    seen = []
    (running_counts(stream(spark, folder).where("log_file != 'z'"), "status").writeStream.outputMode("complete")
     .option("checkpointLocation", str(tmp_path / "state"))
     .foreachBatch(lambda frame, _: seen.append(sorted(map(tuple, frame.collect())))).trigger(availableNow=True).start().awaitTermination())
    assert seen[-1] == sorted(map(tuple, batch.groupBy("status").count().collect())) and len(seen) >= 3


class States:
    """State variables of one key in plain Python, with a count of what is read and written."""

    def __init__(self):
        self.maps, self.value, self.timers, self.touched = {}, None, set(), 0

    def getMapState(self, name, *_):
        outer, held = self, self.maps.setdefault(name, {})

        class Map:
            def getValue(self, key):
                outer.touched += 1
                return held.get(key)

            def updateValue(self, key, value):
                outer.touched += 1
                held[key] = value

            def removeKey(self, key):
                outer.touched += 1
                held.pop(key, None)

            def iterator(self):
                return iter(list(held.items()))

            def clear(self):
                held.clear()

        return Map()

    def getValueState(self, *_):
        outer = self

        class Value:
            exists = lambda self: outer.value is not None
            get = lambda self: outer.value
            update = lambda self, value: setattr(outer, "value", value)
            clear = lambda self: setattr(outer, "value", None)

        return Value()

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


class Clock:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):
        return self.at


def drive(batches, limits):
    """Feed one key batch by batch, (watermark, rows) each; rows are (sec, role, file, line). Gives what fired, and the states."""
    states = States()
    processor = SlidingCount(limits)
    processor.init(states)
    fired, costs = [], []
    for watermark, rows in batches:
        frame = pd.DataFrame([(0, "[\"k\"]", sec, role, f"t{sec}", *[None] * 8, file, line, "raw") for sec, role, file, line in rows],
                             columns=["rule_seq", "key_text", "sec", "role", *FINDING_RECORD_COLUMNS.values()])
        before = states.touched
        if rows:
            list(processor.handleInputRows((0, '["k"]'), fold_rows(limits)(iter([frame])), Clock(watermark)))
        costs.append(states.touched - before)
        if any(t <= watermark for t in states.timers):
            states.timers = {t for t in states.timers if t > watermark}
            for out in processor.handleExpiredTimer((0, '["k"]'), Clock(watermark), None):
                fired += [(r.log_file, r.line_number, r.event_count) for r in out.itertuples()]
    return fired, states, costs


@pytest.mark.parametrize("seed,chunk", [(1, 256), (2, 3), (3, 1)])
def test_state_of_a_key_against_a_walk(seed, chunk, monkeypatch):
    """Rows out of order within the lateness, many in a second, both kinds of rule; nothing is left once time has passed all."""
    monkeypatch.setattr(live, "WINDOW_CHUNK", chunk)
    rng = random.Random(seed)
    for need, seconds, sequence in ((3, 20, False), (1, 0.5, False), (2, 15.5, True), (6, 40, True), (9, 60, False)):
        rows, sec = [], 10_000
        for line in range(700):
            sec += rng.choice([0, 0, 0, 1, 1, 2, 9, 50])
            rows.append((sec, rng.choice([COUNTED_ROW, COUNTED_ROW, FOLLOW_UP] if sequence else [COUNTED_ROW]), f"f{rng.randrange(2)}", line))
        arrival = sorted(rows, key=lambda r: r[0] + rng.randrange(60))
        batches, at = [], 0
        while at < len(arrival):
            size = rng.randint(1, 60)
            seen = max((r[0] for r in arrival[:at]), default=0)
            batches.append((max(0, seen - 61) * 1000, arrival[at : at + size]))
            at += size
        fired, states, _ = drive([*batches, (10**9, []), (10**9 + 1, [])], {0: (need, floor(seconds), ceil(seconds), sequence)})
        model = [{"key": "k", "sec": s, "file": f, "line": n, "counted": r == COUNTED_ROW, "follow": r == FOLLOW_UP} for s, r, f, n in rows]
        assert fired == [(f, n, c) for _, _, f, n, c in keyed_walk(model, need, seconds, sequence)] and len(fired) > 5
        assert states.value is None and not states.timers and not any(states.maps.values())


def test_a_batch_costs_the_same_however_many_rows_wait():
    limits = {0: (5, 100, 100, False)}
    batches = [(0, [(1000 + k, COUNTED_ROW, "f", 1000 * k + i) for i in range(40)]) for k in range(300)]
    _, states, costs = drive(batches, limits)
    assert set(costs) == {costs[0]} and max(len(json.loads(body)) for (body,) in states.maps["rows"].values()) == 5


@pytest.mark.parametrize("chunk", [1000, 3])
def test_keys_of_a_bucket_share_their_state(chunk, monkeypatch):
    """Many keys in one group: each fires as it does alone, a batch costs a few accesses and not some for every key and second."""
    for name in ("WINDOW_CHUNK", "WAITING_CHUNK"):
        monkeypatch.setattr(live, name, chunk)
    rng = random.Random(chunk)
    for need, seconds, sequence in ((2, 30, False), (2, 90, True)):
        limits = {0: (need, seconds, seconds, sequence)}
        rows = [(1000 + i // 8 + rng.randrange(20), f"k{rng.randrange(150)}", rng.choice([COUNTED_ROW, COUNTED_ROW, FOLLOW_UP] if sequence else [COUNTED_ROW]), i) for i in range(2400)]
        states, fired, costs = States(), [], []
        processor = SlidingCount(limits)
        processor.init(states)
        for at in (0, 800, 1600):
            part = rows[at : at + 800]
            frame = pd.DataFrame([(0, key, sec, role, f"t{sec}", *[None] * 8, "f", line, key) for sec, key, role, line in part],
                                 columns=["rule_seq", "key_text", "sec", "role", *FINDING_RECORD_COLUMNS.values()])
            passed = Clock((1000 + at // 8 - 1) * 1000)
            before = states.touched
            list(processor.handleInputRows((0, 7), fold_rows(limits)(iter([frame])), passed))
            costs.append(states.touched - before)
            for now in [passed, Clock(10**9)] if at == 1600 else [passed]:
                for out in processor.handleExpiredTimer((0, 7), now, None):
                    fired += [(r.raw_line, r.timestamp, r.line_number, r.event_count) for r in out.itertuples()]
        model = [{"key": k, "sec": s, "file": "f", "line": n, "counted": r == COUNTED_ROW, "follow": r == FOLLOW_UP} for s, k, r, n in rows]
        assert sorted(fired) == sorted((k, f"t{s}", n, c) for k, s, _, n, c in keyed_walk(model, need, seconds, sequence)) and len(fired) > 100
        assert states.value is None and not any(states.maps.values()) and (chunk < 1000 or max(costs) <= 2)


def test_late_rows_are_dropped_and_idle_keys_forgotten():
    limits = {0: (2, 10, 10, False)}
    late = [(0, [(100, COUNTED_ROW, "f", 1), (101, COUNTED_ROW, "f", 2)]), (105_000, [(104, COUNTED_ROW, "f", 3), (105, COUNTED_ROW, "f", 4), (120, COUNTED_ROW, "f", 5)]),
            (121_000, []), (140_000, [])]
    fired, states, _ = drive(late, limits)
    assert fired == [("f", 2, 2)] and states.value is None and not states.timers


def log_text(first, count):
    return "#Fields: date time c-ip sc-status\n" + "".join(f"2025-11-08 10:{k // 60:02d}:{k % 60:02d} 10.1.1.{k % 3} {404 if k % 2 else 200}\n" for k in range(first, first + count)) + "broken row\n"


def test_arriving_files_are_parsed_once(spark, tmp_path):
    """Files in several batches; a batch whose commit was lost is repeated and changes nothing, one cut off while writing is written anew."""
    folder, target = tmp_path / "in", tmp_path / "out"
    folder.mkdir()

    def arrive(name, first, count):
        (tmp_path / "new").write_text(log_text(first, count))
        (tmp_path / "new").rename(folder / name)

    def run():
        ingest_logs(spark, str(folder), str(target), files_per_batch=2).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.log_file.rsplit("/", 1)[-1], r.line_number, r.batch) for r in ingested(spark, str(target)).collect())

    for k in range(3):
        arrive(f"s{k}.log", 40 * k, 40)
    first = run()
    assert len(first) == 120 and {r[2] for r in first} == {0, 1} and run() == first
    assert sorted((r.log_file.rsplit("/", 1)[-1], r.line_number) for r in ingested(spark, str(target), REJECTS).collect()) == [(f"s{k}.log", 42) for k in range(3)]
    files = lambda: sorted(str(p) for p in (target / "records").rglob("*.parquet"))
    before = files()
    (target / "progress/commits/1").unlink()  # the engine runs batch 1 again
    for crc in (target / "progress/commits").glob(".1.*"):
        crc.unlink()
    assert run() == first and files() == before
    (target / "progress/commits/1").unlink()
    for crc in (target / "progress/commits").glob(".1.*"):
        crc.unlink()
    (target / "records/batch=1/_SUCCESS").unlink()  # it was stopped while it wrote
    arrive("late.log", 500, 10)
    again = run()
    assert [r for r in again if r[0] != "late.log"] == first and len(again) == 130 and before[0] in files() and files() != before
    stream = record_stream(spark, str(target))
    (running_top(stream, "src_ip", 2).writeStream.outputMode("complete").option("checkpointLocation", str(tmp_path / "top"))
     .foreachBatch(lambda frame, _: frame.write.mode("overwrite").parquet(str(tmp_path / "top2"))).trigger(availableNow=True).start().awaitTermination())
    whole = ingested(spark, str(target)).groupBy("src_ip").count().orderBy(F.desc("count"), "src_ip").limit(2)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "top2")).collect())) == sorted(map(tuple, whole.collect()))


def test_a_backlog_comes_in_few_batches(spark, tmp_path):
    """Many small files that wait are not one round of jobs for every few of them; each line still comes once."""
    folder, target = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    for k in range(30):
        (folder / f"s{k}.log").write_text(log_text(3 * k, 3))
    ingest_logs(spark, str(folder), str(target), files_per_batch=1).trigger(availableNow=True).start().awaitTermination()
    found = sorted((r.log_file.rsplit("/", 1)[-1], r.line_number) for r in ingested(spark, str(target)).collect())
    assert found == sorted((f"s{k}.log", n) for k in range(30) for n in (2, 3, 4))
    assert ingested(spark, str(target), REJECTS).count() == 30 and ingested(spark, str(target)).select("batch").distinct().count() == 4


def test_running_counts_of_findings(spark, three_files, tmp_path):
    """Counts of line and keyed findings behind a stateful operator, in complete mode, against the batch."""
    batch, folder = three_files
    extra = {c: F.lit(None).cast("string") for c in ("uri_path_decoded", "uri_query_decoded", "url_decoded", "url_original", "username")}
    rules, _ = load_rules()
    keyed = [keyed_rule("r0", filter=COUNTED, count_gte=5, window_minutes=2.0)]

    def findings(records):
        records = records.where("log_file != 'z'").withColumns(extra)
        return scan(records, rules), records

    lines, records_now = findings(stream(spark, folder))
    found = lines.unionByName(windowed_stream(records_now, keyed, "200 seconds"))
    seen = {}
    for name, frame in (("levels", running_severities(found)), ("rules", running_rule_hits(found, 3))):
        (frame.writeStream.outputMode("complete").option("checkpointLocation", str(tmp_path / name))
         .foreachBatch(lambda rows, _, name=name: seen.__setitem__(name, [tuple(r) for r in rows.collect()])).trigger(availableNow=True).start().awaitTermination())
    lines, records_all = findings(batch)
    passed = detect_keyed(records_all, keyed)
    last = records_all.agg(F.max(F.unix_seconds("timestamp"))).first()[0] - 200
    due = passed.where(F.unix_timestamp("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'") <= last)
    every = lines.unionByName(due)
    assert seen["levels"] == [tuple(r) for r in findings_by_severity(every).collect()]
    assert seen["rules"] == [tuple(r) for r in rule_hits(every).limit(3).collect()] and due.count() > 10
