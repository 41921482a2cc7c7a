"""The same detections on a stream of records.

Line rules are stateless, so ``scan`` itself works on a stream. Threshold and sequence rules need
order: rows wait until the watermark has passed them and are then taken in event-time order, which
gives the batch results for every row that is not later than the watermark allows.

Rows are folded to (rule, key, second) inside each task before they reach the state. A group of the state is a bucket of
the keys of one rule, so state is read and written in chunks of many seconds and keys, never row by row. What waits for
the watermark is a set of chunks in order of time: numbers of rows, and apart from them the rows that can still fire, which
are read only if a second of the chunk reaches its bound. A batch writes chunks of its own, however many rows are waiting,
and a watermark reads only chunks that it has reached and the chunks of the running windows that end.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from itertools import accumulate, groupby
from math import ceil, floor
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from wardlog.functions.severity import LEVELS
from wardlog.operators.rules import Rule, keyed_rules
from wardlog.operators.scan import WINDOW_PHASE, record_columns
from wardlog.operators.summary import TOP_LIMIT
from wardlog.operators.windows import COUNTED, FOLLOW_UP, _keyed_findings, mark_rows
from wardlog.schema import FINDING_RECORD_COLUMNS

PAYLOAD = tuple(FINDING_RECORD_COLUMNS.values())
FOLDED = "rule_seq int, key_text string, sec bigint, counted bigint, held int, rows string"
OUTPUT = ("rule_seq int, key_text string, event_count bigint, timestamp string, src_ip string, method string, "
          "uri_path string, uri_query string, status_code bigint, user_agent string, referer string, host string, "
          "log_file string, line_number bigint, raw_line string")
#: Load only: seconds of keys that are read and written together, of the running windows and of what waits; groups that the keys
#: of a rule are dealt to (kept in the state: a stream goes on only with the number it began with).
WINDOW_CHUNK, WAITING_CHUNK, BUCKETS = 1000, 1000, 512

# A row in the state: [log_file, line_number, role, payload]; counted rows of a sequence carry no payload.
Limits = dict[int, tuple[int, int, int, bool]]


def _in_order(rows: list[list], need: int, sequence: bool) -> list[list]:
    """Rows of one second in file order; a threshold can only fire at one of its first `need` rows."""
    rows.sort(key=lambda r: (r[0] or "", r[1] or 0))
    return rows if sequence else rows[:need]


def fold_rows(limits: Limits) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """One row per (rule, key, second) of each batch of rows, with the number of counted rows and the rows that can fire."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            groups: dict[tuple, list] = {}
            columns = [batch[c].astype(object).where(batch[c].notna(), None).tolist() for c in ("rule_seq", "key_text", "sec", "role", *PAYLOAD)]
            for rule_seq, key_text, sec, role, *payload in zip(*columns):
                group = groups.setdefault((rule_seq, key_text, sec), [0, []])
                group[0] += role == COUNTED
                place = [payload[PAYLOAD.index("log_file")], payload[PAYLOAD.index("line_number")]]
                group[1].append([*place, role, None if limits[rule_seq][3] and role == COUNTED else payload])
            kept = [(key, counted, _in_order(rows, limits[key[0]][0], limits[key[0]][3])) for key, (counted, rows) in groups.items()]
            yield pd.DataFrame([(*key, counted, len(rows), json.dumps(rows)) for key, counted, rows in kept],
                               columns=[c.split()[0] for c in FOLDED.split(", ")])

    return run


class RunningWindow:
    """Counts of the seconds in the windows of the keys of a bucket, oldest first, in chunks of a map state.

    Only the oldest and the newest chunk are held; `totals` has the sum of every key that has one.
    """

    def __init__(self, chunks, oldest: int, start: int, newest: int, totals: dict[str, int]):
        self.chunks, self.oldest, self.start, self.newest, self.totals = chunks, oldest, start, newest, totals
        self.changed = False
        self.last = self._read(newest)
        self.first = self.last if oldest == newest else self._read(oldest)

    def _read(self, number: int) -> list[list]:
        held = self.chunks.getValue((number,))
        return json.loads(held[0]) if held else []

    def forget(self, before: int) -> None:
        """Drop the seconds before a time."""
        while True:
            while self.start < len(self.first) and self.first[self.start][0] < before:
                _, count, key_text = self.first[self.start]
                self.totals[key_text] -= count
                if not self.totals[key_text]:
                    del self.totals[key_text]
                self.start += 1
            if self.start < len(self.first) or self.oldest == self.newest:
                return
            self.chunks.removeKey((self.oldest,))
            self.oldest, self.start = self.oldest + 1, 0
            self.first = self.last if self.oldest == self.newest else self._read(self.oldest)

    def add(self, sec: int, count: int, key_text: str) -> None:
        if len(self.last) >= WINDOW_CHUNK:
            self.write()
            self.last, self.newest = [], self.newest + 1
        self.last.append([sec, count, key_text])
        self.totals[key_text] = self.totals.get(key_text, 0) + count
        self.changed = True

    def write(self) -> None:
        if self.changed:
            self.chunks.updateValue((self.newest,), (json.dumps(self.last),))
            self.changed = False

    def newest_second(self) -> int | None:
        return self.last[-1][0] if self.last and (self.oldest < self.newest or self.start < len(self.last)) else None


class SlidingCount(StatefulProcessor):
    """State of one rule and bucket of keys: what waits for the watermark, in chunks by time; the counts of the running
    windows; the keys with the time before which they do not fire again; and one row with the bounds of the window, the chunks
    that wait (their number, first and last second), and the timer.

    ``limits`` maps rule_seq to (bound, window seconds back, pause seconds, is sequence). Rows of seconds that the
    watermark has passed are late and dropped. A bucket without work keeps a timer that removes its state.
    """

    def __init__(self, limits: Limits):
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "chunk bigint", "body string")
        self.rows = handle.getMapState("rows", "chunk bigint", "body string")
        self.window = handle.getMapState("window", "chunk bigint", "body string")
        self.keys = handle.getMapState("keys", "part bigint", "body string")
        self.bounds = handle.getValueState("bounds", "oldest bigint, start bigint, newest bigint, unused bigint, chunks string, timer bigint")

    def _bounds(self) -> list:
        """Oldest chunk, start in it and newest chunk of the window; a number no chunk had yet; chunks that wait; timer."""
        held = list(self.bounds.get()) if self.bounds.exists() else [0, 0, 0, 0, "[]", None]
        held[4] = json.loads(held[4])
        return held

    def _keep(self, bounds: list, wake: int | None) -> None:
        """Store the bounds with one timer at the given time."""
        if wake != bounds[5]:
            if bounds[5] is not None:
                self.handle.deleteTimer(bounds[5])
            self.handle.registerTimer(wake)
        self.bounds.update((*bounds[:4], json.dumps(bounds[4]), wake))

    def _wait(self, bounds: list, entries: list[tuple]) -> None:
        """Put (second, key, counted rows, rows held, their text) into new chunks, by time."""
        entries.sort(key=itemgetter(0, 1))
        for at in range(0, len(entries), WAITING_CHUNK):
            chunk = entries[at : at + WAITING_CHUNK]
            self.waiting.updateValue((bounds[3],), (json.dumps([e[:4] for e in chunk]),))
            self.rows.updateValue((bounds[3],), ("[" + ",".join(e[4][1:-1] for e in chunk if e[3]) + "]",))
            bounds[4].append([bounds[3], chunk[0][0], chunk[-1][0]])
            bounds[3] += 1

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        bounds, first = None, None
        for frame in rows:
            entries = [e for e in zip(*(frame[c].tolist() for c in ("sec", "key_text", "counted", "held", "rows"))) if e[0] * 1000 > passed]
            if entries:
                bounds = bounds or self._bounds()
                self._wait(bounds, entries)
                first = min(entries[0][0] * 1000, entries[0][0] * 1000 if first is None else first)
        if bounds:
            # an earlier timer stands for waiting seconds, or for a removal that finds these waiting
            self._keep(bounds, first if bounds[5] is None else min(first, bounds[5]))
        yield pd.DataFrame()

    def _due(self, bounds: list, passed: int) -> tuple[list[tuple], Callable[[int], list]]:
        """What the watermark has passed, by second and key: (second, key, counted rows, chunk, place of its rows, rows held);
        and the rows of those chunks. What the watermark has not passed in them goes to new chunks."""

        @lru_cache(maxsize=16)
        def body(chunk: int) -> list:
            return json.loads(self.rows.getValue((chunk,))[0])

        due, later = [], []
        reached = [c for c in bounds[4] if c[1] * 1000 <= passed]
        bounds[4] = [c for c in bounds[4] if c[1] * 1000 > passed]
        for chunk, _, _ in reached:
            entries = json.loads(self.waiting.getValue((chunk,))[0])
            for (sec, key_text, counted, held), end in zip(entries, accumulate(e[3] for e in entries)):
                if sec * 1000 <= passed:
                    due.append((sec, key_text, counted, chunk, end - held, held))
                else:
                    later.append((sec, key_text, counted, held, json.dumps(body(chunk)[end - held : end])))
            self.waiting.removeKey((chunk,))
        self._wait(bounds, later)
        due.sort(key=itemgetter(0, 1))
        return due, body

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        need, back, pause, sequence = self.limits[int(key[0])]
        passed = timerValues.getCurrentWatermarkInMs()
        bounds = self._bounds()
        bounds[5] = None  # it has just expired
        known = self.keys.getValue((0,))
        totals, quiet_until = json.loads(known[0]) if known else ({}, {})
        window = RunningWindow(self.window, *bounds[:3], totals)
        due, body = self._due(bounds, passed)
        fired = []
        for (sec, key_text), parts in groupby(due, key=itemgetter(0, 1)):
            parts = list(parts)
            counted = sum(p[2] for p in parts)
            window.forget(sec - back)
            total = totals.get(key_text, 0)
            if total + counted >= need and (counted or sequence) and sec >= quiet_until.get(key_text, sec):
                rows = [r for *_, chunk, at, held in parts for r in body(chunk)[at : at + held]]
                so_far = 0
                for _, _, role, payload in _in_order(rows, need, sequence):
                    so_far += role == COUNTED
                    if role == (FOLLOW_UP if sequence else COUNTED) and total + so_far >= need:
                        fired.append((int(key[0]), key_text, total + so_far, *payload))
                        quiet_until[key_text] = sec + pause
                        break
            if counted:
                window.add(sec, counted, key_text)
        for chunk in {p[3] for p in due}:
            self.rows.removeKey((chunk,))
        # Only what a later row can still see stays.
        window.forget(passed // 1000 - back)
        quiet_until = {k: until for k, until in quiet_until.items() if until * 1000 > passed}
        newest = window.newest_second()
        wake = min((first for _, first, _ in bounds[4]), default=None)
        if wake is None and newest is not None:
            wake = newest + back + 1
        if wake is None:
            wake = max(quiet_until.values(), default=None)
        if newest is None:
            self.window.clear()
            window.oldest = window.start = window.newest = 0
        else:
            window.write()
        if totals or quiet_until:
            self.keys.updateValue((0,), (json.dumps([totals, quiet_until]),))
        elif known:
            self.keys.removeKey((0,))
        if wake is None:
            self.bounds.clear()
        else:
            self._keep([window.oldest, window.start, window.newest, *bounds[3:5], None], wake * 1000)
        yield pd.DataFrame(fired, columns=[c.split()[0] for c in OUTPUT.split(", ")]) if fired else pd.DataFrame()

    def close(self) -> None:
        pass


def windowed_stream(records: DataFrame, rules: Sequence[Rule], lateness: str, min_level: str = "low") -> DataFrame:
    """Findings of threshold and sequence rules on a stream of records (append mode).

    The watermark follows all records, also those that no rule counts. Needs the RocksDB state store. Rarity rules
    are only defined at the end of input and are left to the batch run.
    """
    rules = list(rules)
    active = [r for r in keyed_rules(rules, min_level) if r.grouping.kind != "rarity"]
    limits = {rules.index(r): (r.grouping.at_least, floor(r.grouping.window_minutes * 60),
                               ceil(r.grouping.window_minutes * 60), r.grouping.kind == "sequence") for r in active}
    timed = records.withColumn("event_time", F.timestamp_seconds(F.unix_seconds("timestamp"))) \
        .withWatermark("event_time", lateness)
    marks = mark_rows(timed, rules, active, record_columns(records)).withColumn("key_text", F.to_json("key"))
    folded = marks.select("rule_seq", "key_text", "sec", "role", *PAYLOAD).mapInPandas(fold_rows(limits), FOLDED)
    bucket = F.pmod(F.xxhash64("key_text"), F.lit(BUCKETS)).alias("bucket")
    fired = folded.select("*", bucket).groupBy("rule_seq", "bucket").transformWithStateInPandas(SlidingCount(limits), OUTPUT, "append", "eventtime")
    keyed = fired.withColumn("key", F.from_json("key_text", "array<string>")).drop("key_text")
    return _keyed_findings(keyed, rules, WINDOW_PHASE)


def running_severities(findings: DataFrame) -> DataFrame:
    """Findings per level on a stream of findings, for the complete mode: all levels, most severe first."""
    totals = findings.agg(*[F.count(F.when(F.col("level") == level, 1)).alias(level) for level in LEVELS])
    rows = F.array(*[F.struct(F.lit(rank).alias("rank"), F.lit(level).alias("level"), F.col(level).alias("findings")) for rank, level in enumerate(reversed(LEVELS))])
    return totals.select(F.explode(rows).alias("row")).select("row.*").orderBy("rank").drop("rank")


def running_rule_hits(findings: DataFrame, limit: int | None = None) -> DataFrame:
    """Findings per rule on a stream of findings, most frequent first, for the complete mode; only the first `limit` if given."""
    hits = findings.groupBy("rule_id", "rule_title", "level").agg(F.count(F.lit(1)).alias("hits")).orderBy(F.desc("hits"), "rule_id")
    return hits.limit(limit) if limit else hits


def running_top(frame: DataFrame, field: str, limit: int = TOP_LIMIT) -> DataFrame:
    """Most frequent values of a column of a stream, ties by value text, for the complete mode."""
    return running_counts(frame, field).orderBy(F.desc("count"), F.col(field).cast("string")).limit(limit)


def running_counts(frame: DataFrame, field: str) -> DataFrame:
    """Running number of rows per value of a column, for the complete or update mode: top-N of a
    stream of records, or findings per level or rule of a stream of findings."""
    return frame.where(F.col(field).isNotNull()).groupBy(field).agg(F.count(F.lit(1)).alias("count"))
