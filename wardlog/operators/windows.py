"""Keyed detections: threshold and sequence over sliding windows with a cool-down, and rarity.

All threshold and sequence rules run together: one pass marks the rows each rule counts, rows are
pre-aggregated to (rule, key, second), and a range window over the seconds gives the sliding
counts. Time slots with a look-back margin split every key, so a hot key is neither one task nor
one group. Only seconds that reach a bound go on to the cool-down, which works slot by slot as well, and
only seconds that fire are looked up in the records again.

Order is event time, then log file and line. Counts cover the closed interval [t - window, t].
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import partial, reduce
from math import ceil, floor, lcm

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlog.lineage import settle, sized
from wardlog.operators.predicates import selection_holds, staged_probe, text_of
from wardlog.operators.rules import Rule, keyed_rules
from wardlog.operators.scan import RARITY_PHASE, WINDOW_PHASE, as_findings, record_columns
from wardlog.schema import FINDING_RECORD_COLUMNS

COUNTED, FOLLOW_UP = 1, 2  # what a row is to a rule
SLOT_SECONDS = 6 * 3600  # least length of a time slot
MAX_COMMON_WINDOW = 10**12  # bound on the common multiple of windows handled in one range window
# Load only: a second with more rows is searched by blocks of so many lines; a key with more reaching seconds by time slots.
BLOCK_LINES, KEY_SECONDS = 4096, 100_000
# Load only: seconds and keys grow with the records, and a query joins several such tables; the driver and every executor hold
# some times as much for each one that is broadcast.
SENT_BYTES = 16 << 20

GROUP = ["rule_seq", "key"]
SECOND = [*GROUP, "sec"]


def _sized(settled: DataFrame) -> DataFrame:
    return sized(settled, SENT_BYTES)


def _role(rule: Rule, probe) -> Column:
    counted = selection_holds(rule.grouping.where, probe)
    if rule.grouping.followed_by is None:
        return F.when(counted, F.lit(COUNTED))
    # A row that is both counts as follow-up only.
    return F.when(selection_holds(rule.grouping.followed_by, probe), F.lit(FOLLOW_UP)).when(counted, F.lit(COUNTED))


def mark_rows(records: DataFrame, rules: Sequence[Rule], active: Sequence[Rule], carry: Iterable[Column]) -> DataFrame:
    """One row per (record, rule that uses it): rule_seq, key, role, sec and the carried columns.

    Records without timestamp are dropped, and keys with a missing part.
    """
    tests = [t for r in active for t in (*r.grouping.where, *(r.grouping.followed_by or ()))]
    staged, probe = staged_probe(records.where(F.col("timestamp").isNotNull()), tests)
    marks = []
    for rule in active:
        parts = [text_of(records, name) for name in rule.grouping.keys]
        usable = reduce(Column.__and__, [p.isNotNull() for p in parts])
        marks.append(F.when(usable & _role(rule, probe).isNotNull(), F.struct(
            F.lit(rules.index(rule)).alias("rule_seq"), F.array(*parts).alias("key"),
            _role(rule, probe).alias("role"))))
    return (staged.withColumn("mark", F.explode(F.array_compact(F.array(*marks))))
            .select("mark.*", F.unix_seconds("timestamp").alias("sec"), *carry))


def _parameters(records: DataFrame, rules: Sequence[Rule], active: Sequence[Rule], common: int) -> DataFrame:
    """Per rule: bound, window lengths in whole seconds, slot length, and the factor that maps
    the rule's window to the common range of the window frame."""
    rows = []
    for rule in active:
        seconds = rule.grouping.window_minutes * 60
        back = floor(seconds)
        rows.append({"rule_seq": rules.index(rule), "need": rule.grouping.at_least, "back": back,
                     "pause": ceil(seconds), "slot": max(back, SLOT_SECONDS),
                     "unit": common // back if back else common + 1,
                     "sequence": rule.grouping.kind == "sequence"})
    return F.broadcast(records.sparkSession.createDataFrame(pa.Table.from_pylist(rows, schema=pa.schema(
        [("rule_seq", pa.int32())] + [(c, pa.int64()) for c in ("need", "back", "pause", "slot", "unit")]
        + [("sequence", pa.bool_())]))))


def _window_batches(active: Sequence[Rule]) -> list[tuple[list[Rule], int]]:
    """Rules that can share one window frame, with the common multiple of their windows."""
    batches: list[tuple[list[Rule], int]] = []
    for rule in active:
        back = max(1, floor(rule.grouping.window_minutes * 60))
        for i, (members, common) in enumerate(batches):
            if lcm(common, back) <= MAX_COMMON_WINDOW:
                batches[i] = ([*members, rule], lcm(common, back))
                break
        else:
            batches.append(([rule], back))
    return batches


def _reaching_seconds(marks: DataFrame, parameters: DataFrame, common: int) -> DataFrame:
    """Seconds in which a rule's count reaches its bound, with the count before that second."""
    per_second = marks.groupBy(*SECOND).agg(
        F.count(F.when(F.col("role") == COUNTED, 1)).alias("n"),
        F.count(F.when(F.col("role") == FOLLOW_UP, 1)).alias("follow_ups"))
    slot = F.floor(F.col("sec") / F.col("slot"))
    placed = (per_second.join(parameters, "rule_seq")
              .withColumn("home", slot)
              .withColumn("in_slot", F.explode(
                  F.when(F.col("sec") >= (F.col("home") + 1) * F.col("slot") - F.col("back"),
                         F.array("home", F.col("home") + 1)).otherwise(F.array("home"))))
              .withColumn("at", (F.col("sec") - F.col("in_slot") * F.col("slot") + F.col("back")) * F.col("unit")))
    in_time = Window.partitionBy(*GROUP, "in_slot").orderBy("at")

    def counted_until(offset: int) -> Column:
        # A frame that only grows costs one step per row; a sliding one is summed anew for every row.
        return F.coalesce(F.sum("n").over(in_time.rangeBetween(Window.unboundedPreceding, offset)), F.lit(0))

    return (placed.withColumn("prior", counted_until(-1) - counted_until(-common - 1))
            .where((F.col("in_slot") == F.col("home")) & (F.col("prior") + F.col("n") >= F.col("need"))
                   & F.when(F.col("sequence"), F.col("follow_ups") > 0).otherwise(F.col("n") > 0))
            .select(*SECOND, "prior", "need", "pause", "sequence", "home", "slot", (F.col("n") + F.col("follow_ups")).alias("rows_here")))


def _fires(role: Column, so_far: Column) -> Column:
    """Whether a row of a reaching second can be the firing one."""
    reached = F.col("prior") + so_far
    return (F.when(F.col("sequence"), (role == FOLLOW_UP) & (reached >= F.col("need")))
            .otherwise((role == COUNTED) & (reached >= F.col("need"))))


def _firing_blocks(positions: DataFrame, crowded: DataFrame, block_lines: int) -> DataFrame:
    """Where in crowded seconds the first firing row is: one block of lines of a file, for a sequence one of two.

    Blocks are counted by hash aggregation; only their counts, a row a block, are ordered within a second.
    """
    per_block = (positions.join(_sized(crowded), SECOND)
                 .groupBy(*SECOND, "log_file", F.floor(F.col("line_number") / block_lines).alias("block"))
                 .agg(F.count(F.when(F.col("role") == COUNTED, 1)).alias("n"), F.count(F.when(F.col("role") == FOLLOW_UP, 1)).alias("follow_ups"),
                      *[F.first(c).alias(c) for c in ("prior", "need", "sequence")]))
    in_second = Window.partitionBy(*SECOND).orderBy("log_file", "block")
    before = F.coalesce(F.sum("n").over(in_second.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    reached = F.col("prior") + F.col("before") + F.col("n") >= F.col("need")
    # The bound is reached inside the first such block; a follow-up in it may still come too early, then the next one fires.
    return (per_block.withColumn("before", before).where(reached & F.when(F.col("sequence"), F.col("follow_ups") > 0).otherwise(F.col("n") > 0))
            .withColumn("nth", F.row_number().over(in_second)).where(F.col("nth") <= F.when(F.col("sequence"), 2).otherwise(1))
            .select(*SECOND, "log_file", "block", "prior", "need", "sequence", "before"))


def first_firing(marks: Callable[[Sequence[Column]], DataFrame], seconds: DataFrame, carry: Sequence[Column], block_lines: int) -> DataFrame:
    """The first firing row of every second that has one: role, the second, event_count and the carried columns.

    ``marks`` gives the rows of the rules with the columns it is asked for, log_file and line_number among ``carry``; ``seconds``
    (settled) has prior, need, sequence and rows_here. A second with more than `block_lines` rows is never one group: its
    rows are counted by blocks of lines, and only the block that holds the row is looked at row by row.
    """
    wanted = [*SECOND, "prior", "need", "sequence"]

    def first_of(rows: DataFrame, group: Sequence[str], before: Column) -> DataFrame:
        ordered = Window.partitionBy(*group).orderBy("log_file", "line_number")
        return (rows.withColumn("so_far", before + F.count(F.when(F.col("role") == COUNTED, 1)).over(ordered))
                .where(_fires(F.col("role"), F.col("so_far")))
                .withColumn("nth", F.row_number().over(ordered)).where("nth = 1")
                .withColumn("event_count", F.col("prior") + F.col("so_far"))
                .drop("nth", "so_far", "prior", "need", "sequence"))

    usual = first_of(marks(carry).join(_sized(seconds.where(F.col("rows_here") <= block_lines).select(*wanted)), SECOND), SECOND, F.lit(0))
    crowded = seconds.where(F.col("rows_here") > block_lines).select(*wanted)
    if crowded.isEmpty():
        return usual
    blocks = settle(_firing_blocks(marks([F.col("log_file"), F.col("line_number")]), crowded, block_lines))
    block = F.floor(F.col("line_number") / block_lines)
    found = first_of(marks(carry).withColumn("block", block).join(_sized(blocks), [*SECOND, "log_file", "block"]), [*SECOND, "log_file", "block"], F.col("before"))
    two = Window.partitionBy(*SECOND).orderBy("log_file", "line_number")  # a row of each of at most two blocks
    return usual.unionByName(found.withColumn("nth", F.row_number().over(two)).where("nth = 1").drop("nth", "block", "before"))


def _settle_order(reaching: DataFrame, marks: Callable[[Sequence[Column]], DataFrame], block_lines: int) -> DataFrame:
    """Drop seconds of a sequence whose follow-ups all come before the count is reached.

    Only seconds that cross the bound inside themselves are looked at row by row.
    """
    reaching = settle(reaching)
    crossing = F.col("sequence") & (F.col("prior") < F.col("need"))
    undecided = reaching.where(crossing)
    if undecided.isEmpty():
        return reaching
    confirmed = first_firing(marks, undecided, [F.col("log_file"), F.col("line_number")], block_lines).select(*SECOND)
    return reaching.where(~crossing).unionByName(undecided.join(confirmed, SECOND, "left_semi"))


def _whole_slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Input sorted by slot name and second, in frames that never split a slot."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        frame = pd.concat([*held, batch], ignore_index=True)
        if frame.empty:
            continue
        still_open = frame["slot_name"] == frame["slot_name"].iloc[-1]
        if not still_open.all():
            yield frame[~still_open]
        held = [frame[still_open]]
    if held:
        yield held[0]


def _next_fires(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Slot number of every row, and the row that fires after it in its slot (itself if none does)."""
    names = frame["slot_name"].to_numpy()
    slot = np.cumsum(np.concatenate(([False], names[1:] != names[:-1])))
    sec, pause = frame["sec"].to_numpy() - frame["sec"].min(), frame["pause"].to_numpy()
    place = slot * (sec.max() + pause.max() + 1) + sec
    after = np.minimum(np.searchsorted(place, place + pause), len(place) - 1)
    inside = (slot[after] == slot) & (place[after] >= place + pause)
    return slot, np.where(inside, after, np.arange(len(place)))


def _slot_outcomes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per slot: every second that can be its first fire, and the last fire that follows from it."""
    for frame in _whole_slots(batches):
        slot, last = _next_fires(frame)
        while (last[last] != last).any():
            last = last[last]
        sec = frame["sec"].to_numpy()
        opens = np.concatenate(([True], slot[1:] != slot[:-1]))
        # a fire before the slot blocks less than one pause of it
        blocked = (frame["home"] * frame["slot"] + frame["pause"]).to_numpy()
        first = np.flatnonzero(opens | (np.concatenate(([0], sec[:-1])) < blocked))
        cuts = np.flatnonzero(np.diff(slot[first])) + 1
        yield frame.loc[opens, ["rule_seq", "key", "home", "pause", "slot_name"]].assign(
            firsts=np.split(sec[first], cuts), lasts=np.split(sec[last[first]], cuts))


def _chain_slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The first fire of every slot that has one. Input is sorted by rule, key and slot; state is one group and one time."""
    group, free_at = None, 0
    for batch in batches:
        entries, fired = [], []
        for rule_seq, key, pause, firsts, lasts in zip(*(batch[c] for c in ("rule_seq", "key", "pause", "firsts", "lasts"))):
            here = (rule_seq, *key)
            at = int(np.searchsorted(firsts, free_at)) if here == group else 0
            fired.append(at < len(firsts))
            if fired[-1]:
                group, free_at = here, int(lasts[at]) + pause
                entries.append(int(firsts[at]))
        yield batch.loc[fired, ["slot_name"]].assign(entry=pd.Series(entries, dtype="int64").to_numpy())


def _fill_slots(columns: list[str]):
    """Rows of a slot that fire, given its first fire."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _whole_slots(batches):
            _, onward = _next_fires(frame)
            fires = np.zeros(len(frame), bool)
            now = np.flatnonzero((frame["sec"] == frame["entry"]).to_numpy())
            while now.size:
                fires[now] = True
                now = onward[now][onward[now] != now]
            yield frame.loc[fires, columns]
    return run


def _fill_keys(columns: list[str]):
    """Rows of whole keys that fire: the first of a key, and from each the next one that may."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _whole_slots(batches):
            key, onward = _next_fires(frame)
            fires = np.zeros(len(frame), bool)
            now = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            while now.size:
                fires[now] = True
                now = onward[now][onward[now] != now]
            yield frame.loc[fires, columns]
    return run


def firing_seconds(reaching: DataFrame, key_seconds: int) -> DataFrame:
    """At most one second per key and window: a second fires if the key's last fire is at least the pause away.

    A key with at most `key_seconds` reaching seconds is worked through at once. Others, which reach their bound nearly all the time,
    are cut into time slots and worked on in many tasks: every slot works out, for each second that can be its first
    fire, the last one; only one row per slot is chained along a key.
    """
    columns = [*SECOND, "prior", "need", "pause", "sequence", "rows_here"]
    reaching = settle(reaching)
    key_name = F.to_json(F.struct(*GROUP))
    busy = settle(reaching.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("seconds")).where(F.col("seconds") > key_seconds).select(*GROUP))
    shape = reaching.select(*columns).schema

    def in_slots(frame: DataFrame) -> DataFrame:
        return frame.repartition("slot_name").sortWithinPartitions("slot_name", "sec")

    if busy.isEmpty():
        return in_slots(reaching.withColumn("slot_name", key_name)).mapInPandas(_fill_keys(columns), shape)
    usual = in_slots(reaching.join(_sized(busy), GROUP, "left_anti").withColumn("slot_name", key_name)).mapInPandas(_fill_keys(columns), shape)
    named = settle(reaching.join(_sized(busy), GROUP, "left_semi").withColumn("slot_name", F.to_json(F.struct(*GROUP, "home"))))
    outcomes = in_slots(named.select(*SECOND, "home", "slot", "pause", "slot_name")).mapInPandas(
        _slot_outcomes, "rule_seq int, key array<string>, home bigint, pause bigint, slot_name string, "
                        "firsts array<bigint>, lasts array<bigint>")
    entries = outcomes.repartition(*GROUP).sortWithinPartitions(*GROUP, "home").mapInPandas(_chain_slots, "slot_name string, entry bigint")
    filled = in_slots(named.join(_sized(settle(entries)), "slot_name")).mapInPandas(_fill_slots(columns), shape)
    return usual.unionByName(filled)


def windowed(records: DataFrame, rules: Sequence[Rule], active: Sequence[Rule]) -> DataFrame:
    """Findings of threshold and sequence rules; the finding shows the row that fired."""
    results = []
    for members, common in _window_batches(active):
        parameters = _parameters(records, rules, members, common)
        reaching = _reaching_seconds(mark_rows(records, rules, members, []), parameters, common)
        sequences = [r for r in members if r.grouping.kind == "sequence"]
        if sequences:
            reaching = _settle_order(reaching, partial(mark_rows, records, rules, sequences), BLOCK_LINES)
        fired = settle(firing_seconds(reaching, KEY_SECONDS))
        rows = first_firing(partial(mark_rows, records, rules, members), fired, record_columns(records), BLOCK_LINES)
        results.append(rows.select("rule_seq", "key", "event_count", *FINDING_RECORD_COLUMNS.values()))
    return _keyed_findings(reduce(DataFrame.unionByName, results), rules, WINDOW_PHASE)


def rare(records: DataFrame, rules: Sequence[Rule], active: Sequence[Rule]) -> DataFrame:
    """Findings of rarity rules: keys seen at most n times in the whole input, shown by their first
    row. The window of such a rule has no effect.

    Keys are counted without any payload; only rows of the keys within the bound are looked up again.
    """
    bounds = records.sparkSession.createDataFrame(pa.Table.from_pylist(
        [{"rule_seq": rules.index(r), "at_most": r.grouping.at_most} for r in active],
        schema=pa.schema([("rule_seq", pa.int32()), ("at_most", pa.int64())])))
    counted = mark_rows(records, rules, active, []).groupBy(*GROUP).agg(F.count(F.lit(1)).alias("event_count"))
    few = _sized(settle(counted.join(F.broadcast(bounds), "rule_seq").where("event_count <= at_most").drop("at_most")))
    in_key = Window.partitionBy(*GROUP).orderBy("log_file", "line_number")
    first = (mark_rows(records, rules, active, record_columns(records)).join(few, GROUP)
             .withColumn("nth", F.row_number().over(in_key)).where("nth = 1"))
    return _keyed_findings(first.select("rule_seq", "key", "event_count", *FINDING_RECORD_COLUMNS.values()), rules, RARITY_PHASE)


def _keyed_findings(matches: DataFrame, rules: Sequence[Rule], phase: int) -> DataFrame:
    keys = matches.sparkSession.createDataFrame(pa.Table.from_pylist(
        [{"rule_seq": i, "matched_fields": [*r.grouping.keys, "event_count"]}
         for i, r in enumerate(rules) if r.grouping is not None],
        schema=pa.schema([("rule_seq", pa.int32()), ("matched_fields", pa.list_(pa.string()))])))
    return as_findings(
        matches.join(F.broadcast(keys), "rule_seq").withColumn(
            "matched_values", F.concat("key", F.array(F.col("event_count").cast("string")))),
        rules, phase)


def detect_keyed(records: DataFrame, rules: Sequence[Rule], min_level: str = "low") -> DataFrame | None:
    """Findings of all keyed rules at or above a level; None when there is no such rule."""
    rules = list(rules)
    active = keyed_rules(rules, min_level)
    parts = []
    sliding = [r for r in active if r.grouping.kind != "rarity"]
    if sliding:
        parts.append(windowed(records, rules, sliding))
    rarities = [r for r in active if r.grouping.kind == "rarity"]
    if rarities:
        parts.append(rare(records, rules, rarities))
    return reduce(DataFrame.unionByName, parts) if parts else None
