"""SimHash near-duplicates: fingerprints, exact links within a Hamming radius, and the components they form.

Links are found with a hierarchical index in Gray order. Distinct fingerprints meet where two of four 16-bit blocks agree
(any two fingerprints at 2 or fewer differing bits share at least two blocks); a key that gathers more than HOT of them is
dealt out again by a third of the remaining 32 bits, so that a group holds at most 2**22 fingerprints whatever the data. A
group is sorted by Gray rank; runs of neighbours become nodes, the bits on which a node agrees are factored into its parent,
and a search carries the differences accumulated on the way down and drops whole nodes once they exceed the radius.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardlog.lineage import settle, sized
from wardlog.llm.common import LOWER, map_slices, slices, utf8

SHINGLE = 3
RADIUS = 2
#: A block key with more distinct fingerprints than this is dealt out a second time.
HOT = 4096
#: Children per node of the index, and queries that go down the tree together.
FAN, QUERIES = 8, 8192
#: Comparisons of one portion of queries at most, where classes are joined on the way.
MEETS = 1 << 19
#: Ids are smaller than this number.
NAMELESS = 1 << 62
PIECE = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash; a bit is 1 if it is set in over half of the shingle hashes. Zero without words."""
    words = utf8(text).translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = min(shingle, len(words))
    hashed = xxhash.xxh64_intdigest
    hashes = [hashed(joined[a:b], 42) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)]
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), PIECE):
        part = np.array(hashes[k : k + PIECE], "<u8").view(np.uint8).reshape(-1, 8)
        counts += np.add.reduce(np.unpackbits(part, axis=1, bitorder="little"), axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def gray_rank(values: np.ndarray) -> np.ndarray:
    """Position of each value in the Gray code."""
    rank = values.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    return rank


class GrayIndex:
    """Hierarchical index over fingerprints sorted by (group, Gray rank); nodes never span two groups."""

    def __init__(self, groups: np.ndarray, values: np.ndarray):
        self.values = values
        edges = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1])))
        every = np.uint64(0xFFFFFFFFFFFFFFFF)
        #: Levels from the items up: first child and one past the last, pattern, mask, last item.
        low, high, last = values.copy(), values.copy(), np.arange(len(values))
        sizes = np.diff(np.concatenate((edges, [len(values)])))
        levels = [{"pattern": values, "mask": np.full(len(values), every), "last": last}]
        while sizes.max(initial=1) > 1:
            firsts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            count = -(-sizes // FAN)
            base = np.repeat(firsts, count)
            step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            begin = base + step * FAN
            stop = np.concatenate((begin[1:], [len(low)]))
            low, high = np.bitwise_and.reduceat(low, begin), np.bitwise_or.reduceat(high, begin)
            last = last[stop - 1]
            levels.append({"begin": begin, "stop": stop, "pattern": low, "mask": ~(low ^ high), "last": last})
            sizes = count
        for child, parent in zip(levels, levels[1:], strict=False):
            shared = np.repeat(parent["mask"], parent["stop"] - parent["begin"])
            child["own"] = child["mask"] & ~shared
        levels[-1]["own"] = levels[-1]["mask"]
        self.levels = levels
        self.root = np.repeat(np.arange(len(edges)), np.diff(np.concatenate((edges, [len(values)]))))

    def search(self, query: np.ndarray, radius: int, label: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (i < j) of one group within the radius, i from `query`; with labels, nodes wholly in the class of i are dropped."""
        ranges = self.label_ranges(label) if label is not None else [None] * len(self.levels)

        def kept(query, node, differ, level, span):
            keep = (differ <= radius) & (level["last"][node] > query)
            if span is not None:
                keep &= (span[0][node] != span[1][node]) | (span[0][node] != label[query])
            return query[keep], node[keep], differ[keep]

        top = self.levels[-1]
        node = self.root[query]
        differ = np.bitwise_count((self.values[query] ^ top["pattern"][node]) & top["own"][node]).astype(np.int64)
        query, node, differ = kept(query, node, differ, top, ranges[-1])
        for parent, child, span in zip(self.levels[:0:-1], self.levels[-2::-1], ranges[-2::-1], strict=True):
            width = parent["stop"][node] - parent["begin"][node]
            fresh = np.repeat(parent["begin"][node] - (np.cumsum(width) - width), width) + np.arange(width.sum())
            query, differ = np.repeat(query, width), np.repeat(differ, width)
            differ = differ + np.bitwise_count((self.values[query] ^ child["pattern"][fresh]) & child["own"][fresh])
            query, node, differ = kept(query, fresh, differ, child, span)
        return (query, node) if len(self.levels) > 1 else (query[:0], node[:0])

    def label_ranges(self, label: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Smallest and greatest label below every node, by level."""
        low = high = label
        ranges = [(low, high)]
        for level in self.levels[1:]:
            low, high = np.minimum.reduceat(low, level["begin"]), np.maximum.reduceat(high, level["begin"])
            ranges.append((low, high))
        return ranges

    def pairs(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs (i < j) of one group within the radius, in portions."""
        for start in range(0, len(self.values), QUERIES):
            query, node = self.search(np.arange(start, min(start + QUERIES, len(self.values))), radius)
            if query.size:
                yield query, node

    def classes(self, radius: int, linked: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        """Label of every value (smallest index of its class) over pairs within the radius that `linked` confirms.

        Portions of queries are bounded by the members they could meet. Members of a class that is already joined are not
        compared with each other again, so that a large group of copies costs about one comparison a member.
        """
        label = np.arange(len(self.values))
        meets = np.cumsum(np.bincount(self.root)[self.root])
        start = 0
        while start < len(label):
            stop = min(len(label), max(start + FAN, int(np.searchsorted(meets, meets[start] + MEETS))))
            left, right = self.search(np.arange(start, stop), radius, label)
            if left.size:
                sure = linked(left, right)
                label = joined(label, left[sure], right[sure])
            start = stop
        return label


def joined(label: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Merge the classes of every pair; a label is the smallest index of its class."""
    while True:
        a, b = label[left], label[right]
        apart = a != b
        if not apart.any():
            return label
        left, right = left[apart], right[apart]
        np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (label[label] != label).any():
            label = label[label]


def links_of(groups: np.ndarray, values: np.ndarray, names: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For every fingerprint with a link in its group but the first of a class: its name and the first one's."""
    order = np.lexsort((gray_rank(values), groups))
    index = GrayIndex(groups[order], values[order])
    label = np.arange(len(order))
    for left, right in index.pairs(radius):
        label = joined(label, left, right)
    moved = np.flatnonzero(label != np.arange(len(order)))
    return names[order[moved]], names[order[label[moved]]]


def _links_in_partition(radius: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        held: list[tuple[np.ndarray, ...]] = []
        rows = 0
        for batch in batches:
            held.append(tuple(batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)))
            rows += batch.num_rows
            if rows >= PIECE:
                key, sub, value, name = (np.concatenate(c) for c in zip(*held, strict=True))
                same = (key == key[-1]) & (sub == sub[-1])
                if not same.all():
                    yield key[~same], sub[~same], value[~same], name[~same]
                    held, rows = [(key[same], sub[same], value[same], name[same])], int(same.sum())
                else:
                    held = [(key, sub, value, name)]
        if rows:
            yield tuple(np.concatenate(c) for c in zip(*held, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, sub, value, name in whole_groups(batches):
            group = np.cumsum(np.concatenate(([0], (key[1:] != key[:-1]) | (sub[1:] != sub[:-1]))))
            a, b = links_of(group, value.view(np.uint64), name, radius)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema)

    return run


def fingerprint_links(prints: DataFrame, hot: int = HOT, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between names of distinct fingerprints (fp, name), enough to join everything within `radius` (at most 2).

    A class of linked fingerprints inside a group gives one row per member, not all pairs.
    """
    if radius > 2:
        raise ValueError("blocks are laid out for a radius of at most 2")
    block = [F.shiftrightunsigned("fp", 16 * k).bitwiseAND(0xFFFF) for k in range(4)]
    pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    # a key: which two blocks agree, their 32 bits; rest: the other 32 bits
    keys = F.array(*[F.struct((F.lit(n << 32) + F.shiftleft(block[i], 16) + block[j]).alias("key"),
                              (F.shiftleft(block[[k for k in range(4) if k not in (i, j)][0]], 16)
                               + block[[k for k in range(4) if k not in (i, j)][1]]).alias("rest"))
                     for n, (i, j) in enumerate(pairs)])
    keyed = prints.select("fp", "name", F.inline(keys))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    shared = keyed.join(sizes, "key")
    # of the remaining 32 bits, cut into 11, 11 and 10, at least one part agrees
    part = [F.shiftrightunsigned("rest", s).bitwiseAND((1 << w) - 1) + (n << 12) for n, (s, w) in enumerate(((0, 11), (11, 11), (22, 10)))]
    subs = F.when(F.col("members") > hot, F.array(*part)).otherwise(F.array(F.lit(-1).cast("bigint")))
    dealt = shared.select("key", "fp", "name", F.explode(subs).alias("sub")).select("key", "sub", "fp", "name")
    return (dealt.repartition("key", "sub").sortWithinPartitions("key", "sub")
            .mapInArrow(_links_in_partition(radius), "a bigint, b bigint"))


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node with a link; the label is the smallest node of its component.

    Every round maps a node to the smallest node of its neighbourhood and contracts the links; the links at least halve in
    nodes each time. All steps are aggregations and joins; nothing is gathered at a hub or in the driver.
    """
    def tidy(frame, a, b):
        return settle(frame.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct())

    links_now = tidy(links, "a", "b")
    labels = None
    while not links_now.isEmpty():
        both = links_now.union(links_now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")))
        if labels is None:
            labels = step
        else:
            onward = step.select(F.col("node").alias("label"), F.col("label").alias("_to"))
            labels = settle(labels.join(onward, "label", "left").select("node", F.coalesce("_to", "label").alias("label")))
        links_now = (links_now.join(step.select(F.col("node").alias("a"), F.col("label").alias("_a")), "a")
                     .join(step.select(F.col("node").alias("b"), F.col("label").alias("_b")), "b"))
        links_now = tidy(links_now, "_a", "_b")
    if labels is None:
        return links.sparkSession.createDataFrame([], "node bigint, label bigint")
    return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, hot: int = HOT) -> DataFrame:
    """One row per document: id, fp (long), component_id (smallest id reachable over links of 2 or fewer differing bits).

    The id is an integer column of values below 2**62. Null and empty texts have fingerprint zero, linked like any other. Repeated rows each get
    their row. Rows without id get a fingerprint and the component of the rows that share it or are linked to it; null if no
    row with an id is. Other columns are not read.
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias(id_col), F.col(text_col).cast("string").alias("_text"))
    arrow = pa.schema([(id_col, pa.int64()), ("fp", pa.int64())])

    def run(piece: pa.RecordBatch) -> list:
        values = np.array([fingerprint(t, shingle) for t in piece.column(1).to_pylist()], np.uint64)
        return [piece.column(0).to_pylist(), values.view(np.int64).tolist()]

    printed = settle(map_slices(texts, run, f"`{id_col}` bigint, fp bigint", arrow))
    # A print without any id is linked under a name above all ids; two that share such a name differ in two bits at most.
    nameless = F.lit(NAMELESS) + F.col("fp").bitwiseAND(F.lit(NAMELESS - 1))
    prints = settle(printed.groupBy("fp").agg(F.min(id_col).alias("name")).withColumn("name", F.coalesce("name", nameless)))
    found = components(fingerprint_links(prints, hot))
    label = F.coalesce("label", "name")
    named = prints.join(found.withColumnRenamed("node", "name"), "name", "left").select("fp", F.when(label < NAMELESS, label).alias("component_id"))
    return printed.join(named, "fp").select(id_col, "fp", "component_id")


#: Near copies: words of a shingle, likeness, words of a wide fingerprint, tables and bits of a table's key (quick search); a key that gathers
#: more than HOT members is dealt out by SUB_BITS more bits, SUB_TABLES times.
COPY_SHINGLE, SIMILARITY = 5, 0.8
WIDE, TABLES, KEY_BITS, SUB_TABLES, SUB_BITS = 8, 40, 18, 16, 12
#: Shingles known as frequent at most, and texts in which they are counted, about.
COMMON, COMMON_ROWS = 1 << 18, 30_000
#: Load only: texts of a leader in one block, and shingles that are counted at once for all texts of two blocks.
FAMILY, COLUMNS = 1024, 4096
MIX = np.arange(1, WIDE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(words: list[bytes], shingle: int = COPY_SHINGLE) -> np.ndarray:
    """Distinct hashes of the shingles of a word sequence, in no order; a shorter text is one shingle. None without words."""
    size = min(shingle, len(words))
    hashed = xxhash.xxh64_intdigest
    return np.array(list({hashed(b" ".join(words[k : k + size]), 42) for k in range(len(words) - size + 1)} if words else ()), np.uint64)


def wide_fingerprint(words: list[bytes], shingle: int = COPY_SHINGLE) -> np.ndarray:
    """SimHash of WIDE * 64 bits, as bits, over the distinct shingles of a word sequence; zero without words."""
    total = np.zeros(WIDE * 64, np.int64)
    if not words:
        return total.astype(np.uint8)
    hashes = shingle_hashes(words, shingle)
    for k in range(0, len(hashes), 255):  # sums of 255 rows fit a byte
        z = hashes[k : k + 255, None] + MIX
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
        total += np.add.reduce(np.unpackbits(z.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return (2 * total > len(hashes)).astype(np.uint8)


def copy_radius(similarity: float, bits: int) -> int:
    """Differing bits up to which sets of equal size may have this Jaccard similarity: the mean and one standard deviation."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(bits * share + math.sqrt(bits * share * (1 - share)))


def _near_links_in_partition(similarity: float, piece: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    radius = copy_radius(similarity, WIDE * 64)
    # the index holds the first 64 bits; three deviations more than their mean lose about one link in a thousand
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    first = int(64 * share + 3 * math.sqrt(64 * share * (1 - share)))

    def solved(group: np.ndarray, name: np.ndarray, wide: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((gray_rank(wide[:, 0]), group))
        wide = wide[order]
        label = GrayIndex(group[order], np.ascontiguousarray(wide[:, 0])).classes(first, lambda i, j: np.bitwise_count(wide[i] ^ wide[j]).sum(axis=1, dtype=np.int64) <= radius)
        back = np.empty(len(order), np.int64)
        back[order] = order[label]
        return name, name[back], back

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        rows = 0

        def portion(last: bool):
            """Links of all held rows; of the group that is still open, one member of each class stays."""
            key, name, wide = (np.concatenate(c) for c in zip(*held, strict=True))
            group = np.cumsum(np.concatenate(([0], (key[1:] != key[:-1]).any(axis=1))))
            a, b, back = solved(group, name, wide)
            stay = (group == group[-1]) & (back == np.arange(len(back))) & (not last)
            moved = a != b
            return pa.RecordBatch.from_arrays([pa.array(a[moved]), pa.array(b[moved])], schema=schema), (key[stay], name[stay], wide[stay])

        for batch in batches:
            key = np.stack([batch.column(k).to_numpy() for k in (0, 1)], axis=1)
            wide = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint64).reshape(-1, WIDE)
            held.append((key, batch.column(2).to_numpy(), wide))
            rows += batch.num_rows
            if rows >= piece:
                found, open_group = portion(False)
                yield found
                held, rows = [open_group], 0
        if sum(len(h[0]) for h in held):
            yield portion(True)[0]

    return run


def _ranked(hashes: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The hashes in an order that is the same for all texts: those outside `common` first, then by count; by hash among equals."""
    if not common.size:
        return np.sort(hashes)
    at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
    return hashes[np.lexsort((hashes, np.where(common[at] == hashes, counts[at], 0)))]


def _common_shingles(texts: DataFrame, rows: int, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of at most COMMON frequent shingles with their counts in about COMMON_ROWS of `rows` texts (id, text).

    They only order the shingles of a text, rare ones first; any order gives the same links.
    """
    share = min(1.0, COMMON_ROWS / max(1, rows))
    some = texts.where(F.pmod(F.xxhash64(texts.columns[0]), F.lit(1 << 20)) < int(share * (1 << 20)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            found = [shingle_hashes(utf8(t).translate(LOWER).split(), shingle) for t in piece.column(1).to_pylist()]
            values, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts)], names=["gram", "n"])

    counted = some.mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).where("n > 2")
    table = counted.orderBy(F.desc("n"), "gram").limit(COMMON).toArrow()
    grams, counts = table.column("gram").to_numpy().view(np.uint64), table.column("n").to_numpy()
    order = np.argsort(grams)
    return grams[order], counts[order]


def _meetings(num: int, den: int):
    """Names that share a key of their prefixes with a name of another label, if both may reach num / den by size and position;
    each with the smallest such name of its group. A group gives a row a member, however many pairs it has."""
    schema = pa.schema([("name", pa.int64()), ("label", pa.int64()), ("leader", pa.int64())])

    def active_of(key, block, label, name, size, rank, side) -> pa.RecordBatch:
        edge = np.concatenate(([True], (key[1:] != key[:-1]) | (block[1:] != block[:-1])))
        opens = np.flatnonzero(edge)
        mixed = block < 0  # of a block with another one: only pairs of both
        ends = np.concatenate((opens[1:], [len(key)]))
        last = ends[np.cumsum(edge) - 1]
        group = np.cumsum(edge) - 1
        edge[1:] |= label[1:] != label[:-1]
        ends = np.concatenate((np.flatnonzero(edge)[1:], [len(key)]))
        begin = ends[np.cumsum(edge) - 1]
        width = last - begin  # members of the same key behind all those with the same label
        total, start = np.cumsum(width), 0
        active = np.zeros(len(key), bool)
        while start < len(key):
            done = total[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(total, done + MEETS, "right")))
            w = width[start:stop]
            i = np.repeat(np.arange(start, stop), w)
            j = np.arange(len(i)) + np.repeat(begin[start:stop] - (np.cumsum(w) - w), w)
            # at the first shingle in order that both have, what can be shared is that one and what follows it in the shorter rest
            rest = np.minimum(size[i] - rank[i], size[j] - rank[j])
            keep = (rest * (num + den) >= num * (size[i] + size[j])) & (~mixed[i] | (side[i] != side[j]))
            active[i[keep]] = active[j[keep]] = True
            start = stop
        leader = np.minimum.reduceat(np.where(active, name, np.iinfo(np.int64).max), opens)[group]
        rows = np.unique(np.stack([name[active], label[active], leader[active]], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in rows.T], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows = 0
        for batch in batches:
            held.append([batch.column(k).to_numpy() for k in range(7)])
            rows += batch.num_rows
            if rows >= PIECE:
                columns = [np.concatenate(c) for c in zip(*held, strict=True)]
                # the group that is still open stays whole
                stop = int(np.max(np.flatnonzero((columns[0] != columns[0][-1]) | (columns[1] != columns[1][-1])), initial=-1)) + 1
                if stop:
                    yield active_of(*(c[:stop] for c in columns))
                held, rows = [[c[stop:] for c in columns]], len(columns[0]) - stop
        if rows:
            yield active_of(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return run


def meetings(texts: DataFrame, labels: DataFrame, similarity: Fraction, shingle: int, hot: int = HOT) -> DataFrame:
    """(name, label, leader) such that any two names with this Jaccard similarity or more and different labels have a leader in common.

    A leader is the smallest name of those that meet at a shingle. Texts of one family meet at many shingles, but have few leaders. Of n shingles in an order common to all texts, two such sets share one within the first n - ceil(similarity * n) + 1 of both.
    The members of a shingle that more than `hot` texts may have, by the counts of the sample, are dealt into blocks; every two blocks
    meet in a group of their own, so a group stays small and every pair still meets.
    """
    num, den = similarity.numerator, similarity.denominator
    id_col, text_col = texts.columns
    context = texts.sparkSession.sparkContext
    rows = labels.count()
    common = context.broadcast(_common_shingles(texts, rows, shingle))
    scale = max(1.0, rows / COMMON_ROWS)
    own = texts.join(sized(labels), F.col(id_col) == F.col("name")).select("name", "label", text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, counts = common.value
        for piece in slices(batches):
            out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(7)]
            for name, label, text in zip(*(piece.column(k).to_pylist() for k in range(3)), strict=True):
                first = _ranked(shingle_hashes(utf8(text).translate(LOWER).split(), shingle), frequent, counts)
                size = len(first)
                first = first[: size + 1 - -(-size * num // den)] if size else first
                blocks = np.ones(len(first), np.int64)
                if frequent.size and len(first):
                    at = np.minimum(np.searchsorted(frequent, first), len(frequent) - 1)
                    blocks = np.maximum(1, np.where(frequent[at] == first, np.ceil(counts[at] * scale / hot), 1).astype(np.int64))
                # a row for every block that this member's block meets; block pairs of two different ones are negative
                place = np.repeat(np.arange(len(first)), blocks)
                other = np.arange(len(place)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                side = xxhash.xxh64_intdigest(name.to_bytes(8, "little", signed=True)) % blocks.astype(np.uint64)
                side = side.astype(np.int64)[place]
                block = np.minimum(side, other) * blocks[place] + np.maximum(side, other)
                block = np.where(side == other, block, -block)
                for column, value in zip(out, (first.view(np.int64)[place], block, *(np.full(len(place), v) for v in (label, name, size)), place, side), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["key", "block", "label", "name", "size", "rank", "side"])

    keyed = own.mapInArrow(run, "key bigint, block bigint, label bigint, name bigint, size bigint, rank bigint, side bigint")
    return keyed.repartition("key", "block").sortWithinPartitions("key", "block", "label").mapInArrow(_meetings(num, den), "name bigint, label bigint, leader bigint").distinct()


def classes_alike(labels: np.ndarray, sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Class of every set (smallest index of its class): sets with equal labels are one class, and classes are joined by two sets
    whose Jaccard similarity is num / den or more. Each set is sorted and without repeats."""
    _, first, at = np.unique(labels, return_index=True, return_inverse=True)
    label = first[at]
    if len(first) == 1:
        return label
    sizes = np.array([len(s) for s in sets], np.int64)
    _, number, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = times[number] > 1
    owner, number = owner[shared], (np.cumsum(times > 1) - 1)[number[shared]]
    together = np.zeros((len(sets), len(sets)), np.float32 if 2 * den * sizes.max() * 2 < 1 << 24 else np.float64)  # exact whole numbers
    order = np.argsort(number, kind="stable")
    owner, number = owner[order], number[order]
    for start in range(0, int(number[-1]) + 1 if len(number) else 0, COLUMNS):
        low, high = np.searchsorted(number, (start, start + COLUMNS))
        has = np.zeros((len(sets), COLUMNS), np.float32)
        has[owner[low:high], number[low:high] - start] = 1
        together += has @ has.T
    alike = together * together.dtype.type(num + den) >= (num * (sizes[:, None] + sizes)).astype(together.dtype)
    i, j = np.nonzero(np.triu(alike & (label[:, None] != label), 1))
    return joined(label, i, j)


def _linked_groups(num: int, den: int):
    """Links (a, b) that join the classes of every group; a row for each class that is joined to another one."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(rows: list[tuple]) -> Iterator[tuple[int, int]]:
        names, labels = (np.array([r[k] for r in rows], np.int64) for k in (1, 2))
        label = classes_alike(labels, [np.frombuffer(r[3], np.uint64) for r in rows], num, den)
        for k in np.unique(labels, return_index=True)[1].tolist():
            if label[k] != k:
                yield int(names[k]), int(names[label[k]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            found: list[tuple[int, int]] = []
            keys = zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)
            for key, *row in zip(keys, *(batch.column(k).to_pylist() for k in (3, 4, 5)), strict=True):
                if held and held[0][0] != key:
                    found += links(held)
                    held = []
                held.append((key, *row))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], schema=schema)
        if held:
            found = list(links(held))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], schema=schema)

    return run


def linked(members: DataFrame, texts: DataFrame, similarity: Fraction, shingle: int, hot: int = FAMILY) -> DataFrame:
    """The settled links that join all texts of this similarity or more which have a leader in common.

    The shingles of a text come once to each of its leaders, and all texts of a leader are compared there by exact counts. A
    leader of more than `hot` texts is dealt into blocks; every two blocks meet in a group of their own.
    """
    id_col, text_col = texts.columns
    members = settle(members)

    def hashed(piece: pa.RecordBatch) -> list:
        return [piece.column(0).to_pylist(), [np.sort(shingle_hashes(utf8(t).translate(LOWER).split(), shingle)).tobytes() for t in piece.column(1).to_pylist()]]

    wanted = settle(members.select(F.col("name").alias(id_col)).distinct())
    known = map_slices(texts.join(sized(wanted), id_col), hashed, "name bigint, grams binary", pa.schema([("name", pa.int64()), ("grams", pa.binary())]))
    counts = members.groupBy("leader").agg(F.ceil(F.count("*") / hot).alias("blocks"))
    own = F.pmod(F.xxhash64("name"), F.col("blocks"))
    placed = (members.join(counts, "leader").withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
              .select("leader", F.least(own, "other").alias("low"), F.greatest(own, "other").alias("high"), "name", "label"))
    key = ["leader", "low", "high"]
    grouped = placed.join(known, "name").select(*key, "name", "label", "grams").repartition(*key).sortWithinPartitions(*key)
    return settle(grouped.mapInArrow(_linked_groups(similarity.numerator, similarity.denominator), "a bigint, b bigint"))


def confirmed(pairs: DataFrame, texts: DataFrame, similarity: Fraction, shingle: int) -> DataFrame:
    """The settled pairs (a, b) of names whose texts have this Jaccard similarity of their distinct shingles or more."""
    num, den = similarity.numerator, similarity.denominator
    id_col, text_col = texts.columns
    wanted = settle(pairs.select(F.col("a").alias(id_col)).union(pairs.select("b")).distinct())

    def hashed(piece: pa.RecordBatch) -> list:
        return [piece.column(0).to_pylist(), [np.sort(shingle_hashes(utf8(t).translate(LOWER).split(), shingle)).tobytes() for t in piece.column(1).to_pylist()]]

    arrow = pa.schema([("name", pa.int64()), ("grams", pa.binary())])
    known = settle(map_slices(texts.join(sized(wanted), id_col), hashed, "name bigint, grams binary", arrow))
    left, right = (known.select(F.col("name").alias(n), F.col("grams").alias(f"_{n}")) for n in "ab")
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "_a", "_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            alike = []
            for a, b in zip(piece.column(2).to_pylist(), piece.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                alike.append(shared * den >= num * (len(x) + len(y) - shared))
            yield piece.select(["a", "b"]).filter(pa.array(alike, type=pa.bool_()))

    return settle(both.mapInArrow(run, "a bigint, b bigint"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = COPY_SHINGLE, similarity: float = SIMILARITY, hot: int = HOT) -> DataFrame:
    """One row per document with an id: id, component_id (smallest id of the documents it is a near copy of, over links).

    Texts link when they have the same words, or when the Jaccard similarity of their distinct shingles is `similarity` or more;
    every such pair ends in one component. Two searches give candidates, and each candidate is confirmed by its shingles. The
    first is quick and joins most of a large family: wide fingerprints that share KEY_BITS sampled bits in one of TABLES tables and
    differ in no more bits than `copy_radius`; what it misses is left to the second. The second is complete: texts of different
    components that share one of their rarest shingles (`meetings`) are compared family by family (`linked`). Null and empty texts are copies of each other. The id is an
    integer column; other columns are not read.
    """
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias(id_col), F.col(text_col).cast("string").alias("_text"))
    draw = np.random.default_rng(7)
    places = np.stack([draw.choice(WIDE * 64, KEY_BITS, replace=False) for _ in range(TABLES)])
    more = np.stack([draw.choice(WIDE * 64, SUB_BITS, replace=False) for _ in range(SUB_TABLES)])

    def sampled(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
        numbers = bits[:, at].astype(np.int32) @ (1 << np.arange(at.shape[1], dtype=np.int32))
        return numbers + (np.arange(len(at), dtype=np.int32) << at.shape[1])

    arrow = pa.schema([(id_col, pa.int64()), ("digest", pa.binary()), ("wide", pa.binary()), ("keys", pa.list_(pa.int32())), ("subs", pa.list_(pa.int32()))])

    def run(piece: pa.RecordBatch) -> list:
        digests, prints = [], []
        for text in piece.column(1).to_pylist():
            words = utf8(text).translate(LOWER).split()
            digests.append(hashlib.blake2b(b" ".join(words), digest_size=16).digest())
            prints.append(wide_fingerprint(words, shingle))
        bits = np.stack(prints)
        wide = [row.tobytes() for row in np.packbits(bits, axis=1, bitorder="little")]
        return [piece.column(0).to_pylist(), digests, wide, sampled(bits, places).tolist(), sampled(bits, more).tolist()]

    printed = settle(map_slices(texts, run, f"`{id_col}` bigint, digest binary, wide binary, keys array<int>, subs array<int>", arrow))
    # equal words: one name, whose row carries the fingerprint on
    named = settle(printed.groupBy("digest").agg(F.min(id_col).alias("name")))
    apart = settle(printed.join(named.withColumn(id_col, F.col("name")), ["digest", id_col]).select("name", "wide", "keys", "subs"))
    dealt = apart.select("name", "wide", "subs", F.explode("keys").alias("key"))
    busy = sized(settle(dealt.groupBy("key").agg(F.count("*").alias("members")).where(F.col("members") > hot).select("key", F.lit(True).alias("busy"))))
    seats = F.when(F.col("busy"), F.col("subs")).otherwise(F.array(F.lit(-1)))
    seated = dealt.join(busy, "key", "left").select("key", F.explode(seats).alias("sub"), "name", "wide")
    links = (seated.repartition("key", "sub").sortWithinPartitions("key", "sub")
             .mapInArrow(_near_links_in_partition(similarity, PIECE), "a bigint, b bigint"))
    least, source = Fraction(str(similarity)), texts.where(F.col("_text").isNotNull())
    sure = confirmed(settle(links.distinct()), source, least, shingle)
    labels = settle(apart.select("name").distinct().join(components(sure).withColumnRenamed("node", "name"), "name", "left")
                    .select("name", F.coalesce("label", "name").alias("label")))
    sure = sure.union(linked(meetings(source, labels, least, shingle, hot), source, least, shingle, min(hot, FAMILY)))
    found = components(sure).withColumnRenamed("node", "name")
    return printed.select(id_col, "digest").join(named, "digest").join(found, "name", "left").select(id_col, F.coalesce("label", "name").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups: DataFrame | None = None) -> DataFrame:
    """All columns of the documents that stand for their component: the one with the smallest id; of rows repeating
    that id, one for each different text.

    Components are those of `near_duplicates`, or `groups` (id, component_id). Rows without id stand for themselves and stay.
    """
    kept = (groups or near_duplicates(docs, id_col, text_col)).where(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias("_kept")).distinct()
    # columns of the documents stay inside `_row`, so no name of theirs can clash
    packed = docs.select(F.col(id_col).cast("bigint").alias("_key"), F.struct(*docs.columns).alias("_row"))
    text = F.col("_row").getField(text_col)
    once = Window.partitionBy("_key", F.sha2(text.cast("string"), 256)).orderBy(text)
    chosen = packed.join(kept, F.col("_key") == F.col("_kept"), "left_semi").withColumn("_nth", F.row_number().over(once)).where("_nth = 1")
    return chosen.select("_row.*").unionByName(docs.where(F.col(id_col).isNull()))
