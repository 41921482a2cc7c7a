"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

Words play the part of characters. The test strings are the windows of the benchmark items. For all windows of one length a
shift table over blocks of two words says how far the search may jump, the block that ends a window selects a bucket of test
strings, a look at the first words discards most of them, and a direct comparison confirms the occurrence.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlog.lineage import settle
from wardlog.llm.common import keep_rows, map_slices, utf8

WINDOW = 10
#: Benchmark text held in one search table (and so broadcast with a task); longer benchmarks are searched in blocks of items.
BLOCK_BYTES = 32 << 20
#: A-Z to a-z; bytes 0x00-0x2F, 0x3A-0x60, 0x7B-0x7F (after lower-casing) to a space: what stays are the words.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased; none for null."""
    return utf8(text).translate(WORD_BYTES).split()


class WuManber:
    """Search of windows that all have the same number of words."""

    def __init__(self, length: int, windows: dict[tuple[bytes, ...], set[str]]):
        self.length = length
        self.block = min(2, length)
        self.skip = length - self.block + 1
        shift: dict = {}
        buckets: dict = defaultdict(lambda: defaultdict(list))
        for window, items in windows.items():
            for end in range(self.block, length + 1):
                block = window[end - self.block : end]
                shift[block] = min(shift.get(block, self.skip), length - end)
            buckets[window[length - self.block :]][window[: self.block]].append((list(window), frozenset(items)))
        self.shift = shift
        self.buckets = {k: dict(v) for k, v in buckets.items()}

    def search(self, words: list[bytes]) -> Iterator[tuple[int, frozenset[str]]]:
        """Start of every occurrence, with the items of the window."""
        length, size, skip, shift, buckets = self.length, self.block, self.skip, self.shift.get, self.buckets
        at, n = length, len(words)
        while at <= n:
            block = (words[at - 2], words[at - 1]) if size == 2 else (words[at - 1],)
            jump = shift(block, skip)
            if jump:
                at += jump
                continue
            start = at - length
            for window, items in buckets[block].get(tuple(words[start : start + size]), ()):
                if words[start:at] == window:
                    yield start, items
            at += 1


class Benchmark:
    """Search tables of a block of benchmark items, one per window length."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        by_length: dict[int, dict] = defaultdict(lambda: defaultdict(set))
        for item, text in items:
            words = words_of(text)
            size = min(window, len(words))
            for start in range(len(words) - size + 1 if words else 0):
                by_length[size][tuple(words[start : start + size])].add(str(item))
        self.tables = [WuManber(size, windows) for size, windows in sorted(by_length.items())]

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word ranges of all occurrences, and the items they come from."""
        found: list[tuple[int, int]] = []
        items: set[str] = set()
        for table in self.tables:
            for start, names in table.search(words):
                found.append((start, start + table.length))
                items |= names
        return found, items


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open ranges."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def benchmark_blocks(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> Iterator[list]:
    """Items in blocks of bounded size, streamed through the driver one partition after the other; null ids are left out."""
    block, size = [], 0
    for item, text in benchmark.where(F.col(item_col).isNotNull()).select(item_col, text_col).toLocalIterator():
        block.append((item, text))
        size += len(text or "") + 64
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


STATE = "`_id` {}, `_text` string, `_ranges` binary, `_items` array<string>"


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: id, n_words, n_hit, items (sorted strings), spans (array of word ranges).

    A window is `window` consecutive words of an item; an item of fewer words, but not none, is one window. A document word
    inside any occurrence is hit. Null and empty texts have no words; null or empty items have no windows, items without id
    are left out. Repeated rows each get their result; an empty benchmark gives no hits; other columns are not read. No
    shuffle: documents stream past the search table; a benchmark beyond `block_bytes` is searched block after block, with
    a checkpoint between two blocks.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[id_col].dataType
    state = pa.schema([("_id", to_arrow_type(kind)), ("_text", pa.string()), ("_ranges", pa.binary()), ("_items", pa.list_(pa.string()))])
    frame = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), F.lit(None).cast("binary").alias("_ranges"),
                        F.lit(None).cast("array<string>").alias("_items"))
    blocks = benchmark_blocks(benchmark, block_bytes=block_bytes)
    block = next(blocks, [])
    while True:
        following = next(blocks, None)
        if following is None:
            break
        search = _search_into(Benchmark(block, window))
        frame = settle(map_slices(frame, lambda piece, search=search: search(piece)[:4], STATE.format(kind.simpleString()), state))
        block = following
    last = _search_into(Benchmark(block, window))
    out = pa.schema([(id_col, to_arrow_type(kind)), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
                     ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])

    def finish(piece: pa.RecordBatch) -> list:
        ids, _, ranges, items, sizes = last(piece)
        spans = [np.frombuffer(r or b"", np.int32).reshape(-1, 2).tolist() for r in ranges]
        return [ids, sizes, [sum(e - s for s, e in x) for x in spans], items,
                [[{"start": s, "end": e} for s, e in x] for x in spans]]

    return map_slices(frame, finish, f"`{id_col}` {kind.simpleString()}, n_words long, n_hit long, items array<string>, "
                      "spans array<struct<start: int, end: int>>", out)


def _search_into(table: Benchmark):
    """Adds one block's ranges and items to those of the blocks before; also gives the number of words."""

    def run(piece: pa.RecordBatch) -> list:
        ids, texts, ranges, items = (piece.column(k).to_pylist() for k in range(4))
        sizes = []
        for k, text in enumerate(texts):
            words = words_of(text)
            sizes.append(len(words))
            found, names = table.hits(words)
            old = np.frombuffer(ranges[k] or b"", np.int32).reshape(-1, 2).tolist()
            ranges[k] = np.array(merged([*map(tuple, old), *found]), np.int32).tobytes()
            items[k] = sorted({*(items[k] or ()), *names})
        return [ids, texts, ranges, items, sizes]

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents (all their columns) in which no benchmark window occurs; null texts stay."""
    for block in benchmark_blocks(benchmark, block_bytes=block_bytes):
        table = Benchmark(block, window)
        docs = keep_rows(docs, text_col, lambda texts, table=table: [not table.hits(words_of(t))[0] for t in texts])
    return docs

