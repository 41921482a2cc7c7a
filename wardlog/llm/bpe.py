"""Byte-level BPE encoding and decoding by corpus-level merge replay.

Texts are cut into pre-tokens by the tokenizer's pattern. The distinct pre-tokens of a large piece of the corpus form one word
list, laid out one behind the other, with an inverted index from token pair to the positions where it stands; the merges are
replayed over the whole list in rank order, all occurrences of a merge at once, each touching only its two neighbours. Words that
were met before come from a bounded memo that a worker keeps for its next tasks. The vocabulary file is a parameter and is read by
the driver; its ranks travel with the tasks (about 1 MB).
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlog.llm.common import rows_out

#: Words that stay in the memo of a worker after a piece; beyond it the memo starts anew (results do not depend on it).
MEMO_WORDS = 250_000
#: Longer pre-tokens are not kept in the memo.
MEMO_CHARS = 64
#: Load only: bytes of text whose words are replayed together, and the least number of words worth an array replay. A worker that has
#: met a piece keeps about the memory that its arrays took, also while it serves other stages.
PIECE_BYTES, MANY_WORDS = 4 << 20, 4000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file with a base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class MergeReplay:
    """Encodes lists of distinct words by replaying the merges over all of them at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.size = max(ranks.values(), default=0) + 1
        pairs = sorted((ranks[a] * self.size + ranks[b], rank) for token, rank in ranks.items() for k in range(1, len(token))
                       if (a := token[:k]) in ranks and (b := token[k:]) in ranks)
        #: Every pair of tokens that is a token together, as one number in order, and the rank of that token.
        self.pairs, self.merges = (np.array(c, np.int64) for c in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 2
        self.bytes = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)

    def packed(self, words: list[bytes]) -> list[bytes]:
        """Ids of every word as little-endian unsigned 32-bit integers."""
        if len(words) < MANY_WORDS:
            return [np.array(ids, "<u4").tobytes() for ids in self.encode(words)]
        ids, cuts, odd = self._replay(words)
        raw = ids.astype("<u4").tobytes()
        cuts = (cuts * 4).tolist()
        out = [raw[s:e] for s, e in zip(cuts, cuts[1:])]
        for k, own in zip(odd, self.encode([words[k] for k in odd]), strict=True):
            out[k] = np.array(own, "<u4").tobytes()
        return out

    def _merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair makes, or -1."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.merges[at], -1) if len(self.pairs) else np.full(len(key), -1, np.int64)

    def _replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Ids of all words in a row, where each word begins, and the words that have to be replayed alone: those in which a
        merge makes a pair of lower rank than its own, which then has to go first."""
        whole = np.array([self.ranks.get(w, -1) for w in words], np.int64)
        sizes = np.where(whole >= 0, 1, np.array([len(w) for w in words], np.int64))
        ends = np.cumsum(sizes)
        token = np.empty(ends[-1] if len(ends) else 0, np.int64)
        known = whole >= 0
        single = ends[known] - 1
        spelt = np.ones(len(token), bool)
        spelt[single] = False
        token[single] = whole[known]
        token[spelt] = self.bytes[np.frombuffer(b"".join([w for w, k in zip(words, known.tolist()) if not k]), np.uint8)]
        word_of = np.repeat(np.arange(len(words)), sizes)
        after, before = np.arange(1, len(token) + 1), np.arange(-1, len(token) - 1)
        filled = sizes > 0
        after[ends[filled] - 1] = -1
        before[(ends - sizes)[filled]] = -1
        alive, odd = np.ones(len(token), bool), np.zeros(len(words), bool)

        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def note(ranks: np.ndarray, places: np.ndarray) -> None:
            """Enter places under the ranks of the pairs that begin there."""
            order = np.argsort(ranks, kind="stable")
            ranks, places = ranks[order], places[order]
            cuts = np.flatnonzero(np.concatenate(([True], ranks[1:] != ranks[:-1]))) if len(ranks) else np.zeros(0, np.int64)
            for rank, s, e in zip(ranks[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(ranks)]):
                if rank in index:
                    index[rank].append(places[s:e])
                else:
                    index[rank] = [places[s:e]]
                    heapq.heappush(heap, rank)

        first = np.flatnonzero(after >= 0)
        ranks = self._merged(token[first], token[after[first]])
        note(ranks[ranks >= 0], first[ranks >= 0])
        while heap:
            rank = heapq.heappop(heap)
            found = index.pop(rank)
            places = found[0] if len(found) == 1 else np.concatenate(found)
            places = np.unique(places) if len(found) > 1 else np.sort(places)
            places = places[alive[places] & (after[places] >= 0)]
            if len(places):
                places = places[(self._merged(token[places], token[after[places]]) == rank) & ~odd[word_of[places]]]
            if not len(places):
                continue
            right = after[places]
            # aaa: of occurrences that overlap every second one counts, from the left
            opens = np.concatenate(([True], right[:-1] != places[1:]))
            if not opens.all():
                number = np.arange(len(places))
                places = places[(number - np.maximum.accumulate(np.where(opens, number, 0))) % 2 == 0]
                right = after[places]
            end = after[right]
            inner = end >= 0
            to_right = np.full(len(places), -1, np.int64)
            to_right[inner] = self._merged(np.full(int(inner.sum()), rank), token[end[inner]])
            token[places] = rank
            alive[right] = False
            after[places] = end
            before[end[inner]] = places[inner]
            start = before[places]
            inner = start >= 0
            to_left = np.full(len(places), -1, np.int64)
            to_left[inner] = self._merged(token[start[inner]], np.full(int(inner.sum()), rank))
            early = ((to_right >= 0) & (to_right < rank)) | ((to_left >= 0) & (to_left < rank))
            odd[word_of[places[early]]] = True
            note(np.concatenate((to_right[to_right >= 0], to_left[to_left >= 0])), np.concatenate((places[to_right >= 0], start[to_left >= 0])))
        left = np.bincount(word_of[alive], minlength=len(words))
        return token[alive], np.concatenate(([0], np.cumsum(left))), np.flatnonzero(odd).tolist()

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of every word, as greedy lowest-rank-first merging gives them."""
        ranks, tokens = self.ranks, self.tokens
        ids: list[list[int]] = []
        after: list[list[int]] = []
        before: list[list[int]] = []
        index: dict[int, list[tuple[int, int]]] = {}
        memo: dict[tuple[int, int], int] = {}

        def merged(left: int, right: int) -> int:
            key = (left, right)
            if (known := memo.get(key)) is None:
                known = memo[key] = ranks.get(tokens[left] + tokens[right], -1)
            return known

        for w, word in enumerate(words):
            whole = ranks.get(word)
            row = [whole] if whole is not None else [ranks[word[k : k + 1]] for k in range(len(word))]
            n = len(row)
            ids.append(row)
            after.append([*range(1, n), -1] if n else [])
            before.append([*range(-1, n - 1)])
            for k in range(n - 1):
                rank = merged(row[k], row[k + 1])
                if rank >= 0:
                    index.setdefault(rank, []).append((w, k))
        heap = list(index)
        heapq.heapify(heap)
        while heap:
            rank = heapq.heappop(heap)
            places = index.pop(rank, None)
            if places is None:
                continue
            places.sort()
            waiting = -1  # a word that got a lower rank meanwhile goes on after that one
            for w, k in places:
                if w == waiting:
                    index.setdefault(rank, []).append((w, k))
                    continue
                row, nxt, prv = ids[w], after[w], before[w]
                if row[k] < 0:
                    continue
                r = nxt[k]
                if r < 0 or merged(row[k], row[r]) != rank:
                    continue
                row[k], row[r] = rank, -1
                nxt[k] = end = nxt[r]
                if end >= 0:
                    prv[end] = k
                    new = merged(rank, row[end])
                    if new >= 0:
                        if new not in index:
                            heapq.heappush(heap, new)
                        index.setdefault(new, []).append((w, k))
                        if new < rank:
                            waiting = w
                start = prv[k]
                if start >= 0:
                    new = merged(row[start], rank)
                    if new >= 0:
                        if new not in index:
                            heapq.heappush(heap, new)
                        index.setdefault(new, []).append((w, start))
                        if new < rank:
                            waiting = w
            if rank in index:
                heapq.heappush(heap, rank)
        return [[i for i in row if i >= 0] for row in ids]


class Numbers(dict):
    """Numbers words in the order in which they are met."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


class Tokenizer:
    """Pattern, merges and memo of a worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = regex.compile(pattern)
        self.replay = MergeReplay(ranks)
        self.numbers, self.known = Numbers(), []

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """Ids of every text as little-endian unsigned 32-bit integers; empty for null and empty texts."""
        numbers, known, met = self.numbers, self.known, len(self.known)
        # words as numbers: a text is held in four bytes a word
        cut = [array("I", map(numbers.__getitem__, self.pattern.findall(t))) if t else array("I") for t in texts]
        fresh = [w for w, _ in zip(reversed(numbers), range(len(numbers) - met))][::-1]
        known += self.replay.packed([w.encode("utf-8") for w in fresh])
        out = [b"".join([known[n] for n in words]) for words in cut]
        if any(len(w) > MEMO_CHARS for w in fresh):
            # the numbers must stay without a gap, so the new words are entered again without the long ones
            kept = [(w, i) for w, i in zip(fresh, known[met:]) if len(w) <= MEMO_CHARS]
            for word in fresh:
                del numbers[word]
            del known[met:]
            for word, ids in kept:
                numbers[word] = len(numbers)
                known.append(ids)
        if len(numbers) > MEMO_WORDS:
            self.numbers, self.known = Numbers(), []
        return out

    def decode(self, ids: bytes) -> bytes:
        """The bytes of a packed id list."""
        tokens = self.replay.tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()])


_KEPT: list[tuple[dict[bytes, int], Tokenizer]] = []


def tokenizer_of(ranks: dict[bytes, int], pattern: str) -> Tokenizer:
    """The tokenizer of this worker, kept with its memo for the next task of the same vocabulary."""
    if not _KEPT or _KEPT[0][1].pattern.pattern != pattern or _KEPT[0][0] != ranks:
        _KEPT[:] = [(ranks, Tokenizer(ranks, pattern))]
    return _KEPT[0][1]


def pieces(batches: Iterator[pa.RecordBatch], at: int, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches in pieces of about `limit` bytes of the text column; one text alone may be longer."""
    for batch in batches:
        if batch.num_rows:
            number = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy().astype(np.int64)) // limit
            starts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), batch.num_rows]
            for s, e in zip(starts, starts[1:]):
                yield batch.slice(s, e - s)


def encode_documents(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ids (packed little-endian unsigned 32-bit), decoded (bytes of the decoded ids).

    Special tokens are ordinary text. Null and empty texts have no ids. Repeated rows each get their result; null ids stay;
    other columns are not read. No shuffle; memory is one piece of texts with its words, and the memo.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[id_col].dataType
    arrow = pa.schema([(id_col, to_arrow_type(kind)), ("ids", pa.binary()), ("decoded", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_of(ranks, pattern)
        for piece in pieces(batches, 1):
            ids = tokenizer.encode(piece.column(1).to_pylist())
            yield rows_out(arrow, [piece.column(0).to_pylist(), ids, [tokenizer.decode(i) for i in ids]])
        pa.default_memory_pool().release_unused()  # the worker lives on

    return docs.select(F.col(id_col).alias(id_col), F.col(text_col).cast("string").alias("_text")).mapInArrow(
        run, f"`{id_col}` {kind.simpleString()}, ids binary, decoded binary")
