"""Cross-tokenizer alignment by pointer jumping.

Two tokenizers cut the same bytes. Every token points to its farthest-right overlapping token; doubling the pointers, for all
tokens of many documents at once, leads every token to the last one of its component: that labels the groups between common ends.
Overlapping pairs of tokens are links; their counts over the whole corpus tell how usual a link is.

Texts are tokenized once. What later steps need of a document (its different links and how often each occurs) is kept as packed
numbers in the shared folder. The most frequent links, as many as fit a table of TABLE_LINKS, go to every task; the others are joined by
a shuffle, in which no link is frequent any more.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import uuid
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlog.lineage import checkpoint_dir, settle
from wardlog.llm.common import rows_out

#: Links in the table that goes to every task (17 bytes each).
TABLE_LINKS = 1 << 21
#: Load only: bytes of text tokenized at once, and different links that a task holds before it hands their counts on.
SLICE_BYTES, HELD_LINKS = 1 << 19, 1 << 21
#: Words in a memo (it starts anew beyond that), and the longest that is kept in it.
MEMO_WORDS, MEMO_CHARS = 300_000, 64
SPACE = "▁"
#: Fixed value: how byte-level tokenizers cut texts.
BYTE_LEVEL_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts of these characters, whose classes all libraries agree on, are encoded word by word; others as a whole.
PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\xac\xae-\u024f‐-‧…]*")


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable Latin-1 as it is, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class WordIds:
    """Ids of texts whose words a tokenizer encodes one by one: every word once, then from a memo."""

    def __init__(self, split: Callable[[str], list[str]], encode: Callable[[list[str]], list[list[int]]], tokens: list[bytes]):
        self.split, self.encode, self.tokens = split, encode, tokens
        self.memo: dict[str, bytes | None] = {}

    def ids(self, texts: list[str]) -> list[np.ndarray | None]:
        """Ids of every text; None where they do not give back its bytes."""
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        cut = [self.split(t) for t in texts]
        fresh = list(set().union(*cut).difference(self.memo))
        coded = self.encode(fresh) if fresh else []
        token = self.tokens.__getitem__
        self.memo.update((w, array("I", ids).tobytes() if b"".join(map(token, ids)) == w.encode() else None) for w, ids in zip(fresh, coded, strict=True))
        out: list[np.ndarray | None] = []
        for words in cut:
            found = list(map(self.memo.__getitem__, words))
            out.append(None if None in found else np.frombuffer(b"".join(found), np.uintc).astype(np.int64))
        for word in fresh:
            if len(word) > MEMO_CHARS:
                del self.memo[word]
        return out


class Aligner:
    """Both tokenizers (content of their files) with the bytes of their entries."""

    def __init__(self, first_json: str, second_model: bytes):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_str(first_json)
        self.first.encode_special_tokens = True
        self.first.no_padding()
        self.first.no_truncation()
        self.second = sentencepiece.SentencePieceProcessor(model_proto=second_model)
        letters = byte_letters()
        data = json.loads(first_json)
        whole = {t["content"] for t in data.get("added_tokens", ())}
        size = self.first.get_vocab_size(with_added_tokens=True)
        self.first_bytes = [b""] * size
        for token, number in self.first.get_vocab(with_added_tokens=True).items():
            self.first_bytes[number] = token.encode() if token in whole else bytes(letters[c] for c in token)
        self.second_bytes = []
        for number in range(self.second.vocab_size()):
            piece = self.second.id_to_piece(number)
            self.second_bytes.append(bytes([int(piece[3:5], 16)]) if self.second.is_byte(number) else piece.replace(SPACE, " ").encode())
        self.first_sizes = np.array([len(t) for t in self.first_bytes], np.int64)
        self.second_sizes = np.array([len(t) for t in self.second_bytes], np.int64)
        a, b = ([str(k) for k in range(n)] for n in (len(self.first_bytes), len(self.second_bytes)))
        #: An id with what follows it: A inside a group, A at the end of its side, B inside, B at the end of a group, B at the end of the text.
        self.words = [*(x + "," for x in a), *(x + "|" for x in a), *(x + "," for x in b), *(x + ";" for x in b), *b]
        before = data.get("pre_tokenizer") or {}
        #: Whether words are encoded without regard to their neighbours: the first cuts texts by the byte-level pattern, and no
        #: entry of the second goes on behind a space.
        self.by_word = (before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not data.get("normalizer")
                        and not any(SPACE in self.second.id_to_piece(k).lstrip(SPACE) for k in range(len(self.second_bytes))))
        self.first_words = WordIds(regex.compile(BYTE_LEVEL_WORDS).findall, self._first_ids, self.first_bytes)
        self.second_words = WordIds(re.compile(" +[^ ]*").findall, self._second_ids, self.second_bytes)

    def _first_ids(self, spaced: list[str]) -> list[list[int]]:
        return [one.ids for one in self.first.encode_batch_fast(spaced, add_special_tokens=False)]

    def _second_ids(self, words: list[str]) -> list[list[int]]:
        """Words begin with a space, which the tokenizer adds itself, but not to an empty text."""
        space = [self.second.piece_to_id(SPACE)]
        return [ids or space for ids in self.second.encode([w[1:] for w in words], num_threads=1)]

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both for each text; none where a tokenizer does not give back the bytes of space + text."""
        spaced = [" " + t for t in texts]
        none = np.zeros(0, np.int64)
        a, b = [none] * len(texts), [none] * len(texts)
        plain = [k for k, t in enumerate(texts) if t and self.by_word and PLAIN.fullmatch(t)]
        words = [spaced[k] for k in plain]
        for k, left, right in zip(plain, self.first_words.ids(words), self.second_words.ids(words), strict=True):
            if left is not None and right is not None:
                a[k], b[k] = left, right
        done = set(plain)
        others = [k for k, t in enumerate(texts) if t and k not in done]
        for k, left, right in zip(others, self._first_ids([spaced[k] for k in others]), self.second.encode([texts[k] for k in others], num_threads=1), strict=True):
            raw = spaced[k].encode("utf-8", "surrogatepass")
            if b"".join([self.first_bytes[i] for i in left]) == raw and b"".join([self.second_bytes[i] for i in right]) == raw:
                a[k], b[k] = np.array(left, np.int64), np.array(right, np.int64)
        return a, b


@functools.lru_cache(maxsize=1)
def aligner_of(first_json: str, second_model: bytes) -> Aligner:
    """Kept by a worker for its next tasks."""
    return Aligner(first_json, second_model)


def terminals(starts_a: np.ndarray, ends_a: np.ndarray, starts_b: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """For all A tokens and then all B tokens the number of the B token that ends their component (counted from 0)."""
    count = len(ends_a)
    farthest_b = np.searchsorted(starts_b, ends_a, "left") - 1
    farthest_a = np.searchsorted(starts_a, ends_b, "left") - 1
    own = np.arange(len(ends_b))
    # A token that reaches no farther than its partner points there; at a common end the B token is the last.
    jump = np.concatenate((count + farthest_b, np.where(ends_a[farthest_a] > ends_b, farthest_a, count + own))) if count else np.zeros(0, np.int64)
    while True:
        onward = jump[jump]
        if np.array_equal(onward, jump):
            return jump - count
        jump = onward


def align(aligner: Aligner, texts: list[str]) -> dict[str, list]:
    """Columns for a list of texts (none null): counts, groups as text, and the different links with their numbers."""
    ids_a, ids_b = aligner.encode(texts)
    n_a, n_b = (np.array([len(x) for x in ids], np.int64) for ids in (ids_a, ids_b))
    a, b = np.concatenate(ids_a), np.concatenate(ids_b)
    ends_a, ends_b = np.cumsum(aligner.first_sizes[a]), np.cumsum(aligner.second_sizes[b])
    starts_a, starts_b = ends_a - aligner.first_sizes[a], ends_b - aligner.second_sizes[b]
    last = terminals(starts_a, ends_a, starts_b, ends_b)
    is_last = last[len(a):] == np.arange(len(b))
    rank = np.cumsum(is_last) - 1
    group_a, group_b = (rank[last[: len(a)]], rank[last[len(a):]]) if len(a) else (a, b)
    docs_a, docs_b = np.repeat(np.arange(len(texts)), n_a), np.repeat(np.arange(len(texts)), n_b)
    n_groups = np.bincount(docs_b[is_last], minlength=len(texts))

    size_a, size_b = len(aligner.first_bytes), len(aligner.second_bytes)
    ends_side = np.append(group_a[1:] != group_a[:-1], True)[: len(a)]
    ends_text = np.zeros(len(b), bool)
    ends_text[np.cumsum(n_b)[n_b > 0] - 1] = True
    word = np.empty(len(a) + len(b), np.int64)
    word[np.arange(len(a)) + np.searchsorted(group_b, group_a, "left")] = a + size_a * ends_side
    word[np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")] = b + 2 * size_a + size_b * (is_last.astype(np.int64) + ends_text)
    written = [aligner.words[k] for k in word.tolist()]
    cuts = np.concatenate(([0], np.cumsum(n_a + n_b))).tolist()
    groups = ["".join(written[s:e]) for s, e in zip(cuts, cuts[1:])]

    low, high = np.searchsorted(ends_b, starts_a, "right"), np.searchsorted(starts_b, ends_a, "left")
    each = high - low
    partner = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(low, each)
    links = np.repeat(docs_a << 32, each) | (np.repeat(a * size_b, each) + b[partner])
    n_links = np.bincount(np.repeat(docs_a, each), minlength=len(texts))
    links, times = np.unique(links, return_counts=True)
    cuts = np.searchsorted(links, np.arange(len(texts) + 1) << 32).tolist()
    parts = [((links[s:e] & 0xFFFFFFFF).astype("<u4"), times[s:e].astype("<u4")) for s, e in zip(cuts, cuts[1:])]
    return {"n_a": n_a.tolist(), "n_b": n_b.tolist(), "n_groups": n_groups.tolist(), "n_links": n_links.tolist(), "groups": groups,
            "links": [pack(np.diff(x, prepend=np.uint32(0))) for x, _ in parts], "times": [pack(t) for _, t in parts]}


def pack(numbers: np.ndarray) -> bytes:
    """32-bit numbers byte plane by byte plane, which compresses well."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpack(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def unpack_links(planes: bytes) -> np.ndarray:
    return np.cumsum(unpack(planes))


def text_slices(batches: Iterator[pa.RecordBatch], at: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches in pieces of about `limit` bytes of text; one text alone may be longer."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy().astype(np.int64)
        number = np.cumsum(sizes) // limit
        starts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), batch.num_rows]
        for s, e in zip(starts, starts[1:]):
            yield batch.slice(s, e - s)


def align_documents(docs: DataFrame, first_json: str, second_model: bytes, id_col: str = "doc_id", text_col: str = "text", keep_groups: bool = True) -> DataFrame:
    """One row per document: id, n_a, n_b, n_groups, n_links, groups (or only groups_sha256), links and times (packed).

    `groups` lists the ids of both tokenizers between common ends: a1,a2|b1;a3|b2,b3. Texts that are null or empty, or that a
    tokenizer does not give back byte for byte, have no tokens, zeros and an empty string. Repeated rows each get a row; null
    ids stay; other columns are not read. No shuffle.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[id_col].dataType
    shown = "groups" if keep_groups else "groups_sha256"
    arrow = pa.schema([(id_col, to_arrow_type(kind)), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), (shown, pa.string()), ("links", pa.binary()), ("times", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_of(first_json, second_model)
        for piece in text_slices(batches, 1):
            out = align(aligner, [t or "" for t in piece.column(1).to_pylist()])
            if not keep_groups:
                out["groups_sha256"] = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in out["groups"]]
            yield rows_out(arrow, [piece.column(0).to_pylist(), *(out[c] for c in ("n_a", "n_b", "n_groups", "n_links", shown, "links", "times"))])

    return docs.select(F.col(id_col).alias(id_col), F.col(text_col).cast("string").alias("_text")).mapInArrow(
        run, f"`{id_col}` {kind.simpleString()}, n_a long, n_b long, n_groups long, n_links long, {shown} string, links binary, times binary")


def link_counts(aligned: DataFrame, second_size: int) -> DataFrame:
    """link, n, best: how often each link (A id * second_size + B id) occurs in the corpus, and if its B id has no more frequent one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links, counts, waiting, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            every, at = np.unique(np.concatenate([links, *(x for x, _ in waiting)]), return_inverse=True)
            total = np.zeros(len(every), np.int64)
            np.add.at(total, at, np.concatenate([counts, *(t for _, t in waiting)]))
            return every, total

        for batch in batches:
            for planes, times in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                waiting.append((unpack_links(planes), unpack(times)))
                size += len(waiting[-1][0])
                if size > HELD_LINKS:
                    links, counts = summed()
                    waiting, size = [], 0
                    if len(links) > HELD_LINKS:
                        yield pa.RecordBatch.from_pydict({"link": links, "n": counts})
                        links, counts = links[:0], counts[:0]
        links, counts = summed()
        yield pa.RecordBatch.from_pydict({"link": links, "n": counts})

    counted = settle(aligned.select("links", "times").mapInArrow(run, "link long, n long").groupBy("link").agg(F.sum("n").alias("n")))
    of_b = F.col("link") % second_size
    top = counted.groupBy(of_b.alias("b")).agg(F.max("n").alias("top"))  # as many rows as the vocabulary has entries
    return settle(counted.join(F.broadcast(top), of_b == F.col("b")).select("link", "n", (F.col("n") == F.col("top")).alias("best")))


def _frequent_from(counted: DataFrame, most: int) -> int:
    """The least count such that at most `most` links have it or a larger one."""
    step = F.floor(F.log2("n") * 4)
    bands = counted.groupBy(step.alias("band")).agg(F.count(F.lit(1)).alias("links"), F.min("n").alias("least"), F.max("n").alias("largest"))
    room, least = most, None
    for band in sorted(bands.collect(), key=lambda r: -r["band"]):  # a few bands for each power of two
        if band["links"] > room:
            return band["largest"] + 1
        room, least = room - band["links"], band["least"]
    return least or 1


def score_links(aligned: DataFrame, counted: DataFrame, table_links: int = TABLE_LINKS) -> DataFrame:
    """`aligned` (with a column row that names its rows) without its packed columns, with n_best and count_sum of every document."""
    spark = aligned.sparkSession
    least = _frequent_from(counted, table_links)
    table = counted.where(F.col("n") >= least).orderBy("link").toArrow()
    shipped = spark.sparkContext.broadcast([table.column(c).to_numpy() for c in ("link", "n", "best")])
    rare = counted.where(F.col("n") < least)

    def looked_up(batches: Iterator[pa.RecordBatch], known_only: bool) -> Iterator[pa.RecordBatch]:
        links, counts, best = shipped.value
        for batch in batches:
            rows, found = [], []
            for row, planes, times in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                mine, times = unpack_links(planes), unpack(times)
                at = np.minimum(np.searchsorted(links, mine), max(len(links) - 1, 0))
                known = links[at] == mine if len(links) else np.zeros(len(mine), bool)
                if known_only:
                    at, times = at[known], times[known]
                    rows.append(row)
                    found.append((int(times[best[at]].sum()), int(times @ counts[at]) if len(at) else 0))
                else:
                    rows += [row] * int((~known).sum())
                    found += zip(mine[~known].tolist(), times[~known].tolist())
            if rows:
                one, two = zip(*found)
                names = ("n_best", "count_sum") if known_only else ("link", "times")
                yield pa.RecordBatch.from_pydict({"row": pa.array(rows, pa.int64()), names[0]: pa.array(one, pa.int64()), names[1]: pa.array(two, pa.int64())})

    packed = aligned.select("row", "links", "times")
    parts = packed.mapInArrow(lambda batches: looked_up(batches, True), "row long, n_best long, count_sum long")
    if not rare.isEmpty():
        others = packed.mapInArrow(lambda batches: looked_up(batches, False), "row long, link long, times long").join(rare, "link")
        parts = parts.unionByName(others.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")))
    sums = parts.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return aligned.drop("links", "times").join(sums, "row").drop("row")


def aligned_links(docs: DataFrame, first_json: str, second_model: bytes, id_col: str = "doc_id", text_col: str = "text", table_links: int = TABLE_LINKS) -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document; see `align_documents` for odd rows."""
    import sentencepiece

    spark = docs.sparkSession
    size = sentencepiece.SentencePieceProcessor(model_proto=second_model).vocab_size()
    folder = f"{checkpoint_dir(spark)}/alignment-{uuid.uuid4().hex}"
    aligned = align_documents(docs, first_json, second_model, id_col, text_col, keep_groups=False)
    aligned.withColumn("row", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(folder)
    aligned = spark.read.parquet(folder)
    return score_links(aligned, link_counts(aligned, size), table_links).select(id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
