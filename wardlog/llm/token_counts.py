"""Token counts: count-only Viterbi over a unigram vocabulary.

Every word (a text is cut at its blanks, a blank belongs to the word after it) goes through an Aho-Corasick automaton of all
pieces; dynamic programming over the positions carries only the best score and the number of pieces. Ties are broken as the
unigram tokenizer does: pieces are tried by their start, and a later one replaces the best only if it is strictly better. A
character that no piece begins with alone is unknown, ten below the worst piece; neighbouring unknown characters are one token.
Counts of words met before come from a bounded memo.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlog.llm.common import rows_out, slices

BLANK = "▁"
UNKNOWN_PENALTY = 10.0
MEMO_WORDS, MEMO_CHARS = 500_000, 64


def read_pieces(path: str) -> list[str]:
    """Pieces of a sentencepiece model file in their order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(k) for k in range(model.get_piece_size())]


def unigram_scores(pieces: list[str], special: int = 3) -> list[tuple[str, float]]:
    """(piece, log probability): Zipf's law over the rank of a piece; single characters, listed last, keep their rank.

    The first `special` pieces (unknown, begin, end) and byte pieces are control pieces that no text matches.
    """
    total = math.log(sum(1 / k for k in range(1, len(pieces) + 1)))
    return [(p, 0.0 if k < special else -math.log(k - special + 1) - total) for k, p in enumerate(pieces)]


class Viterbi:
    def __init__(self, scores: list[tuple[str, float]], special: int = 3):
        self.automaton = ahocorasick.Automaton()
        usable = {p: s for k, (p, s) in enumerate(scores) if k >= special and not (p.startswith("<0x") and len(p) == 6)}
        for piece, score in usable.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in scores), default=0.0) - UNKNOWN_PENALTY
        self.memo: dict[str, int] = {}

    def count(self, word: str) -> int:
        """Number of tokens of one word."""
        n = len(word)
        best = [None] * (n + 1)  # score, tokens, whether the last token is unknown
        best[0] = (0.0, 0, False)
        # matches by end, each with its start; starts ascend when the longest comes first
        ends: list[list] = [[] for _ in range(n + 1)]
        single = [False] * n
        for end, (size, score) in self.automaton.iter(word):
            ends[end + 1].append((size, score))
            if size == 1:
                single[end] = True
        for at in range(1, n + 1):
            found = None
            for size, score in sorted(ends[at], key=lambda m: -m[0]):
                total = score + best[at - size][0]
                if found is None or total > found[0]:
                    found = (total, best[at - size][1] + 1, False)
            if not single[at - 1]:
                total = self.unknown + best[at - 1][0]
                if found is None or total > found[0]:
                    found = (total, best[at - 1][1] + (not best[at - 1][2]), True)
            best[at] = found
        return best[n][1]

    def tokens(self, text: str | None) -> int:
        """Number of tokens of a text; a blank is put before it unless it begins with one. None for null and empty texts."""
        if not text:
            return 0
        total, memo = 0, self.memo
        marked = text.replace(" ", BLANK)
        for part in marked.removeprefix(BLANK).split(BLANK):
            known = memo.get(part)
            if known is None:
                known = self.count(BLANK + part)
                if len(part) <= MEMO_CHARS:
                    if len(memo) > MEMO_WORDS:
                        memo.clear()
                    memo[part] = known
            total += known
        return total


def count_tokens(docs: DataFrame, scores: list[tuple[str, float]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_chars, n_tokens. Null and empty texts have no tokens; repeated rows each get their row.

    The vocabulary is a parameter and travels with the tasks; other columns are not read. No shuffle; memory is one slice of
    texts, the automaton and the memo.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[id_col].dataType
    arrow = pa.schema([(id_col, to_arrow_type(kind)), ("n_chars", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        viterbi = Viterbi(scores)
        for piece in slices(batches):
            texts = piece.column(1).to_pylist()
            yield rows_out(arrow, [piece.column(0).to_pylist(), [len(t or "") for t in texts], [viterbi.tokens(t) for t in texts]])

    return docs.select(F.col(id_col).alias(id_col), F.col(text_col).cast("string").alias("_text")).mapInArrow(
        run, f"`{id_col}` {kind.simpleString()}, n_chars long, n_tokens long")
