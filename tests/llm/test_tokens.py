"""BPE and unigram counts against the public libraries."""

import random
import tracemalloc

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from llm_tables import ODD, empty_frame, frame, odd_frame, prose

from wardlog.llm import bpe, token_counts


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def noise(rng, n):
    return "".join(rng.choice("aaab 'stréßñ漢🙂 \n\t  19.,!<|endoftext|>") for _ in range(n))


@pytest.mark.parametrize("many,memo", [(4000, 10**6), (1, 10**6), (1, 50)])
def test_merge_replay(ranks, monkeypatch, many, memo):
    monkeypatch.setattr(bpe, "MANY_WORDS", many)
    monkeypatch.setattr(bpe, "MEMO_WORDS", memo)
    rng = random.Random(1)
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [*ODD, *(noise(rng, rng.randint(1, 300)) for _ in range(300)), *(prose(rng, 3) for _ in range(40)), "ab" * 4000, "the" * 3000 + " Überführung"]
    tokenizer = bpe.Tokenizer(ranks, public_tokenizers.PATTERN)
    for _ in range(2):  # the second time from the memo
        for text, ids in zip(texts, tokenizer.encode(texts), strict=True):
            assert memoryview(ids).cast("I").tolist() == reference.encode_ordinary(text or "")
            assert tokenizer.decode(ids) == (text or "").encode()


def test_replay_order_where_merges_give_lower_ranks(monkeypatch):
    """Merges that create a pair of lower rank than the one at hand, several in a word; overlapping pairs."""
    rng, odd = random.Random(2), 0
    for _ in range(60):
        letters = [bytes([b]) for b in b"abc"]
        more = list({b"".join(rng.choices(letters, k=rng.randint(2, 5))) for _ in range(12)})
        rng.shuffle(more)
        table = {bytes([b]): k for k, b in enumerate(range(256))} | {w: 256 + k for k, w in enumerate(more)}
        words = [b"".join(rng.choices(letters, k=rng.randint(1, 14))) for _ in range(60)]
        reference = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=table, special_tokens={})
        expected = [reference.encode_ordinary(w.decode()) for w in words]
        replay = bpe.MergeReplay(table)
        assert replay.encode(words) == expected
        monkeypatch.setattr(bpe, "MANY_WORDS", 1)
        assert [memoryview(i).cast("I").tolist() for i in replay.packed(words)] == expected
        odd += len(replay._replay(words)[2])
    assert odd > 20  # words in which a merge makes a pair that has to go first


def test_encode_documents(spark, ranks):
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: r for r in bpe.encode_documents(frame(spark, ODD), ranks, public_tokenizers.PATTERN).collect()}
    assert all(memoryview(bytes(got[k]["ids"])).cast("I").tolist() == reference.encode_ordinary(t or "") and bytes(got[k]["decoded"]) == (t or "").encode() for k, t in enumerate(ODD))
    assert bpe.encode_documents(odd_frame(spark), ranks, public_tokenizers.PATTERN).count() == len(ODD) + 3
    assert bpe.encode_documents(empty_frame(spark), ranks, public_tokenizers.PATTERN).count() == 0


def test_what_a_worker_keeps_is_bounded(monkeypatch):
    """The memo holds no more words than it may after a piece, not only before the next one."""
    monkeypatch.setattr(bpe, "MEMO_WORDS", 100)
    tokenizer = bpe.Tokenizer({bytes([b]): b for b in range(256)}, public_tokenizers.PATTERN)
    for first, kept in ((0, 60), (60, 0), (120, 60)):  # the second brings it over 100
        text = " ".join(f"word{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(first, first + 60))
        assert tokenizer.decode(tokenizer.encode([text])[0]) == text.encode()
        assert len(tokenizer.numbers) == len(tokenizer.known) == kept


def test_memory_does_not_grow_with_the_batch():
    """A batch of 12 MB of words that are all different takes about the memory of one of 4 MB beyond its own rows."""
    rng, peaks = random.Random(8), []
    texts = [" ".join("".join(rng.choices("abcdefghijklmnopqrst", k=31)) for _ in range(1000)) for _ in range(375)]
    for rows in (125, 375):
        batch = pa.RecordBatch.from_arrays([pa.array(texts[:rows])], names=["text"])
        tokenizer = bpe.Tokenizer({bytes([b]): b for b in range(256)} | {b"ab": 256, b"cd": 257}, public_tokenizers.PATTERN)
        tracemalloc.start()
        for piece in bpe.pieces(iter([batch]), 0):
            tokenizer.encode(piece.column(0).to_pylist())
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.7 * peaks[0]


def test_token_counts(spark):
    from tokenizers import Tokenizer, models, pre_tokenizers

    scores = token_counts.unigram_scores(token_counts.read_pieces(public_tokenizers.path("piece_bpe_32k.model")))
    usable = [(p, s) if k < 3 or not (p.startswith("<0x") and len(p) == 6) else (f"\ue000{k}", s) for k, (p, s) in enumerate(scores)]
    usable = [(f"\ue001{k}", s) if k < 3 else (p, s) for k, (p, s) in enumerate(usable)]
    library = Tokenizer(models.Unigram(usable, unk_id=0, byte_fallback=False))
    library.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    rng = random.Random(3)
    texts = [*ODD, *(noise(rng, rng.randint(1, 200)) for _ in range(300)), *(prose(rng, 3) for _ in range(40)), "▁a ▁▁b", "a▁b"]
    viterbi = token_counts.Viterbi(scores)
    assert [viterbi.tokens(t) for t in texts] == [len(library.encode(t, add_special_tokens=False).ids) if t else 0 for t in texts]
    got = {r["doc_id"]: (r["n_chars"], r["n_tokens"]) for r in token_counts.count_tokens(frame(spark, texts), scores).collect()}
    assert got == {k: (len(t or ""), viterbi.tokens(t)) for k, t in enumerate(texts)}
    assert token_counts.count_tokens(odd_frame(spark), scores).count() == len(ODD) + 3
    assert token_counts.count_tokens(empty_frame(spark), scores).count() == 0


def test_ties_take_the_longest_last_piece():
    scores = [("<unk>", 0.0), ("<s>", 0.0), ("</s>", 0.0), ("▁", -1.0), ("a", -1.0), ("▁a", -2.0), ("aa", -2.0), ("aaa", -3.0)]
    from tokenizers import Tokenizer, models, pre_tokenizers

    library = Tokenizer(models.Unigram(scores, unk_id=0, byte_fallback=False))
    library.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    viterbi = token_counts.Viterbi(scores)
    for text in ("a", "aa", "aaa", "aaaa", "aaaaaaa", "a a", "xaxxa", "xx"):
        assert viterbi.tokens(text) == len(library.encode(text, add_special_tokens=False).ids)
