import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

from pathloom.llm.byte_bpe import bpe_decode, bpe_encode, bpe_round_trip, codec, read_ranks
from pathloom.llm.token_counts import count_batch, token_counts

RANKS = P.path("byte_bpe_50k.tiktoken")
TEXTS = ["", None, " ", "a ", "hello  world", "x" * 5000, "the cat sat. " * 4000, "<|endoftext|> <s>", "日本語 テキスト 😀", "a\n b\t c", "é " * 300, "▁a ▁b", "it's 1,234 'll"]


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"])
def test_counts_are_the_library_s(name):
    path = P.path(name)
    if name.endswith(".model"):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        want = [len(model.encode(t or "")) for t in TEXTS]
    else:
        model = Tokenizer.from_file(path)
        want = [len(model.encode(t or "", add_special_tokens=False).ids) for t in TEXTS]
    assert count_batch(TEXTS, path, piece_chars=50, batch_bytes=200) == want


def test_token_counts(spark):
    docs = spark.createDataFrame([(1, "ab cd", 9), (1, "ab cd", 9), (None, None, 9), (2, "é", 9)], "doc_id long, text string, n_tokens int")
    rows = token_counts(docs, P.path("piece_bpe_32k.model")).collect()
    assert sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"] > 0) for r in rows) == [(0, 0, False), (1, 5, True), (1, 5, True), (2, 2, True)]
    assert token_counts(docs.limit(0), P.path("piece_bpe_32k.model")).count() == 0


def reference(text):
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})
    return encoding.encode_ordinary(text)


def test_bpe_is_exact():
    import random

    model, draw = codec(RANKS, P.PATTERN), random.Random(4)
    bits = ["a", "th", "ing", " ", "  ", "\n", "é", "日本", "😀", "1", "23", "'s", "!!", "\xa0", "aaaa", "\t", "<|endoftext|>", "́"]
    texts = [t or "" for t in TEXTS] + ["".join(draw.choice(bits) for _ in range(draw.randint(0, 40))) for _ in range(1500)] + ["".join(draw.choice("abcdefgh") for _ in range(5000))]
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})
    for text in texts:
        coded = model.encode(text)
        assert [int.from_bytes(coded[i : i + 4], "little") for i in range(0, len(coded), 4)] == encoding.encode_ordinary(text)
        assert model.decode(coded) == text.encode()


def test_bpe_round_trip(spark):
    docs = spark.createDataFrame([(1, "hello world", "x"), (None, None, "y"), (1, "", "z")], "doc_id long, text string, ids string")
    rows = bpe_decode(bpe_encode(docs, RANKS, P.PATTERN), RANKS).collect()
    assert sorted(map(str, rows)) == sorted(map(str, bpe_round_trip(docs, RANKS, P.PATTERN).collect()))
    assert sorted((r["n_tokens"], bytes(r["decoded"])) for r in rows) == [(0, b""), (0, b""), (2, b"hello world")]
