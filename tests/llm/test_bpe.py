import os

import pytest

from arrayloom.llm import bpe

PATH = f"{bpe.TOKENIZERS}/byte_bpe_50k.tiktoken"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary files")


def test_same_as_the_library(spark):
    import random

    import tiktoken

    rng = random.Random(4)
    texts = ["", None, "   ", " \n\n \t x", "Hello, world! it's we'll 1234 <|endoftext|>", "naïve 日本語テキスト 👩‍🔬 ​\x00 \xad", "Привет мир"]
    texts += ["a" * 3000, "ab" * 700 + "!" * 900, " " * 500, "".join(chr(rng.randrange(97, 123)) for _ in range(2500))]
    texts += ["".join(rng.choice("abcdefghij etaoin shrdlu .,'\n") for _ in range(300)) for _ in range(60)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "x", 2)], "key long, text string, ids int")
    got = {r.key: r.ids for r in bpe.encode_texts(df, "key", "text").collect()}
    enc = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})
    assert len(got) == len(texts) + 1
    for i, t in enumerate(texts):
        assert got[i] == enc.encode_ordinary(t or ""), t[:50]


def test_round_trip_and_empty_table(spark):
    ranks = bpe.read_ranks(PATH)
    tokens = {i: t for t, i in ranks.items()}
    text = "Ünïcode — und etwas länger; " * 40
    df = spark.createDataFrame([(1, text)], "k int, t string")
    ids = bpe.encode_texts(df, "k", "t").collect()[0].ids
    assert b"".join(tokens[i] for i in ids).decode() == text
    assert bpe.encode_texts(df.limit(0), "k", "t").collect() == []


def test_matrix_and_heap_agree():
    pairs = bpe.PairTable(bpe.read_ranks(PATH))
    words = [b" international", b"aaaaaaaaab", b"x", b"\xff\xfe", b"unbelievableness" * 4]
    for w, ids in zip(words, bpe.encode_words(words, pairs)):
        assert ids.tolist() == bpe._heap(w, pairs).tolist()
