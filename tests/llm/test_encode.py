from __future__ import annotations

import random

from lodestrata.llm.encode import VOCABULARY, PrefixEncoder, read_ranks, token_counts, token_ids

ALPHABET = ["a", "e", "the", "ing", " ", "  ", "\n", "'s", "ä", "日", "1", "=", "==", "🎉", "　", "<|endoftext|>", "\r", "Ġ", "\x00"]


def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


def test_equals_the_published_library():
    mine, theirs, rng = PrefixEncoder(read_ranks(VOCABULARY)), reference(), random.Random(7)
    for _ in range(3000):
        s = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(1, 40)))
        assert mine.encode(s) == theirs(s), s


def test_long_pieces():
    mine, theirs = PrefixEncoder(read_ranks(VOCABULARY)), reference()
    for s in ("a" * 3001, " " * 4000 + "x", "=-" * 1500, "日本" * 900):
        assert mine.encode(s) == theirs(s)
    assert len(mine.encode("ab" * 200_000)) > 0


def test_empty_null_repeated_and_clashing(spark):
    df = spark.createDataFrame([(1, "hello world", 5), (2, "", 5), (3, None, 5), (1, "hello world", 5), (None, "<|endoftext|>", 5)], "doc_id long, text string, ids int")
    got = token_ids(df).collect()
    assert sorted((r["doc_id"] or 0, len(r["ids"])) for r in got) == [(0, 7), (1, 2), (1, 2), (2, 0), (3, 0)]
    assert all(50256 not in r["ids"] for r in got)
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts(df).collect()} == {1: 2, 2: 0, 3: 0, None: 7}
    assert token_ids(df.limit(0)).count() == 0


def test_round_trip_over_the_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    e = PrefixEncoder(read_ranks(VOCABULARY))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r["ids"] for r in token_ids(docs).collect()}
    assert got.keys() == texts.keys()
    for i, ids in got.items():
        assert b"".join(e.token[t] for t in ids).decode("utf-8") == (texts[i] or "")
