"""Encoding against a public library's encoder of the same vocabulary, and round trips."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrata.llm import bpe

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def both():
    t = tokenizers.Tokenizer.from_file(f"{bpe.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return bpe.Encoder("byte_bpe_50k"), lambda s: t.encode(s, add_special_tokens=False).ids


ODD = ["", " ", "\n\n  x", "<|endoftext|>", "a\x85b c  d\x1ce", "🙂🙂 étude d'été", "~" * 3000, "ab" * 4000, "don't WE'LL", " 　x", "½²Ⅷ", "﻿‍", "नमस्ते", "\U0001d518x"]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(both, text):
    own, other = both
    assert own.encode(text).tolist() == other(text)
    assert own.decode(own.encode(text)) == text and own.count(text) == len(other(text))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(both, text):
    own, other = both
    assert own.encode(text).tolist() == other(text)
    assert own.decode(own.encode(text)) == text


def test_queue_skips_stale_entries():
    ranks = {b"a": 0, b"b": 1, b"c": 2, b"ab": 3, b"bc": 4, b"abc": 5}
    assert bpe.merge(b"abcab", ranks) == [5, 3] and bpe.merge(b"bcb", ranks) == [4, 1]


def test_column_with_nulls_empties_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (1, "hello world")], "doc_id long, text string").withColumn("ids", F.lit("x"))
    rows = sorted((r["doc_id"], list(r["ids"])) for r in bpe.encode_column(df, "doc_id", "text").collect())
    assert [len(r[1]) for r in rows] == [2, 2, 0, 0]
    assert bpe.encode_column(df.limit(0), "doc_id", "text").count() == 0
    assert [r["tokens"] for r in bpe.count_column(df, "doc_id", "text").orderBy("doc_id").collect()] == [2, 2, 0, 0]


def test_lone_surrogates_are_replaced(both):
    own, other = both
    assert own.encode("a\ud800b").tolist() == other("a�b")


def test_token_counts_by_language(spark, tmp_path):
    import __spark_entry__ as entry

    spark.createDataFrame([(1, "en", "ab cd"), (2, "en", ""), (3, "de", "x"), (4, None, None)], "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["lang"]: (r["n_documents"], r["n_chars"], r["n_empty"]) for r in entry.queries()["p7_token_counts"](spark, str(tmp_path)).collect()}
    assert got == {"en": (2, 5, 1), "de": (1, 1, 0), None: (1, 0, 1)}
