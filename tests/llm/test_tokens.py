import random

import pytest
from pyspark.sql import functions as F

from momentforge.llm import tokens as T

public = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

ODD = ["", " ", "a" * 3000, "é" * 500 + " x", "\U0001f600" * 130, "x   y　z  \n\n q", "é‍", "don't I'LL we've 's", "a\u0000b\x7f", "<|endoftext|> hi", " " * 200 + "a", "1" * 150, "ſ ﬁ Ǆ ½ ² Ⅷ 一二 १२३", "\r\n\t x\r", "'s's 'S", "पुल के पास", "ab́c", "!" * 119 + "?" * 500]


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


def docs(spark):
    rng = random.Random(2)
    some = ["".join(rng.choice(["the ", "cat", " 123", "\n", "é", "x-y", "  ", "日本", "ing ", "!"]) for _ in range(60)) for _ in range(200)]
    rows = list(enumerate(ODD + some + some[:20]))
    return rows, spark.createDataFrame([*rows, (9999, None)], "doc_id bigint, text string")


def test_ids_equal_the_library(spark, library):
    rows, d = docs(spark)
    got = {r.doc_id: r.ids for r in T.encode(d.withColumn("ids", F.lit(1)).withColumn("w", F.lit(1))).collect()}
    assert got[9999] == [] and got[0] == []
    assert [i for i, t in rows if got[i] != library(t)] == []


def test_round_trip(spark):
    rows, d = docs(spark)
    back = {r.doc_id: r.text for r in T.decode(T.encode(d)).collect()}
    assert all(back[i] == t for i, t in rows) and back[9999] == ""


def test_totals_equal_the_ids(spark, library):
    rows, d = docs(spark)
    d = d.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "a").when(F.col("doc_id") % 3 == 1, "b"))
    want = {"a": sum(len(library(t)) for i, t in rows if i % 3 == 0), "b": sum(len(library(t)) for i, t in rows if i % 3 == 1)}
    assert {r.source: r.tokens for r in T.token_totals(d, "source").collect()} == want


def test_totals_of_some_groups(spark):
    d = spark.createDataFrame([(1, "one two", "a"), (2, "three", "b"), (3, "four five six", "c"), (4, None, "c"), (5, "x", None)], "doc_id bigint, text string, source string")
    assert {r.source: r.tokens for r in T.token_totals(d, "source", only=["a", "z"]).collect()} == {"a": 2, T.OTHER: 4}


def test_no_rows(spark):
    e = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert T.encode(e).count() == 0 and T.token_totals(e, "source").count() == 0


def test_heap_equals_slow_merge():
    v = T.load(T.default_vocabulary())
    ranks = {p: i for i, p in enumerate(v.pieces) if p}
    for w in (b"hello", "überraschung".encode(), b"aaaaaaaaaab" * 9, bytes(range(256))):
        slow = [ranks[p] for p in T._slow_bpe(w, ranks, len(v.pieces))]
        assert T.heap_encode(w, v.merges, v.byte_ids) == slow


def test_kept_columns(spark):
    d = spark.createDataFrame([(1, "a b", "s", "t")], "doc_id bigint, text string, source string, title string")
    assert T.encode(d, keep=("source", "text")).columns == ["doc_id", "source", "text", "ids"]
