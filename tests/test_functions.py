import math

import pytest
from pyspark.sql import functions as F

from momentforge.functions import text as T
from momentforge.functions import timeline as L
from momentforge.functions import vector as V


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


@pytest.mark.parametrize(("raw", "want"), [("  A\xa0 Man\t\nWalks ", "a man walks"), ("", ""), ("\xa0", ""), (None, None)])
def test_normal_form(spark, raw, want):
    assert one(spark, T.normalize(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize(("text", "n"), [("", 0), ("a  b", 2), ("  ", 0), ("a b c", 3)])
def test_word_count(spark, text, n):
    assert one(spark, T.word_count(F.lit(text))) == n


@pytest.mark.parametrize(("text", "valid"), [("is it the", False), ("... !!! ???", False), ("a b", False), (" ".join(["cat"] * 51), False), (" ".join(["cat"] * 50), True), ("the cat sat", True), ("(the) cat, sat!", True)])
def test_valid_captions(spark, text, valid):
    assert one(spark, T.valid_caption(F.lit(text))) is valid


def test_search_tokens(spark):
    assert one(spark, T.search_tokens(F.lit("Someone is WALKING dogs, boxes and wanted as the video bus"))) == ["walk", "dog", "box", "want", "as", "bus"]
    assert one(spark, T.query_key(F.lit("  Dog's  Life! "))) == "dog s life"


def test_ngrams(spark):
    w = F.array(*map(F.lit, "abc"))
    assert one(spark, T.ngrams(w, 2)) == ["a b", "b c"] and one(spark, T.ngrams(w, 4)) == []


def test_bigrams_break_at_stop_words(spark):
    assert one(spark, T.content_bigrams(F.lit("red cars near the old bridge"))) == ["red cars", "cars near", "old bridge"]
    assert one(spark, T.content_tokens(F.lit("The x red cars"))) == ["red", "cars"]


@pytest.mark.parametrize(("s", "want"), [(65.4, "1:05"), (0.0, "0:00"), (-3.0, "0:00"), (3600.0, "60:00")])
def test_clock(spark, s, want):
    assert one(spark, T.clock(F.lit(s))) == want


def test_formats(spark):
    assert one(spark, T.percent(F.lit(0.913))) == "91%" and one(spark, T.percent(F.lit(0.3664), 1)) == "36.6%"
    assert one(spark, T.hms(F.lit(3725.9))) == "01:02:05"
    assert one(spark, T.media_url(F.lit("v1"), F.lit(-2.0))).endswith("t=0.0")
    assert one(spark, T.clean_title(F.lit("/x/my_clip-01.mp4"))) == "my clip 01" and one(spark, T.clean_title(F.lit("___.mp4"))) == "Untitled"
    assert one(spark, T.file_suffix(F.lit("a/b.MP4"))) == ".mp4" and one(spark, T.file_stem(F.lit("a/b.c.mp4"))) == "b.c"


def test_grounded_answer(spark):
    span = lambda a, b, s: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(s).alias("score"))
    two = one(spark, T.grounded_answer(F.lit("dog"), F.array(span(2.0, 8.0, 0.9), span(61.0, 70.0, 0.4))))
    assert two == "The closest moment for “dog” is 0:02–0:08 (90% match). There is also a weaker match at 1:01–1:10."
    none = one(spark, T.grounded_answer(F.lit("dog"), F.array().cast("array<struct<start:double,end:double,score:double>>")))
    assert none == "I couldn't find “dog” in this video."


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(1.0), F.lit(0.0))
    assert one(spark, V.dot(a, b)) == 3.0 and one(spark, V.unit(a)) == [0.6, 0.8] and one(spark, V.cosine(a, b)) == pytest.approx(0.6)
    assert one(spark, V.unit(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]
    rows = F.array(F.array(F.lit(2.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0)))
    assert one(spark, V.pooled(rows, 2)) == pytest.approx([math.sqrt(0.5)] * 2)
    assert one(spark, V.pooled(rows, 2, normed=False)) == pytest.approx([2 / math.sqrt(5), 1 / math.sqrt(5)])
    short = F.array(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.5)), F.array(F.lit(0.0), F.lit(0.2)))
    assert one(spark, V.pooled(short, 2)) == pytest.approx([1 / math.sqrt(5), 2 / math.sqrt(5)])
    assert one(spark, V.masked_mean(a, F.array(F.lit(0), F.lit(0)))) == 0.0


def test_fusions(spark):
    none = F.lit(None).cast("double")
    assert one(spark, V.fuse_logistic(F.lit(0.3), none)) == 0.5 and one(spark, V.fuse_range(F.lit(0.4))) == pytest.approx(1.0)
    assert one(spark, V.fuse_two_stage(F.lit(0.2), none)) == 0.5 and one(spark, V.fuse_two_stage(F.lit(0.2), F.lit(0.0))) == 0.5
    assert one(spark, V.fuse_half(F.lit(0.0))) == 0.5


def test_jitter_reads_the_digest_little_endian(spark):
    import hashlib

    n = int.from_bytes(hashlib.md5(b"q\x1fw1").digest()[:8], "little") % 10_000
    assert one(spark, V.jittered(F.lit(0.5), F.lit("q"), F.lit("w1"))) == pytest.approx(0.5 + 0.12 * (n / 10_000 - 0.5))


@pytest.mark.parametrize(("d", "whole", "want"), [(8.0, False, [(0, 8)]), (45.0, True, [(0, 45)]), (12.0, False, [(0, 10), (2, 12)]), (20.0, False, [(0, 10), (5, 15), (10, 20)]), (0.0, False, [])])
def test_windows(spark, d, whole, want):
    assert [tuple(w) for w in one(spark, L.windows(F.lit(d), whole=whole))] == want


def test_long_windows(spark):
    w = one(spark, L.windows(F.lit(27.0)))
    assert tuple(w[0]) == (0, 10) and w[-1]["end"] == 27 and all(x["end"] - x["start"] <= 10 for x in w)
    assert one(spark, L.windows(F.lit(None).cast("double"))) == []


def test_frames(spark):
    assert one(spark, L.even_indices(F.lit(10), 3)) == [0, 4, 9] and one(spark, L.even_indices(F.lit(10), 1)) == [0]
    assert one(spark, L.ends_and_middle(F.lit(9))) == [0, 4, 8] and one(spark, L.segment_centres(F.lit(0.0), F.lit(10.0), 5)) == [1, 3, 5, 7, 9]
    assert [tuple(x) for x in one(spark, L.every_kth(F.lit(60), F.lit(0.0), 1.0))] == [(0, 0.0), (30, 1.0)]
    assert one(spark, L.every_kth(F.lit(0), F.lit(25.0), 1.0)) == []


def test_aspects(spark):
    d = spark.createDataFrame([(640, 480), (1920, 1080), (500, 500), (0, 10), (None, 5), (1000, 100)], "w int, h int")
    assert [r.a for r in d.select(L.aspect(F.col("w"), F.col("h")).alias("a")).collect()] == ["4:3", "16:9", "1:1", "unknown", "unknown", "other"]
