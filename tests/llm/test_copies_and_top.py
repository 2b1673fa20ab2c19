from pyspark.sql import functions as F

from momentforge.llm.format_copies import collapse, copies_of
from momentforge.llm.top_n import top_n

S = "row_id bigint, video_id string, caption string, attrs string"


def test_copies_in_other_dress(spark):
    rows = [
        (5, "video1", "A man, walking!", '{"a": 1, "b": "x"}'), (3, "raw/VIDEO1.mp4", "a man walking", '{"b":"x","a":1.0}'), (9, "video-1", "A MAN  WALKING", '{"b": "x", "a": 1}'),
        (4, "video1", "a man walking", '{"a": 1, "b": "X"}'), (6, "video1", "a man walking", None), (7, "video1", "A man walking.", None), (8, "video1", "a man walking", "{}"),
        (10, "video2", "...", None), (11, "video2", "!!", None), (12, "video2", None, None), (13, None, "x", None), (14, None, "X", None), (15, "video1", "a man walking", "not json"), (16, "video1", "a man walking!", "not json"),
    ]
    d = spark.createDataFrame(rows, S).withColumn("text", F.lit("clash")).withColumn("n", F.lit(1)).withColumn("k1", F.lit(1))
    assert {tuple(r) for r in copies_of(d).collect()} == {(3, 5), (3, 9), (6, 7), (13, 14), (15, 16)}
    assert {tuple(r) for r in collapse(d).collect()} == {(3, 3), (4, 1), (6, 2), (8, 1), (13, 2), (15, 2)}


def test_null_is_not_empty(spark):
    d = spark.createDataFrame([(1, None, "a", None), (2, "", "a", None), (3, "a", "a", '{"x": null}'), (4, "a", "a", "{}")], S)
    # a clip without letters or digits names no clip, as null does
    assert {tuple(r) for r in copies_of(d).collect()} == {(1, 2)}


def test_hot_copies(spark):
    d = spark.range(3000).select(F.col("id").alias("row_id"), F.lit("v").alias("video_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("caption"), F.lit(None).cast("string").alias("attrs"))
    assert copies_of(d).count() == 999 and copies_of(d).agg(F.max("first_row_id")).first()[0] == 0


def test_no_rows(spark):
    e = spark.createDataFrame([], S)
    assert copies_of(e).count() == 0 and collapse(e).count() == 0


def test_long_text(spark):
    big = "x" * 300_000
    d = spark.createDataFrame([(1, "v", big, None), (2, "v", big.upper() + "!", None)], S)
    assert [tuple(r) for r in copies_of(d).collect()] == [(1, 2)]


B = "video_id string, window_id string, stage1_score double"


def test_top_with_ties_nulls_and_repeats(spark):
    nan = float("nan")
    rows = [("a", "w2", 0.5), ("a", "w1", 0.5), ("a", "w3", 0.5), ("a", "w4", 0.5), ("a", "w1", 0.1), ("a", "w9", nan), ("a", "w8", None), (None, "w0", 1.0), ("b", "w10", 0.1), ("b", "w9", 0.1), ("b", None, 9.0), ("c", "w", -1.0), ("c", "w", -1.0)]
    d = spark.createDataFrame(rows, B).withColumn("rank", F.lit(0)).withColumn("_g", F.lit(0))
    got = sorted((r.video_id, r["rank"], r.window_id) for r in top_n(d, "video_id", "window_id", "stage1_score", 3).collect())
    assert got == [("a", 1, "w1"), ("a", 2, "w2"), ("a", 3, "w3"), ("b", 1, "w10"), ("b", 2, "w9"), ("c", 1, "w")]


def test_top_of_nothing_and_bad_n(spark):
    import pytest

    e = spark.createDataFrame([], B)
    assert top_n(e, "video_id", "window_id", "stage1_score").count() == 0
    with pytest.raises(ValueError):
        top_n(e, "video_id", "window_id", "stage1_score", 0)


def test_group_limit_is_planned(spark):
    d = spark.createDataFrame([("a", "w", 1.0)], B)
    plan = top_n(d, "video_id", "window_id", "stage1_score")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
