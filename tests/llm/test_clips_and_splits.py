import pytest
from pyspark.sql import functions as F

from momentforge.llm import clips
from momentforge.llm.group_splits import assign_splits, components, leaking_rows, weighted_cut

ROWS = "row_id bigint, video_id string, split string"
VIDEOS = "video_id string, url string"


def test_clip_spellings(spark):
    names = ["video7", " VIDEO7 ", "raw/a/video_7.MP4", "video-7.mkv ", "./video7.avi", "video7\xa0", "x\\video7"]
    d = spark.createDataFrame([(n,) for n in names], "v string").select(clips.clip_key("v").alias("k"))
    assert {r.k for r in d.collect()} == {"video7"}
    odd = spark.createDataFrame([(None,), ("",), ("...",), ("/.mp4",)], "v string").select(clips.clip_key("v").alias("k"))
    assert [r.k for r in odd.collect()] == [None] * 4


def test_split_names(spark):
    d = spark.createDataFrame([("Train ",), (" VALIDATION",), ("val",), ("Test",), ("dev",), (None,)], "s string").select(clips.split_name("s").alias("s"))
    assert [r.s for r in d.collect()] == ["train", "val", "val", "test", None, None]


@pytest.mark.parametrize("url", ["https://a.b/watch?v=ABCdef_-123", "https://a.b/watch?list=p&v=ABCdef_-123&t=1s", "https://s.e/ABCdef_-123", "a.b/v/ABCdef_-123#t=1", "https://a.b/embed/ABCdef_-123?rel=0", "https://m.a.b/shorts/ABCdef_-123/"])
def test_source_from_url(spark, url):
    d = spark.createDataFrame([("video1", url)], "v string, u string").select(clips.source_key(F.col("v"), F.col("u")).alias("k"))
    assert d.first().k == "ABCdef_-123"


def test_components_against_union_find(spark):
    import random

    rng = random.Random(4)
    pairs = [(f"v{rng.randrange(300)}", f"v{rng.randrange(300)}") for _ in range(220)] + [("hub", f"leaf{i}") for i in range(200)] + [(f"c{i}", f"c{i + 1}") for i in range(60)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            parent[find(a)] = find(b)
    edges = spark.createDataFrame([*pairs, (None, "x"), ("y", "y")], "a string, b string")
    got = {r.vertex: r.label for r in components(edges).collect()}
    groups, want = {}, {}
    for v, label in got.items():
        groups.setdefault(label, set()).add(v)
    for v in parent:
        want.setdefault(find(v), set()).add(v)
    assert {frozenset(g) for g in groups.values()} == {frozenset(g) for g in want.values()}


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_leaking_rows(spark):
    rows = spark.createDataFrame([
        (1, "abcdefghijk_1_5", "train", 9), (2, "clips/abcdefghijk_7_9.mp4", "val", 9), (3, "video1", "train", 9), (4, "VIDEO-1", "Train ", 9), (5, "video2", "test", 9),
        (6, None, "train", 9), (7, "...", "test", 9), (8, "abcdefghijk_1_5", None, 9), (9, "video3", "train", 9), (10, "ABCDEFGHIJK_1_9", "test", 9),
    ], ROWS + ", clip int")
    videos = spark.createDataFrame([("video2", "https://x.y/watch?v=abcdefghijk", 1), ("video3", None, 1), ("video1", None, 1)], VIDEOS + ", label int")
    # row 10 is another key: letter case counts in keys
    assert sorted(r.row_id for r in leaking_rows(rows, videos).collect()) == [1, 2, 5]


def test_split_assignment_keeps_groups_whole(spark):
    rows = spark.range(2000).select(F.col("id").alias("row_id"), F.when(F.col("id") < 700, "video7").otherwise(F.format_string("abcdefgh%03d_%d_9", F.col("id") % 200, F.col("id") % 5)).alias("video_id"), F.lit(None).cast("string").alias("split"))
    out = assign_splits(rows, spark.createDataFrame([], VIDEOS)).join(rows.select("row_id", "video_id"), "row_id")
    assert out.count() == 2000
    key = F.regexp_extract("video_id", "^([^_]*)", 1)
    assert out.groupBy(key).agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    share = {r.split: r["count"] / 2000 for r in out.groupBy("split").count().collect()}
    assert abs(share["train"] - 0.8) < 0.02 and abs(share["val"] - 0.1) < 0.02


def test_split_of_unreadable_and_no_rows(spark):
    rows = spark.createDataFrame([(1, None, None), (2, "", None)], ROWS)
    assert assign_splits(rows, spark.createDataFrame([], VIDEOS)).count() == 2
    assert assign_splits(rows.limit(0), spark.createDataFrame([], VIDEOS)).count() == 0
    assert leaking_rows(rows.limit(0), spark.createDataFrame([], VIDEOS)).count() == 0


def test_weighted_cut_is_reproducible(spark):
    w = spark.range(500).select(F.col("id").cast("string").alias("label"), F.lit(3).alias("weight"))
    a = {tuple(r) for r in weighted_cut(w, {"train": 0.5, "test": 0.5}).collect()}
    b = {tuple(r) for r in weighted_cut(w.repartition(7), {"train": 0.5, "test": 0.5}).collect()}
    assert a == b and abs(sum(s == "train" for _, s in a) - 250) <= 2


def test_category_reading(spark):
    rows = spark.createDataFrame([(f"v{i}", c) for i, c in enumerate(["7", "7.0", " Pet  Antics ", "N/A", "unknown", "", None, "99", "7.5"])], "video_id string, category string")
    targets = spark.createDataFrame([(7, "lab demos"), (3, "pet antics")], "category_id int, category_name string")
    assert {r.clip: r.category_id for r in clips.category_ids(rows, targets).collect()} == {"v0": 7, "v1": 7, "v2": 3}


def test_a_clip_with_two_sources_joins_them(spark):
    from momentforge.llm.group_splits import clip_groups

    rows = spark.createDataFrame([("one",), ("two",), ("both",), ("alone",)], "video_id string")
    videos = spark.createDataFrame([("one", "https://x.org/watch?v=AAAAAAAAAAA"), ("two", "https://x.org/watch?v=BBBBBBBBBBB"), ("both", "https://x.org/watch?v=AAAAAAAAAAA"), ("BOTH", "https://x.org/watch?v=BBBBBBBBBBB")], "video_id string, url string")
    label = {r.clip: r.label for r in clip_groups(rows, videos).collect()}
    assert label["one"] == label["two"] == label["both"] != label["alone"]
