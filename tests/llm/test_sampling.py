import numpy as np
import pytest
from pyspark.sql import functions as F

from momentforge.llm.source_mix import mix, splitting_tree, starved_sources
from momentforge.llm.target_sample import TargetSample, rake

T = "category_id int, category_name string, target_share double, min_videos int"
R = "video_id string, category string, source string"


def test_rake_meets_both_margins():
    w = rake(np.array([[50.0, 10], [20, 40], [5, 5]]), [np.array([0.2, 0.5, 0.3]), np.array([0.6, 0.4])])
    x = w * np.array([[50.0, 10], [20, 40], [5, 5]])
    assert np.allclose(x.sum(1) / x.sum(), [0.2, 0.5, 0.3], atol=1e-6) and np.allclose(x.sum(0) / x.sum(), [0.6, 0.4], atol=1e-6)


def test_rake_without_records():
    assert rake(np.zeros((2, 2)), [np.array([0.5, 0.5])] * 2).sum() == 0


@pytest.fixture(scope="module")
def sampler(spark):
    rows = spark.range(4000).select(F.format_string("v%05d", "id").alias("video_id"), F.when(F.col("id") < 3000, "0").when(F.col("id") < 3900, "1.0").when(F.col("id") < 3990, " Rare ").otherwise("none at all").alias("category"), F.when(F.col("id") % 3 == 0, "A").otherwise("B").alias("source"))
    rows = rows.union(rows).withColumn("clip", F.lit(1)).withColumn("key", F.lit(1))  # repeated rows, clashing names
    targets = spark.createDataFrame([(0, "zero", 0.5, 1), (1, "one", 0.375, 1), (2, "rare", 0.125, 40), (3, "never", 0.0, 5)], T)
    return TargetSample(rows, targets)


def test_sample_counts(sampler):
    assert sampler.size == 1995
    sample, quota = sampler.draw()
    got = {r.category_id: r["count"] for r in sample.groupBy("category_id").count().collect()}
    assert got == {c: n for c, n in quota.items() if n} and sum(got.values()) == 1995
    assert sample.select("clip").distinct().count() == 1995
    assert got[2] == 90 and abs(got[0] - 1088) < 70


def test_report_names_the_gaps(sampler):
    r = {x.category_id: x for x in sampler.report().collect()}
    assert not r[2].met and r[2].need == 250 and r[2].available == 90 and r[2].gap == 160
    assert not r[3].met and r[3].need == 5 and r[0].met and r[1].met


def test_sample_is_reproducible(sampler):
    a, b = ({r.clip for r in sampler.draw()[0].collect()} for _ in range(2))
    assert a == b


def test_sample_of_nothing(spark):
    t = TargetSample(spark.createDataFrame([], R), spark.createDataFrame([(0, "zero", 1.0, 2)], T))
    assert t.draw()[0].count() == 0 and [x.met for x in t.report().collect()] == [False]
    nulls = TargetSample(spark.createDataFrame([(None, "0", None), ("v1", None, None), ("v2", "0", None)], R), spark.createDataFrame([(0, "zero", 1.0, 1)], T))
    assert nulls.size == 0 and nulls.draw()[0].count() <= 1


def test_splitting_tree_keeps_quotas():
    q = np.array([7, 0, 100, 23])
    out = splitting_tree(q, 6, np.random.default_rng(1))
    assert (out.sum(0) == q).all() and out.sum(1).max() - out.sum(1).min() <= 1 and (out >= 0).all()


D = "doc_id bigint, text string, source string"
M = "source string, target_share double, max_repeats int"


def test_mix_meets_the_shares(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words here. "), (F.col("id") % 7 + 1).cast("int")).alias("text"), F.when(F.col("id") % 10 == 0, "small").when(F.col("id") % 10 == 1, F.lit(None)).otherwise("big").alias("source"))
    docs = docs.union(spark.createDataFrame([(9001, None, "small"), (9002, "", "big")], D)).withColumn("tokens", F.lit(1)).withColumn("ids", F.lit(1)).withColumn("block", F.lit(1))
    targets = spark.createDataFrame([("small", 0.25, 3), ("big", 0.7, 1), ("absent", 0.05, 9)], M)
    rows, report = mix(docs, targets, shard_tokens=5000, blocks_per_shard=32)
    r = {x.source: x for x in report.collect()}
    assert r["absent"].tokens == 0 and not r["absent"].feasible and r["small"].copies <= 3 and r["big"].copies == 1
    total = docs.where("source is not null").count()
    assert 0.2 < r["small"].actual_share / (r["small"].actual_share + r["big"].actual_share) < 0.31 and total
    assert rows.groupBy("doc_id", "copy").count().where("count > 1").count() == 0
    per = rows.groupBy("shard").agg(F.sum("tokens").alias("t")).agg(F.min("t").alias("lo"), F.max("t").alias("hi")).first()
    assert per.hi < 1.6 * per.lo


def test_starved(spark):
    docs = spark.createDataFrame([(1, "one two three four five six seven eight nine ten", "a"), (2, "one", "b"), (3, "x y z", None)], D)
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.4, 2), ("c", 0.1, 5)], M)
    assert sorted(r.source for r in starved_sources(docs, targets).collect()) == ["b", "c"]


def test_mix_of_nothing(spark):
    rows, report = mix(spark.createDataFrame([], D), spark.createDataFrame([("a", 1.0, 2)], M))
    assert rows.count() == 0 and [(x.source, x.tokens, x.feasible) for x in report.collect()] == [("a", 0, True)]


def test_shards_are_written_shuffled_and_whole(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words here. "), (F.col("id") % 7 + 1).cast("int")).alias("text"), F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("source"))
    rows, report = mix(docs, spark.createDataFrame([("a", 0.5, 3), ("b", 0.5, 1)], M), shard_tokens=1500, blocks_per_shard=8)
    read = rows.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()).orderBy("at").collect()
    assert len({r.shard for r in read}) > 3
    for shard in {r.shard for r in read}:
        mine = [r for r in read if r.shard == shard]
        assert len({r.part for r in mine}) == 1 and [r.place for r in mine] == sorted(r.place for r in mine)
        assert [r.doc_id for r in mine] != sorted(r.doc_id for r in mine)
    r = {x.source: x for x in report.collect()}
    assert abs(r["a"].actual_share - r["a"].reachable_share) < 0.02 and abs(r["a"].reachable_share + r["b"].reachable_share - 1) < 1e-9


def test_tasks_split_the_tree_as_the_driver_does(spark, monkeypatch):
    from momentforge.llm import source_mix

    q = np.array([700, 0, 130, 23])
    monkeypatch.setattr(source_mix, "NODES", 4)
    got = source_mix.deal_blocks(spark, ["a", "b", "c", "d"], q, 37, 5).collect()
    want = {(s, lo): (int(first[i]), int(have[i])) for lo, _, first, have in source_mix.split_nodes(q, 37, 5, 37) for i, s in enumerate("abcd") if have[i]}
    assert {(r.source, r.shard): (r["first"], r.n) for r in got} == want
    for s, n in zip("abcd", q, strict=True):
        runs = sorted((r["first"], r.n) for r in got if r.source == s)
        assert sum(k for _, k in runs) == n and all(a + k == b for (a, k), (b, _) in zip(runs, runs[1:]))


def test_met_means_taken(spark):
    rows = spark.range(90).select(F.format_string("v%02d", "id").alias("video_id"), (F.col("id") % 3).cast("string").alias("category"), F.lit("A").alias("source"))
    shares = spark.createDataFrame([(0, "a", 0.34, 1), (1, "b", 0.33, 1), (2, "c", 0.33, 30)], T)
    for r in TargetSample(rows, shares).report().collect():
        assert r.met == (r.taken >= r.need) and r.reachable == (r.available >= r.need) and (r.gap == 0) == r.met


def test_sources_beyond_the_bound_share_a_margin(spark, monkeypatch):
    from momentforge.llm import target_sample

    monkeypatch.setattr(target_sample, "MAX_SOURCES", 5)
    rows = spark.range(400).select(F.format_string("v%03d", "id").alias("video_id"), (F.col("id") % 2).cast("string").alias("category"), F.format_string("s%d", F.col("id") % 50).alias("source"))
    t = TargetSample(rows, spark.createDataFrame([(0, "a", 0.5, 1), (1, "b", 0.5, 1)], T))
    assert len(t._cells) <= 12 and t.draw()[0].count() == 200
