"""Train, validation and test splits by hash order, set operations on ids, and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order(seed: int, *cols: str) -> Column:
    """A reproducible random order: independent of partitioning and row order. MD5, so that SQL engines agree."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def _ranked(df: DataFrame, by: list[str], order: Column, bins: int = 256) -> DataFrame:
    """``rank`` (1 ..) and ``size`` per stratum. Rows are ranked within hash ranges first and the ranges added
    up, so that no stratum is sorted in one task."""
    keyed = df.withColumn("_o", order).withColumn("_b", F.floor(F.conv(F.substring("_o", 1, 4), 16, 10).cast("int") / F.lit(65536 // bins)).cast("int"))
    per = keyed.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    before = per.select(
        *[F.col(c).alias("_k_" + c) for c in (*by, "_b")], (F.sum("_n").over(Window.partitionBy(*by).orderBy("_b")) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy(*by)).alias("size")
    )
    same = F.lit(True)
    for c in (*by, "_b"):
        same = same & F.col(c).eqNullSafe(F.col("_k_" + c))
    joined = keyed.join(before, same).drop(*["_k_" + c for c in (*by, "_b")])
    inside = F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_o"))
    return joined.withColumn("rank", F.col("_before") + inside).drop("_before", "_b", "_o")


def stratified_split(videos: DataFrame, stratum: str, val_ratio: float = 0.1, seed: int = 42) -> DataFrame:
    """(video_id, split): train and val over the videos that have no official test mark.

    ``videos`` is (video_id, split_hint, stratum), one row a video. A stratum with fewer than two videos
    makes the whole split ignore strata. Rows of one video always share the split.
    """
    test = videos.where("split_hint = 'test'").select("video_id", F.lit("test").alias("split"))
    rest = videos.where("split_hint is null or split_hint <> 'test'")
    least = rest.groupBy(stratum).count().agg(F.min("count").alias("least"))
    thin = (least.first() or [0])[0]
    by = [stratum] if thin and thin >= 2 else []
    if not by:
        rest = rest.withColumn("_all", F.lit(0))
        by = ["_all"]
    ranked = _ranked(rest, by, _order(seed, "video_id"))
    split = F.when(F.col("rank") <= F.ceil(F.col("size") * val_ratio), "val").otherwise("train")
    return ranked.select("video_id", split.alias("split")).unionByName(test)


def official_split(rows: DataFrame, hint: str = "split_hint") -> DataFrame:
    return rows.where(F.col(hint).isin("train", "val", "test")).withColumn("split", F.col(hint))


def shuffled_split(ids: DataFrame, key: str, ratio: float = 0.1, seed: int = 42) -> DataFrame:
    """(key, split): the first floor(ratio x n) ids of the hash order are val."""
    ranked = _ranked(ids.select(key).distinct().withColumn("_all", F.lit(0)), ["_all"], _order(seed, key))
    return ranked.select(key, F.when(F.col("rank") <= F.floor(F.col("size") * ratio), "val").otherwise("train").alias("split"))


def sampled(ids: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` ids in hash order (top-n, no full sort)."""
    return ids.select(key).distinct().orderBy(_order(seed, key)).limit(n)


def capped_per_source(rows: DataFrame, source: str, key: str, most: int, seed: int = 42) -> DataFrame:
    """At most ``most`` rows of each source, by hash order; the group limit prunes before the exchange."""
    w = Window.partitionBy(source).orderBy(_order(seed, key))
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def equal_source_draws(rows: DataFrame, source: str, key: str, draws: int, seed: int = 42) -> DataFrame:
    """(draw, source, key): draws with replacement, every source equally likely and every row of it too.

    A draw hashes (MD5, so that SQL engines agree) to a source number and a row number; rows are numbered in hash order per source.
    """
    numbered = _ranked(rows.select(source, key), [source], _order(seed, key))
    sources = numbered.groupBy(source).agg(F.max("size").alias("size")).withColumn("_s", F.row_number().over(Window.orderBy(source)) - 1)
    n = sources.count()
    if not n:
        return rows.sparkSession.createDataFrame([], f"draw bigint, {source} string, {key} bigint")
    number = lambda what: F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(what), F.col("id").cast("string"))), 1, 12), 16, 10).cast("bigint")
    d = rows.sparkSession.range(draws).select(F.col("id").alias("draw"), (number("source") % n).cast("int").alias("_s"), number("row").alias("_h"))
    wanted = d.join(sources, "_s").withColumn("rank", F.col("_h") % F.col("size") + 1)
    return wanted.join(numbered.select(source, key, "rank"), [source, "rank"]).select("draw", source, key)


def difference(all_ids: DataFrame, *gone: DataFrame) -> DataFrame:
    """Distinct ids of the first table that are in none of the others."""
    out = all_ids.distinct()
    for other in gone:
        out = out.join(other, all_ids.columns, "left_anti")
    return out


def mixed_videos(rows: DataFrame) -> DataFrame:
    """(video_id, splits) of videos in more than one split: empty where splits are disjoint."""
    per = rows.where("video_id is not null and split is not null").groupBy("video_id").agg(F.min("split").alias("lo"), F.max("split").alias("hi"), F.count_distinct("split").alias("splits"))
    return per.where("lo <> hi").select("video_id", "splits")


def range_split(number: Column) -> Column:
    """The split by the number in a video's id: below 6513 train, below 7010 val, else test."""
    return F.when(number < 6513, "train").when(number < 7010, "val").otherwise("test")


def member_split(ids: DataFrame, key: str, test: DataFrame, train: DataFrame) -> DataFrame:
    """(key, split): test if listed there, else train if listed there, else unused."""
    t = test.select(key).distinct().withColumn("_test", F.lit(True))
    r = train.select(key).distinct().withColumn("_train", F.lit(True))
    joined = ids.join(t, key, "left").join(r, key, "left")
    return joined.select(key, F.when(F.col("_test"), "test").when(F.col("_train"), "train").otherwise("unused").alias("split"))
