"""Exploratory statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.timeline import aspect

DESCRIBED = ["mean", "std", "min", "p25", "median", "p75", "p95", "max"]


def quantile(v: Column | str, p, exact: bool = True, accuracy: int = 100_000) -> Column:
    """The interpolated quantile of a group, for which one task holds the group's distinct values; or, not exact, a
    value within 1/accuracy of the rank from mergeable sketches, for groups too large for that."""
    return F.percentile(v, p) if exact else F.percentile_approx(v, p, accuracy)


def describe(df: DataFrame, value: Column, by: list[str] | None = None, exact: bool = True) -> DataFrame:
    """mean, sample standard deviation, least, quartiles, 95th percentile (``quantile``), greatest; three digits.
    Null and NaN values are left out."""
    v = F.when(~F.isnan(value.cast("double")), value.cast("double"))
    q = quantile(v, F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75, 0.95)]) if exact else [0.25, 0.5, 0.75, 0.95], exact)
    r = lambda c: F.round(c, 3)
    out = df.groupBy(*(by or [])).agg(r(F.avg(v)).alias("mean"), r(F.stddev_samp(v)).alias("std"), F.min(v).alias("min"), q.alias("_q"), F.max(v).alias("max"))
    return out.select(*(by or []), "mean", "std", r(F.col("min")).alias("min"), *[r(F.get("_q", F.lit(i))).alias(n) for i, n in enumerate(("p25", "median", "p75", "p95"))], r(F.col("max")).alias("max"))


def histogram(df: DataFrame, value: Column, low: float, high: float, bins: int) -> DataFrame:
    """(bin, low, high, count) for all bins; equal widths, the last bin holds its upper edge; values outside are left out."""
    v = value.cast("double")
    width = (high - low) / bins
    at = F.least(F.floor((v - low) / width), F.lit(bins - 1)).cast("int")
    counted = df.where((v >= low) & (v <= high)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    all_bins = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return all_bins.join(counted, "bin", "left").select(
        "bin", F.round(F.col("bin") * width + low, 3).alias("low"), F.round((F.col("bin") + 1) * width + low, 3).alias("high"), F.coalesce("n", F.lit(0)).alias("count")
    )


def per_group_sizes(df: DataFrame, key: str) -> DataFrame:
    """How many groups have how many rows: (size, groups)."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("groups"))


def most_common(df: DataFrame, tokens: Column, k: int, name: str = "token") -> DataFrame:
    """(token, count): the ``k`` most frequent, ties by token."""
    return df.select(F.explode(tokens).alias(name)).groupBy(name).agg(F.count("*").alias("count")).orderBy(F.desc("count"), name).limit(k)


def vocabulary_size(df: DataFrame, tokens: Column) -> DataFrame:
    return df.select(F.explode(tokens).alias("t")).agg(F.count_distinct("t").alias("vocab_size"))


def duplicate_counts(df: DataFrame) -> DataFrame:
    """(rows, distinct_captions, global_duplicates, intra_video_duplicates) of normalized captions."""
    n = df.select("video_id", T.normalize("caption").alias("c")).where("c is not null and video_id is not null")
    per = n.groupBy("c", "video_id").agg(F.count("*").alias("n")).groupBy("c").agg(F.sum("n").alias("n"), F.sum(F.col("n") - 1).alias("intra"))
    return per.agg(F.sum("n").alias("rows"), F.count("*").alias("distinct_captions"), F.sum(F.col("n") - 1).alias("global_duplicates"), F.sum("intra").alias("intra_video_duplicates"))


def pivot_counts(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts by ``row`` and ``column``, zero-filled, the largest totals first."""
    p = df.groupBy(row).pivot(column, values).count().na.fill(0, values)
    total = sum((F.col(v) for v in values[1:]), F.col(values[0]))
    return p.withColumn("total", total).orderBy(F.desc("total"), row)


# The order in which splits are listed.
SPLIT_ORDER = {"train": 0, "train (9k)": 0, "val": 1, "test": 2, "test (1k-A)": 2}


def split_order(c: str) -> Column:
    out = F.lit(9)
    for k, v in SPLIT_ORDER.items():
        out = F.when(F.col(c) == k, v).otherwise(out)
    return out


def split_scheme(df: DataFrame, scheme: str) -> DataFrame:
    """(scheme, split, position, videos, captions) per split."""
    return df.groupBy("split").agg(F.count_distinct("video_id").alias("videos"), F.count("*").alias("captions")).select(F.lit(scheme).alias("scheme"), "split", split_order("split").alias("position"), "videos", "captions")


def availability(checks: DataFrame) -> DataFrame:
    """(split, live, total, live_pct) of (split, status_code): 200 and 401 are live."""
    return checks.groupBy("split").agg(F.count_if(F.col("status_code").isin(200, 401)).alias("live"), F.count("*").alias("total")).withColumn("live_pct", F.round(F.try_divide(100.0 * F.col("live"), F.col("total")), 2))


def media_shapes(videos: DataFrame) -> DataFrame:
    """(aspect, resolution, videos)."""
    r = F.when((F.col("width") > 0) & (F.col("height") > 0), F.concat_ws("x", "width", "height")).otherwise("unknown")
    return videos.groupBy(aspect(F.col("width"), F.col("height")).alias("aspect"), r.alias("resolution")).agg(F.count("*").alias("videos"))


def codec_counts(probes: DataFrame) -> DataFrame:
    """(codec, videos) of probed files (codec), most frequent first in the order of counts; null is no codec."""
    return probes.where("codec is not null").groupBy("codec").agg(F.count("*").alias("videos"))


def mean_vector(df: DataFrame, vector: str, by: list[str]) -> DataFrame:
    """(by, i, mean): element-wise means, one row an element."""
    return df.select(*by, F.posexplode(vector).alias("i", "x")).groupBy(*by, "i").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


def shortest(df: DataFrame, k: int = 5) -> DataFrame:
    """(words, caption): captions with the least number of words, the first ``k`` in order."""
    d = df.select(T.word_count(T.normalize("caption")).alias("words"), T.normalize("caption").alias("caption")).where("caption is not null")
    least = d.agg(F.min("words").alias("words"))
    return d.join(F.broadcast(least), "words").distinct().orderBy("caption").limit(k)


def summary(captions: DataFrame, videos: DataFrame) -> DataFrame:
    """One row: mean words, share within 77 tokens, usual resolution (the smallest of equals), mean duration."""
    c = captions.where("caption is not null").agg(F.round(F.avg(T.word_count("caption")), 6).alias("mean_words"), F.round(100.0 * F.avg(F.when(T.word_token_proxy("caption") <= 77, 1.0).otherwise(0.0)), 6).alias("within_77_pct"))
    v = videos.agg(F.mode(F.concat_ws("x", "width", "height"), True).alias("resolution"), F.round(F.avg(F.when(~F.isnan("duration"), F.col("duration"))), 6).alias("mean_duration"))
    return c.join(F.broadcast(v), F.lit(True))  # one row each


def latency_percentiles(log: DataFrame, exact: bool = True) -> DataFrame:
    """(model, n, p50, p95) per model and, with a null model, over all; ``log`` is (model, latency_json).
    A missing total counts as 0."""
    t = F.coalesce(F.get_json_object("latency_json", "$.total").try_cast("double"), F.lit(0.0))
    d = log.select("model", t.alias("ms"))
    agg = lambda g: g.agg(F.count("*").alias("n"), F.round(quantile("ms", 0.5, exact), 1).alias("p50"), F.round(quantile("ms", 0.95, exact), 1).alias("p95"))
    return agg(d.groupingSets([["model"], []], "model")).select("model", "n", F.coalesce("p50", F.lit(0.0)).alias("p50"), F.coalesce("p95", F.lit(0.0)).alias("p95"))
