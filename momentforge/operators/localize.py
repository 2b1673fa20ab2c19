"""Moments within a video: frame similarity, saliency, islands, span repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vector as V

MAX_SPANS, LEAST_SECONDS, MOST_OVERLAP = 3, 1.0, 0.5
SPAN = "struct<start:double,end:double,score:double>"


def frames(windows: DataFrame) -> DataFrame:
    """(video_id, t, feature): the frames of all windows of a video in time order; a frame within a
    thousandth of a second of the one before goes. ``windows`` is (window_id, video_id, frame_times, frame_features)."""
    return _apart(_each_frame(windows))


def _each_frame(windows: DataFrame) -> DataFrame:
    return windows.where("frame_features is not null and frame_times is not null").select(
        "video_id", "window_id", F.posexplode(F.arrays_zip("frame_times", "frame_features")).alias("i", "x")
    ).select("video_id", "window_id", "i", F.col("x.frame_times").cast("double").alias("t"), F.col("x.frame_features").alias("feature")).where("t is not null and feature is not null")


def _apart(one: DataFrame) -> DataFrame:
    w = Window.partitionBy("video_id").orderBy("t", "window_id", "i")
    before = F.lag("t").over(w)
    return one.withColumn("_d", F.col("t") - before).where("_d is null or _d > 0.001").drop("_d")


def _similarity(query: list[float]) -> Column:
    return F.round(V.dot(V.unit(F.col("feature")), F.array(*[F.lit(float(x)) for x in query])), 9).alias("similarity")


def frame_saliency(windows: DataFrame, query: list[float]) -> DataFrame:
    """``saliency(frames(windows), query)`` with the similarities computed first, so that a frame crosses the exchange of its
    video as two numbers and not as a feature."""
    near = _each_frame(windows).select("video_id", "window_id", "i", "t", _similarity(query))
    return _stretched(_apart(near).select("video_id", "t", "similarity"), "video_id")


def saliency(frames_: DataFrame, query: list[float], key: str = "video_id") -> DataFrame:
    """(key, t, similarity, saliency): similarity of each frame to the query, smoothed with (1/4, 1/2, 1/4)
    and zeros beyond the ends, stretched to 0..1 per series; all ones where a series is flat."""
    return _stretched(frames_.select(key, "t", _similarity(query)), key)


def _stretched(s: DataFrame, key: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy("t")
    smooth = 0.25 * F.lag("similarity", 1, 0.0).over(w) + 0.5 * F.col("similarity") + 0.25 * F.lead("similarity", 1, 0.0).over(w)
    s = s.withColumn("_s", smooth)
    whole = Window.partitionBy(key)
    low, high = F.min("_s").over(whole), F.max("_s").over(whole)
    return s.withColumn("saliency", F.when(high - low > 1e-6, (F.col("_s") - low) / (high - low)).otherwise(1.0)).drop("_s")


def frame_step(frames_: DataFrame, key: str = "video_id") -> DataFrame:
    """(key, step): the median distance of neighbouring frames, 1 for a single one."""
    d = frames_.withColumn("_d", F.col("t") - F.lag("t").over(Window.partitionBy(key).orderBy("t")))
    return d.groupBy(key).agg(F.coalesce(F.median("_d"), F.lit(1.0)).alias("step"))


def islands(series: DataFrame, key: str = "video_id", threshold: float = 0.6) -> DataFrame:
    """(key, start, end, score): runs of saliency at or above the threshold, half a step wider at both
    ends, not before 0, scored by their mean saliency."""
    w = Window.partitionBy(key).orderBy("t")
    above = F.col("saliency") >= threshold
    marked = series.withColumn("_above", above).withColumn("_new", F.when(above & ~F.coalesce(F.lag("_above").over(w), F.lit(False)), 1).otherwise(0))
    marked = marked.withColumn("_island", F.sum("_new").over(w)).where("_above")
    runs = marked.groupBy(key, "_island").agg(F.min("t").alias("_first"), F.max("t").alias("_last"), F.avg("saliency").alias("score"))
    step = frame_step(series, key)
    return runs.join(step, key).select(key, F.greatest(F.col("_first") - F.col("step") / 2, F.lit(0.0)).alias("start"), (F.col("_last") + F.col("step") / 2).alias("end"), "score")


def _span(start: Column, end: Column, score: Column) -> Column:
    return F.struct(start.cast("double").alias("start"), end.cast("double").alias("end"), score.cast("double").alias("score"))


def repaired(spans: Column, duration: Column) -> Column:
    """Ends put in order and inside the video, short spans widened to a second around their middle, empty ones dropped."""
    def one(s: Column) -> Column:
        a, b = F.greatest(F.lit(0.0), F.least(s["start"], s["end"])), F.least(duration, F.greatest(s["start"], s["end"]))
        a2 = F.greatest(F.lit(0.0), (a + b) / 2 - LEAST_SECONDS / 2)
        b2 = F.least(duration, a2 + LEAST_SECONDS)
        short = b - a < LEAST_SECONDS
        return _span(F.when(short, F.greatest(F.lit(0.0), b2 - LEAST_SECONDS)).otherwise(a), F.when(short, b2).otherwise(b), s["score"])

    return F.filter(F.transform(spans, one), lambda s: s["end"] > s["start"])


def _by_score(spans: Column) -> Column:
    """Best first; of equal scores the earlier place stays first."""
    tagged = F.transform(spans, lambda s, i: F.struct((-s["score"]).alias("k"), i.alias("i"), s.alias("s")))
    return F.transform(F.array_sort(tagged), lambda x: x["s"])


def overlap(a: Column, b: Column) -> Column:
    """Shared time over the stretch from the first start to the last end."""
    shared = F.greatest(F.lit(0.0), F.least(a["end"], b["end"]) - F.greatest(a["start"], b["start"]))
    hull = F.greatest(a["end"], b["end"]) - F.least(a["start"], b["start"])
    return F.when(hull > 0, shared / hull).otherwise(0.0)


def clean_spans(spans: Column, duration: Column) -> Column:
    """Repaired spans; of strongly overlapping ones the best stays, other overlaps grow into the better
    span, and the best three remain, rounded. Greedy and per row, so it is a fold over the row's array."""
    empty = F.array().cast(f"array<{SPAN}>")
    kept = F.aggregate(
        _by_score(repaired(spans, duration)), empty,
        lambda acc, s: F.when(F.forall(acc, lambda k: overlap(s, k) <= MOST_OVERLAP), F.concat(acc, F.array(s))).otherwise(acc),
    )

    def merge(acc: Column, s: Column) -> Column:
        touches = lambda m: (s["start"] < m["end"]) & (m["start"] < s["end"])
        first = F.array_min(F.transform(acc, lambda m, i: F.when(touches(m), i)))
        grown = F.transform(acc, lambda m, i: F.when(i == first, _span(F.least(m["start"], s["start"]), F.greatest(m["end"], s["end"]), F.greatest(m["score"], s["score"]))).otherwise(m))
        return F.when(first.isNull(), F.concat(acc, F.array(s))).otherwise(grown)

    best = F.slice(_by_score(F.aggregate(kept, empty, merge)), 1, MAX_SPANS)
    return F.transform(best, lambda s: _span(F.round(s["start"], 2), F.round(s["end"], 2), F.round(s["score"], 3)))


def strip(times: Column, values: Column, duration: Column) -> Column:
    """Saliency at every half second past a whole one: interpolated between samples, 0 outside them,
    cut to 0..1, rounded; null without samples or duration. ``times`` ascend."""
    n = F.greatest(F.ceil(duration).cast("int"), F.lit(1))
    pairs = F.arrays_zip(times.alias("t"), values.alias("v"))

    def at(i: Column) -> Column:
        g = i + F.lit(0.5)
        left = F.element_at(F.filter(pairs, lambda p: p["t"] <= g), -1)
        right = F.element_at(F.filter(pairs, lambda p: p["t"] >= g), 1)
        value = F.when(left["t"] == right["t"], left["v"]).otherwise(left["v"] + (right["v"] - left["v"]) * (g - left["t"]) / (right["t"] - left["t"]))
        inside = (F.size(F.filter(pairs, lambda p: p["t"] <= g)) > 0) & (F.size(F.filter(pairs, lambda p: p["t"] >= g)) > 0)
        return F.round(F.when(inside, V.clamp(value)).otherwise(0.0), 3)

    return F.when((F.size(times) > 0) & (duration > 0), F.transform(F.sequence(F.lit(0), n - 1), at))


def neighbours(windows: DataFrame, best: DataFrame) -> DataFrame:
    """The window before, at and after each video's best one; an unknown best counts as the first.
    ``best`` is (video_id, window_id)."""
    w = Window.partitionBy("video_id").orderBy("start_sec", "window_id")
    numbered = windows.withColumn("_n", F.row_number().over(w))
    named = numbered.join(best.select("video_id", F.col("window_id").alias("_b")), "video_id")
    at = F.coalesce(F.max(F.when(F.col("window_id") == F.col("_b"), F.col("_n"))).over(Window.partitionBy("video_id")), F.lit(1))
    return named.withColumn("_at", at).where(F.abs(F.col("_n") - F.col("_at")) <= 1).drop("_n", "_at", "_b")


def best_time(series: DataFrame, key: str = "video_id") -> DataFrame:
    """(key, t): the time of the most similar frame, the earliest of equals."""
    return series.groupBy(key).agg(F.max_by("t", F.struct("similarity", -F.col("t"))).alias("t"))


def localized(windows: DataFrame, query: list[float], durations: DataFrame) -> DataFrame:
    """(video_id, spans, strip): cleaned spans and the saliency strip of every video that has frames."""
    series = frame_saliency(windows, query)
    spans = islands(series).groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "score"))).alias("spans"))
    curve = series.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("t", "saliency"))).alias("c"))
    d = F.col("duration")
    return (
        curve.join(spans, "video_id", "left").join(durations, "video_id")
        .select("video_id", clean_spans(F.coalesce("spans", F.array().cast(f"array<{SPAN}>")), d).alias("spans"), strip(F.col("c.t"), F.col("c.saliency"), d).alias("strip"))
    )
