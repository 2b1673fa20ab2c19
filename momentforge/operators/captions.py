"""Caption cleaning: validity, duplicates, quality gate, validation report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Which source's row a caption in both keeps.
SOURCE_ORDER = ["MSR-VTT", "MSVD"]


def source_rank(c: str = "source"):
    out = F.lit(len(SOURCE_ORDER))
    for i, name in reversed(list(enumerate(SOURCE_ORDER))):
        out = F.when(F.col(c) == name, i).otherwise(out)
    return out


def normalized(rows: DataFrame, least: int = 3, most: int = 50) -> DataFrame:
    """Rows with their caption in normal form, invalid and null captions left out."""
    n = rows.withColumn("caption", T.normalize("caption")).where(F.col("caption").isNotNull())
    return n.where(T.valid_caption("caption", least, most))


def first_in_video(rows: DataFrame, order: str = "row_id") -> DataFrame:
    """One row per (video_id, caption): the first."""
    w = Window.partitionBy("video_id", "caption").orderBy(order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def first_overall(rows: DataFrame, order: str = "row_id") -> DataFrame:
    """One row per caption: that of the first source, then the first row. A caption that holds a third of
    all rows is cut to one row a task before the exchange by the group limit."""
    w = Window.partitionBy("caption").orderBy(source_rank(), order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def deduplicated(rows: DataFrame, scope: str = "global", order: str = "row_id") -> DataFrame:
    """``scope`` intra: repeats within a video go; global: then repeats across videos and sources too."""
    if scope not in ("intra", "global"):
        raise ValueError("scope must be intra or global")
    inside = first_in_video(rows, order)
    return inside if scope == "intra" else first_overall(inside, order)


def funnel(rows: DataFrame, least: int = 3, most: int = 50) -> DataFrame:
    """One row of counts: total, too_short, too_long, only_stop_words, intra_duplicates,
    cross_duplicates, retained, retained_pct. Duplicates are counted by sizes of groups."""
    n = rows.select("video_id", T.normalize("caption").alias("caption")).where("caption is not null")
    n = n.withColumn("words", T.word_count("caption")).withColumn("stop", T.only_stop_words("caption"))
    flags = n.agg(
        F.count("*").alias("total"), F.count_if(F.col("words") < least).alias("too_short"), F.count_if(F.col("words") > most).alias("too_long"),
        F.count_if(F.col("stop") & F.col("words").between(least, most)).alias("only_stop_words"),
    )
    kept = n.where(F.col("words").between(least, most) & ~F.col("stop"))
    per = kept.groupBy("caption", "video_id").agg(F.count("*").alias("n")).groupBy("caption").agg(F.sum("n").alias("n"), F.count("*").alias("videos"))
    dup = per.agg(F.coalesce(F.sum(F.col("n") - F.col("videos")), F.lit(0)).alias("intra_duplicates"), F.coalesce(F.sum(F.col("videos") - 1), F.lit(0)).alias("cross_duplicates"), F.count("*").alias("retained"))
    # one row each
    return flags.join(F.broadcast(dup), F.lit(True)).withColumn("retained_pct", F.round(F.coalesce(F.try_divide(100.0 * F.col("retained"), F.col("total")), F.lit(0.0)), 2))


def similarity_gate(rows: DataFrame, threshold: float = 0.15) -> DataFrame:
    """Rows with a similarity, of the videos whose best one reaches the threshold. Null and NaN
    similarities go first. Videos below are few or many: an anti join on per-video maxima, pre-aggregated."""
    scored = rows.where(F.col("clip_sim").isNotNull() & ~F.isnan("clip_sim"))
    weak = scored.groupBy("video_id").agg(F.max("clip_sim").alias("_m")).where(F.col("_m") < threshold).select("video_id")
    return scored.join(weak, "video_id", "left_anti")


def with_frames(rows: DataFrame) -> DataFrame:
    return rows.where(F.size("frame_paths") > 0)


def attach_frames(rows: DataFrame, frames: DataFrame) -> DataFrame:
    """Frame lists looked up by video_id alone; rows without frames go."""
    return with_frames(rows.join(frames, "video_id", "left"))


def of_staged(rows: DataFrame, staged: DataFrame) -> DataFrame:
    """Rows whose video is in the listing."""
    return rows.join(staged.select("video_id").distinct(), "video_id", "left_semi")


def missing_files(rows: DataFrame, staged: DataFrame) -> DataFrame:
    """(missing_videos, missing_rows) of rows whose video is not in the listing."""
    gone = rows.join(staged.select("video_id").distinct(), "video_id", "left_anti")
    return gone.agg(F.count_distinct("video_id").alias("missing_videos"), F.count("*").alias("missing_rows"))


def first_videos(rows: DataFrame, n: int, per: str | None = None, order: str = "row_id") -> DataFrame:
    """Rows of the first ``n`` distinct videos by first appearance, per value of ``per`` if given. Videos are
    ranked from their first rows, one row a video."""
    keys = ([per] if per else []) + ["video_id"]
    seen = rows.groupBy(*keys).agg(F.min(order).alias("_first"))
    if per:
        kept = seen.withColumn("_r", F.row_number().over(Window.partitionBy(per).orderBy("_first"))).where(F.col("_r") <= n)
    else:
        kept = seen.orderBy("_first").limit(n)
    cond = rows["video_id"].eqNullSafe(kept["video_id"])
    if per:
        cond = cond & rows[per].eqNullSafe(kept[per])
    return rows.join(kept, cond, "left_semi")


def validation(rows: DataFrame, exact: bool = True) -> DataFrame:
    """(split, source, captions, videos, median_similarity) per split and source; not ``exact``: the median from sketches."""
    from .stats import quantile

    return rows.groupBy("split", "source").agg(
        F.count("*").alias("captions"), F.count_distinct("video_id").alias("videos"),
        # a hair more, so that halves go up however they are stored
        F.round(quantile(F.when(~F.isnan("clip_sim"), F.col("clip_sim")), 0.5, exact) + 1e-10, 4).alias("median_similarity"),
    )


def leaks(rows: DataFrame, examples: int = 5) -> DataFrame:
    """(split_a, split_b, videos, examples): videos in two splits, with the first ids of each pair."""
    per = rows.where("video_id is not null and split is not null").select("video_id", "split").distinct()
    a, b = per.select("video_id", F.col("split").alias("split_a")), per.select("video_id", F.col("split").alias("split_b"))
    both = a.join(b, "video_id").where("split_a < split_b")
    rank = F.row_number().over(Window.partitionBy("split_a", "split_b").orderBy("video_id"))
    few = both.withColumn("_r", rank).where(F.col("_r") <= examples).groupBy("split_a", "split_b").agg(F.array_sort(F.collect_list("video_id")).alias("_e"))
    count = both.groupBy("split_a", "split_b").agg(F.count("*").alias("videos"))
    return count.join(few, ["split_a", "split_b"]).select("split_a", "split_b", "videos", F.array_join("_e", ",").alias("examples"))


def frames_from_video(rows: DataFrame, per_video: int | None = None) -> DataFrame:
    """Frame x caption pairs: one row a caption and each of its first ``per_video`` frames, all of them by default."""
    frames = F.col("frame_paths") if per_video is None else F.slice("frame_paths", 1, per_video)
    return rows.select("row_id", "video_id", "caption", F.explode(frames).alias("frame"))


def first_caption(rows: DataFrame, order: str = "row_id") -> DataFrame:
    """(video_id, caption): the first non-blank caption of every video."""
    good = rows.select("video_id", F.struct(F.col(order), T.clean("caption").alias("caption")).alias("x")).where("video_id is not null and x.caption <> ''")
    return good.groupBy("video_id").agg(F.min("x").alias("x")).select("video_id", "x.caption")


def random_caption(rows: DataFrame, seed: int = 42, epoch: int = 0) -> DataFrame:
    """(video_id, row_id): one caption of every video, chosen by a hash of seed, epoch and row."""
    h = F.md5(F.concat_ws("|", F.lit(f"{seed}|{epoch}"), F.col("row_id").cast("string")))
    return rows.where("video_id is not null").groupBy("video_id").agg(F.min(F.struct(h.alias("h"), "row_id")).alias("x")).select("video_id", "x.row_id")
