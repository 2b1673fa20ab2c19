"""How clip ids, splits, categories and source videos are read from dirty columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_EDGE = r"(?U)^[\s​﻿]+|[\s​﻿]+$"
_CUT = r"^([A-Za-z0-9_-]{11})_\d+(?:\.\d+)?_\d+(?:\.\d+)?$"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """White space of every kind (no-break space too) off both ends."""
    return F.regexp_replace(_c(x), _EDGE, "")


def letters_digits(x: Column | str) -> Column:
    """Letters and digits only, lower case; null stays null."""
    return F.lower(F.regexp_replace(_c(x), r"[^\p{L}\p{N}]", ""))


def base_name(x: Column | str) -> Column:
    """The id without folders and video extension."""
    s = F.regexp_replace(strip(x), r"(?s)^.*[/\\]", "")
    return strip(F.regexp_replace(s, r"(?i)\.(mp4|avi|mkv)$", ""))


def clip_key(x: Column | str) -> Column:
    """Ids of the same clip have the same key; null for ids without letter or digit."""
    return F.nullif(letters_digits(base_name(x)), F.lit(""))


def split_name(x: Column | str) -> Column:
    """train, val or test; null for anything else."""
    s = F.lower(strip(x))
    return F.when(s.isin("val", "validation"), "val").when(s.isin("train", "test"), s)


def source_key(video_id: Column, url: Column) -> Column:
    """The 11-character key of the source video: from a cut's id, else from the url; else null."""
    own = F.regexp_extract(strip(video_id), _CUT, 1)
    by_v = F.regexp_extract(url, r"[?&]v=([A-Za-z0-9_-]{11})(?![A-Za-z0-9_-])", 1)
    by_path = F.regexp_extract(url, r"/([A-Za-z0-9_-]{11})(?:[/?#&]|\s*$)", 1)
    some = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(some(own), some(by_v), some(by_path))


def clip_sources(ids: DataFrame, videos: DataFrame) -> DataFrame:
    """(clip, source) of every clip named by ``ids.video_id``; a row for each source the clip has.

    The catalogue's spelling of an id counts before that of the records, as a key's letter case
    matters; where several spellings of a clip, or several catalogue rows, have different keys, the clip belongs to
    all of their sources. A clip with neither a cut's id nor a url is its own source.
    """
    seen = (
        ids.select("video_id").distinct()
        .select(clip_key("video_id").alias("clip"), source_key(base_name("video_id"), F.lit(None).cast("string")).alias("own_key"))
        .where("clip is not null").distinct()
    )
    known = (
        videos.select(clip_key("video_id").alias("clip"), source_key(base_name("video_id"), F.col("url")).alias("key"))
        .where("clip is not null and key is not null").distinct()
    )
    keyed = seen.join(known, "clip", "left").groupBy("clip", F.coalesce("key", "own_key").alias("key")).agg(F.lit(1))
    named = keyed.groupBy("clip").agg(F.count("key").alias("keys"))
    # spellings without a key add nothing to a clip that has one
    return keyed.join(named, "clip").where("key is not null or keys = 0").select(
        "clip", F.coalesce(F.concat(F.lit("key:"), F.col("key")), F.concat(F.lit("clip:"), F.col("clip"))).alias("source")
    )


def category_ids(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """(clip, category_id): the category of every clip that has one, one row per clip.

    ``rows`` are collapsed to distinct spellings before anything is joined. Rows of a clip that
    name two categories (the data have none) count for the smaller id.
    """
    c = F.lower(F.regexp_replace(strip("category"), r"(?U)\s+", " "))
    named = targets.select(F.lower(strip("category_name")).alias("name"), F.col("category_id").cast("int").alias("by_name"))
    ids = targets.select(F.col("category_id").cast("int").alias("number"))
    got = (
        rows.select("video_id", "category").where("category is not null and video_id is not null").distinct()
        .select(clip_key("video_id").alias("clip"), c.alias("name"))
        .where("clip is not null").distinct()
        .withColumn("number", F.when(F.col("name").rlike(r"^\d{1,9}(\.0*)?$"), F.regexp_extract("name", r"^(\d+)", 1).cast("int")))
    )
    # 20 fixed rows: the target table is a parameter of the problem, not data that grow
    both = got.join(F.broadcast(named), "name", "left").join(F.broadcast(ids.withColumn("there", F.lit(True))), "number", "left")
    return (
        both.withColumn("category_id", F.coalesce("by_name", F.when(F.col("there"), F.col("number"))))
        .where("category_id is not null").groupBy("clip").agg(F.min("category_id").alias("category_id"))
    )
