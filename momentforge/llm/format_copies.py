"""Records that are equal but for white space, letter case, punctuation and field order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .clips import clip_key, letters_digits


def _key(prefix: str, *names: str):
    """128 bits that name the values of the columns; nulls differ from empty strings."""
    parts = [x for n in names for x in (F.col(n).isNull(), F.col(n))]
    return F.xxhash64(F.lit(1), *parts).alias(prefix + "1"), F.xxhash64(F.lit("two"), *parts).alias(prefix + "2")


def canonical_fields(json_column: str):
    """A JSON object with its fields in one order and its values in one spelling; what is no JSON
    counts as its own text; null stays null."""
    v = F.try_parse_json(F.col(json_column))
    return F.when(F.col(json_column).isNull(), None).otherwise(
        F.coalesce(F.concat(F.lit("j"), F.to_json(v)), F.concat(F.lit("t"), F.col(json_column)))
    )


def survivors_of(df: DataFrame, id_column: str = "row_id", clip: str = "video_id", text: str = "caption", fields: str = "attrs") -> DataFrame:
    """One row per byte-identical raw row: its key (k1, k2), first id, count, and canonical clip, text, fields.

    Only distinct raw rows are canonicalised. The step is map-side combined, so copies that hold a third
    of all rows leave each task as one row. Texts without letter or digit, and null ones, take no part; a
    null clip or a clip without letters equals only its like.
    """
    raw = (
        df.select(F.col(id_column).alias("row_id"), F.col(clip).alias("video_id"), F.col(text).alias("caption"), F.col(fields).alias("attrs"))
        .groupBy("video_id", "caption", "attrs").agg(F.min("row_id").alias("first"), F.count("*").alias("n"))
    )
    return raw.select(
        *_key("k", "video_id", "caption", "attrs"), "first", "n",
        clip_key("video_id").alias("clip"), letters_digits("caption").alias("text"), canonical_fields("attrs").alias("fields"),
    ).where("text <> ''")


def canonical_groups(survivors: DataFrame) -> DataFrame:
    """One row per canonical record, grouped on its full text: clip, text, fields, first_row_id, copies."""
    return survivors.groupBy("clip", "text", "fields").agg(F.min("first").alias("first_row_id"), F.sum("n").alias("copies"))


def collapse(df: DataFrame, **names: str) -> DataFrame:
    """(first_row_id, copies): one row per record, with the number of rows it came in."""
    return canonical_groups(survivors_of(df, **names)).select("first_row_id", "copies")


def copies_of(df: DataFrame, id_column: str = "row_id", clip: str = "video_id", text: str = "caption", fields: str = "attrs") -> DataFrame:
    """(first_row_id, row_id) of every row that repeats an earlier one in other dress.

    Groups are made on the full canonical text. Rows find theirs through 128-bit keys of the raw row and of
    the canonical record; the side that carries the groups has one row per distinct raw row of a
    repeated record, so a hot group is a skewed probe side that the adaptive skew join splits.
    """
    survivors = cut(survivors_of(df, id_column, clip, text, fields))
    groups = canonical_groups(survivors)
    canonical = _key("g", "clip", "text", "fields")
    repeated = groups.where("copies > 1").select(*canonical, "first_row_id")
    where = survivors.select("k1", "k2", *canonical).join(repeated, ["g1", "g2"]).select("k1", "k2", "first_row_id")
    rows = df.select(F.col(id_column).alias("row_id"), F.col(clip).alias("video_id"), F.col(text).alias("caption"), F.col(fields).alias("attrs"))
    return rows.select("row_id", *_key("k", "video_id", "caption", "attrs")).join(where, ["k1", "k2"]).where("row_id <> first_row_id").select("first_row_id", "row_id")
