"""Scans of annotation files, listings, manifests and results, with declared schemas."""

from __future__ import annotations

import os
import re
import warnings
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..session import path_exists

FULL = "videos array<struct<video_id:string,category:int,url:string,split:string,`start time`:double,`end time`:double>>, sentences array<struct<video_id:string,caption:string>>"
LISTED = "video_id string, clip_name string, video string, caption string, category string"
CAPTIONS = "video_id string, caption string, source string, category string, split_hint string"
RESULTS = "model string, variant string, dataset string, metric_name string, metric_value double, source_file string"
# File kinds in the order in which a video is looked for.
VIDEO_SUFFIXES = [".mp4", ".avi", ".mkv"]


def _there(path: str) -> bool:
    """As ``session.path_exists`` where a session runs; a local look before there is one."""
    spark = SparkSession.getActiveSession()
    return path_exists(spark, path) if spark is not None else os.path.exists(path)


def existing(*paths: str) -> list[str]:
    """The paths that are there; a missing file is skipped with a warning."""
    found = []
    for p in paths:
        if _there(p):
            found.append(p)
        else:
            warnings.warn(f"{p} is missing and was skipped", stacklevel=2)
    return found


def first_existing(folder: str, name: str) -> str | None:
    """``name`` in the folder, in its parent, or anywhere below, in this order; on any file system Spark reads."""
    base = folder.rstrip("/")
    for p in (f"{base}/{name}", f"{base.rsplit('/', 1)[0]}/{name}"):
        if _there(p):
            return p
    if not _there(base):
        return None
    spark = SparkSession.getActiveSession()
    if spark is None:
        return next((str(p) for p in sorted(Path(folder).rglob(name))), None)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(base).select(F.min("path")).first()[0]
    return files if files is None or ":" in base.split("/", 1)[0] else re.sub(r"^file:/*", "/", files)


def one_or_many(c: Column) -> Column:
    """A caption field that is text or a JSON list of texts, as an array."""
    return F.when(c.rlike(r"^\s*\["), F.coalesce(F.from_json(c, "array<string>"), F.array(c))).otherwise(F.array(c))


def scan_full_annotations(spark: SparkSession, paths: list[str], source: str = "MSR-VTT") -> DataFrame:
    """Caption rows of ``{videos, sentences}`` files; a sentence takes its video's category, 'unknown' without one;
    the split hint is test for files with test in their name."""
    d = spark.read.schema(FULL).option("multiLine", True).json(paths).withColumn("_f", F.input_file_name())
    cats = d.select(F.inline("videos")).select("video_id", F.col("category").cast("string").alias("category")).where("video_id is not null").groupBy("video_id").agg(F.min("category").alias("category"))
    rows = d.select("_f", F.inline("sentences")).join(cats, "video_id", "left")
    return rows.select("video_id", "caption", F.lit(source).alias("source"), F.coalesce("category", F.lit("unknown")).alias("category"), F.when(F.element_at(F.split("_f", "/"), -1).contains("test"), "test").otherwise("train").alias("split_hint"))


def scan_listed_annotations(spark: SparkSession, paths: list[str], source: str, split_hint: str | None = None, category: str = "N/A") -> DataFrame:
    """Caption rows of list files; captions may be a text or a list; ids fall back to the clip name, then the file stem."""
    d = spark.read.schema(LISTED).option("multiLine", True).json(paths).withColumn("_f", F.input_file_name())
    vid = F.coalesce("video_id", "clip_name", F.regexp_replace("video", r"\.[^.]*$", ""))
    hint = F.lit(split_hint) if split_hint else F.when(F.element_at(F.split("_f", "/"), -1).contains("test"), "test").otherwise("train")
    rows = d.select(vid.alias("video_id"), F.explode(one_or_many(F.col("caption"))).alias("caption"), F.coalesce("category", F.lit(category)).alias("category"), hint.alias("split_hint"))
    return rows.where("video_id is not null and caption is not null").select("video_id", "caption", F.lit(source).alias("source"), "category", "split_hint")


def scan_splits(spark: SparkSession, files: dict[str, str], source: str = "MSVD") -> DataFrame:
    """The union of one list file a split; missing files are skipped with a warning. Paths may have any scheme."""
    there = set(existing(*files.values()))
    parts = [scan_listed_annotations(spark, [p], source, split) for split, p in files.items() if p in there]
    if not parts:
        return spark.createDataFrame([], CAPTIONS)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def annotation_videos(rows: DataFrame) -> DataFrame:
    """(video_id, captions): one row a video, captions stripped, blank ones out, in row order, or by a column
    ``ordinal`` where the rows have one, as rows of several files have no order of their own."""
    t = F.regexp_replace("caption", r"(?U)^\s+|\s+$", "")
    order = F.col("ordinal") if "ordinal" in rows.columns else F.monotonically_increasing_id()
    numbered = rows.select("video_id", t.alias("caption"), order.alias("_i")).where("caption <> ''")
    return numbered.groupBy("video_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "caption"))), lambda x: x["caption"]).alias("captions"))


def staged_files(spark: SparkSession, folder: str, suffixes: list[str] | None = None) -> DataFrame:
    """(video_id, path, suffix, size) of the files below a folder, without their content."""
    ends = [s.lower() for s in suffixes or VIDEO_SUFFIXES]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.col("length").alias("size"))
    name = F.element_at(F.split("path", "/"), -1)
    d = files.select("path", "size", F.regexp_replace(name, r"\.[^.]*$", "").alias("video_id"), F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)).alias("suffix"))
    return d.where(F.col("suffix").isin(ends) & (F.col("size") > 0))


def video_paths(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Rows with ``path``: the file of the video with the first usual suffix, '' without one."""
    rank = F.lit(len(VIDEO_SUFFIXES))
    for i, s in reversed(list(enumerate(VIDEO_SUFFIXES))):
        rank = F.when(F.col("suffix") == s, i).otherwise(rank)
    first = files.groupBy("video_id").agg(F.min_by("path", F.struct(rank, "path")).alias("path"))
    return rows.join(first, "video_id", "left").withColumn("path", F.coalesce("path", F.lit("")))


def looked_up(names: DataFrame, files: DataFrame) -> DataFrame:
    """(name, path): by file name, else by stem."""
    by_name = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("path").alias("_n")).groupBy("name").agg(F.min("_n").alias("_n"))
    by_stem = files.groupBy(F.col("video_id").alias("_stem")).agg(F.min("path").alias("_s"))
    stem = F.regexp_replace(names["name"], r"\.[^.]*$", "")
    return names.join(by_name, "name", "left").join(by_stem, stem == by_stem["_stem"], "left").select("name", F.coalesce("_n", "_s").alias("path"))


def _first_filled(have: list[str], keys: list[str]) -> Column:
    found = [F.nullif(F.trim(F.col(k)), F.lit("")) for k in keys if k in have]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def scan_manifest_csv(spark: SparkSession, path: str) -> DataFrame:
    """(video, caption) by the first filled of the usual column names; ``.mp4`` is added to names without a
    suffix. Raises ValueError when no row is left."""
    # Accepted column names in order.
    videos, captions = ["video_path", "video", "path", "filename", "videoid"], ["caption", "text", "name", "title"]
    d = spark.read.option("header", True).csv(path)
    d = d.toDF(*[c.lstrip("﻿") for c in d.columns])
    v = _first_filled(d.columns, videos)
    out = d.select(F.when(v.rlike(r"\.[A-Za-z0-9]+$"), v).otherwise(F.concat(v, F.lit(".mp4"))).alias("video"), _first_filled(d.columns, captions).alias("caption")).where("video is not null and caption is not null")
    if out.isEmpty():
        raise ValueError(f"no usable row in {path}")
    return out


def scan_metadata_csv(spark: SparkSession, path: str) -> DataFrame:
    """One row a video id; blank ids go, of a repeated id the last row counts."""
    schema = "video_id string, title string, collection string, source string, license string, captions string"
    d = spark.read.schema(schema).option("header", True).csv(path)
    # a row's place: its file by name, its part of the file, its number within the part
    place = F.struct(F.input_file_name(), F.input_file_block_start(), F.monotonically_increasing_id())
    d = d.withColumn("_i", place).where("trim(video_id) <> ''")
    return d.groupBy("video_id").agg(F.max_by(F.struct("title", "collection", "source", "license", "captions"), "_i").alias("x")).select("video_id", "x.*")


def scan_split_ids(spark: SparkSession, path: str) -> DataFrame:
    """Distinct ids of a split file with a ``video_id`` or ``videoid`` column."""
    d = spark.read.option("header", True).csv(path)
    return d.select(_first_filled(d.columns, ["video_id", "videoid"]).alias("video_id")).where("video_id is not null").distinct()


def scan_embedding_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("video_id string, embed_path string, captions array<string>, split string").option("multiLine", True).json(path)


def zipped(vectors: DataFrame, metadata: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Vectors and their metadata by position; unequal numbers of rows raise ValueError."""
    a, b = vectors.count(), metadata.count()
    if a != b:
        raise ValueError(f"{a} vectors but {b} metadata rows")
    return vectors.join(metadata, ordinal)


def discovered_captions(spark: SparkSession, path: str) -> DataFrame:
    """(row_index, video_id, caption) of any JSON container: a list, or an object with a list under data, items,
    annotations, sentences or videos; the caption is the first of caption, text, sentence, description."""
    raw = spark.read.option("wholetext", True).text(path)
    v = F.try_parse_json("value")
    lists = [F.try_variant_get(v, p, "array<variant>") for p in ("$", "$.data", "$.items", "$.annotations", "$.sentences", "$.videos")]  # fixed values
    items = raw.select(F.posexplode(F.coalesce(*lists)).alias("row_index", "x"))
    get = lambda *ps: F.coalesce(*[F.try_variant_get("x", f"$.{p}", "string") for p in ps])
    return items.select("row_index", get("video_id", "videoid", "id", "video").alias("video_id"), get("caption", "text", "sentence", "description").alias("caption"))


def scan_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RESULTS).option("header", True).csv(path)


def preview_jsonl(spark: SparkSession, path: str, n: int = 5, schema: str | S.StructType = "`index` int, video_id string, caption string, model_output string") -> DataFrame:
    return spark.read.schema(schema).json(path).limit(n)


def load_config(path: str) -> dict:
    """A YAML file with ${NAME} and ${NAME:-default} taken from the environment."""
    import yaml

    def put(m: re.Match) -> str:
        name, _, default = m[1].partition(":-")
        return os.environ.get(name, default)

    return yaml.safe_load(re.sub(r"\$\{([^}]+)\}", put, Path(path).read_text(encoding="utf-8"))) or {}


def copy_report(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """(found, videos): how many named videos have a file."""
    have = files.select("video_id").distinct().withColumn("_f", F.lit(True))
    return wanted.select("video_id").distinct().join(have, "video_id", "left").groupBy(F.coalesce("_f", F.lit(False)).alias("found")).agg(F.count("*").alias("videos"))
