"""From uploads to vectors: probes, archives, embedding, reindexing; encoders and decoders are seams."""

from __future__ import annotations

import importlib
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vector as V
from ..session import path_exists

PROBE = "path string, duration double, width int, height int, has_video boolean"


def probed(files: DataFrame, probe: str) -> DataFrame:
    """(path, duration, width, height, has_video) of files (path, content BINARY) by a function ``module:name`` of
    the bytes that returns a dict; a file it cannot read has nulls and no video."""
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        module, _, name = probe.partition(":")
        do = getattr(importlib.import_module(module), name)
        for pdf in it:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    x = do(content)
                except Exception:  # noqa: BLE001 - whatever a decoder raises
                    x = {}
                rows.append((path, x.get("duration"), x.get("width"), x.get("height"), bool(x.get("has_video", False))))
            out = pd.DataFrame(rows, columns=["path", "duration", "width", "height", "has_video"])
            yield out.astype({"width": "Int32", "height": "Int32", "duration": "Float64"})

    return files.select("path", "content").mapInPandas(run, PROBE)


def archive_members(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(archive, name, video_id, content) of the members of zip files whose stem is a wanted video_id.

    Archives are read by the executors, one a row; wanted ids meet the members in a semi join.
    """
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for m in z.infolist():
                        if not m.is_dir():
                            stem = m.filename.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                            yield pd.DataFrame({"archive": [p], "name": [m.filename], "video_id": [stem], "content": [z.read(m)]})

    members = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "archive string, name string, video_id string, content binary")
    return members.join(wanted.select("video_id").distinct(), "video_id", "left_semi").select("archive", "name", "video_id", "content")


def embedded(windows: DataFrame, models: list[tuple[str, str]], done: DataFrame | None = None) -> DataFrame:
    """(model_id, window_id, video_id, start_sec, end_sec, vector) for every model and window not yet ``done``.

    ``models`` is a short list of (model_id, ``module:function``), the function taking a pandas frame of
    windows and returning vectors. Each model is one branch, so no window is crossed with a table.
    """
    out = None
    for model_id, encoder in models:
        rows = windows.select("window_id", "video_id", "start_sec", "end_sec").withColumn("model_id", F.lit(model_id))
        if done is not None:
            rows = rows.join(done.select("model_id", "window_id"), ["model_id", "window_id"], "left_anti")

        def run(it: Iterator[pd.DataFrame], encoder: str = encoder) -> Iterator[pd.DataFrame]:
            module, _, name = encoder.partition(":")
            do = getattr(importlib.import_module(module), name)
            for pdf in it:
                yield pdf.assign(vector=[[float(x) for x in v] for v in do(pdf)])[["model_id", "window_id", "video_id", "start_sec", "end_sec", "vector"]]

        part = rows.select("model_id", "window_id", "video_id", "start_sec", "end_sec").mapInPandas(run, "model_id string, window_id string, video_id string, start_sec double, end_sec double, vector array<float>")
        out = part if out is None else out.unionByName(part)
    return out


def progress(windows: DataFrame, vectors: DataFrame, models: int) -> DataFrame:
    """(video_id, windows, vectors, progress): the share of a video's windows that have their vectors."""
    w = windows.groupBy("video_id").agg(F.count("*").alias("windows"))
    v = vectors.groupBy("video_id").agg(F.count("*").alias("vectors"))
    n = F.coalesce("vectors", F.lit(0))
    return w.join(v, "video_id", "left").select("video_id", "windows", n.alias("vectors"), F.round(n / (F.col("windows") * models), 4).alias("progress"))


def to_reindex(videos: DataFrame, windows: DataFrame, collection: str) -> DataFrame:
    """Windows of the ready videos of a collection."""
    ready = videos.where((F.col("collection_id") == collection) & (F.lower(F.trim("status")) == "ready"))
    return windows.join(ready.select("video_id"), "video_id", "left_semi")


def unit_vectors_only(vectors: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """Raises ValueError unless all vectors have length 1: the index stores what it is given."""
    bad = vectors.where(F.abs(V.norm(F.col("vector")) - 1) > tolerance).limit(1).count()
    if bad:
        raise ValueError("vectors must have length 1")
    return vectors


def answered(queries: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(queries whose video is in the manifest, (kept, skipped) counts)."""
    have = manifest.select("video_id").distinct()
    marked = queries.join(have.withColumn("_h", F.lit(True)), "video_id", "left")
    counts = marked.agg(F.count_if(F.coalesce("_h", F.lit(False))).alias("kept"), F.count_if(F.col("_h").isNull()).alias("skipped"))
    return queries.join(have, "video_id", "left_semi"), counts


def headline(models: DataFrame, view: DataFrame, dataset: str, metric: str = "R@1") -> DataFrame:
    """(model_id, label, value): each model's figure of the benchmark view by its label; null without one."""
    v = view.where((F.col("dataset") == dataset) & (F.col("metric") == metric)).select(F.col("model").alias("label"), "value")
    return models.join(v, "label", "left").select("model_id", "label", "value")


def residual(x: Column, f: Column, weight: float = 0.1) -> Column:
    """x + weight f, brought to length 1: an adapter's output from its input and its layer's output."""
    return V.unit(F.zip_with(x, f, lambda a, b: a.cast("double") + weight * b.cast("double")))


def short_id(prefix: str, *parts: Column) -> Column:
    """A reproducible id of twelve hex digits from the parts."""
    return F.concat(F.lit(prefix), F.substring(F.md5(F.concat_ws("|", *parts)), 1, 12))


def tagged(rows: DataFrame, tagger: str, text: str = "caption") -> DataFrame:
    """(tag, count) by a tagger ``module:function`` from texts to lists of tags, counted over all rows."""
    @F.pandas_udf("array<string>")
    def tags(s: pd.Series) -> pd.Series:
        module, _, name = tagger.partition(":")
        do = getattr(importlib.import_module(module), name)
        return pd.Series([do(x) if x is not None else [] for x in s])

    return rows.select(F.explode(tags(F.col(text))).alias("tag")).groupBy("tag").agg(F.count("*").alias("count"))


def ensure_table(spark: SparkSession, path: str, schema: str) -> bool:
    """Writes an empty table unless there is one; whether it was made."""
    if path_exists(spark, path):
        return False
    spark.createDataFrame([], schema).write.parquet(path)
    return True
