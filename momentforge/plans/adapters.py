"""Pluggable models: what an adapter offers, and the registry that finds them."""

from __future__ import annotations

import importlib
import threading
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any, Protocol, runtime_checkable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import vector as V
from ..functions.text import search_tokens
from ..operators.localize import localized


@runtime_checkable
class Adapter(Protocol):
    """Encoders run in batches on the executors; ``fuse`` is a Column expression."""

    model_id: str
    embedding_dim: int
    supports_rerank: bool
    supports_localize: bool

    def load(self) -> None: ...
    def encode_text(self, texts: list[str]) -> list[list[float]]: ...
    def encode_window(self, windows: DataFrame) -> DataFrame: ...
    def rerank(self, query: list[float], pool: DataFrame) -> DataFrame: ...
    def localize(self, query: list[float], windows: DataFrame, durations: DataFrame) -> DataFrame: ...
    def fuse(self, stage1: Column, rerank: Column) -> Column: ...


class HashAdapter:
    """A model-free adapter: hashed word vectors, digest jitter as re-ranker, logistic fusion."""

    supports_rerank, supports_localize = True, True

    def __init__(self, model_id: str = "hash", embedding_dim: int = 64):
        self.model_id, self.embedding_dim = model_id, embedding_dim

    def load(self) -> None:
        return None

    def encode_text(self, texts: list[str]) -> list[list[float]]:
        from ..session import SparkSession

        spark = SparkSession.getActiveSession()
        d = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
        return [list(r[1]) for r in d.select("i", V.hash_embedding(search_tokens("t"), self.embedding_dim)).orderBy("i").collect()]

    def encode_window(self, windows: DataFrame) -> DataFrame:
        """(window_id, vector, features, times) of windows (window_id, frame_times, frame_features): the mean of the frames'
        unit vectors, brought to length 1; null without frames."""
        units = F.transform("frame_features", V.unit)
        total = F.aggregate(units, F.array_repeat(F.lit(0.0), self.embedding_dim), lambda s, v: F.zip_with(s, v, lambda a, b: a + b.cast("double")))
        return windows.select("window_id", F.when(F.size("frame_features") > 0, V.unit(total)).alias("vector"), F.col("frame_features").alias("features"), F.col("frame_times").alias("times"))

    def localize(self, query: list[float], windows: DataFrame, durations: DataFrame) -> DataFrame:
        """(video_id, spans, strip) from the frames of the windows."""
        return localized(windows, query, durations)

    def rerank(self, query: list[float], pool: DataFrame) -> DataFrame:
        key = F.lit(",".join(f"{x:.6f}" for x in query[:8]))
        return pool.withColumn("rerank", V.jittered(F.col("stage1"), key, F.col("window_id")))

    def fuse(self, stage1: Column, rerank: Column) -> Column:
        return V.fuse_logistic(stage1, rerank)


class CosineAdapter(HashAdapter):
    """No re-rank stage; a cosine range is stretched to 0..1."""

    supports_rerank = False

    def rerank(self, query: list[float], pool: DataFrame) -> DataFrame:
        raise NotImplementedError(f"{self.model_id} has no re-rank stage")

    def fuse(self, stage1: Column, rerank: Column) -> Column:
        return V.fuse_range(stage1)


class TwoStageAdapter(HashAdapter):
    """A seam for a two-stage model: only fusion is here."""

    def encode_text(self, texts: list[str]) -> list[list[float]]:
        raise NotImplementedError("bring an encoder")

    def encode_window(self, windows: DataFrame) -> DataFrame:
        raise NotImplementedError("bring an encoder")

    def rerank(self, query: list[float], pool: DataFrame) -> DataFrame:
        raise NotImplementedError("bring a re-ranker")

    def fuse(self, stage1: Column, rerank: Column) -> Column:
        return V.fuse_two_stage(stage1, rerank)


@dataclass
class Entry:
    model_id: str
    adapter: str
    enabled: bool = True
    options: dict[str, Any] = field(default_factory=dict)
    status: str = "idle"
    error: str = ""


class Registry:
    """Adapters by id, loaded at first use from ``module:Class``; a failed one keeps its error."""

    def __init__(self, entries: list[dict], default: str | None = None):
        self.entries = {e["model_id"]: Entry(**e) for e in entries}
        self.default = default or next(iter(self.entries), None)
        self._made: dict[str, Adapter] = {}
        self._lock = threading.Lock()

    def get(self, model_id: str | None = None) -> Adapter:
        key = model_id or self.default
        if key not in self.entries or not self.entries[key].enabled:
            raise KeyError(f"404: no model {key}")
        with self._lock:
            if key not in self._made:
                e = self.entries[key]
                try:
                    module, _, name = e.adapter.partition(":")
                    made = getattr(importlib.import_module(module), name)(model_id=key, **e.options)
                    if not isinstance(made, Adapter):
                        raise TypeError(f"{e.adapter} is no adapter")
                    made.load()
                except Exception as x:
                    e.status, e.error = "error", str(x)
                    raise
                e.status = "ready"
                self._made[key] = made
            return self._made[key]

    def listing(self) -> list[dict]:
        return [{"model_id": e.model_id, "status": e.status, "enabled": e.enabled, "error": e.error} for e in self.entries.values()]


def generate(rows: DataFrame, adapter: str, batch: int = 4, prompt: str = "prompt") -> DataFrame:
    """``model_output`` by a text generator named ``module:function`` (list of prompts to list of answers), a few
    prompts at a time, loaded once a Python worker."""
    out = StructType([*rows.schema.fields, StructField("model_output", StringType())])

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        module, _, name = adapter.partition(":")
        do = getattr(importlib.import_module(module), name)
        for pdf in it:
            answers: list[str] = []
            for i in range(0, len(pdf), batch):
                answers += do(pdf[prompt].iloc[i : i + batch].tolist())
            yield pdf.assign(model_output=answers)

    return rows.mapInPandas(run, out)
