"""The service calls as functions that return DataFrames."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import benchmarks, ingest, localize, search, stats, vector_index
from .adapters import Registry


# File types of an upload by suffix.
UPLOADS = {".mp4": ["video/mp4", "application/octet-stream"], ".mov": ["video/quicktime", "application/octet-stream"], ".webm": ["video/webm", "application/octet-stream"]}


class ServiceError(Exception):
    """An error with the code that the web service would answer."""

    def __init__(self, code: int, what: str):
        super().__init__(f"{code}: {what}")
        self.code = code


@dataclass
class Service:
    """Calls over tables: videos, windows (window_id, video_id, start_sec, end_sec, vector, frame_times,
    frame_features), collections and a log."""

    spark: SparkSession
    videos: DataFrame
    windows: DataFrame
    registry: Registry
    jobs: DataFrame | None = None
    feedback: DataFrame | None = None
    most_bytes: int = 200 * 1024 * 1024
    most_seconds: float = 300.0

    def health(self) -> dict:
        return {"status": "ok"}

    def models(self) -> list[dict]:
        return self.registry.listing()

    def collections(self) -> DataFrame:
        return vector_index.collection_counts(self.videos)

    def _windows(self, collection: str | None) -> DataFrame:
        if not collection:
            return self.windows
        own = self.videos.where(F.col("collection_id") == collection)
        if own.isEmpty():
            raise ServiceError(404, f"no collection {collection}")
        return self.windows.join(own.select("video_id"), "video_id", "left_semi")

    def search(self, query: str, top_k: int = 10, model: str | None = None, collection: str | None = None, rerank: bool = False, spans: bool = True) -> DataFrame:
        """Ranked videos with links, and, from an adapter that localizes, ``spans`` and the saliency ``strip`` found in the best
        window and its neighbours; the thumbnail then is of the first span."""
        try:
            search.check_request(query, top_k)
        except ValueError as e:
            raise ServiceError(422, str(e)) from e
        try:
            adapter = self.registry.get(model)
        except KeyError as e:
            raise ServiceError(404, f"no model {model}") from e
        w = self._windows(collection)
        if w.isEmpty():
            raise ServiceError(409, "nothing is indexed")
        q = adapter.encode_text([query])[0]
        again = (lambda pool: adapter.rerank(q, pool)) if rerank and adapter.supports_rerank else None
        hits = search.search_moments(w, q, top_k, again, fuse=adapter.fuse)
        found = search.attach_videos(hits, self.videos.select("video_id", "title"), top_k)
        at = F.col("start_sec")
        if spans and adapter.supports_localize:
            around = localize.neighbours(self.windows, found.select("video_id", "window_id"))
            found = found.join(adapter.localize(q, around, self.videos.select("video_id", "duration")), "video_id", "left")
            at = F.coalesce(F.get("spans", F.lit(0))["start"], at)
        return found.withColumn("url", T.media_url(F.col("video_id"), F.col("start_sec"))).withColumn("thumbnail", T.thumbnail_url(F.col("video_id"), at))

    def video(self, video_id: str) -> DataFrame:
        """The video's row with its ``windows`` in time order."""
        found = self.videos.where(F.col("video_id") == video_id)
        if found.isEmpty():
            raise ServiceError(404, f"no video {video_id}")
        own = self.windows.where(F.col("video_id") == video_id).groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("start_sec", "end_sec", "window_id"))).alias("windows"))
        return found.join(own, "video_id", "left").withColumn("windows", F.coalesce("windows", F.array().cast("array<struct<start_sec:double,end_sec:double,window_id:string>>")))

    def upload(self, filename: str, content_type: str, size: int, probe: dict | None, title: str | None = None) -> tuple[str, str]:
        """(video_id, job_id) of an upload that was received and probed; its video and job rows are queued. ``probe``
        is what the decoder says: duration, width, height, has_video, or None when it cannot read the file."""
        suffix = "." + filename.rsplit(".", 1)[-1].lower() if "." in filename else ""
        if content_type.split(";")[0].strip().lower() not in UPLOADS.get(suffix, ()):
            raise ServiceError(415, "an MP4, MOV or WebM video is needed")
        if size > self.most_bytes:
            raise ServiceError(413, "the file is too large")
        if size == 0:
            raise ServiceError(400, "the file is empty")
        if not probe or not probe.get("has_video") or not (probe.get("duration") or 0) > 0:
            raise ServiceError(415, "no video can be read from the file")
        if probe["duration"] > self.most_seconds:
            raise ServiceError(413, "the video is too long")
        video_id, job_id = f"up_{uuid.uuid4().hex[:12]}", f"job_{uuid.uuid4().hex[:12]}"
        row = self.spark.createDataFrame([(video_id, "uploads", (title or "").strip()[:120] or None, filename, float(probe["duration"]), "queued")], "video_id string, collection_id string, title string, _file string, duration double, status string")
        row = row.withColumn("title", F.coalesce("title", T.clean_title(F.col("_file")))).drop("_file").withColumn("created_at", F.current_timestamp())
        self.videos = self.videos.unionByName(row, allowMissingColumns=True)
        self._add_job(job_id, video_id, 0.05, "Waiting for a worker")
        return video_id, job_id

    def _add_job(self, job_id: str, video_id: str | None, progress: float, detail: str) -> None:
        row = self.spark.createDataFrame([(job_id, video_id, "queued", progress, detail)], "job_id string, video_id string, status string, progress double, step_detail string")
        row = row.withColumn("updated_at", F.current_timestamp())
        self.jobs = row if self.jobs is None else self.jobs.unionByName(row, allowMissingColumns=True)

    def job(self, job_id: str) -> DataFrame:
        """The last state of a job."""
        own = None if self.jobs is None else self.jobs.where(F.col("job_id") == job_id)
        if own is None or own.isEmpty():
            raise ServiceError(404, f"no job {job_id}")
        return own.orderBy(F.desc("updated_at"), F.desc("progress")).limit(1)

    def give_feedback(self, query_id: str, video_id: str, relevant: bool, span: tuple[float, float] | None = None) -> dict:
        if self.videos.where(F.col("video_id") == video_id).isEmpty():
            raise ServiceError(404, f"no video {video_id}")
        row = self.spark.createDataFrame([(query_id, video_id, relevant, *(span or (None, None)))], "query_id string, video_id string, relevant boolean, span_start double, span_end double")
        self.feedback = row if self.feedback is None else self.feedback.unionByName(row)
        return {"status": "recorded"}

    def reindex(self, model: str, collection: str) -> tuple[str, DataFrame]:
        """(job_id, the windows of the collection's ready videos to embed again)."""
        try:
            self.registry.get(model)
        except KeyError as e:
            raise ServiceError(404, f"no model {model}") from e
        if self.videos.where(F.col("collection_id") == collection).isEmpty():
            raise ServiceError(404, f"no collection {collection}")
        job_id = f"job_{uuid.uuid4().hex[:12]}"
        self._add_job(job_id, None, 0.0, f"Reindex {collection} with {model}")
        return job_id, ingest.to_reindex(self.videos, self.windows, collection)

    def localize(self, video_id: str, query: str, model: str | None = None) -> DataFrame:
        w = self.windows.where(F.col("video_id") == video_id)
        if self.videos.where(F.col("video_id") == video_id).isEmpty():
            raise ServiceError(404, f"no video {video_id}")
        if w.isEmpty():
            raise ServiceError(409, "nothing is indexed")
        q = self.registry.get(model).encode_text([query])[0]
        return localize.localized(w, q, self.videos.select("video_id", "duration"))

    def ask(self, video_id: str, query: str, model: str | None = None) -> DataFrame:
        found = self.localize(video_id, query, model)
        return found.select("video_id", T.grounded_answer(F.lit(query), F.col("spans")).alias("answer"), "spans")

    def compare(self, query: str, models: list[str], top_k: int = 10) -> DataFrame:
        """Runs of two or three models with the places each video won against the first."""
        if not 2 <= len(models) <= 3:
            raise ServiceError(422, "two or three models are compared")
        if not 1 <= top_k <= 20:
            raise ServiceError(422, "top_k is 1 to 20")
        runs = [self.search(query, top_k, m) for m in models]
        out = None
        for m, run in zip(models, runs, strict=True):
            part = search.rank_changes(run, runs[0]).withColumn("model", F.lit(m))
            out = part if out is None else out.unionByName(part)
        return out

    def ground_truth(self, query: str) -> DataFrame:
        return search.first_with_caption(self.videos, query)

    def benchmarks(self, results: DataFrame, rules: list[dict], dataset: str | None = None, model: str | None = None) -> DataFrame:
        return benchmarks.benchmark_view(results, rules, dataset, model)

    def list_videos(self, offset: int = 0, limit: int = 24) -> DataFrame:
        return search.page(self.videos, offset, limit)

    def latency(self, log: DataFrame) -> DataFrame:
        return stats.latency_percentiles(log)

    def delete_video(self, video_id: str) -> None:
        gone = self.spark.createDataFrame([(video_id,)], "video_id string")
        kept = vector_index.cascade({"videos": self.videos, "windows": self.windows}, gone)
        self.videos, self.windows = kept["videos"], kept["windows"]

    def create_collection(self, collections: DataFrame, collection_id: str, name: str) -> DataFrame:
        import re

        if not re.fullmatch(r"[a-z0-9][a-z0-9_-]{0,62}", collection_id):
            raise ServiceError(422, "a collection id has lower-case letters, digits, - and _")
        if not collections.where(F.col("id") == collection_id).isEmpty():
            raise ServiceError(409, f"{collection_id} exists")
        return collections.unionByName(self.spark.createDataFrame([(collection_id, name)], "id string, name string"), allowMissingColumns=True)
