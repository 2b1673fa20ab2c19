"""A vector index and a feature store as versioned Parquet directories, and catalogue tables."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def last_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of every key by ``order``."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_r = 1").drop("_r")


def first_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of every key by ``order``: duplicates dropped in a stated order."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order)))).where("_r = 1").drop("_r")


def upserted(old: DataFrame, new: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` in place of or beside its own; of a key repeated in ``new`` the last, by the
    column ``order``, else by the place in ``new`` (that of a local table or of one file; several files need ``order``)."""
    fresh = last_per_key(new, key, order) if order else last_per_key(new.withColumn("_o", F.monotonically_increasing_id()), key, "_o").drop("_o")
    return old.join(fresh.select(key), key, "left_anti").unionByName(fresh.select(*old.columns))


def deleted(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(ids.select(key), key, "left_anti")


def window_rows(videos: DataFrame, width: float = 10.0, stride: float = 5.0) -> DataFrame:
    """(window_id, video_id, start_sec, end_sec) of every video with a duration; ids are ``<video>_w<nnn>``."""
    from ..functions.timeline import windows

    w = videos.select("video_id", F.posexplode(windows(F.col("duration"), width, stride)).alias("i", "w"))
    return w.select(F.format_string("%s_w%03d", "video_id", "i").alias("window_id"), "video_id", F.col("w.start").alias("start_sec"), F.col("w.end").alias("end_sec"))


def replaced_windows(old: DataFrame, videos: DataFrame) -> DataFrame:
    """All windows of the given videos replaced by fresh ones."""
    fresh = window_rows(videos)
    return old.join(videos.select("video_id").distinct(), "video_id", "left_anti").select(*fresh.columns).unionByName(fresh)


def cascade(tables: dict[str, DataFrame], videos: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the videos to remove; tables are keyed by video_id."""
    gone = videos.select("video_id").distinct()
    return {name: t.join(gone, "video_id", "left_anti") for name, t in tables.items()}


def imported(files: DataFrame, metadata: DataFrame, existing: DataFrame, force: bool = False) -> DataFrame:
    """(video_id, title, status, action): what a folder import does with every file.

    A ready video is skipped unless forced; other files are queued; the title comes from the metadata,
    else from the file name.
    """
    from ..functions.text import clean_title

    f = files.select("video_id", "path").join(metadata.select("video_id", F.col("title").alias("_m")), "video_id", "left").join(existing.select("video_id", F.col("status").alias("_s")), "video_id", "left")
    skip = (F.lower(F.col("_s")) == "ready") & F.lit(not force)
    skip = F.coalesce(skip, F.lit(False))
    return f.select("video_id", F.coalesce("_m", clean_title(F.col("path"))).alias("title"), F.when(skip, "ready").otherwise("queued").alias("status"), F.when(skip, "skip").when(F.col("_s").isNull(), "insert").otherwise("update").alias("action"))


def latest_jobs(events: DataFrame) -> DataFrame:
    """The last state of every job: (job_id, status, progress, updated_at)."""
    return events.groupBy("job_id").agg(F.max_by(F.struct("status", "progress", "updated_at"), F.struct("updated_at", "progress")).alias("x")).select("job_id", "x.*")


def collection_counts(videos: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """(collection_id, videos, ready) per collection."""
    return videos.where("collection_id is not null").groupBy("collection_id").agg(F.count("*").alias("videos"), F.count_if(F.lower(F.trim("status")) == "ready").alias("ready"))


def index_counts(vectors: DataFrame) -> DataFrame:
    """(model_id, collections MAP): vectors per collection, one map a model."""
    c = vectors.groupBy("model_id", "collection_id").agg(F.count("*").alias("n"))
    return c.groupBy("model_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("collection_id", "n")))).alias("collections"))


# The collections that a new catalogue has.
DEFAULT_COLLECTIONS = [
    ("msrvtt-1ka", "MSR-VTT 1k-A", "Clips from the MSR-VTT 1k-A test set."),
    ("msvd-test", "MSVD test", "Clips from the MSVD test split."),
    ("uploads", "Your uploads", "Videos uploaded through this site."),
]


def with_default_collections(collections: DataFrame) -> DataFrame:
    """(id, name, description) with the default collections that are missing; those that are there stay as they are."""
    default = collections.sparkSession.createDataFrame(DEFAULT_COLLECTIONS, "id string, name string, description string")
    return collections.select("id", "name", "description").unionByName(default.join(collections.select("id"), "id", "left_anti"))


class VectorIndex:
    """Rows (id, vector, video_id, start_sec, end_sec) below ``path`` as immutable segments, newest last.

    An upsert or a delete writes a segment of its own rows or ids only; the newest row of an id counts, which older
    segments learn from anti joins with the ids of the newer ones. More than ``most_segments`` are merged into one.
    Manifests are numbered files that list the segments; a writer claims the number after the one it has read, which only one
    can create, and adds its segment to the newer manifest if another was faster, so no update is lost. What older manifests
    list stays for their readers.
    """

    SCHEMA = "id string, vector array<float>, video_id string, start_sec double, end_sec double"

    def __init__(self, spark: SparkSession, path: str, key: str = "id", schema: str | None = None, most_segments: int = 8):
        self.spark, self.path, self.key, self.most_segments = spark, path.rstrip("/"), key, most_segments
        self.schema = schema or self.SCHEMA

    def _file(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest/{name}".rstrip("/"))
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _current(self) -> tuple[int, list[str]]:
        """(number, segments) of the newest manifest; (0, []) before the first."""
        folder, fs = self._file("")
        names = [x.getPath().getName() for x in fs.listStatus(folder)] if fs.exists(folder) else []
        number = max((int(n.removesuffix(".segments")) for n in names if n.endswith(".segments")), default=0)
        if not number:
            return 0, []
        lines = self.spark.read.text(f"{self.path}/manifest/{number}.segments").collect()  # a line
        return number, json.loads(lines[0][0])

    def _publish(self, number: int, segments: list[str]) -> bool:
        """Whether this writer was the one to make manifest ``number``."""
        claim, fs = self._file(str(number))
        fs.mkdirs(claim.getParent())
        if not fs.createNewFile(claim):
            return False
        out = fs.create(self._file(f"{number}.segments")[0], False)
        out.write(json.dumps(segments).encode())
        out.close()
        return True

    def _segment(self, name: str) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, _gone boolean").parquet(f"{self.path}/{name}")

    def _live(self, segments: list[str]) -> DataFrame:
        out, newer = self.spark.createDataFrame([], f"{self.schema}, _gone boolean"), None
        for name in reversed(segments):
            rows = self._segment(name)
            out = out.unionByName(rows if newer is None else rows.join(newer, self.key, "left_anti"))
            newer = rows.select(self.key) if newer is None else newer.union(rows.select(self.key))
        return out.where("not _gone").drop("_gone")

    def rows(self) -> DataFrame:
        return self._live(self._current()[1])

    def _write(self, rows: DataFrame) -> str:
        name = "v" + uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/{name}")
        return name

    def _append(self, rows: DataFrame, attempts: int = 50) -> None:
        name = self._write(rows)
        for _ in range(attempts):
            number, segments = self._current()
            if self._publish(number + 1, [*segments, name]):
                if len(segments) + 1 > self.most_segments:
                    self.compact()
                return
            time.sleep(0.1)
        raise RuntimeError("other writers were faster each time, or one ended between its claim and its manifest")

    def compact(self) -> bool:
        """One segment instead of many; False if another writer was faster, which leaves all as it was."""
        number, segments = self._current()
        return self._publish(number + 1, [self._write(self._live(segments).withColumn("_gone", F.lit(False)))])

    def upsert(self, new: DataFrame, order: str | None = None) -> None:
        none = self.spark.createDataFrame([], self.schema)
        self._append(upserted(none, new, self.key, order).withColumn("_gone", F.lit(False)))

    def delete(self, ids: DataFrame) -> None:
        fields = self.spark.createDataFrame([], self.schema).schema
        gone = ids.select(self.key).distinct()
        self._append(gone.select(*[F.col(f.name) if f.name == self.key else F.lit(None).cast(f.dataType).alias(f.name) for f in fields], F.lit(True).alias("_gone")))

    def clear(self) -> None:
        """No rows any more."""
        while not self._publish(self._current()[0] + 1, []):
            time.sleep(0.1)

    def count(self) -> int:
        return self.rows().count()

    def search(self, query: list[float], k: int, video_id: str | None = None) -> DataFrame:
        from .search import top_k

        return top_k(self.rows(), query, k, None if video_id is None else F.col("video_id") == video_id)


class FeatureStore:
    """(model_id, window_id, features, times), a folder a model."""

    SCHEMA = "window_id string, features array<array<float>>, times array<float>"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _model(self, model_id: str) -> VectorIndex:
        return VectorIndex(self.spark, f"{self.path}/{model_id}", "window_id", self.SCHEMA)

    def put(self, model_id: str, rows: DataFrame) -> None:
        self._model(model_id).upsert(rows)

    def get_many(self, model_id: str, ids: DataFrame) -> DataFrame:
        return self._model(model_id).rows().join(ids, "window_id", "left_semi")

    def delete(self, model_id: str, ids: DataFrame) -> None:
        self._model(model_id).delete(ids)

    def drop_model(self, model_id: str) -> None:
        self._model(model_id).clear()


def get_index(spark: SparkSession, root: str, model_id: str, collection_id: str, backend: str = "parquet") -> VectorIndex:
    """The index of a model and collection by backend; other stores are seams that raise, unknown names are errors."""
    if backend == "parquet":
        return VectorIndex(spark, f"{root.rstrip('/')}/{model_id}/{collection_id}")
    if backend in ("chroma", "pinecone"):
        raise NotImplementedError(f"{backend}: bring a client with upsert, delete, count and search")
    raise ValueError(f"unknown index backend: {backend}")
