"""Exact vector search, grouping, re-ranking and fusion."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vector as V
from ..session import cut as written

#: A block of queries that is sent to every task: at most this many vectors.
MAX_BLOCK = 4096


def candidate_depth(top_k: int, rerank_k: int | None = None) -> tuple[int, int]:
    """(first-stage depth, pool): max(50, 5 k) windows; the pool is what is re-ranked, else k."""
    return max(50, 5 * top_k), max(rerank_k, top_k) if rerank_k else top_k


def check_request(query: str, top_k: int = 10) -> None:
    """Limits of a request; raises ValueError before any plan is made."""
    if not 1 <= len(query.strip()) <= 200:
        raise ValueError("a query has 1 to 200 characters")
    if not 1 <= top_k <= 50:
        raise ValueError("top_k is 1 to 50")


def top_k(gallery: DataFrame, query: list[float], k: int, where: Column | None = None, item: str = "id", vector: str = "vector") -> DataFrame:
    """(item, score) of the ``k`` best by inner product, ties by item; filters apply before the cut."""
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = gallery if where is None else gallery.where(where)
    return rows.select(item, F.round(V.dot(F.col(vector), q), 6).alias("score")).orderBy(F.desc("score"), item).limit(k)


def _blocks(queries: DataFrame, query: str, vector: str, extra: list[str]) -> Iterator[dict]:
    """The queries in blocks of at most MAX_BLOCK vectors; one empty block when there are none."""
    rows = queries.select(query, vector, *extra)
    n = -(-rows.count() * 5 // (4 * MAX_BLOCK))  # hashed blocks vary in size
    rows = written(rows) if n > 1 else rows  # else what the queries come from runs again for every block
    for b in range(max(n, 1)):
        got = rows.where(F.pmod(F.xxhash64(query), F.lit(max(n, 1))) == b).limit(MAX_BLOCK + 1).collect()
        if len(got) > MAX_BLOCK:
            raise ValueError(f"more than {MAX_BLOCK} queries share a block: are ids repeated?")
        yield {"ids": [r[query] for r in got], "v": np.array([r[vector] for r in got], np.float64), "rows": got}


def block_top_k(gallery: DataFrame, queries: DataFrame, k: int, item: str = "id", vector: str = "vector", query: str = "query_id") -> DataFrame:
    """(query, item, score, rank): the ``k`` best items of every query of a stated set, exactly.

    The set goes to the tasks in blocks of bounded size; for each block the gallery is streamed through one
    matrix product a batch, and each batch leaves at most k rows a query; so nothing is crossed and
    only partial top lists are exchanged.
    """
    out = None
    for block in _blocks(queries, query, vector, []):
        part = _block_top_k(gallery, block, queries.schema[query].dataType.simpleString(), k, item, vector, query)
        out = part if out is None else out.unionByName(part)
    return out


def _block_top_k(gallery: DataFrame, block: dict, kind: str, k: int, item: str, vector: str, query: str) -> DataFrame:
    ids, q = block["ids"], block["v"]
    name = gallery.schema[item].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n or not len(ids):
                continue
            v = batch.column(vector).flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.float64)
            s = np.round(q @ v.T, 6)
            items = batch.column(item)
            by_id = np.argsort(np.array(items.to_pylist(), dtype=object if name == "string" else None), kind="stable")
            best = by_id[np.argsort(-s[:, by_id], 1, kind="stable")[:, :k]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.arange(len(ids)), best.shape[1])), items.take(pa.array(best.ravel())), pa.array(np.take_along_axis(s, best, 1).ravel())],
                names=["_q", item, "score"],
            )

    partial = gallery.select(item, vector).mapInArrow(run, f"_q bigint, {item} {name}, score double")
    rank = F.row_number().over(Window.partitionBy("_q").orderBy(F.desc("score"), item))
    top = partial.withColumn("rank", rank).where(F.col("rank") <= k)
    names = gallery.sparkSession.createDataFrame(list(enumerate(ids)), f"_q bigint, {query} {kind}")
    return top.join(F.broadcast(names), "_q").select(query, item, "score", "rank")


def best_per_group(hits: DataFrame, group: str, item: str, score: str = "score") -> DataFrame:
    """The best hit of every group, ties by item."""
    w = Window.partitionBy(group).orderBy(F.desc(score), item)
    return hits.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def dense_rank_of(hits: DataFrame, score: str, item: str, k: int) -> DataFrame:
    """The ``k`` best with ranks 1, 2, ...: the cut comes first, so the window holds k rows."""
    cut = hits.orderBy(F.desc(score), item).limit(k)
    return cut.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), item)))


def search_moments(
    windows: DataFrame, query: list[float], k: int = 10, rerank: Callable[[DataFrame], DataFrame] | None = None, rerank_k: int = 50,
    fuse: Callable[[Column, Column], Column] = lambda s, r: V.fuse_range(s, r), where: Column | None = None, mode: str = "exact",
) -> DataFrame:
    """(video_id, window_id, start_sec, end_sec, stage1, rerank, score, rank): the best window of the ``k`` best videos.

    ``windows`` is (window_id, video_id, start_sec, end_sec, vector). ``exact`` groups by video before anything
    is cut; ``compat`` cuts to the candidate depth first, as an index with windows only would.
    ``rerank`` takes the pool and adds a column ``rerank``; without it the column is null.
    """
    depth, pool_size = candidate_depth(k, rerank_k if rerank else None)
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = windows if where is None else windows.where(where)
    hits = rows.select("window_id", "video_id", "start_sec", "end_sec", F.round(V.dot(F.col("vector"), q), 6).alias("stage1"))
    if mode == "compat":
        hits = hits.orderBy(F.desc("stage1"), "window_id").limit(depth)
    pool = best_per_group(hits, "video_id", "window_id", "stage1").orderBy(F.desc("stage1"), "window_id").limit(pool_size)
    pool = rerank(pool) if rerank else pool.withColumn("rerank", F.lit(None).cast("double"))
    fused = pool.withColumn("score", F.round(fuse(F.col("stage1"), F.col("rerank")), 6))
    return dense_rank_of(fused, "score", "video_id", k)


def numbered(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Rows with their place in a total order: sorted ranges are numbered each and begin after those before, so no
    task sees all rows."""
    ranges = written(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = ranges.groupBy("_part").agg(F.count("*").alias("_n"))
    # one row a range
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranges.withColumn("_own", own).join(F.broadcast(before), "_part").withColumn(name, (F.col("_before") + F.col("_own")).cast("int")).drop("_part", "_own", "_before")


def attach_videos(hits: DataFrame, videos: DataFrame, most: int | None = None) -> DataFrame:
    """Hits with their video's row; hits without one go and the ranks close up. ``most`` says how many hits there can be
    where these are a page of results, else any number is ranked."""
    found, order = hits.drop("rank").join(videos, "video_id"), [F.desc("score"), F.col("video_id")]
    if most is None:
        return numbered(found, order)
    return found.orderBy(*order).limit(most).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def with_features(pool: DataFrame, features: DataFrame) -> DataFrame:
    """The pool with each window's (features, times) of the feature store, null for windows it does not have."""
    return pool.join(features.select("window_id", "features", "times"), "window_id", "left")


def with_times(hits: DataFrame, times: DataFrame) -> DataFrame:
    """Hits (video_id, score) with ``timestamps`` and the middle one of them, ``best_timestamp``; empty and 0 without.
    ``times`` is (video_id, timestamps ARRAY)."""
    t = F.coalesce("timestamps", F.array().cast("array<double>"))
    middle = F.coalesce(F.get(t, F.floor(F.size(t) / 2).cast("int")), F.lit(0.0))
    return hits.join(times, "video_id", "left").withColumns({"timestamps": t, "best_timestamp": middle})


def first_with_caption(videos: DataFrame, query: str) -> DataFrame:
    """The first video (by id) of which a caption equals the query once both are normalized."""
    from ..functions.text import query_key

    one = videos.select("video_id", F.explode(F.split("captions", r"\|")).alias("caption"))
    return one.where(query_key("caption") == query_key(F.lit(query))).agg(F.min("video_id").alias("video_id")).where("video_id is not null")


def rank_changes(run: DataFrame, baseline: DataFrame) -> DataFrame:
    """(video_id, rank, before, change): places won against a baseline run; 'new' where it has none."""
    b = baseline.select("video_id", F.col("rank").alias("before"))
    change = F.when(F.col("before").isNull(), "new").otherwise((F.col("before") - F.col("rank")).cast("string"))
    return run.select("video_id", "rank").join(b, "video_id", "left").select("video_id", "rank", "before", change.alias("change"))


def page(videos: DataFrame, offset: int = 0, limit: int = 24) -> DataFrame:
    """One page, newest first, ties by id."""
    return videos.orderBy(F.desc("created_at"), "video_id").offset(offset).limit(limit)
