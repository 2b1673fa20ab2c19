"""Retrieval evaluation, in-batch losses and run tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .search import _blocks


def truth_ranks(gallery: DataFrame, queries: DataFrame, item: str = "id", vector: str = "vector", query: str = "query_id", truth: str = "truth_id") -> DataFrame:
    """(query, truth, score, rank): where the true item stands for every query of a stated set.

    No gallery is sorted: the rank is 1 plus the items that score higher, or equal with a smaller id.
    Queries whose truth is not in the gallery are skipped. Each batch leaves one count a query.
    """
    own = cut(queries.join(gallery.select(F.col(item).alias(truth), F.col(vector).alias("_tv")), truth))
    kinds = f"_q bigint, {query} {queries.schema[query].dataType.simpleString()}, {truth} {gallery.schema[item].dataType.simpleString()}, score double"
    out = None
    for block in _blocks(own, query, vector, [truth, "_tv"]):
        part = _ranks_of(gallery, block, item, vector, query, truth, kinds)
        out = part if out is None else out.unionByName(part)
    return out


def _ranks_of(gallery: DataFrame, block: dict, item: str, vector: str, query: str, truth: str, kinds: str) -> DataFrame:
    ids, q = block["ids"], block["v"]
    truths = [r[truth] for r in block["rows"]]
    gold = np.round(np.array([float(np.dot(a, np.array(r["_tv"], np.float64))) for a, r in zip(q, block["rows"], strict=True)]), 6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        better = np.zeros(len(ids), np.int64)
        for batch in batches:
            n = batch.num_rows
            if n and len(ids):
                v = batch.column(vector).flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.float64)
                s = np.round(q @ v.T, 6)
                items = np.array(batch.column(item).to_pylist())
                better += ((s > gold[:, None]) | ((s == gold[:, None]) & (items[None, :] < np.array(truths)[:, None]))).sum(1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(ids))), pa.array(better)], names=["_q", "better"])

    counts = gallery.select(item, vector).mapInArrow(run, "_q bigint, better bigint").groupBy("_q").agg(F.sum("better").alias("better"))
    names = gallery.sparkSession.createDataFrame([(i, a, t, float(g)) for i, (a, t, g) in enumerate(zip(ids, truths, gold, strict=True))], kinds)
    return names.join(counts, "_q").select(query, truth, "score", (F.col("better") + 1).alias("rank"))


def retrieval_metrics(ranks: DataFrame, by: list[str] | None = None, percent: bool = False) -> DataFrame:
    """R@1, R@5, R@10, MRR, mean and median rank, and the number of queries; in percent on request."""
    f = 100.0 if percent else 1.0
    hit = lambda k: F.round(F.avg(F.when(F.col("rank") <= k, f).otherwise(0.0)), 6)
    return ranks.groupBy(*(by or [])).agg(
        hit(1).alias("r1"), hit(5).alias("r5"), hit(10).alias("r10"), F.round(F.avg(F.lit(f) / F.col("rank")), 6).alias("mrr"),
        F.round(F.avg("rank"), 6).alias("mean_rank"), F.median("rank").alias("median_rank"), F.count("*").alias("queries"),
    )


def confusion(ranks: DataFrame, gallery_size: int, ks: list[int]) -> DataFrame:
    """(k, tp, fp, fn, tn, precision, recall, f1) with one relevant item a query."""
    k = F.explode(F.array(*map(F.lit, ks))).alias("k")
    r = ranks.select("rank", k).withColumn("hit", F.col("rank") <= F.col("k"))
    n = F.lit(gallery_size)
    c = r.groupBy("k").agg(
        F.count_if("hit").alias("tp"), F.sum(F.greatest(F.when(F.col("hit"), F.col("k") - 1).otherwise(F.col("k")), F.lit(0))).alias("fp"),
        F.count_if(~F.col("hit")).alias("fn"), F.sum(F.greatest(n - F.col("k") - F.when(F.col("hit"), 0).otherwise(1), F.lit(0))).alias("tn"),
    )
    p, rc = F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1)), F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))
    return c.withColumn("precision", F.round(p, 6)).withColumn("recall", F.round(rc, 6)).withColumn("f1", F.round(2 * p * rc / F.greatest(p + rc, F.lit(1e-12)), 6))


def match_curve(ranks: DataFrame, upto: int = 20) -> DataFrame:
    """(k, share): share of queries found within k, k = 1 .. upto."""
    return ranks.select("rank", F.explode(F.sequence(F.lit(1), F.lit(upto))).alias("k")).groupBy("k").agg(F.round(F.avg(F.when(F.col("rank") <= F.col("k"), 1.0).otherwise(0.0)), 6).alias("share"))


def top_frame_score(scores: DataFrame, keys: list[str], score: str = "score", n: int = 2) -> DataFrame:
    """The mean of the ``n`` best frame scores of each group."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score))
    return scores.where(F.col(score).isNotNull()).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).groupBy(*keys).agg(F.avg(score).alias(score))


def weighted_losses(log: DataFrame, by: list[str], loss: str = "loss", n: str = "n") -> DataFrame:
    """Mean loss weighted by batch size, and the samples, per group."""
    return log.groupBy(*by).agg(F.round(F.sum(F.col(loss) * F.col(n)) / F.greatest(F.sum(n), F.lit(1)), 6).alias("mean_loss"), F.sum(n).alias("samples"))


def _lse(by: str) -> tuple[Column, Column]:
    w = Window.partitionBy("batch_id", by)
    top = F.max("logit").over(w)
    return top, top + F.log(F.sum(F.exp(F.col("logit") - top)).over(w))


def contrastive_loss(logits: DataFrame, symmetric: bool = True) -> DataFrame:
    """(batch_id, loss): in-batch contrastive loss with one or several positives a row.

    ``logits`` is (batch_id, i, j, logit, positive): all pairs of a training batch, whose size is bounded by
    training. Rows without positive count 0; both directions are averaged when ``symmetric``.
    """
    def one(by: str) -> DataFrame:
        _, lse = _lse(by)
        part = logits.withColumn("lp", F.col("logit") - lse).withColumn("p", F.col("positive").cast("double"))
        rows = part.groupBy("batch_id", by).agg((-F.sum(F.col("lp") * F.col("p")) / F.greatest(F.sum("p"), F.lit(1.0))).alias("l"))
        return rows.groupBy("batch_id").agg(F.avg("l").alias("loss"))

    a = one("i")
    if not symmetric:
        return a.withColumn("loss", F.round("loss", 6))
    b = one("j").withColumnRenamed("loss", "other")
    return a.join(b, "batch_id").select("batch_id", F.round((F.col("loss") + F.col("other")) / 2, 6).alias("loss"))


def batch_logits(pairs: DataFrame, temperature: float = 0.07) -> DataFrame:
    """(batch_id, i, j, logit, positive) of pairs (batch_id, i, group, a, b): all pairs within a batch;
    rows of the same group are positives of each other."""
    from ..functions.vector import dot

    left = pairs.select("batch_id", "i", F.col("group").alias("gi"), "a")
    right = pairs.select("batch_id", F.col("i").alias("j"), F.col("group").alias("gj"), "b")
    return left.join(right, "batch_id").select("batch_id", "i", "j", (dot(F.col("a"), F.col("b")) / temperature).alias("logit"), (F.col("gi") == F.col("gj")).alias("positive"))


def compared(before: DataFrame, after: DataFrame) -> DataFrame:
    """(metric, before, after, change) of two (metric, value) tables."""
    a = after.select("metric", F.col("value").alias("after"))
    return before.select("metric", F.col("value").alias("before")).join(a, "metric").withColumn("change", F.round(F.col("after") - F.col("before"), 6))
