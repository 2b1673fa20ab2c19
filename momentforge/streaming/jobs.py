"""Structured Streaming operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.vector_index import VectorIndex


def as_events(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Event time as TIMESTAMP: watermarks reject TIMESTAMP_NTZ."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def read_files(spark: SparkSession, path: str, schema, per_batch: int = 10) -> DataFrame:
    """New Parquet files of a folder, at most ``per_batch`` a micro-batch; the checkpoint remembers which are done."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def _limited(times: list[float], recent: list[float], limit: int, window: float) -> tuple[list[bool], list[float]]:
    out = []
    for t in times:
        recent = [r for r in recent if t - r <= window]
        ok = len(recent) < limit
        out.append(ok)
        if ok:
            recent.append(t)
    return out, recent


def rate_limited(hits: DataFrame, limit: int = 30, window: float = 60.0) -> DataFrame:
    """(client, t, allowed): a sliding-window limit per client as a stateful stream.

    A hit is allowed while fewer than ``limit`` allowed hits lie within the window before it; rejected
    hits do not count. ``hits`` is (client STRING, t DOUBLE seconds); hits of one client within a micro-batch
    are taken in time order. The state is the allowed times of the window: ``limit`` numbers at most.
    """
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent = list(state.get[0]) if state.exists else []
        t = sorted(x for pdf in batches for x in pdf["t"])
        ok, recent = _limited(t, recent, limit, window)
        state.update((recent,))
        yield pd.DataFrame({"client": [key[0]] * len(t), "t": t, "allowed": ok})

    return hits.groupBy("client").applyInPandasWithState(step, "client string, t double, allowed boolean", "recent array<double>", "append", GroupStateTimeout.NoTimeout)


def rate_limited_batch(hits: DataFrame, limit: int = 30, window: float = 60.0) -> DataFrame:
    """The same decisions over a finished table (client, t), as a fold of each client's sorted times. A client's
    times are one row, so this form is for tables whose clients have bounded histories."""
    zero = F.struct(F.array().cast("array<double>").alias("recent"), F.array().cast("array<struct<t:double,allowed:boolean>>").alias("out"))

    def step(s, t):
        recent = F.filter(s["recent"], lambda r: t - r <= window)
        ok = F.size(recent) < limit
        return F.struct(F.when(ok, F.concat(recent, F.array(t))).otherwise(recent).alias("recent"), F.concat(s["out"], F.array(F.struct(t.alias("t"), ok.alias("allowed")))).alias("out"))

    folded = hits.groupBy("client").agg(F.array_sort(F.collect_list("t")).alias("ts")).select("client", F.aggregate("ts", zero, step)["out"].alias("o"))
    return folded.select("client", F.inline("o"))


def windowed_latency(events: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(window start, model, n, p50, p95) of a log (ts, model, ms); late rows beyond the watermark are dropped."""
    return (
        as_events(events).withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "model")
        .agg(F.count("*").alias("n"), F.percentile_approx("ms", 0.5).alias("p50"), F.percentile_approx("ms", 0.95).alias("p95"))
        .select(F.col("w.start").alias("window_start"), "model", "n", "p50", "p95")
    )


def latest_state(events: DataFrame) -> DataFrame:
    """(job_id, status, progress): the last state of each job, for update mode."""
    return events.groupBy("job_id").agg(F.max_by(F.struct("status", "progress"), "updated_at").alias("x")).select("job_id", "x.*")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, n): sessions that a gap without events ends."""
    return (
        as_events(events).withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("s"))
        .agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")
    )


def once_per_id(events: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """Repeats of an id within the watermark dropped."""
    return as_events(events).withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def into_index(vectors: DataFrame, path: str, checkpoint: str, order: str | None = None):
    """Upserts every micro-batch into the vector index: redelivered batches change nothing. Of an id repeated in
    a batch the last row by ``order`` stays, else the last of the batch."""
    def put(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            VectorIndex(batch.sparkSession, path).upsert(batch, order)

    return vectors.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append", timeout: int = 300) -> None:
    """Runs a stream over everything that is there into a Parquet folder."""
    q = df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start()
    if not q.awaitTermination(timeout):
        q.stop()
        raise TimeoutError("the stream did not end")


def each_batch(df: DataFrame, do: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update", timeout: int = 300) -> None:
    q = df.writeStream.foreachBatch(do).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    if not q.awaitTermination(timeout):
        q.stop()
        raise TimeoutError("the stream did not end")
