"""Sinks: stage tables, reports, logs, exports."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import path_exists


def write_stage(df: DataFrame, path: str, by: str | None = None) -> None:
    """A stage's Parquet table, replaced as a whole, in folders of ``by`` on request."""
    w = df.write.mode("overwrite")
    (w.partitionBy(by) if by else w).parquet(path)


def write_frame_map(rows: DataFrame, path: str) -> None:
    rows.select("video_id", "frame_paths").dropDuplicates(["video_id"]).write.mode("overwrite").json(path)


def write_report(report: DataFrame, path: str) -> None:
    report.coalesce(1).write.mode("overwrite").json(path)


def append_metrics(rows: DataFrame, path: str) -> None:
    """Results are appended; a file has the header once."""
    rows.coalesce(1).write.mode("append").option("header", True).csv(path)


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def append_rows(rows: DataFrame, path: str) -> None:
    """Query log, feedback and vectors: appended rows."""
    rows.write.mode("append").parquet(path)


def query_log(rows: DataFrame) -> DataFrame:
    """Log rows with ids and latencies as JSON text."""
    return rows.select("query_id", "query", "model", F.to_json("result_ids").alias("result_ids_json"), F.to_json("latency").alias("latency_json"))


def only_new(rows: DataFrame, spark: SparkSession, path: str, key: str) -> DataFrame:
    """Rows whose key the table at ``path`` does not have; all of them while there is none. A table that cannot be read
    raises, as all rows would be appended again."""
    if not path_exists(spark, path):
        return rows
    return rows.join(spark.read.parquet(path).select(key).distinct(), key, "left_anti")


def upsert_in_batches(rows: DataFrame, send, size: int = 100) -> None:
    """Calls ``send(list of rows)`` with at most ``size`` rows at a time, on the executors."""
    def run(it):
        part = []
        for r in it:
            part.append(r)
            if len(part) == size:
                send(part)
                part = []
        if part:
            send(part)

    rows.foreachPartition(run)


def markdown_table(df: DataFrame, most: int = 1000) -> str:
    """A small aggregated table as Markdown; more than ``most`` rows raise ValueError."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("too many rows for a report")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows]) + "\n"


def write_markdown(parts: dict[str, DataFrame], path: str) -> None:
    Path(path).write_text("\n".join(f"## {title}\n\n{markdown_table(df)}" for title, df in parts.items()), encoding="utf-8")


def export_folder(source: str, target: str) -> str:
    """Copies a folder: Skipped when there is none, else Success or Failed."""
    import shutil

    if not Path(source).exists():
        return "Skipped"
    try:
        shutil.copytree(source, target, dirs_exist_ok=True)
    except OSError:
        return "Failed"
    return "Success"


def write_data_js(parts: dict[str, DataFrame], path: str, name: str = "DATA", most: int = 100_000) -> None:
    """Small aggregated tables as one JavaScript constant for a static page; more than ``most`` rows raise ValueError."""
    import json

    body = {}
    for k, df in parts.items():
        rows = df.limit(most + 1).select(F.to_json(F.struct(*df.columns))).collect()
        if len(rows) > most:
            raise ValueError(f"too many rows for a page: {k}")
        body[k] = [json.loads(r[0]) for r in rows]
    Path(path).write_text(f"const {name} = {json.dumps(body, ensure_ascii=False)};\n", encoding="utf-8")


def stamped(rows: DataFrame, at=None) -> DataFrame:
    """Rows with ``created_at``: now in UTC, or a given time for reproducible runs."""
    return rows.withColumn("created_at", F.lit(at) if at is not None else F.current_timestamp())
