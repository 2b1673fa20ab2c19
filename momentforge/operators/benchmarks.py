"""The long table of results as a benchmark view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The metrics and datasets of the view by their name in the results, metrics where less is better, and ms a second.
METRICS = {"R@1": "R@1", "R@5": "R@5", "R@10": "R@10", "MRR": "MRR", "MedianRank": "MedR", "MedR": "MedR", "MeanRank": "MeanR", "MeanR": "MeanR", "R1@0.5": "R1@0.5", "R1@0.7": "R1@0.7", "mIoU": "mIoU"}
DATASETS = {"MSVD": "MSVD", "MSRVTT": "MSR-VTT", "MSR-VTT": "MSR-VTT"}
LOWER_IS_BETTER = ["MedR", "MeanR", "latency_ms"]
MS = 1000.0


def _lookup(names: dict[str, str], c: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), c)


def label(model: Column, variant: Column) -> Column:
    v = F.trim(F.replace(F.coalesce(variant, F.lit("")), F.lit("_"), F.lit("-")))
    return F.when(v != "", F.concat(model, F.lit(" ("), v, F.lit(")"))).otherwise(model)


def enriched(rows: DataFrame, rules: list[dict]) -> DataFrame:
    """``protocol`` and ``notes``: the row's own where it has one, else of the first rule of which all keys equal the row's, ignoring
    case; empty without one. A rule is {"match": {column: value}, "protocol": .., "notes": ..}."""
    def pick(field: str) -> Column:
        out = None
        for rule in rules:
            fits = F.lit(True)
            for k, v in rule.get("match", {}).items():
                fits = fits & (F.lower(F.coalesce(F.col(k).cast("string"), F.lit(""))) == str(v).lower())
            out = F.when(fits, rule.get(field, "")) if out is None else out.when(fits, rule.get(field, ""))
        return out.otherwise("") if out is not None else F.lit("")

    def own_or_rule(field: str) -> Column:
        return F.coalesce(F.nullif(F.col(field), F.lit("")), pick(field)) if field in rows.columns else pick(field)

    return rows.withColumns({"protocol": own_or_rule("protocol"), "notes": own_or_rule("notes")})


def benchmark_view(results: DataFrame, rules: list[dict] | None = None, dataset: str | None = None, model: str | None = None) -> DataFrame:
    """(model, dataset, protocol, metric, value, notes): known metrics renamed, latency in ms, the rest dropped."""
    seconds = F.col("metric_name") == "avg_query_latency_sec"
    r = enriched(results, rules or []).withColumn("metric", F.when(seconds, "latency_ms").otherwise(_lookup(METRICS, F.col("metric_name")))).where("metric is not null")
    value = F.round(F.when(seconds, F.col("metric_value") * MS).otherwise(F.col("metric_value")), 6)
    out = r.select(label(F.col("model"), F.col("variant")).alias("model"), F.coalesce(_lookup(DATASETS, F.col("dataset")), F.col("dataset")).alias("dataset"), "protocol", "metric", value.alias("value"), "notes")
    if dataset:
        out = out.where(F.lower("dataset") == dataset.lower())
    if model:
        out = out.where(F.contains(F.lower("model"), F.lit(model.lower())))
    return out


def wide(view: DataFrame, metrics: list[str], order: str) -> DataFrame:
    """One row a model and dataset, one column a metric; the last value by ``order`` counts."""
    return view.groupBy("model", "dataset").pivot("metric", metrics).agg(F.max_by("value", order))


def wide_with_notes(view: DataFrame, metrics: list[str], order: str) -> DataFrame:
    """As ``wide``, with the first protocol and the first notes by ``order`` that are not empty."""
    first = lambda c: F.coalesce(F.min_by(c, F.when(F.col(c) != "", F.col(order))), F.lit("")).alias(c)
    told = view.groupBy("model", "dataset").agg(first("protocol"), first("notes"))
    return told.join(wide(view, metrics, order), ["model", "dataset"])


def best_marked(view: DataFrame) -> DataFrame:
    """The view with ``best``: the least value of a dataset's metric where lower is better, else the greatest."""
    w = Window.partitionBy("dataset", "metric")
    best = F.when(F.col("metric").isin(LOWER_IS_BETTER), F.min("value").over(w)).otherwise(F.max("value").over(w))
    return view.withColumn("best", F.col("value") == best)
