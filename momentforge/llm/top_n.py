"""Top N items of every group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, group: str, item: str, score: str, n: int = 3) -> DataFrame:
    """(group, item, score, rank) of the ``n`` best items of every group.

    An item's score is the highest of its rows; ties go to the smaller item in string order. Rows
    whose group, item or score is null, or whose score is NaN, are passed over; an empty table gives
    no rows; other columns are dropped first, so their names cannot clash. The rank filter lets the
    optimiser put a group limit before the exchange: a hot group leaves each task as ``n`` rows.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    s = F.col(score).cast("double")
    best = (
        df.select(F.col(group).alias("_g"), F.col(item).alias("_i"), s.alias("_s"))
        .where("_g is not null and _i is not null and _s is not null and not isnan(_s)")
        .groupBy("_g", "_i").agg(F.max("_s").alias("_s"))
    )
    rank = F.row_number().over(Window.partitionBy("_g").orderBy(F.col("_s").desc(), F.col("_i").cast("string")))
    return best.withColumn("_r", rank).where(F.col("_r") <= n).select(
        F.col("_g").alias(group), F.col("_i").alias(item), F.col("_s").alias(score), F.col("_r").alias("rank")
    )
