"""Train, validation and test splits that keep related records together."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .clips import clip_key, clip_sources, split_name


#: A task's forest is handed on when it has so many vertices, so that its memory has a bound.
FOREST = 200_000


def local_forest(edges: DataFrame) -> DataFrame:
    """(a, b): fewer edges with the same components: in each task the edges of a component become a star around its least
    vertex."""
    def stars(parent: dict[str, str], find: Callable[[str], str]) -> pa.RecordBatch:
        pairs = [(v, r) for v in parent if (r := find(v)) != v]
        return pa.RecordBatch.from_arrays([pa.array([v for v, _ in pairs], pa.string()), pa.array([r for _, r in pairs], pa.string())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[str, str] = {}

        def find(v: str) -> str:
            root = v
            while (up := parent.setdefault(root, root)) != root:
                root = up
            while parent[v] != root:
                parent[v], v = root, parent[v]
            return root

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                x, y = find(a), find(b)
                if x != y:
                    parent[max(x, y)] = min(x, y)
            if len(parent) > FOREST:
                yield stars(parent, find)
                parent.clear()
        yield stars(parent, find)

    return edges.select("a", "b").mapInArrow(run, "a string, b string")


def components(edges: DataFrame, seed: int = 7, max_rounds: int = 200) -> DataFrame:
    """(vertex, label): connected components of the undirected edges (a, b) by random-mate contraction.

    First every task turns its share of the edges into stars, and vertices with one neighbour collapse into it (of two that only have each other the larger), which
    ends stars. Then in every round each vertex flips a coin (a hash of seed, round and id). A tail with a head neighbour
    collapses into its smallest such neighbour; a head whose only neighbour is a smaller head
    collapses too. No chain can arise, as what is collapsed into never
    moves in the same round. The edges are relabelled and the round's (child, parent) table is kept;
    when no edge is left the tables are unwound from the last to the first. Each round is a
    map-side-combined aggregate and two joins with a table that has one row a vertex, so a vertex
    that holds a third of the edges is a skewed probe side, which the adaptive skew join splits. Both
    tables of a round are written to the shared folder. Null ends and loops are dropped: vertices
    that only have these are not in the result and count as their own component.
    """
    def both(e: DataFrame) -> DataFrame:
        return e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()

    e = edges.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b")).where("a is not null and b is not null and a <> b")
    e, steps = cut(both(local_forest(e))), []
    for r in range(max_rounds):
        head = lambda c: F.pmod(F.xxhash64(F.lit(seed), F.lit(r), F.col(c)), F.lit(2)) == 1  # noqa: B023, E731
        if r == 0:
            degree = e.groupBy("a").agg(F.count("*").alias("degree"), F.min("b").alias("mate"))
            ends = degree.where("degree = 1").select(F.col("a").alias("child"), F.col("mate").alias("parent"))
            other = ends.select(F.col("child").alias("c2"), F.lit(True).alias("end"))
            parent = cut(ends.join(other, F.col("parent") == F.col("c2"), "left").where("end is null or child > parent").select("child", "parent"))
        else:
            around = e.groupBy("a").agg(F.count("*").alias("degree"), F.min(F.when(head("b"), F.col("b"))).alias("mate"), F.min("b").alias("least"))
            parent = cut(
                around.where("mate is not null")
                .where(~head("a") | ((F.col("degree") == 1) & (F.col("a") > F.col("least"))))
                .select(F.col("a").alias("child"), F.col("mate").alias("parent"))
            )
        steps.append(parent)
        move = lambda d, c: d.join(parent, d[c] == parent["child"], "left").withColumn(c, F.coalesce("parent", c)).select("a", "b")  # noqa: B023, E731
        e = cut(move(move(e, "a"), "b").where("a <> b").distinct())
        if e.isEmpty():
            break
    else:
        raise RuntimeError(f"edges are left after {max_rounds} rounds")
    labels = None
    for k, step in enumerate(reversed(steps)):
        if labels is None:
            labels = step.select(F.col("child").alias("vertex"), F.col("parent").alias("label"))
            continue
        up = labels.select(F.col("vertex").alias("parent"), F.col("label"))
        labels = labels.union(step.join(up, "parent", "left").select(F.col("child").alias("vertex"), F.coalesce("label", "parent").alias("label")))
        if k % 4 == 3:
            labels = cut(labels)
    roots = labels.select(F.col("label").alias("vertex")).distinct().withColumn("label", F.col("vertex"))
    return cut(labels.union(roots))


def weighted_cut(weights: DataFrame, shares: dict[str, float], seed: int = 7, large: float = 0.005, bins: int = 4096) -> DataFrame:
    """(label, split): whole groups dealt out to splits by cumulative weight.

    ``weights`` is (label, weight). Groups stand in a hashed order, those heavier than ``large`` of all
    weight first (at most 1/large of them), and a group goes where the middle of its stretch of the
    cumulative weight falls; so shares are met to within the weight of one group. The cumulative sum
    has two levels: sums of ``bins`` hash ranges, then the groups within each range. No task sees all
    groups.
    """
    total = weights.agg(F.sum("weight").alias("total"))
    total_weight = (total.first() or [0])[0] or 0
    h = F.xxhash64(F.lit(seed), F.col("label"))
    w = weights.withColumn("bin", F.when(F.col("weight") > large * total_weight, F.lit(-1)).otherwise(F.pmod(h, F.lit(bins)))).withColumn("h", h)
    per_bin = w.groupBy("bin").agg(F.sum("weight").alias("bin_weight"))
    before = per_bin.select("bin", (F.sum("bin_weight").over(Window.orderBy("bin")) - F.col("bin_weight")).alias("bin_start"))
    inside = Window.partitionBy("bin").orderBy(F.col("weight").desc(), "h", "label").rowsBetween(Window.unboundedPreceding, 0)
    # at most bins + 1 rows by construction
    placed = w.withColumn("run", F.sum("weight").over(inside)).join(F.broadcast(before), "bin")
    middle = (F.col("bin_start") + F.col("run") - F.col("weight") / 2) / F.lit(float(max(total_weight, 1)))
    edge, rule = 0.0, None
    names = list(shares)
    for name in names[:-1]:
        edge += shares[name]
        rule = F.when(middle < edge, name) if rule is None else rule.when(middle < edge, name)
    return placed.select("label", (rule.otherwise(names[-1]) if rule is not None else F.lit(names[0])).alias("split"))


def clip_groups(rows: DataFrame, videos: DataFrame) -> DataFrame:
    """(clip, label): the group of every clip; clips of one source video share the label."""
    linked = clip_sources(rows, videos)
    edges = linked.select(F.concat(F.lit("0:"), F.col("source")).alias("a"), F.concat(F.lit("1:"), F.col("clip")).alias("b"))
    found = components(edges).where(F.col("vertex").startswith("1:"))
    return found.select(F.substring("vertex", 3, 1 << 30).alias("clip"), "label")


def assign_splits(rows: DataFrame, videos: DataFrame, shares: dict[str, float] | None = None) -> DataFrame:
    """(row_id, split) for every row; all clips of one source video get the same split.

    Rows are counted per clip before anything is joined. A row whose clip cannot be read is a group
    of its own.
    """
    shares = shares or {"train": 0.8, "val": 0.1, "test": 0.1}
    named = rows.select("row_id", F.coalesce(clip_key("video_id"), F.concat(F.lit("row/"), F.col("row_id").cast("string"))).alias("clip"))
    groups = clip_groups(rows, videos)
    labelled = named.groupBy("clip").count().join(groups, "clip", "left").select("clip", "count", F.coalesce("label", F.concat(F.lit("2:"), F.col("clip"))).alias("label"))
    labelled = cut(labelled)
    where = weighted_cut(labelled.groupBy("label").agg(F.sum("count").alias("weight")), shares)
    return named.join(labelled.join(where, "label").select("clip", "split"), "clip").select("row_id", "split")


def leaking_rows(rows: DataFrame, videos: DataFrame) -> DataFrame:
    """(row_id) of every row with a split whose source video has rows in more than one split."""
    named = rows.select("row_id", clip_key("video_id").alias("clip"), split_name("split").alias("split")).where("clip is not null and split is not null")
    in_split = named.groupBy("clip", "split").count().join(clip_groups(rows, videos), "clip")
    mixed = in_split.groupBy("label").agg(F.min("split").alias("lo"), F.max("split").alias("hi")).where("lo <> hi")
    clips = in_split.join(mixed, "label").select("clip").distinct()
    return named.join(clips, "clip", "left_semi").select("row_id")
