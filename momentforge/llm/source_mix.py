"""Mixing sources to target weights, measured in tokens."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut
from .tokens import encode


#: The driver splits down to so many nodes; tasks split on from there.
NODES = 256


def _halves(lo: int, hi: int, have: np.ndarray, sizes: Callable[[int, int], int], rng: np.random.Generator) -> tuple[int, np.ndarray]:
    """(middle, blocks that go left) of the node of shards lo to hi: a multivariate-hypergeometric draw."""
    mid = (lo + hi) // 2
    want, left, rest = sizes(lo, mid), np.zeros_like(have), int(have.sum())
    for i, n in enumerate(have):
        left[i] = rng.hypergeometric(n, rest - n, want - int(left.sum())) if n and want > left.sum() else 0
        rest -= int(n)
    return mid, left


def _shard_sizes(total: int, shards: int) -> Callable[[int, int], int]:
    """Blocks of the shards lo to hi: as equal as they can be, the first ones one more."""
    upto = lambda k: k * (total // shards) + min(k, total % shards)
    return lambda lo, hi: upto(hi) - upto(lo)


def split_nodes(quotas: np.ndarray, shards: int, seed: int, most: int) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """(lo, hi, first, have) of the nodes of the tree that hold all shards, once there are ``most`` of them or every
    node is a shard. ``first`` is the place of a node's first block in each source's order."""
    sizes, nodes = _shard_sizes(int(quotas.sum()), shards), [(0, shards, np.zeros_like(quotas), quotas)]
    while len(nodes) < most and any(hi - lo > 1 for lo, hi, _, _ in nodes):
        after = []
        for lo, hi, first, have in nodes:
            if hi - lo == 1:
                after.append((lo, hi, first, have))
                continue
            mid, left = _halves(lo, hi, have, sizes, np.random.default_rng([seed, lo, hi]))
            after += [(lo, mid, first, left), (mid, hi, first + left, have - left)]
        nodes = after
    return nodes


def splitting_tree(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """(shards, sources) block counts: the quotas dealt out by a multivariate-hypergeometric tree.

    Every node halves its shards and draws, without replacement, which of its blocks go left, so each
    shard has its exact number of blocks and the sums over shards are the quotas.
    """
    leaves = split_nodes(quotas.astype(np.int64), shards, int(rng.integers(1 << 31)), shards)
    return np.stack([have for _, _, _, have in sorted(leaves, key=lambda n: n[0])])


def deal_blocks(spark: SparkSession, names: list[str], quotas: np.ndarray, shards: int, seed: int) -> DataFrame:
    """(source, shard, first, n): the run of the source's blocks that each shard takes, shards without any left out.

    The driver splits the tree down to NODES nodes; the tasks split theirs on, so what the driver holds does
    not grow with the shards.
    """
    total = int(quotas.sum())
    if total >= 1_000_000_000:
        raise ValueError("more than a billion blocks: raise shard_tokens")
    nodes = [(lo, hi, first.tolist(), have.tolist()) for lo, hi, first, have in split_nodes(quotas, shards, seed, NODES)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sizes = _shard_sizes(total, shards)
        for frame in frames:
            for row in frame.itertuples():
                stack = [(int(row.lo), int(row.hi), np.array(row.first, np.int64), np.array(row.have, np.int64))]
                while stack:
                    lo, hi, first, have = stack.pop()
                    if hi - lo > 1:
                        mid, left = _halves(lo, hi, have, sizes, np.random.default_rng([seed, lo, hi]))
                        stack += [(lo, mid, first, left), (mid, hi, first + left, have - left)]
                        continue
                    some = np.flatnonzero(have)
                    yield pd.DataFrame({"source": [names[i] for i in some], "shard": lo, "first": first[some], "n": have[some]})

    table = spark.createDataFrame(nodes, "lo long, hi long, first array<long>, have array<long>")
    return table.repartition(min(len(nodes), 64), "lo").mapInPandas(run, "source string, shard long, first long, n long")


def mix_plan(totals: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, size, wanted, available, feasible) of every target source.

    ``totals`` is (source, tokens) of all documents with a source; ``wanted`` is the share of their sum,
    ``available`` the size times the repeats. A source without documents has size 0.
    """
    totals = cut(totals)
    all_tokens = float(totals.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0])
    plan = targets.select("source", "target_share", "max_repeats").join(totals, "source", "left")
    plan = plan.withColumn("size", F.coalesce("tokens", F.lit(0)).cast("bigint")).drop("tokens")
    plan = plan.withColumn("wanted", F.col("target_share") * all_tokens).withColumn("available", F.col("size") * F.col("max_repeats"))
    return plan.withColumn("feasible", F.col("available") >= F.col("wanted"))


def starved_sources(docs: DataFrame, targets: DataFrame, path: str | None = None) -> DataFrame:
    """(source) of every target source that cannot reach its share within its repeats, from the report of the mixture."""
    return mix(docs, targets, path)[1].where("not feasible").select("source")


def mix(docs: DataFrame, targets: DataFrame, path: str | None = None, shard_tokens: int = 2_000_000, blocks_per_shard: int = 64, bins: int = 1024, seed: int = 9) -> tuple[DataFrame, DataFrame]:
    """(rows, report).

    ``rows`` is (shard, place, doc_id, source, copy, tokens): the mixture, one row a use of a document. It is
    written once, every shard whole in one task and shuffled, that is in the order of ``place``. ``report`` is
    (source, target_share, reachable_share, actual_share, tokens, copies, max_repeats, feasible); ``reachable_share`` is
    what the repeats allow of the target, among what they allow of all.

    Each source is put in a hashed order and cut into blocks of equal token counts; the cumulative sum
    behind that has two levels (hash ranges, then documents in a range), so a source that holds a
    third of all rows is no single task. Block quotas of the sources are dealt out to the shards by the
    splitting tree, and a shard takes the next blocks of the source's order, beginning again after
    the last (copy 1, 2, ...), so no block is used twice within a pass and no source more than
    ``max_repeats`` times. Null sources and sources without a target take no part; texts without
    tokens come along with the block they fall in. Shares are met to within a block a source.
    """
    spark = docs.sparkSession
    sized = cut(
        encode(docs.where(F.col("source").isNotNull()), path, keep=("source",))
        .select("doc_id", "source", F.size("ids").cast("bigint").alias("tokens"))
    )
    plan = {r["source"]: r for r in mix_plan(sized.groupBy("source").agg(F.sum("tokens").alias("tokens")), targets).collect()}  # one row a target
    reach = {s: min(r["wanted"], r["available"]) for s, r in plan.items()}
    total = sum(reach.values())
    shards = max(1, math.ceil(total / shard_tokens))
    block = max(1.0, total / (shards * blocks_per_shard))
    names = sorted(s for s, r in plan.items() if r["size"] > 0)
    blocks = {s: max(1, math.ceil(plan[s]["size"] / block)) for s in names}
    quotas = np.array([min(round(reach[s] / plan[s]["size"] * blocks[s]), blocks[s] * plan[s]["max_repeats"]) for s in names], np.int64)
    sizes = spark.createDataFrame([(s, float(plan[s]["size"]) / blocks[s], blocks[s]) for s in names], "source string, step double, blocks long")
    taken_blocks = F.explode(F.sequence("first", F.col("first") + F.col("n") - 1))
    uses = deal_blocks(spark, names, quotas, shards, seed) if names else spark.createDataFrame([], "source string, shard long, first long, n long")
    uses = uses.select("source", "shard", taken_blocks.alias("k")).join(F.broadcast(sizes), "source")
    uses = uses.select("source", "shard", (F.col("k") % F.col("blocks")).alias("block"), F.floor(F.col("k") / F.col("blocks")).alias("copy"))
    h = F.xxhash64(F.lit(seed), F.col("doc_id"))
    placed = sized.where(F.col("source").isin(names) if names else F.lit(False)).withColumn("bin", F.pmod(h, F.lit(bins)))
    sums = placed.groupBy("source", "bin").agg(F.sum("tokens").alias("n"))
    before = sums.select("source", "bin", (F.sum("n").over(Window.partitionBy("source").orderBy("bin")) - F.col("n")).alias("from"))
    inside = Window.partitionBy("source", "bin").orderBy(h, "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    begun = F.col("from") + F.sum("tokens").over(inside) - F.col("tokens")
    cutup = placed.join(F.broadcast(before), ["source", "bin"]).join(F.broadcast(sizes), "source").withColumn("block", F.least(F.floor(begun / F.col("step")), F.col("blocks") - 1))
    used = cutup.join(uses, ["source", "block"]).select(F.col("shard").cast("int").alias("shard"), F.xxhash64(F.lit(seed + 1), "doc_id", "copy").alias("place"), "doc_id", "source", "copy", "tokens")
    rows = cut(used.repartition("shard").sortWithinPartitions("shard", "place", "doc_id"))
    taken = rows.groupBy("source").agg(F.sum("tokens").alias("tokens"), (F.max("copy") + 1).alias("copies"))
    targets_now = spark.createDataFrame([(s, r["target_share"], reach[s] / total if total else 0.0, r["max_repeats"], r["feasible"]) for s, r in sorted(plan.items())], "source string, target_share double, reachable_share double, max_repeats int, feasible boolean")
    full = targets_now.join(taken, "source", "left").fillna(0, ["tokens", "copies"])
    everything = Window.partitionBy(F.lit(0))  # one row a target
    report = full.select("source", "target_share", "reachable_share", (F.col("tokens") / F.greatest(F.sum("tokens").over(everything), F.lit(1))).alias("actual_share"), "tokens", "copies", "max_repeats", "feasible")
    return rows, report
