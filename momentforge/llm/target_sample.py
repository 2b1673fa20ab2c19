"""A sample whose category shares match given proportions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .clips import category_ids, clip_key

REPORT = "category_id int, target_share double, need long, available long, taken long, actual_share double, gap long, met boolean, reachable boolean"
_STEPS = 64
#: Sources beyond the most frequent ones share one margin, so that cells are at most categories times these and one.
MAX_SOURCES, _REST = 1000, "\x00rest"


def rake(counts: np.ndarray, margins: list[np.ndarray], rounds: int = 200, tolerance: float = 1e-10) -> np.ndarray:
    """Weights of the cells of ``counts`` (one axis a margin) by iterative proportional fitting: the
    weighted sums over each axis take the given shares. A share without records is left out and the
    rest are scaled; cells without records weigh 0."""
    fitted = counts.astype(float)
    for _ in range(rounds):
        moved = 0.0
        for axis, share in enumerate(margins):
            others = tuple(i for i in range(counts.ndim) if i != axis)
            now = fitted.sum(axis=others)
            wanted = np.where(now > 0, share, 0.0)
            factor = np.where(now > 0, wanted / max(wanted.sum(), 1e-300) / np.where(now > 0, now, 1), 0.0)
            moved = max(moved, float(np.abs(factor * fitted.sum() - 1)[now > 0].max(initial=0)))
            fitted = fitted * factor.reshape([-1 if i == axis else 1 for i in range(counts.ndim)])
        if moved < tolerance:
            break
    return np.where(counts > 0, fitted / np.where(counts > 0, counts, 1), 0.0)


def _quotas(drawn: dict[int, int], least: dict[int, int], available: dict[int, int], size: int) -> dict[int, int]:
    """Counts per category after repair: nobody below ``least``, the size kept where it can be."""
    got = {c: max(min(drawn.get(c, 0), available[c]), least[c]) for c in available}
    over = sum(got.values()) - size
    while over:  # one step a unit of over- or undershoot, which is at most the repairs made
        step = 1 if over > 0 else -1
        room = {c: got[c] - least[c] if step > 0 else available[c] - got[c] for c in got}
        c = max(room, key=lambda c: (room[c], -c))
        if room[c] <= 0:
            break
        part = step * max(1, min(abs(over), room[c] // 2))
        got[c] -= part
        over -= part
    return got


class TargetSample:
    """Draws ``share`` of the clips that have a category.

    Weights are raked over two margins, the target category shares and the shares the ``source``
    values have among all clips (the MAX_SOURCES most frequent each, the rest together), from the bounded table of
    cell counts; they give each cell the chance p of its clips. Every clip gets the key -ln(u) / w with u a hash
    of its id and w = -ln(1 - p), so that keys below 1 come with chance p; the smallest keys are the draw. Then each category is brought up to its minimum, at the cost of the largest surpluses, again
    by smallest key. Keys are counted in logarithmic bins (a few thousand a category), so neither the
    draw nor a hot category is ever sorted in one task: only the bin where a quota ends is.
    """

    def __init__(self, rows: DataFrame, targets: DataFrame, share: float = 0.5, seed: int = 3):
        self.spark = rows.sparkSession
        clips = category_ids(rows, targets)
        sources = rows.select("video_id", "source").distinct().select(clip_key("video_id").alias("clip"), F.coalesce("source", F.lit("")).alias("source")).where("clip is not null").groupBy("clip").agg(F.min("source").alias("source"))
        named = cut(clips.join(sources, "clip"))
        most = named.groupBy("source").count().orderBy(F.desc("count"), "source").limit(MAX_SOURCES).select("source", F.col("source").alias("margin"))
        self.clips = named.join(F.broadcast(most), "source", "left").select("clip", "category_id", F.coalesce("margin", F.lit(_REST)).alias("source"))
        self.targets = {int(r["category_id"]): (float(r["target_share"]), int(r["min_videos"])) for r in targets.collect()}  # 20 rows
        cells = self.clips.groupBy("category_id", "source").count().collect()  # at most categories x (MAX_SOURCES + 1)
        self.available = {c: 0 for c in self.targets}
        for r in cells:
            self.available[r["category_id"]] += r["count"]
        self.size = math.floor(share * sum(self.available.values()))
        self.need = {c: max(math.ceil(t * self.size), m) for c, (t, m) in self.targets.items()}
        self.seed, self._cells = seed, cells

    def _wanted(self) -> dict[int, float]:
        """Clips per category by the target shares; what a category lacks goes to the others by their shares."""
        got, open_ = {c: 0.0 for c in self.targets}, {c for c, (t, _) in self.targets.items() if t > 0 and self.available[c]}
        left = float(self.size)
        while open_ and left > 1e-9:
            total = sum(self.targets[c][0] for c in open_)
            full = {c for c in open_ if got[c] + left * self.targets[c][0] / total >= self.available[c]}
            for c in full or open_:
                got[c] = float(self.available[c]) if full else got[c] + left * self.targets[c][0] / total
            left = self.size - sum(got.values())
            if not full:
                break
            open_ -= full
        return got

    def _keyed(self) -> DataFrame:
        cats, srcs = sorted(self.targets), sorted({r["source"] for r in self._cells})
        counts = np.zeros((len(cats), max(1, len(srcs))))
        for r in self._cells:
            counts[cats.index(r["category_id"]), srcs.index(r["source"])] = r["count"]
        total, wanted = max(counts.sum(), 1.0), self._wanted()
        of = max(sum(wanted.values()), 1e-9)
        weights = rake(counts, [np.array([wanted[c] / of for c in cats]), counts.sum(0) / total])
        chance = np.minimum(weights * of / max((weights * counts).sum(), 1e-9), 1 - 1e-6)  # of a clip of the cell to be drawn
        flat = [(c, s, float(max(-np.log1p(-chance[i, j]), 1e-9))) for i, c in enumerate(cats) for j, s in enumerate(srcs) if counts[i, j] > 0]
        table = self.spark.createDataFrame(flat, "category_id int, source string, weight double")
        u = (F.pmod(F.xxhash64(F.lit(self.seed), F.col("clip")), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
        keyed = self.clips.join(F.broadcast(table), ["category_id", "source"]).withColumn("key", -F.log(u) / F.col("weight"))
        return keyed.withColumn("bin", F.floor(F.log("key") * _STEPS).cast("int"))

    def plan(self, binned: list) -> dict[int, int]:
        """Final counts per category from (category_id, bin, count) rows."""
        by_bin: dict[int, list] = {}
        for r in binned:
            by_bin.setdefault(r["bin"], []).append(r)
        drawn, left = {c: 0 for c in self.targets}, self.size
        for b in sorted(by_bin):
            here = sum(r["count"] for r in by_bin[b])
            part = min(1.0, left / here) if here else 0
            for r in sorted(by_bin[b], key=lambda r: r["category_id"]):
                n = min(left, r["count"], math.ceil(part * r["count"]))
                drawn[r["category_id"]] += n
                left -= n
            if left <= 0:
                break
        least = {c: min(self.available[c], self.need[c]) for c in self.targets}
        if sum(least.values()) > self.size:  # the rounding up of all needs may exceed the size
            least = {c: min(self.available[c], max(m, math.floor(t * self.size))) for c, (t, m) in self.targets.items()}
        return _quotas(drawn, least, self.available, self.size)

    def draw(self) -> tuple[DataFrame, dict[int, int]]:
        """((clip, category_id) of the sample, counts per category)."""
        keyed = cut(self._keyed())
        binned = keyed.groupBy("category_id", "bin").count().collect()  # bounded: bins of a double's logarithm
        quota = self.plan(binned)
        ends, run = [], {c: 0 for c in quota}
        for r in sorted(binned, key=lambda r: r["bin"]):
            c = r["category_id"]
            left = quota[c] - run[c]
            run[c] += r["count"]
            if left > 0:
                ends.append((c, r["bin"], min(left, r["count"])))
        table = self.spark.createDataFrame(ends, "category_id int, bin int, n long")
        marked = keyed.join(F.broadcast(table), ["category_id", "bin"])
        whole = keyed.groupBy("category_id", "bin").count()
        marked = marked.join(F.broadcast(whole), ["category_id", "bin"])
        rank = F.row_number().over(Window.partitionBy("category_id", "bin").orderBy("key", "clip"))
        edge = marked.where(F.col("n") < F.col("count")).withColumn("r", rank).where(F.col("r") <= F.col("n"))
        return marked.where(F.col("n") >= F.col("count")).select("clip", "category_id").union(edge.select("clip", "category_id")), quota

    def report(self) -> DataFrame:
        """One row a category: what it needs, has and got, the gap that remains, whether it got what it needs, and whether it has as much."""
        binned = self._keyed().groupBy("category_id", "bin").count().collect()
        taken = self.plan(binned)
        total = max(sum(taken.values()), 1)
        rows = [(c, t, self.need[c], self.available[c], taken[c], taken[c] / total, max(self.need[c] - taken[c], 0), taken[c] >= self.need[c], self.available[c] >= self.need[c]) for c, (t, _) in sorted(self.targets.items())]
        return self.spark.createDataFrame(rows, REPORT)
