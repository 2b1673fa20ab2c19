"""The most similar vectors of every vector, by cross-polytope hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: Fixed by the recall measured against brute force (README).
TABLES, AXES, PROBES, SKETCH_BITS, SKETCH_APART = 8, 3, 4, 64, 21
#: Neighbours of this cosine and more are promised by the tables; places left open are filled by WIDE of the signed axes of one more rotation.
PROMISED, WIDE = 0.9, 28
#: Buckets of more stored vectors are not paired but go through matrix products, in blocks of so many vectors;
#: the wide buckets are so many vectors to a group.
LARGE, BLOCK, GROUP = 64, 8192, 32_768


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Hadamard transform of every row, in place; the width is a power of two."""
    n, step = x.shape[1], 1
    while step < n:
        v = x.reshape(len(x), n // (2 * step), 2, step)
        a = v[:, :, 0].copy()
        v[:, :, 0] += v[:, :, 1]
        np.subtract(a, v[:, :, 1], out=v[:, :, 1])
        step *= 2
    return x


def rotate(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Pseudo-rotation: three times random signs, then the Hadamard transform."""
    for s in signs:
        x = hadamard(x * s)
    return x


def _signs(width: int, count: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2, (count, 3, width)).astype(np.float32) * 2 - 1


def polytope_keys(x: np.ndarray, tables: int, axes: int, probes: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(n, tables) home keys and (n, tables, probes) probed keys of unit rows ``x``.

    A hash is the nearest signed axis after a pseudo-rotation, a key joins ``axes`` of them. Probes
    are the home key and those with the least loss when one axis gives way to its second nearest.
    """
    width = 1 << max(1, int(x.shape[1] - 1).bit_length())
    padded = np.zeros((len(x), width), np.float32)
    padded[:, : x.shape[1]] = x
    signs = _signs(width, tables * axes, seed)
    home = np.empty((len(x), tables), np.int64)
    probed = np.empty((len(x), tables, probes), np.int64)
    row = np.arange(len(x))
    for t in range(tables):
        first, second, loss = [], [], []
        for j in range(axes):
            y = rotate(padded.copy(), signs[t * axes + j])
            size = np.abs(y)
            for where in (first, second):
                at = size.argmax(1)
                where.append(at * 2 + (y[row, at] < 0))
                loss.append(size[row, at].copy())
                size[row, at] = -1
        base = np.array([(2 * width) ** j for j in range(axes)], np.int64)
        f, s = np.stack(first, 1), np.stack(second, 1)
        gap = np.stack(loss[0::2], 1) - np.stack(loss[1::2], 1)
        key = f @ base
        home[:, t] = key * tables + t
        steps = key[:, None] + (s - f) * base  # one axis changed
        order = np.argsort(gap, 1, kind="stable")
        ranked = np.take_along_axis(steps, order, 1)
        probed[:, t, 0] = home[:, t]
        for p in range(1, probes):
            if p <= axes:
                probed[:, t, p] = ranked[:, p - 1] * tables + t
            else:  # the two axes that lose least change together
                both = ranked[:, 0] + ranked[:, 1] - key
                probed[:, t, p] = both * tables + t
    return home, probed


def window_vectors(base: DataFrame, width: int = 64) -> DataFrame:
    """(window_id, vector): one row per window that has a usable vector.

    The vector is ``embedding`` if it has ``width`` finite numbers that are not all zero, else the mean
    of the rows of ``frame_features`` (each of ``width`` finite numbers, the mean not all zero), kept as their
    sum, which has the same cosines; a window with neither takes no part. Numbers are FLOAT, as in the table. Rows of a window agree in both, so any usable one counts.
    """
    sound = lambda a: (F.size(a) == width) & F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = lambda a: F.exists(a, lambda x: x != 0)
    f = F.col("frame_features")
    total = F.transform(
        F.sequence(F.lit(0), F.lit(width - 1)),
        lambda i: F.aggregate(f, F.lit(0.0), lambda acc, row: acc + row[i].cast("double")).cast("float"),
    )
    e = F.when(sound(F.col("embedding")) & some(F.col("embedding")), F.col("embedding").cast("array<float>"))
    m = F.when((F.size(f) > 0) & F.forall(f, lambda r: F.coalesce(sound(r), F.lit(False))), total)
    # the wide columns are read once a row, and only one array of a window crosses the exchange
    picked = base.where("window_id is not null").select("window_id", F.coalesce(e, F.when(some(m), m)).alias("v")).where("v is not null")
    return picked.groupBy("window_id").agg(F.first("v").alias("vector"))


def distinct_vectors(windows: DataFrame, k: int) -> DataFrame:
    """(vec_id, vector, ids): windows with the same numbers make one row.

    ``ids`` are the k + 1 smallest window ids only: by the tie rule no other member of the class can be
    among anyone's k most similar, so a class that holds a third of all windows stays small.
    """
    rank = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("window_id"))
    keyed = windows.select("window_id", "vector", F.xxhash64(F.lit(1), "vector").alias("k1"), F.xxhash64(F.lit("2"), "vector").alias("k2"))
    kept = keyed.withColumn("r", rank).where(F.col("r") <= k + 1)
    return kept.groupBy("k1", "k2").agg(F.first("vector").alias("vector"), F.array_sort(F.collect_list("window_id")).alias("ids")).select(F.col("k1").alias("vec_id"), "vector", "ids")


def _unit(column: pa.Array, n: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _lists_of(keys: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * keys.shape[1], pa.int32()), pa.array(keys.ravel()))


def hashed(vectors: DataFrame, tables: int, axes: int, probes: int) -> DataFrame:
    """(vec_id, sketch, keys): ``probes`` keys a table, the first of which is the home key. The sketch has
    the signs of 64 more pseudo-rotated coordinates."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(batch.column("vector"), batch.num_rows)
            _, probed = polytope_keys(x, tables, axes, probes)
            width = 1 << max(1, int(x.shape[1] - 1).bit_length())
            wide = np.zeros((len(x), max(width, SKETCH_BITS)), np.float32)
            wide[:, : x.shape[1]] = x
            bits = rotate(wide, _signs(wide.shape[1], 1, 977)[0])[:, :SKETCH_BITS] > 0
            sketch = np.packbits(bits, axis=1).view(np.int64).ravel()
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(sketch), _lists_of(probed.reshape(len(x), -1))], names=["vec_id", "sketch", "keys"])

    return vectors.select("vec_id", "vector").mapInArrow(run, "vec_id bigint, sketch bigint, keys array<bigint>")


def wide_keys(vectors: DataFrame, probes: int, seed: int = 41) -> DataFrame:
    """(vec_id, keys): the ``probes`` nearest signed axes of one pseudo-rotation, nearest first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(batch.column("vector"), batch.num_rows)
            width = 1 << max(1, int(x.shape[1] - 1).bit_length())
            wide = np.zeros((len(x), width), np.float32)
            wide[:, : x.shape[1]] = x
            y = rotate(wide, _signs(width, 1, seed)[0])
            at = np.argsort(-np.abs(y), 1, kind="stable")[:, : min(probes, width)]
            keys = at.astype(np.int64) * 2 + (np.take_along_axis(y, at, 1) < 0)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), _lists_of(keys)], names=["vec_id", "keys"])

    return vectors.select("vec_id", "vector").mapInArrow(run, "vec_id bigint, keys array<bigint>")


def bucket_best(asked: DataFrame, stored: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """(q, o, cosine): for every asked vector the ``k`` most similar stored ones of each pair of blocks it is in.

    ``asked`` is (key, q, v), ``stored`` (key, o, v); with a column ``axes ARRAY<INT>`` of the one and ``axis INT`` of the other, only
    rows meet whose axis is among the axes. Both sides of a bucket are cut into blocks of about ``block``
    vectors, counted beforehand, so that no task holds more than one block of each; two blocks meet in matrix
    products, of which ``k`` rows an asked vector leave the task.
    """
    blocks = lambda d, n: d.groupBy("key").agg(F.ceil(F.count("*") / block).alias(n))
    sizes = cut(blocks(asked, "na").join(blocks(stored, "ns"), "key"))
    of = lambda c, n: F.pmod(F.xxhash64(F.lit(8), c), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    some = "axis" in stored.columns
    left = asked.join(sizes, "key").select("key", of("q", "na").alias("a_block"), every("ns").alias("s_block"), "q", "v", *["axes"] * some)
    right = stored.join(sizes, "key").select("key", every("na").alias("a_block"), of("o", "ns").alias("s_block"), "o", "v", *["axis"] * some)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        none = pa.table({"q": pa.array([], pa.int64()), "o": pa.array([], pa.int64()), "cosine": pa.array([], pa.float64())})
        if not left.num_rows or not right.num_rows:
            return none
        rows = lambda t: t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1).astype(np.float64)
        x, y, q, o = rows(left), rows(right), left.column("q").to_numpy(), right.column("o").to_numpy()
        ux, uy = ((z / np.sqrt((z * z).sum(1))[:, None]).astype(np.float32) for z in (x, y))
        out: list[tuple[np.ndarray, ...]] = []

        def meet(mine: np.ndarray, theirs: np.ndarray) -> None:
            other, ids = uy[theirs], o[theirs]
            for at in range(0, len(mine), 512):
                part = mine[at : at + 512]
                s = ux[part] @ other.T
                s[q[part][:, None] == ids[None, :]] = -2
                top = np.argpartition(-s, k - 1, 1)[:, :k] if len(theirs) > k else np.broadcast_to(np.arange(len(theirs)), s.shape)
                i, j = np.nonzero(np.take_along_axis(s, top, 1) > -2)
                r, c = part[i], theirs[top[i, j]]
                # as in near_pairs: rounded, so that vectors that differ by a factor only tie
                out.append((q[r], o[c], np.round((x[r] * y[c]).sum(1) / np.sqrt((x[r] * x[r]).sum(1) * (y[c] * y[c]).sum(1)), 12)))

        if some:
            lists = left.column("axes").combine_chunks()
            of, axes = np.repeat(np.arange(len(x)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy(zero_copy_only=False)
            axis = right.column("axis").to_numpy()
            for one in np.unique(axis):
                meet(of[axes == one], np.flatnonzero(axis == one))
        else:
            meet(np.arange(len(x)), np.arange(len(y)))
        if not out:
            return none
        a, b, c = (np.concatenate(z) for z in zip(*out, strict=True))
        order = np.lexsort((-c, a))
        first = np.flatnonzero(np.concatenate([[True], np.diff(a[order]) != 0]))
        best = order[np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order)))) < k]
        return pa.table({"q": a[best], "o": b[best], "cosine": c[best]})

    groups = ["key", "a_block", "s_block"]
    return left.groupBy(*groups).cogroup(right.groupBy(*groups)).applyInArrow(run, "q bigint, o bigint, cosine double")


def near_pairs(vectors: DataFrame, k: int = 5, tables: int = TABLES, axes: int = AXES, probes: int = PROBES, large: int = LARGE) -> DataFrame:
    """(q, o, cosine): exact cosine of the candidate pairs of distinct vectors, in both directions.

    Every vector is stored under its home key of each table and probes several; pairs whose 64 sign
    bits differ in more than 21 places are dropped in the join (a cosine of 0.9 differs in 9 on
    average; more than 21 for fewer than one in ten thousand), so that vectors far apart that share a bucket
    never leave it. Buckets that store more than ``large`` vectors (dense clusters of near copies) are not paired:
    they go through ``bucket_best``, which keeps the ``k`` best of each asked vector.
    """
    keys = cut(hashed(vectors, tables, axes, probes))
    stored = keys.select(F.col("vec_id").alias("s"), F.col("sketch").alias("ss"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(tables - 1)), lambda t: F.get("keys", t * probes))).alias("key"))
    asked = keys.select(F.col("vec_id").alias("q"), F.col("sketch").alias("qs"), F.explode("keys").alias("key"))
    crowded = cut(stored.groupBy("key").count().where(F.col("count") > large).select("key"))
    hot = not crowded.isEmpty()
    usual = (lambda d: d.join(crowded, "key", "left_anti")) if hot else (lambda d: d)
    met = usual(asked).join(usual(stored), "key").where("q <> s").where(F.bit_count(F.col("qs").bitwiseXOR(F.col("ss"))) <= SKETCH_APART)
    pairs = met.select(F.least("q", "s").alias("a"), F.greatest("q", "s").alias("b")).distinct()
    va = vectors.select(F.col("vec_id").alias("a"), F.col("vector").alias("va"))
    vb = vectors.select(F.col("vec_id").alias("b"), F.col("vector").alias("vb"))
    both = pairs.repartition("a").join(va, "a").join(vb, "b").select("a", "b", "va", "vb")

    def cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.num_rows
            x, y = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.float64) for c in ("va", "vb"))
            # rounded, so that vectors that differ by a factor only tie
            c = np.round((x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1)), 12)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(c)], names=["a", "b", "cosine"])

    found = cut(both.mapInArrow(cosines, "a bigint, b bigint, cosine double"))
    directed = found.select(F.col("a").alias("q"), F.col("b").alias("o"), "cosine").union(found.select(F.col("b").alias("q"), F.col("a").alias("o"), "cosine"))
    if not hot:
        return directed
    held = lambda d, c: d.join(crowded, "key", "left_semi").select("key", c).join(vectors.select(F.col("vec_id").alias(c), F.col("vector").alias("v")), c)
    return cut(directed.union(bucket_best(held(asked, "q"), held(stored, "s").withColumnRenamed("s", "o"), k)).distinct())


def _best(vectors: DataFrame, directed: DataFrame, k: int) -> DataFrame:
    """(q, near): the ``k`` + 1 most similar windows of every distinct vector from (q, o, cosine) rows, as
    an ordered array of (r, neighbour, cosine).

    Members of a class of equal vectors are each other's nearest at cosine 1.
    """
    ids = vectors.select(F.col("vec_id").alias("o"), "ids")
    best = directed.join(ids, "o").select("q", "cosine", F.explode("ids").alias("neighbour"))
    own = vectors.where(F.size("ids") > 1).select(F.col("vec_id").alias("q"), F.lit(1.0).alias("cosine"), F.explode("ids").alias("neighbour"))
    # k + 1, as a window's own id may be among those of its class
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.col("cosine").desc(), "neighbour"))
    lists = best.union(own).withColumn("r", rank).where(F.col("r") <= k + 1)
    return lists.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("r", "neighbour", "cosine"))).alias("near"))


def _lists(windows: DataFrame, vectors: DataFrame, directed: DataFrame, k: int) -> DataFrame:
    """(window_id, neighbour, cosine, rank) from (q, o, cosine) rows of distinct vectors."""
    members = windows.select("window_id", F.xxhash64(F.lit(1), "vector").alias("q"))
    others = F.slice(F.filter("near", lambda x: x["neighbour"] != F.col("window_id")), 1, k)
    return (
        members.join(_best(vectors, directed, k), "q").select("window_id", F.posexplode(others).alias("p", "n"))
        .select("window_id", F.col("n.neighbour").alias("neighbour"), F.col("n.cosine").alias("cosine"), (F.col("p") + 1).alias("rank"))
    )


def far_pairs(vectors: DataFrame, directed: DataFrame, k: int, wide: int = WIDE) -> DataFrame:
    """(q, o, cosine) for the vectors that have fewer than ``k`` neighbours of the promised cosine: the ``k`` best of each of the
    buckets of the ``wide`` signed axes nearest to them, in one more rotation.

    A neighbour that is hardly nearer than the rest shares no key with its vector but by chance, so this looks through
    a part of all vectors that does not shrink as they grow: the cost of such vectors grows with their number times all.
    """
    sure = _best(vectors, directed.where(F.col("cosine") >= PROMISED), k).where(F.size("near") > k).select(F.col("q").alias("vec_id"))
    open_ = vectors.join(sure, "vec_id", "left_anti").select("vec_id", "vector")
    # the buckets stand in groups, so that a vector is sent once to each group and not to each bucket
    groups = max(1, -(-vectors.count() // GROUP))
    vector = lambda c: vectors.select(F.col("vec_id").alias(c), F.col("vector").alias("v"))
    homes = wide_keys(vectors, 1).select(F.col("vec_id").alias("o"), F.get("keys", F.lit(0)).cast("int").alias("axis"))
    homes = homes.join(vector("o"), "o").withColumn("key", F.pmod("axis", F.lit(groups)).cast("bigint"))
    asked = wide_keys(open_, wide).select(F.col("vec_id").alias("q"), F.explode("keys").alias("axis"))
    asked = asked.groupBy("q", F.pmod("axis", F.lit(groups)).alias("key")).agg(F.collect_list(F.col("axis").cast("int")).alias("axes")).join(vector("q"), "q")
    return bucket_best(asked, homes, k, GROUP)


def nearest(windows: DataFrame, k: int = 5, wide: int = WIDE, **shape: int) -> DataFrame:
    """(window_id, neighbour, cosine, rank): up to ``k`` most similar windows of every window, ties by
    neighbour id, among the candidates of the hash tables.

    The tables promise neighbours of cosine 0.9 and more (recall above 0.99 against brute
    force). Windows with fewer than ``k`` of these look further, in ``wide`` buckets of one more rotation (0: not), so
    that recall over all places is above 0.9 too; ``nearest_exact`` finds all for a stated query set.
    """
    vectors = cut(distinct_vectors(windows, k))
    directed = near_pairs(vectors, k, **shape)
    if wide:
        directed = directed.union(cut(far_pairs(vectors, directed, k, wide))).distinct()
    return _lists(windows, vectors, directed, k)


def query_set(windows: DataFrame, of: int = 20) -> DataFrame:
    """The stated query set: windows whose hashed id is divisible by ``of``."""
    return windows.where(F.pmod(F.xxhash64("window_id"), F.lit(of)) == 0)


def _block_best(vectors: DataFrame, block: list, k: int) -> DataFrame:
    """(q, o, cosine): for every vector of the block its ``k`` best of ``vectors`` in each task, itself left out."""
    ids = np.array([r["vec_id"] for r in block], np.int64)
    asked = np.array([r["vector"] for r in block], np.float64)
    asked = (asked / np.linalg.norm(asked, axis=1, keepdims=True)).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((len(ids), k), -2, np.float32)
        who = np.zeros((len(ids), k), np.int64)
        row = np.arange(len(ids))[:, None]
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = part.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1).astype(np.float64)
                there = part.column("vec_id").to_numpy(zero_copy_only=False)
                s = asked @ (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32).T
                s[ids[:, None] == there[None, :]] = -2
                some = np.concatenate([best, s], 1)
                top = np.argpartition(-some, k - 1, 1)[:, :k]
                from_new = np.concatenate([who, np.broadcast_to(there, s.shape)], 1)
                best, who = some[row, top], from_new[row, top]
        kept = best > -2
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, kept.sum(1))), pa.array(who[kept])], names=["q", "o"])

    return vectors.select("vec_id", "vector").mapInArrow(run, "q bigint, o bigint")


def nearest_exact(windows: DataFrame, queries: DataFrame, k: int = 5, block: int = 8192) -> DataFrame:
    """As ``nearest``, exactly, for the windows of a stated query set, against all windows.

    Queries go to the tasks in blocks of at most ``block`` vectors (a few MB), each block is one pass of matrix
    products over the distinct vectors, and a task keeps ``k`` rows a query.
    """
    vectors = cut(distinct_vectors(windows, k))
    asked = cut(vectors.join(queries.select(F.xxhash64(F.lit(1), "vector").alias("vec_id")).distinct(), "vec_id", "left_semi").select("vec_id", "vector"))
    n = max(1, -(-asked.count() * 5 // (4 * block)))
    found = None
    for b in range(n):
        rows = asked.where(F.pmod(F.xxhash64(F.lit(2), "vec_id"), F.lit(n)) == b).collect()  # one block
        if rows:
            part = cut(_block_best(vectors, rows, k))
            found = part if found is None else found.union(part)
    if found is None:
        return nearest(windows.limit(0), k)
    side = lambda c: vectors.select(F.col("vec_id").alias(c), F.col("vector").alias("v" + c))
    cos = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)
    q, o = F.col("vq"), F.col("vo")
    directed = found.join(side("q"), "q").join(side("o"), "o").select("q", "o", F.round(cos(q, o) / F.sqrt(cos(q, q) * cos(o, o)), 12).alias("cosine"))
    return _lists(queries, vectors, directed, k)


def measured_recall(windows: DataFrame, k: int = 5, of: int = 20) -> DataFrame:
    """(band, exact, found, recall, recall_in_all): how many of the exact neighbours of the stated query set the hash tables
    find, by their cosine and over all bands."""
    asked = query_set(windows, of)
    exact = nearest_exact(windows, asked, k).select("window_id", "neighbour", "cosine")
    got = nearest(windows, k).select("window_id", "neighbour", F.lit(True).alias("hit"))
    band = F.when(F.col("cosine") >= 0.9, "0.9 and more").when(F.col("cosine") >= 0.7, "0.7 to 0.9").otherwise("below 0.7")
    by = exact.join(got, ["window_id", "neighbour"], "left").groupBy(band.alias("band")).agg(F.count("*").alias("exact"), F.count("hit").alias("found"))
    share = lambda f, e: F.round(f / e, 4)
    every = Window.partitionBy(F.lit(0))  # three rows
    return by.withColumn("recall", share(F.col("found"), F.col("exact"))).withColumn("recall_in_all", share(F.sum("found").over(every), F.sum("exact").over(every)))


def near_window_pairs(base: DataFrame, k: int = 5, least: float = PROMISED) -> DataFrame:
    """(window_id_a, window_id_b), smaller id first: pairs of cosine ``least`` or more of which one is
    among the ``k`` most similar of the other."""
    found = nearest(cut(window_vectors(base)), k, wide=0).where(F.col("cosine") >= least)
    return found.select(F.least("window_id", "neighbour").alias("window_id_a"), F.greatest("window_id", "neighbour").alias("window_id_b")).distinct()
