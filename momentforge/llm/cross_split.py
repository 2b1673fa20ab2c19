"""Captions of evaluation splits that occur, the same or nearly, in the training split."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .clips import split_name

HASHES_PER_BAND, BANDS = 5, 32
#: A set's digest: the places of its tokens among 56 bits, and its size in the upper eight (255: that or more).
_PLACES, _MANY = 56, 255


def words(column: str):
    """The distinct lower-cased runs of letters and digits, sorted; empty for null."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(column), F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))))


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def minhash_bands(hashes: np.ndarray, starts: np.ndarray, bands: int, per_band: int, seed: int = 11) -> np.ndarray:
    """(sets, bands) keys. ``hashes`` holds the element hashes of all sets, set i from starts[i] on;
    every set has an element. Distinct elements are hashed once a batch."""
    unique, at = np.unique(hashes.view(np.uint64), return_inverse=True)
    keys = np.empty((len(starts), bands), np.int64)
    for b in range(bands):
        acc = np.full(len(starts), np.uint64(b + 1) * np.uint64(0x9E3779B97F4A7C15 >> 8), np.uint64)
        for r in range(per_band):
            salt = _mix(np.array([seed * 1_000_003 + b * per_band + r], np.uint64))[0]
            low = np.minimum.reduceat((_mix(unique ^ salt) >> np.uint64(32)).astype(np.uint32)[at], starts)
            with np.errstate(over="ignore"):
                acc = _mix(acc * np.uint64(31) + low)
        keys[:, b] = acc.view(np.int64)
    return keys


def band_keys(sets: DataFrame, bands: int = BANDS, per_band: int = HASHES_PER_BAND) -> DataFrame:
    """(set_id, key, digest) of sets (set_id, tokens ARRAY<BIGINT>): one row a band; empty sets have none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens = batch.column("tokens")
            offsets = tokens.offsets.to_numpy(zero_copy_only=False)
            flat = tokens.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
            flat, starts = np.ascontiguousarray(flat, dtype=np.int64), (offsets[:-1] - offsets[0]).astype(np.int64)
            keys = minhash_bands(flat, starts, bands, per_band)
            places = np.bitwise_or.reduceat(np.uint64(1) << (flat.view(np.uint64) % np.uint64(_PLACES)), starts)
            digest = places | (np.minimum(np.diff(offsets), _MANY).astype(np.uint64) << np.uint64(_PLACES))
            again = np.repeat(np.arange(batch.num_rows), bands)
            yield pa.RecordBatch.from_arrays([batch.column("set_id").take(pa.array(again)), pa.array(keys.ravel()), pa.array(np.repeat(digest.view(np.int64), bands))], names=["set_id", "key", "digest"])

    return sets.where(F.size("tokens") > 0).select("set_id", "tokens").mapInArrow(run, "set_id bigint, key bigint, digest bigint")


def may_reach(a: Column, b: Column, threshold: float) -> Column:
    """False only if two sets with these digests cannot have the Jaccard similarity: shared tokens share
    places, and tokens that fall on one place are at most a set's size less its places."""
    size = lambda x: F.shiftrightunsigned(x, _PLACES)
    places = lambda x: x.bitwiseAND(F.lit((1 << _PLACES) - 1))
    hidden = lambda x: size(x) - F.bit_count(places(x))
    most = F.bit_count(places(a).bitwiseAND(places(b))) + F.least(hidden(a), hidden(b))
    return (size(a) == _MANY) | (size(b) == _MANY) | (most * (1 + threshold) >= threshold * (size(a) + size(b)) - 1e-9)


def similar_sets(sets: DataFrame, threshold: float = 0.75) -> DataFrame:
    """(train_set, eval_set) of the different sets with a Jaccard similarity of at least ``threshold``,
    the first of a train record, the second of an eval record.

    Candidates share one of 32 bands of 5 minwise hashes: a pair at 0.75 is found with probability
    0.9998, at 0.8 with 0.999997; unrelated captions of one template (0.3) with 0.07.
    Only rows of the two sides meet; both sides of a bucket are kept whole. Pairs whose digests rule the
    similarity out never leave the join; the exact one of the others is computed from the full sets.
    """
    left = band_keys(sets.where("in_train")).select(F.col("set_id").alias("a"), "key", F.col("digest").alias("da"))
    right = band_keys(sets.where("in_eval")).select(F.col("set_id").alias("b"), "key", F.col("digest").alias("db"))
    pairs = left.join(right, "key").where("a <> b").where(may_reach(F.col("da"), F.col("db"), threshold)).select("a", "b")
    half = pairs.repartition("a").distinct().join(sets.select(F.col("set_id").alias("a"), F.col("tokens").alias("ta")), "a")
    full = half.join(sets.select(F.col("set_id").alias("b"), F.col("tokens").alias("tb")), "b")
    shared = F.size(F.array_intersect("ta", "tb"))
    return full.where(shared >= F.lit(threshold) * (F.size("ta") + F.size("tb") - shared) - 1e-9).select(F.col("a").alias("train_set"), F.col("b").alias("eval_set"))


def overlaps(rows: DataFrame, threshold: float = 0.75, least_words: int = 8) -> tuple[DataFrame, DataFrame]:
    """(members, links).

    ``members`` is (row_id, k1, k2, train BOOLEAN, split, source) of the rows with a split and enough
    words; rows with the same words share the 128 bits k1, k2. ``links`` is (train_set, eval_set, t1, t2, e1, e2), the last
    four the bits of both, of all sets that overlap across the splits: equal sets and verified similar ones. A set is named by
    its smallest row_id, so that no two have one name. Null captions and captions with too few words take no part.
    """
    named = rows.select("row_id", "caption", split_name("split").alias("split"), "source").where("split is not null and caption is not null")
    named = named.withColumn("w", words("caption")).where(F.size("w") >= least_words)
    named = named.select("row_id", "split", "source", (F.col("split") == "train").alias("train"), F.xxhash64("w").alias("k1"), F.xxhash64(F.lit("two"), "w").alias("k2"), F.transform("w", lambda x: F.xxhash64(x)).alias("tokens"))
    sets = cut(
        named.groupBy("k1", "k2", "tokens").agg(F.min("row_id").alias("set_id"), F.max("train").alias("in_train"), F.max(~F.col("train")).alias("in_eval"))
    )
    same = sets.where("in_train and in_eval").select(F.col("set_id").alias("train_set"), F.col("set_id").alias("eval_set"))
    side = lambda name, k: sets.select(F.col("set_id").alias(name), F.col("k1").alias(k + "1"), F.col("k2").alias(k + "2"))
    links = cut(similar_sets(sets, threshold).union(same).join(side("train_set", "t"), "train_set").join(side("eval_set", "e"), "eval_set"))
    return named.select("row_id", "k1", "k2", "train", "split", "source"), links


def overlapping_pairs(rows: DataFrame, threshold: float = 0.75, least_words: int = 8) -> DataFrame:
    """(row_id_a, row_id_b), smaller id first: one row in train, the other in val or test."""
    members, links = overlaps(rows, threshold, least_words)
    touched = links.select(F.col("t1").alias("k1"), F.col("t2").alias("k2")).union(links.select("e1", "e2")).distinct()
    held = cut(members.select("row_id", "train", "k1", "k2").join(touched, ["k1", "k2"], "left_semi"))
    a = held.where("train").select(F.col("k1").alias("t1"), F.col("k2").alias("t2"), F.col("row_id").alias("t"))
    b = held.where("not train").select(F.col("k1").alias("e1"), F.col("k2").alias("e2"), F.col("row_id").alias("e"))
    return links.join(a, ["t1", "t2"]).join(b, ["e1", "e2"]).select(F.least("t", "e").alias("row_id_a"), F.greatest("t", "e").alias("row_id_b"))


def overlap_report(rows: DataFrame, threshold: float = 0.75, least_words: int = 8) -> DataFrame:
    """(split, source, pairs, eval_rows): confirmed pairs and touched evaluation rows per split and source.

    Train rows are counted per set before the join, so no pair of rows is made.
    """
    members, links = overlaps(rows, threshold, least_words)
    per_set = members.where("train").groupBy(F.col("k1").alias("t1"), F.col("k2").alias("t2")).agg(F.count("*").alias("n"))
    weight = links.join(per_set, ["t1", "t2"]).groupBy(F.col("e1").alias("k1"), F.col("e2").alias("k2")).agg(F.sum("n").alias("n"))
    return (
        members.where("not train").join(weight, ["k1", "k2"])
        .groupBy("split", "source").agg(F.sum("n").alias("pairs"), F.count("*").alias("eval_rows"))
    )
