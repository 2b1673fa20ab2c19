"""Vector and score functions, as Column expressions that add up in DOUBLE."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unit(v: Column, epsilon: float = 1e-12) -> Column:
    """The vector over its length, or over ``epsilon`` where it is shorter."""
    return let(v, lambda a: let(F.greatest(norm(a), F.lit(epsilon)), lambda n: F.transform(a, lambda x: x.cast("double") / n)))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-12))


def sound(v: Column, width: int = 64) -> Column:
    """``width`` finite numbers, not all zero."""
    fine = (F.size(v) == width) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.coalesce(fine, F.lit(False))


def mean_rows(rows: Column, width: int, normed: bool) -> Column:
    """The mean of the rows of a matrix, each normed first on request; null for no rows."""
    of = F.transform(rows, lambda r: unit(r)) if normed else rows  # noqa: PLW0108 - a second parameter would be the index
    total = F.aggregate(of, F.array_repeat(F.lit(0.0), width), lambda s, r: F.zip_with(s, r, lambda a, b: a + b.cast("double")))
    return F.when(F.size(rows) > 0, F.transform(total, lambda x: x / F.size(rows)))


def pooled(rows: Column, width: int = 64, normed: bool = True) -> Column:
    """One unit vector of many frames: mean, then norm; frames are normed first on request."""
    return unit(mean_rows(rows, width, normed))


def masked_mean(values: Column, mask: Column) -> Column:
    kept = F.aggregate(F.zip_with(values, mask, lambda x, m: x.cast("double") * m.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return kept / F.greatest(F.aggregate(mask, F.lit(0.0), lambda s, m: s + m.cast("double")), F.lit(1.0))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def fuse_logistic(stage1: Column, rerank: Column) -> Column:
    return sigmoid((F.coalesce(rerank, stage1) - 0.3) * 7.0)


def fuse_range(stage1: Column, rerank: Column | None = None) -> Column:
    """A cosine of 0.15 to 0.40 mapped to 0 to 1."""
    return clamp((stage1 - 0.15) / 0.25)


def fuse_two_stage(stage1: Column, rerank: Column) -> Column:
    return F.when(rerank.isNotNull(), sigmoid(rerank)).otherwise(sigmoid((stage1 - 0.2) * 10))


def fuse_half(stage1: Column, rerank: Column | None = None) -> Column:
    return clamp((stage1 + 1) / 2)


def _md5_low(*parts: Column) -> Column:
    """The first eight bytes of the digest of the joined parts, read little-endian, modulo 10,000.

    The number is below 2**64: it is split in two halves, as BIGINT holds 63 bits.
    """
    digest = F.md5(F.concat_ws("\x1f", *parts))
    byte = lambda i: F.substring(digest, 2 * i + 1, 2)
    low = F.conv(F.concat(*[byte(i) for i in (3, 2, 1, 0)]), 16, 10).cast("bigint")
    high = F.conv(F.concat(*[byte(i) for i in (7, 6, 5, 4)]), 16, 10).cast("bigint")
    return ((high % 10_000) * (4_294_967_296 % 10_000) + low) % 10_000


def jittered(stage1: Column, query_key: Column, item: Column) -> Column:
    """The first-stage score moved by up to 0.06 either way, by a digest of query and item."""
    return stage1 + 0.12 * (_md5_low(query_key, item) / 10_000.0 - 0.5)


def hash_embedding(words: Column, width: int = 64) -> Column:
    """A deterministic text embedding: every word adds +1 or -1 to a hashed place, then the length is 1."""
    place = lambda w: F.pmod(F.xxhash64(w), F.lit(width)).cast("int")
    sign = lambda w: F.when(F.pmod(F.xxhash64(F.lit(1), w), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    return unit(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.aggregate(F.filter(words, lambda w: place(w) == i), F.lit(0.0), lambda s, w: s + sign(w))))
