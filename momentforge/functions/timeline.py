"""Frame and window arithmetic on a video's time line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def even_indices(total: Column, n: int) -> Column:
    """``n`` whole frame numbers spread over 0 .. total - 1, cut to whole numbers; 0 alone for n = 1."""
    if n == 1:
        return F.array(F.lit(0))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * (total - 1) / float(n - 1)).cast("int"))


def ends_and_middle(total: Column) -> Column:
    return F.array(F.lit(0), F.floor(total / 2).cast("int"), (total - 1).cast("int"))


def rounded_indices(total: Column, n: int) -> Column:
    """As ``even_indices`` but rounded half to even; repeats stay when there are fewer frames than n."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.bround(i * (total - 1) / float(max(n - 1, 1))).cast("int"))


def every_kth(frames: Column, fps: Column, target: float, default_fps: float = 30.0) -> Column:
    """(index, seconds) of every k-th frame with k = fps / target, 1 at least; fps 0 counts as the default."""
    f = F.when(fps > 0, fps.cast("double")).otherwise(default_fps)
    step = F.greatest(F.floor(f / target).cast("int"), F.lit(1))
    numbers = F.when(frames > 0, F.sequence(F.lit(0), (frames - 1).cast("int"), step)).otherwise(F.array().cast("array<int>"))
    return F.transform(numbers, lambda i: F.struct(i.alias("frame"), F.round(i / f, 2).alias("seconds")))


def segment_centres(start: Column, end: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: start + (i + 0.5) * (end - start) / n)


def windows(duration: Column, width: float = 10.0, stride: float = 5.0, whole: bool = False) -> Column:
    """(start, end) windows over a clip: one if it is short or ``whole``, else overlapping ones of which the
    last ends with the clip; starts that fall together count once. Null or no duration gives none."""
    d = duration.cast("double")
    one = F.array(F.struct(F.lit(0.0).alias("start"), F.round(d, 3).alias("end")))
    if not whole:
        n = F.ceil((d - width) / stride).cast("int") + 1
        starts = F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.round(F.least(i * stride, d - width), 3)))
        many = F.transform(starts, lambda s: F.struct(s.alias("start"), F.round(s + width, 3).alias("end")))
        one = F.when(d <= width, one).otherwise(many)
    return F.when(d > 0, one).otherwise(F.array().cast("array<struct<start:double,end:double>>"))


def resize_geometry(width: Column, height: Column, size: int = 224) -> Column:
    """Size after the short side becomes ``size``, and the offsets of the centre square."""
    short = F.greatest(F.least(width, height), F.lit(1))
    w, h = F.round(width * size / short).cast("int"), F.round(height * size / short).cast("int")
    return F.struct(w.alias("w"), h.alias("h"), F.floor((w - size) / 2).cast("int").alias("x"), F.floor((h - size) / 2).cast("int").alias("y"))


def aspect(width: Column, height: Column, slack: float = 0.03) -> Column:
    """The first of the usual ratios within ``slack``, else other; unknown without a size."""
    r = width / F.nullif(height, F.lit(0))
    # The usual ratios in order.
    out = F.when(~((width > 0) & (height > 0)) | width.isNull() | height.isNull(), "unknown")
    for name, value in (("4:3", 4 / 3), ("16:9", 16 / 9), ("3:2", 3 / 2), ("1:1", 1.0), ("5:4", 5 / 4)):
        out = out.when(F.abs(r - value) < slack, name)
    return out.otherwise("other")
