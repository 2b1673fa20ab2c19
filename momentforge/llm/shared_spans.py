"""Long passages that stand verbatim in more than one text: a log-structured fingerprint index."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, shared_dir

#: A passage of SPAN characters has SPAN - GRAM + 1 grams, one winnowing window, hence one anchor at least.
SPAN, GRAM = 160, 64
_CHUNK = 400_000
#: Odd bases of the two independent hashes of a run.
_B, _B2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of all runs of the texts laid end to end, from prefix sums modulo 2**64."""

    def __init__(self, texts: list[str], base: int = _B):
        raw = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
        self.lengths = np.array([len(r) for r in raw], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        codes = np.concatenate(raw) if raw else np.zeros(0, np.uint32)
        n = len(codes)
        with np.errstate(over="ignore"):
            power = np.full(n + 1, np.uint64(base), np.uint64)
            power[0] = 1
            np.multiply.accumulate(power, out=power)
            self.prefix = np.zeros(n + 1, np.uint64)
            np.cumsum(_mix(codes.astype(np.uint64) + np.uint64(base & 0xFFFF)) * power[:-1], out=self.prefix[1:])
            back = np.full(n + 1, np.uint64(pow(base, -1, 1 << 64)), np.uint64)
            back[0] = 1
            self.back = np.multiply.accumulate(back)

    def windows(self, width: int, text: int | None = None) -> np.ndarray:
        """Hash of the run of ``width`` characters from every place on, over all texts or one of them."""
        lo, hi = (0, self.starts[-1]) if text is None else (self.starts[text], self.starts[text + 1])
        if hi - lo < width:
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            return _mix((self.prefix[lo + width : hi + 1] - self.prefix[lo : hi + 1 - width]) * self.back[lo : hi + 1 - width])


def _slide(x: np.ndarray, width: int, by) -> np.ndarray:
    """Minimum or maximum (``by``) of every run of ``width`` values."""
    n = len(x)
    fill = _TOP if by is np.minimum else np.uint64(0)
    blocks = np.full(-(-n // width) * width, fill, np.uint64)
    blocks[:n] = x
    blocks = blocks.reshape(-1, width)
    ahead = by.accumulate(blocks, 1).ravel()
    behind = by.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return by(behind[: n - width + 1], ahead[width - 1 : n])


def winnowed(hashes: np.ndarray, inside: np.ndarray, width: int) -> np.ndarray:
    """Places whose hash is the least of some run of ``width`` places; ``inside`` marks where such runs
    may start. Of neighbouring equal hashes (one character again and again) the ends stay."""
    if len(hashes) < width:
        return np.zeros(0, np.int64)
    least = _slide(hashes, width, np.minimum)
    least[~inside[: len(least)]] = 0
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    at = np.flatnonzero((_slide(padded, width, np.maximum) == hashes) & (hashes > 0))
    if not len(at):
        return at
    same = (np.diff(at) == 1) & (hashes[at[1:]] == hashes[at[:-1]])
    inner = np.zeros(len(at), bool)
    inner[1:-1] = same[:-1] & same[1:]
    return at[~inner]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold about 400,000 characters, one text at least."""
    for batch in batches:
        size = np.array(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False), np.int64)
        at = 0
        while at < batch.num_rows:
            upto = at + max(1, int(np.searchsorted(np.cumsum(size[at:]), _CHUNK, "right")))
            yield batch.slice(at, upto - at)
            at = upto


def fingerprints(texts: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(h, text_id, pos) of texts (text_id, text): the anchors of every text, by winnowing.

    Any passage of ``span`` characters that two texts share has an anchor that both of them keep.
    """
    width = span - gram + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _chunks(batches):
            r = Rolling(part.column("text").to_pylist())
            h = r.windows(gram)
            inside = np.zeros(len(h) + 1, np.int64)
            long = r.lengths >= span
            np.add.at(inside, r.starts[:-1][long], 1)
            np.add.at(inside, (r.starts[1:] - span + 1)[long], -1)
            at = winnowed(h, np.cumsum(inside)[:-1] > 0, width)
            of = np.searchsorted(r.starts, at, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[at].view(np.int64)), part.column("text_id").take(pa.array(of)), pa.array((at - r.starts[of]).astype(np.int32))],
                names=["h", "text_id", "pos"],
            )

    return texts.select("text_id", "text").mapInArrow(run, "h bigint, text_id bigint, pos int")


def _windows(texts_with_places: DataFrame, span: int, gram: int, every: bool) -> DataFrame:
    """(w, v, text_id, pos, n) of texts (text_id, text, places): the two 64-bit hashes, by independent polynomials, of the
    span-long windows that hold an anchor at one of the places; all of them, or those that winnowing over span-long windows keeps.

    Of all of them, n neighbours with one hash (one character again and again) are one row, which has
    those between the anchors at its ends too."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _chunks(batches):
            texts = part.column("text").to_pylist()
            r, other = Rolling(texts), Rolling(texts, _B2)
            out: list[tuple[np.ndarray, ...]] = []
            for i, places in enumerate(part.column("places").to_pylist()):
                w = r.windows(span, i)
                if not len(w):
                    continue
                p = np.asarray(places, np.int64)
                edge = np.zeros(len(w) + 1, np.int64)
                np.add.at(edge, np.clip(p + gram - span, 0, len(w)), 1)
                np.add.at(edge, np.clip(p + 1, 0, len(w)), -1)
                near = np.cumsum(edge)[:-1] > 0
                if every:
                    first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
                    held = np.logical_or.reduceat(near, first)
                    at, n = first[held], np.diff(np.append(first, len(w)))[held]
                else:
                    keep = np.zeros(len(w), bool)
                    keep[winnowed(w, np.ones(len(w), bool), span // 2 + 1)] = True
                    at = np.flatnonzero(near & keep)
                    n = np.ones(len(at), np.int64)
                out.append((w[at], other.windows(span, i)[at], np.full(len(at), i), at, n))
            if out:
                w, v, of, at, n = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(w.view(np.int64)), pa.array(v.view(np.int64)), part.column("text_id").take(pa.array(of)), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32))],
                    names=["w", "v", "text_id", "pos", "n"],
                )

    return texts_with_places.select("text_id", "text", "places").mapInArrow(run, "w bigint, v bigint, text_id bigint, pos int, n int")


def _contexts(texts_with_places: DataFrame, span: int, gram: int) -> DataFrame:
    """(w, text_id, pos): hashes of the text that ends, and of the text that begins, with each place's anchor
    and reaches half of the rest of a span beyond it. A shared span around an anchor holds one of the two."""
    wide = gram + -(-(span - gram) // 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _chunks(batches):
            r = Rolling(part.column("text").to_pylist())
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for i, places in enumerate(part.column("places").to_pylist()):
                w = r.windows(wide, i)
                p = np.asarray(places, np.int64)
                left, right = p[p + gram >= wide], p[p < len(w)]
                with np.errstate(over="ignore"):
                    h = np.concatenate([_mix(w[left + gram - wide] + np.uint64(1)), w[right]])
                out.append((h, np.full(len(h), i), np.concatenate([left, right])))
            if out:
                w, of, at = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(w.view(np.int64)), part.column("text_id").take(pa.array(of)), pa.array(at.astype(np.int32))], names=["w", "text_id", "pos"]
                )

    return texts_with_places.select("text_id", "text", "places").mapInArrow(run, "w bigint, text_id bigint, pos int")


class SpanIndex:
    """Sorted immutable runs of (h, text_id, pos) below a folder: ``root``, or one of this process in the shared folder.

    ``add`` writes a batch of texts as a new run, merge-joins it with the runs before and returns
    the hashes that now stand in two texts; ``compact`` merges the runs into one. Only hashes cross
    the exchange of the join, pre-aggregated to the smallest and largest text a hash: a boilerplate
    passage in a third of all texts leaves each task as one row a hash.

    Manifests are numbered files that name the runs; the newest counts. A later process opens the same ``root`` and adds
    its batch. A writer claims the next number, which only one can, and raises if another was faster: its run then is
    in no manifest, and the batch can be added again. Old runs and manifests stay for readers that have begun.
    """

    def __init__(self, spark: SparkSession, span: int = SPAN, gram: int = GRAM, max_runs: int = 4, root: str | None = None):
        self.spark, self.span, self.gram, self.max_runs = spark, span, gram, max_runs
        self.root = (root or shared_dir(spark)).rstrip("/")
        self._number, self.runs = self._newest()

    def _path(self, name: str = ""):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifest/{name}".rstrip("/"))
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _newest(self) -> tuple[int, list[str]]:
        """(number, runs) of the newest manifest; (0, []) before the first."""
        folder, fs = self._path()
        names = [x.getPath().getName() for x in fs.listStatus(folder)] if fs.exists(folder) else []
        number = max((int(n.removesuffix(".runs")) for n in names if n.endswith(".runs")), default=0)
        if not number:
            return 0, []
        lines = self.spark.read.text(f"{self.root}/manifest/{number}.runs").collect()  # a line a run, at most max_runs
        meta = json.loads(lines[0][0])
        if (meta["span"], meta["gram"]) != (self.span, self.gram):
            raise ValueError(f"the index has spans of {meta['span']} and grams of {meta['gram']}")
        return number, [f"{self.root}/{name}" for name in meta["runs"]]

    def _publish(self, runs: list[str]) -> None:
        claim, fs = self._path(str(self._number + 1))
        fs.mkdirs(claim.getParent())
        if not fs.createNewFile(claim):
            raise RuntimeError("another writer changed the index: open it again and repeat the batch")
        target, _ = self._path(f"{self._number + 1}.runs")
        out = fs.create(target, False)
        out.write(json.dumps({"span": self.span, "gram": self.gram, "runs": [r.rsplit("/", 1)[-1] for r in runs]}).encode())
        out.close()
        self._number, self.runs = self._number + 1, runs

    def _write(self, rows: DataFrame) -> str:
        path = f"{self.root}/run-{uuid.uuid4().hex}"
        rows.sortWithinPartitions("h").write.parquet(path)
        return path

    def entries(self, runs: list[str] | None = None) -> DataFrame:
        runs = self.runs if runs is None else runs
        if not runs:
            return self.spark.createDataFrame([], "h bigint, text_id bigint, pos int")
        return self.spark.read.schema("h bigint, text_id bigint, pos int").parquet(*runs)

    def add(self, texts: DataFrame) -> DataFrame:
        ends = lambda d, a, b: d.groupBy("h").agg(F.min("text_id").alias(a), F.max("text_id").alias(b))
        old, path = list(self.runs), self._write(fingerprints(texts, self.span, self.gram))
        self._publish([*old, path])
        new = ends(self.entries([path]), "lo", "hi")
        if old:
            new = new.join(ends(self.entries(old), "old_lo", "old_hi").hint("merge"), "h", "left")
            lo, hi = F.least("lo", F.coalesce("old_lo", "lo")), F.greatest("hi", F.coalesce("old_hi", "hi"))
        else:
            lo, hi = F.col("lo"), F.col("hi")
        shared = cut(new.where(lo < hi).select("h"))
        if len(self.runs) > self.max_runs:
            self.compact()
        return shared

    def compact(self) -> None:
        """One sorted run instead of many."""
        self._publish([self._write(self.entries().repartitionByRange("h"))])


def _named(docs: DataFrame, span: int) -> DataFrame:
    """(doc_id, text, k1, k2) of the long texts; two texts count as one if their 128 bits agree."""
    return docs.select("doc_id", "text", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit("two"), "text").alias("k2")).where(F.length("text") >= span)


def _first_texts(named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(whole, texts): the doc_id of all documents whose text several have; (text_id, text) of every different text, named
    by the smallest doc_id that has it, so that no two texts share a name."""
    slim = cut(named.select("doc_id", "k1", "k2"))
    copies = cut(slim.groupBy("k1", "k2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("k1", "k2", "first"))
    members = cut(slim.join(copies, ["k1", "k2"]).select("doc_id", "first").distinct())
    again = members.where("doc_id <> first").select("doc_id")
    return members.select("doc_id"), named.join(again, "doc_id", "left_anti").select(F.col("doc_id").alias("text_id"), "text")


def _anchored(docs: DataFrame, span: int, gram: int, batches: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(whole, texts, hits): hits (h, text_id, pos) are all entries whose hash stands in two texts."""
    whole, texts = _first_texts(_named(docs, span))
    index, shared = SpanIndex(docs.sparkSession, span, gram), None
    for b in range(batches):
        part = texts if batches == 1 else texts.where(F.pmod(F.xxhash64(F.lit(3), "text_id"), F.lit(batches)) == b)
        found = index.add(part)
        shared = found if shared is None else shared.union(found)
    hits = cut(index.entries().join(shared.distinct(), "h", "left_semi"))
    return whole, texts, hits


def _with_places(texts: DataFrame, hits: DataFrame) -> DataFrame:
    """A text has as many places as anchors at most, so the list is bounded by its own length."""
    return texts.join(hits.groupBy("text_id").agg(F.collect_list("pos").alias("places")), "text_id")


def _in_two(windows: DataFrame) -> DataFrame:
    """The hashes (w, and v where there are two) that stand in two texts."""
    keys = [c for c in ("w", "v") if c in windows.columns]
    return windows.groupBy(*keys).agg(F.min("text_id").alias("lo"), F.max("text_id").alias("hi")).where("lo < hi").select(*keys)


def sharing_documents(docs: DataFrame, span: int = SPAN, gram: int = GRAM, batches: int = 5) -> DataFrame:
    """(doc_id) of every document with a run of ``span`` or more characters that stands verbatim in another's text.

    Texts of ``span`` characters and more that several documents have count whole. Different texts
    meet through the index (fed in ``batches``), then through hashes of whole span-long windows: first
    the winnowed ones, which any run of 1.5 spans has in common; for the texts these leave open, and the
    texts that share an anchor with them, all windows around those anchors of which the text half a
    span to the left or right is shared too. A window counts as equal when
    its two independent 64-bit hashes are. Null and shorter texts are never cases.
    """
    whole, texts, hits = _anchored(docs, span, gram, batches)
    held = cut(_with_places(texts, hits).select("text_id", "text", "places"))
    some = cut(_windows(held, span, gram, every=False))
    sure = cut(some.join(_in_two(some), ["w", "v"], "left_semi").select("text_id").distinct())
    doubt = hits.join(sure, "text_id", "left_anti").select("h").distinct()
    places = lambda d: d.groupBy("text_id").agg(F.collect_set("pos").alias("places"))
    open_texts = cut(held.drop("places").join(places(hits.join(cut(doubt), "h", "left_semi")), "text_id"))
    sides = cut(_contexts(open_texts, span, gram))
    near = places(sides.join(_in_two(sides), "w", "left_semi"))
    rest = cut(_windows(open_texts.drop("places").join(near, "text_id"), span, gram, every=True).select("w", "v", "text_id"))
    more = rest.join(_in_two(rest), ["w", "v"], "left_semi").select("text_id")
    # a text is named by its first document, and the others that have it are in ``whole``
    return whole.union(sure).union(more).distinct()


def shared_parts(docs: DataFrame, span: int = SPAN, gram: int = GRAM, batches: int = 5) -> DataFrame:
    """(doc_id, n_chars, shared_chars, shared_share): how much of every document stands elsewhere in
    runs of ``span`` or more characters; 0 for null, empty and short texts.

    All span-long windows around shared anchors are hashed; the characters that shared windows cover
    are counted once, stretches of one repeated character included.
    """
    whole, texts, hits = _anchored(docs, span, gram, batches)
    windows = cut(_windows(_with_places(texts, hits), span, gram, every=True))
    at = windows.join(_in_two(windows), ["w", "v"], "left_semi").groupBy("text_id").agg(F.array_sort(F.collect_set(F.struct("pos", (F.col("pos") + F.col("n") - 1 + span).alias("end")))).alias("at"))
    zero = F.struct(F.lit(0).alias("covered"), F.lit(0).alias("upto"))
    step = lambda s, p: F.struct((s["covered"] + p["end"] - F.greatest(p["pos"], s["upto"])).alias("covered"), p["end"].alias("upto"))
    covered = at.select(F.col("text_id").alias("doc_id"), F.aggregate("at", zero, step)["covered"].alias("covered"))
    all_docs = docs.select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("n_chars"))
    joined = all_docs.join(covered, "doc_id", "left").join(whole.withColumn("copy", F.lit(True)), "doc_id", "left")
    part = F.when(F.col("copy") & (F.col("n_chars") >= span), F.col("n_chars")).otherwise(F.coalesce("covered", F.lit(0)))
    return joined.select("doc_id", "n_chars", part.alias("shared_chars"), F.when(F.col("n_chars") > 0, part / F.col("n_chars")).otherwise(0.0).alias("shared_share"))
