"""BLEU, CIDEr and TF-IDF over relations of n-grams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ngrams, word_list
from ..session import cut

#: At most so many queries, documents and words make a block of posting lists (places have 16 bits); about so many queries
#: and postings of queries meet a block of documents at a time.
BLOCK, DOCS, WORDS, GROUP, POSTINGS = 4096, 32_768, 1_000_000, 65_536, 4_000_000


def _counts(rows: DataFrame, keys: list[str], text: str, most: int = 4) -> DataFrame:
    """(keys, n, gram, count) for n = 1 .. most."""
    words = word_list(F.lower(F.col(text)))
    grams = F.explode(F.flatten(F.array(*[F.transform(ngrams(F.col("_w"), n), lambda g: F.struct(F.lit(n).alias("n"), g.alias("gram"))) for n in range(1, most + 1)]))).alias("x")  # noqa: B023
    return rows.select(*keys, words.alias("_w")).select(*keys, grams).groupBy(*keys, "x.n", "x.gram").agg(F.count("*").alias("count"))


def bleu(predictions: DataFrame, references: DataFrame, smooth: float = 0.1) -> DataFrame:
    """(video_id, bleu1 .. bleu4): sentence BLEU per video, uniform weights; counts are clipped by the
    largest count in any reference, a zero count becomes ``smooth``, and the brevity penalty uses the
    reference length nearest to the prediction's, the shorter of two. Without words the score is 0.
    """
    p = predictions.select("video_id", F.size(word_list(F.lower("prediction"))).alias("plen"), "prediction")
    ref = references.select("video_id", F.size(word_list(F.lower("caption"))).alias("rlen"), "caption", F.xxhash64("caption").alias("ref"))
    near = p.join(ref, "video_id").groupBy("video_id").agg(F.first("plen").alias("plen"), F.min(F.struct(F.abs(F.col("rlen") - F.col("plen")).alias("d"), "rlen")).alias("x")).select("video_id", "plen", F.col("x.rlen").alias("rlen"))
    most = _counts(ref, ["video_id", "ref"], "caption").groupBy("video_id", "n", "gram").agg(F.max("count").alias("most"))
    c = _counts(p, ["video_id"], "prediction").join(most, ["video_id", "n", "gram"], "left")
    per = c.groupBy("video_id", "n").agg(F.sum(F.least("count", F.coalesce("most", F.lit(0)))).alias("hit"), F.sum("count").alias("total"))
    order = near.join(per, "video_id", "left").groupBy("video_id", "plen", "rlen").agg(*[
        F.coalesce(F.max(F.when(F.col("n") == n, F.when(F.col("hit") > 0, F.col("hit")).otherwise(smooth) / F.col("total"))), F.lit(smooth)).alias(f"p{n}") for n in range(1, 5)
    ], F.coalesce(F.max(F.when(F.col("n") == 1, F.col("hit"))), F.lit(0)).alias("hit1"))
    penalty = F.when(F.col("plen") > F.col("rlen"), 1.0).otherwise(F.exp(1 - F.col("rlen") / F.greatest(F.col("plen"), F.lit(1))))
    score = lambda k: F.round(F.when(F.col("hit1") == 0, 0.0).otherwise(penalty * F.exp(sum((F.log(f"p{n}") for n in range(2, k + 1)), F.log("p1")) / k)), 6)
    return order.select("video_id", *[score(k).alias(f"bleu{k}") for k in range(1, 5)])


def cider(predictions: DataFrame, references: DataFrame, sigma: float | None = 6.0, corpus_df: bool = True) -> DataFrame:
    """(video_id, cider): ten times the mean, over n = 1..4 and references, of the cosine of tf-idf n-gram vectors.

    ``corpus_df``: an n-gram's document frequency counts videos and idf = ln(N / (1 + df)), and a Gaussian
    penalty of ``sigma`` words takes length differences; else it counts the video's own references
    and idf = ln((refs + 1) / (df + 1)) without penalty.
    """
    p = predictions.select("video_id", "prediction", F.size(word_list(F.lower("prediction"))).alias("plen"))
    r = references.select("video_id", "caption", F.size(word_list(F.lower("caption"))).alias("rlen"))
    r = r.withColumn("ref", F.row_number().over(Window.partitionBy("video_id").orderBy("caption")))
    rc = _counts(r, ["video_id", "ref"], "caption")
    pc = _counts(p, ["video_id"], "prediction")
    if corpus_df:
        n = F.lit(float(max(references.select("video_id").distinct().count(), 1)))
        df = rc.select("video_id", "n", "gram").distinct().groupBy("n", "gram").agg(F.count("*").alias("df"))
        weigh = lambda d: d.join(df, ["n", "gram"], "left").withColumn("idf", F.log(n / (1.0 + F.coalesce("df", F.lit(0)))))
    else:
        size = r.groupBy("video_id").agg(F.count("*").alias("refs"))
        df = rc.groupBy("video_id", "n", "gram").agg(F.count("*").alias("df"))
        weigh = lambda d: d.join(size, "video_id").join(df, ["video_id", "n", "gram"], "left").withColumn("idf", F.log((F.col("refs") + 1.0) / (F.coalesce("df", F.lit(0)) + 1.0)))
    share = lambda keys: F.col("count") / F.sum("count").over(Window.partitionBy(*keys, "n"))
    pv = weigh(pc).withColumn("w", share(["video_id"]) * F.col("idf")).select("video_id", "n", "gram", F.col("w").alias("pw"))
    rv = weigh(rc).withColumn("w", share(["video_id", "ref"]) * F.col("idf")).select("video_id", "ref", "n", "gram", F.col("w").alias("rw"))
    pn = pv.groupBy("video_id", "n").agg(F.sqrt(F.sum(F.col("pw") * F.col("pw"))).alias("pn"))
    dots = rv.join(pv, ["video_id", "n", "gram"], "left").groupBy("video_id", "ref", "n").agg(F.sum(F.coalesce(F.col("rw") * F.col("pw"), F.lit(0.0))).alias("dot"), F.sqrt(F.sum(F.col("rw") * F.col("rw"))).alias("rn"))
    sim = dots.join(pn, ["video_id", "n"], "left").withColumn("s", F.coalesce(F.col("dot") / F.nullif(F.col("rn") * F.col("pn"), F.lit(0.0)), F.lit(0.0)))
    lens = r.join(p.select("video_id", "plen"), "video_id").select("video_id", "ref", "rlen", "plen")
    scale = F.exp(-((F.col("plen") - F.col("rlen")) ** 2) / (2 * sigma * sigma)) if corpus_df and sigma else F.lit(1.0)
    per = sim.join(lens, ["video_id", "ref"]).groupBy("video_id").agg(F.sum(F.col("s") * scale).alias("t"))
    refs = r.groupBy("video_id").agg(F.count("*").alias("refs"))
    return p.select("video_id").join(refs, "video_id").join(per, "video_id", "left").select("video_id", F.round(10.0 * F.coalesce("t", F.lit(0.0)) / (4.0 * F.col("refs")), 6).alias("cider"))


def tfidf_matches(docs: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, doc_id, score, rank): best documents by cosine of smooth tf-idf vectors of words and word pairs.

    idf = ln((1 + n) / (1 + df)) + 1, fitted on documents and queries together. ``docs`` is (doc_id, text),
    ``queries`` (query_id, text), a stated set; texts of one id count together, and a null id is an id, last among equal
    scores. Texts become posting lists by blocks of rows; lists meet their idf in a join, and every block of documents meets
    the packed blocks of queries in one task, which leaves at most ``k`` rows a query, so a word that stands in most documents
    makes no pair that leaves its task. Only counts pass through the driver.
    """
    n = float(docs.count() + (asking := queries.count()))
    held, asked = cut(_posted(docs, "doc_id", DOCS)), cut(_posted(queries, "query_id", BLOCK))
    df = held.unionByName(asked.withColumn("ids", F.lit(None).cast(held.schema["ids"].dataType))).where("term is not null").groupBy("term").agg(F.sum(F.octet_length("places") / 2).alias("df"))
    idf = df.select("term", (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0).alias("idf"))

    def weighed(t: DataFrame) -> DataFrame:
        none = F.array().cast(t.schema["ids"].dataType).alias("ids")  # after nulls Arrow's writer counts a batch's lists again with every row
        w = t.where("term is not null").join(idf, "term").select("block", "term", (F.col("tf") * F.col("idf")).alias("w"), "places", none)
        return w.unionByName(t.where("term is null").select("block", "term", F.lit(0.0).alias("w"), "places", "ids"))

    postings = asked.agg(F.coalesce(F.sum(F.octet_length("places")), F.lit(0))).first()[0] // 2
    groups = max(1, -(-asking // GROUP), -(-postings // POSTINGS))
    mine = weighed(held).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    blocks = held.where("term is null").select(F.col("block").alias("with"))  # one row a block
    packed = weighed(asked).groupBy("block").applyInArrow(_packed, f"block bigint, terms array<string>, codes binary, places binary, ws binary, ids {asked.schema['ids'].dataType.simpleString()}")
    theirs = packed.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int")).crossJoin(F.broadcast(blocks))
    kinds = ", ".join(f"{c} {d.schema[c].dataType.simpleString()}" for c, d in (("query_id", queries), ("doc_id", docs)))
    out = mine.groupBy("block", "part").cogroup(theirs.groupBy("with", "part")).applyInArrow(_best_of_block(k), f"{kinds}, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def _posted(rows: DataFrame, key: str, most: int) -> DataFrame:
    """(block, term, tf, places, ids): for blocks of at most ``most`` ids the places (16 bits each) of the ids that have
    a term ``tf`` times; one row a block, without a term, has the ids in their order.
    """
    words = F.transform("_t", lambda t: F.regexp_extract_all(F.lower(t), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0)))
    texts = rows.groupBy(key).agg(F.collect_list("text").alias("_t")).select(key, words.alias("_w")).sortWithinPartitions(F.asc_nulls_last(key))
    words_most = WORDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, waiting, ids, words = TaskContext.get().partitionId(), 0, [], 0, 0
        for batch in batches:
            lists = batch.column(1)
            ends = np.append(0, np.cumsum(pc.list_value_length(lists.flatten()).to_numpy(zero_copy_only=False)))[np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]
            at = 0
            while at < batch.num_rows:
                before = ends[at - 1] if at else 0
                take = min(most - ids, int(np.searchsorted(ends[at:], before + words_most - words, "right")), batch.num_rows - at)
                if not take and not ids:
                    take = 1  # longer than a block by itself
                if take:
                    waiting.append(batch.slice(at, take))
                    ids, words, at = ids + take, words + ends[at + take - 1] - before, at + take
                if at < batch.num_rows or ids == most:
                    yield _post((task << 32) + made, pa.Table.from_batches(waiting))
                    made, waiting, ids, words = made + 1, [], 0, 0
        if waiting:
            yield _post((task << 32) + made, pa.Table.from_batches(waiting))

    return texts.mapInArrow(run, f"block bigint, term string, tf int, places binary, ids array<{rows.schema[key].dataType.simpleString()}>")


def _post(block: int, rows: pa.Table) -> pa.RecordBatch:
    """The rows of ``_posted`` of one block of (id, lists of words by text)."""
    ids, lists = rows.column(0).combine_chunks(), rows.column(1).combine_chunks()
    texts = lists.flatten()
    per_text = pc.list_value_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    of_text = np.repeat(np.arange(len(ids)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    text, coded = np.repeat(np.arange(len(texts)), per_text), texts.flatten().dictionary_encode()
    word, v = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(coded.dictionary))
    first = np.flatnonzero(text[:-1] == text[1:])
    who = of_text[np.concatenate([text, text[first]])]
    one, tf = np.unique(np.concatenate([word, v + word[first] * v + word[first + 1]]) * len(ids) + who, return_counts=True)
    term, place = one // len(ids), one % len(ids)
    order = np.lexsort((place, tf, term))
    term, place, tf = term[order], place[order], tf[order]
    starts = np.flatnonzero(np.concatenate([[True], (np.diff(term) > 0) | (np.diff(tf) > 0)])) if len(term) else np.zeros(0, np.int64)
    term, tf = term[starts], tf[starts]
    pair = term >= v
    single = coded.dictionary.take(pa.array(np.where(pair, (term - v) // v, term)))
    names = pc.if_else(pa.array(pair), pc.binary_join_element_wise(single, coded.dictionary.take(pa.array(np.where(pair, (term - v) % v, 0))), " "), single)
    ends = pa.py_buffer((2 * np.append(starts, len(place))).astype(np.int32))
    places = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, ends, pa.py_buffer(place.astype("<u2"))])
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(starts) + 1, block)),
            pa.concat_arrays([pa.array([None], pa.string()), names.cast(pa.string())]),
            pa.array(np.append(0, tf).astype(np.int32)),
            pa.concat_arrays([pa.array([None], pa.binary()), places]),
            pa.concat_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.nulls(len(starts), pa.list_(ids.type))]),
        ],
        names=["block", "term", "tf", "places", "ids"],
    )


def _postings(rows: pa.Table) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The ids and the terms of one block; and for every posting its term's number, its place and its weight, of unit length over an id."""
    ids = rows["ids"].combine_chunks().flatten()
    rows = rows.filter(pc.is_valid(rows["term"]))
    coded, held = rows["term"].combine_chunks().dictionary_encode(), rows["places"].to_pylist()
    n = np.array([len(x) // 2 for x in held], np.int64)
    place = np.frombuffer(b"".join(held), "<u2").astype(np.int64)
    w = np.repeat(rows["w"].to_numpy(), n)
    return ids, coded.dictionary, np.repeat(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), n), place, w / np.sqrt(np.bincount(place, w * w, len(ids)))[place]


def _packed(rows: pa.Table) -> pa.Table:
    """One row of a block's postings, by places."""
    ids, terms, code, place, w = _postings(rows)
    order = np.lexsort((code, place))
    one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
    data = [pa.array([x[order].astype(t).tobytes()]) for x, t in ((code, "<i4"), (place, "<u2"), (w, "<f8"))]
    return pa.table([rows["block"][:1], one(terms), *data, one(ids)], names=["block", "terms", "codes", "places", "ws", "ids"])


def _best_of_block(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """(query_id, doc_id, score): for every query the ``k`` best documents of one block."""

    def run(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        docs, terms, term, doc, w = _postings(mine)
        queries, parts, before = theirs["ids"].combine_chunks().flatten(), [], 0
        for i in range(theirs.num_rows):
            asked, place, weight, codes = (theirs[c][i] for c in ("terms", "places", "ws", "codes"))
            found = pc.index_in(asked.values, value_set=terms).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)[np.frombuffer(codes.as_py(), "<i4")]
            has = found >= 0
            parts.append((before + np.frombuffer(place.as_py(), "<u2").astype(np.int64)[has], found[has], np.frombuffer(weight.as_py(), "<f8")[has]))
            before += len(theirs["ids"][i].values)
        if not parts:
            return pa.table([queries, docs.slice(0, 0), pa.array([], pa.float64())], names=["query_id", "doc_id", "score"])
        query, found, weight = (np.concatenate(x) for x in zip(*parts, strict=True))
        found, weight = found.tolist(), weight.tolist()  # by query
        order = np.lexsort((doc, term))
        term, doc, w = term[order], doc[order], w[order]
        bounds = np.searchsorted(term, np.arange(len(terms) + 1))
        full = {}  # terms of many documents as whole vectors
        segments = -(-len(docs) // 64)
        for t in set(found):
            a, b = bounds[t], bounds[t + 1]
            if (b - a) * 8 > len(docs):
                full[t] = np.zeros(64 * segments)
                full[t][doc[a:b]] = w[a:b]
        bounds = bounds.tolist()
        at_once = max(1, 4_000_000 // max(1, 64 * segments))
        out = []
        who, starts = np.unique(query, return_index=True)
        starts = np.append(starts, len(query)).tolist()
        for at in range(0, len(who), at_once):
            some = range(at, min(at + at_once, len(who)))
            scores = np.zeros((len(some), 64 * segments))
            for row, q in zip(scores, some, strict=True):
                for j in range(starts[q], starts[q + 1]):
                    t = found[j]
                    if t in full:
                        row += weight[j] * full[t]
                    else:
                        a, b = bounds[t], bounds[t + 1]
                        row[doc[a:b]] += weight[j] * w[a:b]
            least = np.zeros(len(some))  # at most the k-th best score of a query: so many segments reach it
            if segments >= k:
                least = np.partition(scores.reshape(len(some), 64, segments).max(axis=1), segments - k, axis=1)[:, segments - k]
            i, d = np.nonzero(scores >= np.maximum(least - 2e-6, np.finfo(float).tiny)[:, None])
            score = np.round(scores[i, d], 6)
            order = np.lexsort((d, -score, i))  # places follow the ids
            first = np.flatnonzero(np.concatenate([[True], np.diff(i[order]) > 0])) if len(i) else np.zeros(0, np.int64)
            best = order[np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order)))) < k]
            out.append((who[at + i[best]], d[best], score[best]))
        q, d, s = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table([queries.take(pa.array(q)), docs.take(pa.array(d)), pa.array(s)], names=["query_id", "doc_id", "score"])

    return run
