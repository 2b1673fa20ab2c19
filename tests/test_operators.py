import numpy as np
import pytest
from pyspark.sql import functions as F

from momentforge.operators import benchmarks as B
from momentforge.operators import captions as C
from momentforge.operators import evaluation as E
from momentforge.operators import localize as L
from momentforge.operators import search as S
from momentforge.operators import splits as P
from momentforge.operators import stats as X
from momentforge.operators import text_metrics as M
from momentforge.operators import vector_index as I

CAP = "row_id bigint, video_id string, caption string, source string, clip_sim double"


def span_col(spans):
    return F.array(*[F.struct(F.lit(float(a)).alias("start"), F.lit(float(b)).alias("end"), F.lit(float(s)).alias("score")) for a, b, s in spans])


def test_dedup_keeps_the_first_source(spark):
    d = spark.createDataFrame([(1, "a", "the red car", "MSVD", 0.1), (2, "b", "the red car", "MSR-VTT", 0.1), (3, "b", "the red car", "MSR-VTT", 0.1), (4, "c", None, "MSVD", 0.1)], CAP)
    n = C.normalized(d)
    assert sorted(r.row_id for r in C.deduplicated(n, "intra").collect()) == [1, 2]
    assert [r.row_id for r in C.deduplicated(n).collect()] == [2]
    with pytest.raises(ValueError):
        C.deduplicated(n, "other")


def test_quality_gate(spark):
    nan = float("nan")
    d = spark.createDataFrame([(1, "a", "x", "s", 0.10), (2, "a", "x", "s", 0.14), (3, "b", "x", "s", 0.05), (4, "b", "x", "s", 0.20), (5, "c", "x", "s", None), (6, "d", "x", "s", nan)], CAP)
    assert sorted(r.row_id for r in C.similarity_gate(d, 0.15).collect()) == [3, 4]


def test_funnel_of_nothing(spark):
    r = C.funnel(spark.createDataFrame([], CAP)).first()
    assert (r.total, r.retained, r.retained_pct) == (0, 0, 0.0)


def test_leaks_and_mixed(spark):
    d = spark.createDataFrame([("a", "train"), ("a", "val"), ("b", "train"), (None, "val"), (None, "train"), ("c", None)], "video_id string, split string")
    assert [tuple(r) for r in C.leaks(d).collect()] == [("train", "val", 1, "a")]
    assert [tuple(r) for r in P.mixed_videos(d).collect()] == [("a", 2)]


def test_stratified_split(spark):
    v = spark.range(1000).select(F.col("id").cast("string").alias("video_id"), F.when(F.col("id") % 10 == 0, "test").alias("split_hint"), (F.col("id") % 3).cast("string").alias("category"))
    a = {tuple(r) for r in P.stratified_split(v, "category").collect()}
    b = {tuple(r) for r in P.stratified_split(v.repartition(9), "category").collect()}
    assert a == b and len(a) == 1000 and sum(s == "val" for _, s in a) == 90 and sum(s == "test" for _, s in a) == 100
    thin = v.withColumn("category", F.col("video_id"))
    assert P.stratified_split(thin, "category").where("split = 'val'").count() == 90
    assert P.stratified_split(v.limit(0), "category").count() == 0


def test_samples(spark):
    v = spark.range(500).select("id", F.when(F.col("id") < 450, "big").otherwise("small").alias("source"))
    assert P.sampled(v, "id", 20).count() == 20
    assert {r.source: r["count"] for r in P.capped_per_source(v, "source", "id", 60).groupBy("source").count().collect()} == {"big": 60, "small": 50}
    d = {r.source: r["count"] for r in P.equal_source_draws(v, "source", "id", 4000).groupBy("source").count().collect()}
    assert sum(d.values()) == 4000 and abs(d["small"] - 2000) < 200
    assert {r.split: r["count"] for r in P.shuffled_split(v, "id").groupBy("split").count().collect()} == {"val": 50, "train": 450}


def gallery(spark, n=300, width=8, seed=0):
    x = np.float32(np.random.default_rng(seed).standard_normal((n, width)))
    return x, spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id bigint, vector array<float>")


def test_unit_axes_search(spark):
    g = spark.createDataFrame([("a", [1.0, 0.0, 0.0], "v1"), ("b", [0.0, 1.0, 0.0], "v2"), ("c", [0.0, 0.0, 1.0], "v2")], "id string, vector array<float>, video_id string")
    assert S.top_k(g, [0.0, 1.0, 0.0], 1).first().id == "b"
    assert {r.id for r in S.top_k(g, [0.0, 1.0, 0.0], 5, F.col("video_id") == "v2").collect()} == {"b", "c"}


def test_block_search_equals_numpy(spark):
    x, g = gallery(spark)
    q = g.where("id < 7").select(F.col("id").alias("query_id"), "vector")
    got = {(r.query_id, r["rank"]): r.id for r in S.block_top_k(g, q, 4).collect()}
    s = np.round(x[:7].astype(float) @ x.astype(float).T, 6)
    for i in range(7):
        assert [got[i, k + 1] for k in range(4)] == list(np.lexsort((np.arange(300), -s[i]))[:4])
    assert S.block_top_k(g.limit(0), q, 3).count() == 0 and S.block_top_k(g, q.limit(0), 3).count() == 0


def test_query_sets_larger_than_a_block(spark, monkeypatch):
    _, g = gallery(spark)
    q = g.where("id < 60").select(F.col("id").alias("query_id"), F.col("id").alias("truth_id"), "vector")
    once = {tuple(r) for r in S.block_top_k(g, q, 3).collect()}, {tuple(r) for r in E.truth_ranks(g, q).collect()}
    monkeypatch.setattr(S, "MAX_BLOCK", 20)
    assert ({tuple(r) for r in S.block_top_k(g, q, 3).collect()}, {tuple(r) for r in E.truth_ranks(g, q).collect()}) == once


def test_search_modes_and_limits(spark):
    w = spark.createDataFrame([(f"v{i // 60}_w{i % 60}", f"v{i // 60}", 0.0, 10.0, [1.0 - i / 1000, 0.0]) for i in range(180)], "window_id string, video_id string, start_sec double, end_sec double, vector array<float>")
    exact = S.search_moments(w, [1.0, 0.0], 3).collect()
    assert [(r.video_id, r["rank"]) for r in exact] == [("v0", 1), ("v1", 2), ("v2", 3)]
    assert len(S.search_moments(w, [1.0, 0.0], 3, mode="compat").collect()) == 1
    for bad in ("", " " * 5, "x" * 201):
        with pytest.raises(ValueError):
            S.check_request(bad)
    with pytest.raises(ValueError):
        S.check_request("ok", 51)
    assert S.candidate_depth(10) == (50, 10) and S.candidate_depth(20, 50) == (100, 50)


def test_truth_ranks_and_metrics(spark):
    x, g = gallery(spark)
    q = spark.createDataFrame([(i, (i * 7) % 300, [float(a) for a in x[i] + x[(i * 7) % 300]]) for i in range(20)] + [(99, 5000, [0.0] * 8)], "query_id int, truth_id bigint, vector array<float>")
    ranks = E.truth_ranks(g, q)
    got = {r.query_id: r["rank"] for r in ranks.collect()}
    assert len(got) == 20
    for i in range(20):
        s = np.round(np.float64(np.float32(x[i] + x[(i * 7) % 300])) @ x.astype(float).T, 6)
        t = (i * 7) % 300
        assert got[i] == 1 + (s > s[t]).sum() + ((s == s[t]) & (np.arange(300) < t)).sum()
    m = E.retrieval_metrics(ranks).first()
    assert m.queries == 20 and m.r1 == pytest.approx(np.mean([v == 1 for v in got.values()])) and m.mrr == pytest.approx(np.mean([1 / v for v in got.values()]), abs=1e-6)


def test_confusion(spark):
    r = spark.createDataFrame([(1,), (3,)], "rank int")
    c = E.confusion(r, 10, [1]).first()
    assert (c.tp, c.fn, c.fp, c.tn) == (1, 1, 1, 17)
    assert [round(x.share, 2) for x in E.match_curve(r, 3).orderBy("k").collect()] == [0.5, 0.5, 1.0]


def test_losses(spark):
    rng = np.random.default_rng(0)
    z = rng.standard_normal((4, 4))
    pos = np.eye(4) + (np.abs(np.subtract.outer(range(4), range(4))) == 2)
    d = spark.createDataFrame([(0, i, j, float(z[i, j]), bool(pos[i, j])) for i in range(4) for j in range(4)], "batch_id int, i int, j int, logit double, positive boolean")
    ls = lambda m: m - np.log(np.exp(m).sum(1, keepdims=True))
    want = np.mean([-(ls(m) * p).sum(1).dot(1 / p.sum(1)) / 4 for m, p in ((z, pos), (z.T, pos.T))])
    assert E.contrastive_loss(d).first().loss == pytest.approx(want, abs=1e-5)


def test_bleu_and_cider(spark):
    p = spark.createDataFrame([("a", "the cat sat on the mat"), ("b", "no match"), ("c", "")], "video_id string, prediction string")
    r = spark.createDataFrame([("a", "the cat sat on the mat"), ("a", "a cat lay down"), ("b", "birds fly south"), ("c", "something here")], "video_id string, caption string")
    got = {x.video_id: x for x in M.bleu(p, r).collect()}
    assert got["a"].bleu4 == pytest.approx(1.0) and got["b"].bleu1 == 0.0 and got["c"].bleu1 == 0.0
    c = {x.video_id: x.cider for x in M.cider(p, r).collect()}
    assert c["a"] > c["b"] == 0.0 and c["c"] == 0.0
    assert {x.video_id: x.cider for x in M.cider(p, r, corpus_df=False).collect()}["a"] > 0


def test_cider_against_plain_python(spark):
    import math
    from collections import Counter

    refs = {"a": ["the cat sat on a mat", "a cat on a mat"], "b": ["dogs run fast in parks", "two dogs run"], "c": ["a man walks"]}
    pred = {"a": "a cat sat on the mat", "b": "dogs run in the park", "c": "a man runs"}
    grams = lambda t, n: Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1))
    df = Counter(g for v in refs.values() for n in range(1, 5) for g in {x for r in v for x in grams(r.split(), n)})

    def vec(t, n):
        c = grams(t, n)
        return {g: k / max(sum(c.values()), 1) * math.log(3 / (1 + df[g])) for g, k in c.items()}

    got = {x.video_id: x.cider for x in M.cider(spark.createDataFrame(list(pred.items()), "video_id string, prediction string"), spark.createDataFrame([(v, c) for v, cs in refs.items() for c in cs], "video_id string, caption string")).collect()}
    for v in refs:
        total = 0.0
        for n in range(1, 5):
            for r in refs[v]:
                a, b = vec(pred[v].split(), n), vec(r.split(), n)
                na, nb = (math.sqrt(sum(x * x for x in y.values())) for y in (a, b))
                s = sum(a[g] * b.get(g, 0) for g in a) / (na * nb) if na and nb else 0
                total += s * math.exp(-((len(pred[v].split()) - len(r.split())) ** 2) / 72) / len(refs[v]) / 4
        assert got[v] == pytest.approx(10 * total, abs=1e-5)


def test_tfidf(spark):
    d = spark.createDataFrame([(1, "red car drives fast"), (2, "blue boat sails"), (3, None)], "doc_id int, text string")
    q = spark.createDataFrame([(7, "a fast red car"), (8, "boat")], "query_id int, text string")
    assert {(r.query_id, r.doc_id) for r in M.tfidf_matches(d, q, 1).collect()} == {(7, 1), (8, 2)}


def test_span_cleanup(spark):
    spans = [(2, 6, 0.9), (2.5, 6.5, 0.8), (5.5, 8, 0.7), (10, 10.2, 0.6), (12, 13, 0.5), (14, 15, 0.4)]
    got = [tuple(s) for s in spark.range(1).select(L.clean_spans(span_col(spans), F.lit(20.0))).first()[0]]
    assert len(got) == 3 and got[0] == (2.0, 8.0, 0.9) and got[1][1] - got[1][0] == pytest.approx(1.0)
    assert [s[2] for s in got] == sorted((s[2] for s in got), reverse=True)
    assert tuple(spark.range(1).select(L.clean_spans(span_col([(-3, 50, 0.5)]), F.lit(12.0))).first()[0][0]) == (0.0, 12.0, 0.5)


def test_span_cleanup_against_plain_python(spark):
    import random

    def plain(spans, d):
        fixed = []
        for a, b, s in spans:
            lo, hi = max(0.0, min(a, b)), min(d, max(a, b))
            if hi - lo < 1:
                c = (lo + hi) / 2
                lo = max(0.0, c - 0.5)
                hi = min(d, lo + 1)
                lo = max(0.0, hi - 1)
            if hi > lo:
                fixed.append((lo, hi, s))
        kept, merged = [], []
        for x in sorted(fixed, key=lambda x: -x[2]):
            if all((max(0, min(x[1], k[1]) - max(x[0], k[0])) / (max(x[1], k[1]) - min(x[0], k[0]))) <= 0.5 for k in kept):
                kept.append(x)
        for x in kept:
            i = next((i for i, m in enumerate(merged) if x[0] < m[1] and m[0] < x[1]), None)
            if i is None:
                merged.append(x)
            else:
                m = merged[i]
                merged[i] = (min(m[0], x[0]), max(m[1], x[1]), max(m[2], x[2]))
        return sorted(merged, key=lambda x: -x[2])[:3]

    rng = random.Random(1)
    rows = [(i, [(rng.randrange(-4, 40) / 2, rng.randrange(-4, 40) / 2, rng.randrange(1, 100) / 100) for _ in range(rng.randrange(0, 9))]) for i in range(60)]
    d = spark.createDataFrame(rows, "i int, s array<struct<start:double,end:double,score:double>>").select("i", L.clean_spans(F.col("s"), F.lit(15.0)).alias("s"))
    for r in d.collect():
        assert [tuple(x) for x in r.s] == [pytest.approx(x, abs=0.006) for x in plain(rows[r.i][1], 15.0)]


def test_strip(spark):
    t, v = F.array(*map(F.lit, (1.0, 3.0, 5.0))), F.array(*map(F.lit, (0.2, 0.9, 0.2)))
    got = spark.range(1).select(L.strip(t, v, F.lit(6.0))).first()[0]
    assert len(got) == 6 and max(got) <= 1 and got[2] > got[0] and got[0] == 0.0 and got[1] == pytest.approx(0.375)
    assert spark.range(1).select(L.strip(F.array().cast("array<double>"), F.array().cast("array<double>"), F.lit(6.0))).first()[0] is None


def test_localize(spark):
    f = lambda x: [float(x), float(1 - x)]
    w = spark.createDataFrame([("w0", "v", [0.5, 1.5, 2.5], [f(0), f(0), f(1)]), ("w1", "v", [2.5004, 3.5, 4.5], [f(1), f(1), f(0)]), ("w2", "u", [1.0], [f(1)]), ("w3", "x", None, None)], "window_id string, video_id string, frame_times array<double>, frame_features array<array<double>>")
    fr = L.frames(w)
    assert fr.where("video_id = 'v'").count() == 5
    got = {r.video_id: r for r in L.localized(w, [1.0, 0.0], spark.createDataFrame([("v", 5.0), ("u", 3.0)], "video_id string, duration double")).collect()}
    assert [tuple(s)[:2] for s in got["v"].spans] == [(2.0, 4.0)] and len(got["v"].strip) == 5 and len(got["u"].spans) == 1
    best = {r.video_id: r.t for r in L.best_time(L.saliency(fr, [1.0, 0.0])).collect()}
    assert best == {"v": 2.5, "u": 1.0}


def test_histogram_and_describe(spark):
    d = spark.createDataFrame([(0.0,), (10.0,), (None,), (11.0,)], "v double")
    assert [r["count"] for r in X.histogram(d, F.col("v"), 0, 10, 2).orderBy("bin").collect()] == [1, 1]
    r = X.describe(spark.createDataFrame([(1.0,), (2.0,), (4.0,), (10.0,), (float("nan"),)], "v double"), F.col("v")).first()
    assert (r.p95, r.median, r.mean) == (9.1, 3.0, 4.25)


def test_latency(spark):
    d = spark.createDataFrame([("m", '{"total": 10}'), ("m", '{"total": 20}'), ("n", "{}"), ("n", None)], "model string, latency_json string")
    assert {r.model: (r.n, r.p50) for r in X.latency_percentiles(d).collect()} == {"m": (2, 15.0), "n": (2, 0.0), None: (4, 5.0)}


def test_benchmark_view(spark):
    rows = [("CLIP", "fine_tuned", "MSRVTT", "R@1", 0.34), ("CLIP", "fine_tuned", "MSRVTT", "Top1Accuracy", 0.34), ("CLIP", "fine_tuned", "MSRVTT", "avg_query_latency_sec", 0.0365), ("Net", None, "MSVD", "MedianRank", 2.0), ("Old", "", "MSVD", "MedR", 3.0)]
    d = spark.createDataFrame(rows, "model string, variant string, dataset string, metric_name string, metric_value double")
    v = B.benchmark_view(d, [{"match": {"model": "clip"}, "protocol": "p"}, {"match": {}, "notes": "n"}])
    got = {(r.model, r.metric): r for r in v.collect()}
    assert got["CLIP (fine-tuned)", "latency_ms"].value == 36.5 and len(got) == 4 and got["CLIP (fine-tuned)", "R@1"].protocol == "p" and got["Net", "MedR"].notes == "n"
    assert B.benchmark_view(d, [], "msr-vtt", "clip").count() == 2
    assert {r.model for r in B.best_marked(v).where("best and metric = 'MedR'").collect()} == {"Net"}


def test_index_and_store(spark, tmp_path):
    index = I.VectorIndex(spark, str(tmp_path / "index"))
    assert index.count() == 0
    rows = lambda *x: spark.createDataFrame(x, index.SCHEMA)
    index.upsert(rows(("a", [1.0, 0.0], "v1", 0.0, 1.0), ("b", [0.0, 1.0], "v2", 0.0, 1.0), ("c", [0.5, 0.5], "v2", 1.0, 2.0)))
    old = index.rows()
    index.upsert(rows(("b", [0.0, 2.0], "v2", 0.0, 1.0)))
    assert index.count() == 3 and index.search([0.0, 1.0], 1).first().score == 2.0 and old.where("id = 'b'").first().vector == [0.0, 1.0]
    index.delete(spark.createDataFrame([("a",)], "id string"))
    assert index.count() == 2 and index.search([1.0, 0.0], 5, "v1").count() == 0
    store = I.FeatureStore(spark, str(tmp_path / "features"))
    store.put("m", spark.createDataFrame([("w1", [[1.0]], [0.5]), ("w2", [[2.0]], [0.5])], store.SCHEMA))
    ids = spark.createDataFrame([("w1",), ("nope",)], "window_id string")
    assert [r.window_id for r in store.get_many("m", ids).collect()] == ["w1"]
    store.delete("m", ids)
    assert store.get_many("m", spark.createDataFrame([("w2",)], "window_id string")).count() == 1
    store.drop_model("m")
    assert store.get_many("m", spark.createDataFrame([("w2",)], "window_id string")).count() == 0


def test_import_and_windows(spark):
    files = spark.createDataFrame([("a", "x/a.mp4"), ("b", "x/b_two.mp4"), ("c", "x/c.mp4")], "video_id string, path string")
    meta = spark.createDataFrame([("a", "Title")], "video_id string, title string")
    have = spark.createDataFrame([("a", "ready"), ("c", "failed")], "video_id string, status string")
    got = {r.video_id: (r.title, r.status, r.action) for r in I.imported(files, meta, have).collect()}
    assert got == {"a": ("Title", "ready", "skip"), "b": ("b two", "queued", "insert"), "c": ("c", "queued", "update")}
    w = I.window_rows(spark.createDataFrame([("a", 12.0), ("b", None)], "video_id string, duration double"))
    assert [r.window_id for r in w.collect()] == ["a_w000", "a_w001"]


def test_bleu_against_plain_python(spark):
    import math
    from collections import Counter

    grams = lambda t, n: Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1))

    def plain(p, refs, order):
        logs = 0.0
        for n in range(1, order + 1):
            c = grams(p, n)
            most = Counter()
            for r in refs:
                most |= grams(r, n)
            hit, total = sum(min(k, most[g]) for g, k in c.items()), max(1, sum(c.values()))
            if n == 1 and not hit:
                return 0.0
            logs += math.log((hit or 0.1) / total)
        near = min((abs(len(r) - len(p)), len(r)) for r in refs)[1]
        return (1.0 if len(p) > near else math.exp(1 - near / len(p))) * math.exp(logs / order)

    data = {"a": ("a cat sat on the mat today", ["the cat sat on the mat", "a cat lay on a mat"]), "b": ("the the the", ["the dog runs far away now"]), "c": ("two dogs", ["two dogs play", "dogs play"]), "d": ("red car", ["blue boat"])}
    p = spark.createDataFrame([(k, v[0]) for k, v in data.items()], "video_id string, prediction string")
    r = spark.createDataFrame([(k, c) for k, v in data.items() for c in v[1]], "video_id string, caption string")
    for row in M.bleu(p, r).collect():
        pred, refs = data[row.video_id][0].split(), [x.split() for x in data[row.video_id][1]]
        assert [row.bleu1, row.bleu2, row.bleu3, row.bleu4] == pytest.approx([plain(pred, refs, n) for n in range(1, 5)], abs=1e-5)


def test_tfidf_in_many_blocks_like_plain_python(spark, monkeypatch):
    import collections
    import math
    import random
    import re

    rng, words = random.Random(3), ["dog", "cat", "cow", "runs", "sits", "eats", "the", "on", "a", "grass_1"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    d = [(f"d{i:03}", text(rng.randrange(8))) for i in range(150)] + [("d001", "the dog"), ("d002", None), (None, "The cow, the COW"), (None, "eats")] + [(f"e{i}", "the cow eats") for i in range(9)]
    q = [(i, text(rng.randrange(5))) for i in range(40)] + [(3, "cow eats"), (None, "the dog sits"), (50, ""), (51, "zebra"), (52, "the cow eats")]

    def terms(rows):
        out = collections.defaultdict(collections.Counter)
        for key, t in rows:
            w = re.findall(r"\w{2,}", (t or "").lower())
            out[key].update(w + [f"{x} {y}" for x, y in zip(w, w[1:])])
        return out

    dt, qt = terms(d), terms(q)
    df = collections.Counter(t for v in (*dt.values(), *qt.values()) for t in v)
    unit = lambda v: {t: n * (math.log((1 + len(d) + len(q)) / (1 + df[t])) + 1) / math.sqrt(sum((m * (math.log((1 + len(d) + len(q)) / (1 + df[u])) + 1)) ** 2 for u, m in v.items())) for t, n in v.items()}
    du, qu, want = {k: unit(v) for k, v in dt.items()}, {k: unit(v) for k, v in qt.items()}, set()
    for i, v in qu.items():
        best = sorted(((-round(sum(v[t] * x[t] for t in v if t in x), 6), j is None, j or "") for j, x in du.items() if v.keys() & x.keys()))[:4]
        want |= {(i, None if none else j, -s, r) for r, (s, none, j) in enumerate(best, 1)}

    docs, asked = spark.createDataFrame(d, "doc_id string, text string"), spark.createDataFrame(q, "query_id int, text string")
    assert {tuple(r) for r in M.tfidf_matches(docs, asked, 4).collect()} == want
    for name, most in (("BLOCK", 3), ("DOCS", 20), ("WORDS", 60), ("GROUP", 10), ("POSTINGS", 50)):
        monkeypatch.setattr(M, name, most)
    assert {tuple(r) for r in M.tfidf_matches(docs, asked, 4).collect()} == want


def test_tfidf_keeps_rows_out_of_the_driver(spark, monkeypatch):
    d = spark.createDataFrame([(i, f"word{i} dog") for i in range(50)], "doc_id int, text string")
    collected, collect = [], type(d).collect

    def counted(self):
        rows = collect(self)
        collected.append(len(rows))
        return rows

    monkeypatch.setattr(type(d), "collect", counted)
    monkeypatch.setattr(M, "BLOCK", 10)
    out = M.tfidf_matches(d, d.withColumnRenamed("doc_id", "query_id"), 1)
    assert sum(collected) <= 3  # counts only
    monkeypatch.undo()
    assert {(r.query_id, r.doc_id) for r in out.collect()} == {(i, i) for i in range(50)}
