import datetime as dt
import warnings

import pytest
from pyspark.sql import functions as F

from momentforge.operators import benchmarks, search, stats, vector_index
from momentforge.operators.captions import frames_from_video
from momentforge.plans.adapters import Adapter, HashAdapter, Registry
from momentforge.plans.service import Service, ServiceError
from momentforge.session import clean_up, cut, path_exists
from momentforge.sources import readers, writers


@pytest.fixture
def service(spark):
    reg = Registry([{"model_id": "hash", "adapter": "momentforge.plans.adapters:HashAdapter"}])
    titles = ["dog catches frisbee", "cat sleeps on sofa"]
    e = HashAdapter().encode_text(titles)
    videos = spark.createDataFrame([(f"v{i}", "demo", t, t, 10.0, "ready", dt.datetime(2025, 1, i + 1)) for i, t in enumerate(titles)], "video_id string, collection_id string, title string, captions string, duration double, status string, created_at timestamp")
    windows = spark.createDataFrame([(f"v{i}_w000", f"v{i}", 0.0, 10.0, x, [2.5, 7.5], [x, e[0]]) for i, x in enumerate(e)], "window_id string, video_id string, start_sec double, end_sec double, vector array<double>, frame_times array<double>, frame_features array<array<double>>")
    return Service(spark, videos, windows, reg)


def test_results_have_spans(service):
    hit = service.search("cat sleeps on sofa", 1).first()
    assert hit.video_id == "v1" and hit.spans and hit.spans[0].start < 5 and len(hit.strip) == 10
    assert "spans" not in service.search("cat", 1, spans=False).columns


def test_adapters_have_the_whole_protocol(spark, service):
    a = HashAdapter()
    assert isinstance(a, Adapter)
    got = {r.window_id: r for r in a.encode_window(service.windows.select("window_id", "frame_times", "frame_features")).collect()}
    assert abs(sum(x * x for x in got["v1_w000"].vector) - 1) < 1e-9 and got["v1_w000"].times == [2.5, 7.5]


def test_video_upload_job_feedback_reindex(service):
    assert [w.window_id for w in service.video("v0").first().windows] == ["v0_w000"]
    ok = {"duration": 12.0, "width": 64, "height": 48, "has_video": True}
    for bad, code in ((("a.txt", "text/plain", 5, ok), 415), (("a.mp4", "video/mp4", 10**10, ok), 413), (("a.mp4", "video/mp4", 0, ok), 400), (("a.mp4", "video/mp4", 5, None), 415), (("a.mp4", "video/mp4", 5, ok | {"duration": 1e6}), 413)):
        with pytest.raises(ServiceError) as e:
            service.upload(*bad)
        assert e.value.code == code
    video_id, job_id = service.upload("my_clip.mp4", "video/mp4; x=1", 5, ok)
    assert service.video(video_id).first().status == "queued" and service.video(video_id).first().windows == []
    assert service.job(job_id).first().progress == 0.05
    assert service.give_feedback("q", "v0", True, (1.0, 2.0)) == {"status": "recorded"} and service.feedback.first().span_end == 2.0
    again, windows = service.reindex("hash", "demo")
    assert windows.count() == 2 and service.job(again).first().status == "queued"
    for call in (lambda: service.video("x"), lambda: service.job("x"), lambda: service.give_feedback("q", "x", True), lambda: service.reindex("x", "demo"), lambda: service.reindex("hash", "x")):
        with pytest.raises(ServiceError) as e:
            call()
        assert e.value.code == 404


def test_own_protocol_and_notes_stay(spark):
    rows = spark.createDataFrame([("CLIP", "a", "MSVD", "R@1", 0.3, "own", None), ("CLIP", "b", "MSVD", "R@1", 0.4, "", "mine")], "model string, variant string, dataset string, metric_name string, metric_value double, protocol string, notes string")
    got = {r.model: (r.protocol, r.notes) for r in benchmarks.benchmark_view(rows, [{"match": {"model": "clip"}, "protocol": "rule", "notes": "n"}]).collect()}
    assert got == {"CLIP (a)": ("own", "n"), "CLIP (b)": ("rule", "mine")}


def test_the_last_of_repeated_ids_stays(spark, tmp_path):
    old = spark.createDataFrame([("a", "old"), ("b", "old")], "id string, v string")
    new = spark.createDataFrame([("a", "first"), ("c", "x"), ("a", "last")], "id string, v string")
    assert {tuple(r) for r in vector_index.upserted(old, new).collect()} == {("a", "last"), ("b", "old"), ("c", "x")}
    index = vector_index.get_index(spark, str(tmp_path), "m", "c")
    row = lambda i, x: (i, [x], "v", 0.0, 1.0)
    index.upsert(spark.createDataFrame([row("a", 1.0), row("a", 2.0)], index.SCHEMA))
    assert [list(r.vector) for r in index.rows().collect()] == [[2.0]]
    with pytest.raises(NotImplementedError):
        vector_index.get_index(spark, str(tmp_path), "m", "c", "chroma")
    with pytest.raises(ValueError):
        vector_index.get_index(spark, str(tmp_path), "m", "c", "nope")


def test_no_update_of_two_writers_is_lost(spark, tmp_path):
    one, two = vector_index.VectorIndex(spark, str(tmp_path)), vector_index.VectorIndex(spark, str(tmp_path))
    rows = lambda i, x=1.0: spark.createDataFrame([(i, [x], "v", 0.0, 1.0)], one.SCHEMA)
    current, seen = one._current, []

    def slow():
        got = current()
        if not seen:
            seen.append(1)
            two.upsert(rows("b"))  # another writer ends between the read and the claim
        return got

    one._current = slow
    one.upsert(rows("a"))
    assert {r.id for r in one.rows().collect()} == {"a", "b"}


def test_segments_are_merged_and_small(spark, tmp_path):
    index = vector_index.VectorIndex(spark, str(tmp_path), most_segments=3)
    row = lambda i, x: spark.createDataFrame([(i, [x], "v", 0.0, 1.0)], index.SCHEMA)
    for k in range(7):
        index.upsert(row(f"i{k % 4}", float(k)))
        assert len(index._current()[1]) <= 3
    index.delete(spark.createDataFrame([("i0",)], "id string"))
    index.upsert(row("i1", 9.0))
    assert {r.id: r.vector[0] for r in index.rows().collect()} == {"i1": 9.0, "i2": 6.0, "i3": 3.0}


def test_paths_with_a_scheme(spark, tmp_path):
    f = tmp_path / "train.json"
    f.write_text('[{"video_id": "v", "caption": "a dog"}]')
    with warnings.catch_warnings(record=True) as told:
        warnings.simplefilter("always")
        got = readers.scan_splits(spark, {"train": f"file://{f}", "val": f"file://{tmp_path}/none.json"}).collect()
    assert [r.split_hint for r in got] == ["train"] and any("none.json" in str(w.message) for w in told)
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "deep" / "er" / "x.csv").write_text("a")
    assert readers.first_existing(str(tmp_path), "x.csv") == str(tmp_path / "deep" / "er" / "x.csv")
    assert readers.first_existing(f"file://{tmp_path}", "train.json") == f"file://{tmp_path}/train.json" and readers.first_existing(str(tmp_path), "no") is None


def test_a_table_that_cannot_be_read_raises(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "part.parquet").write_bytes(b"no parquet")
    rows = spark.createDataFrame([("a",)], "id string")
    with pytest.raises(Exception):  # noqa: B017
        writers.only_new(rows, spark, str(tmp_path / "t"), "id").count()
    assert writers.only_new(rows, spark, str(tmp_path / "none"), "id").count() == 1


def test_places_times_features_and_frames(spark):
    d = spark.range(1000).select(F.format_string("v%04d", "id").alias("video_id"), (F.col("id") % 7).cast("double").alias("score"))
    got = search.numbered(d, [F.desc("score"), F.col("video_id")]).collect()
    want = sorted(got, key=lambda r: (-r.score, r.video_id))
    assert [r["rank"] for r in want] == list(range(1, 1001))
    hits = spark.createDataFrame([("a", 1.0), ("b", 0.5)], "video_id string, score double")
    times = spark.createDataFrame([("a", [1.0, 2.0, 3.0, 4.0])], "video_id string, timestamps array<double>")
    assert {r.video_id: r.best_timestamp for r in search.with_times(hits, times).collect()} == {"a": 3.0, "b": 0.0}
    pool = spark.createDataFrame([("w1",), ("w2",)], "window_id string")
    store = spark.createDataFrame([("w1", [[1.0]], [0.5])], "window_id string, features array<array<double>>, times array<double>")
    assert {r.window_id: r.times for r in search.with_features(pool, store).collect()} == {"w1": [0.5], "w2": None}
    rows = spark.createDataFrame([(1, "v", "c", ["x", "y", "z"])], "row_id int, video_id string, caption string, frame_paths array<string>")
    assert frames_from_video(rows).count() == 3 and [r.frame for r in frames_from_video(rows, 2).collect()] == ["x", "y"]


def test_collections_and_codecs(spark):
    have = spark.createDataFrame([("uploads", "Mine", "")], "id string, name string, description string")
    got = {r.id: r.name for r in vector_index.with_default_collections(have).collect()}
    assert len(got) == 3 and got["uploads"] == "Mine"
    codecs = spark.createDataFrame([("h264",), ("h264",), (None,), ("vp9",)], "codec string")
    assert {r.codec: r.videos for r in stats.codec_counts(codecs).collect()} == {"h264": 2, "vp9": 1}


def test_written_tables_can_be_removed(spark):
    path = cut(spark.range(3)).inputFiles()[0].rsplit("/", 1)[0]
    assert path_exists(spark, path)
    assert clean_up(spark) >= 1 and not path_exists(spark, path)


def test_tfidf_in_blocks(spark, monkeypatch):
    from momentforge.operators import text_metrics as M

    d = spark.createDataFrame([(i, f"the {a} {b}") for i, (a, b) in enumerate((a, b) for a in ("dog", "cat", "cow") for b in ("runs", "sits", "eats"))], "doc_id int, text string")
    q = spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(["the dog", "cow eats", "nothing here", "", "the the cat sits"])], "query_id string, text string")
    once = {tuple(r) for r in M.tfidf_matches(d, q, 3).collect()}
    monkeypatch.setattr(M, "BLOCK", 1)
    assert {tuple(r) for r in M.tfidf_matches(d, q, 3).collect()} == once and {r[0] for r in once} == {"q0", "q1", "q4"}
    assert M.tfidf_matches(d, q.limit(0)).count() == 0 and M.tfidf_matches(d.limit(0), q).count() == 0


def test_quantiles_from_sketches(spark):
    d = spark.range(1, 1002).select(F.col("id").cast("double").alias("x"), F.lit("a").alias("g"))
    exact, near = (stats.describe(d, F.col("x"), ["g"], exact=e).first() for e in (True, False))
    assert exact.median == near.median == 501 and abs(exact.p95 - near.p95) <= 1
