import datetime as dt

import pytest
from pyspark.sql import functions as F

from momentforge.operators.vector_index import VectorIndex
from momentforge.plans.adapters import HashAdapter, Registry, generate
from momentforge.plans.service import Service, ServiceError
from momentforge.streaming import jobs as J


def test_rate_limiter_decisions():
    assert J._limited([0, 1, 2, 61], [], 2, 60)[0] == [True, True, False, True]


def test_rate_limiter_batch_and_stream(spark, tmp_path):
    rows = [("a", float(t)) for t in (0, 1, 2, 61)] + [("b", 5.0), ("b", 5.0), ("b", 5.0)]
    d = spark.createDataFrame(rows, "client string, t double")
    want = [("a", 0.0, True), ("a", 1.0, True), ("a", 2.0, False), ("a", 61.0, True), ("b", 5.0, False), ("b", 5.0, True), ("b", 5.0, True)]
    assert sorted(tuple(r) for r in J.rate_limited_batch(d, 2, 60.0).collect()) == want
    d.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = J.read_files(spark, str(tmp_path / "in"), d.schema)
    J.run_available(J.rate_limited(s, 2, 60.0), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == want


def events(spark, path):
    t = dt.datetime(2025, 1, 1)
    rows = [(1, t + dt.timedelta(minutes=m), "u", "m", float(m)) for m in (0, 1, 6, 50)]
    d = spark.createDataFrame(rows, "event_id int, ts timestamp_ntz, user_id string, model string, ms double")
    d.coalesce(1).write.parquet(path)
    return d


def test_windows_sessions_and_once(spark, tmp_path):
    d = events(spark, str(tmp_path / "in"))
    s = J.read_files(spark, str(tmp_path / "in"), d.schema)
    J.run_available(J.windowed_latency(s), str(tmp_path / "w"), str(tmp_path / "c1"))
    assert {r.n for r in spark.read.parquet(str(tmp_path / "w")).collect()} >= {2, 1}
    assert {r.n for r in J.sessions(d).collect()} == {3, 1}
    J.run_available(J.once_per_id(J.read_files(spark, str(tmp_path / "in"), d.schema), "event_id"), str(tmp_path / "o"), str(tmp_path / "c2"))
    assert spark.read.parquet(str(tmp_path / "o")).count() == 1


def test_latest_state_and_index(spark, tmp_path):
    ev = spark.createDataFrame([("j1", "queued", 0.0, 1), ("j1", "indexed", 1.0, 3), ("j2", "failed", 0.5, 2)], "job_id string, status string, progress double, updated_at int")
    ev.coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = {}
    J.each_batch(J.latest_state(J.read_files(spark, str(tmp_path / "in"), ev.schema)), lambda b, _: seen.update({r.job_id: r.status for r in b.collect()}), str(tmp_path / "c"))
    assert seen == {"j1": "indexed", "j2": "failed"}
    v = spark.createDataFrame([("a", [1.0], "v", 0.0, 1.0)], VectorIndex.SCHEMA)
    v.write.parquet(str(tmp_path / "vin"))
    for c in ("k1", "k2"):  # delivered twice
        q = J.into_index(J.read_files(spark, str(tmp_path / "vin"), v.schema), str(tmp_path / "index"), str(tmp_path / c))
        assert q.awaitTermination(120)
    assert VectorIndex(spark, str(tmp_path / "index")).count() == 1


class Broken:
    def __init__(self, model_id):
        self.model_id = model_id


@pytest.fixture(scope="module")
def service(spark):
    reg = Registry([{"model_id": "hash", "adapter": "momentforge.plans.adapters:HashAdapter"}, {"model_id": "cosine", "adapter": "momentforge.plans.adapters:CosineAdapter"}, {"model_id": "off", "adapter": "x:Y", "enabled": False}, {"model_id": "bad", "adapter": "tests.test_streaming_and_service:Broken"}])
    a = HashAdapter()
    titles = ["dog catches frisbee", "cat sleeps on sofa", "dog runs in park"]
    e = a.encode_text(titles)
    videos = spark.createDataFrame([(f"v{i}", "demo", t, t, 10.0, "ready", dt.datetime(2025, 1, i + 1)) for i, t in enumerate(titles)], "video_id string, collection_id string, title string, captions string, duration double, status string, created_at timestamp")
    windows = spark.createDataFrame([(f"v{i}_w000", f"v{i}", 0.0, 10.0, x, [2.5, 7.5], [x, e[0]]) for i, x in enumerate(e)], "window_id string, video_id string, start_sec double, end_sec double, vector array<double>, frame_times array<double>, frame_features array<array<double>>")
    return Service(spark, videos, windows, reg)


def test_service_search(service):
    hits = service.search("dog catches frisbee", 2).collect()
    assert hits[0].video_id == "v0" and [h["rank"] for h in hits] == [1, 2]
    assert service.search("cat sofa", 1, rerank=True).first().video_id == "v1"
    assert service.ask("v0", "dog catches frisbee").first().answer.startswith("The closest moment")
    assert {r.model for r in service.compare("dog", ["hash", "cosine"], 2).collect()} == {"hash", "cosine"}
    assert service.ground_truth("Dog catches: frisbee!").first().video_id == "v0"
    assert [r.video_id for r in service.list_videos(1, 1).collect()] == ["v1"]
    assert service.collections().first().videos == 3 and service.health()["status"] == "ok"


@pytest.mark.parametrize(("call", "code"), [
    (lambda s: s.search("", 3), 422), (lambda s: s.search("x", 99), 422), (lambda s: s.search("x", 3, "nope"), 404), (lambda s: s.search("x", 3, collection="nope"), 404), (lambda s: s.localize("nope", "x"), 404), (lambda s: s.compare("x", ["hash"]), 422),
])
def test_service_errors(service, call, code):
    with pytest.raises(ServiceError) as e:
        call(service)
    assert e.value.code == code


def test_registry(service):
    with pytest.raises(TypeError):
        service.registry.get("bad")
    assert {m["model_id"]: m["status"] for m in service.models()}["bad"] == "error"
    with pytest.raises(KeyError):
        service.registry.get("off")


def test_generate_in_batches(spark):
    d = spark.createDataFrame([(i, f"p{i}") for i in range(9)], "i int, prompt string")
    got = {r.i: r.model_output for r in generate(d.coalesce(1), "tests.test_streaming_and_service:shout").collect()}
    assert got[0] == "P0" and len(got) == 9
    assert d.where(F.col("i") < 0).count() == 0


def shout(prompts):
    assert len(prompts) <= 4
    return [p.upper() for p in prompts]
