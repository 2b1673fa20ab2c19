import zipfile

import pytest
from pyspark.sql import functions as F

from momentforge.operators import ingest as G
from momentforge.sources import writers as W


def probe(content):
    return {"duration": float(len(content)), "width": 4, "height": 3, "has_video": True} if content else 1 / 0


def encode(pdf):
    return [[s, 1.0] for s in pdf["start_sec"]]


def tags(text):
    return text.split()


def test_probe(spark):
    d = spark.createDataFrame([("a", bytearray(b"xyz")), ("b", bytearray(b""))], "path string, content binary")
    got = {r.path: r for r in G.probed(d, "tests.test_ingest:probe").collect()}
    assert got["a"].duration == 3.0 and got["a"].width == 4 and got["b"].duration is None and not got["b"].has_video


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("in/v1.mp4", b"1")
        z.writestr("v2.mp4", b"2")
    got = G.archive_members(spark, str(tmp_path / "a.zip"), spark.createDataFrame([("v1",)], "video_id string")).collect()
    assert [(r.name, bytes(r.content)) for r in got] == [("in/v1.mp4", b"1")]


def test_embedding(spark):
    w = spark.createDataFrame([(f"w{i}", "v", float(i), i + 10.0) for i in range(4)], "window_id string, video_id string, start_sec double, end_sec double")
    done = spark.createDataFrame([("m", "w0")], "model_id string, window_id string")
    e = G.embedded(w, [("m", "tests.test_ingest:encode"), ("n", "tests.test_ingest:encode")], done)
    assert e.count() == 7 and G.progress(w, e, 2).first().progress == 0.875
    with pytest.raises(ValueError):
        G.unit_vectors_only(e)
    v = spark.createDataFrame([("v", "c", " READY ")], "video_id string, collection_id string, status string")
    assert G.to_reindex(v, w, "c").count() == 4 and G.to_reindex(v, w, "d").count() == 0


def test_lookups(spark):
    q = spark.createDataFrame([("v", "a"), ("x", "b"), (None, "c")], "video_id string, caption string")
    kept, counts = G.answered(q, spark.createDataFrame([("v",)], "video_id string"))
    assert kept.count() == 1 and tuple(counts.first()) == (1, 2)
    view = spark.createDataFrame([("A", "D", "R@1", 0.5)], "model string, dataset string, metric string, value double")
    models = spark.createDataFrame([("a", "A"), ("b", "B")], "model_id string, label string")
    assert {r.model_id: r.value for r in G.headline(models, view, "D").collect()} == {"a": 0.5, "b": None}
    assert {r.tag: r["count"] for r in G.tagged(q, "tests.test_ingest:tags").collect()} == {"a": 1, "b": 1, "c": 1}
    one = spark.range(1).select(G.residual(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(10.0))).alias("r"), G.short_id("v_", F.lit("a")).alias("i")).first()
    assert one.r == pytest.approx([0.5**0.5] * 2) and len(one.i) == 14


def test_tables_and_page(spark, tmp_path):
    assert G.ensure_table(spark, str(tmp_path / "t"), "a int") and not G.ensure_table(spark, str(tmp_path / "t"), "a int")
    W.write_data_js({"x": spark.range(2)}, str(tmp_path / "d.js"))
    assert (tmp_path / "d.js").read_text() == 'const DATA = {"x": [{"id": 0}, {"id": 1}]};\n'
    assert "created_at" in W.stamped(spark.range(1)).columns
