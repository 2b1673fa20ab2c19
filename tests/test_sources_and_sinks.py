import json

import pytest
from pyspark.sql import functions as F

from momentforge.sources import readers as R
from momentforge.sources import writers as W


def put(path, what):
    path.write_text(what if isinstance(what, str) else json.dumps(what), encoding="utf-8")
    return str(path)


def test_full_annotations(spark, tmp_path):
    body = {"videos": [{"video_id": "video1", "category": 3, "url": "u", "split": "train", "start time": 1.0, "end time": 2.0}], "sentences": [{"video_id": "video1", "caption": "a"}, {"video_id": "video2", "caption": "b"}]}
    got = R.scan_full_annotations(spark, [put(tmp_path / "full_test.json", body)]).collect()
    assert {(r.video_id, r.caption, r.category, r.split_hint) for r in got} == {("video1", "a", "3", "test"), ("video2", "b", "unknown", "test")}


def test_listed_annotations(spark, tmp_path):
    body = [{"video_id": "v1", "caption": ["a", "b"]}, {"clip_name": "v2", "caption": "c"}, {"video": "v3.mp4", "caption": "d"}, {"video_id": "v4"}]
    train = put(tmp_path / "train.json", body)
    got = R.scan_splits(spark, {"train": train, "val": str(tmp_path / "none.json")})
    assert {(r.video_id, r.caption, r.split_hint) for r in got.collect()} == {("v1", "a", "train"), ("v1", "b", "train"), ("v2", "c", "train"), ("v3", "d", "train")}
    assert {r.video_id: r.captions for r in R.annotation_videos(got).collect()}["v1"] == ["a", "b"]
    assert R.scan_splits(spark, {}).count() == 0


def test_files(spark, tmp_path):
    for n in ("v1.mkv", "v1.mp4", "v2.avi", "v3.mp4", "notes.txt"):
        (tmp_path / n).write_bytes(b"" if n == "v3.mp4" else b"x")
    files = R.staged_files(spark, str(tmp_path))
    assert {r.video_id for r in files.collect()} == {"v1", "v2"}
    rows = spark.createDataFrame([("v1",), ("v2",), ("v9",)], "video_id string")
    got = {r.video_id: r.path for r in R.video_paths(rows, files).collect()}
    assert got["v1"].endswith("v1.mp4") and got["v2"].endswith("v2.avi") and got["v9"] == ""
    names = spark.createDataFrame([("v1.mkv",), ("v2.mp4",), ("zz",)], "name string")
    looked = {r.name: r.path for r in R.looked_up(names, files).collect()}
    assert looked["v1.mkv"].endswith("v1.mkv") and looked["v2.mp4"].endswith("v2.avi") and looked["zz"] is None
    assert {r.found: r.videos for r in R.copy_report(rows, files).collect()} == {True: 2, False: 1}
    assert R.existing(str(tmp_path), str(tmp_path / "no")) == [str(tmp_path)] and R.first_existing(str(tmp_path / "sub"), "v1.mp4").endswith("v1.mp4")


def test_csv_sources(spark, tmp_path):
    m = put(tmp_path / "m.csv", "﻿filename,name\nclip1,hello\nclip2.avi,there\n,lost\n")
    assert {tuple(r) for r in R.scan_manifest_csv(spark, m).collect()} == {("clip1.mp4", "hello"), ("clip2.avi", "there")}
    with pytest.raises(ValueError):
        R.scan_manifest_csv(spark, put(tmp_path / "e.csv", "video,caption\n,\n"))
    meta = put(tmp_path / "meta.csv", "video_id,title,collection,source,license,captions\na,One,c,s,l,x|y\n,Blank,c,s,l,\na,Two,c,s,l,\n")
    assert [(r.video_id, r.title) for r in R.scan_metadata_csv(spark, meta).collect()] == [("a", "Two")]
    assert {r.video_id for r in R.scan_split_ids(spark, put(tmp_path / "ids.csv", "videoid\nv1\nv1\nv2\n")).collect()} == {"v1", "v2"}
    res = put(tmp_path / "r.csv", "model,variant,dataset,metric_name,metric_value,source_file\nA,b,c,R@1,0.5,f\n")
    assert R.scan_results(spark, res).first().metric_value == 0.5


def test_discovered_json(spark, tmp_path):
    a = put(tmp_path / "a.json", {"data": [{"id": "v1", "text": "hello"}, {"video_id": "v2", "caption": "there"}]})
    b = put(tmp_path / "b.json", [{"video": "v3", "sentence": "x"}])
    assert {(r.video_id, r.caption) for p in (a, b) for r in R.discovered_captions(spark, p).collect()} == {("v1", "hello"), ("v2", "there"), ("v3", "x")}


def test_zip_and_config(spark, tmp_path, monkeypatch):
    a, b = spark.createDataFrame([(0, [1.0])], "ordinal int, v array<double>"), spark.createDataFrame([(0, "x"), (1, "y")], "ordinal int, id string")
    with pytest.raises(ValueError):
        R.zipped(a, b)
    assert R.zipped(a, b.limit(1)).count() == 1
    monkeypatch.setenv("MF_DIR", "/data")
    assert R.load_config(put(tmp_path / "c.yaml", "path: ${MF_DIR}/x\nother: ${NOT_SET:-7}\n")) == {"path": "/data/x", "other": 7}


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([("a", "train", ["f1"]), ("b", "val", ["f2"])], "video_id string, split string, frame_paths array<string>")
    W.write_stage(d, str(tmp_path / "stage"), "split")
    assert (tmp_path / "stage" / "split=val").exists() and spark.read.parquet(str(tmp_path / "stage")).count() == 2
    W.write_frame_map(d, str(tmp_path / "frames"))
    assert spark.read.json(str(tmp_path / "frames")).count() == 2
    for _ in range(2):
        W.append_metrics(spark.createDataFrame([("m", 0.5)], "metric string, value double"), str(tmp_path / "metrics"))
    assert spark.read.option("header", True).csv(str(tmp_path / "metrics")).count() == 2
    W.append_rows(d.select("video_id"), str(tmp_path / "log"))
    assert [r.video_id for r in W.only_new(spark.createDataFrame([("a",), ("z",)], "video_id string"), spark, str(tmp_path / "log"), "video_id").collect()] == ["z"]
    assert W.only_new(d, spark, str(tmp_path / "nothing"), "video_id").count() == 2
    assert W.markdown_table(d.select("video_id").orderBy("video_id")) == "| video_id |\n|---|\n| a |\n| b |\n"
    W.write_markdown({"T": d.select("video_id")}, str(tmp_path / "r.md"))
    assert (tmp_path / "r.md").read_text().startswith("## T")
    assert W.export_folder(str(tmp_path / "none"), str(tmp_path / "to")) == "Skipped" and W.export_folder(str(tmp_path / "log"), str(tmp_path / "to")) == "Success"
    log = spark.createDataFrame([("q1", "dog", "m", ["a"], {"total": 3.0})], "query_id string, query string, model string, result_ids array<string>, latency map<string,double>")
    assert W.query_log(log).first().latency_json == '{"total":3.0}'
    W.write_jsonl(log.select("query"), str(tmp_path / "j"))
    assert R.preview_jsonl(spark, str(tmp_path / "j"), 1, "query string").first().query == "dog"


def test_batches_reach_the_sink(spark, tmp_path):
    target = str(tmp_path)

    def send(part):
        import uuid

        with open(f"{target}/{uuid.uuid4().hex}-{len(part)}", "w") as f:
            f.write("x")

    W.upsert_in_batches(spark.range(250).coalesce(1), send, 100)
    assert sorted(int(p.name.split("-")[1]) for p in tmp_path.iterdir()) == [50, 100, 100]
    assert spark.range(1).select(F.lit(1)).count() == 1


def test_data_js_raises_instead_of_cutting(spark, tmp_path):
    path = tmp_path / "rows.js"
    with pytest.raises(ValueError, match="too many rows"):
        W.write_data_js({"t": spark.range(100_001)}, str(path))
    assert not path.exists()
    W.write_data_js({"t": spark.range(100_000)}, str(path))
    assert path.read_text().count('"id"') == 100_000
