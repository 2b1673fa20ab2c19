import numpy as np
from pyspark.sql import functions as F

from momentforge.llm import similar_vectors as S

BASE = "window_id string, video_id string, embedding array<float>, frame_features array<array<float>>"


def brute(ids, x, k=5):
    s = x @ x.T
    np.fill_diagonal(s, -2)
    order = np.argsort(-np.round(s, 12), 1, kind="stable")[:, :k]
    return {tuple(sorted((ids[i], ids[j]))) for i in range(len(x)) for j in order[i] if s[i, j] >= 0.9}


def test_hadamard_is_orthogonal():
    h = S.hadamard(np.eye(8))
    assert np.allclose(h @ h.T, 8 * np.eye(8))


def test_pairs_against_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((60, 64))
    x = np.repeat(centres, 6, 0) + 0.15 * rng.standard_normal((360, 64))
    ids = [f"w{i:04d}" for i in range(360)]
    rows = [(i, None, [float(a) for a in np.float32(v)], None) for i, v in zip(ids, x, strict=True)]
    d = spark.createDataFrame(rows + rows[:40], BASE).withColumn("vec_id", F.lit(1)).withColumn("key", F.lit(1))
    got = {tuple(r) for r in S.near_window_pairs(d).collect()}
    y = np.float32(x).astype(float)
    want = brute(ids, y / np.linalg.norm(y, axis=1, keepdims=True))
    assert len(want & got) >= 0.98 * len(want) and len(got - want) <= 0.02 * len(want)


def test_copies_are_ranked_by_id_and_stay_small(spark):
    v = [float(i % 7 - 3) for i in range(64)]
    rows = [(f"w{i:03d}", None, v, None) for i in range(300)]
    got = S.nearest(S.window_vectors(spark.createDataFrame(rows, BASE))).collect()
    assert len(got) == 1500
    assert sorted(r.neighbour for r in got if r.window_id == "w002") == ["w000", "w001", "w003", "w004", "w005"]
    assert {r.neighbour for r in got if r.window_id == "w200"} == {f"w{i:03d}" for i in range(5)}


def test_which_vector_counts(spark):
    one, nan = [1.0] * 64, float("nan")
    frames = [[2.0] * 64, [4.0] * 64]
    rows = [("a", None, one, None), ("b", None, [0.0] * 64, frames), ("c", None, [1.0] * 32, frames), ("d", None, [nan] * 64, None), ("e", None, None, None), ("f", None, None, []), ("g", None, one[:63] + [float("inf")], frames), (None, None, one, None), ("h", None, None, [[1.0] * 64, [-1.0] * 64]), ("i", None, [], [[nan] * 64]), ("j", None, one[:63] + [None], frames)]
    got = {r.window_id: r.vector for r in S.window_vectors(spark.createDataFrame(rows, BASE)).collect()}
    assert sorted(got) == ["a", "b", "c", "g", "j"] and got["b"] == [6.0] * 64


def test_no_rows(spark):
    assert S.near_window_pairs(spark.createDataFrame([], BASE)).count() == 0


def test_scaled_copies(spark):
    rng = np.random.default_rng(2)
    v = rng.standard_normal(64)
    rows = [("a", None, [float(x) for x in v], None), ("b", None, [float(3 * x) for x in v], None)]
    assert [tuple(r) for r in S.near_window_pairs(spark.createDataFrame(rows, BASE)).collect()] == [("a", "b")]


def test_exact_neighbours_of_a_query_set(spark):
    rng = np.random.default_rng(4)
    x = np.float32(rng.standard_normal((500, 64)))
    x[7] = x[3]
    ids = [f"w{i:04d}" for i in range(500)]
    w = S.window_vectors(spark.createDataFrame([(i, None, [float(a) for a in v], None) for i, v in zip(ids, x, strict=True)], BASE)).cache()
    asked = w.where(F.substring("window_id", 5, 1).isin("3", "7"))
    for block in (8192, 40):
        got = {}
        for r in S.nearest_exact(w, asked, 5, block).collect():
            got.setdefault(r.window_id, {})[r["rank"]] = r.neighbour
        y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
        s = np.round(y @ y.T, 12)
        np.fill_diagonal(s, -2)
        assert len(got) == 100
        for i in range(500):
            if ids[i] in got:
                assert [got[ids[i]][k + 1] for k in range(5)] == [ids[j] for j in np.argsort(-s[i], kind="stable")[:5]]
    assert S.nearest_exact(w, asked.limit(0)).count() == 0
    assert {r.band for r in S.measured_recall(w).collect()} <= {"0.9 and more", "0.7 to 0.9", "below 0.7"}
