import random

from pyspark.sql import functions as F

from momentforge.llm.shared_spans import SpanIndex, shared_parts, sharing_documents

S = "doc_id bigint, text string"


def text(rng, n):
    return "".join(rng.choice("abcdefghij klmnop\nqé😀") for _ in range(n))


def brute(rows, span=160):
    where = {}
    for i, t in rows:
        for p in range(len(t or "") - span + 1):
            where.setdefault(t[p : p + span], set()).add(i)
    out, covered = set(), {}
    for i, t in rows:
        z = [False] * len(t or "")
        for p in range(len(t or "") - span + 1):
            if len(where[t[p : p + span]]) > 1:
                out.add(i)
                z[p : p + span] = [True] * span
        covered[i] = sum(z)
    return out, covered


def made():
    rng = random.Random(5)
    rows = [(i, text(rng, rng.randrange(0, 900))) for i in range(120)]
    for k, n in enumerate([159, 160, 161, 175, 200, 239, 240, 400, 150, 120]):
        p = text(rng, n)
        rows += [(200 + 3 * k + j, text(rng, 5 + 60 * j) + p + text(rng, 90 * j)) for j in range(3)]
    same, boiler = text(rng, 300), text(rng, 250)
    rows += [(300, same), (301, same), (302, "short"), (303, "short"), (304, None), (305, ""), (306, "z" * 500), (307, "y" + "z" * 300), (308, "z" * 159)]
    rows += [(400 + i, text(rng, 50) + boiler + text(rng, 50)) for i in range(80)]
    # a chain: b shares 100 characters with a and 180 with c around them
    core = text(rng, 100)
    left = text(rng, 80)
    return [*rows, (500, text(rng, 90) + core + text(rng, 90)), (501, left + core + text(rng, 40)), (502, left + core + text(rng, 70))]


def test_documents_against_brute_force(spark):
    rows = made()
    d = spark.createDataFrame(rows, S).withColumn("h", F.lit(1)).withColumn("pos", F.lit(1)).withColumn("text_id", F.lit(1))
    want, _ = brute(rows)
    for batches in (1, 2, 3):
        got = [r.doc_id for r in sharing_documents(d, batches=batches).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_parts_against_brute_force(spark):
    rows = [r for r in made() if r[0] not in (306, 307)]  # of one repeated character only the ends count
    _, covered = brute(rows)
    got = {r.doc_id: r for r in shared_parts(spark.createDataFrame(rows, S)).collect()}
    assert {i: r.shared_chars for i, r in got.items()} == covered
    assert all(0 <= r.shared_share <= 1 and r.n_chars == len(t or "") for i, t in rows for r in [got[i]])


def test_index_in_batches_and_compaction(spark):
    rows = made()
    d = spark.createDataFrame(rows, S).where("length(text) >= 160").select("text", F.col("doc_id").alias("text_id"))
    whole = SpanIndex(spark)
    once = {r.h for r in whole.add(d).collect()}
    parts = SpanIndex(spark, max_runs=2)
    seen = set()
    for b in range(5):
        seen |= {r.h for r in parts.add(d.where(F.col("text_id") % 5 == b)).collect()}
        assert len(parts.runs) <= 2
    assert seen == once and parts.entries().count() == whole.entries().count()


def test_repeated_rows_of_one_document_share_nothing(spark):
    t = text(random.Random(1), 400)
    assert sharing_documents(spark.createDataFrame([(1, t), (1, t)], S)).count() == 0


def test_no_rows_and_long_text(spark):
    assert sharing_documents(spark.createDataFrame([], S)).count() == 0 and shared_parts(spark.createDataFrame([], S)).count() == 0
    rng = random.Random(9)
    big = text(rng, 1_000_000)
    d = spark.createDataFrame([(1, big), (2, "x" + big[500_000:500_200]), (3, "q" * 1000)], S)
    assert sorted(r.doc_id for r in sharing_documents(d).collect()) == [1, 2]


def test_parts_of_one_repeated_character_against_brute_force(spark):
    rng = random.Random(7)
    ruler, passage = "-" * 1000, text(rng, 120) + "=" * 700 + text(rng, 130)
    rows = [*made(), (600, "a" + ruler + "b"), (601, text(rng, 80) + ruler + text(rng, 40)), (602, text(rng, 30) + "-" * 161), (603, "-" * 159 + text(rng, 90))]
    rows += [(610, text(rng, 70) + passage), (611, passage + text(rng, 20)), (612, "#" * 400 + text(rng, 200)), (613, "u" * 160), (614, "u" * 161 + "v")]
    _, covered = brute(rows)
    got = {r.doc_id: r.shared_chars for r in shared_parts(spark.createDataFrame(rows, S)).collect()}
    assert got == covered and got[600] == 1000 and got[306] == 500


def test_default_batches_reach_compaction(spark, monkeypatch):
    done, compact = [], SpanIndex.compact
    monkeypatch.setattr(SpanIndex, "compact", lambda self: (compact(self), done.append(len(self.runs))))
    rows = made()
    want, covered = brute(rows)
    d = spark.createDataFrame(rows, S)
    assert {r.doc_id for r in sharing_documents(d).collect()} == want and done == [1]
    assert {r.doc_id: r.shared_chars for r in shared_parts(d).collect()} == covered and done == [1, 1]


def test_an_index_is_opened_again_by_a_later_process(spark, tmp_path):
    import pytest

    rows = made()
    d = spark.createDataFrame(rows, S).where("length(text) >= 160").select("text", F.col("doc_id").alias("text_id"))
    once = {r.h for r in SpanIndex(spark).add(d).collect()}
    root, seen = f"file://{tmp_path}/index", set()
    for b in range(3):  # each time a new object that knows only the folder
        seen |= {r.h for r in SpanIndex(spark, max_runs=2, root=root).add(d.where(F.col("text_id") % 3 == b)).collect()}
    again = SpanIndex(spark, root=root)
    assert seen == once and 1 <= len(again.runs) <= 2 and again.entries().select("text_id").distinct().count() == d.count()
    with pytest.raises(ValueError):
        SpanIndex(spark, span=200, root=root)
    behind = SpanIndex(spark, root=root)
    again.add(d.limit(1))
    with pytest.raises(RuntimeError):
        behind.add(d.limit(1))
