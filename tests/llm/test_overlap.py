import random

from pyspark.sql import functions as F

from momentforge.llm.cross_split import overlap_report, overlapping_pairs

S = "row_id bigint, caption string, split string, source string"
WORDS = [f"w{i}" for i in range(400)]


def brute(rows, t=0.75):
    import re

    sp = {"train": "train", "val": "val", "validation": "val", "test": "test"}
    side = [(i, frozenset(re.findall(r"[^\W_]+", (c or "").lower())), sp.get((s or "").strip().lower())) for i, c, s, _ in rows]
    side = [x for x in side if len(x[1]) >= 8 and x[2]]
    return {(min(a, b), max(a, b)) for a, u, p in side if p == "train" for b, v, q in side if q != "train" and len(u & v) >= t * len(u | v) - 1e-9}


def made():
    rng, rows = random.Random(3), []
    for i in range(0, 900, 3):
        w = rng.sample(WORDS, 14)
        near = w[: 14 - rng.randrange(4)] + rng.sample(WORDS, 1)
        rows += [(i, " ".join(w), "train", "A"), (i + 1, ", ".join(near).upper(), rng.choice(["val", " Validation", "TEST"]), "B"), (i + 2, " ".join(w[::-1]), rng.choice(["test", "train", None]), None)]
    return rows + [(9000 + i, "one two three four five six seven eight nine", "train" if i % 3 else "test", "C") for i in range(90)] + [(1, None, "train", "A")][:0] + [(9100, None, "train", None), (9101, "", "test", None), (9102, "few words only", "train", "A"), (9103, "few words only", "test", "A")]


def test_pairs_against_brute_force(spark):
    rows = made()
    d = spark.createDataFrame(rows, S).withColumn("set_id", F.lit(1)).withColumn("key", F.lit(0)).withColumn("tokens", F.lit(0))
    got = [tuple(r) for r in overlapping_pairs(d).collect()]
    want = brute(rows)
    assert len(got) == len(set(got)) and not set(got) - want and len(set(got)) >= 0.98 * len(want)


def test_report_counts_the_pairs(spark):
    rows = made()
    d = spark.createDataFrame(rows, S)
    pairs = overlapping_pairs(d)
    ev = d.where("split is not null and lower(trim(split)) <> 'train'").select(F.col("row_id").alias("e"), "source")
    n = pairs.join(ev, (F.col("row_id_a") == F.col("e")) | (F.col("row_id_b") == F.col("e"))).groupBy("source").agg(F.count("*").alias("n"))
    report = overlap_report(d).groupBy("source").agg(F.sum("pairs").alias("n"))
    assert {tuple(r) for r in n.collect()} == {tuple(r) for r in report.collect()}


def test_no_rows_and_long_captions(spark):
    e = spark.createDataFrame([], S)
    assert overlapping_pairs(e).count() == 0 and overlap_report(e).count() == 0
    big = " ".join(f"t{i}" for i in range(20_000))
    d = spark.createDataFrame([(2, big, "train", "A"), (1, big + " more", "val", "A")], S)
    assert [tuple(r) for r in overlapping_pairs(d).collect()] == [(1, 2)]


def test_digests_never_rule_out_a_similar_pair(spark):
    from momentforge.llm.cross_split import band_keys, may_reach

    rng, rows, want = random.Random(8), [], []
    for i in range(600):
        n = rng.choice([1, 8, 17, 40, 254, 255, 400])
        a = rng.sample(range(10**12), n)
        b = a[rng.randrange(0, 1 + n // 3) :] + rng.sample(range(10**12), rng.randrange(0, 1 + n // 4))
        rows += [(2 * i, a), (2 * i + 1, b)]
        if len(set(a) & set(b)) >= 0.75 * len(set(a) | set(b)):
            want.append(i)
    d = band_keys(spark.createDataFrame(rows, "set_id bigint, tokens array<bigint>"), 1, 1)
    a, b = (d.where(F.col("set_id") % 2 == k).select(F.floor(F.col("set_id") / 2).alias("i"), F.col("digest").alias(f"d{k}")) for k in (0, 1))
    kept = {r.i for r in a.join(b, "i").where(may_reach(F.col("d0"), F.col("d1"), 0.75)).collect()}
    assert len(want) > 100 and set(want) <= kept
    far = {i for i in range(300) if i not in want}
    assert len(kept & far) < len(far)
