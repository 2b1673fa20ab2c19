import random

import pytest
from pyspark.sql import functions as F

from momentforge.llm import broken_pairs as module
from momentforge.llm.broken_pairs import broken_pairs
from momentforge.llm.cross_split import band_keys

S = "record_id bigint, caption string, model_output string"
NOUNS = ["kettle", "ladder", "mirror", "sofa", "violin", "tractor", "statue", "basket"]
WHO = ["baker", "welder", "ranger", "dancer", "sailor", "porter"]


def corpus():
    rng, rows = random.Random(1), []
    for i in range(300):
        who, what = rng.choice(WHO), rng.choice(NOUNS)
        rows.append((i, f"a {who} lifts a {what}", f"The quiet {who} slowly lifts the heavy {what}."))
    for i in range(300, 330):
        who, what = rng.choice(WHO), rng.choice(NOUNS)
        rows.append((i, f"a {who} paints a {what} number {i}", "I regret that this topic is closed today, so nothing more follows here."))
    return rows


CASES = [
    (1000, "a baker lifts a sofa", None, "empty"), (1001, "a baker lifts a sofa", " \t\n", "empty"), (1002, "a baker lifts a sofa", "N/A", "empty"), (1003, "a baker lifts a sofa", "[no output]", "empty"), (1004, "a baker lifts a sofa", "​", "empty"), (1005, "a baker lifts a sofa", "???", "empty"),
    (1010, "a baker lifts a sofa", "A BAKER LIFTS A SOFA!", "copy"), (1011, "a baker lifts a sofa", "Caption: a baker lifts a sofa", "copy"), (1012, "a baker lifts a sofa", "A baker lifts a sofa. A baker lifts a sofa.", "copy"), (1013, "a baker lifts a sofa", "a  baker   lifts a sofa", "copy"),
    (1014, "a baker lifts a sofa", "A baker lifts a sofa, and birds gather.", None), (1015, "a baker lifts a sofa", "A baker lifts a so-fa.", "copy"),
    (1020, "a baker lifts a sofa", "Un cycliste coupe un oignon dans une ruelle étroite.", "language"), (1021, "a baker lifts a sofa", "Высокая женщина красит стену.", "language"), (1022, "el panadero levanta una caja detrás del mercado", "Detrás del mercado, el panadero levanta una caja.", None), (1023, "das Kind spült das Geschirr in der Küche", "The quiet baker lifts the heavy sofa.", "language"),
    (1024, "a baker lifts a sofa", "El Mercado is written on the sign above the baker, who lifts the sofa.", None),
    (1030, "a baker lifts a sofa", "The quiet baker slowly lifts the", "truncated"), (1031, "a baker lifts a sofa", "The quiet baker slowly lifts the heavy so", "truncated"), (1032, "a baker lifts a sofa", "The quiet baker slowly lifts the…", "truncated"), (1033, "a baker lifts a sofa", "The quiet baker slowly lifts the heavy sofa", None), (1034, "a baker lifts a sofa", "The quiet baker (", "truncated"), (1035, "a baker lifts a sofa", "The quiet baker,", "truncated"),
    (1040, "a baker lifts a sofa", "I'm sorry, but I cannot describe this video.", "refusal"), (1041, "a baker lifts a sofa", 'The baker apologizes, saying "I\'m sorry, I can\'t help you," and then drops the sofa.', None), (1042, "a baker lifts a sofa", "Standing inside, the baker is unable to lift the sofa and declines.", None),
    (1050, None, "The quiet baker slowly lifts the heavy sofa.", None), (1051, "  ", "The quiet baker slowly lifts the heavy sofa.", None), (1052, None, None, "empty"), (1053, None, "I cannot describe this video.", "refusal"),
]


@pytest.fixture(scope="module")
def got(spark):
    rows = corpus() + [c[:3] for c in CASES]
    d = spark.createDataFrame(rows, S).withColumn("word", F.lit("x")).withColumn("start", F.lit(1)).withColumn("c", F.lit(1)).withColumn("a", F.lit(2))
    out = [tuple(r) for r in broken_pairs(d).collect()]
    assert len(out) == len({i for i, _ in out})
    return dict(out)


@pytest.mark.parametrize("case", CASES, ids=lambda c: str(c[0]))
def test_case(got, case):
    assert got.get(case[0]) == case[3]


def test_sound_answers_stay(got):
    assert not [i for i in range(300) if i in got]


def test_templates_without_known_phrases_are_learnt(got):
    # "I regret that" is a known opening; the recurring template is what marks it here as well
    assert all(got.get(i) == "refusal" for i in range(300, 330))


def test_no_rows_and_long_answers(spark):
    assert broken_pairs(spark.createDataFrame([], S)).count() == 0
    big = "the baker lifts the sofa. " * 20_000
    d = spark.createDataFrame([(1, "a baker lifts a sofa", big), (2, big, big)], S)
    assert {tuple(r) for r in broken_pairs(d).collect()} == {(2, "copy")}


def test_templates_whose_openings_differ_in_a_word_are_learnt(spark):
    said = "This topic remains {} for now and nothing more follows here."
    words = ["closed", "locked", "sealed", "shut", "barred", "blocked", "banned", "fenced", "hidden", "veiled", "masked", "frozen"]
    rows = [r for r in corpus() if r[0] < 300] + [(400 + i, f"a porter paints a basket number {i}", said.format(w)) for i, w in enumerate(words)]
    rows += [(500, "a porter paints a basket", "This topic remains off the table for today.")]
    got = dict(tuple(r) for r in broken_pairs(spark.createDataFrame(rows, S)).collect())
    assert got == {i: "refusal" for i in [*range(400, 412), 500]}


def openings(spark, near):
    other = [(i, [f"w{i}x{k}" for k in range(9)], False) for i in range(12)]
    rows = [(key, said.split(), True) for key, said in near] + other
    d = spark.createDataFrame(rows, "caption_key bigint, opening array<string>, far boolean")
    return {" ".join(r.opening) for r in module.opening_templates(d).collect()}


def test_all_members_of_a_bucket_meet(spark, monkeypatch):
    one_bucket = lambda sets, **k: band_keys(sets, **k).withColumn("key", F.lit(0).cast("bigint")).distinct()
    monkeypatch.setattr(module, "band_keys", one_bucket)
    near = [(i, f"this topic remains {w} for now and nothing more") for i, w in enumerate(["closed", "locked", "sealed"])]
    assert openings(spark, near) == {said for _, said in near}


def test_prompts_count_by_full_hash(spark):
    said = "this topic remains closed for now and nothing more"
    assert openings(spark, [(64 * i, said) for i in range(3)]) == {said}
