"""Broken prompt and response pairs: empty, truncated, refusing, copying, or in another language."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .cross_split import band_keys, may_reach
from .group_splits import components

# What is written in place of an answer, without marks and in lower case.
STAND_INS = ["n a", "na", "none", "null", "nil", "nan", "empty", "blank", "no output", "no answer", "no response", "no caption", "no description", "no result", "no text", "not available", "not applicable", "undefined", "missing", "void", "tbd", "todo", "unavailable", "no data", "placeholder"]
# Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the a an is are was were of and with on by in as it its that this from to while who at his her their".split(),
    "es": "el la los las un una de del en con por para que se su y al junto detrás cerca está muy sobre".split(),
    "fr": "le la les un une des du de dans sur avec et est au aux près derrière à côté qui pour son sa en".split(),
    "de": "der die das ein eine einer einem einen den dem und ist auf im am in mit neben hinter von zu an bei".split(),
    "it": "il lo la gli le un una uno di del della nel nella con e è al alla vicino dietro accanto in sul per".split(),
    "pt": "o a os as um uma do da dos das no na nos nas com e é ao à em perto atrás por numa num de".split(),
    "nl": "de het een en van op met is naast achter bij aan voor zijn in door naar".split(),
    "pl": "i w na z się jest obok za przy do pod przez dla".split(),
    "tr": "bir ve ile bu için yanında arkasında da de".split(),
    "sv": "en ett och på med är av vid bakom den det i som till".split(),
}
# English words that end no sentence.
NEVER_LAST = "the a an is are was were be of and or but with by as from to while who which whose because than into onto his their its my your our at for".split()
# Scripts that only some languages use.
SCRIPTS = {"cyrillic": r"\p{IsCyrillic}", "devanagari": r"\p{IsDevanagari}", "han": r"\p{IsHan}", "kana": r"[\p{IsHiragana}\p{IsKatakana}]", "hangul": r"\p{IsHangul}", "arabic": r"\p{IsArabic}", "greek": r"\p{IsGreek}", "hebrew": r"\p{IsHebrew}", "thai": r"\p{IsThai}"}
# Openings in which a model declines, for corpora too small to show their templates; p6_found runs without.
REFUSING = ["i cannot", "i can t", "i can not", "i am unable", "i m unable", "i am not able", "i m not able", "i must decline", "i have to refrain", "i have to decline", "i won t", "i will not", "i do not feel comfortable", "i don t feel comfortable", "it is not possible for me", "as an ai", "as a language model", "i apologize but", "i regret that", "i am sorry but", "i m sorry but"]
#: Openings of nine words are compared by single words: with one of them exchanged, 8 of 10 are still shared.
MOST_LEAD_IN, OPENING, LEAST_OPENING, SIMILAR, SMALL_BUCKET = 6, 9, 5, 0.8, 64


def tokens(c: Column) -> Column:
    """Lower-cased runs of letters, marks and digits; none for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0))


def _is_copy(caption: Column, answer: Column, ct: Column, ot: Column) -> Column:
    """The caption, once or again and nothing else, after a lead-in of a few words that a colon or line
    end closes; compared by words, or by letters and digits alone."""
    c, o = F.concat(F.lit(" "), F.array_join(ct, "  "), F.lit(" ")), F.concat(F.lit(" "), F.array_join(ot, "  "), F.lit(" "))
    rest = F.replace(o, c, F.lit(""))
    lead = F.size(F.filter(F.split(rest, " "), lambda x: x != ""))
    led = F.endswith(o, c) & F.startswith(o, rest) & (lead <= MOST_LEAD_IN) & ((lead == 0) | answer.rlike(r"^\s*[^:\n]{1,80}[:\n]"))
    solid = lambda ts: F.array_join(ts, "")
    return (F.size(ct) > 0) & (led | ((solid(ot) != "") & (F.replace(solid(ot), solid(ct), F.lit("")) == "")))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _script(c: Column) -> Column:
    """The script of most letters of a text: one of SCRIPTS, else latin; null without letters."""
    letters = F.length(F.regexp_replace(c, r"[^\p{L}]", ""))
    out = F.when(letters == 0, None)
    for name, pattern in SCRIPTS.items():
        out = out.when(2 * F.length(F.regexp_replace(c, rf"[^{pattern}]" if not pattern.startswith("[") else f"[^{pattern[1:]}", "")) > letters, name)
    # most texts have no letter of another script, which one look tells
    return F.when(c.rlike(r"[\p{L}&&[^\p{IsLatin}]]"), out.otherwise("latin")).when(c.rlike(r"\p{L}"), "latin")


def _other_language(caption: Column, answer: Column, ct: Column, ot: Column) -> Column:
    """Another script than the caption's, or function words of another language with hardly one of the
    caption's; words that both languages have count for neither where they are all there is of the caption's.
    A caption with fewer than two function words of another language counts as English."""
    lists = F.array(*[F.array(*map(F.lit, ws)) for ws in FUNCTION_WORDS.values()])
    used = lambda ts: F.transform(lists, lambda ws: F.array_intersect(ts, ws))
    counts = lambda us: F.transform(us, lambda u: F.size(u))

    def latin(cs: Column, us: Column) -> Column:
        most, theirs = F.array_max(cs), F.array_max(counts(us))
        own = F.get(us, F.when((most >= 2) & (most > F.get(cs, F.lit(0))), F.array_position(cs, most).cast("int") - 1).otherwise(0))
        other = F.get(us, F.array_position(counts(us), theirs).cast("int") - 1)
        marked = (most >= 2) | F.lower(answer).rlike(r"[à-öø-ÿąćęłńóśźżğışœ]")
        plain = ((theirs >= 2) & (theirs - F.size(own) >= 2)) | ((theirs >= 1) & (F.size(own) == 0) & marked)
        return plain | ((theirs >= 2) & (F.size(F.array_except(own, other)) == 0) & (F.size(F.array_except(other, own)) > 0))

    spoken = _let(counts(used(ct)), lambda cs: _let(used(ot), lambda us: latin(cs, us)))
    c_script, o_script = _script(caption), _script(answer)
    return F.when(c_script.isNull() | o_script.isNull(), False).when(c_script != o_script, True).when(o_script == "latin", spoken).otherwise(False)


def _stems(ts: Column) -> Column:
    """First four letters of the longer words; captions and answers inflect the same words."""
    return F.array_distinct(F.transform(F.filter(ts, lambda x: F.length(x) >= 4), lambda x: F.substring(x, 1, 4)))


def _bucket_links(seen: DataFrame, keys: DataFrame) -> DataFrame:
    """(a, b): the verified links of the openings that share a bucket, enough of them to connect all that are similar.

    In a bucket of up to SMALL_BUCKET openings all meet. A larger one is not paired: two different openings of at
    most OPENING words reach SIMILAR only if they are equal but for one word of the longer, so its members are grouped by
    what is left of their words when one is left out, and linked to the least of each group.
    """
    sizes = keys.groupBy("key").agg(F.count("*").alias("n"))
    sized = cut(keys.join(sizes, "key"))
    side = lambda n: sized.where(F.col("n") <= SMALL_BUCKET).select(F.col("set_id").alias(n), "key", F.col("digest").alias("d" + n))
    pairs = side("a").join(side("b"), "key").where("a < b").where(may_reach(F.col("da"), F.col("db"), SIMILAR)).select("a", "b").distinct()
    sides = lambda n: seen.select(F.col("set_id").alias(n), F.col("tokens").alias("t" + n))
    shared = F.size(F.array_intersect("ta", "tb"))
    links = pairs.join(sides("a"), "a").join(sides("b"), "b").where(shared >= SIMILAR * (F.size("ta") + F.size("tb") - shared) - 1e-9).select("a", "b")
    crowded = seen.join(sized.where(F.col("n") > SMALL_BUCKET).select("set_id").distinct(), "set_id", "left_semi").select("set_id", F.array_sort("tokens").alias("t"))
    one_less = F.when(F.size("t") == OPENING, F.transform("t", lambda x: F.array_remove("t", x))).otherwise(F.array("t"))
    rest = crowded.select("set_id", F.explode(F.concat(one_less, F.array("t"))).alias("rest"))
    least = rest.groupBy("rest").agg(F.min("set_id").alias("a"), F.max("set_id").alias("z")).where("a < z").select("rest", "a")
    return links.union(rest.join(least, "rest").where("a < set_id").select("a", F.col("set_id").alias("b")))


def opening_templates(rows: DataFrame) -> DataFrame:
    """(opening): openings (first OPENING words) of answers that belong to a template of answers that decline.

    ``rows`` is (caption_key, opening ARRAY, far BOOLEAN). Openings of five words and more of answers that have next
    to nothing of their prompt (far) are clustered by MinHash over their words, a repeated word counting as another one
    (verified Jaccard of 0.8: of nine words one may be exchanged), and components of the links; a cluster is
    a template when it recurs over three or more different prompts.
    """
    far = rows.where(F.col("far") & (F.size("opening") >= LEAST_OPENING)).select("opening", "caption_key").distinct()
    far = cut(far.withColumn("set_id", F.xxhash64("opening")))
    seen = cut(
        far.select("set_id", "opening").distinct()
        .withColumn("tokens", F.transform("opening", lambda w, i: F.xxhash64(w, F.size(F.filter(F.slice("opening", 1, i), lambda x: x == w)))))
    )
    keys = cut(band_keys(seen, bands=24, per_band=5))
    labels = components(_bucket_links(seen, keys)).select(F.col("vertex").cast("bigint").alias("set_id"), "label")
    named = seen.select("set_id", "opening").join(labels, "set_id", "left").withColumn("label", F.coalesce("label", F.col("set_id").cast("string")))
    named = cut(named)
    prompts = far.select("set_id", "caption_key").join(named.select("set_id", "label"), "set_id").groupBy("label").agg(F.count_distinct("caption_key").alias("prompts"))
    return named.join(prompts.where("prompts >= 3"), "label", "left_semi").select("opening")


def marked_words(rows: DataFrame, openings: DataFrame) -> DataFrame:
    """(word): the words of ``openings`` that hardly stand in other answers: of all answers whose opening has
    one, at least 0.8 are far from their prompt, over three different prompts."""
    words = openings.select(F.explode("opening").alias("word")).distinct()
    used = rows.select(F.explode(F.array_distinct("opening")).alias("word"), "far", "caption_key")
    rate = used.groupBy("word").agg(F.avg(F.col("far").cast("double")).alias("rate"), F.min("caption_key").alias("lo"), F.max("caption_key").alias("hi"))
    held = rate.where("rate >= 0.8 and lo < hi").join(words, "word", "left_semi").select("word")
    over = used.where("far").join(held, "word", "left_semi").groupBy("word").agg(F.count_distinct("caption_key").alias("prompts"))
    return over.where("prompts >= 3").select("word")


def revealed(rows: DataFrame, rounds: int = 2) -> DataFrame:
    """(record_id) of the answers that decline: far from their prompt, or without one, and with at least two words
    of the templates, which are a third of the opening or more (without a prompt three and half).

    ``rows`` is (record_id, caption_key, opening, far, asked, foreign BOOLEAN). Templates are learnt from the answers that
    have a prompt and are not in another language; the words of all answers they reveal are the words of the next round.
    """
    learnt = rows.where("asked and not foreign").select("record_id", "caption_key", "opening", "far")
    openings = opening_templates(learnt)
    mine = rows.where("far or not asked").select("record_id", "asked", F.array_distinct("opening").alias("o")).select("record_id", "asked", F.size("o").alias("n"), F.explode("o").alias("word"))
    enough = F.when(F.col("asked"), F.col("k") >= F.greatest(F.lit(2), F.col("n") / 3)).otherwise(F.col("k") >= F.greatest(F.lit(3), F.col("n") / 2))
    for _ in range(rounds):
        held = mine.join(cut(marked_words(learnt, openings)), "word").groupBy("record_id").agg(F.first("asked").alias("asked"), F.first("n").alias("n"), F.count("word").alias("k"))
        found = cut(held.where(enough).select("record_id"))
        openings = learnt.join(found, "record_id", "left_semi").select("opening")
    return found


def word_endings(rows: DataFrame) -> DataFrame:
    """(word, inner, final): how often every word of the corpus stands within a sentence and at a sound
    end (before a full stop, or at the end of a caption)."""
    ended = rows.select(F.explode(F.array(
        F.struct(F.col("ct").alias("ts"), F.lit(True).alias("ended")), F.struct(F.col("ot").alias("ts"), F.col("ended")),
    )).alias("x")).select("x.ts", "x.ended").where(F.size("ts") > 0)
    words = ended.select(F.explode(F.transform("ts", lambda t, i: F.struct(t.alias("word"), (i == F.size("ts") - 1).alias("last")))).alias("w"), "ended").select("w.word", "w.last", "ended")
    return words.where("not last or ended").groupBy("word").agg(F.sum((~F.col("last")).cast("int")).alias("inner"), F.sum(F.col("last").cast("int")).alias("final"))


def broken_pairs(pairs: DataFrame, id_column: str = "record_id", prompt: str = "caption", answer: str = "model_output", known: tuple[str, ...] = tuple(REFUSING)) -> DataFrame:
    """(record_id, defect) of every pair whose answer is no sound rewrite of its prompt; one defect a pair,
    the first of empty, copy, refusal, language, truncated.

    Empty: null, no letters and digits, or a stand-in. Copy and language need a prompt; a null or blank
    prompt is no defect. Refusal: an answer far from its prompt in the words of a template that recurs over unrelated
    prompts, or one that begins as one of ``known``, openings for corpora too small to show their templates (none
    are needed). Truncated: the answer ends in a comma, an open bracket or quote or a dash, or,
    without an end mark, in a word that the corpus never or hardly ever ends a sentence with, or in one
    that stands nowhere else. Repeated pairs are judged alike. All statistics are counted over all pairs.
    """
    a, c = F.col("a"), F.col("c")
    rows = pairs.select(F.col(id_column).alias("record_id"), F.col(prompt).cast("string").alias("c"), F.coalesce(F.col(answer).cast("string"), F.lit("")).alias("a"))
    rows = rows.withColumns({"ct": tokens(c), "ot": tokens(a), "tail": F.regexp_replace(a, r"(?U)[\s\p{Cf}\p{So}\*_]+$", "")})
    rows = rows.withColumns({"cs": _stems(F.col("ct")), "os": _stems(F.col("ot")), "shut": F.regexp_replace("tail", r"[\"'”’»)\]]+$", "")})
    early = (
        F.when((F.size("ot") == 0) | F.array_join("ot", " ").isin(STAND_INS), "empty")
        .when(_is_copy(c, a, F.col("ct"), F.col("ot")), "copy")
    )
    asked = F.size("ct") > 0
    rows = rows.withColumns({
        "early": early, "asked": asked, "near": F.size(F.array_intersect("cs", "os")) / F.greatest(F.size("cs"), F.lit(1)),
        "ended": F.col("shut").rlike(r"[.!?。！？।॥؟]$") & ~F.col("shut").rlike(r"\.\.+$"), "open": F.col("tail").rlike(r"[,;(\[{“„‘«\-–—&/]$"),
    })
    # an answer with more than half of the prompt's words is in its language
    foreign = F.when(asked & F.col("early").isNull() & (F.col("near") <= 0.5), _other_language(c, a, F.col("ct"), F.col("ot"))).otherwise(False)
    opening = F.when(F.col("early").isNull(), F.slice("ot", 1, OPENING))
    rows = cut(rows.select(
        "record_id", F.xxhash64("c").alias("caption_key"), "ct", "ot", "asked", "early", "ended", "open", (asked & (F.col("near") < 0.3)).alias("far"), foreign.alias("foreign"),
        opening.alias("opening"), F.array_join(F.slice("ot", 1, 12), " ").alias("head"), F.try_element_at("ot", F.lit(-1)).alias("word"),
    ))
    refusing = revealed(rows.where("early is null").select("record_id", "caption_key", "opening", "far", "asked", "foreign")).withColumn("template", F.lit(True))
    head = F.concat(F.lit(" "), "head", F.lit(" "))
    first_person = F.substring_index("head", " ", 1).isin("i", "sorry", "unfortunately", "as", "it", "apologies", "my", "we")
    listed = F.exists(F.array(*[F.lit(f" {x} ") for x in known]), lambda x: F.contains(F.substring(head, 1, 44), x)) & F.when(F.col("asked"), F.col("far")).otherwise(first_person) if known else F.lit(False)
    ends = word_endings(rows.select("ct", "ot", "ended"))
    judged = rows.drop("ct", "ot", "opening").join(refusing, "record_id", "left").join(ends, "word", "left")
    total = F.col("inner") + F.col("final")
    latin = F.col("word").rlike(r"^[\p{IsLatin}\p{N}]+$")
    unfinished = F.col("inner").isNull() | F.col("word").isin(NEVER_LAST) | ((total >= 3) & (F.col("final") < 0.02 * total))
    cut_off = ~F.col("ended") & (F.col("open") | (latin & unfinished))
    defect = (
        F.when(F.col("early").isNotNull(), F.col("early")).when(F.col("template") | listed, "refusal").when(F.col("foreign"), "language").when(cut_off, "truncated")
    )
    return judged.select("record_id", defect.alias("defect")).where("defect is not null")
