"""Caption text functions, all as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words the search tokenizer leaves out.
SEARCH_STOP_WORDS = [
    "a", "an", "the", "is", "are", "was", "were", "be", "of", "in", "on", "at", "to",
    "and", "or", "with", "for", "from", "by", "it", "its", "this", "that", "some",
    "someone", "there", "into", "onto", "up", "down", "out", "over", "his", "her",
    "their", "they", "he", "she", "video", "clip",
]
# English stop words of the caption filters (the default parameter; any list can be given).
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself "
    "they them their theirs themselves what which who whom this that these those am is are was were be been being have has had "
    "having do does did doing a an the and but if or because as until while of at by for with about against between into through "
    "during before after above below to from up down in out on off over under again further then once here there when where why how "
    "all any both each few more most other some such no nor not only own same so than too very s t can will just don should now"
).split()


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """Unicode white space off both ends."""
    return F.regexp_replace(_c(x), r"(?U)^\s+|\s+$", "")


def clean(x: Column | str, lower: bool = False) -> Column:
    """Stripped, runs of white space made one space, lower case on request."""
    s = F.regexp_replace(strip(x), r"(?U)\s+", " ")
    return F.lower(s) if lower else s


def normalize(x: Column | str) -> Column:
    """The caption normal form: ``clean`` in lower case."""
    return clean(x, lower=True)


def lower_strip(x: Column | str) -> Column:
    """Lower case and stripped, inner white space kept."""
    return F.lower(strip(x))


def word_list(x: Column | str) -> Column:
    """Words between white space; an empty array for blank text."""
    return F.filter(F.split(_c(x), r"(?U)\s+"), lambda t: t != "")


def word_count(x: Column | str) -> Column:
    return F.size(word_list(x))


def strip_marks(x: Column | str) -> Column:
    """ASCII punctuation off both ends of a word."""
    return F.regexp_replace(_c(x), r"^\p{Punct}+|\p{Punct}+$", "")


def _listed(t: Column, words: list[str]) -> Column:
    return F.array_contains(F.array(*map(F.lit, words)), t)


def only_stop_words(x: Column | str, stop: list[str] | None = None) -> Column:
    """No word is left but stop words once marks are stripped; true also when no word is left at all."""
    content = F.filter(F.transform(word_list(x), strip_marks), lambda t: t != "")
    return ~F.exists(content, lambda t: ~_listed(t, stop or STOP_WORDS))


def valid_caption(x: Column | str, least: int = 3, most: int = 50, stop: list[str] | None = None) -> Column:
    """``least`` to ``most`` words, not stop words alone."""
    return word_count(x).between(least, most) & ~only_stop_words(x, stop)


def stem(t: Column) -> Column:
    """The first of the endings ing, ed, es, s that leaves more than two letters comes off."""
    out, rule = t, None
    for ending in ("ing", "ed", "es", "s"):
        fits = (F.length(t) > len(ending) + 2) & t.endswith(ending)
        cut = F.substring(t, F.lit(1), F.length(t) - len(ending))
        rule = F.when(fits, cut) if rule is None else rule.when(fits, cut)
    return rule.otherwise(out)


def search_tokens(x: Column | str) -> Column:
    """Stems of the ASCII words that are no search stop words."""
    found = F.regexp_extract_all(F.lower(_c(x)), F.lit(r"([a-z0-9]+)"), F.lit(1))
    return F.transform(F.filter(found, lambda t: ~_listed(t, SEARCH_STOP_WORDS)), stem)


def query_key(x: Column | str) -> Column:
    """Queries with the same ASCII words in the same order have the same key."""
    return F.array_join(F.regexp_extract_all(F.lower(_c(x)), F.lit(r"([a-z0-9]+)"), F.lit(1)), " ")


def content_tokens(x: Column | str, stop: list[str] | None = None) -> Column:
    """Words of letters and apostrophes longer than one, stop words left out."""
    found = F.regexp_extract_all(normalize(x), F.lit(r"([a-z']+)"), F.lit(1))
    return F.filter(found, lambda t: (F.length(t) > 1) & ~_listed(t, stop or STOP_WORDS))


def content_bigrams(x: Column | str, stop: list[str] | None = None) -> Column:
    """Neighbouring words of which neither is a stop word."""
    found = F.regexp_extract_all(normalize(x), F.lit(r"([a-z']+)"), F.lit(1))
    pairs = F.when(F.size(found) > 1, F.zip_with(F.slice(found, F.lit(1), F.size(found) - 1), F.slice(found, F.lit(2), F.size(found) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
    kept = F.filter(pairs, lambda p: ~_listed(p["a"], stop or STOP_WORDS) & ~_listed(p["b"], stop or STOP_WORDS))
    return F.transform(kept, lambda p: F.concat_ws(" ", p["a"], p["b"]))


def letter_words(x: Column | str, stop: list[str] | None = None, digits: bool = False) -> Column:
    """Words of letters alone (or letters and digits) that are no stop words."""
    pattern = r"^[\p{L}\p{N}]+$" if digits else r"^\p{L}+$"
    found = F.regexp_extract_all(F.lower(_c(x)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.filter(found, lambda t: t.rlike(pattern) & ~_listed(t, stop or STOP_WORDS))


def ngrams(words: Column, n: int) -> Column:
    """Runs of ``n`` neighbouring words joined by a space; none for shorter lists."""
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))


def clean_title(x: Column | str, default: str = "Untitled", most: int = 120) -> Column:
    """A title from a file name: stem, marks to spaces, odd characters out, a default, at most 120."""
    s = F.regexp_replace(file_stem(x), r"[_-]+", " ")
    s = clean(F.regexp_replace(s, r"[^\p{L}\p{N}_ .,'()&!?-]", ""))
    return F.substring(F.coalesce(F.nullif(s, F.lit("")), F.lit(default)), 1, most)


def file_stem(x: Column | str) -> Column:
    """The file name without folders and last extension."""
    return F.regexp_replace(F.regexp_replace(_c(x), r"^.*/", ""), r"(?<=.)\.[^.]*$", "")


def file_suffix(x: Column | str) -> Column:
    """The last extension with its dot, lower case; empty when there is none."""
    return F.lower(F.regexp_extract(F.regexp_replace(_c(x), r"^.*/", ""), r".(\.[^.]*)$", 1))


def clock(seconds: Column | str) -> Column:
    """m:ss of whole seconds, negative ones count as 0."""
    s = F.greatest(F.floor(_c(seconds)).cast("bigint"), F.lit(0))
    return F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def hms(seconds: Column | str) -> Column:
    s = F.greatest(F.floor(_c(seconds)).cast("bigint"), F.lit(0))
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor((s % 3600) / 60), s % 60)


def span_text(start: Column, end: Column) -> Column:
    return F.concat(clock(start), F.lit("–"), clock(end))


def percent(share: Column | str, digits: int = 0) -> Column:
    return F.format_string(f"%.{digits}f%%", F.round(_c(share) * 100, digits))


# The sentences of an answer.
CLOSEST, WEAKER, NOT_FOUND = ("The closest moment for “", "” is "), " There is also a weaker match at ", ("I couldn't find “", "” in this video.")


def grounded_answer(query: Column, spans: Column) -> Column:
    """A sentence that names the best span and, if there is one, the next; spans are (start, end, score)."""
    top, second = F.get(spans, F.lit(0)), F.get(spans, F.lit(1))
    found = F.concat(
        F.lit(CLOSEST[0]), query, F.lit(CLOSEST[1]), span_text(top["start"], top["end"]),
        F.lit(" ("), F.round(top["score"] * 100).cast("int").cast("string"), F.lit("% match)."),
        F.when(F.size(spans) > 1, F.concat(F.lit(WEAKER), span_text(second["start"], second["end"]), F.lit("."))).otherwise(""),
    )
    return F.when(F.size(spans) > 0, found).otherwise(F.concat(F.lit(NOT_FOUND[0]), query, F.lit(NOT_FOUND[1])))


def media_url(video_id: Column, start: Column) -> Column:
    """Address of a clip with a media fragment; times below 0 count as 0."""
    return F.format_string("/videos/%s/stream#t=%.1f", video_id, F.greatest(start.cast("double"), F.lit(0.0)))


def thumbnail_url(video_id: Column, at: Column) -> Column:
    return F.format_string("/videos/%s/thumbnail?t=%.1f", video_id, F.greatest(at.cast("double"), F.lit(0.0)))


# The instruction for one caption.
REWRITE = "You are given a video caption from the MSVD dataset.\nRewrite it as a clean, concise normalized video description.\n\nCaption: %s\n\nNormalized description:"


def rewrite_prompt(caption: Column) -> Column:
    """The instruction given to a language model for one caption."""
    return F.format_string(REWRITE, caption)


def word_token_proxy(x: Column | str) -> Column:
    """Words plus a start and an end mark: a stand-in for a text encoder's token count."""
    return word_count(x) + 2
