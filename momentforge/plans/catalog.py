"""Every query of the engine's own operators over the provided tables, and its SQL.

Names begin with the part of the engine: scan, text, etl, search, eval, moment, eda, split, index, bench, stream.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import timeline as L
from ..functions import vector as V
from ..operators import benchmarks, captions, evaluation, localize, search, splits, stats, text_metrics, vector_index
from ..session import shared_dir, table
from ..streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


# SQL fragments
WS = r"[\s\x0b\x{{85}}\p{{Z}}]+"  # for str.format
NORM = f"trim(lower(regexp_replace({{c}}, '{WS}', ' ', 'g')))"
CLEAN = f"trim(regexp_replace({{c}}, '{WS}', ' ', 'g'))"
WORDS = "list_filter(string_split({c}, ' '), lambda x: x <> '')"
STOP = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"
SEARCH_STOP = "[" + ", ".join(f"'{w}'" for w in T.SEARCH_STOP_WORDS) + "]"
PUNCT = "[[:punct:]]+"
CONTENT = f"list_filter(list_transform({WORDS}, lambda t: regexp_replace(regexp_replace(t, '^{PUNCT}', ''), '{PUNCT}$', '')), lambda t: t <> '')"
N = NORM.format(c="caption")
_VALID = f"with n as (select *, {N} as c from build_splits where caption is not null), v as (select *, len({WORDS.format(c='c')}) as words, len(list_filter({CONTENT.format(c='c')}, lambda t: not list_contains({STOP}, t))) = 0 as stop from n)"
_FIRST = f"{_VALID}, k as (select * from v where words between 3 and 50 and not stop), i as (select *, row_number() over (partition by video_id, c order by row_id) as r1 from k)"


def caps(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "build_splits")


# -- text ---------------------------------------------------------------------------------------
@query("text_normal_forms", f"select row_id, {N} as normal, {CLEAN.format(c='caption')} as clean, len({WORDS.format(c=N)}) as words from build_splits where caption is not null")
def _(s, d):
    return caps(s, d).where("caption is not null").select("row_id", T.normalize("caption").alias("normal"), T.clean("caption").alias("clean"), T.word_count("caption").alias("words"))


@query("text_valid_captions", f"{_VALID} select row_id, words, stop as only_stop, words between 3 and 50 and not stop as valid from v")
def _(s, d):
    n = caps(s, d).where("caption is not null").withColumn("c", T.normalize("caption"))
    return n.select("row_id", T.word_count("c").alias("words"), T.only_stop_words("c").alias("only_stop"), T.valid_caption("c").alias("valid"))


@query("text_search_tokens", f"""
    select row_id, array_to_string(list_transform(list_filter(regexp_extract_all(lower(caption), '([a-z0-9]+)', 1), lambda t: not list_contains({SEARCH_STOP}, t)),
        lambda t: case when length(t) > 5 and ends_with(t, 'ing') then left(t, length(t) - 3) when length(t) > 4 and ends_with(t, 'ed') then left(t, length(t) - 2)
                       when length(t) > 4 and ends_with(t, 'es') then left(t, length(t) - 2) when length(t) > 3 and ends_with(t, 's') then left(t, length(t) - 1) else t end), ' ') as stems,
        array_to_string(regexp_extract_all(lower(caption), '([a-z0-9]+)', 1), ' ') as key
    from build_splits where caption is not null""")
def _(s, d):
    return caps(s, d).where("caption is not null").select("row_id", F.array_join(T.search_tokens("caption"), " ").alias("stems"), T.query_key("caption").alias("key"))


@query("text_clock", "select video_id, concat(cast(floor(duration) as bigint) // 60, ':', lpad(cast(cast(floor(duration) as bigint) % 60 as varchar), 2, '0')) as clock, printf('%02d:%02d:%02d', cast(floor(duration) as bigint) // 3600, (cast(floor(duration) as bigint) % 3600) // 60, cast(floor(duration) as bigint) % 60) as hms from videos where duration >= 0 and not isnan(duration)")
def _(s, d):
    return table(s, d, "videos").where("duration >= 0 and not isnan(duration)").select("video_id", T.clock("duration").alias("clock"), T.hms("duration").alias("hms"))


@query("text_bigrams_3", f"""
    with w as (select row_id, {WORDS.format(c=N)} as w from build_splits where caption is not null),
    g as (select row_id, unnest(range(1, greatest(len(w) - 1, 1))) as i, w from w where len(w) >= 3)
    select row_id, i as place, array_to_string(list_slice(w, i, i + 2), ' ') as gram from g""")
def _(s, d):
    g = T.ngrams(T.word_list(T.normalize("caption")), 3)
    return caps(s, d).where("caption is not null").select("row_id", F.posexplode(g).alias("p", "gram")).select("row_id", (F.col("p") + 1).cast("bigint").alias("place"), "gram")


@query("text_ids_and_urls", r"""
    select video_id, nullif(regexp_extract(video_id, '^(.*)_([^_]+)_([^_]+)$', 1), '') as source_key, try_cast(nullif(regexp_extract(video_id, '^(.*)_([^_]+)_([^_]+)$', 3), '') as double) - try_cast(nullif(regexp_extract(video_id, '^(.*)_([^_]+)_([^_]+)$', 2), '') as double) as length_sec,
        case when url is null then null else string_split(url, 'v=')[-1] end as tail from videos""")
def _(s, d):
    p = r"^(.*)_([^_]+)_([^_]+)$"
    part = lambda i: F.nullif(F.regexp_extract("video_id", p, i), F.lit(""))
    return table(s, d, "videos").select("video_id", part(1).alias("source_key"), (part(3).try_cast("double") - part(2).try_cast("double")).alias("length_sec"), F.element_at(F.split("url", "v="), -1).alias("tail"))


@query("text_json_fields", "select event_type, count(*) as n, count(json_extract_string(props, '$.k')) as with_k, sum(coalesce(try_cast(json_extract_string(props, '$.k') as double), 0)) as total from events group by 1")
def _(s, d):
    k = F.get_json_object("props", "$.k")
    return table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count(k).alias("with_k"), F.sum(F.coalesce(k.try_cast("double"), F.lit(0.0))).alias("total"))


# -- caption etl --------------------------------------------------------------------------------
@query("etl_source_counts", "select source, count(*) as captions, count(distinct video_id) as videos from build_splits group by 1")
def _(s, d):
    return caps(s, d).groupBy("source").agg(F.count("*").alias("captions"), F.count_distinct("video_id").alias("videos"))


@query("etl_hint_counts", "select source, split_hint, count(*) as n from build_splits group by 1, 2")
def _(s, d):
    return caps(s, d).groupBy("source", "split_hint").agg(F.count("*").alias("n"))


@query("etl_first_in_video", f"{_FIRST} select row_id, c as caption from i where r1 = 1")
def _(s, d):
    return captions.first_in_video(captions.normalized(caps(s, d))).select("row_id", "caption")


@query("etl_first_overall", f"{_FIRST}, g as (select *, row_number() over (partition by c order by case source when 'MSR-VTT' then 0 when 'MSVD' then 1 else 2 end, row_id) as r2 from i where r1 = 1) select row_id, c as caption, source from g where r2 = 1")
def _(s, d):
    return captions.deduplicated(captions.normalized(caps(s, d))).select("row_id", "caption", "source")


@query("etl_funnel", f"""{_VALID}, k as (select * from v where words between 3 and 50 and not stop), g as (select c, video_id, count(*) as n from k group by 1, 2), h as (select c, sum(n) as n, count(*) as vs from g group by 1),
    x as (select count(*) as total, count_if(words < 3) as too_short, count_if(words > 50) as too_long, count_if(stop and words between 3 and 50) as only_stop_words from v),
    y as (select cast(coalesce(sum(n - vs), 0) as bigint) as intra_duplicates, cast(coalesce(sum(vs - 1), 0) as bigint) as cross_duplicates, count(*) as retained from h)
    select *, round(100.0 * retained / total, 2) as retained_pct from x, y""")
def _(s, d):
    return captions.funnel(caps(s, d))


@query("etl_similarity_gate", "with s as (select row_id, video_id, clip_sim from build_splits where clip_sim is not null and not isnan(clip_sim)) select row_id, clip_sim from s where video_id not in (select video_id from s group by 1 having max(clip_sim) < 0.2)")
def _(s, d):
    return captions.similarity_gate(caps(s, d), 0.2).select("row_id", "clip_sim")


@query("etl_with_frames", "select row_id, len(frame_paths) as frames from build_splits where len(frame_paths) > 0")
def _(s, d):
    return captions.with_frames(caps(s, d)).select("row_id", F.size("frame_paths").alias("frames"))


@query("etl_frame_pairs", "select row_id, unnest(frame_paths) as frame from build_splits")
def _(s, d):
    return captions.frames_from_video(caps(s, d)).select("row_id", "frame")


@query("etl_staged", "select row_id from build_splits where video_id in (select video_id from videos)")
def _(s, d):
    return captions.of_staged(caps(s, d), table(s, d, "videos")).select("row_id")


@query("etl_missing", "select count(distinct video_id) as missing_videos, count(*) as missing_rows from build_splits where video_id is null or video_id not in (select video_id from videos)")
def _(s, d):
    return captions.missing_files(caps(s, d), table(s, d, "videos"))


@query("etl_first_videos", "with f as (select video_id, min(row_id) as f from build_splits group by 1 order by f limit 20) select row_id from build_splits where video_id in (select video_id from f)")
def _(s, d):
    return captions.first_videos(caps(s, d), 20).select("row_id")


@query("etl_first_per_hint", "with f as (select split_hint, video_id, min(row_id) as f from build_splits group by 1, 2), r as (select *, row_number() over (partition by split_hint order by f) as r from f) select b.row_id from build_splits b join r on b.video_id is not distinct from r.video_id and b.split_hint is not distinct from r.split_hint where r.r <= 2")
def _(s, d):
    return captions.first_videos(caps(s, d), 2, "split_hint").select("row_id")


@query("etl_validation", "select split, source, count(*) as captions, count(distinct video_id) as videos, round(median(case when not isnan(clip_sim) then clip_sim end) + 1e-10, 4) as median_similarity from build_splits group by 1, 2")
def _(s, d):
    return captions.validation(caps(s, d))


@query("etl_leaks", "with p as (select distinct video_id, split from build_splits where video_id is not null and split is not null), b as (select a.split as split_a, c.split as split_b, a.video_id from p a join p c on a.video_id = c.video_id and a.split < c.split), r as (select *, row_number() over (partition by split_a, split_b order by video_id) as r from b) select split_a, split_b, count(*) as videos, string_agg(case when r <= 5 then video_id end, ',' order by video_id) as examples from r group by 1, 2")
def _(s, d):
    return captions.leaks(caps(s, d))


@query("etl_first_caption", f"with c as (select video_id, row_id, {CLEAN.format(c='caption')} as caption from build_splits where video_id is not null) select video_id, arg_min(caption, row_id) as caption from c where caption <> '' group by 1")
def _(s, d):
    return captions.first_caption(caps(s, d))


@query("etl_captions_with_category", "select b.row_id, coalesce(c.category_name, 'unknown') as category_name from build_splits b left join category_targets c on try_cast(b.category as integer) = c.category_id and regexp_full_match(b.category, '[0-9]+')")
def _(s, d):
    names = table(s, d, "category_targets").select(F.col("category_id").cast("string").alias("category"), "category_name")
    return caps(s, d).join(F.broadcast(names), "category", "left").select("row_id", F.coalesce("category_name", F.lit("unknown")).alias("category_name"))


@query("etl_records_with_captions", "with a as (select video_id, list_sort(list_distinct(list(caption))) as cs from build_splits where caption is not null group by 1) select v.record_id, coalesce(a.cs[1], v.caption) as reference, coalesce(len(a.cs), 0) as known from val_outputs_all v left join a on v.video_id = a.video_id")
def _(s, d):
    known = caps(s, d).where("caption is not null").groupBy("video_id").agg(F.min("caption").alias("c"), F.count_distinct("caption").alias("n"))
    return table(s, d, "val_outputs_all").join(known, "video_id", "left").select("record_id", F.coalesce("c", "caption").alias("reference"), F.coalesce("n", F.lit(0)).alias("known"))


# -- vectors and search -------------------------------------------------------------------------
def gallery(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def moments(s: SparkSession, d: str) -> DataFrame:
    """The vectors as windows of five a video."""
    g = gallery(s, d)
    v = F.floor(F.col("id") / 5)
    return g.select(F.format_string("v%05d_w%03d", v, F.col("id") % 5).alias("window_id"), F.format_string("v%05d", v).alias("video_id"), ((F.col("id") % 5) * 5).cast("double").alias("start_sec"), ((F.col("id") % 5) * 5 + 10).cast("double").alias("end_sec"), "vector", "label")


def query_vector(s: SparkSession, d: str, vec_id: int = 0) -> list[float]:
    r = table(s, d, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()
    return [float(x) for x in r[0]] if r else [0.0] * 64


_DOT = "round(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda p: p[1]::double * p[2]::double)), 6)"
_Q0 = "(select embedding from embeddings where vec_id = 0) q"
_BLOCK = f"q as (select vec_id as query_id, embedding from embeddings where vec_id % 20 = 0), s as (select q.query_id, e.vec_id as id, e.label, {_DOT} as score from embeddings e, q)"


@query("search_top_k", f"select e.vec_id as id, {_DOT} as score from embeddings e, {_Q0} order by score desc, id limit 10")
def _(s, d):
    return search.top_k(gallery(s, d), query_vector(s, d), 10)


@query("search_top_k_filtered", f"select e.vec_id as id, {_DOT} as score from embeddings e, {_Q0} where e.label = 3 order by score desc, id limit 10")
def _(s, d):
    return search.top_k(gallery(s, d), query_vector(s, d), 10, F.col("label") == 3)


@query("search_block_top_k", f"with {_BLOCK}, r as (select query_id, id, score, cast(row_number() over (partition by query_id order by score desc, id) as integer) as rank from s) select * from r where rank <= 10")
def _(s, d):
    g = gallery(s, d)
    return search.block_top_k(g, g.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector"), 10)


_MOMENTS = f"""with h as (select printf('v%05d_w%03d', e.vec_id // 5, e.vec_id % 5) as window_id, printf('v%05d', e.vec_id // 5) as video_id, ((e.vec_id % 5) * 5)::double as start_sec, ((e.vec_id % 5) * 5 + 10)::double as end_sec, {_DOT} as stage1 from embeddings e, {_Q0}),
    g as (select * from (select *, row_number() over (partition by video_id order by stage1 desc, window_id) as r from h) where r = 1), f as (select *, round(least(greatest((stage1 - 0.15) / 0.25, 0), 1), 6) as score from g), t as (select * from g order by stage1 desc, window_id limit 10)
    select video_id, window_id, start_sec, end_sec, stage1, round(least(greatest((stage1 - 0.15) / 0.25, 0.0), 1.0), 6) as score, cast(row_number() over (order by round(least(greatest((stage1 - 0.15) / 0.25, 0.0), 1.0), 6) desc, video_id) as integer) as rank from t"""


@query("search_moments", _MOMENTS)
def _(s, d):
    return search.search_moments(moments(s, d), query_vector(s, d), 10).drop("rerank")


@query("search_moments_compat", f"""with h as (select printf('v%05d_w%03d', e.vec_id // 5, e.vec_id % 5) as window_id, printf('v%05d', e.vec_id // 5) as video_id, ((e.vec_id % 5) * 5)::double as start_sec, ((e.vec_id % 5) * 5 + 10)::double as end_sec, {_DOT} as stage1 from embeddings e, {_Q0}),
    c as (select * from h order by stage1 desc, window_id limit 50), g as (select * from (select *, row_number() over (partition by video_id order by stage1 desc, window_id) as r from c) where r = 1 order by stage1 desc, window_id limit 10)
    select video_id, window_id, start_sec, end_sec, stage1, round(least(greatest((stage1 - 0.15) / 0.25, 0.0), 1.0), 6) as score, cast(row_number() over (order by round(least(greatest((stage1 - 0.15) / 0.25, 0.0), 1.0), 6) desc, video_id) as integer) as rank from g""")
def _(s, d):
    return search.search_moments(moments(s, d), query_vector(s, d), 10, mode="compat").drop("rerank")


@query("search_pool_features", """with p as (select distinct window_id from base where window_id is not null), f as (select window_id, any_value(len(frame_features)) as frames, any_value(len(frame_times)) as times from base where frame_features is not null and frame_times is not null and window_id is not null group by 1)
    select p.window_id, f.frames, f.times from p left join f on p.window_id = f.window_id""")
def _(s, d):
    b = table(s, d, "base").where("window_id is not null")
    store = b.where("frame_features is not null and frame_times is not null").select("window_id", F.col("frame_features").alias("features"), F.col("frame_times").alias("times")).dropDuplicates(["window_id"])
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c).cast("bigint"))
    return search.with_features(b.select("window_id").distinct(), store).select("window_id", size("features").alias("frames"), size("times").alias("times"))


@query("search_best_times", """with h as (select video_id, max(stage1_score) as score from base where video_id is not null and stage1_score is not null and not isnan(stage1_score) group by 1),
    t as (select video_id, list(distinct start_sec order by start_sec) as ts from base where video_id is not null and start_sec is not null and start_sec > 0 group by 1)
    select h.video_id, h.score, coalesce(len(t.ts), 0) as stamps, coalesce(t.ts[len(t.ts) // 2 + 1], 0.0) as best_timestamp from h left join t on h.video_id = t.video_id""")
def _(s, d):
    b = table(s, d, "base").where("video_id is not null")
    hits = b.where("stage1_score is not null and not isnan(stage1_score)").groupBy("video_id").agg(F.max("stage1_score").alias("score"))
    times = b.where("start_sec > 0").groupBy("video_id").agg(F.array_sort(F.collect_set("start_sec")).alias("timestamps"))
    return search.with_times(hits, times).select("video_id", "score", F.size("timestamps").cast("bigint").alias("stamps"), "best_timestamp")


_JIT = "((('0x' || substr(h, 15, 2) || substr(h, 13, 2) || substr(h, 11, 2) || substr(h, 9, 2))::bigint % 10000) * 7296 + ('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2))::bigint) % 10000"


@query("search_reranked", f"""with h as (select printf('v%05d_w%03d', e.vec_id // 5, e.vec_id % 5) as window_id, printf('v%05d', e.vec_id // 5) as video_id, ((e.vec_id % 5) * 5)::double as start_sec, ((e.vec_id % 5) * 5 + 10)::double as end_sec, {_DOT} as stage1 from embeddings e, {_Q0}),
    g as (select *, md5('q0' || chr(31) || window_id) as h from (select *, row_number() over (partition by video_id order by stage1 desc, window_id) as r from h) where r = 1 order by stage1 desc, window_id limit 50),
    f as (select video_id, window_id, start_sec, end_sec, stage1, stage1 + 0.12::double * (({_JIT}) / 10000.0::double - 0.5) as rerank from g), s as (select *, round(1 / (1 + exp(-(rerank - 0.3) * 7.0)), 6) as score from f)
    select video_id, window_id, start_sec, end_sec, stage1, round(rerank, 6) as rerank, score, cast(row_number() over (order by score desc, video_id) as integer) as rank from s order by score desc, video_id limit 10""")
def _(s, d):
    again = lambda pool: pool.withColumn("rerank", V.jittered(F.col("stage1"), F.lit("q0"), F.col("window_id")))
    return search.search_moments(moments(s, d), query_vector(s, d), 10, again, fuse=V.fuse_logistic).withColumn("rerank", F.round("rerank", 6))


@query("search_jitter", """
    with m as (select vec_id, md5('q0' || chr(31) || printf('w%05d', vec_id)) as h from embeddings),
    b as (select vec_id, h, (('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2))::bigint) as lo, (('0x' || substr(h, 15, 2) || substr(h, 13, 2) || substr(h, 11, 2) || substr(h, 9, 2))::bigint) as hi from m)
    select vec_id, round(0.5 + 0.12 * (((hi % 10000) * 7296 + lo) % 10000 / 10000.0 - 0.5), 6) as score from b""")
def _(s, d):
    return table(s, d, "embeddings").select("vec_id", F.round(V.jittered(F.lit(0.5), F.lit("q0"), F.format_string("w%05d", "vec_id")), 6).alias("score"))


@query("search_fusions", f"""with h as (select e.vec_id, {_DOT} as x from embeddings e, {_Q0}) select vec_id, round(1 / (1 + exp(-(x - 0.3) * 7)), 6) as logistic, round(least(greatest((x - 0.15) / 0.25, 0), 1), 6) as range_, round(1 / (1 + exp(-(x - 0.2) * 10)), 6) as two_stage, round(least(greatest((x + 1) / 2, 0), 1), 7) as half from h""")
def _(s, d):
    q = F.array(*[F.lit(x) for x in query_vector(s, d)])
    x, none = F.col("x"), F.lit(None).cast("double")
    h = gallery(s, d).select(F.col("id").alias("vec_id"), F.round(V.dot(F.col("vector"), q), 6).alias("x"))
    return h.select("vec_id", F.round(V.fuse_logistic(x, none), 6).alias("logistic"), F.round(V.fuse_range(x), 6).alias("range_"), F.round(V.fuse_two_stage(x, none), 6).alias("two_stage"), F.round(V.fuse_half(x), 7).alias("half"))


@query("search_frame_similarity", f"select e.vec_id as id, round((1 + {_DOT}) / 2, 4) as similarity from embeddings e, {_Q0} order by {_DOT} desc, id limit 5")
def _(s, d):
    return search.top_k(gallery(s, d), query_vector(s, d), 5).select("id", F.round((F.col("score") + 1) / 2, 4).alias("similarity"))


@query("search_page", "select video_id, created_at from videos order by created_at desc, video_id limit 24 offset 24")
def _(s, d):
    return search.page(table(s, d, "videos"), 24, 24).select("video_id", "created_at")


@query("search_ground_truth", r"""
    with t as (select string_split(captions, '|')[1] as q from videos where captions <> '' order by video_id limit 1), c as (select video_id, unnest(string_split(captions, '|')) as caption from videos),
    k as (select video_id, array_to_string(regexp_extract_all(lower(caption), '([a-z0-9]+)', 1), ' ') as k from c) select min(video_id) as video_id from k, t where k.k = array_to_string(regexp_extract_all(lower(t.q), '([a-z0-9]+)', 1), ' ') having min(video_id) is not null""")
def _(s, d):
    v = table(s, d, "videos")
    first = v.where("captions <> ''").orderBy("video_id").select(F.split("captions", r"\|")[0].alias("q")).first()
    return search.first_with_caption(v, first[0] if first else "")


@query("search_rank_changes", f"""with a as (select e.vec_id, row_number() over (order by {_DOT} desc, e.vec_id) as r from embeddings e, {_Q0}), b as (select e.vec_id, row_number() over (order by {_DOT} desc, e.vec_id) as r from embeddings e, (select embedding from embeddings where vec_id = 5) q)
    select b.vec_id as video_id, cast(b.r as integer) as rank, cast(a.r as integer) as "before", coalesce(cast(a.r - b.r as varchar), 'new') as change from b left join (select * from a where r <= 20) a on a.vec_id = b.vec_id where b.r <= 20""")
def _(s, d):
    run = lambda q: search.dense_rank_of(search.top_k(gallery(s, d), query_vector(s, d, q), 20), "score", "id", 20).select(F.col("id").alias("video_id"), "rank")
    return search.rank_changes(run(5), run(0))


@query("search_attach", "with t as (select video_id, max(stage1_score) as score from base where video_id is not null and stage1_score is not null and not isnan(stage1_score) group by 1), j as (select t.video_id, t.score, v.title from t join videos v on t.video_id = v.video_id) select *, cast(row_number() over (order by score desc, video_id) as integer) as rank from j")
def _(s, d):
    hits = table(s, d, "base").where("video_id is not null and stage1_score is not null and not isnan(stage1_score)").groupBy("video_id").agg(F.max("stage1_score").alias("score")).withColumn("rank", F.lit(0))
    return search.attach_videos(hits, table(s, d, "videos").select("video_id", "title"))


_SOUND = "len(frame_features) > 0 and len(list_filter(frame_features, lambda r: len(r) <> 64 or len(list_filter(r, lambda x: x is null or isnan(x) or isinf(x))) > 0 or len(list_filter(r, lambda x: x <> 0)) = 0)) = 0"
_UNIT = "list_transform({v}, lambda x: x::double / greatest(sqrt(list_sum(list_transform({v}, lambda y: y::double * y::double))), 1e-12))"


@query("search_aligned_pairs", f"""with w as (select window_id, any_value(embedding) as e, any_value(frame_features) as f from base where {_SOUND} and window_id is not null and len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0 group by 1)
    select window_id, round(list_sum(list_transform(list_zip(e, f[1]), lambda p: p[1]::double * p[2]::double)) / (sqrt(list_sum(list_transform(e, lambda x: x::double * x::double))) * sqrt(list_sum(list_transform(f[1], lambda x: x::double * x::double)))), 6) as similarity from w""")
def _(s, d):
    fine = V.sound(F.col("embedding")) & F.forall("frame_features", lambda r: V.sound(r))
    w = table(s, d, "base").where(F.size("frame_features") > 0).where(fine).where("window_id is not null").select("window_id", "embedding", F.get("frame_features", F.lit(0)).alias("frame")).dropDuplicates(["window_id"])
    return w.select("window_id", F.round(V.cosine(F.col("embedding"), F.col("frame")), 6).alias("similarity"))


@query("search_pooled_frames", f"""with w as (select window_id, any_value(frame_features) as f from base where {_SOUND} group by 1), e as (select window_id, generate_subscripts(f, 1) as k, unnest(f) as r from w),
    n as (select window_id, k, r, {_UNIT.format(v='r')} as u from e), x as (select window_id, unnest(range(1, 65)) as i, u, r from n), m as (select window_id, i, avg(u[i]) as a, avg(r[i]::double) as b from x group by 1, 2)
    select window_id, round(max(case when i = 1 then a end) / sqrt(sum(a * a)), 6) as first_normed, round(max(case when i = 1 then b end) / sqrt(sum(b * b)), 6) as first_plain from m group by 1""")
def _(s, d):
    fine = F.forall("frame_features", lambda r: V.sound(r))
    w = table(s, d, "base").where(F.size("frame_features") > 0).where(fine).select("window_id", "frame_features").dropDuplicates(["window_id"])
    a, b = V.pooled(F.col("frame_features")), V.pooled(F.col("frame_features"), normed=False)
    return w.select("window_id", F.round(F.get(a, F.lit(0)), 6).alias("first_normed"), F.round(F.get(b, F.lit(0)), 6).alias("first_plain"))


# -- evaluation ---------------------------------------------------------------------------------
def _ranks(s: SparkSession, d: str) -> DataFrame:
    """Queries are every 20th vector moved towards the next one; the truth is the vector itself."""
    g = gallery(s, d)
    nxt = g.select((F.col("id") - 1).alias("id"), F.col("vector").alias("n"))
    q = g.where("id % 20 = 0").join(nxt, "id").select(F.col("id").alias("query_id"), F.col("id").alias("truth_id"), F.zip_with("vector", "n", lambda a, b: (a * F.lit(0.5) + b).cast("double")).alias("vector"))
    return evaluation.truth_ranks(g, q)


_RANKS = """q as (select a.vec_id as query_id, list_transform(list_zip(a.embedding, b.embedding), lambda p: (p[1]::double * 0.5 + p[2]::double)) as v from embeddings a join embeddings b on b.vec_id = a.vec_id + 1 where a.vec_id % 20 = 0),
    s as (select q.query_id, e.vec_id as id, round(list_sum(list_transform(list_zip(e.embedding, q.v), lambda p: p[1]::double * p[2])), 6) as score from embeddings e, q),
    g as (select query_id, score as gold from s where id = query_id), r as (select s.query_id, g.gold as score, cast(1 + count_if(s.score > g.gold or (s.score = g.gold and s.id < s.query_id)) as bigint) as rank from s join g on s.query_id = g.query_id group by 1, 2)"""


@query("eval_truth_ranks", f"with {_RANKS} select query_id, query_id as truth_id, score, rank from r")
def _(s, d):
    return _ranks(s, d)


def _metrics_sql(f: str) -> str:
    hit = lambda k: f"round(avg(case when rank <= {k} then {f} else 0.0 end), 6)"
    return f"with {_RANKS} select {hit(1)} as r1, {hit(5)} as r5, {hit(10)} as r10, round(avg({f} / rank), 6) as mrr, round(avg(rank), 6) as mean_rank, median(rank) as median_rank, count(*) as queries from r"


@query("eval_metrics", _metrics_sql("1.0::double"))
def _(s, d):
    return evaluation.retrieval_metrics(_ranks(s, d))


@query("eval_metrics_percent", _metrics_sql("100.0::double"))
def _(s, d):
    return evaluation.retrieval_metrics(_ranks(s, d), percent=True)


@query("eval_confusion", f"""with {_RANKS}, n as (select count(*) as n from embeddings), x as (select unnest([1, 5, 10]) as k, rank from r),
    c as (select k, count_if(rank <= k) as tp, cast(sum(greatest(case when rank <= k then k - 1 else k end, 0)) as bigint) as fp, count_if(rank > k) as fn, cast(sum(greatest(n - k - case when rank <= k then 0 else 1 end, 0)) as bigint) as tn from x, n group by 1)
    select k, tp, fp, fn, tn, round(tp / greatest(tp + fp, 1), 6) as precision, round(tp / greatest(tp + fn, 1), 6) as recall, round(2 * (tp / greatest(tp + fp, 1)) * (tp / greatest(tp + fn, 1)) / greatest(tp / greatest(tp + fp, 1) + tp / greatest(tp + fn, 1), 1e-12), 6) as f1 from c""")
def _(s, d):
    return evaluation.confusion(_ranks(s, d), gallery(s, d).count(), [1, 5, 10])


@query("eval_match_curve", f"with {_RANKS} select k, round(avg(case when rank <= k then 1.0::double else 0 end), 6) as share from (select unnest(range(1, 21)) as k, rank from r) group by 1")
def _(s, d):
    return evaluation.match_curve(_ranks(s, d)).select(F.col("k").cast("bigint").alias("k"), "share")


@query("eval_top_two", "with r as (select video_id, stage1_score, row_number() over (partition by video_id order by stage1_score desc) as r from base where video_id is not null and stage1_score is not null and not isnan(stage1_score)) select video_id, round(avg(stage1_score), 6) as score from r where r <= 2 group by 1")
def _(s, d):
    b = table(s, d, "base").where("video_id is not null and stage1_score is not null and not isnan(stage1_score)")
    return evaluation.top_frame_score(b, ["video_id"], "stage1_score").select("video_id", F.round("stage1_score", 6).alias("score"))


def _batches(s: SparkSession, d: str) -> DataFrame:
    g = gallery(s, d)
    return g.select(F.floor(F.col("id") / 16).alias("batch_id"), (F.col("id") % 16).alias("i"), F.col("label").alias("group"), F.col("vector").alias("a"), F.col("vector").alias("b"))


def _loss_sql(positive: str) -> str:
    return f"""with p as (select vec_id // 16 as batch_id, vec_id % 16 as i, label, embedding from embeddings),
    l as (select a.batch_id, a.i, b.i as j, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: p[1]::double * p[2]::double)) / 0.07 as x, ({positive})::integer as p from p a join p b on a.batch_id = b.batch_id),
    r as (select batch_id, i, ln(sum(exp(x))) as lse from l group by 1, 2), c as (select batch_id, j, ln(sum(exp(x))) as lse from l group by 1, 2),
    ri as (select l.batch_id, l.i, -sum((x - lse) * p) / greatest(sum(p), 1) as v from l join r on l.batch_id = r.batch_id and l.i = r.i group by 1, 2),
    ci as (select l.batch_id, l.j, -sum((x - lse) * p) / greatest(sum(p), 1) as v from l join c on l.batch_id = c.batch_id and l.j = c.j group by 1, 2)
    select a.batch_id, round((a.v + b.v) / 2, 6) as loss from (select batch_id, avg(v) as v from ri group by 1) a join (select batch_id, avg(v) as v from ci group by 1) b on a.batch_id = b.batch_id"""


@query("eval_contrastive_loss", _loss_sql("a.i = b.i"))
def _(s, d):
    one = evaluation.batch_logits(_batches(s, d)).withColumn("positive", F.col("i") == F.col("j"))
    return evaluation.contrastive_loss(one)


@query("eval_multi_positive_loss", _loss_sql("a.label = b.label"))
def _(s, d):
    return evaluation.contrastive_loss(evaluation.batch_logits(_batches(s, d)))


@query("eval_weighted_losses", "select l_returnflag as epoch, l_linestatus as source, round(sum(l_discount * l_quantity) / greatest(sum(l_quantity), 1), 6) as mean_loss, sum(l_quantity) as samples from lineitem group by 1, 2")
def _(s, d):
    log = table(s, d, "lineitem").select(F.col("l_returnflag").alias("epoch"), F.col("l_linestatus").alias("source"), F.col("l_discount").alias("loss"), F.col("l_quantity").alias("n"))
    return evaluation.weighted_losses(log, ["epoch", "source"])


@query("eval_compared", f"with {_RANKS}, m as (select 'r1' as metric, avg(case when rank <= 1 then 1.0::double else 0 end) as v, avg(case when rank <= 2 then 1.0::double else 0 end) as w from r union all select 'mrr', avg(1.0::double / rank), avg(1.0::double / (rank + 1)) from r) select metric, round(v, 6) as \"before\", round(w, 6) as \"after\", round(round(w, 6) - round(v, 6), 6) as change from m")
def _(s, d):
    r = _ranks(s, d)
    one = lambda k, add: r.agg(F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 6).alias("r1"), F.round(F.avg(1.0 / (F.col("rank") + add)), 6).alias("mrr")).select(F.inline(F.array(F.struct(F.lit("r1").alias("metric"), F.col("r1").alias("value")), F.struct(F.lit("mrr").alias("metric"), F.col("mrr").alias("value")))))
    return evaluation.compared(one(1, 0), one(2, 1))


def _answers(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = table(s, d, "val_outputs_all").where("caption is not null and model_output is not null and video_id is not null")
    p = v.groupBy("video_id").agg(F.min_by("model_output", "record_id").alias("prediction"))
    return p, v.select("video_id", "caption").distinct()


_ANS_WORDS = r"list_filter(regexp_split_to_array(lower({c}), '[\t-\r \x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+'), lambda x: x <> '')"
_GRAMS = " union all ".join(f"select {{keys}}, {n} as n, unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) as g from {{rel}}" for n in range(1, 5))
_ANS = f"""v as (select * from val_outputs_all where caption is not null and model_output is not null and video_id is not null),
    p as (select video_id, {_ANS_WORDS.format(c='arg_min(model_output, record_id)')} as w from v group by 1), r as (select video_id, caption, {_ANS_WORDS.format(c='caption')} as w from (select distinct video_id, caption from v)),
    pc as (select video_id, n, g, count(*) as c from ({_GRAMS.format(keys='video_id', rel='p')}) group by all), rc as (select video_id, caption, n, g, count(*) as c from ({_GRAMS.format(keys='video_id, caption', rel='r')}) group by all)"""
_BLEU_SCORE = ", ".join(f"round(case when hit1 = 0 then 0.0 else penalty * exp(({' + '.join(f'ln(p{n})' for n in range(1, k + 1))}) / {k}) end, 6) as bleu{k}" for k in range(1, 5))
_BLEU = f"""with {_ANS}, near as (select p.video_id, len(p.w) as plen, min({{'d': abs(len(r.w) - len(p.w)), 'l': len(r.w)}}).l as rlen from p join r on p.video_id = r.video_id group by 1, 2),
    most as (select video_id, n, g, max(c) as m from rc group by all), per as (select pc.video_id, pc.n, sum(least(pc.c, coalesce(m, 0))) as hit, sum(pc.c) as total from pc left join most on pc.video_id = most.video_id and pc.n = most.n and pc.g = most.g group by all),
    o as (select near.video_id, plen, rlen, {', '.join(f"coalesce(max(case when n = {n} then (case when hit > 0 then hit else 0.1 end)::double / total end), 0.1) as p{n}" for n in range(1, 5))}, coalesce(max(case when n = 1 then hit end), 0) as hit1 from near left join per on near.video_id = per.video_id group by 1, 2, 3),
    q as (select *, case when plen > rlen then 1.0 else exp(1 - rlen::double / greatest(plen, 1)) end as penalty from o) select video_id, {_BLEU_SCORE} from q"""


def _cider_sql(corpus: bool) -> str:
    df = "select n, g, count(*) as df from (select distinct video_id, n, g from rc) group by all" if corpus else "select video_id, n, g, count(*) as df from rc group by all"
    on = "x.n = df.n and x.g = df.g" + ("" if corpus else " and x.video_id = df.video_id")
    idf = "ln((select count(distinct video_id) from r)::double / (1 + coalesce(df, 0)))" if corpus else "ln((refs + 1.0::double) / (coalesce(df, 0) + 1))"
    weigh = lambda rel, keys: f"select x.*, x.c::double / sum(x.c) over (partition by {keys}, x.n) * {idf} as w from {rel} x join size on x.video_id = size.video_id left join df on {on}"
    scale = "exp(-pow((len(p.w) - len(r.w))::double, 2) / 72.0)" if corpus else "1.0::double"
    return f"""with {_ANS}, size as (select video_id, count(*) as refs from r group by 1), df as ({df}), pv as ({weigh('pc', 'x.video_id')}), rv as ({weigh('rc', 'x.video_id, x.caption')}),
    pn as (select video_id, n, sqrt(sum(w * w)) as pn from pv group by all), dots as (select rv.video_id, rv.caption, rv.n, sum(coalesce(rv.w * pv.w, 0.0)) as dot, sqrt(sum(rv.w * rv.w)) as rn from rv left join pv on rv.video_id = pv.video_id and rv.n = pv.n and rv.g = pv.g group by all),
    per as (select dots.video_id, sum(coalesce(dot / nullif(rn * pn, 0), 0.0) * {scale}) as t from dots left join pn on dots.video_id = pn.video_id and dots.n = pn.n join p on dots.video_id = p.video_id join r on dots.video_id = r.video_id and dots.caption = r.caption group by 1)
    select p.video_id, round(10.0::double * coalesce(t, 0.0) / (4.0 * refs), 6) as cider from p join size on p.video_id = size.video_id left join per on p.video_id = per.video_id"""


@query("eval_bleu", _BLEU)
def _(s, d):
    return text_metrics.bleu(*_answers(s, d))


@query("eval_cider", _cider_sql(True))
def _(s, d):
    return text_metrics.cider(*_answers(s, d))


@query("eval_cider_own_references", _cider_sql(False))
def _(s, d):
    return text_metrics.cider(*_answers(s, d), corpus_df=False)


@query("eval_tfidf", r"""
    with d as (select video_id as doc_id, regexp_extract_all(lower(captions), '[\p{L}\p{N}_]{2,}') as w from videos where captions <> ''), q as (select record_id as query_id, regexp_extract_all(lower(caption), '[\p{L}\p{N}_]{2,}') as w from val_outputs_all where caption is not null and record_id % 20 = 0),
    dt as (select doc_id, t, count(*) as tf from (select doc_id, unnest(list_concat(w, case when len(w) > 1 then list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) else [] end)) as t from d) group by 1, 2),
    qt as (select query_id, t, count(*) as tf from (select query_id, unnest(list_concat(w, case when len(w) > 1 then list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) else [] end)) as t from q) group by 1, 2),
    n as (select (select count(*) from d) + (select count(*) from q) as n), f as (select t, count(*) as df from (select t from dt union all select t from qt) group by 1), i as (select t, ln((1.0 + n) / (1.0 + df)) + 1.0 as idf from f, n),
    dw as (select doc_id, t, tf * idf / sqrt(sum((tf * idf) ** 2) over (partition by doc_id)) as w from dt join i using (t)), qw as (select query_id, t, tf * idf / sqrt(sum((tf * idf) ** 2) over (partition by query_id)) as w from qt join i using (t)),
    s as (select query_id, doc_id, round(sum(dw.w * qw.w), 6) as score from qw join dw using (t) group by 1, 2), r as (select *, cast(row_number() over (partition by query_id order by score desc, doc_id) as integer) as rank from s) select * from r where rank <= 5""")
def _(s, d):
    docs = table(s, d, "videos").select(F.col("video_id").alias("doc_id"), F.col("captions").alias("text")).where("text <> ''")
    q = table(s, d, "val_outputs_all").where("caption is not null and record_id % 20 = 0").select(F.col("record_id").alias("query_id"), F.col("caption").alias("text"))
    return text_metrics.tfidf_matches(docs, q)


# -- moments ------------------------------------------------------------------------------------
def _framed(s: SparkSession, d: str) -> DataFrame:
    b = table(s, d, "base").where("video_id is not null and window_id is not null and frame_times is not null")
    return b.where(F.size("frame_features") > 0).where(F.forall("frame_features", lambda r: V.sound(r))).groupBy("window_id", "video_id").agg(F.first("frame_times").alias("frame_times"), F.first("frame_features").alias("frame_features"), F.min("start_sec").alias("start_sec"))


def _curve(s: SparkSession, d: str) -> DataFrame:
    return localize.frame_saliency(_framed(s, d), query_vector(s, d))


_FRAMES = f"""f as (select window_id, video_id, any_value(frame_times) as ft, any_value(frame_features) as ff from base where video_id is not null and window_id is not null and frame_times is not null and {_SOUND} group by 1, 2),
    x as (select video_id, window_id, unnest(range(1, least(len(ft), len(ff)) + 1)) as i, ft, ff from f), y as (select video_id, window_id, i, ft[i]::double as t, ff[i] as feature from x where ft[i] is not null),
    fr as (select * from (select *, t - lag(t) over (partition by video_id order by t, window_id, i) as d from y) where d is null or d > 0.001)"""
_CURVE = f"""{_FRAMES}, si as (select fr.video_id, fr.t, round(list_sum(list_transform(list_zip({_UNIT.format(v='fr.feature')}, q.embedding), lambda p: p[1] * p[2]::double)), 9) as similarity from fr, {_Q0}),
    sm as (select *, 0.25::double * coalesce(lag(similarity) over (partition by video_id order by t), 0) + 0.5::double * similarity + 0.25::double * coalesce(lead(similarity) over (partition by video_id order by t), 0) as s from si),
    cu as (select video_id, t, similarity, case when max(s) over (partition by video_id) - min(s) over (partition by video_id) > 1e-6 then (s - min(s) over (partition by video_id)) / (max(s) over (partition by video_id) - min(s) over (partition by video_id)) else 1.0 end as saliency from sm)"""


@query("moment_windows", """
    with v as (select video_id, duration as d from videos where duration > 0 and not isnan(duration)), n as (select *, case when d <= 10 then 1 else cast(ceil((d - 10) / 5) as bigint) + 1 end as n from v),
    w as (select video_id, d, unnest(range(0, n)) as i from n), x as (select distinct video_id, case when d <= 10 then 0.0 else round(least(i * 5.0, d - 10), 3) end as start_sec, d from w)
    select video_id, start_sec, round(case when d <= 10 then d else start_sec + 10 end, 3) as end_sec, printf('%s_w%03d', video_id, cast(row_number() over (partition by video_id order by start_sec) - 1 as bigint)) as window_id from x""")
def _(s, d):
    return vector_index.window_rows(table(s, d, "videos").where("duration > 0 and not isnan(duration)"))


@query("moment_frame_numbers", "select video_id, unnest(list_transform(range(0, 8), lambda i: cast(floor(i * (cast(floor(duration * 25) as bigint) - 1) / 7.0) as bigint))) as frame from videos where duration > 1 and not isnan(duration)")
def _(s, d):
    v = table(s, d, "videos").where("duration > 1 and not isnan(duration)")
    return v.select("video_id", F.explode(F.transform(L.even_indices(F.floor(F.col("duration") * 25), 8), lambda x: x.cast("bigint"))).alias("frame"))


@query("moment_centres", "select video_id, unnest(list_transform(range(0, 5), lambda i: round((i + 0.5) * duration / 5, 6))) as t from videos where duration > 0 and not isnan(duration)")
def _(s, d):
    c = L.segment_centres(F.lit(0.0), F.col("duration"), 5)
    return table(s, d, "videos").where("duration > 0 and not isnan(duration)").select("video_id", F.explode(F.transform(c, lambda x: F.round(x, 6))).alias("t"))


@query("moment_frames", f"with {_FRAMES} select video_id, window_id, t from fr")
def _(s, d):
    return localize.frames(_framed(s, d)).select("video_id", "window_id", "t")


@query("moment_saliency", f"with {_CURVE} select video_id, t, round(similarity, 6) as similarity, round(saliency, 6) as saliency from cu")
def _(s, d):
    return _curve(s, d).select("video_id", "t", F.round("similarity", 6).alias("similarity"), F.round("saliency", 6).alias("saliency"))


@query("moment_islands", f"""with {_CURVE}, n as (select *, saliency >= 0.6 and not coalesce(lag(saliency >= 0.6) over (partition by video_id order by t), false) as starts, t - lag(t) over (partition by video_id order by t) as d from cu),
    g as (select *, sum(starts::integer) over (partition by video_id order by t) as g, coalesce(median(d) over (partition by video_id), 1.0) as step from n)
    select video_id, round(greatest(min(t) - max(step) / 2, 0), 4) as "start", round(max(t) + max(step) / 2, 4) as "end", round(avg(saliency), 4) as score from g where saliency >= 0.6 group by video_id, g""")
def _(s, d):
    return localize.islands(_curve(s, d)).select("video_id", F.round("start", 4).alias("start"), F.round("end", 4).alias("end"), F.round("score", 4).alias("score"))


@query("moment_localized")
def _(s, d):
    return localize.localized(_framed(s, d), query_vector(s, d), table(s, d, "videos").where("duration > 0 and not isnan(duration)").select("video_id", "duration"))


@query("moment_best_time", f"with {_CURVE} select video_id, t from (select *, row_number() over (partition by video_id order by similarity desc, t) as r from cu) where r = 1")
def _(s, d):
    return localize.best_time(_curve(s, d))


@query("moment_answers")
def _(s, d):
    found = localize.localized(_framed(s, d), query_vector(s, d), table(s, d, "videos").where("duration > 0 and not isnan(duration)").select("video_id", "duration"))
    return found.select("video_id", T.grounded_answer(F.lit("the moment"), F.col("spans")).alias("answer"))


@query("moment_neighbours", """
    with w as (select distinct video_id, window_id, start_sec from base where video_id is not null and window_id is not null), n as (select *, row_number() over (partition by video_id order by start_sec, window_id) as n from w),
    b as (select video_id, arg_max(window_id, window_id) as b from w group by 1), a as (select n.*, coalesce(max(case when n.window_id = b.b then n.n end) over (partition by n.video_id), 1) as at_n from n join b on n.video_id = b.video_id)
    select video_id, window_id from a where abs(n - at_n) <= 1""")
def _(s, d):
    w = table(s, d, "base").where("video_id is not null and window_id is not null").select("video_id", "window_id", "start_sec").distinct()
    return localize.neighbours(w, w.groupBy("video_id").agg(F.max("window_id").alias("window_id"))).select("video_id", "window_id")


@query("moment_gaps", "with t as (select distinct user_id, epoch_us(ts) / 1e6 as t from events), d as (select user_id, t - lag(t) over (partition by user_id order by t) as d from t) select user_id, round(median(d), 3) as step from d group by 1 having median(d) is not null")
def _(s, d):
    e = table(s, d, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t")).distinct()
    w = Window.partitionBy("user_id").orderBy("t")
    return e.withColumn("d", F.col("t") - F.lag("t").over(w)).groupBy("user_id").agg(F.round(F.median("d"), 3).alias("step")).where("step is not null")


# -- exploratory statistics ---------------------------------------------------------------------
def _describe_sql(v: str, rel: str, by: str = "") -> str:
    q = lambda p: f"round(quantile_cont({v}, {p}), 3)"
    return f"select {by + ',' if by else ''} round(avg({v}), 3) as mean, round(stddev_samp({v}), 3) as std, round(min({v}), 3) as min, {q(0.25)} as p25, {q(0.5)} as median, {q(0.75)} as p75, {q(0.95)} as p95, round(max({v}), 3) as max from {rel} {'group by ' + by if by else ''}"


@query("eda_durations", _describe_sql("duration", "(select source, duration from videos where duration is not null and not isnan(duration))", "source"))
def _(s, d):
    return stats.describe(table(s, d, "videos").where("duration is not null and not isnan(duration)"), F.col("duration"), ["source"])


@query("eda_words", _describe_sql("w", f"(select source, len({WORDS.format(c=N)})::double as w from build_splits where caption is not null)", "source"))
def _(s, d):
    return stats.describe(caps(s, d).where("caption is not null"), T.word_count("caption"), ["source"])


@query("eda_duration_histogram", "with v as (select least(duration, 60) as v from videos where duration >= 0 and not isnan(duration)), c as (select least(cast(floor(v / 5) as bigint), 11) as b, count(*) as n from v group by 1) select cast(x.b as integer) as bin, round(x.b * 5.0, 3) as low, round((x.b + 1) * 5.0, 3) as high, coalesce(c.n, 0) as count from (select unnest(range(0, 12)) as b) x left join c on c.b = x.b")
def _(s, d):
    return stats.histogram(table(s, d, "videos").where("duration >= 0 and not isnan(duration)"), F.least("duration", F.lit(60.0)), 0, 60, 12)


@query("eda_captions_per_video", "with c as (select video_id, count(*) as size from build_splits where video_id is not null group by 1) select size, count(*) as groups from c group by 1")
def _(s, d):
    return stats.per_group_sizes(caps(s, d), "video_id")


_TOK = f"regexp_extract_all({N}, '([a-z'']+)', 1)"


@query("eda_top_words", f"with t as (select unnest({_TOK}) as token from build_splits where caption is not null) select token, count(*) as count from t where length(token) > 1 and not list_contains({STOP}, token) group by 1 order by 2 desc, 1 limit 25")
def _(s, d):
    return stats.most_common(caps(s, d), T.content_tokens("caption"), 25)


@query("eda_vocabulary", f"with t as (select unnest({_TOK}) as token from build_splits where caption is not null) select count(distinct token) as vocab_size from t where length(token) > 1 and not list_contains({STOP}, token)")
def _(s, d):
    return stats.vocabulary_size(caps(s, d), T.content_tokens("caption"))


@query("eda_top_bigrams", f"with t as (select {_TOK} as w from build_splits where caption is not null), p as (select unnest(list_transform(range(1, greatest(len(w), 1)), lambda i: {{'a': w[i], 'b': w[i + 1]}})) as p from t) select p.a || ' ' || p.b as token, count(*) as count from p where not list_contains({STOP}, p.a) and not list_contains({STOP}, p.b) group by 1 order by 2 desc, 1 limit 20")
def _(s, d):
    return stats.most_common(caps(s, d), T.content_bigrams("caption"), 20)


@query("eda_duplicates", f"with n as (select video_id, {N} as c from build_splits where caption is not null and video_id is not null) select count(*) as rows, count(distinct c) as distinct_captions, count(*) - count(distinct c) as global_duplicates, count(*) - (select count(*) from (select distinct c, video_id from n)) as intra_video_duplicates from n")
def _(s, d):
    return stats.duplicate_counts(caps(s, d))


@query("eda_pivot", "select source, count_if(split_hint = 'train') as train, count_if(split_hint = 'val') as val, count_if(split_hint = 'test') as test, count_if(split_hint = 'train') + count_if(split_hint = 'val') + count_if(split_hint = 'test') as total from build_splits group by 1")
def _(s, d):
    return stats.pivot_counts(caps(s, d), "source", "split_hint", ["train", "val", "test"])


@query("eda_split_scheme", "select 'official' as scheme, split, case split when 'train' then 0 when 'val' then 1 when 'test' then 2 else 9 end as position, count(distinct video_id) as videos, count(*) as captions from build_splits group by 2")
def _(s, d):
    return stats.split_scheme(caps(s, d), "official")


@query("eda_availability", "select o_orderpriority as split, count_if(o_orderstatus = 'F') as live, count(*) as total, round(100.0 * count_if(o_orderstatus = 'F') / count(*), 2) as live_pct from orders group by 1")
def _(s, d):
    o = table(s, d, "orders").select(F.col("o_orderpriority").alias("split"), F.when(F.col("o_orderstatus") == "F", 200).otherwise(404).alias("status_code"))
    return stats.availability(o)


@query("eda_media_shapes", """
    select case when width is null or height is null or not (width > 0 and height > 0) then 'unknown' when abs(width / height - 4 / 3) < 0.03 then '4:3' when abs(width / height - 16 / 9) < 0.03 then '16:9' when abs(width / height - 1.5) < 0.03 then '3:2' when abs(width / height - 1) < 0.03 then '1:1' when abs(width / height - 1.25) < 0.03 then '5:4' else 'other' end as aspect,
        case when width > 0 and height > 0 then width || 'x' || height else 'unknown' end as resolution, count(*) as videos from videos group by 1, 2""")
def _(s, d):
    return stats.media_shapes(table(s, d, "videos"))


@query("eda_mean_vectors", "with x as (select label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as i from embeddings) select label, cast(i as integer) as i, round(avg(x), 6) as mean from x group by 1, 2")
def _(s, d):
    return stats.mean_vector(table(s, d, "embeddings"), "embedding", ["label"])


@query("eda_shortest", f"with n as (select len({WORDS.format(c=N)}) as words, {N} as caption from build_splits where caption is not null) select distinct words, caption from n where words = (select min(words) from n) order by caption limit 5")
def _(s, d):
    return stats.shortest(caps(s, d))


@query("eda_most_repeated", f"select {N} as caption, count(*) as count from build_splits where caption is not null group by 1 order by 2 desc, 1 limit 8")
def _(s, d):
    return caps(s, d).where("caption is not null").groupBy(T.normalize("caption").alias("caption")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "caption").limit(8)


@query("eda_summary", f"with w as (select len({WORDS.format(c=N)}) as w from build_splits where caption is not null), c as (select round(avg(w), 6) as mean_words, round(100.0 * avg(case when w + 2 <= 77 then 1.0::double else 0 end), 6) as within_77_pct from w), r as (select width || 'x' || height as resolution, count(*) as n from videos where width is not null and height is not null group by 1 order by n desc, 1 limit 1), v as (select round(avg(case when not isnan(duration) then duration end), 6) as mean_duration from videos) select * exclude (n) from c, r, v")
def _(s, d):
    return stats.summary(caps(s, d), table(s, d, "videos"))


@query("eda_latency", "with e as (select event_type as model, value as ms from events) select model, count(*) as n, round(quantile_cont(ms, 0.5), 1) as p50, round(quantile_cont(ms, 0.95), 1) as p95 from e group by grouping sets ((model), ())")
def _(s, d):
    log = table(s, d, "events").select(F.col("event_type").alias("model"), F.to_json(F.struct(F.col("value").alias("total"))).alias("latency_json"))
    return stats.latency_percentiles(log)


# -- splits, sets and samples -------------------------------------------------------------------
def _videos(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "videos").select("video_id", "source", F.when(F.substring(F.md5("video_id"), 1, 1) == "0", "test").alias("split_hint"))


_VS = "v as (select video_id, source, case when substr(md5(video_id), 1, 1) = '0' then 'test' end as h from videos)"


@query("split_stratified", f"with {_VS}, r as (select *, row_number() over (partition by source order by md5('42|' || video_id)) as r, count(*) over (partition by source) as n from v where h is null) select video_id, case when r <= ceil(n * 0.1) then 'val' else 'train' end as split from r union all select video_id, 'test' from v where h = 'test'")
def _(s, d):
    return splits.stratified_split(_videos(s, d), "source")


@query("split_shuffled", "with r as (select video_id, row_number() over (order by md5('42|' || video_id)) as r, count(*) over () as n from videos) select video_id, case when r <= floor(0.1 * n) then 'val' else 'train' end as split from r")
def _(s, d):
    return splits.shuffled_split(table(s, d, "videos"), "video_id")


@query("split_sample", "select video_id from videos order by md5('42|' || video_id) limit 50")
def _(s, d):
    return splits.sampled(table(s, d, "videos"), "video_id", 50)


@query("split_capped", "select source, row_id from (select source, row_id, row_number() over (partition by source order by md5('42|' || row_id)) as r from build_splits) where r <= 100")
def _(s, d):
    return splits.capped_per_source(caps(s, d), "source", "row_id", 100).select("source", "row_id")


@query("split_equal_draws", """with r as (select source, row_id, row_number() over (partition by source order by md5('42|' || row_id)) as rank, count(*) over (partition by source) as size from build_splits),
    s as (select source, any_value(size) as size, row_number() over (order by source) - 1 as i from r group by 1), d as (select i as draw, ('0x' || substr(md5('42|source|' || i), 1, 12))::bigint % (select count(*) from s) as k, ('0x' || substr(md5('42|row|' || i), 1, 12))::bigint as h from (select unnest(range(1000)) as i))
    select d.draw, s.source, r.row_id from d join s on d.k = s.i join r on r.source = s.source and r.rank = d.h % s.size + 1""")
def _(s, d):
    return splits.equal_source_draws(caps(s, d), "source", "row_id", 1000)


@query("split_difference", "select distinct video_id from videos where video_id not in (select video_id from build_splits where video_id is not null) and video_id not in (select video_id from val_outputs_all where video_id is not null)")
def _(s, d):
    one = lambda n: table(s, d, n).select("video_id").where("video_id is not null")
    return splits.difference(one("videos"), one("build_splits"), one("val_outputs_all"))


@query("split_mixed_videos", "select video_id, count(distinct split) as splits from build_splits where video_id is not null and split is not null group by 1 having count(distinct split) > 1")
def _(s, d):
    return splits.mixed_videos(caps(s, d))


@query("split_official", "select row_id, split_hint as split from build_splits where split_hint in ('train', 'val', 'test')")
def _(s, d):
    return splits.official_split(caps(s, d)).select("row_id", "split")


@query("split_by_number", "select video_id, case when n < 6513 then 'train' when n < 7010 then 'val' else 'test' end as split from (select video_id, cast(regexp_extract(video_id, '^video([0-9]+)$', 1) as bigint) as n from videos where regexp_full_match(video_id, 'video[0-9]+'))")
def _(s, d):
    v = table(s, d, "videos").where(F.col("video_id").rlike("^video[0-9]+$"))
    return v.select("video_id", splits.range_split(F.regexp_extract("video_id", "([0-9]+)$", 1).cast("bigint")).alias("split"))


@query("split_by_member", "select v.video_id, case when t.video_id is not null then 'test' when r.video_id is not null then 'train' else 'unused' end as split from videos v left join (select distinct video_id from val_outputs_all) t on v.video_id = t.video_id left join (select distinct video_id from base) r on v.video_id = r.video_id")
def _(s, d):
    return splits.member_split(table(s, d, "videos").select("video_id"), "video_id", table(s, d, "val_outputs_all"), table(s, d, "base"))


@query("split_random_caption", "select video_id, arg_min(row_id, (md5('42|0|' || row_id), row_id)) as row_id from build_splits where video_id is not null group by 1")
def _(s, d):
    return captions.random_caption(caps(s, d))


# -- index and catalogue ------------------------------------------------------------------------
@query("index_upsert", "select vec_id as id, label + 100 as label from embeddings where vec_id % 3 = 0 union all select vec_id, label from embeddings where vec_id % 3 <> 0")
def _(s, d):
    g = gallery(s, d).select("id", "label")
    return vector_index.upserted(g, g.where("id % 3 = 0").withColumn("label", F.col("label") + 100))


@query("index_upsert_repeated", """with n as (select vec_id as id, label + 100 * k as label, k from embeddings, (select unnest([1, 2, 3]) as k) where vec_id % 3 = 0 and (k < 3 or vec_id % 2 = 0)), l as (select id, arg_max(label, k) as label from n group by 1)
    select id, label from l union all select vec_id as id, label from embeddings where vec_id % 3 <> 0""")
def _(s, d):
    g = gallery(s, d).select("id", "label")
    new = g.where("id % 3 = 0").withColumn("k", F.explode(F.array(*map(F.lit, (3, 1, 2))))).where("k < 3 or id % 2 = 0").withColumn("label", F.col("label") + 100 * F.col("k"))
    return vector_index.upserted(g, new, order="k")


@query("index_delete", "select vec_id as id from embeddings where vec_id % 4 <> 0")
def _(s, d):
    g = gallery(s, d).select("id")
    return vector_index.deleted(g, g.where("id % 4 = 0"))


@query("index_counts", "select label as model_id, vec_id % 3 as collection_id, count(*) as n from embeddings group by 1, 2")
def _(s, d):
    v = gallery(s, d).select(F.col("label").alias("model_id"), (F.col("id") % 3).alias("collection_id"))
    return vector_index.index_counts(v).select("model_id", F.explode("collections").alias("collection_id", "n"))


@query("index_collections", "select collection_id, count(*) as videos, count_if(lower(trim(status)) = 'ready') as ready from videos where collection_id is not null group by 1")
def _(s, d):
    return vector_index.collection_counts(table(s, d, "videos"))


@query("index_cascade", "select row_id from build_splits where video_id is null or video_id not in (select video_id from videos where collection_id = 'demo')")
def _(s, d):
    gone = table(s, d, "videos").where("collection_id = 'demo'")
    return vector_index.cascade({"c": caps(s, d)}, gone)["c"].select("row_id")


@query("index_latest_jobs", "select o_custkey as job_id, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) as status, max(o_orderdate) as updated_at from orders group by 1")
def _(s, d):
    o = table(s, d, "orders").select(F.col("o_custkey").alias("job_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("progress"), F.col("o_orderdate").alias("updated_at"))
    return vector_index.latest_jobs(o).select("job_id", "status", "updated_at")


@query("index_import", "select video_id, coalesce(title, video_id) as title, case when lower(status) = 'ready' then 'ready' else 'queued' end as status, case when lower(status) = 'ready' then 'skip' when status is null then 'insert' else 'update' end as action from videos")
def _(s, d):
    v = table(s, d, "videos")
    return vector_index.imported(v.select("video_id", F.concat("video_id", F.lit(".mp4")).alias("path")), v.select("video_id", F.coalesce("title", "video_id").alias("title")), v.select("video_id", "status"))


# -- benchmark view -----------------------------------------------------------------------------
# A small literal table of results with the shapes that the view has to handle.
RESULT_ROWS = [
    ("CLIP", "zero_shot", "MSVD", "R@1", 0.33), ("CLIP", "zero_shot", "MSVD", "MedianRank", 3.0), ("CLIP", "zero_shot", "MSVD", "avg_query_latency_sec", 0.00898), ("CLIP", "zero_shot", "MSVD", "Top1Accuracy", 0.33),
    ("CLIP", "fine_tuned", "MSVD", "R@1", 0.366), ("CLIP", "fine_tuned", "MSVD", "MedianRank", 2.0), ("CLIP", "fine_tuned", "MSRVTT", "R@1", 0.34), ("SpanNet", "", "MSR-VTT", "MRR", 0.32), ("SpanNet", "", "MSR-VTT", "R@1", 0.216),
]
RULES = [{"match": {"model": "clip", "dataset": "msvd"}, "protocol": "all captions", "notes": "8 frames"}, {"match": {"model": "CLIP"}, "protocol": "one caption", "notes": ""}]


def _results(s: SparkSession) -> DataFrame:
    rows = [(i, *r) for i, r in enumerate(RESULT_ROWS)]
    return s.createDataFrame(rows, "ordinal int, model string, variant string, dataset string, metric_name string, metric_value double")


_RES = "r as (select * from (values " + ", ".join(f"({i}, '{a}', '{b}', '{c}', '{m}', {v}::double)" for i, (a, b, c, m, v) in enumerate(RESULT_ROWS)) + ") t(ordinal, model, variant, dataset, metric_name, metric_value))"
_VIEW = f"""{_RES}, v as (select ordinal, case when variant <> '' then model || ' (' || replace(variant, '_', '-') || ')' else model end as model, case dataset when 'MSRVTT' then 'MSR-VTT' else dataset end as dataset,
    case when lower(model) = 'clip' and lower(dataset) = 'msvd' then 'all captions' when lower(model) = 'clip' then 'one caption' else '' end as protocol,
    case metric_name when 'avg_query_latency_sec' then 'latency_ms' when 'MedianRank' then 'MedR' when 'R@1' then 'R@1' when 'MRR' then 'MRR' end as metric, round(case metric_name when 'avg_query_latency_sec' then metric_value * 1000 else metric_value end, 6) as value,
    case when lower(model) = 'clip' and lower(dataset) = 'msvd' then '8 frames' else '' end as notes from r)"""


@query("bench_view", f"with {_VIEW} select * exclude (ordinal) from v where metric is not null")
def _(s, d):
    return benchmarks.benchmark_view(_results(s), RULES)


OWN_ROWS = [("zero_shot", "MSVD", "R@1", 0.33, "own", ""), ("zero_shot", "MSVD", "MRR", 0.4, "", "one run"), ("fine_tuned", "MSVD", "R@1", 0.36, None, None), ("fine_tuned", "MSRVTT", "R@1", 0.34, "", "")]
_OWN = "o as (select * from (values " + ", ".join(f"({i}, '{v}', '{x}', '{m}', {y}::double, {'null' if p is None else repr(p)}, {'null' if n is None else repr(n)})" for i, (v, x, m, y, p, n) in enumerate(OWN_ROWS)) + """) t(ordinal, variant, dataset, metric, value, own_protocol, own_notes)),
    v as (select ordinal, 'CLIP (' || replace(variant, '_', '-') || ')' as model, replace(dataset, 'MSRVTT', 'MSR-VTT') as dataset, metric, value, coalesce(nullif(own_protocol, ''), case when dataset = 'MSVD' then 'all captions' else 'one caption' end) as protocol, coalesce(nullif(own_notes, ''), case when dataset = 'MSVD' then '8 frames' else '' end) as notes from o)"""


def _own_results(s: SparkSession) -> DataFrame:
    rows = [(i, "CLIP", *r) for i, r in enumerate(OWN_ROWS)]
    return s.createDataFrame(rows, "ordinal int, model string, variant string, dataset string, metric_name string, metric_value double, protocol string, notes string")


@query("bench_own_notes", f"with {_OWN} select model, dataset, protocol, metric, value, notes from v")
def _(s, d):
    return benchmarks.benchmark_view(_own_results(s), RULES)


@query("bench_wide_notes", f"""with {_OWN} select model, dataset, coalesce(arg_min(protocol, ordinal) filter (protocol <> ''), '') as protocol, coalesce(arg_min(notes, ordinal) filter (notes <> ''), '') as notes, max(case when metric = 'R@1' then value end) as "R@1", max(case when metric = 'MRR' then value end) as MRR from v group by 1, 2""")
def _(s, d):
    view = benchmarks.benchmark_view(_own_results(s), RULES)
    places = s.createDataFrame([("CLIP (zero-shot)", "MSVD", "R@1", 0), ("CLIP (zero-shot)", "MSVD", "MRR", 1), ("CLIP (fine-tuned)", "MSVD", "R@1", 2), ("CLIP (fine-tuned)", "MSR-VTT", "R@1", 3)], "model string, dataset string, metric string, o int")
    return benchmarks.wide_with_notes(view.join(places, ["model", "dataset", "metric"]), ["R@1", "MRR"], "o")


@query("bench_best", f"with {_VIEW} select model, dataset, metric, value, value = case when metric in ('MedR', 'MeanR', 'latency_ms') then min(value) over (partition by dataset, metric) else max(value) over (partition by dataset, metric) end as best from v where metric is not null")
def _(s, d):
    return benchmarks.best_marked(benchmarks.benchmark_view(_results(s), RULES)).select("model", "dataset", "metric", "value", "best")


@query("bench_wide", f"with {_VIEW} select model, dataset, max(case when metric = 'R@1' then value end) as \"R@1\", max(case when metric = 'MedR' then value end) as MedR, max(case when metric = 'latency_ms' then value end) as latency_ms from v where metric is not null group by 1, 2")
def _(s, d):
    return benchmarks.wide(benchmarks.benchmark_view(_results(s), RULES).withColumn("o", F.lit(0)), ["R@1", "MedR", "latency_ms"], "o")


@query("bench_filtered", f"with {_VIEW} select model, metric, value from v where metric is not null and lower(dataset) = 'msvd' and contains(lower(model), 'fine')")
def _(s, d):
    return benchmarks.benchmark_view(_results(s), RULES, "msvd", "FINE").select("model", "metric", "value")


# -- streams ------------------------------------------------------------------------------------
@query("stream_windowed_counts", "select time_bucket(interval '5 minutes', ts) as window_start, event_type as model, count(*) as n from events group by 1, 2")
def _(s, d):
    e = table(s, d, "events").select("ts", F.col("event_type").alias("model"), F.col("value").alias("ms"))
    return jobs.windowed_latency(e).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "model", "n")


@query("stream_latency_quantiles", """with e as (select time_bucket(interval '5 minutes', ts) as window_start, event_type as model, value, row_number() over (partition by time_bucket(interval '5 minutes', ts), event_type order by value) as r, count(*) over (partition by time_bucket(interval '5 minutes', ts), event_type) as n from events where value is not null)
    select window_start, model, n, min(value) filter (r >= 0.5 * n) as p50, min(value) filter (r >= 0.95 * n) as p95 from e group by 1, 2, 3""")
def _(s, d):
    e = _event_stream(s, d).where("value is not null").select("ts", F.col("event_type").alias("model"), F.col("value").alias("ms"))
    out = shared_dir(s)
    write = lambda batch, _: batch.write.mode("overwrite").parquet(f"{out}/rows")
    jobs.each_batch(jobs.windowed_latency(e), write, f"{out}/checkpoint", "complete")
    return s.read.parquet(f"{out}/rows").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("stream_sessions", """
    with o as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) >= interval '30 minutes' then 1 when lag(ts) over (partition by user_id order by ts) is null then 1 else 0 end as new from events),
    g as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as g from o) select user_id, min(ts) as start_ts, max(ts) + interval '30 minutes' as end_ts, count(*) as n from g group by user_id, g""")
def _(s, d):
    x = jobs.sessions(table(s, d, "events").select("ts", "user_id"))
    return x.select("user_id", F.col("start").cast("timestamp_ntz").alias("start_ts"), F.col("end").cast("timestamp_ntz").alias("end_ts"), "n")


_LIMITED = """with recursive e as (select cast(user_id as varchar) as client, epoch_us(ts) / 1e6 as t, row_number() over (partition by user_id order by ts) as i from events),
    w as (select client, i, t, [t] as recent, true as allowed from e where i = 1 union all select client, i, t, case when len(f) < 2 then list_append(f, t) else f end, len(f) < 2 from (select e.client, e.i, e.t, list_filter(w.recent, lambda r: e.t - r <= 3600.0) as f from w join e on e.client = w.client and e.i = w.i + 1))
    select client, t, allowed from w"""


@query("stream_rate_limit", _LIMITED)
def _(s, d):
    return jobs.rate_limited_batch(_hits(table(s, d, "events")), 2, 3600.0)


def _hits(e: DataFrame) -> DataFrame:
    return e.select(F.col("user_id").cast("string").alias("client"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))


def _event_stream(s: SparkSession, d: str) -> DataFrame:
    """The events as a stream of one file."""
    return s.readStream.schema(table(s, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)


@query("stream_rate_limit_stateful", _LIMITED)
def _(s, d):
    out = shared_dir(s)
    jobs.run_available(jobs.rate_limited(_hits(_event_stream(s, d)), 2, 3600.0), f"{out}/rows", f"{out}/checkpoint")
    return s.read.schema("client string, t double, allowed boolean").parquet(f"{out}/rows")


# -- joins over the star schema -----------------------------------------------------------------
@query("scan_sentences_with_videos", "select b.row_id, v.title, v.collection_id from build_splits b join videos v on b.video_id = v.video_id")
def _(s, d):
    return caps(s, d).select("row_id", "video_id").join(table(s, d, "videos").select("video_id", "title", "collection_id"), "video_id").select("row_id", "title", "collection_id")


@query("scan_orders_by_nation", "select n_name, r_name, count(*) as orders, round(sum(o_totalprice), 2) as total from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2")
def _(s, d):
    t = lambda n: table(s, d, n)
    j = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("n_name", "r_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("scan_late_lines", "select l_shipmode, n from (select l_returnflag as l_shipmode, count(*) as n from lineitem join orders on l_orderkey = o_orderkey where l_shipdate > o_orderdate + interval '30 days' group by 1)")
def _(s, d):
    j = table(s, d, "lineitem").join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).where("l_shipdate > o_orderdate + interval '30' day")
    return j.groupBy(F.col("l_returnflag").alias("l_shipmode")).agg(F.count("*").alias("n"))
