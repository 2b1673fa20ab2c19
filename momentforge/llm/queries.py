"""The training-data queries and, where SQL can state them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import cut, table
from . import broken_pairs, cross_split, format_copies, group_splits, shared_spans, similar_vectors, source_mix, target_sample, tokens, top_n

Query = Callable[[SparkSession, str], DataFrame]



def _exact_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = cut(similar_vectors.window_vectors(table(spark, sf_dir, "base")))
    return similar_vectors.nearest_exact(windows, similar_vectors.query_set(windows))


def _sampler(spark: SparkSession, sf_dir: str) -> target_sample.TargetSample:
    return target_sample.TargetSample(table(spark, sf_dir, "build_splits"), table(spark, sf_dir, "category_targets"))


QUERIES: dict[str, Query] = {
    "p1_found": lambda s, d: group_splits.leaking_rows(table(s, d, "build_splits"), table(s, d, "videos")),
    "p1_splits": lambda s, d: group_splits.assign_splits(table(s, d, "build_splits"), table(s, d, "videos")),
    "p2_found": lambda s, d: format_copies.copies_of(table(s, d, "build_splits")),
    "p2_records": lambda s, d: format_copies.collapse(table(s, d, "build_splits")),
    "p3_found": lambda s, d: top_n.top_n(table(s, d, "base"), "video_id", "window_id", "stage1_score", 3).select("video_id", "window_id"),
    "p3_ranked": lambda s, d: top_n.top_n(table(s, d, "base"), "video_id", "window_id", "stage1_score", 3),
    "p4_found": lambda s, d: similar_vectors.near_window_pairs(table(s, d, "base")),
    "p4_nearest": lambda s, d: similar_vectors.nearest(cut(similar_vectors.window_vectors(table(s, d, "base")))),
    "p4_exact": lambda s, d: _exact_neighbours(s, d),
    "p4_recall": lambda s, d: similar_vectors.measured_recall(cut(similar_vectors.window_vectors(table(s, d, "base")))),
    "p5_found": lambda s, d: cross_split.overlapping_pairs(table(s, d, "build_splits")),
    "p5_report": lambda s, d: cross_split.overlap_report(table(s, d, "build_splits")),
    "p6_found": lambda s, d: broken_pairs.broken_pairs(table(s, d, "val_outputs_all"), known=()),
    "p7_found": lambda s, d: _sampler(s, d).report().where("not reachable").select("category_id"),
    "p7_report": lambda s, d: _sampler(s, d).report(),
    "p7_sample": lambda s, d: _sampler(s, d).draw()[0],
    "p8_ids": lambda s, d: tokens.encode(table(s, d, "documents")),
    "p8_decoded": lambda s, d: tokens.decode(tokens.encode(table(s, d, "documents"))),
    "p9_found": lambda s, d: source_mix.starved_sources(table(s, d, "documents"), table(s, d, "mix_targets")),
    "p9_mix": lambda s, d: source_mix.mix(table(s, d, "documents"), table(s, d, "mix_targets"))[0],
    "p9_report": lambda s, d: source_mix.mix(table(s, d, "documents"), table(s, d, "mix_targets"))[1],
    "p10_found": lambda s, d: shared_spans.sharing_documents(table(s, d, "documents")),
    "p10_shared": lambda s, d: shared_spans.shared_parts(table(s, d, "documents")),
}

_CLIP = r"""nullif(lower(regexp_replace(regexp_replace(trim(regexp_replace(trim({c}, chr(160)||chr(9)||chr(10)||chr(13)||' '), '^.*[/\\]', '', 's'), chr(160)||chr(9)||chr(10)||chr(13)||' '), '\.(mp4|avi|mkv)$', '', 'i'), '[^\p{{L}}\p{{N}}]', '', 'g')), '')"""
_BASE = r"""trim(regexp_replace(trim(regexp_replace(trim({c}, chr(160)||chr(9)||chr(10)||chr(13)||' '), '^.*[/\\]', '', 's'), chr(160)||chr(9)||chr(10)||chr(13)||' '), '\.(mp4|avi|mkv)$', '', 'i'), chr(160)||chr(9)||chr(10)||chr(13)||' ')"""
_SPLIT = r"""case lower(trim(split, chr(160)||chr(9)||chr(10)||chr(13)||' ')) when 'train' then 'train' when 'test' then 'test' when 'val' then 'val' when 'validation' then 'val' end"""
_KEY = r"""coalesce(nullif(regexp_extract({b}, '^([A-Za-z0-9_-]{{11}})_[0-9]+_[0-9]+$', 1), ''), nullif(regexp_extract({u}, '[?&]v=([A-Za-z0-9_-]{{11}})', 1), ''), nullif(regexp_extract({u}, '/([A-Za-z0-9_-]{{11}})([/?#&]|$)', 1), ''))"""

_FIELDS = """case when attrs is not null then array_to_string(list_transform(list_sort(json_keys(attrs)), lambda k: k || '=' ||
    case when json_type(attrs, '$."' || k || '"') in ('UBIGINT', 'BIGINT', 'DOUBLE') then 'n' || cast(cast(json_extract(attrs, '$."' || k || '"') as double) as varchar) else cast(json_extract(attrs, '$."' || k || '"') as varchar) end), chr(31)) end"""
_P2 = f"""with r as (select row_id, {_CLIP.format(c='video_id')} as clip, lower(regexp_replace(caption, '[^\\p{{L}}\\p{{N}}]', '', 'g')) as txt, {_FIELDS} as fields from build_splits where caption is not null),
        g as (select *, min(row_id) over (partition by clip, txt, fields) as first_row_id from r where txt <> '')"""

_P5 = f"""with r as (select row_id, {_SPLIT} as sp, source, list_distinct(regexp_extract_all(lower(caption), '[\\p{{L}}\\p{{N}}]+')) as w from build_splits where caption is not null),
        k as (select * from r where sp is not null and len(w) >= 8),
        j as (select a.row_id as t, b.row_id as e, b.sp as split, b.source, len(list_intersect(a.w, b.w)) as n, len(a.w) + len(b.w) as m from k a, k b where a.sp = 'train' and b.sp <> 'train' and len(a.w) >= 0.75 * len(b.w) and len(b.w) >= 0.75 * len(a.w)),
        o as (select * from j where n >= 0.75 * (m - n) - 1e-9)"""
_FINE = "len({r}) = 64 and len(list_filter({r}, lambda x: x is null or isnan(x) or isinf(x))) = 0"
_P4 = f"""with b as (select window_id, embedding as e, frame_features as f from base where window_id is not null),
        s as (select window_id, case when {_FINE.format(r='e')} and len(list_filter(e, lambda x: x <> 0)) > 0 then e end as e,
              case when len(f) > 0 and len(list_filter(f, lambda r: not coalesce({_FINE.format(r='r')}, false))) = 0 then list_transform(range(1, 65), lambda i: list_sum(list_transform(f, lambda r: r[i]::double))::float) end as m from b),
        u as (select window_id, any_value(coalesce(e, case when len(list_filter(m, lambda x: x <> 0)) > 0 then m end))::double[] as v from s where e is not null or len(list_filter(m, lambda x: x <> 0)) > 0 group by 1),
        c as (select a.window_id as x, b.window_id as y, round(list_cosine_similarity(a.v, b.v), 12) as c from u a, u b where a.window_id <> b.window_id),
        t as (select *, row_number() over (partition by x order by c desc, y) as r from c)"""

SQL: dict[str, str] = {
    "p4_found": f"{_P4} select distinct least(x, y) as window_id_a, greatest(x, y) as window_id_b from t where r <= 5 and c >= 0.9",
    "p5_found": f"{_P5} select least(t, e) as row_id_a, greatest(t, e) as row_id_b from o",
    "p5_report": f"{_P5} select split, source, count(*) as pairs, count(distinct e) as eval_rows from o group by 1, 2",
    "p1_found": f"""
        with r as (select row_id, {_CLIP.format(c='video_id')} as clip, {_SPLIT} as sp, {_KEY.format(b=_BASE.format(c='video_id'), u="''")} as own from build_splits),
        v as (select {_CLIP.format(c='video_id')} as clip, max({_KEY.format(b=_BASE.format(c='video_id'), u="coalesce(url, '')")}) as k from videos group by 1),
        o as (select clip, max(own) as own from r group by 1),
        s as (select r.row_id, r.sp, coalesce('key:' || coalesce(v.k, o.own), 'clip:' || r.clip) as src
              from r join o on r.clip = o.clip left join v on r.clip = v.clip where r.sp is not null)
        select row_id from s where src in (select src from s group by src having count(distinct sp) > 1)""",
    "p2_found": f"{_P2} select first_row_id, row_id from g where row_id <> first_row_id",
    "p2_records": f"{_P2} select first_row_id, count(*) as copies from g group by 1",
    "p3_found": """
        with w as (select video_id, window_id, max(stage1_score) as s from base
                   where video_id is not null and window_id is not null and stage1_score is not null and not isnan(stage1_score) group by 1, 2)
        select video_id, window_id from (select *, row_number() over (partition by video_id order by s desc, window_id) as r from w) where r <= 3""",
    "p3_ranked": """
        with w as (select video_id, window_id, max(stage1_score) as stage1_score from base
                   where video_id is not null and window_id is not null and stage1_score is not null and not isnan(stage1_score) group by 1, 2)
        select * from (select *, cast(row_number() over (partition by video_id order by stage1_score desc, window_id) as integer) as rank from w) where rank <= 3""",
    "p7_found": f"""
        with t as (select *, lower(trim(category_name)) as nm from category_targets),
        r as (select {_CLIP.format(c='video_id')} as clip, lower(trim(category, chr(160)||chr(9)||chr(10)||chr(13)||' ')) as c from build_splits where category is not null),
        n as (select clip, coalesce(a.category_id, b.category_id) as category_id from r
              left join t a on r.c = a.nm left join t b on regexp_full_match(r.c, '[0-9]{{1,9}}([.]0*)?') and b.category_id = try_cast(regexp_extract(r.c, '^[0-9]+') as integer)),
        k as (select clip, min(category_id) as category_id from n where category_id is not null and clip is not null group by 1),
        s as (select floor(count(*) / 2.0) as s from k)
        select t.category_id from t, s where (select count(*) from k where k.category_id = t.category_id) < greatest(ceil(t.target_share * s.s), t.min_videos)""",
    "p8_decoded": "select doc_id, coalesce(text, '') as text from documents",
    "p10_found": """
        with w as (select doc_id, unnest(range(1, length(text) - 158)) as p, text from documents where length(text) >= 160),
        h as (select doc_id, md5(substring(text, p, 160)) as m from w),
        g as (select m from h group by m having min(doc_id) < max(doc_id))
        select distinct doc_id from h where m in (select m from g)""",
    "p10_shared": """
        with w as (select doc_id, unnest(range(1, length(text) - 158)) as p, text from documents where length(text) >= 160),
        h as (select doc_id, p, md5(substring(text, p, 160)) as m from w), g as (select m from h group by m having min(doc_id) < max(doc_id)),
        c as (select doc_id, count(distinct place) as n from (select doc_id, unnest(range(p, p + 160)) as place from h where m in (select m from g)) group by 1)
        select d.doc_id, cast(coalesce(length(d.text), 0) as integer) as n_chars, cast(coalesce(c.n, 0) as integer) as shared_chars, case when length(d.text) > 0 then coalesce(c.n, 0) / length(d.text) else 0.0 end as shared_share
        from documents d left join c on d.doc_id = c.doc_id""",
}
