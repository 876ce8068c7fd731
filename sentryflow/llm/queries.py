"""The ten registered queries and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sentryflow.llm import ann, decontaminate, language_id, line_dedup, mixing, near_dedup, packing, pii, repeats, warc
from sentryflow.staging import table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.normalise(warc.write_archives(table(spark, sf_dir, "pages")))
    return warc.read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.read_matrix(packing.write_packed(table(spark, sf_dir, "documents")))


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.repeated_passages(table(spark, sf_dir, "documents"))
    words = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    label = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["stop"].cast("string"))), ",")
    return found.select("doc_id", "n_words", words.alias("n_repeated"), label.alias("spans"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_digests(pii.find_spans(table(spark, sf_dir, "documents")))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out())
    profiles = language_id.fit(docs.where(~F.col("held_out")))
    return language_id.predict(docs, profiles, carry=["doc_id", "held_out"])


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.search(rows, rows.where(F.col("vec_id") % 50 == 0), k=5)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start_shingle", "similarity")


QUERIES = {
    f.__name__: f
    for f in (op1_warc, op2_packing, op3_repeats, op4_pii, op5_language, op6_near_dedup, op7_neighbours, op8_mixing, op9_line_dedup, op10_decontaminate)
}

_ABC = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORDS = f"list_filter(string_split_regex(translate(coalesce(text, ''), {_ABC}), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

ORACLES = {
    "op1_warc": """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha256(coalesce(html, '')) as d from pages),
     f as (select *, min(page_id) over (partition by d) as first_id from p)
select page_id, cast(n as bigint) as payload_bytes, d as payload_digest,
       case when n >= 100 and page_id > first_id then 'revisit' else 'response' end as record_type,
       case when n >= 100 and page_id > first_id then first_id end as refers_to
from f""",
    "op3_repeats": f"""
with w as (select doc_id, {_WORDS} as ws from documents),
     g as (select doc_id, unnest(range(0, len(ws) - 49)) as s, unnest(list_transform(range(1, len(ws) - 48), lambda i: md5(array_to_string(ws[i:i + 49], ' ')))) as h from w where len(ws) >= 50),
     r as (select doc_id, s from g where h in (select h from g group by h having count(*) > 1)),
     e as (select *, case when s - lag(s) over (partition by doc_id order by s) <= 50 then 0 else 1 end as edge from r),
     i as (select *, sum(edge) over (partition by doc_id order by s) as isle from e),
     t as (select doc_id, min(s) as a, max(s) + 50 as z from i group by doc_id, isle),
     d as (select doc_id, sum(z - a) as k, string_agg(cast(a as varchar) || ':' || cast(z as varchar), ',' order by a) as spans from t group by doc_id)
select w.doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(k, 0) as bigint) as n_repeated, coalesce(spans, '') as spans
from w left join d using (doc_id)""",
    "op6_near_dedup": f"""
with recursive w as (select doc_id, {_WORDS} as ws from documents),
     s as (select distinct doc_id, unnest(case when len(ws) = 0 then cast([] as varchar[]) when len(ws) < 5 then [array_to_string(ws, ' ')]
                                          else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) end) as g from w),
     n as (select doc_id, count(*) as n from s group by doc_id),
     p as (select a.doc_id as x, b.doc_id as y, count(*) as k from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
     l as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * k >= 85 * (a.n + b.n - k)),
     both_ways as (select x, y from l union all select y, x from l),
     reach(doc_id, other) as (select doc_id, doc_id from documents union select r.doc_id, b.y from reach r join both_ways b on b.x = r.other),
     c as (select doc_id, min(other) as component_id from reach group by doc_id)
select c.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, component_id, c.doc_id = component_id as kept
from c left join n using (doc_id)""",
    "op8_mixing": """
with d as (select doc_id, source, case when text is null then 0 else len(list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) end as size,
                  md5(coalesce(cast(doc_id as varchar), '')) as ord from documents),
     s as (select source, sum(size) as source_size from d group by source),
     w as (select *, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight, 2 * source_size as cap from s),
     f as (select *, 150 * sum(source_size) over () - 100 * coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as room,
                  sum(weight) over () - coalesce(sum(weight) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as wleft from w),
     c as (select *, cap * 100 * wleft <= weight * room as clamped from f),
     v as (select room as vroom, wleft as vwleft from c where not clamped order by cap / weight, source nulls last limit 1),
     t as (select source, source_size, case when clamped then cast(cap as double) else cast(weight * vroom as double) / cast(100 * vwleft as double) end as target from c left join v on true),
     r as (select d.*, t.source_size, t.target,
                  coalesce(sum(size) over (partition by d.source order by ord, d.doc_id nulls first, size rows between unbounded preceding and 1 preceding), 0) as ahead,
                  case when t.source_size > 0 then cast(floor(target / t.source_size) as bigint) else 0 end as whole
           from d join t on d.source is not distinct from t.source)
select doc_id, cast(size as bigint) as size, cast(source_size as bigint) as source_size, target,
       cast(case when size = 0 then 0 else size * (whole + case when whole < 2 and 2 * ahead + size <= 2 * (target - whole * source_size) then 1 else 0 end) end as bigint) as taken
from r""",
    "op9_line_dedup": f"""
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
     l as (select doc_id, unnest(ls) as line, unnest(range(0, len(ls))) as pos from d),
     k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {_ABC}) as key from l),
     g as (select key, max(doc_id) as owner from k where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
     m as (select k.doc_id, k.pos, k.line, g.owner is not null and k.doc_id <> g.owner as gone from k left join g on k.key = g.key)
select doc_id, count(*) as n_lines, cast(count(*) filter (where gone) as bigint) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from m group by doc_id""",
    "op10_decontaminate": """
with dw as (select doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') as ws from documents),
     iw as (select item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') as ws from benchmark),
     ds as (select doc_id, len(ws) - 4 as m, unnest(range(0, len(ws) - 4)) as pos, unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) as g from dw where len(ws) >= 5),
     iall as (select item_id, len(ws) - 4 as n, unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) as g from iw where len(ws) >= 5),
     ic as (select item_id, n, g, count(*) as c from iall group by item_id, n, g),
     h as (select doc_id, item_id, n as w, n, c, g, unnest(range(greatest(pos - n + 1, 0), least(pos, m - n) + 1)) as s from ds join ic using (g) where m >= n
           union all select doc_id, item_id, m as w, n, c, g, 0 as s from ds join ic using (g) where m < n),
     x as (select doc_id, item_id, w, n, s, g, least(count(*), c) as k from h group by doc_id, item_id, w, n, s, g, c),
     y as (select doc_id, item_id, s, cast(sum(k) as double) / cast(w + n - sum(k) as double) as similarity from x group by doc_id, item_id, w, n, s),
     z as (select *, row_number() over (partition by doc_id, item_id order by similarity desc, s) as r from y where similarity >= 0.8)
select doc_id, item_id, cast(s as bigint) as start_shingle, similarity from z where r = 1""",
}
