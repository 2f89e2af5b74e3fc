"""The queries of the training-data operators: each applies one to its whole table and derives the agreed columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siglake.llm.brown import score_texts
from siglake.llm.common import held_out, table
from siglake.llm.decontam import find_leaks
from siglake.llm.html_text import extract_text
from siglake.llm.jaccard_join import link_classes
from siglake.llm.language import identify_language, learn_profiles
from siglake.llm.minhash_order import edit_probe
from siglake.llm.mixing import mix_sources
from siglake.llm.quality import learn_quality, score_quality
from siglake.llm.sharding import shard_documents
from siglake.llm.urls import judge_urls


def op1_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(table(spark, sf_dir, "documents"), 16)
    text = F.coalesce("text", F.lit(""))
    return placed.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.lit("key").alias("law"),
        F.col("shard").cast("int"), F.col("slot").cast("long"), F.col("grown_shard").cast("int"),
    )


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, aside = table(spark, sf_dir, "documents"), held_out(F.col("doc_id"), 4, 2)
    ranking = learn_quality(docs, table(spark, sf_dir, "labels"), ~aside)
    return score_quality(docs.select("doc_id", "text"), ranking).select("doc_id", aside.alias("held_out"), "score", "predicted")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, aside = table(spark, sf_dir, "documents"), held_out(F.col("doc_id"), 4, 2)
    profiles = learn_profiles(docs, ~held_out(F.col("doc_id"), 4, 2))
    return identify_language(docs.select("doc_id", "text"), profiles).select("doc_id", aside.alias("held_out"), "lang_pred", "score")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"), held_out(F.col("doc_id"), 10, 0))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_classes(table(spark, sf_dir, "documents"), n=3, num=90, den=100).select("doc_id", F.col("n_shingles").cast("long"), "component_id")


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_probe(table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op10_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_shards, op2_quality, op3_language, op4_decontamination, op5_language_model, op6_main_text, op7_jaccard_join, op8_order_minhash, op9_url_filter, op10_mixture)}


_URLS = r"""
with recursive seen as (
  select page_id, html, url, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') as path,
    regexp_extract(url, '^.*?://[^/?#]*([^#]*)', 1, 's') as rest
  from pages),
nodes as (select *, case when host <> '' then host || case when rest = '' then '/' else rest end end as node from seen),
rules(h, p, v) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
best as (
  select host, path, max_by(h || p, length(h || p)) as rule, max_by(v, length(h || p)) as v
  from (select distinct host, path from nodes) join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p)
  group by host, path),
judged as (select nodes.*, rule, v from nodes left join best using (host, path)),
tags as (select node, url, unnest(regexp_extract_all(html, '(<(?:link|meta)\b[^>]*>)', 1, 'is')) as tag from nodes where node is not null),
targets as (
  select node, url, replace(case when regexp_matches(tag, '\brel\s*=\s*["'']?canonical\b', 'i') then regexp_extract(tag, '\bhref\s*=\s*["'']?([^"''\s>]+)', 1, 'is')
    when regexp_matches(tag, '\bhttp-equiv\s*=\s*["'']?refresh\b', 'i') then regexp_extract(tag, '\burl\s*=\s*["'']?([^"''\s>;]+)', 1, 'is') end, '&amp;', '&') as t
  from tags),
whole as (
  select node, case when contains(t, '://') then t when starts_with(t, '//') then 'http:' || t
    when starts_with(t, '/') then regexp_extract(url, '^(.*?://[^/?#]*)', 1, 's') || t
    else regexp_replace(regexp_extract(url, '^(.*?://[^/?#]*(?:[^?#]*/)?)', 1, 's'), '/$', '') || '/' || t end as u
  from targets where t <> ''),
ends as (
  select node as a, translate(regexp_extract(u, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ||
    case when regexp_extract(u, '^.*?://[^/?#]*([^#]*)', 1, 's') = '' then '/' else regexp_extract(u, '^.*?://[^/?#]*([^#]*)', 1, 's') end as b
  from whole),
links as (select a, b from ends union select b, a from ends),
ends_of as (select distinct a as node, regexp_extract(a, '^([^/?#]*)', 1, 's') as h0, regexp_extract(a, '^[^/?#]*([^?#]*)', 1, 's') as p0 from links),
bad as (
  select node from ends_of join rules on (h0 = h or ends_with(h0, '.' || h)) and starts_with(p0, p)
  group by node having max_by(v, length(h || p)) = 'block'),
reached as (
  select node from bad
  union
  select links.b from reached join links on reached.node = links.a)
select page_id, host, path, rule, coalesce(v, case when node in (select node from reached) then 'block' end, 'allow') as verdict from judged
"""

_MIXTURE = r"""
with sized as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size,
    coalesce(substr(md5(cast(doc_id as varchar)), 1, 1) >= '8', false) as falls
  from documents),
sums as (select source, cast(sum(size) as bigint) as source_size from sized group by source),
ranked as (select *, cast((row_number() over (order by source nulls last) - 1) % 3 + 1 as double) as weight from sums),
capped as (select *, source_size * 3.0::double as cap, source_size * 3.0::double / weight as ratio from ranked),
levels as (
  select *, row_number() over o as place,
    (cast(sum(source_size) over () as double) - coalesce(sum(cap) over (o rows between unbounded preceding and 1 preceding), 0))
    / (sum(weight) over () - coalesce(sum(weight) over (o rows between unbounded preceding and 1 preceding), 0)) as level
  from capped window o as (order by ratio, source nulls last)),
found as (select coalesce(arg_min(level, place) filter (where ratio >= level), max(ratio)) as level from levels),
share as (
  select source, source_size, least(found.level * weight, cap) as target,
    cast(coalesce(floor(least(found.level * weight, cap) / nullif(source_size, 0) * 1099511627776), 0) as hugeint) as rate,
    cast(('0x' || substr(md5('17|' || case when source is null then 'n|' else 's|' || source end), 1, 8))::bigint as hugeint) * 256 as start
  from levels, found),
lined as (select *, row_number() over (partition by source order by falls, case when falls then -size else size end, doc_id) - 1 as rank from sized)
select doc_id, size, source_size, target,
  cast((((rank + 1)::hugeint * rate + start) // 1099511627776 - (rank::hugeint * rate + start) // 1099511627776) * size as bigint) as taken
from lined join share on lined.source is not distinct from share.source
"""


def oracle_sql() -> dict[str, str]:
    return {"op9_url_filter": _URLS, "op10_mixture": _MIXTURE}
