"""The registered queries of this package and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .align import align_tokens
from .common import new_folder
from .conversations import repair_conversations
from .decontam import find_leaks
from .exact_dedup import content_sort
from .licenses import scan_licenses
from .lines import line_digest
from .mixing import mix_digest
from .ngram_join import ngram_join
from .quality import score_quality
from .tokens import token_files
from .toxicity import score_toxicity
from .url_filter import judge_urls
from .warc import archive_digest, read_archive, write_archive


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"), new_folder(spark, "tokens"), null_ids=True)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort(table(spark, sf_dir, "documents"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_digest(table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), path)
    return archive_digest(read_archive(spark, path))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_digest(table(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(table(spark, sf_dir, "documents"))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op9_quality": op9_quality,
    "op10_toxicity": op10_toxicity,
    "op2_decontamination": op2_decontamination,
    "op3_licenses": op3_licenses,
    "op4_token_ids": op4_token_ids,
    "op1_ngram_join": op1_ngram_join,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_mix_sources": op6_mix_sources,
    "op7_url_filter": op7_url_filter,
    "op8_warc": op8_warc,
    "op11_line_dedup": op11_line_dedup,
    "op12_alignment": op12_alignment,
    "op13_conversations": op13_conversations,
}

ORACLE_SQL = {
    "op5_exact_dedup": """
select doc_id, max(doc_id) over g as keep_id, cast(count(*) over g as bigint) as group_size,
 doc_id = max(doc_id) over g as kept, sha256(coalesce(text, '')) as text_sha256
from documents window g as (partition by coalesce(text, ''))""",
    "op6_mix_sources": r"""
with sized as (
 select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size from documents),
per as (
 select source, sum(size)::bigint as source_size,
  ((row_number() over (order by source nulls last) - 1) % 3 + 1)::bigint as weight
 from sized group by source),
run as (
 select *, (select sum(source_size) from per) - coalesce(sum(3 * source_size) over before, 0) as top,
  (select sum(weight) from per) - coalesce(sum(weight) over before, 0) as bottom
 from per window before as (order by source_size::double / weight, source nulls last rows between unbounded preceding and 1 preceding)),
level as (
 select top::double / bottom::double as share from run
 where 3 * source_size >= top::double / bottom::double * weight order by source_size::double / weight, source nulls last limit 1),
goal as (
 select per.*, case when 3 * source_size < share * weight then (3 * source_size)::double else share * weight end as target from per, level),
drawn as (
 select doc_id, size, source_size, target,
  case when source_size > 0 then least(target / source_size, 3.0::double) else 0.0::double end as rate,
  ('0x' || substr(md5('0|' || coalesce(doc_id::varchar, '')), 1, 13))::bigint / 4503599627370496.0::double as u
 from sized join goal on sized.source is not distinct from goal.source)
select doc_id, size, source_size, target,
 size * (floor(rate)::bigint + case when u < rate - floor(rate) then 1 else 0 end) as taken
from drawn""",
    "op7_url_filter": r"""
with a as (
 select page_id, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
b as (
 select page_id, coalesce(regexp_extract(rest, '^[^/?#]*', 0), '') as raw, coalesce(rest, '') as rest from a),
c as (
 select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*', 0) as path from b),
r(verdict, rhost, rpath) as (
 values ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
f as (
 select page_id, host, path, rhost || rpath as rule, verdict,
  row_number() over (partition by page_id, host, path order by length(rhost || rpath) desc nulls last) as k
 from c left join r on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath))
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from f where k = 1""",
    "op8_warc": """
with p as (
 select page_id, coalesce(html, '') as html, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes from pages),
g as (select *, max(page_id) over (partition by html) as last from p)
select page_id, payload_bytes, sha1(html) as payload_digest,
 case when payload_bytes >= 1000 and page_id <> last then 'revisit' else 'response' end as record_type,
 case when payload_bytes >= 1000 and page_id <> last then last end as refers_to
from g""",
    "op11_line_dedup": r"""
with d as (
 select row_number() over () as nth, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
l as (select nth, doc_id, unnest(lines) as line, unnest(range(len(lines))) as place from d),
k as (
 select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
m as (select *, min(doc_id) over (partition by key) as least from k),
f as (
 select *, length(key) >= 10 and least is not null and (doc_id is null or doc_id > least) as gone from m)
select doc_id, count(*)::bigint as n_lines, count(*) filter (gone)::bigint as n_dropped,
 sha256(coalesce(string_agg(line, chr(10) order by place) filter (not gone), '')) as kept_sha256
from f group by nth, doc_id""",
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
