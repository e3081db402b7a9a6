"""The queries opN_<name> and pipeline, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, centroids, decontam, ftrl, hmm, html_text, langid, licenses, pii, quality, simhash, urls, vector_codes

BPE_FILE = "byte_bpe_50k.json"
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, public_tokenizers.path(BPE_FILE), keep_ids=False).drop("text")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).drop("text", "lang")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.contamination(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op6_hmm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text", "redacted")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).drop("text", "lang")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")


def op11_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ftrl.score(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")).drop("text")


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).drop("embedding")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")).drop("label")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op")}


OP1_SQL = """
with parts as (
  select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end rest from pages),
keys as (
  select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path from parts),
rules(h, p, v) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'allow'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
best as (
  select page_id, arg_max(h || p, length(h || p)) rule, arg_max(v, length(h || p)) verdict from keys join rules
  on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by page_id)
select page_id, host, path, rule, coalesce(verdict, 'allow') verdict from keys left join best using (page_id)
"""


LOWER_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS_SQL = f"regexp_extract_all({LOWER_SQL}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP4_SQL = f"""
with d as (select doc_id, coalesce({WORDS_SQL.format("text")}, []) w from documents),
b as (select cast(item_id as varchar) item, {WORDS_SQL.format("text")} w from benchmark where item_id is not null and text is not null),
windows as (
  select distinct item, least(len(w), 13) n, array_to_string(list_slice(w, k, k + least(len(w), 13) - 1), ' ') s
  from (select item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) k from b where len(w) > 0)),
sizes as (select distinct n from windows),
places as (
  select doc_id, n, k, array_to_string(list_slice(w, k, k + n - 1), ' ') s
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) k from d, sizes where len(w) >= n)),
found as (select doc_id, k, places.n n, item from places join windows using (s) where places.n = windows.n),
hits as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(k, k + n)) p from (select distinct doc_id, k, n from found)) group by doc_id),
items as (select doc_id, count(*) n_items, sha256(string_agg(item, ',' order by item)) h from (select distinct doc_id, item from found) group by doc_id)
select doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items,
  coalesce(h, sha256('')) items_sha256, coalesce(n_hit > 0 and 20 * n_hit >= len(w), false) contaminated
from d left join hits using (doc_id) left join items using (doc_id)
"""


#: The floor of s / n, which // doesn't give for negative s.
FLOOR_SQL = "(s - ((s % n) + n) % n) // n"


def centroids_sql(rounds: int = 10) -> str:
    steps = []
    for t in range(rounds + 1):
        steps.append(f"""
a{t} as materialized (
  select r, arg_min(c, d * 8 + c) c, min(d) d from (select r, c, sum((x - y) * (x - y)) d from p join c{t} using (i) group by r, c) group by r)""")
        if t < rounds:
            steps.append(f"""
c{t + 1} as materialized (
  select c, i, coalesce({FLOOR_SQL}, y) y from c{t} left join (select c, i, sum(x) s, count(*) n from p join a{t} using (r) group by c, i) using (c, i))""")
    return f"""
with kept as materialized (
  select row_number() over () r, vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) v
  from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64),
p as materialized (select r, unnest(range(64)) i, unnest(v) x from kept),
first as materialized (select row_number() over (order by sha256('3:' || vec_id), v) - 1 c, v from kept where vec_id is not null order by c limit 8),
c0 as materialized (select c, unnest(range(64)) i, unnest(v) y from first),{",".join(steps)},
digests as (select c, sha256(string_agg(cast(cast(y as bigint) as varchar), ',' order by i)) h from c{rounds} group by c),
sums as (select c, sum(d) s from a{rounds} group by c)
select vec_id, cast(c as int) as "cluster", cast(d as bigint) distance, cast(s as bigint) cluster_inertia, cast((select sum(d) from a{rounds}) as bigint) inertia, h centroid_sha256
from kept left join a{rounds} using (r) left join sums using (c) left join digests using (c)
"""


def vector_codes_sql(rounds: int = 2) -> str:
    steps = []
    for t in range(rounds + 1):
        steps.append(f"""
a{t} as materialized (
  select r, m, arg_min(e, d * 64 + e) e, min(d) d from (select r, m, e, sum((x - y) * (x - y)) d from p join c{t} using (m, i) group by r, m, e) group by r, m)""")
        if t < rounds:
            steps.append(f"""
c{t + 1} as materialized (
  select m, e, i, coalesce({FLOOR_SQL}, y) y from c{t} left join (select m, e, i, sum(x) s, count(*) n from p join a{t} using (r, m) group by m, e, i) using (m, e, i))""")
    return f"""
with kept as materialized (
  select row_number() over () r, vec_id, label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) v
  from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)),
p as materialized (select r, unnest(range(64)) // 4 m, unnest(range(64)) % 4 i, unnest(v) x from kept),
first as materialized (select row_number() over (order by vec_id, v) - 1 e, v from kept where vec_id is not null order by e limit 64),
c0 as materialized (select unnest(range(64)) // 4 m, e, unnest(range(64)) % 4 i, unnest(v) y from first),{",".join(steps)},
coded as materialized (
  select vec_id, label, string_agg(lower(printf('%02x', e)), '' order by m) code, cast(sum(d) as bigint) error from kept join a{rounds} using (r) group by r, vec_id, label),
sums as (select label, cast(sum(error) as bigint) label_error from coded group by label)
select vec_id, code, error, label_error, (select sha256(string_agg(cast(cast(y as bigint) as varchar), ',' order by m, e, i)) from c{rounds}) codebooks_sha256
from coded join sums on coded.label is not distinct from sums.label
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filters": OP1_SQL, "op4_decontamination": OP4_SQL, "op12_centroids": centroids_sql(), "op13_vector_codes": vector_codes_sql()}
