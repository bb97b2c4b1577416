"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import decontaminate, fingerprint, language_id, near_dedup, packing, quality, substring_dedup, suffix_dedup, url_filter, warc
from ._tables import table, work_dir, written


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeated(table(spark, sf_dir, "documents"), keep_text=False)


OP1_SQL = r"""
with d as (select doc_id, [x for x in regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') if x <> ''] as ws from documents),
 w as (select doc_id, unnest(range(1, len(ws) + 1)) as i, unnest(ws) as word from d),
 g as (select doc_id, s, md5(array_to_string(ws[s:s + 19], ' ')) as h from (select doc_id, ws, unnest(range(1, len(ws) - 18)) as s from d where len(ws) >= 20)),
 r as (select doc_id, s from (select *, row_number() over (partition by h order by doc_id, s) as n from g) where n > 1),
 gone as (select distinct doc_id, unnest(range(s, s + 20)) as i from r),
 k as (select w.doc_id, count(*) as n_words, count(gone.i) as n_removed, sha256(coalesce(string_agg(case when gone.i is null then word end, ' ' order by w.i), '')) as kept_sha256
   from w left join gone on w.doc_id = gone.doc_id and w.i = gone.i group by w.doc_id)
select d.doc_id, coalesce(n_words, 0)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, coalesce(kept_sha256, sha256('')) as kept_sha256 from d left join k on d.doc_id = k.doc_id
"""


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def held_out(modulus: int, rest: int):
    """Whether the CRC-32 of doc_id, written as text, leaves this rest; false where doc_id is null."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == rest, F.lit(False))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out(4, 2))
    model = language_id.train(docs.where("not held_out"))
    return language_id.predict(docs.select("doc_id", "held_out", "text"), model, keep_text=False)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = quality.train(docs, labels.where(~held_out(5, 0)))
    return quality.score(docs.withColumn("held_out", held_out(5, 0)), model, threshold=0.3)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)


OP7_SQL = r"""
with recursive d as (select doc_id, [x for x in regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') if x <> ''] as ws from documents),
 s as (select distinct doc_id, sh from (
   select doc_id, array_to_string(ws[i:i + 3], ' ') as sh from (select doc_id, ws, unnest(range(1, len(ws) - 2)) as i from d where len(ws) >= 4)
   union all select doc_id, array_to_string(ws, ' ') from d where len(ws) between 1 and 3)),
 n as (select doc_id, count(*) as n from s group by doc_id),
 e as (select a.doc_id as a, b.doc_id as b, count(*) as common from s a join s b on a.sh = b.sh and a.doc_id <> b.doc_id group by 1, 2),
 l as (select a, b from e join n x on x.doc_id = a join n y on y.doc_id = b where 100 * common >= 80 * (x.n + y.n - common)),
 r as (select doc_id as a, doc_id as b from documents union select r.a, l.b from r join l on r.b = l.a),
 c as (select a as doc_id, min(b) as component_id from r group by a)
select c.doc_id, coalesce(n.n, 0)::bigint as n_shingles, component_id, c.doc_id = component_id as kept from c left join n on c.doc_id = n.doc_id
"""


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    folder = work_dir(spark, "warc")
    files = written(warc.write_archives(pages, folder), "warc-files")
    return warc.read_archives(files, folder).select(
        F.col("id").cast("long").alias("page_id"), F.col("payload_length").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"), F.col("refers_to").cast("long").alias("refers_to"),
    )


# Base32 takes 20 bits, five hexadecimal digits, at a time.
OP8_SQL = """
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as hex from pages),
 d as (select page_id, octet_length(encode(html)) as payload_bytes, (
   select string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(hex, 5 * (i // 4) + 1, 5))::bigint >> (15 - 5 * (i % 4)))::int % 32 + 1, 1), '' order by i) from range(32) r(i)
 ) as payload_digest from p)
select page_id, payload_bytes, payload_digest, case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to
from (select *, min(page_id) over (partition by payload_digest) as first from d)
"""


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeated(table(spark, sf_dir, "documents"), keep_text=False)


# Bytes are pairs of hexadecimal digits; windows that overlap or touch make one span.
OP9_SQL = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
 w as (select doc_id, s, md5(substr(h, 2 * s + 1, 400)) as k from (select doc_id, h, unnest(range(0, length(h) // 2 - 199)) as s from d where length(h) >= 400)),
 r as (select doc_id, s, case when s - lag(s) over (partition by doc_id order by s) <= 200 then 0 else 1 end as fresh from (select *, count(*) over (partition by k) as n from w) where n > 1),
 p as (select doc_id, min(s) as a, max(s) + 200 as b from (select *, sum(fresh) over (partition by doc_id order by s) as g from r) group by doc_id, g),
 q as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as before from p),
 k as (select q.doc_id, sum(b - a) as n_removed, count(*) as n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' order by a) || substr(any_value(h), 2 * max(b) + 1) as kept
   from q join d on q.doc_id = d.doc_id group by q.doc_id)
select d.doc_id, (length(h) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(kept, h))) as kept_sha256
from d left join k on d.doc_id = k.doc_id
"""


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, url_filter.rules_table(spark)).select("page_id", "host", "path", "rule", "verdict")


OP10_SQL = r"""
with u as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) end as rest from pages),
 h as (select page_id, translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
   coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from u),
 r(rh, rp, v) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
 m as (select page_id, host, path, rh || rp as rule, v, row_number() over (partition by page_id order by length(rh || rp) desc nulls last) as n
   from h left join r on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp))
select page_id, host, path, rule, coalesce(v, 'allow') as verdict from m where n = 1
"""

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_decontamination": op2_decontamination,
    "op3_language_id": op3_language_id,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_fingerprints": op5_fingerprints,
    "op6_packing": op6_packing,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_warc": op8_warc,
    "op9_suffix_array_dedup": op9_suffix_array_dedup,
    "op10_url_filters": op10_url_filters,
}

ORACLE_SQL = {
    "op1_substring_dedup": OP1_SQL,
    "op7_minhash_near_dedup": OP7_SQL,
    "op8_warc": OP8_SQL,
    "op9_suffix_array_dedup": OP9_SQL,
    "op10_url_filters": OP10_SQL,
}
