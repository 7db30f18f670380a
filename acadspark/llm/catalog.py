"""The registered queries of this subpackage and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (decontaminate, html_text, license, minhash, packing, spelling, substring, suffix_array, token_counts,
               topk, toxicity, trie, warc)
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents with 80 % of their two-word shingles in common."""
    return minhash.groups(table(spark, sf_dir, "documents"), k=2)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that are left when repeated 20-word windows are removed."""
    return substring.digest(table(spark, sf_dir, "documents"))


def op3_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to WARC archives and read back."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with their best window."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, tokens and bytes by source, language and tokenizer version."""
    return token_counts.maintained(table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best of all vectors for every vector whose id is divisible by 100."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each document that are left when repeated 200-byte strings are removed."""
    return suffix_array.digest(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score of every document."""
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all rebuilt conversations."""
    return trie.rebuilt(table(spark, sf_dir, "conversations"))


def op12_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of every document."""
    return license.scan(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of the corpus, planted slips included, with their near words and roots."""
    return spelling.variants(table(spark, sf_dir, "documents"), slips=True)


SQL = {
    "op1_minhash_near_dedup": r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') as w from documents),
s as (
  select doc_id, list_sort(case when len(w) = 0 then [] when len(w) < 2 then [array_to_string(w, ' ')]
                      else list_distinct(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) end) as s
  from d),
class as (select min(doc_id) as c, s, len(s) as n from s where len(s) > 0 group by s),
item as (select c, n, unnest(s) as x from class),
pair as (
  select a.c as a, b.c as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as i
  from item a join item b on a.x = b.x and a.c < b.c and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  group by 1, 2),
link as (select a, b from pair where 100 * i >= 80 * (na + nb - i)),
edge as (select a, b from link union all select b, a from link),
reach(a, b) as (select c, c from class union select r.a, e.b from reach r join edge e on e.a = r.b),
root as (select a as c, min(b) as root from reach group by a)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, coalesce(root, s.doc_id) as component_id,
       s.doc_id = coalesce(root, s.doc_id) as kept
from s left join class on class.s = s.s left join root on root.c = class.c""",
    "op2_substring_dedup": r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) as h
        from (select doc_id, w, unnest(generate_series(1, len(w) - 19)) as i from d where len(w) >= 20)),
again as (select doc_id, i from (select *, row_number() over (partition by h order by doc_id, i) as k from win) where k > 1),
gone as (select distinct doc_id, unnest(generate_series(i, i + 19)) as p from again),
word as (select doc_id, unnest(w) as x, unnest(generate_series(1, len(w))) as p from d),
kept as (select doc_id, count(*) as n, string_agg(x, ' ' order by p) as t
         from word anti join gone using (doc_id, p) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed,
       sha256(coalesce(t, '')) as kept_sha256
from d left join kept on kept.doc_id = d.doc_id""",
    "op3_warc_segments": """
with p as (select page_id, coalesce(html, '') as html from pages),
q as (select page_id, octet_length(encode(html)) as n, sha1(html) as h, min(page_id) over (partition by html) as first from p),
b as (select *, list_transform(generate_series(0, 31),
                lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                  cast((('0x' || substr(h, 5 * (i // 4) + 1, 5))::bigint // (32 ** (3 - i % 4))::bigint) % 32 + 1 as bigint), 1)) as c
      from q)
select page_id, cast(n as bigint) as payload_bytes, array_to_string(c, '') as payload_digest,
       case when page_id = first then 'response' else 'revisit' end as record_type,
       case when page_id = first then null else first end as refers_to, cast(null as varchar) as error
from b""",
    # every window of every document against every item, without fingerprints
    "op4_benchmark_decontamination": r"""
with item as (
  select item_id, w, len(w) as n, least(5, len(w)) as size
  from (select distinct item_id, list_filter(regexp_split_to_array(lower(text), '[\x00-/:-@\[-`{-\x7F]+'), lambda x: x <> '') as w
        from benchmark)
  where len(w) > 0),
wanted as (
  select item_id, n, size, n - size + 1 as m, g, count(*) as c
  from (select *, unnest(list_transform(generate_series(1, n - size + 1), lambda i: array_to_string(w[i:i + size - 1], ' '))) as g
        from item)
  group by all),
doc as (
  select doc_id, list_filter(regexp_split_to_array(lower(text), '[\x00-/:-@\[-`{-\x7F]+'), lambda x: x <> '') as w
  from documents),
held as (
  select doc_id, len(w) as words, size, unnest(generate_series(0, len(w) - size)) as place,
         unnest(list_transform(generate_series(1, len(w) - size + 1), lambda i: array_to_string(w[i:i + size - 1], ' '))) as g
  from doc, (select distinct size from item)
  where len(w) >= size),
hit as (
  select doc_id, item_id, n, m, g, c,
         unnest(generate_series(greatest(0, place - m + 1), least(place, words - n))) as start
  from held join wanted using (size, g)),
overlap as (
  select doc_id, item_id, n, m, start, sum(least(k, c)) as common
  from (select doc_id, item_id, n, m, start, g, c, count(*) as k from hit group by all)
  group by all),
scored as (select *, cast(common as double) / cast(2 * m - common as double) as similarity from overlap)
select doc_id, item_id, cast(start as integer) as start, cast(n as integer) as n_words, similarity
from (select *, row_number() over (partition by doc_id, item_id order by similarity desc, start, n desc) as k
      from scored where similarity >= 0.8 - 1e-12)
where k = 1""",
    "op7_exact_top_k": """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v
  from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)),
pairs as (
  select q.vec_id as query_id, c.vec_id,
         cast(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) as bigint) as score
  from (select distinct * from v where vec_id % 100 = 0) q join v c on c.vec_id <> q.vec_id and len(c.v) = len(q.v))
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from pairs)
where rank <= 10""",
    # what an article element holds, by patterns: for well-formed pages with one article, as the table has them
    "op8_html_extraction": r"""
with p as (
  select page_id, url, regexp_replace(regexp_replace(coalesce(html, ''), '<!--.*?-->', '', 'gs'),
                                      '<(?:script.*?</script|style.*?</style)\s*>', '', 'gsi') as x
  from pages),
body as (select page_id, url, regexp_replace(regexp_extract(x, '<article\b[^>]*>(.*?)(?:</article\s*>|$)', 1, 'si'), '[\s\p{Z}]+', ' ', 'g') as x from p),
cut as (
  select page_id, url, string_split(regexp_replace(regexp_replace(regexp_replace(x,
           '</?(?:a|abbr|b|cite|code|em|i|mark|q|s|small|span|strong|sub|sup|time|u)\b[^>]*>', '', 'gi'),
           '<br\b[^>]*>', ' ', 'gi'), '</?[a-z][^>]*>', chr(10), 'gi'), chr(10)) as lines
  from body),
plain as (
  select page_id, url, list_transform(lines, lambda l: trim(regexp_replace(
           regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(l, '&nbsp;?', ' ', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&#39;?', '''', 'g'), '&amp;?', '&', 'g'),
           '[\s\p{Z}]+', ' ', 'g'))) as lines
  from cut),
t as (select page_id, url, coalesce(array_to_string(list_filter(lines, lambda l: l <> ''), chr(10)), '') as text from plain)
select page_id, url, text, cast(length(text) as bigint) as n_chars from t""",
    # all 200-byte strings as hexadecimal digits, in parts of 1,000 starts
    "op9_suffix_array_dedup": """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as x, octet_length(encode(coalesce(text, ''))) as n from documents),
part as (select doc_id, n, 1000 * c as base, substr(x, 2000 * c + 1, 2398) as x
         from (select *, unnest(generate_series(0, (n - 200) // 1000)) as c from d where n >= 200)),
win as (select doc_id, base + i as i, md5_number(substr(x, 2 * i + 1, 400)) as h
        from (select *, unnest(generate_series(0, least(999, n - 200 - base))) as i from part)),
again as (select doc_id, i from win where h in (select h from win group by h having count(*) > 1)),
run as (select doc_id, min(i) as a, max(i) + 200 as b
        from (select *, sum(new) over (partition by doc_id order by i) as r
              from (select *, case when i <= lag(i) over (partition by doc_id order by i) + 200 then 0 else 1 end as new from again))
        group by doc_id, r),
hole as (select doc_id, 0 as a from d union all select doc_id, b from run),
kept as (select doc_id, string_agg(substr(d.x, 2 * a + 1, 2 * (coalesce(b, n) - a)), '' order by a) as x
         from (select hole.doc_id, hole.a, (select min(run.a) from run where run.doc_id = hole.doc_id and run.a >= hole.a) as b from hole)
         join d using (doc_id) group by doc_id)
select d.doc_id, d.n as n_bytes, cast(coalesce(r.n, 0) as bigint) as n_removed, coalesce(r.k, 0) as n_spans,
       sha256(unhex(kept.x)) as kept_sha256
from d join kept using (doc_id) left join (select doc_id, sum(b - a) as n, count(*) as k from run group by doc_id) r using (doc_id)""",
}


def queries() -> dict[str, Query]:
    found = {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return SQL | {"op11_conversation_trie": trie.ORACLE_SQL, "op12_license_scans": license.oracle_sql(),
                  "op13_spelling_variants": spelling.ORACLE_SQL}
