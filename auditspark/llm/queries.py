"""The operators over the whole tables, one registered query each."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, conversation, decontaminate, embeddings, fingerprint, html, jaccard, packing, periodic, secrets, substring, toxicity, warc
from .common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op2_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op9_bpe")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode_decode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


@query(
    "op10_warc",
    """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, strlen(html) as payload_bytes, sha1(html) as hexed from p),
f as (select hexed, min(page_id) as first from d group by hexed)
select page_id, cast(payload_bytes as bigint) as payload_bytes,
 list_aggregate(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[cast(1 +
  ((('0x' || substr(hexed || '00', cast(1 + (i * 5) // 4 as int), 2))::int >> cast(3 - (i * 5) % 4 as int)) & 31) as int)]),
  'string_agg', '') as payload_digest,
 case when page_id = first then 'response' else 'revisit' end as record_type,
 case when page_id <> first then first end as refers_to
from d join f using (hexed)""",
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


@query("op7_substring_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query("op3_jaccard_join")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


@query("op6_toxicity")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return toxicity.score(documents, toxicity.fit(documents, table(spark, sf_dir, "labels")))


@query("op1_embedding_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op4_fingerprints")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


@query("op5_html_text")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


@query("op8_secret_scan")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


@query(
    "op12_conversation_repair",
    r"""
with recursive given as (
 select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
  coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as k
 from conversations),
marked as (
 select *, xor(4294967295, list_reduce(
   list_prepend(4294967295::bigint, list_transform(string_split(k, ''), lambda c: ascii(c)::bigint)),
   lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1))))) % 20 as kind
 from given),
damaged as (
 select conv_id, turn, case when kind = 4 then 'user' else role end as role,
  case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
 from marked, generate_series(1, case when kind = 3 then 2 else 1 end) where kind <> 0),
numbered as (
 select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as no from damaged),
placed as (
 select *, row_number() over (partition by conv_id, role, text order by no) as copy,
  lag(role) over (partition by conv_id order by no) as role_before,
  rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') as solid
 from numbered),
faulty as (
 select *, left(role, 1) as initial,
  case when solid = '' then 'blank' when copy > 1 then 'duplicate'
       when right(solid, 1) not in ('.', '!', '?') then 'truncated' else 'fine' end as fault
 from placed),
counted as (
 select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
  count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
  count(*) filter (fault = 'truncated') as truncated,
  count(*) filter (no > 1 and left(role_before, 1) || initial not in ('su', 'ua', 'au')) as illegal, count(*) as n
 from faulty group by conv_id),
-- places in the grammar: 0 nothing yet, 1 after s, 2 after u, 3 after a; moves by inserts before a row
inserts(was, mid, roles) as (values (0,0,''),(1,1,''),(2,2,''),(3,3,''),(0,2,'u'),(1,2,'u'),(3,2,'u'),(2,3,'a'),
 (0,3,'ua'),(1,3,'ua'),(3,3,'ua'),(2,2,'au')),
-- moves by a row: its own initial, or any row taken as another
shifts(mid, initial, now) as (values (0,'s',1),(0,'u',2),(1,'u',2),(3,'u',2),(2,'a',3)),
edits as (
 select f.conv_id, f.no, i.was, s.now, 5 * length(i.roles) + case when f.fault = 'truncated' then 5 else 0 end + e.cost as cost,
  repeat('I', length(i.roles)) || e.letter as letters, i.roles,
  case when e.letter = 'K' then f.role when s.initial = 'u' then 'user' else 'assistant' end || ':' || f.text as line
 from faulty f, inserts i join shifts s using (mid), (values ('K', 0), ('R', 1)) e(letter, cost)
 where f.fault in ('fine', 'truncated') and case when e.letter = 'K' then s.initial = f.initial else s.initial in ('u', 'a') end
 union all
 select f.conv_id, f.no, i.was, i.mid, 5 * length(i.roles) + 2, repeat('I', length(i.roles)) || 'D', i.roles, null
 from faulty f, inserts i),
paths as (
 select conv_id, 0::bigint as no, 0 as place, 0::bigint as cost, '' as audit, []::varchar[] as lines from counted
 union all
 select conv_id, no, place, cost, audit, lines from (
  select p.conv_id, e.no, e.now as place, p.cost + e.cost as cost, p.audit || e.letters as audit,
   p.lines || list_transform(list_filter(string_split(e.roles, ''), lambda r: r <> ''),
    lambda r: case when r = 'u' then 'user:' else 'assistant:' end) || case when e.line is null then [] else [e.line] end as lines
  from paths p join edits e on e.conv_id is not distinct from p.conv_id and e.no = p.no + 1 and e.was = p.place) x
 qualify row_number() over (partition by conv_id, no, place order by cost, audit) = 1),
ended as (
 select p.conv_id, p.cost + 5 * length(i.roles) as cost, p.audit || repeat('I', length(i.roles)) as audit,
  p.lines || list_transform(list_filter(string_split(i.roles, ''), lambda r: r <> ''),
   lambda r: case when r = 'u' then 'user:' else 'assistant:' end) as lines
 from paths p join counted c on c.conv_id is not distinct from p.conv_id and c.n = p.no
 join inserts i on i.was = p.place where i.mid in (0, 3)
 qualify row_number() over (partition by p.conv_id order by p.cost + 5 * length(i.roles), p.audit || repeat('I', length(i.roles))) = 1)
select o.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
 coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(cost, 0) as cost, coalesce(audit, '') as audit,
 sha256(coalesce(array_to_string(lines, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) o
left join counted c on c.conv_id is not distinct from o.conv_id
left join ended e on e.conv_id is not distinct from o.conv_id""",
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.repair(table(spark, sf_dir, "conversations"))


@query("op13_periodic_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(table(spark, sf_dir, "documents"))


@query(
    "op11_decontamination",
    r"""
with d as (
 select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (
 select coalesce(cast(item_id as varchar), '') as item, regexp_extract_all(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
windows as (
 select distinct item, array_to_string(list_slice(w, k, k + 9), ' ') as passage, least(len(w), 10) as length
 from b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as t(k) where len(w) > 0),
lengths as (select distinct length from windows),
places as (select rid, w, unnest(range(1, len(w) + 1)) as k from d),
held as (
 select rid, k, length, array_to_string(list_slice(w, k, k + length - 1), ' ') as passage
 from places, lengths where k + length - 1 <= len(w)),
occurring as (select h.*, item from held h join windows using (passage, length)),
hit as (
 select rid, count(distinct word) as n_hit
 from (select rid, unnest(range(k, k + length)) as word from (select distinct rid, k, length from occurring)) group by rid),
named as (
 select rid, count(*) as n_items, string_agg(item, ',' order by item) as items
 from (select distinct rid, item from occurring) group by rid)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
 sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (rid) left join named using (rid)""",
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
