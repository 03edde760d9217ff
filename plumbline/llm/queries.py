"""The queries of this package, one per operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.llm.conversation_repair import damage_and_repair
from plumbline.llm.decontaminate import decontamination
from plumbline.llm.jaccard import jaccard_components
from plumbline.llm.langid import identify
from plumbline.llm.license import TEMPLATES, template_table
from plumbline.llm.license import scan as license_scan
from plumbline.llm.line_dedup import dedup_lines
from plumbline.llm.neighbours import nearest_neighbours
from plumbline.llm.pack import pack
from plumbline.llm.periodic_runs import looped_runs
from plumbline.llm.render_html import extract_text
from plumbline.llm.resample import resample
from plumbline.llm.surrogates import pseudonymise
from plumbline.llm.token_files import token_file_digest
from plumbline.plans.registry import query, table

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_DECONTAMINATE = rf"""
with d as (
  select doc_id, row_number() over () as u,
         coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w
  from documents
), b as (
  select item_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark where text is not null
), bw as (
  select distinct item_id, least(13, len(w)) as k,
         array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') as win
  from (select item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) as i from b where len(w) > 0) x
), dw as (
  select u, i, k, array_to_string(list_slice(w, i, i + k - 1), ' ') as win
  from (select u, w, k, unnest(range(1, len(w) - k + 2)) as i
        from d, (select distinct k from bw) s where len(w) >= k) x
), hit as (
  select dw.u, dw.i, dw.k, bw.item_id from dw join bw on dw.win = bw.win
), words as (
  select u, count(distinct p) as n_hit
  from (select u, unnest(range(i, i + k)) as p from hit) x group by u
), items as (
  select u, count(*) as n_items, string_agg(item, ',' order by item) as s
  from (select distinct u, cast(item_id as varchar) as item from hit) x group by u
)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
       cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(s, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(d.w) as contaminated
from d left join words using (u) left join items using (u)
"""


@query("op8_decontamination", _DECONTAMINATE)
def op8_decontamination(spark, sf_dir):
    return decontamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op6_language_id")
def op6_language_id(spark, sf_dir):
    return identify(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query("op7_token_files")
def op7_token_files(spark, sf_dir):
    return token_file_digest(table(spark, sf_dir, "documents"))


@query("op2_packing")
def op2_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query("op1_surrogates")
def op1_surrogates(spark, sf_dir):
    # a key of its own for these tables; real ones are not in the code
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), b"query of synthetic tables", count_col="n_entities")


_JACCARD = rf"""
with recursive d as (
  select doc_id, coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+'), []) as w from documents
), s as (
  select distinct doc_id, array_to_string(list_slice(w, i, i + least(3, len(w)) - 1), ' ') as g
  from (select doc_id, w, unnest(range(1, len(w) - least(3, len(w)) + 2)) as i from d where len(w) > 0) x
), n as (
  select doc_id, count(*) as n from s group by doc_id
), p as (
  select x.doc_id as a, y.doc_id as b, count(*) as c from s x join s y on x.g = y.g and x.doc_id <> y.doc_id group by x.doc_id, y.doc_id
), l as (
  select a, b from p join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 90 * (na.n + nb.n - c)
), r as (
  select doc_id as node, doc_id as reached from documents
  union
  select r.node, l.b from r join l on l.a = r.reached
)
select doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, m.component_id
from documents left join n using (doc_id)
join (select node as doc_id, min(reached) as component_id from r group by node) m using (doc_id)
"""


@query("op9_jaccard_join", _JACCARD)
def op9_jaccard_join(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


_LICENSES = """
with t as (
  select * from (values %s) v(template_id, license, template)
), tb as (
  select template_id, license, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as b
  from (select template_id, license, regexp_extract_all(translate(template, '{u}', '{l}'), '{p}') as w from t) x where len(w) > 1
), ps as (
  select distinct doc_id, passage from (
    select doc_id, unnest(string_split(text, chr(10))) as passage from documents where text is not null
    union all select doc_id, text from documents where contains(text, chr(10))) x
), pb as (
  select doc_id, passage, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as b
  from (select doc_id, passage, regexp_extract_all(translate(passage, '{u}', '{l}'), '{p}') as w from ps) x
  where len(w) between 2 and 4000
), m as (
  select doc_id, passage, license,
         2.0::double * len(list_intersect(pb.b, tb.b)) / (len(pb.b) + len(tb.b)) as dice
  from pb, tb where len(pb.b) <= 1.5::double * len(tb.b) and len(tb.b) <= 1.5::double * len(pb.b)
)
select doc_id, license, max(dice) as dice, count(distinct passage) as n_passages from m where dice >= 0.8 group by doc_id, license
""".replace("{u}", _UPPER).replace("{l}", _LOWER).replace("{p}", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+") % ", ".join(
    "({}, '{}', '{}')".format(i, name, text.replace("'", "''")) for i, (name, text) in enumerate(TEMPLATES))


@query("op3_license_scan", _LICENSES)
def op3_license_scan(spark, sf_dir):
    return license_scan(table(spark, sf_dir, "documents"), template_table(spark)).withColumnRenamed("id", "doc_id")


@query("op5_html_text")
def op5_html_text(spark, sf_dir):
    return extract_text(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


@query("op4_resampling")
def op4_resampling(spark, sf_dir):
    found = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.withColumnRenamed("id", "doc_id")


@query("op10_nearest_neighbours")
def op10_nearest_neighbours(spark, sf_dir):
    return nearest_neighbours(table(spark, sf_dir, "embeddings"))


_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

_LINES = f"""
with d as (
  select doc_id, row_number() over () as u, string_split(coalesce(text, ''), chr(10)) as w from documents
), l as (
  select doc_id, u, i, line, translate(trim(line, {_WHITE}), '{_UPPER}', '{_LOWER}') as key
  from (select doc_id, u, unnest(w) as line, generate_subscripts(w, 1) as i from d) x
), c as (
  select key, max(doc_id) as keep from l where length(key) >= 40 group by key having count(distinct doc_id) >= 5
), m as (
  select l.*, keep is not null and (doc_id is null or doc_id <> keep) as lost from l left join c using (key)
)
select doc_id, count(*) as n_lines, count(*) filter (where lost) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not lost), '')) as kept_sha256
from m group by u, doc_id
"""


@query("op11_line_dedup", _LINES)
def op11_line_dedup(spark, sf_dir):
    kept = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


#: Checksum of a short ASCII string by the usual table of 256 numbers.
_CRC_TABLE = """crc as (
  select list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, i: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end)) as t
)"""


def _crc(value: str) -> str:
    return f"""xor(list_reduce(list_concat([4294967295], list_transform(string_split({value}, ''), lambda ch: ascii(ch)::bigint)),
    lambda c, b: xor(c // 256, t[1 + (xor(c, b) & 255)])), 4294967295)"""


_RUNS = rf"""
with {_CRC_TABLE}, d as (
  select doc_id, row_number() over () as u, {_crc("doc_id::varchar")} as h,
         coalesce(regexp_extract_all(text, '[^ 	-
]+'), []) as w
  from documents, crc
), a as (
  select *, len(w) as n, (h // 10) % greatest(len(w), 1) as a from d
), p as (
  select *, 1 + (n - a) // (3 + (h // 10) % 8) as p from a
), v as (
  select doc_id, u, n, case when h % 10 = 0 and n > 0
           then list_transform(range(n), lambda i: w[1 + case when i >= a then a + (i - a) % p else i end]) else w end as w
  from p
), x as (
  select u, n, unnest(w) as word, generate_subscripts(w, 1) - 1 as i from v
), e as (
  select x.u, x.i, y.i - x.i as q from x join x y on x.u = y.u and x.word = y.word and y.i > x.i and 4 * (y.i - x.i) <= x.n
), s as (
  select u, q, min(i) as start, count(*) as l
  from (select *, i - row_number() over (partition by u, q order by i) as g from e) z group by u, q, g
), r as (
  select u, start, l + q as length, min(q) as period from s where l >= greatest(6 - q, 3 * q) group by u, start, l + q
), top as (
  select *, row_number() over (partition by u order by length // period desc, ((length % period) * 1000000000000::hugeint) // period desc, start, period) as k from r
), listed as (
  select u, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as runs from r group by u
), gone as (
  select distinct u, unnest(range(start + period, start + length)) as i from r
), kept as (
  select x.u, string_agg(word, ' ' order by i) as kept from x anti join gone using (u, i) group by x.u
)
select doc_id, coalesce(n_runs, 0) as n_runs, start, length, period, (1000 * length) // period as exponent_milli,
       sha256(coalesce(runs, '')) as runs_sha256, sha256(coalesce(kept, '')) as collapsed_sha256
from v left join listed using (u) left join (select * from top where k = 1) t using (u) left join kept using (u)
"""


@query("op12_periodic_runs", _RUNS)
def op12_periodic_runs(spark, sf_dir):
    return looped_runs(table(spark, sf_dir, "documents"))


_BLANK, _ENDED = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*$"

#: Cheapest cost and least initials of every state, row by row; one insertion between two rows is enough in a cheapest repair.
_REPAIR = rf"""
with recursive {_CRC_TABLE}, raw as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
         {_crc("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as k
  from conversations, crc
), dmg as (
  select conv_id, turn, case when k = 4 then 'user' else role end as role,
         case when k = 1 then '' when k = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
         unnest(case when k = 3 then [0, 1] else [0] end) as copy
  from raw where k <> 0
), s as (
  select *, left(role, 1) as c, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i from dmg
), f as (
  select *, case when not regexp_matches(text, '{_BLANK}') then 'b' when row_number() over (partition by conv_id, role, text order by i) > 1 then 'd'
                 when not regexp_matches(text, '{_ENDED}') then 't' else 'c' end as fault,
         lag(c) over (partition by conv_id order by i) || c as pair from s
), info as (
  select conv_id, max(i) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where fault = 'b') as blank,
         count(*) filter (where fault = 'd') as duplicate, count(*) filter (where fault = 't') as truncated,
         count(*) filter (where pair not in ('su', 'ua', 'au')) as illegal
  from f group by conv_id
), p as (
  select conv_id, 0::bigint as i, 0 as st, {{'cost': 0, 'audit': '', 'made': ''}} as best from info
  union all
  select conv_id, i, st, min({{'cost': cost, 'audit': audit, 'made': made}}) from (
    select q.conv_id, q.i,
           case when e = 'D' then q.st when e = 'K' and q.st = 0 and c = 's' then 1 when q.st = 2 then 3 else 2 end as st,
           q.cost + case e when 'D' then 2 when 'K' then 0 else 1 end + case when e <> 'D' and fault = 't' then 5 else 0 end as cost,
           q.audit || e as audit,
           q.made || case e when 'D' then '' when 'K' then chr(10) || role || ':' || text
                     else chr(10) || case when q.st = 2 then 'assistant:' else 'user:' end || text end as made
    from (
      select p.conv_id, f.i, f.c, f.fault, f.role, f.text, o.e,
             case when ins = 0 then p.st when p.st = 2 then 3 else 2 end as st, best.cost + 5 * ins as cost,
             best.audit || repeat('I', ins) as audit, best.made || case when ins = 0 then '' when p.st = 2 then chr(10) || 'assistant:' else chr(10) || 'user:' end as made
      from p join f on f.conv_id is not distinct from p.conv_id and f.i = p.i + 1, (values (0), (1)) v(ins), (values ('D'), ('K'), ('R')) o(e)
    ) q
    where e = 'D' or (fault in ('c', 't') and (e = 'R' or c = case when q.st = 2 then 'a' else 'u' end or (c = 's' and q.st = 0)))
  ) y group by conv_id, i, st
), ends as (
  select p.conv_id, min({{'cost': best.cost + case when st = 2 then 5 else 0 end, 'audit': best.audit || case when st = 2 then 'I' else '' end,
         'made': best.made || case when st = 2 then chr(10) || 'assistant:' else '' end}}) as best
  from p join info on info.conv_id is not distinct from p.conv_id and p.i = info.n where st <> 1 group by p.conv_id
)
select o.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
       coalesce(illegal, 0) as illegal, coalesce(best.cost, 0)::bigint as cost, coalesce(best.audit, '') as audit,
       sha256(coalesce(substr(best.made, 2), '')) as repaired_sha256
from (select distinct conv_id from conversations) o left join info on info.conv_id is not distinct from o.conv_id
left join ends on ends.conv_id is not distinct from o.conv_id
"""


@query("op13_conversation_repair", _REPAIR)
def op13_conversation_repair(spark, sf_dir):
    return damage_and_repair(table(spark, sf_dir, "conversations"))
