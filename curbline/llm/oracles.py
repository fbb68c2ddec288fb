"""DuckDB SQL for the operators that SQL can express."""

OP1 = r"""
with l as (
  select doc_id, i, line,
         translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from (select doc_id, unnest(s) as line, generate_subscripts(s, 1) as i
        from (select doc_id, string_split(coalesce(text, ''), chr(10)) as s from documents))),
o as (select k, min(doc_id) as owner from l where length(k) >= 10 group by k having count(distinct doc_id) > 1),
j as (select l.*, (o.owner is not null and o.owner <> doc_id) as gone from l left join o using (k))
select doc_id, count(*) as n_lines, cast(count(*) filter (gone) as bigint) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
from j group by doc_id
"""

OP4 = r"""
with p as (select page_id, coalesce(html, '') as h, strlen(coalesce(html, '')) as n, sha256(coalesce(html, '')) as d from pages),
f as (select d, min(page_id) as first from p where n >= 100 group by d)
select p.page_id, cast(p.n as bigint) as payload_bytes, p.d as payload_digest,
       case when f.first is null or f.first = p.page_id then 'response' else 'revisit' end as record_type,
       case when f.first <> p.page_id then f.first end as refers_to, true as digest_ok, cast(null as varchar) as error
from p left join f on p.d = f.d
"""

ORACLES = {"op1_line_dedup": OP1, "op4_warc": OP4}
