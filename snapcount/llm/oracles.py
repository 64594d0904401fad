"""DuckDB SQL for the corpus queries that SQL can say."""

from __future__ import annotations

from snapcount.llm import licenses

# CRC-32 by its polynomial, a byte at a time; places by seeded MD5, as the operator takes them.
SHARDING = """
with recursive steps(b, k, c) as (
  select b, 0, b from range(256) r(b)
  union all
  select b, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end from steps where k < 8
), crc as (select list(c order by b) as t from steps where k = 8),
rows as (
  select doc_id, source, coalesce(source, chr(0) || 'null') as source_key,
         octet_length(encode(coalesce(text, ''))) + 1 as size,
         xor(list_reduce(list_concat([4294967295::bigint], list_transform(
           regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::bigint)),
           lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1])), 4294967295::bigint) as text_crc32
  from documents, crc
), shuffled as (
  select *, md5('2024:' || coalesce(cast(doc_id as varchar), '') || ':' || cast(text_crc32 as varchar)) as digest
  from rows
), placed as (
  select *, (2 * (row_number() over (partition by source_key order by digest, doc_id, text_crc32) - 1) + 1)::double
            / (2 * count(*) over (partition by source_key))::double as share
  from shuffled
), ordered as (
  select *, row_number() over (order by share, coalesce(source, ''), digest, doc_id, text_crc32) - 1 as pos,
         count(*) over () as n
  from placed
)
select doc_id, cast(size as bigint) as size, text_crc32, 'rows' as law, cast((pos * 16) // n as int) as shard,
       cast(pos - (((pos * 16) // n) * n + 15) // 16 as bigint) as slot, cast(null as int) as grown_shard, source
from ordered
"""


def license_scan(templates=licenses.TEMPLATES) -> str:
    """Exact containment of every template in every window, without bands."""
    quoted = ", ".join("('" + "', '".join(x.replace("'", "''") for x in t) + "')" for t in templates)
    words = "list_filter(regexp_split_to_array(lower(coalesce({}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    return f"""
with templates(template, license, text) as (values {quoted}),
template_shingles as (
  select distinct template, array_to_string(w[i + 1 : i + 5], ' ') as s, n from (
    select template, w, len(w) - 4 as n, unnest(range(0, greatest(len(w) - 4, 0))) as i
    from (select template, {words.format("text")} as w from templates))
), sized as (
  select template, s, (select min(p) from (select cast(pow(2, k) as bigint) as p from range(1, 40) r(k)) where p >= 2 * n) as length,
         count(*) over (partition by template) as total
  from template_shingles
), document_shingles as (
  select doc_id, cast(i as bigint) as i, array_to_string(w[i + 1 : i + 5], ' ') as s from (
    select doc_id, w, unnest(range(0, greatest(len(w) - 4, 0))) as i
    from (select doc_id, {words.format("text")} as w from documents))
), hits as (
  select doc_id, i, template, s, length, total,
         unnest([i // (length // 2), i // (length // 2) - 1]) as k
  from document_shingles join sized using (s)
), windows as (
  select doc_id, template, k, count(distinct s)::double / any_value(total) as containment, min(i) as start_word
  from hits where k >= 0 group by all
  having count(distinct s)::double / any_value(total) >= 0.8
), own as (
  select a.template, b.template as other, x.s
  from templates a join templates b on a.license <> b.license join sized x on x.template = a.template
  where not exists (select 1 from sized y where y.template = b.template and y.s = x.s)
), confused as (
  select distinct doc_id, template, k from (
    select w.doc_id, w.template, w.k, o.other, count(distinct o.s) as n, count(distinct h.s) as held
    from windows w join own o using (template)
    left join hits h on h.doc_id is not distinct from w.doc_id and h.template = w.template and h.k = w.k and h.s = o.s
    group by all)
  where held < 0.5 * n
)
select doc_id, template, license, min(start_word) as start_word, max(containment) as containment
from windows w join templates using (template)
where not exists (select 1 from confused c where c.doc_id is not distinct from w.doc_id and c.template = w.template and c.k = w.k)
group by all
"""


LICENSES = license_scan()


def vector_codes(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """Every distance to every entry, round after round."""
    sql = f"""
with kept as materialized (
  select row_number() over () as r, vec_id, label, list_transform(embedding, lambda x: cast(floor({scale} * cast(x as double)) as bigint)) as v
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), cells as materialized (
  select r, (i * {parts}) // len(v) as part, i % (len(v) // {parts}) as pos, v[i + 1] as x
  from (select r, v, unnest(range(len(v))) as i from kept)
), book0 as materialized (
  select entry, part, pos, x from cells join (
    select r, row_number() over (order by vec_id nulls last, v) - 1 as entry from kept qualify entry < {entries}) using (r)
)"""
    for k in range(rounds + 1):
        sql += f""", near{k} as materialized (
  select r, part, min(d) as d, arg_min(entry, (d, entry)) as entry from (
    select r, part, entry, sum((c.x - b.x) * (c.x - b.x)) as d from cells c join book{k} b using (part, pos) group by all)
  group by all
)"""
        if k < rounds:
            sql += f""", book{k + 1} as materialized (
  select entry, part, pos, coalesce(m.x, b.x) as x from book{k} b left join (
    select part, entry, pos, cast(floor(sum(x) / count(*)) as bigint) as x
    from cells join near{k} using (r, part) group by all) m using (part, entry, pos)
)"""
    return sql + f""", coded as (
  select r, string_agg(printf('%02x', entry), '' order by part) as code, cast(sum(d) as bigint) as error
  from near{rounds} group by r
)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error,
       (select sha256(string_agg(cast(x as varchar), ',' order by part, entry, pos)) from book{rounds}) as codebooks_sha256
from kept join coded using (r)
"""


VECTOR_CODES = vector_codes()


# SHA-1 in hex to base32: 40 hex digits are 32 groups of five bits.
WARC = """
with paid as (
  select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as h from pages
), named as (
  select page_id, payload_bytes, array_to_string(list_transform(range(8), lambda g: array_to_string(list_transform(range(4), lambda q:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast((('0x' || substr(h, cast(g * 5 + 1 as int), 5))::bigint >> (15 - 5 * q)) & 31 as int) + 1, 1)), '')), '') as payload_digest
  from paid
), ranked as (
  select *, max(page_id) over (partition by payload_digest) as kept from named
)
select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest,
       case when page_id = kept then 'response' else 'revisit' end as record_type,
       case when page_id < kept then kept end as refers_to
from ranked
"""


# Every prefix as its text; subtrees by joining each node with all prefixes of its smallest member.
PREFIX_TRIE = """
with recursive steps(b, k, c) as (
  select b, 0, b from range(256) r(b)
  union all
  select b, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end from steps where k < 8
), crc as (select list(c order by b) as t from steps where k = 8),
turns as (
  select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as text,
         row_number() over (partition by conv_id order by turn nulls first) - 1 as p
  from conversations where conv_id is not null
), ids as (
  select c, n, c - ((c % 5) + 5) % 5 as base,
         xor(list_reduce(list_concat([4294967295::bigint], list_transform(
           regexp_extract_all(hex(encode(cast(c as varchar))), '..'), lambda x: ('0x' || x)::bigint)),
           lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1])), 4294967295::bigint) % 9 as h
  from (select c, count(*) as n from turns group by c), crc
), convs as (
  select i.*, least(h, coalesce(b.bn, 0)) as taken from ids i left join (select c as base, n as bn from ids) b using (base)
), rebuilt as (
  select v.c, t.p, role, text from convs v join turns t on t.c = v.base where t.p < h
  union all
  select v.c, taken + t.p - h, role, text from convs v join turns t on t.c = v.c where t.p >= h
), paths as materialized (
  select c, p + 1 as depth, octet_length(encode(text)) as size,
         sha256(cast(list([role, text]) over (partition by c order by p) as varchar)) as k,
         p + 1 = count(*) over (partition by c) as ends
  from rebuilt
  union all
  select c, 0, 0, '', c not in (select c from rebuilt) from convs
), nodes as materialized (
  select k, depth, any_value(size) as size, min(c) as conv_id, count(*) as n_convs,
         sha256(coalesce(string_agg(cast(c as varchar), ',' order by c) filter (ends), '')) as ends_sha256
  from paths group by k, depth
), up as (
  select n.k, a.k as above, a.depth as above_depth from nodes n join paths a on a.c = n.conv_id and a.depth <= n.depth
), children as (
  select u.above as k, count(*) as n_children from up u join nodes n using (k) where u.above_depth = n.depth - 1 group by 1
), below as (
  select u.above as k, sum((n.n_convs - 1) * n.size) as saved, count(*) filter (n.k not in (select k from children)) as leaves
  from up u join nodes n using (k) group by 1
), parent as (
  select u.k, a.conv_id as parent_conv_id from up u join nodes n using (k) join nodes a on a.k = u.above where u.above_depth = n.depth - 1
)
select conv_id, cast(depth as bigint) as depth, parent_conv_id, n_convs, coalesce(n_children, 0) as n_children,
       leaves as n_leaves, cast(saved as bigint) as saved_tokens, ends_sha256
from nodes left join children using (k) join below using (k) left join parent using (k)
"""
