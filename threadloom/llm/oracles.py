"""SQL of the queries of this package that SQL can express."""

from __future__ import annotations

from threadloom.llm.quality import BOILERPLATE, SENTENCE_MARKS, SEPARATORS, SYMBOLS, LineRules
from threadloom.llm.queries import ARCHIVE_BYTES, N_SHARDS

_sql: dict[str, str] = {}
_RULES = LineRules()

# Words between the six spaces.
_WORDS = "list_filter(regexp_split_to_array(coalesce({0}, ''), '[ \\t-\\r]+'), lambda w: w <> '')"


def registry() -> dict[str, str]:
    return dict(_sql)


def _words(text: str) -> str:
    return _WORDS.format(text)


_sql["op1_rendezvous_shards"] = f"""
with crc_table as (
  select list_transform(range(256), lambda n: list_reduce(list_prepend(n::bigint, range(8)),
    lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
bytes as (
  select doc_id, strlen(coalesce(text, '')) + 16 as size,
    list_transform(list_filter(string_split(regexp_replace(hex(encode(coalesce(text, ''))), '(..)', '\\1,', 'g'), ','),
      lambda h: h <> ''), lambda h: ('0x' || h)::bigint) as b
  from documents),
crc as (
  select doc_id, size, xor(list_reduce(list_prepend(4294967295::bigint, b),
    lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) as text_crc32
  from bytes, crc_table),
costs as (
  select doc_id, s, -ln((('0x' || substr(md5(doc_id || ':' || s), 1, 13))::bigint + 0.5) / pow(16, 13)) as cost
  from documents, range({N_SHARDS + 1}) r(s)),
placed as (
  select doc_id, (arg_min(s, cost) filter (where s < {N_SHARDS}))::int as shard, arg_min(s, cost)::int as grown_shard
  from costs group by doc_id)
select doc_id, size, text_crc32, 'key' as law, shard,
  row_number() over (partition by shard order by doc_id) - 1 as slot, grown_shard
from crc join placed using (doc_id)
"""

_sql["op2_merkle_audit"] = f"""
with read as (
  select page_id, coalesce(url, '') as url, coalesce(html, '') as html,
    coalesce(url, '') || case when page_id % 89 = 3 then '#' else '' end as url2,
    case when page_id % 97 = 5 then 'x' || substr(coalesce(html, ''), 2) else coalesce(html, '') end as html2
  from pages),
records as (
  select page_id, 'WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: ' || url || '\r\nContent-Length: '
    || strlen(html) || '\r\n\r\n' || html || '\r\n\r\n' as record,
    'WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: ' || url2 || '\r\nContent-Length: '
    || strlen(html2) || '\r\n\r\n' || html2 || '\r\n\r\n' as held
  from read),
hashed as (select page_id, strlen(record) as length, sha256(record) as digest, sha256(held) as held from records),
starts as (
  select page_id, digest, held, (sum(length) over (order by page_id, digest rows unbounded preceding) - length)::bigint as start
  from hashed),
one as (
  select page_id, digest, held, start // {ARCHIVE_BYTES} as archive, start % {ARCHIVE_BYTES} as "offset" from starts),
two as (
  select archive, "offset", held as digest from one where coalesce(page_id % 101 <> 7, true)
  union all
  select archive, "offset" + 1, held from one where page_id % 103 = 9 and page_id % 101 <> 7)
select coalesce(one.archive, two.archive) as archive, coalesce(one."offset", two."offset") as "offset",
  case when two.digest is null then 'missing' when one.digest is null then 'extra' else 'changed' end as status,
  one.digest as digest_a, two.digest as digest_b
from one full outer join two on one.archive = two.archive and one."offset" = two."offset"
where one.digest is distinct from two.digest
"""

_sql["op4_quotation_links"] = """
with recursive flat as (
  select conv_id, turn, text, trim(regexp_replace(lower(coalesce(text, '')), '[ \\t-\\r]+', ' ', 'g')) as plain
  from conversations),
answered as (
  select m.conv_id, m.turn, q.plain from flat m join flat q
    on q.conv_id = m.conv_id and q.turn = m.turn - case when m.turn % 5 = 4 and m.turn > 1 then 2 else 1 end),
links as (
  select a.conv_id, a.turn, min(w.turn) as parent
  from answered a join flat w on w.conv_id = a.conv_id and w.plain = a.plain and w.plain <> ''
  group by 1, 2),
tree as (
  select conv_id, turn, turn as root, null::bigint as parent, 0::bigint as depth
  from flat where not exists (select 1 from links l where l.conv_id = flat.conv_id and l.turn = flat.turn)
  union all
  select l.conv_id, l.turn, t.root, l.parent, t.depth + 1
  from links l join tree t on t.conv_id = l.conv_id and t.turn = l.parent)
select conv_id, turn, root, parent, depth,
  row_number() over (partition by conv_id, root order by turn) - 1 as position,
  sha256(regexp_replace(coalesce(text, ''), '^(?:[ \\t\\r]*\\n)+|\\s+$', '', 'g')) as own_sha256
from tree join flat using (conv_id, turn)
"""

_LINE_WORDS = _words("line")
_sql["op5_line_quality"] = f"""
with texts as (select doc_id, coalesce(text, '') as text, {_words("text")} as w from documents),
windows as (
  select doc_id, i, array_to_string(w[i:i + 2], ' ') as k
  from texts, lateral (select unnest(range(1, len(w) - 1)) as i)),
twice as (select doc_id, i from windows qualify count(*) over (partition by doc_id, k) > 1),
repeats as (
  select doc_id, count(distinct i + j) as n_repeat_words from twice, range(3) r(j) group by doc_id),
lines as (
  select doc_id, line, {_LINE_WORDS} as w,
    length(line) - length(translate(line, '{SYMBOLS}', '')) as symbols
  from texts, lateral (select unnest(string_split(text, chr(10))) as line)),
judged as (
  select *, len(w) as n, len(list_filter(w, lambda x: x in {SEPARATORS})) as separators from lines),
bad as (
  select doc_id, line, n > 0 and (
    (separators >= 2 and separators >= {_RULES.separator_share} * n)
    or (symbols >= 3 and symbols >= {_RULES.symbol_share} * n)
    or (n >= {_RULES.repeat_words} and len(list_distinct(w)) < {_RULES.distinct_share} * n)
    or (n < {_RULES.boilerplate_words} and regexp_matches(lower(line), '{"|".join(BOILERPLATE)}'))
    or (n >= {_RULES.unpunctuated_words}
      and not regexp_matches(translate(line, '{SENTENCE_MARKS}', '{"." * len(SENTENCE_MARKS)}'),
        '\\.["''\\)\\]\\x{{00BB}}\\x{{201C}}\\x{{201D}}\\x{{2019}}]*([ \\t\\r]|\\z)')
      and not regexp_matches(line, '[\\p{{Thai}}\\p{{Lao}}\\p{{Tibetan}}][^\\p{{L}}]*\\z'))
    ) as fails
  from judged),
cleaned as (
  select doc_id, coalesce(sum(length(regexp_replace(line, '[ \\t-\\r]+', '', 'g'))) filter (where not fails), 0) as left_chars
  from bad group by doc_id),
counts as (
  select doc_id, len(w)::bigint as n_words, length(regexp_replace(text, '[ \\t-\\r]+', '', 'g'))::bigint as word_chars,
    (length(text) - length(translate(text, '{SYMBOLS}', '')))::bigint as n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \\t-\\r]')) as full_lines
  from texts),
together as (
  select doc_id, n_words, word_chars, n_symbols,
    (len(full_lines) - len(list_distinct(full_lines)))::bigint as n_dup_lines,
    coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
    case when word_chars = 0 then 0.0::double else 1 - left_chars::double / word_chars end as lost_share
  from counts left join repeats using (doc_id) join cleaned using (doc_id)),
base as (
  select *, n_words < {_RULES.min_words} or 100 * n_repeat_words > {_RULES.max_repeat_percent} * n_words as base_failed
  from together)
select *, not base_failed and lost_share <= {_RULES.max_lost} as kept from base
"""

_sql["op6_fm_index"] = f"""
with texts as (select doc_id, {_words("text")} as w from documents),
windows as (
  select doc_id, i, array_to_string(w[i:i + 12], ' ') as k
  from texts, lateral (select unnest(range(1, len(w) - 11)) as i)),
first as (select k, min(doc_id) as earliest from windows group by k),
covered as (
  select distinct doc_id, i + j as p
  from windows join first using (k), range(13) r(j) where earliest < doc_id),
tokens as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from texts),
kept as (
  select t.doc_id, string_agg(word, ' ' order by t.p) filter (where c.p is null) as line,
    count(c.p) as n_removed
  from tokens t left join covered c on c.doc_id = t.doc_id and c.p = t.p group by t.doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(line, '')) as kept_sha256
from texts left join kept using (doc_id)
"""

_PLAIN = "list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '')"
_sql["op7_size_containment"] = f"""
with items as (select item_id, {_PLAIN} as w from benchmark),
asked as (
  select distinct item_id, array_to_string(w[i:i + 4], ' ') as k
  from items, lateral (select unnest(range(1, len(w) - 3)) as i)),
sizes as (select item_id, count(*) as n_shingles from asked group by item_id),
texts as (select doc_id, {_PLAIN} as w from documents),
held as (
  select distinct doc_id, array_to_string(w[i:i + 4], ' ') as k
  from texts, lateral (select unnest(range(1, len(w) - 3)) as i)),
shared as (select doc_id, item_id, count(*) as n_shared from held join asked using (k) group by 1, 2)
select doc_id, item_id, n_shingles, n_shared
from shared join sizes using (item_id) where 100 * n_shared >= 80 * n_shingles
"""

_sql["op10_tensor_minhash"] = f"""
with recursive texts as (
  select doc_id, {_words("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as w from documents),
shingles as (
  select distinct doc_id, array_to_string(w[i:i + 3], ' ') as k
  from texts, lateral (select unnest(range(1, greatest(len(w) - 2, least(len(w), 1) + 1))) as i)),
sizes as (
  select doc_id, count(k) as n_shingles from texts left join shingles using (doc_id) group by doc_id),
pairs as (
  select a.doc_id as a, b.doc_id as b, count(*) as n
  from shingles a join shingles b on a.k = b.k and a.doc_id < b.doc_id group by 1, 2),
links as (
  select a, b from pairs join sizes x on x.doc_id = a join sizes y on y.doc_id = b
  where 100 * n >= 80 * (x.n_shingles + y.n_shingles - n)),
both_ways as (select a, b from links union all select b, a from links),
reached as (
  select doc_id, doc_id as other from texts
  union
  select r.doc_id, l.b from reached r join both_ways l on l.a = r.other)
select doc_id, n_shingles, min(other) as component_id, doc_id = min(other) as kept
from reached join sizes using (doc_id) group by doc_id, n_shingles
"""

# Exact; the query is, too, on tables of one block (4096 records).
_sql["op13_hilbert_windows"] = """
with usable as (
  select vec_id, embedding::double[] as v from embeddings
  where list_bool_and(list_transform(embedding, lambda c: c is not null and isfinite(c)))
    and list_bool_or(list_transform(embedding, lambda c: c <> 0))),
scored as (
  select a.vec_id as query_id, b.vec_id, list_inner_product(a.v, b.v) as score
  from usable a join usable b on a.vec_id <> b.vec_id and a.vec_id % 20 = 0)
select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score
from scored qualify rank <= 20
"""
