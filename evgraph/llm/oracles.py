"""DuckDB SQL for the training-data queries that SQL can express."""

from evgraph.llm.quality import STOP_WORDS

_STOPS = ", ".join(f"'{w}'" for w in sorted(set(" ".join(STOP_WORDS.values()).split())))

QUALITY = rf"""
with d as (
  select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents
), t as (
  select rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l
  from d
), p as (
  select rid, unnest(range(1, len(w) - 1)) as i, w from t where len(w) > 2
), k as (
  select rid, i, count(*) over (partition by rid, w[i], w[i + 1], w[i + 2]) as n from p
), r as (
  select rid, count(distinct i + j.j) as n_repeat_words
  from k, (values (0), (1), (2)) j(j) where n > 1 group by rid
), m as (
  select t.rid, doc_id, len(w) as n_words, length(list_aggregate(w, 'string_agg', '')) as word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]')) as n_symbols,
         len(regexp_extract_all(text, '!')) as n_marks,
         len(l) as n_lines, len(l) - len(list_distinct(l)) as n_dup_lines,
         coalesce(n_repeat_words, 0) as n_repeat_words,
         len(list_filter(w, lambda x: lower(x) in ({_STOPS}))) as n_stops
  from t left join r using (rid)
), v as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
         greatest(n_words, 1) as nw from m
)
select doc_id, n_words::bigint as n_words, coalesce(word_chars, 0)::bigint as word_chars,
       n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines,
       n_repeat_words::bigint as n_repeat_words, base_failed,
       not base_failed and word_chars >= 1.5::double * nw and word_chars <= 25 * nw
         and n_symbols::double / nw <= 0.1::double and n_marks::double / nw <= 0.5::double
         and n_stops::double / nw >= 0.02::double
         and n_dup_lines::double / greatest(n_lines, 1) <= 0.5::double
         and n_repeat_words::double / nw <= 0.5::double as kept
from v
"""

CHAT = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), e as (
  select *, length(role || text) + length(regexp_extract_all(text, '<\\*/?s>')) + 8
         + length(regexp_extract_all(role, '<\\*(/?s|n)>')) + 2 * (length(role) - length(replace(role, chr(10), ''))) as chars
  from t
)
select conv_id, count(*)::bigint as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       sum(chars)::bigint as formatted_chars
from e group by conv_id
"""

# The crc32 of a short text: its bytes one after the other, each with eight shifts (-1).
_CRC = """
  xor(list_reduce(flatten([[4294967295]] || list_transform(string_split(doc_id::varchar, ''),
      lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda c, e: case when e >= 0 then xor(c, e) when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end), 4294967295)
"""


def _part(value: str) -> str:
    return f"case when {value} is null then '-' else octet_length(encode({value}::varchar)) || ':' || {value}::varchar end"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_part(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


MERKLE = f"""
with recursive d as (
  select doc_id, source, {_leaf("text")} as leaf,
         case when {_CRC} % 2 = 0 then {_leaf("replace(text, chr(10), '')")} else {_leaf("text")} end as now
  from documents
), l as (
  select *, row_number() over (partition by source order by doc_id, leaf) - 1 as i,
         count(*) over (partition by source) as n, dense_rank() over (order by source nulls first) - 1 as s
  from d
), t as (
  select s, 0 as level, i, leaf as h, n from l
  union all
  select s, level + 1, i // 3, sha256(string_agg(h, '' order by i)), any_value((n + 2) // 3)
  from t where n > 1 group by s, level, i // 3
), u as (
  select 0 as level, s as i, h, (select count(*) from t where n = 1) as n from t where n = 1
  union all
  select level + 1, i // 3, sha256(string_agg(h, '' order by i)), any_value((n + 2) // 3)
  from u where n > 1 group by level, i // 3
), x as (  -- the nodes on the way up of each leaf, levels of both trees one after the other
  select l.s, l.i, t.level, t.i as at, t.n, false as top from l join t on t.s = l.s and t.i = l.i // pow(3, t.level)::bigint
  union all
  select l.s, l.i, 1000 + u.level, u.i, u.n, true from l join u on u.i = l.s // pow(3, u.level)::bigint
), k as (
  select s, level, i, h, false as top from t union all select 0, 1000 + level, i, h, true from u
), p as (
  select x.s, x.i, x.level, coalesce(string_agg(k.h, '' order by k.i) filter (k.i < x.at), '') as a,
         coalesce(string_agg(k.h, '' order by k.i) filter (k.i > x.at), '') as b
  from x left join k on k.top = x.top and (x.top or k.s = x.s) and k.level = x.level and k.i // 3 = x.at // 3 and k.i <> x.at
  where x.n > 1 group by all
), q as (
  select s, i, sha256(coalesce(string_agg(a || b, '' order by level), '')) as proof, list(struct_pack(a := a, b := b) order by level) as steps
  from p group by all
), r as (
  select l.*, coalesce(proof, sha256('')) as proof_sha256, coalesce(steps, []) as steps from l left join q using (s, i)
)
select doc_id, leaf, (select h from t where t.s = r.s and t.n = 1) as subroot, (select h from u where n = 1) as root, proof_sha256,
       list_reduce([now] || list_transform(steps, lambda z: z.a || chr(10) || z.b),
         lambda acc, z: sha256(split_part(z, chr(10), 1) || acc || split_part(z, chr(10), 2))) as folded_root,
       list_reduce([now] || list_transform(steps, lambda z: z.a || chr(10) || z.b),
         lambda acc, z: sha256(split_part(z, chr(10), 1) || acc || split_part(z, chr(10), 2))) = (select h from u where n = 1) as verified
from r
"""

PHRASES = r"""
with d as (
  select coalesce(lang, 'und') as lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t
  from documents
), s as (
  select lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) as s from d
), w as (
  select lang, regexp_extract_all(s, '[^\x20\x09]+') as w from s
), g as (
  select lang, k, array_to_string(w[i : i + k - 1], ' ') as phrase
  from (select *, unnest(range(1, len(w) - k + 2)) as i from (select *, unnest([1, 2, 3, 4]) as k from w) where len(w) >= k)
), f as (
  select lang, k, phrase, count(*) as a from g group by all
), c as (
  select *, string_split(phrase, ' ') as w from f where k > 1 and a >= 30
), halves as (
  select lang, phrase, a, j, array_to_string(w[1 : j], ' ') as head, array_to_string(w[j + 1 : k], ' ') as rest
  from (select *, unnest(range(1, k)) as j from c)
), cuts as (
  select h.lang, h.phrase, h.a, j, l.a as l, r.a as r, (2000000::hugeint * h.a // (l.a + r.a))::bigint as score
  from halves h join f l on l.lang = h.lang and l.phrase = h.head join f r on r.lang = h.lang and r.phrase = h.rest
), best as (
  select *, row_number() over (partition by lang, phrase order by score, j) as nth from cuts
), within as (
  select lang, array_to_string(w[i : i + n - 1], ' ') as phrase, max(a) as longer
  from (select *, unnest(range(1, k - n + 2)) as i from (select *, unnest(range(2, k)) as n from c)) group by 1, 2
), kept as (
  select b.* from best b left join within x using (lang, phrase)
  where nth = 1 and (longer is null or 100::hugeint * longer < 80::hugeint * a)
), ranked as (
  select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept
), n as (
  select lang, sum(a)::bigint as n from f where k = 1 group by lang
)
select lang, rank, phrase, a, l, r, n, score from ranked join n using (lang) where rank <= 2000
"""
