"""Checking SQL (DuckDB) of the training-data queries that SQL can say."""

from __future__ import annotations

from quillmark.llm import collocations, lines, mixing, topk

_WORDS = r"len(regexp_extract_all({}, '[^\x20\x09-\x0D]+'))"

LINE_DEDUP = f"""
with l as (
  select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents),
r as (
  select *, row_number() over w as i, sum(n) over w as c from (select *, {_WORDS.format('line')} as n from l) where n > 0
  window w as (partition by doc_id order by pos)),
ends as (
  select a.doc_id, a.i as a, min(b.i) as b from r a join r b on a.doc_id = b.doc_id and b.i between a.i and a.i + {lines.MIN_WORDS - 1}
    and b.c - a.c + a.n >= {lines.MIN_WORDS} group by a.doc_id, a.i
  union
  select b.doc_id, max(a.i), b.i from r b join r a on a.doc_id = b.doc_id and a.i between b.i - {lines.MIN_WORDS - 1} and b.i
    and b.c - a.c + a.n >= {lines.MIN_WORDS} group by b.doc_id, b.i),
runs as (
  select e.doc_id, min(r.pos) as p, max(r.pos) as q, string_agg(r.line, chr(10) order by r.i) as content
  from ends e join r on r.doc_id = e.doc_id and r.i between e.a and e.b group by e.doc_id, e.a, e.b),
later as (
  select * from (select *, min(doc_id * 10000000 + p) over (partition by content) as first from runs) where doc_id * 10000000 + p > first),
gone as (select distinct l.doc_id, l.pos from later x join l on l.doc_id = x.doc_id and l.pos between x.p and x.q)
select l.doc_id, count(*)::int as n_lines, count(g.pos)::int as n_removed,
  sha256(coalesce(string_agg(l.line, chr(10) order by l.pos) filter (g.pos is null), '')) as kept_sha256
from l left join gone g on g.doc_id = l.doc_id and g.pos = l.pos group by l.doc_id"""

TOP_K = f"""
with v as (select vec_id, list_transform(embedding, lambda c: floor({topk.SCALE} * c::double)) as x from embeddings),
s as (select q.vec_id as query_id, v.vec_id, list_inner_product(q.x, v.x)::bigint as score from v q join v on q.vec_id <> v.vec_id where q.vec_id % 50 = 0)
select query_id, rank::int as rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= {topk.TOP}"""

_W = mixing.WEIGHTS
SOURCE_MIX = f"""
with sized as (
  select doc_id, source, {_WORDS.format("coalesce(text, '')")} as size,
    (('0x' || substr(md5('{mixing.SEED}:' || doc_id::varchar), 1, 13))::bigint + 0.5::double) / {2**52}::double as u from documents),
src as (
  select source, sum(size)::double as s, [{_W[0]}, {_W[1]}, {_W[2]}][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double as w
  from sized group by source),
lv as (
  select *, {mixing.MOST_COPIES} * s as cap, ({mixing.TOTAL_SHARE} * sum(s) over () - coalesce(sum({mixing.MOST_COPIES} * s) over (o rows between unbounded preceding and 1 preceding), 0))
    / sum(w) over (o rows between current row and unbounded following) as level
  from src window o as (order by {mixing.MOST_COPIES} * s / w, source nulls last)),
tg as (select source, s, case when cap / w <= level then cap else least(cap, w * max(case when cap / w > level then level end) over ()) end as target from lv),
e as (
  select d.*, t.s, t.target, floor(case when t.s > 0 then least({mixing.MOST_COPIES}, t.target / t.s) else 0 end) as whole,
    case when t.s > 0 then least({mixing.MOST_COPIES}, t.target / t.s) else 0 end as x
  from sized d join tg t on t.source is not distinct from d.source),
ranked as (
  select *, case when x - whole > 0 then u * (1 - (x - whole)) / (u * (1 - (x - whole)) + (x - whole) * (1 - u)) else 1 end as rank,
    case when whole < {mixing.MOST_COPIES} then size else 0 end as room from e),
filled as (
  select *, round(target) - sum(whole * size) over (partition by source) as open,
    coalesce(sum(room) over (partition by source order by rank, doc_id, size rows between unbounded preceding and 1 preceding), 0) as before from ranked)
select doc_id, size::bigint as size, s::bigint as source_size, target, (whole * size + greatest(0, least(room, open - before)))::bigint as taken from filled"""

JACCARD_JOIN = r"""
with w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
g as (
  select distinct doc_id, shingle from (
    select doc_id, unnest(list_transform(range(1, greatest(len(ws) - 4, 1) + 1), lambda i: array_to_string(ws[i:i + 4], ' '))) as shingle from w where len(ws) > 0)),
n as (select doc_id, count(*) as n from g group by doc_id),
pairs as (
  select a.doc_id as a, b.doc_id as b, count(*) as k from g a join g b on a.shingle = b.shingle and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
links as (
  select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 80 * (x.n + y.n - k)),
e as materialized (select a, b from links union select b, a from links),
reach as (
  with recursive t(doc_id, other) as (
    select doc_id, doc_id from documents union select t.doc_id, e.b from t join e on e.a = t.other)
  select doc_id, min(other) as component_id from t group by doc_id)
select d.doc_id, coalesce(n.n, 0) as n_shingles, r.component_id from documents d left join n using (doc_id) join reach r using (doc_id)"""

COLLOCATIONS = rf"""
with p as (
  select row_number() over () as piece, coalesce(lang, 'und') as lang, regexp_extract_all(part, '[^\x20\x09]+') as w from (
    select lang, unnest(string_split_regex(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as part from documents)),
g as (
  select lang, k::bigint as k, unnest(list_transform(range(1, len(w) - k::bigint + 2), lambda i: array_to_string(w[i:i + k::bigint - 1], ' '))) as phrase
  from p, range(1, {collocations.LONGEST + 1}) s(k) where len(w) >= k),
f as materialized (select lang, k, phrase, count(*) as f from g group by all),
n as (select lang, sum(f)::bigint as n from f where k = 1 group by lang),
c as materialized (select lang, k, phrase, f as a, string_split(phrase, ' ') as w from f where k > 1 and f >= {collocations.SUPPORT}),
cuts as (
  select lang, phrase, k, a, t.cut::bigint as cut, array_to_string(w[1:t.cut::bigint], ' ') as x, array_to_string(w[t.cut::bigint + 1:k], ' ') as y
  from c, range(1, {collocations.LONGEST}) t(cut) where t.cut < k),
scored as (
  select cuts.lang, cuts.phrase, cuts.a, n.n, cuts.cut, fx.f as l, fy.f as r, ((1000::hugeint * cuts.a * n.n) // (fx.f::hugeint * fy.f)) as score
  from cuts join f fx on fx.lang = cuts.lang and fx.phrase = x join f fy on fy.lang = cuts.lang and fy.phrase = y join n on n.lang = cuts.lang),
best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
held as (
  select lang, array_to_string(w[i::bigint:i::bigint + size::bigint - 1], ' ') as phrase, max(a) as longer
  from c, range(2, {collocations.LONGEST}) s(size), range(1, {collocations.LONGEST}) t(i) where size < k and i + size - 1 <= k group by all),
kept as (select best.* from best left join held using (lang, phrase) where longer is null or 100 * longer < 100 * a)
select lang, rank, phrase, a, l, r, n, score::bigint as score from (
  select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept) where rank <= {collocations.TOP}"""

_FIELD = "coalesce(strlen({0}::varchar)::varchar || ':' || {0}::varchar, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{0}")) + ")"
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
    lambda acc, byte: list_reduce(list_prepend(xor(acc, byte), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))))"""


def _siblings(nodes: str, items: str, keep: str) -> str:
    """Left and right siblings of every item on every level: ``items`` has pos, ``nodes`` level, pos, h and their group."""
    return f"""select i.*, x.level, coalesce(string_agg(x.h, '' order by x.pos) filter (x.pos < i.pos // (3 ** x.level)::bigint), '') as lh,
      coalesce(string_agg(x.h, '' order by x.pos) filter (x.pos > i.pos // (3 ** x.level)::bigint), '') as rh
    from {items} i join {nodes} x on {keep} and x.pos // 3 = i.pos // ((3 ** x.level) * 3)::bigint and x.n > 1 group by all"""


MERKLE = f"""
with recursive rows as materialized (
  select doc_id, source, {_LEAF.format('text')} as leaf,
    case when ({_CRC}) % 2 = 0 then {_LEAF.format("replace(text, chr(10), '')")} else {_LEAF.format('text')} end as start,
    row_number() over (partition by source order by doc_id) - 1 as pos from documents),
nodes as (
  select 0::bigint as level, source, pos, leaf as h, count(*) over (partition by source) as n from rows
  union all
  select level + 1, source, pos // 3, sha256(string_agg(h, '' order by pos)), ceil(n / 3)::bigint from nodes where n > 1 group by level, source, pos // 3, n),
sub as materialized (select source, h, row_number() over (order by source nulls first) - 1 as pos, count(*) over () as n from nodes where n = 1),
top as (
  select 0::bigint as level, pos, h, n from sub
  union all
  select level + 1, pos // 3, sha256(string_agg(h, '' order by pos)), ceil(n / 3)::bigint from top where n > 1 group by level, pos // 3, n),
own as ({_siblings('nodes', 'rows', 'x.source is not distinct from i.source')}),
upper as ({_siblings('top', 'sub', 'true')}),
way as materialized (
  select doc_id, level, lh, rh from own
  union all
  select r.doc_id, (select coalesce(max(level), 0) from nodes) + 1 + u.level, u.lh, u.rh from rows r join upper u on u.source is not distinct from r.source),
steps as materialized (select *, row_number() over (partition by doc_id order by level) as k from way),
folded as (
  select doc_id, 0::bigint as k, start as h from rows
  union all
  select f.doc_id, s.k, sha256(s.lh || f.h || s.rh) from folded f join steps s on s.doc_id = f.doc_id and s.k = f.k + 1),
ends as (select doc_id, arg_max(h, k) as folded_root from folded group by doc_id),
proofs as (select doc_id, sha256(string_agg(lh || rh, '' order by k)) as proof_sha256 from steps group by doc_id)
select r.doc_id, r.leaf, sub.h as subroot, t.h as root, coalesce(p.proof_sha256, sha256('')) as proof_sha256, e.folded_root, e.folded_root = t.h as verified
from rows r join sub on sub.source is not distinct from r.source join (select h from top where n = 1) t on true join ends e using (doc_id) left join proofs p using (doc_id)"""

ORACLES = {
    "op1_line_dedup": LINE_DEDUP,
    "op4_top_k_search": TOP_K,
    "op6_source_mix": SOURCE_MIX,
    "op9_jaccard_join": JACCARD_JOIN,
    "op12_collocations": COLLOCATIONS,
    "op13_merkle_manifest": MERKLE,
}
