"""DuckDB equivalents of the queries that SQL can express."""

from __future__ import annotations

SQL: dict[str, str] = {}

LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

SQL["op3_line_dedup"] = f"""
with docs as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
lines as (
  select rid, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as pos from docs),
keyed as (select *, {LOWERED.format(f"trim(line, {BLANKS})")} as key from lines),
repeated as (select key from keyed where key <> '' group by key having count(distinct rid) >= 10),
kept as (
  select rid, count(*) as n_lines, count(*) filter (r.key is not null) as n_dropped,
         string_agg(line, chr(10) order by pos) filter (r.key is null) as text
  from keyed left join repeated r using (key) group by rid)
select doc_id, n_lines, n_dropped, sha256(coalesce(kept.text, '')) as kept_sha256
from docs join kept using (rid)"""

SHINGLED = f"""
docs as (select row_number() over () as rid, doc_id,
         regexp_extract_all({LOWERED.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') as w from documents),
shingled as (
  select rid, doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < %d then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - %d), lambda i: array_to_string(w[i:i + %d], ' ')) end) as s from docs)"""


def near_duplicate_sql(size: int, num: int, den: int) -> str:
    """doc_id, n_shingles, component_id and kept of every row, by all pairs that share a shingle."""
    return f"""
with recursive {SHINGLED % (size, size - 2, size - 1)},
one as (select rid, len(s) as n, unnest(s) as sh from shingled),
common as (
  select a.rid as a, b.rid as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as k
  from one a join one b on a.sh = b.sh and a.rid < b.rid group by 1, 2),
links as (select a, b from common where {den} * k >= {num} * (na + nb - k)),
both_ways as (select a, b from links union all select b, a from links),
reach as (select rid as a, rid as b from docs union select reach.a, l.b from reach join both_ways l on l.a = reach.b),
component as (select reach.a as rid, min(d.doc_id) as component_id from reach join docs d on d.rid = reach.b group by 1)
select s.doc_id, len(s.s) as n_shingles, c.component_id, s.doc_id = c.component_id as kept
from shingled s join component c using (rid)"""


SQL["op9_chosen_path"] = near_duplicate_sql(3, 85, 100)


# crc32 of decimal digits, bit by bit; 3988292384 is the reflected polynomial.
CRC32 = """xor(4294967295, list_reduce(list_transform(string_split({}, ''), lambda d: cast(ascii(d) as ubigint)),
  lambda crc, byte: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, xor(crc, byte)),
  cast(4294967295 as ubigint)))"""


def _leaf(text: str) -> str:
    part = "coalesce(strlen({0}) || ':' || {0}, '-')"
    return "sha256(" + " || ".join(part.format(f"cast({c} as varchar)") for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


SQL["op11_merkle_climb"] = f"""
with recursive
rows0 as (select doc_id, lang, {_leaf("text")} as leaf,
  case when doc_id is not null and {CRC32.format("cast(coalesce(doc_id, 0) as varchar)")} % 3 = 0 then {_leaf(LOWERED.format("text"))} end as other from documents),
langs as (select lang, count(*) as n, row_number() over (order by lang nulls first) - 1 as t from rows0 group by lang),
leaves as (select r.*, l.t, row_number() over (partition by l.t order by doc_id nulls first, leaf) - 1 as pos
  from rows0 r join langs l on r.lang is not distinct from l.lang),
built as (
  select t, 0 as level, pos, leaf as digest, n from leaves join langs using (t)
  union all
  select t, level + 1, pos // 8, sha256(string_agg(digest, '' order by pos)), (n + 7) // 8 from built where n > 1 group by t, level, pos // 8, n),
subroots as (select t, level as height, digest from built where n = 1),
tops as (
  select 0 as level, t as pos, digest, (select count(*) from langs) as n from subroots
  union all
  select level + 1, pos // 8, sha256(string_agg(digest, '' order by pos)), (n + 7) // 8 from tops where n > 1 group by level, pos // 8, n),
sides as (
  select b.t, b.level, b.pos, coalesce(string_agg(s.digest, '' order by s.pos) filter (s.pos < b.pos), '') as left_,
         coalesce(string_agg(s.digest, '' order by s.pos) filter (s.pos > b.pos), '') as right_
  from built b join built s on s.t = b.t and s.level = b.level and s.pos // 8 = b.pos // 8 where b.n > 1 group by 1, 2, 3),
top_sides as (
  select b.level, b.pos, coalesce(string_agg(s.digest, '' order by s.pos) filter (s.pos < b.pos), '') as left_,
         coalesce(string_agg(s.digest, '' order by s.pos) filter (s.pos > b.pos), '') as right_
  from tops b join tops s on s.level = b.level and s.pos // 8 = b.pos // 8 where b.n > 1 group by 1, 2),
climb as (
  select l.t, l.pos as leaf_pos, 0 as level, l.pos, coalesce(other, leaf) as fold, '' as proof from leaves l
  union all
  select c.t, c.leaf_pos, c.level + 1, c.pos // 8, sha256(s.left_ || c.fold || s.right_), c.proof || s.left_ || s.right_
  from climb c join sides s on s.t = c.t and s.level = c.level and s.pos = c.pos),
over_ as (
  select c.t, c.leaf_pos, 0 as level, c.t as pos, c.fold, c.proof from climb c join subroots s on s.t = c.t and s.height = c.level
  union all
  select o.t, o.leaf_pos, o.level + 1, o.pos // 8, sha256(s.left_ || o.fold || s.right_), o.proof || s.left_ || s.right_
  from over_ o join top_sides s on s.level = o.level and s.pos = o.pos),
root as (select level, digest from tops where n = 1)
select l.doc_id, l.leaf, s.digest as subroot, r.digest as root, sha256(o.proof) as proof_sha256, o.fold as folded_root, o.fold = r.digest as verified
from leaves l join subroots s using (t) join over_ o on o.t = l.t and o.leaf_pos = l.pos join root r on r.level = o.level"""


SQL["op12_hyperplane_dedup"] = """
with recursive vectors as (
  select row_number() over () as rid, vec_id, cast(embedding as double[]) as e from embeddings),
usable as (
  select * from vectors where e is not null and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(e, lambda x: x <> 0)) > 0),
links as (
  select a.rid as a, b.rid as b from usable a join usable b on a.rid <> b.rid and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.95),
reach as (select rid as a, rid as b from vectors union select reach.a, l.b from reach join links l on l.a = reach.b),
component as (select reach.a as rid, min(v.vec_id) as component_id from reach join vectors v on v.rid = reach.b group by 1),
counted as (select a as rid, count(*) as n_links from links group by 1)
select v.vec_id, coalesce(n_links, 0) as n_links, component_id, coalesce(v.vec_id = component_id, false) as kept
from vectors v join component using (rid) left join counted using (rid)"""


SQL["op13_bond_negatives"] = """
with rows_ as (
  select row_number() over () as rid, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select a.rid as anchor, a.vec_id as anchor_id, b.rid, b.vec_id, a.label = b.label as same,
         cast(coalesce(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])), 0) as bigint) as score
  from rows_ a join rows_ b on a.vec_id % 50 = 0 and a.rid <> b.rid and len(a.v) = len(b.v)),
positives as (
  select * from scored where same qualify row_number() over (partition by anchor order by score desc, vec_id nulls last) <= 5),
fitting as (
  select p.anchor_id, p.vec_id as positive_id, p.score as positive_score, n.vec_id as negative_id, n.score as negative_score,
         row_number() over (partition by p.anchor, p.rid order by n.score desc, n.vec_id nulls last) as place
  from positives p join scored n on n.anchor = p.anchor and not n.same and 50 * p.score <= 100 * n.score and 100 * n.score <= 95 * p.score)
select anchor_id, positive_id, cast(place as integer) as rank, negative_id, positive_score, negative_score from fitting where place <= 3"""
