"""SQL equivalents of the registered queries, over the given tables."""

from __future__ import annotations

from ..functions.text import ABBREVIATIONS, LIGATURES, STOPWORDS
from .views import DOCUMENT_RULES, KNEE_SENTENCES

SQL: dict[str, str] = {}

# ---- shared table expressions -------------------------------------------------------------------

ORDERS = """
orders_w as (
  select cast(o_orderkey as varchar) as case_id, o_custkey as customer,
         case o_orderstatus when 'F' then 1.0::double when 'O' then 0.0::double end as filled,
         case when cast(left(o_orderpriority, 1) as int) <= 2 then 1.0::double
              when cast(left(o_orderpriority, 1) as int) >= 4 then 0.0::double end as urgent
  from orders),
truth as (
  select case_id, 'filled' as label, filled as y from orders_w
  union all select case_id, 'urgent', urgent from orders_w)"""

PREDICTIONS = """
per_order as (
  select cast(l_orderkey as varchar) as case_id, count(*) as n,
         sum(cast(round(l_discount * 100) as bigint)) as disc,
         sum(case when l_quantity > 10 then cast(l_quantity as bigint) end) as qty,
         sum(case when l_tax > 0 then cast(round(l_tax * 100) as bigint) end) as tax
  from lineitem group by 1),
per_source as (
  select 'disc' as source, case_id, cast(disc as double) / (n * 10.0::double) as p from per_order
  union all select 'qty', case_id, cast(qty as double) / (n * 50.0::double) from per_order
  union all select 'tax', case_id, cast(tax as double) / (n * 8.0::double) from per_order),
preds as (
  select source, case_id, 'filled' as label, p from per_source where p is not null
  union all select source, case_id, 'urgent', 1 - p from per_source where p is not null)"""

SCORES = f"{ORDERS}, {PREDICTIONS}, scores as (select source, case_id, label, p, y from preds join truth using (case_id, label))"

_CURVES = """
hist as (
  select source, label, p, sum(case when y >= 0.5 then 1 else 0 end) as pos, sum(case when y < 0.5 then 1 else 0 end) as neg
  from scores where y is not null group by all),
curve as (
  select *, coalesce(sum(neg) over (partition by source, label order by p rows between unbounded preceding and 1 preceding), 0) as below,
         sum(pos) over (partition by source, label order by p desc rows between unbounded preceding and current row) as tp,
         sum(neg) over (partition by source, label order by p desc rows between unbounded preceding and current row) as fp,
         sum(pos) over (partition by source, label) as np, sum(neg) over (partition by source, label) as nn
  from hist),
auc as (
  select source, label, cast(max(np) + max(nn) as bigint) as n, cast(max(np) as bigint) as positives,
         case when max(np) > 0 and max(nn) > 0 then
           sum(pos * (below + neg / 2.0::double)) / (max(np)::double * max(nn)::double) end as auc,
         case when max(np) > 0 and max(nn) > 0 then sum(pos * tp / (tp + fp)::double) / max(np) end as ap,
         case when max(np) > 0 and max(nn) > 0 then max(2 * tp / (tp + fp + np)::double) end as best_f1,
         coalesce(2.0::double * sum(case when p >= 0.5 then pos else 0 end)
           / nullif(sum(case when p >= 0.5 then pos + neg else 0 end) + max(np), 0), 0) as f1_at_half
  from curve group by source, label)"""
HISTOGRAM = f"{SCORES}, {_CURVES}"

LIGATED = "text"
for _a, _b in LIGATURES.items():
    LIGATED = f"replace({LIGATED}, '{_a}', '{_b}')"
FOLDED = rf"""
folded as (
  select cast(doc_id as varchar) as case_id, lang,
    regexp_replace(regexp_replace(regexp_replace(lower(strip_accents({LIGATED})),
      '[ \t\r\f\x0B]+', ' ', 'g'), '\n\s*', chr(10), 'g'), '^\s+|\s+$', '', 'g') as folded
  from documents)"""

_EXPANDED = "folded"
for _a, _b in ABBREVIATIONS:
    _EXPANDED = f"regexp_replace({_EXPANDED}, '{_a}', '{_b.replace('$', chr(92))}', 'gi')"
# Marks next to a digit are set aside before the split and put back after it.
SENTENCES = rf"""{FOLDED},
marked as (
  select case_id, lang, {_EXPANDED} as t from folded),
shielded as (
  select case_id, lang, regexp_replace(regexp_replace(t, '([0-9])([.!?;])', '\1' || chr(1) || '\2' || chr(1), 'g'),
    '([.!?;])([0-9])', chr(1) || '\1' || chr(1) || '\2', 'g') as t from marked),
coded as (
  select case_id, lang, replace(replace(replace(replace(t, chr(1) || '.' || chr(1), chr(2)), chr(1) || '!' || chr(1), chr(3)),
    chr(1) || '?' || chr(1), chr(4)), chr(1) || ';' || chr(1), chr(5)) as t from shielded),
split as (
  select case_id, lang, list_filter(list_transform(string_split_regex(t, '[.!?;]\s*|\n+'),
    lambda s: trim(replace(replace(replace(replace(s, chr(2), '.'), chr(3), '!'), chr(4), '?'), chr(5), ';'), ' -•*' || chr(9))),
    lambda s: s <> '') as s from coded)"""


def _quoted(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_CUES = DOCUMENT_RULES.cues
_BEFORE = "list_slice({b}, coalesce(list_max(list_filter(range(1, len({b}) + 1), lambda k: list_contains(term, {b}[k]))), 0) + 1, len({b}))"
_STOP = "coalesce(list_min(list_filter(range(1, len(a{n}) + 1), lambda k: regexp_matches(g{n}[k], '[,(]') or list_contains(term, a{n}[k]))), 99)"
# All patterns of these rules are whole words, so hits and windows are lists of words.
HITS = rf"""{SENTENCES},
sent as (select case_id, unnest(s) as s from split),
words as (
  select case_id, regexp_extract_all(s, '[\p{{L}}\p{{N}}_]+') as w, string_split_regex(s, '[\p{{L}}\p{{N}}_]+') as gaps,
         {_quoted(_CUES.terminators)} as term from sent where regexp_matches(s, 'tion|heit|ment|cion|idiot|trash|worthless')),
placed as (
  select *, list_filter(range(1, len(w) + 1), lambda i: regexp_full_match(w[i], '[a-z]+(tion|heit|ment|cion)')) as anchors,
    list_filter(range(1, len(w) + 1), lambda i: list_contains(['the', 'der', 'les', 'los'], w[i])) as comps,
    list_filter(range(1, len(w) + 1), lambda i: list_contains(['idiot', 'trash', 'worthless'], w[i])) as toxic from words),
anchored as (
  select case_id, w, gaps, term, 'quality' as label, unnest(anchors) as i, comps from placed where len(comps) > 0
  union all select case_id, w, gaps, term, 'toxic', unnest(toxic), null from placed),
paired as (
  select *, case when label = 'toxic' then i else
    list_sort(list_transform(comps, lambda c: {{'d': abs(c - i), 'c': c}}))[1].c end as j from anchored),
bounded as (
  select case_id, label, w, gaps, term, i, j, least(i, j) as l, greatest(i, j) as r from paired where abs(i - j) <= 3),
windowed as (
  select *, list_slice(w, greatest(l - 6, 1), l - 1) as b6, list_slice(w, greatest(i - 6, 1), i - 1) as bi,
    list_slice(w, greatest(j - 6, 1), j - 1) as bj, list_slice(w, r + 1, r + 6) as a6, list_slice(gaps, r + 1, r + 6) as g6,
    list_slice(w, r + 1, r + 3) as a3, list_slice(gaps, r + 1, r + 3) as g3, list_slice(w, l, r) as inner_w from bounded),
cut as (
  select case_id, label, {_BEFORE.format(b="b6")} as b6, {_BEFORE.format(b="bi")} as bi, {_BEFORE.format(b="bj")} as bj,
    list_slice(a6, 1, {_STOP.format(n=6)} - 1) as a6, list_slice(a3, 1, {_STOP.format(n=3)} - 1) as a3, inner_w from windowed),
hits as (
  select case_id, label, case
    when list_has_any(b6, {_quoted(_CUES.uncertain)}) or list_has_any(a6, {_quoted(_CUES.uncertain)})
      or list_has_any(inner_w, {_quoted(_CUES.uncertain)}) then 'uncertain'
    when list_has_any(bi, {_quoted(_CUES.pre_negation)}) or list_has_any(bj, {_quoted(_CUES.pre_negation)})
      or list_has_any(a3, {_quoted(_CUES.post_negation)}) then 'negated'
    else 'affirmed' end as kind from cut)"""

TERMS = rf"""{FOLDED},
blank as (select case_id, unnest(list_filter(string_split_regex(folded, '\s+'), lambda x: x <> '')) as word from folded),
padded as (select case_id, ' ' || word || ' ' as word, count(*) as k from blank group by all),
grams as (select case_id, word, k, unnest(range(2, least(5, length(word)) + 1)) as n from padded),
pieces as (select case_id, word, k, n, unnest(range(1, length(word) - n + 2)) as i from grams),
plain as (select case_id, regexp_extract_all(folded, '[\p{{L}}\p{{N}}_]{{2,}}') as w from folded),
word_terms as (
  select case_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as term from plain),
counts as (
  select case_id, 'c' as block, substring(word, i, n) as term, sum(k) as tf from pieces group by all
  union all select case_id, 'w', term, count(*) from word_terms group by all),
seen as (
  select block, term, count(*) as df, sum(tf) as total from counts group by all having count(*) >= 2),
ranked as (
  select *, row_number() over (partition by block order by total desc, term) as place,
    ln((1 + (select count(*) from documents)::double) / (1 + df)) + 1 as idf from seen),
vocabulary as (select * from ranked where place <= case block when 'c' then 200000 else 100000 end)"""

HEADERS = """
headers as (
  select cast(user_id as varchar) as case_id, event_type as series_id, lpad(cast(event_id as varchar), 12, '0') as path,
    cast(event_id % 97 as int) as instance_number, event_id, floor(cast(round(value * 100) as bigint) / 500.0::double) as place,
    not (event_type = 'click' and event_id % 40 = 0) as has_position,
    case event_type when 'view' then 'sagittal' when 'click' then 'coronal' when 'error' then 'axial' when 'purchase' then 'sagittal' end as plane,
    case event_type when 'click' then 2 when 'error' then 3 when 'signup' then 0 else 1 end as along,
    case when event_id % 10 = 0 then 256 else 512 end as rows, 512 as cols, event_id % 53 <> 0 as readable,
    case when event_id % 2 = 0 then 'explicit' else 'implicit' end as transfer_syntax
  from events)"""

ORDERED = f"""{HEADERS},
sizes as (
  select case_id, series_id, rows, count(*) as n, min(path) as first from headers where readable group by all),
size as (
  select case_id, series_id, rows from sizes qualify row_number() over (partition by case_id, series_id order by n desc, first) = 1),
fitting as (
  select h.*, h.rows = s.rows as fits from headers h join size s using (case_id, series_id) where readable),
facts as (
  select case_id, series_id, bool_and(has_position) and max(plane) is not null as placed from fitting where fits group by all),
keyed as (
  select f.*, case when placed then place * along else instance_number::double end as key
  from fitting f join facts using (case_id, series_id) where fits),
judged as (
  select *, has_position and row_number() over (partition by case_id, series_id, key order by path) > 1 as repeated from keyed)"""

SERIES = f"""{HEADERS},
listed as (
  select distinct cast(user_id as varchar) as case_id, event_type as series_id,
    case when event_type in ('view', 'purchase') then 1 else 0 end as fluid, cast(user_id % 2 as int) as fatsat,
    case event_type when 'view' then 'sagittal' when 'signup' then 'coronal' when 'purchase' then 'axial' end as plane
  from events where value > 5
  union all select cast(c_custkey as varchar), 'survey', 0, 1, 'axial' from customer),
stored as (select case_id, series_id, count(*) as n_files, max(plane) as inferred from headers group by all),
series as (
  select case_id, series_id, coalesce(fluid, 0) as fluid, coalesce(fatsat, 0) as fatsat, coalesce(l.plane, s.inferred) as plane,
    l.fluid is not null as listed, s.n_files is not null as on_disk, coalesce(n_files, 0) as n_files
  from listed l full outer join stored s using (case_id, series_id)),
usable as (
  select *, 2 * fluid + fatsat as q, -abs(n_files - 30) as d from series where on_disk and n_files > 0 and plane is not null),
main_routes as (
  select case_id, plane as key, series_id from usable
  qualify row_number() over (partition by case_id, plane order by q desc, d desc, n_files desc, series_id desc) = 1),
t1_routes as (
  select case_id, plane || '_t1' as key, series_id from usable where fluid = 0
  qualify row_number() over (partition by case_id, plane order by q desc, d desc, n_files desc, series_id desc) = 1),
routes as (select * from main_routes union all select * from t1_routes)"""

MANIFEST = f"""{SERIES},
saved as (select case_id, series_id, count(*) as n from headers where readable and rows = 512 group by all),
log as (
  select case_id, key, series_id, coalesce(n, 0) as n_saved_slices,
    case when n is null or cast(case_id as bigint) % 17 = 0 then 'DecodeError: no slice could be decoded' end as error
  from routes left join saved using (case_id, series_id)),
studies as (
  select case_id, count(*) filter (listed) as n_series_listed, count(*) filter (on_disk) as n_series_stored,
    case when cast(case_id as bigint) % 29 = 0 then 'FileNotFoundError' end as study_error from series group by all),
per_case as (
  select case_id, """ + ", ".join(f"""
    max(case when key = '{p}' then case when error is null then 1 else 0 end end) as has_{p},
    max(case when key = '{p}' and error is null then n_saved_slices end) as n_slices_{p},
    max(case when key = '{p}' then series_id end) as {p}_series""" for p in ("sagittal", "coronal", "axial")) + """,
    count(*) filter (error is not null) as n_series_errors from log group by all),
manifest as (
  select case_id, n_series_listed, n_series_stored, study_error, """ + ", ".join(
    f"coalesce(has_{p}, 0) as has_{p}, coalesce(n_slices_{p}, 0) as n_slices_{p}, {p}_series"
    for p in ("sagittal", "coronal", "axial")) + """, coalesce(n_series_errors, 0) as n_series_errors
  from studies left join per_case using (case_id))"""

VOLUMES = """
vol as (
  select cast(label // 3 as varchar) as case_id, cast(label as varchar) as series_id,
    ['sagittal', 'coronal', 'axial'][label % 3 + 1] as plane, vec_id, label,
    row_number() over (partition by label order by vec_id) - 1 as slice_idx, embedding as px from embeddings)"""

PIXELS = f"{VOLUMES}, pix as (select case_id, series_id, plane, vec_id, slice_idx, unnest(range(64)) as i, unnest(px)::double as v from vol)"


def _frames(source: str, value: str = "v", index: str = "i") -> str:
    return (f"select series_id, slice_idx, round(sum({value}), 4) as total, round(sum({value} * {index}), 3) as weighted "
            f"from {source} group by series_id, slice_idx")


BOUNDS = """
floors as (select series_id, min(v) as mn, count(*) as n from pix group by all),
fore as (select series_id, count(*) filter (v > mn) as m from pix join floors using (series_id) group by all),
sample as (
  select p.series_id, v from pix p join floors using (series_id) join fore using (series_id) where m <= 100 or v > mn)"""


def _bounds(low: float, high: float) -> str:
    return (f"bounds as (select series_id, quantile_cont(v, {low}) as lo, quantile_cont(v, {high}) as hi from sample group by all)")


# ---- labels -------------------------------------------------------------------------------------

SQL["known_labels"] = """
select o_orderstatus, count(*) as cells, count(y) as known, sum(y) as positives from (
  select o_orderstatus, case when try_cast(left(o_orderpriority, 1) as double) in (0, 1)
    then try_cast(left(o_orderpriority, 1) as double) end as y from orders) group by 1"""
SQL["loaded_cases"] = """select cast(d.doc_id as varchar) as case_id, case when d.doc_id % 11 <> 0 then coalesce(length(text), 0) else 0 end::int as n_chars,
  quality, toxic, d.doc_id % 4 = 1 as held_out from documents d left join labels l on d.doc_id = l.doc_id"""
SQL["labeled_cases"] = """
select l.quality in (0, 1) is true or l.toxic in (0, 1) is true as is_labeled, count(*) as cases
from documents d left join labels l using (doc_id) group by 1"""
SQL["gold_view"] = f"with {ORDERS} select filled, urgent, count(*) as cases from orders_w group by all"
SQL["series_flags"] = """
select plane, fluid, fatsat, count(*) as n from (
  select case when event_type = 'view' then 'sagittal' when event_type = 'click' then 'axial' end as plane,
    case when value > 50 then 1 else 0 end as fluid, case when event_id % 3 = 1 then 1 else 0 end as fatsat from events) group by all"""
SQL["list_cases"] = f"""with {SERIES}, {ORDERS}
select count(*) as cases, min(case_id) as first, max(case_id) as last from (
  select case_id from listed union select case_id from orders_w)"""
SQL["ordered_cases"] = f"""with {SERIES}, {ORDERS}, ids as (select case_id from listed union select case_id from orders_w)
select case_id, row_number() over (order by case_id) - 1 as place from ids"""
SQL["duplicate_ids"] = "select l_orderkey as case_id, count(*) as n from lineitem group by 1 having count(*) > 1"

MERGED = f"""{ORDERS}, {PREDICTIONS},
cells as (
  select t.case_id, t.label, y, coalesce(y, case when p is not null then greatest(0, least(1, p)) end) as v,
    abs(2 * coalesce(y, case when p is not null then greatest(0, least(1, p)) end) - 1) as conf
  from truth t left join preds p on t.case_id = p.case_id and t.label = p.label and source = 'disc'),
merged as (
  select case_id, max(case when label = 'filled' then v end) as filled, max(case when label = 'urgent' then v end) as urgent,
    max(case when label = 'filled' then (y is not null)::int end) as filled__true,
    max(case when label = 'urgent' then (y is not null)::int end) as urgent__true,
    case when count(y) = count(*) then 'true' when count(y) = 0 then 'pseudo' else 'mixed' end as label_source,
    avg(case when y is null then conf end) as pseudo_confidence,
    avg(case when y is not null then 1.0 else coalesce(0.5 * conf, 0) end) as sample_weight from cells group by 1)"""
SQL["merged_labels"] = f"""with {MERGED}
select case_id, round(filled, 6) as filled, round(urgent, 6) as urgent, filled__true, urgent__true, label_source,
  round(pseudo_confidence, 6) as pseudo_confidence, round(sample_weight, 6) as sample_weight from merged"""
SQL["weighted_cases"] = f"""with {MERGED}
select case_id, round(case when customer % 2 = 0 then sample_weight else 1.0 end, 6) as sample_weight
from orders_w left join merged using (case_id)"""
SQL["shape_gaps"] = f"""with {ORDERS}, {PREDICTIONS}
select case_id, label from truth except select case_id, label from preds where source = 'qty'
union all (select case_id, label from preds where source = 'qty' except select case_id, label from truth)"""
SQL["prevalence"] = f"""with {MERGED}
select label, count(y) as true_n, round(avg(y), 6) as true_prevalence, count(*) filter (y is null and v is not null) as pseudo_n,
  round(avg(case when y is null then v end), 6) as pseudo_mean_prob,
  round(avg(case when y is null and v is not null then (v >= 0.5)::int end), 6) as pseudo_prevalence_at_half from cells group by 1"""
SQL["leakage_problems"] = f"""with {MERGED},
damaged as (
  select case_id, case when cast(case_id as bigint) % 11 = 0 then 1.5 else filled end as filled, urgent, filled__true,
    case when cast(case_id as bigint) % 13 = 0 then 0 else urgent__true end as urgent__true from merged),
both_sides as (
  select d.case_id as ours, o.case_id as theirs, d.filled as vf, d.urgent as vu, d.filled__true as ff, d.urgent__true as fu,
    o.filled as yf, o.urgent as yu from damaged d full outer join orders_w o on d.case_id = o.case_id),
found as (
  select 'case set differs from the training cases' as problem, count(*) as n from both_sides where ours is null or theirs is null
  union all select 'label values outside [0, 1] or missing', count(*) from both_sides
    where ours is not null and not coalesce(vf between 0 and 1 and vu between 0 and 1, false)
  union all select 'ground-truth labels were overwritten', count(*) from both_sides where ours is not null and theirs is not null
    and ((yf is not null and vf is distinct from yf) or (yu is not null and vu is distinct from yu))
  union all select 'truth flags do not match ground-truth availability', count(*) from both_sides where ours is not null and theirs is not null
    and ((ff <> 0) <> (yf is not null) or (fu <> 0) <> (yu is not null))
  union all select 'held-out cases present', count(*) from damaged where case_id in (select cast(c_custkey as varchar) from customer))
select problem, n from found where n > 0"""
SQL["class_weights"] = f"""with {ORDERS}
select label, count(y) as n, sum(y) as positives, round(greatest(1, least(20, (count(y) - sum(y)) / greatest(sum(y), 1))), 6) as pos_weight,
  round(count(y) / (2 * sum(y)), 6) as w1, round(count(y) / (2 * (count(y) - sum(y))), 6) as w0 from truth group by 1"""

# ---- text ---------------------------------------------------------------------------------------

SQL["folded_text"] = f"with {FOLDED} select case_id, length(folded)::int as n_chars, md5(folded) as digest from folded"
SQL["sentences"] = f"""with {SENTENCES}
select case_id, len(s)::int as n_sentences, md5(array_to_string(s, '|')) as digest from split"""
SQL["languages"] = f"""with {FOLDED},
w as (select case_id, unnest(regexp_extract_all(folded, '[a-z]+')) as w from folded),
votes as (select case_id, lang, rank, count(*) as n from w join (values {", ".join(
    f"('{lang}', {i}, '{word}')" for i, (lang, words) in enumerate(STOPWORDS.items()) for word in dict.fromkeys(words.split()))}) s(lang, rank, word)
  on w.w = s.word group by all),
best as (select case_id, lang from votes qualify row_number() over (partition by case_id order by n desc, rank) = 1)
select coalesce(b.lang, 'unk') as lang, count(*) as reports from folded f left join best b using (case_id) group by 1"""
SQL["bilingual_reports"] = """with b as (
  select cast(doc_id as varchar) as case_id,
    regexp_replace(text || chr(10) || chr(10) || case when lang <> 'en' then coalesce(reverse(text), '') else '' end, '^\\s+|\\s+$', '', 'g') as t from documents)
select case_id, length(t)::int as n_chars, md5(t) as digest from b"""
SQL["token_windows"] = """
with t as (select cast(doc_id as varchar) as case_id, string_split(text, ' ') as t from documents),
c as (select case_id, case when len(t) <= 64 then t else list_concat(t[1:48], t[len(t) - 15:len(t)]) end as t from t)
select case_id, len(t)::int as n_tokens, md5(array_to_string(t, ' ')) as digest from c"""
SQL["rule_hits"] = f"with {HITS} select case_id, label, kind, count(*) as n from hits group by all"
SQL["knee_findings"] = f"""with said(i, label, p) as (values {", ".join(
    f"({i}, '{label.replace(chr(39), chr(39) * 2)}', {p}::double)" for i, (_, found) in enumerate(KNEE_SENTENCES) for label, p in found.items())}),
picked as (
  select o_orderkey as k, o_orderkey % {len(KNEE_SENTENCES)} as i from orders
  union all select o_orderkey, (o_orderkey // 7) % {len(KNEE_SENTENCES)} from orders),
scores as (select k, label, max(p) as p from picked join said using (i) group by all)
select cast(k as varchar) as case_id, string_agg(label || '=' || case p when 1 then '1.0' else '0.5' end, ';' order by label) as found
from scores group by 1"""
SQL["rule_scores"] = f"""with {HITS}, s as (
  select case_id, label, max(case kind when 'affirmed' then 1.0 when 'uncertain' then 0.5 else 0.0 end)::double as v from hits group by all)
select f.case_id, coalesce(max(case when label = 'quality' then v end), 0) as quality,
  coalesce(max(case when label = 'toxic' then v end), 0) as toxic from folded f left join s using (case_id) group by 1"""
SQL["translated_reports"] = f"""with {SENTENCES},
done as (
  select f.case_id, case when s.lang in ('de', 'es') and len(s.s) > 0
    then array_to_string(list_transform(s.s, lambda x: s.lang || ':' || upper(x)), '. ') else folded end as t
  from folded f join split s using (case_id))
select case_id, length(t)::int as n_chars, md5(t) as digest from done"""
SQL["tfidf_vocabulary"] = f"""with {TERMS}
select block, length(term)::int as n, count(distinct term) as terms, count(*) as postings, sum(tf)::bigint as occurrences,
  round(sum(idf), 2) as idf_sum from counts join vocabulary using (block, term) group by all"""
SQL["tfidf_limited"] = f"""with {TERMS}
select block, term, df, total::bigint as total, round(idf, 6) as idf from ranked where place <= case block when 'c' then 700 else 150 end"""
SQL["tfidf_weights"] = f"""with {TERMS},
w as (select case_id, block, (1 + ln(tf)) * idf as w from counts join vocabulary using (block, term)),
unit as (select case_id, w / sqrt(sum(w * w) over (partition by case_id, block)) as u from w)
select case_id, count(*) as n_terms, round(sum(u), 6) as weight_sum, round(sum(u * u), 6) as squared from unit group by 1"""

# ---- metrics ------------------------------------------------------------------------------------

SQL["auc_per_label"] = f"with {HISTOGRAM} select source, label, n, positives, round(auc, 9) as auc from auc"
SQL["metrics_all_labels"] = f"""with {SCORES.replace("scores as", "all_scores as")},
cells as (
  select source, label, case when not (source = 'tax' and label = 'urgent') then y end as y,
    case when cast(case_id as bigint) % 10 > 1 then p end as p from all_scores),
scores as (select * from cells where p is not null), {_CURVES}
select k.source, k.label, coalesce(n, 0) as n, coalesce(positives, 0) as positives, round(auc, 6) as auc, round(ap, 6) as ap,
  round(coalesce(f1_at_half, 0), 6) as f1_at_half, round(best_f1, 6) as best_f1
from (select distinct source, label from cells) k left join auc using (source, label)"""
SQL["metric_report"] = f"""with {HISTOGRAM}
select 0 as line, '# Metrics' as value union all select 1, '' union all select 2, '| source | label | n | positives | auc |'
union all select 3, '|---|---|---|---|---|'
union all select cast(3 + row_number() over (order by source, label) as int), printf('| %s | %s | %d | %d | %.4f |', source, label, n, positives, auc) from auc"""
SQL["macro_auc"] = f"with {HISTOGRAM} select source, round(avg(auc), 9) as macro_auc from auc group by 1"
SQL["label_metrics"] = f"""with {HISTOGRAM}
select source, label, n, positives, round(auc, 6) as auc, round(ap, 6) as ap, round(f1_at_half, 6) as f1_at_half,
  round(best_f1, 6) as best_f1 from auc"""
SQL["source_comparison"] = f"""with {HISTOGRAM} select label, """ + ", ".join(
    f"round(max(case when source = '{s}' then {m} end), 6) as {s}_{m}"
    for s in ("disc", "qty", "tax") for m in ("auc", "f1_at_half", "best_f1")) + " from auc group by 1"
SQL["source_summary"] = f"""with {HISTOGRAM}
select source, round(avg(auc), 6) as auc, round(avg(ap), 6) as ap, round(avg(f1_at_half), 6) as f1_at_half,
  round(avg(best_f1), 6) as best_f1 from auc group by 1"""
SQL["hardest_cases"] = f"""with {SCORES},
r as (
  select label, y >= 0.5 as positive, case_id,
    row_number() over (partition by label, y >= 0.5 order by case when y >= 0.5 then p else -p end, case_id) as r
  from scores where y is not null and source = 'disc')
select label, string_agg(case_id, ';' order by r) filter (positive) as hardest_fn,
  string_agg(case_id, ';' order by r) filter (not positive) as hardest_fp from r where r <= 5 group by 1"""
SQL["oof_macro_auc"] = f"with {HISTOGRAM} select round(avg(auc), 9) as macro_auc from auc where source = 'tax'"
SQL["oof_errors"] = f"""with {HISTOGRAM},
r as (
  select label, y >= 0.5 as positive, case_id,
    row_number() over (partition by label, y >= 0.5 order by case when y >= 0.5 then p else -p end, case_id) as r
  from scores where y is not null and source = 'disc'),
hard as (
  select label, string_agg(case_id, ';' order by r) filter (positive) as hardest_fn,
    string_agg(case_id, ';' order by r) filter (not positive) as hardest_fp from r where r <= 5 group by 1)
select label, n as n_labeled, positives as n_pos, round(positives / n::double, 6) as prevalence, round(auc, 9) as auc, hardest_fn, hardest_fp
from auc join hard using (label) where source = 'disc'"""
SQL["error_table"] = f"""with {HISTOGRAM},
r as (
  select label, y >= 0.5 as positive, case_id,
    row_number() over (partition by label, y >= 0.5 order by case when y >= 0.5 then p else -p end, case_id) as r
  from scores where y is not null and source = 'disc'),
hard as (
  select label, string_agg(case_id, ';' order by r) filter (positive) as hardest_fn,
    string_agg(case_id, ';' order by r) filter (not positive) as hardest_fp from r where r <= 5 group by 1),
cells as (
  select label, p, 1 as kind, pos::bigint as n from hist where source = 'disc' and pos > 0
  union all select label, p, 0, neg::bigint from hist where source = 'disc' and neg > 0),
drawn as (
  select label, p, kind, rep, (((n >> (4 * level)) & 15) << (4 * level)) as mean,
    cast('0x' || left(md5(concat_ws(':', '0', label, cast(floor(p * 1e12) as bigint), rep, kind, level)), 13) as bigint) / 4503599627370496.0::double as u
  from cells, range(1, 201) a(rep), range(5) b(level) where ((n >> (4 * level)) & 15) > 0),
means as (select distinct mean from drawn),
wide as (select mean, unnest(range(cast(greatest(0, floor(mean - 10 * sqrt(mean) - 30)) as bigint), cast(ceil(mean + 10 * sqrt(mean) + 30) as bigint) + 1)) as k from means),
cdf as (select mean, k, sum(exp(k * ln(mean) - mean - lgamma(k + 1))) over (partition by mean order by k) as c from wide),
weights as (select label, p, rep, kind, sum(k) as w from drawn d asof join cdf c on d.mean = c.mean and d.u <= c.c group by all),
per_p as (select label, rep, p, coalesce(sum(w) filter (kind = 1), 0)::double as pos, coalesce(sum(w) filter (kind = 0), 0)::double as neg from weights group by all),
won as (select label, rep, pos, neg, pos * (coalesce(sum(neg) over (partition by label, rep order by p rows between unbounded preceding and 1 preceding), 0) + neg / 2) as won from per_p),
reps as (select label, rep, sum(won) / (sum(pos) * sum(neg)) as auc from won group by all having sum(pos) > 0 and sum(neg) > 0),
ci as (select label, quantile_cont(auc, 0.025) as lo, quantile_cont(auc, 0.975) as hi from reps group by 1)
select label, n as n_labeled, positives as n_pos, round(positives / n::double, 6) as prevalence, round(auc, 6) as auc,
  round(lo, 6) as ci_low, round(hi, 6) as ci_high, hardest_fn, hardest_fp
from auc join hard using (label) join ci using (label) where source = 'disc'"""
SQL["scoring_losses"] = f"""with {SCORES},
z as (
  select source, label, p as p0, y, ln(greatest(0.000001, least(0.999999, p)) / (1 - greatest(0.000001, least(0.999999, p)))) as z
  from scores where y is not null),
q as (select *, 1 / (1 + exp(-z)) as p, ln(1 + exp(-abs(z))) + greatest(-z, 0) as softplus from z),
l as (
  select source, label, p0, (0.25 * y + 0.75 * (1 - y)) * power(1 - (p * y + (1 - p) * (1 - y)), 2) * ((1 - y) * z + softplus) as focal,
    -((1 - p) * y * ln(greatest(p, 1e-8)) + power(1 - least(1 - p + 0.05, 1), 4) * (1 - y) * ln(greatest(least(1 - p + 0.05, 1), 1e-8))) as asl,
    (1 - y) * z + (1 + y) * softplus as bce from q)
select source, label, round(avg(focal), 6) as focal, round(avg(asl), 6) as asymmetric, round(avg(bce), 6) as bce,
  round(sum(focal * (0.5 + p0 / 2)) / sum(0.5 + p0 / 2), 6) as focal_weighted from l group by all"""

# ---- folds --------------------------------------------------------------------------------------

SQL["rarest_folds"] = f"""with {ORDERS},
rare as (select sum(filled) <= sum(urgent) as filled_first from orders_w),
keyed as (
  select case_id, case when filled_first then case when filled = 1 then 0 when urgent = 1 then 1 else -1 end
    else case when urgent = 1 then 1 when filled = 1 then 0 else -1 end end as stratum from orders_w, rare)
select case_id, cast((row_number() over (partition by stratum order by md5('42:' || case_id), case_id) - 1 + stratum + 1) % 5 as int) as fold
from keyed"""
SQL["split_cases"] = f"""with {ORDERS}
select case_id, customer, case when cast(case_id as bigint) % 5 = 2 then 'validation' else 'train' end as side from orders_w"""
SQL["fold_summary"] = f"""with {ORDERS}
select cast(customer % 5 as int) as fold, count(*) as studies, count(*) filter (filled is not null or urgent is not null) as labeled,
  count(*) filter (filled >= 0.5) as filled, count(*) filter (urgent >= 0.5) as urgent from orders_w group by 1"""
SQL["fold_balance"] = f"""with {ORDERS}
select measure, 5 as folds, n as total, true as balanced from (
  select 'studies' as measure, count(*) as n from orders_w union all select 'labeled', count(*) filter (filled is not null or urgent is not null) from orders_w
  union all select 'filled', count(*) filter (filled >= 0.5) from orders_w union all select 'urgent', count(*) filter (urgent >= 0.5) from orders_w)"""
SQL["given_folds"] = f"""with {ORDERS}
select case_id, cast(customer % 5 as int) as fold from orders_w where filled is not null or urgent is not null"""
SQL["leaking_groups"] = "select o_custkey as customer from orders group by 1 having count(distinct o_orderkey % 5) > 1"
SQL["shards"] = f"""with {ORDERS}, r as (select case_id, row_number() over (order by case_id) - 1 as r from orders_w)
select case_id from r where r % 3 = 1"""
SQL["first_cases"] = f"with {ORDERS} select case_id from orders_w order by case_id limit 100"
SQL["same_case_ids"] = f"""with {ORDERS}, {PREDICTIONS}, ids as (
  select 'lines' as t, cast(l_orderkey as varchar) as case_id from lineitem union select 'orders', case_id from orders_w
  union select source, case_id from preds),
pairs as (select * from (values ('lines', 'disc'), ('disc', 'qty'), ('lines', 'orders')) p(a, b))
select a || ' and ' || b as pair, not exists (
  select 1 from ids i where i.t in (a, b) group by i.case_id having count(*) < 2) as same from pairs"""
SQL["sampled_cases"] = f"with {ORDERS} select case_id from orders_w order by md5('7:' || case_id), case_id limit 100"

# ---- ensembling ---------------------------------------------------------------------------------

RANKED = f"""{PREDICTIONS},
rank0 as (
  select *, rank() over (partition by source, label order by p) as r, count(*) over (partition by source, label, p) as t,
    count(*) over (partition by source, label) as n from preds),
ranks as (select source, case_id, label, (r + (t - 1) / 2.0::double) / n as p from rank0)"""
SQL["rank_normalized"] = f"with {RANKED} select source, case_id, label, round(p, 9) as p from ranks"
SQL["rank_with_gaps"] = f"""with {PREDICTIONS},
known as (
  select *, rank() over (partition by source, label order by p) as r, count(*) over (partition by source, label, p) as t,
    count(*) over (partition by source, label) as n from preds where cast(case_id as bigint) % 10 <> 0)
select source, case_id, label, round((r + (t - 1) / 2.0::double) / n, 9) as p from known
union all select source, case_id, label, null from preds where cast(case_id as bigint) % 10 = 0"""
SQL["read_back_predictions"] = f"""with {PREDICTIONS}, w as (select distinct source, case_id from preds where source in ('disc', 'tax')),
l as (select unnest(['filled', 'urgent']) as label)
select w.source, w.case_id, l.label, round(p, 9) as p from w cross join l left join preds using (source, case_id, label)"""
SQL["logged_runs"] = """
select event_type as run, user_id % 5 as fold, round(max(value), 6) as best, arg_max(event_id, {'v': value, 'e': -event_id}) as epoch
from events group by all"""
SQL["alignment"] = f"""with {PREDICTIONS}, seen as (select distinct source, case_id from preds),
common as (select case_id from seen group by 1 having count(*) = 3)
select source, count(*) as cases, count(c.case_id) as used from seen left join common c using (case_id) group by 1"""
SQL["rank_blend"] = f"""with {RANKED}
select case_id, label, round(sum(case source when 'disc' then 0.5 else 0.25 end * p) / 0.75, 9) as p
from ranks where source in ('disc', 'qty') group by all having count(distinct source) = 2"""
SQL["spec_blend"] = f"""with {RANKED}
select case_id, label, round(sum(case source when 'disc' then 0.5 else 0.25 end * p), 9) as p
from ranks group by all having count(distinct source) = 3"""


def _greedy(predictions: str, sources: list[str]) -> str:
    """Greedy selection over ranks as a recursive query: a state has the picks so far, its trials add one pick of each source."""
    picks = ", ".join(f"c{i}" for i in range(len(sources)))
    every = " union all ".join(f"select {i} as i" for i in range(len(sources)))

    def trials(state: str) -> str:
        terms = " + ".join(f"(c{i} + cast(i = {i} as int)) * p{i}" for i in range(len(sources)))
        total = " + ".join(f"c{i}" for i in range(len(sources)))
        key = f"step, {picks}, reached, i"
        return f"""
        select *, row_number() over (order by m desc, i) as place from (select {key}, avg(auc) as m from (
          select {key}, label, sum(pos * (below + neg / 2.0::double)) / (sum(pos)::double * sum(neg)::double) as auc from (
            select *, coalesce(sum(neg) over (partition by i, label order by p rows between unbounded preceding and 1 preceding), 0) as below from (
              select {key}, label, p, sum(y)::bigint as pos, sum(1 - y)::bigint as neg from (
                select {key}, label, y, ({terms}) / ({total} + 1) as p from {state}, ({every}), cells) group by all)) group by all) group by all)"""

    grown = ", ".join(f"c{i} + cast(i = {i} as int) as c{i}" for i in range(len(sources)))
    wide = ", ".join(f"max(p) filter (source = '{s}') as p{i}" for i, s in enumerate(sources))
    whole = " and ".join(f"p{i} is not null" for i in range(len(sources)))
    none_picked = ", ".join(f"0 as c{i}" for i in range(len(sources)))
    weights = " ".join(f"when {i} then c{i}" for i in range(len(sources)))
    names = " ".join(f"when {i} then '{s}'" for i, s in enumerate(sources))
    total = " + ".join(f"c{i}" for i in range(len(sources)))
    return f"""with recursive {predictions},
cells as materialized (
  select w.*, t.y from (select case_id, label, {wide} from ranks group by all) w join truth t using (case_id, label) where {whole} and y is not null),
start as (select -1 as step, {none_picked}, 0.0::double as reached),
single as materialized ({trials("start")}),
state as (
  select 0 as step, {grown}, m as reached from single where place = 1
  union all
  select step + 1, {grown}, m from ({trials("state")}) where place = 1 and m > reached + 1e-6 and step < 30),
final as (select * from state order by step desc limit 1)
select case s.i {names} end as model, round(m, 9) as oof_macro_auc,
  round((select (case s.i {weights} end)::double / ({total}) from final), 9) as weight from single s
union all select 'ENSEMBLE', round(reached, 9), 1.0 from final"""


SQL["ensemble_weights"] = _greedy(f"{ORDERS}, {RANKED}", ["disc", "qty", "tax"])
SQL["greedy_weights"] = _greedy(f"""{ORDERS},
votes as (
  select source, case_id, label, cast('0x' || left(md5(source || ':' || label || ':' || case_id), 13) as bigint) / 4503599627370496.0::double
    + case when cast(case_id as bigint) % 3 = k and y = 1 then (k + 1) * 0.25::double else 0 end as p
  from truth, (values ('first', 0), ('second', 1), ('third', 2)) s(source, k)),
ranks as (
  select source, case_id, label, (rank() over (partition by source, label order by p) + (count(*) over (partition by source, label, p) - 1) / 2.0::double)
    / count(*) over (partition by source, label) as p from votes)""", ["first", "second", "third"])
SQL["mean_blend"] = f"""with {PREDICTIONS}
select case_id, label, round(sum(p) / 3.0, 9) as p from preds group by all having count(distinct source) = 3"""
SQL["view_mean"] = f"with {PREDICTIONS} select case_id, label, round(avg(p), 9) as p from preds group by all"
CHOSEN = f"""{HISTOGRAM},
chosen as (
  select label, case when max(positives) >= 5 and max(auc) is not null then
    arg_max(source, {{'a': auc, 'o': case source when 'disc' then 0 when 'qty' then -1 else -2 end}}) else 'disc' end as source
  from auc where auc is not null group by 1)"""
SQL["chosen_sources"] = f"with {CHOSEN} select label, source from chosen"
SQL["combined_sources"] = f"""with {CHOSEN}
select case_id, label, round(p, 9) as p from preds join chosen using (label, source)"""
SQL["source_candidates"] = f"""with {PREDICTIONS}, b as (
  select m.case_id, m.label, m.p, r.p as r from preds m join preds r
  on m.case_id = r.case_id and m.label = r.label and m.source = 'disc' and r.source = 'qty')
select 'model' as source, case_id, label, round(p, 9) as p from b
union all select 'blend', case_id, label, round(0.5 * p + 0.5 * r, 9) from b
union all select 'rules', case_id, label, round(r, 9) from b"""
SQL["assembled_result"] = f"""with {ORDERS}, {PREDICTIONS},
b as (select case_id, label, sum(p) / 2 as p from preds where source in ('disc', 'tax') group by all having count(distinct source) = 2),
w as (select case_id, max(case when label = 'filled' then p end) as f, max(case when label = 'urgent' then p end) as u from b group by 1),
m as (select avg(f) as f, avg(u) as u from w)
select o.case_id, round(greatest(0, least(1, coalesce(w.f, m.f, 0.5))), 9) as filled,
  round(greatest(0, least(1, coalesce(w.u, m.u, 0.5))), 9) as urgent from orders_w o left join w using (case_id), m"""
GAPS = f"""{PREDICTIONS},
gaps as (select source, case_id, label, case when cast(case_id as bigint) % 10 = 0 or (source = 'tax' and cast(case_id as bigint) % 7 = 1)
  or (source = 'qty' and label = 'urgent') then null else p end as p from preds),
gap_ranks as (select source, case_id, label, case when p is not null then
  (rank() over (partition by source, label order by p nulls last) + (count(*) over (partition by source, label, p) - 1) / 2.0::double)
  / count(p) over (partition by source, label) end as p from gaps)"""
SQL["unknown_ranks"] = f"with {GAPS} select source, case_id, label, round(p, 9) as p from gap_ranks"
SQL["unknown_blend"] = f"""with {GAPS}
select case_id, label, case when count(p) = 3 then round(sum(case source when 'disc' then 0.5 else 0.25 end * p), 9) end as p
from gap_ranks group by all having count(*) = 3"""
SQL["unknown_mean"] = f"with {GAPS} select case_id, label, case when count(p) = count(*) then round(avg(p), 9) end as p from gaps group by all"
SQL["unknown_result"] = f"""with {ORDERS}, {GAPS},
b as (select case_id, label, case when count(p) = 3 then sum(case source when 'disc' then 0.5 else 0.25 end * p) end as p
  from gaps group by all having count(*) = 3),
w as (select case_id, max(case when label = 'filled' then p end) as f, max(case when label = 'urgent' then p end) as u from b group by 1),
m as (select avg(f) as f, avg(u) as u from w)
select o.case_id, round(greatest(0, least(1, coalesce(w.f, m.f, 0.5))), 9) as filled,
  round(greatest(0, least(1, coalesce(w.u, m.u, 0.5))), 9) as urgent from orders_w o left join w using (case_id), m"""
SQL["run_summary"] = f"""with {HISTOGRAM},
named as (select label, positives, auc, case source when 'disc' then 'model' when 'qty' then 'rules' else 'final' end as source from auc),
means as (select avg(auc) filter (source = 'model') as model, avg(auc) filter (source = 'rules') as rules, avg(auc) filter (source = 'final') as final from named),
picked as (
  select label, case when max(positives) < 5 then 'rules' else arg_max(source, {{'a': auc, 'o': case source when 'model' then 0 else -1 end}}) end as source
  from named where source <> 'final' group by 1),
few as (select label from truth group by 1 having count(*) filter (y = 1) < 5)
select (select count(*) from orders_w) as n_cases, (select count(*) from orders_w where filled is not null or urgent is not null) as n_labeled,
  (select count(*) from orders_w where filled is null and urgent is null) as n_pseudo_labeled,
  (select coalesce(string_agg(label, ',' order by label), '') from few) as rule_only,
  (select '{{' || string_agg('"' || label || '":"' || source || '"', ',' order by label) || '}}' from picked) as chosen,
  round(model, 6) as auc_model, round(rules, 6) as auc_rules, round(final, 6) as auc_final, round(final - rules, 6) as gain, final > rules as final_beats_rules from means"""
SQL["result_problems"] = """
with r as (select o_orderkey as k, o_orderkey % 101 <> 0 as present, o_orderkey % 103 = 0 as swapped, o_orderkey % 107 = 0 as bad from orders),
f as (
  select 'rows without a counterpart' as problem, count(*) filter (not present) as n from r
  union all select 'ids out of order', count(*) filter (present and swapped) from r
  union all select 'scores not finite in [0, 1]', count(*) filter (present and bad) from r)
select problem, n from f where n > 0"""
SQL["usable_runs"] = """
with g as (
  select o_orderstatus as name, lpad(cast(o_orderkey as varchar), 10, '0') as path,
    'run' || (o_custkey % 50) || case when o_orderkey % 7 = 0 then '_smoke' else '' end as run, o_orderkey % 5 as fold from orders)
select name, path, run, fold from g where not ends_with(run, '_smoke')
qualify row_number() over (partition by name, run, fold order by path) = 1"""
SQL["leaderboard"] = """
with b as (select event_type as run, user_id % 5 as fold, max(value) as best from events group by all)
select run, count(distinct fold) as folds, round(avg(best), 6) as mean_score, round(max(best), 6) as best_score from b group by 1"""

# ---- series and volumes -------------------------------------------------------------------------

SQL["reconciled_series"] = f"with {SERIES} select * from series"
SQL["routed_series"] = f"with {SERIES} select case_id, key, series_id from routes"
SQL["majority_sizes"] = f"""with {HEADERS},
s as (select case_id, series_id, rows, cols, count(*) as n, min(path) as first from headers group by all)
select case_id, series_id, rows, cols from s qualify row_number() over (partition by case_id, series_id order by n desc, first) = 1"""
SQL["ordered_slices"] = f"""with {ORDERED}
select case_id, series_id, path, row_number() over (partition by case_id, series_id order by key, path) - 1 as slice_idx,
  plane as inferred_plane from judged where not repeated"""
SQL["dropped_slices"] = f"""with {ORDERED},
d as (
  select case_id, series_id, 'h' as why from headers where not readable
  union all select case_id, series_id, 's' from fitting where not fits
  union all select case_id, series_id, 'p' from judged where repeated)
select case_id, series_id, count(*) filter (why = 'h') as bad_header, count(*) filter (why = 's') as off_size,
  count(*) filter (why = 'p') as duplicate_position from d group by all"""
SQL["typed_headers"] = """
select event_type as series_id, 'unknown' as transfer_syntax, 512 as rows, 0 as cols,
  count(*) filter (event_id % 5 <> 0) as instances, count(*) filter (value <= 100) as positions, 0::bigint as orientations,
  count(*) as spacings, round(sum(case when value > 30 then value end), 3) as thickness from events group by 1"""
SQL["inferred_planes"] = f"with {HEADERS} select series_id, plane, count(*) as slices from headers group by all"
SQL["letterbox_layout"] = """
with f as (select p_partkey, (p_size + 1) * (p_retailprice / 1000) as ph, 40.0::double as pw from part),
s as (select p_partkey, greatest(1, least(64, cast(round_even(ph * (64.0::double / greatest(ph, pw)), 0) as int))) as new_h,
  greatest(1, least(64, cast(round_even(pw * (64.0::double / greatest(ph, pw)), 0) as int))) as new_w from f)
select p_partkey, new_h, new_w, (64 - new_h) // 2 as top, (64 - new_w) // 2 as left from s"""
SQL["decode_report"] = f"""with {HEADERS}
select transfer_syntax, count(*) as files, count(*) filter (readable) as decoded, count(*) filter (not readable) as failed
from headers group by 1"""
SQL["top_errors"] = """
select 'Failure: ' || left(props, 8) as error, count(*) as n from events where event_type = 'error'
group by 1 order by n desc, error limit 10"""
SQL["intensity_windows"] = f"with {PIXELS}, {BOUNDS}, {_bounds(0.005, 0.995)} select series_id, round(lo, 6) as lo, round(hi, 6) as hi from bounds"
SQL["windowed_volumes"] = f"""with {PIXELS}, {BOUNDS}, {_bounds(0.01, 0.98)},
w as (select series_id, slice_idx, i, greatest(0, least(1, (v - lo) / (hi - lo)))::float::double as v from pix join bounds using (series_id))
{_frames("w")}"""
CHOICE = f"""{VOLUMES}, n as (select series_id, count(*) as n from vol group by 1)"""


def _choice(limit: int) -> str:
    return f"""{CHOICE},
picks as (
  select series_id, unnest(case when n <= {limit} then range(n) else
    list_distinct(list_transform(range({limit}), lambda j: cast(round_even(j * ((n - 1) / {limit - 1}.0::double), 0) as bigint))) end) as source_idx
  from n)"""


SQL["selected_slices"] = f"""with {_choice(16)}
select series_id, source_idx, row_number() over (partition by series_id order by source_idx) - 1 as slice_idx from picks"""
SQL["slabs"] = f"""with {VOLUMES},
s as (
  select series_id, slice_idx, list_concat(list_concat(coalesce(lag(px) over w, px), px), coalesce(lead(px) over w, px)) as px
  from vol window w as (partition by series_id order by slice_idx)),
x as (select series_id, slice_idx, unnest(range(192)) as i, unnest(px)::double as v from s)
{_frames("x")}"""
SQL["sliding_mip"] = f"""with {PIXELS},
x as (
  select series_id, slice_idx, i, max(v) over (partition by series_id, i order by slice_idx rows between 2 preceding and 1 following) as v from pix)
{_frames("x")}"""
SQL["flipped"] = f"with {PIXELS}, x as (select series_id, slice_idx, i // 8 * 8 + 7 - i % 8 as i, v from pix) {_frames('x')}"
SQL["stored_bytes"] = f"""with {PIXELS},
x as (select series_id, slice_idx, i, (round_even(greatest(0, least(1, abs(v))) * 255, 0) / 255.0::double)::float::double as v from pix)
{_frames("x")}"""


def _resample(source: str) -> str:
    """8 x 8 frames with pixels of 1 x 2 units to 3 x 6 pixels in the middle rows of a 6 x 6 square."""
    axis = ("select o, k, w / sum(w) over (partition by o) as w from (select o, k, greatest(0, 1 - abs(k + 0.5::double - (o + 0.5::double) * {s}) / {s}) as w "
            "from range({n}) a(o), range(8) b(k))")
    return f"""wy as ({axis.format(s='(8.0::double / 3)', n=3)}), wx as ({axis.format(s='(8.0::double / 6)', n=6)}),
small as (
  select series_id, slice_idx, (wy.o + 1) * 6 + wx.o as i, sum(wy.w * wx.w * v)::float::double as v
  from {source} join wy on wy.k = {source}.i // 8 join wx on wx.k = {source}.i % 8 where wy.w > 0 and wx.w > 0 group by all)"""


SQL["resized"] = f"with {PIXELS}, {_resample('pix')} {_frames('small')}"
SQL["montage"] = f"""with {VOLUMES},
c as (select distinct case_id from vol), s as (select case_id from c order by md5('0:' || case_id), case_id limit 3),
n as (select case_id, plane, count(*) as n from vol join s using (case_id) group by all),
t as (select case_id, plane, n, unnest(range(5)) as tile from n)
select case_id, plane, cast(tile as int) as tile, cast(case when n > 5 then round_even(tile * ((n - 1) / 4.0::double), 0)
  when tile < n then tile end as int) as slice_idx from t"""
SQL["attention_weights"] = """
with e as (select vec_id, label, case when vec_id % 5 <> 0 then exp(embedding[1]::double) else 0 end as e from embeddings)
select vec_id, label, round(e / sum(e) over (partition by label), 9) as weight from e"""
POOLED = f"""{VOLUMES},
e as (select case_id, plane, px, case when vec_id % 5 <> 0 then exp(4 * px[1]::double) else 0 end as e from vol),
x as (select case_id, plane, e, unnest(range(64)) as i, unnest(px)::double as v from e),
pooled as (select case_id, plane, i, sum(e * v) / sum(e) as value from x group by all)"""
SQL["attention_pooled"] = f"with {POOLED} select case_id, plane, cast(i as int) as i, round(value, 6) as value from pooled"
SQL["fused_planes"] = f"""with {POOLED},
c as (select distinct case_id from vol), grid as (select case_id, o, unnest(range(64)) as i, plane from c, (values (0, 'sagittal'), (1, 'coronal'), (2, 'axial')) p(o, plane))
select case_id, cast(g.o * 64 + g.i as int) as i, round(coalesce(value, 0), 6) as value from grid g left join pooled using (case_id, plane, i)
union all
select case_id, cast(192 + o as int), case when exists (select 1 from vol where vol.case_id = g.case_id and vol.plane = g.plane) then 1.0 else 0.0 end
from grid g where i = 0"""

# ---- inventory ----------------------------------------------------------------------------------

SQL["manifest"] = f"with {MANIFEST} select * from manifest"
SQL["complete_cases"] = f"with {MANIFEST} select case_id from manifest where has_sagittal = 1 and has_axial = 1"
SQL["any_plane_cases"] = f"with {MANIFEST} select case_id from manifest where has_sagittal = 1 or has_axial = 1"
SQL["plane_totals"] = f"""with {MANIFEST}
select cast(sum(has_sagittal) as bigint) as sagittal, cast(sum(has_coronal) as bigint) as coronal, cast(sum(has_axial) as bigint) as axial from manifest"""
SQL["cache_summary"] = f"""with {MANIFEST}
select count(*) as n_studies, count(study_error) as n_study_errors, count(*) filter (has_sagittal = 0) as missing_sagittal,
  count(*) filter (has_coronal = 0) as missing_coronal, count(*) filter (has_axial = 0) as missing_axial,
  count(*) filter (has_sagittal = 1 and has_coronal = 1 and has_axial = 1) as studies_all_planes,
  (select count(*) from log where error is null) as n_series_cached, (select count(error) from log) as n_series_failed,
  (select sum(rows * cols)::bigint from headers) as cache_bytes from manifest"""
SQL["cache_problems"] = f"""with {MANIFEST}, {ORDERS},
facts as (
  select case_id, case series_id when 'view' then 'sagittal' when 'signup' then 'coronal' when 'purchase' then 'axial' end as plane,
    count(*) as n_slices, count(distinct rows) as n_shapes, bool_or(instance_number = 96) as odd, max(instance_number) as peak
  from headers where readable and series_id in ('view', 'signup', 'purchase') and cast(case_id as bigint) % 19 <> 0 group by all),
claims as (
  select case_id, 'sagittal' as plane, has_sagittal as has, n_slices_sagittal as claimed from manifest
  union all select case_id, 'coronal', has_coronal, n_slices_coronal from manifest
  union all select case_id, 'axial', has_axial, n_slices_axial from manifest),
f as (select c.case_id, c.plane, c.has, c.claimed, n_slices, n_shapes, odd, peak from claims c left join facts using (case_id, plane)),
found as (
  select 'missing_file' as kind, case_id || '/' || plane as w from f where has = 1 and n_slices is null
  union all select 'bad_shape', case_id || '/' || plane from f where n_shapes > 1
  union all select 'slice_count_mismatch', case_id || '/' || plane from f where n_shapes = 1 and n_slices <> claimed
  union all select 'non_finite', case_id || '/' || plane from f where odd
  union all select 'all_black', case_id || '/' || plane from f where peak = 0
  union all select 'study_error', case_id from manifest where study_error is not null
  union all select 'no_planes', case_id from manifest where has_sagittal + has_coronal + has_axial = 0
  union all select 'series_count_differs_from_table', case_id from manifest where n_series_listed is distinct from n_series_stored
  union all select 'studies_not_cached', case_id from orders_w where case_id not in (select case_id from manifest))
select kind, count(*) as n, min(w) as example, case when kind = 'series_count_differs_from_table' then 'note' else 'fail' end as severity
from found group by kind"""
INGEST = """
files as (
  select label, vec_id // 20 as z, label = 4 or (vec_id % 17 = 3 and label not in (2, 8)) as bad, vec_id % 13 = 5 as odd,
    (vec_id // 20) % 19 = 7 or label = 7 as lost, (vec_id // 20) % 23 = 9 as turned from embeddings),
counted as (select label, count(*) as n_files, count(*) filter (bad) as bad, count(*) filter (odd and not bad) as odd from files group by 1),
places as (select label, z, lost, turned, count(*) as n from files where not bad and not odd group by all),
good as (
  select label, sum(n)::bigint - count(*) as twice, count(*) filter (lost) as failed, count(*) filter (turned and not lost) as turned,
    count(*) filter (not turned and not lost) as raw,
    concat_ws(',', case when bool_or(z % 2 = 0) filter (not turned and not lost) then 'explicit' end,
      case when bool_or(z % 2 = 1) filter (not turned and not lost) then 'implicit' end) as syntaxes from places group by 1),
one as (
  select *, ['sagittal', 'coronal', 'axial'][label % 3 + 1] as plane, cast(label // 3 as varchar) as case_id, cast(label as varchar) as series_id,
    case when label = 8 then 0 else cast(label % 2 as int) end as fluid, case when label % 4 = 0 and label <> 8 then 1 else 0 end as fatsat,
    coalesce(raw, 0) as n_raw, coalesce(odd, 0) + coalesce(turned, 0) as off, coalesce(raw, 0) > 0 as fine
  from counted left join good using (label)),
log as (select *, plane as key from one union all select *, plane || '_t1' from one where fluid = 0)"""
SQL["listed_files"] = f"""with {INGEST}
select cast(label // 3 as varchar) as case_id, cast(label as varchar) as series_id, count(*) as n_files from files group by all"""
SQL["raw_frames"] = """
with files as (
  select label, (label = 4 or (vec_id % 17 = 3 and label not in (2, 8))) as bad, (vec_id // 20) % 19 = 7 or label = 7 as lost,
    case when vec_id % 13 = 5 then [4, 16] when (vec_id // 20) % 23 = 9 then [16, 4] else [8, 8] end as shape,
    (vec_id // 20) % 2 = 1 as inverted, list_transform(embedding, lambda x: x::double * 2 - 1) as values from embeddings),
read as (
  select *, not bad and not lost as ok, case when bad then 'JSONDecodeError' when lost then 'ValueError' end as error,
    case when inverted then list_transform(values, lambda x: (list_max(values) - x)::float) else list_transform(values, lambda x: x::float) end as pixels from files)
select cast(label // 3 as varchar) as case_id, cast(label as varchar) as series_id, ok, error,
  case when ok then shape[1] else 0 end::int as h, case when ok then shape[2] else 0 end::int as w, count(*) as frames,
  round(min(case when ok then list_min(pixels) end)::double, 6) as low, round(max(case when ok then list_max(pixels) end)::double, 6) as high,
  round(sum(case when ok then list_sum(list_transform(pixels, lambda x: x::double)) end), 4) as total
from read group by all"""
SQL["ingested_series"] = f"""with {INGEST}
select case_id, key, series_id, fluid, fatsat, n_files, n_raw as n_raw_slices, least(n_raw, 12) as n_saved_slices,
  '{{' || concat_ws(',', case when bad > 0 then '"bad_header":' || bad end, case when failed > 0 then '"decode_failed":' || failed end,
    case when twice > 0 then '"duplicate_position":' || twice end, case when off > 0 then '"off_size":' || off end) || '}}' as dropped_json,
  case when fine then 8 end as raw_h, case when fine then 8 end as raw_w, case when fine then plane end as inferred_plane,
  case when fine then syntaxes end as syntaxes, case when fine then label + 2.0::double end as spacing,
  case when not fine then 'DecodeError' end as error from log"""
SQL["ingested_studies"] = f"""with {INGEST}
select case_id, count(*) filter (key = plane and label <> 8) + 1 as n_series_listed, count(*) filter (key = plane) as n_series_stored, null as study_error,
  """ + ", ".join(f"""max(case when key = '{p}' and fine then 1 else 0 end) as has_{p}, max(case when key = '{p}' and fine then least(n_raw, 12) else 0 end) as n_slices_{p},
  max(case when key = '{p}' then series_id end) as {p}_series""" for p in ("sagittal", "coronal", "axial")) + """,
  count(*) filter (not fine) as n_series_errors, 'lost' as missing, count(*) filter (key = plane and label = 8) as series_not_listed,
  '{' || string_agg('"' || key || '":"' || series_id || '"', ',' order by key) || '}' as routes,
  string_agg(key, ',' order by key) filter (fine) as saved_keys, 12 as max_slices from log group by 1"""
SQL["ingest_problems"] = f"""with {INGEST},
studies as (select case_id, count(*) filter (key = plane and label <> 8) + 1 as listed, count(*) filter (key = plane) as stored, bool_or(fine) as fine from log group by 1),
found as (
  select 'series_count_differs_from_table' as kind, case_id as place from studies where listed <> stored
  union all select 'no_planes', case_id from studies where not fine
  union all select 'studies_not_cached', 'undelivered')
select kind, count(*) as n, min(place) as example, case kind when 'series_count_differs_from_table' then 'note' else 'fail' end as severity from found group by 1"""
_SQUARE = ("select o, k, w / sum(w) over (partition by o) as w from (select o, k, greatest(0, 1 - abs(k + 0.5::double - (o + 0.5::double) * (8.0::double / 6)) / (8.0::double / 6)) as w "
           "from range(6) a(o), range(8) b(k))")
SQL["preprocessed"] = f"""with {_choice(12).replace(VOLUMES, PIXELS)}, {BOUNDS}, {_bounds(0.005, 0.995)},
numbered as (select series_id, source_idx, row_number() over (partition by series_id order by source_idx) - 1 as no from picks),
win as (select p.series_id, no as slice_idx, i, greatest(0, least(1, (v - lo) / (hi - lo)))::float::double as v
  from pix p join bounds using (series_id) join numbered c on c.series_id = p.series_id and c.source_idx = p.slice_idx),
axis as ({_SQUARE}),
small as (
  select series_id, slice_idx, y.o * 6 + x.o as i, sum(y.w * x.w * v)::float::double as v
  from win join axis y on y.k = win.i // 8 join axis x on x.k = win.i % 8 where y.w > 0 and x.w > 0 group by all)
select series_id, slice_idx, string_agg(printf('%02X', cast(round_even(v::float * 255::float, 0) as int)), '' order by i) as stored from small group by all"""
SQL["frame_sizes"] = f"with {HEADERS} select rows as h, cols as w, 'uint8' as dtype, count(*) as slices from headers group by all"
SQL["stored_volumes"] = f"""with {PIXELS},
x as (select series_id, slice_idx, i, (round_even(greatest(0, least(1, abs(v))) * 255, 0) / 255.0::double)::float::double as v from pix
  where plane in ('sagittal', 'axial'))
{_frames("x")}"""
SQL["pending_cases"] = f"""with {ORDERS}, {PREDICTIONS}
select case_id from orders_w where case_id not in (select case_id from preds where source = 'tax')"""
SQL["streamed_cases"] = """
select cast(user_id as varchar) as case_id, event_type, count(*) as events, sum(length(props))::bigint as chars from events group by all"""
