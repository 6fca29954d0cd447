"""SQL equivalents of the core queries, for an engine with regular expressions, lists and lambdas."""

from __future__ import annotations

from corpusloom.functions.text import PLACEHOLDERS
from corpusloom.operators.evidence import FLAGS, RULES, demands
from corpusloom.plans import vocab as V

_WS = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '{_WS}', '', 'g')"


def _list(c: str) -> str:
    return f"list_filter(list_transform(string_split(coalesce({c}, ''), ';;'), lambda x: {_strip('x')}), lambda x: x <> '')"


_CODES = f"list_sort(list_distinct({_list('cpc_codes')}))"
_SLICES = f"list_sort(list_distinct(list_transform(list_filter({_CODES}, lambda x: length(x) >= 8), lambda x: substr(x, 1, 8))))"
_APPNO = r"upper(regexp_replace(application_number, '[\s\-/,.]', '', 'g'))"
_GRANT = "coalesce(contains(lower(trim(document_type)), 'grant'), starts_with(upper(trim(kind)), 'B'), false)"
_TEXT = _strip("coalesce(title, '') || '. ' || coalesce(abstract, '')")


def _prefix(ps: tuple[str, ...]) -> str:
    return "len(list_filter(codes, lambda x: " + " or ".join(f"starts_with(x, '{p}')" for p in ps) + ")) > 0"


def _re(c: str, pattern: str) -> str:
    return f"regexp_matches(coalesce({c}, ''), '(?i){pattern}')"


_v = V.VOCAB
_ANY_TEXT = "(ev_device_text or ev_topic_text or ev_mechanism)"
_TAGGED = f"""
with base as (select *, {_CODES} as codes, {_TEXT} as text from stage1_corpus),
ev as (select *, {_prefix(_v.core_prefixes)} as ev_core, {_prefix(_v.topic_prefixes)} and not ({_prefix(_v.topic_excluded)}) as ev_topic_code,
  {_prefix(_v.device_prefixes)} as ev_device_code, {_re('text', _v.topic_text)} as ev_topic_text, {_re('text', _v.mechanism_text)} as ev_mechanism,
  {_re('text', _v.device_text)} as ev_device_text, {_re('text', _v.weak_text)} as ev_weak, {_re('title', _v.veto_text)} as ev_veto from base),
tagged as (select *, ev_topic_code or ev_topic_text or ev_mechanism as cond_topic, ev_device_text or ev_device_code as cond_device,
  ev_core and {_ANY_TEXT} and not ev_veto as in_corpus, case when ev_core and {_ANY_TEXT} and not ev_veto then 'T1' else 'excluded' end as tier from ev)"""

_PATTERNS = V.TAXONOMY.patterns()
_CLASSES = list(_PATTERNS)


def _hits(c: str) -> str:
    return "list_filter([" + ", ".join(f"case when {_re(c, p)} then '{k}' end" for k, p in _PATTERNS.items()) + "], lambda x: x is not null)"


_CLASSED = _TAGGED + f", classed as (select *, {_hits('text')} as labels, {_hits('title')} as title_labels from tagged)"
_CATS = "(values " + ", ".join(f"('{c}')" for c in _CLASSES) + ") c(category)"


def _wilson(k: str, n: str) -> tuple[str, str]:
    mid, half, den = f"({k}/{n}::double + 1.9208/{n})", f"1.96*sqrt(({k}/{n}::double)*(1-{k}/{n}::double)/{n} + 0.9604/({n}::double*{n}))", f"(1 + 3.8416/{n})"
    return f"case when {n} > 0 then greatest(0.0, 100*({mid}-{half})/{den}) end", f"case when {n} > 0 then least(100.0, 100*({mid}+{half})/{den}) end"


_LO, _HI = _wilson("n", "n_records")


def _shares(where: str) -> str:
    return _CLASSED + f""", spine as (select unnest(range({V.FIRST}, {V.LAST + 1}))::int as year),
k as (select s.year, c.category, count(x.rec_id) as n_records, count(x.rec_id) filter (where list_contains(x.labels, c.category)) as n
  from spine s cross join {_CATS} left join (select * from classed where {where}) x on x.pub_year = s.year group by 1, 2),
shares as (select year, category, n_records, n, case when n_records > 0 then 100.0::double*n/n_records end as pct, {_LO} as lo, {_HI} as hi, year > {V.COMPLETE_TO} as provisional from k)"""


def _annual(year: str = "pub_year") -> str:
    return f""", a_{year} as (select {year}::int as year, category, count(*) as n_full, count(*) filter (where in_corpus) as n_inside,
  count(*) filter (where list_contains(labels, category)) as full_n, count(*) filter (where list_contains(labels, category) and in_corpus) as inside_n
  from (select *, year(filing_date) as filing_year from classed) x cross join {_CATS} where {year} between {V.FIRST} and {V.COMPLETE_TO} group by 1, 2),
annual_{year} as (select *, 100.0::double*full_n/n_full as full_pct, case when n_inside > 0 then 100.0::double*inside_n/n_inside end as inside_pct from a_{year}),
pooled_{year} as (select category, sum(full_n)::bigint as full_n, sum(inside_n)::bigint as inside_n, 100.0::double*sum(full_n)/sum(n_full) as full_pct,
  case when sum(n_inside) > 0 then 100.0::double*sum(inside_n)/sum(n_inside) end as inside_pct from a_{year} group by 1)"""


_DEVICE = "(ev_device_code or ev_device_text)"


def _rule(rule: str) -> str:
    return " or ".join("(" + " and ".join("(" + " or ".join(f"ev_{k}" for k in kinds) + ")" for kinds in part) + ")" for part in demands(rule))


_EVNAMES = "coalesce(nullif(array_to_string(list_filter([" + ", ".join(f"case when ev_{n} then '{n}' end" for n in ("topic_code", "topic_text", "mechanism", "device_code", "device_text")) + "], lambda x: x is not null), ','), ''), 'no evidence')"


def _norm(c: str) -> str:
    t = f"upper({_strip(f'coalesce({c}, $$$$)')})".replace("$$$$", "''")
    return f"case when {t} = 'NAN' or substr({t}, 1, 1) not in ('Y', 'N', 'B') then '' else substr({t}, 1, 1) end"


_LABELS = f""", lab as (select * from (select publication_number, {_norm('is_ai_hardware')} as gold, side, stage, architecture, label_id,
  row_number() over (partition by publication_number order by labelled_at desc, label_id desc) as rn from validation_labels) where rn = 1),
lab2 as (select publication_number, {_norm('is_ai_hardware')} as second from (select *, row_number() over (partition by publication_number order by labelled_at desc, label2_id desc) as rn from validation_labels_annotator2) where rn = 1)"""
_ONE = ", one as (select * from (select *, row_number() over (partition by display_key order by rec_id) as rn from tagged where display_key is not null) where rn = 1)"
_JUDGED = _TAGGED + _LABELS + _ONE + ", judged as (select l.publication_number, l.gold, l.side, l.stage, l.architecture, o.text, o.title, coalesce(o.tier, 'excluded') as tier, coalesce(o.in_corpus, false) as in_corpus, " + ", ".join(f"coalesce(o.{f}, false) as {f}" for f in FLAGS) + " from lab l left join one o on l.publication_number = o.display_key)"


def _hint(c: str) -> str:
    return f"case when upper(trim({c})) = 'NONE' then 'NONE' " + " ".join(f"when regexp_matches(lower({c}), '{p}') then '{k}'" for p, k in V.HINTS) + " else '' end"


def _canon(c: str, default: str = "''") -> str:
    return "case " + " ".join(f"when {c} = '{k}' then '{v}'" for k, v in V.CANONICAL.items()) + f" else {default} end"


def _band(c: str, bands: list[tuple[float, float]], other: str) -> str:
    return "case " + " ".join(f"when {c} >= {lo} and {c} < {hi} then '{lo:.2f}-{hi:.2f}'" for lo, hi in bands) + f" else {other} end"


_SEED = """
with e as (select vec_id, label, embedding::double[] as v from embeddings),
p as (select a.vec_id, a.label = 0 as is_seed, list_dot_product(a.v, s.v) as sim, row_number() over (partition by a.vec_id order by list_dot_product(a.v, s.v) desc) as rn
  from e a join e s on s.label = 0 and s.vec_id <> a.vec_id),
raw as (select vec_id, is_seed, avg(sim) as exact from p where rn <= 10 group by 1, 2),
scores as (select vec_id, is_seed, round(exact, 6) as score from raw)"""
_BANDED = _band("score", V.LOW_BANDS, "'below'")
_SIDE = "case when in_corpus then 'retained' when cond_topic <> cond_device then 'excluded_near' when not cond_topic and not cond_device then 'excluded_far' else 'excluded_both' end"
_DRAWN = _TAGGED + f""", s as (select *, {_SIDE} as side, md5(rec_id::varchar || '|42') as draw from tagged),
drawn as (select * from (select *, row_number() over (partition by side order by draw, rec_id) as rn from s) where rn <= case side when 'retained' then 120 when 'excluded_near' then 60 when 'excluded_far' then 20 else 0 end)"""
_FIRST = "(select *, row_number() over (partition by lens_id order by _source_folder nulls first, _source_file nulls first, rec_id) as rn from stage1_corpus)"


_WIDE, _NARROW = "".join(chr(0xFF01 + i) for i in range(94)), "".join(chr(0x21 + i) for i in range(94)).replace("'", "''")
_TRIMMED = "regexp_replace(translate({c}, chr(12288) || chr(160), '  '), '^[\\s\\p{{Z}}\\p{{Cf}}]+|[\\s\\p{{Z}}\\p{{Cf}}]+$', '', 'g')"
_BARE = "lower(regexp_replace(" + _TRIMMED + ", '^[\\[(<{{]+|[\\])>}}]+$', '', 'g'))"
_EMPTY = "('" + "', '".join(PLACEHOLDERS) + "')"
LAST_PRIORITY = "list_last(list_filter(string_split(priority_numbers, ';;'), lambda x: regexp_matches(x, '[^\\s\\p{Z}\\p{Cf}]')))"


def filled(c: str) -> str:
    """SQL: is the cell neither blank nor a placeholder?"""
    bare = _BARE.format(c=c)
    return f"coalesce({bare} not in {_EMPTY} and regexp_matches({bare}, '[\\p{{L}}\\p{{N}}]'), false)"


def narrow(c: str) -> str:
    """SQL: full-width forms replaced by plain ones."""
    return f"translate({c}, '{_WIDE}', '{_NARROW}')"


def bare_key(c: str) -> str:
    """SQL: a cell in capitals without blanks and punctuation."""
    return f"upper(regexp_replace({narrow(c)}, '[^\\p{{L}}\\p{{M}}\\p{{N}}]+', '', 'g'))"


def usable_key(c: str) -> str:
    """SQL: the bare key of a cell that names something, or null."""
    return f"case when {filled(c)} and not regexp_matches({c}, '^[^\\p{{L}}\\p{{N}}]*0*$') then {bare_key(c)} end"


def trimmed(c: str) -> str:
    """SQL: a cell without blanks of any kind at its ends."""
    return _TRIMMED.format(c=c)


_KEYED = f"""with x as (select rec_id, pub_year, {_GRANT} as g, coalesce({usable_key('_family')}, {usable_key(LAST_PRIORITY)}, {usable_key('_appno')}, 'NOAPP_' || rec_id) as family,
  coalesce({usable_key('_appno')}, 'NOAPP_' || rec_id) as application from stage1_corpus)"""


def _collapsed(mode: str) -> str:
    keep = {"invention": "true", "apps": "not g", "grants": "g"}[mode]
    return f"""{_KEYED}, y as (select *, bool_or(g) over (partition by family) as granted from x),
z as (select *, row_number() over (partition by family order by g desc, rec_id) as rn from y where {keep})
select family, rec_id{', granted' if mode != 'grants' else ''} from z where rn = 1"""


_TERMS = r"""
with d as (select section, doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}\p{N}\p{Pc}]{2,}'), lambda w: not list_contains({stop}, w)) as w from documents where lang = 'en' and section is not null),
t as (select section, doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as term from d),
tf as (select section, doc_id, term, count(*) as tf from t group by all),
n as (select section, count(*) as n from d group by 1),
st as (select section, term, count(*) as df, sum(tf) as total from tf group by all having count(*) >= 3),
vo as (select section, term, df, n from (select *, row_number() over (partition by section order by total desc, term) as r from st) join n using (section) where r <= 4000),
x as (select tf.section, doc_id, term, n, tf * (ln((1 + n) / (1 + df)::double) + 1) as w from tf join vo using (section, term)),
l as (select section, doc_id, sqrt(sum(w * w)) as len from x group by all),
m as (select section, term, sum(w / len) / max(n) as weight from x join l using (section, doc_id) group by 1, 2),
b as (select *, row_number() over (partition by section order by round(weight, 9) desc, term) as rank from m)
select section, rank::int as rank, term, round(weight, 6) as weight from b where rank <= 4"""


def _terms() -> str:
    from corpusloom.operators.terms import STOP_WORDS

    return _TERMS.replace("{stop}", "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]")


ORACLES: dict[str, str] = {
    "key_normalise": rf"select rec_id, {_APPNO} as appno, regexp_replace(application_number, '\s+', '', 'g') as overlap_key from stage1_corpus",
    "family_key": f"""with x as (select rec_id, {_list('priority_numbers')} as p, nullif({_APPNO}, '') as a from stage1_corpus)
select rec_id, coalesce(p[-1], a, 'NOAPP_' || rec_id) as family, p[-1] as earliest, p[1] as first_listed, coalesce(p[-1] <> p[1], false) as differs from x""",
    "split_codes": f"select rec_id, array_to_string({_CODES}, ';;') as codes, len({_CODES})::bigint as n_codes from stage1_corpus",
    "code_prefix_slice": f"select rec_id, array_to_string({_SLICES}, ';;') as slices, len({_SLICES})::bigint as n_slices from stage1_corpus",
    "code_prefix_counts": f"select code, count(*) as n from (select unnest({_SLICES}) as code from stage1_corpus) group by 1",
    "prefix_evidence": _TAGGED + " select rec_id, ev_core, ev_topic_code, ev_device_code from tagged",
    "title_abstract_text": _TAGGED + " select rec_id, md5(text) as text_md5 from tagged",
    "mixed_dates": """with o as (select o_orderkey, case when o_orderkey % 2 = 0 then strftime(o_orderdate, '%Y-%m-%d') when o_orderkey % 7 = 0 then '31/31/2025' else day(o_orderdate) || '/' || month(o_orderdate) || '/' || year(o_orderdate) end as w from orders),
p as (select coalesce(try_strptime(w, '%Y-%m-%d'), try_strptime(w, '%d/%m/%Y')) as t from o) select year(t)::int as year, month(t)::int as month, count(*) as n from p group by 1, 2""",
    "grant_label": f"select case when {_GRANT} then 'grant' else 'application' end as label, jurisdiction, count(*) as n from stage1_corpus group by 1, 2",
    "numeric_coercion": "select count(*) as n, count(try_cast(json_extract_string(props, '$.page') as double)) as n_number, count(try_cast(substr(event_type, 1, 1) as double)) as n_letter_number from events",
    "impute_scale": """with x as (select rec_id, case when year(filing_date) not in (1900, 9999) then year(filing_date) end as y from stage1_corpus), s as (select median(y) as m, min(y) as lo, max(y) as hi from x)
select rec_id, round((coalesce(y, m) - lo) / greatest(hi - lo, 1)::double, 6) as scaled from x cross join s""",
    "category_hint": f"select {_strip('architecture')} as free_text, count(*) as n, {_hint(_strip('architecture'))} as suggested from validation_labels where architecture is not null group by 1, 3",
    "category_canonical": f"select {_canon('suggested')} as category, sum(n)::bigint as n_rows, count(*) as n_values from (select {_strip('architecture')} as f, count(*) as n, {_hint(_strip('architecture'))} as suggested from validation_labels where architecture is not null group by 1, 3) group by 1",
    "truncation_flags": "select _source_file, count(*) as n_rows, count(*) in (1000, 5000, 10000, 20000, 25000, 50000, 100000, 250000) or count(*) % 10000 = 0 as suspect from stage1_corpus group by 1",
    "evidence_names": _TAGGED + f" select {_EVNAMES} as evidence, count(*) as n from tagged group by 1",
    "regex_evidence": _TAGGED + " select rec_id, ev_topic_text, ev_mechanism, ev_device_text, ev_weak from tagged",
    "subject_veto": _TAGGED + f" select rec_id, ev_veto as veto_title, {_re('text', _v.veto_text)} as veto_text from tagged",
    "rule_production": _TAGGED + " select rec_id, cond_topic, cond_device, tier, in_corpus from tagged",
    "rule_second_tier": _TAGGED + f" select case when ev_veto then 'excluded' when ev_core then 'T1' when (ev_topic_code or ev_topic_text) and {_DEVICE} then 'T2' else 'excluded' end as tier, count(*) as n from tagged group by 1",
    "rule_variants": _TAGGED + " " + " union all ".join(f"select '{n}' as variant, count(*) filter (where ({_rule(n)}) and not ev_veto) as n_kept from tagged" for n in RULES),
    "attrition": _TAGGED + " select ordinal::bigint as ordinal, step, n, round(100.0::double * n / base, 6) as pct_of_base from (" + " union all ".join(f"select {i} as ordinal, '{s}' as step, count(*) filter (where {c}) as n, count(*) as base from tagged" for i, (s, c) in enumerate({"records": "true", "topic condition": "cond_topic", "device condition": "cond_device", "core code": "ev_core", "core code with text": f"ev_core and {_ANY_TEXT}", "second tier": "tier = 'T2'", "retained": "in_corpus"}.items())) + ")",
    "evidence_composition": _TAGGED + " select count(*) as n_retained, count(*) filter (where ev_topic_code and not ev_topic_text) as code_only, count(*) filter (where ev_topic_text and not ev_topic_code) as text_only, count(*) filter (where ev_topic_text and ev_topic_code) as both, count(*) filter (where ev_mechanism and not ev_topic_text and not ev_topic_code) as mechanism_only from tagged where in_corpus",
    "weak_only": _TAGGED + " select count(*) filter (where ev_weak and not ev_device_text and not ev_device_code) as n_weak_only, count(*) filter (where ev_weak) as n_weak from tagged",
    "taxonomy_multilabel": _CLASSED + " select rec_id, array_to_string(labels, ',') as labels, array_to_string(title_labels, ',') as title_labels from classed",
    "label_structure": _CLASSED + " select round(100 * avg((len(labels) = 0)::int), 6) as pct_none, round(100 * avg((len(labels) = 1)::int), 6) as pct_one, round(100 * avg((len(labels) >= 2)::int), 6) as pct_more, round(avg(len(labels)), 6) as mean_labels from classed",
    "evidence_strength": _CLASSED + f" select category, n_any, n_title, round(case when n_any > 0 then n_title / n_any::double else 0 end, 6) as strength from (select category, count(*) filter (where list_contains(labels, category)) as n_any, count(*) filter (where list_contains(title_labels, category)) as n_title from classed cross join {_CATS} group by 1)",
    "doc_type_filter": f"select lower(trim(document_type)) as t, coalesce(lower(trim(document_type)) in {V.KEPT_TYPES}, false) and coalesce(jurisdiction, '') = 'US' as kept, count(*) as n from stage1_corpus group by 1, 2",
    "dedup_first": f"select lens_id, rec_id, pub_year from {_FIRST} where rn = 1",
    "dedup_preferred": _KEYED + " select application, rec_id from (select *, row_number() over (partition by application order by g desc, rec_id) as rn from x) where rn = 1",
    "collapse_invention": _collapsed("invention"),
    "collapse_apps_only": _collapsed("apps"),
    "collapse_grants_only": _collapsed("grants"),
    "granted_flag": _KEYED + ", y as (select pub_year, bool_or(g) over (partition by family) as granted from x) select pub_year, count(*) as n, count(*) filter (where granted) as n_granted from y group by 1",
    "multi_source_ids": "select count(*) as n_keys from (select lens_id from stage1_corpus where lens_id is not null group by 1 having count(distinct _source_folder) > 1)",
    "multi_source_families": _KEYED + " select count(*) as n_keys from (select family from x group by 1 having count(distinct g) > 1)",
    "distinct_counts": "select count(distinct lens_id) as n_lens_id, count(distinct _appno) as n_appno, count(distinct _family) as n_family, count(distinct display_key) as n_display_key from stage1_corpus",
    "freq_table": "select jurisdiction as value, count(*) as n, round(100.0::double * count(*) / sum(count(*)) over (), 6) as pct from stage1_corpus group by 1",
    "crosstab": "select pub_year, " + ", ".join(f"count(*) filter (where coalesce(jurisdiction, 'none') = '{j}') as \"{j}\"" for j in ("US", "EP", "DE", "none")) + " from stage1_corpus group by 1",
    "union_shared_columns": "select _source_folder, count(*) as n, count(title) as n_title, sum(rec_id)::bigint as sum_id from stage1_corpus where _source_folder in ('by_filing', 'by_publication') group by 1",
    "overlap_pct": f"with k as (select {_APPNO} as k, bool_or(_source_folder = 'by_filing') as a, bool_or(_source_folder = 'by_publication') as b from stage1_corpus where application_number is not null group by 1) select count(*) filter (where a) as n_a, count(*) filter (where b) as n_b, count(*) filter (where a and b) as n_both, round(100.0::double * count(*) filter (where a and b) / greatest(count(*) filter (where a), 1), 6) as pct_of_a from k",
    "row_counts": "select _source_folder, _source_file, count(*) as n_rows from raw_records group by 1, 2",
    "left_label_join": _JUDGED + " select l.side, count(*) as n, count(o.rec_id) as n_matched, count(*) filter (where o.in_corpus) as n_in_corpus from lab l left join one o on l.publication_number = o.display_key group by 1",
    "inner_text_join": _JUDGED + " select l.publication_number, l.gold, length(o.text)::bigint as n_text from lab l join one o on l.publication_number = o.display_key",
    "anti_seed": "select label, count(*) as n from embeddings where vec_id not in (select vec_id from embeddings where label = 0) group by 1",
    "annotator_pairs": _TAGGED + _LABELS + " select publication_number, gold as first, second from lab join lab2 using (publication_number) where gold <> '' and second <> '' and gold <> second",
    "annual_share_wilson": _shares("in_corpus") + " select year, category, n_records, n, round(pct, 6) as pct, round(lo, 6) as lo, round(hi, 6) as hi, provisional from shares",
    "filtered_vs_full_annual": _CLASSED + _annual() + " select year, category, n_full, n_inside, full_n, inside_n, round(full_pct, 6) as full_pct, round(inside_pct, 6) as inside_pct, round(inside_pct - full_pct, 6) as delta from annual_pub_year",
    "pooled_ratio": _CLASSED + _annual() + " select category, full_n, inside_n, round(full_pct, 6) as full_pct, round(inside_pct, 6) as inside_pct, round(case when full_pct > 0 then inside_pct / full_pct end, 6) as ratio from pooled_pub_year",
    "trend_delta": _CLASSED + _annual() + """, o as (select *, row_number() over (partition by category order by year) as i, count(*) over (partition by category) as n from annual_pub_year where n_inside >= 5),
h as (select *, greatest(n // 3, 1) as k from o), t as (select category, avg(full_pct) filter (where i > n - k) - avg(full_pct) filter (where i <= k) as fd, avg(inside_pct) filter (where i > n - k) - avg(inside_pct) filter (where i <= k) as id,
  sum(inside_n) filter (where i <= k)::bigint as n_first, sum(inside_n) filter (where i > n - k)::bigint as n_last from h group by 1)
select category, round(fd, 6) as full_delta, round(id, 6) as inside_delta, n_first, n_last, sign(fd) <> sign(id) as opposite from t""",
    "milestone_shares": _shares("true") + " select category, " + ", ".join(f"round(max(pct) filter (where year = {y}), 6) as pct_{y}, max(n) filter (where year = {y}) as n_{y}" for y in (2012, 2016, 2022)) + " from shares group by 1",
    "growth_ratio": _shares("true") + ", g as (select category, max(n) filter (where year = 2017) as n_first, max(n) filter (where year = 2022) as n_last from shares group by 1) select *, round(case when n_first > 0 then n_last / n_first::double end, 6) as growth from g",
    "trajectory": _shares("true") + " select category, year, case when provisional then 'provisional' else 'complete' end as segment, n, round(pct, 6) as pct, round(lo, 6) as lo, round(hi, 6) as hi from shares where year >= 2016",
    "ratio_robustness": _CLASSED + _annual() + _annual("filing_year") + " select category, round(case when p.full_pct > 0 then p.inside_pct / p.full_pct end, 6) as ratio_pub, round(case when f.full_pct > 0 then f.inside_pct / f.full_pct end, 6) as ratio_filing from pooled_pub_year p join pooled_filing_year f using (category)",
    "year_histogram": _TAGGED + " select pub_year::int as year, count(*) as n from tagged where in_corpus and pub_year >= 2012 group by 1",
    "lag_stats": "select count(*) as n, median(lag)::double as median_lag, round(avg(lag), 6) as mean_lag, round(quantile_cont(lag, 0.9)::double, 6) as p90_lag from (select year(pub_date) - year(filing_date) as lag from stage1_corpus) where lag between 0 and 20",
    "date_coverage": "select _source_folder, min(year(filing_date))::int as first_year, max(year(filing_date))::int as last_year, median(year(filing_date))::double as median_year, round(100 * avg((filing_date is null)::int), 6) as pct_missing, count(*) as n from stage1_corpus group by 1",
    "cluster_sizes": "with c as (select case when vec_id % 5 = 0 then -1 else label end as c, count(*) as n from embeddings group by 1) select count(*) filter (where c <> -1) as n_clusters, round(100.0::double * coalesce(sum(n) filter (where c = -1), 0) / sum(n), 6) as noise_pct, round(100.0::double * max(n) filter (where c <> -1) / sum(n), 6) as largest_pct from c",
    "cluster_year_counts": "select label as cluster, (2010 + vec_id % 7)::int as year, count(*) as n from embeddings where label <> -1 group by 1, 2",
    "eta_squared": "with x as (select label, (2010 + vec_id % 7 + label)::double as y from embeddings), g as (select avg(y) as m from x), s as (select sum((y - m) * (y - m)) as t from x cross join g), b as (select sum(n * (a - m) * (a - m)) as b from (select label, count(*) as n, avg(y) as a from x group by 1) cross join g) select round(b / t, 6) as eta2 from s cross join b",
    "spearman": "with x as (select l_quantity as a, l_extendedprice as b from lineitem), r as (select rank() over (order by a) + (count(*) over (partition by a) - 1) / 2.0::double as ra, rank() over (order by b) + (count(*) over (partition by b) - 1) / 2.0::double as rb from x) select round(corr(ra, rb), 6) as rho from r",
    "label_norm": f"select {_norm('is_ai_hardware')} as label, count(*) as n from validation_labels group by 1",
    "rule_scores": _JUDGED + ", k as (" + " union all ".join(f"select '{n}' as variant, ({_rule(n)}) and not ev_veto as keep, gold = 'Y' as yes from judged where gold in ('Y', 'N', 'B')" for n in RULES) + """),
t as (select variant, count(*) filter (where keep) as kept, count(*) filter (where keep and yes) as tp, count(*) filter (where keep and not yes) as fp, count(*) filter (where not keep and yes) as fn from k group by 1),
u as (select *, case when tp + fp > 0 then tp / (tp + fp)::double end as p, case when tp + fn > 0 then tp / (tp + fn)::double end as r from t)
select variant, kept, tp, fp, fn, round(p, 6) as precision, round(r, 6) as recall, round(case when p > 0 and r > 0 then 2 * p * r / (p + r) end, 6) as f1 from u""",
    "wrong_records": _JUDGED + f", w as (select *, ({_rule('core | topic & device')}) and not ev_veto as keep, gold = 'Y' as yes from judged where gold in ('Y', 'N', 'B')) select publication_number, case when yes then 'false negative' else 'false positive' end as kind, {_EVNAMES} as evidence from w where keep <> yes",
    "precision_by_side": _JUDGED + ", t as (select side, stage, count(*) as n_records, count(*) filter (where gold = 'Y') as n, count(*) filter (where gold = 'B') as b from judged where gold in ('Y', 'N', 'B') group by 1, 2) " + f"select side, stage, n_records as n, n as n_yes, b as n_borderline, round(100.0::double * n / n_records, 6) as precision_pct, round({_LO}, 6) as lo, round({_HI}, 6) as hi from t",
    "precision_by_tier": _JUDGED + ", t as (select tier, count(*) as n_records, count(*) filter (where gold = 'Y') as n, count(*) filter (where gold = 'B') as b from judged where gold in ('Y', 'N', 'B') group by 1) " + f"select tier, n_records as n, n as n_yes, b as n_borderline, round(100.0::double * n / n_records, 6) as precision_pct, round({_LO}, 6) as lo, round({_HI}, 6) as hi from t",
    "class_confusion": _JUDGED + f""", h as (select coalesce(stage, 'none') as stage, {_hint("coalesce(architecture, '')")} as hint, {_hits('text')} as labels from judged),
g as (select stage, case when hint <> '' then [{_canon('hint', 'null')}] else [] end as gold, labels from h), s as (select 'ALL' as split, * from g union all select stage, * from g),
t as (select split, category, count(*) filter (where coalesce(list_contains(gold, category), false)) as n_gold, count(*) filter (where list_contains(labels, category)) as n_found, count(*) filter (where coalesce(list_contains(gold, category), false) and list_contains(labels, category)) as tp from s cross join {_CATS} group by 1, 2)
select split, category, n_gold, n_found, tp, n_found - tp as fp, n_gold - tp as fn, round(case when n_found > 0 then tp / n_found::double end, 6) as precision, round(case when n_gold > 0 then tp / n_gold::double end, 6) as recall from t""",
    "none_cross": _JUDGED + f", x as (select upper(trim(architecture)) = 'NONE' as is_none, len({_hits('text')}) > 0 as f from judged where architecture is not null) select count(*) filter (where is_none) as n_none, count(*) filter (where is_none and f) as none_but_found, count(*) filter (where not is_none) as n_class, count(*) filter (where not is_none and not f) as class_but_nothing from x",
    "kappa": _TAGGED + _LABELS + """, p as (select gold as a, second as b from lab join lab2 using (publication_number) where gold in ('Y', 'N') and second in ('Y', 'N')),
t as (select count(*) filter (where a = 'Y' and b = 'Y') as yy, count(*) filter (where a = 'N' and b = 'N') as nn, count(*) filter (where a = 'Y' and b = 'N') as yn, count(*) filter (where a = 'N' and b = 'Y') as ny, count(*)::double as n from p),
k as (select *, ((yy + yn) * (yy + ny) + (nn + ny) * (nn + yn)) / (n * n) as pe from t), f as (select *, case when n > 0 and pe < 1 then ((yy + nn) / n - pe) / (1 - pe) end as kap from k)
select yy, nn, yn, ny, round(100 * (yy + nn) / n, 6) as raw_pct, round(kap, 6) as kappa, case when kap is null then null when kap >= 0.81 then 'almost perfect' when kap >= 0.61 then 'substantial' when kap >= 0.41 then 'moderate' when kap >= 0.21 then 'fair' when kap >= 0 then 'slight' else 'poor' end as band from f""",
    "l2_normalise": "with x as (select vec_id, list_transform(embedding::float[], lambda x: (x * 3)::double) as v from embeddings), n as (select vec_id, v, sqrt(list_dot_product(v, v)) + 1e-9 as n from x) select vec_id, round(v[1] / n, 6) as first, round(sqrt(list_dot_product(v, v)) / n, 6) as norm from n",
    "topk_seed_score": _SEED + " select vec_id, is_seed, score from scores",
    "seed_quantiles": _SEED + " select " + ", ".join(f"round(quantile_cont(exact, {q}), 6) as p{round(q * 100)}" for q in (0.1, 0.25, 0.5, 0.75, 0.9)) + " from raw where is_seed",
    "score_bands": _SEED + f" select {_BANDED} as band, count(*) as n from scores where not is_seed group by 1",
    "band_precision": _SEED + ", j as (select s.score, case when e.label % 3 = 0 then 'Y' else 'N' end as gold from scores s join e using (vec_id) where not is_seed) select band, n, n_yes, cum_n, cum_yes, round(case when n > 0 then n_yes / n::double end, 6) as precision, round(case when cum_n >= 5 then cum_yes / cum_n::double end, 6) as cum_precision from (" + " union all ".join(f"select '{lo:.2f}-{hi:.2f}' as band, count(*) filter (where score >= {lo} and score < {hi}) as n, count(*) filter (where score >= {lo} and score < {hi} and gold = 'Y') as n_yes, count(*) filter (where score >= {lo}) as cum_n, count(*) filter (where score >= {lo} and gold = 'Y') as cum_yes from j" for lo, hi in V.LOW_BANDS) + ")",
    "expand_accept": _SEED + " select e.label, count(*) as n from scores s join e using (vec_id) where not is_seed and score >= 0.2 group by 1",
    "view_fusion": "with x as (select vec_id, embedding::double[] as v, (vec_id % 7) / 6.0::double * 0.15 as t from embeddings), y as (select vec_id, v, t, sqrt(list_dot_product(v, v)) / (sqrt(list_dot_product(v, v)) + 1e-9) as n from x) select vec_id, len(v)::bigint + 1 as dims, round(sqrt(n * n + t * t), 6) as norm from y",
    "ari_nmi": """with e as (select label as a, floor(vec_id * 7 % 11 / 2) + label % 3 as b from embeddings), c as (select a, b, count(*)::double as n from e group by 1, 2), r as (select a, sum(n) as r from c group by 1), k as (select b, sum(n) as k from c group by 1),
s as (select (select sum(n * (n - 1) / 2) from c) as pc, (select sum(r * (r - 1) / 2) from r) as pa, (select sum(k * (k - 1) / 2) from k) as pb, (select sum(n) from c) as n,
 (select sum(c.n * ln(c.n / (r.r * k.k))) from c join r using (a) join k using (b)) as m, (select -sum(r * ln(r)) from r) as ha, (select -sum(k * ln(k)) from k) as hb)
select round((pc - pa * pb / (n * (n - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (n * (n - 1) / 2)), 6) as ari, round((m / n + ln(n)) / ((ha / n + ln(n) + hb / n + ln(n)) / 2), 6) as nmi from s""",
    "silhouette_exact": """with e as (select vec_id, label, embedding::double[] as v from embeddings), p as (select a.vec_id, a.label as la, b.label as lb, sum(case when a.vec_id = b.vec_id then 0 else list_distance(a.v, b.v) end) as s, count(*) as n from e a cross join e b group by 1, 2, 3),
q as (select vec_id, max(case when la = lb then s / greatest(n - 1, 1) end) as a, min(case when la <> lb then s / n end) as b, max(case when la = lb then n end) as n from p group by 1)
select round(avg(case when n > 1 then (b - a) / greatest(a, b) else 0 end), 6) as silhouette from q""",
    "centroid_medians": "select label as cluster, count(*) as n, round(median(embedding[1]::double), 6) as cx, round(median(embedding[2]::double), 6) as cy from embeddings where label <> -1 group by 1",
    "tfidf_top_terms": _terms(),
    "stream_ingest": "select event_type, count(distinct event_id) as n from events group by 1",
    "stratified_sample": _DRAWN + " select rec_id, side from drawn",
    "blind_sheet": _DRAWN + " select rec_id, display_key, row_number() over (order by draw, rec_id) as row, '' as is_topic, '' as notes from drawn",
    "band_sample": _SEED + f", b as (select vec_id, {_band('score', V.LOW_BANDS, 'null')} as band, md5(vec_id::varchar || '|42') as draw from scores where not is_seed) select vec_id, band from (select *, row_number() over (partition by band order by draw, vec_id) as rn from b where band is not null) where rn <= 20",
    "label_report": _TAGGED + _LABELS + f""", x as (select gold, side, coalesce({_strip('architecture')}, '') <> '' and upper(trim(architecture)) <> 'NONE' as about from lab where gold in ('Y', 'N', 'B')),
t as (select 'precision' as measure, count(*) filter (where side = 'retained' and gold = 'Y') as k, count(*) filter (where side = 'retained') as n_records from x union all select 'false_negatives', count(*) filter (where side = 'excluded_near' and gold = 'Y'), count(*) filter (where side = 'excluded_near') from x
 union all select 'far_positives', count(*) filter (where side = 'excluded_far' and gold = 'Y'), count(*) filter (where side = 'excluded_far') from x union all select 'about', count(*) filter (where side = 'retained' and about), count(*) filter (where side = 'retained') from x)
select measure, k, n_records as n, round(100.0::double * k / nullif(n_records, 0), 6) as pct, round({_wilson('k', 'n_records')[0]}, 6) as lo, round({_wilson('k', 'n_records')[1]}, 6) as hi from t""",
    "merged_labels": _TAGGED + _LABELS + ", b as (select publication_number, is_ai_hardware as second from (select *, row_number() over (partition by publication_number order by labelled_at desc, label2_id desc) as rn from validation_labels_annotator2) where rn = 1) select lab.publication_number, gold, " + _strip("coalesce(b.second, '')") + " as second from lab left join b on lab.publication_number = b.publication_number",
    "category_sets": "with x as (select label_id, list_filter(list_transform(list_filter(list_transform(string_split(coalesce(architecture, ''), ','), lambda x: " + _strip("x") + "), lambda x: x <> ''), lambda x: " + _hint("x") + "), lambda x: x <> '') as h from validation_labels) select label_id, array_to_string(list_sort(list_distinct(list_transform(h, lambda x: " + _canon("x", "x") + "))), ',') as categories from x",
    "ratio_rank_agreement": _CLASSED + _annual() + _annual("filing_year") + """, x as (select case when p.full_pct > 0 then p.inside_pct / p.full_pct end as a, case when f.full_pct > 0 then f.inside_pct / f.full_pct end as b from pooled_pub_year p join pooled_filing_year f using (category)),
r as (select rank() over (order by round(a, 6)) + (count(*) over (partition by round(a, 6)) - 1) / 2.0::double as ra, rank() over (order by round(b, 6)) + (count(*) over (partition by round(b, 6)) - 1) / 2.0::double as rb from x where a is not null and b is not null) select round(corr(ra, rb), 6) as rho from r""",
    "expansion_union": _SEED + f", b as (select vec_id, {_band('score', V.LOW_BANDS, 'null')} as band, md5(vec_id::varchar || '|42') as draw from scores where not is_seed), drawn as (select vec_id from (select *, row_number() over (partition by band order by draw, vec_id) as rn from b where band is not null) where rn <= 20), u as (select vec_id, min(o) as o from (select vec_id, 1 as o from scores where is_seed union all select vec_id, 2 from scores where not is_seed and score >= 0.2 union all select vec_id, 3 from drawn) group by 1) select case o when 1 then 'seed' when 2 then 'accepted' else 'sample' end as part, count(*) as n from u group by 1",
    "vector_alignment": "with r as (select count(*) as n, count(*) filter (where rec_id in (select vec_id from embeddings)) as m from stage1_corpus), v as (select count(*) as n, count(*) filter (where vec_id in (select rec_id from stage1_corpus)) as m from embeddings) select r.n as n_records, v.n as n_vectors, r.m as n_aligned, r.n - r.m as n_without_vector, v.n - v.m as n_without_record, r.n = r.m and v.n = v.m as complete from r, v",
    "aligned_eta_squared": "with x as (select label, pub_year::double as y from embeddings join stage1_corpus on vec_id = rec_id where label <> -1), g as (select avg(y) as m from x), s as (select sum((y - m) * (y - m)) as t from x cross join g), b as (select sum(n * (a - m) * (a - m)) as b from (select label, count(y) as n, avg(y) as a from x group by 1) cross join g) select round(b / t, 6) as eta2 from s cross join b",
    "aligned_cluster_years": "select label as cluster, pub_year::int as year, count(*) as n from embeddings join stage1_corpus on vec_id = rec_id where label <> -1 and pub_year is not null group by 1, 2",
    "cluster_map": "with x as (select label, pub_year, embedding[1]::double as x, embedding[2]::double as y from embeddings join stage1_corpus on vec_id = rec_id), t as (select label as cluster, count(*) as n, 100.0::double * count(*) / (select count(*) from x) as pct, median(pub_year)::double as m, median(x) as cx, median(y) as cy from x where label <> -1 group by 1) select cluster, n, round(pct, 6) as pct, round(m, 6) as median_year, round(cx, 6) as cx, round(cy, 6) as cy, case when cluster = 0 then 'seeds' else 'C' || cluster end as name, row_number() over (order by n desc, cluster) <= 3 as annotated from t",
    "resumable_embedding": "select greatest(1, count(*) // 3)::bigint as n_first, count(*) - greatest(1, count(*) // 3)::bigint as n_second, count(*) as n, count(distinct rec_id) as n_ids, 5::bigint as dims from stage1_corpus",
}
