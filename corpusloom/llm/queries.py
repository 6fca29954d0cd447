"""Queries of the training-data operators over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import canon, consensus, encode, packing, sentences, survivors
from corpusloom.plans.oracle import LAST_PRIORITY, bare_key, filled, narrow, trimmed, usable_key
from corpusloom.session import read

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return canon.canonical_rows(read(spark, d, "validation_labels"), read(spark, d, "architecture_ref"))


def p1_unmatched(spark: SparkSession, d: str) -> DataFrame:
    return canon.unmatched_values(read(spark, d, "validation_labels"), read(spark, d, "architecture_ref"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return survivors.survivors(read(spark, d, "stage1_corpus"))


def p2_golden(spark: SparkSession, d: str) -> DataFrame:
    return survivors.golden_records(read(spark, d, "stage1_corpus"))


def p2_witnesses(spark: SparkSession, d: str) -> DataFrame:
    return survivors.grant_quality(read(spark, d, "stage1_corpus"))


def p2_judgements(spark: SparkSession, d: str) -> DataFrame:
    return survivors.judgements(read(spark, d, "stage1_corpus"))


def p2_true_codes(spark: SparkSession, d: str) -> DataFrame:
    return survivors.true_values(read(spark, d, "stage1_corpus")).select(F.col("_key").alias("family_key"), "value", "n_for", "n_against", "posterior")


def _sheets(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return read(spark, d, "validation_labels"), read(spark, d, "validation_labels_annotator2")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return consensus.consensus(*_sheets(spark, d)).select("publication_number", "consensus")


def p4_annotators(spark: SparkSession, d: str) -> DataFrame:
    return consensus.annotators(*_sheets(spark, d))


def p4_agreement(spark: SparkSession, d: str) -> DataFrame:
    return consensus.agreement(*_sheets(spark, d)).withColumns({c: F.round(c, 9) for c in ("observed_agreement", "alpha")})


def p4_pair_kappa(spark: SparkSession, d: str) -> DataFrame:
    return consensus.pair_kappa(*_sheets(spark, d)).withColumn("kappa", F.round("kappa", 9))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode(read(spark, d, "documents"))


def p6_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Ids back to text: equal to ``text`` with nulls as empty text."""
    return encode.decode(encode.encode(read(spark, d, "documents")))


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(encode.token_counts(read(spark, d, "documents")))


def p7_usage(spark: SparkSession, d: str) -> DataFrame:
    return packing.usage(p7_packed(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.split_sentences(read(spark, d, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_unmatched, p2_found, p2_golden, p2_witnesses, p2_judgements, p2_true_codes, p4_found, p4_annotators, p4_agreement, p4_pair_kappa, p6_ids, p6_decoded, p7_packed, p7_usage, p8_found)}

def _vote(c: str, yes: str) -> str:
    return f"case when not {filled(c)} then 0 when starts_with(lower({trimmed(c)}), '{yes}') then 1 else -1 end"


_RANKED = f"""
with v as (
  select *, coalesce({usable_key('_family')}, {usable_key(LAST_PRIORITY)}, {usable_key('_appno')}) as k,
    (case when is_granted then 1 when not is_granted then -1 else 0 end) + ({_vote('_source', 'grant')}) + ({_vote('kind', 'b')}) + ({_vote('document_type', 'grant')}) as vote,
    case when pub_date not in (date '1900-01-01', date '9999-12-31', date '1970-01-01', date '0001-01-01') then pub_date end as pd,
    {filled('title')} as ok_title, {filled('abstract')} as ok_abstract, {filled('cpc_codes')} as ok_cpc,
    coalesce(filing_date not in (date '1900-01-01', date '9999-12-31', date '1970-01-01', date '0001-01-01'), false) as ok_filing
  from stage1_corpus),
r as (select *, row_number() over (partition by k order by (vote > 0) desc, pd desc nulls last, ingested_at desc nulls last, rec_id) as rn, count(*) over (partition by k) as n from v where k is not null)"""

_WORD = f"lower({trimmed(narrow('is_ai_hardware'))})"
_BOTH = "^(y|yes)\\s*(/|or|and|&)\\s*(n|no)\\b|^(n|no)\\s*(/|or|and|&)\\s*(y|yes|a)\\b|^not?\\s+(sure|clear|idea|known|decided|yet)\\b|^n\\.\\s?a\\b"
_FIRST = f"regexp_extract({_WORD}, '^([\\p{{L}}\\p{{N}}]+)', 1)"
_ANSWER = f"case when regexp_matches({_WORD}, '{_BOTH}') then null when {_FIRST} in ('y', 'yes', 'true', '1') then 'Y' when {_FIRST} in ('n', 'no', 'false', '0') then 'N' end"
_SAID = f"select {bare_key('publication_number')} as item, lower({trimmed('annotator')}) as annotator, {_ANSWER} as answer, labelled_at"
_ANSWERS = f"""
with said as ({_SAID}, 1 as sheet, label_id as id from validation_labels union all {_SAID}, 2, label2_id from validation_labels_annotator2),
a as (select item, annotator, answer from (select *, row_number() over (partition by item, annotator order by labelled_at desc nulls last, sheet desc, id desc) as rn from said where item <> '' and annotator <> '') where rn = 1 and answer is not null)"""

ORACLES: dict[str, str] = {
    "p4_agreement": _ANSWERS + """, m as (select item, count(*) as m, count(*) filter (where answer = 'Y') as y from a group by 1 having count(*) > 1),
t as (select count(*) as n_items, sum(m)::bigint as n_answers, sum(y)::bigint as n_yes, sum(2 * y * (m - y) / (m - 1)::double) as d, sum(y * (m - y))::double as dis, sum(m * (m - 1) / 2)::double as pairs from m),
e as (select *, 2 * n_yes * (n_answers - n_yes) / (n_answers - 1)::double as ex from t)
select n_items, n_answers, n_yes, round(case when pairs > 0 then 1 - dis / pairs end, 9) as observed_agreement, round(case when n_answers > 1 and ex > 0 then 1 - d / ex end, 9) as alpha from e""",
    "p4_pair_kappa": _ANSWERS + """, p as (select x.annotator as a, z.annotator as b, x.answer as p, z.answer as q from a x join a z on x.item = z.item and x.annotator < z.annotator),
t as (select a, b, count(*)::double as n, count(*) filter (where p = 'Y' and q = 'Y') as yy, count(*) filter (where p = 'N' and q = 'N') as nn, count(*) filter (where p = 'Y' and q = 'N') as yn, count(*) filter (where p = 'N' and q = 'Y') as ny from p group by 1, 2),
k as (select *, ((yy + yn) * (yy + ny) + (nn + ny) * (nn + yn)) / (n * n) as pe from t)
select a as annotator_a, b as annotator_b, n::bigint as n_items, round(case when pe < 1 then ((yy + nn) / n - pe) / (1 - pe) end, 9) as kappa from k""",
    "p2_found": _RANKED + """
select s.rec_id as survivor_rec, f.field_name, f.from_rec from r s join (
  select k, 'title' as field_name, arg_min(rec_id, rn) as from_rec from r where ok_title group by k union all
  select k, 'abstract', arg_min(rec_id, rn) from r where ok_abstract group by k union all
  select k, 'cpc_codes', arg_min(rec_id, rn) from r where ok_cpc group by k union all
  select k, 'filing_date', arg_min(rec_id, rn) from r where ok_filing group by k) f on s.k = f.k
where s.rn = 1 and s.n > 1""",
    "p6_decoded": "select doc_id, coalesce(text, '') as text from documents",
}
