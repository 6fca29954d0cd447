"""Queries of the core operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import dates, stats, text
from corpusloom.operators import cluster, dedup, embed, evidence, measure, raw_records, sampling, terms, validate, vectors
from corpusloom.plans import vocab as V
from corpusloom.session import cut_lineage, over_cores, read, shared_folder
from corpusloom.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def r6(c: str | Column) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})


# ---- records ---------------------------------------------------------------------------------------------------


def records(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "stage1_corpus")


def is_grant(c: str = "document_type") -> Column:
    return F.coalesce(F.contains(F.lower(F.trim(F.col(c))), F.lit("grant")), F.startswith(F.upper(F.trim(F.col("kind"))), F.lit("B")), F.lit(False))


def tagged(spark: SparkSession, d: str) -> DataFrame:
    return evidence.apply_rule(evidence.tag_evidence(over_cores(records(spark, d), "rec_id"), V.VOCAB))


def classed(spark: SparkSession, d: str) -> DataFrame:
    return evidence.tag_classes(tagged(spark, d), V.TAXONOMY)


CLASSES = list(V.TAXONOMY.classes)

# ---- projections ------------------------------------------------------------------------------------------------


@query
def key_normalise(spark, d):
    x = records(spark, d)
    return x.select("rec_id", text.clean_number(F.col("application_number")).alias("appno"), F.regexp_replace("application_number", r"\s+", "").alias("overlap_key"))


@query
def family_key(spark, d):
    p = text.last_filled(F.col("priority_numbers"))
    no = text.clean_number(F.col("application_number"))
    own = F.coalesce(F.when(no != "", no), F.concat(F.lit("NOAPP_"), F.col("rec_id").cast("string")))
    first = text.first_filled(F.col("priority_numbers"))
    return records(spark, d).select("rec_id", F.coalesce(p, own).alias("family"), p.alias("earliest"), first.alias("first_listed"), F.coalesce(p != first, F.lit(False)).alias("differs"))


@query
def split_codes(spark, d):
    c = text.split_codes(F.col("cpc_codes"))
    return records(spark, d).select("rec_id", F.array_join(c, ";;").alias("codes"), F.size(c).cast("bigint").alias("n_codes"))


@query
def code_prefix_slice(spark, d):
    s = text.code_slices(text.split_codes(F.col("cpc_codes")), 8)
    return records(spark, d).select("rec_id", F.array_join(s, ";;").alias("slices"), F.size(s).cast("bigint").alias("n_slices"))


@query
def code_prefix_counts(spark, d):
    s = text.code_slices(text.split_codes(F.col("cpc_codes")), 8)
    return records(spark, d).select(F.explode(s).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


@query
def prefix_evidence(spark, d):
    return tagged(spark, d).select("rec_id", "ev_core", "ev_topic_code", "ev_device_code")


@query
def title_abstract_text(spark, d):
    return records(spark, d).select("rec_id", F.md5(text.title_and_body(F.col("title"), F.col("abstract"))).alias("text_md5"))


@query
def mixed_dates(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(F.col("o_orderkey") % 7 == 0, F.lit("31/31/2025")).otherwise(F.date_format("o_orderdate", "d/M/yyyy")).alias("written"))
    day = dates.mixed_date(F.col("written"))
    return o.groupBy(F.year(day).alias("year"), F.month(day).alias("month")).agg(F.count("*").alias("n"))


@query
def grant_label(spark, d):
    x = records(spark, d).withColumn("label", F.when(is_grant(), "grant").otherwise("application"))
    return x.groupBy("label", "jurisdiction").agg(F.count("*").alias("n"))


@query
def numeric_coercion(spark, d):
    x = read(spark, d, "events").select("event_id", F.get_json_object("props", "$.page").alias("t"), F.substring("event_type", 1, 1).alias("u"))
    return x.agg(F.count("*").alias("n"), F.count(F.col("t").try_cast("double")).alias("n_number"), F.count(F.col("u").try_cast("double")).alias("n_letter_number"))


@query
def impute_scale(spark, d):
    x = records(spark, d).select("rec_id", F.year(F.when(~F.year("filing_date").isin(1900, 9999), F.col("filing_date"))).alias("y"))
    return measure.impute_scale(x, "y").select("rec_id", r6("scaled").alias("scaled"))


@query
def category_hint(spark, d):
    return read(spark, d, "validation_labels").where("architecture is not null").groupBy(text.strip(F.col("architecture")).alias("free_text")).agg(F.count("*").alias("n")).select("free_text", "n", evidence.first_hint(F.col("free_text"), V.HINTS).alias("suggested"))


@query
def category_canonical(spark, d):
    table = spark.createDataFrame(list(V.CANONICAL.items()), "suggested string, category string")
    x = category_hint(spark, d)
    return dedup.lookup(x, table, "suggested", "category").groupBy("category").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_values"))


@query
def truncation_flags(spark, d):
    return measure.truncation_flags(records(spark, d), "_source_file")


@query
def evidence_names(spark, d):
    return tagged(spark, d).groupBy(evidence.evidence_names().alias("evidence")).agg(F.count("*").alias("n"))


# ---- evidence and rules -----------------------------------------------------------------------------------------


@query
def regex_evidence(spark, d):
    return tagged(spark, d).select("rec_id", "ev_topic_text", "ev_mechanism", "ev_device_text", "ev_weak")


@query
def subject_veto(spark, d):
    return evidence.vetoes(records(spark, d), V.VOCAB).select("rec_id", "veto_title", "veto_text")


@query
def rule_production(spark, d):
    return tagged(spark, d).select("rec_id", "cond_topic", "cond_device", "tier", "in_corpus")


@query
def rule_second_tier(spark, d):
    x = evidence.apply_rule(evidence.tag_evidence(records(spark, d), V.VOCAB), evidence.RuleOptions(require_text=False, second_tier=True, mechanism_counts=False))
    return x.groupBy("tier").agg(F.count("*").alias("n"))


@query
def rule_variants(spark, d):
    return evidence.rule_counts(tagged(spark, d))


@query
def attrition(spark, d):
    return evidence.attrition(tagged(spark, d)).select(F.col("ordinal").cast("bigint").alias("ordinal"), "step", "n", r6("pct_of_base").alias("pct_of_base"))


@query
def evidence_composition(spark, d):
    return evidence.composition(tagged(spark, d))


@query
def weak_only(spark, d):
    return evidence.weak_only(tagged(spark, d))


@query
def taxonomy_multilabel(spark, d):
    return classed(spark, d).select("rec_id", F.array_join("labels", ",").alias("labels"), F.array_join("title_labels", ",").alias("title_labels"))


@query
def label_structure(spark, d):
    return rounded(evidence.label_structure(classed(spark, d)), "pct_none", "pct_one", "pct_more", "mean_labels")


@query
def evidence_strength(spark, d):
    return rounded(evidence.evidence_strength(classed(spark, d), V.TAXONOMY), "strength")


@query
def doc_type_filter(spark, d):
    x = records(spark, d).withColumn("t", F.lower(F.trim("document_type"))).withColumn("kept", F.coalesce(F.col("t").isin(*V.KEPT_TYPES), F.lit(False)) & (F.coalesce("jurisdiction", F.lit("")) == "US"))
    return x.groupBy("t", "kept").agg(F.count("*").alias("n"))


# ---- deduplication and sets -------------------------------------------------------------------------------------


def _first_order() -> list[str]:
    return ["_source_folder", "_source_file", "rec_id"]


@query
def dedup_first(spark, d):
    return dedup.keep_first(records(spark, d).select("lens_id", *_first_order(), "pub_year"), ["lens_id"], _first_order()).select("lens_id", "rec_id", "pub_year")


def _keyed(spark, d) -> DataFrame:
    """Records under the key of their invention: the family, else the earliest priority, else the application, else
    the record itself."""
    key = dedup.group_key("rec_id", F.col("_family"), text.last_filled(F.col("priority_numbers")), F.col("_appno"))
    x = over_cores(records(spark, d).select("rec_id", "_family", "priority_numbers", "_appno", "document_type", "kind", "pub_year"), "rec_id")
    return x.select("rec_id", key.alias("family"), dedup.group_key("rec_id", F.col("_appno")).alias("application"), "document_type", "kind", "pub_year")


@query
def dedup_preferred(spark, d):
    return dedup.keep_preferred(_keyed(spark, d), ["application"], F.when(is_grant(), 0).otherwise(1), "rec_id").select("application", "rec_id")


@query
def collapse_invention(spark, d):
    return dedup.collapse(_keyed(spark, d), "family", is_grant(), "rec_id").select("family", "rec_id", "granted")


@query
def collapse_apps_only(spark, d):
    return dedup.collapse(_keyed(spark, d), "family", is_grant(), "rec_id", "apps_only").select("family", "rec_id", "granted")


@query
def collapse_grants_only(spark, d):
    return dedup.collapse(_keyed(spark, d), "family", is_grant(), "rec_id", "grants_only").select("family", "rec_id")


@query
def granted_flag(spark, d):
    return dedup.granted_flag(_keyed(spark, d), "family", is_grant()).groupBy("pub_year").agg(F.count("*").alias("n"), F.count_if("granted").alias("n_granted"))


@query
def multi_source_ids(spark, d):
    return dedup.in_several(records(spark, d), "lens_id", "_source_folder")


@query
def multi_source_families(spark, d):
    return dedup.in_several(_keyed(spark, d).withColumn("s", F.when(is_grant(), "grant").otherwise("application")), "family", "s")


@query
def distinct_counts(spark, d):
    return dedup.distinct_counts(records(spark, d), ["lens_id", "_appno", "_family", "display_key"])


@query
def freq_table(spark, d):
    return rounded(dedup.frequency(records(spark, d), "jurisdiction"), "pct")


@query
def crosstab(spark, d):
    return dedup.crosstab(records(spark, d).withColumn("j", F.coalesce("jurisdiction", F.lit("none"))), "pub_year", "j", ["US", "EP", "DE", "none"])


@query
def union_shared_columns(spark, d):
    a = records(spark, d).where("_source_folder = 'by_filing'").drop("abstract").withColumn("only_here", F.lit(1))
    b = records(spark, d).where("_source_folder = 'by_publication'").drop("ingested_at")
    return dedup.union_shared([a, b]).groupBy("_source_folder").agg(F.count("*").alias("n"), F.count("title").alias("n_title"), F.sum("rec_id").alias("sum_id"))


@query
def overlap_pct(spark, d):
    x = records(spark, d).withColumn("k", text.clean_number(F.col("application_number")))
    return rounded(dedup.overlap(x.where("_source_folder = 'by_filing'"), x.where("_source_folder = 'by_publication'"), "k"), "pct_of_a")


@query
def row_counts(spark, d):
    return read(spark, d, "raw_records").groupBy("_source_folder", "_source_file").agg(F.count("*").alias("n_rows"))


# ---- joins ------------------------------------------------------------------------------------------------------


def _labels(spark, d) -> DataFrame:
    """The last label of each publication of the first sheet."""
    x = read(spark, d, "validation_labels").withColumn("gold", validate.norm_label(F.col("is_ai_hardware")))
    return x.groupBy("publication_number").agg(F.max_by(F.struct("gold", "side", "stage", "architecture", "label_id"), F.struct("labelled_at", "label_id")).alias("l")).select("publication_number", "l.*")


def _one_per_key(spark, d) -> DataFrame:
    """The first record of each labelled publication with its evidence. The labels are met before the texts are read
    for evidence, so that only labelled records are."""
    keys = read(spark, d, "validation_labels").select(F.col("publication_number").alias("display_key"))
    one = dedup.keep_first(records(spark, d).select("display_key", "rec_id", "title", "abstract", "cpc_codes").join(keys, "display_key", "left_semi"), ["display_key"], ["rec_id"])
    return evidence.apply_rule(evidence.tag_evidence(one, V.VOCAB))


@query
def left_label_join(spark, d):
    x = _labels(spark, d).join(_one_per_key(spark, d), F.col("publication_number") == F.col("display_key"), "left")
    return x.groupBy("side").agg(F.count("*").alias("n"), F.count("rec_id").alias("n_matched"), F.count_if("in_corpus").alias("n_in_corpus"))


@query
def inner_text_join(spark, d):
    x = _labels(spark, d).join(_one_per_key(spark, d), F.col("publication_number") == F.col("display_key"))
    return x.select("publication_number", "gold", F.length("text").cast("bigint").alias("n_text"))


@query
def anti_seed(spark, d):
    e = read(spark, d, "embeddings")
    return dedup.anti(e, e.where("label = 0"), "vec_id").groupBy("label").agg(F.count("*").alias("n"))


@query
def annotator_pairs(spark, d):
    b = read(spark, d, "validation_labels_annotator2").groupBy("publication_number").agg(F.max_by(validate.norm_label(F.col("is_ai_hardware")), F.struct("labelled_at", "label2_id")).alias("second"))
    pairs = _labels(spark, d).select("publication_number", F.col("gold").alias("first")).join(b, "publication_number")
    return validate.disagreements(pairs, "first", "second").select("publication_number", "first", "second")


# ---- measurement ------------------------------------------------------------------------------------------------


@query
def annual_share_wilson(spark, d):
    return rounded(measure.annual_shares(classed(spark, d).where("in_corpus"), "pub_year", "labels", CLASSES, V.FIRST, V.LAST, V.COMPLETE_TO), "pct", "lo", "hi")


def _annual(spark, d) -> DataFrame:
    return measure.filtered_vs_full(classed(spark, d), "pub_year", "labels", CLASSES, F.col("in_corpus"), V.FIRST, V.COMPLETE_TO)


@query
def filtered_vs_full_annual(spark, d):
    return rounded(_annual(spark, d), "full_pct", "inside_pct", "delta")


@query
def pooled_ratio(spark, d):
    return rounded(measure.pooled(_annual(spark, d)), "full_pct", "inside_pct", "ratio")


@query
def trend_delta(spark, d):
    return rounded(measure.trend_delta(_annual(spark, d), 5), "full_delta", "inside_delta")


def _shares(spark, d) -> DataFrame:
    return measure.annual_shares(classed(spark, d), "pub_year", "labels", CLASSES, V.FIRST, V.LAST, V.COMPLETE_TO)


@query
def milestone_shares(spark, d):
    return rounded(measure.milestones(_shares(spark, d), [2012, 2016, 2022]), "pct_2012", "pct_2016", "pct_2022")


@query
def growth_ratio(spark, d):
    return rounded(measure.growth(_shares(spark, d), 2017, 2022), "growth")


@query
def trajectory(spark, d):
    return rounded(measure.trajectory(_shares(spark, d), 2016), "pct", "lo", "hi")


@query
def ratio_robustness(spark, d):
    """Ratios by publication and by filing year side by side, lowest first."""
    by_pub = measure.pooled(_annual(spark, d)).select("category", F.col("ratio").alias("ratio_pub"))
    y = classed(spark, d).withColumn("filing_year", F.year("filing_date"))
    by_filing = measure.pooled(measure.filtered_vs_full(y, "filing_year", "labels", CLASSES, F.col("in_corpus"), V.FIRST, V.COMPLETE_TO)).select("category", F.col("ratio").alias("ratio_filing"))
    return rounded(by_pub.join(by_filing, "category"), "ratio_pub", "ratio_filing").orderBy("ratio_pub")


@query
def ratio_rank_agreement(spark, d):
    """Do both ways to date records rank the categories alike?"""
    return rounded(cluster.spearman(ratio_robustness(spark, d), "ratio_pub", "ratio_filing"), "rho")


@query
def year_histogram(spark, d):
    return measure.year_histogram(tagged(spark, d).where("in_corpus"), "pub_year", 2012)


@query
def lag_stats(spark, d):
    return rounded(measure.lag_stats(records(spark, d), "filing_date", "pub_date"), "mean_lag", "p90_lag")


@query
def date_coverage(spark, d):
    return rounded(measure.date_coverage(records(spark, d), "_source_folder", "filing_date"), "pct_missing")


@query
def cluster_sizes(spark, d):
    return rounded(measure.cluster_sizes(read(spark, d, "embeddings").withColumn("c", F.when(F.col("vec_id") % 5 == 0, -1).otherwise(F.col("label"))), "c"), "noise_pct", "largest_pct")


@query
def cluster_year_counts(spark, d):
    return measure.cluster_years(read(spark, d, "embeddings").withColumn("y", 2010 + F.col("vec_id") % 7), "label", "y")


@query
def eta_squared(spark, d):
    x = read(spark, d, "embeddings").withColumn("y", 2010 + F.col("vec_id") % 7 + F.col("label"))
    return rounded(measure.eta_squared(x, "y", "label"), "eta2")


@query
def spearman(spark, d):
    o = read(spark, d, "lineitem")
    return rounded(cluster.spearman(o, "l_quantity", "l_extendedprice"), "rho")


# ---- validation -------------------------------------------------------------------------------------------------


def _judged(spark, d) -> DataFrame:
    return _labels(spark, d).join(_one_per_key(spark, d), F.col("publication_number") == F.col("display_key"), "left").na.fill(False, list(evidence.FLAGS) + ["in_corpus"]).withColumn("tier", F.coalesce("tier", F.lit("excluded")))


@query
def label_norm(spark, d):
    x = read(spark, d, "validation_labels")
    return x.groupBy(validate.norm_label(F.col("is_ai_hardware")).alias("label")).agg(F.count("*").alias("n"))


@query
def rule_scores(spark, d):
    return rounded(validate.rule_scores(evidence.with_rules(_judged(spark, d)), "gold"), "precision", "recall", "f1")


@query
def wrong_records(spark, d):
    return validate.wrong_records(_judged(spark, d), "gold", evidence.satisfies("core | topic & device"), "publication_number", evidence.evidence_names())


@query
def precision_by_side(spark, d):
    return rounded(validate.precision_by(_judged(spark, d), "gold", "side", "stage"), "precision_pct", "lo", "hi")


@query
def precision_by_tier(spark, d):
    return rounded(validate.precision_by(_judged(spark, d), "gold", "tier"), "precision_pct", "lo", "hi")


@query
def class_confusion(spark, d):
    hint = evidence.first_hint(F.coalesce("architecture", F.lit("")), V.HINTS)
    canon = F.create_map(*[F.lit(x) for kv in V.CANONICAL.items() for x in kv])
    x = evidence.tag_classes(_judged(spark, d).withColumn("gold_set", F.array_compact(F.array(F.element_at(canon, F.when(hint != "", hint))))), V.TAXONOMY)
    return rounded(validate.class_confusion(x, "gold_set", "labels", CLASSES, F.coalesce("stage", F.lit("none"))), "precision", "recall")


@query
def label_report(spark, d):
    about = F.coalesce(text.strip(F.col("architecture")), F.lit("")) != ""
    return rounded(validate.label_report(_labels(spark, d), "gold", "side", about & (F.upper(F.trim("architecture")) != "NONE")), "pct", "lo", "hi")


@query
def merged_labels(spark, d):
    """The first sheet with a stale second label, replaced by what the second sheet says."""
    b = read(spark, d, "validation_labels_annotator2").groupBy("publication_number").agg(F.max_by("is_ai_hardware", F.struct("labelled_at", "label2_id")).alias("second"))
    return sampling.merge_labels(_labels(spark, d).select("publication_number", "gold", F.lit("stale").alias("second")), b, "publication_number", ["second"])


@query
def category_sets(spark, d):
    """Labels that name several categories, each led to its canonical name by its own hint."""
    one = lambda x: evidence.first_hint(x, V.HINTS)
    x = read(spark, d, "validation_labels").select("label_id", F.array_join(F.filter(F.transform(text.split_list(F.col("architecture"), ","), one), lambda h: h != ""), ",").alias("hints"))
    return x.select("label_id", F.array_join(F.array_sort(dedup.canonical_list(F.col("hints"), V.CANONICAL)), ",").alias("categories"))


@query
def none_cross(spark, d):
    x = _judged(spark, d).withColumn("gold_set", F.when(F.upper(F.trim("architecture")) == "NONE", F.array(F.lit("NONE"))).when(F.col("architecture").isNotNull(), F.array(F.lit("class"))).otherwise(F.array().cast("array<string>")))
    return validate.none_cross(evidence.tag_classes(x, V.TAXONOMY), "gold_set", "labels")


@query
def kappa(spark, d):
    b = read(spark, d, "validation_labels_annotator2").groupBy("publication_number").agg(F.max_by(validate.norm_label(F.col("is_ai_hardware")), F.struct("labelled_at", "label2_id")).alias("second"))
    pairs = _labels(spark, d).select("publication_number", F.col("gold").alias("first")).join(b, "publication_number")
    return rounded(validate.agreement(pairs, "first", "second"), "raw_pct", "kappa")


# ---- vectors ----------------------------------------------------------------------------------------------------


def _seeded(spark, d) -> DataFrame:
    return vectors.seed_scores(read(spark, d, "embeddings"), "vec_id", "embedding", F.col("label") == 0)


@query
def l2_normalise(spark, d):
    e = read(spark, d, "embeddings").withColumn("v", F.transform("embedding", lambda x: x * 3))
    n = e.select("vec_id", vectors.l2_normalise(F.col("v")).alias("u"))
    return n.select("vec_id", r6(F.get("u", 0)).alias("first"), r6(vectors.norm2(F.col("u"))).alias("norm"))


@query
def topk_seed_score(spark, d):
    return rounded(_seeded(spark, d), "score")


@query
def seed_quantiles(spark, d):
    return rounded(vectors.quantiles(_seeded(spark, d).where("is_seed"), "score"), "p10", "p25", "p50", "p75", "p90")


@query
def score_bands(spark, d):
    x = _seeded(spark, d).where("not is_seed").withColumn("band", F.coalesce(stats.band(r6("score"), V.LOW_BANDS), F.lit("below")))
    return x.groupBy("band").agg(F.count("*").alias("n"))


@query
def band_precision(spark, d):
    x = _seeded(spark, d).join(read(spark, d, "embeddings").select("vec_id", "label"), "vec_id").where("not is_seed")
    x = x.withColumn("score", r6("score")).withColumn("gold", F.when(F.col("label") % 3 == 0, "Y").otherwise("N"))
    return rounded(validate.band_precision(x, "score", "gold", V.LOW_BANDS), "precision", "cum_precision")


@query
def expand_accept(spark, d):
    acc = vectors.accept(_seeded(spark, d).withColumn("score", r6("score")), 0.2)
    return acc.join(read(spark, d, "embeddings").select("vec_id", "label"), "vec_id").groupBy("label").agg(F.count("*").alias("n"))


@query
def expansion_union(spark, d):
    """Seeds, accepted candidates and the best of every band under each other, each row once."""
    x = _seeded(spark, d).withColumn("score", r6("score"))
    parts = [x.where("is_seed"), vectors.accept(x, 0.2), sampling.band_sample(x.where("not is_seed"), "score", "vec_id", V.LOW_BANDS, 20)]
    return dedup.union_distinct([p.select("vec_id", F.lit(n).alias("part")) for n, p in zip(("seed", "accepted", "sample"), parts)], ["vec_id"]).groupBy("part").agg(F.count("*").alias("n"))


def _aligned(spark, d) -> tuple[DataFrame, DataFrame]:
    return vectors.align(records(spark, d).select("rec_id", "pub_year", "filing_date"), "rec_id", read(spark, d, "embeddings"), "vec_id")


@query
def vector_alignment(spark, d):
    return _aligned(spark, d)[1]


@query
def aligned_eta_squared(spark, d):
    return rounded(measure.eta_squared(_aligned(spark, d)[0], "pub_year", "label"), "eta2")


@query
def aligned_cluster_years(spark, d):
    return measure.cluster_years(_aligned(spark, d)[0], "label", "pub_year")


@query
def cluster_map(spark, d):
    x = _aligned(spark, d)[0].select("label", "pub_year", F.get("embedding", 0).cast("double").alias("x"), F.get("embedding", 1).cast("double").alias("y"))
    return rounded(cluster.cluster_map(x, "label", "x", "y", "pub_year", manual={0: "seeds"}, largest=3), "pct", "median_year", "cx", "cy")


def _letters(texts: list[str]) -> list[list[float]]:
    """A small encoder for the resumable run: shares of the vowels."""
    return [[t.count(v) / max(len(t), 1) for v in "aeiou"] for t in texts]


@query
def resumable_embedding(spark, d):
    """Two runs that share the work: the first stops at a third of the records, the second does the rest."""
    x = records(spark, d).select("rec_id", text.title_and_body(F.col("title"), F.col("abstract")).alias("text"))
    path = shared_folder(spark)
    first = embed.encode_resumably(x, "rec_id", "text", _letters, path, limit=max(1, x.count() // 3))
    second = embed.encode_resumably(x, "rec_id", "text", _letters, path)
    return spark.read.parquet(path).agg(F.lit(first).cast("bigint").alias("n_first"), F.lit(second).cast("bigint").alias("n_second"), F.count("*").alias("n"), F.countDistinct("rec_id").alias("n_ids"), F.min(F.size("embedding")).cast("bigint").alias("dims"))


@query
def view_fusion(spark, d):
    e = read(spark, d, "embeddings").withColumn("t", F.array((F.col("vec_id") % 7) / 6.0))
    x = vectors.fuse(e, {"semantic": (vectors.l2_normalise(F.col("embedding")), 1.0), "codes": (F.array(F.lit(1.0)), 0.0), "time": (F.col("t"), 0.15)})
    return x.select("vec_id", F.size("fused").cast("bigint").alias("dims"), r6(vectors.norm2(F.col("fused"))).alias("norm"))


@query
def ari_nmi(spark, d):
    e = read(spark, d, "embeddings").withColumn("b", F.floor(F.col("vec_id") * 7 % 11 / 2) + F.col("label") % 3)
    return rounded(cluster.agreement(e, "label", "b"), "ari", "nmi")


@query
def silhouette_exact(spark, d):
    return rounded(cluster.silhouette(read(spark, d, "embeddings"), "vec_id", "embedding", "label"), "silhouette")


@query
def centroid_medians(spark, d):
    e = read(spark, d, "embeddings").select("label", F.get("embedding", 0).cast("double").alias("x"), F.get("embedding", 1).cast("double").alias("y"))
    return rounded(cluster.centroids(e, "label", "x", "y"), "cx", "cy")


@query
def hashed_embedding(spark, d):
    x = records(spark, d)
    return embed.hashed_tfidf(x.select("rec_id", text.title_and_body(x["title"], x["abstract"]).alias("text")), "rec_id", "text")


@query
def code_view(spark, d):
    return embed.code_view(records(spark, d), "rec_id", "cpc_codes")[0]


@query
def pca_hdbscan(spark, d):
    red = cluster.reduce_dimensions(read(spark, d, "embeddings"), "embedding", 10)
    return cluster.cluster_table(red, "vec_id", "reduced", 15, 5)


@query
def kmeans_clusters(spark, d):
    return cluster.kmeans(read(spark, d, "embeddings"), "vec_id", "embedding", 10)


def _grid(spark, d) -> DataFrame:
    red = cluster.reduce_dimensions(read(spark, d, "embeddings"), "embedding", 5)
    return cluster.grid(red, "vec_id", "reduced", [5, 10, 20, 75, 100, 150, 200, 300], [3, 5, 10, 20])


@query
def hdbscan_grid(spark, d):
    return _grid(spark, d)


@query
def grid_select(spark, d):
    return cluster.select_configurations(_grid(spark, d).withColumn("g", F.lit("all")), ["g"], too_large=100.0)


@query
def representation_grid(spark, d):
    """Code heads of 4 and 8 characters x three weights of the codes x three numbers of neighbours x four least sizes."""
    e = read(spark, d, "embeddings").withColumn("sem", vectors.l2_normalise(F.col("embedding")))
    coded = e.select("vec_id").join(records(spark, d).select(F.col("rec_id").alias("vec_id"), "cpc_codes"), "vec_id", "left")
    for g in (4, 8):
        e = e.join(embed.code_view(coded, "vec_id", "cpc_codes", g)[0].withColumnRenamed("codes_view", f"codes{g}"), "vec_id")
    views = {g: {"semantic": "sem", "codes": f"codes{g}"} for g in (4, 8)}
    rows = cluster.representation_grid(cut_lineage(e), "vec_id", views, [0.15, 0.3, 0.6], "codes", {"semantic": 1.0}, 5, [10, 25, 50, 100], [5, 10, 15])
    return cluster.recommend(rows)


@query
def view_ablation(spark, d):
    e = read(spark, d, "embeddings").withColumn("sem", vectors.l2_normalise(F.col("embedding"))).withColumn("y", (2010 + F.col("vec_id") % 7).cast("double")).withColumn("time", F.array((F.col("y") - 2010) / 6))
    coded = e.select("vec_id").join(records(spark, d).select(F.col("rec_id").alias("vec_id"), "cpc_codes"), "vec_id", "left")
    e = cut_lineage(e.join(embed.code_view(coded, "vec_id", "cpc_codes")[0], "vec_id"))
    views, base = {"semantic": "sem", "codes": "codes_view", "temporal": "time"}, {"semantic": 1.0, "codes": 0.3, "temporal": 0.0}
    return cluster.ablation(e, "vec_id", views, base, {"temporal": [0.0, 0.05, 0.15, 0.3, 0.6], "codes": [0.0, 0.15, 0.3, 0.6]}, "y", 5, 15, 5)


@query
def tfidf_top_terms(spark, d):
    return rounded(terms.top_terms(read(spark, d, "documents").where("lang = 'en' and section is not null"), "section", "doc_id", "text"), "weight")


@query
def section_top_terms(spark, d):
    """As tfidf_top_terms, which SQL checks on English texts, but over all documents; no section is a group too."""
    return rounded(terms.top_terms(read(spark, d, "documents"), "section", "doc_id", "text"), "weight")


@query
def cluster_names(spark, d):
    x = read(spark, d, "documents")
    return terms.cluster_names(x.withColumn("c", F.when(F.col("section") == "claims", 1).otherwise(0)), "c", "doc_id", "text", {1: "claims"})


# ---- samples ----------------------------------------------------------------------------------------------------


@query
def stratified_sample(spark, d):
    x = tagged(spark, d).withColumn("side", sampling.strata(F.col("cond_topic"), F.col("cond_device"), F.col("in_corpus")))
    return sampling.stratified(x, "side", "rec_id", {"retained": 120, "excluded_near": 60, "excluded_far": 20}).select("rec_id", "side")


@query
def blind_sheet(spark, d):
    x = tagged(spark, d).withColumn("side", sampling.strata(F.col("cond_topic"), F.col("cond_device"), F.col("in_corpus"))).select("rec_id", "display_key", "side", "tier")
    s = sampling.stratified(x, "side", "rec_id", {"retained": 120, "excluded_near": 60, "excluded_far": 20})
    return sampling.blind_sheet(s, "rec_id", ["side", "tier"], ["is_topic", "notes"]).withColumn("row", F.col("row").cast("bigint"))


@query
def band_sample(spark, d):
    x = _seeded(spark, d).where("not is_seed").withColumn("score", r6("score"))
    return sampling.band_sample(x, "score", "vec_id", V.LOW_BANDS, 20).select("vec_id", "band")


# ---- stream -----------------------------------------------------------------------------------------------------


@query
def stream_ingest(spark, d):
    """The events as a file stream, each id once, appended exactly once to a table in the shared folder."""
    rows = ingest.stream_parquet(spark, f"{d}/events.parquet*", read(spark, d, "events").schema)
    out = shared_folder(spark)
    ingest.ingest_available(rows, lambda x: ingest.first_seen(x, "event_id", "ts", "1 day"), f"{out}/table", f"{out}/state").awaitTermination()
    return spark.read.parquet(f"{out}/table").groupBy("event_type").agg(F.count("*").alias("n"))


# ---- raw records ------------------------------------------------------------------------------------------------


def _raw(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return read(spark, d, "raw_records"), read(spark, d, "export_files")


@query
def p3_found(spark, d):
    return raw_records.layout_changes(*_raw(spark, d))


@query
def p3_types(spark, d):
    return raw_records.field_versions(*_raw(spark, d))


@query
def p3_table(spark, d):
    return raw_records.unified_table(*_raw(spark, d))


@query
def p5_found(spark, d):
    return raw_records.failing_records(*_raw(spark, d)).select("raw_id", "fail_reason")


@query
def p5_loaded(spark, d):
    return raw_records.load_records(*_raw(spark, d)).where("fail_reason is null").select("raw_id", "_source_folder", "_source_file", "record_no", "fields")
