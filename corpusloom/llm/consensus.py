"""Consensus of several annotators' yes/no answers by expectation-maximisation over confusion matrices.

Items' last answers are folded to patterns: the sorted list of (annotator, answer) with the number of items that
have it. Each iteration reads the patterns once and sends four sums per annotator to the driver, so the work grows with the patterns and the driver's share only with the number of annotators. Agreement corrected for
chance (Krippendorff's alpha and, per pair, Cohen's kappa) is reported apart from the fit.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.stats import kappa
from corpusloom.functions.text import match_key, narrow, strip
from corpusloom.session import cut_lineage, small_side


def yes_no(c: Column) -> Column:
    """``Y``, ``N``, or null for an answer that states neither (blank, unsure, borderline, both)."""
    word = F.lower(strip(narrow(c)))
    first = F.regexp_extract(word, r"^([\p{L}\p{N}]+)", 1)
    both = word.rlike(r"^(y|yes)\s*(/|or|and|&)\s*(n|no)\b|^(n|no)\s*(/|or|and|&)\s*(y|yes|a)\b|^not?\s+(sure|clear|idea|known|decided|yet)\b|^n\.\s?a\b")
    return F.when(both, F.lit(None)).when(first.isin("y", "yes", "true", "1"), "Y").when(first.isin("n", "no", "false", "0"), "N")


def last_answers(first_sheet: DataFrame, more: DataFrame) -> DataFrame:
    """(item, annotator, answer) of the last answer of each person on each item over both tables, if it states yes
    or no. Later ``labelled_at`` wins (null is earliest), then the second table, then the larger id. Rows without
    item or annotator say nothing."""
    pick = lambda df, sheet, key: df.select(match_key(F.col("publication_number")).alias("item"), F.lower(strip(F.col("annotator"))).alias("annotator"), yes_no(F.col("is_ai_hardware")).alias("answer"), F.col("labelled_at").alias("at"), F.lit(sheet).alias("sheet"), F.col(key).alias("id"))
    said = pick(first_sheet, 1, "label_id").unionByName(pick(more, 2, "label2_id")).where("item <> '' and annotator <> ''")
    last = said.groupBy("item", "annotator").agg(F.max(F.struct("at", "sheet", "id", "answer"))["answer"].alias("answer"))
    return last.where("answer is not null")


#: Up to so many annotators their rates are a literal in the plan; beyond, a table that is joined.
LITERAL = 1000


def fit(answers: DataFrame, iterations: int = 40, smoothing: float = 1.0, tolerance: float = 1e-6, literal: int = LITERAL) -> tuple[DataFrame, DataFrame, float]:
    """Items with the posterior of yes, annotators with their confusion matrix, and the prior of yes.

    Starts at each item's share of yes; the rates are smoothed by ``smoothing`` answers of either kind. Each iteration
    is one aggregation, of a row per annotator and one for the prior."""
    spark = answers.sparkSession
    items = cut_lineage(answers.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("annotator", "answer"))).alias("votes")).withColumn("_p", F.monotonically_increasing_id()))
    pats = cut_lineage(items.groupBy("votes").agg(F.count("*").alias("n")).withColumn("_p", F.monotonically_increasing_id()))
    prior = 0.5
    rates: dict[str, tuple[float, float, int]] = {}
    whole = F.array(F.struct(F.lit(None).cast("string").alias("annotator"), F.lit("Y").alias("answer")))  # the prior's own row
    for _ in range(iterations):
        one = _scored(pats, prior, rates, literal).select("n", F.col("p_yes").alias("p"), F.explode(F.concat(whole, "votes")).alias("v"))
        n, p, yes = F.col("n"), F.col("p"), (F.col("v.answer") == "Y").cast("int")
        rows = one.groupBy("v.annotator").agg(F.sum(n * p * yes).alias("yy"), F.sum(n * p).alias("y"), F.sum(n * (1 - p) * (1 - yes)).alias("nn"), F.sum(n * (1 - p)).alias("no"), F.sum("n").alias("n")).collect()
        if not rows:
            break
        total = next(r for r in rows if r["annotator"] is None)
        new = {r["annotator"]: ((r["yy"] + smoothing) / (r["y"] + 2 * smoothing), (r["nn"] + smoothing) / (r["no"] + 2 * smoothing), r["n"]) for r in rows if r["annotator"] is not None}
        moved = max((abs(new[a][i] - rates.get(a, (0, 0, 0))[i]) for a in new for i in (0, 1)), default=0.0)
        rates, prior = new, (total["y"] + smoothing) / (total["n"] + 2 * smoothing)
        if moved < tolerance:
            break
    post = _scored(items, prior, rates, literal).select("item", "votes", "p_yes")
    people = spark.createDataFrame([(a, s, t, 1 - s, 1 - t, n) for a, (s, t, n) in sorted(rates.items())], "annotator string, yes_given_yes double, no_given_no double, no_given_yes double, yes_given_no double, n_answers long")
    return post, people, prior


def _scored(pats: DataFrame, prior: float, rates: dict[str, tuple[float, float, int]], literal: int) -> DataFrame:
    """Rows (_p, votes) with ``p_yes``; before the first fit the share of yes."""
    if not rates:
        return pats.withColumn("p_yes", F.size(F.filter("votes", lambda v: v["answer"] == "Y")) / F.size("votes"))
    odds = [(a, math.log(s / (1 - t)), math.log((1 - s) / t)) for a, (s, t, _) in rates.items()]
    start = math.log(prior / (1 - prior))
    if len(odds) <= literal:
        yes, no = (F.create_map(*[F.lit(z) for o in odds for z in (o[0], o[i])]) for i in (1, 2))
        total = F.aggregate("votes", F.lit(start), lambda a, v: a + F.when(v["answer"] == "Y", F.element_at(yes, v["annotator"])).otherwise(F.element_at(no, v["annotator"])))
        return pats.withColumn("p_yes", 1 / (1 + F.exp(-total)))
    table = small_side(pats.sparkSession.createDataFrame(odds, "annotator string, yes double, no double"))
    votes = pats.select("_p", F.explode("votes").alias("v")).select("_p", "v.annotator", "v.answer").join(table, "annotator")
    per = votes.groupBy("_p").agg(F.sum(F.when(F.col("answer") == "Y", F.col("yes")).otherwise(F.col("no"))).alias("_odds"))
    return pats.join(per, "_p").withColumn("p_yes", 1 / (1 + F.exp(-(F.lit(start) + F.col("_odds"))))).drop("_odds")


def consensus(first_sheet: DataFrame, more: DataFrame, min_answers: int = 3) -> DataFrame:
    """(publication_number as the first sheet writes it, consensus Y or N, p_yes, n_answers) for each item of the
    first sheet with at least ``min_answers`` persons' yes/no answers. If the first sheet writes an item in several
    ways, its earliest label's writing counts. An even posterior goes to N."""
    post, _, _ = fit(last_answers(first_sheet, more))
    written = first_sheet.withColumn("item", match_key(F.col("publication_number"))).where("item <> ''").groupBy("item").agg(F.min(F.struct("label_id", "publication_number"))["publication_number"].alias("publication_number"))
    return post.where(F.size("votes") >= min_answers).join(written, "item").select("publication_number", F.when(F.col("p_yes") > 0.5, "Y").otherwise("N").alias("consensus"), "p_yes", F.size("votes").alias("n_answers"))


def annotators(first_sheet: DataFrame, more: DataFrame) -> DataFrame:
    """Reliability per annotator: the confusion matrix and the balanced accuracy."""
    people = fit(last_answers(first_sheet, more))[1]
    return people.withColumn("reliability", (F.col("yes_given_yes") + F.col("no_given_no")) / 2)


def agreement(first_sheet: DataFrame, more: DataFrame) -> DataFrame:
    """Agreement measures over items with two or more answers: observed share of agreeing pairs and
    Krippendorff's alpha (nominal). Null where undefined."""
    per = last_answers(first_sheet, more).groupBy("item").agg(F.count_if(F.col("answer") == "Y").alias("y"), F.count("*").alias("m")).where("m > 1")
    t = per.agg(F.count("*").alias("n_items"), F.sum("m").alias("n_answers"), F.sum("y").alias("n_yes"), F.sum(2 * F.col("y") * (F.col("m") - F.col("y")) / (F.col("m") - 1)).alias("d"), F.sum(F.col("y") * (F.col("m") - F.col("y"))).alias("dis"), F.sum(F.col("m") * (F.col("m") - 1) / 2).alias("pairs"))
    n, y = F.col("n_answers"), F.col("n_yes")
    expected = 2 * y * (n - y) / (n - 1)
    return t.select("n_items", "n_answers", "n_yes", F.when(F.col("pairs") > 0, 1 - F.col("dis") / F.col("pairs")).alias("observed_agreement"), F.when((n > 1) & (expected > 0), 1 - F.col("d") / expected).alias("alpha"))


def pair_kappa(first_sheet: DataFrame, more: DataFrame) -> DataFrame:
    """Cohen's kappa of every two persons over the items both answered. Pairs arise inside an item's few answers."""
    votes = last_answers(first_sheet, more).groupBy("item").agg(F.array_sort(F.collect_list(F.struct("annotator", "answer"))).alias("v"))
    a = votes.select("item", "v", F.posexplode("v").alias("i", "x")).select("x", F.explode(F.slice("v", F.col("i") + 2, F.size("v"))).alias("z"))
    is_ = lambda p, q: F.count_if((F.col("x.answer") == p) & (F.col("z.answer") == q))
    t = a.groupBy(F.col("x.annotator").alias("annotator_a"), F.col("z.annotator").alias("annotator_b")).agg(is_("Y", "Y").alias("yy"), is_("N", "N").alias("nn"), is_("Y", "N").alias("yn"), is_("N", "Y").alias("ny"))
    return t.select("annotator_a", "annotator_b", (F.col("yy") + F.col("nn") + F.col("yn") + F.col("ny")).alias("n_items"), kappa(*[F.col(k) for k in ("yy", "nn", "yn", "ny")]).alias("kappa"))


__all__ = ["agreement", "annotators", "consensus", "fit", "last_answers", "pair_kappa", "yes_no"]
