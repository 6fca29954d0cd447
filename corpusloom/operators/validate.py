"""Human labels against rules: normalisation, precision, recall, per-class confusion, agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.stats import kappa, kappa_band, percent, wilson
from corpusloom.functions.text import strip


def norm_label(c: Column) -> Column:
    """``Y``, ``N``, ``B`` (borderline) or '' from the first letter of a label; blanks, nulls and ``nan`` give ''."""
    t = F.upper(strip(F.coalesce(c, F.lit(""))))
    first = F.substring(t, 1, 1)
    return F.when((t == "NAN") | ~first.isin("Y", "N", "B"), "").otherwise(first)


def _rates(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    p, r = F.when(tp + fp > 0, tp / (tp + fp)), F.when(tp + fn > 0, tp / (tp + fn))
    return p, r, F.when((p > 0) & (r > 0), 2 * p * r / (p + r))


def rule_scores(df: DataFrame, gold: str) -> DataFrame:
    """(variant, kept, tp, fp, fn, precision, recall, f1) of ``kept_by`` against labels; a borderline label is a no.
    Undefined rates are null; F1 is null if either rate is 0. Rows without a valid label do not count."""
    x = df.where(F.col(gold).isin("Y", "N", "B")).select((F.col(gold) == "Y").alias("yes"), F.explode("kept_by").alias("k"))
    keep, yes = F.col("k.keep"), F.col("yes")
    t = x.groupBy(F.col("k.variant").alias("variant")).agg(F.count_if(keep).alias("kept"), F.count_if(keep & yes).alias("tp"), F.count_if(keep & ~yes).alias("fp"), F.count_if(~keep & yes).alias("fn"))
    p, r, f = _rates(F.col("tp"), F.col("fp"), F.col("fn"))
    return t.withColumns({"precision": p, "recall": r, "f1": f})


def wrong_records(df: DataFrame, gold: str, keep: Column, id_col: str, evidence: Column) -> DataFrame:
    """Records where a rule and the label differ, as ``false negative`` or ``false positive`` with their evidence."""
    x = df.where(F.col(gold).isin("Y", "N", "B")).withColumn("_y", F.col(gold) == "Y").where(keep != F.col("_y"))
    return x.select(id_col, F.when(F.col("_y"), "false negative").otherwise("false positive").alias("kind"), evidence.alias("evidence"))


def precision_by(df: DataFrame, gold: str, *by: str) -> DataFrame:
    """Labelled rows, yes and borderline counts, and precision with its Wilson interval per group."""
    t = df.where(F.col(gold).isin("Y", "N", "B")).groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col(gold) == "Y").alias("n_yes"), F.count_if(F.col(gold) == "B").alias("n_borderline"))
    lo, hi = wilson(F.col("n_yes"), F.col("n"))
    return t.withColumns({"precision_pct": 100.0 * F.col("n_yes") / F.col("n"), "lo": lo, "hi": hi})


def class_confusion(df: DataFrame, gold: str, found: str, classes: list[str], split: Column | None = None) -> DataFrame:
    """(split, category, n_gold, n_found, tp, fp, fn, precision, recall) of two label arrays; with ``split`` also a
    row set ALL. One pass: each record counts for ALL and for its split."""
    x = df.withColumn("split", F.explode(F.array(F.lit("ALL"), split) if split is not None else F.array(F.lit("ALL"))))
    aggs = []
    for i, c in enumerate(classes):
        g, f = F.array_contains(gold, c), F.array_contains(found, c)
        aggs += [F.count_if(g).alias(f"g{i}"), F.count_if(f).alias(f"f{i}"), F.count_if(g & f).alias(f"t{i}")]
    one = x.groupBy("split").agg(*aggs)
    rows = one.select("split", F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.col(f"g{i}").alias("n_gold"), F.col(f"f{i}").alias("n_found"), F.col(f"t{i}").alias("tp")) for i, c in enumerate(classes)])).alias("r")).select("split", "r.*")
    rows = rows.withColumns({"fp": F.col("n_found") - F.col("tp"), "fn": F.col("n_gold") - F.col("tp")})
    p, r, _ = _rates(F.col("tp"), F.col("fp"), F.col("fn"))
    return rows.withColumns({"precision": p, "recall": r})


def none_cross(df: DataFrame, gold: str, found: str, none: str = "NONE") -> DataFrame:
    """Records whose label is only NONE but which have a class, and labelled records in which none was found."""
    is_none, any_found = (F.size(gold) == 1) & F.array_contains(gold, none), F.size(found) > 0
    return df.where(F.size(gold) > 0).agg(F.count_if(is_none).alias("n_none"), F.count_if(is_none & any_found).alias("none_but_found"), F.count_if(~is_none).alias("n_class"), F.count_if(~is_none & ~any_found).alias("class_but_nothing"))


def agreement(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Raw agreement, Cohen's kappa and its band of two yes/no labels over rows where both are Y or N."""
    both = pairs.where(F.col(a).isin("Y", "N") & F.col(b).isin("Y", "N"))
    n = lambda p, q: F.count_if((F.col(a) == p) & (F.col(b) == q))
    t = both.agg(n("Y", "Y").alias("yy"), n("N", "N").alias("nn"), n("Y", "N").alias("yn"), n("N", "Y").alias("ny"))
    total = F.col("yy") + F.col("nn") + F.col("yn") + F.col("ny")
    t = t.withColumn("raw_pct", F.when(total > 0, 100.0 * (F.col("yy") + F.col("nn")) / total)).withColumn("kappa", kappa(F.col("yy"), F.col("nn"), F.col("yn"), F.col("ny")))
    return t.withColumn("band", kappa_band(F.col("kappa")))


def disagreements(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Rows on which both labels are filled and differ."""
    return pairs.where((F.col(a) != "") & (F.col(b) != "") & (F.col(a) != F.col(b)))


def band_precision(df: DataFrame, score: str, gold: str, bands: list[tuple[float, float]], least: int = 5) -> DataFrame:
    """Per score band: labelled rows, yes, precision, and the cumulative precision above the band's floor (null with
    fewer than ``least`` labels). One pass."""
    x = df.where(F.col(gold).isin("Y", "N", "B"))
    yes = F.col(gold) == "Y"
    aggs = []
    for i, (lo, hi) in enumerate(bands):
        inside, above = (F.col(score) >= lo) & (F.col(score) < hi), F.col(score) >= lo
        aggs += [F.count_if(inside).alias(f"n{i}"), F.count_if(inside & yes).alias(f"y{i}"), F.count_if(above).alias(f"cn{i}"), F.count_if(above & yes).alias(f"cy{i}")]
    one = x.agg(*aggs)
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(f"{lo:.2f}-{hi:.2f}").alias("band"), F.col(f"n{i}").alias("n"), F.col(f"y{i}").alias("n_yes"), F.col(f"cn{i}").alias("cum_n"), F.col(f"cy{i}").alias("cum_yes")) for i, (lo, hi) in enumerate(bands)])).alias("r")).select("r.*")
    return rows.withColumn("precision", F.when(F.col("n") > 0, F.col("n_yes") / F.col("n"))).withColumn("cum_precision", F.when(F.col("cum_n") >= least, F.col("cum_yes") / F.col("cum_n")))


def label_report(df: DataFrame, gold: str, side: str, about: Column) -> DataFrame:
    """(measure, k, n, pct, lo, hi) with Wilson intervals: precision (yes among retained), false_negatives (yes among
    near misses), far_positives (yes among far ones) and about (labelled retained records of the subject class). Only
    valid labels count; a borderline label is no yes. An empty stratum gives null rates."""
    x = df.where(F.col(gold).isin("Y", "N", "B"))
    yes, at = F.col(gold) == "Y", lambda s: F.col(side) == s
    parts = {"precision": ("retained", yes), "false_negatives": ("excluded_near", yes), "far_positives": ("excluded_far", yes), "about": ("retained", F.coalesce(about, F.lit(False)))}
    one = x.agg(*[F.count_if(at(s)).alias(f"n{i}") for i, (s, _) in enumerate(parts.values())], *[F.count_if(at(s) & c).alias(f"k{i}") for i, (s, c) in enumerate(parts.values())])
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(f"k{i}").alias("k"), F.col(f"n{i}").alias("n")) for i, m in enumerate(parts)])).alias("r")).select("r.*")
    lo, hi = wilson(F.col("k"), F.col("n"))
    return rows.withColumns({"pct": percent(F.col("k"), F.col("n")), "lo": lo, "hi": hi})
