"""TF-IDF of words and pairs of words, and each group's top terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import over_cores, top_per_group

#: Common English words that are no terms.
STOP_WORDS = "a an and are as at be been before but by can each every first for from has have if in into is it its more no nor not of on or one other out over second so some such than that the their them then there these this those to under was were when where which while with without".split()


def with_terms(df: DataFrame, text: str, out: str, stop: list[str] = STOP_WORDS) -> DataFrame:
    """``df`` with an array of the lower-case words of two or more word characters without stop words, and of the
    pairs of neighbours. The words are a column of their own, so that each text is cut once."""
    words = F.filter(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"(?U)\b\w\w+\b"), F.lit(0)), lambda w: ~w.isin(*stop))
    x = df.withColumn("_words", words)
    n = F.greatest(F.size("_words") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("_words", F.lit(1), n), F.slice("_words", F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b))
    return x.withColumn(out, F.concat("_words", pairs)).drop("_words")


def top_terms(df: DataFrame, group: str, id_col: str, text: str, k: int = 4, min_df: int = 3, max_terms: int = 4000) -> DataFrame:
    """(group, rank, term, weight): the k terms of greatest mean TF-IDF weight in each group.

    Per group: terms in at least ``min_df`` texts, of these the ``max_terms`` most frequent; idf = ln((1 + n) /
    (1 + df)) + 1; each text's weights have length 1. A group without such terms gives no row. Ties by term. Terms
    are counted per text before any shuffle by group. Texts without a group are a group of their own."""
    df = df.select(F.struct(F.col(group).alias("is")).alias(group), id_col, text)  # a struct equals another with null inside
    n = df.groupBy(group).agg(F.count("*").alias("_n"))
    tf = with_terms(over_cores(df, id_col).select(group, id_col, F.col(text).alias("_t")), "_t", "_terms").select(group, id_col, F.explode("_terms").alias("term")).groupBy(group, id_col, "term").agg(F.count("*").alias("tf"))
    stat = tf.groupBy(group, "term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).where(F.col("df") >= min_df)
    vocab = top_per_group(stat, group, [F.desc("total"), "term"], max_terms, "term").join(n, group).select(group, "term", "_n", (F.log((1 + F.col("_n")) / (1 + F.col("df"))) + 1).alias("idf"))
    x = tf.join(vocab, [group, "term"]).withColumn("w", F.col("tf") * F.col("idf"))
    norm = x.groupBy(group, id_col).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_len"))
    mean = x.join(norm, [group, id_col]).groupBy(group, "term", "_n").agg((F.sum(F.col("w") / F.col("_len")) / F.col("_n")).alias("weight"))
    best = top_per_group(mean, group, [F.desc(F.round("weight", 9)), "term"], k, "term")
    return best.select(F.col(group)["is"].alias(group), "rank", "term", "weight")


def cluster_names(df: DataFrame, group: str, id_col: str, text: str, manual: dict[int, str] | None = None, k: int = 2) -> DataFrame:
    """(group, name): the manual name, else the top terms, else C and the group's number."""
    top = top_terms(df, group, id_col, text, k).groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), ", ").alias("terms"))
    given = F.lit(None).cast("string")
    for c, name in (manual or {}).items():
        given = F.when(F.col(group) == c, name).otherwise(given)
    return df.select(group).distinct().join(top.withColumnRenamed(group, "_of"), F.col(group).eqNullSafe(F.col("_of")), "left").select(group, F.coalesce(given, F.col("terms"), F.concat(F.lit("C"), F.col(group).cast("string"))).alias("name"))
