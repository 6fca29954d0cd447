"""Free-entered values led back to the entries of a reference list.

Distinct values are cut to tokens; each distinct token is joined to the reference vocabulary by edit distance
(``repair_tokens``, an exchange of neighbouring letters counting as one edit), and the corrected tokens of a value are combined with soft TF-IDF to rank complete entries
(``match_values``). Values that fit no entry are reported with entry 0.

The vocabulary holds the words of every name of an entry and the runs of neighbouring words written together, so
that lost, moved or exchanged blanks and hyphens stay one token's edit. A value gives its words, its runs of two
words and, where it abbreviates with a full stop, its word heads. The edit-distance join is an equi-join: a token
within distance d of a vocabulary word keeps one of the word's d + 1 segments unchanged, at a place shifted by at
most d. Both sides are joined on (word length, segment number, segment) and then verified, so no pair is lost and
no cross join is needed.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import narrow, strip
from corpusloom.session import cut_lineage, small_side

#: Words and signs that say that there is nothing to enter.
SAYS_NOTHING = ("none", "no", "n/a", "na", "n.a", "nil", "null", "nan", "keine", "keines", "kein", "ninguno", "ninguna", "aucun", "aucune", "nothing", "no architecture", "without", "without architecture", "not applicable", "no arch", "keine architektur")
#: Least soft TF-IDF coverage of an entry's name by a value's tokens.
MIN_COVER = 0.62
#: Longest run of neighbouring words of an entry taken as one token.
MAX_RUN = 3


def states_something(c: Column) -> Column:
    """False for null, blank, and words or signs that say that there is no entry."""
    bare = F.lower(F.regexp_replace(strip(narrow(c)), r"(?U)^[\[(<{\s]+|[\])>}\s.!]+$", ""))
    return F.coalesce(bare.rlike(r"[\p{L}\p{N}]") & ~bare.isin(*SAYS_NOTHING), F.lit(False))


def _plain(v: str) -> str:
    flat = "".join(c for c in unicodedata.normalize("NFKD", v) if not unicodedata.combining(c)).lower()
    return " ".join("".join("-" if unicodedata.category(c) == "Pd" else c for c in flat if unicodedata.category(c) != "Cf").replace("_", " ").split())


def _plain_all(s: pd.Series) -> pd.Series:
    return s.map(_plain, na_action="ignore")


def plain(c: Column) -> Column:
    """Compatibility form without accents, lower case, single blanks. For distinct values only: it runs in Python."""
    return F.pandas_udf(_plain_all, "string")(c)


def most_edits(length: Column) -> Column:
    """Edits allowed for a vocabulary word of this length."""
    return F.when(length <= 3, 0).when(length <= 5, 1).when(length <= 9, 2).otherwise(3)


def vocabulary(reference: DataFrame) -> DataFrame:
    """(arch_id, name_no, n_words, first, last, token): each run of up to MAX_RUN neighbouring words of each name,
    with the places of the words it covers; the short code is a name of one word. Grows with the list only."""
    names = reference.select("arch_id", F.posexplode(F.concat(F.array(F.col("arch_name")), F.split(F.coalesce("other_names", F.lit("")), r"\|"), F.array(F.coalesce("short_code", F.lit(""))))).alias("name_no", "name"))
    w = names.select("arch_id", "name_no", F.filter(F.split(plain(F.col("name")), r"[^\p{L}\p{N}]+"), lambda x: x != "").alias("words")).where("size(words) > 0")
    runs = F.flatten(F.transform(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.transform(F.sequence(i, F.least(i + MAX_RUN, F.size("words")) - 1), lambda j: F.struct(i.alias("first"), j.alias("last"), F.array_join(F.slice("words", i + 1, j - i + 1), "").alias("token")))))
    return w.select("arch_id", "name_no", F.size("words").alias("n_words"), F.explode(runs).alias("r")).select("arch_id", "name_no", "n_words", "r.*")


def _segments(word: Column, edits: Column) -> Column:
    """(number, start, text) of the edits + 1 nearly equal segments of a word."""
    k = edits + 1
    base = F.floor(F.length(word) / k).cast("int")
    extra = F.length(word) - base * k

    def seg(i: Column) -> Column:
        start = i * base + F.greatest(F.lit(0), i - (k - extra))
        size = base + F.when(i >= k - extra, 1).otherwise(0)
        return F.struct(i.alias("no"), start.alias("start"), F.substring(word, start + 1, size).alias("text"))

    return F.transform(F.sequence(F.lit(0), k - 1), seg)


def repair_tokens(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """(token, word, sim) of every distinct token and vocabulary word within ``most_edits``; sim = 1 - d / length."""
    words = vocab.select(F.col("token").alias("word")).distinct()
    seg_w = words.withColumn("d", most_edits(F.length("word"))).select("word", F.length("word").alias("len"), F.explode(_segments(F.col("word"), F.col("d"))).alias("s")).select("word", "len", F.col("s.no").alias("no"), F.col("s.text").alias("seg"))
    shape = words.select(F.length("word").alias("len")).distinct().withColumn("d", most_edits(F.col("len"))).collect()  # the list's word lengths
    t = F.col("token")
    rows = []
    for n, d in sorted((r["len"], r["d"]) for r in shape):
        base, extra = divmod(n, d + 1)
        start = 0
        for i in range(d + 1):
            size = base + (1 if i >= d + 1 - extra else 0)
            for length in range(max(1, n - d), n + d + 1):
                rows += [(length, n, i, p + 1, size) for p in range(max(0, start - d), min(start + d, length - size) + 1)]
            start += size
    spark = tokens.sparkSession
    cuts = spark.createDataFrame(rows, "token_len int, len int, no int, at int, size int")
    # few bytes become many probes: keep the tasks that adaptive execution would merge
    spread = tokens.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "token").withColumn("token_len", F.length("token"))
    probe = spread.join(F.broadcast(cuts), "token_len").select("token", "len", "no", F.substring(t, F.col("at"), F.col("size")).alias("seg"))
    pairs = probe.join(seg_w, ["len", "no", "seg"]).select("token", "word").distinct()
    dist = F.levenshtein("token", "word")
    near = pairs.withColumn("dist", dist).where(F.col("dist") <= most_edits(F.length("word"))).select("token", "word", (1 - F.col("dist") / F.length("word")).alias("sim"))
    # two exchanges of neighbouring letters are four plain edits but leave the letters the same
    letters = lambda c: F.array_join(F.array_sort(F.split(c, "")), "")
    swapped = tokens.where("length(token) >= 6").select("token", letters(t).alias("l")).join(words.select("word", letters(F.col("word")).alias("l")), "l").withColumn("dist", dist).where("dist between 1 and 4")
    return near.unionByName(swapped.select("token", "word", (1 - F.col("dist") / (2 * F.length("word"))).alias("sim"))).groupBy("token", "word").agg(F.max("sim").alias("sim"))


def match_values(values: DataFrame, reference: DataFrame, min_cover: float = MIN_COVER) -> DataFrame:
    """(value, arch_id, score) of each distinct non-null value of column ``value``; arch_id 0 if nothing fits.

    Score: soft TF-IDF cosine part that the value's tokens cover of an entry's name, in 0..1; the name's words are
    weighted by their rarity among the list's names. Ties go to the name that leaves fewer of the value's words
    over, then to the smaller arch_id. A list without entries gives 0 for all.
    """
    vocab = cut_lineage(vocabulary(reference))
    words = F.filter(F.split(F.col("p"), " "), lambda x: x != "")
    v = values.select("value").distinct().withColumn("p", plain(F.col("value"))).repartition("value")
    v = v.withColumn("chunks", words).withColumn("atoms", F.filter(F.split("p", r"[^\p{L}\p{N}]+"), lambda x: x != ""))
    pairs = F.when(F.size("atoms") > 1, F.transform(F.sequence(F.lit(0), F.size("atoms") - 2), lambda i: F.concat(F.get("atoms", i), F.get("atoms", i + 1)))).otherwise(F.array().cast("array<string>"))
    whole = F.regexp_replace("p", r"[^\p{L}\p{N}]+", "")
    glued = F.transform("chunks", lambda c: F.regexp_replace(c, r"[^\p{L}\p{N}]+", ""))
    singular = F.transform(F.concat("atoms", F.array(whole)), lambda a: F.regexp_replace(a, "s$", ""))
    tokens = F.filter(F.array_distinct(F.concat("atoms", pairs, glued, singular)), lambda x: F.length(x) > 1)
    heads = F.filter(F.transform(F.filter("chunks", lambda c: c.rlike(r"\.\W*$")), lambda c: F.regexp_replace(c, r"[^\p{L}\p{N}]+", "")), lambda x: F.length(x) >= 3)
    tv = v.select("value", "p", F.size("atoms").alias("n_atoms"), F.explode(F.concat(F.transform(tokens, lambda x: F.struct(x.alias("token"), F.lit(False).alias("head"))), F.transform(heads, lambda x: F.struct(x.alias("token"), F.lit(True).alias("head"))))).alias("t")).select("value", "n_atoms", "t.*")
    tv = cut_lineage(tv)
    repaired = repair_tokens(tv.where("not head").select("token").distinct(), vocab).withColumn("head", F.lit(False))
    by_head = vocab.where("length(token) >= 3").select(F.col("token").alias("word")).distinct().withColumn("token", F.explode(F.transform(F.sequence(F.lit(3), F.length("word")), lambda n: F.substring(F.col("word"), F.lit(1), n))))
    fits = repaired.select("token", "head", "word", "sim").unionByName(by_head.select("token", F.lit(True).alias("head"), "word", F.lit(0.95).alias("sim")))
    hits = tv.join(fits, ["token", "head"]).select("value", "n_atoms", "word", "sim").groupBy("value", "n_atoms", "word").agg(F.max("sim").alias("sim"))

    # rarity of a word among the names, and each name's weight
    one = vocab.where("first = last").select("arch_id", "name_no", F.col("first").alias("place"), "token")
    n_names = one.select("arch_id", "name_no").distinct().count()
    idf = one.select("token", "arch_id", "name_no").distinct().groupBy("token").agg(F.log((F.lit(n_names) + 1) / (F.count("*") + 0.5)).alias("idf"))
    place = one.join(idf, "token").select("arch_id", "name_no", "place", (F.col("idf") * F.col("idf")).alias("w2"))
    norm = place.groupBy("arch_id", "name_no").agg(F.sum("w2").alias("norm"))

    covers = vocab.select("arch_id", "name_no", F.col("token").alias("word"), F.explode(F.sequence("first", "last")).alias("place"))
    part = hits.join(covers, "word").groupBy("value", "n_atoms", "arch_id", "name_no", "place").agg(F.max("sim").alias("sim"))
    cover = part.join(place, ["arch_id", "name_no", "place"]).groupBy("value", "n_atoms", "arch_id", "name_no").agg(F.sum(F.col("w2") * F.col("sim")).alias("got"), F.count("*").alias("n_hit")).join(norm, ["arch_id", "name_no"])
    ranked = cover.select("value", "arch_id", (F.col("got") / F.col("norm")).alias("score"), (F.col("n_hit") / F.greatest("n_atoms", F.lit(1))).alias("used"))
    best = ranked.groupBy("value").agg(F.max(F.struct("score", "used", (-F.col("arch_id")).alias("neg"))).alias("b")).select("value", (-F.col("b.neg")).alias("arch_id"), F.col("b.score").alias("score")).where(F.col("score") >= min_cover)
    return values.select("value").distinct().join(best, "value", "left").select("value", F.coalesce("arch_id", F.lit(0).cast("bigint")).alias("arch_id"), F.coalesce("score", F.lit(0.0)).alias("score"))


def canonical_rows(labels: DataFrame, reference: DataFrame, id_col: str = "label_id", value_col: str = "architecture") -> DataFrame:
    """(id, arch_id) of every row whose value states something; 0 if it fits no entry."""
    said = labels.select(F.col(id_col), F.col(value_col).alias("value")).where(states_something(F.col("value")))
    found = cut_lineage(match_values(said, reference))
    return said.join(small_side(found), "value").select(id_col, "arch_id")


def unmatched_values(labels: DataFrame, reference: DataFrame, value_col: str = "architecture") -> DataFrame:
    """Values that fit no entry, with the number of rows that have them."""
    said = labels.select(F.col(value_col).alias("value")).where(states_something(F.col("value")))
    none = match_values(said, reference).where("arch_id = 0").select("value")
    return said.groupBy("value").agg(F.count("*").alias("n_rows")).join(none, "value")


__all__ = ["canonical_rows", "match_values", "repair_tokens", "states_something", "unmatched_values", "vocabulary"]
