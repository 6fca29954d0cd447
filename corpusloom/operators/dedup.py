"""Unions, deduplication, collapse to families and set comparisons. All choices are deterministic."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.stats import percent
from corpusloom.functions.text import split_list, usable_key


def union_shared(frames: list[DataFrame]) -> DataFrame:
    """UNION ALL over the columns that all frames have, in the first frame's order, as strings where types differ."""
    shared = [c for c in frames[0].columns if all(c in f.columns for f in frames)]
    types = {c: {dict(f.dtypes)[c] for f in frames} for c in shared}
    pick = lambda f: f.select(*[F.col(c) if len(types[c]) == 1 else F.col(c).cast("string").alias(c) for c in shared])
    return reduce(DataFrame.unionByName, [pick(f) for f in frames])


def one_sided_columns(a: DataFrame, b: DataFrame) -> tuple[list[str], list[str]]:
    """Columns only in ``a``, only in ``b``."""
    return [c for c in a.columns if c not in b.columns], [c for c in b.columns if c not in a.columns]


def group_key(id_col: str, *candidates: Column) -> Column:
    """The first usable candidate, compared without case, width, blanks and punctuation, else a key of the record's
    own: no record is without a key, so none is lost in a collapse and no two meet for want of one."""
    return F.coalesce(*[usable_key(c) for c in candidates], F.concat(F.lit("NOAPP_"), F.col(id_col).cast("string")))


def _best(df: DataFrame, key: list[str], order: list[Column], alone: Column | None = None) -> DataFrame:
    """First row per key in this order. The rows are compared before the shuffle, so a key that many rows share
    sends one row per task. Null keys form one group; with ``alone`` they form one per value of it."""
    row = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], F.struct(*df.columns).alias("_row"))
    by = [F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]
    if alone is not None:
        by.append(F.when(reduce(Column.__or__, [F.col(k).isNull() for k in key]), alone).alias("_alone"))
    return df.groupBy(*by).agg(F.min(row).alias("_m")).select("_m._row.*")


def keep_first(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key: the first by ``order`` (ascending, nulls first). Order until ties are gone."""
    return _best(df, key, [F.col(c) for c in order])


def keep_preferred(df: DataFrame, key: list[str], rank: Column, tie: str) -> DataFrame:
    """One row per key: the smallest ``rank``, then the smallest ``tie``, which names the record. Records without a
    key (any part of it null) are each alone."""
    return _best(df, key, [rank, F.col(tie)], F.col(tie))


def granted_flag(df: DataFrame, key: str, is_grant: Column) -> DataFrame:
    """``df`` with ``granted``: does any row of the same key have ``is_grant``? Null keys: the row's own value."""
    keys = df.where(is_grant & F.col(key).isNotNull()).select(F.col(key).alias("_gk")).distinct()
    x = df.join(keys, F.col(key) == F.col("_gk"), "left")
    return x.withColumn("granted", F.col("_gk").isNotNull() | (F.col(key).isNull() & F.coalesce(is_grant, F.lit(False)))).drop("_gk")


def collapse(df: DataFrame, key: str, is_grant: Column, tie: str, mode: str = "invention") -> DataFrame:
    """One row per key with ``granted``: grants preferred (invention), or only grants, or only others kept before the
    choice. ``granted`` is computed before the mode filters. Records with a null key are each alone."""
    x = granted_flag(df, key, is_grant)
    if mode == "grants_only":
        x = x.where(is_grant)
    elif mode == "apps_only":
        x = x.where(~is_grant)
    return keep_preferred(x, [key], F.when(is_grant, 0).otherwise(1), tie)


def in_several(df: DataFrame, key: str, source: str) -> DataFrame:
    """Number of keys that occur under two or more sources; null keys are left out."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.countDistinct(source).alias("k")).agg(F.count_if(F.col("k") > 1).alias("n_keys"))


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys of either side, common keys, and their percentage of the first side."""
    tag = a.select(key, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select(key, F.lit(0).alias("a"), F.lit(1).alias("b"))).where(F.col(key).isNotNull())
    per = tag.groupBy(key).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    t = per.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("n_a"), F.coalesce(F.sum("b"), F.lit(0)).alias("n_b"), F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("n_both"))
    return t.withColumn("pct_of_a", 100.0 * F.col("n_both") / F.greatest("n_a", F.lit(1)))


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exact distinct non-null values of each column, in one row."""
    return df.agg(*[F.countDistinct(c).alias(f"n_{c.strip('_')}") for c in columns])


def frequency(df: DataFrame, column: str) -> DataFrame:
    """(value, n, pct) of each value, null included, most frequent first."""
    total = df.count()
    t = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return t.withColumn("pct", percent(F.col("n"), F.lit(total))).orderBy(F.desc("n"), F.asc_nulls_last("value"))


def crosstab(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts by ``row`` in one column per value, 0 where empty."""
    return df.groupBy(row).pivot(column, values).count().na.fill(0, values)


def anti(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among the other's keys."""
    return df.join(other.select(key).distinct(), key, "left_anti")


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, default: str = "") -> DataFrame:
    """``df`` with ``value`` looked up by ``key``; the default where nothing is found. Repeated keys of the table:
    the smallest value."""
    one = table.groupBy(key).agg(F.min(value).alias(value))
    return df.join(one, key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def union_distinct(frames: list[DataFrame], key: list[str]) -> DataFrame:
    """The frames' shared columns under each other, one row per key: that of the first frame that has it, and of its
    rows the least."""
    tagged = [f.withColumn("_frame", F.lit(i)) for i, f in enumerate(frames)]
    x = union_shared(tagged)
    return keep_first(x, key, ["_frame", *[c for c in x.columns if c not in ("_frame", *key)]]).drop("_frame")


def canonical_list(c: Column, table: dict[str, str], sep: str = ",") -> Column:
    """Distinct canonical names of the elements of a delimited cell; an element that the table does not know stays as
    it is written, trimmed. Null and blank cells give an empty array."""
    names = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.array_distinct(F.transform(split_list(c, sep), lambda x: F.coalesce(F.try_element_at(names, F.upper(x)), x)))
