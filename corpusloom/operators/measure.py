"""Annual shares, comparisons of a filtered with a full population, trends and cluster summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions.stats import percent, wilson


def year_spine(df: DataFrame, first: int, last: int) -> DataFrame:
    """One row per year, also for years without data."""
    return df.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("year"))


def annual_shares(df: DataFrame, year: str, labels: str, classes: list[str], first: int, last: int, complete_to: int) -> DataFrame:
    """Long table (year, category, n_records, n, pct, lo, hi, provisional) over a dense spine. Years without records
    stay, with null shares. One aggregation over the data; the unpivot runs on the annual totals."""
    per = df.where(F.col(year).between(first, last)).groupBy(F.col(year).cast("int").alias("year")).agg(F.count("*").alias("n_records"), *[F.count_if(F.array_contains(labels, c)).alias(f"k{i}") for i, c in enumerate(classes)])
    full = year_spine(df, first, last).join(F.broadcast(per), "year", "left").na.fill(0)  # at most one row a year
    one = full.select("year", "n_records", F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.col(f"k{i}").alias("n")) for i, c in enumerate(classes)])).alias("x")).select("year", "n_records", "x.*")
    lo, hi = wilson(F.col("n"), F.col("n_records"))
    return one.select("year", "category", "n_records", "n", percent(F.col("n"), F.col("n_records")).alias("pct"), lo.alias("lo"), hi.alias("hi"), (F.col("year") > complete_to).alias("provisional"))


def filtered_vs_full(df: DataFrame, year: str, labels: str, classes: list[str], inside: Column, first: int, last: int) -> DataFrame:
    """(year, category, n_full, n_inside, full_n, inside_n, full_pct, inside_pct, delta): the same classes over two
    denominators. Years without records are left out; shares inside are null where nothing is inside."""
    aggs = [F.count("*").alias("n_full"), F.count_if(inside).alias("n_inside")]
    for i, c in enumerate(classes):
        has = F.array_contains(labels, c)
        aggs += [F.count_if(has).alias(f"f{i}"), F.count_if(has & inside).alias(f"i{i}")]
    per = df.where(F.col(year).between(first, last)).groupBy(F.col(year).cast("int").alias("year")).agg(*aggs)
    one = per.select("year", "n_full", "n_inside", F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.col(f"f{i}").alias("full_n"), F.col(f"i{i}").alias("inside_n")) for i, c in enumerate(classes)])).alias("x")).select("year", "n_full", "n_inside", "x.*")
    return one.withColumn("full_pct", percent(F.col("full_n"), F.col("n_full"))).withColumn("inside_pct", percent(F.col("inside_n"), F.col("n_inside"))).withColumn("delta", F.col("inside_pct") - F.col("full_pct"))


def pooled(annual: DataFrame) -> DataFrame:
    """Sums over sums of ``filtered_vs_full``: pooled shares and their ratio per category (null where undefined)."""
    t = annual.groupBy("category").agg(F.sum("full_n").alias("full_n"), F.sum("inside_n").alias("inside_n"), F.sum("n_full").alias("a"), F.sum("n_inside").alias("b"))
    t = t.withColumn("full_pct", percent(F.col("full_n"), F.col("a"))).withColumn("inside_pct", percent(F.col("inside_n"), F.col("b")))
    return t.select("category", "full_n", "inside_n", "full_pct", "inside_pct", F.when(F.col("full_pct") > 0, F.col("inside_pct") / F.col("full_pct")).alias("ratio"))


def trend_delta(annual: DataFrame, min_inside: int) -> DataFrame:
    """Mean of the last third minus the mean of the first third of the years with enough records inside, for both
    populations, the counts inside of both thirds, and whether the directions differ. At most one row per year and
    category goes through the windows."""
    ok = annual.where(F.col("n_inside") >= min_inside)
    w = Window.partitionBy("category")
    x = ok.withColumn("i", F.row_number().over(w.orderBy("year"))).withColumn("n", F.count("*").over(w)).withColumn("k", F.greatest(F.floor(F.col("n") / 3), F.lit(1)))
    head, tail = F.col("i") <= F.col("k"), F.col("i") > F.col("n") - F.col("k")
    diff = lambda c: F.avg(F.when(tail, F.col(c))) - F.avg(F.when(head, F.col(c)))
    t = x.groupBy("category").agg(diff("full_pct").alias("full_delta"), diff("inside_pct").alias("inside_delta"), F.sum(F.when(head, F.col("inside_n"))).alias("n_first"), F.sum(F.when(tail, F.col("inside_n"))).alias("n_last"))
    return t.withColumn("opposite", F.signum("full_delta") != F.signum("inside_delta"))


def milestones(shares: DataFrame, years: list[int]) -> DataFrame:
    """Wide table: share and count of each category in given years."""
    aggs = []
    for y in years:
        at = F.col("year") == y
        aggs += [F.max(F.when(at, F.col("pct"))).alias(f"pct_{y}"), F.max(F.when(at, F.col("n"))).alias(f"n_{y}")]
    return shares.groupBy("category").agg(*aggs)


def growth(shares: DataFrame, first: int, last: int) -> DataFrame:
    """Counts of two years and their ratio per category; null where the first is 0."""
    a, b = F.max(F.when(F.col("year") == first, F.col("n"))), F.max(F.when(F.col("year") == last, F.col("n")))
    return shares.groupBy("category").agg(a.alias("n_first"), b.alias("n_last")).withColumn("growth", F.when(F.col("n_first") > 0, F.col("n_last") / F.col("n_first")))


def trajectory(shares: DataFrame, share_start: int) -> DataFrame:
    """Rows of the share panel: from ``share_start`` on, as complete or provisional segment with its band."""
    return shares.where(F.col("year") >= share_start).withColumn("segment", F.when(F.col("provisional"), "provisional").otherwise("complete")).select("category", "year", "segment", "n", "pct", "lo", "hi")


def year_histogram(df: DataFrame, year: str, first: int) -> DataFrame:
    """(year, n) from the first year on; null years are left out."""
    return df.where(F.col(year) >= first).groupBy(F.col(year).cast("int").alias("year")).agg(F.count("*").alias("n"))


def lag_stats(df: DataFrame, early: str, late: str, least: int = 0, most: int = 20) -> DataFrame:
    """Median, mean and 90th percentile (interpolated) of the lag in years between two dates, inside a range."""
    lag = F.year(late) - F.year(early)
    return df.select(lag.alias("lag")).where(F.col("lag").between(least, most)).agg(F.count("*").alias("n"), F.median("lag").cast("double").alias("median_lag"), F.avg("lag").alias("mean_lag"), F.percentile("lag", F.lit(0.9)).cast("double").alias("p90_lag"))


def date_coverage(df: DataFrame, group: str, date: str) -> DataFrame:
    """First, last and median year and the share of missing dates per group."""
    y = F.year(date)
    return df.groupBy(group).agg(F.min(y).alias("first_year"), F.max(y).alias("last_year"), F.median(y).cast("double").alias("median_year"), (F.avg(F.col(date).isNull().cast("int")) * 100).alias("pct_missing"), F.count("*").alias("n"))


def truncation_flags(df: DataFrame, file: str, caps: tuple[int, ...] = (1000, 5000, 10000, 20000, 25000, 50000, 100000, 250000)) -> DataFrame:
    """Rows per file and whether the count looks like an export limit (a cap or a multiple of 10,000)."""
    t = df.groupBy(file).agg(F.count("*").alias("n_rows"))
    return t.withColumn("suspect", F.col("n_rows").isin(*caps) | ((F.col("n_rows") % 10000 == 0) & (F.col("n_rows") > 0)))


def cluster_sizes(df: DataFrame, cluster: str, noise: int = -1) -> DataFrame:
    """Clusters, noise percentage, and the largest cluster's percentage of all rows."""
    per = df.groupBy(cluster).agg(F.count("*").alias("n"))
    real = F.when(F.col(cluster) != noise, F.col("n"))
    t = per.agg(F.count(real).alias("n_clusters"), F.sum("n").alias("total"), F.coalesce(F.sum(F.when(F.col(cluster) == noise, F.col("n"))), F.lit(0)).alias("noise"), F.max(real).alias("largest"))
    return t.select("n_clusters", percent(F.col("noise"), F.col("total")).alias("noise_pct"), percent(F.col("largest"), F.col("total")).alias("largest_pct"))


def cluster_years(df: DataFrame, cluster: str, year: str, noise: int = -1) -> DataFrame:
    """(cluster, year, n) without noise and without missing years."""
    return df.where((F.col(cluster) != noise) & F.col(year).isNotNull()).groupBy(F.col(cluster).alias("cluster"), F.col(year).cast("int").alias("year")).agg(F.count("*").alias("n"))


def eta_squared(df: DataFrame, value: str, cluster: str, noise: int = -1, least: int = 10) -> DataFrame:
    """Share of a value's variance that the clusters explain. Null below ``least`` non-noise rows, or without
    variance. From the mean and variance of each cluster, taken about the means, so that values far from 0 lose no
    digits."""
    x = df.where(F.col(cluster) != noise)
    v = F.col(value).cast("double")
    per = x.groupBy(cluster).agg(F.count("*").alias("m"), F.count(v).alias("n"), F.avg(v).alias("a"), F.var_pop(v).alias("s")).withColumn("_1", F.lit(1))
    grand = per.agg((F.sum(F.col("n") * F.col("a")) / F.nullif(F.sum("n"), F.lit(0))).alias("g")).withColumn("_1", F.lit(1))
    off = F.col("a") - F.col("g")
    t = per.join(grand, "_1").agg(F.sum("m").alias("m"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("s")).alias("inside"), F.sum(F.col("n") * off * off).alias("between"))
    all_ = F.col("inside") + F.col("between")
    return t.select(F.when((F.col("m") >= least) & (F.col("n") > 0) & (all_ > 1e-9), F.col("between") / all_).alias("eta2"))


def impute_scale(df: DataFrame, value: str) -> DataFrame:
    """``df`` with ``scaled``: missing values take the exact median, then (x - min) / max(range, 1)."""
    s = df.agg(F.median(value).cast("double").alias("mid"), F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi")).first()
    if s["lo"] is None:
        return df.withColumn("scaled", F.lit(None).cast("double"))
    return df.withColumn("scaled", (F.coalesce(F.col(value).cast("double"), F.lit(s["mid"])) - s["lo"]) / max(s["hi"] - s["lo"], 1.0))


def size_note(n: int, least: int = 30_000, most: int = 400_000) -> str:
    """A note if a corpus is smaller or larger than a plausible range, else ''."""
    return f"{n:,} records: fewer than {least:,}, the rule may be too narrow" if n < least else f"{n:,} records: more than {most:,}, the rule may be too wide" if n > most else ""
