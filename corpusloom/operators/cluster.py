"""Clustering, its quality measures and parameter grids."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions.stats import percent
from corpusloom.operators import density
from corpusloom.operators.blocks import BLOCK_BYTES, distance_sums, spread
from corpusloom.operators.measure import eta_squared
from corpusloom.session import cut_lineage, exact_quantiles, running_total

def reduce_dimensions(df: DataFrame, vec: str, k: int) -> DataFrame:
    """``df`` with ``reduced``: principal components. Rows with a null vector are left out."""
    x = df.where(F.col(vec).isNotNull()).withColumn("_v", array_to_vector(F.transform(vec, lambda t: t.cast("double"))))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(x)
    return model.transform(x).withColumn("reduced", vector_to_array("_p")).drop("_v", "_p")


def density_clusters(points: np.ndarray, min_size: int = 50, min_samples: int = 5) -> np.ndarray:
    """Hierarchical density clusters of points in memory: labels from 0, noise -1.

    Mutual reachability distances, their minimum spanning tree, the tree condensed by ``min_size``, and the clusters
    of greatest excess of mass. Memory grows with the points, not with their square."""
    n = len(points)
    if n < max(2, min_size):
        return np.full(n, -1)
    points = np.asarray(points, dtype=float)
    core = density.nearest(points, points, min_samples + 1)[:, -1]
    return density.condensed(n, *density.forest(*density.tree(points, core)), min_size)


def cluster_table(df: DataFrame, id_col: str, vec: str, min_size: int, min_samples: int, block_rows: int = density.BLOCK_ROWS) -> DataFrame:
    """(id, cluster) by density clustering of all rows with a vector, as ``density_clusters`` of them in the order of
    their (distinct) ids. Distances are taken in blocks; only the n - 1 edges of the spanning tree meet in one task."""
    x = _points(df, id_col, vec)
    labels = density.tree_labels(x, density.spanning_tree(x, min_samples, block_rows), [min_size])
    return labels.select(F.col("id").alias(id_col), "cluster")


def _points(df: DataFrame, id_col: str, vec: str) -> DataFrame:
    return cut_lineage(spread(df.where(F.col(vec).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec).alias("v"))))


def kmeans(df: DataFrame, id_col: str, vec: str, k: int, seed: int = 42) -> DataFrame:
    """(id, cluster) by k-means, for inputs of any size."""
    from pyspark.ml.clustering import KMeans

    x = df.where(F.col(vec).isNotNull()).select(id_col, array_to_vector(F.transform(vec, lambda t: t.cast("double"))).alias("features"))
    return KMeans(k=k, seed=seed).fit(x).transform(x).select(id_col, F.col("prediction").alias("cluster"))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index and normalised mutual information (arithmetic mean) of two label columns, from their
    contingency table. Both are 1 where both partitions are trivial."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").cast("double").alias("n"))
    rows = cells.groupBy("a").agg(F.sum("n").alias("ra"))
    cols = cells.groupBy("b").agg(F.sum("n").alias("cb"))
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    r = rows.agg(pairs("ra").alias("pa"), F.sum("ra").alias("n"), F.sum(-F.col("ra") * F.log("ra")).alias("ha"))
    c = cols.agg(pairs("cb").alias("pb"), F.sum(-F.col("cb") * F.log("cb")).alias("hb"))
    x = cells.join(rows, "a").join(cols, "b").agg(pairs("n").alias("pc"), F.sum(F.col("n") * F.log(F.col("n") / (F.col("ra") * F.col("cb")))).alias("m"))
    one = F.lit(1).alias("_1")
    t = r.select("*", one).join(c.select("*", one), "_1").join(x.select("*", one), "_1")
    n = F.col("n")
    expected, most = F.col("pa") * F.col("pb") / (n * (n - 1) / 2), (F.col("pa") + F.col("pb")) / 2
    mi, ha, hb = F.col("m") / n + F.log(n), F.col("ha") / n + F.log(n), F.col("hb") / n + F.log(n)
    return t.select(F.when(most == expected, 1.0).otherwise((F.col("pc") - expected) / (most - expected)).alias("ari"), F.when(ha + hb <= 1e-12, 1.0).otherwise(F.greatest(F.lit(0.0), mi) / ((ha + hb) / 2)).alias("nmi"))


def silhouette(df: DataFrame, id_col: str, vec: str, cluster: str, noise: int = -1, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Mean Euclidean silhouette of all non-noise rows. Null with fewer than two clusters. Members of clusters of one
    count 0.

    Every row is compared with all rows, a block of at most ``block_bytes`` at a time; a block leaves one sum of
    distances per row and cluster, and the sums are merged per row. The driver holds the clusters' sizes."""
    spark = df.sparkSession
    x = df.where((F.col(cluster) != noise) & F.col(vec).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec).alias("v"), F.col(cluster).alias("c"))
    x = cut_lineage(spread(x))
    sizes = x.groupBy("c").agg(F.count("*").alias("n")).orderBy("c").collect()
    if len(sizes) < 2:
        return spark.createDataFrame([(None,)], "silhouette double")
    codes = spark.createDataFrame([(r["c"], i) for i, r in enumerate(sizes)], x.select("c", F.lit(0).alias("i")).schema)
    size = np.array([r["n"] for r in sizes])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            if not len(p):
                continue
            sums, own, at = np.array(p["s"].tolist()), p["i"].to_numpy(dtype=int), np.arange(len(p))
            a = sums[at, own] / np.maximum(size[own] - 1, 1)
            mean = sums / size
            mean[at, own] = np.inf
            b = mean.min(1)
            yield pd.DataFrame({"s": np.where(size[own] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0.0)})

    return distance_sums(x, codes, block_bytes).mapInPandas(run, "s double").agg(F.avg("s").alias("silhouette"))


def grid(df: DataFrame, id_col: str, vec: str, sizes: list[int], samples: list[int], block_rows: int = density.BLOCK_ROWS) -> DataFrame:
    """Density clustering for every (min_size, min_samples): clusters, noise share, largest share, silhouette.

    One spanning tree of all rows for each min_samples; the driver loops over configurations, not over data.
    Configurations with fewer than two clusters are left out."""
    x, out = _points(df, id_col, vec), []
    n = x.count()
    for mp in dict.fromkeys(samples):
        labels = cut_lineage(density.tree_labels(x, density.spanning_tree(x, mp, block_rows), list(dict.fromkeys(sizes))))
        of = labels.where("cluster >= 0").groupBy("min_size", "cluster").agg(F.count("*").alias("n"))
        for r in of.groupBy("min_size").agg(F.count("*").alias("k"), F.sum("n").alias("on"), F.max("n").alias("most")).where("k >= 2").orderBy("min_size").collect():
            s = silhouette(x.join(labels.where(F.col("min_size") == r["min_size"]), "id"), "id", "v", "cluster").first()["silhouette"]
            out.append((r["min_size"], mp, r["k"], 100 * (n - r["on"]) / n, 100 * r["most"] / n, s))
    return df.sparkSession.createDataFrame(out, "min_size int, min_samples int, k int, noise_pct double, largest_pct double, silhouette double")


def select_configurations(rows: DataFrame, by: list[str], least: int = 15, most: int = 40, too_large: float = 40.0) -> DataFrame:
    """Best configuration per group: fewer than three clusters or a cluster above ``too_large`` percent is refused;
    then a number of clusters inside [least, most] counts 100, plus the silhouette. Ties: smaller min_size, then
    min_samples."""
    ok = rows.where((F.col("k") >= 3) & (F.col("largest_pct") <= too_large)).withColumn("score", F.col("k").between(least, most).cast("int") * 100 + F.col("silhouette"))
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "min_size", "min_samples")
    return ok.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def ablation(df: DataFrame, id_col: str, views: dict[str, str], base: dict[str, float], vary: dict[str, list[float]], value: str, dims: int, min_size: int, min_samples: int) -> DataFrame:
    """Clusterings with one view's weight varied at a time, each compared with that view at weight 0: (view, weight,
    n_clusters, noise_frac, eta2, ari_vs_zero, nmi_vs_zero). The driver loops over configurations, not over data."""
    from corpusloom.operators.vectors import fuse

    spark, out = df.sparkSession, []
    for view, weights in vary.items():
        zero = None
        for w in sorted({0.0, *weights}):
            conf = base | {view: w}
            fused = fuse(df, {n: (F.col(c), conf.get(n, 0.0)) for n, c in views.items()})
            lab = cluster_table(reduce_dimensions(fused, "fused", dims), id_col, "reduced", min_size, min_samples).cache()
            zero = lab.withColumnRenamed("cluster", "zero") if zero is None else zero
            m = lab.agg(F.countDistinct(F.when(F.col("cluster") >= 0, F.col("cluster"))).alias("k"), F.avg((F.col("cluster") < 0).cast("int")).alias("noise")).first()
            e = eta_squared(lab.join(df.select(id_col, value), id_col), value, "cluster").first()["eta2"]
            a = agreement(lab.join(zero, id_col), "zero", "cluster").first()
            if w in weights:
                out.append((view, float(w), m["k"], m["noise"], e, a["ari"], a["nmi"]))
    return reduce(DataFrame.unionByName, [spark.createDataFrame(out, "view string, weight double, n_clusters long, noise_frac double, eta2 double, ari_vs_zero double, nmi_vs_zero double")])


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Spearman's rank correlation with average ranks for ties. Ranks come from the counts of the distinct values,
    summed up range by range."""

    def ranked(x: DataFrame, c: str, out: str) -> DataFrame:
        n = running_total(x.groupBy(c).agg(F.count("*").alias("_n")), c, "_n", "_upto")
        return x.join(n.select(c, (F.col("_upto") - (F.col("_n") - 1) / 2).alias(out)), c)

    x = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b)
    return ranked(ranked(x, a, "_ra"), b, "_rb").agg(F.corr("_ra", "_rb").alias("rho"))


def centroids(df: DataFrame, cluster: str, x: str, y: str, noise: int = -1) -> DataFrame:
    """Size and exact coordinate medians of each cluster, noise left out."""
    real = df.where(F.col(cluster) != noise).select(F.col(cluster).alias("cluster"), F.col(x).alias("_x"), F.col(y).alias("_y"))
    n = real.groupBy("cluster").agg(F.count("*").alias("n"))
    mid = lambda c, out: exact_quantiles(real, ["cluster"], c, (0.5,)).select("cluster", F.get("q", 0).alias(out))
    return n.join(mid("_x", "cx"), "cluster", "left").join(mid("_y", "cy"), "cluster", "left")


def cluster_map(df: DataFrame, cluster: str, x: str, y: str, year: str, names: DataFrame | None = None, manual: dict[int, str] | None = None, largest: int = 8, noise: int = -1) -> DataFrame:
    """(cluster, n, pct, median_year, cx, cy, name, annotated) of each cluster, largest first: its share of all rows, its
    median year and coordinates, the manual name, else that of ``names`` (cluster, name), else C and its number, and
    whether it is one of the ``largest`` to be annotated (ties by number). Noise counts in the share only."""
    total = df.agg(F.count("*").alias("_all")).withColumn("_1", F.lit(1))
    mid = exact_quantiles(df.where(F.col(cluster) != noise).select(F.col(cluster).alias("cluster"), F.col(year).alias("_y")), ["cluster"], "_y", (0.5,)).select("cluster", F.get("q", 0).alias("median_year"))
    t = centroids(df, cluster, x, y, noise).join(mid, "cluster", "left").withColumn("_1", F.lit(1)).join(total, "_1")
    name = F.concat(F.lit("C"), F.col("cluster").cast("string"))
    if names is not None:
        t = t.join(names.select(F.col("cluster").alias("_c"), F.col("name").alias("_name")), F.col("cluster") == F.col("_c"), "left")
        name = F.coalesce("_name", name)
    for c, given in (manual or {}).items():
        name = F.when(F.col("cluster") == c, given).otherwise(name)
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "cluster"))  # one row per cluster
    return t.select("cluster", "n", percent(F.col("n"), F.col("_all")).alias("pct"), "median_year", "cx", "cy", name.alias("name"), (rank <= largest).alias("annotated")).orderBy(F.desc("n"), "cluster")


def recommend(rows: DataFrame, least: int = 15, most: int = 40, too_large: float = 40.0) -> DataFrame:
    """``rows`` of a grid in the order in which to look at them: a number of clusters inside [least, most] first, then the
    greater silhouette, refused ones (fewer than three clusters, or one above ``too_large`` percent) last; and
    ``recommended`` for the first, if it is not refused. Other columns break ties."""
    refused, fits = (F.col("k") < 3) | (F.col("largest_pct") > too_large), F.col("k").between(least, most)
    order = [refused.asc(), fits.desc(), F.col("silhouette").desc_nulls_last(), *[F.col(c).asc() for c in rows.columns if c != "silhouette"]]
    return rows.withColumn("recommended", (F.row_number().over(Window.orderBy(*order)) == 1) & ~refused).orderBy(*order)


def representation_grid(df: DataFrame, id_col: str, views: dict[int, dict[str, str]], weights: list[float], varied: str, base: dict[str, float], dims: int, sizes: list[int], samples: list[int]) -> DataFrame:
    """``grid`` of every representation: (granularity, weight) and the columns of ``grid``. ``views``: granularity -> view
    -> column; the weight of the view ``varied`` runs over ``weights``. The driver loops over configurations, not data."""
    from corpusloom.operators.vectors import fuse

    out = []
    for g, columns in views.items():
        for w in weights:
            conf = base | {varied: w}
            fused = fuse(df, {n: (F.col(c), conf.get(n, 0.0)) for n, c in columns.items()})
            rows = grid(reduce_dimensions(fused, "fused", dims), id_col, "reduced", sizes, samples)
            out.append(rows.select(F.lit(g).alias("granularity"), F.lit(float(w)).alias("weight"), "*"))
    return reduce(DataFrame.unionByName, out)
