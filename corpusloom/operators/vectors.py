"""Vector columns: norms, similarity to seeds, fused views."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.blocks import block_tables, matrix, pieces
from corpusloom.session import cut_lineage, exact_quantiles, over_cores

#: Bytes of a seed block that every task holds.
BLOCK_BYTES = 64 << 20


def norm2(v: Column) -> Column:
    """Euclidean norm in double precision."""
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def l2_normalise(v: Column, eps: float = 1e-9) -> Column:
    """Vector over its norm plus ``eps``; a zero vector stays zero."""
    n = norm2(v) + eps
    return F.transform(v, lambda x: x.cast("double") / n)


def dot(a: Column, b: Column) -> Column:
    """Scalar product of two arrays of equal length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def seed_scores(df: DataFrame, id_col: str, vec: str, is_seed: Column, k: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, is_seed, score): mean of the ``k`` greatest scalar products with seeds other than the row itself.

    All rows are scored against all seeds, in blocks: seeds travel as arrays of at most ``block_bytes``, each task
    multiplies its batches with one block and keeps the k best per row and block, and the blocks' bests are merged
    per row. With fewer than k other seeds the mean is over those; without any the score is null. Rows with a null
    vector score null.
    """
    x = df.select(F.col(id_col).alias("id"), F.col(vec).alias("v"), F.coalesce(is_seed, F.lit(False)).alias("s"))
    x = cut_lineage(x.withColumn("_row", F.monotonically_increasing_id()))  # rows of the same id stay apart
    seeds = cut_lineage(x.where("s and v is not null").select("id", "v"))
    rows = over_cores(x.where("v is not null").select("_row", "id", "v"), "_row")
    dim = seeds.select(F.max(F.size("v"))).first()[0] or 1
    parts = []
    for block in block_tables(seeds, dim, block_bytes):
        pdf = block.toPandas()  # one block of bounded bytes at a time
        held = df.sparkSession.sparkContext.broadcast((pdf["id"].to_numpy(), matrix(pdf["v"]) if len(pdf) else np.zeros((0, dim))))
        part = rows.mapInPandas(_best_of_block(held, k), "_row long, top array<double>")
        parts.append(part)
        if len(pdf) < seeds.count():  # several blocks: each leaves its best and is let go
            parts[-1] = cut_lineage(part)
            held.destroy()
    top = reduce(DataFrame.unionByName, parts)
    if len(parts) > 1:
        top = top.groupBy("_row").agg(F.slice(F.sort_array(F.flatten(F.collect_list("top")), asc=False), 1, k).alias("top"))
    mean = F.when(F.size("top") > 0, F.aggregate("top", F.lit(0.0), lambda a, t: a + t) / F.size("top"))
    return x.join(top.select("_row", mean.alias("score")), "_row", "left").select(F.col("id").alias(id_col), F.col("s").alias("is_seed"), "score")


def _best_of_block(held, k: int):
    """The k greatest scalar products of each row with the seeds of a block other than itself."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, mat = held.value
        order = np.argsort(ids, kind="stable")
        in_order = ids[order]
        for p in batches:
            if not len(p):
                continue
            q, own, tops = matrix(p["v"]), p["id"].to_numpy(), []
            lo, hi = np.searchsorted(in_order, own), np.searchsorted(in_order, own, side="right")
            for s in pieces(len(q), len(mat)):
                sim = q[s] @ mat.T if len(mat) else np.zeros((len(q[s]), 0))
                for i in np.flatnonzero(hi[s] > lo[s]):  # a row that is a seed
                    sim[i, order[lo[s][i] : hi[s][i]]] = -np.inf
                best = -np.sort(-(np.partition(sim, sim.shape[1] - k, axis=1)[:, -k:] if sim.shape[1] > k else sim), axis=1)
                tops += [[float(t) for t in r if t > -np.inf] for r in best]
            yield pd.DataFrame({"_row": p["_row"], "top": tops})

    return run


def quantiles(df: DataFrame, value: str, at: tuple[float, ...] = (0.1, 0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """Exact interpolated quantiles in one row, as p10, p25, ...; null without values."""
    q = exact_quantiles(df.withColumn("_all", F.lit(1)), ["_all"], value, at).agg(F.max("q").alias("q"))
    return q.select(*[F.get("q", i).alias(f"p{round(a * 100)}") for i, a in enumerate(at)])


def align(records: DataFrame, id_col: str, vectors: DataFrame, vec_id: str) -> tuple[DataFrame, DataFrame]:
    """(records with their vectors, report). Records and vectors meet by id, never by position. The report has one row:
    n_records, n_vectors, n_aligned, n_without_vector, n_without_record, and ``complete``. Null ids meet nothing; a
    repeated vector id gives its record once per vector."""
    both = records.join(vectors.withColumnRenamed(vec_id, "_vec_id"), F.col(id_col) == F.col("_vec_id")).drop("_vec_id")
    sides = records.select(F.col(id_col).alias("k"), F.lit(1).alias("r"), F.lit(0).alias("v")).unionByName(vectors.select(F.col(vec_id).alias("k"), F.lit(0).alias("r"), F.lit(1).alias("v")))
    per = sides.groupBy("k").agg(F.sum("r").alias("r"), F.sum("v").alias("v"))  # counted before the shuffle
    known = F.col("k").isNotNull()
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    report = per.agg(
        total("r").alias("n_records"), total("v").alias("n_vectors"), total(F.when(known, F.col("r") * F.col("v"))).alias("n_aligned"),
        total(F.when((F.col("v") == 0) | ~known, F.col("r"))).alias("n_without_vector"), total(F.when((F.col("r") == 0) | ~known, F.col("v"))).alias("n_without_record"),
    )
    return both, report.withColumn("complete", (F.col("n_without_vector") == 0) & (F.col("n_without_record") == 0))


def fuse(df: DataFrame, views: dict[str, tuple[Column, float]]) -> DataFrame:
    """``df`` with ``fused``: the views' vectors scaled by their weights and joined; views of weight 0 or less are
    left out."""
    used = [_scaled(v, w) for v, w in views.values() if w > 0]
    return df.withColumn("fused", F.concat(*used) if used else F.array().cast("array<double>"))


def _scaled(v: Column, w: float) -> Column:
    return F.transform(v, lambda x: x.cast("double") * w)


def accept(scores: DataFrame, threshold: float) -> DataFrame:
    """Candidates (not seeds) that score at least the threshold."""
    return scores.where(~F.col("is_seed") & (F.col("score") >= threshold))
