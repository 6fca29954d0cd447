"""Work of all rows against all rows in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import cut_lineage

#: Bytes of a block of rows that every task holds, and of a piece of a distance matrix.
BLOCK_BYTES = 8 << 20


def pieces(n: int, columns: int) -> Iterator[slice]:
    """Slices of ``n`` rows so that a matrix with ``columns`` columns stays within BLOCK_BYTES."""
    step = max(1, BLOCK_BYTES // (8 * max(1, columns)))
    return (slice(i, i + step) for i in range(0, n, step))


def matrix(v: pd.Series) -> np.ndarray:
    return np.array(v.tolist(), dtype=float).reshape(len(v), -1)


def block_tables(x: DataFrame, dim: int, block_bytes: int = BLOCK_BYTES) -> Iterator[DataFrame]:
    """The rows of ``x`` (id, ...) in blocks of about ``block_bytes`` of vectors, one after the other."""
    blocks = max(1, -(-x.count() * 8 * max(1, dim) // block_bytes))
    x = x.withColumn("_b", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    for b in range(blocks):
        yield x.where(F.col("_b") == b).drop("_b")


def spread(x: DataFrame) -> DataFrame:
    """``x`` by id over at least as many tasks as the cluster has cores, for work that grows with rows times rows."""
    return x.repartition(max(x.sparkSession.sparkContext.defaultParallelism, int(x.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "id")


def distance_sums(x: DataFrame, codes: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, i, s): per row of ``x`` (id, v, c) the sums of its distances to the rows of each cluster, as an array in the
    order of ``codes`` (c, i), of all rows against all rows in blocks."""
    x = x.join(F.broadcast(codes), "c").select("id", "v", "i")
    k, dim = codes.count(), x.select(F.max(F.size("v"))).first()[0] or 1
    parts = []
    for block in block_tables(x, dim, block_bytes):
        b = block.toPandas()
        held = x.sparkSession.sparkContext.broadcast((b["id"].to_numpy(), matrix(b["v"]), b["i"].to_numpy(dtype=int)))

        def run(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            ids, m, c = held.value
            order = np.argsort(ids)
            hot, sq = np.zeros((len(c), k)), (m**2).sum(1)
            hot[np.arange(len(c)), c] = 1.0
            for p in batches:
                if not len(p):
                    continue
                q, own, sums = matrix(p["v"]), p["id"].to_numpy(), np.zeros((len(p), k))
                if len(m):
                    for s in pieces(len(q), len(m)):
                        d = np.sqrt(np.maximum(0.0, (q[s] ** 2).sum(1)[:, None] + sq[None, :] - 2 * q[s] @ m.T))
                        at = np.minimum(np.searchsorted(ids, own[s], sorter=order), len(ids) - 1)
                        mine = ids[order[at]] == own[s]
                        d[np.flatnonzero(mine), order[at][mine]] = 0.0
                        sums[s] = d @ hot
                yield pd.DataFrame({"id": p["id"], "i": p["i"], "s": list(sums)})

        parts.append(cut_lineage(x.mapInPandas(run, f"id {x.schema['id'].dataType.simpleString()}, i int, s array<double>")))
        held.destroy()
    sums = parts[0]
    for p in parts[1:]:
        sums = sums.unionByName(p)
    if len(parts) == 1:
        return sums
    zero = F.array_repeat(F.lit(0.0), F.lit(k))
    return sums.groupBy("id", "i").agg(F.aggregate(F.collect_list("s"), zero, lambda t, s: F.zip_with(t, s, lambda u, v: u + v)).alias("s"))
