"""Hierarchical density clustering of any number of rows: core distances, spanning tree and condensed tree.

Equal distances are ordered by the ids of the two ends, so the spanning tree is unique and does not depend on blocks or
partitions. Distances are summed place by place and have the same bits wherever they are computed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.blocks import BLOCK_BYTES, block_tables, matrix, pieces
from corpusloom.session import cut_lineage

#: Rows of a block; a task of the spanning tree sees two blocks.
BLOCK_ROWS = 4096
#: Edges that a task gathers before it drops those that close a cycle.
EDGE_ROWS = 1 << 20


def distances(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of ``q`` to the rows of ``m``."""
    s = np.zeros((len(q), len(m)))
    for k in range(m.shape[1] if m.ndim > 1 else 0):
        t = q[:, k, None] - m[None, :, k]
        s += t * t
    return np.sqrt(s)


def nearest(q: np.ndarray, m: np.ndarray, k: int) -> np.ndarray:
    """Per row of ``q`` its ``k`` smallest distances to rows of ``m``, in order (all, if there are fewer)."""
    out = [np.sort(np.partition(d, min(k, len(m)) - 1, axis=1)[:, :k], axis=1) for s in pieces(len(q), len(m)) for d in [distances(q[s], m)]]
    return np.concatenate(out) if out else np.zeros((0, min(k, len(m))))


def tree(points: np.ndarray, core: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, d): the minimum spanning tree of mutual reachability, a < b, found one vertex at a time."""
    n, cols = len(points), [np.ascontiguousarray(c) for c in points.T]
    idx, near, key, done = np.arange(n), np.full(n, np.inf), np.full(n, n * n), np.zeros(n, dtype=bool)
    ends, d, v = np.zeros(max(0, n - 1), dtype=np.int64), np.zeros(max(0, n - 1)), 0
    for i in range(n - 1):
        done[v] = True
        near[v] = np.inf
        s = np.zeros(n)
        for c in cols:
            t = c - c[v]
            s += t * t
        w = np.maximum(np.maximum(np.sqrt(s), core), core[v])
        w[done] = np.inf
        new = np.minimum(v, idx) * n + np.maximum(v, idx)
        closer = (w < near) | ((w == near) & (new < key) & ~done)
        near[closer], key[closer] = w[closer], new[closer]
        ties = np.flatnonzero((near == near.min()) & ~done)
        v = int(ties[np.argmin(key[ties])])
        ends[i], d[i] = key[v], near[v]
    return ends // n, ends % n, d


def forest(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The edges of the minimum spanning forest, in order of (d, a, b)."""
    ids, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    order = np.lexsort((b, a, d))
    parent, keep = list(range(len(ids))), []
    for e, x, y in zip(order.tolist(), flat[: len(a)][order].tolist(), flat[len(a) :][order].tolist()):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        while parent[y] != y:
            parent[y] = parent[parent[y]]
            y = parent[y]
        if x != y:
            parent[y] = x
            keep.append(e)
    return a[keep], b[keep], d[keep]


def condensed(n: int, a: np.ndarray, b: np.ndarray, d: np.ndarray, min_size: int) -> np.ndarray:
    """Labels from 0, noise -1, of ``n`` points from the edges of their spanning tree in ascending order: the tree
    condensed by ``min_size``, and the clusters of greatest excess of mass."""
    if n < max(2, min_size):
        return np.full(n, -1)
    # dendrogram: node n + i joins two nodes at a distance
    parent, size, left, right, height = list(range(2 * n - 1)), [1] * n, [], [], d.tolist()

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        ra, rb = root(x), root(y)
        left.append(ra)
        right.append(rb)
        size.append(size[ra] + size[rb])
        parent[ra] = parent[rb] = n + i

    def leaves(node: int) -> list[int]:
        out, todo = [], [node]
        while todo:
            t = todo.pop()
            if t < n:
                out.append(t)
            else:
                todo += [left[t - n], right[t - n]]
        return out

    # condensed tree: a cluster lives from the density of its birth; points fall off or it splits
    births, stable, children, members = [0.0], [0.0], {0: []}, {0: []}
    todo = [(2 * n - 2, 0)]
    while todo:
        node, c = todo.pop()
        if node < n:
            members[c].append(node)
            continue
        lam = 1.0 / max(height[node - n], 1e-12)
        x, y = left[node - n], right[node - n]
        big = [t for t in (x, y) if size[t] >= min_size]
        if len(big) == 2:
            stable[c] += (lam - births[c]) * (size[x] + size[y])
            for t in big:
                births.append(lam)
                stable.append(0.0)
                k = len(births) - 1
                children[c].append(k)
                children[k], members[k] = [], []
                todo.append((t, k))
        else:
            for t in (x, y):
                if t in big:
                    todo.append((t, c))
                else:
                    stable[c] += (lam - births[c]) * size[t]
                    members[c] += leaves(t)
    chosen, value = {}, list(stable)
    for c in range(len(births) - 1, -1, -1):
        below = sum(value[k] for k in children[c])
        chosen[c] = c != 0 and stable[c] >= below
        value[c] = stable[c] if chosen[c] else below
    labels, todo2, k = np.full(n, -1), [0], 0
    while todo2:
        c = todo2.pop()
        if chosen[c]:
            part, stack = [], [c]
            while stack:
                t = stack.pop()
                part += members[t]
                stack += children[t]
            labels[part] = k
            k += 1
        else:
            todo2 += reversed(children[c])
    return labels


def core_distances(x: DataFrame, min_samples: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``x`` (id, v) with ``core``: the distance to the ``min_samples``-th nearest other row, of all rows against all
    rows in blocks; each block leaves its smallest distances per row, which are merged."""
    dim = x.select(F.max(F.size("v"))).first()[0] or 1
    parts = []
    for block in block_tables(x, dim, block_bytes):
        held = x.sparkSession.sparkContext.broadcast(matrix(block.toPandas()["v"]))

        def run(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            for p in batches:
                if len(p):
                    near = nearest(matrix(p["v"]), held.value, min_samples + 1) if len(held.value) else np.zeros((len(p), 0))
                    yield pd.DataFrame({"id": p["id"], "near": list(near)})

        parts.append(cut_lineage(x.mapInPandas(run, "id long, near array<double>")))
        held.destroy()
    near = parts[0]
    for p in parts[1:]:
        near = near.unionByName(p)
    kept = F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, min_samples + 1)
    return x.join(near.groupBy("id").agg(F.element_at(kept, -1).alias("core")), "id")


def spanning_tree(x: DataFrame, min_samples: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b, d): the minimum spanning tree of the mutual reachability of all rows of ``x`` (id, v), a < b.

    An edge of the whole tree is also one of the tree of any part that holds both ends. So rows are put into blocks,
    every two blocks give the tree of their rows in a task of their own, and of all those edges the ones that close a
    cycle are dropped. Tasks hold two blocks, or edges in proportion to the rows."""
    n = x.count()
    blocks = max(1, -(-n // block_rows))
    c = core_distances(x, min_samples).withColumn("_b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    other = F.filter(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda o: (o != F.col("_b")) | F.lit(blocks == 1))
    pairs = c.withColumn("_o", F.explode(other)).select("id", "v", "core", F.least("_b", "_o").alias("_i"), F.greatest("_b", "_o").alias("_j"))

    def grow(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("id")
        ids = p["id"].to_numpy()
        a, b, d = tree(matrix(p["v"]), p["core"].to_numpy())
        return pd.DataFrame({"a": ids[a], "b": ids[b], "d": d})

    def prune(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, new, rows = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), [], 0

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            return forest(*[np.concatenate([kept[i], *[p[k].to_numpy() for p in new]]) for i, k in enumerate("abd")])

        for p in batches:
            new.append(p)
            rows += len(p)
            if rows > max(EDGE_ROWS, len(kept[0])):
                kept, new, rows = merged(), [], 0
        yield pd.DataFrame(dict(zip("abd", merged())))

    kind = "a long, b long, d double"
    tasks = max(1, min(1000, blocks * (blocks - 1) // 2))  # a number of its own, as the work is not in proportion to the bytes
    edges = pairs.repartition(tasks, "_i", "_j").groupBy("_i", "_j").applyInPandas(grow, kind)
    if blocks == 1:
        return cut_lineage(edges)
    first = cut_lineage(edges.mapInPandas(prune, kind))
    return cut_lineage(first.coalesce(1).mapInPandas(prune, kind))


def tree_labels(x: DataFrame, edges: DataFrame, sizes: list[int]) -> DataFrame:
    """(id, min_size, cluster): the labels of the rows of ``x`` for every least size, from their spanning tree. The
    edges of one tree meet in a task per size, in memory in proportion to the rows; distances don't."""
    n = x.count()
    if n < 2:
        return x.select("id", F.explode(F.array(*[F.lit(s) for s in sizes])).alias("min_size"), F.lit(-1).alias("cluster"))

    def run(p: pd.DataFrame) -> pd.DataFrame:
        a, b, d = forest(p["a"].to_numpy(), p["b"].to_numpy(), p["d"].to_numpy())
        ids, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
        ms = int(p["min_size"].iloc[0])
        return pd.DataFrame({"id": ids, "min_size": ms, "cluster": condensed(len(ids), flat[: len(a)], flat[len(a) :], d, ms)})

    each = edges.withColumn("min_size", F.explode(F.array(*[F.lit(s) for s in sizes])))
    return each.groupBy("min_size").applyInPandas(run, "id long, min_size int, cluster int")
