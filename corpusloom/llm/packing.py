"""Items of varying length put into containers of fixed capacity, by patterns fitted to the length histogram.

Everything that decides sees only the histogram (at most ``capacity`` bins), never the items:

1. ``patterns``: all combinations of the few long items (an eighth of the capacity or more) that go into a container,
   by classes of length, each with the room that it leaves for short ones;
2. ``repeat_counts``: how often to use each, by non-negative least squares against the histogram of the classes and
   the least number of containers by volume. The active-set solution uses no more patterns than there are classes,
   so rounding its counts loses little;
3. ``fill``: short items, and long ones that rounding left over, go into the room of the patterns' containers best fit,
   longest first, still as counts of equal containers; new containers are opened only when nothing has room.

The plan is a table of rank ranges per length. Items get their rank among equals of their length (counted per salted
bucket, so that a length which many items share is no single task) and look up their container there. An item longer
than the capacity is cut into full containers and a rest; others stay whole. Items of length 0 take no room: they are
listed with container null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.session import cut_lineage

CAPACITY = 2048
#: Long items take at least this part of a container; classes of length are this fine.
LONG, CLASSES = 8, 64
#: Classes get finer, where there are too few short items, as long as there are no more patterns than this.
PATTERNS = 20_000
#: Weight of the number of containers in the fit, against 1 for the items that fill one.
BOX_WEIGHT = 0.3
#: Items per salted bucket of a length, at most; a rank inside a bucket is one task's work.
BUCKET_ROWS = 100_000

Container = tuple[tuple[int, ...], int]


def patterns(there: np.ndarray, top: int, most: int = 1 << 62) -> list[tuple[int, ...]] | None:
    """Combinations of the classes in ``there`` (ascending), longest first, of which the sum is at most ``top``; None if
    there are more than ``most``."""
    out: list[tuple[int, ...]] = []
    todo: list[tuple[tuple[int, ...], int]] = [((), 0)]
    sizes = [int(c) for c in there]
    while todo:
        if len(out) > most:
            return None
        have, used = todo.pop()
        for c in sizes:
            if used + c > top or have and c > have[-1]:
                break
            out.append((*have, c))
            todo.append((out[-1], used + c))
    return out


def repeat_counts(a: np.ndarray, b: np.ndarray, iterations: int = 2000) -> np.ndarray:
    """x >= 0 of least squares of a x - b, by active sets (Lawson and Hanson): at most as many positive entries as
    ``a`` has rows."""
    n = a.shape[1]
    x, on = np.zeros(n), np.zeros(n, dtype=bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0.0)))
    for _ in range(iterations):
        w = a.T @ (b - a @ x)
        w[on] = -np.inf
        k = int(np.argmax(w)) if n else -1
        if k < 0 or w[k] <= tolerance:
            break
        on[k] = True
        while True:
            at = np.flatnonzero(on)
            z = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (z > 0).all() or not len(at):
                break
            bad = z <= 0
            step = float((x[at][bad] / np.maximum(x[at][bad] - z[bad], 1e-300)).min())
            x[at] += step * (z - x[at])
            on[at[bad & (x[at] <= 1e-9)]] = False
            x[~on] = 0.0
        x[:] = 0.0
        x[at] = z
    return x


def fitted(hist: np.ndarray) -> tuple[list[Container], np.ndarray]:
    """Containers opened by the fitted patterns, as (lengths, number), and the histogram of what is left."""
    capacity = len(hist) - 1
    g, left = max(1, capacity // CLASSES), hist.astype(np.int64).copy()
    left[0] = 0
    out: list[Container] = [((capacity,), int(left[capacity]))] if left[capacity] else []
    left[capacity] = 0
    size = np.arange(capacity + 1)
    long = (size >= max(1, capacity // LONG)) & (left > 0)
    short_volume = int((left * size)[~long].sum())
    rows, there, of, counts = [], size[:0], size, left
    while True:  # class c holds the lengths above (c - 1) * g, up to c * g
        finer_of = -(-size // g)
        finer_counts = np.bincount(finer_of[long], weights=left[long], minlength=capacity // g + 2).astype(np.int64)
        finer = patterns(np.flatnonzero(finer_counts), capacity // g, PATTERNS if rows else 1 << 62)
        if finer is None:
            g *= 2
            break
        rows, of, counts, there = finer, finer_of, finer_counts, np.flatnonzero(finer_counts)
        if g == 1 or not rows or short_volume >= int(left[long].sum()) * g // 2:
            break  # the short items make up for what the classes round up
        g //= 2
    if not rows:
        return out, left
    boxes = -(-int((left * size).sum()) // capacity)
    # an item weighs its length, as a share of a container
    a = np.zeros((len(there) + 1, len(rows)))
    place = {int(c): i for i, c in enumerate(there)}
    for j, row in enumerate(rows):
        for c in row:
            a[place[c], j] += c / (capacity / g)
        a[-1, j] = BOX_WEIGHT
    b = np.append(counts[there] * there / (capacity / g), BOX_WEIGHT * boxes)
    x = repeat_counts(a, b)
    # lengths of a class in runs, longest first
    runs = {int(c): [[int(s), int(left[s])] for s in np.flatnonzero(long & (of == c))[::-1]] for c in there}
    stock = {int(c): int(counts[c]) for c in there}
    for j in np.argsort(-x, kind="stable"):
        want = int(x[j] + 0.5)
        if want == 0:
            break
        row = rows[j]
        want = min(want, *(stock[c] // row.count(c) for c in set(row)))
        for c in row:
            stock[c] -= want
        while want:
            lengths, n = _alike(runs, row, want)
            out.append((lengths, n))
            want -= n
            for length in lengths:
                left[length] -= n
    return out, left


def _alike(runs: dict[int, list[list[int]]], row: tuple[int, ...], most: int) -> tuple[tuple[int, ...], int]:
    """Takes up to ``most`` containers with the same lengths from the ends of the classes' runs."""
    need: dict[int, int] = {}
    lengths = []
    for c in row:  # one item of the class's last run, or of the run before where that is used up by this row
        k, skip = len(runs[c]) - 1, need.get(c, 0)
        while skip >= runs[c][k][1]:
            skip -= runs[c][k][1]
            k -= 1
        need[c] = need.get(c, 0) + 1
        lengths.append(runs[c][k][0])
    used = {s: lengths.count(s) for s in lengths}
    n = min(most, *(left // used[s] for c in set(row) for s, left in runs[c] if s in used))
    for c in set(row):
        for r in runs[c]:
            r[1] -= n * used.get(r[0], 0)
        while runs[c] and runs[c][-1][1] == 0:
            runs[c].pop()
        runs[c][:] = [r for r in runs[c] if r[1]]
    return tuple(lengths), n


def fill(open_: list[Container], left: np.ndarray) -> list[Container]:
    """``open_`` with the items of the histogram ``left`` put in best fit, longest first, and new containers for those
    that fit nowhere: (lengths in a container, number of such containers)."""
    capacity = len(left) - 1
    room_of: list[list[Container]] = [[] for _ in range(capacity + 1)]  # by free room
    for items, n in open_:
        if n:
            room_of[capacity - sum(items)].append((items, n))
    for size in range(capacity, 0, -1):
        count, room = int(left[size]), size
        while count:
            while room < capacity and not room_of[room]:
                room += 1
            if room < capacity or room_of[capacity]:
                items, n = room_of[room].pop()
                m = min(n, count)
                if n > m:
                    room_of[room].append((items, n - m))
                room_of[room - size].append(((*items, size), m))
                count -= m
            else:  # new containers, as full of this length as they go
                each = capacity // size
                whole, rest = divmod(count, each)
                if whole:
                    room_of[capacity - each * size].append(((size,) * each, whole))
                if rest:
                    room_of[capacity - rest * size].append(((size,) * rest, 1))
                count = 0
            room = size
    return [g for groups in room_of for g in groups]


def plan(hist: np.ndarray) -> tuple[list[Container], int]:
    """All containers as (lengths, number), and how many of them the patterns opened. ``hist[l]``: items of length l;
    hist[0] is ignored."""
    open_, left = fitted(hist)
    return fill(open_, left), sum(n for _, n in open_)


def rank_ranges(containers: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, container of the first, slot, start in the container)."""
    used: dict[int, int] = {}
    rows, base = [], 1
    for items, n in containers:
        start = 0
        for slot, size in enumerate(items, 1):
            lo = used.get(size, 0)
            rows.append((size, lo, lo + n, base, slot, start))
            used[size] = lo + n
            start += size
        base += n
    return rows


def pack(sizes: DataFrame, id_col: str = "doc_id", size_col: str = "n_tokens", capacity: int = CAPACITY) -> DataFrame:
    """(id, piece_no, piece_start, n_tokens, container_id, slot, start_pos) of each piece of each item of ``sizes``.

    Whole items have one piece 0. Container ids run from 1 without gaps. A null size counts as 0; repeated rows are items of their own. Equal lengths
    are interchangeable: they are ranked by id, then by row.
    """
    spark = sizes.sparkSession
    n = F.coalesce(F.col(size_col), F.lit(0)).cast("bigint")
    items = sizes.select(F.col(id_col), F.greatest(n, F.lit(0)).alias("_n"), F.monotonically_increasing_id().alias("_row"))
    cut = items.withColumn("piece_no", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.lit(0), F.floor((F.col("_n") - 1) / capacity)))))
    cut = cut.withColumn("piece_start", F.col("piece_no") * capacity).withColumn("len", F.least(F.lit(capacity), F.col("_n") - F.col("piece_start")).cast("int"))
    cut = cut_lineage(cut.drop("_n"))
    most = cut.where("len > 0").groupBy("len").agg(F.count("*").alias("c")).agg(F.coalesce(F.max("c"), F.lit(0))).first()[0]
    buckets = max(1, -(-most // BUCKET_ROWS))  # the longest run of equals is not one task
    cut = cut.withColumn("b", F.pmod(F.xxhash64(id_col, "_row", "piece_no"), F.lit(buckets)).cast("int"))
    counts = cut.where("len > 0").groupBy("len", "b").agg(F.count("*").alias("c"))
    hist, before = np.zeros(capacity + 1, dtype=np.int64), []
    for r in sorted(counts.collect(), key=lambda r: (r["len"], r["b"])):  # at most capacity * buckets rows
        before.append((r["len"], r["b"], int(hist[r["len"]])))
        hist[r["len"]] += r["c"]
    containers, _ = plan(hist)
    ranges = spark.sparkContext.broadcast(_lookup(rank_ranges(containers), capacity))
    offsets = spark.createDataFrame(before, "len int, b int, before long")
    rank = F.row_number().over(Window.partitionBy("len", "b").orderBy(id_col, "_row", "piece_no"))
    ranked = cut.where("len > 0").withColumn("rn", rank).join(F.broadcast(offsets), ["len", "b"]).select(F.col(id_col).alias("_id"), "piece_no", "piece_start", "len", (F.col("before") + F.col("rn") - 1).alias("rank"))
    kind = f"_id {ranked.schema['_id'].dataType.simpleString()}, piece_no long, piece_start long, n_tokens int, container_id long, slot int, start_pos int"
    out = ranked.mapInArrow(_place(ranges), kind).withColumnRenamed("_id", id_col)
    none = lambda t: F.lit(None).cast(t)
    zero = cut.where("len = 0").select(id_col, "piece_no", "piece_start", F.col("len").alias("n_tokens"), none("bigint").alias("container_id"), none("int").alias("slot"), none("int").alias("start_pos"))
    return out.unionByName(zero)


def _lookup(rows: list[tuple[int, int, int, int, int, int]], capacity: int) -> tuple[np.ndarray, ...]:
    """The rank ranges in order, for a binary search: key (length, first rank), container less rank, slot, start."""
    t = np.array(sorted(rows), dtype=np.int64).reshape(-1, 6)
    return t[:, 0], t[:, 1], t[:, 3] - t[:, 1], t[:, 4], t[:, 5], np.searchsorted(t[:, 0], np.arange(capacity + 2))


def _place(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, low, shift, slot, start, first = held.value
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(4).to_numpy()
            at = np.zeros(len(length), dtype=np.int64)
            for v in np.unique(length):  # the ranges of one length are ordered by rank
                mine = length == v
                at[mine] = first[v] + np.searchsorted(low[first[v] : first[v + 1]], rank[mine], side="right") - 1
            got = [pa.array(shift[at] + rank), pa.array(slot[at].astype(np.int32)), pa.array(start[at].astype(np.int32))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), *got], ["_id", "piece_no", "piece_start", "n_tokens", "container_id", "slot", "start_pos"])

    return run


def usage(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, how many of them a fitted pattern opened, tokens, the least number of containers possible by
    volume, and the filled share. The plan follows from the lengths alone, so it is worked out from them again."""
    x = packed.where("container_id is not null")
    hist = np.zeros(capacity + 1, dtype=np.int64)
    for r in x.groupBy("n_tokens").agg(F.count("*").alias("c")).collect():  # at most capacity rows
        hist[r["n_tokens"]] = r["c"]
    t = x.agg(F.countDistinct("container_id").alias("n_containers"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"))
    return t.select("n_containers", F.lit(plan(hist)[1]).cast("bigint").alias("n_by_pattern"), "n_tokens", F.ceil(F.col("n_tokens") / capacity).alias("least_containers"), F.when(F.col("n_containers") > 0, F.col("n_tokens") / (F.col("n_containers") * capacity)).alias("filled"))
