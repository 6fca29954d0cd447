"""Writing results: type-safe parquet, sheets, bad lines, manifests, resumable appends and cached stages."""

from __future__ import annotations

import json
import platform
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.stats import progress
from corpusloom.sources import storage

#: Row counters of exports that are not data.
COUNTERS = ("#", "", "Unnamed: 0")


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """Without row counters; columns of types that other readers do not share (void, intervals, variants) become
    strings. Returns what was written."""
    odd = lambda t: t == "void" or t.startswith(("interval", "variant", "map"))
    as_text = lambda c, t: (F.to_json(c) if t.startswith(("map", "variant")) else F.col(c).cast("string")).alias(c.strip("`"))
    x = df.select(*[as_text(f"`{c}`", t) if odd(t) else F.col(f"`{c}`") for c, t in df.dtypes if c not in COUNTERS])
    w = x.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    return df.sparkSession.read.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """With header and doubled quotes; nested columns as JSON."""
    x = df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes])
    x.write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def write_lines(bad: DataFrame, path: str) -> None:
    """Bad lines as text, one a line, in a folder per file."""
    bad.select("_source_file", F.col("line").alias("value")).write.mode("overwrite").partitionBy("_source_file").text(path)


def write_manifest(path: str, **what) -> None:
    """JSON of a stage's settings and counts, with the versions and the machine it ran on."""
    import pyspark

    where = {"python": platform.python_version(), "spark": pyspark.__version__, "platform": platform.platform()}
    storage.write_text(path, json.dumps({"environment": where} | what, indent=2, default=str, sort_keys=True))


def write_report(path: str, lines: list[str]) -> None:
    """A text report."""
    storage.write_text(path, "\n".join(lines))


def read_manifest(path: str) -> dict:
    """The manifest, or {} if there is none."""
    return json.loads(storage.read_bytes(path, storage.size(path))) if storage.exists(path) else {}


def append_missing(df: DataFrame, path: str, id_col: str) -> int:
    """Appends the rows whose id the table at ``path`` does not hold; returns how many. Safe to repeat after a loss. The
    rows are counted as they are written, so they are worked out once."""
    if storage.exists(path):
        df = df.join(df.sparkSession.read.parquet(path).select(id_col), id_col, "left_anti")
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
    return seen.get["n"]


def append_chunks(df: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, id_col: str, chunks: int = 8, limit: int | None = None, tell: Callable[[dict], None] = lambda _: None) -> int:
    """Appends ``work`` of the rows whose id the table at ``path`` does not hold, chunk by chunk, so that a run that ends
    early loses one chunk at most and the next goes on behind it. ``limit``: at most so many rows in this run, the first
    by id. ``tell`` gets the progress after each chunk. Returns how many rows were appended."""
    if storage.exists(path):
        df = df.join(df.sparkSession.read.parquet(path).select(id_col), id_col, "left_anti")
    df = df if limit is None else df.orderBy(id_col).limit(limit)
    total, done, start = df.count(), 0, time.monotonic()
    for k in range(chunks if total else 0):
        done += append_missing(work(df.where(F.pmod(F.xxhash64(id_col), F.lit(chunks)) == k)), path, id_col) if limit is None else 0
        if limit is not None:  # the rows that are left differ after each chunk
            done = append_missing(work(df), path, id_col)
        tell(progress(done, total, time.monotonic() - start))
        if done >= total:
            break
    return done


def write_sheet(df: DataFrame, path: str, label_columns: list[str]) -> None:
    """A sheet to be labelled. A sheet that is there and has any label filled in is work and is not overwritten."""
    if storage.exists(path):
        old = df.sparkSession.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
        filled = [F.col(f"`{c}`") for c in label_columns if c in old.columns]
        for c in filled:
            if old.where(F.trim(F.coalesce(c, F.lit(""))) != "").limit(1).count():
                raise FileExistsError(f"{path} holds labels")
    write_csv(df, path)


def cached_stage(spark: SparkSession, path: str, build: Callable[[], DataFrame], refresh: bool = False) -> DataFrame:
    """The table at ``path`` if it is there, else built, written and read back."""
    return spark.read.parquet(path) if not refresh and storage.exists(path) else write_parquet(build(), path)
