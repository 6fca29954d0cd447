"""Folders of delimited exports as DataFrames, with malformed lines kept apart and schema drift reported."""

from __future__ import annotations

import csv
import io
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.operators.dedup import union_shared
from corpusloom.sources import storage

#: Trial order of encodings; the last one takes any byte.
ENCODINGS = ("utf-8", "utf-8-sig", "cp1252", "latin-1")
CORRUPT, BAD = "_corrupt", "_bad"


#: Bytes in which a header line must end.
HEADER_BYTES = 1 << 20


def files_of(folder: str, limit: int | None = None) -> list[str]:
    """Delimited files of a folder in name order, whatever the case of their ending; the first ``limit``, if given."""
    found = [p for p in storage.files(folder) if p.lower().endswith(".csv")]
    if not found:
        raise FileNotFoundError(f"no .csv files in {folder}")
    return found[:limit]


def header_of(path: str, encoding: str = "utf-8-sig", delim: str = ",") -> list[str]:
    """Field names of a file; a name that occurs again gets its number."""
    text = storage.read_bytes(path, HEADER_BYTES).decode(encoding, errors="replace")
    names = next(csv.reader(io.StringIO(text, newline=""), delimiter=delim), [])
    seen: dict[str, int] = {}
    out = []
    for n in names:
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n}.{seen[n] - 1}")
    return out


def encoding_of(data: bytes) -> str:
    """First encoding of ENCODINGS that decodes all of the bytes."""
    for e in ENCODINGS[:-1]:
        try:
            data.decode(e)
            return "utf-8-sig" if e == "utf-8" and data.startswith(b"\xef\xbb\xbf") else e
        except UnicodeDecodeError:
            continue
    return ENCODINGS[-1]


def read_file(spark: SparkSession, path: str, delim: str = ",", encoding: str = "utf-8") -> DataFrame:
    """All lines of one file as strings. Short lines are padded with null; a line with more fields than the header
    has ``_bad`` set, also where the fields too many are empty. Quoted fields may hold line breaks and doubled quotes."""
    names = header_of(path, "utf-8-sig" if encoding == "utf-8" else encoding, delim)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, CORRUPT]])
    # all fields of a line are counted, whichever columns are asked for
    raw = spark.read.option("columnPruning", "false").csv(path, schema=schema, header=True, multiLine=True, quote='"', escape='"', sep=delim, encoding=encoding, enforceSchema=True, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT)
    # a line of another number of fields is kept as text; its separators outside of quotes tell more from fewer
    d = delim if delim.isalnum() else "\\" + delim
    seps = F.regexp_count(F.regexp_replace(CORRUPT, '"[^"]*"', ""), F.lit(d))
    return raw.select(*[F.col(f"`{n}`") for n in names], (F.coalesce(seps >= len(names), F.lit(False)) & (F.length(F.coalesce(*[F.col(f"`{n}`") for n in names], F.lit(""))) >= 0)).alias(BAD))


def read_small(spark: SparkSession, path: str, max_bytes: int = 64 << 20) -> DataFrame:
    """A small sheet in whatever encoding it was saved, read on the driver; refuses more than ``max_bytes``."""
    if storage.size(path) > max_bytes:
        raise ValueError(f"{path} is larger than {max_bytes} bytes; use read_file")
    data = storage.read_bytes(path, max_bytes)
    e = encoding_of(data)
    names = header_of(path, "utf-8-sig" if e == "utf-8" else e)
    rows = [r[: len(names)] + [None] * (len(names) - len(r)) for r in csv.reader(io.StringIO(data.decode(e), newline=""))][1:]
    return spark.createDataFrame(rows, T.StructType([T.StructField(n, T.StringType()) for n in names]))


def scan(spark: SparkSession, folder: str, source: str, limit: int | None = None) -> tuple[DataFrame, DataFrame, list[tuple[str, str]]]:
    """(rows, bad lines, files that could not be read). Rows have the columns shared by all files in the first
    file's order, with ``_source_folder`` and ``_source_file``; bad lines go apart with their file."""
    good, bad, failed = [], [], []
    for path in files_of(folder, limit):
        try:
            x = read_file(spark, path)
        except Exception as e:  # noqa: BLE001 one unreadable file must not stop the others
            failed.append((path, str(e)[:200]))
            continue
        cols = [c for c in x.columns if c != BAD]
        tag = {"_source_folder": F.lit(source), "_source_file": F.lit(storage.name(path))}
        good.append(x.where(~F.col(BAD)).drop(BAD).withColumns(tag))
        bad.append(x.where(BAD).select(F.lit(storage.name(path)).alias("_source_file"), F.to_json(F.struct(*cols)).alias("line")))
    if not good:
        raise ValueError(f"no readable file in {folder}")
    return union_shared(good), reduce(DataFrame.unionByName, bad), failed


def head(spark: SparkSession, path: str, n: int = 2000) -> tuple[DataFrame, int, str | None]:
    """First n good rows, the number of bad lines among the first n lines, and the first of those (null: none)."""
    x = read_file(spark, path).limit(n)
    bad = x.where(BAD)
    first = bad.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in x.columns if c != BAD])).alias("line")).first()
    return x.where(~F.col(BAD)).drop(BAD), bad.count(), first["line"] if first else None


def scan_log(rows: DataFrame, bad: DataFrame, failed: list[tuple[str, str]]) -> DataFrame:
    """(_source_file, n_rows, n_bad, error) of every file of a scan; files that could not be read have their error."""
    spark = rows.sparkSession
    n = rows.groupBy("_source_file").agg(F.count("*").alias("n_rows")).join(bad.groupBy("_source_file").agg(F.count("*").alias("n_bad")), "_source_file", "full")
    read = n.select("_source_file", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("n_bad", F.lit(0)).alias("n_bad"), F.lit(None).cast("string").alias("error"))
    return read.unionByName(spark.createDataFrame([(storage.name(p), 0, 0, e) for p, e in failed], "_source_file string, n_rows long, n_bad long, error string"))


def row_counts(rows: DataFrame) -> DataFrame:
    """Rows per file."""
    return rows.groupBy("_source_file").agg(F.count("*").alias("n_rows"))


def schema_groups(folder: str) -> list[tuple[tuple[str, ...], list[str]]]:
    """Files grouped by their columns. Metadata only."""
    groups: dict[tuple[str, ...], list[str]] = {}
    for p in files_of(folder):
        groups.setdefault(tuple(header_of(p)), []).append(storage.name(p))
    return list(groups.items())


def drift(folder: str) -> tuple[list[str], dict[str, list[str]]]:
    """(columns of every file, partial column -> files that have it)."""
    groups = schema_groups(folder)
    files = [f for _, names in groups for f in names]
    have: dict[str, list[str]] = {}
    for cols, names in groups:
        for c in cols:
            have.setdefault(c, []).extend(names)
    return [c for c in have if len(set(have[c])) == len(files)], {c: sorted(f) for c, f in have.items() if len(set(f)) < len(files)}


def prune(df: DataFrame, wanted: Callable[[str], bool]) -> DataFrame:
    """Columns whose name satisfies a predicate; the scan reads no others."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if wanted(c)])


def column_with(df: DataFrame, part: str) -> str:
    """First column whose name contains a text."""
    for c in df.columns:
        if part in c:
            return c
    raise KeyError(f"no column with {part!r} among {df.columns}")
