"""Reproducible samples: the draw depends on the ids and the seed only, not on partitions or order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions.stats import band
from corpusloom.functions.text import strip


def draw_key(id_col: str, seed: int = 42) -> Column:
    """Pseudo-random order of ids: md5 of id and seed."""
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"|{seed}")))


def stratified(df: DataFrame, stratum: str, id_col: str, sizes: dict[str, int], seed: int = 42) -> DataFrame:
    """min(size, rows) rows of every stratum named in ``sizes``; others and null are left out.

    The rank is first held to the greatest size, a constant, so that every task cuts its own rows to that many per
    stratum before anything is shuffled; the stratum's own size follows."""
    want = F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv])
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy("_draw", id_col))
    x = df.withColumn("_draw", draw_key(id_col, seed)).withColumn("_r", rank).where(F.col("_r") <= max(sizes.values()))
    return x.where(F.col("_r") <= F.element_at(want, F.col(stratum))).drop("_r", "_draw")


def strata(topic: Column, device: Column, inside: Column) -> Column:
    """retained; excluded_near (exactly one condition); excluded_far (none); excluded_both (both, yet excluded)."""
    return F.when(inside, "retained").when(topic != device, "excluded_near").when(~topic & ~device, "excluded_far").otherwise("excluded_both")


def numbered(df: DataFrame, id_col: str, seed: int = 42) -> DataFrame:
    """A drawn sample in shuffled order with ``row`` 1..n. For samples: it numbers in one task."""
    return df.withColumn("row", F.row_number().over(Window.orderBy(draw_key(id_col, seed), id_col)))


def blind_sheet(sample: DataFrame, id_col: str, hide: list[str], label_columns: list[str], seed: int = 42) -> DataFrame:
    """The sheet an annotator gets: shuffled and numbered, without the columns that tell the rule's outcome, with
    empty label columns. Every annotator gets the same sheet."""
    x = numbered(sample, id_col, seed).drop(*hide)
    return x.withColumns({c: F.lit("") for c in label_columns})


def band_sample(df: DataFrame, score: str, id_col: str, bands: list[tuple[float, float]], per_band: int, seed: int = 42) -> DataFrame:
    """``per_band`` rows of every score band, with the band's label."""
    x = df.withColumn("band", band(F.col(score), bands))
    return stratified(x, "band", id_col, {f"{lo:.2f}-{hi:.2f}": per_band for lo, hi in bands}, seed)


def merge_labels(sample: DataFrame, labels: DataFrame, id_col: str, label_columns: list[str]) -> DataFrame:
    """A sample with the labels of a sheet, stale label columns replaced, blanks where there is none."""
    x = sample.drop(*label_columns).join(labels.select(id_col, *label_columns), id_col, "left")
    return x.withColumns({c: strip(F.coalesce(c, F.lit(""))) for c in label_columns})
