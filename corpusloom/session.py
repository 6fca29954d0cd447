"""Session helpers: lineage cuts in shared storage and size-checked broadcasts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_root(spark: SparkSession) -> str:
    """The folder that all machines share, as the cluster names it in ``spark.checkpoint.dir``. Only a session on one
    machine, such as a test, may leave it unset and gets a temporary folder; a cluster without it is refused, as its
    executors would write to a path that exists on the driver alone."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise ValueError("spark.checkpoint.dir is not set: name a folder that all executors reach")
    if sc.master not in _LOCAL:
        _LOCAL[sc.master] = tempfile.mkdtemp(prefix="shared-")
    return _LOCAL[sc.master]


#: The one temporary folder of a session on one machine.
_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the shared one."""
    return f"{shared_root(spark)}/{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it from there."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """As ``cut_lineage``, but as a table of columns: smaller where values repeat, and read back by column."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def over_cores(df: DataFrame, by: str) -> DataFrame:
    """``df`` by hash of ``by`` over all cores if its scan has fewer tasks than there are (a few small files), for work
    that costs far more than the shuffle; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, by)


def running_total(df: DataFrame, order: str, value: str, out: str) -> DataFrame:
    """``df`` with the inclusive running sum of ``value`` in the order of the (distinct) values of ``order``.

    Ranges of the order go to tasks of their own; the driver holds one sum per range."""
    x = cut_lineage(df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()))
    offsets, total = [], 0
    for r in sorted(x.groupBy("_part").agg(F.sum(value).alias("s")).collect(), key=lambda r: r["_part"]):
        offsets.append((r["_part"], total))
        total += r["s"]
    table = F.broadcast(df.sparkSession.createDataFrame(offsets, "_part int, _before long"))
    w = Window.partitionBy("_part").orderBy(order)
    return x.join(table, "_part").withColumn(out, F.col("_before") + F.sum(value).over(w)).drop("_part", "_before")


def exact_quantiles(df: DataFrame, group: list[str], value: str, at: tuple[float, ...]) -> DataFrame:
    """(group columns, n, q): the exact quantiles of a value per group, interpolated between neighbours, as an array in
    the order of ``at``. Nulls do not count. Values are ranked range by range, so no task holds a group's values."""
    x = df.where(F.col(value).isNotNull()).select(*group, F.col(value).cast("double").alias("_x"))
    x = cut_lineage(x.repartitionByRange(*group, "_x").withColumn("_part", F.spark_partition_id()))
    per = x.groupBy(*group, "_part").agg(F.count("*").alias("_m"))  # groups x ranges at most
    all_parts, upto = Window.partitionBy(*group), Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_before", F.coalesce(F.sum("_m").over(upto), F.lit(0))).withColumn("n", F.sum("_m").over(all_parts)).drop("_m")
    per = per.withColumnsRenamed({g: f"_g{i}" for i, g in enumerate(group)}).withColumnRenamed("_part", "_p")
    same = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)]
    rank = F.row_number().over(Window.partitionBy("_part", *group).orderBy("_x")) - 1
    ranked = x.withColumn("_rank", rank).join(small_side(per), [*same, F.col("_part") == F.col("_p")]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    pos = [F.lit(float(q)) * (F.col("n") - 1) for q in at]
    ends = ranked.where(F.greatest(*[(F.col("_rank") >= F.floor(p)) & (F.col("_rank") <= F.ceil(p)) for p in pos], F.lit(False), F.lit(False)))
    pick = lambda p, end: F.max(F.when(F.col("_rank") == end(p), F.col("_x")))
    t = ends.groupBy(*group, "n").agg(*[pick(p, F.floor).alias(f"_lo{i}") for i, p in enumerate(pos)], *[pick(p, F.ceil).alias(f"_hi{i}") for i, p in enumerate(pos)])
    q = [F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (p - F.floor(p)) for i, p in enumerate(pos)]
    return t.select(*group, "n", F.array(*q).alias("q"))


def top_per_group(df: DataFrame, group: str, order: list, k: int, spread: str, salts: int = 64) -> DataFrame:
    """``df`` cut to the first ``k`` rows of each group with ``rank`` from 1. Each (group, salt of ``spread``) is cut
    first, so that no task sees more of a group than its salt's share and salts * k rows."""
    salt = F.pmod(F.xxhash64(spread), F.lit(salts))
    first = df.withColumn("_salt", salt).withColumn("_r", F.row_number().over(Window.partitionBy(group, "_salt").orderBy(*order))).where(F.col("_r") <= k)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k).drop("_r", "_salt")


def small_side(df: DataFrame, max_rows: int = 50_000) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows, else as it is.

    Looks at no more than ``max_rows + 1`` rows. Beyond the bound the join is left
    to adaptive execution (shuffle join with skew splitting).
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
