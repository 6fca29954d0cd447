"""Alignment, exact quantiles, unions, recommendations and reports against brute force and by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import cluster, dedup, embed, measure, sampling, validate, vectors
from corpusloom.session import exact_quantiles, over_cores


@pytest.mark.parametrize("n", [1, 2, 7, 500])
def test_exact_quantiles(spark, n):
    rng = np.random.default_rng(n)
    v = rng.normal(size=n).round(2)  # ties
    g = np.where(rng.random(n) < 0.7, "hot", "cold")
    rows = [(str(a), float(b)) for a, b in zip(g, v)] + [(None, 1.0), (None, 3.0), ("hot", None)]
    got = {r["g"]: (r["n"], r["q"]) for r in exact_quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", (0.0, 0.25, 0.5, 1.0)).collect()}
    for k in set(g):
        part = v[g == k]
        assert got[k][0] == len(part) and got[k][1] == pytest.approx(np.quantile(part, [0, 0.25, 0.5, 1]).tolist())
    assert got[None] == (2, [1.0, 1.5, 2.0, 3.0])


def test_quantiles_of_nothing(spark):
    x = spark.createDataFrame([(None,)], "v double")
    assert list(vectors.quantiles(x, "v", (0.5,)).first()) == [None] and exact_quantiles(x.withColumn("g", F.lit(1)), ["g"], "v", (0.5,)).count() == 0


def test_alignment(spark):
    r = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), (None, 4)], "id string, x int")
    v = spark.createDataFrame([("b", [1.0]), ("c", [2.0]), (None, [3.0])], "vid string, v array<double>")
    both, report = vectors.align(r, "id", v, "vid")
    assert sorted((x["id"], x["x"], x["v"]) for x in both.collect()) == [("b", 2, [1.0]), ("b", 3, [1.0])]
    assert report.first().asDict() == {"n_records": 4, "n_vectors": 3, "n_aligned": 2, "n_without_vector": 2, "n_without_record": 2, "complete": False}
    assert vectors.align(r.limit(0), "id", v.limit(0), "vid")[1].first()["complete"] is True


@pytest.mark.parametrize("block", [1 << 26, 64])
def test_seed_scores_take_ids_of_any_type(spark, block):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(30, 3))
    rows = [(f"d{i}", [float(v) for v in m[i]], i % 3 == 0) for i in range(30)] + [("d0", [float(v) for v in m[0]], True)]
    got = vectors.seed_scores(spark.createDataFrame(rows, "id string, v array<double>, s boolean"), "id", "v", F.col("s"), 2, block).collect()
    seeds = [(f"d{i}", m[i]) for i in range(0, 30, 3)] + [("d0", m[0])]
    for r in got:
        i = int(r["id"][1:])
        want = sorted((m[i] @ s for k, s in seeds if k != r["id"]), reverse=True)[:2]
        assert r["score"] == pytest.approx(np.mean(want))


def test_eta_squared_of_large_values(spark):
    x = spark.createDataFrame([(c, 1e9 + 0.001 * (10 * c + i % 3)) for c in (0, 1) for i in range(300)], "c int, y double")
    y = np.array([[10 * c + i % 3 for i in range(300)] for c in (0, 1)], dtype=float)
    want = 300 * ((y.mean(1) - y.mean()) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    assert measure.eta_squared(x.withColumn("y", F.col("y") * 1000), "y", "c").first()["eta2"] == pytest.approx(want, rel=1e-4)


def test_union_distinct(spark):
    a = spark.createDataFrame([(1, "a"), (2, "a")], "id int, part string")
    b = spark.createDataFrame([(2, "b"), (3, "b"), (3, "b"), (None, "b")], "id int, part string")
    assert sorted(((r["id"] or 0), r["part"]) for r in dedup.union_distinct([a, b.withColumn("more", F.lit(1))], ["id"]).collect()) == [(0, "b"), (1, "a"), (2, "a"), (3, "b")]


@pytest.mark.parametrize("v, want", [(None, []), (" ", []), ("cpu, Gpu ,cpu,Other", ["CPU", "GPU", "Other"])])
def test_canonical_list(spark, v, want):
    assert spark.createDataFrame([(v,)], "c string").select(dedup.canonical_list(F.col("c"), {"CPU": "CPU", "GPU": "GPU"})).first()[0] == want


def test_several_categories_in_the_confusion(spark):
    x = spark.createDataFrame([("A, b", ["A"]), ("B", ["B"]), (None, ["A"])], "gold string, found array<string>").withColumn("gold", dedup.canonical_list(F.col("gold"), {"B": "B"}))
    got = {r["category"]: (r["n_gold"], r["tp"], r["fp"], r["fn"]) for r in validate.class_confusion(x, "gold", "found", ["A", "B"]).collect()}
    assert got == {"A": (1, 1, 1, 0), "B": (2, 1, 0, 1)}


def test_recommendation(spark):
    rows = [(1, 20, 10.0, 0.1), (2, 20, 10.0, 0.3), (3, 5, 10.0, 0.9), (4, 20, 60.0, 0.9), (5, 2, 1.0, 0.9)]
    got = cluster.recommend(spark.createDataFrame(rows, "a int, k int, largest_pct double, silhouette double")).collect()
    assert [r["a"] for r in got][:3] == [2, 1, 3] and [r["recommended"] for r in got] == [True] + [False] * 4
    assert not any(r["recommended"] for r in cluster.recommend(spark.createDataFrame(rows[3:], "a int, k int, largest_pct double, silhouette double")).collect())


def test_representation_grid(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(v) for v in rng.normal(6 * (i % 3), 0.3, 3)], [float(i % 2), 1.0 - i % 2]) for i in range(90)]
    x = spark.createDataFrame(rows, "id long, a array<double>, b array<double>")
    got = cluster.representation_grid(x, "id", {4: {"a": "a", "b": "b"}}, [0.0, 0.5], "b", {"a": 1.0}, 2, [10, 40], [3])
    assert {(r["granularity"], r["weight"], r["min_size"]): r["k"] for r in got.collect()}[4, 0.0, 10] == 3


def test_label_report(spark):
    rows = [("retained", "Y", "x")] * 98 + [("retained", "N", None)] * 22 + [("excluded_near", "Y", "x")] + [("excluded_near", "N", "x")] * 59 + [("retained", "", "x"), ("other", "Y", "x")]
    got = {r["measure"]: r for r in validate.label_report(spark.createDataFrame(rows, "side string, g string, a string"), "g", "side", F.col("a").isNotNull()).collect()}
    assert (got["precision"]["k"], got["precision"]["n"], round(got["precision"]["lo"], 2)) == (98, 120, 73.8) and round(got["false_negatives"]["pct"], 2) == 1.67
    assert got["about"]["k"] == 98 and got["far_positives"]["n"] == 0 and got["far_positives"]["pct"] is None


def test_cluster_map(spark):
    rows = [(c, float(c), float(i), 2000 + i if i else None) for c, m in ((0, 5), (1, 3), (2, 3), (-1, 9)) for i in range(m)]
    names = spark.createDataFrame([(1, "terms"), (0, "not taken")], "cluster int, name string")
    got = [tuple(r) for r in cluster.cluster_map(spark.createDataFrame(rows, "c int, x double, y double, year int"), "c", "x", "y", "year", names, {0: "mine"}, 2).collect()]
    assert got == [(0, 5, 25.0, 2002.5, 0.0, 2.0, "mine", True), (1, 3, 15.0, 2001.5, 1.0, 1.0, "terms", True), (2, 3, 15.0, 2001.5, 2.0, 1.0, "C2", False)]


def test_resumable_embedding(spark, tmp_path):
    x = spark.createDataFrame([(f"k{i}", "a" * i if i else None) for i in range(9)], "id string, t string")
    encode = lambda limit=None: embed.encode_resumably(x, "id", "t", lambda ts: [[float(len(t))] for t in ts], str(tmp_path / "e"), 3, limit)
    assert (encode(4), encode(), encode()) == (4, 5, 0)
    assert {r["id"]: r["embedding"] for r in spark.read.parquet(str(tmp_path / "e")).collect()} == {f"k{i}": [float(i)] for i in range(9)}


def test_merged_labels_replace_stale_ones(spark):
    s = spark.createDataFrame([(1, "stale"), (2, "stale")], "id int, label string")
    got = sampling.merge_labels(s, spark.createDataFrame([(1, " Y\xa0", 9)], "id int, label string, other int"), "id", ["label"])
    assert {r["id"]: r["label"] for r in got.collect()} == {1: "Y", 2: ""} and got.columns == ["id", "label"]


def test_size_notes():
    assert "narrow" in measure.size_note(10) and "wide" in measure.size_note(10**6) and measure.size_note(50_000) == ""


def test_over_cores(spark):
    x = spark.range(10, numPartitions=1)
    assert over_cores(x, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    wide = spark.range(10, numPartitions=64)
    assert over_cores(wide, "id") is wide
