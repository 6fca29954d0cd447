import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import cluster, dedup, embed, evidence, measure, sampling, terms, validate, vectors
from corpusloom.operators.evidence import RuleOptions, Taxonomy, Vocabulary
from corpusloom.plans.queries import QUERIES

V = Vocabulary(("G06N3/06",), ("G06N",), ("G06N10",), ("G11C",), r"\b(?:neural network|synaptic)\b", r"\b(?:systolic|tensor\s+comput)\b", r"\b(?:accelerator|crossbar)\b", r"\b(?:memory)\b", r"\b(?:qubit|etching process)\b")


def tag(spark, *rows):
    return evidence.tag_evidence(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, title string, abstract string, cpc_codes string"), V)


def test_flags_and_traps(spark):
    rows = tag(spark, ("An accelerator", None, "G06N3/063"), ("accelerators", "tensor computing", "G06N3/006"), (None, "etching process", "G06N3/08;;G06N10/20"), ("Etching process", None, None)).orderBy("id").collect()
    assert [r["ev_core"] for r in rows] == [True, False, False, False]
    assert [r["ev_device_text"] for r in rows] == [True, False, False, False]
    assert [r["ev_mechanism"] for r in rows] == [False] * 4  # a stem before a closing boundary stays dead
    assert [r["ev_topic_code"] for r in rows] == [True, True, False, False]
    assert [r["ev_veto"] for r in rows] == [False, False, False, True]


def test_rules_differ(spark):
    x = tag(spark, ("systolic accelerator", "", "G06F17/16"), ("synaptic crossbar", "", "G06N3/06"), ("data", "", "G06N3/06"))
    assert [r["in_corpus"] for r in evidence.apply_rule(x).orderBy("id").collect()] == [False, True, False]
    legacy = RuleOptions(require_text=False, second_tier=True)
    assert [r["tier"] for r in evidence.apply_rule(x, legacy).orderBy("id").collect()] == ["T2", "T1", "T1"]


def test_attrition_of_nothing(spark):
    x = evidence.apply_rule(tag(spark, ("a", "b", "c")).where("false"))
    assert [r["n"] for r in evidence.attrition(x).orderBy("ordinal").collect()] == [0] * 7


def test_classes(spark):
    t = Taxonomy({"A": (("TPU",), ()), "B": ((), ("in memory comput",))})
    x = evidence.tag_classes(spark.createDataFrame([(1, "TPUs", "in-memory computing"), (2, None, None)], "id int, title string, text string"), t).orderBy("id").collect()
    assert x[0]["labels"] == ["B"] and x[0]["title_labels"] == ["A"] and x[1]["labels"] == []


def test_dedup_is_deterministic(spark):
    x = spark.createDataFrame([("k", 2, "b"), ("k", 1, "a"), (None, 3, "c"), (None, 4, "d"), ("k", 1, "a")], "k string, n int, v string")
    for p in (1, 3):
        assert sorted((r["k"] or "", r["n"]) for r in dedup.keep_first(x.repartition(p), ["k"], ["n"]).collect()) == [("", 3), ("k", 1)]
    assert {(r["k"], r["v"]) for r in dedup.keep_preferred(x, ["k"], F.when(F.col("v") == "b", 0).otherwise(1), "n").collect()} == {("k", "b"), (None, "c"), (None, "d")}


def test_collapse_modes(spark):
    x = spark.createDataFrame([("f", 1, False), ("f", 2, True), ("g", 3, False), (None, 4, True), (None, 5, True), (None, 6, False)], "f string, id int, g boolean")
    run = lambda m: {(r["f"], r["id"], r["granted"]) for r in dedup.collapse(x, "f", F.col("g"), "id", m).collect()}
    assert run("invention") == {("f", 2, True), ("g", 3, False), (None, 4, True), (None, 5, True), (None, 6, False)}
    assert run("apps_only") == {("f", 1, True), ("g", 3, False), (None, 6, False)}
    assert run("grants_only") == {("f", 2, True), (None, 4, True), (None, 5, True)}


def test_every_record_has_a_key(spark):
    rows = [(1, "US-1 p"), (2, "us1P"), (3, None), (4, None), (5, "N/A"), (6, "N/A"), (7, " 0 ")]
    x = spark.createDataFrame(rows, "id int, f string")
    got = {r["id"]: r["k"] for r in x.select("id", dedup.group_key("id", F.col("f")).alias("k")).collect()}
    assert got == {1: "US1P", 2: "US1P"} | {i: f"NOAPP_{i}" for i in range(3, 8)}


def test_collapse_loses_no_record(spark, data):
    keyed = {r["family"] for r in QUERIES["collapse_invention"](spark, data).collect()}
    rows = spark.read.parquet(f"{data}/stage1_corpus.parquet").count()
    parts = QUERIES["collapse_apps_only"](spark, data).count(), QUERIES["collapse_grants_only"](spark, data).count()
    assert max(parts) <= len(keyed) <= min(rows, sum(parts))


def test_union_shared(spark):
    a, b = spark.createDataFrame([(1, "x")], "i int, s string"), spark.createDataFrame([("2", 1.0)], "i string, d double")
    assert [tuple(r) for r in dedup.union_shared([a, b]).orderBy("i").collect()] == [("1",), ("2",)]
    assert dedup.one_sided_columns(a, b) == (["s"], ["d"])


def test_shares_keep_empty_years(spark):
    x = spark.createDataFrame([(2001, ["A"]), (2001, []), (2003, ["A"]), (None, ["A"])], "y int, labels array<string>")
    rows = {r["year"]: r for r in measure.annual_shares(x, "y", "labels", ["A"], 2001, 2003, 2002).collect()}
    assert rows[2001]["pct"] == 50.0 and rows[2002]["pct"] is None and rows[2002]["lo"] is None and rows[2003]["provisional"]


def test_eta_squared(spark):
    x = spark.createDataFrame([(c, float(10 * c + i % 3)) for c in (0, 1, -1) for i in range(9)], "c int, y double")
    y = np.array([[10 * c + i % 3 for i in range(9)] for c in (0, 1)], dtype=float)
    want = 9 * ((y.mean(1) - y.mean()) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    assert measure.eta_squared(x, "y", "c").first()["eta2"] == pytest.approx(want)
    assert measure.eta_squared(x.limit(0), "y", "c").first()["eta2"] is None
    assert measure.eta_squared(x.withColumn("y", F.lit(1.0)), "y", "c").first()["eta2"] is None


def test_impute_and_scale(spark):
    x = spark.createDataFrame([(1, 2000), (2, 2010), (3, None)], "id int, y int")
    assert [r["scaled"] for r in measure.impute_scale(x, "y").orderBy("id").collect()] == [0.0, 1.0, 0.5]
    assert measure.impute_scale(x.where("y is null"), "y").first()["scaled"] is None


@pytest.mark.parametrize("v, want", [("Y", "Y"), (" yes ", "Y"), ("n", "N"), ("Borderline", "B"), ("", ""), (None, ""), ("nan", ""), ("maybe", "")])
def test_norm_label(spark, v, want):
    assert spark.createDataFrame([(v,)], "c string").select(validate.norm_label(F.col("c"))).first()[0] == want


def test_agreement_counts(spark):
    rows = [("Y", "Y")] * 27 + [("N", "N")] * 21 + [("Y", "N")] * 2 + [("", "Y"), ("B", "N")]
    r = validate.agreement(spark.createDataFrame(rows, "a string, b string"), "a", "b").first()
    assert r["raw_pct"] == 96.0 and round(r["kappa"], 5) == 0.91896 and r["band"] == "almost perfect"


def test_precision_by(spark):
    rows = [("retained", "Y")] * 98 + [("retained", "N")] * 22 + [("near", "Y")] + [("near", "N")] * 59
    got = {r["side"]: r for r in validate.precision_by(spark.createDataFrame(rows, "side string, g string"), "g", "side").collect()}
    assert round(got["retained"]["precision_pct"], 2) == 81.67 and round(got["near"]["precision_pct"], 2) == 1.67


def test_samples_do_not_depend_on_partitions(spark):
    x = spark.range(1000).withColumn("s", (F.col("id") % 3).cast("string"))
    draw = lambda p: {r["id"] for r in sampling.stratified(x.repartition(p), "s", "id", {"0": 10, "1": 5000}).collect()}
    assert draw(1) == draw(7) and len(draw(1)) == 10 + 333


def test_blind_sheet_hides(spark):
    s = sampling.blind_sheet(spark.range(5).withColumn("tier", F.lit("T1")), "id", ["tier"], ["label"])
    assert s.columns == ["id", "row", "label"] and sorted(r["row"] for r in s.collect()) == [1, 2, 3, 4, 5]


def test_strata(spark):
    x = spark.createDataFrame([(True, True, True), (True, False, False), (False, False, False), (True, True, False)], "t boolean, d boolean, i boolean")
    assert [r[0] for r in x.select(sampling.strata(F.col("t"), F.col("d"), F.col("i"))).collect()] == ["retained", "excluded_near", "excluded_far", "excluded_both"]


@pytest.mark.parametrize("block", [1 << 26, 64])
def test_seed_scores_against_brute_force(spark, block):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(40, 4))
    x = spark.createDataFrame([(i, [float(v) for v in m[i]], i % 4 == 0) for i in range(40)] + [(99, None, False)], "id long, v array<double>, s boolean")
    got = {r["id"]: r["score"] for r in vectors.seed_scores(x, "id", "v", F.col("s"), 3, block).collect()}
    for i in range(40):
        sims = sorted((m[i] @ m[j] for j in range(0, 40, 4) if j != i), reverse=True)[:3]
        assert got[i] == pytest.approx(np.mean(sims))
    assert got[99] is None


def test_no_seeds(spark):
    x = spark.createDataFrame([(1, [1.0, 0.0])], "id long, v array<double>")
    assert vectors.seed_scores(x, "id", "v", F.lit(False)).first()["score"] is None


def test_blobs_are_found():
    rng = np.random.default_rng(1)
    a = np.concatenate([rng.normal(c, 0.2, size=(60, 2)) for c in ((0, 0), (6, 0), (0, 6))] + [rng.uniform(-20, 20, size=(20, 2))])
    lab = cluster.density_clusters(a, 20, 5)
    assert lab.max() == 2
    for k in range(3):
        part = lab[60 * k : 60 * k + 60]
        assert (part == np.bincount(part[part >= 0]).argmax()).mean() > 0.9
    assert (lab[180:] == -1).mean() > 0.6
    order = rng.permutation(len(a))
    again = cluster.density_clusters(a[order], 20, 5)
    assert {frozenset(np.flatnonzero(lab == k)) for k in range(3)} == {frozenset(order[np.flatnonzero(again == k)]) for k in range(3)}
    assert (cluster.density_clusters(a[:5], 20, 5) == -1).all()


def test_partition_agreement(spark):
    x = spark.createDataFrame([(i % 3, (i % 3) * 7) for i in range(30)], "a int, b int")
    r = cluster.agreement(x, "a", "b").first()
    assert r["ari"] == pytest.approx(1.0) and r["nmi"] == pytest.approx(1.0)


def test_spearman_with_ties(spark):
    x = spark.createDataFrame([(1, 10), (2, 20), (2, 30), (3, 30), (4, 5)], "a int, b int")
    ra, rb = np.array([1, 2.5, 2.5, 4, 5]), np.array([2, 3, 4.5, 4.5, 1])
    assert cluster.spearman(x, "a", "b").first()["rho"] == pytest.approx(np.corrcoef(ra, rb)[0, 1])


def test_selection(spark):
    x = spark.createDataFrame([("g", 5, 3, 20, 10.0, 0.1), ("g", 6, 3, 5, 10.0, 0.9), ("g", 7, 3, 2, 10.0, 1.0), ("g", 8, 3, 30, 60.0, 1.0)], "g string, min_size int, min_samples int, k int, largest_pct double, silhouette double")
    assert cluster.select_configurations(x, ["g"]).first()["min_size"] == 5


def test_top_terms(spark):
    x = spark.createDataFrame([(i, "g", "The crossbar array stores") for i in range(4)] + [(9, "h", "alone")], "id long, g string, t string")
    got = terms.top_terms(x, "g", "id", "t", 2).collect()
    assert {r["g"] for r in got} == {"g"} and got[0]["weight"] > 0
    names = {r["g"]: r["name"] for r in terms.cluster_names(x.withColumn("g", F.when(F.col("g") == "g", 1).otherwise(2)), "g", "id", "t", {1: "mine"}).collect()}
    assert names == {1: "mine", 2: "C2"}


def test_encoders(spark):
    x = spark.createDataFrame([(1, "ab"), (2, None)], "id long, t string")
    got = {r["id"]: r["embedding"] for r in embed.encode_with(x, "id", "t", lambda ts: [[len(t), 1.0] for t in ts]).collect()}
    assert got == {1: [2.0, 1.0], 2: [0.0, 1.0]}
    assert embed.hashed_tfidf(x, "id", "t", 8).count() == 2
    view, names = embed.code_view(spark.createDataFrame([(1, "AAAA1;;BBBB2"), (2, None)], "id long, c string"), "id", "c", 4)
    assert names == ["AAAA", "BBBB"] and {r["id"]: [round(v, 3) for v in r["codes_view"]] for r in view.collect()} == {1: [0.707, 0.707], 2: [0.0, 0.0]}


def brute_silhouette(m, c):
    d = np.sqrt(((m[:, None] - m[None]) ** 2).sum(2))
    out = []
    for i in range(len(m)):
        own = (c == c[i]).sum()
        b = min(d[i, c == k].mean() for k in set(c) - {c[i]})
        a = d[i, c == c[i]].sum() / max(own - 1, 1)
        out.append((b - a) / max(a, b) if own > 1 else 0.0)
    return np.mean(out)


@pytest.mark.parametrize("block", [1 << 20, 256])
def test_silhouette_against_brute_force(spark, block):
    rng = np.random.default_rng(3)
    c = np.array([i % 3 for i in range(60)] + [7])
    m = rng.normal(size=(61, 2)) + c[:, None]
    rows = [(i, [float(v) for v in m[i]], int(c[i])) for i in range(61)] + [(98, [0.0, 0.0], -1), (99, None, 0)]
    x = spark.createDataFrame(rows, "id long, v array<double>, c int")
    assert cluster.silhouette(x, "id", "v", "c", block_bytes=block).first()["silhouette"] == pytest.approx(brute_silhouette(m, c))
    assert cluster.silhouette(x.where("c = 1"), "id", "v", "c").first()["silhouette"] is None


def test_silhouette_takes_all_rows(spark):
    n = 20_002  # two points and one far row each: a sample of 20,000 would miss rows
    x = spark.range(n).select("id", F.when(F.col("id") < n - 2, F.array(F.lit(0.0))).otherwise(F.array(F.lit(1.0))).alias("v"), F.when(F.col("id") % 2 == 0, 0).otherwise(1).alias("c"))
    half, s = n // 2, []
    for far in (False, True):
        a, b = ((half - 1) / (half - 1), (half - 1) / half) if far else (1 / (half - 1), 1 / half)
        s.append((b - a) / max(a, b))
    want = ((n - 2) * s[0] + 2 * s[1]) / n
    assert cluster.silhouette(x, "id", "v", "c").first()["silhouette"] == pytest.approx(want, rel=1e-9)


def test_density_blocks_give_the_same_labels(spark):
    rng = np.random.default_rng(5)
    m = np.round(np.concatenate([rng.normal(c, 0.3, size=(40, 2)) for c in ((0, 0), (5, 0), (0, 5))] + [rng.uniform(-9, 9, size=(20, 2))]), 1)  # many equal distances
    x = spark.createDataFrame([(i * 7, [float(v) for v in m[i]]) for i in range(len(m))] + [(-1, None)], "id long, v array<double>")
    want = cluster.density_clusters(m, 15, 4)
    assert want.max() >= 2
    for rows in (4096, 30):
        got = cluster.cluster_table(x, "id", "v", 15, 4, block_rows=rows).orderBy("id").collect()
        assert [r["id"] for r in got] == [i * 7 for i in range(len(m))] and [r["cluster"] for r in got] == want.tolist()
    a, b = ({tuple(round(v, 9) for v in r) for r in cluster.grid(x, "id", "v", [5, 15], [3, 4], block_rows=rows).collect()} for rows in (4096, 30))
    row = {r[:2]: r for r in a}[15, 4]
    assert a == b and row[2] == want.max() + 1 and row[3] == pytest.approx(100 * (want < 0).mean()) and row[5] == pytest.approx(brute_silhouette(m[want >= 0], want[want >= 0]))
    assert [r["cluster"] for r in cluster.cluster_table(x.where("id in (0, 7)"), "id", "v", 15, 4).collect()] == [-1, -1]
    assert cluster.cluster_table(x.where("id = 0"), "id", "v", 15, 4).collect()[0]["cluster"] == -1


def test_density_refuses_no_number_of_rows(spark):
    rows = 20_001  # one more than was taken before
    x = spark.range(rows).select("id", F.array((F.col("id") % 2) * 1e6 + F.col("id") / 2.0).alias("v"))
    got = {(r["odd"], r["cluster"]): r["n"] for r in cluster.cluster_table(x, "id", "v", 50, 5).groupBy((F.col("id") % 2).alias("odd"), "cluster").agg(F.count("*").alias("n")).collect()}
    assert len(got) == 2 and sorted(got.values()) == [10_000, 10_001] and len({c for _, c in got}) == 2 and min(c for _, c in got) >= 0


def test_hashed_embedding_is_of_all_records(spark, data):
    x = QUERIES["hashed_embedding"](spark, data).collect()
    assert len(x) == spark.read.parquet(f"{data}/stage1_corpus.parquet").count() and {len(r["embedding"]) for r in x} == {256}
    assert {round(float(np.linalg.norm(r["embedding"])), 6) for r in x} <= {0.0, 1.0}


def test_hashed_embedding_reads_the_abstract(spark, tmp_path):
    rows = [(1, "crossbar", "memory"), (2, "crossbar", "logic"), (3, None, "memory"), (4, None, None)]
    spark.createDataFrame(rows, "rec_id long, title string, abstract string").write.parquet(f"{tmp_path}/stage1_corpus.parquet")
    v = {r["rec_id"]: np.array(r["embedding"]) for r in QUERIES["hashed_embedding"](spark, str(tmp_path)).collect()}
    assert sorted(v) == [1, 2, 3, 4] and not v[4].any() and np.linalg.norm(v[3]) == pytest.approx(1.0)
    assert v[1] @ v[3] > 0 and v[1] @ v[2] < 0.999


def test_code_view_has_main_groups(spark, data):
    x = spark.read.parquet(f"{data}/stage1_corpus.parquet").select("rec_id", "cpc_codes").collect()
    heads = {r["rec_id"]: {c.strip()[:8] for c in (r["cpc_codes"] or "").split(";;") if len(c.strip()) >= 8} for r in x if not (r["cpc_codes"] or "").lstrip().startswith("[")}
    got = {r["rec_id"]: r["codes_view"] for r in QUERIES["code_view"](spark, data).collect()}
    assert len(got) == len(x) and len({len(v) for v in got.values()}) == 1
    for i, h in heads.items():
        assert [round(v, 9) for v in got[i] if v] == [round(max(1, len(h)) ** -0.5, 9)] * len(h)
    assert embed.code_view(spark.createDataFrame([(1, None)], "id long, c string"), "id", "c")[0].first()["codes_view"] == []


def test_ablation_has_all_views_and_weights(spark, data):
    got = {(r["view"], r["weight"]): r for r in QUERIES["view_ablation"](spark, data).collect()}
    assert sorted(got) == [("codes", 0.0), ("codes", 0.15), ("codes", 0.3), ("codes", 0.6), ("temporal", 0.0), ("temporal", 0.05), ("temporal", 0.15), ("temporal", 0.3), ("temporal", 0.6)]
    assert got["codes", 0.0]["ari_vs_zero"] == pytest.approx(1.0)


def test_terms_are_of_all_documents(spark, tmp_path):
    rows = [(i, "a", "en", "crossbar") for i in range(3)] + [(9, "a", "en", "memory crossbar"), (10, "a", "EN", "memory"), (11, "a", None, "memory"), (12, "b", "de", None)] + [(i, None, "de", "Speicherzelle") for i in range(20, 24)] + [(i, "c", "ja", "メモリ") for i in range(30, 33)]
    spark.createDataFrame(rows, "doc_id long, section string, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["section"], r["term"]): r["weight"] for r in QUERIES["section_top_terms"](spark, str(tmp_path)).collect()}
    crossbar, memory = np.log(7 / 5) + 1, np.log(7 / 4) + 1
    length = np.hypot(crossbar, memory)
    assert got == {("a", "crossbar"): pytest.approx((3 + crossbar / length) / 6, abs=1e-6), ("a", "memory"): pytest.approx((2 + memory / length) / 6, abs=1e-6), (None, "speicherzelle"): 1.0, ("c", "メモリ"): 1.0}
    names = {r["c"]: r["name"] for r in QUERIES["cluster_names"](spark, str(tmp_path)).collect()}
    assert names == {0: "speicherzelle, crossbar"}  # in 4 texts, and in 3 with one that it shares


@pytest.mark.parametrize("n, want", [(20_000, True), (24_999, False), (25_000, True), (250_000, True)])
def test_export_limits(spark, n, want):
    assert measure.truncation_flags(spark.range(n).withColumn("f", F.lit("x")), "f").first()["suspect"] is want
