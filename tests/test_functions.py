import datetime as dt

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import dates, stats, text


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(make(F.col("c")).alias("r")).first()["r"]


@pytest.mark.parametrize("v, want", [(" US 33/444-406,7 a.", "US334444067A"), (None, None), ("", "")])
def test_clean_number(spark, v, want):
    assert one(spark, v, text.clean_number) == want


@pytest.mark.parametrize("v, want", [("2025-02-28", dt.date(2025, 2, 28)), ("4/9/2025", dt.date(2025, 9, 4)), ("28/2/2025", dt.date(2025, 2, 28)), ("31/31/2025", None), ("2025-02-30", None), ("4-9-2025", None), ("2025-02-28T10:00", None), ("", None), (None, None)])
def test_mixed_date(spark, v, want):
    assert one(spark, v, dates.mixed_date) == want


@pytest.mark.parametrize("v, want", [("B ;; A;;B;;\xa0", ["A", "B"]), ("['B', 'A']", ["A", "B"]), (None, []), ("", []), ("[not available]", ["[not available]"])])
def test_split_codes(spark, v, want):
    assert one(spark, v, text.split_codes) == want


@pytest.mark.parametrize("v, last, first", [("a;;b;; ", "b", "a"), (" ;; ", None, None), (None, None, None)])
def test_ends_of_list(spark, v, last, first):
    assert one(spark, v, text.last_filled) == last and one(spark, v, text.first_filled) == first


def test_prefix_and_slices(spark):
    codes = ["G06N3/063", "G11C11/54", "H01L"]
    assert one(spark, codes, lambda c: text.any_prefix(c, ("G06N3/06",)), "array<string>") is True
    assert one(spark, codes, lambda c: text.any_prefix(c, ("g06n",)), "array<string>") is False
    assert one(spark, None, lambda c: text.any_prefix(c, ("G",)), "array<string>") is False
    assert one(spark, codes, lambda c: text.code_slices(c, 8), "array<string>") == ["G06N3/06", "G11C11/5"]


@pytest.mark.parametrize("v, want", [("output input basic", False), ("two TPUs", True), ("a tpu.", True), (None, False)])
def test_abbreviations(spark, v, want):
    assert one(spark, v, lambda c: text.contains(c, text.phrase_pattern(("TPU", "NPU", "ASIC")))) is want


@pytest.mark.parametrize("v", ["near-memory", "near memory", "Near\xa0memories"])
def test_phrases(spark, v):
    assert one(spark, v, lambda c: text.contains(c, text.phrase_pattern((), ("near memor",)))) is True


@pytest.mark.parametrize("v, want", [("written in C++.", True), ("C++s differ", True), ("plain C", False), ("C+++", True), ("xC++", False), ("C++11", False)])
def test_signs_stand_for_themselves(spark, v, want):
    assert one(spark, v, lambda c: text.contains(c, text.phrase_pattern(("C++",)))) is want


def test_signs_in_phrases(spark):
    p = text.phrase_pattern((), ("a.b (c)",))
    assert one(spark, "A.B  (C)s", lambda c: text.contains(c, p)) is True and one(spark, "axb (c)", lambda c: text.contains(c, p)) is False


def test_keys(spark):
    same = ["US 123 P", "us-123-p", "ＵＳ１２３Ｐ", " us.123,p\xa0"]
    assert {one(spark, v, text.usable_key) for v in same} == {"US123P"}
    assert {one(spark, v, text.usable_key) for v in ("", "-", "N/A", "0", "none", None, "[not available]", "UNKNOWN", "n.a.")} == {None}


@pytest.mark.parametrize("k, n, lo, hi", [(98, 120, 73.80, 87.57), (36, 45, 66.18, 89.10), (62, 75, 72.57, 89.58)])
def test_wilson(spark, k, n, lo, hi):
    row = spark.createDataFrame([(k, n), (0, 0)], "k long, n long").select(*stats.wilson(F.col("k"), F.col("n"))).collect()
    assert round(row[0][0], 2) == lo and round(row[0][1], 2) == hi and row[1][0] is None and row[1][1] is None


def test_kappa(spark):
    x = spark.createDataFrame([(27, 21, 2, 0), (0, 0, 0, 0), (5, 0, 0, 0)], "yy long, nn long, yn long, ny long").select(stats.kappa(*map(F.col, ("yy", "nn", "yn", "ny"))).alias("k")).withColumn("b", stats.kappa_band(F.col("k"))).collect()
    assert round(x[0]["k"], 5) == 0.91896 and x[0]["b"] == "almost perfect" and x[1]["k"] is None and x[2]["k"] is None


@pytest.mark.parametrize("v, want", [(0.9, "0.90-1.01"), (0.8999, "0.80-0.90"), (1.0, "0.90-1.01"), (0.1, None), (None, None)])
def test_band(spark, v, want):
    assert one(spark, v, lambda c: stats.band(c, [(0.9, 1.01), (0.8, 0.9)]), "double") == want


def test_six_bands(spark):
    from corpusloom.plans.vocab import BANDS

    got = [one(spark, v, lambda c: stats.band(c, BANDS), "double") for v in (0.95, 0.9, 0.87, 0.8, 0.79, 0.7, 0.65, 0.59)]
    assert got == ["0.90-1.01", "0.90-1.01", "0.85-0.90", "0.80-0.85", "0.75-0.80", "0.70-0.75", "0.60-0.70", None]
