import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import consensus as C

ONE = "label_id long, publication_number string, is_ai_hardware string, annotator string, labelled_at timestamp"
TWO = ONE.replace("label_id", "label2_id")
AT = dt.datetime(2025, 1, 1)


@pytest.mark.parametrize("v, want", [("Y?", "Y"), (" yes. ", "Y"), ("1", "Y"), ("TRUE", "Y"), ("Yes - claim 1", "Y"), ("no, software only", "N"), ("N.", "N"), ("0", "N"), ("No!", "N"), ("n/a", None), ("Y/N", None), ("not sure", None), ("NaN", None), ("B", None), ("?", None), ("", None), (None, None), ("none", None), ("no idea", None), ("yet to check", None)])
def test_yes_no(spark, v, want):
    assert spark.createDataFrame([(v,)], "c string").select(C.yes_no(F.col("c"))).first()[0] == want


def sheets(spark, first, more):
    a = spark.createDataFrame([(i, p, v, w, AT + dt.timedelta(hours=h)) for i, (p, v, w, h) in enumerate(first)], ONE)
    return a, spark.createDataFrame([(i, p, v, w, AT + dt.timedelta(hours=h)) for i, (p, v, w, h) in enumerate(more)], TWO)


def test_last_answers(spark):
    a, b = sheets(spark, [("US 1/2 A1", "Y", "p", 1), ("US 3 B1", "Y", "p", 5)], [("us12a1", "N", "p", 2), ("US-12-A1", "Y", "q", 0), ("US 3 B1", "not sure", "p", 6), (None, "Y", "q", 1), ("US 3 B1", "Y", None, 1)])
    assert {tuple(r) for r in C.last_answers(a, b).collect()} == {("US12A1", "p", "N"), ("US12A1", "q", "Y")}


def test_consensus_form(spark):
    a, b = sheets(spark, [("US 1 A", "Y", "p", 1), ("US 2 A", "N", "p", 1)], [("us1a", "Y", "q", 1), ("us1a", "Y", "r", 1), ("US 2 A", "N", "q", 1), ("US 9 A", "Y", "q", 1)])
    assert [(r[0], r[1]) for r in C.consensus(a, b).collect()] == [("US 1 A", "Y")]


def test_empty(spark):
    a, b = sheets(spark, [], [])
    assert C.consensus(a, b).count() == 0 and C.annotators(a, b).count() == 0
    r = C.agreement(a, b).first()
    assert r["n_items"] == 0 and r["alpha"] is None


def test_better_than_the_majority(spark):
    rng = random.Random(5)
    people = {"good1": 0.95, "good2": 0.93, "liar": 0.08, "coin1": 0.5, "coin2": 0.5}
    truth, rows = {}, []
    for i in range(400):
        p, t = f"US {i} A", rng.random() < 0.5
        truth[p] = "Y" if t else "N"
        for w, acc in people.items():
            rows.append((p, "Y" if t == (rng.random() < acc) else "N", w, 0))
    a, b = sheets(spark, [r for r in rows if r[2] == "good1"], [r for r in rows if r[2] != "good1"])
    got = {r[0]: r[1] for r in C.consensus(a, b).collect()}
    right = sum(got[p] == t for p, t in truth.items()) / len(truth)
    votes = {}
    for p, v, _, _ in rows:
        votes[p] = votes.get(p, 0) + (1 if v == "Y" else -1)
    majority = sum(("Y" if votes[p] > 0 else "N") == t for p, t in truth.items()) / len(truth)
    assert right > 0.95 > majority
    rel = {r["annotator"]: r["reliability"] for r in C.annotators(a, b).collect()}
    assert rel["liar"] < 0.2 < rel["coin1"] < 0.7 < rel["good2"]


def test_agreement_numbers(spark):
    a, b = sheets(spark, [(f"U{i}", "Y" if i < 6 else "N", "p", 0) for i in range(10)], [(f"U{i}", "Y" if i < 5 else "N", "q", 0) for i in range(10)])
    r = C.agreement(a, b).first()
    do, de = 1 / 10, 2 * 11 * 9 / (20 * 19)
    assert r["observed_agreement"] == pytest.approx(0.9) and r["alpha"] == pytest.approx(1 - do / de)
    k = C.pair_kappa(a, b).first()
    assert k["n_items"] == 10 and k["kappa"] == pytest.approx((0.9 - 0.5) / 0.5)


def test_many_annotators_take_a_table(spark):
    rng = random.Random(7)
    rows = [(f"U{i % 60}", f"w{w}", "Y" if (i % 60 < 30) == (rng.random() < 0.5 + w / 20) else "N") for i in range(60) for w in range(10) if rng.random() < 0.7]
    x = spark.createDataFrame(rows, "item string, annotator string, answer string")
    a, b = ({r["item"]: r["p_yes"] for r in C.fit(x, 5, literal=n)[0].collect()} for n in (1000, 0))
    assert set(a) == set(b) and all(a[k] == pytest.approx(b[k]) for k in a)
