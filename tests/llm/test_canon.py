import random

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import canon

REF = [(1, "Memristive crossbar array", "MXB", "resistive grid array|memristor matrix"), (2, "Winner-take-all circuit", "WTA", None), (3, "DRAM bank compute layer", "DBC", "row-activated compute bank"), (4, "Event-driven spiking core", None, "")]
CASES = [
    ("Memristive crossbar array", 1), ("memristor  matrix!", 1), ("MXB", 1), ("m.x.b.", 1), ("MXBs", 1), ("Ｍｅｍｒｉｓｔｉｖｅ　ｃｒｏｓｓｂａｒ array", 1), ("array, Memristive crossbar", 1),
    ("hybrid memristive crosbar aray (claim 1)", 1), ("Winner–take–all\xa0circuit", 2), ("Winnertakeall circuit", 2), ("Winne. circu.", 2), ("circuit of Winner-take-all", 2), ("DRAM bankcompute lyaer", 3),
    ("DRA Mbank compute layer", 3), ("Evnet-dirven spikign core", 4), ("Event_driven_spiking_core", 4), ("Tree pruning robot", 0), ("see notes", 0), ("Memory bank statement", 0),
]


def ref(spark, rows=REF):
    return spark.createDataFrame(rows, "arch_id long, arch_name string, short_code string, other_names string")


def test_cases(spark):
    x = spark.createDataFrame([(i, v, "x") for i, (v, _) in enumerate(CASES)], "label_id long, architecture string, token string")
    got = {r["label_id"]: r["arch_id"] for r in canon.canonical_rows(x, ref(spark)).collect()}
    assert {CASES[i][0]: a for i, a in got.items()} == dict(CASES)


def test_no_statement_is_no_case(spark):
    x = spark.createDataFrame([(i, v) for i, v in enumerate([None, "", " \xa0", "-", "NONE.", "n/a", "[none]", "keine", "no architecture", "MXB", "MXB"])], "label_id long, architecture string")
    assert {(r["label_id"], r["arch_id"]) for r in canon.canonical_rows(x, ref(spark)).collect()} == {(9, 1), (10, 1)}


def test_empty_tables(spark):
    x = spark.createDataFrame([(1, "MXB")], "label_id long, architecture string")
    assert canon.canonical_rows(x.limit(0), ref(spark)).count() == 0
    assert [r["arch_id"] for r in canon.canonical_rows(x, ref(spark, [])).collect()] == [0]


def test_unmatched_are_counted(spark):
    x = spark.createDataFrame([(1, "robot"), (2, "robot"), (3, "MXB")], "label_id long, architecture string")
    assert [(r["value"], r["n_rows"]) for r in canon.unmatched_values(x, ref(spark)).collect()] == [("robot", 2)]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def allowed(n):
    return 0 if n <= 3 else 1 if n <= 5 else 2 if n <= 9 else 3


def test_join_against_brute_force(spark):
    rng = random.Random(7)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(2, 13))) for _ in range(40)})
    tokens = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 14))) for _ in range(120)} | set(words))
    vocab = spark.createDataFrame([(w,) for w in words], "token string")
    got = {(r["token"], r["word"]): r["sim"] for r in canon.repair_tokens(spark.createDataFrame([(t,) for t in tokens], "token string"), vocab).collect()}
    want = {(t, w): 1 - edits(t, w) / len(w) for t in tokens for w in words if edits(t, w) <= allowed(len(w))}
    assert want.keys() <= got.keys()
    for pair in got.keys() - want.keys():  # only exchanged letters may add pairs
        assert sorted(pair[0]) == sorted(pair[1]) and edits(*pair) <= 4
    for pair in want:
        assert got[pair] >= want[pair] - 1e-9


@pytest.mark.parametrize("long", ["x" * 5000, "word " * 3000])
def test_very_long_values(spark, long):
    x = spark.createDataFrame([(1, long)], "label_id long, architecture string")
    assert canon.canonical_rows(x, ref(spark)).first()["arch_id"] == 0


def test_states_something_nulls(spark):
    assert spark.createDataFrame([(None,)], "v string").select(canon.states_something(F.col("v"))).first()[0] is False
