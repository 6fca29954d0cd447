import datetime as dt

import pytest

from corpusloom.llm import survivors as S

SCHEMA = "rec_id long, title string, abstract string, cpc_codes string, filing_date date, priority_numbers string, _appno string, _family string, _source string, document_type string, kind string, is_granted boolean, pub_date date, ingested_at timestamp, _source_folder string, _source_file string"


def rec(i, family="US 1 P", **k):
    base = dict(title=f"t{i}", abstract=f"a{i}", cpc_codes="A", filing_date=dt.date(2020, 1, 1), priority_numbers=None, _appno=None, _source=None, document_type=None, kind=None, is_granted=None, pub_date=dt.date(2021, 1, 1), ingested_at=dt.datetime(2024, 1, 1), _source_folder="f", _source_file="x")
    base |= k
    return (i, *[base[c] for c in ("title", "abstract", "cpc_codes", "filing_date", "priority_numbers", "_appno")], family, *[base[c] for c in ("_source", "document_type", "kind", "is_granted", "pub_date", "ingested_at", "_source_folder", "_source_file")])


def found(spark, *rows):
    return {(r[0], r[1]): r[2] for r in S.survivors(spark.createDataFrame(list(rows), SCHEMA)).collect()}


def test_order_and_fields(spark):
    got = found(
        spark, rec(1, pub_date=dt.date(2023, 1, 1)), rec(2, kind="b1 ", title="N/A", filing_date=dt.date(1900, 1, 1)), rec(3, is_granted=True, kind="A1", abstract=None),
        rec(4, pub_date=dt.date(9999, 12, 31)), rec(5, "other"),
    )
    assert got == {(2, "title"): 1, (2, "abstract"): 2, (2, "cpc_codes"): 2, (2, "filing_date"): 1}


def test_ties_go_to_the_smaller_id(spark):
    assert found(spark, rec(9), rec(8), rec(7, ingested_at=None))[(8, "title")] == 8


def test_keys(spark):
    rows = [rec(1, "US-1.p"), rec(2, "ＵＳ　１　Ｐ"), rec(3, "0", priority_numbers="X 9;;us 1 p;; "), rec(4, None, _appno="US1P"), rec(5, "N/A"), rec(6, None, priority_numbers=" ;; ")]
    got = found(spark, *rows)
    assert {k[0] for k in got} == {1} and len(got) == 4


def test_nothing_usable_gives_no_row(spark):
    assert found(spark, rec(1, title="-"), rec(2, title="\xa0")).keys() == {(1, "abstract"), (1, "cpc_codes"), (1, "filing_date")}


def test_empty(spark):
    x = spark.createDataFrame([], SCHEMA)
    assert S.survivors(x).count() == S.golden_records(x).count() == S.true_values(x).count() == 0


def test_even_votes_are_no_grant(spark):
    x = spark.createDataFrame([rec(1, is_granted=True, kind="A1"), rec(2, is_granted=True, kind="B1", document_type="Patent Application"), rec(3, _source=" GRANT ")], SCHEMA)
    assert [r["is_grant"] for r in S.judged(x).orderBy("rec_id").collect()] == [False, True, True]


def test_the_model_decides(spark):
    """A witness that says grant of everything tells nothing, so its word alone makes no grant, although the fields
    that say so outnumber those that deny it."""
    say = lambda i, yes: rec(i, f"k{i}", is_granted=True, kind="B1" if yes else "A1", _source="grant" if yes else "app", document_type="Granted Patent" if yes else "Application")
    x = spark.createDataFrame([say(i, i % 3 == 0) for i in range(300)] + [rec(900, is_granted=True, pub_date=dt.date(2022, 1, 1)), rec(901, kind="B1", pub_date=dt.date(2020, 1, 1))], SCHEMA)
    got = {r["rec_id"]: (r["is_grant"], r["grant_vote"]) for r in S.judged(x).collect()}
    assert got[900] == (False, 1) and got[901] == (True, 1) and got[0] == (True, 4) and got[1] == (False, -2)
    assert {r["survivor_rec"] for r in S.survivors(x).collect()} == {901}  # by the plain majority it would be 900
    t = S.judgements(x).first()
    assert (t["n_records"], t["n_model"], t["n_majority"], t["n_differ"]) == (302, 101, 102, 1)


def test_em_recovers_quality():
    import random

    rng = random.Random(3)
    true = [(0.95, 0.9), (0.6, 0.99), (0.9, 0.6)]
    counts = {}
    for _ in range(30_000):
        z = rng.random() < 0.3
        v = tuple(0 if rng.random() < 0.1 else (1 if rng.random() < (se if z else 1 - sp) else -1) for se, sp in true)
        counts[v] = counts.get(v, 0) + 1
    prior, sens, spec, post = S.two_sided_em(sorted(counts.items()), 3, iterations=500)
    assert prior == pytest.approx(0.3, abs=0.05)
    for s in range(3):
        assert sens[s] == pytest.approx(true[s][0], abs=0.06) and spec[s] == pytest.approx(true[s][1], abs=0.06)


def test_true_values_keep_several(spark):
    rows = [rec(i, f"k{i // 4}", cpc_codes="A;;B" if i % 4 < 3 else "A;;Z", _source_file=f"s{i % 4}") for i in range(80)]
    got = {(r["_key"], r["value"]) for r in S.true_values(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert ("K3", "A") in got and ("K3", "B") in got and ("K3", "Z") not in got


def test_golden(spark):
    r = S.golden_records(spark.createDataFrame([rec(1, kind="B1", title=None), rec(2)], SCHEMA)).collect()
    assert len(r) == 1 and r[0]["survivor_rec"] == 1 and r[0]["title"] == "t2" and r[0]["n_records"] == 2


def test_against_brute_force(spark, data):
    rows = spark.read.parquet(f"{data}/stage1_corpus.parquet")
    import re
    import unicodedata

    def key(v):
        k = re.sub(r"[\W_]+", "", unicodedata.normalize("NFKC", v or "")).upper()
        return None if k in ("", "NA", "NONE", "NULL", "UNKNOWN", "0", "NAN", "NOTAVAILABLE") else k

    def ok(v):
        if v is None:
            return False
        if isinstance(v, dt.date):
            return str(v) not in S.EMPTY_DATES
        return v.strip().strip("[]").lower() not in ("", "-", "?", "n/a", "n.a.", "none", "null", "not available")

    groups = {}
    for r in rows.collect():
        last = [p for p in (r["priority_numbers"] or "").split(";;") if p.strip()]
        k = key(r["_family"]) or key(last[-1] if last else None) or key(r["_appno"])
        if k:
            say = [r["is_granted"]] + [None if not (v or "").strip() else v.strip().lower().startswith(p) for v, p in ((r["_source"], "grant"), (r["kind"], "b"), (r["document_type"], "grant"))]
            grant = sum(1 if s else -1 for s in say if s is not None) > 0
            day = r["pub_date"].toordinal() if ok(r["pub_date"]) else -1
            groups.setdefault(k, []).append(((not grant, -day, -r["ingested_at"].timestamp(), r["rec_id"]), r))
    want = set()
    for g in groups.values():
        if len(g) > 1:
            g.sort(key=lambda x: x[0])
            for f in S.FIELDS:
                hit = next((r for _, r in g if ok(r[f])), None)
                if hit:
                    want.add((g[0][1]["rec_id"], f, hit["rec_id"]))
    assert {tuple(r) for r in S.survivors(rows).collect()} == want


def test_clashing_names(spark):
    x = spark.createDataFrame([rec(1), rec(2)], SCHEMA).selectExpr("*", "1 as _key", "2 as o", "3 as _v_kind", "4 as grant_vote")
    assert S.survivors(x).count() == 4 and S.golden_records(x).count() == 1


def test_golden_keeps_codes_of_the_family(spark):
    x = spark.createDataFrame([rec(1, kind="B1", cpc_codes="B;;A"), rec(2, cpc_codes="A;;C"), rec(3, None, cpc_codes="D")], SCHEMA)
    true = {r["value"] for r in S.true_values(x).collect()}
    got = {r["survivor_rec"]: r["cpc_codes"] for r in S.golden_records(x).collect()}
    assert got == {1: "A;;B;;C", 3: "D"} and true == {"A", "B", "C"}
