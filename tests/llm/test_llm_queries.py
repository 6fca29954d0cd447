import glob
import os

import pytest

from corpusloom.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, data, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    rel = con.sql(ORACLES[name])
    df = QUERIES[name](spark, data)
    want = sorted(tuple(r) for r in rel.fetchall())
    assert sorted(df.columns) == sorted(rel.columns)
    assert sorted(tuple(r[c] for c in rel.columns) for r in df.collect()) == want


@pytest.fixture
def rows(spark, data):
    """Rows of a query, and of a table."""
    return lambda name: [r.asDict() for r in QUERIES[name](spark, data).collect()], lambda name: [r.asDict() for r in spark.read.parquet(f"{data}/{name}.parquet").collect()]


def test_p1(rows):
    query, table = rows
    known, labels = {r["arch_id"] for r in table("architecture_ref")}, {r["label_id"]: r["architecture"] for r in table("validation_labels")}
    found = {r["label_id"]: r["arch_id"] for r in query("p1_found")}
    assert set(found.values()) <= known | {0} and set(found) < set(labels) and all((labels[i] or "").strip() for i in found)
    exact = {r["arch_name"]: r["arch_id"] for r in table("architecture_ref")}
    assert all(found[i] == exact[v] for i, v in labels.items() if v in exact)
    assert sum(r["n_rows"] for r in query("p1_unmatched")) == sum(v == 0 for v in found.values())


def test_p2(rows):
    query, table = rows
    recs = {r["rec_id"]: r for r in table("stage1_corpus")}
    golden = {r["survivor_rec"]: r for r in query("p2_golden")}
    assert sum(r["n_records"] for r in golden.values()) == len(recs)
    for r in query("p2_found"):
        if r["field_name"] != "cpc_codes":
            assert golden[r["survivor_rec"]][r["field_name"]] == recs[r["from_rec"]][r["field_name"]] and golden[r["survivor_rec"]]["n_records"] > 1
    assert len(query("p2_witnesses")) == 4 and all(0.5 < r["sensitivity"] < 1 and 0.5 < r["specificity"] < 1 for r in query("p2_witnesses"))
    j = query("p2_judgements")[0]
    assert j["n_records"] == len(recs) and j["n_differ"] == 0 < j["n_model"] < len(recs)
    codes = query("p2_true_codes")
    assert codes and all(r["posterior"] > 0.5 and r["n_for"] > 0 for r in codes) and len({(r["family_key"], r["value"]) for r in codes}) == len(codes)


def test_p4(rows):
    query, table = rows
    items = {r["publication_number"] for r in table("validation_labels")}
    found = query("p4_found")
    assert found and {r["publication_number"] for r in found} <= items and {r["consensus"] for r in found} == {"Y", "N"} and len({r["publication_number"] for r in found}) == len(found)
    people = query("p4_annotators")
    assert 0 < len(people) <= 14 and all(0 < r["reliability"] < 1 for r in people)


def test_p6(rows):
    query, table = rows
    texts = {r["doc_id"]: r["text"] for r in table("documents")}
    ids = {r["doc_id"]: r["ids"] for r in query("p6_ids")}
    assert set(ids) == set(texts) and all((not ids[k]) == (not v) for k, v in texts.items())


def test_p7(rows):
    query, _ = rows
    packed, ids = query("p7_packed"), {r["doc_id"]: len(r["ids"]) for r in query("p6_ids")}
    size, box = dict.fromkeys(ids, 0), {}
    for r in packed:
        size[r["doc_id"]] += r["n_tokens"]
        if r["container_id"] is not None:
            box.setdefault(r["container_id"], []).append((r["start_pos"], r["n_tokens"]))
    assert size == ids
    for parts in box.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(parts[-1]) <= 2048
    u = query("p7_usage")[0]
    assert u["n_containers"] == len(box) == u["least_containers"] and u["n_by_pattern"] >= 0.5 * len(box)  # of a dozen; whole tables: nearly all


def test_p8(rows):
    query, table = rows
    spans: dict = {}
    for r in query("p8_found"):
        spans.setdefault(r["doc_id"], []).append((r["start_pos"], r["end_pos"]))
    for d in table("documents"):
        t, at = d["text"] or "", 0
        for a, b in sorted(spans.get(d["doc_id"], [])):
            assert at <= a < b <= len(t) and t[a:b] == t[a:b].strip() and not t[at:a].strip()
            at = b
        assert not t[at:].strip()
