import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import encode, packing

pytestmark = pytest.mark.skipif(not os.path.exists(f"{encode.TOKENIZERS}/{encode.DEFAULT}.tiktoken"), reason="no tokenizer files here")

TEXTS = [None, "", " ", "Hello world's  best\n\n\ttabs", "naïve café — “quotes” 中文字 ไทย हिन्दी العربية", "🧠👩‍🔬 ​ 　x\r\n", "<|endoftext|> plain", "x" * 20_000, "'S 'll don't 123,456.78 ½ ²", "a\u0085b c ﻿", "𝒳𝟙 Ⅷ", "same", "same"]


@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{encode.TOKENIZERS}/{encode.DEFAULT}.json")
    t.encode_special_tokens = True
    return t


def docs(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "extra") for i, t in enumerate(texts)], "doc_id long, text string, ids string")


def test_ids_and_round_trip(spark, reference):
    e = encode.encode(docs(spark))
    got = {r["doc_id"]: r["ids"] for r in e.collect()}
    assert got == {i: reference.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(TEXTS)}
    assert {r["doc_id"]: r["text"] for r in encode.decode(e).collect()} == {i: t or "" for i, t in enumerate(TEXTS)}
    assert {r["doc_id"]: r["n_tokens"] for r in encode.token_counts(docs(spark)).collect()} == {i: len(v) for i, v in got.items()}


def test_repeated_rows(spark):
    x = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, len(r["ids"])) for r in encode.encode(x).collect()) == [(0, 1), (1, 2), (1, 2)]


def test_no_documents(spark):
    x = docs(spark).limit(0)
    assert encode.encode(x).count() == 0 and packing.pack(encode.token_counts(x)).count() == 0


@settings(max_examples=6, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=25))
def test_any_text(spark, reference, texts):
    texts = [t.encode("utf-8", "ignore").decode().replace("\x00", "") for t in texts]
    got = {r["doc_id"]: r["ids"] for r in encode.encode(docs(spark, texts)).collect()}
    assert got == {i: reference.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120))
def test_plan(sizes):
    hist = np.bincount(sizes, minlength=41) if sizes else np.zeros(41, dtype=int)
    used = np.zeros(41, dtype=int)
    boxes = 0
    containers, fitted = packing.plan(hist)
    for items, n in containers:
        assert sum(items) <= 40 and n > 0
        boxes += n
        for x in items:
            used[x] += n
    assert (used == hist).all()
    assert 0 <= fitted <= boxes <= max(1, 11 / 9 * -(-sum(sizes) // 40) + 4)
    seen = set()
    for size, lo, hi, base, _slot, start in packing.rank_ranges(containers):
        assert start + size <= 40
        for r in range(lo, hi):
            assert (size, r) not in seen
            seen.add((size, r))
    assert len(seen) == len(sizes)


def test_patterns_are_all_combinations():
    got = packing.patterns(np.array([2, 3, 5]), 7)
    assert sorted(got) == [(2,), (2, 2), (2, 2, 2), (3,), (3, 2), (3, 2, 2), (3, 3), (5,), (5, 2)] and len(set(got)) == len(got)
    assert packing.patterns(np.array([2, 3, 5]), 7, 3) is None and packing.patterns(np.array([], dtype=int), 7) == []


def test_least_squares_is_not_negative_and_sparse():
    rng = np.random.default_rng(4)
    a = np.abs(rng.normal(size=(6, 200)))
    true = np.zeros(200)
    true[[3, 50, 120]] = (2.0, 5.0, 1.0)
    x = packing.repeat_counts(a, a @ true)
    assert (x >= 0).all() and (x > 0).sum() <= 6 and np.linalg.norm(a @ x - a @ true) < 1e-6
    b = rng.normal(size=6)  # no exact solution: the gradient shows that it is the least
    x = packing.repeat_counts(a, b)
    w = a.T @ (b - a @ x)
    assert (w <= 1e-6).all() and np.allclose(w[x > 0], 0, atol=1e-6)


@pytest.mark.parametrize("n", [3_000, 300_000])
def test_patterns_carry_the_plan(n):
    rng = np.random.default_rng(n)
    hist = np.bincount(np.exp(rng.normal(5.0, 1.2, n)).astype(int).clip(1, 2048), minlength=2049)
    containers, fitted = packing.plan(hist)
    boxes, least = sum(k for _, k in containers), -(-int((hist * np.arange(2049)).sum()) // 2048)
    assert boxes <= least + 1 and fitted >= 0.95 * boxes


def test_pack(spark):
    rng = np.random.default_rng(2)
    sizes = [None, 0, 2048, 5000, 4096, 1] + rng.integers(1, 1500, 400).tolist() + [700] * 300
    x = spark.createDataFrame([(i, int(s) if s is not None else None) for i, s in enumerate(sizes)], "doc_id long, n_tokens long")
    rows = packing.pack(x).collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert set(by) == set(range(len(sizes)))
    for i, s in enumerate(sizes):
        parts = sorted(by[i], key=lambda r: r["piece_no"])
        assert sum(p["n_tokens"] for p in parts) == (s or 0)
        assert len(parts) == max(1, -(-(s or 0) // 2048)) and (s or parts[0]["container_id"] is None)
        assert [p["piece_start"] for p in parts] == [2048 * k for k in range(len(parts))]
    boxes = {}
    for r in rows:
        if r["container_id"] is not None:
            boxes.setdefault(r["container_id"], []).append(r)
    assert set(boxes) == set(range(1, len(boxes) + 1))
    for b in boxes.values():
        b.sort(key=lambda r: r["start_pos"])
        at = 0
        for k, r in enumerate(b, 1):
            assert r["start_pos"] == at and r["slot"] == k
            at += r["n_tokens"]
        assert at <= 2048
    least = -(-sum(s or 0 for s in sizes) // 2048)
    pieces = [min(2048, s - k) for s in sizes for k in range(0, s or 0, 2048)]
    hist = np.bincount(pieces, minlength=2049)
    assert len(boxes) == sum(n for _, n in packing.plan(hist)[0]) <= 1.02 * sum(n for _, n in packing.fill([], hist))
    u = packing.usage(packing.pack(x)).first()
    assert u["least_containers"] == least and u["n_containers"] == len(boxes) and 0 < u["n_by_pattern"] <= len(boxes)
