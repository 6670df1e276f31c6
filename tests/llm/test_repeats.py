"""Repeated strings against brute force over all positions."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from gneiss.llm import repeats


def brute(rows, length=100):
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for at in range(len(raw) - length + 1):
            s = raw[at : at + length]
            if s in seen:
                gone[at : at + length] = True
            seen.add(s)
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[i] = (len(raw), int(gone.sum()), runs, hashlib.sha256(raw[: len(raw)] if not gone.any() else np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def result(df):
    got = {}
    for r in df.collect():
        got.setdefault(r["doc_id"], set()).add((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]))
    assert all(len(v) == 1 for v in got.values())
    return {k: v.pop() for k, v in got.items()}


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(60) for _ in range(4)] + [prose(14) for _ in range(3)]
    out = []
    for _ in range(120):
        parts = [prose(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(passages), prose(rng.randint(0, 40))]
        out.append(" ".join(parts))
    out += [t[: len(t) // 2] + "#" + t[len(t) // 2 :] for t in out[:30]] + out[:10]
    out += ["=" * 5000, "=" * 99, "=" * 100, "ab" * 700, "xyz" * 40 + "q" + "xyz" * 40, None, "", "日本語の文章" * 60, passages[0][:100], passages[0][1:100], passages[5]]
    order = list(range(len(out)))
    rng.shuffle(order)
    return [(i, out[k]) for i, k in enumerate(order)]


@pytest.mark.parametrize("parts", [1, 7])
def test_equals_brute_force(spark, texts, parts):
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(parts)
    assert result(repeats.remove_repeats(df)) == brute(texts)


def test_other_lengths_and_small_batches(spark, texts):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
        assert result(repeats.remove_repeats(df, length=60)) == brute(texts, 60)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_long_texts_are_cut_alike(spark, texts, monkeypatch):
    rng = random.Random(9)
    monkeypatch.setattr(repeats, "CHUNK", 1000)
    half = "".join(rng.choice("abc ") for _ in range(3000))
    rows = [(1, half + "-" + half), (2, half[100:900] * 2)]
    import pyarrow as pa

    data, offsets = repeats.utf8(pa.array([t for _, t in rows]))
    whole = [(r, at) for r, (_, t) in enumerate(rows) for at in range(len(t) - 99)]
    doc, everything = np.array([5, 77]), np.full(repeats.FILTER_BITS // 8, 255, np.uint8)
    for rounds, span in enumerate(repeats.SPANS):
        found = list(repeats.units(data, offsets, doc, 100, [everything] * rounds))
        assert sorted((int(r), int(s) + k) for row, start, count, _, _ in found for r, s, c in zip(row, start, count, strict=True) for k in range(c)) == whole
        assert max(int(f[2].max()) for f in found) <= span
    # What a row is cut into does not depend on the rows beside it.
    alone = [f for r in (0, 1) for f in repeats.units(*repeats.utf8(pa.array([rows[r][1]])), doc, 100, [])]
    together = list(repeats.units(data, offsets, doc, 100, []))
    assert sorted(zip(*(np.concatenate([f[c] for f in alone]).tolist() for c in (3, 4)), strict=True)) == sorted(zip(*(np.concatenate([f[c] for f in together]).tolist() for c in (3, 4)), strict=True))
    assert result(repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_repeated_rows_and_ids(spark):
    rng = random.Random(5)
    a, b = ("".join(rng.choice("abcdefgh ") for _ in range(400)) for _ in range(2))
    rows = [(3, a, 1), (3, a, 2), (5, a + b, 1), (5, b, 1), (None, b, 1), (None, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, doc int").repartition(3)
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in repeats.remove_repeats(df).collect()), key=repr)
    assert got == sorted([(3, 400, 0), (3, 400, 0), (5, 800, 800), (5, 400, 400), (None, 400, 0), (None, 0, 0)], key=repr)


def test_awkward_and_empty(spark, awkward, nothing):
    got = repeats.remove_repeats(awkward, keep_text=True).collect()
    assert len(got) == awkward.count() and all(len(r["kept"]) == r["n_bytes"] - r["n_removed"] for r in got)
    none = repeats.remove_repeats(nothing)
    assert none.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] and none.count() == 0


def test_anchors_depend_on_their_strings_alone():
    rng = np.random.default_rng(6)
    data = rng.integers(97, 101, 5000).astype(np.uint8)
    values = repeats.Strings(data).of(np.arange(4961), np.arange(40, 5001))
    places = repeats.least_places(values, 61)
    assert all(places[i] == i + int(values[i : i + 61].argmin()) for i in range(0, 4900, 7))
