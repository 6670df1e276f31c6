"""Spelling variants against brute force over all pairs."""

from __future__ import annotations

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from gneiss.llm import variants


def brute_words(rows):
    seen = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= 7 and n >= 2}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    a, b = sorted((a, b), key=len)
    p = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[p:] == b[p + 1 :] if len(a) < len(b) else a[p + 1 :] == b[p + 1 :]


def brute(words, ratio=10):
    links, forms = Counter(), {}
    for w, v in itertools.permutations(words, 2):
        if near(w, v):
            links[w] += 1
            if (-words[v], v) < forms.get(w, (0, "")):
                forms[w] = (-words[v], v)
    forms = {w: (v, -n) for w, (n, v) in forms.items() if -n >= ratio * words[w]}
    out = {}
    for w, n in words.items():
        root = w
        while root in forms:
            root = forms[root][0]
        out[w] = (w, n, links[w], *forms.get(w, (None, None)), root)
    return out


def result(df):
    return {r["word"]: (r["word"], r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in df.collect()}


@pytest.mark.parametrize("group_rows", [4000, 3])
def test_equals_all_pairs(spark, group_rows):
    rng = random.Random(group_rows)
    base = ["".join(rng.choice("abcé") for _ in range(rng.randint(6, 11))) for _ in range(60)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "abababab", "babababa", "ÿÿÿÿÿÿÿ"]
    words = {}
    for w in base:
        words[w] = rng.choice([2, 3, 40, 900, 20_000])
        for _ in range(8):
            p = rng.randrange(len(w) + 1)
            v = rng.choice([w[:p] + w[p + 1 :], w[:p] + rng.choice("abcz") + w[p:], w[:p] + rng.choice("abcz") + w[p + 1 :]])
            words.setdefault(v, rng.choice([2, 2, 5, 50]))
    words = {w: n for w, n in words.items() if len(w) >= 7}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert result(variants.spelling_variants(df, group_rows=group_rows, bin_rows=200)) == brute(words)


def test_chains_of_forms_lead_to_one_root(spark):
    words = {"abcdefg": 2, "abcdefgh": 20, "abcdefghi": 300, "abcdefghij": 3000, "abcdefghik": 3000, "zzzzzzz": 5}
    got = result(variants.spelling_variants(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert got == brute(words) and got["abcdefg"][5] == "abcdefghij"  # of equals the first in order


def test_words_of_awkward_texts(spark, awkward, nothing):
    extra = [(900 + i, t, 1) for i, t in enumerate(["ÉCOLESÉ écolesé Écolesé", "x1abcdefg_ABCDEFG abcdefg×abcdefg", "abcdefg " * 50])]
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()] + [(i, t) for i, t, _ in extra]
    docs = awkward.select("doc_id", "text", "rep").union(spark.createDataFrame(extra, "doc_id long, text string, rep int").select("doc_id", "text", "rep"))
    words = variants.vocabulary(variants.letter_runs(docs))
    assert {r["word"]: r["n"] for r in words.collect()} == brute_words(rows)
    assert result(variants.spelling_variants(words)) == brute(brute_words(rows))
    none = variants.spelling_variants(variants.vocabulary(variants.letter_runs(nothing)))
    assert none.columns == ["word", "n", "n_near", "form", "form_n", "root"] and none.count() == 0


def test_the_acceptor_is_minimal_and_numbers_its_words():
    words = sorted(["".join(p) for k in (2, 3) for p in itertools.product("abc", repeat=k)] + ["abcc", "bbcc"])
    width = max(map(len, words))
    rows = np.zeros((len(words), width), np.int64)
    for i, w in enumerate(words):
        rows[i, : len(w)] = [ord(c) - 96 for c in w]
    a = variants.Acceptor(rows, np.array([len(w) for w in words]))
    languages = {}

    def language(s):
        return frozenset(([""] if a.final[s] else []) + [chr(96 + a.symbol[t]) + rest for t in range(a.first[s], a.first[s + 1]) for rest in language(a.to[t])])

    for s in range(len(a.final)):
        languages.setdefault(language(s), []).append(s)
    assert language(a.root) == frozenset(words) and all(len(v) == 1 for v in languages.values())
    for i, w in enumerate(words):
        s, at = a.root, 0
        for c in w:
            t = int(a.follow(np.array([s]), np.array([ord(c) - 96]))[0])
            s, at = a.to[t], at + a.skip[t]
        assert at == i


def test_large_partitions_are_cut(spark):
    words = [("abcdefg" + x + y + "hijklmn", 2) for x in "abcdefghij" for y in "abcdefghij"]
    rows = variants.keyed(spark.createDataFrame(words, "word string, n long"), 30)
    assert max(r["count"] for r in rows.where("b - a > 1").groupBy("key").count().collect()) <= 30
    single = [r["count"] for r in rows.where("b - a = 1").groupBy("key").count().collect()]
    assert max(single) == 100  # two letters that differ
