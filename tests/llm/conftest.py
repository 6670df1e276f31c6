from __future__ import annotations

import random

import pytest


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with nulls, empty and long texts, copies, repeated rows and clashing extra columns."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    base = [" ".join(word() for _ in range(rng.randint(5, 80))) for _ in range(40)]
    texts = base + base[:5] + [b + " extra" for b in base[:10]] + [b.replace(" ", "  ") for b in base[:4]]
    texts += [None, "", "  \n\t ", "one", "one two", "a b c d e", "x " * 20_000, "y" * 50_000, "日本 語 ▁ mark", "<|endoftext|> tail", "q.\nq.\nq.\n" * 9]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s1", None]), len(t or ""), 1, "x", 0, 1.0) for i, t in enumerate(texts)]
    rows += rows[:2] + [(None, "null id text here now", "en", "s0", 3, 1, "x", 0, 1.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, rep long, signature string, size int, key double")


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)
