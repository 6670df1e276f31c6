"""The pipeline, stage by stage, against what its words say."""

from __future__ import annotations

import hashlib
import random
import re

import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    syllables = {"en": ["the", "ing", "er", "st", "on", "wh"], "de": ["sch", "ung", "ein", "ä", "ber", "ch"]}
    docs, labels = [], []
    for i in range(1200):
        lang = "en" if i % 3 else "de"
        text = ["".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(20, 60))]
        if i % 10 == 0:
            for _ in range(4):
                text.insert(rng.randrange(len(text)), "grmbl" + rng.choice(["a", "o", "uk"]))
        docs.append([i, " ".join(text), lang, f"s{i % 4}", 0])
        if i % 4:
            labels.append((i, 1, int(i % 10 == 0)))
    docs += [[3000 + i, docs[i + 1][1] + " tail", "en", "s1", 0] for i in range(8)] + [[4000, docs[1][1], None, None, 0], [4001, None, "en", "s0", 0], [4002, "12 34 !", "en", "s0", 0]]
    for d in docs:
        d[4] = len(d[1] or "")
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns = docs.columns
    stage = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "near_duplicates", "mixing", "sentencepiece"]

    kept = stage["toxicity"](spark, docs, corpus).cache()
    ids = {r["doc_id"] for r in kept.collect()}
    wanted = {r["doc_id"] for r in docs.collect() if "grmbl" not in (r["text"] or "")}
    assert kept.columns == columns
    assert len(ids ^ wanted) <= 4, sorted(ids ^ wanted)

    named = stage["language_id"](spark, kept, corpus).cache()
    rows = {r["doc_id"]: r for r in named.collect()}
    assert named.columns == columns and set(rows) == ids - {4001, 4002} and rows[4000]["lang"] in ("en", "de")

    single = stage["near_duplicates"](spark, named, corpus).cache()
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, r in rows.items() for w in [WORDS.findall(r["text"])]}
    gone = {b for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    assert single.columns == columns and {r["doc_id"] for r in single.collect()} == set(sets) - gone and 4000 in gone

    mixed = stage["mixing"](spark, single, corpus).cache()
    sizes, taken = {}, {}
    for r in single.collect():
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(WORDS.findall(r["text"]))
    for r in mixed.collect():
        taken[r["source"]] = taken.get(r["source"], 0) + len(WORDS.findall(r["text"]))
        assert r["n_chars"] == len(r["text"])
    assert mixed.columns == columns and sum(taken.values()) == pytest.approx(1.5 * sum(sizes.values()), abs=len(sizes))
    assert all(taken[s] <= 2 * sizes[s] for s in taken)

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = sorted((r["doc_id"], hashlib.sha256(" ".join(map(str, [*library.encode(r["text"]), library.eos_id()])).encode()).hexdigest()) for r in mixed.collect())
    assert sorted((r["doc_id"], r["ids_sha256"]) for r in stage["sentencepiece"](spark, mixed, corpus).collect()) == want


def test_stages_of_nothing(spark, corpus):
    none = spark.read.parquet(f"{corpus}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, corpus)
        assert out.count() == 0


def test_texts_in_no_learned_language_go(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").where("doc_id < 2000")
    strange = [
        (5000, "Это предложение написано на русском языке и не похоже на другие тексты.", "en"),
        (5001, "Kysymys on siitä, miten ihmiset voivat elää yhdessä rauhassa ja sovussa keskenään.", None),
        (5002, "xkq zvwpj qqzt bvnm wrtp kjhg zxcv mnbq plkj zzxq wvkp", "de"),
        (5003, "schung einung scheinber ungeinsch berchung einschung einber", "en"),
    ]
    more = spark.createDataFrame([(i, t, lang, "s0", len(t)) for i, t, lang in strange], docs.schema)
    got = {r["doc_id"]: r["lang"] for r in corpus_pipeline.language_id(spark, docs.union(more), corpus).collect()}
    assert {i for i in got if i >= 5000} == {5003} and got[5003] == "de"
    assert {i for i in got if i < 5000} == {r["doc_id"] for r in docs.collect()}
