"""Each operator against a brute-force twin, and on awkward and empty tables."""

from __future__ import annotations

import base64
import gzip
import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gneiss.llm import language, maintext, mixing, near, pieces, rules, textbytes, tokens, topk, toxicity, warc

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
BPE, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def brute_links(rows, threshold=0.8):
    sets = {}
    for i, t in rows:
        w = WORDS.findall(t or "")
        if w and i is not None:
            sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    links, root = Counter(), {i: i for i, _ in rows}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold:
                links[a] += 1
                links[b] += 1
                root[max(top(a), top(b))] = min(top(a), top(b))
    return {i: (top(i), links[i]) for i in root}


def test_near_equals_brute_force(awkward):
    once = awkward.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in near.near_duplicates(once).collect()}
    assert got == brute_links(rows_of(once))


def test_near_splits_large_groups_alike(awkward):
    once = awkward.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in near.near_duplicates(once, block_rows=2).collect()}
    assert got == brute_links(rows_of(once))


def test_near_awkward_and_empty(awkward, nothing):
    got = near.near_duplicates(awkward).collect()
    assert len(got) == awkward.count()
    assert [tuple(r) for r in got if r["doc_id"] is None] == [(None, None, 0)]
    assert next(r["n_links"] for r in got if r["doc_id"] == 0) >= 2  # a repeated row counts as a copy
    assert near.near_duplicates(nothing).count() == 0
    kept = near.drop_near_duplicates(awkward)
    assert kept.columns == awkward.columns and kept.where("doc_id IS NULL").count() == 1
    assert near.drop_near_duplicates(nothing).count() == 0


def test_texts_under_one_id_or_none_are_linked_each(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " x"), (None, c), (None, c), (None, c + " x"), (None, a), (5, d), (None, ""), (6, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((tuple(r) for r in near.near_duplicates(df).collect()), key=repr)
    want = [(1, 1, 2), (1, 1, 1), (2, 1, 2), (3, 1, 1), *[(None, None, 2)] * 3, (None, 1, 2), (5, 5, 0), (None, None, 0), (6, 6, 0)]
    assert got == sorted(want, key=repr)
    kept = [(r["doc_id"], r["text"]) for r in near.drop_near_duplicates(df).collect()]
    rest = [x for x in kept if x[1] not in (c, c + " x")]
    assert sorted(rest, key=repr) == sorted([(1, a), (1, b), (5, d), (None, ""), (6, "")], key=repr) and len(kept) == 6


def test_the_filter_keeps_every_wanted_key(spark, monkeypatch):
    monkeypatch.setattr(near, "FILTER_BITS", 1 << 17)
    rows = spark.range(20_000).select(F.xxhash64("id").alias("f"), "id")
    wanted = rows.where("id % 7 = 0").select(F.col("f").alias("g"))
    got = {r["id"] for r in near._maybe_in(rows, "f", wanted, "g").collect()}
    assert got >= set(range(0, 20_000, 7)) and len(got) < 4_000
    assert near._maybe_in(rows, "f", wanted.limit(0), "g").count() == 0


def test_mixed_rows_of_one_id_keep_their_own_size(spark):
    rows = [(k, " ".join(f"w{n}" for _ in range(n)), "s") for n in (3, 40, 200) for k in (None, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = Counter()
    for r in mixing.mix(df).collect():
        want[r["doc_id"], r["size"]] += r["taken"]
    got = Counter()
    for r in mixing.mixed_documents(df).collect():
        words = r["text"].split()
        got[r["doc_id"], int(words[0][1:])] += len(words)
    assert got == +want


def test_pruning_keeps_what_may_reach_the_threshold():
    fewest = near.least_matches(0.8, 1e-7)
    assert list(fewest) == sorted(fewest) and fewest[0] <= 4 and 80 < fewest[-1] < 128


def test_word_hashes_see_words_only():
    import pyarrow as pa

    texts = ["a bb  a", "", "bb\na", None, "x" * (3 << 20), " lead a", "é é"]
    codes, rows = textbytes.word_hashes(*textbytes.utf8(pa.array(texts)))
    words = [WORDS.findall(t or "") for t in texts]
    assert np.diff(rows).tolist() == [len(w) for w in words]
    flat = [w for ws in words for w in ws]
    assert len(set(zip(flat, codes.tolist(), strict=True))) == len(set(flat)) == len(set(codes.tolist()))


def test_minhash_estimates_jaccard():
    rng = np.random.default_rng(1)
    shared, a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (800, 100, 100))
    both = np.concatenate([shared, a, shared, b])
    s = near.minhash(both, np.array([0, 900, 1800]))
    assert abs((s[0] == s[1]).mean() - 0.8) < 0.12


def test_token_counts_equal_the_library(awkward, nothing):
    library = Tokenizer.from_file(BPE)
    got = Counter(map(tuple, tokens.count_tokens(awkward, BPE, part_bytes=1000).collect()))
    want = Counter()
    for i, t in rows_of(awkward):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want[(i, len((t or "").encode()), n, n > 2048)] += 1
    assert got == want
    assert tokens.count_tokens(nothing, BPE).count() == 0


ODD = [*"abcSsté.,!'~ \n\t日本😀<>Σσ", "  ", "İ", "İ.", "\u0301", "\u0307", "ﬁ", "<|endoftext|>", "<|ENDOFTEXT|>", "\xa0", "\x85", "\u2028", "\x1c", "한", "\u1112", "\u1161", "'s", "Ⅷ", "▁", "</s>", "<0x0A>", "\x00"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_parts_count_like_whole_texts(name):
    rng = np.random.default_rng(5)
    path = public_tokenizers.path(name)
    counter = tokens.TextCounter(path)
    assert counter.cuts == name.endswith(".json")
    library = Tokenizer.from_file(path) if counter.cuts else sentencepiece.SentencePieceProcessor(model_file=path)
    count = (lambda t: len(library.encode(t, add_special_tokens=False).ids)) if counter.cuts else (lambda t: len(library.encode(t)))
    texts = ["".join(rng.choice(ODD, rng.integers(0, 40))) for _ in range(4000)] + ["GALATASARAYİ, ve", "AKSARAYİ!", "Don't. it's a1. 3.14, x~ ~ ~~", "x" * 5000]
    for at in range(0, len(texts), 50):
        part = texts[at : at + 50]
        assert counter.counts([t.encode() for t in part], 1 + at % 12) == [count(t) for t in part]


def test_texts_are_cut_only_where_the_rules_allow_it():
    ok = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
    assert tokens._keeps_boundaries(ok) and tokens._keeps_boundaries(None)
    for kind in ({"type": "Strip"}, {"type": "Prepend", "prepend": "▁"}, {"type": "Replace", "pattern": {"String": " "}, "content": "▁"}):
        assert not tokens._keeps_boundaries(kind) and not tokens._keeps_boundaries({"type": "Sequence", "normalizers": [kind]})
    split = lambda regex, behavior="Removed", invert=True: {"type": "Split", "pattern": {"Regex": regex}, "behavior": behavior, "invert": invert}
    assert tokens._parts_at_boundaries(split(r"'s|[\p{L}]+|[^\s\p{L}\p{N}]+"))
    for part in (split(r"\p{L}+ ?"), split(r"\S+\s*"), split(r"[^a]+"), split(r"a.b"), split(r"\p{L}+", "Isolated", False), {"type": "Metaspace"}, None):
        assert not tokens._parts_at_boundaries(part)


def test_long_texts_are_parted_in_balance():
    text = b"some words of a text. " * 1000
    groups = list(tokens.balanced([text, b"", b"tail"], 1000))
    assert b"".join(p for g in groups for r, p in g if r == 0) == text and groups[-1][-1] == (2, b"tail")
    assert max(sum(len(p) for _, p in g) for g in groups) < 1010
    assert [len(p) for g in tokens.balanced([b"y" * 5000], 1000) for _, p in g] == [5000]


def test_a_word_is_encoded_once(monkeypatch):
    library = Tokenizer.from_file(BPE)
    counter, encoded = tokens.TextCounter(BPE), []
    whole = counter.lengths
    counter.lengths = lambda texts: encoded.extend(texts) or whole(texts)
    texts = ["Le café est là, où  le café était.\n", "the café\t", "y" * 100 + " café est"] * 40
    want = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert counter.counts([t.encode() for t in texts], 1 << 16) == want
    assert len(encoded) == len(set(encoded)) and {" café".encode(), b" est"} <= set(encoded)
    assert sum(map(len, encoded)) < 200 and max(map(len, counter.known)) <= tokens.LONGEST_WORD
    monkeypatch.setattr(tokens, "MOST_WORDS", 3)  # what is known is forgotten again and again
    assert counter.counts([t.encode() for t in texts], 1) == want and len(counter.known) <= 3


def test_words_lie_between_boundaries():
    rng = np.random.default_rng(8)
    for _ in range(20_000):
        text = "".join(rng.choice(ODD, rng.integers(0, 14))).encode()
        assert tokens.WORD.findall(text) == [x for x in tokens.BOUNDARY.split(text) if x]


def test_pieces_equal_the_library(awkward, nothing):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = pieces.encode_pieces(awkward.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), PIECES).collect()
    texts = dict(rows_of(awkward))
    for r in got:
        text = texts[r["doc_id"]] or ""
        ids = [*library.encode(text), library.eos_id()]
        assert r["ids"] == ids and r["decoded"] == library.decode(ids)
        assert r["bounds"][0] == 0 and r["bounds"][-1] == len(text.encode()) and len(r["bounds"]) == len(ids) + 1
    assert pieces.encode_pieces(nothing, PIECES).count() == 0
    one = pieces.digests(pieces.encode_pieces(awkward.where("text = ''").limit(1), PIECES)).first()
    assert (one["n_tokens"], one["ids_sha256"], one["decoded_sha256"]) == (1, hashlib.sha256(b"2").hexdigest(), hashlib.sha256(b"").hexdigest())


@pytest.mark.parametrize("text", ["plain words", " lead  two ", "a\nb \n c", "▁ mark▁ é 日", "😀 x", "<0x0A> </s>", "  ", "\n\n"])
def test_bounds_follow_the_library_offsets(text):
    check_bounds(pieces.PieceEncoder(PIECES), text)


def test_bounds_of_odd_texts():
    encoder, rng = pieces.PieceEncoder(PIECES), np.random.default_rng(6)
    for _ in range(3000):
        check_bounds(encoder, "".join(rng.choice(ODD, rng.integers(0, 30))))


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
def test_pieces_behind_a_character_map_are_projected(rule, monkeypatch):
    """A model with the map of another: bounds part the source where its characters part."""
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    from sentencepiece import sentencepiece_model_pb2

    encoder, proto, own = pieces.PieceEncoder(PIECES), sentencepiece_model_pb2.ModelProto(), sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(library.serialized_model_proto())
    with open(PIECES, "rb") as f:
        own.ParseFromString(f.read())
    own.normalizer_spec.precompiled_charsmap = proto.normalizer_spec.precompiled_charsmap
    encoder.library = sentencepiece.SentencePieceProcessor(model_proto=own.SerializeToString())
    encoder.normaliser = pieces.Normaliser(own.normalizer_spec)
    for text in ["ﬁne ①② ＡＢＣ tail", "é é x", " a   b ", "㌔ 株式会社", "plain", ""]:
        ids, bounds = encoder.encode([text.encode()])[0]
        assert bounds.tolist() == sorted(bounds.tolist()) and len(bounds) == len(ids) + 1 and bounds[-1] == len(text.encode())
    text = "ﬁne ＡＢ tail"
    ids, bounds = encoder.encode([text.encode()])[0]
    parts = [(encoder.library.id_to_piece(int(i)), text.encode()[a:b].decode()) for i, a, b in zip(ids, bounds[:-1], bounds[1:], strict=True)]
    assert "".join(s for _, s in parts) == text and parts[-1][1].strip() == parts[-1][0].strip("▁")


def check_bounds(encoder, text):
    ids, bounds = encoder.encode([text.encode()])[0]
    proto = encoder.library.encode(text, return_type="proto").pieces
    assert [p.id for p in proto] == ids.tolist()
    assert bounds[0] == 0 and bounds[-1] == len(text.encode())
    for p, begin, end in zip(proto, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if not p.piece.startswith("<0x") and p.surface:
            assert (begin, end) == (p.begin, p.end) and text.encode()[begin:end].decode() == p.surface


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
def test_character_map_normalises_like_the_library(rule):
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(library.serialized_model_proto())
    spec = proto.normalizer_spec
    ours = pieces.Normaliser(spec)
    for text in ["ﬁne ①② ＡＢＣ", "é é x", " a   b ", "㌔ 株式会社", "plain", ""]:
        normal, begins, ends = ours.normalise(text.encode())
        assert normal.decode() == library.normalize(text), text
        assert begins.tolist() == sorted(begins.tolist()) and all(0 <= b <= e <= len(text.encode()) for b, e in zip(begins, ends, strict=True))


def brute_top(vectors, query, own, k):
    scores = sorted((-sum(int(a) * int(b) for a, b in zip(query, v, strict=True)), i) for i, v in vectors if i != own)
    return [(-s, i) for s, i in scores[:k]]


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 6)]) for i in range(150)] + [(200 + i, [0.5] * 6) for i in range(9)] + [(400, [0.0] * 6)]
    bad = [(500, None), (550, [0.1, None, 0.1, 0.1, 0.1, 0.1]), (600, [float("nan")] * 6), (650, [float("inf")] + [0.0] * 5), (None, [0.1] * 6)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    got = defaultdict(list)
    for r in topk.top_k(df, F.col("vec_id") % 50 == 0, block_rows=40, query_rows=2).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["score"], r["vec_id"]))
    assert dict(got) == {i: brute_top(whole, v, i, 5) for i, v in whole if i % 50 == 0}
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_of_ragged_vectors_repeated_ids_and_clashing_columns(spark):
    rng = np.random.default_rng(4)
    rows = [(i % 90, [float(x) for x in rng.normal(0, 0.3, rng.integers(0, 7))], i, i, "q", None) for i in range(140)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id long, v long, q string, b string")
    whole = [(r[0], [math.floor(256 * x) for x in r[1]]) for r in rows]
    got = defaultdict(list)
    for r in topk.top_k(df.where("vec_id <> 0 OR id = 0"), F.col("vec_id") % 50 == 0, block_rows=20, list_rows=7).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["score"], r["vec_id"]))
    whole = [x for k, x in enumerate(whole) if x[0] or not k]
    want = {}
    for own in (0, 50):  # rows of one id pool their hits
        scores = [(-sum(a * b for a, b in zip(q, v, strict=False)), i) for j, q in whole if j == own for i, v in whole if i != own]
        want[own] = [(-s, i) for s, i in sorted(scores)[:5]]
    assert set(got) == {0, 50} and got[0] == want[0] and got[50] == want[50]


def test_large_components_are_exact(spark):
    rows = [(i, [float(2**40 + i), 1.0, -float(2**39)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, scale=2.0**-10).orderBy("query_id", "rank").collect()
    whole = [(i, [math.floor(2.0**-10 * x) for x in v]) for i, v in rows]
    want = [(i, rank, j, s) for i, v in whole if i % 50 == 0 for rank, (s, j) in enumerate(brute_top(whole, v, i, 5), 1)]
    assert [tuple(r) for r in got] == want


def test_threshold_algorithm_stops_early():
    rng = np.random.default_rng(3)
    v = rng.integers(-50, 50, (4000, 3)).astype(float)
    lists, scored = topk.SortedLists(np.arange(4000), v), []

    class Counted(np.ndarray):
        def __getitem__(self, key):
            scored.append(np.size(key))
            return np.asarray(self)[key]

    lists.vectors = lists.vectors.view(Counted)
    for query in ([3.0, -2.0, 0.0], [0.0, 0.0, 0.0], [1.0, 1.0, 1.0]):
        ids, scores = [np.zeros(0, np.int64)], [np.zeros(0)]
        scored.clear()
        lists.search(np.array([query]), np.array([-1]), 5, ids, scores)
        assert [(int(s), int(r)) for s, r in zip(scores[0], ids[0], strict=True)] == brute_top(list(enumerate(v)), query, -1, 5)
        assert not any(query) or sum(scored) < 2000
        scored.clear()  # with these scores the same block again has nothing to give
        lists.search(np.array([query]), np.array([-1]), 5, ids, [scores[0] + 1000])
        assert not sum(scored)


def test_archives_round_trip(spark, tmp_path):
    pages = [(1, "http://a/x", "<p>one</p>"), (2, "http://b", "<p>one</p>"), (3, None, None), (4, "u\r\nv", ""), (5, "http://c", "a\r\n\r\nb é"), (5, "http://c", "again"), (None, "http://n", "nul")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    out = f"file://{tmp_path}/warc"
    got = warc.through_archives(df, out, with_payload=True).collect()
    digest = lambda s: base64.b32encode(hashlib.sha1((s or "").encode()).digest()).decode()
    want = sorted(
        [(1, 10, digest("<p>one</p>"), "revisit", 2), (2, 10, digest("<p>one</p>"), "response", None), (3, 0, digest(""), "revisit", 4), (4, 0, digest(""), "response", None),
         (5, len("a\r\n\r\nb é".encode()), digest("a\r\n\r\nb é"), "response", None), (5, 5, digest("again"), "response", None), (None, 3, digest("nul"), "response", None)],
        key=repr,
    )
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=repr) == want
    assert {r["payload"] for r in got if r["record_type"] == "response"} == {b"<p>one</p>", b"", "a\r\n\r\nb é".encode(), b"again", b"nul"}
    for archive in (tmp_path / "warc" / "records").glob("*.warc.gz"):
        raw = archive.read_bytes()
        for line in archive.with_name(archive.name.replace(".warc.gz", ".idx")).read_text().splitlines():
            offset, length = map(int, line.split()[:2])
            assert gzip.decompress(raw[offset : offset + length]).startswith(b"WARC/1.1")
    assert warc.through_archives(df.limit(0), f"file://{tmp_path}/none").count() == 0


def test_archives_of_long_pages_with_clashing_columns(spark, tmp_path):
    long = "<p>é " + "x" * 3_000_000 + "</p>"
    rows = [(i, "http://a", h, 7, "d", 1, "v", 0) for i, h in ((1, long), (2, long), (2, long), (3, "s"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, page int, digest string, latest int, value string, offset int")
    got = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.through_archives(df, f"file://{tmp_path}/w").collect()), key=repr)
    n = len(long.encode())
    assert got == [(1, n, "revisit", 2), (2, n, "response", None), (2, n, "response", None), (3, 1, "response", None)]


def test_a_payload_below_the_least_size_is_its_own(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "xx"), (2, "b", "xx")], "page_id long, url string, html string")
    assert {r["record_type"] for r in warc.through_archives(df, f"file://{tmp_path}/w", least_bytes=3).collect()} == {"response"}


def test_mix_meets_its_targets(spark, awkward, nothing):
    got = mixing.mix(awkward).collect()
    assert len(got) == awkward.count()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix(awkward.repartition(7)).collect()), key=repr)
    sources = defaultdict(lambda: [0, None, None])
    names = {r["doc_id"]: r["source"] for r in awkward.collect()}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        s = sources[names[r["doc_id"]]]
        s[0], s[1], s[2] = s[0] + r["taken"], r["target"], r["source_size"]
    for taken, target, size in sources.values():
        assert abs(taken - target) <= 0.5 + 1e-6 and target <= 2 * size + 1e-6
    assert sum(s[1] for s in sources.values()) == pytest.approx(1.5 * sum(s[2] for s in sources.values()), abs=1e-3)
    assert mixing.mix(nothing).count() == 0


def test_targets_stop_at_the_cap_and_go_to_the_others(spark):
    sizes = [("a", 10), ("b", 1000), (None, 500), ("c", 300)]
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
    total, weight, cap, open_ = 1.5 * 1810, {"a": 5, "b": 2, "c": 1, None: 5}, {s: 2 * n for s, n in sizes}, {s for s, _ in sizes}
    want = {}
    while True:  # as the words say: cut at the cap, share what is over
        level = (total - sum(want.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > cap[s]}
        if not over:
            break
        want |= {s: cap[s] for s in over}
        open_ -= over
    want |= {s: level * weight[s] for s in open_}
    assert got == pytest.approx(want)


def test_mix_does_not_depend_on_strata_and_constant_qualities(spark):
    """A low quality for all shifts all keys alike; strata are only a way to find the end of the budget."""
    rows = [(i, "word " * (1 + i % 7), "ab"[i % 3 == 0]) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = sorted(map(tuple, mixing.mix(df).collect()))
    assert sum(r[1] < r[4] < 2 * r[1] for r in want) <= 2  # each source's budget ends in one document at most
    for options in ({"strata": 1}, {"strata": 1 << 16}, {"quality": mixing.F.lit(0.01)}, {"quality": mixing.F.lit(50.0)}):
        assert sorted(map(tuple, mixing.mix(df, **options).collect())) == want
    worthless = mixing.F.when(mixing.F.col("doc_id") < 300, 1.0)
    got = {r["doc_id"]: r["taken"] for r in mixing.mix(df, quality=worthless, share=0.5).collect()}
    assert len(got) == 400 and not any(got[i] for i in range(300, 400))


def test_mixed_documents_take_the_words_of_the_mix(spark, awkward):
    unique = awkward.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(unique).collect() if r["taken"]}
    words = Counter()
    for r in mixing.mixed_documents(unique).collect():
        words[r["doc_id"]] += len(WORDS.findall(r["text"]))
    assert dict(words) == taken


def brute_measures(text):
    w = WORDS.findall(text or "")
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    times = Counter(windows)
    covered = {j for i, x in enumerate(windows) if times[x] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_measures_equal_brute_force(spark, awkward, nothing):
    labels = spark.createDataFrame([(0, 1), (1, 0), (None, 1), (2, None)], "doc_id long, quality int")
    got = rules.quality_rules(awkward, labels).collect()
    want = {i: brute_measures(t) for i, t in rows_of(awkward)}
    assert len(got) == awkward.count()
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want[r["doc_id"]]
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert r["kept"] == (not r["base_failed"])  # too few labels for any cutoff
    assert rules.quality_rules(nothing, labels.limit(0)).count() == 0


def test_binomial_tail_is_exact(spark):
    rows = [(k, n) for n in (1, 10, 400, 3000) for k in (0, 1, 5, 40) if k <= n]
    got = spark.createDataFrame(rows, "k long, n long").select("k", "n", rules.binomial_tail(F.col("k"), F.col("n"), 0.02).alias("p")).collect()
    for r in got:
        want = 1.0 if r["k"] >= r["n"] else sum(math.exp(math.lgamma(r["n"] + 1) - math.lgamma(i + 1) - math.lgamma(r["n"] - i + 1) + i * math.log(0.02) + (r["n"] - i) * math.log(0.98)) for i in range(r["k"] + 1))
        assert r["p"] == pytest.approx(want, rel=1e-9)


def test_cutoffs_keep_the_risk(spark):
    rows = [(i, "x", 1, 100, 0 if i % 100 else 30, 10, 0, 0, 1000, i) for i in range(4000)] + [(9000 + i, "x", 0, 100, 60, 10, 0, 0, 1000, i) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, s string, g int, n_words long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, word_chars long, junk long")
    got = {r["rule"]: r["cutoff"] for r in rules.risk_cutoffs(df, "s", "g", risk=0.02).collect()}
    assert 0.03 <= got["symbols"] < 0.06 and "repeats" not in got


def test_toxic_words_are_learned_from_positives(spark, nothing):
    import random

    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "tu", "se", "ra"]) for _ in range(3))
    docs, labels = [], []
    for i in range(1200):
        text = [word() for _ in range(rng.randint(10, 60))]
        toxic = i % 8 == 0
        if toxic:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), "vrgh" + rng.choice(["en", "a", "osk", "um"]))
        docs.append((i, " ".join(text)))
        if i % 3:
            labels.append((i, int(toxic)))
    docs += [(9000, None), (9001, ""), (None, "kalo")]
    df, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.held_out_toxicity(df, lab).collect()
    assert len(got) == len(docs)
    right = [r["predicted"] == int(r["row"]["doc_id"] % 8 == 0) for r in got if r["row"]["doc_id"] is not None and r["row"]["doc_id"] < 9000]
    assert sum(right) / len(right) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.held_out_toxicity(df.limit(0), lab).count() == 0
    assert {r["score"] for r in toxicity.held_out_toxicity(df, lab.limit(0)).collect()} == {0.0}


def test_scores_do_not_depend_on_how_rows_are_dealt_out(spark, tmp_path):
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "tu", "se", "ra"], 4))
    texts = [" ".join(word() for _ in range(20)) + (" vrghen" if i % 7 == 0 else "") for i in range(700)]
    rows = [(i, t, "x", 1.0) for i, t in enumerate(texts)]
    rows += rows[:50] + [(9000, "lokatu " * 30_000, "x", 1.0), (9001, None, "x", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string, score double")  # names that the operator uses itself
    lab = spark.createDataFrame([(i, int(i % 7 == 0)) for i in range(700) if i % 2] * 2, "doc_id long, toxic int")
    once, again = (sorted((r["row"]["doc_id"], r["score"]) for r in toxicity.held_out_toxicity(df.repartition(n), lab.repartition(n)).collect()) for n in (1, 7))
    assert once == again and len(once) == len(rows) and len({s for _, s in once}) > 1


def test_every_positive_of_a_family_is_counted(spark):
    # Unrelated texts with one common word of a low hash, then copies and near copies of one text.
    least = min((f"w{'abcdefghij'[i // 10]}{'abcdefghij'[i % 10]}" for i in range(100)), key=toxicity.xxhash.xxh3_64_intdigest)
    apart = [f"{least} {' '.join('qrstuvwxyz'[i] * 3 + 'qrstuvwxyz'[j] * 2 for j in range(10))} vrghen" for i in range(10)]
    long = " ".join(f"{'abcdefghij'[i // 10] * 3}{'klmnopqrst'[i % 10] * 3}" for i in range(100))
    near_copy = long.replace(max(long.split(), key=toxicity.xxhash.xxh3_64_intdigest), "")
    rows = [(t,) for t in [*apart, long, long, near_copy]]
    texts = spark.createDataFrame(rows, "text string").repartition(5)
    counted, voters = toxicity.support(texts, texts)
    got = {r["feature"]: (r["up"], r["down"]) for r in counted.collect()}
    brute = {}
    for (t,) in rows:
        for f in toxicity.features_of(toxicity.words_of(t)):
            brute.setdefault(f, []).append(toxicity._family(toxicity.words_of(t)))
    assert voters == 11 and got == {f: (len(set(x)), len(x)) for f, x in brute.items()}
    assert got["vrghen$#1"] == (10, 10)


def brute_bits(trees_counts, langs, data):
    """Code length of bytes by walking the contexts from the longest down."""
    bits = np.zeros(len(langs))
    for l in range(len(langs)):
        tree = trees_counts[l]
        for i in range(len(data)):
            for n in range(min(language.ORDER - 1, i), -1, -1):
                context = data[i - n : i]
                seen = tree.get(context)
                if not seen:
                    continue
                total, kinds = sum(seen.values()), len(seen)
                if data[i] in seen:
                    bits[l] += math.log2((total + kinds) / seen[data[i]])
                    break
                bits[l] += math.log2((total + kinds) / kinds)
            else:
                bits[l] += 8
    return bits


def test_code_lengths_equal_a_walk_down_the_contexts(spark):
    import pyarrow as pa

    texts = {"a": ["the cat sat on the mat", "then that"], "b": ["el gato se sento", "la mesa el"]}
    langs = sorted(texts)
    trees, counts = [], {}
    for lang in langs:
        tree = defaultdict(Counter)
        for t in texts[lang]:
            raw = bytes(language.fold(np.frombuffer(t.encode(), np.uint8)))
            for i in range(len(raw)):
                for n in range(min(language.ORDER - 1, i) + 1):
                    tree[raw[i - n : i]][raw[i]] += 1
        trees.append(tree)
    for n in range(1, language.ORDER + 1):
        grams = Counter()
        for l, tree in enumerate(trees):
            for context, seen in tree.items():
                if len(context) == n - 1:
                    for byte, c in seen.items():
                        grams[(int.from_bytes(context + bytes([byte]), "big"), l)] += c
        keys = np.array(sorted({k for k, _ in grams}), np.int64)
        counts[n] = keys, np.array([[grams[(k, l)] for l in range(2)] for k in keys.tolist()], float)
    model = language.ContextTrees(langs, counts)
    tests = ["the gato", "zzz q", "mat", ""]
    data, offsets = textbytes.utf8(pa.array(tests))
    got = model.lengths(language.fold(data), offsets[:-1][offsets[:-1] < len(data)])
    for k, t in enumerate(tests):
        want = brute_bits(trees, langs, bytes(language.fold(np.frombuffer(t.encode(), np.uint8))))
        assert got[offsets[k] : offsets[k + 1]].sum(axis=0) == pytest.approx(want, rel=1e-4)


def test_whole_texts_train_and_too_many_languages_raise(spark, monkeypatch):
    monkeypatch.setattr(language, "PART", 7)
    batch = language.pa.RecordBatch.from_arrays([language.pa.array(["a", "a", "a"]), language.pa.array(["abcdefgh" * 3, "", "xyz" * 9])], ["lang", "text"])
    got, want = Counter(), Counter()
    for b in language._grams([batch]):
        for r in b.to_pylist():
            got[r["n"], r["gram"]] += r["c"]
    for t in batch.column("text").to_pylist():
        want.update((n, int.from_bytes(t[i : i + n].encode())) for n in range(1, 5) for i in range(len(t) - n + 1))
    assert got == want
    monkeypatch.setattr(language, "PART", 1 << 20)
    df = spark.createDataFrame([(1, "ab " * 7_000 + "qqqq", "x"), (2, "cd", "y")], "doc_id long, text string, lang string")
    assert int.from_bytes(b"qqqq") in language.train(spark, df, "text", "lang", "doc_id").grams[4]
    monkeypatch.setattr(language, "MOST_LANGUAGES", 1)
    with pytest.raises(ValueError):
        language.train(spark, df, "text", "lang", "doc_id")


def test_every_text_trains_and_sets_the_limits(spark, monkeypatch):
    words = ["".join(chr(97 + i // 17**k % 17) for k in range(4)) for i in range(0, 83_521, 29)]  # 2,881 texts of a language
    texts = [("x", f"{w} so") for w in words] + [("y", "zu zz")]
    df = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(texts)], "doc_id long, text string, lang string").repartition(5)
    trees = language.train(spark, df, "text", "lang", "doc_id")
    grams = Counter(t.encode()[i : i + 4] for _, t in texts for i in range(len(t) - 3))
    assert trees.grams[4].tolist() == sorted(int.from_bytes(g) for g in grams)

    def bits(text):
        data = language.fold(np.frombuffer(text.encode(), np.uint8))
        return trees.lengths(data, np.zeros(1, np.int64)).sum(axis=0, dtype=np.float64) / len(data)

    steps = [math.ceil(bits(t)[0] * language.SPREAD_STEP) / language.SPREAD_STEP for lang, t in texts if lang == "x"]
    middle, high = np.percentile(steps, [50, 99])
    want = [middle + max(language.SPREAD * (high - middle), language.LEAST_SPREAD), bits("zu zz")[1] + language.LEAST_SPREAD]
    assert language.code_length_limits(spark, trees, language.training_rows(df, "text", "lang")) == pytest.approx(want, abs=2 / language.SPREAD_STEP)

    table = bits("zu sosa abcd")
    monkeypatch.setattr(language, "MOST_CELLS", 2 * len(grams))
    found = language.train(spark, df, "text", "lang")
    assert not found.children[4][1] and trees.children[4][1]
    trees = found
    assert bits("zu sosa abcd").tolist() == table.tolist()


def test_counts_handed_on_early_sum_up_alike(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(2)
    rows = [("ab"[i % 2], "".join(rng.choice(list("abcdé 0"), rng.integers(0, 9)))) for i in range(400)]
    batches = [pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows[i : i + 40], strict=True)], ["lang", "text"]) for i in range(0, 400, 40)]
    want = Counter()
    for lang, t in rows:
        raw = bytes(language.fold(np.frombuffer(t.encode(), np.uint8)))
        want.update((lang, n, int.from_bytes(raw[i : i + n])) for n in range(1, 5) for i in range(len(raw) - n + 1))
    for flush, part in ((1 << 20, 1 << 18), (500, 5), (1, 1)):
        monkeypatch.setattr(language, "FLUSH", flush)
        monkeypatch.setattr(language, "PART", part)
        got = Counter()
        for b in language._grams(batches):
            for r in b.to_pylist():
                got[r["lang"], r["n"], r["gram"]] += r["c"]
        assert got == want


def test_languages_are_told_apart(spark, awkward, nothing):
    rows = [(i, "the house is on the hill and the dog sleeps", "en") for i in range(40)] + [(100 + i, "das haus ist auf dem berg und der hund liegt", "de") for i in range(40)]
    rows += [(300, None, "en"), (301, "123 !?", "de"), (302, "der berg und das haus", None), (None, "the dog", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.held_out_languages(df).collect()}
    assert got[300] == got[301] == ("und", 0.0) and got[302][0] == "de" and got[None][0] == "en"
    assert all(got[i][0] == ("en" if i < 100 else "de") for i in range(140) if i in got)
    assert language.held_out_languages(awkward).count() == awkward.count()
    assert language.held_out_languages(nothing).count() == 0


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><a href=/>Site</a></header><nav><ul><li><a href=1>One</a></ul></nav>
<div class="cookie-notice">We use cookies</div><div class=ad>Buy now</div>%s<aside>See also</aside><form><p>Name</p></form>
<section id="comments"><p>first!</p></section><script>var x="</p>";</script><footer>&copy; us</footer></body></html>"""
BODY = "<h1>A &amp; B</h1><p>First   para\nwith <b>bold</b> text that is long enough.<p>Second&nbsp;one &lt;ok&gt;.</p><p>Of.</p><ul><li>x<li>y</ul>"
TEXT = "A & B\n\nFirst para with bold text that is long enough.\n\nSecond one <ok>.\n\nOf.\n\nx\n\ny"


@pytest.mark.parametrize("wrap", ["<article>%s</article>", "<main>%s</main>", "<div id=content>%s</div>"])
def test_main_text(wrap):
    assert maintext.main_text(PAGE % (wrap % BODY)) == TEXT


@pytest.mark.parametrize("page", [None, "", "   ", "<html></html>", "<script>x</script>", "<!-- only -->", "<", "<p", "<nav><a>m</a></nav>"])
def test_pages_without_text(page):
    assert maintext.main_text(page) in ("", "<")


def test_main_text_over_a_table(spark):
    df = spark.createDataFrame([(1, "u", PAGE % BODY), (2, None, None), (None, "n", "<p>x &am")], "page_id long, url string, html string")
    got = {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in maintext.extract_main_text(df).collect()}
    assert got == {1: ("u", TEXT, len(TEXT)), 2: (None, "", 0), None: ("n", "x &am", 5)}
    assert maintext.extract_main_text(df.limit(0)).count() == 0


def test_text_goes_on_behind_links_and_long_blocks():
    short = ["Some plain words of the article, number %d, which go on for about a hundred and fifty characters, as paragraphs of articles do, up to here." % i for i in range(6)]
    join = lambda parts: "".join(f"<p>{p}</p>" for p in parts)
    linked = '<a href="/a">a paragraph which is nearly all of it a link</a> and so on'
    assert maintext.main_text(join([*short[:3], linked, *short[3:]])) == "\n\n".join([*short[:3], "a paragraph which is nearly all of it a link and so on", *short[3:]])
    long = "word " * 12_000
    assert maintext.main_text(join([short[0], long, *short[1:]])) == "\n\n".join([short[0], long.strip(), *short[1:]])
    menu = "".join(f'<p><a href="/{i}">entry {i}</a></p>' for i in range(5))
    assert maintext.main_text(menu + join(short[:3]) + menu + join(short[3:]) + menu) == "\n\n".join(short)


def test_windows_run_on_marked_pages_and_keep_every_article(monkeypatch):
    part = ["Some plain words of part %d, which go on for about a hundred characters, as paragraphs of articles do." % i for i in range(8)]
    join = lambda parts: "".join(f"<p>{p}</p>" for p in parts)
    two = f"<article>{join(part[:5])}</article><p>stray</p><article>{join(part[5:])}</article>"
    assert maintext.main_text(two) == "\n\n".join(part)
    # Text outside an article that surges is kept.
    assert maintext.main_text(f"<article>{join(part[:4])}</article><div>{join(part[4:])}</div>") == "\n\n".join(part)
    ran = []
    whole = maintext._stretches
    monkeypatch.setattr(maintext, "_stretches", lambda lines, window: ran.append(len(lines)) or whole(lines, window))
    assert maintext.main_text(f"<article>{join(part[:2])}<p><a>all link</a></p></article>").endswith("all link") and ran == [3]


def test_names_of_wrappers_are_not_believed():
    body = "<h1>Head of it</h1><p>Some text of the page, and long enough to be one.</p>"
    text = "Head of it\n\nSome text of the page, and long enough to be one."
    assert maintext.main_text(f'<div class="layout has-sidebar"><article>{body}</article></div><div class=sidebar>See also</div>') == text
    assert maintext.main_text(f'<div class="sidebar"><article>{body}</article></div><div class=ad>Buy this, and buy that, at once, for it is long</div>') == text
    assert maintext.main_text(f'<div id="page-header-wrapper">{body}</div><div class="menu">One two</div>') == text
    assert maintext.main_text(f'<article><div class="article-header"><h1>Head of it</h1></div>{body[19:]}</article><section id="comments"><article class="comment"><p>{"first! " * 40}</p></article></section>') == text
    assert maintext.main_text(f'<div class=ad>{"Buy now. " * 40}</div><article><p>Short.</p></article>') == "Short."


def test_broken_markup_takes_linear_time_and_loses_no_text():
    import time

    assert maintext.main_text('<p title="x>one</p><p>two</p>') == "one\n\ntwo"
    began = time.perf_counter()
    for part in ("<div>x", "<a>x", "</div>x", '<a "', "<title>x", "<b>x</i>", "<span>x</p>", "<div class=ad>x", "<", "&"):
        maintext.main_text(part * 64_000)
    assert time.perf_counter() - began < 20


def test_pages_repeat_with_clashing_columns(spark):
    text = "A paragraph of the page which is long enough."
    long = PAGE % ("<article>" + f"<p>{text}</p>" * 20_000 + "</article>")
    df = spark.createDataFrame([(1, "u", long, 2, "x")] * 2 + [(2, "v", None, 3, None)], "page_id long, url string, html string, id int, text string")
    got = maintext.extract_main_text(df).collect()
    assert sorted((r["page_id"], r["n_chars"]) for r in got) == [(1, 20_000 * len(text) + 19_999 * 2)] * 2 + [(2, 0)]


NAMES = "share-price related-work notice legal side widget promotion search foot copyright social-history skip-level ad".split()


@pytest.mark.parametrize("wrap", ["<article>%s</article>", "<div class=post>%s</div>"])
def test_a_name_takes_no_paragraph_out_of_the_article(wrap):
    part = [f"Paragraph {i} of the article, which goes on for a while and then for some more, so that it is as long as paragraphs are." for i in range(30)]
    body = "<h1>Head</h1>" + "".join(f"<p>{p}</p>" + (f'<div class="{NAMES[i]}"><p>{part[i + 15]}</p></div>' if i < len(NAMES) else "") for i, p in enumerate(part[:15]))
    text = "\n\n".join(["Head", *(x for i, p in enumerate(part[:15]) for x in ([p, part[i + 15]] if i < len(NAMES) else [p]))])
    around = f'<div class="sidebar"><p>{part[29]}</p></div><div class="cookie-notice">{part[28]}</div><div id=comments><p>{part[27]}</p></div>'
    assert maintext.main_text(around + wrap % body + around) == text
    short = body.replace("</h1>", '</h1><div class="ad">Buy now, it is cheap</div><div class="widget share"><a href=x>Send it</a> <a href=y>Print</a></div>')
    assert maintext.main_text(around + wrap % short) == text


def test_a_slash_ends_no_element_of_html():
    page = '<article><h1>Head</h1><p>Text of it, long enough to be some.</p><script src="a.js"/>var leak = 1;</script><svg/><p>More of the text.</p></article>'
    assert maintext.main_text(page) == "Head\n\nText of it, long enough to be some.\n\nMore of the text."
    assert maintext.main_text("<nav id=top/><p>One two three</p></nav><p>Four five six seven</p>") == "Four five six seven"
    lines = maintext.lines_of("<p><a href=/x/>link</a> and <a name=y/>text</p>")
    assert [(x.text, x.linked) for x in lines] == [("link and text", 4)]


def test_stretches_equal_brute_force():
    rng = np.random.default_rng(12)
    for _ in range(400):
        sizes = [int(rng.choice([0, 0, 0, 1, 5, 60, 200])) for _ in range(int(rng.integers(1, 25)))]
        lines = [maintext.Line("x" * max(n, 4), 0 if n else 2, None, 0, False, 0) for n in sizes]
        mass = [x.plain for x in lines]
        got = [id(x) for x in maintext._stretches(lines, 3)]
        if not any(mass):
            assert got == [id(x) for x in lines]
            continue
        surge = sorted(min(m, 80) for m in mass if m)[(sum(m > 0 for m in mass) - 1) // 2]
        low = [any(0 <= s and s + 3 <= len(mass) and sum(mass[s : s + 3]) < max(surge / 20, 1) for s in (i - 2, i - 1, i)) for i in range(len(mass))]
        want, i = [], 0
        while i < len(mass):
            j = i
            while j < len(mass) and low[j] == low[i]:
                j += 1
            if not low[i] and max(sum(mass[k : min(k + 3, j)]) for k in range(i, j)) >= surge:
                text = [k for k in range(i, j) if mass[k]]
                want += [id(x) for x in lines[text[0] : text[-1] + 1]]
            i = j
        assert got == want


def test_chains_of_overlapping_texts(spark):
    words = [f"w{i * 7919 % 104729}" for i in range(70 + 7 * 700)]
    rows = [(i, " ".join(words[7 * i : 7 * i + 70])) for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in near.near_duplicates(df, block_rows=50).collect()}
    assert got == brute_links(rows)


def test_repeated_rows_are_folded_before_they_meet(spark, monkeypatch):
    text = " ".join(f"t{i}" for i in range(40))
    rows = [(7, text)] * 5000 + [(8, text + " more")] + [(20 + i, text + f" x{i}") for i in range(60)]
    whole = near._verifier

    def watched(*args):
        verify = whole(*args)

        def count(table):
            if table.num_rows > 2 * 40:
                raise ValueError(f"{table.num_rows} rows met")
            return verify(table)

        return count

    monkeypatch.setattr(near, "_verifier", watched)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {(r["doc_id"], r["class_id"], r["n_links"]) for r in near.near_duplicates(df, block_rows=20).collect()}
    assert (7, 7, 5060) in got and (8, 7, 5060) in got and len(got) == 62


def test_one_id_many_times_changes_no_model(spark, monkeypatch):
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abcdefghij"), rng.integers(3, 8)))
    docs = [(i, " ".join([word() for _ in range(30)] + ([f"grob{word()[:3]}" for _ in range(3)] if i % 14 == 0 else []))) for i in range(700)]
    labels = [(i, int(i % 14 == 0)) for i in range(700) if i % 2 == 0 or i % 14 == 0]
    schemas = "id long, text string", "id long, label int"
    lab = spark.createDataFrame(labels, schemas[1])
    seen = []
    fit = toxicity.fit_non_negative
    monkeypatch.setattr(toxicity, "fit_non_negative", lambda positive, mixture, prior, **options: seen.append((len(positive), len(mixture), prior)) or fit(positive, mixture, prior, **options))
    models = [toxicity.train(spark, spark.createDataFrame(rows, schemas[0]).repartition(4), lab) for rows in (docs, docs + [docs[3]] * 30_000, docs + [docs[14]] * 30_000)]
    assert seen == [(50, 700, 50 / 350)] * 3
    for other in models[1:]:
        assert other.vocabulary == models[0].vocabulary and np.array_equal(other.weights, models[0].weights) and other.bias == models[0].bias
    toxicity.train(spark, spark.createDataFrame(docs + [(5, f"text {i}") for i in range(3000)] + [(14, f"grob {i}") for i in range(3000)], schemas[0]), lab, most_positive=30, most_mixture=200)
    assert seen[-1][:2] == (30, 200)


def test_the_risk_is_that_of_its_definition():
    rng = np.random.default_rng(4)
    positive, mixture, prior = rng.random((40, 3)) < [0.9, 0.5, 0.2], rng.random((300, 3)) < [0.3, 0.5, 0.2], 0.2
    w, b = toxicity.fit_non_negative(positive, mixture, prior, sparse=0.0)

    def risk(w, b):
        loss = lambda g: 1 / (1 + np.exp(g))
        gp, gu = positive @ w + b, mixture @ w + b
        return prior * loss(gp).mean() + max(0.0, loss(-gu).mean() - prior * loss(-gp).mean())

    grid = [(np.array([x, 0.0, 0.0]), y) for x in (0.0, 4.0, 12.0) for y in (-10.0, -6.0, -2.0, 0.0)]
    assert risk(w, b) <= min(risk(*g) for g in grid) + 0.01 and w[0] > abs(w[1]) and w[0] > abs(w[2])
