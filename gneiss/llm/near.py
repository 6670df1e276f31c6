"""N-gram Jaccard join with Bayesian candidate pruning."""

from __future__ import annotations

from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gneiss.llm.textbytes import bounded_batches, mix, shingle_hashes, utf8, word_hashes
from gneiss.operators.components import connected_components
from gneiss.storage import materialise, release, written

BANDS, PER_BAND, STEP = 32, 5, 16
HASHES = BANDS * PER_BAND
_rng = np.random.Generator(np.random.PCG64(77_031))
_factors = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
_flips = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)


def minhash(shingles: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """MinHash signatures, uint32 of shape (rows, HASHES); every row has a shingle."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(rows) - 1, HASHES), np.uint32)
    at = 0
    while at < len(rows) - 1:
        to = max(int(np.searchsorted(rows, rows[at] + 200_000)) - 1, at + 1)
        part, begins = low[rows[at] : rows[to]], rows[at:to] - rows[at]
        for k in range(HASHES):
            out[at:to, k] = np.minimum.reduceat((part ^ _flips[k]) * _factors[k], begins)
        at = to
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit key a band; equal only where the band's minima are."""
    keys = np.empty((len(signatures), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(signatures), b + 1, np.uint64)
        for k in range(b * PER_BAND, (b + 1) * PER_BAND):
            key = mix(key ^ (signatures[:, k].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)))
        keys[:, b] = key
    return keys


@lru_cache
def least_matches(threshold: float, tolerance: float) -> tuple[int, ...]:
    """For 16, 32, ... compared values, the fewest matches that keep a pair.

    With a uniform prior, P(J >= t | m of n match) is the chance of at most m
    successes in n + 1 draws of chance t; a pair goes once this falls below the
    tolerance.
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        tail, m = 0.0, 0
        for m in range(n + 2):
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                break
        out.append(m)
    return tuple(out)


def _signer(width: int):
    def sign(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            words, rows = word_hashes(data, offsets)
            shingles, starts = shingle_hashes(words, rows, width)
            some = np.diff(starts) > 0
            keep = np.flatnonzero(some)
            signatures = minhash(shingles, np.append(starts[:-1][some], starts[-1])) if len(keep) else np.zeros((0, HASHES), np.uint32)
            raw = [None] * len(some)
            for r, s in zip(keep.tolist(), signatures, strict=True):
                raw[r] = s.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("f1"), batch.column("f2"), pa.array(np.diff(offsets)), pa.array(raw, pa.binary())],
                ["id", "f1", "f2", "n_bytes", "signature"],
            )

    return sign


def _keys_of(batches):
    for batch in batches:
        signatures = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(-1, HASHES)
        keys = band_keys(signatures).view(np.int64).ravel()
        ids = np.repeat(batch.column("rep").to_numpy(), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(keys)], ["rep", "key"])


def candidate_pairs(signatures: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float, tolerance: float):
    """Yield ``(i, js)``: for row i of ``left``, the rows of ``right`` after it that may be similar enough.

    They share a band; MinHash values are then compared 16 at a time and a pair
    is dropped when the posterior falls below the tolerance.
    """
    keys, fewest = band_keys(signatures), least_matches(threshold, tolerance)
    for i in left.tolist():
        js = right[right > i]
        js = js[(keys[js] == keys[i]).any(axis=1)] if len(js) else js
        matched = np.zeros(len(js), np.int64)
        for step, least in enumerate(fewest):
            if not len(js):
                break
            part = slice(step * STEP, (step + 1) * STEP)
            matched += (signatures[js, part] == signatures[i, part]).sum(axis=1)
            js, matched = js[matched >= least], matched[matched >= least]
        if len(js):
            yield i, js


def similar_pairs(signatures: np.ndarray, shingles: np.ndarray, starts: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float, tolerance: float):
    """Yield ``(i, js)``: for row i of ``left``, the rows of ``right`` after it that are similar enough.

    Candidates are verified on the exact shingle sets, held as bit sets.
    """
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    universe, inverse, times = np.unique(shingles, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(times > 1)
    column = np.full(len(universe), -1, np.int64)
    column[shared] = np.arange(len(shared))
    at = column[inverse]
    bits = np.zeros((len(starts) - 1, (len(shared) + 63) // 64 * 8), np.uint8)
    row, at = row[at >= 0], at[at >= 0]
    np.bitwise_or.at(bits, (row, at >> 3), (1 << (at & 7)).astype(np.uint8))
    bits, sizes = bits.view(np.uint64), np.diff(starts)
    for i, js in candidate_pairs(signatures, left, right, threshold, tolerance):
        both = np.bitwise_count(bits[js] & bits[i]).sum(axis=1).astype(np.int64)
        js = js[both / (sizes[js] + sizes[i] - both) >= threshold]
        if len(js):
            yield i, js


def _prospects(threshold: float, tolerance: float):
    """``(area, a, b, rep)``: the rows of two blocks that are in a pair which pruning leaves."""

    def choose(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        rep, block = (table.column(c).to_numpy() for c in ("rep", "block"))
        signatures = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint32).reshape(-1, HASHES)
        a, b = (table.column(c)[0].as_py() for c in ("a", "b"))
        everyone, some = np.arange(len(rep)), np.zeros(len(rep), bool)
        for left, right in _halves(everyone, block, a, b):
            for i, js in candidate_pairs(signatures, left, right, threshold, tolerance):
                some[i] = True
                some[js] = True
        return table.select(["area", "a", "b", "rep"]).filter(pa.array(some))

    return choose


def _halves(everyone: np.ndarray, block: np.ndarray, a: int, b: int):
    """Rows to compare with later rows, so that each pair of two blocks, or of one, comes up once."""
    if a == b:
        yield everyone, everyone
    else:
        yield everyone[block == a], everyone[block == b]
        yield everyone[block == b], everyone[block == a]


_FOUND = pa.schema([("split", pa.bool_()), ("src", pa.int64()), ("dst", pa.int64()), ("links", pa.int64())])


def _verifier(width: int, threshold: float, tolerance: float):
    def verify(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("rep").to_numpy(), kind="stable")
        table = table.take(pa.array(order)).combine_chunks()
        rep = table.column("rep").to_numpy()
        _, single = np.unique(rep, return_index=True)
        table = table.take(pa.array(single)) if len(single) < len(rep) else table
        rep, weight, block = (table.column(c).to_numpy() for c in ("rep", "n", "block"))
        signatures = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint32).reshape(-1, HASHES)
        words, rows = word_hashes(*utf8(table.column("text")))
        loose, starts = shingle_hashes(words, rows, width)
        sets = [np.unique(loose[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True)]
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        a, b, split = (table.column(c)[0].as_py() for c in ("a", "b", "split"))
        everyone = np.arange(len(rep))
        links, root = np.zeros(len(rep), np.int64), everyone.copy()

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for left, right in _halves(everyone, block, a, b):
            for i, js in similar_pairs(signatures, np.concatenate(sets), starts, left, right, threshold, tolerance):
                links[i] += weight[js].sum()
                links[js] += weight[i]
                for j in np.unique(root[js]).tolist():
                    low, high = sorted((top(i), top(j)))
                    root[high] = low
        linked = np.flatnonzero(links)
        tops = np.array([top(i) for i in linked.tolist()], np.int64)
        return pa.Table.from_arrays(
            [pa.array(np.full(len(linked), split)), pa.array(rep[linked]), pa.array(rep[tops] if len(tops) else tops), pa.array(links[linked])], schema=_FOUND
        )

    return verify


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = 0.8,
    width: int = 5,
    tolerance: float = 1e-7,
    block_rows: int = 160,
    block_bytes: int = 16 << 20,
) -> DataFrame:
    """One row per document: ``(id_col, class_id, n_links)``.

    Two documents are linked when the Jaccard similarity of their sets of
    ``width``-word shingles is at least ``threshold``; ``n_links`` counts the
    other documents linked to one (copies included), ``class_id`` is the
    smallest id in its connected component of links.  Words are runs of
    characters outside ``[\\x20\\x09-\\x0D]``; a text of fewer words has one
    shingle of them all.

    Plan: exact copies are folded by fingerprint (an aggregate).  MinHash bands
    of the remaining texts give buckets, and every bucket adds a star of edges
    to its smallest member, never its pairs.  The components of these stars
    bound where links can be.  A component's texts meet in one group, or, when
    they are more than ``block_rows`` or ``block_bytes``, in one group for each
    two blocks of it, first as signatures alone, then with the texts of those
    that a pair is left of.  Only link counts and a spanning forest leave a group.
    Within a group pairs that share a band go through Bayesian pruning and then
    exact verification, on the sets of the shingles' 64-bit hashes.  A pair at exactly the threshold shares no band with
    probability below 4e-6, and is pruned with probability below 1e-6.

    A text, not an id, is what is compared: rows under one id, or under none,
    are each linked by their own text.  Null, empty and all-white-space texts
    have no links and their own class.  A class in which no row has an id is
    null.  Repeated rows with one id and text count as copies of the text.
    Columns other than the two named play no part.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed, per_text = _classes(rows, threshold, width, tolerance, block_rows, block_bytes)
    known = (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")) & F.col("signature").isNotNull()
    return signed.join(per_text, known, "left").select(
        F.col("id").alias(id_col), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )


#: Bits of the filter that spares texts outside every component a shuffle: 4 MB, whatever the table's size.
FILTER_BITS = 1 << 25


def _maybe_in(rows: DataFrame, key: str, wanted: DataFrame, wanted_key: str) -> DataFrame:
    """Rows whose key is among the wanted ones, and a few others: a bitmap of the
    wanted keys' remainders, at most FILTER_BITS, is broadcast in parts of 4 KB."""
    at = lambda c: F.pmod(F.col(c), F.lit(FILTER_BITS))
    marks = wanted.groupBy(F.bitmap_bucket_number(at(wanted_key)).alias("_part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at(wanted_key))).alias("_bits"))
    placed = rows.withColumns({"_bucket": F.bitmap_bucket_number(at(key)), "_bit": F.bitmap_bit_position(at(key))})
    byte = "cast(conv(hex(substring(_bits, cast(_bit div 8 AS int) + 1, 1)), 16, 10) AS int)"
    kept = placed.join(F.broadcast(marks), F.col("_bucket") == F.col("_part")).where(f"shiftright({byte}, cast(_bit % 8 AS int)) & 1 = 1")
    return kept.select(rows.columns)


_PRINTS = (F.xxhash64, "f1"), (lambda text: F.xxhash64(F.lit(7), text), "f2")


def _printed(rows: DataFrame) -> DataFrame:
    return rows.select("*", *(of("text").alias(name) for of, name in _PRINTS))


def _classes(rows: DataFrame, threshold: float = 0.8, width: int = 5, tolerance: float = 1e-7, block_rows: int = 160, block_bytes: int = 16 << 20) -> tuple[DataFrame, DataFrame]:
    """The signed rows of ``(id, text)``, and of each different text with words
    ``(g1, g2, least, first, class_id, n_links)``: its fingerprint, its smallest
    id, and whether it is the first of its class (smallest id, nulls last)."""
    bounded_batches(rows.sparkSession)
    before = written()
    printed = _printed(rows)
    signed = materialise(
        printed.mapInArrow(_signer(width), "id long, f1 long, f2 long, n_bytes long, signature binary"),
        "near-signed",
    )
    wordy = signed.where("signature IS NOT NULL")
    # Once the table is written, a text's number is fixed.
    folded = wordy.groupBy("f1", "f2").agg(F.min("id").alias("least"), F.count("*").alias("n")).withColumn("rep", F.monotonically_increasing_id())
    folded = materialise(folded, "near-folded")
    named = folded.select(F.col("f1").alias("g1"), F.col("f2").alias("g2"), "least", "n", "rep")
    of_text = (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")) & F.col("id").eqNullSafe(F.col("least"))
    texts = materialise(wordy.join(named, of_text).dropDuplicates(["rep"]).select("rep", "g1", "g2", "least", "n", "n_bytes", "signature"), "near-texts")
    keys = texts.select("rep", "signature").mapInArrow(_keys_of, "rep long, key long")
    heads = materialise(keys.groupBy("key").agg(F.min("rep").alias("head"), F.count("*").alias("c")).where("c > 1").select(F.col("key").alias("hkey"), "head"), "near-heads")
    stars = keys.join(heads, F.col("key") == F.col("hkey")).where("rep <> head").select("rep", "head")
    # A text has at most one head a band; all of them hang on its smallest one, which keeps the components.
    stars = stars.withColumn("low", F.min("head").over(Window.partitionBy("rep")))
    hung = stars.select(F.explode(F.array("rep", "head")).alias("src"), F.col("low").alias("dst")).where("src <> dst").distinct()
    areas = connected_components(hung)
    sized = materialise(
        areas.join(texts.select("rep", "n_bytes"), F.col("node") == F.col("rep"))
        .groupBy("component")
        .agg(F.greatest(F.ceil(F.count("*") / block_rows), F.ceil(F.sum("n_bytes") / block_bytes)).cast("int").alias("blocks")),
        "near-sized",
    )
    placed = (
        areas.join(sized.withColumnRenamed("component", "area"), F.col("component") == F.col("area"))
        .select("area", F.col("node"), "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    )
    signs = placed.join(texts.drop("n_bytes"), F.col("node") == F.col("rep"))
    signs = materialise(signs.select("area", "block", "blocks", "rep", "g1", "g2", "least", "n", "signature"), "near-signs")
    # Ranges of groups are cut by their rows, so no task has many more rows than others, but one group;
    # they are not put together again by size, as it is the pairs in them that cost time.
    spark = rows.sparkSession
    ranges = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    facing = signs.where("blocks > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    facing = facing.select("area", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "rep", "signature")
    prospects = facing.repartitionByRange(ranges, "area", "a", "b").groupBy("area", "a", "b").applyInArrow(_prospects(threshold, tolerance), "area long, a int, b int, rep long")
    met = materialise(prospects.union(signs.where("blocks = 1").select("area", F.lit(0), F.lit(0), "rep")), "near-met")
    wanted = materialise(met.select(F.col("rep").alias("wanted")).distinct().join(signs, F.col("wanted") == F.col("rep")).drop("wanted", "area"), "near-wanted")
    # Texts that nothing is left of, mostly nearly all of them, are left where they are; repeated rows are folded.
    inside = _maybe_in(printed, "f1", wanted, "g1").dropDuplicates(["id", "f1", "f2"])
    whole = materialise(wanted.join(inside, of_text).select(F.col("rep").alias("of"), "block", "blocks", "n", "signature", "text"), "near-whole")
    found = (
        met.join(whole, F.col("rep") == F.col("of"))
        .select("area", "a", "b", (F.col("blocks") > 1).alias("split"), "block", "rep", "n", "signature", "text")
        .repartitionByRange(ranges, "area", "a", "b")
        .groupBy("area", "a", "b")
        .applyInArrow(_verifier(width, threshold, tolerance), "split boolean, src long, dst long, links long")
    )
    found = materialise(found, "near-found")
    links = found.groupBy("src").agg(F.sum("links").alias("links"))
    across = connected_components(found.where("split").select("src", "dst"))
    classes = found.where("NOT split").select(F.col("src").alias("node"), F.col("dst").alias("component")).distinct().union(across)
    classes = materialise(classes.join(folded, F.col("node") == F.col("rep")).select("node", "component", "least", "f1", "f2"), "near-classes")
    order = F.struct(F.col("least").isNull().alias("unnamed"), "least", "f1", "f2", "node")
    firsts = classes.groupBy("component").agg(F.min("least").alias("class_id"), F.min(order)["node"].alias("first_node")).withColumnRenamed("component", "of")
    classes = classes.join(firsts, F.col("component") == F.col("of")).select("node", "class_id", "first_node")
    per_text = materialise(
        named.join(links, F.col("rep") == F.col("src"), "left")
        .join(classes, F.col("rep") == F.col("node"), "left")
        .select(
            "g1", "g2", "least", (F.coalesce("first_node", "rep") == F.col("rep")).alias("first"),
            F.coalesce("class_id", "least").alias("class_id"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        ),
        "near-per-text",
    )
    release(before, signed, per_text)  # nothing else of it is read again
    return signed, per_text


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that are the first (smallest id, nulls last) of their class; all columns stay.

    Documents without words stay.  Repeated rows of one id and text become a
    single row, but for those with neither id nor words.
    """
    signed, per_text = _classes(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), **options)
    first = per_text.where("first").select("g1", "g2", "least")
    wordless = signed.where("signature IS NULL").select(F.col("f1").alias("g1"), F.col("f2").alias("g2")).distinct()
    whole = F.struct(*(F.col(c) for c in docs.columns)).alias("row")
    rows = _printed(docs.select(whole, F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))).drop("text")
    same = (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2"))
    kept = rows.join(first, same & F.col("id").eqNullSafe(F.col("least"))).dropDuplicates(["f1", "f2"]).select("row")
    bare = rows.join(wordless, same, "left_semi")
    return kept.union(bare.where("id IS NOT NULL").dropDuplicates(["id", "f1", "f2"]).select("row")).union(bare.where("id IS NULL").select("row")).select("row.*")
