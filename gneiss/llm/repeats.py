"""Removal of byte strings that repeat, by distributed prefix doubling on ranks of positions."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gneiss.llm.textbytes import bounded_batches, mix, utf8
from gneiss.storage import materialise, release, written

#: Length of the strings that positions are ranked by first.
SEED = 40
#: Bits of the filter that spares unique ranks a shuffle: 16 MB, whatever the corpus' size.
FILTER_BITS = 1 << 27
CHUNK = 1 << 19
#: How many positions, counted from an anchor, are ranked together in each round.
SPANS = (64, 8, 1)
#: Spreads the starts of units over the filters' keys.
STEP = 1_000_003
_rng = np.random.Generator(np.random.PCG64(90_173))
_code = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0xD1342543DE82EF95
_up = np.ones(1, np.uint64)
_down = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _up, _down
    if len(_up) < n:
        up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _up, _down = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _up, _down


class Strings:
    """Fingerprints of the substrings of some bytes, from prefix sums."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_code[data] * up[: len(data)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts + salt).astype(np.uint64))


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values the place of its first smallest one, by doubling."""
    places, span = np.arange(len(values)), 1
    best = values
    while span < width:
        step = min(span, width - span)
        later = best[step:] < best[:-step]
        best, places = np.where(later, best[step:], best[:-step]), np.where(later, places[step:], places[:-step])
        span += step
    return places


def segments(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Byte ranges of whole rows, together up to about ``most`` bytes, or of ``most`` positions of a longer
    row, cut from its own start; what a row is cut into does not depend on its neighbours."""
    out, at = [], 0
    while at < len(offsets) - 1:
        to = max(int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1, at + 1)
        low, high = int(offsets[at]), int(offsets[to])
        out += [(x, min(x + most, high)) for x in range(low, high, most)] if high - low > most else [(low, high)]
        at = to
    return out


def marked(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the bits of some 64-bit keys are set."""
    bit = keys.view(np.uint64) & np.uint64(FILTER_BITS - 1)
    return (bits[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 > 0


def unit_keys(doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    return doc ^ start * STEP


def units(data: np.ndarray, offsets: np.ndarray, doc: np.ndarray, length: int, open_: list[np.ndarray], seed: int = SEED):
    """Yield ``(row, start, count, rank, whole)``: units of consecutive positions with ``length`` bytes before
    them in their row.

    The anchor of a position is the first smallest, by fingerprint, of the strings
    of ``seed`` bytes in its ``length``.  Positions that share an anchor are a
    unit, whose ``rank`` is the anchor's fingerprint; of the units that a filter
    of ``open_`` marks, those of their positions that are at most SPANS[1],
    SPANS[2], ... apart, counted from the anchor, are the units of the next
    round, whose ``rank`` is the fingerprint of what all positions so far from
    an anchor have in common.  Positions with equal strings are in units of equal
    rank, so a string whose unit's rank is unique does not repeat.  ``whole`` is
    the fingerprint of all bytes from the first position to the end of the last
    one's string; units with equal rank and ``whole`` have the same strings in
    the same order.  No two positions of a unit have equal strings, which would
    have anchors of their own.
    """
    ends = offsets[1:]
    for at, to in segments(offsets, CHUNK):
        part = data[at : to + length - 1]
        if len(part) < length:
            continue
        strings = Strings(part)
        grams = strings.of(np.arange(len(part) - seed + 1), np.arange(seed, len(part) + 1))
        anchors = least_places(grams, length - seed + 1)[: to - at]
        row = np.searchsorted(ends, at + np.arange(len(anchors)), "right")
        fits = at + np.arange(len(anchors)) + length <= ends[row]
        new = np.ones(len(anchors), bool)
        new[1:] = (anchors[1:] != anchors[:-1]) | (row[1:] != row[:-1]) | ~fits[:-1]
        first = np.flatnonzero(new & fits)
        breaks = np.append(np.flatnonzero(new | ~fits), len(anchors))
        count = breaks[np.searchsorted(breaks, first, "right")] - first
        row, rank = row[first], grams[anchors[first]]
        for bits, span in zip(open_, SPANS[1:], strict=False):
            keep = marked(bits, unit_keys(doc[row], at + first - offsets[row]))
            row, first, count = row[keep], first[keep], count[keep]
            place = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
            apart = (anchors[place] - place) // span
            new = np.ones(len(place), bool)
            new[1:] = (apart[1:] != apart[:-1]) | (anchors[place[1:]] != anchors[place[:-1]]) | (place[1:] != place[:-1] + 1)
            begins = np.flatnonzero(new)
            row, first, count = np.repeat(row, count)[begins], place[begins], np.diff(np.append(begins, len(place)))
            common = anchors[first] - apart[begins] * span
            rank = strings.of(common, common - span + 1 + length)
        if len(first):
            yield row, at + first - offsets[row], count, rank, strings.of(first, first + count + length - 1, salt=1 << 32)


def _all_units(batch: pa.RecordBatch, length: int, open_: list[np.ndarray]) -> list[np.ndarray]:
    doc = batch.column("doc").to_numpy() if open_ else None
    found = list(units(*utf8(batch.column("text")), doc, length, open_))
    kinds = (np.int64, np.int64, np.int64, np.uint64, np.uint64)
    return [np.concatenate([f[c] for f in found]) if found else np.zeros(0, kind) for c, kind in enumerate(kinds)]


def _ranks(length: int):
    """``(rank, times)``: how many units of a batch have a rank."""

    def rank(batches):
        for batch in batches:
            ranks, times = np.unique(_all_units(batch, length, [])[3], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(ranks.view(np.int64)), pa.array(times)], ["rank", "times"])

    return rank


def _place_keys(batch: pa.RecordBatch, row: np.ndarray, start: np.ndarray) -> list[np.ndarray]:
    """The order of positions, most significant last: null ids first, id, text, start."""
    ids = batch.column("id")
    null = ids.is_null().to_numpy(zero_copy_only=False)
    return [start, batch.column("doc").to_numpy()[row], ids.fill_null(0).to_numpy()[row], ~null[row]]


def _candidates(length: int, repeated, open_: list, open_docs):
    """``(rank, whole, id, doc, start, count, known)`` of a round's units, in the first round of those whose rank may repeat.

    Of a batch's equal units only the earliest is left to be compared with
    others; the later ones are known to repeat, and neighbours become one row.
    """

    def choose(batches):
        for batch in batches:
            if open_:  # texts that no unit is left of
                batch = batch.filter(pa.array(marked(open_docs.value, batch.column("doc").to_numpy())))
            row, start, count, rank, whole = _all_units(batch, length, [b.value for b in open_])
            if not open_:
                maybe = marked(repeated.value, rank)
                row, start, count, rank, whole = (x[maybe] for x in (row, start, count, rank, whole))
            keys = _place_keys(batch, row, start)
            order = np.lexsort([*keys, whole, rank])
            same = np.zeros(len(order), bool)
            same[1:] = (rank[order][1:] == rank[order][:-1]) & (whole[order][1:] == whole[order][:-1])
            leader = np.empty(len(order), np.int64)
            leader[order] = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
            mine = leader == np.arange(len(order))
            again = ~mine & np.all([k == k[leader] for k in keys], axis=0)  # the same document once more
            late = np.flatnonzero(~mine & ~again)
            late = late[np.lexsort((start[late], row[late]))]
            run = np.ones(len(late), bool)
            run[1:] = (row[late][1:] != row[late][:-1]) | (start[late][1:] != (start + count)[late][:-1])
            head = np.flatnonzero(run)
            covered = np.add.reduceat(count[late], head) if len(head) else head
            take = np.concatenate([np.flatnonzero(mine), late[head]])
            known = np.concatenate([np.zeros(mine.sum(), bool), np.ones(len(head), bool)])
            out = [pa.array(rank[take].view(np.int64)), pa.array(whole[take].view(np.int64)), batch.column("id").take(pa.array(row[take])), batch.column("doc").take(pa.array(row[take]))]
            out += [pa.array(start[take].astype(np.int32)), pa.array(np.concatenate([count[mine], covered]).astype(np.int32)), pa.array(known)]
            yield pa.RecordBatch.from_arrays(out, ["rank", "whole", "id", "doc", "start", "count", "known"])

    return choose


def removed_bytes(n: int, spans: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal runs ``(from, to)`` of bytes covered by the strings at spans ``(start, count)`` of positions."""
    runs: list[tuple[int, int]] = []
    for start, count in sorted(spans):
        end = start + count + length - 1
        if runs and start <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(runs[-1][1], end))
        else:
            runs.append((start, end))
    return runs


def _finished(rows, length: int, keep_text: bool) -> pa.RecordBatch:
    """Results of ``(id, text, spans)``."""
    out = []
    for id_, text, spans in rows:
        raw = text.encode()
        runs = removed_bytes(len(raw), spans, length)
        edges = [0, *(x for run in runs for x in run), len(raw)]
        kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
        out.append((id_, len(raw), sum(b - a for a, b in runs), len(runs), hashlib.sha256(kept).hexdigest(), kept if keep_text else None))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    columns = list(zip(*out, strict=True)) or [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def _untouched(length: int, shared, keep_text: bool):
    """Results of the texts without any span."""

    def finish(batches):
        for batch in batches:
            clean = np.flatnonzero(~marked(shared.value, batch.column("doc").to_numpy()))
            ids, texts = batch.column("id"), batch.column("text")
            yield _finished(((ids[i].as_py(), texts[i].as_py(), ()) for i in clean.tolist()), length, keep_text)

    return finish


def _maybe_touched(shared):
    def choose(batches):
        for batch in batches:
            yield batch.filter(pa.array(marked(shared.value, batch.column("doc").to_numpy())))

    return choose


def _cut(length: int, keep_text: bool):
    def finish(batches):
        for batch in batches:
            rows = zip(batch.column("id"), batch.column("text"), batch.column("spans"), strict=True)
            yield _finished(((i.as_py(), t.as_py(), [(x["start"], x["count"]) for x in spans.as_py() or ()]) for i, t, spans in rows), length, keep_text)

    return finish


def _filter_of(rows: DataFrame, key) -> np.ndarray:
    """The bitmap of some 64-bit keys: parts of 4 KB, at most FILTER_BITS in all."""
    at = key.bitwiseAND(F.lit(FILTER_BITS - 1))
    parts = rows.groupBy(F.shiftright(at, 15).cast("int").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at + 1)).alias("bits")).collect()
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for p in parts:
        out[p["part"] << 12 : (p["part"] + 1) << 12] = np.frombuffer(p["bits"], np.uint8)
    return out


def repeated_positions(texts: DataFrame, length: int) -> DataFrame:
    """``(doc, start, count)``: runs of positions whose strings of ``length`` bytes also start earlier.

    ``texts`` is ``(id, doc, text)``, ``doc`` being a fingerprint of id and text.
    """
    spark = texts.sparkSession
    counted = texts.select("text").mapInArrow(_ranks(length), "rank long, times long").groupBy("rank").agg(F.sum("times").alias("times"))
    repeated = spark.sparkContext.broadcast(_filter_of(counted.where("times > 1"), F.col("rank")))
    kind = "rank long, whole long, id long, doc long, start int, count int, known boolean"
    place, found, open_, open_docs = F.struct("id", "doc", "start"), None, [], None
    for span in SPANS:
        chosen = texts.mapInArrow(_candidates(length, repeated, open_, open_docs), kind)
        # A batch sends a unit once, so no key has more rows than there are batches.
        first = F.when(~F.col("known"), F.min(place).over(Window.partitionBy("rank", "whole", "known")) == place).otherwise(False)
        placed = materialise(chosen.withColumn("first", F.coalesce(first, F.lit(True))).drop("whole", "known", "id"), f"repeat-units-{span}")
        later = placed.where("NOT first").select("doc", "start", "count")
        found = later if found is None else found.union(later)
        if span == 1:
            return found
        firsts = placed.where("first")
        several = firsts.groupBy("rank").agg(F.count("*").alias("c")).where("c > 1").select(F.col("rank").alias("of"))
        left = firsts.join(several, F.col("rank") == F.col("of"))
        open_docs = spark.sparkContext.broadcast(_filter_of(left, F.col("doc")))
        open_ = [*open_, spark.sparkContext.broadcast(_filter_of(left, F.col("doc").bitwiseXOR(F.col("start") * F.lit(STEP).cast("long"))))]
    raise AssertionError("the last span is one position")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, keep_text: bool = False) -> DataFrame:
    """``(id_col, n_bytes, n_removed, n_spans, kept_sha256)`` of every row, and ``kept`` (binary) if asked for.

    Of each text's UTF-8 bytes those go that a string of ``length`` bytes covers
    which also starts earlier: in a document with a smaller id, or earlier in
    the same one.  Null texts count as empty, null ids are before all others,
    rows of one id and different texts are documents in the order of a
    fingerprint of both, and repeated rows of one id and text are one document,
    each row with its result.  Strings never cross documents.  Other columns
    play no part.

    Prefix doubling that starts at SEED bytes and drops positions as soon as
    their rank is unique.  A round ranks units of positions (``units``) by a
    string that all of a unit's positions have in common; Spark sorts the pairs
    (rank, rank of the whole unit).  A unit with a unique rank does not repeat,
    all but the earliest of equal pairs repeat, and the first of the different
    units that share a rank are taken apart for the next round, where the common
    string is longer: SEED bytes at first, then ``length - SPANS[i] + 1``, until
    it is the position's own string.  Ranks are 64-bit fingerprints, as equality
    is all that is asked of them, and every decision rests on two.

    Each round reads the texts again and shuffles a row for each unit left, its
    own copies in a batch folded; filters of FILTER_BITS say which are left (a
    bit set in error costs a row, not a result).  Texts are shuffled once, where
    spans meet them.
    """
    if length < SEED + 16:
        raise ValueError(f"strings of at least {SEED + 16} bytes have anchors that are worth it; {length} were asked for")
    spark = docs.sparkSession
    bounded_batches(spark)
    before = written()
    ids = F.col(id_col).cast("long")
    texts = docs.select(ids.alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = texts.select("id", F.xxhash64("id", "text").alias("doc"), "text")
    found = repeated_positions(texts, length)
    touched = spark.sparkContext.broadcast(_filter_of(found, F.col("doc")))
    spans = found.groupBy(F.col("doc").alias("of")).agg(F.collect_list(F.struct("start", "count")).alias("spans"))
    met = texts.mapInArrow(_maybe_touched(touched), "id long, doc long, text string").join(spans, F.col("doc") == F.col("of"), "left").select("id", "text", "spans")
    kind = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    out = met.mapInArrow(_cut(length, keep_text), kind).union(texts.mapInArrow(_untouched(length, touched, keep_text), kind))
    out = materialise(out, "repeat-result")
    release(before, out)
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if keep_text else []))
