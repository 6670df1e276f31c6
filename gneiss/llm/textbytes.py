"""Words of whole Arrow batches as 64-bit hashes, without per-word Python.

A word is a run of bytes outside ``[\\x20\\x09-\\x0D]``.  White space is ASCII,
so words can be found on UTF-8 bytes directly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

WINDOW = 1 << 20

_space = np.zeros(256, bool)
_space[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.Generator(np.random.PCG64(20_240_607))
_byte_code = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_MULT = np.uint64(0x9E3779B97F4A7C15)
_MULT_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_shingle_code = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def bounded_batches(spark: SparkSession, most: str = "2m") -> None:
    """Bound what a Python worker and its executor hold of a table at once: Arrow
    batches of ``most`` bytes, or one longer row, unless the session names a size."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, most)


def parts_of(column: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Rows ``(at, to)`` of consecutive parts of about ``most`` bytes of a string column, or one longer row."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(sizes):
        before = sizes[at - 1] if at else 0
        to = max(int(np.searchsorted(sizes, before + most, "right")), at + 1)
        yield at, to
        at = to


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string()).cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data[:0], offsets - offsets[0] if len(offsets) else offsets


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        ones = np.full(n, _MULT, np.uint64)
        ones[0] = 1
        _powers["up"] = np.multiply.accumulate(ones)
        ones = np.full(n, _MULT_INV, np.uint64)
        ones[0] = 1
        _powers["down"] = np.multiply.accumulate(ones)
    return _powers["up"], _powers["down"]


def _window_words(data: np.ndarray, starts_row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of one window; a row's start ends a word too."""
    inside = ~_space[data]
    before = np.empty(len(data), bool)
    before[0], before[1:] = False, inside[:-1]
    before[starts_row] = False
    first = np.flatnonzero(inside & ~before)
    if not len(first):
        return first, np.zeros(0, np.uint64)
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = False, inside[1:]
    cut = starts_row[starts_row > 0] - 1
    after[cut] = False
    last = np.flatnonzero(inside & ~after)
    up, down = _power(len(data) + 1)
    total = np.cumsum(_byte_code[data] * up[: len(data)])
    lower = np.where(first > 0, total[first - 1], np.uint64(0))
    return first, mix((total[last] - lower) * down[first] + (last - first).astype(np.uint64))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the offsets of each row's words among them.

    Works through windows of about 1 MB that end at white space or at a row's
    end; a single longer word makes its own window longer.
    """
    hashes, where, at = [], [], 0
    while at < len(data):
        end = min(at + WINDOW, len(data))
        while end < len(data):
            stretch = np.flatnonzero(_space[data[end : end + WINDOW]])
            row_end = offsets[np.searchsorted(offsets, end)]
            space = end + stretch[0] if len(stretch) else min(end + WINDOW, len(data))
            end = min(space, row_end)
            if len(stretch) or end == row_end:
                break
        rows = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, end)] - at
        first, codes = _window_words(data[at:end], rows)
        hashes.append(codes)
        where.append(first + at)
        at = end
    codes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    places = np.concatenate(where) if where else np.zeros(0, np.int64)
    return codes, np.searchsorted(places, offsets)


def shingle_hashes(words: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every ``width``-word shingle and the offsets of each row's.

    A row with fewer words, but at least one, has a single shingle of them all.
    """
    lengths = np.diff(rows)
    counts = np.where(lengths >= width, lengths - width + 1, (lengths > 0).astype(np.int64))
    total = np.zeros(len(words) + width, np.uint64)
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    for k in range(width):
        total[: len(words)] += padded[k : k + len(words)] * _shingle_code[k]
    out_rows = np.concatenate([[0], np.cumsum(counts)])
    row = np.repeat(np.arange(len(lengths)), counts)
    at = rows[row] + np.arange(out_rows[-1]) - out_rows[row]
    out = mix(total[at])
    for r in np.flatnonzero((lengths > 0) & (lengths < width)):
        own = words[rows[r] : rows[r + 1]]
        out[out_rows[r]] = mix(np.array([(own * _shingle_code[: len(own)]).sum() + np.uint64(len(own))], np.uint64))[0]
    return out, out_rows
