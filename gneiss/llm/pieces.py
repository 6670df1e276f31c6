"""SentencePiece encoding and decoding that keeps source offsets."""

from __future__ import annotations

import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.textbytes import bounded_batches, parts_of

_MARK = "▁".encode()
#: Kinds of pieces in a model: unknown, user-defined, byte.
_UNKNOWN, _USER, _BYTE = 2, 4, 6


class CharacterMap:
    """The compiled character map of a model: a double-array trie of source
    strings, each with an offset to its replacement in a block of C strings."""

    def __init__(self, compiled: bytes):
        if compiled:
            (size,) = struct.unpack_from("<I", compiled)
            self.units = np.frombuffer(compiled, "<u4", size // 4, 4).tolist()
            self.targets = compiled[4 + size :]
        else:
            self.units, self.targets = [], b""
        self.first = frozenset(b for b in range(1, 256) if self._leads(b)) if self.units else frozenset()

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & (1 << 9)) >> 6)

    def _leads(self, byte: int) -> bool:
        node = self._offset(self.units[0]) ^ byte
        return node < len(self.units) and self.units[node] & 0x800000FF == byte

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest source string at ``at`` and what replaces it."""
        best, node = None, self._offset(self.units[0])
        for i in range(at, len(text)):
            byte = text[i]
            node ^= byte
            if byte == 0 or node >= len(self.units) or self.units[node] & 0x800000FF != byte:
                break
            unit = self.units[node]
            node ^= self._offset(unit)
            if (unit >> 8) & 1:
                value = self.units[node] & 0x7FFFFFFF
                best = i + 1 - at, value
        return best and (best[0], self.targets[best[1] : self.targets.index(b"\0", best[1])])


def _char_length(lead: int) -> int:
    return 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


def _class(byte_values) -> re.Pattern:
    """A pattern for one of these bytes; for none of them, one that never matches."""
    return re.compile(b"[" + b"".join(b"\\x%02x" % b for b in sorted(byte_values)) + b"]" if byte_values else b"(?!)")


class Normaliser:
    """Longest-prefix normalisation through the compiled map that records, for
    every byte of the result, where its source begins and ends.

    A byte that is kept comes from itself; all bytes of a replacement, or of the
    mark of a space, come from the whole string that was replaced.  Stretches in
    which no string of the map can begin are aligned at once.  User-defined
    pieces are kept as they are.
    """

    def __init__(self, spec, kept: tuple[str, ...] = ()):
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.dummy, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        kept = sorted((k.encode() for k in kept), key=len, reverse=True)
        self.kept = re.compile(b"|".join(map(re.escape, kept)) or b"(?!)")
        self.starts = _class(self.map.first | {k[0] for k in kept})

    def _units(self, text: bytes):
        """``(source start, source end, replacement)`` from left to right; a
        replacement of None stands for the source itself, byte by byte."""
        at = 0
        while at < len(text):
            found = self.starts.search(text, at)
            to = found.start() if found else len(text)
            if to > at:
                yield at, to, None
            if not found:
                return
            same, mapped = self.kept.match(text, to), self.map.longest(text, to) if text[to] in self.map.first else None
            if mapped and not same:
                yield to, to + mapped[0], mapped[1]
                at = to + mapped[0]
            else:
                at = same.end() if same else to + _char_length(text[to])
                yield to, at, None

    def normalise(self, text: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The normalised bytes and, for each of them, its source start and end."""
        parts, begins, ends = [], [], []
        for begin, end, new in self._units(text):
            parts.append(text[begin:end] if new is None else new)
            own = np.arange(begin, end) if new is None else np.full(len(new), begin)
            begins.append(own)
            ends.append(own + 1 if new is None else np.full(len(new), end))
        none = np.zeros(0, np.int64)
        data, begin, end = np.frombuffer(b"".join(parts), np.uint8), np.concatenate([none, *begins]), np.concatenate([none, *ends])
        blank = data == 0x20
        if self.squeeze:  # no white space at either end, one space for a run
            keep = np.flatnonzero(~blank | np.append(False, ~blank)[: len(blank)])
            keep = keep[:-1] if len(keep) and blank[keep[-1]] else keep
            data, begin, end, blank = data[keep], begin[keep], end[keep], blank[keep]
        if not len(data):
            return b"", none, none
        normal = data.tobytes()
        if self.escape:
            times = np.where(blank, len(_MARK), 1)
            normal, begin, end = normal.replace(b" ", _MARK), np.repeat(begin, times), np.repeat(end, times)
        if self.dummy:
            space = _MARK if self.escape else b" "
            lead = np.full(len(space), begin[0])
            normal, begin, end = space + normal, np.concatenate([lead, begin]), np.concatenate([lead, end])
        return normal, begin, end


class PieceEncoder:
    """Encodes with the library and projects every piece onto the source's bytes."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        self.library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.normaliser = Normaliser(proto.normalizer_spec, tuple(p.piece for p in proto.pieces if p.type == _USER))
        # Bytes of normalised text that each id covers; an unknown piece's are its own.
        self.width = np.array([-1 if p.type == _UNKNOWN else 1 if p.type == _BYTE else len(p.piece.encode()) for p in proto.pieces], np.int64)
        self.eos = self.library.eos_id()

    def ids(self, texts: list[bytes]) -> list[list[int]]:
        """The library's ids of each text."""
        return self.library.encode([t.decode() for t in texts], num_threads=1)

    def encode(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per text: ids, and the ``len(ids) + 1`` source byte positions between pieces.

        The widths of the pieces tell which bytes of the normalised text each
        covers, and the alignment takes these to the source.
        """
        out = []
        for text, own in zip(texts, self.ids(texts), strict=True):
            ids = np.array(own, np.int32)
            width = self.width[ids]
            if (width < 0).any():
                surfaces = [len(p.piece.encode()) for p in self.library.encode(text.decode(), return_type="proto").pieces]
                width = np.where(width < 0, surfaces, width)
            normal, begins, _ = self.normaliser.normalise(text)
            at = np.concatenate([[0], np.cumsum(width)])
            if at[-1] != len(normal):
                raise ValueError(f"pieces cover {at[-1]} of {len(normal)} normalised bytes")
            out.append((ids, np.append(begins, len(text))[at]))
        return out


_encoders: dict[str, PieceEncoder] = {}


def opened(path: str) -> PieceEncoder:
    """The encoder of a model, opened once a worker; it keeps nothing of the texts."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(rows).astype(np.int32)))


def _encoder(path: str, add_end: bool, batch_bytes: int):
    def encode(batches):
        encoder = opened(path)
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary()).fill_null(b"")
            for at, to in parts_of(texts, batch_bytes):
                part = encoder.encode(texts.slice(at, to - at).to_pylist())
                ids = [np.append(i, np.int32(encoder.eos)) if add_end else i for i, _ in part]
                bounds = [np.append(b, b[-1]) if add_end else b for _, b in part]
                decoded = [encoder.library.decode(i.tolist()) for i in ids]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(at, to - at), _lists(ids), _lists(bounds), pa.array(decoded, pa.string())], ["id", "ids", "bounds", "decoded"]
                )

    return encode


def encode_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", add_end: bool = True, batch_bytes: int = 1 << 20) -> DataFrame:
    """``(id_col, ids, bounds, decoded)`` of every row, whole texts.

    ``ids`` are exactly the library's, with the end id where ``add_end`` holds.
    Every text also goes through the normaliser here, which records source
    alignment: piece k covers bytes ``bounds[k]`` to ``bounds[k + 1]`` of the
    source's UTF-8 (the end id covers none, nor does the mark before a text).
    A model whose pieces do not add up to the normalised text raises.
    ``decoded`` is the library's decoding.  The model is opened once a worker.
    A null or empty text has only the end id.  Ids may be null or repeat and
    pass through; other columns play no part.  There is no shuffle, and a task
    holds about ``batch_bytes`` of text with its pieces, or one longer text.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(_encoder(model_path, add_end, batch_bytes), f"id {kind}, ids array<int>, bounds array<int>, decoded string")
    return out.withColumnRenamed("id", id_col)


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(id_col, n_tokens, ids_sha256, decoded_sha256, bounds)`` of encoded documents."""
    return encoded.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "bounds",
    )
