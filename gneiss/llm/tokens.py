"""Token counts: batch encoding, each distinct word once, that returns lengths only."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import chain, filterfalse

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.textbytes import bounded_batches, parts_of

#: Before an ASCII blank behind a printable ASCII character or one of U+00C0 to U+00FF.
BOUNDARY = re.compile(rb"(?=[\x20\x09-\x0d])(?:(?<=[\x21-\x7e])|(?<=\xc3[\x80-\xbf]))")
#: What lies between boundaries: blanks and a word, and more of both while no boundary parts them.
WORD = re.compile(rb"\s*+[^\s]++(?:(?<![\x21-\x7e])(?<!\xc3[\x80-\xbf])\s++[^\s]*+)*+|\s++")
#: Words whose counts a worker keeps (about 120 MB), and bytes of the longest of them.
MOST_WORDS, LONGEST_WORD = 1 << 20, 64
#: In a pre-tokenizer's pattern: a class without white space; then whatever could match white space, or look ahead or behind.
_BLANKLESS = re.compile(r"\[\^\\s[^\]\\]*(?:\\p\{\w+\}|\\[dw])*\]|\[?\\p\{[LN]\w*\}\]?")
_BLANKS = re.compile(r"\\[sSWDXRbB]|\\[pP]\{|\[\^|\.|\(\?|[ \t\n]|\\[nrtfvx]")


def _keeps_boundaries(part: dict | None) -> bool:
    """Whether a normaliser changes no text across, or for lack of, a neighbour behind a boundary."""
    kind = part and part["type"]
    if kind == "Sequence":
        return all(map(_keeps_boundaries, part["normalizers"]))
    # Composition never reaches over a blank, letters change case one by one, and blanks stay blanks.
    return kind in (None, "NFC", "NFD", "NFKC", "NFKD", "Lowercase") or kind == "Replace" and part["pattern"] == {"Regex": r"\s+"} and part["content"] == " "


def _parts_at_boundaries(part: dict | None) -> bool:
    """Whether a pre-tokenizer begins a new piece at every boundary, whatever stands before it."""
    kind = part and part["type"]
    if kind == "Sequence":
        first, *rest = part["pretokenizers"]
        return _parts_at_boundaries(first) and all(x["type"] == "ByteLevel" and not x["use_regex"] and not x["add_prefix_space"] for x in rest)
    if kind == "ByteLevel":  # its own pattern: blanks only at the start of a piece, or alone
        return part["use_regex"] and not part["add_prefix_space"]
    if kind == "Split":  # only matches are kept, and none holds a blank
        pattern = part["pattern"].get("Regex")
        return bool(pattern) and part["behavior"] == "Removed" and part["invert"] and not _BLANKS.search(_BLANKLESS.sub("", pattern))
    return kind in ("Whitespace", "WhitespaceSplit", "BertPreTokenizer")


class TextCounter:
    """Token counts of texts, as the library for the file gives them.

    A tokenizers .json is encoded in batches; where the rules in the file show
    that a piece begins at every boundary (an ASCII blank behind a printable
    ASCII character or a letter of Latin-1), texts are cut there: a text's count
    is the sum of its words', and a batch encodes only words that are not known
    yet.  Counts of at most MOST_WORDS short words are kept; beyond that all are
    forgotten.  Else, and for a SentencePiece .model, texts are encoded whole,
    and nothing of a text is kept behind its batch.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.known: dict[bytes, int] = {}
        if path.endswith(".model"):
            from gneiss.llm.pieces import opened

            self.cuts, self.lengths = False, lambda texts: list(map(len, opened(path).ids(texts)))
            return
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        self.cuts = (
            _keeps_boundaries(rules["normalizer"])
            and _parts_at_boundaries(rules["pre_tokenizer"])
            and not any(BOUNDARY.search(t["content"].encode()) or t["lstrip"] or t["rstrip"] or t["single_word"] for t in rules["added_tokens"])
        )
        self.lengths = lambda texts: list(map(len, tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)))

    def counts(self, texts: list[bytes], part_bytes: int) -> list[int]:
        """The count of each text, from parts of about ``part_bytes``."""
        totals = [0] * len(texts)
        for group in balanced(texts, part_bytes, self.cuts):
            parts = [part for _, part in group]
            for (row, _), n in zip(group, self._by_words(parts) if self.cuts else self.lengths(parts), strict=True):
                totals[row] += n
        return totals

    def _by_words(self, parts: list[bytes]) -> list[int]:
        words = [WORD.findall(part) for part in parts]
        if len(self.known) + sum(map(len, words)) > MOST_WORDS:
            self.known.clear()
        new = list(set(filterfalse(self.known.__contains__, chain.from_iterable(words))))
        self.known.update(zip(new, self.lengths(new), strict=True))
        counts = [sum(map(self.known.__getitem__, own)) for own in words]
        for w in new:
            if len(w) > LONGEST_WORD:
                del self.known[w]
        return counts


def balanced(texts: list[bytes], most: int, cuts: bool = True) -> Iterator[list[tuple[int, bytes]]]:
    """Lists of ``(row, part)`` of about ``most`` bytes each.

    With ``cuts``, a longer text is parted at the first boundary behind every
    ``most`` bytes; parts of one row may lie in several lists.
    """
    group, size = [], 0
    for row, text in enumerate(texts):
        at = 0
        while at < len(text):
            found = BOUNDARY.search(text, at + most) if cuts and len(text) - at > most else None
            end = found.start() if found else len(text)
            group.append((row, text[at:end]))
            size += end - at
            at = end
            if size >= most:
                yield group
                group, size = [], 0
    if group:
        yield group


_counters: dict[str, TextCounter] = {}


def _counter(path: str, part_bytes: int):
    def count(batches):
        if path not in _counters:
            _counters[path] = TextCounter(path)
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary()).fill_null(b"")
            for at, to in parts_of(texts, 16 * part_bytes):
                raw = texts.slice(at, to - at).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(at, to - at), pa.array(list(map(len, raw)), pa.int64()), pa.array(_counters[path].counts(raw, part_bytes), pa.int64())], ["id", "n_bytes", "n_tokens"]
                )

    return count


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, part_bytes: int = 1 << 16) -> DataFrame:
    """``(id_col, n_bytes, n_tokens, over_limit)`` of every row, whole texts.

    ``tokenizer_path`` is a tokenizers .json or a SentencePiece .model; it is
    opened once a worker, on the executor.  No tokens are added, nothing is
    truncated or padded; special strings inside a text count as the library
    handles them.  Texts travel as Arrow batches and are encoded about
    ``part_bytes`` at a time, in words where that is safe, each word that a
    worker knows only once; only lengths come back.  A null or empty text has 0 bytes and 0 tokens; ids may
    be null or repeat and are passed through; other columns play no part.
    There is no shuffle.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    counted = rows.mapInArrow(_counter(tokenizer_path, part_bytes), f"id {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
