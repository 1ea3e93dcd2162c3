"""Token counts by a public tokenizer, with overlap resynchronisation for huge texts.

A text is cut before every single space that stands between two other characters. In a byte-level pre-tokeniser
such a space always opens a new piece, whatever is around it, so the parts encode alone as they do in the text
(a special string has no space and is never cut). Each distinct part is encoded once by the library and remembered. A
part that is a run of Latin letters and then plain marks is one piece for the letters and the pieces of the marks; its
letters go to the library's merge model directly, as most of an encoding's time is spent on splitting.

A text longer than ``chunk_chars`` is not held as one encoding: overlapping chunks are encoded with offsets, and two
neighbours are spliced where both start a piece at the same character, well before the first one's end. From a common
start the rest of the split depends on the rest of the text alone, so the splice is exact. Where the overlap has no
such place, it is doubled, up to the whole rest.
"""

from __future__ import annotations

import bisect
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.textops import limit_arrow

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 512
MARGIN_CHARS = 64
CACHE_PARTS = 400_000
SPECIAL_MARK = "<|"

_CUT = re.compile(r"(?<=\S) (?=\S)")
# letters below U+0250, then marks that open a piece of their own and belong to no contraction or special string
_PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!\"#$%&()*+,\-./:;=?@\[\\\]^_`{}~]*)")
_loaded: dict[str, PartCounter] = {}


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: a visible byte stands for itself, the others for the characters from U+0100 on."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(rest)}


_BYTES = byte_letters()
_AS_TEXT = [_BYTES[b] for b in range(256)]


def load(path: str) -> PartCounter:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    if path not in _loaded:
        _loaded[path] = PartCounter(Tokenizer.from_file(path))
    return _loaded[path]


def piece_starts(encoding, least: int = 0) -> list[tuple[int, int]]:
    """(character, token number) of each token that opens a piece at character ``least`` or later."""
    offsets, pieces = encoding.offsets, encoding.word_ids
    first = bisect.bisect_left(offsets, (least, 0))
    return [(offsets[k][0], k) for k in range(first, len(offsets)) if pieces[k] is None or k == 0 or pieces[k] != pieces[k - 1]]


def count_spliced(tokenizer, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS, margin: int = MARGIN_CHARS) -> int:
    """Number of tokens of ``text``, encoded in overlapping chunks."""
    encode = lambda a, b: tokenizer.encode(text[a:b], add_special_tokens=False)
    total, start, end = 0, 0, min(chunk, len(text))
    now = encode(start, end)
    first = 0  # tokens of this chunk before it are counted already
    while end < len(text):
        width = overlap
        while True:
            begin = max(start + 1, end - width)
            stop = min(len(text), begin + max(chunk, 2 * width))
            after = encode(begin, stop)
            # the last pieces of a chunk may go on behind its end
            here = {start + at: k for at, k in piece_starts(now, begin - start)[:-2] if start + at <= end - margin and k >= first}
            place = next(((k, here[begin + at]) for at, k in piece_starts(after)[1:] if begin + at in here), None)
            if place is not None:
                break
            if begin == start + 1:  # no common place at all: one longer chunk
                end = min(len(text), end + max(chunk, end - start))
                now = encode(start, end)
                if end == len(text):
                    return total + len(now.ids) - first
                continue
            width *= 2
        total += place[1] - first
        now, start, end, first = after, begin, stop, place[0]
    return total + len(now.ids) - first


def parts_of(text: str) -> list[str]:
    """The text's independent parts; all but the first get their space back when they are encoded."""
    return _CUT.split(text)


class PartCounter:
    """Counts the tokens of texts from the counts of their parts, each of which the library gives once."""

    def __init__(self, tokenizer):
        self.tokenizer, self.merge = tokenizer, tokenizer.model.tokenize
        self.spaced: dict[str, int] = {}  # parts that follow a space
        self.bare: dict[str, int] = {}  # parts that follow a line end

    def encoded(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False))

    def piece(self, part: str, space: str) -> int:
        if (m := _PLAIN.fullmatch(part)) is None:
            return self.encoded(space + part)
        letters, marks = m.groups()
        known = self.spaced if space else self.bare
        if (n := known.get(letters)) is None:
            n = known[letters] = len(self.merge("".join(map(_AS_TEXT.__getitem__, (space + letters).encode()))))
        if marks:
            if (k := self.bare.get(marks)) is None:
                k = self.bare[marks] = self.encoded(marks)
            n += k
        return n

    def learn(self, part: str) -> bool:
        """False if the part is empty or has white space at an end: then its text has other parts."""
        if not part or part != part.strip():
            return False
        lines = part.split("\n")
        if len(lines) == 1:
            self.spaced[part] = self.piece(part, " ")
            return True
        if any(not x or x != x.strip() for x in lines) or SPECIAL_MARK in part:
            self.spaced[part] = self.encoded(" " + part)
            return True
        # a single line end between two other characters is a piece of its own
        n = self.spaced[lines[0]] = self.piece(lines[0], " ")
        for x in lines[1:]:
            if (k := self.bare.get(x)) is None:
                k = self.bare[x] = self.piece(x, "")
            n += k + self.line_end
        self.spaced[part] = n
        return True

    def count(self, text: str) -> int:
        self.line_end = self.bare.get("\n") or self.bare.setdefault("\n", self.encoded("\n"))
        first, *rest = text.split(" ")
        if len(self.spaced) + len(self.bare) > CACHE_PARTS:
            self.spaced.clear()
            self.bare.clear()
        spaced = self.spaced
        if first and first == first.strip() and all(p in spaced or self.learn(p) for p in set(rest)):
            return self.encoded(first) + sum(map(spaced.__getitem__, rest))
        first, *rest = parts_of(text)
        return self.encoded(first) + sum(spaced[p] if p in spaced else self.encoded(" " + p) for p in rest)


def counter(path: str, chunk_chars: int, overlap_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = load(path)

        def count(text: str) -> int:
            if not text:
                return 0
            if len(text) > chunk_chars:
                return count_spliced(parts.tokenizer, text, chunk_chars, overlap_chars)
            return parts.count(text)

        for batch in batches:
            counts = [count(t or "") for t in batch.column("text").to_pylist()]
            kept = [batch.column(c) for c in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(counts, pa.int64())], [*batch.schema.names[:-1], "n_tokens"])

    return run


def count_tokens(docs: DataFrame, path: str, limit: int = 512, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of ``docs`` (columns doc_id and text; others are ignored).

    A null text counts as empty (0 bytes, 0 tokens); repeated rows give repeated results; an empty table an empty one.
    """
    df = limit_arrow(docs).select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "text")
    out = df.mapInArrow(counter(path, chunk_chars, overlap_chars), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
