"""Order MinHash fingerprints (Marçais, DeBlasio, Pandey and Kingsford, 2019): signatures sensitive to edit distance.

Every run of ``K`` code points counts with its occurrence number in the text, (k-mer, 1st), (k-mer, 2nd) and so on, and is
hashed to a place on a circle. The ``SIGNATURES`` orders are that circle begun at as many equidistant points: the order's
``PICKED`` minimal k-mers are the next ones clockwise. They are put back in text order and the tuple is hashed to 16 bits;
the fingerprint is the list of these hashes, the likeness of two texts the share of equal ones.

A text shorter than ``K`` is one k-mer. An empty text has no k-mer; its fingerprint is all zeros.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm import textops
from engram.llm.textops import limit_arrow, mix

K = 8
SIGNATURES = 64
PICKED = 2
KEPT = 16  # k-mers wanted from each point of the circle before the nearest are taken
ROWS_PER_RANGE = 1000
MOST_RANGES = 10_000
SLICE_CHARS = 1 << 20
NO_ID = -(1 << 63)
_U = np.uint64
_MASK24 = _U((1 << 24) - 1)


def _occurrences(hashes: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, occurrence number) of every k-mer. Places are in text order, so equal k-mers of one text stay together."""
    n = len(hashes)
    if n < 1 << 24:
        key = np.sort((hashes & ~_MASK24) | np.arange(n, dtype=_U))
        place = (key & _MASK24).astype(np.int64)
        value = key >> _U(24)
    else:
        value = hashes >> _U(24)
        place = np.argsort(value, kind="stable")
        value = value[place]
    owner = texts[place]
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    index = np.arange(n)
    begun = np.maximum.accumulate(np.where(fresh, index, 0))
    return place, index - begun


def fingerprints(strings: list[str]) -> np.ndarray:
    """A row of SIGNATURES 16-bit hashes for each string."""
    total = len(strings)
    out = np.zeros((total, SIGNATURES), dtype=np.uint16)
    codes = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.fromiter(map(len, strings), dtype=np.int64, count=total)
    ends = np.cumsum(lengths)
    if not len(codes):
        return out
    power, inverse = textops._powers(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, dtype=_U)
    np.cumsum((codes.astype(_U) + _U(1)) * power[:-1], out=sums[1:])
    n_kmers = np.where(lengths > 0, np.maximum(lengths - K + 1, 1), 0)
    texts = np.repeat(np.arange(total), n_kmers)
    first = np.cumsum(n_kmers) - n_kmers
    begin = np.arange(len(texts)) + (ends - lengths - first)[texts]
    width = np.minimum(lengths, K)
    del codes
    hashes = mix((sums[begin + width[texts]] - sums[begin]) * inverse[begin])
    del sums, begin
    place, occurrence = _occurrences(hashes, texts)
    spot = mix((hashes[place] >> _U(24)) * _U(0x9FB21C651E98DF25) + occurrence.astype(_U) * _U(0xD6E8FEB86659FD93))
    owner = texts[place]

    # of a long text, the k-mers close behind a point of the circle are picked if there are enough behind every point
    within = (spot << _U(6)) >> _U(42)
    near = np.minimum(KEPT * SIGNATURES / np.maximum(n_kmers, 1), 1.0) * float(1 << 22)
    keep = within < near[owner]
    del within
    if (cut := n_kmers > KEPT * SIGNATURES).any():
        behind = np.bincount(owner[keep] * SIGNATURES + (spot[keep] >> _U(58)).astype(np.int64), minlength=total * SIGNATURES)
        lacking = cut & (behind.reshape(total, SIGNATURES) < PICKED).any(axis=1)
        if lacking.any():
            keep |= lacking[owner]
    spot, place, owner = spot[keep], place[keep], owner[keep]
    order = np.lexsort((place, spot, owner)) if total > 1 << 12 or len(texts) >= 1 << 24 else None
    if order is None:
        key = np.sort((owner.astype(_U) << _U(52)) | ((spot >> _U(36)) << _U(24)) | place.astype(_U))
        place, owner, spot = (key & _MASK24).astype(np.int64), (key >> _U(52)).astype(np.int64), (key >> _U(24)) & _U((1 << 28) - 1)
    else:
        place, owner, spot = place[order], owner[order], spot[order] >> _U(36)
    has = np.flatnonzero(n_kmers)
    counts = np.bincount(owner, minlength=total)[has]
    low = np.cumsum(counts) - counts
    points = np.arange(SIGNATURES, dtype=np.int64) << 22
    circle = (owner << 28) | spot.astype(np.int64)
    at = np.searchsorted(circle, ((has << 28)[:, None] | points).ravel()).reshape(len(has), SIGNATURES) - low[:, None]
    picked = np.stack([place[low[:, None] + (at + j) % counts[:, None]] for j in range(PICKED)])
    picked.sort(axis=0)
    signature = np.zeros(at.shape, dtype=_U)
    for j in range(PICKED):
        signature = mix(signature * _U(0x9E3779B97F4A7C15) + hashes[picked[j]])
    out[has] = (signature >> _U(48)).astype(np.uint16)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=-1)


def edited(text: str, following: str) -> str:
    r = len(text) // 3
    return text[: len(text) - r] + following[:r]


def _ranged(bounds: list[int]):
    """Deal rows to ranges of descending doc_id; the largest row of a range is also shown to the range before it."""
    edges = np.array(bounds, dtype=np.int64)  # descending; range k holds ids in (edges[k + 1], edges[k]]; null is below all

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            k = len(edges) - np.searchsorted(edges[::-1], ids, side="left") - 1
            k = np.maximum(k, 0)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(np.zeros(len(k), bool)), *batch.columns], ["range", "shown", *batch.schema.names])
            heads = np.flatnonzero(ids == edges[k])
            if len(heads):
                part = batch.take(pa.array(heads))
                before = (k[heads] - 1) % len(edges)
                yield pa.RecordBatch.from_arrays([pa.array(before, pa.int64()), pa.array(np.ones(len(heads), bool)), *part.columns], ["range", "shown", *batch.schema.names])

    return run


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by range, shown and descending doc_id: fingerprints of each text and of its edited text."""
    waiting: list[tuple] = []  # (range, doc_id, text, shown)

    def ready(rows: list[tuple]) -> pa.RecordBatch:
        """Results of all rows but the last, which is only the last one's follower."""
        pairs = [(a, b) for a, b in zip(rows, rows[1:], strict=False) if not a[3] and a[0] == b[0]]
        strings = [r[2] for r in rows]
        changed = [edited(a[2], b[2]) for a, b in pairs]
        prints = fingerprints(strings + changed)
        index = {id(r): i for i, r in enumerate(rows)}
        own = np.array([index[id(a)] for a, _ in pairs], dtype=np.int64)
        after = np.array([index[id(b)] for _, b in pairs], dtype=np.int64)
        altered = prints[len(rows) :]
        hexed = lambda m: [x.tobytes().hex() for x in m.astype(">u2")]
        columns = [
            [a[1] for a, _ in pairs],
            [len(a[2]) for a, _ in pairs],
            [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in changed],
            hexed(prints[own]),
            hexed(altered),
            likeness(prints[own], altered).tolist() if pairs else [],
            likeness(prints[own], prints[after]).tolist() if pairs else [],
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)

    size = 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("range", "doc_id", "text", "shown")), strict=True):
            waiting.append((row[0], row[1], row[2] or "", row[3]))
            size += len(waiting[-1][2])
            if size > SLICE_CHARS // 2 or len(waiting) >= 2000:
                yield ready(waiting)
                waiting = waiting[-1:]
                size = len(waiting[0][2])
    if waiting:
        yield ready(waiting)


def compare_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text: the last third of its code points replaced by the first of the next.

    The next document is the one with the next smaller doc_id (the smallest is followed by the largest). Columns doc_id and
    text are read, others ignored; a null text is empty. Rows with a null doc_id come behind all others. Rows that repeat
    a doc_id, or have none, follow each other by text. A single row follows itself; an empty table gives an empty result.
    """
    rows = limit_arrow(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = rows.count()
    ranges = max(1, min(MOST_RANGES, n // ROWS_PER_RANGE))
    shares = [(ranges - k) / ranges for k in range(ranges)]
    # percentiles are ids of the table, so the largest id of each range is known without a further pass
    found = rows.agg(F.percentile_approx("doc_id", shares, 20 * max(ranges, 50)).alias("p"), F.max("doc_id").alias("top")).first()
    bounds = sorted({*(found["p"] or []), found["top"]}, reverse=True) if found["top"] is not None else [NO_ID]
    dealt = rows.mapInArrow(_ranged(bounds), "range long, shown boolean, doc_id long, text string")
    ordered = dealt.repartition("range").sortWithinPartitions("range", "shown", F.col("doc_id").desc(), "text")
    return ordered.mapInArrow(_compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
