"""Suffix-array removal of repeated byte strings, across and inside documents.

1. Every ``LENGTH``-byte window of a text has one anchor, the smallest hash of the ``GRAM``-byte strings inside it. Neighbouring
   windows with one anchor form a region; equal windows have equal anchors and so fall to one anchor hash, wherever they are.
2. Regions are records of a few integers, sent as arrays. An anchor hash that occurs once in the corpus can hold no repeat and
   is dropped. Regions that equal each other are folded into one with a count before anything else is moved, so a passage
   that a third of all documents share is one region with a large count; if its anchor has no other region, it is done.
3. The distinct regions' bytes are dealt to shards by anchor hash. Each shard is suffix-sorted by induction; permuted common
   prefixes tell which windows occur again. A region's windows also repeat if it was folded. The regions of one anchor whose
   bytes exceed ``HOT_BYTES`` (a short string in very many surroundings) are not held in one task: their windows are dealt by
   digest, and those with equal ones repeat.
4. The repeated windows of each region go back to all its places, and every byte that a repeated window covers is removed.

Documents are kept in a bucketed table by row number, so the two joins that need their texts don't move them. Regions are
told apart by the 64-bit hash of their anchor and a 64-bit digest of all their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm import packed, suffix_sort, textops
from engram.llm.buckets import bucketed, number_for
from engram.llm.textops import limit_arrow, mix
from engram.session import free_shuffles, materialise, shuffle_partitions

LENGTH = 200
GRAM = 24
SHARD_BYTES = 1 << 21
HOT_BYTES = 1 << 26  # of one anchor's regions; beyond it their windows are dealt by digest
HELD_REGIONS = 1 << 17
PIECE = 1 << 18  # windows of a very long text that are read at once
SALTS, SALTED_FROM = 64, 1000
_U = np.uint64


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` consecutive values (van Herk's two running minima)."""
    n = len(values)
    whole = -(-n // width) * width
    padded = np.full(whole, np.iinfo(np.uint64).max, dtype=_U)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - width + 1
    return np.minimum(behind[:m], ahead[width - 1 : width - 1 + m])


def regions(data: np.ndarray, offs: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, anchor hash, digest, first window, number of windows) of the regions of consecutive texts."""
    n = len(data)
    z = np.zeros(0, dtype=np.int64)
    per_row = np.maximum(np.diff(offs) - length + 1, 0)
    total = int(per_row.sum())
    if not total:
        return z, z.view(_U), z.view(_U), z, z
    power, inverse = textops._powers(n + 1)
    sums = np.zeros(n + 1, dtype=_U)
    np.cumsum(data.astype(_U) * power[:-1] + power[:-1], out=sums[1:])
    m = n - gram + 1
    grams = mix((sums[gram:] - sums[:-gram]) * inverse[:m])
    low = _U((1 << max(26, int(m).bit_length())) - 1)  # low bits hold the place: of equal grams the first one counts
    least = sliding_least((grams & ~low) | np.arange(m, dtype=_U), length - gram + 1)
    before = np.cumsum(per_row) - per_row
    start = np.arange(total) + np.repeat(offs[:-1] - before, per_row)
    anchor = (least[start] & low).astype(np.int64)
    fresh = np.ones(total, dtype=bool)
    fresh[1:] = anchor[1:] != anchor[:-1]
    fresh[before[per_row > 0]] = True
    begin = np.flatnonzero(fresh)
    count = np.diff(np.append(begin, total))
    a = start[begin]
    row = np.repeat(np.arange(len(per_row)), np.add.reduceat(fresh, before[per_row > 0], dtype=np.int64)) if per_row.all() else np.searchsorted(offs, a, side="right") - 1
    digest = mix((sums[a + count + length - 1] - sums[a]) * inverse[a] + count.astype(_U))
    return row, grams[anchor[begin]], digest, a - offs[row], count


def _pieces(offs: np.ndarray, length: int, piece: int) -> Iterator[tuple[int, int, int, int]]:
    """(first row, last row, first byte, last byte): slices of texts, and overlapping pieces of a very long one."""
    for i, j in textops.slices(offs):
        a, b = int(offs[i]), int(offs[j])
        step = max(piece, 4 * length)
        for at in range(a, max(a + 1, b - length + 1), step) if j == i + 1 and b - a > 2 * step else (a,):
            yield i, j, at, (min(b, at + step + length - 1) if j == i + 1 and b - a > 2 * step else b)


_REGIONS = "part int, anchor binary, digest binary, rid binary, first binary, windows binary"
_FOUND = "rid long, anchor long, digest long, first long, windows int, copies long, alone boolean, head boolean, hot boolean"


def _records(length: int, gram: int, parts: int, piece: int):
    """Rows (rid, text) to the regions of each part of the anchors, as arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            anchor, digest, rid, first, windows = (np.concatenate(x) for x in zip(*held, strict=True))
            part = (mix(anchor) % _U(parts)).astype(np.int32)
            return packed.dealt(part, {"anchor": anchor, "digest": digest, "rid": rid, "first": first, "windows": windows.astype(np.int32)})

        for batch in batches:
            data, offs = textops.text_buffers(batch.column(1))
            rids = batch.column(0).to_numpy()
            for i, j, a, b in _pieces(offs, length, piece):
                row, anchor, digest, first, count = regions(data[a:b], np.clip(offs[i : j + 1], a, b) - a, length, gram)
                if len(row):
                    held.append((anchor, digest, rids[row + i], first + (a - offs[i] if j == i + 1 else 0), count))
                    size += len(row)
            if size > HELD_REGIONS:
                yield out()
                held.clear()
                size = 0
        if size:
            yield out()

    return run


def _recurring(length: int, hot_bytes: int):
    """Of each part the regions whose anchor occurs again: copies (of the region), alone (the anchor has no other region),
    head (the first of its copies), hot (the anchor's regions hold too many bytes for one task)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in packed.grouped(batches, "part"):
            anchor = packed.joined(rows, "anchor", _U)
            values, counts = np.unique(anchor, return_counts=True)
            again = np.flatnonzero((counts > 1)[np.searchsorted(values, anchor)])
            anchor = anchor[again]
            digest, rid, first, windows = (packed.joined(rows, c, t)[again] for c, t in (("digest", _U), ("rid", np.int64), ("first", np.int64), ("windows", np.int32)))
            order = np.lexsort((first, rid, digest, anchor))
            anchor, digest, rid, first, windows = (x[order] for x in (anchor, digest, rid, first, windows))
            if not len(anchor):
                continue
            new = np.append(True, anchor[1:] != anchor[:-1])
            head = new | np.append(True, digest[1:] != digest[:-1])
            group, region = np.cumsum(new) - 1, np.cumsum(head) - 1
            copies = np.bincount(region)[region]
            alone = (np.bincount(group, head) == 1)[group]
            hot = (np.bincount(group, head * (windows + length - 1.0)) > hot_bytes)[group]
            for i in range(0, len(anchor), 1 << 16):
                some = slice(i, i + (1 << 16))
                columns = (rid, anchor.view(np.int64), digest.view(np.int64), first, windows, copies, alone, head, hot)
                yield pa.RecordBatch.from_arrays([pa.array(c[some]) for c in columns], [x.split()[0] for x in _FOUND.split(", ")])

    return run


def _fetch(length: int):
    """Rows (text, wanted regions) to rows (anchor, digest, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = textops.text_buffers(batch.column(0))
            wanted = batch.column(1)
            rows = np.repeat(np.arange(len(wanted)), np.diff(wanted.offsets.to_numpy()))
            flat = wanted.flatten()
            begin = offs[rows] + flat.field("first").to_numpy()
            size = flat.field("windows").to_numpy().astype(np.int64) + length - 1
            for i in range(0, len(begin), 8192):
                b, s = begin[i : i + 8192], size[i : i + 8192]
                cut = np.concatenate([np.zeros(1, np.int64), np.cumsum(s)])
                inner = np.arange(cut[-1]) + np.repeat(b - cut[:-1], s)
                blob = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(b), [None, pa.py_buffer(cut), pa.py_buffer(data[inner])]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([*(flat.field(c).slice(i, len(b)) for c in ("anchor", "digest", "copies", "hot")), blob], ["anchor", "digest", "copies", "hot", "bytes"])

    return run


def _shards(length: int, shard_bytes: int):
    """Rows sorted by anchor: suffix-sort runs of whole anchors, and tell which windows of each region are repeated."""

    def solve(held: list[tuple]) -> pa.RecordBatch:
        marks = suffix_sort.repeated([x[3] for x in held], length)
        anchor, digest, spans = [], [], []
        for (a, d, copies, _), twice in zip(held, marks, strict=True):
            if copies > 1:
                found = [0, len(twice)]
            else:
                edge = np.flatnonzero(np.diff(np.concatenate([[False], twice, [False]]).astype(np.int8)))
                found = edge.tolist()
            if found:
                anchor.append(a)
                digest.append(d)
                spans.append(found)
        return pa.RecordBatch.from_arrays([pa.array(anchor, pa.int64()), pa.array(digest, pa.int64()), pa.array(spans, pa.list_(pa.int32()))], ["anchor", "digest", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for x in zip(*(batch.column(c).to_pylist() for c in ("anchor", "digest", "copies", "bytes")), strict=True):
                if size > shard_bytes and held[-1][0] != x[0]:
                    yield solve(held)
                    held, size = [], 0
                held.append(x)
                size += len(x[3])
        if held:
            yield solve(held)

    return run


_WINDOWS = "part int, value binary, anchor binary, digest binary, at binary"
_TWICE = "anchor long, digest long, part int, at binary"


def _windows(length: int, parts: int):
    """Rows (anchor, digest, bytes) of hot anchors to digests of their windows, as arrays for each part of the digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = textops.text_buffers(batch.column("bytes"))
            keys = [batch.column(c).to_numpy() for c in ("anchor", "digest")]
            for i, j in textops.slices(offs):
                part, at = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                per_row = np.diff(at) - length + 1
                power, inverse = textops._powers(len(part) + 1)
                sums = np.zeros(len(part) + 1, dtype=_U)
                np.cumsum(part.astype(_U) * power[:-1] + power[:-1], out=sums[1:])
                inner = np.arange(per_row.sum()) - np.repeat(np.cumsum(per_row) - per_row, per_row)
                start = inner + np.repeat(at[:-1], per_row)
                value = mix((sums[start + length] - sums[start]) * inverse[start])
                anchor, digest = (np.repeat(k[i:j], per_row) for k in keys)
                yield packed.dealt((value % _U(parts)).astype(np.int32), {"value": value, "anchor": anchor, "digest": digest, "at": inner.astype(np.int32)})

    return run


def _twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each part the windows whose digest occurs again, region by region."""
    for part, rows in packed.grouped(batches, "part"):
        value, anchor, digest = (packed.joined(rows, c, t) for c, t in (("value", _U), ("anchor", np.int64), ("digest", np.int64)))
        values, counts = np.unique(value, return_counts=True)
        again = np.flatnonzero((counts > 1)[np.searchsorted(values, value)])
        at = packed.joined(rows, "at", np.int32)[again]
        anchor, digest = anchor[again], digest[again]
        order = np.lexsort((at, digest, anchor))
        at, anchor, digest = at[order], anchor[order], digest[order]
        begin = np.flatnonzero(np.append(len(at) > 0, (anchor[1:] != anchor[:-1]) | (digest[1:] != digest[:-1])))
        ends = np.append(begin, len(at))[1:]
        blobs = [packed.blob(at[i:j]) for i, j in zip(begin.tolist(), ends.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(anchor[begin]), pa.array(digest[begin]), pa.array(np.full(len(begin), part, np.int32)), pa.array(blobs, pa.binary())], ["anchor", "digest", "part", "at"])


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, digest, windows, copies, found) to the runs of repeated windows; a region with copies repeats whole."""
    for batch in batches:
        spans = []
        for windows, copies, found in zip(*(batch.column(c).to_pylist() for c in ("windows", "copies", "found")), strict=True):
            mark = np.zeros(windows + 2, dtype=np.int8)
            if copies > 1:
                mark[1:-1] = 1
            for x in found or []:
                mark[packed.numbers(x, np.int32) + 1] = 1
            spans.append(np.flatnonzero(np.diff(mark)).tolist())
        yield pa.RecordBatch.from_arrays([batch.column("anchor"), batch.column("digest"), pa.array(spans, pa.list_(pa.int32()))], ["anchor", "digest", "spans"])


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.large_string())])


def _remove(length: int, with_text: bool):
    """Rows (doc_id, text, spans of repeated windows) to results; ``kept`` drops bytes of broken characters at the cuts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = textops.text_buffers(batch.column(1))
            lists = batch.column(2)
            owner = np.repeat(np.arange(batch.num_rows), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            spans = lists.flatten()
            a, b = (spans.field(c).to_numpy(zero_copy_only=False).astype(np.int64) + offs[owner] for c in ("a", "b"))
            change = np.bincount(a, minlength=len(data) + 1) - np.bincount(np.minimum(b - 1 + length, offs[owner + 1]), minlength=len(data) + 1)
            gone = np.cumsum(change[:-1]) > 0
            opens = gone.copy()
            opens[1:] &= ~gone[:-1]
            inner = offs[:-1][offs[:-1] < offs[1:]]
            opens[inner] = gone[inner]  # a text begins a span of its own
            removed, starts = (np.concatenate([[0], np.cumsum(x)])[offs] for x in (gone, opens))
            left = offs - removed
            rest = data[~gone].tobytes()
            kept = [rest[left[k] : left[k + 1]] for k in range(batch.num_rows)]
            columns = [np.diff(offs), np.diff(removed), np.diff(starts), [hashlib.sha256(x).hexdigest() for x in kept], [x.decode("utf-8", "ignore") if with_text else None for x in kept]]
            fields = list(_RESULT)[1:]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(columns, fields, strict=True))], _RESULT.names)

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, with_text: bool = False, hot_bytes: int = HOT_BYTES, piece: int = PIECE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 (and ``kept`` if asked for) of every row of ``docs``.

    Columns doc_id and text are read, others ignored. Bytes are judged on the input: each byte that a ``length``-byte string
    covers which starts anywhere else as well is removed, overlaps included. A null text is empty; a text shorter than
    ``length`` keeps everything; repeated rows are documents of their own, so their long texts go entirely; an empty table
    gives no rows. ``gram`` must not exceed ``length``.
    """
    spark = docs.sparkSession
    parts = max(shuffle_partitions(spark), 64)
    gram = min(gram, length)
    numbered = limit_arrow(docs).select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = number_for(docs)
    kept = bucketed(numbered, "rid", "suffix", n)

    sent = kept.select("rid", "text").mapInArrow(_records(length, gram, parts, piece), _REGIONS)
    found = sent.repartition("part").sortWithinPartitions("part").mapInArrow(_recurring(length, hot_bytes), _FOUND)
    found = materialise(found, "regions")
    free_shuffles(spark)
    # an anchor of one region needs no sorting: its copies are equal as they are
    open_heads = found.where("head AND NOT alone")
    wanted = open_heads.repartition(n, "rid").groupBy("rid").agg(F.collect_list(F.struct("first", "windows", "anchor", "digest", "copies", "hot")).alias("wanted"))
    blobs = kept.select("rid", "text").join(wanted, "rid").select("text", "wanted").mapInArrow(_fetch(length), "anchor long, digest long, copies long, hot boolean, bytes binary")
    solved = blobs.where("NOT hot").repartition("anchor").sortWithinPartitions("anchor", "digest").mapInArrow(_shards(length, shard_bytes), "anchor long, digest long, spans array<int>")
    if not found.where("hot AND NOT alone").isEmpty():
        dealt = blobs.where("hot").mapInArrow(_windows(length, parts), _WINDOWS).repartition("part").sortWithinPartitions("part")
        twice = dealt.mapInArrow(_twice, _TWICE).groupBy("anchor", "digest").agg(F.collect_list("at").alias("found"))
        all_hot = open_heads.where("hot").select("anchor", "digest", "windows", "copies").join(twice, ["anchor", "digest"], "left")
        solved = solved.union(all_hot.mapInArrow(_spans, "anchor long, digest long, spans array<int>"))
    # a region of many copies would be a hot key, so it tells them in SALTS parts
    salts = F.when(F.col("copies") > SALTED_FROM, SALTS).otherwise(1)
    told = solved.where(F.size("spans") > 0).join(open_heads.select("anchor", "digest", "copies"), ["anchor", "digest"])
    told = told.select("anchor", "digest", "spans", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    places = found.where("NOT alone").withColumn("salt", F.pmod(F.xxhash64("rid", "first"), salts).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.size("spans") - 2, F.lit(2)), lambda i: F.struct((F.col("first") + F.get("spans", i)).alias("a"), (F.col("first") + F.get("spans", i + 1)).alias("b")))
    hits = places.join(told, ["anchor", "digest", "salt"]).select("rid", F.explode(pairs).alias("span"))
    whole = found.where("alone").select("rid", F.struct(F.col("first").alias("a"), (F.col("first") + F.col("windows")).alias("b")).alias("span"))
    per_doc = hits.union(whole).repartition(n, "rid").groupBy("rid").agg(F.collect_list("span").alias("spans"))
    columns = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"
    result = kept.join(per_doc.hint("shuffle_hash"), "rid", "left").select("doc_id", "text", "spans").mapInArrow(_remove(length, with_text), columns)
    return result if with_text else result.drop("kept")
