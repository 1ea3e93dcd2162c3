"""Line deduplication by an exact set-similarity join: of lines that match, the later ones are removed.

A line is the set of its words. All words have one global order, rare ones first: words are counted in ``2 ** RANK_BITS``
buckets of their hash over the whole corpus, and ordered by their bucket's count, then by bucket and hash. Lines with equal
sets are one, at its first place. Two sets with a Jaccard similarity of at least ``THRESHOLD`` percent share a word among
the first of each (prefix filter), have similar sizes (length filter), leave enough words around the shared one
(positional filter), and their parity bitmaps differ in few bits. A word that occurs once in the corpus joins nothing.

One pass over the texts deals each chunk's sets to fragments of the words, as arrays, and its lines to parts by their set.
In a fragment every line meets the lines of each word's list. Its ``CANDIDATES`` most alike earlier ones by bitmap are
verified, the best two first, so a line of a large group needs few pairs. Only a line that these don't settle though others
were left out (of more candidates, or in a list of more than ``MOST_STEPS`` lines of similar size) meets all earlier lines, in
a second pass.

Words are told apart by 50 bits of their hash, sets by 64 bits of a sum over their words; a match by prefix is verified
word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm import buckets, packed, textops
from engram.llm.textops import limit_arrow, mix
from engram.session import free_shuffles, materialise, shuffle_partitions

THRESHOLD = 80  # percent
RANK_BITS, REST_BITS = 20, 30
MOST_STEPS = 4096  # neighbours by size under one word that are compared in the first pass
CANDIDATES, WIDER = 8, 32  # of a line that are verified before the second pass; so many times more if even the best one is in doubt
PER_FRAGMENT = 1 << 21  # words of the corpus
LEAST_FRAGMENTS, MOST_FRAGMENTS = 64, 1 << 16
CHUNK = 1 << 19  # words
MARKS = 1 << 24
_SUMS = 16
_AT_ONCE = 1 << 19  # pairs
_U = np.uint64
_WORD_BITS = RANK_BITS + REST_BITS
_LEAST = np.iinfo(np.int64).min


class Order:
    """Places of words in the global order, as 50-bit numbers: the rank of the word's bucket, and bits of its hash."""

    def __init__(self, counts: np.ndarray):
        self.total = int(counts.sum())
        self.single = _U(int((counts <= 1).sum()))  # words of the buckets before occur once
        self.rank = np.empty(len(counts), dtype=np.uint32)
        self.rank[np.argsort(counts, kind="stable")] = np.arange(len(counts), dtype=np.uint32)

    def place(self, hashes: np.ndarray) -> np.ndarray:
        rank = self.rank[(hashes >> _U(64 - RANK_BITS)).view(np.int64)].astype(_U)
        return (rank << _U(REST_BITS)) | (hashes & _U((1 << REST_BITS) - 1))


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many words fall to each bucket of the hash, in ``_SUMS`` rows."""
    counts, held, size = np.zeros(1 << RANK_BITS, dtype=np.int64), [], 0
    for batch in batches:
        for _, data, offs in _parts(batch.column(0)):
            held.append((textops.words(data, offs)[0] >> _U(64 - RANK_BITS)).astype(np.int64))
            size += len(held[-1])
            if size > CHUNK:
                counts += np.bincount(np.concatenate(held), minlength=len(counts))
                held, size = [], 0
    if held:
        counts += np.bincount(np.concatenate(held), minlength=len(counts))
    kind = np.int32 if counts.max() < 1 << 31 else np.int64
    yield pa.RecordBatch.from_arrays([pa.array(range(_SUMS), pa.int32()), pa.array([packed.blob(c.astype(kind)) for c in np.split(counts, _SUMS)], pa.binary())], ["part", "counts"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    each = (1 << RANK_BITS) // _SUMS
    for part, rows in packed.grouped(batches, "part"):
        total = np.zeros(each, dtype=np.int64)
        for r in rows:
            total += packed.numbers(r["counts"], np.int32 if len(r["counts"]) == 4 * each else np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([packed.blob(total)], pa.binary())], ["part", "counts"])


def order_of(texts: DataFrame) -> Order:
    """The global order by the words of all ``texts`` (one column); 8 MB come to the driver at any input size."""
    schema = "part int, counts binary"
    sums = limit_arrow(texts).mapInArrow(_tally, schema).repartition("part").sortWithinPartitions("part").mapInArrow(_add, schema)
    counts = np.zeros((_SUMS, (1 << RANK_BITS) // _SUMS), dtype=np.int64)
    for part, blob in sums.collect():
        counts[part] = packed.numbers(blob, np.int64)
    return Order(counts.ravel())


def line_sets(data: np.ndarray, offs: np.ndarray, order: Order, bitmap: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(row, line number, size, start) of each line that has words, and their words, line by line in global order.

    ``bitmap``: only of lines that hold a marked word."""
    h, rows, starts, _ = textops.words(data, offs)
    breaks = np.flatnonzero(data == 10)
    line = np.repeat(np.arange(len(breaks) + 1), np.diff(np.searchsorted(starts, breaks), prepend=0, append=len(h))) + rows  # rows begin a line as well
    if bitmap is not None and len(h):
        some = np.zeros(line[-1] + 1, dtype=bool)
        some[line[_marked(bitmap, h)]] = True  # a word's place ends in the bits of its hash that mark it
        keep = np.flatnonzero(some[line])
        h, rows, line = h[keep], rows[keep], line[keep]
    if not len(h):
        z = np.zeros(0, np.int64)
        return z, z, z, z, z.view(_U)
    fresh = np.append(True, line[1:] != line[:-1])
    local, first = np.cumsum(fresh) - 1, np.flatnonzero(fresh)
    place = order.place(h)
    if local[-1] < 1 << (64 - _WORD_BITS):
        key = np.sort((local.astype(_U) << _U(_WORD_BITS)) | place)
        key = key[np.append(True, key[1:] != key[:-1])]
        owner, words = (key >> _U(_WORD_BITS)).astype(np.int64), key & _U((1 << _WORD_BITS) - 1)
    else:
        words, owner = textops.row_sets(place, local)
    size = np.bincount(owner, minlength=len(first))
    row = rows[first]
    return row, line[first] - row - np.searchsorted(breaks, offs)[row], size, np.cumsum(size) - size, words


def identity(words: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    total = np.add.reduceat(mix(words + _U(0x9E3779B97F4A7C15)), start) if len(start) else words[:0]
    return mix(total ^ (size.astype(_U) << _U(44)))


def prefix_length(size: np.ndarray, threshold: int) -> np.ndarray:
    return size - (threshold * size + 99) // 100 + 1


def _parts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    data, offs = textops.text_buffers(column)
    for i, j in textops.slices(offs):
        yield i, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]


def _inner(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of the runs (start, size), one run after the other."""
    return np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)


_DEALT = "part int, same binary, doc_id binary, row binary, line binary, size binary, bits binary, more_bits binary, open binary, count binary, word binary, at binary"
_ENTITY = {"same": _U, "doc_id": np.int64, "row": np.int64, "line": np.int32, "size": np.int32, "bits": _U, "more_bits": _U, "open": np.uint8}


def _batch(schema: str, part: np.ndarray | list, columns: dict[str, list]) -> pa.RecordBatch:
    names = [x.split()[0] for x in schema.split(", ")]
    arrays = [pa.array(part, pa.int32()), *(pa.array(columns[c], pa.binary()) if c in columns else pa.nulls(len(part), pa.binary()) for c in names[1:])]
    return pa.RecordBatch.from_arrays(arrays, names)


def _deal(schema: str, part: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    made = packed.dealt(part, columns)
    return _batch(schema, made.column(0).to_pylist(), {c: made.column(c).to_pylist() for c in columns})


def _lines(shared, threshold: int, fragments: int, parts: int, marks=None):
    """Rows (row, doc_id, text) to arrays by part: below 0 the postings of a fragment of the words; from 0 on the first lines of
    the chunk's sets, by set; from ``parts`` on its other lines, by row. ``marks``: only postings, of marked words, and which sets
    are marked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = shared.value
        held: list[tuple] = []
        total = 0

        def out() -> Iterator[pa.RecordBatch]:
            same, doc_id, row, line, size, words = (np.concatenate([h[k] for h in held]) for k in range(6))
            start = np.cumsum(size) - size
            by = _first_to_last(doc_id, row)
            by = by[np.argsort(same[by], kind="stable")]
            head = np.append(True, same[by][1:] != same[by][:-1])
            first = np.sort(by[head])
            if marks is None:
                columns = lambda at: {"same": same[at], "doc_id": doc_id[at], "row": row[at], "line": line[at].astype(np.int32)}
                yield _deal(_DEALT, (same[first] % _U(parts)).astype(np.int32), columns(first))
                rest = by[~head]
                if len(rest):
                    gone = columns(rest)
                    yield _deal(_DEALT, parts + _part_of(row[rest], parts), {c: gone[c] for c in ("row", "line")})
            same, doc_id, row, line, size, start = (x[first] for x in (same, doc_id, row, line, size, start))
            length = prefix_length(size, threshold)
            owner, at = np.repeat(np.arange(len(size)), length), _inner(np.zeros(len(size), np.int64), length)
            word = words[start[owner] + at]
            keep = word >> _U(REST_BITS) >= order.single
            if marks is not None:
                keep &= _marked(marks.value[1], word)
            owner, at, word = owner[keep], at[keep], word[keep]
            posted, owner = np.unique(owner, return_inverse=True)
            if not len(posted):
                return
            same, doc_id, row, line, size, start = (x[posted] for x in (same, doc_id, row, line, size, start))
            begin = np.cumsum(size) - size
            whole = words[_inner(start, size)]
            spot = mix(whole) & _U(127)  # two halves of a bitmap of 128 bits
            flips = _U(1) << (spot & _U(63))
            bits, more_bits = (np.bitwise_xor.reduceat(np.where(half, flips, _U(0)), begin) for half in (spot < _U(64), spot >= _U(64)))
            columns = [same, doc_id, row, line.astype(np.int32), size.astype(np.int32), bits, more_bits]
            if marks is not None:
                columns.append(_marked(marks.value[0], same).astype(np.uint8))
            fragment = ((mix(word) >> _U(32)) % _U(fragments)).astype(np.int64)
            by = np.argsort(fragment, kind="stable")  # within a fragment by owner
            fragment, owner = fragment[by], owner[by]
            begin = np.flatnonzero(np.append(True, (fragment[1:] != fragment[:-1]) | (owner[1:] != owner[:-1])))
            count, present = np.diff(np.append(begin, len(by))).astype(np.int32), owner[begin]
            filled = np.unique(fragment)
            cuts = [np.searchsorted(x, np.append(filled, fragments)).tolist() for x in (fragment[begin], fragment)]
            made = {}
            for c, x in [*zip(_ENTITY, columns, strict=False), ("count", count), ("word", word[by]), ("at", at[by].astype(np.int32))]:
                cut = cuts[c in ("word", "at")]
                x = x[present] if c in _ENTITY else x
                made[c] = [packed.blob(x[i:j]) for i, j in zip(cut, cut[1:], strict=False)]
            yield _batch(_DEALT, -1 - filled, made)

        for batch in batches:
            rows, ids = batch.column(0).to_numpy(), batch.column(1).fill_null(int(_LEAST)).to_numpy()
            for i, data, offs in _parts(batch.column(2)):
                row, line, size, start, words = line_sets(data, offs, order, None if marks is None else marks.value[1])
                if len(row):
                    held.append((identity(words, start, size), ids[row + i], rows[row + i], line, size, words))
                    total += len(words)
                if total > CHUNK:
                    yield from out()
                    held.clear()
                    total = 0
        if held:
            yield from out()

    return run


def _marked(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    spot = (values & _U(MARKS - 1)).view(np.int64)
    return (bitmap[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1 > 0


def _first_to_last(doc_id: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The order by doc_id, then row, of lines whose rows have theirs in order."""
    by = np.argsort(doc_id, kind="stable")
    d, r = doc_id[by], row[by]
    return np.lexsort((row, doc_id)) if ((d[1:] == d[:-1]) & (r[1:] != r[:-1])).any() else by


def _part_of(rows: np.ndarray, parts: int) -> np.ndarray:
    return (mix(rows.view(_U)) % _U(parts)).astype(np.int32)


def _passes(x: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, threshold: int) -> tuple[np.ndarray, ...]:
    """Of the pairs of entries (i, j) of a word's list, of similar sizes, those that pass the other filters, and in how many bits they differ."""
    a, b, at_i, at_j = x["size"][i], x["size"][j], x["at"][i], x["at"][j]
    both = a + b
    most = np.minimum(a - at_i, b - at_j) + np.minimum(at_i, at_j)
    near = np.flatnonzero((100 + threshold) * most >= threshold * both)
    i, j, both = i[near], j[near], both[near]
    apart = np.bitwise_count(x["bits"][i] ^ x["bits"][j]).astype(np.int64) + np.bitwise_count(x["more_bits"][i] ^ x["more_bits"][j])
    near = np.flatnonzero((100 + threshold) * ((both - apart) // 2) >= threshold * both)  # sets differ in at least as many words as bits
    return i[near], j[near], apart[near]


_TOLD = "part int, row binary, line binary, other_row binary, other_line binary, apart binary, more binary"


def _met(rows: list[dict], threshold: int, most_steps: int, candidates: int, parts: int, only_open: bool) -> Iterator[pa.RecordBatch]:
    """Of one fragment: the earlier lines that pass for each line, and whether some were left out."""
    x = {c: packed.joined(rows, c, t) for c, t in _ENTITY.items() if c != "open" or only_open}
    entity = np.repeat(np.arange(len(x["same"])), packed.joined(rows, "count", np.int32))
    word, at = packed.joined(rows, "word", _U), packed.joined(rows, "at", np.int32)
    rows.clear()
    # a set that several chunks hold is at its first place
    early = _first_to_last(x["doc_id"], x["row"])  # one chunk has all lines of a row
    same = x["same"][early]
    by = np.argsort(same, kind="stable")
    head = np.append(True, same[by][1:] != same[by][:-1])
    heads = np.sort(by[head])
    first = early[heads]
    x = {c: v[first] for c, v in x.items()}
    own, place = np.empty(len(by), dtype=np.int64), np.empty(len(by), dtype=np.int64)
    place[heads] = np.arange(len(first))
    own[early[by]] = place[by[head]][np.cumsum(head) - 1]
    entity = own[entity]
    del early, same
    # each word's list by size; places in ``x`` are in order of the first places
    number = np.unique(word, return_inverse=True)[1].astype(np.int32)
    del word
    bits = [int(v.max(initial=0)).bit_length() for v in (entity, x["size"])]
    if sum(bits) + int(number.max(initial=0)).bit_length() < 64:  # one number holds all three
        by = np.argsort((((number.astype(np.int64) << bits[1]) | x["size"][entity]) << bits[0]) | entity)
    else:
        by = np.lexsort((entity, x["size"][entity], number))
    group, entity = number[by], entity[by]
    fresh = np.append(len(by) > 0, (group[1:] != group[:-1]) | (entity[1:] != entity[:-1]))
    group, entity, by = group[fresh], entity[fresh], by[fresh]
    begin = np.flatnonzero(np.append(len(group) > 0, group[1:] != group[:-1]))
    length = np.diff(np.append(begin, len(group)))
    del number, own, place, head, heads
    entry = {"size": x["size"][entity].astype(np.int64), "at": at[by].astype(np.int64), "bits": x["bits"][entity], "more_bits": x["more_bits"][entity]}
    more = np.zeros(len(first), dtype=bool)
    met: list[tuple] = []

    def kept() -> tuple[np.ndarray, ...]:
        """The most alike earlier lines of each line; pairs under several words count once."""
        i, j, apart = (np.concatenate(c) for c in zip(*met, strict=True))
        pair, once = np.unique((i << 32) | j, return_index=True)
        i, j, apart = pair >> 32, pair & 0xFFFFFFFF, apart[once]
        if only_open or not len(i):
            return i, j, apart
        by = np.lexsort((apart, i))
        i, j, apart = i[by], j[by], apart[by]
        start = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
        sizes = np.diff(np.append(start, len(i)))
        # a line whose best candidate differs, by its bits, in most of what is allowed may need many
        differs = -64 * np.log1p(-np.minimum(apart[start], 63) / 64)
        allowed = (x["size"][i[start]].astype(np.int64) + x["size"][j[start]]) * (100 - threshold) / (100 + threshold)
        most = np.repeat(np.where(differs > 0.8 * allowed, candidates * WIDER, candidates), sizes)
        within = np.arange(len(i)) - np.repeat(start, sizes) < most
        more[i[~within]] = True
        return i[within], j[within], apart[within]

    def told(i: np.ndarray, j: np.ndarray, apart: np.ndarray) -> pa.RecordBatch:
        return _deal(_TOLD, _part_of(x["row"][i], parts), {
            "row": x["row"][i], "line": x["line"][i], "other_row": np.where(j < 0, -1, x["row"][j]), "other_line": np.where(j < 0, -1, x["line"][j]).astype(np.int32),
            "apart": apart.astype(np.int32), "more": more[i].astype(np.uint8),
        })

    active = np.arange(len(group))
    del group, by, at, fresh
    begin, number = np.repeat(begin, length), np.repeat(np.arange(len(begin)), length)
    if only_open and len(active):
        active = active[np.repeat(np.maximum.reduceat(x["open"][entity], np.cumsum(length) - length), length) > 0]
    size, step = 0, 0
    while True:
        step += 1
        active = active[active - step >= begin[active]]
        active = active[100 * entry["size"][active - step] >= threshold * entry["size"][active]]
        if not len(active):
            break
        if step > most_steps and not only_open:
            cut = np.zeros(len(length), dtype=bool)
            cut[number[active]] = True
            more[entity[cut[number]]] = True
            break
        i, j, apart = _passes(entry, active, active - step, threshold)
        i, j = np.maximum(entity[i], entity[j]), np.minimum(entity[i], entity[j])
        if only_open:
            asked = np.flatnonzero(x["open"][i])
            i, j, apart = i[asked], j[asked], apart[asked]
        met.append((i, j, apart))
        size += len(i)
        if size > _AT_ONCE:
            some = kept()
            met.clear()
            size = 0
            if only_open:
                yield told(*some)
            else:
                met.append(some)  # what is kept is bounded by the lines
    if met:
        some = kept()
        if len(some[0]):
            yield told(*some)
    alone = np.flatnonzero(more)
    if len(alone):
        yield told(alone, np.full(len(alone), -1), np.full(len(alone), 1 << 20))


def _meet(threshold: int, most_steps: int, candidates: int, parts: int, only_open: bool):
    """Fragments to pairs (part below 0: by row), and all lines of a set but the first to removed ones (part from 0 on, by row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in packed.grouped(batches, "part"):
            if part < 0:
                for made in _met(rows, threshold, most_steps, candidates, parts, only_open):
                    yield pa.RecordBatch.from_arrays([pa.array(-1 - made.column(0).to_numpy(), pa.int32()), *made.columns[1:]], made.schema.names)
                continue
            row, line = packed.joined(rows, "row", np.int64), packed.joined(rows, "line", np.int32)
            if part < parts:
                same, doc_id = packed.joined(rows, "same", _U), packed.joined(rows, "doc_id", np.int64)
                by = _first_to_last(doc_id, row)
                by = by[np.argsort(same[by], kind="stable")]
                by = by[np.append(False, same[by][1:] == same[by][:-1])]
                row, line = row[by], line[by]
            if len(row):
                yield _deal(_TOLD, _part_of(row, parts), {"row": row, "line": line})

    return run


def _best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs by part of their row to pairs once each, numbered per line from the most alike one."""
    kinds = {"row": np.int64, "line": np.int32, "other_row": np.int64, "other_line": np.int32, "apart": np.int32, "more": np.uint8}
    for _, rows in packed.grouped(batches, "part"):
        x = {c: packed.joined(rows, c, t) for c, t in kinds.items()}
        by = np.lexsort((x["other_line"], x["other_row"], x["apart"], x["line"], x["row"]))
        x = {c: v[by] for c, v in x.items()}
        new = np.append(True, (x["row"][1:] != x["row"][:-1]) | (x["line"][1:] != x["line"][:-1]))
        begin = np.flatnonzero(new)
        sizes = np.diff(np.append(begin, len(by)))
        more = np.repeat(np.maximum.reduceat(x["more"], begin), sizes) > 0
        once = new | np.append(True, (x["other_row"][1:] != x["other_row"][:-1]) | (x["other_line"][1:] != x["other_line"][:-1]))
        count = np.cumsum(once)
        number = count - np.repeat(count[begin], sizes)
        at = np.flatnonzero(once)
        columns = [x["row"], x["line"], x["other_row"], x["other_line"], number.astype(np.int32), more]
        yield pa.RecordBatch.from_arrays([pa.array(c[at]) for c in columns], ["row", "line", "other_row", "other_line", "number", "more"])


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Removed lines by part of their row to a row (row, lines) for each."""
    for _, rows in packed.grouped(batches, "part"):
        row, line = packed.joined(rows, "row", np.int64), packed.joined(rows, "line", np.int32)
        by = np.argsort(row, kind="stable")
        row, line = row[by], line[by]
        begin = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        cut = np.append(begin, len(row)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(row[begin]), pa.ListArray.from_arrays(pa.array(cut), pa.array(line))], ["row", "lines"])


def _line_bytes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first line of each text, start and end of each line with its break) of consecutive texts; every text has a line."""
    breaks = np.flatnonzero(data == 10)
    n = np.searchsorted(breaks, offs[1:]) - np.searchsorted(breaks, offs[:-1]) + 1
    first = np.cumsum(n) - n
    start, end = np.empty(int(n.sum()), dtype=np.int64), np.empty(int(n.sum()), dtype=np.int64)
    inner = np.ones(len(start), dtype=bool)
    inner[first + n - 1] = False  # lines that end in a break
    end[inner], end[~inner] = breaks + 1, offs[1:]
    start[first] = offs[:-1]
    later = np.ones(len(start), dtype=bool)
    later[first] = False
    start[later] = end[:-1][later[1:]] if len(end) else end
    return first, start, end


def _words_of(shared):
    """Rows (row, text, lines) to the words of those lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = textops.text_buffers(batch.column(1))
            first, start, end = _line_bytes(data, offs)
            lists = batch.column(2)
            owner = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            line = lists.flatten().to_numpy(zero_copy_only=False)
            at = first[owner] + line
            size = end[at] - start[at]
            for i, j in textops.slices(np.append(0, np.cumsum(size))):
                part = data[_inner(start[at[i:j]], size[i:j])]
                row, _, n, begin, words = line_sets(np.where(part == 10, np.uint8(32), part), np.append(0, np.cumsum(size[i:j])), shared.value)
                cut = np.append(begin, len(words)).astype(np.int32)
                picked = row + i
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner[picked])), pa.array(line[picked].astype(np.int32)), pa.ListArray.from_arrays(pa.array(cut), pa.array(words.view(np.int64)))], ["row", "line", "words"])

    return run


def _sets_of(texts: DataFrame, shared, lines: DataFrame, n: int) -> DataFrame:
    """row, line and words of the lines (row, line); ``texts`` are in ``n`` buckets by row."""
    by_row = lines.repartition(n, "row").groupBy("row").agg(F.collect_list("line").alias("lines"))
    return texts.join(by_row.hint("shuffle_hash"), "row").select("row", "text", "lines").mapInArrow(_words_of(shared), "row long, line int, words array<long>")


def _verified(texts: DataFrame, shared, pairs: DataFrame, threshold: int, n: int) -> DataFrame:
    """The lines (row, line) of those pairs (row, line, other_row, other_line) that are similar enough."""
    pairs = pairs.select("row", "line", "other_row", "other_line")
    ends = pairs.select("row", "line").union(pairs.select("other_row", "other_line")).distinct()
    words = materialise(_sets_of(texts, shared, ends, n), "words")
    other = words.select(F.col("row").alias("other_row"), F.col("line").alias("other_line"), F.col("words").alias("others"))
    both = pairs.join(other, ["other_row", "other_line"]).join(words, ["row", "line"])
    common = F.size(F.array_intersect("words", "others"))
    fine = (100 + threshold) * common >= threshold * (F.size("words") + F.size("others"))
    return materialise(both.where(fine).select("row", "line").distinct(), "settled")


def _removed(texts: DataFrame, n: int, order: Order, threshold: int, most_steps: int, candidates: int) -> DataFrame:
    """row and lines (numbers) of all lines of ``texts`` (row, doc_id, text; in ``n`` buckets by row) that match earlier ones."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(order)
    parts = max(shuffle_partitions(spark), 16)
    fragments = min(max(LEAST_FRAGMENTS, order.total // PER_FRAGMENT), MOST_FRAGMENTS)

    def meet(marks=None) -> DataFrame:
        dealt = texts.mapInArrow(_lines(shared, threshold, fragments, parts, marks), _DEALT).repartition("part").sortWithinPartitions("part")
        return materialise(dealt.mapInArrow(_meet(threshold, most_steps, candidates, parts, marks is not None), _TOLD), "met")

    def numbered(told: DataFrame) -> DataFrame:
        best = told.where("part < 0").repartition("part").sortWithinPartitions("part").mapInArrow(_best, "row long, line int, other_row long, other_line int, number int, more boolean")
        return materialise(best, "pairs")

    told = meet()
    free_shuffles(spark)
    pairs = numbered(told)
    settled = _verified(texts, shared, pairs.where("number < 2 AND other_row >= 0"), threshold, n)
    unsettled = pairs.where("number >= 2 AND other_row >= 0").join(settled, ["row", "line"], "left_anti")
    settled = settled.union(_verified(texts, shared, unsettled, threshold, n))
    left = pairs.where("more").select("row", "line").distinct().join(settled, ["row", "line"], "left_anti")
    left = materialise(left, "left")
    if not left.isEmpty():
        # two bitmaps of 2 MB at any input size; what is marked by chance is verified like the rest
        found = _sets_of(texts, shared, left, n).mapInArrow(_marks_of(threshold), "kind int, mark int").distinct().toArrow()
        kind, mark = (found.column(c).to_numpy() for c in ("kind", "mark"))
        marks = np.zeros((2, MARKS // 8), dtype=np.uint8)
        np.bitwise_or.at(marks, (kind, mark >> 3), (1 << (mark & 7)).astype(np.uint8))
        pairs = numbered(meet(spark.sparkContext.broadcast(marks)))
        settled = settled.union(_verified(texts, shared, pairs.where("other_row >= 0"), threshold, n))
    copies = told.where("part >= 0").repartition("part").sortWithinPartitions("part").mapInArrow(_rows_of, "row long, lines array<int>")
    every = copies.union(settled.select("row", F.array("line").alias("lines")))
    return every.repartition(n, "row").groupBy("row").agg(F.flatten(F.collect_list("lines")).alias("lines"))


def _marks_of(threshold: int):
    """Lines with their words to the marks of their sets (kind 0) and of the words they are met by (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            size = lists.value_lengths().to_numpy()
            words, start = lists.flatten().to_numpy().view(_U), np.cumsum(size) - size
            for kind, values in enumerate((identity(words, start, size), words[_inner(start, prefix_length(size, threshold))])):
                mark = np.unique((values % _U(MARKS)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(mark), kind, np.int32)), pa.array(mark)], ["kind", "mark"])

    return run


def _removal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, lines to remove, others) to n_lines, n_removed, the rest of the text, and the others."""
    for batch in batches:
        data, offs = textops.text_buffers(batch.column(0))
        first, start, end = _line_bytes(data, offs)
        n = np.diff(np.append(first, len(start)))
        lists = batch.column(1)
        owner = np.repeat(np.arange(batch.num_rows), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        stays = np.ones(len(start), dtype=bool)
        stays[first[owner] + lists.flatten().to_numpy(zero_copy_only=False)] = False
        # where the last line goes, so does the break behind the last one that stays
        last = np.maximum.accumulate(np.where(stays, np.arange(len(stays)), -1))[first + n - 1] if len(stays) else first
        cut = last[(last >= first) & (last < first + n - 1)]
        left, size = start[stays], (end - start)[stays]
        size[(np.cumsum(stays) - 1)[cut]] -= 1
        ends = np.append(0, np.cumsum(size))
        breaks = np.append(len(left) > 0, left[1:] != left[:-1] + size[:-1])  # what stays in one piece is copied at once
        piece = np.flatnonzero(breaks)
        pieces = [data[i:j] for i, j in zip(left[piece].tolist(), (left + size)[np.append(piece[1:], len(left))[: len(piece)] - 1].tolist(), strict=True)]
        ends = ends[np.append(0, np.cumsum(stays))[np.append(first, len(stays))]]
        texts = pa.LargeStringArray.from_buffers(batch.num_rows, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.concatenate([data[:0], *pieces]))).cast(pa.string())
        null = batch.column(0).is_null().to_numpy(zero_copy_only=False)
        if null.any():
            texts = pa.array([None if z else t for z, t in zip(null, texts.to_pylist(), strict=True)], pa.string())
        removed = n - np.add.reduceat(stays, first, dtype=np.int64) if len(first) else n
        others = [batch.column(k) for k in range(2, batch.num_columns)]
        yield pa.RecordBatch.from_arrays([pa.array(np.where(null, 0, n), pa.int64()), pa.array(np.where(null, 0, removed), pa.int64()), texts, *others], ["n_lines", "n_removed", "kept", *batch.schema.names[2:]])


def _without(docs: DataFrame, threshold: int, most_steps: int, candidates: int) -> DataFrame:
    """n_lines, n_removed, kept, and the columns of ``docs`` as c0, c1 and so on, so that no name can clash."""
    spark = docs.sparkSession
    safe = [f"c{k}" for k in range(len(docs.columns))]
    text, doc_id = safe[docs.columns.index("text")], safe[docs.columns.index("doc_id")]
    order = order_of(docs.select("text"))
    n = buckets.number_for(docs)
    table = buckets.bucketed(limit_arrow(docs).toDF(*safe).withColumn("row", F.monotonically_increasing_id()), "row", "rows", n)
    free_shuffles(spark)
    texts = table.select("row", F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    removed = _removed(texts, n, order, threshold, most_steps, candidates)
    free_shuffles(spark)
    others = [c for c in safe if c != text]
    fields = "".join(f", {c} {table.schema[c].dataType.simpleString()}" for c in others)
    whole = table.join(removed.hint("shuffle_hash"), "row", "left").select(text, "lines", *others)
    return whole.mapInArrow(_removal, f"n_lines long, n_removed long, kept string{fields}")


def remove_lines(docs: DataFrame, threshold: int = THRESHOLD, most_steps: int = MOST_STEPS, candidates: int = CANDIDATES) -> DataFrame:
    """All columns of ``docs`` but text, and n_lines, n_removed and ``kept``, the text without the lines that match earlier ones.

    A line is removed if any earlier line, removed or not, has a word set whose Jaccard similarity to its own is at least
    ``threshold`` percent; earlier is by doc_id (null first), then row, then place in the text. Lines without words are
    kept. A null text stays null and has no lines; an empty text has one, empty line; of repeated rows the first keeps its
    lines; an empty table gives no rows. Columns named like the results are replaced.
    """
    names = {f"c{k}": c for k, c in enumerate(docs.columns) if c not in ("text", "n_lines", "n_removed", "kept")}
    return _without(docs, threshold, most_steps, candidates).select(*(F.col(k).alias(c) for k, c in names.items()), "n_lines", "n_removed", "kept")


def clean(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` with the kept lines as text, whatever its columns' names; a document keeps its row even if no line is left."""
    out = []
    for k, c in enumerate(docs.columns):
        column = F.col("kept") if c == "text" else F.col(f"c{k}")
        if c == "n_chars":
            column = F.when(F.col("kept").isNull(), column).otherwise(F.length("kept")).cast(docs.schema[c].dataType)
        out.append(column.alias(c))
    return _without(docs, threshold, MOST_STEPS, CANDIDATES).select(*out)


def digests(removed: DataFrame) -> DataFrame:
    return removed.select("doc_id", "n_lines", "n_removed", F.length("kept").cast("long").alias("kept_chars"), F.sha2(F.coalesce("kept", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
