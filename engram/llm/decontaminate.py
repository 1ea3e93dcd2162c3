"""Benchmark decontamination by templates: re-parameterised questions are found as well as copies.

A word is canonicalised to a typed placeholder if it is a number, a unit behind a number, or a name (capitalised, not at the
start of a sentence), and to its lower-case core without outer punctuation otherwise. Windows of ``WINDOW`` canonical
words, and of ``SHORT``, are hash-joined with those of the benchmark, the short ones by
their literal words as well, as windows of many slots have no other. The windows of one size that match along one alignment of text and item must map
the item's names to the text's one to one: the same name always becomes the same other name; numbers and units are free. Literal
windows are consistent in themselves, so a copy with a name changed in one place is held by the others. A document leaks an
item if the windows of consistent alignments cover at least ``COVERAGE`` of the item's words, and ``WINDOW`` of them or all,
or are that share of its windows of ``WINDOW`` words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm import textops
from engram.llm.textops import limit_arrow, mix

WINDOW = 8
SHORT = 5  # so that words around a changed one still count
LEAST_WORDS = 4  # of a window that aren't slots
COVERAGE = 0.5
MOST_BROADCAST = 2_000_000  # windows of the benchmark (16 MB); beyond it all windows of the documents are joined
UNITS = "km m cm mm mi ft in kg g mg lb oz l ml s sec min h hr hours minutes seconds days years months weeks % percent dollars euros usd eur mph kph degrees hz khz mhz ghz kb mb gb tb miles meters metres feet inches pounds grams litres liters kilometers kilometres".split()
_U = np.uint64
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_OUTER = ~(_DIGIT | _LETTER)
_STOP = np.zeros(256, dtype=bool)
_STOP[[33, 46, 58, 59, 63]] = True
_NUMBER, _UNIT, _NAME = _U(0xA24BAED4963EE407), _U(0x9FB21C651E98DF25), _U(0xC3A5C85C97CB3127)
_IS_NAME = _U(2)  # the bit of a slot value that tells a name
_unit_hashes: list[np.ndarray] = []


def _units() -> np.ndarray:
    if not _unit_hashes:
        raw = " ".join(UNITS).encode()
        data = np.frombuffer(raw, dtype=np.uint8)
        _unit_hashes.append(np.sort(textops.words(data, np.array([0, len(data)]))[0]))
    return _unit_hashes[0]


def canonical(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code, slot value, row, literal code) of each word; the slot value is 0 for a word that is no slot."""
    starts, ends, rows = textops.word_spans(data, offs)
    if not len(starts):
        z = np.zeros(0, dtype=_U)
        return z, z, rows, z
    a, b = starts.copy(), ends.copy()
    for _ in range(3):
        a += (b - a > 1) & _OUTER[data[a]]
        b -= (b - a > 1) & _OUTER[data[b - 1]]
    core = textops.span_hashes(data, a, b)
    count = lambda table: (lambda c: c[b] - c[a])(np.concatenate([[0], np.cumsum(table[data])]))
    number = (count(_DIGIT) > 0) & (count(_LETTER) <= 3)
    after_number = np.append(False, number[:-1] & (rows[1:] == rows[:-1]))
    known = _units()
    at = np.minimum(np.searchsorted(known, core), len(known) - 1)
    unit = after_number & (known[at] == core) & ~number
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    opens = np.ones(len(starts), dtype=bool)
    opens[1:] = (rows[1:] != rows[:-1]) | _STOP[data[ends[:-1] - 1]] | (lines[starts[1:]] > lines[ends[:-1]])
    first = data[a]
    second = data[np.minimum(a + 1, len(data) - 1)]
    capital = ((first >= 65) & (first <= 90)) | ((first == 0xC3) & (second >= 0x80) & (second <= 0x9E))
    name = capital & ~opens & ~number & ~unit
    code = np.where(number, _NUMBER, np.where(unit, _UNIT, np.where(name, _NAME, core)))
    value = np.where(number | unit | name, (core & ~_IS_NAME) | _U(1) | np.where(name, _IS_NAME, _U(0)), _U(0))
    return code, value, rows, core


def windows(code: np.ndarray, value: np.ndarray | None, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of each run of ``size`` words of one text that holds enough words besides slots.

    Without slot values the codes are literal, and every run counts.
    """
    n = len(code) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    fine = rows[:n] == rows[size - 1 :]
    if value is not None:
        slots = np.concatenate([[0], np.cumsum(value != 0)])
        fine &= size - (slots[size:] - slots[:-size]) >= min(LEAST_WORDS, (size + 1) // 2)
    h = np.full(n, size if value is not None else -size & 0xFF, dtype=_U)
    for j in range(size):
        h = mix(h * _U(0x9E3779B97F4A7C15) + code[j : j + n])
    at = np.flatnonzero(fine)
    return at, h[at]


def _emit(sizes: list[int], wanted, whole_short: bool):
    """Rows (id, at, window, slots, literal) of the texts' windows; of the wanted hashes only, if these are given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = None if wanted is None else wanted.value
        for batch in batches:
            data, offs = textops.text_buffers(batch.column(1))
            for i, j in textops.slices(offs):
                code, value, rows, core = canonical(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                begin = np.searchsorted(rows, np.arange(j - i))
                length = np.bincount(rows, minlength=j - i) if len(rows) else np.zeros(j - i, np.int64)
                for size, literal in [(x, y) for x in sizes for y in (False, True) if x < WINDOW or not y]:
                    at, h = windows(core, None, rows, size) if literal else windows(code, value, rows, size)
                    if whole_short and size < WINDOW:  # an item shorter than a window is one window
                        of = length[rows[at]]
                        fits = (of == size) | ((of >= WINDOW) & (size == SHORT))
                        at, h = at[fits], h[fits]
                    if keep is not None and len(at):
                        place = np.minimum(np.searchsorted(keep, h), len(keep) - 1) if len(keep) else np.zeros(len(h), np.int64)
                        hit = keep[place] == h if len(keep) else np.zeros(len(h), bool)
                        at, h = at[hit], h[hit]
                    if not len(at):
                        continue
                    r = rows[at]
                    slots = value[at[:, None] + np.arange(size)].view(np.int64)
                    cut = np.arange(len(at) + 1, dtype=np.int32) * size
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(r + i)), pa.array(at - begin[r]), pa.array(h.view(np.int64)), pa.ListArray.from_arrays(pa.array(cut), pa.array(slots.ravel())), pa.array(np.full(len(at), literal))],
                        ["id", "at", "window", "slots", "literal"],
                    )

    return run


_SCHEMA = "id long, at long, window long, slots array<long>, literal boolean"


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, item_id, coverage, n_slots, n_changed, exact of every document and benchmark item that it leaks.

    Columns doc_id and text of ``docs``, item_id and text of ``benchmark`` are read, others ignored. Null texts are empty, and
    texts and items without words leak and are leaked by nothing; an item shorter than a window is matched whole. Rows
    that repeat a doc_id are judged as one document, rows with a null doc_id too (their doc_id is null). Empty tables
    give no rows.
    """
    spark = docs.sparkSession
    items = limit_arrow(benchmark).select(F.col("item_id").cast("long").alias("id"), "text")
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    short = [r[0] for r in items.select(words.alias("n")).where(f"n BETWEEN 1 AND {WINDOW - 1}").distinct().collect()]
    sizes = sorted({*short, SHORT, WINDOW})
    of_items = items.mapInArrow(_emit(sizes, None, True), _SCHEMA).withColumnsRenamed({"id": "item_id", "at": "item_at", "slots": "item_slots"}).drop("literal")
    n_words = items.groupBy(F.col("id").alias("item_id")).agg(F.max(words).alias("n_words"))
    distinct = of_items.select("window").distinct()
    wanted = None
    if distinct.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        found = distinct.toArrow().column("window").to_numpy()
        wanted = spark.sparkContext.broadcast(np.sort(found.view(_U)))
    texts = limit_arrow(docs).select(F.col("doc_id").cast("long").alias("id"), "text")
    of_docs = texts.mapInArrow(_emit(sizes, wanted, False), _SCHEMA).withColumnRenamed("id", "doc_id")

    met = of_docs.join(of_items, "window").withColumn("shift", F.col("at") - F.col("item_at")).withColumn("kind", F.when(F.col("literal"), -F.size("slots")).otherwise(F.size("slots")))
    of_whole = of_items.where(F.size("item_slots") == WINDOW).groupBy("item_id").agg(F.countDistinct("item_at").alias("n_windows"))
    span = F.sequence("item_at", F.col("item_at") + F.size("slots") - 1)
    pair = F.arrays_zip(F.sequence(F.lit(0), F.size("slots") - 1).alias("j"), F.col("slots").alias("ours"), F.col("item_slots").alias("theirs"))
    filled = F.transform(F.filter(pair, lambda x: (x["ours"] != 0) & (x["theirs"] != 0)), lambda x: F.struct((F.col("item_at") + x["j"]).alias("place"), x["theirs"].alias("theirs"), x["ours"].alias("ours")))
    # an alignment holds no more windows than its item, so these sets are bounded by the benchmark
    aligned = met.groupBy("doc_id", "item_id", "shift", "kind").agg(F.array_distinct(F.flatten(F.collect_set(span))).alias("places"), F.collect_set(F.when(F.col("kind") == WINDOW, F.col("item_at"))).alias("starts"), F.array_distinct(F.flatten(F.collect_set(filled))).alias("slots"))
    named = F.filter("slots", lambda x: x["ours"].bitwiseAND(int(_IS_NAME)) != 0)
    several = lambda *names: F.size(F.array_distinct(F.transform(named, lambda x: F.struct(*[x[n] for n in names]))))
    pairs = several("theirs", "ours")
    consistent = aligned.where((pairs == several("theirs")) & (pairs == several("ours")))
    changed = F.size(F.filter("slots", lambda x: x["ours"] != x["theirs"]))
    consistent = consistent.select("doc_id", "item_id", "places", "starts", F.size("slots").alias("n_slots"), changed.alias("n_changed"))
    held = consistent.groupBy("doc_id", "item_id").agg(
        F.size(F.array_distinct(F.flatten(F.collect_set("places")))).alias("n_held"),
        F.size(F.array_distinct(F.flatten(F.collect_set("starts")))).alias("n_starts"),
        F.max(F.struct(F.size("places").alias("n"), (-F.col("n_changed")).alias("less"), "n_slots")).alias("best"),
    )
    # of an item dense in slots only the windows that it has can be held by a changed copy
    by_words = F.when(F.col("n_held") >= F.least(F.lit(WINDOW), "n_words"), F.col("n_held") / F.col("n_words")).otherwise(0.0)
    share = F.greatest(by_words, F.col("n_starts") / F.col("n_windows"))
    n_changed = (-F.col("best.less")).cast("long")
    told = held.join(n_words, "item_id").join(of_whole, "item_id", "left")
    return told.where(share >= coverage).select("doc_id", "item_id", F.round(share, 6).alias("coverage"), F.col("best.n_slots").cast("long").alias("n_slots"), n_changed.alias("n_changed"), (n_changed == 0).alias("exact"))


def clean(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The documents that leak no item, with all their columns."""
    found = leaks(docs, benchmark, coverage).select(F.col("doc_id").alias("_leaked")).distinct()
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col("_leaked")), "left_anti")
