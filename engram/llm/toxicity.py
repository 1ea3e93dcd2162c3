"""Toxicity by a string-subsequence-kernel support vector machine with Nyström landmarks.

The kernel compares words by the letter triples that both hold as subsequences: a triple whose letters span d more places
than three weighs ``DECAY ** d``, up to ``SPAN`` places, so inserted characters and inflected endings cost little. Letters
are 5-bit codes; every other character is a gap. Runs of single letters ("i d i o t") are read as one word as well.

Training (in one task, from a bounded sample of labelled documents): at most ``MOST_WORDS`` distinct words of the sample are
instances, each as often toxic and clean as the documents that hold it. Landmarks are the most telling and some other words; a
squared-hinge SVM is fitted by Newton steps on the Nyström features. As features are linear in the triples, the machine folds into one weight
per triple, and a word's decision value is a sum over its triples. A logistic layer maps the largest decision values
of a document's words to a probability. Scoring reads every word of every text.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm import textops
from engram.llm.textops import limit_arrow

DECAY = 0.6
SPAN = 8
LANDMARKS = 96
MOST_DOCS = 1500  # labelled documents of each class in the sample
MOST_BYTES = 32_768  # of a text in the sample; longer texts are left out of it
MOST_WORDS = 24_000  # distinct words of the sample that the machine is fitted to: most telling, most frequent and by hash
_CODES = 32
_TABLE = _CODES**3
_PAD = SPAN
_AT_ONCE = 1 << 16  # words
_BLOCK = 2048  # words with features
_OFFSETS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]

_CODE = np.zeros(256, dtype=np.uint8)
_CODE[97:123] = np.arange(1, 27)
_CODE[65:91] = np.arange(1, 27)
_CODE[0x80:0xC0] = 27 + np.arange(64) % 5  # the last byte of a letter beyond ASCII; its first byte is a gap


def _norms(most: int = 64) -> np.ndarray:
    """Length of the feature vector of a word of n letters without gaps."""
    n = np.arange(most + 1)
    square = sum(np.maximum(n - b, 0) * DECAY ** (2 * (b - 2)) for _, b in _OFFSETS)
    return np.sqrt(np.maximum(square, 1.0))


_NORM = _norms()


def encode_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes with ``_PAD`` gaps behind each word, start of each word therein, letters of each word)."""
    lengths = ends - starts
    first = np.cumsum(lengths + _PAD) - (lengths + _PAD)
    codes = np.zeros(int(lengths.sum()) + _PAD * len(lengths), dtype=np.uint8)
    inner = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    codes[inner + np.repeat(first, lengths)] = _CODE[data[inner + np.repeat(starts, lengths)]]
    letters = np.add.reduceat(codes > 0, first, dtype=np.int64) if len(first) else np.zeros(0, np.int64)
    return codes, first, letters


def triples(codes: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """For each pair of offsets: the triple that begins at each place (0 in it: none), and its weight."""
    n = len(codes) - _PAD
    wide = codes.astype(np.int32)
    head = wide[:n] << 10
    for a, b in _OFFSETS:
        yield head + (wide[a : n + a] << 5) + wide[b : n + b], DECAY ** (b - 2)


def decision(codes: np.ndarray, first: np.ndarray, letters: np.ndarray, beta: np.ndarray, bias: float) -> np.ndarray:
    """Decision value of each word."""
    if not len(first):
        return np.zeros(0)
    total = np.zeros(len(codes), dtype=np.float32)
    for triple, weight in triples(codes):
        total[: len(triple)] += beta[triple] * np.float32(weight)
    return np.add.reduceat(total, first) / _NORM[np.minimum(letters, len(_NORM) - 1)] + bias


def _features(codes: np.ndarray, first: np.ndarray, letters: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Kernel of each word with each landmark, some words at a time; ``table``: the landmarks' vectors, a row per triple."""
    known = table.any(axis=1)
    ends = np.append(first[1:], len(codes))
    out = np.zeros((len(first), table.shape[1]), dtype=np.float32)
    for i in range(0, len(first), _BLOCK):
        begin, stop = first[i : i + _BLOCK], ends[min(i + _BLOCK, len(first)) - 1]
        owner = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, stop)))
        for triple, weight in triples(codes[begin[0] : stop]):
            at = np.flatnonzero(known[triple])
            if len(at):
                rows = owner[at]
                cut = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
                out[i + rows[cut]] += np.add.reduceat(table[triple[at]], cut, axis=0) * np.float32(weight)
    return out / _NORM[np.minimum(letters, len(_NORM) - 1)][:, None].astype(np.float32)


def _vectors(codes: np.ndarray, first: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """A column of triple weights for each word."""
    n = len(codes) - _PAD
    owner = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(codes))))[:n]
    out = np.zeros((_TABLE, len(first)), dtype=np.float32)
    for triple, weight in triples(codes):
        np.add.at(out, (triple, owner), np.float32(weight))
    index = np.arange(_TABLE)
    out[(index >> 10 == 0) | (index >> 5 & 31 == 0) | (index & 31 == 0)] = 0
    return out / _NORM[np.minimum(letters, len(_NORM) - 1)].astype(np.float32)


def all_words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, start, end) of the words, and of the runs of three or more single letters, by row."""
    h, rows, starts, ends = textops.words(data, offs)
    if not len(h):
        return h, rows, starts, ends
    single = (ends - starts == 1) & (_CODE[data[starts]] > 0)
    if np.count_nonzero(single) < 3:
        return h, rows, starts, ends
    before = np.append(False, single[:-1] & (rows[:-1] == rows[1:]))
    after = np.append(single[1:] & (rows[:-1] == rows[1:]), False)
    begin, stop = np.flatnonzero(single & ~before), np.flatnonzero(single & ~after)
    long = stop - begin >= 2
    begin, stop = begin[long], stop[long]
    if not len(begin):
        return h, rows, starts, ends
    extra = textops.span_hashes(data, starts[begin], ends[stop])
    order = np.argsort(np.concatenate([rows, rows[begin]]), kind="stable")
    join = lambda a, b: np.concatenate([a, b])[order]
    return join(h, extra), join(rows, rows[begin]), join(starts, starts[begin]), join(ends, ends[stop])


def _pooled(values: np.ndarray, rows: np.ndarray, n_rows: int) -> np.ndarray:
    """Per document: the two largest decision values of its words, and how many are above 0.5 and 0 (log)."""
    out = np.zeros((n_rows, 4))
    out[:, :2] = -2.0
    if len(values):
        present, begin = np.unique(rows, return_index=True)
        top = np.maximum.reduceat(values, begin)
        out[present, 0] = top
        where = np.flatnonzero(values == out[rows, 0])
        _, once = np.unique(rows[where], return_index=True)
        rest = values.copy()
        rest[where[once]] = -2.0
        out[present, 1] = np.maximum.reduceat(rest, begin)
        out[present, 2] = np.log1p(np.add.reduceat(values > 0.5, begin, dtype=np.int64))
        out[present, 3] = np.log1p(np.add.reduceat(values > 0.0, begin, dtype=np.int64))
    return out


def _newton_svm(z: np.ndarray, positive: np.ndarray, negative: np.ndarray, ridge: float = 1e-4, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Weighted squared-hinge SVM, each instance with a weight in either class: weights and bias."""
    w = np.zeros(z.shape[1] + 1)
    prior = ridge * np.eye(len(w))
    prior[-1, -1] = 1e-9
    for _ in range(rounds):
        h, g = prior.copy(), np.zeros(len(w))
        for i in range(0, len(z), _BLOCK):
            x = np.hstack([z[i : i + _BLOCK], np.ones((len(z[i : i + _BLOCK]), 1))])
            value = x @ w
            plus, minus = positive[i : i + _BLOCK] * (value < 1), negative[i : i + _BLOCK] * (value > -1)
            h += (x * (plus + minus)[:, None]).T @ x
            g += x.T @ (plus - minus)
        new = np.linalg.solve(h, g)
        done = np.abs(new - w).max() < 1e-8
        w = new
        if done:
            break
    return w[:-1], float(w[-1])


def _logistic(x: np.ndarray, y: np.ndarray, s: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (s * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (s * (y - p)) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _count_by_class(data: np.ndarray, offs: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, ...]:
    """(hash, toxic documents, clean documents, start, end) of the distinct words, a slice of the texts at a time."""
    z = np.zeros(0, np.int64)
    known = (z.view(np.uint64), z, z, z, z)
    held = [known]

    def merged() -> tuple[np.ndarray, ...]:
        h, yes, no, starts, ends = (np.concatenate(x) for x in zip(*held, strict=True))
        distinct, index, inverse = np.unique(h, return_index=True, return_inverse=True)
        add = lambda n: np.bincount(inverse, n, len(distinct)).astype(np.int64)
        return distinct, add(yes), add(no), starts[index], ends[index]

    for i, j in textops.slices(offs):
        h, rows, starts, ends = all_words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        if not len(h):
            continue
        pair_h, pair_r = textops.row_sets(h, rows)  # a word counts once for a document
        distinct, inverse = np.unique(pair_h, return_inverse=True)
        order = np.argsort(h, kind="stable")
        place = order[np.searchsorted(h[order], distinct)]
        yes = np.bincount(inverse, toxic[i + pair_r], len(distinct)).astype(np.int64)
        held.append((distinct, yes, np.bincount(inverse, minlength=len(distinct)) - yes, starts[place] + offs[i], ends[place] + offs[i]))
        if len(held) > 16:
            held = [merged()]
    return merged()


def train(texts: pa.Array, toxic: np.ndarray, counts: tuple[int, int]) -> dict:
    """Fit the machine. ``counts``: how many labelled documents of the clean and the toxic class the sample stands for."""
    data, offs = textops.text_buffers(texts)
    sampled = int((1 - toxic).sum()), int(toxic.sum())
    rates = [n / max(1, m) for n, m in zip(counts, sampled, strict=True)]
    model = {"beta": np.zeros(_TABLE, np.float32), "bias": -1.0, "layer": np.array([0.0, 0.0, 0.0, 0.0, np.log((sampled[1] * rates[1] + 0.5) / (sampled[0] * rates[0] + 0.5))])}
    distinct, in_toxic, in_clean, starts, ends = _count_by_class(data, offs, toxic)
    lengths = ends - starts
    usable = (lengths >= 3) & (lengths <= 40)
    if not usable.any() or 0 in sampled:
        return model
    p, q = in_toxic / sampled[1], in_clean / sampled[0]
    telling = p * np.log((in_toxic + 0.05) / sampled[1] / ((in_clean + 0.5) / sampled[0]))
    ranked = np.flatnonzero(usable)[np.lexsort((distinct[usable], -telling[usable]))]
    frequent = np.flatnonzero(usable)[np.lexsort((distinct[usable], -(p + q)[usable]))]
    spread = np.flatnonzero(usable)[np.argsort(distinct[usable])]
    third = MOST_WORDS // 3
    words = np.unique(np.concatenate([ranked[:third], frequent[:third], spread[:third]]))
    half = LANDMARKS // 2
    chosen = dict.fromkeys([*ranked[:half], *frequent[: half // 2], *spread[:LANDMARKS]])
    marks = np.array([w for w, _ in zip(chosen, range(LANDMARKS), strict=False)])
    vectors = _vectors(*encode_words(data, starts[marks], ends[marks]))
    values, basis = np.linalg.eigh((vectors.T @ vectors).astype(np.float64))
    good = values > 1e-6 * values.max()
    whiten = basis[:, good] / np.sqrt(values[good])
    z = _features(*encode_words(data, starts[words], ends[words]), vectors) @ whiten.astype(np.float32)
    positive, negative = p[words], 3 * q[words]
    scale = 100 / (positive.sum() + negative.sum())
    weights, bias = _newton_svm(z, positive * scale, negative * scale)
    model["beta"] = (vectors @ (whiten @ weights)).astype(np.float32)
    model["bias"] = bias
    model["layer"] = _logistic(_pool_texts(data, offs, model), toxic.astype(float), np.where(toxic > 0, rates[1], rates[0]))
    return model


def _pool_texts(data: np.ndarray, offs: np.ndarray, model: dict) -> np.ndarray:
    """The layer's inputs of each text."""
    pooled = [np.zeros((0, 4))]
    for i, j in textops.slices(offs):
        part, at = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        h, rows, starts, ends = all_words(part, at)
        pooled.append(_pooled(_values(part, starts, ends, h, model) if len(h) else np.zeros(0), rows, j - i))
    return np.concatenate(pooled)


def _values(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray, model: dict) -> np.ndarray:
    _, index, inverse = np.unique(h, return_index=True, return_inverse=True)
    values = [np.zeros(0)]
    for i in range(0, len(index), _AT_ONCE):
        some = index[i : i + _AT_ONCE]
        values.append(decision(*encode_words(data, starts[some], ends[some]), model["beta"], model["bias"]))
    return np.concatenate(values)[inverse]


def score_texts(column: pa.Array, model: dict) -> np.ndarray:
    x = _pool_texts(*textops.text_buffers(column), model)
    return 1 / (1 + np.exp(-np.clip(x @ model["layer"][:-1] + model["layer"][-1], -30, 30)))


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(1)) == 0


def _fit(counts: tuple[int, int]):
    """Rows (text, toxic) of the sample to one row, the fitted machine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).cast(pa.string()), b.column(1).to_numpy(zero_copy_only=False)) for b in batches]
        texts, toxic = [pa.array([], pa.string())] + [t for t, _ in held], [np.zeros(0, np.int64)] + [y for _, y in held]
        model = train(pa.concat_arrays(texts), np.concatenate(toxic), counts)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    return run


def fit(docs: DataFrame, labels: DataFrame, most_docs: int = MOST_DOCS, most_bytes: int = MOST_BYTES) -> dict:
    """Train on at most ``most_docs`` labelled documents of each class, of at most ``most_bytes`` each, none of them held out.

    Which ones is decided by a hash of their id and text. Labels other than 0 and 1 and null ids are no labels. The sample is
    bounded, so one task fits the machine, and only the machine comes to the driver.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic"))
    # ids and lengths decide; texts are read for the sample alone
    lengths = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).alias("bytes"))
    rows = lengths.join(known, F.col("doc_id") == F.col("_id"))
    counts = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("doc_id", F.lit(9))
    sample = []
    for y in (0, 1):
        ids = rows.where((F.col("bytes") <= most_bytes) & (F.col("toxic") == y)).orderBy(order, "doc_id").limit(most_docs).select("doc_id").distinct()
        texts = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi").where(F.octet_length("text") <= most_bytes)
        sample.append(texts.orderBy(order, "text").limit(most_docs).select("text", F.lit(y).alias("toxic")))
    both = limit_arrow(sample[0].union(sample[1])).repartition(1).sortWithinPartitions("toxic", F.xxhash64("text"), "text")
    totals = counts.get(0, 0), counts.get(1, 0)
    found = both.mapInArrow(_fit(totals), "model binary").collect()
    return pickle.loads(found[0][0]) if found else train(pa.array([], pa.string()), np.zeros(0, np.int64), totals)


def score(docs: DataFrame, model: dict, name: str = "score") -> DataFrame:
    """Add the column ``name`` (0 to 1) to ``docs``; a null text is empty, and a text without words gets the score of no evidence."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score_texts(text, shared.value))], [*names, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return limit_arrow(docs).mapInArrow(run, f"{schema}, `{name}` double")


def clean(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """The documents that the machine, trained on the labelled ones among them, does not call toxic, with all their columns.

    Columns may have any names, those of the results included. An empty table, or one without labels of both classes, is
    judged by the share of its toxic labels (none: nothing goes).
    """
    name = "score"
    while name in (c.lower() for c in docs.columns):
        name = f"_{name}"
    return score(docs, fit(docs, labels, **bounds), name).where(F.col(name) < 0.5).select(*(F.col(f"`{c}`") for c in docs.columns))


def classify(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs`` (columns doc_id and text; others are ignored).

    Only labels of rows that are not held out are learned. Repeated rows get the same score, an empty table no rows; with
    labels of one class or none every text gets that class's share.
    """
    model = fit(docs, labels, **bounds)
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
