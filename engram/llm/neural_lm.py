"""A log-bilinear language model (Mnih and Hinton, 2007), trained with noise-contrastive estimation (Mnih and Teh, 2012).

Units: the ``SHORTLIST`` most frequent words, ``BUCKETS`` groups of all other words by their first two bytes, and the end
of a text. The context is the unit before (or the start). Training reads all training texts: the tasks count every pair of
neighbouring units, and the driver climbs the contrastive objective over that table, whose size the shortlist bounds. The
noise is the units' own distribution, ``NOISE`` noise words to a true one, taken by expectation instead of sampling.

Probabilities are normalised: batched matrix products give the sums over all units for every context. A word of a bucket has
the bucket's probability times (c + 0.5) / (N_b + 0.5 (V_b + 1)), where c is its count and N_b and V_b count the bucket's
words; the rest is left for words never seen.

Counts are over all training texts. Those of the ``FREQUENT`` most frequent words are broadcast (a few MB at any input size);
the other words of a text are joined to their counts by hash. Words are told apart by a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm import textops
from engram.llm.textops import limit_arrow
from engram.session import materialise

SHORTLIST = 2048
BUCKETS = 64
FREQUENT = 1 << 18
DIM = 24
NOISE = 100
STEPS = 60
RATE = 0.15
_CHUNK_WORDS = 1 << 21
_LOG10 = np.log(10.0)


def training(doc_id: F.Column) -> F.Column:
    return ~held_out(doc_id)


def held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def buckets_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.int64)
    first = textops._LOWER[data[starts]].astype(np.int64)
    second = np.where(ends - starts > 1, textops._LOWER[data[np.minimum(starts + 1, len(data) - 1)]], 0)
    return (first * 31 + second) % BUCKETS


# counts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = docs = 0

    def flush() -> pa.RecordBatch:
        h = np.concatenate([x for x, _ in held]) if held else np.zeros(0, np.uint64)
        b = np.concatenate([x for _, x in held]) if held else np.zeros(0, np.int64)
        distinct, index, n = np.unique(h, return_index=True, return_counts=True)
        columns = [np.append(distinct.view(np.int64), 0), np.append(b[index], -1), np.append(n, docs)]  # bucket -1: ends
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["word", "bucket", "n"])

    for batch in batches:
        data, offs = textops.text_buffers(batch.column(0))
        docs += batch.num_rows
        for i, j in textops.slices(offs):
            part, at = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            h, _, starts, ends = textops.words(part, at)
            held.append((h, buckets_of(part, starts, ends)))
            size += len(h)
            if size > _CHUNK_WORDS:
                yield flush()
                held.clear()
                size = docs = 0
    if held or docs:
        yield flush()


def count_words(docs: DataFrame) -> DataFrame:
    """word (hash), bucket and n over all texts of ``docs``; bucket -1 counts the ends."""
    found = limit_arrow(docs).select("text").mapInArrow(_count, "word long, bucket long, n long")
    return found.groupBy("word", "bucket").agg(F.sum("n").alias("n"))


class Vocabulary:
    """The frequent words with their counts, the units, and the totals that the counts of all words give."""

    def __init__(self, counts: DataFrame):
        words = counts.where("bucket >= 0")
        per_bucket = {r["bucket"]: (r["n"], r["v"]) for r in counts.groupBy("bucket").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
        top = words.orderBy(F.col("n").desc(), "word").limit(FREQUENT).toArrow()
        h, n, b = (top.column(c).to_numpy() for c in ("word", "n", "bucket"))
        h = h.view(np.uint64)
        order = np.argsort(h)
        rank = np.arange(len(h))
        self.hashes, self.counts, self.rank = h[order], n[order].astype(np.int64), rank[order]
        self.short = min(SHORTLIST, len(h))
        self.n_short, self.bucket_short = n[: self.short].astype(np.int64), b[: self.short]
        self.ends = per_bucket.get(-1, (0, 0))[0]
        self.total = sum(x for x, _ in per_bucket.values())
        self.distinct = sum(v for k, (_, v) in per_bucket.items() if k >= 0) + (self.ends > 0)
        self.bucket_n = np.array([per_bucket.get(k, (0, 0))[0] for k in range(BUCKETS)], dtype=np.int64)
        self.bucket_v = np.array([per_bucket.get(k, (0, 0))[1] for k in range(BUCKETS)], dtype=np.int64)
        np.subtract.at(self.bucket_n, self.bucket_short, self.n_short)
        np.subtract.at(self.bucket_v, self.bucket_short, 1)
        self.end = self.short + BUCKETS
        self.units = self.end + 1
        self.begin = self.units  # a context, never predicted

    def frequencies(self) -> np.ndarray:
        """Smoothed shares of the units in the training texts: the noise distribution."""
        n = np.concatenate([self.n_short, self.bucket_n, [self.ends]]).astype(float) + 1.0
        return n / n.sum()

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, count) of each word; -1 and 0 for those that aren't frequent."""
        if not len(self.hashes):
            return np.full(len(hashes), -1), np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        hit = self.hashes[at] == hashes
        return np.where(hit, self.rank[at], -1), np.where(hit, self.counts[at], 0)

    def sequence(self, ranks: np.ndarray, buckets: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(unit, unit before, row) of all words and ends, text by text."""
        unit = np.where((ranks >= 0) & (ranks < self.short), ranks, self.short + buckets)
        lengths = np.bincount(rows, minlength=n_rows) if len(rows) else np.zeros(n_rows, np.int64)
        n = len(unit) + n_rows
        row = np.repeat(np.arange(n_rows), lengths + 1)
        is_end = np.zeros(n, dtype=bool)
        is_end[np.cumsum(lengths + 1) - 1] = True
        out = np.empty(n, dtype=np.int64)
        out[is_end], out[~is_end] = self.end, unit
        before = np.full(n, self.begin)
        before[1:] = np.where(is_end[:-1], self.begin, out[:-1])
        return out, before, row


def _pairs(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        total = np.zeros((v.units + 1) * v.units, dtype=np.int64)
        for batch in batches:
            data, offs = textops.text_buffers(batch.column(0))
            for i, j in textops.slices(offs):
                part, at = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                h, rows, starts, ends = textops.words(part, at)
                ranks, _ = v.look_up(h)
                out, before, _ = v.sequence(ranks, buckets_of(part, starts, ends), rows, j - i)
                pair, n = np.unique(before * v.units + out, return_counts=True)
                total[pair] += n
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], ["pair", "n"])

    return run


def count_pairs(docs: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """How often each unit (column) follows each context (row) in the texts of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    found = limit_arrow(docs).select("text").mapInArrow(_pairs(shared), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros((vocabulary.units + 1) * vocabulary.units, dtype=np.float32)
    table[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    return table.reshape(vocabulary.units + 1, vocabulary.units)


def train(pairs: np.ndarray, noise: np.ndarray, steps: int = STEPS, seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context vectors, unit vectors, biases) that climb the noise-contrastive objective over the counted pairs.

    A pair is told from noise by its score less log(NOISE * its noise probability). Steps are Adam's, on gradients of the mean.
    """
    rng = np.random.default_rng(seed)
    total = max(float(pairs.sum()), 1.0)
    true = pairs / np.float32(total)
    context = true.sum(axis=1, keepdims=True)
    false = (context * (NOISE * noise[None, :])).astype(np.float32)
    shift = np.log(NOISE * noise).astype(np.float32)
    both = true + false
    weights = [rng.normal(0, 0.1, (len(pairs), DIM)).astype(np.float32), rng.normal(0, 0.1, (len(noise), DIM)).astype(np.float32), np.log(noise).astype(np.float32)]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, steps + 1):
        q, r, bias = weights
        score = q @ r.T
        score += bias - shift
        np.clip(score, -30, 30, out=score)
        np.negative(score, out=score)
        np.exp(score, out=score)
        score += 1
        np.divide(both, score, out=score)  # what is taken for true
        gradient = true - score
        gradients = [gradient @ r, gradient.T @ q, gradient.sum(axis=0)]
        rate = RATE * min(1.0, 2 * (1 - (step - 1) / steps))
        for w, g, m, s in zip(weights, gradients, first, second, strict=True):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            w += rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-12)
    return weights[0], weights[1], weights[2]


def log_probabilities(weights: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Normalised log10 probability of each unit (column) behind each context (row), by batched matrix products."""
    q, r, bias = weights
    out = np.empty((len(q), len(r)), dtype=np.float32)
    for i in range(0, len(q), 256):
        s = q[i : i + 256] @ r.T + bias
        s -= s.max(axis=1, keepdims=True)
        out[i : i + 256] = (s - np.log(np.exp(s).sum(axis=1, keepdims=True))) / np.float32(_LOG10)
    return out


_SCORED = "rid long, doc_id long, n_tokens long, n_known long, base_score double, score double, rare array<long>, times array<int>"


def _scorer(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, log_p = model.value
        base = np.log10(v.total + 0.5 * (v.distinct + 1))
        in_bucket = np.log10(v.bucket_n + 0.5 * (v.bucket_v + 1))
        for batch in batches:
            data, offs = textops.text_buffers(batch.column(2))
            for i, j in textops.slices(offs):
                part, at = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                n = j - i
                h, rows, starts, ends = textops.words(part, at)
                ranks, counts = v.look_up(h)
                buckets = buckets_of(part, starts, ends)
                out, before, row = v.sequence(ranks, buckets, rows, n)
                score = np.bincount(row, log_p[before, out], n)
                frequent = ranks >= 0
                own = np.where(frequent, np.log10(counts + 0.5), 0.0)
                beyond = (~frequent) | (ranks >= v.short)
                score += np.bincount(rows, np.where(beyond, own - in_bucket[buckets], 0.0), n)
                lengths = np.bincount(rows, minlength=n)
                base_score = np.bincount(rows, own, n) + np.log10(v.ends + 0.5) - (lengths + 1) * base
                known = np.bincount(rows, frequent, n).astype(np.int64) + (v.ends > 0)
                rare = np.flatnonzero(~frequent)
                order = rare[np.lexsort((h[rare], rows[rare]))]
                rh, rr = h[order], rows[order]
                begin = np.flatnonzero(np.append(len(rh) > 0, (rh[1:] != rh[:-1]) | (rr[1:] != rr[:-1])))
                times = np.diff(np.append(begin, len(rh)))
                cut = np.searchsorted(rr[begin], np.arange(n + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, n), batch.column(1).slice(i, n), pa.array(lengths + 1, pa.int64()), pa.array(known, pa.int64()), pa.array(base_score), pa.array(score),
                        pa.ListArray.from_arrays(pa.array(cut), pa.array(rh[begin].view(np.int64))), pa.ListArray.from_arrays(pa.array(cut), pa.array(times.astype(np.int32))),
                    ],
                    ["rid", "doc_id", "n_tokens", "n_known", "base_score", "score", "rare", "times"],
                )

    return run


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs``.

    Columns doc_id and text are read, others ignored. A null text is empty: its only token is the end. Rows with a null
    doc_id are learned from. Repeated rows get the same scores; an empty table gives no rows. Without training texts
    all words are unknown and the model's units are equally likely.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    learned = rows.where(training(F.col("doc_id")))
    counts = materialise(count_words(learned), "words")
    vocabulary = Vocabulary(counts)
    weights = train(count_pairs(learned, vocabulary), vocabulary.frequencies())
    model = docs.sparkSession.sparkContext.broadcast((vocabulary, log_probabilities(weights)))
    numbered = limit_arrow(rows).select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
    scored = materialise(numbered.mapInArrow(_scorer(model), _SCORED), "scored")

    pairs = scored.select("rid", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("rid", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    # a word that isn't among the frequent ones is no more frequent than they, so no key is hot
    seen = pairs.join(counts.where("bucket >= 0").select("word", "n"), "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    extra = seen.groupBy("rid").agg(F.sum(F.col("times") * F.log10(F.col("n") + 0.5)).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more_known"))
    whole = scored.drop("rare", "times").join(extra, "rid", "left")
    more = F.coalesce("more", F.lit(0.0))
    return whole.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(vocabulary.total).cast("long").alias("train_tokens"), (F.col("base_score") + more).alias("base_score"), (F.col("score") + more).alias("score"),
    )
