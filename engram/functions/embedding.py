"""The n-gram hash embedder: words and character trigrams, hashed with signs into a unit vector."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from engram.errors import EngineError, invalid

_SPACE, _BREAK = re.compile(r"\s+"), re.compile(r"[\W_]+")


def fnv1a(s: str) -> int:
    """32-bit FNV-1a over UTF-16 code units."""
    h = 0x811C9DC5
    for unit in _units(s).tolist():
        h = ((h ^ unit) * 0x01000193) & 0xFFFFFFFF
    return h


def _units(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-16-le", "surrogatepass"), dtype=np.uint16)


def embed_texts(texts: list[str], dim: int = 256, seen: dict[str, int] | None = None) -> np.ndarray:
    """A unit vector for each text: its words and the trigrams of its UTF-16 code units, hashed with signs.

    Trigrams are hashed for all texts at once; a word is hashed where it is first seen.
    """
    seen = {} if seen is None else seen
    clean = [_SPACE.sub(" ", t.lower()).strip() for t in texts]
    owners, hashes = [], []
    for i, t in enumerate(clean):
        words = [w for w in _BREAK.split(t) if w]
        for w in words:
            if w not in seen:
                seen[w] = fnv1a("w:" + w)
        owners.append(np.full(len(words), i))
        hashes.append(np.fromiter((seen[w] for w in words), np.uint32, len(words)))
    parts = [_units(f" {t} ") for t in clean]
    lengths = np.array([len(p) for p in parts], dtype=np.int64)
    if len(texts):
        flat, row = np.concatenate(parts).astype(np.uint32), np.repeat(np.arange(len(texts)), lengths)
        h = np.full(max(0, len(flat) - 2), fnv1a("g:"), dtype=np.uint32)
        for k in range(3):
            h = (h ^ flat[k : k + len(h)]) * np.uint32(0x01000193)
        whole = row[: len(h)] == row[2:]
        owners.append(row[: len(h)][whole])
        hashes.append(h[whole])
    owner, h = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (owners, hashes))
    h = h.astype(np.int64)
    v = np.bincount(owner * dim + h % dim, np.where(h >> 31 & 1, -1.0, 1.0), len(texts) * dim).reshape(len(texts), dim)
    norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return (v / np.where(norm > 0, norm, 1.0)).astype(np.float32)


def embed_text(text: str, dim: int = 256) -> np.ndarray:
    return embed_texts([text], dim)[0]


@dataclass(frozen=True)
class EmbeddingSpace:
    """What makes two vectors comparable."""

    embedder_kind: str
    model_id: str
    dimension: int
    normalize: bool = True
    prefix_policy: str = "none"
    prompt_template_hash: str = ""

    def check(self, other: EmbeddingSpace | None) -> None:
        if other is None or other != self:
            raise EngineError("EMBEDDING_SPACE_MISMATCH", f"{other} is not {self}")


def ngram_space(dim: int = 256) -> EmbeddingSpace:
    return EmbeddingSpace("ngram", f"ngram-{dim}", dim, prompt_template_hash=hashlib.sha256(f"ngram|{dim}".encode()).hexdigest()[:16])


def ngram_embed(text: Column, dim: int = 256) -> Column:
    """Arrow-batched embedding of a text column (null: empty)."""
    if dim < 16:
        raise invalid("dimension must be at least 16")

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        seen: dict[str, int] = {}
        for batch in batches:
            if len(seen) > 500_000:
                seen.clear()
            texts = [t or "" for t in batch]
            blocks = [embed_texts(texts[i : i + 512], dim, seen) for i in range(0, len(texts), 512)]
            yield pd.Series([row for block in blocks for row in block])

    return embed(text)


def create_embedder(spec: str, allow_fallback: bool = False) -> tuple[Callable[[Column], Column], EmbeddingSpace]:
    """``ngram[:dim]``; ``onnx:<model>`` needs model files that aren't here, unless a fallback to n-grams is allowed."""
    kind, _, rest = spec.partition(":")
    if kind == "ngram":
        dim = int(rest or 256)
        return (lambda c: ngram_embed(c, dim)), ngram_space(dim)
    if kind == "onnx" and allow_fallback:
        return (lambda c: ngram_embed(c)), ngram_space()
    raise EngineError("EMBEDDER_UNAVAILABLE", f"no embedder for {spec}")
