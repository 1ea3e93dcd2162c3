"""Many small records as a few rows of arrays: what a task has for one part of the keys travels as one row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def blob(x: np.ndarray) -> bytes:
    """The numbers' first bytes, then their second ones and so on: the zeros of small numbers stand together and compress."""
    return np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.dtype.itemsize).T).tobytes()


def numbers(raw: bytes, kind: type) -> np.ndarray:
    """What :func:`blob` was made of."""
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(kind).ravel()


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[dict]]]:
    """Rows sorted by ``key``, a group at a time."""
    now, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if held and row[key] != now:
                yield now, held
                held = []
            now = row[key]
            held.append(row)
    if held:
        yield now, held


def dealt(part: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """A row for each part, with the part's share of each column."""
    order = np.argsort(part, kind="stable")
    sorted_part = part[order]
    begin = np.flatnonzero(np.append(len(part) > 0, sorted_part[1:] != sorted_part[:-1]))
    ends = np.append(begin, len(part))[1:]
    arrays = [pa.array(sorted_part[begin].astype(np.int32))]
    for c in columns.values():
        c = c[order]
        arrays.append(pa.array([blob(c[i:j]) for i, j in zip(begin.tolist(), ends.tolist(), strict=True)], pa.binary()))
    return pa.RecordBatch.from_arrays(arrays, ["part", *columns])


def joined(rows: list[dict], name: str, kind: type) -> np.ndarray:
    """A column of a group's rows, as one array."""
    return np.concatenate([numbers(r[name], kind) for r in rows])
