"""Cosine similarity on embedding columns, computed on whole Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _matrix(vectors: pa.ListArray) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(vectors), -1) if len(vectors) else flat.reshape(0, 1)


def _of_length(vectors: pa.ListArray, length: int) -> np.ndarray:
    """Which vectors are there and have this length; others have no similarity."""
    return pc.fill_null(pc.equal(pc.list_value_length(vectors), length), False).to_numpy(zero_copy_only=False)


def _masked(score: np.ndarray, length: int, valid: np.ndarray) -> pa.Array:
    out = np.zeros(length)
    out[valid] = score
    return pa.array(out, mask=~valid | np.isnan(out))


def cosine_to(query: Sequence[float]) -> Callable[[Column], Column]:
    """Similarity of an embedding column to one query vector."""
    needle = np.asarray(query, dtype=np.float64)
    with np.errstate(invalid="ignore", divide="ignore"):
        needle = needle / np.linalg.norm(needle)

    @F.arrow_udf(T.DoubleType())
    def score(vectors: pa.Array) -> pa.Array:
        valid = _of_length(vectors, len(needle))
        rows = _matrix(vectors.filter(pa.array(valid)))
        with np.errstate(invalid="ignore", divide="ignore"):
            values = rows @ needle / np.linalg.norm(rows, axis=1) if len(rows) else np.zeros(0)
        return _masked(values, len(vectors), valid)

    return score


def cosine(left: Column, right: Column) -> Column:
    """Similarity of two embedding columns, row by row."""

    @F.arrow_udf(T.DoubleType())
    def score(a: pa.Array, b: pa.Array) -> pa.Array:
        values = np.full(len(a), np.nan)
        for length in pc.unique(pc.list_value_length(a)).drop_null().to_pylist():
            alike = _of_length(a, length) & _of_length(b, length)
            x, y = (_matrix(v.filter(pa.array(alike))) for v in (a, b))
            with np.errstate(invalid="ignore", divide="ignore"):
                values[alike] = np.einsum("ij,ij->i", x, y) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))
        return _masked(values, len(a), np.ones(len(a), bool))

    return score(left, right)


def cosine_to_many(queries: Sequence[Sequence[float]]) -> Callable[[Column], Column]:
    """Similarities of an embedding column to a fixed, small set of query vectors, as an array."""
    needles = np.asarray(queries, dtype=np.float64)
    needles = needles / np.linalg.norm(needles, axis=1, keepdims=True)

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def score(vectors: pa.Array) -> pa.Array:
        valid = _of_length(vectors, needles.shape[1])
        values = np.full((len(vectors), len(needles)), np.nan)
        if valid.any():
            rows = _matrix(vectors.filter(pa.array(valid)))
            with np.errstate(invalid="ignore", divide="ignore"):
                values[valid] = rows @ needles.T / np.linalg.norm(rows, axis=1, keepdims=True)
        flat = values.ravel()
        return pa.ListArray.from_arrays(
            pa.array(np.arange(len(vectors) + 1) * len(needles), pa.int32()), pa.array(flat, mask=np.isnan(flat)))

    return score


@F.arrow_udf(T.IntegerType())
def usable_length(vectors: pa.Array) -> pa.Array:
    """Length of an embedding that has a direction; null if it is missing, zero, or holds null or non-finite components."""
    found = np.zeros(len(vectors), np.int32)
    for length in pc.unique(pc.list_value_length(vectors)).drop_null().to_pylist():
        alike = _of_length(vectors, length)
        norms = np.linalg.norm(_matrix(vectors.filter(pa.array(alike))), axis=1) if length else np.zeros(alike.sum())
        found[alike] = np.where(np.isfinite(norms) & (norms > 0), length, 0)
    return pa.array(found, mask=found == 0)


def nearest_cell(centroids: np.ndarray) -> Callable[[Column], Column]:
    """Number of the unit centroid nearest to an embedding (the lowest of equals), -1 for those without a direction or of another length."""

    @F.arrow_udf(T.IntegerType())
    def cell(vectors: pa.Array) -> pa.Array:
        valid = _of_length(vectors, centroids.shape[1])
        rows = _matrix(vectors.filter(pa.array(valid)))
        best = np.full(len(rows), -1, np.int32)
        norms = np.linalg.norm(rows, axis=1)
        directed = np.flatnonzero(np.isfinite(norms) & (norms > 0))
        for at in range(0, len(directed), 4096):
            part = directed[at:at + 4096]
            best[part] = (rows[part] / norms[part, None] @ centroids.T).argmax(1)
        found = np.full(len(vectors), -1, np.int32)
        found[valid] = best
        return pa.array(found)

    return cell
