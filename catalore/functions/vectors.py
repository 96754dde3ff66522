"""Vector distances and the int8 codec, Arrow batches in numpy."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, ByteType, DoubleType

L2, COSINE = "L2", "cosine"


def _rows(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values end to end, lengths; a null list has length -1)."""
    null = np.asarray(values.is_null())
    lengths = np.diff(values.offsets.to_numpy())
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.where(null, -1, lengths)


def _matrix(values: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of the given dimension, which rows those are)."""
    flat, lengths = _rows(values)
    ends = np.cumsum(np.maximum(lengths, 0))
    good = lengths == dim
    if good.all():
        return flat.reshape(-1, dim), good
    starts = ends - np.maximum(lengths, 0)
    return flat[(starts[good][:, None] + np.arange(dim)).reshape(-1)].reshape(-1, dim), good


def _distance(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    if metric == L2:
        return np.sqrt(((a - b) ** 2).sum(1))
    norms = np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1) if b.ndim > 1 else (b * b).sum())
    with np.errstate(invalid="ignore", divide="ignore"):
        return 1.0 - (a * b).sum(1) / norms


def _out(found: np.ndarray, good: np.ndarray) -> pa.Array:
    out = np.full(len(good), np.nan)
    out[good] = found
    return pa.array(out, mask=np.isnan(out))


def distance_to(column: Column, query, metric: str = L2) -> Column:
    """Distance to one vector; null where the dimension differs, a value is not a number or cosine has no norm."""
    q = np.asarray(query, dtype=np.float64)

    @F.arrow_udf(DoubleType())
    def run(values: pa.Array) -> pa.Array:
        x, good = _matrix(values, len(q))
        return _out(_distance(x, q, metric), good)

    return run(column)


def distance(left: Column, right: Column, metric: str = L2) -> Column:
    """Distance of two vector columns, row by row; null as in ``distance_to``."""

    @F.arrow_udf(DoubleType())
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        out = np.full(len(a), np.nan)
        la, lb = _rows(a)[1], _rows(b)[1]
        for dim in set(la[(la == lb) & (la > 0)].tolist()):
            x, ga = _matrix(a, dim)
            y, gb = _matrix(b, dim)
            both = ga & gb
            out[both] = _distance(x[both[ga]], y[both[gb]], metric)
        return pa.array(out, mask=np.isnan(out))

    return run(left, right)


def scale_from_absmax(absmax: float | None) -> float:
    """Step of the int8 code: the largest magnitude over 127, 1 where that is no positive number."""
    s = np.float32(absmax if absmax is not None else 0.0) / np.float32(127.0)
    return float(s) if np.isfinite(s) and s > 0 else 1.0


def absmax(column: Column) -> Column:
    """The largest finite magnitude in a vector."""
    return F.array_max(F.transform(F.filter(column, lambda x: ~F.isnan(x)), lambda x: F.abs(x)))


def quantize(column: Column, scale: float | Column) -> Column:
    """int8 codes: value over scale in single precision, halves to even, clamped. A column of scales has no nulls."""

    @F.arrow_udf(ArrayType(ByteType()))
    def run(values: pa.Array, scales: pa.Array) -> pa.Array:
        flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
        lengths = np.where(np.asarray(values.is_null()), 0, np.diff(values.offsets.to_numpy()))
        steps = np.repeat(scales.to_numpy(zero_copy_only=False).astype(np.float32), lengths)
        coded = np.nan_to_num(np.clip(np.rint(flat / steps), -128, 127)).astype(np.int8)
        offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32), mask=np.append(np.asarray(values.is_null()), False))
        return pa.ListArray.from_arrays(offsets, pa.array(coded))

    return run(column, scale if isinstance(scale, Column) else F.lit(scale))


def load_npy(data: bytes) -> np.ndarray:
    """The vector in an NPY file: one dimension, or the first row of two."""
    x = np.load(io.BytesIO(data), allow_pickle=False)
    if x.ndim not in (1, 2) or x.size == 0 or x.dtype.kind not in "fiub":
        raise ValueError(f"no vector in an array of shape {x.shape} and type {x.dtype}")
    return np.asarray(x if x.ndim == 1 else x[0], dtype=np.float32)


def load_npy_rows(data: bytes) -> list[list[float]]:
    """The rows of an NPY file of little-endian floats in C order."""
    x = np.load(io.BytesIO(data), allow_pickle=False)
    if x.dtype.kind != "f" or x.dtype.byteorder == ">" or not x.flags.c_contiguous or x.ndim not in (1, 2):
        raise ValueError("expected little-endian floats in C order, one or two dimensions")
    return np.atleast_2d(x).astype(np.float32).tolist()
