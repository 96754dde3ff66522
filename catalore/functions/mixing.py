"""The seeded order of ids: a bijective 64-bit mixer of id and seed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.types import LongType

_U = np.uint64
#: Increment, multipliers and shifts of the splitmix64 generator.
GOLDEN, M1, M2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
MASK = (1 << 64) - 1


def mix64(x: int) -> int:
    """The finalizer on one unsigned number."""
    x = (x + GOLDEN) & MASK
    x = ((x ^ (x >> 30)) * M1) & MASK
    x = ((x ^ (x >> 27)) * M2) & MASK
    return x ^ (x >> 31)


def signed(x: int) -> int:
    """The signed number of the same 64 bits."""
    return x - (1 << 64) if x >> 63 else x


def pk_mix(ids: Column, seed: int) -> Column:
    """Pseudo-random but fixed order key of an id under a seed; null ids give null."""
    start = _U(mix64(seed & MASK))

    @F.arrow_udf(LongType())
    def mixed(values: pa.Array) -> pa.Array:
        x = values.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ start
        with np.errstate(over="ignore"):
            x = x + _U(GOLDEN)
            x = (x ^ (x >> _U(30))) * _U(M1)
            x = (x ^ (x >> _U(27))) * _U(M2)
            x = x ^ (x >> _U(31))
        return pa.array(x.view(np.int64), mask=np.asarray(values.is_null()))

    return mixed(ids.cast("long"))
