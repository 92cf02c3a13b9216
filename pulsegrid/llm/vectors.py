"""What the operators on vectors share: which vectors count, and how they travel."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def whole(col: str = "embedding") -> Column:
    """Not null, and every component a finite number."""
    return F.col(col).isNotNull() & F.forall(col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def packing(dtype: str):
    """A column function that packs an array's numbers as bytes of this type; integers that it can't hold are refused."""

    @F.pandas_udf("binary")
    def run(x: pd.Series) -> pd.Series:
        def pack(v: np.ndarray) -> bytes:
            out = np.asarray(v).astype(dtype)
            if out.dtype.kind == "i" and (out != np.asarray(v)).any():
                raise ValueError(f"a component doesn't fit {dtype}")
            return out.tobytes()

        return x.map(pack)

    return run


def unpacked(blobs: pd.Series, dtype: str) -> np.ndarray:
    """[rows, components] of packed vectors of one length."""
    return np.frombuffer(b"".join(blobs), dtype).reshape(len(blobs), -1 if len(blobs) and len(blobs.iloc[0]) else 0)


def exact_floats(*parts: np.ndarray) -> list[np.ndarray]:
    """Integer matrices as floats where every inner product of their rows is exact in them, which is faster, else as 64-bit integers."""
    top = max((float(np.abs(x.astype(np.int64)).max()) for x in parts if x.size), default=0.0)
    fits = top * top * parts[0].shape[1] < 2.0**52
    return [x.astype(np.float64 if fits else np.int64) for x in parts]
