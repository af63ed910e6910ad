"""Embeddings as bytes and back."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def from_blob(raw: bytes) -> list[float]:
    """Little-endian 32-bit floats; bytes left over are dropped."""
    return np.frombuffer(raw[: len(raw) // 4 * 4], "<f4").astype(float).tolist()


def to_blob(values: list[float]) -> bytes:
    return np.asarray(values, "<f4").tobytes()


def decoded(c: Column) -> Column:
    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        return x.map(from_blob, na_action="ignore")

    return run(c)


def encoded(c: Column) -> Column:
    @F.pandas_udf("binary")
    def run(x: pd.Series) -> pd.Series:
        return x.map(to_blob, na_action="ignore")

    return run(c)
