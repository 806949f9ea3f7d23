"""Vectors as providers send them: base64 of little-endian floats."""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WIDTHS = {"float16": "<f2", "float32": "<f4"}


def decoded(text: Column, kind: str = "float32") -> Column:
    """The vector behind a base64 string; null for null or what is not whole floats."""
    dtype = np.dtype(WIDTHS[kind])

    @F.pandas_udf("array<float>")
    def decode(values: pd.Series) -> pd.Series:
        def one(v):
            try:
                return np.frombuffer(base64.b64decode(v, validate=True), dtype).astype(np.float32)
            except (TypeError, ValueError):
                return None

        return values.map(one)

    return decode(text)


def encoded(vector: Column, kind: str = "float32") -> Column:
    """A vector as base64."""
    dtype = np.dtype(WIDTHS[kind])

    @F.pandas_udf("string")
    def encode(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else base64.b64encode(np.asarray(v, dtype).tobytes()).decode())

    return encode(vector)
