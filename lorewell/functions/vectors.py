"""Vector algebra over arrays, accumulated in doubles."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """Scaled to length 1; a zero vector stays."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def hash_embedding(text: str, dimensions: int) -> np.ndarray:
    """Offline vector: dimension i from the SHA-256 of the text and i, scaled to length 1."""
    raw = [hashlib.sha256(text.encode() + i.to_bytes(4, "little")).digest()[:4] for i in range(dimensions)]
    v = np.frombuffer(b"".join(raw), "<i4").astype(np.float32) / np.float32(2**31 - 1)
    n = np.sqrt((v * v).sum())
    return v / n if n > 0 else v


def embedder(dimensions: int = 768):
    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: hash_embedding(t or "", dimensions))

    return embed
