"""A deterministic embedder of hashed words and trigrams: the only model that needs no download."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIMS, WORD, TRIGRAM = 768, 1.0, 0.5
_SALT = 0x9E3779B97F4A7C15
_WORDS = re.compile(r"[^\W_]+")


def fnv1a(data: bytes) -> int:
    """64-bit FNV-1a."""
    h = 0xCBF29CE484222325
    for b in data:
        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return h


def embed_text(text: str, dims: int = DIMS) -> np.ndarray:
    """Signed feature hashing: a word weighs 1, each of its trigrams (with a blank at both ends) a half; unit length."""
    out, low = np.zeros(dims, dtype=np.float32), text.lower()
    features = [(fnv1a(w.encode()), WORD) for w in _WORDS.findall(low)]
    for w in _WORDS.findall(low):
        padded = f" {w} "
        features += [(fnv1a(padded[k : k + 3].encode()) ^ _SALT, TRIGRAM) for k in range(len(padded) - 2)]
    for h, weight in features or [(fnv1a(low.encode()), WORD)]:
        out[h % dims] += weight if h >> 63 == 0 else -weight
    norm = np.linalg.norm(out)
    return out / norm if norm > 0 else out


@F.pandas_udf(T.StructType([T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("error_code", T.StringType())]))
def embed(text: pd.Series) -> pd.DataFrame:
    """A vector for each text; empty or missing ones get an error code of their own and don't fail their batch."""
    rows = [(None, "empty_input") if t is None or not t.strip() else (embed_text(t).tolist(), None) for t in text]
    return pd.DataFrame(rows, columns=["vector", "error_code"])
