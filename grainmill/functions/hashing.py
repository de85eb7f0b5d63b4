"""Fingerprints: canonical JSON, configurations, states of named arrays, vectors' bits."""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def canonical_json(value: object) -> str:
    """Keys sorted, no blanks, no ASCII escapes."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def fingerprint(value: object, digits: int = 64) -> str:
    """sha256 of a value's canonical JSON, or its first digits."""
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()[:digits]


def state_hash(arrays: dict[str, np.ndarray]) -> str:
    """sha256 over names in order, kinds, shapes and bytes."""
    h = hashlib.sha256()
    for name in sorted(arrays):
        a = np.ascontiguousarray(arrays[name])
        h.update(canonical_json([name, str(a.dtype), list(a.shape)]).encode())
        h.update(a.tobytes())
    return h.hexdigest()


@F.pandas_udf(T.StringType())
def json_hash(text: pd.Series) -> pd.Series:
    """sha256 of the canonical form of JSON texts; null for null or invalid ones."""

    def one(t: str | None) -> str | None:
        try:
            return None if t is None else fingerprint(json.loads(t))
        except ValueError:
            return None

    return text.map(one)
