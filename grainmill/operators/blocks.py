"""Cutting words into byte blocks that never split a character."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


def cut(raw: bytes, size: int) -> list[bytes]:
    out = []
    while raw:
        end = min(size, len(raw))
        while end < len(raw) and end > 1 and raw[end] & 0xC0 == 0x80:
            end -= 1
        out.append(raw[:end])
        raw = raw[end:]
    return out


def overflow_blocks(df: DataFrame, column: str, size: int) -> DataFrame:
    """word, block, piece: the blocks of each word in order. Nulls have none."""

    def part(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = [(w, k, b.decode(errors="replace")) for w in pdf[column].dropna() for k, b in enumerate(cut(w.encode(), size))]
            yield pd.DataFrame(rows, columns=["word", "block", "piece"])

    return df.select(column).mapInPandas(part, "word string, block int, piece string")
