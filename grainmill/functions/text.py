"""Text functions on columns: cleaning policies, byte tokens, turns, lengths, formats."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What Python's str.split() takes for white space, as a regular expression class (Java and RE2 alike). Fixed values.
SPACE = r"\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: Where str.splitlines() cuts.
LINE = r"\x{D}\x{A}|[\x{A}-\x{D}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"
BYTE_OFFSET, PAD, BOS, EOS = 3, 0, 1, 2


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Canonical composition; ASCII texts pass untouched. Null stays null."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def line_ends(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def clean_prose(text: Column) -> Column:
    """Line ends to LF, NFC, runs of white space to one space, none at the ends."""
    return strip(F.regexp_replace(nfc(line_ends(text)), f"[{SPACE}]+", " "))


def clean_code(text: Column) -> Column:
    """Line ends to LF, NFC, no white space around the text or at the end of a line; lines and indentation stay."""
    lines = F.split(strip(nfc(line_ends(text))), LINE)
    return F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, f"[{SPACE}]+$", "")), "\n")


def clean(text: Column, lane: Column) -> Column:
    """The lane's cleaning policy: code keeps its lines, all else is prose."""
    return F.when(lane == "code", clean_code(text)).otherwise(clean_prose(text))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def byte_tokens(text: pd.Series) -> pd.Series:
    """UTF-8 bytes plus BYTE_OFFSET."""
    return text.map(lambda t: None if t is None else np.frombuffer(t.encode(), np.uint8).astype(np.int32) + BYTE_OFFSET)


@F.pandas_udf(T.StringType())
def byte_text(tokens: pd.Series) -> pd.Series:
    """The text of byte tokens, special tokens left out; null if the bytes are no UTF-8."""

    def one(t: np.ndarray | None) -> str | None:
        if t is None:
            return None
        b = np.asarray(t, np.int64)
        try:
            return (b[b >= BYTE_OFFSET] - BYTE_OFFSET).astype(np.uint8).tobytes().decode()
        except UnicodeDecodeError:
            return None

    return tokens.map(one)


def rendered_turns(turns: Column) -> Column:
    """'<role> text' and a line end per turn."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<"), F.coalesce(t["role"], F.lit("")), F.lit("> "), F.coalesce(t["text"], F.lit("")), F.lit("\n"))), "")


def length_bucket(n: Column) -> Column:
    """Byte length classes; the last one catches all above."""
    return F.when(n <= 8, "1-8").when(n <= 16, "9-16").when(n <= 32, "17-32").when(n <= 64, "33-64").otherwise("65-128")


def human_bytes(value: Column) -> Column:
    """Binary units with two decimals."""
    v = value.cast("double")
    out = F.format_string("%.2f TiB", v / F.lit(1024.0**4))
    for k, unit in ((3, "GiB"), (2, "MiB"), (1, "KiB"), (0, "B")):
        out = F.when(F.abs(v / F.lit(1024.0**k)) < 1024, F.format_string(f"%.2f {unit}", v / F.lit(1024.0**k))).otherwise(out)
    return out


def hash_bucket(key: Column, buckets: int) -> Column:
    """int(sha256(key)[:8], 16) % buckets."""
    return F.pmod(F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int")


def html_escape(text: Column) -> Column:
    """The five characters that HTML reserves."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def thousands(value: Column, digits: int = 0) -> Column:
    """A number with separators, an em dash for null."""
    return F.coalesce(F.format_number(value, digits), F.lit("—"))


def mean_code(df: DataFrame, key: str, column: str, size: int = 32) -> DataFrame:
    """key, coordinate, value: position * 256 + byte of each byte, of one over the word's length. A word of more than `size` bytes raises an error."""
    h, n = F.hex(F.encode(column, "UTF-8")), F.octet_length(column)
    n = F.when(n > size, F.raise_error(F.lit(f"more than {size} bytes")).cast("int")).otherwise(n)
    rows = df.select(key, h.alias("_h"), n.alias("_n")).where("_n > 0").select(key, "_h", "_n", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_i"))
    byte = F.conv(F.substr(F.col("_h"), F.col("_i") * 2 + 1, F.lit(2)), 16, 10).cast("int")
    return rows.select(key, (F.col("_i") * 256 + byte).alias("coordinate"), F.round(1 / F.col("_n"), 9).alias("value"))


class CharTokenizer:
    """Characters to ids behind pad (0) and end (1). The alphabet is small whatever the corpus, and is kept in order of code points."""

    pad, eos = 0, 1

    def __init__(self, chars: list[str]):
        self.chars = sorted(chars)

    @classmethod
    def of(cls, df: DataFrame, column: str) -> CharTokenizer:
        return cls([r["ch"] for r in df.select(F.explode(F.split(column, "")).alias("ch")).where("ch <> ''").distinct().collect()])

    @property
    def vocabulary(self) -> int:
        return len(self.chars) + 2

    def encode(self, text: Column, end: bool = True) -> Column:
        """Ids of a text; a character outside the alphabet raises an error."""
        ids = F.create_map(*[F.lit(x) for i, c in enumerate(self.chars) for x in (c, i + 2)]) if self.chars else F.create_map().cast("map<string,int>")
        each = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.coalesce(ids[c], F.raise_error(F.concat(F.lit("no id for "), c)).cast("int")))
        return F.concat(each, F.array(F.lit(self.eos))) if end else each

    def decode(self, ids: Column) -> Column:
        """The text of ids; pad and end are left out."""
        chars = F.array(*[F.lit(c) for c in self.chars]).cast("array<string>")
        return F.array_join(F.transform(F.filter(ids, lambda i: i > self.eos), lambda i: F.get(chars, i - 2)), "")
