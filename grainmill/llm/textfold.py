"""Character folding shared by the text operators: ignorable characters, compatibility forms, look-alike letters, words."""

from __future__ import annotations

import unicodedata

# Letters that look like a Latin letter, by script.
CYRILLIC = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Ԍ": "G", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Ѵ": "V", "Ԝ": "W", "Х": "X", "У": "Y",
}
GREEK = {
    "α": "a", "ϲ": "c", "ι": "i", "ϳ": "j", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "χ": "x",
    "Α": "A", "Β": "B", "Ϲ": "C", "Ε": "E", "Η": "H", "Ι": "I", "Ϳ": "J", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ζ": "Z",
}
ARMENIAN = {"ց": "g", "հ": "h", "ո": "n", "օ": "o", "ս": "u", "Լ": "L", "Օ": "O", "Ս": "U"}
LATIN = {"ı": "i", "ɑ": "a", "ɡ": "g", "ʏ": "Y", "ℓ": "l"}
SCRIPTS = ("LATIN", "CYRILLIC", "GREEK", "ARMENIAN")
LOOKALIKE = CYRILLIC | GREEK | ARMENIAN | LATIN
#: Compatibility forms that look as their parts do; superscripts, circled and styled letters look different and stay.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>")
#: Characters without a look of their own, besides category Cf.
IGNORABLE = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}


def same_look(ch: str) -> str | None:
    """What a character becomes so that equal looks are equal: None if it is ignorable, ' ' for any space or line end."""
    code, cat = ord(ch), unicodedata.category(ch)
    if cat in ("Zs", "Zl", "Zp") or ch in "\t\n\r\v\f\x1c\x1d\x1e\x1f\x85":
        return " "
    if code in IGNORABLE or cat == "Cf" or cat == "Cc":
        return None
    if ch in "‐‑":
        return "-"
    parts = unicodedata.decomposition(ch)
    if parts and (parts[0] != "<" or parts.startswith(SAME_LOOK)):
        return "".join(same_look(c) or "" if c != ch else c for c in unicodedata.normalize("NFKC", ch)) or None
    return ch


class _Looks(dict):
    """A translate table that fills itself: characters to their common look."""

    def __missing__(self, code: int) -> str | None:
        self[code] = value = same_look(chr(code))
        return value


class _Words(dict):
    """A translate table that fills itself: lower case, Latin look-alikes, punctuation and symbols to spaces."""

    def __missing__(self, code: int) -> str | None:
        value = same_look(chr(code))
        if value is not None:
            value = "".join(LOOKALIKE.get(c, c) for c in value).lower()
            value = "".join(" " if unicodedata.category(c)[0] in "PS" else c for c in value)
        self[code] = value
        return value


_LOOKS, _WORDS = _Looks(), _Words()


def fold_looks(text: str) -> str:
    """Compatibility and composed forms, no ignorable characters, single spaces; look-alike letters are kept."""
    text = " ".join(text.translate(_LOOKS).split())
    return text if text.isascii() else unicodedata.normalize("NFC", text)


def fold_words(text: str) -> list[str]:
    """Words without case, punctuation, spacing and mere character form; digits and accents stay."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    return text.translate(_WORDS).split()
