"""Bit-parallel edit distances (Myers 1999, with Hyyrö's carry handling) over sequences of hashable symbols.

A Python integer is the bit vector, so a pattern may have any length; a text symbol costs a few integer operations.
"""

from __future__ import annotations

from collections.abc import Hashable, Sequence


def distance(pattern: Sequence[Hashable], text: Sequence[Hashable]) -> int:
    """Least number of insertions, deletions and substitutions that turn pattern into text."""
    m = len(pattern)
    if not m or not len(text):
        return max(m, len(text))
    masks: dict[Hashable, int] = {}
    for i, symbol in enumerate(pattern):
        masks[symbol] = masks.get(symbol, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    get = masks.get
    for symbol in text:
        eq = get(symbol, 0)
        x = eq | down
        d0 = ((((x & up) + up) ^ up) | x) & full
        plus, minus = down | (full & ~(d0 | up)), up & d0
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus = (plus << 1 | 1) & full
        minus = minus << 1 & full
        up, down = minus | (full & ~(d0 | plus)), plus & d0
    return score


def search(masks: dict[Hashable, int], m: int, text: Sequence[Hashable]) -> tuple[int, int]:
    """Least distance of the pattern (bit masks by symbol, length m) to a stretch of text that may start and end anywhere, and the first such end."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best, end = full, 0, m, m, 0
    get = masks.get
    for j, symbol in enumerate(text, 1):
        eq = get(symbol, 0)
        x = eq | down
        d0 = ((((x & up) + up) ^ up) | x) & full
        plus, minus = down | (full & ~(d0 | up)), up & d0
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        if score < best:
            best, end = score, j
        plus = plus << 1 & full
        minus = minus << 1 & full
        up, down = minus | (full & ~(d0 | plus)), plus & d0
    return best, end


def common_length(a: Sequence[Hashable], b: Sequence[Hashable]) -> int:
    """Length of the longest common subsequence, bit-parallel: a cleared bit of the vector is a symbol of `a` matched so far."""
    masks: dict[Hashable, int] = {}
    for i, symbol in enumerate(a):
        masks[symbol] = masks.get(symbol, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for symbol in b:
        hit = row & masks.get(symbol, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()
