"""Problem 7: evaluation texts leaking into training text, by pigeonhole edit matching.

A leaked passage has at least `passage` words of an item in at most two stretches, at most one word in NINE altered. Cut the
item into pieces of PIECE words on a grid: a stretch of 24 words at any place holds at least (24 - PIECE + 1) / PIECE = 5
whole pieces, which is the error budget (24 / 9 = 2 altered words, and a third for rounding) plus the break between
stretches plus one; so one piece at least stands in the document unaltered. Pieces are looked up by the hash of their words
in all documents; a hit is verified by Myers' bit-parallel distance: windows of VERIFY words of the item around the piece
are searched in the document around the hit, and a match is carried on to the neighbouring windows; a piece that no window
covers is extended word by word, so that short stretches count. Each stretch is measured by the distance as a whole.

Items of at most MOST_SENT bytes of text in all, a checked size, go to every task, and the documents stay where they are:
one narrow scan without a shuffle. More items are joined with the documents' pieces by key, and the pairs that share one are
verified by the same function. Both ways give the same rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .editdistance import distance, search
from .textfold import fold_words

PASSAGE, PIECE, NINE, VERIFY = 24, 4, 9, 12
#: A line that at least so many items share is an instruction line.
SHARED_LINE = 3
#: Words of a passage that must be the item's own, and not of a shared line.
OWN = 20
#: Words at the edges of a passage that windows on the grid may miss.
EDGE = 4
#: Words of the shortest stretch that counts without a window of its own.
SHORT = 8
#: Bytes of item texts up to which they are sent to every task.
MOST_SENT = 8 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHash(dict):
    """Words to 63-bit hashes, kept for reuse up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word) >> 1
        return value


def keys(words: np.ndarray) -> np.ndarray:
    """The hash of every PIECE consecutive words."""
    n = max(0, len(words) - PIECE + 1)
    key = np.full(n, np.uint64(PIECE))
    for j in range(PIECE):
        key = (key ^ words[j : j + n]) * _MIX
        key ^= key >> np.uint64(31)
    return key


class Item:
    """One test item: its words as hashes, which of them stand in shared lines, pieces on the grid, windows made when first used."""

    def __init__(self, item_id: int, words: list[int], shared: list[bool]):
        self.id, self.words, self.shared = item_id, words, np.array(shared, bool)
        at = range(0, len(words) - PIECE + 1, PIECE)
        every = keys(np.array(words, np.uint64))
        self.pieces = [(int(every[p]), p) for p in at if not self.shared[p : p + PIECE].all()]
        self._masks: dict[int, tuple[dict[int, int], int]] = {}

    def window(self, p: int) -> tuple[dict[int, int], int]:
        """Bit masks by word, and the length, of the window at p."""
        if (known := self._masks.get(p)) is None:
            masks: dict[int, int] = {}
            part = self.words[p : p + VERIFY]
            for i, w in enumerate(part):
                masks[w] = masks.get(w, 0) | 1 << i
            known = self._masks[p] = masks, len(part)
        return known

    def starts(self) -> range:
        return range(0, max(1, len(self.words) - VERIFY + 1), PIECE)


def item_lines(text: str, code: WordHash) -> list[tuple[int, list[int]]]:
    """A text's lines: the hash of the whole line and those of its words."""
    rows = (fold_words(line) for line in text.splitlines())
    return [(xxhash.xxh3_64_intdigest(" ".join(w)) >> 1, [code[x] for x in w]) for w in rows if w]


class Items:
    """The test items and all their pieces, sorted by key."""

    def __init__(self, rows: list[tuple[int, str]]):
        code = WordHash()
        split = [(item, item_lines(text, code)) for item, text in rows]
        count = Counter(h for _, lines in split for h in {h for h, _ in lines})
        self.items = [Item(item, [w for _, ws in lines for w in ws], [count[h] >= SHARED_LINE for h, ws in lines for _ in ws]) for item, lines in split]
        pieces: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, item in enumerate(self.items):
            for key, p in item.pieces:
                pieces[key].append((k, p))
        self.keys = np.array(sorted(pieces), np.uint64)
        self.at = [pieces[int(x)] for x in self.keys]


def _hits(items: Items, texts: list[str], code: WordHash) -> Iterator[tuple[int, list[int], dict[int, list[tuple[int, int]]]]]:
    """Per text with a piece: its number, its words, and by item number the hits (place in the item, place in the text)."""
    docs = [[code[w] for w in fold_words(t)] for t in texts]
    lens = np.array([len(d) for d in docs], np.int64)
    flat = np.fromiter((w for d in docs for w in d), np.uint64, int(lens.sum()))
    if len(flat) < PIECE or not len(items.keys):
        return
    key = keys(flat)
    where = np.minimum(np.searchsorted(items.keys, key), len(items.keys) - 1)
    at = np.flatnonzero(items.keys[where] == key)
    ends = np.cumsum(lens)
    owner = np.searchsorted(ends, at, side="right")
    inside = at + PIECE <= ends[owner]
    at, owner = at[inside], owner[inside]
    for d in np.unique(owner):
        base = int(ends[d] - lens[d])
        seeds: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for q in at[owner == d]:
            for k, p in items.at[where[q]]:
                seeds[k].append((p, int(q) - base))
        yield int(d), docs[d], seeds


def _match(item: Item, p: int, doc: list[int], expected: int) -> tuple[int, int] | None:
    """(edits, end in the document) of the item's window at p near the expected place, if within the budget."""
    masks, m = item.window(p)
    budget = max(1, -(-m // NINE))
    low = max(0, expected - 4)
    edits, end = search(masks, m, doc[low : expected + m + 4])
    return (edits, low + end) if edits <= budget else None


def passage(item: Item, doc: list[int], places: list[tuple[int, int]]) -> tuple[int, int, int] | None:
    """(matched words, own words, edits) of the best one or two stretches of an item in a document, around exact pieces (place in the item, in the document)."""
    starts = item.starts()
    found: dict[tuple[int, int], int] = {}
    tried: set[tuple[int, int]] = set()
    todo = [(s, q - p + s) for p, q in places for s in (p - 8, p - 4, p) if s in starts]
    while todo:
        s, expected = todo.pop()
        near = (s, (expected + 2) // 4)
        if near in tried:
            continue
        tried.add(near)
        if hit := _match(item, s, doc, expected):
            edits, end = hit
            if found.get((s, end), 99) > edits:
                found[s, end] = edits
                begin = end - VERIFY
                todo += [(t, begin + t - s) for t in (s - PIECE, s + PIECE) if t in starts]
    return _best(item, doc, sorted(found), places)


def _grow(w: list[int], doc: list[int], lo: int, hi: int, a: int, b: int) -> tuple[int, int, int, int]:
    """Extend a stretch (item lo..hi, document a..b) word by word over equal words, at most one altered word in between."""
    while lo and a and (w[lo - 1] == doc[a - 1] or (lo > 2 and a > 2 and w[lo - 2] == doc[a - 2] and w[lo - 3] == doc[a - 3])):
        step = 1 if w[lo - 1] == doc[a - 1] else 3
        lo, a = lo - step, a - step
    while hi < len(w) and b < len(doc) and (w[hi] == doc[b] or (hi + 2 < len(w) and b + 2 < len(doc) and w[hi + 1] == doc[b + 1] and w[hi + 2] == doc[b + 2])):
        step = 1 if w[hi] == doc[b] else 3
        hi, b = hi + step, b + step
    return lo, hi, a, b


def _tighten(w: list[int], doc: list[int], lo: int, hi: int, a: int, b: int) -> tuple[int, int, int, int]:
    """Take a stretch's ends in to the first and last two equal words; windows on the grid may hang over a passage."""
    i, j = next(((i, j) for i in range(lo, min(lo + 8, hi - 1)) for j in range(max(0, a - 2), min(a + 10, b - 1)) if w[i] == doc[j] and w[i + 1] == doc[j + 1]), (lo, a))
    x, y = next(((x, y) for x in range(hi, max(hi - 8, i + 1), -1) for y in range(min(len(doc), b + 2), max(b - 10, j + 1), -1) if w[x - 1] == doc[y - 1] and w[x - 2] == doc[y - 2]), (hi, b))
    return i, x, j, y


def _best(item: Item, doc: list[int], windows: list[tuple[int, int]], places: list[tuple[int, int]]) -> tuple[int, int, int] | None:
    """The best one or two stretches made of matched windows (start in the item, end in the document) and of pieces that none covers."""
    m = min(VERIFY, len(item.words))
    stretches: list[list[int]] = []
    for s, end in windows:
        for st in stretches:
            if s <= st[1] and abs((end - s) - (st[3] - (st[1] - m))) <= 3 and s >= st[0]:
                st[1], st[3] = max(st[1], s + m), max(st[3], end)
                break
        else:
            stretches.append([s, s + m, max(0, end - m), end])
    grown = [_grow(item.words, doc, *_tighten(item.words, doc, *st)) for st in stretches]
    windowed = len(grown)
    for p, q in places:
        if not any(lo <= p and p + PIECE <= hi and a <= q and q + PIECE <= b for lo, hi, a, b in grown):
            lone = _grow(item.words, doc, p, p + PIECE, q, q + PIECE)
            if lone[1] - lone[0] >= SHORT:
                grown.append(lone)
    scored = []
    for k, (lo, hi, a, b) in enumerate(grown):
        edits = distance(item.words[lo:hi], doc[a:b])
        # A stretch without a window has only its words to speak for it.
        if edits * (NINE - 2 if k < windowed else NINE) <= hi - lo:
            scored.append((lo, hi, a, b, edits, hi - lo, int((~item.shared[lo:hi]).sum()), k >= windowed))
    best = None
    for x in scored:
        for y in [None, *scored]:
            if y is None:
                total = x[5], x[6], x[4]
            elif y[0] >= x[1] - 2 and y[2] >= x[3] - 2:
                total = x[5] + y[5], x[6] + y[6], x[4] + y[4]
                if (x[7] or y[7]) and total[2] * NINE > total[0]:
                    continue
            else:
                continue
            if best is None or total[0] - 3 * total[2] > best[0] - 3 * best[2]:
                best = total
    return best


def _good(eval_items: DataFrame) -> DataFrame:
    return eval_items.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select("item_id", "text").distinct()


MATCHES = "doc_id long, item_id long, matched_words int, own_words int, edits int"
_COLUMNS = ["doc_id", "item_id", "matched_words", "own_words", "edits"]


def _scanned(texts: DataFrame, eval_items: DataFrame) -> DataFrame:
    """Matches with the items in every task."""
    items = texts.sparkSession.sparkContext.broadcast(Items(sorted((r["item_id"], r["text"]) for r in _good(eval_items).collect())))

    def part(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = WordHash()
        for pdf in it:
            ids, rows = pdf["doc_id"].tolist(), []
            for d, doc, seeds in _hits(items.value, pdf["text"].tolist(), code):
                for k, places in seeds.items():
                    if best := passage(items.value.items[k], doc, places):
                        rows.append((ids[d], items.value.items[k].id, *best))
            yield pd.DataFrame(rows, columns=_COLUMNS)

    return texts.mapInPandas(part, MATCHES)


def _joined(texts: DataFrame, eval_items: DataFrame) -> DataFrame:
    """Matches by a join of the documents' pieces with the items', and of the pairs found with their texts."""

    def lines(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = WordHash()
        for pdf in it:
            rows = [(i, h, n, line, ws) for i, t, h in zip(pdf["item_id"], pdf["text"], pdf["_t"]) for n, (line, ws) in enumerate(item_lines(t, code))]
            yield pd.DataFrame(rows, columns=["item_id", "_t", "n", "line", "words"])

    def pieces(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = [(i, h, np.uint64(key).astype(np.int64)) for i, h, ls in zip(pdf["item_id"], pdf["_t"], pdf["lines"]) for key in {k for k, _ in _item(i, ls).pieces}]
            yield pd.DataFrame(rows, columns=["item_id", "_t", "key"])

    def cut(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = WordHash()
        for pdf in it:
            for d, h, t in zip(pdf["doc_id"], pdf["_d"], pdf["text"]):
                words = [code[w] for w in fold_words(t)]
                key = np.unique(keys(np.array(words, np.uint64))).astype(np.int64)
                yield pd.DataFrame({"doc_id": np.full(len(key), d), "_d": np.full(len(key), h), "key": key})

    def verify(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = WordHash()
        for pdf in it:
            rows = []
            for d, t, i, ls in zip(pdf["doc_id"], pdf["text"], pdf["item_id"], pdf["lines"]):
                item, doc = _item(i, ls), [code[w] for w in fold_words(t)]
                at: dict[int, list[int]] = defaultdict(list)
                for key, p in item.pieces:
                    at[key].append(p)
                places = [(p, q) for q, key in enumerate(keys(np.array(doc, np.uint64)).tolist()) for p in at.get(key, ())]
                if places and (best := passage(item, doc, places)):
                    rows.append((d, i, *best))
            yield pd.DataFrame(rows, columns=_COLUMNS)

    split = _good(eval_items).withColumn("_t", F.xxhash64("text")).mapInPandas(lines, "item_id long, _t long, n int, line long, words array<long>")
    shared = split.groupBy("line").agg(F.countDistinct("item_id", "_t").alias("_n")).where(F.col("_n") >= SHARED_LINE).select("line", F.lit(True).alias("shared"))
    # The lines of one item, in order.
    line = F.struct("n", "words", F.coalesce("shared", F.lit(False)).alias("shared"))
    items = split.join(shared, "line", "left").groupBy("item_id", "_t").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    docs = texts.where("doc_id is not null").withColumn("_d", F.xxhash64("text"))
    own = docs.select("doc_id", "_d", "text").distinct().mapInPandas(cut, "doc_id long, _d long, key long")
    pairs = own.join(items.mapInPandas(pieces, "item_id long, _t long, key long"), "key").select("doc_id", "_d", "item_id", "_t").distinct()
    return pairs.join(docs, ["doc_id", "_d"]).join(items, ["item_id", "_t"]).select("doc_id", "text", "item_id", "lines").mapInPandas(verify, MATCHES)


def _item(item_id: int, lines: list) -> Item:
    return Item(item_id, [int(w) for x in lines for w in x["words"]], [x["shared"] for x in lines for _ in x["words"]])


def matches(documents: DataFrame, eval_items: DataFrame, most_sent: int = MOST_SENT) -> DataFrame:
    """Every document of split train and item with matched stretches: matched words, own words (not of shared lines), edits."""
    texts = documents.where((F.col("split") == "train") & F.col("text").isNotNull()).select("doc_id", "text")
    size = eval_items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    return _scanned(texts, eval_items) if size <= most_sent else _joined(texts, eval_items)


def leaks(documents: DataFrame, eval_items: DataFrame, passage_words: int = PASSAGE, own_words: int = OWN, most_sent: int = MOST_SENT) -> DataFrame:
    """Documents of split train that hold a passage of an item, with the item: doc_id, item_id, matched_words, own_words, edits.

    A passage: at least passage_words - EDGE matched words in one or two stretches, own_words - EDGE of them not of lines that
    items share, at most about one in NINE altered; so an item of fewer words is never reported (lower passage_words for
    such). Null texts, null ids and empty tables give no rows; repeated rows of documents repeat theirs, repeated items count
    once. Columns other than doc_id, split and text, item_id and text are not read.
    """
    found = matches(documents, eval_items, most_sent).where(F.col("doc_id").isNotNull())
    return found.where((F.col("matched_words") >= passage_words - EDGE) & (F.col("own_words") >= own_words - EDGE) & (F.col("edits") * NINE <= F.col("matched_words") + NINE))


def leak_report(documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    """Per suite and item: the training documents that hold a passage of it."""
    hit = leaks(documents, eval_items).groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.max("matched_words").alias("most_words"))
    return eval_items.select("suite", "item_id").distinct().join(hit, "item_id")
