"""Problem 3: the same or nearly the same records across splits, by winnowing fingerprints.

Texts are folded to words; equal word sequences form a class, of which one representative goes on. Neither texts nor words
are ever stored: what is kept are keys, and texts are read and folded anew where their words are wanted.

A text that may stand e edits from another (`pieces_needed` is e + 1) has one of any e + 1 disjoint pieces of it whole in the
other. So the representatives with members outside train lay down e + 1 pieces of LENGTHS words, the rarest of about SPARE
times as many; those with members in train look for all their runs of that many words. Which runs are frequent is estimated
from a bounded sample; only speed depends on it. Frequent pieces that a text must lay down are dealt over several keys.

A key is a piece, a range of text lengths and a range of places in the text, as near-same texts agree in these about; a
Bloom filter of what is laid down leaves of the runs those that have a counterpart. What the join yields is settled before
it is shuffled, by exact lengths and places and by word signatures (one bit a word), which may not differ in more bits than
the allowed edits can flip. The words of the pairs left are read again and verified: seeds are chained collinearly, the
stretches between them aligned with a bit-parallel edit distance over words, and each record's coverage is the share of its
words in the longest common subsequence. A text of fewer than SHORT words must share GRAM words in a row.

`fingerprints` is the winnowing by which pairs were searched before; no query uses it.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .editdistance import common_length, distance
from .skew import with_members
from .textfold import fold_looks, fold_words

GRAM, WIDEST, LEAST, SEVEN = 3, 4, 12, 7
#: Frequent fingerprints: those of at least HOT_COUNT of about SAMPLE sampled texts; at most HOT_MOST are known.
SAMPLE, HOT_COUNT, HOT_MOST = 25_000, 3, 300_000
#: A text keeps one in KEEP of the fingerprints that must be shared, however frequent.
KEEP = 6
#: Texts of one fingerprint that a join key takes.
SPLIT = 20_000
#: Words of a piece; pieces that a text has for each one it needs; texts below SHORT words are laid down with all their runs.
LENGTHS, SPARE, SHORT = np.array([3, 4]), 1.2, 11
#: Texts are compared by buckets of length, one such a step longer than the other.
STEP = 1.2
#: A Bloom filter: bits looked at for a number, binary logarithms of its largest size and of the bits that one row carries.
PROBES, MOST_BITS, BLOCK = 2, 29, 15
BLANK = "\x00"
#: Words of 64 bits in a signature.
SIGNATURE = 4
_P = np.uint64(0x9E3779B97F4A7C15)
_M = np.uint64(0xD6E8FEB86659FD93)


class WordHash(dict):
    """Words to 32-bit hashes, kept for reuse up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = value = xxhash.xxh32_intdigest(word)
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M
    return x ^ (x >> np.uint64(29))


def grams(words: np.ndarray, length: int) -> np.ndarray:
    """Rolling hashes (63 bits) of every `length` consecutive words of a concatenation of texts."""
    w = words.astype(np.uint64)
    n = max(0, len(w) - length + 1)
    h = np.full(n, np.uint64(length))
    for k in range(length):
        h = h * _P + w[k : k + n]
    return _mix(h) >> np.uint64(1)


def allowed(n: int | np.ndarray) -> int | np.ndarray:
    """Altered words allowed in a text of n words: about one in seven."""
    return -(-n // SEVEN)


def shared(n: np.ndarray, window: int | np.ndarray) -> np.ndarray:
    """Fingerprints that a text of n words keeps and shares with a near-same one that is no longer."""
    e = allowed(n)
    return -(-((n - e) - (e + 1) * (GRAM + window - 2)) // window)


def _rules(longest: int = 1 << 14) -> tuple[np.ndarray, np.ndarray]:
    """Per number of words: the window, and what a near-same pair whose shorter text has so many words must share."""
    n = np.arange(longest)
    window = np.ones(longest, np.int64)
    for w in range(2, WIDEST + 1):
        enough = np.minimum.accumulate(shared(n, w)[::-1])[::-1] >= LEAST
        window[enough] = w
    own = shared(n, window)
    # The longer text of a pair has n + its own allowance of words at most.
    most = np.minimum(longest - 1, n * SEVEN // (SEVEN - 1) + 2)
    must = own.copy()
    for i in range(longest * (SEVEN - 1) // SEVEN - 2):
        must[i] = own[i : most[i] + 1].min()
    return window, must


WINDOWS, MUST = _rules()


def rules(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows and the fingerprints that must be shared; beyond the table the promise grows with n, but for its steps."""
    far = n >= len(MUST) * (SEVEN - 1) // SEVEN - 2
    return np.where(far, WIDEST, WINDOWS[np.minimum(n, len(MUST) - 1)]), np.where(far, shared(n, WIDEST) - 2, MUST[np.minimum(n, len(MUST) - 1)])


def fingerprints(texts: list[np.ndarray], hot: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text number, fingerprint, sampled count) of a batch of texts; per text how many a near-same one shares, and how many were left out.

    hot (sorted) and counts: known frequent fingerprints. A text leaves out its most frequent ones, by (count, fingerprint)
    downwards, but keeps one in KEEP of what must be shared.
    """
    lens = np.array([len(t) for t in texts], np.int64)
    words = np.concatenate(texts) if len(texts) else np.zeros(0, np.uint32)
    ends = np.cumsum(lens)
    owner = np.repeat(np.arange(len(texts)), lens)
    windows, bound = rules(lens)
    h = grams(words, GRAM)
    o = owner[: len(h)]
    last = np.arange(len(h)) + GRAM
    known = np.isin(h, hot)
    # Rare fingerprints go first in every window.
    key = h | (known.astype(np.uint64) << np.uint64(63))
    keep = (windows[o] == 1) & (last <= ends[o])
    for w in range(2, WIDEST + 1):
        at = np.flatnonzero(windows[o] == w)
        if not len(at):
            continue
        # Windows that lie within their text, by first place; a place is kept if it is the least of one.
        inside = at[last[at] + w - 1 <= ends[o[at]]]
        least = key[inside]
        for d in range(1, w):
            least = np.minimum(least, key[inside + d])
        for d in range(w):
            keep[inside[key[inside + d] == least] + d] = True
    text, fp = o[keep], h[keep]
    selected = np.bincount(text, minlength=len(texts))
    at = np.minimum(np.searchsorted(hot, fp), max(0, len(hot) - 1))
    often = np.where(hot[at] == fp, counts[at], 0) if len(hot) else np.zeros(len(fp), np.int64)
    order = np.lexsort((fp, often, text))[::-1]
    text, fp, often = text[order], fp[order], often[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (fp[1:] != fp[:-1])
    text, fp, often = text[new], fp[new], often[new]
    distinct = np.bincount(text, minlength=len(texts))
    # A text in which a fingerprint stands again and again may lose more places than fingerprints.
    must = np.maximum(1, bound - (selected - distinct))
    spare = must - np.maximum(1, must // KEEP)
    # Texts come last to first here, each from its most frequent fingerprint down.
    begin = np.concatenate(([0], np.flatnonzero(text[1:] != text[:-1]) + 1)) if len(text) else np.zeros(0, np.int64)
    place = np.arange(len(text)) - np.repeat(begin, np.diff(np.concatenate((begin, [len(text)]))))
    out = (often > 0) & (place < spare[text])
    dropped = np.bincount(text[out], minlength=len(texts))
    return text[~out], fp[~out], often[~out], must.astype(np.int32), dropped.astype(np.int32)


def pieces_needed(n: int | np.ndarray) -> int | np.ndarray:
    """One more than the edits to the longest text that a text of n words can be nearly the same as."""
    return allowed((SEVEN * n + SEVEN - 1) // (SEVEN - 1)) + 1


def piece_length(n: np.ndarray) -> np.ndarray:
    """Words of a piece: the longest of LENGTHS of which a text of n words has enough beside those it leaves out as frequent."""
    out = np.full(len(n), LENGTHS[0])
    for g in LENGTHS[1:]:
        out[n // g >= SPARE * pieces_needed(n)] = g
    return out


def _asked(longest: int = 1 << 12) -> np.ndarray:
    """Per number of words, as bits by place in LENGTHS: the pieces of which lengths a text must look for, as its counterparts have them."""
    n = np.arange(longest)
    place = np.searchsorted(LENGTHS, piece_length(n))
    return np.array([np.bitwise_or.reduce(1 << place[max(0, i - allowed(i)) : (SEVEN * i + SEVEN - 1) // (SEVEN - 1) + 1]) for i in range(longest * (SEVEN - 1) // SEVEN - 2)])


ASKED = _asked()


def bucket(n: np.ndarray) -> np.ndarray:
    """Texts by length, in steps of a fifth."""
    return np.floor(np.log(np.maximum(n, 1)) / np.log(STEP)).astype(np.int64)


def reach(k: np.ndarray) -> np.ndarray:
    """By how many places a run of words may stand apart in near-same texts, of which one is in bucket k."""
    most = np.ceil(STEP ** (k + 1.0)).astype(np.int64)
    return allowed((SEVEN * most + SEVEN - 1) // (SEVEN - 1))


def cell(fp: np.ndarray, k: np.ndarray, at: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """The join key (63 bits) of a run of words in texts of bucket k, about a place."""
    return _mix(fp * _P + _mix((k * 1_000_003 + at).astype(np.uint64) * _M + salt.astype(np.uint64))) >> np.uint64(1)


def cells(fp: np.ndarray, n: np.ndarray, place: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys under which a counterpart of a text of n words may have laid down a run, and the number of the run."""
    low, high = bucket(n - allowed(n)), bucket((SEVEN * n + SEVEN - 1) // (SEVEN - 1))
    keys, runs = [], []
    for d in range(int((high - low).max(initial=-1)) + 1):
        of = np.flatnonzero(low + d <= high)
        k = low[of] + d
        far = reach(k)
        first, last = (place[of] - far) // (far + 1), (place[of] + far) // (far + 1)
        for at in range(3):
            some = first + at <= last
            keys.append(cell(fp[of[some]], k[some], (first + at)[some], salt[of[some]]))
            runs.append(of[some])
    return np.concatenate([np.zeros(0, np.uint64), *keys]), np.concatenate([np.zeros(0, np.int64), *runs])


class Texts:
    """Many texts as one array of word hashes."""

    def __init__(self, texts: list[np.ndarray]):
        self.n = np.array([len(t) for t in texts], np.int64)
        self.words = np.concatenate([np.zeros(0, np.uint32), *texts])
        self.ends = np.cumsum(self.n)
        self.owner = np.repeat(np.arange(len(texts)), self.n)

    def grams(self, length: int, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text number, place and hash of every run of `length` words of the texts flagged in `of`."""
        h = grams(self.words, length)
        owner = self.owner[: len(h)]
        at = np.flatnonzero(of[owner] & (np.arange(len(h)) + length <= self.ends[owner]))
        text = owner[at]
        return text, at - (self.ends - self.n)[text], h[at]


def often(fp: np.ndarray, hot: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sampled counts of hashes; hot (sorted) and counts are those known as frequent."""
    if not len(hot):
        return np.zeros(len(fp), np.int64)
    at = np.minimum(np.searchsorted(hot, fp), len(hot) - 1)
    return np.where(hot[at] == fp, counts[at], 0)


def laid_down(texts: Texts, hot: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, place, hash and sampled count of the pieces by which a text is found: as many disjoint ones as it needs, the rarest; all runs of a short text."""
    size = piece_length(texts.n)
    parts = []
    for g in LENGTHS:
        text, place, fp = texts.grams(g, size == g)
        keep = (place % g == 0) | (texts.n[text] < SHORT)
        parts.append((text[keep], place[keep], fp[keep]))
    text, place, fp = (np.concatenate(x) for x in zip(*parts))
    count = often(fp, hot, counts)
    order = np.lexsort((fp, count, text))
    text, place, fp, count = text[order], place[order], fp[order], count[order]
    begin = np.searchsorted(text, np.arange(len(texts.n)))
    keep = (np.arange(len(text)) - begin[text] < pieces_needed(texts.n)[text]) | (texts.n[text] < SHORT)
    return text[keep], place[keep], fp[keep], count[keep]


def looked_for(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, place and hash of all runs of a text that may be a counterpart's piece."""
    asked = np.where(texts.n < len(ASKED), ASKED[np.minimum(texts.n, len(ASKED) - 1)], 1 << len(LENGTHS) - 1)
    parts = [texts.grams(g, (asked >> k & 1) > 0) for k, g in enumerate(LENGTHS)]
    return tuple(np.concatenate(x) for x in zip(*parts))


def signature(words: np.ndarray) -> list[int]:
    """SIGNATURE * 64 bits, one set for each word's hash; an edit flips two at most."""
    bits = np.zeros(SIGNATURE * 64, np.uint8)
    bits[(words.astype(np.uint64) * _M >> np.uint64(40)) % np.uint64(SIGNATURE * 64)] = 1
    return np.packbits(bits).view(np.int64).tolist()


def chain(a: list[int], b: list[int], length: int = GRAM) -> list[tuple[int, int]]:
    """Collinear seeds (i, j): a[i:i+length] == b[j:j+length], strictly increasing in both; seeds are runs unique in a."""
    at: dict[tuple[int, ...], int] = {}
    for i in range(len(a) - length + 1):
        g = tuple(a[i : i + length])
        at[g] = -1 if g in at else i
    seeds = [(j, i) for j in range(len(b) - length + 1) if (i := at.get(tuple(b[j : j + length]), -1)) >= 0]
    tails: list[int] = []
    best: list[int] = []
    link = [-1] * len(seeds)
    for k, (_, i) in enumerate(seeds):
        p = bisect_left(tails, i)
        link[k] = best[p - 1] if p else -1
        if p == len(tails):
            tails.append(i)
            best.append(k)
        else:
            tails[p], best[p] = i, k
    out, k = [], best[-1] if best else -1
    while k >= 0:
        out.append((seeds[k][1], seeds[k][0]))
        k = link[k]
    return out[::-1]


def aligned_edits(a: list[int], b: list[int], most: int) -> int:
    """Word edits between two texts: between chained seeds where that is within `most`, else over the whole."""
    edits, i, j = 0, 0, 0
    for x, y in chain(a, b):
        if x >= i and y >= j:
            edits += distance(a[i:x], b[j:y])
            if edits > most:
                break
            i, j = x + GRAM, y + GRAM
    else:
        edits += distance(a[i:], b[j:])
    return edits if edits <= most or abs(len(a) - len(b)) > most else distance(a, b)


def _there(documents: DataFrame) -> DataFrame:
    return documents.where(F.col("text").isNotNull() & F.col("split").isNotNull() & F.col("doc_id").isNotNull())


def _whole(words: list[str], text: str) -> str:
    """What equal texts have in common; texts of signs alone are the same only if they look the same. Blank texts have only the mark."""
    return " ".join(words) or BLANK + fold_looks(text)


def records(documents: DataFrame) -> DataFrame:
    """doc_id, is_train, class (128 bits of the folded words); no blank texts."""

    def part(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            whole = [_whole(fold_words(t), t) for t in pdf["text"]]
            keep = [w != BLANK for w in whole]
            yield pdf.loc[keep, ["doc_id", "is_train"]].assign(**{"class": [xxhash.xxh3_128_digest(w) for w in whole if w != BLANK]})

    return _there(documents).select("doc_id", (F.col("split") == "train").alias("is_train"), "text").mapInPandas(part, "doc_id long, is_train boolean, class binary")


class Bits:
    """A set of whole numbers as a Bloom filter: PROBES bits a number in an array of at most MOST_BITS; it may take others for members, never the reverse."""

    def __init__(self, numbers: DataFrame):
        """numbers: one column of longs."""
        (name,) = numbers.columns
        self.log = min(MOST_BITS, max(BLOCK, int(numbers.count() * 12).bit_length()))
        self.bits = np.zeros(1 << self.log >> 3, np.uint8)

        def part(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in it:
                at = np.unique(np.concatenate(self._places(pdf[name].to_numpy(np.int64))))
                yield pd.DataFrame({"block": (at >> BLOCK).astype(np.int32), "at": (at & (1 << BLOCK) - 1).astype(np.int32)})

        def packed(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in it:
                rows = []
                for at in pdf["at"]:
                    flags = np.zeros(1 << BLOCK, bool)
                    flags[at] = True
                    rows.append(np.packbits(flags).tobytes())
                yield pd.DataFrame({"block": pdf["block"], "bits": rows})

        places = numbers.mapInPandas(part, "block int, at int")
        width = 1 << BLOCK >> 3
        for r in places.groupBy("block").agg(F.collect_set("at").alias("at")).mapInPandas(packed, "block int, bits binary").toLocalIterator():
            self.bits[r["block"] * width : (r["block"] + 1) * width] = np.frombuffer(r["bits"], np.uint8)

    def _places(self, x: np.ndarray) -> list[np.ndarray]:
        h = _mix(x.astype(np.uint64) * _P)
        return [((h * _M ** np.uint64(k + 1)) >> np.uint64(64 - self.log)).astype(np.int64) for k in range(PROBES)]

    def has(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for at in self._places(x):
            out &= (self.bits[at >> 3] >> (7 - (at & 7)) & 1) > 0
        return out


def words_of(documents: DataFrame, ids: Bits) -> DataFrame:
    """rep, words (as 32-bit hashes) of the documents that `ids` has; read and folded anew, so that no text is ever stored."""
    sent = documents.sparkSession.sparkContext.broadcast(ids)

    def part(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = WordHash()
        for pdf in it:
            pdf = pdf[sent.value.has(pdf["doc_id"].to_numpy(np.int64))]
            words = [np.fromiter((code[w] for w in ws), np.uint32, len(ws)) for ws in map(fold_words, pdf["text"])]
            yield pd.DataFrame({"rep": pdf["doc_id"], "words": [w.tobytes() for w in words]})

    return _there(documents).select("doc_id", "text").mapInPandas(part, "rep long, words binary")


def _texts(pdf: pd.DataFrame) -> Texts:
    return Texts([np.frombuffer(w, np.uint32) for w in pdf["words"]])


SIGNED = [f"sig{i}" for i in range(SIGNATURE)]
PRINTS = "key long, fp long, rep long, n int, place int, " + ", ".join(f"{c} long" for c in SIGNED)


def _prints(texts: Texts, rep: np.ndarray, key: np.ndarray, fp: np.ndarray, text: np.ndarray, place: np.ndarray) -> pd.DataFrame:
    sig = np.zeros((len(texts.n), SIGNATURE), np.int64)
    for i in np.unique(text):
        sig[i] = signature(texts.words[texts.ends[i] - texts.n[i] : texts.ends[i]])
    what = {"key": key.astype(np.int64), "fp": fp.astype(np.int64), "rep": rep[text], "n": texts.n[text].astype(np.int32), "place": place.astype(np.int32)}
    return pd.DataFrame(what | {c: sig[text, i] for i, c in enumerate(SIGNED)})


def _laid_down(words: DataFrame, hot: np.ndarray, counts: np.ndarray, every: int) -> DataFrame:
    """The pieces by which each text is found. One that many texts have has several salts, and is there once for each."""
    sent = words.sparkSession.sparkContext.broadcast((hot, counts))

    def part(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            texts = _texts(pdf)
            text, place, fp, count = laid_down(texts, *sent.value)
            salts = 1 + count * every // SPLIT
            salt = np.arange(salts.sum()) - np.repeat(np.cumsum(salts) - salts, salts)
            text, place, fp = (np.repeat(x, salts) for x in (text, place, fp))
            k = bucket(texts.n[text])
            yield _prints(texts, pdf["rep"].to_numpy(np.int64), cell(fp, k, place // (reach(k) + 1), salt), fp, text, place)

    return words.mapInPandas(part, PRINTS)


def _looked_for(words: DataFrame, laid: Bits, hot: np.ndarray, counts: np.ndarray, every: int) -> DataFrame:
    """The runs of each text that `laid` has, under every key that it has, with one of their salts."""
    sent = words.sparkSession.sparkContext.broadcast((laid, hot, counts))

    def part(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits, *known = sent.value
        for pdf in it:
            texts, rep = _texts(pdf), pdf["rep"].to_numpy(np.int64)
            text, place, fp = looked_for(texts)
            hit = bits.has(fp)
            text, place, fp = text[hit], place[hit], fp[hit]
            salt = (_mix(rep.astype(np.uint64)) >> np.uint64(1)).astype(np.int64)[text] % (1 + often(fp, *known) * every // SPLIT)
            key, run = cells(fp, texts.n[text], place, salt)
            hit = bits.has(key)
            key, run = key[hit], run[hit]
            yield _prints(texts, rep, key, fp[run], text[run], place[run])

    return words.mapInPandas(part, PRINTS)


def _frequent(words: DataFrame, every: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Runs of words that at least HOT_COUNT of one in `every` texts have, sorted, their counts, and the step; at most HOT_MOST. Only speed hangs on them."""

    def part(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            texts = _texts(pdf[_mix(pdf["rep"].to_numpy(np.int64).astype(np.uint64)) % np.uint64(every) == 0])
            text, _, fp = looked_for(texts)
            new = np.unique(np.rec.fromarrays((text, fp)))
            yield pd.DataFrame({"fp": new["f1"].astype(np.int64)})

    rows = words.mapInPandas(part, "fp long").groupBy("fp").count().where(F.col("count") >= HOT_COUNT).orderBy(F.desc("count"), "fp").limit(HOT_MOST).toPandas()
    rows = rows.sort_values("fp")
    return rows["fp"].to_numpy(np.uint64), rows["count"].to_numpy(np.int64), every


LINKS = "rep_a long, rep_b long, edits int, coverage_a double, coverage_b double"


def _runs(x: list[int]) -> set[tuple[int, ...]]:
    return {tuple(x[i : i + GRAM]) for i in range(len(x) - GRAM + 1)}


def _verify(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in it:
        rows = []
        for a, b, x, y in zip(pdf["rep_a"], pdf["rep_b"], pdf["words_a"], pdf["words_b"]):
            p, q = np.frombuffer(x, np.uint32).tolist(), np.frombuffer(y, np.uint32).tolist()
            most = allowed(max(len(p), len(q)))
            # Each edit mends one word that the other text lacks.
            lacking = (Counter(p) - Counter(q)).total()
            if max(lacking, lacking + len(q) - len(p)) > most:
                continue
            if min(len(p), len(q)) < SHORT and not _runs(p) & _runs(q):
                continue
            if (edits := aligned_edits(p, q, most)) <= most:
                common = common_length(p, q)
                rows.append((a, b, edits, common / len(p), common / len(q)))
        yield pd.DataFrame(rows, columns=["rep_a", "rep_b", "edits", "coverage_a", "coverage_b"])


class Overlap:
    """Classes of equal word sequences, their members, and the near-same pairs of classes across splits.

    members: doc_id, is_train, rep (the smallest doc_id of its class). links: rep_a (with members in train), rep_b (with
    members elsewhere), edits, and the share of each record's words that the other has in order; a class with members on both
    sides is linked with itself at 0 edits. Null or blank texts, and records with a null split or doc_id, are in no class.
    Repeated rows are members once each.
    """

    def __init__(self, documents: DataFrame, sample: int = SAMPLE):
        rows = cut_lineage(records(documents))
        grouped = rows.groupBy("class").agg(F.min("doc_id").alias("rep"), F.max("is_train").alias("train"), F.max(~F.col("is_train")).alias("other"))
        self.classes = cut_lineage(grouped.select("class", "rep", "train", "other"))
        self.members = rows.join(self.classes.select("class", "rep"), "class").select("doc_id", "is_train", "rep")
        self.links = cut_lineage(self._found(documents, sample))

    def _found(self, documents: DataFrame, sample: int) -> DataFrame:
        reps = {x: self.classes.where(x).select("rep") for x in ("train", "other")}
        train, other = (words_of(documents, Bits(reps[x])) for x in ("train", "other"))
        hot = _frequent(train, max(1, reps["train"].count() // sample))
        laid = cut_lineage(_laid_down(other, *hot))
        run = _looked_for(train, Bits(laid.select(F.explode(F.array("key", "fp")).alias("key"))), *hot)
        side = lambda x: ["key", *(F.col(c).alias(f"{c}_{x}") for c in ("rep", "n", "place", *SIGNED))]
        most = F.ceil(F.greatest("n_a", "n_b") / F.lit(SEVEN))
        flipped = reduce(add, (F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in SIGNED))
        # What comes out of the join is settled there: only pairs that may be near the same are shuffled.
        near = (F.col("rep_a") != F.col("rep_b")) & (F.abs(F.col("n_a") - F.col("n_b")) <= most) & (F.abs(F.col("place_a") - F.col("place_b")) <= most) & (flipped <= most * 2)
        seeds = run.select(side("a")).join(laid.select(side("b")), "key").where(near)
        alike = seeds.select("rep_a", "rep_b").distinct()
        # Bits may take a document for the first of its class that is not.
        for x, c in (("a", "train"), ("b", "other")):
            alike = alike.join(reps[c].withColumnRenamed("rep", f"rep_{x}"), f"rep_{x}", "left_semi")
        alike = cut_lineage(alike)
        words = words_of(documents, Bits(alike.select(F.explode(F.array("rep_a", "rep_b")).alias("rep")))).groupBy("rep").agg(F.max("words").alias("words"))
        both = (
            alike.join(words.select(F.col("rep").alias("rep_a"), F.col("words").alias("words_a")), "rep_a")
            .join(words.select(F.col("rep").alias("rep_b"), F.col("words").alias("words_b")), "rep_b")
        )
        same = self.classes.where("train and other").select(F.col("rep").alias("rep_a"), F.col("rep").alias("rep_b"), F.lit(0).alias("edits"), F.lit(1.0).alias("coverage_a"), F.lit(1.0).alias("coverage_b"))
        return both.mapInPandas(_verify, LINKS).unionByName(same)

    def pairs(self) -> DataFrame:
        """doc_id_a < doc_id_b of every linked train document and document of another split."""
        members = cut_lineage(self.members)
        links = with_members(self.links.select("rep_a", "rep_b"), "rep_a", members.where("is_train"), "rep", "doc_id", "x")
        out = with_members(links, "rep_b", members.where(~F.col("is_train")), "rep", "doc_id", "y").where("x <> y")
        return out.select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b")).distinct()

    def touched(self) -> DataFrame:
        """doc_id, is_train, rep, best coverage of the document and links (linked classes) of each document with a counterpart; never expands pairs."""
        a = self.links.groupBy(F.col("rep_a").alias("rep")).agg(F.max("coverage_a").alias("coverage"), F.count("*").alias("links"))
        b = self.links.groupBy(F.col("rep_b").alias("rep")).agg(F.max("coverage_b").alias("coverage"), F.count("*").alias("links"))
        train = self.members.where("is_train").join(a, "rep")
        other = self.members.where(~F.col("is_train")).join(b, "rep")
        return train.unionByName(other).select("doc_id", "is_train", "rep", "coverage", "links")


def overlap_report(documents: DataFrame) -> DataFrame:
    """Per split and source: documents, those with a same or near-same record across the train border, their share, mean coverage."""
    hit = Overlap(documents).touched().groupBy("doc_id").agg(F.max("coverage").alias("coverage"))
    return (
        documents.where(F.col("split").isNotNull()).select("doc_id", "split", "source").join(hit, "doc_id", "left")
        .groupBy("split", "source")
        .agg(F.count("*").alias("documents"), F.count("coverage").alias("overlapping"), F.round(F.count("coverage") / F.count("*"), 6).alias("share"), F.round(F.avg("coverage"), 6).alias("mean_coverage"))
    )


def shard_overlap(documents: DataFrame, shard_index: DataFrame) -> DataFrame:
    """shard_id, split, lane, claimed (the flag as delivered), eval_overlap (as found), overlapping_documents."""
    hit = Overlap(documents).touched().select("doc_id").distinct()
    held = shard_index.select("shard_id", F.explode(F.array_distinct("document_ids")).alias("doc_id")).join(hit, "doc_id").groupBy("shard_id").agg(F.count("*").alias("found"))
    return shard_index.select("shard_id", "split", "lane", F.col("eval_overlap").alias("claimed")).join(held, "shard_id", "left").select(
        "shard_id", "split", "lane", "claimed", F.col("found").isNotNull().alias("eval_overlap"), F.coalesce("found", F.lit(0)).alias("overlapping_documents")
    )
