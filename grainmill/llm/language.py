"""Problem 1: languages of documents and of their stretches of lines, by prediction by partial matching.

Per language a tree of byte contexts of order 0 to ORDER counts which byte follows (method C: a context seen T times with D
different followers gives a follower seen c times c / (T + D), and an escape to the shorter context D / (T + D); order -1
is uniform). The statistics are frozen after training, so the exact code length of a token is the same wherever it stands;
contexts begin anew with each token. The code of a line in a language has one escape more: a token may be borrowed, that is
coded by any tree for BORROW bits on top, so that a single foreign word decides no line. Tokens are runs of letters, runs of signs; digits say nothing about a language and
are left out. Indic letters take one byte each behind a byte for their block. Languages written in two scripts have a tree
for each; a line's code length in a language is that of its better tree.

A document's lines are cut into stretches by dynamic programming: the lines' code lengths plus SWITCH bits per change of
language are least. A stretch most of whose lines even its best language codes in more than STRANGE bits a letter is of none
of these languages (und). Confidence is the probability of the language given code lengths, tempered for their dependence.

Training takes a bounded sample of labelled documents (PER_LABEL for each language). Labels are often wrong and Latin lines
of documents labelled Hindi may be English, so training is repeated: each round every line of the sample goes to the
language that codes it best, unless only its label's language can be meant.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textfold import LOOKALIKE, same_look

ORDER = 5
#: Bits of a change of language between two lines.
SWITCH = 14.0
#: Labelled documents per language that training looks at.
PER_LABEL = 250
#: Share of a record's lines from which it counts as code throughout (three lines at least, or half of them).
CODE_SHARE = 0.25
ROUNDS = 3
#: Bits of a token that is borrowed from another tree.
BORROW = 30.0
#: A line of fewer letters is no stretch of its own, unless it is in a script that its neighbours are not.
SCRAP = 14
#: Bits a letter above which a line speaks for no known language, in stretches of at least SURE letters; lines of a known one need about 1 to 3.5.
STRANGE, SURE, NONE = 5.5, 20, "und"
#: Weight of a bit in the confidence: the one of least log loss on held-out pieces of one to three words.
TEMPER = 0.5
LANGUAGES = ("en", "es", "de", "hi", "mr", "te", "kn", "ta", "python")
INDIC = {"hi": 0x12, "mr": 0x12, "te": 0x18, "kn": 0x19, "ta": 0x17}
#: Trees: a language, or an Indic language in Latin letters.
TREES = (*LANGUAGES, *(f"{x}-latn" for x in INDIC))
_OF = np.array([LANGUAGES.index(t.split("-")[0]) for t in TREES])
# Usual codes and names.
NAMES = {
    "en": ("en", "eng", "english"), "es": ("es", "spa", "esp", "spanish", "español", "espanol", "castellano"), "de": ("de", "deu", "ger", "german", "deutsch"),
    "hi": ("hi", "hin", "hindi", "हिन्दी", "हिंदी"), "mr": ("mr", "mar", "marathi", "मराठी"), "te": ("te", "tel", "telugu", "తెలుగు"), "kn": ("kn", "kan", "kannada", "ಕನ್ನಡ"),
    "ta": ("ta", "tam", "tamil", "தமிழ்"), "python": ("python", "py", "python2", "python3"),
}
_BY_NAME = {n: k for k, names in NAMES.items() for n in names}


def named(label: Column) -> Column:
    """The language that a label names, null if none of LANGUAGES: any usual code or name; region, script and case aside."""
    first = F.regexp_extract(F.lower(F.trim(label)), r"^([^-_\s(.]+)", 1)
    table = F.create_map(*[F.lit(x) for pair in _BY_NAME.items() for x in pair])
    return table[first]


class _Fold(dict):
    def __missing__(self, code: int) -> str | None:
        value = same_look(chr(code))
        self[code] = value = None if value is None else "".join(LOOKALIKE.get(c, c) for c in value).lower()
        return value


_FOLD = _Fold()
_LINES = re.compile(r"[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]+")
#: Letters with their marks (Indic blocks as a whole, where Python's \w leaves out vowel signs), or signs.
_TOKENS = re.compile(r"[a-z]+|[ऀ-෿]+|[^\W\d_]+|[^\w\s]+|_+")


def tokens(line: str) -> list[str]:
    """A line's tokens in the common form."""
    return _TOKENS.findall(line.translate(_FOLD))


def compact(token: str) -> bytes:
    """A token as bytes; letters of one Indic block take one byte each behind the block's."""
    if token.isascii():
        return token.encode()
    if "ऀ" <= token[0] <= "෿":
        return bytes((1 + (ord(token[0]) >> 7 & 0x1F), *(0x80 | (ord(c) & 0x7F) for c in token)))
    return token.encode()


_END = 0


class Trees:
    """The frozen context trees of all languages, with code lengths resolved through their escapes.

    For a context and a follower (bytes together), `length` numbers the row of `costs` with the code length in every tree;
    `escape` that of `escapes` with the cost, per tree, of leaving a context. A token's lengths follow the longest contexts
    known to any tree.
    """

    def __init__(self, counts: dict[str, Counter], order: int = ORDER):
        """counts: tokens by tree. Trees without tokens are left out by an infinite code length."""
        self.order = order
        size = len(TREES)
        follow: list[dict[bytes, Counter]] = []
        for name in TREES:
            tree: dict[bytes, Counter] = defaultdict(Counter)
            for token, n in counts.get(name, {}).items():
                raw = b"\x02" + compact(token) + bytes((_END,))
                for i in range(1, len(raw)):
                    for k in range(min(order, i) + 1):
                        tree[raw[i - k : i]][raw[i]] += n
            follow.append(tree)
        self.none = np.array([0.0 if t else np.inf for t in follow])
        contexts = sorted(set().union(*follow), key=len)
        escape: dict[bytes, np.ndarray] = {}
        length: dict[bytes, np.ndarray] = {}

        def fall(ctx: bytes, sym: bytes) -> np.ndarray:
            cost = np.zeros(size)
            while (v := length.get(ctx + sym)) is None:
                if (e := escape.get(ctx)) is not None:
                    cost = cost + e
                if not ctx:
                    return cost + 8.0
                ctx = ctx[1:]
            return cost + v

        for ctx in contexts:
            here = [t.get(ctx) for t in follow]
            esc, total = np.zeros(size), np.ones(size)
            for j, c in enumerate(here):
                if c:
                    total[j] = sum(c.values()) + len(c)
                    esc[j] = -np.log2(len(c) / total[j])
            for k in set().union(*(c for c in here if c)):
                sym = bytes((k,))
                v = (fall(ctx[1:], sym) if ctx else np.full(size, 8.0)) + esc
                for j, c in enumerate(here):
                    if c and (n := c.get(k)):
                        v[j] = -np.log2(n / total[j])
                length[ctx + sym] = v
            escape[ctx] = esc
        # As two matrices and their row numbers the model travels fast.
        self.escape, self.escapes = dict(zip(escape, range(len(escape)))), np.array([*escape.values(), np.zeros(size)])
        self.length, self.costs = dict(zip(length, range(len(length)))), np.array([*length.values(), np.zeros(size)])
        self._ids: dict[str, int] = {}
        self._rows, self._letters = np.zeros((1024, size), np.float32), np.zeros(1024, np.int64)
        self._steps: dict[bytes, int] = {}
        self._costs = np.zeros((1024, size), np.float64)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_ids", "_rows", "_letters", "_steps", "_costs")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._ids, self._rows, self._letters = {}, np.zeros((1024, len(TREES)), np.float32), np.zeros(1024, np.int64)
        self._steps, self._costs = {}, np.zeros((1024, len(TREES)), np.float64)

    def _fall(self, ctx: bytes, sym: int) -> np.ndarray:
        """Code lengths of a follower after a context, shorter contexts included."""
        cost, byte, length, escape = None, bytes((sym,)), self.length, self.escape
        while (k := length.get(ctx + byte)) is None:
            if (e := escape.get(ctx)) is not None:
                cost = self.escapes[e] if cost is None else cost + self.escapes[e]
            if not ctx:
                return 8.0 + (0.0 if cost is None else cost) + np.zeros(len(TREES))
            ctx = ctx[1:]
        return self.costs[k] if cost is None else cost + self.costs[k]

    def lengths(self, token: str) -> np.ndarray:
        """The token's code length in bits in every tree."""
        raw = b"\x02" + compact(token) + bytes((_END,))
        total = self.none.copy()
        for i in range(1, len(raw)):
            total += self._fall(raw[max(0, i - self.order) : i], raw[i])
        return np.minimum(total, total.min() + BORROW) + self.none

    def numbers(self, flat: list[str]) -> np.ndarray:
        """The rows in which tokens' code lengths and letter counts are kept; tokens not seen before get theirs."""
        ids = self._ids
        if len(ids) > 300_000:
            ids.clear()
        known = list(map(ids.get, flat))
        if None in known:
            new = [t for t in dict.fromkeys(t for t, k in zip(flat, known) if k is None)]
            first = len(ids)
            while first + len(new) > len(self._rows):
                self._rows = np.concatenate((self._rows, np.zeros_like(self._rows)))
                self._letters = np.concatenate((self._letters, np.zeros_like(self._letters)))
            self._rows[first : first + len(new)] = self._many(new)
            self._letters[first : first + len(new)] = [len(t) for t in new]
            ids.update(zip(new, range(first, first + len(new))))
            known = list(map(ids.get, flat))
        return np.array(known, np.int64)

    def _many(self, new: list[str]) -> np.ndarray:
        """Code lengths of many tokens: a byte's cost hangs on it and the ORDER bytes before it, and such windows recur."""
        steps, k = self._steps, self.order
        if len(steps) > 300_000:
            steps.clear()
        windows, lens = [], []
        for t in new:
            raw = b"\x02" + compact(t) + bytes((_END,))
            windows += [raw[max(0, i - k) : i + 1] for i in range(1, len(raw))]
            lens.append(len(raw) - 1)
        for w in windows:
            if w not in steps:
                if len(steps) >= len(self._costs):
                    self._costs = np.concatenate((self._costs, np.zeros_like(self._costs)))
                self._costs[len(steps)] = self._fall(w[:-1], w[-1])
                steps[w] = len(steps)
        at = np.fromiter(map(steps.__getitem__, windows), np.int64, len(windows))
        total = np.add.reduceat(self._costs[at], np.cumsum(lens) - lens, axis=0) + self.none
        return np.minimum(total, total.min(axis=1, keepdims=True) + BORROW) + self.none

    def by_tree(self, rows: list[list[str]]) -> np.ndarray:
        """Code lengths of lines (lists of tokens) by tree; 0 for lines without tokens. Tokens seen before are looked up."""
        flat = self.numbers([t for row in rows for t in row])
        lens = np.array([len(r) for r in rows], np.int64)
        out = np.zeros((len(rows), len(TREES)), np.float64)
        some = lens > 0
        if some.any():
            starts = (np.cumsum(lens) - lens)[some]
            out[some] = np.add.reduceat(self._rows[flat], starts, axis=0, dtype=np.float64)
        return out

    def letters(self, rows: list[list[str]]) -> np.ndarray:
        """Letters of lines."""
        ends = np.cumsum([len(r) for r in rows], dtype=np.int64)
        total = np.concatenate(([0], np.cumsum(self._letters[self.numbers([t for row in rows for t in row])])))
        return np.diff(np.concatenate(([0], total[ends])))

    def lines(self, rows: list[list[str]]) -> np.ndarray:
        """Code lengths of lines by language."""
        out = self.by_tree(rows)
        best = np.full((len(rows), len(LANGUAGES)), np.inf)
        for j in range(len(TREES)):
            best[:, _OF[j]] = np.minimum(best[:, _OF[j]], out[:, j])
        return best


def stretches(cost: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The language of each line such that code lengths plus changes of language cost least."""
    first = cost.argmin(axis=1)
    if len(cost) < 2 or (first == first[0]).all():
        return first
    n, k = cost.shape
    total, back = cost[0].copy(), np.zeros((n, k), np.int64)
    for i in range(1, n):
        low = int(total.argmin())
        stay = total <= total[low] + switch
        back[i] = np.where(stay, np.arange(k), low)
        total = np.where(stay, total, total[low] + switch) + cost[i]
    out = np.zeros(n, np.int64)
    out[-1] = int(total.argmin())
    for i in range(n - 1, 0, -1):
        out[i - 1] = back[i, out[i]]
    return out


def confidence(cost: np.ndarray, chosen: int) -> float:
    """Probability of the chosen language given total code lengths."""
    d = np.minimum(60.0, (cost - cost[chosen]) * TEMPER)
    return float(1.0 / np.exp2(-d).sum())


def _latin(line: list[str]) -> bool:
    return sum(len(t) for t in line if t[0] < "ɐ") > sum(len(t) for t in line if t[0] >= "ऀ")


def _rate(cost: np.ndarray, lines: list[list[str]]) -> np.ndarray:
    """Bits a letter of each line in its best tree."""
    return cost.min(axis=1) / np.array([max(1, sum(len(x) for x in t)) for t in lines])


def _romanised(lines: list[tuple[str, list[str]]], strange: float) -> dict[str, Counter]:
    """Tokens of Indic languages in Latin letters, from lines that no other tree codes well.

    The label with most such lines is right about them; what its tree codes well belongs to it, whatever the label says.
    """
    out: dict[str, Counter] = {}
    while lines:
        label = max(sorted({x for x, _ in lines}), key=[x for x, _ in lines].count)
        name = f"{label}-latn"
        out[name] = Counter(t for x, line in lines if x == label for t in line)
        lines = [x for x in lines if x[0] != label]
        if lines:
            rate = _rate(Trees({name: out[name]}).by_tree([t for _, t in lines]), [t for _, t in lines])
            for x, r in zip(lines, rate):
                if r <= strange:
                    out[name].update(x[1])
            lines = [x for x, r in zip(lines, rate) if r > strange]
    return out


def fit(rows: list[tuple[str, str]], rounds: int = ROUNDS) -> Trees:
    """Trees from (label's language, text) of a sample, labels being mostly right."""
    lines = [(label, t) for label, text in rows for x in _LINES.split(text) if len(t := tokens(x)) >= 3]
    plain = [t for _, t in lines]
    trees = None
    for _ in range(rounds):
        counts: dict[str, Counter] = defaultdict(Counter)
        odd: list[tuple[str, list[str]]] = []
        if trees is None:
            # Latin lines of Indic labels may be anything yet.
            for label, line in lines:
                if label in INDIC and not _latin(line) and _in_block(line, label) or label not in INDIC and (_latin(line) or label == "python"):
                    counts[label].update(line)
        else:
            cost = trees.by_tree(plain)
            rate = _rate(cost, plain)
            # Bits a letter that a language's own lines hardly ever need.
            middle = float(np.median(rate)) if len(rate) else 0.0
            strange = max(1.8 * middle, middle + 0.6)
            for (label, line), c, r in zip(lines, cost, rate):
                if r <= strange:
                    counts[TREES[int(c.argmin())]].update(line)
                elif _latin(line) and label in INDIC:
                    odd.append((label, line))
            for name, more in _romanised(odd, strange).items():
                counts[name] += more
        trees = Trees(counts)
    return trees or Trees({})


def _in_block(line: list[str], label: str) -> bool:
    return any(ord(t[0]) >> 7 == INDIC[label] for t in line if "ऀ" <= t[0] <= "෿")


def train(documents: DataFrame, per_label: int = PER_LABEL, rounds: int = ROUNDS) -> Trees:
    """Trees from at most about per_label documents of each label, picked by a hash of doc_id; that sample is all that is gathered."""
    labelled = documents.where(F.col("text").isNotNull()).select("doc_id", named(F.col("language")).alias("label"), "text").where(F.col("label").isNotNull())
    sizes = {r["label"]: r["n"] for r in documents.where(F.col("text").isNotNull()).groupBy(named(F.col("language")).alias("label")).agg(F.count("*").alias("n")).where(F.col("label").isNotNull()).collect()}
    if not sizes:
        return Trees({})
    share = F.create_map(*[F.lit(x) for label, n in sizes.items() for x in (label, min(1.0, per_label / n))])
    unit = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1_000_000)) / 1_000_000.0
    sample = labelled.where(unit < share[F.col("label")]).collect()
    return fit(sorted((r["label"], r["text"]) for r in sample), rounds)


def _block(line: list[str]) -> int:
    """The Indic block of most of a line's letters; 0 for other letters."""
    count: Counter = Counter()
    for t in line:
        if t[0].isalpha() or "ऀ" <= t[0] <= "෿":
            count[ord(t[0]) >> 7 if "ऀ" <= t[0] <= "෿" else 0] += len(t)
    return max(count, key=lambda k: (count[k], k)) if count else 0


def read(trees: Trees, texts: list[str], records: bool = False) -> Iterator[list[tuple[int, int, str, float, int]]]:
    """Per text its stretches: first line, last line, language, confidence, letters. Blank lines belong to the stretch before.

    records: a record of code is python throughout, whatever its comments, strings and data; and every stretch has a language.
    """
    split = [[tokens(x) for x in _LINES.split(t)] for t in texts]
    every = [row for doc in split for row in doc]
    cost, sizes = trees.lines(every), trees.letters(every).tolist() if every else []
    python = LANGUAGES.index("python")
    at = 0
    for doc in split:
        own, size = cost[at : at + len(doc)], sizes[at : at + len(doc)]
        at += len(doc)
        some = [i for i, row in enumerate(doc) if row]
        c = own[some]
        if not some or not np.isfinite(c.min(axis=1)).all():
            yield []
            continue
        lang = stretches(c)
        code = int((lang == python).sum())
        if records and code >= CODE_SHARE * len(lang) and (code >= 3 or 2 * code >= len(lang)):
            lang[:] = python
        letters = [size[x] for x in some]
        for k in range(len(lang)):
            # A scrap of a line says too little to stand alone between lines of one language, or at an end.
            near = [m for m in (k - 1, k + 1) if 0 <= m < len(lang)]
            around = {int(lang[m]) for m in near}
            if letters[k] < SCRAP and len(around) == 1 and int(lang[k]) not in around:
                block = _block(doc[some[k]])
                if not block or block in {_block(doc[some[m]]) for m in near}:
                    lang[k] = around.pop()
        out, i = [], 0
        while i < len(some):
            j = i
            while j + 1 < len(some) and lang[j + 1] == lang[i]:
                j += 1
            k, n = int(lang[i]), sum(letters[i : j + 1])
            total = c[i : j + 1].sum(axis=0)
            odd = sum(c[m, k] > STRANGE * letters[m] for m in range(i, j + 1))
            name = NONE if not records and n >= SURE and 2 * odd > j - i + 1 else LANGUAGES[k]
            out.append((some[i], some[j], name, round(confidence(total, k), 6), n))
            i = j + 1
        yield out


SEGMENTS = "doc_id long, first_line int, last_line int, language string, confidence double, letters int"


def segments(documents: DataFrame, trees: Trees | None = None, records: bool = False) -> DataFrame:
    """doc_id, first_line, last_line, language, confidence, letters of every stretch of lines in one language.

    Lines are numbered from 0 among the non-empty ones of splitting at line ends. A stretch of no known language is 'und'.
    records: a record of code is one stretch of python.
    Null texts, blank texts and texts without a letter or sign have none; whole texts are read, however long. Repeated rows
    repeat theirs; an empty table, or one without any label to learn from, gives no rows. One narrow pass, no shuffle.
    """
    model = documents.sparkSession.sparkContext.broadcast(trees or train(documents))

    def part(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = [(d, *x) for d, found in zip(pdf["doc_id"].tolist(), read(model.value, pdf["text"].tolist(), records)) for x in found]
            yield pd.DataFrame(rows, columns=["doc_id", "first_line", "last_line", "language", "confidence", "letters"])

    return documents.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text").mapInPandas(part, SEGMENTS)


def document_languages(documents: DataFrame, trees: Trees | None = None) -> DataFrame:
    """doc_id, language (that of most letters), confidence (of its stretches, weighted by letters), share, languages."""
    seg = segments(documents, trees).groupBy("doc_id", "language").agg(F.sum("letters").alias("n"), F.sum(F.col("confidence") * F.col("letters")).alias("c"))
    top = seg.groupBy("doc_id").agg(F.max(F.struct("n", "language", "c")).alias("t"), F.sum("n").alias("all"), F.array_sort(F.collect_set("language")).alias("languages"))
    return top.select("doc_id", F.col("t.language").alias("language"), F.round(F.col("t.c") / F.col("t.n"), 6).alias("confidence"), F.round(F.col("t.n") / F.col("all"), 6).alias("share"), "languages")


def unnamed_languages(documents: DataFrame, trees: Trees | None = None) -> DataFrame:
    """doc_id and each language that a stretch of its lines has and its label does not name; records of code are python.

    The label goes through the map beside the text, so documents are read once and only the result's keys are shuffled.
    """
    model = documents.sparkSession.sparkContext.broadcast(trees or train(documents))

    def part(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = [(d, k) for d, label, found in zip(pdf["doc_id"].tolist(), pdf["label"].tolist(), read(model.value, pdf["text"].tolist(), True)) for k in dict.fromkeys(x[2] for x in found) if k != label]
            yield pd.DataFrame(rows, columns=["doc_id", "language"])

    good = documents.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    return good.select("doc_id", named(F.col("language")).alias("label"), "text").mapInPandas(part, "doc_id long, language string").distinct()
