"""Problem 9: abusive, hateful or sexual statements, by class-conditional Kneser-Ney models.

Two Kneser-Ney trigram models over words, one of toxic and one of ordinary statements, share a vocabulary and their
lowest-order backoff counts (continuation counts of both classes), so a rare expression costs both alike unless a class has
seen it. A statement's stretch of words is compared by the difference of its two log-likelihoods, less PRIOR bits (few
statements are toxic, and a stretch may begin anywhere), normalised by its length; a document scores as its best stretch.

Words are read through their disguises: case, look-alike and zero-width characters, digits for letters, letters set apart,
drawn out letters, letters replaced by an asterisk.

Labels are of documents, are partly wrong, and only a statement or two of a positive document is toxic. So word triples that
are far more frequent in positive documents than in all others tell which statements, of all documents, make up the toxic
class at first; the first models then claim further ones, and are counted again.

What is learnt from is a bounded sample of different labelled texts (MOST_LABELLED): the vocabulary, and which word triples, pairs
and words the models know. How often those stand in either class is counted over all documents: texts are encoded once and
kept; triples are counted per task, summed by a shuffle, and of the sums only what the sample knows is gathered. The mass of
what it does not know is kept as a sum by context, so that probabilities are those of the whole corpus.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .textfold import LOOKALIKE, same_look

MOST_LABELLED = 6_000
DISCOUNT = 0.75
#: Bits against a toxic stretch before its words are seen, and bits a word above them from which a document is marked.
PRIOR, THRESHOLD = 20.0, 2.5
#: Training: how much more frequent a telling triple is in positive documents; bits, and bits a word, of a statement that is claimed.
RATIO, SURE_BITS, SURE_RATE, SMOOTH = 5.0, 25.0, 2.0, 2.0
#: What makes a statement odd: share of documents with its triples at most, and against those of the document's statements.
RARE, ODD = 0.002, 0.2
#: Labelled texts that a word of the vocabulary stands in at least.
LEAST = 2
UNKNOWN, NUMBER, HIDDEN = "<unk>", "#", "<hidden>"
#: Letters of the longest token, drawn out letters apart, that is read as a word; encoded data is not.
LONGEST = 28


class _Fold(dict):
    """Characters to lower case without look-alikes; sentence ends to line ends, other signs but '*' to spaces."""

    def __missing__(self, code: int) -> str | None:
        ch = chr(code)
        value = "\n" if ch in "\n\r\u2028\u2029.!?।॥;:\"()[]{}=" else same_look(ch)
        if value is not None and value != "\n":
            value = "".join(LOOKALIKE.get(c, c) for c in value).lower()
            value = "".join("\n" if c in ".!?।॥;:\"()[]{}=" else c if c.isalnum() or c in "*@$" or not c.isascii() else " " for c in value)
        self[code] = value
        return value


_FOLD = _Fold()
_LEET = str.maketrans("013457@$", "oieastas")
_MIXED = re.compile(r"[0-9@$]+[a-z]|[a-z][0-9@$]+[a-z]")
_DRAWN = re.compile(r"([^\W\d_])\1{2,}")
_APART = re.compile(r"(?<![^\s])(?:[^\s\d*] +){3,}[^\s\d*](?![^\s])")
_DOTTED = re.compile(r"(?<!\w)(?:[^\W\d_]\.){3,}[^\W\d_](?!\w)")


def word(raw: str) -> tuple[str, bool]:
    """A word without its disguise, and whether it had one."""
    if raw.isdigit():
        return NUMBER, False
    if len(raw) > LONGEST and len(_DRAWN.sub(r"\1", raw)) > LONGEST:
        return UNKNOWN, False
    if "*" in raw:
        core = raw.strip("*")
        return (raw, True) if "*" in core and len(core) > 2 else (core or NUMBER, False)
    if raw.isalpha():
        plain = _DRAWN.sub(r"\1", raw)
        return plain, plain != raw
    if _MIXED.search(raw) and sum(c.isalpha() for c in raw) >= 1:
        return _DRAWN.sub(r"\1", raw.translate(_LEET)), True
    return raw.strip("@$") or NUMBER, False


def _read(raw: str) -> list[str]:
    """The words of a token; one that was disguised stands behind HIDDEN."""
    if raw.endswith("***"):
        return [HIDDEN, raw[:-3]]
    plain, hidden = word(raw)
    return [HIDDEN, plain] if hidden else [plain]


def _lines(text: str) -> list[list[str]]:
    """A text's statements as tokens; letters that were set apart are joined and end in ***."""
    if "." in text:
        text = _DOTTED.sub(lambda m: m.group().replace(".", " "), text)
    text = text.translate(_FOLD)
    text = _APART.sub(lambda m: m.group().replace(" ", "") + "***", text)
    return [row for line in text.split("\n") if (row := line.split())]


def statements(text: str) -> list[list[str]]:
    """A text's statements as words; a word that was disguised stands behind the token HIDDEN."""
    return [[w for raw in row for w in _read(raw)] for row in _lines(text)]


class Encoder:
    """Texts as word numbers: each statement stands behind two zeros; 1 is an unknown word."""

    def __init__(self, vocabulary: list[str]):
        self.words = ["", UNKNOWN, *vocabulary]
        self.ids = {w: i + 2 for i, w in enumerate(vocabulary)}
        self.size = len(self.words)
        self.read: dict[str, tuple[int, ...]] = {}

    def __getstate__(self) -> dict:
        return {**self.__dict__, "read": {}}

    def numbers(self, raw: str) -> tuple[int, ...]:
        """A token's word numbers, kept for reuse."""
        if len(self.read) > 400_000:
            self.read.clear()
        self.read[raw] = ids = tuple(self.ids.get(w, 1) for w in _read(raw))
        return ids

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        known = self.read.get
        for tokens in _lines(text):
            out += (0, 0)
            for raw in tokens:
                out += known(raw) or self.numbers(raw)
        return out

    def statement(self, words: np.ndarray) -> str:
        return " ".join(self.words[w] for w in words)


class Flat:
    """The statements of many texts as one array, with their triples as numbers in base `size`."""

    def __init__(self, docs: list[np.ndarray], size: int):
        self.words = np.concatenate([np.zeros(0, np.int64), *docs]).astype(np.int64)
        self.owner = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        self.at = np.flatnonzero(self.words)
        w = self.words
        self.keys = (w[self.at - 2] * size + w[self.at - 1]) * size + w[self.at]
        # A word behind two zeros begins a statement.
        begins = (w[self.at - 1] == 0) & (w[self.at - 2] == 0)
        self.statement = np.cumsum(begins) - 1
        self.first = np.flatnonzero(begins)
        self.length = np.diff(np.concatenate((self.first, [len(self.at)])))

    def row(self, k: int, a: int = 0, b: int | None = None) -> np.ndarray:
        """The words a to b of statement k."""
        first, n = self.first[k], self.length[k]
        return self.words[self.at[first + a : first + (n if b is None else min(b, n))]]


def triples(row: np.ndarray, size: int) -> np.ndarray:
    """The triples of one statement as numbers."""
    w = np.concatenate(([0, 0], row)).astype(np.int64)
    return (w[:-2] * size + w[1:-1]) * size + w[2:]


def _find(keys: np.ndarray, values: np.ndarray, at: np.ndarray, default: float) -> np.ndarray:
    """The values of keys (sorted) that stand in `at`; elsewhere the default."""
    if not len(keys):
        return np.full(len(at), default)
    where = np.minimum(np.searchsorted(keys, at), len(keys) - 1)
    return np.where(keys[where] == at, values[where], default)


class KneserNey:
    """Interpolated Kneser-Ney of orders 3 to 1 above a lowest order that is given, as tables of what is known.

    tri, bi: (keys, counts) of known triples (occurrences) and pairs (continuations); pairs: (keys, occurrences) of known
    contexts of two words; words, uni: continuation counts by word, as a context and as the word itself. Contexts' sums are
    of everything, known or not: what known followers leave of a context is backed off to the shorter one.
    """

    def __init__(self, size: int, tri: tuple[np.ndarray, np.ndarray], pairs: tuple[np.ndarray, np.ndarray], bi: tuple[np.ndarray, np.ndarray], words: np.ndarray, uni: np.ndarray):
        self.size, self.uni = size, uni

        def discounted(keys: np.ndarray, counts: np.ndarray, context: np.ndarray, contexts: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Followers' own probabilities, and what their contexts leave."""
            known = np.maximum(counts - DISCOUNT, 0.0)
            place = np.searchsorted(contexts, context)
            taken = np.bincount(place, known, minlength=len(contexts))
            return known / sums[place], 1.0 - taken / sums

        order = np.argsort(pairs[0])
        self.pair_keys, sums = pairs[0][order], pairs[1][order].astype(np.float64)
        order = np.argsort(tri[0])
        self.tri_keys = tri[0][order]
        self.tri, self.pair_rest = discounted(self.tri_keys, tri[1][order], self.tri_keys // size, self.pair_keys, sums)
        order = np.argsort(bi[0])
        self.bi_keys = bi[0][order]
        contexts = np.flatnonzero(words)
        self.bi, rest = discounted(self.bi_keys, bi[1][order], self.bi_keys // size, contexts, words[contexts].astype(np.float64))
        self.word_rest = np.ones(size)
        self.word_rest[contexts] = rest

    def ground(self, shared: np.ndarray) -> None:
        """Set the order 1 above the shared lowest order."""
        total = self.uni.sum()
        self.low = shared if not total else (np.maximum(self.uni - DISCOUNT, 0.0) + DISCOUNT * np.count_nonzero(self.uni) * shared) / total

    def p(self, keys: np.ndarray) -> np.ndarray:
        """P(w | u v) of triples."""
        size = self.size
        v, w = keys // size % size, keys % size
        two = _find(self.bi_keys, self.bi, v * size + w, 0.0) + self.word_rest[v] * self.low[w]
        return _find(self.tri_keys, self.tri, keys, 0.0) + _find(self.pair_keys, self.pair_rest, keys // size, 1.0) * two


def counted(keys: np.ndarray, counts: np.ndarray, size: int) -> KneserNey:
    """A model from the counts of all its triples (distinct keys)."""
    group = lambda k, n=None: (u := np.unique(k, return_inverse=True), (u[0], np.bincount(u[1], n, minlength=len(u[0]))))[1]
    bi = group(keys % (size * size))
    dense = lambda k, n=None: np.bincount(k, n, minlength=size)
    return KneserNey(size, (keys, counts), group(keys // size, counts), bi, dense(bi[0] // size, bi[1]), dense(bi[0] % size))


class Toxicity:
    """The two models with their vocabulary."""

    def __init__(self, encoder: Encoder, toxic: KneserNey, ordinary: KneserNey):
        self.encoder, self.size, self.toxic, self.ordinary = encoder, encoder.size, toxic, ordinary
        both = 1.0 + toxic.uni + ordinary.uni
        for model in (toxic, ordinary):
            model.ground(both / both.sum())

    def bits(self, keys: np.ndarray) -> np.ndarray:
        """By how many bits each triple's last word speaks for the toxic class."""
        each, back = np.unique(keys, return_inverse=True)
        return np.log2(self.toxic.p(each) / self.ordinary.p(each))[back]

    def stretches(self, flat: Flat) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The stretch of most bits of each statement: bits, first word, end; no bits where every word speaks against it."""
        x = self.bits(flat.keys)
        n = len(flat.first)
        if not n:
            return np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)
        total = np.cumsum(x)
        before = total - x
        # Sums begin anew with each statement; a step down between statements keeps their least ones apart.
        step = float(np.abs(x).sum() + 1.0)
        base = before[flat.first][flat.statement]
        least = np.minimum.accumulate(before - base - step * flat.statement) + step * flat.statement
        gain = total - base - least
        best = np.maximum.reduceat(gain, flat.first)
        end = np.full(n, -1, np.int64)
        hit = np.flatnonzero(gain >= best[flat.statement] - 1e-9)
        end[flat.statement[hit][::-1]] = hit[::-1]
        # The stretch starts behind the least sum before its end.
        start = flat.first.copy()
        low = np.flatnonzero(before - base <= least[end][flat.statement] + 1e-6)
        low = low[low <= end[flat.statement[low]]]
        start[flat.statement[low]] = low
        return np.maximum(best, 0.0), start - flat.first, end + 1 - flat.first

    def score(self, docs: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Per text its score, at least 0, and the words of its best statement."""
        flat = Flat(docs, self.size)
        bits, a, b = self.stretches(flat)
        rate = np.maximum(0.0, (bits - PRIOR) / np.maximum(1, b - a))
        owner = flat.owner[flat.at[flat.first]] if len(flat.first) else np.zeros(0, np.int64)
        order = np.lexsort((-np.arange(len(rate)), rate, owner))
        score, best = np.zeros(len(docs)), np.full(len(docs), -1)
        score[owner[order]], best[owner[order]] = rate[order], order
        return score, [flat.row(k) if k >= 0 else np.zeros(0, np.int64) for k in best]


def telling(pos: list[list[np.ndarray]], df: dict[int, int], documents: int) -> set[int]:
    """Word triples that stand in RATIO times as large a share of the positive documents as of all others, one document of the former left out."""
    inside: Counter = Counter()
    for doc in pos:
        inside.update(set().union(*(t.tolist() for t in doc)))
    share = (documents - len(pos) + 1) / max(1, len(pos))
    return {t for t, a in inside.items() if a >= 2 and (a - 0.9) * share >= RATIO * (df[t] - a + 1)}


def odd_ones(pos: list[list[np.ndarray]], neg: list[list[np.ndarray]], df: dict[int, int], documents: int, hot: set[int], size: int) -> set[int]:
    """Rare word triples of the oddest statement of each positive document that has no telling one.

    Such a document should have a toxic statement, most likely of a kind that no other labelled document has. The oddest
    is the one whose triples are rarest, if they are rare at all and far rarer than those of the document's other
    statements; so a document that is labelled wrongly mostly gives none. Triples of a document labelled ordinary are left out.
    """
    limit = max(2.0, RARE * documents)
    cleared = {t for doc in neg for s in doc for t in s.tolist()}
    out: set[int] = set()
    for doc in pos:
        if len(doc) < 2 or any(told(np.array([t in hot for t in s.tolist()])) for s in doc):
            continue
        typical = [float(np.median([df[t] for t in s.tolist()])) for s in doc]
        k = int(np.argmin([m if len(s) >= 4 else np.inf for m, s in zip(typical, doc)]))
        if typical[k] <= limit and typical[k] <= ODD * float(np.median(typical)):
            out |= {t for t in doc[k].tolist() if df[t] <= limit and t % size > 1 and t not in cleared}
    return out


def told(hot: np.ndarray) -> tuple[int, int] | None:
    """From where to where telling triples (flags by word) make up a statement, if at least three do and nearly half of what lies between."""
    at = np.flatnonzero(hot)
    if len(at) < 3 or len(at) < 0.45 * (at[-1] - at[0] + 1):
        return None
    return int(at[0]), int(at[-1]) + 1


def trimmed(flat: Flat, k: int, a: int, b: int) -> np.ndarray:
    """What is learnt of a statement: all of it, or the stretch with its neighbours if other sentences run into it."""
    return flat.row(k) if flat.length[k] <= 20 else flat.row(k, max(0, a - 3), b + 3)


def divided(flat: Flat, hot: np.ndarray, model: Toxicity | None) -> list[tuple[int, int, int]]:
    """The toxic statements: number, from, to. hot: telling triples, sorted. A model claims more."""
    flags = _find(hot, np.ones(len(hot)), flat.keys, 0.0) > 0
    some = np.flatnonzero(np.bincount(flat.statement[flags], minlength=len(flat.first)) >= 3)
    out = {int(k): at for k in some if (at := told(flags[flat.first[k] : flat.first[k] + flat.length[k]]))}
    if model is not None:
        bits, a, b = model.stretches(flat)
        for k in np.flatnonzero((bits >= SURE_BITS) & (bits >= SURE_RATE * (b - a + SMOOTH))):
            out.setdefault(int(k), (int(a[k]), int(b[k])))
    return [(k, *at) for k, at in out.items()]


def _encoded(documents: DataFrame, encoder: Encoder) -> DataFrame:
    sent = documents.sparkSession.sparkContext.broadcast(encoder)

    def part(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "words": [np.array(sent.value.encode(t), np.int32).tobytes() for t in pdf["text"].tolist()]})

    return documents.where(F.col("text").isNotNull()).select("doc_id", "source", "text").mapInPandas(part, "doc_id long, source string, words binary")


def _flat(pdf: pd.DataFrame, size: int) -> Flat:
    return Flat([np.frombuffer(w, np.int32) for w in pdf["words"]], size)


def _frequencies(encoded: DataFrame, wanted: np.ndarray, size: int) -> dict[int, int]:
    """In how many documents each wanted triple (sorted) stands."""
    sent = encoded.sparkSession.sparkContext.broadcast(wanted)

    def part(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(sent.value), np.int64)
        for pdf in it:
            flat = _flat(pdf, size)
            if len(total) and len(flat.keys):
                where = np.minimum(np.searchsorted(sent.value, flat.keys), len(total) - 1)
                ok = sent.value[where] == flat.keys
                pairs = np.unique(flat.owner[flat.at[ok]] * len(total) + where[ok])
                total += np.bincount(pairs % len(total), minlength=len(total))
        some = np.flatnonzero(total)
        yield pd.DataFrame({"key": sent.value[some], "n": total[some]})

    rows = encoded.select("words").mapInPandas(part, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect()
    return Counter({r["key"]: r["n"] for r in rows})


def _class_counts(encoded: DataFrame, hot: np.ndarray, model: Toxicity | None, size: int) -> DataFrame:
    """toxic, key, n: triples of the statements of either class. With a model: only the changes that its claims make."""
    sent = encoded.sparkSession.sparkContext.broadcast((hot, model))

    def part(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            flat = _flat(pdf, size)
            toxic = divided(flat, *sent.value)
            if model is not None:
                before = {k for k, _, _ in divided(flat, sent.value[0], None)}
                toxic = [x for x in toxic if x[0] not in before]
            mine = np.isin(flat.statement, [k for k, _, _ in toxic])
            learnt = np.concatenate([np.zeros(0, np.int64), *(triples(trimmed(flat, *x), size) for x in toxic)])
            a, n = np.unique(learnt, return_counts=True)
            b, m = np.unique(flat.keys[mine if model is not None else ~mine], return_counts=True)
            yield pd.DataFrame({"toxic": np.repeat([True, False], [len(a), len(b)]), "key": np.concatenate((a, b)), "n": np.concatenate((n, -m if model is not None else m))})

    return encoded.select("words").mapInPandas(part, "toxic boolean, key long, n long").groupBy("toxic", "key").agg(F.sum("n").alias("n"))


def _models(counts: DataFrame, known: np.ndarray, encoder: Encoder) -> Toxicity:
    """The models of the class counts, as far as the sample's triples (sorted) go. What is gathered is bounded by these and the vocabulary."""
    spark, size = counts.sparkSession, encoder.size
    among = lambda df, keys: df.join(spark.createDataFrame(pd.DataFrame({"key": keys}), "key long"), "key", "left_semi").toPandas()
    arrays = lambda pdf: (pdf["key"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64))
    toxic = counted(*arrays(among(counts.where("toxic"), known)), size)
    plain = counts.where(~F.col("toxic"))
    tri = arrays(among(plain.select("key", "n"), known))
    pairs = arrays(among(plain.groupBy(F.floor(F.col("key") / F.lit(size)).alias("key")).agg(F.sum("n").alias("n")), np.unique(known // size)))
    continued = plain.groupBy((F.col("key") % F.lit(size * size)).alias("key")).agg(F.count("*").alias("n"))
    bi = arrays(among(continued, np.unique(known % (size * size))))

    def dense(df: DataFrame) -> np.ndarray:
        out = np.zeros(size, np.int64)
        key, n = arrays(df.toPandas())
        out[key] = n
        return out

    words = dense(continued.groupBy(F.floor(F.col("key") / F.lit(size)).alias("key")).agg(F.sum("n").alias("n")))
    uni = dense(continued.groupBy((F.col("key") % F.lit(size)).alias("key")).agg(F.count("*").alias("n")))
    return Toxicity(encoder, toxic, KneserNey(size, tri, pairs, bi, words, uni))


def labelled_texts(documents: DataFrame, review_labels: DataFrame, most: int = MOST_LABELLED) -> tuple[list[str], list[str]]:
    """At most about `most` labelled texts, picked by hash: labelled toxic (mean of all reviewers of a text above one half), and not. Null labels say nothing.

    Equal texts are one witness, with the opinions of all: copies neither crowd others out nor confirm each other.
    """
    votes = review_labels.where(F.col("abusive").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.sum(F.col("abusive").cast("long")).alias("yes"), F.count("*").alias("votes"))
    texts = documents.where(F.col("text").isNotNull()).select("doc_id", "text", F.unhex(F.sha2("text", 256)).alias("same"))
    pooled = cut_lineage(texts.select("doc_id", "same").join(votes, "doc_id").groupBy("same").agg((F.sum("yes") / F.sum("votes")).alias("vote"), F.min("doc_id").alias("doc_id")))
    unit = F.pmod(F.xxhash64("same", F.lit("toxicity")), F.lit(1_000_000)) / 1_000_000.0
    picked = pooled.where(unit < min(1.0, most / max(1, pooled.count())))
    # About `most` at the most: few enough to go to the documents, wherever these lie.
    rows = texts.join(F.broadcast(picked), ["doc_id", "same"]).select("doc_id", "vote", "text").collect()
    rows = sorted({(r["doc_id"], r["vote"], r["text"]) for r in rows})
    return [t for _, v, t in rows if v > 0.5], [t for _, v, t in rows if v <= 0.5]


def train(documents: DataFrame, review_labels: DataFrame, most: int = MOST_LABELLED) -> tuple[Toxicity, DataFrame]:
    """The models, and the documents as the models read them: doc_id, source, words. Counts are over all documents with text."""
    positive, negative = labelled_texts(documents, review_labels, most)
    seen: Counter = Counter()
    for text in (*positive, *negative):
        seen.update({w for s in statements(text) for w in s})
    encoder = Encoder(sorted(w for w, n in seen.items() if n >= LEAST))
    size = encoder.size
    encoded = cut_lineage(_encoded(documents, encoder))

    def rows(texts: list[str]) -> list[list[np.ndarray]]:
        flats = (Flat([np.array(encoder.encode(t), np.int64)], size) for t in texts)
        return [[f.keys[a : a + n] for a, n in zip(f.first, f.length)] for f in flats]

    pos, neg = rows(positive), rows(negative)
    gather = lambda docs: np.unique(np.concatenate([np.zeros(0, np.int64), *(s for doc in docs for s in doc)]))
    known, total = gather([*pos, *neg]), encoded.count()
    df = _frequencies(encoded, gather(pos), size)
    hot = telling(pos, df, total)
    hot |= odd_ones(pos, neg, df, total, hot, size)
    hot = np.array(sorted(hot), np.int64)
    counts = cut_lineage(_class_counts(encoded, hot, None, size))
    model = _models(counts, known, encoder)
    if len(hot):
        changed = counts.unionByName(_class_counts(encoded, hot, model, size)).groupBy("toxic", "key").agg(F.sum("n").alias("n")).where("n > 0")
        model = _models(cut_lineage(changed), known, encoder)
    return model, encoded


SCORES = "doc_id long, source string, score double, flagged boolean, statement string"


def scored(encoded: DataFrame, model: Toxicity, threshold: float = THRESHOLD) -> DataFrame:
    """Scores of encoded documents, one narrow pass."""
    sent = encoded.sparkSession.sparkContext.broadcast(model)

    def part(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            s, rows = sent.value.score([np.frombuffer(w, np.int32) for w in pdf["words"]])
            said = [sent.value.encoder.statement(r) if x >= threshold else None for x, r in zip(s, rows)]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "score": s.round(6), "flagged": s >= threshold, "statement": said})

    return encoded.mapInPandas(part, SCORES)


def scores(documents: DataFrame, review_labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, source, score, flagged (score >= threshold), statement (the worst, in the words that the models know) of documents with text.

    Null texts have no row; blank texts score 0. Without any toxic label every score is 0. Whole texts are read. Repeated rows
    repeat theirs, and count as often; empty tables give no rows.
    """
    model, encoded = train(documents, review_labels)
    return scored(encoded, model, threshold)


def source_rates(documents: DataFrame, review_labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per source: documents with text, flagged ones, their rate, mean score."""
    return (
        scores(documents, review_labels, threshold=threshold)
        .groupBy("source")
        .agg(F.count("*").alias("documents"), F.count_if("flagged").alias("flagged"), F.round(F.count_if("flagged") / F.count("*"), 6).alias("rate"), F.round(F.avg("score"), 6).alias("mean_score"))
    )
