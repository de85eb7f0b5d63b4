"""Problem 4: one consistent form for texts that look the same.

A text is first folded (compatibility forms, composed accents, ignorable characters, spaces). Each word with a letter that
more than one script has then spans a lattice: one column per character, holding each script's letter of that look.
Viterbi's search finds the reading of highest score under character bigrams of one script each; a word's first letter is
scored over all scripts together, and a change of script costs SWITCH. The lattice depends on the look alone, not on the
characters that happen to be written, so words that look equal get equal forms; and a reading has the look that it was
made from, so words that look different get different forms.

The bigrams are counted over the words of a single script of all documents, Latin ones included: partial counts per task,
summed by a shuffle of at most alphabet^2 rows per task; the result, at most alphabet^2 rows, is broadcast.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .skew import with_members
from .textfold import ARMENIAN, CYRILLIC, GREEK, LATIN, LOOKALIKE, SCRIPTS, fold_looks

#: Stand after a role and between turns; private-use characters.
ROLE, TURN = "", ""
#: Log cost of a change of script within a word.
SWITCH = -12.0
_OF = {"CYRILLIC": CYRILLIC, "GREEK": GREEK, "ARMENIAN": ARMENIAN, "LATIN": LATIN}
#: The letter of each script for a look, which is written as its Latin letter.
MEMBERS: dict[str, dict[str, str]] = defaultdict(dict)
for _s in SCRIPTS[1:]:
    for _c, _l in _OF[_s].items():
        MEMBERS[_l].setdefault("LATIN", _l)
        MEMBERS[_l].setdefault(_s, _c)
_TO_LOOK = str.maketrans(LOOKALIKE)
_ALIKE = re.compile(f"[{''.join(LOOKALIKE)}]")
#: Runs of letters of the scripts concerned: Latin, Greek, Cyrillic, Armenian.
_WORD = re.compile("[A-Za-zÀ-ÖØ-öø-ʯͰ-ͳͶͷͻ-ͿΆΈ-ҁҊ-Ֆՠ-ֈḀ-ᾼῂ-ῼ]+")
_SHARED = re.compile(f"[{''.join(MEMBERS)}]")
#: Distinct words that are kept for reuse.
KEPT = 200_000


def script(ch: str) -> str:
    name = unicodedata.name(ch, "?").split(" ")[0]
    return name if name in SCRIPTS else "?"


def look(text: str) -> str:
    """A text's look: folded, every look-alike letter written as its Latin one."""
    text = fold_looks(text)
    return text if text.isascii() or not _ALIKE.search(text) else unicodedata.normalize("NFC", text.translate(_TO_LOOK))


def word_bigrams(words: Counter) -> Counter:
    """(script, letter before or '', letter or '' for the end) counts of counted words of a single script with look-alikes."""
    out: Counter = Counter()
    for word, n in words.items():
        scripts = {"LATIN"} if word.isascii() else {script(c) for c in word}
        if len(scripts) == 1 and (s := scripts.pop()) != "?":
            for a, b in zip(("", *word), (*word, "")):
                out[s, a, b] += n
    return out


class Lattice:
    """Character bigrams by script, and the search for the best reading of looks, many at once."""

    def __init__(self, bigrams: dict[tuple[str, str, str], int]):
        self.scripts = (*SCRIPTS, "?")
        letters = {s: sorted({c for (t, a, b) in bigrams if t == s for c in (a, b) if c}) for s in self.scripts}
        self.place = {s: {c: i for i, c in enumerate(letters[s])} for s in self.scripts}
        sizes = {s: max(32, len(letters[s])) for s in self.scripts}
        starts = sum(n for (s, a, _), n in bigrams.items() if not a and s != "?") + sum(sizes.values())
        #: Log probabilities, add-one smoothed: of a word's first letter over the words of all scripts, and of a letter behind
        #: another one of its script. The last letter stands for any not seen, the last follower for the end of the word.
        self.start, self.step = [], []
        for s in self.scripts:
            n = len(letters[s])
            first, after = np.zeros(n + 1), np.zeros((n + 1, n + 2))
            for (t, a, b), count in bigrams.items():
                if t == s and not a:
                    first[self.place[s][b]] = count
                elif t == s:
                    after[self.place[s][a], self.place[s][b] if b else n + 1] = count
            self.start.append(np.log((first + 1) / starts))
            self.step.append(np.log((after + 1) / (after.sum(axis=1, keepdims=True) + sizes[s])))
        self.memo: dict[str, str] = {}
        #: Words that are their own form: most, so texts are first held against these as a whole.
        self.plain: set[str] = set()
        self.searched = 0

    def __getstate__(self) -> dict:
        return {**self.__dict__, "memo": {}, "plain": set(), "searched": 0}

    def learn(self, words: set[str]) -> None:
        """Keep the forms of looks; the search decides if more than one script has one of their letters."""
        new = words - self.memo.keys()
        if len(self.memo) + len(new) > KEPT:
            self.memo.clear()
            self.plain.clear()
            new = words
        shared = sorted((w for w in new if _SHARED.search(w)), key=lambda w: (len(w), w))
        forms = dict.fromkeys(new)
        for k in range(0, len(shared), 4096):
            for n in sorted({len(w) for w in shared[k : k + 4096]}):
                same = [w for w in shared[k : k + 4096] if len(w) == n]
                forms.update(zip(same, self.search(same)))
        for w, form in forms.items():
            self.memo[w] = form = form or w
            if form == w:
                self.plain.add(w)

    def search(self, words: list[str]) -> list[str]:
        """Viterbi's search over words of one length, side by side: a script has one letter for a look, so a state is a script; ties go to the script named first."""
        self.searched += len(words)
        looks, back = np.unique(np.array([list(w) for w in words]), return_inverse=True)
        back = back.reshape(len(words), -1)
        members = [MEMBERS.get(c) or {script(c): c} for c in looks.tolist()]
        # By script and look: the letter's number, -1 where the script has none.
        number = np.array([[self.place[s].get(m[s], len(self.place[s])) if s in m else -1 for m in members] for s in self.scripts])
        letter = [[m.get(s, "") for m in members] for s in self.scripts]
        many, n = back.shape
        all_ = range(len(self.scripts))
        at = number[:, back]
        score = np.stack([np.where(at[s, :, 0] >= 0, self.start[s][at[s, :, 0]], -np.inf) for s in all_])
        came = np.zeros((n, len(self.scripts), many), np.int8)
        for i in range(1, n):
            new = np.full_like(score, -np.inf)
            for s in all_:
                here = at[s, :, i]
                others = score.copy()
                others[s] = -np.inf
                best = others.argmax(axis=0)
                change = others[best, np.arange(many)] + SWITCH + self.start[s][here]
                stay = score[s] + self.step[s][at[s, :, i - 1], here]
                came[i, s] = np.where(stay >= change, s, best)
                new[s] = np.where(here >= 0, np.maximum(stay, change), -np.inf)
            score = new
        score = np.stack([score[s] + self.step[s][at[s, :, n - 1], -1] for s in all_])
        state, out = score.argmax(axis=0), [[""] * n for _ in words]
        for i in range(n - 1, -1, -1):
            for w, (s, c) in enumerate(zip(state.tolist(), back[:, i].tolist())):
                out[w][i] = letter[s][c]
            state = came[i, state, np.arange(many)]
        return ["".join(w) for w in out]

    def forms(self, texts: list[str | None]) -> list[str | None]:
        """The consistent forms of texts; null for null."""
        looks = [None if t is None else look(t) for t in texts]
        words = [set(_WORD.findall(t)) if t else set() for t in looks]
        self.learn(set().union(*words))
        return [t if not t or w <= self.plain else _WORD.sub(lambda m: self.memo[m.group()], t) for t, w in zip(looks, words)]

    def form(self, text: str) -> str:
        return self.forms([text])[0]


def _record(documents: DataFrame) -> Column:
    """The text, or, for records without one, the turns in order with their roles; private-use characters keep them apart."""
    turn = F.transform("turns", lambda t: F.concat(F.coalesce(t["role"], F.lit("")), F.lit(f" {ROLE} "), F.coalesce(t["text"], F.lit(""))))
    return F.coalesce(F.col("text"), F.array_join(turn, f" {TURN} "))


def is_blank(form: str | None) -> bool:
    """Whether a record's form shows nothing: no text, or turns without any."""
    return not form or (ROLE in form and not any(t.partition(ROLE)[2].strip() for t in form.split(TURN)))


def bigram_counts(documents: DataFrame) -> DataFrame:
    """script, before, letter, n over all texts and turns."""

    def part(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        words: Counter = Counter()
        for pdf in it:
            for text in pdf["record"].dropna():
                words.update(_WORD.findall(fold_looks(text)))
            if len(words) > KEPT:
                total += word_bigrams(words)
                words.clear()
        total += word_bigrams(words)
        yield pd.DataFrame([(*k, n) for k, n in total.items()], columns=["script", "before", "letter", "n"])

    return documents.select(_record(documents).alias("record")).mapInPandas(part, "script string, before string, letter string, n long").groupBy("script", "before", "letter").agg(F.sum("n").alias("n"))


def train(documents: DataFrame) -> Lattice:
    """The lattice model of a corpus. Gathers at most alphabet^2 rows per script (the letters of four alphabets)."""
    return Lattice({(r["script"], r["before"], r["letter"]): r["n"] for r in bigram_counts(documents).collect()})


def consistent_forms(documents: DataFrame, lattice: Lattice | None = None) -> DataFrame:
    """doc_id, form, form_hash (128 bits), blank, raw_hash (128 bits of the characters as they stand, turns and roles included).

    form is null where there is neither text nor turns, and '' for blank ones. Nulls inside turns count as ''. Columns other
    than doc_id, text and turns are not read. Repeated rows give repeated results; an empty table gives no rows.
    """
    model = documents.sparkSession.sparkContext.broadcast(lattice or train(documents))

    def part(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            forms = model.value.forms([None if pd.isna(t) else t for t in pdf["record"]])
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"],
                "form": forms,
                "form_hash": [None if f is None else xxhash.xxh3_128_digest(f) for f in forms],
                "blank": [is_blank(f) for f in forms],
                "raw_hash": [None if t is None else xxhash.xxh3_128_digest(t) for t in pdf["record"]],
            })

    return documents.select("doc_id", _record(documents).alias("record")).mapInPandas(part, "doc_id long, form string, form_hash binary, blank boolean, raw_hash binary")


class Looks:
    """The documents that show something, by look and by spelling.

    members: doc_id, spelling (the smallest doc_id written just so), once each. spellings: spelling, look (the smallest
    doc_id of that look), documents. Records with a null doc_id and blank ones (no visible character; turns without any
    text) are in neither. Only ids and hashes are shuffled; counts are partially aggregated.
    """

    def __init__(self, documents: DataFrame, lattice: Lattice | None = None):
        forms = consistent_forms(documents, lattice).where(~F.col("blank") & F.col("doc_id").isNotNull()).select("doc_id", "form_hash", "raw_hash")
        self.forms = cut_lineage(forms)
        written = self.forms.groupBy("form_hash", "raw_hash").agg(F.min("doc_id").alias("spelling"), F.count("*").alias("documents"))
        looks = written.groupBy("form_hash").agg(F.min("spelling").alias("look"), F.count("*").alias("spellings"))
        self.spellings = cut_lineage(written.join(looks, "form_hash").select("raw_hash", "form_hash", "spelling", "look", "spellings", "documents"))

    def members(self) -> DataFrame:
        return self.forms.join(self.spellings.select("form_hash", "raw_hash", "spelling", "spellings"), ["form_hash", "raw_hash"]).select("doc_id", "spelling", "spellings").distinct()

    def classes(self) -> DataFrame:
        """doc_id, look (its class: the smallest doc_id of that look), spelling, and how many spellings the look has."""
        return self.forms.join(self.spellings, ["form_hash", "raw_hash"]).select("doc_id", "look", "spelling", "spellings").distinct()

    def links(self) -> DataFrame:
        """Pairs of spellings of one look: spelling_a < spelling_b. Their number is that of different strings, not of documents."""
        some = self.spellings.where("spellings > 1").select("look", "spelling")
        return some.withColumnRenamed("spelling", "spelling_a").join(some.withColumnRenamed("spelling", "spelling_b"), "look").where("spelling_a < spelling_b").select("spelling_a", "spelling_b")

    def pairs(self) -> DataFrame:
        """doc_id_a < doc_id_b of documents of different spellings of one look: the links expanded by their members, large groups dealt over many tasks."""
        members = cut_lineage(self.members().where("spellings > 1").select("doc_id", "spelling"))
        out = with_members(with_members(self.links(), "spelling_a", members, "spelling", "doc_id", "x"), "spelling_b", members, "spelling", "doc_id", "y")
        return out.where("x <> y").select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b")).distinct()


def same_looking_pairs(documents: DataFrame, lattice: Lattice | None = None) -> DataFrame:
    """Pairs doc_id_a < doc_id_b of documents whose texts (or turns) look the same and are not the same string."""
    return Looks(documents, lattice).pairs()
