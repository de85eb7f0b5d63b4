"""The training-data operators: brute force, invariants, nulls, ties, repeats, empty tables, clashing columns."""

from __future__ import annotations

import math
import random
import unicodedata
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

from grainmill import session
from grainmill.llm import cutoff, language, leakage, lookalike, mixing, overlap, packing, queries, skew, splitting, textfold, toxicity
from grainmill.llm.editdistance import common_length, distance, search
from grainmill.session import table

DOCS = "doc_id long, text string, source string, lane string, language string, split string, quality double, turns array<struct<role:string,text:string>>, rep long, class string, n int, _group string"
ROWS = "shard_id string, row_id int, doc_id long, lane string, split string, language string, tokens array<int>, roles array<string>, written_at timestamp, n int, part int, size int"
CONFIG = "lane string, capacity int, piece_limit int, piece_overlap int, keep_fraction double, protected_floor double"


def docs(spark, rows):
    """Rows of (doc_id, text, source, lane, language, split, quality, turns), with columns whose names operators use themselves."""
    return spark.createDataFrame([(*r, 1, "c", 2, "g") for r in rows], DOCS)


def config(spark, rows=(("a", 10, 8, 2, 0.5, None),)):
    return spark.createDataFrame(list(rows), CONFIG)


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


# --- SQL and rows


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, sf_dir, name):
    assert compare(spark, connect(sf_dir), queries.queries()[name], queries.oracle_sql()[name], sf_dir) == ""


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_schema_and_no_repeats(spark, sf_dir, name):
    df = queries.queries()[name](spark, sf_dir)
    want = {"p1_found": {"doc_id": "bigint", "language": "string"}, "p3_found": {"doc_id_a": "bigint", "doc_id_b": "bigint"}, "p4_found": {"doc_id_a": "bigint", "doc_id_b": "bigint"}, "p7_found": {"doc_id": "bigint", "item_id": "bigint"}, "p9_found": {"doc_id": "bigint"}}
    assert name not in want or dict(df.dtypes) == want[name]
    pdf = df.toPandas()
    if name.endswith("_found"):
        assert not pdf.duplicated().any()
    if "doc_id_a" in pdf:
        assert (pdf.doc_id_a < pdf.doc_id_b).all()


def test_empty_tables(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n).limit(0)
    d, r, c = t("documents"), t("shard_rows"), t("lane_config")
    assert language.unnamed_languages(d).count() == 0 and language.document_languages(d).count() == 0
    assert packing.pack(r, c).count() == 0 and packing.fill_report(packing.pack(r, c)).count() == 0
    assert overlap.Overlap(d).pairs().count() == 0 and overlap.overlap_report(d).count() == 0
    assert lookalike.same_looking_pairs(d).count() == 0
    assert splitting.split_oversized(r, c).count() == 0
    assert cutoff.lane_cutoffs(d, c).count() == 0 and cutoff.kept_documents(d, c).count() == 0
    assert leakage.leaks(d, t("eval_items")).count() == 0
    assert leakage.leaks(table(spark, sf_dir, "documents"), t("eval_items")).count() == 0
    assert mixing.mix(d, t("source_targets"), tokenizer=None).uses.count() == 0 and mixing.mix(d, t("source_targets"), tokenizer=None).report().count() == 0
    assert mixing.mix(table(spark, sf_dir, "documents"), t("source_targets"), tokenizer=None).uses.count() == 0
    assert toxicity.scores(d, t("review_labels")).count() == 0
    assert toxicity.scores(table(spark, sf_dir, "documents").limit(20), t("review_labels")).where("flagged").count() == 0


NULLS = [(None, None, None, None, None, None, None, None), (1, None, None, None, None, "train", float("nan"), None), (2, "", "s", "a", "", "train", -1.0, []), (3, " ​\n", "s", "a", "en", None, 2.0, [(None, None)]), (4, "!?", "s", "a", "xx", "eval", 0.5, [("user", None)]), (4, "!?", "s", "a", "xx", "eval", 0.5, [("user", None)])]


def test_nulls_in_any_column(spark):
    d = docs(spark, NULLS)
    c = config(spark, [("a", None, None, None, None, None), (None, 4, 4, 1, 0.5, None)])
    assert language.segments(d).count() == 0
    assert overlap.Overlap(d).pairs().count() == 0
    assert lookalike.same_looking_pairs(d).count() == 0
    assert lookalike.consistent_forms(d).where("blank").count() == 4
    assert cutoff.lane_cutoffs(d, c).count() == 0
    items = spark.createDataFrame([(1, "x", "en", None, None), (None, "x", "en", "a b c d", None), (2, "x", "en", "", None)], "item_id long, suite string, language string, text string, answer string")
    assert leakage.leaks(d, items).count() == 0
    targets = spark.createDataFrame([("s", None, 1), (None, 0.5, 1), ("t", 0.5, None)], "source string, target_share double, max_repeats int")
    assert mixing.mix(d, targets, tokenizer=None).uses.count() == 0
    labels = spark.createDataFrame([(4, "r", None, None), (None, "r", 1, None)], "doc_id long, reviewer string, abusive int, labelled_at timestamp")
    assert toxicity.scores(d, labels).where("flagged").count() == 0
    rows = spark.createDataFrame([(None, None, None, None, None, None, None, None, None, 1, 1, 1), ("s", 0, 1, "a", "train", "en", None, ["x"], None, 1, 1, 1), ("s", 1, 1, "a", "train", "en", [1, None], None, None, 1, 1, 1)], ROWS)
    assert packing.pack(rows, c).where("container is not null").count() == 0
    assert splitting.split_oversized(rows, c).count() == 0
    assert packing.pack(rows, config(spark)).where("container is not null").count() == 1


# --- 1 languages


def test_labels_name_languages(spark):
    got = spark.createDataFrame([(x,) for x in ("en", " EN ", "en-US", "en_GB", "English", "ger", "de-AT", "Python", "py", "hi-IN", "fr", "xx", "", "N/A", None, "Marathi")], "language string").select(language.named(F.col("language")).alias("l")).collect()
    assert [r.l for r in got] == ["en"] * 5 + ["de", "de", "python", "python", "hi", None, None, None, None, None, "mr"]


def test_code_lengths_are_exact():
    """The lengths of a token under the resolved trees equal those of walking the escapes by hand, and sum to a distribution."""
    from collections import Counter

    trees = language.Trees({"en": Counter({"the": 3, "then": 1}), "de": Counter({"der": 2})})
    for tree, counts in (("en", {"the": 3, "then": 1}), ("de", {"der": 2})):
        follow = {}
        for tok, n in counts.items():
            raw = b"\x02" + tok.encode() + b"\x00"
            for i in range(1, len(raw)):
                for k in range(min(language.ORDER, i) + 1):
                    follow.setdefault(raw[i - k : i], Counter())[raw[i]] += n

        def cost(ctx, sym):
            bits = 0.0
            while True:
                c = follow.get(ctx)
                if c:
                    total = sum(c.values()) + len(c)
                    if sym in c:
                        return bits - math.log2(c[sym] / total)
                    bits -= math.log2(len(c) / total)
                if not ctx:
                    return bits + 8
                ctx = ctx[1:]

        j = language.TREES.index(tree)
        for tok in ("the", "there", "der"):
            raw = b"\x02" + tok.encode() + b"\x00"
            want = sum(cost(raw[max(0, i - language.ORDER) : i], raw[i]) for i in range(1, len(raw)))
            got = sum(trees._fall(raw[max(0, i - language.ORDER) : i], raw[i])[j] for i in range(1, len(raw)))
            assert abs(want - got) < 1e-9


def test_held_out_accuracy_and_mixed_lines(spark):
    d = table(spark, "/root/testdata/sf0.01", "documents").where("text is not null")
    trees = language.train(d.where("doc_id % 2 = 0"), per_label=120)
    rest = d.where("doc_id % 2 = 1").select("doc_id", "text", "source", "lane", "language", "split", "quality", "turns")
    got = language.document_languages(rest, trees).toPandas().set_index("doc_id")
    label = rest.select("doc_id", language.named(F.col("language")).alias("l"), "lane").toPandas().set_index("doc_id")
    j = got.join(label).dropna(subset=["l"])
    assert (j.language == j.l).mean() > 0.85  # one label in ten or so is wrong
    code = got.join(label).query("lane == 'code'")
    assert (code.language == "python").mean() > 0.97
    mixed = "The report counts more than forty visits and the bridge was closed.\nDer Gärtner zählt einen neuen Plan, und die Gemeinde ergänzt das Wörterbuch.\nछात्र विद्यालय के आँगन में पुरानी किताबें देखते हैं। (bridge)"
    langs = [x[2] for x in next(language.read(trees, [mixed]))]
    assert langs == ["en", "de", "hi"]
    one = next(language.read(trees, ["The planners near the canal weigh every library ahead of the season (पंचायत) and the market repeats it."]))
    assert [x[2] for x in one] == ["en"] and 0 <= one[0][3] <= 1


def test_stretches_scraps_and_unknown_languages(spark):
    d = table(spark, "/root/testdata/sf0.01", "documents").where("text is not null")
    trees = language.train(d, per_label=120)
    prose = "The report counts more than forty visits and the bridge was closed.\nRecords show that the market reopened after the rain."
    code = "def count_visits(bridge, market=40):\n    total = bridge + market\n    return total"
    mixed = f"{prose}\n{code}\n{prose}"
    assert [x[2] for x in next(language.read(trees, [mixed]))] == ["en", "python", "en"]
    assert [x[2] for x in next(language.read(trees, [mixed], records=True))] == ["python"]
    # A short line in another script stands; a short line in the same one is taken for its neighbours'.
    assert [x[2] for x in next(language.read(trees, [f"{prose}\nநன்றி"]))] == ["en", "ta"]
    assert [x[2] for x in next(language.read(trees, [f"{prose}\nnaïve près"]))] == ["en"]
    for text in ("Вчера городской совет решил закрыть мост на время ремонта, и жители должны выбрать другую дорогу.", "市议会昨天决定在维修期间关闭大桥居民必须选择其他道路绕行并且等待", "Gmina zdecydowała wczoraj zamknąć most na czas remontu i mieszkańcy muszą wybrać inną drogę"):
        assert [x[2] for x in next(language.read(trees, [text]))] == [language.NONE]


def test_borrowed_words_are_an_escape_of_the_code():
    from collections import Counter

    trees = language.Trees({"en": Counter({"the": 30, "then": 10}), "de": Counter({"der": 20})})
    plain = lambda t: np.array([sum(trees._fall((b"\x02" + t.encode() + b"\x00")[max(0, i - language.ORDER) : i], (b"\x02" + t.encode() + b"\x00")[i])[j] for i in range(1, len(t) + 2)) for j in range(len(language.TREES))]) + trees.none
    for t in ("the", "derthe", "xyzxyzxyz"):
        want = np.minimum(plain(t), plain(t).min() + language.BORROW) + trees.none
        assert np.allclose(trees.lengths(t), want, equal_nan=True) and np.allclose(trees._many([t])[0], want, equal_nan=True)


def test_confidence_is_calibrated_on_held_out_lines(spark):
    """Of short stretches given with confidence c, about c are right: checked in three bands on held-out lines cut to a few words."""
    d = table(spark, "/root/testdata/sf0.01", "documents").where("text is not null")
    trees = language.train(d.where("doc_id % 2 = 0"), per_label=120)
    whole = [x for r in d.where("doc_id % 2 = 1").select("text").collect() for x in r.text.splitlines()]
    rng, got = random.Random(15), []
    for line in whole:
        words = line.split()
        full = next(language.read(trees, [line]))
        if len(full) != 1 or full[0][4] < 40 or full[0][3] < 0.999 or full[0][2] == language.NONE:
            continue
        at = rng.randrange(len(words))
        part = next(language.read(trees, [" ".join(words[at : at + rng.choice([1, 1, 2, 3])])]))
        if len(part) == 1:
            got.append((part[0][3], part[0][2] == full[0][2]))
    got = np.array(got, float)
    assert len(got) > 500
    for lo, hi in ((0.0, 0.7), (0.7, 0.95), (0.95, 1.01)):
        band = got[(got[:, 0] >= lo) & (got[:, 0] < hi)]
        assert len(band) < 30 or abs(band[:, 0].mean() - band[:, 1].mean()) < 0.25, (lo, len(band), band.mean(axis=0))


# --- 2 packing


def test_packing_invariants_and_ties(spark):
    rng = random.Random(3)
    sizes = [rng.choice([1, 2, 3, 5, 5, 5, 7, 10, 11, 25]) for _ in range(300)]
    rows = [("s", i, i, "a", "train", "en", [9] * n, ["content"] * n, None, 0, 0, 0) for i, n in enumerate(sizes)]
    rows += rows[:7] + [("s", 900, 1, "zz", "train", "en", [1], ["x"], None, 0, 0, 0), ("s", 901, 1, None, "train", "en", [1], ["x"], None, 0, 0, 0), ("s", 902, 1, "a", "train", "en", [], [], None, 0, 0, 0), ("s", 903, 1, "a", "train", "en", [4, 0, 0], ["content", "pad", "pad"], None, 0, 0, 0)]
    got = packing.pack(spark.createDataFrame(rows, ROWS).repartition(7), config(spark), ranges=4, block=3).toPandas()
    placed = got[got.container.notna()].sort_values(["container", "packed_start"])
    assert sorted(got[got.container.isna()].row_id) == [900, 901, 902]
    assert not got.duplicated(["shard_id", "row_id", "part"]).any()
    assert placed["size"].sum() == sum(sizes) + 1
    for _, g in placed.groupby("container"):
        assert (g.packed_start == g["size"].cumsum() - g["size"]).all() and g["size"].sum() <= 10 and (g.container_fill == g["size"].sum()).all()
    cut = placed[placed.part > 0].row_id.unique()
    assert all(sizes[i] > 10 for i in cut)
    assert set(placed.container) == set(range(int(placed.container.max()) + 1))
    least = -(-placed["size"].sum() // 10)
    assert placed.container.max() + 1 <= least * 1.1 + 1


def _histogram(spark, sizes, capacity):
    return spark.createDataFrame([("a", capacity, s, n) for s, n in sizes.items()], "lane string, capacity int, size int, count long")


def _plain_best_fit(sizes, capacity):
    """Containers of best-fit decreasing, item by item."""
    gaps = []
    for size in sorted((s for s, n in sizes.items() for _ in range(n)), reverse=True):
        at = min((g for g in gaps if g >= size), default=None)
        if at is None:
            gaps.append(capacity - size)
        else:
            gaps[gaps.index(at)] -= size
    return len(gaps)


@pytest.mark.parametrize("capacity", [10, 64, 2048, 131072])
def test_every_rank_has_one_place_and_containers_hold(spark, capacity):
    rng = random.Random(capacity)
    sizes = {}
    for _ in range(400):
        s = min(capacity, int(rng.lognormvariate(math.log(capacity / 8), 0.9)) + 1)
        sizes[s] = sizes.get(s, 0) + 1
    rows = packing.plan(_histogram(spark, sizes, capacity)).collect()
    seen, held = {s: set() for s in sizes}, {}
    for r in rows:
        for rank in range(r.lo, r.hi):
            assert rank not in seen[r["size"]]
            seen[r["size"]].add(rank)
            held.setdefault(r["first"] + (rank - r.lo) // r.k, []).append((r.start + (rank - r.lo) % r.k * r["size"], r["size"]))
    assert all(seen[s] == set(range(n)) for s, n in sizes.items())
    for parts in held.values():
        at = 0
        for start, size in sorted(parts):
            assert start == at
            at += size
        assert at <= capacity
    assert sorted(held) == list(range(len(held)))
    assert len(held) <= _plain_best_fit(sizes, capacity) * 1.01 + 2


def test_sweep_is_best_fit(spark):
    rng = random.Random(4)
    for _ in range(200):
        items = {rng.randint(1, 40): rng.randint(1, 6) for _ in range(rng.randint(1, 6))}
        gaps = [rng.randint(1, 60) for _ in range(rng.randint(0, 8))]
        matches, left, rest = packing.sweep([(s, 0, n) for s, n in items.items()], [(g, i, 1) for i, g in enumerate(gaps)], 64)
        plain, missed = list(gaps), {}
        for size in sorted((s for s, n in items.items() for _ in range(n)), reverse=True):
            fits = [g for g in plain if g >= size]
            if fits:
                plain[plain.index(min(fits))] -= size
            else:
                missed[size] = missed.get(size, 0) + 1
        assert {s: hi - lo for s, lo, hi in left} == missed
        assert sorted(g for g, _, n in rest for _ in range(n) if g) == sorted(g for g in plain if g)
        assert sum(hi - lo for _, lo, hi, *_ in matches) == sum(items.values()) - sum(missed.values())


def test_rounds_and_plan_are_bounded_by_the_capacity(spark):
    rng = random.Random(4)
    base = {s: rng.randint(1, 9) for s in range(1, 513)}
    few = packing.plan(_histogram(spark, base, 512)).count()
    many = packing.plan(_histogram(spark, {s: n * 1_000_003 for s, n in base.items()}, 512)).count()
    assert many < 12 * few and many < 512 * 12


# --- 3 overlap, with edit distances


def test_bit_parallel_distances():
    rng = random.Random(0)
    for _ in range(400):
        a, b = ([rng.randint(0, 3) for _ in range(rng.randint(0, 14))] for _ in range(2))
        assert distance(a, b) == edit(a, b) and common_length(a, b) == lcs(a, b)
        if a:
            masks = {}
            for i, x in enumerate(a):
                masks[x] = masks.get(x, 0) | 1 << i
            assert search(masks, len(a), b)[0] == min(edit(a, b[i:j]) for i in range(len(b) + 1) for j in range(i, len(b) + 1))


def test_overlap_equals_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows, texts = [], {}
    common = ["this", "notice", "must", "be", "kept", "in", "all", "copies", "of", "the", "file"]
    for k in range(160):
        base = (common if k % 3 == 0 else []) + [rng.choice(words) for _ in range(rng.choice([3, 6, 9, 15, 30, 45, 90, 220]))]
        for copy in range(rng.randint(1, 3)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 5)) if copy else 0):
                i, what = rng.randrange(len(w)), rng.random()
                w[i : i + 1] = [] if what < 0.25 and len(w) > 3 else [rng.choice(words)] * (2 if what > 0.75 else 1)
            doc = len(rows) + 1
            text = " ".join(w) if copy != 1 else ", ".join(w).upper()
            rows.append((doc, text, "s", "a", "en", rng.choice(["train", "train", "eval", "validation"]), 0.5, None))
            texts[doc] = textfold.fold_words(text)
    rows += [(1000 + i, "the same text stands here five times", "s", "a", "en", "train" if i < 3 else "eval", 0.5, None) for i in range(5)]
    texts |= {1000 + i: textfold.fold_words(rows[-1][1]) for i in range(5)}
    split = {r[0]: r[5] for r in rows}
    want = set()
    for a in texts:
        for b in texts:
            if split[a] == "train" != split[b]:
                n = max(len(texts[a]), len(texts[b]))
                if edit(texts[a], texts[b]) <= n // 7:
                    want.add((min(a, b), max(a, b)))
    o = overlap.Overlap(docs(spark, rows).repartition(5))
    got = {(r.doc_id_a, r.doc_id_b) for r in o.pairs().collect()}
    assert want <= got
    for a, b in got - want:
        n = max(len(texts[a]), len(texts[b]))
        assert edit(texts[a], texts[b]) <= overlap.allowed(n)
    touched = {r.doc_id: r for r in o.touched().collect()}
    assert set(touched) == {x for p in got for x in p}
    for r in o.links.collect():
        a, b = texts[r.rep_a], texts[r.rep_b]
        assert r.edits == edit(a, b) and r.coverage_a == pytest.approx(lcs(a, b) / len(a)) and r.coverage_b == pytest.approx(lcs(a, b) / len(b))


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
        row = new
    return row[-1]


def test_near_same_texts_share_what_is_promised():
    """Windows, and the number of fingerprints that a pair must share, hold for edits placed as badly as can be."""
    rng = random.Random(13)
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for n in [*range(7, 90), 120, 146, 147, 200, 350, 700, 1500]:
        a = rng.sample(range(10**6), n)
        for even in (True, False):
            b, e = list(a), int(overlap.allowed(n))
            at = [round((k + 1) * (n + 1) / (e + 1)) - 1 for k in range(e)] if even else rng.sample(range(n), e)
            for k in sorted(set(at), reverse=True):
                b[k : k + 1] = [rng.randint(10**6, 10**7)] if rng.random() < 0.6 or len(b) >= n else []
            text, fp, _, must, _ = overlap.fingerprints([np.array(a, np.uint32), np.array(b, np.uint32)], *none)
            both = len(set(fp[text == 0].tolist()) & set(fp[text == 1].tolist()))
            assert both >= min(must) or n < 11, (n, even, both, must)
    windows, must = overlap.rules(np.arange(5, 40_000))
    assert (np.diff(windows) >= 0).all() and windows.max() == overlap.WIDEST and [int(np.argmax(windows == w)) + 5 for w in (2, 3, 4)] == sorted(int(np.argmax(windows == w)) + 5 for w in (2, 3, 4))
    full = np.array(rng.sample(range(10**6), 2000), np.uint32)
    assert len(overlap.fingerprints([full], *none)[0]) < 0.45 * 2000


def test_every_near_same_text_looks_for_a_piece_that_is_laid_down():
    """Whatever is frequent and however badly the edits are placed, a text has a key under which its counterpart lays a piece down."""
    rng = random.Random(17)
    for n in [*range(3, 60), 99, 100, 146, 200, 350, 700, 1500, 5000]:
        a = rng.sample(range(10**6), n)
        for _ in range(6):
            b, e = list(a), int(overlap.allowed(n)) if n >= 11 else n // 7
            at = [round((k + 1) * (n + 1) / (e + 1)) - 1 for k in range(e)] if rng.random() < 0.5 else rng.sample(range(n), e)
            what = rng.choice(["out", "in", "other"])
            for k in sorted(set(at), reverse=True):
                b[k : k + (what != "in")] = [] if what == "out" else [rng.randint(10**6, 10**7)]
            if not b or distance(a, b) > overlap.allowed(max(len(a), len(b))):
                continue
            for x, y in ((a, b), (b, a)):
                laid, asked = overlap.Texts([np.array(x, np.uint32)]), overlap.Texts([np.array(y, np.uint32)])
                known = np.unique(np.concatenate([overlap.grams(laid.words, g) for g in overlap.LENGTHS]))
                known = known[np.array([rng.random() < 0.3 for _ in known], bool)]
                text, place, fp, _ = overlap.laid_down(laid, known, np.full(len(known), 9))
                assert len(text) <= max(overlap.pieces_needed(len(x)), overlap.SHORT - 3)
                k = overlap.bucket(laid.n[text])
                keys = overlap.cell(fp, k, place // (overlap.reach(k) + 1), np.zeros(len(fp), np.int64))
                text, place, fp = overlap.looked_for(asked)
                assert np.isin(overlap.cells(fp, asked.n[text], place, np.zeros(len(fp), np.int64))[0], keys).any(), (n, what)


def test_overlap_stores_less_than_the_texts(spark):
    d = table(spark, "/root/testdata/sf0.1", "documents")
    size = lambda: sum(p.stat().st_size for p in Path(urlparse(spark.sparkContext.getCheckpointDir()).path).rglob("*") if p.is_file())
    session.ensure_checkpoint_dir(spark)
    before = size()
    o = overlap.Overlap(d)
    assert o.links.count() and size() - before < 0.5 * d.agg(F.sum(F.octet_length("text"))).first()[0]


def test_frequent_fingerprints_are_dealt_over_keys(spark, monkeypatch):
    """The same pairs with and without salts."""
    rng = random.Random(14)
    boiler = [f"b{i}" for i in range(40)]
    rows = [(i, " ".join(boiler + [f"x{i}", f"y{i}"][: i % 3]), "s", "a", "en", rng.choice(["train", "eval"]), 0.5, None) for i in range(60)]
    whole = {tuple(r) for r in overlap.Overlap(docs(spark, rows)).pairs().collect()}
    monkeypatch.setattr(overlap, "SPLIT", 7)
    assert {tuple(r) for r in overlap.Overlap(docs(spark, rows)).pairs().collect()} == whole
    split = {r[0]: r[5] for r in rows}
    assert whole == {(a, b) for a in split for b in split if a < b and (split[a] == "train") != (split[b] == "train")}


def test_overlap_of_the_test_tables_equals_brute_force(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "split", "text").toPandas()
    w = {r.doc_id: textfold.fold_words(r.text) for r in d.itertuples()}
    split = dict(zip(d.doc_id, d.split))
    want = set()
    for a in w:
        for b in w:
            if split[a] == "train" != split[b] and w[a] and w[b]:
                n = max(len(w[a]), len(w[b]))
                if abs(len(w[a]) - len(w[b])) <= overlap.allowed(n) and distance(w[a], w[b]) <= overlap.allowed(n):
                    want.add((min(a, b), max(a, b)))
    got = {(r.doc_id_a, r.doc_id_b) for r in queries.queries()["p3_found"](spark, sf_dir).collect()}
    assert got == want


# --- 4 looks


CYRILLIC_WORDS = {("CYRILLIC", "", "М"): 5, ("CYRILLIC", "М", "о"): 5, ("CYRILLIC", "о", "с"): 5, ("CYRILLIC", "с", "к"): 5, ("CYRILLIC", "к", "в"): 5, ("CYRILLIC", "в", "а"): 5}


def test_equal_looks_are_equal_and_others_differ():
    lat = lookalike.Lattice(CYRILLIC_WORDS)
    same = [("The copy", "Тhе сору"), ("fi ﬁ", "fi fi"), ("ｆｕｌｌ １", "full 1"), ("café", "café"), ("cafe\u0301", "caf\u0435\u0301"), ("a\u200bb\u00adc", "abc"), ("a \t\r\nb ", "a b"), ("x‑y", "x-y"), ("Москва", "Mocквa")]
    for a, b in same:
        assert lat.form(a) == lat.form(b), (a, b)
    different = [("The", "the"), ("cafe", "café"), ("a,b", "a.b"), ("a1", "al"), ("O", "0"), ("x²", "x2"), ("“a”", '"a"'), ("l", "I")]
    for a, b in different:
        assert lat.form(a) != lat.form(b), (a, b)
    assert lat.form("Mocквa") == "Москва"
    for text in ("Тhе сору", "Mocквa", "नमस्ते", "ﬁ²", ""):
        assert lat.form(lat.form(text)) == lat.form(text)


def test_the_search_reads_every_shared_look_as_the_corpus_does(spark):
    """A look that the corpus backs as Cyrillic reads Cyrillic in both spellings, one that it backs as Latin reads Latin; each is searched once."""
    russian, english = "сор роса ухо сор роса сор", "cope race hoax cope race cope"
    rows = [(i, russian, *[None] * 6) for i in range(20)] + [(100 + i, english, *[None] * 6) for i in range(20)]
    model = lookalike.train(docs(spark, rows))
    counted = {(r.script, r.before, r.letter): r.n for r in lookalike.bigram_counts(docs(spark, rows)).collect()}
    assert counted["LATIN", "c", "o"] == 60 and counted["CYRILLIC", "с", "о"] == 60 and counted["LATIN", "", "r"] == 40
    for word in ("сор", "роса", "ухо"):
        assert model.form(word) == word == model.form(word.translate(str.maketrans(textfold.LOOKALIKE)))
    for word in ("cope", "race", "hoax"):
        assert model.form(word) == word == model.form(word.replace("o", "о").replace("a", "а"))
    assert model.searched == 6
    model.form("cope dry 123 नमस्ते")
    assert model.searched == 7  # dry: y is shared; the others are known or have no shared letter


def test_forms_do_not_hang_on_what_is_kept(monkeypatch):
    monkeypatch.setattr(lookalike, "KEPT", 7)
    lat, rng = lookalike.Lattice(CYRILLIC_WORDS), random.Random(17)
    texts = [" ".join(rng.choice(["Mocквa", "the", "copy", "vote", "peace", "oxen", "ace", "Тhе", "soap", "cat", "dry"]) for _ in range(6)) for _ in range(60)]
    got = [f for k in range(0, 60, 5) for f in lat.forms(texts[k : k + 5])]
    assert got == [lookalike.Lattice(CYRILLIC_WORDS).form(t) for t in texts]


def test_viterbi_equals_all_readings():
    rng = random.Random(11)
    letters = list("aoecpxyst")
    pairs = {}
    for s in textfold.SCRIPTS:
        own = [lookalike.MEMBERS[c][s] if c in lookalike.MEMBERS and s in lookalike.MEMBERS[c] else c for c in letters if s == "LATIN" or s in lookalike.MEMBERS.get(c, {})]
        for a in ("", *own):
            for b in (*own, "") if a else own:
                pairs[s, a, b] = rng.randint(0, 9)
    lat = lookalike.Lattice(pairs)

    log = lambda x: math.log(x)
    sizes = {s: max(32, len({c for t, a, b in pairs if t == s for c in (a, b) if c})) for s in (*textfold.SCRIPTS, "?")}
    starts = sum(n for (s, a, _), n in pairs.items() if not a) + sum(sizes.values())
    before = {}
    for (s, a, _), n in pairs.items():
        before[s, a] = before.get((s, a), 0) + n
    step = lambda s, a, b: log((pairs.get((s, a, b), 0) + 1) / (before.get((s, a), 0) + sizes[s]))
    start = lambda s, c: log((pairs.get((s, "", c), 0) + 1) / starts)

    def score(path):
        total, last = 0.0, None
        for s, c in path:
            total += start(s, c) if last is None else step(s, last[1], c) if last[0] == s else lookalike.SWITCH + start(s, c)
            last = s, c
        return total + step(last[0], last[1], "")

    words = ["".join(rng.choice([*letters, "b", "é"]) for _ in range(rng.randint(1, 5))) for _ in range(80)]
    for n in range(1, 6):
        same = [w for w in words if len(w) == n]
        for word, read in zip(same, lat.search(same) if same else []):
            paths = [[]]
            for c in word:
                paths = [[*p, x] for p in paths for x in (lookalike.MEMBERS.get(c) or {lookalike.script(c): c}).items()]
            top = max(map(score, paths))
            assert any(abs(score(p) - top) < 1e-9 and "".join(c for _, c in p) == read for p in paths)


def test_same_looking_pairs(spark):
    rows = [(1, "a copy here", None, None, None, None, None, None), (2, "а  сору hеrе", None, None, None, None, None, None), (3, "a copy here", None, None, None, None, None, None), (4, "A copy here", None, None, None, None, None, None)]
    rows += [(5, None, None, None, None, None, None, [("user", "hi there")]), (6, None, None, None, None, None, None, [("user", "hі there")]), (7, None, None, None, None, None, None, [("assistant", "hi there")]), (8, None, None, None, None, None, None, [("user", "hi"), ("user", "there")])]
    rows += [(9, " ", None, None, None, None, None, None), (10, "​", None, None, None, None, None, None)]
    got = {tuple(r) for r in lookalike.same_looking_pairs(docs(spark, rows)).collect()}
    assert got == {(1, 2), (2, 3), (5, 6)}
    classes = {r.doc_id: (r.look, r.spelling, r.spellings) for r in lookalike.Looks(docs(spark, rows)).classes().collect()}
    assert classes == {1: (1, 1, 2), 2: (1, 2, 2), 3: (1, 1, 2), 4: (4, 4, 1), 5: (5, 5, 2), 6: (5, 6, 2), 7: (7, 7, 1), 8: (8, 8, 1)}


def test_large_groups_are_dealt_over_many_keys(spark):
    members = spark.createDataFrame([(i, 1 if i < 500 else 500 + i % 7) for i in range(1, 800)], "doc_id long, rep long")
    links = spark.createDataFrame([(1, 500), (1, 1), (501, 502)], "rep_a long, rep_b long")
    assert {tuple(r) for r in skew.large_groups(members, "rep", 100).collect()} == {(1, 5)}
    both = skew.with_members(skew.with_members(links, "rep_a", members, "rep", "doc_id", "x", 100), "rep_b", members, "rep", "doc_id", "y", 100)
    of = {}
    for i in range(1, 800):
        of.setdefault(1 if i < 500 else 500 + i % 7, []).append(i)
    want = {(a, b, x, y) for a, b in ((1, 500), (1, 1), (501, 502)) for x in of[a] for y in of[b]}
    got = [(r.rep_a, r.rep_b, r.x, r.y) for r in both.collect()]
    assert len(got) == len(want) and set(got) == want


# --- 5 pieces


@pytest.mark.parametrize("limit,overlap_", [(8, 2), (8, 0), (5, 4), (5, 9), (1, 0), (64, 8), (200, 20)])
def test_pieces_cover_and_overlap(limit, overlap_):
    rng = np.random.default_rng(limit)
    text = "Ünïcode wörds, and नमस्ते दुनिया। More text here! A line\nand another one? " * 12
    t = np.frombuffer(text.encode(), np.uint8).astype(np.int64) + 3
    r = np.repeat(rng.integers(0, 3, len(t) // 40 + 1), 40)[: len(t)]
    got = splitting.split_row(t, r, limit, overlap_)
    o = min(overlap_, limit - 1)
    assert got[0][0] == 0 and got[-1][1] == len(t) and got[-1][2] == "end"
    for (s, e, _), (s2, e2, _) in zip(got, got[1:]):
        assert s2 == max(0, e - o) and e2 > e
    assert all(0 < e - s <= limit for s, e, _ in got)
    if limit >= 64:
        assert all(k in ("role", "line", "sentence", "word") for _, _, k in got[:-1])


def test_cuts_are_optimal_over_all_positions():
    rng = random.Random(6)
    for _ in range(30):
        n = rng.randint(9, 24)
        kind = np.array([4] + [rng.randint(0, 4) for _ in range(n - 1)], np.int8)
        limit, o = rng.randint(4, 8), rng.randint(0, 2)
        cuts = splitting.cut_positions(kind, n, limit, o)
        pieces = max(2, -(-(n - o) // (limit - o)))
        ideal = (n + (pieces - 1) * o) / pieces

        def cost(cs):
            ends = [*cs, n]
            starts = [0] + [c - o for c in cs]
            sizes = [e - max(0, s) if i == 0 else e - s for i, (s, e) in enumerate(zip(starts, ends))]
            return math.inf if max(sizes) > limit else sum(splitting.PENALTY[kind[c]] for c in cs) + splitting.BALANCE * sum((s / ideal - 1) ** 2 for s in sizes)

        best = {0: [(0.0, [])]}
        options = [(math.inf, None)]

        def grow(at, cs):
            if n - at + (o if cs else 0) <= limit and cs:
                options.append((cost(cs), cs))
            for c in range(at + 1, n):
                if c - at + (o if cs else 0) <= limit:
                    if len(cs) < 8:
                        grow(c, [*cs, c])

        if n <= 14:
            grow(0, [])
            assert cost(cuts) <= min(x for x, _ in options) + 1e-9
        assert cost(cuts) < math.inf and best


def _plain_programme(kind, n, limit, o):
    """Least cost over all positions, position by position."""
    pieces = max(2, -(-(n - o) // (limit - o)))
    ideal = (n + (pieces - 1) * o) / pieces
    best = [0.0] + [math.inf] * n
    for c in range(1, n + 1):
        own = splitting.PENALTY[kind[c]] if c < n else 0.0
        for b in range(max(0, c - limit), c):
            size = c - b + (o if b else 0)
            if size <= limit:
                best[c] = min(best[c], best[b] + splitting.BALANCE * (size / ideal - 1) ** 2 + own)
    return best[n], ideal


@pytest.mark.parametrize("limit,o,n", [(1536, 64, 5200), (2048, 256, 4500), (4096, 96, 9000)])
def test_pieces_equal_the_full_programme_at_production_limits(limit, o, n):
    rng = np.random.default_rng(limit)
    # Long stretches without a natural boundary, so that all stages are needed.
    kind = rng.choice(6, n, p=[0.0005, 0.001, 0.001, 0.0025, 0.495, 0.5]).astype(np.int8)
    cuts = splitting.cut_positions(kind, n, limit, o)
    want, ideal = _plain_programme(kind, n, limit, o)
    ends, starts = [*cuts, n], [0] + [c - o for c in cuts]
    sizes = [e - s for s, e in zip(starts, ends)]
    assert max(sizes) <= limit
    assert sum(splitting.PENALTY[kind[c]] for c in cuts) + splitting.BALANCE * sum((s / ideal - 1) ** 2 for s in sizes) == pytest.approx(want, abs=1e-9)


def test_the_latest_delivery_counts_whatever_its_length(spark):
    from datetime import datetime

    day = lambda m: datetime(2024, m, 1)
    row = lambda k, n, m: ("s", k, 1, "a", "train", "en", [35] * n, ["content"] * n, day(m), 0, 0, 0)
    rows = [row(1, 100, 1), row(1, 10, 2), row(2, 10, 1), row(2, 100, 2), row(3, 100, 1), row(3, 60, 3), row(3, 90, 2), row(4, 60, 1), row(4, 80, 1)]
    got = splitting.split_oversized(spark.createDataFrame(rows, ROWS).repartition(3), config(spark, [("a", 100, 50, 0, 0.5, None)])).toPandas()
    assert dict(zip(got.row_id, got.n_tokens)) == {2: 100, 3: 60, 4: 80}
    assert {k: list(g.sort_values("piece").piece) == list(range(g.pieces.iloc[0])) and g.token_end.max() == g.n_tokens.iloc[0] for k, g in got.groupby("row_id")} == {2: True, 3: True, 4: True}


def test_rows_delivered_twice_give_one_set_of_pieces(spark):
    row = ("s", 1, 1, "a", "train", "en", [35] * 20, ["content"] * 18 + ["pad"] * 2, None, 0, 0, 0)
    got = splitting.split_oversized(spark.createDataFrame([row, row, ("s", 2, 1, "a", "train", "en", [35] * 10, ["content"] * 8 + ["pad"] * 2, None, 0, 0, 0)], ROWS), config(spark)).toPandas()
    assert set(got.row_id) == {1} and (got.n_tokens == 18).all() and not got.duplicated(["piece"]).any() and (got.token_end - got.token_start).max() <= 8


# --- 6 cutoffs


@pytest.mark.parametrize("bins", [2, 7, 2048])
def test_cutoffs_equal_brute_force(spark, bins):
    rng = random.Random(7)
    scores = {"a": [rng.choice([0.0, 0.25, 0.5, 1.0]) for _ in range(57)], "b": [rng.random() for _ in range(101)], "c": [0.3] * 9, "d": [5e-324, 0.0, 1.0, 1 - 2**-53, 2**-1074]}
    rows = [(i, None, None, lane, None, None, q, None) for i, (lane, q) in enumerate((lane, q) for lane, qs in scores.items() for q in qs)]
    rows += [(900, None, None, "a", None, None, x, None) for x in (float("nan"), -0.1, 1.1, None)] + [(901, None, None, None, None, None, 0.5, None)]
    c = config(spark, [(lane, 1, 1, 0, f, None) for lane, f in (("a", 0.5), ("b", 0.375), ("c", 0.1), ("d", 0.6), ("e", 0.5))])
    got = {r.lane: (r.cutoff, r.scored, r.kept) for r in cutoff.lane_cutoffs(docs(spark, rows), c, bins).collect()}
    want = {}
    for lane, f in (("a", 0.5), ("b", 0.375), ("c", 0.1), ("d", 0.6)):
        q = sorted(scores[lane], reverse=True)
        cut = q[math.ceil(f * len(q)) - 1]
        want[lane] = (cut, len(q), sum(x >= cut for x in q))
    assert got == want


# --- 7 leaks


def test_leaks_on_a_fixture(spark):
    rng = random.Random(8)
    words = [f"word{i}" for i in range(500)]
    take = lambda n: [rng.choice(words) for _ in range(n)]
    own = {k: take(60) for k in range(6)}
    line = "Read the passage and answer the question."
    items = spark.createDataFrame([(k, "s", "en", f"{line}\n" + " ".join(w), None) for k, w in own.items()], "item_id long, suite string, language string, text string, answer string")
    noise = lambda: " ".join(f"n{rng.randint(0, 9999)}" for _ in range(50))
    altered = list(own[1][10:40])
    for i in (5, 14, 23):
        altered[i] = "changed"
    texts = {
        1: noise() + " " + " ".join(own[0][7:33]).upper() + ". " + noise(),
        2: noise() + " " + " ".join(altered) + " " + noise(),
        3: noise() + " " + " ".join(own[2][3:18]) + " " + noise() + " " + " ".join(own[2][25:40]) + " " + noise(),
        4: noise() + " " + " ".join(own[3][0:9]) + " " + noise(),
        5: line + " " + noise(),
        6: " ".join(" ".join(w) for w in own.values()),
        7: " ".join(own[4][20:46]),
    }
    rows = [(k, t, "s", "a", "en", "eval" if k == 7 else "train", 0.5, None) for k, t in texts.items()]
    want = {(1, 0), (2, 1), (3, 2), *((6, k) for k in own)}
    for most_sent in (leakage.MOST_SENT, 0):
        assert {tuple(r) for r in leakage.leaks(docs(spark, rows + rows[:2]), items, most_sent=most_sent).select("doc_id", "item_id").distinct().collect()} == want


def test_uneven_stretches_off_the_grid_count(spark):
    """Stretches of 8 and 16 words, and of 12 and 12 with an altered word, anywhere in the item."""
    rng = random.Random(12)
    own = [f"word{i}" for i in range(90)]
    items = spark.createDataFrame([(1, "s", "en", " ".join(own), None)], "item_id long, suite string, language string, text string, answer string")
    noise = lambda: " ".join(f"n{rng.randint(0, 9999)}" for _ in range(30))
    rows, few = [], []
    for k in range(12):
        a, b = list(own[k : k + 8]), list(own[40 + k : 56 + k])
        b[7] = "changed"
        rows.append((k, f"{noise()} {' '.join(a)} {noise()} {' '.join(b)} {noise()}", "s", "a", "en", "train", 0.5, None))
        a, b = list(own[k : k + 12]), list(own[50 + k : 62 + k])
        a[5] = "changed"
        rows.append((100 + k, f"{noise()} {' '.join(a)} {noise()} {' '.join(b)} {noise()}", "s", "a", "en", "train", 0.5, None))
        few.append((200 + k, f"{noise()} {' '.join(own[k : k + 5])} {noise()} {' '.join(own[40 + k : 54 + k])} {noise()}", "s", "a", "en", "train", 0.5, None))
    got = {r.doc_id for r in leakage.leaks(docs(spark, rows + few), items).collect()}
    assert got >= {r[0] for r in rows if r[0] >= 100} and len(got & {r[0] for r in rows}) >= 22 and not got & {r[0] for r in few}


def test_many_items_of_many_words(spark):
    """Two hundred thousand distinct words over the items, by either way."""
    items = [(k, "s", "en", " ".join(f"q{k}x{j}" for j in range(50)), None) for k in range(4000)]
    schema = "item_id long, suite string, language string, text string, answer string"
    rows = [(k, " ".join(f"q{k}x{j}" for j in range(10, 40)), "s", "a", "en", "train", 0.5, None) for k in range(0, 4000, 40)]
    for most_sent in (leakage.MOST_SENT, 0):
        got = {tuple(r) for r in leakage.leaks(docs(spark, rows), spark.createDataFrame(items, schema), most_sent=most_sent).select("doc_id", "item_id").collect()}
        assert got == {(k, k) for k in range(0, 4000, 40)}


def test_short_items_are_found_if_asked_for(spark):
    items = spark.createDataFrame([(1, "s", "en", " ".join(f"w{j}" for j in range(14)), None)], "item_id long, suite string, language string, text string, answer string")
    d = docs(spark, [(1, "x y " + " ".join(f"w{j}" for j in range(14)) + " z", "s", "a", "en", "train", 0.5, None)])
    assert leakage.leaks(d, items).count() == 0 and leakage.leaks(d, items, passage_words=14, own_words=14).count() == 1


# --- 8 mixing


MIX = {"big": (0.5, 1), "mid": (0.3, 2), "small": (0.2, 4), "absent": (0.2, 4)}
MIX_SCHEMA = "source string, target_share double, max_repeats int"


@pytest.mark.parametrize("total", [None, 3000, 10**9])
def test_shares_and_repeats(spark, total):
    rng = random.Random(9)
    rows = [(i, "x" * rng.randint(5, 60), s, "a", "en", "train", rng.random(), None) for i, s in enumerate(["big"] * 900 + ["mid"] * 420 + ["small"] * 30)]
    rows += [(5000, "x" * 2000, "mid", "a", "en", "train", 0.9, None), (5001, None, "big", "a", "en", "train", 0.9, None), (5002, "x", "big", "a", "en", "eval", 0.9, None), (5003, "", "big", "a", "en", "train", 0.9, None)]
    targets = spark.createDataFrame([(s, *v) for s, v in MIX.items()], MIX_SCHEMA)
    mixed = mixing.mix(docs(spark, rows), targets, total, tokenizer=None)
    pdf = mixed.uses.toPandas()
    assert len(pdf) == 1352 and set(pdf.source) == {"big", "mid", "small"}
    assert (pdf.uses <= pdf.source.map({s: m for s, (_, m) in MIX.items()})).all() and pdf[pdf.doc_id == 5003].uses.iloc[0] == 0
    size = pdf.tokens.groupby(pdf.source).sum()
    used = (pdf.tokens * pdf.uses).groupby(pdf.source).sum()
    aim = sum(size) if total is None else min(total, sum(MIX[s][1] * size[s] for s in size.index))
    for s in size.index:
        largest = pdf[pdf.source == s].tokens.max()
        # All that it may, or its share of what the saturated sources leave, within half of its largest document.
        full = MIX[s][1] * size[s]
        open_ = [x for x in size.index if used[x] < MIX[x][1] * size[x] - 1]
        left = aim - sum(MIX[x][1] * size[x] for x in size.index if x not in open_)
        want = full if s not in open_ else MIX[s][0] * left / sum(MIX[x][0] for x in open_)
        assert abs(used[s] - want) <= largest / 2 + 1, s
    assert abs(sum(used) - aim) <= 0.5 * sum(pdf[pdf.source == s].tokens.max() for s in size.index) + 3
    report = mixed.report().toPandas().set_index("source")
    assert report.loc["absent"].given == 0 and report.as_owed.all() and dict(report.given.drop("absent")) == dict(used)
    assert report.loc["small"].short == pytest.approx(max(0, 0.2 * sum(used) - used["small"]), abs=1e-2)
    again = mixing.mix(docs(spark, rows).repartition(3), targets, total, tokenizer=None).uses.toPandas()
    assert dict(zip(pdf.doc_id, pdf.uses)) == dict(zip(again.doc_id, again.uses))


def test_a_tiny_source_does_not_shrink_the_mixture(spark):
    rows = [(i, "x" * 50, "big" if i else "tiny", "a", "en", "train", 0.5, None) for i in range(1000)]
    targets = spark.createDataFrame([("big", 0.5, 1), ("tiny", 0.5, 3)], MIX_SCHEMA)
    used = mixing.mix(docs(spark, rows), targets, tokenizer=None).uses.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("n")).collect()
    assert {r.source: r.n for r in used} == {"big": 50_000 - 150, "tiny": 150}


def test_tokens_of_a_public_vocabulary_need_no_file_on_the_workers(spark):
    got = {r.doc_id: (r.tokens, r.bytes) for r in mixing.token_counts(docs(spark, [(1, "The report counts visits.", "s", "a", "en", "train", 0.5, None), (2, "", "s", "a", "en", "train", 0.5, None)])).collect()}
    assert got[2] == (0, 0) and got[1][1] == 25 and 3 <= got[1][0] <= 8
    with pytest.raises(FileNotFoundError):
        mixing.token_counts(docs(spark, []), "/nowhere")


def test_better_documents_are_likelier(spark):
    rows = [(i, "x" * 20, "s" if i % 2 else "t", "a", "en", "train", 0.95 if i % 4 < 2 else 0.05, None) for i in range(4000)]
    targets = spark.createDataFrame([("s", 0.2, 1), ("t", 0.8, 1)], MIX_SCHEMA)
    pdf = mixing.mix(docs(spark, rows), targets, 40_000, tokenizer=None).uses.toPandas()
    s = pdf[pdf.source == "s"]
    good, bad = s[s.doc_id % 4 < 2].uses.mean(), s[s.doc_id % 4 >= 2].uses.mean()
    assert good > 1.5 * bad
    # Inclusion odds: 0.9625 and 0.2875 per unit of c, with 400 of 2000 documents' tokens to give.
    assert good == pytest.approx(0.4 * 0.9625 / 1.25, abs=0.05) and bad == pytest.approx(0.4 * 0.2875 / 1.25, abs=0.05)


def test_odds_scale_to_the_need(spark):
    levels = [(100_000, 100), (500_000, 300), (1_000_000, 50)]
    sized = spark.createDataFrame([("s", w, t) for w, t in levels], "source string, w long, tokens long")
    for need in (1, 60, 200, 300, 440, 449):
        c = mixing._odds(sized, {"s": need})["s"]
        assert abs(sum(min(1, c * w / mixing.UNIT) * t for w, t in levels) - need) < 1e-6


# --- 9 toxicity


def test_disguises_are_read():
    got = toxicity.statements("You 1MB3C1L3, c.r.e.t.i.n and s u b h u m a n! vermmmmmin idi*t test_74 42 ТОР")
    flat = [w for s in got for w in s]
    for w in ("imbecile", "cretin", "subhuman", "vermin", "idi*t", "#", "top"):
        assert w in flat
    assert flat.count(toxicity.HIDDEN) == 5


def test_kneser_ney_is_a_distribution_whatever_is_known():
    """Probabilities sum to one, and those of what is known do not change if the rest is only known as sums."""
    rows, size = [[2, 3, 4], [2, 3, 5], [3, 4, 4, 2], [2, 3, 4, 6, 6]], 7
    keys, counts = np.unique(np.concatenate([toxicity.triples(np.array(r), size) for r in rows]), return_counts=True)
    whole = toxicity.counted(keys, counts, size)
    some = keys[::2]
    known = lambda k, n, among: (k[np.isin(k, among)], n[np.isin(k, among)])
    pairs = np.unique(keys // size), np.array([counts[keys // size == x].sum() for x in np.unique(keys // size)])
    bi = np.unique(keys % (size * size), return_counts=True)
    dense = lambda k, n: np.bincount(k, n, minlength=size)
    part = toxicity.KneserNey(size, known(keys, counts, some), known(*pairs, some // size), known(*bi, some % (size * size)), dense(bi[0] // size, bi[1]), dense(bi[0] % size, None))
    for m in (whole, part):
        m.ground(np.full(size, 1 / size))
        for u, v in ((0, 0), (2, 3), (5, 5), (0, 2), (4, 4)):
            assert abs(m.p((u * size + v) * size + np.arange(size)).sum() - 1) < 1e-9
    # By hand: P(4 | 2 3) = (2 - D) / 3 + what is left of the context (2 known followers) * P(4 | 3).
    d = toxicity.DISCOUNT
    low = (max(2 - d, 0) + d * 5 / size) / whole.uni.sum()
    two = (2 - d) / 3 + (1 - ((2 - d) + (1 - d)) / 3) * low
    assert whole.uni[4] == 2 and whole.p(np.array([(2 * size + 3) * size + 4]))[0] == pytest.approx((2 - d) / 3 + (1 - ((2 - d) + (1 - d)) / 3) * two)


def test_stretches_equal_trying_all():
    rng = np.random.default_rng(1)
    encoder = toxicity.Encoder([f"w{i}" for i in range(8)])
    rows = [rng.integers(2, 10, 6) for _ in range(30)]
    make = lambda rs: toxicity.counted(*np.unique(np.concatenate([toxicity.triples(r, encoder.size) for r in rs]), return_counts=True), encoder.size)
    model = toxicity.Toxicity(encoder, make(rows[:15]), make(rows[15:]))
    docs_ = [np.concatenate([np.zeros(0, np.int64), *(np.concatenate(([0, 0], rng.integers(1, 10, rng.integers(1, 9)))) for _ in range(rng.integers(0, 4)))]).astype(np.int64) for _ in range(40)]
    flat = toxicity.Flat(docs_, encoder.size)
    bits, a, b = model.stretches(flat)
    each = model.bits(flat.keys)
    for k, (first, n) in enumerate(zip(flat.first, flat.length)):
        x = each[first : first + n]
        best = max((x[i:j].sum() for i in range(n) for j in range(i + 1, n + 1)), default=0.0)
        assert bits[k] == pytest.approx(max(best, 0.0), abs=1e-6)
        if best > 0:
            assert x[a[k] : b[k]].sum() == pytest.approx(best, abs=1e-6)
    score, words = model.score(docs_)
    for d, s in enumerate(score):
        mine = [k for k in range(len(flat.first)) if flat.owner[flat.at[flat.first[k]]] == d]
        assert s == pytest.approx(max([0.0, *((bits[k] - toxicity.PRIOR) / max(1, b[k] - a[k]) for k in mine)]), abs=1e-6)


def test_counts_are_those_of_all_documents(spark):
    """A telling phrase of few labelled documents, and an ordinary one: scores do not hang on how the table is cut, and every document counts."""
    rng = random.Random(16)
    plain = lambda: " ".join(rng.choice("the bridge market river counts keeps old new report visits".split()) for _ in range(9)) + "."
    bad = "Get lost you utter zorgle nobody wants you here."
    rows = [(i, plain() + " " + (bad if i % 10 == 0 else plain()), "s", "a", "en", "train", 0.5, None) for i in range(400)]
    labels = spark.createDataFrame([(i, "r", int(i % 10 == 0), None) for i in range(0, 400, 1) if i % 20 in (0, 3, 7)], "doc_id long, reviewer string, abusive int, labelled_at timestamp")
    got = toxicity.scores(docs(spark, rows), labels).toPandas().set_index("doc_id")
    assert (got.flagged == (got.index % 10 == 0)).all() and got[got.flagged].statement.str.contains("zorgle").all()
    again = toxicity.scores(docs(spark, rows[::-1]).repartition(7), labels).toPandas().set_index("doc_id")
    assert np.allclose(got.score, again.loc[got.index].score)
    # The same words in a corpus where everybody says them tell nothing.
    common = [(1000 + i, plain() + " " + bad, "s", "a", "en", "train", 0.5, None) for i in range(4000)]
    assert not toxicity.scores(docs(spark, rows + common), labels).where("flagged").count()


def test_copies_do_not_crowd_labelled_texts_out(spark):
    """However often the others are copied and labelled, every different text is learnt from; equal texts pool their opinions."""
    rows = [(i, f"text {i % 30}", "s", "a", "en", "train", 0.5, None) for i in range(3000)] + [(5000 + i, f"rare {i}", "s", "a", "en", "train", 0.5, None) for i in range(5)]
    labels = [(r[0], "r", int(r[1].startswith("rare") or (r[0] % 30 < 5 and r[0] % 3 < 2) or (r[0] % 30 >= 25 and r[0] == r[0] % 30)), None) for r in rows]
    d, labels = docs(spark, rows), spark.createDataFrame(labels, "doc_id long, reviewer string, abusive int, labelled_at timestamp")
    pos, neg = toxicity.labelled_texts(d, labels, 40)
    alike = {f"text {k}" for k in range(5) if k % 3 < 2}
    assert sorted(pos) == sorted({f"rare {i}" for i in range(5)} | alike)
    assert sorted(neg) == sorted({f"text {k}" for k in range(30)} - alike)


def test_toxicity_held_out(spark):
    """Trained on two thirds of the labels of the larger table; documents of the last third are told apart."""
    d = "/root/testdata/sf0.1"
    docs_, labels = table(spark, d, "documents"), table(spark, d, "review_labels")
    votes = labels.where("abusive is not null").groupBy("doc_id").agg(F.avg("abusive").alias("v"))
    held = votes.where("doc_id % 3 = 0")
    model, encoded = toxicity.train(docs_, labels.join(held, "doc_id", "left_anti"))
    got = toxicity.scored(encoded.join(held.select("doc_id"), "doc_id"), model).join(held, "doc_id").toPandas()
    pos, neg = got[got.v > 0.5], got[got.v <= 0.5]
    assert neg.flagged.mean() < 0.05 and pos.flagged.mean() > 0.3


def test_fold_is_stable_and_composed():
    for t in ("Ａｂｃ", "café", "नमस्ते", "a b", "ﬁx"):
        assert unicodedata.is_normalized("NFC", textfold.fold_looks(t))
        assert textfold.fold_words(" ".join(textfold.fold_words(t))) == textfold.fold_words(t)
