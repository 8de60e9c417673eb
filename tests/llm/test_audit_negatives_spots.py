"""Filter audit, hard negatives and fingerprints against plain versions."""

import hashlib
import math
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import filteraudit, negatives, spots

TEXT = "The quick fox of old towns is in a red house and by that of a river it runs for 3 miles. "


def flags_of(rows, labels):
    """(part, failed filters, good, toxic) of each row, by plain rules."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    out = []
    for i, text, lang in rows:
        text = text or ""
        words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
        fails = set()
        fails |= {"A"} if len(words) < 100 else set()
        fails |= {"B"} if 100 * len(set(words)) < 80 * len(words) else set()
        fails |= {"C"} if 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text) else set()
        fails |= {"D"} if set(text) & set("#$%&*|") else set()
        fails |= {"E"} if i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows) else set()
        out.append((lang or "", fails, i in good, i in toxic))
    return out


def audit(flags):
    out = {}
    for part in {f[0] for f in flags}:
        own = [f for f in flags if f[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, c in enumerate(order, 1):
                gone = [f for f in left if c in f[1]]
                late = sum(c in f[1] and bool(f[1] & set(order[: step - 1])) for f in own)
                left = [f for f in left if c not in f[1]]
                shapley[c] += len(gone)
                out[part, order, step] = [len(left), len(gone), late, sum(f[1] == {c} for f in own), sum(f[2] for f in gone), sum(f[3] for f in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def test_filter_audit_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(120))
    rows = [
        (1, long, "en"), (2, long, "de"), (2, long, "de"), (2, long, "fr"), (3, None, "en"), (4, "", None), (5, "A B C", ""), (6, "x " * 150, "en"), (7, "a|b " * 30, "de"),
        (None, long, "en"), (None, None, "en"), (8, "ÄÖ é\u3000x", "en"), (9, "$" + long, "en"), (1, "other", "en"), (-5, long, None),
        (10, "AB\t\n\x0b\x0ccd " * 60, "en"), (11, "big " + " ".join(f"W{i}" for i in range(300_000)), "fr"),
    ]
    labels = [(1, 1, 0), (1, 0, 1), (2, 1, 1), (5, 0, 1), (6, None, None), (None, 1, 1), (99, 1, 1)]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, lang string, part int")
    table = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, lang string")
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in filteraudit.filter_audit(filteraudit.document_flags(docs, table)).collect()}
    want = audit(flags_of(rows, labels))
    assert got == want and len(got) == 600 * len({r[2] or "" for r in rows})
    assert filteraudit.filter_audit(filteraudit.document_flags(docs.limit(0), table)).count() == 0
    none = filteraudit.filter_audit(filteraudit.document_flags(docs, table.limit(0)))
    assert none.agg(F.sum("good_lost"), F.sum("removed")).first()[0] == 0


@pytest.mark.parametrize("letters", ["A", "AB", "ABCD"])
def test_intervals_cover_each_order_once(letters):
    orders = ["".join(p) for p in permutations(letters)]
    at = {(mask, rank): [] for mask in range(1, 1 << len(letters)) for rank in range(len(orders))}
    for mask, step, first, lo, hi in filteraudit.mask_intervals(letters):
        for rank in range(lo, hi):
            at[mask, rank].append((step, first))
    for (mask, rank), steps in at.items():
        hit = [s for s, c in enumerate(orders[rank], 1) if mask >> letters.index(c) & 1]
        assert sorted(steps) == [(s, s == hit[0]) for s in hit]


def mined(rows, positives=5, negatives_=10):
    whole = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, label, v in {(i, label, tuple(v)) for i, label, v in whole if i % 100 == 0}:
        scored = [(-dot(v, w), j, k) for j, k, w in whole if j != i]
        for p, pid, _ in sorted(x for x in scored if x[2] == label)[:positives]:
            band = sorted((s, j) for s, j, k in scored if k != label and 30 * -p <= 100 * -s <= 90 * -p)[:negatives_]
            out += [(i, pid, r + 1, j, -p, -s) for r, (s, j) in enumerate(band)]
    return sorted(out)


@pytest.mark.parametrize("width", [1, 3, 40])
def test_hard_negatives_ties_nulls_and_repeats(spark, monkeypatch, width):
    rng = np.random.default_rng(width)
    rows = [(i, int(rng.integers(0, 3)) if i % 5 else 0, [float(x) for x in rng.integers(-2, 6, width) / 4]) for i in range(450)]
    rows += [(1000 + i, 1, rows[3][2]) for i in range(30)] + [(1100, 1, rows[3][2])] * 2 + [(1200, 2, rows[3][2])] * 3 + [(1300, 77, rows[3][2]), (-100, 0, rows[4][2])]
    bad = [(None, 1, [1.0] * width), (1400, None, [1.0] * width), (1401, 1, None), (1500, 1, [None] * width), (1600, 1, [float("nan")] * width), (1700, 1, [float("inf")] * width)]
    df = spark.createDataFrame([(i, v, label, "x") for i, label, v in rows + bad], "vec_id long, embedding array<float>, label int, score string")
    monkeypatch.setattr(negatives, "ROWS", 64)
    monkeypatch.setattr(negatives, "ANCHORS", 3)
    monkeypatch.setattr(negatives, "STEP", 2)
    clean = negatives.labelled(df, moved=10**9)
    got = sorted(tuple(r) for r in negatives.hard_negatives(clean, clean.filter("vec_id % 100 = 0")).collect())
    moved = [(i, (label + 1) % 10 if i % 10**9 == 0 else label, v) for i, label, v in rows]
    assert got == mined(moved)
    assert negatives.hard_negatives(clean.limit(0), clean.limit(0)).count() == 0
    assert negatives.hard_negatives(clean, clean.limit(0)).count() == 0


def test_labels_move_up(spark):
    df = spark.createDataFrame([(0, [0.5], 9), (7, [0.5], 3), (8, [0.5], 3)], "vec_id long, embedding array<float>, label int")
    assert sorted(tuple(r) for r in negatives.labelled(df).select("vec_id", "label").collect()) == [(0, 0), (7, 4), (8, 3)]


def test_bounds_hold_and_rule_out():
    rng = np.random.default_rng(3)
    centers = rng.integers(-900, 900, (8, 1)) + rng.integers(-30, 30, (8, 32))
    v = np.repeat(centers, 100, 0) + rng.integers(-9, 10, (800, 32))
    block = negatives.Block(np.arange(800), np.zeros(800, np.int64), v)
    scores = v @ v.T
    for (mean, dev) in block.levels:
        middle, reach = mean.astype(float) @ mean.T.astype(float), dev.astype(float) @ dev.T.astype(float)
        assert (np.abs(scores - middle) <= reach + 1e-6 * np.abs(scores).max()).all()
    high = np.full(800, negatives.NO_ID)
    low = np.sort(scores, 1)[:, -5]
    a, r, s = negatives.wanted_pairs(block, slice(0, 800), block, np.ones((800, 800), bool), low, high)
    assert sorted(zip(a.tolist(), r.tolist())) == sorted(zip(*(x.tolist() for x in np.nonzero(scores >= low[:, None]))))
    assert (s == scores[a, r]).all()
    mean, dev = block.levels[0]
    ruled = (mean @ mean.T + dev @ dev.T < low[:, None] - 1).mean()
    assert ruled > 0.5


def test_huge_components(spark):
    df = spark.createDataFrame([(0, [1e30, 0.0], 1), (1, [1e30, 1.0], 1), (2, [0.3, 1.0], 2), (3, [5.0, 1.0], 1)], "vec_id long, embedding array<float>, label int")
    clean = negatives.labelled(df, moved=10**9)
    assert negatives.hard_negatives(clean, clean.filter("vec_id = 3")).count() >= 0


def plain_spots(text):
    words = __import__("regex").findall(r"[\p{L}\p{N}]+", text.lower())
    anchors = set(spots.ANCHORS)
    content = [i for i, w in enumerate(words) if w not in anchors]
    found = set()
    for i, w in enumerate(words):
        if w in anchors:
            after = [j for j in content if j > i][:2]
            if len(after) == 2 and after[0] - i <= 4 and after[1] - after[0] <= 4:
                found.add(f"#{w} {words[after[0]]} {words[after[1]]}")
    if not found:
        found = {f" {' '.join(words)} "} if words else {text} if text else set()
    return sorted(hashlib.md5(x.encode()).hexdigest()[:16] for x in found)


def jaccard(a, b):
    return 1.0 if a == b else len(set(a) & set(b)) / len(set(a) | set(b))


def test_fingerprints_of_odd_texts(spark):
    rng = np.random.default_rng(8)
    words = TEXT.split() + ["ÄÖÜ", "straße", "l'eau", "\U0001f600", "#x", "niño", "the", "of"]
    texts = [" ".join(words[i] for i in rng.integers(0, len(words), int(rng.integers(0, 60)))) for _ in range(120)]
    texts += [None, "", " ", "the the the the", "...", "one", "the of in to a fox ran", "the of in to a of fox ran", "\U0001f600" * 9, "é" * 7, "the " * 50_000 + "end", (TEXT * 20_000)]
    rows = [(3 * i - 50, t) for i, t in enumerate(texts)] + [(None, "null id of a fox town")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, value string, part int")
    got = {r.doc_id: r for r in spots.document_fingerprints(docs).collect()}
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: -r[0]) + [rows[-1]]
    assert len(got) == len(rows)
    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[i]
        assert (r.n_chars, r.edited) == (len(text), edited), i
        if len(text) < 100_000:
            assert r.spots == plain_spots(text) and r.edited_spots == plain_spots(edited), text
        assert r.near_edited == pytest.approx(jaccard(r.spots, r.edited_spots)) and r.near_next == pytest.approx(jaccard(r.spots, got[order[(k + 1) % len(order)][0]].spots))


def test_next_of_few_and_repeated_rows(spark):
    one = spark.createDataFrame([(5, "a fox of old towns")], "doc_id long, text string")
    row = spots.document_fingerprints(one).first()
    assert row.near_next == 1.0 and row.edited == "a fox of " + "a fox of "
    assert spots.document_fingerprints(one.limit(0)).count() == 0
    same = spark.createDataFrame([(5, TEXT)] * 40 + [(None, TEXT)] * 40 + [(4, "")], "doc_id long, text string")
    rows = spots.document_fingerprints(same).collect()
    assert len(rows) == 81 and len({tuple(r.spots) for r in rows if r.n_chars}) == 1


def test_pruned_likeness(spark):
    sets = [["a"], ["a", "b"], ["a", "b", "c", "d"], ["a", "b", "c", "d", "e"], ["x", "y"], [], [str(i) for i in range(40)], [str(i) for i in range(33)]]
    df = spark.createDataFrame([(a, b) for a in sets for b in sets], "a array<string>, b array<string>").select(F.array_sort("a").alias("a"), F.array_sort("b").alias("b"))
    for r in df.select("a", "b", spots.likeness(F.col("a"), F.col("b")).alias("all"), spots.likeness(F.col("a"), F.col("b"), 0.8).alias("near")).collect():
        want = jaccard(r.a, r.b)
        assert r["all"] == pytest.approx(want) and r.near == pytest.approx(want if want >= 0.8 else 0.0)
