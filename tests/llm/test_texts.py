import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from colloquy.llm import decontam, neardup, pieces, pii, quality, substrings, tokencount

import brute

SCHEMA = "doc_id long, text string, n_words int, spans string, label int, node string, ids string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "s", 2, "n", "i") for i, t in rows], SCHEMA)


def sample(spark, n=60):
    return [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(n).collect()]


EDGES = [(None, None), (7, ""), (7, ""), (8, "  hello  world \n x<s>é☃ 漢字"), (9, "▁a ▁"), (10, "a" * 3000), (11, "<|endoftext|>x<|endoftext|>"), (12, "\x00\x85\u2028 z"), (13, "'s ''re  \n\n")]


def test_pieces_equal_library_without_dropout(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))
    rows = [r for r in sample(spark) + EDGES if "▁" not in (r[1] or "")]
    got = pieces.encode(docs(spark, rows).coalesce(1), dropout=0.0).collect()
    assert [list(r.ids) for r in got] == [sp.encode(t or "") for _, t in rows]


@pytest.mark.parametrize("dropout", [0.1, 0.7, 1.0])
def test_pieces_round_trip(spark, dropout):
    rows = sample(spark) + EDGES
    encoded = pieces.round_trip(docs(spark, rows).coalesce(1), dropout, seed=3)
    assert encoded.filter("not lossless or n_ids <> size(ids)").count() == 0
    assert [r.text for r in pieces.decode(encoded).collect()] == [t or "" for _, t in rows]


def test_pieces_vary_by_place_and_repeat_by_seed(spark):
    m = pieces.load(pieces.MODEL)
    texts = ["international " * 200]
    a, _ = pieces.encode_texts(texts, np.array([1]), m, 0.3, seed=1)
    b, _ = pieces.encode_texts(texts, np.array([1]), m, 0.3, seed=1)
    c, _ = pieces.encode_texts(texts, np.array([1]), m, 0.3, seed=2)
    assert a.tolist() == b.tolist() != c.tolist()
    assert pieces.encode(docs(spark, []), 0.1).count() == 0


def test_arrays_and_heap_agree(monkeypatch):
    m = pieces.load(pieces.MODEL)
    units = ["▁" + "".join(random.Random(i).choices("abcdeé", k=i % 20 + 1)) for i in range(400)]
    a = pieces.segment(units, np.arange(400) % 16, m, 0.3, 5)
    monkeypatch.setattr(pieces, "LONG", 0)
    b = pieces.segment(units, np.arange(400) % 16, m, 0.3, 5)
    assert all((x == y).all() for x, y in zip(a, b, strict=True))


def test_token_counts_equal_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = sample(spark) + EDGES
    got = tokencount.token_counts(docs(spark, rows).repartition(3), buckets=5).collect()
    want = [(i, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False)), n > 512) for i, x in rows]
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
    assert tokencount.token_counts(docs(spark, [])).count() == 0


def test_decontamination(spark):
    base = [f"w{i}" for i in range(40)]
    bench = spark.createDataFrame([(1, " ".join(base[:20]), 0), (2, "Short ITEM", 0), (2, "short item", 0), (3, None, 0), (4, "...", 0), (None, "nobody", 0)], "item_id long, text string, n_hit int")
    rows = [(1, "x " + ", ".join(base[2:17]).upper() + " y"), (1, " ".join(base[2:14])), (2, "a short item, a SHORT-item"), (3, None), (4, ""), (5, "nobody " + "z " * 30), (6, " ".join(base[:20] + ["q"] * 2000))]
    for blocks, passes in ((1 << 20, 1 << 26), (40, 1 << 26), (40, 80), (3, 3)):
        found = decontam.benchmark_hits(docs(spark, rows).repartition(2), bench, block_bytes=blocks, pass_bytes=passes)
        got = {(r.doc_id, r.n_words): r for r in found.collect()}
        assert {k: (r.n_hit, r["items"], r.contaminated) for k, r in got.items()} == {
            (1, 17): (15, ["1"], True), (1, 12): (0, [], False), (2, 6): (4, ["2"], True), (3, 0): (0, [], False), (4, 0): (0, [], False), (5, 31): (1, [], False), (6, 2020): (20, ["1"], False),
        }
        text = rows[0][1].encode()
        assert [text[s.start : s.end].decode() for s in got[1, 17].spans] == [", ".join(base[2:17]).upper()]
        assert len(got[2, 6].spans) == 2
    assert decontam.benchmark_hits(docs(spark, rows), bench.limit(0)).filter("n_hit > 0").count() == 0
    assert decontam.benchmark_hits(docs(spark, []), bench).count() == 0


def test_no_text_is_shuffled_for_many_blocks(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    one, many = (decontam.benchmark_hits(table, bench, block_bytes=b) for b in (1 << 20, 500))
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (one, many)]
    assert all(p.count("MapInArrow") == 1 and "Exchange" not in p for p in plans)
    columns = ["doc_id", "n_words", "n_hit", "items", "spans", "contaminated"]
    assert sorted(map(str, one.select(columns).collect())) == sorted(map(str, many.select(columns).collect()))


def test_suffix_order_and_search():
    rng = np.random.default_rng(3)
    text = np.append(rng.integers(0, 3, 500), 0)
    text[100:150] = text[300:350]
    zeros = np.cumsum(text == 0) - 1
    key = np.where(text == 0, zeros, text + zeros[-1] + 1).tolist()
    assert decontam.suffix_order(text).tolist() == sorted(range(len(text)), key=lambda i: key[i:])
    index = decontam.FMIndex(text, 3)
    rows = np.array([[1, 2, 1], [0, 2, 2], [1, 1, 1]])
    which, lo, hi = index.search(rows, np.array([3, 2, 3]))
    for p, a, b in zip(which.tolist(), lo.tolist(), hi.tolist(), strict=True):
        pattern = [x for x in rows[p].tolist() if x]
        want = [i for i in range(len(text)) if text[i : i + len(pattern)].tolist() == pattern]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_crf_matches_enumeration():
    rng = np.random.default_rng(1)
    good, move = rng.normal(size=5), rng.normal(size=(2, 2))
    share, joint = quality.forward_backward(good, np.array([0, 4, 5]), move, pairs=True)
    total, mass, pairs = 0.0, np.zeros(4), np.zeros((2, 2))
    for code in range(16):
        y = [code >> i & 1 for i in range(4)]
        p = np.exp(sum(good[i] * y[i] for i in range(4)) + sum(move[y[i], y[i + 1]] for i in range(3)))
        total += p
        mass += p * np.array(y)
        for i in range(3):
            pairs[y[i], y[i + 1]] += p
    assert np.allclose(share[:4], mass / total) and np.allclose(share[4], 1 / (1 + np.exp(-good[4]))) and np.allclose(joint, pairs / total)


def test_quality_on_held_out(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    scored = quality.op5_quality_classifier(spark, d).join(labels, "doc_id").filter("held_out").toPandas()
    assert (scored.predicted == scored.quality).mean() > 0.97
    assert scored[scored.quality == 1].predicted.mean() > 0.98


def test_quality_edges(spark):
    rows = docs(spark, [*EDGES, (20, "\n\n"), (21, "x\n" * 5000)])
    for labels in (spark.createDataFrame([(8, 1), (10, 0), (None, 1), (9, None)], "doc_id long, quality int"), spark.createDataFrame([], "doc_id long, quality int")):
        got = quality.score_quality(rows, quality.fit_quality(rows, labels)).collect()
        assert len(got) == len(EDGES) + 2 and all(0 <= r.score <= 1 for r in got)
    assert all(r.score == 0.5 for r in got)
    assert quality.score_quality(docs(spark, []), quality.fit(np.zeros((0, 91)), np.zeros(1, int), np.zeros(0, int))).count() == 0


def test_lines_are_features_of_their_document():
    a, size_a, _ = quality.line_features(*raw(["one | two\n\nTHREE!!", "x x x y"]))
    b, size_b, bounds = quality.line_features(*raw(["x x x y"]))
    assert size_a.tolist() == [9, 0, 7, 7] and np.allclose(a[3], b[0]) and bounds.tolist() == [0, 1]


def raw(texts):
    data = [t.encode() for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"v{i}" for i in range(50)]
    rows = []
    for g in range(12):
        text = rng.choices(vocabulary, k=rng.choice([3, 8, 40, 120]))
        for _ in range(6):
            rows.append((len(rows), " ".join(text)))
            text = list(text)
            text[rng.randrange(len(text))] = rng.choice(vocabulary)
    rows += [(len(rows) + i, t) for i, t in enumerate(["", "", "!!", "!!!", "a b", "b a", "A, b.", "x" * 5000])]
    got = neardup.near_duplicates(docs(spark, rows).repartition(3)).collect()
    want = brute.classes(rows)
    want[len(rows) - 7] = len(rows) - 8
    assert {r.doc_id: r.class_id for r in got} == want
    assert sum(r.kept for r in got) == len(set(want.values()))
    plain = neardup.near_duplicates(docs(spark, rows).repartition(3), weights="distinct").collect()
    assert len({r.class_id for r in plain}) == len(set(brute.classes(rows, weighted=False).values()))
    again = neardup.near_duplicates(docs(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (None, None)])).collect()
    assert sorted((str(r.class_id), r.class_size, r.kept) for r in again) == [("1", 2, False), ("1", 2, True), ("None", 1, True)]
    assert neardup.near_duplicates(docs(spark, [])).count() == 0


def test_weights_tell_repeated_lines_apart(spark):
    """Equal sets of shingles, unlike numbers of them."""
    line = "one two three four five six seven "
    rows = [(i, line * n + "and that is the end of it") for i, n in enumerate([3, 3, 30, 31, 200, 300])]
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs(spark, rows)).collect()}
    assert got == brute.classes(rows) == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 5}
    assert {r.class_id for r in neardup.near_duplicates(docs(spark, rows[2:]), weights="distinct").collect()} == {2}
    assert len(neardup.occurrences(np.array([5, 9], np.uint64), np.array([3, 1]))) == 4


@pytest.mark.parametrize("small", [0, 100])
def test_one_row_of_each_class_stays(spark, monkeypatch, small):
    from colloquy.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 3)
    monkeypatch.setattr(common, "HOT_KEYS", 5)
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(i, text) for i in range(9)] + [(i, f"{text} z{i}") for i in range(20, 32)] + [(40, "alone"), (40, "alone"), (None, None), (None, ""), (None, None), (41, "")]
    table = docs(spark, rows)
    left = neardup.leave_one(table, neardup.near_duplicates(table), small)
    assert left.columns == table.columns
    assert sorted((str(r.doc_id), r.text) for r in left.collect()) == [("0", text), ("40", "alone"), ("41", "")]
    empty = docs(spark, [])
    assert neardup.leave_one(empty, neardup.near_duplicates(empty), small).count() == 0


def test_open_buckets_lose_no_link(spark, monkeypatch):
    """A chain: neighbours are similar, the ends aren't; with few members a chunk the pairs are split."""
    monkeypatch.setattr(neardup, "MEMBERS", 2)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([*(f"n{j}" for j in range(15 * i)), *base[15 * i :]])) for i in range(8)]
    got = neardup.near_duplicates(docs(spark, rows)).collect()
    assert {r.doc_id: r.class_id for r in got} == brute.classes(rows)


@pytest.mark.parametrize(("shared", "a", "b"), [(800, 1.0, 1.0), (500, 1.0, 3.0), (900, 2.0, 2.5)])
def test_darts_estimate_weighted_jaccard(shared, a, b):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    y = np.concatenate((x[:shared], rng.integers(0, 2**63, 1000 - shared, dtype=np.uint64)))
    weights = np.concatenate((np.full(1000, a), np.full(1000, b)))
    equal = [np.equal(*neardup.signatures(np.repeat([0, 1], 1000), np.concatenate((x, y)), weights, 2, seed=s)).mean() for s in range(20)]
    true = shared * min(a, b) / (1000 * a + 1000 * b - shared * min(a, b))
    assert abs(np.mean(equal) - true) < 0.05


def test_base_spans_equal_patterns():
    rng = random.Random(1)
    texts = ["".join(rng.choices("12 .@+-a4()b", k=60)) for _ in range(3000)]
    texts += ["a@b.c@d.e", "x" * 5000 + "@", "1" * 5000, "1.2.3.4.5.6.7.8", "0300.1.1.1 256.1.1.1", "+1 (269) 555-3296 4524132264652876", "é a@b.de 4111 1111 1111 1111"]
    for t in texts:
        assert pii.base_spans(t) == brute.personal(t)


def test_segments_match_enumeration():
    rng = np.random.default_rng(2)
    ranges = [(i, j) for i in range(5) for j in range(i + 1, min(i + 3, 5) + 1)]
    scores = rng.normal(size=(len(ranges), 2))

    def every(at):
        if at == 5:
            yield []
            return
        for rest in every(at + 1):
            yield rest
        for c, (i, j) in enumerate(ranges):
            if i == at:
                for k in range(2):
                    for rest in every(j):
                        yield [(c, k), *rest]

    found = [(sum(scores[c, k] for c, k in s), s) for s in every(0)]
    value, best = max(found, key=lambda x: x[0])
    assert pii.best_segments(5, ranges, scores) == [(*ranges[c], k) for c, k in best]
    mass = np.zeros_like(scores)
    for v, s in found:
        for c, k in s:
            mass[c, k] += np.exp(v)
    assert np.allclose(pii.expected(5, ranges, scores), mass / sum(np.exp(v) for v, _ in found))


def test_pii_query_rows_and_mask(spark):
    rows = [(1, "mail a.b@x.example.com or +1 (456) 555-2186, card 4111 1111 1111 1111 at 10.1.2.3"), (None, None), (2, ""), (2, "no data"), (3, "é1")]
    table = docs(spark, rows * 3)
    weights = pii.fit_pii(table)
    got = pii.find_pii(table.coalesce(1), weights).collect()
    assert len(got) == 15
    for r, (_, text) in zip(got, rows * 3, strict=True):
        want = brute.personal(text)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(want[k]) for k in pii.KINDS] and r.base == pii.written(want)
        assert set(r.base.split(",")) <= set(r.spans.split(","))
    masked = {r.doc_id: r.text for r in pii.mask_pii(table, weights).filter("doc_id = 1").collect()}
    assert masked[1].startswith("mail <EMAIL> or <PHONE>, card <CARD> at <IP>")
    assert pii.find_pii(docs(spark, []), weights).count() == 0


def test_field_recovers_base_spans_alone(spark):
    texts = [t for _, t in sample(spark, 200) if t]
    weights = pii.fit_field(texts)
    found = total = 0
    for t in texts:
        want = {(a, b, k) for k, spans in pii.base_spans(t).items() for a, b in spans}
        found += len(want & set(pii.field_spans(t, {k: [] for k in pii.KINDS}, weights)))
        total += len(want)
    assert total and found >= 0.8 * total


@pytest.mark.parametrize("size", [400, 30, 9])
def test_repeats_equal_brute_force(spark, size):
    rng = random.Random(3)
    base = ["".join(rng.choices(["ab", "cde", "é", "xyz", "q"], k=300)) for _ in range(6)]
    texts = [*base, *[base[0]] * 3, base[1][:200] + base[2][100:300] + base[1][150:], "", None, "x" * 900, base[3][:299], base[4][7:] + "z", "x" * 399]
    got = substrings.remove_repeats(docs(spark, list(enumerate(texts))).repartition(4), size).orderBy("doc_id").collect()
    assert [tuple(r)[1:5] for r in got] == brute.repeats(texts, size)
    assert all(hashlib.sha256(r.text.encode()).hexdigest() == r.kept_sha256 for r in got if r.text.isascii() and (r.n_spans == 0 or texts[r.doc_id].isascii()))
    assert substrings.remove_repeats(docs(spark, []), size).count() == 0


def test_repeats_are_judged_by_bytes_not_words(spark):
    """A passage of over 50 words that two documents share stays at 399 bytes and goes at 400; one document's own repeat goes, too."""
    rng = random.Random(4)
    own = lambda: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(100))
    passages = [" ".join("".join(rng.choices("klmnop", k=k)) for k in [5] * 60 + [last])[-size:] for last, size in ((39, 399), (40, 400))]
    assert all(len(p.split()) > 50 for p in passages)
    texts = [f"{own()}<{p}>{own()}" if i % 2 else f"{own()}[{p}]{own()}" for p in passages for i in range(2)]
    texts.append(f"{own()}({passages[1][::-1]}){own()}{{{passages[1][::-1]}}}")
    got = substrings.remove_repeats(docs(spark, list(enumerate(texts)))).orderBy("doc_id").collect()
    assert [r.n_removed for r in got] == [0, 0, 400, 400, 800]
    assert [tuple(r)[1:5] for r in got] == brute.repeats(texts, 400)


def test_difference_cover_covers():
    for length in (400, 100, 30, 9):
        v, cover = substrings.difference_cover(length)
        assert v < length and {(a - b) % v for a in cover for b in cover} == set(range(v))


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    d = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{d}/documents.parquet")
    good = p.quality_filter(spark, rows, d)
    kept = p.near_dedup(spark, good, d)
    clean = p.decontaminate(spark, kept, d)
    masked = p.mask_personal_data(spark, clean, d)
    assert good.columns == kept.columns == clean.columns == masked.columns == rows.columns
    texts = {r.doc_id: r.text for r in good.collect()}
    of = brute.classes(sorted(texts.items()))
    assert {r.doc_id for r in kept.collect()} == set(of.values())
    bench = [brute.words(r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + 13]) for w in bench for i in range(max(1, len(w) - 12)) if w}

    def contaminated(text):
        w = brute.words(text)
        hit = {j for i in range(len(w)) for n in {len(x) for x in windows} if tuple(w[i : i + n]) in windows for j in range(i, i + n)}
        return bool(hit) and 20 * len(hit) >= len(w)

    assert {r.doc_id for r in clean.collect()} == {i for i in set(of.values()) if not contaminated(texts[i])}
    assert all("@" not in r.text or not any(brute.personal(r.text).values()) for r in masked.collect())
    out = p.run(spark, d)
    assert out.count() == clean.count() and out.filter("not lossless").count() == 0


def odd_documents(spark):
    """Nulls, empty and very long texts, repeated rows and ids, and columns that clash with the operators' own."""
    long = " ".join(f"word{i} +1 (269) 555-{i % 9000 + 1000}" for i in range(60_000))
    rows = [(None, None), (None, None), (1, None), (2, ""), (2, ""), (3, "one text that is here twice, word for word and more"), (3, "one text that is here twice, word for word and more"), (3, "another text of the same id, quite unlike the first one"), (4, long), (5, "x" * 5_000_000), (6, "a@b.example and 10.1.2.3")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, node string, row string, turn int, of string"
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "s", "n", "r", 1, "o") for i, t in rows], schema), rows


def test_pipeline_on_odd_documents(spark):
    import corpus_pipeline as p

    d = "/root/testdata/sf0.001"
    table, rows = odd_documents(spark)
    for _, stage in p.STAGES[:-1]:
        assert stage(spark, table, d).columns == p.COLUMNS
        assert stage(spark, table.limit(0), d).count() == 0
    kept = p.near_dedup(spark, table, d).collect()
    assert sorted((str(r.doc_id), len(r.text or "")) for r in kept) == sorted([("1", 0), ("3", 51), ("3", 55), ("4", len(rows[8][1])), ("5", 5_000_000), ("6", 24)]) or sorted((str(r.doc_id), len(r.text or "")) for r in kept) == sorted([("2", 0), ("3", 51), ("3", 55), ("4", len(rows[8][1])), ("5", 5_000_000), ("6", 24)])
    assert p.decontaminate(spark, table, d).count() == len(rows)
    masked = p.mask_personal_data(spark, table, d).collect()
    assert len(masked) == len(rows) and all(r.n_chars == (None if r.text is None else len(r.text)) for r in masked)
    assert [r.text for r in masked if r.doc_id == 6] == ["<EMAIL> and <IP>"] and "555-" not in next(r.text for r in masked if r.doc_id == 4)
    out = p.encode(spark, table, d).select("doc_id", "lossless").collect()
    assert len(out) == len(rows) and all(r.lossless for r in out)
    assert p.encode(spark, table.limit(0), d).count() == 0


def test_quality_rows_of_odd_ids(spark):
    table, rows = odd_documents(spark)
    labels = spark.createDataFrame([(3, 1), (6, 0), (4, 0)], "doc_id long, quality int")
    scored = quality.score_quality(table, quality.fit_quality(table, labels))
    assert scored.columns.count("score") == 1 and scored.count() == len(rows)
    flags = spark.createDataFrame([(None,), (1,)], "doc_id long").select(quality.held_out(F.col("doc_id"))).collect()
    assert flags[0][0] is True and flags[1][0] is not None


def test_long_texts_through_every_operator(spark):
    table, rows = odd_documents(spark)
    got = {(r.doc_id, r.n_words): r for r in decontam.benchmark_hits(table, spark.createDataFrame([(1, " ".join(f"word{i} 1 269 555 {i % 9000 + 1000}" for i in range(100, 110)))], "item_id long, text string")).collect()}
    assert len([r for r in got.values() if r.n_hit]) == 1
    counts = tokencount.token_counts(table).collect()
    assert len(counts) == len(rows)
    repeats = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans) for r in substrings.remove_repeats(table).collect())
    assert ("5", 5_000_000, 5_000_000, 1) in repeats and len(repeats) == len(rows)
