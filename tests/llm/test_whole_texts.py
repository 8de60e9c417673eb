"""Cases that a cap on draws or on windows would get wrong."""

import numpy as np
import pytest

from colloquy.llm import pieces, pii

MANY = 20000


def test_each_occurrence_draws_for_itself():
    m = pieces.load(pieces.MODEL)
    # one candidate merge: its rate over documents, and over places of one document, is the dropout
    assert len(pieces.encode_texts(["x"], np.array([1]), m, 0.0)[0]) == 1
    for texts, keys in ((["x"] * MANY, np.arange(MANY)), ([" ".join(["x"] * MANY)], np.array([5]))):
        ids, _ = pieces.encode_texts(texts, keys, m, 0.1)
        assert len(ids) / MANY - 1 == pytest.approx(0.1, abs=0.01)
    ids, bounds = pieces.encode_texts(["internationalization"] * 2000, np.arange(2000), m, 0.1)
    assert len({tuple(ids[a:b].tolist()) for a, b in zip(bounds, bounds[1:])}) > 16


def test_draws_are_the_same_in_any_slices(monkeypatch):
    m = pieces.load(pieces.MODEL)
    texts = ["some words of a text ▁ with é☃ " * 20, None, "", "a" * 300 + " b"]
    want = [x.tolist() for x in pieces.encode_texts(texts, np.arange(4), m, 0.3)]
    monkeypatch.setattr(pieces, "SLICE", 7)
    assert [x.tolist() for x in pieces.encode_texts(texts, np.arange(4), m, 0.3)] == want
    alone = [pieces.encode_texts([t], np.array([i]), m, 0.3)[0].tolist() for i, t in enumerate(texts)]
    assert sum(alone, []) == want[0]


def numbers(n):
    """Single digits apart from each other, of which none is an entity by itself."""
    return " ".join("7" for _ in range(n))


@pytest.fixture(scope="module")
def weights():
    """A field that takes what starts with a plus sign and has 9 to 11 digits, and nothing else."""
    w = np.full((len(pii.KINDS), pii.N_FEATURES), 0.0)
    w[:, 0] = -50
    w[pii.KINDS.index("phone"), [0, 4, 18]] = -25, 20, 20  # 9 to 11 digits, a plus sign first
    return w


@pytest.mark.parametrize("before", [*range(380, 404), 790, 797, 4000])
def test_spans_over_any_place_of_long_windows_are_whole(weights, before):
    number = "+49 30 1234567"
    text = f"{numbers(before)} {number} {numbers(30)}"
    a = text.index("+")
    found = pii.field_spans(text, {k: [] for k in pii.KINDS}, weights)
    assert found == [(a, a + len(number), "phone")]


@pytest.mark.parametrize("gap", range(40, 140, 7))
def test_no_candidate_crosses_windows(gap):
    """All candidates of the text's tokens, without windows, are candidates of some window."""
    text = f"no 1 {'word ' * 40}"[:gap] + " some.long.name.of.some.one@mail.example.org " + "a 1 " * 900 + " b@c.de  " + "4 a " * 10
    tokens = [t.span() for t in pii.TOKEN.finditer(text)]
    every = {(tokens[i][0], tokens[j - 1][1]) for i, j in pii.candidates(text, tokens, [])}
    assert {(w[i][0], w[j - 1][1]) for w in pii.windows(text) for i, j in pii.candidates(text, w, [])} == every


def test_taken_spans_of_any_order_are_kept_clear():
    text = "12 34 56 78 90"
    tokens = [t.span() for t in pii.TOKEN.finditer(text)]
    for taken in ([], [(0, 8), (3, 5)], [(3, 5), (9, 11)], [(2, 3)]):
        free = [not any(a < y and x < b for x, y in taken) for a, b in tokens]
        want = {(i, j) for i in range(5) for j in range(i + 1, 6) if all(free[i:j])}
        assert set(pii.candidates(text, tokens, taken)) == want


OUTSIDE = {
    "phone": ["(269) 555-3296", "269-555-3296", "0049 89 1234567", "269.555.3296", "06 12 34 56 78", "030/1234567"],
    "card": ["4111.1111.1111.1111", "3782.822463.10005", "4111/1111/1111/1111"],
    "ip": ["10[.]1[.]2[.]3", "192(.)168(.)0(.)1", "10 dot 1 dot 2 dot 3"],
    "email": ["joe.p at x.org", "jane.doe (at) mail.example.com", "jane [at] example [dot] org", "a_b @ host.net"],
}
NONE = ["2021-03-04", "10:30", "version 3.", "CC BY-NC 4.0.", "1,234,567", "$12.50", "1998-2004", "4111111111111112", "look at home. Then", "at 3.5 or so", "p. 123-456", 'token = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"', "Room 555", "10 000 000", "999.400.500.300"]
AROUND = [("", ""), ("this is ", " of the thing"), ("The word. ", ". And so on"), ("ha, ", ", the\n"), ("x\n", "\nrest of it")]


@pytest.fixture(scope="module")
def fitted(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return pii.fit_pii(rows)


def test_field_finds_what_the_patterns_do_not(fitted):
    found = total = 0
    for kind, spans in OUTSIDE.items():
        for span in spans:
            for before, after in AROUND:
                text = before + span + after
                base = pii.base_spans(text)
                want = (len(before), len(before) + len(span))
                assert want not in base[kind]
                total += 1
                found += (*want, kind) in pii.field_spans(text, base, fitted)
    assert found >= 0.95 * total


def test_field_finds_base_formats_alone(fitted):
    for kind, span in (("email", "a.b@x.example"), ("ip", "10.1.2.3"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (269) 555-3296")):
        for before, after in AROUND:
            assert pii.field_spans(before + span + after, {k: [] for k in pii.KINDS}, fitted) == [(len(before), len(before) + len(span), kind)]


def test_field_leaves_other_numbers_alone(fitted):
    for text in NONE:
        for before, after in AROUND:
            assert pii.field_spans(before + text + after, {k: [] for k in pii.KINDS}, fitted) == [], text


def test_field_on_invented_sentences(fitted):
    random = np.random.Generator(np.random.PCG64(1))
    found = total = wrong = 0
    for text, gold in pii.sentences(["and so the words of a text go on here"], random, 1000):
        spans = {(a, b): pii.KINDS.index(k) for a, b, k in pii.field_spans(text, {k: [] for k in pii.KINDS}, fitted)}
        total += len(gold)
        found += sum(spans.get(s) == k for s, k in gold.items())
        wrong += sum(not any(a < y and x < b for x, y in gold) for a, b in spans)
    assert found >= 0.92 * total and wrong <= 0.02 * total
