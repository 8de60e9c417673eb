"""Rule files, fallback counters and resampling against plain versions."""

import pytest
from pyspark.sql import functions as F

from colloquy.functions import variation
from colloquy.functions.expressions import Rules, Unknown
from colloquy.operators import conversation as C
from colloquy.operators import rules as R
from colloquy.sources import readers

LOGS = "file_name string, interaction array<struct<role:string,text:string>>, chatbot_phrases array<string>, user_phrases array<string>, data_output map<string,string>, judged map<string,string>, price string, lang string, steps int"


@pytest.fixture(scope="module")
def logs(spark):
    def row(name, turns, data, judged, price, lang):
        said = lambda who: [t for r, t in turns if r == who]
        return (name, turns, said("assistant"), said("user"), data, judged, price, lang, len(turns))

    return spark.createDataFrame(
        [
            row("a.yml", [("user", "hi"), ("assistant", "It costs 12.50 euros."), ("user", "ok"), ("assistant", "It costs 12.50 euros.")], {"size": "L", "drink": None}, {"only_talks_about('pizza')": "True", "language(price)": "ENG", "utterance_index('user', 'price')": "3"}, "12.5 EUR", "en"),
            row("b.yml", [("user", "hi there"), ("assistant", "Total: $7 for you")], {"size": "M", "drink": "water"}, {"only_talks_about('pizza')": "['cars']"}, "7", "en"),
            row("c.yml", [], {}, None, None, "de"),
        ],
        LOGS,
    )


CASES = {
    "extract_float(chatbot_phrases[0]) == 12.5": [True, False, False],
    "extract_float(chatbot_phrases[0]) > 10": [True, False, None],
    "currency(price) == 'EUR' or lang == 'de'": [True, False, True],
    "length(chatbot_phrases, 'max')": [21, 17, 0],
    "length(user_phrases)": [2, 8, 100_000_000],
    "length(user_phrases, 'average')": [2.0, 8.0, 0.0],
    "length(user_phrases[0], kind='max')": [2, 8, None],
    "conversation_length()": [4, 2, 0],
    "conversation_length('user') + 2 * conversation_length(who='assistant') - 1": [5, 2, -1],
    "chatbot_returns('costs')": [[1, 3], [], []],
    "chatbot_returns('Total', 'for')": [[], [], []],
    "len(chatbot_returns('costs', 'dollars')) // 2": [1, 0, 0],
    "repeated_answers()": [["It costs 12.50 euros."], [], []],
    "repeated_answers('jaccard', 0.5)": [["It costs 12.50 euros."], [], []],
    "not repeated_answers()": [False, True, True],
    "data_collected()": [False, True, True],
    "missing_slots()": [["drink"], [], []],
    "'drink' in missing_slots()": [True, False, False],
    "data_output['size'] in ['L', 'XL']": [True, False, False],
    "only_talks_about('pizza')": [True, False, None],
    "language(price) == 'ENG'": [True, False, False],
    "utterance_index('user', 'price') >= 3": [True, None, None],
    "price is None": [False, False, True],
    "price is not None and len(price) < 4": [False, True, False],
    "'EUR' in price": [True, False, None],
    "1 < steps <= 4": [True, True, False],
    "-steps % 3 if lang == 'en' else steps": [2, 1, 0],
    "user_phrases[-1]": ["ok", "hi there", None],
    "conv[0].lang + '!'": ["en!", "en!", "de!"],
    "steps / 0": [None, None, None],
}


@pytest.mark.parametrize("source", CASES)
def test_expressions(logs, source):
    known = Rules(logs)
    value = known._value(known._parse(source))
    assert [r.v for r in logs.select("file_name", value.alias("v")).orderBy("file_name").collect()] == CASES[source]


@pytest.mark.parametrize("source", ["__import__('os')", "open('x')", "[x for x in y]", "lambda: 1", "steps ** 2", "conv[1].lang", "is_unique('lang')", "f'{steps}'", "1 +", "length(price, 'sum')", "repeated_answers('tf-idf')"])
def test_what_rules_do_not_have(logs, source):
    with pytest.raises(Unknown):
        known = Rules(logs)
        known._value(known._parse(source))


FILES = {
    "b.yaml": "name: costs\ndescription: 'it''s a price'  # quoted\nwhen: lang == 'en'\nif: conversation_length() > 2\noracle: extract_float(chatbot_phrases[0]) > 10\nyields: price\n",
    "sub/a.yml": "# a comment\nname: pairs\nconversations: 2\nwhen: conv[0].lang == conv[1].lang\nthen: >\n  conv[0].steps\n  < conv[1].steps\n",
    "c.yml": 'name: all\nconversations: all\nif: "lang == \'en\'"\nthen: is_unique(\'price\') and num_exist("steps > 2") == 1\n',
    "d.yml": "name: off\nactive: false\nthen: nonsense(\n",
    "e.yml": "name: topic\nthen: only_talks_about('pizza')\n",
    "f.yml": "name: value\nthen: length(chatbot_phrases, 'max')\nyields: currency(price)\n",
    "notes.txt": "name: not a rule",
}


def test_rule_files(spark, logs, tmp_path):
    for name, text in FILES.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    rules = readers.rules(spark, str(tmp_path))
    assert [r.name for r in rules] == ["costs", "all", "off", "topic", "value", "pairs"]
    assert rules[0].description == "it's a price" and not rules[2].active
    got = {r.rule: tuple(r)[1:] for r in R.file_rule_statistics(logs, rules).collect()}
    assert got == {
        "costs": (3, 1, 0, 2, "0.00%"),
        "topic": (3, 1, 1, 1, "50.00%"),
        "value": (3, 0, 3, 0, "100.00%"),
        "all": (2, 1, 0, 1, "0.00%"),
        "pairs": (6, 1, 1, 4, "50.00%"),
    }
    messages = {(r.file_name, r.rule): r.message for r in R.rule_outcomes(logs, [r for r in rules if r.conversations == 1 and r.active]).collect()}
    assert messages["a.yml", "value"] == "EUR" and messages["b.yml", "costs"] is None
    assert R.file_rule_statistics(logs, []).count() == 0
    none = {r.rule: (r.checks, r.passed, r.failed) for r in R.file_rule_statistics(logs.limit(0), rules).collect()}
    assert none["pairs"] == (0, 0, 0) and "costs" not in none


def test_pairs_need_something_equal(logs):
    with pytest.raises(ValueError, match="equal"):
        R.pair_statistics(logs, R.FileRule("p", "conv[0].steps < conv[1].steps", conversations=2))


def test_pairs_of_equal_rows_and_maps(logs):
    many = logs.unionByName(logs).unionByName(logs)
    rows = many.collect()
    for then in ("conv[0].steps == conv[1].steps", "len(conv[0].data_output) == len(conv[1].data_output)"):
        r = R.pair_statistics(many, R.FileRule("p", then, when="conv[0].lang == conv[1].lang", conversations=2)).first()
        pairs = [(a, b) for i, a in enumerate(rows) for j, b in enumerate(rows) if i != j]
        judged = [(a, b) for a, b in pairs if a.lang == b.lang]
        same = sum(a.steps == b.steps if "steps" in then else len(a.data_output) == len(b.data_output) for a, b in judged)
        assert (r.passed, r.failed, r.na) == (same, len(judged) - same, len(pairs) - len(judged))


def test_fallback_counters(spark):
    turns = {1: "fffxffffffffffff", 2: "xxfxf", 3: "", 4: "ffffffffffx"}
    rows = [(c, i, x == "f") for c, said in turns.items() for i, x in enumerate(said)] + [(5, 0, None)]
    got = {(r.conv_id, r.turn_idx): (r.repeat_count, r.loop_count, r.action) for r in C.fallback_counters(spark.createDataFrame(rows, "conv_id long, turn_idx int, failed boolean"), F.col("failed")).collect()}
    want = {(5, 0): (0, 0, "none")}
    for c, said in turns.items():
        repeat = loop = 0
        for i, x in enumerate(said):
            action = "none"
            if x == "f":
                repeat, loop, action = repeat + 1, loop + 1, "rephrase"
                if repeat >= 3:
                    repeat, action = 0, "change_topic"
            else:
                repeat = loop = 0
            want[c, i] = (repeat, loop, action)
            if loop >= 9:
                break
    assert got == want


def test_resampled(spark):
    rows = [(i, [i % 3, i % 4, i % 5, 0], [[i % 3], list(range(4)), list(range(i % 5 + 1)), []]) for i in range(400)] + [(1000, [2], [[2]]), (1001, [0, 1], [[0], [1, 0]]), (1002, [], [])]
    df = spark.createDataFrame(rows, "id long, now array<int>, allowed array<array<int>>")
    got = df.select("*", variation.resampled(F.col("now"), F.col("allowed"), F.col("id").cast("string")).alias("new")).collect()
    seen = set()
    for r in got:
        assert len(r.new) == len(r.now) and all(n in a or (not a and n == o) for n, a, o in zip(r.new, r.allowed, r.now))
        assert r.new != r.now or all(set(a) <= {o} for a, o in zip(r.allowed, r.now))
        seen.add(tuple(r.new))
    assert len(seen) > 50
