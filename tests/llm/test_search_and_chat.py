import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import chat, queries, topk, urlrules

from duck import assert_same

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, DATA), queries.SQL[name], DATA)


def best(rows, k):
    out = []
    for q in {tuple([i, *v]) for i, v in rows if i % 50 == 0}:
        qid, qv = q[0], q[1:]
        scored = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in rows if i != qid)
        out += [(qid, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_top_k_ties_nulls_and_repeats(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 6) / 4]) for i in range(300)]
    rows += [(900 + i, rows[3][1]) for i in range(40)] + [(950, rows[3][1])] * 2 + [(1000, rows[3][1])] * 3
    bad = [(None, [1.0] * 6), (1050, None), (1051, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1052, [float("nan")] * 6), (1053, [float("inf")] + [0.0] * 5)]
    df = spark.createDataFrame([(*r, "x") for r in rows + bad], "vec_id long, embedding array<float>, rank string")
    monkeypatch.setattr(topk, "TREE", 64)
    clean = topk.quantised(df)
    got = sorted(tuple(r) for r in topk.top_k(clean, clean.filter("vec_id % 50 = 0")).collect())
    whole = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows]
    assert got == best(whole, 5)
    few = clean.filter("vec_id < 3")
    assert topk.top_k(few, few.filter("vec_id % 50 = 0")).count() == 2
    assert topk.top_k(clean.limit(0), clean.limit(0)).count() == 0


def test_tree_skips_far_pages():
    rng = np.random.default_rng(5)
    centers = rng.integers(-2000, 2000, (16, 8))
    v = np.repeat(centers, 600, 0) + rng.integers(-9, 10, (9600, 8))
    tree = topk.MTree(np.arange(9600), v)
    q = v[::480] + 1
    scores, ids, taken = tree.search(np.full(len(q), -1), q, np.full(len(q), topk.LEAST), 5)
    s = q @ v.T
    want = np.lexsort((np.broadcast_to(np.arange(9600), s.shape), -s))[:, :5]
    assert (ids == want).all() and (scores == np.take_along_axis(s, want, 1)).all()
    assert taken < 0.8 * len(q) * len(v)


def test_huge_components_are_exact():
    a = np.array([[2**40, 3], [1, 1]])
    assert topk.products(a, a)[1].tolist() == [2**40 + 3, 2]


def test_chat_collapse(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (3, 0, "user", "a"), (3, 1, "assistant", "b"), (3, 1, "assistant", "b"), (4, 5, "user", "a"), (4, 6, "assistant", "b"), (4, 7, None, None), (None, 0, "user", "<|im_end|>"), (5, None, "user", "q")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, pos int")
    got = {(r.conv_id, r.part): r for r in chat.format_chats(df).collect()}
    assert set(got) == {(4, 0), (None, 0), (5, 0)}
    assert got[4, 0].n_turns == 3 and got[4, 0].rendered.endswith("<|im_start|>\n<|im_end|>\n")
    assert got[None, 0].rendered == "<|im_start|>user\n< |im_end|><|im_end|>\n"
    assert chat.format_chats(df.limit(0)).count() == 0


def test_chat_long_conversation_in_parts(spark):
    df = spark.range(10).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    df = df.unionByName(df.filter("turn < 7").withColumn("conv_id", F.lit(2).cast("long")))
    rows = chat.format_chats(df, segment=4).orderBy("part").collect()
    assert [r.conv_id for r in rows] == [1, 1, 1]
    assert "".join(r.rendered for r in rows) == "".join(f"<|im_start|>user\n{i}<|im_end|>\n" for i in range(10))


def judged(url, rules):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:cut].translate(str.maketrans(urlrules.UPPER, urlrules.LOWER)), rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fit = [(len(h + p), h.count("."), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[2:] if fit else (None, "allow")))


def test_url_rules_against_all_rules(spark):
    rng = np.random.default_rng(6)
    hosts = ["org", "example.org", "a.example.org", "b.a.example.org", "com", "x.com", "notexample.org", "ORG"]
    paths = ["", "/", "/a", "/ab", "/ab/c", "/ab/c?x=/", "/b#/ab", "/é", "?q", "#f"]
    urls = [f"http://{hosts[i]}{paths[j]}" for i, j in zip(rng.integers(0, 8, 300), rng.integers(0, 10, 300), strict=True)] + [None, "", "no scheme/x", "http://", "a://b://c.org/ab"]
    rules = [("org", "/", "allow"), ("org", "/ab", "block"), ("example.org", "/a", "block"), ("example.org", "/ab/c", "allow"), ("a.example.org", "", "block"), ("com", "/b", "block")]
    pages = spark.createDataFrame([(i % 50, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    table = spark.createDataFrame([*rules, rules[0], (None, "/", "block")], "host string, path string, verdict string")
    got = sorted((tuple(r) for r in urlrules.url_filter(pages, table, salts=3).collect()), key=str)
    assert got == sorted(((i % 50, *judged(u, rules)) for i, u in enumerate(urls)), key=str)
    assert urlrules.url_filter(pages.limit(0), table).count() == 0
    assert urlrules.url_filter(pages, table.limit(0)).filter("rule is null and verdict = 'allow'").count() == len(urls)
