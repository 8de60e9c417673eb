"""Queries around the search for failing tests."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colloquy.functions import features
from colloquy.operators import search as S

from .conversation import PAIRS, pairs
from .metrics import r6, ratings
from .history import tests
from colloquy.operators import agreement as A


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def constrained_fields(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    return S.constrained(rows, "o_orderstatus", ["o_orderpriority", "o_totalprice"], {"F": ["o_orderpriority"], "P": []})


def uncovered_pairs(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_size", "p_brand")
    return S.uncovered_pairs(rows, "p_size", "p_brand")


def tournament(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumn("rank", F.col("p_size") % 5)
    return S.tournament(rows, "p_brand", "p_partkey", "rank", "p_retailprice")


def next_intents(spark, sf_dir):
    order = Window.partitionBy("conv_id").orderBy("turn_idx")
    so_far = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = pairs(spark, sf_dir).withColumn("before", F.lag("intent").over(order))
    rows = rows.withColumn("repeats", F.count_if(F.col("intent") == "followup").over(so_far)).withColumn("confirmed", F.coalesce(F.max(F.col("intent") == "failure").over(so_far), F.lit(False)))
    return rows.select("conv_id", "turn_idx", S.allowed_intents(rows).alias("next"))


def conversation_similarity(spark, sf_dir):
    """Conversations 2k and 2k + 1 turn by turn: share of equal intents and of equal length."""
    rows = pairs(spark, sf_dir).withColumn("pair", F.floor(F.col("conv_id") / 2))
    left, right = (rows.filter(F.col("conv_id") % 2 == i).select("pair", "turn_idx", F.coalesce("intent", F.lit("none")).alias(f"i{i}")) for i in (0, 1))
    both = left.join(right, ["pair", "turn_idx"], "full").groupBy("pair").agg(F.count("i0").alias("n0"), F.count("i1").alias("n1"), F.count_if(F.col("i0") == F.col("i1")).alias("same"))
    shared = F.least("n0", "n1")
    return r6(both.select("pair", F.when(shared == 0, 0.0).otherwise(0.7 * F.col("same") / shared + 0.3 * shared / F.greatest("n0", "n1")).alias("similarity")), "similarity")


def replayed_state(spark, sf_dir):
    return r6(S.replayed_state(tests(spark, sf_dir), "user_id", ["ts", "event_id"], "event_type", "value", "signup", "click").select("event_id", "state"), "state")


def best_outputs(spark, sf_dir):
    """For each order the line of the highest keyed score, the first of equals."""
    rows = table(spark, sf_dir, "lineitem").withColumn("score", features.keyed_uniform(F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")))
    return rows.groupBy("l_orderkey").agg(F.max_by(F.struct("l_partkey", "l_suppkey"), F.struct("score", -F.col("l_partkey"), -F.col("l_suppkey"))).alias("b")).select("l_orderkey", "b.*")


def date_steps(spark, sf_dir):
    """For each order: its date, five dates at even steps of 30 days, and seconds of a time text."""
    rows = table(spark, sf_dir, "orders")
    day = F.to_date("o_orderdate")
    dates = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.date_format(F.date_add(day, i * 30), "yyyy-MM-dd")), ",")
    text = F.format_string("%02d:%02d:%02d", (F.col("o_orderkey") % 24).cast("int"), (F.col("o_orderkey") % 60).cast("int"), (F.col("o_orderkey") % 7).cast("int"))
    parts = F.split(text, ":")
    seconds = parts[0].cast("int") * 3600 + parts[1].cast("int") * 60 + parts[2].cast("int")
    return rows.select("o_orderkey", dates.alias("dates"), seconds.alias("seconds"))


def judge_ranking(spark, sf_dir):
    """Accuracy and macro F1 of each rater against the majority, ranked, with accuracy a unit of cost (rater + 1)."""
    rows = ratings(spark, sf_dir)
    truth = A.majority(rows).select("item", F.col("label").alias("expected"))
    both = rows.join(truth, "item").groupBy("rater").agg(F.avg((F.col("label") == F.col("expected")).cast("double")).alias("accuracy"), F.count("*").alias("n"))
    return r6(both.withColumn("value", F.col("accuracy") / (F.col("rater") + 1)).withColumn("rank", F.rank().over(Window.orderBy(F.desc("accuracy")))), "accuracy", "value")


def tf_idf_pairs(spark, sf_dir):
    """TF-IDF cosine of each benchmark item and the one before it, with idf over the two texts."""
    rows = table(spark, sf_dir, "benchmark").withColumn("b", F.lag("text").over(Window.partitionBy(F.col("item_id") % 4).orderBy("item_id"))).filter("b is not null")
    side = lambda c, i: rows.select("item_id", F.lit(i).alias("side"), F.explode(F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9_]{2,}"), F.lit(0))).alias("w"))
    n = side("text", 0).unionByName(side("b", 1)).groupBy("item_id", "w").agg(F.count_if(F.col("side") == 0).alias("x"), F.count_if(F.col("side") == 1).alias("y"))
    idf = F.ln(F.lit(3.0) / (1 + (F.col("x") > 0).cast("int") + (F.col("y") > 0).cast("int"))) + 1
    n = n.withColumn("p", F.col("x") * idf).withColumn("q", F.col("y") * idf)
    return r6(n.groupBy("item_id").agg((F.sum(F.col("p") * F.col("q")) / F.sqrt(F.sum(F.col("p") * F.col("p")) * F.sum(F.col("q") * F.col("q")))).alias("cosine")), "cosine")


def fitted_weights(spark, sf_dir):
    """Share of failing tests and mean score by decile of a logistic score, with the best bound's F1 on all rows."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select((F.length("text") / 1000.0).alias("size"), (F.col("n_chars") % 10).cast("double").alias("noise"), "quality")
    return S.best_threshold(S.logistic_weights(rows, ["size", "noise"], "quality").withColumn("score", F.round("score", 3)), "score", "quality")


def vector_clusters(spark, sf_dir):
    rows = S.clusters(table(spark, sf_dir, "embeddings"), "embedding", range(4, 7))
    return rows.groupBy("cluster").agg(F.count("*").alias("n"), F.count_distinct("label").alias("labels"))


def critical_regions(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_quantity", "l_discount", (F.col("l_returnflag") == "R").alias("failed"))
    return S.critical_regions(rows, ["l_quantity", "l_discount"], "failed")


QUERIES = {f.__name__: f for f in (constrained_fields, uncovered_pairs, tournament, next_intents, conversation_similarity, replayed_state, best_outputs, date_steps, judge_ranking, tf_idf_pairs, fitted_weights, vector_clusters, critical_regions)}

R = "WITH l AS (SELECT doc_id AS item, CAST(quality + toxic AS INTEGER) AS label FROM labels), r AS (SELECT item, 0 AS rater, label FROM l UNION ALL SELECT item, 1, CASE WHEN item % 7 = 0 THEN (label + 1) % 3 ELSE label END FROM l UNION ALL SELECT item, 2, CASE WHEN item % 5 = 0 THEN (label + 2) % 3 ELSE label END FROM l), c AS (SELECT item, label, count(*) AS n FROM r GROUP BY ALL), m AS (SELECT item, arg_max(label, n * 10 - label) AS e FROM c GROUP BY item)\n"
SQL = {
    "constrained_fields": "SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS o_orderpriority, CASE WHEN o_orderstatus NOT IN ('F', 'P') THEN o_totalprice END AS o_totalprice FROM orders",
    "uncovered_pairs": "WITH p AS (SELECT p_size, p_brand FROM part) SELECT * FROM (SELECT DISTINCT p_size FROM p), (SELECT DISTINCT p_brand FROM p) EXCEPT SELECT * FROM p",
    "tournament": "WITH o AS (SELECT *, floor((row_number() OVER (PARTITION BY p_brand ORDER BY ('0x' || substr(md5('t:' || p_partkey), 1, 8))::UBIGINT, p_partkey) - 1) / 2) AS m FROM part) SELECT p_brand, CAST(m AS BIGINT) AS match, first(p_partkey ORDER BY p_size % 5, p_retailprice DESC, p_partkey) AS winner FROM o GROUP BY p_brand, m",
    "next_intents": PAIRS
    + ", s AS (SELECT *, lag(intent) OVER w AS before, count_if(intent = 'followup') OVER b AS repeats, coalesce(max(CAST(intent = 'failure' AS INTEGER)) OVER b, 0) = 1 AS confirmed FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn_idx), b AS (PARTITION BY conv_id ORDER BY turn_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT conv_id, turn_idx, CASE WHEN turn_idx = 0 THEN 'start' WHEN intent = 'stop' THEN 'none' WHEN confirmed THEN 'stop' WHEN repeats >= 2 THEN 'stop' WHEN intent = before THEN 'other' WHEN intent IS NULL THEN 'repeat' ELSE 'any' END AS next FROM s",
    "conversation_similarity": PAIRS
    + ", q AS (SELECT CAST(floor(conv_id / 2) AS BIGINT) AS pair, conv_id % 2 AS h, turn_idx, coalesce(intent, 'none') AS i FROM t), j AS (SELECT coalesce(a.pair, b.pair) AS pair, a.i AS x, b.i AS y FROM (SELECT * FROM q WHERE h = 0) a FULL JOIN (SELECT * FROM q WHERE h = 1) b ON a.pair = b.pair AND a.turn_idx = b.turn_idx), n AS (SELECT pair, count(x) AS a, count(y) AS b, count_if(x = y) AS s FROM j GROUP BY pair) SELECT pair, round(CASE WHEN least(a, b) = 0 THEN 0 ELSE 0.7 * s / least(a, b) + 0.3 * least(a, b) / greatest(a, b) END, 6) AS similarity FROM n",
    "replayed_state": "WITH s AS (SELECT *, count_if(event_type = 'signup') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM events) SELECT event_id, round(sum(CASE WHEN event_type IN ('signup', 'click') THEN value ELSE 0 END) OVER (PARTITION BY user_id, g ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS state FROM s",
    "best_outputs": "SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY ('0x' || substr(md5(l_partkey || ':' || l_suppkey), 1, 8))::UBIGINT DESC, l_partkey, l_suppkey) = 1",
    "date_steps": "SELECT o_orderkey, array_to_string(list_transform(range(5), lambda i: strftime(CAST(o_orderdate AS DATE) + CAST(i * 30 AS INTEGER), '%Y-%m-%d')), ',') AS dates, CAST(o_orderkey % 24 * 3600 + o_orderkey % 60 * 60 + o_orderkey % 7 AS INTEGER) AS seconds FROM orders",
    "judge_ranking": R + ", s AS (SELECT rater, avg(CAST(label = e AS INTEGER)) AS accuracy, count(*) AS n FROM r JOIN m USING (item) GROUP BY rater) SELECT rater, round(accuracy, 6) AS accuracy, n, round(accuracy / (rater + 1), 6) AS value, CAST(rank() OVER (ORDER BY accuracy DESC) AS INTEGER) AS rank FROM s",
    "tf_idf_pairs": "WITH l AS (SELECT item_id, text AS a, lag(text) OVER (PARTITION BY item_id % 4 ORDER BY item_id) AS b FROM benchmark), w AS (SELECT item_id, 0 AS s, unnest(regexp_extract_all(lower(a), '[a-z0-9_]{2,}')) AS w FROM l WHERE b IS NOT NULL UNION ALL SELECT item_id, 1, unnest(regexp_extract_all(lower(b), '[a-z0-9_]{2,}')) FROM l WHERE b IS NOT NULL), n AS (SELECT item_id, w, count_if(s = 0) AS x, count_if(s = 1) AS y FROM w GROUP BY ALL), v AS (SELECT *, ln(3.0 / (1 + CAST(x > 0 AS INTEGER) + CAST(y > 0 AS INTEGER))) + 1 AS i FROM n) SELECT item_id, round(sum(x * i * y * i) / sqrt(sum(x * i * x * i) * sum(y * i * y * i)), 6) AS cosine FROM v GROUP BY item_id",
}
