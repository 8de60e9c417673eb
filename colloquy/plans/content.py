"""Queries on content: features, points of interest, scores, texts and keyed samples."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colloquy.functions import features, text
from colloquy.operators import poi, scoring

from .metrics import r6

LINE = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
STYLES = ["formal", "casual", "slang", "rude"]
WANTS = [
    (1, ("STEEL", None, None, None, None, None, None, None)),
    (2, (None, "$$", 3.0, None, None, None, None, "09:30")),
    (3, (None, None, None, True, 48.0, 11.0, 40.0, None)),
    (4, ("nothing like it", None, None, None, None, None, None, None)),
]
WANT = "want_id int, want struct<category:string,price_level:string,rating:double,parking:boolean,lat:double,lng:double,radius_km:double,now:string>"


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points_of_interest(spark, sf_dir):
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        key.alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("category"), poi.price_level(F.col("p_retailprice"), (1000.0, 1300.0, 1600.0)).alias("price_level"),
        (F.col("p_size") / 10).alias("rating"), (F.lit(48.0) + (key % 100) / 100).alias("lat"), (F.lit(11.0) + (key % 37) / 50).alias("lng"), (key % 3 == 0).alias("parking"),
        F.format_string("%02d:00", (key % 12).cast("int")).alias("opens"), F.format_string("%02d:30", (key % 12 + 9).cast("int")).alias("closes"),
    )


def poi_filter(spark, sf_dir):
    wants = spark.createDataFrame(WANTS, WANT)
    return poi.existence(points_of_interest(spark, sf_dir), wants)


def decoded_features(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    styles = F.array(*map(F.lit, STYLES))
    return rows.select(
        "l_orderkey", "l_linenumber", features.ordinal_label(styles, F.col("l_discount") * 10).alias("style"), features.category_label(styles, F.col("l_linenumber") - 2).alias("kind"),
        features.label_index(styles, F.lit("slang")).alias("slang_index"), features.label_index(styles, F.lit("other")).alias("unknown_index"),
    )


def feature_maps(spark, sf_dir):
    """Named values of each order line against those of the one before: what changed, as text."""
    rows = table(spark, sf_dir, "lineitem")
    now = features.named_values(F.array(F.lit("flag"), F.lit("status"), F.lit("tax")), F.array("l_returnflag", "l_linestatus", F.round("l_tax", 2).cast("string")))
    rows = rows.select("l_orderkey", *LINE, now.alias("now"))
    rows = rows.withColumn("before", F.lag("now").over(Window.partitionBy("l_orderkey").orderBy(*LINE))).filter("before is not null")
    changed = F.array_sort(F.map_keys(features.map_changes(F.col("before"), F.col("now"))))
    return rows.select("l_orderkey", "l_linenumber", F.array_join(changed, ",").alias("changed"))


def threshold_oracles(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    a, b = scoring.threshold(F.col("l_discount"), "<", 0.05), scoring.threshold(F.col("l_tax"), ">=", 0.04)
    return rows.groupBy("l_returnflag").agg(F.count_if(a).alias("n_a"), F.count_if(b).alias("n_b"), F.count_if(scoring.merged([a, b])).alias("n_any"), F.count_if(scoring.merged([a, b], "all")).alias("n_all"))


def dimension_scores(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumns({"clarity": F.col("l_linenumber") % 3, "request": (F.col("l_orderkey") % 3)})
    score = scoring.weighted_share({"clarity": 0.5, "request": 0.5}, 2)
    return r6(rows.groupBy("l_linestatus").agg(F.avg(score).alias("score"), F.avg(scoring.logit_share(F.col("l_discount"), F.col("l_tax"))).alias("yes")), "score", "yes")


def content_match(spark, sf_dir):
    """Weighted field match of each order's lines with its first line; missing tax isn't scored."""
    first = F.first(F.struct("l_returnflag", "l_linestatus", "tax")).over(Window.partitionBy("l_orderkey").orderBy(*LINE))
    rows = table(spark, sf_dir, "lineitem").withColumn("tax", F.when(F.col("l_tax") > 0, F.round(F.col("l_tax") * 100).cast("int"))).withColumn("want", first)
    score = scoring.field_match(F.col("want"), F.struct("l_returnflag", "l_linestatus", "tax"), {"l_returnflag": 0.5, "l_linestatus": 0.2, "tax": 0.3})
    return rows.select("l_orderkey", "l_linenumber", F.round(score, 6).alias("score"))


def document_words(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.word_count(F.col("text")).alias("n_words"), F.length(text.normalised(F.col("text"))).alias("n_plain"))


def document_numbers(spark, sf_dir):
    """The first number and the currency of each document, nulls where there is none."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.first_float(F.col("text")).alias("number"), text.currency(F.col("text")).alias("currency"))


def perturbed_items(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    kinds = F.explode(F.array(*map(F.lit, ("leet", "delete_words", "none")))).alias("kind")
    return items.select("item_id", "text", kinds).select("item_id", "kind", text.perturbed(F.col("text"), F.col("kind"), F.col("item_id")).alias("text"))


def item_similarity(spark, sf_dir):
    """Word-set similarity of each benchmark item to the one before it."""
    rows = table(spark, sf_dir, "benchmark").withColumn("b", F.lag("text").over(Window.partitionBy(F.col("item_id") % 4).orderBy("item_id"))).filter("b is not null")
    return r6(rows.select("item_id", text.jaccard(F.col("text"), F.col("b")).alias("jaccard")), "jaccard")


def item_sequence_ratio(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").withColumn("b", F.lag("text").over(Window.partitionBy(F.col("item_id") % 4).orderBy("item_id"))).filter("b is not null")
    return r6(rows.select("item_id", text.sequence_ratio("text", "b").alias("ratio")), "ratio")


def listed_flags(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_returnflag")).alias("flags"))
    return rows.select("l_orderkey", text.listed(F.col("flags")).alias("flags"), text.filled(F.lit("order {{o}}: {{n}}"), F.create_map(F.lit("o"), F.col("l_orderkey").cast("string"), F.lit("n"), F.size("flags").cast("string"))).alias("phrase"))


def page_fields(spark, sf_dir):
    """Title and heading counts of raw pages."""
    rows = table(spark, sf_dir, "pages")
    return rows.select("page_id", F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("title"), F.size(F.regexp_extract_all("html", F.lit("<p[ >]"), F.lit(0))).alias("n_paragraphs"))


def sampled_features(spark, sf_dir):
    """A keyed weighted choice, an ordinal score inside a label's bin, and a uniform value for each customer."""
    rows = table(spark, sf_dir, "customer")
    u = lambda name: features.keyed_uniform(F.lit(name), F.col("c_custkey").cast("string"))
    styles = F.array(*map(F.lit, STYLES))
    pick = F.when(u("c") < 0.5, "formal").when(u("c") < 0.8, "casual").when(u("c") < 0.9, "slang").otherwise("rude")
    return r6(rows.select("c_custkey", pick.alias("style"), features.label_score(styles, pick, u("o")).alias("score"), (10 + 5 * u("v")).alias("value")), "score", "value")


def crossed_features(spark, sf_dir):
    """Uniform crossover of neighbouring customers' segment and nation, and bounded mutation of the balance."""
    order = Window.partitionBy(F.floor(F.col("c_custkey") / 2)).orderBy("c_custkey")
    rows = table(spark, sf_dir, "customer").withColumn("other", F.coalesce(F.lead(F.struct("c_mktsegment", "c_nationkey")).over(order), F.lag(F.struct("c_mktsegment", "c_nationkey")).over(order), F.struct("c_mktsegment", "c_nationkey")))
    u = lambda name: features.keyed_uniform(F.lit(name), F.col("c_custkey").cast("string"))
    return rows.select(
        "c_custkey", F.when(u("s") < 0.5, F.col("other.c_mktsegment")).otherwise(F.col("c_mktsegment")).alias("segment"), F.when(u("n") < 0.5, F.col("other.c_nationkey")).otherwise(F.col("c_nationkey")).alias("nation"),
        F.round(F.least(F.greatest(F.col("c_acctbal") + (u("m") - 0.5) * 100, F.lit(-1000.0)), F.lit(10000.0)), 2).alias("balance"),
    )


QUERIES = {f.__name__: f for f in (poi_filter, decoded_features, feature_maps, threshold_oracles, dimension_scores, content_match, document_words, document_numbers, perturbed_items, item_similarity, item_sequence_ratio, listed_flags, page_fields, sampled_features, crossed_features)}

H = "(('0x' || substr(md5('{}:' || {}), 1, 8))::UBIGINT / 4294967296.0)"
SQL = {
    "poi_filter": """
WITH p AS (SELECT p_partkey AS id, lower(p_type || ' ' || p_name) AS t, CASE WHEN p_retailprice < 1000 THEN '$' WHEN p_retailprice < 1300 THEN '$$' WHEN p_retailprice < 1600 THEN '$$$' ELSE '$$$$' END AS price, p_size / 10 AS rating,
  48 + (p_partkey % 100) / 100 AS lat, 11 + (p_partkey % 37) / 50 AS lng, p_partkey % 3 = 0 AS parking, printf('%02d:00', p_partkey % 12) AS o, printf('%02d:30', p_partkey % 12 + 9) AS c FROM part),
m AS (SELECT 1 AS w, id, rating FROM p WHERE contains(t, 'steel')
  UNION ALL SELECT 2, id, rating FROM p WHERE price = '$$' AND rating >= 3 AND o <= '09:30' AND '09:30' <= c
  UNION ALL SELECT 3, id, rating FROM p WHERE parking AND 2 * 6371.0088 * asin(sqrt(sin(radians(48 - lat) / 2) ** 2 + cos(radians(lat)) * cos(radians(48)) * sin(radians(11 - lng) / 2) ** 2)) <= 40),
k AS (SELECT w, string_agg(id, ',' ORDER BY rating DESC, id) AS ids FROM (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY w ORDER BY rating DESC, id) <= 5) GROUP BY w)
SELECT w.w AS want_id, count(id) AS n, count(id) > 0 AS poi_exists, coalesce(max(ids), '') AS ids FROM (VALUES (1), (2), (3), (4)) w(w) LEFT JOIN m ON m.w = w.w LEFT JOIN k ON k.w = w.w GROUP BY w.w""",
    "decoded_features": "SELECT l_orderkey, l_linenumber, (['formal', 'casual', 'slang', 'rude'])[CAST(least(floor(l_discount * 10 * 4), 3) AS INTEGER) + 1] AS style, CASE WHEN l_linenumber - 2 BETWEEN 0 AND 3 THEN (['formal', 'casual', 'slang', 'rude'])[l_linenumber - 1] END AS kind, 2::BIGINT AS slang_index, NULL::BIGINT AS unknown_index FROM lineitem",
    "feature_maps": "WITH l AS (SELECT *, lag(l_returnflag) OVER w AS f, lag(l_linestatus) OVER w AS s, lag(round(l_tax, 2)) OVER w AS t, row_number() OVER w AS n FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate)) SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN f <> l_returnflag THEN 'flag' END, CASE WHEN s <> l_linestatus THEN 'status' END, CASE WHEN t <> round(l_tax, 2) THEN 'tax' END) AS changed FROM l WHERE n > 1",
    "threshold_oracles": "SELECT l_returnflag, count_if(abs(l_discount) < 0.05) AS n_a, count_if(l_tax >= 0.04) AS n_b, count_if(abs(l_discount) < 0.05 OR l_tax >= 0.04) AS n_any, count_if(abs(l_discount) < 0.05 AND l_tax >= 0.04) AS n_all FROM lineitem GROUP BY 1",
    "dimension_scores": "SELECT l_linestatus, round(avg((l_linenumber % 3 * 0.5 + l_orderkey % 3 * 0.5) / 2), 6) AS score, round(avg(1 / (1 + exp(l_tax - l_discount))), 6) AS yes FROM lineitem GROUP BY 1",
    "content_match": "WITH l AS (SELECT *, l_returnflag AS f, l_linestatus AS s, CASE WHEN l_tax > 0 THEN CAST(round(l_tax * 100) AS INTEGER) END AS t FROM lineitem), w AS (SELECT *, first_value(f) OVER o AS wf, first_value(s) OVER o AS ws, first_value(t) OVER o AS wt FROM l WINDOW o AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate)) SELECT l_orderkey, l_linenumber, round((CASE WHEN f = wf THEN 0.5 ELSE 0 END + CASE WHEN s = ws THEN 0.2 ELSE 0 END + CASE WHEN t = wt THEN 0.3 ELSE 0 END) / (0.7 + CASE WHEN wt IS NULL THEN 0 ELSE 0.3 END), 6) AS score FROM w",
    "document_words": "SELECT doc_id, coalesce(len(regexp_extract_all(text, '[A-Za-z0-9]+')), -1) AS n_words, length(regexp_replace(lower(text), '[^A-Za-z0-9_\\s]', '', 'g')) AS n_plain FROM documents",
    "document_numbers": r"""
WITH d AS (SELECT doc_id, text, regexp_replace(regexp_replace(text, '([0-9]),([0-9])', '\1\2', 'g'), '([0-9]),([0-9])', '\1\2', 'g') AS plain FROM documents),
f AS (SELECT doc_id, nullif(regexp_extract(plain, '[-+]?[0-9]*\.[0-9]+|[0-9]+'), '') AS n, nullif(regexp_extract(text, '[$€£¥₹]'), '') AS s,
  nullif(regexp_extract(text, '(?:^|[^\p{L}\p{N}_])(USD|EUR|GBP|JPY|INR)(?:[^\p{L}\p{N}_]|$)', 1), '') AS c,
  lower(nullif(regexp_extract(text, '(?i)(?:^|[^\p{L}\p{N}_])(dollars|euros|pounds|yen|rupees)(?:[^\p{L}\p{N}_]|$)', 1), '')) AS w FROM d)
SELECT doc_id, TRY_CAST(n AS DOUBLE) AS number, coalesce(
  CASE s WHEN '$' THEN 'USD' WHEN '€' THEN 'EUR' WHEN '£' THEN 'GBP' WHEN '¥' THEN 'JPY' WHEN '₹' THEN 'INR' END, c,
  CASE w WHEN 'dollars' THEN 'USD' WHEN 'euros' THEN 'EUR' WHEN 'pounds' THEN 'GBP' WHEN 'yen' THEN 'JPY' WHEN 'rupees' THEN 'INR' END) AS currency FROM f""",
    "perturbed_items": "WITH w AS (SELECT item_id, text, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) - 1 AS i FROM benchmark), k AS (SELECT item_id, string_agg(w, ' ' ORDER BY i) FILTER (NOT (lower(w) IN ('a', 'an', 'and', 'at', 'for', 'in', 'is', 'of', 'on', 'the', 'to', 'with') AND ('0x' || substr(md5(item_id || ':' || i), 1, 8))::UBIGINT / 4294967296.0" + " < 0.4)) AS t FROM w GROUP BY item_id) SELECT item_id, 'leet' AS kind, translate(text, 'aeioAEIO', '43104310') AS text FROM benchmark UNION ALL SELECT item_id, 'delete_words', coalesce(t, '') FROM k UNION ALL SELECT item_id, 'none', text FROM benchmark",
    "item_similarity": "WITH l AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')) AS a, list_distinct(list_filter(regexp_split_to_array(lower(lag(text) OVER (PARTITION BY item_id % 4 ORDER BY item_id)), '\\s+'), lambda w: w <> '')) AS b FROM benchmark) SELECT item_id, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS jaccard FROM l WHERE b IS NOT NULL",
    "listed_flags": "WITH f AS (SELECT l_orderkey, list_sort(list_distinct(list(l_returnflag))) AS f FROM lineitem GROUP BY 1) SELECT l_orderkey, CASE len(f) WHEN 1 THEN f[1] ELSE array_to_string(f[1:len(f) - 1], ', ') || ' and ' || f[len(f)] END AS flags, 'order ' || l_orderkey || ': ' || len(f) AS phrase FROM f",
    "page_fields": "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<p[ >]')) AS n_paragraphs FROM pages",
    "sampled_features": f"WITH u AS (SELECT c_custkey, {H.format('c', 'c_custkey')} AS c, {H.format('o', 'c_custkey')} AS o, {H.format('v', 'c_custkey')} AS v FROM customer), s AS (SELECT *, CASE WHEN c < 0.5 THEN 0 WHEN c < 0.8 THEN 1 WHEN c < 0.9 THEN 2 ELSE 3 END AS i FROM u) SELECT c_custkey, (['formal', 'casual', 'slang', 'rude'])[i + 1] AS style, round((i + o) / 4, 6) AS score, round(10 + 5 * v, 6) AS value FROM s",
    "crossed_features": f"WITH x AS (SELECT *, coalesce(lead(c_mktsegment) OVER w, lag(c_mktsegment) OVER w, c_mktsegment) AS s, coalesce(lead(c_nationkey) OVER w, lag(c_nationkey) OVER w, c_nationkey) AS n FROM customer WINDOW w AS (PARTITION BY floor(c_custkey / 2) ORDER BY c_custkey)) SELECT c_custkey, CASE WHEN {H.format('s', 'c_custkey')} < 0.5 THEN s ELSE c_mktsegment END AS segment, CASE WHEN {H.format('n', 'c_custkey')} < 0.5 THEN n ELSE c_nationkey END AS nation, round(least(greatest(c_acctbal + ({H.format('m', 'c_custkey')} - 0.5) * 100, -1000), 10000), 2) AS balance FROM x",
}
