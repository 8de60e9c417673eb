"""Queries on fronts over generations, volumes, medoids, far points, values, dependence and covering rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.functions import features
from colloquy.operators import conversation as C
from colloquy.operators import fronts, medoids, variables
from colloquy.operators import history as H
from colloquy.operators import search as S

from .history import T, tests
from .metrics import r6


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def yearly(spark, sf_dir):
    """Lines of each supplier by year, with three objectives."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(
        F.col("l_suppkey").alias("g"), F.year("l_shipdate").alias("gen"), F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"),
        (F.col("l_quantity") / 100).alias("x"), F.col("l_discount").alias("y"), F.col("l_tax").alias("z"),
    )


def cumulative_front(spark, sf_dir):
    """Lines that are ever on their supplier's front of quantity and discount up to a year, and the year that beats them."""
    rows = yearly(spark, sf_dir).drop("z")
    return fronts.cumulative_fronts(rows, "g", "gen", ["x", "y"]).withColumnRenamed("left", "beaten_in")


def front_growth(spark, sf_dir):
    """Size of the suppliers' fronts of three objectives after each year that changes them."""
    return fronts.front_sizes(fronts.cumulative_fronts(yearly(spark, sf_dir), "g", "gen", ["x", "y", "z"]), "g", "gen")


def global_front(spark, sf_dir):
    """The front of all lines, of three objectives."""
    return fronts.front(yearly(spark, sf_dir), [], ["x", "y", "z"])


def hypervolume3(spark, sf_dir):
    """Volume of three objectives that each supplier's front beats, scaled by the front's ends."""
    return fronts.normalised_hypervolume(yearly(spark, sf_dir), "g", ["x", "y", "z"]).withColumn("hypervolume", F.round("hypervolume", 9))


def profiles(spark, sf_dir):
    """Customers as utterances: two scores and two choices."""
    u = features.keyed_uniform(F.lit("u"), F.col("c_custkey").cast("string"))
    rows = table(spark, sf_dir, "customer")
    kind = F.concat(F.lit("k"), (F.col("c_custkey") % 4).cast("string"))
    return rows.select("c_custkey", "c_nationkey", F.array((F.col("c_acctbal") + 1000) / 11000, u).alias("scores"), F.array("c_mktsegment", kind).alias("choices"))


def medoid_clusters(spark, sf_dir):
    """Medoids of each nation's customers: silhouette, distances between medoids, and of each cluster its medoid, size and sum of distances."""
    rows = profiles(spark, sf_dir)
    found = medoids.medoids(rows, "c_nationkey", "c_custkey", "scores", "choices")
    sizes = medoids.assigned(rows, found, "c_nationkey", "scores", "choices").groupBy("c_nationkey", "cluster").agg(F.count("*").alias("n"), F.sum("distance").alias("loss"))
    each = found.select("c_nationkey", "silhouette", "mean_apart", "most_apart", "mean_most_apart", F.posexplode(F.col("medoids.c_custkey")).alias("cluster", "medoid"))
    return r6(each.join(sizes, ["c_nationkey", "cluster"], "left").fillna(0, ["n", "loss"]), "silhouette", "mean_apart", "most_apart", "mean_most_apart", "loss")


def farthest_vectors(spark, sf_dir):
    """Four vectors of each label that are far from each other."""
    whole = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")).cast("long"))
    rows = table(spark, sf_dir, "embeddings").select("label", "vec_id", whole.alias("vec"))
    picked = medoids.farthest_points(rows, "label", "vec_id", "vec", 4)
    return picked.select("label", F.posexplode(F.col("picked.vec_id")).alias("place", "vec_id"))


SIZES = ["small", "medium", "large"]
TOPPINGS = ["olives", "ham", "onion", "corn"]
DRINKS = ["water", "juice"]


def value_combinations(spark, sf_dir):
    """For each customer as the n-th test: the combination of three dependent lists, a draw without repeats and a sample of two."""
    n = F.col("c_custkey")
    lists = [F.array(*map(F.lit, v)) for v in (SIZES, TOPPINGS, DRINKS)]
    draw = variables.nth_without_repeats(n, lists[1], F.lit("topping"))
    both = F.array_join(variables.nth_sample(n, lists[1], F.lit(2), F.lit("two")), "+")
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(variables.nth_combination(n, lists), "/").alias("order"), draw.alias("draw"), both.alias("both"))


def dependency_levels(spark, sf_dir):
    """Customers that depend on each other: every fifth on none."""
    rows = table(spark, sf_dir, "customer")
    master = F.when(F.col("c_custkey") % 5 != 0, (F.col("c_custkey") * 7 + 3) % 1409)
    return variables.dependency_levels(rows.select("c_custkey", master.alias("master")), "c_custkey", "master")


def part_domains(spark, sf_dir):
    """Values of four features of each brand's parts."""
    rows = table(spark, sf_dir, "part")
    values = F.array(
        F.struct(F.lit("size").alias("feature"), F.floor(F.col("p_size") / 10).cast("string").alias("v")),
        F.struct(F.lit("type").alias("feature"), F.substring_index("p_type", " ", 1).alias("v")),
        F.struct(F.lit("metal").alias("feature"), F.substring_index("p_type", " ", -1).alias("v")),
        F.struct(F.lit("price").alias("feature"), F.floor(F.col("p_retailprice") / 300).cast("string").alias("v")),
    )
    return rows.select("p_brand", F.inline(values)).groupBy("p_brand", "feature").agg(F.array_sort(F.collect_set("v")).alias("values"))


def covering_pairs(spark, sf_dir):
    """Rows of part features in which all pairs of values of each brand stand."""
    rows = variables.covering_sample(part_domains(spark, sf_dir), "p_brand", "feature", "values", strength=2)
    return rows.select("p_brand", "row", F.array_join("choice", "/").alias("choice"))


def plus_distances(spark, sf_dir):
    """Distances of each supplier's front to the front of all lines, of three objectives, counting only what is worse."""
    rows = yearly(spark, sf_dir)
    return r6(fronts.plus_distances(rows, "g", ["x", "y", "z"], fronts.front(rows, [], ["x", "y", "z"])), "gd_plus", "igd_plus")


def constrained_tournament(spark, sf_dir):
    """Winners among the parts of each brand: large ones break a constraint, others meet by dominance."""
    size, price = F.col("p_size"), F.col("p_retailprice")
    rows = table(spark, sf_dir, "part").withColumns({"over": F.greatest(size - 40, F.lit(0)), "crowd": price % 7, "x": size % 5, "y": F.floor(price / 200), "rank": size % 3})
    return S.constrained_tournament(rows, "p_brand", "p_partkey", "over", ["x", "y"], "rank", "crowd", "dominance")


def start_hours(spark, sf_dir):
    """Hours since the first event of each event's run."""
    return r6(H.since_start(tests(spark, sf_dir), "run", "ts").select("event_id", "hours"), "hours")


def numbered_dialogues(spark, sf_dir):
    return C.numbered_dialogue(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (cumulative_front, front_growth, global_front, hypervolume3, medoid_clusters, farthest_vectors, value_combinations, dependency_levels, covering_pairs, plus_distances, constrained_tournament, start_hours, numbered_dialogues)}

L = "WITH l AS (SELECT l_suppkey AS g, year(CAST(l_shipdate AS DATE)) AS gen, l_orderkey AS id, l_linenumber AS line, l_quantity / 100 AS x, l_discount AS y, l_tax AS z FROM lineitem),\n"
PRIOR = "(q.x <= p.x AND q.y <= p.y AND q.z <= p.z AND (q.x < p.x OR q.y < p.y OR q.z < p.z))"
#: Distinct points, so that the joins below are small.
BEATEN3 = f"d AS (SELECT DISTINCT g, gen, x, y, z FROM l), b AS (SELECT p.g, p.gen, p.x, p.y, p.z, min(q.gen) AS cut FROM d p LEFT JOIN d q ON p.g = q.g AND {PRIOR} GROUP BY ALL)"
FAR = "list_sum(list_transform(list_zip({a}.vec, {b}.vec), lambda p: (p[1] - p[2]) ** 2))"
SQL = {
    "cumulative_front": L.replace(", l_tax AS z", "")
    + """d AS (SELECT DISTINCT g, gen, x, y FROM l), b AS (SELECT p.g, p.gen, p.x, p.y, min(q.gen) AS cut FROM d p LEFT JOIN d q ON p.g = q.g AND q.x <= p.x AND q.y <= p.y AND (q.x < p.x OR q.y < p.y) GROUP BY ALL)
SELECT g, gen, id, line, x, y, cut AS beaten_in FROM l JOIN b USING (g, gen, x, y) WHERE cut IS NULL OR cut > gen""",
    "front_growth": L
    + BEATEN3
    + """, m AS (SELECT g, gen, cut FROM l JOIN b USING (g, gen, x, y, z) WHERE cut IS NULL OR cut > gen),
e AS (SELECT g, gen, count(*) AS entered, 0 AS gone FROM m GROUP BY ALL UNION ALL SELECT g, cut, 0, count(*) FROM m WHERE cut IS NOT NULL GROUP BY ALL),
s AS (SELECT g, gen, CAST(sum(entered) AS BIGINT) AS entered, CAST(sum(gone) AS BIGINT) AS gone FROM e GROUP BY g, gen)
SELECT *, CAST(sum(entered - gone) OVER (PARTITION BY g ORDER BY gen) AS BIGINT) AS size FROM s""",
    "global_front": L + f"d AS (SELECT DISTINCT x, y, z FROM l), f AS (SELECT * FROM d p WHERE NOT EXISTS (SELECT 1 FROM d q WHERE {PRIOR})) SELECT l.* FROM l JOIN f USING (x, y, z)",
    "hypervolume3": L
    + f"""d AS (SELECT DISTINCT g, x, y, z FROM l), f AS (SELECT * FROM d p WHERE NOT EXISTS (SELECT 1 FROM d q WHERE q.g = p.g AND {PRIOR})),
c AS (SELECT g, count(*) AS n FROM l JOIN f USING (g, x, y, z) GROUP BY g),
r AS (SELECT g, min(x) AS a, max(x) AS b, min(y) AS c, max(y) AS d, min(z) AS e, max(z) AS f FROM f GROUP BY g),
u AS (SELECT g, CASE WHEN b > a THEN (x - a) / (b - a) ELSE 0 END AS x, CASE WHEN d > c THEN (y - c) / (d - c) ELSE 0 END AS y, CASE WHEN r.f > e THEN (z - e) / (r.f - e) ELSE 0 END AS z FROM f JOIN r USING (g)),
ux AS (SELECT g, x, lead(x, 1, 1.01::DOUBLE) OVER (PARTITION BY g ORDER BY x) - x AS w FROM (SELECT DISTINCT g, x FROM u)),
uy AS (SELECT g, y, lead(y, 1, 1.01::DOUBLE) OVER (PARTITION BY g ORDER BY y) - y AS w FROM (SELECT DISTINCT g, y FROM u)),
uz AS (SELECT g, z, lead(z, 1, 1.01::DOUBLE) OVER (PARTITION BY g ORDER BY z) - z AS w FROM (SELECT DISTINCT g, z FROM u)),
v AS (SELECT ux.g, sum(ux.w * uy.w * uz.w) AS v FROM ux JOIN uy USING (g) JOIN uz USING (g) WHERE EXISTS (SELECT 1 FROM u WHERE u.g = ux.g AND u.x <= ux.x AND u.y <= uy.y AND u.z <= uz.z) GROUP BY ux.g)
SELECT g, n, round(v, 9) AS hypervolume FROM c JOIN v USING (g)""",
    "farthest_vectors": f"""
WITH v AS (SELECT label, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS vec FROM embeddings WHERE vec_id IS NOT NULL),
p0 AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1),
d0 AS (SELECT v.*, {FAR.format(a="v", b="p0")} AS d FROM v JOIN p0 USING (label)), p1 AS (SELECT * FROM d0 QUALIFY row_number() OVER (PARTITION BY label ORDER BY d DESC, vec_id) = 1),
d1 AS (SELECT d0.* REPLACE (least(d0.d, {FAR.format(a="d0", b="p1")}) AS d) FROM d0 JOIN p1 USING (label)), p2 AS (SELECT * FROM d1 QUALIFY row_number() OVER (PARTITION BY label ORDER BY d DESC, vec_id) = 1),
d2 AS (SELECT d1.* REPLACE (least(d1.d, {FAR.format(a="d1", b="p2")}) AS d) FROM d1 JOIN p2 USING (label)), p3 AS (SELECT * FROM d2 QUALIFY row_number() OVER (PARTITION BY label ORDER BY d DESC, vec_id) = 1)
SELECT label, 0 AS place, vec_id FROM p0 UNION ALL SELECT label, 1, vec_id FROM p1 WHERE d > 0 UNION ALL SELECT label, 2, vec_id FROM p2 WHERE d > 0 UNION ALL SELECT label, 3, vec_id FROM p3 WHERE d > 0""",
    "plus_distances": L
    + f"""d AS (SELECT DISTINCT g, x, y, z FROM l), f AS (SELECT * FROM d p WHERE NOT EXISTS (SELECT 1 FROM d q WHERE q.g = p.g AND {PRIOR})), a AS (SELECT DISTINCT x, y, z FROM f p WHERE NOT EXISTS (SELECT 1 FROM f q WHERE {PRIOR})),
s AS (SELECT min(x) AS a, max(x) AS b, min(y) AS c, max(y) AS d, min(z) AS e, max(z) AS f FROM a),
m AS (SELECT p.g, p.x, p.y, p.z, q.x AS qx, q.y AS qy, q.z AS qz, sqrt(greatest(p.x - q.x, 0) ** 2 / CASE WHEN b > a THEN (b - a) ** 2 ELSE 1 END + greatest(p.y - q.y, 0) ** 2 / CASE WHEN d > c THEN (d - c) ** 2 ELSE 1 END + greatest(p.z - q.z, 0) ** 2 / CASE WHEN s.f > e THEN (s.f - e) ** 2 ELSE 1 END) AS w FROM f p, a q, s),
u AS (SELECT g, avg(w) AS gd FROM (SELECT g, min(w) AS w FROM m GROUP BY g, x, y, z) GROUP BY g), v AS (SELECT g, avg(w) AS igd FROM (SELECT g, min(w) AS w FROM m GROUP BY g, qx, qy, qz) GROUP BY g)
SELECT g, round(gd, 6) AS gd_plus, round(igd, 6) AS igd_plus FROM u JOIN v USING (g)""",
    "constrained_tournament": """
WITH p AS (SELECT p_brand AS b, p_partkey AS k, greatest(p_size - 40, 0) AS v, p_retailprice % 7 AS c, p_size % 5 AS x, floor(p_retailprice / 200) AS y, ('0x' || substr(md5('t:' || p_partkey), 1, 8))::UBIGINT AS t, ('0x' || substr(md5('w:' || p_partkey), 1, 8))::UBIGINT AS u FROM part),
o AS (SELECT *, (row_number() OVER (PARTITION BY b ORDER BY t, k) - 1) // 2 AS m FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY b, m ORDER BY u, k) AS i FROM o)
SELECT a.b AS p_brand, a.m AS match, CASE WHEN z.k IS NULL THEN a.k WHEN a.v > 0 OR z.v > 0 THEN CASE WHEN z.v < a.v THEN z.k ELSE a.k END WHEN a.x <= z.x AND a.y <= z.y AND (a.x < z.x OR a.y < z.y) THEN a.k WHEN z.x <= a.x AND z.y <= a.y AND (z.x < a.x OR z.y < a.y) THEN z.k WHEN z.c > a.c THEN z.k ELSE a.k END AS winner
FROM (SELECT * FROM r WHERE i = 1) a LEFT JOIN (SELECT * FROM r WHERE i = 2) z ON a.b = z.b AND a.m = z.m""",
    "start_hours": T + "SELECT event_id, round((epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY run)) / 3.6e9, 6) AS hours FROM t",
    "numbered_dialogues": "SELECT conv_id, string_agg(n || ' - ' || role || ' : ' || coalesce(text, ''), chr(10) ORDER BY n) AS dialogue FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) GROUP BY conv_id",
    "value_combinations": """
WITH c AS (SELECT c_custkey, c_custkey AS n, ['small', 'medium', 'large'] AS s, ['olives', 'ham', 'onion', 'corn'] AS t, ['water', 'juice'] AS d FROM customer)
SELECT c_custkey, s[CAST(n // 8 % 3 AS INTEGER) + 1] || '/' || t[CAST(n // 2 % 4 AS INTEGER) + 1] || '/' || d[CAST(n % 2 AS INTEGER) + 1] AS "order",
       list_sort(list_transform(range(4), lambda i: {'h': md5('topping:' || (n // 4) || ':' || i), 'v': t[i + 1]}))[CAST(n % 4 AS INTEGER) + 1].v AS draw,
       array_to_string(list_transform(list_sort(list_transform(range(4), lambda i: {'h': md5('two:' || n || ':' || i), 'v': t[i + 1]}))[1:2], lambda x: x.v), '+') AS both FROM c""",
    "dependency_levels": """
WITH RECURSIVE e AS (SELECT c_custkey AS name, CASE WHEN c_custkey % 5 <> 0 THEN (c_custkey * 7 + 3) % 1409 END AS master FROM customer),
a AS (SELECT e.name, e.master, e.master IS NOT NULL AND m.name IS NULL AS outside FROM e LEFT JOIN e m ON e.master = m.name),
r AS (SELECT name, CASE WHEN outside THEN 1 ELSE 0 END AS level, CASE WHEN outside THEN master ELSE name END AS root FROM a WHERE master IS NULL OR outside
      UNION ALL SELECT a.name, r.level + 1, r.root FROM r JOIN a ON a.master = r.name AND NOT a.outside),
w AS (SELECT name, master AS far FROM e WHERE name NOT IN (SELECT name FROM r) UNION SELECT w.name, e.master FROM w JOIN e ON w.far = e.name)
SELECT name, CAST(level AS BIGINT) AS level, root, 'no' AS cycle FROM r
UNION ALL SELECT name, NULL, NULL, CASE WHEN bool_or(far = name) THEN 'member' ELSE 'behind' END FROM w GROUP BY name""",
}
