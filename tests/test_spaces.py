"""Fronts over generations, volumes, medoids, far points, values, dependence and covering rows against plain versions."""

from itertools import combinations, product

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.operators import fronts, medoids, variables
from colloquy.plans import spaces

DATA = "/root/testdata/sf0.001"


def beats(q, p):
    return all(a <= b for a, b in zip(q, p)) and q != p


def random_points(spark, n, d, seed, groups=3, generations=6, levels=9):
    rng = np.random.default_rng(seed)
    rows = [(int(g), int(t), i, *map(float, p)) for i, (g, t, p) in enumerate(zip(rng.integers(0, groups, n), rng.integers(0, generations, n), rng.integers(0, levels, (n, d)), strict=True))]
    names = [f"x{k}" for k in range(d)]
    return rows, names, spark.createDataFrame(rows, "g long, gen long, id long, " + ", ".join(f"{c} double" for c in names))


@pytest.mark.parametrize("d", [1, 2, 3])
def test_fronts_and_prefixes(spark, d):
    rows, names, df = random_points(spark, 700, d, d)
    df = df.unionByName(spark.createDataFrame([(0, 0, -1, *[None] * d)], df.schema))
    got = {r.id for r in fronts.front(df, ["g"], names).collect()}
    assert got == {r[2] for r in rows if not any(q[0] == r[0] and beats(q[3:], r[3:]) for q in rows)}
    assert {r.id for r in fronts.front(df, [], names).collect()} == {r[2] for r in rows if not any(beats(q[3:], r[3:]) for q in rows)}
    members = [(r.g, r.gen, r.left, r.id) for r in fronts.cumulative_fronts(df, "g", "gen", names).collect()]
    for t in range(6):
        prefix = [r for r in rows if r[1] <= t]
        want = {r[2] for r in prefix if not any(q[0] == r[0] and beats(q[3:], r[3:]) for q in prefix)}
        assert {i for _, gen, left, i in members if gen <= t and (left is None or left > t)} == want
        for g in range(3):
            sizes = [(r.gen, r.size) for r in fronts.front_sizes(fronts.cumulative_fronts(df, "g", "gen", names), "g", "gen").filter(F.col("g") == g).collect()] if t == 5 else []
            assert not sizes or max(sizes)[1] == sum(r[0] == g and r[2] in want for r in prefix)


def test_fronts_of_large_batches_and_none(spark):
    rng = np.random.default_rng(9)
    p = rng.integers(0, 60, (3000, 3)).astype(float)
    plain = np.array([not ((p <= r).all(1) & (p < r).any(1)).any() for r in p])
    assert (fronts.first_front(p) == plain).all() and (fronts.beaten(p, p) == ~plain).all()
    empty = spark.createDataFrame([], "g long, gen long, x double")
    assert fronts.front(empty, ["g"], ["x"]).count() == fronts.cumulative_fronts(empty, "g", "gen", ["x"]).count() == fronts.normalised_hypervolume(empty, "g", ["x"]).count() == 0


@pytest.mark.parametrize("d", [1, 2, 3, 4])
def test_volume_against_a_grid(d):
    rng = np.random.default_rng(d)
    for _ in range(5):
        p = rng.integers(0, 7, (12, d)).astype(float)
        want = sum(any((q <= np.array(c)).all() for q in p) for c in product(range(6), repeat=d))
        assert fronts.volume(p, np.full(d, 6.0)) == pytest.approx(want)


def test_normalised_hypervolume_of_flat_objective(spark):
    df = spark.createDataFrame([(1, 0.0, 5.0), (1, 2.0, 5.0), (2, 0.0, 1.0), (2, 1.0, 0.0), (2, 1.0, 1.0)], "g long, x double, y double")
    got = {r.g: (r.n, r.hypervolume) for r in fronts.normalised_hypervolume(df, "g", ["x", "y"]).collect()}
    assert got[1] == (1, pytest.approx(1.01 * 1.01)) and got[2] == (2, pytest.approx(0.01 * 1.01 + 1.0 * 0.01))


def plain_medoids(d, k):
    """Build and best swaps by loops."""
    n = len(d)
    cost = lambda m: sum(min(d[i][j] for j in m) for i in range(n))
    chosen = [min(range(n), key=lambda i: (sum(d[i]), i))]
    while len(chosen) < k:
        chosen.append(min((i for i in range(n) if i not in chosen), key=lambda i: (round(cost([*chosen, i]), 12), i)))
    while True:
        best = (cost(chosen) - 1e-9, None)
        for a in chosen:
            for b in range(n):
                if b not in chosen:
                    c = cost([b if x == a else x for x in chosen])
                    if c < best[0] - 1e-12:
                        best = (c, [b if x == a else x for x in chosen])
        if best[1] is None:
            return cost(chosen)
        chosen = best[1]


def plain_silhouette(d, label):
    out = []
    for i in range(len(d)):
        own = [d[i][j] for j in range(len(d)) if label[j] == label[i] and j != i]
        if not own:
            out.append(0.0)
            continue
        a = sum(own) / len(own)
        b = min(np.mean([d[i][j] for j in range(len(d)) if label[j] == o]) for o in set(label) if o != label[i])
        out.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return float(np.mean(out))


def test_medoids_against_loops():
    rng = np.random.default_rng(1)
    for n in (2, 5, 14):
        scores, choices = rng.random((n, 2)), rng.integers(0, 3, (n, 2))
        d = medoids.mixed_matrix(scores, choices)
        assert d[0, 1] == pytest.approx((np.sqrt(((scores[0] - scores[1]) ** 2).sum()) + (choices[0] != choices[1]).sum()) / 4)
        for k in range(1, n):
            found = medoids.swap(d, medoids.build(d, k))
            cost = d[found].min(0).sum()
            least = min(d[list(c)].min(0).sum() for c in combinations(range(n), k))
            assert cost <= plain_medoids(d.tolist(), k) + 1e-9 and least - 1e-9 <= cost <= 1.1 * least + 1e-9
        label = rng.integers(0, 2, n)
        label[:2] = 0, 1
        assert medoids.silhouette(d, label) == pytest.approx(plain_silhouette(d.tolist(), label.tolist()))


def test_medoids_of_sampled_and_odd_groups(spark):
    rng = np.random.default_rng(2)
    rows = [(1, i, [float(i % 3) + 0.01 * rng.random(), 0.0], [str(i % 3), "x"]) for i in range(600)] + [(2, 1, [0.5, None], [None, "a"]), (3, 1, [0.0, 0.0], ["a", "b"]), (3, 2, [0.0, 0.0], ["a", "b"])]
    df = spark.createDataFrame(rows, "g long, id long, s array<double>, c array<string>")
    found = medoids.medoids(df, "g", "id", "s", "c", range(2, 6), sample=60)
    by = {r.g: r for r in found.collect()}
    assert len(by[1].medoids) == 3 and by[1].silhouette > 0.9 and len(by[2].medoids) == 1 and by[2].silhouette is None
    placed = medoids.assigned(df, found, "g", "s", "c").collect()
    assert len(placed) == 603
    clusters = {(r.id % 3, r.cluster) for r in placed if r.g == 1}
    loss = sum(r.distance for r in placed if r.g == 1)
    assert len(clusters) == 3 and loss <= 1.1 * sum(min(abs(a[2][0] - b[2][0]) for b in rows[:600] if b[1] % 3 == a[1] % 3 and b[1] in [m.id for m in by[1].medoids]) / 4 for a in rows[:600])


def test_medoid_query_clusters_everyone(spark):
    rows = spaces.medoid_clusters(spark, DATA).collect()
    assert sum(r.n for r in rows) == spark.read.parquet(f"{DATA}/customer.parquet").count()
    for nation in {r.c_nationkey for r in rows}:
        own = spaces.profiles(spark, DATA).filter(F.col("c_nationkey") == nation).orderBy("c_custkey").collect()
        codes = [{v: i for i, v in enumerate(sorted({r.choices[k] for r in own}))} for k in range(2)]
        d = medoids.mixed_matrix(np.array([r.scores for r in own]), np.array([[codes[k][r.choices[k]] for k in range(2)] for r in own]))
        best = (None, None)
        for k in range(2, min(8, len(own)) + 1):
            found = sorted(medoids.swap(d, medoids.build(d, k)))
            value = plain_silhouette(d.tolist(), d[found].argmin(0).tolist())
            if best[0] is None or value > best[0] + 1e-12:
                best = (value, [own[i].c_custkey for i in found])
        mine = sorted((r.cluster, r.medoid) for r in rows if r.c_nationkey == nation)
        if best[0] is not None:
            assert [m for _, m in mine] == best[1] and next(r.silhouette for r in rows if r.c_nationkey == nation) == pytest.approx(best[0], abs=2e-6)


def test_farthest_points_few_and_equal(spark):
    rows = [(1, i, [float(x), float(y)]) for i, (x, y) in enumerate(product(range(5), range(4)))] + [(2, 1, [1.0, 1.0]), (2, 2, [1.0, 1.0]), (2, None, [9.0, 9.0]), (3, 4, None)]
    df = spark.createDataFrame(rows, "g long, id long, v array<double>")
    got = {r.g: [p.id for p in r.picked] for r in medoids.farthest_points(df, "g", "id", "v", 6).collect()}
    picked = [0]
    pts = {i: v for g, i, v in rows if g == 1}
    while len(picked) < 6:
        picked.append(max((i for i in pts if i not in picked), key=lambda i: (min(sum((a - b) ** 2 for a, b in zip(pts[i], pts[j])) for j in picked), -i)))
    assert got == {1: picked, 2: [1]}


def test_values_by_number(spark):
    lists = [["a", "b", "c"], ["x", "y"], ["p", "q", "r", "s"]]
    columns = [F.array(*map(F.lit, v)) for v in lists]
    rows = spark.range(60).select("id", variables.nth_combination(F.col("id"), columns).alias("all"), variables.nth_without_repeats(F.col("id"), columns[2], F.lit("k")).alias("one"), variables.nth_sample(F.col("id"), columns[2], F.lit(9), F.lit("k")).alias("some")).orderBy("id").collect()
    want = [list(p) for p in product(*lists)]
    assert [r["all"] for r in rows] == [want[i % 24] for i in range(60)]
    turns = [tuple(r.one for r in rows[i : i + 4]) for i in range(0, 60, 4)]
    assert all(sorted(t) == lists[2] for t in turns) and len(set(turns)) > 5
    assert all(sorted(r.some) == lists[2] for r in rows)
    none = spark.range(1).select(variables.nth_combination(F.col("id"), [F.array().cast("array<string>")]).alias("a"), variables.nth_without_repeats(F.col("id"), F.array().cast("array<string>")).alias("b")).first()
    assert none.a == [None] and none.b is None


def test_dependency_levels_chains_cycles_roots(spark):
    master = {"r1": None, "r2": None, "a": "r1", "b": "a", "c": "b", "d": "r2", "x": "y", "y": "z", "z": "x", "w": "x", "v": "w", "self": "self", "o": "outside", "p": "o"} | {f"n{i}": f"n{i + 1}" for i in range(70)} | {"n70": None}
    df = spark.createDataFrame([*master.items(), ("a", "r1"), (None, "a")], "name string, to string")
    got = {r.name: (r.level, r.root, r.cycle) for r in variables.dependency_levels(df, "name", "to").collect()}

    def plain(v):
        path = [v]
        while master.get(path[-1]) is not None:
            nxt = master[path[-1]]
            if nxt in path:
                return None, None, "member" if v in path[path.index(nxt) :] else "behind"
            path.append(nxt)
        return len(path) - 1, path[-1], "no"

    assert got == {v: plain(v) for v in master}
    assert variables.dependency_levels(df.limit(0), "name", "to").count() == 0


@pytest.mark.parametrize("sizes, strength", [([3, 3, 3], 2), ([5, 2, 4, 3], 2), ([2, 2, 2, 2], 3), ([4], 2), ([3, 4], 1), ([1, 6, 2], 2), ([6, 6, 5, 4, 3], 2)])
def test_covering_rows(sizes, strength):
    rows = variables.covering_rows(sizes, strength)
    t = min(strength, len(sizes))
    for c in combinations(range(len(sizes)), t):
        assert {tuple(r[f] for f in c) for r in rows} == set(product(*(range(sizes[f]) for f in c)))
    assert len(rows) <= 1.5 * np.prod(sorted(sizes)[-t:]) and len(set(rows)) == len(rows)


def test_covering_query_and_sample(spark):
    domains = spaces.part_domains(spark, DATA)
    values = {(r.p_brand, r.feature): r["values"] for r in domains.collect()}
    rows = variables.covering_sample(domains, "p_brand", "feature", "values", strength=2).collect()
    for m in {k for k, _ in values}:
        own = [dict(zip(r.features, r.choice)) for r in rows if r.p_brand == m]
        for a, b in combinations(sorted(f for k, f in values if k == m), 2):
            assert {(r[a], r[b]) for r in own} == set(product(values[m, a], values[m, b]))
        assert len(own) <= 2 * np.prod(sorted(len(v) for (k, _), v in values.items() if k == m)[-2:])
    few = variables.covering_sample(domains, "p_brand", "feature", "values", n=7)
    assert {r["count"] for r in few.groupBy("p_brand").count().collect()} == {7}
    many = variables.covering_sample(domains, "p_brand", "feature", "values", n=100, strength=1).groupBy("p_brand", "choice").count().groupBy("p_brand").agg(F.max("count").alias("a"), F.min("count").alias("b")).collect()
    assert all(r.a - r.b <= 1 for r in many)
    assert variables.least_strength([3, 3], 8) == 2 and variables.least_strength([3, 3], 2) == 1


def test_plus_distances_and_bounds(spark):
    df = spark.createDataFrame([(1, 0.0, 4.0), (1, 4.0, 0.0), (1, 4.0, 4.0), (2, 2.0, 4.0), (3, None, 1.0)], "g long, x double, y double")
    ref = spark.createDataFrame([(0.0, 4.0), (2.0, 2.0), (4.0, 0.0), (3.0, 3.0)], "x double, y double")
    got = {r.g: (r.gd_plus, r.igd_plus) for r in fronts.plus_distances(df, "g", ["x", "y"], ref).collect()}
    assert got == {1: (0.0, pytest.approx(0.5 / 3)), 2: (0.5, pytest.approx((0.5 + 0.5 + 1.0) / 3))}
    with pytest.raises(ValueError, match="different points"):
        fronts.plus_distances(df, "g", ["x", "y"], ref, most=2)


def test_ties_and_missing_labels_fail(spark):
    from colloquy.operators import agreement as A

    votes = spark.createDataFrame([(1, 0, 2), (1, 1, 2), (1, 2, 0), (2, 0, 1), (2, 1, 1)], "item int, rater int, label int")
    assert sorted((r.item, r.label) for r in A.majority(votes, "error").collect()) == [(1, 2), (2, 1)]
    tied = votes.unionByName(spark.createDataFrame([(3, 0, 1), (3, 1, 0)], votes.schema))
    assert {r.item: r.label for r in A.majority(tied, "max").collect()}[3] == 1 and {r.item: r.label for r in A.majority(tied).collect()}[3] == 0
    with pytest.raises(Exception, match="tie in the votes on item 3"):
        A.majority(tied, "error").collect()
    with pytest.raises(ValueError, match="min, max or error"):
        A.majority(tied, "first")
    rows, labels = spark.createDataFrame([(1,), (2,)], "item int"), spark.createDataFrame([(1, 5), (2, 6), (9, 7)], "item int, label int")
    assert sorted(tuple(r) for r in A.with_label(rows, labels, "item", "label").collect()) == [(1, 5), (2, 6)]
    with pytest.raises(Exception, match="no label for 2"):
        A.with_label(rows, labels.filter("item <> 2"), "item", "label").collect()


def test_tournament_by_rank_and_odd_one_out(spark):
    from colloquy.operators import search as S

    rows = spark.createDataFrame([("g", i, 0.0, 1.0, i % 2, 0.5) for i in range(5)], "g string, k long, v double, x double, r long, c double")
    won = S.constrained_tournament(rows, "g", "k", "v", ["x"], "r", "c").collect()
    assert len(won) == 3 and sum(r.winner % 2 == 0 for r in won) >= 2
    with pytest.raises(ValueError, match="rank or dominance"):
        S.constrained_tournament(rows, "g", "k", "v", ["x"], "r", "c", "luck")


def test_uncovered_pairs_and_too_many_values(spark):
    from colloquy.operators import search as S

    df = spark.createDataFrame([("x", 1), ("x", 2), ("y", 1), ("z", None), (None, 3)], "a string, b int")
    assert sorted(tuple(r) for r in S.uncovered_pairs(df, "a", "b").collect()) == [("x", 3), ("y", 2), ("y", 3), ("z", 1), ("z", 2), ("z", 3)]
    assert S.uncovered_pairs(df.limit(0), "a", "b").count() == 0
    with pytest.raises(Exception, match="over 2 values"):
        S.uncovered_pairs(df, "a", "b", most=2).collect()


def test_grid_between(spark):
    from colloquy.operators import search as S

    df = spark.createDataFrame([("g", 0.0, 5.0), ("g", 2.0, 5.0), ("h", 1.0, 1.0)], "g string, x double, y double")
    rows = S.grid_between(df, "g", ["x", "y"], 3).collect()
    assert sorted((r.x, r.y) for r in rows if r.g == "g") == [(x, 5.0) for x in (0.0, 1.0, 2.0) for _ in range(3)] and len(rows) == 18
    assert {(r.x, r.y) for r in rows if r.g == "h"} == {(1.0, 1.0)}


def test_existence_of_places(spark):
    from colloquy.operators import poi

    rng = np.random.default_rng(0)
    rows = [(i, ("thai", "greek", "cafe")[i % 3], None if i % 11 == 0 else float(rng.integers(0, 4))) for i in range(300)]
    pois = spark.createDataFrame([(i, c, "", r, "$", True, 0.0, 0.0, None, None) for i, c, r in rows], "id long, category string, name string, rating double, price_level string, parking boolean, lat double, lng double, opens string, closes string").repartition(5)
    empty = (None,) * 7
    wants = spark.createDataFrame([(1, ("thai", *empty)), (2, ("zz", *empty)), (3, (None, None, 3.0, *empty[:5]))], "want_id int, want struct<category:string,price_level:string,rating:double,parking:boolean,lat:double,lng:double,radius_km:double,now:string>")
    got = {r.want_id: (r.n, r.poi_exists, r.ids) for r in poi.existence(pois, wants).collect()}

    def best(match):
        found = sorted((x for x in rows if match(x)), key=lambda x: (-(x[2] if x[2] is not None else -np.inf), x[0]))
        return len(found), bool(found), ",".join(str(x[0]) for x in found[:5])

    assert got[1] == best(lambda x: x[1] == "thai") and got[2] == (0, False, "")
    assert got[3][2].split(",") and got[3][0] == sum(x[2] is not None and x[2] >= 3.0 for x in rows)


def test_equal_points_are_compared_once(monkeypatch):
    pairs, plain = [], fronts.beaten
    monkeypatch.setattr(fronts, "beaten", lambda p, q: pairs.append(len(p) * len(q)) or plain(p, q))
    points = np.repeat([[1.0, 2.0, 3.0], [0.0, 5.0, 5.0], [2.0, 2.0, 3.0]], 20_000, 0)
    assert (fronts.first_front(points) == np.repeat([True, True, False], 20_000)).all()
    assert sum(pairs) < 100


def test_fronts_of_groups_at_once():
    rng = np.random.default_rng(2)
    for d in (1, 2, 3):
        cuts = np.append(0, np.cumsum(rng.choice([1, 2, 5, 70, 400], 60)))
        points = rng.integers(0, 9, (cuts[-1], d)).astype(float)
        want = [((p[:, None] <= p).all(2) & (p[:, None] < p).any(2)).any(0) for p in np.split(points, cuts[1:-1])]
        assert (fronts.first_fronts(points, cuts) == ~np.concatenate(want)).all()


@pytest.mark.parametrize("batch", [7, 300, 10_000])
def test_cumulative_fronts_and_indicators_of_small_and_large_groups(spark, batch):
    rng = np.random.default_rng(batch)
    sizes = {0: 1, 1: 3, 2: 1500, 3: 40, 4: 2, 5: 900, 6: 30}
    # on planes, so that fronts are large
    flat = lambda n: np.round(np.column_stack((p := rng.random((n, 2)), 2 - p.sum(1) + rng.integers(0, 3, n) / 10)), 2)
    rows = [(g, int(gen), i, *map(float, p)) for g, n in sizes.items() for i, (gen, p) in enumerate(zip(rng.integers(0, 6, n), flat(n), strict=True))]
    df = spark.createDataFrame(rows, "g int, gen int, id int, x double, y double, z double").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = {(r.g, r.id): r.left for r in fronts.cumulative_fronts(df, "g", "gen", ["x", "y", "z"]).collect()}
        volumes = fronts.normalised_hypervolume(df, "g", ["x", "y", "z"])
        distances = fronts.plus_distances(df, "g", ["x", "y", "z"], fronts.front(df, [], ["x", "y", "z"]))
        n, gd = {r.g: r.n for r in volumes.collect()}, {r.g: (r.gd_plus, r.igd_plus) for r in distances.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, best = {}, {}
    for g in sizes:
        p, gen, ids = (np.array([r[c] for r in rows if r[0] == g]) for c in (slice(3, 6), 1, 2))
        beat = (p[:, None] <= p).all(2) & (p[:, None] < p).any(2)
        cut = np.where(beat, gen[:, None], 99).min(0)
        want |= {(g, int(i)): (None if c == 99 else int(c)) for i, c, own in zip(ids, cut, gen, strict=True) if c > own}
        best[g] = p[cut == 99]
    assert got == want
    assert n == {g: len(p) for g, p in best.items()}
    z = np.unique(np.concatenate(list(best.values())), axis=0)
    z = z[~((z[:, None] <= z).all(2) & (z[:, None] < z).any(2)).any(0)]
    for g, p in best.items():
        d = np.sqrt((np.maximum(np.unique(p, axis=0)[:, None] - z, 0) ** 2 / (z.max(0) - z.min(0)) ** 2).sum(2))
        assert gd[g] == (pytest.approx(d.min(1).mean()), pytest.approx(d.min(0).mean()))
    # no call and no frame for each group
    for frame in (volumes, distances):
        assert "FlatMapGroups" not in frame._jdf.queryExecution().executedPlan().toString()
