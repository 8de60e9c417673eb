"""The merged failure predicate on the labelled conversations that come with the published results, and the recount of real tests."""

import pytest
from pyspark.sql import functions as F

from colloquy.operators import scoring as S

#: Scores of dimensions, efficiency and effectiveness, and whether the conversation is labelled critical.
NAVIGATION = [
    (1.0, 1.0, 0.9676933408340778, 0), (0.825, 1.0, 0.9538084437481773, 0), (0.675, 1.0, 0.9676933408340778, 0), (0.675, 1.0, 0.9538084437481773, 0), (0.675, 1.0, 0.9676933408340778, 0),
    (1.0, 0.5, 0.0, 1), (0.675, 1.0, 0.9651236748457105, 0), (1.0, 1.0, 0.9749555347702317, 0), (1.0, 1.0, 0.0, 1), (1.0, 1.0, 0.9538084437481773, 0), (1.0, 1.0, 0.9651236748457104, 0),
    (1.0, 1.0, 0.704533657097778, 1), (0.675, 0.6666666666666667, 0.9538084437481773, 1), (1.0, 1.0, 0.0, 1), (1.0, 0.6666666666666667, 0.4719962339250623, 1), (0.0, 1.0, 0.9538084437481773, 1),
    (0.5, 0.8333333333333334, 0.943113674261846, 1), (1.0, 0.5, 0.0, 1), (1.0, 0.5, 0.0, 1), (0.675, 1.0, 0.6230938467016408, 1), (0.5, 1.0, 0.9538219874745165, 1),
]
CAR_CONTROL = [
    (1.0, 1.0, 0.8571428571428572, 0), (1.0, 1.0, 1.0, 0), (0.5, 0.5, 1.0, 1), (1.0, 1.0, 1.0, 0), (1.0, 1.0, 1.0, 0), (1.0, 1.0, 0.7777777777777778, 0), (1.0, 1.0, 1.0, 0),
    (0.675, 0.25, 0.7037037037037037, 1), (0.675, 1.0, 1.0, 0), (1.0, 1.0, 0.7142857142857143, 1), (1.0, 1.0, 0.9047619047619048, 0), (1.0, 1.0, 1.0, 0), (1.0, 1.0, 0.8095238095238096, 0),
    (1.0, 1.0, 1.0, 0), (1.0, 1.0, 1.0, 0), (0.825, 0.75, 0.8571428571428572, 0), (1.0, 1.0, 1.0, 0), (1.0, 1.0, 1.0, 0), (1.0, 0.75, 1.0, 0), (1.0, 1.0, 1.0, 0), (0.5, 0.75, 0.8518518518518517, 1),
    (1.0, 1.0, 1.0, 0), (1.0, 0.75, 1.0, 0), (1.0, 1.0, 1.0, 0), (1.0, 1.0, 1.0, 0),
]
SCORES = ("dimensions", "efficiency", "effectiveness")


@pytest.mark.parametrize("rows, critical", [(NAVIGATION, 12), (CAR_CONTROL, 4)])
def test_labels_of_the_published_rows(spark, rows, critical):
    df = spark.createDataFrame(rows, "dimensions double, efficiency double, effectiveness double, label int")
    said = df.select("label", S.critical_conversation(*map(F.col, SCORES)).alias("said")).collect()
    assert all(r.said == bool(r.label) for r in said) and sum(r.said for r in said) == critical


def plain(rows, content=0.75, efficiency=0.65, response=0.65, only_response=False):
    tests = fails = 0
    for asked, critical, d, e, f in rows:
        if not asked:
            continue
        tests += 1
        if not critical:
            continue
        old = d is None or d < 1.0
        if only_response:
            fails += old if response is None else d is not None and d <= response
        elif content is None and efficiency is None and response is None:
            fails += old
        else:
            a = content is not None and d is not None and response is not None and d <= response
            b = efficiency is not None and e is not None and e <= efficiency
            c = response is not None and f is not None and content is not None and f <= content
            fails += a or b or c
    return tests, fails


@pytest.mark.parametrize("how", [{}, {"only_response": True}, {"only_response": True, "response": None}, {"content": None, "efficiency": None, "response": None}, {"efficiency": 0.75}])
def test_recount(spark, how):
    rows = [(bool(i % 4), bool(label), d, e, None if i % 5 == 0 else f) for i, (d, e, f, label) in enumerate(NAVIGATION + CAR_CONTROL)] + [(True, True, None, None, None), (None, True, 0.0, 0.0, 0.0), (True, None, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "asked boolean, critical boolean, dimensions double, efficiency double, effectiveness double").withColumn("run", F.lit(1))
    counts = S.recounted(df, "run", F.col("asked"), F.col("critical"), tuple(map(F.col, SCORES)), **how)
    r = counts.first()
    assert (r.real_tests, r.real_failures) == plain(rows, **how) and (r.tests, r.failures) == (len(rows), sum(bool(x[1]) for x in rows))
    summary = spark.createDataFrame([(1, 49, 45, 18, 17)], "run int, n_all long, n_all_distinct long, n_critical long, n_critical_distinct long")
    less = S.without_duplicates(counts, summary, "run").first()
    assert (less.real_tests, less.real_failures) == (r.real_tests - 4, r.real_failures - 1)
    assert S.without_duplicates(counts, summary.limit(0), "run").first().real_tests == r.real_tests
