import json

from pyspark.sql import functions as F

from colloquy.sources import readers, writers
from colloquy.streaming import live


def test_poi_and_features(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"name": "A", "city": "Munich", "stars": 4.5, "categories": "Food", "attributes": {"RestaurantsPriceRange2": "2", "BusinessParking": "{'lot': True}"}}) + "\n" + json.dumps({"name": "B", "city": "Paris"}) + "\n")
    assert [(r.name, r.price_level, r.parking) for r in readers.pois(spark, str(tmp_path / "p.json"), "munich").collect()] == [("A", "$$", True)]
    (tmp_path / "f.json").write_text(json.dumps({"categorical_features": [{"name": "c", "values": ["x", None, 3]}], "ordinal_features": [], "continuous_features": [{"name": "z", "lb": 0, "ub": 1}]}))
    assert [(r.grp, r.name) for r in readers.feature_config(spark, str(tmp_path / "f.json")).orderBy("grp").collect()] == [("categorical", "c"), ("continuous", "z")]


def test_raters_and_cases(spark, tmp_path):
    d = tmp_path / "raters"
    d.mkdir()
    (d / "ann.csv").write_text("conversation_id,clarity\n1,2\n2,x\n")
    (d / "bob.csv").write_text("conversation_id,clarity\n1,1\n")
    got = {(r.item, r.rater): r.label for r in readers.rater_tables(spark, str(d), ["clarity"]).collect()}
    assert got == {("1", "ann"): 2, ("2", "ann"): None, ("1", "bob"): 1}
    (tmp_path / "t.csv").write_text('vars,conversation,Fitness_a,Critical\n"[1, 2]","User: x\ny",0.5,1\nvars,conversation,Fitness_a,Critical\n"[3]",z,1.0,0\n')
    rows = readers.test_cases(spark, str(tmp_path / "t.csv")).collect()
    assert [(r.x.vars, r.f, r.is_critical) for r in rows] == [("[1, 2]", {"a": 0.5}, True), ("[3]", {"a": 1.0}, False)]


def test_dirty_logs(spark, tmp_path):
    text = "- broken: [a]\nconversation: x\n---\nconversation time: 3.5\nassistant response time:\n- 1.5\n- 2.0\nresponse time report:\n---\ninteraction:\n- User: hello\n- Assistant: 'hi\n  there'\n"
    (tmp_path / "a.yml").write_text(text)
    (tmp_path / "__report__x.yml").write_text(text)
    rows = readers.conversation_logs(spark, str(tmp_path)).collect()
    assert len(rows) == 1 and rows[0].conv_time == 3.5 and rows[0].resp_times == [1.5, 2.0]
    assert [(t.role, t.text) for t in rows[0].turns] == [("user", "hello"), ("assistant", "hi there")]


def test_writers(spark, tmp_path):
    tests = spark.createDataFrame([(1, {"a": 0.5}, True), (2, {"a": 1.0, "b": 0.1}, False)], "id int, f map<string,double>, is_critical boolean")
    writers.fitness_csv(tests, str(tmp_path / "c"))
    assert sorted(spark.read.option("header", True).csv(str(tmp_path / "c")).columns) == ["Critical", "Fitness_a", "Fitness_b", "id"]
    writers.tests_json(tests, str(tmp_path / "j"), critical_only=True)
    assert spark.read.json(str(tmp_path / "j")).count() == 1
    writers.summary_csv(spark.range(1).select(F.lit(3).alias("n")), str(tmp_path / "s"))
    assert readers.summary(spark, str(tmp_path / "s")).collect()[0].attributes == {"n": "3"}
    assert writers.without_nan(spark.range(1).select(F.lit(float("nan")).alias("x"))).collect()[0].x is None
    assert "n \\\\" in writers.latex_table(spark.range(1).select(F.lit(3).alias("n")))


def test_streams_equal_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i % 2, i, f"2024-01-01 00:0{i % 5}:00", i % 3 == 0) for i in range(20)], "run int, user_id long, ts string, failed boolean").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = live.running_failures(stream).writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, live.running_failures(rows).collect()))
    query = live.failures_per_window(stream).writeStream.outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("windows").agg(F.sum("tests")).collect()[0][0] == 20
