"""Readers of the files that test campaigns leave behind. All parsing of many files runs on the executors."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURN = T.StructType([T.StructField("user", T.StringType()), T.StructField("system", T.StringType())])
SURVEY = T.StructType(
    [
        T.StructField("generation_plan", T.StringType()),
        T.StructField("turns", T.ArrayType(TURN)),
        T.StructField("raw_conversation", T.StringType()),
        T.StructField(
            "metadata",
            T.StructType(
                [
                    T.StructField("individual_id", T.LongType()),
                    T.StructField("is_critical", T.BooleanType()),
                    T.StructField("judge_dimensions", T.MapType(T.StringType(), T.IntegerType())),
                    T.StructField("fitness_scores", T.MapType(T.StringType(), T.DoubleType())),
                    T.StructField("generation_time_seconds", T.DoubleType()),
                ]
            ),
        ),
    ]
)
POI = "name string, address string, city string, latitude double, longitude double, stars double, categories string, attributes map<string,string>, hours map<string,string>"


def pois(spark: SparkSession, path: str, city: str | None = None, limit: int | None = None) -> DataFrame:
    """JSON lines of points of interest, with price level ($ to $$$$), parking and text; ``city`` is a case-insensitive part."""
    rows = spark.read.schema(POI).json(path)
    if city:
        rows = rows.filter(F.contains(F.lower("city"), F.lit(city.lower())))
    if limit is not None:
        rows = rows.limit(limit)
    attribute = lambda k: F.try_element_at("attributes", F.lit(k))
    price = attribute("RestaurantsPriceRange2").try_cast("int")
    return rows.withColumnsRenamed({"stars": "rating", "categories": "category", "hours": "opening_hours"}).select(
        "*",
        F.when(price.between(1, 4), F.repeat(F.lit("$"), price)).alias("price_level"),
        F.coalesce(F.contains(F.lower(attribute("BusinessParking")), F.lit("true")), F.lit(False)).alias("parking"),
        F.concat_ws(" | ", "name", "category", "city").alias("text"),
    )


def survey_conversations(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document a file."""
    return spark.read.schema(SURVEY).option("multiLine", True).json(path).withColumn("file", F.element_at(F.split("_metadata.file_path", "/"), -1))


def feature_config(spark: SparkSession, path: str) -> DataFrame:
    """grp, pos, name, values, lb, ub of the feature lists of a JSON configuration."""
    item = "array<struct<name:string,values:array<string>,distribution:array<double>,lb:double,ub:double>>"
    groups = ("categorical", "ordinal", "continuous")
    rows = spark.read.schema(", ".join(f"{g}_features {item}" for g in groups)).option("multiLine", True).json(path)
    parts = [rows.select(F.lit(g).alias("grp"), F.posexplode(f"{g}_features").alias("pos", "f")).select("grp", "pos", "f.*") for g in groups]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def rater_tables(spark: SparkSession, path: str, dimensions: list[str]) -> DataFrame:
    """item, rater (file name), dimension, label from one CSV a rater."""
    rows = spark.read.option("header", True).csv(path).withColumn("rater", F.regexp_replace(F.element_at(F.split("_metadata.file_path", "/"), -1), r"\.csv$", ""))
    missing = {"conversation_id", *dimensions} - set(rows.columns)
    if missing:
        raise ValueError(f"rater tables lack {sorted(missing)}")
    pairs = F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).try_cast("int").alias("label")) for d in dimensions)))
    return rows.select(F.col("conversation_id").alias("item"), "rater", pairs.alias("p")).select("item", "rater", "p.*")


def test_cases(spark: SparkSession, path: str) -> DataFrame:
    """x, f (map of Fitness_ columns) and is_critical of test case CSVs; repeated header rows are dropped."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    fitness = [c for c in rows.columns if c.startswith("Fitness_")]
    inputs = rows.columns[: rows.columns.index(fitness[0])]
    rows = rows.filter(F.col(inputs[0]).isNull() | (F.col(inputs[0]) != inputs[0]))
    entries = [x for c in fitness for x in (F.lit(c.removeprefix("Fitness_")), F.col(c).try_cast("double"))]
    return rows.select(F.struct(*inputs).alias("x"), F.create_map(*entries).alias("f"), F.col("Critical").try_cast("double").cast("int").cast("boolean").alias("is_critical"))


def generations(spark: SparkSession, path: str) -> DataFrame:
    """Test cases of gen_<n>.csv files with their generation."""
    rows = spark.read.option("header", True).csv(path)
    return rows.withColumn("gen", F.regexp_extract("_metadata.file_path", r"gen_(\d+)\.csv$", 1).cast("int"))


def summary(spark: SparkSession, path: str) -> DataFrame:
    """One row of the Attribute, Value pairs of each summary file, as a map."""
    rows = spark.read.option("header", True).csv(path).select(F.col("_metadata.file_path").alias("file"), "Attribute", "Value")
    return rows.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("Attribute", "Value"))).alias("attributes"))


def run_names(rows: DataFrame, name: str, created: str) -> DataFrame:
    """sut, algo and seed of run names like 'algo_sut_seed3', newest row of each name."""
    newest = rows.groupBy(name).agg(F.max_by(F.struct(*rows.columns), created).alias("r")).select("r.*")
    part = lambda i: F.regexp_extract(name, r"^([^_]+)_(.+?)_seed(\d+)", i)
    return newest.select("*", part(1).alias("algo"), part(2).alias("sut"), part(3).try_cast("int").alias("seed"))


LOG = "file string, topics map<string,string>, conv_time double, resp_times array<double>, turns array<struct<role:string,text:string>>, errors array<string>"
ENTRY = re.compile(r"^\s*-\s*(User|Assistant):\s*(.*)$")


def parse_log(content: str) -> dict:
    """A conversation log of several YAML documents, read line by line: files that no strict parser accepts still give their turns."""
    turns: list[dict] = []
    times: list[float] = []
    errors: list[str] = []
    topics: dict[str, str] = {}
    conv_time, part = None, ""
    for line in content.splitlines():
        plain = line.strip()
        found = ENTRY.match(line)
        if found:
            turns.append({"role": found[1].lower(), "text": found[2].strip("'\"")})
        elif plain.startswith("conversation time:"):
            conv_time = float(plain.split(":", 1)[1])
        elif re.fullmatch(r"[\w ]+:", plain):
            part = plain[:-1]
        elif part == "assistant response time" and re.fullmatch(r"-\s*[0-9.]+", plain):
            times.append(float(plain[1:]))
        elif part == "errors" and plain.startswith("-"):
            errors.append(plain[1:].strip())
        elif turns and line.startswith(" ") and part == "interaction" and plain:
            turns[-1]["text"] += " " + plain.strip("'\"")
        elif part == "" and ":" in plain and not plain.startswith("-"):
            key, value = plain.split(":", 1)
            topics[key.strip()] = value.strip()
    return {"topics": topics, "conv_time": conv_time, "resp_times": times, "turns": turns, "errors": errors}


def conversation_logs(spark: SparkSession, path: str) -> DataFrame:
    """Logs below a folder; report files are skipped."""

    def parse(frames):
        for frame in frames:
            rows = [{"file": p} | parse_log(bytes(c).decode("utf-8", "replace")) for p, c in zip(frame["path"], frame["content"], strict=True)]
            yield pd.DataFrame(rows, columns=["file", "topics", "conv_time", "resp_times", "turns", "errors"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.y*ml").load(path)
    return files.filter(~F.col("path").contains("__report__")).select("path", "content").mapInPandas(parse, LOG)


def rule_fields(content: str) -> dict[str, str]:
    """Fields of a flat rule file: "key: value" lines, quoted values, > and | blocks, comments."""
    fields: dict[str, str] = {}
    key, joint, lines = None, " ", []
    for line in [*content.splitlines(), "end:"]:
        found = re.match(r"([A-Za-z_]+):(?:\s+(.*))?$", line)
        if not found:
            if key is not None and (line.startswith(" ") or not line.strip()):
                lines.append(line.strip())
            continue
        if key is not None:
            fields[key] = joint.join(lines).strip()
        key, value = found[1], (found[2] or "").strip()
        quoted = re.match(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*')\s*(?:#.*)?$""", value)
        if quoted:
            value = quoted[1][1:-1].replace("''", "'") if quoted[1][0] == "'" else quoted[1][1:-1].replace('\\"', '"')
        else:
            value = re.sub(r"(^|\s)#.*$", "", value).strip()
        joint = "\n" if value[:1] == "|" else " "
        lines = [] if value[:1] in (">", "|") and len(value) < 3 else [value]
    return fields


def rules(spark: SparkSession, path: str) -> list:
    """Rules of the .yaml and .yml files below a folder, by file name; they are few and small, and compiled on the driver."""
    from colloquy.operators.rules import file_rule

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.y*ml").load(path)
    return [file_rule(rule_fields(bytes(r.content).decode("utf-8", "replace"))) for r in files.select("path", "content").orderBy("path").collect()]


def comparison_csv(spark: SparkSession, path: str, metric: str) -> DataFrame:
    """algorithm, n, mean and sigma of a table of curves side by side, whose columns are <name>_n_evals, <name>_<metric> and <name>_<metric>_sigma."""
    rows = spark.read.option("header", True).csv(path)
    names = [c.removesuffix("_n_evals") for c in rows.columns if c.endswith("_n_evals")]
    number = lambda c: F.col(f"`{c}`").try_cast("double")
    each = [F.struct(F.lit(a).alias("algorithm"), number(f"{a}_n_evals").cast("long").alias("n"), number(f"{a}_{metric}").alias("mean"), number(f"{a}_{metric}_sigma").alias("sigma")) for a in names]
    if not each:
        raise ValueError(f"{path} has no <name>_n_evals columns")
    return rows.select(F.inline(F.array(*each))).filter("n is not null")


def majority_labels(spark: SparkSession, path: str, label: str) -> DataFrame:
    """conversation (name of the file, without folders) and label of a CSV of majority votes; rows without either are left out, of a name that stands twice the larger label stays."""
    rows = spark.read.option("header", True).csv(path)
    name = F.element_at(F.split(F.translate("conversation_id", "\\", "/"), "/"), -1)
    found = rows.select(name.alias("conversation"), F.col(label).try_cast("int").alias("label"))
    return found.dropna().groupBy("conversation").agg(F.max("label").alias("label"))


def utterance_corpus(spark: SparkSession, csv: str, column: str, seeds: str | None = None, most: int | None = None) -> DataFrame:
    """text and source of the non-empty utterances of a CSV column (``most`` of them, in order of their hashes), and of a JSON file of seeds, a list of texts."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(csv).select(F.col(column).alias("text"), F.lit("corpus").alias("source")).filter("text is not null")
    if most is not None:
        rows = rows.orderBy(F.xxhash64("text"), "text").limit(most)
    if seeds is None:
        return rows
    listed = spark.read.text(seeds, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("text"), F.lit("seed").alias("source"))
    return rows.unionByName(listed.filter("text is not null"))
