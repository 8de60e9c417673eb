"""URL filter: sort-merge range join of urls with nested prefix rules, DataFrame functions only.

A rule (host, path, verdict) fits its host and all subdomains where the url's path starts with the
rule's. In keys made of the reversed host and the path, a rule is the interval [path, path + 0xFF)
under its reversed host; intervals of a host nest or are disjoint. A sweep over their sorted ends
keeps a stack: the running sum of +1 (start) and -1 (end) is its height, and the last start at a
height is what that slot holds. That gives disjoint segments labelled by the innermost rule; urls
sorted among the segment starts take the last label before them.

Cases: a null url or one without ``://`` has an empty host and path and no rule. Repeated rows stay.
A rule given twice counts once, block before allow; rules with nulls are left out. Among rules that
fit, the longest host+path wins, then the deeper host. Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import n_partitions

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rules of the query op7_url_filters: host, path, verdict.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def reversed_host(host: Column, depth: int | None = None) -> Column:
    labels = F.reverse(F.split(host, r"\."))
    return F.array_join(labels if depth is None else F.slice(labels, 1, depth), ".")


def rule_segments(rules: DataFrame) -> DataFrame:
    """(depth, grp, key, top): from ``key`` on, urls of the host ``grp`` are in the rule ``top``."""
    clean = (
        rules.select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict")
        .dropna()
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))
        .select(
            F.size(F.split("host", r"\.")).alias("depth"),
            reversed_host(F.col("host")).alias("grp"),
            F.struct(
                F.length(F.concat("host", "path")).alias("size"),
                F.size(F.split("host", r"\.")).alias("depth"),
                F.concat("host", "path").alias("rule"),
                "verdict",
            ).alias("rule"),
            F.col("path").cast("binary").alias("first"),
        )
    )
    ends = clean.select(
        "depth",
        "grp",
        F.inline(
            F.array(
                F.struct(F.col("first").alias("key"), F.lit(1).alias("step"), F.col("rule").alias("pushed")),
                F.struct(F.concat("first", F.lit(b"\xff")).alias("key"), F.lit(-1).alias("step"), F.lit(None).cast(clean.schema["rule"].dataType).alias("pushed")),
            )
        ),
    )
    sweep = Window.partitionBy("depth", "grp").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    slot = Window.partitionBy("depth", "grp", "height").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    return (
        ends.withColumn("height", F.sum("step").over(sweep))
        .withColumn("top", F.when(F.col("height") > 0, F.last("pushed", ignorenulls=True).over(slot)))
        .select("depth", "grp", "key", "top")
    )


def url_filter(pages: DataFrame, rules: DataFrame, default: str = "allow", salts: int | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of ``pages`` (page_id, url).

    One sort of the urls for each host depth among the rules (a handful). Urls of a busy host are
    dealt over ``salts`` groups (default: the shuffle partitions), which each get that host's
    segments, so no host is one task's work.
    """
    salts = salts or n_partitions(pages.sparkSession)
    segments = rule_segments(rules)
    host, path = host_and_path(F.coalesce("url", F.lit("")))
    now = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("best", F.lit(None).cast(segments.schema["top"].dataType))
    for (depth,) in sorted(segments.select("depth").distinct().collect()):
        labels = F.size(F.split("host", r"\."))
        urls = now.select(
            "*",
            F.when(labels >= depth, reversed_host(F.col("host"), depth)).alias("grp"),
            (F.monotonically_increasing_id() % salts).cast("int").alias("salt"),
            F.col("path").cast("binary").alias("key"),
            F.lit(None).cast(f"struct<top:{segments.schema['top'].dataType.simpleString()}>").alias("mark"),
            F.lit(1).alias("kind"),
        )
        marks = segments.filter(F.col("depth") == depth).select(
            "grp",
            F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"),
            "key",
            F.struct("top").alias("mark"),
            F.lit(0).alias("kind"),
        )
        order = Window.partitionBy("grp", "salt").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
        found = F.last("mark", ignorenulls=True).over(order)["top"]
        now = (
            urls.unionByName(marks, allowMissingColumns=True)
            .withColumn("found", F.when(F.col("grp").isNotNull(), found))
            .filter("kind = 1")
            .select("page_id", "host", "path", F.greatest("best", "found").alias("best"))
        )
    return now.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.array(*(F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in RULES))
    rules = spark.range(1).select(F.inline(rows))
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT row_number() OVER () AS n, page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(h, s, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (
  SELECT n, arg_max(h || s, length(h || s)) AS rule, arg_max(v, length(h || s)) AS verdict
  FROM p JOIN r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.s) GROUP BY n)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (n)
"""
