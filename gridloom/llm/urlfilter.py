"""URL rules by a sort-merge range join (DataFrame functions only).

A host's labels are reversed and each closed by a dot (``blog.example.net`` -> ``net.example.blog.``), so a
rule's host and all its subdomains are one interval of keys, and intervals nest or are disjoint. The ends of the rules'
intervals and the distinct hosts of the urls are dealt by ranges of the key and swept in order: a running sum tells how many
intervals are open, and the last one opened at each depth is the stack. What is open at a range's border comes from one row
for each range before it. A url then takes, of its host's open rules, the longest whose path starts its own path.

Rules are rows of a table (a list is made one), so their number is bounded by the cluster, not by the driver. A host that many
urls share is swept once; urls find their host's rules by a join, in which hosts with more than a quarter of a task's share
of all urls (at most four a task) are broadcast and all others are shuffled.

Defined cases: a null url or one without ``://`` has empty host and path, fits no rule and is blocked as
not addressable; all other urls without a rule are allowed. Hosts compare with A-Z folded, paths exactly; of rules with the same host
and path the last of a list counts, and block in a table; rules of null host, path or action count for nothing. Null page ids and
repeated rows are judged like any other, very long urls whole; empty tables of pages or rules do no harm; other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import ascii_lower, checkpointed, partitions

#: (action, host, path)
RULES: tuple[tuple[str, str, str], ...] = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
UNREACHABLE, OTHERWISE = "block", "allow"
END, START, HOST = range(3)  # in this order at one key


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 2), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, "[.]")), "."), F.lit("."))


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]] | DataFrame) -> DataFrame:
    """(key, opened): the rules (rule, path, action) of each host that has some. rules has action, host and path."""
    if not isinstance(rules, DataFrame):
        listed = [{"place": i, "action": a, "host": h, "path": p} for i, (a, h, p) in enumerate(rules)]
        rules = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(listed)), "array<struct<place:int,action:string,host:string,path:string>>")))
    place = F.col("place") if "place" in rules.columns else (F.col("action") == "block").cast("int")
    rows = rules.select("action", ascii_lower(F.col("host")).alias("host"), "path", place.alias("place")).dropna(subset=["action", "host", "path"])
    rows = rows.groupBy("host", "path").agg(F.max_by("action", "place").alias("action"))
    own = F.struct(F.concat("host", "path").alias("rule"), "path", "action")
    return rows.groupBy(host_key(F.col("host")).alias("key")).agg(F.sort_array(F.collect_list(own)).alias("opened"))


def open_rules(hosts: DataFrame, rules: DataFrame, parts: int) -> DataFrame:
    """(key, open) of the keys of hosts that lie in an interval: all rules (rule, path, action) whose host is the key's or above it."""
    spark = hosts.sparkSession
    none = F.lit(None).cast(dict(rules.dtypes)["opened"])
    starts = rules.select("key", F.lit(START).alias("kind"), F.lit(1).alias("step"), "opened")
    ends = rules.select(F.concat(F.expr("substring(key, 1, length(key) - 1)"), F.lit("/")).alias("key"), F.lit(END).alias("kind"), F.lit(-1).alias("step"), none.alias("opened"))  # "/" follows "."
    swept = starts.unionByName(ends).unionByName(hosts.select("key", F.lit(HOST).alias("kind"), F.lit(0).alias("step"), none.alias("opened")))
    swept = checkpointed(swept.repartitionByRange(parts, "key", "kind").withColumn("part", F.spark_partition_id()))
    along = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over one row a range
    opened_before = swept.groupBy("part").agg(F.sum("step").alias("net")).select("part", F.coalesce(F.sum("net").over(before), F.lit(0)).alias("ahead"))
    swept = swept.join(F.broadcast(opened_before), "part").withColumn("depth", F.col("ahead") + F.sum("step").over(along))
    deepest = swept.agg(F.max("depth")).first()[0] or 0  # no host nests deeper than it has labels
    if not deepest:
        return spark.range(0).select(F.lit("").alias("key"), none.alias("open"))
    at = lambda d: (F.col("kind") == START) & (F.col("depth") == d)
    levels = range(1, deepest + 1)
    left = swept.groupBy("part").agg(*(F.max_by("opened", F.when(at(d), F.col("key"))).alias(f"left{d}") for d in levels))
    carried = left.select("part", *(F.last(f"left{d}", ignorenulls=True).over(before).alias(f"carried{d}") for d in levels))
    swept = swept.join(F.broadcast(carried), "part")
    stack = swept.select("key", "kind", "depth", *(F.coalesce(F.last(F.when(at(d), F.col("opened")), ignorenulls=True).over(along), F.col(f"carried{d}")).alias(f"level{d}") for d in levels))
    open_ = F.flatten(F.filter(F.array(*(F.when(F.col("depth") >= d, F.col(f"level{d}")) for d in levels)), lambda x: x.isNotNull()))
    return stack.where((F.col("kind") == HOST) & (F.col("depth") > 0)).select("key", open_.alias("open"))


def judge(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame = RULES, page_id: str = "page_id", url: str = "url", parts: int | None = None,
) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule (null if none fits) and verdict."""
    spark = pages.sparkSession
    parts = parts or partitions(spark)
    urls = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"))
    urls = urls.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn("key", host_key(F.col("host")))
    hosts = checkpointed(urls.groupBy("key").agg(F.count("*").alias("n")))
    known = open_rules(hosts, rule_table(spark, rules), parts)
    share = F.coalesce(hosts.agg(F.sum("n").alias("n")).select("n").scalar() / (4 * parts), F.lit(0))
    known = checkpointed(known.join(hosts, "key").withColumn("hot", F.col("n") > share))
    hot = known.where("hot").select("key", F.col("open").alias("hot_open"))  # at most 4 * parts rows
    joined = urls.join(F.broadcast(hot), "key", "left")
    rest = joined.where("hot_open is null").join(known.where("not hot").select("key", "open"), "key", "left").drop("hot_open")
    judged = joined.where("hot_open is not null").withColumnRenamed("hot_open", "open").unionByName(rest, allowMissingColumns=True)
    fits = F.transform(F.filter("open", lambda r: F.startswith(F.col("path"), r["path"])), lambda r: F.struct(F.length(r["rule"]).alias("a"), (-F.length(r["path"])).alias("b"), r["rule"].alias("rule"), r["action"].alias("action")))
    judged = judged.withColumn("best", F.array_max(fits))
    other = F.when(F.col("host") == "", F.lit(UNREACHABLE)).otherwise(F.lit(OTHERWISE))
    return judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.action"), other).alias("verdict"))
