"""URL filters by a sort-merge range join over reversed-host canonical keys.

A rule (host, path, verdict) fits a URL whose host is the rule's or a subdomain of it and whose path starts with
the rule's path. Prefixes are intervals of sorted keys, and intervals of prefixes nest. Two sweeps take them:

1. by host: the key is the reversed host, closed by a dot; a rule host is the interval of all hosts below it;
2. by path: a URL stands at reversed rule host + / + path for each rule host around it; a rule is the interval of its path.

A sweep sorts starts of intervals and points into ranges of keys. Each start pops the entries of the stack that don't hold
it and is pushed; a point takes the stack of the last start before it, without the entries that don't hold the point. A range
begins with the stack that the ranges before it hand over: the rules that hold its first key. So no rule is repeated, and a hot
host, or a single URL in a third of all rows, is cut into ranges like any other rows.

Defined results: a null URL or one without :// has an empty host and path and gets the default verdict; of
rules of equal length that with the longer host wins, then the smaller text; of repeated rules block wins; a rule
without a host or a verdict, or with a path that no URL can have, fits nothing; repeated rows of the input are kept, as are rows
without an id; very long URLs are judged whole; other columns are not read, whatever their names; an empty rule table gives the
default everywhere, an empty table of pages no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged

#: Starts and points that one range of a sweep takes in the mean.
ROWS_PER_SWEEP = 100_000
#: Starts that one fold of the stack takes; each fold begins with a stack of its own.
STARTS_PER_FOLD = 256
RULE_SCHEMA = "host string, path string, verdict string"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (after the first ://, A-Z lower-cased) and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return lower_ascii(host), path


def lower_ascii(host: Column) -> Column:
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(list(rules), RULE_SCHEMA)


def host_key(host: Column) -> Column:
    """Labels from the last to the first, each closed by a dot: the key of a host begins those of its subdomains."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def sweep(points: DataFrame, starts: DataFrame, name: str) -> DataFrame:
    """Points (key, ...) with `stack`: the rules among starts (key, rule; keys distinct) whose keys begin the point's, shortest first.

    Points and starts should be staged, as they are counted and sampled before they are sorted.
    """
    rule_type = starts.schema["rule"].dataType
    entry = F.struct("key", "rule")
    stack_type = f"array<struct<key:string,rule:{rule_type.simpleString()}>>"
    payload = [c for c in points.columns if c != "key"]
    # a start comes before the points of its key; points of one key may lie in several ranges
    turn = F.lit(1) + F.pmod(F.xxhash64(*payload), F.lit(1 << 30))
    events = starts.select("key", F.lit(0).cast("long").alias("_turn"), "rule", *(F.lit(None).cast(points.schema[c].dataType).alias(c) for c in payload)).unionByName(
        points.select("key", turn.alias("_turn"), F.lit(None).cast(rule_type).alias("rule"), *payload)
    )
    ranges = 1 + (points.count() + starts.count()) // ROWS_PER_SWEEP
    events = staged(events.repartitionByRange(ranges, "key", "_turn").withColumn("_range", F.spark_partition_id()), name)

    pushed = events.where("_turn = 0").select("_range", "key", "rule")
    turn_of = F.row_number().over(Window.partitionBy("_range").orderBy("key"))
    pushed = pushed.withColumn("_fold", F.floor((turn_of - 1) / F.lit(STARTS_PER_FOLD)))
    folds = pushed.groupBy("_range", "_fold").agg(F.array_sort(F.collect_list(entry)).alias("_starts"))
    firsts = events.groupBy("_range").agg(F.min("key").alias("_head"))
    # what is handed over: of the first key of a range all rules that hold it, of the first start of a fold those around it
    heads = folds.select("_range", "_fold", F.col("_starts")[0]["key"].alias("_head"), (F.length(F.col("_starts")[0]["key"]) - 1).alias("_most"))
    heads = heads.unionByName(firsts.select("_range", F.lit(-1).cast("long").alias("_fold"), "_head", F.length("_head").alias("_most")))
    lengths = [r[0] for r in starts.select(F.length("key")).distinct().collect()]  # no more than the longest rule has characters
    fitting = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.col("_most"))
    around = heads.select("_range", "_fold", "_head", F.explode(fitting).alias("_n")).select("_range", "_fold", F.substr("_head", F.lit(1), F.col("_n")).alias("key"))
    handed = around.join(starts.select("key", "rule"), "key").groupBy("_range", "_fold").agg(F.array_sort(F.collect_list(entry)).alias("_handed"))

    empty = F.array().cast(stack_type)
    begun = F.struct(F.coalesce("_handed", empty).alias("stack"), F.array().cast(f"array<{stack_type}>").alias("stacks"))

    def push(state: Column, start: Column) -> Column:
        stack = F.concat(F.filter(state["stack"], lambda e: F.startswith(start["key"], e["key"])), F.array(start))
        return F.struct(stack.alias("stack"), F.concat(state["stacks"], F.array(stack)).alias("stacks"))

    stacks = folds.join(handed, ["_range", "_fold"], "left").select("_range", F.explode(F.aggregate("_starts", begun, push, lambda s: s["stacks"])).alias("stack"))
    stacks = stacks.select("_range", F.element_at("stack", -1)["key"].alias("key"), F.lit(0).cast("long").alias("_turn"), "stack")
    opening = handed.where("_fold = -1").select("_range", F.lit("").alias("key"), F.lit(-1).cast("long").alias("_turn"), F.col("_handed").alias("stack"))
    merged = stacks.unionByName(opening).unionByName(events.where("_turn > 0").drop("rule"), allowMissingColumns=True)
    order = Window.partitionBy("_range").orderBy("key", "_turn").rowsBetween(Window.unboundedPreceding, 0)
    swept = merged.withColumn("stack", F.last("stack", ignorenulls=True).over(order)).where("_turn > 0")
    held = F.filter(F.coalesce("stack", empty), lambda e: F.startswith(F.col("key"), e["key"]))
    return swept.select("key", *payload, held.alias("stack"))


def url_filter(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """Per row of pages: id, host, path, rule (host + path of the deciding rule, else null) and verdict."""
    host, path = url_parts(F.col(url))
    rows = pages.select(F.col(id_col).alias("_id"), host.alias("_host"), path.alias("_path")).groupBy("_id", "_host", "_path").agg(F.count("*").alias("_n"))
    rows = staged(rows, "url-rows")
    clean = rules.select(F.lower("host").alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").where("host is not null and verdict is not null")
    clean = clean.where((F.col("path") == "") | F.startswith("path", F.lit("/"))).where(~F.contains("host", F.lit("/")))
    clean = clean.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # block after allow
    clean = staged(clean.withColumn("key", host_key(F.col("host"))), "url-rules")

    by_host = sweep(rows.where("_host <> ''").withColumn("key", host_key(F.col("_host"))), clean.select("key", F.col("key").alias("rule")).distinct(), "url-hosts")
    points = by_host.select(*rows.columns, F.explode("stack.key").alias("_at"))
    points = staged(points.select(F.concat("_at", F.lit("/"), "_path").alias("key"), *rows.columns), "url-points")
    best = F.struct((F.length("host") + F.length("path")).alias("n"), F.length("host").alias("h"), "host", "path", "verdict")
    starts = staged(clean.select(F.concat("key", F.lit("/"), "path").alias("key"), best.alias("rule")), "url-starts")
    by_path = sweep(points, starts, "url-paths")

    none = F.lit(None).cast(starts.schema["rule"].dataType)
    every = by_path.where(F.size("stack") > 0).select(*rows.columns, F.element_at("stack", -1)["rule"].alias("_best")).unionByName(rows.select(*rows.columns, none.alias("_best")))
    judged = every.groupBy("_id", "_host", "_path").agg(F.max("_n").alias("_n"), F.max("_best").alias("_best"))
    judged = judged.withColumn("_again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    return judged.select(
        F.col("_id").alias(id_col),
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.when(F.col("_best").isNotNull(), F.concat("_best.host", "_best.path")).alias("rule"),
        F.coalesce("_best.verdict", F.lit(default)).alias("verdict"),
    )
