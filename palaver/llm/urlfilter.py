"""URL filter lists as a sort-merge range join.

A rule (host, path prefix) fits its host and all subdomains. Its canonical key is the host with its labels reversed, a
slash, and the path; the keys it fits are one interval that starts with the rule's key. A url gives one key for each of its
host's suffixes, so fitting means that the rule's key is a prefix of one of them. Rules and distinct url keys are sorted
together into ranges and slices; a sweep over each slice keeps the stack of rules that are open at that point, starting with
those that were open before the slice. All steps are DataFrame functions.

Defined results: a null url, or one without ``://``, has an empty host and path and fits nothing; of fitting rules the
longest text wins, then the longest host, then ``block``; repeated rules and rows are judged alike; with no rules every row
gets the default; other columns are carried along, output columns replace columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.llm.shared import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLICE_ROWS = 256
OUTPUT = ("host", "path", "rule", "verdict")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` up to ``/``, ``?``, ``#``; path from there up to ``?`` or ``#``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def _key(labels: Column, path: Column) -> Column:
    return F.concat(F.array_join(F.reverse(labels), "."), F.lit("/"), path)


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``. ``rules`` has host, path and action."""
    kept = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in OUTPUT]
    host, path = host_and_path(F.col(f"`{url}`"))
    rows = pages.select(*kept, host.alias("host"), path.alias("path"))
    text = F.concat("host", "path")
    listed = rules.filter(F.col("host").isNotNull() & F.col("path").isNotNull()).select(
        _key(F.split(F.translate("host", UPPER, LOWER), r"\."), F.col("path")).alias("key"),
        F.struct(F.length(text).alias("size"), F.length("host").alias("host_size"), (F.col("action") == "block").alias("block"), text.alias("text"), F.col("action").alias("action")).alias("rule"),
    )
    listed = listed.groupBy("key").agg(F.max("rule").alias("rule"))

    # No rule looks further than this: labels from the host's end, characters of the path. One row.
    reach = rules.agg(F.max(F.size(F.split("host", r"\."))).alias("labels"), F.max(F.length("path")).alias("path"), F.max(F.length("host") + F.length("path") + 1).alias("key")).first()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(reach["labels"] or 1))), lambda i: F.slice(labels, -i, i))
    rows = rows.withColumn("_head", F.substring("path", 1, reach["path"] or 0))
    distinct = written(rows.select("host", "_head").filter(F.col("host") != "").distinct(), "urls")
    keyed = distinct.select("host", "_head", F.explode(suffixes).alias("s")).select("host", "_head", _key(F.col("s"), F.col("_head")).alias("key"))

    none = F.lit(None).cast(listed.schema["rule"].dataType)
    events = listed.select("key", F.lit(0).alias("kind"), "rule").unionByName(keyed.select("key").distinct().select("key", F.lit(1).alias("kind"), none.alias("rule")))
    parts = max(1, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = written(events.repartitionByRange(parts, "key", "kind").withColumn("range", F.spark_partition_id()), "events")
    number = F.row_number().over(Window.partitionBy("range").orderBy("key", "kind"))
    sliced = ranged.withColumn("slice", F.floor((number - 1) / slice_rows))
    slices = written(sliced.groupBy("range", "slice").agg(F.sort_array(F.collect_list(F.struct("key", "kind", "rule"))).alias("events")), "slices")

    # rules open before a slice begins: those whose key is a prefix of its first key
    first = F.col("events")[0]["key"]
    lows = slices.select("range", "slice", first.alias("low")).select("range", "slice", "low", F.explode(F.sequence(F.lit(1), F.least(F.length("low"), F.lit(reach["key"] or 1)))).alias("n"))
    opened = lows.select("range", "slice", F.expr("substring(low, 1, n)").alias("key")).join(listed, "key")
    opened = opened.groupBy("range", "slice").agg(F.sort_array(F.collect_list(F.struct("key", "rule"))).alias("open"))

    best = F.struct(F.col("open").alias("stack"), F.expr("cast(array() as array<struct<key:string,rule:" + none_type(listed) + ">>)").alias("out"))
    swept = (
        slices.join(opened, ["range", "slice"], "left")
        .withColumn("open", F.coalesce("open", F.expr("cast(array() as array<struct<key:string,rule:" + none_type(listed) + ">>)")))
        .select(F.aggregate("events", best, _sweep, lambda s: s["out"]).alias("out"))
        .select(F.inline("out"))
    )
    found = keyed.join(swept, "key").groupBy("host", "_head").agg(F.max("rule").alias("_won"))
    return rows.join(found, ["host", "_head"], "left").select(
        *[F.col(f"`{c}`") for c in rows.columns if c != "_head"],
        F.col("_won.text").alias("rule"), F.coalesce(F.col("_won.action"), F.lit(default)).alias("verdict"),
    )


def none_type(listed: DataFrame) -> str:
    return listed.schema["rule"].dataType.simpleString()


def _sweep(state: Column, event: Column) -> Column:
    """Close the rules that the key has left; open a rule, or give a url key the longest rule that is open."""
    stack = F.filter(state["stack"], lambda r: F.startswith(event["key"], r["key"]))
    rule = F.struct(event["key"].alias("key"), event["rule"].alias("rule"))
    won = F.struct(event["key"].alias("key"), F.array_max(F.transform(stack, lambda r: r["rule"])).alias("rule"))
    is_rule = event["kind"] == 0
    return F.struct(
        F.when(is_rule, F.concat(stack, F.array(rule))).otherwise(stack).alias("stack"),
        F.when(is_rule | (F.size(stack) == 0), state["out"]).otherwise(F.concat(state["out"], F.array(won))).alias("out"),
    )
