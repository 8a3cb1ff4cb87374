"""Cost, latency, memory and log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from palaver.operators import telemetry, topics
from palaver.queries import tables
from palaver.queries.registry import query

SQL = tables.SQL
SQL["t_priced"] = """
SELECT c.*, (greatest(in_tok - cached_in, 0) * coalesce(p.input, 0) + cached_in * coalesce(p.cached_input, 0) + out_tok * coalesce(p.output, 0)) / 1000000e0
    * CASE WHEN batch THEN 0.5e0 ELSE 1 END AS cost_usd
FROM t_calls c LEFT JOIN t_prices p ON p.model = c.model"""
SQL["t_steps"] = """
SELECT run_id, step, count(*) AS calls, sum(in_tok) AS in_tok, sum(out_tok) AS out_tok, sum(cached_in) AS cached_in, sum(latency_s) AS latency_s,
  sum(cost_usd) AS cost_usd, arg_max(model, {'a': seq, 'b': in_tok, 'c': cached_in, 'd': latency_s, 'e': model}) AS model FROM t_priced GROUP BY 1, 2"""
LAST = ["seq", "in_tok", "cached_in", "latency_s", "model"]


def priced(spark, sf):
    return telemetry.price_calls(tables.calls(spark, sf), tables.prices(spark))


def steps(spark, sf):
    return telemetry.step_rollup(priced(spark, sf), LAST)


@query("price_join", "SELECT run_id, seq, model, in_tok, out_tok, cached_in, batch, round(cost_usd, 10) AS cost_usd FROM t_priced")
def price_join(spark, sf):
    out = priced(spark, sf).withColumn("cost_usd", F.round("cost_usd", 10))
    return out.select("run_id", "seq", "model", "in_tok", "out_tok", "cached_in", "batch", "cost_usd")


@query(
    "step_rollup",
    """SELECT run_id, step, calls, CAST(in_tok AS BIGINT) AS in_tok, CAST(out_tok AS BIGINT) AS out_tok, CAST(cached_in AS BIGINT) AS cached_in,
       round(latency_s, 2) AS latency_s, round(cost_usd, 10) AS cost_usd, model FROM t_steps""",
)
def step_rollup(spark, sf):
    return steps(spark, sf).withColumns({"latency_s": F.round("latency_s", 2), "cost_usd": F.round("cost_usd", 10)})


@query(
    "run_totals",
    """SELECT run_id, step, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(in_tok) AS BIGINT) AS in_tok, CAST(sum(out_tok) AS BIGINT) AS out_tok,
         CAST(sum(cached_in) AS BIGINT) AS cached_in, round(sum(latency_s), 2) AS latency_s, round(sum(cost_usd), 10) AS cost_usd
       FROM t_steps GROUP BY GROUPING SETS ((run_id, step), (run_id))""",
)
def run_totals(spark, sf):
    out = telemetry.run_totals(steps(spark, sf))
    return out.withColumns({"latency_s": F.round("latency_s", 2), "cost_usd": F.round("cost_usd", 10)})


@query(
    "run_compare",
    """SELECT run_id, round(sum(cost_usd) FILTER (WHERE step = 'A'), 10) AS A, round(sum(cost_usd) FILTER (WHERE step = 'N'), 10) AS N,
         round(sum(cost_usd) FILTER (WHERE step = 'R'), 10) AS R, round(sum(cost_usd), 10) AS total FROM t_steps GROUP BY 1""",
)
def run_compare(spark, sf):
    out = telemetry.run_compare(steps(spark, sf), ["A", "N", "R"])
    return out.select("run_id", *[F.round(c, 10).alias(c) for c in ("A", "N", "R", "total")])


@query("models_by_step", "SELECT run_id, string_agg(step || '=' || model, ',' ORDER BY step) AS models FROM t_steps GROUP BY 1")
def models_by_step(spark, sf):
    out = telemetry.models_by_step(steps(spark, sf))
    pairs = F.transform(F.map_entries("models"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return out.select("run_id", F.array_join(pairs, ",").alias("models"))


SQL["t_variants"] = """
SELECT l_suppkey AS bench, CASE l_returnflag WHEN 'A' THEN 'original' WHEN 'N' THEN 'ratio_0.5' ELSE 'ratio_0.4' END AS variant,
  min(l_tax) AS compress_s, max(l_quantity) AS resume_wall_s, min(l_quantity) AS extraction_wall_s,
  CASE WHEN l_returnflag <> 'N' THEN max(l_discount) END AS plan_wall_s FROM lineitem GROUP BY l_suppkey, l_returnflag"""


def variants(spark, sf):
    li = tables.read(spark, sf, "lineitem")
    name = F.when(F.col("l_returnflag") == "A", "original").when(F.col("l_returnflag") == "N", "ratio_0.5").otherwise("ratio_0.4")
    return li.groupBy(F.col("l_suppkey").alias("bench"), "l_returnflag").agg(
        F.min("l_tax").alias("compress_s"), F.max("l_quantity").alias("resume_wall_s"),
        F.min("l_quantity").alias("extraction_wall_s"), F.max("l_discount").alias("plan_wall_s"),
    ).select(
        "bench", name.alias("variant"), "compress_s", "resume_wall_s", "extraction_wall_s",
        F.when(F.col("l_returnflag") != "N", F.col("plan_wall_s")).alias("plan_wall_s"),
    )


@query(
    "variant_totals",
    """WITH t AS (SELECT *, coalesce(compress_s, 0) + coalesce(resume_wall_s, 0) + coalesce(extraction_wall_s, 0) + coalesce(plan_wall_s, 0) AS total_s FROM t_variants)
       SELECT t.bench, t.variant, round(t.total_s, 6) AS total_s, round(t.total_s / nullif(b.total_s, 0), 6) AS ratio
       FROM t LEFT JOIN (SELECT * FROM t WHERE variant = 'original') b ON b.bench = t.bench""",
)
def variant_totals(spark, sf):
    out = telemetry.variant_totals(variants(spark, sf), ["bench"])
    return out.select("bench", "variant", F.round("total_s", 6).alias("total_s"), F.round("ratio", 6).alias("ratio"))


@query(
    "ram_peak_mean",
    """SELECT s.series_id, coalesce(max(e.rss_mb), 0) AS peak_mb, round(coalesce(avg(e.rss_mb), 0), 6) AS mean_mb
       FROM (SELECT DISTINCT series_id FROM t_samples) s LEFT JOIN (SELECT * FROM t_samples WHERE label = 'purchase') e ON e.series_id = s.series_id GROUP BY 1""",
)
def ram_peak_mean(spark, sf):
    s = tables.samples(spark, sf)
    out = telemetry.peak_mean(s.filter("label = 'purchase'"), s.select("series_id").distinct())
    return out.withColumn("mean_mb", F.round("mean_mb", 6))


@query(
    "step_durations",
    """SELECT series_id AS job_id, event_id, label AS name, CAST(printf('%.2f', lead(t) OVER (PARTITION BY series_id ORDER BY t, event_id) - t) AS DOUBLE) AS duration_s FROM t_samples""",
)
def step_durations(spark, sf):
    s = tables.samples(spark, sf).select(
        F.col("series_id").alias("job_id"), "event_id", F.col("label").alias("name"), F.col("t").alias("t_start")
    )
    return telemetry.step_durations(s, ["t_start", "event_id"]).select("job_id", "event_id", "name", "duration_s")


@query(
    "step_log_table",
    """SELECT series_id AS job_id, no, '| ' || no || ' | ' || label || ' | ' || printf('%.1f', rss_mb) || 's |' AS line FROM (
         SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t, label) AS no FROM t_samples)""",
)
def step_log_table(spark, sf):
    s = tables.samples(spark, sf).select(
        F.col("series_id").alias("job_id"), F.col("label").alias("name"), F.col("t").alias("t_start"), F.col("rss_mb").alias("duration_s")
    )
    return telemetry.step_log_lines(s)


@query(
    "post_stop_wait",
    """SELECT series_id AS job_id, round(max(t) FILTER (WHERE label = 'error') - max(t) FILTER (WHERE label = 'view'), 3) AS wait_s FROM t_samples GROUP BY 1""",
)
def post_stop_wait(spark, sf):
    event = F.when(F.col("label") == "error", "close").when(F.col("label") == "view", "stop")
    log = tables.samples(spark, sf).select(F.col("series_id").alias("job_id"), event.alias("event"), "t")
    return telemetry.post_stop_wait(log).withColumn("wait_s", F.round("wait_s", 3))


@query(
    "max_concurrency",
    """WITH e AS (SELECT label, t, 1 AS d FROM t_samples UNION ALL SELECT label, t + rss_mb * 10, -1 FROM t_samples),
       n AS (SELECT label, t, sum(d) AS d FROM e GROUP BY 1, 2)
       SELECT label, max(o) AS max_open FROM (SELECT label, CAST(sum(d) OVER (PARTITION BY label ORDER BY t) AS BIGINT) AS o FROM n) GROUP BY 1""",
)
def max_concurrency(spark, sf):
    s = tables.samples(spark, sf).select("label", "t", (F.col("t") + F.col("rss_mb") * 10).alias("done"))
    return telemetry.max_concurrency(s, ["label"], "t", "done")


@query(
    "draft_acceptance",
    "SELECT series_id, round(count(*) FILTER (WHERE label = 'purchase') / nullif(count(*) FILTER (WHERE label = 'view'), 0), 6) AS acceptance FROM t_samples GROUP BY 1",
)
def draft_acceptance(spark, sf):
    runs = tables.samples(spark, sf).groupBy("series_id").agg(
        F.count_if(F.col("label") == "purchase").alias("accepted"), F.count_if(F.col("label") == "view").alias("drafted")
    )
    return telemetry.draft_acceptance(runs).select("series_id", F.round("acceptance", 6).alias("acceptance"))


@query(
    "llm_call_count",
    "SELECT meeting_id, count(*) * 3 + 1 AS n_perchunk, count(*) * 2 + 2 AS n_legacy FROM t_sections GROUP BY 1",
)
def llm_call_count(spark, sf):
    s = tables.sections(spark, sf)
    a = telemetry.calls_needed(s, "perchunk").withColumnRenamed("n_calls", "n_perchunk")
    return a.join(telemetry.calls_needed(s, "legacy").withColumnRenamed("n_calls", "n_legacy"), "meeting_id")


@query(
    "st_suggestion_feed",
    """WITH i AS (SELECT meeting_id, ts, p, items[p] AS item FROM (SELECT meeting_id, seg_idx AS ts, items, unnest(range(1, len(items) + 1)) AS p FROM (
           SELECT meeting_id, seg_idx, string_split(text, chr(10)) AS items FROM t_segments)) WHERE items[p] <> ''),
       n AS (SELECT meeting_id, item, max(ts) AS ts, arg_max(p, {'a': ts, 'b': -p}) AS p FROM i GROUP BY 1, 2)
       SELECT meeting_id, rank, ts, item FROM (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY ts DESC, p) AS rank FROM n) WHERE rank <= 40""",
)
def st_suggestion_feed(spark, sf):
    items = F.split("text", "\n")
    g = tables.segments(spark, sf).select("meeting_id", F.col("seg_idx").alias("ts"), items.alias("items"))
    return telemetry.suggestion_feed(g)


@query(
    "recent_turns_context",
    """SELECT meeting_id, seg_idx, string_agg(line, chr(10) ORDER BY k) AS context FROM (
         SELECT a.meeting_id, a.seg_idx, b.seg_idx AS k, '[' || b.speaker || ']: ' || trim(b.text, ' ' || chr(10) || chr(9) || chr(13)) AS line
         FROM t_segments a JOIN t_segments b ON a.meeting_id = b.meeting_id AND b.seg_idx BETWEEN a.seg_idx - 3 AND a.seg_idx) GROUP BY 1, 2""",
)
def recent_turns_context(spark, sf):
    return telemetry.recent_context(tables.segments(spark, sf), 4).select("meeting_id", "seg_idx", "context")
