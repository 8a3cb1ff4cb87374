"""Cost, latency, memory and step logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.functions.numbers import fixed, round_exact
from palaver.plans.scans import running_number, scan

# --- fixed values -----------------------------------------------------------------------------------------------
BATCH_DISCOUNT = 0.5
FALLBACK_MODEL = "local"
TOKENS_PER_PRICE = 1000000.0
# ----------------------------------------------------------------------------------------------------------------

DAY = 86400.0


def price_calls(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost of each call in USD. A model without a price costs what the fallback row says, nothing when that is
    missing too. The price table is small, so the join broadcasts it when its size allows."""
    p = prices.select("model", *[F.col(c).alias(f"_{c}") for c in ("input", "cached_input", "output")])
    spare = prices.filter(F.col("model") == FALLBACK_MODEL).agg(
        *[F.coalesce(F.max(c), F.lit(0.0)).alias(f"_f_{c}") for c in ("input", "cached_input", "output")]
    )
    joined = calls.join(p, "model", "left").join(F.broadcast(spare))  # one row

    def rate(c: str) -> Column:
        return F.when(F.col("_input").isNotNull(), F.col(f"_{c}")).otherwise(F.col(f"_f_{c}"))

    fresh = F.greatest(F.col("in_tok") - F.col("cached_in"), F.lit(0))
    cost = (fresh * rate("input") + F.col("cached_in") * rate("cached_input") + F.col("out_tok") * rate("output")) / TOKENS_PER_PRICE
    paid = F.when(F.col("batch"), cost * (1 - BATCH_DISCOUNT)).otherwise(cost)
    return joined.withColumn("cost_usd", paid).select(*calls.columns, "cost_usd")


SUMS = ("in_tok", "out_tok", "cached_in", "latency_s", "cost_usd")


def step_rollup(priced: DataFrame, order: list[str]) -> DataFrame:
    """Per run and step: calls, sums, and the model of the last call by ``order``."""
    last = F.struct(*[F.col(c) for c in order])
    return priced.groupBy("run_id", "step").agg(
        F.count("*").alias("calls"), *[F.sum(c).alias(c) for c in SUMS], F.max_by("model", last).alias("model")
    )


def run_totals(steps: DataFrame) -> DataFrame:
    """Step rows and one total row (step NULL) per run."""
    return steps.rollup("run_id", "step").agg(
        F.sum("calls").alias("calls"), *[F.sum(c).alias(c) for c in SUMS]
    ).filter("run_id IS NOT NULL")


def run_compare(steps: DataFrame, names: list[str]) -> DataFrame:
    """Cost per run with one column per step and a total."""
    wide = steps.groupBy("run_id").pivot("step", names).agg(F.sum("cost_usd"))
    total = steps.groupBy("run_id").agg(F.sum("cost_usd").alias("total"))
    return wide.join(total, "run_id")


def models_by_step(steps: DataFrame) -> DataFrame:
    """MAP step -> model per run; a run has few steps."""
    pairs = F.array_sort(F.collect_list(F.struct("step", "model")))
    return steps.groupBy("run_id").agg(F.map_from_entries(pairs).alias("models"))


def variant_totals(variants: DataFrame, key: list[str], base: str = "original") -> DataFrame:
    """Total seconds of each variant and the ratio to the base variant; missing parts count as zero."""
    parts = [F.coalesce(c, F.lit(0.0)) for c in ("compress_s", "resume_wall_s", "extraction_wall_s", "plan_wall_s")]
    total = variants.withColumn("total_s", sum(parts[1:], parts[0]))
    ref = total.filter(F.col("variant") == base).select(*key, F.col("total_s").alias("_base"))
    return total.join(ref, key, "left").withColumn("ratio", F.try_divide("total_s", "_base")).drop("_base")


def peak_mean(samples: DataFrame, series: DataFrame) -> DataFrame:
    """Peak and mean of each series, 0 for one without samples."""
    agg = samples.groupBy("series_id").agg(F.max("rss_mb").alias("peak_mb"), F.avg("rss_mb").alias("mean_mb"))
    return series.join(agg, "series_id", "left").na.fill(0.0, ["peak_mb", "mean_mb"])


def step_durations(starts: DataFrame, order: list[str]) -> DataFrame:
    """Seconds of each step; a step ends when the next one starts, the last one at ``closed`` if given."""
    out = scan(starts, ["job_id"], order, F.floor(F.col("t_start") / DAY), {"_next": ("lead", F.col("t_start"))})
    end = F.coalesce("_next", F.col("closed")) if "closed" in starts.columns else F.col("_next")
    return out.withColumn("duration_s", round_exact(end - F.col("t_start"), 2)).drop("_next")


def post_stop_wait(log: DataFrame) -> DataFrame:
    """Seconds between the stop click and the close of a job's log."""
    stop, close = (F.max(F.when(F.col("event") == e, F.col("t"))) for e in ("stop", "close"))
    return log.groupBy("job_id").agg((close - stop).alias("wait_s"))


def step_log_lines(steps: DataFrame) -> DataFrame:
    """Numbered table rows of the steps of each job."""
    numbered = running_number(steps, ["job_id"], ["t_start", "name"], F.floor(F.col("t_start") / DAY), "no")
    line = F.concat(
        F.lit("| "), F.col("no").cast("string"), F.lit(" | "), "name", F.lit(" | "), fixed(F.col("duration_s"), 1), F.lit("s |")
    )
    return numbered.select("job_id", F.col("no"), line.alias("line"))


def max_concurrency(spans: DataFrame, key: list[str], start: str, end: str) -> DataFrame:
    """Largest number of spans open at once; a span that ends where another starts does not overlap it."""
    events = spans.select(*key, F.col(start).alias("t"), F.lit(1).alias("d")).unionByName(
        spans.select(*key, F.col(end).alias("t"), F.lit(-1).alias("d"))
    )
    net = events.groupBy(*key, "t").agg(F.sum("d").alias("d"))
    open_now = scan(net, key, ["t"], F.floor(F.col("t") / DAY), {"n": ("sum", F.col("d"))})
    return open_now.groupBy(*key).agg(F.max("n").alias("max_open"))


def draft_acceptance(runs: DataFrame) -> DataFrame:
    return runs.withColumn("acceptance", F.try_divide("accepted", "drafted"))


def calls_needed(chunks: DataFrame, mode: str) -> DataFrame:
    """Model calls of a meeting: three per chunk and one, or two per chunk and two in the older mode."""
    per, final = (2, 2) if mode == "legacy" else (3, 1)
    return chunks.groupBy("meeting_id").agg((F.count("*") * per + final).alias("n_calls"))


def suggestion_feed(groups: DataFrame, keep: int = 40) -> DataFrame:
    """Distinct items, newest group first, the latest ``keep`` of each meeting; an item counts at its newest group.

    Groups are first cut to the newest item occurrences per meeting by rank, before anything is collected.
    """
    items = groups.select("meeting_id", "ts", F.posexplode("items").alias("pos", "item")).filter("item <> ''")
    newest = items.groupBy("meeting_id", "item").agg(F.max(F.struct("ts", (-F.col("pos")).alias("neg"))).alias("at"))
    rank = F.row_number().over(Window.partitionBy("meeting_id").orderBy(F.col("at.ts").desc(), F.col("at.neg").desc()))
    return newest.withColumn("rank", rank).filter(F.col("rank") <= keep).select(
        "meeting_id", "rank", F.col("at.ts").alias("ts"), "item"
    )


def recent_context(turns: DataFrame, keep: int = 12) -> DataFrame:
    """The last ``keep`` rendered turns up to each turn, as one text."""
    from palaver.functions.text import segment_line
    from palaver.plans.scans import frames

    lined = turns.withColumn("_line", segment_line(F.col("speaker"), F.col("text"))).filter("_line IS NOT NULL")
    return frames(
        lined, ["meeting_id"], "seg_idx", keep - 1, 0,
        lambda w: {"context": F.array_join(F.collect_list("_line").over(w.rowsBetween(-(keep - 1), 0)), "\n")},
    ).drop("_line")


