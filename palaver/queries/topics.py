"""Topic segmentation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from palaver.operators import topics
from palaver.queries import tables
from palaver.queries.registry import query
from palaver.queries.scalars import BLANKS
from palaver.session import cut_lineage

SQL = tables.SQL
SQL["t_win"] = f"""
SELECT meeting_id, CAST(row_number() OVER (PARTITION BY meeting_id ORDER BY seg_idx) - 1 AS INTEGER) AS win_idx,
       start AS start_time, e AS end_time, array_to_string(lines, chr(10)) AS text, seg_idx AS first_seg, embedding
FROM (SELECT meeting_id, seg_idx, start, embedding,
        last("end") OVER w AS e, count(*) OVER w AS n, list(line) FILTER (WHERE line IS NOT NULL) OVER w AS lines
      FROM (SELECT *, CASE WHEN trim(text, {BLANKS}) <> '' THEN '[' || coalesce(speaker, '?') || ']: ' || trim(text, {BLANKS}) END AS line FROM t_topic)
      WINDOW w AS (PARTITION BY meeting_id ORDER BY seg_idx ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING))
WHERE n = 3 AND len(lines) > 0"""
SQL["t_raw"] = """
SELECT a.meeting_id, a.win_idx, list_dot_product(a.embedding, b.embedding) AS raw
FROM t_win a JOIN t_win b ON a.meeting_id = b.meeting_id AND b.win_idx = a.win_idx + 1"""


def sql_smooth(source: str, keys: str, sigma: float) -> str:
    """Mirrored Gaussian as a join on offsets."""
    radius = int(4 * sigma + 0.5)
    k = keys.split(", ")
    on = " AND ".join(f"x.{c} = i.{c}" for c in k)
    return f"""
SELECT {', '.join('i.' + c for c in k)}, i.win_idx, any_value(i.raw) AS raw,
       CASE WHEN any_value(i.n) > 3 THEN sum(exp(-0.5e0 * i.k * i.k / {sigma * sigma}e0) * x.raw) / sum(exp(-0.5e0 * i.k * i.k / {sigma * sigma}e0))
            ELSE any_value(i.raw) END AS smoothed
FROM (SELECT *, least(j, 2 * n - 1 - j) AS src FROM (SELECT *, ((win_idx + k) % (2 * n) + 2 * n) % (2 * n) AS j FROM (
        SELECT *, count(*) OVER (PARTITION BY {keys}) AS n FROM {source}), (SELECT unnest(range(-{radius}, {radius} + 1)) AS k))) i
JOIN {source} x ON {on} AND x.win_idx = i.src
GROUP BY {', '.join('i.' + c for c in k)}, i.win_idx"""


SQL["t_curve"] = sql_smooth("t_raw", "meeting_id", 2.0)
SQL["t_cand"] = """
SELECT c.meeting_id, c.win_idx, c.raw, c.smoothed, threshold FROM t_curve c
JOIN (SELECT meeting_id, quantile_cont(smoothed, 0.2) AS threshold FROM t_curve GROUP BY 1) q ON q.meeting_id = c.meeting_id
WHERE c.smoothed < threshold"""
SQL["t_bounds"] = """
WITH RECURSIVE c AS (SELECT meeting_id, win_idx, smoothed, row_number() OVER (PARTITION BY meeting_id ORDER BY win_idx) AS rn FROM t_cand),
r AS (SELECT meeting_id, rn, win_idx AS kept, smoothed AS kv, CAST(NULL AS INTEGER) AS out_idx, CAST(NULL AS DOUBLE) AS out_v FROM c WHERE rn = 1
  UNION ALL
  SELECT r.meeting_id, c.rn,
    CASE WHEN c.win_idx - r.kept >= 10 OR c.smoothed < r.kv THEN c.win_idx ELSE r.kept END,
    CASE WHEN c.win_idx - r.kept >= 10 OR c.smoothed < r.kv THEN c.smoothed ELSE r.kv END,
    CASE WHEN c.win_idx - r.kept >= 10 THEN r.kept END, CASE WHEN c.win_idx - r.kept >= 10 THEN r.kv END
  FROM r JOIN c ON c.meeting_id = r.meeting_id AND c.rn = r.rn + 1)
SELECT meeting_id, out_idx AS win_idx, out_v AS smoothed FROM r WHERE out_idx IS NOT NULL
UNION ALL
SELECT meeting_id, kept, kv FROM (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY rn DESC) AS last FROM r) WHERE last = 1"""
SQL["t_chunks"] = f"""
WITH p AS (SELECT s.*, sum(CASE WHEN b.win_idx IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY s.meeting_id ORDER BY s.seg_idx) AS part,
    CASE WHEN trim(text, {BLANKS}) <> '' THEN '[' || coalesce(speaker, '?') || ']: ' || trim(text, {BLANKS}) END AS line
  FROM t_topic s LEFT JOIN t_bounds b ON b.meeting_id = s.meeting_id AND b.win_idx + 1 = s.seg_idx),
g AS (SELECT meeting_id, part, count(*) AS n_segments, min(seg_idx) AS first_seg, min(start) AS start_time, max("end") AS end_time,
    coalesce(length(string_agg(line, chr(10) ORDER BY seg_idx)), 0) AS n_chars FROM p GROUP BY 1, 2)
SELECT meeting_id, CAST(row_number() OVER (PARTITION BY meeting_id ORDER BY first_seg) - 1 AS INTEGER) AS chunk_id,
  n_segments, n_chars, first_seg, start_time, end_time FROM g WHERE n_chars > 0"""

P = 0.2  # a share of the 48 windows of a test meeting that leaves some candidates


def windows(spark, sf):
    seg = tables.topic_segments(spark, sf)
    vec = seg.select("meeting_id", F.col("seg_idx").alias("first_seg"), "embedding")
    return topics.build_windows(seg).join(vec, ["meeting_id", "first_seg"])


def curve(spark, sf):
    return cut_lineage(topics.gaussian_smooth(topics.adjacent_similarity(windows(spark, sf))))


def bounds(spark, sf):
    return cut_lineage(topics.min_distance_pick(cut_lineage(topics.percentile_candidates(curve(spark, sf), P))))


@query("build_windows", "SELECT meeting_id, win_idx, start_time, end_time, text, first_seg FROM t_win")
def build_windows(spark, sf):
    return topics.build_windows(tables.topic_segments(spark, sf))


@query("adjacent_similarity", "SELECT meeting_id, win_idx, round(raw, 6) AS raw FROM t_raw")
def adjacent_similarity(spark, sf):
    out = topics.adjacent_similarity(windows(spark, sf))
    return out.select("meeting_id", "win_idx", F.round("raw", 6).alias("raw"))


@query("gaussian_smooth", "SELECT meeting_id, win_idx, round(smoothed, 6) AS smoothed FROM t_curve")
def gaussian_smooth(spark, sf):
    return curve(spark, sf).select("meeting_id", "win_idx", F.round("smoothed", 6).alias("smoothed"))


@query(
    "percentile_threshold",
    "SELECT meeting_id, win_idx, round(smoothed, 6) AS smoothed, round(threshold, 6) AS threshold FROM t_cand",
)
def percentile_threshold(spark, sf):
    out = topics.percentile_candidates(curve(spark, sf), P)
    return out.select(
        "meeting_id", "win_idx", F.round("smoothed", 6).alias("smoothed"), F.round("threshold", 6).alias("threshold")
    )


@query("min_distance_pick", "SELECT meeting_id, win_idx, round(smoothed, 6) AS smoothed FROM t_bounds")
def min_distance_pick(spark, sf):
    return bounds(spark, sf).withColumn("smoothed", F.round("smoothed", 6))


@query("assign_chunks", "SELECT * FROM t_chunks")
def assign_chunks(spark, sf):
    return topics.assign_chunks(tables.topic_segments(spark, sf), bounds(spark, sf))


@query("resplit_oversize")
def resplit_oversize(spark, sf):
    seg = tables.topic_segments(spark, sf)
    placed = topics.named_by_first(topics.segment_parts(seg, bounds(spark, sf)))
    return topics.resplit_oversize(cut_lineage(placed))


@query("topic_chunks")
def topic_chunks(spark, sf):
    return topics.topic_chunks(tables.topic_segments(spark, sf))


@query(
    "coarse_boundaries",
    """SELECT meeting_id, win_idx, round(smoothed, 6) AS smoothed FROM (
         SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY smoothed, win_idx) AS r FROM t_bounds) WHERE r <= 2""",
)
def coarse_boundaries(spark, sf):
    return topics.coarse_boundaries(bounds(spark, sf), 3).withColumn("smoothed", F.round("smoothed", 6))


@query(
    "similarity_stats",
    "SELECT meeting_id, round(min(raw), 6) AS sim_min, round(max(raw), 6) AS sim_max, round(avg(raw), 6) AS sim_mean FROM t_raw GROUP BY 1",
)
def similarity_stats(spark, sf):
    out = topics.similarity_stats(topics.adjacent_similarity(windows(spark, sf)))
    return out.select("meeting_id", *[F.round(c, 6).alias(c) for c in ("sim_min", "sim_max", "sim_mean")])


@query(
    "chunk_stats",
    "SELECT meeting_id, chunk_id, n_segments, n_chars, end_time - start_time AS duration_s FROM t_chunks",
)
def chunk_stats(spark, sf):
    return assign_chunks(spark, sf).select(
        "meeting_id", "chunk_id", "n_segments", "n_chars", (F.col("end_time") - F.col("start_time")).alias("duration_s")
    )


SQL["t_causal"] = """
SELECT meeting_id, win_idx, CASE WHEN win_idx < 2 THEN any_value(raw) ELSE sum(w * x) / sum(w) END AS smoothed FROM (
  SELECT a.meeting_id, a.win_idx, a.raw, b.raw AS x, exp(-0.5e0 * power((a.win_idx - b.win_idx) / 2e0, 2)) AS w
  FROM t_raw a JOIN t_raw b ON a.meeting_id = b.meeting_id AND b.win_idx BETWEEN a.win_idx - 4 AND a.win_idx) GROUP BY 1, 2"""
SQL["t_roll"] = """
SELECT *, coalesce(smoothed < threshold, false) AS candidate FROM (
  SELECT meeting_id, win_idx, smoothed, CASE WHEN count(*) OVER w >= 20 THEN avg(smoothed) OVER w - 1 * stddev_pop(smoothed) OVER w END AS threshold
  FROM t_causal WINDOW w AS (PARTITION BY meeting_id ORDER BY win_idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"""


def causal(spark, sf):
    return topics.causal_smooth(topics.adjacent_similarity(windows(spark, sf)))


@query("causal_smooth", "SELECT meeting_id, win_idx, round(smoothed, 6) AS smoothed FROM t_causal")
def causal_smooth(spark, sf):
    return causal(spark, sf).select("meeting_id", "win_idx", F.round("smoothed", 6).alias("smoothed"))


@query("rolling_threshold", "SELECT meeting_id, win_idx, round(threshold, 6) AS threshold, candidate FROM t_roll")
def rolling_threshold(spark, sf):
    out = topics.rolling_threshold(causal(spark, sf), k_sigma=1.0)
    return out.select("meeting_id", "win_idx", F.round("threshold", 6).alias("threshold"), "candidate")


@query(
    "confirm_valley",
    """SELECT meeting_id, win_idx FROM (
         SELECT *, min(smoothed) OVER (PARTITION BY meeting_id ORDER BY win_idx ROWS BETWEEN 2 FOLLOWING AND 5 FOLLOWING) AS low,
           max(win_idx) OVER (PARTITION BY meeting_id) AS top FROM t_roll) WHERE candidate AND top - win_idx >= 5 AND low >= smoothed""",
)
def confirm_valley(spark, sf):
    out = topics.confirm_valley(topics.rolling_threshold(causal(spark, sf), k_sigma=1.0))
    return out.filter("confirmed").select("meeting_id", "win_idx")


@query("vectorize_windows")
def vectorize_windows(spark, sf):
    out = topics.vectorize_windows(topics.build_windows(tables.segments(spark, sf)))
    return out.select("meeting_id", "win_idx", F.size("embedding").alias("dim"))


@query("text_topic_chunks")
def text_topic_chunks(spark, sf):
    """Topic chunks of conversations whose window vectors come from their words."""
    seg = tables.segments(spark, sf)
    vec = topics.vectorize_windows(topics.build_windows(seg), 1024).select(
        "meeting_id", F.col("first_seg").alias("seg_idx"), "embedding"
    )
    return topics.topic_chunks(seg.join(vec, ["meeting_id", "seg_idx"], "left"), with_text=False)
