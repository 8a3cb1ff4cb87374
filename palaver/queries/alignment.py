"""Words, turns, speakers and time."""

from __future__ import annotations

from pyspark.sql import functions as F

from palaver.functions import text
from palaver.operators import alignment, assignment, diarization, transcripts
from palaver.queries import tables
from palaver.queries.registry import query
from palaver.queries.scalars import sql_normalized

SQL = tables.SQL
SQL["t_turns"] = """
SELECT meeting_id, CAST(g - 1 AS INTEGER) AS turn_idx, min(start) AS start, max_by("end", word_idx) AS "end",
       any_value(speaker) AS speaker, string_agg(word, ' ' ORDER BY word_idx) AS text
FROM (SELECT *, sum(CASE WHEN prev IS NOT DISTINCT FROM speaker THEN 0 ELSE 1 END) OVER (PARTITION BY meeting_id ORDER BY word_idx) AS g
      FROM (SELECT *, lag(speaker) OVER (PARTITION BY meeting_id ORDER BY word_idx) AS prev FROM t_words)) GROUP BY 1, g"""


@query("words_to_turns", "SELECT * FROM t_turns")
def words_to_turns(spark, sf):
    return transcripts.words_to_turns(tables.words(spark, sf))


@query("words_per_speaker", "SELECT meeting_id, speaker, count(*) AS n_words FROM t_words GROUP BY 1, 2")
def words_per_speaker(spark, sf):
    return diarization.words_per_speaker(tables.words(spark, sf))


@query(
    "unique_speakers",
    "SELECT meeting_id, string_agg(speaker, ',' ORDER BY speaker) AS speakers FROM (SELECT DISTINCT meeting_id, speaker FROM t_segments) GROUP BY 1",
)
def unique_speakers(spark, sf):
    return diarization.unique_speakers(tables.segments(spark, sf)).withColumn("speakers", F.array_join("speakers", ","))


def tokens(spark, sf):
    """Each word as marked head, tail and closing punctuation."""
    w = tables.words(spark, sf)
    stem = F.regexp_replace("word", "[.,!?:;]+$", "")
    mark = F.regexp_extract("word", "([.,!?:;])$", 1)
    parts = F.array(
        F.when(stem != "", F.concat(F.lit("▁"), F.substring(stem, 1, 2))).otherwise(""), F.substr(stem, F.lit(3)), mark
    )
    t = w.select("meeting_id", "word_idx", "start", F.posexplode(parts).alias("k", "tok")).filter("tok <> ''")
    return t.select(
        "meeting_id", (F.col("word_idx") * 10 + F.col("k")).alias("tok_idx"), "tok",
        (F.col("start") + F.lit(0.1) * F.col("k")).alias("ts"),
    )


SQL["t_tokens"] = """
SELECT meeting_id, word_idx * 10 + k AS tok_idx, parts[k + 1] AS tok, start + 0.1e0 * k AS ts FROM (
  SELECT meeting_id, word_idx, start, unnest([0, 1, 2]) AS k,
    [CASE WHEN stem <> '' THEN '▁' || substr(stem, 1, 2) ELSE '' END, substr(stem, 3), regexp_extract(word, '([.,!?:;])$', 1)] AS parts
  FROM (SELECT *, regexp_replace(word, '[.,!?:;]+$', '') AS stem FROM t_words)) WHERE parts[k + 1] <> ''"""


@query(
    "tokens_to_words",
    """WITH f AS (SELECT *, tok IN ('.', ',', '!', '?', ':', ';', '...') AS p FROM t_tokens),
       o AS (SELECT *, CASE WHEN NOT p AND (starts_with(tok, '▁') OR
           count(*) FILTER (WHERE NOT p) OVER (PARTITION BY meeting_id ORDER BY tok_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 0) THEN 1 ELSE 0 END AS op FROM f),
       n AS (SELECT *, sum(op) OVER (PARTITION BY meeting_id ORDER BY tok_idx) AS w FROM o),
       base AS (SELECT meeting_id, w, string_agg(ltrim(tok, ' ▁'), '' ORDER BY tok_idx) AS word, min(ts) AS start FROM n WHERE NOT p GROUP BY 1, 2),
       mk AS (SELECT meeting_id, w - 1 AS w, string_agg(tok, '' ORDER BY tok_idx) AS marks, max(ts) AS mts FROM n WHERE p AND w > 1 GROUP BY 1, 2),
       fin AS (SELECT meeting_id, max(ts) AS fts FROM t_tokens GROUP BY 1)
       SELECT b.meeting_id, CAST(b.w - 1 AS INTEGER) AS word_idx, word || coalesce(marks, '') AS word, start,
         coalesce(mts + 0.08e0, lead(start) OVER (PARTITION BY b.meeting_id ORDER BY b.w), fts + 0.08e0) AS "end"
       FROM base b LEFT JOIN mk ON mk.meeting_id = b.meeting_id AND mk.w = b.w JOIN fin ON fin.meeting_id = b.meeting_id""",
)
def tokens_to_words(spark, sf):
    return transcripts.tokens_to_words(tokens(spark, sf))


SQL["t_mid"] = """
WITH o AS (SELECT *, lag("end") OVER w AS prev_end, lag(speaker) OVER w AS prev_speaker, row_number() OVER w AS rn
  FROM t_diar WINDOW w AS (PARTITION BY meeting_id ORDER BY start, idx)),
l AS (SELECT meeting_id, arg_max(speaker, rn) AS last_speaker FROM o GROUP BY 1),
m AS (SELECT *, (start + "end") / 2 AS mid FROM t_words),
f AS (SELECT m.meeting_id, m.word_idx, min(o.rn) AS rn FROM m JOIN o ON m.meeting_id = o.meeting_id AND o."end" > m.mid GROUP BY 1, 2)
SELECT m.meeting_id, m.word_idx, m.word, m.start, m."end",
  CASE WHEN l.last_speaker IS NULL THEN 'SPEAKER_00' WHEN o.rn IS NULL THEN l.last_speaker
       WHEN m.mid < o.start AND o.prev_end IS NOT NULL AND m.mid - o.prev_end < o.start - m.mid THEN o.prev_speaker ELSE o.speaker END AS speaker
FROM m LEFT JOIN l ON m.meeting_id = l.meeting_id LEFT JOIN f ON m.meeting_id = f.meeting_id AND m.word_idx = f.word_idx
LEFT JOIN o ON f.meeting_id = o.meeting_id AND f.rn = o.rn"""


@query("align_words_midpoint", "SELECT * FROM t_mid")
def align_words_midpoint(spark, sf):
    return alignment.align_words_midpoint(tables.words(spark, sf), tables.diar_segments(spark, sf)).select(
        "meeting_id", "word_idx", "word", "start", "end", "speaker"
    )


SQL["t_changes"] = """
SELECT meeting_id, start AS "at", speaker FROM (SELECT *, lag(speaker) OVER (PARTITION BY meeting_id ORDER BY start) AS prev,
  row_number() OVER (PARTITION BY meeting_id ORDER BY start) AS rn FROM t_diar) WHERE rn = 1 OR prev IS DISTINCT FROM speaker"""


@query("change_points", 'SELECT meeting_id, "at", speaker FROM t_changes')
def change_points(spark, sf):
    return alignment.change_points(tables.diar_segments(spark, sf))


SQL["t_snap"] = """
WITH w AS (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY start, word_idx) - 1 AS i, regexp_matches(word, '[.!?।]') AS p FROM t_words),
r AS (SELECT c.meeting_id, c."at", c.speaker, min(w.i) AS wi FROM t_changes c JOIN w ON w.meeting_id = c.meeting_id AND w.start > c."at" GROUP BY 1, 2, 3),
x AS (SELECT r.*, w.start AS ref FROM r JOIN w ON w.meeting_id = r.meeting_id AND w.i = r.wi),
f AS (SELECT x.meeting_id, x."at", x.speaker, x.wi,
   min(w.i) FILTER (WHERE w.i >= x.wi AND w.p) AS fi, max(w.i) FILTER (WHERE w.i < x.wi AND w.p) AS bi
  FROM x LEFT JOIN w ON w.meeting_id = x.meeting_id AND w.start BETWEEN x.ref - 5 AND x.ref + 5 GROUP BY 1, 2, 3, 4)
SELECT meeting_id, "at", speaker, CASE WHEN wi = 0 THEN 0 WHEN fi IS NOT NULL AND (bi IS NULL OR fi - wi <= wi - bi) THEN fi + 1
  WHEN bi IS NOT NULL THEN bi + 1 ELSE wi + 1 END AS i FROM f"""


@query("boundary_snap", 'SELECT meeting_id, "at", speaker, i FROM t_snap')
def boundary_snap(spark, sf):
    numbered = alignment.number_words(tables.words(spark, sf))
    return alignment.boundary_snap(numbered, alignment.change_points(tables.diar_segments(spark, sf)))


SQL["t_bnd"] = """
WITH w AS (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY start, word_idx) - 1 AS i FROM t_words),
c AS (SELECT meeting_id, i, max_by(speaker, "at") AS ch FROM t_snap GROUP BY 1, 2),
f AS (SELECT meeting_id, min_by(speaker, start) AS first_speaker FROM t_diar GROUP BY 1)
SELECT w.meeting_id, w.word_idx, w.i, w.start, w."end", w.word,
  coalesce(last_value(ch IGNORE NULLS) OVER (PARTITION BY w.meeting_id ORDER BY w.i), first_speaker, 'SPEAKER_00') AS speaker
FROM w LEFT JOIN c ON c.meeting_id = w.meeting_id AND c.i = w.i LEFT JOIN f ON f.meeting_id = w.meeting_id"""


@query("forward_fill_speaker", "SELECT meeting_id, word_idx, i, speaker FROM t_bnd")
def forward_fill_speaker(spark, sf):
    out = alignment.align_words_boundary(tables.words(spark, sf), tables.diar_segments(spark, sf))
    return out.select("meeting_id", "word_idx", "i", "speaker")


def probes(spark, sf):
    s = tables.subsegments(spark, sf)
    return s.select("meeting_id", "sub_idx", (F.col("sub_idx") * F.lit(0.5) + F.lit(0.1)).alias("t"))


def centers(spark, sf):
    return tables.subsegments(spark, sf).withColumn("center", F.col("start") + F.lit(0.6))


@query(
    "nearest_embedding_label",
    """SELECT p.meeting_id, p.sub_idx, 'SPEAKER_' || lpad(CAST(CASE WHEN b.c IS NOT NULL AND (a.c IS NULL OR p.t - b.c <= a.c - p.t) THEN b.label ELSE a.label END AS VARCHAR), 2, '0') AS speaker
       FROM (SELECT meeting_id, sub_idx, sub_idx * 0.5e0 + 0.1e0 AS t FROM t_sub) p
       ASOF LEFT JOIN (SELECT meeting_id, start + 0.6e0 AS c, label FROM t_sub) b ON b.meeting_id = p.meeting_id AND p.t >= b.c
       ASOF LEFT JOIN (SELECT meeting_id, start + 0.6e0 AS c, label FROM t_sub) a ON a.meeting_id = p.meeting_id AND p.t < a.c""",
)
def nearest_embedding_label(spark, sf):
    out = alignment.nearest_label(probes(spark, sf), centers(spark, sf), "t", "center", "sub_idx", alignment.PROVISIONAL_SPEAKER)
    return out.select("meeting_id", "sub_idx", "speaker")


SQL["t_filled"] = """
WITH bare AS (SELECT s.*, (s.start + s."end") / 2 AS mid FROM t_speech s ANTI JOIN t_sub u ON u.meeting_id = s.meeting_id AND u.parent_idx = s.idx),
d AS (SELECT b.meeting_id, b.idx, b.start, b."end", u.label, row_number() OVER (PARTITION BY b.meeting_id, b.idx ORDER BY abs(b.mid - (u.start + u."end") / 2), u.sub_idx) AS rn
  FROM bare b JOIN t_sub u ON u.meeting_id = b.meeting_id)
SELECT meeting_id, idx, start, "end", 'SPEAKER_' || lpad(CAST(label AS VARCHAR), 2, '0') AS speaker FROM d WHERE rn = 1"""


@query("nearest_label_fill", 'SELECT meeting_id, idx, start, "end", speaker FROM t_filled')
def nearest_label_fill(spark, sf):
    return alignment.fill_unlabelled(tables.speech_segments(spark, sf), tables.subsegments(spark, sf))


SQL["t_spoken"] = """
SELECT meeting_id, start, "end", 'SPEAKER_' || lpad(CAST(label AS VARCHAR), 2, '0') AS speaker FROM t_sub
UNION ALL SELECT meeting_id, start, "end", speaker FROM t_filled"""


@query("speech_plus_filled", 'SELECT meeting_id, start, "end", speaker FROM t_spoken')
def speech_plus_filled(spark, sf):
    return diarization.speech_plus_filled(tables.speech_segments(spark, sf), tables.subsegments(spark, sf))


SQL["t_merged"] = """
WITH a AS (SELECT *, lag(speaker) OVER (PARTITION BY meeting_id ORDER BY start, "end", speaker) AS prev FROM t_spoken),
b AS (SELECT *, sum(CASE WHEN prev IS NOT DISTINCT FROM speaker THEN 0 ELSE 1 END) OVER (PARTITION BY meeting_id ORDER BY start, "end", speaker) AS run FROM a),
c AS (SELECT *, max("end") OVER (PARTITION BY meeting_id, run ORDER BY start, "end", speaker ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM b),
d AS (SELECT *, sum(CASE WHEN reach IS NULL OR start - reach >= 0.7e0 THEN 1 ELSE 0 END) OVER (PARTITION BY meeting_id, run ORDER BY start, "end", speaker) AS part FROM c)
SELECT meeting_id, min(start) AS start, max("end") AS "end", any_value(speaker) AS speaker FROM d GROUP BY meeting_id, run, part"""


def merged(spark, sf):
    return diarization.merge_adjacent(speech_plus_filled(spark, sf))


@query("merge_adjacent_segments", 'SELECT meeting_id, start, "end", speaker FROM t_merged')
def merge_adjacent_segments(spark, sf):
    return merged(spark, sf)


@query(
    "live_segments",
    """WITH v AS (SELECT meeting_id, sub_idx, label, (start + 0.6e0) * CASE WHEN sub_idx >= 25 THEN 2 ELSE 1 END AS c FROM t_sub),
       a AS (SELECT *, lag(label) OVER w AS pl, lag(c) OVER w AS pc FROM v WINDOW w AS (PARTITION BY meeting_id ORDER BY sub_idx)),
       b AS (SELECT *, sum(CASE WHEN pl = label AND c - 0.6e0 <= (pc + 0.6e0) + 0.1e0 THEN 0 ELSE 1 END) OVER (PARTITION BY meeting_id ORDER BY sub_idx) AS run FROM a)
       SELECT meeting_id, min(c) - 0.6e0 AS start, max(c) + 0.6e0 AS "end", 'SPEAKER_' || lpad(CAST(any_value(label) AS VARCHAR), 2, '0') AS speaker FROM b GROUP BY meeting_id, run""",
)
def live_segments(spark, sf):
    stretch = F.when(F.col("sub_idx") >= 25, 2).otherwise(1)
    v = centers(spark, sf).select(
        "meeting_id", F.col("sub_idx").alias("idx"), (F.col("center") * stretch).alias("center"), "label"
    )
    return diarization.live_segments(v)


@query(
    "subsegment_windows",
    """WITH s AS (SELECT meeting_id, idx, start, "end", "end" - start AS len FROM t_speech WHERE "end" - start >= 0.4e0)
       SELECT meeting_id, idx AS parent_idx, 0 AS win, start, "end" FROM s WHERE len <= 1.2e0 * 1.5e0
       UNION ALL
       SELECT meeting_id, idx, k, start + k * 0.6e0, least(start + k * 0.6e0 + 1.2e0, "end") FROM s, (SELECT unnest(range(0, 1000)) AS k)
       WHERE len > 1.2e0 * 1.5e0 AND start + k * 0.6e0 + 0.4e0 < "end" """,
)
def subsegment_windows(spark, sf):
    return diarization.subsegment_windows(tables.speech_segments(spark, sf))


@query(
    "window_has_speech",
    "SELECT meeting_id, frame_idx // 37 AS win_idx, bool_or(prob >= 0.4e0) AS has_speech FROM t_frames GROUP BY 1, 2",
)
def window_has_speech(spark, sf):
    return diarization.window_has_speech(tables.frames(spark, sf), 37)


@query(
    "speech_islands",
    """WITH v AS (SELECT meeting_id, frame_idx, lag(frame_idx) OVER (PARTITION BY meeting_id ORDER BY frame_idx) AS pf FROM t_frames WHERE prob >= 0.4e0),
       g AS (SELECT *, sum(CASE WHEN pf IS NOT NULL AND (frame_idx - pf - 1) * 0.032e0 < 0.05e0 THEN 0 ELSE 1 END) OVER (PARTITION BY meeting_id ORDER BY frame_idx) AS run FROM v),
       s AS (SELECT meeting_id, min(frame_idx) * 0.032e0 AS s, (max(frame_idx) + 1) * 0.032e0 AS e FROM g GROUP BY meeting_id, run),
       k AS (SELECT meeting_id, s, e, lag(e) OVER w AS pe, lead(s) OVER w AS ns FROM s WHERE e - s >= 0.2e0 WINDOW w AS (PARTITION BY meeting_id ORDER BY s))
       SELECT meeting_id, CASE WHEN pe IS NULL THEN greatest(s - 0.02e0, 0) ELSE greatest(s - 0.02e0, (pe + s) / 2) END AS start,
         CASE WHEN ns IS NULL THEN e + 0.02e0 ELSE least(e + 0.02e0, (e + ns) / 2) END AS "end" FROM k""",
)
def speech_islands(spark, sf):
    return diarization.speech_islands(tables.frames(spark, sf))


@query(
    "vad_stats",
    """SELECT d.meeting_id, count(s.idx) AS n_segments, round(coalesce(sum(s."end" - s.start), 0), 6) AS speech_s,
         round(CASE WHEN any_value(d.dur) > 0 THEN coalesce(sum(s."end" - s.start), 0) / any_value(d.dur) ELSE 0 END, 6) AS speech_ratio
       FROM (SELECT meeting_id, CASE WHEN max(label) % 2 = 0 THEN max("end") ELSE 0 END AS dur FROM t_sub GROUP BY 1) d
       LEFT JOIN t_speech s ON s.meeting_id = d.meeting_id GROUP BY 1""",
)
def vad_stats(spark, sf):
    durations = tables.subsegments(spark, sf).groupBy("meeting_id").agg(
        F.when(F.max("label") % 2 == 0, F.max("end")).otherwise(0.0).alias("duration")
    )
    out = diarization.vad_stats(tables.speech_segments(spark, sf), durations)
    return out.withColumns({"speech_s": F.round("speech_s", 6), "speech_ratio": F.round("speech_ratio", 6)})


@query(
    "active_turn_at",
    """SELECT p.meeting_id, p.t, coalesce(min(u.turn_idx), -1) AS active FROM (SELECT meeting_id, start + 50e0 AS t FROM t_diar) p
       LEFT JOIN t_turns u ON u.meeting_id = p.meeting_id AND p.t >= u.start AND p.t < u."end" GROUP BY 1, 2""",
)
def active_turn_at(spark, sf):
    points = tables.diar_segments(spark, sf).select("meeting_id", (F.col("start") + F.lit(50.0)).alias("t"))
    return alignment.active_turn(words_to_turns(spark, sf), points)


@query(
    "ram_mark_asof",
    """SELECT s.series_id, s.t, s.rss_mb, m.event_id AS mark FROM t_samples s
       ASOF LEFT JOIN (SELECT * FROM t_samples WHERE label = 'error') m ON m.series_id = s.series_id AND s.t >= m.t""",
)
def ram_mark_asof(spark, sf):
    s = tables.samples(spark, sf)
    marks = s.filter("label = 'error'").select("series_id", "t", F.col("event_id").alias("mark"))
    return alignment.backward_asof(s.select("series_id", "t", "rss_mb"), marks, "series_id", "t", 86400.0)


@query(
    "apply_speaker_mapping",
    """SELECT s.meeting_id, s.seg_idx, coalesce(m.nom, s.speaker) AS speaker FROM t_segments s
       LEFT JOIN (SELECT DISTINCT meeting_id, speaker, 'Ada ' || meeting_id AS nom FROM t_segments WHERE speaker = 'user') m
       ON m.meeting_id = s.meeting_id AND m.speaker = s.speaker""",
)
def apply_speaker_mapping(spark, sf):
    s = tables.segments(spark, sf)
    names = s.filter("speaker = 'user'").select(
        "meeting_id", F.col("speaker").alias("label"), F.concat(F.lit("Ada "), "meeting_id").alias("nom")
    ).distinct()
    return transcripts.apply_speaker_mapping(s, names).select("meeting_id", "seg_idx", "speaker")


@query(
    "end_of_turn",
    """SELECT meeting_id, seg_idx, text LIKE '%.' OR (prev IS NOT NULL AND prev <> speaker) AS end_of_turn FROM (
         SELECT *, lag(speaker) OVER (PARTITION BY meeting_id ORDER BY seg_idx) AS prev FROM t_segments)""",
)
def end_of_turn(spark, sf):
    s = tables.segments(spark, sf).withColumn("is_final", F.col("text").endswith("."))
    return transcripts.end_of_turn(s).select("meeting_id", "seg_idx", "end_of_turn")


@query(
    "sort_segments",
    """SELECT meeting_id, CAST(row_number() OVER (PARTITION BY meeting_id ORDER BY start, line_no) - 1 AS INTEGER) AS seg_idx, line_no
       FROM (SELECT meeting_id, seg_idx AS line_no, CAST(length(text) AS DOUBLE) AS start FROM t_segments)""",
)
def sort_segments(spark, sf):
    s = tables.segments(spark, sf).select(
        "meeting_id", F.col("seg_idx").alias("line_no"), F.length("text").cast("double").alias("start"),
        F.lit(0.0).alias("end"), "speaker", F.col("seg_idx").cast("string").alias("text"),
    )
    out = transcripts.to_segments(s)
    return out.select("meeting_id", "seg_idx", F.col("text").cast("int").alias("line_no"))


@query(
    "real_time_factor",
    """SELECT meeting_id, round(sum("end" - start) / nullif(max("end") * (max(label) % 2), 0), 6) AS rtf FROM t_sub GROUP BY 1""",
)
def real_time_factor(spark, sf):
    runs = tables.subsegments(spark, sf).groupBy("meeting_id").agg(
        F.sum(F.col("end") - F.col("start")).alias("processing_s"), (F.max("end") * (F.max("label") % 2)).alias("audio_s")
    )
    return diarization.real_time_factor(runs).select("meeting_id", F.round("rtf", 6).alias("rtf"))


SQL["t_doc_normal"] = sql_normalized("t_doc_lines")


@query(
    "split_ratio",
    """SELECT meeting_id, n_in, coalesce(n_out, 0) AS n_out, coalesce(n_out, 0) / CAST(n_in AS DOUBLE) AS ratio
       FROM (SELECT meeting_id, count(*) AS n_in FROM t_doc_lines GROUP BY 1)
       LEFT JOIN (SELECT meeting_id, count(*) AS n_out FROM t_doc_normal GROUP BY 1) USING (meeting_id)""",
)
def split_ratio(spark, sf):
    return transcripts.split_ratio(tables.document_lines(spark, sf))


# --- quality ----------------------------------------------------------------------------------------------------


def reference(spark, sf):
    s = tables.subsegments(spark, sf)
    return s.select(
        "meeting_id", F.concat(F.lit("R"), F.col("label") % 4).alias("speaker"),
        (F.col("sub_idx") * 2).cast("double").alias("start"), (F.col("sub_idx") * 2 + F.lit(1.9)).alias("end"),
    )


def hypothesis(spark, sf):
    s = tables.subsegments(spark, sf)
    who = (F.col("label") + F.when(F.col("parent_idx") == 2, 1).otherwise(0)) % 4
    return s.select(
        "meeting_id", F.concat(F.lit("H"), who).alias("speaker"),
        (F.col("sub_idx") * 2 + F.lit(0.3)).alias("start"), (F.col("sub_idx") * 2 + F.lit(2.1)).alias("end"),
    )


SQL["t_ref"] = """
SELECT meeting_id, 'R' || (label % 4) AS speaker, CAST(sub_idx * 2 AS DOUBLE) AS start, sub_idx * 2 + 1.9e0 AS "end" FROM t_sub"""
SQL["t_hyp"] = """
SELECT meeting_id, 'H' || ((label + CASE WHEN parent_idx = 2 THEN 1 ELSE 0 END) % 4) AS speaker,
       sub_idx * 2 + 0.3e0 AS start, sub_idx * 2 + 2.1e0 AS "end" FROM t_sub"""


@query(
    "der_components",
    """WITH e AS (SELECT meeting_id, unnest([start, "end", start - 0.125e0, start + 0.125e0, "end" - 0.125e0, "end" + 0.125e0]) AS t FROM t_ref
         UNION SELECT meeting_id, unnest([start, "end"]) FROM t_hyp),
       p AS (SELECT meeting_id, t AS a, lead(t) OVER (PARTITION BY meeting_id ORDER BY t) AS b FROM (SELECT DISTINCT * FROM e)),
       m AS (SELECT *, (a + b) / 2 AS c, b - a AS dur FROM p WHERE b IS NOT NULL),
       q AS (SELECT m.meeting_id, a, dur,
          (SELECT list(speaker) FROM t_ref r WHERE r.meeting_id = m.meeting_id AND c > r.start AND c < r."end") AS rs,
          (SELECT list('R' || substr(speaker, 2)) FROM t_hyp h WHERE h.meeting_id = m.meeting_id AND c > h.start AND c < h."end") AS hs,
          EXISTS (SELECT 1 FROM t_ref r WHERE r.meeting_id = m.meeting_id AND (abs(c - r.start) < 0.125e0 OR abs(c - r."end") < 0.125e0)) AS collar FROM m),
       n AS (SELECT meeting_id, dur, coalesce(len(rs), 0) AS nr, coalesce(len(hs), 0) AS nh, coalesce(len(list_intersect(rs, hs)), 0) AS ok FROM q WHERE NOT collar AND coalesce(len(rs), 0) <= 1)
       SELECT meeting_id, round(sum(nr * dur), 6) AS total_s, round(sum(greatest(nr - nh, 0) * dur) / sum(nr * dur), 6) AS miss,
         round(sum(greatest(nh - nr, 0) * dur) / sum(nr * dur), 6) AS false_alarm,
         round(sum((least(nr, nh) - ok) * dur) / sum(nr * dur), 6) AS confusion,
         round(sum((greatest(nr, nh) - ok) * dur) / sum(nr * dur), 6) AS der FROM n GROUP BY 1""",
)
def der_components(spark, sf):
    out = diarization.der_components(reference(spark, sf), hypothesis(spark, sf))
    return out.select("meeting_id", *[F.round(c, 6).alias(c) for c in ("total_s", "miss", "false_alarm", "confusion", "der")])


@query(
    "der_optimal_map",
    """WITH o AS (SELECT r.meeting_id, r.speaker AS r, h.speaker AS h, sum(least(r."end", h."end") - greatest(r.start, h.start)) AS w
         FROM t_ref r JOIN t_hyp h ON h.meeting_id = r.meeting_id AND h.start < r."end" AND r.start < h."end" GROUP BY 1, 2, 3),
       n AS (SELECT meeting_id, list(DISTINCT r ORDER BY r) AS rs, list(DISTINCT h ORDER BY h) AS hs FROM o GROUP BY 1),
       s AS (SELECT meeting_id, rs, hs, u[1] AS a, u[2] AS b, u[3] AS c, u[4] AS d FROM n, (SELECT [a, b, c, d] AS u FROM range(4) x(a), range(4) y(b), range(4) z(c), range(4) w(d)
         WHERE a <> b AND a <> c AND a <> d AND b <> c AND b <> d AND c <> d)),
       k AS (SELECT meeting_id, a, b, c, d, unnest([{'r': rs[1], 'h': hs[a + 1]}, {'r': rs[2], 'h': hs[b + 1]}, {'r': rs[3], 'h': hs[c + 1]}, {'r': rs[4], 'h': hs[d + 1]}]) AS p FROM s)
       SELECT meeting_id, round(max(w), 6) AS overlap_s FROM (
         SELECT k.meeting_id, a, b, c, d, sum(coalesce(o.w, 0)) AS w FROM k LEFT JOIN o ON o.meeting_id = k.meeting_id AND o.r = p.r AND o.h = p.h GROUP BY 1, 2, 3, 4, 5) GROUP BY 1""",
)
def der_optimal_map(spark, sf):
    """Seconds that agree under the best one-to-one map of the speakers of each meeting."""
    met = diarization.speaker_cooccurrence(reference(spark, sf), hypothesis(spark, sf))
    best = met.join(assignment.optimal_map(met), ["meeting_id", "r_spk", "h_spk"])
    return best.groupBy("meeting_id").agg(F.round(F.sum("overlap_s"), 6).alias("overlap_s"))


@query("der_greedy_map")
def der_greedy_map(spark, sf):
    ref, hyp = reference(spark, sf), hypothesis(spark, sf)
    mapping = diarization.greedy_speaker_map(diarization.speaker_cooccurrence(ref, hyp))
    return diarization.der_components(ref, hyp, mapping)


@query(
    "snk_transcript_txt",
    """SELECT meeting_id, turn_idx, '[' || printf('%02d', CAST(floor(start / 60) AS BIGINT)) || ':' || lpad(printf('%.2f', start - floor(start / 60) * 60), 5, '0')
         || ' - ' || printf('%02d', CAST(floor("end" / 60) AS BIGINT)) || ':' || lpad(printf('%.2f', "end" - floor("end" / 60) * 60), 5, '0')
         || ']  ' || speaker || ' : ' || text AS line FROM t_turns""",
)
def snk_transcript_txt(spark, sf):
    t = words_to_turns(spark, sf)
    line = text.transcript_line(F.col("start"), F.col("end"), F.col("speaker"), F.col("text"))
    return t.select("meeting_id", "turn_idx", line.alias("line"))


@query(
    "snk_rttm",
    """SELECT meeting_id, 'SPEAKER ' || meeting_id || ' 1 ' || printf('%.6f', start) || ' ' || printf('%.6f', "end" - start) || ' <NA> <NA> ' || speaker || ' <NA> <NA>' AS line FROM t_merged""",
)
def snk_rttm(spark, sf):
    m = merged(spark, sf)
    return m.select("meeting_id", text.rttm_line(F.col("meeting_id"), F.col("start"), F.col("end"), F.col("speaker")).alias("line"))


@query(
    "snk_diar_txt",
    """SELECT meeting_id, '[' || lpad(printf('%.2f', start), 7, ' ') || ' - ' || lpad(printf('%.2f', "end"), 7, ' ') || ']  ' || speaker AS line FROM t_merged""",
)
def snk_diar_txt(spark, sf):
    m = merged(spark, sf)
    return m.select("meeting_id", text.diar_line(F.col("start"), F.col("end"), F.col("speaker")).alias("line"))
