"""Streaming queries: the input tables are written as files, streamed to the end and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from palaver.functions import dates
from palaver.operators import clusters, live, transcripts
from palaver.queries import tables
from palaver.queries.registry import query
from palaver.queries.scalars import SQL_SENTENCE_TURNS
from palaver.session import cut_lineage, shared_dir
from palaver.sources.versioned import BUCKETS, bucket_of
from palaver.streaming import jobs

EPOCH = "2024-01-01 00:00:00"


def at(seconds):
    return F.lit(EPOCH).cast("timestamp") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def with_end(df, key, order):
    """One closing row per key, after all others."""
    last = df.groupBy(key).agg((F.max(order) + 1).cast(df.schema[order].dataType).alias(order)).withColumn("ended", F.lit(True))
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema if f.name not in (key, order)]
    return df.withColumn("ended", F.lit(False)).unionByName(last.select(key, order, "ended", *missing))


def live_turns(spark, sf):
    s = tables.segments(spark, sf)
    return s.select(
        "meeting_id", F.col("seg_idx").alias("turn_idx"), (F.col("seg_idx") * 3 + F.when(F.col("seg_idx") > 4, 130).otherwise(0)).cast("double").alias("now"),
        "speaker", (F.col("speaker") != "system").alias("is_other"), F.col("text").endswith(".").alias("final"),
    )


SQL = tables.SQL
SQL["t_trigger"] = """
WITH RECURSIVE t AS (SELECT meeting_id, seg_idx AS turn_idx, seg_idx * 3 + CASE WHEN seg_idx > 4 THEN 130e0 ELSE 0 END AS now, speaker, speaker <> 'system' AS other,
    ends_with(text, '.') AS final, row_number() OVER (PARTITION BY meeting_id ORDER BY seg_idx) AS rn FROM t_segments),
r AS (SELECT meeting_id, CAST(0 AS BIGINT) AS rn, -1 AS turn_idx, 0e0 AS last_fire, CAST(NULL AS VARCHAR) AS last_speaker, false AS fired FROM t WHERE rn = 1
  UNION ALL
  SELECT meeting_id, rn, turn_idx, CASE WHEN f THEN now ELSE last_fire END, speaker, f FROM (
    SELECT t.*, r.last_fire, t.now - r.last_fire >= 120 OR (t.now - r.last_fire >= 6 AND t.other AND (t.final OR coalesce(r.last_speaker <> t.speaker, false))) AS f
    FROM r JOIN t ON t.meeting_id = r.meeting_id AND t.rn = r.rn + 1))
SELECT meeting_id, turn_idx, fired FROM r WHERE rn > 0"""
SQL["t_built"] = """
WITH RECURSIVE a AS (SELECT *, lag(speaker) OVER w AS ps, lag("end") OVER w AS pe FROM t_words WINDOW w AS (PARTITION BY meeting_id ORDER BY word_idx)),
b AS (SELECT *, sum(CASE WHEN ps = speaker AND start - pe <= 0.8e0 THEN 0 ELSE 1 END) OVER (PARTITION BY meeting_id ORDER BY word_idx) AS run FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY meeting_id, run ORDER BY word_idx) AS rn, regexp_matches(word, '[.!?…]$') AS fin FROM b),
r AS (SELECT meeting_id, run, rn, word_idx, word, speaker, start, "end", start AS ts, 1 AS n, 0 AS part, false AS closed FROM c WHERE rn = 1
  UNION ALL
  SELECT meeting_id, run, rn, word_idx, word, speaker, start, "end", ts, n, part, n > 1 AND ((fin AND "end" - ts >= 5) OR "end" - ts >= 30 OR n >= 120) FROM (
    SELECT c.*, CASE WHEN r.closed THEN c.start ELSE r.ts END AS ts, CASE WHEN r.closed THEN 1 ELSE r.n + 1 END AS n, CASE WHEN r.closed THEN r.part + 1 ELSE r.part END AS part
    FROM r JOIN c ON c.meeting_id = r.meeting_id AND c.run = r.run AND c.rn = r.rn + 1))
SELECT meeting_id, min(start) AS start, max("end") AS "end", any_value(speaker) AS speaker, string_agg(word, ' ' ORDER BY word_idx) AS text FROM r GROUP BY meeting_id, run, part"""
SQL["t_sugg"] = """
WITH RECURSIVE g AS (SELECT meeting_id, CAST(seg_idx AS DOUBLE) AS ts, row_number() OVER (PARTITION BY meeting_id ORDER BY seg_idx) AS rn,
    list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s, ' ' || chr(9) || chr(13))), lambda s: s <> '') AS c FROM t_segments),
u AS (SELECT *, list_transform(c, lambda s: lower(s)) AS lc FROM g),
r AS (SELECT meeting_id, CAST(0 AS BIGINT) AS rn, 0e0 AS ts, CAST([] AS VARCHAR[][]) AS mem, CAST([] AS VARCHAR[]) AS kept FROM u WHERE rn = 1
  UNION ALL
  SELECT meeting_id, rn, ts, CASE WHEN len(k) > 0 THEN list_slice(list_append(mem, list_transform(k, lambda s: lower(s))), greatest(1, len(mem) - 2), len(mem) + 1) ELSE mem END, k FROM (
    SELECT u.meeting_id, u.rn, u.ts, r.mem, list_slice(list_filter(u.c, lambda s, i: list_position(u.lc, lower(s)) = i AND NOT list_contains(flatten(r.mem), lower(s))), 1, 3) AS k
    FROM r JOIN u ON u.meeting_id = r.meeting_id AND u.rn = r.rn + 1))
SELECT meeting_id, ts, i - 1 AS pos, kept[i] AS item FROM (SELECT *, unnest(range(1, len(kept) + 1)) AS i FROM r WHERE rn > 0)"""


@query("live_trigger", "SELECT * FROM t_trigger")
def live_trigger(spark, sf):
    return live.live_trigger(live_turns(spark, sf))


@query("st_live_trigger", "SELECT * FROM t_trigger")
def st_live_trigger(spark, sf):
    return jobs.run_to_table(jobs.trigger(jobs.as_stream(live_turns(spark, sf), ["turn_idx"])))


def groups(spark, sf):
    items = F.split("text", "\n")
    return tables.segments(spark, sf).select("meeting_id", F.col("seg_idx").cast("double").alias("ts"), items.alias("items"))


@query("suggestion_dedup", "SELECT * FROM t_sugg")
def suggestion_dedup(spark, sf):
    return live.suggestion_dedup(groups(spark, sf))


@query("st_suggestion_dedup", "SELECT * FROM t_sugg")
def st_suggestion_dedup(spark, sf):
    return jobs.run_to_table(jobs.dedup_suggestions(jobs.as_stream(groups(spark, sf), ["ts"])))


@query(
    "st_words_source",
    "SELECT meeting_id, word_idx, word FROM t_words",
)
def st_words_source(spark, sf):
    """Every word is sent twice, as by a recogniser that repeats its list."""
    w = tables.words(spark, sf).withColumn("ts", at(F.col("start")))
    twice = w.unionByName(w).select("meeting_id", "word_idx", "word", "ts")
    return jobs.run_to_table(jobs.new_words(jobs.as_stream(twice, ["ts", "word_idx"]), "1 day")).select("meeting_id", "word_idx", "word")


@query(
    "st_sliding_vectors",
    """SELECT meeting_id, start_ms, start_ms + 1200 AS end_ms FROM (
         SELECT series_id AS meeting_id, rss_mb, 600 * (ms // 600 - k) AS start_ms FROM (
           SELECT *, 1704067200000 + CAST(floor(round(t * 1000000) / 1000) AS BIGINT) AS ms, unnest([0, 1]) AS k FROM t_samples))
       GROUP BY 1, 2 HAVING bool_or(least(rss_mb / 100, 1.0e0) >= 0.4e0)""",
)
def st_sliding_vectors(spark, sf):
    s = tables.samples(spark, sf)
    f = s.select(F.col("series_id").alias("meeting_id"), F.least(F.col("rss_mb") / 100, F.lit(1.0)).alias("prob"), at(F.col("t")).alias("ts"))
    out = jobs.run_to_table(jobs.sliding_speech(jobs.as_stream(f, ["ts"]), delay="1 minute"))
    return out.select("meeting_id", F.unix_millis("start").alias("start_ms"), F.unix_millis("end").alias("end_ms"))


@query("turn_builder", "SELECT * FROM t_built")
def turn_builder(spark, sf):
    return transcripts.turn_builder(tables.words(spark, sf))


@query("st_turn_builder", "SELECT * FROM t_built")
def st_turn_builder(spark, sf):
    w = with_end(tables.words(spark, sf), "meeting_id", "word_idx")
    return jobs.run_to_table(jobs.build_turns(jobs.as_stream(w, ["word_idx"])))


def silent_turns(words, idle=600_000, beat=3600, **kw):
    """Turns of meetings that nobody ends. A last row of another meeting, ``beat`` seconds later, moves the watermark on."""
    rows = words.withColumn("ts", at(F.col("start")))
    beats = rows.agg(F.max("start").alias("start"), F.max("ts").alias("ts"), F.max("word_idx").alias("word_idx")).select(
        F.lit("~").alias("meeting_id"), "word_idx", F.lit("").alias("word"), "start", F.col("start").alias("end"), F.lit("?").alias("speaker"),
        (F.col("ts") + F.make_dt_interval(secs=F.lit(beat))).alias("ts"),
    )
    stream = jobs.as_stream(rows.select(*beats.columns).unionByName(beats), ["ts"], **kw)
    return jobs.run_to_table(jobs.build_turns(stream, idle))


@query("st_silent_meeting", "SELECT * FROM t_built")
def st_silent_meeting(spark, sf):
    """Every meeting is ended by its silence of ten minutes."""
    return silent_turns(tables.words(spark, sf))


@query("st_sentence_split", SQL_SENTENCE_TURNS)
def st_sentence_split(spark, sf):
    out = jobs.run_to_table(jobs.split_turns(jobs.as_stream(tables.segments(spark, sf), ["seg_idx"])))
    return out.withColumns({"start": F.round("start", 6), "end": F.round("end", 6)})


def topic_turns(spark, sf):
    return tables.topic_segments(spark, sf).withColumn("speaker", F.coalesce("speaker", F.lit("?")))


@query("topic_chunker")
def topic_chunker(spark, sf):
    return live.topic_chunker(topic_turns(spark, sf), k_sigma=1.0)


def stream_chunks(spark, sf, **kw):
    rows = with_end(topic_turns(spark, sf), "meeting_id", "seg_idx")
    return jobs.run_to_table(jobs.chunk_topics(jobs.as_stream(rows, ["seg_idx"]), **kw))


@query("st_topic_chunker")
def st_topic_chunker(spark, sf):
    return stream_chunks(spark, sf, k_sigma=1.0)


@query("st_size_cap")
def st_size_cap(spark, sf):
    return stream_chunks(spark, sf, k_sigma=1.0)


@query(
    "st_finalize",
    """WITH RECURSIVE t AS (SELECT *, coalesce(speaker, '?') AS sp, length(text) + length(coalesce(speaker, '?')) + 4 AS size,
         row_number() OVER (PARTITION BY meeting_id ORDER BY seg_idx) AS rn FROM t_topic),
       r AS (SELECT meeting_id, rn, 0 AS chunk_id, size AS held, size >= 15000 AS closed FROM t WHERE rn = 1
         UNION ALL
         SELECT t.meeting_id, t.rn, r.chunk_id + CAST(r.closed AS INTEGER), CASE WHEN r.closed THEN 0 ELSE r.held END + t.size,
           CASE WHEN r.closed THEN 0 ELSE r.held END + t.size >= 15000
         FROM r JOIN t ON t.meeting_id = r.meeting_id AND t.rn = r.rn + 1)
       SELECT meeting_id, chunk_id, min(start) AS start_time, max("end") AS end_time, count(*) AS n_turns,
         string_agg('[' || sp || ']: ' || text, chr(10) ORDER BY rn) AS text FROM r JOIN t USING (meeting_id, rn) GROUP BY 1, 2""",
)
def st_finalize(spark, sf):
    """Chunks that only the size cap or the end of the meeting closes: no valley is that deep."""
    return stream_chunks(spark, sf, k_sigma=100.0)


@query(
    "st_provisional_speaker",
    """SELECT meeting_id, word_idx, coalesce('SPEAKER_' || lpad(CAST(label AS VARCHAR), 2, '0'), 'SPEAKER_?') AS speaker FROM (
         SELECT w.meeting_id, w.sub_idx AS word_idx, v.label, row_number() OVER (PARTITION BY w.meeting_id, w.sub_idx ORDER BY abs((w.start + 0.9e0) - (v.start + 0.6e0)), v.sub_idx) AS rn
         FROM t_sub w LEFT JOIN t_sub v ON v.meeting_id = w.meeting_id AND v.sub_idx * 2 > 10 AND v.sub_idx <= w.sub_idx) WHERE rn = 1""",
)
def st_provisional_speaker(spark, sf):
    s = tables.subsegments(spark, sf)
    empty = F.lit(None)
    vec = s.select(
        "meeting_id", (F.col("sub_idx") * 2).cast("long").alias("seq"), F.lit("vector").alias("kind"), (F.col("start") + 0.6).alias("t"),
        empty.cast("long").alias("word_idx"), F.col("label").cast("long").alias("label"),
    ).filter("seq > 10")
    word = s.select(
        "meeting_id", (F.col("sub_idx") * 2 + 1).cast("long").alias("seq"), F.lit("word").alias("kind"), (F.col("start") + 0.9).alias("t"),
        F.col("sub_idx").cast("long").alias("word_idx"), empty.cast("long").alias("label"),
    )
    return jobs.run_to_table(jobs.provisional_speakers(jobs.as_stream(vec.unionByName(word), ["seq"])))


@query("st_online_clusterer")
def st_online_clusterer(spark, sf):
    """All vectors of a meeting are streamed; the first 20 are labelled by the bootstrap."""
    vecs = tables.subsegments(spark, sf)
    return online_labels(vecs, 20)


def online_labels(vecs, size, **kw):
    boot = clusters.bootstrap(vecs, size)
    packed = clusters.centroids(boot).groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct("label", "centroid", "n"))).alias("cents"))
    limit = clusters.calibrate_threshold(boot)
    rows = with_end(vecs.select("meeting_id", "sub_idx", "embedding"), "meeting_id", "sub_idx")
    return jobs.run_to_table(jobs.assign_online(jobs.as_stream(rows, ["sub_idx"], **kw), cut_lineage(packed.join(limit, "meeting_id")), cut_lineage(boot), size))


@query(
    "st_status_transition",
    """SELECT job_id, min(t) AS t FROM (SELECT *, lag(status) OVER (PARTITION BY job_id ORDER BY t, event_id) AS before FROM t_status)
       WHERE status = 'done' AND before IN ('running', 'queued', 'pending') GROUP BY 1""",
)
def st_status_transition(spark, sf):
    return jobs.run_to_table(jobs.status_notices(jobs.as_stream(tables.status_log(spark, sf), ["t", "event_id"], "job_id")))


@query("st_end_reminder")
def st_end_reminder(spark, sf):
    """Each user's events as recorder states; a view starts a recording that should end 90 minutes later."""
    s = tables.samples(spark, sf)
    on = F.col("label").isin("view", "click")
    rows = s.select(
        F.col("series_id").alias("job_id"), at(F.col("t")).alias("ts"), (F.col("label") != "error").alias("recording"),
        F.when(on, F.concat(F.lit("e"), F.floor(F.col("t") / 5400).cast("string"))).alias("event_id"),
        F.when(on, 1704067200000 + (F.floor(F.col("t") / 5400) + 1) * 5400000).cast("long").alias("end_ms"),
    )
    return jobs.run_to_table(jobs.end_reminders(jobs.as_stream(rows, ["ts"], "job_id")))


@query(
    "st_notify_timers",
    """WITH r AS (SELECT series_id AS calendar_id, epoch_us(ts) // 1000 AS ms, epoch_us(ts) // 5400000000 AS slot, label = 'error' AS rec FROM t_samples WHERE label IN ('view', 'click', 'error')),
       e AS (SELECT *, (slot + 1) * 5400000 - 300000 AS due FROM r),
       f AS (SELECT calendar_id, slot, due, min(ms) FILTER (WHERE NOT rec AND due - ms BETWEEN -60000 AND 3600000) AS p, min(ms) FILTER (WHERE rec) AS begun FROM e GROUP BY 1, 2, 3)
       SELECT calendar_id, 'e' || CAST(slot AS VARCHAR) AS event_id, greatest(due, p) AS at_ms FROM f
       WHERE p IS NOT NULL AND slot % 7 <> 0 AND (begun IS NULL OR (begun >= greatest(due, p) AND begun > p)) AND greatest(due, p) <= (SELECT max(ms) FROM r)""",
)
def st_notify_timers(spark, sf):
    """Each user's events as a calendar: a view or click lists the event that starts at the end of its 90 minutes, an error is
    the start of its recording. Of every seventh event the notice was told before."""
    s = tables.samples(spark, sf).filter(F.col("label").isin("view", "click", "error")).withColumn("ts", F.timestamp_millis(dates.epoch_ms(F.col("ts"))))
    slot = F.floor(F.unix_millis("ts") / 5400000)
    rows = s.select(
        F.col("series_id").alias("calendar_id"), "ts", (F.col("label") == "error").alias("recorded"),
        F.concat(F.lit("e"), slot.cast("string")).alias("event_id"), ((slot + 1) * 5400000).cast("long").alias("start_ms"),
    )
    told = s.filter(slot % 7 == 0).select(F.col("series_id").alias("calendar_id"), F.concat(F.lit("e"), slot.cast("string")).alias("event_id"), ((slot + 1) * 5400000 - 300000).cast("long").alias("at_ms"))
    return jobs.run_to_table(jobs.due_notices(jobs.as_stream(rows, ["ts"], "calendar_id"), told.distinct(), delay="0 seconds"))


@query("st_sections_out_of_order", "SELECT meeting_id, chunk_id, row_number() OVER (PARTITION BY meeting_id ORDER BY start_time, chunk_id) AS no FROM t_sections")
def st_sections_out_of_order(spark, sf):
    """Sections arrive by length of their text; order comes back on read."""
    from palaver.operators.reports import sort_sections

    s = tables.sections(spark, sf).select("meeting_id", "chunk_id", "start_time", F.length("resume").alias("size"))
    return sort_sections(jobs.run_to_table(jobs.as_stream(s, ["size"]))).select("meeting_id", "chunk_id", "no")


@query("st_backpressure", "SELECT meeting_id, CAST(count(*) AS BIGINT) AS n FROM t_segments GROUP BY 1")
def st_backpressure(spark, sf):
    """The source is read one file per micro-batch, and nothing is dropped."""
    s = tables.segments(spark, sf).select("meeting_id", "seg_idx")
    return jobs.run_to_table(jobs.as_stream(s, ["seg_idx"], slices=4, per_trigger=1)).groupBy("meeting_id").agg(F.count("*").alias("n"))


@query("st_late_data", "SELECT meeting_id, word_idx, speaker FROM t_mid")
def st_late_data(spark, sf):
    """Provisional words come from a stream; the final alignment then replaces the rows of each meeting.

    Meetings are dealt to a fixed number of buckets, so files do not grow with their number; a bucket is replaced whole."""
    from palaver.operators.alignment import align_words_midpoint

    words = tables.words(spark, sf).withColumn("speaker", F.lit("SPEAKER_?")).select("meeting_id", "word_idx", "start", "end", "word", "speaker")
    path = f"{shared_dir(spark)}/words-{uuid.uuid4().hex}"
    bucket = bucket_of(F.col("meeting_id"), BUCKETS)
    stream = jobs.as_stream(words, ["word_idx"]).withColumn("bucket", bucket)
    q = (
        stream.writeStream.format("parquet").partitionBy("bucket").option("checkpointLocation", f"{path}-state")
        .trigger(availableNow=True).start(path)
    )
    q.awaitTermination()
    provisional = spark.read.schema(stream.schema).parquet(path).drop("bucket")
    final = align_words_midpoint(provisional, tables.diar_segments(spark, sf)).select("meeting_id", "word_idx", "speaker", bucket.alias("bucket"))
    table = f"{path}-final"
    final.write.partitionBy("bucket").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(table)
    return spark.read.schema(final.schema).parquet(table).drop("bucket")
