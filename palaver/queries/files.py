"""Sources and sinks: tables are written in each file format and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from palaver.operators import alignment as align
from palaver.operators import reports, topics, transcripts
from palaver.queries import alignment, catalog, tables, telemetry
from palaver.queries import reports as report_queries
from palaver.queries import topics as topic_queries
from palaver.queries.registry import query
from palaver.session import shared_dir
from palaver.sources import readers, writers

PROMPT = "Résume ce passage."


def scratch(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def by_meeting(path, column="meeting_id"):
    """Directory names carry the partition column."""
    return F.regexp_replace(path, f"^{column}=", "")


@query("src_transcript_txt", "SELECT meeting_id, line_no, raw FROM t_lines")
def src_transcript_txt(spark, sf):
    path = scratch(spark, "transcripts")
    writers.write_lines(tables.transcript_lines(spark, sf), path, "line_no", "raw")
    out = readers.transcript_lines(spark, path)
    return out.withColumn("meeting_id", by_meeting(F.col("meeting_id")))


@query(
    "src_segments_json",
    'SELECT meeting_id, row_number() OVER (PARTITION BY meeting_id ORDER BY start, p) - 1 AS seg_idx, start, "end", speaker, text FROM (SELECT *, seg_idx AS p FROM t_segments)',
)
def src_segments_json(spark, sf):
    path = scratch(spark, "segments")
    s = tables.segments(spark, sf)
    docs = s.groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "speaker", "text"))).alias("segments"))
    docs.repartition(writers.writing_tasks(docs), "meeting_id").write.options(**writers.MOVED_BY_TASKS).partitionBy("meeting_id").option("maxRecordsPerFile", 1).json(path)
    out = readers.segments_json(spark, path).withColumn("meeting_id", by_meeting(F.col("meeting_id")))
    return transcripts.to_segments(out.withColumnRenamed("pos", "line_no"))


@query("src_turns_json", """SELECT meeting_id, turn_idx IS NOT NULL AS has_turns, speaker, start, "end", CASE WHEN speaker = 'user' THEN 'Ana' END AS name FROM (
    SELECT meeting_id, turn_idx, start, "end", speaker FROM t_turns UNION ALL SELECT 'none', NULL, NULL, NULL, NULL FROM (SELECT max(conv_id) FROM conversations))""")
def src_turns_json(spark, sf):
    root = scratch(spark, "turns")
    turns = alignment.words_to_turns(spark, sf)
    body = turns.select("meeting_id", F.to_json(F.struct("start", "end", "speaker", "text")).alias("line"), "turn_idx")
    writers.write_lines(body, f"{root}/t", "turn_idx")
    # Spark names its files itself, so the array reader is given the line form of the same rows
    with readers.listing(spark):
        read = spark.read.schema("start double, end double, speaker string, text string").option("recursiveFileLookup", "true").json(f"{root}/t")
    rows = read.select(
        by_meeting(readers.meeting_of(F.col("_metadata.file_path"))).alias("meeting_id"), "start", "end", "speaker", "text"
    )
    names = turns.filter("speaker = 'user'").select("meeting_id", F.col("speaker").alias("label"), F.lit("Ana").alias("name")).distinct()
    met = turns.select("meeting_id").distinct().unionByName(turns.groupBy().agg(F.lit("none").alias("meeting_id")))
    return readers.job_turns(met, rows, names).select("meeting_id", "has_turns", "speaker", "start", "end", "name")


@query("src_meeting_tree")
def src_meeting_tree(spark, sf):
    """One directory per job category with one raw file per job kind."""
    root = scratch(spark, "tree")
    f = catalog.files(spark, sf).join(tables.jobs(spark, sf).select("id", "folder", "status"), "id")
    kinds = f.groupBy(F.coalesce("folder", F.lit("none")).alias("folder"), "status").agg(F.count("*").cast("string").alias("value"))
    kinds.write.partitionBy("folder", "status").text(root)
    return readers.file_listing(spark, root).groupBy("dir").agg(F.count("*").alias("n")).select(
        F.regexp_extract("dir", r"folder=([^/]*)", 1).alias("folder"), "n"
    )


@query("src_calendar_json", "SELECT id, CASE WHEN subject = '' THEN '(sans objet)' ELSE subject END AS subject, start, location, is_online, trim(preview, ' ' || chr(10)) AS preview FROM t_cal")
def src_calendar_json(spark, sf):
    root = scratch(spark, "calendar")
    c = tables.calendar_events(spark, sf)

    def mail(name, address):
        return F.struct(F.struct(name.alias("name"), address.alias("address")).alias("emailAddress"))

    people = F.transform(
        "attendees", lambda a: F.struct(a["type"].alias("type"), F.struct(a["name"].alias("name"), a["address"].alias("address")).alias("emailAddress"))
    )
    doc = F.array(
        F.struct(
            "id", "subject", F.struct(F.col("start").alias("dateTime"), F.lit("Europe/Paris").alias("timeZone")).alias("start"),
            F.struct(F.col("end").alias("dateTime"), F.lit("Europe/Paris").alias("timeZone")).alias("end"),
            mail(F.col("organizer_name"), F.col("organizer_address")).alias("organizer"), F.struct(F.col("location").alias("displayName")).alias("location"),
            people.alias("attendees"), F.col("is_online").alias("isOnlineMeeting"), F.col("preview").alias("bodyPreview"),
        )
    )
    c.select(doc.alias("value")).write.option("maxRecordsPerFile", 0).json(root)
    out = readers.calendar_json_lines(spark, root)
    return out.select("id", "subject", "start", "location", "is_online", "preview")


@query("src_resource_csv", "SELECT t AS uptime_s, rss_mb AS python_rss_mb, CASE WHEN label = 'view' THEN 0 ELSE 2 END AS n_pids FROM t_samples")
def src_resource_csv(spark, sf):
    root = scratch(spark, "resources")
    s = tables.samples(spark, sf)
    z = F.lit(0.0)
    pids = F.when(F.col("label") != "view", F.concat(F.lit("10,"), (F.col("event_id") + 1).cast("string")))
    s.select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.col("t").alias("uptime_s"), F.col("rss_mb").alias("python_rss_mb"),
        z.alias("python_vms_mb"), z.alias("llama_rss_mb"), pids.alias("llama_pids"), z.alias("system_used_mb"), z.alias("system_available_mb"),
        z.alias("system_percent"), z.alias("swap_used_mb"), z.alias("swap_percent"),
    ).write.option("header", "true").csv(root)
    return readers.resource_csv(spark, root).select("uptime_s", "python_rss_mb", F.size("llama_pids").alias("n_pids"))


@query("src_run_breakdown", "SELECT run_id, step, calls, CAST(in_tok AS BIGINT) AS input_tokens, model FROM t_steps")
def src_run_breakdown(spark, sf):
    root = scratch(spark, "breakdown")
    st = telemetry.steps(spark, sf)
    body = F.struct(
        F.col("calls").cast("int").alias("calls"), F.col("in_tok").alias("input_tokens"), F.col("out_tok").alias("output_tokens"),
        F.col("cached_in").alias("cached_input_tokens"), "latency_s", "cost_usd", "model",
    )
    docs = st.groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.struct("step", body.alias("s")))).alias("steps"), F.struct(F.sum("cost_usd").alias("cost_usd")).alias("total"))
    docs.select(F.col("run_id").alias("architecture"), "steps", "total").write.json(root)
    out = readers.run_breakdown_lines(spark, root)
    return out.select(F.col("architecture").alias("run_id"), "step", F.col("calls").cast("long").alias("calls"), "input_tokens", "model")


@query("src_variant_metrics", "SELECT bench, variant, compress_s, resume_wall_s FROM t_variants")
def src_variant_metrics(spark, sf):
    root = scratch(spark, "variants")
    v = telemetry.variants(spark, sf)
    m = v.groupBy("bench").agg(F.map_from_entries(F.collect_list(F.struct("variant", F.struct("compress_s", "resume_wall_s", "extraction_wall_s", "plan_wall_s")))).alias("m"))
    m.select("bench", F.to_json("m").alias("value")).repartition(writers.writing_tasks(m), "bench").write.options(**writers.MOVED_BY_TASKS).partitionBy("bench").text(root)
    out = readers.variant_metrics(spark, root)
    return out.select(by_meeting(F.col("bench"), "bench").cast("long").alias("bench"), "variant", "compress_s", "resume_wall_s")


@query("src_rttm", 'SELECT meeting_id, round(start, 6) AS start, round("end", 6) AS "end", speaker FROM t_merged')
def src_rttm(spark, sf):
    root = scratch(spark, "rttm")
    writers.write_rttm(alignment.merged(spark, sf), root)
    out = readers.rttm(spark, root)
    return out.withColumns({"start": F.round("start", 6), "end": F.round("end", 6)})


@query("src_report_md", "SELECT meeting_id, line_no, line AS raw FROM t_report")
def src_report_md(spark, sf):
    root = scratch(spark, "reports")
    writers.write_reports(report_queries.assemble_report(spark, sf), root)
    out = readers.text_lines(spark, root, "*")
    return out.withColumn("meeting_id", by_meeting(F.col("meeting_id")))


def teams_runs(spark, sf):
    """A paragraph per segment: bold speaker, timestamp, then the text's lines with breaks between; systems have no time."""
    s = tables.segments(spark, sf)
    lines = F.split("text", "\n")
    none = F.lit(None).cast("string")

    def run(bold, body, brk):
        return F.struct(F.lit(bold).alias("is_bold"), body.alias("text"), F.lit(brk).alias("is_break"))

    stamp = F.when(F.col("speaker") == "system", F.lit("a commencé")).otherwise(F.concat(F.lit("0:0"), "seg_idx"))
    body = F.flatten(F.transform(lines, lambda x: F.array(run(False, x, False), run(False, none, True))))
    runs = F.concat(F.array(run(True, F.lit(" "), False), run(True, F.col("speaker"), False), run(False, stamp, False)), body)
    return s.select("meeting_id", F.col("seg_idx").alias("para_idx"), F.posexplode(runs).alias("run_idx", "r")).select(
        "meeting_id", "para_idx", "run_idx", "r.*"
    )


@query(
    "src_teams_runs",
    """SELECT meeting_id, seg_idx AS para_idx, '00:00:0' || seg_idx AS ts, speaker, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s)), lambda s: s <> ''), ' ') AS text
       FROM t_segments WHERE speaker <> 'system'""",
)
def src_teams_runs(spark, sf):
    return transcripts.teams_turns(teams_runs(spark, sf))


# --- sinks ------------------------------------------------------------------------------------------------------


@query("snk_words_turns_json", "SELECT 'midpoint' AS alignment, meeting_id, word_idx, speaker FROM t_mid UNION ALL SELECT 'boundary', meeting_id, word_idx, speaker FROM t_bnd")
def snk_words_turns_json(spark, sf):
    path = scratch(spark, "words")
    words, segs = tables.words(spark, sf), tables.diar_segments(spark, sf)
    cols = ["meeting_id", "word_idx", "word", "start", "end", "speaker"]
    writers.write_words_turns(align.align_words_midpoint(words, segs).select(*cols), align.align_words_boundary(words, segs).select(*cols), path)
    schema = "meeting_id string, word_idx long, word string, start double, end double, speaker string, alignment string"
    return spark.read.schema(schema).json(path).select("alignment", "meeting_id", "word_idx", "speaker")


@query("snk_sections_cache", "SELECT meeting_id, chunk_id FROM t_sections WHERE chunk_id >= 2 AND resume NOT IN (SELECT resume FROM t_sections WHERE chunk_id < 2)")
def snk_sections_cache(spark, sf):
    """The first two chunks of each meeting are cached; the rest is pending."""
    path = scratch(spark, "cache")
    chunks = tables.sections(spark, sf).select("meeting_id", "chunk_id", F.col("resume").alias("text"))
    first = writers.pending_chunks(chunks.filter("chunk_id < 2"), None, PROMPT)
    writers.append_sections(first.select("chunk_key", "meeting_id", "chunk_id"), path)
    cache = spark.read.schema("chunk_key string, meeting_id string, chunk_id int").parquet(path)
    return writers.pending_chunks(chunks, cache, PROMPT).select("meeting_id", "chunk_id")


@query(
    "snk_similarity",
    """SELECT c.meeting_id, c.win_idx, round(c.raw, 6) AS raw, round(c.smoothed, 6) AS smoothed, b.win_idx IS NOT NULL AS is_boundary
       FROM t_curve c LEFT JOIN t_bounds b ON b.meeting_id = c.meeting_id AND b.win_idx = c.win_idx""",
)
def snk_similarity(spark, sf):
    path = scratch(spark, "similarity")
    curve = topic_queries.curve(spark, sf)
    picked = topics.min_distance_pick(topics.percentile_candidates(curve, topic_queries.P))
    writers.write_similarity(curve.select("meeting_id", "win_idx", "raw", "smoothed"), picked, path)
    out = spark.read.parquet(path)
    return out.withColumns({"raw": F.round("raw", 6), "smoothed": F.round("smoothed", 6)})


@query("snk_assembly", "SELECT c.meeting_id, c.chunk_id, c.n_decisions, CAST(sum(n_decisions) OVER (PARTITION BY meeting_id) AS BIGINT) AS n_decisions_total FROM t_counts c")
def snk_assembly(spark, sf):
    path = scratch(spark, "assembly")
    s = tables.sections(spark, sf)
    writers.write_assembly(reports.section_counts(s), reports.assembly_totals(s), path)
    return spark.read.schema("meeting_id string, chunk_id int, n_decisions int, n_decisions_total long").json(path)


@query("snk_run_metrics", "SELECT meeting_id, count(*) AS n_chunks, count(*) * 3 + 1 AS n_calls FROM t_sections GROUP BY 1")
def snk_run_metrics(spark, sf):
    from palaver.operators.telemetry import calls_needed

    path = scratch(spark, "metrics")
    s = tables.sections(spark, sf)
    facts = s.groupBy("meeting_id").agg(F.count("*").alias("n_chunks")).join(calls_needed(s, "perchunk"), "meeting_id")
    writers.append_run_metrics(facts, path)
    return spark.read.schema(facts.schema).parquet(path)


@query("snk_report_md", "SELECT meeting_id, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM t_report GROUP BY 1")
def snk_report_md(spark, sf):
    out = src_report_md(spark, sf)
    return out.groupBy("meeting_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("raw")).alias("n_chars"))
