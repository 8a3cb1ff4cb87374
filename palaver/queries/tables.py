"""Meeting tables derived from the given test tables, once in Spark and once in SQL.

Each function reads the whole given table; each entry of ``SQL`` is the same table for DuckDB.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.functions import dates
from palaver.plans.rows import spread
from palaver.plans.scans import running_number

NOW = "2024-01-01 01:30:00"  # the fixed "now" of the registered queries


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def read_texts(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table whose texts are worth spreading over the cores."""
    return spread(read(spark, sf, name))


SQL: dict[str, str] = {}


def with_tables(sql: str) -> str:
    """Prefix the definitions of the tables a statement names."""
    wanted: list[str] = []

    def visit(text: str) -> None:
        for name, definition in SQL.items():
            if name not in wanted and re.search(rf"\b{name}\b", text):
                visit(definition)
                wanted.append(name)

    visit(sql)
    if not wanted:
        return sql
    ctes = ",\n".join(f"{name} AS ({SQL[name]})" for name in wanted)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes},\n{body[len('WITH RECURSIVE'):]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


# --- transcripts ------------------------------------------------------------------------------------------------


def segments(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "conversations")
    return c.select(
        F.concat(F.lit("m"), "conv_id").alias("meeting_id"),
        F.col("turn").cast("int").alias("seg_idx"),
        F.col("turn").cast("double").alias("start"),
        (F.col("turn") + 1).cast("double").alias("end"),
        F.col("role").alias("speaker"),
        "text",
    )


SQL["t_segments"] = """
SELECT 'm' || conv_id AS meeting_id, CAST(turn AS INTEGER) AS seg_idx, CAST(turn AS DOUBLE) AS start,
       CAST(turn + 1 AS DOUBLE) AS "end", role AS speaker, text FROM conversations"""


def transcript_lines(spark: SparkSession, sf: str) -> DataFrame:
    """One line per conversation turn, in the four grammars by turn number."""
    c = read(spark, sf, "conversations")
    two = F.lpad(F.col("turn").cast("string"), 2, "0")
    nxt = F.lpad((F.col("turn") + 1).cast("string"), 2, "0")
    text = F.replace("text", F.lit("\n"), F.lit(" "))
    kind = F.col("turn") % 4
    raw = (
        F.when(kind == 0, F.concat(F.lit("["), two, F.lit(":05.50 - "), nxt, F.lit(":02.25]  "), "role", F.lit(" : "), text))
        .when(kind == 1, F.concat(F.lit("[00:"), two, F.lit(":07] "), "role", F.lit(": "), text))
        .when(kind == 2, F.concat(F.lit("["), two, F.lit(":09] **"), "role", F.lit("**: "), text))
        .otherwise(F.concat("role", F.lit(": "), text))
    )
    return c.select(
        F.concat(F.lit("m"), "conv_id").alias("meeting_id"), F.col("turn").cast("int").alias("line_no"), raw.alias("raw")
    )


SQL["t_lines"] = """
SELECT 'm' || conv_id AS meeting_id, CAST(turn AS INTEGER) AS line_no,
  CASE turn % 4
    WHEN 0 THEN '[' || lpad(CAST(turn AS VARCHAR), 2, '0') || ':05.50 - ' || lpad(CAST(turn + 1 AS VARCHAR), 2, '0')
                || ':02.25]  ' || role || ' : ' || replace(text, chr(10), ' ')
    WHEN 1 THEN '[00:' || lpad(CAST(turn AS VARCHAR), 2, '0') || ':07] ' || role || ': ' || replace(text, chr(10), ' ')
    WHEN 2 THEN '[' || lpad(CAST(turn AS VARCHAR), 2, '0') || ':09] **' || role || '**: ' || replace(text, chr(10), ' ')
    ELSE role || ': ' || replace(text, chr(10), ' ') END AS raw
FROM conversations"""


def document_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Every line of every document, blank ones included; longer lines get the language as speaker."""
    d = read_texts(spark, sf, "documents")
    lines = d.select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    spoken = F.when(F.length("line") > 40, F.concat("lang", F.lit(": "), "line")).otherwise(F.col("line"))
    return lines.select(F.concat(F.lit("d"), "doc_id").alias("meeting_id"), "line_no", spoken.alias("raw"))


SQL["t_doc_lines"] = """
SELECT 'd' || doc_id AS meeting_id, CAST(pos - 1 AS INTEGER) AS line_no,
       CASE WHEN length(parts[pos]) > 40 THEN lang || ': ' || parts[pos] ELSE parts[pos] END AS raw FROM (
  SELECT doc_id, lang, parts, unnest(range(1, len(parts) + 1)) AS pos
  FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS parts FROM documents))"""


def words(spark: SparkSession, sf: str) -> DataFrame:
    """Word timeline: 0.4 s per word, a one second pause every 17 words, 1000 s per conversation turn."""
    c = read(spark, sf, "conversations")
    tokens = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    rows = c.select("conv_id", "turn", "role", F.posexplode(tokens).alias("pos", "word"))
    start = F.col("turn") * F.lit(1000.0) + F.lit(0.4) * F.col("pos") + F.floor(F.col("pos") / 17).cast("double")
    return rows.select(
        F.concat(F.lit("m"), "conv_id").alias("meeting_id"),
        (F.col("turn") * 1000000 + F.col("pos")).alias("word_idx"),
        "word",
        start.alias("start"),
        (start + F.lit(0.4)).alias("end"),
        F.col("role").alias("speaker"),
    )


SQL["t_words"] = r"""
SELECT 'm' || conv_id AS meeting_id, turn * 1000000 + pos AS word_idx, tokens[pos + 1] AS word,
       turn * 1000e0 + 0.4e0 * pos + CAST(pos // 17 AS DOUBLE) AS start,
       (turn * 1000e0 + 0.4e0 * pos + CAST(pos // 17 AS DOUBLE)) + 0.4e0 AS "end", role AS speaker
FROM (SELECT conv_id, turn, role, tokens, unnest(range(len(tokens))) AS pos
      FROM (SELECT conv_id, turn, role, list_filter(string_split_regex(text, '\s+'), lambda w: w <> '') AS tokens
            FROM conversations))"""


def diar_segments(spark: SparkSession, sf: str) -> DataFrame:
    """One speaker segment per turn, over the first half of its words."""
    c = read(spark, sf, "conversations")
    n = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    start = F.col("turn") * F.lit(1000.0) + F.lit(0.3)
    return c.select(
        F.concat(F.lit("m"), "conv_id").alias("meeting_id"),
        F.col("turn").cast("int").alias("idx"),
        start.alias("start"),
        (start + F.lit(0.2) * n).alias("end"),
        F.col("role").alias("speaker"),
    )


SQL["t_diar"] = r"""
SELECT 'm' || conv_id AS meeting_id, CAST(turn AS INTEGER) AS idx, turn * 1000e0 + 0.3e0 AS start,
       (turn * 1000e0 + 0.3e0) + 0.2e0 * len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) AS "end",
       role AS speaker
FROM conversations"""


# --- vectors ----------------------------------------------------------------------------------------------------


def subsegments(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "embeddings")
    idx = F.col("vec_id") % 50
    start = F.lit(0.6) * idx
    return e.select(
        F.concat(F.lit("v"), F.floor(F.col("vec_id") / 50).cast("string")).alias("meeting_id"),
        idx.cast("int").alias("sub_idx"),
        start.alias("start"),
        (start + F.lit(1.2)).alias("end"),
        F.floor(idx / 5).cast("int").alias("parent_idx"),
        "embedding",
        "label",
    )


SQL["t_sub"] = """
SELECT 'v' || (vec_id // 50) AS meeting_id, CAST(vec_id % 50 AS INTEGER) AS sub_idx,
       0.6e0 * (vec_id % 50) AS start, 0.6e0 * (vec_id % 50) + 1.2e0 AS "end",
       CAST((vec_id % 50) // 5 AS INTEGER) AS parent_idx, CAST(embedding AS DOUBLE[]) AS embedding, label
FROM embeddings"""


def speech_segments(spark: SparkSession, sf: str) -> DataFrame:
    """The parents of the sub-segments, and a short uncovered segment after each."""
    s = subsegments(spark, sf)
    parents = s.groupBy("meeting_id", F.col("parent_idx").alias("idx")).agg(
        F.min("start").alias("start"), F.max("end").alias("end")
    )
    short = parents.select(
        "meeting_id",
        (F.col("idx") + 100).alias("idx"),
        (F.col("end") + F.lit(0.05)).alias("start"),
        (F.col("end") + F.lit(0.25)).alias("end"),
    )
    return parents.unionByName(short)


SQL["t_speech"] = """
SELECT meeting_id, parent_idx AS idx, min(start) AS start, max("end") AS "end" FROM t_sub GROUP BY 1, 2
UNION ALL
SELECT meeting_id, idx + 100, e + 0.05e0, e + 0.25e0
FROM (SELECT meeting_id, parent_idx AS idx, max("end") AS e FROM t_sub GROUP BY 1, 2)"""


def topic_segments(spark: SparkSession, sf: str) -> DataFrame:
    """One segment per document, with the vector whose number is the document's modulo the number of vectors.

    Where no number is there twice, the vectors say so, and Spark leaves the join out where no vector is asked for."""
    e = read(spark, sf, "embeddings").select("vec_id", "embedding")
    n = e.agg(F.count("*").alias("rows"), F.count("vec_id").alias("ids"), F.countDistinct("vec_id").alias("different")).first()
    vec_id = F.col("doc_id") % F.lit(n["rows"])
    if n["ids"] == n["different"]:
        e = e.dropDuplicates(["vec_id"])
    d = read(spark, sf, "documents").select("doc_id", "lang", "text", vec_id.alias("vec_id"))
    idx = F.col("doc_id") % 50
    return d.join(e, "vec_id", "left").select(
        F.concat(F.lit("v"), F.floor(F.col("doc_id") / 50).cast("string")).alias("meeting_id"),
        idx.cast("int").alias("seg_idx"),
        (idx * 10).cast("double").alias("start"),
        (idx * 10 + 10).cast("double").alias("end"),
        F.col("lang").alias("speaker"),
        F.coalesce("text", F.lit("")).alias("text"),
        "embedding",
    )


SQL["t_topic"] = """
SELECT 'v' || (doc_id // 50) AS meeting_id, CAST(doc_id % 50 AS INTEGER) AS seg_idx,
       CAST((doc_id % 50) * 10 AS DOUBLE) AS start, CAST((doc_id % 50) * 10 + 10 AS DOUBLE) AS "end",
       lang AS speaker, coalesce(text, '') AS text, CAST(embedding AS DOUBLE[]) AS embedding
FROM documents LEFT JOIN embeddings ON vec_id = doc_id % (SELECT count(*) FROM embeddings)"""


# --- catalogue and calendar -------------------------------------------------------------------------------------


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders")
    linked = F.col("o_orderstatus") == "F"
    return o.select(
        F.concat(F.lit("j"), "o_orderkey").alias("id"),
        F.when(linked, "done").when(F.col("o_orderstatus") == "O", "running").otherwise("queued").alias("status"),
        F.when(linked, "Terminé")
        .when(F.col("o_orderpriority") == "2-HIGH", "Étape : diarisation en cours")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "TRANSCRIPTION 40 %")
        .when(F.col("o_orderpriority") == "5-LOW", "compte rendu")
        .otherwise("En attente")
        .alias("step"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.concat(F.lit("2024-05-19_14h00m00s_"), "o_custkey"))
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "")
        .otherwise(F.concat(F.lit("Réunion "), "o_custkey"))
        .alias("label"),
        F.when(F.col("o_totalprice") < 250000, "audio").otherwise("transcript").alias("source"),
        (dates.epoch_ms(F.col("o_orderdate")) + F.col("o_orderkey") * 1000).alias("created_ms"),
        F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_orderpriority")).alias("folder"),
        F.when(linked, F.concat(F.lit("e"), "o_custkey")).alias("event_id"),
        F.when(linked, F.concat(F.lit("Point "), "o_custkey")).alias("cal_subject"),
        F.when(linked, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'.0000000'")).alias("cal_start"),
        F.col("o_orderdate").alias("created"),
    )


SQL["t_jobs"] = """
SELECT 'j' || o_orderkey AS id,
  CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'running' ELSE 'queued' END AS status,
  CASE WHEN o_orderstatus = 'F' THEN 'Terminé' WHEN o_orderpriority = '2-HIGH' THEN 'Étape : diarisation en cours'
       WHEN o_orderpriority = '3-MEDIUM' THEN 'TRANSCRIPTION 40 %' WHEN o_orderpriority = '5-LOW' THEN 'compte rendu'
       ELSE 'En attente' END AS step,
  CASE o_orderpriority WHEN '5-LOW' THEN '2024-05-19_14h00m00s_' || o_custkey WHEN '4-NOT SPECIFIED' THEN ''
       ELSE 'Réunion ' || o_custkey END AS label,
  CASE WHEN o_totalprice < 250000 THEN 'audio' ELSE 'transcript' END AS source,
  epoch_ms(o_orderdate) + o_orderkey * 1000 AS created_ms,
  CASE WHEN o_orderpriority <> '1-URGENT' THEN o_orderpriority END AS folder,
  CASE WHEN o_orderstatus = 'F' THEN 'e' || o_custkey END AS event_id,
  CASE WHEN o_orderstatus = 'F' THEN 'Point ' || o_custkey END AS cal_subject,
  CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '.0000000' END AS cal_start,
  o_orderdate AS created
FROM orders"""


def calendar_events(spark: SparkSession, sf: str) -> DataFrame:
    """One event per customer, starting that many minutes into 2024; three attendees, one of them a room for some."""
    c = read(spark, sf, "customer")
    base = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    start = base + F.make_dt_interval(mins=F.col("c_custkey").cast("int"))
    iso = "yyyy-MM-dd'T'HH:mm:ss'.0000000'"
    seg = F.lower("c_mktsegment")

    def person(name, address, kind):
        return F.struct(name.alias("name"), address.alias("address"), kind.alias("type"))

    attendees = F.array(
        person(
            F.when(F.col("c_acctbal") > 1000, F.concat(F.lit("Ana "), "c_nationkey")),
            F.concat(F.lit("ana@"), seg, F.lit(".example.com")),
            F.lit("required"),
        ),
        person(
            F.concat(F.lit("Salle "), "c_nationkey"),
            F.concat(F.lit("salle@rooms.example.org")),
            F.when(F.col("c_acctbal") > 5000, F.lit("Resource")).otherwise(F.lit("optional")),
        ),
        person(F.lit(""), F.when(F.col("c_nationkey") > 12, F.lit("bob@gmail.com")), F.lit(None).cast("string")),
    )
    return c.select(
        F.concat(F.lit("e"), "c_custkey").alias("id"),
        F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise(F.col("c_name")).alias("subject"),
        F.date_format(start, iso).alias("start"),
        F.date_format(start + F.make_dt_interval(mins=F.lit(30)), iso).alias("end"),
        F.col("c_name").alias("organizer_name"),
        F.concat(F.lit("chef@"), seg, F.lit(".example.com")).alias("organizer_address"),
        F.when(F.col("c_nationkey") < 15, F.concat(F.lit("Salle "), "c_nationkey")).alias("location"),
        attendees.alias("attendees"),
        (F.col("c_acctbal") > 2000).alias("is_online"),
        F.when(F.col("c_acctbal") > 4000, F.concat(F.lit("  Ordre du jour "), "c_custkey", F.lit(" \n")))
        .otherwise("")
        .alias("preview"),
    )


SQL["t_cal"] = r"""
SELECT 'e' || c_custkey AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE c_name END AS subject,
  strftime(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(c_custkey AS INTEGER)), '%Y-%m-%dT%H:%M:%S') || '.0000000' AS start,
  strftime(TIMESTAMP '2024-01-01 00:30:00' + to_minutes(CAST(c_custkey AS INTEGER)), '%Y-%m-%dT%H:%M:%S') || '.0000000' AS "end",
  c_name AS organizer_name, 'chef@' || lower(c_mktsegment) || '.example.com' AS organizer_address,
  CASE WHEN c_nationkey < 15 THEN 'Salle ' || c_nationkey END AS location,
  [{'name': CASE WHEN c_acctbal > 1000 THEN 'Ana ' || c_nationkey END,
    'address': 'ana@' || lower(c_mktsegment) || '.example.com', 'type': 'required'},
   {'name': 'Salle ' || c_nationkey, 'address': 'salle@rooms.example.org',
    'type': CASE WHEN c_acctbal > 5000 THEN 'Resource' ELSE 'optional' END},
   {'name': '', 'address': CASE WHEN c_nationkey > 12 THEN 'bob@gmail.com' END, 'type': CAST(NULL AS VARCHAR)}] AS attendees,
  c_acctbal > 2000 AS is_online,
  CASE WHEN c_acctbal > 4000 THEN '  Ordre du jour ' || c_custkey || ' ' || chr(10) ELSE '' END AS preview
FROM customer"""


# --- telemetry --------------------------------------------------------------------------------------------------

PRICES = (("OA", 0.5, 0.05, 1.5), ("OR", 0.15, 0.015, 0.6), ("ON", 1.5, 0.15, 7.5), ("FA", 0.5, 0.05, 1.5))


def calls(spark: SparkSession, sf: str) -> DataFrame:
    li = read(spark, sf, "lineitem")
    return li.select(
        F.concat(F.lit("r"), "l_orderkey").alias("run_id"),
        F.col("l_linenumber").alias("seq"),
        F.col("l_returnflag").alias("step"),
        F.concat("l_linestatus", "l_returnflag").alias("model"),
        F.round(F.col("l_quantity") * 100).cast("long").alias("in_tok"),
        F.round(F.col("l_quantity") * 7).cast("long").alias("out_tok"),
        F.round(F.col("l_discount") * 20000).cast("long").alias("cached_in"),
        F.round(F.col("l_tax") * 100, 2).alias("latency_s"),
        (F.col("l_discount") >= 0.05).alias("batch"),
    )


SQL["t_calls"] = """
SELECT 'r' || l_orderkey AS run_id, l_linenumber AS seq, l_returnflag AS step, l_linestatus || l_returnflag AS model,
  CAST(round(l_quantity * 100) AS BIGINT) AS in_tok, CAST(round(l_quantity * 7) AS BIGINT) AS out_tok,
  CAST(round(l_discount * 20000) AS BIGINT) AS cached_in, round(l_tax * 100, 2) AS latency_s, l_discount >= 0.05 AS batch
FROM lineitem"""


def prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRICES, "model string, input double, cached_input double, output double")


SQL["t_prices"] = "SELECT * FROM (VALUES {}) p(model, input, cached_input, output)".format(
    ", ".join(f"('{m}', {a}e0, {b}e0, {c}e0)" for m, a, b, c in PRICES)
)


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """Event stream as a sampled series per user: seconds into 2024, a value, and a label."""
    ev = read(spark, sf, "events")
    t = (dates.epoch_ms(F.col("ts")) - 1704067200000) / F.lit(1000.0)
    return ev.select(
        F.concat(F.lit("u"), "user_id").alias("series_id"),
        "event_id",
        t.alias("t"),
        F.col("value").alias("rss_mb"),
        F.col("event_type").alias("label"),
        "ts",
    )


SQL["t_samples"] = """
SELECT 'u' || user_id AS series_id, event_id, (epoch_us(ts) // 1000 - 1704067200000) / 1000e0 AS t, value AS rss_mb,
       event_type AS label, ts FROM events"""


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """Speech probability per 32 ms frame: the events of a user in time order."""
    s = samples(spark, sf)
    numbered = running_number(s, ["series_id"], ["t", "event_id"], F.floor(F.col("t") / 86400), "n")
    return numbered.select(
        F.col("series_id").alias("meeting_id"),
        (F.col("n") - 1).alias("frame_idx"),
        F.least(F.col("rss_mb") / 100, F.lit(1.0)).alias("prob"),
    )


SQL["t_frames"] = """
SELECT series_id AS meeting_id, row_number() OVER (PARTITION BY series_id ORDER BY t, event_id) - 1 AS frame_idx,
       least(rss_mb / 100, 1.0e0) AS prob FROM t_samples"""

STATUS_OF = (("click", "queued"), ("view", "running"), ("purchase", "done"), ("signup", "pending"), ("error", "error"))


def status_log(spark: SparkSession, sf: str) -> DataFrame:
    s = samples(spark, sf)
    mapped = F.lit(None).cast("string")
    for event, status in STATUS_OF:
        mapped = F.when(F.col("label") == event, status).otherwise(mapped)
    return s.select(F.col("series_id").alias("job_id"), "event_id", "t", mapped.alias("status"))


SQL["t_status"] = "SELECT series_id AS job_id, event_id, t, CASE label {} END AS status FROM t_samples".format(
    " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in STATUS_OF)
)


# --- sections ---------------------------------------------------------------------------------------------------


def sections(spark: SparkSession, sf: str) -> DataFrame:
    """One section per conversation turn; its lines become points, decisions and plan items."""
    c = read(spark, sf, "conversations")
    lines = F.split("text", "\n")
    points = F.slice(lines, F.lit(2), F.size(lines))
    decisions = F.filter(lines, lambda s: s.contains(","))
    kind = F.when(F.col("turn") % 2 == 0, "engagement").otherwise("suggestion")
    plan = F.transform(
        decisions,
        lambda s: F.struct(
            F.concat(F.lit("a|"), s).alias("action"),
            F.col("role").alias("responsable"),
            F.when(F.col("turn") > 2, "demain").alias("echeance"),
            kind.alias("type"),
        ),
    )
    return c.select(
        F.concat(F.lit("m"), "conv_id").alias("meeting_id"),
        F.col("turn").cast("int").alias("chunk_id"),
        F.when(F.col("role") == "system", "").otherwise(F.concat(F.lit("Sujet "), F.col("turn") + 1)).alias("titre"),
        F.when(F.col("turn") != 3, lines[0]).alias("contexte"),
        points.alias("points"),
        F.col("text").alias("resume"),
        decisions.alias("decisions"),
        plan.alias("plan"),
        (F.col("turn") * 10).cast("double").alias("start_time"),
        (F.col("turn") * 10 + 10).cast("double").alias("end_time"),
    )


SQL["t_sections"] = """
SELECT meeting_id, chunk_id, titre, contexte, points, resume, decisions,
  list_transform(decisions, lambda s: {'action': 'a|' || s, 'responsable': role,
    'echeance': CASE WHEN chunk_id > 2 THEN 'demain' END,
    'type': CASE WHEN chunk_id % 2 = 0 THEN 'engagement' ELSE 'suggestion' END}) AS plan, start_time, end_time
FROM (SELECT 'm' || conv_id AS meeting_id, CAST(turn AS INTEGER) AS chunk_id, role,
  CASE WHEN role = 'system' THEN '' ELSE 'Sujet ' || (turn + 1) END AS titre,
  CASE WHEN turn <> 3 THEN string_split(text, chr(10))[1] END AS contexte,
  string_split(text, chr(10))[2:] AS points, text AS resume,
  list_filter(string_split(text, chr(10)), lambda s: contains(s, ',')) AS decisions,
  CAST(turn * 10 AS DOUBLE) AS start_time, CAST(turn * 10 + 10 AS DOUBLE) AS end_time FROM conversations)"""


def replies(spark: SparkSession, sf: str) -> DataFrame:
    """Model replies of four shapes: fenced JSON, JSON inside prose, broken JSON, plain text."""
    c = read(spark, sf, "conversations")
    clean = F.regexp_replace("text", r"[^a-zA-Z ,.]", " ")
    body = F.concat(
        F.lit('{"titre": "'), "role", F.lit('", "contexte": "'), clean, F.lit('", "points": ["un", " deux "], "decisions": ["'),
        clean, F.lit('", ""], "plan": [{"action": " faire ", "responsable": "SPEAKER_0'), F.col("turn"),
        F.lit('", "echeance": "", "type": "Engagement"}, {"action": "voir", "responsable": "x", "echeance": "y", "type": "z"}, '),
        F.lit('{"action": "", "responsable": "x", "echeance": "y", "type": "engagement"}]}'),
    )
    kind = F.col("turn") % 4
    raw = (
        F.when(kind == 0, F.concat(F.lit("Voici :\n```json\n"), body, F.lit("\n```\nfin")))
        .when(kind == 1, F.concat(F.lit("Bien sûr. "), body, F.lit(" Voilà.")))
        .when(kind == 2, F.concat(F.lit("{ cassé "), body))
        .otherwise(F.concat(F.lit("  "), clean, F.lit(" ")))
    )
    return c.select(
        F.concat(F.lit("m"), "conv_id").alias("meeting_id"), F.col("turn").cast("int").alias("chunk_id"), raw.alias("raw")
    )


SQL["t_replies"] = r"""
SELECT 'm' || conv_id AS meeting_id, CAST(turn AS INTEGER) AS chunk_id,
  CASE turn % 4 WHEN 0 THEN 'Voici :' || chr(10) || '```json' || chr(10) || body || chr(10) || '```' || chr(10) || 'fin'
    WHEN 1 THEN 'Bien sûr. ' || body || ' Voilà.' WHEN 2 THEN '{ cassé ' || body ELSE '  ' || clean || ' ' END AS raw
FROM (SELECT *, '{"titre": "' || role || '", "contexte": "' || clean || '", "points": ["un", " deux "], "decisions": ["'
    || clean || '", ""], "plan": [{"action": " faire ", "responsable": "SPEAKER_0' || turn
    || '", "echeance": "", "type": "Engagement"}, {"action": "voir", "responsable": "x", "echeance": "y", "type": "z"}, '
    || '{"action": "", "responsable": "x", "echeance": "y", "type": "engagement"}]}' AS body
  FROM (SELECT *, regexp_replace(text, '[^a-zA-Z ,.]', ' ', 'g') AS clean FROM conversations))"""
