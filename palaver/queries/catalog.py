"""Catalogue, calendar, timeline and search queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from palaver.functions.dates import day_key
from palaver.operators import catalog
from palaver.queries import tables
from palaver.queries.registry import query
from palaver.queries.scalars import SQL_DISPLAY
from palaver.session import cut_lineage, shared_dir
from palaver.sources.versioned import VersionedTable

SQL = tables.SQL
NOW = tables.NOW
PARSE = "strptime(substr({}, 1, 19), '%Y-%m-%dT%H:%M:%S')"
SQL["t_open"] = "SELECT * FROM t_cal WHERE id NOT IN (SELECT event_id FROM t_jobs WHERE event_id IS NOT NULL)"


def jobs_table(spark, sf, **more):
    """The jobs as a versioned table in the shared folder."""
    rows = jobs(spark, sf).withColumns(more) if more else jobs(spark, sf)
    return VersionedTable.create(rows, f"{shared_dir(spark)}/jobs-{uuid.uuid4().hex}", "id")


def written_back(table, outcome, column, source):
    """The outcome with the column as the table has it after the change; the batch is sent twice, as after a failure."""
    judged = cut_lineage(outcome)
    for _ in range(2):
        catalog.apply_columns(table, judged, column, 0, source)
    return judged.select("id", "error_code").join(table.read().select("id", column), "id", "left")


def jobs(spark, sf):
    return tables.jobs(spark, sf)


def events(spark, sf):
    return tables.calendar_events(spark, sf)


@query("timeline_upcoming_anti", "SELECT id, start FROM t_open")
def timeline_upcoming_anti(spark, sf):
    return catalog.not_recorded(events(spark, sf), jobs(spark, sf)).select("id", "start")


SQL["t_timeline"] = f"""
SELECT 'ev:' || id AS key, CASE WHEN subject = '' THEN '(sans objet)' ELSE subject END AS title, {PARSE.format('start')} AS d, 'upcoming' AS kind, 'upcoming' AS status FROM t_open
UNION ALL
SELECT 'job:' || id, {SQL_DISPLAY.format(fallback="'Réunion ' || substr(id, 1, 8)").replace('{{', '{').replace('}}', '}')},
  coalesce({PARSE.format('cal_start')}, make_timestamp(created_ms * 1000)), 'recorded', status FROM t_jobs"""


@query(
    "build_timeline",
    "SELECT key, title, strftime(d, '%Y-%m-%d %H:%M:%S') AS date, kind, status, CASE WHEN kind = 'upcoming' THEN epoch_ms(d) ELSE -epoch_ms(d) END AS sort_ms FROM t_timeline",
)
def build_timeline(spark, sf):
    out = catalog.timeline(events(spark, sf), jobs(spark, sf), NOW)
    return out.withColumn("date", F.date_format("date", "yyyy-MM-dd HH:mm:ss"))


@query(
    "today_next_split",
    f"SELECT key, title, CAST(d AS DATE) = CAST(TIMESTAMP '{NOW}' AS DATE) AS today FROM t_timeline WHERE kind = 'upcoming'",
)
def today_next_split(spark, sf):
    return catalog.today_next(events(spark, sf), jobs(spark, sf), NOW).select("key", "title", "today")


@query(
    "next_meeting",
    f"""SELECT id FROM t_open WHERE {PARSE.format('start')} > TIMESTAMP '{NOW}' - INTERVAL 1 MINUTE AND {PARSE.format('start')} < TIMESTAMP '{NOW}' + INTERVAL 60 MINUTE
        ORDER BY start, id LIMIT 1""",
)
def next_meeting(spark, sf):
    return catalog.next_meeting(events(spark, sf), jobs(spark, sf), NOW).select("id")


@query(
    "imminent_meeting",
    f"""SELECT id, {PARSE.format('start')} < TIMESTAMP '{NOW}' + INTERVAL 15 MINUTE AS shortcut FROM t_cal WHERE {PARSE.format('start')} >= TIMESTAMP '{NOW}' - INTERVAL 1 MINUTE
        AND {PARSE.format('start')} <= TIMESTAMP '{NOW}' + INTERVAL 30 MINUTE ORDER BY start, id LIMIT 1""",
)
def imminent_meeting(spark, sf):
    return catalog.imminent_meeting(events(spark, sf), NOW).select("id", "shortcut")


@query(
    "st_notify_due",
    f"""SELECT id, greatest(d, 0) AS delay_ms FROM (SELECT id, epoch_ms({PARSE.format('start')}) - 300000 - epoch_ms(TIMESTAMP '{NOW}') AS d, location FROM t_open)
        WHERE d BETWEEN -60000 AND 3600000 AND id NOT IN (SELECT id FROM t_cal WHERE location = 'Salle 3')""",
)
def st_notify_due(spark, sf):
    ev = events(spark, sf)
    sent = ev.filter("location = 'Salle 3'").select("id")
    return catalog.notify_due(ev, jobs(spark, sf), sent, NOW).select("id", "delay_ms")


@query("pending_event_lookup", "SELECT id, subject FROM t_cal WHERE id = 'e17'")
def pending_event_lookup(spark, sf):
    return events(spark, sf).filter("id = 'e17'").select("id", "subject")


@query("get_by_id", "SELECT id, status, label FROM t_jobs WHERE id = 'j77'")
def get_by_id(spark, sf):
    return jobs(spark, sf).filter("id = 'j77'").select("id", "status", "label")


@query("list_jobs", "SELECT id, status, label, created_ms FROM t_jobs ORDER BY created_ms DESC, id")
def list_jobs(spark, sf):
    return catalog.list_jobs(jobs(spark, sf)).select("id", "status", "label", "created_ms")


@query("recent_jobs", "SELECT id, created_ms FROM t_jobs ORDER BY created_ms DESC, id LIMIT 6")
def recent_jobs(spark, sf):
    return catalog.list_jobs(jobs(spark, sf), 6).select("id", "created_ms")


@query("recent_done", "SELECT id, created_ms FROM t_jobs WHERE status = 'done' ORDER BY created_ms DESC, id LIMIT 4")
def recent_done(spark, sf):
    return catalog.list_jobs(jobs(spark, sf), 4, "done").select("id", "created_ms")


DISPLAY_ID = SQL_DISPLAY.format(fallback="id").replace("{{", "{").replace("}}", "}")


@query(
    "search_jobs",
    f"SELECT id, created_ms FROM t_jobs WHERE contains(lower({DISPLAY_ID}), 'point 1') ORDER BY created_ms DESC, id LIMIT 30",
)
def search_jobs(spark, sf):
    return catalog.search_jobs(jobs(spark, sf), " Point 1").select("id", "created_ms")


@query(
    "filter_jobs",
    f"""SELECT id, folder FROM t_jobs WHERE contains(lower({DISPLAY_ID}), 'réunion') AND strftime(make_timestamp(created_ms * 1000), '%Y-%m') = '1997-05' AND folder IS NULL""",
)
def filter_jobs(spark, sf):
    month = day_key(F.col("created_ms")).startswith("1997-05")
    return catalog.filter_jobs(jobs(spark, sf), "RÉUNION", folder=None).filter(month).select("id", "folder")


@query(
    "folder_stats",
    "SELECT coalesce(folder, '::no-folder::') AS folder, count(*) AS n, max(created_ms) AS last_ms FROM t_jobs GROUP BY 1",
)
def folder_stats(spark, sf):
    return catalog.folder_stats(jobs(spark, sf))


@query(
    "folder_groups",
    f"""SELECT folder, count(*) FILTER (WHERE contains(lower(name), 'point')) AS matching, count(*) AS total FROM (
          SELECT coalesce(folder, '::no-folder::') AS folder, {DISPLAY_ID} AS name FROM t_jobs) GROUP BY 1 HAVING count(*) FILTER (WHERE contains(lower(name), 'point')) > 0""",
)
def folder_groups(spark, sf):
    j = jobs(spark, sf)
    folders = j.filter("folder IS NOT NULL").select("folder").distinct()
    return catalog.folder_groups(j, folders, "point")


@query(
    "available_attendees",
    """WITH s AS (SELECT DISTINCT meeting_id, speaker AS label, CASE WHEN speaker = 'user' THEN 'Ana' END AS name FROM t_segments),
       a AS (SELECT DISTINCT meeting_id, n AS name FROM t_segments, (VALUES ('Ana'), ('Bob'), ('Cléo')) v(n))
       SELECT s.meeting_id, s.label, a.name FROM s JOIN a ON a.meeting_id = s.meeting_id
       WHERE NOT EXISTS (SELECT 1 FROM s o WHERE o.meeting_id = s.meeting_id AND o.name = a.name AND o.label <> s.label)""",
)
def available_attendees(spark, sf):
    seg = tables.segments(spark, sf)
    speakers = seg.select(
        "meeting_id", F.col("speaker").alias("label"), F.when(F.col("speaker") == "user", "Ana").alias("name")
    ).distinct()
    people = seg.select("meeting_id", F.explode(F.array(F.lit("Ana"), F.lit("Bob"), F.lit("Cléo"))).alias("name")).distinct()
    return catalog.available_attendees(speakers, people)


SQL["t_files"] = """
SELECT id, unnest(CASE WHEN source = 'audio' THEN ['audio.wav', 'words.json', 'transcript.txt'] ELSE ['transcript.raw.txt', 'norm.txt'] END
   || CASE WHEN status = 'done' THEN ['compte_rendu.md', 'metrics.json'] ELSE [] END
   || CASE WHEN folder = '2-HIGH' THEN ['.origin.recording'] ELSE [] END) AS file FROM t_jobs"""


def files(spark, sf):
    arr = lambda *x: F.array(*[F.lit(v) for v in x])
    none = F.array().cast("array<string>")
    names = F.concat(
        F.when(F.col("source") == "audio", arr("audio.wav", "words.json", "transcript.txt")).otherwise(arr("transcript.raw.txt", "norm.txt")),
        F.when(F.col("status") == "done", arr("compte_rendu.md", "metrics.json")).otherwise(none),
        F.when(F.col("folder") == "2-HIGH", arr(".origin.recording")).otherwise(none),
    )
    return jobs(spark, sf).select("id", F.explode(names).alias("file"))


@query(
    "retention_candidates",
    """SELECT id, file FROM t_files WHERE file NOT IN ('compte_rendu.md', 'compte_rendu.docx', '.calendar_event.json', 'transcript.txt', 'turns.json', 'speakers.json', 'compte_rendu.sections.json')
       AND file <> 'audio.wav'""",
)
def retention_candidates(spark, sf):
    f = files(spark, sf)
    audio = f.filter(F.col("file").startswith("audio.")).select("id", F.col("file").alias("audio"))
    return catalog.retention_candidates(f, audio)


@query(
    "catalog_reconcile",
    """SELECT e.path, f.path IS NOT NULL AS found FROM (SELECT id || '/compte_rendu.md' AS path FROM t_jobs) e
       LEFT JOIN (SELECT DISTINCT id || '/' || file AS path FROM t_files) f ON f.path = e.path""",
)
def catalog_reconcile(spark, sf):
    expected = jobs(spark, sf).select(F.concat("id", F.lit("/compte_rendu.md")).alias("path"))
    have = files(spark, sf).select(F.concat("id", F.lit("/"), "file").alias("path"))
    return catalog.reconcile(expected, have)


@query(
    "derive_job_status",
    """SELECT id AS dir, CASE WHEN a THEN 'audio' ELSE 'transcript' END AS source, CASE WHEN a AND l THEN 'recording' ELSE 'upload' END AS origin,
         CASE WHEN r THEN 'done' ELSE 'queued' END AS status, CASE WHEN r AND a AND t THEN 'transcript.txt' END AS transcript FROM (
         SELECT id, bool_or(file = 'audio.wav') AS a, bool_or(file = 'transcript.raw.txt') AS raw, bool_or(file = '.origin.recording') AS l,
           bool_or(file = 'compte_rendu.md') AS r, bool_or(file = 'transcript.txt') AS t FROM t_files GROUP BY 1) WHERE a OR raw""",
)
def derive_job_status(spark, sf):
    return catalog.derive_job_status(files(spark, sf).select(F.col("id").alias("dir"), F.col("file").alias("name")))


@query("list_categories", "SELECT DISTINCT id AS dir FROM t_jobs WHERE folder = '3-MEDIUM' UNION SELECT DISTINCT folder FROM t_jobs WHERE folder IS NOT NULL")
def list_categories(spark, sf):
    """Folders of the jobs, with the files of some jobs left out so that their directories count as empty."""
    j = jobs(spark, sf)
    f = files(spark, sf).join(j.filter("folder = '3-MEDIUM'").select("id"), "id", "left_anti")
    listing = f.select(F.col("id").alias("dir"), F.col("file").alias("name"))
    dirs = j.select(F.col("id").alias("dir")).unionByName(j.filter("folder IS NOT NULL").select(F.col("folder").alias("dir"))).distinct()
    return catalog.list_categories(listing, dirs)


@query(
    "status_transition",
    """SELECT job_id, min(t) AS t, arg_min(event_id, t) AS event_id FROM (SELECT *, lag(status) OVER (PARTITION BY job_id ORDER BY t, event_id) AS before FROM t_status)
       WHERE status = 'done' AND before IN ('running', 'queued', 'pending') GROUP BY 1""",
)
def status_transition(spark, sf):
    return catalog.status_transitions(tables.status_log(spark, sf))


SANE = r"""trim(regexp_replace(trim({}), '[<>:"/\\|?*\x00-\x1f]', '', 'g'), '. ')"""


@query(
    "cat_rename",
    f"""WITH q AS (SELECT 'j' || (o_orderkey + CASE WHEN o_orderpriority = '5-LOW' THEN 100000000 ELSE 0 END) AS id,
          CASE o_orderpriority WHEN '1-URGENT' THEN 'Réunion ' || o_custkey WHEN '2-HIGH' THEN ' ?. ' ELSE 'Revue: ' || o_custkey END AS nl FROM orders),
        c AS (SELECT q.id, {SANE.format('nl')} AS w FROM q),
        e AS (SELECT c.id, w, j.label, CASE WHEN j.status IS NULL THEN 'not_found' WHEN j.status IN ('queued', 'running') THEN 'busy' WHEN w = '' THEN 'invalid'
           WHEN w = j.label THEN NULL WHEN w IN (SELECT label FROM t_jobs) THEN 'exists' END AS error_code FROM c LEFT JOIN t_jobs j ON j.id = c.id),
        f AS (SELECT w, min(id) AS first_id FROM e WHERE error_code IS NULL AND w IS DISTINCT FROM label GROUP BY 1),
        r AS (SELECT e.id, w, label, CASE WHEN error_code IS NULL AND w IS DISTINCT FROM label AND id > first_id THEN 'exists' ELSE error_code END AS error_code FROM e LEFT JOIN f USING (w))
        SELECT id, error_code, CASE WHEN error_code IS NULL THEN w ELSE label END AS label FROM r""",
)
def cat_rename(spark, sf):
    o = tables.read(spark, sf, "orders")
    wanted = (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit("Réunion "), "o_custkey"))
        .when(F.col("o_orderpriority") == "2-HIGH", " ?. ").otherwise(F.concat(F.lit("Revue: "), "o_custkey"))
    )
    shift = F.when(F.col("o_orderpriority") == "5-LOW", 100000000).otherwise(0)
    q = o.select(F.concat(F.lit("j"), F.col("o_orderkey") + shift).alias("id"), wanted.alias("new_label"))
    return written_back(jobs_table(spark, sf), catalog.rename(jobs(spark, sf), q), "label", "rename")


@query(
    "cat_move",
    f"""WITH q AS (SELECT 'j' || o_orderkey AS id, CASE WHEN o_totalprice > 300000 THEN NULL WHEN o_totalprice > 200000 THEN '2-HIGH' ELSE 'Neuf ' || o_custkey END AS nf FROM orders),
        c AS (SELECT id, nullif({SANE.format("coalesce(nf, '')")}, '') AS w FROM q),
        e AS (SELECT c.id, w, j.folder, j.label, CASE WHEN j.status IN ('queued', 'running') THEN 'busy' WHEN j.folder IS NOT DISTINCT FROM w THEN NULL
           WHEN EXISTS (SELECT 1 FROM t_jobs o WHERE coalesce(o.folder, '') = coalesce(w, '') AND o.label = j.label) THEN 'exists' END AS error_code
           FROM c LEFT JOIN t_jobs j ON j.id = c.id),
        f AS (SELECT coalesce(w, '') AS place, label, min(id) AS first_id FROM e WHERE error_code IS NULL AND folder IS DISTINCT FROM w GROUP BY 1, 2),
        r AS (SELECT e.id, w, folder, CASE WHEN error_code IS NULL AND folder IS DISTINCT FROM w AND id > first_id THEN 'exists' ELSE error_code END AS error_code
           FROM e LEFT JOIN f ON place = coalesce(w, '') AND f.label = e.label)
        SELECT id, error_code, CASE WHEN error_code IS NULL THEN w ELSE folder END AS folder FROM r""",
)
def cat_move(spark, sf):
    o = tables.read(spark, sf, "orders")
    wanted = F.when(F.col("o_totalprice") > 300000, F.lit(None).cast("string")).when(F.col("o_totalprice") > 200000, "2-HIGH").otherwise(
        F.concat(F.lit("Neuf "), "o_custkey")
    )
    asked = o.select(F.concat(F.lit("j"), "o_orderkey").alias("id"), wanted.alias("new_folder"))
    return written_back(jobs_table(spark, sf), catalog.move(jobs(spark, sf), asked), "folder", "move")


@query(
    "cat_folder_create_delete",
    f"""SELECT name, folder, CASE WHEN folder = '' THEN 'invalid' WHEN folder IN (SELECT folder FROM t_jobs WHERE folder IS NOT NULL) THEN 'exists'
          WHEN row_number() OVER (PARTITION BY folder ORDER BY no) > 1 THEN 'exists' END AS error_code
        FROM (SELECT no, name, {SANE.format('name')} AS folder FROM (
          SELECT DISTINCT -1 AS no, o_orderpriority AS name FROM orders UNION ALL SELECT p_partkey, p_name || '?' FROM part UNION ALL SELECT -2, '??'))
        UNION ALL SELECT f, f, 'deletable' FROM (SELECT DISTINCT p_name AS f FROM part)""",
)
def cat_folder_create_delete(spark, sf):
    part = tables.read(spark, sf, "part")
    o = tables.read(spark, sf, "orders").select(F.lit(-1).cast("long").alias("no"), F.col("o_orderpriority").alias("name")).distinct()
    more = part.select(F.col("p_partkey").cast("long").alias("no"), F.concat("p_name", F.lit("?")).alias("name"))
    asked = o.unionByName(more).unionByName(spark.createDataFrame([(-2, "??")], "no long, name string"))
    j = jobs(spark, sf)
    have = j.filter("folder IS NOT NULL").select("folder").distinct()
    made = catalog.folder_create(asked, have, order="no")
    free = catalog.deletable_folders(have.unionByName(part.select(F.col("p_name").alias("folder")).distinct()), j)
    return made.unionByName(free.select(F.col("folder").alias("name"), "folder", F.lit("deletable").alias("error_code")))


@query(
    "cat_delete",
    """SELECT q.id, CASE WHEN status IS NULL THEN 'not_found' WHEN status IN ('queued', 'running') THEN 'busy' END AS error_code,
         coalesce(status IN ('queued', 'running'), false) AS still_there FROM (SELECT 'j' || (o_orderkey * 2) AS id FROM orders) q LEFT JOIN t_jobs j ON j.id = q.id""",
)
def cat_delete(spark, sf):
    q = tables.read(spark, sf, "orders").select(F.concat(F.lit("j"), F.col("o_orderkey") * 2).alias("id"))
    table, judged = jobs_table(spark, sf), cut_lineage(catalog.delete(jobs(spark, sf), q))
    catalog.apply_delete(table, judged, 0)
    left = table.read().select("id", F.lit(True).alias("still_there"))
    return judged.join(left, "id", "left").withColumn("still_there", F.coalesce("still_there", F.lit(False)))


@query(
    "cat_report_update",
    """SELECT j.id, CASE WHEN n IS NOT NULL AND status <> 'done' THEN 'not_done' END AS error_code,
         CASE WHEN n IS NOT NULL AND status = 'done' THEN n ELSE 'old ' || j.id END AS report_md
       FROM t_jobs j LEFT JOIN (SELECT 'j' || o_orderkey AS id, 'new ' || o_custkey AS n FROM orders WHERE o_totalprice > 100000) e ON e.id = j.id""",
)
def cat_report_update(spark, sf):
    o = tables.read(spark, sf, "orders").filter("o_totalprice > 100000")
    edits = o.select(F.concat(F.lit("j"), "o_orderkey").alias("id"), F.concat(F.lit("new "), "o_custkey").alias("new_report"))
    j = jobs(spark, sf).withColumn("report_md", F.concat(F.lit("old "), "id"))
    table = jobs_table(spark, sf, report_md=F.concat(F.lit("old "), "id"))
    judged = cut_lineage(catalog.update_report(j, edits).select("id", "error_code", "report_md"))
    catalog.apply_columns(table, judged, "report_md", 0, "report")
    return judged.select("id", "error_code").join(table.read().select("id", "report_md"), "id", "left")


@query(
    "month_grid",
    """WITH c AS (SELECT unnest(range(0, 42)) AS cell), d AS (SELECT cell, cell - (isodow(DATE '1997-05-01') - 1) AS k FROM c),
       g AS (SELECT cell, CASE WHEN k BETWEEN 0 AND 30 THEN strftime(DATE '1997-05-01' + CAST(k AS INTEGER), '%Y-%m-%d') END AS day FROM d
             WHERE cell < CAST(ceil((isodow(DATE '1997-05-01') - 1 + 31) / 7.0) * 7 AS INTEGER))
       SELECT cell, g.day AS day, coalesce(n, 0) AS n FROM g LEFT JOIN (SELECT strftime(make_timestamp(created_ms * 1000), '%Y-%m-%d') AS day, count(*) AS n FROM t_jobs GROUP BY 1) j ON j.day = g.day""",
)
def month_grid(spark, sf):
    return catalog.month_grid(1997, 5, jobs(spark, sf))
