"""Meeting catalogue, calendar and timeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.functions import dates, text
from palaver.plans.scans import running_number
from palaver.sources.versioned import VersionedTable

# --- fixed values -----------------------------------------------------------------------------------------------
FOLDER_FORMAT = "yyyy-MM-dd_HH'h'mm'm'ss's'"
STEPS_AUDIO = ("Conversion", "Diarisation", "Transcription", "Compte rendu")
STEPS_TRANSCRIPT = ("Normalisation", "Compte rendu")
NO_FOLDER = "::no-folder::"
NO_SUBJECT = "(sans objet)"
KEPT_FILES = (
    "compte_rendu.md", "compte_rendu.docx", ".calendar_event.json", "transcript.txt", "turns.json", "speakers.json",
    "compte_rendu.sections.json",
)
BUSY = ("queued", "running")
# ----------------------------------------------------------------------------------------------------------------


def _ntz(now: str) -> Column:
    return F.lit(now).cast("timestamp_ntz")


def _minutes(n: int) -> Column:
    return F.make_dt_interval(mins=F.lit(n))


def _days(n: int) -> Column:
    return F.make_dt_interval(days=F.lit(n))


def unique_folder_names(new: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Folder names of (id, created_ms, created, hint) rows; the i-th use of a name gets the i-th free number."""
    label = text.sanitize_label(F.col("hint"))
    base = F.concat_ws("_", F.date_format("created", FOLDER_FORMAT), F.nullif(label, F.lit("")))
    hour = F.floor(F.col("created_ms") / 3600000)
    ranked = running_number(new.withColumn("base", base), ["base"], ["created_ms", "id"], hour, "k")
    if existing is not None:
        bases = ranked.groupBy("base").agg(F.max("k").alias("n_new"))
        suffix = F.regexp_extract("folder", r"^(.*)_(\d+)$", 2).try_cast("long")
        taken = existing.select(F.col("folder").alias("base"), F.lit(1).cast("long").alias("no")).unionByName(
            existing.filter(suffix > 1).select(
                F.regexp_extract("folder", r"^(.*)_(\d+)$", 1).alias("base"), suffix.alias("no")
            )
        ).distinct()
        used = bases.join(taken, "base", "left").groupBy("base", "n_new").agg(F.count("no").alias("n_used"))
        numbers = used.select("base", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_new") + F.col("n_used"))).alias("no"))
        free = running_number(
            numbers.join(taken, ["base", "no"], "left_anti"), ["base"], ["no"], F.floor(F.col("no") / 4096), "k"
        )
        ranked = ranked.join(free, ["base", "k"]).drop("k").withColumnRenamed("no", "k")
    name = F.when(F.col("k") == 1, F.col("base")).otherwise(F.concat_ws("_", "base", F.col("k").cast("string")))
    return ranked.withColumn("folder", name).drop("base", "k")


def progress(jobs: DataFrame) -> DataFrame:
    """Index of the first known step named in the step text, and the percentage shown for it."""
    steps = F.when(F.col("source") == "transcript", F.array(*map(F.lit, STEPS_TRANSCRIPT))).otherwise(
        F.array(*map(F.lit, STEPS_AUDIO))
    )
    hits = F.transform(steps, lambda s: F.lower("step").contains(F.lower(s)))
    idx = F.array_position(hits, True) - 1
    pct = F.when(F.col("status") == "done", F.lit(100.0)).otherwise(
        F.greatest(F.lit(8.0), (idx + 1) * F.lit(100.0) / F.size(steps))
    )
    return jobs.withColumns({"idx": idx, "pct": pct})


def calendar_window(events: DataFrame, now: str, days: int, limit: int | None = 100) -> DataFrame:
    """The first ``limit`` events (all if None) that end after midnight today and start within the days ahead (1 to 31)."""
    days = max(1, min(int(days), 31))
    start, end = dates.parse_graph_date(F.col("start")), dates.parse_graph_date(F.col("end"))
    inside = (end > F.date_trunc("DAY", _ntz(now)).cast("timestamp_ntz")) & (start < _ntz(now) + _days(days))
    found = events.filter(inside).orderBy("start", "id")
    return found if limit is None else found.limit(limit)


def public_view(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """Job rows with availability flags from a (id, file) table."""
    flags = files.groupBy("id").agg(
        F.bool_or(F.col("file").startswith("audio.")).alias("_audio"),
        F.bool_or(F.col("file") == "transcript.txt").alias("_transcript"),
        F.bool_or(F.col("file") == "compte_rendu.docx").alias("_docx"),
    )
    no = F.lit(False)
    return jobs.join(flags, "id", "left").withColumns(
        {
            "audio_available": (F.col("source") == "audio") & F.coalesce("_audio", no),
            "transcript_available": F.coalesce("_transcript", no),
            "report_docx_available": F.coalesce("_docx", no),
        }
    ).drop("_audio", "_transcript", "_docx")


def recorded_events(jobs: DataFrame) -> DataFrame:
    return jobs.filter("event_id IS NOT NULL AND event_id <> ''").select(F.col("event_id").alias("id")).distinct()


def not_recorded(events: DataFrame, jobs: DataFrame) -> DataFrame:
    """Events no job was recorded for."""
    return events.join(recorded_events(jobs), "id", "left_anti")


def timeline(events: DataFrame, jobs: DataFrame, now: str) -> DataFrame:
    """Upcoming and recorded meetings in one table; ``sort_ms`` orders each kind (ascending, descending)."""
    upcoming = not_recorded(events, jobs).select(
        F.concat(F.lit("ev:"), "id").alias("key"),
        F.coalesce(F.nullif("subject", F.lit("")), F.lit(NO_SUBJECT)).alias("title"),
        F.coalesce(dates.parse_graph_date(F.col("start")), _ntz(now)).alias("date"),
        F.lit("upcoming").alias("kind"),
        F.lit("upcoming").alias("status"),
    )
    made = F.when(
        F.col("created_ms") > 0,
        F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        + F.make_dt_interval(secs=(F.col("created_ms") / 1000).cast("decimal(18,6)")),
    )
    recorded = jobs.select(
        F.concat(F.lit("job:"), "id").alias("key"),
        text.display_name(
            F.col("label"), F.col("cal_subject"), F.concat(F.lit("Réunion "), F.substring("id", 1, 8))
        ).alias("title"),
        F.coalesce(dates.parse_graph_date(F.col("cal_start")), made, _ntz(now)).alias("date"),
        F.lit("recorded").alias("kind"),
        "status",
    )
    both = upcoming.unionByName(recorded)
    ms = dates.epoch_ms(F.col("date"))
    return both.withColumn("sort_ms", F.when(F.col("kind") == "upcoming", ms).otherwise(-ms))


def today_next(events: DataFrame, jobs: DataFrame, now: str) -> DataFrame:
    """Upcoming meetings with a flag for today's."""
    up = timeline(events, jobs, now).filter("kind = 'upcoming'")
    return up.withColumn("today", F.to_date("date") == F.to_date(_ntz(now)))


def _starts_between(events: DataFrame, now: str, ahead: int, closed: bool) -> DataFrame:
    at = dates.parse_graph_date(F.col("start"))
    low, high = _ntz(now) - _minutes(1), _ntz(now) + _minutes(ahead)
    near = ((at >= low) & (at <= high)) if closed else ((at > low) & (at < high))
    return events.withColumn("at", at).filter(near)


def next_meeting(events: DataFrame, jobs: DataFrame, now: str) -> DataFrame:
    """The earliest unrecorded meeting between a minute ago and an hour ahead."""
    return not_recorded(_starts_between(events, now, 60, closed=False), jobs).orderBy("at", "id").limit(1)


def imminent_meeting(events: DataFrame, now: str) -> DataFrame:
    """The earliest meeting between a minute ago and half an hour ahead; ``shortcut`` under 15 minutes."""
    near = _starts_between(events, now, 30, closed=True).orderBy("at", "id").limit(1)
    return near.withColumn("shortcut", F.col("at") < _ntz(now) + _minutes(15))


def notify_due(events: DataFrame, jobs: DataFrame, notified: DataFrame, now: str) -> DataFrame:
    """Events to announce five minutes before the start, with the delay until then."""
    at = dates.parse_graph_date(F.col("start"))
    delay = dates.epoch_ms(at) - 5 * 60000 - dates.epoch_ms(_ntz(now))
    due = events.withColumn("delay_ms", delay).filter(F.col("delay_ms").between(-60000, 60 * 60000))
    fresh = not_recorded(due, jobs).join(notified.select("id"), "id", "left_anti")
    return fresh.withColumn("delay_ms", F.greatest(F.col("delay_ms"), F.lit(0)))


def list_jobs(jobs: DataFrame, limit: int | None = None, status: str | None = None) -> DataFrame:
    """Newest first, without the long text columns."""
    rows = jobs.filter(F.col("status") == status) if status else jobs
    slim = rows.drop("report_md", "transcript")
    ordered = slim.orderBy(F.coalesce("created_ms", F.lit(0)).desc(), "id")
    return ordered.limit(limit) if limit else ordered


def _named(jobs: DataFrame) -> Column:
    return F.lower(text.display_name(F.col("label"), F.col("cal_subject"), F.col("id")))


def search_jobs(jobs: DataFrame, term: str) -> DataFrame:
    """Blank term: the newest 8; else the newest 30 whose display name contains it."""
    term = term.strip().lower()
    if not term:
        return list_jobs(jobs, 8)
    return list_jobs(jobs.filter(_named(jobs).contains(term)), 30)


ANY = object()


def filter_jobs(jobs: DataFrame, term: str = "", day: str = "", folder: object = ANY) -> DataFrame:
    """Text, day and folder filters; ``folder=None`` means jobs without one."""
    out = jobs
    if term.strip():
        out = out.filter(_named(jobs).contains(term.strip().lower()))
    if day:
        out = out.filter(dates.day_key(F.col("created_ms")) == day)
    if folder is not ANY:
        out = out.filter(F.nullif("folder", F.lit("")).eqNullSafe(F.lit(folder)))
    return out


def folder_stats(jobs: DataFrame) -> DataFrame:
    """Jobs and latest activity per folder."""
    key = F.coalesce(F.nullif("folder", F.lit("")), F.lit(NO_FOLDER)).alias("folder")
    return jobs.groupBy(key).agg(F.count("*").alias("n"), F.coalesce(F.max("created_ms"), F.lit(0)).alias("last_ms"))


def folder_groups(jobs: DataFrame, folders: DataFrame, term: str = "", day: str = "") -> DataFrame:
    """Matching and total jobs per folder; folders without a match only show when nothing is filtered."""
    filtering = bool(term.strip() or day)
    match = F.lit(True)
    if term.strip():
        match = match & _named(jobs).contains(term.strip().lower())
    if day:
        match = match & (dates.day_key(F.col("created_ms")) == day)
    key = F.coalesce(F.nullif("folder", F.lit("")), F.lit(NO_FOLDER)).alias("folder")
    counts = jobs.groupBy(key).agg(F.count_if(match).alias("matching"), F.count("*").alias("total"))
    known = folders.select("folder").unionByName(counts.filter(F.col("folder") == NO_FOLDER).select("folder"))
    zero = F.lit(0)
    out = known.distinct().join(counts, "folder", "left").select(
        "folder", F.coalesce("matching", zero).alias("matching"), F.coalesce("total", zero).alias("total")
    )
    return out.filter("matching > 0") if filtering else out


def available_attendees(speakers: DataFrame, attendees: DataFrame) -> DataFrame:
    """Per speaker label, the attendees not already given to another label.

    A used name is only offered to its own label, so the used ones come from an equi join and the free ones pair with
    the labels of their meeting.
    """
    used = speakers.filter("name IS NOT NULL").select("meeting_id", "label", "name")
    own = used.join(attendees, ["meeting_id", "name"])
    free = attendees.join(used.select("meeting_id", "name").distinct(), ["meeting_id", "name"], "left_anti")
    offered = speakers.select("meeting_id", "label").join(free, "meeting_id")
    return offered.select("meeting_id", "label", "name").unionByName(own.select("meeting_id", "label", "name")).distinct()


def reconcile(expected: DataFrame, existing: DataFrame) -> DataFrame:
    """Expected artefacts with a found flag."""
    have = existing.select("path").distinct().withColumn("_have", F.lit(True))
    return expected.join(have, "path", "left").withColumn("found", F.col("_have").isNotNull()).drop("_have")


def retention_candidates(files: DataFrame, audio: DataFrame) -> DataFrame:
    """Files of a meeting that are neither on the keep list nor its audio; nothing is deleted."""
    other = files.filter(~F.col("file").isin(*KEPT_FILES))
    return other.join(audio.select("id", F.col("audio").alias("file")), ["id", "file"], "left_anti")


def status_transitions(log: DataFrame) -> DataFrame:
    """First change of a job from a pending state to done."""
    from palaver.plans.scans import scan

    seen = scan(log, ["job_id"], ["t", "event_id"], F.floor(F.col("t") / 86400), {"before": ("lag", F.col("status"))})
    hit = seen.filter((F.col("status") == "done") & F.col("before").isin("running", "queued", "pending"))
    return hit.groupBy("job_id").agg(F.min_by(F.struct("t", "event_id"), F.struct("t", "event_id")).alias("x")).select(
        "job_id", "x.t", "x.event_id"
    )


def derive_job_status(files: DataFrame) -> DataFrame:
    """Jobs of a (folder, name) listing: source, origin, status and transcript file."""
    name = F.col("name")
    stem = F.regexp_extract(name, r"^(.+?)(\.[^.]*)?$", 1)
    facts = files.groupBy("dir").agg(
        F.bool_or(stem == "audio").alias("audio"),
        F.bool_or(name == "transcript.raw.txt").alias("raw"),
        F.bool_or(name == ".origin.recording").alias("live"),
        F.bool_or(name.isin("compte_rendu.md", "compte_rendu.docx")).alias("report"),
        F.bool_or(name == "transcript.txt").alias("turns"),
        F.bool_or(name == "audio.transcript.midpoint.txt").alias("old"),
    )
    source = F.when(F.col("audio"), "audio").when(F.col("raw"), "transcript")
    return facts.withColumn("source", source).filter("source IS NOT NULL").select(
        "dir",
        "source",
        F.when(F.col("audio") & F.col("live"), "recording").otherwise("upload").alias("origin"),
        F.when(F.col("report"), "done").otherwise("queued").alias("status"),
        F.when(
            F.col("report") & F.col("audio"),
            F.when(F.col("turns"), "transcript.txt").when(F.col("old"), "audio.transcript.midpoint.txt"),
        ).alias("transcript"),
    )


def list_categories(files: DataFrame, directories: DataFrame) -> DataFrame:
    """Directories that are not meetings themselves, empty ones included."""
    name = F.col("name")
    meeting = files.filter(
        (F.regexp_extract(name, r"^(.+?)(\.[^.]*)?$", 1) == "audio") | (name == "transcript.raw.txt")
    ).select("dir").distinct()
    return directories.join(meeting, "dir", "left_anti").orderBy("dir")


# --- catalogue changes ------------------------------------------------------------------------------------------


def _first_only(judged: DataFrame, wants: Column, name: list[str], order: str) -> DataFrame:
    """``judged`` where of several requests for one name, so far without error, all but the first get ``exists``. The first
    is found by a sum per name, so a name that very many ask for is no large group."""
    judged = judged.withColumn("_wants", F.col("error_code").isNull() & F.coalesce(wants, F.lit(False)))
    first = judged.filter("_wants").groupBy(*name).agg(F.min(order).alias("_first"))
    late = F.col("_wants") & (F.col(order) > F.col("_first"))
    return judged.join(first, name, "left").withColumn("error_code", F.when(late, "exists").otherwise(F.col("error_code"))).drop("_wants", "_first")


def rename(jobs: DataFrame, requests: DataFrame, order: str = "id") -> DataFrame:
    """Outcome of (id, new_label) requests: the label after the change and an error code. Of requests for the same free
    label the first by ``order`` gets it."""
    clean = requests.withColumn("wanted", text.sanitize_label(F.col("new_label")))
    names = jobs.select(F.col("label").alias("wanted")).distinct().withColumn("_taken", F.lit(True))
    out = clean.join(jobs.select("id", "status", "label"), "id", "left").join(names, "wanted", "left")
    error = (
        F.when(F.col("status").isNull(), "not_found")
        .when(F.col("status").isin(*BUSY), "busy")
        .when(F.col("wanted") == "", "invalid")
        .when(F.col("wanted") == F.col("label"), F.lit(None))
        .when(F.col("_taken").isNotNull(), "exists")
    )
    out = _first_only(out.withColumn("error_code", error), ~F.col("wanted").eqNullSafe(F.col("label")), ["wanted"], order)
    kept = F.col("error_code").isNull()
    return out.select("id", "error_code", F.when(kept, F.col("wanted")).otherwise(F.col("label")).alias("label"))


def move(jobs: DataFrame, requests: DataFrame, order: str = "id") -> DataFrame:
    """Outcome of (id, new_folder) requests; NULL or blank moves to the root. Of requests that would put the same label into
    the same folder the first by ``order`` succeeds."""
    raw = text.strip(F.coalesce("new_folder", F.lit("")))
    clean = requests.withColumn("_raw", raw).withColumn(
        "wanted", F.when(F.col("_raw") != "", text.sanitize_label(F.col("_raw")))
    )
    root = F.lit("")
    places = jobs.select(F.coalesce("folder", root).alias("_place"), "label").distinct().withColumn("_taken", F.lit(True))
    out = clean.join(jobs.select("id", "status", "label", "folder"), "id", "left").withColumn(
        "_place", F.coalesce("wanted", root)
    )
    out = out.join(places, ["_place", "label"], "left")
    same = F.nullif("folder", root).eqNullSafe(F.col("wanted"))
    error = (
        F.when(F.col("status").isNull(), "not_found")
        .when(F.col("status").isin(*BUSY), "busy")
        .when((F.col("_raw") != "") & (F.col("wanted") == ""), "invalid")
        .when(same, F.lit(None))
        .when(F.col("_taken").isNotNull(), "exists")
    )
    out = _first_only(out.withColumn("error_code", error), ~same, ["_place", "label"], order)
    kept = F.col("error_code").isNull()
    return out.select("id", "error_code", F.when(kept, F.col("wanted")).otherwise(F.col("folder")).alias("folder"))


def folder_create(requests: DataFrame, directories: DataFrame, order: str = "name") -> DataFrame:
    """Outcome of (name) requests; of names that give the same new folder the first by ``order`` makes it."""
    clean = requests.withColumn("folder", text.sanitize_label(F.col("name")))
    known = directories.select("folder").distinct().withColumn("_have", F.lit(True))
    out = clean.join(known, "folder", "left")
    error = F.when(F.col("folder") == "", "invalid").when(F.col("_have").isNotNull(), "exists")
    out = _first_only(out.withColumn("error_code", error), F.lit(True), ["folder"], order)
    return out.select("name", "folder", "error_code")


def deletable_folders(folders: DataFrame, jobs: DataFrame) -> DataFrame:
    """Folders that hold no meeting."""
    return folders.join(jobs.filter("folder IS NOT NULL").select("folder").distinct(), "folder", "left_anti")


def delete(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    out = requests.join(jobs.select("id", "status"), "id", "left")
    error = F.when(F.col("status").isNull(), "not_found").when(F.col("status").isin(*BUSY), "busy")
    return out.select("id", error.alias("error_code"))


def update_report(jobs: DataFrame, edits: DataFrame) -> DataFrame:
    """Report text after the edits; only done jobs take them."""
    out = jobs.join(edits.select("id", "new_report"), "id", "left")
    ok = (F.col("status") == "done") & F.col("new_report").isNotNull()
    return out.withColumns(
        {
            "error_code": F.when(F.col("new_report").isNotNull() & (F.col("status") != "done"), "not_done"),
            "report_md": F.when(ok, F.col("new_report")).otherwise(F.col("report_md")),
        }
    ).drop("new_report")


def apply_columns(table: VersionedTable, outcome: DataFrame, column: str, batch: int, source: str) -> None:
    """Write ``column`` of the requests without an error back to the jobs table; a batch that was applied changes nothing."""
    done = outcome.filter("error_code IS NULL").select("id", F.col(column).alias("_new"), F.lit(True).alias("_set"))

    def change(rows: DataFrame) -> DataFrame:
        joined = rows.join(done, "id", "left")
        return joined.withColumn(column, F.when(F.col("_set"), F.col("_new")).otherwise(F.col(column))).select(*rows.columns)

    table.apply(done, change, batch, source)


def apply_delete(table: VersionedTable, outcome: DataFrame, batch: int, source: str = "delete") -> None:
    """Take the jobs of requests without an error out of the table."""
    done = outcome.filter("error_code IS NULL").select("id")
    table.apply(done, lambda rows: rows.join(done, "id", "left_anti"), batch, source)


def month_grid(year: int, month: int, jobs: DataFrame) -> DataFrame:
    """Monday-first month cells padded to full weeks, with the jobs of each day."""
    spark = jobs.sparkSession
    first = F.make_date(F.lit(year), F.lit(month), F.lit(1))
    lead = F.weekday(first)
    size = F.ceil((lead + F.dayofmonth(F.last_day(first))) / 7) * 7
    cells = spark.range(1).select(
        F.explode(F.sequence(F.lit(0), (size - 1).cast("int"))).alias("cell"), first.alias("first"), lead.alias("lead")
    )
    day = F.col("cell") - F.col("lead") + 1
    inside = (day >= 1) & (day <= F.dayofmonth(F.last_day("first")))
    grid = cells.select("cell", F.when(inside, F.date_add("first", (day - 1).cast("int")).cast("string")).alias("day"))
    counts = jobs.groupBy(dates.day_key(F.col("created_ms")).alias("day")).agg(F.count("*").alias("n"))
    return grid.join(counts, "day", "left").withColumn("n", F.coalesce("n", F.lit(0)))
