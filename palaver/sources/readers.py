"""Readers. The meeting is named by the file: its path below the root, without the file name."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palaver import schemas
from palaver.functions import text
from palaver.operators.catalog import NO_SUBJECT, derive_job_status
from palaver.plans.scans import scan


def meeting_of(path: Column) -> Column:
    """Name of the directory a file lies in."""
    return F.element_at(F.split(path, "/"), -2)


@contextmanager
def listing(spark: SparkSession) -> Iterator[None]:
    """Folders are listed when a reader is made, by default in a task each; here a task lists many."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), 4 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stable_id(path: Column) -> Column:
    return F.sha2(path, 256)


def transcript_lines(spark: SparkSession, root: str) -> DataFrame:
    """(meeting_id, line_no, raw) of every ``*.txt`` below the root, 0-based; blank lines are left out but counted."""
    kept = text_lines(spark, root, "*.txt").filter(~text.is_blank(F.col("raw")))
    return kept.withColumn("line_no", F.col("line_no") - 1)


def segments_json(spark: SparkSession, root: str) -> DataFrame:
    """Segments of ``{segments: [...]}`` documents, a missing start counting as 0."""
    with listing(spark):
        docs = (
            spark.read.schema(schemas.SEGMENT_DOC).option("multiLine", "true").option("recursiveFileLookup", "true")
            .option("pathGlobFilter", "*.json").json(root).select("*", F.col("_metadata.file_path").alias("path"))
        )
    rows = docs.select(meeting_of(F.col("path")).alias("meeting_id"), F.posexplode("segments").alias("pos", "s"))
    return rows.select("meeting_id", "pos", F.coalesce("s.start", F.lit(0.0)).alias("start"), "s.end", "s.speaker", "s.text")


def turns_json(spark: SparkSession, root: str) -> DataFrame:
    """Turns of ``turns.json`` arrays."""
    rows = (
        spark.read.schema(schemas.TURN).option("multiLine", "true").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "turns.json").json(root).select("*", F.col("_metadata.file_path").alias("path"))
    )
    return rows.select(meeting_of(F.col("path")).alias("meeting_id"), "start", "end", "speaker", "text")


def speakers_json(spark: SparkSession, root: str) -> DataFrame:
    """(meeting_id, label, name) of ``speakers.json`` maps."""
    rows = (
        spark.read.option("recursiveFileLookup", "true").option("wholetext", "true").option("pathGlobFilter", "speakers.json")
        .text(root).select("value", F.col("_metadata.file_path").alias("path"))
    )
    parsed = rows.select(meeting_of(F.col("path")).alias("meeting_id"), F.from_json("value", schemas.SPEAKER_DOC).alias("m"))
    return parsed.select("meeting_id", F.explode("m").alias("label", "name"))


def job_turns(meetings: DataFrame, turns: DataFrame, speakers: DataFrame) -> DataFrame:
    """Turns with display names; a meeting without turns keeps one row with ``has_turns`` false."""
    named = turns.join(speakers.withColumnRenamed("label", "speaker"), ["meeting_id", "speaker"], "left")
    out = meetings.select("meeting_id").join(named, "meeting_id", "left")
    return out.withColumn("has_turns", F.col("start").isNotNull())


def file_listing(spark: SparkSession, root: str) -> DataFrame:
    """(dir, name, length, modified) of every file; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(
        "path", "length", F.col("modificationTime").alias("modified")
    )
    return files.select(
        F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("dir"), F.element_at(F.split("path", "/"), -1).alias("name"), "length", "modified"
    )


def meeting_tree(spark: SparkSession, root: str) -> DataFrame:
    """Meeting directories at the root or one level down, with their status; the level between is the category."""
    files = file_listing(spark, root)
    base = root.rstrip("/").split("/")[-1]
    below = F.element_at(F.split("dir", f"/{base}/"), -1)
    jobs = derive_job_status(files).withColumn("_path", F.split(below, "/")).filter(F.size("_path") <= 2)
    return jobs.select(
        stable_id(F.col("dir")).alias("meeting_id"), F.element_at("_path", -1).alias("label"),
        F.when(F.size("_path") == 2, F.col("_path")[0]).alias("folder"), "source", "origin", "status", "transcript",
    )


def calendar_json(spark: SparkSession, root: str) -> DataFrame:
    """Calendar events with renamed fields and defaults; rooms are no attendees."""
    return _calendar(spark.read.schema(schemas.CALENDAR_DOC).option("multiLine", "true").option("recursiveFileLookup", "true").json(root))


def calendar_json_lines(spark: SparkSession, root: str) -> DataFrame:
    """The same from files with one document per line, which split."""
    return _calendar(spark.read.schema(schemas.CALENDAR_DOC).option("recursiveFileLookup", "true").json(root))


def _calendar(docs: DataFrame) -> DataFrame:
    e = docs.select(F.inline("value"))
    people = F.transform(
        "attendees",
        lambda a: F.struct(
            a["emailAddress"]["name"].alias("name"), a["emailAddress"]["address"].alias("address"), a["type"].alias("type")
        ),
    )
    empty = F.array().cast("array<struct<name:string,address:string>>")
    return e.select(
        "id",
        F.coalesce(F.nullif("subject", F.lit("")), F.lit(NO_SUBJECT)).alias("subject"),
        F.col("start.dateTime").alias("start"),
        F.col("end.dateTime").alias("end"),
        F.col("start.timeZone").alias("time_zone"),
        F.col("organizer.emailAddress").alias("organizer"),
        F.nullif("location.displayName", F.lit("")).alias("location"),
        F.coalesce(text.attendees_without_rooms(people), empty).alias("attendees"),
        F.coalesce("isOnlineMeeting", F.lit(False)).alias("is_online"),
        F.col("onlineMeetingProvider").alias("provider"),
        text.html_to_text(F.col("body.content"), F.col("body.contentType"), F.col("bodyPreview")).alias("preview"),
    )


def resource_csv(spark: SparkSession, root: str) -> DataFrame:
    rows = spark.read.schema(schemas.RESOURCES).option("header", "true").option("recursiveFileLookup", "true").csv(root)
    ids = F.filter(F.split(F.coalesce("llama_pids", F.lit("")), ","), lambda p: p != "")
    return rows.withColumn("llama_pids", F.transform(ids, lambda p: p.cast("long")))


def run_breakdown(spark: SparkSession, root: str) -> DataFrame:
    """One row per run and step."""
    reader = spark.read.schema(schemas.BREAKDOWN).option("multiLine", "true").option("recursiveFileLookup", "true")
    return _breakdown(reader.json(root))


def run_breakdown_lines(spark: SparkSession, root: str) -> DataFrame:
    """The same from files with one document per line."""
    return _breakdown(spark.read.schema(schemas.BREAKDOWN).option("recursiveFileLookup", "true").json(root))


def _breakdown(read: DataFrame) -> DataFrame:
    docs = read.select("*", F.col("_metadata.file_path").alias("path"))
    rows = docs.select(meeting_of(F.col("path")).alias("run_id"), "architecture", F.explode("steps").alias("step", "s"), F.col("total.cost_usd").alias("run_cost_usd"))
    return rows.select("run_id", "architecture", "step", "s.*", "run_cost_usd")


def variant_metrics(spark: SparkSession, root: str) -> DataFrame:
    """One row per benchmark and variant of ``{variant: {...}}`` documents."""
    with listing(spark):
        docs = spark.read.option("recursiveFileLookup", "true").option("wholetext", "true").text(root).select(
            "value", F.col("_metadata.file_path").alias("path")
        )
    parsed = docs.select(meeting_of(F.col("path")).alias("bench"), F.from_json("value", f"map<string, {schemas.VARIANT}>").alias("m"))
    return parsed.select("bench", F.explode("m").alias("variant", "v")).select("bench", "variant", "v.*")


def rttm(spark: SparkSession, root: str) -> DataFrame:
    """Speaker rows of RTTM files."""
    lines = spark.read.option("recursiveFileLookup", "true").text(root)
    f = F.split(F.trim("value"), r"\s+")
    rows = lines.filter(F.col("value").startswith("SPEAKER")).select(f.alias("f"))
    start, dur = F.col("f")[3].cast("double"), F.col("f")[4].cast("double")
    return rows.select(F.col("f")[1].alias("meeting_id"), start.alias("start"), (start + dur).alias("end"), F.col("f")[7].alias("speaker"))


def report_md(spark: SparkSession, root: str) -> DataFrame:
    """(meeting_id, line_no, raw) of every report."""
    return text_lines(spark, root, "*.md")


def text_lines(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """(meeting_id, line_no, raw) of text files, 1-based, blank lines included.

    Files are read line by line and large ones in several splits. Rows of a split come in file order, so a line's number
    is its place in the split plus the lines of the splits before it. The files of a meeting count on in name order.
    """
    with listing(spark):
        read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(root)
    lines = (
        read.select(
            "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"),
            F.monotonically_increasing_id().alias("id"),
        )
        .withColumn("meeting_id", meeting_of(F.col("path")))
    )
    place = lines.select("meeting_id", "path", "at").distinct()
    order = Window.partitionBy("meeting_id").orderBy("path", "at")
    slots = place.withColumn("slot", F.row_number().over(order))
    numbered = scan(
        lines.join(slots, ["meeting_id", "path", "at"]), ["meeting_id"], ["slot", "id"], F.col("slot").cast("long"),
        {"line_no": ("sum", F.lit(1).cast("long"))},
    )
    return numbered.select("meeting_id", "line_no", F.col("value").alias("raw"))
