"""Sinks. Rows are spread by meeting and slice before writing, so one long meeting is written by many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.functions import text
from palaver.plans.scans import ROWS_PER_BUCKET

#: Files are moved to their place by the tasks, not one after the other by the driver: there is at least one per meeting.
MOVED_BY_TASKS = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}


def writing_tasks(df: DataFrame) -> int:
    """Tasks that write a file per meeting. Small meetings are few bytes but as many files, so they are not to be coalesced."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def write_lines(lines: DataFrame, path: str, order: str, line: str = "line", name: str = "part") -> None:
    """One directory per meeting with its lines in order; a long meeting becomes several files in name order."""
    sliced = lines.withColumn("_slice", F.floor(F.col(order) / ROWS_PER_BUCKET))
    sliced.repartitionByRange(writing_tasks(lines), "meeting_id", "_slice").sortWithinPartitions("meeting_id", order).select(
        "meeting_id", F.col(line).alias("value")
    ).write.options(**MOVED_BY_TASKS).mode("overwrite").partitionBy("meeting_id").text(path)


def write_transcript(turns: DataFrame, path: str, with_times: bool = True) -> None:
    line = text.transcript_line(F.col("start"), F.col("end"), F.col("speaker"), F.col("text"), with_times)
    write_lines(turns.select("meeting_id", "turn_idx", line.alias("line")), path, "turn_idx")


def write_rttm(segments: DataFrame, path: str) -> None:
    line = text.rttm_line(F.col("meeting_id"), F.col("start"), F.col("end"), F.col("speaker"))
    write_lines(segments.select("meeting_id", "start", line.alias("line")), path, "start")


def write_diar(segments: DataFrame, path: str) -> None:
    line = text.diar_line(F.col("start"), F.col("end"), F.col("speaker"))
    write_lines(segments.select("meeting_id", "start", line.alias("line")), path, "start")


def write_words_turns(midpoint: DataFrame, boundary: DataFrame, path: str) -> None:
    """Words (or turns) of both alignments as JSON, one directory each."""
    both = midpoint.withColumn("alignment", F.lit("midpoint")).unionByName(boundary.withColumn("alignment", F.lit("boundary")))
    both.write.mode("overwrite").partitionBy("alignment").json(path)


def chunk_key(chunks: DataFrame, prompt: str) -> DataFrame:
    """Content hash of a chunk and the prompt it is asked with."""
    return chunks.withColumn("chunk_key", F.sha2(F.concat("text", F.lit("‖"), F.lit(prompt)), 256))


def pending_chunks(chunks: DataFrame, cache: DataFrame | None, prompt: str, no_cache: bool = False) -> DataFrame:
    """Chunks whose section is not in the cache yet; all of them with ``no_cache``."""
    keyed = chunk_key(chunks, prompt)
    if no_cache or cache is None:
        return keyed
    return keyed.join(cache.select("chunk_key").distinct(), "chunk_key", "left_anti")


def append_sections(sections: DataFrame, path: str) -> None:
    sections.write.mode("append").parquet(path)


def write_similarity(curve: DataFrame, boundaries: DataFrame, path: str) -> None:
    """Curve rows with a boundary flag."""
    marks = boundaries.select("meeting_id", "win_idx", F.lit(True).alias("is_boundary"))
    curve.join(marks, ["meeting_id", "win_idx"], "left").withColumn(
        "is_boundary", F.coalesce("is_boundary", F.lit(False))
    ).write.mode("overwrite").parquet(path)


def write_assembly(counts: DataFrame, totals: DataFrame, path: str) -> None:
    """Section counts with the totals of their meeting, as JSON rows."""
    counts.join(totals, "meeting_id").write.mode("overwrite").json(path)


def append_run_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("append").parquet(path)


def write_reports(numbered: DataFrame, path: str) -> None:
    """Report lines (meeting_id, line_no, line), one directory per meeting."""
    write_lines(numbered, path, "line_no")
