"""Speech and speaker segments, and their quality measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palaver.operators.alignment import fill_unlabelled, speaker_name
from palaver.operators.assignment import optimal_map
from palaver.plans.scans import by_index, by_time, islands, scan
from palaver.session import cut_lineage

# --- fixed values -----------------------------------------------------------------------------------------------
SPEECH_THRESHOLD = 0.4
MIN_SPEECH_S, MIN_SILENCE_S, SPEECH_PAD_S = 0.2, 0.05, 0.02
FRAME_S = 0.032
MERGE_GAP_S = 0.7
LIVE_GAP_S, LIVE_HALF_S = 0.1, 0.6
WIN_S, HOP_S, MIN_SEGMENT_S = 1.2, 0.6, 0.4
COLLAR_S = 0.25
# ----------------------------------------------------------------------------------------------------------------


def label_subsegments(subsegments: DataFrame) -> DataFrame:
    return subsegments.select("meeting_id", "start", "end", speaker_name(F.col("label")).alias("speaker"))


def speech_plus_filled(speech: DataFrame, subsegments: DataFrame) -> DataFrame:
    """Labelled sub-segments and the speech segments that have none."""
    filled = fill_unlabelled(speech, subsegments).drop("idx")
    return label_subsegments(subsegments).unionByName(filled)


def merge_adjacent(segments: DataFrame, gap_s: float = MERGE_GAP_S) -> DataFrame:
    """Merge a segment into the one before when the speaker is the same and the gap is short."""
    order, key = ["start", "end", "speaker"], ["meeting_id"]  # total but for equal rows
    runs = cut_lineage(islands(
        segments, key, order, by_time("start", 600.0), ["speaker"],
        lambda cur, prev: ~cur("speaker").eqNullSafe(prev("speaker")), "run",
    ))
    key2 = [*key, "run"]
    reach = scan(runs, key2, order, by_time("start", 600.0), {"_reach": ("max_before", F.col("end"))}, keep=True)
    opens = F.when(F.col("_reach").isNull() | ((F.col("start") - F.col("_reach")) >= gap_s), 1).otherwise(0)
    parts = scan(reach.withColumn("_open", opens), key2, order, None, {"part": ("sum", F.col("_open"))})
    merged = parts.groupBy(*key2, "part").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.first("speaker").alias("speaker")
    )
    return merged.drop("run", "part")


def live_segments(vectors: DataFrame) -> DataFrame:
    """Merge consecutive vectors (meeting_id, idx, center, label) of one label whose windows touch."""
    runs = islands(
        vectors, ["meeting_id"], ["idx"], by_index("idx"), ["label", "center"],
        lambda cur, prev: (cur("label") != prev("label"))
        | ((cur("center") - LIVE_HALF_S) > (prev("center") + LIVE_HALF_S) + LIVE_GAP_S),
        "run",
    )
    return runs.groupBy("meeting_id", "run").agg(
        (F.min_by("center", "idx") - LIVE_HALF_S).alias("start"),
        (F.max_by("center", "idx") + LIVE_HALF_S).alias("end"),
        speaker_name(F.first("label")).alias("speaker"),
    ).drop("run")


def subsegment_windows(speech: DataFrame) -> DataFrame:
    """Analysis windows of each speech segment: the whole when short, else 1.2 s every 0.6 s, the last one clipped."""
    length = F.col("end") - F.col("start")
    last = F.greatest(F.ceil((length - MIN_SEGMENT_S) / HOP_S) - 1, F.lit(0))
    steps = speech.filter(length >= MIN_SEGMENT_S).withColumn(
        "k", F.explode(F.when(length <= WIN_S * 1.5, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), last + 1)))
    )
    ws = F.col("start") + F.col("k") * HOP_S
    whole = length <= WIN_S * 1.5
    return steps.filter(whole | (ws + MIN_SEGMENT_S < F.col("end"))).select(
        "meeting_id",
        F.col("idx").alias("parent_idx"),
        F.col("k").alias("win"),
        F.when(whole, F.col("start")).otherwise(ws).alias("start"),
        F.when(whole, F.col("end")).otherwise(F.least(ws + WIN_S, F.col("end"))).alias("end"),
    )


def window_has_speech(frames: DataFrame, frames_per_window: int) -> DataFrame:
    """Per window of frames, whether any reaches the speech threshold."""
    win = F.floor(F.col("frame_idx") / frames_per_window).alias("win_idx")
    return frames.groupBy("meeting_id", win).agg(F.bool_or(F.col("prob") >= SPEECH_THRESHOLD).alias("has_speech"))


def speech_islands(frames: DataFrame) -> DataFrame:
    """Speech segments of a frame-probability table: bridge short silences, drop short speech, pad the ends."""
    voiced = frames.filter(F.col("prob") >= SPEECH_THRESHOLD).withColumn("_t", F.col("frame_idx") * FRAME_S)
    order, bucket = ["frame_idx"], F.floor(F.col("frame_idx") / 4096)
    runs = islands(
        voiced, ["meeting_id"], order, bucket, ["frame_idx"],
        lambda cur, prev: (cur("frame_idx") - prev("frame_idx") - 1) * FRAME_S >= MIN_SILENCE_S, "run",
    )
    spans = runs.groupBy("meeting_id", "run").agg(
        (F.min("frame_idx") * FRAME_S).alias("start"), ((F.max("frame_idx") + 1) * FRAME_S).alias("end")
    ).filter(F.col("end") - F.col("start") >= MIN_SPEECH_S)
    near = scan(
        spans, ["meeting_id"], ["start"], by_time("start", 600.0), {"_prev": ("lag", F.col("end")), "_next": ("lead", F.col("start"))}
    )
    # two neighbours closer than twice the pad share the silence between them
    pad = F.lit(SPEECH_PAD_S)
    start = F.when(F.col("_prev").isNull(), F.greatest(F.col("start") - pad, F.lit(0.0))).otherwise(
        F.greatest(F.col("start") - pad, (F.col("_prev") + F.col("start")) / 2)
    )
    end = F.when(F.col("_next").isNull(), F.col("end") + pad).otherwise(
        F.least(F.col("end") + pad, (F.col("end") + F.col("_next")) / 2)
    )
    return near.select("meeting_id", start.alias("start"), end.alias("end"))


def vad_stats(speech: DataFrame, durations: DataFrame) -> DataFrame:
    """Segments, speech seconds and speech share per meeting; (meeting_id, duration) gives the audio length."""
    agg = speech.groupBy("meeting_id").agg(
        F.count("*").alias("n_segments"), F.sum(F.col("end") - F.col("start")).alias("speech_s")
    )
    out = durations.join(agg, "meeting_id", "left")
    speech_s = F.coalesce("speech_s", F.lit(0.0))
    return out.select(
        "meeting_id",
        F.coalesce("n_segments", F.lit(0)).alias("n_segments"),
        speech_s.alias("speech_s"),
        F.when(F.col("duration") > 0, speech_s / F.col("duration")).otherwise(F.lit(0.0)).alias("speech_ratio"),
    )


def words_per_speaker(words: DataFrame) -> DataFrame:
    return words.groupBy("meeting_id", "speaker").agg(F.count("*").alias("n_words"))


def unique_speakers(turns: DataFrame) -> DataFrame:
    return turns.groupBy("meeting_id").agg(F.sort_array(F.collect_set("speaker")).alias("speakers"))


def real_time_factor(runs: DataFrame) -> DataFrame:
    return runs.withColumn("rtf", F.try_divide("processing_s", "audio_s"))


def _edges(rows: DataFrame, side: str) -> DataFrame:
    """+1/-1 events of one labelling."""
    keep = ["meeting_id", "speaker"]
    return rows.select(*keep, F.col("start").alias("t"), F.lit(1).alias("d"), F.lit(side).alias("side")).unionByName(
        rows.select(*keep, F.col("end").alias("t"), F.lit(-1).alias("d"), F.lit(side).alias("side"))
    )


def speaker_cooccurrence(reference: DataFrame, hypothesis: DataFrame, bucket_s: float = 60.0) -> DataFrame:
    """Seconds each reference speaker overlaps each hypothesis speaker, through time slots."""

    def slots(df: DataFrame, prefix: str) -> DataFrame:
        span = F.sequence(F.floor(F.col("start") / bucket_s), F.floor(F.col("end") / bucket_s))
        return df.select(
            "meeting_id", F.col("speaker").alias(f"{prefix}_spk"), "start", "end", F.explode(span).alias("_slot")
        ).select(
            "meeting_id", "_slot", f"{prefix}_spk",
            F.greatest("start", F.col("_slot") * bucket_s).alias(f"{prefix}_s"),
            F.least("end", (F.col("_slot") + 1) * bucket_s).alias(f"{prefix}_e"),
        )

    both = slots(reference, "r").join(slots(hypothesis, "h"), ["meeting_id", "_slot"])
    overlap = F.least("r_e", "h_e") - F.greatest("r_s", "h_s")
    return both.filter(overlap > 0).groupBy("meeting_id", "r_spk", "h_spk").agg(F.sum(overlap).alias("overlap_s"))


def greedy_speaker_map(overlaps: DataFrame, rounds: int | None = None) -> DataFrame:
    """One-to-one map of hypothesis to reference speakers, largest overlap first.

    A pair is taken when it leads both its row and its column; taking all such pairs of all meetings in one round gives
    the same map as taking them one by one, and at least one pair per meeting goes each round.
    """
    left = overlaps
    taken: DataFrame | None = None
    order = [F.col("overlap_s").desc(), "r_spk", "h_spk"]
    while True:
        lead_r = F.row_number().over(Window.partitionBy("meeting_id", "r_spk").orderBy(*order))
        lead_h = F.row_number().over(Window.partitionBy("meeting_id", "h_spk").orderBy(*order))
        ranked = left.withColumns({"_r": lead_r, "_h": lead_h})
        pick = cut_lineage(ranked.filter("_r = 1 AND _h = 1").select("meeting_id", "r_spk", "h_spk"))
        if pick.isEmpty():
            break
        taken = pick if taken is None else taken.unionByName(pick)
        left = cut_lineage(
            left.join(pick.select("meeting_id", "r_spk"), ["meeting_id", "r_spk"], "left_anti").join(
                pick.select("meeting_id", "h_spk"), ["meeting_id", "h_spk"], "left_anti"
            )
        )
    return taken if taken is not None else left.select("meeting_id", "r_spk", "h_spk")


def der_components(
    reference: DataFrame, hypothesis: DataFrame, mapping: DataFrame | None = None, collar_s: float = COLLAR_S, skip_overlap: bool = True
) -> DataFrame:
    """Missed, false-alarm and confused seconds over the reference time, per meeting. Without a ``mapping`` of the hypothesis'
    speakers, the one-to-one map with the longest overlap is used.

    The time line is cut at every edge. Around each reference edge a collar is left out, half of ``collar_s`` on each
    side, and so is overlapped reference speech. With a running count of open segments per side, every piece between
    two cuts knows how many reference and hypothesis speakers it has; the mapped speakers that agree come from the same
    counts on mapped names.
    """
    ref = reference.select("meeting_id", "speaker", "start", "end")
    if mapping is None:
        mapping = cut_lineage(optimal_map(speaker_cooccurrence(reference, hypothesis)))
    hyp = (
        hypothesis.select("meeting_id", F.col("speaker").alias("h_spk"), "start", "end")
        .join(mapping, ["meeting_id", "h_spk"], "left")
        .select("meeting_id", F.coalesce("r_spk", F.concat(F.lit("?"), "h_spk")).alias("speaker"), "start", "end")
    )
    half = collar_s / 2.0
    edges = ref.select("meeting_id", F.col("start").alias("e")).unionByName(ref.select("meeting_id", F.col("end").alias("e")))
    collars = edges.select(
        "meeting_id", F.lit("").alias("speaker"), (F.col("e") - half).alias("start"), (F.col("e") + half).alias("end")
    )
    events = _edges(ref, "r").unionByName(_edges(hyp, "h")).unionByName(_edges(collars, "c"))
    at = events.groupBy("meeting_id", "t").agg(
        *[F.sum(F.when(F.col("side") == s, F.col("d")).otherwise(0)).alias(s) for s in ("r", "h", "c")]
    )
    pieces = scan(
        at, ["meeting_id"], ["t"], by_time("t", 600.0),
        {
            "n_r": ("sum", F.col("r")), "n_h": ("sum", F.col("h")), "n_c": ("sum", F.col("c")), "t_next": ("lead", F.col("t")),
        },
    ).withColumn("dur", F.col("t_next") - F.col("t"))
    pieces = cut_lineage(pieces)
    scored = F.col("t_next").isNotNull() & (F.col("n_c") == 0)
    if skip_overlap:
        scored = scored & (F.col("n_r") <= 1)
    counted = pieces.filter(scored).groupBy("meeting_id").agg(
        F.sum(F.col("n_r") * F.col("dur")).alias("total_s"),
        F.sum(F.greatest(F.col("n_r") - F.col("n_h"), F.lit(0)) * F.col("dur")).alias("miss_s"),
        F.sum(F.greatest(F.col("n_h") - F.col("n_r"), F.lit(0)) * F.col("dur")).alias("false_alarm_s"),
        F.sum(F.least("n_r", "n_h") * F.col("dur")).alias("both_s"),
    )
    # correct time: pieces of one speaker name where both sides are open; scored-time flags ride along as extra sides
    named = _edges(ref, "r").unionByName(_edges(hyp, "h"))
    blocked = pieces.select(
        "meeting_id", "t", F.when(scored, 0).otherwise(1).alias("_blocked")
    )
    flips = scan(blocked, ["meeting_id"], ["t"], by_time("t", 600.0), {"_was": ("lag", F.col("_blocked"))}).filter(
        F.col("_blocked") != F.coalesce("_was", F.lit(0))
    ).select("meeting_id", "t", F.when(F.col("_blocked") == 1, 1).otherwise(-1).alias("d"))
    speakers = named.filter("side = 'r'").select("meeting_id", "speaker").distinct()
    switches = flips.join(speakers, "meeting_id").select("meeting_id", "speaker", "t", "d", F.lit("b").alias("side"))
    per_name = named.join(speakers, ["meeting_id", "speaker"], "left_semi").unionByName(switches)
    at_name = per_name.groupBy("meeting_id", "speaker", "t").agg(
        *[F.sum(F.when(F.col("side") == s, F.col("d")).otherwise(0)).alias(s) for s in ("r", "h", "b")]
    )
    agree = scan(
        at_name, ["meeting_id", "speaker"], ["t"], by_time("t", 600.0),
        {"n_r": ("sum", F.col("r")), "n_h": ("sum", F.col("h")), "n_b": ("sum", F.col("b")), "t_next": ("lead", F.col("t"))},
    ).filter("n_r > 0 AND n_h > 0 AND n_b = 0 AND t_next IS NOT NULL")
    correct = agree.groupBy("meeting_id").agg(F.sum(F.col("t_next") - F.col("t")).alias("correct_s"))
    out = counted.join(correct, "meeting_id", "left")
    zero = F.lit(0.0)
    confusion = F.col("both_s") - F.coalesce("correct_s", zero)
    total = F.when(F.col("total_s") > 0, F.col("total_s")).otherwise(F.lit(1.0))
    return out.select(
        "meeting_id",
        F.col("total_s"),
        (F.col("miss_s") / total).alias("miss"),
        (F.col("false_alarm_s") / total).alias("false_alarm"),
        (confusion / total).alias("confusion"),
        ((F.col("miss_s") + F.col("false_alarm_s") + confusion) / total).alias("der"),
    )
