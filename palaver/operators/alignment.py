"""Joins of points, words and segments in time.

Nearest-in-time lookups are a union of both sides and one bucketed scan, so neither side is paired with the other and
a long meeting is spread over its time slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.plans.scans import by_index, by_time, running_number, scan
from palaver.session import cut_lineage

# --- fixed values -----------------------------------------------------------------------------------------------
DEFAULT_SPEAKER = "SPEAKER_00"
PROVISIONAL_SPEAKER = "SPEAKER_?"
PUNCTUATION = ".!?।"
SNAP_HOP_S = 5.0
# ----------------------------------------------------------------------------------------------------------------


def neighbours(
    left: DataFrame, right: DataFrame, keys: list[str], at: str, right_at: str, payload: list[str], bucket_s: float = 600.0
) -> DataFrame:
    """Each left row with ``before`` (latest right row at or before it) and ``after`` (first right row past it)."""
    value = F.struct(F.col(right_at).alias("at"), *[F.col(c) for c in payload])
    points = right.select(*keys, F.col(right_at).alias("_t"), F.lit(0).alias("_k"), value.alias("_v"), F.lit(None).alias("_row"))
    rows = F.struct(*[F.col(c) for c in left.columns if c not in keys])
    probes = left.select(*keys, F.col(at).alias("_t"), F.lit(1).alias("_k"), F.lit(None).alias("_v"), rows.alias("_row"))
    both = points.unionByName(probes)
    seen = scan(both, keys, ["_t", "_k"], by_time("_t", bucket_s), {"before": ("last", "_v"), "after": ("next", "_v")})
    own = [F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in left.columns]
    return seen.filter("_k = 1").select(*own, "before", "after")


NEVER = 1e15  # past the end of every meeting, in seconds


def align_words_midpoint(words: DataFrame, segments: DataFrame) -> DataFrame:
    """Speaker of each word by its midpoint.

    Of the segments in order of their start, the first whose end lies past the midpoint counts. If it has not begun, the word
    is in a gap, and the nearer of it and the segment before counts, the later one on a tie; past all segments the last one;
    without segments a default. A segment can be the first past some midpoint only if its end lies past all ends before it, so
    one running maximum and one lookup are enough, whether segments overlap or not.
    """
    order = ["start", "idx" if "idx" in segments.columns else "end"]
    spans = segments.select("meeting_id", F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), "speaker", F.col(order[1]).cast("double").alias("_nth"))
    close = spans.groupBy("meeting_id").agg(F.lit(NEVER).alias("start"), F.lit(2 * NEVER).alias("end"), F.lit(None).cast("string").alias("speaker"), F.lit(0.0).alias("_nth"))
    seen = scan(
        spans.unionByName(close), ["meeting_id"], ["start", "_nth"], by_time("start", 600.0),
        {"_reach": ("max_before", F.col("end")), "prev": ("lag", F.struct("end", "speaker"))},
    )
    first = seen.filter(F.col("_reach").isNull() | (F.col("end") > F.col("_reach")))
    probes = words.drop("speaker").withColumn("_mid", (F.col("start") + F.col("end")) / 2.0)
    near = neighbours(probes, first, ["meeting_id"], "_mid", "end", ["start", "speaker", "prev"])
    mid, seg = F.col("_mid"), F.col("after")
    before = (mid < seg["start"]) & seg["prev"].isNotNull() & ((mid - seg["prev"]["end"]) < (seg["start"] - mid))
    speaker = F.when(seg.isNull(), F.lit(DEFAULT_SPEAKER)).when(before, seg["prev"]["speaker"]).otherwise(seg["speaker"])
    return near.withColumn("speaker", speaker).drop("_mid", "before", "after")


def nearest_label(points: DataFrame, vectors: DataFrame, at: str, vec_at: str, order: str, default: str) -> DataFrame:
    """Label of the vector nearest in time, the earlier on a tie; ``default`` where the meeting has none."""
    unique = vectors.groupBy("meeting_id", F.col(vec_at).alias("_at")).agg(F.min_by("label", order).alias("label"))
    near = neighbours(points, unique, ["meeting_id"], at, "_at", ["label"])
    t, b, a = F.col(at), F.col("before"), F.col("after")
    take_before = b.isNotNull() & (a.isNull() | ((t - b["at"]) <= (a["at"] - t)))
    label = F.when(take_before, b["label"]).otherwise(a["label"])
    return near.withColumn("label", label).withColumn(
        "speaker", F.when(label.isNull(), F.lit(default)).otherwise(speaker_name(label))
    ).drop("before", "after")


def speaker_name(label: Column) -> Column:
    return F.format_string("SPEAKER_%02d", label.cast("int"))


def fill_unlabelled(speech: DataFrame, subsegments: DataFrame) -> DataFrame:
    """Speech segments without a sub-segment, with the speaker of the nearest sub-segment midpoint."""
    covered = subsegments.select("meeting_id", F.col("parent_idx").alias("idx")).distinct()
    bare = speech.join(covered, ["meeting_id", "idx"], "left_anti")
    mids = subsegments.withColumn("_mid", (F.col("start") + F.col("end")) / 2.0)
    probes = bare.withColumn("_mid", (F.col("start") + F.col("end")) / 2.0)
    return nearest_label(probes, mids, "_mid", "_mid", "sub_idx", DEFAULT_SPEAKER).select(
        "meeting_id", "idx", "start", "end", "speaker"
    )


def backward_asof(rows: DataFrame, marks: DataFrame, key: str, at: str, bucket_s: float = 3600.0) -> DataFrame:
    """Each row with the label of the latest mark at or before it."""
    near = neighbours(rows, marks, [key], at, at, ["mark"], bucket_s)
    return near.withColumn("mark", F.col("before")["mark"]).drop("before", "after")


def active_turn(turns: DataFrame, probes: DataFrame, bucket_s: float = 30.0) -> DataFrame:
    """Index of the first turn with start <= t < end at each probe (meeting_id, t); -1 when none."""
    slot = lambda c: F.floor(c / bucket_s)
    spread = turns.filter(F.col("end") > F.col("start")).select(
        "meeting_id", "turn_idx", "start", "end", F.explode(F.sequence(slot(F.col("start")), slot(F.col("end")))).alias("_slot")
    )
    keyed = probes.select("meeting_id", "t").distinct().withColumn("_slot", slot(F.col("t")))
    hits = keyed.join(spread, ["meeting_id", "_slot"]).filter((F.col("t") >= F.col("start")) & (F.col("t") < F.col("end")))
    found = hits.groupBy("meeting_id", "t").agg(F.min("turn_idx").alias("active"))
    return probes.join(found, ["meeting_id", "t"], "left").withColumn("active", F.coalesce("active", F.lit(-1)))


def change_points(segments: DataFrame) -> DataFrame:
    """Times at which the diarised speaker differs from the one before."""
    seen = scan(segments, ["meeting_id"], ["start", "end"], by_time("start", 600.0), {"_prev": ("lag", F.struct("speaker"))})
    return seen.filter(F.col("_prev").isNull() | ~F.col("speaker").eqNullSafe(F.col("_prev")["speaker"])).select(
        "meeting_id", F.col("start").alias("at"), "speaker"
    )


def number_words(words: DataFrame) -> DataFrame:
    """Dense 0-based ``i`` in time order."""
    out = running_number(words, ["meeting_id"], ["start", "word_idx"], by_time("start", 600.0), "i")
    return out.withColumn("i", F.col("i") - 1)


def boundary_snap(numbered: DataFrame, changes: DataFrame, hop_s: float = SNAP_HOP_S) -> DataFrame:
    """Word index each speaker change is moved to: after the nearest punctuated word within the hop, counted in words,
    the later one on a tie; after the reference word when there is none. A change past the last word is dropped."""
    marks = F.lit(False)
    for p in PUNCTUATION:
        marks = marks | F.col("word").contains(p)
    here = F.struct("i", "start")
    key, none = ["meeting_id"], F.lit(None)
    # the reference word: of the words past the change the first one, so words go before a change at their time
    change = F.struct(F.col("at"), F.col("speaker"))
    words = numbered.select(*key, F.col("start").alias("_t"), F.lit(0).alias("_k"), "i", F.struct("i", F.col("start").alias("at")).alias("_v"), none.alias("_row"))
    probes = changes.select(*key, F.col("at").alias("_t"), F.lit(1).alias("_k"), none.alias("i"), none.alias("_v"), change.alias("_row"))
    seen = scan(words.unionByName(probes), key, ["_t", "_k", "i"], by_time("_t", 600.0), {"after": ("next", "_v")})
    found = cut_lineage(seen.filter("_k = 1 AND after IS NOT NULL").select(*key, "_row", "after"))
    # the punctuated words around it, on those words alone; a reference word may be one itself
    points = numbered.filter(marks).select(*key, "i", F.lit(1).alias("_k"), here.alias("_p"), none.alias("_row"), none.alias("after"))
    refs = found.select(*key, F.col("after")["i"].alias("i"), F.lit(0).alias("_k"), none.alias("_p"), "_row", "after")
    punct = scan(points.unionByName(refs), key, ["i", "_k"], by_index("i"), {"fwd": ("next", "_p"), "bwd": ("last", "_p")})
    near = punct.filter("_k = 0").select(*key, "_row.*", F.struct("after.*", "fwd", "bwd").alias("after"))
    r, f, b = F.col("after"), F.col("after")["fwd"], F.col("after")["bwd"]
    f_ok = F.coalesce(f["start"] <= r["at"] + hop_s, F.lit(False))
    b_ok = F.coalesce(b["start"] >= r["at"] - hop_s, F.lit(False))
    forward = f_ok & (~b_ok | ((f["i"] - r["i"]) <= (r["i"] - b["i"])))
    chosen = F.when(forward, f["i"]).when(b_ok, b["i"]).otherwise(r["i"])
    pos = F.when(r["i"] == 0, F.lit(0)).otherwise(chosen + 1)
    return near.select("meeting_id", "at", "speaker", pos.alias("i"))


def forward_fill(numbered: DataFrame, points: DataFrame, first_speakers: DataFrame) -> DataFrame:
    """Speaker of each word: that of the latest point at or before it; of points on one word the last counts."""
    at = points.filter("meeting_id IS NOT NULL").groupBy("meeting_id", "i").agg(F.max_by("speaker", "at").alias("_change"))
    words = numbered.drop("speaker").withColumns({"_k": F.lit(1), "_change": F.lit(None).cast("string")})
    marked = words.unionByName(at.withColumn("_k", F.lit(0)), allowMissingColumns=True)
    filled = scan(marked, ["meeting_id"], ["i", "_k"], by_index("i"), {"_spk": ("last", "_change")}).filter("_k = 1").drop("_k")
    named = filled.join(first_speakers, "meeting_id", "left")
    return named.withColumn(
        "speaker", F.coalesce("_spk", "first_speaker", F.lit(DEFAULT_SPEAKER))
    ).drop("_change", "_spk", "first_speaker")


def align_words_boundary(words: DataFrame, segments: DataFrame, hop_s: float = SNAP_HOP_S) -> DataFrame:
    """Speaker of each word with changes moved to punctuation."""
    numbered = cut_lineage(number_words(words.drop("speaker")))
    points = cut_lineage(boundary_snap(numbered, change_points(segments), hop_s))
    first = segments.groupBy("meeting_id").agg(F.min_by("speaker", F.struct("start", "end")).alias("first_speaker"))
    return forward_fill(numbered, points, first)
