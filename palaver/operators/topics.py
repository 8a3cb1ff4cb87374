"""Topic segmentation: windows, similarity, smoothing, boundaries, chunks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.functions import text, vectors
from palaver.plans.rows import ordered_text
from palaver.plans.scans import by_index, exact_percentile, frames, islands, ordered_pass, running_number, scan
from palaver.session import cut_lineage

# --- fixed values -----------------------------------------------------------------------------------------------
WINDOW_SIZE = 3
SIGMA = 2.0
TRUNCATE = 4.0
PERCENTILE = 0.05
MIN_DISTANCE = 10
MAX_CHUNK_CHARS = 15000
LIVE_ROLLING, LIVE_K_SIGMA, LIVE_CONFIRM = 20, 2.0, 5
# ----------------------------------------------------------------------------------------------------------------


def build_windows(segments: DataFrame, keys: list[str] | None = None, size: int = WINDOW_SIZE, index: str = "seg_idx") -> DataFrame:
    """Windows of ``size`` consecutive segments, one per position; windows without text are left out and the rest
    renumbered. ``first_seg`` is the position of the window's first segment. Of measured segments (``_len`` instead of the
    text) the windows have no text. Which windows count is told by the lengths, so the text is shuffled only where it is
    asked for."""
    keys = keys or ["meeting_id"]
    lined = _measured(segments)
    with_text = "text" in lined.columns
    if with_text:
        lined = lined.withColumn("_line", text.segment_line(F.col("speaker"), F.col("text")))

    def columns(win: Window) -> dict[str, Column]:
        span = win.rowsBetween(0, size - 1)
        lines = {"_lines": F.collect_list("_line").over(span)} if with_text else {}
        return lines | {
            "_spoken": F.count("_len").over(span),
            "_n": F.count("*").over(span),
            "_last_end": F.last("end").over(span),
        }

    full = frames(lined, keys, index, 0, size - 1, columns).filter((F.col("_n") == size) & (F.col("_spoken") > 0))
    numbered = running_number(full, keys, [index], by_index(index), "n")
    return numbered.select(
        *keys,
        (F.col("n") - 1).cast("int").alias("win_idx"),
        F.col("start").alias("start_time"),
        F.col("_last_end").alias("end_time"),
        *([F.array_join("_lines", "\n").alias("text")] if with_text else []),
        F.col(index).alias("first_seg"),
    )


def adjacent_similarity(windows: DataFrame, keys: list[str] | None = None, index: str = "win_idx") -> DataFrame:
    """Dot product of each window's vector with the next one's; the last window has none."""
    keys = keys or ["meeting_id"]
    slim = windows.select(*keys, index, "embedding")
    paired = frames(slim, keys, index, 0, 1, lambda w: {"_next": F.lead("embedding").over(w)})
    return paired.filter("_next IS NOT NULL").select(
        *keys, index, vectors.dot(F.col("embedding"), F.col("_next")).alias("raw")
    )


def gaussian_weights(sigma: float, truncate: float = TRUNCATE) -> list[float]:
    radius = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    total = sum(raw)
    return [w / total for w in raw]


def smooth_array(values: Column, index: Column, first: Column, n: Column, sigma: float) -> Column:
    """Gaussian average at ``index``; ``values`` holds the curve from position ``first`` on, and positions outside
    0..n-1 are mirrored at the edges, repeatedly for a short curve."""
    weights = gaussian_weights(sigma)
    radius = len(weights) // 2
    total = F.lit(0.0)
    for k, w in zip(range(-radius, radius + 1), weights):
        j = F.pmod(index + k, 2 * n)
        j = F.least(j, 2 * n - 1 - j)
        total = total + F.lit(w) * F.get(values, (j - first).cast("int"))
    return total


def gaussian_smooth(curve: DataFrame, keys: list[str] | None = None, index: str = "win_idx", sigma: float = SIGMA) -> DataFrame:
    """``smoothed`` beside ``raw``; a curve of three points or fewer stays as it is."""
    keys = keys or ["meeting_id"]
    radius = len(gaussian_weights(sigma)) // 2

    def columns(win: Window) -> dict[str, Column]:
        span = win.rowsBetween(-radius, radius)
        return {"_values": F.collect_list("raw").over(span), "_first": F.min(index).over(span), "_top": F.max(index).over(span)}

    around = frames(curve, keys, index, radius, radius, columns)
    # only rows within the radius of the end need the length, and their frame shows the last index
    n = F.when(F.col("_top") - F.col(index) < radius, F.col("_top") + 1).otherwise(F.col("_top") + 1 + 4 * radius)
    smooth = smooth_array(F.col("_values"), F.col(index), F.col("_first"), F.col("_n"), sigma)
    value = F.when((F.col("_n") > 3) & F.lit(sigma > 0), smooth).otherwise(F.col("raw"))
    return around.withColumn("_n", n).withColumn("smoothed", value).drop("_values", "_first", "_top", "_n")


def percentile_candidates(curve: DataFrame, p: float = PERCENTILE) -> DataFrame:
    """Points strictly below the percentile of their own curve."""
    limit = exact_percentile(curve, ["meeting_id"], "smoothed", p).select("meeting_id", F.col("pct").alias("threshold"))
    return curve.join(limit, "meeting_id").filter(F.col("smoothed") < F.col("threshold"))


class PickState:
    __slots__ = ("kept", "value")

    def __init__(self) -> None:
        self.kept, self.value = None, None


def pick_step(min_distance: int):
    def step(state: PickState, row: tuple) -> list[tuple]:
        """A far enough candidate closes the kept one; a near and deeper one takes its place."""
        idx, value = row
        if state.kept is None or idx - state.kept >= min_distance:
            out = [] if state.kept is None else [(state.kept, state.value)]
            state.kept, state.value = idx, value
            return out
        if value < state.value:
            state.kept, state.value = idx, value
        return []

    return step


def pick_finish(state: PickState) -> list[tuple]:
    return [] if state.kept is None else [(state.kept, state.value)]


def min_distance_pick(candidates: DataFrame, min_distance: int = MIN_DISTANCE) -> DataFrame:
    """Boundaries among (meeting_id, win_idx, smoothed) candidates.

    The kept boundary is never past the latest candidate, so a gap of ``min_distance`` between candidates starts afresh
    whatever came before; the rule runs over those runs, not over meetings.
    """
    runs = islands(
        candidates.select("meeting_id", "win_idx", "smoothed"), ["meeting_id"], ["win_idx"], by_index("win_idx", 65536),
        ["win_idx"], lambda cur, prev: cur("win_idx") - prev("win_idx") >= min_distance, "run",
    )
    return ordered_pass(
        runs, ["meeting_id", "run"], ["win_idx"], ["win_idx", "smoothed"], PickState, pick_step(min_distance),
        pick_finish, "meeting_id string, run long, win_idx int, smoothed double",
    ).drop("run")


def coarse_boundaries(boundaries: DataFrame, target: int) -> DataFrame:
    """The ``target - 1`` deepest boundaries of each meeting, the earlier one on a tie."""
    depth = F.row_number().over(Window.partitionBy("meeting_id").orderBy("smoothed", "win_idx"))
    return boundaries.withColumn("_rank", depth).filter(F.col("_rank") <= target - 1).drop("_rank")


def segment_parts(segments: DataFrame, boundaries: DataFrame) -> DataFrame:
    """``part`` of every segment: a boundary at window b cuts before segment b + 1."""
    cuts = boundaries.select("meeting_id", (F.col("win_idx") + 1).alias("seg_idx"), F.lit(1).alias("_cut")).distinct()
    flagged = segments.join(cuts, ["meeting_id", "seg_idx"], "left").withColumn("_cut", F.coalesce("_cut", F.lit(0)))
    return scan(flagged, ["meeting_id"], ["seg_idx"], by_index("seg_idx"), {"part": ("sum", F.col("_cut"))}).drop("_cut")


def _measured(segments: DataFrame) -> DataFrame:
    """Length of the text line of each segment; NULL without text."""
    if "_len" in segments.columns:
        return segments
    return segments.withColumn("_len", F.length(text.segment_line(F.col("speaker"), F.col("text"))))


def part_sizes(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Segments and text length per part, from line lengths alone; the text itself is not put together."""
    lines = F.count("_len")
    chars = F.coalesce(F.sum("_len") + lines - 1, F.lit(0))
    return _measured(segments).groupBy(*keys).agg(
        F.count("*").alias("n_segments"),
        F.when(lines > 0, chars).otherwise(F.lit(0)).alias("n_chars"),
        F.min("seg_idx").alias("first_seg"),
        F.min_by("start", "seg_idx").alias("start_time"),
        F.max_by("end", "seg_idx").alias("end_time"),
    )


def number_chunks(parts: DataFrame) -> DataFrame:
    """Parts with text, numbered from 0 within the meeting."""
    kept = parts.filter("n_chars > 0")
    numbered = running_number(kept, ["meeting_id"], ["first_seg"], by_index("first_seg"), "n")
    return numbered.withColumn("chunk_id", (F.col("n") - 1).cast("int")).drop("n")


def assign_chunks(segments: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Topic chunks cut at the boundaries, before any re-split."""
    placed = segment_parts(segments, boundaries)
    return number_chunks(part_sizes(placed, ["meeting_id", "part"]).drop("part"))


def _similarity_links(segments: DataFrame, size: int, vec: DataFrame) -> DataFrame:
    """Per window start: the next window's start and the similarity of the two (meeting_id, seg_idx, nxt, raw)."""
    starts = build_windows(segments, size=size).select("meeting_id", "win_idx", "first_seg")
    windows = starts.join(vec, ["meeting_id", "first_seg"])

    def columns(win: Window) -> dict[str, Column]:
        return {"_next": F.lead("embedding").over(win), "nxt": F.lead("first_seg").over(win)}

    paired = frames(windows, ["meeting_id"], "win_idx", 0, 1, columns).filter("nxt IS NOT NULL")
    return paired.select(
        "meeting_id", F.col("first_seg").alias("seg_idx"), "nxt", vectors.dot(F.col("embedding"), F.col("_next")).alias("raw")
    )


def split_part(lengths: list, nxt: list, raw: list, max_chars: int, size: int, sigma: float) -> list[int]:
    """Starts of the pieces of one part, as offsets. ``nxt`` and ``raw`` link each window start to the next one."""
    least = max(4, size + 1)
    weights = np.array(gaussian_weights(sigma))
    radius = len(weights) // 2

    def chars(lo: int, hi: int) -> int:
        lines = [n for n in lengths[lo:hi] if n is not None]
        return sum(lines) + len(lines) - 1 if lines else 0

    def cut(lo: int, hi: int) -> int:
        links = [raw[i] for i in range(lo, hi - size) if nxt[i] is not None and nxt[i] <= hi - size]
        if hi - lo < least or not links:
            return lo + (hi - lo) // 2
        curve = np.array(links)
        if len(curve) > 3 and sigma > 0:
            curve = np.convolve(np.pad(curve, radius, mode="symmetric"), weights, mode="valid")
        return lo + int(np.argmin(curve)) + 1

    starts, todo = [], [(0, len(lengths), 4)]
    while todo:
        lo, hi, floor = todo.pop()
        if hi - lo >= floor and chars(lo, hi) > max_chars:
            at = cut(lo, hi)
            todo += [(lo, at, least), (at, hi, least)]
        else:
            starts.append(lo)
    return starts


def resplit_oversize(
    segments: DataFrame, max_chars: int = MAX_CHUNK_CHARS, size: int = WINDOW_SIZE, sigma: float = SIGMA,
    rows_in_task: int = 65536, vec: DataFrame | None = None,
) -> DataFrame:
    """Split parts over ``max_chars`` at their deepest similarity valley until none can be split.

    ``segments`` carries ``part`` and the ``embedding`` of the window that starts at each segment, unless ``vec``
    (meeting_id, first_seg, embedding) has them; the result is the new part of every segment. Similarities are computed once, and from then on a segment is three numbers. A part of up
    to ``rows_in_task`` segments is split to the end by one task; a larger one is halved by whole-table rounds until its
    pieces are small enough.
    """
    key = ["meeting_id", "part"]
    if vec is None:
        vec = segments.select("meeting_id", F.col("seg_idx").alias("first_seg"), "embedding")
    links = _similarity_links(segments, size, vec)
    work = cut_lineage(
        _measured(segments).select(*key, "seg_idx", "_len").join(links, ["meeting_id", "seg_idx"], "left")
        .withColumn("_floor", F.lit(4))
    )
    done: list[DataFrame] = []
    while True:
        lines = F.count("_len")
        sized = work.groupBy(*key).agg(
            F.count("*").alias("_n"), F.min("seg_idx").alias("_from"), (F.sum("_len") + lines - 1).alias("_chars")
        )
        placed = work.join(sized, key).withColumn(
            "_state",
            F.when((F.coalesce("_chars", F.lit(0)) <= max_chars) | (F.col("_n") < F.col("_floor")), "fits")
            .when(F.col("_n") <= rows_in_task, "small").otherwise("large"),
        )
        done.append(placed.filter("_state = 'fits'").select("meeting_id", "seg_idx", F.col("part").cast("long").alias("part")))
        done.append(_split_in_tasks(placed.filter("_state = 'small'"), max_chars, size, sigma))
        large = placed.filter("_state = 'large'")
        if large.isEmpty():
            break
        work = cut_lineage(_halve(large, size, sigma))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _split_in_tasks(small: DataFrame, max_chars: int, size: int, sigma: float) -> DataFrame:
    def run(pdf):
        pdf = pdf.sort_values("seg_idx")
        base = int(pdf["seg_idx"].iloc[0])
        lengths = [None if pd.isna(v) else int(v) for v in pdf["_len"]]
        nxt = [None if pd.isna(v) else int(v) - base for v in pdf["nxt"]]
        starts = np.array(sorted(split_part(lengths, nxt, list(pdf["raw"]), max_chars, size, sigma)))
        offset = pdf["seg_idx"].to_numpy() - base
        part = starts[np.searchsorted(starts, offset, side="right") - 1] + base
        return pd.DataFrame({"meeting_id": pdf["meeting_id"], "seg_idx": pdf["seg_idx"], "part": part})

    slim = small.select("meeting_id", "part", "seg_idx", "_len", "nxt", "raw")
    return slim.groupBy("meeting_id", "part").applyInPandas(run, "meeting_id string, seg_idx int, part long")


def _halve(large: DataFrame, size: int, sigma: float) -> DataFrame:
    """Cut each part once, at the deepest valley of its smoothed curve."""
    key = ["meeting_id", "part"]
    inside = large.filter(F.col("nxt") <= F.col("_from") + F.col("_n") - size)
    curve = running_number(inside, key, ["seg_idx"], by_index("seg_idx"), "_w").withColumn("win_idx", F.col("_w") - 1)
    smooth = gaussian_smooth(cut_lineage(curve.select(*key, "win_idx", "raw")), key, sigma=sigma)
    best = smooth.groupBy(*key).agg(F.min_by("win_idx", F.struct("smoothed", "win_idx")).alias("_best"))
    middle = F.col("_from") + F.floor(F.col("_n") / 2)
    at = F.coalesce(F.when(F.col("_n") >= max(4, size + 1), F.col("_from") + F.col("_best") + 1), middle)
    new_part = F.when(F.col("seg_idx") < at, F.col("_from")).otherwise(at).cast("long")
    return large.join(best, key, "left").select(
        "meeting_id", new_part.alias("part"), "seg_idx", "_len", "nxt", "raw", F.lit(max(4, size + 1)).alias("_floor")
    )


def named_by_first(placed: DataFrame) -> DataFrame:
    """Rename each part to its first segment."""
    first = placed.groupBy("meeting_id", "part").agg(F.min("seg_idx").cast("long").alias("_from"))
    return placed.join(first, ["meeting_id", "part"]).withColumn("part", F.col("_from")).drop("_from")


def topic_chunks(
    segments: DataFrame,
    target: int | None = None,
    max_chars: int = MAX_CHUNK_CHARS,
    size: int = WINDOW_SIZE,
    with_text: bool = True,
) -> DataFrame:
    """The whole chain on segments whose ``embedding`` is the vector of the window starting there.

    The chain runs on the lengths of the lines and on the vectors, each written down once; the text is read again at the
    end, when the chunk of each segment is known, and shuffled to its segment's chunk and to the other lines of the chunk.
    """
    measured = cut_lineage(_measured(segments).select("meeting_id", "seg_idx", "start", "end", "_len"))
    vec = cut_lineage(segments.select("meeting_id", F.col("seg_idx").alias("first_seg"), "embedding"))
    windows = build_windows(measured, size=size).join(vec, ["meeting_id", "first_seg"])
    curve = cut_lineage(gaussian_smooth(adjacent_similarity(windows)))
    bounds = cut_lineage(min_distance_pick(cut_lineage(percentile_candidates(curve))))
    if target:
        bounds = coarse_boundaries(bounds, target)
    placed = cut_lineage(named_by_first(segment_parts(measured, bounds)))
    parts = cut_lineage(resplit_oversize(placed, max_chars, size, vec=vec))
    final = placed.drop("part").join(parts, ["meeting_id", "seg_idx"])
    chunks = number_chunks(part_sizes(final, ["meeting_id", "part"]))
    if not with_text:
        return chunks.drop("part")
    line = text.segment_line(F.col("speaker"), F.col("text"))
    lines = segments.select("meeting_id", "seg_idx", line.alias("line")).filter("line IS NOT NULL")
    bodies = lines.join(parts, ["meeting_id", "seg_idx"]).groupBy("meeting_id", "part").agg(
        ordered_text("line", "seg_idx").alias("text")
    )
    return chunks.join(bodies, ["meeting_id", "part"]).drop("part")


def similarity_stats(curve: DataFrame) -> DataFrame:
    return curve.groupBy("meeting_id").agg(
        F.min("raw").alias("sim_min"), F.max("raw").alias("sim_max"), F.avg("raw").alias("sim_mean")
    )


# --- live curve -------------------------------------------------------------------------------------------------


def causal_smooth(curve: DataFrame, sigma: float = SIGMA) -> DataFrame:
    """One-sided smoothing over the last values; the first two stay raw."""
    behind = int(2 * sigma)

    def columns(win: Window) -> dict[str, Column]:
        return {"_values": F.collect_list("raw").over(win.rowsBetween(-behind, 0))}

    weights = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(behind + 1)]
    seen = frames(curve, ["meeting_id"], "win_idx", behind, 0, columns)
    size = F.size("_values")
    top, bottom = F.lit(0.0), F.lit(0.0)
    for k, w in enumerate(weights):
        has = size > k
        top = top + F.when(has, F.lit(w) * F.get("_values", size - 1 - k)).otherwise(F.lit(0.0))
        bottom = bottom + F.when(has, F.lit(w)).otherwise(F.lit(0.0))
    value = F.when(F.col("win_idx") < 2, F.col("raw")).otherwise(top / bottom)
    return seen.withColumn("smoothed", value).drop("_values")


def rolling_threshold(curve: DataFrame, n: int = LIVE_ROLLING, k_sigma: float = LIVE_K_SIGMA) -> DataFrame:
    """Mean less ``k_sigma`` deviations of the last ``n`` smoothed values; NULL until there are that many."""

    def columns(win: Window) -> dict[str, Column]:
        span = win.rowsBetween(-(n - 1), 0)
        return {
            "_m": F.avg("smoothed").over(span), "_d": F.stddev_pop("smoothed").over(span), "_c": F.count("*").over(span)
        }

    seen = frames(curve, ["meeting_id"], "win_idx", n - 1, 0, columns)
    limit = F.when(F.col("_c") >= n, F.col("_m") - F.lit(k_sigma) * F.col("_d"))
    return seen.withColumn("threshold", limit).withColumn(
        "candidate", F.coalesce(F.col("smoothed") < F.col("threshold"), F.lit(False))
    ).drop("_m", "_d", "_c")


def confirm_valley(candidates: DataFrame, delay: int = LIVE_CONFIRM) -> DataFrame:
    """Candidates with enough later points, none of which from the second to the last of the delay is lower."""

    def columns(win: Window) -> dict[str, Column]:
        return {
            "_low": F.min("smoothed").over(win.rowsBetween(2, delay)),
            "_later": F.count("*").over(win.rowsBetween(1, delay)),
        }

    seen = frames(candidates, ["meeting_id"], "win_idx", 0, delay, columns)
    ok = F.col("candidate") & (F.col("_later") >= delay) & (F.coalesce("_low", F.col("smoothed")) >= F.col("smoothed"))
    return seen.withColumn("confirmed", ok).drop("_low", "_later")


def vectorize_windows(windows: DataFrame, features: int = 4096, keys: list[str] | None = None) -> DataFrame:
    """Unit vectors of window texts from hashed word counts, for when no sentence vectors are at hand.

    Words are counted with a hash into ``features`` places; inverse document frequencies come from one pass.
    """
    from pyspark.ml.feature import IDF, HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    words = windows.withColumn("_w", F.split(F.lower("text"), r"\W+"))
    counted = HashingTF(inputCol="_w", outputCol="_tf", numFeatures=features).transform(words)
    weighted = IDF(inputCol="_tf", outputCol="_idf").fit(counted).transform(counted)
    unit = Normalizer(inputCol="_idf", outputCol="_unit").transform(weighted)
    return unit.withColumn("embedding", vector_to_array("_unit")).drop("_w", "_tf", "_idf", "_unit")
