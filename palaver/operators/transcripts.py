"""Transcript lines, sentences, words and turns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.functions import text
from palaver.plans.rows import ordered_text, tasks_for
from palaver.plans.scans import BUCKET, block_pass, by_index, by_time, islands, running_number, scan
from palaver.session import cut_lineage

# --- fixed values -----------------------------------------------------------------------------------------------
SILENCE_GAP_S = 0.8
MIN_TURN_S = 5.0
MAX_TURN_S = 30.0
MAX_TURN_WORDS = 120
SENTENCE_ENDERS = (".", "!", "?", "…")
PUNCTUATION_TOKENS = (".", ",", "!", "?", ":", ";", "...")
TOKEN_TAIL_S = 0.08
WORD_MARKS = " ▁"
PAST_WORDS = 1 << 48
# ----------------------------------------------------------------------------------------------------------------


def parse_lines(lines: DataFrame) -> DataFrame:
    """Segments of (meeting_id, line_no, raw) rows; lines no grammar reads are dropped."""
    parsed = F.array_compact(F.array(text.parse_line(F.col("raw"), F.col("line_no"))))
    return lines.select("meeting_id", "line_no", F.inline(parsed))


def to_segments(parsed: DataFrame) -> DataFrame:
    """Segments numbered by start time, line order breaking ties."""
    ordered = running_number(parsed, ["meeting_id"], ["start", "line_no"], by_time("start"), "n")
    return ordered.select(
        "meeting_id", (F.col("n") - 1).cast("int").alias("seg_idx"), "start", "end", "speaker", "text"
    )


def normalize_lines(lines: DataFrame, max_chars: int | None = 300) -> DataFrame:
    out = lines.select(
        "meeting_id", "line_no", F.posexplode(text.normalized_lines(F.col("raw"), max_chars)).alias("pos", "line")
    )
    return out.withColumn("pos", F.col("pos") + 1)


def split_ratio(lines: DataFrame, max_chars: int | None = 300) -> DataFrame:
    """Lines in, lines out and their ratio per meeting."""
    counted = lines.select("meeting_id", F.size(text.normalized_lines(F.col("raw"), max_chars)).alias("n"))
    return counted.groupBy("meeting_id").agg(
        F.count("*").alias("n_in"), F.sum("n").alias("n_out"), F.try_divide(F.sum("n"), F.count("*")).alias("ratio")
    )


def sentence_turns(turns: DataFrame, max_chars: int | None = 300) -> DataFrame:
    """Turns cut into sentences; the time of a turn is shared by sentence length."""
    parts = turns.withColumn("_s", text.split_sentences(F.col("text"), max_chars))
    single = F.size("_s") <= 1
    lens = F.transform("_s", lambda s: F.length(s))
    pieces = F.when(single, F.array(F.col("text"))).otherwise(F.col("_s"))
    out = parts.withColumns({"_n": lens, "_total": F.aggregate(lens, F.lit(0), lambda a, x: a + x)}).select(
        *[c for c in turns.columns if c not in ("start", "end", "text")],
        F.col("start").alias("_from"),
        F.col("end").alias("_to"),
        "_n",
        "_total",
        F.size(pieces).alias("_k"),
        F.posexplode(pieces).alias("_i", "text"),
    )
    before = F.aggregate(F.slice("_n", 1, F.col("_i")), F.lit(0), lambda a, x: a + x)
    span = F.greatest(F.col("_to") - F.col("_from"), F.lit(0.0))
    begin = F.col("_from") + span * before / F.col("_total")
    finish = F.col("_from") + span * (before + F.get("_n", F.col("_i"))) / F.col("_total")
    one, last = F.col("_k") == 1, F.col("_i") == F.col("_k") - 1
    return out.select(
        *[c for c in turns.columns if c not in ("start", "end", "text")],
        (F.col("_i") + 1).alias("pos"),
        F.when(one, F.col("_from")).otherwise(begin).alias("start"),
        F.when(one | last | (span == 0), F.col("_to")).otherwise(finish).alias("end"),
        "text",
    )


def segments_to_text(segments: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``[speaker]: text`` lines per key. Use a key whose groups are bounded, such as the topic chunk."""
    lines = segments.select(*keys, order, text.segment_line(F.col("speaker"), F.col("text")).alias("line"))
    return lines.filter("line IS NOT NULL").groupBy(*keys).agg(ordered_text("line", order).alias("text"))


def apply_speaker_mapping(segments: DataFrame, names: DataFrame) -> DataFrame:
    """Replace labels by names; a label without a name stays."""
    mapped = names.select("meeting_id", F.col("label").alias("speaker"), "nom")
    return segments.join(mapped, ["meeting_id", "speaker"], "left").withColumn(
        "speaker", F.coalesce("nom", "speaker")
    ).drop("nom")


def words_to_turns(words: DataFrame) -> DataFrame:
    """Consecutive words of one speaker as one turn."""
    runs = islands(
        words, ["meeting_id"], ["word_idx"], by_time("start"), ["speaker"],
        lambda cur, prev: ~cur("speaker").eqNullSafe(prev("speaker")), "turn",
    )
    return runs.groupBy("meeting_id", "turn").agg(
        F.min("start").alias("start"),
        F.max_by("end", "word_idx").alias("end"),
        F.first("speaker").alias("speaker"),
        ordered_text("word", "word_idx", " ").alias("text"),
    ).withColumn("turn_idx", (F.col("turn") - 1).cast("int")).drop("turn")


def tokens_to_words(tokens: DataFrame) -> DataFrame:
    """Words of a token stream (meeting_id, tok_idx, tok, ts).

    A token with a leading blank mark opens a word. Punctuation goes to the last completed word, not to the open one,
    and sets that word's end; punctuation before any completed word is lost.
    """
    punct = F.col("tok").isin(*PUNCTUATION_TOKENS)
    spoken = ~punct & ~F.col("tok").isin(" ", "▁")
    marked = spoken & (F.col("tok").startswith(" ") | F.col("tok").startswith("▁"))
    key, order = ["meeting_id"], ["tok_idx"]
    given = cut_lineage(tokens.select("meeting_id", "tok_idx", "tok", "ts").filter("meeting_id IS NOT NULL"))
    tasks = tasks_for(given)
    # a marked token opens a word, and so does the first spoken token of the meeting, marked or not
    specs = {"_marks": ("sum", marked.cast("int")), "_bare": ("first", F.when(spoken, (~marked).cast("int")))}
    placed = cut_lineage(scan(given, key, order, by_index("tok_idx"), specs, tasks=tasks))
    # a word is completed by the next opener, so punctuation seen while word w is open belongs to word w - 1
    w = F.col("_marks") + F.coalesce("_bare", F.lit(0))
    piece = F.when(marked, F.ltrim(F.col("tok"), F.lit(WORD_MARKS))).when(spoken, F.col("tok"))
    parts = placed.select(
        "meeting_id", "tok_idx", "ts", F.when(punct, w - 1).otherwise(w).alias("w"), piece.alias("piece"),
        F.when(punct, F.col("tok")).alias("mark"), F.lit(None).cast("double").alias("final_ts"),
    ).filter("w > 0 AND (piece IS NOT NULL OR mark IS NOT NULL)")
    # a row past the last word tells all words of the meeting when its last token was
    final = placed.groupBy("meeting_id").agg(F.max_by("ts", "tok_idx").alias("final_ts")).withColumn("w", F.lit(PAST_WORDS))
    dealt = parts.unionByName(final, allowMissingColumns=True).withColumn(BUCKET, by_index("w")).repartition(tasks, *key, BUCKET)
    at_piece, at_mark = (F.when(F.col(c).isNotNull(), F.col("tok_idx")) for c in ("piece", "mark"))
    words = dealt.groupBy(*key, BUCKET, "w").agg(
        ordered_text("piece", "tok_idx", "").alias("word"), F.min_by("ts", at_piece).alias("start"),
        ordered_text("mark", "tok_idx", "").alias("marks"), F.max_by("ts", at_mark).alias("mark_ts"),
        F.max("final_ts").alias("final_ts"),
    )
    seen = scan(words, key, ["w"], None, {"next_start": ("lead", "start"), "end_ts": ("next", "final_ts")}, keep=True)
    tail = F.lit(TOKEN_TAIL_S)
    end = F.coalesce(F.col("mark_ts") + tail, F.col("next_start"), F.col("end_ts") + tail)
    return seen.filter(F.col("w") < PAST_WORDS).select(
        "meeting_id",
        (F.col("w") - 1).cast("int").alias("word_idx"),
        F.concat("word", F.coalesce("marks", F.lit(""))).alias("word"),
        "start",
        end.alias("end"),
    )


def hard_runs(words: DataFrame) -> DataFrame:
    """Runs between speaker changes and silences; a turn never crosses one."""
    return islands(
        words, ["meeting_id"], ["word_idx"], by_time("start"), ["speaker", "start", "end"],
        lambda cur, prev: ~cur("speaker").eqNullSafe(prev("speaker")) | ((cur("start") - prev("end")) > SILENCE_GAP_S),
        "run",
    )


def ends_sentence(words: np.ndarray) -> np.ndarray:
    return np.array([bool(w) and w.rstrip().endswith(SENTENCE_ENDERS) for w in words], dtype=bool)


def turn_cuts(start: np.ndarray, end: np.ndarray, final: np.ndarray) -> list[int]:
    """Where turns end in a run of words, as the positions behind their last words; the words behind the last cut are open.

    A word asks for a least length of the turn, a short one if it ends a sentence, and the first word past the opening one
    that finds it reached ends the turn. No turn needs a look at more than ``MAX_TURN_WORDS`` words.
    """
    asks = np.where(final, MIN_TURN_S, MAX_TURN_S)
    cuts, a = [], 0
    while a < len(start):
        b = a + MAX_TURN_WORDS
        reached = np.flatnonzero(end[a + 1 : b] - start[a] >= asks[a + 1 : b])
        a = a + 2 + int(reached[0]) if reached.size else b
        if a <= len(start):
            cuts.append(a)
    return cuts


class TurnParts:
    """Number of the open turn within a run, and its words. Takes (word_idx, word, start, end); gives (word_idx, part)."""

    def __init__(self) -> None:
        self.part, self.open = 0, [np.zeros(0), np.zeros(0), np.zeros(0, dtype=bool)]

    def feed(self, rows: dict) -> list[tuple]:
        held = len(self.open[0])
        new = rows["start"].astype(float), rows["end"].astype(float), ends_sentence(rows["word"])
        words = [np.concatenate(x) for x in zip(self.open, new)]
        cuts = turn_cuts(*words)
        parts = self.part + np.searchsorted(cuts, np.arange(held, len(words[0])), side="right")
        self.part, self.open = self.part + len(cuts), [x[cuts[-1] if cuts else 0 :] for x in words]
        return list(zip(rows["word_idx"].tolist(), parts.tolist()))

    def close(self) -> list[tuple]:
        return []


def turn_builder(words: DataFrame) -> DataFrame:
    """Turns of a word stream: hard ends at speaker changes and silences, soft ends inside a run."""
    runs = hard_runs(words)
    numbered = block_pass(
        runs, ["meeting_id", "run"], ["word_idx"], ["word_idx", "word", "start", "end"], TurnParts,
        "meeting_id string, run long, word_idx long, part int",
    )
    joined = words.join(numbered, ["meeting_id", "word_idx"])
    turns = joined.groupBy("meeting_id", "run", "part").agg(
        F.min_by("start", "word_idx").alias("start"),
        F.max_by("end", "word_idx").alias("end"),
        F.first("speaker").alias("speaker"),
        ordered_text("word", "word_idx", " ").alias("text"),
    )
    return turns.withColumn("text", text.strip(F.col("text"))).filter("text <> ''").drop("run", "part")


def end_of_turn(turns: DataFrame) -> DataFrame:
    """Final flag, or a speaker other than the known previous one."""
    seen = scan(turns, ["meeting_id"], ["seg_idx"], by_index("seg_idx"), {"prev": ("lag", F.col("speaker"))})
    changed = F.col("prev").isNotNull() & ~F.col("speaker").eqNullSafe(F.col("prev"))
    return seen.withColumn("end_of_turn", F.col("is_final") | changed).drop("prev")


def teams_turns(runs: DataFrame) -> DataFrame:
    """Turns of a run table (meeting_id, para_idx, run_idx, is_bold, text, is_break).

    Per paragraph: the first bold run with text is the speaker, the run after it must be a timestamp, breaks cut the
    rest into sentences. Paragraphs missing any of the three are dropped.
    """
    key = ["meeting_id", "para_idx"]
    spoken = runs.withColumn("_text", text.strip(F.col("text")))
    named = spoken.filter("NOT is_break AND is_bold AND _text <> ''").groupBy(*key).agg(
        F.min("run_idx").alias("_at"), F.min_by("_text", "run_idx").alias("speaker")
    )
    after = spoken.join(named, key).filter("run_idx > _at")
    stamp = after.filter("NOT is_break").groupBy(*key).agg(
        F.min("run_idx").alias("_ts_at"), F.min_by("_text", "run_idx").alias("_raw")
    ).withColumn("ts", text.teams_timestamp(F.col("_raw"))).filter("ts IS NOT NULL")
    body = after.join(stamp.select(*key, "_ts_at", "ts"), key).filter("run_idx > _ts_at")
    lined = scan(body, key, ["run_idx"], by_index("run_idx"), {"_line": ("sum", F.col("is_break").cast("int"))})
    sentences = lined.filter("NOT is_break").groupBy(*key, "speaker", "ts", "_line").agg(
        text.strip(ordered_text("text", "run_idx", "")).alias("s")
    )
    return sentences.filter("s <> ''").groupBy(*key, "ts", "speaker").agg(ordered_text("s", "_line", " ").alias("text"))
