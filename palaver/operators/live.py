"""Rules of the live path, worked out block by block.

A rule is the state of one key. ``feed`` takes the next rows of the key as arrays by column name and returns what they
settle; ``close`` returns what the end of the key settles. The batch twin feeds the sorted blocks of ``block_pass``, the
stream its micro-batches, and the result does not depend on where the blocks end.
"""

from __future__ import annotations

import math
from collections import deque
from itertools import pairwise

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.functions import text
from palaver.operators.transcripts import SILENCE_GAP_S, ends_sentence, turn_cuts
from palaver.plans.scans import block_pass, by_index, islands

# --- fixed values -----------------------------------------------------------------------------------------------
COOLDOWN_S, MAX_GAP_S = 6.0, 120.0
MAX_SUGGESTIONS, REMEMBERED_GROUPS = 3, 4
CHUNK_WINDOW, CHUNK_SIGMA, CHUNK_ROLLING, CHUNK_K, CHUNK_DELAY = 3, 2.0, 20, 2.0, 5
CHUNK_MIN_TURNS, CHUNK_MAX_CHARS, LINE_EXTRA = 10, 15000, 4
PENDING = ("running", "queued", "pending")
# ----------------------------------------------------------------------------------------------------------------

SEARCH_ROWS = 256


def behind(held: dict | None, rows: dict) -> dict:
    """``rows`` with the rows still held in front."""
    return rows if held is None else {c: np.concatenate([held[c], rows[c]]) for c in rows}


# --- turns ------------------------------------------------------------------------------------------------------


class Turns:
    """The words of the open turn, fewer than ``MAX_TURN_WORDS``.

    Takes (word, start, end, speaker); gives (start, end, speaker, text). A block is cut where the speaker changes or is
    silent, each piece by ``turn_cuts``; what lies behind the last cut stays open.
    """

    def __init__(self) -> None:
        self.open: dict | None = None

    def feed(self, rows: dict) -> list[tuple]:
        rows = behind(self.open, rows)
        speaker, start, end = rows["speaker"], rows["start"].astype(float), rows["end"].astype(float)
        final = ends_sentence(rows["word"])
        breaks = np.flatnonzero((speaker[1:] != speaker[:-1]) | (start[1:] - end[:-1] > SILENCE_GAP_S)) + 1
        cuts = {*breaks.tolist()}
        for a, b in pairwise([0, *breaks.tolist(), len(start)]):
            cuts.update(a + c for c in turn_cuts(start[a:b], end[a:b], final[a:b]))
        edges = [0, *sorted(cuts)]
        self.open = {c: v[edges[-1] :] for c, v in rows.items()}
        return [r for a, b in pairwise(edges) for r in _turn(rows, a, b)]

    def close(self) -> list[tuple]:
        return [] if self.open is None or not len(self.open["word"]) else _turn(self.open, 0, len(self.open["word"]))


def _turn(rows: dict, a: int, b: int) -> list[tuple]:
    said = " ".join(rows["word"][a:b]).strip()
    return [(rows["start"][a], rows["end"][b - 1], rows["speaker"][a], said)] if said else []


# --- trigger ----------------------------------------------------------------------------------------------------


class Trigger:
    """Time of the last advice call and the speaker heard last.

    Takes (turn_idx, now, speaker, is_other, final); gives (turn_idx, fired). Each turn has a time that must have passed
    since the last call, the cooldown for a finished turn of somebody else and the longest gap for any other, so the next
    call is the first turn that reaches its own.
    """

    def __init__(self, since: float = 0.0) -> None:
        self.since, self.speaker = since, None

    def feed(self, rows: dict) -> list[tuple]:
        now, speaker = rows["now"].astype(float), rows["speaker"].astype(object)
        before = np.concatenate([np.array([self.speaker], dtype=object), speaker[:-1]])
        other_voice = np.array([b is not None for b in before]) & (before != speaker)
        invites = rows["is_other"].astype(bool) & (rows["final"].astype(bool) | other_voice)
        wait = np.where(invites, COOLDOWN_S, MAX_GAP_S)
        fired = np.zeros(len(now), dtype=bool)
        lo = 0
        while lo < len(now):
            hits = np.flatnonzero(now[lo : lo + SEARCH_ROWS] - self.since >= wait[lo : lo + SEARCH_ROWS])
            if hits.size:
                lo += int(hits[0])
                fired[lo], self.since = True, float(now[lo])
                lo += 1
            else:
                lo += SEARCH_ROWS
        self.speaker = speaker[-1]
        return list(zip(rows["turn_idx"].tolist(), fired.tolist()))

    def close(self) -> list[tuple]:
        return []


class TriggerAfterPause(Trigger):
    """The rule for one run between long pauses; any run but the first opens with a call."""

    def __init__(self) -> None:
        super().__init__(math.nan)

    def feed(self, rows: dict) -> list[tuple]:
        if math.isnan(self.since):
            self.since = 0.0 if rows["run_no"][0] == 1 else -math.inf
        return super().feed(rows)


def live_trigger(turns: DataFrame) -> DataFrame:
    """Which turns (meeting_id, turn_idx, now, speaker, is_other, final) start an advice call.

    A pause of ``MAX_GAP_S`` between two turns always fires, whatever was fired before, so the rule runs over the runs
    between such pauses.
    """
    runs = islands(
        turns, ["meeting_id"], ["turn_idx"], by_index("turn_idx"), ["now"],
        lambda cur, prev: cur("now") - prev("now") >= MAX_GAP_S, "run",
    )
    out = block_pass(
        runs.withColumn("run_no", F.col("run")), ["meeting_id", "run"], ["turn_idx"],
        ["turn_idx", "now", "speaker", "is_other", "final", "run_no"], TriggerAfterPause,
        "meeting_id string, run long, turn_idx int, fired boolean",
    )
    return out.drop("run")


# --- suggestions ------------------------------------------------------------------------------------------------


def named_items(groups: DataFrame) -> DataFrame:
    """``items`` without outer blanks, empty ones and repeats within the group, and the ``names`` they are compared by."""
    items = F.filter(F.transform(F.coalesce("items", F.array().cast("array<string>")), lambda s: text.strip(s)), lambda s: s != "")
    trimmed = groups.withColumn("items", items).withColumn("names", F.transform("items", F.lower))
    new = trimmed.withColumn("items", F.filter("items", lambda s, i: F.array_position("names", F.lower(s)) == i + 1))
    return new.withColumn("names", F.transform("items", F.lower))


class Suggestions:
    """Names of the last groups of which something was shown.

    Takes (ts, items, names) of ``named_items``; gives (ts, pos, item) for the first items not shown in those groups.
    """

    def __init__(self) -> None:
        self.shown: deque[set[str]] = deque(maxlen=REMEMBERED_GROUPS)

    def feed(self, rows: dict) -> list[tuple]:
        out: list[tuple] = []
        for ts, items, names in zip(rows["ts"], rows["items"], rows["names"]):
            hidden = set().union(*self.shown)
            new = [i for i, name in enumerate(names) if name not in hidden][:MAX_SUGGESTIONS]
            if new:
                self.shown.append({names[i] for i in new})
                out += [(ts, pos, items[i]) for pos, i in enumerate(new)]
        return out

    def close(self) -> list[tuple]:
        return []


def suggestion_dedup(groups: DataFrame) -> DataFrame:
    return block_pass(
        named_items(groups), ["meeting_id"], ["ts"], ["ts", "items", "names"], Suggestions,
        "meeting_id string, ts double, pos int, item string",
    )


# --- topic chunks -----------------------------------------------------------------------------------------------


def similarity_curve(said: np.ndarray, embedding: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed similarities of neighbouring windows of some turns, and the turn with which each value is known.

    A window is known by the vector of its last turn. One without text has no value and passes on the vector before it;
    at the beginning it passes on none, to which the next window has similarity 0.
    """
    none = np.zeros(0, dtype=int), np.zeros(0)
    if len(said) < CHUNK_WINDOW:
        return none
    spoken = sliding_window_view(np.array([bool(s and s.strip()) for s in said]), CHUNK_WINDOW).any(axis=1)
    known = np.flatnonzero(spoken) + CHUNK_WINDOW - 1
    vecs = [np.asarray(embedding[i], dtype=np.float64) for i in known]
    raw = [float(a @ b) if a.shape == b.shape else 0.0 for a, b in pairwise(vecs)]
    if len(known) and not spoken[0]:
        raw = [0.0, *raw]
    if not raw:
        return none
    weights = np.exp(-0.5 * (np.arange(int(2 * CHUNK_SIGMA) + 1) / CHUNK_SIGMA) ** 2)
    n = len(raw)
    smooth = np.convolve(raw, weights)[:n] / np.convolve(np.ones(n), weights)[:n]
    smooth[:2] = raw[:2]
    return known[-n:], smooth


def valleys(known: np.ndarray, smooth: np.ndarray, k_sigma: float) -> dict[str, np.ndarray]:
    """Values below the rolling band: ``at`` (turn of the boundary), ``value``, the turn that shows it (``seen``), the
    turn that settles it (``due``, past the end if that turn has not come) and whether it stood (``stood``)."""
    if len(smooth) < CHUNK_ROLLING:
        low = np.zeros(0, dtype=int)
    else:
        recent = sliding_window_view(smooth, CHUNK_ROLLING)
        low = np.flatnonzero(smooth[CHUNK_ROLLING - 1 :] < recent.mean(axis=1) - k_sigma * recent.std(axis=1)) + CHUNK_ROLLING - 1
    settled = np.concatenate([known[CHUNK_DELAY:], np.full(CHUNK_DELAY, np.iinfo(np.int64).max)])
    after = np.concatenate([smooth, np.full(CHUNK_DELAY + 1, np.inf)])
    lowest = after[low[:, None] + np.arange(2, CHUNK_DELAY + 1)].min(axis=1) if low.size else np.zeros(0)
    return {"at": low + 1, "value": smooth[low], "seen": known[low], "due": settled[low], "stood": lowest >= smooth[low]}


class TopicChunks:
    """Turns since the last boundary, as many as the size cap lets through.

    Takes (start, end, speaker, text, embedding); gives (chunk_id, start_time, end_time, n_turns, text). The curve over
    the held turns tells with which turn each valley is settled, and the sums of their lengths with which turn the cap is
    reached. The earlier of the two cuts, a valley first on the same turn; then the turns behind the cut are the held
    ones. Valleys of the new curve count from the turn after the cut was made (``since``), the cap from ``filled``.
    """

    def __init__(self, k_sigma: float = CHUNK_K, max_chars: int = CHUNK_MAX_CHARS, min_turns: int = CHUNK_MIN_TURNS) -> None:
        self.k_sigma, self.max_chars, self.min_turns = k_sigma, max_chars, min_turns
        self.held: dict | None = None
        self.since = self.filled = self.emitted = 0

    def _valleys(self, turns: dict) -> dict[str, np.ndarray]:
        found = valleys(*similarity_curve(turns["text"], turns["embedding"]), self.k_sigma)
        found["due"] = np.maximum(found["due"], self.since)
        long_enough = found["at"] + 1 >= self.min_turns
        return {c: v[long_enough] for c, v in found.items()}

    def _pending(self, found: dict[str, np.ndarray], now: int) -> np.ndarray:
        """Valleys seen by turn ``now`` that it does not settle."""
        return np.flatnonzero((found["seen"] <= now) & (found["due"] > now) & (now >= self.since))

    def _cut(self, turns: dict, ends: list[int]) -> tuple[dict, list[tuple]]:
        out = []
        for a, b in pairwise([0, *(e + 1 for e in ends)]):
            lines = [f"[{s}]: {t or ''}" for s, t in zip(turns["speaker"][a:b], turns["text"][a:b])]
            out.append((self.emitted, turns["start"][a], turns["end"][b - 1], b - a, "\n".join(lines)))
            self.emitted += 1
        return {c: v[ends[-1] + 1 :] for c, v in turns.items()}, out

    def feed(self, rows: dict) -> list[tuple]:
        turns, out = behind(self.held, rows), []
        while n := len(turns["text"]):
            size = np.cumsum([len(t or "") + len(s or "") + LINE_EXTRA for t, s in zip(turns["text"], turns["speaker"])])
            full = max(int(np.searchsorted(size, self.max_chars)), self.filled)
            found = self._valleys({c: v[: full + 1] for c, v in turns.items()})
            stood = np.flatnonzero(found["stood"] & (found["due"] < n))
            settled = int(found["due"][stood].min()) if stood.size else n
            now = min(settled, full)
            if now >= n:
                break
            if settled <= full:
                ends = found["at"][stood][found["due"][stood] == now].tolist()
            else:
                open_ = self._pending(found, now)
                ends = [int(found["at"][open_[np.argmin(found["value"][open_])]])] if open_.size else [now]
            turns, rows_out = self._cut(turns, ends)
            out += rows_out
            self.since = now - ends[-1]
            self.filled = self.since - 1 if settled <= full else self.since
        self.held = turns
        return out

    def close(self) -> list[tuple]:
        """The first valley not settled yet cuts once more; the rest is the last chunk."""
        if self.held is None or not (n := len(self.held["text"])):
            return []
        found = self._valleys(self.held)
        ends = [int(found["at"][i]) for i in self._pending(found, n - 1)[:1]]
        return self._cut(self.held, ends if ends == [n - 1] else [*ends, n - 1])[1]


CHUNK_COLUMNS = ["start", "end", "speaker", "text", "embedding"]


def topic_chunker(turns: DataFrame, k_sigma: float = CHUNK_K, max_chars: int = CHUNK_MAX_CHARS, min_turns: int = CHUNK_MIN_TURNS) -> DataFrame:
    """Batch twin of the live chunker on (meeting_id, seg_idx, start, end, speaker, text, embedding)."""
    return block_pass(
        turns, ["meeting_id"], ["seg_idx"], CHUNK_COLUMNS, lambda: TopicChunks(k_sigma, max_chars, min_turns),
        "meeting_id string, chunk_id int, start_time double, end_time double, n_turns int, text string",
    )


# --- job status and provisional speakers ------------------------------------------------------------------------


class Statuses:
    """Status before, and whether the one notice was given. Takes (t, status); gives (t)."""

    def __init__(self) -> None:
        self.before, self.told = None, False

    def feed(self, rows: dict) -> list[tuple]:
        status = rows["status"].tolist()
        done = [t for t, a, b in zip(rows["t"], [self.before, *status], status) if b == "done" and a in PENDING]
        self.before, first = status[-1], [] if self.told else done[:1]
        self.told = self.told or bool(first)
        return [(t,) for t in first]

    def close(self) -> list[tuple]:
        return []


class Labels:
    """Vectors that can still be nearest to a word: the latest at or before the last word, and later ones.

    Takes (kind, t, word_idx, label); a vector is remembered, a word gets the nearest label, the earlier on a tie.
    """

    def __init__(self) -> None:
        self.t, self.label = np.zeros(0), np.zeros(0, dtype=int)

    def feed(self, rows: dict) -> list[tuple]:
        out = []
        for kind, t, word_idx, label in zip(rows["kind"], rows["t"], rows["word_idx"], rows["label"]):
            if kind == "vector":
                self.t, self.label = np.append(self.t, t), np.append(self.label, int(label))
                continue
            near = f"{self.label[np.abs(self.t - t).argmin()]:02d}" if len(self.t) else "?"
            out.append((int(word_idx), f"SPEAKER_{near}"))
            passed = np.flatnonzero(self.t <= t)
            if passed.size:
                self.t, self.label = self.t[passed[-1] :], self.label[passed[-1] :]
        return out

    def close(self) -> list[tuple]:
        return []
