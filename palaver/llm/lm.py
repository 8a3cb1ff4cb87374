"""Language-model scores by logistic context mixing over bits.

What is scored is the token sequence that the base score counts, written as bytes: lower-cased words with one blank between
them, and an end mark. A byte is eight binary choices, so the model gives every sequence a probability.
Predictors for each choice look up counts under a hash of their context: the last one to five bytes, and the word so far
(of at most five bytes). The logits of the predictors are mixed by weights that a gate selects (how well the two longest contexts are
known), learnt online, and the mix is refined by an adaptive table of what happened at such mixed predictions.

What is gathered from the corpus: the count of every word and of every run of six bytes in the training texts, summed per task
and then by key. Predictor tables are added up from the run counts by a fixed number of tasks and have a fixed size, so they
go to every task. Mixer and refinement learn from all runs with their counts, each without its own contribution; several
tasks learn online from their share and the results are averaged, weighted by what they have seen.

The base score needs the exact count of every word of every text. Counts of the ``HOT_WORDS`` commonest words (fixed bound) go to every
task; the rarer words of a text are joined with the counts by key.

Words and runs are known by 64-bit hashes. Defined results: a null text is empty: one end token; repeated rows count as often
as they occur; a null id is training text; without training rows all counts are 0; only id and text are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.llm import columns as C
from palaver.llm.shared import written
from palaver.llm.textbatch import LOWER, WORD, mix, pieces, span_hashes, words

WORD_KIND, RUN_KIND = 0, 1
END_WORD = 1  # key of the end token; words have other hashes, as good as surely
END_BYTE = 0xFF  # no byte of UTF-8
CONTEXT = 5  # bytes before the one to come
HOT_WORDS = 1 << 18
FLUSH = 1_500_000  # distinct keys that a task holds
#: Predictors: bits of their table; the context is cut out of the last bytes.
TABLES = ((16, 1), (18, 2), (19, 3), (20, 4), (20, 5), (20, 0))  # (bits of the table, bytes of context; 0: the word so far)
SIZES = [1 << b for b, _ in TABLES]
BASES = np.concatenate([[0], np.cumsum(SIZES)])
GATES, STEPS = 64, 33
BUILD_TASKS, SEGMENTS = 8, 64
SMOOTH, RATE, EPOCHS = 0.4, 0.3, 2


def _held_out(id_column: str, remainder: int = 1):
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 5 == remainder, F.lit(False))


def token_text(data: np.ndarray, offsets: np.ndarray, ends: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of each text as bytes: lower-cased words with one blank between them."""
    keep = WORD[data]
    between = ends[:-1][owner[1:] == owner[:-1]]
    keep[between] = True
    lowered = LOWER[data]
    lowered[between] = 0x20
    return lowered[keep], np.append(0, np.cumsum(keep))[offsets]


def runs_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every byte of every text, the end mark included, with the five bytes before it, as one number; and text offsets.
    Before its start a text has zero bytes."""
    n = len(offsets) - 1
    flat = np.insert(data, offsets[1:], END_BYTE)
    ends = offsets[1:] + np.arange(1, n + 1)
    starts = np.append(0, ends[:-1])
    out = flat.astype(np.uint64)
    for back in range(1, CONTEXT + 1):
        out[back:] |= flat[:-back].astype(np.uint64) << np.uint64(8 * back)
    for j in range(CONTEXT):  # the first bytes of a text do not see the text before
        at = starts + j
        at = at[at < ends]
        out[at] &= np.uint64((1 << 8 * (j + 1)) - 1)
    return out, np.append(0, ends)


def _counted(keys: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if weight is None:
        keys = np.sort(keys)
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        return keys[first], np.diff(np.append(first, len(keys)))
    order = np.argsort(keys, kind="stable")
    keys, weight = keys[order], weight[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(weight, first) if len(first) else weight


class Tally:
    """Counts of keys in one task, handed over when there are many."""

    def __init__(self, kind: int):
        self.kind, self.parts, self.size = kind, [], 0

    def add(self, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append(_counted(keys))
        self.size += len(self.parts[-1][0])
        if self.size > FLUSH:
            if len(self.parts) > 1:
                self.parts = [_counted(*(np.concatenate(x) for x in zip(*self.parts)))]
                self.size = len(self.parts[0][0])
            if self.size > FLUSH // 2:
                yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            keys, n = _counted(*(np.concatenate(x) for x in zip(*self.parts)))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), self.kind, dtype="i1")), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["kind", "key", "n"])
        self.parts, self.size = [], 0


def corpus_counts(train: DataFrame, text: str) -> DataFrame:
    """(kind, key, n) of words and byte runs in all texts of ``train``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, seen = Tally(WORD_KIND), Tally(RUN_KIND)
        for batch in batches:
            for lo, hi, data, offsets in pieces(batch.column(text)):
                starts, ends, owner = words(data, offsets)
                found = span_hashes(LOWER[data], starts, ends)
                yield from vocabulary.add(np.append(found, np.full(hi - lo, END_WORD, dtype=np.uint64)))
                yield from seen.add(runs_of(*token_text(data, offsets, ends, owner))[0])
        yield from vocabulary.flush()
        yield from seen.flush()

    parts = train.select(text).mapInArrow(run, "kind byte, key long, n long")
    return parts.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _contexts(runs: np.ndarray) -> list[np.ndarray]:
    """Hash of each predictor's context."""
    before = runs >> np.uint64(8)
    out = []
    for t, (_, size) in enumerate(TABLES):
        if size:
            part = before & np.uint64((1 << 8 * size) - 1)
        else:  # bytes behind the last blank
            part, open_ = np.zeros_like(before), np.ones(len(before), dtype=bool)
            for j in range(CONTEXT):
                byte = (before >> np.uint64(8 * j)) & np.uint64(255)
                open_ &= byte > 0x20
                part |= np.where(open_, byte << np.uint64(8 * j), np.uint64(0))
        out.append(part if size == 1 else mix(part * np.uint64(2 * t + 3) + np.uint64(t)))
    return out


def _slots(t: int, context: np.ndarray, node: np.ndarray) -> np.ndarray:
    bits, size = TABLES[t]
    if size == 1:
        return ((context << np.uint64(8)) | node.astype(np.uint64)).astype(np.int64) + BASES[t]
    return ((context + node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD1B54A32D192ED03) >> np.uint64(64 - bits)).astype(np.int64) + BASES[t]


def _bits(runs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Node (the bits of the byte so far, with a leading 1) and next bit, from the highest."""
    byte = (runs & np.uint64(255)).astype(np.int64)
    for k in range(8):
        yield (1 << k) | (byte >> (8 - k)), (byte >> (7 - k)) & 1


class Model:
    """Counts of every slot as a logit and how well it is known, mixing weights, refinement. Fixed size."""

    def __init__(self) -> None:
        self.name = uuid.uuid4().hex
        self.weights = np.full((GATES, len(TABLES)), 1.5 / len(TABLES))
        self.hits = np.tile(1 / (1 + np.exp(-np.linspace(-8, 8, STEPS))), (256, 1)) * 2.0
        self.seen = np.full((256, STEPS), 2.0)
        self.tables: tuple | None = None

    def use(self, counts: tuple[np.ndarray, np.ndarray]) -> None:
        """Make the tables that scoring looks up, from the slot counts; done in each worker, so that only counts are sent."""
        zero, one = (c.astype(np.float32) for c in counts)
        logit = np.log((one + SMOOTH) / (zero + SMOOTH))
        known = np.minimum(np.log2(1 + one + zero), 7).astype(np.uint8)
        self.tables = logit, known, np.log(self.hits / (self.seen - self.hits))

    @staticmethod
    def gate(long: np.ndarray, word: np.ndarray) -> np.ndarray:
        return long.astype(np.int64) * 8 + word

    def refined(self, table: np.ndarray, node: np.ndarray, x: np.ndarray) -> np.ndarray:
        at = np.clip((x + 8) * ((STEPS - 1) / 16), 0, STEPS - 1.001)
        low = at.astype(np.int64)
        part = at - low
        return 0.5 * (x + table[node, low] * (1 - part) + table[node, low + 1] * part)

    def log2(self, runs: np.ndarray) -> np.ndarray:
        """log2 of the probability of each run's last byte after the bytes before it."""
        logit, known, table = self.tables
        contexts = _contexts(runs)
        out = np.zeros(len(runs))
        for node, bit in _bits(runs):
            slots = [_slots(t, c, node) for t, c in enumerate(contexts)]
            w = self.weights[self.gate(known[slots[-2]], known[slots[-1]])]
            x = sum(w[:, t] * logit[s] for t, s in enumerate(slots))
            x = self.refined(table, node, x)
            out -= np.logaddexp(0, np.where(bit == 1, -x, x))
        return out / np.log(2)


def build(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Slot counts of zeros and ones over all byte runs, added up by a fixed number of tasks in double precision and sent in
    single; counts over 60,000 keep their ratio."""
    total = int(BASES[-1])
    bounds = np.linspace(0, total, SEGMENTS + 1).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((2, total), dtype=np.float64)
        for batch in batches:
            keys, n = (batch.column(c).to_numpy() for c in ("key", "n"))
            runs = keys.view(np.uint64)
            for t, context in enumerate(_contexts(runs)):
                for node, bit in _bits(runs):
                    slot = _slots(t, context, node)
                    base, size = BASES[t], SIZES[t]
                    for b in (0, 1):
                        own = bit == b
                        np.add.at(table[b, base : base + size], slot[own] - base, n[own].astype(np.float64))
        for i in range(SEGMENTS):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([table[:, bounds[i] : bounds[i + 1]].astype(np.float32).tobytes()], pa.binary())], ["i", "part"])

    def add(t: pa.Table) -> pa.Table:
        found = np.sum([np.frombuffer(x, dtype=np.float32) for x in t.column("part").to_pylist()], axis=0, dtype=np.float64)
        return pa.table({"i": t.column("i").slice(0, 1), "part": pa.array([found.astype(np.float32).tobytes()], pa.binary())})

    parts = counts.filter(F.col("kind") == RUN_KIND).select("key", "n").coalesce(BUILD_TASKS).mapInArrow(run, "i int, part binary")
    rows = sorted(parts.groupBy("i").applyInArrow(add, "i int, part binary").collect())  # a table of fixed size
    table = np.concatenate([np.frombuffer(r["part"], dtype=np.float32).reshape(2, -1) for r in rows], axis=1) if rows else np.zeros((2, total), np.float64)
    scale = np.maximum(1, table.max(axis=0) / 60_000)
    return tuple(np.ceil(t / scale).astype(np.uint16) for t in table)


def learn(counts: DataFrame, model: Model, shared) -> None:
    """Mixing weights, then the refinement, from all byte runs. Each run is predicted from what the others left. ``shared``
    is the broadcast of the slot counts."""

    def inputs(tables: tuple, runs: np.ndarray, n: np.ndarray) -> Iterator[tuple]:
        contexts = _contexts(runs)
        for node, bit in _bits(runs):
            slots = [_slots(t, c, node) for t, c in enumerate(contexts)]
            one = np.stack([tables[1][s] for s in slots]).astype(np.float32) - (bit == 1)
            zero = np.stack([tables[0][s] for s in slots]).astype(np.float32) - (bit == 0)
            one, zero = np.maximum(one, 0), np.maximum(zero, 0)
            logit = np.log((one + SMOOTH) / (zero + SMOOTH))
            known = np.minimum(np.log2(1 + one[-2:] + zero[-2:]), 7).astype(np.int64)
            yield node, bit, logit, Model.gate(known[0], known[1]), n.astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, weights, load = shared.value, start.copy(), np.zeros(GATES)
        slope = np.ones((GATES, len(TABLES)))
        hits, seen = np.zeros((256, STEPS)), np.zeros((256, STEPS))
        for batch in batches:
            keys, n = (batch.column(c).to_numpy() for c in ("key", "n"))
            for lo in range(0, len(keys), 4096):
                runs, times = keys[lo : lo + 4096].view(np.uint64), n[lo : lo + 4096]
                for node, bit, logit, gate, weight in inputs(tables, runs, times):
                    x = np.einsum("tn,nt->n", logit, weights[gate])
                    wrong = (bit - 1 / (1 + np.exp(-np.clip(x, -30, 30)))) * weight
                    step = np.zeros((GATES, len(TABLES)))
                    for t in range(len(TABLES)):
                        step[:, t] = np.bincount(gate, wrong * logit[t], GATES)
                    slope += step**2
                    weights += RATE * step / np.sqrt(slope)
                    load += np.bincount(gate, weight, GATES)
                    at = np.clip(np.rint((np.clip(x, -8, 8) + 8) * ((STEPS - 1) / 16)), 0, STEPS - 1).astype(np.int64)
                    np.add.at(hits, (node, at), weight * bit)
                    np.add.at(seen, (node, at), weight)
        rows = [np.concatenate([(weights * load[:, None]).ravel(), load, hits.ravel(), seen.ravel()]).tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array(rows, pa.binary())], ["i", "part"])

    source = counts.filter(F.col("kind") == RUN_KIND).select("key", "n").coalesce(BUILD_TASKS)
    start = model.weights
    for _ in range(EPOCHS):
        # one row of fixed size per building task
        rows = [np.frombuffer(r["part"]) for r in source.mapInArrow(run, "i int, part binary").collect()]
        if not rows:
            break
        total = np.sum(rows, axis=0)
        k = GATES * len(TABLES)
        load = total[k : k + GATES]
        some = load > 0
        model.weights[some] = (total[:k].reshape(GATES, -1)[some]) / load[some][:, None]
        found = total[k + GATES :].reshape(2, 256, STEPS)
        prior = 1 / (1 + np.exp(-np.linspace(-8, 8, STEPS)))
        model.hits, model.seen = found[0] + 4 * prior, found[1] + 4.0
        start = model.weights


class Scored:
    """log2 of byte runs, with a table of runs met before."""

    BITS = 21

    def __init__(self, model: Model):
        self.model = model
        self.keys = np.full(1 << self.BITS, np.uint64(2**64 - 1))
        self.values = np.zeros(1 << self.BITS, dtype=np.float32)

    def of(self, runs: np.ndarray) -> np.ndarray:
        spot = (runs * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.BITS)).astype(np.int64)
        out = self.values[spot].astype(np.float64)
        missing = np.flatnonzero(self.keys[spot] != runs)
        if len(missing):
            new, back = np.unique(runs[missing], return_inverse=True)
            found = np.concatenate([self.model.log2(new[i : i + 65536]) for i in range(0, len(new), 65536)]).astype(np.float32)
            out[missing] = found[back]
            at = (new * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.BITS)).astype(np.int64)
            self.keys[at], self.values[at] = new, found
        return out


_latest: dict[str, Scored] = {}


def _worker(model: Model, counts) -> Scored:
    """The scorer of this Python worker; the one of another model is given up."""
    if model.name not in _latest:
        _latest.clear()
        model.use(counts.value)
        _latest[model.name] = Scored(model)
    return _latest[model.name]


def hot_words(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The commonest words, at most ``HOT_WORDS``: those whose count reaches a power of two that few enough reach."""
    vocabulary = counts.filter(F.col("kind") == WORD_KIND)
    classes = {r["c"]: r["n"] for r in vocabulary.groupBy(F.floor(F.log2("n")).alias("c")).agg(F.count("*").alias("n")).collect()}  # under 64 rows
    least, total = 63, 0
    while least and total + classes.get(least - 1, 0) <= HOT_WORDS:
        least -= 1
        total += classes.get(least, 0)
    rows = vocabulary.filter(F.col("n") >= 2**least).select("key", "n").toArrow()  # bounded by HOT_WORDS
    keys, n = rows.column("key").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order]


def scores(docs: DataFrame, id_column: str = "doc_id", text: str = "text", remainder: int = 1) -> DataFrame:
    """One row per document: ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``, and
    ``bits_per_byte`` of the model."""
    spark = docs.sparkSession
    docs = docs.select(id_column, F.col(text).cast("string").alias("text"))
    counts = written(corpus_counts(docs.filter(~_held_out(id_column, remainder)), "text"), "counts")
    vocabulary = counts.filter(F.col("kind") == WORD_KIND)
    total = vocabulary.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    tokens, types = total["n"] or 0, total["v"]
    model, slots = Model(), spark.sparkContext.broadcast(build(counts))  # fixed size
    learn(counts, model, slots)
    hot = spark.sparkContext.broadcast(hot_words(counts))
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scored = _worker(model, slots)
        keys, n = hot.value
        row = TaskContext.get().partitionId() << 40
        for whole in batches:
            for batch in C.split(iter([whole]), "text"):
                for lo, hi, data, offsets in pieces(batch.column("text")):
                    starts, ends, owner = words(data, offsets)
                    runs, bounds = runs_of(*token_text(data, offsets, ends, owner))
                    bits = np.add.reduceat(scored.of(runs), bounds[:-1])
                    size = hi - lo
                    found = np.append(span_hashes(LOWER[data], starts, ends), np.full(size, END_WORD, dtype=np.uint64))
                    owner = np.append(owner, np.arange(size))
                    at = np.minimum(np.searchsorted(keys, found), max(0, len(keys) - 1))
                    known = keys[at] == found if len(keys) else np.zeros(len(found), dtype=bool)
                    base = np.bincount(owner[known], np.log10(n[at[known]] + 0.5) if known.any() else None, size)
                    rest, rest_owner = found[~known], owner[~known]
                    order = np.argsort(rest_owner, kind="stable")
                    ends_of = np.append(0, np.cumsum(np.bincount(rest_owner, minlength=size))).astype("i4")
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.arange(row, row + size)), batch.column(id_column).slice(lo, size), pa.array(np.bincount(owner, minlength=size).astype(np.int64)),
                            pa.array(np.bincount(owner[known], minlength=size).astype(np.int64)), pa.array(base.astype(np.float64)), pa.array(bits), pa.array(np.diff(bounds)),
                            pa.ListArray.from_arrays(pa.array(ends_of), pa.array(rest[order].view(np.int64))),
                        ],
                        ["row", id_column, "n_tokens", "known", "base", "bits", "n_bytes", "rare"],
                    )
                    row += size

    schema = f"row long, `{id_column}` {kind}, n_tokens long, known long, base double, bits double, n_bytes long, rare array<long>"
    rows = written(docs.mapInArrow(run, schema), "scored")
    rare = rows.filter(F.size("rare") > 0).select("row", F.explode("rare").alias("key")).groupBy("row", "key").agg(F.count("*").alias("times"))
    looked = rare.join(vocabulary.select("key", "n"), "key", "left")
    looked = looked.groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("more"), F.sum(F.when(F.col("n").isNotNull(), F.col("times"))).alias("more_known")
    )
    norm = float(np.log10(tokens + 0.5 * (types + 1)))
    joined = rows.drop("rare").join(looked, "row", "left")
    return joined.select(
        id_column, _held_out(id_column, remainder).alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * norm).alias("base_score"),
        (F.col("bits") * float(np.log10(2))).alias("score"), (-F.col("bits") / F.col("n_bytes")).alias("bits_per_byte"),
    )
