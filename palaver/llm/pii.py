"""Personal data, and the words that give it away.

Four kinds of personal data are found by pattern. The corpus then tells how strongly a word reveals a protected value (its
entity): from all windows of words around an entity and all occurrences of the word, the pointwise mutual information of the
two is set against the entity's own information content. Their ratio is the disclosure: 1 if the word occurs only with
that entity. How often the word's occurrences stand beside the entity is taken at the lower end of its confidence
interval, so every pair is judged, a rare one with less certainty. A word whose disclosure exceeds the threshold is generalised
there, above the higher one removed.

Corpus counts cover all texts. Candidates are screened by a bit table of fixed size, which each task gets whole; what it
lets through is counted exactly, by 64-bit hash.

Defined results: a null text is empty and has no spans; spans are code points, end exclusive; repeated rows get equal
results; an empty table gives an empty result; other columns are kept, output columns replace columns of the same name.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.llm import columns as C
from palaver.llm.shared import tidy, written
from palaver.llm.textbatch import pieces, span_hashes, words

# The kinds and the patterns of the contract. A run of digits or letters can only match from its start.
KINDS = ("email", "ip", "card", "phone", "term")
EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
EMAIL_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
NO_DIGIT = re.compile("[^0-9]")
TERM = re.compile(r"(?<![^\W\d_])[^\W\d_]{2,}(?![^\W\d_])")  # a whole run of letters
BEYOND = re.compile(r"[^\w\x00-\x7f]|(?![0-9])\d")  # beyond ASCII and no part of a word

WINDOW_WORDS, LONG = 5, 4  # a window goes to the fifth word of four letters; shorter ones between belong to it
REACH = 200  # characters within which the words of a window are looked for
Z = 1.645  # one-sided confidence of 95 percent
GENERALISE, REMOVE = 0.9, 0.97
BITS = 22


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end), by kind and start. Per kind leftmost and without overlap; failing matches are dropped."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in EMAIL_LOCAL:
            start -= 1
        if start < at and (m := EMAIL_DOMAIN.match(text, at)):
            out.append((0, start, m.end()))
            last = m.end()
        at = text.find("@", at + 1)
    if DIGIT.search(text):
        out += [(1, *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(digits := NO_DIGIT.sub("", m[0])) <= 19 and _luhn(digits):
                out.append((2, *m.span()))
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(NO_DIGIT.sub("", m[0])) <= 15]
    return out


def _entity(kind: int, value: str) -> str:
    """What is protected: the value without its way of writing."""
    return f"{KINDS[kind]}:{value.lower() if kind < 2 else NO_DIGIT.sub('', value)}"


def _lower(text: str) -> str:
    """Lower case that does not depend on what stands behind a letter."""
    return text.lower().replace("ς", "σ")


def _whole(text: str, low: int, high: int) -> Iterator[re.Match]:
    """Terms that start and end within the bounds; one character more is looked at, so no word is cut."""
    return (m for m in TERM.finditer(text, low, high + 1) if m.end() <= high)


def _window(found: Iterable[re.Match]) -> Iterator[re.Match]:
    long = 0
    for m in found:
        yield m
        long += m.end() - m.start() >= LONG
        if long == WINDOW_WORDS:
            return


def _beside(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[str, str, int, int, int]]:
    """(entity, word, start, end, mentions) of the words near the spans of each entity, personal data left out. A word is
    listed once for an entity; the first one brings the number of mentions."""
    near: dict[str, dict[int, re.Match]] = {}
    mentions: Counter[str] = Counter()
    for kind, start, end in spans:
        left = _window(reversed(list(_whole(text, max(0, start - REACH), start))))
        right = _window(_whole(text, end, end + REACH))
        entity = _entity(kind, text[start:end])
        mentions[entity] += 1
        near.setdefault(entity, {}).update((m.start(), m) for m in itertools.chain(left, right) if not any(s < m.end() and m.start() < e for _, s, e in spans))
    return [(e, _lower(m[0]), m.start(), m.end(), 0 if i else mentions[e]) for e, found in near.items() for i, m in enumerate(found.values())]


SPAN = "array<struct<kind:int,start:int,end:int>>"
BESIDE = "array<struct<entity:string,word:string,start:int,end:int,mentions:int>>"


def _scan(docs: DataFrame, text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, at = TaskContext.get().partitionId() << 40, 0
        span_type = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
        near_type = pa.list_(pa.struct([("entity", pa.string()), ("word", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("mentions", pa.int32())]))
        for batch in C.split(batches, text):
            spans, near = [], []
            for t in C.texts(batch, text):
                found = base_spans(t)
                spans.append([{"kind": k, "start": s, "end": e} for k, s, e in found])
                near.append([dict(zip(("entity", "word", "start", "end", "mentions"), x)) for x in _beside(t, found)] if found else [])
            ids = np.arange(at, at + batch.num_rows) + task
            at += batch.num_rows
            yield C.extend(batch, {"_row": pa.array(ids), "base": pa.array(spans, span_type), "_near": pa.array(near, near_type)})

    return C.map_batches(docs, run, {"_row": "long", "base": SPAN, "_near": BESIDE})


def _word_hashes(found: list[str]) -> np.ndarray:
    data = [w.encode() for w in found]
    flat = np.frombuffer(b"".join(data), dtype=np.uint8)
    ends = np.cumsum([len(w) for w in data])
    return span_hashes(flat, ends - [len(w) for w in data], ends)


def _occurrences(docs: DataFrame, text: str, table: bytes) -> DataFrame:
    """Corpus counts of the words whose bit is set, as ``TERM`` cuts and ``_lower`` writes them, by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(table, dtype=np.uint8))
        keys, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in C.split(batches, text):
            # cut first: lower case may add marks that are no letters
            lowered = pa.array([_lower(BEYOND.sub(" ", t)) for t in C.texts(batch, text)], pa.large_string())
            for _, _, data, offsets in pieces(lowered):
                found = span_hashes(data, *_letter_runs(data, offsets))
                found, times = np.unique(found[bits[(found >> np.uint64(64 - BITS)).astype(np.int64)] > 0], return_counts=True)
                keys, back = np.unique(np.concatenate([keys, found]), return_inverse=True)
                n = np.bincount(back, np.concatenate([n, times]), len(keys)).astype(np.int64)
            if len(keys) > 200_000:
                yield _counted(keys, n)
                keys, n = keys[:0], n[:0]
        yield _counted(keys, n)

    return docs.select(F.col(text)).mapInArrow(tidy(run), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _counted(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["key", "n"])


LETTER = np.zeros(256, dtype=bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _letter_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of letters and of bytes beyond ASCII."""
    shown = np.where(LETTER[data], data, np.uint8(0x20))
    starts, ends, _ = words(shown, offsets)
    return starts, ends


def disclosing(scanned: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """(entity, word, disclosure) of all words beside an entity."""
    near = scanned.filter(F.size("_near") > 0).select(F.explode("_near").alias("x")).select("x.entity", "x.word", "x.mentions")
    pairs = near.groupBy("entity", "word").agg(F.count("*").alias("together"))
    pairs = written(_hashed(pairs), "pairs")
    entities = near.groupBy("entity").agg(F.sum("mentions").alias("mentions"))
    # at most 2^BITS / 8 numbers come here, whatever the corpus
    spot = F.shiftrightunsigned("key", 64 - BITS).cast("int")
    bit = F.expr("shiftright(128, cast(spot & 7 as int))")
    places = pairs.select(spot.alias("spot")).distinct().select(F.shiftright("spot", 3).alias("byte"), bit.alias("bit")).groupBy("byte").agg(F.bit_or("bit").alias("bits")).collect()
    table = np.zeros(1 << (BITS - 3), dtype=np.uint8)
    for r in places:
        table[r["byte"]] = r["bits"]
    if not table.any():  # no word stands beside an entity
        return pairs.select("entity", "word", F.lit(0.0).alias("disclosure"))
    occurs = _occurrences(docs, text, table.tobytes())
    joined = pairs.join(occurs, "key").join(entities, "entity")
    size = docs.select(F.sum(F.length(F.coalesce(F.col(text), F.lit("")))).alias("chars")).first()["chars"] or 1
    words_in_all = max(2.0, size / 6.0)
    p_entity = F.least(F.lit(0.5), F.col("mentions") / words_in_all)
    return joined.select("entity", "word", (F.lit(1.0) - F.log(_at_least(F.col("together"), F.greatest("n", "together"))) / F.log(p_entity)).alias("disclosure"))


def _at_least(hits: Column, n: Column) -> Column:
    """Lower end of Wilson's interval for a share of ``hits`` in ``n``."""
    share, square = hits / n, Z * Z
    return (share + square / (2 * n) - Z * F.sqrt(share * (1 - share) / n + square / (4 * n * n))) / (1 + square / n)


def _hashed(pairs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = _word_hashes(batch.column("word").to_pylist()) if batch.num_rows else np.zeros(0, np.uint64)
            yield C.extend(batch, {"key": pa.array(keys.view(np.int64))})

    return C.map_batches(pairs, run, {"key": "long"})


def find(docs: DataFrame, text: str = "text", keep_text: bool = True, generalise: float = GENERALISE) -> DataFrame:
    """``docs`` with ``base`` (spans by pattern), ``terms`` (spans of disclosing words, with their disclosure)."""
    scanned = _scan(docs, text)
    scanned = written(scanned if keep_text else scanned.drop(text), "scanned")
    strong = disclosing(scanned, docs, text).filter(F.col("disclosure") > generalise)
    spots = scanned.filter(F.size("_near") > 0).select("_row", F.explode("_near").alias("x")).select("_row", "x.entity", "x.word", "x.start", "x.end")
    terms = spots.join(strong, ["entity", "word"]).groupBy("_row", "start", "end").agg(F.max("disclosure").alias("disclosure"))
    terms = terms.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("start", "end", "disclosure"))).alias("terms"))
    empty = F.expr("cast(array() as array<struct<start:int,end:int,disclosure:double>>)")
    # only rows with a word beside an entity are joined; the texts of all others stay where they are
    rows = scanned.drop("terms")
    beside = rows.filter(F.size("_near") > 0).join(terms, "_row", "left").withColumn("terms", F.coalesce("terms", empty))
    return rows.filter(F.size("_near") == 0).withColumn("terms", empty).unionByName(beside).drop("_row", "_near")


def sanitise(docs: DataFrame, text: str = "text", remove: float = REMOVE) -> DataFrame:
    """``docs`` with personal data replaced by its kind, disclosing words by ``[TERM]`` or nothing. A null text stays null."""
    found = find(docs, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.split(batches, text):
            out = []
            for t, base, terms in zip(*(batch.column(n).to_pylist() for n in (text, "base", "terms"))):
                marks = [(x["start"], x["end"], f"[{KINDS[x['kind']].upper()}]") for x in base]
                marks += [(x["start"], x["end"], "" if x["disclosure"] > remove else "[TERM]") for x in terms]
                out.append(t if t is None else replace(t, marks))
            yield C.extend(batch, {text: pa.array(out, pa.string())})

    return C.map_batches(found, run, {text: "string"}).select(*[F.col(f"`{c}`") for c in docs.columns])


def replace(text: str, marks: list[tuple[int, int, str]]) -> str:
    """Put marks for spans; of overlapping spans the whole stretch goes and the first one's mark stays."""
    out, at = [], 0
    for start, end, mark in sorted(marks, key=lambda m: (m[0], -m[1])):
        if start < at:
            at = max(at, end)
            continue
        out += [text[at:start], mark]
        at = end
    return "".join([*out, text[at:]])
