"""Spelling variants: words that differ by one letter, grouped under their commonest form.

Words are counted over all texts. For the neighbours, the words and their reversals are laid out as a trie, kept as a
distributed table of edges (node, letter, child). A state (word, position, node, edits) says that the word up to the position
leads to the node with so many edits. In each round all states are joined with the edges of their nodes and move one letter
on, exactly or by the one edit; a state that ends in a word with one edit makes the two neighbours. Rounds go on until no state
is left.

The edit may be taken in the first or the second half of a word; what is before it is untouched. So a state starts at the
node of the word's exact first half, and the reversed word does the same from its end: every neighbour is met by one of the
two, and no state stands at the crowded nodes near the root. A node keeps, for each letter, the letters that follow below, so
that a step is taken only where the next one is possible. Where a single word is left below a letter, the edge leads to that
word, however long, and the two are compared; all neighbours are compared like this in the end, so hashes of nodes need not be
unique. Rounds grow with the longest beginning that two words share, less the half.

A node with many words is dealt out in salted copies of its one row.

Defined results: null and empty texts have no words; a null id counts as an empty one in the checksum; repeated rows count as
often as they occur; an empty table gives an empty result; only the id and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from palaver.llm import columns as C
from palaver.llm.shared import small_batches, tidy, written
from palaver.llm.textbatch import LOWER, pieces, words

MIN_LENGTH, MIN_COUNT, RATIO, DROP = 5, 3, 2, 97
TALLY_WORDS = 200_000
#: Runs up to so many bytes are hashed side by side, longer ones one by one.
SIDE_BY_SIDE = 48
#: States and words per copy of a node.
NODE_WORDS = 20_000
END = " "
PRIME = (1 << 61) - 1
BASES = (0x1B873593CC9E2D51 % PRIME, 0x0E6546B64C2B2AE3)
STARTS = (1, 2)

# Bytes of the letters A-Z, a-z; U+00C0 to U+00FF are 0xC3 and any byte behind it.
ASCII_LETTER = np.zeros(256, dtype=bool)
ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True
LEAD = 0xC3


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (table & np.uint32(1)))
    return table


CRC = _crc_table()


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of the maximal runs of letters."""
    letter = ASCII_LETTER[data]
    lead = data == LEAD
    letter |= lead
    letter[1:] |= lead[:-1]
    return words(np.where(letter, data, np.uint8(0x20)), offsets)


def checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """crc32 of each run, going on from ``seeds``, and a 64-bit key of its bytes."""
    size = ends - starts
    order = np.argsort(-np.minimum(size, SIDE_BY_SIDE + 1).astype(np.int16), kind="stable")
    size, begin = size[order], starts[order]
    crc = (seeds[order] ^ np.uint32(0xFFFFFFFF)).astype(np.uint32)
    key = np.full(len(order), 0x9E3779B97F4A7C15, dtype=np.uint64)
    long = int(np.searchsorted(-size, -SIDE_BY_SIDE))  # runs above the limit come first
    for j in range(int(size[long]) if long < len(size) else 0):
        m = int(np.searchsorted(-size, -j))  # those longer than j
        byte = data[begin[long:m] + j]
        part = crc[long:m]
        crc[long:m] = CRC[(part ^ byte) & np.uint32(255)] ^ (part >> np.uint32(8))
        part = (key[long:m] ^ byte) * np.uint64(0x7FB5D329728EA185)
        key[long:m] = part ^ (part >> np.uint64(29))
    crc ^= np.uint32(0xFFFFFFFF)
    for i in range(long):
        raw = data[begin[i] : begin[i] + size[i]].tobytes()
        crc[i] = zlib.crc32(raw, int(seeds[order[i]]))
        key[i] = int.from_bytes(blake2b(raw, digest_size=8).digest(), "little")
    back = np.empty(len(order), dtype=np.int64)
    back[order] = np.arange(len(order))
    return crc[back], key[back]


def word_counts(docs: DataFrame, id_column: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, drop: int = DROP) -> DataFrame:
    """(word, n) over all texts. A run whose checksum with the id is divisible by ``drop`` is counted without one letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: dict[str, int] = defaultdict(int)
        for batch in C.split(batches, "text"):
            ids = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in batch.column("id").to_pylist()], dtype=np.uint32)
            for lo, _, data, offsets in pieces(batch.column("text")):
                _count_piece(tally, LOWER[data], offsets, ids[lo : lo + len(offsets) - 1])
                if len(tally) > TALLY_WORDS:
                    yield _tallied(tally)
                    tally.clear()
        yield _tallied(tally)

    def _count_piece(tally: dict[str, int], data: np.ndarray, offsets: np.ndarray, ids: np.ndarray) -> None:
        starts, ends, owner = runs(data, offsets)
        if not len(starts):
            return
        crc, key = checksums(data, starts, ends, ids[owner])
        raw = data.tobytes()
        odd = crc % drop == 0
        for a, b, c in zip(starts[odd].tolist(), ends[odd].tolist(), crc[odd].tolist()):
            word = raw[a:b].decode()
            at = c % len(word)
            word = word[:at] + word[at + 1 :]
            if len(word) >= min_length:
                tally[word] += 1
        leads = np.concatenate([[0], np.cumsum(data == LEAD)])
        whole = ~odd & (ends - starts - (leads[ends] - leads[starts]) >= min_length)
        starts, ends, key = starts[whole], ends[whole], key[whole]
        _, first, times = np.unique(key, return_index=True, return_counts=True)
        for a, b, n in zip(starts[first].tolist(), ends[first].tolist(), times.tolist()):
            tally[raw[a:b].decode()] += n

    small_batches(docs.sparkSession)
    source = docs.select(F.col(f"`{id_column}`").cast("string").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    counted = source.mapInArrow(tidy(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= min_count)


def _tallied(tally: dict[str, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(tally), pa.string()), pa.array(list(tally.values()), pa.int64())], ["word", "n"])


def _nodes_of(word: str, way: int) -> list[int]:
    """The node of every beginning of a word, the empty one and the whole included, and of the word's end."""
    base, h = BASES[way], STARTS[way]
    out = [h]
    for c in word:
        h = (h * base + ord(c) + 1) % PRIME
        out.append(h)
    out.append((h * base + 1) % PRIME)
    return out


def _oriented(counted: DataFrame) -> DataFrame:
    """Every word forwards and backwards: (word, n, way, whole, pos, node), where ``whole`` names the word and ``node`` is
    that of its first half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: tuple[list, ...] = [], [], [], [], [], []
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
                for way, w in enumerate((word, word[::-1])):
                    nodes = _nodes_of(w, way)
                    for column, x in zip(columns, (w, n, way, nodes[-1], len(w) // 2, nodes[len(w) // 2])):
                        column.append(x)
            types = pa.string(), pa.int64(), pa.int8(), pa.int64(), pa.int32(), pa.int64()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["word", "n", "way", "whole", "pos", "node"])

    return counted.select("word", "n").mapInArrow(tidy(run), "word string, n long, way byte, whole long, pos int, node long")


def _letters(oriented: DataFrame) -> DataFrame:
    """(node, letter, next, child, whole) for the beginnings that a neighbour's state can reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: tuple[list, ...] = [], [], [], [], []
            for word, way in zip(batch.column("word").to_pylist(), batch.column("way").to_pylist()):
                nodes, first = _nodes_of(word, way), (len(word) - 1) // 2
                marked = word + END
                columns[0].extend(nodes[first:-1])
                columns[1].extend(marked[first:])
                columns[2].extend(marked[first + 1 :])
                columns[2].append("")
                columns[3].extend(nodes[first + 1 :])
                columns[4].extend([nodes[-1]] * (len(marked) - first))
            types = pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["node", "letter", "next", "child", "whole"])

    return oriented.select("word", "way").mapInArrow(tidy(run), "node long, letter string, next string, child long, whole long")


def edge_table(oriented: DataFrame, node_words: int = NODE_WORDS) -> DataFrame:
    """(node, salts, edges) for every node with two words or more; an edge is (letter, next, child, word, n), and has a word
    if it is the only one below. A node has at most one edge per letter."""
    letters = _letters(oriented)
    edges = letters.groupBy("node", "letter").agg(F.count("*").alias("n_words"), F.max("child").alias("child"), F.max("whole").alias("whole"), F.array_join(F.collect_set("next"), "").alias("next"))
    nodes = edges.groupBy("node").agg(F.sum("n_words").alias("n_words"), F.collect_list(F.struct("letter", "next", "child", "whole", (F.col("n_words") == 1).alias("single"))).alias("edges"))
    nodes = written(nodes.filter("n_words > 1").select("node", F.floor(F.col("n_words") / node_words).cast("int").alias("salts"), "edges"), "nodes")
    flat = nodes.select("node", "salts", F.explode("edges").alias("e")).select("node", "salts", "e.letter", "e.next", "e.child", F.when(F.col("e.single"), F.col("e.whole")).alias("whole"))
    single = flat.filter("whole is not null").join(oriented.select("whole", "word", F.col("n").alias("word_n")), "whole").select("node", "salts", "letter", F.lit(None).cast("string").alias("next"), F.lit(None).cast("long").alias("child"), "word", "word_n")
    several = flat.filter("whole is null").select("node", "salts", "letter", "next", "child", F.lit(None).cast("string").alias("word"), F.lit(None).cast("long").alias("word_n"))
    return single.unionByName(several).groupBy("node", "salts").agg(F.collect_list(F.struct("letter", "next", "child", "word", "word_n")).alias("edges"))


def _step(states: DataFrame, nodes: DataFrame, crowded: DataFrame) -> DataFrame:
    """All states one letter on: states, and neighbours where ``near`` is not null."""
    salted = states.join(crowded, "node", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("word"), F.col("salts") + 1).cast("int"), F.lit(0))).drop("salts")
    edge = [F.col(f"e.{c}").alias(a) for c, a in (("letter", "letter"), ("next", "next"), ("child", "child"), ("word", "near"), ("word_n", "near_n"))]
    marked = F.concat("word", F.lit(END))
    ahead = [F.substring(marked, F.col("pos") + 1 + i, F.lit(1)).alias(f"c{i}") for i in range(3)]
    met = salted.join(nodes, ["node", "salt"]).select("word", "way", "pos", "edits", *ahead, "edges")
    met = met.select("word", "way", "pos", "edits", "c0", "c1", "c2", F.explode("edges").alias("e")).select("word", "way", "pos", "edits", "c0", "c1", "c2", *edge)
    exact, free, single = F.col("letter") == F.col("c0"), F.col("edits") == 0, F.col("near").isNotNull()

    def follows(i: int) -> Column:
        return F.instr(F.col("next"), F.col(f"c{i}")) > 0

    def to(pos: int, edits: Column) -> Column:
        return F.struct((F.col("pos") + pos).alias("pos"), edits.alias("edits"))

    # with its edit made, a state has one edge to follow; the others are dropped before anything is computed
    met = met.filter(F.when(single, (free | exact) & (F.levenshtein("word", "near", 1) == 1)).when(exact, free | follows(1)).otherwise(free))
    one, inner = F.lit(1), F.col("c0") != END
    moves = F.array(
        F.when(single | exact, to(1, F.col("edits"))).when(inner & follows(1), to(1, one)),  # on, or another letter
        F.when(~single & ~exact & follows(0), to(0, one)),  # a letter more in the trie
        F.when(~single & ~exact & inner & (F.col("letter") == F.col("c1")) & follows(2), to(2, one)),  # a letter less
    )
    moved = met.select("word", "way", "child", "near", "near_n", F.explode(moves).alias("m")).filter("m is not null")
    return moved.select("word", "way", F.col("m.pos").alias("pos"), F.col("child").alias("node"), F.col("m.edits").alias("edits"), "near", "near_n")


def neighbours(counted: DataFrame, node_words: int = NODE_WORDS) -> DataFrame:
    """(word, near, near_n): all pairs, both ways, of words that differ by one inserted, deleted or replaced letter."""
    spark = counted.sparkSession
    oriented = written(_oriented(counted), "oriented")
    table = written(edge_table(oriented, node_words), "edges")
    crowded = table.filter("salts > 0").select("node", "salts")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salted = table.select("node", F.explode(F.sequence(F.lit(0), F.col("salts"))).alias("salt"), "edges")
    nodes = salted.repartition(parts, "node", "salt").persist(StorageLevel.DISK_ONLY)
    states = oriented.select("word", "way", "pos", "node", F.lit(0).alias("edits"))
    found = []
    while True:
        step = written(_step(states, nodes, crowded), "states")
        found.append(step.filter("near is not null").select("word", "way", "near", "near_n"))
        states = step.filter("near is null").select("word", "way", "pos", "node", "edits")
        if states.isEmpty():
            break
    nodes.unpersist()
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    backwards = F.col("way") == 1
    straight = pairs.select(*[F.when(backwards, F.reverse(c)).otherwise(F.col(c)).alias(c) for c in ("word", "near")], "near_n")
    return straight.groupBy("word", "near").agg(F.max("near_n").alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the last word that forms lead to. Every round doubles the steps that are known."""
    known = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = known.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        further = written(known.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        known = further.select("word", "root")
        if further.filter("moved").isEmpty():
            return known


def variants(docs: DataFrame, id_column: str = "doc_id", text: str = "text", ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word that is counted often enough. ``form`` is the commonest near word,
    ties to the smallest, if it occurs at least ``ratio`` times as often."""
    counted = written(word_counts(docs, id_column, text), "words")
    best = neighbours(counted).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    judged = counted.join(best, "word", "left")
    has = -F.col("best.less") >= ratio * F.col("n")
    judged = written(
        judged.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best.near")).alias("form"), F.when(has, -F.col("best.less")).alias("form_n")), "judged"
    )
    last = roots(judged.filter("form is not null"))
    return judged.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
