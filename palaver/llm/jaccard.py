"""Near-duplicate documents by a grouped prefix join on word shingles (Jaccard similarity of at least 0.8).

Texts with the same set of shingles are one node. Shingles have one order for all documents: those that many documents share
come last, as far as a count table of fixed size tells, otherwise by hash. The first shingles of a set, so many that two
similar sets must share one, are its prefix. Nodes with identical prefix and size form a group; a posting list holds, for one
shingle, the groups with it in their prefix.

Pairs are not all needed, only the components, so candidates are taken in two rounds. First every node is paired with one
leader of its lists (the smallest node), which joins large families of copies by as many comparisons as they have members.
Then all pairs of a list that are still apart and pass the size, position and bitmap filters are compared. Groups are
expanded to their members. Every comparison is exact: the sets are computed again from the texts that are wanted, and sent
to the leader's place, where a leader with many partners is spread over several tasks. No candidate is dropped except by a
bound that proves its similarity under 0.8.

Shingles are 64-bit hashes. Defined results: a null text, or one without words, has no shingles and links with nothing; a text of
fewer than five words is one shingle; rows that repeat an id are one document, linked by whatever one of them is linked by;
a row without an id is its own component (null); an empty table gives an empty result; only id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.llm.components import components
from palaver.llm.lm import Tally, _counted
from palaver.llm.shared import tidy, written
from palaver.llm.textbatch import LOWER, mix, pieces, shingles, span_hashes, words

PERCENT, SHINGLE = 80, 5
SKETCH_BITS, HOT_LOCAL, HOT = 22, 2, 4  # size of the count table; repeats in a task and in all that make a shingle common
BITMAP = 1024
PER_LEADER, WANTED_BITS, BLOCK, SHORT = 256, 23, 1024, 64


def document_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The set of shingle hashes of each text, ascending."""
    for lo, hi, data, offsets in pieces(column):
        starts, ends, owner = words(data, offsets)
        hashes = span_hashes(LOWER[data], starts, ends)
        bounds = np.searchsorted(owner, np.arange(hi - lo + 1)).tolist()
        for a, b in zip(bounds, bounds[1:]):
            yield shingles(hashes[a:b], SHINGLE)


def _least(size: int) -> int:
    """Shingles that a set of this size shares with any similar one."""
    return -(-PERCENT * size // 100)


def common(docs: DataFrame) -> np.ndarray:
    """How common the shingles of each hash class are, as a power of two; 0 for most. A table of fixed size. Texts that are the
    same within a task count once, and only repeats within a task are seen: it steers the order, not the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, seen = Tally(0), set()
        for batch in batches:
            for s in document_sets(batch.column("text")):
                key = hash(s.tobytes())
                if key in seen:
                    continue
                seen.add(key)
                if len(seen) > 100_000:
                    seen.clear()
                tally.parts.append(s)
                tally.size += len(s)
                if tally.size > 1_000_000:
                    yield from repeated(tally)
        yield from repeated(tally)

    def repeated(tally: Tally) -> Iterator[pa.RecordBatch]:
        if tally.parts:
            keys, n = _counted(np.concatenate(tally.parts))
            keep = n >= HOT_LOCAL
            spot = (keys[keep] >> np.uint64(64 - SKETCH_BITS)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(spot), pa.array(n[keep])], ["spot", "n"])
        tally.parts, tally.size = [], 0

    found = docs.select("text").mapInArrow(tidy(run), "spot int, n long").groupBy("spot").agg(F.sum("n").alias("n")).filter(F.col("n") >= HOT)
    rows = found.toArrow()  # at most 2^SKETCH_BITS small rows
    table = np.zeros(1 << SKETCH_BITS, dtype=np.uint8)
    if rows.num_rows:
        table[rows.column("spot").to_numpy()] = np.log2(rows.column("n").to_numpy()).astype(np.uint8)
    return table


def parity(members: np.ndarray, bits: int) -> np.ndarray:
    """One bit for each hash class: whether the set has an odd number of members in it. Bits of words of eight bytes."""
    odd = np.bincount((mix(members) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def fold(bitmap: np.ndarray, bits: int) -> np.ndarray:
    """The same table for fewer classes."""
    return np.bitwise_xor.reduce(bitmap.reshape(-1, bits // 64), axis=0)


def signatures(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """(doc_id, n, sig, group, prefix, bitmap) of each document: what the join needs without the whole set."""
    shared = docs.sparkSession.sparkContext.broadcast(table)  # fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = shared.value
        for batch in batches:
            rows = [], [], [], [], [], []
            at = 0
            for s in document_sets(batch.column("text")):
                n = len(s)
                if n:
                    level = order[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                    first = s[np.argsort(level, kind="stable")[: n - _least(n) + 1]]
                    digest = hashlib.blake2b(first.tobytes(), digest_size=8, salt=n.to_bytes(8, "little")).digest()
                    wide = parity(s, BITMAP << max(0, (2 * n - 1).bit_length() - BITMAP.bit_length() + 1))
                    new = n, hashlib.blake2b(s.tobytes(), digest_size=16).digest(), int.from_bytes(digest, "little", signed=True), first.view(np.int64), fold(wide, BITMAP).tobytes(), wide.tobytes()
                else:
                    new = 0, None, None, None, None, None
                for column, value in zip(rows, new):
                    column.append(value)
                if len(rows[0]) == 2000:
                    yield pack(batch, at, rows)
                    at += 2000
                    rows = [], [], [], [], [], []
            yield pack(batch, at, rows)

    def pack(batch: pa.RecordBatch, at: int, rows: tuple) -> pa.RecordBatch:
        kinds = pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary()
        return pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(rows[0])), *(pa.array(r, k) for r, k in zip(rows, kinds))], ["doc_id", "n", "sig", "group", "prefix", "bitmap", "wide"])

    return docs.mapInArrow(tidy(run), "doc_id long, n long, sig binary, `group` long, prefix array<long>, bitmap binary, wide binary")


def posting_lists(groups: DataFrame) -> DataFrame:
    """(shingle, node, n, pos, lead) of shingles that several groups have in their prefix; ``lead`` is the smallest node."""
    entries = groups.select("node", "n", F.posexplode("prefix").alias("pos", "shingle"))
    parts = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = entries.select("shingle", "node", "n", "pos").repartition(parts, "shingle").sortWithinPartitions("shingle", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: pa.RecordBatch | None = None  # the latest row, not yet handed over if it opened a list
        lead, opened = 0, False
        for batch in batches:
            if not batch.num_rows:
                continue
            if last is not None:
                t = pa.Table.from_batches([last, batch]).combine_chunks()
                batch = t.to_batches()[0]
            shingle, node = batch.column("shingle").to_numpy(), batch.column("node").to_numpy()
            first = np.append(True, shingle[1:] != shingle[:-1])
            owner = np.maximum.accumulate(np.where(first, np.arange(len(shingle)), 0))
            leads = node[owner]
            if last is not None:
                leads[owner == 0] = lead
            inner = ~first
            inner[:-1] |= ~first[1:]
            inner[-1] = False  # is looked at with the next batch, or at the end
            if last is not None and opened:
                inner[0] = True
            keep = np.flatnonzero(inner)
            if len(keep):
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(keep)).columns, pa.array(leads[keep])], ["shingle", "node", "n", "pos", "lead"])
            lead, opened = leads[-1], bool(not first[-1]) or (len(shingle) == 1 and opened)
            last = batch.slice(batch.num_rows - 1, 1)
        if last is not None and opened:
            yield pa.RecordBatch.from_arrays([*last.columns, pa.array([lead])], ["shingle", "node", "n", "pos", "lead"])

    return dealt.mapInArrow(tidy(run), "shingle long, node long, n long, pos int, lead long")


def _fit(a: str, b: str):
    """Sizes that allow the similarity."""
    return (F.col(a) * 100 >= F.col(b) * PERCENT) & (F.col(b) * 100 >= F.col(a) * PERCENT)


def _likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs whose sizes and bitmaps allow the similarity: sets differ in at least as many shingles as their bitmaps in bits.
    The small bitmap of all comes first, then the one that has at least two bits for each shingle."""
    for bitmap in ("bitmap", "wide"):
        a = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col(bitmap).alias("ba"))
        b = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col(bitmap).alias("bb"))
        joined = pairs.join(a, "a").join(b, "b").filter(_fit("na", "nb"))
        pairs = written(joined.select("a", "b", "na", "nb", "ba", "bb").mapInArrow(_near, "a long, b long").distinct(), "likely")
    return pairs


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        ba, bb = batch.column("ba").to_pylist(), batch.column("bb").to_pylist()
        if len({*map(len, ba), *map(len, bb)}) == 1:
            x, y = (np.frombuffer(b"".join(b), dtype=np.uint64).reshape(len(b), -1) for b in (ba, bb))
            apart = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
        else:
            apart = np.array([_apart_bits(x, y) for x, y in zip(ba, bb)], dtype=np.int64)
        total = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
        # with |a|+|b| = s and d different: (s-d)/2 shared of (s+d)/2, so d (100+p) <= s (100-p)
        keep = np.flatnonzero(apart * (100 + PERCENT) <= total * (100 - PERCENT))
        yield batch.select(["a", "b"]).take(pa.array(keep))


def _apart_bits(a: bytes, b: bytes) -> int:
    bits = min(len(a), len(b)) * 8
    return int(np.bitwise_count(fold(np.frombuffer(a, dtype=np.uint64), bits) ^ fold(np.frombuffer(b, dtype=np.uint64), bits)).sum())


def _wanted(ids: DataFrame) -> np.ndarray:
    """Bit table of the ids, of fixed size."""
    spot = F.pmod(F.xxhash64("id"), F.lit(1 << WANTED_BITS))
    rows = ids.select(F.floor(spot / 8).cast("int").alias("byte"), F.element_at(F.array(*[F.lit(128 >> k) for k in range(8)]), (spot % 8 + 1).cast("int")).alias("bit"))
    found = rows.groupBy("byte").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most 2^WANTED_BITS / 8 small rows
    table = np.zeros(1 << (WANTED_BITS - 3), dtype=np.uint8)
    if found.num_rows:
        table[found.column("byte").to_numpy()] = found.column("bits").to_numpy()
    return table


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar. Sets are computed anew from the texts of the nodes in question."""
    ids = written(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct(), "wanted")
    table = docs.sparkSession.sparkContext.broadcast(_wanted(ids))  # fixed size
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << WANTED_BITS))

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(table.value)
        for batch in batches:
            some = np.flatnonzero(bits[batch.column("spot").to_numpy()]) if batch.num_rows else []
            if not len(some):
                continue
            part = batch.take(pa.array(some))
            found, at, size = [], 0, 0
            for s in document_sets(part.column("text")):
                found.append(s.tobytes() or None)
                size += s.nbytes
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").slice(at, len(found)), pa.array(found, pa.binary())], ["id", "members"])
                    at, found, size = at + len(found), [], 0
            yield pa.RecordBatch.from_arrays([part.column("doc_id").slice(at, len(found)), pa.array(found, pa.binary())], ["id", "members"])

    sets = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "text", spot.alias("spot")).mapInArrow(tidy(compute), "id long, members binary")
    sets = written(sets.filter(F.col("members").isNotNull()), "sets", "lz4")
    load = pairs.groupBy("b").agg(F.count("*").alias("m")).select("b", F.ceil(F.col("m") / PER_LEADER).cast("int").alias("salts"))
    load = written(load, "leaders")
    sent = pairs.join(load, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int").alias("salt"))
    sent = sent.join(sets, sent["a"] == sets["id"]).select("b", "salt", F.lit(1).alias("role"), "a", "members")
    leaders = load.select("b", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    leaders = leaders.join(sets, leaders["b"] == sets["id"]).select("b", "salt", F.lit(0).alias("role"), F.col("b").alias("a"), "members")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = leaders.unionByName(sent).repartition(2 * parts, "b", "salt").sortWithinPartitions("b", "salt", "role")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = None, []
        for batch in batches:
            a_out, b_out = [], []
            for b, salt, role, a, members in zip(*(batch.column(c).to_pylist() for c in ("b", "salt", "role", "a", "members"))):
                if (b, salt) != name:
                    name, held = (b, salt), []
                s = np.frombuffer(members, dtype=np.uint64)
                if role == 0:
                    held.append(s)
                elif any(similar(s, h) for h in held):
                    a_out.append(a)
                    b_out.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], ["a", "b"])

    return written(dealt.mapInArrow(tidy(compare), "a long, b long"), "verified")


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    if not len(a) or not len(b):
        return False
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _apart(lists: DataFrame) -> DataFrame:
    """Pairs of a posting list in different components that pass the size and position filters."""
    parts = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    several = lists.groupBy("shingle").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("shingle")
    dealt = lists.join(several, "shingle", "left_semi").repartition(2 * parts, "shingle").sortWithinPartitions("shingle", "n", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("shingle", "node", "n", "pos", "root")])
            if held and held[0][0, 0] == rows[0, -1]:  # one list throughout
                held.append(rows)
                continue
            if held and held[0][0, 0] == rows[0, 0]:
                rows = np.concatenate([*held, rows], axis=1)
            elif held:
                yield from pairs_of(np.concatenate(held, axis=1))
            begin = np.flatnonzero(np.append(True, rows[0, 1:] != rows[0, :-1]))
            held = [rows[:, begin[-1] :]]  # may go on in the next batch
            size = np.diff(begin)
            for k in np.flatnonzero(size > SHORT).tolist():
                yield from pairs_of(rows[:, begin[k] : begin[k + 1]])
            short = rows[:, : begin[-1]][:, np.repeat(size <= SHORT, size)]
            yield from short_pairs(short)
        if held:
            yield from pairs_of(np.concatenate(held, axis=1))

    def short_pairs(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The same for many short lists at once: rows one apart, two apart and so on."""
        shingle, node, n, pos, root = rows
        at = np.arange(len(node))
        for step in range(1, SHORT):
            at = at[at < len(node) - step]
            at = at[shingle[at] == shingle[at + step]]
            if not len(at):
                break
            i, j = at, at + step
            rest = np.minimum(n[i] - pos[i], n[j] - pos[j])
            keep = (root[i] != root[j]) & (100 * n[i] >= PERCENT * n[j]) & (rest * (100 + PERCENT) >= PERCENT * (n[i] + n[j]))
            if keep.any():
                u, v = node[i[keep]], node[j[keep]]
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], ["a", "b"])

    def pairs_of(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        _, node, n, pos, root = rows
        for lo in range(0, len(node), BLOCK):
            right = slice(lo, lo + BLOCK)
            low = int(np.searchsorted(n, -(-PERCENT * n[lo] // 100)))  # sizes ascend
            for left_lo in range(low, min(lo + BLOCK, len(node)), BLOCK):
                left = slice(left_lo, left_lo + BLOCK)
                a, b = n[left, None], n[None, right]
                keep = (np.arange(len(node))[left, None] < np.arange(len(node))[None, right]) & (root[left, None] != root[None, right]) & (100 * a >= PERCENT * b)
                # what can be shared from the first common shingle on
                rest = np.minimum(a - pos[left, None], b - pos[None, right])
                keep &= rest * (100 + PERCENT) >= PERCENT * (a + b)
                i, j = np.nonzero(keep)
                if len(i):
                    u, v = node[left][i], node[right][j]
                    yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], ["a", "b"])

    return dealt.mapInArrow(tidy(run), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, ``n_shingles``, ``component_id`` (smallest id reachable)."""
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    signed = written(signatures(docs, common(docs)), "signed")
    usable = signed.filter(F.col("sig").isNotNull() & F.col("doc_id").isNotNull())
    payload = F.struct("n", "group", "prefix", "bitmap", "wide")
    nodes = written(usable.groupBy("sig").agg(F.min("doc_id").alias("node"), F.first(payload).alias("x")).select("node", "sig", "x.*"), "nodes")

    groups = nodes.groupBy("group").agg(F.min("node").alias("node"), F.first(F.struct("n", "prefix")).alias("x")).select("group", "node", "x.*")
    groups = written(groups, "groups")
    lists = written(posting_lists(groups.select("node", "n", "prefix")), "lists")
    members = nodes.select("group", F.col("node").alias("a")).join(groups.select("group", F.col("node").alias("b")), "group").filter("a <> b").select("a", "b")

    stars = lists.filter("node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b")).distinct()
    stars = _likely(stars.union(members), nodes)
    one_each = stars.groupBy("a").agg(F.min("b").alias("b"))
    first = verified(one_each, docs)
    roots = written(components(first), "roots")

    def with_root(df: DataFrame, node: str, name: str) -> DataFrame:
        r = roots.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
        return df.join(r, df[node] == r["_node"], "left").withColumn(name, F.coalesce("_root", node)).drop("_node", "_root")

    # groups still apart meet in their lists; a group's members stand for themselves, as they may be apart as well
    expanded = groups.select(F.col("node").alias("_lead"), "group").join(nodes.select("group", F.col("node").alias("member")), "group").filter("_lead <> member").select("_lead", "member")
    more = lists.join(expanded, lists["node"] == expanded["_lead"]).select("shingle", F.col("member").alias("node"), "n", "pos")
    every = lists.select("shingle", "node", "n", "pos").unionByName(more)
    crossing = _apart(with_root(every, "node", "root"))
    inside = with_root(nodes.select("group", "node"), "node", "root")  # members of one group, which may have no list
    inside = inside.join(groups.select("group", "prefix", "n"), "group").select(F.col("prefix")[0].alias("shingle"), "node", "n", F.lit(0).alias("pos"), "root", "group")
    inside = _apart(inside.withColumn("shingle", F.col("group")).drop("group"))
    left = with_root(with_root(stars, "a", "ra"), "b", "rb").filter("ra <> rb").select("a", "b")
    open_pairs = _likely(crossing.union(inside).union(left), nodes)
    tested = one_each.select("a", "b").withColumn("_done", F.lit(True))
    second = verified(open_pairs.join(tested, ["a", "b"], "left").filter("_done is null").select("a", "b"), docs)

    final = components(first.union(second))
    roots_of = nodes.select("sig", "node").join(final, "node", "left").select("sig", F.coalesce("root", "node").alias("root"))
    by_id = usable.select("doc_id", "sig").join(roots_of, "sig").groupBy("doc_id").agg(F.min("root").alias("root"))
    joined = signed.select("doc_id", "n").join(by_id, "doc_id", "left")
    return joined.select(F.col("doc_id").alias(id_column), F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without those whose component has a smaller id. Of rows that repeat an id one stays; rows without an id stay."""
    found = near_duplicates(docs, id_column, text).groupBy(id_column).agg(
        F.max(F.col("component_id") != F.col(id_column)).alias("_drop"), (F.count("*") > 1).alias("_again")
    )
    marks = written(found.filter(F.col(id_column).isNotNull() & (F.col("_drop") | F.col("_again"))).withColumnRenamed(id_column, "_id"), "marks")
    again = marks.filter("_again and not _drop").select("_id")
    rest = docs.join(marks.select("_id"), docs[id_column] == F.col("_id"), "left_anti")
    return rest.unionByName(docs.join(again, docs[id_column] == F.col("_id"), "left_semi").dropDuplicates([id_column]))
