"""Sharding, spelling variants and the Merkle manifest against plain Python, with null, empty, repeated and long rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from palaver.llm import merkle, queries, sharding, spelling

LOWER_ASCII = {i: i + 32 for i in range(65, 91)}
RUN = re.compile("[A-Za-zÀ-ÿ]+")


# ---- sharding -------------------------------------------------------------------------------------------------------


def check_shards(rows, docs, shards, slack):
    assert sorted((r.doc_id is not None, r.doc_id, r.size, r.text_crc32) for r in rows) == sorted(
        (i is not None, i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs
    )
    places, held = defaultdict(list), Counter()
    for r in rows:
        places[r.shard].append(r.slot)
        held[r.shard] += r.size
    assert set(places) <= set(range(shards))
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    mean = sum(held.values()) / shards
    largest = max((len((t or "").encode()) + 1 for _, t in docs), default=0)
    assert all(abs(held[s] - mean) <= max(largest, slack * mean) for s in range(shards))


def test_shards_are_even_and_gapless(spark):
    rng = random.Random(3)
    docs = [(i, rng.choice([None, "", "é", "x" * rng.randint(0, 300)])) for i in range(3000)] + [(7, "same")] * 3 + [(None, "none")] * 2 + [(5000, "y" * 3000)]
    table = spark.createDataFrame([(i, t, 1, "s") for i, t in docs], "doc_id long, text string, SHARD int, Slot string").repartition(3)
    check_shards(sharding.shard(table.drop("SHARD"), shards=16).collect(), docs, 16, 0.01)


def test_one_key_with_a_third_of_all_rows_is_split(spark):
    docs = [(1, "hot" * 10)] * 2000 + [(i, "cold" * 8) for i in range(2, 4002)]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(8)
    check_shards(sharding.shard(table, shards=16).collect(), docs, 16, 0.02)


def test_empty_table_has_no_places(spark):
    table = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.shard(table, shards=4).collect() == []


def test_map_versions_are_kept_and_edits_move_little(spark, tmp_path):
    path = str(tmp_path / "map")
    docs = spark.range(20000).selectExpr("id as doc_id", "repeat('x', cast(id % 50 as int)) as text")
    sharding.create(spark, path, 8, slots=256)
    weighed = sharding.weights(sharding.sizes(docs, slots=256))
    sharding.rebalance(spark, path, weighed, 8)
    sharding.rebalance(spark, path, weighed, 8)
    sharding.rebalance(spark, path, weighed, 9)
    by_version = defaultdict(dict)
    for r in sharding.versions(spark, path).collect():
        by_version[r.version][r.slot, r.lane] = r.shard
    assert sorted(by_version) == [0, 1, 2, 3] and all(len(m) == 256 for m in by_version.values())
    assert by_version[2] == by_version[1]  # nothing to do, nothing moved
    moved = [k for k in by_version[3] if by_version[3][k] != by_version[2][k]]
    assert 256 / 9 * 0.7 <= len(moved) <= 256 / 9 * 1.6 and sum(by_version[3][k] == 8 for k in moved) >= 0.8 * len(moved)
    with pytest.raises(Exception, match="exists"):
        sharding._store(sharding.current(spark, path).drop("version"), path, 3)
    routed = sharding.route(docs, sharding.current(spark, path), slots=256).groupBy("shard").count().collect()
    assert sum(r["count"] for r in routed) == 20000 and len(routed) == 9


# ---- spelling -------------------------------------------------------------------------------------------------------


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def brute_words(docs):
    found = Counter()
    for i, t in docs:
        for w in RUN.findall(t or ""):
            w = w.translate(LOWER_ASCII)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 5:
                found[w] += 1
    return {w: n for w, n in found.items() if n >= 3}


def brute_variants(docs):
    n = brute_words(docs)
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), None if form[w] is None else n[form[w]]))
    return out


def spelling_docs(seed):
    rng = random.Random(seed)
    letters = "abcÉßÿ÷"
    stems = ["".join(rng.choice(letters) for _ in range(rng.randint(4, 9))) for _ in range(25)] + ["aaaaa", "aaaaaa", "aaaaaaa", "abababab", "babababa", "x" * 24, "x" * 23, "x" * 12 + "y" + "x" * 11, "z" * 700, "Straße"]
    docs = [(None, " ".join(stems)), (1, None), (2, ""), (3, " \n.,12 ")]
    for i in range(4, 160):
        words = []
        for _ in range(rng.randint(1, 30)):
            w = rng.choice(stems)
            at = rng.randrange(len(w) + 1)
            w = rng.choice([w, w, w.upper(), w[:at] + w[at + 1 :], w[:at] + rng.choice(letters) + w[at:], w[:at] + rng.choice(letters) + w[at + 1 :]])
            words.append(w)
        docs.append((i, rng.choice([" ", "-", "1"]).join(words)))
    chain = [(500, "stone " * 4 + "stoney " * 10 + "stoneyy " * 30)]  # forms that lead on to a further form
    return docs + [docs[-1]] * 2 + chain


@pytest.mark.parametrize("node_words", [spelling.NODE_WORDS, 3])
def test_spelling_variants(spark, node_words, monkeypatch):
    monkeypatch.setattr(spelling, "SIDE_BY_SIDE", 8)
    monkeypatch.setattr(spelling.neighbours, "__defaults__", (node_words,))
    docs = spelling_docs(node_words)
    table = spark.createDataFrame([(i, t, "w") for i, t in docs], "doc_id long, text string, Word string").repartition(4)
    expected = brute_variants(docs)
    assert len(expected) > 60 and any(x[1] and x[2] != x[1] for x in expected)
    assert {tuple(r) for r in spelling.variants(table).collect()} == expected
    assert spelling.variants(table.limit(0)).collect() == []


def test_checksums():
    rng = random.Random(9)
    parts = [bytes(rng.randrange(97, 100) for _ in range(rng.choice([1, 2, 5, 47, 48, 49, 200]))) for _ in range(300)]
    ends = np.cumsum([len(p) for p in parts])
    starts = ends - [len(p) for p in parts]
    seeds = np.array([zlib.crc32(str(i).encode()) for i in range(300)], dtype=np.uint32)
    crc, key = spelling.checksums(np.frombuffer(b"".join(parts), dtype=np.uint8), starts, ends, seeds)
    assert crc.tolist() == [zlib.crc32(p, int(s)) for p, s in zip(parts, seeds)]
    assert len(set(key.tolist())) == len(set(parts))


def test_roots_follow_long_chains(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(37)] + [("a", "w5")], "word string, form string")
    assert {r.word: r.root for r in spelling.roots(forms).collect()} == {f"w{i}": "w37" for i in range(37)} | {"a": "w37"}


# ---- manifest -------------------------------------------------------------------------------------------------------


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(leaves):
    """Root and, for each leaf, its siblings by level."""
    level, paths, steps = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        for i, at in enumerate(paths):
            low = at // 16 * 16
            steps[i].append(("".join(level[low:at]), "".join(level[at + 1 : low + 16])))
            paths[i] = at // 16
        level = [h("".join(level[i : i + 16])) for i in range(0, len(level), 16)]
    return level[0], steps


def plain_leaf(row):
    return h("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


@pytest.mark.parametrize("block_levels", [3, 1])
def test_manifest(spark, block_levels, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", block_levels)
    monkeypatch.setattr(merkle, "BLOCK", 16**block_levels)
    rows = [(i, f"text {i}" if i % 7 else None, None, "big", i) for i in range(600)]
    rows += [(1000 + i, "Ünï", "de", None, None) for i in range(17)] + [(2000 + i, "", "xx", "", 3) for i in range(16)]
    rows += [(3000, "alone", None, "one", 1), (None, None, None, "nothing", None), (5, "twice", "en", "two", 2), (5, "twice", "en", "two", 2), (5, "other", "en", "two", 2)]
    rows += [(9000 + i, "z", "en", f"s{i:02d}", 1) for i in range(20)]
    names = "doc_id long, text string, lang string, source string, n_chars long, Node string, witness int"
    table = spark.createDataFrame([(*r, "n", 1) for r in rows], names).repartition(5)
    groups = defaultdict(list)
    for i, text, lang, source, n in rows:
        groups[source].append((i is not None, i, plain_leaf((i, source, lang, n, text))))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subroots, expected = {}, Counter()
    for s in names:
        leaves = [x[2] for x in sorted(groups[s], key=lambda x: (x[0], x[1] or 0, x[2]))]
        subroots[s] = plain_tree(leaves)
    root, top = plain_tree([subroots[s][0] for s in names])
    for k, s in enumerate(names):
        for x, steps in zip(sorted(groups[s], key=lambda x: (x[0], x[1] or 0, x[2])), subroots[s][1]):
            expected[x[1], x[2], subroots[s][0], root, tuple(steps + top[k])] += 1
    found = merkle.manifest(table).collect()
    assert Counter((r.doc_id, r.leaf, r.subroot, r.root, tuple(map(tuple, r.witness))) for r in found) == expected
    folded = merkle.manifest(table).select(merkle.fold(merkle.F.col("leaf"), merkle.F.col("witness")).alias("f"), "root").collect()
    assert all(r.f == r.root for r in folded)


def test_manifest_of_nothing(spark):
    assert merkle.manifest(spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")).collect() == []


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 255, 256, 257, 4096])
def test_appender(n):
    leaves = [h(str(i)) for i in range(n)]
    block = merkle.Appender()
    nodes = [block.append(x) for x in leaves]
    root, steps = plain_tree(leaves)
    assert block.finish() == root and [merkle.Appender.steps(x) for x in nodes] == steps


# ---- contracts of the queries ---------------------------------------------------------------------------------------


def test_queries_keep_their_contract(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    shards = queries.QUERIES["op11_shard"](spark, sf)
    assert shards.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    check_shards(shards.collect(), docs, 16, 0.01)
    words = queries.QUERIES["op12_spelling"](spark, sf)
    assert words.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert {tuple(r) for r in words.collect()} == brute_variants(docs)


# ---- hashes of long words -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [512, 1024, 2048, 4096])
def test_words_of_one_polynomial_value_are_told_apart(n):
    """The Thue-Morse word and its complement have one value under every polynomial hash modulo 2^64 from 1024 letters on."""
    import pyarrow as pa
    import public_tokenizers
    from palaver.llm import bpe, jaccard, textbatch
    from tokenizers import Tokenizer

    word = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    texts = [word, word.translate(str.maketrans("ab", "ba"))]
    data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    hashes = textbatch.span_hashes(data, np.array([0, n]), np.array([n, 2 * n]))
    assert hashes[0] != hashes[1]
    sets = list(jaccard.document_sets(pa.array(texts)))
    assert not np.array_equal(sets[0], sets[1])
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    for mine, text in zip(bpe.Codec(path).encode_texts(texts), texts):
        assert np.frombuffer(mine, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
