"""Operators of the llm subpackage against plain Python on small inputs, with null, empty, repeated and long rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from palaver.llm import bpe, gif, jaccard, lm, neardup, packing, pii, quality, urlfilter, warc

PATH = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [None, "", " ", "one", "The the\n\nTHE  end <|endoftext|> é 　x", "mail a.b@c.de, +1 (499) 555-6503 and 10.0.0.1!", "aaaa " * 3000, "x" * 5000, "The same words again and again here", "The same words again and again here", "\x00\x1c tab\tend "]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "other") for i, t in enumerate(TEXTS)] + [(3, "one", "other"), (None, "no id at all but words", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, IDS string").coalesce(2)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, IDS string")


def expected_ids(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


def test_bpe(docs, nothing):
    done = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    assert len(done) == len(TEXTS) + 2
    for r in done:
        assert np.frombuffer(r.ids, "<u4").tolist() == expected_ids(r.text) and r.decoded == (r.text or "") and r.n_tokens == len(r.ids) // 4
    assert bpe.encode(nothing, PATH).count() == 0


def test_bpe_random_words():
    codec, library, rng = bpe.Codec(PATH), Tokenizer.from_file(PATH), random.Random(1)
    texts = ["".join(rng.choice(["a", "e", "th", "in", " ", "'", "ll", "\n", "1", "é", "\t", "!!"]) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    for mine, theirs in zip(codec.encode_texts(texts), library.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(mine, "<u4").tolist() == theirs.ids


def test_packing(docs, nothing):
    rows = packing.pack(docs, PATH).collect()
    for r in rows:
        whole = expected_ids({i: t for i, t in enumerate(TEXTS)}.get(r.doc_id, "no id at all but words")) + [2]
        assert np.frombuffer(r.ids, "<u4").tolist() == whole[r.start : r.start + r.length]
        assert r.start == 0 or r.length == 1024
    at = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values()) <= 1024 and len(at) == -(-sum(r.length for r in rows) // 1024)
    assert packing.pack(nothing, PATH).count() == 0


def test_packing_plan_is_whole():
    rng = random.Random(5)
    for _ in range(20):
        counts = dict(Counter(rng.choice([rng.randint(1, 1024), rng.randint(1, 90), 1024, 512]) for _ in range(rng.randint(1, 400))))
        used = Counter()
        for parts, times in packing.plan(counts):
            assert sum(parts) <= 1024 and times > 0
            used.update({p: n * times for p, n in Counter(parts).items()})
        assert used == counts


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://", "https://WWW.Example.com/en/x?q#f", "http://example.com/en", "http://a.example.com/en/", "http://x.net/es/1", "http://x.net/fr", "http://net/fr/", "http://notcom/en/", "ftp://b.com", "http://c.com/#a"] * 2
    urls += [f"http://h{i}.example.com/en/{i}" for i in range(600)]
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"), ("net", "/fr/", "block"), (None, "/", "block")]
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id long, url string, Host string")
    listed = spark.createDataFrame(rules, "host string, path string, action string")
    for r in urlfilter.judge(pages, listed, slice_rows=16).collect():
        rest = (r.url or "").partition("://")[2] if "://" in (r.url or "") else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path, host = re.match(r"[^?#]*", rest[len(host) :])[0], host.lower()
        fits = [(len(h + p), h + p, a) for h, p, a in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, best[1], best[2])
    assert urlfilter.judge(pages, listed.limit(0)).filter("verdict <> 'allow'").count() == 0
    assert urlfilter.judge(pages.limit(0), listed).count() == 0


def test_gif(docs, nothing):
    rows = gif.features(gif.store(docs)).collect()
    texts = {i: t for i, t in enumerate(TEXTS)} | {None: "no id at all but words"}
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 64)) * 64, b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:])
    assert len(rows) == len(TEXTS) + 2 and gif.store(nothing).count() == 0
    shown = gif.frames(gif.store(docs).filter("doc_id = 7")).collect()
    assert [f.at_ms for f in shown] == [0] and sum(shown[0].histogram) == shown[0].width * shown[0].height


def test_gif_reads_growing_codes():
    """Two code streams written by hand: a run that refers to itself, and one with a clear code inside."""

    def stream(codes, widths):
        bits = at = 0
        for c, w in zip(codes, widths):
            bits |= c << at
            at += w
        return bits.to_bytes(-(-at // 8), "little")

    assert gif.read_lzw(stream([4, 1, 6, 7, 5], [3, 3, 3, 4, 4]), 2, 6).tolist() == [1, 1, 1, 1, 1, 1]
    assert gif.read_lzw(stream([4, 1, 2, 4, 3, 5], [3] * 6), 2, 4).tolist() == [1, 2, 3, 0]
    assert gif.read_lzw(b"", 2, 3).tolist() == [0, 0, 0]


def test_warc(spark):
    long = "long é page\r\n\r\n" * 20000
    html = [None, "", "short", "short", "x" * 100, long, "x" * 100, long, "x" * 100]
    pages = spark.createDataFrame([(i, f"http://a/{i}\nb", h) for i, h in enumerate(html)] + [(None, None, "x" * 100), (4, "again", "x" * 100)], "page_id long, url string, html string")
    index = warc.write(pages)
    rows = warc.records(index).collect()
    assert len(rows) == len(html) + 2
    for r in rows:
        raw = (html[r.page_id] if r.page_id is not None else "x" * 100) or ""
        data = raw.encode()
        first = html.index(raw) if raw in html else r.page_id
        want = first if len(data) >= 100 and first != r.page_id else None
        assert (r.payload_bytes, r.payload_digest, r.refers_to) == (len(data), hashlib.sha256(data).hexdigest(), want)
        assert r.record_type == ("response" if want is None else "revisit")
    chunks = warc.read(index).filter("page_id = 5").orderBy("chunk_no").collect()
    assert len(chunks) > 3 and b"".join(c.data for c in chunks) == long.encode()
    assert [c.chunk_no for c in chunks if c.last] == [len(chunks) - 1]
    assert chunks[0].digest == hashlib.sha256(chunks[0].data).hexdigest()
    assert warc.records(warc.write(pages.limit(0))).count() == 0


def test_pii_spans():
    def plain(t):
        out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) < 256 for x in m[0].split("."))]
        return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]

    rng = random.Random(2)
    for letters in ("a1.@-é ", "0123 -.+()", "1.2+ ", "@a.b"):
        for _ in range(4000):
            t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 30)))
            assert [s for s in pii.base_spans(t) if s[0] != 2] == plain(t)
    assert [t[s:e] for t in ["pay 4111 1111-1111 1111 now"] for k, s, e in pii.base_spans(t) if k == 2] == ["4111 1111-1111 1111"]
    assert not [s for s in pii.base_spans("pay 4111 1111 1111 1112 now") if s[0] == 2]


def test_pii_counts_by_kind(spark, tmp_path):
    """Each count is of its own kind, whatever the place of a span among the others."""
    from palaver.llm.queries import op9

    spans = {1: ["a.b@c.de", "10.0.0.1", "4111 1111-1111 1111", "+49 30 1234567", "+33 1 22 33 44 55"], 2: ["1.2.3.4", "5.6.7.8", "x@y.z"], 3: [], 4: ["a@b.c", "d@e.f"]}
    rows = [(i, " or ".join(s)) for i, s in spans.items()] + [(5, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in op9(spark, str(tmp_path)).collect()}
    assert {i: (r.n_email, r.n_ip, r.n_card, r.n_phone) for i, r in found.items()} == {1: (1, 1, 1, 2), 2: (1, 2, 0, 0), 3: (0, 0, 0, 0), 4: (2, 0, 0, 0), 5: (0, 0, 0, 0)}
    texts = dict(rows)
    for i, r in found.items():
        base = [x for x in r.spans.split(",") if x and not x.startswith("term")]
        assert sorted(texts[i][int(a) : int(b)] for _, a, b in (x.split(":") for x in base)) == sorted(spans.get(i, []))
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()


def test_pii_disclosing_words(spark, docs, nothing):
    """A word that stands beside one address in different windows only gives it away; a common word does not."""
    filler = ["alpha", "beta", "gamma", "delta", "epsilon", "kappa"]
    rows = [(i, f"{filler[i]} zanzibarian common {filler[i]} x@y.org {filler[-i]} more") for i in range(6)]
    rows += [(10 + i, "common words with common terms and more of common sense " * 3) for i in range(50)]
    found = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows[:6]:
        assert "zanzibarian" in [t[x.start : x.end] for x in found[i].terms] and "common" not in [t[x.start : x.end] for x in found[i].terms]
    assert all(not found[i].terms and not found[i].base for i, _ in rows[6:])
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert clean[0] is None and clean[5].startswith("mail [EMAIL], [PHONE] and [IP]!") and clean[7] == TEXTS[7]
    assert pii.find(nothing).count() == 0


def test_pii_rare_disclosing_words(spark):
    """A word in one context, a template repeated and a short name are judged too; common words beside them are not taken."""
    common = "please write down some common words about this plan today and then come back with more notes for Lee "
    rows = [(1, "please write Zanzibarian about this plan a@one.org today"), (2, "common notes for Bo q@two.org today"), (3, "please ask Quy r@four.org today")]
    rows += [(10 + i, "please write Templeton about this plan b@three.org today") for i in range(4)]
    rows += [(100 + i, common * 1000 + "ask ") for i in range(40)]
    found = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    terms = {i: [t[x.start : x.end] for x in found[i].terms] for i, t in rows}
    assert [terms[i] for i in (1, 2, 3, 10, 13)] == [["Zanzibarian"], ["Bo"], ["Quy"], ["Templeton"], ["Templeton"]]
    assert not any(terms[i] for i, _ in rows if i >= 100)


def test_pii_words_beside_are_whole():
    """Words are not cut where the reach ends or at the edge of a span; a word between two mentions counts once."""
    text = "y" * 150 + "first " + "a " * 97 + "x@y.org"
    assert [w for _, w, *_ in pii._beside(text, pii.base_spans(text))] == []
    assert [w for _, w, *_ in pii._beside("éabc@x.org end", pii.base_spans("éabc@x.org end"))] == ["end"]
    text = "x@y.org between x@y.org"
    assert pii._beside(text, pii.base_spans(text)) == [("email:x@y.org", "between", 8, 15, 2)]


def test_quality(spark, docs, nothing):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["good", "plain", "words", "here", "of", "text"]) + ("!!" if i % 3 == 0 else "") for _ in range(40))) for i in range(300)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i, _ in rows] + [(1, None), (None, 1), (2, 7)], "doc_id long, quality int")
    found = quality.scores(table.unionByName(docs.select("doc_id", "text").filter("doc_id is null")), labels).collect()
    good = [r.score for r in found if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.doc_id % 3]
    bad = [r.score for r in found if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.doc_id % 3 == 0]
    assert min(good) > 0.5 > max(bad) and len(found) == 301
    assert {r.score for r in quality.scores(docs, labels.limit(0)).collect()} == {quality.PRIOR}
    assert quality.scores(nothing, labels).count() == 0


def test_isotonic_is_monotone():
    at, value = quality.isotonic(np.arange(6.0), np.array([0, 3, 1, 2, 5, 4.0]), np.array([5, 5, 5, 5, 5, 5.0]))
    assert (np.diff(value) > 0).all() and value[0] == 0 and len(at) == len(value)


def test_near_vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((60, 16))
    rows = [list(map(float, b + rng.standard_normal(16) * s)) for b in base for s in (0, 0.05, 0.2, 0.4)]
    rows += [rows[0], rows[0], None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, [1e300] * 16, [1.0] * 8]
    table = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    usable = [i for i, v in enumerate(rows) if v and None not in v and np.isfinite(v).all() and any(v) and len(v) == 16]
    unit = np.array([np.array(rows[i]) / np.abs(rows[i]).max() for i in usable])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    linked = (unit @ unit.T >= 0.9) & ~np.eye(len(usable), dtype=bool)
    found = {r.vec_id: r for r in neardup.near_duplicates(table, block=16).collect()}
    assert len(found) == len(rows)
    agree = sum(found[i].n_links == int(linked[k].sum()) for k, i in enumerate(usable))
    assert agree >= 0.98 * len(usable) and all(found[i].n_links <= int(linked[k].sum()) for k, i in enumerate(usable))
    assert all(found[i].n_links == 0 and found[i].kept for i in range(len(rows)) if i not in usable)
    assert found[len(base) * 4].component_id == 0
    assert neardup.near_duplicates(table.limit(0)).count() == 0


def word_set(text):
    words = WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def test_jaccard(spark, docs, nothing):
    rng = random.Random(6)
    rows, shared = [], [f"s{i}" for i in range(40)]
    for i in range(40):
        words = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([3, 30, 120]))] + (shared if i % 4 == 0 else [])
        for _ in range(rng.choice([1, 1, 5])):
            rows.append((len(rows), " ".join(words)))
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = f"n{rng.randint(0, 999)}"
    rows += [(1000 + i, t) for i, t in enumerate(TEXTS)]
    sets = {i: word_set(t) for i, t in rows}
    root = {i: i for i in sets}
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if b < a and both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {i: new if r == old else r for i, r in root.items()}
    found = {r.doc_id: r for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert {i: (r.n_shingles, r.component_id) for i, r in found.items()} == {i: (len(s), root[i]) for i, s in sets.items()}
    kept = jaccard.one_of_each(docs).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [0, 1, 2, 3, 4, 5, 6, 7, 8, 10] and len(kept) == 11
    assert jaccard.near_duplicates(nothing).count() == 0


def test_lm(docs, nothing):
    rows = docs.collect()
    tokens = [WORD.findall((r.text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) + [None] for r in rows]
    held = [r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 1 for r in rows]
    counts = Counter(t for ts, h in zip(tokens, held) if not h for t in ts)
    total, types = sum(counts.values()), len(counts)
    want = sorted((str(r.doc_id), len(ts), sum(counts[t] > 0 for t in ts), round(sum(np.log10((counts[t] + 0.5) / (total + 0.5 * (types + 1))) for t in ts), 6)) for r, ts in zip(rows, tokens))
    found = lm.scores(docs).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in found) == want
    assert all(r.score < 0 and r.train_tokens == total for r in found)
    assert lm.scores(nothing).count() == 0


def test_lm_counts_beyond_float32(spark):
    """A slot past 2^24 goes on counting."""
    run = lambda before, last: (before << 16) | (0x61 << 8) | last
    rows = [(1, run(0, 0x61), 1 << 24), (1, run(0, 0xE1), 1 << 24)] + [(1, run(i, 0x61), 1) for i in range(1, 2001)]
    zero, one = lm.build(spark.createDataFrame(rows, "kind byte, key long, n long").coalesce(1))
    at = (0x61 << 8) | 1
    assert (zero[at], one[at]) == (60000, 59993)


def test_lm_is_a_distribution():
    """The chances of all next bytes add up to 1."""
    rng = np.random.default_rng(0)
    model = lm.Model()
    size = int(lm.BASES[-1])
    model.use((rng.integers(0, 9, size).astype(np.uint16), rng.integers(0, 9, size).astype(np.uint16)))
    runs = np.uint64(0x6162636465) * np.uint64(256) + np.arange(256, dtype=np.uint64)
    assert abs(np.exp2(model.log2(runs)).sum() - 1) < 1e-6
