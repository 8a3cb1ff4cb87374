"""Boundary cases of single rules, written by hand or against plain Python."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palaver.functions import numbers, replies, text
from palaver.operators import alignment, catalog, clusters, diarization, live, telemetry, topics, transcripts


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", expr(F.col("v")).alias("x")).orderBy("i").collect()]


def test_numbers_follow_the_binary_value(spark):
    rng = random.Random(1)
    vals = [30.45, 52.15, 2.675, 0.125, 0.375, -1.005, 0.0, 5999.995] + [rng.uniform(-5000, 5000) for _ in range(300)]
    vals += [k / 1000 for k in range(0, 3000, 5)]
    for d in (1, 2, 6):
        assert column(spark, vals, lambda c: numbers.fixed(c, d), "double") == [f"{v:.{d}f}" for v in vals]
        assert column(spark, vals, lambda c: numbers.round_exact(c, d), "double") == [round(v, d) for v in vals]


def test_line_grammars(spark):
    lines = [
        "[00:03.20 - 00:11.45]  SPEAKER_00 : hello all. Item two.", "[01:02:03] Ada: hello", "[01:02] **Bob**: hello",
        "", "Cleo: hello", "no colon here", "[00:05.0 - 00:07.0] X : ", "[01:02] Y: " + "a" * 100,
    ]
    df = spark.createDataFrame([("m", i, x) for i, x in enumerate(lines)], "meeting_id string, line_no int, raw string")
    got = {r.line_no: r for r in transcripts.parse_lines(df).collect()}
    assert sorted(got) == [0, 1, 2, 4, 7] or sorted(got) == [0, 1, 2, 4, 6, 7]
    assert (got[0].kind, got[0].start, got[0].end, got[0].speaker) == ("range", 3.2, 11.45, "SPEAKER_00")
    assert (got[1].start, got[1].end) == (3723.0, 3724.0)
    assert (got[2].kind, got[2].start, got[2].speaker) == ("short", 62.0, "Bob")
    assert (got[4].start, got[4].end, got[4].speaker) == (4.0, 5.0, "Cleo")
    assert got[7].end == pytest.approx(62 + 5.0)


def test_sentences_protect_abbreviations(spark):
    got = column(spark, ["cf. p. 3 ok. Next! Dr. X? yes", "loop. Then", "  ", "A…  b. c"], text.split_sentences)
    assert got == [["cf. p. 3 ok.", "Next!", "Dr. X?", "yes"], ["loop. Then"], [], ["A…  b.", "c"]]


def wrap(s, limit):
    out = []
    s = s.strip()
    while len(s) > limit:
        space = s[:limit].rfind(" ")
        at = space if space > 0 else limit
        out.append(s[:at].strip())
        s = s[at:].strip()
    return out + [s] if s else out


def test_hard_wrap_random(spark):
    rng = random.Random(3)
    vals = ["".join(rng.choice("ab é") for _ in range(rng.randint(0, 90))).strip() for _ in range(200)] + ["x" * 37, "a  b" * 9]
    assert column(spark, vals, lambda c: text.hard_wrap(c, 10)) == [wrap(v, 10) for v in vals]


def test_labels(spark):
    got = column(spark, ["a<b>:c", "con", " .x. ", None, "é" * 300, "lpt9"], text.sanitize_label)
    assert got == ["abc", "_con", "x", "", "é" * 200, "_lpt9"]
    assert column(spark, ["0:08", "1:03:43", "12:3", "x"], text.teams_timestamp) == ["00:00:08", "01:03:43", None, None]


def test_replies(spark):
    vals = ['x ```json\n{"titre": "T"}\n``` y', 'Oui {"titre": "U"} fin', '{"titre": ', "", "{a} {b}"]
    got = column(spark, vals, lambda c: replies.parse_reply(replies.json_text_safe(c))["titre"])
    assert got == ["T", "U", None, None, None]
    plan = [{"action": " a ", "responsable": "SPEAKER_03", "echeance": "", "type": "Engagement"},
            {"action": "b", "responsable": "x", "echeance": "y", "type": "odd"}, {"action": " ", "type": "engagement"},
            {"action": "c", "responsable": " Z ", "echeance": "j", "type": "engagement"}]
    df = spark.createDataFrame([(json.dumps({"plan": plan}),)], "raw string")
    items = df.select(replies.normalize_plan_items(replies.parse_reply(F.col("raw"))["plan"]).alias("p")).first().p
    assert [tuple(i) for i in items] == [("a", "—", "—", "engagement"), ("b", "—", "—", "suggestion"), ("c", "Z", "j", "engagement")]


def test_midpoint_alignment_edges(spark):
    segs = spark.createDataFrame([("m", 1.0, 2.0, "A"), ("m", 4.0, 5.0, "B")], "meeting_id string, start double, end double, speaker string")
    words = spark.createDataFrame(
        [("m", 0, "w", 0.0, 0.2, ""), ("m", 1, "w", 2.9, 3.1, ""), ("m", 2, "w", 2.8, 3.0, ""), ("m", 3, "w", 9.0, 9.2, ""), ("z", 0, "w", 1.0, 1.1, "")],
        "meeting_id string, word_idx long, word string, start double, end double, speaker string",
    )
    got = {(r.meeting_id, r.word_idx): r.speaker for r in alignment.align_words_midpoint(words, segs).collect()}
    assert got == {("m", 0): "A", ("m", 1): "B", ("m", 2): "A", ("m", 3): "B", ("z", 0): "SPEAKER_00"}


def test_boundary_snap_edges(spark):
    toks = ["a", "b.", "c", "d", "e.", "f", "g", "h"]
    words = spark.createDataFrame(
        [("m", i, w, float(i), i + 0.5, "") for i, w in enumerate(toks)],
        "meeting_id string, word_idx long, word string, start double, end double, speaker string",
    )
    ch = spark.createDataFrame([("m", -1.0, "A"), ("m", 2.5, "B"), ("m", 99.0, "C")], "meeting_id string, at double, speaker string")
    got = {r.speaker: r.i for r in alignment.boundary_snap(alignment.number_words(words), ch).collect()}
    # word 3 follows 2.5: the mark at 4 is one ahead, the one at 1 two behind
    assert got == {"A": 0, "B": 5}


def plain_turns(words):
    """Direct reading of the turn rules for one meeting."""
    turns, cur = [], []
    for w, s, e, spk in words:
        if cur and (spk != cur[0][3] or s - cur[-1][2] > 0.8):
            turns.append(cur)
            cur = []
        cur.append((w, s, e, spk))
        if len(cur) > 1:
            span = e - cur[0][1]
            if (w.endswith((".", "!", "?", "…")) and span >= 5) or span >= 30 or len(cur) >= 120:
                turns.append(cur)
                cur = []
    if cur:
        turns.append(cur)
    return [(t[0][1], t[-1][2], t[0][3], " ".join(x[0] for x in t)) for t in turns]


def random_words(seed, n, step=0.4, gap=0.02, stop=0.15):
    rng = random.Random(seed)
    t, out, spk = 0.0, [], "A"
    for i in range(n):
        if rng.random() < 0.03:
            spk = rng.choice("AB")
        t += 0.9 if rng.random() < gap else 0.0
        out.append((f"w{i}" + (rng.choice(".!?…") if rng.random() < stop else ""), t, t + step, spk))
        t += step
    return out


@pytest.mark.parametrize("seed,kw", [(1, {}), (2, {"stop": 0.0}), (3, {"step": 0.1, "stop": 0.0, "gap": 0.0})])
def test_turn_builder_against_plain(spark, seed, kw):
    words = random_words(seed, 700, **kw)
    df = spark.createDataFrame(
        [("m", i, *w) for i, w in enumerate(words)], "meeting_id string, word_idx long, word string, start double, end double, speaker string"
    )
    got = sorted((r.start, r.end, r.speaker, r.text) for r in transcripts.turn_builder(df).collect())
    assert got == sorted(plain_turns(words))


def test_turn_limits():
    def run(words):
        by_column = dict(zip(["word", "start", "end", "speaker"], map(np.array, zip(*words))))
        whole = live.Turns()
        out = whole.feed(by_column) + whole.close()
        single, parts = live.Turns(), []
        for i in range(len(words)):
            parts += single.feed({c: v[i : i + 1] for c, v in by_column.items()})
        assert parts + single.close() == out
        return out

    assert len(run([("a", 0.0, 1.0, "S"), ("b", 1.75, 2.0, "S")])) == 1  # gap below the limit
    assert len(run([("a", 0.0, 1.0, "S"), ("b", 1.81, 2.0, "S")])) == 2
    assert len(run([("a", 0.0, 1.0, "S"), ("b.", 1.0, 5.0, "S"), ("c", 5.0, 5.1, "S")])) == 2  # five seconds exactly
    assert [len(r[3].split()) for r in run([("w", i / 10, i / 10 + 0.1, "S") for i in range(121)])] == [120, 1]


def test_trigger_gaps(spark):
    turns = [(0, 5.9, "A", True, True), (1, 6.0, "A", True, True), (2, 11.0, "B", True, True), (3, 12.0, "B", True, True),
             (4, 131.9, "B", False, True), (5, 132.0, "B", False, False), (6, 400.0, "B", False, False), (7, 404.0, "A", True, True)]
    rule, plain = live.Trigger(), []
    for t in turns:
        plain += rule.feed({c: np.array([v]) for c, v in zip(["turn_idx", "now", "speaker", "is_other", "final"], t)})
    assert [f for _, f in plain] == [False, True, False, True, False, True, True, False]
    df = spark.createDataFrame([("m", *t) for t in turns], "meeting_id string, turn_idx int, now double, speaker string, is_other boolean, final boolean")
    assert sorted((r.turn_idx, r.fired) for r in live.live_trigger(df).collect()) == plain


def test_pricing_edges(spark):
    calls = spark.createDataFrame(
        [("r", 1, "m", 10, 0, 20, False), ("r", 2, "?", 10, 5, 0, False), ("r", 3, "m", 1000000, 0, 0, True)],
        "run_id string, seq int, model string, in_tok long, out_tok long, cached_in long, batch boolean",
    )
    prices = spark.createDataFrame([("m", 2.0, 1.0, 3.0), ("local", 0.0, 0.0, 0.0)], "model string, input double, cached_input double, output double")
    got = {r.seq: r.cost_usd for r in telemetry.price_calls(calls, prices).collect()}
    assert got == {1: pytest.approx(2e-05), 2: 0.0, 3: pytest.approx(1.0)}


def unit_rows(seed, n, labels, dim=6, meeting="m"):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return [(meeting, i, [float(x) for x in v[i]], int(labels[i % len(labels)])) for i in range(n)]


VEC = "meeting_id string, sub_idx int, embedding array<double>, label int"


def test_threshold_defaults(spark):
    rows = unit_rows(1, 3, [0, 1], meeting="few") + unit_rows(2, 6, [0], meeting="one")
    df = spark.createDataFrame(rows, VEC)
    got = {r.meeting_id: r.threshold for r in clusters.calibrate_threshold(df).collect()}
    assert got == {"few": 0.6, "one": 0.6}


def test_greedy_matches_plain(spark):
    rows = unit_rows(5, 60, [0])
    got = {r.sub_idx: r.label for r in clusters.cosine_greedy(spark.createDataFrame(rows, VEC), 0.4, 3).collect()}
    sums, counts = [], []
    for _, i, v, _ in rows:
        v = np.array(v)
        sims = [float(v @ (s / c)) / (np.linalg.norm(v) * np.linalg.norm(s / c) + 1e-10) for s, c in zip(sums, counts)]
        best = int(np.argmax(sims)) if sims else -1
        if best < 0 or (sims[best] < 0.4 and len(sums) < 3):
            sums.append(v.copy())
            counts.append(1)
            best = len(sums) - 1
        else:
            sums[best] += v
            counts[best] += 1
        assert got[i] == best


def test_close_centroids_merge(spark):
    rows = unit_rows(9, 40, [0, 1, 2, 3])
    got = {r.sub_idx: r.label for r in clusters.merge_close_centroids(spark.createDataFrame(rows, VEC), 0.9).collect()}
    emb, lab = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    while len(set(lab)) > 1:
        names = sorted(set(lab))
        c = np.array([emb[lab == k].mean(0) for k in names])
        c /= np.linalg.norm(c, axis=1, keepdims=True)
        pairs = [(1 - c[a] @ c[b], a, b) for a in range(len(names)) for b in range(a + 1, len(names))]
        d, a, b = min(pairs)
        if d > 0.9:
            break
        lab[lab == names[b]] = names[a]
    order = {k: i for i, k in enumerate(sorted(set(lab)))}
    assert [got[i] for i in range(40)] == [order[k] for k in lab]


def test_online_assignment(spark):
    rows = unit_rows(11, 50, [0, 1])
    df = spark.createDataFrame(rows, VEC)
    frozen = {r.sub_idx: r.label for r in clusters.bootstrap_online(df, 20, create=False).collect()}
    opened = {r.sub_idx: r.label for r in clusters.bootstrap_online(df, 20, create=True).collect()}
    assert len(frozen) == len(opened) == 50
    assert set(frozen.values()) <= {0, 1} and max(opened.values()) >= 1
    assert all(frozen[i] == rows[i][3] for i in range(20))


def voices(seed, n, k, spread, dim=12):
    rng = np.random.default_rng(seed)
    v = np.eye(dim)[np.arange(n) % k] + spread * rng.normal(size=(n, dim))
    return [("m", i, [float(x) for x in v[i]], int(i % k)) for i in range(n)]


def plain_chunks(n_segments, boundaries, lens, sims, limit):
    """Chunk starts after the recursive re-split, for segments that all have text and windows of three."""
    from math import exp

    w = [exp(-0.5 * (k / 2.0) ** 2) for k in range(-8, 9)]

    def smooth(x):
        if len(x) <= 3:
            return x
        n, out = len(x), []
        for i in range(n):
            acc = 0.0
            for k in range(-8, 9):
                j = (i + k) % (2 * n)
                acc += w[k + 8] * x[min(j, 2 * n - 1 - j)]
            out.append(acc / sum(w))
        return out

    def size(lo, hi):
        return sum(lens[lo:hi]) + hi - lo - 1

    def split(lo, hi, out):
        curve = smooth(sims[lo : hi - 3])
        at = lo + (curve.index(min(curve)) + 1 if curve else (hi - lo) // 2)
        for a, b in ((lo, at), (at, hi)):
            if size(a, b) > limit and b - a >= 4:
                split(a, b, out)
            else:
                out.append(a)

    starts, cuts = [], sorted({0, n_segments, *(b + 1 for b in boundaries)})
    for lo, hi in zip(cuts, cuts[1:]):
        if size(lo, hi) > limit and hi - lo >= 4:
            split(lo, hi, starts)
        else:
            starts.append(lo)
    return sorted(starts)


@pytest.mark.parametrize("rows_in_task", [65536, 6])
def test_resplit_against_plain(spark, rows_in_task):
    rng = np.random.default_rng(4)
    n, limit = 60, 400
    vec = rng.normal(size=(n, 5))
    vec /= np.linalg.norm(vec, axis=1, keepdims=True)
    texts = ["x" * int(k) for k in rng.integers(5, 90, n)]
    seg = spark.createDataFrame(
        [("m", i, float(i), i + 1.0, "S", texts[i], [float(x) for x in vec[i]]) for i in range(n)],
        "meeting_id string, seg_idx int, start double, end double, speaker string, text string, embedding array<double>",
    )
    bounds = spark.createDataFrame([("m", 24, 0.1)], "meeting_id string, win_idx int, smoothed double")
    placed = topics.named_by_first(topics.segment_parts(seg, bounds))
    out = topics.resplit_oversize(placed, limit, rows_in_task=rows_in_task).collect()
    sims = [float(vec[i] @ vec[i + 1]) for i in range(n - 1)]
    want = plain_chunks(n, [24], [len(t) + 5 for t in texts], sims, limit)
    assert sorted(r.seg_idx for r in out) == list(range(n))
    assert sorted({r.part for r in out}) == want


def test_min_distance_pick_rule(spark):
    pts = [(3, 0.5), (8, 0.4), (9, 0.45), (18, 0.9), (27, 0.1), (40, 0.2), (50, 0.3), (55, 0.1)]
    df = spark.createDataFrame([("m", i, v) for i, v in pts], "meeting_id string, win_idx int, smoothed double")
    kept, last = [], None
    for i, v in pts:
        if last is None or i - kept[-1][0] >= 10:
            kept.append((i, v))
        elif v < kept[-1][1]:
            kept[-1] = (i, v)
        last = i
    assert sorted((r.win_idx, r.smoothed) for r in topics.min_distance_pick(df).collect()) == kept


def test_folder_names_take_free_numbers(spark):
    new = spark.sql("select concat('j', id) id, id created_ms, timestamp_ntz'2024-05-19 14:00:00' created, 'Point' hint from range(3)")
    have = spark.createDataFrame([("2024-05-19_14h00m00s_Point",), ("2024-05-19_14h00m00s_Point_3",)], "folder string")
    got = [r.folder.rsplit("_", 1)[-1] for r in catalog.unique_folder_names(new, have).orderBy("id").collect()]
    assert got == ["2", "4", "5"]


def test_greedy_speaker_map(spark):
    df = spark.createDataFrame(
        [("m", "r1", "h1", 5.0), ("m", "r1", "h2", 4.0), ("m", "r2", "h1", 4.5), ("m", "r2", "h2", 1.0), ("n", "r1", "h9", 1.0)],
        "meeting_id string, r_spk string, h_spk string, overlap_s double",
    )
    got = sorted(tuple(r) for r in diarization.greedy_speaker_map(df).collect())
    assert got == [("m", "r1", "h1"), ("m", "r2", "h2"), ("n", "r1", "h9")]


def test_overlapping_segments_give_the_first_end_past_the_word(spark):
    """Literal cases: a word inside an earlier, longer segment is that speaker's; gaps go to the nearer edge."""
    from palaver.operators.alignment import align_words_midpoint

    segments = spark.createDataFrame(
        [("m", 0, 0.0, 10.0, "A"), ("m", 1, 2.0, 3.0, "B"), ("m", 2, 9.4, 20.0, "C"), ("m", 3, 30.0, 31.0, "D")],
        "meeting_id string, idx int, start double, end double, speaker string",
    )
    mids = [(2.5, "A"), (5.0, "A"), (9.6, "A"), (10.0, "C"), (22.0, "C"), (25.0, "D"), (29.0, "D"), (99.0, "D")]
    words = spark.createDataFrame(
        [("m", i, "w", t - 0.1, t + 0.1) for i, (t, _) in enumerate(mids)] + [("n", 0, "w", 0.0, 1.0)],
        "meeting_id string, word_idx int, word string, start double, end double",
    )
    found = {(r.meeting_id, r.word_idx): r.speaker for r in align_words_midpoint(words, segments).collect()}
    assert found == {("m", i): s for i, (_, s) in enumerate(mids)} | {("n", 0): "SPEAKER_00"}


def test_unicode_blanks(spark):
    """No-break spaces around colons and sentence ends, as in French text."""
    rows = spark.createDataFrame([("Ana\u00a0:\u00a0bonjour",), ("[00:05]\u00a0Léa\u202f:\u00a0oui\u00a0!\u00a0non\u00a0?\u2003si.",)], "line string")
    parsed = rows.select(F.expr("line"), text.parse_line(F.col("line"), F.lit(0)).alias("p")).collect()
    assert [(r["p"]["speaker"], r["p"]["text"]) for r in parsed] == [("Ana", "bonjour"), ("Léa", "oui\u00a0!\u00a0non\u00a0?\u2003si.")]
    found = rows.select(text.split_sentences(F.lit("oui\u00a0!\u00a0non\u00a0?\u2003si.")).alias("s")).first()["s"]
    assert found == ["oui\u00a0!", "non\u00a0?", "si."]


def test_entities(spark):
    body = "<p>&ecirc;tre &agrave; 20&deg; &#233;&#xE8; &amp;lt; &nbsp;&ocirc;</p>"
    got = spark.range(1).select(text.html_to_text(F.lit(body), F.lit("html"), F.lit("")).alias("t")).first()["t"]
    assert got == "être à 20° éè &lt; ô"


def test_suggestions(spark):
    rows = [("m", 1.0, [" a ", "A", "b", None, "", "c", "d"]), ("m", 2.0, ["D", "a"]), ("m", 3.0, None), ("m", 4.0, ["a", "b"])]
    rows += [("m", 5.0 + i, [f"x{i}"]) for i in range(3)] + [("m", 9.0, ["A"])]
    df = spark.createDataFrame(rows, "meeting_id string, ts double, items array<string>")
    got = sorted((r.ts, r.pos, r.item) for r in live.suggestion_dedup(df).collect())
    # the last four groups shown count: at 9.0 they are D, x0, x1 and x2
    assert got == [(1.0, 0, "a"), (1.0, 1, "b"), (1.0, 2, "c"), (2.0, 0, "D"), (5.0, 0, "x0"), (6.0, 0, "x1"), (7.0, 0, "x2"), (9.0, 0, "A")]
