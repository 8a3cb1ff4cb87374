"""What is shuffled and how rows are dealt, for chains that run on large tables."""

import re

import numpy as np
import pytest

from palaver.operators import alignment, topics, transcripts
from palaver.plans import rows
from palaver.plans.scans import by_index, scan
from palaver.queries import tables


def exchanges(df):
    """Input columns and partitioning of each exchange of the plan."""
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*?)\]\nArguments: (.*?)\n", plan, re.S)


def topic_rows(spark, folder, vec_ids):
    docs = [(i, None if i == 7 else f"text {i} " * (1 + i % 5), "fr" if i % 2 else None) for i in range(120)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{folder}/documents.parquet")
    rng = np.random.default_rng(1)
    vectors = [(v, rng.normal(size=8).tolist()) for v in vec_ids]
    spark.createDataFrame(vectors, "vec_id long, embedding array<double>").write.parquet(f"{folder}/embeddings.parquet")
    return tables.topic_segments(spark, folder)


def test_text_is_shuffled_at_the_end_only(spark, tmp_path):
    segments = topic_rows(spark, str(tmp_path), [*range(40), None, None])
    assert "Join" not in segments.select("meeting_id", "text")._jdf.queryExecution().optimizedPlan().toString()
    chunks = topics.topic_chunks(segments, max_chars=100)
    with_text = [x for x, _ in exchanges(chunks) if re.search(r"\b(text|line)#", x)]
    assert len(with_text) <= 2
    got = chunks.collect()
    assert sum(r.n_segments for r in got) == 120 and all(len(r.text) == r.n_chars for r in got)


def test_vectors_with_the_same_number_all_count(spark, tmp_path):
    segments = topic_rows(spark, str(tmp_path), [0, 0, 1, 2, 3])
    assert segments.count() == segments.select("text").count() == 120 + 24


def test_words_are_shuffled_by_slices_only(spark):
    words = spark.createDataFrame(
        [("m", i, "end." if i % 5 == 4 else "word", 0.5 * (i // 2), 0.5 * (i // 2) + 0.5, "x") for i in range(60)],
        "meeting_id string, word_idx long, word string, start double, end double, speaker string",
    )
    segs = spark.createDataFrame(
        [("m", i, 3.0 * i, 3.0 * i + 3.0, f"s{i % 2}") for i in range(6)],
        "meeting_id string, idx int, start double, end double, speaker string",
    )
    numbered = alignment.number_words(words)
    snapped = alignment.boundary_snap(numbered, alignment.change_points(segs))
    dealt = [how for _, how in exchanges(snapped)]
    assert dealt and not [how for how in dealt if not re.match(r"hashpartitioning\(meeting_id#\d+, (_slice#\d+L, )?\d+\)", how)]
    # each change goes behind the nearest closed word within five seconds, counted in words, the later one on a tie
    ref = {0.0: 2, 3.0: 14, 6.0: 26, 9.0: 38, 12.0: 50, 15.0: None}
    expected = {}
    for at, r in ref.items():
        if r is not None:
            ahead, behind = r + (4 - r) % 5, r - 1 - (r - 5) % 5
            expected[at] = (ahead if behind < 0 or ahead - r <= r - behind else behind) + 1
    assert {r["at"]: r["i"] for r in snapped.collect()} == expected
    out = alignment.align_words_boundary(words, segs).orderBy("word_idx").collect()
    turns = sorted((i, f"s{int(at / 3) % 2}") for at, i in expected.items())
    assert [r.speaker for r in out] == [([s for i, s in turns if i <= k] or ["s0"])[-1] for k in range(60)]


@pytest.mark.parametrize("seed", [1, 2])
def test_tokens_are_dealt_by_their_number(spark, monkeypatch, seed):
    monkeypatch.setattr(rows, "ROWS_IN_TASK", 20, raising=False)
    rng = np.random.default_rng(seed)
    toks = ["▁he", "llo", ".", " you", "▁", "...", "a", " "]
    given = [(m, 3 * i, toks[rng.integers(len(toks))], float(i)) for m in ("a", "b") for i in range(200)]
    given += [("c", 0, ".", 0.0), ("c", 1, "▁", 1.0), (None, 0, "▁he", 0.0), ("d", 9000, "llo", 1.0), ("d", 1, "!", 0.0)]
    df = spark.createDataFrame(given, "meeting_id string, tok_idx long, tok string, ts double")
    out = transcripts.tokens_to_words(df)
    assert out.rdd.getNumPartitions() >= 20

    expected = []
    for m in ("a", "b", "c", "d"):
        mine = sorted(x[1:] for x in given if x[0] == m)
        words = []  # text, start, marks, end
        for _, tok, ts in mine:
            if tok in transcripts.PUNCTUATION_TOKENS:
                if len(words) > 1:
                    words[-2][2] += tok
                    words[-2][3] = ts + transcripts.TOKEN_TAIL_S
            elif tok not in (" ", "▁"):
                if tok[0] in " ▁" or not words:
                    words.append([tok.lstrip(" ▁"), ts, "", None])
                else:
                    words[-1][0] += tok
        for k, (word, start, marks, end) in enumerate(words):
            later = words[k + 1][1] if k + 1 < len(words) else mine[-1][2] + transcripts.TOKEN_TAIL_S
            expected.append((m, k, word + marks, start, later if end is None else end))
    assert sorted(map(tuple, out.collect())) == sorted(expected)


def test_scan_of_the_earliest_value(spark):
    rng = np.random.default_rng(3)
    values = [None if rng.random() < 0.7 else int(rng.integers(9)) for _ in range(50)]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "k int, i int, v int")
    out = scan(df, ["k"], ["i"], by_index("i", 7), {"f": ("first", "v"), "l": ("last", "v")}, tasks=3).orderBy("i").collect()
    seen = [[v for v in values[: i + 1] if v is not None] for i in range(50)]
    assert [(r.f, r.l) for r in out] == [(x[0], x[-1]) if x else (None, None) for x in seen]
