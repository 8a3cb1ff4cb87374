"""A stream gives what the batch twin gives, however rows fall into micro-batches."""

import uuid

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from test_rules import VEC, random_words, unit_rows

from palaver.operators import clusters, live, transcripts
from palaver.queries.streams import online_labels, silent_turns, with_end
from palaver.streaming import jobs


@pytest.mark.parametrize("slices", [2, 5])
def test_turns(spark, slices):
    rows = [(m, i, *w) for m, seed in (("a", 4), ("b", 5)) for i, w in enumerate(random_words(seed, 150))]
    df = spark.createDataFrame(rows, "meeting_id string, word_idx long, word string, start double, end double, speaker string")
    batch = sorted((r.meeting_id, r.start, r.text) for r in transcripts.turn_builder(df).collect())
    stream = jobs.run_to_table(jobs.build_turns(jobs.as_stream(with_end(df, "meeting_id", "word_idx"), ["word_idx"], slices=slices)))
    assert sorted((r.meeting_id, r.start, r.text) for r in stream.collect()) == batch


def plain_live_chunks(turns, vec, k_sigma, max_chars, min_turns):
    """Live chunk ends by absolute turn positions; ``vec[i]`` belongs to the window that ends at turn i."""
    ends, base, n = [], 0, 0
    curve, smooth, cand = [], [], []
    while n < len(turns):
        n += 1
        first = base + 2
        have = max(0, n - 2 - base)
        for w in range(len(curve) + 1 if have else 0, have):
            curve.append(float(vec[first + w - 1] @ vec[first + w]))
            tail = np.array(curve[-5:])
            g = np.exp(-0.5 * ((np.arange(len(tail)) - len(tail) + 1) / 2.0) ** 2)
            smooth.append(curve[-1] if len(curve) <= 2 else float((tail * g).sum() / g.sum()))
            recent = np.array(smooth[-20:])
            if len(smooth) >= 20 and smooth[-1] < recent.mean() - k_sigma * recent.std():
                cand.append((base + len(curve), smooth[-1]))
        if have:
            sure = []
            for at, v in list(cand):
                rel = at - base
                if len(smooth) - rel >= 5:
                    cand.remove((at, v))
                    if min(smooth[rel + 1 : rel + 5], default=v) >= v and at - base + 1 >= min_turns:
                        sure.append(at)
            for at in sure:
                if at >= base:
                    ends.append(at)
                    base = at + 1
                    curve, smooth, cand = [], [], []
        if sum(len(t[1]) + len(t[0]) + 4 for t in turns[base:n]) >= max_chars:
            ready = [(v, at) for at, v in cand if at - base + 1 >= min_turns]
            at = min(ready)[1] if ready else n - 1
            ends.append(at)
            base = at + 1
            curve, smooth, cand = [], [], []
    ready = [at for at, _ in cand if at - base + 1 >= min_turns]
    if ready:
        ends.append(ready[0])
        base = ready[0] + 1
    if base < len(turns):
        ends.append(len(turns) - 1)
    return ends


@pytest.mark.parametrize("max_chars", [10**9, 900])
def test_topic_chunker(spark, max_chars):
    rng = np.random.default_rng(8)
    n = 140
    vec = rng.normal(size=(n, 4)) + np.repeat(rng.normal(size=(n // 20, 4)) * 2, 20, axis=0)
    vec /= np.linalg.norm(vec, axis=1, keepdims=True)
    turns = [("S", "t" * int(k)) for k in rng.integers(3, 60, n)]
    df = spark.createDataFrame(
        [("m", i, float(i), i + 1.0, *turns[i], [float(x) for x in vec[i]]) for i in range(n)],
        "meeting_id string, seg_idx int, start double, end double, speaker string, text string, embedding array<double>",
    )
    want = plain_live_chunks(turns, vec, 1.0, max_chars, 10)
    batch = live.topic_chunker(df, 1.0, max_chars).orderBy("chunk_id").collect()
    assert [int(r.end_time) - 1 for r in batch] == want
    rows = with_end(df, "meeting_id", "seg_idx")
    stream = jobs.run_to_table(jobs.chunk_topics(jobs.as_stream(rows, ["seg_idx"], slices=4), 1.0, max_chars))
    assert [int(r.end_time) - 1 for r in stream.orderBy("chunk_id").collect()] == want


def test_end_reminder(spark):
    base = 1704067200000
    rows = [("j", 0, True, "e1", 60), ("j", 30, True, "e1", 60), ("j", 70, True, "e2", 90), ("j", 80, False, None, None), ("j", 200, True, "e3", 100), ("j", 300, True, "e4", 400), ("j", 500, True, "e4", 400)]
    df = spark.createDataFrame(rows, "job_id string, s int, recording boolean, event_id string, e int")
    states = df.select(
        "job_id", F.timestamp_millis(F.lit(base) + F.col("s") * 1000).alias("ts"), "recording", "event_id", (F.lit(base) + F.col("e") * 1000).alias("end_ms")
    )
    for slices in (1, 3):
        out = jobs.run_to_table(jobs.end_reminders(jobs.as_stream(states, ["ts"], "job_id", slices=slices)))
        assert sorted((r.event_id, (r.at_ms - base) // 1000) for r in out.collect()) == [("e1", 60), ("e4", 400)]


def test_a_slice_of_many_files_is_one_micro_batch(spark, monkeypatch):
    """No row of a slice comes behind the watermark that another of its files has moved, and batches do not grow with files."""
    monkeypatch.setattr(jobs, "ROWS_PER_FILE", 40)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        base = 1704067200000
        states = spark.range(600).select(
            F.concat(F.lit("j"), F.col("id") % 60).alias("job_id"), F.timestamp_millis(F.lit(base) + F.col("id") * 1000).alias("ts"), F.lit(True).alias("recording"),
            F.concat(F.lit("e"), F.floor(F.col("id") / 300)).alias("event_id"), (F.lit(base) + (F.floor(F.col("id") / 300) * 300 + 270) * 1000).alias("end_ms"),
        )
        out = jobs.run_to_table(jobs.end_reminders(jobs.as_stream(states, ["ts"], "job_id")))
        assert sorted((r.job_id, r.event_id, (r.at_ms - base) // 1000) for r in out.collect()) == sorted((f"j{i}", e, t) for i in range(60) for e, t in (("e0", 270), ("e1", 570)))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.mark.parametrize("slices", [1, 3])
def test_words_after_an_end_mark(spark, slices):
    rows = [("m", 0, "a", 0.0, 0.4, "S", False), ("m", 1, None, None, None, None, True), ("m", 2, "b", 1.0, 1.4, "S", False), ("m", 3, None, None, None, None, True)]
    df = spark.createDataFrame(rows, "meeting_id string, word_idx long, word string, start double, end double, speaker string, ended boolean")
    out = jobs.run_to_table(jobs.build_turns(jobs.as_stream(df, ["word_idx"], slices=slices)))
    assert sorted(r.text for r in out.collect()) == ["a", "b"]


@pytest.mark.parametrize("slices", [1, 4])
def test_online_clusterer_labels_every_vector(spark, slices):
    """The bootstrap vectors too, and a meeting that ends within the bootstrap."""
    df = spark.createDataFrame(unit_rows(11, 50, [0, 1], meeting="long") + unit_rows(12, 7, [0, 1, 2], meeting="short"), VEC)
    want = sorted((r.meeting_id, r.sub_idx, r.label) for r in clusters.bootstrap_online(df, 20, create=False).collect())
    assert len(want) == 57
    assert sorted((r.meeting_id, r.sub_idx, r.label) for r in online_labels(df, 20, slices=slices).collect()) == want


def test_bootstrap_tables_are_not_broadcast(spark):
    df = spark.createDataFrame(unit_rows(11, 30, [0, 1], meeting="a"), VEC)
    boot = clusters.bootstrap(df, 20)
    setup = clusters.centroids(boot).select("meeting_id", "centroid")
    plan = jobs.with_setup(df.select("meeting_id", "sub_idx", "embedding"), setup, boot)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("slices", [1, 3, 7])
def test_silent_meetings_are_closed_by_the_watermark(spark, slices):
    rows = [(m, i, *w) for m, seed in (("a", 4), ("b", 5)) for i, w in enumerate(random_words(seed, 60))]
    df = spark.createDataFrame(rows, "meeting_id string, word_idx long, word string, start double, end double, speaker string")
    batch = sorted((r.meeting_id, r.start, r.text) for r in transcripts.turn_builder(df).collect())
    got = silent_turns(df, slices=slices)
    assert sorted((r.meeting_id, r.start, r.text) for r in got.collect()) == batch
    open_still = silent_turns(df, beat=1, slices=slices).collect()  # the watermark stays inside the ten minutes
    assert len(open_still) == len(batch) - 2


@pytest.mark.parametrize("slices", [1, 3])
def test_a_pause_closes_before_the_row_behind_it(spark, slices):
    """Words of one turn by their times, but sent a quarter of an hour apart."""
    rows = [("m", i, w, i / 2, i / 2 + 0.4, "S", s) for i, (w, s) in enumerate([("a", 0), ("b", 1), ("c", 900), ("d", 901)])] + [("~", 9, "", 9.0, 9.0, "?", 9000)]
    df = spark.createDataFrame(rows, "meeting_id string, word_idx long, word string, start double, end double, speaker string, s long")
    df = df.withColumn("ts", F.timestamp_seconds(F.col("s") + 60)).drop("s")
    out = jobs.run_to_table(jobs.build_turns(jobs.as_stream(df, ["ts"], slices=slices), 600_000))
    assert sorted(r.text for r in out.collect()) == ["a b", "c d"]


@pytest.mark.parametrize("slices", [1, 3, 7])
def test_due_notices(spark, slices):
    """Told at its time by timer or row, once; taken back by a recording; too early, too late, told before, recorded first."""
    minute, base = 60, 1704067200
    rows = [
        ("c", 0, False, "timer", 30), ("c", 1, False, "timer", 30), ("c", 2, False, "back", 40), ("c", 3, False, "far", 500),
        ("c", 10, True, "back", None), ("c", 11, False, "back", 40), ("c", 20, True, "before", None), ("c", 21, False, "before", 50),
        ("c", 22, False, "old", 50), ("c", 30, False, "now", 34), ("c", 30, True, "now2", None), ("c", 30, False, "now2", 35), ("c", 40, False, "late", 41),
        ("c", 45, True, "timer", None), ("c", 46, False, None, 60), ("c", 47, False, "", 60), ("c", 48, False, "no start", None),
        ("d", 5, False, "other", 30), ("d", 5, False, "pair", 30), ("d", 6, True, "pair", None), ("d", 7, False, "open", 66), ("d", 60, False, None, None),
    ]
    df = spark.createDataFrame(rows, "calendar_id string, m int, recorded boolean, event_id string, start int")
    df = df.select("calendar_id", F.timestamp_seconds(F.col("m") * minute + base).alias("ts"), "recorded", "event_id", ((F.col("start").cast("long") * minute + base) * 1000).alias("start_ms"))
    told = spark.createDataFrame([("c", "old", (40 * minute + base) * 1000)], "calendar_id string, event_id string, at_ms long")
    out = jobs.run_to_table(jobs.due_notices(jobs.as_stream(df, ["ts"], "calendar_id", slices=slices), told)).collect()
    assert sorted((r.calendar_id, r.event_id, (r.at_ms // 1000 - base) // minute) for r in out) == [("c", "now", 30), ("c", "timer", 25), ("d", "other", 25)]


def test_silent_meetings_end_their_topic_chunks(spark):
    """As with an end row, in several micro-batches."""
    rng = np.random.default_rng(9)
    unit = rng.normal(size=(40, 4))
    vec = unit / np.linalg.norm(unit, axis=1, keepdims=True)
    rows = [("m", i, float(i), i + 1.0, "S", "t" * 30, [float(x) for x in vec[i]], i + 60) for i in range(40)]
    rows.append(("~", 40, 40.0, 41.0, "S", "t", [1.0, 0.0, 0.0, 0.0], 9000))
    df = spark.createDataFrame(rows, "meeting_id string, seg_idx int, start double, end double, speaker string, text string, embedding array<double>, s long")
    want = [tuple(r) for r in live.topic_chunker(df.filter("meeting_id = 'm'").drop("s"), 1.0, 400).select("chunk_id", "end_time", "text").orderBy("chunk_id").collect()]
    stream = jobs.as_stream(df.withColumn("ts", F.timestamp_seconds("s")).drop("s"), ["ts"], slices=3)
    got = jobs.run_to_table(jobs.chunk_topics(stream, 1.0, 400, idle=600_000)).select("chunk_id", "end_time", "text").orderBy("chunk_id")
    assert [tuple(r) for r in got.collect()] == want and len(want) > 1


def state_calls(stream):
    """Rows of a stream that is run to its end, and how often its state was read or written."""
    spark = stream.sparkSession
    base = f"{jobs.shared_dir(spark)}/counted-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start(f"{base}/rows")
    q.awaitTermination()
    metrics = [op.customMetrics for p in q.recentProgress for op in p.stateOperators]
    return spark.read.schema(stream.schema).parquet(f"{base}/rows").count(), sum(m[f"rocksdb{call}Count"] for m in metrics for call in ("Get", "Put"))


def plain_notices(rows, told, last):
    """Notices of (calendar, ms, recorded, event, start_ms) rows, calendar by calendar; ``last`` is the time of the last row of all."""
    out = []
    for calendar in {r[0] for r in rows}:
        known = {e: (at, True) for c, e, at in told if c == calendar}

        def tell(until):
            for e, (at, done) in known.items():
                if not done and at <= until:
                    out.append((calendar, e, at))
                    known[e] = (at, True)

        for _, ms, recorded, event, start in sorted((r for r in rows if r[0] == calendar), key=lambda r: (r[1], not r[2])):
            tell(ms)
            if recorded and not known.get(event, (0, False))[1]:
                known[event] = (ms, True)
            elif not recorded and event not in known and -60_000 <= start - 300_000 - ms <= 3_600_000:
                known[event] = (max(start - 300_000, ms), False)
                tell(ms)
        tell(last)
    return out


@pytest.mark.parametrize("slices", [1, 4])
def test_notices_of_calendars_that_share_a_bucket(spark, monkeypatch, slices):
    """Each calendar by its own rows, one without a name too, and whatever number of Arrow batches a bucket comes in."""
    monkeypatch.setattr(jobs, "STATE_BUCKETS", 2, raising=False)
    rng = np.random.default_rng(21)
    base, names = 1704067200000, [*(f"c{i}" for i in range(11)), None]
    rows = []
    for _ in range(400):
        ms, event = base + int(rng.integers(0, 7200)) * 1000, int(rng.integers(0, 8))
        rows.append((names[rng.integers(0, 12)], ms, bool(rng.random() < 0.15), f"e{event}", base + 1_000_000 * (event + 1)))
    told = [(n, "e3", base + 3_700_000) for n in names[:8] if n] + [(n, "e4", base + 4_700_000) for n in names[4:9] if n]
    df = spark.createDataFrame(rows, "calendar_id string, ms long, recorded boolean, event_id string, start_ms long")
    df = df.select("calendar_id", F.timestamp_millis("ms").alias("ts"), "recorded", "event_id", "start_ms")
    earlier = spark.createDataFrame(told, "calendar_id string, event_id string, at_ms long")
    want = plain_notices(rows, told, max(r[1] for r in rows))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = jobs.run_to_table(jobs.due_notices(jobs.as_stream(df, ["ts"], "calendar_id", slices=slices), earlier, delay="0 seconds")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(want) > 20
    assert sorted(map(str, out)) == sorted(str(Row(calendar_id=c, event_id=e, at_ms=at)) for c, e, at in want)


def test_notices_read_state_by_the_bucket(spark, monkeypatch):
    """Not by the row, the event or the calendar: F1."""
    monkeypatch.setattr(jobs, "STATE_BUCKETS", 4, raising=False)
    rows = spark.range(3000).select(
        F.concat(F.lit("c"), F.col("id") % 300).alias("calendar_id"), F.timestamp_millis(F.lit(1704067200000) + F.col("id") * 1000).alias("ts"), F.lit(False).alias("recorded"),
        F.concat(F.lit("e"), F.floor(F.col("id") / 1000)).alias("event_id"), (F.lit(1704067200000) + (F.floor(F.col("id") / 1000) + 1) * 1_000_000 + 100_000).alias("start_ms"),
    )
    told = rows.filter("event_id = 'e1'").select("calendar_id", "event_id", (F.col("start_ms") - 300_000).alias("at_ms")).distinct()
    n, calls = state_calls(jobs.due_notices(jobs.as_stream(rows, ["ts"], "calendar_id"), told, delay="0 seconds"))
    assert n == 600  # two of three events: the middle one was told before
    assert calls < 300


def plain_reminders(rows, last):
    out = []
    for job in {r[0] for r in rows}:
        now = None
        for _, ms, recording, event, end in [*sorted((r for r in rows if r[0] == job), key=lambda r: r[1]), (job, last, None, None, None)]:
            if now and now[2] and now[1] <= ms:
                out.append((job, *now[:2]))
                now = (*now[:2], False)
            if not (recording and event and end is not None):
                now = None
            elif now is None or now[0] != event:
                now = (event, end, end > ms)
    return out


@pytest.mark.parametrize("slices", [1, 4])
def test_reminders_of_jobs_that_share_a_bucket(spark, monkeypatch, slices):
    """Each job by its own rows, one without a name too; times are told apart, so the order is known."""
    monkeypatch.setattr(jobs, "STATE_BUCKETS", 2, raising=False)
    rng = np.random.default_rng(22)
    base, names = 1704067200000, [*(f"j{i}" for i in range(11)), None]
    rows = []
    for i, name in enumerate(rng.integers(0, 12, 500)):
        event = i // 60 + int(rng.integers(0, 2))
        kind = rng.random()
        rows.append((names[name], base + i * 1000 + 500, bool(kind > 0.08), None if kind > 0.95 else f"e{event}", None if 0.9 < kind < 0.93 else base + (event * 60 + 45) * 1000))
    df = spark.createDataFrame(rows, "job_id string, ms long, recording boolean, event_id string, end_ms long")
    df = df.select("job_id", F.timestamp_millis("ms").alias("ts"), "recording", "event_id", "end_ms")
    want = plain_reminders(rows, max(r[1] for r in rows))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = jobs.run_to_table(jobs.end_reminders(jobs.as_stream(df, ["ts"], "job_id", slices=slices))).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(want) > 20
    assert sorted(map(str, out)) == sorted(str(Row(job_id=j, event_id=e, at_ms=at)) for j, e, at in want)


def test_reminders_read_state_by_the_bucket(spark, monkeypatch):
    """Not by the row or the job: F2."""
    monkeypatch.setattr(jobs, "STATE_BUCKETS", 4, raising=False)
    states = spark.range(3000).select(
        F.concat(F.lit("j"), F.col("id") % 300).alias("job_id"), F.timestamp_millis(F.lit(1704067200000) + F.col("id") * 1000).alias("ts"), F.lit(True).alias("recording"),
        F.concat(F.lit("e"), F.floor(F.col("id") / 1000)).alias("event_id"), (F.lit(1704067200000) + (F.floor(F.col("id") / 1000) * 1000 + 900) * 1000).alias("end_ms"),
    )
    n, calls = state_calls(jobs.end_reminders(jobs.as_stream(states, ["ts"], "job_id")))
    assert n == 900
    assert calls < 300
