"""Readers on small hand-written files."""

import json

from palaver.sources import readers


def put(path, body):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(body, encoding="utf-8")


def test_transcript_counts_blank_lines(spark, tmp_path):
    put(tmp_path / "m1" / "t.txt", "A: one\n\nB: two\n")
    got = sorted((r.meeting_id, r.line_no, r.raw) for r in readers.transcript_lines(spark, str(tmp_path)).collect())
    assert got == [("m1", 0, "A: one"), ("m1", 2, "B: two")]


def test_transcript_split_file(spark, tmp_path):
    put(tmp_path / "m1" / "t.txt", "".join(f"S: line {i}\n" for i in range(2000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = readers.transcript_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.line_no, r.raw) for r in rows) == [(i, f"S: line {i}") for i in range(2000)]


def test_meeting_tree(spark, tmp_path):
    root = tmp_path / "root"
    for p in ("a/audio.wav", "a/compte_rendu.md", "a/transcript.txt", "a/.calendar_event.json", "cat/b/transcript.raw.txt", "cat/c/notes.txt", "cat/d/e/audio.mp3"):
        put(root / p, "x")
    got = {r.label: (r.folder, r.source, r.origin, r.status, r.transcript) for r in readers.meeting_tree(spark, str(root)).collect()}
    assert got == {"a": (None, "audio", "upload", "done", "transcript.txt"), "b": ("cat", "transcript", "upload", "queued", None)}


def test_json_documents(spark, tmp_path):
    put(tmp_path / "s" / "m" / "d.json", json.dumps({"segments": [{"end": 2.0, "speaker": "A", "text": "x"}, {"start": 1.5, "text": "y"}]}, indent=1))
    rows = readers.segments_json(spark, str(tmp_path / "s")).orderBy("pos").collect()
    assert [(r.meeting_id, r.start, r.speaker) for r in rows] == [("m", 0.0, "A"), ("m", 1.5, None)]
    put(tmp_path / "t" / "m" / "turns.json", json.dumps([{"start": 0.0, "end": 1.0, "speaker": "S0", "text": "hi"}]))
    put(tmp_path / "t" / "m" / "speakers.json", json.dumps({"S0": "Ada"}))
    turns, names = readers.turns_json(spark, str(tmp_path / "t")), readers.speakers_json(spark, str(tmp_path / "t"))
    met = spark.createDataFrame([("m",), ("n",)], "meeting_id string")
    got = {r.meeting_id: (r.has_turns, r.name) for r in readers.job_turns(met, turns, names).collect()}
    assert got == {"m": (True, "Ada"), "n": (False, None)}


def test_calendar_and_telemetry(spark, tmp_path):
    event = {
        "id": "1", "subject": "", "start": {"dateTime": "2026-05-19T14:00:00.0000000", "timeZone": "Z"}, "isOnlineMeeting": True,
        "attendees": [{"type": "resource", "emailAddress": {"name": "Room"}}, {"type": "required", "emailAddress": {"name": "", "address": "a@b.c"}}],
        "body": {"contentType": "html", "content": "<style>x</style><p>Hi&nbsp;&amp; bye</p>\n\n\n<b>z</b>"},
    }
    put(tmp_path / "c" / "cal.json", json.dumps({"value": [event]}, indent=1))
    r = readers.calendar_json(spark, str(tmp_path / "c")).first()
    assert (r.subject, r.is_online, r.preview, [tuple(a) for a in r.attendees]) == ("(sans objet)", True, "Hi & bye\nz", [("a@b.c", "a@b.c")])
    put(tmp_path / "r" / "x.csv", "timestamp,uptime_s,python_rss_mb,python_vms_mb,llama_rss_mb,llama_pids,system_used_mb,system_available_mb,system_percent,swap_used_mb,swap_percent\n2026-01-01T00:00:00,1.5,2,3,4,\"7,8\",1,1,1,1,1\n")
    assert readers.resource_csv(spark, str(tmp_path / "r")).first().llama_pids == [7, 8]
    put(tmp_path / "b" / "run1" / "breakdown.json", json.dumps({"architecture": "x", "steps": {"s": {"calls": 2, "model": "m"}}, "total": {"cost_usd": 0.5}}, indent=1))
    b = readers.run_breakdown(spark, str(tmp_path / "b")).first()
    assert (b.run_id, b.step, b.calls, b.run_cost_usd) == ("run1", "s", 2, 0.5)
