"""Explicit schemas of the meeting tables; nothing is inferred."""

from __future__ import annotations

SEGMENTS = "meeting_id string, seg_idx int, start double, end double, speaker string, text string"
SEGMENT_DOC = "segments array<struct<start: double, end: double, speaker: string, text: string>>"
TURN = "start double, end double, speaker string, text string"
SPEAKER_DOC = "map<string, string>"
CALENDAR_DOC = (
    "value array<struct<id: string, subject: string, start: struct<dateTime: string, timeZone: string>, "
    "end: struct<dateTime: string, timeZone: string>, "
    "organizer: struct<emailAddress: struct<name: string, address: string>>, location: struct<displayName: string>, "
    "attendees: array<struct<type: string, emailAddress: struct<name: string, address: string>>>, "
    "isOnlineMeeting: boolean, onlineMeetingProvider: string, bodyPreview: string, "
    "body: struct<contentType: string, content: string>>>"
)
RESOURCES = (
    "timestamp string, uptime_s double, python_rss_mb double, python_vms_mb double, llama_rss_mb double, "
    "llama_pids string, system_used_mb double, system_available_mb double, system_percent double, swap_used_mb double, "
    "swap_percent double"
)
BREAKDOWN = (
    "architecture string, steps map<string, struct<calls: int, input_tokens: bigint, output_tokens: bigint, "
    "cached_input_tokens: bigint, latency_s: double, cost_usd: double, model: string, batch: boolean>>, "
    "total struct<input_tokens: bigint, output_tokens: bigint, cost_usd: double, latency_s: double>"
)
VARIANT = (
    "struct<chars_input: int, compress_s: double, resume_wall_s: double, resume_input_tok: int, resume_output_tok: int, "
    "extraction_wall_s: double, extraction_input_tok: int, extraction_output_tok: int, plan_wall_s: double, "
    "plan_input_tok: int, plan_output_tok: int, total_wall_s: double>"
)
TEAMS_RUNS = "meeting_id string, para_idx int, run_idx int, is_bold boolean, text string, is_break boolean"
