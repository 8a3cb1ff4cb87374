"""String rules for transcripts, labels, reports and message bodies, as Column expressions."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from palaver.functions.numbers import fixed

# --- fixed values -----------------------------------------------------------------------------------------------
# blanks of Unicode text, the no-break space among them, as characters and as a class of regular expressions
BLANK = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
BLANK_CLASS = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
ABBREVIATION_STEMS = (
    "M", "Mme", "Mlle", "Dr", "Pr", "St", "Ste", "cf", "ex", "etc", "p", "pp", "n°", "No", "vs", "env",
)
QUESTION_CUES = (
    "est-ce que", "est ce que", "qu'est", "qu est", "c'est quoi", "comment", "pourquoi", "quel", "quelle", "quels",
    "quelles", "qui", "quand", "combien", "où", "peux-tu", "pouvez-vous", "pourriez", "pourrais", "avez-vous", "as-tu",
)
PUBLIC_MAIL_HOSTS = (
    "gmail.com", "outlook.com", "hotmail.com", "hotmail.fr", "live.com", "yahoo.com", "yahoo.fr", "icloud.com",
    "orange.fr", "free.fr", "wanadoo.fr", "sfr.fr", "laposte.net", "protonmail.com", "proton.me",
)
RESERVED_LABELS = ("CON", "PRN", "AUX", "NUL", *(f"{p}{i}" for p in ("COM", "LPT") for i in range(1, 10)))
AUTO_LABEL = r"^\d{4}-\d{2}-\d{2}_\d{2}h\d{2}m\d{2}s"

# transcript line grammars, tried in this order; (?d) keeps "." to everything but a newline
LINE_RANGE = r"(?d)^\[(\d{2}):(\d{2}(?:\.\d+)?)\s*-\s*(\d{2}):(\d{2}(?:\.\d+)?)\]\s+(.+?)\s*:\s+(.*)"
LINE_LONG = r"(?d)^\[(\d{2}):(\d{2}):(\d{2})\]\s+(.+?):\s+(.*)"
LINE_SHORT = r"(?d)^\[(\d{2}):(\d{2})\]\s+\*{0,2}(.+?)\*{0,2}:\s+(.*)"
LINE_BARE = r"(?d)^(.+?):\s+(.+)$"
LOOSE_RANGE = r"(?d)^\[[\d:.]+\s*-\s*[\d:.]+\]\s+(.+?)\s*:\s*(.*)"
# ----------------------------------------------------------------------------------------------------------------


def unicode_blanks(pattern: str) -> str:
    """The pattern with ``\\s`` for every blank of Unicode, which Java's own leaves out. Not for use inside a class."""
    return pattern.replace(r"\s", BLANK_CLASS)


LINE_RANGE, LINE_LONG, LINE_SHORT, LINE_BARE, LOOSE_RANGE = map(unicode_blanks, (LINE_RANGE, LINE_LONG, LINE_SHORT, LINE_BARE, LOOSE_RANGE))


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(BLANK))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(BLANK))


def is_blank(text: Column) -> Column:
    return text.isNull() | (strip(text) == "")


def hard_wrap(text: Column, max_chars: int) -> Column:
    """Pieces of at most ``max_chars``: cut at the last space before the limit, at the limit when there is none."""
    piece = (
        rf"(?s)\G{BLANK_CLASS}*(.{{1,{max_chars}}}\z|.{{1,{max_chars - 1}}}(?= )|.{{{max_chars}}})"
    )
    return F.transform(F.regexp_extract_all(text, F.lit(piece), F.lit(1)), strip)


def split_sentences(text: Column, max_chars: int | None = None) -> Column:
    """Sentences of a text. A full stop after an abbreviation stem does not end one, wherever the stem stands."""
    stems = "|".join(ABBREVIATION_STEMS)
    parts = F.split(text, rf"(?<=[.!?])(?<!(?:{stems})\.){BLANK_CLASS}+")
    sentences = F.filter(F.transform(parts, strip), lambda s: s != "")
    if max_chars:
        sentences = F.flatten(
            F.transform(
                sentences,
                lambda s: F.when(F.length(s) > max_chars, hard_wrap(s, max_chars)).otherwise(F.array(s)),
            )
        )
    return F.coalesce(sentences, F.array().cast("array<string>"))


def parse_line(line: Column, line_no: Column) -> Column:
    """STRUCT<kind, start, end, speaker, text> of one transcript line; NULL when no grammar matches."""
    line = strip(line)

    def part(pattern: str, group: int) -> Column:
        return F.regexp_extract(line, pattern, group)

    def number(pattern: str, group: int) -> Column:
        return part(pattern, group).try_cast("double")

    def segment(kind: str, start: Column, end: Column, speaker: Column, text: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"),
            start.alias("start"),
            end.alias("end"),
            strip(speaker).alias("speaker"),
            strip(text).alias("text"),
        )

    long_start = number(LINE_LONG, 1) * 3600 + number(LINE_LONG, 2) * 60 + number(LINE_LONG, 3)
    short_start = number(LINE_SHORT, 1) * 60 + number(LINE_SHORT, 2)
    return (
        F.when(
            line.rlike(LINE_RANGE),
            segment(
                "range",
                number(LINE_RANGE, 1) * 60 + number(LINE_RANGE, 2),
                number(LINE_RANGE, 3) * 60 + number(LINE_RANGE, 4),
                part(LINE_RANGE, 5),
                part(LINE_RANGE, 6),
            ),
        )
        .when(
            line.rlike(LINE_LONG),
            segment(
                "long", long_start, default_end(long_start, part(LINE_LONG, 5)), part(LINE_LONG, 4), part(LINE_LONG, 5)
            ),
        )
        .when(
            line.rlike(LINE_SHORT),
            segment(
                "short",
                short_start,
                default_end(short_start, part(LINE_SHORT, 4)),
                part(LINE_SHORT, 3),
                part(LINE_SHORT, 4),
            ),
        )
        .when(
            line.rlike(LINE_BARE),
            segment(
                "bare",
                line_no.cast("double"),
                (line_no + 1).cast("double"),
                part(LINE_BARE, 1),
                part(LINE_BARE, 2),
            ),
        )
    )


def default_end(start: Column, raw_text: Column) -> Column:
    """End of a line without one; the length counts the text before stripping."""
    return start + F.greatest(F.length(raw_text) * F.lit(0.05), F.lit(1.0))


def normalized_lines(line: Column, max_chars: int | None = 300) -> Column:
    """``speaker: sentence`` lines of one input line; a line no grammar reads is kept as it is."""
    line = rstrip(line)

    def rendered(pattern: str, speaker: int, text: int) -> Column:
        prefix = F.concat(strip(F.regexp_extract(line, pattern, speaker)), F.lit(": "))
        return F.transform(
            split_sentences(F.regexp_extract(line, pattern, text), max_chars), lambda s: F.concat(prefix, s)
        )

    return (
        F.when(is_blank(line), F.array().cast("array<string>"))
        .when(line.rlike(LOOSE_RANGE), rendered(LOOSE_RANGE, 1, 2))
        .when(line.rlike(LINE_LONG), rendered(LINE_LONG, 4, 5))
        .when(line.rlike(LINE_SHORT), rendered(LINE_SHORT, 3, 4))
        .when(line.rlike(LINE_BARE), rendered(LINE_BARE, 1, 2))
        .otherwise(F.array(line))
    )


def teams_timestamp(raw: Column) -> Column:
    """``m:ss`` or ``h:mm:ss`` to ``hh:mm:ss``; NULL otherwise."""
    parts = F.split(raw, ":")
    two = F.concat_ws(":", F.lit("00"), F.lpad(parts[0], 2, "0"), F.get(parts, F.lit(1)))
    three = F.concat_ws(":", F.lpad(parts[0], 2, "0"), F.get(parts, F.lit(1)), F.get(parts, F.lit(2)))
    return F.when(
        raw.rlike(r"^\d{1,2}(?::\d{2}){1,2}$"), F.when(F.size(parts) == 2, two).otherwise(three)
    )


def sanitize_label(raw: Column) -> Column:
    kept = F.regexp_replace(strip(F.coalesce(raw, F.lit(""))), r'[<>:"/\\|?*\x00-\x1f]', "")
    kept = F.trim(kept, F.lit(". "))
    named = F.when(F.upper(kept).isin(*RESERVED_LABELS), F.concat(F.lit("_"), kept)).otherwise(kept)
    return F.substring(named, 1, 200)


def unescape_md(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\`*_{}\[\]()#+\-.!|>])", "$1")


def md_cell(text: Column) -> Column:
    return strip(F.replace(F.replace(text, F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit("\\|")))


def escape_pipes(text: Column) -> Column:
    return F.replace(text, F.lit("|"), F.lit("\\|"))


@F.pandas_udf(StringType())
def _unescaped(text: pd.Series) -> pd.Series:
    """Named and numeric entities of HTML decoded."""
    return text.map(html.unescape, na_action="ignore")


def html_to_text(content: Column, content_type: Column, preview: Column) -> Column:
    """Plain text of a message body; scripts and styles go first, then tags, then entities, then spare blanks."""
    raw = strip(F.coalesce(content, F.lit("")))
    text = F.regexp_replace(raw, r"(?is)<(script|style)\b[^>]*>.*?</\1>", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]+>", " ")
    text = _unescaped(text)
    text = F.regexp_replace(text, "[ \t ]+", " ")
    text = F.regexp_replace(text, unicode_blanks(r"\s*\n\s*"), "\n")
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    return (
        F.when(raw == "", strip(F.coalesce(preview, F.lit(""))))
        .when(F.lower(F.coalesce(content_type, F.lit(""))) == "html", strip(text))
        .otherwise(raw)
    )


def looks_like_question(text: Column) -> Column:
    low = F.lower(strip(F.coalesce(text, F.lit(""))))
    head = F.substring(low, 1, 45)
    cue = F.lit(False)
    for word in QUESTION_CUES:
        cue = cue | head.startswith(word) | head.contains(" " + word)
    return (low != "") & (low.endswith("?") | cue)


def display_name(label: Column, subject: Column, fallback: Column) -> Column:
    """Calendar subject for an unnamed or auto-dated meeting, else the label, else the subject, else the fallback."""
    label, subject = strip(F.coalesce(label, F.lit(""))), strip(F.coalesce(subject, F.lit("")))
    return (
        F.when((subject != "") & ((label == "") | label.rlike(AUTO_LABEL)), subject)
        .when(label != "", label)
        .when(subject != "", subject)
        .otherwise(fallback)
    )


def guess_companies(organizer: Column, addresses: Column) -> Column:
    """Capitalised first domain labels of the addresses, public mail hosts left out, in first-seen order."""
    all_of = F.filter(F.concat(F.array(organizer), addresses), lambda a: a.isNotNull() & (a != ""))
    hosts = F.transform(all_of, lambda a: F.lower(F.get(F.split(a, "@"), F.lit(1))))
    hosts = F.filter(hosts, lambda h: h.isNotNull() & (h != "") & ~h.isin(*PUBLIC_MAIL_HOSTS))
    cores = F.filter(F.transform(hosts, lambda h: F.split(h, "\\.")[0]), lambda c: c != "")
    names = F.transform(cores, lambda c: F.concat(F.upper(F.substring(c, 1, 1)), F.substr(c, F.lit(2))))
    return F.array_join(F.array_distinct(names), ", ")


def attendee_names(attendees: Column) -> Column:
    names = F.transform(attendees, lambda a: a["name"])
    return F.array_join(F.filter(names, lambda n: n.isNotNull() & (n != "")), ", ")


def attendees_without_rooms(attendees: Column) -> Column:
    """Attendees that are not rooms; the name falls back to the address, and the nameless are dropped."""
    people = F.filter(attendees, lambda a: F.lower(F.coalesce(a["type"], F.lit(""))) != "resource")
    named = F.transform(
        people,
        lambda a: F.struct(
            F.coalesce(F.nullif(a["name"], F.lit("")), a["address"]).alias("name"), a["address"].alias("address")
        ),
    )
    return F.filter(named, lambda a: a["name"].isNotNull() & (a["name"] != ""))


def build_context(subject: Column, organizer: Column, location: Column, online: Column, preview: Column) -> Column:
    body = strip(F.coalesce(preview, F.lit("")))

    def line(prefix: str, value: Column) -> Column:
        return F.when(value.isNotNull() & (value != ""), F.concat(F.lit(prefix), value))

    return F.concat_ws(
        "\n",
        F.concat(F.lit("Réunion : "), subject),
        line("Organisateur : ", organizer),
        line("Lieu : ", location),
        F.when(online, F.lit("Réunion en ligne (Teams).")),
        F.when(body != "", F.concat(F.lit("\n"), body)),
    )


def clock(seconds: Column) -> Column:
    """``MM:SS.ss``; minutes may pass 59."""
    minutes = F.floor(seconds / 60).cast("string")
    return F.concat(
        F.when(F.length(minutes) < 2, F.lpad(minutes, 2, "0")).otherwise(minutes),
        F.lit(":"),
        F.lpad(fixed(seconds % 60, 2), 5, "0"),
    )


def transcript_line(start: Column, end: Column, speaker: Column, text: Column, with_times: bool = True) -> Column:
    plain = F.concat(speaker, F.lit(" : "), text)
    if not with_times:
        return plain
    return F.concat(F.lit("["), clock(start), F.lit(" - "), clock(end), F.lit("]  "), plain)


def rttm_line(file_id: Column, start: Column, end: Column, speaker: Column) -> Column:
    return F.concat(
        F.lit("SPEAKER "), file_id, F.lit(" 1 "), fixed(start, 6), F.lit(" "), fixed(end - start, 6),
        F.lit(" <NA> <NA> "), speaker, F.lit(" <NA> <NA>"),
    )


def diar_line(start: Column, end: Column, speaker: Column) -> Column:
    def seven(x: Column) -> Column:
        body = fixed(x, 2)
        return F.when(F.length(body) < 7, F.lpad(body, 7, " ")).otherwise(body)

    return F.concat(F.lit("["), seven(start), F.lit(" - "), seven(end), F.lit("]  "), speaker)


def segment_line(speaker: Column, text: Column) -> Column:
    """``[speaker]: text``, NULL for an empty text; a missing speaker shows as ``?``."""
    body = strip(F.coalesce(text, F.lit("")))
    return F.when(body != "", F.concat(F.lit("["), F.coalesce(speaker, F.lit("?")), F.lit("]: "), body))


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("long")
