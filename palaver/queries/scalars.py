"""Projections, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from palaver.functions import dates, replies, text, vectors
from palaver.operators import transcripts
from palaver.queries import tables
from palaver.queries.registry import query

BLANKS = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"
STEMS = "|".join(text.ABBREVIATION_STEMS)


def sql_sentences(expr: str) -> str:
    """DuckDB list of sentences: dots after an abbreviation become chr(1), sentence ends become chr(2)."""
    return f"""list_filter(list_transform(string_split(regexp_replace(regexp_replace({expr}, '({STEMS})\\.',
      '\\1' || chr(1), 'g'), '([.!?])\\s+', '\\1' || chr(2), 'g'), chr(2)),
      lambda s: trim(replace(s, chr(1), '.'), {BLANKS})), lambda s: s <> '')"""


# line grammars in RE2; the text keeps everything but newlines
R_RANGE = r"^\[(\d{2}):(\d{2}(?:\.\d+)?)\s*-\s*(\d{2}):(\d{2}(?:\.\d+)?)\]\s+(.+?)\s*:\s+(.*)"
R_LONG = r"^\[(\d{2}):(\d{2}):(\d{2})\]\s+(.+?):\s+(.*)"
R_SHORT = r"^\[(\d{2}):(\d{2})\]\s+\*{0,2}(.+?)\*{0,2}:\s+(.*)"
R_BARE = r"^(.+?):\s+(.+)$"
R_LOOSE = r"^\[[\d:.]+\s*-\s*[\d:.]+\]\s+(.+?)\s*:\s*(.*)"


def rx(pattern: str, group: int, column: str = "l") -> str:
    return f"regexp_extract({column}, '{pattern}', {group})"


def num(pattern: str, group: int) -> str:
    return f"TRY_CAST({rx(pattern, group)} AS DOUBLE)"


PARSED_SQL = f"""
SELECT meeting_id, line_no, kind, start, e AS "end", trim(sp, {BLANKS}) AS speaker, trim(tx, {BLANKS}) AS text FROM (
 SELECT *, CASE kind
   WHEN 'range' THEN {num(R_RANGE, 3)} * 60 + {num(R_RANGE, 4)}
   WHEN 'bare' THEN CAST(line_no + 1 AS DOUBLE)
   ELSE start + greatest(length(tx) * 0.05e0, 1.0e0) END AS e FROM (
  SELECT *, CASE kind
     WHEN 'range' THEN {num(R_RANGE, 1)} * 60 + {num(R_RANGE, 2)}
     WHEN 'long' THEN {num(R_LONG, 1)} * 3600 + {num(R_LONG, 2)} * 60 + {num(R_LONG, 3)}
     WHEN 'short' THEN {num(R_SHORT, 1)} * 60 + {num(R_SHORT, 2)}
     ELSE CAST(line_no AS DOUBLE) END AS start,
   CASE kind WHEN 'range' THEN {rx(R_RANGE, 5)} WHEN 'long' THEN {rx(R_LONG, 4)} WHEN 'short' THEN {rx(R_SHORT, 3)}
     ELSE {rx(R_BARE, 1)} END AS sp,
   CASE kind WHEN 'range' THEN {rx(R_RANGE, 6)} WHEN 'long' THEN {rx(R_LONG, 5)} WHEN 'short' THEN {rx(R_SHORT, 4)}
     ELSE {rx(R_BARE, 2)} END AS tx
  FROM (SELECT meeting_id, line_no, l, CASE WHEN regexp_matches(l, '{R_RANGE}') THEN 'range'
     WHEN regexp_matches(l, '{R_LONG}') THEN 'long' WHEN regexp_matches(l, '{R_SHORT}') THEN 'short'
     WHEN regexp_matches(l, '{R_BARE}') THEN 'bare' END AS kind
    FROM (SELECT meeting_id, line_no, trim(raw, {BLANKS}) AS l FROM {{lines}})) WHERE kind IS NOT NULL))"""


# entities that the pages have, in the order in which the SQL replaces them
ENTITIES = (
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"),
    ("&copy;", "©"), ("&reg;", "®"), ("&middot;", "·"), ("&laquo;", "«"), ("&raquo;", "»"), ("&hellip;", "…"),
    ("&mdash;", "—"), ("&ndash;", "–"), ("&rsquo;", "’"), ("&lsquo;", "‘"), ("&eacute;", "é"), ("&egrave;", "è"),
    ("&agrave;", "à"), ("&ccedil;", "ç"), ("&euro;", "€"), ("&amp;", "&"),
)


@query("parse_line_grammar", PARSED_SQL.replace('{lines}', "t_lines"))
def parse_line_grammar(spark, sf):
    return transcripts.parse_lines(tables.transcript_lines(spark, sf))


@query("parse_document_lines", PARSED_SQL.replace('{lines}', "t_doc_lines"))
def parse_document_lines(spark, sf):
    return transcripts.parse_lines(tables.document_lines(spark, sf))


@query(
    "default_end_time",
    'SELECT meeting_id, line_no, start, "end" FROM (' + PARSED_SQL.replace('{lines}', 't_lines') + ") WHERE kind IN ('long', 'short')",
)
def default_end_time(spark, sf):
    parsed = transcripts.parse_lines(tables.transcript_lines(spark, sf))
    return parsed.filter(F.col("kind").isin("long", "short")).select("meeting_id", "line_no", "start", "end")


@query(
    "ordinal_time",
    'SELECT meeting_id, line_no, start, "end" FROM (' + PARSED_SQL.replace('{lines}', 't_doc_lines') + ") WHERE kind = 'bare'",
)
def ordinal_time(spark, sf):
    parsed = transcripts.parse_lines(tables.document_lines(spark, sf))
    return parsed.filter("kind = 'bare'").select("meeting_id", "line_no", "start", "end")


def sql_wrapped(keys: str, source: str, limit: int = 300) -> str:
    """Recursive members ``w``: pieces of at most ``limit`` characters (keys, pos, piece, part) of the sentences of ``source``
    (keys, pos, sentence)."""
    space = f"strpos(reverse(substr(rest, 2, {limit - 1})), ' ')"
    return f"""w AS (SELECT {keys}, pos, 0 AS piece, CAST(NULL AS VARCHAR) AS part, sentence AS rest FROM {source}
      UNION ALL
      SELECT {keys}, pos, piece + 1, trim(substr(rest, 1, cut), {BLANKS}), trim(substr(rest, cut + 1), {BLANKS}) FROM (
        SELECT *, CASE WHEN length(rest) <= {limit} THEN length(rest) WHEN {space} > 0 THEN {limit} - {space} ELSE {limit} END AS cut
        FROM w WHERE rest <> ''))"""


def sql_normalized(lines: str) -> str:
    """Normalised lines, one row each; sentences over 300 characters are wrapped, lines without a grammar are not."""
    return f"""
WITH RECURSIVE read AS (
  SELECT *, CASE kind WHEN 'range' THEN {rx(R_LOOSE, 1)} WHEN 'long' THEN {rx(R_LONG, 4)}
      WHEN 'short' THEN {rx(R_SHORT, 3)} WHEN 'bare' THEN {rx(R_BARE, 1)} END AS sp,
    CASE kind WHEN 'range' THEN {rx(R_LOOSE, 2)} WHEN 'long' THEN {rx(R_LONG, 5)}
      WHEN 'short' THEN {rx(R_SHORT, 4)} WHEN 'bare' THEN {rx(R_BARE, 2)} END AS tx
  FROM (SELECT *, CASE WHEN regexp_matches(l, '{R_LOOSE}') THEN 'range' WHEN regexp_matches(l, '{R_LONG}') THEN 'long'
      WHEN regexp_matches(l, '{R_SHORT}') THEN 'short' WHEN regexp_matches(l, '{R_BARE}') THEN 'bare' END AS kind
    FROM (SELECT meeting_id, line_no, rtrim(raw, {BLANKS}) AS l FROM {lines}) WHERE trim(l, {BLANKS}) <> '')),
said AS (SELECT meeting_id, line_no, sp, pos, ss[pos] AS sentence FROM (
  SELECT *, unnest(range(1, len(ss) + 1)) AS pos FROM (SELECT meeting_id, line_no, sp, {sql_sentences('tx')} AS ss FROM read WHERE sp IS NOT NULL))),
{sql_wrapped('meeting_id, line_no, sp', 'said')}
SELECT meeting_id, line_no, 1 AS pos, l AS line FROM read WHERE sp IS NULL
UNION ALL
SELECT meeting_id, line_no, row_number() OVER (PARTITION BY meeting_id, line_no ORDER BY pos, piece), trim(sp, {BLANKS}) || ': ' || part FROM w WHERE piece > 0"""


@query("normalize_lines", sql_normalized("t_lines"))
def normalize_lines(spark, sf):
    return transcripts.normalize_lines(tables.transcript_lines(spark, sf))


@query("normalize_document_lines", sql_normalized("t_doc_lines"))
def normalize_document_lines(spark, sf):
    return transcripts.normalize_lines(tables.document_lines(spark, sf))


@query(
    "split_sentences",
    f"""SELECT doc_id, pos, s[pos] AS sentence FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS pos
        FROM (SELECT doc_id, {sql_sentences('text')} AS s FROM documents))""",
)
def split_sentences(spark, sf):
    d = tables.read_texts(spark, sf, "documents")
    return d.select("doc_id", F.posexplode(text.split_sentences(F.col("text"))).alias("pos", "sentence")).withColumn(
        "pos", F.col("pos") + 1
    )


@query(
    "hard_wrap",
    f"""WITH RECURSIVE s0 AS (SELECT doc_id, pos, s[pos] AS sentence FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS pos
          FROM (SELECT doc_id, {sql_sentences('text')} AS s FROM documents))),
        w AS (SELECT doc_id, pos, 0 AS piece, CAST(NULL AS VARCHAR) AS part, sentence AS rest FROM s0
          UNION ALL
          SELECT doc_id, pos, piece + 1, trim(substr(rest, 1, cut), {BLANKS}), trim(substr(rest, cut + 1), {BLANKS}) FROM (
            SELECT *, CASE WHEN length(rest) <= 80 THEN length(rest)
              WHEN strpos(reverse(substr(rest, 2, 79)), ' ') > 0 THEN 80 - strpos(reverse(substr(rest, 2, 79)), ' ')
              ELSE 80 END AS cut FROM w WHERE rest <> ''))
        SELECT doc_id, pos, piece, part FROM w WHERE piece > 0""",
)
def hard_wrap(spark, sf):
    d = tables.read_texts(spark, sf, "documents")
    s = d.select("doc_id", F.posexplode(text.split_sentences(F.col("text"))).alias("pos", "sentence"))
    return s.select(
        "doc_id", (F.col("pos") + 1).alias("pos"), F.posexplode(text.hard_wrap(F.col("sentence"), 80)).alias("piece", "part")
    ).withColumn("piece", F.col("piece") + 1)


SQL_SENTENCE_TURNS = f"""WITH RECURSIVE s AS (SELECT meeting_id, seg_idx, start, "end" AS e, speaker, text, {sql_sentences('text')} AS ss FROM t_segments),
  said AS (SELECT meeting_id, seg_idx, pos, ss[pos] AS sentence FROM (SELECT *, unnest(range(1, len(ss) + 1)) AS pos FROM s)),
  {sql_wrapped('meeting_id, seg_idx', 'said')},
  p AS (SELECT meeting_id, seg_idx, part AS txt, length(part) AS n, row_number() OVER o AS pos, count(*) OVER g AS k,
    sum(length(part)) OVER o AS cum, sum(length(part)) OVER g AS total FROM w WHERE piece > 0
    WINDOW o AS (PARTITION BY meeting_id, seg_idx ORDER BY pos, piece), g AS (PARTITION BY meeting_id, seg_idx))
  SELECT meeting_id, seg_idx, 1 AS pos, speaker, round(start, 6) AS start, round(e, 6) AS "end", text FROM s
  WHERE (meeting_id, seg_idx) NOT IN (SELECT (meeting_id, seg_idx) FROM p WHERE k > 1)
  UNION ALL
  SELECT meeting_id, seg_idx, pos, speaker, round(start + (e - start) * (cum - n) / total, 6),
    round(CASE WHEN pos = k THEN e ELSE start + (e - start) * cum / total END, 6), txt FROM p JOIN s USING (meeting_id, seg_idx) WHERE k > 1"""


@query("apportion_sentence_time", SQL_SENTENCE_TURNS)
def apportion_sentence_time(spark, sf):
    out = transcripts.sentence_turns(tables.segments(spark, sf))
    return out.withColumns({"start": F.round("start", 6), "end": F.round("end", 6)})


@query(
    "norm_teams_ts",
    r"""SELECT event_id, raw, CASE WHEN regexp_matches(raw, '^\d{1,2}(:\d{2}){1,2}$') THEN
          CASE WHEN len(p) = 2 THEN '00:' || lpad(p[1], 2, '0') || ':' || p[2]
               ELSE lpad(p[1], 2, '0') || ':' || p[2] || ':' || p[3] END END AS ts
        FROM (SELECT *, string_split(raw, ':') AS p FROM (SELECT event_id,
          CASE event_type WHEN 'click' THEN hour(ts) || ':' || lpad(CAST(minute(ts) AS VARCHAR), 2, '0')
            WHEN 'view' THEN hour(ts) || ':' || lpad(CAST(minute(ts) AS VARCHAR), 2, '0') || ':' || lpad(CAST(second(ts) AS VARCHAR), 2, '0')
            WHEN 'error' THEN props ELSE hour(ts) || ':' || minute(ts) END AS raw FROM events))""",
)
def norm_teams_ts(spark, sf):
    e = tables.read(spark, sf, "events")
    h, m, s = F.hour("ts").cast("string"), F.minute("ts").cast("string"), F.second("ts").cast("string")
    raw = (
        F.when(F.col("event_type") == "click", F.concat_ws(":", h, F.lpad(m, 2, "0")))
        .when(F.col("event_type") == "view", F.concat_ws(":", h, F.lpad(m, 2, "0"), F.lpad(s, 2, "0")))
        .when(F.col("event_type") == "error", F.col("props"))
        .otherwise(F.concat_ws(":", h, m))
    )
    return e.select("event_id", raw.alias("raw")).withColumn("ts", text.teams_timestamp(F.col("raw")))


RESERVED = ", ".join(f"'{r}'" for r in text.RESERVED_LABELS)
SQL_SANITIZE = f"""substr(CASE WHEN upper(k) IN ({RESERVED}) THEN '_' || k ELSE k END, 1, 200)"""


def sql_kept(expr: str) -> str:
    return f"""trim(regexp_replace(trim(coalesce({expr}, ''), {BLANKS}), '[<>:"/\\\\|?*\\x00-\\x1f]', '', 'g'), '. ')"""


@query(
    "sanitize_label",
    f"""SELECT page_id AS id, {SQL_SANITIZE} AS label FROM (SELECT page_id, {sql_kept('url')} AS k FROM pages)
        UNION ALL SELECT doc_id + 1000000, {SQL_SANITIZE} FROM (SELECT doc_id, {sql_kept('text')} AS k FROM documents)
        UNION ALL SELECT c_custkey + 2000000, {SQL_SANITIZE}
        FROM (SELECT c_custkey, {sql_kept("' com' || c_nationkey || ' .'")} AS k FROM customer)""",
)
def sanitize_label(spark, sf):
    p = tables.read(spark, sf, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("raw"))
    d = tables.read(spark, sf, "documents").select((F.col("doc_id") + 1000000).alias("id"), F.col("text").alias("raw"))
    c = tables.read(spark, sf, "customer").select(
        (F.col("c_custkey") + 2000000).alias("id"), F.concat(F.lit(" com"), "c_nationkey", F.lit(" .")).alias("raw")
    )
    return p.union(d).union(c).select("id", text.sanitize_label(F.col("raw")).alias("label"))


@query(
    "unique_folder_name",
    """SELECT id, CASE WHEN k = 1 THEN base ELSE base || '_' || k END AS folder FROM (
         SELECT id, base, row_number() OVER (PARTITION BY base ORDER BY created_ms, id) AS k FROM (
           SELECT id, created_ms, strftime(created, '%Y-%m-%d_%Hh%Mm%Ss') || CASE WHEN cal_subject IS NULL THEN '' ELSE '_Point' END AS base FROM t_jobs))""",
)
def unique_folder_name(spark, sf):
    from palaver.operators import catalog

    j = tables.jobs(spark, sf).select(
        "id", "created_ms", "created", F.when(F.col("cal_subject").isNotNull(), "Point").alias("hint")
    )
    return catalog.unique_folder_names(j).select("id", "folder")


@query(
    "unescape_md",
    r"""SELECT doc_id, regexp_replace(x, '\\([\\`*_{}\[\]()#+\-.!|>])', '\1', 'g') AS text FROM (
          SELECT doc_id, replace(replace(text, '.', '\.'), '-', '\-') AS x FROM documents)""",
)
def unescape_md(spark, sf):
    d = tables.read(spark, sf, "documents")
    escaped = F.replace(F.replace("text", F.lit("."), F.lit("\\.")), F.lit("-"), F.lit("\\-"))
    return d.select("doc_id", text.unescape_md(escaped).alias("text"))


@query("md_cell", f"SELECT doc_id, trim(replace(replace(text, chr(10), ' '), '|', '\\|'), {BLANKS}) AS cell FROM documents")
def md_cell(spark, sf):
    return tables.read(spark, sf, "documents").select("doc_id", text.md_cell(F.col("text")).alias("cell"))


def sql_html(expr: str) -> str:
    out = f"regexp_replace({expr}, '(?is)<script\\b[^>]*>.*?</script>', ' ', 'g')"
    out = f"regexp_replace({out}, '(?is)<style\\b[^>]*>.*?</style>', ' ', 'g')"
    out = f"regexp_replace({out}, '(?s)<[^>]+>', ' ', 'g')"
    for entity, char in ENTITIES:
        out = "replace({}, '{}', '{}')".format(out, entity.replace("'", "''"), char.replace("'", "''"))
    out = f"regexp_replace({out}, '[ \\t' || chr(160) || ']+', ' ', 'g')"
    out = f"regexp_replace({out}, '[\\s\\x0b]*\\n[\\s\\x0b]*', chr(10), 'g')"
    return f"trim({out}, {BLANKS})"


@query(
    "html_to_text",
    f"SELECT page_id, {sql_html('trim(html, ' + BLANKS + ')')} AS text FROM pages",
)
def html_to_text(spark, sf):
    p = tables.read_texts(spark, sf, "pages")
    return p.select("page_id", text.html_to_text(F.col("html"), F.lit("HTML"), F.lit("")).alias("text"))


@query(
    "parse_graph_date",
    """SELECT id, strftime(try_strptime(regexp_replace(start, '\\.\\d+$', ''), '%Y-%m-%dT%H:%M:%S'), '%Y-%m-%d %H:%M:%S') AS d
       FROM (SELECT id, CASE WHEN subject = '' THEN 'demain' ELSE start END AS start FROM t_cal)""",
)
def parse_graph_date(spark, sf):
    c = tables.calendar_events(spark, sf)
    raw = F.when(F.col("subject") == "", "demain").otherwise(F.col("start"))
    return c.select("id", F.date_format(dates.parse_graph_date(raw), "yyyy-MM-dd HH:mm:ss").alias("d"))


MONTH_LIST = "[" + ", ".join(f"'{m}'" for m in dates.MONTH_CODES) + "]"
MONTHS_LIST = "[" + ", ".join(f"'{m}'" for m in dates.MONTHS) + "]"
DAYS_LIST = "[" + ", ".join(f"'{m}'" for m in dates.WEEKDAYS) + "]"


@query("date_chip", f"SELECT o_orderkey, day(o_orderdate) AS d, {MONTH_LIST}[month(o_orderdate)] AS m FROM orders")
def date_chip(spark, sf):
    o = tables.read(spark, sf, "orders")
    d = F.col("o_orderdate")
    return o.select(
        "o_orderkey", dates.date_chip_day(d).cast("long").alias("d"), dates.date_chip_month(d).alias("m")
    )


@query(
    "day_section",
    f"""SELECT o_orderkey, CASE diff WHEN 0 THEN 'Aujourd''hui' WHEN 1 THEN 'Hier' WHEN -1 THEN 'Demain'
          ELSE {DAYS_LIST}[isodow(d)] || ' ' || day(d) || ' ' || {MONTHS_LIST}[month(d)] END AS label
        FROM (SELECT o_orderkey, o_orderdate AS d, date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-10-03') AS diff FROM orders)""",
)
def day_section(spark, sf):
    o = tables.read(spark, sf, "orders")
    return o.select("o_orderkey", dates.day_section(F.col("o_orderdate"), F.lit("1998-10-03")).alias("label"))


@query(
    "day_key",
    """SELECT id, CASE WHEN ms IS NULL OR ms = 0 THEN '' ELSE strftime(make_timestamp(ms * 1000), '%Y-%m-%d') END AS day
       FROM (SELECT id, CASE WHEN status = 'queued' THEN 0 WHEN folder IS NOT NULL THEN created_ms END AS ms FROM t_jobs)""",
)
def day_key(spark, sf):
    j = tables.jobs(spark, sf)
    ms = F.when(F.col("status") == "queued", F.lit(0).cast("long")).when(F.col("folder").isNotNull(), F.col("created_ms"))
    return j.select("id", dates.day_key(ms).alias("day"))


SQL_DISPLAY = """CASE WHEN trim(coalesce(cal_subject, '')) <> '' AND (trim(coalesce(label, '')) = ''
  OR regexp_matches(trim(label), '^\\d{{4}}-\\d{{2}}-\\d{{2}}_\\d{{2}}h\\d{{2}}m\\d{{2}}s')) THEN trim(cal_subject)
  WHEN trim(coalesce(label, '')) <> '' THEN trim(label) WHEN trim(coalesce(cal_subject, '')) <> '' THEN trim(cal_subject)
  ELSE {fallback} END"""


@query("display_name", f"SELECT id, {SQL_DISPLAY.format(fallback='id')} AS name FROM t_jobs")
def display_name(spark, sf):
    j = tables.jobs(spark, sf)
    return j.select("id", text.display_name(F.col("label"), F.col("cal_subject"), F.col("id")).alias("name"))


HOSTS = ", ".join(f"'{h}'" for h in text.PUBLIC_MAIL_HOSTS)


@query(
    "guess_companies",
    f"""WITH a AS (SELECT id, unnest(range(1, len(l) + 1)) AS pos, l FROM (
          SELECT id, list_prepend(organizer_address, list_transform(attendees, lambda x: x.address)) AS l FROM t_cal)),
        h AS (SELECT id, pos, lower(split_part(l[pos], '@', 2)) AS host FROM a WHERE coalesce(l[pos], '') <> ''),
        n AS (SELECT id, upper(substr(core, 1, 1)) || substr(core, 2) AS name, min(pos) AS pos FROM (
          SELECT id, pos, split_part(host, '.', 1) AS core FROM h WHERE host <> '' AND host NOT IN ({HOSTS})) WHERE core <> '' GROUP BY 1, 2)
        SELECT t_cal.id AS id, coalesce(string_agg(name, ', ' ORDER BY pos), '') AS companies FROM t_cal LEFT JOIN n ON n.id = t_cal.id GROUP BY 1""",
)
def guess_companies(spark, sf):
    c = tables.calendar_events(spark, sf)
    addresses = F.transform("attendees", lambda a: a["address"])
    return c.select("id", text.guess_companies(F.col("organizer_address"), addresses).alias("companies"))


@query(
    "attendee_names",
    """SELECT id, array_to_string(list_filter(list_transform(attendees, lambda a: a.name), lambda n: n IS NOT NULL AND n <> ''), ', ') AS names
       FROM t_cal""",
)
def attendee_names(spark, sf):
    return tables.calendar_events(spark, sf).select("id", text.attendee_names(F.col("attendees")).alias("names"))


@query(
    "attendees_without_rooms",
    """SELECT id, array_to_string(list_filter(list_transform(list_filter(attendees, lambda a: lower(coalesce(a.type, '')) <> 'resource'),
         lambda a: coalesce(nullif(a.name, ''), a.address)), lambda n: n IS NOT NULL AND n <> ''), '; ') AS people FROM t_cal""",
)
def attendees_without_rooms(spark, sf):
    kept = text.attendees_without_rooms(F.col("attendees"))
    return tables.calendar_events(spark, sf).select(
        "id", F.array_join(F.transform(kept, lambda a: a["name"]), "; ").alias("people")
    )


@query(
    "build_context",
    f"""SELECT id, 'Réunion : ' || subject || CASE WHEN organizer_name <> '' THEN chr(10) || 'Organisateur : ' || organizer_name ELSE '' END
         || CASE WHEN location <> '' THEN chr(10) || 'Lieu : ' || location ELSE '' END
         || CASE WHEN is_online THEN chr(10) || 'Réunion en ligne (Teams).' ELSE '' END
         || CASE WHEN trim(preview, {BLANKS}) <> '' THEN chr(10) || chr(10) || trim(preview, {BLANKS}) ELSE '' END AS context FROM t_cal""",
)
def build_context(spark, sf):
    c = tables.calendar_events(spark, sf)
    return c.select(
        "id",
        text.build_context(
            F.col("subject"), F.col("organizer_name"), F.col("location"), F.col("is_online"), F.col("preview")
        ).alias("context"),
    )


CUE_TEST = " OR ".join(
    "starts_with(head, '{0}') OR contains(head, ' {0}')".format(w.replace("'", "''")) for w in text.QUESTION_CUES
)


@query(
    "looks_like_question",
    f"""SELECT doc_id, pos, low <> '' AND (ends_with(low, '?') OR {CUE_TEST}) AS question FROM (
        SELECT doc_id, pos, low, substr(low, 1, 45) AS head FROM (SELECT doc_id, pos, lower(s[pos]) AS low FROM (
          SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS pos FROM (SELECT doc_id, {sql_sentences('text')} AS s FROM documents))))""",
)
def looks_like_question(spark, sf):
    return split_sentences(spark, sf).select(
        "doc_id", "pos", text.looks_like_question(F.col("sentence")).alias("question")
    )


BRACED = """CASE WHEN strpos({0}, '{{') > 0 AND strpos({0}, '}}') > 0
   AND length({0}) - strpos(reverse({0}), '}}') + 1 > strpos({0}, '{{')
   THEN substr({0}, strpos({0}, '{{'), length({0}) - strpos(reverse({0}), '}}') + 1 - strpos({0}, '{{') + 1) END"""
SAFE = f"""SELECT meeting_id, chunk_id, raw, {BRACED.format('x')} AS js FROM (SELECT *, CASE WHEN regexp_matches(t, '(?s)```(?:json)?\\s*(.+?)\\s*```')
   THEN trim(regexp_extract(t, '(?s)```(?:json)?\\s*(.+?)\\s*```', 1), {BLANKS}) ELSE t END AS x
   FROM (SELECT *, trim(raw, {BLANKS}) AS t FROM t_replies))"""
VALID = "(js IS NOT NULL AND json_valid(js))"


@query(
    "parse_json_safe",
    f"""SELECT meeting_id, chunk_id, {VALID} AS valid, CASE WHEN {VALID} THEN json_extract_string(js, '$.titre') END AS titre,
          CASE WHEN {VALID} THEN json_array_length(js, '$.points') END AS n_points FROM ({SAFE})""",
)
def parse_json_safe(spark, sf):
    r = tables.replies(spark, sf).withColumn("js", replies.json_text_safe(F.col("raw")))
    d = r.withColumn("d", replies.parse_reply(F.col("js")))
    n = F.when(F.col("d.points").isNotNull(), F.size("d.points")).cast("long")
    return d.select(
        "meeting_id", "chunk_id", replies.is_json(F.col("js")).alias("valid"), F.col("d.titre").alias("titre"), n.alias("n_points")
    )


@query(
    "parse_json_loose",
    f"""SELECT meeting_id, chunk_id, CASE WHEN {VALID} THEN json_extract_string(js, '$.contexte') END AS contexte FROM (
        SELECT meeting_id, chunk_id, CASE WHEN json_valid(raw) THEN trim(raw, {BLANKS}) ELSE {BRACED.format('raw')} END AS js FROM t_replies)""",
)
def parse_json_loose(spark, sf):
    r = tables.replies(spark, sf).withColumn("d", replies.parse_reply(replies.json_text_loose(F.col("raw"))))
    return r.select("meeting_id", "chunk_id", F.col("d.contexte").alias("contexte"))


@query(
    "schema_check",
    """SELECT meeting_id, chunk_id, array_to_string(list_filter([
        CASE WHEN titre IS NULL THEN 'titre_missing' END, CASE WHEN contexte IS NULL THEN 'contexte_missing' END,
        CASE WHEN len(points) NOT BETWEEN 2 AND 6 THEN 'points_count' END,
        CASE WHEN len(plan) > 2 THEN 'plan_count' END,
        CASE WHEN len(list_filter(plan, lambda p: p.echeance IS NULL)) > 0 THEN 'plan_keys' END], lambda v: v IS NOT NULL), ',') AS violations
       FROM t_sections""",
)
def schema_check(spark, sf):
    s = tables.sections(spark, sf)
    v = replies.schema_violations(*[F.col(c) for c in ("titre", "contexte", "points", "decisions", "plan")])
    return s.select("meeting_id", "chunk_id", F.array_join(v, ",").alias("violations"))


@query(
    "compose_summary",
    f"""SELECT meeting_id, chunk_id, CASE WHEN c = '' AND len(b) = 0 THEN trim(CASE WHEN resume <> '' THEN resume ELSE '' END, {BLANKS})
          ELSE c || CASE WHEN c <> '' AND len(b) > 0 THEN chr(10) ELSE '' END || array_to_string(list_transform(b, lambda p: '- ' || p), chr(10)) END AS summary
        FROM (SELECT meeting_id, chunk_id, resume, trim(coalesce(contexte, ''), {BLANKS}) AS c,
          list_filter(list_transform(points, lambda p: trim(p, {BLANKS})), lambda p: p <> '') AS b FROM t_sections)""",
)
def compose_summary(spark, sf):
    s = tables.sections(spark, sf)
    out = replies.compose_summary(F.col("contexte"), F.col("points"), F.col("resume"), F.lit(""))
    return s.select("meeting_id", "chunk_id", out.alias("summary"))


@query(
    "normalize_plan_items",
    f"""SELECT meeting_id, chunk_id, pos, trim(p.action, {BLANKS}) AS action, kind AS type,
          CASE WHEN kind = 'engagement' AND NOT regexp_matches(coalesce(nullif(trim(p.responsable), ''), '—'), '^SPEAKER_\\d+$')
            THEN coalesce(nullif(trim(p.responsable), ''), '—') ELSE '—' END AS responsable,
          CASE WHEN kind = 'engagement' THEN coalesce(nullif(trim(p.echeance), ''), '—') ELSE '—' END AS echeance
        FROM (SELECT *, CASE WHEN lower(trim(p.type)) IN ('engagement', 'suggestion') THEN lower(trim(p.type)) ELSE 'suggestion' END AS kind
          FROM (SELECT meeting_id, chunk_id, pos, items[pos] AS p FROM (SELECT *, unnest(range(1, len(items) + 1)) AS pos FROM (
            SELECT meeting_id, chunk_id, list_filter(from_json(js->'$.plan', '[{{"action":"VARCHAR","responsable":"VARCHAR","echeance":"VARCHAR","type":"VARCHAR"}}]'),
              lambda a: trim(a.action) <> '') AS items FROM (SELECT meeting_id, chunk_id, CAST(js AS JSON) AS js FROM ({SAFE}) WHERE {VALID})))))""",
)
def normalize_plan_items(spark, sf):
    r = tables.replies(spark, sf).withColumn("d", replies.parse_reply(replies.json_text_safe(F.col("raw"))))
    items = r.select(
        "meeting_id", "chunk_id", F.posexplode(replies.normalize_plan_items(F.col("d.plan"))).alias("pos", "p")
    )
    return items.select("meeting_id", "chunk_id", (F.col("pos") + 1).alias("pos"), "p.*")


@query(
    "speaker_map_clean",
    """SELECT c_custkey, n AS nom, CASE WHEN lower(e) <> 'null' THEN e END AS entreprise FROM (
         SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'Null' WHEN c_nationkey < 3 THEN '' ELSE c_name END AS n,
           CASE WHEN c_nationkey > 20 THEN 'NULL' ELSE c_mktsegment END AS e FROM customer) WHERE n <> '' AND lower(n) <> 'null'""",
)
def speaker_map_clean(spark, sf):
    c = tables.read(spark, sf, "customer")
    nom = F.when(F.col("c_acctbal") < 0, "Null").when(F.col("c_nationkey") < 3, "").otherwise(F.col("c_name"))
    firm = F.when(F.col("c_nationkey") > 20, "NULL").otherwise(F.col("c_mktsegment"))
    m = F.create_map(F.lit("SPEAKER_00"), F.struct(nom.alias("nom"), firm.alias("entreprise")))
    cleaned = c.select("c_custkey", F.explode(replies.speaker_map_clean(m)).alias("label", "v"))
    return cleaned.select("c_custkey", "v.nom", "v.entreprise")


@query(
    "speaker_map_patch",
    f"""SELECT c_custkey, label, name FROM (
         SELECT c_custkey, 'SPEAKER_00' AS label, CASE WHEN c_nationkey > 20 THEN NULL WHEN c_nationkey > 10 THEN trim(c_name, {BLANKS}) ELSE 'Ana' END AS name FROM customer
         UNION ALL SELECT c_custkey, 'SPEAKER_01', 'Bob' FROM customer) WHERE name IS NOT NULL""",
)
def speaker_map_patch(spark, sf):
    c = tables.read(spark, sf, "customer")
    current = F.create_map(F.lit("SPEAKER_00"), F.lit("Ana"), F.lit("SPEAKER_01"), F.lit("Bob"))
    updates = (
        F.when(F.col("c_nationkey") > 20, F.create_map(F.lit("SPEAKER_00"), F.lit(" ")))
        .when(F.col("c_nationkey") > 10, F.create_map(F.lit("SPEAKER_00"), F.col("c_name")))
        .otherwise(F.create_map().cast("map<string,string>"))
    )
    return c.select("c_custkey", F.explode(replies.speaker_map_patch(current, updates)).alias("label", "name"))


PROMPT = "Résume ce passage.\n\n{texte}\n\nRéponds en JSON."


def _q(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


SQL_PROMPT = f"""replace({_q(PROMPT)}, '{{texte}}', text) || {_q(replies.REMINDER_HEAD)} || chr(10) || {_q(replies.REMINDER_RULE)}
   || chr(10) || 'PARTICIPANTS : ' || speaker"""


@query("render_prompt", f"SELECT meeting_id, seg_idx, {SQL_PROMPT} AS prompt FROM t_segments")
def render_prompt(spark, sf):
    s = tables.segments(spark, sf)
    prompt = replies.render_prompt(F.lit(PROMPT), F.col("text"), F.col("speaker"), F.lit(" "))
    return s.select("meeting_id", "seg_idx", prompt.alias("prompt"))


@query("token_estimate", "SELECT doc_id, length(text) // 4 AS tokens FROM documents")
def token_estimate(spark, sf):
    return tables.read(spark, sf, "documents").select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


@query(
    "segments_to_text",
    f"""SELECT meeting_id, string_agg('[' || coalesce(speaker, '?') || ']: ' || trim(text, {BLANKS}), chr(10) ORDER BY seg_idx) AS text
        FROM t_segments WHERE trim(text, {BLANKS}) <> '' GROUP BY 1""",
)
def segments_to_text(spark, sf):
    return transcripts.segments_to_text(tables.segments(spark, sf), ["meeting_id"], "seg_idx")


@query(
    "l2_normalize",
    """SELECT vec_id, pos - 1 AS dim, round(v[pos] / (n + 1e-10), 6) AS x FROM (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n, unnest(range(1, len(v) + 1)) AS pos
       FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 3) AS v FROM embeddings))""",
)
def l2_normalize(spark, sf):
    e = tables.read(spark, sf, "embeddings")
    tripled = F.transform("embedding", lambda x: x.cast("double") * 3)
    return e.select("vec_id", F.posexplode(vectors.l2_normalize(tripled)).alias("dim", "x")).withColumn("x", F.round("x", 6))


@query(
    "cosine_dot",
    """SELECT a.meeting_id, a.sub_idx, round(list_dot_product(a.embedding, b.embedding), 6) AS dot,
         round(greatest((list_cosine_similarity(a.embedding, b.embedding) + 1) / 2, 0), 6) AS affinity
       FROM t_sub a JOIN t_sub b ON a.meeting_id = b.meeting_id AND b.sub_idx = a.sub_idx + 1""",
)
def cosine_dot(spark, sf):
    s = tables.subsegments(spark, sf).select("meeting_id", "sub_idx", "embedding")
    nxt = s.select("meeting_id", (F.col("sub_idx") - 1).alias("sub_idx"), F.col("embedding").alias("other"))
    return s.join(nxt, ["meeting_id", "sub_idx"]).select(
        "meeting_id",
        "sub_idx",
        F.round(vectors.dot(F.col("embedding"), F.col("other")), 6).alias("dot"),
        F.round(vectors.affinity(F.col("embedding"), F.col("other")), 6).alias("affinity"),
    )


@query(
    "progress_step_index",
    """SELECT id, idx, CASE WHEN status = 'done' THEN 100.0e0 ELSE greatest(8.0e0, (idx + 1) * 100.0e0 / n) END AS pct FROM (
        SELECT id, status, len(st) AS n, coalesce(list_position(list_transform(st, lambda s: contains(lower(step), lower(s))), true), 0) - 1 AS idx FROM (
          SELECT *, CASE WHEN source = 'transcript' THEN ['Normalisation', 'Compte rendu'] ELSE ['Conversion', 'Diarisation', 'Transcription', 'Compte rendu'] END AS st FROM t_jobs))""",
)
def progress_step_index(spark, sf):
    from palaver.operators import catalog

    return catalog.progress(tables.jobs(spark, sf)).select("id", "idx", "pct")


@query(
    "calendar_window",
    f"""SELECT id, start FROM t_cal WHERE strptime(substr("end", 1, 19), '%Y-%m-%dT%H:%M:%S') > TIMESTAMP '2024-01-01 00:00:00'
          AND strptime(substr(start, 1, 19), '%Y-%m-%dT%H:%M:%S') < TIMESTAMP '{tables.NOW}' + INTERVAL 1 DAY
        ORDER BY start LIMIT 100""",
)
def calendar_window(spark, sf):
    from palaver.operators import catalog

    return catalog.calendar_window(tables.calendar_events(spark, sf), tables.NOW, 0).select("id", "start")


@query(
    "job_public_view",
    """SELECT id, status, label, source, created_ms, source = 'audio' AND price < 100000 AS audio_available, status = 'done' AS transcript_available
       FROM t_jobs JOIN (SELECT 'j' || o_orderkey AS oid, o_totalprice AS price FROM orders) ON oid = id""",
)
def job_public_view(spark, sf):
    from palaver.operators import catalog

    o = tables.read(spark, sf, "orders").withColumn("id", F.concat(F.lit("j"), "o_orderkey"))
    files = o.filter("o_totalprice < 100000").select("id", F.lit("audio.wav").alias("file")).unionByName(
        o.filter("o_orderstatus = 'F'").select("id", F.lit("transcript.txt").alias("file"))
    )
    return catalog.public_view(tables.jobs(spark, sf), files).select(
        "id", "status", "label", "source", "created_ms", "audio_available", "transcript_available"
    )
