"""Sections, plans, report lines and Markdown."""

from __future__ import annotations

from pyspark.sql import functions as F

from palaver.functions import replies
from palaver.operators import markdown, reports
from palaver.queries import tables
from palaver.queries.registry import query
from palaver.queries.scalars import BLANKS
from palaver.session import cut_lineage

SQL = tables.SQL


def sections(spark, sf):
    return tables.sections(spark, sf)


@query(
    "sort_sections",
    "SELECT meeting_id, chunk_id, row_number() OVER (PARTITION BY meeting_id ORDER BY start_time, chunk_id) AS no FROM t_sections",
)
def sort_sections(spark, sf):
    return reports.sort_sections(sections(spark, sf)).select("meeting_id", "chunk_id", "no")


SQL["t_flat"] = """
SELECT meeting_id, chunk_id, start_time, titre, pos - 1 AS pos, decisions[pos] AS decision FROM (SELECT *, unnest(range(1, len(decisions) + 1)) AS pos FROM t_sections)"""


@query("flatten_decisions", "SELECT meeting_id, chunk_id, pos, titre, decision FROM t_flat")
def flatten_decisions(spark, sf):
    return reports.flatten_decisions(sections(spark, sf)).drop("start_time")


@query(
    "decision_dedup",
    """SELECT meeting_id, chunk_id, pos, decision FROM (SELECT *, row_number() OVER (PARTITION BY meeting_id, k ORDER BY chunk_id, pos) AS rn FROM (
         SELECT meeting_id, chunk_id, pos, decision, array_to_string(list_filter(string_split_regex(lower(decision), '\\s+'), lambda w: w <> ''), ' ') AS k FROM t_flat)) WHERE rn = 1""",
)
def decision_dedup(spark, sf):
    flat = reports.flatten_decisions(sections(spark, sf))
    return reports.decision_dedup(flat).select("meeting_id", "chunk_id", "pos", "decision")


SQL["t_plan"] = f"""
SELECT meeting_id, chunk_id, row_number() OVER (PARTITION BY meeting_id ORDER BY rank, start_time, chunk_id, pos) AS no, action, sujet, responsable, echeance FROM (
  SELECT meeting_id, chunk_id, start_time, pos, CASE WHEN p.type = 'engagement' THEN 0 ELSE 1 END AS rank, trim(p.action, {BLANKS}) AS action,
    coalesce(nullif(trim(titre), ''), '—') AS sujet, coalesce(nullif(p.responsable, ''), '—') AS responsable, coalesce(nullif(p.echeance, ''), '—') AS echeance
  FROM (SELECT *, plan[pos] AS p FROM (SELECT *, unnest(range(1, len(plan) + 1)) AS pos FROM t_sections))) WHERE action <> ''"""


@query("plan_assembly", "SELECT meeting_id, no, action, sujet, responsable, echeance FROM t_plan")
def plan_assembly(spark, sf):
    return reports.plan_assembly(sections(spark, sf)).select("meeting_id", "no", "action", "sujet", "responsable", "echeance")


@query(
    "plan_dispatch",
    "SELECT meeting_id, no, action, sujet, responsable, echeance FROM t_plan UNION ALL SELECT meeting_id, chunk_id, resume, titre, '—', '—' FROM t_sections",
)
def plan_dispatch(spark, sf):
    """An unknown mode gives the per-chunk plan; the older mode gives the plan table it is handed."""
    s = sections(spark, sf)
    cols = ["meeting_id", "no", "action", "sujet", "responsable", "echeance"]
    given = s.select(
        "meeting_id", F.col("chunk_id").cast("long").alias("no"), F.col("resume").alias("action"), F.col("titre").alias("sujet"),
        F.lit("—").alias("responsable"), F.lit("—").alias("echeance"),
    )
    return reports.plan_assembly(s, "unknown").select(*cols).unionByName(reports.plan_assembly(s, "legacy", given).select(*cols))


@query("plan_item_cap", "SELECT meeting_id, chunk_id, least(len(plan), 2) AS n, array_to_string(list_transform(plan[1:2], lambda p: p.action), ';') AS actions FROM t_sections")
def plan_item_cap(spark, sf):
    out = reports.plan_item_cap(sections(spark, sf))
    return out.select(
        "meeting_id", "chunk_id", F.size("plan").alias("n"), F.array_join(F.transform("plan", lambda p: p["action"]), ";").alias("actions")
    )


SQL["t_counts"] = """
SELECT meeting_id, chunk_id, titre, start_time, end_time, len(decisions) AS n_decisions, len(list_filter(plan, lambda p: p.type = 'engagement')) AS n_engagements,
  len(list_filter(plan, lambda p: p.type = 'suggestion')) AS n_suggestions FROM t_sections"""


@query("section_counts", "SELECT * FROM t_counts")
def section_counts(spark, sf):
    return reports.section_counts(sections(spark, sf))


@query(
    "assembly_totals",
    """SELECT meeting_id, count(*) AS n_sections, CAST(sum(n_decisions) AS BIGINT) AS n_decisions_total, CAST(sum(n_engagements) AS BIGINT) AS n_engagements_total,
       CAST(sum(n_suggestions) AS BIGINT) AS n_suggestions_total FROM t_counts GROUP BY 1""",
)
def assembly_totals(spark, sf):
    return reports.assembly_totals(sections(spark, sf))


SQL["t_people"] = """
SELECT 'm' || c_nationkey AS meeting_id, c_name AS nom, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_mktsegment END AS entreprise FROM customer"""
SQL["t_firms"] = """
SELECT meeting_id, coalesce(entreprise, 'Non précisé') AS company, string_agg(nom, ', ' ORDER BY nom) AS names FROM t_people GROUP BY 1, 2"""


def people(spark, sf):
    c = tables.read(spark, sf, "customer")
    firm = F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment"))
    return c.select(F.concat(F.lit("m"), "c_nationkey").alias("meeting_id"), F.col("c_name").alias("nom"), firm.alias("entreprise"))


@query("participants_by_company", "SELECT * FROM t_firms")
def participants_by_company(spark, sf):
    return reports.participants_by_company(people(spark, sf))


def summaries(spark, sf):
    return sections(spark, sf).select("meeting_id").distinct().withColumn("exec_summary", F.concat(F.lit(" Bilan de "), "meeting_id", F.lit(" ")))


def report(spark, sf):
    s = sections(spark, sf)
    met = summaries(spark, sf)
    known = people(spark, sf).join(met.select("meeting_id"), "meeting_id", "left_semi")
    return reports.assemble_report(s, met, cut_lineage(reports.plan_assembly(s)), known)


LINES = "[{}]"
SQL["t_report"] = f"""
WITH m AS (SELECT s.meeting_id, CASE WHEN p.meeting_id IS NULL THEN 0 ELSE 1 END AS k FROM (SELECT DISTINCT meeting_id FROM t_sections) s
   LEFT JOIN (SELECT DISTINCT meeting_id FROM t_people) p ON p.meeting_id = s.meeting_id),
s AS (SELECT *, trim(coalesce(contexte, ''), {BLANKS}) AS c, list_filter(list_transform(points, lambda p: trim(p, {BLANKS})), lambda p: p <> '') AS b,
   row_number() OVER (PARTITION BY meeting_id ORDER BY start_time, chunk_id) AS no FROM t_sections),
b AS (
 SELECT meeting_id, 0 AS block, 0 AS sec, ['# Compte rendu de réunion', ''] AS l FROM m
 UNION ALL SELECT meeting_id, 1, 0, ['## 1. Participants', ''] FROM m WHERE k = 1
 UNION ALL SELECT f.meeting_id, 1, row_number() OVER (PARTITION BY f.meeting_id ORDER BY company), ['**' || company || '** : ' || names, ''] FROM t_firms f JOIN m ON m.meeting_id = f.meeting_id
 UNION ALL SELECT meeting_id, 1, 1000000000, [''] FROM m WHERE k = 1
 UNION ALL SELECT meeting_id, 2, 0, ['## ' || (1 + k) || '. Résumé', '', 'Bilan de ' || meeting_id, ''] FROM m
 UNION ALL SELECT meeting_id, 3, 0, ['## ' || (2 + k) || '. Sujets abordés', ''] FROM m
 UNION ALL SELECT meeting_id, 4, no, ['### ' || no || '. ' || titre, ''] || CASE WHEN c <> '' OR len(b) > 0 THEN
     CASE WHEN c <> '' THEN [c, ''] ELSE [] END || list_transform(b, lambda p: '- ' || p) || CASE WHEN len(b) > 0 THEN [''] ELSE [] END
     ELSE [trim(resume, {BLANKS}), ''] END
   || CASE WHEN len(decisions) > 0 THEN ['**Décisions :**', ''] || list_transform(decisions, lambda d: '- ' || d) || [''] ELSE [] END FROM s
 UNION ALL SELECT meeting_id, 5, 0, ['## ' || (3 + k) || '. Décisions', ''] || CASE WHEN meeting_id IN (SELECT meeting_id FROM t_flat)
     THEN ['| # | Sujet | Décision |', '|---|-------|----------|'] ELSE ['_Aucune décision formellement prise._', ''] END FROM m
 UNION ALL SELECT meeting_id, 5, row_number() OVER (PARTITION BY meeting_id ORDER BY start_time, chunk_id, pos),
     ['| ' || row_number() OVER (PARTITION BY meeting_id ORDER BY start_time, chunk_id, pos) || ' | ' || titre || ' | ' || replace(decision, '|', '\\|') || ' |'] FROM t_flat
 UNION ALL SELECT DISTINCT meeting_id, 5, 1000000000, [''] FROM t_flat
 UNION ALL SELECT meeting_id, 6, 0, ['## ' || (4 + k) || '. Plan d''attaque', ''] || CASE WHEN meeting_id IN (SELECT meeting_id FROM t_plan)
     THEN ['| # | Sujet | Action | Responsable | Échéance |', '|---|-------|--------|-------------|----------|'] ELSE ['_Aucune action à planifier._', ''] END FROM m
 UNION ALL SELECT meeting_id, 6, no, ['| ' || no || ' | ' || replace(sujet, '|', '\\|') || ' | ' || replace(action, '|', '\\|') || ' | ' || responsable || ' | ' || echeance || ' |'] FROM t_plan
 UNION ALL SELECT DISTINCT meeting_id, 6, 1000000000, [''] FROM t_plan)
SELECT meeting_id, row_number() OVER (PARTITION BY meeting_id ORDER BY block, sec, p) AS line_no, l[p] AS line FROM (SELECT *, unnest(range(1, len(l) + 1)) AS p FROM b)"""


@query("assemble_report", "SELECT * FROM t_report")
def assemble_report(spark, sf):
    lines = cut_lineage(report(spark, sf))
    return reports.report_numbering(lines).select("meeting_id", "line_no", "line")


@query("report_numbering", "SELECT meeting_id, line_no, line FROM t_report WHERE regexp_matches(line, '^#{2,3} \\d')")
def report_numbering(spark, sf):
    return assemble_report(spark, sf).filter(F.col("line").rlike(r"^#{2,3} \d"))


SQL["t_memory"] = f"""
SELECT meeting_id, chunk_id, resume, list_filter(decisions, lambda d: trim(d, {BLANKS}) <> '') AS decisions,
  list_filter(list_transform(plan, lambda p: {{'action': CASE WHEN chunk_id = 1 THEN '' ELSE p.action END, 'responsable': p.responsable, 'echeance': p.echeance}}), lambda a: a.action <> '') AS actions
FROM t_sections"""


def memory(spark, sf):
    actions = F.transform(
        "plan",
        lambda p: F.struct(
            F.when(F.col("chunk_id") == 1, "").otherwise(p["action"]).alias("action"), p["responsable"].alias("responsable"), p["echeance"].alias("echeance")
        ),
    )
    return sections(spark, sf).select(
        "meeting_id", "chunk_id", "start_time", "titre", "resume", replies.memory_clean(F.col("decisions")).alias("decisions"),
        replies.memory_actions(actions).alias("actions"),
    )


@query("memory_clean", "SELECT meeting_id, chunk_id, len(decisions) AS n_decisions, array_to_string(list_transform(actions, lambda a: a.action), ';') AS actions FROM t_memory")
def memory_clean(spark, sf):
    return memory(spark, sf).select(
        "meeting_id", "chunk_id", F.size("decisions").alias("n_decisions"), F.array_join(F.transform("actions", lambda a: a["action"]), ";").alias("actions")
    )


@query("memory_overview", "SELECT meeting_id, chunk_id, chunk_id || ' : ' || resume AS overview, '- ' || resume AS bullet FROM t_memory")
def memory_overview(spark, sf):
    return reports.memory_overview(memory(spark, sf))


@query(
    "meta_block",
    f"""SELECT c_custkey, CASE WHEN t = '' THEN '' ELSE t || chr(10) || chr(10) END AS block FROM (SELECT c_custkey, concat_ws(chr(10),
          CASE WHEN c_nationkey > 5 THEN '{replies.META_PARTICIPANTS}' || c_name END, CASE WHEN c_nationkey > 10 THEN '{replies.META_COMPANIES}' || c_mktsegment END,
          CASE WHEN c_nationkey > 20 THEN '{replies.META_CONTEXT.replace("'", "''")}' || c_mktsegment END) AS t FROM customer)""",
)
def meta_block(spark, sf):
    c = tables.read(spark, sf, "customer")
    pick = lambda n, v: F.when(F.col("c_nationkey") > n, F.col(v)).otherwise(" ")
    return c.select("c_custkey", replies.meta_block(pick(5, "c_name"), pick(10, "c_mktsegment"), pick(20, "c_mktsegment")).alias("block"))


def routes(spark, sf):
    """Every section routes to itself, its successor and an id no chunk has."""
    s = sections(spark, sf)
    ids = F.when(F.col("chunk_id") == 2, F.array(F.lit(99))).otherwise(F.array(F.col("chunk_id") + 1, F.lit(99), F.col("chunk_id")))
    return s.select("meeting_id", (F.col("chunk_id") + 1).alias("sec_no"), "titre", ids.alias("chunk_ids"))


@query(
    "section_chunk_routing",
    """WITH r AS (SELECT meeting_id, chunk_id + 1 AS sec_no, CASE WHEN chunk_id = 2 THEN [99] ELSE [chunk_id + 1, 99, chunk_id] END AS ids FROM t_sections),
       e AS (SELECT meeting_id, sec_no, pos, ids[pos] AS cid FROM (SELECT *, unnest(range(1, len(ids) + 1)) AS pos FROM r))
       SELECT r.meeting_id, r.sec_no, coalesce(string_agg('=== passage ' || cid || ' ===' || chr(10) || resume, chr(10) || chr(10) ORDER BY pos) FILTER (WHERE resume IS NOT NULL), '(aucun passage)') AS passages
       FROM r LEFT JOIN (SELECT e.*, s.resume FROM e JOIN t_sections s ON s.meeting_id = e.meeting_id AND s.chunk_id = e.cid) e ON e.meeting_id = r.meeting_id AND e.sec_no = r.sec_no GROUP BY 1, 2""",
)
def section_chunk_routing(spark, sf):
    chunks = sections(spark, sf).select("meeting_id", "chunk_id", F.col("resume").alias("text"))
    return reports.section_chunk_routing(routes(spark, sf), chunks)


@query(
    "routing_table",
    """SELECT meeting_id, chunk_id + 1 AS sec_no, 'Section ' || (chunk_id + 1) || ' « ' || titre || ' » <- chunks [' || CASE WHEN chunk_id = 2 THEN '99' ELSE (chunk_id + 1) || ', 99, ' || chunk_id END || ']' AS line FROM t_sections""",
)
def routing_table(spark, sf):
    return reports.routing_table(routes(spark, sf))


@query(
    "head_lines",
    "SELECT meeting_id, string_agg(raw, chr(10) ORDER BY line_no) AS intro FROM t_doc_lines WHERE line_no < 80 GROUP BY 1",
)
def head_lines(spark, sf):
    return reports.head_lines(tables.document_lines(spark, sf), 80)


@query(
    "assemble_report_v2",
    f"""WITH m AS (SELECT DISTINCT meeting_id FROM t_sections), w AS (SELECT meeting_id, chunk_id + 1 AS no, titre, trim(resume, {BLANKS}) AS body FROM t_sections),
       d0 AS (SELECT meeting_id, chunk_id, pos, decision, array_to_string(list_filter(string_split_regex(lower(decision), '\\s+'), lambda w: w <> ''), ' ') AS k FROM t_flat),
       d1 AS (SELECT *, row_number() OVER (PARTITION BY meeting_id, k ORDER BY chunk_id, pos) AS rn FROM d0),
       d AS (SELECT meeting_id, decision, row_number() OVER (PARTITION BY meeting_id ORDER BY chunk_id, pos) AS no FROM d1 WHERE rn = 1),
       a0 AS (SELECT meeting_id, chunk_id, pos, actions[pos] AS a FROM (SELECT *, unnest(range(1, len(actions) + 1)) AS pos FROM t_memory)),
       a AS (SELECT meeting_id, a.action AS action, a.responsable AS responsable, a.echeance AS echeance, row_number() OVER (PARTITION BY meeting_id ORDER BY chunk_id, pos) AS no FROM a0),
       b AS (SELECT meeting_id, 0 AS block, 0 AS sec, ['# Compte rendu de réunion', '', '_Type de réunion_ : **point**', '', '_Objectif_ : suivre ' || meeting_id, '', '## Synthèse', '', 'Tout va bien.', '', '## Sujets abordés', ''] AS l FROM m
         UNION ALL SELECT meeting_id, 1, no, ['### ' || no || '. ' || titre, '', body, ''] FROM w
         UNION ALL SELECT DISTINCT meeting_id, 2, 0, ['## Décisions', '', '| # | Décision |', '|---|---|'] FROM d
         UNION ALL SELECT meeting_id, 2, no, ['| ' || no || ' | ' || trim(replace(decision, '|', '\\|')) || ' |'] FROM d
         UNION ALL SELECT DISTINCT meeting_id, 2, 1000000000, [''] FROM d
         UNION ALL SELECT DISTINCT meeting_id, 3, 0, ['## Plan d''action', '', '| # | Action | Responsable | Échéance |', '|---|---|---|---|'] FROM a
         UNION ALL SELECT meeting_id, 3, no, ['| ' || no || ' | ' || trim(replace(action, '|', '\\|')) || ' | ' || coalesce(responsable, '—') || ' | ' || coalesce(echeance, '—') || ' |'] FROM a
         UNION ALL SELECT DISTINCT meeting_id, 3, 1000000000, [''] FROM a)
       SELECT meeting_id, row_number() OVER (PARTITION BY meeting_id ORDER BY block, sec, p) AS line_no, l[p] AS line FROM (SELECT *, unnest(range(1, len(l) + 1)) AS p FROM b)""",
)
def assemble_report_v2(spark, sf):
    s = sections(spark, sf)
    mem = memory(spark, sf)
    met = s.select("meeting_id").distinct().select(
        "meeting_id", F.lit("point").alias("type"), F.concat(F.lit("suivre "), "meeting_id").alias("objectif"),
        F.lit(" ").alias("participants"), F.lit("").alias("entreprises"), F.lit("Tout va bien.").alias("resume_global"),
    )
    written = s.select("meeting_id", (F.col("chunk_id") + 1).alias("no"), "titre", F.col("resume").alias("body"))
    unique = reports.decision_dedup(reports.flatten_decisions(mem.withColumn("decisions", F.col("decisions"))))
    decisions = reports.number_decisions(unique)
    flat = mem.select("meeting_id", "start_time", "chunk_id", F.posexplode("actions").alias("pos", "a")).select(
        "meeting_id", "start_time", "chunk_id", "pos", "a.*"
    )
    actions = reports.number_decisions(flat)
    return reports.report_numbering(reports.assemble_report_v2(met, written, decisions, actions)).select("meeting_id", "line_no", "line")


# --- Markdown read back -----------------------------------------------------------------------------------------


def report_lines(spark, sf):
    """Assembled reports and the documents, line by line, with a fenced block around one line of each document."""
    mine = assemble_report(spark, sf).select(F.col("meeting_id").alias("report_id"), "line_no", F.col("line").alias("raw"))
    docs = tables.document_lines(spark, sf).select(
        F.col("meeting_id").alias("report_id"), (F.col("line_no") + 1).cast("long").alias("line_no"),
        F.when(F.col("line_no").isin(1, 3), "```").otherwise(F.col("raw")).alias("raw"),
    )
    return cut_lineage(mine.unionByName(docs))


SQL["t_md"] = "SELECT meeting_id AS report_id, line_no, line AS raw FROM t_report UNION ALL SELECT meeting_id, line_no + 1, CASE WHEN line_no IN (1, 3) THEN '```' ELSE raw END FROM t_doc_lines"
SQL["t_kinds"] = f"""
WITH a AS (SELECT *, trim(raw, {BLANKS}) AS s FROM t_md),
b AS (SELECT *, starts_with(s, '|') AND ends_with(s, '|') AND length(s) >= 2 AS isrow, starts_with(s, '```') AS fen,
  starts_with(s, '|') AND ends_with(s, '|') AND length(s) >= 2 AND regexp_matches(s, '^[|]+( *(:?-{{2,}}:?)? *[|])*[|]*$') AS sep FROM a),
c AS (SELECT *, coalesce(sum(CASE WHEN fen THEN 1 ELSE 0 END) OVER (PARTITION BY report_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS ins,
  lead(sep) OVER (PARTITION BY report_id ORDER BY line_no) AS nsep FROM b),
d AS (SELECT *, isrow AND NOT ins AS tr, sum(CASE WHEN isrow AND NOT ins THEN 0 ELSE 1 END) OVER (PARTITION BY report_id ORDER BY line_no) AS g FROM c),
e AS (SELECT *, min(CASE WHEN tr AND coalesce(nsep, false) THEN line_no END) OVER (PARTITION BY report_id, g) AS st FROM d)
SELECT report_id, line_no, raw, CASE WHEN fen THEN 'fence' WHEN ins THEN 'code' WHEN tr AND line_no = st THEN 'table_header' WHEN tr AND line_no = st + 1 THEN 'table_separator'
  WHEN tr AND line_no > st THEN 'table_row' WHEN regexp_matches(s, '^#{{1,6}}\\s+.+$') THEN 'heading' || length(regexp_extract(s, '^(#{{1,6}})\\s', 1))
  WHEN regexp_matches(s, '^[-*]\\s+') THEN 'bullet' WHEN regexp_matches(s, '^\\d+\\\\?\\.\\s+') THEN 'ordered' WHEN starts_with(s, '>') THEN 'quote' ELSE 'paragraph' END AS kind,
  CASE WHEN tr AND line_no >= st THEN st END AS table_at FROM e WHERE s <> '' OR (ins AND NOT fen)"""


@query("md_block_kinds", "SELECT report_id, line_no, kind, table_at FROM t_kinds")
def md_block_kinds(spark, sf):
    return markdown.block_kinds(report_lines(spark, sf)).select("report_id", "line_no", "kind", "table_at")


@query(
    "md_table_cells",
    f"""SELECT report_id, table_at, line_no, p - 1 AS col_no, regexp_replace(replace(trim(cs[p], {BLANKS}), chr(1), '|'), '\\\\([\\\\`*_{{}}\\[\\]()#+\\-.!|>])', '\\1', 'g') AS cell FROM (
         SELECT *, unnest(range(1, len(cs) + 1)) AS p FROM (SELECT *, string_split(replace(regexp_replace(regexp_replace(trim(raw, {BLANKS}), '^\\|', ''), '\\|$', ''), '\\|', chr(1)), '|') AS cs
           FROM t_kinds WHERE kind IN ('table_header', 'table_row')))""",
)
def md_table_cells(spark, sf):
    return markdown.table_cells(markdown.block_kinds(report_lines(spark, sf)))


SQL["t_span_src"] = """
SELECT doc_id, pos, CASE (pos + doc_id) % 5 WHEN 0 THEN '**' || w || '** x *' || w || '*' WHEN 1 THEN '_' || w || '_ et `' || w || '`' WHEN 2 THEN '[' || w || '](http://x/' || pos || ')' ELSE w END AS content
FROM (SELECT doc_id, pos, parts[pos] AS w FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS pos FROM (SELECT doc_id, string_split(text, ' ') AS parts FROM documents)))"""


@query(
    "md_inline_spans",
    """WITH s AS (SELECT doc_id, pos, regexp_extract_all(regexp_replace(content, '\\\\([\\\\`*_{}\\[\\]()#+\\-.!|>])', '\\1', 'g'),
          '(\\*\\*[^*\\n]+\\*\\*|\\*[^*\\n]+\\*|_[^_\\n]+_|`[^`\\n]+`|\\[[^\\]]+\\]\\([^)]+\\))', 1) AS t FROM t_span_src)
       SELECT doc_id, pos, k - 1 AS span_no, CASE WHEN starts_with(t[k], '**') THEN 'bold' WHEN starts_with(t[k], '`') THEN 'code' WHEN starts_with(t[k], '[') THEN 'link' ELSE 'italic' END AS kind,
         CASE WHEN starts_with(t[k], '**') THEN substr(t[k], 3, length(t[k]) - 4) WHEN starts_with(t[k], '[') THEN regexp_extract(t[k], '^\\[([^\\]]+)\\]', 1) ELSE substr(t[k], 2, length(t[k]) - 2) END AS text
       FROM (SELECT *, unnest(range(1, len(t) + 1)) AS k FROM s)""",
)
def md_inline_spans(spark, sf):
    d = tables.read_texts(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "w"))
    d = d.withColumn("pos", F.col("pos") + 1)
    k, w = (F.col("pos") + F.col("doc_id")) % 5, F.col("w")
    content = (
        F.when(k == 0, F.concat(F.lit("**"), w, F.lit("** x *"), w, F.lit("*")))
        .when(k == 1, F.concat(F.lit("_"), w, F.lit("_ et `"), w, F.lit("`")))
        .when(k == 2, F.concat(F.lit("["), w, F.lit("](http://x/"), F.col("pos").cast("string"), F.lit(")")))
        .otherwise(w)
    )
    return markdown.inline_spans(d.select("doc_id", "pos", content.alias("content")), "content")
