"""Report assembly: every block is a set of (meeting_id, block, sec, pos, line) rows, put in order at the sink.

No report is built in one cell. Numbers inside a report come from bucketed scans over the section order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.functions import text
from palaver.functions.replies import UNKNOWN
from palaver.plans.rows import ordered_text
from palaver.plans.scans import by_index, running_number

# --- fixed values -----------------------------------------------------------------------------------------------
TITLE = "# Compte rendu de réunion"
PARTICIPANTS, SUMMARY, TOPICS, DECISIONS, PLAN = (
    "Participants", "Résumé", "Sujets abordés", "Décisions", "Plan d'attaque",
)
NO_COMPANY = "Non précisé"
SECTION_DECISIONS = "**Décisions :**"
DECISION_HEAD = ("| # | Sujet | Décision |", "|---|-------|----------|")
PLAN_HEAD = ("| # | Sujet | Action | Responsable | Échéance |", "|---|-------|--------|-------------|----------|")
NO_DECISION = "_Aucune décision formellement prise._"
NO_ACTION = "_Aucune action à planifier._"
NO_PASSAGE = "(aucun passage)"
V2_TYPE, V2_GOAL, V2_PEOPLE, V2_FIRMS = "_Type de réunion_", "_Objectif_", "_Participants_", "_Entreprises_"
V2_SYNTHESIS, V2_ACTIONS = "Synthèse", "Plan d'action"
V2_DECISION_HEAD = ("| # | Décision |", "|---|---|")
V2_ACTION_HEAD = ("| # | Action | Responsable | Échéance |", "|---|---|---|---|")
PLAN_MODES = ("perchunk", "legacy")
# ----------------------------------------------------------------------------------------------------------------

LAST = 1 << 40  # section number that sorts after all others


def _rows(df: DataFrame, block: int, sec: Column, pos: Column, line: Column) -> DataFrame:
    return df.select(
        "meeting_id", F.lit(block).alias("block"), sec.cast("long").alias("sec"), pos.cast("long").alias("pos"), line.alias("line")
    ).filter("line IS NOT NULL")


def _fixed(df: DataFrame, block: int, sec: int, *lines: Column | str) -> DataFrame:
    """The same few lines for each row of ``df`` (one per meeting)."""
    arr = F.array(*[F.lit(x) if isinstance(x, str) else x for x in lines])
    rows = df.withColumn("_l", arr).select("*", F.posexplode("_l").alias("_p", "_line"))
    return _rows(rows, block, F.lit(sec), F.col("_p"), F.col("_line"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sort_sections(sections: DataFrame) -> DataFrame:
    """``no``: 1-based order of a meeting's sections by start time."""
    return running_number(
        sections, ["meeting_id"], ["start_time", "chunk_id"], F.floor(F.col("start_time") / 3600), "no"
    )


def flatten_decisions(sections: DataFrame) -> DataFrame:
    """(meeting_id, start_time, chunk_id, pos, titre, decision) in section order."""
    return sections.select(
        "meeting_id", "start_time", "chunk_id", "titre", F.posexplode("decisions").alias("pos", "decision")
    )


def number_decisions(flat: DataFrame) -> DataFrame:
    return running_number(
        flat, ["meeting_id"], ["start_time", "chunk_id", "pos"], F.floor(F.col("start_time") / 3600), "no"
    )


def decision_dedup(flat: DataFrame) -> DataFrame:
    """First of each decision after lower-casing and collapsing blanks, in order."""
    norm = F.array_join(F.filter(F.split(F.lower("decision"), text.unicode_blanks(r"\s+")), lambda w: w != ""), " ")
    at = F.struct("start_time", "chunk_id", "pos")
    first = flat.withColumn("_k", norm).groupBy("meeting_id", "_k").agg(
        F.min_by(F.struct("start_time", "chunk_id", "pos", "titre", "decision"), at).alias("d")
    )
    return first.select("meeting_id", "d.*")


def plan_assembly(sections: DataFrame, mode: str = "perchunk", legacy: DataFrame | None = None) -> DataFrame:
    """Plan rows: engagements first, then suggestions, each in section order.

    ``legacy`` plans come from a model reply table; an unknown mode falls back to ``perchunk``.
    """
    if mode == "legacy" and legacy is not None:
        return legacy
    items = sections.select(
        "meeting_id", "start_time", "chunk_id", "titre", F.posexplode("plan").alias("pos", "p")
    ).withColumn("action", text.strip(F.col("p.action"))).filter("action <> ''")
    titre = text.strip(F.coalesce("titre", F.lit("")))
    known = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(UNKNOWN))
    firm = F.coalesce(F.col("p.type") == "engagement", F.lit(False))
    rows = items.select(
        "meeting_id",
        F.when(firm, 0).otherwise(1).alias("rank"),
        "start_time",
        "chunk_id",
        "pos",
        "action",
        F.when(titre != "", titre).otherwise(F.lit(UNKNOWN)).alias("sujet"),
        known("p.responsable").alias("responsable"),
        known("p.echeance").alias("echeance"),
    )
    # suggestions follow all engagements, so the slice keeps the two apart
    slot = F.col("rank") * 100000000 + F.least(F.floor(F.col("start_time") / 3600), F.lit(99999999))
    return running_number(rows, ["meeting_id"], ["rank", "start_time", "chunk_id", "pos"], slot, "no")


def plan_item_cap(sections: DataFrame, most: int = 2) -> DataFrame:
    return sections.withColumn("plan", F.slice("plan", 1, most))


def section_counts(sections: DataFrame) -> DataFrame:
    """Decisions, engagements and suggestions per section."""
    of = lambda t: F.size(F.filter("plan", lambda p: p["type"] == t))
    return sections.select(
        "meeting_id", "chunk_id", "titre", "start_time", "end_time", F.size("decisions").alias("n_decisions"),
        of("engagement").alias("n_engagements"), of("suggestion").alias("n_suggestions"),
    )


def assembly_totals(sections: DataFrame) -> DataFrame:
    return section_counts(sections).groupBy("meeting_id").agg(
        F.count("*").alias("n_sections"),
        *[F.sum(c).alias(f"{c}_total") for c in ("n_decisions", "n_engagements", "n_suggestions")],
    )


def participants_by_company(speakers: DataFrame) -> DataFrame:
    """Company lines: sorted names joined. Names per company of one meeting are few."""
    company = F.coalesce(F.nullif("entreprise", F.lit("")), F.lit(NO_COMPANY)).alias("company")
    return speakers.groupBy("meeting_id", company).agg(F.array_join(F.sort_array(F.collect_list("nom")), ", ").alias("names"))


def assemble_report(
    sections: DataFrame, summaries: DataFrame, plan: DataFrame, speakers: DataFrame | None = None
) -> DataFrame:
    """All lines of the reports. ``summaries`` is (meeting_id, exec_summary), one row per report."""
    meetings = summaries.select("meeting_id", "exec_summary")
    facts = {
        "_people": None if speakers is None else speakers.select("meeting_id").distinct(),
        "_decided": sections.filter(F.size("decisions") > 0).select("meeting_id").distinct(),
        "_planned": plan.select("meeting_id").distinct(),
    }
    for name, have in facts.items():
        if have is None:
            meetings = meetings.withColumn(name, F.lit(False))
        else:
            meetings = meetings.join(have.withColumn(name, F.lit(True)), "meeting_id", "left").withColumn(
                name, F.coalesce(name, F.lit(False))
            )
    shift = F.col("_people").cast("int")

    def head(n: int, title: str) -> Column:
        return F.concat(F.lit("## "), (shift + n).cast("string"), F.lit(f". {title}"))

    def at(block: int, sec: int, *lines: Column | str, only: Column | None = None) -> Column:
        """Lines at one place of the report, as structs; none where ``only`` does not hold."""
        rows = [
            F.struct(
                F.lit(block).alias("block"), F.lit(sec).cast("long").alias("sec"), F.lit(i).cast("long").alias("pos"),
                (F.lit(x) if isinstance(x, str) else x).alias("line"),
            )
            for i, x in enumerate(lines)
        ]
        full = F.array(*rows)
        return full if only is None else F.when(only, full).otherwise(F.slice(full, 1, 0))

    people, decided, planned = F.col("_people"), F.col("_decided"), F.col("_planned")
    frame = F.concat(
        at(0, 0, TITLE, ""),
        at(1, 0, f"## 1. {PARTICIPANTS}", "", only=people),
        at(1, LAST, "", only=people),
        at(2, 0, head(1, SUMMARY), "", text.strip(F.col("exec_summary")), ""),
        at(3, 0, head(2, TOPICS), ""),
        at(5, 0, head(3, DECISIONS), ""),
        at(5, 1, *DECISION_HEAD, only=decided),
        at(5, LAST, "", only=decided),
        at(5, 1, NO_DECISION, "", only=~decided),
        at(6, 0, head(4, PLAN), ""),
        at(6, 1, *PLAN_HEAD, only=planned),
        at(6, LAST, "", only=planned),
        at(6, 1, NO_ACTION, "", only=~planned),
    )
    parts = [meetings.select("meeting_id", F.inline(frame))]
    if speakers is not None:
        firms = participants_by_company(speakers)
        ranked = running_number(firms, ["meeting_id"], ["company"], F.lit(0).cast("long"), "no")
        lines = F.array(F.concat(F.lit("**"), "company", F.lit("** : "), "names"), F.lit(""))
        spread = ranked.select("meeting_id", "no", F.posexplode(lines).alias("p", "l"))
        parts.append(_rows(spread, 1, F.col("no"), F.col("p"), F.col("l")))

    context = text.strip(F.coalesce("contexte", F.lit("")))
    points = F.filter(F.transform("points", text.strip), lambda p: p != "")
    points = F.coalesce(points, F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    blank = F.array(F.lit(""))
    bullets = lambda arr: F.transform(arr, lambda p: F.concat(F.lit("- "), p))
    body = F.when(
        (F.col("_context") != "") | (F.size("_points") > 0),
        F.concat(
            F.when(F.col("_context") != "", F.array(F.col("_context"), F.lit(""))).otherwise(none),
            bullets(F.col("_points")),
            F.when(F.size("_points") > 0, blank).otherwise(none),
        ),
    ).otherwise(F.array(text.strip(F.coalesce("resume", F.lit(""))), F.lit("")))
    decisions = F.when(
        F.size("decisions") > 0, F.concat(F.array(F.lit(SECTION_DECISIONS), F.lit("")), bullets(F.col("decisions")), blank)
    ).otherwise(none)
    title = F.array(F.concat(F.lit("### "), F.col("no").cast("string"), F.lit(". "), F.coalesce("titre", F.lit(""))), F.lit(""))
    ordered = sort_sections(sections).withColumns({"_context": context, "_points": points})
    topic = ordered.select("meeting_id", "no", F.posexplode(F.concat(title, body, decisions)).alias("p", "l"))
    parts.append(_rows(topic, 4, F.col("no"), F.col("p"), F.col("l")))

    row = F.concat(
        F.lit("| "), F.col("no").cast("string"), F.lit(" | "), F.coalesce("titre", F.lit("")), F.lit(" | "),
        text.escape_pipes(F.col("decision")), F.lit(" |"),
    )
    parts.append(_rows(number_decisions(flatten_decisions(sections)), 5, F.col("no") + 1, F.lit(0), row))
    cells = [F.col("no").cast("string"), text.escape_pipes(F.col("sujet")), text.escape_pipes(F.col("action")), F.col("responsable"), F.col("echeance")]
    parts.append(_rows(plan, 6, F.col("no") + 1, F.lit(0), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))))
    return _union(parts)


def assemble_report_v2(meetings: DataFrame, written: DataFrame, decisions: DataFrame, actions: DataFrame) -> DataFrame:
    """The other report layout.

    ``meetings`` has type, objectif, participants, entreprises and resume_global; ``written`` the section texts
    (meeting_id, no, titre, body); ``decisions`` and ``actions`` are numbered rows.
    """

    def when_set(value: str, *lines: Column) -> Column:
        ok = text.strip(F.coalesce(value, F.lit(""))) != ""
        return F.when(ok, F.array(*lines)).otherwise(F.array().cast("array<string>"))

    def tag(name: str, value: str) -> Column:
        return F.concat(F.lit(f"{name} : "), F.col(value))

    top = F.concat(
        F.array(F.lit(TITLE), F.lit(""), F.concat(F.lit(f"{V2_TYPE} : **"), F.col("type"), F.lit("**")), F.lit("")),
        when_set("objectif", tag(V2_GOAL, "objectif"), F.lit("")),
        when_set("participants", tag(V2_PEOPLE, "participants"), F.lit("")),
        when_set("entreprises", tag(V2_FIRMS, "entreprises"), F.lit("")),
        when_set("resume_global", F.lit(f"## {V2_SYNTHESIS}"), F.lit(""), F.col("resume_global"), F.lit("")),
        F.array(F.lit(f"## {TOPICS}"), F.lit("")),
    )
    parts = [_rows(meetings.select("meeting_id", F.posexplode(top).alias("p", "l")), 0, F.lit(0), F.col("p"), F.col("l"))]
    section = F.array(F.concat(F.lit("### "), F.col("no").cast("string"), F.lit(". "), "titre"), F.lit(""), text.strip(F.col("body")), F.lit(""))
    spread = written.select("meeting_id", "no", F.posexplode(section).alias("p", "l"))
    parts.append(_rows(spread, 1, F.col("no"), F.col("p"), F.col("l")))
    for block, rows, title, header, cells in (
        (2, decisions, DECISIONS, V2_DECISION_HEAD, ["decision"]),
        (3, actions, V2_ACTIONS, V2_ACTION_HEAD, ["action", "responsable", "echeance"]),
    ):
        have = rows.select("meeting_id").distinct()
        parts.append(_fixed(have, block, 0, F.lit(f"## {title}"), "", *header))
        filled = [text.md_cell(F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(UNKNOWN))) for c in cells]
        line = F.concat(F.lit("| "), F.concat_ws(" | ", F.col("no").cast("string"), *filled), F.lit(" |"))
        parts.append(_rows(rows, block, F.col("no"), F.lit(0), line))
        parts.append(_rows(have, block, F.lit(LAST), F.lit(0), F.lit("")))
    return _union(parts)


def section_chunk_routing(routes: DataFrame, chunks: DataFrame) -> DataFrame:
    """Text handed to each section: its known chunks in listed order, or a placeholder."""
    listed = routes.select("meeting_id", "sec_no", F.posexplode("chunk_ids").alias("pos", "chunk_id"))
    block = F.concat(F.lit("=== passage "), F.col("chunk_id").cast("string"), F.lit(" ===\n"), F.col("text"))
    found = listed.join(chunks.select("meeting_id", "chunk_id", "text"), ["meeting_id", "chunk_id"]).withColumn("block", block)
    joined = found.groupBy("meeting_id", "sec_no").agg(ordered_text("block", "pos", "\\n\\n").alias("passages"))
    return routes.select("meeting_id", "sec_no").join(joined, ["meeting_id", "sec_no"], "left").withColumn(
        "passages", F.coalesce("passages", F.lit(NO_PASSAGE))
    )


def routing_table(routes: DataFrame) -> DataFrame:
    """``Section i « title » <- chunks [...]`` lines."""
    ids = F.concat(F.lit("["), F.array_join("chunk_ids", ", "), F.lit("]"))
    line = F.concat(F.lit("Section "), F.col("sec_no").cast("string"), F.lit(" « "), "titre", F.lit(" » <- chunks "), ids)
    return routes.select("meeting_id", "sec_no", line.alias("line"))


def memory_overview(memory: DataFrame) -> DataFrame:
    """``id : summary`` and ``- summary`` lines of the chunk memory, one row per chunk."""
    return memory.select(
        "meeting_id", "chunk_id",
        F.concat(F.col("chunk_id").cast("string"), F.lit(" : "), "resume").alias("overview"),
        F.concat(F.lit("- "), "resume").alias("bullet"),
    )


def head_lines(lines: DataFrame, n: int) -> DataFrame:
    """The first ``n`` transcript lines of each meeting as one text."""
    return lines.filter(F.col("line_no") < n).groupBy("meeting_id").agg(ordered_text("raw", "line_no").alias("intro"))


def report_numbering(lines: DataFrame) -> DataFrame:
    """Position of each line within its report."""
    slot = F.col("block") * 1000000 + F.least(F.floor(F.col("sec") / 1024), F.lit(999999))
    return running_number(lines, ["meeting_id"], ["block", "sec", "pos"], slot, "line_no")
