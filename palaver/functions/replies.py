"""Model replies: JSON extraction, rule checks and clean-up, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palaver.functions.text import strip

# --- fixed values -----------------------------------------------------------------------------------------------
UNKNOWN = "—"
PLAN_TYPES = ("engagement", "suggestion")
REPLY_SCHEMA = (
    "titre STRING, contexte STRING, points ARRAY<STRING>, resume STRING, decisions ARRAY<STRING>, "
    "plan ARRAY<STRUCT<action: STRING, sujet: STRING, responsable: STRING, echeance: STRING, type: STRING>>"
)
META_PARTICIPANTS = "PARTICIPANTS (noms officiels, vérité — à utiliser EXACTEMENT) : "
META_COMPANIES = "ENTREPRISES / ORGANISATIONS présentes : "
META_CONTEXT = "CONTEXTE (fourni par l'utilisateur, pour lever les ambiguïtés de sigles) : "
REMINDER_HEAD = "\n\n--- RAPPEL ENTITÉS (VÉRITÉ ABSOLUE) ---"
REMINDER_RULE = (
    "Reproduis chaque nom EXACTEMENT comme dans les listes ci-dessous (casse, accents, espaces). "
    "Corrige silencieusement toute variante ASR. Ne cite AUCUNE personne ou entreprise absente de ces listes."
)
# ----------------------------------------------------------------------------------------------------------------


def _braced(text: Column) -> Column:
    """From the first ``{`` to the last ``}``; NULL when there is no such pair."""
    first = F.locate("{", text)
    last = F.length(text) - F.locate("}", F.reverse(text)) + 1
    has = (first > 0) & (F.locate("}", text) > 0) & (last > first)
    return F.when(has, F.substr(text, first, last - first + 1))


def json_text_safe(raw: Column) -> Column:
    """JSON inside a reply: the fenced block if there is one, then the outermost braces."""
    text = strip(raw)
    fence = r"(?s)```(?:json)?\s*(.+?)\s*```"
    inner = F.when(text.rlike(fence), strip(F.regexp_extract(text, fence, 1))).otherwise(text)
    return _braced(inner)


def is_json(text: Column) -> Column:
    return F.coalesce(F.try_parse_json(text).isNotNull(), F.lit(False))


def json_text_loose(raw: Column) -> Column:
    """The whole reply when it is JSON, else its outermost braces."""
    return F.when(is_json(raw), strip(raw)).otherwise(_braced(raw))


def parse_reply(json_text: Column, schema: str = REPLY_SCHEMA) -> Column:
    """Struct of the reply; every field NULL when the JSON is broken."""
    return F.from_json(F.when(is_json(json_text), json_text).otherwise(F.lit("{}")), schema)


def clean_strings(values: Column) -> Column:
    kept = F.filter(F.transform(values, strip), lambda v: v.isNotNull() & (v != ""))
    return F.coalesce(kept, F.array().cast("array<string>"))


def compose_summary(contexte: Column, points: Column, resume: Column, raw: Column) -> Column:
    """Context and bullet points; the plain summary or the raw reply when both are missing."""
    context = strip(F.coalesce(contexte, F.lit("")))
    bullets = F.transform(clean_strings(points), lambda p: F.concat(F.lit("- "), p))
    composed = F.concat_ws("\n", F.nullif(context, F.lit("")), F.nullif(F.array_join(bullets, "\n"), F.lit("")))
    fallback = strip(F.coalesce(F.nullif(resume, F.lit("")), strip(raw)))
    return F.when(composed != "", composed).otherwise(fallback)


def normalize_plan_items(plan: Column) -> Column:
    """Plan items with an action; owner and deadline only survive on engagements."""

    def known(value: Column) -> Column:
        return F.coalesce(F.nullif(strip(value), F.lit("")), F.lit(UNKNOWN))

    def item(p: Column) -> Column:
        kind = F.lower(strip(F.coalesce(F.nullif(p["type"], F.lit("")), F.lit("suggestion"))))
        kind = F.when(kind.isin(*PLAN_TYPES), kind).otherwise(F.lit("suggestion"))
        firm = kind == "engagement"
        owner = known(p["responsable"])
        return F.struct(
            strip(p["action"]).alias("action"),
            F.when(firm & ~owner.rlike(r"^SPEAKER_\d+$"), owner).otherwise(F.lit(UNKNOWN)).alias("responsable"),
            F.when(firm, known(p["echeance"])).otherwise(F.lit(UNKNOWN)).alias("echeance"),
            kind.alias("type"),
        )

    kept = F.filter(plan, lambda p: p["action"].isNotNull() & (strip(p["action"]) != ""))
    empty = F.array().cast("array<struct<action:string,responsable:string,echeance:string,type:string>>")
    return F.coalesce(F.transform(kept, item), empty)


def schema_violations(titre: Column, contexte: Column, points: Column, decisions: Column, plan: Column) -> Column:
    """Names of the broken rules: required keys, 2-6 points, at most 2 plan items, known item types."""
    types_ok = F.forall(plan, lambda p: F.coalesce(p["type"].isin(*PLAN_TYPES), F.lit(False)))
    keys_ok = F.forall(
        plan, lambda p: p["action"].isNotNull() & p["responsable"].isNotNull() & p["echeance"].isNotNull()
    )
    rules = (
        ("titre_missing", titre.isNull()),
        ("contexte_missing", contexte.isNull()),
        ("points_missing", points.isNull()),
        ("points_count", points.isNotNull() & ~F.size(points).between(2, 6)),
        ("decisions_missing", decisions.isNull()),
        ("plan_missing", plan.isNull()),
        ("plan_count", plan.isNotNull() & (F.size(plan) > 2)),
        ("plan_type", plan.isNotNull() & ~types_ok),
        ("plan_keys", plan.isNotNull() & ~keys_ok),
    )
    return F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules]))


def speaker_map_clean(mapping: Column) -> Column:
    """Entries with a real name; the text ``null`` counts as missing."""
    named = F.map_filter(
        mapping, lambda _, v: v["nom"].isNotNull() & (v["nom"] != "") & (F.lower(v["nom"]) != "null")
    )
    return F.transform_values(
        named,
        lambda _, v: F.struct(
            v["nom"].alias("nom"),
            F.when(F.lower(v["entreprise"]) != "null", v["entreprise"]).alias("entreprise"),
        ),
    )


def speaker_map_patch(current: Column, updates: Column) -> Column:
    """Upsert of speaker names; an empty or NULL name removes the label."""
    untouched = F.map_filter(current, lambda k, _: ~F.map_contains_key(updates, k))
    named = F.map_filter(updates, lambda _, v: v.isNotNull() & (strip(v) != ""))
    return F.map_concat(untouched, F.transform_values(named, lambda _, v: strip(v)))


def memory_clean(decisions: Column) -> Column:
    kept = F.filter(decisions, lambda d: d.isNotNull() & (strip(d) != ""))
    return F.coalesce(kept, F.array().cast("array<string>"))


def memory_actions(actions: Column) -> Column:
    kept = F.filter(actions, lambda a: a["action"].isNotNull() & (a["action"] != ""))
    return F.coalesce(kept, F.array().cast("array<struct<action:string,responsable:string,echeance:string>>"))


def meta_block(participants: Column, companies: Column, context: Column) -> Column:
    """Official names and context put in front of a prompt; empty when nothing is set."""

    def line(prefix: str, value: Column) -> Column:
        return F.when(strip(value) != "", F.concat(F.lit(prefix), strip(value)))

    lines = F.concat_ws(
        "\n",
        line(META_PARTICIPANTS, participants),
        line(META_COMPANIES, companies),
        line(META_CONTEXT, context),
    )
    return F.when(lines != "", F.concat(lines, F.lit("\n\n"))).otherwise(F.lit(""))


def entity_reminder(participants: Column, companies: Column) -> Column:
    """Reminder added to a prompt when names are known."""
    people, firms = strip(F.coalesce(participants, F.lit(""))), strip(F.coalesce(companies, F.lit("")))
    block = F.concat_ws(
        "\n",
        F.lit(REMINDER_HEAD),
        F.lit(REMINDER_RULE),
        F.when(people != "", F.concat(F.lit("PARTICIPANTS : "), people)),
        F.when(firms != "", F.concat(F.lit("ENTREPRISES : "), firms)),
    )
    return F.when((people == "") & (firms == ""), F.lit("")).otherwise(block)


def render_prompt(template: Column, text: Column, participants: Column, companies: Column) -> Column:
    """Template with ``{texte}`` filled, followed by the reminder."""
    return F.concat(F.replace(template, F.lit("{texte}"), text), entity_reminder(participants, companies))
