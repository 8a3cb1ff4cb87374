"""Markdown lines, table cells and inline spans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.functions import text
from palaver.plans.scans import by_index, scan
from palaver.session import cut_lineage

# --- fixed values -----------------------------------------------------------------------------------------------
HEADING = r"^(#{1,6})\s+(.+)$"
BULLET = r"^[-*]\s+"
ORDERED = r"^\d+\\?\.\s+"
SEPARATOR_CELL = r"^:?-{2,}:?$"
SPANS = r"(\*\*[^*\n]+\*\*|\*[^*\n]+\*|_[^_\n]+_|`[^`\n]+`|\[[^\]]+\]\([^)]+\))"
# ----------------------------------------------------------------------------------------------------------------


def _is_row(s):
    return s.startswith("|") & s.endswith("|") & (F.length(s) >= 2)


def block_kinds(lines: DataFrame) -> DataFrame:
    """Kind of each (report_id, line_no, raw) line; blank lines outside fences are dropped.

    A line is inside a fence when an odd number of fence lines came before it. A table starts with a row whose next
    line is a separator, outside fences, and goes on while lines are rows.
    """
    s = text.strip(F.col("raw"))
    cells = F.transform(F.split(F.trim(s, F.lit("|")), r"\|"), lambda c: F.trim(c))
    is_sep = _is_row(s) & F.forall(F.filter(cells, lambda c: c != ""), lambda c: c.rlike(SEPARATOR_CELL))
    base = lines.withColumns({"s": s, "_row": _is_row(s), "_sep": is_sep, "_fence": s.startswith("```").cast("int")})
    key, order = ["report_id"], ["line_no"]
    near = scan(
        base, key, order, by_index("line_no"),
        {"_open": ("sum_before", F.col("_fence")), "_next_sep": ("lead", F.col("_sep")), "_before_row": ("lag", F.col("_row"))},
    )
    inside = (F.col("_open") % 2) == 1
    out = cut_lineage(near.withColumns({"_in": inside, "_tbl": F.col("_row") & ~inside}))
    # the latest header candidate and the latest line that is no row decide whether a row belongs to a table
    head = F.col("_tbl") & F.coalesce("_next_sep", F.lit(False))
    seen = scan(
        out, key, order, by_index("line_no"),
        {"_head": ("last", F.when(head, F.col("line_no"))), "_gap": ("last", F.when(~F.col("_tbl"), F.col("line_no")))},
    )
    # the first header after a gap opens the table; rows before it in the same run are paragraphs
    runs = seen.filter("_tbl").groupBy("report_id", "_gap").agg(F.min("_head").alias("_start"))
    joined = seen.join(
        runs.withColumnRenamed("_gap", "_g"),
        (seen["report_id"] == runs["report_id"]) & seen["_gap"].eqNullSafe(F.col("_g")) & seen["_tbl"], "left",
    ).select(seen["*"], "_start")
    in_table = F.col("_tbl") & F.col("_start").isNotNull() & (F.col("line_no") >= F.col("_start"))
    kind = (
        F.when(F.col("_fence") == 1, "fence")
        .when(F.col("_in"), "code")
        .when(in_table & (F.col("line_no") == F.col("_start")), "table_header")
        .when(in_table & (F.col("line_no") == F.col("_start") + 1), "table_separator")
        .when(in_table, "table_row")
        .when(F.col("s").rlike(HEADING), F.concat(F.lit("heading"), F.length(F.regexp_extract("s", HEADING, 1))))
        .when(F.col("s").rlike(BULLET), "bullet")
        .when(F.col("s").rlike(ORDERED), "ordered")
        .when(F.col("s").startswith(">"), "quote")
        .otherwise("paragraph")
    )
    kinds = joined.withColumn("kind", kind).filter((F.col("s") != "") | (F.col("kind") == "code"))
    return kinds.select("report_id", "line_no", "raw", "kind", F.when(in_table, F.col("_start")).alias("table_at"))


def table_cells(kinds: DataFrame) -> DataFrame:
    """Cells of header and body rows; an escaped pipe stays in its cell."""
    s = text.strip(F.col("raw"))
    inner = F.regexp_replace(F.regexp_replace(s, r"^\|", ""), r"\|$", "")
    parts = F.transform(F.split(inner, r"(?<!\\)\|"), lambda c: text.unescape_md(F.replace(text.strip(c), F.lit("\\|"), F.lit("|"))))
    rows = kinds.filter(F.col("kind").isin("table_header", "table_row"))
    return rows.select("report_id", "table_at", "line_no", F.posexplode(parts).alias("col_no", "cell"))


def inline_spans(lines: DataFrame, content: str) -> DataFrame:
    """Bold, italic, code and link spans of each line, in order."""
    found = F.regexp_extract_all(text.unescape_md(F.col(content)), F.lit(SPANS), F.lit(1))
    spans = lines.select(*[c for c in lines.columns if c != content], F.posexplode(found).alias("span_no", "tok"))
    tok = F.col("tok")
    link = r"^\[([^\]]+)\]\(([^)]+)\)"
    kind = (
        F.when(tok.startswith("**"), "bold").when(tok.startswith("`"), "code").when(tok.startswith("["), "link").otherwise("italic")
    )
    body = (
        F.when(kind == "bold", F.substr(tok, F.lit(3), F.length(tok) - 4))
        .when(kind == "link", F.regexp_extract(tok, link, 1))
        .otherwise(F.substr(tok, F.lit(2), F.length(tok) - 2))
    )
    return spans.withColumns({"kind": kind, "text": body}).drop("tok")
