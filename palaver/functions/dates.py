"""Calendar helpers. Times are TIMESTAMP_NTZ; "now" is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------------------------------------------
MONTH_CODES = ("JAN", "FÉV", "MAR", "AVR", "MAI", "JUIN", "JUIL", "AOÛT", "SEP", "OCT", "NOV", "DÉC")
MONTHS = (
    "janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre",
    "décembre",
)
WEEKDAYS = ("lundi", "mardi", "mercredi", "jeudi", "vendredi", "samedi", "dimanche")
# ----------------------------------------------------------------------------------------------------------------


def _pick(names: tuple[str, ...], index: Column) -> Column:
    return F.get(F.array(*[F.lit(n) for n in names]), index)


def epoch_ms(ts: Column) -> Column:
    """Milliseconds since 1970 of a zone-less timestamp."""
    days = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    seconds = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    millis = F.date_format(ts, "SSS").cast("int")
    return days * 86400000 + seconds.cast("long") * 1000 + millis


def parse_graph_date(text: Column) -> Column:
    """ISO text without offset, fraction dropped; NULL when it does not parse."""
    bare = F.regexp_replace(text, r"\.\d+$", "")
    return F.try_to_timestamp(bare, F.lit("yyyy-MM-dd'T'HH:mm:ss")).cast("timestamp_ntz")


def date_chip_day(d: Column) -> Column:
    return F.dayofmonth(d)


def date_chip_month(d: Column) -> Column:
    return _pick(MONTH_CODES, F.month(d) - 1)


def day_section(d: Column, today: Column) -> Column:
    diff = F.datediff(today.cast("date"), d.cast("date"))
    full = F.concat_ws(
        " ", _pick(WEEKDAYS, F.weekday(d)), F.dayofmonth(d).cast("string"), _pick(MONTHS, F.month(d) - 1)
    )
    return (
        F.when(diff == 0, F.lit("Aujourd'hui"))
        .when(diff == 1, F.lit("Hier"))
        .when(diff == -1, F.lit("Demain"))
        .otherwise(full)
    )


def day_key(ms: Column) -> Column:
    """``YYYY-MM-DD`` of epoch milliseconds (UTC), empty for NULL or 0."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ms / 86400000).cast("int"))
    return F.when(ms.isNull() | (ms == 0), F.lit("")).otherwise(day.cast("string"))
