"""Scalar functions over columns: the two clocks, numbers, units, text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STAMP = "yyyy-MM-dd HH:mm:ss xx"
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
NOT_NUMBERS = r"(?i)^[+-]?(nan|inf|infinity)$"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def instant(stamp: Column | str) -> Column:
    """The absolute time of `YYYY-MM-DD HH:MM:SS +HHMM`; null if it isn't one."""
    return F.try_to_timestamp(col(stamp), F.lit(STAMP))


def local_time(stamp: Column | str) -> Column:
    """The wall clock of the stamp's own offset, without a zone."""
    return F.when(instant(stamp).isNotNull(), F.substring(col(stamp), 1, 19).try_cast("timestamp_ntz"))


def local_day(local: Column | str) -> Column:
    return F.to_date(col(local))


def night(local: Column | str) -> Column:
    """The day a sleep segment counts for: from 18:00 on, the next."""
    return F.to_date(col(local) + F.expr("INTERVAL 6 HOURS"))


def number(text: Column | str) -> Column:
    """A decimal number or NaN/infinity, as strictly spelled as the export spells them; null otherwise."""
    t = col(text)
    return F.when(t.rlike(NUMBER) | t.rlike(NOT_NUMBERS), t.try_cast("double"))


def finite(x: Column | str) -> Column:
    return ~(F.isnan(col(x)) | (F.abs(col(x)) == float("inf")))


def folded_unit(unit: Column | str) -> Column:
    """A unit's spelling without brackets, blanks and case, its products as quotients. `Cal` is the food calorie; `cal` is left as it is, and unknown."""
    u = F.btrim(col(unit), F.lit(" \t\n\r"))
    return F.when(u == "Cal", "kcal").otherwise(F.lower(F.translate(u, "·*() \t", "//")))


def json_number(point: Column, field: str) -> Column:
    """A numeric field of a variant; strings that look like numbers are not numbers."""
    got = F.try_variant_get(point, f"$.{field}", "double")
    kind = F.schema_of_variant(F.try_variant_get(point, f"$.{field}", "variant"))
    return F.when(~kind.isin("STRING", "BOOLEAN", "VOID") & ~kind.startswith("OBJECT") & ~kind.startswith("ARRAY"), got)


def json_text(point: Column, field: str) -> Column:
    kind = F.schema_of_variant(F.try_variant_get(point, f"$.{field}", "variant"))
    return F.when(kind == "STRING", F.try_variant_get(point, f"$.{field}", "string"))


def appended_note(narrative: Column | str, day: Column | str, note: Column | str) -> Column:
    """The narrative with a dated note on a line of its own."""
    line = F.concat(F.lit("["), F.date_format(col(day), "yyyy-MM-dd"), F.lit("] "), col(note))
    return F.when(col(note).isNull(), col(narrative)).otherwise(F.concat_ws("\n", F.nullif(col(narrative), F.lit("")), line))


def subject(raw: Column | str) -> Column:
    """Trimmed; blank and `self` in any case are null (the person themselves)."""
    t = F.trim(col(raw))
    return F.when(~F.lower(t).isin("", "self"), t)


def looks_like_fraction(kind: Column | str, value: Column | str, kinds: tuple[str, ...]) -> Column:
    """A percent that arrives at or below 1 was probably sent as a fraction."""
    return col(kind).isin(*kinds) & (col(value) > 0) & (col(value) <= 1)


def days_since(day: Column | str, today: Column | str) -> Column:
    return F.date_diff(col(today), F.to_date(col(day)))


def overdue(review_by: Column | str, today: Column | str) -> Column:
    return F.coalesce(col(review_by) < col(today), F.lit(False))


def cadence_note(days: Column | str, most: int = 10) -> Column:
    return F.when(col(days) > most, F.format_string("It has been %d days since the last completed check-in.", col(days)))
