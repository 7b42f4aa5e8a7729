"""Column expressions for report labels, ages and slot ordering."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels and formats of the reports.
NO_SLOT = "No Time Slot"
UNKNOWN_OCCUPATION = "Unknown"
NOT_SPECIFIED = "Not Specified"
YES, NO = "Yes", "No"
SLOT_FORMAT_MINUTES = "yyyy-MM-dd HH:mm"
SLOT_FORMAT_SECONDS = "yyyy-MM-dd HH:mm:ss"
WORKSHOP_NUMBER_PATTERN = r"^Workshop ([0-9]+)"
SLOT_TEXT_DATE_PATTERN = r"^([0-9]+ [A-Za-z]{3})"
# Age bands in their fixed display order: (label, lowest age, highest age).
AGE_BANDS = [
    ("Under 18", None, 17),
    ("18-25", 18, 25),
    ("26-30", 26, 30),
    ("31-35", 31, 35),
    ("36-40", 36, 40),
    ("41-50", 41, 50),
    ("Above 50", 51, None),
    ("Not Specified", None, None),
]


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c) -> Column:
    """NULLIF(c, '')."""
    c = col_(c)
    return F.when(c == "", F.lit(None)).otherwise(c)


def slot_label(range_col="time_slot_range", ts_col="time_slot", fmt: str = SLOT_FORMAT_MINUTES,
               empty: str = NO_SLOT) -> Column:
    """Original slot text if non-empty, else the formatted start, else ``empty``."""
    return F.coalesce(blank_to_null(range_col), F.date_format(col_(ts_col), fmt), F.lit(empty))


def occupation_label(c="occupation", empty: str = UNKNOWN_OCCUPATION) -> Column:
    return F.coalesce(blank_to_null(c), F.lit(empty))


def workshop_number(c="form_name") -> Column:
    """Number after a leading ``Workshop ``; null when the name has none."""
    num = F.regexp_extract(col_(c), WORKSHOP_NUMBER_PATTERN, 1)
    return F.when(num != "", num.try_cast("int"))


def slot_sort_group(range_col="time_slot_range", ts_col="time_slot") -> Column:
    """Sort group of a slot: 0 = date from the slot text only (no year, sorts
    first, like a year-1 date), 1 = real timestamp, null = undated (last)."""
    rng = col_(range_col)
    return (F.when(col_(ts_col).isNotNull(), F.lit(1))
            .when(rng.rlike(r"^([0-9]+) [A-Za-z]{3}"), F.lit(0)))


def slot_sort_date(range_col="time_slot_range", ts_col="time_slot") -> Column:
    """Date used to number slots: the timestamp's day, or day+month of the text
    placed in the leap year 2000 (so 29 Feb parses); null when unparseable."""
    rng = col_(range_col)
    text_date = F.regexp_extract(rng, SLOT_TEXT_DATE_PATTERN, 1)
    parsed = F.try_to_timestamp(F.concat(text_date, F.lit(" 2000")), F.lit("d MMM yyyy"))
    return (F.when(col_(ts_col).isNotNull(), F.to_date(col_(ts_col)))
            .when(rng.rlike(r"^([0-9]+) [A-Za-z]{3}"), F.to_date(parsed)))


def exact_age(dob="date_of_birth", as_of: str | _dt.date = "2025-06-30") -> Column:
    """Whole years between ``dob`` and ``as_of`` (calendar exact, leap-day safe)."""
    d = col_(dob)
    ref = F.lit(str(as_of)).cast("date")
    return (F.year(ref) - F.year(d)
            - F.when(F.date_format(ref, "MMdd") < F.date_format(d, "MMdd"), 1).otherwise(0))


def age_band(dob="date_of_birth", as_of: str | _dt.date = "2025-06-30") -> Column:
    age = exact_age(dob, as_of)
    expr = F.when(col_(dob).isNull(), F.lit("Not Specified"))
    for label, lo, hi in AGE_BANDS:
        if label == "Not Specified":
            continue
        if lo is None:
            expr = expr.when(age <= hi, label)
        elif hi is None:
            expr = expr.otherwise(label)
        else:
            expr = expr.when(age.between(lo, hi), label)
    return expr


def age_band_order(band: Column) -> Column:
    expr = None
    for i, (label, _, _) in enumerate(AGE_BANDS, start=1):
        expr = F.when(band == label, i) if expr is None else expr.when(band == label, i)
    return expr.otherwise(len(AGE_BANDS) + 1)


def yes_no(c) -> Column:
    return F.when(col_(c), YES).otherwise(NO)
