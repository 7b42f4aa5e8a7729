"""Column expressions for cleaning imported cells.

Everything is a built-in expression (``regexp_*``, ``try_to_timestamp``,
``coalesce``), so cleaning runs inside whole-stage codegen with no Python on
the rows.  All parsing uses the ``try_`` forms: ANSI mode would otherwise fail
the whole job on one dirty cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.functions.labels import col_

# Validation patterns, boolean words and datetime formats.
EMAIL_PATTERN = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
TRUE_WORDS = ["true", "1", "yes", "y", "on"]
MIN_PHONE_DIGITS = 10
# Plain formats tried in order after the ISO and time-slot forms
# (day/month before month/day; no date-only form with a month name).
DATETIME_FORMATS = [
    "yyyy-M-d H:m:s",
    "yyyy-M-d H:m",
    "yyyy-M-d",
    "d/M/yyyy H:m:s",
    "d/M/yyyy",
    "M/d/yyyy H:m:s",
    "M/d/yyyy",
    "d MMM yyyy H:m:s",
    "d MMM yyyy H:m",
    "d MMMM yyyy H:m:s",
    "d MMMM yyyy H:m",
]
# Start-time formats of a slot: 12-hour with and without a space, then 24-hour.
SLOT_TIME_FORMATS = ["h:m a", "h:ma", "H:m"]

_WS = r"(?U)^\s+|\s+$"


def strip(c) -> Column:
    """Unicode-aware strip (Spark's ``trim`` removes spaces only)."""
    return F.regexp_replace(col_(c).cast("string"), _WS, "")


def normalize_string(c) -> Column:
    """Stripped text, empty -> null."""
    s = strip(c)
    return F.when(s != "", s)


def normalize_email(c) -> Column:
    """Lower-cased, stripped key."""
    return F.lower(strip(c))


def is_valid_email(c) -> Column:
    """Pattern check on the stripped value; null/empty -> false."""
    s = strip(c)
    return F.coalesce(s.rlike(EMAIL_PATTERN), F.lit(False))


def normalize_phone(c) -> Column:
    """C4: digits only; kept when at least 10 digits remain."""
    d = F.regexp_replace(col_(c).cast("string"), r"\D", "")
    return F.when(F.length(d) >= MIN_PHONE_DIGITS, d)


def _ntz(s: Column, fmt: str) -> Column:
    return F.try_to_timestamp(s, F.lit(fmt)).cast("timestamp_ntz")


def _can_hold(s: Column, fmt: str) -> Column:
    """Whether the text has a digit and the separators of the format; without them its parse fails, and a failing parse
    throws and is slow."""
    out = s.rlike("[0-9]")
    for mark in "-/: ":
        if mark in fmt:
            out = out & s.contains(mark)
    return out


def parse_iso_naive(c) -> Column:
    """ISO-8601 text as a zone-less timestamp.  ``Z`` and a trailing offset
    are dropped *without shifting*; the fraction is cut or padded to 6 digits.
    Only applies to text containing ``T``.  ``c`` should be stripped text."""
    s = col_(c)
    clean = F.regexp_replace(F.regexp_replace(s, "[Zz]", ""), r"[+-]\d{2}:?\d{2}$", "")
    text = F.regexp_replace(clean, r"^([^T]*)T([^.]*)(?:\.(.*))?$", "$1 $2|$3")
    base = F.substring_index(text, "|", 1)
    frac = F.regexp_replace(F.substring_index(text, "|", -1), r"\D", "")
    frac6 = F.rpad(F.substring(frac, 1, 6), 6, "0")
    return F.when(s.contains("T"), _ntz(F.concat(base, F.lit("."), frac6), "yyyy-M-d H:m:s.SSSSSS"))


def _stage(df: DataFrame, cols: list[tuple[str, Column]]) -> DataFrame:
    """Add columns one projection at a time.  An intermediate used several
    times stays a single column (Catalyst does not inline a non-trivial
    expression into several consumers), so the parsers below stay small
    enough for whole-stage codegen."""
    for name, expr in cols:
        df = df.withColumn(name, expr)
    return df


def with_time_slot(df: DataFrame, src: str, dst: str, year: int, _p: str = "__slot_") -> DataFrame:
    """Start of a slot such as ``25 Nov, 4:00 - 7:00 PM`` in ``year``.

    An AM/PM written anywhere in the time part applies to a start that has
    none (so ``11:00 - 1:00 PM`` starts at 23:00, as in the source system).
    Month short or long; 12-hour then 24-hour; a last-resort ``h:mm`` scan.
    Only applies to text with a comma and a dash."""
    c = lambda n: F.col(_p + n)
    y = F.lit(str(year))
    like = c("s").contains(",") & c("s").contains("-")
    stages = [
        (_p + "s", strip(src)),
        (_p + "tp", strip(F.regexp_extract(c("s"), r"^[^,]*,(.*)$", 1))),
        (_p + "dp", F.concat(strip(F.substring_index(c("s"), ",", 1)), F.lit(" "), y)),
        (_p + "st0", F.when(c("tp").contains(" - "), strip(F.substring_index(c("tp"), " - ", 1)))
         .when(c("tp").contains("-") & ~c("tp").startswith("-"), strip(F.substring_index(c("tp"), "-", 1)))
         .otherwise(c("tp"))),
        (_p + "pm", F.upper(c("tp")).contains("PM")),
        (_p + "am", F.upper(c("tp")).contains("AM")),
        (_p + "st", F.when(F.upper(c("st0")).contains("PM") | F.upper(c("st0")).contains("AM"), c("st0"))
         .when(c("pm"), F.concat(c("st0"), F.lit(" PM")))
         .when(c("am"), F.concat(c("st0"), F.lit(" AM")))
         .otherwise(c("st0"))),
        # a failing parse throws and is slow: only texts that can be a slot are tried
        (_p + "day", F.when(like, F.coalesce(F.try_to_timestamp(c("dp"), F.lit("d MMM yyyy")),
                                             F.try_to_timestamp(c("dp"), F.lit("d MMMM yyyy"))))),
        (_p + "t", F.when(like, F.coalesce(*[F.try_to_timestamp(c("st"), F.lit(f)) for f in SLOT_TIME_FORMATS]))),
        (_p + "hm", F.regexp_extract(c("st"), r"(\d{1,2}:\d{2})", 1)),
        (_p + "h0", F.when(c("hm") != "", F.substring_index(c("hm"), ":", 1).cast("int"))),
        (_p + "m", F.when(c("hm") != "", F.substring_index(c("hm"), ":", -1).cast("int"))),
        (_p + "h", F.when(c("pm") & (c("h0") < 12), c("h0") + 12)
         .when(~c("pm") & c("am") & (c("h0") == 12), 0).otherwise(c("h0"))),
        (_p + "ok", (c("h") <= 23) & (c("m") <= 59)),
        (_p + "hour", F.coalesce(F.hour(c("t")), F.when(c("ok"), c("h")))),
        (_p + "minute", F.coalesce(F.minute(c("t")), F.when(c("ok"), c("m")))),
    ]
    df = _stage(df, stages)
    applies = like & c("day").isNotNull() & c("hour").isNotNull()
    ts = F.make_timestamp_ntz(F.year(c("day")), F.month(c("day")), F.dayofmonth(c("day")),
                              c("hour"), c("minute"), F.lit(0))
    df = df.withColumn(dst, F.when(applies, ts))
    return df.drop(*[n for n, _ in stages])


def with_datetime(df: DataFrame, src: str, dst: str, year: int, _p: str = "__dt_") -> DataFrame:
    """First successful form among ISO, time slot, then the plain formats;
    unparseable or empty text -> null."""
    s = _p + "s"
    df = df.withColumn(s, strip(src))
    df = df.withColumn(_p + "iso", parse_iso_naive(F.col(s)))
    df = with_time_slot(df, s, _p + "slot", year)
    plain = [F.when(_can_hold(F.col(s), f), _ntz(F.col(s), f)) for f in DATETIME_FORMATS]
    df = df.withColumn(dst, F.when(F.col(s) != "", F.coalesce(F.col(_p + "iso"), F.col(_p + "slot"), *plain)))
    return df.drop(s, _p + "iso", _p + "slot")


def coerce_boolean(c, kind: Column | None = None) -> Column:
    """True for true/1/yes/y/on in any case (no trimming), and for numbers
    other than 0; else false.  What counts is the column's type, or ``kind``
    where a text column holds the cells of a workbook: a cell that holds the
    text 2 is no number."""
    word = F.lower(col_(c).cast("string")).isin(TRUE_WORDS)
    if kind is not None:
        number = col_(c).cast("string").try_cast("double") != 0
        return F.coalesce(F.when(kind == "number", number).otherwise(word), F.lit(False))
    number = F.typeof(col_(c)).rlike("^(tinyint|smallint|int|bigint|float|double|decimal.*)$")
    return F.coalesce(F.when(number, col_(c).cast("string").cast("double") != 0).otherwise(word), F.lit(False))


def coerce_boolean_upper_true(c) -> Column:
    """C9, lab variant: only the word TRUE in any case."""
    return F.coalesce(F.upper(col_(c).cast("string")) == "TRUE", F.lit(False))


def year_from_text(c) -> Column:
    """C10 (sheet path): first 4-digit run as a year."""
    y = F.regexp_extract(col_(c).cast("string"), r"\d{4}", 0)
    return F.when(y != "", y.try_cast("int"))


def strict_int(c) -> Column:
    """C10 (generic path): the whole cell as an integer (surrounding
    whitespace allowed), else null."""
    t = strip(c)
    return F.when(t.rlike(r"^[+-]?\d{1,9}$"), t.cast("int"))


def with_types_by_name(df: DataFrame, fields: dict[str, str], year: int) -> DataFrame:
    """C11: type each generic-import field from its *name*, checked in order:
    date/time -> timestamp, valid/participated -> boolean, year -> integer,
    else normalized text.  ``fields`` maps target field -> source column."""
    out = []
    for field, src in fields.items():
        f = field.lower()
        if "date" in f or "time" in f:
            df = with_datetime(df, src, f"__typed_{field}", year)
            out.append(F.col(f"__typed_{field}").alias(field))
        elif "valid" in f or "participated" in f:
            out.append(coerce_boolean(src).alias(field))
        elif "year" in f:
            out.append(strict_int(src).alias(field))
        else:
            out.append(normalize_string(src).alias(field))
    keep = [c for c in df.columns if c not in fields and not c.startswith("__typed_")]
    return df.select(*keep, *out)
