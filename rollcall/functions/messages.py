"""Texts of import errors, header checks and run summaries.

These must read exactly as the source system's messages, so they live
together here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Import, header and summary messages.
ROW_PREFIX = "Row "
MISSING_REQUIRED_FIELDS = "Missing required fields: "
INVALID_EMAIL = "Invalid email: "
INVALID_EMAIL_FORMAT = "Invalid email format: "
MISSING_NAME_OR_EMAIL = "Missing name or email"
MISSING_EMAIL_OR_NAME = "Missing email or name"
MISSING_EMAIL = "Missing email"
MISSING_COLUMNS_NAME_EMAIL = "Missing required columns: Name or Email"
MISSING_COLUMNS_EMAIL_NAME = "Missing required columns: Email or Name"
TOO_FEW_COLUMNS = "Expected at least {expected} columns, got %d"
MISSING_CRITICAL_HEADER = "Missing critical header: "
TOO_FEW_SHEETS = "Expected %d sheets, found %d"
RUN_COMPLETE = "Complete"
RUN_SUMMARY = "Validated: %d, Failed: %d, Updated likes/comments: %d"
NULL_VALUE = 'null value in column "{column}" violates not-null constraint'
VALUE_TOO_LONG = "value too long for type character varying({width})"
NO_PARENT = 'insert or update on table "{table}" violates foreign key constraint'
DUPLICATE_KEY = 'duplicate key value violates unique constraint "{table}_pkey"'
WORKSHOP_PREFIX = "Workshop "


def row_error(row: Column | str, reason: Column) -> Column:
    """``Row <n>: <reason>``."""
    r = F.col(row) if isinstance(row, str) else row
    return F.concat(F.lit(ROW_PREFIX), r.cast("string"), F.lit(": "), reason)
