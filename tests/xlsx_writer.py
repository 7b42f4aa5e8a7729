"""Tests write workbooks with the library's writer."""

from rollcall.sinks.workbook import write_xlsx  # noqa: F401
