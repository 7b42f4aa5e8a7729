"""All oracle SQL strings, keyed like ``catalog.QUERIES``."""

from __future__ import annotations

from rollcall.plans.oracle_access import ORACLE as _ACCESS
from rollcall.plans.oracle_constraints import ORACLE as _CONSTRAINTS
from rollcall.plans.oracle_io import ORACLE as _IO
from rollcall.plans.oracle_links import ORACLE as _LINKS
from rollcall.plans.oracle_merge import ORACLE as _MERGE
from rollcall.plans.oracle_reports import ORACLE as _REPORTS
from rollcall.plans.oracle_workbook import ORACLE as _WORKBOOK

ORACLE: dict[str, str] = {}
for part in (_REPORTS, _ACCESS, _MERGE, _LINKS, _CONSTRAINTS, _IO, _WORKBOOK):
    ORACLE.update(part)
