"""All registered queries and their oracle SQL.

Importing the catalog modules registers their queries in ``QUERIES``.
"""

from __future__ import annotations

from rollcall.plans import (  # noqa: F401  (registration side effects)
    catalog_access,
    catalog_constraints,
    catalog_io,
    catalog_links,
    catalog_merge,
    catalog_reports,
    catalog_workbook,
)
from rollcall.plans.catalog import QUERIES
from rollcall.plans.oracle import ORACLE

__all__ = ["QUERIES", "ORACLE"]
