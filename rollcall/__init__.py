"""rollcall: programme analytics on Spark.

Imports, keyed merges with change logs, link validation and reports for
learning programmes, as DataFrame operators:

* ``functions`` - column expressions (cleaning, labels, link reading)
* ``operators`` - DataFrame operators (reports, merge, imports, validation, ...)
* ``sources`` / ``sinks`` - file scans into a common row shape; exports and
  versioned tables
* ``streaming`` - Structured Streaming entry points
* ``plans`` - the driver-table views, the registered queries and their
  DuckDB oracles
"""
