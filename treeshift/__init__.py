"""Code-change analytics as Spark DataFrame jobs.

Input tables describe source trees, commits, requests and shell commands; the
functions in this package turn them into tables of facts about code change.
Every function takes and returns DataFrames (or Columns) and is keyed by
``range_id``, so one comparison and every commit of many repositories run as
the same plan.
"""

__version__ = "0.1.0"
