"""Transit operators: functions from :class:`Tables` and parameters to a frame.

Measures are aggregated on the fact table alone, before any join, so that map
tasks shrink the data first and one crowded route cannot fill one task. The
small results then meet the dimension tables. No broadcast is forced: Spark
picks it from the size statistics, and falls back to a shuffle join.
"""
