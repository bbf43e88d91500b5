"""Spark operators that keep replicated file collections consistent.

Inventories of the files seen at each location and manifests of recorded digests are DataFrames; diffs,
fixity checks, replication plans, retention gates and collection numbering are joins, windows and
aggregations over them.
"""
