"""All registered queries and their SQL."""

from __future__ import annotations

from . import coverage_queries, feature_queries, job_queries, metric_queries, space_queries

_FAMILIES = [space_queries, feature_queries, metric_queries, coverage_queries, job_queries]

QUERIES = {name: fn for family in _FAMILIES for name, fn in family.Q.items()}
SQL = {name: text for family in _FAMILIES for name, text in family.SQL.items()}
