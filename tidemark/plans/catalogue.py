"""The registered queries by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import cascades, evaluation, items, negatives, recognition, relations, reports, service, storage

FLAGSHIP = "identify"
_GROUPS = (recognition, evaluation, relations, service, negatives, cascades, items, reports, storage)
#: Relations of the rules themselves, which read no table: tested against their SQL, but not registered.
FIXED = ("key_relation_grid__A28", "condition_matrix__Q1", "synthetic_plan__Z8", "fixture_specs__X20")
_ALL = {k: f for g in _GROUPS for k, f in g.QUERIES.items()}
_SQL = {k: s for g in _GROUPS for k, s in g.ORACLE_SQL.items()}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for k, f in _ALL.items() if k not in FIXED}
ORACLE_SQL: dict[str, str] = {k: s for k, s in _SQL.items() if k not in FIXED}
FIXED_RELATIONS = {k: (_ALL[k], _SQL[k]) for k in FIXED}
