"""All registered queries of the sequence operators."""

from __future__ import annotations

from . import analyses, composition, features, generators, models, numbers, relational, reports, sequences, statistics, streams, tables

MODULES = (features, numbers, statistics, sequences, analyses, relational, generators, models, tables, reports, composition, streams)
FLAGSHIP = "feature_matrix"
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
