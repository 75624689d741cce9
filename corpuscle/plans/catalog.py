"""All queries of the engine's own operators."""

from __future__ import annotations

from corpuscle.plans import cast_queries, check_queries, live_queries, more_queries, review_queries, rule_queries, text_queries
from corpuscle.plans.registry import Query

_ALL = [text_queries.R, cast_queries.R, live_queries.R, more_queries.R, rule_queries.R, review_queries.R, check_queries.R]
QUERIES: dict[str, Query] = {k: q for r in _ALL for k, q in r.queries.items()}
SQL: dict[str, str] = {k: q for r in _ALL for k, q in r.sql.items()}
