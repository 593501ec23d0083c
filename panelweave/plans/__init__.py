"""Registered queries: operators applied to the tables, with the DuckDB SQL that says the same."""

from panelweave.plans import assemble, crosssection, evaluate, ingest, labels, models, policy, screening, stats
from panelweave.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "assemble", "crosssection", "evaluate", "ingest", "labels", "models", "policy", "screening", "stats"]
