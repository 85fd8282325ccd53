"""Single place that gathers the registered queries and their oracles."""

from __future__ import annotations


def all_queries() -> dict:
    from fleetlens.plans import queries

    for mod in ("fleetlens.plans.queries_inventory", "fleetlens.plans.queries_observations",
                "fleetlens.plans.queries_streaming", "fleetlens.plans.queries_documents"):
        try:
            __import__(mod)
        except ModuleNotFoundError as ex:
            if ex.name != mod:
                raise
    return dict(queries.QUERIES)


def all_oracles() -> dict:
    from fleetlens.plans import oracle_sql

    for mod in ("fleetlens.plans.oracle_inventory", "fleetlens.plans.oracle_observations",
                "fleetlens.plans.oracle_documents"):
        try:
            __import__(mod)
        except ModuleNotFoundError as ex:
            if ex.name != mod:
                raise
    qs = all_queries()
    return {k: v for k, v in oracle_sql.ORACLES.items() if k in qs}
