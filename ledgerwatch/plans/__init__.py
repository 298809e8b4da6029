"""Every registered query, grouped by operator family."""

import importlib

FAMILIES = (
    "views", "rules", "tables", "filters", "joins", "aggregates", "windows", "features", "geo", "graph", "learning",
    "anomaly", "text", "streams", "scalars",
)


def _load():
    from ledgerwatch.plans import registry

    for name in FAMILIES:
        importlib.import_module(f"ledgerwatch.plans.{name}")
    return registry


def queries():
    return dict(_load().QUERIES)


def oracle_sql():
    return dict(_load().ORACLES)
