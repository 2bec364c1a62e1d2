"""All registered queries."""

from importlib import import_module

#: Modules whose import registers queries.
MODULES = ("drift", "retrieval", "rules", "judging", "ingest", "evaluation", "telemetry", "steps", "routing", "selection", "metrics", "stores", "tools")


def load():
    for name in MODULES:
        import_module(f"gleanery.plans.{name}")
    from gleanery.plans.registry import ORACLE, QUERIES

    return QUERIES, ORACLE
