"""Queries: operators put to the tables, each with its SQL for a second engine where SQL can say it."""

from importlib import import_module

#: Each module registers its queries when it is imported.
MODULES = ("catalogue", "selection", "scoring", "records", "filters", "relational", "community", "lifecycle", "dedupe", "search", "extraction", "evaluation", "feeds", "sources", "topics", "further", "governance")


def register_all() -> None:
    for name in MODULES:
        import_module(f"{__name__}.{name}")
