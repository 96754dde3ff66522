"""The registered queries with their SQL."""


def registered():
    """Name to (callable (spark, folder) -> DataFrame, SQL or None)."""
    from importlib import import_module

    found = {}
    for part in ("statistics", "searches", "dataflows", "more"):
        found |= import_module(f"catalore.registry.{part}").registered()
    return found
