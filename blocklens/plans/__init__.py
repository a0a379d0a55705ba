"""Named queries over the driver tables."""

from importlib import import_module

MODULES = ["bytes_queries", "range_queries", "rule_queries", "carve_queries", "fs_queries", "raid_queries", "ledger_queries", "report_queries", "ml_queries", "stream_queries", "io_queries"]


def load_all():
    """Import every query module and return the filled catalog."""
    for name in MODULES:
        import_module(f"blocklens.plans.{name}")
    return import_module("blocklens.plans.catalog")
