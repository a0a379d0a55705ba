"""Loads every operator's module and gives the filled registry."""

from importlib import import_module

MODULES = ["quality", "exact", "mixing", "licenses", "bpe", "simhash", "language", "substrings", "lines", "htmltext", "interaction", "merkle", "piecewise"]


def load_all():
    for name in MODULES:
        import_module(f"blocklens.llm.{name}")
    common = import_module("blocklens.llm.common")
    return common.QUERIES, common.ORACLES
