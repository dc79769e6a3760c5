"""Registered queries with their SQL oracles."""
from importlib import import_module

from .registry import ORACLES, QUERIES

_PARTS = ("scalar", "feature_sets", "scores_prices", "tables", "lineups", "learning", "landing", "files")


def load():
    for part in _PARTS:
        import_module(f"{__name__}.{part}")
    return QUERIES, ORACLES
