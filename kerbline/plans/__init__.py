"""Registered queries: the operators applied to the shared tables, each with its SQL twin."""

import importlib

MODULES = ("risk", "timelines", "tallies", "quality", "space", "models", "feeds", "live")


def load() -> None:
    for m in MODULES:
        importlib.import_module(f"kerbline.plans.{m}")
