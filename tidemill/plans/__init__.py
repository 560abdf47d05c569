"""Multi-step plans built from operators and functions."""

from __future__ import annotations

import importlib

#: Modules of this folder that register queries when imported.
MODULES: list[str] = ["history", "features", "matching", "temporal", "reliability", "warehouse", "identity", "sheets", "requirements", "deliverables", "feedback", "scans", "labs", "examples"]


def register_all() -> None:
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
    importlib.import_module("tidemill.streaming.events")
