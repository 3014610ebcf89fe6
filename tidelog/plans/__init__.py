"""All registered queries."""

import importlib

from tidelog.plans.base import CHECKS, QUERIES

for _family in ("search", "quality", "behaviour", "security", "metrics", "storage", "screening", "scalars", "streaming"):
    importlib.import_module(f"tidelog.plans.{_family}")

__all__ = ["CHECKS", "QUERIES"]
