"""All registered queries (importing the query modules fills the registry)."""

from __future__ import annotations

from . import q_eval, q_ml, q_profile, q_text  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
