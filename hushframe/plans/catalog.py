"""All registered queries."""

from . import chatting, ingesting, limiting, recognition, rewriting, scoring, streams  # noqa: F401
from .registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
