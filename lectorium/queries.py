"""All queries by name, with their SQL."""

from __future__ import annotations

from .plans import answers, catalogue, markup, state, texts  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
