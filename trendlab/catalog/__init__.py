"""Registered queries over the provided tables, each with an independent SQL counterpart."""

from . import market, portfolio, signals, studies  # noqa: F401  (fill the registry)
from .registry import REGISTRY

__all__ = ["REGISTRY"]
