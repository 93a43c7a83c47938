"""Imports every plan module so that its queries are registered."""
from floodlens.plans import captures, detector, labels, metrics, models, stores, streams, windows  # noqa: F401
from floodlens.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
