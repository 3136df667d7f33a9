"""Registered queries over the driver's tables."""

from . import curation, evaluation, graph, integration, projection, retrieval, scalars, stores  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
