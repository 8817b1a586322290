"""Pipelines and the query registry (queries register themselves on import)."""

from . import registry  # noqa: F401
