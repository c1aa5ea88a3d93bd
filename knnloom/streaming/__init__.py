"""Structured Streaming forms of the join."""

from .lookup import stream_aknn
from .nearest import current, prepare, start, updates

__all__ = ["current", "prepare", "start", "stream_aknn", "updates"]
