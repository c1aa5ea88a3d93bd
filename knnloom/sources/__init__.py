"""Readers and writers of points, and writers of results."""

from .points import DIGITS, THIN_DIGITS, load_points, read_points, write_points
from .results import result_name, write_metrics, write_neighbours, write_stripes
from .scratch import drop_kept, kept, kept_tables, scratch
from .tokens import read_tokens

__all__ = ["DIGITS", "THIN_DIGITS", "drop_kept", "kept", "kept_tables", "load_points", "read_points", "read_tokens", "result_name", "scratch", "write_metrics", "write_neighbours", "write_points", "write_stripes"]
