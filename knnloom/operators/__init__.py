"""Operators over points and over results of the join."""

from .allpairs import heap_additions, nested_states
from .datasets import FACTORS, convert, generate_uniform, multiply, target_count
from .intervals import overlap_join
from .join import aknn_join, with_padding
from .results import difference_ids, first_differences, merge, nested, positions, result_lines, top_k
from .sketches import boundaries, sketches, stripe_depths
from .states import merge_states, nearest_states, ranked
from .statistics import all_counts, candidate_counts, candidate_stats, dataset_counts, run_metrics

__all__ = [
    "FACTORS", "aknn_join", "all_counts", "boundaries", "candidate_counts", "candidate_stats", "convert", "dataset_counts", "difference_ids", "first_differences", "generate_uniform", "heap_additions", "merge", "merge_states",
    "multiply", "nearest_states", "nested", "nested_states", "overlap_join", "positions", "ranked", "result_lines", "sketches", "stripe_depths", "run_metrics", "target_count", "top_k", "with_padding",
]
