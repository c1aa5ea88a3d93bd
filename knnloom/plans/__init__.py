"""Physical strategies of the join: one logical operator, four plans."""

from .registry import FAMILIES, STRATEGIES, Strategy, candidate_rows, compared, ranked_counts, register, strategy, strategy_mask, with_counts

__all__ = ["FAMILIES", "STRATEGIES", "Strategy", "candidate_rows", "compared", "ranked_counts", "register", "strategy", "strategy_mask", "with_counts"]
