"""Column expressions."""

from .geometry import dist_sq, finite_points, optimal_stripes

__all__ = ["dist_sq", "finite_points", "optimal_stripes"]
