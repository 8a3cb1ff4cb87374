"""Reusable plan shapes: bucketed scans, bounded frames, exact quantiles, ordered passes."""
