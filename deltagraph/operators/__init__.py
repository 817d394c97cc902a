"""Algorithms and single-step operators."""
