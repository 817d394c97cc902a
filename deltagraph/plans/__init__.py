"""Logical plans: kernels, the round, scheduling and termination."""
