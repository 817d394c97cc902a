"""When to stop.  A checker sees the sum of values and the sum of pending changes of each checked round.

A checker with a method ``estimate()`` gives an aggregate Column over the state (id, v, delta) that it sees in place of the sum of values.  ``sums_only``
marks checkers that mean nothing for min and max, whose pending changes can leave the sums as they are."""

from __future__ import annotations

from typing import Protocol


class TermChecker(Protocol):
    def reset(self) -> None: ...

    def terminate(self, current: float, residual: float) -> bool: ...


class Diff:
    """Stop when the sum of values moved by at most ``tol`` since the last check; never at the first."""

    sums_only = True

    def __init__(self, tol: float = 1e-4):
        self.tol, self.last = tol, None

    def reset(self) -> None:
        self.last = None

    def terminate(self, current: float, residual: float) -> bool:
        last, self.last = self.last, current
        return last is not None and abs(current - last) <= self.tol


class Reach:
    """Stop when the absolute sum of values is at least ``least``."""

    def __init__(self, least: float):
        self.least = least

    def reset(self) -> None: ...

    def terminate(self, current: float, residual: float) -> bool:
        return abs(current) >= self.least


class Settled:
    """Stop when the sum of pending changes is at most ``tol``."""

    sums_only = True

    def __init__(self, tol: float = 0.0):
        self.tol = tol

    def reset(self) -> None: ...

    def terminate(self, current: float, residual: float) -> bool:
        return residual <= self.tol
