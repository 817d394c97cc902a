"""Declarative kernels for delta-based accumulative iteration.

A vertex has a value v and a pending change delta.  A round folds delta into v, sends what delta causes along the out-edges, resets delta to
the identity and accumulates what arrives.  Every part of a kernel is a function of Columns, so Catalyst sees whole expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Accumulator:
    """A commutative, associative operation with an identity: ``fold`` of two Columns and the aggregate ``over`` a group."""

    name: str
    fold: Callable[[Column, Column], Column]
    over: Callable[[Column], Column]
    identity: Callable[[], Column]
    idempotent: bool = False


# An unset value of min and max is null: least and greatest skip nulls, as do the aggregates.
SUM = Accumulator("sum", lambda a, b: a + b, F.sum, lambda: F.lit(0.0))
MIN = Accumulator("min", F.least, F.min, lambda: F.lit(None), True)
MAX = Accumulator("max", F.greatest, F.max, lambda: F.lit(None), True)


@dataclass(frozen=True)
class Message:
    """What ``emit`` may use: the processed delta, the value after the fold, the edge weight and destination, the out-degree, the vertex."""

    delta: Column
    v: Column
    weight: Column
    degree: Column
    row: Callable[[str], Column]


@dataclass(frozen=True)
class Kernel:
    name: str
    accumulate: Accumulator
    #: of the vertex row (id and its data columns)
    init_v: Callable[[Callable[[str], Column]], Column]
    init_delta: Callable[[Callable[[str], Column]], Column]
    emit: Callable[[Message], Column]
    process: Callable[[Column, Callable[[str], Column]], Column] | None = None
    kind: str = "double"

    def identity(self) -> Column:
        return self.accumulate.identity().cast(self.kind)

    def is_pending(self, delta: Column) -> Column:
        """Whether a delta differs from the identity."""
        return delta.isNotNull() if self.accumulate.idempotent else delta != 0

    def changes(self, v: Column, delta: Column) -> Column:
        """Whether folding changes the value; idempotent kernels emit only then."""
        if not self.accumulate.idempotent:
            return self.is_pending(delta)
        return delta.isNotNull() & (v.isNull() | (self.accumulate.fold(v, delta) != v))

    def priority(self, v: Column, delta: Column) -> Column:
        """Magnitude of the change that a row would make."""
        if not self.accumulate.idempotent:
            return F.abs(delta)
        folded = self.accumulate.fold(v, delta)
        return F.when(delta.isNull(), F.lit(0.0)).when(v.isNull(), F.lit(float("inf"))).otherwise(F.abs(folded - v).cast("double"))
