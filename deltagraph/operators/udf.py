"""Escape hatch for kernels that Columns can't express: Arrow-batched functions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltagraph.plans.kernel import Kernel, Message


def pandas_emit(f: Callable[..., pd.Series]) -> Callable[[Message], Column]:
    """An ``emit`` from a function of (delta, v, weight, degree) pandas series to doubles."""
    udf = F.pandas_udf(f, "double")
    return lambda m: udf(m.delta, m.v, m.weight, m.degree)


def with_emit(kernel: Kernel, f: Callable[..., pd.Series]) -> Kernel:
    return Kernel(kernel.name + "_udf", kernel.accumulate, kernel.init_v, kernel.init_delta, pandas_emit(f), kernel.process, kernel.kind)


#: Keys that a task folds before it hands on what it has.
KEYS = 200_000


def accumulate_with(messages: DataFrame, fold: Callable[[float, float], float]) -> DataFrame:
    """(dst, d) with a user's commutative and associative ``fold`` of two floats; nulls are left out, a key with nothing else gives null.

    Each task folds what it reads to one value a key before the shuffle, up to ``KEYS`` keys at a time; then the partial values come in order of their
    keys and are folded as they stream by, so neither many keys nor a hot one need memory, and no key costs a call of its own."""

    def batch(keys: list, values: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(values, pa.float64())], ["dst", "d"])

    def partial(batches):
        found: dict = {}
        for b in batches:
            _into(found, b, fold)
            if len(found) >= KEYS:
                yield batch(list(found), list(found.values()))
                found = {}
        if found:
            yield batch(list(found), list(found.values()))

    def final(batches):
        last: dict = {}
        for b in batches:
            _into(last, b, fold)
            if not last:
                continue
            # the largest key may go on in the next batch; nulls come first
            key, value = last.popitem()
            if last:
                yield batch(list(last), list(last.values()))
            last = {key: value}
        if last:
            yield batch(list(last), list(last.values()))

    kind = "dst bigint, d double"
    some = messages.select(F.col("dst").cast("bigint").alias("dst"), F.col("d").cast("double").alias("d")).mapInArrow(partial, kind)
    parts = int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return some.repartition(parts, "dst").sortWithinPartitions("dst").mapInArrow(final, kind)


def _into(found: dict, batch: pa.RecordBatch, fold: Callable[[float, float], float]) -> None:
    """Fold the rows (dst, d) of a batch into ``found``, whose keys stay in the order in which they came."""
    for key, x in zip(*(c.to_pylist() if c.null_count else c.to_numpy().tolist() for c in batch.columns)):
        have = found.get(key)
        found[key] = x if have is None else have if x is None else float(fold(have, x))
