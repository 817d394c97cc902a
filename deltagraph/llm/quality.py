"""Quality classifier: a sparse rule ensemble.

Statistics of a whole text are computed in one vectorised pass.  Small boosted trees are grown on a bounded labelled sample; every
path from a root to a node is a conjunctive rule over the statistics.  A lasso logistic regression over the rules (and nothing else)
keeps few of them, and those compile into one Spark column expression, so scoring is plain generated code.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deltagraph.llm.common import carrying, crc_mod, documents, small, table
from deltagraph.llm.tokens import SPACED, words

#: Labelled rows to learn from, as expected number; rows are chosen by a hash of their id.
TRAIN_ROWS = 20_000
THRESHOLD = 0.3
TREES, DEPTH, BINS, LEARN = 40, 3, 32, 0.2
PENALTY, STEPS = 0.0007, 1500

STATISTICS = ["log_words", "word_chars", "upper", "digits", "symbols", "pipes", "shouts", "doubled", "repeats", "distinct", "stops", "lines", "wide"]


def _class(chars: bytes) -> np.ndarray:
    t = np.zeros(256, np.int64)
    t[np.frombuffer(chars, np.uint8)] = 1
    return t


_UPPER, _LOWER, _DIGIT = (_class(bytes(range(*r))) for r in ((65, 91), (97, 123), (48, 58)))
_SYMBOL = _class(b"#$%&*+/<=>@\\^_`{|}~")
_PIPE, _SHOUT, _STOP, _LINE = _class(b"|"), _class(b"!"), _class(b".?"), _class(b"\n")
_WIDE = np.r_[np.zeros(128, np.int64), np.ones(128, np.int64)]


def text_statistics(arr: pa.Array) -> np.ndarray:
    """One row of STATISTICS for each text; zeros for a null text or one without words."""
    out = []
    for w in words(arr, SPACED):
        n = w.hi - w.lo
        count = np.diff(w.first).astype(float)

        def total(t: np.ndarray, x: np.ndarray = w.buf, rows: np.ndarray = w.offsets) -> np.ndarray:
            return np.diff(np.concatenate([[0], np.cumsum(t[x])])[rows])

        one = np.maximum(count, 1)
        upper, lower = total(_UPPER), total(_LOWER)
        again = np.zeros(len(w.buf), np.int64)  # a mark after the same mark
        if len(w.buf) > 1:
            mark = (_SYMBOL + _SHOUT)[w.buf] > 0
            again[1:] = mark[1:] & (w.buf[1:] == w.buf[:-1])
        doubled = np.diff(np.concatenate([[0], np.cumsum(again)])[w.offsets])
        doc = np.repeat(np.arange(n), np.diff(w.first))
        same = np.zeros(n)
        if len(w.hash) > 1:
            same += np.bincount(doc[1:], (w.hash[1:] == w.hash[:-1]) & (doc[1:] == doc[:-1]), n)
        # different words in each stretch of 50, so that a text's length doesn't matter
        stretch = doc * (1 << 32) + (np.arange(len(doc)) - w.first[doc]) // 50
        order = np.lexsort((w.hash, stretch))
        new = np.ones(len(order), bool)
        new[1:] = (w.hash[order][1:] != w.hash[order][:-1]) | (stretch[1:] != stretch[:-1])
        distinct = np.bincount(doc, new, n) if len(doc) else np.zeros(n)
        chars = np.bincount(doc, w.length, n) if len(doc) else np.zeros(n)
        out.append(np.stack([
            np.log1p(count), chars / one, upper / np.maximum(upper + lower, 1), total(_DIGIT) / one, total(_SYMBOL) / one, total(_PIPE) / one,
            total(_SHOUT) / one, doubled / one, same / one, distinct / one, total(_STOP) / one, total(_LINE) / one, total(_WIDE) / np.maximum(chars, 1)], 1) * (count > 0)[:, None])
    return np.concatenate(out) if out else np.zeros((0, len(STATISTICS)))


def statistics(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The ``keep`` columns and a double for each of STATISTICS."""
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = text_statistics(b.column(text))
            yield pa.record_batch([*[b.column(c) for c in keep], *[pa.array(c) for c in x.T]], [*keep, *[f"_{s}" for s in STATISTICS]])

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, kept + "".join(f", _{s} double" for s in STATISTICS))


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above, threshold), all must hold


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> list[Rule]:
    """Paths of boosted trees with logistic loss: one rule for every node but the roots."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    bins = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T)], 1)  # bin b: v <= cuts[b]
    rng, rules = np.random.default_rng(11), {}
    margin = np.zeros(len(y))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        used = rng.random(len(y)) < 0.7

        def grow(rows: np.ndarray, path: Rule, g=g, h=h, used=used, margin=margin) -> None:
            own = rows[used[rows]]
            best = (1e-6, None, None)
            if len(path) < depth and len(own) >= 20:
                for f, c in enumerate(cuts):
                    if len(c) == 0:
                        continue
                    gs, hs = np.bincount(bins[own, f], g[own], len(c) + 1), np.bincount(bins[own, f], h[own], len(c) + 1)
                    ns = np.cumsum(np.bincount(bins[own, f], minlength=len(c) + 1))[:-1]
                    gl, hl = np.cumsum(gs)[:-1], np.cumsum(hs)[:-1]
                    gr, hr = gs.sum() - gl, hs.sum() - hl
                    gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - gs.sum() ** 2 / (hs.sum() + 1)
                    gain[(ns < 5) | (len(own) - ns < 5)] = -1
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), f, k)
            if best[1] is None:
                margin[rows] += LEARN * g[own].sum() / (h[own].sum() + 1) if len(own) else 0.0
                return
            _, f, k = best
            low = bins[rows, f] <= k
            for above, part in ((False, rows[low]), (True, rows[~low])):
                rule = (*path, (f, above, float(cuts[f][k])))
                rules.setdefault(rule)
                grow(part, rule)

        grow(np.arange(len(y)), ())
    return list(rules)


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, above, t in rule:
        out &= (x[:, f] > t) == above
    return out


def lasso(z: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and intercept of an L1-penalised logistic regression (accelerated proximal gradient)."""
    n, m = z.shape
    rate = 4.0 / max(1e-9, float(np.linalg.norm(z, 2) ** 2) / n + 1)
    w, b = np.zeros(m), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    v, c, t = w.copy(), b, 1.0
    for _ in range(steps):
        r = 1 / (1 + np.exp(-(z @ v + c))) - y
        new = v - rate * (z.T @ r) / n
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        nb = c - rate * r.mean()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / nt * (new - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = new, nb, nt
    return w, b


@dataclass
class RuleEnsemble:
    intercept: float = 0.0
    rules: list[tuple[Rule, float]] = field(default_factory=list)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> RuleEnsemble:
        """Without rows, or with one label only, the score is a constant."""
        if len(y) == 0:
            return cls()
        if y.min() == y.max():
            return cls(float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))))
        paths, unique = tree_rules(x, y), {}
        for r in paths:
            z = holds(r, x)
            if z.any() and not z.all():
                unique.setdefault(z.tobytes(), (r, z))
        if not unique:
            return cls(float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))))
        w, b = lasso(np.stack([z for _, z in unique.values()], 1).astype(float), y)
        return cls(b, [(r, float(v)) for (r, _), v in zip(unique.values(), w) if abs(v) > 1e-6])

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.intercept + sum((v * holds(r, x) for r, v in self.rules), np.zeros(len(x))))))

    def column(self) -> Column:
        """The score as a Spark expression over the statistics."""
        margin = F.lit(self.intercept)
        for rule, v in self.rules:
            test = F.lit(True)
            for f, above, t in rule:
                c = F.col(f"_{STATISTICS[f]}")
                test = test & (c > t if above else c <= t)
            margin = margin + F.when(test, F.lit(v)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-margin))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS) -> RuleEnsemble:
    """Fit on about ``rows`` labelled documents.  Several labels of one doc_id count by their mean; null labels and ids are left out."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("double").alias("_label"))
    number = known.count()
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(5)), 11) / F.lit(float(2**53))
    sample = known.where(draw < min(1.0, rows / max(1, number)))
    held = docs.select("doc_id", "text").join(small(sample, min(number, 2 * rows)), "doc_id")
    got = statistics(held, ["doc_id", "_label"]).orderBy("doc_id").toPandas()
    return RuleEnsemble.fit(got[[f"_{s}" for s in STATISTICS]].to_numpy(float), got["_label"].to_numpy(float))


@carrying
def score(docs: DataFrame, keep: list[str], model: RuleEnsemble, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The ``keep`` columns plus score (0 to 1) and predicted (1 if score >= threshold).  Null and empty texts are scored too; every row gets one result."""
    return statistics(docs, keep, text).withColumn("score", model.column()).withColumn("predicted", (F.col("score") >= threshold).cast("int")).select(*keep, "score", "predicted")


def learnt_from(frame: DataFrame) -> DataFrame:
    """Rows that labels may be learnt from."""
    return frame.where(crc_mod(F.col("doc_id"), 5) != 0)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = train(docs, learnt_from(table(spark, sf_dir, "labels")))
    held = F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    return score(docs, ["doc_id"], model).select("doc_id", held.alias("held_out"), "score", "predicted")
