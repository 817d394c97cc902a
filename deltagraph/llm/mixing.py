"""Mixing sources to target weights by balanced sampling with the cube method.

Every source gets a target number of words.  A document of a source with ratio r = target / source size is taken
floor(r) times, and once more with inclusion probability r - floor(r).  The cube method decides these fractions:
the probabilities of three documents at a time move along the null space of the constraints (words and documents of
the source stay the same) until one of them is 0 or 1, so both totals are kept exactly during the flight.

The flight runs in blocks of about ``BLOCK`` documents of one source; what each block leaves undecided (ten documents
at most) meets in the next round, so a source of any size takes log_BLOCK(n) rounds and no task holds a source.
A few documents of all lengths are set aside for the landing, which swaps them until the words fit.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltagraph.llm.common import Workspace, documents, small
from deltagraph.plans.schedule import ranked

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0
BLOCK = 8192
SEED = 20240607
WORD = r"[^\x20\x09-\x0D]+"
#: Documents left for the landing of a source, and for the next round by each of several blocks.
LANDING, ASIDE = 64, 8
_EPS = 1e-9


def source_targets(totals: DataFrame, ws: Workspace, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, words, n, target of the sources (source, words, n).  Sources by code point, null last, weigh ``weights`` in turn and share ``share`` times all
    words; a target stops at ``most`` times its source's size and the excess is shared again by weight.

    The sources are a table of any length; only sums come to the driver."""
    stored, rank = ranked(totals, F.col("source").isNull(), F.col("source"))
    weight = F.get(F.array(*[F.lit(w) for w in weights]), (rank % len(weights)).cast("int"))
    plan = ws.save(stored.select("source", "words", "n", weight.alias("weight")), "sources")
    r = plan.agg(F.sum("words").alias("words"), F.sum("weight").alias("weight"), F.count("*").alias("n")).first()
    whole, left, of, free = share * (r["words"] or 0), share * (r["words"] or 0), r["weight"] or 1, r["n"]
    while True:
        over = F.lit(left) * F.col("weight") / F.lit(of) > F.lit(most) * F.col("words")
        r = plan.agg(F.sum(F.when(over, F.col("words"))).alias("words"), F.sum(F.when(~over, F.col("weight"))).alias("weight"), F.count(F.when(~over, 1)).alias("n")).first()
        if r["n"] == free or not r["n"]:
            # a source over the limit stays over it while the others' shares grow
            return plan.select("source", "words", "n", F.when(over, F.lit(most) * F.col("words")).otherwise(F.lit(left) * F.col("weight") / F.lit(of)).alias("target"))
        left, of, free = whole - most * (r["words"] or 0), r["weight"], r["n"]


def flight(size: np.ndarray, p: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Move the probabilities ``p``, in the order given, until two fractional ones at most are left."""
    size, out, draw = size.tolist(), p.tolist(), draw.tolist()
    held: list[int] = []
    for k in range(len(out)):
        if _EPS < out[k] < 1 - _EPS:
            held.append(k)
        else:
            out[k] = float(round(out[k]))
        while len(held) == 3:
            a, b, c = held
            u = (size[c] - size[b], size[a] - size[c], size[b] - size[a])
            if not any(u):
                u = (1.0, -1.0, 0.0)
            up = down = float("inf")
            for i, d in zip(held, u):
                if d > 0:
                    up, down = min(up, (1 - out[i]) / d), min(down, out[i] / d)
                elif d < 0:
                    up, down = min(up, out[i] / -d), min(down, (1 - out[i]) / -d)
            step = up if draw[c] * (up + down) < down else -down
            for i, d in zip(held, u):
                out[i] += step * d
            draw[c] = draw[c] * 7919.0 % 1.0  # another number for the next step
            done = [i for i in held if not _EPS < out[i] < 1 - _EPS]
            for i in done:
                out[i] = float(round(out[i]))
            held = [i for i in held if i not in done]
    return np.array(out)


def land(size: np.ndarray, p: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Decide what the flight left and what was set aside: each by its probability, then single flips and swaps (which keep the
    number of documents) while they bring the words nearer to what was asked."""
    rest = np.flatnonzero((p > 0) & (p < 1))
    if not len(rest):
        return p
    s, x = size[rest], (draw[rest] < p[rest]).astype(float)
    off = float((s * x).sum() - (s * p[rest]).sum())
    for _ in range(4 * len(rest)):
        flip = s * (1 - 2 * x)
        pair = flip[:, None] + np.where(x[:, None] != x[None, :], flip[None, :], np.inf)
        one, two = int(np.abs(off + flip).argmin()), int(np.abs(off + pair).argmin())
        i, j = divmod(two, len(rest))
        best = [i, j] if abs(off + pair[i, j]) <= abs(off + flip[one]) else [one]
        new = off + float(flip[best].sum())
        if abs(new) >= abs(off) - _EPS:
            break
        x[best], off = 1 - x[best], new
    p = p.copy()
    p[rest] = x
    return p


def _decide(t: pa.Table) -> pa.Table:
    """One block of one source.  Some documents of all lengths are set aside for the landing."""
    # rows come in any order: from here on it is by size and draw
    t = t.take(pa.array(np.lexsort(tuple(t[c].to_numpy() for c in ("p", "draw")) + (-t["size"].to_numpy(),))))
    size, p, draw = (t[c].to_numpy().astype(float) for c in ("size", "p", "draw"))
    last = t["blocks"][0].as_py() == 1
    order = np.flatnonzero((p > _EPS) & (p < 1 - _EPS))
    aside = np.unique(np.linspace(0, max(0, len(order) - 1), min(LANDING if last else ASIDE, len(order) // 2)).astype(int))
    flying = np.delete(order, aside)
    moved = np.where((p > _EPS) & (p < 1 - _EPS), p, np.round(p))
    moved[flying] = flight(size[flying], p[flying], draw[flying])
    if last:
        moved = land(size, moved, draw)
    return t.set_column(t.column_names.index("p"), "p", pa.array(moved)).select(["doc_id", "source", "size", "base", "p", "draw"])


def mix_sources(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken: one row for each row of ``docs`` (doc_id, text, source); other columns are left out.

    A null text or one without words has size 0 and takes nothing; null sources are a source of their own; repeated rows are units of their own;
    an empty table gives an empty result.  Equal inputs give equal results whatever the partitioning."""
    ws = Workspace(docs.sparkSession, "mixing")
    sizes = ws.save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "sizes")
    totals = sizes.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    plan = source_targets(totals, ws, weights, share, most).withColumn("ratio", F.when(F.col("words") > 0, F.col("target") / F.col("words")).otherwise(0.0))
    plan = ws.save(plan, "plan")
    sources = plan.count()
    plans = small(plan.select("source", F.col("words").alias("source_size"), "target", "ratio"), sources).alias("s")
    base = F.least(F.floor("ratio"), F.lit(int(most)))
    left = (
        _numbered(sizes, block).alias("d").join(plans, F.expr("d.source <=> s.source"))
        .select("doc_id", "d.source", "size", base.cast("long").alias("base"), (F.col("ratio") - base).alias("p"),
                (F.shiftrightunsigned(F.xxhash64("doc_id", "size", "copy", F.lit(seed)), 11) / F.lit(float(2**53))).alias("draw"))
    )
    done, turn, counts = [], 0, plan.select("source", "n")
    while True:
        dealing = ws.save(counts.select("source", F.greatest(F.lit(1).cast("long"), F.ceil(F.col("n") / block)).alias("blocks")), f"blocks{turn}")
        dealt = (
            left.alias("l").join(small(dealing, sources).alias("b"), F.expr("l.source <=> b.source"))
            .select("doc_id", "l.source", "size", "base", "p", "draw", "blocks",
                    F.pmod(F.xxhash64("draw", F.lit(seed + turn)), "blocks").alias("block"))
        )
        kind = "doc_id long, source string, size long, base long, p double, draw double"
        out = ws.save(dealt.groupBy("source", "block").applyInArrow(_decide, kind), f"round{turn}")
        undecided = (F.col("p") > 0) & (F.col("p") < 1)
        done.append(out.where(~undecided))
        if dealing.where("blocks > 1").isEmpty():
            break
        left = out.where(undecided)
        counts = ws.save(left.groupBy("source").agg(F.count("*").alias("n")), f"left{turn}")
        turn += 1
    every = done[0]
    for x in done[1:]:
        every = every.unionByName(x)
    copies = (F.col("base") + F.col("p")).cast("long")
    return every.alias("d").join(plans, F.expr("d.source <=> s.source")).select("doc_id", "d.source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def _numbered(sizes: DataFrame, block: int) -> DataFrame:
    """Rows doc_id, source, size with a column copy that tells equal rows apart, the same whatever the partitioning.

    A row that stands very often is dealt out in lots of ``block`` before it is unfolded."""
    equal = sizes.groupBy("doc_id", "source", "size").agg(F.count("*").alias("c"))
    lots = equal.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("c") / block) - 1)))
    lots = lots.withColumn("own", F.least(F.lit(block).cast("long"), F.col("c") - F.col("lot") * block))
    unfold = lambda df: df.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("own") - 1))).select("doc_id", "source", "size", (F.col("lot") * block + F.col("i")).alias("copy"))
    single = lots.where("c = 1").select("doc_id", "source", "size", F.lit(0).cast("long").alias("copy"))
    few, many = lots.where((F.col("c") > 1) & (F.col("c") <= block)), lots.where(F.col("c") > block)
    return single.unionByName(unfold(few)).unionByName(unfold(many.repartition(F.xxhash64("doc_id", "size", "lot"))))


def take_copies(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it was taken.  doc_id must be unique in ``docs``."""
    n = mixed.where("copies > 0").select("doc_id", "copies")
    return docs.join(n, "doc_id").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copies")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


