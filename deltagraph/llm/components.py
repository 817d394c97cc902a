"""Connected components of a link table by min-neighbour contraction.

Every round each node hooks on its smallest neighbour and the links are rewritten to those; links that fall together are merged.  Pointers
only go down, so the last node of a component is its smallest, and a component of n nodes takes O(log n) rounds in practice.  All
state is tables in the shared folder; a node of any degree is aggregated map-side before its key is shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltagraph.llm.common import Workspace


def components(links: DataFrame, ws: Workspace) -> DataFrame:
    """node, root for every node that has a link: links have columns a, b (long); root is the smallest node reachable."""
    edges = ws.save(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    roots = None
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
        hook = ws.save(both.groupBy("node").agg(F.least(F.min("other"), F.min("node")).alias("to")), "hooks")
        twice = hook.alias("h").join(hook.alias("g"), F.col("h.to") == F.col("g.node")).select("h.node", F.col("g.to").alias("to"))
        step = ws.save(twice, "jumps")
        if roots is None:
            new = step.select("node", F.col("to").alias("root"))
        else:
            new = roots.join(step.select(F.col("node").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        new = ws.save(new, "roots")
        to_a, to_b = (step.select(F.col("node").alias(c), F.col("to").alias(f"to_{c}")) for c in "ab")
        moved = edges.join(to_a, "a").join(to_b, "b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b"))
        rest = ws.save(moved.where("a <> b").distinct(), "links")
        ws.drop(edges, hook, step, *([roots] if roots is not None else []))
        edges, roots = rest, new
    if roots is None:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("root"))
    return roots


def local_forest(n: int, a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """A spanning forest of links between 0..n-1."""
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x, y in zip(a, b):
        p, q = find(x), find(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((x, y))
    return out
