"""Shipped algorithms as kernels, and a registry of them by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltagraph.plans.engine import Adjacency, Options, Result, initial_state, run
from deltagraph.plans.kernel import MAX, MIN, SUM, Kernel

REGISTRY: dict[str, Callable[..., Kernel]] = {}


def register(name: str):
    def add(f: Callable[..., Kernel]) -> Callable[..., Kernel]:
        REGISTRY[name] = f
        return f

    return add


@register("pagerank")
def pagerank(damping: float = 0.8, teleport: float = 0.2) -> Kernel:
    """Un-normalised: values sum to the number of vertices if none dangles; what a dangling vertex would send is lost."""
    return Kernel("pagerank", SUM, lambda c: F.lit(0.0), lambda c: F.lit(teleport), lambda m: m.delta * damping / m.degree)


@register("connected_components")
def connected_components() -> Kernel:
    """Largest id among the vertices that reach a vertex; undirected components if the edges go both ways."""
    return Kernel("connected_components", MAX, lambda c: F.lit(None), lambda c: c("id"), lambda m: m.v, kind="bigint")


@register("shortest_paths")
def shortest_paths(source: int = 0) -> Kernel:
    """Distance from ``source``; null if unreachable."""
    return Kernel("shortest_paths", MIN, lambda c: F.lit(None), lambda c: F.when(c("id") == source, F.lit(0.0)), lambda m: m.delta + m.weight)


@register("katz")
def katz(source: int = 0, beta: float = 0.1, start: float = 1e6) -> Kernel:
    """start * sum over t of beta^t * (walks of length t from ``source``); grows without bound if beta is too large for the graph."""
    return Kernel("katz", SUM, lambda c: F.lit(0.0), lambda c: F.when(c("id") == source, F.lit(start)).otherwise(F.lit(0.0)), lambda m: m.delta * beta)


@register("adsorption")
def adsorption(starts: int = 100, damping: float = 0.1, start: float = 10.0) -> Kernel:
    """Weighted spreading from the vertices with ids below ``starts``."""
    return Kernel("adsorption", SUM, lambda c: F.lit(0.0), lambda c: F.when(c("id") < starts, F.lit(start)).otherwise(F.lit(0.0)), lambda m: m.delta * damping * m.weight)


@register("simrank")
def simrank(decay: float = 0.8) -> Kernel:
    """Over pair vertices with a data column i_ab, the product of the in-degrees; delta is scaled before it is folded."""
    ready = lambda d, c: F.when((d == 0) | (c("i_ab") == 0), d).otherwise(d * decay / c("i_ab"))
    return Kernel(
        "simrank", SUM, lambda c: F.lit(0.0),
        lambda c: F.when(c("id")["a"] == c("id")["b"], c("i_ab") / F.lit(decay)).otherwise(F.lit(0.0)),
        lambda m: m.delta, process=ready)


def simrank_graph(vertices: DataFrame, edges: DataFrame, both_ways: bool = False) -> tuple[DataFrame, DataFrame]:
    """Pair vertices (id struct a <= b, i_ab) and pair edges.

    A source pair counts once for a target pair however often its successors combine to it; with ``both_ways`` it counts as often as they do."""
    indeg = vertices.select("id").join(edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n")), "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))
    a, b = (indeg.select(F.col("id").alias(x), F.col("n").alias(f"n{x}")) for x in "ab")
    pairs = a.join(b, F.col("a") <= F.col("b")).select("a", "b", (F.col("na") * F.col("nb")).alias("i_ab"))
    e1, e2 = (edges.select(F.col("src").alias(x), F.col("dst").alias(y)) for x, y in (("a", "p"), ("b", "q")))
    pair_edges = pairs.join(e1, "a").join(e2, "b").where("p <> q").select("a", "b", F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y"))
    pair_edges = pair_edges if both_ways else pair_edges.distinct()
    ids = pairs.select(F.struct("a", "b").alias("id"), "i_ab")
    return ids, pair_edges.select(F.struct("a", "b").alias("src"), F.struct(F.col("x").alias("a"), F.col("y").alias("b")).alias("dst"))


def solve(name: str, vertices: DataFrame, edges: DataFrame, options: Options | None = None, **parameters) -> Result:
    """Run a registered algorithm: ``vertices`` (id), ``edges`` (src, dst[, weight])."""
    data: list[str] = []
    if name == "simrank":
        vertices, edges = simrank_graph(vertices, edges)
        data = ["i_ab"]
    kernel = REGISTRY[name](**parameters)
    return run(initial_state(vertices, kernel), Adjacency.build(vertices, edges, data), kernel, options)
