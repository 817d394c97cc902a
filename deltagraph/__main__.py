"""Command line: python -m deltagraph ALGORITHM --graph DIR --result DIR [options]."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from deltagraph.operators.algorithms import REGISTRY, solve
from deltagraph.plans.engine import Options
from deltagraph.plans.terminate import Diff, Reach
from deltagraph.sources import adjacency, files
from deltagraph.sources.graphs import vertices_of
from deltagraph.streaming.epochs import snapshots


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="deltagraph")
    p.add_argument("algorithm", choices=sorted(REGISTRY))
    p.add_argument("--graph", required=True, help="folder of adjacency text")
    p.add_argument("--result", required=True, help="folder for the result, which must not exist")
    p.add_argument("--weighted", action="store_true")
    p.add_argument("--vertices", type=int, help="fail unless the graph has so many vertices")
    p.add_argument("--portion", type=float, default=1.0)
    p.add_argument("--tol", type=float, default=1e-4)
    p.add_argument("--reach", type=float, help="stop when the sum of values reaches this")
    p.add_argument("--max-rounds", type=int, help="stop after so many rounds, done or not")
    p.add_argument("--check-every", type=int, default=1)
    p.add_argument("--checkpoint", help="folder for epoch snapshots")
    p.add_argument("--log", help="folder for the convergence log")
    p.add_argument("--set", action="append", default=[], metavar="NAME=VALUE", help="parameter of the algorithm")
    o = p.parse_args(args)
    spark = SparkSession.builder.appName(o.algorithm).getOrCreate()
    edges = (adjacency.read_weighted if o.weighted else adjacency.read_adjacency)(spark, o.graph)
    vertices = adjacency.read_vertices(spark, o.graph).union(vertices_of(edges)).distinct()
    if o.vertices is not None and (n := vertices.count()) != o.vertices:
        raise SystemExit(f"the graph has {n} vertices")
    given = {k: float(v) if "." in v or "e" in v else int(v) for k, v in (x.split("=", 1) for x in o.set)}
    checker = Reach(o.reach) if o.reach is not None else Diff(o.tol)
    options = Options(max_rounds=o.max_rounds, checker=checker, portion=o.portion, check_every=o.check_every, on_round=snapshots(o.checkpoint) if o.checkpoint else None)
    done = solve(o.algorithm, vertices, edges, options, **given)
    state = done.state
    if o.algorithm == "simrank":
        state = state.selectExpr("concat_ws('_', id.a, id.b) AS id", "v")
    adjacency.write_result(state, o.result)
    if o.log:
        files.write_progress(done.progress_frame(), o.log)
    print(f"{len(done.progress)} checks, converged: {done.converged}, total {done.progress[-1]['current']}")


if __name__ == "__main__":
    main()
