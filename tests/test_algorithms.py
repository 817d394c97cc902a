"""Closed forms and invariants of the algorithms on hand-checkable graphs."""

import pytest

from deltagraph.operators import algorithms as alg
from deltagraph.operators import hubs, udf
from deltagraph.plans.engine import Adjacency, Options, initial_state, one_round, rounds, run
from deltagraph.plans.terminate import Diff, Reach, Settled
from deltagraph.streaming import epochs

MICRO = [(0, 1, 4.0), (0, 2, 1.0), (1, 3, 1.0), (2, 1, 2.0), (2, 3, 5.0), (4, 0, 1.0)]
EXACT = Options(checker=Settled(1e-12), max_rounds=200)


@pytest.fixture(scope="module")
def micro(spark):
    return spark.createDataFrame([(i,) for i in range(5)], "id long"), spark.createDataFrame(MICRO, "src long, dst long, weight double")


def values(state):
    return {r["id"]: r["v"] for r in state.collect()}


def test_micro_graph(micro):
    want = {
        ("shortest_paths", ("source", 0)): {0: 0, 1: 3, 2: 1, 3: 4, 4: None},
        ("pagerank",): {0: 0.36, 1: 0.4816, 2: 0.344, 3: 0.72288, 4: 0.2},
        ("connected_components",): {i: 4 for i in range(5)},
        ("katz", ("source", 0), ("beta", 0.1)): {0: 1e6, 1: 110000, 2: 100000, 3: 21000, 4: 0},
        ("adsorption", ("starts", 2), ("damping", 0.1)): {0: 10, 1: 14.2, 2: 1.0, 3: 1.92, 4: 0},
    }
    for (name, *parameters), expected in want.items():
        got = values(alg.solve(name, *micro, EXACT, **dict(parameters)).state)
        assert got == {k: pytest.approx(v) if v is not None else None for k, v in expected.items()}, name


def test_simrank_golden(spark):
    edges = spark.createDataFrame([(1, 2), (1, 4), (2, 3), (3, 1), (4, 5), (5, 4)], "src long, dst long")
    vertices = spark.createDataFrame([(i,) for i in range(1, 6)], "id long")
    got = {(r["id"]["a"], r["id"]["b"]): r["v"] for r in alg.solve("simrank", vertices, edges, Options(checker=Diff(1e-9), max_rounds=80, check_every=4)).state.collect()}
    golden = {(1, 4): 0.132336, (1, 5): 0.033878, (2, 4): 0.413551, (2, 5): 0.105869, (3, 4): 0.042348, (3, 5): 0.330841, (4, 5): 0.088224}
    golden |= {(i, i): 1.0 for i in range(1, 6)}
    for pair, v in got.items():
        assert v == pytest.approx(golden.get(pair, 0.0), abs=2e-6), pair


def test_self_loops_survive_and_parallel_edges_count_twice(spark):
    vertices = spark.createDataFrame([(0,), (1,)], "id long")
    edges = spark.createDataFrame([(0, 0), (0, 1), (0, 1)], "src long, dst long")
    kernel = alg.pagerank()
    got = {r["id"]: r["delta"] for r in one_round(initial_state(vertices, kernel), Adjacency.build(vertices, edges), kernel).collect()}
    assert got[0] == pytest.approx(0.2 * 0.8 / 3) and got[1] == pytest.approx(2 * 0.2 * 0.8 / 3)


def test_unknown_vertices_fail_only_when_strict(spark):
    vertices = spark.createDataFrame([(0,)], "id long")
    edges = spark.createDataFrame([(0, 7)], "src long, dst long")
    kernel = alg.pagerank()
    state, adj = initial_state(vertices, kernel), Adjacency.build(vertices, edges)
    assert [r["id"] for r in one_round(state, adj, kernel).collect()] == [0]
    with pytest.raises(Exception, match="no vertex"):
        one_round(state, adj, kernel, strict=True).collect()


def test_closed_graph_ranks_sum_to_n(spark):
    ring = spark.createDataFrame([(i, (i + 1) % 20) for i in range(20)] + [(i, (i * 3) % 20) for i in range(20)], "src long, dst long")
    vertices = spark.range(20)
    r = alg.solve("pagerank", vertices, ring, Options(checker=Diff(1e-9), max_rounds=200, check_every=10))
    assert sum(values(r.state).values()) == pytest.approx(20, abs=1e-6) and r.converged
    for name, p in (("pagerank", {}), ("shortest_paths", {"source": 3}), ("connected_components", {})):
        whole = values(alg.solve(name, vertices, ring, Options(checker=Settled(1e-10), max_rounds=150, check_every=5), **p).state)
        some = values(alg.solve(name, vertices, ring, Options(checker=Settled(1e-6), max_rounds=300, portion=0.5), **p).state) if name != "pagerank" else whole
        assert some == pytest.approx(whole, abs=1e-5), name


def test_small_chunks_hub_split_and_udf_agree(micro):
    vertices, edges = micro
    for name, p in (("pagerank", {}), ("shortest_paths", {"source": 0}), ("adsorption", {"starts": 2})):
        kernel = alg.REGISTRY[name](**p)
        state = initial_state(vertices, kernel)
        plain = {tuple(r) for r in rounds(state, Adjacency.build(vertices, edges), kernel, 3).collect()}
        chunked = {tuple(r) for r in rounds(state, Adjacency.build(vertices, edges, chunk=1), kernel, 3).collect()}
        split = state
        for _ in range(3):
            split = hubs.split_round(split, edges, kernel, 2, 3)
        assert chunked == plain and {tuple(r) for r in split.collect()} == plain
    by_udf = udf.with_emit(alg.pagerank(), lambda d, v, w, n: d * 0.8 / n)
    adj = Adjacency.build(vertices, edges)
    assert values(rounds(initial_state(vertices, by_udf), adj, by_udf, 3)) == pytest.approx(values(rounds(initial_state(vertices, alg.pagerank()), adj, alg.pagerank(), 3)))


def test_resume_equals_an_uninterrupted_run(micro, spark, tmp_path):
    vertices, edges = micro
    kernel, adj = alg.pagerank(), Adjacency.build(vertices, edges)
    folder = f"file://{tmp_path}/epochs"
    assert epochs.latest_epoch(spark, folder) is None
    run(initial_state(vertices, kernel), adj, kernel, Options(max_rounds=2, checker=None, on_round=epochs.snapshots(folder)))
    assert epochs.latest_epoch(spark, folder) == 2
    resumed = epochs.resume(vertices, adj, kernel, folder, Options(max_rounds=4, checker=None)).state
    assert values(resumed) == pytest.approx(values(rounds(initial_state(vertices, kernel), adj, kernel, 4)))


def test_checkers():
    d, reach, settled = Diff(0.5), Reach(3), Settled(0.1)
    assert [d.terminate(x, 0) for x in (1, 2, 2.4)] == [False, False, True]
    d.reset()
    assert not d.terminate(2.4, 0)
    assert reach.terminate(-3, 0) and not reach.terminate(2, 0) and settled.terminate(0, 0.1)


def test_idempotent_kernels_end_only_when_nothing_is_pending(spark):
    """Zero weights leave the sums as they are, and a chain is longer than any default number of rounds."""
    vertices = spark.range(4)
    edges = spark.createDataFrame([(0, 1, 0.0), (1, 2, 0.0), (2, 3, 5.0)], "src long, dst long, weight double")
    done = alg.solve("shortest_paths", vertices, edges)
    assert values(done.state) == {0: 0.0, 1: 0.0, 2: 0.0, 3: 5.0} and done.converged
    chain = spark.range(299).selectExpr("id AS src", "id + 1 AS dst", "CAST(id % 2 AS DOUBLE) AS weight")
    done = alg.solve("shortest_paths", spark.range(300), chain, Options(check_every=25))
    assert values(done.state) == {i: float(i // 2) for i in range(300)} and done.converged
    short = alg.solve("shortest_paths", spark.range(300), chain, Options(check_every=10, max_rounds=20))
    assert not short.converged and sum(v is not None for v in values(short.state).values()) == 20


def test_a_sum_that_never_settles_is_an_error(spark, monkeypatch):
    from deltagraph.plans import engine

    monkeypatch.setattr(engine, "LIMIT", 6)
    ring = spark.createDataFrame([(0, 1), (1, 0)], "src long, dst long")
    with pytest.raises(RuntimeError, match="isn't done"):
        alg.solve("katz", spark.range(2), ring, Options(checker=Diff(1e-9), check_every=3), beta=1.0)


def test_updates_triggers_and_own_estimates(micro):
    class Count:
        seen = []

        def reset(self): ...

        def estimate(self):
            from pyspark.sql import functions as F

            return F.count(F.when(F.col("v") > 0, 1))

        def terminate(self, current, residual):
            self.seen.append(current)
            return current >= 5

    done = alg.solve("pagerank", *micro, Options(checker=Count(), max_rounds=9))
    assert Count.seen == [5.0] and done.converged and done.progress[0]["updates"] == 5 and done.state.columns == ["id", "v", "delta"]
    seen = alg.solve("pagerank", *micro, Options(checker=None, max_rounds=3, check_every=3)).progress
    assert seen[-1]["updates"] == 5 + 4 + 3
    from pyspark.sql import functions as F

    none = alg.solve("pagerank", *micro, Options(checker=None, trigger=lambda key, current, update: F.when(key == 3, update).otherwise(0.0)))
    assert values(none.state) == pytest.approx({0: 0.2, 1: 0.2, 2: 0.2, 3: 0.2 + 0.16 + 0.08, 4: 0.2})


def test_a_round_has_one_exchange_and_combines_before_it(micro):
    from deltagraph.plans.engine import Adjacency, initial_state, rounds

    vertices, edges = micro
    kernel = alg.pagerank()
    adj = Adjacency.build(vertices, edges)
    adj.rows.count()
    plan = lambda k: rounds(initial_state(vertices, kernel), adj, kernel, k)._jdf.queryExecution().executedPlan().toString().split("InMemoryTableScan")[0]
    assert plan(1).count("partial_sum(delta") == 1 and plan(1).count("Exchange hashpartitioning(id") == 1
    adj.release()


def test_priorities_by_ranges_equal_one_buffer(spark, monkeypatch):
    from pyspark.sql import functions as F

    from deltagraph.plans import schedule

    state = spark.range(500).select("id", F.lit(0.0).alias("v"), ((F.col("id") * 37) % 100 / 7).alias("delta")).repartition(3)
    kernel = alg.pagerank()
    want = {r["id"] for r in state.where(schedule.threshold(state, kernel, 0.3)).collect()}
    monkeypatch.setattr(schedule, "ONE_BUFFER", 10)
    assert {r["id"] for r in state.where(schedule.threshold(state, kernel, 0.3)).collect()} == want
    best = sorted(((-round(r["delta"], 9), r["id"]) for r in state.collect()))[:125]
    assert {r["id"] for r in schedule.top_portion(state, kernel, 0.25).collect()} == {i for _, i in best}


def test_distances_over_trees_equal_rounds(spark):
    import random

    from deltagraph.operators import trees

    dice = random.Random(5)
    for n, m in ((60, 70), (40, 30)):
        rows = [(dice.randrange(n + 2), dice.randrange(n + 2), float(dice.randrange(4))) for _ in range(m)] + [(n - 3, n - 2, 1.0), (n - 2, n - 3, 1.0)]
        vertices, edges = spark.range(n), spark.createDataFrame(rows, "src long, dst long, weight double")
        for source in (rows[0][0],):
            assert values(trees.distances(vertices, edges, source)) == values(alg.solve("shortest_paths", vertices, edges, source=source).state)
    # a loop of vertices with one way in has no root
    loop = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (3, 1, 1.0), (0, 4, 2.0)], "src long, dst long, weight double")
    assert values(trees.distances(spark.range(5), loop, 0)) == {0: 0.0, 1: None, 2: None, 3: None, 4: 2.0}
    assert values(trees.distances(spark.range(5), loop, 2)) == {0: None, 1: 2.0, 2: 0.0, 3: 1.0, 4: None}


def test_rounds_of_a_chain_do_not_follow_its_length(spark, monkeypatch):
    from deltagraph.operators import trees
    from deltagraph.plans import engine

    plain, ran = engine.one_round, []
    monkeypatch.setattr(engine, "one_round", lambda *a: ran.append(1) or plain(*a))
    chain = spark.range(1999).selectExpr("id AS src", "id + 1 AS dst", "CAST(id % 2 AS DOUBLE) AS weight")
    assert values(trees.distances(spark.range(2000), chain, 0)) == {i: float(i // 2) for i in range(2000)} and len(ran) <= 2


def test_the_chain_query_has_few_rounds(spark, tmp_path, monkeypatch):
    from deltagraph import catalogue
    from deltagraph.plans import engine

    plain, ran = engine.one_round, []
    monkeypatch.setattr(engine, "one_round", lambda *a: ran.append(1) or plain(*a))
    spark.range(0, 200, 2).withColumnRenamed("id", "s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    got = values(catalogue.queries()["sssp_chain"](spark, str(tmp_path)))
    assert got == {i: float(sum(j % 3 for j in range(0, i, 2))) for i in range(0, 200, 2)} and len(ran) <= 4


def test_partitions_follow_the_graph_and_no_round_sorts_the_adjacency(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        vertices, edges = spark.range(50), spark.range(50).selectExpr("id AS src", "(id * 7) % 50 AS dst")
        kernel, adj = alg.pagerank(), Adjacency.build(vertices, edges)
        assert adj.rows.rdd.getNumPartitions() == adj.parts == spark.sparkContext.defaultParallelism
        assert spark.conf.get("spark.sql.shuffle.partitions") == "64"
        once = one_round(initial_state(vertices, kernel), adj, kernel)
        once.collect()
        plan = once._jdf.queryExecution().executedPlan().toString()
        read = plan[: plan.index("InMemoryRelation")]
        assert read.count("Sort [") == read.count("SortMergeJoin") == 1 and "weight" not in read
        run(initial_state(vertices, kernel), adj, kernel, Options(max_rounds=1, checker=None))
        assert spark.conf.get("spark.sql.shuffle.partitions") == "64"
        adj.release()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
