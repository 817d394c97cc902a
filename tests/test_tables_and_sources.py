"""Table operations, partitioners, text formats and generators."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from deltagraph.functions import scalars
from deltagraph.operators import partition, shards, table_ops, udf
from deltagraph.operators.algorithms import pagerank
from deltagraph.sources import adjacency, files, generate


@pytest.fixture(scope="module")
def state(spark):
    return spark.range(1000).select("id", (F.col("id") * 11.0).alias("v"), (F.col("id") * 7.0).alias("delta"))


def test_put_get_update_iterate(state, spark):
    assert table_ops.entries(state) == 1000 and state.agg(F.sum("delta")).first()[0] == 7 * 999 * 500
    changed = table_ops.update(state, F.col("id") < 10, v=F.lit(0.0))
    assert {r["v"] for r in table_ops.get(changed, [1, 9]).collect()} == {0.0} and table_ops.get(changed, [10], "v").first()["v"] == 110.0
    more = table_ops.upsert(state, spark.createDataFrame([(5, 1.0, 2.0), (5000, 3.0, 4.0)], "id long, v double, delta double"))
    assert table_ops.entries(more) == 1001 and table_ops.get(more, [5]).first()["v"] == 1.0
    assert table_ops.contains(state, spark.range(995, 1010)).count() == 5
    assert table_ops.entries(table_ops.remove(state, spark.range(100))) == 900
    assert table_ops.is_empty(table_ops.clear(state)) and table_ops.swap(1, 2) == (2, 1)
    assert [r["id"] for r in table_ops.page(state, 20, 3).collect()] == [20, 21, 22]
    sent = spark.createDataFrame([(1, 1.0), (1, 2.0), (2000, 5.0)], "dst long, d double")
    assert table_ops.get(table_ops.accumulate(state, sent, pagerank()), [1]).first()["delta"] == 10.0
    assert [r["dst"] for r in table_ops.orphans(sent, state).collect()] == [2000]
    assert {r["dst"]: r["d"] for r in udf.accumulate_with(sent, max).collect()} == {1: 2.0, 2000: 5.0}


def test_shards(spark):
    df = spark.createDataFrame([(-1, "7_9"), (6, "10_2")], "id long, k string")
    rows = df.select(partition.mod(F.col("id"), 4).alias("m"), partition.pair_mod(F.col("k"), 4).alias("p"), partition.text_hash(F.col("k"), 4).alias("t")).collect()
    assert [(r["m"], r["p"]) for r in rows] == [(3, 3), (2, 2)] and all(0 <= r["t"] < 4 for r in rows)
    assert partition.deal(df, partition.mod(F.col("id"), 3), 3).rdd.getNumPartitions() == 3


def test_adjacency_text(spark, tmp_path):
    (tmp_path / "a.txt").write_text("\n1\t2 3 \nno tab\n4\t\n5\t6")
    path = f"file://{tmp_path}/a.txt"
    assert {tuple(r) for r in adjacency.read_adjacency(spark, path).collect()} == {(1, 2), (1, 3), (5, 6)}
    assert {r["id"] for r in adjacency.read_vertices(spark, path).collect()} == {1, 4, 5}
    (tmp_path / "w.txt").write_text("1\t2,0.5 3,2 \n4\t1,7")
    assert {tuple(r) for r in adjacency.read_weighted(spark, f"file://{tmp_path}/w.txt").collect()} == {(1, 2, 0.5), (1, 3, 2.0), (4, 1, 7.0)}
    (tmp_path / "p.txt").write_text("1_4\t6 2 4 \t5 \n2_2\t1 \t\n")
    rows = {(r["a"], r["b"]): (r["i_ab"], r["out_a"], r["out_b"]) for r in adjacency.read_pairs(spark, f"file://{tmp_path}/p.txt").collect()}
    assert rows == {(1, 4): (6, [2, 4], [5]), (2, 2): (1, [], [])}
    edges = spark.createDataFrame([(1, 2, 0.5), (1, 3, 2.0), (9, 1, 1.0)], "src long, dst long, weight double")
    adjacency.write_adjacency(edges, f"file://{tmp_path}/out", weighted=True)
    assert {tuple(r) for r in adjacency.read_weighted(spark, f"file://{tmp_path}/out").collect()} == {tuple(r) for r in edges.collect()}


def test_generator_is_reproducible_and_has_no_loops(spark):
    g = generate.random_graph(spark, 200, weighted=True)
    assert {tuple(r) for r in g.collect()} == {tuple(r) for r in generate.random_graph(spark, 200, weighted=True).collect()}
    assert g.where("src = dst or dst < 0 or dst >= 200 or weight <= 0").isEmpty() and g.select("src").distinct().count() == 200


def test_histogram(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (1.01,)], "x double")
    assert sum(r["n"] for r in scalars.histogram(df, "x").collect()) == 3


def test_files_and_progress_log(spark, tmp_path):
    base = f"file://{tmp_path}/f"
    files.mkdirs(spark, base)
    (tmp_path / "f" / "a.txt").write_text("x\ny")
    assert files.exists(spark, f"{base}/a.txt") and files.stat(spark, f"{base}/*.txt")[0][1] == 3
    assert files.move(spark, f"{base}/a.txt", f"{base}/b.txt") and [p.rsplit("/", 1)[1] for p in files.glob(spark, f"{base}/*")] == ["b.txt"]
    assert files.lines(spark, f"{base}/b.txt").count() == 2 and bytes(files.whole(spark, base).first()["content"]) == b"x\ny"
    progress = spark.createDataFrame([(2, 1.5), (1, 0.5)], "round int, current double")
    files.write_progress(progress, f"{base}/log")
    assert [r["value"] for r in files.lines(spark, f"{base}/log").collect()] == ["round 1\tcurrent 0.5", "round 2\tcurrent 1.5"]
    assert files.remove(spark, base) and not files.exists(spark, base)


def test_functions_on_shards(spark):
    df = spark.range(40).select("id", (F.col("id") * 1.0).alias("v"))

    def total(batches):
        yield pd.DataFrame({"s": [sum(float(b["v"].sum()) for b in batches)]})

    shard = partition.mod(F.col("id"), 4)
    assert sum(r["s"] for r in shards.run_all(df, shard, 4, total, "s double").collect()) == 780
    assert sum(r["s"] for r in shards.run_range(df, shard, 4, [0, 1], total, "s double").collect()) == 370
    assert sum(r["s"] for r in shards.run_one(df, shard, 3, total, "s double").collect()) == 210


def test_command_line(spark, tmp_path, capsys):
    from deltagraph.__main__ import main

    (tmp_path / "g.txt").write_text("0\t1,4 2,1 \n1\t3,1 \n2\t1,2 3,5\n4\t0,1\n3\t\n")
    main(["shortest_paths", "--graph", f"file://{tmp_path}/g.txt", "--weighted", "--result", f"file://{tmp_path}/out", "--vertices", "5", "--set", "source=0", "--log", f"file://{tmp_path}/log"])
    got = {r["id"]: r["v"] for r in adjacency.read_result(spark, f"file://{tmp_path}/out").collect()}
    assert got == {0: 0.0, 1: 3.0, 2: 1.0, 3: 4.0, 4: None} and "converged: True" in capsys.readouterr().out


def test_a_user_fold_costs_no_call_a_key_and_streams(spark, monkeypatch):
    monkeypatch.setattr(udf, "KEYS", 50)
    sent = spark.range(40_000).select(F.when(F.col("id") % 7 > 0, F.col("id") % 3001).alias("dst"), F.when(F.col("id") % 5 > 0, F.col("id").cast("double")).alias("d")).repartition(3)
    folded = udf.accumulate_with(sent, lambda a, b: a + b)
    assert {tuple(r) for r in folded.collect()} == {tuple(r) for r in sent.groupBy("dst").agg(F.sum("d")).collect()}
    assert "FlatMapGroups" not in folded._jdf.queryExecution().executedPlan().toString()
    nothing = spark.createDataFrame([(1, None), (1, None), (2, None), (2, 3.0)], "dst long, d double")
    assert {tuple(r) for r in udf.accumulate_with(nothing, max).collect()} == {(1, None), (2, 3.0)}
    assert udf.accumulate_with(sent.limit(0), max).isEmpty()
