"""Line dedup, embedding dedup, n-gram join, decontamination and the pipeline, against brute force."""

import collections
import hashlib
import os
import time
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from deltagraph.llm import components, decontamination, embedding_dedup, line_dedup, ngram_join
from deltagraph.llm.common import Workspace, shared_dir
from tests.llm.conftest import ROOT_TABLES, plain_words

needs_tables = pytest.mark.skipif(not os.path.isdir(ROOT_TABLES), reason="no test tables")


def groups(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


# --- components


def test_components_of_chains_stars_and_cycles(spark):
    rng = np.random.default_rng(2)
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 202), (202, 200), (300, 300), (-5, 400)]
    links += [tuple(map(int, x)) for x in rng.integers(1000, 1100, (60, 2))]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long"), Workspace(spark, "t")).collect()}
    want = groups({x for p in links for x in p}, links)
    assert got == {k: v for k, v in want.items() if any(k in p and p[0] != p[1] for p in links)}
    assert components.components(spark.createDataFrame([], "a long, b long"), Workspace(spark, "t")).count() == 0


# --- line dedup


def brute_lines(docs, least):
    """docs: (id, text) in order; the texts without later copies of runs of at least ``least`` words."""
    runs = collections.defaultdict(list)
    for d, (_, t) in enumerate(docs):
        lines = (t or "").split("\n") if t is not None else []
        for i in range(len(lines)):
            for j in range(i + 1, len(lines) + 1):
                if sum(len(plain_words(x, "spaced")) for x in lines[i:j]) >= least:
                    runs["\n".join(lines[i:j]), j - i].append((d, i, j))
    gone = collections.defaultdict(set)
    for places in runs.values():
        for d, i, j in sorted(places)[1:]:
            gone[d].update(range(i, j))
    return [None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[d]) for d, (_, t) in enumerate(docs)]


def test_repeated_runs_by_brute_force(spark):
    rng = np.random.default_rng(5)
    pool = ["a b c", "d", "", "e f", "g h i j k l", "m n"]
    for least in (1, 4, 7):
        docs = [(i, "\n".join(pool[k] for k in rng.integers(0, len(pool), rng.integers(1, 14)))) for i in range(30)]
        docs = [(i, t) for i, t in docs if t] + [(100, None), (101, "g h i j k l\ng h i j k l\ng h i j k l")]
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
        got = {r["doc_id"]: r["text"] for r in line_dedup.delete_repeats(df, min_words=least).collect()}
        assert got == dict(zip([i for i, _ in docs], brute_lines(docs, least)))


def test_line_dedup_of_awkward_rows(spark, awkward, empty):
    rows = line_dedup.delete_repeats(awkward).collect()
    assert len(rows) == awkward.count() and {"n", "lang", "source"} <= set(rows[0].asDict())
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["text"] is None and by[1]["n_lines"] == 0 and by[2]["n_lines"] == 1 and by[8]["text"] == "" and by[7]["n_removed"] == 0
    assert sum(r["doc_id"] == 4 for r in rows) == 2 and line_dedup.delete_repeats(empty).count() == 0


def test_repeated_rows_of_many_lines_stand_once(spark):
    lines = "\n".join(f"w{k}" for k in range(12))
    docs = spark.createDataFrame([(i, 0, i, lines) for i in (1, 2) for _ in range(3)], "d1 long, d2 long, id long, text string")
    found = line_dedup.later_copies(docs, Workspace(spark, "t"), 4).collect()
    # a run can be found both from its first and from its last line
    assert {(r["d1"], r["n"]) for r in found} == {(2, 4)} and len(found) <= 2 * len(set(found))
    text = "\n".join(f"w{k} v{k}" for k in range(60))
    other = "\n".join(f"u{k}" for k in range(70))
    rows = [(1, text)] * 10 + [(2, other)] + [(3, text)] * 2 + [(4, other + "\nend")] + [(None, text)] * 4 + [(None, "end")] * 2
    got = line_dedup.delete_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    one = [(1, text), (2, other), (3, text), (4, other + "\nend"), (None, text), (None, "end")]
    want = dict(zip(one, brute_minimal(dict(enumerate(t for _, t in one)), range(len(one)))))
    assert collections.Counter((r["doc_id"], r["text"]) for r in got) == collections.Counter((i, want[i, t]) for i, t in rows)


def test_mostly_blank_lines_are_listed_once(spark):
    """Runs over thousands of blank lines overlap; what is listed stays linear."""
    text = "\n".join(f"w{k}" + "\n" * 20 for k in range(100))
    docs = spark.createDataFrame([(1, text), (2, text), (3, "x")], "doc_id long, text string")
    keyed = docs.selectExpr("doc_id AS d1", "0L AS d2", "doc_id AS id", "text")
    copies = line_dedup.later_copies(keyed, Workspace(spark, "t"))
    listed = line_dedup.maximal_runs(copies).collect()
    n = text.count("\n") + 1
    assert sum(r["end"] - r["start"] for r in listed) <= n and {r["d1"] for r in listed} == {2}
    got = {r["doc_id"]: r for r in line_dedup.delete_repeats(docs).collect()}
    assert got[1]["n_removed"] == 0 and got[2]["n_lines"] == n and got[3]["text"] == "x"
    # the blank lines at the end close runs that begin 50 words before them
    assert [got[i]["text"] for i in (1, 2)] == [text, ""] and got[2]["n_removed"] == n


def test_line_dedup_keeps_columns_of_any_name(spark):
    text = "\n".join(f"w{k} v{k}" for k in range(60))
    docs = spark.createDataFrame([(1, text, 5, 6, 7, 8, 9), (2, text, 1, 2, 3, 4, 5)], "doc_id long, text string, gone long, d1 long, _c0 long, n_lines long, id long")
    got = line_dedup.delete_repeats(docs)
    assert got.columns == ["doc_id", "text", "gone", "d1", "_c0", "id", "n_lines", "n_removed"]
    assert sorted(tuple(r) for r in got.collect()) == [(1, text, 5, 6, 7, 9, 60, 0), (2, "", 1, 2, 3, 5, 60, 60)]


# --- n-gram join


def brute_groups(rows, k, num, den):
    sets = {}
    for i, t in rows:
        w = plain_words(t, "spaced")
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    ids = sorted(sets)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), g) for i, g in groups(ids, links).items()}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.integers(len(words))] = f"x{rng.integers(9)}"
    return " ".join(words)


@pytest.mark.parametrize(("k", "num", "dense"), [(3, 90, 4), (5, 80, 1), (3, 80, 0)])
def test_groups_by_brute_force(spark, monkeypatch, k, num, dense):
    """Small pages and a low limit for forests, so that paging, forests and the second look all take part."""
    monkeypatch.setattr(ngram_join, "PAGE", 16)
    monkeypatch.setattr(ngram_join, "DENSE", dense)
    rng = np.random.default_rng(k + dense)
    base = [f"w{x}" for x in rng.integers(0, 400, 150)]
    rows = [(i, edited(rng, base, rng.integers(0, 12))) for i in range(60)]
    rows += [(100 + i, " ".join(f"w{x}" for x in rng.integers(0, 30, rng.integers(1, 14)))) for i in range(120)]
    rows += [(300, None), (301, ""), (302, " "), (303, "one"), (304, "ONE"), (305, "one two"), (306, " ".join(base)), (307, " ".join(base))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similar_groups(df, ["doc_id"], k=k, num=num).collect()}
    assert got == brute_groups(rows, k, num, 100)


def test_ngram_join_of_awkward_rows(awkward, empty):
    rows = ngram_join.similar_groups(awkward, ["doc_id"]).collect()
    by = collections.defaultdict(set)
    for r in rows:
        by[r["doc_id"]].add(r["component_id"])
    assert len(rows) == awkward.count() and by[8] == {7} and by[4] == {4} and by[1] == {1} and by[2] == {2}
    assert ngram_join.similar_groups(empty, ["doc_id"]).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 60), st.integers(1, 60), st.sampled_from([(90, 100), (80, 100), (1, 2)]))
def test_linked_sets_share_a_key_and_pass_the_bound(seed, common, extra, limit):
    num, den = limit
    rng = np.random.default_rng(seed)
    pool = np.unique(rng.integers(0, 2**63, common + extra, dtype=np.uint64))
    a, b = pool[rng.random(len(pool)) < 0.95], pool[rng.random(len(pool)) < 0.95]
    if len(a) and len(b) and den * len(np.intersect1d(a, b)) >= num * len(np.union1d(a, b)) and len(np.setxor1d(a, b)):
        assert np.intersect1d(ngram_join.set_keys(a, num, den), ngram_join.set_keys(b, num, den)).size
        point = lambda s: ngram_join.tree_point(s).astype(np.int32)[None, :]
        assert len(ngram_join.tree_pairs(point(a), np.array([len(a)]), point(b), np.array([len(b)]), num, den)[0]) == 1
        assert ngram_join.fine_bound(ngram_join.fine_point(a), ngram_join.fine_point(b)) >= ngram_join.needed(len(a), len(b), num, den)


def test_different_sets_share_no_key_of_an_empty_part():
    rng = np.random.default_rng(8)
    for n, num in ((250, 80), (25, 80), (120, 90)):
        held = collections.Counter(k for _ in range(400) for k in set(ngram_join.set_keys(np.unique(rng.integers(0, 2**64, n, np.uint64)), num, 100).tolist()))
        assert max(held.values()) <= 4


@pytest.mark.parametrize("deals", [1, 2, 4])
def test_sets_at_the_limit_share_a_key(monkeypatch, deals):
    monkeypatch.setattr(ngram_join, "DEALS", deals)
    rng = np.random.default_rng(deals)
    for turn in range(1500):
        num, both = (80, 90)[turn % 2], int(rng.integers(4, 60))
        apart = both * (100 - num) // num  # the most shingles that one of two linked sets may lack
        cut = int(rng.integers(0, apart + 1))
        s = rng.integers(0, 2**64, both + apart, np.uint64)
        a, b = np.sort(s[: both + cut]), np.sort(np.delete(s, np.s_[both : both + cut]))
        if 100 * both >= num * (both + apart) and max(len(a), len(b)) * (100 - num) >= 100:
            assert not apart or np.intersect1d(ngram_join.set_keys(a, num, 100), ngram_join.set_keys(b, num, 100)).size


def test_ngram_join_leaves_only_the_tables_its_result_reads(spark):
    root = Path(shared_dir(spark).removeprefix("file://"))
    before = set(root.iterdir())
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(i, " ".join(words[: 60 - i % 3])) for i in range(30)], "doc_id long, text string")
    got = ngram_join.similar_groups(docs, ["doc_id"])
    assert sorted(t.name[4:] for d in set(root.iterdir()) - before for t in d.iterdir()) == ["named", "rows"]
    assert {r["component_id"] for r in got.collect()} == {0}


def test_saved_tables_leave_no_shuffle_files(spark):
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {f for d in dirs for f in Path(d).rglob("shuffle_*")}
    before = files()
    out = Workspace(spark, "t").save(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counted")
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and out.count() == 7


# --- embeddings


def brute_vectors(ids, x):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = x @ x.T >= 0.9
    np.fill_diagonal(hit, False)
    return hit.sum(1), groups(ids, [(ids[i], ids[j]) for i, j in zip(*np.nonzero(hit))])


def test_links_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "PAGE", 20)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 32))
    x[100:160] = x[0] + 0.1 * rng.standard_normal((60, 32))  # a large group of near copies
    x[160:200] = x[1]  # exact copies
    x[200:] = x[100:200] * 3 + 0.6 * rng.standard_normal((100, 32))
    ids = list(range(300))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>").repartition(3)
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df).collect()}
    n, component = brute_vectors(ids, x)
    found = np.array([got[i]["n_links"] for i in ids])
    assert (found <= n).all() and found.sum() >= 0.95 * n.sum()
    assert np.mean([got[i]["component_id"] == component[i] for i in ids]) > 0.97
    assert all(got[i]["kept"] == (got[i]["component_id"] == i) for i in ids)


def test_planted_pairs_reach_the_recall(spark):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(400):
        x = rng.standard_normal(64)
        x /= np.linalg.norm(x)
        z = rng.standard_normal(64)
        z -= z @ x * x
        c = rng.uniform(0.9001, 0.999)
        rows += [(2 * i, x.tolist()), (2 * i + 1, (c * x + np.sqrt(1 - c * c) * z / np.linalg.norm(z)).tolist())]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert got.where("n_links = 1").count() >= 0.9 * 800


def test_awkward_vectors(spark):
    rows = [(1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [float("inf"), 1.0]), (6, []), (7, [1.0, 2.0]), (8, [2.0, 4.0]), (8, [2.0, 4.0]), (9, [1.0, 2.0, 0.0]), (None, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((str(r["vec_id"]), r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(df).collect())
    assert got == sorted([(str(i), 0, i) for i in (1, 2, 3, 4, 5, 6, 9)] + [("7", 3, 7), ("8", 3, 7), ("8", 3, 7), ("None", 3, 7)])
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_different_vectors_may_share_an_id(spark):
    rows = [(5, [1.0, 0.0, 0.0]), (5, [0.0, 1.0, 0.0]), (7, [1.0, 0.01, 0.0]), (None, [0.0, 0.0, 1.0])]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((str(r["vec_id"]), r["n_links"], r["component_id"]) for r in got) == [("5", 0, 5), ("5", 1, 5), ("7", 1, 5), ("None", 0, None)]


# --- decontamination


def brute_hits(text, items, window):
    w, hit, found = plain_words(text, "alnum"), set(), set()
    for i, t in items:
        x = plain_words(t, "alnum")
        n = min(window, len(x))
        for s in range(len(x) - n + 1 if n else 0):
            for p in range(len(w) - n + 1):
                if w[p : p + n] == x[s : s + n]:
                    hit.update(range(p, p + n))
                    found.add(str(i))
    return len(w), len(hit), sorted(found)


def test_hits_by_brute_force(spark, awkward, empty, monkeypatch):
    rng = np.random.default_rng(3)
    word = lambda n: " ".join("abcde"[k] for k in rng.integers(0, 5, n))
    items = [(i, word(rng.integers(1, 9))) for i in range(12)] + [(50, None), (51, " .!"), (52, "B a"), (53, "b, A")]
    docs = [(i, word(rng.integers(0, 60))) for i in range(40)] + [(90, None), (91, "")]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {i: brute_hits(t, items, 4) for i, t in docs}
    for block, chunk in ((10**6, 1 << 19), (20, 3)):
        monkeypatch.setattr(decontamination, "CANDIDATES", chunk)
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontamination.decontaminate(df, bench, ["doc_id"], window=4, block_words=block).collect()}
        assert got == want
    assert decontamination.decontaminate(awkward, bench, ["doc_id", "lang"]).count() == awkward.count()
    assert decontamination.decontaminate(empty, bench, ["doc_id"]).count() == 0
    assert decontamination.decontaminate(df, bench.limit(0), ["doc_id"]).where("n_hit > 0").count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "red x x blue red green"), (2, "red blue"), (3, "green red blue"), (4, None)], "doc_id long, text string")
    index = decontamination.build_index(docs, "text", ["doc_id"], None, Workspace(spark, "t"))
    got = sorted(tuple(r) for r in decontamination.proximity(index, ["doc_id"], "blue Red green", 3).collect())
    assert got == [(1, 3, 6), (3, 0, 3)]


@needs_tables
def test_decontamination_query(spark):
    """Every row, long texts included."""
    docs = spark.read.parquet(f"{ROOT_TABLES}/documents.parquet").select("doc_id", "text").collect()
    items = {str(r["item_id"]): plain_words(r["text"], "alnum") for r in spark.read.parquet(f"{ROOT_TABLES}/benchmark.parquet").collect()}
    windows = collections.defaultdict(set)
    for i, x in items.items():
        n = min(10, len(x))
        for s in range(len(x) - n + 1 if n else 0):
            windows[tuple(x[s : s + n])].add(i)
    sizes = sorted({len(x) for x in windows})
    got = {r["doc_id"]: r for r in decontamination.op7_decontamination(spark, ROOT_TABLES).collect()}
    assert len(got) == len(docs)
    for r in docs:
        w, hit, found = plain_words(r["text"], "alnum"), set(), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[p : p + n]))) is not None:
                    hit.update(range(p, p + n))
                    found |= own
        mine = got[r["doc_id"]]
        assert (mine["n_words"], mine["n_hit"], mine["n_items"], mine["contaminated"]) == (len(w), len(hit), len(found), bool(hit))
        assert mine["items_sha256"] == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


# --- pipeline


@needs_tables
def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{ROOT_TABLES}/documents.parquet").withColumn("n_words", F.lit(1)).withColumn("score", F.lit("x"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "line_dedup", "near_duplicates", "decontamination", "mixing"]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{ROOT_TABLES}/labels.parquet").collect()}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{ROOT_TABLES}/benchmark.parquet").collect()]
    ws = Workspace(spark, "t")
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
        out = ws.save(stage(spark, docs, ROOT_TABLES), name)
        if name == "mixing":
            assert set(before) == {r["doc_id"] for r in out.collect()}
            break
        assert out.columns == docs.columns
        after = {r["doc_id"]: r["text"] for r in out.select("doc_id", "text").collect()}
        if name == "quality":
            known = [i for i in before if i in labels]
            assert sum((i in after) == bool(labels[i]) for i in known) >= 0.95 * len(known)
        elif name == "line_dedup":
            ids = sorted(before)
            assert after == {i: t for i, t in zip(ids, brute_minimal(before, ids)) if t or t == before[i]}
        elif name == "near_duplicates":
            assert set(after) == {i for i, (_, g) in brute_groups(list(before.items()), 5, 80, 100).items() if g == i}
        else:
            assert set(after) == {i for i, t in before.items() if not brute_hits_fast(t, items)}
        docs = out
    empty = spark.read.parquet(f"{ROOT_TABLES}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, ROOT_TABLES).count() == 0


@needs_tables
def test_pipeline_judges_rows_with_null_or_shared_ids(spark):
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    rows = lambda df: collections.Counter((r["doc_id"], r["text"]) for r in df.collect())
    docs = spark.read.parquet(f"{ROOT_TABLES}/documents.parquet").select("doc_id", "text")
    kept, every = rows(stages["quality"](spark, docs, ROOT_TABLES)), rows(docs)
    bad = next(t for (i, t), n in (every - kept).items() if t)
    labelled = {r["doc_id"] for r in spark.read.parquet(f"{ROOT_TABLES}/labels.parquet").collect()}
    shared = next(i for i, _ in kept if i not in labelled)
    more = spark.createDataFrame([(None, bad), (shared, bad)], docs.schema)
    assert rows(stages["quality"](spark, docs.unionByName(more), ROOT_TABLES)) == kept

    item = next(r["text"] for r in spark.read.parquet(f"{ROOT_TABLES}/benchmark.parquet").collect() if len(plain_words(r["text"], "alnum")) >= 10)
    a, b, c, d, e = (" ".join(f"{x}{k}" for k in range(20)) for x in "abcde")
    mixed = spark.createDataFrame([(None, item), (1, a), (1, item), (None, b), (2, None)], docs.schema)
    assert rows(stages["decontamination"](spark, mixed, ROOT_TABLES)) == {(1, a): 1, (None, b): 1, (2, None): 1}

    copies = [(None, a), (None, a), (3, b), (None, b), (7, c), (7, d), (2, c), (9, e), (9, e), (None, None), (None, None), (4, ""), (4, "")]
    left = stages["near_duplicates"](spark, spark.createDataFrame(copies, docs.schema), ROOT_TABLES)
    assert rows(left) == {(None, a): 1, (3, b): 1, (2, c): 1, (7, d): 1, (9, e): 1, (None, None): 2, (4, ""): 2}


def brute_minimal(texts, ids):
    """Like brute_lines for runs of 50 words, over the shortest sufficient runs only."""
    runs, gone = {}, collections.defaultdict(set)
    for i in ids:
        lines = (texts[i] or "").split("\n")
        n = [len(plain_words(x, "spaced")) for x in lines]
        spans = set()
        for s in range(len(lines)):
            for e in range(s, len(lines)):
                if sum(n[s : e + 1]) >= line_dedup.MIN_WORDS:
                    spans.add((s, e + 1))
                    break
            for b in range(s, -1, -1):
                if sum(n[b : s + 1]) >= line_dedup.MIN_WORDS:
                    spans.add((b, s + 1))
                    break
        for s, e in sorted(spans):
            if runs.setdefault((e - s, "\n".join(lines[s:e])), (i, s)) != (i, s):
                gone[i].update(range(s, e))
    return ["\n".join(x for k, x in enumerate(texts[i].split("\n")) if k not in gone[i]) for i in ids]


def brute_hits_fast(text, items, window=10):
    w = plain_words(text, "alnum")
    for _, t in items:
        x = plain_words(t, "alnum")
        n = min(window, len(x))
        have = {tuple(x[s : s + n]) for s in range(len(x) - n + 1)} if n else set()
        if have and any(tuple(w[p : p + n]) in have for p in range(len(w) - n + 1)):
            return True
    return False
