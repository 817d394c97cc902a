"""Mixing, WARC, URL filter, licences, languages, quality: brute force, round trips and awkward rows."""

import glob
import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from deltagraph.llm import language_id, license_scan, mixing, quality, queries, url_filter, warc
from deltagraph.llm.common import Workspace, join_few
from tests.llm.conftest import ROOT_TABLES, plain_words

needs_tables = pytest.mark.skipif(not os.path.isdir(ROOT_TABLES), reason="no test tables")


@needs_tables
@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{ROOT_TABLES}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    df, rel = queries.queries()[name](spark, ROOT_TABLES), con.sql(queries.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr) == sorted(rel.select(*cols).fetchall(), key=repr)


def test_join_few(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (None, "c")], "k long, x string")
    right = spark.createDataFrame([(2, 9)], "k long, y int")
    assert sorted(map(tuple, join_few(left, right, "k").collect()), key=repr) == sorted([(1, "a", None), (2, "b", 9), (2, "b", 9), (None, "c", None)], key=repr)
    assert {tuple(r) for r in join_few(left, right.select("k"), "k", "left_anti").collect()} == {(1, "a"), (None, "c")}


# --- mixing


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, free = {}, share * sum(sizes.values()), list(order)
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > most * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / total for s in free}
        target |= {s: most * float(sizes[s]) for s in over}
        left = share * sum(sizes.values()) - sum(target.values())
        free = [s for s in free if s not in target]
    return target


def targets(spark, sizes):
    rows = [(s, n, 1) for s, n in sizes.items()]
    return {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(rows, "source string, words long, n long"), Workspace(spark, "t")).collect()}


def test_targets_fill_up_by_weight(spark):
    t = targets(spark, {"b": 100, "a": 10, None: 100})
    assert t["a"] == 20 and sum(t.values()) == pytest.approx(315) and t["b"] / t[None] == pytest.approx(1 / 2)
    assert targets(spark, {}) == {} and targets(spark, {"a": 0}) == {"a": 0.0}
    rng = np.random.default_rng(4)
    sizes = {f"{'zéA漢'[i % 4]}{i}": int(n) for i, n in enumerate(rng.pareto(1, 60) * 40)} | {None: 3, "": 0}
    assert targets(spark, sizes) == pytest.approx(brute_targets(sizes))


def test_many_sources(spark):
    """A source for each document."""
    docs = spark.range(6_000).selectExpr("id AS doc_id", "'a b c d' AS text", "concat('s', id) AS source")
    got = mixing.mix_sources(docs)
    r = got.agg(F.count("*").alias("n"), F.sum("taken").alias("t"), F.max("taken").alias("most")).first()
    assert r["n"] == 6_000 and r["most"] <= 8 and abs(r["t"] - 1.5 * 24_000) <= 0.25 * 24_000


def test_equal_rows_are_dealt_over_blocks(spark):
    rows = [(None, "a b c", "s")] * 500 + [(7, "a b", "s")] * 40 + [(8, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    runs = [sorted(map(str, mixing.mix_sources(docs.repartition(n), block=32).select("doc_id", "size", "target", "taken").collect())) for n in (1, 5)]
    got = mixing.mix_sources(docs, block=32).toPandas()
    assert runs[0] == runs[1] and len(got) == 541 and (got.taken <= 2 * got["size"]).all()
    own = got[got.source == "s"]
    assert abs(own.taken.sum() - own.target.iloc[0]) <= 3
    units = mixing._numbered(docs.selectExpr("doc_id", "source", "1L AS size"), 32)
    assert units.count() == 541 and units.distinct().count() == 541


def test_flight_keeps_words_and_documents():
    rng = np.random.default_rng(0)
    size, p = rng.integers(1, 500, 400).astype(float), np.full(400, 0.37)
    out = mixing.flight(size, p, rng.random(400))
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert (size * out).sum() == pytest.approx((size * p).sum()) and out.sum() == pytest.approx(p.sum())
    assert set(mixing.land(size, out, rng.random(400))) <= {0.0, 1.0}


def test_mix_is_near_its_targets_in_one_or_many_blocks(spark, awkward, empty):
    rows = [(i, "w " * (1 + i % 97), f"s{i % 3}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for block in (8192, 64):
        got = mixing.mix_sources(docs, block=block).toPandas()
        by = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
        assert (abs(by.taken - by.target) <= 2).all() and (got.taken <= 2 * got["size"]).all() and len(got) == 900
        again = mixing.mix_sources(docs.repartition(3), block=block).toPandas()
        assert got.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()
    odd = mixing.mix_sources(awkward).collect()
    assert len(odd) == awkward.count() and all(r["taken"] == 0 for r in odd if r["size"] == 0)
    assert mixing.mix_sources(empty).count() == 0
    copies = mixing.take_copies(docs, mixing.mix_sources(docs))
    assert copies.count() == mixing.mix_sources(docs).agg(F.sum("copies")).first()[0]


# --- WARC


def test_chunked_framing_round_trip():
    for payload in (b"", b"x", bytes(range(256)) * 300):
        assert warc.unchunk(warc.chunked(payload, 100)) == payload
    with pytest.raises(ValueError):
        warc.unchunk(b"5\r\nab")


def test_archives_round_trip_with_segments_and_revisits(spark, tmp_path):
    long = "é<p>\r\n\r\nWARC/1.1\r\n</p>" * 4000
    rows = [(1, "http://a/", long), (2, "http://b/ c", long), (2, "http://b/ c", long), (3, None, None), (4, "u", "x" * 999), (5, "u", "x" * 999), (None, "n", "y" * 1000), (6, "n", "y" * 1000), (7, "z", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = f"file://{tmp_path}/w"
    warc.write_warc(pages, path, segment=1000)
    back = warc.read_warc(spark, path, payloads=True).collect()
    assert len(back) == len(rows)
    kinds = sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in back)
    assert kinds == sorted([("1", "revisit", 2), ("2", "response", None), ("2", "response", None), ("3", "response", None), ("4", "response", None), ("5", "response", None), ("None", "revisit", 6), ("6", "response", None), ("7", "response", None)], key=str)
    payload = {r["page_id"]: bytes(r["data"]) for r in back if r["record_type"] == "response"}
    assert payload[2] == long.encode() and payload[3] == b"" and payload[6] == b"y" * 1000
    warc.write_warc(pages.limit(0), f"file://{tmp_path}/none")
    assert warc.read_warc(spark, f"file://{tmp_path}/none").count() == 0


def test_missing_segment_is_an_error(spark, tmp_path):
    records = list(warc.page_records(1, "u", b"z" * 5000, "00" * 20, None, 1000))
    (tmp_path / "a.warc").write_bytes(b"".join(r + warc.END for i, r in enumerate(records) if i != 2))
    with pytest.raises(Exception, match="segments"):
        warc.read_warc(spark, f"file://{tmp_path}/a.warc").collect()


# --- URLs


def test_longest_rule_wins_and_odd_urls(spark):
    urls = [("http://WWW.Example.com/en/1", "www.example.com/en/", "allow"), ("https://m.example.com/en/", "example.com/en/", "block"), ("http://notexample.com/en/", "com/", "allow"),
            ("http://x.com", None, "allow"), ("http://a.net/es/x?/fr/", "net/es/", "block"), ("ftp://b.net/it/", None, "allow"), (None, None, "allow"), ("", None, "allow"), ("nothing", None, "allow"),
            ("http://ads.DoubleClick.net/x", None, "block"), ("http://doubleclick.net", None, "block"), ("x://a.b.c.d.net/fr/" + "y" * 5000, "net/fr/", "block")]
    df = spark.createDataFrame([(u, 1) for u, _, _ in urls] + [(urls[0][0], 1)], "url string, rule int")
    rules, own = url_filter.rule_table(spark, url_filter.RULES), url_filter.rule_table(spark, url_filter.METHOD_BLOCKS)
    got = url_filter.filter_urls(df, "url", rules, extra=own).collect()
    assert len(got) == len(urls) + 1
    want = {u: (r, v) for u, r, v in urls}
    assert all((r["url_rule"], r["url_verdict"]) == want[r["url"]] for r in got)
    assert {r["url_verdict"] for r in url_filter.filter_urls(df, "url", rules.limit(0)).collect()} == {"allow"}
    assert url_filter.filter_urls(df.limit(0), "url", rules).count() == 0
    clash = df.selectExpr("url", "1 AS won", "2 AS url_rule", "3 AS host", "4 AS keys", "5 AS block", "6 AS _c0")
    out = url_filter.filter_urls(clash, "url", rules, extra=own)
    assert out.columns == ["url", "won", "host", "keys", "block", "_c0", *url_filter.RESULT]
    assert {(r["won"], r["host"], r["keys"], r["block"], r["_c0"]) for r in out.collect()} == {(1, 3, 4, 5, 6)} and out.count() == len(urls) + 1


def test_a_full_filter_changes_no_verdict(spark, monkeypatch):
    hosts = [f"h{i}.org" for i in range(300)]
    rules = spark.createDataFrame([(h, f"/{i % 7}/", "block") for i, h in enumerate(hosts)], "host string, path string, action string")
    urls = spark.range(3000).selectExpr("id", "concat('http://w.h', id % 600, '.org/', id % 5, '/x') AS url")
    want = {i: "block" if i % 600 < 300 and (i % 600) % 7 == i % 5 else "allow" for i in range(3000)}
    for most in (1 << 17, 1):
        monkeypatch.setattr(url_filter, "MOST_BLOCKS", most)
        assert {r["id"]: r["url_verdict"] for r in url_filter.filter_urls(urls, "url", rules).collect()} == want


# --- licences


def test_base_phrases_by_brute_force(spark, awkward, empty):
    texts = ["GNU general  public LICENSE", "cc by-cc-by the mit license mit licenses", "apache", "apache license apache license", "gnu general public", "public license " + "the of " * 2000 + "cc by"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").unionByName(awkward.select("doc_id", "text"))
    for r in license_scan.scan(docs, ["doc_id", "text"]).collect():
        w = plain_words(r["text"], "alnum")
        at = [(i, label) for p, label in license_scan.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(w), len(at), sorted({x for _, x in at}))
        assert (r["first_word"], r["last_word"]) == ((min(at)[0], max(at)[0]) if at else (None, None)) and set(r["base_labels"]) <= set(r["labels"])
    assert license_scan.scan(empty, ["doc_id"]).count() == 0


def test_edited_templates_are_covered(spark):
    for label, text in license_scan.TEMPLATES:
        words = text.split()
        edited = " ".join(words[:10] + ["really", "new"] + words[10:]) if len(words) > 20 else text
        (r,) = license_scan.scan(spark.createDataFrame([("before and " + edited + " after",)], "text string"), ["text"]).collect()
        assert label in r["labels"] and r["score"] >= 0.6
    (r,) = license_scan.scan(spark.createDataFrame([("the software is free of charge to any person who may use it",)], "text string"), ["text"]).collect()
    assert r["labels"] == [] and 0 <= r["score"] < 1
    (r,) = license_scan.scan(spark.createDataFrame([("one zlib two",)], "text string"), ["text"], license_scan.Scanner(phrases=[("zlib", "z")])).collect()
    assert (r["n_base"], r["first_word"], r["base_labels"]) == (1, 1, ["z"])
    only = lambda label: license_scan.scan(spark.createDataFrame([(dict(license_scan.TEMPLATES)[label],)], "text string"), ["text"]).first()["labels"]
    assert [only(x) for x in ("lgpl", "agpl", "bsd-2", "bsd-3", "mit")] == [["lgpl"], ["agpl"], ["bsd-2"], ["bsd-3"], ["mit"]]


def test_matching_statistics_by_brute_force():
    rng = np.random.default_rng(4)
    texts = [rng.integers(0, 3, 12).tolist() for _ in range(4)]
    machine = license_scan.Automaton(texts, [[0, 1]])
    stream = rng.integers(0, 4, 200).tolist()
    inside = {tuple(t[i:j]) for t in texts + [[0, 1]] for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    for i, (v, n) in enumerate(machine.stream(stream)):
        assert n == max((k for k in range(i + 2) if k == 0 or tuple(stream[i + 1 - k : i + 1]) in inside), default=0)
        assert [1 for p, need in machine.phrases[v] if n >= need] == [1] * (stream[max(0, i - 1) : i + 1] == [0, 1])


# --- languages


def test_costs_are_exact_code_lengths():
    texts = {"x": b"abracadabra abba", "y": b"banana bandana"}
    grams = {}
    for k, t in texts.items():
        padded = np.frombuffer(b"\0\0\0" + t, np.uint8).astype(np.int64)
        g = (padded[:-3] << 24) | (padded[1:-2] << 16) | (padded[2:-1] << 8) | padded[3:]
        grams[k] = np.unique(g, return_counts=True)
    trees = language_id.ContextTrees(grams)
    assert np.exp2(-trees.cost[:, 1:, :].astype(float)).sum(1) == pytest.approx(np.ones((len(trees.cost), 2)), abs=1e-5)
    data = b"abracadabra abba" + b"banana" + "\u00e9\0".encode()
    bits = trees.lengths(np.frombuffer(data, np.uint8), np.array([0, 16, 22, 22, len(data)]))
    assert bits[0].argmin() == 0 and bits[1].argmin() == 1 and (bits[2] == 0).all() and (bits[3] > 0).all()
    # by hand: after "abr" only "a" was seen, twice: 2 of 2 + 1 escape
    row = trees.row[int(sum(int(trees.symbol[b]) * trees.size ** (2 - i) for i, b in enumerate(b"abr")))]
    assert trees.cost[row, trees.symbol[ord("a")], 0] == pytest.approx(-np.log2(2 / 3))


def test_small_languages_keep_their_bytes():
    # many scripts, the first language far larger than the others
    starts = {"en": 0x21, "ru": 0x430, "el": 0x3B1, "he": 0x5D0, "ar": 0x627, "th": 0xE01, "hi": 0x905, "zh": 0x4E00, "ko": 0xAC00}
    texts = {k: "".join(chr(s + 7 * i % {"en": 90, "zh": 2000, "ko": 2000}.get(k, 24)) for i in range(300)).encode() for k, s in starts.items()}
    grams = {}
    for k, t in texts.items():
        padded = np.frombuffer(b"\0\0\0" + t, np.uint8).astype(np.int64)
        g, n = np.unique((padded[:-3] << 24) | (padded[1:-2] << 16) | (padded[2:-1] << 8) | padded[3:], return_counts=True)
        grams[k] = (g, n * (1000 if k == "en" else 1))
    trees = language_id.ContextTrees(grams)
    used = sorted(set(b"".join(texts.values())))
    assert len(used) > 120 and len(set(trees.symbol[used].tolist())) == len(used) and 1 not in trees.symbol[used]
    data = b"".join(texts.values())
    bits = trees.lengths(np.frombuffer(data, np.uint8), np.cumsum([0, *[len(t) for t in texts.values()]]))
    assert [trees.langs[i] for i in bits.argmin(1)] == list(texts)


def test_languages_of_awkward_texts(spark, awkward, empty):
    train = spark.createDataFrame([(i, "en", "the quick brown fox") for i in range(9)] + [(20 + i, "de", "der schnelle braune fuchs") for i in range(9)], "doc_id long, lang string, text string")
    trees = language_id.train(train)
    got = {r["text"]: r for r in language_id.predict(awkward, ["text"], trees).collect()}
    assert got[None]["lang_pred"] == got[""]["lang_pred"] == got["\n\n\n"]["lang_pred"] == "und" and got["one"]["lang_pred"] in ("en", "de")
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language_id.train(train.limit(0)) is None
    assert {r["lang_pred"] for r in language_id.predict(awkward, ["text"], None).collect()} == {"und"}
    assert language_id.predict(empty, ["doc_id"], trees).count() == 0


@needs_tables
def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{ROOT_TABLES}/documents.parquet").select("doc_id", "lang")
    got = language_id.op6_language_id(spark, ROOT_TABLES).join(docs, "doc_id").where("held_out")
    assert got.where("lang_pred = lang").count() >= 0.95 * got.count()


# --- quality


def test_statistics_by_brute_force():
    texts = ["Aa bb bb !! $$x 12|", None, "", "é é\né"]
    x = quality.text_statistics(pa.array(texts))
    at = {s: i for i, s in enumerate(quality.STATISTICS)}
    assert x[0, at["log_words"]] == pytest.approx(np.log1p(6)) and x[0, at["repeats"]] == pytest.approx(1 / 6) and x[0, at["doubled"]] == pytest.approx(2 / 6)
    assert x[0, at["upper"]] == pytest.approx(1 / 7) and x[0, at["pipes"]] == pytest.approx(1 / 6) and x[0, at["distinct"]] == pytest.approx(5 / 6)
    assert (x[1] == 0).all() and (x[2] == 0).all() and x[3, at["lines"]] == pytest.approx(1 / 3)


def test_column_equals_model_and_awkward_rows(spark, awkward, empty):
    rng = np.random.default_rng(1)
    x = rng.random((600, len(quality.STATISTICS)))
    y = ((x[:, 1] > 0.5) & (x[:, 4] < 0.7)).astype(float)
    model = quality.RuleEnsemble.fit(x, y)
    assert ((model.predict(x) >= 0.5) == y).mean() > 0.97 and 0 < len(model.rules) < 100
    df = spark.createDataFrame([(*map(float, r),) for r in x[:50]], [f"_{s}" for s in quality.STATISTICS])
    assert [r["s"] for r in df.select(model.column().alias("s")).collect()] == pytest.approx(model.predict(x[:50]).tolist())
    assert quality.score(awkward, ["doc_id"], model).count() == awkward.count() and quality.score(empty, ["doc_id"], model).count() == 0
    labels = spark.createDataFrame([(4, 1), (None, 0), (6, None)], "doc_id long, quality int")
    assert quality.train(awkward, labels).rules == [] and quality.train(awkward, labels.limit(0)).intercept == 0.0


@needs_tables
def test_held_out_quality(spark):
    labels = spark.read.parquet(f"{ROOT_TABLES}/labels.parquet")
    got = quality.op2_quality(spark, ROOT_TABLES).join(labels, "doc_id").where("held_out")
    assert got.where("predicted = quality").count() >= 0.85 * got.count()


def test_kept_columns_may_have_any_name(spark):
    from deltagraph.llm import decontamination, ngram_join

    names = ["doc_id", "n", "f1", "keys", "score", "terms", "lang_pred", "n_words", "root", "_letter", "text"]
    docs = spark.createDataFrame([(1, *"abcdefghi", "one two three"), (2, *"abcdefghi", None)], ["doc_id", *names[1:]])
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    items = spark.createDataFrame([(1, "two three")], "item_id long, text string")
    trees = language_id.train(docs.withColumn("lang", F.lit("en")))
    for out in (
        ngram_join.similar_groups(docs, names), license_scan.scan(docs, names), language_id.predict(docs, names, trees),
        quality.score(docs, names, quality.RuleEnsemble()), decontamination.decontaminate(docs, items, names),
    ):
        rows = out.collect()
        assert len(rows) == 2 and len(set(out.columns)) == len(out.columns) and set(names) <= set(out.columns) and {r["f1"] for r in rows} == {"b"}
