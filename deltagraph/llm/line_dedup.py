"""Deletion of repeated line runs, by a suffix array over line ids.

The corpus is one sequence of line ids, documents apart.  Distributed prefix doubling gives every place its rank among all suffixes
by their first 1, 2, 4, ... lines: the rank by 2k lines is the order of the pair (rank by k lines here, rank by k lines k places on).  Places of
equal rank are an LCP interval; an interval of a single place is dropped, so the work shrinks to what still repeats.

A line is deleted if it lies in a run of consecutive lines with at least MIN_WORDS words that also starts earlier in the corpus (by
doc_id, null last, then by place).  Every such run is the union of its shortest sufficient runs: those that start at one of its
lines and those that end at one, merged to maximal ones before any line is listed.  Two runs of n lines are equal if both their first and their last 2^j lines have equal rank, with 2^j the largest power
of two within n, so each run is found by two look-ups in one level.

Ranks are order-preserving numbers of the distinct pairs, aggregated map-side and range-sorted; a line of any frequency is one row
there.  Lines are compared by 128-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deltagraph.llm.common import Workspace, documents, join_few, split_few
from deltagraph.llm.tokens import SPACED, words

#: A run of lines counts as a repeated passage if it has at least so many words.
MIN_WORDS = 50
PLACES = "d1 long, d2 long, id long, pos int, r1 long, r2 long, ahead int, back int"


def _line_ends(buf: np.ndarray, s: int, e: int, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own = breaks[np.searchsorted(breaks, s) : np.searchsorted(breaks, e)]
    return np.concatenate([[s], own + 1]), np.concatenate([own, [e]])


def _places(min_words: int):
    """Every line with the length of the shortest sufficient run that starts (ahead) or ends (back) at it; 0: none."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d1, d2, ids = (b.column(c).to_pylist() for c in ("d1", "d2", "id"))
            for w in words(b.column("text"), SPACED, hashes=False):
                raw, breaks = memoryview(np.ascontiguousarray(w.buf)), np.flatnonzero(w.buf == 10)
                valid = b.column("text").slice(w.lo, w.hi - w.lo).is_valid().to_pylist()
                cols: list[list] = [[], [], [], [], [], []]
                digests: list[bytes] = []
                for i in range(w.hi - w.lo):
                    if not valid[i]:
                        continue
                    begin, end = _line_ends(w.buf, int(w.offsets[i]), int(w.offsets[i + 1]), breaks)
                    n = len(begin)
                    cum = np.searchsorted(w.start, np.append(begin, end[-1])) - np.searchsorted(w.start, begin[0])
                    cum[1:] = np.maximum.accumulate(cum[1:])
                    to = np.searchsorted(cum, cum[:-1] + min_words)  # first place with enough words since the line's start
                    since = np.searchsorted(cum, cum[1:] - min_words, "right") - 1
                    row = np.arange(n)
                    for c, x in enumerate((d1, d2, ids)):
                        cols[c] += [x[w.lo + i]] * n
                    cols[3].append(row)
                    cols[4].append(np.where(to <= n, to - row, 0))
                    cols[5].append(np.where(since >= 0, row + 1 - since, 0))
                    digests += [xxhash.xxh3_128_digest(raw[x:y]) for x, y in zip(begin.tolist(), end.tolist())]
                if digests:
                    h = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                    cat = lambda x: pa.array(np.concatenate(x).astype(np.int32))
                    yield pa.record_batch([*[pa.array(x, pa.int64()) for x in cols[:3]], cat(cols[3]), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), cat(cols[4]), cat(cols[5])], ["d1", "d2", "id", "pos", "r1", "r2", "ahead", "back"])

    return run


def _ranked(pairs: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """Order-preserving ranks of the pairs (r1, r2) that stand at two places or more."""
    seen = pairs.groupBy("r1", "r2").agg(F.count("*").alias("n")).where("n > 1")
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = seen.repartitionByRange(parts, "r1", "r2").sortWithinPartitions("r1", "r2")
    return ws.save(ordered.select("r1", "r2", F.monotonically_increasing_id().alias("rank")), name)


#: A document is known by 128 bits of its id and text.
DOC = ["d1", "d2"]


def _later_copies(runs: DataFrame, level: DataFrame, span: int, ws: Workspace) -> DataFrame:
    """d1, d2, start, n of the runs (d1, d2, id, start, n; span <= n < 2 span) that also start earlier."""
    head = level.select(*DOC, F.col("pos").alias("start"), F.col("rank").alias("ra"))
    tail = level.select(*DOC, F.col("pos").alias("at"), F.col("rank").alias("rb"))
    place = F.struct(F.col("id").isNull().alias("none"), "id", *DOC, "start")
    named = runs.withColumn("at", F.col("start") + F.col("n") - span).join(head, [*DOC, "start"]).join(tail, [*DOC, "at"]).select(*DOC, "start", "n", "ra", "rb", place.alias("place"))
    # stored, so that the join back has an exchange on either side and a hot run can be split
    first = ws.save(named.groupBy("n", "ra", "rb").agg(F.min("place").alias("first"), F.count("*").alias("c")).where("c > 1").drop("c"), f"first{span}")
    return named.join(first, ["n", "ra", "rb"]).where(F.col("first") < F.col("place")).select(*DOC, "start", "n")


def _one_of_each(docs: DataFrame, ws: Workspace) -> DataFrame:
    """One row for each document; only rows that may repeat are shuffled, reduced map-side."""
    repeated = ws.save(docs.groupBy(*DOC).agg(F.count("*").alias("c")).where("c > 1").select(*DOC), "repeated")
    if repeated.isEmpty():
        return docs
    some, rest = split_few(docs, repeated, DOC)
    return rest.unionByName(some.dropDuplicates(DOC))


def later_copies(docs: DataFrame, ws: Workspace, min_words: int = MIN_WORDS) -> DataFrame:
    """d1, d2, start, n: line runs to delete, for docs with d1, d2, id, text.  Rows with equal d1, d2 are one document, so that no place stands twice in the joins."""
    docs = _one_of_each(docs.select(*DOC, "id", "text"), ws)
    places = ws.save(docs.mapInArrow(_places(min_words), PLACES), "places", rows=500)
    named = _ranked(places, ws, "rank1")
    level1 = ws.save(places.join(named, ["r1", "r2"]).select(*DOC, "id", "pos", "rank", "ahead", "back"), "level1")
    ws.drop(places, named)
    runs = level1.where("ahead > 0").select(*DOC, "id", F.col("pos").alias("start"), F.col("ahead").alias("n"))
    runs = runs.unionByName(level1.where("back > 0").select(*DOC, "id", (F.col("pos") + 1 - F.col("back")).alias("start"), F.col("back").alias("n")))
    longest = runs.agg(F.max("n").alias("n")).first()["n"] or 0
    found, level, span = None, level1.select(*DOC, "pos", "rank"), 1
    while span <= longest:
        own = _later_copies(runs.where((F.col("n") >= span) & (F.col("n") < 2 * span)), level, span, ws)
        own = ws.save(own, f"copies{span}")
        found = own if found is None else found.unionByName(own)
        if 2 * span > longest:
            break
        ahead = level.select(*DOC, (F.col("pos") - span).alias("pos"), F.col("rank").alias("r2"))
        pairs = ws.save(level.withColumnRenamed("rank", "r1").join(ahead, [*DOC, "pos"]), f"pairs{2 * span}")
        level = ws.save(pairs.join(_ranked(pairs, ws, f"rank{2 * span}"), ["r1", "r2"]).select(*DOC, "pos", "rank"), f"level{2 * span}")
        ws.drop(pairs)
        if level.isEmpty():
            break
        span *= 2
    return found if found is not None else runs.select(*DOC, "start", "n").where("false")


def maximal_runs(copies: DataFrame) -> DataFrame:
    """d1, d2, start, end: what each run adds to those that start before it, so that overlapping runs make up maximal ones and every line stands once."""
    earlier = Window.partitionBy(*DOC).orderBy("start", "n").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("n")
    start = F.greatest(F.col("start"), F.coalesce(F.max(end).over(earlier), F.lit(0)))
    return copies.select(*DOC, start.alias("start"), end.alias("end")).where("start < end")


def delete_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """All rows and columns of ``docs``, with the later copies of repeated line runs deleted from the text, plus n_lines and n_removed.

    Lines end at line feeds and are compared byte by byte; a text without one is a single line, a null text has none and stays null.  A text whose lines all
    go becomes empty.  Rows that repeat with the same id and text are one document and are treated alike.  Columns may have any name; one called
    n_lines or n_removed gives way to the result; an empty table gives an empty one."""
    ws = Workspace(docs.sparkSession, "lines")
    id_, body = F.col(doc_id), F.col(text)
    # the columns travel under names of their own
    others = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    keyed = docs.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(others)], id_.cast("long").alias("id"), body.alias("text"), F.xxhash64(id_, body).alias("d1"), F.xxhash64(F.lit(1), body, id_).alias("d2"))
    copies = later_copies(keyed, ws, min_words)
    places = maximal_runs(copies).select(*DOC, F.explode(F.sequence("start", F.col("end") - 1)).alias("pos"))
    gone = ws.save(places.groupBy(*DOC).agg(F.collect_list("pos").alias("gone")), "gone")
    # a one-element array binds the split text to a variable, so that it is split once
    bound = F.array(F.struct(F.split("text", "\n", -1).alias("l"), F.col("gone").alias("g")))
    rest = F.transform(bound, lambda x: F.transform(F.array_except(F.sequence(F.lit(0), F.size(x["l"]) - 1), x["g"]), lambda i: F.get(x["l"], i)))
    new = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.get(rest, F.lit(0)), "\n"))
    lines = F.coalesce(F.regexp_count("text", F.lit("\n")) + 1, F.lit(0)).cast("long")
    removed = F.coalesce(F.array_size("gone"), F.lit(0)).cast("long")
    names = [(new if c == text else F.col(f"_c{i}")).alias(c) for i, c in enumerate(others)]
    return join_few(keyed, gone, DOC).select(*names, lines.alias("n_lines"), removed.alias("n_removed"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delete_repeats(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")


ORACLE = rf"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (
  SELECT doc_id, pos, ls[pos] AS line, len(regexp_extract_all(ls[pos], '[^\x20\x09-\x0D]+')) AS w
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS pos FROM d)),
c AS (SELECT *, CAST(sum(w) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS cum FROM l),
runs AS (
  SELECT s.doc_id, s.pos AS a, min(e.pos) AS b FROM c s JOIN c e ON e.doc_id = s.doc_id AND e.pos >= s.pos AND e.cum - s.cum + s.w >= {MIN_WORDS} GROUP BY ALL
  UNION
  SELECT e.doc_id, max(s.pos) AS a, e.pos AS b FROM c s JOIN c e ON e.doc_id = s.doc_id AND e.pos >= s.pos AND e.cum - s.cum + s.w >= {MIN_WORDS} GROUP BY e.doc_id, e.pos),
t AS (SELECT r.doc_id, a, b, array_to_string(ls[a:b], chr(10)) AS content, b - a AS n FROM runs r JOIN d USING (doc_id)),
o AS (SELECT doc_id, a, b, row_number() OVER (PARTITION BY content, n ORDER BY doc_id, a) AS k FROM t),
gone AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS pos FROM o WHERE k > 1),
kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed, string_agg(line, chr(10) ORDER BY l.pos) FILTER (g.pos IS NULL) AS text
  FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text
FROM d LEFT JOIN kept k USING (doc_id)
"""
