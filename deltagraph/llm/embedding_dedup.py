"""Near-duplicate vectors by cosine, with an inverted multi-index.

Two independent codebooks, one for each half of the (unit) vectors, span a product grid of cells.  A vector belongs to the cell of
its nearest codewords and visits the cells around it in the order of their distance (the multi-sequence staircase) up to the
radius at which the target recall is reached; that radius is calibrated on pairs drawn from the sample.  Visiting vectors and the
cell's members meet in pages of bounded size, are compared exactly in double precision, and a page pair returns link counts and
a spanning forest of its links, never the links one by one.

Vectors are kept in the precision they come in and compared in double precision.  The codebooks are fitted on a bounded sample (``SAMPLE`` vectors by a hash of their class,
more only where the codebooks, which grow with the root of the number of vectors, need it); every vector is indexed and every vector is a query.
Equal vectors are one class with a multiplicity and a number of its own; ids, which different vectors may share, only name the components.  Members and visitors of a hot cell are split into pages, and each member page is
its own join key.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltagraph.llm.common import Workspace, small, table
from deltagraph.llm.components import components, local_forest

COSINE = 0.9
TARGET = 0.97
#: Vectors that the codebooks are fitted on (expected number, at least; SPREAD for each codeword), vectors of a page.
SAMPLE, SPREAD, PAGE = 20_000, 20, 256


@dataclass
class MultiIndex:
    """Codebooks of the two halves and the squared radius within which cells are visited."""

    books: tuple[np.ndarray, np.ndarray]
    radius: float

    @classmethod
    def fit(cls, x: np.ndarray, codes: int, cosine: float = COSINE, target: float = TARGET) -> MultiIndex:
        """x: unit vectors of the sample.  The radius is the ``target`` quantile over pairs with cosines from ``cosine`` to 1."""
        rng = np.random.default_rng(3)
        half = x.shape[1] // 2
        books = tuple(_kmeans(part, codes, rng) for part in (x[:, :half], x[:, half:]))
        index = cls(books, 0.0)
        c = rng.uniform(cosine, 1.0, len(x))[:, None]
        z = rng.standard_normal(x.shape)
        z -= (z * x).sum(1, keepdims=True) * x
        z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
        y = c * x + np.sqrt(1 - c * c) * z
        rows = np.arange(len(x))
        (dx, dy) = (index.distances(v) for v in (x, y))
        (ax, bx), (ay, by) = ((d.argmin(1) for d in p) for p in (dx, dy))
        need = np.minimum(dx[0][rows, ay] + dx[1][rows, by], dy[0][rows, ax] + dy[1][rows, bx])
        index.radius = float(np.quantile(need, target)) if len(x) else 0.0
        return index

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of the halves of ``x`` to all codewords."""
        half = self.books[0].shape[1]
        out = []
        for v, b in zip((x[:, :half], x[:, half:]), self.books):
            out.append((v * v).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * v @ b.T)
        return out[0], out[1]

    def visits(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Own cell of each vector, and the other cells that it visits, nearest first."""
        d1, d2 = self.distances(x)
        o1, o2 = np.argsort(d1, 1, kind="stable"), np.argsort(d2, 1, kind="stable")
        own = o1[:, 0] * len(self.books[1]) + o2[:, 0]
        others = []
        for i in range(len(x)):
            s1, s2 = d1[i, o1[i]], d2[i, o2[i]]
            # the staircase: with the r-th codeword of half one, a prefix of half two lies within the radius
            depth = np.searchsorted(s2, self.radius - s1, "right")
            first = np.repeat(np.arange(len(s1)), depth)
            second = np.arange(len(first)) - np.repeat(np.cumsum(depth) - depth, depth)
            near = np.argsort(s1[first] + s2[second], kind="stable")
            cells = (o1[i, first] * len(self.books[1]) + o2[i, second])[near]
            others.append(cells[cells != own[i]])
        return own, others


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    k = max(1, min(k, len(x)))
    centre = x[rng.choice(len(x), k, replace=False)] if len(x) else np.zeros((1, x.shape[1]))
    for _ in range(rounds if len(x) else 0):
        near = ((centre * centre).sum(1)[None, :] - 2 * x @ centre.T).argmin(1)
        count = np.bincount(near, minlength=k)
        total = np.stack([np.bincount(near, c, k) for c in x.T], 1)
        centre = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centre)
    return centre


def _matrix(col: pa.Array) -> np.ndarray:
    """Rows of equally long float lists."""
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1).astype(float) if len(col) else np.zeros((0, 0))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.maximum(np.abs(x).max(1, keepdims=True), 1e-300)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


ASSIGNED = "node long, mult long, cell long, visits array<long>, vec "
FOUND = "node long, n long, other long"


def _pages(assigned: DataFrame, key: str, ws: Workspace) -> DataFrame:
    """Pages (cell, page, points) of about PAGE rows each, by the cell in column ``key``."""
    rows = assigned.select(F.col(key).alias("at"), F.struct("node", "mult", "cell", "visits", "vec").alias("p"))
    hot = ws.save(rows.groupBy("at").agg(F.count("*").alias("n")).where(F.col("n") > PAGE), "hot")
    split = F.coalesce(F.ceil(F.col("n") / PAGE), F.lit(1))
    dealt = rows.join(hot, "at", "left").withColumn("page", F.pmod(F.xxhash64("p.node"), split))
    return dealt.groupBy("at", "page", split.alias("of")).agg(F.collect_list("p").alias("points"))


def _compare(cosine: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, number, other = [], [], []
            for row in range(b.num_rows):
                m, q = (b.column(c)[row].values for c in ("members", "visitors"))
                mn, qn, mm, qm = (p.field(f).to_numpy(zero_copy_only=False) for f in ("node", "mult") for p in (m, q))
                hit = _unit(_matrix(q.field("vec"))) @ _unit(_matrix(m.field("vec"))).T >= cosine
                hit &= qn[:, None] != mn[None, :]
                qi, mi = np.nonzero(hit)
                if len(qi):
                    # a pair that also meets the other way round counts where the smaller node visits
                    qc, mc = q.field("cell").to_numpy(zero_copy_only=False)[qi], m.field("cell").to_numpy(zero_copy_only=False)[mi]
                    lists = m.field("visits")
                    owner = np.repeat(np.arange(len(m)), np.diff(lists.offsets.to_numpy(zero_copy_only=False)))
                    visit = lists.flatten().to_numpy(zero_copy_only=False)
                    cells, code = np.unique(np.concatenate([visit, qc]), return_inverse=True)
                    known = np.sort(owner * len(cells) + code[: len(visit)])
                    want = mi * len(cells) + code[len(visit) :]
                    at = np.searchsorted(known, want)
                    back = (qc == mc) | ((known[np.minimum(at, len(known) - 1)] == want) if len(known) else False)
                    keep = ~back | (qn[qi] < mn[mi])
                    qi, mi = qi[keep], mi[keep]
                if len(qi):
                    for ids, n in ((qn, np.bincount(qi, mm[mi], len(qn))), (mn, np.bincount(mi, qm[qi], len(mn)))):
                        has = np.flatnonzero(n)
                        node.append(ids[has])
                        number.append(n[has].astype(np.int64))
                        other.append(ids[has])
                    forest = local_forest(len(qn) + len(mn), qi.tolist(), (mi + len(qn)).tolist())
                    both = np.concatenate([qn, mn])
                    node.append(both[[x for x, _ in forest]])
                    number.append(np.zeros(len(forest), np.int64))
                    other.append(both[[y for _, y in forest]])
            cat = lambda x: pa.array(np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64))
            yield pa.record_batch([cat(node), cat(number), cat(other)], ["node", "n", "other"])

    return run


def _links_of(classes: DataFrame, n: int, ws: Workspace, cosine: float, target: float) -> DataFrame:
    """FOUND rows of classes (node, mult, vec) of one dimension."""
    codes = max(2, round(np.sqrt(n) / 2))  # so that a cell has about four vectors, however many there are
    share = min(1.0, max(SAMPLE, SPREAD * codes) / max(1, n))
    draw = F.shiftrightunsigned(F.xxhash64("node", F.lit(3)), 11) / F.lit(float(2**53))
    sample = classes.where(draw < share).orderBy("node").select("vec").toPandas()["vec"]
    x = _unit(np.stack(sample.to_numpy()).astype(float)) if len(sample) else np.zeros((0, 2))
    sent = ws.spark.sparkContext.broadcast(MultiIndex.fit(x, codes, cosine, target) if len(x) else None)

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for b in batches:
            x = _unit(_matrix(b.column("vec")))
            if index is None or not len(x):
                own, visits = np.zeros(len(x), np.int64), [[] for _ in range(len(x))]
            else:
                own, visits = index.visits(x)
            lists = pa.array(visits, pa.list_(pa.int64()))
            yield pa.record_batch([b.column("node"), b.column("mult"), pa.array(own.astype(np.int64)), lists, b.column("vec")], ["node", "mult", "cell", "visits", "vec"])

    assigned = ws.save(classes.select("node", "mult", "vec").mapInArrow(assign, ASSIGNED + dict(classes.dtypes)["vec"]), "assigned", rows=1000)
    members = ws.save(_pages(assigned, "cell", ws).select("at", "page", "of", F.col("points").alias("members")), "members")
    # visitors need no list of their own visits
    visiting = assigned.select("node", "mult", "cell", F.explode(F.concat(F.array("cell"), "visits")).alias("to"), F.array().cast("array<long>").alias("visits"), "vec")
    occupied = members.select("at", F.col("of")).distinct()
    visitors = _pages(visiting.join(occupied.select(F.col("at").alias("to")), "to", "left_semi"), "to", ws).select("at", F.col("points").alias("visitors"))
    each = visitors.join(occupied, "at").withColumn("page", F.explode(F.sequence(F.lit(0).cast("long"), F.col("of") - 1)))
    pairs = each.select("at", "page", "visitors").join(members.select("at", "page", "members"), ["at", "page"])
    found = ws.save(pairs.select("members", "visitors").mapInArrow(_compare(cosine), FOUND), "found", rows=8)
    return found


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", vec: str = "embedding", cosine: float = COSINE, target: float = TARGET) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors``.

    Null or zero vectors and those with null or non-finite parts link with nothing; vectors of different lengths don't link.
    Rows are vectors of their own, so a repeated row links with its copies.  A component without any id has a null component_id and is kept."""
    ws = Workspace(vectors.sparkSession, "embeddings")
    v = F.col(vec).cast("array<double>")
    fine = F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    valid = v.isNotNull() & ~F.coalesce(fine, F.lit(True)) & F.coalesce(F.exists(v, lambda e: e != 0), F.lit(False))
    rows = ws.save(vectors.select(F.col(vec_id).alias("vec_id"), valid.alias("valid"), F.xxhash64(v).alias("h1"), F.hash(v).alias("h2"), F.col(vec).alias("vec")), "rows")
    classes = rows.where("valid").groupBy("h1", "h2").agg(F.min("vec_id").alias("first"), F.count("*").alias("mult"), F.first("vec").alias("vec"))
    classes = ws.save(classes.select("h1", "h2", "first", "mult", F.monotonically_increasing_id().alias("node"), F.size("vec").alias("dim"), "vec"), "classes")
    found = None
    for r in classes.groupBy("dim").agg(F.count("*").alias("n")).collect():
        part = _links_of(classes.where(F.col("dim") == r["dim"]), r["n"], ws, cosine, target)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    roots = components(found.where("n = 0").select(F.col("node").alias("a"), F.col("other").alias("b")), ws)
    told = classes.join(counts, "node", "left").join(roots, "node", "left").select("h1", "h2", "first", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    told = ws.save(told, "told")
    least = ws.save(told.groupBy("root").agg(F.min("first").alias("component")), "least")
    told = told.join(least, "root").select("h1", "h2", "n_links", "component")
    number = told.count()
    out = rows.drop("vec").join(small(told.withColumn("valid", F.lit(True)), number), ["h1", "h2", "valid"], "left")
    component = F.when(F.col("valid"), F.col("component")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, component.isNull()).alias("kept"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
