"""Exact Jaccard self-join of word n-gram sets, with count vectors in R-trees.

A set's shingles are hashed into groups; the group counts are a point.  Points are packed into R-trees (sort-tile-recursive, boxes with lower and upper
corners and the sizes below them), and two trees are joined from their roots down.  The overlap of two sets is at most the sum of the coordinate minima of their points,
and below two boxes at most that of the upper corners; the gaps between two boxes bound the symmetric difference from below.  What no bound
rules out is compared by finer points, with one to four shingles a group, and then verified on the sets themselves.

The directory over the trees makes this distributed without loss.  Sets that link differ in at most r shingles, so if the groups are dealt
into r + 1 + 2e parts, at least 1 + 2e parts have equal counts; a set with v <= 2e empty parts leaves these out and its e - ceil(v / 2) thinnest others, and one
common part remains: of two such sets at most min(v, w) + 2e - ceil(v / 2) - ceil(w / 2) <= 2e equal parts are left out.  An empty part would be a key of a share of
all sets, whose pages all meet; so a set with more of them gives its other parts and is dealt anew, by another hash, as are all that it may lack a key with.  Only
what has too many in all ``DEALS`` keeps some.  The signature of a part's counts is the key of a tree, and only sets under one key are compared; keys with
the same sets are one tree.  r follows the set size, hence size classes; a set also enters the next class where a larger partner may be.

Equal sets are one class before all this.  A tree has pages of bounded size, which are joined pair by pair.  What a page pair gives is linear in its points, whatever
the size of a group of copies:

1. Within pages: few survivors are given as they are; of many, a spanning forest with the best bounds first.  They are verified and linked.
2. Between and within pages of the trees that aren't settled: only pairs of sets that aren't linked yet, again as they are or as a forest over what
   is linked (``ROUNDS`` times; more rounds find few links, see step 3).
3. Trees that still have more pairs than that (sets just below the limit, many times over) are verified in place: the pages carry the sets
   themselves, and give the links of a spanning forest.

Classes and signatures are 64-bit and 128-bit hashes of sets: signatures that collide cost time only; sets are told apart by 128 bits and
compared by the 64-bit hashes of their shingles.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltagraph.llm.common import Workspace, carrying, documents, join_few, small
from deltagraph.llm.components import components
from deltagraph.llm.tokens import SPACED, mix, ngram_hashes, words

#: log2 of the fewest and most coordinates of a tree's point (even numbers), shingles of a coordinate between them.
BITS, MOST_BITS, CROWD = 6, 12, 8
#: Counters behind a part's signature, points of a tree node and of a page, growth of size classes, deals of a set's groups into parts.
COUNTERS, NODE, PAGE, GROWTH, DEALS = 1 << 20, 16, 256, 1.4, 4
#: A page pair with more survivors a point than this gives a forest; rounds of forests; shingles of a page that carries sets.
DENSE, ROUNDS, BODY = 2, 1, 1 << 18
#: Words of the filters that pick the texts of sets to verify, and shared keys (fixed sizes, whatever the input).
FILTER_WORDS, KEY_WORDS = 1 << 17, 1 << 19
#: Parts in which the keys are shuffled, one after the other: the shuffle files of one are on disk at a time.
KEY_TURNS = 4
#: Elements compared at once.
CELLS = 1 << 20

SETS = "n long, f1 long, f2 long, vec binary, fine binary, keys array<long>"


def size_classes(n: int, num: int, den: int) -> list[tuple[int, int]]:
    """(class start, class end) of every class that a set of n shingles enters; a pair belongs to the class of its larger set."""
    out, lo = [], 1
    while lo * num <= n * den:
        hi = max(lo + 1, int(lo * GROWTH))
        if n < hi:
            out.append((lo, hi))
        lo = hi
    return out


def parts_of(end: int, num: int, den: int) -> tuple[int, int]:
    """Number of parts for sets below ``end``, and how many of them a set without empty ones leaves out; (1, 0) if only equal sets can link."""
    most = 2 * (end - 1) * (den - num) // (den + num)  # largest symmetric difference
    if most < 1:
        return 1, 0
    spare = 2 + most * 5 * (den - num) // (8 * den)  # parts are thinner, and more of them empty, where less similar sets link
    return most + 1 + 2 * spare, spare


def set_keys(s: np.ndarray, num: int, den: int) -> np.ndarray:
    """Signatures of a set's parts in all its size classes; s: sorted distinct hashes."""
    out = []
    classes = [(lo, *parts_of(hi, num, den)) for lo, hi in size_classes(len(s), num, den)]
    classes = [c for c in classes if c[1] > 1]
    for deal in range(DEALS):
        if not classes:
            break
        own = np.sort(mix(s + np.uint64(deal))) if deal else s
        value, high, again = mix(own & np.uint64(COUNTERS - 1)), own >> np.uint64(32), []
        for lo, m, spare in classes:
            part = ((high * np.uint64(m)) >> np.uint64(32)).astype(np.int64)  # ascending, as the set is
            count = np.bincount(part, minlength=m)
            total = np.zeros(m, np.uint64)
            used = np.flatnonzero(count)
            total[used] = np.add.reduceat(value, np.searchsorted(part, used))
            empty = m - len(used)
            if empty <= 2 * spare:
                left_out = empty + spare - -(-empty // 2)
            elif deal < DEALS - 1:
                left_out = empty
                again.append((lo, m, spare))
            else:
                left_out = spare
            kept = np.argsort(count, kind="stable")[left_out:]
            seed = mix(np.array([lo], np.uint64) << np.uint64(32) | np.uint64(deal))[0]
            out.append(mix(total[kept] + mix(kept.astype(np.uint64) + seed)))
        classes = again
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


def text_sets(arr: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text: k words each, or the whole sequence as one if there are fewer."""
    for w in words(arr, SPACED):
        for i in range(w.hi - w.lo):
            h = w.hash[w.first[i] : w.first[i + 1]]
            yield np.unique(ngram_hashes(h, min(k, len(h)))) if len(h) else h


def _fingerprints(s: np.ndarray) -> tuple[int, int]:
    a = np.array([s.sum(), np.bitwise_xor.reduce(mix(s)) + np.uint64(len(s))], np.uint64) if len(s) else np.zeros(2, np.uint64)
    f = mix(a + np.uint64(1)).view(np.int64)
    return int(f[0]), int(f[1])


def _matrix(points: list[bytes], groups: int) -> np.ndarray:
    """Points as rows, folded to ``groups`` groups."""
    return np.stack([unpack(p).reshape(groups, -1).sum(1, dtype=np.int32) for p in points])


def pack(p: np.ndarray) -> bytes:
    """A point as bytes, one or two a count; it has 2^even groups, so the length tells which."""
    return p.astype(np.uint8).tobytes() if p.max() < 256 else p.tobytes()


def unpack(b: bytes) -> np.ndarray:
    return np.frombuffer(b, np.uint16 if len(b).bit_length() % 2 == 0 else np.uint8)


def groups_of(b: bytes) -> int:
    return len(b) // (2 - len(b).bit_length() % 2)


def tree_point(s: np.ndarray) -> np.ndarray:
    """The point that the trees hold: about CROWD shingles a group, within limits."""
    bits = int(np.ceil(np.log2(max(1, len(s)) / CROWD)))
    return point(s, min(MOST_BITS, max(BITS, bits + bits % 2)))


def fine_point(s: np.ndarray) -> np.ndarray:
    """One to four shingles a group."""
    bits = max(BITS, int(np.ceil(np.log2(max(1, len(s)) / 4))))
    return point(s, bits + bits % 2)


def point(s: np.ndarray, bits: int) -> np.ndarray:
    """Counts in 2^bits groups, by the leading bits; 65535 everywhere if a count is larger, so that bounds stay bounds."""
    count = np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return count.astype(np.uint16) if count.max() < 65535 else np.full(1 << bits, 65535, np.uint16)


def fine_bound(a: np.ndarray, b: np.ndarray) -> int:
    """Summed coordinate minima; the finer point is folded to the groups of the coarser one."""
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    return int(np.minimum(a.astype(np.int64), b.reshape(len(a), -1).sum(1, dtype=np.int64)).sum())


def needed(na, nb, num: int, den: int):
    """Smallest overlap with which sets of these sizes link."""
    return -(-num * (na + nb) // (num + den))


def overlap(s: np.ndarray, t: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    s, t = (s, t) if len(s) <= len(t) else (t, s)
    return int((t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum()) if len(t) else 0


class RTree:
    """Points packed by sort-tile-recursive.  Level 0 has the points; each further level the boxes of NODE nodes of the one below."""

    def __init__(self, p: np.ndarray, n: np.ndarray):
        self.order = np.argsort(n, kind="stable")
        tiles = -(-len(p) // NODE)
        if tiles > 2:  # slabs by size, each tiled along the coordinates that spread most
            slab = np.arange(len(p)) // (NODE * int(np.ceil(np.sqrt(tiles))))
            widest = np.argsort(-p.var(0), kind="stable")[:6][::-1]
            self.order = self.order[np.lexsort((*p[self.order][:, widest].T, slab))]
        p, n = p[self.order], n[self.order]
        #: (lower corners, upper corners, smallest size, largest size) of each node
        self.levels = [(p, p, n, n)]
        while len(self.levels[-1][0]) > NODE:
            self.grow()

    def grow(self) -> None:
        lo, hi, least, most = self.levels[-1]
        start = np.arange(0, len(lo), NODE)
        self.levels.append((np.minimum.reduceat(lo, start), np.maximum.reduceat(hi, start), np.minimum.reduceat(least, start), np.maximum.reduceat(most, start)))

    def join(self, other: RTree, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs (i, j, bound) of points that may link, each pair once if ``other`` is this tree."""
        while len(other.levels) < len(self.levels):
            other.grow()
        while len(self.levels) < len(other.levels):
            self.grow()
        top, same = len(self.levels) - 1, other is self
        i, j = (x.ravel() for x in np.meshgrid(np.arange(len(self.levels[top][0])), np.arange(len(other.levels[top][0])), indexing="ij"))
        bound = np.zeros(0, np.int64)
        for k in range(top, -1, -1):
            if same:
                first = i <= j if k else i < j
                i, j = i[first], j[first]
            keep, bound = self._meet(self.levels[k], other.levels[k], i, j, num, den)
            i, j, bound = i[keep], j[keep], bound[keep]
            if k:
                step = np.arange(NODE)
                i = np.broadcast_to(i[:, None, None] * NODE + step[:, None], (len(i), NODE, NODE)).ravel()
                j = np.broadcast_to(j[:, None, None] * NODE + step[None, :], (len(j), NODE, NODE)).ravel()
                inside = (i < len(self.levels[k - 1][0])) & (j < len(other.levels[k - 1][0]))
                i, j = i[inside], j[inside]
        return self.order[i], other.order[j], bound

    @staticmethod
    def _meet(a: tuple, b: tuple, i: np.ndarray, j: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
        """Which node pairs (i, j) may have linked sets below, and the bound of their overlap."""
        (alo, ahi, aleast, amost), (blo, bhi, bleast, bmost) = a, b
        keep = (amost[i] * den >= bleast[j] * num) & (bmost[j] * den >= aleast[i] * num)
        bound = np.zeros(len(i), np.int64)
        at = np.flatnonzero(keep)
        step = max(1, CELLS // max(1, alo.shape[1]))
        for lo in range(0, len(at), step):
            c = at[lo : lo + step]
            x, y = i[c], j[c]
            bound[c] = np.minimum(ahi[x], bhi[y]).sum(1)
            fits = bound[c] >= needed(aleast[x], bleast[y], num, den)
            if alo is not ahi:
                gap = np.maximum(np.maximum(alo[x] - bhi[y], blo[y] - ahi[x]), 0).sum(1)
                fits &= gap * (num + den) <= (amost[x] + bmost[y]) * (den - num)
            keep[c] = fits
        return keep, bound


def tree_pairs(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j, bound) of points of two tables that may link."""
    return RTree(a, na).join(RTree(b, nb), num, den)


def _forest(a: np.ndarray, b: np.ndarray, best: np.ndarray, links=None) -> list[int]:
    """Places, in the order ``best``, of the pairs of a spanning forest of the nodes a, b; with ``links`` only of pairs (places) for which it holds."""
    _, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = code[: len(a)].tolist(), code[len(a) :].tolist()
    parent = list(range(int(code.max()) + 1 if len(code) else 0))

    def find(v: int) -> int:
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    out = []
    for k in best.tolist():
        p, q = find(x[k]), find(y[k])
        if p != q and (links is None or links(k)):
            parent[p] = q
            out.append(k)
    return out


def _points(col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes], list]]:
    """node, n, root, points, sets (if there) of each row of a column of member lists."""
    flat, off = col.values, col.offsets.to_numpy(zero_copy_only=False)
    node, n, root = (flat.field(f).to_numpy(zero_copy_only=False) for f in ("node", "n", "root"))
    has = flat.type.get_field_index("body") >= 0
    for lo, hi in zip(off[:-1], off[1:]):
        part = flat.slice(lo, hi - lo)
        yield node[lo:hi], n[lo:hi], root[lo:hi], part.field("vec").to_pylist(), part.field("body") if has else None


def _survivors(num: int, den: int):
    """Pairs (a, b) of sets in different roots that may link, from pages (key, of, one, two; two is null where a page meets itself).

    Few are given as they are; of many a spanning forest of the roots, and ``again`` names the key.  With sets in the pages, the pairs are a forest of links."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            aa, bb, again = [], [], set()
            two, alone = _points(batch.column("two")), batch.column("two").is_null().to_pylist()
            for key, of, own, one, other in zip(batch.column("key").to_pylist(), batch.column("of").to_pylist(), alone, _points(batch.column("one")), two):
                (fm, nm, rm, pm, sm), (fq, nq, rq, pq, sq) = one, one if own else other
                groups = min(map(groups_of, pm if own else pm + pq))
                tree = RTree(_matrix(pm, groups), nm)
                i, j, bound = tree.join(tree if own else RTree(_matrix(pq, groups), nq), num, den)
                apart = rm[i] != rq[j]
                i, j, bound = i[apart], j[apart], bound[apart]
                if not len(i):
                    continue
                most = DENSE * (len(fm) + (0 if own else len(fq))) // of
                if sm is not None or len(i) > most:
                    best = np.argsort(-bound / (nm[i] + nq[j]), kind="stable")
                    links = None
                    if sm is not None:
                        body = lambda s, k: np.frombuffer(s[int(k)].as_py(), np.uint64)
                        links = lambda k, i=i, j=j, nm=nm, nq=nq, sm=sm, sq=sq: overlap(body(sm, i[k]), body(sq, j[k])) >= needed(nm[i[k]], nq[j[k]], num, den)
                    else:
                        again.add(key)
                    some = _forest(rm[i], rq[j], best, links)
                    i, j = i[some], j[some]
                aa.append(fm[i])
                bb.append(fq[j])
            a = np.concatenate(aa) if aa else np.zeros(0, np.int64)
            b = np.concatenate(bb) if bb else np.zeros(0, np.int64)
            a, b = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            n = len(again)
            yield pa.record_batch([
                pa.array([*a.tolist(), *[None] * n], pa.int64()), pa.array([*b.tolist(), *[None] * n], pa.int64()),
                pa.array([None] * len(a) + sorted(again), pa.int64())], ["a", "b", "again"])

    return run


def _candidates(members: DataFrame, num: int, den: int, within: bool, ws: Workspace, name: str) -> tuple[DataFrame, DataFrame]:
    """(pairs, pages): a, b, again for the pages of the members (key, node, n, vec, root[, body]) of each key, and the pages; ``within``: only of pages with themselves.

    What is linked already lies in pages of its own, which needn't meet each other."""
    carried = [c for c in ("node", "n", "vec", "root", "body") if c in members.columns]
    number = lambda c, shingles: F.ceil(F.col(c) / PAGE) if "body" not in carried else F.greatest(F.ceil(F.col(c) / PAGE), F.ceil(F.col(shingles) / BODY))
    rooted = members.groupBy("key", "root").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    size = rooted.groupBy("key").agg(F.sum("c").alias("c"), F.sum("s").alias("s"))
    hot = ws.save(size.select("key", number("c", "s").alias("of")).where("of > 1"), "hot")
    large = ws.save(rooted.select("key", "root", number("c", "s").alias("own")).where("own > 1"), "large")
    of = F.coalesce(F.col("of"), F.lit(1).cast("long"))
    place = F.pmod(F.xxhash64("node"), F.coalesce("own", of))
    dealt = members.join(small(hot, hot.count()), "key", "left").join(small(large, large.count()), ["key", "root"], "left")
    dealt = dealt.withColumn("page", F.when(F.col("own").isNull(), place).otherwise(F.xxhash64("root", place))).withColumn("of", of)
    roots = [F.min("root").alias("lo"), F.max("root").alias("hi")]
    pages = ws.save(dealt.groupBy("key", "page", "of").agg(F.collect_list(F.struct(*carried)).alias("points"), *roots), name)
    schema, run = "a long, b long, again long", _survivors(num, den)
    points = pages.schema["points"].dataType
    own = pages.where("lo <> hi").select("key", "of", F.col("points").alias("one"), F.lit(None).cast(points).alias("two"))
    found = ws.save(own.mapInArrow(run, schema), f"{name}-own", rows=128 if "body" not in carried else 4)
    if not within:
        several = pages.where("of > 1")
        ends = several.select("key", "page", "lo", "hi")
        pairs = ends.join(ends.withColumnsRenamed({"page": "with", "lo": "lo2", "hi": "hi2"}), "key").where("page < with and (lo <> hi or lo2 <> hi2 or lo <> lo2)").select("key", "page", "with")
        left = pairs.join(several.select("key", "page", "of", F.col("points").alias("one")), ["key", "page"]).withColumn("page", F.col("with"))
        both = left.join(several.select("key", "page", F.col("points").alias("two")), ["key", "page"])
        # rows are large where a key has several pages, so few of them make a batch
        found = found.unionByName(ws.save(both.select("key", "of", "one", "two").mapInArrow(run, schema), f"{name}-cross", rows=4))
    return found, pages


class _Sets:
    """Looks up the sets of classes: ``points`` (node, n, f1, f2, vec, fine, doc_key) of the texts of ``docs``."""

    def __init__(self, docs: DataFrame, text: str, points: DataFrame, k: int, ws: Workspace):
        self.docs, self.text, self.points, self.k, self.ws = docs, text, points, k, ws

    def bodies(self, wanted: DataFrame) -> DataFrame:
        """node, body for the classes of ``wanted`` (node): one text of each is found again through a filter of fixed size."""
        ws, text, k = self.ws, self.text, self.k
        chosen = ws.save(self.points.join(wanted, "node", "left_semi").select("node", "f1", "f2", "doc_key"), "chosen")
        bit = F.pmod(F.xxhash64("doc_key"), F.lit(FILTER_WORDS * 64))
        filled = chosen.select(F.floor(bit / 64).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("bigint"), (bit % 64).cast("int")).alias("m")).groupBy("w").agg(F.bit_or("m").alias("m")).collect()
        bits = np.zeros(FILTER_WORDS, np.int64)
        bits[[r["w"] for r in filled]] = [r["m"] for r in filled]
        sent = ws.spark.sparkContext.broadcast(bits)

        def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = sent.value
            for b in batches:
                at = b.column("bit").to_numpy(zero_copy_only=False)
                b = b.filter(pa.array((held[at >> 6] >> (at & 63)) & 1 == 1))
                for lo in range(0, b.num_rows, 256):
                    part = b.slice(lo, 256)
                    f1, f2, body = [], [], []
                    for s in text_sets(part.column("text"), k):
                        p, q = _fingerprints(s)
                        f1.append(p)
                        f2.append(q)
                        body.append(s.tobytes())
                    yield pa.record_batch([pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(body, pa.binary())], ["f1", "f2", "body"])

        source = self.docs.select(F.pmod(F.xxhash64(_doc_key(text)), F.lit(FILTER_WORDS * 64)).alias("bit"), F.col(text).alias("text"))
        built = source.mapInArrow(build, "f1 long, f2 long, body binary").join(chosen.select("node", "f1", "f2"), ["f1", "f2"])
        return ws.save(built.groupBy("node").agg(F.first("body").alias("body")), "bodies")

    def linked(self, pairs: DataFrame, num: int, den: int) -> DataFrame:
        """The pairs (a, b) that link: first by their fine points, then by their sets."""

        def close(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                points = [[unpack(v.as_py()) for v in b.column(c)] for c in ("one", "two")]
                need = needed(*(b.column(c).to_numpy(zero_copy_only=False) for c in ("na", "nb")), num, den)
                keep = [fine_bound(x, y) >= n for x, y, n in zip(*points, need)]
                yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = []
                for x, y in zip(b.column("one"), b.column("two")):
                    s, t = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
                    keep.append(overlap(s, t) >= needed(len(s), len(t), num, den))
                yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        ws, points = self.ws, self.points
        near = pairs.join(points.select(F.col("node").alias("a"), F.col("fine").alias("one"), F.col("n").alias("na")), "a").join(points.select(F.col("node").alias("b"), F.col("fine").alias("two"), F.col("n").alias("nb")), "b")
        pairs = ws.save(near.select("a", "b", "one", "two", "na", "nb").mapInArrow(close, "a long, b long"), "close")
        built = self.bodies(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct())
        joined = pairs.join(built.select(F.col("node").alias("a"), F.col("body").alias("one")), "a").join(built.select(F.col("node").alias("b"), F.col("body").alias("two")), "b")
        out = ws.save(joined.select("a", "b", "one", "two").mapInArrow(check, "a long, b long"), "links", rows=256)
        ws.drop(built)
        return out


def _doc_key(text: str):
    """Any value that finds a set's text again: a hash of the text."""
    return F.xxhash64(F.col(text))


def _trees(full: DataFrame, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """(members, points): key, node, n, vec of the sets of each key that several sets have (keys with the same sets are one), and node, f1, f2, n, vec, fine, doc_key of these sets."""
    keyed = full.select("f1", "f2", F.explode("keys").alias("key"))
    shared = None
    for turn in range(KEY_TURNS):
        some = keyed.where(F.pmod("key", F.lit(KEY_TURNS)) == turn).groupBy("key").agg(F.min("f1").alias("lo"), F.max("f1").alias("hi"))
        some = ws.save(some.where("lo <> hi").select("key"), "shared")
        shared = some if shared is None else shared.unionByName(some)
    one_each = ws.save(join_few(keyed, shared, "key", "left_semi", KEY_WORDS).select("key", "f1", "f2").distinct(), "entries")
    same = [F.count("*").alias("c"), F.min("f1").alias("lo"), F.max("f1").alias("hi"), F.bit_xor(F.xxhash64("f1", "f2")).alias("x"), F.bit_xor(F.xxhash64("f2", "f1")).alias("y")]
    chosen = one_each.groupBy("key").agg(*same).groupBy("c", "lo", "hi", "x", "y").agg(F.min("key").alias("key"))
    entries = ws.save(one_each.join(ws.save(chosen.select("key"), "chosen-keys"), "key", "left_semi"), "tree-entries")
    # only sets of trees need points, the others aren't shuffled
    some = ws.save(entries.select("f1", "f2").distinct(), "tree-sets")
    points = join_few(full.select("f1", "f2", "n", "vec", "fine", "doc_key"), some, ["f1", "f2"], "left_semi", KEY_WORDS)
    points = points.groupBy("f1", "f2").agg(*[F.first(c).alias(c) for c in ("n", "vec", "fine")], F.min("doc_key").alias("doc_key"))
    points = ws.save(points.withColumn("node", F.monotonically_increasing_id()), "points")
    return ws.save(entries.join(points.select("f1", "f2", "node", "n", "vec"), ["f1", "f2"]).select("key", "node", "n", "vec"), "members"), points


def _links(members: DataFrame, sets: _Sets, num: int, den: int, ws: Workspace) -> DataFrame:
    """node, root of the linked classes."""
    found, pages = _candidates(members.withColumn("root", F.col("node")), num, den, True, ws, "pages")
    links = sets.linked(found.where("a is not null").select("a", "b").distinct(), num, den)
    rest = ws.save(found.where("again is not null").select(F.col("again").alias("key")).unionByName(pages.where("of > 1").select("key")).distinct(), "rest")
    ws.drop(pages)
    roots = components(links, ws)
    for turn in range(ROUNDS + 1):
        if rest.isEmpty():
            break
        part = members.join(rest, "key", "left_semi").join(roots.select("node", "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
        part = ws.save(part, "unsettled")
        open_ = part.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
        part = part.join(ws.save(open_, "open"), "key", "left_semi")
        if turn == ROUNDS:
            part = part.join(sets.bodies(part.select("node").distinct()), "node")
        found, pages = _candidates(part, num, den, False, ws, f"round{turn}")
        pairs = found.where("a is not null").select("a", "b").distinct()
        more = pairs if turn == ROUNDS else sets.linked(pairs, num, den)
        links = links.unionByName(more)
        rest = ws.save(found.where("again is not null").select(F.col("again").alias("key")).distinct(), "rest")
        ws.drop(pages)
        roots = components(links, ws)
    return roots


@carrying
def similar_groups(docs: DataFrame, keep: list[str], doc_id: str = "doc_id", text: str = "text", k: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """The ``keep`` columns of every row plus n_shingles and component_id.

    Rows link when den * intersection >= num * union of their sets of k-word shingles (words between white space, A-Z lower-cased; fewer than k words: the whole
    sequence).  Texts without words, or null, have the empty set and link with nothing.  component_id is the smallest doc_id reachable by
    links; null ids never name a component, unless it has no other.  Repeated rows are all returned."""
    # the result reads the tables of ws; those of work go before
    ws, work = (Workspace(docs.sparkSession, name) for name in ("ngrams", "ngrams-work"))
    docs = docs.withColumn("_id", F.col(doc_id).cast("long"))
    own = [*keep, "_id"]
    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in own)

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                n, f1, f2, vec, fine, keys = [], [], [], [], [], []
                for s in text_sets(part.column(text), k):
                    p, q = _fingerprints(s)
                    n.append(len(s))
                    f1.append(p)
                    f2.append(q)
                    vec.append(pack(tree_point(s)))
                    fine.append(pack(fine_point(s)))
                    keys.append(set_keys(s, num, den))
                offsets = np.zeros(len(keys) + 1, np.int32)
                np.cumsum([len(x) for x in keys], out=offsets[1:])
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys)))
                yield pa.record_batch([*[part.column(c) for c in [*own, "doc_key"]], pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(vec, pa.binary()), pa.array(fine, pa.binary()), lists], [*own, "doc_key", "n", "f1", "f2", "vec", "fine", "keys"])

    source = docs.select(*own, _doc_key(text).alias("doc_key"), text)
    sets = work.save(source.mapInArrow(build, f"{kept}, doc_key long, {SETS}"), "sets")
    members, points = _trees(sets.where("n > 0"), work)
    # the keys and points of all sets are the largest table: from here on only the trees' are read
    every = ws.save(sets.select(*own, "n", "f1", "f2"), "rows")
    work.drop(sets)
    roots = _links(members, _Sets(docs, text, points, k, work), num, den, work)
    rooted = work.save(points.select("node", "f1", "f2").join(roots, "node").select("f1", "f2", "root"), "rooted")
    classes = every.where("n > 0").groupBy("f1", "f2").agg(F.min("_id").alias("first"))
    ids = work.save(classes.join(small(rooted, rooted.count()), ["f1", "f2"], "left"), "ids")
    linked = ids.where("root is not null")
    least = work.save(linked.groupBy("root").agg(F.min("first").alias("component")), "least")
    named = linked.join(least, "root").select("f1", "f2", "component").unionByName(ids.where("root is null").select("f1", "f2", F.col("first").alias("component")))
    named = ws.save(named, "named")
    work.clear()
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("_id"))
    return every.join(named, ["f1", "f2"], "left").select(*keep, F.col("n").alias("n_shingles"), component.alias("component_id"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(documents(spark, sf_dir), ["doc_id"])
