"""Benchmark decontamination with a distributed positional inverted index.

The index is a table of segments, each an inverted index over some documents: for every term its posting list, the sorted places at which it
stands.  Documents follow each other in a segment with a gap between them, so one number is document and position.  A segment holds about
PIECE bytes of text, so the postings of a frequent term are spread over the index, and a segment needs no shuffle to be built.  Only terms
that occur in a test item are indexed; no other can take part in a match.  Corpus-wide term counts come from the index itself.

A query phrase is answered from its rarest term: only segments that have all its terms are looked at; there, the posting list of the rarest term, shifted
by its offset, is intersected with the shifted list of the next rarest, and so on.  Candidates are handled in chunks of bounded size.

Test items are handled in blocks of ``BLOCK_WORDS`` words, so what is sent to the executors has a fixed bound; each block reads the index once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltagraph.llm.common import Workspace, carrying, documents, table
from deltagraph.llm.tokens import ALNUM, words

WINDOW = 10
BLOCK_WORDS = 1_000_000
#: Distinct terms of the test items kept as a filter while indexing; with more, all terms are indexed.
MAX_TERMS = 4_000_000
#: Candidates of phrases that are intersected at a time.
CANDIDATES = 1 << 19
POSTINGS = "terms array<long>, counts array<int>, places array<int>"
SPANS = "array<struct<start:long,end:long>>"


def _hash_lists(arr: pa.Array) -> list[np.ndarray]:
    out = []
    for w in words(arr, ALNUM):
        out += [w.hash[w.first[i] : w.first[i + 1]] for i in range(w.hi - w.lo)]
    return out


def _one(values: pa.Array) -> pa.Array:
    """A list column with a single row."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def build_index(docs: DataFrame, text: str, keep: list[str], terms: np.ndarray | None, ws: Workspace) -> DataFrame:
    """Store the index of ``docs``: segment, docs (the ``keep`` columns, base and n_words of each) and POSTINGS.  ``terms`` (sorted hashes) restricts what is indexed."""
    sent = docs.sparkSession.sparkContext.broadcast(terms) if terms is not None else None

    def index(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, number = sent.value if sent is not None else None, TaskContext.get().partitionId() << 33
        for b in batches:
            for w in words(b.column(text), ALNUM):
                n_words = np.diff(w.first)
                base = np.cumsum(n_words + 1) - n_words - 1
                h, place = w.hash, np.arange(len(w.hash)) + np.repeat(np.arange(len(n_words)), n_words)
                if known is not None:
                    at = np.searchsorted(known, h)
                    hit = np.flatnonzero(known[np.minimum(at, len(known) - 1)] == h) if len(known) else np.zeros(0, int)
                    place, h = place[hit], h[hit]
                order = np.argsort(h, kind="stable")
                place, h = place[order].astype(np.int32), h[order]
                new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, int)
                count = np.diff(np.append(new, len(h))).astype(np.int32)
                own = [b.column(c).slice(w.lo, w.hi - w.lo) for c in keep] + [pa.array(base, pa.int32()), pa.array(n_words, pa.int64())]
                lists = [pa.StructArray.from_arrays(own, [*keep, "base", "n_words"]), pa.array(h[new].view(np.int64)), pa.array(count), pa.array(place)]
                yield pa.record_batch([pa.array([number], pa.int64()), *map(_one, lists)], ["segment", "docs", "terms", "counts", "places"])
                number += 1

    kept = "".join(f"`{f.name}`:{f.dataType.simpleString()}," for f in docs.schema if f.name in keep)
    return ws.save(docs.select(*keep, text).mapInArrow(index, f"segment long, docs array<struct<{kept}base:int,n_words:long>>, {POSTINGS}"), "index", rows=1000)


@dataclass
class Phrases:
    """Query phrases as terms in rarest-first order: phrase i has terms[i, k] at offset offset[i, k] (-1: no more)."""

    item: np.ndarray  # index of the item
    length: np.ndarray
    terms: np.ndarray  # indices into vocab
    offset: np.ndarray
    vocab: np.ndarray  # sorted hashes

    @classmethod
    def of(cls, items: list[np.ndarray], counts: dict[int, int] | None, window: int) -> Phrases:
        vocab = np.unique(np.concatenate(items)) if items else np.zeros(0, np.uint64)
        freq = np.array([(counts or {}).get(int(v), 0) for v in vocab.view(np.int64)], np.int64)
        size = np.array([len(h) for h in items], np.int64)
        flat = np.searchsorted(vocab, np.concatenate(items)) if items else np.zeros(0, np.int64)
        length = np.minimum(size, window)
        number = np.where(size > 0, size - length + 1, 0)
        item = np.repeat(np.arange(len(items)), number)
        start = (np.cumsum(size) - size)[item] + np.arange(len(item)) - (np.cumsum(number) - number)[item]
        step = np.arange(window)
        inside = step[None, :] < length[item][:, None]
        terms = np.where(inside, flat[np.minimum(start[:, None] + step, max(0, len(flat) - 1))] if len(flat) else 0, -1)
        order = np.argsort(np.where(inside, freq[terms] if len(freq) else 0, np.iinfo(np.int64).max), axis=1, kind="stable")
        return cls(item, length[item], np.take_along_axis(terms, order, 1), np.where(np.take_along_axis(inside, order, 1), order, -1), vocab)


def _postings(b: pa.RecordBatch, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms, their counts, places, and base and n_words of the documents, of one segment."""
    lists = [b.column(c)[row].values for c in ("terms", "counts", "places")]
    docs = b.column("docs")[row].values
    terms, counts, places, base, n_words = (x.to_numpy(zero_copy_only=False) for x in (*lists, docs.field("base"), docs.field("n_words")))
    return terms.view(np.uint64), counts.astype(np.int64), places.astype(np.int64), base.astype(np.int64), n_words


def phrase_hits(terms: np.ndarray, counts: np.ndarray, places: np.ndarray, q: Phrases) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(start, phrase) of every occurrence of a phrase in a segment, chunk by chunk."""
    if not len(q.vocab) or not len(places):
        return
    at = np.searchsorted(q.vocab, terms)
    at = np.where(q.vocab[np.minimum(at, len(q.vocab) - 1)] == terms, at, -1)
    first, number = np.zeros(len(q.vocab) + 1, np.int64), np.zeros(len(q.vocab) + 1, np.int64)
    first[at], number[at] = np.cumsum(counts) - counts, counts  # the last entry stands for no term
    number[-1] = 1
    here = np.flatnonzero((number[q.terms] > 0).all(1))  # phrases whose terms all occur
    number[-1] = 0
    # all posting lists as one sorted list of (term, place)
    width = np.int64(places.max() + q.terms.shape[1] + 1)
    listed = np.repeat(at, counts) * width + places
    if (at < 0).any():
        listed = np.sort(listed[np.repeat(at, counts) >= 0])
    total = np.cumsum(number[q.terms[here, 0]])
    lo = 0
    while lo < len(here):
        before = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, before + CANDIDATES, "right")))
        part = here[lo:hi]
        n = number[q.terms[part, 0]]
        phrase = np.repeat(part, n)
        within = np.arange(len(phrase)) - np.repeat(np.cumsum(n) - n, n)
        start = places[first[q.terms[phrase, 0]] + within] - q.offset[phrase, 0]
        ok = start >= 0
        start, phrase = start[ok], phrase[ok]
        for k in range(1, q.terms.shape[1]):
            need, more = q.terms[phrase, k], q.offset[phrase, k]
            want = need * width + start + more
            ok = (need < 0) | (listed[np.minimum(np.searchsorted(listed, want), len(listed) - 1)] == want)
            start, phrase = start[ok], phrase[ok]
        yield start, phrase
        lo = hi


def _covered(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Disjoint sorted spans (start, end) that cover the given ones."""
    order = np.argsort(start, kind="stable")
    s, e = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], s[1:] > e[:-1]])
    return np.stack([s[new], e[np.append(np.flatnonzero(new)[1:] - 1, len(s) - 1)]], 1)


def term_counts(index: DataFrame) -> DataFrame:
    """Corpus-wide number of postings of each term."""
    return index.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.counts").alias("n"))


def _item_blocks(items: DataFrame, item_id: str, text: str, most: int) -> Iterator[tuple[list[str], list[np.ndarray]]]:
    """Ids and word hashes of the items, in blocks of bounded size, read one partition at a time."""
    ids, lists, size = [], [], 0
    for r in items.select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t")).toLocalIterator():
        (h,) = _hash_lists(pa.array([r["t"]], pa.string()))
        if len(h):
            if size + len(h) > most and ids:
                yield ids, lists
                ids, lists, size = [], [], 0
            ids.append(r["i"])
            lists.append(h)
            size += len(h)
    if ids:
        yield ids, lists


def _search(index: DataFrame, ids: list[str], q: Phrases, ws: Workspace) -> DataFrame:
    """segment, doc, items, spans of the documents with an occurrence of one of the phrases."""
    sent = ws.spark.sparkContext.broadcast((ids, q))

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = sent.value
        for b in batches:
            for row, segment in enumerate(b.column("segment").to_pylist()):
                terms, counts, places, base, _ = _postings(b, row)
                found = list(phrase_hits(terms, counts, places, q))
                start, phrase = (np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found) if found else ((), ())))
                # many windows of one item hit one document: spans are joined before anything becomes an object
                doc = np.searchsorted(base, start, "right") - 1
                order = np.argsort(doc, kind="stable")
                doc, start, phrase = doc[order], start[order], phrase[order]
                hit, cut = np.unique(doc, return_index=True)
                cut = np.append(cut, len(doc))
                items, spans = [], []
                for i, d in enumerate(hit.tolist()):
                    s, p = start[cut[i] : cut[i + 1]] - base[d], phrase[cut[i] : cut[i + 1]]
                    items.append([ids[j] for j in np.unique(q.item[p])])
                    spans.append([{"start": a, "end": e} for a, e in _covered(s, s + q.length[p]).tolist()])
                yield pa.record_batch([pa.array([segment] * len(hit), pa.int64()), pa.array(hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, _SPAN_LIST)], ["segment", "doc", "items", "spans"])

    wanted = index.select("segment", "docs", "terms", "counts", "places")
    return ws.save(wanted.mapInArrow(search, f"segment long, doc long, items array<string>, spans {SPANS}"), "hits", rows=2)


_SPAN_LIST = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


@carrying
def _decontaminate(docs: DataFrame, keep: list[str], items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The ``keep`` columns of every row of ``docs`` plus n_words, n_hit, items (ids as strings, sorted) and spans (start, end in words).

    A word is hit if it lies in an occurrence of ``window`` consecutive words of an item, or of all of an item that has fewer.
    Null or empty texts have no words; items without words match nothing; items with equal texts are all named; null ids of
    items are left out of the list; without items or documents nothing is hit.  Rows that repeat are judged one by one."""
    spark = docs.sparkSession
    ws = Workspace(spark, "decontamination")
    vocab: np.ndarray | None = np.zeros(0, np.uint64)
    n_blocks = 0
    for _, lists in _item_blocks(items, item_id, item_text, block_words):
        n_blocks += 1
        if vocab is not None:
            vocab = np.unique(np.concatenate([vocab, *lists]))
            vocab = vocab if len(vocab) <= MAX_TERMS else None
    index = build_index(docs, text, keep, vocab, ws)
    counts = ws.save(term_counts(index), "counts") if n_blocks else None
    hits = None
    for ids, lists in _item_blocks(items, item_id, item_text, block_words):
        own = np.unique(np.concatenate(lists)).view(np.int64)
        if n_blocks == 1:
            wanted = counts
        else:  # a block's terms are at most block_words
            wanted = counts.join(F.broadcast(spark.createDataFrame([(int(x),) for x in own], "term long")), "term")
        q = Phrases.of(lists, {r["term"]: r["n"] for r in wanted.toLocalIterator()}, window)
        found = _search(index, ids, q, ws)
        hits = found if hits is None else hits.unionByName(found)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep)
    schema = f"{kept}, n_words long, n_hit long, items array<string>, spans {SPANS}"

    def told(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                own = b.column("docs")[row].values
                n_hit, names, spans = np.zeros(len(own), np.int64), [[]] * len(own), [[]] * len(own)
                by: dict[int, list[dict]] = {}
                for x in b.column("hits")[row].as_py() or []:
                    by.setdefault(x["doc"], []).append(x)
                for d, found in by.items():
                    at = np.array([(s["start"], s["end"]) for x in found for s in x["spans"]], np.int64)
                    cover = _covered(at[:, 0], at[:, 1]).tolist()
                    n_hit[d] = sum(e - s for s, e in cover)
                    names[d] = sorted({i for x in found for i in x["items"] if i is not None})
                    spans[d] = [{"start": s, "end": e} for s, e in cover]
                cols = [own.field(c) for c in [*keep, "n_words"]]
                yield pa.record_batch([*cols, pa.array(n_hit), pa.array(names, pa.list_(pa.string())), pa.array(spans, _SPAN_LIST)], [*keep, "n_words", "n_hit", "items", "spans"])

    lists = f"array<struct<doc:long,items:array<string>,spans:{SPANS}>>"
    plain = index.select("segment", "docs")
    if hits is None:
        joined = plain.withColumn("hits", F.lit(None).cast(lists))
    else:  # a segment's hits are bounded by its words
        joined = plain.join(hits.groupBy("segment").agg(F.collect_list(F.struct("doc", "items", "spans")).alias("hits")), "segment", "left")
    return ws.save(joined.select("docs", "hits").mapInArrow(told, schema), "told", rows=4)


def decontaminate(docs: DataFrame, items: DataFrame, keep: list[str], **how) -> DataFrame:
    """See ``_decontaminate``; ``how``: text, item_id, item_text, window, block_words."""
    return _decontaminate(docs, keep, items, **how)


def proximity(index: DataFrame, keep: list[str], query: str, within: int) -> DataFrame:
    """Documents of an index in which all words of ``query`` lie within ``within`` consecutive words: the ``keep`` columns, start and end of the
    shortest such stretch (the first of equals).  Only the posting lists of the query's words are read in a segment that has them all."""
    (h,) = _hash_lists(pa.array([query]))
    need = np.unique(h)

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                terms, counts, places, base, _ = _postings(b, row)
                rows, start, end = [], [], []
                if len(need) and np.isin(need, terms).all():
                    first = np.cumsum(counts) - counts
                    at = np.searchsorted(terms, need)
                    place = np.concatenate([places[first[j] : first[j] + counts[j]] for j in at])
                    word = np.repeat(np.arange(len(at)), counts[at])
                    order = np.argsort(place, kind="stable")
                    place, word = place[order], word[order]
                    docs_of = np.searchsorted(base, place, "right") - 1
                    cut = np.append(np.unique(docs_of, return_index=True)[1], len(place)).tolist()
                    for lo, hi in zip(cut[:-1], cut[1:]):
                        best, left, have = None, lo, dict.fromkeys(range(len(at)), 0)
                        for i in range(lo, hi):
                            have[int(word[i])] += 1
                            while have[int(word[left])] > 1:
                                have[int(word[left])] -= 1
                                left += 1
                            if all(have.values()) and (best is None or place[i] - place[left] < best[1] - best[0]):
                                best = (int(place[left]), int(place[i]))
                        if best and best[1] - best[0] + 1 <= within:
                            d = int(docs_of[lo])
                            rows.append(d)
                            start.append(best[0] - int(base[d]))
                            end.append(best[1] + 1 - int(base[d]))
                own = b.column("docs")[row].values.take(pa.array(rows, pa.int64()))
                yield pa.record_batch([*[own.field(c) for c in keep], pa.array(start, pa.int64()), pa.array(end, pa.int64())], [*keep, "start", "end"])

    fields = {f.name: f.dataType.simpleString() for f in index.schema["docs"].dataType.elementType}
    kept = ", ".join(f"`{c}` {fields[c]}" for c in keep)
    return index.mapInArrow(search, f"{kept}, start long, end long")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"), ["doc_id"])
    names = F.sha2(F.array_join(F.sort_array("items"), ","), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), names.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
