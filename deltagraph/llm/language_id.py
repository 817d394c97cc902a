"""Language identification by prediction by partial matching (PPM).

Each language has a variable-order byte context tree, frozen after training.  A byte costs -log2 of its probability under the longest
context that was seen, with escape probabilities of method C and full exclusion, so the costs of a text are exact code lengths; the
language with the shortest code wins.

Frozen statistics allow a table: the longest seen context of up to ORDER bytes is a row, the next byte a column, and the entry the cost
under every language.  A text is then scored by two table look-ups a byte, over its whole length.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltagraph.llm.common import Workspace, carrying, crc_mod, documents
from deltagraph.llm.tokens import PIECE, text_buffer

ORDER = 3
#: Training rows of a language, as expected number; rows are chosen by a hash of their id.
SAMPLE = 1500
UNKNOWN = "und"


def count_grams(rows: DataFrame) -> DataFrame:
    """lang, gram (4 bytes, big-endian), n over all texts of ``rows`` (lang, text).  A text begins after three zero bytes."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            langs = b.column("lang").to_pylist()
            data, off = text_buffer(b.column("text"))
            for lang in set(langs):
                parts = [x for i, l in enumerate(langs) if l == lang for x in (np.zeros(ORDER, np.uint8), data[off[i] : off[i + 1]])]
                t = np.concatenate(parts).astype(np.uint32)
                g = (t[:-3] << 24) | (t[1:-2] << 16) | (t[2:-1] << 8) | t[3:]
                g, n = np.unique(g[(g & 255) != 0], return_counts=True)
                if lang in total:
                    both, back = np.unique(np.concatenate([total[lang][0], g]), return_inverse=True)
                    g, n = both, np.bincount(back, np.concatenate([total[lang][1], n])).astype(np.int64)
                total[lang] = (g, n)
        for lang, (g, n) in total.items():
            yield pa.record_batch([pa.array([lang] * len(g), pa.string()), pa.array(g.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    return rows.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class ContextTrees:
    """Frozen statistics of several languages as one cost table."""

    def __init__(self, grams: dict[str, tuple[np.ndarray, np.ndarray]], order: int = ORDER):
        self.langs = sorted(grams)
        freq = sum(np.bincount((g & 255).astype(int), n, 256) for g, n in grams.values())
        seen = np.flatnonzero(freq[1:] > 0) + 1
        #: every byte of the training texts has a symbol; 0: before the text; 1: a byte that no language has
        self.symbol = np.ones(256, np.uint16)
        self.symbol[0] = 0
        self.symbol[seen] = np.arange(2, len(seen) + 2)
        self.size = size = len(seen) + 2
        self.order = order
        split = {}
        for lang, (g, n) in grams.items():
            b = np.stack([self.symbol[(g >> s) & 255] for s in (24, 16, 8, 0)], 1).astype(np.int64)
            b[b[:, 3] == 0, 3] = 1  # a zero byte inside a text
            split[lang] = (b, n.astype(float))
        # contexts of all languages, longest first
        self.row = np.zeros(size**order, np.int32)
        rows: list[np.ndarray] = [np.zeros((1, 0), np.int64)]
        for k in range(1, order + 1):
            rows.append(np.unique(np.concatenate([b[:, 3 - k : 3] for b, _ in split.values()]), axis=0))
        first = np.cumsum([0, *[len(r) for r in rows]])
        for k in range(1, order + 1):
            code = rows[k] @ (size ** np.arange(k - 1, -1, -1))
            table = np.tile(np.zeros(size**k, np.int32), 1)
            table[code] = np.arange(first[k], first[k + 1])
            # a context of k symbols decides all longer ones that end in it
            whole = np.tile(table, size ** (order - k))
            self.row = np.where(whole > 0, whole, self.row)
        cost = np.empty((first[-1], size, len(self.langs)), np.float32)
        for j, lang in enumerate(self.langs):
            cost[:, :, j] = self._costs(split[lang], rows, size)
        self.cost = np.ascontiguousarray(cost)

    @staticmethod
    def _costs(stats: tuple[np.ndarray, np.ndarray], rows: list[np.ndarray], size: int) -> np.ndarray:
        """Code length of each symbol in each context; a context that the language never saw has the costs of its suffix."""
        b, n = stats
        uniform = np.full(size, 1.0 / (size - 1))
        uniform[0] = 0.0
        out, lower, lower_codes = [], uniform[None, :], None
        for k, ctx in enumerate(rows):
            weigh = size ** np.arange(k - 1, -1, -1) if k else np.zeros(0, np.int64)
            codes = ctx @ weigh if k else np.zeros(1, np.int64)
            at = np.searchsorted(codes, b[:, 3 - k : 3] @ weigh if k else np.zeros(len(b), np.int64))
            count = np.bincount(at * size + b[:, 3], n, len(codes) * size).reshape(len(codes), size)
            below = lower if k == 0 else lower[np.searchsorted(lower_codes, codes % size ** (k - 1))] if k > 1 else np.repeat(lower, len(codes), 0)
            seen = count > 0
            total, kinds = count.sum(1, keepdims=True), seen.sum(1, keepdims=True)
            rest = np.where(seen, 0.0, below).sum(1, keepdims=True)
            escape = np.where(rest > 0, kinds / np.maximum(total + kinds, 1), 0.0)
            escape = np.where(total == 0, 1.0, escape)
            p = np.where(seen, count / np.maximum(total, 1) * (1 - escape), escape * below / np.maximum(rest, 1e-300))
            out.append(p)
            lower, lower_codes = p, codes
        p = np.concatenate(out)
        return -np.log2(np.maximum(p, 1e-30))

    def lengths(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Code length in bits of each text under each language."""
        n, k = len(off) - 1, self.order
        out = np.zeros((n, len(self.langs)))
        lo = 0
        while lo < n:
            hi = min(n, max(lo + 1, int(np.searchsorted(off, off[lo] + PIECE // 2, "right")) - 1))
            s = self.symbol[data[off[lo] : off[hi]]].astype(np.int64)
            rows = off[lo : hi + 1] - off[lo]
            if len(s):
                s[s == 0] = 1
                # each text is preceded by k start symbols
                shift = k * np.arange(1, hi - lo + 1)
                t = np.zeros(len(s) + k * (hi - lo), np.int64)
                at = np.arange(len(s)) + np.repeat(shift, np.diff(rows))
                t[at] = s
                code = np.zeros(len(t), np.int64)
                for i in range(k, 0, -1):
                    code[k:] = code[k:] * self.size + t[k - i : len(t) - i]
                bits = self.cost[self.row[code[at]], s]
                full = np.flatnonzero(np.diff(rows))
                out[lo + full] = np.add.reduceat(bits.astype(np.float64), rows[:-1][full], axis=0)
            lo = hi
        return out


def train(rows: DataFrame, sample: int = SAMPLE, order: int = ORDER) -> ContextTrees | None:
    """Context trees from rows with doc_id, lang, text; about ``sample`` of each language, chosen by a hash of the id."""
    spark = rows.sparkSession
    known = rows.where(F.col("lang").isNotNull() & (F.length("text") > 0))
    number = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not number:
        return None
    share = F.lit(0.0)
    for lang, n in number.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, sample / n))).otherwise(share)
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(7)), 11) / F.lit(float(2**53))
    grams = Workspace(spark, "language").save(count_grams(known.where(draw < share)), "grams").toPandas()
    stats = {lang: (g["gram"].to_numpy(), g["n"].to_numpy()) for lang, g in grams.groupby("lang")}
    return ContextTrees(stats, order) if stats else None


@carrying
def predict(docs: DataFrame, keep: list[str], trees: ContextTrees | None, text: str = "text") -> DataFrame:
    """The ``keep`` columns plus lang_pred, score (posterior of the winner under equal priors) and bits (its code length).

    A null text, or one without a letter, is ``und`` with score 0, as is everything without training rows.  Ties go to
    the first language by name."""
    sent = docs.sparkSession.sparkContext.broadcast(trees)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = sent.value
        for b in batches:
            cols = [b.column(c) for c in keep]
            ok = b.column("_letter").to_numpy(zero_copy_only=False).astype(bool)
            if t is None:
                pred, p, best = [UNKNOWN] * b.num_rows, np.zeros(b.num_rows), np.zeros(b.num_rows)
            else:
                bits = t.lengths(*text_buffer(b.column(text)))
                win = bits.argmin(1)
                best = np.where(ok, bits[np.arange(len(win)), win], 0.0)
                p = np.where(ok, 1 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1), 0.0)
                pred = [t.langs[w] if o else UNKNOWN for w, o in zip(win, ok)]
            yield pa.record_batch([*cols, pa.array(pred, pa.string()), pa.array(p), pa.array(best)], [*keep, "lang_pred", "score", "bits"])

    letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    return docs.select(*dict.fromkeys([*keep, text]), letter.alias("_letter")).mapInArrow(score, f"{kept}, lang_pred string, score double, bits double")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False))
    trees = train(docs.where(crc_mod(F.col("doc_id"), 4) != 2))
    out = predict(docs.select("doc_id", "text"), ["doc_id"], trees)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "bits")
