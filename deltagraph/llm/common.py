"""Shared plumbing: staged tables in the cluster's shared folder, and joins of checked size."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if its counted rows stay below this.
BROADCAST_ROWS = 100_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(col):
    """Lower-case A-Z only, whatever the locale."""
    return F.translate(col, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster shares (spark.checkpoint.dir).

    Only a local session without that setting (tests) gets a temporary folder, which is set there."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="deltagraph-")
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


#: With it, a query's shuffle files go when it ends; else they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Batches of at most ``rows`` rows for the Python workers of the jobs run inside: for rows of many kilobytes."""
    with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows)):
        yield


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """The setting for the jobs run inside."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


class Workspace:
    """Tables of one operator run, written under the shared folder, so that lost executors lose
    nothing and the lineage is cut.  ``drop`` deletes a table that no later plan reads, ``clear`` all of them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def save(self, df: DataFrame, name: str, rows: int = 2000) -> DataFrame:
        path = self.path(name)
        with arrow_rows(self.spark, rows), setting(self.spark, CLEANUP, "true"):
            # zstd streams through small buffers; the default codec holds direct memory of the size of its largest page
            df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._staged_path = path
        return out

    def drop(self, *dfs: DataFrame) -> None:
        for df in dfs:
            if (path := getattr(df, "_staged_path", None)) is not None:
                self.remove(path)

    def clear(self) -> None:
        self.remove(self.root)

    def remove(self, path: str) -> None:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def small(df: DataFrame, rows: int, bound: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` if its counted ``rows`` are within ``bound``; otherwise leave the join to a shuffle."""
    return F.broadcast(df) if rows <= bound else df


#: Words of 64 bits in the filter of join_few (two bits a key): its table never has more rows than this, whatever the input.
FILTER_WORDS = 1 << 17


def split_few(df: DataFrame, right: DataFrame, key: str | list[str], words: int = FILTER_WORDS) -> tuple[DataFrame, DataFrame]:
    """The rows of ``df`` that a bit filter of fixed size over the columns ``key`` of ``right`` lets through (all with such a key and a few others), and the rest."""
    hashed = lambda: F.xxhash64(*([key] if isinstance(key, str) else key))
    word = F.pmod(hashed(), F.lit(words)).alias("_word")
    one = lambda shift: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.shiftrightunsigned(hashed(), shift), F.lit(64)).cast("int"))
    mask = one(32).bitwiseOR(one(48))
    bits = right.select(word, mask.alias("_mask")).groupBy("_word").agg(F.bit_or("_mask").alias("_bits"))
    names = df.columns
    marked = df.withColumn("_word", F.pmod(hashed(), F.lit(words))).join(F.broadcast(bits), "_word", "left")
    hit = F.coalesce(F.col("_bits").bitwiseAND(mask) == mask, F.lit(False))
    return marked.where(hit).select(*names), marked.where(~hit).select(*names)


def join_few(df: DataFrame, right: DataFrame, key: str | list[str], how: str = "left", words: int = FILTER_WORDS) -> DataFrame:
    """``df`` joined ("left", "left_semi" or "left_anti") on the columns ``key`` with a table that concerns few of its rows.

    A bit filter of fixed size over the keys of ``right`` is broadcast; rows that it rules out are passed on as they are, so only the others are
    shuffled.  ``df`` is read twice and should be a plain scan.  If the filter fills up, more rows are shuffled and the result is the same."""
    some, rest = split_few(df, right, key, words)
    some = some.join(right.hint("merge"), key, how)
    if how == "left_semi":
        return some
    if how == "left":
        extra = [f for f in right.schema if f.name not in ([key] if isinstance(key, str) else key)]
        rest = rest.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in extra])
    return rest.unionByName(some)


def carrying(f):
    """For operators f(docs, keep, ...): the kept columns travel under names of their own, so that they may be called anything.

    A kept column with the name of a result column gives way to the result."""

    @wraps(f)
    def run(docs: DataFrame, keep: list[str], *args, **named) -> DataFrame:
        keep = list(dict.fromkeys(keep))
        inner = [f"_kept{i}" for i in range(len(keep))]
        used = [c for c in (named.get("text", "text"), named.get("doc_id", "doc_id")) if c in docs.columns]
        out = f(docs.select(*[F.col(c).alias(k) for c, k in zip(keep, inner)], *used), inner, *args, **named)
        made = [c for c in out.columns if c not in inner]
        return out.select(*[F.col(k).alias(c) for c, k in zip(keep, inner) if c not in made], *made)

    return run


def crc_mod(doc_id, m: int):
    """crc32 of the id as text, modulo m; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % m


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
