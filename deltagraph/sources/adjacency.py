"""Adjacency text: "src<TAB>dst dst ...", weighted "src<TAB>dst,w dst,w ...", pair lines, and result files.

Lines without a tab and empty tokens are dropped; a last token needs no trailing blank; lines may have any length Spark's reader can hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _lines(spark: SparkSession, path: str) -> DataFrame:
    cut = F.split("value", "\t", 2)
    return spark.read.text(path).where(F.instr("value", "\t") > 0).select(F.trim(cut[0]).alias("key"), cut[1].alias("rest"))


def _tokens(rest):
    return F.filter(F.split(rest, r"\s+"), lambda x: x != "")


def read_vertices(spark: SparkSession, path: str) -> DataFrame:
    """One row per line with a tab, also those without edges."""
    return _lines(spark, path).select(F.col("key").cast("bigint").alias("id")).where("id is not null")


def read_adjacency(spark: SparkSession, path: str) -> DataFrame:
    return _lines(spark, path).select(F.col("key").cast("bigint").alias("src"), F.explode(F.transform(_tokens(F.col("rest")), lambda t: t.cast("bigint"))).alias("dst"))


def read_weighted(spark: SparkSession, path: str) -> DataFrame:
    each = _lines(spark, path).select(F.col("key").cast("bigint").alias("src"), F.explode(_tokens(F.col("rest"))).alias("t"))
    part = F.split("t", ",", 2)
    return each.select("src", part[0].cast("bigint").alias("dst"), part[1].cast("double").alias("weight"))


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Pair lines "a_b<TAB>n out(a)...<TAB>out(b)...": a, b, i_ab, out_a, out_b."""
    line = _lines(spark, path)
    key, sides = F.split("key", "_"), F.split("rest", "\t", 2)
    left = _tokens(sides[0])
    longs = lambda x: F.transform(x, lambda t: t.cast("bigint"))
    return line.select(
        key[0].cast("bigint").alias("a"), key[1].cast("bigint").alias("b"), left[0].cast("bigint").alias("i_ab"),
        longs(F.slice(left, 2, F.greatest(F.size(left) - 1, F.lit(0)))).alias("out_a"), longs(_tokens(F.coalesce(F.get(sides, F.lit(1)), F.lit("")))).alias("out_b"))


def write_adjacency(edges: DataFrame, path: str, weighted: bool = False, mark: str = "") -> None:
    """``mark`` goes before the list, for readers that expect a tag there."""
    token = F.concat_ws(",", "dst", "weight") if weighted else F.col("dst").cast("string")
    rows = edges.groupBy("src").agg(F.sort_array(F.collect_list(token)).alias("t"))
    rows.select(F.concat(F.col("src").cast("string"), F.lit("\t" + mark), F.array_join("t", " ")).alias("value")).write.text(path)


def write_pairs(pairs: DataFrame, path: str) -> None:
    """Pair lines of a, b, i_ab, out_a, out_b, as ``read_pairs`` takes them."""
    text = lambda c: F.array_join(F.transform(F.col(c), lambda x: x.cast("string")), " ")
    line = F.concat(F.concat_ws("_", "a", "b"), F.lit("\t"), F.concat_ws(" ", F.col("i_ab").cast("string"), text("out_a")), F.lit("\t"), text("out_b"))
    pairs.select(line.alias("value")).write.text(path)


def write_result(state: DataFrame, path: str) -> None:
    """key<TAB>value files."""
    state.select("id", "v").write.option("sep", "\t").csv(path)


def read_result(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id bigint, v double").option("sep", "\t").csv(path)


def result_totals(state: DataFrame) -> DataFrame:
    """Totals of pending changes (f1) and values (f2), and the number of rows."""
    return state.agg(F.sum("delta").alias("f1"), F.sum("v").alias("f2"), F.count("*").alias("n"))
