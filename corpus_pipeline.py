"""A corpus pipeline of five stages: each takes what the one before kept, and returns documents with the same columns.

1. quality: documents that the rule ensemble rejects go.
2. line_dedup: later copies of repeated line runs are deleted from the texts; documents of which nothing stays go.
3. near_duplicates: of documents that hang together by 5-word shingles at a similarity of 0.8 or more, the one with the smallest doc_id stays (null last).
4. decontamination: documents with a benchmark passage go.
5. mixing: words taken of each document for the target weights of the sources (the last stage: doc_id, source, size, source_size, target, taken).

Every row is judged by its own text, whether its doc_id is null or shared with other rows.  Verdicts come back by a 64-bit hash of id and text, so that texts needn't
travel.  Of rows that repeat with the same id and text, or with null ids and the same text, one stays (in near_duplicates); texts without words are no copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltagraph.llm import decontamination, line_dedup, mixing, ngram_join, quality
from deltagraph.llm.common import Workspace, documents, join_few, split_few, table

#: The later stages' texts: shingles of so many words, similarity in hundredths.
SHINGLE, SIMILAR = 5, 80
KEY = "_row_key"


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a hash of id and text; rows with one hash have the same verdict."""
    return docs.withColumn(KEY, F.xxhash64("doc_id", "text"))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose keys are not in ``gone``."""
    ws = Workspace(docs.sparkSession, "gone")
    return join_few(_keyed(docs), ws.save(gone.select(KEY).distinct(), "keys"), KEY, "left_anti").select(*docs.columns)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    text = _keyed(docs.select("doc_id", "text"))
    model = quality.train(text, quality.learnt_from(table(spark, sf_dir, "labels")))
    return _without(docs, quality.score(text, [KEY], model).where("predicted = 0"))


def delete_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    whole = docs.select("doc_id", "text", F.struct(*[c for c in docs.columns if c != "text"]).alias("_row"))
    done = line_dedup.delete_repeats(whole).where("n_removed = 0 or length(text) > 0")
    changed = {"text": F.col("text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("_row")["n_chars"]) if "n_chars" in docs.columns else None}
    return done.select(*[changed[c].alias(c) if c in changed else F.col("_row")[c].alias(c) for c in docs.columns])


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "groups")
    groups = ngram_join.similar_groups(_keyed(docs.select("doc_id", "text")), ["doc_id", KEY], doc_id=KEY, k=SHINGLE, num=SIMILAR)
    groups = ws.save(groups.where("n_shingles > 0").select("doc_id", KEY, "component_id"), "groups")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", KEY)
    first = groups.groupBy("component_id").agg(F.min(place).alias("first"), F.count("*").alias("c")).where("c > 1")
    left = _without(docs, groups.join(first, "component_id").where(F.col(KEY) != F.col("first")[KEY]))
    # what is left of a group is one document; if its row repeats, the smallest of them stays
    repeated = ws.save(groups.groupBy(KEY).agg(F.count("*").alias("c")).where("c > 1").select(KEY), "repeated")
    if repeated.isEmpty():
        return left
    left = ws.save(left, "left")
    some, rest = split_few(_keyed(left), repeated, KEY)
    several = some.join(repeated.hint("merge"), KEY, "left_semi").groupBy(KEY).agg(F.min(F.struct(*left.columns)).alias("_row"))
    alone = some.join(repeated.hint("merge"), KEY, "left_anti")
    return rest.select(*left.columns).unionByName(alone.select(*left.columns)).unionByName(several.select("_row.*"))


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(_keyed(docs.select("doc_id", "text")), table(spark, sf_dir, "benchmark"), [KEY])
    return _without(docs, found.where("n_hit > 0"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs.select("doc_id", "source", "text")).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("quality", keep_good),
    ("line_dedup", delete_lines),
    ("near_duplicates", keep_one_of_each_group),
    ("decontamination", keep_uncontaminated),
    ("mixing", mix),
]

#: Training and balanced sampling are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, ws = documents(spark, sf_dir), Workspace(spark, "pipeline")
    for name, stage in STAGES:
        docs = ws.save(stage(spark, docs, sf_dir), name, rows=2000)
    return docs
