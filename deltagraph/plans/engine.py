"""The round as one DataFrame plan, and the driver loop around it.

``Adjacency`` holds, for every vertex, its out-edges in chunks of bounded length plus one entry for the vertex itself, dealt by id and
cached.  A round joins the state with it, explodes, and groups by destination: the vertex's own entry carries its folded value, the
others carry messages.  State is referenced once, so rounds chain linearly in one plan; the only exchange of a round is the one that
groups messages, combined map-side.  A hub's chunks are rows that an adaptive skew join can split."""

from __future__ import annotations

import contextlib
import math
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deltagraph.plans.kernel import Kernel, Message
from deltagraph.plans.schedule import threshold
from deltagraph.plans.terminate import Diff, TermChecker

#: Out-edges of one adjacency row.
CHUNK = 1024
#: Edges and vertices of one partition, at which a graph gets fewer partitions than the session's shuffles have.
ROWS = 500_000
#: So many hubs are sent to all tasks; more are joined by a shuffle.
FEW = 500_000
#: Rounds after which a run of a sum kernel without a limit of its own is given up.
LIMIT = 1000


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir).  Only a local session without one gets a temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="deltagraph-")
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def truncate(df: DataFrame, folder: str) -> DataFrame:
    """Cut the lineage with a table in the shared folder."""
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete a truncated table that nothing reads any more."""
    if path := getattr(df, "_path", None):
        p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def packed(edges: DataFrame, *keys: str) -> DataFrame:
    """One row for each combination of ``keys``: its edges as arrays dst and weight.  Two arrays, as kernels without weights then read one only."""
    rows = edges.groupBy(*keys).agg(F.collect_list(F.struct("dst", "weight")).alias("e"))
    return rows.select(*keys, F.col("e.dst").alias("dst"), F.col("e.weight").alias("weight"))


def parts_for(spark: SparkSession, rows: int) -> int:
    """Partitions for a graph of so many edges and vertices: every core has some, and none is nearly empty, for the blocks of a round's shuffle are their square."""
    return min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(spark.sparkContext.defaultParallelism, math.ceil(rows / ROWS)))


@contextlib.contextmanager
def shuffles_of(spark: SparkSession, parts: int) -> Iterator[None]:
    """Shuffles planned within have ``parts`` partitions."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@dataclass
class Adjacency:
    """id, dst and weight (arrays of equal length), degree (0: the vertex's own entry, whose dst is its id) and the vertices' data columns."""

    rows: DataFrame
    data: list[str]
    parts: int

    @classmethod
    def build(cls, vertices: DataFrame, edges: DataFrame, data: list[str] | None = None, chunk: int = CHUNK, cache: bool = True) -> Adjacency:
        """``vertices``: id and data columns; ``edges``: src, dst and optionally weight."""
        data = data or []
        weight = F.col("weight").cast("double") if "weight" in edges.columns else F.lit(1.0)
        # only hubs are cut into parts, any other vertex has all its edges in one row, which tells its degree.  The hubs are few (one for each ``chunk``
        # edges at most) and known before the edges are dealt, so that edges aren't shuffled to find theirs
        degree = edges.groupBy("src").agg(F.count("*").alias("degree")).where(F.col("degree") > chunk)
        hubs = truncate(degree.withColumn("chunks", F.ceil(F.col("degree") / chunk)), f"{shared_dir(edges.sparkSession)}/hubs")
        if hubs.count() <= FEW:
            hubs = F.broadcast(hubs)
        part = F.coalesce(F.pmod(F.xxhash64("dst"), F.col("chunks")), F.lit(0))
        out = edges.join(hubs, "src", "left").select(F.col("src").alias("id"), part.alias("part"), "degree", "dst", weight.alias("weight"))
        own = vertices.select("id", F.lit(-1).cast("long").alias("part"), F.lit(0).cast("long").alias("degree"), F.col("id").alias("dst"), F.lit(1.0).alias("weight"))
        n = parts_for(vertices.sparkSession, edges.count() + vertices.count())
        # each edge is shuffled once; all that follows keeps to the partitions
        rows = packed(own.unionByName(out).repartition(n, "id"), "id", "part", "degree").drop("part")
        rows = rows.withColumn("degree", F.coalesce(F.col("degree"), F.size("dst").cast("long")))
        if data:
            rows = rows.join(vertices.select("id", *data), "id")
        # in order of the ids, so that no round sorts it again
        rows = rows.sortWithinPartitions("id")
        return cls(rows.cache() if cache else rows, data, n)

    def release(self) -> None:
        self.rows.unpersist()


def initial_state(vertices: DataFrame, kernel: Kernel) -> DataFrame:
    """id, v, delta before the first round."""
    col = lambda c: F.col(c)
    return vertices.select("id", kernel.init_v(col).cast(kernel.kind).alias("v"), kernel.init_delta(col).cast(kernel.kind).alias("delta"))


#: A trigger: the change to put in place of ``update`` when it is delivered to vertex ``key`` with value ``current``.
Trigger = Callable[[Column, Column, Column], Column]


def one_round(state: DataFrame, adj: Adjacency, kernel: Kernel, chosen: Column | None = None, strict: bool = False, trigger: Trigger | None = None) -> DataFrame:
    """The state after one round.  Rows outside ``chosen`` keep value and delta.  Messages to unknown vertices are dropped; with
    ``strict`` they make the job fail.  A column ``updates``, if there, counts how often a vertex was processed."""
    joined = state.join(adj.rows, "id")
    counted = ["updates"] if "updates" in state.columns else []
    pending = kernel.is_pending(F.col("delta"))
    active = pending if chosen is None else pending & chosen
    delta = kernel.process(F.col("delta"), F.col) if kernel.process else F.col("delta")
    live = joined.select(
        "id", "dst", "weight", "degree", *adj.data, "v", F.col("delta").alias("kept"), active.alias("active"),
        F.when(active, delta).otherwise(kernel.identity()).alias("d"), *[(F.col(c) + active.cast("long")).alias(c) for c in counted])
    live = live.withColumn("sends", F.col("active") & kernel.changes(F.col("v"), F.col("d")))
    live = live.withColumn("v", F.when(F.col("active"), kernel.accumulate.fold(F.col("v"), F.col("d"))).otherwise(F.col("v")))
    # edges of vertices that don't send are not even unpacked, so a round costs what its frontier costs
    wanted = F.when(F.col("sends") | (F.col("degree") == 0), F.col("dst"))
    each = live.select("id", "weight", "degree", *adj.data, "v", "kept", "active", "d", *counted, F.posexplode(wanted).alias("at", "to"))
    own = F.col("degree") == 0
    sent = kernel.emit(Message(F.col("d"), F.col("v"), F.get("weight", F.col("at")), F.col("degree"), F.col)).cast(kernel.kind)
    moved = each.select(
        F.col("to").alias("id"),
        F.when(own, F.col("v")).alias("v"),
        F.when(own, F.when(F.col("active"), kernel.identity()).otherwise(F.col("kept"))).otherwise(sent).alias("delta"),
        own.alias("own"),
        *[F.when(own, F.col(c)).alias(c) for c in counted],
    )
    out = moved.groupBy("id").agg(F.max("v").alias("v"), kernel.accumulate.over("delta").alias("delta"), F.max("own").alias("own"), *[F.max(c).alias(c) for c in counted])
    if trigger:
        fired = F.col("own") & kernel.is_pending(F.col("delta"))
        out = out.withColumn("delta", F.when(fired, trigger(F.col("id"), F.col("v"), F.col("delta")).cast(kernel.kind)).otherwise(F.col("delta")))
    if strict:
        known = F.when(~F.col("own"), F.raise_error(F.lit("a message has no vertex"))).otherwise(F.lit(True))
        return out.where(known).select("id", "v", "delta", *counted)
    return out.where("own").select("id", "v", "delta", *counted)


def messages(state: DataFrame, edges: DataFrame, kernel: Kernel) -> DataFrame:
    """dst, d: what the pending changes of ``state`` (id, v, delta) send along ``edges`` (src, dst[, weight]), before they are accumulated."""
    delta = kernel.process(F.col("delta"), F.col) if kernel.process else F.col("delta")
    live = state.where(kernel.is_pending(F.col("delta"))).withColumn("d", delta).where(kernel.changes(F.col("v"), F.col("d")))
    live = live.withColumn("v", kernel.accumulate.fold(F.col("v"), F.col("d")))
    out = edges.withColumn("weight", F.col("weight").cast("double") if "weight" in edges.columns else F.lit(1.0))
    degree = edges.groupBy("src").agg(F.count("*").alias("degree"))
    joined = live.join(degree.withColumnRenamed("src", "id"), "id").join(out.withColumnRenamed("src", "id"), "id")
    return joined.select("dst", kernel.emit(Message(F.col("d"), F.col("v"), F.col("weight"), F.col("degree"), F.col)).cast(kernel.kind).alias("d"))


def rounds(state: DataFrame, adj: Adjacency, kernel: Kernel, k: int) -> DataFrame:
    """k rounds as a single lazy plan."""
    for _ in range(k):
        state = one_round(state, adj, kernel)
    return state


@dataclass
class Options:
    """max_rounds (None: run to the end; a sum kernel that isn't done after LIMIT rounds raises an error); checker (when to stop, None: never
    before the work is done); portion of rows to schedule; rounds between checks; ``trigger``: sees and may replace each change that is
    delivered; ``on_round``: called with (round, state) after each check, e.g. to write epochs.

    Idempotent kernels (min, max) end when nothing is pending: checkers for sums aren't asked there."""

    max_rounds: int | None = None
    checker: TermChecker | None = field(default_factory=Diff)
    portion: float = 1.0
    exact: bool = True
    check_every: int = 1
    strict: bool = False
    on_round: Callable[[int, DataFrame], None] | None = None
    trigger: Trigger | None = None


@dataclass
class Result:
    state: DataFrame
    progress: list[dict]
    converged: bool

    def progress_frame(self) -> DataFrame:
        kind = "round int, current double, residual double, active long, updates long, elapsed double"
        return self.state.sparkSession.createDataFrame([tuple(p[c] for c in ("round", "current", "residual", "active", "updates", "elapsed")) for p in self.progress], kind)


def measure(state: DataFrame, kernel: Kernel, estimate: Callable[[], Column] | None = None) -> DataFrame:
    """current (sum of values, or ``estimate``: an aggregate over the state), residual (sum of pending changes), active rows, updates so far: one
    row, aggregated in parallel."""
    pending = kernel.is_pending(F.col("delta"))
    current = estimate() if estimate else F.sum(F.col("v").cast("double"))
    return state.agg(
        F.coalesce(current.cast("double"), F.lit(0.0)).alias("current"),
        F.coalesce(F.sum("updates"), F.lit(0)).alias("updates") if "updates" in state.columns else F.lit(0).cast("long").alias("updates"),
        F.coalesce(F.sum(F.when(pending, F.abs(F.col("delta").cast("double")))), F.lit(0.0)).alias("residual"),
        F.count(F.when(pending, 1)).alias("active"),
    )


def run(state: DataFrame, adj: Adjacency, kernel: Kernel, options: Options | None = None, start: int = 0) -> Result:
    """Rounds until nothing is pending, the checker is satisfied or max_rounds is reached (then ``converged`` is False).  Each is done when this
    returns, with as many partitions as the adjacency has."""
    with shuffles_of(state.sparkSession, adj.parts):
        return _run(state, adj, kernel, options, start)


def _run(state: DataFrame, adj: Adjacency, kernel: Kernel, options: Options | None, start: int) -> Result:
    o = options or Options()
    spark = state.sparkSession
    folder = f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"
    checker = None if kernel.accumulate.idempotent and getattr(o.checker, "sums_only", False) else o.checker
    limit = o.max_rounds if o.max_rounds is not None else math.inf if kernel.accumulate.idempotent else start + LIMIT
    if "updates" not in state.columns:
        state = state.withColumn("updates", F.lit(0).cast("long"))
    if checker:
        checker.reset()
    log, began, k, done = [], time.time(), start, False
    if o.portion < 1:
        state = truncate(state, folder)
    while not done and k < limit:
        before = [state]
        for _ in range(min(o.check_every, limit - k)):
            chosen = threshold(state, kernel, o.portion, o.exact) if o.portion < 1 else None
            state = one_round(state, adj, kernel, chosen, o.strict, o.trigger)
            if o.portion < 1:
                before.append(state := truncate(state, folder))
            k += 1
        if o.portion >= 1:
            state = truncate(state, folder)
        row = measure(state, kernel, getattr(checker, "estimate", None)).first()
        log.append({"round": k, "current": row["current"], "residual": row["residual"], "active": row["active"], "updates": row["updates"], "elapsed": time.time() - began})
        if o.on_round:
            o.on_round(k, state)
        for old in before:
            if old is not state:
                forget(old)
        done = row["active"] == 0 or bool(checker and checker.terminate(row["current"], row["residual"]))
    if not done and o.max_rounds is None:
        raise RuntimeError(f"{kernel.name} isn't done after {LIMIT} rounds; give max_rounds, or a checker that it can satisfy")
    return Result(state.drop("updates"), log, done)
