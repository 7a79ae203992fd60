"""Checkpoints and the fixed-point loop that the graph operators share."""

from __future__ import annotations

import gc
import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JError
from pyspark import SparkContext
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from . import local

#: Edges that leave one node are dealt in shares of about so many.
FAN = 50_000
#: Percent of the driver's heap that may stay free after it was trimmed.
SPARE = 40
_FREE = "MaxHeapFreeRatio"
_RULES = "spark.sql.optimizer.excludedRules"
#: Tables of known rows that are kept apart before later ones are merged into one.
MERGE = 3


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session for some statements."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def checkpointed(df: DataFrame, share: int = 2) -> DataFrame:
    """Writes the rows to the folder all executors share and forgets how they were made.

    Afterwards the driver's memory is trimmed if its heap has grown past half its limit (or another
    share of it): plans of many joins leave much garbage, and a heap that once grew keeps its memory.
    That folder is ``spark.checkpoint.dir``.  Where it is unset a temporary folder serves a session
    on one machine; a cluster, whose executors would not share it, gets an error.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not context.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = os.path.join(tempfile.gettempdir(), "checkpoints")
        context.setCheckpointDir(folder)
    # new attributes on top, and no constraints: the optimizer cannot carry either through a union
    # of checkpoints
    with setting(df.sparkSession, "spark.sql.constraintPropagation.enabled", "false"):
        out = df.select(*[F.col(f"`{c}`").alias(c) for c in df.columns]).checkpoint(eager=True)
    trim(df.sparkSession, share)
    return out


def trim(spark: SparkSession, share: int) -> None:
    heap = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    if heap.totalMemory() > heap.maxMemory() // share:
        release(spark)


def release(spark: SparkSession) -> None:
    """Lets Spark delete shuffle and checkpoint files that nothing refers to any more; trims the driver's memory.

    Its cleaner follows the driver's garbage collection, which may not come for half an hour.  What
    the collection frees goes back to the system down to ``SPARE`` percent of the heap, and so does
    native memory that the C library kept; other virtual machines than HotSpot only collect.
    """
    gc.collect()
    context = spark.sparkContext
    jvm = context._jvm
    before = None
    try:
        before = _managed(context, "HotSpotDiagnostic", "getVMOption", _FREE).get("value")
        _managed(context, "HotSpotDiagnostic", "setVMOption", _FREE, str(min(int(before), SPARE)))
    except (Py4JError, StopIteration):
        pass
    jvm.System.gc()
    try:
        if before is not None:
            _managed(context, "HotSpotDiagnostic", "setVMOption", _FREE, before)
        _managed(context, "DiagnosticCommand", "systemTrimNativeHeap")
    except (Py4JError, StopIteration):
        pass


def _managed(context: SparkContext, bean: str, name: str, *args: str):
    """Calls an operation of a management bean of the driver (through its interface: the class itself is hidden)."""
    java, new = context._jvm.java.lang, context._gateway.new_array
    values, kinds, call = new(java.Object, len(args)), new(java.String, len(args)), new(java.Object, 4)
    for i, arg in enumerate(args):
        values[i], kinds[i] = arg, "java.lang.String"
    call[0], call[1], call[2], call[3] = context._jvm.javax.management.ObjectName(f"com.sun.management:type={bean}"), name, values, kinds
    invoke = next(m for m in java.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    return invoke.invoke(java.management.ManagementFactory.getPlatformMBeanServer(), call)


@contextmanager
def dealt(spark: SparkSession) -> Iterator[int]:
    """Within it a checkpoint keeps its hash partitioning.

    Adaptive plans give theirs up, and so does a plan whose last aliases the optimizer removed: its
    partitioning then names attributes that the checkpoint does not have.
    """
    rules = ",".join(filter(None, [spark.conf.get(_RULES, None), "org.apache.spark.sql.catalyst.optimizer.RemoveRedundantAliases"]))
    with setting(spark, "spark.sql.adaptive.enabled", "false"), setting(spark, _RULES, rules):
        yield int(spark.conf.get("spark.sql.shuffle.partitions"))


def fixed_point(seeds: DataFrame, edges: DataFrame, keys: list[str], limit: int = 100_000) -> DataFrame:
    """(``keys``, node, mask, born): least masks that hold the seeds' bits and those of all sources.

    ``seeds`` has the keys, node and mask, a set of bits; ``edges`` has src, dst and any of the key
    columns, which restrict an edge to them.  ``born`` is the round that first gave a row, which is
    the length of the shortest path from a seed.

    Where edges and seeds are few by count, one task does all rounds (``local``).  Beyond that the
    loop is semi-naive: a round moves only the bits found in the round before.  Edges and known rows lie
    hash-partitioned by node for the whole loop, so a round has one exchange, of new rows that were
    combined before it, and writes only what is new.  Where some node has more than ``FAN`` edges
    these are dealt in shares, and new rows pass a second exchange to reach them all.  The driver
    learns one number a round; rounds are as many as the longest shortest path.
    """
    on = [c for c in keys if c in edges.columns]
    at = [*keys, "node"]
    spark = seeds.sparkSession
    n_links, links = counted(edges.select(*on, F.col("src").alias("node"), "dst").distinct())
    n_seeds, seeds = counted(seeds.select(*at, "mask").groupBy(*at).agg(F.bit_or("mask").alias("mask")))
    if n_links + n_seeds <= local.ROWS:
        out = _in_one_task(seeds, links, on, keys)
        if out is not None:
            return out
    with dealt(spark) as n:
        links = checkpointed(links.repartition(n, *on, "node"), share=4)
    wide = links.groupBy(*on, "node").agg(F.ceil(F.count("*") / F.lit(float(FAN))).cast("int").alias("shares")).where("shares > 1")
    first = seeds.select(*at, "mask")
    hot = not wide.isEmpty()
    extra, source = (["shares"], [*on, "node", "share"]) if hot else ([], [*on, "node"])
    if hot:
        wide = checkpointed(wide)
        several = lambda df, end: df.join(
            wide.select(*[F.col(c).alias(f"hot_{c}") for c in on], F.col("node").alias("hot_node"), F.col("shares").alias("hot_shares")),
            [*[F.col(c) == F.col(f"hot_{c}") for c in on], F.col(end) == F.col("hot_node")], "left",
        ).withColumn(f"{end}_shares", F.coalesce("hot_shares", F.lit(1))).drop("hot_node", "hot_shares", *[f"hot_{c}" for c in on])
        links = several(several(links, "node"), "dst").withColumn("share", F.pmod(F.xxhash64("dst"), F.col("node_shares")).cast("int"))
        first = several(first, "node")
    first = first.groupBy(*at).agg(F.bit_or("mask").alias("mask"), *([F.max("node_shares").alias("shares")] if hot else []))
    with dealt(spark) as n:
        if hot:
            links = checkpointed(links.select(*source, "dst", "dst_shares").repartition(n, *source))
        new = checkpointed(first.withColumn("born", F.lit(0)).repartition(n, *on, "node"))
        known, sizes = [new], [n_seeds]
        widest = [F.max("shares").alias("shares")] if hot else []
        for turn in range(1, limit):
            moving = new
            if hot:
                moving = new.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).repartition(n, *source)
            came = moving.select(*at, "mask", *(["share"] if hot else [])).join(links, source)
            came = came.groupBy(*keys, F.col("dst").alias("node")).agg(F.bit_or("mask").alias("mask"), *([F.max("dst_shares").alias("shares")] if hot else []))
            # one exchange by node serves the grouping, the known rows and the next join
            rows = came.repartition(n, *on, "node").select(*at, F.lit(0).cast("long").alias("had"), "mask", *extra)
            for part in known:
                rows = rows.union(part.select(*at, F.col("mask").alias("had"), F.lit(0).cast("long"), *extra))
            fresh = F.bit_or("mask").bitwiseAND(F.bitwise_not(F.bit_or("had")))
            seen = Observation()
            new = rows.groupBy(*at).agg(fresh.alias("mask"), *widest, F.lit(turn).alias("born")).where("mask <> 0")
            new = checkpointed(new.observe(seen, F.count(F.lit(1)).alias("n")))
            if not seen.get["n"]:
                return _together(known, at, widest).drop("shares")
            known.append(new)
            sizes.append(seen.get["n"])
            if len(known) > MERGE:
                # small later parts become one; the first is written again only once they have grown to half of it
                first = 1 if 2 * sum(sizes[1:]) < sizes[0] else 0
                known = [*known[:first], checkpointed(_together(known[first:], at, widest))]
                sizes = [*sizes[:first], sum(sizes[first:])]
    raise RuntimeError("the closure did not end")


def _together(parts: list[DataFrame], at: list[str], widest: list) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy(*at).agg(F.bit_or("mask").alias("mask"), *widest, F.min("born").alias("born"))


def counted(df: DataFrame) -> tuple[int, DataFrame]:
    """A checkpoint and its number of rows, in one job."""
    seen = Observation()
    kept = checkpointed(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return seen.get["n"], kept


def _in_one_task(seeds: DataFrame, links: DataFrame, on: list[str], keys: list[str]) -> DataFrame | None:
    rest = [c for c in keys if c not in on]
    kinds = dict(seeds.dtypes)
    typed = lambda c: F.lit(None).cast(kinds[c]).alias(c)
    rows = links.select(F.lit(False).alias("is_seed"), *on, *[typed(c) for c in rest], "node", "dst", F.lit(0).cast("long").alias("mask")).union(
        seeds.select(F.lit(True), *on, *rest, "node", F.lit(None).cast(kinds["node"]), F.col("mask").cast("long"))
    )
    columns = [*on, *rest, "node", "mask", "born"]
    out = rows.select(*on, *rest, "node", F.lit(0).cast("long").alias("mask"), F.lit(0).alias("born"))
    solve = local.solver(on, rest, to_arrow_schema(out.schema), local.MOST)
    seen = Observation()
    out = rows.repartition(1).mapInArrow(solve, ", ".join(f"`{c}` {t}" for c, t in out.dtypes)).observe(seen, F.count_if(F.col("born") < 0).alias("over"))
    out = checkpointed(out)
    return None if seen.get["over"] else out.select(*columns)


def closure(seeds: DataFrame, edges: DataFrame, keys: list[str], born: bool = False) -> DataFrame:
    """Smallest set of (``keys``, node) that holds the seeds and is closed under the edges."""
    one = seeds.select(*keys, "node", F.lit(1).cast("long").alias("mask"))
    return fixed_point(one, edges, keys).select(*keys, "node", *(["born"] if born else []))
