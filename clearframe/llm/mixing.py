"""Mixing sources to target weights by the cube method.

A source's target over its size is the rate r at which each of its documents is wanted.  The whole
part of r is taken of every document; the fraction p is sampled.  Sampling is balanced: the vector
of inclusion probabilities moves through the null space of the constraints (documents and words of
the source) until coordinates reach 0 or 1, so both totals keep their expected values exactly while
the flight lasts.  It runs in blocks of a source; what a block leaves undecided (fewer units than
constraints + 1) flies again with the leftovers of other blocks, and the last few units land by a
draw that favours the smallest change of the word total.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, checkpointed, table

#: Weights of the sources in order of their names, repeating.  Fixed by the contract.
WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
BLOCK = 1024
_EPS = 1e-9


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """Adds ``target`` to (source, source_size): shares by weight, capped, the excess shared again.

    Sharing again until none is above its cap ends where every target is min(cap, level * weight)
    for one level.  With the sources in order of cap / weight the capped ones come first, so the
    level follows from running sums; both windows run over one row per source.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    ranked = sources.withColumn("weight", cycle).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    after = order.rowsBetween(0, W.unboundedFollowing)
    whole = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    # the first source in this order that its level does not fill sets the level of all after it
    ranked = ranked.withColumn("own_level", level)
    free = F.when(F.col("own_level") * F.col("weight") <= F.col("cap"), F.col("own_level"))
    ranked = ranked.withColumn("free_level", free)
    ranked = ranked.withColumn("level", F.first("free_level", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    return ranked.select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def cube_flight(p: np.ndarray, sizes: np.ndarray, seed: int = 0) -> np.ndarray:
    """Moves probabilities until at most two stay strictly between 0 and 1.

    Three undecided units always have a direction that changes neither the number nor the words
    taken; the move along it goes as far as the unit cube allows, one way or the other with the
    odds that keep the probabilities' expectation.  ``seed`` fixes the draws.
    """
    p = p.astype(float).copy()
    draw = np.random.default_rng([seed, len(p)])
    waiting = [i for i in range(len(p)) if _EPS < p[i] < 1 - _EPS]
    p[p <= _EPS], p[p >= 1 - _EPS] = 0.0, 1.0
    values, size = p.tolist(), sizes.astype(float).tolist()
    active: list[int] = []
    odds = draw.random(len(waiting) + 8).tolist()
    while True:
        while len(active) < 3 and waiting:
            active.append(waiting.pop())
        if len(active) < 3:
            break
        i, j, k = active
        u = (size[k] - size[j], size[i] - size[k], size[j] - size[i])  # null space of [[1,1,1],[si,sj,sk]]
        if u == (0.0, 0.0, 0.0):
            u = (1.0, -1.0, 0.0)
        up = min(((1 - values[x]) if d > 0 else values[x]) / abs(d) for x, d in zip(active, u) if d)
        down = min((values[x] if d > 0 else (1 - values[x])) / abs(d) for x, d in zip(active, u) if d)
        step = up if odds.pop() * (up + down) < down else -down
        if not odds:
            odds = draw.random(1024).tolist()
        for x, d in zip(active, u):
            values[x] += step * d
        for x in active:
            if values[x] <= _EPS or values[x] >= 1 - _EPS:
                values[x] = float(values[x] > 0.5)
        active = [x for x in active if 0 < values[x] < 1]
    return np.array(values)


def cube_landing(p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Decides the last units: of all roundings, the one whose word total is nearest to the expected."""
    p = p.copy()
    left = np.flatnonzero((p > 0) & (p < 1))
    if len(left):
        picks = (np.arange(1 << len(left))[:, None] >> np.arange(len(left))) & 1
        off = np.abs(picks @ sizes[left] - p[left] @ sizes[left])
        p[left] = picks[int(np.argmin(off))]
    return p


def _fly(last: bool):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["unit", "size"], kind="stable").reset_index(drop=True)
        seed = zlib.crc32(f"{block['source'].iloc[0]}\x00{block['block'].iloc[0]}".encode()) if len(block) else 0
        p = cube_flight(block["p"].to_numpy(), block["size"].to_numpy(), seed)
        if last:
            p = cube_landing(p, block["size"].to_numpy())
        return block.assign(p=p)

    return run


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies.

    * a null text has size 0 and nothing of it is taken; a null source is a source, the last;
    * sources of no words have target 0; if no source has words nothing is taken;
    * repeated rows are separate units; equal ones may be taken unequally often;
    * reruns agree: units are ordered and drawn by hashes of their content, not by task.
    Blocks hold about ``block`` documents of one source, dealt by hash, so that a source with a
    third of all rows is spread over many tasks.
    """
    sized = docs.select(F.col("doc_id"), F.col("source"), word_count("text").alias("size"), F.xxhash64("doc_id", "text").alias("unit"))
    sized = checkpointed(sized)
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    goals = checkpointed(source_targets(sources, weights, most).join(sources.select(F.col("source").alias("s"), "n"), F.col("source").eqNullSafe(F.col("s"))).drop("s"))
    named = goals.select(F.col("source").alias("goal_source"), "source_size", "target", "n")
    rated = sized.join(named, F.col("source").eqNullSafe(F.col("goal_source"))).drop("goal_source")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    rated = rated.withColumn("rate", rate)
    base = F.floor(F.col("rate") + F.lit(_EPS))
    rated = rated.withColumn("base", base).withColumn("p", F.greatest(F.col("rate") - base, F.lit(0.0)))
    blocks = F.greatest(F.ceil(F.col("n") / F.lit(block)), F.lit(1)).cast("long")
    rated = rated.withColumn("block", F.pmod(F.xxhash64("unit", F.lit(17)), blocks))
    kind = "source string, doc_id long, size long, source_size long, target double, base long, p double, unit long, block long"
    columns = [c.split()[0] for c in kind.split(", ")]
    state = checkpointed(rated.select(*columns).groupBy("source", "block").applyInPandas(_fly(False), kind))
    open_ = (F.col("p") > 0) & (F.col("p") < 1)
    done = state.where(~open_)
    left = state.where(open_)
    # each round joins the leftovers of up to block/2 blocks; two or three rounds reach any size
    most_blocks = goals.agg(F.max(F.ceil(F.col("n") / F.lit(block)))).first()[0] or 1
    while most_blocks > 1:
        most_blocks = -(-most_blocks * 2 // block)
        grouped = left.withColumn("block", F.pmod(F.col("block"), F.lit(most_blocks))).groupBy("source", "block").applyInPandas(_fly(False), kind)
        grouped = checkpointed(grouped)
        done = done.unionByName(grouped.where(~open_))
        left = grouped.where(open_)
    landed = left.groupBy("source").applyInPandas(_fly(True), kind)
    copies = (F.col("base") + F.col("p")).cast("long")
    return done.unionByName(landed).select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), "unit")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents themselves, each as often as the mix takes it, with their own columns."""
    counts = mix(docs, **options).where("copies > 0").groupBy("doc_id", "unit").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(row.alias("row"), F.xxhash64("doc_id", "text").alias("key"), F.col("doc_id").alias("id"))
    joined = keyed.join(counts, (F.col("key") == F.col("unit")) & F.col("id").eqNullSafe(F.col("doc_id")))
    # equal rows share their copies: the first ones give one more than the others
    place = F.row_number().over(W.partitionBy("key", "id").orderBy(F.xxhash64("row")))
    each = F.floor(F.col("copies") / F.col("rows")) + (place <= F.col("copies") % F.col("rows")).cast("long")
    taken = joined.withColumn("each", each.cast("int")).where("each > 0")
    return taken.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("each")))).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("unit", "copies")
