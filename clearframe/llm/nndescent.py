"""Approximate nearest neighbours: NN-descent builds the graph, greedy search answers queries.

The graph starts from cells of random hyperplanes, within which neighbours are exact, and from cells
of nodes dealt by hash, so that a node alone in its cell of every tree has edges too.  It improves by
joining neighbours of neighbours: each node's neighbours and reverse neighbours are compared
with each other wherever one of the two is new, and an edge replaces a worse one.  Large
neighbourhoods are joined in slices, dealt anew each round; there a member counts as new for as many
rounds as there are slices, so that it meets most of the others, though not surely all.  Queries walk the
graph greedily, always expanding the nodes of the pool not yet expanded, until none is left.
Distances in the build and the walk use vectors rounded to 8 bits; the result is scored exactly.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed, mix64, table
from .covertree import finite, folded

TOP = 20
EVERY = 20
#: Neighbours of a node in the graph, nodes a walk keeps, and rounds of the build.
NEIGHBOURS, POOL = 36, 192
ROUNDS = 8
#: The build stops when a round changes fewer edges than this share.
ENOUGH = 0.005
#: Hyperplane trees that start the graph, and the nodes a cell holds.
TREES, CELL = 3, 256
#: Nodes in a bucket of local joins, and the members of one local join.
BUCKET, JOIN = 512, 64
#: Queries in a bucket of a walk: each brings some thousands of candidates at once.
ASKED = 48
SEED = 7


def _planes(dim: int, depth: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((TREES * depth, dim))


def _decode(column) -> np.ndarray:
    """Rows of (float32 scale, int8 components) as float32."""
    raw = column.to_pylist()
    if not raw:
        return np.zeros((0, 1), np.float32)
    data = np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1)
    return data[:, 4:].copy().view(np.int8).astype(np.float32) * data[:, :4].copy().view("<f4")


def _encoded(depth_of: dict[int, int], dealt_of: dict[int, int]):
    """(node, q, cells): the 8-bit vector, the cell of each tree and last a cell by hash of the node."""

    def run(batches):
        for batch in batches:
            q, cells = [], []
            names = mix64(batch.column("node").to_numpy().astype(np.uint64) + np.uint64(SEED))
            for v, name in zip(batch.column("v"), names):
                x = np.asarray(v.as_py(), np.float64)
                scale = np.float32(max(np.abs(x).max(), 1e-30) / 127)
                q.append(scale.tobytes() + np.clip(np.rint(x / scale), -127, 127).astype(np.int8).tobytes())
                depth = depth_of[len(x)]
                bits = (_planes(len(x), depth) @ x > 0).reshape(TREES, depth)
                own = [int(b) for b in bits @ (1 << np.arange(depth))] if depth else [0] * TREES
                cells.append([*own, int(name % np.uint64(dealt_of[len(x)]))])
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(q, pa.binary()), pa.array(cells, pa.list_(pa.int64()))], ["node", "q", "cells"])

    return run


_EDGE = "a long, b long, s float"


def _edges(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], keep: int) -> pa.Table:
    """The best ``keep`` distinct edges (a, b, s) of each a."""
    a, b, s = (np.concatenate(x) if found else np.zeros(0) for x in (zip(*found) if found else ((), (), ())))
    if len(a):
        order = np.lexsort((b, -s, a))
        a, b, s = a[order], b[order], s[order]
        same = np.zeros(len(a), bool)
        same[1:] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
        a, b, s = a[~same], b[~same], s[~same]
        starts = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
        rank = np.arange(len(a)) - np.repeat(starts, np.diff(np.append(starts, len(a))))
        a, b, s = a[rank < keep], b[rank < keep], s[rank < keep]
    return pa.table({"a": pa.array(a.astype(np.int64)), "b": pa.array(b.astype(np.int64)), "s": pa.array(s.astype(np.float32))})


def _cell_edges(group: pa.Table) -> pa.Table:
    x, node = _decode(group["q"]), group["node"].to_numpy()
    found = []
    for i in range(0, len(node), 512):
        s = x[i : i + 512] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        k = min(NEIGHBOURS, len(node) - 1)
        if k > 0:
            top = np.argpartition(-s, k - 1, axis=1)[:, :k]
            found.append((np.repeat(node[i : i + 512], k), node[top].ravel(), np.take_along_axis(s, top, 1).ravel()))
    return _edges(found, NEIGHBOURS)


def _local_join(group: pa.Table) -> pa.Table:
    """Pairs of members of one node's neighbourhood that improve the list of either of them."""
    group = group.sort_by([("center", "ascending"), ("slice", "ascending")])
    x, member, fresh, worst = _decode(group["q"]), group["member"].to_numpy(), group["fresh"].to_numpy(zero_copy_only=False), group["worst"].to_numpy()
    center, part = group["center"].to_numpy(), group["slice"].to_numpy()
    cut = np.flatnonzero(np.append(True, (center[1:] != center[:-1]) | (part[1:] != part[:-1]))) if len(center) else np.zeros(0, int)
    found = []
    for i, j in zip(cut, np.append(cut[1:], len(center))):
        if not fresh[i:j].any():
            continue
        s = x[i:j] @ x[i:j].T
        good = (fresh[i:j, None] | fresh[None, i:j]) & (s > worst[i:j, None])
        np.fill_diagonal(good, False)
        r, c = np.nonzero(good)
        found.append((member[i:j][r], member[i:j][c], s[r, c]))
    return _edges(found, NEIGHBOURS)


def _best(edges: DataFrame, keep: int) -> DataFrame:
    """The best edges of each node; of two equal ones the older stays."""
    one = edges.groupBy("a", "b").agg(F.max("s").alias("s"), F.min("born").alias("born"))
    return one.withColumn("r", F.row_number().over(W.partitionBy("a").orderBy(F.desc("s"), "b"))).where(F.col("r") <= keep).drop("r")


def build(vectors: DataFrame, neighbours: int = NEIGHBOURS, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(nodes, graph) for (node, v): nodes with 8-bit vectors, edges (a, b, s).

    Vectors of different lengths are never neighbours.  Cells and neighbourhoods of any size are
    cut into slices by hash; every member is in some slice.
    """
    dims = {r["dim"]: r["n"] for r in vectors.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).collect()}
    depths = {d: max(0, math.ceil(math.log2(max(1, n / CELL)))) for d, n in dims.items()}
    dealt = {d: max(1, n // CELL) for d, n in dims.items()}
    nodes = vectors.select("node", "v").mapInArrow(_encoded(depths, dealt), "node long, q binary, cells array<long>").withColumn("dim", F.length("q"))
    nodes = checkpointed(nodes)
    celled = nodes.select("node", "q", "dim", F.posexplode("cells").alias("tree", "cell"))
    slices = celled.groupBy("dim", "tree", "cell").agg(F.ceil(F.count("*") / F.lit(4.0 * CELL)).alias("parts")).withColumnsRenamed({"dim": "d", "tree": "t", "cell": "c"})
    at = (F.col("dim") == F.col("d")) & (F.col("tree") == F.col("t")) & (F.col("cell") == F.col("c"))
    celled = celled.join(slices, at).withColumn("slice", F.pmod(F.xxhash64("node", "tree"), F.col("parts")))
    edges = celled.select("node", "q", "dim", "tree", "cell", "slice").groupBy("dim", "tree", "cell", "slice").applyInArrow(_cell_edges, _EDGE)
    graph = checkpointed(_best(edges.withColumn("born", F.lit(0)), neighbours))
    n = sum(dims.values())
    buckets = max(1, -(-n // BUCKET))
    worst = lambda g: g.groupBy("a").agg(F.min("s").alias("w"), F.count("*").alias("k"))
    for last in range(rounds):
        both = graph.select(F.col("a").alias("center"), F.col("b").alias("member"), "born").union(graph.select(F.col("b"), F.col("a"), "born"))
        both = both.groupBy("center", "member").agg((F.lit(last) - F.max("born")).alias("age"))
        size = both.groupBy("center").agg(F.ceil(F.count("*") / F.lit(float(JOIN))).alias("parts"), F.min("age").alias("least")).where("least < parts").select(F.col("center").alias("of"), "parts")
        limits = worst(graph).select(F.col("a").alias("node"), F.when(F.col("k") >= neighbours, F.col("w")).otherwise(F.lit(-3.0e38)).cast("float").alias("worst"))
        known = nodes.select("node", "q").join(limits, "node", "left").withColumn("worst", F.coalesce("worst", F.lit(-3.0e38).cast("float")))
        joined = both.join(size, F.col("center") == F.col("of")).join(known, F.col("member") == F.col("node"))
        joined = joined.select("center", F.pmod(F.xxhash64("member", F.lit(last)), F.col("parts")).alias("slice"), "member", (F.col("age") < F.col("parts")).alias("fresh"), "worst", "q", F.pmod(F.xxhash64("center"), F.lit(buckets)).alias("bucket"))
        new = joined.groupBy("bucket").applyInArrow(_local_join, _EDGE)
        graph = checkpointed(_best(graph.select("a", "b", "s", "born").union(new.withColumn("born", F.lit(last + 1))), neighbours))
        if graph.where(F.col("born") > last).count() < ENOUGH * neighbours * n:
            break
    return nodes, graph.select("a", "b", "s")


def _walk_scores(left: pa.Table, right: pa.Table) -> pa.Table:
    """Scores of the candidates of each query in a bucket."""
    x, q = _decode(left["q"]), _decode(right["q"])
    ask, name = left["ask"].to_numpy(), right["node"].to_numpy()
    order = np.argsort(name)
    row = order[np.searchsorted(name, ask, sorter=order)] if len(ask) else np.zeros(0, int)
    s = np.einsum("ij,ij->i", x, q[row]) if len(ask) else np.zeros(0)
    return pa.table({"ask": left["ask"], "node": left["node"], "s": pa.array(s.astype(np.float32))})


def search(nodes: DataFrame, graph: DataFrame, asked: DataFrame, pool: int = POOL) -> DataFrame:
    """(ask, node): the pool that the walks of the query nodes end with, the query node included.

    Queries are nodes of the graph (column ``ask``) and start at themselves.  A walk ends when every
    node of its pool is expanded; each step expands all that are not, and the pool only gets better.
    """
    m = asked.count()
    buckets = max(1, -(-m // ASKED))
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(buckets))
    links = graph.select(F.col("a").alias("from"), F.col("b").alias("node"))
    own = asked.join(nodes.select("node", "q"), F.col("ask") == F.col("node")).select("node", "q", bucket("ask").alias("bucket"))
    own = checkpointed(own)
    big = F.lit(3.0e38).cast("float")
    state = checkpointed(asked.select("ask", F.col("ask").alias("node"), big.alias("s"), F.lit(False).alias("done")))
    while not state.where("not done").isEmpty():
        front = state.where("not done").select("ask", F.col("node").alias("at"))
        reached = front.join(links, F.col("at") == F.col("from")).select("ask", "node").distinct()
        fresh = reached.join(state.select("ask", "node"), ["ask", "node"], "left_anti")
        fresh = fresh.join(nodes.select("node", "q"), "node").select("ask", "node", "q", bucket("ask").alias("bucket"))
        fresh = fresh.toDF(*fresh.columns)
        scored = fresh.groupBy("bucket").cogroup(own.groupBy("bucket")).applyInArrow(_walk_scores, "ask long, node long, s float")
        everything = state.withColumn("done", F.lit(True)).union(scored.withColumn("done", F.lit(False)))
        rank = F.row_number().over(W.partitionBy("ask").orderBy(F.desc("s"), "node"))
        state = checkpointed(everything.withColumn("r", rank).where(F.col("r") <= pool + 1).drop("r"))
    return state.select("ask", "node")


def nearest(embeddings: DataFrame, is_query: Column, k: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score): of each query the k nearest found, by exact inner product.

    Null vectors and those that are zero, or hold null or non-finite components, take no part.
    Equal vectors share a node, which stands for all their ids; ties go to the smaller vec_id; a
    query is not its own candidate.
    """
    good = finite(embeddings).where(F.exists("embedding", lambda c: c != 0)).select("vec_id", F.col("embedding").alias("v"))
    marked = good.withColumn("is_query", is_query)
    distinct = checkpointed(folded(marked.select("vec_id", "v"), k + 1))
    nodes, graph = build(distinct.select("node", "v"))
    key = lambda v: F.xxhash64(F.array_join(F.transform(v, lambda x: x.cast("string")), ","))
    owner = distinct.select("node", F.col("v").alias("node_v"), key("v").alias("node_key"))
    asked = marked.where("is_query").select(F.col("vec_id").alias("query_id"), "v", key("v").alias("key"))
    asked = checkpointed(asked.join(owner, (F.col("key") == F.col("node_key")) & (F.col("v") == F.col("node_v"))).select("query_id", F.col("node").alias("ask")))
    found = search(nodes, graph, asked.select("ask").distinct())
    left = distinct.select(F.col("node").alias("ask"), F.col("v").alias("qv"))
    right = distinct.select("node", "v", "ids")
    product = F.aggregate(F.zip_with("qv", "v", lambda a, b: a * b), F.lit(0.0), lambda x, y: x + y)
    scored = found.join(right, "node").join(left, "ask").select("ask", product.alias("score"), "ids")
    flat = F.flatten(F.transform("hits", lambda h: F.transform(h["ids"], lambda i: F.struct(h["s"].alias("s"), i.alias("id")))))
    listed = scored.groupBy("ask").agg(F.collect_list(F.struct((-F.col("score")).alias("s"), "ids")).alias("hits")).select("ask", F.slice(F.array_sort(flat), 1, k + 1).alias("hits"))
    mine = F.slice(F.filter("hits", lambda h: h["id"] != F.col("query_id")), 1, k)
    out = asked.join(listed, "ask").select("query_id", F.posexplode(mine).alias("rank", "hit"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("hit.id").alias("vec_id"), (-F.col("hit.s")).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)
