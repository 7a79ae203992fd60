"""Exact top-k inner products by dual-tree search over cover trees.

The upper levels of both trees are tables: vectors go to the nearest of up to ``CENTRES`` centres
(balls that hold too many are cut by hash), and each block keeps its centre, covering radius and
smallest id.  Each query block first searches the blocks of the best bounds, which gives every
query a kth score; a block of data then meets a block of queries only where its bound can
still beat the worst kth score of that group.  With centres p, q and radii r, s no pair below scores
more than <p,q> + r|q| + s|p| + rs.

Blocks of data that lie close together form a shelf.  A shelf moves once for each ``CHUNK`` queries, and a
block of queries once for each shelf that holds a block it must meet, so that what is moved grows by
shelves and chunks and not by pairs of blocks.

Inside a task both sides get cover trees, one for each block: every node has a centre among its points and a radius
that covers them, the centres of children are apart from each other by at least the radius that
covers them, and nodes are always split down to small leaves.  The traversal goes down both trees
together and leaves a pair of nodes out under the same bound.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed, table

TOP = 5
EVERY = 50
SCALE = 256.0
#: Vectors that a block of data or of queries should hold, and those it may hold.
DATA_BLOCK, QUERY_BLOCK, MOST = 1024, 256, 65_536
#: Centres of the upper level at most: with the blocks' bounds all that every task receives.
CENTRES = 4096
#: Blocks of the best bounds that a query block searches before the others are judged.
FIRST = 2
#: Shelves that a large table should have, rows of a shelf at least and at most (a block is never cut), queries of a chunk.
SHELVES, LEAST_ROWS, MOST_ROWS, CHUNK = 48, 4096, 65_536, 65_536
#: Points of a leaf of the data and of a leaf of the queries, and children of a node at most.
LEAF, GROUP, FAN = 32, 12, 6
#: A group of queries is compared as one where its parts would still meet so much of what it must meet.
WORTH = 0.9
_SLACK = 1 + 1e-9


class Node:
    __slots__ = ("center", "radius", "norm", "points", "children", "first")

    def __init__(self, center, radius, points, children, first):
        self.center, self.radius, self.points, self.children, self.first = center, radius, points, children, first
        self.norm = float(np.sqrt(center @ center))


def cover_tree(x: np.ndarray, ids: np.ndarray, leaf: int = LEAF, points: np.ndarray | None = None) -> Node:
    """Cover tree of the rows of x, or of some; ``first`` is the smallest id below a node."""

    def away(points: np.ndarray, at: int) -> np.ndarray:
        return np.sqrt(np.maximum(((x[points] - x[at]) ** 2).sum(1), 0))

    def build(points: np.ndarray, at: int, far: np.ndarray) -> Node:
        radius, first = float(far.max()) * _SLACK, int(ids[points].min())
        if len(points) <= leaf or radius == 0:
            return Node(x[at], radius, points, (), first)
        # each next centre is the point farthest from the ones before, so centres are apart by at
        # least the distance within which they cover the rest
        centres, own, near = [at], np.zeros(len(points), int), far.copy()
        while len(centres) < FAN and near.max() > 0:
            centres.append(int(points[near.argmax()]))
            here = away(points, centres[-1])
            closer = here < near
            own[closer], near[closer] = len(centres) - 1, here[closer]
        parts = [(points[own == i], c, near[own == i]) for i, c in enumerate(centres)]
        return Node(x[at], radius, points, tuple(build(*p) for p in parts if len(p[0])), first)

    points = np.arange(len(x)) if points is None else points
    own = x[points]
    at = int(points[((own - own.mean(0)) ** 2).sum(1).argmin()])
    return build(points, at, away(points, at))


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, .. of each entry, ``count`` numbers."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())


class Flat:
    """The nodes of trees over the rows of x as arrays, so that a bound against many nodes is one product.

    Children follow each other, and so do the rows of a leaf: ``x`` and ``ids`` are in the leaves' order.
    """

    def __init__(self, roots: list[Node], x: np.ndarray, ids: np.ndarray):
        nodes, children = list(roots), []
        for node in nodes:
            children.append((len(nodes), len(node.children)))
            nodes.extend(node.children)
        self.roots = np.arange(len(roots))
        self.center, self.radius, self.norm = np.array([n.center for n in nodes]), np.array([n.radius for n in nodes]), np.array([n.norm for n in nodes])
        self.child, self.children = np.array(children).T
        self.leaf = self.children == 0
        self.rows = np.array([0 if n.children else len(n.points) for n in nodes])
        self.row = np.cumsum(self.rows) - self.rows
        order = np.concatenate([n.points for n in nodes if not n.children])
        self.x, self.ids = x[order], ids[order]
        self.single, self.longest = self.x.astype(np.float32), _longest(self.x)

    def most(self, a: Node, nodes: np.ndarray) -> np.ndarray:
        """Bounds on the products of any point below a with any point below the nodes."""
        bound = self.center[nodes] @ a.center + a.radius * self.norm[nodes] + self.radius[nodes] * (a.norm + a.radius)
        return bound + 1e-9 * np.abs(bound)

    def opened(self, nodes: np.ndarray, which: np.ndarray) -> np.ndarray:
        """The nodes, those of ``which`` replaced by their children."""
        return np.concatenate([nodes[~which], _ranges(self.child[nodes[which]], self.children[nodes[which]])])


def _longest(x: np.ndarray) -> float:
    """The greatest length of a row; infinite unless all numbers are whole."""
    return float(np.sqrt((x**2).sum(1).max())) if (x == np.rint(x)).all() else np.inf


def dual_tree(queries: np.ndarray, tree: Flat, k: int, floor: np.ndarray | None = None, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """(scores, ids, pairs compared): each query's k best rows, ties to the smaller id.

    Rows that score below a query's ``floor`` may be left out; absent ones have id -1.  ``start`` are the
    roots to search, all unless given.
    """
    best = np.full((len(queries), k), -np.inf)
    names = np.full((len(queries), k), np.iinfo(np.int64).max)
    least = np.full(len(queries), -np.inf) if floor is None else floor
    compared = 0
    # whole numbers whose products sum to at most 2^24 are as exact in single precision
    exact = max(1.0, _longest(queries)) * max(1.0, tree.longest) < 1 << 24
    asked, data = (queries.astype(np.float32), tree.single) if exact else (queries, tree.x)

    def worst(a: Node) -> float:
        return float(np.maximum(best[a.points, -1], least[a.points]).min())

    def compare(a: Node, points: np.ndarray) -> None:
        nonlocal compared
        rows = a.points
        compared += len(rows) * len(points)
        scores = asked[rows] @ data[points].T
        row, col = np.divmod(np.flatnonzero(scores >= np.maximum(best[rows, -1], least[rows]).astype(scores.dtype)[:, None]), len(points))
        if not len(row):
            return
        # rows with a score that may enter are ordered again, with the entries they have; ids break ties
        old = np.unique(row)
        score, who = np.append(scores[row, col], best[rows[old]]), np.append(tree.ids[points[col]], names[rows[old]])
        row = np.append(row, np.repeat(old, k))
        order = np.lexsort((who, -score, row))
        row, score, who = row[order], score[order], who[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        row, score, who, rank = row[rank < k], score[rank < k], who[rank < k], rank[rank < k]
        best[rows[row], rank], names[rows[row], rank] = score, who

    def leaves(a: Node, nodes: np.ndarray, limit: float) -> np.ndarray:
        while not tree.leaf[nodes].all():
            nodes = tree.opened(nodes, ~tree.leaf[nodes])
            nodes = nodes[tree.most(a, nodes) >= limit]
        return nodes

    def descend(a: Node, nodes: np.ndarray) -> None:
        limit = worst(a)
        nodes = nodes[tree.most(a, nodes) >= limit]
        if a.children and np.isfinite(limit):
            nodes = leaves(a, nodes, limit)
            left = sum(len(c.points) * tree.rows[nodes[tree.most(c, nodes) >= worst(c)]].sum() for c in a.children)
            apart = left < WORTH * len(a.points) * tree.rows[nodes].sum()
        else:
            apart = bool(a.children)
        if not len(nodes):
            return
        if apart:
            nodes = tree.opened(nodes, ~tree.leaf[nodes] & (tree.radius[nodes] >= a.radius))
            for child in a.children:
                descend(child, nodes)
            return
        nodes = leaves(a, nodes, limit)
        most = tree.most(a, nodes)
        order = np.argsort(-most, kind="stable")
        nodes, most, at, width = nodes[order], most[order], 0, 4
        while at < len(nodes) and most[at] >= limit:  # the best leaves first, in growing batches
            ready = nodes[at : at + width][most[at : at + width] >= limit]
            compare(a, _ranges(tree.row[ready], tree.rows[ready]))
            limit, at, width = worst(a), at + width, min(64, 2 * width)

    descend(cover_tree(queries, np.arange(len(queries)), GROUP), tree.roots if start is None else start)
    names[~np.isfinite(best)] = -1
    return best, names, compared


def _matrix(column) -> np.ndarray:
    joined = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return joined.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(joined), -1)


_FOUND = "q long, node long, score double"


def _search(k: int):
    """Rows (q, node, score) of a shelf and the query blocks it meets, and one (null, number of pairs compared, 0).

    The blocks of data of a query block's ``done`` were compared with it before.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        key, names, scores, compared = [np.zeros(0, np.int64)], [], [np.zeros(0)], 0
        if left.num_rows and right.num_rows:
            x, ids = _matrix(right["v"]), right["node"].to_numpy()
            blocks, parts = _parts(right["block"].to_numpy())
            forest = Flat([cover_tree(x, ids, points=p) for p in parts], x, ids)
            floor = left["floor"].to_numpy(zero_copy_only=False).astype(float)
            q, node, floor = _matrix(left["v"]), left["node"].to_numpy(), np.where(np.isnan(floor), -np.inf, floor)
            for rows in _parts(left["qb"].to_numpy())[1]:
                start = np.flatnonzero(~np.isin(blocks, left["done"][int(rows[0])].as_py()))
                best, who, n = dual_tree(q[rows], forest, k, floor[rows], start)
                keep = who.reshape(-1) >= 0
                compared += n
                key, names, scores = [*key, np.repeat(node[rows], k)[keep]], [*names, who.reshape(-1)[keep]], [*scores, best.reshape(-1)[keep]]
        q = pa.concat_arrays([pa.array(np.concatenate(key), pa.int64()), pa.nulls(1, pa.int64())])
        return pa.table({"q": q, "node": pa.array(np.concatenate([*names, [compared]]), pa.int64()), "score": pa.array(np.concatenate([*scores, [0.0]]))})

    return run


def _parts(keys: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct keys, and where each is."""
    order = np.argsort(keys, kind="stable")
    names, first = np.unique(keys[order], return_index=True)
    return names, np.split(order, first[1:])


def shelves(centres: np.ndarray, sizes: np.ndarray, most: int) -> np.ndarray:
    """Number of the shelf of each block: halves along the widest direction until at most ``most`` rows, or one block, are left."""
    out, open_, n = np.zeros(len(sizes), np.int64), [np.arange(len(sizes))], 0
    while open_:
        at = open_.pop()
        if len(at) < 2 or sizes[at].sum() <= most:
            out[at], n = n, n + 1
            continue
        c = centres[at] - centres[at].mean(0)
        at = at[np.argsort(c @ np.linalg.eigh(c.T @ c)[1][:, -1], kind="stable")]
        cut = 1 + int(np.abs(np.cumsum(sizes[at])[:-1] - sizes[at].sum() / 2).argmin())
        open_ += [at[:cut], at[cut:]]
    return out


def folded(vectors: DataFrame, copies: int) -> DataFrame:
    """(node, v, ids): distinct vectors, named by their smallest id, with their smallest ids.

    No search for k rows needs more than k + 1 copies of one vector.  The limit is applied before
    the exchange, so a vector that a third of all rows share is no hot group.
    """
    key = F.xxhash64(F.array_join(F.transform("v", lambda x: x.cast("string")), ","))
    ranked = vectors.withColumn("key", key).withColumn("rank", F.row_number().over(W.partitionBy("key", "v").orderBy("vec_id"))).where(F.col("rank") <= copies)
    return ranked.groupBy("key", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("node"), "v", "ids")


def _nearest_centre(centres: dict[int, np.ndarray]):
    """Adds the number of the nearest centre of the same length."""

    def run(batches):
        for batch in batches:
            out = np.zeros(batch.num_rows, np.int32)
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x, c = _matrix(batch.column("v").take(pa.array(at))), centres[int(dim)]
                for i in range(0, len(at), 1024):
                    out[at[i : i + 1024]] = ((c**2).sum(1)[None] - 2 * x[i : i + 1024] @ c.T).argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, "ball"])

    return run


def _balls(batch: pa.Table) -> pa.Table:
    """(dim, block, centre, radius, first, size) of the vectors of one block."""
    x = _matrix(batch["v"])
    centre = x.mean(0)
    radius = float(np.sqrt(((x - centre) ** 2).sum(1).max())) * _SLACK
    first = {c: batch[c][0].as_py() for c in ("dim", "block")}
    return pa.table({"dim": pa.array([first["dim"]], pa.int32()), "block": pa.array([first["block"]], pa.int64()), "centre": pa.array([centre.tolist()], pa.list_(pa.float64())), "radius": pa.array([radius]), "first": pa.array([int(batch["node"].to_numpy().min())], pa.int64()), "size": pa.array([len(x)], pa.int64())})


_BALL = "dim int, block long, centre array<double>, radius double, first long, size long"


def blocked(nodes: DataFrame, centres: dict[int, np.ndarray], size: int, most: int) -> DataFrame:
    """(dim, node, v, block): vectors by their nearest centre, of at most about ``most`` a block."""
    kinds = "dim int, node long, v array<double>, ball int"
    near = checkpointed(nodes.select("dim", "node", F.col("v").cast("array<double>").alias("v")).mapInArrow(_nearest_centre(centres), kinds))
    # at most CENTRES of a length; the rows are written once
    large = near.groupBy("dim", "ball").agg(F.ceil(F.count("*") / F.lit(float(most))).cast("long").alias("parts")).where("parts > 1").collect()
    part = F.lit(0)
    if large:
        cut = nodes.sparkSession.createDataFrame(large, "d int, b int, parts long")
        near = near.join(F.broadcast(cut), (F.col("dim") == F.col("d")) & (F.col("ball") == F.col("b")), "left")
        part = F.coalesce(F.pmod(F.xxhash64("node"), F.col("parts")), F.lit(0))
    return near.select("dim", "node", "v", (F.col("ball").cast("long") * (1 << 32) + part).alias("block"))


def _survivors(data: dict[int, tuple], first: bool):
    """Pairs (dim, qb, shelf) to meet, and the blocks to leave out there.

    The first time each of the best blocks is a shelf of its own; then come the shelves of all others that can still matter.
    """

    def run(batches):
        for batch in batches:
            dims, qbs, out, done = [], [], [], []
            for row in batch.to_pylist():
                blocks, c, r, shelf = data[row["dim"]]
                p, s = np.array(row["centre"]), row["radius"]
                most = c @ p + r * np.sqrt(p @ p) + s * np.sqrt((c**2).sum(1)) + r * s
                best = np.argsort(-(c @ p), kind="stable")[:FIRST]
                found = blocks[best].tolist()
                if not first:
                    floor = row["floor"] if row["floor"] is not None else -np.inf
                    found = np.unique(shelf[np.setdiff1d(np.flatnonzero(most + 1e-9 * np.abs(most) >= floor), best)]).tolist()
                dims += [row["dim"]] * len(found)
                qbs += [row["block"]] * len(found)
                out += found
                done += [[] if first else blocks[best].tolist()] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(dims, pa.int32()), pa.array(qbs, pa.int64()), pa.array(out, pa.int64()), pa.array(done, pa.list_(pa.int64()))], ["dim", "qb", "shelf", "done"])

    return run


def _met(asked: DataFrame, data: DataFrame, pairs: DataFrame, chunks: int, k: int) -> DataFrame:
    """The rows found where the query blocks of ``asked`` meet the shelves of ``data`` (with column shelf)."""
    chunk = F.pmod(F.xxhash64("qb", F.lit(7)), F.lit(chunks)).cast("int").alias("chunk")
    on = ["dim", "shelf", "chunk"]
    left = asked.join(pairs.withColumnRenamed("dim", "pair_dim"), (F.col("dim") == F.col("pair_dim")) & (F.col("block") == F.col("qb"))).select("dim", "shelf", chunk, "qb", "done", "node", "v", "floor")
    needed = pairs.select(F.col("dim").alias("pair_dim"), F.col("shelf").alias("pair_shelf"), chunk).distinct()
    right = data.join(needed, (F.col("dim") == F.col("pair_dim")) & (F.col("shelf") == F.col("pair_shelf"))).select(*on, "block", "node", "v")
    left, right = left.toDF(*left.columns), right.toDF(*right.columns)
    return left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(_search(k), _FOUND)


def search(nodes: DataFrame, asked: DataFrame, k: int, data_block: int = DATA_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(q, node, score): more than enough rows for the k best of each query node; q null counts pairs.

    ``nodes`` has dim, node, v and ``asked`` the nodes that are queries (q).  What tasks receive is
    bounded: ``CENTRES`` centres of each length, and centre and radius of the blocks.
    """
    sizes = {r["dim"]: r["n"] for r in nodes.groupBy("dim").agg(F.count("*").alias("n")).collect()}

    def centres(rows: DataFrame, of: dict[int, int], size: int) -> dict[int, np.ndarray]:
        out = {}
        for dim, n in of.items():
            want = min(CENTRES, -(-n // size))
            drawn = rows.where(F.col("dim") == dim).select("v", F.xxhash64("node", F.lit(3)).alias("h"), "node").orderBy("h", "node").limit(want)
            out[dim] = np.array([list(r["v"]) for r in drawn.collect()], float).reshape(want, dim)
        return out

    ask = checkpointed(nodes.join(asked.select("q").distinct(), F.col("node") == F.col("q"), "left_semi").select("dim", "node", "v"))
    m = {r["dim"]: r["n"] for r in ask.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    parts = lambda size: -(-max(m.values(), default=1) // size)
    data = blocked(nodes, centres(nodes, sizes, data_block), data_block, MOST)
    queries = blocked(ask, centres(ask, m, query_block), query_block, 4 * query_block)
    balls = lambda rows: checkpointed(rows.groupBy("dim", "block").applyInArrow(_balls, _BALL))
    q_balls, tops = balls(queries), {}
    for r in balls(data).orderBy("dim", "block").collect():  # at most CENTRES + rows / MOST of a length
        tops.setdefault(r["dim"], []).append((r["block"], r["centre"], r["radius"], r["size"]))
    tops = {d: tuple(map(np.array, zip(*x))) for d, x in tops.items()}
    tops = {d: (b, c, r, shelves(c, n, min(MOST_ROWS, max(LEAST_ROWS, sizes[d] // SHELVES)))) for d, (b, c, r, n) in tops.items()}
    kinds = "dim int, qb long, shelf long, done array<long>"
    near = checkpointed(q_balls.mapInArrow(_survivors(tops, True), kinds))
    found = checkpointed(_met(queries.withColumn("floor", F.lit(None).cast("double")), data.withColumn("shelf", F.col("block")), near, parts(CHUNK // 8), k))
    place = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "node"))
    kth = found.where("q is not null").withColumn("rank", place).where(F.col("rank") == k).select("q", F.col("score").alias("floor"))
    floors = checkpointed(queries.join(kth, F.col("node") == F.col("q"), "left").select("dim", "node", "v", "block", "floor"))
    # a group whose queries do not all have k rows yet has no floor
    group = floors.groupBy("dim", "block").agg(F.min("floor").alias("floor"), F.count_if(F.col("floor").isNull()).alias("open")).select(F.col("dim").alias("d"), F.col("block").alias("b"), F.when(F.col("open") == 0, F.col("floor")).alias("floor"))
    judged = q_balls.join(group, (F.col("dim") == F.col("d")) & (F.col("block") == F.col("b"))).drop("d", "b")
    rest = checkpointed(judged.mapInArrow(_survivors(tops, False), kinds))
    places = [(d, int(b), int(s)) for d, (blocks, _, _, shelf) in tops.items() for b, s in zip(blocks, shelf)]
    places = nodes.sparkSession.createDataFrame(places, "d int, b long, shelf long")
    placed = data.join(F.broadcast(places), (F.col("dim") == F.col("d")) & (F.col("block") == F.col("b"))).drop("d", "b")
    return found.union(checkpointed(_met(floors, placed, rest, parts(CHUNK), k)))


def _distinct(vectors: DataFrame, is_query: Column, k: int) -> tuple[DataFrame, DataFrame]:
    marked = vectors.withColumn("is_query", is_query)
    nodes = checkpointed(folded(marked.select("vec_id", "v"), k + 1).withColumn("dim", F.size("v")))
    asked = marked.where("is_query").select(F.col("vec_id").alias("query_id"), "v")
    key = lambda v: F.xxhash64(F.array_join(F.transform(v, lambda x: x.cast("string")), ","))
    owner = nodes.select("node", F.col("v").alias("node_v"), key("v").alias("node_key"))
    asked = asked.withColumn("key", key("v")).join(owner, (F.col("key") == F.col("node_key")) & (F.col("v") == F.col("node_v"))).select("query_id", F.col("node").alias("q"))
    return nodes, checkpointed(asked)


def compared_share(vectors: DataFrame, is_query: Column, k: int = TOP, data_block: int = DATA_BLOCK, query_block: int = QUERY_BLOCK) -> float:
    """Share of all pairs of a distinct query and a distinct row that were multiplied."""
    nodes, asked = _distinct(vectors, is_query, k)
    pairs = search(nodes, asked, k + 1, data_block, query_block).where("q is null").agg(F.sum("node")).first()[0] or 0
    return pairs / max(1, nodes.count() * asked.select("q").distinct().count())


def top_k(vectors: DataFrame, is_query: Column, k: int = TOP, data_block: int = DATA_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k rows with the largest inner product.

    ``vectors`` has vec_id and v, an array of numbers whose products and sums are exact in double
    precision.  Ties go to the smaller vec_id; a query is not its own candidate.  Vectors of
    another length are not compared; an empty table gives no rows.
    """
    nodes, asked = _distinct(vectors, is_query, k)
    found = search(nodes, asked, k + 1, data_block, query_block).where("q is not null")
    # a query's own copies count: its list has one more entry, and each entry stands for its ids
    best = W.partitionBy("q").orderBy(F.desc("score"), "node")
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k + 1)
    copies = nodes.select(F.col("node").alias("copy_node"), "ids")
    listed = found.join(copies, F.col("node") == F.col("copy_node")).groupBy("q").agg(F.collect_list(F.struct((-F.col("score")).alias("s"), "ids")).alias("hits"))
    flat = F.flatten(F.transform("hits", lambda h: F.transform(h["ids"], lambda i: F.struct(h["s"].alias("s"), i.alias("id")))))
    listed = checkpointed(listed.select("q", F.slice(F.array_sort(flat), 1, k + 1).alias("hits")))
    mine = F.slice(F.filter("hits", lambda h: h["id"] != F.col("query_id")), 1, k)
    out = asked.join(listed, "q").select("query_id", F.posexplode(mine).alias("rank", "hit"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("hit.id").alias("vec_id"), (-F.col("hit.s")).alias("score"))


def finite(embeddings: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles) of vectors without null or non-finite components."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return embeddings.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & fine).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding"))


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    return finite(embeddings).select("vec_id", F.transform("embedding", lambda c: F.floor(c * F.lit(SCALE))).alias("v"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, F.col("vec_id") % EVERY == 0).withColumn("score", F.col("score").cast("long"))


ORACLE = """
WITH ints AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.v, d.v)::BIGINT AS score
  FROM ints q JOIN ints d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
