"""Near-duplicate documents by SetSketch registers.

Every document's set of five-word shingles is sketched into registers: the smallest of the
exponentially distributed hash values that fall on a register, cut to a geometric grid of base B.
Registers are mergeable (the larger one of two stays) and locality sensitive.  Bands of registers
give candidate pairs, the joint likelihood of the two register vectors estimates their Jaccard
similarity, and what stays is verified on the full sets.

Groups are never expanded into pairs.  Equal sets fold into one representative first.  In each
bucket of a band all members are compared with the bucket's smallest document (a star); documents
already connected need no more comparisons.  Where members of a bucket are still in different
components, registers alone tell which of these components may meet; their documents form a cluster,
which is settled on full sets in bounded blocks.  A block gives back only links that join components,
so the rows never exceed the documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .common import WHITE, checkpointed, counted, mix64, release, shingle_hashes, table, unused, word_hashes

WIDTH = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 75
ROWS, BANDS = 6, 60
REGISTERS = ROWS * BANDS
#: Base of the grid and the register for the value 1; registers are cut to [0, 255].
B = 1.1
_ZERO = 64
#: Estimates below this are not verified: five standard deviations at the threshold.
MARGIN = 5 * math.sqrt(0.75 * 0.25 / REGISTERS)
_CHUNK = 1 << 22
_U = np.uint64
#: Documents, and shingles, in a block of a bucket or cluster.
_BLOCK, _BLOCK_SHINGLES = 2048, 1 << 20
#: Edges whose components one task finds; more of them take rounds of joins.
EDGES = 1 << 18


def text_sets(texts: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text (A-Z lower-cased, words between white space)."""
    words, first = word_hashes([t.lower() for t in texts], WHITE)
    return [np.unique(shingle_hashes(words[a:b], width)) for a, b in zip(first[:-1], first[1:])]


def _uniform(x: np.ndarray) -> np.ndarray:
    return (mix64(x) >> _U(11)).astype(np.float64) * 2.0**-53 + 2.0**-54


def registers(sets: list[np.ndarray], m: int = REGISTERS) -> np.ndarray:
    """SetSketch registers of each set, as a row of ``m`` bytes.

    Each element gives points of a Poisson process in rising order, each on a register of its own
    draw.  Points above the largest register minimum change nothing, so each set has a bound that
    almost surely exceeds it; sets with an empty register go again with twice the bound.
    """
    low = np.full((len(sets), m), np.inf)
    bound = np.array([(math.log(m) + 5.0) / max(1, len(s)) for s in sets])
    todo = [i for i, s in enumerate(sets) if len(s)]
    while todo:
        elements = np.concatenate([sets[i] for i in todo])
        owner = np.repeat(todo, [len(sets[i]) for i in todo])
        low[todo] = np.inf
        flat, at, step = low.reshape(-1), np.zeros(len(elements)), 0
        while len(elements):
            step += 1
            seed = elements + _U(step * 0xD1342543DE82EF95 % (1 << 64))
            at = at - np.log(_uniform(seed)) / m
            live = at < bound[owner]
            elements, owner, at, seed = elements[live], owner[live], at[live], seed[live]
            register = ((mix64(seed ^ _U(0xA0761D6478BD642F)) >> _U(32)) * _U(m) >> _U(32)).astype(np.int64)
            np.minimum.at(flat, owner * m + register, at)
        todo = [i for i in todo if not np.isfinite(low[i]).all()]
        bound[todo] *= 2
    with np.errstate(invalid="ignore"):
        grid = _ZERO + np.floor(1 - np.log(low * m) / math.log(B))
    return np.clip(np.nan_to_num(grid, nan=0, posinf=0, neginf=0), 0, 255).astype(np.uint8)


def likely_similarity(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, grid: int = 101) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity for rows of register pairs and known set sizes.

    Of the registers some are larger in a, some in b, some equal; given u and v, the shares of the
    sizes, the chances of the first two are q(u - vJ) and q(v - uJ) with
    q(x) = -log_B(1 - x (B - 1) / B).
    """
    more, less = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    same = a.shape[1] - more - less
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    j = np.linspace(0, 1, grid)[None, :] * np.minimum(u / v, v / u)
    q = lambda x: np.clip(-np.log1p(-np.clip(x, 0, 1) * (B - 1) / B) / math.log(B), 1e-12, 1)
    up, down = q(u - v * j), q(v - u * j)
    score = more * np.log(up) + less * np.log(down) + same * np.log(np.clip(1 - up - down, 1e-12, 1))
    return j[np.arange(len(j)), score.argmax(1)]


_SKETCH = "doc_id long, own long, n_shingles long, k1 long, k2 long, sketch binary"


def _groups(lengths: list[int]) -> Iterator[slice]:
    """Runs of texts of about ``_CHUNK`` bytes, so that memory stays bounded in large batches."""
    start = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > _CHUNK:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield slice(start, len(lengths))


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for part in _groups([len(t) if t else 0 for t in texts.cast(pa.binary()).to_pylist()]):
            raw = [t or b"" for t in texts[part.start : part.stop].cast(pa.binary()).to_pylist()]
            sets = text_sets(raw)
            sketch = registers(sets)
            one = np.array([np.add.reduce(mix64(s + _U(1))) if len(s) else 0 for s in sets], np.uint64)
            two = np.array([np.add.reduce(mix64(s ^ _U(0x5851F42D4C957F2D))) if len(s) else 0 for s in sets], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [ids[part.start : part.stop], batch.column(2)[part.start : part.stop], pa.array([len(s) for s in sets], pa.int64()), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array([r.tobytes() for r in sketch], pa.binary())],
                ["doc_id", "own", "n_shingles", "k1", "k2", "sketch"],
            )


def _with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for part in _groups([len(t) if t else 0 for t in texts.cast(pa.binary()).to_pylist()]):
            sets = text_sets([t or b"" for t in texts[part.start : part.stop].cast(pa.binary()).to_pylist()])
            yield pa.RecordBatch.from_arrays([ids[part.start : part.stop], pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["doc_id", "members"])


def _estimated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps pairs (a, b) whose likely similarity is near or above the threshold."""
    for batch in batches:
        if batch.num_rows:
            regs = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, REGISTERS) for c in ("sa", "sb")]
            sizes = [batch.column(c).to_numpy().astype(float) for c in ("na", "nb")]
            good = likely_similarity(*regs, *sizes) >= PERCENT / 100 - MARGIN
            yield batch.select(["a", "b", "na", "nb"]).filter(pa.array(good))


_PAIR = "a long, b long, na long, nb long"


def _read(t: pa.Table) -> tuple[np.ndarray, ...]:
    sketch = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint8).reshape(-1, REGISTERS)
    return t["doc_id"].to_numpy(), t["n_shingles"].to_numpy(), t["component"].to_numpy().copy(), sketch


def _joins(left: pa.Table, right: pa.Table, linked) -> pa.Table:
    """Links between two blocks that join components, found by trying likely pairs of different ones.

    ``linked(i, js)`` tells which of the likely pairs count.  Components that meet become one, and
    their further pairs are not tried.
    """
    ids, n, comp, regs = _read(left)
    ids2, n2, comp2, regs2 = _read(right)
    found: list[tuple[int, int]] = []
    for i in range(len(ids)):
        at = np.flatnonzero((comp2 != comp[i]) & (100 * np.minimum(n2, n[i]) >= PERCENT * np.maximum(n2, n[i])))
        if not len(at):
            continue
        j = likely_similarity(np.broadcast_to(regs[i], (len(at), REGISTERS)), regs2[at], np.full(len(at), float(n[i])), n2[at].astype(float))
        order = np.argsort(-j, kind="stable")
        for k in at[order[j[order] >= PERCENT / 100 - MARGIN]]:
            if comp2[k] != comp[i] and linked(i, k):
                found.append((int(ids[i]), int(ids2[k])))
                old, new = max(comp[i], comp2[k]), min(comp[i], comp2[k])
                comp[comp == old], comp2[comp2 == old] = new, new
    rows = np.array(found, np.int64).reshape(-1, 2)
    return pa.table({"a": pa.array(rows[:, 0]), "b": pa.array(rows[:, 1])})


def _hints(left: pa.Table, right: pa.Table) -> pa.Table:
    """Pairs that may link components of one bucket: by registers alone."""
    return _joins(left, right, lambda i, j: True)


def _settle(left: pa.Table, right: pa.Table) -> pa.Table:
    """Pairs that do link components of one cluster: likely ones, verified on full sets."""
    sets = [[np.asarray(x.values, np.int64) for x in t["members"].combine_chunks()] for t in (left, right)]

    def linked(i: int, j: int) -> bool:
        a, b = sets[0][i], sets[1][j]
        both = len(np.intersect1d(a, b, assume_unique=True))
        return 100 * both >= PERCENT * (len(a) + len(b) - both)

    return _joins(left, right, linked)


def _blocked(rows: DataFrame, key: str, run) -> DataFrame:
    """Runs a function over all pairs of blocks of each group; a group of any size is cut by hash."""
    cost = F.greatest(F.ceil(F.count("*") / F.lit(_BLOCK)), F.ceil(F.sum("n_shingles") / F.lit(_BLOCK_SHINGLES)))
    sizes = rows.groupBy(key).agg(cost.cast("int").alias("parts")).withColumnRenamed(key, "of")
    rows = rows.join(sizes, F.col(key) == F.col("of")).drop("of").withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
    rows = checkpointed(rows)
    # most groups are one block, which meets only itself and is sent once
    single = rows.where("parts = 1").groupBy(key).applyInArrow(_alone(run), "a long, b long")
    large = rows.where("parts > 1")
    left = large.withColumn("x", F.col("own")).withColumn("y", F.explode(F.sequence(F.col("own"), F.col("parts") - 1)))
    right = large.withColumn("y", F.col("own")).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("own"))))
    right = right.toDF(*right.columns)
    return single.union(left.groupBy(key, "x", "y").cogroup(right.groupBy(key, "x", "y")).applyInArrow(run, "a long, b long"))


def _alone(run):
    return lambda block: run(block, block)


def _sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, members) of the named documents, read again from the texts."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chosen = texts.join(ids, F.col("doc_id") == F.col("need"), "left_semi").groupBy("doc_id").agg(F.max_by("text", F.xxhash64("text")).alias("text"))
    return chosen.mapInArrow(_with_sets, "doc_id long, members array<long>")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose full sets meet the threshold."""
    one = sets.select(F.col("doc_id").alias("a"), F.col("members").alias("ma"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("members").alias("mb"))
    both = F.size(F.array_intersect("ma", "mb")).cast("long")
    return pairs.join(one, "a").join(two, "b").where(100 * both >= PERCENT * (F.col("na") + F.col("nb") - both)).select("a", "b")


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of the edges of all batches.

    Of two roots that an edge joins the larger one takes the smaller one as its parent.  Only roots
    without a smaller neighbour stay, at most half of those with edges, so rounds are few.
    """
    ends = [np.concatenate(x) for x in zip(*[(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows])]
    if not ends:
        return
    names, place = np.unique(np.concatenate(ends), return_inverse=True)
    a, b = place[: len(ends[0])], place[len(ends[0]) :]
    up = np.arange(len(names))
    while True:
        a, b = up[a], up[b]
        apart = a != b
        if not apart.any():
            break
        a, b = a[apart], b[apart]
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up, higher := up[up]):
            up = higher
    for at in range(0, len(names), _CHUNK >> 6):
        part = slice(at, at + (_CHUNK >> 6))
        yield pa.RecordBatch.from_arrays([pa.array(names[part]), pa.array(names[up[part]])], ["node", "component"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node each node of the edges (a, b) reaches; a <> b.

    Up to ``EDGES`` edges by count are joined in one task.  Beyond that every node points to its smallest smaller neighbour.  That is a forest, whose roots come by
    pointer doubling over one row a node, and a root is the smallest node of its tree.  Every other
    edge meets the roots once; those that join two trees are contracted to them, and the same is
    done with the trees.  So no round moves more rows than there are nodes, however many edges a
    node has; hot roots are split by the adaptive skew join.
    """
    release(edges.sparkSession)
    n, edges = counted(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if n <= EDGES:
        return checkpointed(edges.coalesce(1).mapInArrow(_united, "node long, component long"))
    tree = edges.groupBy("b").agg(F.min("a").alias("up")).select(F.col("b").alias("node"), "up")
    tree = checkpointed(tree)
    while True:
        over = tree.select(F.col("node").alias("at"), F.col("up").alias("top"))
        seen = Observation()
        tree = tree.join(over, F.col("up") == F.col("at"), "left").select("node", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved"))
        tree = checkpointed(tree.observe(seen, F.count_if("moved").alias("n"))).select("node", "up")
        if not seen.get["n"]:
            break
    release(edges.sparkSession)
    side = lambda c: tree.select(F.col("node").alias(f"{c}_node"), F.col("up").alias(f"{c}_up"))
    met = edges.join(side("b"), F.col("b") == F.col("b_node")).join(side("a"), F.col("a") == F.col("a_node"), "left").select(F.coalesce("a_up", "a").alias("x"), F.col("b_up").alias("y"))
    m, across = counted(met.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    if m:
        roots = components(across).select(F.col("node").alias("root"), "component")
        tree = tree.join(roots, F.col("up") == F.col("root"), "left").select("node", F.coalesce("component", "up").alias("up")).union(roots)
    out = tree.select("node", F.col("up").alias("component"))
    return checkpointed(out.union(out.select(F.col("component").alias("node"), "component")).distinct())


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sketches of all rows, components of linked documents)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("own"))
    sketches = checkpointed(texts.mapInArrow(_sketched, _SKETCH))
    full = sketches.where("doc_id is not null")
    # a doc_id with several texts stands by one of them
    several = full.groupBy("doc_id").agg(F.min("own").alias("least"), F.max("own").alias("most")).where("least <> most").select(F.col("doc_id").alias("of"), "most")
    several = checkpointed(several)
    if not several.isEmpty():
        full = full.join(several, (F.col("doc_id") == F.col("of")) & (F.col("own") != F.col("most")), "left_anti")
    full = full.where("n_shingles > 0")
    key = ["n_shingles", "k1", "k2"]
    first = full.groupBy(*key).agg(F.min("doc_id").alias("first"))
    # equal sets: an edge to the smallest document with the set
    equal = full.select("doc_id", *key).join(first, key).where("doc_id <> first").select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    alone = full.join(first.select("first"), F.col("doc_id") == F.col("first"), "left_semi").dropDuplicates(["doc_id"])
    alone = checkpointed(alone.select("doc_id", "n_shingles", "sketch"))
    width = ROWS
    keys = F.array(*[F.xxhash64(F.lit(i), F.substring("sketch", width * i + 1, width)) for i in range(BANDS)])
    banded = alone.select("doc_id", F.explode(keys).alias("band"))
    heads = banded.groupBy("band").agg(F.min("doc_id").alias("a"), F.count("*").alias("n")).where("n > 1")
    members = checkpointed(banded.join(heads, "band").select("band", "a", "doc_id"))
    release(docs.sparkSession)
    star = members.where("a <> doc_id").select("a", F.col("doc_id").alias("b")).distinct()
    busy = checkpointed(star.select(F.explode(F.array("a", "b")).alias("need")).distinct())
    sets = checkpointed(_sets_of(docs, busy))
    release(docs.sparkSession)
    known = alone.join(busy, F.col("doc_id") == F.col("need"), "left_semi")
    side = lambda c: known.select(F.col("doc_id").alias(c), F.col("n_shingles").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    sizes_fit = 100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb")
    likely = checkpointed(star.join(side("a"), "a").join(side("b"), "b").where(sizes_fit).mapInArrow(_estimated, _PAIR))
    edges = checkpointed(verified(likely, sets))
    release(docs.sparkSession)
    found = components(edges)
    # buckets whose members are in several components
    named = members.join(found, F.col("doc_id") == F.col("node"), "left").select("band", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    split = named.groupBy("band").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 <> c2").select("band")
    rest = named.join(split, "band").join(known, "doc_id").select("band", "doc_id", "n_shingles", "component", "sketch")
    hints = checkpointed(_blocked(rest, "band", _hints).distinct())
    release(docs.sparkSession)
    if not hints.isEmpty():
        # documents of components that may meet, in clusters
        label = named.select("doc_id", "component").distinct()
        label = checkpointed(label)
        cluster = components(hints.union(label.where("doc_id <> component").select(F.col("component"), F.col("doc_id"))))
        touched = cluster.join(hints.select(F.explode(F.array("a", "b")).alias("hit")).distinct(), F.col("node") == F.col("hit"), "left_semi").select(F.col("component").alias("cluster")).distinct()
        inside = cluster.withColumnRenamed("component", "cluster").join(touched, "cluster").join(label, F.col("node") == F.col("doc_id")).drop("node")
        inside = inside.join(known, "doc_id").join(sets, "doc_id").select("cluster", "doc_id", "n_shingles", "component", "sketch", "members")
        edges = edges.union(checkpointed(_blocked(inside, "cluster", _settle)))
    return sketches, components(edges.union(equal))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    * null and empty texts, and texts of white space, have the empty set and link with nothing;
    * texts of fewer than five words have one shingle, the whole sequence;
    * a null doc_id takes no part in links: its component is null and it is kept;
    * repeated rows of one doc_id share their component; where their texts differ, the one with the
      largest hash stands for the doc_id, and n_shingles is each row's own;
    * other columns are not read.
    """
    sketches, found = links(docs)
    component = F.coalesce("component", "doc_id")
    return (
        sketches.select("doc_id", "n_shingles")
        .join(found, F.col("doc_id") == F.col("node"), "left")
        .select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
    )


def without_duplicates(docs: DataFrame) -> DataFrame:
    """The documents with one of each group left, the smallest doc_id."""
    _, found = links(docs)
    gone = unused(docs, "gone_id")
    return docs.join(found.where("component <> node").select(F.col("node").alias(gone)), docs["doc_id"] == F.col(gone), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
shingles AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM words),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM shingles),
meets AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS i
  FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
linked AS (SELECT a, b FROM meets WHERE 100 * i >= 75 * (na + nb - i)),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, linked.b FROM reach JOIN linked ON linked.a = reach.r)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM shingles s JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) c ON c.doc_id = s.doc_id
"""
