"""Quality by compression: zstandard dictionaries built from good and from bad labelled text.

A text costs fewer bytes under the dictionary of the kind it resembles.  For each size of dictionary
a text gives three normalised differences of compressed sizes, (x - y) / (x + y): bad against good
dictionary, none against good, none against bad.  The score is a calibrated function of these
differences alone: a logistic regression on straight pieces of each.  The text's size serves one
purpose: a short text's differences say little, so they shrink to zero by n / (n + SHRINK).

Dictionaries and calibration are fitted on bounded, disjoint samples of the labelled rows outside the
held-out fold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Labelled rows of each class for the dictionaries, and again as many for the calibration.
SAMPLE = 600
#: Sizes of the dictionaries; there is one pair for each.
DICTIONARIES = (16 * 1024, 64 * 1024)
#: Pieces of one text that teach a dictionary, spread over the whole text, and their length.
PIECES, PIECE = 16, 2048
LEVEL = 1
#: Bytes at which a text's difference counts half.
SHRINK = 40.0
FOLD, FOLDS = 2, 4
CUT = 0.7


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % FOLDS == FOLD


#: Places at which the calibration's straight pieces meet, in tenths of a difference.
KNOTS = (0, 0.3, 0.6, 1, 1.5, 2, 3, 4, 5)
TERMS = 3 * len(DICTIONARIES)


class Measure:
    """Normalised differences of a text's compressed sizes, three for each pair of dictionaries."""

    def __init__(self, pairs: list[tuple[bytes, bytes]]):
        import zstandard as z

        make = lambda d: z.ZstdCompressor(level=LEVEL, dict_data=z.ZstdCompressionDict(d) if d else None, write_content_size=False, write_dict_id=False, write_checksum=False)
        self.pairs, self.plain = [(make(good), make(bad)) for good, bad in pairs], make(b"")

    def __call__(self, text: str | None) -> list[float]:
        raw = (text or "").encode()
        out, weight, none = [], len(raw) / (len(raw) + SHRINK), len(self.plain.compress(raw))
        for with_good, with_bad in self.pairs:
            good, bad = len(with_good.compress(raw)), len(with_bad.compress(raw))
            out += [weight * (x - y) / (x + y) for x, y in ((bad, good), (none, good), (none, bad))]
        return out


def _pieces(x: np.ndarray) -> np.ndarray:
    x = x.reshape(-1, TERMS) * 10
    return np.concatenate([np.ones((len(x), 1)), x, *[np.maximum(0, x - k) for k in KNOTS]], 1)


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 60) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton steps."""
    z = _pieces(x)
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = z.T @ (z * (p * (1 - p) + 1e-9)[:, None]) + ridge * np.eye(len(w))
        move = np.linalg.solve(h, z.T @ (y - p) - ridge * w)
        w = w + move
        if np.abs(move).max() < 1e-7:
            break
    return w


class Model:
    def __init__(self, pairs: list[tuple[bytes, bytes]], weights: np.ndarray):
        self.pairs, self.weights = pairs, weights

    def of(self, differences: list[list[float]]) -> np.ndarray:
        x = np.array(differences, float).reshape(-1, TERMS)
        return 1 / (1 + np.exp(-np.clip(_pieces(x) @ self.weights, -30, 30)))

    def score(self, texts: list[str | None]) -> np.ndarray:
        measure = Measure(self.pairs)
        return self.of([measure(t) for t in texts])


def _even(pairs: list[tuple[bytes, bytes]]) -> Model:
    """Every score is one half."""
    return Model(pairs or [(b"", b"")] * len(DICTIONARIES), np.zeros(1 + TERMS * (1 + len(KNOTS))))


def _dictionary(texts: list[bytes], size: int) -> bytes:
    """A dictionary of at most ``size`` bytes trained on pieces spread over every text."""
    import zstandard as z

    pieces = []
    for t in texts:
        if len(t) <= PIECES * PIECE:
            pieces += [t[i : i + PIECE] for i in range(0, len(t), PIECE)]
        else:
            pieces += [t[i : i + PIECE] for i in np.linspace(0, len(t) - PIECE, PIECES).astype(int)]
    try:
        return z.train_dictionary(size, pieces).as_bytes()
    except z.ZstdError:  # too little text to train on: the text itself is the dictionary
        return b"".join(pieces)[-size:]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on at most ``2 * sample`` labelled rows of each class outside the held-out fold.

    A document with two labels counts as the worse; of several texts under one doc_id the one with the
    largest hash counts.  Without labels of both classes every score is one half.  One task trains the
    dictionaries: it receives ``2 * sample`` texts, of long ones ``PIECES`` pieces; the driver receives
    dictionaries and differences only.
    """
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out()).groupBy(F.col("doc_id").alias("chosen")).agg(F.min("quality").alias("quality"))
    rows = []
    for q in (1, 0):
        own = known.where(F.col("quality") == q).withColumn("h", F.xxhash64("chosen", F.lit(5))).orderBy("h", "chosen").limit(2 * sample)
        rows += [(r["chosen"], q, i % 2) for i, r in enumerate(own.collect())]
    if len({q for _, q, _ in rows}) < 2:
        return _even([])
    chosen = spark.createDataFrame(rows, "chosen long, quality int, part int")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    got = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("chosen"))
    got = got.groupBy("chosen", "quality", "part").agg(F.max_by("text", F.xxhash64("text")).alias("text"))
    long = F.length("text")
    piece = F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), lambda i: F.substring(F.col("text"), (i * (long - PIECE) / (PIECES - 1)).cast("int") + 1, F.lit(PIECE)))
    drawn = got.where("part = 0").select("chosen", "quality", F.when(long > PIECES * PIECE, F.array_join(piece, "")).otherwise(F.col("text")).alias("text"))
    trained = drawn.repartition(1).sortWithinPartitions("chosen").mapInArrow(_trained, "quality int, size int, dictionary binary").collect()
    book = {(r["quality"], r["size"]): bytes(r["dictionary"]) for r in trained}
    pairs = [(book.get((1, s), b""), book.get((0, s), b"")) for s in DICTIONARIES]
    feats = got.where("part = 1").select("chosen", "quality", "text").mapInArrow(_differences(pairs), "quality int, d array<double>").orderBy("d", "quality").toPandas()
    if feats["quality"].nunique() < 2:
        return _even(pairs)
    x, y = np.array(feats["d"].tolist(), float), feats["quality"].to_numpy(float)
    weights = calibrate(x, y)
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    weights[0] += np.log(counts[1] / counts[0]) - np.log(y.mean() / (1 - y.mean()))  # from the sample's odds to the corpus's
    return Model(pairs, weights)


def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    texts: dict[int, list[bytes]] = {}
    for batch in batches:
        for q, t in zip(batch.column("quality").to_pylist(), batch.column("text").to_pylist()):
            texts.setdefault(q, []).append(t.encode())
    out = [(q, size, _dictionary(own, size)) for q, own in sorted(texts.items()) for size in DICTIONARIES]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.binary())], ["quality", "size", "dictionary"])


def _differences(pairs: list[tuple[bytes, bytes]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = Measure(pairs)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("quality"), pa.array([measure(t.as_py()) for t in batch.column("text")], pa.list_(pa.float64()))], ["quality", "d"])

    return run


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = Measure(model.pairs)
        for batch in batches:
            p = model.of([measure(t.as_py()) for t in batch.column(1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64())], ["doc_id", "score"])

    return run


def scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Null and empty texts have differences of 0; a null doc_id is not held out; repeated rows each
    give a row.
    """
    model = fit(docs, labels, sample)
    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_score(model), "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
