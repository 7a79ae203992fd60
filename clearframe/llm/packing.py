"""Packing by power-of-two decomposition.

A document of L ids (its own and a closing id 0) is cut into as many whole sequences of the maximum
length as fit, then into the binary digits of the rest, longest first.  Every piece has a power of
two as its length and is a sequence by itself: no sequence crosses documents and nothing is padded.
Batches are drawn per bucket of equal length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, table

MAX_TOKENS = 1024
END = 0

_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bucket int, part int, at long"


def piece_lengths(total: int, longest: int = MAX_TOKENS) -> list[int]:
    """Lengths of the pieces of ``total`` ids: whole sequences, then falling powers of two."""
    rest = total % longest
    digits = (1 << bit for bit in range(rest.bit_length() - 1, -1, -1))
    return [longest] * (total // longest) + [d for d in digits if rest & d]


class ByteBpe:
    """Ids of a byte-level BPE vocabulary file.

    The ranks file of the same vocabulary is faster; texts that spell a special token go through
    the JSON file, whose ids are the reference.
    """

    def __init__(self, json_path: str, ranks_path: str | None = None, pattern: str | None = None):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(json_path)
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks_path:
            import base64

            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is None or any(s in text for s in self.special):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.array(self.fast.encode_ordinary(text), dtype="<u4")


def public_bpe() -> ByteBpe:
    """The vocabulary the contract names, from the files installed with the tokenizers package."""
    import public_tokenizers as P

    return ByteBpe(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def _cut(make_tokenizer, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokenize, part, at = make_tokenizer(), TaskContext.get().partitionId(), 0
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0), batch.column(1)):
                ids = np.append(tokenize(text.as_py() or ""), np.uint32(END)).astype("<u4")
                start = 0
                for n in piece_lengths(len(ids), longest):
                    out.append((doc.as_py(), start, n, zlib.crc32(ids[start : start + n].tobytes()), len(ids), n.bit_length() - 1, part, at))
                    start, at = start + n, at + 1
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
            columns = list(zip(*out)) or [()] * len(kinds)
            names = [f.split()[0] for f in _PIECE.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return run


def pack(docs: DataFrame, make_tokenizer=public_bpe, longest: int = MAX_TOKENS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket.

    * a null or empty text has one id, the closing one, and so one piece of length 1;
    * a null doc_id stays null; repeated rows each give their own pieces;
    * ``bucket`` is log2 of the length, the group a trainer draws batches from;
    * sequences are numbered without gaps: by task, then in the task's order.  Only a count for
      each task reaches the driver.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest sequence must be a power of two")
    spark = docs.sparkSession
    pieces = checkpointed(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_cut(make_tokenizer, longest), _PIECE))
    sizes = {r["part"]: r["n"] for r in pieces.groupBy("part").agg(F.count("*").alias("n")).collect()}
    first, seen = [], 0
    for part in range(max(sizes, default=-1) + 1):
        first.append(seen)
        seen += sizes.get(part, 0)
    begin = spark.createDataFrame(list(enumerate(first)), "part int, first long")
    return pieces.join(F.broadcast(begin), "part").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.col("at")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "bucket"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
