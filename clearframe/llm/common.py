"""What the training-data operators share: checkpoints, table loading and word hashing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..plans.lineage import checkpointed, counted, release

__all__ = ["WHITE", "WORD", "checkpointed", "counted", "mix64", "release", "separator_table", "shingle_hashes", "table", "unused", "word_hashes"]

#: Code points that separate words in every contract: space and \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"

_U = np.uint64
_BASE, _STEP = _U(0x9E3779B97F4A7C15 | 1), _U(0xC2B2AE3D27D4EB4F)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """The name, or a longer one, that no column of the table has (upper and lower case are alike)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche over uint64 (multiply and xor-shift rounds)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> np.ndarray:
    p = np.full(n, _BASE, dtype=np.uint64)
    p[:1] = 1
    return np.multiply.accumulate(p)


def word_hashes(texts: list[bytes], separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of a batch, and for each text the index of its first word.

    ``separators`` is a 256-entry boolean table over bytes.  The whole batch is one byte array, so
    the cost is a few passes of numpy whatever the number of texts.  The second array has
    ``len(texts) + 1`` entries.
    """
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    inside = ~separators[data]
    inside[ends - 1] = False
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & ~before)
    first = np.searchsorted(starts, np.concatenate([[0], ends]))
    if not len(starts):
        return np.zeros(0, np.uint64), first
    where = np.flatnonzero(inside)
    lengths = np.diff(np.append(np.searchsorted(where, starts), len(where)))
    offset = np.arange(len(where)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    weighted = (data[where].astype(np.uint64) + _U(1)) * _powers(int(lengths.max()))[offset]
    return mix64(np.add.reduceat(weighted, np.cumsum(lengths) - lengths) + lengths.astype(np.uint64)), first


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` consecutive words (of the whole sequence if it is shorter)."""
    if not len(words):
        return words
    width = min(width, len(words))
    total = np.zeros(len(words) - width + 1, np.uint64)
    for k in range(width):
        total = total * _STEP + mix64(words[k : len(words) - width + 1 + k] + _U(k + 1))
    return mix64(total + _U(width))


def separator_table(members: bytes | None = None, keep: bytes | None = None) -> np.ndarray:
    """Either the given bytes separate words, or all ASCII bytes except ``keep``."""
    out = np.zeros(256, bool)
    if members is not None:
        out[list(members)] = True
    else:
        out[:128] = True
        out[list(keep)] = False
    return out


WHITE = separator_table(b" \t\n\x0b\x0c\r")
