"""The fixed point of a graph that fits in one task, in numpy.

A round of the distributed loop costs a job, whatever the graph's size.  Where edges and seeds are
few by count, one task does all rounds; it gives up as soon as its rows exceed a bound, and the
caller goes on with the loop.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

#: Edges and seeds of one task, and the rows it may hold at any time.
ROWS, MOST = 500_000, 4_000_000

# executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _codes(columns: list) -> np.ndarray:
    """One number for each distinct combination of values, null being a value."""
    code = np.zeros(len(columns[0]), np.int64) if columns else None
    for c in columns:
        own = c.combine_chunks().dictionary_encode(null_encoding="encode")
        own = own.combine_chunks() if isinstance(own, pa.ChunkedArray) else own
        code = np.unique(code * len(own.dictionary) + own.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    return code


def _combined(key: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the bits of all their masks."""
    if not len(key):
        return key, mask
    order = np.argsort(key, kind="stable")
    key, mask = key[order], mask[order]
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[starts], np.bitwise_or.reduceat(mask, starts)


def solver(on: list[str], rest: list[str], schema: pa.Schema, most: int = MOST):
    """A function over rows (is_seed, on.., rest.., node, dst, mask); it yields (on.., rest.., node, mask, born).

    A single row with born = -1 says that the rows were too many.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        t = pa.Table.from_batches(batches)
        seed = t["is_seed"].to_numpy(zero_copy_only=False).astype(bool)
        at_edge, at_seed = np.flatnonzero(~seed), np.flatnonzero(seed)
        group = _codes([t[c] for c in on]) if on else np.zeros(t.num_rows, np.int64)
        names = pa.chunked_array([*t["node"].chunks, *t["dst"].take(at_edge).chunks], t["node"].type)
        named = _codes([names])
        where, place = np.unique(np.concatenate([group, group[at_edge]]) * (named.max() + 1) + named, return_index=True, return_inverse=True)[1:]
        n, rows = len(where), t.num_rows
        src, dst = place[at_edge], place[rows:]
        order = np.argsort(src, kind="stable")
        dst, first = dst[order], np.searchsorted(src[order], np.arange(n + 1))
        sown, kind = np.unique(_codes([t[c].take(at_seed) for c in rest]) if rest and len(at_seed) else np.zeros(len(at_seed), np.int64), return_index=True, return_inverse=True)[1:]
        mask = t["mask"].to_numpy(zero_copy_only=False)[at_seed].astype(np.int64)
        key, mask = _combined(kind.astype(np.int64) * n + place[at_seed], mask)
        known, bits, born, turn = key, mask.copy(), np.zeros(len(key), np.int64), 0
        while len(key):
            turn += 1
            node = key % n
            fan = first[node + 1] - first[node]
            if fan.sum() > most or len(known) > most:
                yield pa.RecordBatch.from_arrays([pa.nulls(1, f.type) if f.name != "born" else pa.array([-1], pa.int32()) for f in schema], schema=schema)
                return
            row = np.repeat(np.arange(len(key)), fan)
            edge = np.arange(len(row)) - np.repeat(np.cumsum(fan) - fan, fan) + first[node[row]]
            key, mask = _combined((key - node)[row] + dst[edge], mask[row])
            spot = np.searchsorted(known, key)
            old = (spot < len(known)) & (known[np.minimum(spot, len(known) - 1)] == key)
            mask = mask & ~np.where(old, bits[np.minimum(spot, len(known) - 1)], 0)
            keep = mask != 0
            key, mask, spot, old = key[keep], mask[keep], spot[keep], old[keep]
            bits[spot[old]] |= mask[old]
            known, bits, born = (np.insert(a, spot[~old], b) for a, b in ((known, key[~old]), (bits, mask[~old]), (born, np.full((~old).sum(), turn))))
        at = where[known % n]
        line = np.where(at < rows, at, at_edge[np.maximum(at - rows, 0)] if len(at_edge) else 0)
        out = {c: t[c].take(line) for c in on} | {c: t[c].take(at_seed[sown[known // n]]) for c in rest}
        out |= {"node": names.take(at), "mask": pa.array(bits), "born": pa.array(born.astype(np.int32))}
        yield from pa.table([out[f.name] for f in schema], schema=schema).to_batches()

    return run
