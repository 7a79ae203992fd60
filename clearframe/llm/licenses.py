"""Licence scans: word bigrams of the text against licence templates by the Dice coefficient.

Text is normalised to lower-case runs of letters and digits.  A window of a template's own number
of bigrams slides over the text; its Dice coefficient is 2 |A n B| / (|A| + |B|) over the multisets
of bigrams.  Sizes prune first: a text with h of a template's m bigrams in it cannot reach t when
2 h / (h + m) < t, so most texts meet no template in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import separator_table, shingle_hashes, table, word_hashes

THRESHOLD = 0.8

#: Licence notices as published: fixed values.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "MIT": "Released under the MIT License",
    "MIT-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    "Unlicense": "This is free and unencumbered software released into the public domain",
}

_WORDS = separator_table(keep=b"abcdefghijklmnopqrstuvwxyz0123456789")
_KIND = "doc_id long, license string, dice double, n_matches long, matches string"


def bigrams(texts: list[bytes]) -> list[np.ndarray]:
    words, first = word_hashes([t.lower() for t in texts], _WORDS)
    return [shingle_hashes(words[a:b], 2) if b - a > 1 else words[:0] for a, b in zip(first[:-1], first[1:])]


def best_windows(grams: np.ndarray, template: np.ndarray, threshold: float) -> list[tuple[int, float]]:
    """(start, Dice) of non-overlapping windows that reach the threshold, best first, then earliest."""
    m = len(template)
    kinds, need = np.unique(template, return_counts=True)
    place = np.searchsorted(kinds, grams)
    place[place == len(kinds)] = 0
    hit = kinds[place] == grams
    h = int(hit.sum())
    if 2 * h < threshold * (h + m):
        return []
    width = min(m, len(grams))
    reach = np.concatenate([[0], np.cumsum(hit)])
    upper = reach[width:] - reach[: len(grams) - width + 1]
    found = []
    for at in np.flatnonzero(2 * np.minimum(upper, m) >= threshold * (width + m)):
        got = np.bincount(place[at : at + width][hit[at : at + width]], minlength=len(kinds))
        dice = 2 * np.minimum(got, need).sum() / (width + m)
        if dice >= threshold:
            found.append((int(at), float(dice)))
    chosen: list[tuple[int, float]] = []
    taken = np.zeros(len(grams) + 1, bool)
    for at, dice in sorted(found, key=lambda x: (-x[1], x[0])):
        if not taken[at : at + width].any():
            taken[at : at + width] = True
            chosen.append((at, dice))
    return chosen


def _scan(templates: dict[str, str], threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = sorted(templates)
        grams = dict(zip(names, bigrams([templates[n].encode() for n in names])))
        every = np.unique(np.concatenate(list(grams.values())))
        for batch in batches:
            out: list[tuple] = []
            for ids in range(0, batch.num_rows, 64):
                part = batch.slice(ids, 64)
                texts = [t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()]
                for doc, found in zip(part.column(0).to_pylist(), bigrams(texts)):
                    place = np.searchsorted(every, found)
                    place[place == len(every)] = 0
                    hits = []
                    if len(found) and (every[place] == found).any():
                        for n in names:
                            hits += [(-dice, n, at) for at, dice in best_windows(found, grams[n], threshold)]
                    hits.sort()
                    told = ",".join(f"{n}:{at}:{-d:.4f}" for d, n, at in sorted(hits, key=lambda x: (x[2], x[1])))
                    out.append((doc, hits[0][1] if hits else None, round(-hits[0][0], 6) if hits else 0.0, len(hits), told))
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.string())
            columns = list(zip(*out)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [f.split()[0] for f in _KIND.split(", ")])

    return run


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, license, dice, n_matches, matches.

    ``license`` is the best match (ties to the name first in order), null if none; ``matches``
    lists name:word:dice in the order of the text.  Null, empty and one-word texts match nothing;
    repeated rows each give a row.
    """
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(_scan(templates or TEMPLATES, threshold), _KIND)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
