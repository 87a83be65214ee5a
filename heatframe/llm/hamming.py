"""Near duplicates by minhash signatures and a multi-index Hamming join (operator 13).

A set's signature is a row of minhashes, of each of which ``bits`` are kept. Two sets of similarity s differ in a
component with a chance of 1 - s. The components are cut into ``chunks``; if two signatures differ in fewer than
``chunks * (errors + 1)`` components, some chunk differs in at most ``errors`` of its own (pigeonhole). So each set
is entered, for every chunk and every choice of ``errors`` components that may be wrong, under the others' values, and
all pairs below that distance meet. Whatever meets is verified on whole sets (``setjoin``).

With the default 13 chunks of 6 components and one error, pairs of distance 25 of 78 or less meet for certain. A pair
at a similarity of exactly 0.8 meets in no chunk with a chance of 1e-6, at 0.85 of 6e-9.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatframe.llm.setjoin import SetJoin, Sets, shortened
from heatframe.llm.words import BASE, mix

CHUNKS, COMPONENTS, ERRORS, BITS = 13, 6, 1, 16
BAND_RATIO = 4  # sets of one band, and of two neighbouring ones near their border, may meet


def signatures(sets: Sets, components: int, bits: int) -> np.ndarray:
    """A row of ``components`` numbers of ``bits`` bits for every set that is not empty."""
    starts = sets.bounds[:-1][sets.sizes > 0]
    out = np.empty((len(starts), components), "u8")
    keys = mix(np.arange(2 * components, dtype="u8") + np.uint64(0x5EED))
    for k in range(components):
        value = sets.values ^ keys[2 * k]
        value *= keys[2 * k + 1] | np.uint64(1)
        out[:, k] = mix(np.minimum.reduceat(value, starts)) >> np.uint64(64 - bits) if len(starts) else 0
    return out


def entries(sets: Sets, chosen: np.ndarray, num: int, den: int, chunks: int, components: int, errors: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the chosen sets and the set of each: every chunk without every choice of ``errors`` components."""
    rows = signatures(sets, chunks * components, bits)
    place = np.flatnonzero(sets.sizes > 0)
    own = chosen[place]
    rows, place = rows[own], place[own]
    sizes = sets.sizes[place]
    band = np.zeros(len(sizes), "i8")
    while (more := BAND_RATIO ** (band + 1) <= sizes).any():
        band += more
    above = sizes * den >= num * BAND_RATIO ** (band + 1)
    rows = np.concatenate([rows, rows[above]])
    tag = mix(np.concatenate([band, band[above] + 1]).astype("u8"))
    place = np.concatenate([place, place[above]])
    out = []
    for c in range(chunks):
        part = rows[:, c * components:(c + 1) * components]
        for n, wrong in enumerate(combinations(range(components), errors)):
            key = mix(tag + np.uint64(c << 16 | n))
            for k in range(components):
                if k not in wrong:
                    key = mix(key * BASE + part[:, k])
            out.append(key)
    keys = np.concatenate(out) if out else np.empty(0, "u8")
    return shortened(keys), np.tile(place, len(out))


class HammingJoin(SetJoin):
    """The join by entries of a multi-index over minhash signatures."""

    def __init__(self, docs: DataFrame, folder: str, num: int = 80, den: int = 100, width: int = 2, chunks: int = CHUNKS,
                 components: int = COMPONENTS, errors: int = ERRORS, bits: int = BITS, **settings):
        super().__init__(docs, folder, num, den, width, **settings)
        if not 0 <= errors < components:
            raise ValueError("a chunk has more components than errors")
        if not 0 < bits <= 64:
            raise ValueError("1 to 64 bits of a minhash are kept")
        self.index = (chunks, components, errors, bits)

    def signer(self):
        num, den, index = self.num, self.den, self.index
        return lambda: lambda sets, chosen: entries(sets, chosen, num, den, *index)


def near_duplicates(docs: DataFrame, folder: str, **settings) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs.

    Documents link when their sets of distinct word shingles (``width`` words, A-Z lower-cased) have
    ``den * intersection >= num * union``; every link found is confirmed on the full sets. component_id is the
    smallest doc_id that links reach, kept whether it is the row's own. A text with fewer words than a shingle is one
    shingle; null and empty texts and those without words have an empty set and link with nothing. Rows without a
    doc_id link with nothing and have neither component nor verdict. Repeated rows get one result each; several texts
    under one id link on their own. Other columns play no part; without rows there is no result.
    """
    found = HammingJoin(docs, folder, **settings).run().drop("set_hash", "component")
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))
