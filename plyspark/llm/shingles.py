"""Sets of word shingles: words in A-Z lower case, five consecutive words a shingle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .textkernel import distinct, slices

SHINGLE = 5
SEED = 11


def shingle_sets(column: pa.Array, short: bool):
    """(from row, to row, distinct hashes of each text ascending, offsets) for row ranges of bounded bytes.

    short: a text of 1 to 4 words has its whole sequence as its one shingle; else it has none.
    """
    for low, high, words in slices(column):
        hashes, text = words.windows(SHINGLE, words.hashes(SEED, lower=True), SEED, short)
        yield low, high, *distinct(hashes, text, high - low)


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)
