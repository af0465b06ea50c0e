"""Looking up every word of a corpus in a table of its distinct words, by one plan at any size.

Words are far from equally frequent, so the table is split by count.  At most FREQUENT_WORDS words, the
most frequent ones, go to every task; all others, each of which is rare by itself, are joined through a
shuffle, where no word is a hot key.  The bound doesn't depend on the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FREQUENT_WORDS = 50_000
_STEPS = 16


def _step(n):
    """Counts in steps of a sixteenth of a doubling."""
    return F.floor(F.log2(n) * _STEPS)


def frequent_floor(table: DataFrame, most: int = FREQUENT_WORDS) -> int:
    """The lowest step of counts from which on at most ``most`` words of (word, n) are left."""
    sizes = {r.step: r.k for r in table.groupBy(_step(F.col("n")).alias("step")).agg(F.count(F.lit(1)).alias("k")).collect()}  # about 16 rows a doubling
    total, floor = 0, 64 * _STEPS
    for step in sorted(sizes, reverse=True):
        total += sizes[step]
        if total > most:
            break
        floor = step
    return floor


def split(table: DataFrame, most: int = FREQUENT_WORDS) -> tuple[list, DataFrame]:
    """(rows of the frequent words, at most ``most``; the table of the others) of a written table of (word, n, ...)."""
    floor = frequent_floor(table, most)
    return table.filter(_step(F.col("n")) >= floor).collect(), table.filter(_step(F.col("n")) < floor)


def places(words: pa.ListArray, index: dict[str, int]) -> tuple[np.ndarray, np.ndarray, pa.DictionaryArray]:
    """(offsets of the lists, place in ``index`` of every word or -1, the words): each distinct word of a batch is
    looked up once."""
    offsets = words.offsets.to_numpy() - words.offsets[0].as_py()
    encoded = words.flatten().dictionary_encode()
    found = np.array([index.get(w, -1) for w in encoded.dictionary.to_pylist()] or [-1], np.int64)
    return offsets, found[encoded.indices.to_numpy(zero_copy_only=False)] if len(encoded) else np.zeros(0, np.int64), encoded


def unknown(offsets: np.ndarray, at: np.ndarray, encoded: pa.DictionaryArray) -> pa.ListArray:
    """The words of each list whose place is -1, in order."""
    missing = np.flatnonzero(at < 0)
    ends = np.searchsorted(missing, offsets)
    values = encoded.take(pa.array(missing)).cast(pa.string()) if len(missing) else pa.array([], pa.string())
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)
