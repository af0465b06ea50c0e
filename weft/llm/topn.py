"""The N best items of each of millions of groups by simultaneous per-group bisection.

Items are compared through an order-preserving code: a priority word, a score word whose bits are
flipped so that a higher score is a smaller number, and the identifier in 8-byte words.  All groups of
a task are bisected at once, word by word: every step halves the cutoff interval of every open group by
counting its rows at or below the midpoint, until each group holds exactly N rows; rows equal to a
cutoff go on to the next word with what is still wanted.

The operator runs twice.  Each task first cuts its own input rows, without a shuffle, so a group of any
size sends at most N rows per chunk of a task onwards; the survivors are then hashed by group and cut
again.  No task ever holds more than one chunk of a group's rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_ROWS = 250_000
_COLUMNS = ["g", "i", "p", "s"]
_SCHEMA = "g string, i string, p bigint, s double"


def priority_code(priority: np.ndarray) -> np.ndarray:
    """int64 to uint64 in the same order."""
    return priority.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)


def score_code(score: np.ndarray) -> np.ndarray:
    """float64 (no NaN) to uint64; a higher score has a smaller code."""
    bits = (score.astype(np.float64) + 0.0).view(np.uint64)  # -0.0 becomes 0.0
    ascending = np.where(bits >> np.uint64(63) == 1, ~bits, bits | np.uint64(1 << 63))
    return ~ascending


def id_words(ids: list[bytes]) -> np.ndarray:
    """Rows of big-endian 8-byte words, then the length: compares like the bytes themselves."""
    width = -(-max(map(len, ids), default=1) // 8) * 8 or 8
    padded = np.frombuffer(b"".join(b.ljust(width, b"\0") for b in ids), dtype=">u8").reshape(len(ids), -1)
    length = np.array([len(b) for b in ids], dtype=np.uint64)
    return np.column_stack([padded.astype(np.uint64), length])


def bisect_word(group: np.ndarray, code: np.ndarray, need: np.ndarray) -> np.ndarray:
    """The cutoff of each group: the smallest code c found by bisection with at least ``need`` rows of
    code <= c (stopping early where a midpoint has exactly ``need``); the largest code of a group with
    no more rows than needed."""
    n = len(need)
    low, high = np.full(n, np.iinfo(np.uint64).max, np.uint64), np.zeros(n, np.uint64)
    np.minimum.at(low, group, code)
    np.maximum.at(high, group, code)
    size = np.bincount(group, minlength=n)
    cut = high.copy()
    open_ = (size > need) & (low < high)
    cut[~open_ & (size > need)] = high[~open_ & (size > need)]
    while open_.any():
        keep = open_[group]
        group, code = group[keep], code[keep]
        middle = low + (high - low) // np.uint64(2)
        count = np.bincount(group[code <= middle[group]], minlength=n)
        exact, enough = open_ & (count == need), count >= need
        cut[exact] = middle[exact]
        high = np.where(open_ & enough, middle, high)
        low = np.where(open_ & ~enough, middle + np.uint64(1), low)
        done = open_ & ~exact & (low == high)
        cut[done] = low[done]
        open_ &= ~exact & ~done
    return cut


def bisect_top(group: np.ndarray, words, n_groups: int, n: int) -> np.ndarray:
    """Mask of the n rows of each group with the smallest codes.

    words: functions that give the next word's code of the rows at the given indexes.  Rows equal in
    all words are settled by position, which is only reached by whole duplicates.
    """
    taken = np.zeros(len(group), bool)
    rows, need = np.arange(len(group)), np.full(n_groups, n, np.int64)
    for word in words:
        if not len(rows):
            return taken
        g, code = group[rows], word(rows)
        cut = bisect_word(g, code, need)[g]
        below, at = code < cut, code == cut
        inside = np.bincount(g[below | at], minlength=n_groups)
        whole = (inside <= need)[g]
        sure = below | (at & whole)
        taken[rows[sure]] = True
        need = need - np.bincount(g[sure], minlength=n_groups)
        left = at & ~whole & (need[g] > 0)
        rows = rows[left]
    if len(rows):
        order = np.argsort(group[rows], kind="stable")
        g = group[rows][order]
        first = np.r_[0, np.flatnonzero(np.diff(g)) + 1]
        place = np.arange(len(g)) - np.repeat(first, np.diff(np.r_[first, len(g)]))
        taken[rows[order][place < need[g]]] = True
    return taken


def _codes(table: pa.Table):
    def dictionary(name):
        column = table.column(name).combine_chunks()
        column = column.dictionary_encode() if not pa.types.is_dictionary(column.type) else column
        return column.indices.to_numpy(zero_copy_only=False).astype(np.int64), column.dictionary

    group, groups = dictionary("g")
    item, items = dictionary("i")
    return group, groups, item, items, priority_code(table.column("p").to_numpy()), score_code(table.column("s").to_numpy())


def cut(table: pa.Table, n: int, ranked: bool) -> pa.Table:
    """The n best distinct items of each group of a table of g, i, p, s; with ranked, their place k."""
    group, groups, item, items, priority, score = _codes(table)
    # a repeated item counts by its best row: the same bisection with n = 1 over (group, item)
    pair, pair_rows, pair_of = np.unique(group * max(1, len(items)) + item, return_index=True, return_inverse=True)
    rows = np.arange(len(group))
    if len(pair) < len(group):
        rows = np.flatnonzero(bisect_top(pair_of, [lambda r: priority[r], lambda r: score[r]], len(pair), 1))
    g, it, p, s = group[rows], item[rows], priority[rows], score[rows]
    words = [lambda r: p[r], lambda r: s[r]]
    if len(items):
        named: dict = {}  # identifier words of the rows that are still open at the first of them

        def id_word(k):
            def word(r):
                if not named:
                    named["rows"], named["words"] = r, id_words([x.encode() for x in items.take(pa.array(it[r])).to_pylist()])
                found = named["words"]
                return found[np.searchsorted(named["rows"], r), min(k, found.shape[1] - 1)]

            return word

        words += [id_word(k) for k in range(-(-(pc.max(pc.binary_length(items)).as_py() or 1) // 8) + 1)]
    mask = bisect_top(g, words, len(groups), n) if len(g) else np.zeros(0, bool)
    kept = rows[mask]
    if not ranked:
        return table.take(pa.array(kept))
    names = np.array([x.encode() for x in items.take(pa.array(item[kept])).to_pylist()], dtype=object)
    by_name = np.empty(len(kept), np.int64)
    by_name[np.argsort(names, kind="stable")] = np.arange(len(kept))
    order = np.lexsort((by_name, score[kept], priority[kept], group[kept]))
    g = group[kept][order]
    first = np.r_[0, np.flatnonzero(np.diff(g)) + 1] if len(g) else np.zeros(0, np.int64)
    place = np.arange(len(g)) - np.repeat(first, np.diff(np.r_[first, len(g)])) if len(g) else np.zeros(0, np.int64)
    out = table.take(pa.array(kept[order]))
    return pa.table({"g": out["g"], "k": pa.array((place + 1).astype(np.int32)), "i": out["i"], "p": out["p"], "s": out["s"]})


def _local_cutter(n: int, chunk_rows: int):
    """Cuts a stream of batches in any order; survivors may leave early, as they are cut again."""

    def run(batches):
        held, size, floor = [], 0, 0
        for batch in batches:
            held.append(pa.table(batch))
            size += batch.num_rows
            if size >= floor + chunk_rows:
                held = [cut(pa.concat_tables(held), n, False)]
                size = floor = held[0].num_rows
                if floor > chunk_rows:
                    yield from held[0].to_batches()
                    held, size, floor = [], 0, 0
        if held:
            yield from cut(pa.concat_tables(held), n, False).to_batches()

    return run


def _final_cutter(n: int, chunk_rows: int):
    """Cuts a stream of batches sorted by group: whole groups are passed on, the last one of a chunk waits,
    cut to its survivors."""

    def run(batches):
        held, size, floor = [], 0, 0
        for batch in batches:
            held.append(pa.table(batch))
            size += batch.num_rows
            if size >= floor + chunk_rows:
                rows = pa.concat_tables(held)
                waiting = pc.sum(pc.equal(rows["g"], rows["g"][-1])).as_py()
                over = rows.slice(0, rows.num_rows - waiting)
                if over.num_rows:
                    yield from cut(over, n, True).to_batches()
                held = [cut(rows.slice(over.num_rows), n, False)]
                size = floor = held[0].num_rows
        if held:
            yield from cut(pa.concat_tables(held), n, True).to_batches()

    return run


def top_n(df: DataFrame, group: str, item: str, priority: str, score: str, n: int, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(group, pos, item, priority, score): the first n distinct items of each group by priority
    ascending, score descending, item ascending (by UTF-8 bytes).

    Rows with a null group or item, or a null or NaN score, don't count; a null priority comes last.
    An item found several times counts once, by its best row; whole repeats count once.  An empty table
    gives no rows; other columns are ignored; a group with fewer than n items gives them all.
    """
    s = F.col(score).cast("double")
    rows = df.select(
        F.col(group).cast("string").alias("g"), F.col(item).cast("string").alias("i"),
        F.coalesce(F.col(priority).cast("bigint"), F.lit(2**63 - 1)).alias("p"), s.alias("s"),
    ).filter(F.col("g").isNotNull() & F.col("i").isNotNull() & F.col("s").isNotNull() & ~F.isnan("s"))
    local = rows.mapInArrow(_local_cutter(n, chunk_rows), _SCHEMA)
    final = local.repartition("g").sortWithinPartitions("g").mapInArrow(_final_cutter(n, chunk_rows), "g string, k int, i string, p bigint, s double")
    return final.select(
        F.col("g").alias("group"), F.col("k").alias("pos"), F.col("i").alias("item"),
        F.when(F.col("p") != 2**63 - 1, F.col("p")).alias("priority"), F.col("s").alias("score"),
    )
