"""The k best candidates of each author instance without a table of its pairs.

Instances are grouped by author id, then by name key; a group stays in one Python worker, large ones in slices
of anchors that each see the whole group.  What comes out are the k best of each anchor, already named, so no
pair is shuffled.  Within a large group only those candidates are scored that can be among the k best: all with
a common co-author, and of those without one the first k + 1 by the rest of the score, within the years, in the
same affiliation, and outside of the years in the same affiliation.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.functions.similarity import ratio_of
from weft.operators.mentions import INSTANCE_ORDER
from weft.plans.runtime import Scratch, default_parallelism

#: Anchors of a group that one task works on.
SLICE = 8192
#: Rows of whole groups that are worked on together.
CHUNK_ROWS = 20_000
#: Groups of so many ids, or names, take the plain way.
FEW_IDS, FEW_NAMES = 200, 24
#: Parts per shuffle partition, as the work of a part isn't told by its bytes.
PARTS = 4
#: Ids that may come several times are told by the bucket of their hash; this many buckets at most go to every task.
BUCKETS = 1 << 20
_ROW = "id string, author_id string, name_key string, year int, prefix string, u_coauthors array<string>, u_prefix string, u_name string, u_year int, u_frame string"
_FIRST = "first array<struct<id: string, score: double, year: int, frame: string>>"
_OUT = "anchor_id string, candidate_id string, best_pass_id string, best_block_key string, pass_priority int, score double, rank int, a_year_int int, c_year_int int, a_query_frame string, c_query_frame string"
_NO_YEAR = np.iinfo(np.int32).min


def _codes(column):
    """(code of each row, -1 for null; the distinct values)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    encoded = column.dictionary_encode()
    return encoded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary


def _filled(column):
    """Codes where '' counts as null."""
    code, values = _codes(column)
    empty = [i for i, x in enumerate(values.to_pylist()) if x == ""]
    return np.where(np.isin(code, empty), -1, code) if empty else code


class Names:
    """Subsequence ratios of one name to all names of a group: a word of 64 bits holds a part of a row of the table."""

    def __init__(self, names: list[str]):
        self.names = names
        self.order = np.array(sorted(range(len(names)), key=lambda i: -len(names[i])), np.int64)
        self.length = np.array([len(x) for x in names], np.int64)
        letters: dict[str, int] = {}
        top = int(self.length.max(initial=0))
        self.chars = np.zeros((top, len(names)), np.int64)
        for place, i in enumerate(self.order if len(names) > FEW_NAMES else ()):
            for j, x in enumerate(names[i]):
                self.chars[j, place] = letters.setdefault(x, len(letters) + 1)
        self.letters = letters
        by_length = self.length[self.order]
        self.active = [int(np.searchsorted(-by_length, -j)) for j in range(top)]  # so many are longer than j

    def common(self, name: str) -> np.ndarray:
        """Length of the longest common subsequence with each name."""
        words = -(-len(name) // 64)
        rows = np.full((words, len(self.names)), ~np.uint64(0))
        masks = np.zeros((words, len(self.letters) + 1), np.uint64)
        for i, x in enumerate(name):
            if x in self.letters:
                masks[i // 64, self.letters[x]] |= np.uint64(1 << (i % 64))
        for j, many in enumerate(self.active):
            chars, carry = self.chars[j, :many], None
            for w in range(words):
                row = rows[w, :many]
                hit = row & masks[w][chars]
                total = row + hit
                over = None if words == 1 else total < row
                if carry is not None:
                    total += carry
                    over |= total < carry
                carry = None if over is None else over.astype(np.uint64)
                rows[w, :many] = total | (row - hit)
        found = np.zeros(len(self.names), np.int64)
        for w in range(words):
            used = np.uint64((1 << min(64, len(name) - 64 * w)) - 1)
            found += np.bitwise_count(~rows[w] & used).astype(np.int64)
        out = np.empty_like(found)
        out[self.order] = found
        return out

    def ratios(self, i: int) -> np.ndarray:
        name = self.names[i]
        if len(self.names) <= FEW_NAMES:
            return np.array([ratio_of(name, x) for x in self.names])
        total = self.length + len(name)
        return np.where(total > 0, 2.0 * self.common(name) / np.maximum(total, 1), 1.0)


def _leading(ids: np.ndarray, score: np.ndarray | None, n: int) -> np.ndarray:
    """The first n of ascending ids by score descending, then id."""
    if len(ids) <= n:
        return ids
    if score is None:
        return ids[:n]
    least = -np.partition(-score, n - 1)[n - 1]
    above = ids[score > least]
    return np.concatenate([above, ids[score == least][: n - len(above)]])


class Chunk:
    """Whole groups, sorted by group and id, as numbers."""

    def __init__(self, table: pa.Table, k: int, window: int, with_names: bool):
        self.k, self.window, self.with_names = k, window, with_names
        n = table.num_rows
        key = _codes(table["key"])[0]
        part = table["slice"].to_numpy()
        self.anchor = table["anchor"].to_numpy()
        change = np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1 if n else np.zeros(0, np.int64)
        self.bounds = np.r_[0, change, n]
        self.listed = table["first"].combine_chunks() if "first" in table.column_names else None
        ids = table["id"].combine_chunks()
        self.list_at = np.zeros(n + 1, np.int64)
        if self.listed is not None:
            lengths = self.listed.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            self.list_at = np.r_[0, np.cumsum(lengths)]
            ids = pa.concat_arrays([ids, self.listed.flatten().field("id")])
        code = _codes(ids)[0]
        self.id, self.list_id = code[:n], code[n:]
        self.at = np.full(int(code.max(initial=-1)) + 1, -1, np.int64)
        self.year = table["year"].combine_chunks().fill_null(int(_NO_YEAR)).to_numpy(zero_copy_only=False).astype(np.int64)
        self.prefix, self.u_prefix = _filled(table["prefix"]), _filled(table["u_prefix"])
        self.prefixes = _codes(table["prefix"])[1]
        self.name, names = _codes(table["u_name"])
        self.names = names.to_pylist() if with_names else []
        lists = table["u_coauthors"].combine_chunks()
        owner = np.repeat(np.arange(n), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        who, people = _codes(lists.flatten())
        width = len(people) + 1
        pairs = np.unique(owner[who >= 0] * width + who[who >= 0])
        self.co_row, self.co = pairs // width, pairs % width
        self.co_at = np.searchsorted(self.co_row, np.arange(n + 1))

    def groups(self):
        for lo, hi in zip(self.bounds[:-1].tolist(), self.bounds[1:].tolist()):
            if hi - lo > 1 and self.anchor[lo:hi].any():
                yield Group(self, lo, hi)


class Group:
    """One block: its ids are numbers in their order."""

    def __init__(self, c: Chunk, lo: int, hi: int):
        self.c, self.lo, self.hi = c, lo, hi
        code = c.id[lo:hi]
        new = np.r_[True, code[1:] != code[:-1]]
        self.rows = lo + np.flatnonzero(new)  # first row of each id
        self.ends = np.r_[self.rows[1:], hi]
        self.repeated = len(self.rows) < hi - lo
        self.size = len(self.rows)
        self.u_prefix, self.year, self.prefix = c.u_prefix[self.rows], c.year[self.rows], c.prefix[self.rows]
        self.count = c.co_at[self.rows + 1] - c.co_at[self.rows]
        inside = slice(c.co_at[lo], c.co_at[hi])
        people, owners = c.co[inside], np.searchsorted(self.rows, c.co_row[inside], "right") - 1
        once = self.rows[owners] == c.co_row[inside]  # further rows of an id repeat its co-authors
        people, owners = people[once], owners[once]
        order = np.argsort(people, kind="stable")
        self.posted = owners[order]
        self.people, self.posted_at = np.unique(people[order], return_index=True)
        self.posted_at = np.r_[self.posted_at, len(order)]
        if c.with_names:
            known, self.name = np.unique(c.name[self.rows], return_inverse=True)
            self.compare = Names([c.names[i] for i in known])
            self.by_name = np.argsort(self.name, kind="stable")
            self.name_at = np.searchsorted(self.name[self.by_name], np.arange(len(known) + 1))
        self.plain = self.repeated or self.size <= max(FEW_IDS, c.k)
        self.everyone = np.arange(self.size)
        self.known: dict = {}
        self.found: dict = {}
        self.last_name = -1
        if not self.plain:
            self.same = {x: self._places(y) for x, y in (("u", self.u_prefix), ("e", self.prefix))}

    @staticmethod
    def _places(codes: np.ndarray) -> dict:
        order = np.argsort(codes, kind="stable")
        values, at = np.unique(codes[order], return_index=True)
        return {int(v): x for v, x in zip(values, np.split(order, at[1:])) if v >= 0}

    def near(self, year: int, of: np.ndarray) -> np.ndarray:
        return (np.abs(of - year) <= self.c.window) | (of == _NO_YEAR) if year != _NO_YEAR else np.ones(len(of), bool)

    def base(self, a: int) -> np.ndarray | None:
        """The name's part of the score with each name of the group."""
        if not self.c.with_names:
            return None
        if self.last_name != self.name[a]:
            self.last_name, self.last_base = int(self.name[a]), 0.55 * self.compare.ratios(int(self.name[a]))
        return self.last_base

    def anchors(self):
        """Ids that are anchors here, those of a name one after the other."""
        found = np.flatnonzero(np.logical_or.reduceat(self.c.anchor[self.lo : self.hi], self.rows - self.lo))
        return found[np.argsort(self.name[found], kind="stable")] if self.c.with_names else found

    def _nearest(self, year: int, base: np.ndarray | None) -> np.ndarray:
        """Of the ids within the years the first k + 1 by base descending and id."""
        n = self.c.k + 1
        key = (year, self.last_name)
        if key not in self.known:
            if base is None:
                found = np.flatnonzero(self.near(year, self.year))[:n]
            else:
                self.known = {k: v for k, v in self.known.items() if k[1] == self.last_name}
                found = self._nearest_names(year, base, n)
            self.known[key] = found
        return self.known[key]

    def _nearest_names(self, year: int, base: np.ndarray, n: int) -> np.ndarray:
        if 4 * n < len(base):
            if ("top", self.last_name) not in self.known:
                top = np.argpartition(-base, 4 * n)[: 4 * n]
                ids = np.sort(np.concatenate([self.by_name[self.name_at[i] : self.name_at[i + 1]] for i in top]))
                self.known["top", self.last_name] = ids, base[top].min()
            ids, least = self.known["top", self.last_name]
            ids = ids[self.near(year, self.year[ids])]
            score = base[self.name[ids]]
            if (score > least).sum() >= n:  # no name that was left out reaches the n best
                return _leading(ids, score, n)
        ids = np.flatnonzero(self.near(year, self.year))
        return _leading(ids, base[self.name[ids]], n)

    def _shared(self, a: int):
        """(ids with a common co-author, how many are common) of anchor a."""
        row = self.rows[a]
        own = np.searchsorted(self.people, self.c.co[self.c.co_at[row] : self.c.co_at[row + 1]])
        parts = [self.posted[self.posted_at[i] : self.posted_at[i + 1]] for i in own]
        if len(parts) < 2:  # an id is posted once for each of its co-authors
            ids = parts[0] if parts else self.posted[:0]
            return ids, np.ones(len(ids), np.int64)
        ids = np.concatenate(parts)
        if 4 * len(ids) < self.size:
            return np.unique(ids, return_counts=True)
        times = np.bincount(ids)
        ids = np.flatnonzero(times)
        return ids, times[ids]

    def _scores(self, a: int, ids: np.ndarray, shared: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Scores of ascending ids, which hold all of shared."""
        base, both = self.base(a), np.zeros(len(ids), np.int64)
        both[np.searchsorted(ids, shared)] = times
        union = self.count[a] + self.count[ids] - both
        score = 0.35 * np.where(union > 0, both / np.maximum(union, 1), 0.0)
        score = score + 0.10 * ((self.u_prefix[ids] == self.u_prefix[a]) & (self.u_prefix[a] >= 0))
        return score if base is None else base[self.name[ids]] + score

    def enough_near(self, a: int) -> bool:
        """Whether so many ids are within the years of anchor a that no other can be among its k best."""
        year = int(self.year[a])
        if not self.plain and ("many", year) not in self.found:
            self.found["many", year] = int(self.near(year, self.year).sum())
        return not self.plain and self.found["many", year] > self.c.k

    def leading_near(self, a: int):
        """(ids, scores) of the first k + 1 of the ids within the years of anchor a, which may be one of them."""
        c, row, n, year = self.c, self.rows[a], self.c.k + 1, int(self.year[a])
        same = (year, int(self.u_prefix[a]), int(self.name[a]) if c.with_names else -1, c.co[c.co_at[row] : c.co_at[row + 1]].tobytes())
        if same not in self.found:
            base = self.base(a)
            shared, times = self._shared(a)
            near = self.near(year, self.year[shared])
            shared, times = shared[near], times[near]
            own = self.same["u"].get(same[1], self.posted[:0])
            own = own[self.near(year, self.year[own])]
            own = _leading(own, None if base is None else base[self.name[own]], n)
            ids = np.unique(np.concatenate([shared, own, self._nearest(year, base)]))
            score = self._scores(a, ids, shared, times)
            if len(ids) > n:
                kept = np.sort(_leading(np.arange(len(ids)), score, n))
                ids, score = ids[kept], score[kept]
            self.found[same] = ids, score
        return self.found[same]

    def _possible(self, a: int, shared: np.ndarray) -> np.ndarray:
        """Ids that may be among the k best of anchor a."""
        if self.plain:
            return self.everyone
        n, base, year, nothing = self.c.k + 1, self.base(a), int(self.year[a]), self.posted[:0]
        own = self.same["u"].get(int(self.u_prefix[a]), nothing)
        own = own[self.near(year, self.year[own])]
        rest = self.same["e"].get(int(self.prefix[a]), nothing)
        rest = rest[~self.near(year, self.year[rest])]
        both = rest[self.u_prefix[rest] == self.u_prefix[a]]
        parts = [shared, self._nearest(year, base), rest, both, own]
        for i, more in ((2, 0.0), (3, 0.1), (4, 0.1)):
            parts[i] = _leading(parts[i], None if base is None else base[self.name[parts[i]]] + more, n)
        return np.unique(np.concatenate(parts))

    def scored(self, a: int, everyone: bool = False):
        """(ids, scores) of the possible candidates of anchor a; may hold a itself."""
        shared, times = self._shared(a)
        ids = self.everyone if everyone else self._possible(a, shared)
        return ids, self._scores(a, ids, shared, times)

    def passes(self, a: int, ids: np.ndarray):
        """(priority 2, 3, or 9 for none; code of the common prefix of priority 3) of the ids."""
        c, priority, prefix = self.c, np.full(len(ids), 9), np.full(len(ids), -1)
        if not self.repeated:
            year, own = int(self.year[a]), self.prefix[a]
            priority[(self.prefix[ids] == own) & (own >= 0)] = 3
            prefix[priority == 3] = own
            priority[self.near(year, self.year[ids])] = 2
            return priority, prefix
        text = c.prefixes.to_pylist()
        for x, i in enumerate(ids):
            mine, its = range(self.rows[a], self.ends[a]), range(self.rows[i], self.ends[i])
            common = [int(c.prefix[r]) for r in mine if c.prefix[r] >= 0 and (c.prefix[list(its)] == c.prefix[r]).any()]
            if common:
                priority[x], prefix[x] = 3, min(common, key=lambda p: text[p].encode())
            if any(self.near(int(c.year[r]), c.year[list(its)]).any() for r in mine):
                priority[x] = 2
        return priority, prefix


def _chunks(batches):
    """Tables of whole groups of a stream sorted by key and slice."""
    held, size, floor = [], 0, 0
    for batch in batches:
        held.append(pa.table(batch))
        size += batch.num_rows
        if size >= floor + CHUNK_ROWS:
            rows = pa.concat_tables(held)
            key, part = _codes(rows["key"])[0], rows["slice"].to_numpy()
            waiting = int(((key == key[-1]) & (part == part[-1])).sum())
            if waiting < size:
                yield rows.slice(0, size - waiting).combine_chunks()
            held, size = [rows.slice(size - waiting)], waiting
            floor = size
    if size:
        yield pa.concat_tables(held).combine_chunks()


def _id_finder(k: int, with_names: bool):
    """Adds to each anchor the k best of its author id."""

    def run(batches):
        for table in _chunks(batches):
            c = Chunk(table, k, 0, with_names)
            length, found, scores = np.zeros(table.num_rows, np.int64), {}, {}
            for g in c.groups():
                for a in g.anchors():
                    ids, score = g.scored(a, True)
                    ids, score = ids[ids != a], score[ids != a]
                    order = np.lexsort((ids, -score))[:k]
                    for row in range(g.rows[a], g.ends[a]):
                        found[row], scores[row], length[row] = g.rows[ids[order]], score[order], len(order)
            kept = np.flatnonzero(c.anchor)
            rows = np.concatenate([np.zeros(0, np.int64), *(found[r] for r in kept if length[r])])
            values = np.concatenate([np.zeros(0), *(scores[r] for r in kept if length[r])])
            of = pa.array(rows)
            parts = [table[x].take(of).combine_chunks() for x in ("id", "u_year", "u_frame")]
            inner = pa.StructArray.from_arrays([parts[0], pa.array(values), *parts[1:]], ["id", "score", "year", "frame"])
            out = table.select([x.split()[0] for x in _ROW.split(", ")]).take(pa.array(kept))
            out = out.append_column("first", pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(length[kept])].astype(np.int32)), inner))
            yield from out.to_batches(max_chunksize=10_000)

    return run


def _candidate_finder(k: int, window: int, with_names: bool):
    """The k best of each anchor: those of its author id, then those of its name key."""

    def run(batches):
        for table in _chunks(batches):
            c = Chunk(table, k, window, with_names)
            taken = np.diff(c.list_at)
            parts = []
            for g in c.groups() if table.num_rows else ():
                if not table["name_key"][g.lo].as_py():
                    continue
                c.at[c.id[g.rows]] = g.everyone
                for a in g.anchors():
                    have = np.unique(c.list_id[c.list_at[g.rows[a]] : c.list_at[g.ends[a]]])
                    left = k - len(have)
                    if left <= 0:
                        continue
                    enough = g.enough_near(a)
                    ids, score = g.leading_near(a) if enough else g.scored(a)
                    keep = ids != a
                    own = c.at[have]
                    if (own >= 0).any():
                        keep &= ~np.isin(ids, own)
                    priority, prefix = (np.full(len(ids), 2), np.full(len(ids), -1)) if enough else g.passes(a, ids)
                    keep &= priority < 9
                    ids, score, priority, prefix = ids[keep], score[keep], priority[keep], prefix[keep]
                    order = np.lexsort((ids, -score, priority))[:left]
                    parts.append((np.full(len(order), g.rows[a]), g.rows[ids[order]], priority[order], score[order], prefix[order], len(have) + 1 + np.arange(len(order))))
                c.at[c.id[g.rows]] = -1
            if c.list_at[-1]:
                inner, rows = c.listed.flatten(), np.repeat(np.arange(table.num_rows), taken)
                rank = np.arange(len(rows)) - np.repeat(c.list_at[:-1], taken) + 1
                yield from _named(table, rows, inner.field("id"), 1, inner.field("score"), None, rank, inner.field("year"), inner.field("frame"))
            for i in range(0, len(parts), 1000):
                anchor, other, priority, score, prefix, rank = (np.concatenate(x) for x in zip(*parts[i : i + 1000]))
                of = pa.array(other)
                text = c.prefixes.take(pa.array(np.maximum(prefix, 0), mask=prefix < 0)) if len(c.prefixes) else pa.nulls(len(prefix), pa.string())
                yield from _named(table, anchor, table["id"].take(of), priority, pa.array(score), text, rank, table["u_year"].take(of), table["u_frame"].take(of))

    def _named(table, anchor, candidate, priority, score, prefix, rank, year, frame):
        import pyarrow.compute as pc

        rows = table.select(["id", "author_id", "name_key", "u_year", "u_frame"]).take(pa.array(anchor))
        if prefix is None:
            passes, block = pa.array(["pass1_author_id"] * len(anchor), pa.string()), pc.binary_join_element_wise("author_id:", rows["author_id"], "")
        else:
            second = pa.array(priority == 2)
            passes = pc.if_else(second, "pass2_name_key", "pass3_name_key_affil")
            block = pc.if_else(second, pc.binary_join_element_wise("name_key:", rows["name_key"], ""), pc.binary_join_element_wise(pc.binary_join_element_wise("name_key_affil:", rows["name_key"], ""), prefix, "|"))
        priority = pa.array(np.broadcast_to(np.asarray(priority, np.int32), len(anchor)))
        columns = [rows["id"], candidate, passes, block, priority, score, pa.array(rank.astype(np.int32)), rows["u_year"], year, rows["u_frame"], frame]
        yield from pa.table(columns, names=[x.split()[0] for x in _OUT.split(", ")]).to_batches(max_chunksize=10_000)

    return run


def _sliced(rows: DataFrame, instances: DataFrame, column: str) -> DataFrame:
    """Rows by key (the column, else the id) and slice, sorted by id; anchor: the slice's own rows, the others are
    the rest of the group.  Rows without the column have no group, so each is alone."""
    large = instances.filter(F.col(column) != "").groupBy(F.concat(F.lit("k|"), F.col(column)).alias("key")).agg(F.ceil(F.count(F.lit(1)) / SLICE).cast("int").alias("slices")).filter("slices > 1")
    keyed = rows.withColumn("key", F.concat(F.lit("k|"), F.nullif(column, F.lit(""))))
    cut = keyed.join(F.broadcast(large), "key", "left").withColumn("slices", F.coalesce("slices", F.lit(1))).drop("key")  # at most one key for SLICE rows
    cut = cut.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).withColumn("anchor", F.pmod(F.xxhash64("id"), F.col("slices")) == F.col("slice"))
    if "first" in rows.columns:  # author ids are read of anchors alone then
        cut = cut.withColumn("author_id", F.when(F.col("anchor"), F.col("author_id"))).withColumn("first", F.when(F.col("anchor"), F.transform("first", lambda x: x.withField("id", _short(x["id"])))))
    group = F.when(F.col(column) != "", F.xxhash64(column)).otherwise(F.xxhash64("id"))
    moved = cut.drop("slices").withColumn("id", _short(F.col("id"))).repartition(PARTS * default_parallelism(rows.sparkSession), group, "slice")
    back = moved.withColumn("id", _long(F.col("id")))
    if "first" in rows.columns:
        back = back.withColumn("first", F.transform("first", lambda x: x.withField("id", _long(x["id"]))))
    key = F.when(F.col(column) != "", F.concat(F.lit("k|"), F.col(column))).otherwise(F.concat(F.lit("n|"), "id"))
    return back.withColumn("key", key).sortWithinPartitions("key", "slice", "id")


def _short(text: Column) -> Column:
    """A text as bytes, half as many if it is hexadecimal, as hashes are; for the way through a shuffle."""
    return F.when(text.rlike("^([0-9a-f]{2})+$"), F.concat(F.lit(b"\x01"), F.unhex(text))).otherwise(F.concat(F.lit(b"\x00"), text.cast("binary")))


def _long(short: Column) -> Column:
    rest = F.substring(short, 2, 2**31 - 1)
    return F.when(F.substring(short, 1, 1) == F.lit(b"\x01"), F.lower(F.hex(rest))).otherwise(rest.cast("string"))


def _bucket() -> Column:
    return F.pmod(F.xxhash64("author_instance_id"), F.lit(BUCKETS)).cast("int").alias("bucket")


def _again(instances: DataFrame) -> DataFrame:
    """(bucket): of the ids that come several times, as a written table; all ids of other buckets come once."""
    hashes = instances.filter("author_instance_id is not null").groupBy(F.xxhash64("author_instance_id").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    return Scratch(instances.sparkSession, "again").keep(hashes.filter("n > 1").select(F.pmod("h", F.lit(BUCKETS)).cast("int").alias("bucket")).distinct())


def _rows(instances: DataFrame, name: str, again: DataFrame | None = None) -> DataFrame:
    """The distinct keys of each instance that aren't truncated, with what is scored: that of its first row.

    Only rows of ids that may come several times are brought together by id, the others stay where they are."""
    again = _again(instances) if again is None else again
    known = instances.filter("author_instance_id is not null").withColumn("_b", _bucket())
    once, several = (known.join(F.broadcast(again), F.col("_b") == F.col("bucket"), how) for how in ("left_anti", "left_semi"))
    own = F.struct(F.col("author_id"), F.col("name_key"), F.col("year_int").alias("year"), F.col("record_affil_prefix").alias("prefix"))
    first = F.min(F.struct(*dict.fromkeys([*INSTANCE_ORDER, name]), "coauthor_keys"))
    one = several.groupBy(F.col("author_instance_id").alias("id")).agg(F.collect_set(F.when(~F.col("truncation_flag"), own)).alias("own"), first.alias("u"))
    scored = lambda u: (F.col(f"{u}coauthor_keys").alias("u_coauthors"), F.col(f"{u}record_affil_prefix").alias("u_prefix"), F.coalesce(f"{u}{name}", F.lit("")).alias("u_name"), F.col(f"{u}year_int").alias("u_year"), F.col(f"{u}query_frame").alias("u_frame"))
    together = one.select("id", F.explode("own").alias("e"), "u").select("id", "e.*", *scored("u."))
    return once.filter(~F.col("truncation_flag")).select(F.col("author_instance_id").alias("id"), "author_id", "name_key", F.col("year_int").alias("year"), F.col("record_affil_prefix").alias("prefix"), *scored("")).unionByName(together)


def _any_id_has_several_keys(instances: DataFrame, again: DataFrame) -> bool:
    keys = F.xxhash64(*(F.struct(F.col(x)) for x in ("author_id", "name_key", "year_int", "record_affil_prefix")), *(F.col(x).isNull() for x in ("author_id", "name_key", "year_int", "record_affil_prefix")))
    several = instances.filter(~F.col("truncation_flag")).withColumn("_b", _bucket()).join(F.broadcast(again), F.col("_b") == F.col("bucket"), "left_semi")
    of = several.groupBy(F.xxhash64("author_instance_id").alias("id")).agg(F.min(keys).alias("a"), F.max(keys).alias("b"))
    return bool(of.filter("a <> b").limit(1).collect())


def best_pairs(instances: DataFrame, k: int, year_window: int, with_names: bool, name: str = "author_norm") -> DataFrame:
    """(anchor_id, candidate_id, best_pass_id, best_block_key, pass_priority, score, rank, years and query frames
    of both): the k best of each anchor among the pairs of ``blocking.author_pairs``, by 0.35 co-author Jaccard +
    0.10 same affiliation prefix, with_names also + 0.55 name ratio."""
    again = _again(instances)
    rows = _rows(instances, name, again)
    if not with_names:  # not read, so not moved either
        rows = rows.withColumns({"u_name": F.lit(""), "u_year": F.lit(None).cast("int"), "u_frame": F.lit(None).cast("string")})
    by_id = _sliced(rows.filter("author_id <> ''"), instances, "author_id").mapInArrow(_id_finder(k, with_names), f"{_ROW}, {_FIRST}")
    alone = rows.filter("author_id is null or author_id = ''").withColumn("first", F.array().cast(_FIRST.split(" ", 1)[1]))
    by_id = by_id.unionByName(alone)
    found = _sliced(by_id, instances, "name_key").mapInArrow(_candidate_finder(k, year_window, with_names), _OUT)
    if not _any_id_has_several_keys(instances, again):
        return found
    # an id with several keys is in several groups: the best k of each of them hold its best k
    best = F.min_by(F.struct("best_pass_id", "best_block_key", "pass_priority", "score", "a_year_int", "c_year_int", "a_query_frame", "c_query_frame"), F.struct("pass_priority", "best_block_key"))
    one = found.groupBy("anchor_id", "candidate_id").agg(best.alias("b")).select("anchor_id", "candidate_id", "b.*")
    order = W.partitionBy("anchor_id").orderBy("pass_priority", F.col("score").desc(), "candidate_id")
    return one.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(*found.columns)
