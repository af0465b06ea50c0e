"""Filling containers of fixed capacity by sum-of-squares online packing.

Items arrive one after another.  A level array holds how many open containers have each fill level; an
item goes to the level (or to a new container) that leaves the smallest sum of squared counts over
partially filled levels, which keeps levels varied enough to be completed by later items.  An item
larger than the capacity fills whole containers by itself; only its rest is placed as an item.

The stream is cut by hash into independent lanes of about ``lane_tokens`` (at most about LANE_ITEMS
items) each, a fixed amount of work at any corpus size; per lane only the containers still open at its end can hold waste, and those are
packed once more, fullest first, by the same rule.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.plans.runtime import Scratch

LANE_TOKENS, LANE_ITEMS = 16_000_000, 200_000


class Packer:
    """The level array and the open containers of one lane."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)  # count[h]: open containers of level h; 0 and capacity stay 0
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.level: list[int] = []

    def place(self, size: int) -> tuple[int, int]:
        """(container, offset) for an item of 0 < size <= capacity."""
        n, cap = self.count, self.capacity
        # change of the sum of squares when a container moves from level h to h + size
        top = cap - size
        gain_new = 2 * n[size] + 1 if size < cap else 0
        best, cost = 0, gain_new
        if top >= 1:
            h = np.flatnonzero(n[1 : top + 1]) + 1
            if len(h):
                into = np.where(h + size < cap, 2 * n[np.minimum(h + size, cap)] + 1, 0)
                change = into - 2 * n[h] + 1
                i = len(h) - 1 - int(np.argmin(change[::-1]))  # ties: the fullest container
                if change[i] <= cost:
                    best, cost = int(h[i]), int(change[i])
        if best:
            container = self.open[best].pop()
            n[best] -= 1
        else:
            container = len(self.level)
            self.level.append(0)
        offset = self.level[container]
        self.level[container] = full = offset + size
        if full < cap:
            n[full] += 1
            self.open[full].append(container)
        return container, offset

    def merge_open(self) -> dict[int, tuple[int, int]]:
        """Packs the open containers once more: container -> (container it moves into, offset added)."""
        waiting = sorted((c for level in self.open for c in level), key=lambda c: (-self.level[c], c))
        again, moved, places = Packer(self.capacity), {}, []
        for c in waiting:
            into, offset = again.place(self.level[c])
            if into == len(places):
                places.append(c)
            moved[c] = (places[into], offset)
        return moved


def pack_items(keys, sizes, capacity: int) -> pd.DataFrame:
    """key, part, start, length, container, offset; sizes > 0, in the order given."""
    packer, rows = Packer(capacity), []
    for key, size in zip(keys, sizes):
        part = start = 0
        while size - start > capacity:
            container, offset = len(packer.level), 0
            packer.level.append(capacity)
            rows.append((key, part, start, capacity, container, offset))
            part, start = part + 1, start + capacity
        container, offset = packer.place(size - start)
        rows.append((key, part, start, size - start, container, offset))
    moved = packer.merge_open()
    out = [(k, p, s, n, *((moved[c][0], moved[c][1] + o) if c in moved else (c, o))) for k, p, s, n, c, o in rows]
    return pd.DataFrame(out, columns=["key", "part", "start", "length", "container", "offset"])


def pack(sized: DataFrame, key: str, size: str, capacity: int, lane_tokens: int = LANE_TOKENS) -> DataFrame:
    """(key, part, start, length, container, offset): where each item's tokens lie.

    container is "lane-number".  Items of size 0 or null take no space: one row with length 0 and null
    container and offset.  A larger item than ``capacity`` has several parts, whole ones first.  Equal
    items are placed in the order of hash and key.  ``key`` is unique.  Empty tables give no rows.
    """
    if capacity < 1:
        raise ValueError("the capacity must be at least 1")
    rows = Scratch(sized.sparkSession, "packing").keep(sized.select(F.col(key).alias("key"), F.coalesce(F.col(size).cast("bigint"), F.lit(0)).alias("size")))
    total = rows.agg(F.sum("size").alias("tokens"), F.count_if(F.col("size") > 0).alias("items")).first()
    lanes = max(1, round((total.tokens or 0) / lane_tokens), -(-total.items // LANE_ITEMS))
    kind = rows.schema["key"].dataType
    schema = T.StructType(
        [T.StructField("key", kind), *(T.StructField(c, T.IntegerType()) for c in ("part", "start", "length")), T.StructField("container", T.StringType()), T.StructField("offset", T.IntegerType())]
    )

    def lane(number: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "key"])
        out = pack_items(pdf["key"].tolist(), pdf["size"].tolist(), capacity)
        out["container"] = str(number[0]) + "-" + out["container"].astype(str)
        return out

    hashed = rows.filter("size > 0").withColumn("h", F.xxhash64("key")).withColumn("lane", F.pmod("h", F.lit(lanes)))
    placed = hashed.groupBy("lane").applyInPandas(lane, schema)
    empty = rows.filter("size <= 0").select(
        "key", *(F.lit(0).alias(c) for c in ("part", "start", "length")), F.lit(None).cast("string").alias("container"), F.lit(None).cast("int").alias("offset")
    )
    return placed.unionByName(empty).withColumnRenamed("key", key)
