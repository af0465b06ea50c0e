"""Occurrences and records of every n-gram of terms by suffix sorting.

Each position of a record's term sequence emits one suffix, truncated to ``max_n`` terms.  Suffixes are
routed by their first term (and a slice of the record's hash, see below), sorted in reverse
lexicographic order within a task, and scanned once with a stack: when the next suffix leaves a prefix,
its occurrences and record set are final, are written out, and are folded into its parent.

Routing by first term alone would send a frequent term to one task with its whole record set.  So the
route also has one of ``slices`` slices of the record hash (by default as many as the session has
shuffle partitions, at least SLICES): the slices of a term have disjoint records, hence their record
counts add up, and only (n-gram, counts) rows meet in the final sum.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.plans.runtime import default_parallelism

SLICES = 16


def _scan(batches):
    """Sorted (suffix, record) batches to (gram, cf, df); see the module's text."""
    stack: list[list] = []  # [term, occurrences, records]
    grams, counts, records = [], [], []

    def close(depth):
        while len(stack) > depth:
            _, count, seen = stack.pop()
            grams.append([x[0] for x in stack] + [_])
            counts.append(count)
            records.append(len(seen))
            if stack:
                stack[-1][1] += count
                stack[-1][2] |= seen

    def flush():
        out = pa.RecordBatch.from_arrays(
            [pa.array(grams, pa.list_(pa.string())), pa.array(counts, pa.int64()), pa.array(records, pa.int64())], ["gram", "cf", "df"]
        )
        grams.clear(), counts.clear(), records.clear()
        return out

    for batch in batches:
        for suffix, record in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            same = 0
            while same < len(stack) and same < len(suffix) and stack[same][0] == suffix[same]:
                same += 1
            close(same)
            stack.extend([term, 0, set()] for term in suffix[same:])
            top = stack[-1]
            top[1] += 1
            if record is not None:
                top[2].add(record)
        if len(grams) > 20_000:
            yield flush()
    close(0)
    yield flush()


def gram_counts(df: DataFrame, sequence: str, record: str, max_n: int, slices: int | None = None) -> DataFrame:
    """(gram array<string>, occurrences, records) of every n-gram, n from 1 to max_n.

    sequence: array<string>; null arrays and null elements give nothing (n-grams don't span a null
    element: it is left out before).  A null record id counts as an occurrence, not as a record; rows
    with one record id are one record.  Repeated rows count.  Empty tables give no rows.
    """
    slices = slices or max(SLICES, default_parallelism(df.sparkSession))
    terms = F.filter(F.col(sequence), lambda t: t.isNotNull())
    rows = df.select(terms.alias("terms"), F.col(record).cast("string").alias("record")).filter(F.size("terms") > 0)
    suffix = F.transform(F.sequence(F.lit(1), F.size("terms")), lambda i: F.slice("terms", i, F.least(F.lit(max_n), F.size("terms") - i + 1)))
    exploded = rows.select(F.explode(suffix).alias("suffix"), F.col("record"))
    routed = (
        exploded.withColumn("slice", F.pmod(F.xxhash64("record"), F.lit(slices)))
        .repartition(F.col("suffix")[0], "slice")
        .sortWithinPartitions(F.col("suffix").desc())
    )
    scanned = routed.select("suffix", "record").mapInArrow(_scan, "gram array<string>, cf bigint, df bigint")
    return scanned.groupBy("gram").agg(F.sum("cf").alias("occurrences"), F.sum("df").alias("records"))


def marked(counts: DataFrame, total_records, min_records: int, max_share: float) -> DataFrame:
    """Adds mark: 'rare' under min_records records, else 'common' above max_share of total_records
    (a scalar Column), else null."""
    return counts.withColumn(
        "mark",
        F.when(F.col("records") < min_records, "rare").when(F.col("records") > F.lit(max_share) * total_records, "common"),
    )
