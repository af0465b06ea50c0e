"""All pairs of author instances, each made once where it belongs, against one row of the best pass per pair."""

import io
import random
from contextlib import redirect_stdout

import pytest
from test_best_pairs import instances

from weft.operators import blocking

COLUMNS = ["anchor_id", "candidate_id", "best_pass_id", "best_block_key", "pass_priority"]


@pytest.mark.parametrize("several, cell", [(True, 4096), (True, 30), (False, 50)])
def test_pairs_of_all_passes(spark, monkeypatch, several, cell):
    monkeypatch.setattr(blocking, "CELL", cell)
    df = instances(spark, 250, several, random.Random(cell))
    # 'doe|j' + 'lab a' and 'doe' + 'j|lab a' are one key of the third pass, of two names
    odd = [("o1", "", "doe|j", 1990, "lab a", None, False), ("o2", "", "doe", 1990, "j|lab a", None, False), (None, "1", "doe|j", 2001, "lab a", None, False), ("o3", "1", "doe|j", 2001, "", None, None)]
    df = df.unionByName(spark.createDataFrame(odd, df.select("author_instance_id", "author_id", "name_key", "year_int", "record_affil_prefix", "coauthor_keys", "truncation_flag").schema), True)
    numbers = blocking.numbered(df.select("author_instance_id"))
    slow = blocking.with_names(blocking.author_number_pairs(blocking.with_numbers(df, "author_instance_id", numbers)), ["anchor_id", "candidate_id"], numbers)
    fast = blocking.author_pairs(df)
    assert fast.columns == COLUMNS
    got = sorted(map(str, fast.collect()))
    assert got == sorted(map(str, slow.select(COLUMNS).collect())) and len(got) > 1000


def test_pairs_are_not_shuffled(spark):
    out = io.StringIO()
    with redirect_stdout(out):
        blocking.author_pairs(instances(spark, 20, True, random.Random(1))).explain()
    above = out.getvalue().split("SortMergeJoin")[0]
    assert "Exchange" not in above and "Aggregate" not in above
