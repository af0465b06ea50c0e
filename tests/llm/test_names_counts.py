"""Spellings are linked whatever the number of their mentions."""

import pytest
from pyspark.sql import functions as F

from weft.llm import names


@pytest.mark.parametrize("times", [1, 10])
def test_mentions_dont_cut(spark, times):
    spellings = {"Vofisku, Betis Norse": 5, "Voffisku, Betis N.": 3, "Torlopis, Bena": 14, "Toerlopis, B.": 4, "Vofisku, Zanlu": 3}
    rows = [(f"{n}/{i}", n) for n, k in spellings.items() for i in range(k * times)]
    df = spark.createDataFrame(rows, "id string, raw string").withColumn("pid", F.lit(""))
    aliases = spark.createDataFrame([], "alias string, given_name string")
    found = {}
    for r in names.link_people(df, "id", "raw", "pid", aliases, "alias", "given_name").collect():
        found.setdefault(r.cluster, set()).add(r.id.split("/")[0])
    assert sorted(map(sorted, found.values())) == [["Toerlopis, B.", "Torlopis, Bena"], ["Voffisku, Betis N.", "Vofisku, Betis Norse"], ["Vofisku, Zanlu"]]


def test_cosine_and_exact_check():
    v = names.Vectors({}, 10)
    assert v.alike("informatiks", "niformatiks") > 0.5 and v.alike("panhafina", "panzafina") > 0.5
    assert v.alike("soran", "sarun") == 0.0 and v.alike("deurishobor", "deurisfodor") == 0.0 and v.alike("abc", "abd") == 0.0


def test_misspelt():
    assert names._misspelt(1, 1) and names._misspelt(13, 39) and not names._misspelt(10, 16) and not names._misspelt(100, 160)
