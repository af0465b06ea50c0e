import pytest
from pyspark.sql import functions as F

from weft.llm import lookalikes

WORDS = "tineutor hisneran zelnisris université técnica of school gakelmi больница гугансорфина институт школа мелсо".split(" ")
CASES = {
    "Ｄｉｒａｊ": "Diraj", "t𝐢𝐧𝐞utor": "tineutor", "técnica": "técnica", "técn⁠ica": "técnica", "sch­ool": "school", "a　b": "a b", "x y": "x y", "leﬁmeri": "lefimeri",
    "hіsneran": "hisneran", "zelnisrіѕ": "zelnisris", "ɑgakelmi": "agakelmi", "больница": "больница", "мелсо": "мелсо", "бoльница": "больница", "plain": "plain", "université": "université",
    "оf": "of", "сор": "сор", "": "",
}


@pytest.fixture(scope="module")
def cells(spark):
    rows = [(i, w, None) for i, w in enumerate(WORDS * 20)] + [(1000 + i, x, y) for i, (x, y) in enumerate(CASES.items())] + [(5000, None, None), (5001, "l" * 50000 + " hіsneran", None)]
    return spark.createDataFrame(rows, "n int, f string, expected string").withColumn("text", F.lit(1)).withColumn("k0", F.lit("x"))


@pytest.mark.parametrize("only_changed", [False, True])
def test_cases(spark, cells, only_changed):
    got = {r.n: r for r in lookalikes.unified(cells, ["n"], ["f"], only_changed).collect()}
    for i, (x, y) in enumerate(CASES.items()):
        if only_changed and x == y:
            assert 1000 + i not in got
        else:
            assert got[1000 + i].canonical == y, (x, got[1000 + i].canonical)
            assert got[1000 + i].changed == (x != y)
    assert 5000 not in got and got[5001].canonical.endswith(" hisneran")
    assert not any(got[i].changed for i in range(len(WORDS * 20)) if i in got)


def test_capitals():
    model = lookalikes.Trigrams({})
    assert lookalikes.canonical("UNIVЕRSITУ", model)[:8] == "UNIVERSI" and lookalikes.canonical("Sоran", model) == "Soran"
    assert lookalikes.canonical("ПРИВЕТ", model) == "ПРИВЕТ" and lookalikes.canonical("ılık", model) == "ılık"


def test_two_fields_and_repeated_words(spark):
    df = spark.createDataFrame([(1, "hіs hіs ok", "ｘ"), (1, None, "ok")], "n int, a string, b string")
    got = sorted((r.field, r.canonical) for r in lookalikes.unified(df, ["n"], ["a", "b"]).collect())
    assert ("a", "his his ok") in got and ("b", "ok") in got


def test_empty(spark, cells):
    assert lookalikes.unified(cells.limit(0), ["n"], ["f"]).count() == 0
