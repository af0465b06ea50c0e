"""Scalar functions: literal cases, nulls and boundaries."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weft.functions import similarity as sim
from weft.functions import text


def values(spark, rows, expr, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(v,) if not isinstance(v, tuple) else v for v in rows], schema).select(expr).collect()]


def test_normalise(spark):
    got = values(spark, ["  Ａb  C ", None, "ﬁeld!!", "a--b", "STRASSE ß", "x y"], text.normalise_text(F.col("x")))
    assert got == ["ab c", "", "field!", "a-b", "strasse ss", "x y"]


def test_label_text(spark):
    assert values(spark, ["NaN", "none", None, "Ab  c", "a--b"], text.normalise_label_text(F.col("x"))) == ["", "", "", "ab c", "a--b"]


def test_acronyms(spark):
    rows = ["Univ (UM6P), CNRS, CNRS", "VI II MIT", None, "", "2025 IEEE al-Ain", "[ABC-] XYZ"]
    assert values(spark, rows, text.acronyms(F.col("x"))) == [["UM6P", "CNRS"], ["MIT"], [], [], ["IEEE"], ["ABC", "XYZ"]]


def test_ids(spark):
    rows = ["Doe, J. (123456)", "Lab (LMCE)", "a (12345)", "x (1234567890) y (123456)", None, ""]
    assert values(spark, rows, text.strip_numeric_id(F.col("x"))) == ["Doe, J.", "Lab (LMCE)", "a (12345)", "x y", None, ""]
    assert values(spark, ["a (1) b", "c (22)"], text.strip_any_id(F.col("x"))) == ["a  b", "c"]
    assert values(spark, ["a (1) b (2)"], text.strip_trailing_id(F.col("x"))) == ["a (1) b"]


def test_keys_and_tokens(spark):
    assert values(spark, ["doe, john", "", None, "solo"], text.name_key(F.col("x"))) == ["john|d", "", "", "solo|s"]
    assert values(spark, ["a b c d"], text.first_words(F.col("x"), 3)) == ["a b c"]
    assert values(spark, ["Mohammed VI University"], text.token_set(F.col("x"))) == [["mohammed", "vi", "university"]]
    assert values(spark, ["A bb a"], text.token_set(F.col("x"))) == [["bb"]]
    assert values(spark, [" a ;; b; "], text.split_list(F.col("x"))) == [["a", "b"]]
    assert values(spark, ["a (123456) | … | b | b"], text.pipe_set(F.col("x"))) == [["a", "b"]]
    assert values(spark, ["um6p | cnrs | …"], text.pipe_acronyms(F.col("x"))) == [["UM6P", "CNRS"]]


def test_labels_and_numbers(spark):
    assert values(spark, ["Same", " NO ", "1", "what", None], text.label_class(F.col("x"))) == ["match", "non-match", "match", "", ""]
    assert values(spark, ["1"], text.label_class(F.col("x"), digits=False)) == [""]
    assert values(spark, ["2020", "2020.0", "20.5", "x", None, ""], text.safe_int(F.col("x"))) == [2020, 2020, None, None, None, None]
    assert values(spark, ["1.0", "2", "3", "", None], text.label_code(F.col("x"))) == ["1", "2", None, None, None]
    assert values(spark, ["k sk-ant-abcdefghij12"], text.redact_key(F.col("x"))) == ["k [REDACTED]"]
    assert values(spark, ["abcdef", "abc", None], text.truncate(F.col("x"), 4)) == ["abc…", "abc", None]


def lcs_slow(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            row[j], last = (last + 1 if x == y else max(row[j], row[j - 1])), row[j]
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abcd é", max_size=12), st.text("abcd é", max_size=12))
def test_lcs_against_table(a, b):
    assert sim.lcs_length(a, b) == lcs_slow(a, b)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["ab", "b", "abc", "cd"]), max_size=4), st.lists(st.sampled_from(["ab", "b", "abc", "cd"]), max_size=4))
def test_token_set_against_definition(a, b):
    x, y = set(a), set(b)
    got = sim.token_set_of(" ".join(a), " ".join(b))
    if not x or not y:
        assert got == 0.0
        return
    common = " ".join(sorted(x & y))
    left, right = (" ".join(filter(None, [common, " ".join(sorted(d))])) for d in (x - y, y - x))
    if common and (x <= y or y <= x):
        assert got == 1.0
    else:
        pairs = [(left, right)] + ([(common, left), (common, right)] if common else [])
        assert got == pytest.approx(max(sim.ratio_of(p, q) for p, q in pairs))


def test_ratios(spark):
    df = spark.createDataFrame([("ab cd", "cd ab"), ("", ""), (None, "a"), ("kitten", "sitting")], "a string, b string")
    got = df.select(sim.ratio(F.col("a"), F.col("b")), sim.token_sort_ratio(F.col("a"), F.col("b")), sim.token_set_ratio(F.col("a"), F.col("b"))).collect()
    assert got[0][1:] == (1.0, 1.0) and got[1][:2] == (1.0, 1.0) and got[1][2] == 0.0 and got[2][0] == 0.0
    assert got[3][0] == pytest.approx(1 - 5 / 13)


def test_jaccard_and_cosine(spark):
    df = spark.createDataFrame([(["a", "b"], ["b"]), ([], []), (None, ["a"])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(sim.jaccard(F.col("a"), F.col("b"))).collect()] == [0.5, 0.0, 0.0]
    v = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0])], "a array<float>, b array<float>")
    assert v.select(sim.cosine(F.col("a"), F.col("b"))).first()[0] == pytest.approx(0.5)
