"""Label rule as a table of cases, and properties that hold for any text."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowlens.functions.labels import label_to_binary

CASES = {
    None: [None, "", "  ", "<NA>", "nan", "None", "NULL", "unknown", " Unknown "],
    0: [" Benign ", "normal", "LEGITIMATE", "legit", "nonattack", "non_attack", "clean", "false", "F", "no", "0", "0.0", "-0", "0e5",
        "anomaly", "dos10", "benign traffic", "unknown2no"],
    1: ["TRUE", "t", "2", "1e3", "inf", "-3.5", "slowite", "malformed", "bruteforce", "flood", "attack", "yes", "tru", "ddos"],
}


def labelled(spark, values, **options):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r["b"] for r in rows.select("k", label_to_binary(F.col("v"), **options).alias("b")).orderBy("k").collect()]


@pytest.mark.parametrize("want", CASES)
def test_cases(spark, want):
    assert labelled(spark, CASES[want]) == [want] * len(CASES[want])


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="abcdefilmnorstu0123456789 ._-", max_size=8), min_size=1, max_size=40))
def test_case_and_outer_spaces_do_not_matter(spark, values):
    assert labelled(spark, values) == labelled(spark, [f"  {v.upper()} " for v in values])


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="xyz", min_size=1, max_size=8), min_size=1, max_size=20), st.sampled_from(["benign", "normal", "legit", "clean"]))
def test_a_benign_token_inside_decides(spark, values, token):
    assert labelled(spark, values) == [1] * len(values)
    assert labelled(spark, [v + token + v for v in values]) == [0] * len(values)


def test_label_map(spark):
    df = spark.createDataFrame([("error",), ("click",), (None,)], "v string")
    got = [r[0] for r in df.select(label_to_binary(F.col("v"), label_map={"error": 1}, default=0)).collect()]
    assert got == [1, 0, None]


def test_token_mode(spark):
    df = spark.createDataFrame([("anomaly",), ("dos10",), ("no attack",), ("benign-traffic",)], "v string")
    got = [r[0] for r in df.select(label_to_binary(F.col("v"), match="token")).collect()]
    assert got == [1, 1, 0, 0]  # whole words only: 'no attack' and 'benign-traffic' contain a benign word
