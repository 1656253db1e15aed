import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logweave.functions import distance, hashing, kernels, masking, tokens


def column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("s"))).collect()]


@pytest.mark.parametrize(
    ("mask", "cases"),
    [
        (masking.NUMBER, {"3.14 x=5 a 1 2 3 c:\\7": "3.$v x=$v a $v $v $v c:\\$v"}),
        (masking.HEX, {"é0xff 0xff": "é$v $v"}),
        (masking.LIBVIRTD, {"2018-05-02 12:41:35.123+0000: 77: hi": "$v hi", "x": "x"}),
        (masking.AGGRESSIVE_NUMBER, {"a-5 b7 8": "a$v b7 $v"}),
        (masking.SEPARATION, {"a=b,c": "a= b, c"}),
        (masking.UUID, {"id {12345678-1234-1234-1234-123456789abc} z": "id {$v} z"}),
        (
            masking.IPV6,
            {
                "2001:db8::2:1": "$v", "[2001:db8::1]:80": "$v", "[::1]": "[$v]", "a :: b": "a :: b", "12:34:56": "12:34:56", "aa:bb:cc:dd:ee:ff": "aa:bb:cc:dd:ee:ff",
                "std::vector": "std::vector", "abc::def(": "$v(", "::ffff:1.2.3.4": "$v.2.3.4", "1:2:3:4:5:6:7:8": "$v", "1:2:3:4:5:6:7:8:9": "1:2:3:4:5:6:7:8:9", "fe80:: up": "$v up", "x [fe80::1] y [fe80::2]:7 z": "x [$v] y $v z",
            },
        ),
    ],
)
def test_masks(spark, mask, cases):
    assert column(spark, list(cases), mask) == list(cases.values())


def test_chain_runs_in_reverse_and_nulls_stay(spark):
    cases = {
        "[abc] <def>": "[$v] <$v>", "audit(1525.123:77)": "audit($v)", "12 KB in 3.5 ms via eth0": "$v in $v via $v", "10.0.0.1:80 aa:bb:cc:dd:ee:ff": "$v $v",
        "2018-05-02 12:41:35.123+0000: 77: hi": "$v.123+0000: $v: hi", "Wed May 02 2018 12:41:35 CET": "$v", "": "",
    }
    assert column(spark, [*cases, None], masking.DEFAULT) == [*cases.values(), None]
    assert masking.MaskChain(masking.NUMBER, masking.TIME).order == [masking.TIME, masking.NUMBER]
    assert masking.MaskChain(masking.NUMBER).add(masking.TIME).order[0] is masking.TIME


def test_extraction(spark):
    assert column(spark, ["a <x> 5"], masking.MaskChain(masking.NUMBER, masking.POINTED).extract) == [["<x>", "5"]]
    assert column(spark, ["a -5 6"], masking.AGGRESSIVE_NUMBER.extract) == [["", ""]]


def test_tokens(spark):
    assert column(spark, ["this is a test string "], tokens.words) == [["this", "is", "a", "test", "string"]]
    text = "say \"hello big\" it's 'a b'x tail \"open end"
    assert column(spark, [text], tokens.quoted_words) == [["say", '"hello big"', "it's", "'a b'", "x", "tail", '"open end']]
    assert column(spark, [" a=b;c "], tokens.separators) == [[" ", "=", ";", " "]]
    assert column(spark, ["", "::a", "12", "created.", "user_x", "$v"], tokens.is_possible_param) == [False, False, False, True, True, True]
    assert [[tuple(x) for x in column(spark, [" ab  c"], tokens.spans)[0]]] == [[(1, 3), (5, 6)]]


def test_edit_paths_and_subsequences(spark):
    assert kernels.edit_path("claw", "lawn") == (2, "DRRRI")
    assert kernels.edit_path("clawn is my lawn so far".split(), "clawn lawn thus far".split()) == (3, "RDDRSR")
    assert "".join(kernels.common_subsequence(["scclawn", "lawn", "wanwmn", "lwnmower"])) == "wn"
    assert kernels.common_subsequence([[], ["a"]]) == []
    with pytest.raises(ValueError):
        kernels.common_subsequence([f" com {i} com {i}".split() for i in range(100)])
    df = spark.createDataFrame([("claw", "lawn"), (None, "x")], "a string, b string")
    assert [tuple(r[0]) for r in df.select(distance.edit_path("a", "b")).collect()] == [(2, "DRRRI"), (None, None)]


@settings(max_examples=40, deadline=None)
@given(st.text("abc", max_size=8), st.text("abc", max_size=8))
def test_edit_path_is_as_long_as_the_distance(a, b):
    d, ops = kernels.edit_path(a, b)
    assert d == sum(o != "R" for o in ops)
    assert sum(o in "RSD" for o in ops) == len(a) and sum(o in "RSI" for o in ops) == len(b)


def test_weighted_distance(spark):
    rows = [("this is a test string", "this is a fest string"), ("help", "halp"), ("help", "help"), ("", ""), ("a b", "a")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string")
    got = [r[0] for r in df.orderBy("i").select(distance.weighted_text_distance(F.col("a"), F.col("b"))).collect()]
    for x, y in zip(got, [0.01798620996209156, 0.2689414213699951, 0.0, 0.0, 1 / (1 + math.exp(2))]):
        assert x == pytest.approx(y, abs=1e-12)


def test_two_means():
    assert [kernels.two_means_cutoff(v) for v in ([1, 2], [3, 5, 9], [], [4], [4, 4], [1, 1, 9])] == [1, 5, None, None, None, 1]
    assert kernels.two_means_cutoff([1, 9], [2, 1]) == kernels.two_means_cutoff([1, 1, 9])


def test_hashes_and_shared_calls(spark):
    df = spark.createDataFrame([(1, 2), (3, 4), (1, 2), (2, 1)], "a int, b int")
    r = df.select((hashing.symmetric_hash("a", "b") == hashing.symmetric_hash("b", "a")).alias("s"), (hashing.multi_hash("a", "b") == hashing.multi_hash("b", "a")).alias("o")).first()
    assert r.s and not r.o
    got = hashing.call_once(df, ["a", "b"], lambda a, b: a + b, "t", symmetric=True)
    assert sorted(tuple(x) for x in got.collect()) == [(1, 2, 3), (1, 2, 3), (2, 1, 3), (3, 4, 7)]


def test_edit_distances_of_many_words():
    words = ["", "claw", "lawn", "clawn", "lawnmower", "é", "help", "halp"]
    assert kernels.edit_distances(words).tolist() == [[int(kernels.edit_table(a, b)[-1, -1]) for b in words] for a in words]
