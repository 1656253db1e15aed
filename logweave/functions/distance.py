"""Edit distances over strings and sequences, and the weighted distance of messages."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweave.functions import kernels
from logweave.functions.tokens import words


#: Types and not their names: workers import this module too, and have no session to parse names with.
_PATH = T.StructType([T.StructField("distance", T.IntegerType()), T.StructField("ops", T.StringType())])


def levenshtein(a: Column, b: Column, by_bytes: bool = False) -> Column:
    """Unit-cost edit distance, by code points or by UTF-8 bytes."""
    if by_bytes:
        a, b = (F.decode(F.encode(x, "UTF-8"), "ISO-8859-1") for x in (a, b))
    return F.levenshtein(a, b)


def sequence_distance(same: Callable | None = None) -> Callable[[Column, Column], Column]:
    """Edit distance of two arrays of strings, with an equality of one's own if given."""

    @F.pandas_udf("int")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else int(kernels.edit_table(x, y, same or (lambda p, q: p == q))[-1, -1]) for x, y in zip(a, b)], dtype="Int32")

    return run


@F.pandas_udf(_PATH)
def edit_path(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Distance and edit script (R, D, I, S) of two strings."""
    return pd.DataFrame([kernels.edit_path(x, y) if x is not None and y is not None else (None, None) for x, y in zip(a, b)], columns=["distance", "ops"])


@F.pandas_udf(_PATH)
def word_edit_path(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """The same for two arrays of words."""
    return pd.DataFrame([kernels.edit_path(list(x), list(y)) if x is not None and y is not None else (None, None) for x, y in zip(a, b)], columns=["distance", "ops"])


def common_subsequence(cells: int = 10_000_000) -> Callable[[Column], Column]:
    """Longest common subsequence of an array of arrays of strings; more table cells than `cells` are an error."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else kernels.common_subsequence([list(y) for y in x], cells=cells) for x in s])

    return run


def logistic_decrease(x: Column, nu: float = 0.0, scale: float | Column = 1.0) -> Column:
    """1 / (1 + exp(scale * x - nu))"""
    return 1 / (1 + F.exp(x * scale - nu))


def weighted_distance(a: Column, b: Column, weight: Callable[[Column], Column] = logistic_decrease, distance: Callable[[Column, Column], Column] = F.levenshtein) -> Column:
    """Sum over positions k from 1 of distance(a's word k, b's word k) * weight(k), on arrays of words; a missing word is empty."""
    most = F.greatest(F.size(a), F.size(b))
    term = lambda k: distance(F.coalesce(F.get(a, k - 1), F.lit("")), F.coalesce(F.get(b, k - 1), F.lit(""))) * weight(k)
    total = F.aggregate(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), F.lit(0.0), lambda acc, k: acc + term(k))
    return F.when(most > 0, total).otherwise(F.lit(0.0))


def weighted_text_distance(a: Column, b: Column, nu: float = 0.0, scale: float | Column = 1.0) -> Column:
    """weighted_distance of two strings by their blank-separated words."""
    return weighted_distance(words(a), words(b), lambda k: logistic_decrease(k, nu, scale))
