"""Combined hashes, ordered and symmetric, and calls shared by equal arguments."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def multi_hash(*columns: Column | str) -> Column:
    """A hash of several values that depends on their order."""
    return F.xxhash64(*columns)


hash_combine = multi_hash


def symmetric_hash(a: Column | str, b: Column | str) -> Column:
    """A hash of two values that doesn't depend on their order."""
    return F.xxhash64(F.least(a, b), F.greatest(a, b))


def symmetric_multi_hash(*columns: Column | str) -> Column:
    """The same of any number of values of one type."""
    return F.xxhash64(F.array_sort(F.array(*columns)))


def call_once(df: DataFrame, arguments: Sequence[str], call: Callable[..., Column], result: str, symmetric: bool = False) -> DataFrame:
    """df with `result`, each distinct tuple of arguments being evaluated once; of a symmetric call's two, once in either order."""
    a = [F.col(c) for c in arguments]
    keys = [F.least(*a), F.greatest(*a)] if symmetric else a
    names = [f"__arg{i}" for i in range(len(keys))]
    marked = df.withColumns(dict(zip(names, keys)))
    once = marked.select(*names).distinct()
    once = once.withColumn(result, call(*[F.col(n) for n in names]))
    match = [marked[n].eqNullSafe(once[n]) for n in names]
    return marked.join(once, match, "left").select(*[marked[c] for c in df.columns], once[result])
