"""Clustering of messages by a weighted edit distance: flat, by process, and nested."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logweave.functions.distance import logistic_decrease, weighted_distance
from logweave.functions.kernels import edit_distances, two_means_cutoff
from logweave.functions.tokens import quoted_words
from logweave.operators.graph import connected_components


def reachable(start: DataFrame, edges: DataFrame, node: str = "node", src: str = "src", dst: str = "dst", max_rounds: int = 1000) -> DataFrame:
    """Nodes reachable from those of start over edges in either direction, breadth first, start included."""
    from logweave.operators.graph import _written

    both = _written(edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).union(edges.select(F.col(dst).alias("u"), F.col(src).alias("v"))).distinct(), "bfs-edges")
    seen = front = _written(start.select(F.col(node).alias("node")).distinct(), "bfs")
    for _ in range(max_rounds):
        step = front.join(both, front.node == both.u).select(F.col("v").alias("node")).distinct()
        front = _written(step.join(seen, "node", "left_anti"), "bfs")
        if front.isEmpty():
            break
        seen = seen.union(front)
    return seen.withColumnRenamed("node", node)


#: Items of a block: without keys every block meets every other.
BLOCK_ITEMS = 2000


def pairs_within(df: DataFrame, keys: Sequence[str], item: str) -> DataFrame:
    """keys, a, b for each two items a < b of a group: an equi-join on the keys with a range condition.

    Without keys every item meets every other, block by block, so that no task has them all.
    """
    left, right = df.select(*keys, F.col(item).alias("a")), df.select(*keys, F.col(item).alias("b"))
    if keys:
        return left.join(right, list(keys)).where("a < b")
    blocks = max(1, min(256, -(-df.count() // BLOCK_ITEMS)))
    every, own = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))), lambda x: F.pmod(F.xxhash64(x), F.lit(blocks)).cast("int")
    return left.select("a", own("a").alias("i"), every.alias("j")).join(right.select("b", own("b").alias("j"), every.alias("i")), ["i", "j"]).where("a < b").select("a", "b")


def agglomerative(df: DataFrame, keys: Sequence[str], item: str, edge: Callable[[Column, Column], Column]) -> DataFrame:
    """keys, item, cluster_id: components of the graph of all pairs for which edge holds. Ids count from 0 by smallest member within the keys."""
    items = df.select(*keys, item).distinct()
    linked = pairs_within(items, keys, item).where(edge(F.col("a"), F.col("b"))).select(*keys, "a", "b")
    return label_components(items, linked, keys, item)


def label_components(items: DataFrame, linked: DataFrame, keys: Sequence[str], item: str) -> DataFrame:
    """The same from a table of edges (keys, a, b)."""
    node = lambda c: F.struct(*keys, F.col(c).alias("item"))
    found = connected_components(linked.select(node("a").alias("src"), node("b").alias("dst")))
    flat = found.select(*[F.col(f"node.{k}").alias(k) for k in keys], F.col("node.item").alias(item), F.col("component.item").alias("least"))
    out = items.join(flat, [*keys, item], "left").withColumn("least", F.coalesce("least", item))
    return out.withColumn("cluster_id", F.dense_rank().over(W.partitionBy(*keys).orderBy("least")) - 1).drop("least")


#: Items that nearest() and nearest_cluster() compare every query with at most: they are broadcast.
NEAREST_ITEMS = 100_000


def _few(items: DataFrame) -> DataFrame:
    if items.limit(NEAREST_ITEMS + 1).count() > NEAREST_ITEMS:
        raise ValueError(f"there are more than {NEAREST_ITEMS} items to compare each query with; block them by a key")
    return F.broadcast(items)


def nearest(queries: DataFrame, query: str, items: DataFrame, item: str, distance: Callable[[Column, Column], Column]) -> DataFrame:
    """query, item, distance of the nearest item, the first in item order among equals; infinity and null for no items.

    Each query is compared with every item, as any distance may be given; more than NEAREST_ITEMS items are an error.
    """
    met = queries.select(F.col(query)).distinct().join(_few(items.select(F.col(item)).distinct()))
    best = met.withColumn("distance", distance(F.col(query), F.col(item)).cast("double")).groupBy(query).agg(F.min(F.struct("distance", item)).alias("best"))
    got = queries.select(query).distinct().join(best, query, "left")
    return got.select(query, F.col(f"best.{item}").alias(item), F.coalesce("best.distance", F.lit(float("inf"))).alias("distance"))


def nearest_cluster(queries: DataFrame, query: str, clusters: DataFrame, item: str, cluster: str, distance: Callable[[Column, Column], Column]) -> DataFrame:
    """query, cluster, distance: the cluster with the nearest member, the first cluster among equals. As nearest(), an error for very many members."""
    met = queries.select(F.col(query)).distinct().join(_few(clusters.select(cluster, item)))
    each = met.withColumn("distance", distance(F.col(query), F.col(item)).cast("double")).groupBy(query, cluster).agg(F.min("distance").alias("distance"))
    best = each.groupBy(query).agg(F.min(F.struct("distance", cluster)).alias("best"))
    return best.select(query, F.col(f"best.{cluster}").alias(cluster), F.col("best.distance").alias("distance"))


def distance_cutoffs(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, cutoff: the two-means cutoff of each group's values; null for fewer than two different ones.

    Equal values are counted before they are brought together, so a group costs its distinct values.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[*pdf.iloc[0][list(keys)], two_means_cutoff(pdf["v"].to_numpy(), pdf["n"].to_numpy())]], columns=[*keys, "cutoff"])

    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return counted.groupBy(*keys).applyInPandas(run, f"{schema}, cutoff double" if keys else "cutoff double")


def message_distance(a: Column, b: Column, nu: float = -1.0, scale: float | Column = 1.0) -> Column:
    """Weighted edit distance by quoted words: what all three clusterings use."""
    return weighted_distance(quoted_words(a), quoted_words(b), lambda k: logistic_decrease(k, nu, scale))


def cluster_flat(messages: DataFrame, column: str = "message", cutoff: float = 0.3, nu: float = -1.0) -> DataFrame:
    """message, cluster_id: distinct messages that are nearer than the cutoff are together.

    Messages whose numbers of words differ so much that the surplus alone reaches the cutoff are passed over: each missing
    word costs its weight at least.
    """
    items = messages.select(column).distinct().withColumn("n", F.size(quoted_words(F.col(column))))
    # the surplus words' weights, by position, decide which counts can be near each other at all
    weight = lambda k: 1 / (1 + np.exp(k - nu))
    most = 64
    near = [(n, m) for n in range(most) for m in range(n, most) if sum(weight(k) for k in range(n + 1, m + 1)) < cutoff]
    spark = messages.sparkSession
    reach = spark.createDataFrame(near, "na int, nb int").union(spark.createDataFrame([(m, n) for n, m in near if n != m], "na int, nb int"))
    part = lambda n: F.least(n, F.lit(most - 1))
    left = items.select(F.col(column).alias("a"), part(F.col("n")).alias("na"))
    right = items.select(F.col(column).alias("b"), part(F.col("n")).alias("nb"))
    met = left.join(F.broadcast(reach), "na").join(right, "nb").where("a < b")
    linked = met.where(message_distance(F.col("a"), F.col("b"), nu) < cutoff).select("a", "b")
    return label_components(items.select(column), linked, [], column)


def distances(messages: DataFrame, keys: Sequence[str], column: str = "message", nu: float = -1.0) -> DataFrame:
    """keys, a, b, distance for each two distinct messages of a group; to 12 places, as sums that are equal should compare so."""
    items = messages.select(*keys, column).distinct()
    return pairs_within(items, keys, column).withColumn("distance", F.round(message_distance(F.col("a"), F.col("b"), nu), 12))


def cluster_by_process(messages: DataFrame, process: str = "process", column: str = "message", nu: float = -1.0) -> DataFrame:
    """process, message, cutoff, cluster_id: each process with two or more distinct messages is clustered below its own cutoff.

    Where all distances are equal there is no cutoff, and the process is one cluster.
    """
    from logweave.operators.graph import _written

    items = messages.select(process, column).distinct()
    enough = items.groupBy(process).agg(F.count("*").alias("c")).where("c > 1").select(process)
    items = items.join(enough, process, "left_semi")
    apart = _written(distances(items, [process], column, nu), "distances")
    cut = distance_cutoffs(apart, [process], "distance")
    linked = apart.join(cut, process).where(F.col("cutoff").isNull() | (F.col("distance") < F.col("cutoff"))).select(process, "a", "b")
    return label_components(items, linked, [process], column).join(cut, process, "left")


def _nested(words: list[list[str]], scale: float) -> list[tuple[int, ...]]:
    """The path of each message of one bucket: nested components below cutoffs that shrink."""
    n = len(words)
    # position by position: distances of the distinct words there, spread over the pairs
    most = max(map(len, words), default=0)
    weights = 1 / (1 + np.exp(scale * np.arange(1, most + 1) + 1))
    d = np.zeros((n, n))
    for k in range(most):
        here = [w[k] if k < len(w) else "" for w in words]
        distinct = sorted(set(here))
        number = {w: i for i, w in enumerate(distinct)}
        at = np.array([number[w] for w in here])
        table = edit_distances(distinct)
        d += table[np.ix_(at, at)] * weights[k]
    paths: list[tuple[int, ...]] = [()] * n

    def go(members: list[int], path: tuple[int, ...], last: float | None) -> None:
        leaf = len(members) == 1
        if not leaf:
            part = d[np.ix_(members, members)][np.triu_indices(len(members), 1)]
            low, high = part.min(), part.max()
            leaf = high < 1e-6 or (low > 0 and high / low - 1 < 1e-6)
        cutoff = None if leaf else two_means_cutoff(part)
        if not leaf and last is not None and cutoff is not None:
            if cutoff >= 0.9999 * last and high >= 1.2 * last:
                cutoff = 0.95 * last
            spread = abs(high / cutoff - 1) if cutoff else np.inf
            leaf = cutoff >= 0.999 * last or high < last or (cutoff < 0.1 * last and spread < 0.9) or (cutoff < 0.5 * last and spread < 0.1)
        if leaf or cutoff is None:
            for m in members:
                paths[m] = path
            return
        left, k = list(members), 0
        while left:
            front, group = [left[0]], {left[0]}
            while front:
                at = front.pop()
                new = [m for m in left if m not in group and d[at, m] < cutoff]
                group |= set(new)
                front += new
            left = [m for m in left if m not in group]
            go(sorted(group), (*path, k), cutoff)
            k += 1

    go(list(range(n)), (), None)
    return paths


def cluster_nested(messages: DataFrame, process: str = "process", column: str = "message", max_bucket: int = 5_000) -> DataFrame:
    """process, n_words, first_word, message, path: within each bucket of a process (quoted word count and first word), nested clusters.

    The path has the index of the component at each depth. Weights fall off by the process's word counts: scale 7 / (mean
    + population deviation). Processes with one message are left out. A bucket of more than max_bucket messages fails:
    its distances are a matrix, of 200 MB at that size.
    """
    items = messages.select(process, column).distinct().withColumn("words", quoted_words(F.col(column)))
    items = items.withColumns({"n_words": F.size("words"), "first_word": F.coalesce(F.get("words", F.lit(0)), F.lit(""))})
    stats = items.groupBy(process).agg(F.count("*").alias("c"), (7 / (F.avg("n_words") + F.stddev_pop("n_words"))).alias("scale")).where("c > 1").drop("c")
    rows = items.join(stats, process)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > max_bucket:
            raise ValueError(f"a bucket has {len(pdf)} messages, more than {max_bucket}")
        pdf = pdf.sort_values(column, kind="stable").reset_index(drop=True)
        paths = _nested([list(w) for w in pdf["words"]], float(pdf["scale"].iloc[0]))
        pdf["path"] = ["-".join(map(str, p)) for p in paths]
        return pdf[[process, "n_words", "first_word", column, "path"]]

    kind = messages.schema[process].dataType.simpleString()
    return rows.groupBy(process, "n_words", "first_word").applyInPandas(run, f"`{process}` {kind}, n_words int, first_word string, `{column}` string, path string")


def leaves(nested: DataFrame, process: str = "process", column: str = "message") -> DataFrame:
    """process, leaf, path, members (sorted), in the order of their first members: leaf counts from 0 within the process."""
    each = nested.groupBy(process, "n_words", "first_word", "path").agg(F.array_sort(F.collect_list(column)).alias("members"))
    return each.withColumn("leaf", F.row_number().over(W.partitionBy(process).orderBy(F.get("members", F.lit(0)))) - 1)

