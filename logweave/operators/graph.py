"""Connected components of an edge table, by alternating large-star and small-star rounds.

Each round keeps at most as many edges as there are links, every group is reduced by an aggregate and a join (no list of
neighbours is ever collected), and each round is written to the shared folder, so lineage stays short and a lost executor
costs one round at most.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that spark.checkpoint.dir names.

    Where that is unset a local session (tests) gets a folder of its own; on a cluster it is an error, as a folder of one
    machine can't be shared.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="logweave-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/logweave/{name}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries that end in here leave no shuffle files behind, instead of keeping them until the driver collects garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def _written(df: DataFrame, name: str) -> DataFrame:
    path = shared_path(df.sparkSession, name)
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return row[0], row[1]


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 50) -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reachable.

    Direction and repetition of edges don't matter; self-loops give components of one; edges with a null end are left
    out; no edges give no rows. Nodes must be of one orderable type.
    """
    pairs = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).distinct()
    every = _written(pairs, "edges")
    now = every.where("u <> v")
    before = None
    for _ in range(max_rounds):
        # large star: v's neighbours that are larger go to the least of v's neighbourhood
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u's smaller neighbours and u itself go to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        now = _written(small, "stars")
        after = _state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = every.select(F.col("u").alias("node")).union(every.select(F.col("v").alias("node"))).distinct()
    return nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("m")), "node", "left").select("node", F.coalesce("m", "node").alias("component"))
