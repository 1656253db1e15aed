"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logweave.llm.common import materialize

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_key(source: Column) -> Column:
    """A source as a join key that isn't null."""
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source.cast("string")))


def priority(doc_id: Column, seed: int) -> Column:
    """52 bits of the seed's and the id's md5: the order in which a fractional repetition takes documents."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")


def _order() -> Column:
    """The order in which a source's documents are taken, as one value."""
    return F.struct("pri", F.col("id").isNull().alias("no_id"), F.coalesce("id", F.lit(0)).alias("id"), "size")


def cyclic_weights(sources: DataFrame, cycle: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """Add weight: the sources by code point, null last, weigh the cycle's values in turn. One row per source comes in."""
    place = F.row_number().over(W.orderBy(F.col("source").isNull(), "source")) - 1
    return sources.withColumn("weight", F.element_at(F.array(*map(F.lit, cycle)), (place % len(cycle) + 1).cast("int")).cast("double"))


def water_fill(sources: DataFrame, total: float, max_epochs: float) -> DataFrame:
    """Add target to (key, source_size, weight): shares of `total` by weight, at most max_epochs times the source's size.

    Excess over the caps is shared again among the rest by weight until none is above. Every round is one aggregate over
    the sources; only two sums come to the driver. If all caps together hold less than `total`, all are met.
    """
    cap = max_epochs * F.col("source_size")
    level, clamped = None, -1
    while True:
        over = F.lit(False) if level is None else F.col("weight") * level > cap
        got = sources.agg(F.sum(F.when(over, cap).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))), F.sum(over.cast("int"))).first()
        if got[0] is None or not got[1]:
            return sources.withColumn("target", cap.cast("double"))
        if got[2] == clamped:
            return sources.withColumn("target", F.least(F.col("weight") * level, cap))
        level, clamped = (total - got[0]) / got[1], got[2]


def mixing_plan(docs: DataFrame, share: float, max_epochs: float, seed: int, cycle: tuple[int, ...] = (5, 2, 1), weights: DataFrame | None = None) -> DataFrame:
    """(key, b1, source_size, target, whole, cut...) for each source and each of its 4096 priority ranges.

    docs: (id, source, size, key, pri). weights: (source, weight), or None for cyclic ones. A source's documents are
    taken `whole` times, and those before the cut once more; of the one at the cut, `part` words are. The cut is found by
    narrowing a histogram of priorities twice and ordering only the documents of the last range, so a source of any size
    loads no single task.
    """
    b1, b2 = F.shiftright("pri", 40), F.shiftright("pri", 28).bitwiseAND(4095)
    bins = materialize(docs.groupBy("key", b1.alias("b1")).agg(F.sum("size").alias("words"), F.first("source").alias("source")), "mix-bins")
    sources = bins.groupBy("key").agg(F.first("source").alias("source"), F.sum("words").alias("source_size"))
    if weights is None:
        sources = cyclic_weights(sources, cycle)
    else:
        given = weights.select(source_key(F.col("source")).alias("key"), F.col("weight").cast("double").alias("weight")).groupBy("key").agg(F.max("weight").alias("weight"))
        sources = sources.join(given, "key", "left").fillna(0.0, ["weight"])
    sources = materialize(sources, "mix-sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    targets = water_fill(sources, share * total, max_epochs)
    size = F.col("source_size")
    targets = targets.withColumn("whole", F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0).cast("long"))
    targets = targets.withColumn("need", F.col("target") - F.col("whole") * size)

    def narrow(binned: DataFrame, by: str, need: str) -> DataFrame:
        """The last bin of each key whose words begin below the need, and what is needed of it."""
        before = F.sum("words").over(W.partitionBy("key").orderBy(by)) - F.col("words")
        return binned.withColumn("before", before).where(F.col("before") < F.col(need)).groupBy("key").agg(F.max(F.struct(F.col(by), (F.col(need) - F.col("before")).alias("left"))).alias("at"))

    level1 = narrow(bins.join(targets.select("key", "need"), "key"), "b1", "need").select("key", F.col("at.b1").alias("b1"), F.col("at.left").alias("left1"))
    inner = docs.withColumns({"b1": b1, "b2": b2}).join(level1, ["key", "b1"])
    inner = materialize(inner.select("key", "b1", "b2", "pri", "id", "size", "left1"), "mix-inner")
    level2 = narrow(inner.groupBy("key", "b2", "left1").agg(F.sum("size").alias("words")), "b2", "left1").select("key", F.col("at.b2").alias("b2"), F.col("at.left").alias("left2"))
    order = W.partitionBy("key").orderBy("pri", F.col("id").isNull(), "id", "size")
    last = inner.join(level2, ["key", "b2"]).groupBy("key", "pri", "id", "size", "left2").agg(F.count("*").alias("n"))
    before = F.sum(F.col("size") * F.col("n")).over(order) - F.col("size") * F.col("n")
    part = F.least(F.col("size"), F.floor((F.col("left2") - F.col("before")) / F.col("n"))).cast("long")
    cut = last.withColumn("before", before).where("before < left2").groupBy("key").agg(F.max(F.struct(_order().alias("upto"), part.alias("part"))).alias("cut"))
    place = targets.join(level1.select("key", F.col("b1").alias("cut1")), "key", "left").join(level2.select("key", F.col("b2").alias("cut2")), "key", "left").join(cut.select("key", "cut.*"), "key", "left")
    return bins.select("key", "b1").join(place.select("key", "source_size", "target", "whole", "cut1", "cut2", "upto", "part"), "key")


def repetitions(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """docs (with key, pri, id, size) and source_size, target, whole, extra: so many whole repetitions, and words of one more.

    extra is the document's size before the source's cut, 0 behind it, and in between for the one document at the cut.
    The join is on source and priority range, so a hot source is spread.
    """
    b1, b2 = F.shiftright("pri", 40), F.shiftright("pri", 28).bitwiseAND(4095)
    joined = docs.withColumns({"b1": b1, "b2": b2}).join(plan, ["key", "b1"])
    size, none, own = F.col("size"), F.lit(0).cast("long"), _order()
    extra = (
        F.when(F.col("cut1").isNull() | (F.col("b1") > F.col("cut1")), none).when(F.col("b1") < F.col("cut1"), size)
        .when(F.col("cut2").isNull() | (F.col("b2") > F.col("cut2")), none).when(F.col("b2") < F.col("cut2"), size)
        .when(F.col("upto").isNull() | (own > F.col("upto")), none).when(own < F.col("upto"), size).otherwise(F.col("part"))
    )
    return joined.withColumn("extra", extra).drop("b1", "b2", "cut1", "cut2", "upto", "part")


def sizes(df: DataFrame, seed: int, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, size, key, pri) of each row; only these leave the scan."""
    got = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    return got.withColumns({"key": source_key(F.col("source")), "pri": priority(F.col("id"), seed)})


def mix(df: DataFrame, share: float = 1.5, max_epochs: float = 2.0, seed: int = 20240229, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cycle: tuple[int, ...] = (5, 2, 1), weights: DataFrame | None = None) -> DataFrame:
    """One row per row of df: id, size (words), source_size, target (the source's) and taken (words, repetitions counted).

    A source's taken words are its target, rounded down, as one document per source is repeated in part.

    Null and empty texts have size 0 and are taken 0 times their size; null sources are one source of their own, the
    last in order; rows that repeat id and size are taken alike; null ids come last among equals. An empty table gives
    no rows. With a fixed seed reruns agree, whatever the partitioning.
    """
    docs = materialize(sizes(df, seed, id_col, text_col, source_col), "mix-sizes")
    got = repetitions(docs, mixing_plan(docs, share, max_epochs, seed, cycle, weights))
    return got.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("whole") + F.col("extra")).alias("taken"))


def mixed_documents(df: DataFrame, share: float = 1.5, max_epochs: float = 2.0, seed: int = 20240229, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cycle: tuple[int, ...] = (5, 2, 1), weights: DataFrame | None = None) -> DataFrame:
    """The rows of df as often as the mix takes them, with df's columns; one repetition per source has only the words needed.

    Null, empty and blank texts add nothing and are left out; sources, ids and ties are as mix() says. An empty table stays
    empty. Clashing names of other columns don't matter: a row is carried as one value.
    """
    docs = materialize(sizes(df, seed, id_col, text_col, source_col), "mix-sizes")
    plan = mixing_plan(docs, share, max_epochs, seed, cycle, weights)
    carried = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(id_col).alias("id"), word_count(F.col(text_col)).alias("size"), source_key(F.col(source_col)).alias("key"), priority(F.col(id_col), seed).alias("pri"))
    got = repetitions(carried, plan).where("size > 0")
    copies = F.when(F.col("whole") > 0, F.array_repeat(F.col("size"), F.col("whole").cast("int"))).otherwise(F.array().cast("array<bigint>"))
    turns = F.when(F.col("extra") > 0, F.concat(copies, F.array("extra"))).otherwise(copies)
    each = got.select("row", "size", F.explode(turns).alias("words"))
    # a word with the white space before it, so that joining the first ones gives the text up to there
    begun = F.array_join(F.slice(F.regexp_extract_all(F.col(f"row.`{text_col}`"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), F.col("words").cast("int")), "")
    text = F.when(F.col("words") < F.col("size"), begun).otherwise(F.col(f"row.`{text_col}`"))
    return each.select(*[text.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in df.columns])


#: The same in DuckDB; {seed} as above. Caps are met in the order of cap per weight.
MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS pri FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS INTEGER)]::DOUBLE AS w FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY 2.0 * source_size / w, source IS NULL, source) AS k FROM s),
c AS (SELECT *, coalesce(sum(2 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps_before,
    sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_rest FROM o),
l AS (SELECT k, (1.5 * (SELECT CAST(sum(source_size) AS DOUBLE) FROM s) - CAST(caps_before AS DOUBLE)) / w_rest AS lam, w, source_size FROM c),
pick AS (SELECT lam FROM l WHERE w * lam <= 2.0 * source_size ORDER BY k LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN (SELECT lam FROM pick) IS NULL THEN 2.0 * source_size ELSE least(w * (SELECT lam FROM pick), 2.0 * source_size) END AS target FROM s),
n AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
m AS (SELECT d.doc_id, d.size, n.source_size, n.target, n.whole, n.target - n.whole * n.source_size AS need,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.pri, d.doc_id IS NULL, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS before
  FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target, CAST(size * whole + greatest(0, least(size, CAST(floor(need - before) AS BIGINT))) AS BIGINT) AS taken FROM m
"""
