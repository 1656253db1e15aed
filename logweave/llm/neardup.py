"""MinHash near-duplicates: one-permutation hashing with optimal densification, banded buckets, star-shaped candidates.

1. Every document gets its shingle set's size and 128-bit digest and its band keys; equal sets become one class, whose
   smallest id stands for it from then on.
2. In each band bucket the smallest id is the hub of a star, so a bucket of n gives n - 1 candidates.
3. Candidates are confirmed on full sets, and confirmed links joined to components.
4. A star can miss a link between two members neither of which links to the hub. Buckets that still hold several
   components are therefore searched again, exactly: shingles shared there are ordered by rarity, and any two sets similar
   enough share one of the first few (prefix filter). Only pairs across components are looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logweave.llm.common import byte_slices, filled, materialize
from logweave.operators.graph import connected_components

WIDTH = 5
BINS, ROWS = 256, 5
BANDS = BINS // ROWS
_U = np.uint64
_rng = np.random.default_rng(20240501)
_ODD = (_rng.integers(0, 2**63, 64, dtype=np.uint64) << _U(1)) | _U(1)
#: For bin i, the bins that an empty one looks into, in order: random, the same for all documents.
_PROBES = _rng.integers(0, BINS, (BINS, 8 * BINS))
_EDGES = np.arange(1, BINS, dtype=np.uint64) << _U(64 - BINS.bit_length() + 1)
#: Ids that a look-up may broadcast; beyond that it shuffles.
BROADCAST_IDS = 500_000
#: Sets of a block that others meet under a shingle.
BLOCK_SETS = 1024


def _mix(h: np.ndarray) -> np.ndarray:
    """A bijective finish, so that every bit depends on all."""
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles: five words, A-Z lower-cased; fewer words make one shingle."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(filled(texts)))
    coded = parts.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    codes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
    ids = coded.indices.to_numpy()
    full = np.fromiter((bool(w) for w in words), bool, len(words))[ids] if len(ids) else np.zeros(0, bool)
    doc = np.repeat(np.arange(len(parts)), np.diff(parts.offsets.to_numpy()))[full]
    h = codes[ids[full]] if len(ids) else np.zeros(0, np.uint64)
    n = len(h)
    sums = np.zeros(max(0, n - WIDTH + 1), np.uint64)
    for k in range(WIDTH):
        sums += h[k : n - WIDTH + 1 + k] * _ODD[k]
    sums = _mix(sums)
    ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(parts)))])
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        if b - a >= WIDTH:
            out.append(np.unique(sums[a : b - WIDTH + 1]))
        elif b > a:
            out.append(_mix((h[a:b] * _ODD[: b - a]).sum(dtype=np.uint64, keepdims=True) + _ODD[32 + b - a]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(s: np.ndarray) -> np.ndarray:
    """One-permutation minima by bin; an empty bin takes the value of the first full one in its own random order."""
    at = np.concatenate([[0], np.searchsorted(s, _EDGES), [len(s)]])
    has = at[:-1] < at[1:]
    source = np.arange(BINS)
    empty = np.flatnonzero(~has)
    if len(empty):
        for width in (16, _PROBES.shape[1]):  # nearly always the first few decide
            probes = _PROBES[empty, :width]
            tries = has[probes]
            first = tries.argmax(1)
            hit = tries[np.arange(len(empty)), first]
            source[empty[hit]] = probes[hit, first[hit]]
            empty = empty[~hit]
            if not len(empty):
                break
        source[empty] = np.flatnonzero(has)[0]
    return s[at[source]]


def bands(s: np.ndarray) -> np.ndarray:
    rows = signature(s)[: BANDS * ROWS].reshape(BANDS, ROWS)
    return _mix((rows * _ODD[8 : 8 + ROWS]).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _ODD[40])


def _ids_type(df: DataFrame, id_col: str) -> str:
    return df.schema[id_col].dataType.simpleString()


def signatures(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n, d1, d2, keys): set size, set digest, band keys (none for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_slices(batches, "text"):
            rows = []
            for s in shingle_sets(part.column("text")):
                digest = xxhash.xxh3_128_intdigest(s.tobytes())
                rows.append((len(s), (digest >> 64) - (1 << 63), digest % (1 << 64) - (1 << 63), bands(s).view(np.int64) if len(s) else None))
            n, d1, d2, keys = zip(*rows)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "n", "d1", "d2", "keys"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {_ids_type(df, id_col)}, n long, d1 long, d2 long, keys array<long>")


def _parity(s: np.ndarray) -> list[int]:
    """Four numbers of 64 bits: for each of 256 classes of shingles whether the set has an odd number of them."""
    bits = np.bincount((s & _U(255)).astype(np.int64), minlength=256) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64).tolist()


def full_sets(df: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, s): the shingle hashes of the documents named in ids (id), a row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_slices(batches, "text", 1 << 20):
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([s.view(np.int64) for s in shingle_sets(part.column("text"))], pa.list_(pa.int64()))], names=["id", "s"])

    wanted = ids if ids.count() > BROADCAST_IDS else F.broadcast(ids)
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(wanted, "id", "left_semi")
    return texts.mapInArrow(run, f"id {_ids_type(df, id_col)}, s array<long>")


def sketches(sets: DataFrame) -> DataFrame:
    """(id, g0 to g3) of (id, s): two sets differ in as many of these bits as in shingles, or in fewer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values, offsets = b.column("s").flatten().to_numpy(zero_copy_only=False).view(np.uint64), b.column("s").offsets.to_numpy()
            offsets = offsets - offsets[0]
            g = np.array([_parity(values[i:j]) for i, j in zip(offsets[:-1], offsets[1:])], np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(g[:, k]) for k in range(4))], names=["id", *(f"g{k}" for k in range(4))])

    kind = sets.schema["id"].dataType.simpleString()
    return sets.mapInArrow(run, f"id {kind}, g0 long, g1 long, g2 long, g3 long")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of pairs whose sets are similar enough: 100 * intersection >= percent * union."""
    both = pairs.join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b").join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a")
    shared = F.size(F.array_intersect("sa", "sb")).cast("long")
    return both.where(100 * shared >= percent * (F.size("sa") + F.size("sb") - shared)).select("a", "b")


def near_duplicates(df: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: id, n_shingles, component_id (smallest id reachable over links), kept (id = component_id).

    Null and empty texts have no shingles and are linked with nothing. Texts with equal sets are linked. Rows that repeat
    an id and its text are one document, and each gets its row; a null id stays null, takes part in no link, and is kept.
    """
    clean = df.where(F.col(id_col).isNotNull())
    sig = materialize(signatures(df, id_col, text_col), "signatures")
    some = sig.where("id is not null and n > 0")
    classes = materialize(some.groupBy("d1", "d2", "n").agg(F.min("id").alias("rep")), "classes")
    reps = some.join(classes.select(F.col("rep").alias("id"), "d1", "d2", "n"), ["id", "d1", "d2", "n"]).dropDuplicates(["id", "d1", "d2"])
    # one id with several texts (which shouldn't be) may stand for several sets; then it is linked with them all
    reps = reps.groupBy("id").agg(F.max("n").alias("n"), F.flatten(F.collect_list("keys")).alias("keys"))
    members = reps.select("id", "n", F.explode("keys").alias("key"))
    hubs = members.groupBy("key").agg(F.min(F.struct("id", "n")).alias("hub"), F.count("*").alias("c")).where("c > 1").select("key", "hub")
    crowded = materialize(members.join(hubs, "key"), "buckets")
    small, large = F.least("n", "hub.n"), F.greatest("n", "hub.n")
    stars = crowded.where(F.col("id") != F.col("hub.id")).where(100 * small >= percent * large).select(F.col("hub.id").alias("a"), F.col("id").alias("b")).distinct()
    sets = materialize(full_sets(clean, crowded.select("id").distinct(), id_col, text_col).groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("s"))).alias("s")), "sets")
    links = materialize(_confirm(stars, sets, percent), "links")
    found = connected_components(links, "a", "b")

    label = crowded.select("id", "n", "key").join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("component", "id"))
    mixed = label.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key")
    open_ = materialize(label.join(mixed, "key").select("id", "n", "label").distinct(), "open")
    more = materialize(_confirm(_prefix_pairs(open_, sets, percent), sets, percent), "more-links")
    if not more.isEmpty():
        found = connected_components(links.union(more), "a", "b")
    classed = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("d1", "d2", "n", F.coalesce("component", "rep").alias("component"))
    return _with_component(sig, classed, id_col)


def _with_component(sig: DataFrame, classed: DataFrame, id_col: str) -> DataFrame:
    """Give every row its class's component; a class of very many copies is spread over salts that it occurs with."""
    rows = sig.select("id", "n", "d1", "d2", F.pmod(F.xxhash64("id"), F.lit(16)).cast("int").alias("salt"))
    salts = rows.where("id is not null and n > 0").groupBy("d1", "d2", "n", "salt").agg(F.lit(1).alias("one"))
    spread = salts.join(classed, ["d1", "d2", "n"]).drop("one")
    got = rows.join(spread, ["d1", "d2", "n", "salt"], "left")
    component = F.when(F.col("id").isNull(), F.col("id")).otherwise(F.coalesce("component", "id"))
    return got.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _prefix_pairs(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different labels that may be similar enough: all that are are there.

    Shingles are taken in the order of how many sets have them, so those that one set alone has come first and match
    nothing. Two sets that are similar enough share at least ceil(percent * n / 100) of either's n shingles, and as many as
    ceil(2 * percent * n / (100 + percent)) of the smaller one's. So one of the smaller set's first shingles up to the
    latter is among the larger one's first up to the former. Under a shingle, sets meet in blocks, and a pair is made only
    where sizes, and the bits in which the sets' sketches differ, allow it: many sets that share most of their shingles
    and still aren't similar enough give no pairs.
    """
    each = open_.join(sets, "id").select("id", "label", F.size("s").alias("size"), F.explode("s").alias("h"))
    shared = each.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    known = each.join(shared, "h")
    lists = known.groupBy("id", "label", "size").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("hs"))
    alone = F.col("size") - F.size("hs")
    upto = lambda least: (F.col("size") - F.ceil(least) + 1 - alone).cast("int")
    looks, indexed = upto(F.col("size") * percent / 100), upto(F.col("size") * (2 * percent) / (100 + percent))
    lists = lists.withColumns({"looks": looks, "indexed": indexed}).where("looks > 0")
    prefix = lists.select("id", "label", "size", "indexed", F.posexplode(F.slice("hs", F.lit(1), F.col("looks"))).alias("at", "x"))
    prefix = prefix.select("id", "label", "size", (F.col("at") < F.col("indexed")).alias("indexed"), F.col("x.h").alias("h"))
    across = prefix.groupBy("h").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count_if("indexed").alias("c")).where("x <> y and c > 0")
    kept = prefix.join(across.select("h", F.ceil(F.col("c") / BLOCK_SETS).cast("int").alias("blocks")), "h").join(sketches(open_.select("id").distinct().join(sets, "id")), "id")
    kept = materialize(kept, "prefix")
    columns = ["id", "label", "size", "g0", "g1", "g2", "g3"]
    left = kept.where("indexed").select("h", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"), *[F.col(c).alias(f"{c}_1") for c in columns])
    right = kept.select("h", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), *[F.col(c).alias(f"{c}_2") for c in columns])
    sizes = F.expr(f"(size_1 < size_2 or size_1 = size_2 and id_1 < id_2) and 100 * size_1 >= {percent} * size_2 and label_1 <> label_2")
    # of two sets with as many shingles in common as they must have, (100 - percent) / (100 + percent) of all are in one only
    bits = F.expr(f"{100 + percent} * ({' + '.join(f'bit_count(g{k}_1 ^ g{k}_2)' for k in range(4))}) <= {100 - percent} * (size_1 + size_2)")
    return left.join(right, ["h", "block"]).where(sizes & bits).select(F.least("id_1", "id_2").alias("a"), F.greatest("id_1", "id_2").alias("b")).distinct()


def keep_one(df: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df whose document is kept, with df's columns.

    Null ids, and null and empty texts, stay; repeated rows of a document stay or go together; an empty table stays empty.
    """
    gone = near_duplicates(df, percent, id_col, text_col).where(~F.col("kept")).select(id_col).distinct()
    return df.join(gone, id_col, "left_anti").select(*[f"`{c}`" for c in df.columns])


#: The same in DuckDB, over all pairs that share a shingle.
NEAR_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
i AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, CASE WHEN len(ws) > 0 THEN 1 ELSE 0 END) + 1)) AS k FROM w),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[k:k + 4], ' ') AS x FROM i),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
sym AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(node, seen) AS (SELECT doc_id, doc_id FROM w UNION SELECT b, seen FROM reach JOIN sym ON a = node),
comp AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN comp ON comp.node = w.doc_id
"""
