"""Quality rules with an isolation forest over the rule statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import SMALL_SLICE_BYTES, byte_slices, materialize
from logweave.llm.textstats import COUNTS, FEATURES, features, statistics

#: Trees of the forest that judges, and splits on the way down each.
TREES, HEIGHT = 100, 8
#: Bins that scores are parted in to find the one of a rank.
BINS = 4096
#: The statistics that the forest looks at: those that hardly depend on language and length.
FOREST = [FEATURES.index(n) for n in ("word_length", "symbols", "upper", "stops", "loud", "dup_lines", "repeats", "unique")]
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _mean_path(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search in a binary tree of n points."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class IsolationForest:
    """Random axis-parallel splits; few splits isolate an anomaly. Flat node arrays, one row per tree.

    Splits are drawn over the box of a node, not over its rows' range: a statistic that is the same in all rows is split
    too, if `span` reaches beyond it, and values that the rows lack are isolated at once.
    """

    feature: np.ndarray
    cut: np.ndarray
    depth: np.ndarray
    psi: int

    @classmethod
    def fit(cls, x: np.ndarray, trees: int = 100, psi: int = 256, seed: int = 7, span: tuple[np.ndarray, np.ndarray] | None = None) -> IsolationForest:
        """A forest over the rows of x; span: (lowest, highest) value to split each column over, those of x if unset."""
        rng = np.random.default_rng(seed)
        psi = min(psi, len(x))
        height = max(1, int(np.ceil(np.log2(max(psi, 2)))))
        nodes = (2 << height) - 1
        feature, cut, depth = np.full((trees, nodes), -1, np.int16), np.zeros((trees, nodes)), np.zeros((trees, nodes))
        for t in range(trees):
            stack = [(0, x[rng.choice(len(x), psi, replace=False)], 0, *(span or (x.min(0), x.max(0))))]
            while stack:
                node, part, level, low, high = stack.pop()
                open_ = np.flatnonzero(high > low)
                if level == height or len(part) < 2 or not len(open_):
                    depth[t, node] = level + _mean_path(np.array(len(part)))
                    continue
                f = int(rng.choice(open_))
                value = rng.uniform(low[f], high[f])
                feature[t, node], cut[t, node] = f, value
                left, at = part[:, f] < value, np.arange(x.shape[1]) == f
                stack += [(2 * node + 1, part[left], level + 1, low, np.where(at, value, high)), (2 * node + 2, part[~left], level + 1, np.where(at, value, low), high)]
        return cls(feature, cut, depth, psi)

    @classmethod
    def drawn(cls, span: tuple[np.ndarray, np.ndarray], trees: int = TREES, height: int = HEIGHT, seed: int = 7) -> IsolationForest:
        """Splits of the whole box of span down to `height`, which no row has gone through yet; `counted` makes them a forest."""
        rng = np.random.default_rng(seed)
        nodes = (2 << height) - 1
        feature, cut, depth = np.full((trees, nodes), -1, np.int16), np.zeros((trees, nodes)), np.zeros((trees, nodes))
        for t in range(trees):
            low, high = np.tile(span[0], (nodes, 1)), np.tile(span[1], (nodes, 1))
            for node in range(nodes >> 1):
                left, right = 2 * node + 1, 2 * node + 2
                low[[left, right]], high[[left, right]] = low[node], high[node]
                open_ = np.flatnonzero(high[node] > low[node])
                if len(open_) and (not node or feature[t, (node - 1) >> 1] >= 0):
                    f = int(rng.choice(open_))
                    feature[t, node], cut[t, node] = f, rng.uniform(low[node, f], high[node, f])
                    high[left, f] = low[right, f] = cut[t, node]
        return cls(feature, cut, depth, 0)

    def counted(self, ends: np.ndarray, rows: int) -> IsolationForest:
        """The forest of `rows` rows, ends[t, node] of which end in a node of tree t: a node of less than two has no split."""
        count = ends.copy()
        for node in range(count.shape[1] - 1, 0, -1):
            count[:, (node - 1) >> 1] += count[:, node]
        level = np.floor(np.log2(np.arange(1, count.shape[1] + 1)))
        feature = np.where(count < 2, -1, self.feature).astype(np.int16)
        return replace(self, feature=feature, depth=np.where(feature < 0, level + _mean_path(count), 0.0), psi=rows)

    def ends(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """For each tree, the node that each row of x ends in."""
        rows = np.arange(len(x))
        for feature, cut in zip(self.feature, self.cut):
            node = np.zeros(len(x), np.int64)
            while True:
                f = feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                step = 2 * node + 1 + (x[rows, np.maximum(f, 0)] >= cut[node])
                node = np.where(inner, step, node)
            yield node

    def scores(self, x: np.ndarray) -> np.ndarray:
        """2^(-mean path length / expected): towards 1 for anomalies."""
        total = np.zeros(len(x))
        for depth, node in zip(self.depth, self.ends(x)):
            total += depth[node]
        return np.exp2(-total / len(self.feature) / max(float(_mean_path(np.array(self.psi))), 1e-9))


@dataclass
class RuleModel:
    forest: IsolationForest | None
    threshold: float

    def anomalous(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.forest is None:
            return np.zeros(len(x)), np.zeros(len(x), bool)
        s = self.forest.scores(x[:, FOREST])
        return s, s > self.threshold


def ranked(scores: DataFrame, rank: int) -> float:
    """The score (column `score`) that `rank` rows don't exceed, the first being 1: exact, by narrowing a histogram of all rows."""
    low, high = scores.agg(F.min("score"), F.max("score")).first()
    at = F.col("score")
    while low < high:
        bin_ = F.least(F.lit(BINS - 1), F.floor((at - F.lit(low)) / F.lit(high - low) * BINS).cast("int"))
        for b in scores.where(at.between(F.lit(low), F.lit(high))).groupBy(bin_.alias("bin")).agg(F.count("*").alias("rows"), F.min("score").alias("low"), F.max("score").alias("high")).orderBy("bin").collect():
            if rank <= b.rows:
                break
            rank -= b.rows
        low, high = b.low, b.high
    return low


def calibrate(scores: DataFrame, keep: float) -> float:
    """The threshold that keeps at least the share `keep` of the good rows of (score, good), half way to the next score above it."""
    kept = scores.where("good")
    n = kept.count()
    if not n:
        return np.inf
    low = ranked(kept, min(n, max(1, int(np.ceil(keep * n)))))
    above = scores.where(F.col("score") > low).agg(F.min("score")).first()[0]
    return low if above is None else (low + above) / 2


def labelled_features(df: DataFrame, labels: DataFrame, rows: int, where=None, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """(features, quality) of at most `rows` labelled documents, those whose ids hash lowest. Rows without a label or id don't count.

    The sample is cut by hash before the texts are read, so the ids to look up are at most `rows` and can be broadcast. Of
    labels that contradict each other for one id the highest counts, and of several texts of one id the one of least
    features: what comes to the driver is one row an id. Empty tables give no rows.
    """
    ids = labels.where(F.col("quality").isNotNull() & F.col(id_col).isNotNull())
    ids = ids.where(where) if where is not None else ids
    ids = ids.groupBy(id_col).agg(F.max("quality").alias("quality")).orderBy(F.xxhash64(id_col), id_col).limit(rows)
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, quality int, x array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_slices(batches, text_col, SMALL_SLICE_BYTES):
            x = features(statistics(part.column(text_col)))
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("quality").cast(pa.int32()), pa.array(list(x), pa.list_(pa.float64()))], names=["id", "quality", "x"])

    each = df.select(id_col, text_col).join(F.broadcast(ids), id_col).select(F.col(id_col).alias("id"), "quality", text_col).mapInArrow(run, schema)
    got = each.groupBy("id").agg(F.first("quality").alias("quality"), F.min("x").alias("x")).select("quality", "x").toPandas()
    x = np.array(got["x"].tolist(), float).reshape(len(got), len(FEATURES))
    y = got["quality"].to_numpy(int)
    order = np.lexsort((*x.T, y)) if len(x) else np.zeros(0, int)  # the same model whatever order the rows come in
    return x[order], y[order]


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: id and COUNTS of the text."""
    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, " + ", ".join(f"{n} long" for n in COUNTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_slices(batches, text_col, SMALL_SLICE_BYTES):
            s = statistics(part.column(text_col))
            yield pa.RecordBatch.from_arrays([part.column(id_col), *(pa.array(s[n]) for n in COUNTS)], names=[id_col, *COUNTS])

    return df.select(id_col, text_col).mapInArrow(run, schema)


def _counts(part: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {n: part.column(n).to_numpy(zero_copy_only=False) for n in COUNTS}


def fit(df: DataFrame, labels: DataFrame, keep: float = 0.995, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> RuleModel:
    """Forest over all rows labelled good, split over the values of both labels, and a threshold that keeps the share `keep` of them.

    Good rows that fail the base rules are left out, as the verdict is on the others only. Without labels nothing is anomalous.
    """
    return fit_measured(materialize(measure(df, id_col, text_col), "rule-counts"), labels, keep, seed, id_col)


def fit_measured(counts: DataFrame, labels: DataFrame, keep: float = 0.995, seed: int = 7, id_col: str = "doc_id") -> RuleModel:
    """The model of `fit`, of rows of `measure`.

    Every labelled id counts once: of labels that contradict each other the highest, of several texts the one of least
    counts. Splits need only the span of the rows, so they are drawn first; then all rows go down every tree where they
    lie. What comes to the driver are sums by node, and the bins that narrow down the threshold.
    """
    ids = labels.where(F.col("quality").isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max("quality").alias("quality"))
    each = counts.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(F.struct(*COUNTS)).alias("least"))
    names = [f"x{k}" for k in range(len(FOREST))]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            s = _counts(part)
            x = features(s)[:, FOREST]
            passed = ~base_failed(s["n_words"], s["n_repeat_words"])
            good = passed & (part.column("quality").to_numpy(zero_copy_only=False) == 1)
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in x.T), pa.array(passed), pa.array(good)], names=[*names, "passed", "good"])

    matrix = lambda part: np.column_stack([part.column(n).to_numpy() for n in names])
    schema = ", ".join([f"{n} double" for n in names] + ["passed boolean", "good boolean"])
    seen = materialize(each.join(ids, id_col).select("quality", "least.*").mapInArrow(look, schema), "rule-rows")
    n, *ends = seen.agg(F.count_if("good"), *[f(c) for f in (F.min, F.max) for c in names]).first()
    if n < 2:
        return RuleModel(None, np.inf)
    drawn = IsolationForest.drawn((np.array(ends[: len(names)]), np.array(ends[len(names) :])), seed=seed)
    shape = drawn.feature.shape

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = np.zeros(shape, np.int64)
        for part in batches:
            for t, node in enumerate(drawn.ends(matrix(part))):
                rows[t] += np.bincount(node, minlength=shape[1])
        at = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(rows.ravel()[at])], names=["node", "rows"])

    sums = seen.where("good").select(*names).mapInArrow(count, "node long, rows long").groupBy("node").agg(F.sum("rows").alias("rows")).toPandas()
    rows = np.zeros(shape, np.int64)
    rows.ravel()[sums["node"].to_numpy()] = sums["rows"].to_numpy()
    forest = drawn.counted(rows, n)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            yield pa.RecordBatch.from_arrays([pa.array(forest.scores(matrix(part))), part.column("good")], names=["score", "good"])

    scores = seen.where("passed").select(*names, "good").mapInArrow(score, "score double, good boolean")
    return RuleModel(forest, calibrate(materialize(scores, "rule-scores"), keep))


def base_failed(n_words: np.ndarray, n_repeat_words: np.ndarray, min_words: int = 50, max_repeat_percent: int = 50) -> np.ndarray:
    """Fewer than min_words words, or over max_repeat_percent of them in repeated three-word windows."""
    return (n_words < min_words) | (100 * n_repeat_words > max_repeat_percent * n_words)


def apply(df: DataFrame, model: RuleModel, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """One row per row of df: id, the rule statistics, base_failed, anomaly (0 to 1) and kept.

    base_failed: fewer than min_words words, or over max_repeat_percent of them in repeated three-word windows. Null and
    empty texts have no words and fail. Repeated rows each give a row, null ids stay null, other columns aren't read.
    """
    run, schema = _judge(df, model, id_col, min_words, max_repeat_percent)
    return df.select(id_col, text_col).mapInArrow(lambda batches: (run(part, statistics(part.column(text_col))) for part in byte_slices(batches, text_col, SMALL_SLICE_BYTES)), schema)


def apply_measured(counts: DataFrame, model: RuleModel, id_col: str = "doc_id", min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """The rows of `apply`, of rows of `measure`."""
    run, schema = _judge(counts, model, id_col, min_words, max_repeat_percent)
    return counts.mapInArrow(lambda batches: (run(part, _counts(part)) for part in batches), schema)


def fit_and_apply(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `apply` by the model of `fit`, with the texts read once."""
    counts = materialize(measure(df, id_col, text_col), "rule-counts")
    return apply_measured(counts, fit_measured(counts, labels, id_col=id_col), id_col)


def _judge(df: DataFrame, model: RuleModel, id_col: str, min_words: int, max_repeat_percent: int) -> tuple[Callable[[pa.RecordBatch, dict[str, np.ndarray]], pa.RecordBatch], str]:
    """(function of a slice with ids and its counts, schema of what it gives)."""
    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, " + ", ".join(f"{n} long" for n in STATS) + ", base_failed boolean, anomaly double, kept boolean"

    def run(part: pa.RecordBatch, s: dict[str, np.ndarray]) -> pa.RecordBatch:
        failed = base_failed(s["n_words"], s["n_repeat_words"], min_words, max_repeat_percent)
        score, odd = model.anomalous(features(s))
        return pa.RecordBatch.from_arrays(
            [part.column(id_col), *(pa.array(s[n]) for n in STATS), pa.array(failed), pa.array(score), pa.array(~failed & ~odd)],
            names=[id_col, *STATS, "base_failed", "anomaly", "kept"],
        )

    return run, schema
