"""Quality classifier: Bradley-Terry scores from preference pairs, thresholded at a score quantile."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import SMALL_SLICE_BYTES, byte_slices
from logweave.llm.quality_rules import labelled_features
from logweave.llm.textstats import features, statistics

#: Labelled rows that the model is fitted on at most (those of lowest hash), and preference pairs drawn from them.
SAMPLE_ROWS, PAIRS = 20_000, 60_000
#: The probability that the threshold stands for.
AT = 0.7


def held_out(column: str = "doc_id"):
    """Rows kept from learning: crc32 of the id as text leaves 2 when divided by 4. A null id isn't held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def is_held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


@dataclass
class RankModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    spread: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def probability(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, and AT exactly at the threshold."""
        z = (self.raw(x) - self.threshold) / self.spread + np.log(AT / (1 - AT))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit_pairs(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, seed: int = 11, ridge: float = 1e-2, rounds: int = 30) -> RankModel:
    """P(a preferred to b) = sigmoid(w (x_a - x_b)), by Newton steps on the logistic loss of pairs of a good and a bad row.

    The threshold is the quantile of the scores that separates the labels best; of equally good ones, the middle of the
    longest run. With one class only, or no rows, every document scores above the threshold.
    """
    d = x.shape[1] if len(x) else len(features({k: np.zeros(1) for k in ("n_words", "word_chars", "n_symbols", "upper", "lower", "digit", "stop", "loud", "mark", "high", "n_dup_lines", "n_repeat_words", "n_unique", "n_lines")})[0])
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return RankModel(np.zeros(d), np.ones(d), np.zeros(d), -1.0, 1.0)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.clip((x - mean) / scale, -8, 8)
    rng = np.random.default_rng(seed)
    delta = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = np.zeros(d)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(delta @ w, -30, 30)))
        gradient = delta.T @ (1 - p) / pairs - ridge * w
        hessian = (delta * (p * (1 - p))[:, None]).T @ delta / pairs + ridge * np.eye(d)
        step = np.linalg.solve(hessian, gradient)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    score = z @ w
    order = np.argsort(score, kind="stable")
    s, label = score[order], y[order]
    # rows below the cut are rejected: balanced accuracy of a cut below each row
    accuracy = np.concatenate([[0], np.cumsum(label == 0)]) / len(bad) + 1 - np.concatenate([[0], np.cumsum(label == 1)]) / len(good)
    best = np.flatnonzero(accuracy == accuracy.max())
    run = max(np.split(best, np.flatnonzero(np.diff(best) > 1) + 1), key=len)
    cut = run[len(run) // 2]
    below, above = s[max(cut - 1, 0)], s[min(cut, len(s) - 1)]
    return RankModel(mean, scale, w, float((below + above) / 2), float(max(score.std(), 1e-6) / 4))


def fit(df: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, id_col: str = "doc_id") -> RankModel:
    """Learn from labelled rows that aren't held out; labels.quality is all that's read of them."""
    return fit_pairs(*labelled_features(df, labels, rows, ~held_out(id_col), id_col))


def score(df: DataFrame, model: RankModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: id, held_out, score (0 to 1, also for null and empty texts), predicted (score >= 0.7).

    Repeated rows each give a row; null ids stay null and aren't held out. Only the text is an input of the score.
    """
    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, held_out boolean, score double, predicted int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_slices(batches, text_col, SMALL_SLICE_BYTES):
            p = model.probability(features(statistics(part.column(text_col))))
            out = pa.array([is_held_out(i) for i in part.column(id_col).to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([part.column(id_col), out, pa.array(p), pa.array((p >= AT).astype(np.int32))], names=[id_col, "held_out", "score", "predicted"])

    return df.select(id_col, text_col).mapInArrow(run, schema)


def keep_good(df: DataFrame, model: RankModel, text_col: str = "text") -> DataFrame:
    """The rows of df that the model doesn't reject, with all their columns.

    Null and empty texts are scored as texts without words; repeated rows stay or go together; ids may be null. An empty
    table stays empty.
    """
    schema = df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_slices(batches, text_col, SMALL_SLICE_BYTES):
            p = model.probability(features(statistics(part.column(text_col))))
            yield part.filter(pa.array(p >= AT))

    return df.mapInArrow(run, schema)
