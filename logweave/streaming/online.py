"""The template miner over a stream: each bucket's templates are its state, and every batch updates them."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from logweave.operators.templates import Bucket, TemplateMiner, bucket_columns

OUTPUT = "n_tokens int, kind string, token string, node int, template string, lines long, version long, params map<int,array<string>>"


def mine_stream(lines: DataFrame, miner: TemplateMiner, column: str = "value", ttl_ms: int | None = None) -> DataFrame:
    """Rows (bucket, node, template, lines, version) of the templates that a micro-batch changed, in update mode.

    Within a batch a bucket's lines are taken in byte order, so one batch gives what the batch miner does before its
    split. A bucket not seen for ttl_ms of processing time is dropped; without it, state stays, as it has no event time.
    """
    text = F.col(column)
    keys = ["n_tokens", "kind", "token"]
    rows = lines.where(text.isNotNull() & (text != "")).select(text.alias("line"), *bucket_columns(text))

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        bucket, version = pickle.loads(state.get[0]) if state.exists else (Bucket(miner.threshold, miner.store_params), 0)
        batch = sorted(line for f in frames for line in f["line"])
        changed = sorted({bucket.add(line) for line in batch})
        version += 1
        state.update((pickle.dumps((bucket, version)),))
        if ttl_ms:
            state.setTimeoutDuration(ttl_ms)
        out = []
        for k in changed:
            node = bucket.nodes[k]
            out.append((*key, k, node.text, node.lines, version, {p: sorted(v) for p, v in node.params.items()}))
        yield pd.DataFrame(out, columns=[*keys, "node", "template", "lines", "version", "params"])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout
    return rows.groupBy(*keys).applyInPandasWithState(update, OUTPUT, "bucket binary", "update", timeout)


def latest(updates: DataFrame) -> DataFrame:
    """The newest version of every template of a table of updates."""
    keys = ["n_tokens", "kind", "token", "node"]
    best = updates.groupBy(*keys).agg(F.max_by(F.struct("template", "lines", "params"), "version").alias("t"))
    return best.select(*keys, "t.*")
