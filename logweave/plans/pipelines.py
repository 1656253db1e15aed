"""The composite queries: template mining of a log, and the three clusterings of a syslog."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.functions import masking
from logweave.operators import clustering
from logweave.operators.graph import _written
from logweave.operators.parsing import parse_lines
from logweave.operators.templates import TemplateMiner, frequencies
from logweave.sources import text as sinks


def masked_distinct(lines: DataFrame, column: str = "value", chain: masking.MaskChain = masking.DEFAULT) -> DataFrame:
    """(value): the distinct masked lines. Only they go on, so what is masked alike is folded once.

    The masks come out of a generator, past which no filter on the result is moved: they would run again in the filter.
    """
    masked = lines.select(F.inline(F.array(F.struct(chain(F.col(column)).alias("value")))))
    return masked.distinct()


def template_frequencies(lines: DataFrame, column: str = "value", threshold: float = 0.34) -> DataFrame:
    """(template, n): how many lines each mined template fits. Lines are masked once; what comes of it is written."""
    masked = lines.select(F.inline(F.array(F.struct(masking.DEFAULT(F.col(column)).alias("value")))))
    counted = _written(masked.groupBy("value").agg(F.count("*").alias("n")), "masked-lines")
    return frequencies(counted, TemplateMiner(threshold).mine(counted.select("value")))


def mine_log(lines: DataFrame, column: str = "value", threshold: float = 0.34, params: bool = True, split: bool = True) -> DataFrame:
    """Mask, dedup, mine and split."""
    return TemplateMiner(threshold, params, split).mine(masked_distinct(lines, column))


def masked_messages(lines: DataFrame, fmt: str, column: str = "value", chain: masking.MaskChain = masking.DEFAULT, **options) -> DataFrame:
    """Parsed lines without errors, their messages masked."""
    parsed = parse_lines(lines, fmt, column, **options).where(~F.col("_error"))
    kept = [c for c in parsed.columns if c != "message"]
    return parsed.select(*kept, F.inline(F.array(F.struct(chain(F.col("message")).alias("message")))))


def syslog_flat(lines: DataFrame, fmt: str = "${DATE} ${ORIGIN} ${MESSAGE}", cutoff: float = 0.3, **options) -> DataFrame:
    return clustering.cluster_flat(masked_messages(lines, fmt, hosts=False, **options), cutoff=cutoff)


def syslog_by_process(lines: DataFrame, fmt: str = "${DATE} ${ORIGIN} ${MESSAGE}", **options) -> DataFrame:
    return clustering.cluster_by_process(masked_messages(lines, fmt, hosts=False, **options))


def syslog_nested(lines: DataFrame, fmt: str = "${DATE} ${ORIGIN} ${MESSAGE}", **options) -> DataFrame:
    return clustering.cluster_nested(masked_messages(lines, fmt, chain=masking.NESTED, hosts=False, **options))


def main(argv: list[str] | None = None) -> int:
    """logweave <log file> <output folder>: templates as text, and with parameters in <output folder>_pars."""
    parser = argparse.ArgumentParser(prog="logweave")
    parser.add_argument("input")
    parser.add_argument("output")
    parser.add_argument("--threshold", type=float, default=0.34)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("logweave").getOrCreate()
    found = mine_log(sinks.read_lines(spark, args.input), threshold=args.threshold).cache()
    sinks.write_text(sinks.template_lines(found), args.output, mode="overwrite")
    sinks.write_text(sinks.template_param_lines(found), f"{args.output}_pars", mode="overwrite")
    return 0
