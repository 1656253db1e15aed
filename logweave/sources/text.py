"""Reading of log files, and writing of templates, clusters and distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.operators.parsing import parse_lines


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): a row per line; lines end at line feeds only. A path that doesn't exist is an error."""
    return spark.read.text(path, lineSep="\n")


def stream_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same of files as they appear."""
    return spark.readStream.text(path, lineSep="\n")


def read_syslog(spark: SparkSession, path: str, fmt: str, year: int = 1970, **options) -> DataFrame:
    """Lines parsed by a format string; blank ones are left out."""
    return parse_lines(read_lines(spark, path), fmt, year=year, **options)


def template_lines(templates: DataFrame, prefix: str = "") -> DataFrame:
    """(value): the prefix and a template per line."""
    return templates.select(F.concat(F.lit(prefix), "template").alias("value"))


def template_param_lines(templates: DataFrame, prefix: str = "") -> DataFrame:
    """(value): a template with its parameters, several lines in one value; `Split: ` before those that came of a split."""
    entries = F.array_sort(F.map_entries("params"))
    param = F.transform(entries, lambda e: F.concat(F.lit("\n  Params at pos "), e["key"].cast("string"), F.lit(":"), F.concat_ws("", F.transform(F.array_sort(e["value"]), lambda v: F.concat(F.lit(" "), v)))))
    over = F.when(F.size("exceeded") > 0, F.concat(F.lit("\n  Positions with max num of tokens exceeded: "), F.concat_ws(" ", F.transform("exceeded", lambda x: x.cast("string"))))).otherwise("")
    return templates.select(F.concat(F.when(F.col("split"), "Split: ").otherwise(""), F.lit(prefix), F.col("template"), F.concat_ws("", param), over).alias("value"))


def filtered_lines(messages: DataFrame) -> DataFrame:
    """(value): `Process 'p' with PID 'n' wrote 'm'`, the middle part only where there is a pid."""
    pid = F.coalesce(F.concat(F.lit(" with PID '"), F.col("pid").cast("string"), F.lit("'")), F.lit(""))
    return messages.select(F.concat(F.lit("Process '"), "process", F.lit("'"), pid, F.lit(" wrote '"), "message", F.lit("'")).alias("value"))


def assignment_lines(clusters: DataFrame, line: Column | str = "message") -> DataFrame:
    """(value): `<cluster id> -> <line>`."""
    return clusters.select(F.concat(F.col("cluster_id").cast("string"), F.lit(" -> "), line).alias("value"))


def nested_report(leaves: DataFrame, process: str = "process", width: int = 12) -> DataFrame:
    """process, leaf, value: a line per member, prefixed A- and B- in turn by leaf, and by the path padded to a width."""
    mark = F.when(F.col("leaf") % 2 == 0, "A-").otherwise("B-")
    path = F.rpad(F.when(F.col("path") == "", "").otherwise(F.concat("path", F.lit("-"))), width, " ")
    each = leaves.select(process, "leaf", mark.alias("mark"), path.alias("p"), F.explode("members").alias("m"))
    return each.select(process, "leaf", F.concat("mark", "p", F.lit(" "), "m").alias("value"))


def nested_counts(leaves: DataFrame, process: str = "process") -> DataFrame:
    """process, value: how many leaves there are, the report's header."""
    return leaves.groupBy(process).agg(F.concat(F.count("*").cast("string"), F.lit(" clusters")).alias("value"))


def write_text(lines: DataFrame, path: str, by: str | None = None, mode: str = "errorifexists") -> None:
    """Write (value), in a folder for each value of `by` if given."""
    writer = lines.write.mode(mode)
    (writer.partitionBy(by) if by else writer).text(path)


def write_distances(pairs: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Pairs with distance, and cutoff where there is one, as Parquet."""
    pairs.write.mode(mode).parquet(path)
