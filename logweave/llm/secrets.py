"""Secret scans with an incremental blob ledger. DataFrame functions only.

Texts are addressed by their content. A ledger table keeps what each rule version found in each blob; a scan looks only
at blobs that the ledger lacks for the current version, each once, and findings are joined back to every path.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import scratch_path

#: Kind, pattern, and what a match must satisfy, in the order that decides ties. The last two patterns hold the least
#: length themselves: a run that is too short has no part that is long enough.
ASSIGN = r"""(?i:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
RULES = (("assign", ASSIGN, 6), ("access", r"AKIA[A-Z0-9]{16,}", 0), ("hex", r"[0-9a-f]{24,}", 0))
RULE_VERSION = "2024-1"
LEDGER = "blob string, n_assign long, n_access long, n_hex long, spans string, rule_version string"


def _spans(text: Column, kind: str, rank: int, pattern: str, least: int) -> Column:
    """Array of (start, rank, label) of the matches, by the lengths of matches and of what lies between them."""
    p = F.lit(pattern)
    found, gaps = F.regexp_extract_all(text, p, F.lit(0)), F.split(text, pattern, -1)
    values = F.regexp_extract_all(text, p, F.lit(1)) if least else found
    pieces = F.arrays_zip(found.alias("m"), F.slice(gaps, F.lit(1), F.size(found)).alias("g"), values.alias("v"))
    none = F.array().cast("array<struct<start:int,rank:int,label:string>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + F.length(x["g"])
        end = start + F.length(x["m"])
        label = F.concat(F.lit(f"{kind}:"), start.cast("string"), F.lit(":"), end.cast("string"))
        one = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), label.alias("label")))
        kept = F.when(F.length(x["v"]) >= least, F.concat(acc["out"], one)).otherwise(acc["out"]) if least else F.concat(acc["out"], one)
        return F.struct(end.alias("pos"), kept.alias("out"))

    folded = F.aggregate(pieces, F.struct(F.lit(0).alias("pos"), none.alias("out")), step)["out"]
    return F.when(text.rlike(pattern), folded).otherwise(none)


def scan(blobs: DataFrame) -> DataFrame:
    """(blob, text) to rows of the ledger: counts by kind, and all spans by start, then kind, joined by commas."""
    text = F.col("text")
    found = blobs.select("blob", *[_spans(text, kind, k, pattern, least).alias(kind) for k, (kind, pattern, least) in enumerate(RULES)])
    every = F.array_sort(F.concat(*[F.col(kind) for kind, _, _ in RULES]))
    counts = [F.size(kind).cast("long").alias(f"n_{kind}") for kind, _, _ in RULES]
    return found.select("blob", *counts, F.array_join(F.transform(every, lambda x: x["label"]), ",").alias("spans"))


def _ledger(df: DataFrame, path: str) -> DataFrame | None:
    try:
        return df.sparkSession.read.schema(LEDGER).parquet(path)
    except AnalysisException:
        return None


def update_ledger(versions: DataFrame, path: str, rule_version: str = RULE_VERSION, text_col: str = "text") -> DataFrame:
    """Scan what the ledger at `path` hasn't seen under rule_version, append it, and return that version's ledger.

    versions: every historical version of every file, a row each; null texts are empty ones.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    blobs = versions.select(F.sha2(text, 256).alias("blob"), text.alias("text"))
    seen = _ledger(versions, path)
    if seen is not None:
        blobs = blobs.join(seen.where(F.col("rule_version") == rule_version).select("blob"), "blob", "left_anti")
    scan(blobs.distinct()).withColumn("rule_version", F.lit(rule_version)).write.mode("append").partitionBy("rule_version").parquet(path)
    return _ledger(versions, path).where(F.col("rule_version") == rule_version)


def scan_documents(df: DataFrame, ledger: str | None = None, rule_version: str = RULE_VERSION, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: id, n_assign, n_access, n_hex, base_sha256 (of the base spans) and spans.

    The rules add no spans to the base ones. Null and empty texts have none; repeated rows each give a row; null ids stay
    null; other columns aren't read. Without a ledger path a new one is begun. Only findings, not blobs without any,
    take part in the join back, which is salted, as one leaked file may be copied to a third of all paths.
    """
    known = update_ledger(df.select(id_col, text_col), ledger or scratch_path(df.sparkSession, "ledger"), rule_version, text_col)
    paths = df.select(F.col(id_col).alias("id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("blob"))
    paths = paths.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(16)).cast("int"))
    hits = known.where("spans <> ''").drop("rule_version").dropDuplicates(["blob"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    got = paths.join(hits, ["blob", "salt"], "left")
    spans = F.coalesce("spans", F.lit(""))
    return got.select(F.col("id").alias(id_col), *[F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k, _, _ in RULES], F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans"))


def _sql_kind(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    return f"""
{kind}_m AS (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {group}) AS v, string_split_regex(t, '{pattern}') AS g FROM d),
{kind}_u AS (SELECT doc_id, unnest(range(1, len(m) + 1)) AS i, m, v, g FROM {kind}_m),
{kind} AS (SELECT doc_id, {rank} AS r, '{kind}' AS kind,
    CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s, length(m[i]) AS n FROM {kind}_u WHERE length(v[i]) >= {least})"""


SECRETS_SQL = (
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),"
    + ",".join(
        _sql_kind(kind, k, (pattern.replace("'", "''") if kind != "assign" else r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""), 2 if kind == "assign" else 0, least)
        for k, (kind, pattern, least) in enumerate(RULES)
    )
    + """,
f AS (SELECT * FROM assign UNION ALL SELECT * FROM access UNION ALL SELECT * FROM hex),
a AS (SELECT doc_id, count(*) FILTER (r = 0) AS n_assign, count(*) FILTER (r = 1) AS n_access, count(*) FILTER (r = 2) AS n_hex,
    string_agg(kind || ':' || CAST(s AS VARCHAR) || ':' || CAST(s + n AS VARCHAR), ',' ORDER BY s, r) AS spans FROM f GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (doc_id)"""
)
