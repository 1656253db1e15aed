"""Named queries over the driver tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.functions import distance, hashing, masking, tokens
from logweave.operators import clustering, parsing, templates
from logweave.operators.graph import connected_components, shared_path
from logweave.plans import pipelines
from logweave.sources import text as sinks

Query = Callable[[SparkSession, str], DataFrame]

#: One log message per event, in the SQL of both engines ({S}: its string type).
MSG = """CASE event_type
 WHEN 'error' THEN concat('Failed request 0x', lower(hex(event_id)), ' from 10.0.', cast(user_id % 256 as {S}), '.', cast(event_id % 256 as {S}), ' after ', cast(cast(value as decimal(10,2)) as {S}), ' ms')
 WHEN 'view' THEN concat('Directory /srv/u', cast(user_id as {S}), '/d', cast(event_id % 97 as {S}), ' was viewed [req ', cast(event_id as {S}), ']')
 WHEN 'click' THEN concat('Login of user u', cast(user_id as {S}), ', status: ', CASE WHEN value >= 50 THEN 'successful' ELSE 'failed' END)
 WHEN 'signup' THEN concat('User u', cast(user_id as {S}), CASE WHEN event_id % 2 = 0 THEN ' logged on' ELSE ' saved state' END, ' successfully')
 ELSE concat('order id=', cast(event_id as {S}), ' amount=', cast(cast(value as decimal(10,2)) as {S}), ' size=', cast(event_id % 512 as {S}), ' KB') END"""
#: Two IPv6 addresses, and a line's head as libvirtd writes it.
IP6 = "concat('2001:db8::', lower(hex(user_id + 1)), ' [2001:db8::1:', lower(hex(event_id)), ']:80')"
#: A number in hexadecimal groups of four digits at most, as a longer one is no address; and the same two addresses of any numbers.
_GROUPS = lambda n: f"regexp_replace(lower(hex({n})), '(?<=.)(?=(?:.{{4}})+$)', ':')"
IP6_OF_ANY = f"concat('2001:db8::', {_GROUPS('user_id + 1')}, ' [2001:db8::1:', {_GROUPS('event_id')}, ']:80')"
LIBVIRTD = "concat('2018-05-', lpad(cast(event_id % 28 + 1 as {S}), 2, '0'), ' 12:41:35.123+0000: ', cast(event_id as {S}), ': ')"
#: The same with a value of every kind that a mask looks for.
RICH = """concat('Wed May ', lpad(cast(event_id % 28 + 1 as {S}), 2, '0'), ' 2018 12:41:35 CET ', '2018-05-', lpad(cast(event_id % 28 + 1 as {S}), 2, '0'), ' 12:41:35 on 12/31/', lpad(cast(user_id % 100 as {S}), 2, '0'),
 ' at 10:11:', lpad(cast(user_id % 60 as {S}), 2, '0'), ' id 12345678-1234-1234-1234-', lpad(lower(hex(event_id)), 12, '0'), ' audit(1525.', cast(event_id as {S}), ':77) ', cast(event_id % 64 as {S}), 'K ', cast(user_id as {S}), ' kib in ',
 cast(event_id % 90 as {S}), '.5 seconds via enp', cast(user_id % 9 as {S}), 's3 eth', cast(user_id % 4 as {S}), ' aa:bb:cc:dd:ee:', lpad(lower(hex(user_id % 256)), 2, '0'), ' 10.1.', cast(user_id % 256 as {S}), '.7:8080 0x', lower(hex(event_id)),
 ' from ', {IP6}, ' <', event_type, '> [', event_type, '] x=', cast(event_id as {S}), ' (', cast(user_id as {S}), ') -', cast(user_id as {S}), ' ', event_type, cast(user_id as {S}), ',', cast(event_id as {S}))"""
RICH = RICH.replace("{IP6}", IP6)
_TS = {"string": "date_format(ts, 'MMM dd HH:mm:ss')", "varchar": "strftime(ts, '%b %d %H:%M:%S')"}


def _line(kind: str) -> str:
    return f"concat({_TS[kind]}, ' host', cast(user_id % 4 as {kind}), ' svc-', event_type, '[', cast(user_id as {kind}), ']: ', {MSG.replace('{S}', kind)})"


def loglines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, ts, user_id, event_type, msg, rich, value) with value the syslog line."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    keep = ["event_id", "ts", "user_id", "event_type"]
    return e.select(*keep, F.expr(MSG.replace("{S}", "string")).alias("msg"), F.expr(RICH.replace("{S}", "string")).alias("rich"), F.expr(_line("string")).alias("value"))


_V = f"WITH l AS (SELECT event_id, ts, user_id, event_type, {MSG.replace('{S}', 'varchar')} AS msg, {RICH.replace('{S}', 'varchar')} AS rich, {_line('varchar')} AS value FROM events)"
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        SQL[name] = sql


def _over(make: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: make(loglines(spark, sf_dir))


def _docs(make: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: make(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _parts(make: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: make(spark.read.parquet(f"{sf_dir}/part.parquet"))


# scans and parsing
_add("scan_lines", _over(lambda d: d.select("event_id", "value")), f"{_V} SELECT event_id, value FROM l")
FORMAT = "${DATE} ${ORIGIN} ${MESSAGE}"
_add(
    "parse_syslog",
    _over(lambda d: parsing.parse_lines(d.select("event_id", "value"), FORMAT, year=2000, hosts=False).select("event_id", F.date_format("ts", "MM-dd HH:mm:ss").alias("at"), "origin", "process", "pid", "message", F.col("_error").cast("int").alias("error"))),
    f"{_V} SELECT event_id, strftime(ts, '%m-%d %H:%M:%S') AS at, 'host' || (user_id % 4) AS origin, 'svc-' || event_type AS process, CAST(user_id AS INTEGER) AS pid, msg AS message, 0 AS error FROM l",
)
_add(
    "parse_syslog_ignore",
    _over(lambda d: parsing.parse_lines(d.select("event_id", "value"), "${IGNORE} " * 4 + "${MESSAGE}").select("event_id", parsing.full_message(F.col("process"), F.col("pid"), F.col("message")).alias("full"), parsing.tagged_message(F.col("process"), F.col("message")).alias("tagged"))),
    f"{_V} SELECT event_id, 'svc-' || event_type || '[' || user_id || ']: ' || msg AS \"full\", 'svc-' || event_type || ': ' || msg AS tagged FROM l",
)
_SPLIT = "concat(CASE event_id % 6 WHEN 0 THEN 'proc[12]: a' WHEN 1 THEN 'proc: b' WHEN 2 THEN 'proc[]: c' WHEN 3 THEN 'nocolon' WHEN 4 THEN ': d' ELSE 'p[x]: e' END, ' ', event_type)"
_add(
    "split_message",
    _over(lambda d: d.select("event_id", *[v.cast("int").alias(k) if k == "error" else v.alias(k) for k, v in parsing.split_message(F.expr(_SPLIT)).items()])),
    f"""SELECT event_id, CASE WHEN event_id % 6 < 3 THEN 'proc' END AS process, CASE event_id % 6 WHEN 0 THEN 12 WHEN 2 THEN 0 END AS pid,
    CASE event_id % 6 WHEN 0 THEN 'a ' || event_type WHEN 1 THEN 'b ' || event_type WHEN 2 THEN 'c ' || event_type END AS message, CASE WHEN event_id % 6 < 3 THEN 0 ELSE 1 END AS error FROM events""",
)


def _levels(d: DataFrame) -> DataFrame:
    names = F.array(*map(F.lit, parsing.FACILITIES))
    text = F.concat(F.get(names, F.col("event_id") % 23), F.lit(" "), (F.col("user_id") % 8).cast("string"), F.lit(" p: m"))
    got = parsing.parse_lines(d.select("event_id", text.alias("value")), "${FACILITY} ${SEVERITY_NUM} ${MESSAGE}")
    return got.select("event_id", "facility", "severity", parsing.facility_name(F.col("facility")).alias("facility_name"), parsing.severity_name(F.col("severity")).alias("severity_name"))


_names = lambda n: "[" + ", ".join(f"'{x}'" for x in n) + "]"
_add("facility_severity", _over(_levels), f"SELECT event_id, CAST(event_id % 23 AS INTEGER) AS facility, CAST(user_id % 8 AS INTEGER) AS severity, {_names(parsing.FACILITIES)}[CAST(event_id % 23 + 1 AS INTEGER)] AS facility_name, {_names(parsing.SEVERITIES)}[CAST(user_id % 8 + 1 AS INTEGER)] AS severity_name FROM events")


def _level_numbers(d: DataFrame) -> DataFrame:
    names = F.array(*map(F.lit, parsing.SEVERITIES))
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z '"), (F.col("event_id") % 23).cast("string"), F.lit(" "), F.get(names, F.col("user_id") % 8), F.lit(" p[1][2]: m"))
    got = parsing.parse_lines(d.select("event_id", text.alias("value")), "${ISODATE} ${FACILITY_NUM} ${SEVERITY} ${MESSAGE}")
    return got.select("event_id", F.unix_micros("ts").alias("us"), "facility", "severity", "process", "pid")


_add("level_numbers", _over(_level_numbers), "SELECT event_id, epoch_us(date_trunc('second', ts)) AS us, CAST(event_id % 23 AS INTEGER) AS facility, CAST(user_id % 8 AS INTEGER) AS severity, 'p[1]' AS process, 2 AS pid FROM events")
_HOST = "CASE event_id % 3 WHEN 0 THEN concat('10.0.', cast(user_id % 256 as {S}), '.1') WHEN 1 THEN concat('2001:db8::', lower(hex(user_id + 1))) ELSE concat('host', cast(user_id as {S}), '.local') END"
_add("log_hosts", _over(lambda d: d.select("event_id", parsing.log_host(F.expr(_HOST.replace("{S}", "string"))).alias("h")).select("event_id", "h.kind", "h.addr")), f"SELECT event_id, ['ipv4', 'ipv6', 'name'][CAST(event_id % 3 + 1 AS INTEGER)] AS kind, {_HOST.replace('{S}', 'varchar')} AS addr FROM events")
_add("host_kinds", _over(lambda d: d.select("event_id", parsing.host_kind(F.expr(_HOST.replace("{S}", "string"))).alias("kind"))), "SELECT event_id, ['ipv4', 'ipv6', 'name'][CAST(event_id % 3 + 1 AS INTEGER)] AS kind FROM events")
_add("iso_times", _over(lambda d: d.select("event_id", F.unix_micros(parsing.iso_time(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")))).alias("us"))), "SELECT event_id, epoch_us(date_trunc('second', ts)) - 7200000000 AS us FROM events")
_add("iso_times_compat", _over(lambda d: d.select("event_id", F.unix_micros(parsing.iso_time(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")), "reference")).alias("us"))), "SELECT event_id, epoch_us(date_trunc('second', ts)) + 7200000000 AS us FROM events")
_add("custom_times", _over(lambda d: d.select("event_id", F.unix_micros(parsing.custom_time(F.date_format("ts", "dd/MM/yyyy HH:mm:ss"), "%d/%m/%Y %H:%M:%S")).alias("us"))), "SELECT event_id, epoch_us(date_trunc('second', ts)) AS us FROM events")


def _log_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log written to a file and read again by the syslog reader."""
    path = shared_path(spark, "log")
    loglines(spark, sf_dir).select("value").write.text(path)
    got = sinks.read_syslog(spark, path, FORMAT, year=2000, hosts=False)
    return got.groupBy("process", "pid", "message", F.col("_error").cast("int").alias("error")).agg(F.count("*").alias("n"))


_add("read_syslog", _log_file, f"{_V} SELECT 'svc-' || event_type AS process, CAST(user_id AS INTEGER) AS pid, msg AS message, 0 AS error, count(*) AS n FROM l GROUP BY ALL")


# masking
def _re2(mask: masking.Mask) -> str:
    pattern = mask.pattern
    for boundary in (masking.WB, masking.BEFORE, masking.BEHIND):
        pattern = pattern.replace(boundary, r"\b")
    return pattern.replace("'", "''")


def _mask_sql(mask: masking.Mask, text: str) -> str:
    if mask.name == "number_constant":  # the right-hand delimiter is consumed, so neighbours take two passes
        p = rf"(^|[{masking.LEFT}])(-?\d+)([{masking.RIGHT}]|$)".replace("'", "''")
        once = f"regexp_replace({text}, '{p}', '\\1$v\\3', 'g')"
        return f"regexp_replace({once}, '{p}', '\\1$v\\3', 'g')"
    to = mask.replacement.replace(r"\$", "$") if mask.name != "separation_inserter" else r"\1 \2"
    return f"regexp_replace({text}, '{_re2(mask)}', '{to}', 'g')"


for _m in masking.MASKS.values():
    _add(f"mask_{_m.name}", _over(lambda d, m=_m: d.select("event_id", m(F.col("rich")).alias("masked"))), None if _m.name in ("ipv6", "libvirtd") else f"{_V} SELECT event_id, {_mask_sql(_m, 'rich')} AS masked FROM l")
_add("mask_ipv6", lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", masking.IPV6(F.expr(RICH.replace(IP6, IP6_OF_ANY).replace("{S}", "string"))).alias("masked")))
SQL["mask_ipv6"] = f"SELECT event_id, {RICH.replace(IP6, chr(39) + '$v $v' + chr(39)).replace('{S}', 'varchar')} AS masked FROM events"
_add("mask_libvirtd", _over(lambda d: d.select("event_id", masking.LIBVIRTD(F.concat(F.expr(LIBVIRTD.replace("{S}", "string")), "msg")).alias("masked"))), f"{_V} SELECT event_id, '$v ' || msg AS masked FROM l")


def _chain_sql(chain: masking.MaskChain, text: str) -> str:
    for m in chain.order:
        text = text if m.name == "ipv6" else _mask_sql(m, text)  # these lines have no IPv6 address
    return text


_add("mask_chain", _over(lambda d: d.select("event_id", masking.DEFAULT(F.col("msg")).alias("masked"))), f"{_V} SELECT event_id, {_chain_sql(masking.DEFAULT, 'msg')} AS masked FROM l")
_add("mask_chain_nested", _over(lambda d: d.select("event_id", masking.NESTED(F.col("msg")).alias("masked"))), f"{_V} SELECT event_id, {_chain_sql(masking.NESTED, 'msg')} AS masked FROM l")
_add("extract_values", _over(lambda d: d.select("event_id", F.array_join(masking.HEX.extract(F.col("rich")), "\u0001").alias("hex"), F.array_join(masking.IPV4.extract(F.col("rich")), "\u0001").alias("ipv4"), F.array_join(masking.POINTED.extract(F.col("rich")), "\u0001").alias("pointed"))), f"{_V} SELECT event_id, array_to_string(regexp_extract_all(rich, '{_re2(masking.HEX)}'), chr(1)) AS hex, array_to_string(regexp_extract_all(rich, '{_re2(masking.IPV4)}'), chr(1)) AS ipv4, array_to_string(regexp_extract_all(rich, '{_re2(masking.POINTED)}'), chr(1)) AS pointed FROM l")
_add(
    "extract_chain",
    _over(lambda d: d.select("event_id", F.array_join(masking.DEFAULT.extract(F.col("msg")), "\u0001").alias("found"))),
    """SELECT event_id, CASE event_type WHEN 'click' THEN '' WHEN 'signup' THEN '' WHEN 'view' THEN '[req ' || event_id || ']'
 WHEN 'error' THEN concat_ws(chr(1), cast(cast(value as decimal(10,2)) as varchar) || ' ms', '10.0.' || user_id % 256 || '.' || event_id % 256, '0x' || lower(hex(event_id)))
 ELSE concat_ws(chr(1), event_id % 512 || ' KB', event_id, split_part(cast(cast(value as decimal(10,2)) as varchar), '.', 2)) END AS found FROM events""",
)
_add("distinct_masked", _over(lambda d: pipelines.masked_distinct(d.select(F.col("msg").alias("value")))), f"{_V} SELECT DISTINCT {_chain_sql(masking.DEFAULT, 'msg')} AS value FROM l")
_add("filtered_lines", _over(lambda d: d.select("event_id", F.concat(F.lit("svc-"), "event_type").alias("process"), F.col("user_id").alias("pid"), F.col("msg").alias("message")).transform(sinks.filtered_lines)), f"{_V} SELECT 'Process ''svc-' || event_type || ''' with PID ''' || user_id || ''' wrote ''' || msg || '''' AS value FROM l")

# tokens
_SP = r"[^\s=;,''\"()\[\]{}]+".replace('\\"', '"')
_add("words", _docs(lambda d: d.select("doc_id", F.size(tokens.words(F.col("text"))).alias("n"), F.array_join(tokens.words(F.col("text")), "\u0001").alias("joined"))), "SELECT doc_id, CAST(len(regexp_extract_all(text, '[^ \\t]+')) AS INTEGER) AS n, array_to_string(regexp_extract_all(text, '[^ \\t]+'), chr(1)) AS joined FROM documents")
_add("special_words", _over(lambda d: d.select("event_id", tokens.count_tokens(F.col("rich")).alias("n"), F.array_join(tokens.special_words(F.col("rich")), "\u0001").alias("joined"))), f"{_V} SELECT event_id, CAST(len(regexp_extract_all(rich, '{_SP}')) AS INTEGER) AS n, array_to_string(regexp_extract_all(rich, '{_SP}'), chr(1)) AS joined FROM l")
_QT = """'"[^"]*"?|''[^'']*''?|[^ \\t]+'"""
_add("quoted_words", _over(lambda d: d.select("event_id", F.array_join(tokens.quoted_words(F.concat(F.lit("say \"hello big\" it's 'a b'x "), "msg", F.lit(' "open end'))), "\u0001").alias("joined"))), f"""{_V} SELECT event_id, array_to_string(regexp_extract_all('say "hello big" it''s ''a b''x ' || msg || ' "open end', {_QT}), chr(1)) AS joined FROM l""")
_add("separators", _over(lambda d: d.select("event_id", F.array_join(tokens.separators(F.col("rich")), "\u0001").alias("joined"), tokens.previous_separators(F.col("rich"), F.lit(2)).alias("before2"), tokens.next_separators(F.col("rich"), F.lit(2)).alias("behind2"))), f"{_V} SELECT event_id, array_to_string(string_split_regex(rich, '{_SP}'), chr(1)) AS joined, string_split_regex(rich, '{_SP}')[3] AS before2, string_split_regex(rich, '{_SP}')[4] AS behind2 FROM l")
_add("possible_params", _over(lambda d: d.select("event_id", F.explode(tokens.special_words(F.col("msg"))).alias("t")).groupBy("event_id").agg(F.count("*").alias("n"), F.sum(tokens.is_possible_param(F.col("t")).cast("int")).alias("params"))), f"{_V} SELECT event_id, count(*) AS n, CAST(sum(CASE WHEN regexp_matches(t, '[^a-zA-Z0-9:]') THEN 1 ELSE 0 END) AS BIGINT) AS params FROM (SELECT event_id, unnest(regexp_extract_all(msg, '{_SP}')) AS t FROM l) GROUP BY event_id")
_add("word_spans", _over(lambda d: d.select("event_id", F.array_join(F.transform(tokens.spans(F.col("msg")), lambda s: F.substring("msg", s["begin"] + 1, s["end"] - s["begin"])), "\u0001").alias("joined"))), f"{_V} SELECT event_id, array_to_string(regexp_extract_all(msg, '[^ \\t]+'), chr(1)) AS joined FROM l")
_add("buckets", _over(lambda d: d.select(*templates.bucket_columns(F.col("msg"))).groupBy("n_tokens", "kind", "token").count().withColumnRenamed("count", "n")), f"""{_V}, t AS (SELECT regexp_extract_all(msg, '{_SP}') AS w FROM l), u AS (SELECT CAST(len(w) AS INTEGER) AS n_tokens, NOT regexp_matches(w[1], '[^a-zA-Z0-9:]') AS f, NOT regexp_matches(w[-1], '[^a-zA-Z0-9:]') AS b, w FROM t)
SELECT n_tokens, CASE WHEN f THEN 'first' WHEN b THEN 'last' ELSE 'first' END AS kind, CASE WHEN f THEN w[1] WHEN b THEN w[-1] ELSE '*' END AS token, count(*) AS n FROM u GROUP BY ALL""")

# distances
_PAIR = "SELECT a.p_name AS a, b.p_name AS b FROM (SELECT DISTINCT p_name FROM part) a JOIN (SELECT DISTINCT p_name FROM part) b ON a.p_name < b.p_name"


def _name_pairs(d: DataFrame) -> DataFrame:
    return clustering.pairs_within(d.select("p_name", F.lit(0).alias("k")).distinct(), ["k"], "p_name").select("a", "b")


_add("levenshtein", _parts(lambda d: _name_pairs(d).select("a", "b", distance.levenshtein(F.col("a"), F.col("b")).cast("long").alias("d"), distance.levenshtein(F.col("a"), F.col("b"), True).cast("long").alias("d_bytes"))), f"SELECT a, b, levenshtein(a, b) AS d, levenshtein(a, b) AS d_bytes FROM ({_PAIR})")
_wed_sql = lambda nu: f"WITH p AS (SELECT a, b, string_split(a, ' ') AS x, string_split(b, ' ') AS y FROM ({_PAIR})), q AS (SELECT a, b, x, y, unnest(range(1, greatest(len(x), len(y)) + 1)) AS k FROM p) SELECT a, b, round(sum(levenshtein(coalesce(x[k], ''), coalesce(y[k], '')) / (1 + exp(k - ({nu})))), 9) AS d FROM q GROUP BY a, b"
_add("weighted_distance", _parts(lambda d: _name_pairs(d).select("a", "b", F.round(distance.weighted_text_distance(F.col("a"), F.col("b")), 9).alias("d"))), _wed_sql(0))
_add("message_distance", _parts(lambda d: _name_pairs(d).select("a", "b", F.round(clustering.message_distance(F.col("a"), F.col("b")), 9).alias("d"))), _wed_sql(-1))
_add("logistic_decrease", _over(lambda d: d.select("event_id", F.round(distance.logistic_decrease(F.col("event_id") % 7, -1.0, 0.5), 12).alias("w"))), "SELECT event_id, round(1 / (1 + exp(0.5 * (event_id % 7) + 1)), 12) AS w FROM events")
_add("edit_path", _parts(lambda d: _name_pairs(d).select("a", "b", distance.edit_path("a", "b").alias("p")).select("a", "b", F.col("p.distance").cast("long").alias("d"), F.length(F.regexp_replace("p.ops", "R", "")).cast("long").alias("edits"))), f"SELECT a, b, levenshtein(a, b) AS d, levenshtein(a, b) AS edits FROM ({_PAIR})")
_add("word_edit_path", _parts(lambda d: _name_pairs(d).select("a", "b", distance.word_edit_path(tokens.words(F.col("a")), tokens.words(F.col("b"))).alias("p")).select("a", "b", "p.distance", "p.ops")), f"WITH p AS (SELECT a, b, string_split(a, ' ') AS x, string_split(b, ' ') AS y FROM ({_PAIR})) SELECT a, b, CAST((x[1] <> y[1])::INT + (x[2] <> y[2])::INT AS INTEGER) AS distance, (CASE WHEN x[1] = y[1] THEN 'R' ELSE 'S' END) || (CASE WHEN x[2] = y[2] THEN 'R' ELSE 'S' END) AS ops FROM p")
_ABC = """CASE event_id % 5 WHEN 0 THEN 'claw is my lawn' WHEN 1 THEN 'my lawn so far' WHEN 2 THEN 'claw my far' WHEN 3 THEN '' ELSE 'lawn' END"""
_add(
    "edit_scripts",  # deletions and insertions too
    _over(lambda d: d.select("event_id", distance.word_edit_path(tokens.words(F.lit("clawn is my lawn so far")), tokens.words(F.expr(_ABC))).alias("w"), distance.edit_path(F.lit("claw"), F.lit("lawn")).alias("c")).select("event_id", F.col("w.distance").alias("words"), F.col("w.ops").alias("script"), F.col("c.ops").alias("chars"))),
    "SELECT event_id, CAST([3, 2, 4, 6, 5][CAST(event_id % 5 + 1 AS INTEGER)] AS INTEGER) AS words, ['SRRRDD', 'DDRRRR', 'DSRDDR', 'DDDDDD', 'DDDRDD'][CAST(event_id % 5 + 1 AS INTEGER)] AS script, 'DRRRI' AS chars FROM events",
)
_add("word_distance", _parts(lambda d: _name_pairs(d).select("a", "b", distance.sequence_distance()(tokens.words(F.col("a")), tokens.words(F.col("b"))).alias("d"))), f"WITH p AS (SELECT a, b, string_split(a, ' ') AS x, string_split(b, ' ') AS y FROM ({_PAIR})) SELECT a, b, CAST((x[1] <> y[1])::INT + (x[2] <> y[2])::INT AS INTEGER) AS d FROM p")
_add("common_subsequence", _parts(lambda d: _name_pairs(d).select("a", "b", F.array_join(distance.common_subsequence()(F.array(tokens.words(F.col("a")), tokens.words(F.col("b")))), " ").alias("lcs"))), f"WITH p AS (SELECT a, b, string_split(a, ' ') AS x, string_split(b, ' ') AS y FROM ({_PAIR})) SELECT a, b, array_to_string(list_filter([CASE WHEN x[1] = y[1] THEN x[1] END, CASE WHEN x[2] = y[2] THEN x[2] END], lambda z: z IS NOT NULL), ' ') AS lcs FROM p")

# clustering
_EDGES = f"e AS (SELECT a, b FROM ({_wed_sql(-1)}) WHERE d < 0.3), s AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e)"
_add(
    "cluster_flat",
    _parts(lambda d: clustering.cluster_flat(d.select(F.col("p_name").alias("message")), cutoff=0.3)),
    f"WITH RECURSIVE {_EDGES}, r(m, x) AS (SELECT DISTINCT p_name, p_name FROM part UNION SELECT s.b, r.x FROM r JOIN s ON s.a = r.m), c AS (SELECT m, min(x) AS least FROM r GROUP BY m) SELECT m AS message, CAST(dense_rank() OVER (ORDER BY least) - 1 AS INTEGER) AS cluster_id FROM c",
)
_add(
    "cluster_by_process",
    _parts(lambda d: clustering.cluster_by_process(d.select(F.col("p_brand").alias("process"), F.col("p_name").alias("message"))).select("process", "message", "cluster_id", F.round("cutoff", 9).alias("cutoff"))),
    """WITH RECURSIVE i AS (SELECT DISTINCT p_brand AS p, p_name AS m FROM part),
w AS (SELECT x.p, x.m AS a, y.m AS b, string_split(x.m, ' ') AS u, string_split(y.m, ' ') AS v FROM i x JOIN i y ON x.p = y.p AND x.m < y.m),
k AS (SELECT p, a, b, u, v, unnest(range(1, greatest(len(u), len(v)) + 1)) AS k FROM w),
d AS MATERIALIZED (SELECT p, a, b, round(sum(levenshtein(coalesce(u[k], ''), coalesce(v[k], '')) / (1 + exp(k + 1))), 12) AS d FROM k GROUP BY p, a, b),
o AS (SELECT p, d, row_number() OVER (PARTITION BY p ORDER BY d) - 1 AS j, count(*) OVER (PARTITION BY p) AS n FROM d), mid AS (SELECT p, d AS mid FROM o WHERE j = n // 2),
h AS (SELECT p, CASE WHEN bool_or(d < mid) THEN max(CASE WHEN d < mid THEN d END) ELSE any_value(mid) END AS hi FROM d JOIN mid USING (p) GROUP BY p),
c(p, hi, k) AS (SELECT p, hi, 0 FROM h UNION ALL SELECT p, (SELECT max(d.d) FROM d WHERE d.p = c.p AND d.d <= ((SELECT avg(d.d) FROM d WHERE d.p = c.p AND d.d <= c.hi) + (SELECT avg(d.d) FROM d WHERE d.p = c.p AND d.d > c.hi)) / 2), k + 1 FROM c WHERE k < 30),
cut AS (SELECT p, hi FROM c WHERE k = 30), e AS (SELECT p, a, b FROM d JOIN cut USING (p) WHERE d < hi), s AS (SELECT p, a, b FROM e UNION ALL SELECT p, b, a FROM e),
r(p, m, x) AS (SELECT p, m, m FROM i UNION SELECT r.p, s.b, r.x FROM r JOIN s ON s.p = r.p AND s.a = r.m), f AS (SELECT p, m, min(x) AS least FROM r GROUP BY p, m)
SELECT f.p AS process, m AS message, CAST(dense_rank() OVER (PARTITION BY f.p ORDER BY least) - 1 AS INTEGER) AS cluster_id, round(hi, 9) AS cutoff FROM f JOIN cut ON cut.p = f.p""",
)
_add("cluster_nested", _parts(lambda d: clustering.cluster_nested(d.select(F.col("p_brand").alias("process"), F.col("p_name").alias("message")))))
_add("nested_report", _parts(lambda d: sinks.nested_report(clustering.leaves(clustering.cluster_nested(d.select(F.col("p_brand").alias("process"), F.col("p_name").alias("message")))))))
_add("agglomerative", _parts(lambda d: clustering.agglomerative(d.select(F.col("p_brand").alias("process"), F.col("p_name").alias("message")), ["process"], "message", lambda a, b: F.levenshtein(a, b) < 3)),
     """WITH RECURSIVE i AS (SELECT DISTINCT p_brand AS process, p_name AS m FROM part), s AS (SELECT x.process, x.m AS a, y.m AS b FROM i x JOIN i y ON x.process = y.process AND x.m <> y.m AND levenshtein(x.m, y.m) < 3),
r(process, m, x) AS (SELECT process, m, m FROM i UNION SELECT r.process, s.b, r.x FROM r JOIN s ON s.a = r.m AND s.process = r.process), c AS (SELECT process, m, min(x) AS least FROM r GROUP BY process, m)
SELECT process, m AS message, CAST(dense_rank() OVER (PARTITION BY process ORDER BY least) - 1 AS INTEGER) AS cluster_id FROM c""")
_add("assignment_lines", _parts(lambda d: sinks.assignment_lines(clustering.cluster_flat(d.select(F.col("p_name").alias("message")), cutoff=0.3))),
     f"WITH RECURSIVE {_EDGES}, r(m, x) AS (SELECT DISTINCT p_name, p_name FROM part UNION SELECT s.b, r.x FROM r JOIN s ON s.a = r.m), c AS (SELECT m, min(x) AS least FROM r GROUP BY m) SELECT CAST(dense_rank() OVER (ORDER BY least) - 1 AS VARCHAR) || ' -> ' || m AS value FROM c")
_add("components", lambda spark, sf_dir: connected_components(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.col("l_suppkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst"))),
     "WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey * 2 AS a, l_partkey * 2 + 1 AS b FROM lineitem), s AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), m AS (SELECT a AS node, min(least(a, b)) AS x FROM s GROUP BY a), r(node, x, k) AS (SELECT node, x, 0 FROM m UNION ALL SELECT s.a, min(r.x), r.k + 1 FROM r JOIN s ON s.b = r.node WHERE r.k < 12 GROUP BY s.a, r.k) SELECT node, min(x) AS component FROM r GROUP BY node")
_add("nearest", lambda spark, sf_dir: clustering.nearest(spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_name").alias("q")), "q", spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_name").alias("r")), "r", F.levenshtein),
     "SELECT q, r, CAST(d AS DOUBLE) AS distance FROM (SELECT n_name AS q, r_name AS r, levenshtein(n_name, r_name) AS d, row_number() OVER (PARTITION BY n_name ORDER BY levenshtein(n_name, r_name), r_name) AS k FROM nation, region) WHERE k = 1")
_add("nearest_cluster", lambda spark, sf_dir: clustering.nearest_cluster(spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_name").alias("q")), "q", spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_regionkey", "n_name"), "n_name", "n_regionkey", F.levenshtein),
     "SELECT q, n_regionkey, CAST(d AS DOUBLE) AS distance FROM (SELECT r_name AS q, n_regionkey, min(levenshtein(r_name, n_name)) AS d, row_number() OVER (PARTITION BY r_name ORDER BY min(levenshtein(r_name, n_name)), n_regionkey) AS k FROM region, nation GROUP BY r_name, n_regionkey) WHERE k = 1")
_add("distance_cutoffs", lambda spark, sf_dir: clustering.distance_cutoffs(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderpriority", F.floor("o_totalprice").cast("double").alias("v")), ["o_orderpriority"], "v"),
     """WITH RECURSIVE v AS (SELECT o_orderpriority AS g, floor(o_totalprice) AS v FROM orders), o AS (SELECT g, v, row_number() OVER (PARTITION BY g ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM v), m AS (SELECT g, v AS mid FROM o WHERE i = n // 2),
b AS (SELECT g, CASE WHEN bool_or(v.v < mid) THEN max(CASE WHEN v.v < mid THEN v.v END) ELSE any_value(mid) END AS hi FROM v JOIN m USING (g) GROUP BY g),
r(g, hi, k) AS (SELECT g, hi, 0 FROM b UNION ALL SELECT g, (SELECT max(v.v) FROM v WHERE v.g = r.g AND v.v <= ((SELECT avg(v.v) FROM v WHERE v.g = r.g AND v.v <= r.hi) + (SELECT avg(v.v) FROM v WHERE v.g = r.g AND v.v > r.hi)) / 2), k + 1 FROM r WHERE k < 40)
SELECT g AS o_orderpriority, hi AS cutoff FROM r WHERE k = 40""")
_add("reachable", lambda spark, sf_dir: clustering.reachable(spark.read.parquet(f"{sf_dir}/region.parquet").agg(F.concat(F.lit("r"), F.min("r_regionkey")).alias("node")), spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.lit("r"), "n_regionkey").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("dst"))),
     "SELECT 'r' || min(r_regionkey) AS node FROM region UNION ALL SELECT 'n' || n_nationkey FROM nation WHERE n_regionkey = (SELECT min(r_regionkey) FROM region)")

# template mining
_kind = "CASE event_type WHEN 'error' THEN 'Failed request $v from $v after $v' WHEN 'view' THEN 'Directory <*> was viewed [$v]' WHEN 'click' THEN 'Login of user <*>, status: <*>' WHEN 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 'User <*> logged on successfully' ELSE 'User <*> saved state successfully' END ELSE 'order id=$v amount=<*> size=$v' END"
_lines = lambda d: d.select(F.col("msg").alias("value"))
_add("mine_templates", _over(lambda d: pipelines.mine_log(_lines(d)).select("template")), f"SELECT DISTINCT {_kind} AS template FROM events")
_add("mine_templates_unsplit", _over(lambda d: pipelines.mine_log(_lines(d), split=False).select("template")), f"SELECT DISTINCT CASE event_type WHEN 'signup' THEN 'User <*> <*> <*> successfully' ELSE {_kind} END AS template FROM events")
_add("template_frequencies", _over(lambda d: pipelines.template_frequencies(_lines(d))), f"SELECT {_kind} AS template, count(*) AS n FROM events GROUP BY 1")
#: The values at each wildcard; of a position that alone has more than 500, those of the first 501 lines.
_VALUES = """p AS (SELECT 'Directory <*> was viewed [$v]' AS t, 1 AS pos, '/srv/u' || user_id || '/d' || event_id % 97 AS v FROM events WHERE event_type = 'view'
 UNION SELECT 'Login of user <*>, status: <*>', 3, 'u' || user_id FROM events WHERE event_type = 'click'
 UNION SELECT 'Login of user <*>, status: <*>', 5, CASE WHEN value >= 50 THEN 'successful' ELSE 'failed' END FROM events WHERE event_type = 'click'
 UNION SELECT CASE WHEN event_id % 2 = 0 THEN 'User <*> logged on successfully' ELSE 'User <*> saved state successfully' END, 1, 'u' || user_id FROM events WHERE event_type = 'signup'
 UNION SELECT 'order id=$v amount=<*> size=$v', 4, split_part(cast(cast(value as decimal(10,2)) as varchar), '.', 1) || '.$v' FROM events WHERE event_type NOT IN ('error', 'view', 'click', 'signup')),
q AS (SELECT *, row_number() OVER (PARTITION BY t, pos ORDER BY v) AS r, count(*) OVER (PARTITION BY t, pos) AS n FROM p)"""
_add(
    "template_params",
    _over(lambda d: pipelines.mine_log(_lines(d)).select("template", F.explode("params").alias("pos", "vals")).select("template", "pos", F.array_join("vals", "\u0001").alias("vals"))),
    f"WITH {_VALUES} SELECT t AS template, CAST(pos AS INTEGER) AS pos, string_agg(v, chr(1) ORDER BY v) AS vals FROM q WHERE r <= 501 GROUP BY t, pos",
)
_add("template_lines", _over(lambda d: sinks.template_lines(pipelines.mine_log(_lines(d)), "T: ")), f"SELECT DISTINCT 'T: ' || {_kind} AS value FROM events")
_add(
    "template_param_lines",
    _over(lambda d: sinks.template_param_lines(pipelines.mine_log(_lines(d)))),
    f"""WITH {_VALUES}, a AS (SELECT t, pos, chr(10) || '  Params at pos ' || pos || ': ' || string_agg(v, ' ' ORDER BY v) AS x, max(n) AS n FROM q WHERE r <= 501 GROUP BY t, pos)
SELECT CASE WHEN t LIKE 'User %' THEN 'Split: ' ELSE '' END || t || string_agg(x, '' ORDER BY pos) || CASE WHEN max(n) > 500 THEN chr(10) || '  Positions with max num of tokens exceeded: ' || string_agg(CASE WHEN n > 500 THEN pos END, ' ' ORDER BY pos) ELSE '' END AS value FROM a GROUP BY t
UNION ALL SELECT DISTINCT 'Failed request $v from $v after $v' FROM events WHERE event_type = 'error'""",
)
_add("mine_documents", _docs(lambda d: templates.TemplateMiner(0.5, False, True).mine(d.select(F.explode(F.split("text", "\n")).alias("value")).distinct()).select("n_tokens", "kind", "token", "template", "lines")))

# hashes and shared calls
_add("hash_properties", _over(lambda d: d.select("event_id", (hashing.symmetric_hash("msg", "rich") == hashing.symmetric_hash("rich", "msg")).cast("int").alias("symmetric"), (hashing.multi_hash("msg", "rich") == hashing.multi_hash("rich", "msg")).cast("int").alias("ordered"), (hashing.symmetric_multi_hash("msg", "rich", "value") == hashing.symmetric_multi_hash("value", "msg", "rich")).cast("int").alias("symmetric3"))), "SELECT event_id, 1 AS symmetric, 0 AS ordered, 1 AS symmetric3 FROM events")
_add("call_once", _over(lambda d: hashing.call_once(d.select("event_id", (F.col("user_id") % 10).alias("a"), (F.col("event_id") % 7).alias("b")), ["a", "b"], lambda a, b: a + b, "total", symmetric=True)), "SELECT event_id, user_id % 10 AS a, event_id % 7 AS b, user_id % 10 + event_id % 7 AS total FROM events")
