"""Parsing of log lines by a format string such as "${DATE} ${ORIGIN} ${MESSAGE}"."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweave.functions import kernels

#: The position is the number; number 5 of the usual numbering is missing here, so later ones are lower by one.
FACILITIES = ("kern", "user", "mail", "daemon", "auth", "lpr", "news", "uucp", "clock", "authpriv", "ftp", "ntp", "audit", "alert", "cron", *(f"local{i}" for i in range(8)))
SEVERITIES = ("emerg", "alert", "crit", "err", "warning", "notice", "info", "debug")
_TRADITIONAL = r"[A-Za-z]{3,9}\s+\d{1,2}\s+\d{1,2}:\d{1,2}:\d{1,2}"
_ISO = r"\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}(?:\.\d+)?(?:\+\d{1,2}:\d{1,2}|-\d{2}:\d{2}|Z)?"
_PIECES = {"ORIGIN": r"(\S+)", "FACILITY": r"(\S+)", "FACILITY_NUM": r"(-?\d+)", "SEVERITY": r"(\S+)", "SEVERITY_NUM": r"(-?\d+)", "ISODATE": f"({_ISO})", "DATE": f"({_TRADITIONAL})", "MESSAGE": r"(.*)"}
_MESSAGE = r"(?s)^(?=[^:])([^:]*?)(?:\[(-?\d+)?\])?:.(.*)$"


class FormatError(ValueError):
    """A format string that can't be compiled."""


@dataclass(frozen=True)
class Format:
    """The macros in order, and one anchored pattern with a group for each but IGNORE."""

    macros: tuple[str, ...]
    pattern: str


def compile_format(text: str, compat: str = "intent") -> Format:
    """White space in the format means nothing; other characters stand for themselves after any white space.

    IGNORE skips one token, or, with compat="reference", white space only.
    """
    macros, pattern, i = [], "(?s)^", 0
    while i < len(text):
        if text[i].isspace():
            i += 1
        elif text.startswith("${", i):
            end = text.find("}", i)
            if end < 0:
                raise FormatError("a macro isn't ended")
            name = text[i + 2 : end]
            if macros and macros[-1] == "MESSAGE":
                raise FormatError("MESSAGE must be the last element")
            if name == "IGNORE":
                pattern += r"\s*" if compat == "reference" else r"\s*\S+"
            elif name in _PIECES:
                pattern += r"\s*" + _PIECES[name]
            else:
                raise FormatError(f"unknown macro {name}")
            macros.append(name)
            i = end + 1
        else:
            if macros and macros[-1] == "MESSAGE":
                raise FormatError("MESSAGE must be the last element")
            pattern += r"\s*" + re.escape(text[i])
            i += 1
    return Format(tuple(macros), pattern if "MESSAGE" in macros else pattern + ".*$")


@F.pandas_udf(T.StructType([T.StructField("kind", T.StringType()), T.StructField("addr", T.StringType())]))
def log_host(text: pd.Series) -> pd.DataFrame:
    """(kind, canonical text) of a host: ipv6, ipv4 or name."""
    return pd.DataFrame([kernels.host(t) or (None, None) for t in text], columns=["kind", "addr"])


def host_kind(text: Column) -> Column:
    """The kind alone, natively, for dotted quads and names; what has two colons is taken for IPv6."""
    octet = r"(?:(?:2[0-4]|1\d|[1-9])?\d|25[0-5])"
    return F.when(text.rlike(rf"^(?:{octet}\.){{3}}{octet}$"), "ipv4").when(text.rlike(r"^[0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*$"), "ipv6").otherwise("name")


def traditional_time(text: Column, year: int) -> Column:
    """`Mon d H:M:S`; the year, which the text lacks, is a parameter."""
    one = F.regexp_replace(F.trim(text), r"\s+", " ")
    short = F.regexp_replace(one, r"^([A-Za-z]{3})[A-Za-z]*", "$1")
    return F.try_to_timestamp(F.concat(F.lit(f"{year} "), short), F.lit("yyyy MMM d H:m:s"))


def iso_time(text: Column, compat: str = "intent") -> Column:
    """The instant; with compat="reference" `+hh:mm` is added, `-hh:mm` ignored, and fraction digits are nanoseconds."""
    if compat != "reference":
        return F.try_to_timestamp(text)
    local = F.try_to_timestamp(F.regexp_extract(text, r"^(\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2})", 1), F.lit("yyyy-M-d'T'H:m:s"))
    micros = F.coalesce(F.regexp_extract(text, r"\.(\d+)", 1).try_cast("long"), F.lit(0)) / 1000
    minutes = F.coalesce(F.regexp_extract(text, r"\+(\d{1,2}):", 1).try_cast("long") * 60 + F.regexp_extract(text, r"\+\d{1,2}:(\d{1,2})", 1).try_cast("long"), F.lit(0))
    return F.timestamp_micros((F.unix_micros(local) + F.floor(micros) + minutes * 60_000_000).cast("long"))


_STRFTIME = {"Y": "yyyy", "m": "MM", "d": "dd", "e": "d", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "b": "MMM", "B": "MMMM", "h": "MMM", "y": "yy", "j": "DDD", "p": "a", "a": "EEE", "A": "EEEE", "t": " ", "n": " ", "%": "%", "T": "HH:mm:ss", "F": "yyyy-MM-dd", "D": "MM/dd/yy", "R": "HH:mm"}


def custom_time(text: Column, fmt: str) -> Column:
    """A time in a strftime format."""
    out, i = "", 0
    while i < len(fmt):
        if fmt[i] == "%":
            if i + 1 == len(fmt) or fmt[i + 1] not in _STRFTIME:
                raise FormatError(f"no such conversion in {fmt!r}")
            out += _STRFTIME[fmt[i + 1]]
            i += 2
        else:
            out += f"'{fmt[i]}'" if fmt[i].isalpha() else fmt[i]
            i += 1
    return F.try_to_timestamp(text, F.lit(out))


def split_message(text: Column) -> dict[str, Column]:
    """process, pid and message of `process[pid]: message`, and error.

    The first colon parts them, and the character behind it is dropped. Empty brackets are pid 0, as are digits that
    overflow. Of several brackets the last ones count. No colon, nothing before it, nothing behind it, or brackets that
    hold anything else: an error.
    """
    process, digits, message = (F.regexp_extract(text, _MESSAGE, k) for k in (1, 2, 3))
    bad = text.isNull() | ~text.rlike(_MESSAGE) | (process.endswith("]") & ~text.rlike(r"^[^:]*\[(?:-?\d+)?\]:"))
    pid = F.when(digits != "", F.coalesce(digits.try_cast("int"), F.lit(0))).when(text.rlike(r"^[^:]*\[\]:"), F.lit(0))
    keep = lambda c: F.when(~bad, c)
    return {"process": keep(process), "pid": keep(pid), "message": keep(message), "error": bad}


def full_message(process: Column, pid: Column, message: Column) -> Column:
    return F.concat(process, F.coalesce(F.concat(F.lit("["), pid.cast("string"), F.lit("]")), F.lit("")), F.lit(": "), message)


def tagged_message(process: Column, message: Column) -> Column:
    return F.concat(process, F.lit(": "), message)


def _number(names: tuple[str, ...], text: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for k, n in enumerate(names) for x in (n, k)]), text)


def facility_name(number: Column) -> Column:
    return F.get(F.array(*map(F.lit, FACILITIES)), number)


def severity_name(number: Column) -> Column:
    return F.get(F.array(*map(F.lit, SEVERITIES)), number)


def parse_lines(lines: DataFrame, fmt: str, column: str = "value", year: int = 1970, compat: str = "intent", hosts: bool = True, mode: str = "PERMISSIVE") -> DataFrame:
    """lines with the fields that the format names: ts, facility, severity, origin, process, pid, message, and _error.

    Blank lines are left out. A line that doesn't match, an unknown facility, or a message that can't be parted has
    _error set; with mode="FAILFAST" it fails the query. An unknown severity stays unset.
    """
    spec = compile_format(fmt, compat)
    text = F.col(column)
    rows = lines.where(text.rlike(r"\S"))
    named = [m for m in spec.macros if m != "IGNORE"]
    value = {m: F.regexp_extract(text, spec.pattern, k + 1) for k, m in enumerate(named)}
    out: dict[str, Column] = {}
    error = ~text.rlike(spec.pattern)
    if "DATE" in value:
        out["ts"] = traditional_time(value["DATE"], year)
    if "ISODATE" in value:
        out["ts"] = iso_time(value["ISODATE"], compat)
    if "ts" in out:
        error = error | out["ts"].isNull()
    if "FACILITY" in value:
        out["facility"] = _number(FACILITIES, value["FACILITY"]) if compat != "reference" else F.when(value["FACILITY"] == "X", F.lit(0))
        error = error | out["facility"].isNull()
    if "FACILITY_NUM" in value:
        out["facility"] = value["FACILITY_NUM"].try_cast("int")
    if "SEVERITY" in value:
        out["severity"] = _number(SEVERITIES, value["SEVERITY"]) if compat != "reference" else F.when(value["SEVERITY"] == "X", F.lit(0))
    if "SEVERITY_NUM" in value:
        out["severity"] = value["SEVERITY_NUM"].try_cast("int")
    if "ORIGIN" in value:
        out["origin"] = log_host(value["ORIGIN"]) if hosts else value["ORIGIN"]
    if "MESSAGE" in value:
        parts = split_message(value["MESSAGE"])
        error = error | parts.pop("error")
        out |= parts
    if mode == "FAILFAST":
        return rows.withColumns(out | {"_error": F.when(error, F.raise_error(F.concat(F.lit("can't parse: "), text))).otherwise(F.lit(False))})
    return rows.withColumns(out | {"_error": error})
