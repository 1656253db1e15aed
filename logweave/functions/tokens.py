"""Tokenizers and token predicates, all native expressions over a string column."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = " \\t"
SPECIAL = r"\s=;,'\"()\[\]{}"


def words(text: Column, separators: str = BLANK) -> Column:
    """Words between blanks (space and tab), or between the characters of another class."""
    return F.regexp_extract_all(text, F.lit(f"[^{separators}]+"), F.lit(0))


def special_words(text: Column) -> Column:
    """Words between white space and any of =;,'"()[]{}"""
    return words(text, SPECIAL)


def quoted_words(text: Column) -> Column:
    """As words(); one that begins with a quote runs to the next such quote, or to the end."""
    return F.regexp_extract_all(text, F.lit("\"[^\"]*\"?|'[^']*'?|[^ \\t]+"), F.lit(0))


def separators(text: Column, chars: str = SPECIAL) -> Column:
    """What lies before, between and behind the words: one entry more than there are words."""
    return F.split(text, f"[^{chars}]+", -1)


def previous_separators(text: Column, i: Column, chars: str = SPECIAL) -> Column:
    """Separators before word i (from 0)."""
    return F.get(separators(text, chars), i)


def next_separators(text: Column, i: Column, chars: str = SPECIAL) -> Column:
    """Separators behind word i (from 0); empty beyond the last word."""
    return F.coalesce(F.get(separators(text, chars), i + 1), F.lit(""))


def spans(text: Column, chars: str = BLANK) -> Column:
    """(begin, end) of every word in code points, end exclusive."""
    parts = F.arrays_zip(separators(text, chars).alias("s"), words(text, chars).alias("w"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,end:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["s"])
        end = begin + F.coalesce(F.length(x["w"]), F.lit(0))
        one = F.array(F.struct(begin.alias("begin"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["w"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], one)).alias("out"))

    return F.aggregate(parts, start, step)["out"]


def count_tokens(text: Column) -> Column:
    """Words by special separators."""
    return F.regexp_count(text, F.lit(f"[^{SPECIAL}]+"))


def is_possible_param(token: Column) -> Column:
    """Whether a token has any character but ASCII letters, digits and colons."""
    return token.rlike("[^a-zA-Z0-9:]")


_PARAM = re.compile("[^a-zA-Z0-9:]")


def is_param(token: str) -> bool:
    """The same for a Python string."""
    return _PARAM.search(token) is not None
