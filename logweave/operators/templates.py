"""Log template mining: a fold over the lines of each bucket, and a split of templates that were merged too far.

Lines meet only lines of their own bucket: the number of tokens, and the first token, or else the last, that can't be a
parameter. So the lines are partitioned by bucket and sorted within, and each task folds them as they stream by: it holds
the templates of one bucket, never its lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.functions.tokens import SPECIAL, count_tokens, is_param, is_possible_param, special_words
from logweave.operators.graph import _written

WILD = "<*>"
_TOKEN = re.compile(f"[^{SPECIAL}]+", re.ASCII)
#: Rows that a template's parameter table holds before its widest positions are given up.
TABLE_ROWS = 500
#: Templates of a bucket from which they are looked up in an index.
INDEXED = 16


def tokenize(line: str) -> tuple[list[str], list[str]]:
    """Tokens, and the separators before, between and behind them."""
    tokens, seps, at = [], [], 0
    for m in _TOKEN.finditer(line):
        seps.append(line[at : m.start()])
        tokens.append(m.group())
        at = m.end()
    return tokens, [*seps, line[at:]]


def bucket_of(tokens: list[str]) -> tuple[int, str, str]:
    """(token count, first or last, token) or the common bucket `*`."""
    if tokens and not is_param(tokens[0]):
        return len(tokens), "first", tokens[0]
    if tokens and not is_param(tokens[-1]):
        return len(tokens), "last", tokens[-1]
    return len(tokens), "first", "*"


Row = tuple[tuple[int, str], ...]


@dataclass
class Template:
    tokens: list[str]
    seps: list[str]
    params: dict[int, set[str]] = field(default_factory=dict)
    table: set[Row] = field(default_factory=set)
    exceeded: set[int] = field(default_factory=set)
    split: bool = False
    lines: int = 1

    @property
    def text(self) -> str:
        return self.seps[0] + "".join(t + s for t, s in zip(self.tokens, self.seps[1:]))

    def similarity(self, tokens: list[str], seps: list[str], threshold: float) -> float:
        """Share of equal tokens above the threshold; 0 where separators or keys of `key=` contradict."""
        equal, last = 0, len(tokens) - 1
        for i, (mine, other) in enumerate(zip(self.tokens, tokens)):
            if mine == other and other != "&v":
                equal += 1
            elif self.seps[i] != seps[i] or (self.seps[i + 1] == seps[i + 1] == "=" and not is_param(mine) and not is_param(other)):
                return 0.0
        return equal / len(tokens) - threshold if last >= 0 else 0.0

    def merge(self, tokens: list[str], seps: list[str], keep_params: bool) -> None:
        """Differing positions become wildcards, and the separators are the line's."""
        before, now = {}, {}
        for i, other in enumerate(tokens):
            mine = self.tokens[i]
            if mine != other and mine != WILD:
                if i not in self.exceeded:
                    before[i], now[i] = mine, other
                    if keep_params:
                        self.params.setdefault(i, set()).update((mine, other))
                self.tokens[i] = WILD
            elif mine == WILD and i not in self.exceeded:
                now[i] = other
                if keep_params:
                    self.params.setdefault(i, set()).add(other)
        self.seps = seps
        self.lines += 1
        if before:
            self.table = {_row({**before, **dict(r)}) for r in self.table} or {_row(before)}
        self.table.add(_row(now))
        if len(self.table) > TABLE_ROWS:
            self._reduce()

    def _reduce(self) -> None:
        values: dict[int, set[str]] = {}
        for row in self.table:
            for pos, token in row:
                values.setdefault(pos, set()).add(token)
        counts = sorted({len(v) for v in values.values()})
        while len(self.table) > TABLE_ROWS and counts:
            most = counts.pop()
            gone = {p for p, v in values.items() if len(v) == most}
            self.table = {tuple(x for x in row if x[0] not in gone) for row in self.table}
            self.exceeded |= gone

    def divide(self, keep_params: bool) -> list[Template]:
        """The templates that this one is split into where positions determine one another, or none."""
        rows = [dict(r) for r in sorted(self.table)]
        positions = sorted(rows[0]) if rows else []
        columns = {p: [r.get(p, "") for r in rows] for p in positions}
        words: dict[int, list[int]] = {}
        marks: dict[int, list[int]] = {}
        for p in positions:
            kind = marks if all(is_param(v) for v in columns[p]) else words
            kind.setdefault(len(set(columns[p])), []).append(p)

        def follows(p: int, q: int) -> bool:
            seen: dict[str, str] = {}
            return all(seen.setdefault(a, b) == b for a, b in zip(columns[p], columns[q]))

        tied, alike = set(), set()
        for group in words.values():
            if 2 <= len(group) <= len(self.tokens) - 2:
                for k, p in enumerate(group):
                    for q in group[k + 1 :]:
                        if columns[p] == columns[q]:
                            alike |= {p, q}
                        elif follows(p, q):
                            tied |= {p, q}
        tied -= alike
        tied |= {q for n, group in words.items() for p in group if p in tied for q in marks.get(n, []) if follows(p, q)}
        made: dict[str, Template] = {}
        for r in rows if tied else []:
            tokens = [r.get(i, "") if i in tied else t for i, t in enumerate(self.tokens)]
            new = Template(tokens, self.seps, lines=0)
            new = made.setdefault(new.text, new)
            if keep_params:
                for i, t in enumerate(self.tokens):
                    if i not in tied and t == WILD:
                        new.params.setdefault(i, set()).add("*" if i in self.exceeded else r.get(i, ""))
        self.split = bool(made)
        return [made[t] for t in sorted(made)]


@lru_cache(maxsize=1024)
def _needed(n: int, threshold: float) -> int:
    """The least number of n tokens whose share is greater than the threshold; n + 1 where all aren't enough."""
    return next((k for k in range(n + 1) if k / n - threshold > 0), n + 1) if n else 0


class Bucket:
    """The templates of one bucket, in the order in which they came up.

    From INDEXED templates on, those that a line is held against come out of an index by place and token. A line that joins
    a template shares `need` of its n tokens at least, so one at least of any n - need + 1: those whose lists are shortest.
    """

    def __init__(self, threshold: float, keep_params: bool):
        self.threshold, self.keep_params, self.nodes = threshold, keep_params, []
        self.index: dict[tuple[int, str], list[int]] = {}

    def add(self, line: str) -> int:
        """The number of the template that the line went to."""
        tokens, seps = tokenize(line)
        best, number = 0.0, -1
        for k in self._within_reach(tokens):
            if (s := self.nodes[k].similarity(tokens, seps, self.threshold)) > best:
                best, number = s, k
        if number < 0:
            self.nodes.append(Template(tokens, seps))
            number = len(self.nodes) - 1
            if self.index:
                self._note(number, range(len(tokens)))
            return number
        node = self.nodes[number]
        fixed = [i for i, t in enumerate(node.tokens) if t != tokens[i] and t != WILD] if self.index else []
        node.merge(tokens, seps, self.keep_params)
        self._note(number, fixed)
        return number

    def _note(self, number: int, places: Iterable[int]) -> None:
        """What a template has had at a place stays in the index: it is held against the line in any case."""
        for i in places:
            self.index.setdefault((i, self.nodes[number].tokens[i]), []).append(number)

    def _within_reach(self, tokens: list[str]) -> Iterable[int]:
        """The numbers of all templates that the line may join, ascending."""
        n = len(tokens)
        if len(self.nodes) < INDEXED or (need := _needed(n, self.threshold)) == 0:
            return range(len(self.nodes))
        if not self.index:
            for k in range(len(self.nodes)):
                self._note(k, range(len(self.nodes[k].tokens)))
        lists = sorted((self.index.get((i, t), ()) for i, t in enumerate(tokens)), key=len)
        return sorted(set().union(*lists[: max(0, n - need + 1)]))

    def __getstate__(self) -> dict:
        """Without the index, which is made again where it is needed: a stream keeps buckets as its state."""
        return self.__dict__ | {"index": {}}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update({"index": {}} | state)

    def result(self, split: bool) -> list[tuple[Template, bool]]:
        """(template, came of a split): unsplit ones first."""
        new = [t for node in self.nodes for t in node.divide(self.keep_params)] if split else []
        return [(n, False) for n in self.nodes if not n.split] + [(t, True) for t in new]


@dataclass(frozen=True)
class TemplateMiner:
    """threshold: a line joins a template if its share of equal tokens is greater. Lines are taken in byte order, or in the order of `arrival`."""

    threshold: float = 0.5
    store_params: bool = False
    split: bool = True

    SCHEMA = "n_tokens int, kind string, token string, template string, split boolean, lines long, params map<int,array<string>>, exceeded array<int>"

    def mine(self, lines: DataFrame, column: str = "value", arrival: str | None = None, partitions: int | None = None) -> DataFrame:
        """One row per template. Empty and null lines are left out."""
        text = F.col(column)
        rows = lines.where(text.isNotNull() & (text != ""))
        rows = rows.select(text.alias("line"), *bucket_columns(text), *([F.col(arrival).alias("at")] if arrival else []))
        keys = ["n_tokens", "kind", "token"]
        dealt = rows.repartition(partitions, *keys) if partitions else rows.repartition(*keys)
        ordered = dealt.sortWithinPartitions(*keys, "at" if arrival else "line").select(*keys, "line")
        miner = self

        def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, bucket = None, None
            for b in batches:
                out: list[tuple] = []
                for n, kind, token, line in zip(*(b.column(c).to_pylist() for c in (*keys, "line"))):
                    if (n, kind, token) != key:
                        out += miner._rows(key, bucket)
                        key, bucket = (n, kind, token), Bucket(miner.threshold, miner.store_params)
                    bucket.add(line)
                yield _batch(out)
            yield _batch(miner._rows(key, bucket))

        return ordered.mapInArrow(fold, self.SCHEMA)

    def _rows(self, key: tuple | None, bucket: Bucket | None) -> list[tuple]:
        return [] if bucket is None else [(*key, t.text, new, t.lines, sorted((p, sorted(v)) for p, v in t.params.items()), sorted(t.exceeded)) for t, new in bucket.result(self.split)]


_TYPES = (("n_tokens", pa.int32()), ("kind", pa.string()), ("token", pa.string()), ("template", pa.string()), ("split", pa.bool_()), ("lines", pa.int64()), ("params", pa.map_(pa.int32(), pa.list_(pa.string()))), ("exceeded", pa.list_(pa.int32())))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(_TYPES)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(columns, _TYPES)], names=[n for n, _ in _TYPES])


def _row(values: dict[int, str]) -> Row:
    return tuple(sorted(values.items()))


def bucket_columns(text: Column) -> list[Column]:
    """n_tokens, kind and token of a line's bucket."""
    tokens = special_words(text)
    first, last = F.get(tokens, F.lit(0)), F.try_element_at(tokens, F.lit(-1))
    by_first, by_last = ~is_possible_param(first), ~is_possible_param(last)
    kind = F.when(by_first, "first").when(by_last, "last").otherwise("first")
    return [count_tokens(text).alias("n_tokens"), kind.alias("kind"), F.when(by_first, first).when(by_last, last).otherwise("*").alias("token")]


def show_tree(templates: DataFrame) -> DataFrame:
    """Templates in the order of the tree: by length, then by first and last tokens."""
    return templates.orderBy("n_tokens", "kind", "token", "template")


#: Templates that are broadcast to the lines; more are shuffled.
BROADCAST_TEMPLATES = 100_000


def _best(rows: DataFrame, templates: DataFrame) -> DataFrame:
    """(row, template, params) for each of the rows (row), distinct lines, that a template of its bucket fits."""
    each = rows.select("row", *bucket_columns(F.col("row")), special_words(F.col("row")).alias("words"))
    known = templates.select("n_tokens", "kind", "token", "template", F.expr(f"regexp_extract_all(template, '[^\\\\s=;,\\\\x27\"()\\\\[\\\\]{{}}]+', 0)").alias("parts"))
    # a bucket may hold most of the lines: they stay where they are if the templates are few
    known = _written(known, "templates")
    known = F.broadcast(known) if known.count() <= BROADCAST_TEMPLATES else known
    pairs = F.arrays_zip(F.col("words").alias("w"), F.col("parts").alias("p"))
    fits = F.forall(pairs, lambda x: (x["p"] == WILD) | (x["p"] == x["w"]))
    wild = F.filter(pairs, lambda x: x["p"] == WILD)
    met = each.join(known, ["n_tokens", "kind", "token"]).where(fits).select("row", F.struct(F.size(wild).alias("n"), "template", F.transform(wild, lambda x: x["w"]).alias("params")).alias("m"))
    return met.groupBy("row").agg(F.min("m").alias("m")).select("row", "m.template", "m.params")


def matches(lines: DataFrame, templates: DataFrame, column: str = "value") -> DataFrame:
    """Every line with the template of its bucket that fits it best (fewest wildcards, then first in byte order), its parameters, and null where none does.

    A template's token fits if it is the wildcard or equal. The join is on the bucket, so only templates of a line's own
    bucket are looked at.
    """
    # a line is its own name: lines that are equal fit alike
    every = lines.select(F.col(column).alias("line"))
    best = _best(every.where("line is not null").distinct().withColumnRenamed("line", "row"), templates)
    return every.join(best, F.col("line") == F.col("row"), "left").select("line", "template", "params")


def frequencies(counted: DataFrame, templates: DataFrame, column: str = "value", count: str = "n") -> DataFrame:
    """(template, n): how many lines each template fits best, as matches() has it; null: those that none fits.

    counted has distinct lines and how often each occurs, so that a line is looked at once.
    """
    best = _best(counted.where(F.col(column).isNotNull()).select(F.col(column).alias("row")), templates)
    found = counted.join(best, F.col(column) == F.col("row"), "left")
    return found.groupBy("template").agg(F.sum(count).alias("n"))
