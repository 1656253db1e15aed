"""Line dedup by a segment-partition edit join. DataFrame functions only.

Lines equal to one another are one class. Of different lines, those that are near enough are linked: how many edits
(insert, delete or replace a code point) are allowed follows from the shorter one's length, by one rule. Lines are split
into one segment more than that, so whatever line is within reach holds one of them unchanged, close to its place.
Segments go into an index keyed by the class of the line's length, segment number and content; each line looks in the
classes within reach at the few substrings that could be the segment there; what meets is verified within the band: with
a bit-parallel automaton where few edits are allowed, and along the diagonals that edits can reach beyond.

Where many lines meet under a substring, they do so in blocks, and a pair is made only where lengths and the numbers of
common code points allow it. Under a substring that very many lines hold nothing meets: what lies around it takes part in
another round under that key, with segments of its own, and so on. Only texts of no more code points than edits are
allowed meet all others of their key, as any two of them are within reach.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logweave.llm.common import materialize
from logweave.operators.graph import connected_components

#: Lines indexed under a key above which it is refined, and lines of a block that others meet.
KEY_LINES, BLOCK_LINES = 4096, 64
#: Rows of a few numbers that a look-up may broadcast; beyond that it shuffles.
BROADCAST_KEYS = 500_000
#: Edits up to which the automaton verifies.
AUTOMATON = 2
#: A line that this share of all lines is equal to, and this many, is met in SALTS places.
HOT_SHARE, HOT_COPIES, SALTS = 0.001, 10_000, 64
_BEYOND_LATIN = r"[^\x00-\xFF]"
#: A line's place: document, then line number, as one number.
_LINES = 1 << 31


def occurrences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, mark, line_no, line) for every line with a non-blank character; mark stands for the text. Null texts have no lines."""
    # the mark is made before the lines are, so once for each text
    texts = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    lines = texts.select("id", "mark", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return lines.where(F.ltrim(F.col("line"), F.lit(" \t\n\x0b\x0c\r")) != "")


def _place(id_: Column, line_no: Column) -> Column:
    """Null ids come last."""
    return F.coalesce(id_.cast("decimal(20,0)"), F.lit(str(1 << 63)).cast("decimal(20,0)")) * F.lit(_LINES).cast("decimal(12,0)") + line_no


def _marks(line: Column) -> list[Column]:
    """128 bits that stand for the line where its text isn't needed."""
    return [F.xxhash64(line).alias("k1"), F.xxhash64(F.lit("line"), F.length(line), line).alias("k2")]


#: (length, edits), ascending: lines whose shorter one is as long at least may be as many edits apart. A tenth of short lines, and about 2 % of long ones.
STEPS = ((10, 1), (20, 2), (150, 3), (250, 5), (400, 8), (650, 13), (1000, 20))
Steps = tuple[tuple[int, int], ...]


def edits_of(n: int, steps: Steps = STEPS) -> int:
    """How many edits two lines may be apart whose shorter one has n code points."""
    return max([0, *[e for least, e in steps if n >= least]])


def _edits(n: Column, steps: Steps) -> Column:
    return F.greatest(F.lit(0), *[F.when(n >= least, e) for least, e in steps])


def length_classes(of: Callable[[int], int], first: int, top: int = 1 << 31) -> list[tuple[int, int, int]]:
    """(least, end, edits) from the length `first` on: in a class, edits are the same and lengths differ by about a half at most. `of` never falls."""
    out, least = [], first
    while least < top:
        edits = of(least)
        most = max(least + edits + 1, least * 3 // 2)
        end = most if of(most) == edits else next(n for n in range(least + 1, most + 1) if of(n) != edits)
        out.append((least, end, edits))
        least = end
    return out


def places(edits: int, size: int) -> list[tuple[int, bool, int, int, int]]:
    """(slot, left, offset, width, role) of the substrings of a line that stand for its edits + 1 segments of `size`.

    Half of the segments are counted from the line's start, the others from its end. Of two lines that are `edits` apart
    either the left half has at most as many as it has segments, less one, or the right half has. In that half, going
    inwards, let i be the first segment up to whose inner end there are at most i edits: it has none itself, and exactly
    i lie before it. So it is the same in both lines, and no more than i places away.

    A line is indexed (role 1) under some substrings of a segment and looks (role 2) at others, so that any two places up
    to i apart meet: `turns` of them, `step` apart, against `step` neighbours. offset is that of the substring's outer end.
    """
    out = []
    for left, count in ((True, edits // 2 + 1), (False, (edits + 1) // 2)):
        for i in range(count):
            ways = [(step, -(-(2 * i + 1) // step)) for step in range(1, 2 * i + 2)]
            step, turns = min((w for w in ways if 2 * (w[1] - 1) * w[0] <= size), key=lambda w: (w[0] + w[1], w[1] * w[0] - w[0]))
            last = (turns - 1) * step
            indexed, looked = {k * step for k in range(turns)}, {last - i + k for k in range(step)}
            out += [(2 * i + (not left), left, i * size + o, size - last, (o in indexed) + 2 * (o in looked)) for o in sorted(indexed | looked)]
    return out


def _class_table(spark: SparkSession, classes: list[tuple[int, int, int, int]]) -> DataFrame:
    """(of, octave, least, end, edits, final, places) for the classes (of, least, end, edits): a row for each power of two they reach.

    Classes of lines that are too short for segments have one empty substring: all their lines meet. Such are final.
    """
    rows = []
    for of, least, end, edits in classes:
        final = least <= edits
        at = [(0, True, 0, 0, 3)] if final else places(edits, least // (edits + 1))
        for octave in range(max(1, least.bit_length()), max(1, (end + edits - 1).bit_length()) + 1):
            rows.append({"of": of, "octave": octave, "least": least, "end": end, "edits": edits, "final": int(final), "places": [dict(zip(("slot", "left", "off", "width", "does"), p)) for p in at]})
    kind = "array<struct<of:int,octave:int,least:bigint,end:bigint,edits:int,final:int,places:array<struct<slot:int,left:boolean,off:int,width:int,does:int>>>>"
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), F.lit(kind))))


def _entries(items: DataFrame, table: DataFrame) -> DataFrame:
    """An entry for each place of the items (id, context, text, n, role, of) in the classes of the table.

    A line is indexed in its own class and looks in those whose lines it may be longer than by the edits at most. Only
    the columns that are asked for are made: a row has the text for the key, and needn't carry it on.
    """
    # one byte for each code point, where that is possible, so that each is found in one step
    single = F.when(F.octet_length("text") == F.col("n"), F.col("text").cast("binary")).when(~F.col("text").rlike(_BEYOND_LATIN), F.encode("text", "ISO-8859-1"))
    met = items.withColumns({"octave": F.length(F.bin(F.col("n"))), "single": single}).join(F.broadcast(table), ["of", "octave"]).where("n >= least and n < end + edits")
    carried = ["id", "context", "text", "single", "n", "least", "edits", "final"]
    each = met.select(*carried, F.when(F.col("n") < F.col("end"), F.col("role")).otherwise(F.col("role").bitwiseAND(2)).alias("role"), F.inline("places"))
    placed = each.select(*carried, "slot", "width", F.col("role").bitwiseAND(F.col("does")).alias("role"), F.when(F.col("left"), F.col("off")).otherwise(F.col("n") - F.col("off") - F.col("width")).alias("at"))
    placed = placed.where("role <> 0 and at >= 0 and at + width <= n")
    part = F.substring("text", F.col("at") + 1, F.col("width"))
    part = F.when(F.col("single").isNotNull(), F.expr("substring(single, at + 1, width)")).when(part.rlike(_BEYOND_LATIN), part.cast("binary")).otherwise(F.encode(part, "ISO-8859-1"))
    return placed.select(F.xxhash64("context", "least", "edits", "slot", part).alias("key"), "id", "text", "role", "final", "slot", "at", "width", "edits")


#: Common code points whose numbers, modulo 16, tell most lines that can't be near.
_COMMON = " etaoinshrdlucm."


def _sketch(text: Column) -> list[Column]:
    """Two numbers for a text. Of two texts' as many bits differ as the counts do, or fewer: a count is a code of eight bits that goes round."""
    codes = []
    for c in _COMMON:
        n = (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit("")))).bitwiseAND(15)
        codes.append(F.get(F.lit([(1 << k) - 1 if k <= 8 else 256 - (1 << (k - 8)) for k in range(16)]), n).cast("long"))
    return [reduce(Column.bitwiseOR, [F.shiftleft(c, 8 * k) for k, c in enumerate(codes[i::2])]).alias(f"s{i}") for i in range(2)]


def candidates(lines: DataFrame, steps: Steps = STEPS) -> DataFrame:
    """Distinct (a, b), a < b, of lines (id, line, n) that may be as near as the steps want; none that is is missing."""
    spark = lines.sparkSession
    table = _class_table(spark, [(0, *c) for c in length_classes(lambda n: edits_of(n, steps), steps[0][0])])
    items = lines.select("id", F.lit(0).cast("long").alias("context"), F.col("line").alias("text"), "n", F.lit(3).alias("role"), F.lit(0).alias("of"))
    found, refined = [], None
    while True:
        tagged = _entries(items, table).select("key", (F.col("id") * 8 + F.col("final") * 4 + F.col("role")).alias("tag"))
        w, id_ = W.partitionBy("key"), F.shiftright("tag", 3)
        seen = tagged.select("key", "tag", F.sum(F.col("tag").bitwiseAND(1)).over(w).alias("indexed"), F.min(id_).over(w).alias("lo"), F.max(id_).over(w).alias("hi"))
        met = materialize(seen.where("lo < hi and indexed > 0").select("key", "tag", "indexed"), "met")
        hot = (F.col("indexed") > KEY_LINES) & (F.col("tag").bitwiseAND(4) == 0)
        found.append(materialize(_pairs(met.where(~hot), lines, steps), "candidates"))
        hot_keys = materialize(met.where(hot).select("key").distinct(), "hot-keys")
        if hot_keys.isEmpty():
            return reduce(DataFrame.union, found).distinct()
        hot_ids = met.where(hot).select(id_.alias("id")).distinct()
        if refined is None:
            every = sorted({e for _, e in steps})
            refined = _class_table(spark, [(e, *c) for e in every for c in [(0, e + 1, e), *length_classes(lambda _, e=e: e, e + 1)]])
        items, table = materialize(_around(items.join(_few(hot_ids), "id", "left_semi"), table, hot_keys), "refined"), refined


def _pairs(met: DataFrame, lines: DataFrame, steps: Steps) -> DataFrame:
    """Distinct (a, b) of lines that meet under a key, one indexed and one looking, and whose lengths and sketches don't forbid it.

    Many lines under a key are parted in blocks, each of which all that look there meet: no task has a whole hot key.
    """
    entry = met.select("key", F.shiftright("tag", 3).alias("id"), F.col("tag").bitwiseAND(3).alias("role"), F.ceil(F.col("indexed") / BLOCK_LINES).cast("int").alias("blocks"))
    known = lines.join(_few(entry.select("id").distinct()), "id", "left_semi").select("id", "n", *_sketch(F.col("line")))
    entry = entry.join(_few(known), "id")
    x = entry.where("role & 1 = 1").select("key", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"), F.col("id").alias("x"), F.col("n").alias("nx"), F.col("s0").alias("x0"), F.col("s1").alias("x1"))
    y = entry.where("role & 2 = 2").select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("id").alias("y"), F.col("n").alias("ny"), F.col("s0").alias("y0"), F.col("s1").alias("y1"))
    edits = _edits(F.least("nx", "ny"), steps)
    # an edit changes two of the counts by one at most
    near = (F.col("x") != F.col("y")) & (F.abs(F.col("nx") - F.col("ny")) <= edits) & (F.expr("bit_count(x0 ^ y0) + bit_count(x1 ^ y1)") <= 2 * edits)
    return x.join(y, ["key", "block"]).where(near).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _few(keys: DataFrame) -> DataFrame:
    """keys, to be broadcast if they are few."""
    keys = materialize(keys, "keys")
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def _around(items: DataFrame, table: DataFrame, hot_keys: DataFrame) -> DataFrame:
    """Items again, of what lies around the substrings that hot keys stand for, under these keys.

    Lines that meet in another segment than the first have different texts before it, as there are edits. So a key whose
    lines all begin alike up to there leads to nothing that the first segment doesn't lead to.
    """
    each = _entries(items, table).join(_few(hot_keys), "key", "left_semi")
    each = each.select("key", "id", "role", "slot", "edits", F.expr("substring(text, 1, at)").alias("before"), F.expr("substring(text, at + width + 1)").alias("behind"))
    begin = F.xxhash64("before")
    useful = each.groupBy("key").agg(F.min(begin).alias("x"), F.max(begin).alias("y"), F.min("slot").alias("slot")).where("x <> y or slot = 0").select("key")
    kept = each.join(useful, "key", "left_semi").withColumn("text", F.concat("before", "behind"))
    one = kept.groupBy("id", F.col("key").alias("context"), "text", F.col("edits").alias("of")).agg(F.bit_or("role").alias("role"))
    return one.select("id", "context", "text", F.length("text").alias("n"), "role", "of")


def _bound(df: DataFrame) -> DataFrame:
    """df with its columns computed here once: a generator, through which the optimizer moves no expression."""
    return df.select(F.inline(F.array(F.struct(*[F.col(c) for c in df.columns]))))


def within(pairs: DataFrame, threshold: int, a: str = "line_a", b: str = "line_b") -> DataFrame:
    """The rows of pairs whose b is within `threshold` edits of a: banded, bit-parallel.

    State e of the automaton is a number whose bit k says that a's first j + k - threshold code points are within e edits
    of b's first j. A code point of b moves all diagonals of the band at once: match keeps the bits whose diagonal has it
    next; replace takes the state of one edit less as it is, insert takes it shifted down, delete takes the new one shifted
    up. Blocks that both begin with are skipped, and once the last state is empty the rest costs next to nothing.
    """
    block, width = 32, 2 * threshold + 1
    others = [c for c in pairs.columns if c not in (a, b)]
    close = F.abs(F.length(a) - F.length(b)) <= threshold
    # code points of fixed width, so that each is found in one step
    wide = _bound(pairs.where(close).select(*others, a, b, F.encode(a, "UTF-32").alias("_a"), F.encode(b, "UTF-32").alias("_b")))
    blocks = F.floor(F.least(F.octet_length("_a"), F.octet_length("_b")) / (4 * block)).cast("int")
    same = F.expr(f"aggregate(sequence(0, _blocks - 1), 0, (k, i) -> if(k = i and substring(_a, i * {4 * block} + 1, {4 * block}) = substring(_b, i * {4 * block} + 1, {4 * block}), k + 1, k))")
    trimmed = _bound(_bound(wide.withColumn("_blocks", blocks)).withColumn("_same", F.when(F.col("_blocks") > 0, same).otherwise(0)))
    start = f"_same * {4 * block} + 1"
    rest = _bound(trimmed.select(*others, a, b, F.expr(f"substring(_a, {start})").alias("_a"), F.expr(f"substring(_b, {start})").alias("_b")))
    hit = " | ".join(f"if(substring(_a, (j + {k - threshold - 1}) * 4 + 1, if(j + {k - threshold} > 0, 4, 0)) = substring(_b, j * 4 - 3, 4), {1 << k}, 0)" for k in range(width))
    states = [f"(r.r0 & h)"]
    for e in range(1, threshold + 1):
        less = f"r.r{e - 1}"
        states.append(f"((r.r{e} & h) | {less} | shiftright({less}, 1) | {states[-1]} | (shiftleft({states[-1]}, 1) & {(1 << width) - 1}))")
    named = ", ".join(f"'r{e}', {x}" for e, x in enumerate(states))
    begin = ", ".join(f"'r{e}', {((1 << (e + 1)) - 1) << threshold & ((1 << width) - 1)}" for e in range(threshold + 1))
    step = f"if(r.r{threshold} = 0, r, element_at(transform(array({hit}), h -> named_struct({named})), 1))"
    end = F.expr(f"aggregate(sequence(1, octet_length(_b) div 4), named_struct({begin}), (r, j) -> {step}).r{threshold}")
    last = F.when(F.octet_length("_b") > 0, end).otherwise(F.lit(((1 << (threshold + 1)) - 1) << threshold & ((1 << width) - 1)))
    reached = F.expr(f"shiftleft(1, cast((octet_length(_a) - octet_length(_b)) / 4 as int) + {threshold}) & _end") != 0
    return rest.withColumn("_end", last).where(reached).select(*others, a, b)


def within_many(pairs: DataFrame) -> DataFrame:
    """The rows of pairs (a, b, line_a, line_b, edits) whose lines are within their edits: by furthest steps on diagonals.

    After each edit it is known for each diagonal (b's place less a's) how far in a one can come: one step on from where
    the edit before came on it or on its neighbours, then as far as both lines go on alike, which is found by halving
    widths. So a pair costs edits * edits steps at most, and hardly more for longer lines. Diagonals that can't lead to
    both ends with the edits that are left are passed over. Places count from 1, in bytes; a code point takes _w of them.
    """
    latin = ~(F.col("line_a").rlike(_BEYOND_LATIN) | F.col("line_b").rlike(_BEYOND_LATIN))
    near = _bound(pairs.where(F.abs(F.length("line_a") - F.length("line_b")) <= F.col("edits")).withColumn("_w", F.when(latin, 1).otherwise(4)))
    code = lambda line: F.when(F.col("_w") == 1, F.encode(line, "ISO-8859-1")).otherwise(F.encode(line, "UTF-32"))
    wide = _bound(near.select("a", "b", "edits", "_w", code("line_a").alias("_a"), code("line_b").alias("_b")))
    longest = "greatest(octet_length(_a), octet_length(_b))"
    sized = _bound(wide.select("*", F.octet_length("_a").alias("_n"), F.expr("int((octet_length(_b) - octet_length(_a)) div _w)").alias("_gap"), F.expr(f"length(bin({longest} div _w))").alias("_bits")))
    # a level is an edit: its diagonals, what puts those of the level before in their places, and which of those ends both lines
    lo = lambda d: f"greatest(-({d}), _gap - edits + {d})"
    shift = f"if(d = 0, 1, 1 - {lo('d')} + {lo('(d - 1)')})"
    levels = f"transform(sequence(0, edits), d -> named_struct('ks', sequence({lo('d')} * _w, least(d, _gap + edits - d) * _w, _w), 'pad', slice(array(-9, -9), 1, {shift}), 'end', if(d = 0, 0, _gap - {lo('(d - 1)')})))"
    alike = "aggregate(if(substring(wa, i, 8 * _w) = substring(wb, i + k, 8 * _w), steps, short), i, (p, s) -> if(substring(wa, p, s) = substring(wb, p + k, s), p + s, p))"
    begin = "greatest(get(q, x), greatest(get(q, x + 1), get(q, x + 2)) + _w)"
    furthest = f"element_at(transform(array({begin}), i -> if(substring(wa, i, _w) = substring(wb, i + k, _w), {alike}, i)), 1)"
    level = f"element_at(transform(array(concat(v.pad, r)), q -> transform(v.ks, (k, x) -> coalesce({furthest}, -9))), 1)"
    end = f"aggregate({levels}, array(1 - _w), (r, v) -> if(coalesce(get(r, v.end) > _n, size(r) = 0), array(), {level}))"
    # a column of bytes is copied each time that it is read, a variable isn't
    for name, value in (("short", "array(4 * _w, 2 * _w, _w)"), ("steps", "transform(sequence(_bits - 1, 0, -1), p -> shiftleft(_w, p))"), ("wb", "_b"), ("wa", "_a")):
        end = f"element_at(transform(array({value}), {name} -> {end}), 1)"
    return _bound(sized.select("a", "b", "_n", F.expr(end).alias("_end"))).where("coalesce(get(_end, 0) > _n, size(_end) = 0)").select("a", "b")


#: Kinds that code points are counted by, by a hash whose seed tells the common ones apart: WORDS numbers hold LANES counts of six bits each.
KIND_SEED, WORDS, LANES = 819, 6, 6


def _grams(texts: DataFrame) -> DataFrame:
    """(id, n, g0 to g3, c0 to c5) of (id, line): for each of 256 numbers whether an odd number of the line's pairs of neighbours has it, and its code points by kind.

    The last code point's neighbour is the end. An edit changes four pairs at most, so texts within e edits differ in
    4 * e of the numbers at most. A count may run over into the next one: the sum tells of their differences all the same.
    """
    wide = texts.select("id", F.length("line").alias("n"), F.encode("line", "UTF-32").alias("wide"))
    each = wide.select("id", "n", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("n") - 1))).alias("at"), "wide")
    kind = F.pmod(F.hash(F.lit(KIND_SEED), F.expr("substring(wide, at * 4 + 1, 4)")), F.lit(WORDS * LANES))
    hashed = each.select("id", "n", F.xxhash64(F.expr("substring(wide, at * 4 + 1, 8)")).alias("h"), kind.alias("kind"))
    bit, one = F.expr("shiftleft(1L, int(h & 63))"), F.expr(f"shiftleft(1L, 6 * (kind % {LANES}))")
    pairs = [F.bit_xor(F.when(F.shiftright("h", 6).bitwiseAND(3) == k, bit).otherwise(F.lit(0).cast("long"))).alias(f"g{k}") for k in range(4)]
    counts = [F.sum(F.when(F.expr(f"kind div {LANES}") == k, one).otherwise(F.lit(0).cast("long"))).alias(f"c{k}") for k in range(WORDS)]
    return hashed.groupBy("id", "n").agg(*pairs, *counts)


def _alike(edits: Column) -> Column:
    """Whether the counts of a and b by kind allow texts that are `edits` apart.

    An edit takes one code point from a text at most, and adds one at most: neither has more than `edits` too many. Where
    all counts differ by less than 32 they are read off the difference of the sums; texts that are near do, up to 31 edits.
    """
    middle = sum(32 << (6 * k) for k in range(LANES))
    words = []
    for w in range(WORDS):
        gap = f"(ca{w} - cb{w} + {middle})"
        # 31 in each lane of 32 at least: what a has too many stays; numbers modulo 63 are the sums of their lanes, or less
        words.append(f"({gap} & (({gap} & {middle}) - shiftright({gap} & {middle}, 5))) % 63")
    return (edits > 31) | (F.expr(" + ".join(words)) <= F.least(edits, edits + F.col("na") - F.col("nb")))


def _links(lines: DataFrame, steps: Steps) -> DataFrame:
    """Distinct (a, b), a < b, of lines (id, line, n) within the edits that the shorter one's length allows."""
    pairs = materialize(candidates(lines, steps), "line-pairs")
    ends = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    texts = materialize(lines.select("id", "line").join(_few(ends), "id", "left_semi"), "line-texts")
    grams = _few(_grams(texts))
    side = lambda x: grams.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), *[F.col(f"g{k}").alias(f"g{x}{k}") for k in range(4)], *[F.col(f"c{k}").alias(f"c{x}{k}") for k in range(WORDS)])
    told = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("edits", _edits(F.least("na", "nb"), steps))
    told = told.where(F.expr(" + ".join(f"bit_count(ga{k} ^ gb{k})" for k in range(4))) <= 4 * F.col("edits")).where(_alike(F.col("edits"))).select("a", "b", "edits")
    text = lambda x: texts.select(F.col("id").alias(x), F.col("line").alias(f"line_{x}"))
    both = materialize(told.join(text("b"), "b").join(text("a"), "a"), "line-both")
    close = [within(both.where(F.col("edits") == e), e) for e in range(1, AUTOMATON + 1)]
    close.append(within_many(both.where(F.col("edits") > AUTOMATON)))
    return reduce(DataFrame.union, [c.select("a", "b") for c in close])


def line_classes(df: DataFrame, steps: Steps = STEPS, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(classes, hot): (k1, k2, copies, class_id, class_line, n_links) for each line of df that isn't alone, and (k1, k2) of those that very many are equal to.

    class_id and class_line are where the line's class occurs first; n_links counts the different lines that it is linked
    with. Lines that occur once and are linked with none are left out. There are 1 / HOT_SHARE hot ones at most.
    """
    seen = occurrences(df, id_col, text_col).select("line", _place(F.col("id"), F.col("line_no")).alias("place"))
    lines = seen.groupBy("line").agg(F.min("place").alias("place"), F.count("*").alias("copies")).withColumns({"id": F.monotonically_increasing_id(), "n": F.length("line")})
    lines = materialize(lines.select("id", "n", *_marks(F.col("line")), "place", "copies", "line"), "lines")
    links = materialize(_links(lines.select("id", "line", "n"), steps), "line-links")
    ends = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node")))
    known = connected_components(links, "a", "b").join(ends.groupBy("node").agg(F.count("*").alias("n_links")), "node")
    placed = materialize(lines.select(F.col("id").alias("node"), "place").join(_few(known), "node"), "linked")
    first = placed.groupBy("component").agg(F.min("place").alias("class_place"))
    linked = placed.join(first, "component").select(F.col("node").alias("id"), "class_place", "n_links")
    several = lines.select("id", "k1", "k2", "place", "copies").join(_few(linked), "id", "left").where("copies > 1 or n_links is not null")
    place = F.coalesce("class_place", "place")
    document = F.floor(place / F.lit(_LINES).cast("decimal(12,0)"))
    class_id = F.when(document < F.lit(str(1 << 63)).cast("decimal(20,0)"), document).cast("long")
    class_line = F.pmod(place, F.lit(_LINES).cast("decimal(12,0)")).cast("int")
    classes = materialize(several.select("k1", "k2", "copies", class_id.alias("class_id"), class_line.alias("class_line"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")), "line-classes")
    total = lines.agg(F.sum("copies")).first()[0] or 0
    return classes, classes.where(F.col("copies") > max(HOT_COPIES, HOT_SHARE * total)).select("k1", "k2")


def dedup_lines(df: DataFrame, steps: Steps = STEPS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per non-blank line of each row of df: id, line_no, copies, class_id, class_line, n_links, kept.

    class_id and class_line are the document and line where the line's class occurs first, in order of id (null last) and
    line; only that line is kept. copies counts equal lines, itself included; n_links the different lines that this one is
    linked with. Null, empty and blank texts give no rows. Rows that repeat an id and a text are one document, and each
    gets its rows. Columns besides the two named aren't read. An empty table gives no rows. Lines of any length take part
    whole; those for which no edit is allowed are equal to others or alone. Ids are whole numbers.
    """
    got = _decisions(df, steps, id_col, text_col)
    return got.select(F.col("id").alias(id_col), "line_no", "copies", "class_id", "class_line", "n_links", "kept")


def _decisions(df: DataFrame, steps: Steps, id_col: str, text_col: str) -> DataFrame:
    """The rows of dedup_lines with the texts' marks."""
    classes, hot = line_classes(df, steps, id_col, text_col)
    own = occurrences(df, id_col, text_col).select("id", "mark", "line_no", *_marks(F.col("line")))
    # a line may fill a third of the table: such are few, and each is met in SALTS places
    salts = F.array(*map(F.lit, range(SALTS)))
    own = own.join(F.broadcast(hot.withColumn("hot", F.lit(True))), ["k1", "k2"], "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("id", "line_no"), F.lit(SALTS)).cast("int")).otherwise(0))
    classes = classes.join(F.broadcast(hot.withColumn("hot", F.lit(True))), ["k1", "k2"], "left").withColumn("salt", F.explode(F.when(F.col("hot"), salts).otherwise(F.array(F.lit(0))))).drop("hot")
    got = own.drop("hot").join(classes, ["k1", "k2", "salt"], "left")
    alone = F.col("copies").isNull()
    class_id, class_line = F.when(alone, F.col("id").cast("long")).otherwise(F.col("class_id")), F.coalesce("class_line", "line_no")
    kept = alone | (F.col("class_id").eqNullSafe(F.col("id").cast("long")) & (F.col("class_line") == F.col("line_no")))
    return got.select("id", "mark", "line_no", F.coalesce("copies", F.lit(1).cast("long")).alias("copies"), class_id.alias("class_id"), class_line.alias("class_line"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), kept.alias("kept"))


def without_duplicates(df: DataFrame, steps: Steps = STEPS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df with all their columns, their texts without the lines that aren't kept. Every row stays, if empty.

    Nulls stay null. Rows that repeat an id and a text stay alike: the one line that is kept stays in all of them.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    gone = _decisions(df, steps, id_col, text_col).where(~F.col("kept")).groupBy(name("id").alias("name"), "mark").agg(F.collect_set("line_no").alias("gone"))
    row = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), name(id_col).alias("name"), F.xxhash64(text_col).alias("mark")).join(gone, ["name", "mark"], "left")
    lines = F.split(F.col(f"row.`{text_col}`"), "\n", -1)
    rest = F.array_join(F.filter(F.transform(lines, lambda x, i: F.when(~F.array_contains("gone", i), x)), lambda x: x.isNotNull()), "\n")
    text = F.when(F.col("gone").isNull(), F.col(f"row.`{text_col}`")).otherwise(rest)
    return row.select(*[text.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in df.columns])
