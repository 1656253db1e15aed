"""Rule statistics of whole texts, computed for an Arrow slice at a time with numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from logweave.llm.common import filled, raw_bytes, segment_sums

_WHITE = [0x20, *range(0x09, 0x0E)]


def _table(chars: bytes | list[int]) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


_CLASSES = {
    "white": _table(_WHITE),
    "lead": ~_table(range(0x80, 0xC0)),
    "symbol": _table(b"#*$%&|<>"),
    "upper": _table(range(0x41, 0x5B)),
    "lower": _table(range(0x61, 0x7B)),
    "digit": _table(b"0123456789"),
    "stop": _table(b".,;:"),
    "loud": _table(b"!?"),
    "mark": _table(b"()[]{}\"'_=/\\+~^`@-"),
    "high": _table(range(0xC0, 0x100)),
}


def _repeats(keys: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, same): keys in stable order; same[i]: entry order[i+1] has the key and document of order[i]."""
    order = np.argsort(keys, kind="stable")
    k, d = keys[order], doc[order]
    return order, (k[1:] == k[:-1]) & (d[1:] == d[:-1])


def statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """Counts by text, nulls as empty texts.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words as the quality rules define them; n_lines (with a word),
    n_unique (words) and the byte classes upper, lower, digit, stop, loud, mark, high.
    """
    texts = filled(texts)
    n = len(texts)
    data, ends = raw_bytes(texts)
    hits = {name: segment_sums(table[data], ends) for name, table in _CLASSES.items() if name not in ("white", "lead")}
    white, lead = _CLASSES["white"][data], _CLASSES["lead"][data]
    out = {"word_chars": segment_sums(lead & ~white, ends), "n_symbols": hits.pop("symbol"), **hits}

    parts = pc.ascii_split_whitespace(texts)
    coded = parts.flatten().dictionary_encode()
    ids = coded.indices.to_numpy().astype(np.int64)
    doc = np.repeat(np.arange(n), np.diff(parts.offsets.to_numpy().astype(np.int64)))
    full = (pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False) > 0)[ids] if len(ids) else np.zeros(0, bool)
    ids, doc = ids[full], doc[full]
    out["n_words"] = np.bincount(doc, minlength=n)
    _, same = _repeats(ids, doc)
    out["n_unique"] = out["n_words"] - _again(ids, doc, n)

    width = max(1, len(coded.dictionary))
    if width >= 1 << 21:  # three word numbers no longer fit 63 bits: number the pairs first
        pair = np.unique(ids[:-2] * width + ids[1:-1], return_inverse=True)[1] if len(ids) > 2 else np.zeros(0, np.int64)
        keys = pair * width + ids[2:] if len(ids) > 2 else pair
    else:
        keys = (ids[:-2] * width + ids[1:-1]) * width + ids[2:] if len(ids) > 2 else np.zeros(0, np.int64)
    at = np.flatnonzero(doc[:-2] == doc[2:]) if len(doc) > 2 else np.zeros(0, np.int64)
    order, same = _repeats(keys[at], doc[at])
    twice = np.zeros(len(at), bool)
    twice[order[:-1][same]] = True
    twice[order[1:][same]] = True
    covered = np.zeros(len(ids) + 2, bool)
    for k in range(3):
        covered[at[twice] + k] = True
    out["n_repeat_words"] = np.bincount(doc[covered[: len(ids)]], minlength=n)

    lines = pc.split_pattern(texts, "\n")
    coded = lines.flatten().dictionary_encode()
    ids = coded.indices.to_numpy().astype(np.int64)
    doc = np.repeat(np.arange(n), np.diff(lines.offsets.to_numpy().astype(np.int64)))
    full = (pc.binary_length(pc.ascii_trim_whitespace(coded.dictionary)).to_numpy(zero_copy_only=False) > 0)[ids] if len(ids) else np.zeros(0, bool)
    ids, doc = ids[full], doc[full]
    out["n_lines"] = np.bincount(doc, minlength=n)
    out["n_dup_lines"] = _again(ids, doc, n)
    return {k: v.astype(np.int64) for k, v in out.items()}


def _again(keys: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """By document, entries equal to an earlier one."""
    order, same = _repeats(keys, doc)
    return np.bincount(doc[order[1:][same]], minlength=n)


#: Names of statistics(), in the order in which rows of them compare.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_unique", "upper", "lower", "digit", "stop", "loud", "mark", "high")

#: Columns of features(), all of them ratios or logarithms.
FEATURES = ("words_log", "word_length", "symbols", "upper", "digits", "stops", "loud", "marks", "high", "dup_lines", "repeats", "unique", "line_words")


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    """One row of FEATURES for each text; an empty text is all zeros."""
    words, chars = np.maximum(s["n_words"], 1), np.maximum(s["word_chars"], 1)
    letters, lines = np.maximum(s["upper"] + s["lower"], 1), np.maximum(s["n_lines"], 1)
    return np.column_stack([
        np.log1p(s["n_words"]), np.minimum(s["word_chars"] / words, 50), s["n_symbols"] / chars, s["upper"] / letters,
        s["digit"] / chars, s["stop"] / words, s["loud"] / words, s["mark"] / chars, s["high"] / chars,
        s["n_dup_lines"] / lines, s["n_repeat_words"] / words, s["n_unique"] / words, np.log1p(s["n_words"] / lines),
    ])
