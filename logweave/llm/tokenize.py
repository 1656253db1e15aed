"""Token ids and counts in Arrow functions, by the tokenizer libraries, over units that are safe to cut.

Cost is dominated by the library's merge loop, so each distinct unit (a word, or a word with the space before it) goes
through the library once per worker and is remembered, within a bound; texts that have no safe cut go to it whole, and
so do all where an encoder that merges by rank takes the library's place: that is quicker than looking up their units.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from logweave.llm.common import byte_slices, filled, segment_sums, text_bytes

#: Units and ids that a worker remembers at most before it starts afresh.
MEMO_UNITS, MEMO_IDS = 400_000, 4_000_000
WHITE_FREE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class UnitEncoder:
    """ids of texts, as the library gives them for the whole text.

    plan "words": the tokenizer drops white space before it looks for tokens, so no token crosses ASCII white space.
    plan "spaced": byte-level pre-tokens begin at a single space before a non-space; a text with no double space and
    none at its end can be cut before every space. plan "ranks": as that, but texts aren't cut, as merging by rank is
    quick. plan "whole": everything else.
    """

    def __init__(self, path: str, end_id: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.plan, self.end_id = "whole", end_id
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._library = lambda texts: model.encode(texts, num_threads=1)
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            self._library = lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            self.plan = _safe_plan(spec)
            if self.plan == "spaced" and (same := _rank_encoder(spec)) is not None:
                self.plan = "ranks"
                whole, special = self._library, [t["content"] for t in spec.get("added_tokens", [])]
                self._library = lambda texts: [same(t) if not any(x in t for x in special) else whole([t])[0] for t in texts]
        self._clear()

    def _clear(self) -> None:
        self._index: dict[str, int] = {}
        self._starts, self._lengths = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self._flat, self._used, self._units = np.zeros(4096, np.uint32), 0, 0
        if self.end_id is not None:
            self._append([[self.end_id]])
        self._lasting = self._units, self._used

    def _make_room(self) -> None:
        """Only between slices: the unit numbers of a slice are in use until its ids are read."""
        self._units, self._used = self._lasting
        if self._units > MEMO_UNITS or self._used > MEMO_IDS:
            self._clear()

    def _append(self, ids: list[list[int]]) -> None:
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum()))
        while self._units + len(ids) > len(self._starts):
            self._starts, self._lengths = np.resize(self._starts, 2 * len(self._starts)), np.resize(self._lengths, 2 * len(self._lengths))
        while self._used + len(flat) > len(self._flat):
            self._flat = np.resize(self._flat, 2 * len(self._flat))
        at = slice(self._units, self._units + len(ids))
        self._lengths[at] = lengths
        self._starts[at] = self._used + np.cumsum(lengths) - lengths
        self._flat[self._used : self._used + len(flat)] = flat
        self._used += len(flat)
        self._units += len(ids)

    def _look_up(self, units: list[str]) -> np.ndarray:
        get = self._index.get
        found = np.fromiter((get(u, -1) for u in units), np.int64, len(units))
        new = list(dict.fromkeys(units[i] for i in np.flatnonzero(found < 0)))
        if new:
            for k in range(0, len(new), 4096):
                part = new[k : k + 4096]
                first = self._units
                self._append(self._library(part))
                self._index.update(zip(part, range(first, first + len(part))))
            found = np.fromiter((self._index[u] for u in units), np.int64, len(units))
            self._lasting = self._units, self._used
        return found

    def _look_up_once(self, texts: list[str]) -> np.ndarray:
        """As _look_up, but what is new here goes when the slice is done."""
        first, places = self._units, {t: k for k, t in enumerate(dict.fromkeys(texts))}
        distinct = list(places)
        for k in range(0, len(distinct), 4096):
            self._append(self._library(distinct[k : k + 4096]))
        return first + np.fromiter((places[t] for t in texts), np.int64, len(texts))

    def _units_of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(unit numbers of all texts in a row, offsets by text), good until _make_room."""
        if self.plan == "whole":
            return self._look_up(texts.to_pylist()), np.arange(len(texts) + 1)
        if self.plan == "ranks":
            return self._look_up_once(texts.to_pylist()), np.arange(len(texts) + 1)
        if self.plan == "words":
            parts = pc.ascii_split_whitespace(texts)
            words = parts.flatten().dictionary_encode()
            return self._look_up(words.dictionary.to_pylist())[words.indices.to_numpy()], parts.offsets.to_numpy().astype(np.int64)
        unsafe = pc.or_(pc.match_substring(texts, "  "), pc.ends_with(texts, " ")).to_numpy(zero_copy_only=False)
        if unsafe.any():
            rest, offsets = self._units_of(pc.filter(texts, pa.array(~unsafe))) if not unsafe.all() else (np.zeros(0, np.int64), np.zeros(1, np.int64))
            whole = self._look_up_once(pc.filter(texts, pa.array(unsafe)).to_pylist())
            sizes = np.ones(len(texts), np.int64)
            sizes[~unsafe] = np.diff(offsets)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            mask = np.repeat(unsafe, sizes)
            out = np.empty(ends[-1], np.int64)
            out[mask], out[~mask] = whole, rest
            return out, ends
        parts = pc.split_pattern(texts, " ")
        offsets = parts.offsets.to_numpy().astype(np.int64)
        words = parts.flatten().dictionary_encode()
        numbers = self._look_up([" " + w for w in words.dictionary.to_pylist()])[words.indices.to_numpy()]
        firsts = parts.flatten().take(pa.array(offsets[:-1])).to_pylist()
        numbers[offsets[:-1]] = self._look_up(firsts)
        return numbers, offsets

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text (no nulls)."""
        if len(texts) == 0:
            return np.zeros(0, np.int64)
        self._make_room()
        numbers, offsets = self._units_of(texts)
        return segment_sums(self._lengths[numbers], offsets)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(uint32 ids of all texts in a row, offsets by text), end_id after each text if it is set."""
        if len(texts) == 0:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self._make_room()
        numbers, offsets = self._units_of(texts)
        if self.end_id is not None:
            numbers = np.insert(numbers, offsets[1:], 0)
            offsets = offsets + np.arange(len(offsets))
        lengths = self._lengths[numbers]
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self._starts[numbers] - (ends - lengths), lengths)
        return self._flat[at], np.concatenate([[0], ends])[offsets]


def _safe_plan(spec: dict) -> str:
    pre, normal = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if any(any(c.isspace() for c in t["content"]) or t["lstrip"] or t["rstrip"] for t in spec.get("added_tokens", [])):
        return "whole"
    if normal is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
        return "spaced"
    steps = pre.get("pretokenizers", [])
    kinds = {n.get("type") for n in (normal or {}).get("normalizers", [])}
    if steps and steps[0].get("pattern", {}).get("Regex") == WHITE_FREE and steps[0].get("invert") and steps[0].get("behavior") == "Removed" and kinds <= {"NFC", "Replace", "Lowercase"}:
        return "words"
    return "whole"


#: How byte-level tokenizers part a text into pre-tokens.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _rank_encoder(spec: dict):
    """A quicker encoder of the same vocabulary that merges by rank, or None where the order of ids isn't that of merges.

    Where each merge's product has the next id, the pair to merge first is the one of lowest id, so both give the same ids.
    """
    model, vocab = spec["model"], spec["model"]["vocab"]
    if any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return None
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    if any(vocab.get(m) != 256 + k for k, m in enumerate(merged)):
        return None
    import tiktoken

    # printable bytes stand for themselves, the others for the code points from 256 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    special = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items() if token not in special}
    if len(ranks) != len(merged) + 256:
        return None
    return tiktoken.Encoding("units", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


_ENCODERS: dict[tuple, UnitEncoder] = {}


def encoder(path: str, end_id: int | None = None) -> UnitEncoder:
    """The worker's encoder for a vocabulary file: kept across tasks."""
    key = (path, end_id)
    if key not in _ENCODERS:
        _ENCODERS[key] = UnitEncoder(path, end_id)
    return _ENCODERS[key]


def count_tokens(df: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows each give a row, null ids stay null, columns besides
    the two named are not read. Only lengths leave the Arrow function. A text of any length is counted whole.
    """
    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for part in byte_slices(batches, text_col):
            n = enc.counts(filled(part.column(text_col)))
            yield pa.RecordBatch.from_arrays(
                [part.column(id_col), pa.array(text_bytes(part.column(text_col))), pa.array(n), pa.array(n > limit)],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    return df.select(id_col, text_col).mapInArrow(run, schema)
