"""Plain Python and numpy kernels of what column expressions can't say: edit paths, n-way LCS, two-means, hosts."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable, Sequence
from itertools import product

import numpy as np


def edit_table(a: Sequence, b: Sequence, same: Callable = lambda x, y: x == y) -> np.ndarray:
    """Unit-cost edit distances of all prefixes."""
    t = np.zeros((len(a) + 1, len(b) + 1), int)
    t[:, 0], t[0, :] = range(len(a) + 1), range(len(b) + 1)
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            t[i, j] = min(t[i - 1, j] + 1, t[i, j - 1] + 1, t[i - 1, j - 1] + (not same(x, y)))
    return t


def edit_distances(words: Sequence[str]) -> np.ndarray:
    """Unit-cost edit distances of each two words: each word against all at once."""
    n, most = len(words), max(map(len, words), default=0)
    codes = np.full((most, n), -1, np.int32)
    for k, w in enumerate(words):
        codes[: len(w), k] = [ord(c) for c in w]
    lengths, out = np.array([len(w) for w in words], int), np.zeros((n, n), np.int32)
    for k, w in enumerate(words):
        row = np.repeat(np.arange(most + 1, dtype=np.int32)[:, None], n, axis=1)
        for c in w:
            last = row[0].copy()
            row[0] += 1
            for j in range(1, most + 1):
                now = np.minimum(np.minimum(row[j], row[j - 1]) + 1, last + (codes[j - 1] != ord(c)))
                last, row[j] = row[j].copy(), now
        out[k] = row[lengths, np.arange(n)]
    return out


def edit_path(a: Sequence, b: Sequence, same: Callable = lambda x, y: x == y) -> tuple[int, str]:
    """(distance, script of R D I S). Going back, the diagonal is preferred; deletion and insertion must be strictly cheaper."""
    t = edit_table(a, b, same)
    i, j, back = len(a), len(b), []
    while i and j:
        options = [(t[i - 1, j - 1], "R" if t[i, j] == t[i - 1, j - 1] else "S", 1, 1), (t[i - 1, j], "D", 1, 0), (t[i, j - 1], "I", 0, 1)]
        _, op, di, dj = min(options, key=lambda o: o[0])  # the first of equals
        back.append(op)
        i, j = i - di, j - dj
    return int(t[-1, -1]), "D" * i + "I" * j + "".join(back[::-1])


def common_subsequence(sequences: Sequence[Sequence], same: Callable = lambda x, y: x == y, cells: int = 10_000_000) -> list:
    """A longest common subsequence of any number of sequences, as elements of the first; of equal ways the lowest dimension goes.

    The table has the product of (length + 1) cells; ValueError beyond `cells` of them.
    """
    if not sequences:
        return []
    shape = tuple(len(s) + 1 for s in sequences)
    if np.prod(shape, dtype=float) > cells:
        raise ValueError(f"the table would have {np.prod(shape, dtype=float):.3g} cells, more than {cells}")
    value, trace = np.zeros(shape, int), np.full(shape, -1, int)
    for at in product(*(range(1, n) for n in shape)):
        heads = [s[k - 1] for s, k in zip(sequences, at)]
        if all(same(h, heads[0]) for h in heads[1:]):
            value[at] = value[tuple(k - 1 for k in at)] + 1
            continue
        for dim in range(len(shape)):
            less = at[:dim] + (at[dim] - 1,) + at[dim + 1 :]
            if value[less] > value[at]:
                value[at], trace[at] = value[less], dim
    at, out = tuple(n - 1 for n in shape), []
    while value[at]:
        if trace[at] < 0:
            out.append(sequences[0][at[0] - 1])
            at = tuple(k - 1 for k in at)
        else:
            at = tuple(k - (dim == trace[at]) for dim, k in enumerate(at))
    return out[::-1]


def two_means_cutoff(values: Sequence[float], counts: Sequence[int] | None = None) -> float | None:
    """Largest value of the lower class when values are parted into two classes by their means; None for fewer than two different ones.

    values may be given as distinct values with counts. It begins at the median: what is below its value is the lower
    class, or, if nothing is, what equals it. A value half way between the means belongs to the lower class.
    """
    v, c = np.asarray(values, float), np.ones(len(values), np.int64) if counts is None else np.asarray(counts, np.int64)
    order = np.argsort(v, kind="stable")
    v, where = np.unique(v[order], return_inverse=True)
    c = np.bincount(where, weights=c[order]).astype(np.int64) if len(v) else c
    n = int(c.sum()) if len(v) else 0
    if n < 2 or len(v) < 2:
        return None
    heads, sums = np.cumsum(c), np.cumsum(v * c)
    k = int(np.searchsorted(heads, n // 2, side="right")) or 1
    for _ in range(10_000):
        low = sums[k - 1] / heads[k - 1]
        high = (sums[-1] - sums[k - 1]) / (n - heads[k - 1])
        new = min(max(int(np.searchsorted(v, (low + high) / 2, side="right")), 1), len(v) - 1)
        if new == k:
            break
        k = new
    return float(v[k - 1])


def host(text: str | None) -> tuple[str, str] | None:
    """(kind, canonical text): ipv6, ipv4 or name, tried in this order."""
    if text is None:
        return None
    for kind, make in (("ipv6", ipaddress.IPv6Address), ("ipv4", ipaddress.IPv4Address)):
        try:
            if "%" not in text:
                return kind, str(make(text))
        except ValueError:
            pass
    return "name", text
