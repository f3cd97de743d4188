"""Words of whole texts as arrays of 64-bit hashes, for the operators that compare word sequences in tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text that a task turns into words at a time; texts are never cut, a longer one is taken alone.
TOGETHER = 2_000_000
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing function (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(batch: pa.RecordBatch, column: str, together: int = TOGETHER, rows: int | None = None) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``together`` bytes of text, and at most ``rows`` rows if given."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes) // together
    if rows:
        group = group * batch.num_rows + np.arange(batch.num_rows) // rows
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:], strict=False):
        yield batch.slice(a, b - a)


def split(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Row offsets and the words (runs without ASCII white space) of texts; null is without words."""
    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.ascii_lower(texts)  # A-Z only
    lists = pc.ascii_split_whitespace(texts)
    words = lists.flatten().dictionary_encode()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets -= offsets[0]
    empty = pc.index(words.dictionary, "").as_py()
    if empty >= 0:  # beside leading and trailing white space
        real = words.indices.to_numpy() != empty
        offsets = np.concatenate([[0], np.cumsum(real)])[offsets]
        words = words.filter(pa.array(real))
    return offsets, words


def hashes(words: pa.DictionaryArray) -> np.ndarray:
    distinct = np.array([xxhash.xxh3_64_intdigest(w) for w in words.dictionary.to_pylist()], np.uint64)
    return distinct[words.indices.to_numpy()] if len(distinct) else np.zeros(0, np.uint64)


def powers(base: int, n: int) -> np.ndarray:
    if len(_powers.get(base, ())) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        _powers[base] = np.multiply.accumulate(steps)
    return _powers[base][:n]


class Sequences:
    """Hashes of any run of words in constant time: a prefix sum of a polynomial modulo 2**64."""

    def __init__(self, word_hashes: np.ndarray):
        n = len(word_hashes)
        self.forward = powers(_BASE, n + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(word_hashes * powers(_UNBASE, n + 1)[:n], dtype=np.uint64)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.forward[start])


def sliding(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Least (or greatest) of x[i : i + width], for every i with a whole window."""
    pick = np.minimum if least else np.maximum
    out, have = x, 1
    while 2 * have <= width:
        out, have = pick(out[:-have], out[have:]), 2 * have
    rest = width - have
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


def doc_of(offsets: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
