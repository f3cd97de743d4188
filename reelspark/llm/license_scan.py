"""License templates found in texts through MinHash bands over overlapping windows.

Words are compared without A-Z case and without punctuation at their ends; texts and templates are sets of ``shingle``-word shingles (a
shorter template is one shingle of all its words). A template of T shingles is contained in a text where some run of 2T shingles
(``SPAN``) holds ``least`` of the template's set or more; so words may be inserted up to the template's own length. A text is cut into
blocks of T shingles, and three neighbouring blocks are a window, so every run of 2T shingles lies whole in some window. With m the least
number of shared shingles, the two then resemble each other by m / (4T - m) or more. The bands have one row each, and there are as
many as make the chance of at least one collision ``recall`` or more at that resemblance. Collisions only retrieve: the windows where a
template collided are joined, with the two blocks on either side, and every run of 2T shingles in them is compared exactly. Templates that
repeat a shingle can resemble their windows as little as one likes; they are retrieved by their shingles themselves instead.

Templates are a bounded parameter (``MOST_TEMPLATES`` rows, checked); they go to every task, so documents are never shuffled.

Defined results: null texts and texts without words match nothing; null templates and templates without words are ignored. Equal
templates match each by itself. A row for each match, from its first to its last shared
shingle: of matches of one template that overlap, the fullest stands (then the shortest, then the first). Repeated rows match each by itself; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from reelspark.llm import wordhash

SHINGLE, LEAST, RECALL = 5, 0.8, 0.9999
SPAN = 2  # fixed: a match's length in lengths of its template
MOST_TEMPLATES, MOST_TEMPLATE_WORDS = 5_000, 5_000_000
_ENDS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def bands_for(resemblance: float, recall: float) -> int:
    """Bands of one row so that 1 - (1 - resemblance) ** bands >= recall."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - resemblance)))


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row offsets and hashes of the words; words of punctuation alone count as empty ones."""
    offsets, coded = wordhash.split(texts, lower=True)
    plain = pc.utf8_trim(coded.dictionary, characters=_ENDS)
    return offsets, wordhash.hashes(pa.DictionaryArray.from_arrays(coded.indices, plain))


def _shingles(sequence: wordhash.Sequences, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of each row's shingles, and the shingles of n words."""
    count = np.maximum(np.diff(offsets) - n + 1, 0)
    begins = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(begins[-1]) - np.repeat(begins[:-1] - offsets[:-1], count)
    return begins, sequence.of(at, at + n)


def _family(k: int) -> np.ndarray:
    """Odd multipliers; multiplying by one permutes the 64-bit numbers."""
    return wordhash.mix(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _matches(at: np.ndarray, which: np.ndarray, often: np.ndarray, span: int, least: int) -> list[tuple[int, int, int]]:
    """Matches in places ``at`` of shared shingles ``which``: first and last place, distinct shingles.

    A match begins at a shared shingle, has ``least`` distinct ones or more in ``span`` places, and ends where the last one counts: as
    often as the template has it (``often``).
    """
    at, which, often = at.tolist(), which.tolist(), often.tolist()
    places: dict[int, list[int]] = {}
    before = []  # the place among the hits from which on this one is no more than the template has
    for j, t in enumerate(which):
        seen = places.setdefault(t, [])
        before.append(seen[-often[t]] if len(seen) >= often[t] else -1)
        seen.append(j)
    count: dict[int, int] = {}
    distinct = counted = end = 0
    found = []
    for i, t in enumerate(which):
        while end < len(at) and at[end] < at[i] + span:
            k = which[end]
            count[k] = count.get(k, 0) + 1
            distinct += count[k] == 1
            counted += count[k] <= often[k]
            end += 1
        if distinct >= least:
            last = end - 1
            while before[last] >= i:
                last -= 1
            found.append((-distinct, -counted, at[last] - at[i], at[i], at[last]))
        count[t] -= 1
        distinct -= count[t] == 0
        counted -= count[t] < often[t]
    kept: list[tuple[int, int, int]] = []
    for d, _, _, a, b in sorted(found):
        if all(b < x or y < a for x, y, _ in kept):
            kept.append((a, b, -d))
    return sorted(kept)


class _Templates:
    """Templates with the same number of shingles, of the same number of words: name, distinct shingles, how often each stands."""

    def __init__(self, words: int, block: int, sets: list[tuple[str, np.ndarray, np.ndarray]], least: float, recall: float):
        self.words, self.block, self.sets = words, block, sets
        self.least = [int(np.ceil(least * len(s) - 1e-9)) for _, s, _ in sets]
        self.repeats = len(sets[0][1]) < block
        self.family = _family(0 if self.repeats else bands_for(self.least[0] / ((SPAN + 2) * block - self.least[0]), recall))
        self.keys, self.owners = [], []
        for a in self.family:
            low = np.array([(s * a).min() for _, s, _ in sets])
            order = np.argsort(low, kind="stable")
            self.keys.append(low[order])
            self.owners.append(order)

    def _retrieve(self, row: np.ndarray, start: np.ndarray, shingles: np.ndarray) -> set[tuple[int, int]]:
        """Template and first block of the windows that may hold it."""
        met = set()
        if self.repeats:
            for t, (_, s, _) in enumerate(self.sets):
                hit = np.flatnonzero(s[np.minimum(np.searchsorted(s, shingles), len(s) - 1)] == shingles)
                met |= {(t, w) for w in np.unique(np.searchsorted(start, hit, side="right") - 1).tolist()}
            return met
        follow = [np.flatnonzero(row[k:] == row[: max(len(row) - k, 0)]) for k in range(1, SPAN + 1)]
        for a, keys, owners in zip(self.family, self.keys, self.owners, strict=True):
            block = np.minimum.reduceat(shingles * a, start)
            low = block.copy()
            for k, first in enumerate(follow, 1):
                low[first] = np.minimum(low[first], block[first + k])
            at = np.minimum(np.searchsorted(keys, low), len(keys) - 1)
            for w in np.flatnonzero(keys[at] == low).tolist():
                k = int(at[w])
                while k < len(keys) and keys[k] == low[w]:
                    met.add((int(owners[k]), w))
                    k += 1
        return met

    def search(self, begins: np.ndarray, shingles: np.ndarray) -> Iterator[tuple[int, str, int, int, float]]:
        """Row, template, first shingle, shingles covered and containment of each match."""
        count = np.diff(begins)
        blocks = -(-count // self.block)
        row = np.repeat(np.arange(len(count)), blocks)
        if not len(row):
            return
        start = begins[:-1][row] + (np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * self.block
        areas: list[list[int]] = []  # template, row, first and last shingle
        for t, w in sorted(self._retrieve(row, start, shingles)):
            r = int(row[w])
            a, b = max(int(start[w]) - SPAN * self.block, int(begins[r])), min(int(start[w]) + (2 * SPAN + 1) * self.block, int(begins[r + 1]))
            if areas and areas[-1][:2] == [t, r] and a <= areas[-1][3]:
                areas[-1][3] = b
            else:
                areas.append([t, r, a, b])
        found = []
        for t, r, a, b in areas:
            name, want, often = self.sets[t]
            which = np.minimum(np.searchsorted(want, shingles[a:b]), len(want) - 1)
            hit = np.flatnonzero(want[which] == shingles[a:b])
            if len(np.unique(which[hit])) >= self.least[t]:
                found += [(r, name, a + x - int(begins[r]), y - x + 1, d / len(want)) for x, y, d in _matches(hit, which[hit], often, SPAN * self.block, self.least[t])]
        yield from sorted(found)


def _prepare(templates: list[tuple[str, str]], shingle: int, least: float, recall: float) -> list[_Templates]:
    offsets, hashed = _words(pa.array([t for _, t in templates], pa.string()))
    groups: dict[tuple[int, int, bool], list[tuple[str, np.ndarray, np.ndarray]]] = {}
    sequence = wordhash.Sequences(hashed)
    for (name, _), a, b in zip(templates, offsets, offsets[1:], strict=False):
        if b > a:
            n = min(shingle, int(b - a))
            at = np.arange(a, b - n + 1)
            once, often = np.unique(sequence.of(at, at + n), return_counts=True)
            groups.setdefault((n, len(at), len(once) < len(at)), []).append((name, once, often))
    return [_Templates(n, size, sets, least, recall) for (n, size, _), sets in sorted(groups.items(), key=lambda x: x[0])]


def scan(docs: DataFrame, templates: DataFrame, shingle: int = SHINGLE, least: float = LEAST, recall: float = RECALL) -> DataFrame:
    """docs: doc_id, text; templates: template_id, text. A row for each match: doc_id, template_id, first_word, n_words, containment."""
    rows = templates.select("template_id", "text").dropna().limit(MOST_TEMPLATES + 1).collect()
    if len(rows) > MOST_TEMPLATES or sum(len(r["text"].split()) for r in rows) > MOST_TEMPLATE_WORDS:
        raise ValueError("templates are sent to every task; there are more than MOST_TEMPLATES or MOST_TEMPLATE_WORDS")
    prepared = _prepare(sorted((str(r["template_id"]), r["text"]) for r in rows), shingle, least, recall)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in wordhash.slices(batch, "text"):
                offsets, hashed = _words(part.column("text"))
                sequence = wordhash.Sequences(hashed)
                cut = {n: _shingles(sequence, offsets, n) for n in {t.words for t in prepared}}
                found = [(r, name, first, n + t.words - 1, share) for t in prepared for r, name, first, n, share in t.search(*cut[t.words])]
                r, name, first, n, share = zip(*found, strict=True) if found else ((),) * 5
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(r, pa.int64())), pa.array(name, pa.string()), pa.array(first, pa.int64()), pa.array(n, pa.int64()), pa.array(share, pa.float64())],
                    ["doc_id", "template_id", "first_word", "n_words", "containment"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, template_id string, first_word long, n_words long, containment double")
