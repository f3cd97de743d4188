"""Removal of repeated passages by relative Lempel-Ziv parsing.

A passage repeats if a window of ``window`` consecutive words of one document starts at another place as
well, in the same document or another. All documents are the reference, cut into blocks that are indexed by
*anchors*: of the word sequences of ``anchor`` words within a window, the one with the least hash. Equal
windows have the same anchor at the same place, so an index of anchors misses none. The block of an anchor
is all that the windows around it can reach: ``window - anchor`` words to either side.

* A document is parsed against every indexed block that shares an anchor with it. A block that stands whole at more than one place is a factor.
* Where blocks of one anchor differ, each is parsed greedily from its first word: the longest run of words that begins there and stands
  in another block of the anchor, at least ``window`` words, is a factor; its words are compared one by one. The parse goes on at the factor's
  boundary, with the first window that is not inside it; where no factor begins, with the next word.
* Overlapping factors merge into spans.

No key gathers many rows. Blocks that a batch of texts has twice are factors at once and send one row for all to the shuffle;
the blocks of an anchor that a batch has ``hot_at`` times, or that has more than MOST_BLOCKS in all, are cut into windows that meet by content instead of
by anchor, and windows that a batch has twice send one row again. Both ways give the same result.

Blocks and windows count as equal whose anchors and whole contents have equal hashes of 64 bits each (for windows of hot anchors, two hashes of the content);
texts count as equal with two equal hashes. That is 128 bits: of 10**13 windows less than one false pair is to be expected in 10**12 runs.

Defined results: null and empty texts have no words. Rows are told apart by text alone, since what goes depends on nothing else; repeated
rows repeat each other's passages and are each cut, whatever their doc_id. Documents shorter than a window keep all words. Texts without
removals are joined by single spaces like all others. Extra columns of the input are ignored unless carried along. A text is parsed whole by one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.llm import wordhash
from reelspark.llm.common import discard, mark_known, materialise

WINDOW, ANCHOR, HOT = 35, 8, 64
MOST_BLOCKS = 4096
_LAST = np.uint64(2**64 - 1)


def _row_key() -> Column:
    """128 bits of the text. Rows that agree in it have the same result, so they share a key."""
    return F.struct(F.xxhash64("text").alias("low"), F.xxhash64(F.lit(7), "text").alias("high")).alias("row")


class _Parse:
    """The anchors of a batch of texts."""

    def __init__(self, texts: pa.Array, window: int, anchor: int):
        self.window, self.reach = window, window - anchor
        self.offsets, self.words = wordhash.split(texts)
        n = int(self.offsets[-1])
        self.doc = wordhash.doc_of(self.offsets)
        self.first, self.last = self.offsets[:-1][self.doc], self.offsets[1:][self.doc]
        self.word = wordhash.hashes(self.words)
        self.sequence = wordhash.Sequences(self.word)
        at = np.arange(n)
        self.hash = np.full(n, _LAST)
        whole = at + anchor <= self.last
        self.hash[whole] = self.sequence.of(at[whole], at[whole] + anchor)
        gap = self.reach + 1
        padded = np.concatenate([self.hash, np.full(gap - 1, _LAST)])
        least = wordhash.sliding(padded, gap, True) if n else padded[:0]
        self.least = np.where(at + window <= self.last, least, np.uint64(0))  # of the window that begins here; 0: no window
        reach = wordhash.sliding(np.concatenate([np.zeros(gap - 1, np.uint64), self.least]), gap, False) if n else padded[:0]
        self.anchors = np.flatnonzero((reach == self.hash) & whole)

    def before(self) -> np.ndarray:
        """For each anchor the last place before it with the same hash, or -1; a window belongs to its first anchor."""
        order = np.lexsort((self.anchors, self.hash[self.anchors]))
        at = self.anchors[order]
        same = self.hash[at[1:]] == self.hash[at[:-1]]
        out = np.full(len(at), -1, np.int64)
        out[order[1:][same]] = at[:-1][same]
        return out

    def blocks(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.maximum(self.first[at], at - self.reach), np.minimum(self.last[at], at + self.window)

    def block_hash(self, at: np.ndarray) -> np.ndarray:
        a, b = self.blocks(at)
        return wordhash.mix(self.sequence.of(a, b) + np.uint64(1000003) * (at - a).astype(np.uint64) + (b - at).astype(np.uint64))


def _repeats(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row, how many rows have its keys, and whether it is the first of them."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[order[1:]] != k[order[:-1]] for k in keys]) if len(order) else new[1:]
    group = np.cumsum(new) - 1
    count, first = np.empty(len(order), np.int64), np.empty(len(order), bool)
    count[order], first[order] = np.bincount(group)[group] if len(order) else 0, new
    return count, first


def _whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Batches of rows sorted by key, cut so that equal keys stay together."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        batch = batch if rest is None else pa.concat_batches([rest, batch])
        keys = batch.column(key).to_numpy()
        at = int(np.searchsorted(keys, keys[-1], "left"))
        rest = batch.slice(at)
        if at:
            yield batch.slice(0, at)
    if rest is not None:
        yield rest


def shared_blocks(docs: DataFrame, window: int, anchor: int, hot_at: int) -> DataFrame:
    """row, at (word number), ask, hot: the anchors that stand at more than one place, of docs (row, text).

    ask 0: the whole block is a factor. ask 1: its windows are to be checked. ask 2: its windows are known to
    repeat and stand for all like it. hot: windows of this anchor meet by content.
    """
    kind = docs.schema["row"].dataType.simpleString()

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in wordhash.slices(batch, "text"):
                p = _Parse(part.column("text"), window, anchor)
                at, doc = p.anchors, p.doc[p.anchors]
                name, block = p.hash[at], p.block_hash(at)
                times, first = _repeats(name, block)
                of_anchor, first_of_anchor = _repeats(name)
                twice, often = times > 1, of_anchor >= hot_at
                # weight 1 asks; 2 stands for a repeated block; 0 tells of a hot anchor. Rows with an answer go anywhere.
                known = twice | often
                index = np.concatenate([np.flatnonzero(~known), np.flatnonzero(twice & first), np.flatnonzero(often & first_of_anchor), np.flatnonzero(known)])
                counts = [(~known).sum(), (twice & first).sum(), (often & first_of_anchor).sum(), known.sum()]
                weight = np.repeat(np.array([1, 2, 0, 3], np.int8), counts)
                ask = np.where(weight == 3, (~twice[index]).astype(np.int8), np.int8(-1)).astype(np.int8)
                key = np.where(weight == 3, wordhash.mix(index.astype(np.uint64) + name[index]), name[index]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(np.where(weight == 3, 0, block[index].view(np.int64))), part.column("row").take(pa.array(doc[index])), pa.array((at - p.first[at])[index].astype(np.int32)), pa.array(weight), pa.array(ask)],
                    ["anchor", "block", "row", "at", "weight", "ask"],
                )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_groups(batches, "anchor"):
            name, block, weight, ask = (batch.column(c).to_numpy() for c in ("anchor", "block", "weight", "ask"))
            done = weight == 3
            mixed = np.where(done, -1 - np.arange(len(name)), name)  # answered rows stand alone
            alone = np.concatenate([[True], mixed[1:] != mixed[:-1]]) | done
            group = np.cumsum(alone) - 1
            new = alone | np.concatenate([[True], block[1:] != block[:-1]])
            block_no = np.cumsum(new) - 1
            rows, blocks = np.bincount(group[~done], minlength=group[-1] + 1)[group], np.bincount(group, weights=new)[group]
            total = np.bincount(block_no, weights=np.where(done, 0, weight))[block_no]
            hot = (np.bincount(group, weights=weight == 0)[group] > 0) | (rows > MOST_BLOCKS)
            shared = (rows > 1) & ~done
            whole = shared & (weight == 1) & (total > 1)
            check = shared & (weight == 1) & (total == 1)
            # blocks of a hot anchor were sent on without the index, so there are others beside those seen here
            stands = shared & new & (total > 1) & (weight > 0) & ((blocks > 1) | hot)
            out = np.concatenate([np.flatnonzero(done), np.flatnonzero(whole), np.flatnonzero(check), np.flatnonzero(stands)])
            answer = np.concatenate([ask[done], np.zeros(whole.sum(), np.int8), np.ones(check.sum(), np.int8), np.full(stands.sum(), 2, np.int8)]).astype(np.int8)
            is_hot = np.where(done, ask == 1, hot)[out]
            some = batch.take(pa.array(out))
            yield pa.RecordBatch.from_arrays([some.column("row"), some.column("at"), pa.array(answer), pa.array(is_hot)], ["row", "at", "ask", "hot"])

    parsed = docs.select("row", "text").mapInArrow(parse, f"anchor long, block long, row {kind}, at int, weight byte, ask byte")
    return parsed.repartition("anchor").sortWithinPartitions("anchor", "block", F.desc("weight")).mapInArrow(compare, f"row {kind}, at int, ask byte, hot boolean")


def greedy_factors(words: np.ndarray, asked: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first column and length of the factors of the asked rows of words (hashes, aligned by their anchor; what is no word is unlike all else).

    All rows are parsed at once: those whose parse has come to a column look for others with the same window there, and the classes of
    like rows are refined word by word until a row is alone.
    """
    k, width = words.shape
    sequence, base = wordhash.Sequences(words.ravel()), np.arange(k) * width
    at = np.where(asked, 0, width)  # where each row's parse stands
    out: list[tuple[np.ndarray, int, np.ndarray]] = []

    def classes(keys: tuple[np.ndarray, ...], active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class of each row, and whether its class has another row and one that is parsed here."""
        order = np.lexsort(keys)
        new = np.ones(len(order), bool)
        new[1:] = np.logical_or.reduce([x[order[1:]] != x[order[:-1]] for x in keys])
        number = np.cumsum(new) - 1
        same = np.empty(len(order), np.int64)
        same[order] = number
        return same, (np.bincount(same)[same] > 1) & (np.bincount(same, weights=active)[same] > 0)

    for column in range(width - window + 1):
        active = at == column
        if not active.any():
            continue
        same, stay = classes((sequence.of(base + column, base + column + window),), active)
        rows, same = np.flatnonzero(stay), same[stay]
        if len(rows):  # compare the words themselves
            _, first, which = np.unique(same, return_index=True, return_inverse=True)
            content = words[rows, column : column + window]
            if (content != content[first[which]]).any():
                same = np.unique(content, axis=0, return_inverse=True)[1].ravel()
        at[active] = column + 1
        length = window
        while len(rows):
            ends = column + length == width
            if not ends:
                finer, stay = classes((words[rows, column + length], same), active[rows])
            done = active[rows] if ends else active[rows] & ~stay
            ended = rows[done]
            if len(ended):
                # those alone in their class from the start are no factors
                together = np.ones(len(ended), bool) if length > window else (np.bincount(same)[same] > 1)[done]
                ended = ended[together]
                out.append((ended, column, np.full(len(ended), length)))
                at[ended] = column + length - window + 1
            if ends:
                break
            rows, same, length = rows[stay], finer[stay], length + 1
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate([x[0] for x in out]), np.concatenate([np.full(len(x[0]), x[1]) for x in out]), np.concatenate([x[2] for x in out])


def _binary(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Runs of 64-bit values as binary, ``counts`` values each."""
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64) * 8
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


#: What a row of the second shuffle is: an anchor's block, a window of a hot anchor, or a window that is known to repeat.
_BLOCK, _WINDOW, _KNOWN = 0, 1, 3


def repeated_windows(docs: DataFrame, places: DataFrame, copied: DataFrame, window: int, anchor: int) -> DataFrame:
    """row, at, spans (array of ahead, n): the factors around the places (row, at, ask, hot), as words before the place and length.

    copied: row; texts with more than one row stand for what is like them and ask nothing.
    """
    kind = docs.schema["row"].dataType.simpleString()
    asked = places.groupBy("row").agg(F.collect_set(F.struct("at", "ask", "hot")).alias("asked")).join(copied.withColumn("copied", F.lit(True)).hint("shuffle_hash"), "row", "left")
    names = ["key", "row", "at", "kind", "weight", "ahead", "words"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in wordhash.slices(batch, "text"):
                p = _Parse(part.column("text"), window, anchor)
                lists = part.column("asked")
                rows = np.repeat(np.arange(part.num_rows), pc.list_value_length(lists).to_numpy())
                flat = lists.flatten()
                at = flat.field("at").to_numpy().astype(np.int64) + p.offsets[:-1][rows]
                known_text = pc.fill_null(part.column("copied"), False).to_numpy(zero_copy_only=False)[rows]
                weight = np.where(known_text | (flat.field("ask").to_numpy() == 2), 2, 1).astype(np.int8)
                hot = flat.field("hot").to_numpy(zero_copy_only=False)
                row = part.column("row")

                def of(some: np.ndarray, key: np.ndarray, what: int, heavy: np.ndarray, ahead: np.ndarray, words: pa.Array) -> pa.RecordBatch:
                    place = (at - p.first[at])[some].astype(np.int32)  # noqa: B023
                    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), row.take(pa.array(rows[some])), pa.array(place), pa.array(np.full(len(some), what, np.int8)), pa.array(heavy), pa.array(ahead.astype(np.int32)), words], names)  # noqa: B023

                # whole blocks, to be parsed against the others of the anchor
                some = np.flatnonzero(~hot)
                a, b = p.blocks(at[some])
                edges = np.cumsum(b - a)
                index = np.arange(edges[-1] if len(edges) else 0) + np.repeat(a - edges + (b - a), b - a)
                yield of(some, p.hash[at[some]], _BLOCK, weight[some], at[some] - a, _binary(p.word[index], b - a))

                # hot anchors: their windows by content; those that this batch has twice are known, and one of them stands for all
                some = np.flatnonzero(hot)
                last = p.before()[np.searchsorted(p.anchors, at[some])]
                ahead = np.tile(np.arange(p.reach, -1, -1), (len(some), 1))  # every window an anchor can have, row by row
                begin = at[some][:, None] - ahead
                own = (begin > last[:, None]) & (begin >= p.first[at[some]][:, None]) & (begin + window <= p.last[at[some]][:, None])
                own &= p.least[np.maximum(begin, 0)] == p.hash[at[some]][:, None]
                w, begin, ahead = some[np.nonzero(own)[0]], begin[own], ahead[own]
                content = p.sequence.of(begin, begin + window)
                again = wordhash.Sequences(wordhash.mix(p.word ^ np.uint64(0xA5A5A5A55A5A5A5A))).of(begin, begin + window) if len(w) else content
                times, first = _repeats(content, again)
                twice = (times > 1) & (weight[w] == 1)
                send = np.flatnonzero(~twice | first)
                yield of(w[send], content[send], _WINDOW, np.where(twice[send], 2, weight[w[send]]).astype(np.int8), ahead[send], _binary(again[send], np.ones(len(send), np.int64)))
                known = np.flatnonzero(twice)
                yield of(w[known], wordhash.mix(content[known] + known.astype(np.uint64)), _KNOWN, np.ones(len(known), np.int8), ahead[known], _binary(again[:0], np.zeros(len(known), np.int64)))

    reach, width = window - anchor, 2 * window - anchor

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_groups(batches, "key"):
            what, weight, lead = (batch.column(c).to_numpy() for c in ("kind", "weight", "ahead"))
            hit, ahead, length = [np.flatnonzero(what == _KNOWN)], [lead[what == _KNOWN]], [np.full((what == _KNOWN).sum(), window)]
            some = np.flatnonzero(what == _WINDOW)
            if len(some):
                contents = np.frombuffer(b"".join(batch.column("words").take(pa.array(some)).to_pylist()), np.uint64)
                key = batch.column("key").to_numpy()[some]
                order = np.lexsort((contents, key))
                new = np.ones(len(order), bool)
                new[1:] = (key[order[1:]] != key[order[:-1]]) | (contents[order[1:]] != contents[order[:-1]])
                group = np.empty(len(order), np.int64)
                group[order] = np.cumsum(new) - 1
                found = some[(np.bincount(group, weights=weight[some])[group] > 1) & (weight[some] == 1)]
                hit, ahead, length = [*hit, found], [*ahead, lead[found]], [*length, np.full(len(found), window)]
            some = np.flatnonzero(what == _BLOCK)
            if len(some):
                blocks = batch.column("words").take(pa.array(some))
                counts = pc.binary_length(blocks).to_numpy() // 8
                table = wordhash.mix(np.arange(len(some) * width, dtype=np.uint64) + np.uint64(0x0DDBA11)).reshape(len(some), width)
                inside = (np.arange(width) >= (reach - lead[some])[:, None]) & (np.arange(width) < (reach - lead[some] + counts)[:, None])
                table[inside] = np.frombuffer(b"".join(blocks.to_pylist()), np.uint64)
                row, column, n = greedy_factors(table, weight[some] == 1, window)
                hit, ahead, length = [*hit, some[row]], [*ahead, reach - column], [*length, n]
            index, ahead, length = np.concatenate(hit), np.concatenate(ahead), np.concatenate(length)
            order = np.argsort(index, kind="stable")
            index, ahead, length = index[order], ahead[order], length[order]
            edges = np.searchsorted(index, np.append(np.unique(index), len(what))).astype(np.int32)
            spans = pa.StructArray.from_arrays([pa.array(ahead.astype(np.int32)), pa.array(length.astype(np.int32))], ["ahead", "n"])
            out = batch.select(["row", "at"]).take(pa.array(np.unique(index)))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.ListArray.from_arrays(pa.array(edges), spans)], ["row", "at", "spans"])

    lent = docs.select("row", "text").dropDuplicates(["row"]).join(asked.hint("shuffle_hash"), "row").select("row", "text", "asked", "copied")
    cuts = lent.mapInArrow(cut, f"key long, row {kind}, at int, kind byte, weight byte, ahead int, words binary")
    return cuts.repartition("key").sortWithinPartitions("key").mapInArrow(meet, f"row {kind}, at int, {_SPANS}")


_SPANS = "spans array<struct<ahead: int, n: int>>"


def _cut(docs: DataFrame, found: DataFrame | None, window: int, anchor: int, carry: tuple[str, ...]) -> DataFrame:
    """Merge factors (row, at, spans; null for a whole block, and the whole text for a negative place) into spans, and leave their words out. found None: there are none."""
    none = F.lit(None).cast("array<struct<at: int, spans: array<struct<ahead: int, n: int>>>>").alias("found")
    own = ["doc_id", *carry]
    spans_type = pa.list_(pa.struct([("first_word", pa.int32()), ("n_words", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in wordhash.slices(batch, "text"):
                offsets, words = wordhash.split(part.column("text"))
                n, lists = int(offsets[-1]), pc.fill_null(pc.list_value_length(part.column("found")), 0).to_numpy()
                rows, flat = np.repeat(np.arange(part.num_rows), lists), part.column("found").flatten()
                base, end = offsets[:-1][rows], offsets[1:][rows]
                place = flat.field("at").to_numpy().astype(np.int64)
                at, factors = place + base, flat.field("spans")
                none = pc.is_null(factors).to_numpy(zero_copy_only=False)
                whole, text = none & (place >= 0), none & (place < 0) & (end - base >= window)
                each, factors = pc.fill_null(pc.list_value_length(factors), 0).to_numpy(), factors.flatten()
                begin = np.repeat(at, each) - factors.field("ahead").to_numpy()
                starts = np.concatenate([np.maximum(base[whole], at[whole] - (window - anchor)), base[text], begin])
                ends = np.concatenate([np.minimum(end[whole], at[whole] + window), end[text], begin + factors.field("n").to_numpy()])
                depth = np.cumsum(np.bincount(starts, minlength=n + 1) - np.bincount(ends, minlength=n + 1))[:n]
                gone = depth > 0
                doc = wordhash.doc_of(offsets)
                # spans: maximal runs of removed words of a document
                opens = gone & np.concatenate([[True], ~gone[:-1] | (doc[1:] != doc[:-1])]) if n else gone
                closes = gone & np.concatenate([~gone[1:] | (doc[1:] != doc[:-1]), [True]]) if n else gone
                a, b = np.flatnonzero(opens), np.flatnonzero(closes) + 1
                of_doc = doc[a]
                spans = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(of_doc, np.arange(part.num_rows + 1)).astype(np.int32)),
                    pa.StructArray.from_arrays([pa.array((a - offsets[:-1][of_doc]).astype(np.int32)), pa.array((b - a).astype(np.int32))], ["first_word", "n_words"]),
                )
                left = np.concatenate([[0], np.cumsum(~gone)])[offsets]
                kept = pa.ListArray.from_arrays(pa.array(left.astype(np.int32)), words.filter(pa.array(~gone)).cast(pa.string()))
                total = np.diff(offsets)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in own), pc.binary_join(kept, " "), pa.array(total), pa.array(total - np.diff(left)), spans.cast(spans_type)],
                    [*own, "kept", "n_words", "n_removed", "spans"],
                )

    if found is None:
        joined = docs.select(*own, "text", none)
    else:
        marks = found.groupBy("row").agg(F.collect_set(F.struct("at", "spans")).alias("found"))
        joined = docs.join(marks.hint("shuffle_hash"), "row", "left").select(*own, "text", "found")
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in own)
    return joined.mapInArrow(run, f"{schema}, kept string, n_words long, n_removed long, spans array<struct<first_word: int, n_words: int>>")


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, carry: tuple[str, ...] = (), hot_at: int = HOT) -> DataFrame:
    """docs: doc_id, text and the columns to carry along. Returns doc_id, those, kept (the words left, joined by one space), n_words, n_removed and
    spans (array of first_word, n_words: the removed runs of words).
    """
    if not 0 < anchor <= window:
        raise ValueError("an anchor has at least one word and at most a window's")
    if {"row", "doc_id", "text", "found", "kept", "n_words", "n_removed", "spans"} & set(carry):
        raise ValueError("a column to carry has the name of one of the result's")
    keyed = docs.select(_row_key(), "doc_id", "text", *carry)
    shared = materialise(shared_blocks(keyed, window, anchor, hot_at), "blocks")
    copied = keyed.select("row").groupBy("row").agg(F.count("*").alias("n")).filter("n > 1").select("row")
    differing = shared.filter("ask > 0")
    checked = repeated_windows(mark_known(keyed, differing, "row").filter("known"), differing, copied, window, anchor)
    unspecified = F.lit(None).cast("array<struct<ahead: int, n: int>>").alias("spans")
    factors = shared.filter("ask = 0").select("row", "at", unspecified)
    found = materialise(factors.unionByName(copied.select("row", F.lit(-1).alias("at"), unspecified)).unionByName(checked), "factors")
    discard(shared)
    marked = mark_known(keyed, found, "row")
    return _cut(marked.filter("known"), found, window, anchor, carry).unionByName(_cut(marked.filter("not known"), None, window, anchor, carry))
