"""Exact n-gram Jaccard join of a collection with itself by prefix trees.

A document's set holds 64-bit hashes of its distinct n-grams. Their global order puts n-grams last that stand in many documents, the most
frequent at the end, and goes by hash otherwise; it steers the load, and any order gives the same result. Frequencies are counted over all
documents, as repeats within runs of ``RUN`` n-grams; the ``COMMON`` most frequent n-grams are told apart.

1. Documents with equal sets are one node; only nodes are joined.
2. *Meeting.* Sets of a similarity t share an n-gram among the first n - ceil(t n) + 1 of each. Nodes that share such an n-gram meet there and
   form a star about one of them, if their sizes follow each other closely enough; stars about the same node are one. N-grams known to be hot are
   stars themselves, so their nodes need not come together in one task.
3. *First traversal.* Each node goes to the largest of its stars. Stars are cut into blocks of at most about ``block`` nodes or as many n-grams as
   1024 times that, and one node of the star, its representative, goes to every block. Nodes come as sketches first (n-grams counted by range, which
   bound an overlap); those that may link with another of their block send their text, once. A block's sets, cut into ranges of hashes, form a trie whose
   edges are range contents; it is traversed with itself from range to range. A pair of subtrees carries the overlap of its two prefixes,
   counted once for all pairs of sets below, and is pruned when that overlap and all that remains cannot reach what the smallest sets below need.
4. *Second traversal.* Where a star still holds nodes of several components, those outside its largest component are compared with all of the star's other
   components in the same way: by sketches, and what the sketches leave by the tries of the two sides.
5. Links are thinned to a spanning forest in each unit of work, and components are found over all units.

Near copies by the thousand thus never become rows of pairs, and their texts are sent once; a unit of work holds at most two blocks.

Sets are compared as sets of hashes, and documents are one node by a hash of the whole set: 64 bits each, so of 10**10 distinct sets about three
pairs can be expected to be taken for one.

Defined results: texts without words (and null) have an empty set and link with nothing; texts with fewer words than n have
one n-gram, the whole sequence. Repeated rows and rows with equal sets share a component; component_id is the least
non-null doc_id in it. Empty tables give empty tables; extra columns are ignored. One text's set is held whole by a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.llm import wordhash
from reelspark.llm.common import discard, mark_known, materialise
from reelspark.llm.components import components

BLOCK = 512
#: N-grams among which repeats are counted at a time, the most that are told apart, and the count from which an n-gram is a star itself.
RUN, COMMON, HOT = 1 << 21, 1 << 20, 10_000
#: N-grams that count as much as one more node when blocks are filled.
_NODE = 1024
_U = np.uint64


def ngram_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text, letters A-Z lower-cased."""
    offsets, words = wordhash.split(texts, lower=True)
    sequence = wordhash.Sequences(wordhash.hashes(words))
    total = int(offsets[-1])
    at = np.arange(total)
    last = offsets[1:][wordhash.doc_of(offsets)]
    grams = sequence.of(at, np.minimum(at + n, last))
    out = []
    for a, b in zip(offsets, offsets[1:], strict=False):
        out.append(np.unique(grams[a : max(b - n + 1, a + 1)]) if b > a else grams[:0])
    return out


def _node(grams: np.ndarray) -> int:
    """A set's own number: a hash of all its members and of how many there are."""
    total = np.sum(wordhash.mix(grams ^ _U(0x5851F42D4C957F2D)), dtype=_U)
    return int(wordhash.mix(np.array([total + _U(len(grams))]))[0].view(np.int64))


def _range_of(grams: np.ndarray, ranges: int) -> np.ndarray:
    return ((grams >> _U(32)) * _U(ranges)) >> _U(32)


class Order:
    """The global order: known n-grams and their counts, in any order; all others go first."""

    def __init__(self, grams: np.ndarray, times: np.ndarray):
        rank = np.empty(len(grams), np.int32)
        rank[np.lexsort((grams, times))] = np.arange(1, len(grams) + 1)
        by_gram = np.argsort(grams)
        self.grams, self.rank, self.times = grams[by_gram], rank[by_gram], times[by_gram]

    def places(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and count of each n-gram, 0 if unknown."""
        if not len(self.grams):
            return np.zeros(len(grams), np.int32), np.zeros(len(grams), np.int64)
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        known = self.grams[at] == grams
        return np.where(known, self.rank[at], 0), np.where(known, self.times[at], 0)


def prefixes(sets: list[np.ndarray], order: Order, num: int, den: int) -> list[np.ndarray]:
    """The n-grams by which each set can meet others."""
    rank, _ = order.places(np.concatenate([np.zeros(0, _U), *sets]))
    out, b = [], 0
    for s in sets:
        a, b = b, b + len(s)
        first = len(s) - -(-num * len(s) // den) + 1
        out.append(s[np.argsort(rank[a:b], kind="stable")[:first]])
    return out


def sketch(grams: np.ndarray) -> bytes:
    """How many n-grams fall into each of 8 to 512 equal ranges of hashes, about 8 each; empty if a count exceeds a byte."""
    ranges = 1 << min(9, max(3, (len(grams) >> 3).bit_length()))
    counts = np.bincount(_range_of(grams, ranges).astype(np.int64), minlength=ranges)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def may_link(a_size: np.ndarray, a_group: np.ndarray, a_sketch: list[bytes], b_size: np.ndarray, b_group: np.ndarray, b_sketch: list[bytes], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a have one of b (and the other way round) in another group that they may link with, by size and sketch."""
    length = np.array([len(x) for x in b_sketch])
    kinds = {}
    for k in np.unique(length).tolist():
        rows = np.flatnonzero(length == k)
        rows = rows[np.argsort(b_size[rows], kind="stable")]
        kinds[k] = rows, b_size[rows], np.frombuffer(b"".join(b_sketch[i] for i in rows.tolist()), np.uint8).reshape(len(rows), k)
    in_a, in_b = np.zeros(len(a_size), bool), np.zeros(len(b_size), bool)
    for i, (size, group, own) in enumerate(zip(a_size.tolist(), a_group.tolist(), a_sketch, strict=True)):
        for k, (rows, sizes, table) in kinds.items():
            lo, hi = np.searchsorted(sizes, -(-num * size // den)), np.searchsorted(sizes, den * size // num, "right")
            some = np.arange(lo, hi)[b_group[rows[lo:hi]] != group]
            if k and own and len(some):
                r = min(k, len(own))
                mine = np.frombuffer(own, np.uint8).reshape(r, -1).sum(axis=1)
                theirs = table[some].reshape(len(some), r, -1).sum(axis=2)
                most = np.minimum(mine, theirs).sum(axis=1).astype(np.int64)
                some = some[most * (den + num) >= num * (size + sizes[some])]
            in_a[i] |= len(some) > 0
            in_b[rows[some]] = True
    return in_a, in_b


def _linked(a: list[np.ndarray], b: list[np.ndarray] | None, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of sets a[i], b[j] that reach the threshold; without b, pairs i < j of a. Both tries are
    traversed together, range by range; see the module's text.
    """
    sets = a + (b or [])
    size = np.array([len(s) for s in sets], np.int64)
    levels = int(max(1, min(64, size.max() // 8)))
    grams, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    level = _range_of(grams, levels).astype(np.int64)
    split = np.searchsorted(level, np.arange(levels + 1))
    new = np.concatenate([[True], grams[1:] != grams[:-1]])
    # A trie's nodes at a level are the distinct contents so far; each has the sizes of the sets below it.
    n_a = len(a)
    side_a, side_b = np.arange(n_a), np.arange(n_a, len(sets)) if b is not None else np.arange(n_a)
    trie = np.zeros(len(sets), np.int64)  # node of each set
    used = np.zeros(len(sets), np.int64)
    u, v, common = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64)
    for k in range(levels):
        g, o = np.cumsum(new[split[k] : split[k + 1]]) - 1, owner[split[k] : split[k + 1]]
        # edge labels: distinct contents of this range
        mark = wordhash.mix(np.arange(len(g), dtype=_U)[np.searchsorted(g, np.arange(g[-1] + 1))] + _U(1)) if len(g) else np.zeros(0, _U)
        sums = np.zeros(len(sets), _U)
        np.add.at(sums, o, mark[g])
        used += np.bincount(o, minlength=len(sets))
        _, first, label = np.unique(sums, return_index=True, return_inverse=True)
        one = first[label[o]] == o  # one set stands for all with its content
        row, column = label[o[one]], g[one]
        times = np.bincount(column, minlength=1)
        shared = times[column] > 1  # n-grams of one content alone count for no pair
        table = np.zeros((len(first), int((times > 1).sum())), np.float32)
        table[row[shared], (np.cumsum(times > 1) - 1)[column[shared]]] = 1
        overlap = (table @ table.T).astype(np.int64)
        np.fill_diagonal(overlap, np.bincount(row, minlength=len(first)))
        # children of each node: pairs (node, label)
        step = trie * len(first) + label
        kids, kid_first, child = np.unique(step, return_index=True, return_inverse=True)
        parent_of, label_of = trie[kid_first], label[kid_first]
        least, most_left = np.full(len(kids), 1 << 40), np.zeros(len(kids), np.int64)
        np.minimum.at(least, child, size)
        np.maximum.at(most_left, child, size - used)
        has_a, has_b = np.zeros(len(kids), bool), np.zeros(len(kids), bool)
        has_a[child[side_a]] = True
        has_b[child[side_b]] = True
        kids_a, kids_b = np.flatnonzero(has_a), np.flatnonzero(has_b)  # sorted by parent
        a0, a1 = np.searchsorted(parent_of[kids_a], u), np.searchsorted(parent_of[kids_a], u, "right")
        b0, b1 = np.searchsorted(parent_of[kids_b], v), np.searchsorted(parent_of[kids_b], v, "right")
        each = (a1 - a0) * (b1 - b0)
        nth = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        wide = np.repeat(b1 - b0, each)
        nu = kids_a[np.repeat(a0, each) + nth // wide] if len(wide) else kids_a[:0]
        nv = kids_b[np.repeat(b0, each) + nth % wide] if len(wide) else kids_b[:0]
        common = np.repeat(common, each) + overlap[label_of[nu], label_of[nv]]
        reach = common + np.minimum(most_left[nu], most_left[nv])
        alive = reach * (den + num) >= num * (least[nu] + least[nv])
        if b is None:
            alive &= nu <= nv
        u, v, common, trie = nu[alive], nv[alive], common[alive], child
    # leaves: nodes are distinct sets, so a leaf of a side is one set (or two equal ones, one of each side)
    leaf_a, leaf_b = np.full(trie.max() + 1, -1), np.full(trie.max() + 1, -1)
    leaf_a[trie[side_a]] = side_a
    leaf_b[trie[side_b]] = side_b
    i, j = leaf_a[u], leaf_b[v]
    hit = (common * (den + num) >= num * (size[i] + size[j])) & (i != j)
    return i[hit], j[hit]


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least reachable number for each of n."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = np.minimum(label, label[label])
        if (label == before).all():
            break
    return label


def _order(repeats: DataFrame, most: int) -> Order:
    """The most frequent n-grams (at most ``most``) of repeats: gram, times."""
    counts = materialise(repeats.groupBy("gram").agg(F.sum("times").alias("times")), "counts")
    level = F.floor(F.log2("times") * 8)
    levels = counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect()  # a few hundred rows
    least, total = None, 0
    for r in levels:
        total += r["count"]
        if total > most:
            break
        least = r["level"]
    found = counts.filter(level >= least if least is not None else F.lit(False)).toArrow()
    discard(counts)
    return Order(found.column("gram").to_numpy().view(_U), found.column("times").to_numpy())


def _lend(base: DataFrame, rows: DataFrame) -> DataFrame:
    """Add text to rows (text_key and others), from base (text_key, text)."""
    asked = mark_known(base, rows.select("text_key"), "text_key").filter("known").select("text_key", "text")
    return rows.join(asked.dropDuplicates(["text_key"]).hint("shuffle_hash"), "text_key").drop("text_key")


def similarity_components(docs: DataFrame, n: int, num: int, den: int, block: int = BLOCK, hot: int = HOT, common: int = COMMON) -> DataFrame:
    """docs: doc_id, text. Documents link at a Jaccard similarity of num / den or more of their n-gram sets.

    Returns doc_id, n_shingles (size of the set), component_id; a row for each row of docs.
    """
    if not 0 < num <= den:
        raise ValueError("the threshold is a fraction above 0 and up to 1")
    id_kind = docs.schema["doc_id"].dataType.simpleString()
    base = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document, and rows (gram, times) for the n-grams that a run of sets repeats."""
        names = ["doc_id", "n_shingles", "node", "text_key", "sketch", "gram", "times"]
        run: list[np.ndarray] = []

        def repeats(doc_id_type: pa.DataType) -> pa.RecordBatch:
            gram, times = np.unique(np.concatenate(run), return_counts=True)
            run.clear()
            gram, times = gram[times > 1], times[times > 1]
            empty = [pa.nulls(len(gram), t) for t in (doc_id_type, pa.int64(), pa.int64(), pa.int64(), pa.binary())]
            return pa.RecordBatch.from_arrays([*empty, pa.array(gram.view(np.int64)), pa.array(times)], names)

        kind = None
        for batch in batches:
            for part in wordhash.slices(batch, "text"):
                sets, kind = ngram_sets(part.column("text"), n), part.column("doc_id").type
                full = [len(s) > 0 for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([_node(s) if f else None for s, f in zip(sets, full, strict=True)], pa.int64()),
                        part.column("text_key"),
                        pa.array([sketch(s) if f else None for s, f in zip(sets, full, strict=True)], pa.binary()),
                        pa.nulls(len(sets), pa.int64()),
                        pa.nulls(len(sets), pa.int64()),
                    ],
                    names,
                )
                run += sets
                if sum(map(len, run)) >= RUN:
                    yield repeats(kind)
        if run:
            yield repeats(kind)

    described = materialise(base.mapInArrow(describe, f"doc_id {id_kind}, n_shingles long, node long, text_key long, sketch binary, gram long, times long"), "sets")
    nodes = described.filter("n_shingles is not null").select("doc_id", "n_shingles", "node", "text_key", "sketch")
    order = _order(described.filter("gram is not null").select("gram", "times"), common)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in wordhash.slices(batch, "text"):
                found = {_node(s): s for s in ngram_sets(part.column("text"), n) if len(s)}  # copies in a batch are one row
                points = prefixes(list(found.values()), order, num, den)
                each = [len(p) for p in points]
                point = np.concatenate([np.zeros(0, _U), *points])
                node = np.repeat(np.array(list(found), np.int64), each)
                size = np.repeat(np.array([len(s) for s in found.values()], np.int64), each)
                yield pa.RecordBatch.from_arrays([pa.array(point.view(np.int64)), pa.array(size), pa.array(node), pa.array(order.places(point)[1] >= hot)], ["point", "size", "node", "hot"])

    def hang(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Hang the nodes of a point on one of them, those of a hot one on the point; rows come sorted by point, size and node.

        Where a size is too small for the next one, no set before can link with one after, so a new star begins.
        """
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            point, size, node = (batch.column(c).to_numpy() for c in ("point", "size", "node"))
            is_hot = batch.column("hot").to_numpy(zero_copy_only=False)
            before = np.concatenate([[last[0] if last else ~point[0]], point[:-1]]), np.concatenate([[last[1] if last else 0], size[:-1]])
            new = (point != before[0]) | (before[1] * den < num * size)
            first = np.maximum.accumulate(np.where(new, np.arange(len(point)), -1))
            least = np.where(first >= 0, node[np.maximum(first, 0)], last[2] if last else 0)
            last = (point[-1], size[-1], least[-1])
            star = np.where(is_hot, wordhash.mix(point.view(_U)).view(np.int64), least)
            other = is_hot | (node != least)
            pairs = np.unique(np.concatenate([np.stack([star[other], node[other]]), np.stack([least[other & ~is_hot]] * 2)], axis=1), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["star", "node"])

    points = base.select("text").mapInArrow(meet, "point long, size long, node long, hot boolean")
    dealt = points.repartition("point", F.when(F.col("hot"), F.pmod("node", F.lit(256))).otherwise(0)).sortWithinPartitions("point", "size", "node")
    stars = materialise(dealt.mapInArrow(hang, "star long, node long").distinct(), "stars")
    known = mark_known(nodes.filter("node is not null"), stars.select("node"), "node").filter("known")
    met = known.groupBy("node").agg(F.first("n_shingles").alias("size"), F.min("text_key").alias("text_key"), F.first("sketch").alias("sketch"))
    met = materialise(met, "met")
    texts = base.select("text_key", "text")
    weight = F.col("size") + _NODE

    def units_of(rows: Column) -> Column:
        return F.greatest(F.ceil(rows / F.lit(block * _NODE)), F.lit(1)).cast("int")

    def links(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
        """Links of each unit of work; its rows (keys, side, node, text) follow each other. Without a second side all are compared."""

        def of(sides: tuple[dict[int, np.ndarray], dict[int, np.ndarray]]) -> pa.RecordBatch:
            names = np.array([*sides[0], *sides[1]], np.int64)
            a, b = (list(s.values()) for s in sides)
            i, j = _linked(a, b or None, num, den)
            label = _forest(len(names), i, j)
            hung = label != np.arange(len(names))
            return pa.RecordBatch.from_arrays([pa.array(names[hung]), pa.array(names[label[hung]])], ["a", "b"])

        unit, sides = None, ({}, {})
        for batch in batches:
            for part in wordhash.slices(batch, "text"):
                rows = zip(*(part.column(c).to_pylist() for c in keys), strict=True)
                for key, side, node, s in zip(rows, part.column("side").to_pylist(), part.column("node").to_pylist(), ngram_sets(part.column("text"), n), strict=True):
                    if key != unit:
                        if sides[0] and len(sides[0]) + len(sides[1]) > 1:
                            yield of(sides)
                        unit, sides = key, ({}, {})
                    if len(s) and _node(s) == node:
                        sides[side][node] = s
        if sides[0] and len(sides[0]) + len(sides[1]) > 1:
            yield of(sides)

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of a unit that may link with one of its other side, or of the same side if there is no other."""

        def left(rows: pa.RecordBatch) -> pa.RecordBatch:
            side = rows.column("side").to_numpy()
            of_side = [rows.filter(pa.array(side == k)) for k in (0, 1)]
            sizes = [[x.column("size").to_numpy(), x.column("own").to_numpy(), x.column("sketch").to_pylist()] for x in of_side]
            stay = np.zeros(len(side), bool)
            if side.any():
                stay[side == 0], stay[side == 1] = may_link(*sizes[0], *sizes[1], num, den)
            else:
                stay |= may_link(*sizes[0], *sizes[0], num, den)[0]
            return rows.filter(pa.array(stay)).select(["star", "x", "y", "side", "node", "text_key"])

        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch if rest is None else pa.concat_batches([rest, batch])
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("star", "x", "y")])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist()]
            for a, b in zip(cuts, cuts[1:], strict=False):
                yield left(batch.slice(a, b - a))
            rest = batch.slice(cuts[-1])
        if rest is not None:
            yield left(rest)

    def traverse(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """What the sketches leave of rows (star, x, y, side, node, own, size, text_key, sketch), and its links."""
        dealt = rows.repartition("star", "x", "y").sortWithinPartitions("star", "x", "y", "side", "node")
        kept = materialise(dealt.mapInArrow(narrow, "star long, x int, y int, side int, node long, text_key long"), "kept")
        units = _lend(texts, kept).repartition("star", "x", "y").sortWithinPartitions("star", "x", "y", "side", "node")
        return kept, units.mapInArrow(lambda batches: links(batches, ("star", "x", "y")), "a long, b long")

    # First traversal: each node in the largest of its stars, with the star's representative.
    per_star = stars.groupBy("star").agg(F.count("*").alias("n"))
    choice = stars.join(per_star, "star").groupBy("node").agg(F.max(F.struct("n", "star")).alias("x")).select("node", "x.star")
    chosen = materialise(choice.join(met, "node"), "chosen")
    cut = chosen.groupBy("star").agg(F.count("*").alias("n"), units_of(F.sum(weight)).alias("blocks"), F.min(F.struct("size", "node")).alias("one")).filter("n > 1")
    rows = chosen.join(cut.select("star", "blocks"), "star").withColumn("x", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    ones = cut.filter("blocks > 1").select("star", "blocks", "one.node").join(met, "node").withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    ones = ones.filter(F.col("x") != F.pmod(F.xxhash64("node"), F.col("blocks")))
    first = ["star", "x", F.lit(0).alias("y"), F.lit(0).alias("side"), "node", F.col("node").alias("own"), "size", "text_key", "sketch"]
    sent, near = traverse(rows.select(*first).unionByName(ones.select(*first)))
    near = materialise(near, "near")
    discard(chosen, sent)
    groups = components(near)

    # Second traversal: what lies outside a star's largest component against its other components.
    labelled = stars.join(groups, "node", "left").select("star", "node", F.coalesce("component", "node").alias("own"))
    mixed = labelled.groupBy("star").agg(F.min("own").alias("low"), F.max("own").alias("high")).filter("low != high").select("star")
    held = materialise(labelled.join(mixed, "star").join(met, "node"), "held")
    largest = held.groupBy("star", "own").agg(F.count("*").alias("n")).groupBy("star").agg(F.max_by("own", F.struct("n", "own")).alias("largest"))
    minor = F.col("own") != F.col("largest")
    sizes = held.join(largest, "star").groupBy("star").agg(F.first("largest").alias("largest"), units_of(F.sum(F.when(minor, weight))).alias("few"), units_of(F.sum(weight)).alias("all"))
    rows = held.join(sizes, "star").withColumn("at", F.xxhash64("node"))

    def sides(side: int, own: str, other: str) -> DataFrame:
        some = rows.filter(minor) if side == 0 else rows
        place = F.pmod("at", F.col(own)).cast("int")
        everywhere = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        x, y = (place, everywhere) if side == 0 else (everywhere, place)
        return some.select("star", x.alias("x"), y.alias("y"), F.lit(side).alias("side"), "node", "own", "size", "text_key", "sketch")

    kept, found = traverse(sides(0, "few", "all").unionByName(sides(1, "all", "few")))
    label = groups.select("node", "component")
    a, b = (label.select(F.col("node").alias(c), F.col("component").alias(f"{c}_")) for c in ("a", "b"))
    between = found.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("a_", "a").alias("a"), F.coalesce("b_", "b").alias("b"))
    joined = components(between)
    discard(stars, met, near, held, kept)

    # The least doc_id of a component, over all documents of its nodes.
    of_node = nodes.groupBy("node").agg(F.min("doc_id").alias("first_id")).filter("node is not null")
    named = of_node.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = named.join(joined.select(F.col("node").alias("component"), F.col("component").alias("whole")), "component", "left").withColumn("component", F.coalesce("whole", "component"))
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    labels = named.join(least, "component").select("node", "component_id")
    return nodes.join(labels, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
