"""SimHash near-duplicates by a binary trie self-join.

Fingerprints that differ in at most ``bits`` bits agree on one of ``bits`` + 1 blocks. Each block's value is a
group; in a group, a binary trie over the fingerprints is joined with itself: pairs of nodes go down together,
count the bits in which their branches differ, and are dropped when the count exceeds the budget. Nodes that
are already linked throughout are not compared again, so dense groups are linked without listing their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from limnograph.llm.common import col, map_rows, partitions
from limnograph.session import checkpointed

BITS, WIDTH, SEED = 3, 64, 42
SHINGLE = 3
#: Groups with more fingerprints are cut again on the bits that their block has left over.
GROUP = 8_000
#: Node pairs that a task looks at together.
_PAIRS = 1 << 18


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits, each 1 if set in over half of the XXH64 (seed 42) of the word shingles; 0 without words.

    A-Z are lower-cased; words are what stands between ASCII white space.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    stops = np.cumsum(lengths + 1) - 1
    starts = stops - lengths
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    codes = np.fromiter(
        (digest(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), stops[-n:].tolist(), strict=True)), np.uint64, n)
    ones = np.zeros(WIDTH, np.int64)
    for i in range(0, n, 4096):  # a bounded matrix of bits
        ones += np.unpackbits(codes[i:i + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``simhash``, the fingerprint as a signed long; a NULL text counts as empty. No row is left out."""
    def make():
        return lambda texts: [[(f := simhash(t)) - (f >> 63 << 64) for t in texts]]

    return map_rows(docs, [text], "simhash long", make, keep)


class _Groups:
    """Disjoint sets over places 0 to n - 1; the smallest place names a set."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if np.array_equal(up, self.parent):
                return self.parent
            self.parent = up

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            root = self.roots()
            low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
            apart = low != high
            if not apart.any():
                return
            np.minimum.at(self.parent, high[apart], low[apart])
            a, b = a[apart], b[apart]


def trie_self_join(codes: np.ndarray, group: np.ndarray, bits: int = BITS) -> np.ndarray:
    """For each place of ``codes`` (uint64, sorted and distinct within each ``group``): the first place linked to it.

    A trie node is a range of sorted codes that agree on the bits above its level. The frontier of node pairs
    is worked off in blocks of bounded size, the deepest first.
    """
    n = len(codes)
    sets = _Groups(n)
    if n < 2:
        return sets.roots()
    edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    stops = np.concatenate([edges[1:], [n]])
    some = stops - edges > 1
    edges, stops = edges[some], stops[some]
    zero = np.zeros(len(edges), np.int64)
    stack = [np.stack([edges, stops, edges, stops, zero, zero + WIDTH - 1])] if len(edges) else []
    while stack:
        pairs = stack.pop()
        if pairs.shape[1] > _PAIRS:
            stack.append(pairs[:, _PAIRS:])
            pairs = pairs[:, :_PAIRS]
        root = sets.roots()
        # How far the set of a place goes on to the right of it.
        change = np.flatnonzero(root[1:] != root[:-1]) + 1
        until = np.concatenate([change, [n]])[np.searchsorted(change, np.arange(n), side="right")]
        a, a_stop, b, b_stop, differ, level = pairs
        linked = (root[a] == root[b]) & (until[a] >= a_stop) & (until[b] >= b_stop)
        pairs = pairs[:, ~linked]
        a, a_stop, b, b_stop, differ, level = pairs
        leaf = (a_stop - a == 1) & (b_stop - b == 1)
        apart = leaf & (a != b)
        if apart.any():
            x, y = a[apart], b[apart]
            near = np.bitwise_count(codes[x] ^ codes[y]) <= bits
            sets.link(x[near], y[near])
        inner = ~leaf
        # All bits left may differ and the pair still fits: link whole nodes without going down.
        whole = inner & (differ + level + 1 <= bits)
        if whole.any():
            for i in np.flatnonzero(whole):
                places = np.concatenate([np.arange(a[i], a_stop[i]), np.arange(b[i], b_stop[i])])
                sets.link(np.full(len(places), places.min()), places)
        inner &= ~whole
        if not inner.any():
            continue
        a, a_stop, b, b_stop, differ, level = pairs[:, inner]
        a_cut, b_cut = _split(codes, a, a_stop, level), _split(codes, b, b_stop, level)
        down = level - 1
        below = [
            np.stack([a, a_cut, b, b_cut, differ, down]),
            np.stack([a_cut, a_stop, b_cut, b_stop, differ, down]),
            np.stack([a, a_cut, b_cut, b_stop, differ + 1, down]),
            np.stack([a_cut, a_stop, b, b_cut, differ + 1, down])[:, a != b],  # of a node with itself, once
        ]
        below = np.concatenate(below, axis=1)
        kept = (below[0] < below[1]) & (below[2] < below[3]) & (below[4] <= bits)
        kept &= ~((below[0] == below[2]) & (below[1] - below[0] == 1))
        if kept.any():
            stack.append(below[:, kept])
    return sets.roots()


def _split(codes: np.ndarray, start: np.ndarray, stop: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Where the bit of ``level`` turns to 1 in each sorted range, by halving all ranges together."""
    low, high = start.copy(), stop.copy()
    level = level.astype(np.uint64)
    while True:
        open_ = low < high
        if not open_.any():
            return low
        middle = (low + high) // 2
        one = (codes[np.minimum(middle, len(codes) - 1)] >> level) & np.uint64(1) == 1
        high = np.where(open_ & one, middle, high)
        low = np.where(open_ & ~one, middle + 1, low)


def _blocks(free: list[int], bits: int) -> list[list[int]]:
    return [list(map(int, x)) for x in np.array_split(np.array(free), bits + 1)]


def _keyed(codes: DataFrame, key: list, blocks: list[list[int]]) -> DataFrame:
    """Each fingerprint once for every block, with the block's bits added to its key."""
    entries = []
    for i, places in enumerate(blocks):
        mask = sum(1 << p for p in places)
        mask -= mask >> 63 << 64
        entries.append(F.struct(F.lit(i).alias("block"), F.col("code").bitwiseAND(F.lit(mask).cast("long")).alias("value")))
    spread = codes.withColumn("e", F.explode(F.array(*entries)))
    return spread.select("code", F.xxhash64(*key, "e.block", "e.value").alias("key"), F.col("e.block").alias("block"))


def _local_links(keyed: DataFrame, bits: int) -> DataFrame:
    """(code, other) links of each group, a star for each set found there; the sorted rows of whole groups come by."""
    schema = StructType([StructField("code", LongType()), StructField("other", LongType())])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def links(keys: np.ndarray, signed: np.ndarray) -> Iterator[pa.RecordBatch]:
            codes = signed.view(np.uint64)
            _, group = np.unique(keys, return_inverse=True)
            order = np.lexsort((codes, group))
            codes, group, signed = codes[order], group[order], signed[order]
            first = trie_self_join(codes, group, bits)
            linked = np.flatnonzero(first != np.arange(len(first)))
            if len(linked):
                yield pa.RecordBatch.from_arrays([pa.array(signed[linked]), pa.array(signed[first[linked]])],
                                                 names=["code", "other"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)))
            if sum(len(x) for x, _ in held) < 50_000:
                continue
            keys, codes = (np.concatenate(x) for x in zip(*held, strict=True))
            ends = np.flatnonzero(keys != keys[-1])  # the last group may go on
            cut = int(ends[-1]) + 1 if len(ends) else 0
            if cut:
                yield from links(keys[:cut], codes[:cut])
            held = [(keys[cut:], codes[cut:])]
        if held:
            yield from links(*(np.concatenate(x) for x in zip(*held, strict=True)))

    parts = partitions(keyed.sparkSession)
    return keyed.select("key", "code").repartition(parts, "key").sortWithinPartitions("key", "code").mapInArrow(join, schema)


def links(codes: DataFrame, bits: int = BITS, group: int = GROUP) -> DataFrame:
    """(code, other) links that connect exactly the distinct fingerprints within ``bits`` of each other.

    A group with more than ``group`` fingerprints is not joined in one task: its fingerprints are keyed again
    on ``bits`` + 1 blocks of the bits that are still free, until groups are small or at most 2 * ``bits``
    bits are left, which bounds a group by itself. Pairs of a large group differ in free bits only, so no
    pair is lost.
    """
    found: list[DataFrame] = []
    # Work to do: fingerprints with the key of their group, by the bits that groups of this kind have left.
    todo: list[tuple[DataFrame, list[int]]] = [(codes.select("code", F.lit(0).cast("long").alias("key")), list(range(WIDTH)))]
    while todo:
        rows, free = todo.pop()
        blocks = _blocks(free, bits)
        keyed = checkpointed(_keyed(rows, ["key"], blocks))
        large = keyed.groupBy("key").count().where(F.col("count") > group).drop("count")
        n_large = large.count() if len(free) > 2 * bits else 0
        if not n_large:
            found.append(_local_links(keyed, bits))
            continue
        large = checkpointed(large)
        found.append(_local_links(keyed.join(large, "key", "left_anti"), bits))
        again = checkpointed(keyed.join(large, "key", "left_semi"))
        for i, places in enumerate(blocks):
            left = [p for p in free if p not in places]
            part = again.where(F.col("block") == i).select("code", "key")
            if part.take(1):
                todo.append((part, left))
    return reduce(DataFrame.unionByName, found).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(code, root): each linked fingerprint with the smallest fingerprint it is connected to.

    Alternating large-star and small-star steps (Kiveris et al., 2014): edges only, minimums by partial
    aggregation, a reliable checkpoint for each round, until all edges form stars.
    """
    edges = checkpointed(_directed(edges.select(F.col("code").alias("u"), F.col("other").alias("v"))))
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = _directed(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .unionByName(least.select("u", F.col("m").alias("v")))
        edges = checkpointed(_directed(small))
        # Done when no larger end is the smaller end of another edge and none has two.
        inner = edges.join(edges.select(F.col("u").alias("v")).distinct(), "v", "left_semi")
        twice = edges.groupBy("u").count().where("count > 1")
        if not inner.take(1) and not twice.take(1):
            return edges.select(F.col("u").alias("code"), F.col("v").alias("root"))


def _directed(edges: DataFrame) -> DataFrame:
    """Distinct edges from the larger to the smaller end."""
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = BITS) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` of every row of ``docs``.

    Rows with fingerprints within ``bits`` bits are linked; ``component_id`` is the smallest id reachable.
    NULL, empty and blank texts have fingerprint zero and are linked like any other. A NULL id is carried
    along and never names a component; a component of NULL ids only has a NULL ``component_id``. Repeated
    rows come out as often as they go in.
    """
    rows = checkpointed(fingerprints(docs.select(col(doc_id).cast("long").alias("doc_id"), col(text).cast("string").alias("text")),
                                     keep=["doc_id"]).select("doc_id", F.col("simhash").alias("code")))
    distinct = rows.groupBy("code").agg(F.min("doc_id").alias("least"))
    roots = components(links(distinct.select("code"), bits))
    named = distinct.join(roots, "code", "left").withColumn("root", F.coalesce("root", "code"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.select("code", "root").join(least, "root").select("code", "component_id")
    return rows.join(named, "code").select(
        "doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id")
