"""Near-duplicate embeddings by a forest of random-projection trees.

Equal vectors of one label are one class from the start. A tree halves the vectors again and again: each level
projects on a random direction, and a node sends what lies below its median one way and the rest the other; vectors
close to the median go both ways (spill), so near pairs are seldom parted. The trees are fitted on a bounded sample,
and every vector goes down all of them, as deep as the size of its own group (label and length) asks for. Vectors in
one leaf are compared in double precision. A pair that meets in several leaves counts in the first of them only, which
each side reads from its list of leaves; so links are counted without listing or shuffling pairs, and a leaf
hands on a star for each set of connected vectors.

Nothing caps a leaf: one that stays large (a dense group) is cut into chunks, and every pair of chunks is a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from limnograph.llm.common import col, partitions, slices
from limnograph.llm.simhash import components
from limnograph.session import checkpointed, written

LEAST = 0.93
#: Leaves hold about LEAF vectors; those with over CHUNK are compared chunk by chunk.
TREES, LEAF, CHUNK, SEED = 8, 512, 2_048, 11
#: Half the width in which a node sends vectors both ways, in units of 1 / sqrt(dimension).
SPILL = 0.12
#: Bound on the sample that places the splits, and how many levels have medians of their own.
SAMPLE, FITTED, DEEPEST = 20_000, 8, 48
_PLACES = 56
#: So many vector lengths get a forest; groups of any other are compared whole, chunk by chunk.
_LENGTHS = 1_000


@dataclass(frozen=True)
class Forest:
    """Random directions by tree and level, and the median of each node by tree, level and the first bits of its path."""

    dimension: int
    directions: np.ndarray
    medians: np.ndarray
    spill: float

    def leaves(self, unit: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of all leaves that each row reaches at its ``depth``; sorted. A leaf's first bits are its tree."""
        rows, found = [], []
        for t in range(len(self.directions)):
            row, path, left = np.arange(len(unit)), np.ones(len(unit), np.int64), depth.copy()
            for level in range(int(depth.max(initial=0)) + 1):
                done = left == 0
                rows.append(row[done])
                found.append(path[done] | t << _PLACES)
                row, path, left = row[~done], path[~done], left[~done] - 1
                if not len(row):
                    break
                side = unit[row] @ self.directions[t, level] - self.medians[t, level, self._node(path, level)]
                low, high = side < self.spill, side >= -self.spill
                row = np.concatenate([row[low], row[high]])
                path = np.concatenate([path[low] << 1, path[high] << 1 | 1])
                left = np.concatenate([left[low], left[high]])
        row, leaf = np.concatenate(rows), np.concatenate(found)
        order = np.lexsort((leaf, row))
        return row[order], leaf[order]

    @staticmethod
    def _node(path: np.ndarray, level: int) -> np.ndarray:
        """The place of a node's median: its path, or that of the last ancestor which has medians of its own."""
        top = min(level, FITTED)
        return (path >> (level - top)) - (1 << top)


def fit(sample: np.ndarray, levels: int, trees: int = TREES, spill: float = SPILL, seed: int = SEED) -> Forest:
    """A forest of ``levels`` levels over the unit vectors of ``sample``."""
    n, d = sample.shape
    rng = np.random.default_rng([seed, d])
    directions = rng.standard_normal((trees, levels, d))
    directions /= np.linalg.norm(directions, axis=2, keepdims=True)
    medians = np.zeros((trees, levels, 1 << FITTED))
    for t in range(trees):
        path = np.ones(n, np.int64)
        for level in range(levels):
            side = sample @ directions[t, level]
            top = min(level, FITTED)
            node = Forest._node(path, level)
            middle = np.full(1 << top, np.median(side) if n else 0.0)
            for k in np.unique(node):
                middle[k] = np.median(side[node == k])
            medians[t, level, :1 << top] = middle
            path = path << 1 | (side >= middle[node])
    return Forest(d, directions, medians, spill / math.sqrt(max(1, d)))


def unit_rows(vectors: pa.Array, dimension: int) -> np.ndarray:
    """Vectors in double precision, brought to length 1; scaled first, so that no length overflows or vanishes."""
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), dimension)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _depth(n: Column, leaf: int) -> Column:
    """Levels that cut ``n`` vectors into leaves of about ``leaf``."""
    return F.least(F.greatest(F.ceil(F.log2(n / F.lit(float(leaf)))), F.lit(0)), F.lit(DEEPEST)).cast("int")


def _forests(classes: DataFrame, groups: DataFrame, trees: int, spill: float) -> dict[int, Forest]:
    """A forest for each vector length that has a group to cut, fitted on about ``SAMPLE`` vectors of all lengths."""
    cut = groups.where("depth > 0").groupBy("size").agg(F.max("depth").alias("depth"), F.sum("members").alias("members")) \
        .orderBy("size").limit(_LENGTHS).collect()
    deep = {r.size: r.depth for r in cut}
    if not deep:
        return {}
    # Digests make a fair draw, the same however the rows are dealt out.
    share = min(1.0, SAMPLE / sum(r.members for r in cut))
    drawn = classes.where(F.col("size").isin(list(deep)) & (F.pmod("h1", F.lit(1 << 40)) < int(share * (1 << 40)))).select("size", "vector").collect()
    forests = {}
    for size, depth in deep.items():
        own = [r.vector for r in drawn if r.size == size]
        sample = unit_rows(pa.array(own, pa.list_(pa.float64())), size) if own else np.zeros((0, size))
        forests[size] = fit(sample, depth, trees, spill)
    return forests


def _with_leaves(classes: DataFrame, forests: dict[int, Forest]) -> DataFrame:
    """``classes`` with the sorted list of their leaves; a class whose group is not cut has one leaf."""
    schema = StructType([*classes.schema.fields, StructField("leaves", ArrayType(LongType()))])
    names, shared = schema.names, classes.sparkSession.sparkContext.broadcast(forests)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                size, depth = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("size", "depth"))
                row, leaf = [np.flatnonzero(depth == 0)], [np.ones(int((depth == 0).sum()), np.int64)]
                for d in np.unique(size[depth > 0]):
                    own = np.flatnonzero((size == d) & (depth > 0))
                    if int(d) not in shared.value:
                        row.append(own)
                        leaf.append(np.ones(len(own), np.int64))
                        continue
                    r, found = shared.value[int(d)].leaves(unit_rows(batch.column("vector").take(pa.array(own)), int(d)), depth[own].astype(np.int64))
                    row.append(own[r])
                    leaf.append(found)
                row, leaf = np.concatenate(row), np.concatenate(leaf)
                order = np.argsort(row, kind="stable")
                ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=batch.num_rows))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(leaf[order]))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=names)

    return classes.mapInArrow(run, schema)


def _met_before(lists: pa.Array, leaf: int) -> np.ndarray:
    """Which pairs of rows share a leaf that comes before ``leaf`` in their lists."""
    n = len(lists)
    row = np.repeat(np.arange(n), lists.value_lengths().to_numpy(zero_copy_only=False))
    every = lists.flatten().to_numpy(zero_copy_only=False)
    row, every = row[every < leaf], every[every < leaf]
    known, place, often = np.unique(every, return_inverse=True, return_counts=True)
    new = np.cumsum(often > 1) - 1
    row, place = row[often[place] > 1], new[place[often[place] > 1]]
    met = np.zeros((n, n), bool)
    for i in range(0, int((often > 1).sum()), 1_024):  # a bounded matrix of rows and leaves
        some = (place >= i) & (place < i + 1_024)
        inside = np.zeros((n, 1_024), np.float32)
        inside[row[some], place[some] - i] = 1
        met |= (inside @ inside.T) > 0
    return met


def compare(unit: np.ndarray, chunk: np.ndarray, both: bool, weight: np.ndarray, lists: pa.Array, leaf: int, least: float
            ) -> tuple[np.ndarray, np.ndarray]:
    """For each row of a leaf: the weight of the rows that it is linked to here first, and the first row connected to it.

    ``both``: the rows are of two chunks, and only pairs across them are compared.
    """
    n = len(unit)
    near = np.zeros((n, n), bool)
    for i in range(0, n, 512):
        near[i:i + 512] = unit[i:i + 512] @ unit.T >= least
    near &= chunk[:, None] != chunk if both else ~np.eye(n, dtype=bool)
    near |= near.T
    some = np.flatnonzero(near.any(axis=1))
    gained, first = np.zeros(n, np.int64), np.arange(n)
    if not len(some):
        return gained, first
    near = near[np.ix_(some, some)]
    counted = near & ~_met_before(lists.take(pa.array(some)), leaf)
    for i in range(0, len(some), 512):
        gained[some[i:i + 512]] = (counted[i:i + 512] * weight[some]).sum(axis=1)
    root = np.arange(len(some))
    while True:  # the smallest place among the neighbours, then that place's own, until nothing changes
        least_near = np.minimum(root, np.where(near, root, len(some)).min(axis=1))
        least_near = least_near[least_near]
        if np.array_equal(least_near, root):
            break
        root = least_near
    first[some] = some[root]
    return gained, first


def _linked(met: DataFrame, least: float) -> DataFrame:
    """(cid, links, other) from leaves and pairs of chunks: ``met`` is sorted so that each comes whole."""
    schema = StructType([StructField(c, LongType()) for c in ("cid", "links", "other")])
    arrow = to_arrow_schema(schema)

    def judged(group: pa.Table) -> Iterator[pa.RecordBatch]:
        group = group.combine_chunks()
        head = group.slice(0, 1).to_pylist()[0]
        vectors = group.column("vector").combine_chunks()
        cid = group.column("cid").to_numpy()
        gained, first = compare(unit_rows(vectors, head["size"]), group.column("chunk").to_numpy(), head["low"] != head["high"],
                                group.column("n").to_numpy(), group.column("leaves").combine_chunks(), head["leaf"], least)
        some = np.flatnonzero((gained > 0) | (first != np.arange(len(first))))
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(cid[some]), pa.array(gained[some]), pa.array(cid[first[some]])], names=arrow.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for whole in batches:
            for batch in slices(whole):
                key = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("label", "leaf", "low", "high")]
                cuts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1
                for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                    part = batch.slice(a, b - a)
                    if held and any(held[-1].column(c)[0] != part.column(c)[0] for c in ("label", "leaf", "low", "high")):
                        yield from judged(pa.Table.from_batches(held))
                        held = []
                    held.append(part)
        if held:
            yield from judged(pa.Table.from_batches(held))

    return met.mapInArrow(run, schema)


def near_embeddings(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = LEAST,
                    trees: int = TREES, leaf: int = LEAF, chunk: int = CHUNK, spill: float = SPILL) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` for every row of ``vectors``.

    Rows are linked when their labels are equal and not NULL, their vectors are equally long and the cosine is at
    least ``least``; vectors that are NULL, empty or zero or hold NULL or non-finite components link with nothing and
    are components of their own. Repeated rows count one by one, equal ids included. A row without an id is
    linked like any other but never names a component, and ``kept`` is true for it only where no linked row has an id.
    """
    x = F.col("vector")
    finite = F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < float("inf")))
    rows = vectors.select(col(vec_id).cast("long").alias("vec_id"), col(label).alias("label"), col(vector).alias("vector")) \
        .withColumn("valid", F.coalesce(F.col("label").isNotNull() & finite & F.exists(x, lambda v: v != 0), F.lit(False)))
    alone = rows.where(~F.col("valid")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                                               F.lit(True).alias("kept"))
    digests = [F.xxhash64(F.lit(i), "label", "vector").alias(f"h{i}") for i in (1, 2)]
    rows = rows.where("valid").select("vec_id", "label", "vector", *digests)
    classes = rows.groupBy("h1", "h2").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("vector").alias("vector"),
                                           F.first("label").alias("label")).withColumn("size", F.size("vector"))
    classes = checkpointed(classes.withColumn("cid", F.monotonically_increasing_id()))
    groups = classes.groupBy("label", "size").agg(F.count("*").alias("members")).withColumn("depth", _depth(F.col("members"), leaf))
    sized = classes.join(groups.drop("members"), ["label", "size"])
    placed = checkpointed(_with_leaves(sized.select("label", "size", "cid", "n", "vector", "depth"), _forests(classes, groups, trees, spill)))
    # Leaves that stay large are cut into chunks; the key of each pair of chunks is a task.
    leaves = placed.select("label", "size", F.explode("leaves").alias("leaf"))
    large = leaves.groupBy("label", "size", "leaf").agg(F.count("*").alias("members")).where(F.col("members") > chunk) \
        .select("label", "size", "leaf", F.ceil(2 * F.col("members") / F.lit(chunk)).cast("int").alias("chunks"))
    large, _ = written(large, "forest-large")  # as a table its size is known, and few rows or none are not worth a shuffle of the vectors
    met = placed.withColumn("leaf", F.explode("leaves")).join(large, ["label", "size", "leaf"], "left") \
        .withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn("chunk", F.pmod(F.xxhash64("cid"), F.col("chunks")).cast("int")) \
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    met = met.select("label", "size", "leaf", F.least("chunk", "with").alias("low"), F.greatest("chunk", "with").alias("high"),
                     "chunk", "cid", "n", "vector", "leaves")
    key = ["label", "size", "leaf", "low", "high"]
    found = checkpointed(_linked(met.repartition(partitions(vectors.sparkSession), *key).sortWithinPartitions(*key, "cid"), least))
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    roots = components(found.where("cid <> other").select(F.col("cid").alias("code"), "other"))
    named = classes.select("cid", "h1", "h2", "least", "n").join(links, "cid", "left") \
        .join(roots.withColumnRenamed("code", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(names, "root").select("h1", "h2", "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    near = rows.select("vec_id", "h1", "h2").join(named, ["h1", "h2"]) \
        .select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
    return near.unionByName(alone)
