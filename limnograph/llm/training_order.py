"""Token sequences written in training order.

Texts become token ids, cut into sequences of fixed length. A keyed Feistel permutation with cycle-walking
moves every sequence number to a place in the same domain; equal ranges of places are the shards, and a
sequence's global slot is its rank by place. Shards hold records of one fixed size, so a reader goes to any
slot by arithmetic and reads on from there.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from limnograph.llm.common import col, slices
from limnograph.llm.files import write_whole
from limnograph.session import scratch_path

#: Ranks of the public tokenizer; never copied, always a parameter.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How byte-level vocabularies of this kind split text before merging; a fixed value that must match them.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END_OF_TEXT = 50256
#: Places are numbers of at most so many bits.
_DOMAIN_BITS = 60


@dataclass(frozen=True)
class Layout:
    """Tokens of a sequence, key of the order, and bytes that a shard should have."""

    length: int = 512
    key: int = 20_240_229
    rounds: int = 6
    shard_bytes: int = 16 << 20

    @property
    def record(self) -> np.dtype:
        """One record: document, number of the sequence in it, tokens in use, and the tokens."""
        return np.dtype([("doc_id", "<i8"), ("part", "<i4"), ("n_tokens", "<i4"), ("tokens", "<u2", (self.length,))])


def _mixed(x: np.ndarray, key: int, round_: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x + np.uint64((key * 0x9E3779B97F4A7C15 + round_ * 0xD1B54A32D192ED03) & (2**64 - 1)))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(numbers: np.ndarray, size: int, key: int, rounds: int = 6, back: bool = False) -> np.ndarray:
    """A keyed permutation of 0 to ``size`` - 1: a balanced Feistel network on the next even number of bits.

    A number that lands at ``size`` or beyond is sent through again until it lands inside (cycle-walking);
    less than four passes are expected. ``back`` gives the inverse.
    """
    half = max(1, ((max(1, size - 1)).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    shift = np.uint64(half)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & low
        if back:
            for r in reversed(range(rounds)):
                left, right = right ^ (_mixed(left, key, r) & low), left
        else:
            for r in range(rounds):
                left, right = right, left ^ (_mixed(right, key, r) & low)
        return (left << shift) | right

    out = once(numbers.astype(np.uint64))
    while len(outside := np.flatnonzero(out >= np.uint64(size))):
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def _encoder(shared):
    import tiktoken

    ranks, made = shared.value
    if not made:
        made["encoder"] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return made["encoder"]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def sequences(docs: DataFrame, layout: Layout = Layout(), ranks: str = RANKS) -> tuple[DataFrame, int]:
    """(``place``, ``doc_id``, ``part``, ``tokens``) of every sequence, and the size of the domain of places.

    A text's ids and an end-of-text id are cut every ``length`` tokens. The number of a sequence is made of a hash of its
    document (id and text) and its part, which needs no count of the sequences before it and does not depend on how ids
    are numbered: with bytes as tokens of last resort, a text has no more tokens than bytes. Documents that share a
    hash share their places and come by id and tokens. ``tokens`` are packed 16-bit ids.
    """
    spark = docs.sparkSession
    rows = docs.select(col("doc_id").cast("long").alias("doc_id"), col("text").cast("string").alias("text"))
    longest = rows.agg(F.max(F.octet_length("text"))).first()[0] or 0
    most_parts = longest // layout.length + 1
    numbers = (1 << _DOMAIN_BITS) // most_parts
    domain = numbers * most_parts
    rows = rows.withColumn("number", F.pmod(F.xxhash64("doc_id", "text"), F.lit(numbers)))
    shared = spark.sparkContext.broadcast((read_ranks(ranks), {}))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in batches:
            for part in slices(batch):
                ids, parts, tokens, number = [], [], [], []
                for doc, text, own in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    found = np.array([*encoder.encode_ordinary(text or ""), END_OF_TEXT], "<u2")
                    cut = range(0, len(found), layout.length)
                    ids += [doc] * len(cut)
                    number += [own] * len(cut)
                    parts += range(len(cut))
                    tokens += [found[i:i + layout.length].tobytes() for i in cut]
                places = permute(np.array(number, np.int64) * most_parts + np.array(parts, np.int64), domain, layout.key, layout.rounds)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(places), pa.array(ids, pa.int64()), pa.array(parts, pa.int32()), pa.array(tokens, pa.binary())],
                    names=["place", "doc_id", "part", "tokens"])

    return rows.mapInArrow(encode, "place long, doc_id long, part int, tokens binary"), domain


def write_shards(docs: DataFrame, folder: str, layout: Layout = Layout(), ranks: str = RANKS) -> DataFrame:
    """Write all sequences of ``docs`` below ``folder``; returns (``shard``, ``path``, ``start``, ``n``) of each shard.

    ``start`` is the slot of a shard's first record. NULL and empty texts are one sequence, the end-of-text id
    alone. A NULL id is written as -1. Rows that repeat an id and its text share their places and lie next to each
    other; ids may be any 64-bit numbers. Tokens behind ``n_tokens`` are the end-of-text id.
    One line for each shard goes through the driver.
    """
    spark = docs.sparkSession
    found, domain = sequences(docs, layout, ranks)
    n_bytes = docs.agg(F.sum(F.octet_length(col("text").cast("string")))).first()[0] or 0
    # About two bytes and a half of text to a token of two bytes.
    shards = max(1, spark.sparkContext.defaultParallelism, int(n_bytes * 0.8) // layout.shard_bytes + 1)
    width = -(-domain // shards)
    record = layout.record
    out = StructType.fromDDL("shard int, path string, n long")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, count = TaskContext.get().partitionId(), 0
        path = f"{folder}/shard-{shard:06d}.bin"

        def pieces() -> Iterator[bytes]:
            nonlocal count
            for batch in batches:
                for start in range(0, batch.num_rows, 4096):
                    part = batch.slice(start, 4096)
                    rows = np.zeros(part.num_rows, record)
                    rows["doc_id"] = part.column(1).fill_null(-1).to_numpy()
                    rows["part"] = part.column(2).to_numpy()
                    rows["tokens"] = END_OF_TEXT
                    for i, tokens in enumerate(part.column(3)):
                        ids = np.frombuffer(tokens.as_buffer(), "<u2")
                        rows["n_tokens"][i] = len(ids)
                        rows["tokens"][i, :len(ids)] = ids
                    count += len(rows)
                    yield rows.tobytes()

        write_whole(path, pieces())
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([path]), pa.array([count], pa.int64())],
                                         names=out.names)

    ordered = found.withColumn("shard", F.expr(f"CAST(place DIV {width} AS INT)")) \
        .repartitionById(shards, F.col("shard")).sortWithinPartitions("place", "doc_id", "part", "tokens").drop("shard")
    written = sorted(ordered.mapInArrow(write, out).collect(), key=lambda r: r.shard)
    starts, total = [], 0
    for r in written:
        starts.append((r.shard, r.path, total, r.n))
        total += r.n
    return spark.createDataFrame(starts, "shard int, path string, start long, n long")


def read_shards(spark: SparkSession, folder: str, manifest: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """All records: ``slot``, ``shard``, ``record_offset``, ``doc_id``, ``part``, ``n_tokens``, ``tokens_crc32``.

    Each shard is read from front to back; a reader that stopped at a slot begins at its offset. Without
    shards there are no records.
    """
    out = "slot long, shard int, record_offset long, doc_id long, part int, n_tokens int, tokens_crc32 long"
    if not manifest.take(1):
        return spark.createDataFrame([], out)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder) \
        .select(F.regexp_extract("path", r"shard-(\d+)\.bin$", 1).cast("int").alias("shard"), "content")
    files = files.join(F.broadcast(manifest.select("shard", "start")), "shard").select("shard", "start", "content")
    record = layout.record

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, start, content in zip(*batch.columns, strict=True):
                rows = np.frombuffer(content.as_buffer(), record)
                for at in range(0, len(rows), 10_000):
                    some = rows[at:at + 10_000]
                    slots = np.arange(at, at + len(some), dtype=np.int64)
                    crc = [zlib.crc32(t[:n].tobytes()) for t, n in zip(some["tokens"], some["n_tokens"], strict=True)]
                    doc = some["doc_id"].astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(slots + start.as_py()), pa.array([shard.as_py()] * len(some), pa.int32()),
                         pa.array(slots * record.itemsize), pa.array(doc),
                         pa.array(some["part"].astype(np.int32)), pa.array(some["n_tokens"].astype(np.int32)),
                         pa.array(crc, pa.int64())],
                        names=["slot", "shard", "record_offset", "doc_id", "part", "n_tokens", "tokens_crc32"])

    return files.mapInArrow(read, out)


def training_order(docs: DataFrame, layout: Layout = Layout(), ranks: str = RANKS) -> DataFrame:
    """Shards of ``docs`` written to the folder of ``spark.checkpoint.dir`` and read back, a row for each sequence."""
    folder = scratch_path(docs.sparkSession, "shards")
    manifest = write_shards(docs, folder, layout, ranks)
    return read_shards(docs.sparkSession, folder, manifest, layout)
