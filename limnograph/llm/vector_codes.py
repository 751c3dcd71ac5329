"""Vector code compression: product codes whose codebooks are learnt by Lloyd rounds that look at active entries.

A vector is cut into parts; each part is coded by its nearest codebook entry. Components are whole numbers, so
distances and means are exact. Every part keeps its entry and the exact distance to it. When codebooks change, a part
whose own entry stayed where it was only meets the entries that moved: all others were no nearer before and are not
now. Parts whose entry moved look at the whole codebook. Equal distances go to the lower index in both cases.

Each round reads the state that the round before wrote to the shared folder and writes its own together with the sums
of its tasks, at most parts x entries rows a task; sums are added up by Spark, and the books of fixed size are the only
thing that the driver holds.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from limnograph.llm.common import col, slices
from limnograph.session import discard, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors that meet the entries at a time.
_BLOCK = 4_096


@dataclass(frozen=True)
class Codebooks:
    """``entries``: whole numbers by part, entry and position."""

    entries: np.ndarray
    scale: int

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def bound(width: int) -> int:
    """Components beyond this many units count as this many, so that a distance always fits 60 bits."""
    return math.isqrt((1 << 60) // max(1, width)) // 2


def whole_numbers(vectors: pa.Array, width: int, parts: int, scale: int) -> np.ndarray:
    """floor(scale * x) by vector, part and position; shorter vectors end in zeros."""
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(sizes), width * parts), np.int64)
    most = float(bound(width))
    with np.errstate(over="ignore"):
        out[np.arange(width * parts) < sizes[:, None]] = np.clip(np.floor(flat * scale), -most, most).astype(np.int64)
    return out.reshape(len(sizes), parts, width)


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows and entries; in floating point where every step is a whole number below 2^53."""
    most = max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0))
    if 4 * int(most) ** 2 * max(1, x.shape[1]) < 1 << 53:
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((x - e) ** 2).sum(axis=1) for e in entries], axis=1)


def assign(x: np.ndarray, entries: np.ndarray, moved: np.ndarray, code: np.ndarray, distance: np.ndarray) -> None:
    """Bring ``code`` (-1: none yet) and ``distance`` of one part of all vectors up to date, in place."""
    still = (code >= 0) & ~moved[np.maximum(code, 0)]
    active = np.flatnonzero(moved)
    for rows, among in ((np.flatnonzero(still), active), (np.flatnonzero(~still), np.arange(len(entries)))):
        if not len(among):
            continue
        for i in range(0, len(rows), _BLOCK):
            some = rows[i:i + _BLOCK]
            found = squared(x[some], entries[among])
            best = found.argmin(axis=1)  # the first of equals
            near, index = found[np.arange(len(some)), best], among[best]
            new = (code[some] < 0) | ~still[some] | (near < distance[some]) | ((near == distance[some]) & (index < code[some]))
            code[some[new]], distance[some[new]] = index[new], near[new]


def _round(state: DataFrame, books: Codebooks, moved: np.ndarray, with_sums: bool) -> DataFrame:
    """``state`` with every part assigned to ``books``, and rows with the sums of each task (``entry`` is not NULL)."""
    schema = StructType(state.schema.fields)
    arrow, shared = to_arrow_schema(schema), state.sparkSession.sparkContext.broadcast((books, moved))
    parts, entries, width = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, active = shared.value
        sums = np.zeros((parts, entries, width + 1), np.int64)
        for whole in batches:
            for batch in slices(whole):
                x = whole_numbers(batch.column("vector"), width, parts, own.scale)
                n = batch.num_rows
                if batch.column("codes").null_count:
                    codes, distances = np.full((n, parts), -1, np.int32), np.zeros((n, parts), np.int64)
                else:
                    codes, distances = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(n, parts).copy()
                                        for c in ("codes", "distances"))
                for p in range(parts):
                    assign(x[:, p], own.entries[p], active[p], codes[:, p], distances[:, p])
                    if with_sums:
                        np.add.at(sums[p], codes[:, p], np.concatenate([x[:, p], np.ones((n, 1), np.int64)], axis=1))
                offsets = pa.array(np.arange(0, n * parts + 1, parts, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c) for c in ("vec_id", "label", "vector")],
                     pa.ListArray.from_arrays(offsets, pa.array(codes.ravel())), pa.ListArray.from_arrays(offsets, pa.array(distances.ravel())),
                     pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.int64()))], names=arrow.names)
        if with_sums:
            part, entry = np.nonzero(sums[:, :, -1])
            if len(part):
                rows = {"part": part, "entry": entry, "sums": sums[part, entry].tolist()}
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[f.name], type=f.type) if f.name in rows else pa.nulls(len(part), f.type) for f in arrow],
                    names=arrow.names)

    return state.mapInArrow(run, schema)


def _moved_books(state: DataFrame, books: Codebooks) -> Codebooks:
    """Every entry that is used becomes the floor of the mean of its parts."""
    width = books.entries.shape[2]
    total = state.where("entry IS NOT NULL").groupBy("part", "entry") \
        .agg(F.array(*[F.sum(F.col("sums")[i]) for i in range(width + 1)]).alias("sums"))
    entries = books.entries.copy()
    for r in total.collect():  # at most parts x entries rows
        entries[r.part, r.entry] = np.array(r.sums[:-1], np.int64) // r.sums[-1]
    return Codebooks(entries, books.scale)


def compress(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS,
             entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Codebooks | None]:
    """(vec_id, label, codes, distances) of every vector that is kept, and the codebooks; none if none is kept.

    Vectors that are NULL or hold NULL or non-finite components are left out. The books start as the vectors of the
    smallest ids (then by their components; a NULL id is the largest), fewer if there are fewer. All vectors are taken
    to be as long as the longest, rounded up to equal parts: shorter ones end in zeros. Components beyond ``bound`` count
    as that. Repeated rows are coded one by one; other columns play no role.
    """
    spark = vectors.sparkSession
    finite = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    kept = vectors.select(col(vec_id).alias("vec_id"), col(label).alias("label"), col(vector).alias("vector")) \
        .where(F.col("vector").isNotNull() & finite)
    longest = kept.agg(F.max(F.size("vector")).alias("n")).first().n
    empty = StructType([*kept.schema.fields, StructField("codes", ArrayType(IntegerType())), StructField("distances", ArrayType(LongType())),
                        StructField("part", IntegerType()), StructField("entry", IntegerType()), StructField("sums", ArrayType(LongType()))])
    if longest is None:
        return spark.createDataFrame([], empty).select("vec_id", "label", "codes", "distances"), None
    width = -(-longest // parts)
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    start = whole_numbers(pa.array([r.vector for r in first], pa.list_(pa.float64())), width, parts, scale)
    books = Codebooks(np.ascontiguousarray(start.transpose(1, 0, 2)), scale)
    moved, path = np.ones(books.entries.shape[:2], bool), None
    state = kept.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in empty.fields[3:]])
    for i in range(rounds + 1):
        state, new = written(_round(state, books, moved, i < rounds), "vector-codes")
        if path is not None:
            discard(spark, path)
        path = new
        if i == rounds:
            break
        after = _moved_books(state, books)
        moved = (after.entries != books.entries).any(axis=2)
        books, state = after, state.where("entry IS NULL")
        if not moved.any():
            break  # no entry moves again
    return state.select("vec_id", "label", "codes", "distances"), books


def code_report(vectors: DataFrame, **options) -> DataFrame:
    """One row per kept vector: ``vec_id``, ``code`` (two hex digits a part), ``error``, ``label_error``, ``codebooks_sha256``.

    ``label_error`` adds up the errors of equal labels, NULLs together; it is NULL if it passes 63 bits.
    """
    coded, books = compress(vectors, **options)
    digits = F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0")))
    rows = coded.select("vec_id", "label", F.array_join(digits, "").alias("code"),
                        F.aggregate("distances", F.lit(0).cast("long"), lambda a, b: a + b).alias("error"))
    totals = rows.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error"))
    return rows.join(totals, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label_error", F.lit(books.digest() if books else None).cast("string").alias("codebooks_sha256"))
