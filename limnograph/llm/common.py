"""Helpers of the operators: reading tables, Arrow slices of bounded size, words of a text."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

#: Python works on so many bytes of Arrow data at a time, a single longer row excepted.
SLICE_BYTES = 8 << 20
#: So much of it Spark hands over at a time where ``bounded_batches`` was called: each task has several copies of a batch.
BATCH_BYTES = 2 << 20
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

_A_TO_Z = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_WORD_BYTES = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz") | frozenset(range(0x80, 0x100))
_WORDS_ONLY = bytes(c if c in _WORD_BYTES else 0x20 for c in _A_TO_Z)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def col(name: str) -> Column:
    """A column by its plain name, dots included."""
    return F.col(f"`{name.replace('`', '``')}`")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded_batches(spark: SparkSession) -> None:
    """From now on Spark hands Python batches of about ``BATCH_BYTES`` at most, and not 10,000 rows however long; a bound that
    the session has set already stays. Batches bear on memory alone."""
    if spark.conf.get(_BATCH_BYTES, None) is None:
        spark.conf.set(_BATCH_BYTES, str(BATCH_BYTES))


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of ``batch`` in parts of at most ``SLICE_BYTES``, in order."""
    if batch.num_rows <= 1 or batch.nbytes <= SLICE_BYTES:
        if batch.num_rows:
            yield batch
        return
    middle = batch.num_rows // 2
    yield from slices(batch.slice(0, middle))
    yield from slices(batch.slice(middle))


def map_rows(df: DataFrame, inputs: Sequence[str], fields: str, make: Callable[[], Callable],
             keep: Sequence[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all) of each row, and new ``fields`` computed from ``inputs``.

    ``make`` runs once per task and returns a function from the input columns (lists of Python
    values) to one list or Arrow array per field. A kept column with the name of a new field gives way.
    """
    added = StructType.fromDDL(fields)
    taken = {f.name.lower() for f in added}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in taken]
    read = kept + [c for c in inputs if c not in kept]
    places = [read.index(c) for c in inputs]
    out = StructType([StructField(f.name, f.dataType, True) for f in df.select(*map(col, kept)).schema] + list(added))
    types = [to_arrow_type(f.dataType) for f in added]
    names, width = out.names, len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            for part in slices(batch):
                new = compute(*[part.column(i).to_pylist() for i in places])
                arrays = [part.column(i) for i in range(width)]
                arrays += [x.cast(t) if isinstance(x, pa.Array) else pa.array(x, type=t)
                           for x, t in zip(new, types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return df.select(*map(col, read)).mapInArrow(run, out)


def plain_words(text: str | None) -> bytes:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z, joined by single spaces, in UTF-8."""
    return b" ".join((text or "").encode().translate(_WORDS_ONLY).split())


def ranges(df: DataFrame, key: Column, parts: int, per_part: int = 100, seed: int = 7) -> list:
    """At most ``parts`` - 1 sorted values that cut ``key`` (NULLs left out) into about equal shares of the rows.

    They come from a sample of about ``per_part`` keys for each part, whatever the size of ``df``.
    The sample only places the cuts; rows are not left out of anything.
    """
    keys = df.select(key.alias("k")).where("k IS NOT NULL")
    share = parts * per_part / max(1, keys.count())
    drawn = keys if share >= 1 else keys.sample(share, seed=seed)
    found = sorted(r.k for r in drawn.collect())
    return sorted({found[len(found) * i // parts] for i in range(1, parts)}) if found else []
