"""I-Match fingerprints: hashes of a document's terms of medium document frequency, on several random lexicons.

The lexicon holds the terms in a band of inverse document frequency, counted over all documents. A
fingerprint has one hash of all a document's lexicon terms, sorted, and one for each of several random
subsets of the lexicon. Subsets come in sizes halved again and again: a large one changes with any edit, a
small one still matches after many, so the share of equal hashes tells how much two documents have in common.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from limnograph.llm.common import col, map_rows, partitions, plain_words, slices

_FIRST_ID = -(1 << 63)
#: Hex digits of the hash on the whole lexicon, and of one on a random lexicon.
_WHOLE, _PART = 16, 4
_EMPTY = "0" * _PART


@dataclass(frozen=True)
class Band:
    """Terms in at least ``rare`` and at most ``common`` of the documents; ``draws`` random lexicons of each of ``sizes`` sizes.

    In documents of d distinct terms on average at most d / ``rare`` terms can be in the band, however many
    documents there are: that bounds the broadcast lexicon.
    """

    rare: float = 0.0005
    common: float = 0.1
    draws: int = 12
    sizes: int = 10


def terms(text: str | None) -> set[bytes]:
    return set(plain_words(text).split())


class Lexicon:
    def __init__(self, words: list[bytes], band: Band):
        self.band = band
        self.words = words = sorted(words)
        self.places = {w: i for i, w in enumerate(words)}
        self._codes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        self._levels = self._level(words)

    def _level(self, words: list[bytes]) -> np.ndarray:
        """For each word and draw: in how many of the sizes, each half of the one before, the random lexicon has it."""
        out = np.zeros((len(words), self.band.draws), np.int64)
        for d in range(self.band.draws):
            code = np.fromiter((xxhash.xxh64_intdigest(w, d + 1) for w in words), np.uint64, len(words))
            low = code & (~code + np.uint64(1))  # the lowest bit that is set
            out[:, d] = np.minimum(np.bitwise_count(low - np.uint64(1)), self.band.sizes)
        return out

    def fingerprint(self, text: str | None) -> str:
        """Hex digits for the whole lexicon and for each random one, by draw and size; zeros where no term is in it.

        A text without any term of the lexicon is taken by all its terms.
        """
        found = terms(text)
        known = sorted(self.places[w] for w in found & self.places.keys())
        if known:
            codes, levels = self._codes[known], self._levels[known]
        else:
            words = sorted(found)
            codes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
            levels = self._level(words)
        if not len(codes):
            return "0" * _WHOLE + _EMPTY * (self.band.draws * self.band.sizes)
        out = [xxhash.xxh64_hexdigest(codes.tobytes())]
        for d in range(self.band.draws):
            inside, level = codes, levels[:, d]
            for size in range(1, self.band.sizes + 1):
                mine = level >= size
                inside, level = inside[mine], level[mine]
                if not len(inside):
                    out.append(_EMPTY * (self.band.sizes - size + 1))
                    break
                out.append(xxhash.xxh32_hexdigest(inside.tobytes())[:_PART])
        return "".join(out)


def likeness(a: str, b: str, band: Band = Band()) -> float:
    """Share of the draws whose smallest lexicon with a term of either document has the same terms of both.

    Such a lexicon holds about one term of the two, so the share estimates how many of their terms they have
    in common. 1 for equal fingerprints, 0 where no random lexicon has a term.
    """
    if a == b:
        return 1.0
    width, same, seen = _PART * band.sizes, 0, 0
    for start in range(_WHOLE, len(a), width):
        for at in range(start + width - _PART, start - 1, -_PART):
            x, y = a[at:at + _PART], b[at:at + _PART]
            if x != _EMPTY or y != _EMPTY:
                same, seen = same + (x == y), seen + 1
                break
    return same / seen if seen else 0.0


def lexicon(docs: DataFrame, band: Band = Band(), text: str = "text") -> list[bytes]:
    """The terms of the band, from the document frequencies of all terms of all ``docs``; NULL texts are documents too."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for part in slices(batch):
                for t in part.column(0).to_pylist():
                    found.update(terms(t))
                    if len(found) > 400_000:
                        yield emit(found)
                        found.clear()
        if found:
            yield emit(found)

    def emit(found: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["term", "n"])

    n_docs = docs.count()
    counted = docs.select(col(text).cast("string")).mapInArrow(count, "term binary, n long") \
        .groupBy("term").agg(F.sum("n").alias("n"))
    kept = counted.where((F.col("n") >= band.rare * n_docs) & (F.col("n") <= band.common * n_docs)).select("term")
    return [bytes(r.term) for r in kept.collect()]


def _shared(spark: SparkSession, words: list[bytes], band: Band):
    shared = spark.sparkContext.broadcast((words, band, {}))

    def get() -> Lexicon:
        words_, band_, made = shared.value
        if not made:
            made["lexicon"] = Lexicon(words_, band_)
        return made["lexicon"]

    return get


def fingerprints(docs: DataFrame, words: list[bytes], band: Band = Band(), text: str = "text",
                 keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``fingerprint``; equal texts have equal ones, a NULL text is empty, no row is left out."""
    get = _shared(docs.sparkSession, words, band)

    def make():
        lexicon_ = get()
        return lambda texts: [[lexicon_.fingerprint(t) for t in texts]]

    return map_rows(docs, [text], "fingerprint string", make, keep)


def _beside_next(docs: DataFrame) -> DataFrame:
    """``docs`` cut into ranges of ``doc_id``, each followed by the first row of the next (``guest``).

    Rows are ordered by id, then text; NULL ids come first. The cuts are approximate quantiles of the ids, so
    ranges have about equal numbers of rows; a first row for each range is all that is sent twice.
    """
    spark, parts = docs.sparkSession, partitions(docs.sparkSession)
    rows = docs.select(col("doc_id").cast("long").alias("doc_id"), F.coalesce(col("text").cast("string"), F.lit("")).alias("text")) \
        .withColumn("place", F.coalesce("doc_id", F.lit(_FIRST_ID)))
    at = [i / parts for i in range(1, parts)] or [0.5]
    cuts = sorted(set(rows.agg(F.percentile_approx("place", at, 10_000).alias("c")).first().c or [])) if parts > 1 else []

    def cut():
        return lambda places: [[bisect_right(cuts, p) for p in places]]

    heads = map_rows(rows.select("place"), ["place"], "part int", cut).groupBy("part").agg(F.min("place").alias("place")).collect()
    heads = sorted((r.part, r.place) for r in heads)
    before = {heads[i][1]: heads[i - 1][0] for i in range(len(heads))}  # the first range follows the last
    own = map_rows(rows, ["place"], "part int", cut).withColumn("guest", F.lit(False))
    sent = spark.createDataFrame(list(before.items()), "place long, part int")
    guests = rows.join(F.broadcast(sent), "place").groupBy("place", "part") \
        .agg(F.min_by("doc_id", "text").alias("doc_id"), F.min("text").alias("text")).withColumn("guest", F.lit(True))
    both = own.unionByName(guests).repartitionById(parts, F.col("part")) \
        .sortWithinPartitions("guest", "place", "text").select("doc_id", "text", "guest")
    return both


def compare_with_edits(docs: DataFrame, band: Band = Band()) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and how alike they are.

    The edited text has the last ``floor(n_chars / 2)`` code points replaced by as many first ones (or all) of
    the next document by id, after the last by those of the first. A single document is its own next. A NULL
    text is empty. Rows with equal ids follow each other by text; NULL ids come first. Every row comes out once.
    """
    words = lexicon(docs, band)
    get = _shared(docs.sparkSession, words, band)
    out = StructType.fromDDL("doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                             "edited_fingerprint string, near_edited double, near_next double")
    schema = to_arrow_schema(out)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon_ = get()
        last, done, rows = None, False, []

        def row(doc, text, print_, next_text, next_print):
            half = len(text) // 2
            edited = text[:len(text) - half] + next_text[:half]
            edited_print = lexicon_.fingerprint(edited)
            return (doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), print_, edited_print,
                    likeness(print_, edited_print, band), likeness(print_, next_print, band))

        for batch in batches:
            for part in slices(batch):
                for doc, text, guest in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    if done:
                        continue
                    print_ = lexicon_.fingerprint(text)
                    if last is not None:
                        rows.append(row(*last, text, print_))
                    last, done = (doc, text, print_), guest
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], names=out.names)
                    rows = []

    return _beside_next(docs).mapInArrow(compare, out)
