"""Benchmark decontamination: word windows of the test items in a broadcast hash set, texts scanned against it.

Words of the items get numbers; a text becomes an array of numbers, a window's hash is a polynomial over
them, and a hash found in the set is verified word by word. Items that would make the broadcast set too large
are scanned in blocks, and the hits of all blocks are united.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnograph.llm.common import col, map_rows, plain_words
from limnograph.session import scratch_path

WINDOW = 13
#: Bytes of item texts in one broadcast block.
BLOCK_BYTES = 8 << 20
_PRIME = np.uint64(0x9E3779B97F4A7C15)


class Windows:
    """The windows of some items: a set of hashes for each length, and the exact words behind a hash."""

    def __init__(self, items: list[tuple[int | None, bytes]], window: int):
        self.ids: dict[bytes, int] = {}
        self.by_length: dict[int, dict[tuple[int, ...], set]] = {}
        for item, words in items:
            numbers = [self.ids.setdefault(w, len(self.ids)) for w in words.split()]
            length = min(window, len(numbers))
            for i in range(len(numbers) - length + 1 if length else 0):
                self.by_length.setdefault(length, {}).setdefault(tuple(numbers[i:i + length]), set()).add(item)
        self.hashes = {n: np.unique(_hashes(np.array(list(w), dtype=np.int64).ravel(), n)[::n])
                       for n, w in self.by_length.items()}

    def scan(self, texts: list[bytes]) -> tuple[list[int], list[list[tuple[int, int]]], list[set]]:
        """For each text: its number of words, the spans of all windows found, and the items they come from."""
        counts, numbers, get = [], [], self.ids.get
        for text in texts:
            words = text.split()
            counts.append(len(words))
            numbers += [get(w, -1) for w in words]
            numbers.append(-1)  # no window runs from one text into the next
        codes = np.array(numbers, dtype=np.int64)
        starts = np.cumsum([0] + [n + 1 for n in counts])
        known = np.concatenate([[0], np.cumsum(codes >= 0)])
        spans: list[list] = [[] for _ in texts]
        items: list[set] = [set() for _ in texts]
        for n, found in self.by_length.items():
            if len(codes) < n:
                continue
            at = np.flatnonzero(known[n:] - known[:-n] == n)
            if not len(at):
                continue
            sums = _hashes_at(codes, at, n)
            table = self.hashes[n]
            slot = np.minimum(np.searchsorted(table, sums), len(table) - 1)
            at = at[table[slot] == sums]
            owner = np.searchsorted(starts, at, side="right") - 1
            for place, text in zip(at.tolist(), owner.tolist(), strict=True):
                hit = found.get(tuple(codes[place:place + n].tolist()))
                if hit is not None:
                    start = place - int(starts[text])
                    spans[text].append((start, start + n))
                    items[text] |= hit
        return counts, spans, items


def _hashes_at(codes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(len(at), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = (out ^ (codes[at + i].astype(np.uint64) + np.uint64(1))) * _PRIME
            out ^= out >> np.uint64(29)
    return out


def _hashes(codes: np.ndarray, n: int) -> np.ndarray:
    return _hashes_at(codes, np.arange(len(codes) - n + 1), n)


def _merged(spans: list) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(map(tuple, spans)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int | None, bytes]]]:
    """All items in blocks of about ``block_bytes``, one after another on the driver; a longer item is one block."""
    held, size = [], 0
    rows = benchmark.select(col("item_id").cast("long").alias("i"), col("text").cast("string").alias("t")) \
        .dropDuplicates().toLocalIterator()
    for row in rows:
        words = plain_words(row.t)
        if held and size + len(words) > block_bytes:
            yield held
            held, size = [], 0
        held.append((row.i, words))
        size += len(words)
    if held:
        yield held


def _scanner(spark, items: list, window: int) -> Callable[[], Callable]:
    shared = spark.sparkContext.broadcast(items)

    def make():
        windows = Windows(shared.value, window)

        def scan(texts):
            counts, spans, found = windows.scan([plain_words(t) for t in texts])
            return [counts, [[{"start": a, "stop": b} for a, b in _merged(s)] for s in spans],
                    [sorted(str(i) for i in f if i is not None) for f in found]]

        return scan

    return make


_FOUND = "n_words long, spans array<struct<start: int, stop: int>>, items array<string>"
_JUDGED = "n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start: int, stop: int>>"
#: The words of ``plain_words`` before A-Z are lower-cased, for Spark.
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _verdict():
    def judge(n_words, spans, items):
        merged = [_merged([(s["start"], s["stop"]) for s in x]) for x in spans]
        names = [sorted(set(x)) for x in items]
        n_hit = [sum(b - a for a, b in x) for x in merged]
        return [n_hit, [len(x) for x in names], [hashlib.sha256(",".join(x).encode()).hexdigest() for x in names],
                [h > 0 and 20 * h >= n for h, n in zip(n_hit, n_words, strict=True)],
                [[{"start": a, "stop": b} for a, b in x] for x in merged]]

    return judge


def _judged(windows: Callable[[], Callable]) -> Callable[[], Callable]:
    """Scan and verdict at once: two steps in a row would each take a Python worker of every task."""
    def make():
        scan, judge = windows(), _verdict()

        def run(texts):
            counts, spans, items = scan(texts)
            return [counts, *judge(counts, spans, items)]

        return run

    return make


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text",
                  keep: list[str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with the words that windows of ``benchmark`` (``item_id``, ``text``) cover.

    A window is ``window`` consecutive words of an item, or a shorter item's words. New columns: ``n_words``,
    ``n_hit`` (words inside any occurrence), ``n_items`` and ``items_sha256`` (items with occurring windows),
    ``contaminated`` (``n_hit > 0`` and at least a twentieth of the words) and ``spans`` (the covered word
    ranges). A NULL or empty text has no words; such an item has no window. An item without an id still hits,
    but is not counted or listed as an item; repeated ids are one item. Rows are never left out; ``keep`` names the columns that
    come back (default: all), and those named like a new one give way.

    The broadcast set is bounded by ``block_bytes`` of item text. More items are scanned block by block; the
    hits of the blocks meet in a shuffle on a digest of the text.
    """
    spark = docs.sparkSession
    cols = docs.columns if keep is None else keep
    blocks = _blocks(benchmark, block_bytes)
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        return map_rows(docs, [text], f"n_words long, {_JUDGED}", _judged(_scanner(spark, first, window)),
                        [c for c in cols if c.lower() != "items"])
    found = _in_blocks(docs, [first, second], blocks, window, text, cols)
    return map_rows(found, ["n_words", "spans", "items"], _JUDGED, _verdict).drop("items")


def _in_blocks(docs, ahead, blocks, window, text, cols) -> DataFrame:
    """Hits of each block, written as they come, united by the text's digest and joined back to all rows."""
    spark, digest = docs.sparkSession, "__text_digest"
    keyed = docs.withColumn(digest, F.sha2(F.coalesce(col(text).cast("string"), F.lit("")), 256))
    texts = keyed.select(col(text), digest)
    parts = []
    for items in (*ahead, *blocks):
        path = scratch_path(spark, "hits")
        map_rows(texts, [text], _FOUND, _scanner(spark, items, window), [digest]) \
            .where(F.size("spans") > 0).dropDuplicates([digest]).drop("n_words").write.parquet(path)
        parts.append(spark.read.parquet(path))
    hits = reduce(DataFrame.unionByName, parts).groupBy(digest).agg(
        F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    new = {"n_words", "spans", "items"}
    n_words = F.coalesce(F.regexp_count(col(text).cast("string"), F.lit(_WORD)), F.lit(0)).cast("long")
    counted = keyed.select(*[col(c) for c in cols if c.lower() not in new], digest, n_words.alias("n_words"))
    empty = hits.schema
    return counted.join(hits, digest, "left").drop(digest) \
        .withColumn("spans", F.coalesce("spans", F.array().cast(empty["spans"].dataType))) \
        .withColumn("items", F.coalesce("items", F.array().cast(empty["items"].dataType)))


def without_hits(text: str | None, spans: list) -> str | None:
    """``text`` without the words in ``spans`` and what stands between them (the removal of spans)."""
    if not text or not spans:
        return text
    places = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
    out, at = [], 0
    for a, b in ((s["start"], s["stop"]) for s in spans):
        out.append(text[at:places[a][0]])
        at = places[b - 1][1]
    return "".join([*out, text[at:]])


def remove_spans(docs: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """``docs`` (from ``decontaminate``) with the covered words cut out of the text."""
    at = docs.columns
    return map_rows(docs, [text, spans], f"`{text}` string",
                    lambda: lambda t, s: [[without_hits(x, y) for x, y in zip(t, s, strict=True)]]).select(*map(col, at))
