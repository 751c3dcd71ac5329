"""WARC archives of captured pages, and their index merged into one globally ordered history.

``write_archives`` writes a record per capture; ``read_archives`` reads them back into index lines, in
locally sorted runs; ``merge_runs`` cuts all runs at the same range bounds and merges the slices of each
range by a loser tree, so that the ranges one after another are ordered by URL key and time.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from limnograph.llm.common import col, partitions
from limnograph.llm.url_rules import host_and_path
from limnograph.session import scratch_path

#: Index lines that a task sorts at a time.
RUN_LINES = 100_000
#: Records of one archive file at most.
FILE_RECORDS = 20_000
_END = "\r\n\r\n"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

INDEX = StructType([StructField(name, kind) for name, kind in (
    ("urlkey", StringType()), ("captured", StringType()), ("page_id", LongType()), ("record_type", StringType()),
    ("refers_to", LongType()), ("payload_digest", StringType()), ("payload_bytes", LongType()), ("archive", StringType()),
    ("record_offset", LongType()), ("record_bytes", LongType()), ("run", StringType()), ("run_line", LongType()))])


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in base32, five hex digits (20 bits, four letters) at a time."""
    code = F.sha1(payload)
    letters = []
    for i in range(8):
        bits = F.conv(F.substring(code, 5 * i + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(_BASE32), F.shiftright(bits, s).bitwiseAND(31) + F.lit(1), F.lit(1))
                    for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def write_archives(captures: DataFrame, folder: str) -> None:
    """Write a gzip WARC record per row of ``page_id``, ``url``, ``payload`` and ``captured`` (a timestamp).

    Of equal payloads, that with the smallest ``page_id`` is a ``response`` with the payload, the others are
    ``revisit`` records that refer to it and have the headers only. A NULL payload is empty; empty payloads
    count as equal. Rows that repeat the smallest id are responses too; rows without an id are revisits if
    another row of their payload has one, and responses otherwise. A NULL URL leaves out the target, control
    characters and spaces in a URL are percent-encoded, and a NULL time is 1970.
    """
    page = captures.select(
        col("page_id").cast("long").alias("id"), col("url").cast("string").alias("url"),
        F.coalesce(col("payload").cast("string"), F.lit("")).alias("payload"),
        F.date_format(F.coalesce(col("captured").cast("timestamp"), F.timestamp_seconds(F.lit(0))),
                      "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date")) \
        .withColumn("digest", base32_sha1(F.col("payload")))
    first = page.groupBy("digest").agg(F.min("id").alias("first"))
    page = page.join(first, "digest", "left").withColumn(
        "refers", F.when(F.col("id").isNull() | (F.col("id") > F.col("first")), F.col("first")))
    revisit = F.col("refers").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "),
                    F.octet_length("payload").cast("string"), F.lit(_END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    safe = F.col("url")
    for c in [*range(0x21), 0x7F]:
        safe = F.replace(safe, F.lit(chr(c)), F.lit(f"%{c:02X}"))
    head = F.concat_ws(
        "\r\n", F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("none")), F.lit(">")),
        F.concat(F.lit("WARC-Date: "), F.col("date")),
        F.concat(F.lit("WARC-Target-URI: "), safe),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("refers").cast("string"), F.lit(">")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length("block").cast("string")))
    # A record ends with two line breaks: to Spark's text writer, that is its line separator.
    page.withColumn("block", block).select(F.concat(head, F.lit(_END), F.col("block")).alias("value")) \
        .write.option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS) \
        .text(folder)


def records(content: bytes) -> Iterator[tuple[int, int, dict[str, str], dict[str, str], bytes]]:
    """Offset, length, WARC headers, HTTP headers and payload of each record of a gzip archive, read in pieces."""
    inflate, held, at, place = zlib.decompressobj(31), bytearray(), 0, 0

    def fill(n: int) -> bool:
        nonlocal place, inflate
        while len(held) < n:
            if inflate.eof:
                rest = inflate.unused_data
                if not rest:
                    return False
                inflate = zlib.decompressobj(31)
                held.extend(inflate.decompress(rest))
                continue
            piece = content[place:place + (1 << 16)]
            place += len(piece)
            held.extend(inflate.decompress(piece) if piece else inflate.flush())
            if not piece and not inflate.unused_data:
                return len(held) >= n
        return True

    end = _END.encode()
    while fill(1):
        stop = held.find(end)
        while stop < 0:
            if not fill(len(held) + 1):
                raise ValueError(f"no end of headers at {at}")
            stop = held.find(end)
        head = _headers(bytes(held[:stop]))
        size = stop + 4 + int(head["content-length"])
        if not fill(size + 4) or held[size:size + 4] != end:
            raise ValueError(f"record at {at} is cut short")
        http, _, payload = bytes(held[stop + 4:size]).partition(end)
        yield at, size + 4, head, _headers(http), payload
        del held[:size + 4]
        at += size + 4


def _headers(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.decode().split("\r\n")[1:]:
        name, _, value = line.partition(":")
        out[name.lower()] = value.strip()
    return out


def _page(uri: str | None) -> int | None:
    name = (uri or "").removeprefix("<urn:page:").removesuffix(">")
    return int(name) if name and name != "none" else None


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Index lines of all records, in sorted runs of at most ``RUN_LINES``; a response's digest is checked."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("path", "content")
    plain = StructType([f for f in INDEX if f.name != "urlkey"] + [StructField("url", StringType())])
    names, schema = plain.names, to_arrow_schema(plain)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*(batch.column(i) for i in (0, 1)), strict=True):
                lines = []
                for at, size, head, http, payload in records(content.as_py()):
                    digest = head["warc-payload-digest"].removeprefix("sha1:")
                    kind, n = head["warc-type"], int(http["content-length"])
                    if kind == "response" and (
                            len(payload) != n or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                        raise ValueError(f"{path} at {at}: the payload does not fit its digest")
                    lines.append((
                        "".join(c for c in head["warc-date"] if c.isdigit()), _page(head["warc-record-id"]), kind,
                        _page(head.get("warc-refers-to")), digest, n, path.as_py(), at, size, None, None,
                        head.get("warc-target-uri")))
                    if len(lines) >= RUN_LINES:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(x, t) for x, t in zip(zip(*lines, strict=True), schema.types, strict=True)],
                            names=names)
                        lines = []
                if lines:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, t) for x, t in zip(zip(*lines, strict=True), schema.types, strict=True)], names=names)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, runs, held, count = TaskContext.get().partitionId(), 0, [], 0

        def run() -> pa.RecordBatch:
            lines = pa.Table.from_batches(held).sort_by([(c, "ascending") for c in ("urlkey", "captured", "page_id")])
            lines = lines.set_column(lines.schema.get_field_index("run"), "run",
                                     pa.array([f"{task}-{runs}"] * lines.num_rows, pa.string()))
            lines = lines.set_column(lines.schema.get_field_index("run_line"), "run_line",
                                     pa.array(range(lines.num_rows), pa.int64()))
            return lines.combine_chunks().to_batches()[0]

        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, RUN_LINES - count)
                held.append(part)
                count, batch = count + part.num_rows, batch.slice(part.num_rows)
                if count == RUN_LINES:
                    yield run()
                    runs, held, count = runs + 1, [], 0
        if count:
            yield run()

    host, path = host_and_path(F.col("url"))
    query = F.regexp_extract(F.col("url"), r"^[^?#]*(\?[^#]*)", 1)
    urlkey = F.when(F.col("url").isNull(), F.lit("")).otherwise(F.concat(
        F.concat_ws(",", F.reverse(F.split(host, r"\.", -1))), F.lit(")"), path, query))
    return files.mapInArrow(read, plain).withColumn("urlkey", urlkey).select(*INDEX.names).mapInArrow(sort, INDEX)


class LoserTree:
    """Merges sorted runs; every inner node keeps the run that lost there, so a step replays one path to the root."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self._runs, self._k = runs, max(1, len(runs))
        self._heads = [next(r, None) for r in runs] or [None]
        self._losers = [0] * self._k
        winner = list(range(self._k, 2 * self._k))  # of each node; the leaves come after the inner nodes
        best = [0] * self._k + [i - self._k for i in winner]
        for node in range(self._k - 1, 0, -1):
            a, b = best[2 * node], best[2 * node + 1]
            best[node], self._losers[node] = (a, b) if self._before(a, b) else (b, a)
        self._top = best[1] if self._k > 1 else 0

    def _before(self, a: int, b: int) -> bool:
        x, y = self._heads[a], self._heads[b]
        return y is None or (x is not None and (x, a) <= (y, b))

    def __iter__(self) -> Iterator[tuple]:
        while (head := self._heads[self._top]) is not None:
            yield head
            run = self._top
            self._heads[run] = next(self._runs[run], None)
            node = (run + self._k) // 2
            while node >= 1:
                if self._before(self._losers[node], run):
                    self._losers[node], run = run, self._losers[node]
                node //= 2
            self._top = run


def merge_runs(runs: DataFrame) -> DataFrame:
    """All index lines with ``part`` and ``part_line``; ordered so, they are ordered by URL key, time and page.

    ``runs`` is as from ``read_archives``. The bounds of the ranges hold the page too, so one URL with most
    captures is cut into many ranges. A NULL page comes first among equal URL keys and times.
    """
    spark = runs.sparkSession
    cut = runs.repartitionByRange(partitions(spark), "urlkey", "captured", "page_id")
    out = StructType([*INDEX, StructField("part", IntegerType()), StructField("part_line", LongType())])
    names, keys = out.names, [INDEX.names.index(c) for c in ("urlkey", "captured", "page_id", "run", "run_line")]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        lines = pa.Table.from_batches(list(batches), schema=to_arrow_schema(INDEX)).combine_chunks()
        url, when, page, run, line = (lines.column(i).to_pylist() for i in keys)
        by_run: dict[str, list[tuple]] = {}
        for i, name in enumerate(run):
            no = page[i]
            by_run.setdefault(name, []).append((url[i], when[i], no is not None, no or 0, line[i], i))
        for slice_ in by_run.values():
            if any(a[4] > b[4] for a, b in zip(slice_, slice_[1:], strict=False)):
                slice_.sort(key=lambda x: x[4])  # a shuffle need not keep the order of a run
        order = [head[5] for head in LoserTree([iter(by_run[name]) for name in sorted(by_run)])]
        for at in range(0, len(order), 10_000):
            some = lines.take(pa.array(order[at:at + 10_000], pa.int64())).combine_chunks()
            n = some.num_rows
            yield pa.RecordBatch.from_arrays(
                [*(c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in some.columns),
                 pa.array([part] * n, pa.int32()), pa.array(range(at, at + n), pa.int64())], names=names)

    return cut.mapInArrow(merge, out)


def with_position(merged: DataFrame) -> DataFrame:
    """``merged`` with ``position``, counted over all ranges; one count for each range goes through the driver."""
    counts = {r.part: r.n for r in merged.groupBy("part").agg(F.count("*").alias("n")).collect()}
    starts, total = [], 0
    for part in sorted(counts):
        starts.append((part, total))
        total += counts[part]
    start = merged.sparkSession.createDataFrame(starts, "part int, start long")
    return merged.join(F.broadcast(start), "part").withColumn("position", F.col("start") + F.col("part_line")).drop("start")


def capture_history(captures: DataFrame) -> DataFrame:
    """Archives written, read back and merged: an index line per capture with its global ``position``.

    Archives, runs and the merged index lie in the folder of ``spark.checkpoint.dir``; ``archive``,
    ``record_offset`` (in the unpacked file) and ``record_bytes`` say where a record is. An empty table has
    no lines.
    """
    spark = captures.sparkSession
    archives, runs, merged = (scratch_path(spark, x) for x in ("archives", "runs", "index"))
    write_archives(captures, archives)
    read_archives(spark, archives).write.parquet(runs)
    merge_runs(spark.read.schema(INDEX).parquet(runs)).write.parquet(merged)
    return with_position(spark.read.parquet(merged))
