"""Allow and block rules on URLs as a sort-merge range join.

A host is written with its labels reversed and a dot after each (``com.example.www.``). All
subdomains of a host then lie in one interval of the sorted keys, and intervals of rules are nested
or apart. Rules and URLs are cut into the same ranges, sorted together, and swept once with a stack
of the rules whose interval is open.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limnograph.llm.common import col, map_rows, partitions, ranges

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LAST = "\U0010ffff"
_SALTS = 1024


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/ ? #``, A-Z lower-cased; path: then up to ``? #``; else empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + F.lit(1), F.length(rest)), r"^[^?#]*", 0)
    return F.translate(F.coalesce(host, F.lit("")), UPPER, LOWER), F.coalesce(path, F.lit(""))


def host_key(host: Column) -> Column:
    labels = F.reverse(F.split(host, r"\.", -1))
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.concat_ws(".", labels), F.lit(".")))


def judge_urls(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``urls`` with ``host``, ``path``, ``rule`` (host and path of the longest fitting rule) and ``verdict``.

    ``rules`` has ``host``, ``path`` and ``verdict`` (``allow`` or ``block``). A rule fits its host and all
    subdomains if the URL's path starts with the rule's; the longest host and path together win. Without a
    fitting rule, ``rule`` is NULL and ``verdict`` is ``default``. A NULL URL, or one without ``://``, has an
    empty host and path and fits no rule. Rules with a NULL or empty host fit nothing; a NULL rule path is
    empty. Of rules given twice, ``block`` wins. Every row of ``urls`` comes out once, repeated rows too;
    columns of ``urls`` named like a new one give way.

    Ranges are cut by host, path and a salt of the row, so that a host or URL with a large share of the rows
    is spread over many tasks; a rule goes to each range that its interval meets.
    """
    parts = partitions(urls.sparkSession)
    new = {"host", "path", "rule", "verdict"}
    kept = [c for c in urls.columns if c.lower() not in new]
    host, path = host_and_path(col(url).cast("string"))
    data = F.struct(*[col(c).alias(f"c{i}") for i, c in enumerate(kept)]) if kept else F.struct(F.lit(0).alias("c0"))
    rows = urls.select(data.alias("data"), host.alias("host"), path.alias("path")) \
        .withColumn("key", host_key(F.col("host"))) \
        .withColumn("salt", F.format_string("%04d", F.pmod(F.xxhash64("data"), F.lit(_SALTS))))
    place = F.concat_ws("\0", "key", "path", "salt")
    cuts = ranges(rows, place, parts)

    def at_cut():
        return lambda places: [[bisect_right(cuts, p) for p in places]]

    left = map_rows(rows.withColumn("place", place), ["place"], "part int", at_cut, [*rows.columns])
    left = left.select("part", "key", F.lit(1).alias("kind"), "path", F.lit(None).cast("string").alias("rule"),
                       F.lit(None).cast("string").alias("verdict"), "host", "data")
    given = rules.select(F.translate(F.col("host"), UPPER, LOWER).alias("host"),
                         F.coalesce(F.col("path"), F.lit("")).alias("path"), "verdict") \
        .where("host IS NOT NULL AND host <> ''").groupBy("host", "path").agg(F.max("verdict").alias("verdict")) \
        .withColumn("key", host_key(F.col("host")))

    def spans():
        return lambda keys: [[list(range(bisect_right(cuts, k), bisect_right(cuts, k + _LAST) + 1)) for k in keys]]

    right = map_rows(given, ["key"], "parts array<int>", spans) \
        .select(F.explode("parts").alias("part"), "key", F.lit(0).alias("kind"), "path",
                F.concat("host", "path").alias("rule"), "verdict", "host",
                F.lit(None).cast(left.schema["data"].dataType).alias("data"))
    both = left.unionByName(right).repartitionById(parts, F.col("part")).sortWithinPartitions("key", "kind", "path")
    schema = left.select("data", "host", "path", "rule", "verdict").schema
    names = schema.names

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple[str, dict, list]] = []
        last, best = None, (None, default)
        for batch in batches:
            keys, kinds, paths, rule, verdict = (batch.column(i).to_pylist() for i in range(1, 6))
            found, judged, picked = [], [], []
            for i, (key, kind, path_) in enumerate(zip(keys, kinds, paths, strict=True)):
                if kind == 0 or (key, path_) != last:
                    while stack and not key.startswith(stack[-1][0]):
                        stack.pop()
                if kind == 0:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, {}, []))
                    stack[-1][1][path_] = (rule[i], verdict[i])
                    if len(path_) not in stack[-1][2]:
                        stack[-1][2].append(len(path_))
                    last = None
                    continue
                if (key, path_) != last:
                    last, best, longest = (key, path_), (None, default), -1
                    for _, by_path, lengths in stack:
                        for n in lengths:
                            hit = by_path.get(path_[:n]) if n <= len(path_) else None
                            if hit and len(hit[0]) > longest:
                                best, longest = hit, len(hit[0])
                picked.append(i)
                found.append(best[0])
                judged.append(best[1])
            if picked:
                part = batch.take(pa.array(picked))
                yield pa.RecordBatch.from_arrays(
                    [part.column("data"), part.column("host"), part.column("path"), pa.array(found, pa.string()),
                     pa.array(judged, pa.string())], names=names)

    swept = both.mapInArrow(sweep, schema)
    return swept.select(*[F.col(f"data.c{i}").alias(c) for i, c in enumerate(kept)], "host", "path", "rule", "verdict")
