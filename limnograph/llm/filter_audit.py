"""How a chain of filters shares its work: order effects, lone failures and Shapley values of each filter.

The filters are the players of a game whose value for a coalition is the number of documents that at least one of
its filters rejects. Documents are counted by the set of filters that they fail, so a part of the corpus is 2^k
numbers, whatever its size. From these come the steps of every order (differences of nested coalitions) and the
Hart-Mas-Colell potential P(S) = (v(S) + sum of P(S without i) over i in S) / |S|; a filter's Shapley value is
P(all) less P(all without it). All of it is DataFrame functions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from limnograph.llm.common import col

FILTERS = "ABCDE"
MIN_WORDS, CAPITALS_PERCENT, DISTINCT_PERCENT = 200, 3, 50
_MOST_FILTERS = 6


def text_failures(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with ``mask`` for the text filters in place of ``text``, which holds no NULL.

    Filters A to D fail texts with few words, few different ones, many capitals, and markup signs.
    """
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")  # split once, used in three places
    others = [c for c in rows.columns if c != text]
    split = rows.select(
        *others, words.alias("words"), F.length(text).alias("n_chars"), F.regexp_count(text, F.lit("[A-Z]")).alias("n_capitals"),
        F.col(text).rlike(r"[#$%&*|]").alias("marked"))
    n = F.size("words")
    return split.select(*others, _bits([
        n < MIN_WORDS,
        F.lit(100) * F.size(F.array_distinct("words")) < F.lit(DISTINCT_PERCENT) * n,
        F.lit(100).cast("long") * F.col("n_capitals") > F.lit(CAPITALS_PERCENT) * F.col("n_chars"),
        F.col("marked")]).alias("mask"))


def _bits(failures: Sequence[Column]) -> Column:
    return sum((F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(failures)), F.lit(0))


def failures(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, mask, good, toxic, n): documents by the filters that they fail (bit i is filter i of ``FILTERS``).

    A NULL text counts as empty, a NULL part as ''. Filter E is failed by a document whose text some smaller id
    has anywhere in the table; a NULL id is neither smaller nor larger than any, so it never fails E and makes no
    other fail it; rows that repeat an id count one by one. A document is good (toxic) if any row of ``labels`` with
    its id says so; without labels it is neither.
    """
    body = F.coalesce(col(text).cast("string"), F.lit(""))
    rows = text_failures(docs.select(
        col(doc_id).cast("long").alias("id"), F.coalesce(col(part).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(body, 256)).alias("digest"), body.alias("body")), "body")
    # Rows without an id find no label; numbers spread them over the partitions of the join.
    rows = rows.withColumn("nameless", F.col("id").isNull()) \
        .withColumn("key", F.coalesce("id", F.monotonically_increasing_id()))
    known = labels.select(
        col("doc_id").cast("long").alias("key"), (col("quality") == 1).alias("q"), (col("toxic") == 1).alias("t")) \
        .where("key IS NOT NULL").groupBy("key", F.lit(False).alias("nameless")) \
        .agg(F.coalesce(F.max("q"), F.lit(False)).alias("good"), F.coalesce(F.max("t"), F.lit(False)).alias("toxic"))
    rows = rows.join(known, ["key", "nameless"], "left").fillna(False, ["good", "toxic"])
    # Copies shrink before they are brought together: to one row for each id, then for each kind of row of a text.
    kind = ["digest", "part", "mask", "good", "toxic"]
    by_id = rows.groupBy("key", "nameless", *kind).agg(F.count("*").alias("n"))
    by_text = by_id.groupBy(*kind).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("nameless"), F.col("n")).otherwise(0)).alias("n_nameless"),
        F.min(F.when(~F.col("nameless"), F.struct("key", "n"))).alias("first"))
    least = F.min("first.key").over(Window.partitionBy("digest"))
    by_text = by_text.withColumn("n_first", F.col("n_nameless") + F.when(F.col("first.key") == least, F.col("first.n")).otherwise(0))
    split = F.explode(F.array(
        F.struct(F.col("mask").alias("mask"), F.col("n_first").alias("n")),
        F.struct(F.col("mask").bitwiseOR(F.lit(1 << 4)).alias("mask"), (F.col("n") - F.col("n_first")).alias("n"))))
    return by_text.select("part", "good", "toxic", split.alias("s")) \
        .groupBy("part", F.col("s.mask").alias("mask"), "good", "toxic").agg(F.sum("s.n").alias("n")).where("n > 0")


def coalitions(counts: DataFrame, n_filters: int) -> DataFrame:
    """(part, n, v, good, toxic): all documents, and for each coalition (place = its bits) how many it rejects."""
    def rejected(which: Column) -> Column:
        return F.array(*[F.sum(F.when(which & (F.col("mask").bitwiseAND(F.lit(s)) != 0), F.col("n")).otherwise(F.lit(0).cast("long")))
                         for s in range(1 << n_filters)])

    return counts.groupBy("part").agg(
        F.sum("n").alias("n"), rejected(F.lit(True)).alias("v"), rejected(F.col("good")).alias("good"),
        rejected(F.col("toxic")).alias("toxic"))


def potential(value: str, n_filters: int) -> Column:
    """n_filters! times the potential of every coalition, in whole numbers: parts of a coalition stand before it."""
    inner = " + ".join(f"IF((s & {1 << i}) <> 0, p[s - IF((s & {1 << i}) <> 0, {1 << i}, 0)], 0L)" for i in range(n_filters))
    return F.expr(f"aggregate(sequence(1, {(1 << n_filters) - 1}), array(0L), (p, s) -> array_append(p, "
                  f"({math.factorial(n_filters)}L * {value}[s] + {inner}) div bit_count(s)))")


def audit(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order of ``filters`` (one letter each) and step, zeros included; an empty table gives none.

    ``counts`` has (part, mask, good, toxic, n). ``removed`` is what the step's filter takes from what is left,
    ``redundant`` what it would reject but is gone already, ``unique_fails`` what no other filter rejects, and
    ``shapley`` what the filter removes in all orders together.
    """
    k = len(filters)
    if not 1 <= k <= _MOST_FILTERS or len(set(filters)) != k or not filters.isalnum():
        raise ValueError(f"one to {_MOST_FILTERS} different letters, not {filters!r}")
    games = coalitions(counts, k).withColumn("p", potential("v", k))
    orders = games.withColumn("filter_order", F.explode(F.lit(["".join(o) for o in permutations(filters)])))
    bit = [F.expr(f"shiftleft(1, instr('{filters}', substring(filter_order, {i + 1}, 1)) - 1)") for i in range(k)]
    steps = orders.withColumn("s", F.explode(F.array(*[
        F.struct(F.lit(i + 1).alias("step"), bit[i].alias("bit"), sum(bit[:i], F.lit(0)).alias("before")) for i in range(k)])))
    everyone = (1 << k) - 1
    at = lambda name, place: F.element_at(name, place + 1)
    before, after = F.col("s.before"), F.col("s.before") + F.col("s.bit")
    gain = lambda name: at(name, after) - at(name, before)
    without = F.lit(everyone) - F.col("s.bit")
    return steps.select(
        "part", "filter_order", "s.step", (F.col("n") - at("v", after)).alias("kept"), gain("v").alias("removed"),
        (at("v", F.col("s.bit")) - gain("v")).alias("redundant"),
        (at("v", F.lit(everyone)) - at("v", without)).alias("unique_fails"),
        gain("good").alias("good_lost"), gain("toxic").alias("toxic_lost"),
        (at("p", F.lit(everyone)) - at("p", without)).alias("shapley"))
