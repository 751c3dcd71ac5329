"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives, all other texts are unlabelled, not negative. Linear classifiers on
words and word beginnings minimise ``prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)])`` with the
sigmoid loss l; when the second part falls below zero, a step is taken to raise it again.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limnograph.llm.common import col, map_rows, plain_words, slices

#: Texts with at least this score count as toxic.
THRESHOLD = 0.3
#: Features of toxic texts that a Python worker counts before it hands the counts on.
_COUNTED = 100_000
#: Tasks that count features: so many, twice the cores, or one for every ``_JOINED`` partitions, whichever is most. Each hands
#: on a feature once, so fewer tasks send fewer counts, and a task still reads a few partitions at most where there are many.
_TASKS, _JOINED = 16, 4


@dataclass(frozen=True)
class Fit:
    """Bounds and steps of the training."""

    positives: int = 20_000    # confirmed toxic texts at most, by a hash of their id
    unlabelled: int = 40_000   # unlabelled texts at most, by a hash of id and text
    features: int = 2_048      # words and word beginnings of a classifier
    least_texts: int = 3       # positive texts that have a feature
    sure: float = 1.5          # standard deviations taken off its count there, and added to that among the unlabelled
    lift: float = 2.0          # times its share of the unlabelled texts that is left of its share of the positive ones
    classifiers: int = 3       # each on its own draw of the texts; their mean is the score
    steps: int = 500
    rate: float = 0.1
    decay: float = 1e-4
    prior: float | None = None  # share of toxic texts; None: that among the labelled ones
    usual_prior: float = 0.1    # where no text is labelled clean


@dataclass(frozen=True)
class Model:
    places: dict[str, int]
    weights: np.ndarray  # one row for each classifier, the intercept last

    def score(self, found: list[int]) -> float:
        if not self.places:
            return 0.0
        g = self.weights[:, found].sum(axis=1) + self.weights[:, -1]
        return float(np.mean(1.0 / (1.0 + np.exp(-np.clip(g, -30, 30)))))


def features(text: str | None) -> set[str]:
    """Distinct words of the whole text, and their first four and five characters."""
    words = set(plain_words(text).decode().split())
    return words | {w[:4] + "*" for w in words if len(w) > 3} | {w[:5] + "*" for w in words if len(w) > 4}


def held_out(doc_id: Column) -> Column:
    """True for the quarter of the ids whose labels are never learned; False for a NULL id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def _drawn(df: DataFrame, most: int, seed: int) -> DataFrame:
    """About ``most`` rows at most, by a hash of all columns."""
    share = most / max(1, df.count())
    if share >= 1:
        return df
    return df.where(F.pmod(F.xxhash64(F.lit(seed), *df.columns), F.lit(1_000_000)) < int(share * 1_000_000))


def train(docs: DataFrame, labels: DataFrame, fit: Fit = Fit()) -> Model:
    """Classifiers from ``docs`` (``doc_id``, ``text``) and the confirmed toxic rows of ``labels`` (``doc_id``, ``toxic``).

    Labels of held-out ids are not read. Features are counted over all texts; weights are fitted on a bounded draw
    (``Fit``). That draw's features and the counts of those that enough of at most ``Fit.positives`` toxic texts have
    come to the driver. Without a confirmed toxic text there are no features, and all scores are 0.
    """
    spark = docs.sparkSession
    known = labels.select(col("doc_id"), col("toxic").cast("int").alias("toxic")) \
        .where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))) \
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n_toxic, n_clean = known.agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)).first()
    prior = fit.prior or (n_toxic / (n_toxic + n_clean) if n_clean else fit.usual_prior)
    toxic = F.broadcast(_drawn(known.where("toxic = 1").select("doc_id"), fit.positives, 1))
    texts = docs.select(col("doc_id"), col("text").cast("string").alias("text"))
    positive = texts.join(toxic, "doc_id", "left_semi").select("text", F.lit(True).alias("toxic"))
    unlabelled = _drawn(texts, fit.unlabelled, 2).select("text", F.lit(False).alias("toxic"))
    n_p, n_all = positive.count(), texts.count()
    if not n_p:
        return Model({}, np.zeros((1, 1)))
    # Features that enough positive texts have; then in how many of all texts each of these occurs.
    gathered = _gathered(texts)
    often = _counted(gathered.join(toxic, "doc_id", "left_semi").select("text")).where(F.col("n") >= fit.least_texts).collect()
    p = {r.feature: r.n for r in often}
    u = _counted_among(gathered.select("text"), list(p))
    places = {f: i for i, f in enumerate(_chosen(p, u, n_p, n_all, fit))}
    if not places:
        return Model({}, np.zeros((1, 1)))
    both = positive.unionByName(unlabelled)
    rows = map_rows(both, ["text"], "found array<int>", lambda: lambda t: [[_found(x, places) for x in t]], ["toxic"]).collect()
    # In an order of their own, so that the draws of the training do not depend on how the rows were dealt out.
    sets = {kind: sorted(r.found for r in rows if r.toxic is kind) for kind in (True, False)}
    if not sets[False]:
        return Model({}, np.zeros((1, 1)))
    weights = [nn_pu(sets[True], sets[False], len(places), prior, fit, seed) for seed in range(fit.classifiers)]
    return Model(places, np.array(weights))


def _gathered(texts: DataFrame) -> DataFrame:
    """``texts`` in fewer partitions, without a shuffle."""
    cores = texts.sparkSession.sparkContext.defaultParallelism
    return texts.coalesce(max(_TASKS, 2 * cores, texts.rdd.getNumPartitions() // _JOINED))


def _counted(texts: DataFrame) -> DataFrame:
    """(feature, n): in how many texts each feature occurs."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Counter()
        for batch in batches:
            for part in slices(batch):
                for text in part.column(0).to_pylist():
                    found.update(features(text))
                if len(found) > _COUNTED:
                    yield emit(found)
                    found = Counter()
        if found:
            yield emit(found)

    def emit(found: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["feature", "n"])

    return texts.mapInArrow(count, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def _counted_among(texts: DataFrame, among: list[str]) -> dict[str, int]:
    """In how many texts each feature of ``among`` occurs; those in none are left out.

    A task keeps one number for each feature of ``among`` and hands it on once, at its end.
    """
    shared = texts.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(among)})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = shared.value
        n = np.zeros(len(places), np.int64)
        for batch in batches:
            for part in slices(batch):
                for text in part.column(0).to_pylist():
                    found = features(text) & places.keys()
                    n[np.fromiter(map(places.__getitem__, found), np.int64, len(found))] += 1
        met = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(n[met])], names=["place", "n"])

    counts = texts.mapInArrow(count, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
    return {among[r.place]: r.n for r in counts}


def _chosen(p: dict[str, int], u: dict[str, int], n_p: int, n_u: int, fit: Fit) -> list[str]:
    """Features that are surely commoner in the positive texts, the most surprising first."""
    ranked = []
    for feature, in_p in p.items():
        in_u = u.get(feature, 0)
        if (in_p - fit.sure * in_p ** 0.5) / n_p - fit.lift * (in_u + fit.sure * (in_u + 1) ** 0.5) / n_u > 0:
            ranked.append(((in_u / n_u - in_p / n_p) / (in_p + in_u + 1) ** 0.5, feature))
    return [feature for _, feature in sorted(ranked)[:fit.features]]


def _found(text: str | None, places: dict[str, int]) -> list[int]:
    return sorted(places[f] for f in features(text) if f in places)


def nn_pu(positive: list[list[int]], unlabelled: list[list[int]], width: int, prior: float, fit: Fit, seed: int) -> np.ndarray:
    """Weights of one linear classifier, the intercept last, by the non-negative risk on a draw with replacement."""
    rng = np.random.default_rng(seed)

    def drawn(rows):
        picked = [rows[i] for i in rng.integers(0, len(rows), len(rows))]
        flat = np.fromiter((x for r in picked for x in r), np.int64)
        owner = np.repeat(np.arange(len(picked)), [len(r) for r in picked])
        return flat, owner, len(picked)

    data = drawn(positive), drawn(unlabelled)
    w = np.zeros(width + 1)
    w[-1] = -2.0
    m, v = np.zeros_like(w), np.zeros_like(w)

    def sigmoid(z):
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))

    def slope(side, g, sign):
        """Gradient of the mean of ``sigmoid(-sign * g)``."""
        flat, owner, n = side
        loss = sigmoid(-sign * g)
        d = -sign * loss * (1 - loss) / n
        out = np.bincount(flat, weights=d[owner], minlength=width + 1)
        out[-1] = d.sum()
        return out

    for step in range(1, fit.steps + 1):
        g_p, g_u = (np.bincount(owner, weights=w[flat], minlength=n) + w[-1] for flat, owner, n in data)
        rest = sigmoid(g_u).mean() - prior * sigmoid(g_p).mean()
        negative = slope(data[1], g_u, -1) - prior * slope(data[0], g_p, -1)
        gradient = prior * slope(data[0], g_p, 1) + negative if rest >= 0 else -negative
        gradient[:-1] += fit.decay * w[:-1]
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient * gradient
        w -= fit.rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return w


def score_toxicity(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``toxicity`` (0 to 1), from the whole text alone.

    A NULL or empty text has no features and gets the score of the intercept. Rows are never left out; equal
    texts have equal scores. A column of that name gives way. The broadcast model has at most ``Fit.features`` features.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        return lambda texts: [[shared.value.score(_found(t, shared.value.places)) for t in texts]]

    return map_rows(docs, [text], "toxicity double", make, keep)
