"""Embedding forest, vector codes and filter audit."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from limnograph.llm import embedding_forest, filter_audit, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, n long, size int, codes string"


def _vectors(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(*r, 7, 7, "old") for r in rows], schema)


def _clusters(seed, n_labels=3, singles=150, copies=(2, 5, 40), d=16, noise=0.01):
    rng, rows, k = np.random.default_rng(seed), [], 0
    for label in range(n_labels):
        for size in [1] * singles + list(copies):
            centre = rng.standard_normal(d)
            centre /= np.linalg.norm(centre)
            for _ in range(size):
                rows.append((k, (centre + noise * rng.standard_normal(d)).astype(np.float32).tolist(), label))
                k += 1
    return rows


AWKWARD = [(900, None, 1), (901, [], 1), (902, [0.0] * 16, 1), (903, [1.0, None] * 8, 1), (904, [float("nan")] * 16, 1),
           (905, [float("inf")] * 16, 1), (906, [1.0] * 16, None), (907, [1.0] * 16, None), (908, [2.0] * 16, 2), (909, [1e30] * 16, 2),
           (909, [1e30] * 16, 2), (910, [1.0] * 8, 2), (911, [3.0] * 8, 2), (None, [2.0] * 16, 2), (None, [-1.0] * 8, 1)]


def _brute_links(rows):
    ok = [i for i, (_, v, label) in enumerate(rows) if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    near = {i: set() for i in range(len(rows))}
    unit = {i: np.array(rows[i][1], np.float64) / np.linalg.norm(np.array(rows[i][1], np.float64)) for i in ok}
    for i, j in itertools.combinations(ok, 2):
        if rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.93:
            near[i].add(j)
            near[j].add(i)
    out, seen = [], {}
    for i in range(len(rows)):
        if i not in seen:
            todo, group = [i], {i}
            while todo:
                new = near[todo.pop()] - group
                group |= new
                todo += new
            least = min((rows[j][0] for j in group if rows[j][0] is not None), default=None)
            seen |= dict.fromkeys(group, least)
        out.append((rows[i][0], len(near[i]), seen[i], rows[i][0] == seen[i]))
    return sorted(out, key=str)


@pytest.mark.parametrize("options", [{}, {"leaf": 12}, {"leaf": 12, "chunk": 20}, {"leaf": 40, "chunk": 9}])
def test_forest_finds_what_brute_force_finds(spark, options):
    rows = _clusters(3) + AWKWARD
    found = embedding_forest.near_embeddings(_vectors(spark, rows), **options).collect()
    assert sorted((tuple(r) for r in found), key=str) == _brute_links(rows)


def test_forest_recall_at_the_threshold(spark):
    """Pairs of cosines from 0.93 to 0.96 in deep trees: nine of ten links at least, and none that is not one."""
    rng, rows = np.random.default_rng(5), []
    for k in range(1_000):
        a, b = rng.standard_normal((2, 64))
        a /= np.linalg.norm(a)
        b -= (a @ b) * a
        c = rng.uniform(0.93, 0.96)
        rows += [(2 * k, a.tolist(), 0), (2 * k + 1, (c * a + math.sqrt(1 - c * c) * b / np.linalg.norm(b)).tolist(), 0)]
    truth = {r[0]: r[1:] for r in _brute_links(rows)}
    found = embedding_forest.near_embeddings(_vectors(spark, rows, SCHEMA.replace("float", "double")), leaf=16).collect()
    assert all(r.n_links <= truth[r.vec_id][0] for r in found)
    assert sum(r.n_links for r in found) >= 0.9 * sum(t[0] for t in truth.values())


def test_forest_of_empty_table_and_one_hot_vector(spark):
    assert embedding_forest.near_embeddings(_vectors(spark, [])).count() == 0
    rows = [(k, [1.0, 2.0, 0.5], 4) for k in range(3_000)]
    found = embedding_forest.near_embeddings(_vectors(spark, rows), leaf=64, chunk=100).collect()
    assert {(r.n_links, r.component_id) for r in found} == {(2_999, 0)} and sum(r.kept for r in found) == 1


def _plain_codes(rows, parts=4, entries=256, rounds=4):
    """Every part meets every entry in every round."""
    kept = sorted(((i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)),
                  key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = -(-max(len(v) for _, v, _ in kept) // parts)
    whole = [[math.floor(1024 * x) for x in v] + [0] * (width * parts - len(v)) for _, v, _ in kept]
    cut = [[w[p * width:(p + 1) * width] for p in range(parts)] for w in whole]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    for i in range(rounds + 1):
        codes, errors = [], []
        for c in cut:
            near = [min((sum((a - b) ** 2 for a, b in zip(c[p], e, strict=True)), k) for k, e in enumerate(books[p])) for p in range(parts)]
            codes.append([k for _, k in near])
            errors.append(sum(d for d, _ in near))
        if i < rounds:
            books = [[[sum(x) // len(own) for x in zip(*own, strict=True)] if (own := [c[p] for c, k in zip(cut, codes, strict=True) if k[p] == e])
                      else books[p][e] for e in range(len(books[p]))] for p in range(parts)]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    total = {}
    for (_, _, label), e in zip(kept, errors, strict=True):
        total[label] = total.get(label, 0) + e
    return sorted(((r[0], "".join(f"{k:02x}" for k in c), e, total[r[2]], digest) for r, c, e in zip(kept, codes, errors, strict=True)), key=str)


@pytest.mark.parametrize("entries", [256, 5])
def test_codes_equal_plain_lloyd(spark, entries):
    rng = random.Random(8)
    rows = [(k // 2 if k > 90 else 200 - k, [rng.choice([-1.5, 0.25, 0.0, 1 / 3, rng.uniform(-2, 2)]) for _ in range(6)], rng.choice([1, 2, None]))
            for k in range(130)]
    rows += [(None, [0.1] * 6, 1), (None, [0.1] * 3, 1), (5, [], 2), (6, None, 1), (7, [None] * 6, 1), (8, [float("nan")] * 6, 1), (9, [float("-inf")] * 6, 1)]
    df = _vectors(spark, rows, SCHEMA.replace("float", "double"))
    found = sorted((tuple(r) for r in vector_codes.code_report(df, entries=entries).collect()), key=str)
    assert found == _plain_codes(rows, entries=entries)


def test_codes_of_nothing_and_of_huge_components(spark):
    assert vector_codes.code_report(_vectors(spark, [])).count() == 0
    assert vector_codes.code_report(_vectors(spark, [(1, None, 1)])).count() == 0
    found = vector_codes.code_report(_vectors(spark, [(1, [3e38, -3e38, 0.0, 1.0], 1), (2, [-3e38, 3e38, 0.0, 1.0], 1)]), entries=1).collect()
    assert {r.code for r in found} == {"00000000"} and all(0 < r.error < 1 << 62 for r in found)


def test_active_entries_give_what_whole_scans_give():
    rng = np.random.default_rng(4)
    x = rng.integers(-6, 7, (500, 2))  # many equal distances
    entries = x[:40].copy()
    code, distance, moved = np.full(500, -1, np.int32), np.zeros(500, np.int64), np.ones(40, bool)
    for _ in range(12):
        vector_codes.assign(x, entries, moved, code, distance)
        every = ((x[:, None] - entries) ** 2).sum(axis=2)
        assert (code == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
        after = entries.copy()
        moved = np.zeros(40, bool)
        moved[rng.integers(0, 40, 9)] = True
        after[moved] += rng.integers(-1, 2, (int(moved.sum()), 2))
        moved, entries = (after != entries).any(axis=1), after
    assert (vector_codes.squared(x * 10**7, entries * 10**7) == every * 0 + ((x[:, None] - entries) ** 2).sum(axis=2) * 10**14).all()


def test_whole_numbers_floor_pad_and_bound():
    got = vector_codes.whole_numbers(pa.array([[-0.0001, 0.9999, 2.0], [1e300]], pa.list_(pa.float64())), 1, 4, 1024)
    assert got.tolist() == [[[-1], [1023], [2048], [0]], [[vector_codes.bound(1)], [0], [0], [0]]]


DOCS = [
    (1, "a b c", "en"), (2, "a b c", "fr"), (3, "a b c", "en"), (4, None, "en"), (5, "", None), (6, " \t\n", ""), (None, "a b c", "en"), (None, "a b c", "de"),
    (7, "Some Words # and A SIGN", "fr"), (8, " ".join(f"word{i}" for i in range(300)), "en"), (9, " ".join(f"word{i}" for i in range(300)), "en"),
    (10, " ".join(f"word{i % 7}" for i in range(70_000)), "en"), (11, "é " * 250 + "|", "fr"), (11, "é " * 250 + "|", "fr"), (12, "AAA " * 200, "en"),
    (13, "x y " * 210, "en"), (13, "other", "en")]
LABELS = [(1, 1, 0), (2, 0, 1), (3, 1, 1), (3, 0, 0), (8, 1, None), (9, None, 1), (11, 1, 1), (None, 1, 1), (99, 1, 1)]


def _played_out(docs, labels):
    rows = []
    for doc, text, part in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        smaller = any(o is not None and doc is not None and o < doc and (t or "") == text for o, t, _ in docs)
        fails = {f for f, c in zip("ABCDE", [
            len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            bool(re.search(r"[#$%&*|]", text)), smaller], strict=True) if c}
        good = doc is not None and any(d == doc and q == 1 for d, q, _ in labels)
        toxic = doc is not None and any(d == doc and t == 1 for d, _, t in labels)
        rows.append((part or "", fails, good, toxic))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(f in r[1] for r in own) - len(gone), sum(r[1] == {f} for r in own),
                    sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for (p, order, step), values in out.items():
            if p == part:
                values.append(shapley[order[step - 1]])
    return out


def test_audit_equals_playing_every_order_out(spark):
    docs = spark.createDataFrame([(*d, "old", 3) for d in DOCS], "doc_id long, text string, lang string, part string, n long")
    labels = spark.createDataFrame([(*x, 1) for x in LABELS], "doc_id long, quality int, toxic int, key int")
    rows = filter_audit.audit(filter_audit.failures(docs, labels)).collect()
    found = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in rows}
    assert found == _played_out(DOCS, LABELS) and len(rows) == len(found)


def test_audit_of_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(filter_audit.failures(docs, labels)).count() == 0
    one = filter_audit.audit(filter_audit.failures(spark.createDataFrame([(1, "x", "en")], docs.schema), labels))
    assert one.count() == 600 and one.where("filter_order = 'ABCDE' AND step = 1").first().removed == 1


def test_audit_of_other_filters(spark):
    counts = spark.createDataFrame([("", 3, True, False, 5), ("", 1, False, False, 2), ("", 0, False, False, 4)],
                                   "part string, mask int, good boolean, toxic boolean, n long")
    rows = {(r.filter_order, r.step): (r.removed, r.shapley) for r in filter_audit.audit(counts, "XY").collect()}
    assert rows == {("XY", 1): (7, 9), ("XY", 2): (0, 5), ("YX", 1): (5, 5), ("YX", 2): (2, 9)}
    with pytest.raises(ValueError):
        filter_audit.audit(counts, "AA")
