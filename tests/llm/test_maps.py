"""Operators that work row by row: pieces, notices, decontamination."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
import sentencepiece

from limnograph.llm import decontaminate, notices, pieces
from limnograph.llm.common import plain_words
from limnograph.llm.queries import QUERIES
from tests.llm.cases import CLASHING, LONG, TEXTS, documents


def _plain_best(table, text, unknown):
    """Best score of a segmentation, by looking at every substring."""
    score = [0.0] + [float("-inf")] * len(text)
    for j in range(1, len(text) + 1):
        score[j] = score[j - 1] + unknown
        for i in range(max(0, j - 24), j):
            if text[i:j] in table:
                score[j] = max(score[j], score[i] + table[text[i:j]])
    return score[-1]


def _score(vocabulary, ids, unknown):
    scored, byte_ids = vocabulary
    total, data = 0.0, b""
    for i in ids:
        if i in byte_ids:
            data += bytes([byte_ids.index(i)])
        else:
            total += scored[i][1]
    return total + unknown * len(data.decode())


def test_best_score_equals_plain_dynamic_program():
    rng = random.Random(3)
    scored = [None, *[("".join(p), -float(rng.randint(1, 30))) for p in
                      {tuple(rng.choices("ab▁c", k=rng.randint(1, 4))) for _ in range(25)}]]
    byte_ids = list(range(len(scored), len(scored) + 256))
    vocabulary = (scored + [None] * 256, byte_ids)
    made = pieces.Pieces(*vocabulary)
    table = {p: s for p, s in filter(None, scored)}
    unknown = min(table.values()) - pieces.UNKNOWN
    for _ in range(300):
        text = "".join(rng.choices("abcx ", k=rng.randint(0, 12)))
        ids = made.encode(text)
        assert made.decode(ids) == text
        if text:
            marked = "▁" + text.replace(" ", "▁")
            spaces = _score(vocabulary, ids, unknown)
            assert spaces == pytest.approx(_plain_best(table, marked, unknown))


def test_stretches_do_not_change_the_public_vocabulary_s_best_score():
    vocabulary = pieces.read_model(pieces.MODEL)
    made = pieces.Pieces(*vocabulary)
    table = {p: s for p, s in filter(None, vocabulary[0])}
    unknown = min(table.values()) - pieces.UNKNOWN
    for text in ["Hello, world!  x_1 = 2² m²s", "ça va? (très) bien...\n\nfin", "a  b   c", "x" * 40, "Größe 漢字"]:
        whole = made.best("▁" + text.replace(" ", "▁"))
        assert _score(vocabulary, whole, unknown) == pytest.approx(_score(vocabulary, made.encode(text), unknown))
        assert _score(vocabulary, whole, unknown) == pytest.approx(_plain_best(table, "▁" + text.replace(" ", "▁"), unknown))


def test_pieces_round_trip_and_awkward_rows(spark):
    docs = documents(spark)
    encoded = pieces.encode(docs)
    assert set(encoded.columns) == set(docs.columns)
    decoded = pieces.decode(encoded).select("doc_id", "text", "ids", "n_tokens", "decoded").collect()
    assert len(decoded) == len(TEXTS)
    for r in decoded:
        assert r.decoded == r.text
        assert r.n_tokens == len(r.ids or ())
        assert (r.ids is None) == (r.text is None)
    assert pieces.encode(documents(spark, [])).count() == 0
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    assert sp.decode(decoded[0].ids) == decoded[0].text


def _brute_decontaminate(text, items, window=13):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    hit, names = set(), set()
    for item, body in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (body or "").lower())
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            for p in range(len(words) - n + 1):
                if words[p:p + n] == w[i:i + n]:
                    hit |= set(range(p, p + n))
                    names |= {str(item)} - {"None"}
    return (len(words), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(),
            bool(hit) and 20 * len(hit) >= len(words))


ITEMS = [(1, "one two three four five six seven eight nine ten eleven twelve thirteen extra"), (2, "same TEXT"), (3, ""),
         (4, None), (None, "an idiot"), (10, "same text here"), (10, "same text here"), (12, "a b a b a b a b a b a b a b a b a b")]


@pytest.mark.parametrize("block_bytes", [decontaminate.BLOCK_BYTES, 20])
def test_decontaminate_equals_brute_force(spark, block_bytes):
    rng = random.Random(1)
    rows = [r for r in TEXTS if r[1] != LONG] + [(100 + i, " ".join(rng.choices(["a", "b", "same", "text"], k=40))) for i in range(30)]
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = decontaminate.decontaminate(documents(spark, rows), items, block_bytes=block_bytes)
    assert set(CLASHING) <= set(out.columns) | {"items"}
    found = sorted((str(r.doc_id), r.text or "", r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in out.collect())
    assert found == sorted((str(d), t or "", *_brute_decontaminate(t, ITEMS)) for d, t in rows)


@pytest.mark.parametrize("block_bytes", [decontaminate.BLOCK_BYTES, 20])
def test_decontaminate_takes_one_python_worker_of_a_task(spark, block_bytes):
    """Two steps in Python in one task keep two workers each, which all later stages use and fill in turn."""
    words = "One2 two\u00a0three, FOUR-five \U0001f600six\x00seven _eight `nine {ten [eleven @twelve :thirteen /"
    docs = spark.createDataFrame([(1, "x", 7, words), (2, "y", 8, None), (3, "z", 9, "\u00e9\U0001f600 a")],
                                 "doc_id long, items string, N_HIT int, text string")
    items = spark.createDataFrame([(1, words), (2, "a b"), (3, "\u00e9\U0001f600")], "item_id long, text string")
    out = decontaminate.decontaminate(docs, items, block_bytes=block_bytes)
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert out.columns == ["doc_id", "text", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"]
    n = len(plain_words(words).split())
    assert [tuple(r) for r in out.orderBy("doc_id").select("doc_id", "n_words", "n_hit", "n_items").collect()] == \
        [(1, n, n, 1), (2, 0, 0, 0), (3, 2, 1, 1)]


def test_decontaminate_empty_tables_and_removed_spans(spark):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in decontaminate.decontaminate(documents(spark), empty).collect()} == {0}
    items = spark.createDataFrame([(1, "Same text")], "item_id long, text string")
    assert decontaminate.decontaminate(documents(spark, []), items).count() == 0
    cut = decontaminate.remove_spans(decontaminate.decontaminate(
        documents(spark, [(1, "Oh, same (TEXT) here."), (2, None), (3, "other")]), items))
    assert {r.doc_id: r.text for r in cut.collect()} == {1: "Oh, ) here.", 2: None, 3: "other"}


def _distance_within(phrase, text, errors):
    """Whether a substring of ``text`` is within ``errors`` edits of ``phrase``."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(phrase, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row) <= errors


def test_fuzzy_notices_equal_brute_force():
    rng = random.Random(5)
    some = (notices.Notice("x", "released under the mit license", 3), notices.Notice("y", "all rights reserved", 2))
    find = notices.Searcher(some)
    for _ in range(200):
        base = rng.choice(some).phrase
        for _ in range(rng.randint(0, 5)):
            i = rng.randrange(len(base))
            base = base[:i] + rng.choice(["", "q", "zz", " "]) + base[i + rng.randint(0, 1):]
        text = " ".join(("filler words " + base + " more words").split())
        found = {some[m[3]].label for m in find.search(text)}
        assert found == {n.label for n in some if _distance_within(n.phrase, text, n.errors)}


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("text", ["all right reserved all rights reserved", "all rights reserved all right reserved",
                                  "all rght reserved all right reserved all rights reserved all ights reserved"])
def test_notices_with_more_errors_beside_better_ones(text):
    notice = notices.Notice("x", "all rights reserved", 2)
    assert len(notices.Searcher((notice,)).search(text)) == text.count("reserved")


def test_repeated_notices_equal_brute_force():
    rng = random.Random(9)
    some = (notices.Notice("x", "licensed under cc by nc 4 0", 2), notices.Notice("y", "all rights reserved", 1))
    for _ in range(60):
        notice = rng.choice(some)
        copies = []
        for _ in range(rng.randint(2, 6)):
            own = notice.phrase
            for _ in range(rng.randint(0, notice.errors)):
                i = rng.randrange(1, len(own) - 1)
                own = own[:i] + rng.choice(["", "q", "z"]) + own[i + rng.randint(0, 1):]
            copies.append(own if "  " not in own else notice.phrase)
        text = " ".join(" ".join(rng.choice(["", "all", "cc by"]) + " " + c for c in copies).split())
        found = notices.Searcher((notice,)).search(text)
        assert all(e == _distance(notice.phrase, text[a:b]) for a, b, e, _ in found)
        assert all(x[1] <= y[0] for x, y in zip(found, found[1:], strict=False))
        ends = [0, *[x for a, b, *_ in found for x in (a, b)], len(text)]
        for a, b in zip(ends[::2], ends[1::2], strict=True):
            assert not _distance_within(notice.phrase, text[a:b], notice.errors)
        at = 0
        for own in copies:  # each copy is met by a match with no more errors than it has itself
            at = text.index(own, at)
            assert any(a < at + len(own) and at < b and e <= _distance(notice.phrase, own) for a, b, e, _ in found)
            at += len(own)


def test_notices_spans_and_awkward_rows(spark):
    out = {(r.doc_id, r.text): r for r in notices.find_notices(documents(spark)).collect()}
    first = next(r for r in out.values() if r.doc_id == 1)
    spans = {(m.phrase, m.first_word, first.text[m.start:m.stop], m.errors) for m in first.notices}
    assert ("mit license", 3, "MIT License", 0) in spans
    assert ("released under the mit license", 0, "Released under the MIT License", 0) in spans
    assert {r.n_words for k, r in out.items() if k[0] in (2, 3, 4)} == {0}
    assert notices.find_notices(documents(spark, [])).count() == 0
    near = notices.find_notices(documents(spark, [(1, "x mit license mit  LICENSE; summit license. Relesed under the MITT license")]))
    row = near.collect()[0]
    assert [m.first_word for m in row.notices if m.phrase == "mit license" and m.exact] == [1, 3]
    assert any(m.errors == 2 and m.label == "mit" for m in row.notices)


def test_pieces_query_decodes_every_document(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    out = QUERIES["op10_pieces"](spark, folder).collect()
    assert len(out) == len(texts) and all(r.same for r in out)
    assert all(r.n_decoded == len(texts[r.doc_id]) for r in out)
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in out)
