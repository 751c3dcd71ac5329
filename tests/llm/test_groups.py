"""Operators that shuffle: index merge, training order, I-Match, SimHash, URL rules."""

from __future__ import annotations

import base64
import hashlib
import random
import re
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from limnograph.llm import imatch, simhash, training_order, url_rules, warc_index
from tests.llm.cases import LONG, TEXTS, documents

PAGES = [(1, "http://b.example.com/x?q=1#f", "same"), (2, None, "same"), (3, "http://b.example.com/x?q=1", None), (4, "no scheme", ""),
         (5, "http://B.example.com:80", "WARC/1.1\r\n\r\nWARC-Type: response\r\n\r\n"), (6, "http://a b.com/\r\n", LONG),
         (None, "http://a.org/", "same"), (7, "http://a.org/", "only"), (7, "http://a.org/", "only"), (8, "http://é.org/ü", "ü 漢 \x00")]


def _captures(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, payload string") \
        .withColumn("captured", F.timestamp_seconds(F.coalesce("page_id", F.lit(0)) % 3)).withColumn("digest", F.lit("old"))


def test_index_merge_equals_plain_sort(spark):
    rows = warc_index.capture_history(_captures(spark, PAGES)).orderBy("position").collect()
    assert [r.position for r in rows] == list(range(len(PAGES)))
    keys = [(r.urlkey, r.captured, r.page_id is not None, r.page_id or 0) for r in rows]
    assert keys == sorted(keys)
    found = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in rows)
    expected = []
    for page, _, payload in PAGES:
        data = (payload or "").encode()
        first = min(p for p, _, x in PAGES if (x or "") == (payload or "") and p is not None)
        refers = None if page == first else first
        expected.append((str(page), len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
                         "response" if refers is None else "revisit", str(refers)))
    assert found == sorted(expected)


def test_archives_hold_the_payloads_and_survive_empty_tables(spark, tmp_path):
    folder = str(tmp_path / "warc")
    warc_index.write_archives(_captures(spark, PAGES), folder)
    seen = [(head["warc-type"], payload.decode()) for f in Path(folder).glob("*.gz")
            for _, _, head, _, payload in warc_index.records(f.read_bytes())]
    assert sorted(p for kind, p in seen if kind == "response") == sorted([x or "" for p, _, x in PAGES if p in (1, 3, 5, 6, 7, 8)])
    assert {p for kind, p in seen if kind == "revisit"} == {""}
    assert warc_index.capture_history(_captures(spark, [])).count() == 0


def test_loser_tree_merges_any_number_of_runs():
    rng = random.Random(2)
    for k in range(9):
        runs = [sorted((rng.randint(0, 5), rng.randint(0, 5)) for _ in range(rng.randint(0, 6))) for _ in range(k)]
        assert list(warc_index.LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


@pytest.mark.parametrize("size", [1, 2, 5, 64, 1000])
def test_permutation_is_one_to_one_and_can_be_inverted(size):
    numbers = np.arange(size)
    out = training_order.permute(numbers, size, 5)
    assert sorted(out.tolist()) == list(range(size))
    assert (training_order.permute(out, size, 5, back=True) == numbers).all()
    assert size < 64 or (out != training_order.permute(numbers, size, 6)).any()


def test_shards_hold_every_token_in_slot_order(spark, tmp_path):
    layout = training_order.Layout(length=16, shard_bytes=1 << 14)
    folder = str(tmp_path / "shards")
    docs = documents(spark)
    manifest = training_order.write_shards(docs, folder, layout).collect()
    texts: dict = {}
    total = 0
    for m in sorted(manifest, key=lambda r: r.shard):
        rows = np.fromfile(m.path.removeprefix("file:"), layout.record)
        assert (m.start, m.n) == (total, len(rows))
        total += len(rows)
        for r in rows:
            assert (r["tokens"][r["n_tokens"]:] == training_order.END_OF_TEXT).all()
            texts.setdefault((int(r["doc_id"]), int(r["part"])), []).append(r["tokens"][:r["n_tokens"]])
    import tiktoken
    encoding = tiktoken.Encoding("t", pat_str=training_order.PATTERN, special_tokens={},
                                 mergeable_ranks=training_order.read_ranks(training_order.RANKS))
    for doc, text in TEXTS:
        ids = [*encoding.encode_ordinary(text or ""), training_order.END_OF_TEXT]
        for part in range(0, len(ids), 16):
            held = texts[(-1 if doc is None else doc, part // 16)]
            assert any(x.tolist() == ids[part:part + 16] for x in held)
    assert total == sum(-(-(len(encoding.encode_ordinary(t or "")) + 1) // 16) for _, t in TEXTS)
    back = training_order.read_shards(spark, folder, spark.createDataFrame(manifest), layout)
    assert sorted(r.slot for r in back.collect()) == list(range(total))
    again = training_order.write_shards(docs, str(tmp_path / "again"), layout).collect()
    assert [Path(a.path.removeprefix("file:")).read_bytes() for a in again] == \
        [Path(m.path.removeprefix("file:")).read_bytes() for m in manifest]
    assert training_order.training_order(documents(spark, []), layout).count() == 0


def test_order_does_not_depend_on_how_ids_are_numbered(spark, tmp_path):
    """Ids at both ends of 64 bits, and one id (or none) on most rows: sequences spread over the shards."""
    layout = training_order.Layout(length=16, shard_bytes=1 << 14)
    far = [(-(2**63), "a b c"), (2**63 - 1, "d e f"), (0, None)]
    manifest = training_order.write_shards(documents(spark, far), str(tmp_path / "far"), layout).collect()
    assert sum(m.n for m in manifest) == 3
    rows = [(7 if i % 3 else None, f"text number {i}") for i in range(900)]
    manifest = training_order.write_shards(documents(spark, rows), str(tmp_path / "same"), layout).collect()
    assert sum(m.n for m in manifest) == 900 and len(manifest) >= 8 and max(m.n for m in manifest) < 3 * 900 / len(manifest)


def test_imatch_edits_follow_the_next_document(spark):
    rows = [r for r in TEXTS if r[0] != 7] + [(7, "same text here")]
    out = {r.doc_id: r for r in imatch.compare_with_edits(documents(spark, rows)).collect()}
    assert len(out) == len(rows)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for (doc, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        text, after = text or "", after or ""
        edited = text[:len(text) - len(text) // 2] + after[:len(text) // 2]
        assert out[doc].n_chars == len(text)
        assert out[doc].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= out[doc].near_edited <= 1 and 0 <= out[doc].near_next <= 1
    assert out[5].fingerprint == out[6].fingerprint and out[5].near_next == 1.0
    assert out[7].fingerprint == out[8].fingerprint != out[11].fingerprint
    single = imatch.compare_with_edits(documents(spark, [(1, "abcd")])).collect()
    assert single[0].near_next == 1.0
    assert single[0].edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    assert imatch.compare_with_edits(documents(spark, [])).count() == 0
    assert imatch.compare_with_edits(documents(spark, TEXTS)).count() == len(TEXTS)


def test_imatch_lexicon_is_the_band_of_document_frequencies(spark):
    docs = documents(spark, [(i, "common " + ("half " if i % 2 else "") + f"rare{i}") for i in range(40)])
    assert sorted(imatch.lexicon(docs, imatch.Band(rare=0.1, common=0.6))) == [b"half"]


def test_imatch_likeness_grows_with_what_texts_share():
    rng = random.Random(0)
    words = [f"w{i}".encode() for i in range(600)]
    lexicon = imatch.Lexicon(words, imatch.Band())
    near, half, far = [], [], []
    for _ in range(40):
        a, b = rng.sample(words, 200), rng.sample(words, 200)
        text = lambda w: b" ".join(w).decode()
        first = lexicon.fingerprint(text(a))
        near.append(imatch.likeness(first, lexicon.fingerprint(text(a[:195] + b[:5]))))
        half.append(imatch.likeness(first, lexicon.fingerprint(text(a[:100] + b[:100]))))
        far.append(imatch.likeness(first, lexicon.fingerprint(text(b))))
    assert np.mean(near) > np.mean(half) + 0.1 > np.mean(far) + 0.2


def _brute_simhash(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    words = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    codes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(c >> b & 1 for c in codes) > len(codes))


def _brute_components(codes):
    label = {c: c for c in codes}
    changed = True
    while changed:
        changed = False
        for a in codes:
            for b in codes:
                if (a ^ b).bit_count() <= 3 and label[b] < label[a]:
                    label[a], changed = label[b], True
    return label


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(4)
    base = " ".join(rng.choices([f"t{i}" for i in range(500)], k=400))
    rows = TEXTS + [(100 + i, base.replace(f" t{i} ", " changed ", 1)) for i in range(25)]
    out = simhash.near_duplicates(documents(spark, rows)).collect()
    codes = [_brute_simhash(t) for _, t in rows]
    label = _brute_components(sorted(set(codes)))
    least = {}
    for (doc, _), c in zip(rows, codes, strict=True):
        if doc is not None:
            least[label[c]] = min(doc, least.get(label[c], doc))
    expected = [(str(d), f"{c:016x}", str(least.get(label[c]))) for (d, _), c in zip(rows, codes, strict=True)]
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in out) == sorted(expected)
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


@pytest.mark.parametrize("group", [5, 10_000])
def test_trie_join_finds_all_links_whether_or_not_groups_are_cut(spark, group):
    rng = random.Random(6)
    codes = set()
    for _ in range(25):
        code = rng.getrandbits(64)
        for _ in range(12):
            codes.add(code)
            for b in rng.sample(range(64), rng.randint(1, 4)):
                code ^= 1 << b
    center = rng.getrandbits(64)
    codes |= {center ^ sum(1 << b for b in rng.sample(range(64), 2)) for _ in range(60)}
    signed = lambda c: c - (c >> 63 << 64)
    found = simhash.links(spark.createDataFrame([(signed(c),) for c in codes], "code long"), group=group)
    roots = {r.code: r.root for r in simhash.components(found).collect()}
    label = _brute_components(sorted(codes))
    by_root, by_label = {}, {}
    for c in codes:
        by_root.setdefault(roots.get(signed(c), signed(c)), set()).add(c)
        by_label.setdefault(label[c], set()).add(c)
    assert sorted(map(sorted, by_root.values())) == sorted(map(sorted, by_label.values()))


def test_url_rules_equal_brute_force(spark):
    rng = random.Random(8)
    labels, paths = ["a", "b", "www", "com", "net"], ["/", "/x", "/x/y", "/xy", ""]
    urls = [(i, f"http://{'.'.join(rng.choices(labels, k=rng.randint(1, 4)))}{rng.choice(paths)}{rng.choice(['', '?q', '#f'])}") for i in range(300)]
    urls += [(1000 + i, "http://WWW.a.com/x/y") for i in range(200)] + [(None, None), (1, "nothing"), (2, ""), (3, "://"), (3, "://")]
    rules = [(".".join(rng.choices(labels, k=rng.randint(1, 3))), rng.choice(paths), rng.choice(["allow", "block"])) for _ in range(25)]
    rules += [(rules[0][0], rules[0][1], "block"), (None, "/", "block"), ("", "/", "block"), ("com", None, "block")]
    df = spark.createDataFrame(urls, "page_id long, url string").selectExpr("*", "'old' AS host", "1 AS c0", "2 AS data")
    out = url_rules.judge_urls(df, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    known: dict = {}
    for h, p, v in rules:
        if h:
            known[(h, p or "")] = max(v, known.get((h, p or ""), v))
    expected = []
    for page, url in urls:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0].lower()
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        fit = [k for k in known if (host == k[0] or host.endswith("." + k[0])) and path.startswith(k[1])]
        best = max(map(len, map("".join, fit)), default=0)
        expected.append((str(page), host, path, {"".join(k) for k in fit if len("".join(k)) == best}, {known[k] for k in fit if len("".join(k)) == best} or {"allow"}))
    found = sorted((str(r.page_id), r.host, r.path, r.rule, r.verdict) for r in out)
    assert len(found) == len(urls) and {r.c0 for r in out} == {1} and {r.data for r in out} == {2}
    for f, e in zip(found, sorted(expected, key=lambda x: x[:3]), strict=True):
        assert f[:3] == e[:3] and (f[3] in e[3] if e[3] else f[3] is None) and f[4] in e[4]
    assert url_rules.judge_urls(df.limit(0), spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert {r.verdict for r in url_rules.judge_urls(df, none, default="block").collect()} == {"block"}
