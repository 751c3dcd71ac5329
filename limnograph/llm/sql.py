"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOW + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_DIGEST = """list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(sha1(payload), 1 + 5 * (i // 4)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT, 1)),
    'string_agg', '')"""

OP1 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, url FROM pages),
d AS (SELECT page_id, url, strlen(payload) AS payload_bytes, {_DIGEST} AS payload_digest,
             min(page_id) OVER (PARTITION BY payload) AS first_id FROM p),
h AS (SELECT *, regexp_replace(url, '^.*?://', '', 's') AS rest FROM d),
k AS (SELECT *, {_LOW.format("regexp_extract(rest, '^[^/?#]*')")} AS host FROM h),
u AS (SELECT *, CASE WHEN url IS NULL THEN '' ELSE
    array_to_string(list_reverse(string_split(CASE WHEN contains(url, '://') THEN host ELSE '' END, '.')), ',') || ')' ||
    CASE WHEN contains(url, '://') THEN regexp_extract(substr(rest, length(host) + 1), '^[^?#]*') ELSE '' END ||
    regexp_extract(url, '^[^?#]*(\\?[^#]*)', 1) END AS urlkey,
    strftime(to_timestamp(1577836800 + page_id) AT TIME ZONE 'UTC', '%Y%m%d%H%M%S') AS captured FROM k)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to, urlkey, captured,
       row_number() OVER (ORDER BY urlkey, captured, page_id) - 1 AS position
FROM u
"""

OP8 = f"""
WITH r(rh, rp, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                             ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
h AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
k AS (SELECT page_id, {_LOW.format("regexp_extract(rest, '^[^/?#]*')")} AS host,
             regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM h),
m AS (SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS v
      FROM k JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(v, 'allow') AS verdict
FROM k LEFT JOIN m USING (page_id)
"""

OP9 = f"""
WITH i AS (SELECT item_id, {_WORDS.format("coalesce(text, '')")} AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[p:p + least(13, len(w)) - 1], ' ') AS gram
      FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)),
d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
z AS (SELECT DISTINCT n FROM g),
a AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS gram
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, z WHERE len(w) >= n)),
t AS (SELECT a.doc_id, a.n, a.p, g.item_id FROM a JOIN g ON a.gram = g.gram AND a.n = g.n),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM t) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM t) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN s USING (doc_id)
"""

_FINITE = "len(list_filter({0}, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

#: All pairs of equal labels; the forest equals it where it parts no near pair.
OP11 = f"""
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND {_FINITE.format("e")} AND len(list_filter(e, lambda x: x <> 0)) > 0),
p AS MATERIALIZED (SELECT a.vec_id AS u, b.vec_id AS w FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) >= 0.93 ELSE false END),
r AS (SELECT vec_id AS u, vec_id AS root FROM v UNION SELECT p.w, r.root FROM r JOIN p ON p.u = r.u),
c AS (SELECT u AS vec_id, min(root) AS component_id FROM r GROUP BY u),
n AS (SELECT u AS vec_id, count(*) AS n_links FROM p GROUP BY u)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""


def _assigned(i: int) -> str:
    """The nearest entry of each part, as distance * 256 + entry."""
    return f"""a{i} AS MATERIALIZED (SELECT vec_id, part, min(d * 256 + entry) AS best FROM (
    SELECT vec_id, x.part, entry, sum((x - c) * (x - c))::BIGINT AS d FROM x JOIN b{i} AS b ON x.part = b.part AND x.pos = b.pos
    GROUP BY vec_id, x.part, entry) GROUP BY vec_id, part)"""


def _updated(i: int) -> str:
    return f"""b{i + 1} AS MATERIALIZED (SELECT b.part, b.entry, b.pos, coalesce(u.c, b.c) AS c FROM b{i} AS b LEFT JOIN (
    SELECT x.part, best % 256 AS entry, pos, floor(sum(x)::DOUBLE / count(*))::BIGINT AS c
    FROM x JOIN a{i} USING (vec_id, part) GROUP BY x.part, best % 256, pos) AS u
    ON b.part = u.part AND b.entry = u.entry AND b.pos = u.pos)"""


OP12 = f"""
WITH k AS MATERIALIZED (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND {_FINITE.format("embedding")}),
m AS MATERIALIZED (SELECT ceil(max(len(e)) / 4.0)::INT AS w FROM k),
x AS MATERIALIZED (SELECT vec_id, i // w AS part, i % w AS pos, floor(1024 * coalesce(e[i + 1], 0))::BIGINT AS x
    FROM (SELECT vec_id, e, w, unnest(range(0, 4 * w)) AS i FROM k, m)),
f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k QUALIFY entry < 256),
b0 AS MATERIALIZED (SELECT part, entry, pos, x AS c FROM x JOIN f USING (vec_id)),
{", ".join(f"{_assigned(i)}, {_updated(i)}" for i in range(4))}, {_assigned(4)},
e AS (SELECT vec_id, string_agg(printf('%02x', (best % 256)::INT), '' ORDER BY part) AS code, sum(best // 256)::BIGINT AS error FROM a4 GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY part, entry, pos)) FROM b4) AS codebooks_sha256
FROM e JOIN k USING (vec_id)
"""

_TOKENS = r"list_filter(string_split_regex(body, '[\x20\x09-\x0D]+'), lambda w: w <> '')"

#: Every order is played out over the documents by the sets of filters that they fail.
OP13 = f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body FROM documents),
w AS (SELECT *, {_TOKENS} AS words, min(doc_id) OVER (PARTITION BY body) AS first_id FROM d),
f AS (SELECT doc_id, part,
    (CASE WHEN len(words) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 3 * length(body) THEN 4 ELSE 0 END)
    + (CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 8 ELSE 0 END) + (CASE WHEN doc_id > first_id THEN 16 ELSE 0 END) AS mask FROM w),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
c AS MATERIALIZED (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
    FROM f LEFT JOIN l USING (doc_id) GROUP BY part, mask),
b(ch, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT p.ch || q.ch || r.ch || s.ch || t.ch AS filter_order, [p.bit, q.bit, r.bit, s.bit, t.bit] AS bits
    FROM b p, b q, b r, b s, b t WHERE p.bit | q.bit | r.bit | s.bit | t.bit = 31),
z AS (SELECT filter_order, step::INT AS step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before
    FROM (SELECT *, unnest(range(1, 6)) AS step FROM o)),
g AS (SELECT part, filter_order, step, any_value(bit) AS bit,
    sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
    FROM c, z GROUP BY part, filter_order, step)
SELECT * EXCLUDE (bit), (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM g
"""

SQL = {"op1_warc_index": OP1, "op8_url_rules": OP8, "op9_decontaminate": OP9, "op11_embedding_forest": OP11,
       "op12_vector_codes": OP12, "op13_filter_audit": OP13}
