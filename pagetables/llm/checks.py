"""DuckDB SQL for the operators that SQL can express: plain statements of the results.

No SQL is given for 1, 2 and 7, which learn a model; 3, which takes minutes and much disk
in SQL; 4, whose hash DuckDB lacks; 8, whose sketch rounds logarithms; 9, whose order is a
seeded hash; 11 and 12, which run tokenizers; and the pipeline.  Their tests compare with brute force.
"""

from __future__ import annotations

from pagetables.llm.license_scan import CONTAINED, SHINGLE, TEMPLATES
from pagetables.llm.warc import FIRST_SECOND, SECONDS

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORDS = (
    f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
_LICENSE_WORDS = "list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '')"
_TEMPLATE_ROWS = ", ".join(f"('{name}', '{text}')" for name, text in sorted(TEMPLATES.items()))


def _shingles(source: str, keys: str) -> str:
    return f"""SELECT {keys}, i, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS g
    FROM {source}, unnest(range(1, greatest(2, len(w) - {SHINGLE} + 2))) AS t(i) WHERE len(w) > 0"""


CHECKS: dict[str, str] = {
    "op5_warc_histories": rf"""
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS payload,
                   regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www\.', '') AS host,
                   regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path,
                   regexp_extract(url, '^[^?#]*(\?[^#]+)', 1) AS query
            FROM pages
        ), d AS (
            SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes,
                   sha256(payload) AS payload_digest,
                   array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || path || query AS url_key,
                   strftime(epoch_ms(1000 * ({FIRST_SECOND} + page_id % {SECONDS})), '%Y-%m-%dT%H:%M:%SZ') AS captured_at
            FROM p
        ), f AS (
            SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN first_id END AS refers_to,
               url_key, captured_at,
               row_number() OVER (ORDER BY url_key || ' ' || captured_at || ' ' || lpad(CAST(page_id AS VARCHAR), 20, '0')) - 1
                   AS position
        FROM f
    """,
    "op6_decontamination": f"""
        WITH items AS (
            SELECT item_id, w, least(10, len(w)) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0
        ), windows AS (
            SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
            FROM items, unnest(range(1, len(w) - n + 2)) AS t(i)
        ), d AS (
            SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents
        ), grams AS (
            SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
            FROM d, (SELECT DISTINCT n FROM items) AS s, unnest(range(1, len(w) - n + 2)) AS t(i)
        ), hits AS (
            SELECT rid, n, i, item_id FROM grams JOIN windows USING (n, g)
        ), words AS (
            SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rid
        ), listed AS (
            SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
            FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY rid
        )
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN words USING (rid) LEFT JOIN listed USING (rid)
    """,
    "op10_license_scan": f"""
        WITH templates AS (
            SELECT license, {_LICENSE_WORDS} AS w FROM (VALUES {_TEMPLATE_ROWS}) AS v(license, text)
        ), wanted AS (
            SELECT license, len(w) AS length, g, min(i) - 1 AS place FROM ({_shingles("templates", "license, w")}) GROUP BY ALL
        ), sizes AS (
            SELECT license, count(*) AS size FROM wanted GROUP BY license
        ), d AS (
            SELECT row_number() OVER () AS rid, doc_id, {_LICENSE_WORDS} AS w FROM documents
        ), hits AS (
            SELECT rid, license, length, i, g, place FROM ({_shingles("d", "rid")}) JOIN wanted USING (g)
        ), stretches AS (
            SELECT a.rid, a.license, a.length, a.place, a.i AS first, max(b.i) + {SHINGLE} AS stop, count(DISTINCT b.g) AS n
            FROM hits a JOIN hits b ON a.rid = b.rid AND a.license = b.license AND b.i BETWEEN a.i AND a.i + a.length - 1
            GROUP BY ALL
        ), found AS (
            SELECT *, n / size AS share FROM stretches JOIN sizes USING (license) WHERE n >= {CONTAINED} * size
        ), early AS (
            SELECT * FROM found WHERE place <= greatest(1, length - {SHINGLE} + 1) - {CONTAINED} * size + 0.000001
        ), unbeaten AS (
            SELECT DISTINCT rid, license FROM early AS f WHERE NOT EXISTS (
                SELECT 1 FROM early AS o WHERE o.rid = f.rid AND o.license <> f.license
                AND 2 * (least(o.stop, f.stop) - greatest(o.first, f.first)) > least(o.stop - o.first, f.stop - f.first) AND (o.share > f.share
                     OR o.share = f.share AND (o.size > f.size OR o.size = f.size AND o.license < f.license)))
        ), named AS (
            SELECT rid, count(*) AS n, string_agg(license, ',' ORDER BY license) AS names
            FROM (SELECT DISTINCT rid, license FROM found) GROUP BY rid
        ), bests AS (
            SELECT rid, string_agg(license, ',' ORDER BY license) AS best FROM unbeaten GROUP BY rid
        )
        SELECT doc_id, coalesce(n, 0) AS n_licenses, coalesce(names, '') AS licenses, coalesce(best, '') AS best
        FROM d LEFT JOIN named USING (rid) LEFT JOIN bests USING (rid)
    """,
    "op13_prefix_trie": r"""
        WITH said AS (
            SELECT conv_id AS c, turn, coalesce(text, '') AS text,
                   sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS sym
            FROM conversations WHERE conv_id IS NOT NULL
        ), numbered AS (
            SELECT c, sym, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
                   row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, sym) AS pos
            FROM said
        ), heads AS (
            SELECT c, xor(list_reduce(list_prepend(4294967295, flatten(
                [[(ord(x) >> j) & 1 for j in range(0, 8)] for x in string_split(CAST(c AS VARCHAR), '')])),
                lambda a, b: xor(a >> 1, CASE WHEN xor(a, b) & 1 = 1 THEN 3988292384 ELSE 0 END)), 4294967295) % 4 AS h
            FROM (SELECT DISTINCT c FROM numbered)
        ), turns AS (
            SELECT h.c, n.pos, 0 AS part, n.sym, n.words FROM heads h JOIN numbered n ON n.c = h.c - h.c % 20 AND n.pos <= h.h
            UNION ALL
            SELECT h.c, n.pos, 1 AS part, n.sym, n.words FROM heads h JOIN numbered n ON n.c = h.c AND n.pos > h.h
        ), prefixes AS (
            SELECT c, row_number() OVER w AS d, string_agg(sym, '') OVER w AS k, words FROM turns
            WINDOW w AS (PARTITION BY c ORDER BY part, pos)
            UNION ALL SELECT c, 0, '', 0 FROM heads
        ), members AS (
            SELECT *, d = max(d) OVER (PARTITION BY c) AS is_end FROM prefixes
        ), nodes AS (
            SELECT d, k, min(c) AS c, count(*) AS n, any_value(words) AS words,
                   coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (is_end), '') AS ends
            FROM members GROUP BY d, k
        ), children AS (
            SELECT d - 1 AS d, left(k, 64 * (d - 1)) AS k, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1, 2
        ), above AS (
            SELECT left(nodes.k, 64 * t.i) AS k, t.i AS d, sum((nodes.n - 1) * words) AS saved,
                   count(*) FILTER (children.n IS NULL) AS leaves
            FROM nodes LEFT JOIN children USING (d, k), unnest(range(0, nodes.d + 1)) AS t(i) GROUP BY 1, 2
        )
        SELECT nodes.c AS conv_id, nodes.d AS depth, parents.c AS parent_conv_id, nodes.n AS n_convs,
               coalesce(children.n, 0) AS n_children, above.leaves AS n_leaves, CAST(above.saved AS BIGINT) AS saved_tokens,
               sha256(nodes.ends) AS ends_sha256
        FROM nodes LEFT JOIN children ON children.d = nodes.d AND children.k = nodes.k
        JOIN above ON above.d = nodes.d AND above.k = nodes.k
        LEFT JOIN (SELECT d + 1 AS d, k AS up, c FROM nodes) AS parents
               ON parents.d = nodes.d AND parents.up = left(nodes.k, 64 * (nodes.d - 1)) AND nodes.d > 0
    """,
}
