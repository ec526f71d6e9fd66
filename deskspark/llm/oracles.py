"""The results of some queries as SQL over the same tables."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op1_decontaminate"] = r"""
WITH letters AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS upper_, 'abcdefghijklmnopqrstuvwxyz' AS lower_),
d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), upper_, lower_), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents, letters),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), upper_, lower_), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark, letters),
windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
spots AS (
  SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
hits AS (SELECT r, i, n, item FROM spots JOIN windows USING (n, win)),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""

ORACLES["op5_warc"] = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
digests AS (
  SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS hex,
         min(page_id) OVER (PARTITION BY body) AS first_id
  FROM p),
letters AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567' AS abc)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       array_to_string([
         substr(abc, CAST((CAST('0x' || substr(hex, 1 + 5 * (k // 4), 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31 AS INTEGER) + 1, 1)
         for k in range(32)], '') AS payload_digest,
       CASE WHEN first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM digests, letters
"""

ORACLES["op8_suffix_dedup"] = """
WITH b AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h,
         octet_length(encode(coalesce(text, ''))) AS n
  FROM documents),
win AS (
  SELECT r, doc_id, i, substr(h, 2 * i + 1, 100) AS s
  FROM (SELECT r, doc_id, h, unnest(range(0, n - 49)) AS i FROM b WHERE n >= 50)),
least_ AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
gone AS (
  SELECT DISTINCT r, i + k AS p
  FROM (SELECT r, i, unnest(range(0, 50)) AS k FROM win JOIN least_ USING (s) WHERE m < doc_id)),
runs AS (
  SELECT r, count(*) AS n_removed, count(*) FILTER (WHERE before IS NULL OR before < p - 1) AS n_spans
  FROM (SELECT r, p, lag(p) OVER (PARTITION BY r ORDER BY p) AS before FROM gone) GROUP BY r),
kept AS (
  SELECT r, string_agg(substr(h, 2 * p + 1, 2), '' ORDER BY p) AS rest
  FROM (SELECT r, h, unnest(range(0, n)) AS p FROM b WHERE r IN (SELECT r FROM gone)) ANTI JOIN gone USING (r, p)
  GROUP BY r)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN n_removed IS NULL THEN h ELSE coalesce(rest, '') END)) AS kept_sha256
FROM b LEFT JOIN runs USING (r) LEFT JOIN kept USING (r)
"""


def _clusters(rounds: int) -> str:
    """Every vector measured against every centroid, round after round."""
    parts = [
        """p AS (
  SELECT row_number() OVER () AS r, vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v
  FROM embeddings
  WHERE len(embedding) = 64 AND len([x for x in embedding if x IS NOT NULL AND isfinite(CAST(x AS DOUBLE))]) = 64),
x AS (SELECT r, unnest(range(1, 65)) AS i, unnest(v) AS x FROM p),
starts AS (
  SELECT r, row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS c FROM p),
c0 AS (SELECT c, i, x AS y FROM x JOIN starts USING (r) WHERE c < 16)"""
    ]
    for t in range(rounds + 1):
        parts.append(
            f"""d{t} AS (SELECT r, c, sum((x - y) * (x - y)) AS d FROM x JOIN c{t} USING (i) GROUP BY r, c),
a{t} AS (
  SELECT r, c, d FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY d, c) AS place FROM d{t}) WHERE place = 1)"""
        )
        if t < rounds:
            parts.append(
                f"""m{t} AS (
  SELECT c, i, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS y
  FROM x JOIN a{t} USING (r) GROUP BY c, i),
c{t + 1} AS (SELECT c, i, coalesce(m{t}.y, c{t}.y) AS y FROM c{t} LEFT JOIN m{t} USING (c, i))"""
            )
    return (
        "WITH "
        + ",\n".join(parts)
        + f"""
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance,
       CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, told AS centroid_sha256
FROM p JOIN a{rounds} USING (r)
JOIN (SELECT c, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY i)) AS told FROM c{rounds} GROUP BY c) USING (c)
"""
    )


ORACLES["op11_clusters"] = _clusters(3)

ORACLES["op12_fill_middle"] = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
draws AS (
  SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS one, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS two,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS three, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS four
  FROM d),
cuts AS (
  SELECT *, least(one, two) AS a, greatest(one, two) AS b,
         CASE WHEN n = 0 OR three >= 90 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain'
              WHEN four < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM draws),
parts AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM cuts)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""
