"""DuckDB SQL of the queries that SQL can express; the others are tested against brute force."""

from __future__ import annotations

from hitlytics.llm import decontaminate, negatives, prefixes, topk, urls, vectors, warc

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def url_rules() -> str:
    """Base rules by text comparison, longest first, then the sites' expressions."""
    base = sorted(urls.BASE_RULES, key=lambda r: -len(r.name))
    fits = {}
    for rule in base:
        host, slash, path = rule.name.partition("/")
        fits[rule.name] = f"((host = {_text(host)} OR ends_with(host, {_text('.' + host)})) AND starts_with(path, {_text(slash + path)}))"
    named = " ".join(f"WHEN {c} THEN {_text(n)}" for n, c in fits.items())
    verdicts = " ".join(f"WHEN {fits[r.name]} THEN {_text(r.verdict)}" for r in base)
    sites = " OR ".join(f"regexp_matches(host || path, {_text(r.pattern)})" for r in urls.SITE_RULES)
    return f"""
WITH parts AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages)
SELECT page_id, host, path, CASE {named} END AS rule,
       CASE {verdicts} WHEN {sites} THEN 'block' ELSE 'allow' END AS verdict
FROM parts"""


WARC_TRANSACTIONS = f"""
WITH payloads AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
firsts AS (SELECT *, CASE WHEN n >= {warc.REVISIT_BYTES} THEN min(page_id) OVER (PARTITION BY digest) END AS first FROM payloads)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM firsts"""

_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

BENCHMARK_WINDOWS = f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS words FROM benchmark),
sized AS (SELECT *, least(len(words), {decontaminate.WINDOW_WORDS}) AS size FROM items WHERE len(words) > 0),
item_at AS (SELECT *, unnest(range(1, len(words) - size + 2)) AS i FROM sized),
windows AS (SELECT DISTINCT item, size, array_to_string(words[i:i + size - 1], ' ') AS win FROM item_at),
docs AS (SELECT doc_id, {_WORDS} AS words FROM documents),
sizes AS (SELECT DISTINCT size FROM windows),
doc_at AS (SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM docs, sizes WHERE len(words) >= size),
hits AS (SELECT doc_id, i, d.size, item FROM (SELECT doc_id, i, size, array_to_string(words[i:i + size - 1], ' ') AS win FROM doc_at) d JOIN windows w ON d.win = w.win),
covered AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS w FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND {decontaminate.CLEAN_SHARE} * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)"""


_VECTORS = f"""vectors AS (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor({vectors.SCALE} * CAST(x AS DOUBLE))) AS vec
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"""

THRESHOLD_TOP_K = f"""
WITH {_VECTORS},
scored AS (
  SELECT q.vec_id AS query_id, q.r, c.vec_id, CAST(list_inner_product(q.vec, c.vec) AS BIGINT) AS score
  FROM vectors q JOIN vectors c ON q.r <> c.r WHERE q.vec_id % {topk.QUERY_STEP} = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM scored) WHERE rank <= {topk.K}"""

INVERTED_NEGATIVES = f"""
WITH {_VECTORS},
labelled AS (SELECT r, vec_id, vec, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label FROM vectors WHERE label IS NOT NULL),
scored AS (
  SELECT a.r, a.vec_id AS anchor_id, c.r AS other, c.vec_id, c.label = a.label AS same, CAST(list_inner_product(a.vec, c.vec) AS BIGINT) AS score
  FROM labelled a JOIN labelled c ON a.r <> c.r WHERE a.vec_id % {negatives.ANCHOR_STEP} = 0),
positives AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM scored WHERE same)
  WHERE rank <= {negatives.POSITIVES}),
ranked AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, n.vec_id AS negative_id, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.r, p.rank ORDER BY n.score DESC, n.vec_id NULLS LAST) AS rank
  FROM positives p JOIN scored n ON p.r = n.r AND NOT n.same
    AND {negatives.LEAST} * p.score <= {negatives.MOST} * n.score AND n.score <= p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= {negatives.NEGATIVES}"""

# DuckDB has no crc32. Fixed value: its polynomial. Each character of an id is eight steps after its own.
_CRC32 = """xor(list_reduce(
    flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda crc, b: CASE WHEN b >= 0 THEN xor(crc, b) ELSE xor(crc >> 1, 3988292384 * (crc & 1)) END, 4294967295), 4294967295)"""

PREFIX_TRIE = f"""
WITH turns AS (
  SELECT conv_id, turn, md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS digest,
         len(regexp_extract_all(coalesce(text, ''), '{prefixes.WORD}')) AS words
  FROM conversations WHERE conv_id IS NOT NULL),
ordered AS (
  SELECT conv_id, list(struct_pack(digest := digest, words := words) ORDER BY turn NULLS FIRST, digest) AS seq FROM turns GROUP BY conv_id),
shared AS (SELECT conv_id, {_CRC32} % {prefixes.HEADS} AS h FROM ordered),
rebuilt AS (
  SELECT o.conv_id, coalesce(b.seq[1:h], []) || o.seq[h + 1:] AS seq
  FROM ordered o JOIN shared s USING (conv_id) LEFT JOIN ordered b ON b.conv_id = o.conv_id - o.conv_id % {prefixes.GROUP}),
prefixes AS (
  SELECT conv_id, d, seq[1:d] AS prefix, len(seq) AS n
  FROM (SELECT conv_id, seq, unnest(range(len(seq) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT prefix, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256
  FROM prefixes GROUP BY prefix, d),
kids AS (SELECT prefix[1:depth - 1] AS prefix, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
parts AS (
  SELECT prefix, depth, CASE WHEN depth > 0 THEN (n_convs - 1) * prefix[depth].words ELSE 0 END AS saved, n_children IS NULL AS leaf
  FROM nodes LEFT JOIN kids USING (prefix)),
sums AS (
  SELECT prefix[1:d] AS prefix, sum(saved) AS saved_tokens, count(*) FILTER (leaf) AS n_leaves
  FROM (SELECT *, unnest(range(depth + 1)) AS d FROM parts) GROUP BY ALL)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children,
       n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s ON n.prefix = s.prefix LEFT JOIN kids k ON n.prefix = k.prefix
  LEFT JOIN nodes p ON n.depth > 0 AND p.prefix = n.prefix[1:n.depth - 1]"""


def statements() -> dict[str, str]:
    return {
        "op3_url_rules": url_rules(),
        "op5_warc_transactions": WARC_TRANSACTIONS,
        "op10_benchmark_windows": BENCHMARK_WINDOWS,
        "op11_inverted_negatives": INVERTED_NEGATIVES,
        "op12_prefix_trie": PREFIX_TRIE,
        "op13_threshold_top_k": THRESHOLD_TOP_K,
    }
