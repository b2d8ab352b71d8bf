"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

WORDS = r"'[^\x20\x09-\x0D]+'"
ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _level(k: int, budget: str) -> str:
    """The water-filling of a level: shares of the nodes with k + 1 names."""
    path = ", ".join(f"l{i}" for i in range(k + 1))
    node = " || '/' || ".join(f"l{i}" for i in range(k + 1))
    above = ", ".join(f"l{i}" for i in range(k))
    over = f"PARTITION BY {above}" if k else ""
    join = f"JOIN {budget} USING ({above})" if k else f"CROSS JOIN {budget}"
    return f"""
    c{k} AS (SELECT {path}, sum(cap) AS cap FROM leaf GROUP BY ALL),
    x{k} AS (SELECT c{k}.*, b, coalesce(w.w, 1.0::DOUBLE) AS w, CASE WHEN coalesce(w.w, 1.0::DOUBLE) > 0 THEN cap / coalesce(w.w, 1.0::DOUBLE) ELSE 'inf'::DOUBLE END AS r FROM c{k} {join} LEFT JOIN weights w ON w.node = {node}),
    y{k} AS (SELECT *, sum(cap) OVER ({over} ORDER BY r, {path} ROWS UNBOUNDED PRECEDING) AS cs, sum(w) OVER ({over} ORDER BY r, {path} ROWS UNBOUNDED PRECEDING) AS ws, sum(w) OVER ({over}) AS wa FROM x{k}),
    z{k} AS (SELECT *, CASE WHEN w > 0 THEN cs + r * greatest(wa - ws, 0) <= b * (1 + 1e-12) ELSE false END AS filled FROM y{k}),
    v{k} AS (SELECT *, coalesce(sum(CASE WHEN filled THEN cap END) OVER ({over}), 0) AS cf, coalesce(sum(CASE WHEN NOT filled THEN w END) OVER ({over}), 0) AS wo FROM z{k}),
    n{k} AS (SELECT {path}, greatest(CASE WHEN filled THEN cap WHEN wo > 0 THEN least(cap, w * (b - cf) / wo) ELSE 0 END, 0) AS b FROM v{k})"""


def mixing(weights: list[tuple[str, float]], budget: float, epochs: int, seed: int) -> str:
    values = ", ".join(f"('{n}', {w}::DOUBLE)" for n, w in weights)
    return f"""
    WITH d AS (SELECT doc_id, 'd' || coalesce(CAST(TRY_CAST(regexp_extract(source, '([0-9]+)', 1) AS BIGINT) % 4 AS VARCHAR), 'x') AS l0, coalesce(lang, '(null)') AS l1, coalesce(source, '(null)') AS l2, len(regexp_extract_all(coalesce(text, ''), {WORDS})) AS t FROM documents),
    leaf AS (SELECT l0, l1, l2, sum(t)::DOUBLE AS tokens, sum(t)::DOUBLE * {epochs} AS cap FROM d GROUP BY ALL),
    weights(node, w) AS (VALUES {values}),
    n AS (SELECT sum(tokens) * {budget}::DOUBLE AS b FROM leaf),
    {_level(0, "n")}, {_level(1, "n0")}, {_level(2, "n1")},
    plan AS (SELECT l0, l1, l2, tokens, b, CASE WHEN tokens > 0 THEN floor(b / tokens + 1e-9) ELSE 0 END::BIGINT AS whole FROM leaf JOIN n2 USING (l0, l1, l2)),
    o AS (SELECT d.*, whole, greatest(floor(b + 1e-6) - whole * tokens, 0) AS rest, md5('{seed}:' || whole || ':' || l0 || '/' || l1 || '/' || l2 || ':' || doc_id) AS h FROM d JOIN plan USING (l0, l1, l2)),
    r AS (SELECT *, least(whole + CAST(sum(t) OVER (PARTITION BY l0, l1, l2 ORDER BY h ROWS UNBOUNDED PRECEDING) <= rest AS BIGINT), {epochs}) AS times FROM o)
    SELECT doc_id, l0 || '/' || l1 || '/' || l2 AS leaf, CAST(t AS BIGINT) AS n_tokens, CAST(times AS BIGINT) AS times FROM r WHERE times > 0"""


def substring(window: int) -> str:
    return f"""
    WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORDS}) AS w FROM documents),
    g AS (SELECT doc_id, i, array_to_string(w[i : i + {window - 1}], ' ') AS g FROM w, LATERAL (SELECT unnest(range(1, len(w) - {window - 2})) AS i)),
    s AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM g) WHERE k > 1),
    c AS (SELECT DISTINCT doc_id, i + o AS i FROM s, range({window}) t(o)),
    u AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM w),
    k AS (SELECT doc_id, count(*) AS kept, string_agg(word, ' ' ORDER BY i) AS text FROM u ANTI JOIN c USING (doc_id, i) GROUP BY 1)
    SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)"""


def decontamination(window: int) -> str:
    return f"""
    WITH d AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, {ALNUM}) AS w FROM documents),
    b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({LOWER.format("text")}, {ALNUM}) AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
    bn AS (SELECT item, w, least({window}, len(w)) AS n FROM b WHERE len(w) > 0),
    bw AS (SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM bn, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i)),
    z AS (SELECT DISTINCT n FROM bw),
    dw AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT * FROM d, z), LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i)),
    m AS (SELECT doc_id, dw.n, i, item FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
    h AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, i + o AS at FROM m, LATERAL (SELECT unnest(range(n)) AS o)) GROUP BY 1),
    s AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY 1)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN h USING (doc_id) LEFT JOIN s USING (doc_id)"""
