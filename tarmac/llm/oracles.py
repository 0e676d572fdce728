"""SQL for those of the operators' queries that SQL can express, over whole tables."""

from __future__ import annotations

from tarmac.llm.licenses import LICENSE_FILE, TEMPLATES
from tarmac.llm.secrets import RULES


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


WINDOWS = r"""
WITH words AS (
    SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents
), each AS (
    SELECT doc_id, ws, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM words
), hashed AS (
    SELECT doc_id, i, w, CASE WHEN i + 19 <= len(ws) THEN md5(array_to_string(list_slice(ws, i, i + 19), ' ')) END AS h FROM each
), seen AS (
    SELECT doc_id, i, w, h IS NOT NULL AND row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1 AS again FROM hashed
), judged AS (
    SELECT doc_id, i, w, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS cut FROM seen
), kept AS (
    SELECT doc_id, string_agg(w, ' ' ORDER BY i) FILTER (WHERE NOT cut) AS t, count(*) FILTER (WHERE cut) AS n_removed FROM judged GROUP BY doc_id
)
SELECT doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM words LEFT JOIN kept USING (doc_id)
"""

SUBSTRINGS = """
WITH bytes AS (
    SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents
), each AS (
    SELECT doc_id, h, n, unnest(range(0, n)) AS i FROM bytes
), hashed AS (
    SELECT doc_id, i, substr(h, 2 * i + 1, 2) AS b, CASE WHEN i + 50 <= n THEN md5_number(substr(h, 2 * i + 1, 100)) END AS s FROM each
), seen AS (
    SELECT doc_id, i, b, s IS NOT NULL AND min(doc_id) OVER (PARTITION BY s) < doc_id AS again FROM hashed
), judged AS (
    SELECT doc_id, i, b, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS cut FROM seen
), runs AS (
    SELECT *, cut AND NOT coalesce(lag(cut) OVER (PARTITION BY doc_id ORDER BY i), false) AS first FROM judged
), kept AS (
    SELECT doc_id, count(*) FILTER (WHERE cut) AS n_removed, count(*) FILTER (WHERE first) AS n_spans, string_agg(b, '' ORDER BY i) FILTER (WHERE NOT cut) AS left_over FROM runs GROUP BY doc_id
)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(left_over, ''))) AS kept_sha256 FROM bytes LEFT JOIN kept USING (doc_id)
"""


def secrets() -> str:
    found, joined = [], []
    for i, r in enumerate(RULES):
        # a run of 32 or more is the same, said with a bound, and far fewer matches
        rx = _literal("[0-9a-f]{32,}" if r.kind == "hex" else r.regex)
        found.append(
            f"""m{i} AS (
    SELECT doc_id, list_transform(range(1, len(m) + 1), lambda k: {{'s': list_sum(list_transform(list_slice(gaps, 1, k), lambda g: len(g))) + coalesce(list_sum(list_transform(list_slice(m, 1, k - 1), lambda g: len(g))), 0), 'n': len(m[k]), 'counted': len(c[k])}}) AS spans
    FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {rx}) AS m, regexp_extract_all(coalesce(text, ''), {rx}, {r.counted}) AS c, regexp_split_to_array(coalesce(text, ''), {rx}) AS gaps FROM documents)
)"""
        )
        joined.append(f"SELECT doc_id, {i} AS rule, '{r.kind}' AS kind, {str(r.base).lower()} AS base, CAST(x.s AS BIGINT) AS s, CAST(x.s + x.n AS BIGINT) AS e FROM (SELECT doc_id, unnest(spans) AS x FROM m{i}) WHERE x.counted >= {r.least}")
    say = "kind || ':' || s || ':' || e"
    return f"""WITH {', '.join(found)}, spans AS ({' UNION ALL '.join(joined)}), told AS (
    SELECT doc_id, count(*) FILTER (WHERE rule = 0) AS n_assign, count(*) FILTER (WHERE rule = 1) AS n_access, count(*) FILTER (WHERE rule = 2) AS n_hex,
           string_agg({say}, ',' ORDER BY s, rule) FILTER (WHERE base) AS base_spans, string_agg({say}, ',' ORDER BY s, rule) AS spans
    FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM (SELECT DISTINCT doc_id FROM documents) LEFT JOIN told USING (doc_id)"""


def licenses(threshold: float = 0.6) -> str:
    values = ", ".join(f"({i}, {_literal(name)}, {_literal(text)})" for i, (name, text) in enumerate(TEMPLATES))
    split = lambda c: f"list_filter(regexp_split_to_array(lower({c}), '[^a-z0-9]+'), lambda t: t <> '')"
    named = f"regexp_matches(%s, {_literal(LICENSE_FILE)})"
    return f"""
WITH templates(template, license, body) AS (VALUES {values}), files AS (
    SELECT doc_id, coalesce(text, '') AS body, concat_ws('/', source, lang, CASE WHEN length(text) <= 400 THEN 'LICENSE.' || doc_id ELSE doc_id || '.txt' END) AS path FROM documents
), template_terms AS (
    SELECT template, license, term, count(*) AS n FROM (SELECT template, license, unnest({split('body')}) AS term FROM templates) GROUP BY ALL
), frequency AS (
    SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({split('body')})) AS term FROM files) GROUP BY term
), idf AS (
    SELECT term, ln((1 + (SELECT count(*) FROM files))::DOUBLE / (1 + coalesce(df, 0))) + 1 AS idf FROM (SELECT DISTINCT term FROM template_terms) LEFT JOIN frequency USING (term)
), vectors AS (
    SELECT template, license, term, n * idf / sqrt(sum(n * idf * n * idf) OVER (PARTITION BY template)) AS weight FROM template_terms JOIN idf USING (term)
), parts AS (
    SELECT DISTINCT path, unnest(list_concat(regexp_split_to_array(regexp_replace(body, '([.!?])[ \t]+([A-Z])', '\\1\n\\2', 'g'), '[\n\r]+'), CASE WHEN {named % "regexp_extract(path, '([^/]*)$', 1)"} THEN [body] ELSE [] END)) AS part FROM files
), likely AS (
    SELECT path, part, row_number() OVER () AS id FROM parts WHERE len(list_intersect({split('part')}, (SELECT list(term) FROM idf))) > 0
), part_terms AS (
    SELECT path, id, term, count(*) * coalesce(any_value(idf), (SELECT avg(idf) FROM idf)) AS v FROM (SELECT path, id, unnest({split('part')}) AS term FROM likely) LEFT JOIN idf USING (term) GROUP BY path, id, term
), norms AS (
    SELECT id, sqrt(sum(v * v)) AS norm FROM part_terms GROUP BY id
), near AS (
    SELECT path, license, round(sum(v * weight) / any_value(norm), 6) AS similarity FROM part_terms JOIN vectors USING (term) JOIN norms USING (id) GROUP BY path, id, template, license
), own AS (
    SELECT path, license, similarity FROM near WHERE similarity >= {threshold} QUALIFY row_number() OVER (PARTITION BY path ORDER BY similarity DESC, license) = 1
), held AS (
    SELECT regexp_replace(path, '/?[^/]*$', '') AS folder, license, similarity FROM own WHERE {named % "regexp_extract(path, '([^/]*)$', 1)"}
    QUALIFY row_number() OVER (PARTITION BY regexp_replace(path, '/?[^/]*$', '') ORDER BY similarity DESC, path) = 1
), folders AS (
    SELECT f.folder, h.folder AS held_in, h.license, h.similarity FROM (SELECT DISTINCT regexp_replace(path, '/?[^/]*$', '') AS folder FROM files) f JOIN held h ON f.folder = h.folder OR h.folder = '' OR starts_with(f.folder, h.folder || '/')
    QUALIFY row_number() OVER (PARTITION BY f.folder ORDER BY length(h.folder) DESC) = 1
)
SELECT f.doc_id, f.path, coalesce(own.license, near.license) AS license, coalesce(own.similarity, near.similarity) AS similarity,
       CASE WHEN own.license IS NOT NULL THEN 'stated' WHEN near.license IS NOT NULL THEN 'inherited' END AS origin, CASE WHEN own.license IS NULL THEN near.held_in END AS inherited_from
FROM files f LEFT JOIN own ON f.path = own.path LEFT JOIN folders near ON regexp_replace(f.path, '/?[^/]*$', '') = near.folder
"""


#: CRC-32 is worked out byte by byte, from a table of its polynomial.
SHARDS = """
WITH steps AS (
    SELECT list(v ORDER BY n) AS t FROM (SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(n))
), bytes AS (
    SELECT doc_id, coalesce('=' || source, '-') AS stratum, strlen(coalesce(text, '')) + 1 AS size,
           list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT))) AS b
    FROM documents
), summed AS (
    SELECT doc_id, stratum, size, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) AS crc FROM bytes, steps
), shuffled AS (
    SELECT *, CAST('0x' || substr(md5(concat_ws('|', 42, doc_id, crc, size)), 1, 15) AS BIGINT) AS place_in FROM summed
), ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY stratum ORDER BY place_in, doc_id NULLS FIRST, crc, size) - 0.5 AS DOUBLE) / count(*) OVER (PARTITION BY stratum) AS fraction FROM shuffled
), placed AS (
    SELECT *, row_number() OVER (ORDER BY fraction, place_in, stratum, doc_id NULLS FIRST, crc, size) - 1 AS place, count(*) OVER () AS total FROM ranked
)
SELECT doc_id, CAST(size AS BIGINT) AS size, crc AS text_crc32, 'rows' AS law, CAST(place * 16 // total AS INT) AS shard, place - ((place * 16 // total) * total + 15) // 16 AS slot, CAST(NULL AS INT) AS grown_shard
FROM placed
"""

ORACLES = {"op10_sharding": SHARDS, "op5_licenses": licenses(), "op7_windows": WINDOWS, "op8_secrets": secrets(), "op9_suffixes": SUBSTRINGS}
