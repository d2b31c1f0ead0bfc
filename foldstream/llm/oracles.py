"""SQL of the queries that SQL can express."""

#: Base 32 of the digest: five hexadecimal digits are four letters.
_BASE32 = """array_to_string(list_transform(range(8), lambda g: array_to_string(list_transform([15, 10, 5, 0], lambda s:
 substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(sha, g * 5 + 1, 5))::INTEGER >> s) & 31) + 1, 1)), '')), '')"""

#: Leftmost matches of a pattern with their starts: gaps and matches alternate, so running lengths give the starts.
_FOUND = r"""
 {k} AS (SELECT row, list_transform(range(1, len(f) + 1), lambda i: struct_pack(start := list_sum(list_transform(g[1:i],
   lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0), kind := {n}, found := f[i])) AS s
  FROM (SELECT row, regexp_extract_all(text, '{p}') AS f, string_split_regex(text, '{p}') AS g FROM docs))"""

_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+"""
_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$"""


def _entropy(c: str) -> str:
    return f"""list_max(list_transform(range(1, length({c}) - 18), lambda i: log2(20) - list_sum(list_transform(
   map_values(list_histogram(string_split(substr({c}, i, 20), ''))), lambda n: n * log2(n))) / 20))"""


def _hexadecimal(c: str) -> str:
    return f"regexp_full_match({c}, '[0-9a-fA-F]+') AND regexp_matches({c}, '[0-9]') AND regexp_matches({c}, '[a-fA-F]')"


def _has(c: str, *classes: str) -> str:
    return " AND ".join(f"regexp_matches({c}, '[{x}]')" for x in classes)


#: Of a candidate of no class of its own, a part of letters and digits counts, by the part's class.
_PART = f"""list_count(list_filter(regexp_extract_all(c, '[A-Za-z0-9]{{20,}}'), lambda p: CASE WHEN {_hexadecimal('p')} THEN {_entropy('p')} >= 2.93
   WHEN {_has('p', '0-9', 'a-z', 'A-Z')} THEN {_entropy('p')} >= 3.53 WHEN {_has('p', '0-9', 'a-z')} THEN {_entropy('p')} >= 3.48
   WHEN {_has('p', '0-9', 'A-Z')} THEN {_entropy('p')} >= 3.4
   WHEN NOT {_has('p', '0-9')} AND length(regexp_replace(p, '[^A-Z]', '', 'g')) / length(p) BETWEEN 0.3 AND 0.7 THEN {_entropy('p')} >= 3.62
   ELSE false END)) > 0"""

ORACLES: dict[str, str] = {
    "op10_warc": f"""WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS sha FROM pages),
 w AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS largest FROM p)
SELECT page_id, strlen(h) AS payload_bytes, {_BASE32} AS payload_digest,
 CASE WHEN page_id = largest THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> largest THEN largest END AS refers_to
FROM w""",
    "op7_secrets": "WITH docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),"
    + _FOUND.format(k="a", n=0, p=_ASSIGN) + "," + _FOUND.format(k="b", n=1, p="AKIA[A-Z0-9]{12,}") + ","
    + _FOUND.format(k="c", n=2, p="[0-9a-f]{32,}") + "," + _FOUND.format(k="d", n=3, p="[A-Za-z0-9+/_=-]{24,}")
    + rf""",
 every AS (SELECT row, unnest(s) AS x FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c UNION ALL SELECT * FROM d)),
 flat AS (SELECT row, x.start::BIGINT AS start, x.kind AS kind, x.found AS c FROM every),
 kept AS (SELECT row, start, kind, ['assign', 'access', 'hex', 'entropy'][kind + 1] || ':' || start || ':' || (start + length(c)) AS w FROM flat
  WHERE (kind = 0 AND length(regexp_extract(c, '{_VALUE}', 1)) >= 8) OR kind IN (1, 2)
   OR (kind = 3 AND NOT regexp_full_match(c, '[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}|[0-9A-Z]*(?i:example)[0-9A-Za-z]*|(?:/[a-z0-9_-]+)+/?|[0-9=+/_-]+')
    AND CASE WHEN {_hexadecimal('c')} THEN {_entropy('c')} >= 2.93 WHEN {_has('c', '0-9', 'a-z', 'A-Z')} THEN {_entropy('c')} >= 3.53 ELSE {_PART} END)),
 sums AS (SELECT row, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  string_agg(w, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg(w, ',' ORDER BY start, kind) AS spans FROM kept GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
 sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs LEFT JOIN sums USING (row)""",
    "op13_lines": r"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
 every AS (SELECT row, doc_id, unnest(range(1, len(lines) + 1)) AS pos, unnest(lines) AS line FROM d),
 keyed AS (SELECT *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
   concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) AS key FROM every),
 frequent AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT coalesce(doc_id::VARCHAR, 'none')) >= 10)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
 sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (f.key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN frequent f USING (key) GROUP BY row""",
}
