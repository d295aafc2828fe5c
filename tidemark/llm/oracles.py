"""DuckDB SQL of the queries that it can express over whole tables."""

from __future__ import annotations

_BLANK = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_LOWER = "translate(coalesce({c}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_BLANK}) AS w FROM documents),
    g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
    f AS (SELECT t, min(doc_id) AS least FROM g GROUP BY t),
    hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM g JOIN f USING (t) WHERE least < doc_id),
    words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
    kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM words ANTI JOIN hit USING (doc_id, p) GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

OP3 = f"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format(c='text')}, {_ALNUM}) AS w FROM documents),
    b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER.format(c='text')}, {_ALNUM}) AS w FROM benchmark),
    q AS (SELECT DISTINCT item, least(len(w), 10) AS m, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS t FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
    g AS (SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS t FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM q))),
    h AS (SELECT doc_id, i, g.m, item FROM g JOIN q ON g.m = q.m AND g.t = q.t),
    n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM h) GROUP BY doc_id),
    s AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN n USING (doc_id) LEFT JOIN s USING (doc_id)"""

OP7 = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format(c='text')}, {_BLANK}) AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
    e AS (SELECT x, y FROM p JOIN n a ON x = a.doc_id JOIN n b ON y = b.doc_id WHERE 100 * c >= 80 * (a.n + b.n - c)),
    links AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
    r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT links.y, r.c FROM r JOIN links ON r.doc_id = links.x WHERE r.c < links.y)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id) LEFT JOIN n USING (doc_id)"""

OP2 = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_BLANK}) AS w FROM documents),
    g AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS t FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT unnest([6, 8]) AS m))),
    twice AS (SELECT doc_id, m, i, t FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, m, t) AS times FROM g) WHERE times > 1),
    covered AS (SELECT doc_id, count(DISTINCT p) FILTER (m = 8) AS n_repeat_words, count(DISTINCT p) FILTER (m = 6) AS n_covered FROM (SELECT doc_id, m, unnest(range(i, i + m)) AS p FROM twice) GROUP BY doc_id),
    pairs AS (SELECT a.doc_id, a.i, b.i - a.i AS apart FROM twice a JOIN twice b ON a.doc_id = b.doc_id AND a.t = b.t AND a.m = 6 AND b.m = 6 AND a.i < b.i),
    runs AS (SELECT doc_id, count(*) + 5 AS long FROM (SELECT doc_id, apart, i - row_number() OVER (PARTITION BY doc_id, apart ORDER BY i) AS run FROM pairs) GROUP BY doc_id, apart, run),
    longest AS (SELECT doc_id, max(long) AS longest_repeat FROM runs GROUP BY doc_id),
    lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, {_BLANK}) GROUP BY doc_id),
    m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_covered, 0) AS n_covered, coalesce(longest_repeat, 0) AS longest_repeat
    FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN longest USING (doc_id))
    SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * n_covered <= 40 * n_words AND 100 * longest_repeat <= 25 * n_words AS kept FROM m"""

_BITS = "array_to_string(list_transform(string_split(d, ''), lambda c: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * strpos('0123456789abcdef', c) - 3, 4)), '')"
_FIVE = " + ".join(f"{16 >> k} * CAST(substr(bits, CAST(5 * k AS BIGINT) + {k + 1}, 1) AS INTEGER)" for k in range(5))
OP8 = f"""WITH x AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS d FROM pages),
    f AS (SELECT d, min(page_id) AS o FROM x GROUP BY d),
    b AS (SELECT d, array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + {_FIVE}, 1)), '') AS payload_digest FROM (SELECT d, {_BITS} AS bits FROM f))
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = o THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> o THEN o END AS refers_to FROM x JOIN f USING (d) JOIN b USING (d)"""

#: Fixed values of the test tables: names of hosts whose pages a list of unwanted URLs would have.
UNWANTED = ("casino-win", "free-bets", "cheap-pills", "adult-x", "spam-farm", "ads-track")
#: (verdict, host, path)
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
_CANON = r"""'https://' || regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www\.', '') || coalesce(nullif(rtrim(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), ''), '/')
    || coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: x <> '' AND x NOT LIKE 'utm_%' AND x NOT LIKE 'ref=%')), '&'), ''), '')"""
_FITS = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{{}}'" for v, h, p in sorted(URL_RULES, key=lambda r: -len(r[1] + r[2]))]
_RULES = sorted(URL_RULES, key=lambda r: -len(r[1] + r[2]))
OP11 = f"""WITH u AS (SELECT page_id, url, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
    listed AS (SELECT DISTINCT {_CANON} AS c FROM u WHERE regexp_matches(host, '(^|\\.)({"|".join(UNWANTED)})\\.'))
    SELECT page_id, host, path, CASE {" ".join(f.format(h + p) for f, (_, h, p) in zip(_FITS, _RULES, strict=True))} END AS rule,
    CASE {" ".join(f.format(v) for f, (v, _, _) in zip(_FITS, _RULES, strict=True))} WHEN {_CANON} IN (SELECT c FROM listed) THEN 'block' ELSE 'allow' END AS verdict FROM u"""

#: CRC-32 of an ASCII text, bit by bit: each byte comes in with its first bit.
_CRC = "xor(4294967295, list_reduce(flatten(list_transform(string_split({t}, ''), lambda x: [ascii(x), 0, 0, 0, 0, 0, 0, 0])), lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1)), 4294967295))"


def _field(c: str) -> str:
    return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"


def _tree(levels: int, name: str, nodes: str) -> str:
    """CTEs {name}1, {name}2, ...: the runs of each level (key, p, all nodes, whether one node is all there is). nodes: key, p, node."""
    out = []
    for k in range(levels):
        below = nodes if k == 0 else f"(SELECT key, p, CASE WHEN lone THEN nodes[1] ELSE sha256(array_to_string(nodes, '')) END AS node FROM {name}{k})"
        out.append(f"{name}{k + 1} AS (SELECT key, p // 16 AS p, list(node ORDER BY p) AS nodes, p // 16 = 0 AND count(*) = 1 AS lone FROM {below} GROUP BY key, p // 16)")
    return ", ".join(out)


def _folded(levels: int, name: str, tree: str, start: str) -> str:
    """CTEs {name}1, ...: row by row up that tree. start: id columns, key, p, proof (siblings so far), cur (the folded node)."""
    out = []
    for k in range(levels):
        out.append(f"""{name}{k + 1} AS (SELECT f.* REPLACE (f.p // 16 AS p, proof || CASE WHEN lone THEN '' ELSE array_to_string(nodes[:f.p % 16], '') || array_to_string(nodes[f.p % 16 + 2:], '') END AS proof,
    CASE WHEN lone THEN cur ELSE sha256(array_to_string(nodes[:f.p % 16], '') || cur || array_to_string(nodes[f.p % 16 + 2:], '')) END AS cur) FROM {start if k == 0 else f'{name}{k}'} f JOIN {tree}{k + 1} t ON f.key = t.key AND f.p // 16 = t.p)""")
    return ", ".join(out)


#: Holds for up to 16 ** 5 rows a source and 16 ** 4 sources.
OP12 = f"""WITH d AS (SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low, {_CRC.format(t="CAST(doc_id AS VARCHAR)")} % 5 = 0 AS tampered FROM documents),
    l AS (SELECT doc_id, coalesce('+' || source, '') AS key, sha256({" || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))}) AS leaf,
    sha256({" || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))} || CASE WHEN tampered THEN {_field("low")} ELSE {_field("text")} END) AS cur FROM d),
    n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id, leaf) - 1 AS p FROM l),
    {_tree(5, "t", "(SELECT key, p, leaf AS node FROM n)")},
    r AS (SELECT key AS source_key, '' AS key, row_number() OVER (ORDER BY key) - 1 AS p, CASE WHEN lone THEN nodes[1] ELSE sha256(array_to_string(nodes, '')) END AS node FROM t5),
    {_tree(4, "u", "(SELECT key, p, node FROM r)")},
    top AS (SELECT CASE WHEN lone THEN nodes[1] ELSE sha256(array_to_string(nodes, '')) END AS root FROM u4),
    {_folded(5, "a", "t", "(SELECT doc_id, leaf, key, p, '' AS proof, cur FROM n)")},
    m AS (SELECT doc_id, leaf, r.node AS subroot, '' AS key, r.p AS p, proof, cur FROM a5 JOIN r ON a5.key = r.source_key),
    {_folded(4, "b", "u", "m")}
    SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = root AS verified FROM b4, top"""

OP13 = rf"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER.format(c='text')}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
    w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
    g AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS t FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS m))),
    f AS (SELECT lang, m, t, count(*) AS f FROM g GROUP BY ALL),
    n AS (SELECT lang, sum(f) AS n FROM f WHERE m = 1 GROUP BY lang),
    c AS (SELECT lang, m, t, f AS a, string_split(t, ' ') AS x FROM f WHERE m > 1 AND f >= 10),
    s AS (SELECT c.lang, c.t, c.a, k, l.f AS l, r.f AS r, CAST(1000000 AS HUGEINT) * a * a // (CAST(l.f AS HUGEINT) * r.f) AS score
    FROM (SELECT *, unnest(range(1, m)) AS k FROM c) c JOIN f l ON l.lang = c.lang AND l.t = array_to_string(x[:k], ' ') JOIN f r ON r.lang = c.lang AND r.t = array_to_string(x[k + 1:], ' ')),
    b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, t ORDER BY score, k) = 1),
    gone AS (SELECT DISTINCT i.lang, i.t FROM (SELECT lang, a, unnest([array_to_string(x[1:2], ' '), array_to_string(x[2:3], ' ')]) AS t FROM c WHERE m = 3) o JOIN c i ON i.lang = o.lang AND i.t = o.t WHERE 100 * o.a >= 50 * i.a)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, t) AS rank, t AS phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
    FROM b ANTI JOIN gone USING (lang, t) JOIN n USING (lang) QUALIFY rank <= 2000"""
