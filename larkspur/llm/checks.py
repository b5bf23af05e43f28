"""SQL (DuckDB) that gives the rows of the queries which SQL can express."""

from larkspur.llm.lines import DEPTH, MASS, SIMILARITY, UNSPACED
from larkspur.llm.mixing import PART, POWER, SEED

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

DECONTAMINATION = rf"""
WITH docs AS (
    SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}'), []) AS w FROM documents),
items AS (
    SELECT DISTINCT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w
    FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
windows AS (
    SELECT DISTINCT item_id, least(13, len(w)) AS size, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS words
    FROM items, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS r(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM windows),
runs AS (
    SELECT doc_id, p, size, array_to_string(w[p:p + size - 1], ' ') AS words
    FROM docs, sizes, unnest(range(1, greatest(len(w) - size + 2, 1))) AS r(p)),
found AS (SELECT doc_id, p, runs.size, item_id FROM runs JOIN windows ON runs.words = windows.words AND runs.size = windows.size),
hits AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM found, unnest(range(p, p + size)) AS r(q) GROUP BY doc_id),
ids AS (
    SELECT doc_id, count(*) AS n_items, string_agg(cast(item_id AS VARCHAR), ',' ORDER BY cast(item_id AS VARCHAR)) AS ids
    FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN ids USING (doc_id)
"""


#: Rounds of leaders that the SQL writes out; the plan goes on until none is left.
LEADER_ROUNDS = 8


def leader_round(k: int) -> str:
    """From the buckets b{k} to who joins whom in this round (j{k}) and the buckets that are left."""
    return f"""
best{k} AS (SELECT leaf, part, run, min(rank) AS top FROM b{k} GROUP BY ALL),
seen{k} AS MATERIALIZED (SELECT leaf, masked, rank, top FROM b{k} JOIN best{k} USING (leaf, part, run)),
leads{k} AS MATERIALIZED (SELECT leaf, masked FROM seen{k} GROUP BY ALL HAVING bool_and(rank = top)),
j{k} AS MATERIALIZED (
    SELECT s.leaf, s.masked, min(s.top) AS top FROM (SELECT DISTINCT leaf, masked, top FROM seen{k} WHERE top.masked <> masked) s
    JOIN leads{k} l ON l.leaf = s.leaf AND l.masked = s.top.masked JOIN variants v ON v.leaf = s.leaf AND v.masked = s.masked JOIN variants o ON o.leaf = s.leaf AND o.masked = s.top.masked
    WHERE len(list_filter(range(1, v.n + 1), lambda i: v.tokens[i] = o.tokens[i])) >= ceil(v.n * {SIMILARITY}::DOUBLE - 1e-9::DOUBLE) GROUP BY ALL),
b{k + 1} AS MATERIALIZED (
    SELECT * FROM b{k} b WHERE NOT EXISTS (SELECT 1 FROM leads{k} l WHERE l.leaf = b.leaf AND l.masked = b.masked) AND NOT EXISTS (SELECT 1 FROM j{k} j WHERE j.leaf = b.leaf AND j.masked = b.masked)),"""


def line_dedup(table: str, keep_first: bool) -> str:
    """Common table expressions up to ``deduped`` (doc_id, n_lines, n_dropped, text) for a table of documents."""
    first = "AND doc_id <> first_doc" if keep_first else ""
    unspaced = "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in UNSPACED) + "]"
    return rf"""
split_lines AS MATERIALIZED (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no, unnest(string_split(text, chr(10))) AS line FROM {table}),
plain AS (
    SELECT doc_id, line_no, line, trim(regexp_replace(line, ' [ \t\x0B\f\r]+|[\t\x0B\f\r][ \t\x0B\f\r]*', ' ', 'g')) AS tidy FROM split_lines),
masks AS (
    SELECT doc_id, line_no, line, regexp_replace(tidy, '[^ ]*[0-9@][^ ]*', '<*>', 'g') AS masked FROM plain),
parsed AS MATERIALIZED (
    SELECT doc_id, line_no, masked, string_split(masked, ' ') AS tokens, len(string_split(masked, ' ')) AS n,
           len(string_split(masked, ' ')) + (length(masked) - length(regexp_replace(masked, '{unspaced}', '', 'g'))) // 2 AS words FROM masks WHERE masked <> ''),
leafed AS MATERIALIZED (SELECT *, n::VARCHAR || ' ' || array_to_string(tokens[1:{DEPTH}], ' ') AS leaf FROM parsed),
counted AS (
    SELECT leaf, masked, any_value(n) AS n, any_value(tokens) AS tokens, count(DISTINCT doc_id) AS n_docs, min({{'b': doc_id, 'c': line_no}}) AS first FROM leafed GROUP BY leaf, masked),
variants AS MATERIALIZED (
    SELECT leaf, masked, n, tokens, {{'a': -n_docs, 'b': first.b, 'c': first.c, 'masked': masked}} AS rank, (n - ceil(n * {SIMILARITY}::DOUBLE - 1e-9::DOUBLE))::INT AS d, n - {DEPTH} AS rest FROM counted
    WHERE n > {DEPTH} AND ceil(n * {SIMILARITY}::DOUBLE - 1e-9::DOUBLE) < n QUALIFY count(*) OVER (PARTITION BY leaf) > 1),
cut AS (
    SELECT leaf, masked, rank, p AS part, CASE WHEN d >= rest THEN '' WHEN d = 1 THEN array_to_string(list_concat(tokens[1:{DEPTH} + p], [''], tokens[{DEPTH} + p + 2:]), ' ') ELSE
        array_to_string(tokens[{DEPTH} + 1 + p * rest // least(d + 1, rest):{DEPTH} + (p + 1) * rest // least(d + 1, rest)], ' ') END AS run
    FROM variants, unnest(range(CASE WHEN d >= rest THEN 1 WHEN d = 1 THEN rest ELSE d + 1 END)) AS r(p)),
b0 AS MATERIALIZED (SELECT * FROM cut QUALIFY count(*) OVER (PARTITION BY leaf, part, run) > 1),""" + "".join(leader_round(k) for k in range(LEADER_ROUNDS)) + f"""
assigned AS (""" + " UNION ALL ".join(f"SELECT leaf, masked, top.masked AS template FROM j{k}" for k in range(LEADER_ROUNDS)) + f"""),
templated AS MATERIALIZED (SELECT doc_id, line_no, words, leaf, coalesce(template, masked) AS template FROM leafed LEFT JOIN assigned USING (leaf, masked)),
recurring AS (
    SELECT leaf, template, min(doc_id) AS first_doc FROM templated GROUP BY leaf, template
    HAVING count(DISTINCT doc_id) > 1 AND count(DISTINCT doc_id) * min(words) >= {MASS}),
dropped AS (SELECT doc_id, line_no FROM templated JOIN recurring USING (leaf, template) WHERE true {first}),
deduped AS (
    SELECT doc_id, count(*) AS n_lines, count(d.line_no) AS n_dropped,
           coalesce(string_agg(line, chr(10) ORDER BY s.line_no) FILTER (WHERE d.line_no IS NULL), '') AS text
    FROM split_lines s LEFT JOIN dropped d USING (doc_id, line_no) GROUP BY doc_id)"""


LINE_DEDUP = f"WITH {line_dedup('documents', False)} SELECT doc_id, text, n_lines::BIGINT AS n_lines, n_dropped::BIGINT AS n_dropped FROM deduped"


def bits(*parts: str) -> str:
    joined = ", ".join(f"cast({p} AS VARCHAR)" for p in parts)
    return f"('0x' || substr(md5(concat_ws('|', {joined})), 1, 13))::BIGINT"


def mixing(table: str) -> str:
    """Common table expressions up to ``exploded`` (doc_id, copy, shuffle_key) for a table of documents."""
    return f"""
counts AS (SELECT source, count(*) AS n, pow(count(*)::DOUBLE, {POWER}) AS weight FROM {table} GROUP BY source),
rates AS (
    SELECT source, rate, greatest(1, ceil(rate / {PART}))::BIGINT AS parts
    FROM (SELECT source, sum(n) OVER () * weight / sum(weight) OVER () / n AS rate FROM counts)),
masses AS (
    SELECT source, parts, k, exp(-rate / parts + k * ln(rate / parts) - lgamma(k + 1)) AS p
    FROM rates, unnest(range(0, 31 + ceil(rate / parts + 10 * sqrt(rate / parts))::BIGINT)) AS r(k)),
cumulative AS (
    SELECT source, parts, list(c ORDER BY k) AS sums
    FROM (SELECT source, parts, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM masses) GROUP BY source, parts),
drawn AS (
    SELECT doc_id, digest, list_sum(list_transform(range(1, parts + 1), lambda i: len(list_filter(sums, lambda c: c < ({bits(f"'{SEED}'", 'i', 'doc_id', 'digest')}::DOUBLE + 0.5) / {float(1 << 52)!r}::DOUBLE)))) AS n
    FROM (SELECT *, md5(coalesce(text, '')) AS digest FROM {table}) d JOIN cumulative s ON d.source IS NOT DISTINCT FROM s.source),
exploded AS (
    SELECT doc_id, copy, {bits(f"'{SEED}-order'", 'doc_id', 'copy', 'digest')} AS shuffle_key FROM drawn, unnest(range(1, n::BIGINT + 1)) AS r(copy))"""


MIXING = f"WITH {mixing('documents')} SELECT doc_id, source, copy, shuffle_key, text FROM exploded JOIN documents USING (doc_id)"


#: One step of the CRC-32 for a byte that is already mixed in: a fixed value of that checksum.
CRC_STEP = "list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, {start})"


def crc32(text: str) -> str:
    """Unsigned CRC-32 of a text of plain ASCII."""
    step = CRC_STEP.format(start="xor(s, ascii(x)::BIGINT)")
    return f"xor(list_reduce(list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT), lambda s, x: {step.replace('ascii(x)::BIGINT', 'x')}, 4294967295::BIGINT), 4294967295)"


PREFIX_TRIE = rf"""
WITH turns AS (
    SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, key) - 1 AS pos, key, strlen(text) AS n_bytes
    FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
                 substr(sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')), 1, 30) AS key
          FROM conversations WHERE conv_id IS NOT NULL)),
convs AS (
    SELECT conv_id, count(*) AS n, conv_id - conv_id % 5 AS base, any_value({crc32('conv_id::VARCHAR')}) % 9 AS h FROM turns GROUP BY conv_id),
parts AS (
    SELECT c.conv_id, 0 AS part, t.pos, t.key, t.n_bytes FROM convs c JOIN turns t ON t.conv_id = c.base AND t.pos < c.h
    UNION ALL
    SELECT c.conv_id, 1, t.pos, t.key, t.n_bytes FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos >= c.h),
paths AS (
    SELECT conv_id, coalesce(list(key ORDER BY part, pos) FILTER (WHERE key IS NOT NULL), []) AS keys, coalesce(list(n_bytes ORDER BY part, pos) FILTER (WHERE key IS NOT NULL), []) AS sizes
    FROM convs LEFT JOIN parts USING (conv_id) GROUP BY conv_id),
steps AS (
    SELECT conv_id, d AS depth, len(keys) AS length, md5(array_to_string(keys[1:d], ',')) AS node, CASE WHEN d > 0 THEN md5(array_to_string(keys[1:d - 1], ',')) END AS parent,
           CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS n_bytes
    FROM paths, unnest(range(0, len(keys) + 1)) AS r(d)),
nodes AS (
    SELECT depth, node, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, max(length) = depth AS leaf, (count(*) - 1) * any_value(n_bytes) AS cost,
           sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE length = depth), '')) AS ends_sha256
    FROM steps GROUP BY depth, node),
above AS (
    SELECT s.depth, s.node, sum(n.leaf::INT)::BIGINT AS n_leaves, sum(n.cost)::BIGINT AS saved_tokens
    FROM nodes n JOIN steps s ON s.conv_id = n.conv_id AND s.depth <= n.depth GROUP BY s.depth, s.node),
children AS (SELECT depth - 1 AS depth, parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY depth, parent)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children, a.n_leaves, a.saved_tokens, n.ends_sha256
FROM nodes n JOIN above a USING (depth, node) LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.node = n.parent LEFT JOIN children c ON c.depth = n.depth AND c.node = n.node
"""
