"""DuckDB SQL of the registered queries that SQL can express."""

#: Line dedup over a relation ``docs`` (doc_id, text): tables up to ``line_drops`` (doc_id, pos).
LINE_DROPS = r"""
lines_of AS (
    SELECT doc_id, pos, regexp_split_to_array(trim(string_split(text, chr(10))[pos], ' ' || chr(9) || chr(13)),
                                              '[ 	
]+') AS plain
    FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos
          FROM docs WHERE text IS NOT NULL) AS x
), tokened AS (
    SELECT doc_id, pos, list_transform(plain, lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS tokens
    FROM lines_of WHERE len(plain) >= 3
), leaves AS (
    SELECT DISTINCT [CAST(len(tokens) AS VARCHAR)] || tokens[:3] AS leaf, tokens FROM tokened
), places AS (
    SELECT leaf, tokens, unnest(range(1, len(tokens) + 1)) AS at_pos, unnest(tokens) AS token FROM leaves
), supports AS (
    SELECT leaf, at_pos, token, count(*) AS k FROM places GROUP BY leaf, at_pos, token
), met AS (
    SELECT leaf, tokens, list(k ORDER BY at_pos) AS ks
    FROM places JOIN supports USING (leaf, at_pos, token) GROUP BY leaf, tokens
), levels AS (
    SELECT leaf, tokens, ks, list_reverse_sort(ks)[CAST(ceil(len(tokens) * 0.8) AS INT)] AS level FROM met
), fitting AS (
    SELECT tokens, list_transform(tokens, lambda t, i: CASE WHEN ks[i] * 2 > level THEN [t] ELSE [] END) AS constants
    FROM levels WHERE level > 1
), placed AS (
    SELECT t.doc_id, t.pos, len(t.tokens) AS size,
           CASE WHEN f.tokens IS NULL THEN list_transform(['own'] || t.tokens, lambda x: [x]) ELSE f.constants END AS template
    FROM tokened AS t LEFT JOIN fitting AS f ON f.tokens = t.tokens
), recurring AS (
    SELECT template, min(doc_id) AS first_doc FROM placed GROUP BY template
    HAVING count(DISTINCT doc_id) >= CASE WHEN min(size) >= 50 THEN 2 ELSE 3 END
), line_drops AS (
    SELECT doc_id, pos FROM (
        SELECT doc_id, pos, row_number() OVER (PARTITION BY template ORDER BY doc_id, pos) AS nth
        FROM placed JOIN recurring USING (template)) AS x WHERE nth > 1
)"""

OP1 = f"""
WITH docs AS (SELECT doc_id, text FROM documents), {LINE_DROPS},
gone AS (
    SELECT doc_id, list(pos) AS dropped FROM line_drops GROUP BY doc_id
), cleaned AS (
    SELECT doc_id, len(string_split(text, chr(10))) AS n_lines, coalesce(len(dropped), 0) AS n_dropped,
           array_to_string(list_filter(string_split(text, chr(10)),
                                       lambda line, i: NOT coalesce(list_contains(dropped, i), false)), chr(10)) AS kept
    FROM docs LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(n_dropped AS BIGINT) AS n_dropped,
       CAST(length(coalesce(kept, '')) AS BIGINT) AS kept_chars, sha256(coalesce(kept, '')) AS kept_sha256
FROM cleaned
"""

OP3 = r"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
    SELECT *, replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\t') AS inside,
           replace(replace(replace(replace(role, '\', '\b'), '###', '\h'), '</turn>', '\t'), ':', '\c') AS head
    FROM rows
), whole AS (
    SELECT conv_id, count(*) AS n_turns,
           string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
           coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS spoken,
           CAST(sum(4 + length(head) + 2 + length(inside) + 8) AS BIGINT) AS formatted_chars
    FROM sized GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(spoken) AS BIGINT) AS loss_chars,
       sha256(spoken) AS loss_sha256, formatted_chars
FROM whole
"""

OP5 = r"""
WITH lowered AS (
    SELECT 'd' AS side, CAST(doc_id AS VARCHAR) AS id,
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
    UNION ALL
    SELECT 'b', CAST(item_id AS VARCHAR),
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark
), listed AS (
    SELECT side, id, coalesce(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM lowered
), wanted AS (
    SELECT DISTINCT id AS item_id, list_slice(w, i, i + 9) AS gram
    FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM listed
          WHERE side = 'b' AND len(w) > 0) AS x
), lengths AS (
    SELECT DISTINCT len(gram) AS n FROM wanted
), grams AS (
    SELECT id, n, i, list_slice(w, i, i + n - 1) AS gram
    FROM (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM listed, lengths
          WHERE side = 'd' AND len(w) >= n) AS x
), met AS (
    SELECT g.id, g.n, g.i, item_id FROM grams AS g JOIN wanted USING (gram)
), words_hit AS (
    SELECT id, count(DISTINCT pos) AS n_hit
    FROM (SELECT id, unnest(range(i, i + n)) AS pos FROM (SELECT DISTINCT id, n, i FROM met) AS y) AS x GROUP BY id
), items_hit AS (
    SELECT id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
    FROM (SELECT DISTINCT id, item_id FROM met) AS x GROUP BY id
)
SELECT CAST(l.id AS BIGINT) AS doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM listed AS l LEFT JOIN words_hit USING (id) LEFT JOIN items_hit USING (id) WHERE side = 'd'
"""

OP7 = """
WITH p AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
    FROM pages
), f AS (
    SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""

_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_GAP = r"\x00-\x2F\x3A-\x60\x7B-\x7F"


def _opening(text: str) -> str:
    words = f"regexp_extract_all(translate({text}, {_LETTERS}), '[^{_GAP}]+')"
    return f"nullif(array_to_string(list_slice({words}, 1, 8), ' '), '')"


def _rate(strength: str, prior: str) -> str:
    return f"(bad + {strength} * {prior}) / (n + {strength})"


def _strength(groups: str) -> str:
    """The weight of a level's prior: groups (n, bad, prior)."""
    return f"""(
    SELECT CASE WHEN coalesce(scale, 0) = 0 OR coalesce(over, 0) <= 0 THEN 1000.0
                ELSE least(1000.0, greatest(1.0, scale / over - 1)) END
    FROM (SELECT sum(n * pow(bad / n - prior, 2) - prior * (1 - prior)) AS over,
                 sum((n - 1) * prior * (1 - prior)) AS scale FROM {groups} WHERE n > 0) AS x)"""


_TWO = ("('ac.uk', 'co.in', 'co.jp', 'co.kr', 'co.nz', 'co.uk', 'co.za', 'com.au', 'com.br', 'com.cn', 'com.mx', "
        "'com.tr', 'gov.uk', 'org.uk')")
_ARTICLE = "regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1)"

OP11 = rf"""
WITH urls AS (
    SELECT page_id, html, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), {_LETTERS}) AS host,
           coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
    FROM pages
), told AS (
    SELECT doc_id, count(*) AS n_rows, count(*) FILTER (quality = 0 OR coalesce(toxic, 0) = 1) AS n_bad
    FROM labels WHERE quality IS NOT NULL GROUP BY doc_id
), shown AS (
    SELECT opening, CASE WHEN 2 * sum(n_bad) >= sum(n_rows) THEN 1 ELSE 0 END AS outcome
    FROM (SELECT doc_id, {_opening("text")} AS opening FROM documents) AS d JOIN told USING (doc_id)
    WHERE opening IS NOT NULL GROUP BY opening
), main AS (
    SELECT host, regexp_replace(regexp_replace(CASE WHEN {_ARTICLE} <> '' THEN {_ARTICLE} ELSE html END,
                                               '(?s)<h1.*?</h1>|<[^>]*>', ' ', 'g'),
                                '&#?[0-9A-Za-z]+;', ' ', 'g') AS text
    FROM urls
), counted AS (
    SELECT host, count(outcome) AS n, coalesce(sum(outcome), 0) AS bad
    FROM (SELECT host, {_opening("text")} AS opening FROM main) AS m LEFT JOIN shown USING (opening) GROUP BY host
), labelled AS (
    SELECT *, regexp_replace(host, ':[0-9]*$', '') AS name, string_split(name, '.') AS parts,
           array_to_string(parts[-2:], '.') AS two,
           CASE WHEN two IN {_TWO} THEN two ELSE parts[-1] END AS suffix,
           CASE WHEN regexp_full_match(name, '[0-9.]+') THEN name
                WHEN two IN {_TWO} THEN array_to_string(parts[-3:], '.') ELSE two END AS domain
    FROM counted
), top AS (
    SELECT (sum(bad) + 0.5) / (sum(n) + 1.0) AS rate FROM labelled
), suffixes AS (
    SELECT suffix, sum(n) AS n, sum(bad) AS bad, any_value(rate) AS prior FROM labelled, top GROUP BY suffix
), suffix_rates AS (
    SELECT suffix, {_rate(_strength("suffixes"), "prior")} AS rate FROM suffixes
), domains AS (
    SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad, any_value(rate) AS prior
    FROM labelled JOIN suffix_rates USING (suffix) GROUP BY suffix, domain
), domain_rates AS (
    SELECT suffix, domain, {_rate(_strength("domains"), "prior")} AS rate FROM domains
), hosts AS (
    SELECT host, n, bad, rate AS prior FROM labelled JOIN domain_rates USING (suffix, domain)
), judged AS (
    SELECT host, {_rate("w", "prior")} AS mean, mean - 1.645 * sqrt(mean * (1 - mean) / (n + w + 1)) > 0.5 AS blocked
    FROM (SELECT *, {_strength("hosts")} AS w FROM hosts) AS x
), rules (does, rule, upon, starts) AS (
    VALUES ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'),
           ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')
), ruled AS (
    SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(does, length(rule)) AS does
    FROM (SELECT DISTINCT host, path FROM urls) AS u
    JOIN rules ON (host = upon OR ends_with(host, '.' || upon)) AND starts_with(path, starts) GROUP BY host, path
)
SELECT page_id, host, path, rule, coalesce(does, CASE WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict
FROM urls LEFT JOIN judged USING (host) LEFT JOIN ruled USING (host, path)
"""

OP12 = rf"""
WITH pieces AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
    FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), {_LETTERS}),
                                                                             '[.,;:!?\x0A-\x0D]')) AS piece FROM documents) AS x
), counts AS MATERIALIZED (
    SELECT lang, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS gram, count(*) AS f
    FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM pieces, range(1, 5) AS o(m)) AS x
    GROUP BY ALL HAVING m = 1 OR f >= 30
), totals AS (
    SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE m = 1 GROUP BY lang
), found AS MATERIALIZED (
    SELECT lang, m, gram, string_split(gram, ' ') AS w, f AS a FROM counts WHERE m >= 2 AND f >= 30
), cuts AS MATERIALIZED (
    SELECT lang, gram, a, k, array_to_string(list_slice(w, 1, k), ' ') AS before, array_to_string(list_slice(w, k + 1, m), ' ') AS after
    FROM (SELECT *, unnest(range(1, m)) AS k FROM found) AS c
), scored AS (
    SELECT c.lang, c.gram, a, k, x.f AS l, y.f AS r, (2000000::HUGEINT * a) // (x.f + y.f) AS score
    FROM cuts AS c JOIN counts AS x ON x.lang = c.lang AND x.gram = c.before
    JOIN counts AS y ON y.lang = c.lang AND y.gram = c.after
), lowest AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, gram ORDER BY score, k) = 1
), parts AS MATERIALIZED (
    SELECT lang, array_to_string(list_slice(w, i, i + p - 1), ' ') AS gram, a AS longer
    FROM (SELECT lang, w, a, p, unnest(range(1, m - p + 2)) AS i FROM found, range(2, 4) AS o(p) WHERE p < m) AS x
), inside AS (
    SELECT lang, gram, max(longer) AS longer FROM parts GROUP BY lang, gram
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, gram) AS rank, gram AS phrase, a, l, r, n,
       CAST(score AS BIGINT) AS score
FROM lowest JOIN totals USING (lang) LEFT JOIN inside USING (lang, gram)
WHERE coalesce(longer, 0) * 100 < a * 80
QUALIFY rank <= 2000
"""

#: CRC-32 of a text of ASCII characters, bit by bit: each byte is xor-ed in and eight steps of the polynomial follow.
_STEP = "CASE WHEN {0} & 1 = 1 THEN xor({0} >> 1, 3988292384) ELSE {0} >> 1 END"
_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda c: ord(c)::BIGINT)),
    lambda s, c: list_reduce(list_prepend(xor(s, c), range(8)), lambda v, i: """ + _STEP.format("v") + """)), 4294967295::BIGINT)"""

OP13 = f"""
WITH numbered AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS idx
    FROM conversations WHERE conv_id IS NOT NULL
), own AS (
    SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY idx) AS turns FROM numbered GROUP BY conv_id
), lent AS (
    SELECT conv_id, turns, conv_id - conv_id % 5 AS base, {_CRC32.format("conv_id")} % 9 AS h FROM own
), rebuilt AS (
    SELECT l.conv_id, list_concat(coalesce(b.turns, [])[:h], l.turns[h + 1:]) AS turns
    FROM lent AS l LEFT JOIN own AS b ON b.conv_id = base
), members AS (
    SELECT conv_id, d AS depth, turns[:d] AS prefix, len(turns) = d AS at_end
    FROM (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS d FROM rebuilt) AS x
), nodes AS (
    SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs,
           coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (at_end), '') AS ends,
           CASE WHEN depth > 0 THEN (count(*) - 1) * octet_length(encode(prefix[-1].text)) ELSE 0 END AS own_saving
    FROM members GROUP BY depth, prefix
), parents AS (
    SELECT n.*, p.conv_id AS parent_conv_id FROM nodes AS n
    LEFT JOIN nodes AS p ON p.depth = n.depth - 1 AND p.prefix = n.prefix[:n.depth - 1]
), kids AS (
    SELECT depth - 1 AS depth, prefix[:depth - 1] AS prefix, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL
), told AS (
    SELECT p.*, coalesce(n_children, 0) AS n_children FROM parents AS p LEFT JOIN kids USING (depth, prefix)
), above AS (
    SELECT up AS depth, prefix[:up] AS prefix, count(*) FILTER (n_children = 0) AS n_leaves, sum(own_saving) AS saved_tokens
    FROM (SELECT prefix, n_children, own_saving, unnest(range(depth + 1)) AS up FROM told) AS x GROUP BY ALL
)
SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, n_convs, n_children, n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(ends) AS ends_sha256
FROM told JOIN above USING (depth, prefix)
"""

ORACLES = {
    "op1_line_dedup": OP1,
    "op3_chat_format": OP3,
    "op5_decontamination": OP5,
    "op7_warc": OP7,
    "op11_url_filter": OP11,
    "op12_collocations": OP12,
    "op13_prefix_trie": OP13,
}
