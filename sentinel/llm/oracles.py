"""The registered queries of this package in SQL, where SQL can express them."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"

_ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_NGRAM_JOIN = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({_ASCII_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS w FROM documents
), grams AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g
  FROM words
), sizes AS (
  SELECT d.doc_id, count(g) AS n FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN grams USING (doc_id) GROUP BY 1
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM shared JOIN sizes sx ON sx.doc_id = x JOIN sizes sy ON sy.doc_id = y
  WHERE 100 * shared.n >= 90 * (sx.n + sy.n - shared.n)
), both_ways AS (
  SELECT x, y FROM links UNION SELECT y, x FROM links
), reached(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.doc_id, b.y FROM reached r JOIN both_ways b ON r.other = b.x
), least AS (
  SELECT doc_id, min(other) AS component_id FROM reached GROUP BY 1
)
SELECT d.doc_id, sizes.n AS n_shingles, least.component_id
FROM documents d JOIN sizes USING (doc_id) JOIN least USING (doc_id)
"""

_SUBSTRING_DEDUP = f"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents
), starts AS (
  SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM words WHERE len(w) >= 13
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM starts
), later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS first_id FROM windows) WHERE first_id < doc_id
), covered AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM later
), gone AS (
  SELECT doc_id, count(*) AS n FROM covered GROUP BY 1
), placed AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM words
), kept AS (
  SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.i) AS text
  FROM placed p LEFT JOIN covered c ON c.doc_id = p.doc_id AND c.i = p.i WHERE c.i IS NULL GROUP BY 1
)
SELECT words.doc_id, len(words.w) AS n_words, coalesce(gone.n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM words LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

_TOP_K = """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT * FROM ranked WHERE rank <= 20
"""

_CHAT = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), shown AS (
  SELECT *, length('### ' || role || ':' || chr(10) || text || chr(10) || '</turn>' || chr(10))
    + (length(text) - length(replace(text, '### ', ''))) // 4 + (length(text) - length(replace(text, '</turn>', ''))) // 7 AS chars
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM shown GROUP BY conv_id
"""

_EMBEDDING_DEDUP = """
WITH RECURSIVE vectors AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM vectors a JOIN vectors b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98
), reached(vec_id, other) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT r.vec_id, p.y FROM reached r JOIN pairs p ON r.other = p.x
), least AS (
  SELECT vec_id, min(other) AS component_id FROM reached GROUP BY 1
), direct AS (
  SELECT x, count(*) AS n FROM pairs GROUP BY 1
)
SELECT e.vec_id, coalesce(direct.n, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN least USING (vec_id) LEFT JOIN direct ON direct.x = e.vec_id
"""

_PREFIX_TRIE = f"""
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], [0, 0, 0, 0, 0, 0, 0, 0]),
    lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS crc
), turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn,
    left(sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 32) AS id FROM conversations WHERE conv_id IS NOT NULL
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id) - 1 AS i FROM turns
), convs AS (
  SELECT c AS conv_id, c - c % 20 AS donor, xor(list_reduce(list_concat([4294967295], list_transform(string_split(c::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
      lambda a, x: xor(a >> 8, crc[(xor(a, x) & 255) + 1])), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id AS c FROM turns), crc_table
), rebuilt AS (
  SELECT c.conv_id, p.i, p.id, p.text FROM convs c JOIN placed p ON p.conv_id = c.donor AND p.i < c.h
  UNION ALL SELECT c.conv_id, p.i, p.id, p.text FROM convs c JOIN placed p ON p.conv_id = c.conv_id AND p.i >= c.h
), pathed AS (
  SELECT conv_id, len(regexp_extract_all(text, '{_WORD}')) AS words, row_number() OVER w AS depth, string_agg(id, '/') OVER w AS path
  FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY i ROWS UNBOUNDED PRECEDING)
), members AS (
  SELECT conv_id, depth, path, words FROM pathed UNION ALL SELECT conv_id, 0, '', 0 FROM convs
), nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n, any_value(words) AS words FROM members GROUP BY path, depth
), parted AS (
  SELECT *, CASE WHEN depth = 0 THEN NULL WHEN depth = 1 THEN '' ELSE left(path, length(path) - 33) END AS above FROM nodes
), kids AS (
  SELECT above AS path, count(*) AS n FROM parted WHERE above IS NOT NULL GROUP BY 1
), reached(path, top) AS (
  SELECT path, path FROM parted
  UNION ALL SELECT r.path, p.above FROM reached r JOIN parted p ON p.path = r.top WHERE p.above IS NOT NULL
), sums AS (
  SELECT r.top AS path, sum((p.n - 1) * p.words) AS saved, count(*) FILTER (k.n IS NULL) AS leaves
  FROM reached r JOIN parted p ON p.path = r.path LEFT JOIN kids k ON k.path = r.path GROUP BY 1
), ends AS (
  SELECT path, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends FROM (
    SELECT conv_id, arg_max(path, depth) AS path FROM members GROUP BY conv_id) GROUP BY path
)
SELECT p.conv_id, CAST(p.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, p.n AS n_convs, coalesce(k.n, 0) AS n_children,
  s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM parted p JOIN sums s ON s.path = p.path LEFT JOIN parted up ON up.path = p.above LEFT JOIN kids k ON k.path = p.path
LEFT JOIN ends e ON e.path = p.path
"""

_DIVERGENCE = f"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), terms AS (
  SELECT d, lang, source, unnest(regexp_extract_all({_ASCII_LOWER.format("text")}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM docs
), kept AS (
  SELECT lang, term, count(*) AS n FROM terms GROUP BY ALL HAVING count(DISTINCT d) >= 3
), langs AS (
  SELECT lang, sum(n) AS total, count(*) AS v FROM kept GROUP BY 1
), counts AS (
  SELECT lang, source, term, count(*) AS n FROM terms SEMI JOIN kept USING (lang, term) GROUP BY ALL
), sums AS (
  SELECT lang, source, sum(n) AS total FROM counts GROUP BY ALL
), sources AS (
  SELECT lang, source, coalesce(s.total, 0) AS total FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN sums s USING (lang, source)
), shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.total + l.v) AS p, 1 + (1000000000::HUGEINT * (k.n + 1)) // (l.total + l.v) AS q
  FROM sources g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // b.p) AS BIGINT) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
  UNION ALL SELECT a.lang, a.source, 'pair', b.source, 0 FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source
    WHERE a.lang NOT IN (SELECT lang FROM langs)
  UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM shares WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM found
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200
"""

_FINGERPRINTS = r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS k FROM documents
), paired AS (
  SELECT doc_id, text, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text, coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS next_id
  FROM docs WINDOW w AS (ORDER BY doc_id DESC NULLS LAST, k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
), texts AS (
  SELECT doc_id, 'own' AS kind, text FROM paired
  UNION ALL SELECT doc_id, 'edited', left(text, length(text) - length(text) // 3) || left(next_text, length(text) // 3) FROM paired
), lines AS (
  SELECT doc_id, kind, unnest(l) AS line, generate_subscripts(l, 1) AS i
  FROM (SELECT doc_id, kind, regexp_extract_all(text, '[^
]*
|[^
]+') AS l FROM texts)
), digests AS (
  SELECT doc_id, kind, i, list_transform(regexp_extract_all(line, '(?s).{1,80}?[.!?;:,
] ?|.{1,80}'), lambda p: sha256(p)) AS d FROM lines
), paragraphs AS (
  SELECT doc_id, kind, i, d, sha256(array_to_string(d, '')) AS digest FROM digests
), numbered AS (
  SELECT *, coalesce(count(*) FILTER (digest LIKE '%0') OVER (PARTITION BY doc_id, kind ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS section
  FROM paragraphs
), sections AS (
  SELECT doc_id, kind, section, sha256(string_agg(digest || ';', '' ORDER BY i)) AS digest,
    string_agg(array_to_string(list_transform(d, lambda x: left(x, 8)), '') || ':' || left(digest, 16) || ';', '' ORDER BY i) AS shown
  FROM numbered GROUP BY ALL
), trees AS (
  SELECT t.doc_id, t.kind, sha256(coalesce(string_agg(digest, '' ORDER BY section), '')) AS root,
    coalesce(string_agg('#' || left(digest, 16) || '=' || shown, '' ORDER BY section), '') AS shown
  FROM texts t LEFT JOIN sections s ON s.doc_id = t.doc_id AND s.kind = t.kind GROUP BY ALL
), pieces AS (
  SELECT doc_id, kind, list_distinct(flatten(list(list_transform(d, lambda x: left(x, 8))))) AS p FROM digests GROUP BY ALL
), found AS (
  SELECT t.doc_id, t.kind, root, root || shown AS fp, coalesce(p, []) AS p FROM trees t LEFT JOIN pieces ON pieces.doc_id = t.doc_id AND pieces.kind = t.kind
)
SELECT d.doc_id, length(d.text) AS n_chars, sha256(t.text) AS edited_sha256, a.fp AS fingerprint, b.fp AS edited_fingerprint,
  CASE WHEN a.root = b.root THEN 1.0::DOUBLE ELSE coalesce(2.0::DOUBLE * len(list_intersect(a.p, b.p)) / nullif(len(a.p) + len(b.p), 0), 0.0) END AS near_edited,
  CASE WHEN a.root = c.root THEN 1.0::DOUBLE ELSE coalesce(2.0::DOUBLE * len(list_intersect(a.p, c.p)) / nullif(len(a.p) + len(c.p), 0), 0.0) END AS near_next,
  d.next_id
FROM paired d JOIN texts t ON t.doc_id = d.doc_id AND t.kind = 'edited' JOIN found a ON a.doc_id = d.doc_id AND a.kind = 'own'
JOIN found b ON b.doc_id = d.doc_id AND b.kind = 'edited' JOIN found c ON c.doc_id = d.next_id AND c.kind = 'own'
"""

ORACLES = {
    "op1_exact_top_k": _TOP_K,
    "op2_chat_formatting": _CHAT,
    "op8_embedding_dedup": _EMBEDDING_DEDUP,
    "op9_ngram_jaccard_join": _NGRAM_JOIN,
    "op10_substring_dedup": _SUBSTRING_DEDUP,
    "op11_prefix_trie": _PREFIX_TRIE,
    "op12_source_divergence": _DIVERGENCE,
    "op13_document_fingerprints": _FINGERPRINTS,
}
