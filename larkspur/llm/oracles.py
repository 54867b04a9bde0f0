"""DuckDB SQL for the queries that SQL can express, over the whole tables; written from what each query promises, by plain joins."""

from __future__ import annotations

from larkspur.llm import linechunks

#: Every document and benchmark item that it holds, by the exact sets of five-word shingles.
CONTAINMENT = r"""
WITH words AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT DISTINCT 'i', item_id, text FROM benchmark WHERE text IS NOT NULL
), cut AS (
  SELECT side, id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda w: w <> '') AS w FROM words
), shingles AS (
  SELECT side, id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s FROM cut
), sized AS (SELECT id, count(*) AS n FROM shingles WHERE side = 'i' GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared, n AS n_item, count(*) / n::DOUBLE AS containment
FROM shingles d JOIN shingles i ON d.s = i.s AND d.side = 'd' AND i.side = 'i' JOIN sized z ON z.id = i.id
GROUP BY d.id, i.id, n HAVING count(*) >= 0.8 * n - 1e-9
"""

ARCHIVES = """
WITH p AS (
  SELECT page_id, url, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, url, CAST(payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM p LEFT JOIN f ON f.payload_digest = p.payload_digest AND payload_bytes >= 100
"""

CONVERSATIONS = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('<|turn:' || replace(replace(role, '\', '\\'), '|', '\|') || '|>' || chr(10) || replace(replace(text, '\', '\\'), '<|', '<\|') || chr(10) || '<|end|>' || chr(10))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""

VECTORS = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), n AS (SELECT a, count(*) AS n FROM links GROUP BY a), c AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, c AS component_id, vec_id = c AS kept FROM embeddings e JOIN c ON c.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""

_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

NEAR_TEXTS = rf"""
WITH RECURSIVE cut AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_CAPITALS}', '{_SMALL}'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END)) AS s FROM cut
), sized AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM shared JOIN sized x ON x.doc_id = a JOIN sized y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c AS component_id FROM documents d JOIN c ON c.a = d.doc_id LEFT JOIN sized s ON s.doc_id = d.doc_id
"""


def _draw(node: str) -> str:
    return f"ln((CAST('0x' || substr(md5('{node}:' || doc_id), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)"


def _tree(regions: int, racks: int, shards: int, extra: int = 0) -> str:
    """The shard that the draws choose, as an expression: equal weights, and ``extra`` regions of one shard behind the others."""
    wins = lambda nodes: f"list_position({nodes}, list_max({nodes})) - 1"
    out = []
    for r in range(regions):
        leaves = []
        for k in range(racks):
            of = wins("[" + ", ".join(_draw(f"r{r}/k{k}/{s}") for s in range(shards)) + "]")
            leaves.append(f"WHEN {k} THEN {(r * racks + k) * shards} + {of}")
        rack = wins("[" + ", ".join(_draw(f"r{r}/{k}") for k in range(racks)) + "]")
        out.append(f"WHEN {r} THEN CASE {rack} {' '.join(leaves)} END")
    out += [f"WHEN {regions + x} THEN {regions * racks * shards + x}" for x in range(extra)]
    weights = [racks * shards] * regions + [1] * extra
    region = wins("[" + ", ".join(f"{_draw(f'r/{r}')} / {w}" for r, w in enumerate(weights)) + "]")
    return f"CAST(CASE {region} {' '.join(out)} END AS INTEGER)"


#: CRC-32 of the text is spelled out bit by bit, since DuckDB has no function for it.
SHARDS = f"""
WITH RECURSIVE bits(n, k, c) AS (
  SELECT range::BIGINT, 0, range::BIGINT FROM range(256)
  UNION ALL SELECT n, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8
), crc AS (SELECT list(c ORDER BY n) AS t FROM bits WHERE k = 8),
placed AS (
  SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 8 AS BIGINT) AS size,
         CAST(xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT)), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS BIGINT) AS text_crc32,
         {_tree(2, 3, 4)} AS shard, {_tree(2, 3, 4, 1)} AS grown_shard,
         CAST('0x' || substr(md5('slot:' || doc_id), 1, 8) AS BIGINT) % greatest(1, CAST(ceil((SELECT count(*) FROM documents) / 20000.0) AS BIGINT)) AS bucket
  FROM documents, crc
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id, text_crc32, size) - 1 AS slot, grown_shard,
       CAST(shard // 12 AS INTEGER) AS region, CAST(shard // 4 % 3 AS INTEGER) AS rack
FROM placed
"""

#: Every pair of neighbouring lines that stood at an earlier place; runs of such pairs go unless they are blank.
PASSAGES = """
WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL),
pairs AS (SELECT doc_id, i, line || chr(10) || lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS pair FROM lines),
again AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY doc_id, i) AS n FROM pairs WHERE pair IS NOT NULL) WHERE n > 1),
runs AS (SELECT doc_id, min(i) AS first, max(i) + 1 AS last FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS g FROM again) GROUP BY doc_id, g),
goes AS (SELECT r.doc_id, first, last FROM runs r JOIN lines l ON l.doc_id = r.doc_id AND l.i BETWEEN first AND last GROUP BY r.doc_id, first, last HAVING bool_or(trim(translate(line, chr(13) || chr(9), '')) <> '')),
stay AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM lines l WHERE NOT EXISTS (SELECT 1 FROM goes g WHERE g.doc_id = l.doc_id AND l.i BETWEEN first AND last) GROUP BY doc_id),
counts AS (SELECT doc_id, count(*) AS n FROM goes GROUP BY doc_id), done AS (SELECT d.doc_id, d.text AS old, CASE WHEN n IS NULL THEN d.text ELSE coalesce(s.text, '') END AS text, coalesce(n, 0) AS n FROM documents d LEFT JOIN counts USING (doc_id) LEFT JOIN stay s ON s.doc_id = d.doc_id)
SELECT doc_id, text, CAST(n AS INTEGER) AS n_removed, CAST(coalesce(length(old), 0) - coalesce(length(text), 0) AS INTEGER) AS removed_chars FROM done
"""

#: These pages keep their main text in one article, in paragraphs and lines, and use five character references.
MAIN_TEXTS = r"""
WITH a AS (
  SELECT page_id, url, regexp_replace(regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|$)', 1), '</?(?:p|h1|br)>', ' ', 'g'), '<[^>]*>', '', 'g') AS t FROM pages
), d AS (
  SELECT page_id, url, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(t, '&amp;?', chr(1), 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), chr(1), '&'), '[ \t\n\r\f\v]+', ' ', 'g')) AS text FROM a
)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM d
"""

DIVERGENCE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), '{_CAPITALS}', '{_SMALL}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), o AS (SELECT k, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT k) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN kept USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d), v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
full_counts AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n FROM g JOIN kept ON kept.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
p AS (
  SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS p FROM full_counts JOIN v USING (lang)
), q AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS q FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term) JOIN v USING (lang)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), every AS (SELECT a.lang, a.source, b.source AS item FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source)
SELECT lang, source, 'pair' AS part, item, CAST(coalesce(value, 0) AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY coalesce(value, 0) DESC, item) AS INTEGER) AS rank
FROM every LEFT JOIN pairs USING (lang, source, item)
UNION ALL
SELECT lang, source, 'term', term, CAST(p - q AS BIGINT), CAST(row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) AS INTEGER) AS rank
FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q QUALIFY rank <= 50
"""

LEXICAL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(text, '{_CAPITALS}', '{_SMALL}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL
), sized AS (SELECT k, doc_id, len(w) AS n FROM d WHERE len(w) > 0), s AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM sized),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{_CAPITALS}', '{_SMALL}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE text IS NOT NULL),
tf AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(w) AS term FROM d) SEMI JOIN asked USING (term) GROUP BY k, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, s GROUP BY term, n_docs),
scored AS (
  SELECT item_id, k, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM asked JOIN tf USING (term) JOIN w USING (term) JOIN sized USING (k), s GROUP BY item_id, k, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0 QUALIFY rank <= 10
"""

SQL = {
    "op2_containment_leaks": CONTAINMENT,
    "op4_dictionary_warc": ARCHIVES,
    "op5_line_chunks": linechunks.ORACLE,
    "op5_line_passages": PASSAGES,
    "op7_typed_chat": CONVERSATIONS,
    "op8_subspace_pigeonhole": VECTORS,
    "op9_parity_sketch_join": NEAR_TEXTS,
    "op10_hash_tree_shards": SHARDS,
    "op11_block_tree_extract": MAIN_TEXTS,
    "op12_source_divergence": DIVERGENCE,
    "op13_lexical_search": LEXICAL,
}
