"""The registered queries of these operators, and the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, divergence, exact_dedup, html_text, language, manifest, merkle, near_dedup, packing, quality, quotes, vectors, warc
from .common import table


def tokenizer() -> str:
    """The public tokenizer file of the token queries."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's expected grade, tail probabilities and verdict."""
    return quality.rated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_captures(spark, table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op4_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprints(table(spark, sf_dir, "documents")).drop("edits")


def op5_sum_of_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer())


def op6_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_texts(table(spark, sf_dir, "pages"))


def op7_minhash_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op8_rank_array_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(table(spark, sf_dir, "documents"), tokenizer())


def op9_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identified(table(spark, sf_dir, "documents"))


def op10_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.linked(table(spark, sf_dir, "conversations"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audited(table(spark, sf_dir, "documents"))


def op12_projection_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_groups(table(spark, sf_dir, "embeddings"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.audited(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_ordinal_quality, op2_warc_transactions, op3_chunk_recipes, op4_merkle_fingerprints, op5_sum_of_squares,
        op6_text_density, op7_minhash_stars, op8_rank_array_bpe, op9_rank_order_language,
        op10_quotation_links, op11_source_divergence, op12_projection_collisions, op13_merkle_manifest,
    )
}

ORACLE = {
    "op2_warc_transactions": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
d AS (SELECT page_id, n, sha256(html) AS digest, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to FROM d""",
    "op3_chunk_recipes": r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS n,
    regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id) AS keep_id,
  count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id) AS kept, sha256(t) AS text_sha256 FROM n""",
    "op7_minhash_stars": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inter FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * inter >= 75 * (x.n + y.n - inter)),
r(node, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.seen FROM r JOIN e ON e.a = r.node),
c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN c ON c.node = w.doc_id""",
    "op10_quotation_links": r"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS id, conv_id, turn, role, coalesce(text, '') AS raw FROM conversations),
l AS (SELECT id, pos, length(regexp_replace(regexp_extract(line, '^(?:[ \t]{0,3}>)+'), '[^>]', '', 'g')) AS level,
    regexp_replace(line, '^(?:[ \t]{0,3}>)+ ?', '') AS body
  FROM (SELECT id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS pos
    FROM (SELECT id, regexp_replace(raw, '\r\n?', chr(10), 'g') AS t FROM m))),
n AS (SELECT *, coalesce(lead(level) OVER (PARTITION BY id ORDER BY pos), 0) AS after FROM l),
o AS (SELECT id, max(level) > 0 AS has, string_agg(body, chr(10) ORDER BY pos) FILTER (level = 0 AND NOT (after > 0 AND regexp_matches(body,
    '(?i)\b(?:wrote|schrieb|a écrit|escribió|ha scritto|schreef)\b[^\n]*:[ \t]*$'))) AS said FROM n GROUP BY id),
t AS (SELECT m.*, CASE WHEN has THEN regexp_replace(regexp_replace(coalesce(said, ''), '\n[ \t]*(?:\n[ \t]*)+\n', chr(10) || chr(10), 'g'),
    '^\s+|\s+$', '', 'g') ELSE raw END AS text FROM m JOIN o USING (id)),
lv AS (SELECT DISTINCT id, level FROM l WHERE level > 0),
q AS (SELECT lv.id, lv.level, string_agg(CASE WHEN l.level = lv.level THEN l.body ELSE '' END, chr(10) ORDER BY pos) AS text
  FROM lv JOIN l USING (id) GROUP BY 1, 2),
parts AS (SELECT id, level, unnest(regexp_split_to_array(text, '\n[ \t]*(?:\n[ \t]*)*\n')) AS p FROM (SELECT id, level, text FROM q UNION ALL SELECT id, 0, text FROM t)),
pas AS (SELECT DISTINCT id, level, p FROM (SELECT id, level, trim(regexp_replace(lower(x), '\s+', ' ', 'g')) AS p
  FROM (SELECT id, level, p AS x FROM parts UNION ALL SELECT id, level, unnest(string_split(p, chr(10))) FROM parts)) WHERE p <> ''),
said AS (SELECT conv_id, p, min(turn) AS said FROM pas JOIN m USING (id) WHERE level = 0 AND turn IS NOT NULL GROUP BY 1, 2),
hits AS (SELECT DISTINCT m.conv_id, m.turn, level, pas.p, said FROM pas JOIN m USING (id) JOIN said s ON s.conv_id = m.conv_id AND s.p = pas.p
  WHERE level > 0 AND said < turn),
par AS (SELECT conv_id, turn, reply_to FROM (SELECT conv_id, turn, said AS reply_to,
    row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, sum(length(p)) DESC, said DESC) AS rn FROM hits GROUP BY conv_id, turn, level, said) WHERE rn = 1),
num AS (SELECT conv_id, turn, count(DISTINCT p) AS n_linked FROM hits GROUP BY 1, 2),
up(conv_id, turn, thread, depth) AS (SELECT conv_id, turn, reply_to, 1 FROM par UNION ALL
  SELECT up.conv_id, up.turn, par.reply_to, depth + 1 FROM up JOIN par ON par.conv_id = up.conv_id AND par.turn = up.thread),
root AS (SELECT *, row_number() OVER (PARTITION BY conv_id, thread ORDER BY turn) AS position
  FROM (SELECT conv_id, turn, min(thread) AS thread, max(depth) AS depth FROM up GROUP BY 1, 2)),
nq AS (SELECT id, count(DISTINCT p) AS n FROM pas WHERE level > 0 GROUP BY 1)
SELECT t.conv_id, t.turn, t.role, t.text, coalesce(nq.n, 0) AS n_quotes, coalesce(n_linked, 0) AS n_linked, reply_to,
  coalesce(root.thread, t.turn) AS thread, coalesce(root.depth, 0)::BIGINT AS depth, coalesce(root.position, 0)::BIGINT AS position
FROM t LEFT JOIN nq USING (id) LEFT JOIN par ON par.conv_id = t.conv_id AND par.turn = t.turn
LEFT JOIN num ON num.conv_id = t.conv_id AND num.turn = t.turn LEFT JOIN root ON root.conv_id = t.conv_id AND root.turn = t.turn""",
    "op11_source_divergence": r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS id,
    unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
k AS (SELECT lang, term, count(*)::HUGEINT AS n FROM t GROUP BY 1, 2 HAVING count(DISTINCT id) >= 30),
l AS (SELECT lang, sum(n)::HUGEINT AS total, count(*)::HUGEINT AS v FROM k GROUP BY 1),
q AS (SELECT k.lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (total + 5 * v) AS q FROM k JOIN l USING (lang)),
g AS (SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
c AS (SELECT t.lang, source, term, count(*)::HUGEINT AS n FROM t JOIN k USING (lang, term) GROUP BY 1, 2, 3),
s AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM c GROUP BY 1, 2),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(s.total, 0) + 5 * v) AS p
  FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN s ON s.lang = g.lang AND s.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
d AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(d.value, 0) AS value FROM g x JOIN g y ON y.lang = x.lang AND y.source <> x.source
  LEFT JOIN d ON d.lang = x.lang AND d.source = x.source AND d.item = y.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM r WHERE part = 'pair' OR rank <= 50""",
    "op12_projection_collisions": r"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r(node, seen) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT e.b, r.seen FROM r JOIN e ON e.a = r.node),
c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY 1),
n AS (SELECT a, count(*) AS n FROM e GROUP BY 1)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON c.node = vec_id LEFT JOIN n ON n.a = vec_id""",
    "op13_merkle_manifest": r"""
WITH RECURSIVE d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE 's' || source END AS src,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    text, replace(text, chr(10), '') AS cut,
    list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)),
      lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)), lambda y, i: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384) ELSE y // 2 END)) AS crc
  FROM documents),
l AS (SELECT doc_id, src, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN xor(crc, 4294967295) % 2 = 0 THEN sha256(head || coalesce(strlen(cut) || ':' || cut, '-')) END AS given,
    row_number() OVER (PARTITION BY src ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY src) AS n FROM d),
s(src, lvl, pos, n, h) AS (SELECT src, 0, pos, n, leaf FROM l UNION ALL
  SELECT src, lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM s WHERE n > 1 GROUP BY src, lvl, pos // 3, n),
b AS (SELECT src, h AS subroot, lvl AS depth, row_number() OVER (ORDER BY src) - 1 AS pos, count(*) OVER () AS n FROM s WHERE n = 1),
t(lvl, pos, n, h) AS (SELECT 0, pos, n, subroot FROM b UNION ALL
  SELECT lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY lvl, pos // 3, n),
root AS (SELECT h AS root FROM t WHERE n = 1),
k AS (SELECT src, lvl, pos, n, h FROM s UNION ALL SELECT NULL, lvl, pos, n, h FROM t),
f(doc_id, src, tree, lvl, pos, now, proof) AS (SELECT doc_id, src, src, 0, pos, coalesce(given, leaf), '' FROM l UNION ALL (
  WITH up AS (SELECT f.doc_id, f.src, f.tree, f.lvl, f.pos, f.now, f.proof, k.n FROM f JOIN k ON k.src IS NOT DISTINCT FROM f.tree AND k.lvl = f.lvl AND k.pos = f.pos
    WHERE f.tree IS NOT NULL OR k.n > 1)
  SELECT up.doc_id, up.src, up.tree, up.lvl + 1, up.pos // 3, sha256(string_agg(CASE WHEN k.pos = up.pos THEN up.now ELSE k.h END, '' ORDER BY k.pos)),
    up.proof || coalesce(string_agg(CASE WHEN k.pos <> up.pos THEN k.h END, '' ORDER BY k.pos), '')
  FROM up JOIN k ON k.src IS NOT DISTINCT FROM up.tree AND k.lvl = up.lvl AND k.pos // 3 = up.pos // 3
  WHERE up.n > 1 GROUP BY up.doc_id, up.src, up.tree, up.lvl, up.pos, up.now, up.proof
  UNION ALL SELECT up.doc_id, up.src, NULL, 0, b.pos, up.now, up.proof FROM up JOIN b ON b.src = up.src WHERE up.n = 1)),
e AS (SELECT f.doc_id, f.now AS folded_root, sha256(f.proof) AS proof_sha256 FROM f JOIN t ON f.tree IS NULL AND t.lvl = f.lvl AND t.pos = f.pos AND t.n = 1)
SELECT l.doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM l JOIN b USING (src) JOIN e USING (doc_id) CROSS JOIN root""",
}
