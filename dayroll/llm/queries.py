"""Thin queries over the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .balls import cluster_vectors
from .byte_bpe import decode_bytes, encode_bytes
from .common import table
from .decontaminate import MASKS, SHARE, WINDOW, leaks
from .divergence import DOCUMENTS, TERMS, audit_sources
from .line_dedup import remove_repeated_lines
from .neighbours import near_duplicates
from .pieces import encode_pieces
from .quality import fit_quality, score_quality
from .sharding import shard_documents
from .similarity import similar
from .token_counts import count_tokens
from .toxicity import fit_toxicity, score_toxicity
from .warc import BREAKS, REFERENCES, UNSEEN, derivatives, responses


def op1_similar_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(table(spark, sf_dir, "documents")).drop("node", "text_hash")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"), 0.93)


_OP3_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(e) > 0
  AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  AND list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.93),
reach AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
c AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x), n AS (SELECT x, count(*) AS n_links FROM links GROUP BY x)
SELECT v.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON c.x = v.vec_id LEFT JOIN n ON n.x = v.vec_id"""


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), 24)


CRAWLED = "2024-01-01T00:00:00Z"


def op7_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derivatives(responses(table(spark, sf_dir, "pages"), CRAWLED))


def _op7_sql() -> str:
    text = f"regexp_replace(payload, '{UNSEEN}', '', 'g')"
    text = rf"regexp_replace({text}, '(?i)</?({BREAKS})(\s[^>]*)?/?>', chr(10), 'g')"
    text = f"regexp_replace({text}, '<[^>]*>', '', 'g')"
    n = "regexp_extract(x, '^([0-9]{1,7});', 1)"
    text = f"""array_to_string(list_transform(string_split({text}, '&#'), lambda x, i: CASE WHEN i = 1 THEN x
        WHEN try_cast({n} AS BIGINT) BETWEEN 1 AND 55295 OR try_cast({n} AS BIGINT) BETWEEN 57344 AND 1114111
        THEN chr(try_cast({n} AS INTEGER)) || substr(x, length({n}) + 2) ELSE '&#' || x END), '')"""
    for name, char in REFERENCES.items():
        text = f"replace({text}, '&{name};', '{char.replace(chr(39), chr(39) * 2)}')"
    text = rf"regexp_replace({text}, '[ \t\r\f]{{2,}}|[\t\r\f]', ' ', 'g')"
    text = rf"trim(regexp_replace({text}, ' ?\n[ \n]*', chr(10), 'g'), ' ' || chr(10))"
    rid = lambda kind, *parts: f"(SELECT '<urn:uuid:' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] || '>' FROM (SELECT md5(concat_ws(chr(10), '{kind}', {', '.join(parts)})) AS h))"
    line = lambda name, value: f"coalesce('{name}: ' || {value} || nl, '')"
    return rf"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS payload, chr(13) || chr(10) AS nl FROM pages),
r AS (SELECT *, {rid("response", "coalesce(page_id::VARCHAR, '')", "coalesce(url, '')", "'sha256:' || sha256(payload)")} AS refers_to,
  'HTTP/1.1 200 OK' || nl || 'Content-Type: text/html; charset=utf-8' || nl || 'Content-Length: ' || strlen(payload) || nl AS http FROM p),
o AS (SELECT *, 'sha256:' || sha256(http || nl || payload) AS source_digest, 'sha256:' || sha256(payload) AS payload_digest,
  {rid("conversion", "refers_to")} AS c_id, {rid("metadata", "refers_to")} AS m_id, {text} AS body,
  regexp_extract_all(payload, '(?i)<a\s[^>]*?href\s*=\s*"([^"]*)"', 1) AS links,
  regexp_replace(regexp_extract(payload, '(?is)<title[^>]*>(.*?)</title\s*>', 1), '[\r\n]+', ' ', 'g') AS title FROM r),
f AS (SELECT *, 'title: ' || title || nl || 'source-payload-digest: ' || payload_digest || nl || 'conversion: ' || c_id || nl
  || array_to_string(list_transform(list_filter(string_split(http, nl), lambda x: x <> ''), lambda x: 'source-header: ' || x || nl), '')
  || array_to_string(list_transform(links, lambda x: 'outlink: ' || regexp_replace(x, '[\r\n]+', '', 'g') || ' L a/@href' || nl), '') AS fields FROM o),
k AS (SELECT page_id, 'metadata' AS record_type, m_id AS record_id, refers_to, url AS target_uri, 'application/warc-fields' AS content_type, source_digest, payload_digest, fields AS block, nl FROM f
  UNION ALL SELECT page_id, 'conversion', c_id, refers_to, url, 'text/plain', source_digest, payload_digest, body, nl FROM f),
d AS (SELECT *, '{CRAWLED}' AS warc_date, strlen(block)::BIGINT AS content_length, 'sha256:' || sha256(block) AS block_digest FROM k)
SELECT page_id, record_type, record_id, refers_to, target_uri, warc_date, content_type, content_length, block_digest, source_digest, payload_digest,
  'WARC/1.1' || nl || {line("WARC-Type", "record_type")} || {line("WARC-Record-ID", "record_id")} || {line("WARC-Refers-To", "refers_to")} || {line("WARC-Target-URI", "replace(replace(target_uri, chr(13), '%0D'), chr(10), '%0A')")}
  || {line("WARC-Date", "warc_date")} || {line("WARC-Block-Digest", "block_digest")} || {line("WARC-Source-Block-Digest", "source_digest")} || {line("Content-Type", "content_type")}
  || {line("Content-Length", "content_length")} AS headers, block FROM d"""


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 512)


def op9_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _op9_sql(documents: str = "documents") -> str:
    words = lambda: "list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"
    seed = lambda m: "concat_ws(' ', " + ", ".join(f"w[p + {k}]" for k, c in enumerate(m) if c == "1") + ")"
    seeds = lambda t: " UNION ALL ".join(f"SELECT *, {i} AS mask, {seed(m)} AS seed FROM (SELECT *, unnest(range(1, len(w) - {len(m)} + 2)) AS p FROM {t})" for i, m in enumerate(MASKS))
    return f"""
WITH d AS (SELECT doc_id, {words()} AS w FROM {documents}), b AS (SELECT DISTINCT item_id, {words()} AS w FROM benchmark),
ds AS ({seeds("d")}), bs AS ({seeds("b")}),
h AS (SELECT DISTINCT ds.doc_id, bs.item_id, ds.w AS dw, bs.w AS bw, ds.p - bs.p AS doc_offset FROM ds JOIN bs ON ds.mask = bs.mask AND ds.seed = bs.seed),
e AS (SELECT *, list_transform(range(1, len(bw) + 1), lambda p: CASE WHEN p + doc_offset >= 1 AND p + doc_offset <= len(dw) AND dw[p + doc_offset] = bw[p] THEN 1 ELSE 0 END) AS eq,
  least({WINDOW}, len(bw)) AS width FROM h),
v AS (SELECT doc_id, item_id, doc_offset, len(bw) AS item_tokens, list_sum(eq) AS matched, width,
  list_max(list_transform(range(1, len(bw) - width + 2), lambda s: list_sum(eq[s : s + width - 1]))) AS best FROM e)
SELECT doc_id, item_id, best::BIGINT AS best, matched::BIGINT AS matched, item_tokens::BIGINT AS item_tokens, doc_offset::BIGINT AS doc_offset FROM v WHERE best >= ceil(width * {SHARE})
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY best DESC, matched DESC, doc_offset) = 1"""


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(table(spark, sf_dir, "documents"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents),
w AS (SELECT doc, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT doc) >= {DOCUMENTS}),
v AS (SELECT lang, count(*) AS v, sum(total) AS n FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT d.lang, d.source, any_value(coalesce(s.n, 0)) AS n FROM d LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source) s ON s.lang = d.lang AND s.source = d.source GROUP BY d.lang, d.source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.n + v.v) AS p, 1 + (1000000000::HUGEINT * (k.total + 1)) // (v.n + v.v) AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM r QUALIFY part = 'pair' OR rank <= {TERMS}"""


def op13_ball_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cluster_vectors(table(spark, sf_dir, "embeddings"), k=40, rounds=5, seed="2")
    return found.withColumn("centroid", F.sha2(F.array_join("centroid", ","), 256)).withColumnRenamed("centroid", "centroid_sha256")


def _op13_sql(k: int = 40, rounds: int = 5) -> str:
    square = "list_sum(list_transform(list_zip(v.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    steps = [f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), e) - 1 AS c, e FROM v QUALIFY c < {k})"""]
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT row, min(({square}, c.c)) AS best FROM v, c{r} c GROUP BY row)")
        if r < rounds:
            steps.append(f"""
s{r} AS (SELECT c, i, sum(x)::BIGINT AS x, count(*) AS n FROM (SELECT a.best[2] AS c, unnest(range(1, 65)) AS i, unnest(v.e) AS x FROM a{r} a JOIN v USING (row)) GROUP BY c, i),
m{r} AS (SELECT c, list((x - ((x % n) + n) % n) // n ORDER BY i) AS e FROM s{r} GROUP BY c),
c{r + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.e, c.e) AS e FROM c{r} c LEFT JOIN m{r} m USING (c))""")
    return f"""{",".join(steps)}
SELECT v.vec_id, a.best[2]::INTEGER AS cluster, a.best[1]::BIGINT AS distance, (sum(a.best[1]) OVER (PARTITION BY a.best[2]))::BIGINT AS cluster_inertia, (sum(a.best[1]) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c.e, ',')) AS centroid_sha256 FROM v JOIN a{rounds} a USING (row) JOIN c{rounds} c ON c.c = a.best[2]"""


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = decode_bytes(encode_bytes(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN), ranks)
    digests = {"ids_sha256": F.sha2(F.array_join("ids", " "), 256), "decoded_sha256": F.sha2("decoded", 256)}
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), *[c.alias(n) for n, c in digests.items()])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_similar_texts, op2_line_dedup, op3_embedding_duplicates, op4_quality, op5_pieces, op6_shards, op7_warc_derivatives, op8_token_counts, op9_leaks, op10_toxicity, op11_divergence, op12_byte_bpe, op13_ball_clusters)}

ORACLE_SQL: dict[str, str] = {"op3_embedding_duplicates": _OP3_SQL, "op7_warc_derivatives": _op7_sql(), "op9_leaks": _op9_sql(), "op11_divergence": _OP11_SQL, "op13_ball_clusters": _op13_sql()}
