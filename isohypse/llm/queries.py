"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, clustering, decontaminate, filter_audit, language, neural_lm, ngram_join, pii, quality, secrets, suffix_dedup, toxicity, urls

RANKS = "byte_bpe_50k.tiktoken"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(_read(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_read(spark, sf_dir, "documents")).drop("left_words")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_read(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_read(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(_read(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_read(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(_read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(_read(spark, sf_dir, "embeddings"))


def op12_neural_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neural_lm.score(_read(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_byte_bpe, op2_decontaminate, op3_quality, op4_language, op5_toxicity, op6_pii, op7_suffix_dedup, op8_secrets, op9_url_filter, op10_ngram_join, op11_centroids, op12_neural_lm, op13_filter_audit)}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACED = r"[^\x20\x09-\x0D]+"

_OP2 = rf"""
WITH b AS (SELECT item_id::VARCHAR AS id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT id, least(len(ws), 13) AS size, array_to_string(ws[i:i+least(len(ws), 13)-1], ' ') AS win FROM (SELECT id, ws, unnest(range(1, greatest(len(ws)-12, 1)+1)) AS i FROM b WHERE len(ws) > 0)),
d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents),
dw AS (SELECT doc_id, size, i, array_to_string(ws[i:i+size-1], ' ') AS win FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws)-size+2)) AS i FROM d, (SELECT DISTINCT size FROM bw) WHERE len(ws) >= size)),
m AS (SELECT doc_id, dw.size AS size, i, id FROM dw JOIN bw ON dw.size = bw.size AND dw.win = bw.win),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i+size)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, id FROM m) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20*coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""

_OP3 = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS ws FROM documents),
l AS (SELECT doc_id, source, text, raw, regexp_extract_all(translate(raw, '{_UPPER}123456789', '{_LOWER}000000000'), '{_SPACED}') AS lw FROM (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS raw FROM d)),
k AS (SELECT *, array_to_string(lw, ' ') AS norm FROM l WHERE len(lw) > 0),
hosts AS (SELECT source, count(DISTINCT text) AS docs FROM d GROUP BY source),
common AS (SELECT source, norm FROM (SELECT source, norm, count(DISTINCT text) AS n FROM k GROUP BY source, norm) JOIN hosts USING (source) WHERE n >= greatest(50, docs*0.05)),
gone AS (SELECT doc_id, sum(len(lw)) AS words FROM k JOIN common USING (source, norm) GROUP BY doc_id),
dup AS (SELECT doc_id, count(*)-count(DISTINCT raw) AS n FROM k GROUP BY doc_id),
win AS (SELECT doc_id, i, array_to_string(ws[i:i+4], ' ') AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws)-3)) AS i FROM d WHERE len(ws) >= 5)),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i+5)) AS p FROM win SEMI JOIN (SELECT doc_id, w FROM win GROUP BY doc_id, w HAVING count(*) > 1) USING (doc_id, w)) GROUP BY doc_id),
s AS (SELECT doc_id, len(ws) AS n_words, coalesce(list_sum([length(x) for x in ws]), 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(gone.words, 0) AS lost
FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100*n_repeat_words > 20*n_words AS base_failed,
NOT (n_words < 10 OR 100*n_repeat_words > 20*n_words) AND n_words-lost >= 0.3*n_words AS kept FROM s"""

_OP10 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_SPACED}'), []) AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i+4], ' ') AS sh FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws)-4, 1)+1)) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100*c >= 80*(na.n+nb.n-c)),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, links.b FROM r JOIN links ON links.a = r.reach)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id) m USING (doc_id)"""

_OP11 = f"""
WITH e AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, [floor(64*x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings WHERE len(embedding) = 64 AND len([x for x in embedding if x IS NOT NULL AND isfinite(x)]) = 64),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('1:' || vec_id))-1)::INT AS k, v AS c FROM e ORDER BY sha256('1:' || vec_id) LIMIT 16),
{"".join(f"""a{r} AS MATERIALIZED (SELECT rid, any_value(vec_id) AS vec_id, any_value(v) AS v, min({{'d': list_sum([(p[1]-p[2])*(p[1]-p[2]) for p in list_zip(v, c)])::BIGINT, 'k': k}}) AS m FROM e, c{r} GROUP BY rid),
s{r} AS (SELECT k, list((s - ((s % n)+n) % n) // n ORDER BY i)::BIGINT[] AS c FROM (SELECT m.k AS k, i, sum(v[i]) AS s, count(*) AS n FROM (SELECT m, v, unnest(range(1, 65)) AS i FROM a{r}) GROUP BY m.k, i) GROUP BY k),
c{r+1} AS MATERIALIZED (SELECT k, coalesce(s{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN s{r} USING (k)),
""" for r in range(3))}a3 AS (SELECT rid, any_value(vec_id) AS vec_id, min({{'d': list_sum([(p[1]-p[2])*(p[1]-p[2]) for p in list_zip(v, c)])::BIGINT, 'k': k}}) AS m FROM e, c3 GROUP BY rid)
SELECT vec_id, m.k AS cluster, m.d AS distance, (sum(m.d) OVER (PARTITION BY m.k))::BIGINT AS cluster_inertia, (sum(m.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a3 JOIN c3 ON c3.k = m.k"""

_OP13 = rf"""
WITH l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS ws, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents),
m AS (SELECT part, (len(ws) < 100)::INT + 2*(100*len(list_distinct(ws)) < 80*len(ws))::INT + 4*(100*length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10*length(t))::INT + 8*regexp_matches(t, '[#$%&*|]')::INT + 16*coalesce(doc_id > least, false)::INT AS mask,
  coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM d LEFT JOIN l USING (doc_id)),
g AS (SELECT part, mask, good, toxic, count(*) AS n FROM m GROUP BY ALL),
fs AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM fs a, fs b, fs c, fs d, fs e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT filter_order, i::INT AS step, 1 << (ascii(filter_order[i])-65) AS nxt, coalesce(list_sum([1 << (ascii(x)-65) for x in string_split(filter_order[1:i-1], '') if x <> '']), 0)::INT AS applied FROM (SELECT filter_order, unnest(range(1, 6)) AS i FROM o)),
r AS (SELECT part, filter_order, step, nxt,
  sum(CASE WHEN mask & (nxt | applied) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
  sum(CASE WHEN mask & nxt > 0 AND mask & applied = 0 THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN mask & nxt > 0 AND mask & applied > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
  sum(CASE WHEN mask = nxt THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN mask & nxt > 0 AND mask & applied = 0 AND good THEN n ELSE 0 END)::BIGINT AS good_lost,
  sum(CASE WHEN mask & nxt > 0 AND mask & applied = 0 AND toxic THEN n ELSE 0 END)::BIGINT AS toxic_lost
FROM g, s GROUP BY part, filter_order, step, nxt)
SELECT * EXCLUDE (nxt), sum(removed) OVER (PARTITION BY part, nxt)::BIGINT AS shapley FROM r"""

#: Only operators whose whole result SQL can express; the others are tested by brute force.
ORACLES: dict[str, str] = {"op2_decontaminate": _OP2, "op3_quality": _OP3, "op10_ngram_join": _OP10, "op11_centroids": _OP11, "op13_filter_audit": _OP13}
