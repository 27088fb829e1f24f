"""Queries of the training-data operators, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_pages

    records, _, _ = archive_pages(_table(spark, sf_dir, "pages"), least_bytes=0)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    out = near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, distance=4)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .imatch import compare_edited

    return compare_edited(_table(spark, sf_dir, "documents"))


def op4_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, held_out, score_documents

    docs = _table(spark, sf_dir, "documents")
    scored = score_documents(docs, fit(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted", F.to_json("spans").alias("spans"))


def op5_bpe_prefix_dp(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    from .bpe import encode_documents
    from .bpe import vocabulary as read

    spec = read(vocabulary)
    out = encode_documents(_table(spark, sf_dir, "documents"), spec)
    n_tokens = (F.octet_length("ids") / 4).cast("long").alias("n_tokens")
    return out.select("doc_id", n_tokens, F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    from .bpe import vocabulary as read
    from .packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), read(vocabulary))


def op7_int8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    return nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op8_best_fit_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_documents

    return shard_documents(_table(spark, sf_dir, "documents"), shards=8)


def op9_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import dedup_lines

    out = dedup_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import remove_repeats

    out = remove_repeats(_table(spark, sf_dir, "documents"), window=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import audit

    return audit(_table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversations import Repair, damaged

    found = Repair(damaged(_table(spark, sf_dir, "conversations")))
    digests = found.digests().withColumnRenamed("conv_id", "_id")
    return found.report.join(digests, F.col("conv_id").eqNullSafe(F.col("_id"))).drop("_id")


def op13_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_model import LanguageModel

    docs = _table(spark, sf_dir, "documents")
    return LanguageModel(docs).score(docs)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[:2] == "op" and name[2].isdigit()}


ORACLE = {
    "op1_warc_normaliser": """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS keeper FROM p)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes,
 array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  CAST(1 + ((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) AS INT), 1)), '') AS payload_digest,
 CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keeper THEN keeper END AS refers_to, url FROM k""",
    "op7_int8_nearest": """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x) / (sqrt(list_dot_product(q.x, q.x)) * sqrt(list_dot_product(c.x, c.x))) AS score
 FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.x) = len(c.x)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5""",
    "op10_substring_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, unnest(range(1, greatest(len(w) - 33, 1))) AS i FROM d),
h AS (SELECT s.r, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM s JOIN d ON s.r = d.r),
again AS (SELECT r, i FROM h QUALIFY count(*) OVER (PARTITION BY h) > 1),
gone AS (SELECT DISTINCT r, i + k AS j FROM again, range(0, 35) t(k)),
words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d),
kept AS (SELECT words.r, string_agg(word, ' ' ORDER BY words.j) AS text FROM words LEFT JOIN gone ON words.r = gone.r AND words.j = gone.j WHERE gone.j IS NULL GROUP BY 1),
n AS (SELECT r, count(*) AS n FROM gone GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN n ON d.r = n.r LEFT JOIN kept ON d.r = kept.r""",
    "op11_source_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS (SELECT r, lang, source, translate(unnest(w), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
kept AS (SELECT lang, term FROM o GROUP BY ALL HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN kept USING (lang, term) GROUP BY ALL),
full_ AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, kept.term) AS n_all,
 sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang) AS total_all, v FROM g JOIN kept ON g.lang = kept.lang JOIN v ON g.lang = v.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
s AS (SELECT lang, source, term, n, CAST(1 + 1000000000 * CAST(n + 1 AS HUGEINT) // (total + v) AS HUGEINT) AS p, CAST(1 + 1000000000 * CAST(n_all + 1 AS HUGEINT) // (total_all + v) AS HUGEINT) AS q FROM full_),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
rows_ AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
 LEFT JOIN pairs ON pairs.lang = x.lang AND pairs.source = x.source AND pairs.item = y.source
 UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM s WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM rows_)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200""",
    "op12_conversation_repair": r"""
WITH RECURSIVE poly AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)) AS t),
d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
h AS (SELECT d.*, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(k, ''), lambda c: ascii(c)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) % 20 AS harm FROM d, poly),
x AS (SELECT conv_id, turn, unnest(CASE WHEN harm = 3 THEN [0, 1] ELSE [0] END) AS copy, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role,
 CASE WHEN harm = 1 THEN '' WHEN harm = 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM h WHERE harm <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(role)::VARCHAR || ':' || role || text), copy) AS i, substr(role, 1, 1) AS r FROM x),
f AS (SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
 NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut, lag(r) OVER (PARTITION BY conv_id ORDER BY i) || r AS two FROM o),
g AS (SELECT *, blank OR again AS gone, CASE WHEN cut AND NOT blank AND NOT again THEN 3 ELSE 0 END AS w, role || ':' || text AS line FROM f),
s AS (SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
 count(*) FILTER (w > 0) AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT conv_id, 0::BIGINT AS i, {'c': 0, 's': '', 'b': ''} AS v0, {'c': 1000000000, 's': '', 'b': ''} AS v1, {'c': 1000000000, 's': '', 'b': ''} AS v2, {'c': 1000000000, 's': '', 'b': ''} AS v3 FROM s
 UNION ALL
 SELECT conv_id, i, {'c': v0.c + 4, 's': v0.s || 'D', 'b': v0.b},
  list_min([{'c': v1.c + 4, 's': v1.s || 'D', 'b': v1.b}, {'c': CASE WHEN r = 's' AND NOT gone THEN v0.c + w ELSE 1000000000 END, 's': v0.s || 'K', 'b': v0.b || chr(10) || line}]),
  list_min(list_concat([{'c': a2.c + 4, 's': a2.s || 'D', 'b': a2.b}], flatten(list_transform([v0, v1, a3], lambda z: [
   {'c': CASE WHEN gone THEN 1000000000 ELSE z.c + 3 + w END, 's': z.s || 'R', 'b': z.b || chr(10) || 'user:' || text},
   {'c': CASE WHEN r = 'u' AND NOT gone THEN z.c + w ELSE 1000000000 END, 's': z.s || 'K', 'b': z.b || chr(10) || line}])))),
  list_min([{'c': a3.c + 4, 's': a3.s || 'D', 'b': a3.b}, {'c': CASE WHEN gone THEN 1000000000 ELSE a2.c + 3 + w END, 's': a2.s || 'R', 'b': a2.b || chr(10) || 'assistant:' || text},
   {'c': CASE WHEN r = 'a' AND NOT gone THEN a2.c + w ELSE 1000000000 END, 's': a2.s || 'K', 'b': a2.b || chr(10) || line}])
 FROM (SELECT q.conv_id, g.i, g.r, g.gone, g.w, g.line, g.text, v0, v1,
  list_min(list_concat([v2], list_transform([v0, v1, v3], lambda z: {'c': z.c + 3, 's': z.s || 'I', 'b': z.b || chr(10) || 'user:'}))) AS a2,
  list_min(list_concat([v3, {'c': v2.c + 3, 's': v2.s || 'I', 'b': v2.b || chr(10) || 'assistant:'}], list_transform([v0, v1], lambda z: {'c': z.c + 6, 's': z.s || 'II', 'b': z.b || chr(10) || 'user:' || chr(10) || 'assistant:'}))) AS a3
  FROM p q JOIN g ON g.conv_id IS NOT DISTINCT FROM q.conv_id AND g.i = q.i + 1)),
e AS (SELECT s.*, list_min([v0, v3, {'c': v2.c + 3, 's': v2.s || 'I', 'b': v2.b || chr(10) || 'assistant:'}, {'c': v1.c + 6, 's': v1.s || 'II', 'b': v1.b || chr(10) || 'user:' || chr(10) || 'assistant:'}]) AS v
 FROM s JOIN p ON s.conv_id IS NOT DISTINCT FROM p.conv_id AND p.i = s.n)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(v.c, 0) AS BIGINT) AS cost,
 coalesce(v.s, '') AS audit, sha256(coalesce(substr(v.b, 2), '')) AS repaired_sha256 FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN e ON a.conv_id IS NOT DISTINCT FROM e.conv_id""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
