"""Queries over the operators here, each over whole tables.

Imports of third-party tokenizers happen inside the operators' tasks; the paths of
vocabulary files are parameters taken from the installed ``public_tokenizers``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, centroids, hnsw, html_model, importance, mixing, ordinal, quality, recompress, secretscan, simhash, suffix, tokenfile
from tessera.llm.common import read


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digest(read(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return html_model.extract(pages.select("page_id", "url", "html"), html_model.fit(pages))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompress.digest(read(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    ratings = labels.select("doc_id", (F.col("quality") + 1 - F.col("toxic")).alias("grade"))
    return ordinal.grade(docs, ordinal.fit(docs, ratings, grades=3))


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = tokenfile.write_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return tokenfile.token_digests(spark, out)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sizes(read(spark, sf_dir, "documents"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(read(spark, sf_dir, "embeddings"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digest(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.rules(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


def op11_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return secretscan.scan(docs, secretscan.dictionary(docs))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(read(spark, sf_dir, "embeddings"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.ranked(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


#: The mix of op6: closed-form targets, certain copies, then the Pareto order cut by words.
MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         (CAST('0x' || substr(md5('7|' || doc_id), 1, 12) AS BIGINT)::DOUBLE + 0.5) / 281474976710656 AS u
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) FILTER (WHERE size > 0) AS documents FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS weight FROM s),
r AS (SELECT *, 3.0::DOUBLE * source_size / weight AS ratio, sum(source_size) OVER () AS everything, sum(weight) OVER () AS heavy FROM w),
l AS (
  SELECT *, (everything - 3.0::DOUBLE * coalesce(sum(source_size) OVER o, 0)) / (heavy - coalesce(sum(weight) OVER o, 0)) AS level
  FROM r WINDOW o AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size, documents, least(3.0::DOUBLE * source_size, (SELECT arg_min(level, ratio) FROM l WHERE level <= ratio) * weight) AS target FROM l),
p AS (SELECT *, floor(target / source_size) AS sure, target - floor(target / source_size) * source_size AS rest FROM t),
o AS (
  SELECT d.doc_id, d.size, d.source, p.source_size, p.target, p.sure, p.rest,
         (d.u / (1 - d.u)) / (((p.rest / p.source_size) / (1 - p.rest / p.source_size)) * sqrt(d.size / (p.source_size / p.documents))) AS rank
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
x AS (
  SELECT *, sum(size) OVER (PARTITION BY source, size > 0 ORDER BY rank) - size / 2.0 AS middle FROM o)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN size = 0 THEN 0 ELSE size * (sure + CASE WHEN rest > 0 AND middle <= rest THEN 1 ELSE 0 END) END AS BIGINT) AS taken
FROM x
"""


_NEAREST = """
{name} AS (
  SELECT n, arg_min(cluster, distance * 16 + cluster) AS cluster, min(distance) AS distance
  FROM (SELECT n, cluster, CAST(list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS distance FROM kept, {centroids})
  GROUP BY n)"""

_MOVED = """
{name} AS (
  SELECT old.cluster, coalesce(new.c, old.c) AS c
  FROM {old} old LEFT JOIN (
    SELECT cluster, list(CAST((total - ((total % rows) + rows) % rows) // rows AS BIGINT) ORDER BY i) AS c
    FROM (SELECT cluster, i, sum(v[i]) AS total, count(*) AS rows FROM kept JOIN {assigned} USING (n), range(1, 65) AS x(i) GROUP BY cluster, i)
    GROUP BY cluster) new USING (cluster))"""

#: Clustering of op12: three rounds over all distances, then one more assignment.
CLUSTER_SQL = (
    """
WITH kept AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS (
  SELECT cluster, c FROM (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS cluster, v AS c FROM kept WHERE vec_id IS NOT NULL) WHERE cluster < 16),"""
    + ",".join(_NEAREST.format(name=f"a{k}", centroids=f"c{k}") + "," + _MOVED.format(name=f"c{k + 1}", old=f"c{k}", assigned=f"a{k}") for k in range(3))
    + ","
    + _NEAREST.format(name="a3", centroids="c3")
    + """
SELECT vec_id, CAST(a3.cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY a3.cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM kept JOIN a3 USING (n) JOIN c3 ON c3.cluster = a3.cluster
"""
)

#: Resampling of op13: crc32 of each distinct feature byte by byte, counts, gains, means, then the order.
RESAMPLE_SQL = r"""
WITH step AS (
  SELECT list(list_reduce(range(8), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, b) ORDER BY b) AS t
  FROM (SELECT CAST(range AS BIGINT) AS b FROM range(256))),
texts AS (
  SELECT 0 AS kind, row_number() OVER () AS n, doc_id, text FROM documents UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark),
words AS (
  SELECT kind, n, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
features AS (
  SELECT kind, n, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM words),
told AS (
  SELECT f, xor(list_reduce(list_transform(range(octet_length(encode(f))), lambda i: CAST('0x' || substr(hex(encode(f)), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)),
                        lambda x, b: xor(x >> 8, t[CAST(xor(x, b) & 255 AS INTEGER) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT f FROM features), step),
counts AS (SELECT bucket, count(*) FILTER (WHERE kind = 0) AS s, count(*) FILTER (WHERE kind = 1) AS t FROM features JOIN told USING (f) GROUP BY bucket),
sums AS (SELECT CAST(sum(s) AS DOUBLE) AS all_s, CAST(sum(t) AS DOUBLE) AS all_t FROM counts),
gain AS (SELECT bucket, CAST(floor(1000 * ln((t + 1.0::DOUBLE) * (all_s + 10000) / ((s + 1.0::DOUBLE) * (all_t + 10000)))) AS BIGINT) AS g FROM counts, sums),
means AS (SELECT n, count(*) AS n_features, CAST(sum(g) AS BIGINT) AS total FROM features JOIN told USING (f) JOIN gain USING (bucket) WHERE kind = 0 GROUP BY n),
scored AS (
  SELECT n, doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features,
         CASE WHEN n_features IS NULL THEN 0 ELSE (total - ((total % n_features) + n_features) % n_features) // n_features END AS weight,
         CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS noise
  FROM words LEFT JOIN means USING (n) WHERE kind = 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY weight + noise DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_words >= 20) AS able FROM scored)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(weight + noise AS BIGINT) AS score,
       CAST(CASE WHEN n_words >= 20 AND place <= 25 * able // 100 THEN place END AS BIGINT) AS rank
FROM placed
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_mixing": MIX_SQL, "op12_centroid_clustering": CLUSTER_SQL, "op13_importance_resampling": RESAMPLE_SQL}
