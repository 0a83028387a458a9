"""The jobs as registered queries: each runs its job twice into one new folder and returns the output as the second run leaves it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobs import dataset_release, pattern_inbox
from prismflow import storage
from prismflow.oracle import _LOGIT, _TOP


def job1_dataset_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = storage.fresh_path(spark, "job1")
    for _ in range(2):
        dataset_release.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", path, dataset_release.CONFIG)
    return dataset_release.released(spark, path, dataset_release.CONFIG)


def job2_pattern_inbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, vectors = storage.fresh_path(spark, "job2"), f"{sf_dir}/embeddings.parquet"
    for _ in range(2):
        pattern_inbox.run(spark, vectors, vectors, path, pattern_inbox.CONFIG)
    return pattern_inbox.predictions(spark, path, pattern_inbox.CONFIG)


QUERIES = {f.__name__: f for f in (job1_dataset_release, job2_pattern_inbox)}

JOB1 = r"""
WITH lab AS (SELECT doc_id, CAST(quality AS BIGINT) AS label FROM labels),
lab_bad AS (SELECT 'rejected labels' AS kind, doc_id, CASE WHEN doc_id IS NULL THEN 'no id' WHEN label IS NULL THEN 'empty' ELSE 'negative' END AS problem FROM lab WHERE doc_id IS NULL OR label IS NULL OR label < 0),
per_id AS (SELECT doc_id, min(label) AS label, max(label) AS other FROM lab WHERE doc_id IS NOT NULL AND label >= 0 GROUP BY doc_id),
good AS (SELECT doc_id, label FROM per_id WHERE label = other),
per_doc AS (SELECT doc_id, count(*) AS n, min(source) AS source, min(lang) AS lang, bool_and(coalesce(regexp_matches(text, '[^\x20\x09-\x0D]'), false)) AS worded, min(text) AS text
  FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id),
doc AS (SELECT * FROM per_doc WHERE n = 1 AND worded),
known AS (SELECT doc_id, source, lang, text, coalesce(lang, '') || '|' || label AS class FROM doc JOIN good USING (doc_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('42-' || doc_id), doc_id) AS rank, count(*) OVER (PARTITION BY source) AS size, dense_rank() OVER (ORDER BY class) - 1 AS class_id FROM known)
SELECT 'samples' AS kind, doc_id, source, lang, class, class_id, CASE WHEN rank <= floor(size * 0.8::DOUBLE) THEN 'train' WHEN rank <= floor(size * (0.8::DOUBLE + 0.1::DOUBLE)) THEN 'val' ELSE 'test' END AS split,
  rank, NULL::VARCHAR AS problem, sha256(text) AS text_sha256 FROM ranked
UNION ALL SELECT 'pool', doc_id, source, lang, NULL, NULL, NULL, NULL, NULL, NULL FROM doc WHERE doc_id NOT IN (SELECT doc_id FROM known)
UNION ALL SELECT kind, doc_id, NULL, NULL, NULL, NULL, NULL, NULL, problem, NULL FROM lab_bad
UNION ALL SELECT 'rejected labels', doc_id, NULL, NULL, NULL, NULL, NULL, NULL, 'labels differ', NULL FROM per_id WHERE label <> other
UNION ALL SELECT 'rejected labels', doc_id, NULL, NULL, NULL, NULL, NULL, NULL, 'no document', NULL FROM good WHERE doc_id NOT IN (SELECT doc_id FROM doc)
UNION ALL SELECT 'rejected documents', doc_id, NULL, NULL, NULL, NULL, NULL, NULL, 'no id', NULL FROM documents WHERE doc_id IS NULL
UNION ALL SELECT 'rejected documents', doc_id, NULL, NULL, NULL, NULL, NULL, NULL, CASE WHEN n > 1 THEN 'repeated id' ELSE 'no word' END, NULL FROM per_doc WHERE n > 1 OR NOT worded
"""

JOB2 = f"""
{_LOGIT}, {_TOP},
wide AS (SELECT vec_id, any_value(label) AS label, {", ".join(f"max(class) FILTER (rank = {r}) AS top{r}_class, round(max(p) FILTER (rank = {r}), 6) AS top{r}_p" for r in (1, 2, 3))},
  round(round(max(p) FILTER (rank = 1), 12) - round(max(p) FILTER (rank = 2), 12), 6) AS ahead FROM top GROUP BY vec_id)
SELECT * EXCLUDE (ahead), label = top1_class AS correct, 0::BIGINT AS batch, CASE WHEN ahead >= 0.01 THEN 'accept' ELSE 'review' END AS decision FROM wide
"""

ORACLE = {"job1_dataset_release": JOB1, "job2_pattern_inbox": JOB2}
