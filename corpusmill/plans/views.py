"""Logical tables that the queries derive from the data directory, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.runtime import table

#: Responses in groups of mixed size, groups of one among them; scores have both signs and ties.
ROLLOUTS = """rollouts AS (
  SELECT event_id AS idx, CAST(user_id AS VARCHAR) || '-' || CAST(event_id % 97 AS VARCHAR) AS uid, event_type AS data_source,
         value - 50.0 AS score, 1 + event_id % 13 AS length, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 5 AS pred
  FROM events)"""


def rollouts(spark, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(
        F.col("event_id").alias("idx"),
        F.concat_ws("-", F.col("user_id").cast("string"), (F.col("event_id") % 97).cast("string")).alias("uid"),
        F.col("event_type").alias("data_source"),
        (F.col("value") - 50.0).alias("score"),
        (F.col("event_id") % 13 + 1).alias("length"),
        (F.regexp_extract("props", "([0-9]+)", 1).cast("bigint") % 5).alias("pred"),
    )


#: Token sequences from the embeddings: masks with holes, and a few with nothing kept.
TOKENS = """tokens AS (
  SELECT vec_id AS seq, CAST(label AS BIGINT) * 1000 + vec_id % 7 AS uid, i - 1 AS t,
         CAST(embedding[i] AS DOUBLE) AS x, CAST(embedding[65 - i] AS DOUBLE) AS y, CAST(embedding[i % 64 + 1] AS DOUBLE) AS z,
         CASE WHEN i <= 16 + vec_id % 49 AND i % 11 <> 5 AND vec_id % 97 <> 3 THEN 1 ELSE 0 END AS mask,
         -abs(CAST(embedding[i] AS DOUBLE)) - 0.05 AS old_logp,
         -abs(CAST(embedding[i] AS DOUBLE)) - 0.05 + 0.9 * CAST(embedding[65 - i] AS DOUBLE) AS logp,
         -abs(CAST(embedding[i] AS DOUBLE)) - 0.05 - 0.7 * CAST(embedding[i % 64 + 1] AS DOUBLE) AS rollout_logp,
         10.0 * CAST(embedding[i % 64 + 1] AS DOUBLE) AS advantages
  FROM embeddings, range(1, 65) AS r(i))"""


def tokens(spark, sf: str) -> DataFrame:
    """One row a sequence: arrays x, y, z, mask, old_logp, logp, rollout_logp, advantages."""
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    i = lambda k: k + 1  # noqa: E731 - places from 1, as in SQL
    keep = lambda k: F.when((i(k) <= 16 + F.col("vec_id") % 49) & (i(k) % 11 != 5) & (F.col("vec_id") % 97 != 3), 1).otherwise(0)
    out = e.select(
        F.col("vec_id").alias("seq"),
        (F.col("label").cast("bigint") * 1000 + F.col("vec_id") % 7).alias("uid"),
        "x",
        F.reverse("x").alias("y"),
        F.concat(F.slice("x", 2, 63), F.slice("x", 1, 1)).alias("z"),
        F.transform("x", lambda v, k: keep(k)).alias("mask"),
    )
    base = lambda v: -F.abs(v) - 0.05
    return out.withColumns(
        {
            "old_logp": F.transform("x", base),
            "logp": F.zip_with("x", "y", lambda a, b: base(a) + 0.9 * b),
            "rollout_logp": F.zip_with("x", "z", lambda a, b: base(a) - 0.7 * b),
            "advantages": F.transform("z", lambda v: 10.0 * v),
        }
    )


def long_tokens(spark, sf: str) -> DataFrame:
    """The same in long form, masked tokens included."""
    arrays = ["x", "y", "z", "mask", "old_logp", "logp", "rollout_logp", "advantages"]
    return tokens(spark, sf).select("seq", "uid", F.posexplode(F.arrays_zip(*arrays)).alias("t", "p")).select("seq", "uid", F.col("t").cast("bigint").alias("t"), *[F.col("p")[a].alias(a) for a in arrays])


#: Normalised splits of the manifest with the order in which rows came.
MANIFEST = r"""m AS (
  SELECT sample_id, dataset, problem_id, version, CASE
      WHEN lower(trim(split)) IN ('train', 'training') THEN 'train'
      WHEN lower(trim(split)) IN ('valid', 'val', 'validation', 'dev', 'development') THEN 'valid'
      WHEN lower(trim(split)) IN ('test', 'testing') THEN 'test' END AS split
  FROM manifest),
firsts AS (SELECT sample_id, min(split) AS split, min(version) AS version FROM m WHERE split IS NOT NULL GROUP BY sample_id),
rows_ AS (
  SELECT s.sample_id AS idx, s.dataset || ':' || f.split AS key, s.dataset AS dataset, s.problem_id AS problem_id, s.prompt AS prompt, f.split AS split
  FROM dataset_samples s JOIN firsts f ON s.sample_id = f.sample_id)"""


def split_rows(spark, sf: str) -> DataFrame:
    """(idx, key, dataset, problem_id, prompt, split): samples with their split; key is dataset:split."""
    s = F.lower(F.trim("split"))
    split = F.when(s.isin("train", "training"), "train").when(s.isin("valid", "val", "validation", "dev", "development"), "valid").when(s.isin("test", "testing"), "test")
    firsts = table(spark, sf, "manifest").select("sample_id", split.alias("split")).filter("split IS NOT NULL").groupBy("sample_id").agg(F.min("split").alias("split"))
    return table(spark, sf, "dataset_samples").join(firsts, "sample_id").select(F.col("sample_id").alias("idx"), F.concat_ws(":", "dataset", "split").alias("key"), "dataset", "problem_id", "prompt", "split")


CANON = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce({c}, ''), '\r\n', chr(10), 'g'), '\r', chr(10), 'g'),
  '[\t\x{0B}\x{0C}\x{0D}\x{1C}-\x{1F}\x{85}\p{Z}]+(\n|\z)', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g'),
  '\A[\n\t\x{0B}\x{0C}\x{0D}\x{1C}-\x{1F}\x{85}\p{Z}]+|[\n\t\x{0B}\x{0C}\x{0D}\x{1C}-\x{1F}\x{85}\p{Z}]+\z', '', 'g')"""


def canon_sql(column: str) -> str:
    return CANON.replace("{c}", column)


def r6(col) -> Column:
    """Six decimals, without a negative zero."""
    return F.round(F.col(col) if isinstance(col, str) else col, 6) + 0.0


def rounded(df: DataFrame, *names: str) -> DataFrame:
    """The named columns (or all doubles) at six decimals."""
    chosen = names or [c for c, t in df.dtypes if t == "double"]
    return df.withColumns({c: r6(c) for c in chosen})
