"""Queries of samples, limits, balanced partitions and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions.runtime import table
from corpusmill.operators import retrieval as K
from corpusmill.operators import sampling as T
from corpusmill.operators.batch import pad_to_divisor
from corpusmill.plans.registry import REGISTRY as R
from corpusmill.plans.views import ROLLOUTS, rollouts, rounded


@R.add("t1_cap_then_filter", "WITH c AS (SELECT event_id, value FROM events ORDER BY sha256('11|' || CAST(event_id AS VARCHAR)), event_id LIMIT 200) SELECT event_id, value FROM c WHERE value > 50")
def t1_cap_then_filter(spark, sf):
    return T.capped_then_filtered(table(spark, sf, "events").select("event_id", "value"), 200, F.col("value") > 50, 11, "event_id")


@R.add("t1_head", "SELECT event_id, value FROM events ORDER BY event_id LIMIT 100")
def t1_head(spark, sf):
    return T.first_rows(table(spark, sf, "events").select("event_id", "value"), 100, "event_id")


@R.add("t2_curriculum", "SELECT event_id, row_number() OVER (ORDER BY event_type, event_id) - 1 AS nth, event_type FROM events")
def t2_curriculum(spark, sf):
    """Levels in order, each in the order of its ids."""
    rows = table(spark, sf, "events").select("event_id", "event_type")
    return T.ordered(rows, "curriculum", difficulty="event_type", key="event_id").withColumnRenamed("place", "nth")


@R.add("t2_random", "SELECT event_id, row_number() OVER (ORDER BY substr(sha256('5|' || CAST(event_id AS VARCHAR)), 1, 13), event_id) - 1 AS place FROM events")
def t2_random(spark, sf):
    """Every row's place in a seeded random order."""
    return T.ordered(table(spark, sf, "events").select("event_id"), "random", 5, key="event_id")


@R.add("t3_eval_cap", "SELECT record_id FROM per_problem ORDER BY sha256('3|' || CAST(record_id AS VARCHAR)), record_id LIMIT 150")
def t3_eval_cap(spark, sf):
    return T.seeded_rows(table(spark, sf, "per_problem").select("record_id"), 150, 3, "record_id")


@R.add(
    "t5_qa_sample",
    """WITH b AS (SELECT dataset, problem_id, record_id, coalesce(error_type, 'none') AS t, sha256('9|' || CAST(record_id AS VARCHAR)) AS h FROM per_problem WHERE dataset IS NOT NULL AND problem_id IS NOT NULL),
one AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY dataset, problem_id, t ORDER BY h, record_id) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY dataset, t ORDER BY h, record_id) AS r FROM one QUALIFY r <= 40),
k AS (SELECT *, CASE WHEN t <> 'success' AND r <= 3 THEN 0 WHEN t = 'success' AND count(*) FILTER (t = 'success') OVER (PARTITION BY dataset) <= 3 THEN 1 WHEN t <> 'success' THEN 2 ELSE 3 END AS tier FROM r),
o AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY dataset, problem_id ORDER BY tier, h, record_id) = 1)
SELECT dataset, problem_id, record_id, t AS kind, tier FROM o QUALIFY tier = 0 OR row_number() OVER (PARTITION BY dataset ORDER BY tier, h, record_id) <= 40""",
)
def t5_qa_sample(spark, sf):
    rows = table(spark, sf, "per_problem").filter("dataset IS NOT NULL AND problem_id IS NOT NULL")
    return T.qa_sample(rows, 40, 3, 9)


@R.add("t6_generations", "SELECT input FROM (SELECT DISTINCT prompt AS input FROM per_problem WHERE prompt IS NOT NULL) ORDER BY sha256('42|' || input), input LIMIT 16")
def t6_generations(spark, sf):
    return T.generations_to_log(table(spark, sf, "per_problem").filter("prompt IS NOT NULL").select(F.col("prompt").alias("input")).distinct(), 16)


@R.add("t13_ordinal_split", "WITH n AS (SELECT count(*) AS n FROM events) SELECT event_id, CASE WHEN event_id < CAST(floor(n * 0.75) AS BIGINT) THEN 'train' ELSE 'test' END AS split FROM events, n")
def t13_ordinal_split(spark, sf):
    e = table(spark, sf, "events").select("event_id")
    return T.ordinal_split(e, 0.75, e.count(), "event_id")


@R.add("t9_workload", "SELECT record_id, 24576 * gen_tokens + gen_tokens * gen_tokens AS workload FROM per_problem")
def t9_workload(spark, sf):
    return table(spark, sf, "per_problem").select("record_id", T.workload("gen_tokens").alias("workload"))


#: Rollouts padded with rows from their head to whole batches of 64.
_PADDED = ROLLOUTS + """, padded AS (SELECT idx, length FROM rollouts UNION ALL SELECT n + idx, length FROM rollouts, (SELECT count(*) AS n FROM rollouts) WHERE idx < (64 - n % 64) % 64)"""


def _batches(spark, sf, size):
    rows = rollouts(spark, sf)
    whole, _ = pad_to_divisor(rows.select("idx", "length"), size, rows.count())
    return whole.select(F.floor(F.col("idx") / size).cast("bigint").alias("batch"), "idx", (F.col("length") * 37).alias("length"), F.floor(F.col("idx") / 4).cast("string").alias("uid"))


@R.add("t7_balanced")
def t7_balanced(spark, sf):
    """Batches of 64 cut into eight parts of equal count by the differencing method."""
    return T.balanced(_batches(spark, sf, 64), 8)


_GREEDY = f"""WITH RECURSIVE {_PADDED}, w AS (SELECT idx // 64 AS batch, idx, idx % 64 AS k, 24576 * (length * 37) + (length * 37) * (length * 37) AS w FROM padded),
s AS (SELECT DISTINCT batch, CAST(-1 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS idx, CAST(NULL AS BIGINT) AS part, list_transform(range(8), lambda x: CAST(0 AS BIGINT)) AS sums, list_transform(range(8), lambda x: CAST(0 AS BIGINT)) AS n FROM w
  UNION ALL SELECT batch, k, idx, part, list_transform(sums, lambda x, i: x + CASE WHEN i = part + 1 THEN w ELSE 0 END), list_transform(n, lambda x, i: x + CASE WHEN i = part + 1 THEN 1 ELSE 0 END) FROM (
    SELECT s.batch, w.k, w.idx, w.w, s.sums, s.n, list_position(list_transform(s.sums, lambda x, i: CASE WHEN s.n[i] < 8 THEN x END), list_min(list_transform(s.sums, lambda x, i: CASE WHEN s.n[i] < 8 THEN x END))) - 1 AS part FROM s JOIN w ON w.batch = s.batch AND w.k = s.k + 1))
SELECT batch, idx, part FROM s WHERE k >= 0"""


@R.add("t8_greedy", _GREEDY)
def t8_greedy(spark, sf):
    """The same by the greedy method."""
    return T.balanced(_batches(spark, sf, 64), 8, method="greedy")


@R.add("t10_groups_whole", f"WITH {_PADDED} SELECT idx // 64 AS batch, CAST(idx // 4 AS VARCHAR) AS uid, 1 AS parts, count(*) AS rows FROM padded GROUP BY 1, 2")
def t10_groups_whole(spark, sf):
    """Every run of rows with one prompt lies in one part."""
    b = _batches(spark, sf, 64)
    got = T.balanced_groups(b, 4).join(b.select("batch", "idx", "uid"), ["batch", "idx"])
    return got.groupBy("batch", "uid").agg(F.count_distinct("part").cast("int").alias("parts"), F.count(F.lit(1)).alias("rows"))


@R.add("t11_micro_whole", f"WITH {_PADDED}, b AS (SELECT idx // 64 AS batch, count(*) AS rows, CAST(sum(length * 37) AS BIGINT) AS tokens, CAST(least(count(*), ceil(sum(length * 37) / 2048.0)) AS BIGINT) AS micros FROM padded GROUP BY 1) SELECT batch, rows, tokens, micros, true AS near FROM b")
def t11_micro_whole(spark, sf):
    """Micro-batches hold every row of their batch once, in the right number, none far above the limit."""
    b = _batches(spark, sf, 64)
    got = T.micro_batches(b, 2048).join(b.select("batch", "idx", "length"), ["batch", "idx"]).groupBy("batch", "micro").agg(F.count(F.lit(1)).alias("rows"), F.sum("length").alias("tokens"))
    return got.groupBy("batch").agg(F.sum("rows").alias("rows"), F.sum("tokens").cast("bigint").alias("tokens"), F.count(F.lit(1)).alias("micros"), (F.max("tokens") <= 2.0 * 2048).alias("near"))


@R.add("t12_order_whole", f"WITH {_PADDED} SELECT idx // 64 AS batch, p.part, list_transform(range(8), lambda x: CAST(x AS BIGINT)) AS places, true AS small_ends FROM padded, range(8) AS p(part) GROUP BY 1, 2")
def t12_order_whole(spark, sf):
    """In each part every place is taken once, workloads rise and then fall."""
    b = _batches(spark, sf, 64)
    got = T.balance_order(T.balanced(b, 8).join(b.select("batch", "idx", "length"), ["batch", "idx"]))
    per = got.groupBy("batch", "part").agg(F.sort_array(F.collect_list(F.struct(F.col("place").cast("bigint").alias("place"), "length"))).alias("p"))
    lengths = F.transform("p", lambda x: x["length"])
    top = F.array_position(lengths, F.array_max(lengths)).cast("int")
    rising = F.slice(lengths, F.lit(1), top) == F.sort_array(F.slice(lengths, F.lit(1), top))
    rest = F.slice(lengths, top, F.size(lengths) - top + 1)
    return per.select("batch", "part", F.transform("p", lambda x: x["place"]).alias("places"), (rising & (rest == F.sort_array(rest, asc=False))).alias("small_ends"))


@R.add("t7_balanced_sizes", f"WITH {_PADDED} SELECT idx // 64 AS batch, part, 8 AS rows FROM padded, range(8) AS p(part) GROUP BY 1, 2")
def t7_balanced_sizes(spark, sf):
    return T.balanced(_batches(spark, sf, 64), 8).groupBy("batch", "part").agg(F.count(F.lit(1)).cast("int").alias("rows"))


@R.add("t10_group_balanced")
def t10_group_balanced(spark, sf):
    """Runs of four rows with one prompt stay together."""
    return T.balanced_groups(_batches(spark, sf, 64), 4)


@R.add("t11_micro_batches")
def t11_micro_batches(spark, sf):
    """Micro-batches of about 2048 tokens."""
    return T.micro_batches(_batches(spark, sf, 64), 2048)


@R.add("t11_micro_batch_count", f"WITH {_PADDED} SELECT idx // 64 AS batch, CAST(least(count(*), ceil(sum(length * 37) / 2048.0)) AS BIGINT) AS n FROM padded GROUP BY 1")
def t11_micro_batch_count(spark, sf):
    return T.micro_batch_count(_batches(spark, sf, 64), 2048)


@R.add("t12_balance_order")
def t12_balance_order(spark, sf):
    """The order within each part: small ones first and last."""
    b = _batches(spark, sf, 64)
    return T.balance_order(T.balanced(b, 8).join(b.select("batch", "idx", "length"), ["batch", "idx"])).select("batch", "idx", "part", "place")


@R.add("pf13_group_filter", f"WITH {ROLLOUTS} SELECT idx, uid FROM rollouts QUALIFY max(score) OVER (PARTITION BY uid) <> min(score) OVER (PARTITION BY uid)")
def pf13_group_filter(spark, sf):
    return T.group_filter(rollouts(spark, sf)).select("idx", "uid")


@R.add(
    "j8_prefix_groups",
    """WITH b AS (SELECT event_id // 500 AS batch, event_id AS idx, event_type AS uid FROM events), n AS (SELECT *, CASE WHEN uid = lag(uid) OVER (PARTITION BY batch ORDER BY idx) THEN 0 ELSE 1 END AS new FROM b),
g AS (SELECT *, CAST(sum(new) OVER (PARTITION BY batch ORDER BY idx) - 1 AS BIGINT) AS grp FROM n)
SELECT batch, grp, uid, min(idx) AS first_idx, count(*) AS rows FROM g GROUP BY batch, grp, uid""",
)
def j8_prefix_groups(spark, sf):
    rows = table(spark, sf, "events").select(F.floor(F.col("event_id") / 500).cast("bigint").alias("batch"), F.col("event_id").alias("idx"), F.col("event_type").alias("uid"))
    return T.prefix_groups(rows)


_NORM = "v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), q AS (SELECT vec_id AS query_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS q FROM v WHERE vec_id % 100 = 0)"


@R.add("k2_dense_search", f"WITH {_NORM}, s AS (SELECT query_id, vec_id, list_dot_product(q, v) AS score FROM q, v), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, round(score, 6) + 0.0 AS score, rank FROM r WHERE rank <= 5")
def k2_dense_search(spark, sf):
    """Every vector whose id is divisible by 100 as a query, against all vectors."""
    v = table(spark, sf, "embeddings").select("vec_id", "embedding")
    q = v.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    return rounded(K.dense_search(q, v, 5), "score").withColumn("rank", F.col("rank").cast("bigint"))


@R.add(
    "k3_bm25",
    """WITH q AS (SELECT item_id AS query_id, w AS word, count(*) AS qf FROM (SELECT item_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS w FROM heldout_items WHERE item_id % 100 = 0) WHERE w <> '' GROUP BY 1, 2),
d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda w: w <> '') AS w FROM documents),
t AS (SELECT count(*) AS n, avg(len(w)) AS avg FROM d), tf AS (SELECT doc_id, len, word, count(*) AS tf FROM (SELECT doc_id, len(w) AS len, unnest(w) AS word FROM d) WHERE word IN (SELECT word FROM q) GROUP BY 1, 2, 3),
df AS (SELECT word, count(*) AS df FROM tf GROUP BY word),
s AS (SELECT query_id, doc_id, round(sum(qf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg))), 6) AS score FROM tf JOIN df ON df.word = tf.word JOIN q ON q.word = tf.word, t GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)
SELECT query_id, doc_id, round(score, 4) + 0.0 AS score FROM r WHERE rank <= 10""",
)
def k3_bm25(spark, sf):
    """Held-out items whose id is divisible by 100 as queries, against all documents."""
    q = table(spark, sf, "heldout_items").filter("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), "text")
    return K.bm25(q, table(spark, sf, "documents")).select("query_id", "doc_id", (F.round("score", 4) + 0.0).alias("score"))


@R.add("k1_fetch", "SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT vec_id * 7 FROM embeddings)")
def k1_fetch(spark, sf):
    from corpusmill.operators.batch import take

    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("idx"), F.col("vec_id"), "label")
    return take(e, e.select(F.col("idx").alias("pos"), (F.col("idx") * 7).alias("idx"))).select("vec_id", "label")


@R.add("k4_pooling", "SELECT vec_id, list_transform(range(1, 5), lambda k: round(list_avg(list_transform(range(CAST(1 + vec_id % 7 AS BIGINT)), lambda t: CAST(embedding[t * 4 + k] AS DOUBLE))), 6) + 0.0) AS pooled FROM embeddings")
def k4_pooling(spark, sf):
    from corpusmill.functions.sequences import pooled

    vectors = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda t: F.transform(F.slice("embedding", t * 4 + 1, 4), lambda v: v.cast("double")))
    mask = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda t: F.when(t < 1 + F.col("vec_id") % 7, 1).otherwise(0))
    rows = table(spark, sf, "embeddings").select("vec_id", vectors.alias("v"), mask.alias("m"))
    return rows.select("vec_id", F.transform(pooled("v", "m"), lambda x: F.round(x, 6) + 0.0).alias("pooled"))


@R.add(
    "k5_retrieve",
    f"""WITH {_NORM}, s AS (SELECT query_id, vec_id, round(list_dot_product(q, v), 9) AS score FROM q, v), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, list(r.vec_id ORDER BY rank) AS docs, list(CAST(e.label AS BIGINT) ORDER BY rank) AS labels FROM r JOIN embeddings e ON e.vec_id = r.vec_id WHERE rank <= 3 GROUP BY query_id""",
)
def k5_retrieve(spark, sf):
    """The passages of each query in rank order."""
    v = table(spark, sf, "embeddings").select("vec_id", "embedding", "label")
    found = K.dense_search(v.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), v, 3)
    out = K.retrieve(found, v, "vec_id", "label")
    return out.select("query_id", F.transform("passages", lambda p: p["vec_id"]).alias("docs"), F.transform("passages", lambda p: p["label"].cast("bigint")).alias("labels"))
