"""Queries of the batch algebra, over orders and customers as batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions.runtime import table
from corpusmill.operators import batch as B
from corpusmill.plans.registry import REGISTRY as R

_O = "orders_ AS (SELECT o_orderkey AS idx, o_custkey, o_orderstatus, o_totalprice FROM orders)"


def _orders(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("idx"), "o_custkey", "o_orderstatus", "o_totalprice")


def _size(df):
    return df.count()


@R.add("pf0_info", f"WITH {_O} SELECT count(*) AS rows, min(idx) AS first, max(idx) AS last, 'idx,o_custkey,o_orderstatus,o_totalprice' AS columns FROM orders_")
def pf0_info(spark, sf):
    return B.info(_orders(spark, sf))


@R.add("pf0_numbering", f"WITH {_O} SELECT min(idx) = 0 AND max(idx) + 1 = count(*) AND count(DISTINCT idx) = count(*) AS ok FROM orders_")
def pf0_numbering(spark, sf):
    return B.check_numbering(_orders(spark, sf))


@R.add("pf1_select", f"WITH {_O} SELECT idx, o_totalprice FROM orders_")
def pf1_select(spark, sf):
    return B.select(_orders(spark, sf), ["o_totalprice"])


@R.add("pf2_pop", f"WITH {_O} SELECT idx, o_custkey, o_totalprice FROM orders_")
def pf2_pop(spark, sf):
    return B.pop(_orders(spark, sf), ["o_orderstatus"])[1]


@R.add("pf3_rename", f"WITH {_O} SELECT idx, o_custkey AS cust, o_orderstatus, o_totalprice AS price FROM orders_")
def pf3_rename(spark, sf):
    return B.rename(_orders(spark, sf), {"o_custkey": "cust", "o_totalprice": "price"})


@R.add("pf4_assign", f"WITH {_O} SELECT *, 7 AS version, 'run' AS tag FROM orders_")
def pf4_assign(spark, sf):
    return B.assign(_orders(spark, sf), version=7, tag="run")


@R.add("pf5_gather", f"WITH {_O}, o AS (SELECT l_orderkey * 3 + l_linenumber AS pos, l_orderkey AS p FROM lineitem) SELECT DISTINCT o.pos AS idx, o_custkey, o_orderstatus, o_totalprice FROM orders_ JOIN o ON o.p = orders_.idx")
def pf5_gather(spark, sf):
    picks = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 3 + F.col("l_linenumber")).alias("pos"), F.col("l_orderkey").alias("idx"))
    return B.take(_orders(spark, sf), picks).distinct()


@R.add("pf5_mask", f"WITH {_O} SELECT * FROM orders_ WHERE o_totalprice > 200000 AND o_orderstatus <> 'F'")
def pf5_mask(spark, sf):
    return B.where(_orders(spark, sf), (F.col("o_totalprice") > 200000) & (F.col("o_orderstatus") != "F"))


@R.add("pf6_slice", f"WITH {_O} SELECT * FROM orders_ WHERE idx >= 100 AND idx < (SELECT count(*) FROM orders_) - 50 AND (idx - 100) % 7 = 0")
def pf6_slice(spark, sf):
    o = _orders(spark, sf)
    return B.slice_rows(o, 100, -50, 7, _size(o))


@R.add("pf7_reorder", f"WITH {_O} SELECT (SELECT count(*) FROM orders_) - 1 - idx AS idx, o_custkey, o_orderstatus, o_totalprice FROM orders_")
def pf7_reorder(spark, sf):
    o = _orders(spark, sf)
    n = _size(o)
    return B.reorder(o, B.inverse(o.select(F.col("idx").alias("pos"), (n - 1 - F.col("idx")).alias("idx"))))


@R.add("pf9_nonempty", "SELECT sample_id, problem_id FROM dataset_samples WHERE length(problem_id) > 0")
def pf9_nonempty(spark, sf):
    return table(spark, sf, "dataset_samples").filter(F.length("problem_id") > 0).select("sample_id", "problem_id")


@R.add("j1_zip", f"WITH {_O} SELECT o.idx, o.o_custkey, o.o_orderstatus, o.o_totalprice, 2 * o_totalprice AS twice FROM orders_ o")
def j1_zip(spark, sf):
    o = _orders(spark, sf)
    return B.zip_union(o, o.select("idx", "o_custkey", (2 * F.col("o_totalprice")).alias("twice")))


@R.add("u1_concat", f"WITH {_O} SELECT idx, o_custkey, o_orderstatus, o_totalprice FROM orders_ UNION ALL SELECT idx + (SELECT count(*) FROM orders_), o_custkey, 'X', o_totalprice FROM orders_")
def u1_concat(spark, sf):
    o = _orders(spark, sf)
    n = _size(o)
    return B.concat([o, o.withColumn("o_orderstatus", F.lit("X"))], [n, n])


@R.add("u2_chunk", f"WITH {_O}, n AS (SELECT count(*) AS n FROM orders_) SELECT chunk, count(*) AS rows, min(idx) AS first FROM (SELECT idx, CASE WHEN idx < (n % 7) * (n // 7 + 1) THEN idx // (n // 7 + 1) ELSE n % 7 + (idx - (n % 7) * (n // 7 + 1)) // (n // 7) END AS chunk FROM orders_, n) GROUP BY chunk")
def u2_chunk(spark, sf):
    o = _orders(spark, sf)
    return B.chunk(o, 7, _size(o), even=True).groupBy("chunk").agg(F.count(F.lit(1)).alias("rows"), F.min("idx").alias("first"))


@R.add("u3_split", f"WITH {_O} SELECT idx // 64 AS chunk, count(*) AS rows, max(idx) AS last FROM orders_ GROUP BY 1")
def u3_split(spark, sf):
    return B.split(_orders(spark, sf), 64).groupBy("chunk").agg(F.count(F.lit(1)).alias("rows"), F.max("idx").alias("last"))


@R.add("u4_repeat_interleaved", f"WITH {_O} SELECT idx * 3 + r AS idx, o_custkey, o_orderstatus, o_totalprice FROM orders_, range(3) AS x(r)")
def u4_repeat_interleaved(spark, sf):
    return B.repeat(_orders(spark, sf), 3)


@R.add("u4_repeat_blocks", f"WITH {_O} SELECT r * (SELECT count(*) FROM orders_) + idx AS idx, o_custkey, o_orderstatus, o_totalprice FROM orders_, range(2) AS x(r)")
def u4_repeat_blocks(spark, sf):
    o = _orders(spark, sf)
    return B.repeat(o, 2, interleave=False, size=_size(o))


@R.add("u5_repeat_each", f"WITH {_O} SELECT idx, o_custkey % 4 AS times, r AS copy FROM orders_, range(4) AS x(r) WHERE r < o_custkey % 4")
def u5_repeat_each(spark, sf):
    return B.repeat_each(_orders(spark, sf).select("idx", (F.col("o_custkey") % 4).alias("times")), "times")


@R.add("u6_unfold_columns", "SELECT vec_id * 8 + r AS idx, round(list_sum(list_transform(embedding[r * 8 + 1:r * 8 + 8], lambda v: CAST(v AS DOUBLE))), 6) + 0.0 AS total, label FROM embeddings, range(8) AS x(r)")
def u6_unfold_columns(spark, sf):
    from corpusmill.plans.views import r6

    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("idx"), F.transform("embedding", lambda v: v.cast("double")).alias("v"), "label")
    return B.unfold_columns(e, 8, ["v"]).select("idx", r6(F.aggregate("v", F.lit(0.0), lambda a, x: a + x)).alias("total"), "label")


@R.add("u7_fold", f"WITH {_O} SELECT idx // 10 AS idx, list(o_custkey ORDER BY orders_.idx) AS o_custkey FROM orders_ GROUP BY 1")
def u7_fold(spark, sf):
    return B.fold(_orders(spark, sf), 10, "o_custkey")


@R.add("u7_unfold", f"WITH {_O} SELECT idx, o_custkey FROM orders_")
def u7_unfold(spark, sf):
    return B.unfold(B.fold(_orders(spark, sf), 10, "o_custkey"), 10, "o_custkey")


@R.add("u8_pad_to_divisor", f"WITH {_O}, n AS (SELECT count(*) AS n FROM orders_) SELECT idx, o_custkey FROM orders_ UNION ALL SELECT n + k, o_custkey FROM n, range(4096) AS r(k), orders_ WHERE k < (4096 - n % 4096) % 4096 AND idx = k % n")
def u8_pad_to_divisor(spark, sf):
    o = _orders(spark, sf).select("idx", "o_custkey")
    return B.pad_to_divisor(o, 4096, _size(o))[0]


@R.add("u8_unpad", f"WITH {_O} SELECT idx, o_custkey FROM orders_")
def u8_unpad(spark, sf):
    o = _orders(spark, sf).select("idx", "o_custkey")
    n = _size(o)
    padded, extra = B.pad_to_divisor(o, 4096, n)
    return B.unpad(padded, extra, n + extra)


@R.add("u9_pad_last", f"WITH {_O}, n AS (SELECT count(*) AS n FROM orders_) SELECT idx, o_custkey FROM orders_ UNION ALL SELECT n + r, o_custkey FROM orders_, n, range(5) AS x(r) WHERE idx = n - 1")
def u9_pad_last(spark, sf):
    o = _orders(spark, sf).select("idx", "o_custkey")
    return B.pad_with(o, 5, _size(o), last=True)


@R.add("u10_minibatches", f"WITH {_O} SELECT epoch, idx // 50 AS step, count(*) AS rows, min(idx) AS first FROM orders_, range(3) AS e(epoch) GROUP BY 1, 2")
def u10_minibatches(spark, sf):
    o = _orders(spark, sf)
    return B.minibatches(o, 50, 3, _size(o)).groupBy("epoch", "step").agg(F.count(F.lit(1)).alias("rows"), F.min("idx").alias("first"))


@R.add("u10_shuffled", f"WITH {_O} SELECT epoch, CAST(count(*) / 50 AS BIGINT) AS steps, 50 AS rows, count(*) AS seen FROM orders_, range(2) AS e(epoch) GROUP BY epoch")
def u10_shuffled(spark, sf):
    o = _orders(spark, sf)
    per = B.minibatches(o, 50, 2, _size(o), seed=3).groupBy("epoch", "step").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("idx").alias("d"))
    return per.groupBy("epoch").agg(F.count(F.lit(1)).alias("steps"), F.max("n").cast("int").alias("rows"), F.sum("d").alias("seen"))


@R.add(
    "u12_sets",
    """WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders), b AS (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_mktsegment = 'BUILDING'), u AS (SELECT k FROM a UNION SELECT k FROM b)
SELECT (SELECT count(*) FROM a) AS size_a, (SELECT count(*) FROM b) AS size_b, count(*) AS size_union, count(*) FILTER (k IN (SELECT k FROM a) AND k IN (SELECT k FROM b)) AS size_both,
  count(*) FILTER (k NOT IN (SELECT k FROM b)) AS only_a, count(*) FILTER (k NOT IN (SELECT k FROM a)) AS only_b, count(*) FILTER (k IN (SELECT k FROM a) AND k IN (SELECT k FROM b)) = 0 AS disjoint, count(*) FILTER (k NOT IN (SELECT k FROM b)) = 0 AS a_in_b FROM u""",
)
def u12_sets(spark, sf):
    a = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"))
    b = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("k"))
    return B.set_relations(a, b, "k")


@R.add("u14_dispatch", f"WITH {_O} SELECT idx, o_totalprice * 2 AS twice FROM orders_")
def u14_dispatch(spark, sf):
    return B.map_chunks(_orders(spark, sf), 4, lambda d: d.select("idx", (F.col("o_totalprice") * 2).alias("twice")))


@R.add("u14b_one_to_all", f"WITH {_O} SELECT idx, w AS worker FROM orders_, range(3) AS r(w)")
def u14b_one_to_all(spark, sf):
    """Every row for every worker."""
    return B.one_to_all(_orders(spark, sf).select("idx"), 3)


@R.add("u14b_mesh", f"WITH {_O} SELECT idx, o_totalprice + 1 AS up FROM orders_")
def u14b_mesh(spark, sf):
    """Two workers a data group, uneven rows padded; the first of each group gives its rows back."""
    orders = _orders(spark, sf)
    sent = B.to_mesh(orders.select("idx", "o_totalprice"), [0, 0, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 6, 6], orders.count())
    return B.from_mesh(sent.select("idx", "worker", "padding", (F.col("o_totalprice") + 1).alias("up")), [True, False] * 7)


@R.add("u14b_mesh_sent", f"WITH {_O}, n AS (SELECT count(*) AS n, CAST(ceil(count(*) / 7.0) AS BIGINT) AS k FROM orders_) SELECT w AS worker, k AS rows FROM n, range(14) AS r(w)")
def u14b_mesh_sent(spark, sf):
    """How many rows each worker of the mesh is sent."""
    orders = _orders(spark, sf)
    sent = B.to_mesh(orders.select("idx"), [0, 0, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 6, 6], orders.count())
    return sent.groupBy("worker").agg(F.count(F.lit(1)).alias("rows"))
