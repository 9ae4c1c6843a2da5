"""Golden cases, edge cases and properties of the core's operators."""

import json
import math
import random
import time

import numpy as np
import pytest
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from corpusmill.functions import grading as G
from corpusmill.functions import ranking, sequences, skew
from corpusmill.functions import text as T
from corpusmill.operators import advantages as A
from corpusmill.operators import batch as B
from corpusmill.operators import correction as C
from corpusmill.operators import flatten, governance, losses, metrics, recipes, retrieval, rewards
from corpusmill.operators import sampling as S
from corpusmill.sources import io
from corpusmill.streaming import queue as Q


FAILS = (PySparkException, Py4JError)


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


# ---------------------------------------------------------------- advantages and losses


def scored(spark, pairs):
    return spark.createDataFrame([(i, u, float(s)) for i, (u, s) in enumerate(pairs)], "idx bigint, uid string, score double")


def test_group_mean_std_of_three(spark):
    out = rows(A.group_mean_std(scored(spark, [("0", 1), ("1", 2), ("0", 3)])).select("idx", "mean", "std", "n"), "idx")
    assert out == [(0, 2.0, math.sqrt(2), 2), (1, 0.0, 1.0, 1), (2, 2.0, math.sqrt(2), 2)]


def test_group_operators_on_nothing(spark):
    none = spark.createDataFrame([], "idx bigint, uid string, score double, length bigint")
    for fn in (A.grpo, A.grpo_floored, A.rloo, A.rloo_vectorized, A.opo, A.gpg, A.group_mean_std):
        assert fn(none).count() == 0


def test_single_responses(spark):
    one = scored(spark, [("a", 3), (None, 4)]).withColumn("length", F.lit(2))
    assert rows(A.grpo(one).select("advantage"), "advantage") == [(3 / (1 + 1e-6),), (4 / (1 + 1e-6),)]
    assert rows(A.rloo(one).select("advantage"), "advantage") == [(3.0,), (4.0,)]
    assert rows(A.rloo_vectorized(one).select("advantage")) == [(0.0,), (0.0,)]
    assert rows(A.opo(one).select("advantage"), "advantage") == [(3.0,), (4.0,)]
    with pytest.raises(FAILS):
        A.grpo_passk(one).collect()


def test_loop_and_vector_rloo_agree(spark):
    rng = random.Random(4)
    df = scored(spark, [(str(rng.randrange(5)), rng.random()) for _ in range(64)])
    a, b = rows(A.rloo(df), "idx"), rows(A.rloo_vectorized(df), "idx")
    assert all(math.isclose(x[-1], y[-1], rel_tol=1e-5, abs_tol=1e-6) for x, y in zip(a, b))


def test_factorize_labels(spark):
    df = spark.createDataFrame([(v,) for v in ["a", "b", "a", "c", "0042", "42"]], "label string")
    assert A.factorize(df).select("gidx").distinct().count() == 5
    near = spark.createDataFrame([(1.0000001,), (2.0,), (1.0,), (3.0000000001,)], "label double")
    assert A.factorize(near).select("gidx").distinct().count() == 3


def test_gae_ignores_masked_turns(spark):
    plain = spark.createDataFrame([(0, [1.0, 2.0, 3.0], [0.1, 0.2, 0.3], [1, 1, 1])], "seq bigint, r array<double>, v array<double>, m array<int>")
    holed = spark.createDataFrame([(0, [1.0, 9.0, 2.0, 3.0], [0.1, 7.0, 0.2, 0.3], [1, 0, 1, 1])], "seq bigint, r array<double>, v array<double>, m array<int>")
    a = plain.select(A.gae_column("r", "v", "m", 0.9, 0.8)).first()[0]
    b = holed.select(A.gae_column("r", "v", "m", 0.9, 0.8)).first()[0]
    assert np.allclose(a, [b[0], b[2], b[3]])


def test_null_and_empty_arrays(spark):
    df = spark.createDataFrame([(0, None, None, None), (1, [], [], [])], "seq bigint, r array<double>, v array<double>, m array<int>")
    assert [list(x[0]) if x[0] is not None else None for x in rows(df.select(A.gae_column("r", "v", "m")))] == [None, []]


def test_resample_follows_weights(spark):
    df = spark.createDataFrame([(i, w) for i, w in enumerate([0.0, 1.0, 3.0])], "idx bigint, weight double")
    drawn = rows(A.weighted_resample(df, 400, 7).groupBy("idx").count(), "idx")
    assert sum(n for _, n in drawn) == 400 and dict(drawn).get(0, 0) == 0 and 240 < dict(drawn)[2] < 360
    assert rows(A.weighted_resample(df, 50, 7), "draw") == rows(A.weighted_resample(df.repartition(5), 50, 7), "draw")


def test_aggregation_skips_masked_values(spark):
    df = spark.createDataFrame([([1.0, float("nan")], [1, 0]), ([float("inf"), 4.0], [0, 0]), ([2.0, 4.0], [1, 1])], "loss array<double>, mask array<int>")
    value = lambda mode: losses.agg_loss(df, "loss", "mask", mode, 2).first()[0]
    assert value("token-mean") == pytest.approx(7 / 3)
    assert value("seq-mean-token-sum") == pytest.approx(3.5)
    assert value("seq-mean-token-mean") == pytest.approx(2.0, rel=1e-6)
    assert value("seq-mean-token-sum-norm") == pytest.approx(3.5)
    with pytest.raises(ValueError):
        value("other")


def test_registry_of_losses(spark):
    assert {"vanilla", "gspo", "sapo", "gpg", "clip_cov", "kl_cov", "geo_mean", "cispo", "reinforce"} <= set(losses.LOSSES)
    with pytest.raises(ValueError):
        losses.policy_loss("none")
    with pytest.raises(NotImplementedError):
        losses.kl_estimate(F.lit(0.0), F.lit(0.0), "full")


def test_veto_replaces_the_mask_only(spark):
    df = spark.createDataFrame([(0, [0.0, -9.0], [0.0, 0.0], [1, 1]), (1, [0.0, -9.0], [0.0, 0.0], [1, 0])], "seq bigint, old_logp array<double>, rollout_logp array<double>, mask array<int>")
    out = rows(C.correct(df, "token", 2.0, veto_below=1e-3).select("seq", "kept_mask", "is_weights"), "seq")
    assert [list(r[1]) for r in out] == [[0, 0], [1, 0]] and out[0][2][0] == 1.0


# ---------------------------------------------------------------- metrics


def test_majority_of_two(spark):
    df = spark.createDataFrame([(0, "s1", "p1", 0.8, "A"), (1, "s1", "p1", 0.9, "B"), (2, "s2", "p2", 0.7, "A")], "idx bigint, data_source string, uid string, score double, pred string")
    out = {(r["data_source"], r["metric"]): r["value"] for r in metrics.validation_metrics(df).collect()}
    assert out["s1", "mean@2"] == pytest.approx(0.85) and out["s1", "std@2"] == pytest.approx(0.05) and ("s2", "std@1") not in out
    assert rows(metrics.majority_value(df, ["uid"]), "uid") == [("p1", 0.8), ("p2", 0.7)]


def test_bootstrap_approaches_the_exact_value(spark):
    df = spark.createDataFrame([(i, "u", float(v), 2) for i, v in enumerate([1, 2, 5, 9])], "idx bigint, uid string, score double, n int")
    est = metrics.bootstrap(df, ["uid"], draws=20000).first()
    exact = metrics.expected_extremes(df, ["uid"], 2).first()
    assert est["best_mean"] == pytest.approx(exact["best"], abs=0.1) and est["worst_mean"] == pytest.approx(exact["worst"], abs=0.1)


def test_bootstrap_of_many_groups(spark):
    # a generator call a draw, group by group, misses the limit below
    groups = spark.range(4000).select("id", F.explode(F.sequence(F.lit(1), 1 + F.col("id") % 23)).alias("idx"))
    df = groups.select(F.when(F.col("id") > 0, F.col("id")).alias("uid"), "idx", (F.xxhash64("id", "idx") % 1000 / 7).alias("score"), F.when(F.col("id") % 2 == 0, 4).otherwise(3).alias("n"))
    df = df.withColumn("score", F.when((F.col("uid") != 25) | (F.col("idx") != 2), F.col("score")))
    # one group of several batches, and draws that come in several blocks
    df = df.unionByName(spark.range(25000).select(F.lit(-1).alias("uid"), F.col("id").alias("idx"), (F.xxhash64("id") % 100000 / 7).alias("score"), F.lit(150).alias("n")))
    began = time.perf_counter()
    got = {r["uid"]: tuple(r)[1:] for r in metrics.bootstrap(df, ["uid"]).collect()}
    assert time.perf_counter() - began < 20 and len(got) == 4001
    for uid in (None, -1, 1, 22, 23, 25, 3999):
        data = df.filter(F.col("uid").eqNullSafe(F.lit(uid).cast("bigint"))).orderBy("idx").toPandas()
        score, rng = data["score"].to_numpy(), np.random.RandomState(42)
        picks = np.stack([rng.choice(len(score), int(data["n"][0]), replace=True) for _ in range(1000)])
        best, worst = score[picks].max(axis=1), score[picks].min(axis=1)
        np.testing.assert_array_equal(got[uid], (best.mean(), best.std(), worst.mean(), worst.std()))
        assert np.isnan(got[uid]).any() == (uid == 25)


def test_batch_metrics_of_two(spark):
    one = [[1, 1], [1, 1]]
    df = spark.createDataFrame([(3.0, 1.5, [0.1, 0.2], [1.1, 1.2], [0.9, 1.0], one[0], 2), (7.0, 3.5, [0.3, 0.4], [1.3, 1.4], [1.1, 1.2], one[1], 2)], "score double, reward double, advantages array<double>, returns array<double>, values array<double>, mask array<int>, prompt_length bigint")
    r = metrics.data_metrics(df, 2, 2).first()
    assert r["score_mean"] == 5.0 and r["aborted_ratio"] == 0.0 and r["response_length_clip_ratio"] == 1.0
    with pytest.raises(FAILS):
        metrics.data_metrics(df.withColumn("mask", F.array().cast("array<int>")).withColumn("advantages", F.array().cast("array<double>")).withColumn("returns", F.array().cast("array<double>")).withColumn("values", F.array().cast("array<double>")), 2, 2).collect()


def test_unsolved_costs_are_null(spark):
    df = spark.createDataFrame([("d", False, 0.0, None, None, None)], "dataset string, accepted boolean, pass_ratio double, error_type string, judge_time double, gen_tokens bigint")
    r = metrics.dataset_metrics(df, overall=False).first()
    assert r["cost_per_solved_tokens"] is None and r["exec_success_rate"] == 0.0


def test_step_overrides(spark):
    df = spark.createDataFrame([("global_seqlen/minmax_diff", "avg", 9.0), ("global_seqlen/max", "max", 8.0), ("global_seqlen/min", "min", 3.0), ("perf/throughput", "avg", 1.0), ("perf/total_num_tokens", "sum", 100.0), ("perf/time_per_step", "time_sum", 5.0), ("timing_s/gen", "time_sum", 2.0), ("timing_s/step", "time_sum", 8.0)], "name string, rule string, value double")
    out = {r["name"]: r["value"] for r in metrics.step_overrides(df, 4).collect()}
    assert out["global_seqlen/minmax_diff"] == 5.0 and out["perf/throughput"] == 5.0 and out["trainer/idle_ratio"] == 0.25 and len(out) == 9


# ---------------------------------------------------------------- batches


def test_meta_of_concatenated_batches():
    assert B.merge_meta([{"t": 1, "metrics": {"a": 1}}, {"t": 1, "metrics": {"a": 2}}]) == {"t": 1, "metrics": {"a": [1, 2]}}
    with pytest.raises(ValueError):
        B.merge_meta([{"t": 1}, {"t": 2}])


def batch(spark, n):
    return spark.createDataFrame([(i, f"r{i}") for i in range(n)], "idx bigint, v string")


def test_zip_finds_conflicts(spark):
    a = spark.createDataFrame([(0, float("nan"), None), (1, 1.0, "x")], "idx bigint, x double, s string")
    b = a.withColumn("y", F.lit(1))
    assert B.zip_union(a, b).count() == 2
    for bad in (b.withColumn("x", F.lit(2.0)), b.withColumn("s", F.lit("NaN")), b.filter("idx = 0")):
        with pytest.raises(FAILS):
            B.zip_union(a, bad).collect()


def test_take_keeps_order_and_repeats(spark):
    assert rows(B.take_list(batch(spark, 4), [2, 2, 0]), "idx") == [(0, "r2"), (1, "r2"), (2, "r0")]


def test_slices(spark):
    b = batch(spark, 10)
    for s in (slice(2, 8, 3), slice(None, None, 2), slice(-3, None), slice(1, -2)):
        got = [r[0] for r in rows(B.slice_rows(b, s.start, s.stop, s.step or 1, 10), "idx")]
        assert got == list(range(10))[s]


def test_chunks_must_divide(spark):
    with pytest.raises(ValueError):
        B.chunk(batch(spark, 5), 2, 5)
    assert [r[1] for r in rows(B.chunk(batch(spark, 5), 2, 5, even=True).groupBy("chunk").count(), "chunk")] == [3, 2]
    assert [r[1] for r in rows(B.chunk(batch(spark, 5), 2, 5, pad=True).groupBy("chunk").count(), "chunk")] == [3, 2]


def test_padding_cycles(spark):
    padded, extra = B.pad_to_divisor(batch(spark, 3), 8, 3)
    assert extra == 5 and [r[1] for r in rows(padded, "idx")] == ["r0", "r1", "r2", "r0", "r1", "r2", "r0", "r1"]
    assert B.same(B.unpad(padded, extra, 8), batch(spark, 3))


def test_empty_batches(spark):
    e = spark.createDataFrame([], "idx bigint, v string")
    assert B.repeat(e, 3).count() == B.repeat_each(e.withColumn("n", F.lit(1)), "n").count() == B.pad_to_divisor(e, 4, 0)[0].count() == 0
    assert B.check_numbering(e).first()[0]


def test_names(spark):
    with pytest.raises(KeyError):
        B.select(batch(spark, 1), ["nope"])
    with pytest.raises(ValueError):
        B.rename(batch(spark, 1).withColumn("w", F.lit(1)), {"v": "w"})


# ---------------------------------------------------------------- balancing


def test_differencing_balances():
    rng = random.Random(1)
    values = [rng.randrange(1, 4000) for _ in range(64)]
    for equal in (True, False):
        groups = S.differencing(values, 8, equal)
        assert sorted(i for g in groups for i in g) == list(range(64))
        sums = [sum(values[i] for i in g) for g in groups]
        assert max(sums) - min(sums) < 0.05 * sum(values) / 8
        assert not equal or {len(g) for g in groups} == {8}
    with pytest.raises(ValueError):
        S.differencing(values[:7], 2, True)


def test_group_balance_keeps_runs(spark):
    lens = [100] * 4 + [200] * 4 + [150] * 4 + [50] * 4
    df = spark.createDataFrame([(0, i, n, str(i // 4)) for i, n in enumerate(lens)], "batch bigint, idx bigint, length bigint, uid string")
    out = S.balanced_groups(df, 2).join(df, ["batch", "idx"])
    assert out.count() == 16 and out.groupBy("uid").agg(F.count_distinct("part").alias("n")).filter("n > 1").count() == 0


def test_micro_batches_hold_the_limit(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(0, i, rng.randrange(1, 900)) for i in range(100)], "batch bigint, idx bigint, length bigint")
    out = S.micro_batches(df, 4000).join(df, ["batch", "idx"])
    assert out.count() == 100 and out.groupBy("micro").agg(F.sum("length").alias("t")).agg(F.max("t")).first()[0] < 4400
    with pytest.raises(FAILS):
        S.micro_batches(df, 100).collect()


def test_balance_order_small_ends(spark):
    df = spark.createDataFrame([(0, i, 0, n) for i, n in enumerate([5, 1, 4, 2, 3])], "batch bigint, idx bigint, part bigint, length bigint")
    assert [r["length"] for r in S.balance_order(df).orderBy("place").collect()] == [1, 3, 5, 4, 2]


def test_ranks_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(i % 3 if i % 7 else None, i) for i in range(500)], "g int, i bigint")
    a = rows(ranking.ranked(df, ["g"], ["i"]), "i")
    assert a == rows(ranking.ranked(df.repartition(7), ["g"], ["i"], cell_bits=3), "i")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "200")
        assert a == rows(ranking.ranked(df, ["g"], ["i"]), "i")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    per = {}
    for g, _, r in a:
        per.setdefault(g, []).append(r)
    assert all(sorted(v) == list(range(len(v))) for v in per.values())
    assert [r[2] for r in rows(ranking.ranked_in_order(df, "i"), "i")] == list(range(500))
    per = {}
    for g, _, r in rows(ranking.ranked_in_order(df.repartition(5), "i", by=["g"], cells=9), "i"):
        per.setdefault(g, []).append(r)
    assert all(v == list(range(len(v))) for v in per.values())
    whole = sorted(ranking.ranked_in_order(df, "i", by=["g"], across=True).collect(), key=lambda r: r["rank"])
    assert [(r["g"] is not None, r["g"], r["i"]) for r in whole] == sorted((r["g"] is not None, r["g"], r["i"]) for r in whole) and [r["rank"] for r in whole] == list(range(500))
    ties = spark.createDataFrame([(1.5, "b"), (1.5, "a"), (None, "c"), (0.5, "d")], "k double, t string")
    assert [r["t"] for r in sorted(ranking.ranked_in_order(ties, "k", ties=["t"]).collect(), key=lambda r: r["rank"])] == ["c", "d", "a", "b"]
    assert ranking.ranked_in_order(df.filter("i < 0"), "i").count() == 0


def test_joins_of_hot_keys(spark):
    many = spark.createDataFrame([(None if i % 10 == 0 else 1 if i % 3 else i, i) for i in range(600)], "k bigint, i bigint")
    one = spark.createDataFrame([(k, f"v{k}") for k in (1, 3, 6, 9, 900)], "k bigint, v string")
    for how in ("inner", "left"):
        want = rows(many.join(one, "k", how), "i")
        assert rows(skew.join_unique(many, one, "k", how, least=50), "i") == want == rows(skew.join_unique(many, one, "k", how), "i")
    assert skew.hot_keys(many, "k", least=50) == [1] and skew.hot_keys(many, "k", least=1, most=1) == [1]


def test_queues_take_the_oldest_first(spark):
    puts = spark.createDataFrame([("q", i * 3 % 101) for i in range(101)] + [("r", 5)], "queue string, seq bigint")
    got = {r["seq"]: r["batch"] for r in Q.full_batches(puts, 8).collect()}
    assert got == {i: i // 8 for i in range(96)}
    work = spark.createDataFrame([(i, i in (7, 3) if i != 4 else None) for i in range(10)], "seq bigint, cancelled boolean")
    assert [r["seq"] for r in sorted(Q.resume_order(work).collect(), key=lambda r: r["place"])] == [3, 7, 0, 1, 2, 4, 5, 6, 8, 9]


def test_folds_hold_no_whole_queue(spark):
    rng = random.Random(4)
    events = [("abc"[rng.randrange(3)], i, rng.choice(["put", "put", "get"]), i) for i in range(700)]
    df = spark.createDataFrame(events, "queue string, seq bigint, kind string, item bigint")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
        got = {(r["queue"], r["seq"]): r for r in Q.replay(df.repartition(5), 4).collect()}
        free = Q.replay(df, None).filter("dropped > 0").count()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == 700 and free == 0
    for name in "abc":
        queue = Q.BoundedQueue(4)
        for q, seq, kind, item in events:
            if q == name:
                want = (queue.put(item), item)[1] if kind == "put" else queue.get()
                r = got[name, seq]
                assert (r["item"], r["size"], r["dropped"], r["produced"], r["consumed"]) == (want, len(queue.items), queue.dropped, queue.produced, queue.consumed)
    assert Q.replay(df.filter("seq < 0"), 4).count() == 0


# ---------------------------------------------------------------- nested records

PAYLOADS = [
    None,
    "",
    "no json",
    "[1, 2]",
    json.dumps({"id": "x"}),
    json.dumps({"test": [None, {"input": {"stdin": "1", "files": [None, {"name": "a"}]}, "output": None}], "solutions": {"language": [1, 2], "solution": ["a", None, "c"]}}),
    json.dumps({"test_cases": {"tests": json.dumps([{"input": "1"}, {"input": "2"}]), "test_list": ["assert f()", None]}, "solutions": json.dumps(["s"])}),
    json.dumps({"test": {}, "test_cases": [], "solutions": 5}),
    json.dumps({"test": ["long " * 100_000]}),
]


def test_flatten_payloads(spark):
    df = spark.createDataFrame([(i, p, "clash") for i, p in enumerate(PAYLOADS)], "raw_id bigint, payload string, pos string")
    out = rows(flatten.children(flatten.flatten_json(df, "raw_id", "payload", "raw")), "rec_id", "child_kind", "parent_pos", "pos")
    assert [r[1:] for r in out] == [
        (5, "file", 1, 1), (5, "solution", -1, 0), (5, "solution", -1, 2), (5, "test", -1, 1),
        (6, "assert", -1, 0), (6, "solution", -1, 0), (6, "test", -1, 0), (6, "test", -1, 1), (8, "test", -1, 0),
    ]
    assert flatten.flatten_json(df.filter("raw_id < 0"), "raw_id", "payload", "raw").count() == 0


def test_flat_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame(list(enumerate(PAYLOADS)), "raw_id bigint, payload string")
    tagged = flatten.flatten_json(df, "raw_id", "payload", "raw")
    flatten.write_tables(tagged, str(tmp_path / "t"))
    files, tests = (flatten.read_table(spark, str(tmp_path / "t"), t) for t in ("file", "test"))
    assert rows(files.select("name", "parent_pos")) == [("a", 1)]
    assert files.join(tests, files["parent_pk"] == tests["pk"]).count() == 1
    assert rows(flatten.read_table(spark, str(tmp_path / "t"), "solution").filter("rec_id = 5").select("text", "language"), "text") == [("a", "1"), ("c", None)]
    assert flatten.read_table(spark, str(tmp_path / "t"), "record").count() == len(PAYLOADS)


def test_records_without_ids_keep_their_children(spark):
    df = spark.createDataFrame([(None, json.dumps({"id": name, "test": [{"input": name}]})) for name in "ab"], "raw_id bigint, payload string")
    tagged = flatten.stored(flatten.flatten_json(df, "raw_id", "payload", "raw"))
    records, tests = flatten.as_table(tagged, "record"), flatten.as_table(tagged, "test")
    joined = tests.select("parent_pk", "input").join(records.select(F.col("pk").alias("parent_pk"), "problem_id"), "parent_pk")
    assert rows(joined.select("input", "problem_id"), "input") == [("a", "a"), ("b", "b")]


def test_any_tree_of_tables(spark):
    tree = flatten.Table("order", fields={"who": ("who.name", "who")}, below=(flatten.Table("line", (("lines",), ("more.lines",)), {"what": ("what",)}, (flatten.Table("note", (("notes",),), {"text": ("",)}),)),))
    texts = ['{"who": {"name": "x"}, "lines": [{"what": "w", "notes": ["a", null, "b"]}, null, {"what": [1]}], "more": {"lines": "[{\\"what\\": 2}]"}}', '{"who": "y"}']
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, t string")
    tagged = flatten.flatten_json(df, "id", "t", "o", tree).cache()
    assert rows(flatten.as_table(tagged, "order", tree).select("rec_id", "who"), "rec_id") == [(0, "x"), (1, "y")]
    assert rows(flatten.as_table(tagged, "note", tree).select("parent_pk", "parent_pos", "pos", "text"), "pos") == [("o:0/lines[0]", 0, 0, "a"), ("o:0/lines[0]", 0, 2, "b")]
    typed = spark.createDataFrame([(0, ("x",), [("w", ["a", None, "b"]), None])], "id bigint, who struct<name: string>, lines array<struct<what: string, notes: array<string>>>")
    made = flatten.flatten_typed(typed, "id", "o", tree)
    assert rows(flatten.as_table(made, "note", tree).select("parent_pk", "parent_pos", "pos", "text"), "pos") == [("o:0/lines[0]", 0, 0, "a"), ("o:0/lines[0]", 0, 2, "b")]
    assert rows(flatten.as_table(made, "line", tree).select("pk", "parent_pos", "what"), "pk") == [("o:0/lines[0]", -1, "w")]


def test_flatten_samples_edges(spark):
    schema = "sample_id bigint, dataset string, problem_id string, fetched_at timestamp, solutions array<string>, payload string, test_cases struct<tests: array<struct<input: string, output: string>>, test_list: array<string>, challenge_test_list: array<string>>"
    df = spark.createDataFrame([(1, None, None, None, None, "x", None), (2, "d", "p", None, [None, "s", ""], "x", ([("i", None), None], [], None))], schema)
    assert rows(flatten.children(flatten.flatten_typed(df, "sample_id", "dataset_samples")), "child_kind", "pos") == [("dataset_samples", 2, "solution", -1, 1), ("dataset_samples", 2, "solution", -1, 2), ("dataset_samples", 2, "test", -1, 0)]


# ---------------------------------------------------------------- text, graders, layouts


def test_canonical_prompt(spark):
    df = spark.createDataFrame([("a \r\n\r\n\r\n\r\nb \rc\n\n ",), (None,), ("  ",)], "p string")
    assert [r[0] for r in df.select(T.canonical_prompt("p")).collect()] == ["a\n\nb\nc", "", ""]


def held(spark, pairs, column):
    df = spark.createDataFrame(list(pairs), "a string, b string")
    return [r[0] for r in df.select(column).collect()]


def test_textbook_answers(spark):
    pairs = [("\\dfrac12", "\\frac{1}{2}"), ("0.5", "\\frac{1}{2}"), ("1/2", "\\frac{1}{2}"), ("x=3", "3"), ("\\sqrt3", "\\sqrt{3}"), ("50\\%", "50"), (".5", "0.5"), ("3\\text{ cm}", "3"), ("90^\\circ", "90"), ("\\frac1{72}", "\\frac{1}{72}"), (None, None), ("\\frac1", "\\frac1"), ("", "")]
    assert held(spark, pairs, G.textbook_equal("a", "b")) == [True] * len(pairs)
    assert held(spark, [("1/3", "1/2"), ("a", None), ("3\\text{ cm}\\text{ mm}", "3"), ("a=b=c", "c")], G.textbook_equal("a", "b")) == [False] * 4


def test_values(spark):
    same = [("1,000", "1000"), ("50%", "0.5"), ("(1, 2]", "(1,2]"), ("\\frac{1}{3}", "0.33333"), ("1e3", "1000"), ("(1/2, 3)", "(0.5, 3.0)"), ("\\begin{pmatrix}1 & 2\\\\3 & 4\\end{pmatrix}", "\\begin{pmatrix}1.0&2\\\\3&4\\end{pmatrix}")]
    assert held(spark, same, G.values_equal("a", "b")) == [True] * len(same)
    other = [("1", "2"), ("(1,2)", "[1,2]"), ("x", "y"), ("__import__('os')", "1"), (None, "1"), ("1/0", "1"), (None, None), ("", "1")]
    assert held(spark, other, G.values_equal("a", "b")) == [False] * len(other)


def test_marked_answers(spark):
    texts = ["We add. The answer is: 42. Done", "so 7 apples\nx 12 is the answer", "it is \\boxed{3} or so", "First. Hence x equals 5.", "nothing here", None, "", "Final answer: about 9\nmore"]
    got = held(spark, [(t, None) for t in texts], F.struct(G.matched_answer("a")["matched"], G.matched_answer("a")["pred"]))
    assert [tuple(r) for r in got] == [(True, "42"), (True, "12"), (True, "3"), (True, "5"), (False, "nothing here"), (False, None), (False, ""), (True, "about 9")]


def test_boxed(spark):
    texts = ["a \\boxed{\\frac{1}{2}} b", "\\boxed{1", "\\boxed 7$ x", None, "\\boxed{1} \\boxed{2}", "\\boxed{}", "none", "\\boxed{a{b}c{{d}}}}"]
    assert held(spark, [(t, None) for t in texts], G.last_boxed("a")) == ["\\frac{1}{2}", None, "7", None, "2", "", None, "a{b}c{{d}}"]
    assert held(spark, [(t, None) for t in texts[:3]], G.last_boxed("a", loose=False)) == ["\\frac{1}{2}", None, None]


def test_final_answers(spark):
    texts = {"1,000 dollars": "1000", "$\\frac12$": "\\frac{1}{2}", "\\sqrt3 units": "\\sqrt{3}", "x = \\text{5}": "5", "\\boxed{7}": "7", "12": "12", "a": "a"}
    assert held(spark, [(t, None) for t in texts], G.final_answer("a")) == list(texts.values())


def test_unknown_source_is_an_error(spark):
    with pytest.raises(FAILS):
        spark.createDataFrame([("other", "1", "1")], "s string, a string, t string").select(G.default_score("s", "a", "t")).collect()


def test_compile_error_spreads(spark):
    df = spark.createDataFrame([([1, -4, 1],), ([1, 1],), ([],)], "c array<int>")
    assert [list(r[0]) for r in df.select(G.case_codes("c")).collect()] == [[1, -4, -4], [1, 1], []]


def test_decontamination_by_name(spark):
    df = spark.createDataFrame([("1018_A. Loom", 2), ("1018_B. Oar", 2), ("1018_A. Loom", 1), (None, 2)], "name string, source int")
    test = spark.createDataFrame([("1018_a. loom again",)], "n string")
    assert rows(governance.drop_named(df, "name", test, "n", F.col("source") == 2), "source", "name") == [("1018_A. Loom", 1), (None, 2), ("1018_B. Oar", 2)]


def test_removal_by_priority(spark):
    df = spark.createDataFrame([("test", "h", 0), ("train", "h", 1), ("x", "g", 2), ("y", "g", 3), ("train", "k", 4)], "key string, sha256 string, idx bigint")
    over = governance.cross_overlaps(df)
    leaks = spark.createDataFrame([("train", "e", "k")], "key string, external_key string, sha256 string")
    assert [r[2] for r in rows(governance.remove_overlaps(df, over, leaks, ["test", "train"]), "idx")] == [0, 2, 3]


def test_sft_row(spark):
    df = spark.createDataFrame([([1, 2, 3], [4, 5])], "p array<bigint>, r array<bigint>")
    got = df.select(*[c.alias(k) for k, c in sequences.sft_row("p", "r", 7, 0).items()]).first()
    assert list(got["input_ids"]) == [1, 2, 3, 4, 5, 0, 0] and list(got["loss_mask"]) == [0, 0, 1, 1, 0, 0, 0] and list(got["position_ids"]) == [0, 1, 2, 3, 4, 4, 4]
    with pytest.raises(FAILS):
        df.select(*[c.alias(k) for k, c in sequences.sft_row("p", "r", 4, 0).items()]).collect()
    with pytest.raises(ValueError):
        sequences.sft_row("p", "r", 4, 0, "middle")


def test_array_helpers(spark):
    df = spark.createDataFrame([([0, 7, 0, 9, 0], 9)], "a array<bigint>, e bigint")
    r = df.select(sequences.without_pad("a", 0), sequences.eos_mask("a", F.lit(9).cast("bigint")), sequences.truncate("a", 3, "middle"), sequences.preference_pair(F.col("a"), F.array(F.lit(1).cast("bigint")), 2, 5), sequences.response_mask("a", 2), sequences.cut_request("a", F.lit(2), 4, 1)).first()
    assert [list(x) for x in r][:3] == [[7, 0, 9], [1, 1, 1, 1, 0], [0, 9, 0]]
    assert [list(x) for x in r[3]] == [[0, 7], [1, 5]] and list(r[4]) == [9, 0] and list(r[5]) == [0, 7, 0]


def test_dense_search_edges(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0], "x"), (2, [0.0, 1.0], "x"), (3, None, "x"), (4, [1.0], "x"), (5, [1.0, 0.0], "x")], "vec_id bigint, embedding array<double>, score string")
    q = spark.createDataFrame([(9, [2.0, 0.0]), (8, None), (7, [0.0, 0.0])], "query_id bigint, embedding array<double>")
    out = [(r["query_id"], r["vec_id"], r["rank"]) for r in retrieval.dense_search(q.filter("query_id = 9"), v, 2).orderBy("rank").collect()]
    assert out == [(9, 1, 1), (9, 5, 2)]
    assert retrieval.dense_search(q.filter("query_id < 0"), v, 2).count() == 0


def test_recipes(spark):
    df = spark.createDataFrame([(0, "Q", "work #### 1,234")], "idx bigint, question string, answer string")
    for name in ("gsm8k", "gsm8k_tool", "gsm8k_interaction", "math", "geometry", "aime", "search"):
        r = recipes.recipe(name, df, "test").first()
        assert r["extra_info"]["index"] == 0 and r["prompt"][-1]["content"].find("Q") >= 0
    assert recipes.recipe("gsm8k", df, "test").first()["reward_model"]["ground_truth"] == "1234"
    h = df.withColumns({"endings": F.array(F.lit("a [x]"), F.lit("b")), "label": F.lit("")})
    assert recipes.recipe("hellaswag", h, "t").count() == 0 and recipes.recipe("hellaswag", h.withColumn("label", F.lit("1")), "t").count() == 1
    pair = spark.createDataFrame([("H: x\n\nAssistant: yes", "H: x\n\nAssistant: no")], "chosen string, rejected string")
    assert tuple(recipes.preference_rows(pair).first()) == ("H: x\n\nAssistant:", " yes", " no")


# ---------------------------------------------------------------- sources


def test_json_lines(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"problem_id": "a", "n": 1}\n\n{"problem_id": "é"}\n', encoding="utf-8")
    assert io.read_json_lines(spark, str(p)).count() == 2 and io.read_manifest(spark, str(p)).count() == 2
    p.write_text('{"problem_id": "a"}\nbroken\n{"problem_id": "a"}\n')
    with pytest.raises(FAILS):
        io.read_json_lines(spark, str(p), "problem_id string").collect()
    with pytest.raises(FAILS):
        governance.unique_ids(io.read_json_lines(spark, str(p), "problem_id string", strict=False).select("problem_id")).collect()
    assert [(r["line"], r["ok"]) for r in io.numbered_lines(spark, str(p), "problem_id string").orderBy("line").collect()] == [(1, True), (2, False), (3, True)]


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("in", "out", "g", 0.5)], "input string, output string, gts string, score double")
    io.dump_generations(df, str(tmp_path / "g"), 3)
    assert rows(io.view_generations(spark, str(tmp_path / "g"), "out", ["input", "score"])) == [(3, "in", 0.5)]
    assert io.view_generations(spark, str(tmp_path / "g"), "nothing").count() == 0
    io.write_splits(df.withColumn("split", F.lit("test")), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 1
    made = []
    for _ in range(2):
        io.cached_rollout(spark, str(tmp_path / "c"), lambda: made.append(1) or df)
    assert len(made) == 1
    (tmp_path / "f").write_text("x")
    assert io.copy_to_shared(spark, str(tmp_path / "f"), str(tmp_path / "d")) == io.copy_to_shared(spark, str(tmp_path / "f"), str(tmp_path / "d"))
    sink = io.metric_sink("file", str(tmp_path / "m"), spark)
    sink({"a": 1}, 2)
    sink({"a": 2}, 3)
    sink({"a": 3}, 3)
    assert rows(io.read_json_lines(spark, str(tmp_path / "m"), "step bigint, data struct<a: bigint>").select("step", "data.a"), "step") == [(2, 1), (3, 3)]
    assert io.load_loader(spark, str(tmp_path / "none")) == {"epoch": 0, "position": 0, "seed": 0}
    io.save_loader(spark, str(tmp_path / "l"), 4, {"epoch": 2, "position": 9, "seed": 1})
    assert io.load_loader(spark, str(tmp_path / "l"))["position"] == 9
    (tmp_path / "latest_checkpointed_iteration.txt").write_text("7")
    (tmp_path / "global_step_7").mkdir()
    assert io.latest_checkpoint(spark, str(tmp_path)).endswith("global_step_7")
    with pytest.raises(ValueError):
        io.read_files(spark, ["x.csv"])


def test_training_sources(spark, tmp_path):
    pairs = spark.createDataFrame([("p", "c", "r", 1)], "prompt string, chosen string, rejected string, other int")
    pairs.write.parquet(str(tmp_path / "p.parquet"))
    assert rows(io.read_preferences(spark, [str(tmp_path / "p.parquet")])) == [("p", "c", "r")]
    turns = spark.createDataFrame([([("user", "a"), ("assistant", "b")], True), ([("system", "s"), ("user", "a")], None)], "messages array<struct<role: string, content: string>>, enable_thinking boolean")
    turns.write.parquet(str(tmp_path / "t.parquet"))
    out = io.read_conversations(spark, [str(tmp_path / "t.parquet")], tools="tools", thinking="enable_thinking")
    assert out.columns == ["messages", "tools", "enable_thinking"] and out.filter("tools IS NULL").count() == 2
    assert io.with_generated(pairs, lambda b: b.select("prompt"), pairs).count() == 2
    io.save_batch(pairs, str(tmp_path / "b"))
    assert B.same(io.load_batch(spark, str(tmp_path / "b")), pairs)
    assert recipes.multiturn_rows(spark.createDataFrame([("q", "a")], "question string, answer string"), "s").first()["messages"][0]["role"] == "system"
    got = recipes.collect_responses(spark.createDataFrame([(0, 1, "b"), (0, 0, "a")], "idx bigint, sample int, response string"))
    assert rows(got) == [(0, ["a", "b"])]


# ---------------------------------------------------------------- rewards


def test_reward_managers(spark):
    def length_or_fail(source, response, truth):
        return len(response)

    df = spark.createDataFrame([("openai/gsm8k", "#### 4", "4", 3, 0.0), ("openai/gsm8k", None, "4", 9, 0.0)], "data_source string, response string, ground_truth string, length int, at double")
    assert [r["reward"] for r in rewards.manager("naive")(df).collect()] == [1.0, 0.0]
    failing = rewards.naive(df, length_or_fail).collect()
    assert [(r["reward"], r["error"]) for r in failing] == [(6.0, None), (0.0, "error")]
    assert [r["reward"] for r in rewards.dapo(df, F.lit(1.0), max_length=10, buffer=4, factor=0.5).collect()] == [1.0, 0.625]
    assert [list(r["token_rewards"]) for r in rewards.naive(df, F.lit(1.0), width=4).collect()] == [[0.0, 0.0, 1.0, 0.0], [0.0] * 4]
    assert [r["error"] for r in rewards.prime(df, lambda s, r, t: __import__("time").sleep(0.05) or 1.0, seconds=0.01).collect()] == ["timeout"] * 2
    assert [r["reward"] for r in rewards.batch(df, lambda p: p["response"].isna().astype(float)).collect()] == [0.0, 1.0]
    assert rewards.rate_limited(df, F.lit(1.0), per_minute=60, burst=1).filter("start = 1.0").count() == 2
    with pytest.raises(ValueError):
        rewards.manager("none")


def test_run_records_before_log(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        io.load_run(spark, str(tmp_path))
    (tmp_path / "qa_log_a.jsonl").write_text('{"problem_id": "a"}\n')
    assert io.load_run(spark, str(tmp_path)).first()["sampled"]
    (tmp_path / "per_problem_a.jsonl").write_text('{"problem_id": "a"}\n{"problem_id": "b"}\n')
    assert io.load_run(spark, str(tmp_path)).count() == 2
    (tmp_path / "x_manifest.jsonl").write_text("{}")
    assert io.datasets_in(spark, str(tmp_path)) == ["x"]


# ---------------------------------------------------------------- streaming


def test_queue_drops_the_oldest():
    q = Q.BoundedQueue(2)
    assert q.put(1) and q.put(2) and not q.put(3) and q.take(3) is None and q.take(2) == [2, 3] and q.get() is None
    assert (q.produced, q.consumed, q.dropped) == (3, 2, 1) and Q.staleness_limit(16, 0.5, 2) == 48


def test_stream_equals_replay(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet").select(F.col("event_type").alias("queue"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 == 2, "get").otherwise("put").alias("kind"), F.col("event_id").alias("item"))
    for i in range(3):
        events.filter(F.col("seq").between(i * 300, i * 300 + 299)).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    job = Q.streaming(stream, 8).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    job.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert B.same(got, Q.replay(events.filter("seq < 900"), 8))


def test_token_bucket(spark):
    df = spark.createDataFrame([("a", 0.0, 5.0), ("a", 0.0, 10.0), ("a", 9.0, 1.0)], "bucket string, at double, cost double")
    assert [r["start"] for r in Q.token_bucket(df, 1.0, 10.0).orderBy("at", "cost").collect()] == [0.0, 5.0, 9.0]


def test_event_windows_with_watermark(spark, small, tmp_path):
    src = f"{small}/events.parquet"
    spark.read.parquet(src).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(str(tmp_path / "in"))
    job = Q.event_windows(stream, "6 hours", "1 hour").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    job.awaitTermination()
    assert spark.table("windows").agg(F.sum("n")).first()[0] == spark.read.parquet(src).count()


def test_positions_of_odd_masks(spark):
    masks = [[0, 1, 1], None, [], [1], [0, 0]]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(masks * 40)], "i bigint, m array<bigint>").repartition(3)
    got = {r["i"]: r["p"] for r in df.select("i", sequences.position_ids("m").alias("p")).collect()}
    want = [[0, 0, 1], None, [], [0], [0, 0]] * 40
    assert [got[i] for i in range(len(want))] == want


def test_lines_of_a_file_in_many_blocks(spark, tmp_path):
    text = "\n".join("" if i % 7 == 3 else json.dumps({"i": i}) if i % 5 else "{broken" for i in range(3000)) + "\n"
    (tmp_path / "a.jsonl").write_text(text)
    (tmp_path / "b.jsonl").write_text('{"i": 0}\n\n{"i": 2}')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
        got = [(r["file"][-7:], r["line"], r["record"]["i"] if r["ok"] else None) for r in io.numbered_lines(spark, str(tmp_path), "i int").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = [("a.jsonl", i + 1, i if i % 5 else None) for i in range(3000) if i % 7 != 3] + [("b.jsonl", 1, 0), ("b.jsonl", 3, 2)]
    assert sorted(got, key=str) == sorted(want, key=str)
