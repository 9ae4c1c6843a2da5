"""Queries of evaluation and training rollups."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions.runtime import table
from corpusmill.functions.text import expected_got, guess_exception, mismatch_class, wrapper_type
from corpusmill.operators import metrics as M
from corpusmill.plans.registry import REGISTRY as R
from corpusmill.plans.views import ROLLOUTS, TOKENS, long_tokens, r6, rollouts, rounded, tokens

_METRIC_ROWS = """long AS (SELECT CAST(floor(event_id / 1000) AS BIGINT) AS step, event_id AS at, (['critic/score/max', 'critic/score/min', 'critic/score/mean', 'timing_s/gen_max', 'perf/total_num_tokens', 'training/global_step', 'kl_weighted_avg', 'actor/entropy'])[1 + event_id % 8] AS name, value, 1 + event_id % 3 AS weight FROM events)"""


def _metric_rows(spark, sf):
    names = F.array(*map(F.lit, ["critic/score/max", "critic/score/min", "critic/score/mean", "timing_s/gen_max", "perf/total_num_tokens", "training/global_step", "kl_weighted_avg", "actor/entropy"]))
    return table(spark, sf, "events").select(F.floor(F.col("event_id") / 1000).cast("bigint").alias("step"), F.col("event_id").alias("at"), F.get(names, (F.col("event_id") % 8).cast("int")).alias("name"), "value", (1 + F.col("event_id") % 3).alias("weight"))


@R.add("a1_reduce_metrics", f"WITH {_METRIC_ROWS} SELECT name, round(CASE WHEN contains(name, 'max') THEN max(value) WHEN contains(name, 'min') THEN min(value) ELSE avg(value) END, 6) + 0.0 AS value FROM long GROUP BY name")
def a1_reduce_metrics(spark, sf):
    return rounded(M.reduce_metrics(_metric_rows(spark, sf)))


@R.add(
    "a18_step_metrics",
    f"""WITH {_METRIC_ROWS}, r AS (SELECT *, CASE WHEN name = 'training/global_step' THEN 'last' WHEN starts_with(name, 'timing_s/') THEN 'time_sum' WHEN regexp_matches(name, 'mean|avg|average') THEN 'avg'
  WHEN contains(name, 'max') THEN 'max' WHEN contains(name, 'min') THEN 'min' WHEN regexp_matches(name, 'sum|total') THEN 'sum' ELSE 'avg' END AS rule FROM long)
SELECT name, rule, round(CASE WHEN rule IN ('sum', 'time_sum') THEN sum(value) WHEN rule = 'max' THEN max(value) WHEN rule = 'min' THEN min(value)
  WHEN rule = 'last' THEN (SELECT l.value FROM long l WHERE l.name = r.name ORDER BY l.at DESC LIMIT 1) ELSE avg(value) END, 6) + 0.0 AS value FROM r GROUP BY name, rule""",
)
def a18_step_metrics(spark, sf):
    return rounded(M.step_metrics(_metric_rows(spark, sf), step="at", rules={"training/global_step": "last"}))


@R.add(
    "a4_data_metrics",
    f"""WITH {TOKENS}, s AS (SELECT seq, sum(mask) AS len, sum(x) AS score, sum(y) AS reward, 10 + seq % 7 AS prompt_length FROM tokens GROUP BY seq), k AS (SELECT * FROM tokens WHERE mask = 1),
p AS (SELECT {', '.join(f'{f}({e}) {w} AS {n}_{a}' for n, e, w in (('score', 'score', 'FILTER (len > 0)'), ('reward', 'reward', 'FILTER (len > 0)'), ('response_length', 'len', ''), ('response_length_non_aborted', 'len', 'FILTER (len > 0)'), ('prompt_length', 'prompt_length', '')) for f, a in (('avg', 'mean'), ('max', 'max'), ('min', 'min')))},
  avg(CASE WHEN len = 58 THEN 1.0 ELSE 0.0 END) AS response_length_clip_ratio, avg(CASE WHEN len = 58 THEN 1.0 ELSE 0.0 END) FILTER (len > 0) AS response_length_non_aborted_clip_ratio,
  avg(CASE WHEN len = 0 THEN 1.0 ELSE 0.0 END) AS aborted_ratio, avg(CASE WHEN prompt_length = 16 THEN 1.0 ELSE 0.0 END) AS prompt_length_clip_ratio, count(*) FILTER (len > 0) AS responses FROM s),
q AS (SELECT {', '.join(f'{f}({e}) AS {n}_{a}' for n, e in (('advantages', 'advantages'), ('returns', 'z'), ('values', 'y')) for f, a in (('avg', 'mean'), ('max', 'max'), ('min', 'min')))}, 1 - var_samp(z - y) / (var_samp(z) + 1e-5) AS vf_explained_var FROM k)
SELECT responses, {', '.join(f'round(CAST({c} AS DOUBLE), 6) + 0.0 AS {c}' for c in [f'{n}_{a}' for n in ('score', 'reward', 'response_length', 'response_length_non_aborted', 'prompt_length', 'advantages', 'returns', 'values') for a in ('mean', 'max', 'min')] + ['response_length_clip_ratio', 'response_length_non_aborted_clip_ratio', 'aborted_ratio', 'prompt_length_clip_ratio', 'vf_explained_var'])} FROM p, q""",
)
def a4_data_metrics(spark, sf):
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    rows = tokens(spark, sf).select(total("x").alias("score"), total("y").alias("reward"), "advantages", F.col("z").alias("returns"), F.col("y").alias("values"), "mask", (10 + F.col("seq") % 7).alias("prompt_length"))
    return rounded(M.data_metrics(rows, 58, 16))


@R.add("a5_timing", "WITH t AS (SELECT (['gen', 'ref', 'values', 'adv', 'reward'])[1 + event_id % 5] AS name, value / 100 AS seconds FROM events) SELECT name, round(sum(seconds), 6) + 0.0 AS seconds, round(sum(seconds) * 1000 / CASE name WHEN 'gen' THEN 5000 WHEN 'reward' THEN NULL ELSE 8000 END, 6) + 0.0 AS per_token_ms FROM t GROUP BY name")
def a5_timing(spark, sf):
    names = F.array(*map(F.lit, ["gen", "ref", "values", "adv", "reward"]))
    rows = table(spark, sf, "events").select(F.get(names, (F.col("event_id") % 5).cast("int")).alias("name"), (F.col("value") / 100).alias("seconds"))
    return rounded(M.timing_metrics(rows, 3000, 5000))


@R.add("a5_throughput", "SELECT CAST(sum(gen_tokens) AS BIGINT) AS total_num_tokens, CAST(12.5 AS DOUBLE) AS time_per_step, round(sum(gen_tokens) / (12.5 * 8), 6) + 0.0 AS throughput FROM per_problem")
def a5_throughput(spark, sf):
    return rounded(M.throughput(table(spark, sf, "per_problem"), 12.5, 8, "gen_tokens"))


@R.add(
    "a6_variance_proxies",
    f"""WITH {TOKENS}, s AS (SELECT seq, coalesce(sum(advantages) FILTER (mask = 1), 0) / (sum(mask) + 1e-8) AS a, coalesce(sum(1 - 2 * exp(old_logp) + 0.5) FILTER (mask = 1), 0) AS w FROM tokens GROUP BY seq),
p AS (SELECT avg(a * a * greatest(w, 0)) AS p2, avg(a * a) AS a2, avg(w) AS w, count(*) AS n FROM s)
SELECT round(CAST(0.04 AS DOUBLE), 6) + 0.0 AS proxy1_signal_strength, round(p2, 6) + 0.0 AS proxy2_total_power, round(greatest((p2 - 0.04) / (n - 1), 0), 6) + 0.0 AS proxy3_pure_noise, round(a2, 6) + 0.0 AS expected_a_squared, round(w, 6) + 0.0 AS expected_w FROM p""",
)
def a6_variance_proxies(spark, sf):
    from corpusmill.operators.losses import token_sums

    rows = token_sums(tokens(spark, sf), ["advantages", "old_logp"], "mask", lambda p: {"a": p["advantages"], "w": 1 - 2 * F.exp(p["old_logp"]) + 0.5})
    return rounded(M.variance_proxies(rows.select((F.col("a") / (F.col("n") + 1e-8)).alias("advantage"), "w"), 0.2))


@R.add("a7_bootstrap")
def a7_bootstrap(spark, sf):
    """Seeded bootstrap of the best and worst of four, per user and event type."""
    rows = table(spark, sf, "events").select("user_id", "event_type", F.col("event_id").alias("idx"), F.col("value").alias("score"), F.lit(4).alias("n"))
    return M.bootstrap(rows, ["user_id", "event_type"], draws=1000)


_EXTREMES = "WITH r AS (SELECT user_id, event_type, value AS score, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value, event_id) AS i, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events)"


@R.add("a7_expected_extremes", _EXTREMES + " SELECT user_id, event_type, round(sum(score * (pow(i / n, 4.0) - pow((i - 1) / n, 4.0))), 6) + 0.0 AS best, round(sum(score * (pow((n - i + 1) / n, 4.0) - pow((n - i) / n, 4.0))), 6) + 0.0 AS worst FROM r GROUP BY user_id, event_type")
def a7_expected_extremes(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_type", F.col("event_id").alias("idx"), F.col("value").alias("score"))
    return rounded(M.expected_extremes(rows, ["user_id", "event_type"], 4))


@R.add(
    "a8_majority",
    f"""WITH {ROLLOUTS}, v AS (SELECT data_source, uid, pred, count(*) AS votes, min(idx) AS first FROM rollouts GROUP BY data_source, uid, pred),
b AS (SELECT *, row_number() OVER (PARTITION BY data_source, uid ORDER BY votes DESC, first) AS r FROM v)
SELECT b.data_source, b.uid, round(o.score, 6) + 0.0 AS maj FROM b JOIN rollouts o ON o.idx = b.first WHERE r = 1""",
)
def a8_majority(spark, sf):
    return rounded(M.majority_value(rollouts(spark, sf), ["data_source", "uid"]))


@R.add(
    "a9_validation",
    """WITH r AS (SELECT event_type AS data_source, user_id AS uid, value AS score, row_number() OVER (PARTITION BY event_type, user_id ORDER BY value, event_id) AS i, count(*) OVER (PARTITION BY event_type, user_id) AS n FROM events),
plain AS (SELECT data_source, uid, n, avg(score) AS mean, stddev_pop(score) AS std FROM r GROUP BY data_source, uid, n),
ks AS (SELECT data_source, uid, n, unnest(CASE WHEN n > 1 THEN list_append(list_filter([2, 4, 8, 16, 32, 64, 128, 256, 512, 1024], lambda p: p < n), n) ELSE [] END) AS k FROM plain),
d AS (SELECT r.data_source, r.uid, k, sum(score * (pow(i / r.n, k) - pow((i - 1) / r.n, k))) AS best, sum(score * (pow((r.n - i + 1) / r.n, k) - pow((r.n - i) / r.n, k))) AS worst FROM r JOIN ks ON ks.data_source = r.data_source AND ks.uid = r.uid GROUP BY r.data_source, r.uid, k),
m AS (SELECT data_source, 'mean@' || n AS metric, mean AS value FROM plain UNION ALL SELECT data_source, 'std@' || n, std FROM plain WHERE n > 1
  UNION ALL SELECT data_source, 'best@' || k || '/mean', best FROM d UNION ALL SELECT data_source, 'worst@' || k || '/mean', worst FROM d)
SELECT data_source, metric, round(avg(value), 6) + 0.0 AS value FROM m GROUP BY data_source, metric""",
)
def a9_validation(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_type").alias("data_source"), F.col("user_id").alias("uid"), F.col("event_id").alias("idx"), F.col("value").alias("score"))
    return rounded(M.validation_metrics(rows))


@R.add(
    "a10_route_metrics",
    """WITH m AS (SELECT DISTINCT event_type AS data_source, CASE WHEN event_type = 'click' AND event_id % 3 = 0 THEN 'reward' ELSE (['acc', 'reward', 'length'])[1 + (event_id % 3)] END AS var, (['mean@4', 'mean@2', 'best@4/mean', 'maj@4/mean', 'worst@4/mean', 'std@4'])[1 + event_id % 6] AS metric FROM events),
k AS (SELECT *, CAST(nullif(regexp_extract(metric, '@([0-9]+)', 1), '') AS INT) AS n, CASE WHEN max(CASE WHEN var = 'acc' THEN 1 ELSE 0 END) OVER (PARTITION BY data_source) = 1 THEN 'acc' ELSE 'reward' END AS core FROM m)
SELECT data_source, var, metric, CASE WHEN var = core AND regexp_matches(metric, '^(mean|maj|best)@') AND n = max(n) OVER (PARTITION BY data_source, var) THEN 'val-core' ELSE 'val-aux' END AS section FROM k""",
)
def a10_route_metrics(spark, sf):
    pick = lambda names, n: F.get(F.array(*map(F.lit, names)), (F.col("event_id") % n).cast("int"))
    e = table(spark, sf, "events")
    var = F.when((F.col("event_type") == "click") & (F.col("event_id") % 3 == 0), "reward").otherwise(pick(["acc", "reward", "length"], 3))
    rows = e.select(F.col("event_type").alias("data_source"), var.alias("var"), pick(["mean@4", "mean@2", "best@4/mean", "maj@4/mean", "worst@4/mean", "std@4"], 6).alias("metric")).distinct()
    return M.route_metrics(rows)


@R.add("a11_offline_eval", "WITH r AS (SELECT event_type AS data_source, user_id, avg(value) AS s FROM events GROUP BY event_type, user_id) SELECT data_source, round(avg(s), 6) + 0.0 AS score FROM r GROUP BY data_source")
def a11_offline_eval(spark, sf):
    rows = table(spark, sf, "events").groupBy(F.col("event_type").alias("data_source"), "user_id").agg(F.collect_list("value").alias("scores"))
    return rounded(M.offline_eval(rows))


def _dataset_sql(group: str, name: str) -> str:
    share = lambda *k: f"round(count(*) FILTER (error_type IN ({', '.join(repr(x) for x in k)})) / count(*), 6) + 0.0"
    parts = {
        "accepted_at_1": "round(count(*) FILTER (accepted) / count(*), 6) + 0.0",
        "pass_ratio_mean": "round(avg(pass_ratio), 6) + 0.0",
        "pass_ratio_p50": "round(quantile_cont(pass_ratio, 0.5), 6) + 0.0",
        "pass_ratio_p90": "round(quantile_cont(pass_ratio, 0.9), 6) + 0.0",
        "exec_success_rate": share("success", "wrong_answer"),
        **{f"{e if e != 'unknown' else 'unknown_error'}_rate": share(e) for e in M.ERRORS},
        "avg_judge_time": "round(avg(judge_time), 6) + 0.0",
        "total_judge_time": "round(sum(judge_time), 6) + 0.0",
        "p50_judge_time": "round(quantile_cont(judge_time, 0.5), 6) + 0.0",
        "p95_judge_time": "round(quantile_cont(judge_time, 0.95), 6) + 0.0",
        "avg_gen_tokens": "round(sum(gen_tokens) / count(*), 6) + 0.0",
        "total_gen_tokens": "CAST(sum(gen_tokens) AS BIGINT)",
        "throughput": "round(count(*) / 100.0, 6) + 0.0",
        "cost_per_solved_tokens": "round(sum(gen_tokens) / nullif(count(*) FILTER (accepted), 0), 6) + 0.0",
        "cost_per_solved_judge_time": "round(sum(judge_time) / nullif(count(*) FILTER (accepted), 0), 6) + 0.0",
    }
    return f"SELECT {name} AS dataset, count(*) AS total_problems, " + ", ".join(f"{e} AS {k}" for k, e in parts.items()) + f" FROM per_problem {group}"


@R.add("a12_dataset_metrics", _dataset_sql("GROUP BY dataset", "coalesce(dataset, '(none)')") + " UNION ALL " + _dataset_sql("", "'overall'"))
def a12_dataset_metrics(spark, sf):
    return rounded(M.dataset_metrics(table(spark, sf, "per_problem"), 100.0))


@R.add("a13_executable", "SELECT dataset, count(*) FILTER (error_type IN ('success', 'wrong_answer', 'runtime_error')) AS executable, count(*) AS n FROM per_problem GROUP BY dataset")
def a13_executable(spark, sf):
    return table(spark, sf, "per_problem").groupBy("dataset").agg(F.count_if(M.is_executable(F.col("error_type"))).alias("executable"), F.count(F.lit(1)).alias("n"))


@R.add("a14_errors", "SELECT dataset, coalesce(error_type, 'none') AS error_type, count(*) AS n FROM per_problem GROUP BY 1, 2")
def a14_errors(spark, sf):
    return M.error_distribution(table(spark, sf, "per_problem"))


@R.add("a14_failure_pivot", "SELECT dataset, count(*) AS total, " + ", ".join(f"count(*) FILTER (error_type = '{k}') AS {k}" for k in ("success", *M.ERRORS)) + " FROM per_problem GROUP BY dataset")
def a14_failure_pivot(spark, sf):
    return M.failure_pivot(table(spark, sf, "per_problem"))


_WRAPPER = "CASE WHEN coalesce(response, '') = '' THEN 'empty' WHEN regexp_matches(response, '(?is)<code>.*?</code>') THEN 'code_tag' WHEN contains(response, '```') THEN 'md_fence' ELSE 'raw' END"


@R.add("a15_badcases", f"SELECT dataset, coalesce(error_type, 'none') AS error_type, {_WRAPPER} AS wrapper, count(*) AS n FROM per_problem WHERE NOT coalesce(accepted, false) GROUP BY 1, 2, 3")
def a15_badcases(spark, sf):
    bad = table(spark, sf, "per_problem").filter(~F.coalesce("accepted", F.lit(False)))
    return M.error_distribution(bad.withColumn("wrapper", wrapper_type("response")), ["dataset", "wrapper"])


@R.add("a15_examples", "SELECT dataset, coalesce(error_type, 'none') AS bucket, record_id, row_number() OVER (PARTITION BY dataset, coalesce(error_type, 'none') ORDER BY record_id) AS rank FROM per_problem QUALIFY rank <= 5")
def a15_examples(spark, sf):
    rows = table(spark, sf, "per_problem").select("dataset", F.coalesce("error_type", F.lit("none")).alias("bucket"), "record_id")
    return M.first_examples(rows, ["dataset", "bucket"], "record_id").withColumn("rank", F.col("rank").cast("bigint"))


_LAST = "json_extract_string(details, '$.last_error')"


@R.add(
    "f16_mismatches",
    f"""WITH e AS (SELECT record_id, coalesce({_LAST}, '') AS le FROM per_problem),
x AS (SELECT record_id, le, CASE WHEN regexp_matches(le, '(?s)Expected:\\s*(.*?),\\s*Got:\\s*(.*)$') THEN regexp_extract(le, '(?s)Expected:\\s*(.*?),\\s*Got:\\s*(.*)$', 1) END AS expected,
  CASE WHEN regexp_matches(le, '(?s)Expected:\\s*(.*?),\\s*Got:\\s*(.*)$') THEN regexp_extract(le, '(?s)Expected:\\s*(.*?),\\s*Got:\\s*(.*)$', 2) END AS got FROM e),
s AS (SELECT *, regexp_replace(expected, '[\\s\\p{{Z}}]+', '', 'g') AS es, regexp_replace(got, '[\\s\\p{{Z}}]+', '', 'g') AS gs FROM x)
SELECT record_id, expected, got, coalesce(list_extract(regexp_extract_all(le, '\\b([A-Za-z_]*Error|Exception)\\s*:', 1), -1), list_extract(regexp_extract_all(le, '\\b([A-Za-z_]*Error|Exception)\\b', 1), -1)) AS exception,
  CASE WHEN expected IS NULL THEN NULL WHEN expected = got THEN 'equal' WHEN lower(expected) = lower(got) THEN 'case' WHEN es = gs THEN 'whitespace' WHEN lower(es) = lower(gs) THEN 'case_whitespace' ELSE 'value' END AS mismatch FROM s""",
)
def f16_mismatches(spark, sf):
    rows = table(spark, sf, "per_problem").select("record_id", F.get_json_object("details", "$.last_error").alias("le"))
    e, g = expected_got("le")
    return rows.select("record_id", e.alias("expected"), g.alias("got"), guess_exception("le").alias("exception"), mismatch_class(e, g).alias("mismatch"))


@R.add(
    "a19_assembly",
    """WITH s AS (SELECT gen_time AS t, record_id % 5 AS v, record_id % 5 AS s, record_id % 5 + CASE WHEN record_id % 4 = 0 THEN 1 ELSE 0 END AS e FROM per_problem)
SELECT round(avg(t), 6) + 0.0 AS avg_processing_time, round(max(t), 6) + 0.0 AS max_processing_time, round(min(t), 6) + 0.0 AS min_processing_time, round(quantile_cont(t, 0.5), 6) + 0.0 AS tp50_processing_time, round(quantile_cont(t, 0.95), 6) + 0.0 AS tp95_processing_time, round(quantile_cont(t, 0.99), 6) + 0.0 AS tp99_processing_time,
  round(avg(CASE WHEN s <> e THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS partial_ratio, max(e - s) AS max_partial_span, count(DISTINCT v) AS version_diversity, max(v) - min(v) AS version_span FROM s""",
)
def a19_assembly(spark, sf):
    v = F.col("record_id") % 5
    rows = table(spark, sf, "per_problem").select(F.col("gen_time").alias("processing_time"), v.alias("version"), v.alias("start_version"), (v + F.when(F.col("record_id") % 4 == 0, 1).otherwise(0)).alias("end_version"))
    return rounded(M.assembly_stats(rows))


@R.add("a20_slowest", "SELECT round(avg(gen_time), 6) + 0.0 AS mean, round(max(gen_time), 6) + 0.0 AS max, round(min(gen_time), 6) + 0.0 AS min, (SELECT record_id FROM per_problem WHERE gen_time IS NOT NULL ORDER BY gen_time DESC, record_id LIMIT 1) AS slowest FROM per_problem")
def a20_slowest(spark, sf):
    return rounded(M.slowest(table(spark, sf, "per_problem"), "gen_time", "record_id"), "mean", "max", "min")


@R.add("a21_logprob_debug", f"WITH {TOKENS}, k AS (SELECT exp(logp) AS a, exp(rollout_logp) AS b FROM tokens WHERE mask = 1) SELECT round(corr(a, b), 6) + 0.0 AS pearson, round(max(abs(a - b)), 6) + 0.0 AS diff_max, round(avg(abs(a - b)), 6) + 0.0 AS diff_mean, round(stddev_samp(abs(a - b)), 6) + 0.0 AS diff_std FROM k")
def a21_logprob_debug(spark, sf):
    return rounded(M.logprob_debug(long_tokens(spark, sf).filter("mask = 1"), "logp", "rollout_logp"))


@R.add("a22_masked_stats", f"WITH {TOKENS}, k AS (SELECT x FROM tokens WHERE mask = 1) SELECT round(sum(x), 6) + 0.0 AS sum, round(avg(x), 6) + 0.0 AS mean, round(var_samp(x), 6) + 0.0 AS var FROM k")
def a22_masked_stats(spark, sf):
    return rounded(M.masked_stats(tokens(spark, sf), "x", "mask"))


@R.add("a22_whiten", f"WITH {TOKENS}, s AS (SELECT seq, t, x, avg(CASE WHEN mask = 1 THEN x END) OVER () AS m, var_samp(CASE WHEN mask = 1 THEN x END) OVER () AS v FROM tokens) SELECT seq, t, round((x - m) / sqrt(v + 1e-8), 6) + 0.0 AS whitened FROM s")
def a22_whiten(spark, sf):
    from corpusmill.operators.advantages import whiten

    return whiten(tokens(spark, sf), "x", "mask").select("seq", F.posexplode("whitened").alias("t", "whitened")).select("seq", F.col("t").cast("bigint").alias("t"), r6("whitened").alias("whitened"))


@R.add("a23_imbalance", "WITH p AS (SELECT l_suppkey % 8 AS part, sum(l_linenumber) AS t FROM lineitem GROUP BY 1) SELECT CAST(min(t) AS BIGINT) AS min, CAST(max(t) AS BIGINT) AS max, CAST(max(t) - min(t) AS BIGINT) AS minmax_diff, round(avg(t), 6) + 0.0 AS mean FROM p")
def a23_imbalance(spark, sf):
    return rounded(M.imbalance(table(spark, sf, "lineitem").select((F.col("l_suppkey") % 8).alias("part"), F.col("l_linenumber").alias("length"))))


@R.add(
    "a24_verdicts",
    """WITH v AS (SELECT problem_id, dataset, CASE coalesce(error_type, 'unknown') WHEN 'success' THEN 'passed' ELSE coalesce(error_type, 'unknown') END AS s FROM per_problem)
SELECT dataset, problem_id, count(*) AS n_tests, round(count(*) FILTER (s = 'passed') / count(*), 6) + 0.0 AS pass_ratio, count(*) = count(*) FILTER (s = 'passed') AS accepted,
  CASE WHEN count(*) = count(*) FILTER (s = 'passed') THEN 'success' WHEN bool_or(s = 'syntax_error') THEN 'syntax_error' WHEN bool_or(s = 'timeout') THEN 'timeout' WHEN bool_or(s = 'runtime_error') THEN 'runtime_error' WHEN bool_or(s = 'wrong_answer') THEN 'wrong_answer' ELSE 'unknown' END AS error_type
FROM v GROUP BY dataset, problem_id""",
)
def a24_verdicts(spark, sf):
    t = F.coalesce("error_type", F.lit("unknown"))
    rows = table(spark, sf, "per_problem").select("dataset", "problem_id", F.when(t == "success", "passed").otherwise(t).alias("status"))
    return rounded(M.verdict_rollup(rows, ["dataset", "problem_id"]), "pass_ratio")


@R.add(
    "a24b_stored_verdicts",
    """WITH v AS (SELECT record_id, response, accepted, CASE WHEN record_id % 3 = 0 THEN pass_ratio END AS score, CASE WHEN error_type = 'timeout' AND record_id % 2 = 0 THEN 'no reply' END AS failure,
  list_filter([CASE WHEN record_id % 4 > 0 THEN 'success' END, CASE error_type WHEN 'success' THEN 'success' WHEN 'syntax_error' THEN 'compile_error' ELSE error_type END], lambda x: x IS NOT NULL) AS st FROM per_problem),
w AS (SELECT *, coalesce(trim(regexp_replace(response, '\\s', ' ', 'g')) = '', true) AS blank, list_filter(st, lambda x: x IN ('syntax_error', 'compile_error', 'runtime_error', 'timeout'))[1] AS e FROM v)
SELECT record_id, CASE WHEN blank OR failure IS NOT NULL THEN false WHEN score IS NOT NULL THEN score = 1 ELSE coalesce(accepted, false) END AS accepted,
  round(CASE WHEN blank OR failure IS NOT NULL THEN 0.0 WHEN score IS NOT NULL THEN score WHEN len(st) > 0 THEN len(list_filter(st, lambda x: x = 'success')) / len(st) WHEN accepted THEN 1.0 ELSE 0.0 END, 6) + 0.0 AS pass_ratio,
  CASE WHEN blank THEN 'empty_output' WHEN failure IS NOT NULL THEN 'api_error' WHEN score IS NOT NULL THEN CASE WHEN len(st) = 0 THEN 'unknown' WHEN e = 'compile_error' THEN 'syntax_error' WHEN e IS NOT NULL THEN e ELSE 'wrong_answer' END
    WHEN accepted THEN 'success' WHEN e = 'compile_error' THEN 'syntax_error' WHEN e IS NOT NULL THEN e ELSE 'wrong_answer' END AS error_type, CAST(len(st) AS INT) AS test_count FROM w""",
)
def a24b_stored_verdicts(spark, sf):
    """Stored judge replies as evaluation results: submissions and scored ones, failed calls, empty completions."""
    e = F.col("error_type")
    first, second = F.when(F.col("record_id") % 4 > 0, "success"), F.when(e == "syntax_error", "compile_error").otherwise(e)
    rows = table(spark, sf, "per_problem").select("record_id", F.col("response").alias("completion"), "accepted", F.when(F.col("record_id") % 3 == 0, F.col("pass_ratio")).alias("score"), F.when((e == "timeout") & (F.col("record_id") % 2 == 0), "no reply").alias("failure"), F.filter(F.array(first, second), lambda x: x.isNotNull()).alias("statuses"))
    return rounded(M.stored_verdicts(rows).select("record_id", "accepted", "pass_ratio", "error_type", "test_count"), "pass_ratio")


@R.add("a25_totals", "SELECT dataset, count(*) AS total, count(*) FILTER (finish_reason = 'length') AS truncated, count(*) FILTER (error_type = 'timeout') AS timeouts, round(count(*) FILTER (finish_reason = 'length') / count(*), 6) + 0.0 AS truncation_rate, round(count(*) FILTER (error_type = 'timeout') / count(*), 6) + 0.0 AS timeout_rate, count(*) FILTER (finish_reason = 'length') / count(*) > 0.05 AS truncation_high, count(*) FILTER (error_type = 'timeout') / count(*) > 0.1 AS timeout_high FROM per_problem GROUP BY dataset")
def a25_totals(spark, sf):
    return rounded(M.eval_totals(table(spark, sf, "per_problem")), "truncation_rate", "timeout_rate")


@R.add("a26_tail_ratios", "WITH b AS (SELECT quantile_cont(gen_time, 0.95) AS bar FROM per_problem) SELECT run_id, round(avg(gen_time), 6) + 0.0 AS mean, round(min(gen_time), 6) + 0.0 AS min, round(max(gen_time), 6) + 0.0 AS max, round(max(bar), 6) + 0.0 AS bar, round(avg(CASE WHEN gen_time > bar THEN 1.0 WHEN gen_time <= bar THEN 0.0 END), 6) + 0.0 AS tail_ratio FROM per_problem, b GROUP BY run_id")
def a26_tail_ratios(spark, sf):
    return rounded(M.tail_ratios(table(spark, sf, "per_problem"), 5.0, ["run_id"], "gen_time"))
