"""Rollups of evaluation and training records."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Error types of judged answers.
EXECUTED = ("success", "wrong_answer")
EXECUTED_WIDE = ("success", "wrong_answer", "runtime_error")
ERRORS = ("syntax_error", "runtime_error", "timeout", "wrong_answer", "api_error", "unknown")
#: The bootstrap takes so many draws of a group or of groups at once.
_PICKED = 1 << 16


def reduce_metrics(long: DataFrame, name="name", value="value") -> DataFrame:
    """(name, value) of a metric's values: the largest where the name holds "max", else the smallest for "min", else the mean."""
    n = F.col(name)
    return long.groupBy(name).agg(F.max(value).alias("hi"), F.min(value).alias("lo"), F.avg(value).alias("mid")).select(name, F.when(n.contains("max"), F.col("hi")).when(n.contains("min"), F.col("lo")).otherwise(F.col("mid")).alias("value"))


def data_metrics(batch: DataFrame, width: int, max_prompt: int, with_values: bool = True) -> DataFrame:
    """One row of batch statistics over (score, reward, advantages, returns, values, mask, prompt_length).

    Scores and rewards skip responses of no token; token statistics go over kept tokens;
    the explained variance is 1 - var(returns - values) / (var(returns) + 1e-5).
    A batch in which every response is empty is an error.
    """
    kept = lambda c: F.transform(F.filter(F.arrays_zip(c, "mask"), lambda p: p["mask"] > 0), lambda p: p[c].cast("double"))
    arrays = ["advantages", "returns"] + ["values"] * with_values
    rows = batch.withColumn("length", F.aggregate("mask", F.lit(0).cast("bigint"), lambda a, m: a + m)).select("score", "reward", "prompt_length", "length", *[kept(a).alias(a) for a in arrays])
    some = F.col("length") > 0
    stat = lambda label, c: [F.avg(c).alias(f"{label}_mean"), F.max(c).alias(f"{label}_max"), F.min(c).alias(f"{label}_min")]
    lengths = F.col("length").cast("double")
    prompts = F.col("prompt_length").cast("double")
    top = rows.agg(
        *stat("score", F.when(some, F.col("score"))),
        *stat("reward", F.when(some, F.col("reward"))),
        *stat("response_length", lengths),
        F.avg((F.col("length") == width).cast("double")).alias("response_length_clip_ratio"),
        *stat("response_length_non_aborted", F.when(some, lengths)),
        F.avg(F.when(some, (F.col("length") == width).cast("double"))).alias("response_length_non_aborted_clip_ratio"),
        F.avg((~some).cast("double")).alias("aborted_ratio"),
        *stat("prompt_length", prompts),
        F.avg((F.col("prompt_length") == max_prompt).cast("double")).alias("prompt_length_clip_ratio"),
        F.when(F.count_if(some) == 0, F.raise_error(F.lit("all responses are empty"))).otherwise(F.count_if(some)).alias("responses"),
    )
    long = rows.select(F.explode(F.arrays_zip(*arrays)).alias("p")).select(*[F.col("p")[a].alias(a) for a in arrays])
    parts = [*stat("advantages", F.col("advantages")), *stat("returns", F.col("returns"))]
    if with_values:
        parts += [*stat("values", F.col("values")), (1 - F.var_samp(F.col("returns") - F.col("values")) / (F.var_samp("returns") + 1e-5)).alias("vf_explained_var")]
    return top.join(long.agg(*parts))  # two one-row tables


def timing_metrics(timings: DataFrame, prompt_tokens: int, response_tokens: int) -> DataFrame:
    """(name, seconds, per_token_ms) of phases: generation counts response tokens, the other known phases all tokens."""
    total = prompt_tokens + response_tokens
    tokens = F.when(F.col("name") == "gen", F.lit(response_tokens)).when(F.col("name").isin("ref", "values", "adv", "update_critic", "update_actor"), F.lit(total))
    return timings.groupBy("name").agg(F.sum("seconds").alias("seconds")).select("name", "seconds", (F.col("seconds") * 1000 / tokens).alias("per_token_ms"))


def throughput(batch: DataFrame, seconds: float, gpus: int, tokens="tokens") -> DataFrame:
    """One row: total tokens, time per step and tokens a second and device."""
    return batch.agg(F.sum(tokens).cast("bigint").alias("total_num_tokens")).select("total_num_tokens", F.lit(float(seconds)).alias("time_per_step"), (F.col("total_num_tokens") / (seconds * gpus)).alias("throughput"))


def variance_proxies(rows: DataFrame, gradient_norm: float | None = None) -> DataFrame:
    """One row from (advantage, w): total power E[A^2 W], E[A^2], E[W], and with a gradient norm signal and noise.

    ``advantage`` is the masked mean of a response, ``w`` its summed 1 - 2 pi + sum(pi^2).
    """
    a, w = F.col("advantage"), F.col("w")
    base = rows.agg(F.avg(a * a * F.greatest(w, F.lit(0.0))).alias("proxy2_total_power"), F.avg(a * a).alias("expected_a_squared"), F.avg(w).alias("expected_w"), F.count(F.lit(1)).alias("n"))
    if gradient_norm is None:
        return base.select(F.lit(0.0).alias("proxy1_signal_strength"), "proxy2_total_power", F.lit(0.0).alias("proxy3_pure_noise"), "expected_a_squared", "expected_w")
    signal = float(gradient_norm) ** 2
    noise = F.when(F.col("n") > 1, F.greatest((F.col("proxy2_total_power") - signal) / (F.col("n") - 1), F.lit(0.0))).otherwise(0.0)
    return base.select(F.lit(signal).alias("proxy1_signal_strength"), "proxy2_total_power", noise.alias("proxy3_pure_noise"), "expected_a_squared", "expected_w")


@lru_cache(maxsize=128)
def _kept_picks(n: int, size: int, draws: int, seed: int) -> np.ndarray:
    return np.ascontiguousarray(np.random.RandomState(seed).choice(n, (draws, size), replace=True).T)


def _picks(n: int, size: int, draws: int, seed: int) -> Iterator[np.ndarray]:
    """Places drawn out of ``n`` with numpy's generator, a column a draw: kept where they are few, else in blocks of draws.

    One call for many draws goes through the same numbers as a call a draw.
    """
    if draws * size <= _PICKED:
        yield _kept_picks(n, size, draws, seed)
        return
    rng, step = np.random.RandomState(seed), max(1, _PICKED // size)
    for k in range(0, draws, step):
        yield rng.choice(n, (min(step, draws - k), size), replace=True).T


def _drawn_extremes(values: np.ndarray, edges: np.ndarray, sizes: np.ndarray, draws: int, seed: int) -> np.ndarray:
    """Rows (best mean, best std, worst mean, worst std) of the groups between ``edges``; groups of one length and size share their draws."""
    lengths = np.diff(edges)
    out = np.empty((4, len(lengths)))
    for n, size in set(zip(lengths.tolist(), sizes.tolist())):
        same = np.flatnonzero((lengths == n) & (sizes == size))
        step = max(1, _PICKED // (draws * size))
        for k in range(0, len(same), step):
            at = same[k : k + step]
            drawn = (values.take(edges[at][:, None, None] + p) for p in _picks(n, size, draws, seed))
            ends = [(d.max(axis=1), d.min(axis=1)) for d in drawn]
            best, worst = (np.concatenate(e, axis=1) for e in zip(*ends))
            out[:, at] = best.mean(axis=1), best.std(axis=1), worst.mean(axis=1), worst.std(axis=1)
    return out


def bootstrap(rows: DataFrame, keys: list[str], value="score", order="idx", size="n", draws: int = 1000, seed: int = 42) -> DataFrame:
    """(keys, best_mean, best_std, worst_mean, worst_std): seeded bootstrap of the best and worst of ``size`` draws.

    One group is the responses of one prompt; the draws follow numpy's generator with the
    given seed, one generator a group.  They depend on the group's length and size only, so
    a task makes them once for all groups that agree in both.  Groups come sorted, batch by
    batch; a task holds a batch and the values of the group that is not yet whole.
    """

    def run(batches):
        # values since the start of the last group, and the row that starts it
        held, head = [], None
        for batch in batches:
            place = batch.column("__i").to_numpy()
            fresh = batch.column("__v").to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(place == 1)
            if not len(starts):
                held.append(fresh)
                continue
            values = np.concatenate([*held, fresh])
            edges = starts + len(values) - len(fresh)
            heads = batch.take(pa.array(starts))
            if head is not None:
                edges = np.concatenate(([0], edges))
                heads = pa.concat_batches([head, heads])
            if len(edges) > 1:
                yield done(heads.slice(0, len(edges) - 1), values, edges)
            held, head = [values[edges[-1] :].copy()], heads.slice(len(edges) - 1)
        if head is not None:
            values = np.concatenate(held)
            yield done(head, values, np.array([0, len(values)]))

    def done(heads, values, edges):
        found = _drawn_extremes(values, edges, heads.column("__s").to_numpy(), draws, seed)
        return pa.RecordBatch.from_arrays([*(heads.column(k) for k in keys), *(pa.array(c) for c in found)], [*keys, "best_mean", "best_std", "worst_mean", "worst_std"])

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", best_mean double, best_std double, worst_mean double, worst_std double"
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).asc_nulls_last(), F.col(value).asc_nulls_last()))
    placed = rows.select(*keys, F.coalesce(F.col(value).cast("double"), F.lit(float("nan"))).alias("__v"), F.col(size).cast("bigint").alias("__s"), place.alias("__i"))
    return placed.mapInArrow(run, schema)


def expected_extremes(rows: DataFrame, keys: list[str], n: int | Column, value="score", order="idx") -> DataFrame:
    """(keys, best, worst): the exact expectation of the largest and smallest of n draws with replacement.

    sum over sorted values of x(i) * ((i/N)^n - ((i-1)/N)^n); what ``bootstrap`` estimates.
    """
    w = Window.partitionBy(*keys).orderBy(value, order)
    ranked = rows.withColumn("__i", F.row_number().over(w)).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    k = (n if isinstance(n, Column) else F.lit(n)).cast("double")
    share = lambda i: F.pow(i / F.col("__n"), k)
    i = F.col("__i")
    best = F.col(value) * (share(i) - share(i - 1))
    worst = F.col(value) * (share(F.col("__n") - i + 1) - share(F.col("__n") - i))
    return ranked.groupBy(*keys).agg(F.sum(best).alias("best"), F.sum(worst).alias("worst"))


def majority_value(rows: DataFrame, keys: list[str], pred="pred", value="score", order="idx") -> DataFrame:
    """(keys, maj): the value of the first response that gives the most frequent prediction; ties to the prediction seen first."""
    votes = rows.groupBy(*keys, pred).agg(F.count(F.lit(1)).alias("votes"), F.min(F.struct(order, value)).alias("first"))
    best = F.max(F.struct("votes", (-F.col("first")[order]).alias("early"), F.col("first")[value].alias("value")))
    return votes.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.value").alias("maj"))


def draw_sizes(n: Column) -> Column:
    """2, 4, 8 ... below n, then n itself, for n > 1."""
    powers = F.filter(F.transform(F.sequence(F.lit(1), F.lit(30)), lambda k: F.pow(F.lit(2.0), k).cast("bigint")), lambda p: p < n)
    return F.when(n > 1, F.concat(powers, F.array(n.cast("bigint")))).otherwise(F.array().cast("array<bigint>"))


def validation_metrics(rows: DataFrame, source="data_source", uid="uid", value="score", order="idx") -> DataFrame:
    """(data_source, metric, value): per prompt mean@N, population std@N and exact best/worst@n, then the mean over prompts.

    n runs over 2, 4, 8 ... N.  A prompt of one response has its mean only.
    """
    keys = [source, uid]
    w = Window.partitionBy(*keys).orderBy(value, order)
    ranked = rows.withColumn("__i", F.row_number().over(w)).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    plain = ranked.groupBy(*keys, "__n").agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    first = plain.select(source, F.explode(F.filter(F.array(F.struct(F.format_string("mean@%d", "__n").alias("metric"), F.col("mean").alias("value")), F.when(F.col("__n") > 1, F.struct(F.format_string("std@%d", "__n").alias("metric"), F.col("std").alias("value")))), lambda x: x.isNotNull())).alias("m"))
    each = ranked.filter("__n > 1").withColumn("__k", F.explode(draw_sizes(F.col("__n"))))
    share = lambda i: F.pow(i / F.col("__n"), F.col("__k").cast("double"))
    i = F.col("__i")
    best = F.sum(F.col(value) * (share(i) - share(i - 1)))
    worst = F.sum(F.col(value) * (share(F.col("__n") - i + 1) - share(F.col("__n") - i)))
    drawn = each.groupBy(*keys, "__k").agg(best.alias("best"), worst.alias("worst"))
    second = drawn.select(source, F.explode(F.array(F.struct(F.format_string("best@%d/mean", "__k").alias("metric"), F.col("best").alias("value")), F.struct(F.format_string("worst@%d/mean", "__k").alias("metric"), F.col("worst").alias("value")))).alias("m"))
    return first.unionByName(second).groupBy(source, F.col("m.metric").alias("metric")).agg(F.avg("m.value").alias("value"))


def route_metrics(metrics: DataFrame, source="data_source", var="var", metric="metric", core_var="acc", fallback="reward") -> DataFrame:
    """Adds ``section``: val-core for the core variable's mean@, maj@ and best@ at the source's largest n, else val-aux.

    The core variable is ``acc`` where a source has it, else ``reward``.
    """
    n = F.regexp_extract(metric, r"@([0-9]+)", 1).cast("int")
    w = Window.partitionBy(source)
    core = F.when(F.max((F.col(var) == core_var).cast("int")).over(w) == 1, F.lit(core_var)).otherwise(F.lit(fallback))
    largest = F.max(n).over(Window.partitionBy(source, var))
    kind = F.col(metric).rlike("^(mean|maj|best)@")
    return metrics.withColumn("section", F.when((F.col(var) == core) & kind & (n == largest), "val-core").otherwise("val-aux"))


def offline_eval(responses: DataFrame, source="data_source", scores="scores") -> DataFrame:
    """(data_source, score): mean over a row's responses, then over the rows of a source."""
    total = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x)
    return responses.filter(F.size(scores) > 0).groupBy(source).agg(F.avg(total / F.size(scores)).alias("score"))


def _accepted(c="accepted"):
    return F.coalesce(F.col(c), F.lit(False)).cast("int")


def dataset_metrics(records: DataFrame, wall_seconds: float | None = None, overall: bool = True) -> DataFrame:
    """One row a dataset (and ``overall``) of judged records: acceptance, pass ratios, error rates, judging and token costs.

    Percentiles interpolate linearly.  Null ratios, times and token counts are skipped by
    means and percentiles; a null error type counts as no type.  Costs per solved problem
    are null where nothing was solved.
    """
    total = F.count(F.lit(1)).cast("double")
    solved = F.sum(_accepted()).cast("double")
    share = lambda *kinds: F.sum(F.coalesce(F.col("error_type").isin(*kinds), F.lit(False)).cast("int")) / total
    pct = lambda c, p: F.percentile(c, F.lit(p))
    parts = {
        "total_problems": F.count(F.lit(1)),
        "accepted_at_1": solved / total,
        "pass_ratio_mean": F.avg("pass_ratio"),
        "pass_ratio_p50": pct("pass_ratio", 0.5),
        "pass_ratio_p90": pct("pass_ratio", 0.9),
        "exec_success_rate": share(*EXECUTED),
        **{f"{e if e != 'unknown' else 'unknown_error'}_rate": share(e) for e in ERRORS},
        "avg_judge_time": F.avg("judge_time"),
        "total_judge_time": F.sum("judge_time"),
        "p50_judge_time": pct("judge_time", 0.5),
        "p95_judge_time": pct("judge_time", 0.95),
        "avg_gen_tokens": F.sum("gen_tokens") / total,
        "total_gen_tokens": F.sum("gen_tokens").cast("bigint"),
        "throughput": total / wall_seconds if wall_seconds else F.lit(0.0),
        "cost_per_solved_tokens": F.try_divide(F.sum("gen_tokens").cast("double"), solved),
        "cost_per_solved_judge_time": F.try_divide(F.sum("judge_time"), solved),
    }
    columns = [c.alias(k) for k, c in parts.items()]
    if not overall:
        return records.groupBy("dataset").agg(*columns)
    named = records.withColumn("dataset", F.coalesce("dataset", F.lit("(none)")))
    return named.rollup("dataset").agg(*columns).withColumn("dataset", F.coalesce("dataset", F.lit("overall")))


def is_executable(error_type: Column) -> Column:
    """Whether code ran at all; runtime errors count here, unlike in ``exec_success_rate``."""
    return F.coalesce(error_type.isin(*EXECUTED_WIDE), F.lit(False))


def error_distribution(records: DataFrame, by: list[str] = ("dataset",)) -> DataFrame:
    """Counts of error types, null as ``none``."""
    return records.groupBy(*by, F.coalesce("error_type", F.lit("none")).alias("error_type")).agg(F.count(F.lit(1)).alias("n"))


def failure_pivot(records: DataFrame) -> DataFrame:
    """One row a dataset: totals and a column an error type."""
    kinds = ["success", *ERRORS]
    return records.groupBy("dataset").agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("error_type") == k).alias(k) for k in kinds])


def first_examples(records: DataFrame, bucket: list[str], order: str, most: int = 5) -> DataFrame:
    """The first ``most`` records of each bucket with their rank; a report's examples.

    Ranked in two steps, within hash cells and then among the cells' firsts, so a large
    bucket is not sorted in one task.
    """
    cell = F.pmod(F.xxhash64(F.col(order)), F.lit(64))
    inner = Window.partitionBy(*bucket, cell).orderBy(order)
    outer = Window.partitionBy(*bucket).orderBy(order)
    return records.withColumn("__r", F.row_number().over(inner)).filter(F.col("__r") <= most).withColumn("rank", F.row_number().over(outer)).filter(F.col("rank") <= most).drop("__r")


def step_metrics(long: DataFrame, step="step", name="name", value="value", weight="weight", rules: dict[str, str] | None = None) -> DataFrame:
    """(name, rule, value): metrics of several steps folded into one, by a table of rules, then by words of the name.

    Words, in order: timing_s/ sums; mean and avg; max; min; sum or total sums; otherwise
    the mean.  A rule of the table wins.  ``last`` takes the value of the latest step;
    ``weighted_avg`` weighs by the sample count.
    """
    n = F.col(name)
    known = F.lit(None).cast("string")
    for k, rule in (rules or {}).items():
        known = F.when(n == k, F.lit(rule)).otherwise(known)
    words = (
        F.when(n.startswith("timing_s/"), "time_sum")
        .when(n.rlike("mean|avg|average"), "avg")
        .when(n.contains("max"), "max")
        .when(n.contains("min"), "min")
        .when(n.rlike("sum|total"), "sum")
        .otherwise("avg")
    )
    ruled = long.withColumn("rule", F.coalesce(known, words))
    w = F.coalesce(F.col(weight).cast("double"), F.lit(1.0))
    agg = ruled.groupBy(name, "rule").agg(
        F.sum(value).alias("total"), F.avg(value).alias("mean"), F.max(value).alias("hi"), F.min(value).alias("lo"), F.try_divide(F.sum(F.col(value) * w), F.sum(w)).alias("weighted"), F.max(F.struct(step, value)).alias("last")
    )
    pick = F.when(F.col("rule").isin("sum", "time_sum"), F.col("total")).when(F.col("rule") == "max", F.col("hi")).when(F.col("rule") == "min", F.col("lo")).when(F.col("rule") == "weighted_avg", F.col("weighted")).when(F.col("rule") == "last", F.col("last")[value]).otherwise(F.col("mean"))
    return agg.select(name, "rule", pick.alias("value"))


def step_overrides(folded: DataFrame, gpus: int, name="name", value="value") -> DataFrame:
    """``step_metrics`` with derived metrics in place of folded ones: seqlen spread, throughput and idle ratio.

    The folded table has a row a metric name; its names form one map.
    """
    m = F.broadcast(folded.agg(F.map_from_entries(F.collect_list(F.struct(name, value))).alias("__m")))  # a one-row table
    at = lambda k: F.col("__m")[k]
    derived = {
        "global_seqlen/minmax_diff": at("global_seqlen/max") - at("global_seqlen/min"),
        "perf/throughput": F.try_divide(at("perf/total_num_tokens"), at("perf/time_per_step") * gpus),
    }
    out = F.col(value)
    for k, c in derived.items():
        out = F.when((F.col(name) == k) & c.isNotNull(), c).otherwise(out)
    kept = folded.join(m).withColumn(value, out).drop("__m")
    idle = m.filter(at("timing_s/gen").isNotNull() & at("timing_s/step").isNotNull()).select(F.lit("trainer/idle_ratio").alias(name), F.try_divide(at("timing_s/gen"), at("timing_s/step")).alias(value))
    return kept.filter(F.col(name) != "trainer/idle_ratio").unionByName(idle, allowMissingColumns=True)


def assembly_stats(samples: DataFrame, seconds="processing_time", version="version", start="start_version", end="end_version") -> DataFrame:
    """One row for an assembled batch: processing times, share of partial samples, version span and diversity."""
    s = F.col(seconds)
    return samples.agg(
        F.avg(s).alias("avg_processing_time"),
        F.max(s).alias("max_processing_time"),
        F.min(s).alias("min_processing_time"),
        *[F.percentile(s, F.lit(p / 100)).alias(f"tp{p}_processing_time") for p in (50, 95, 99)],
        F.avg((F.col(start) != F.col(end)).cast("double")).alias("partial_ratio"),
        F.max(F.col(end) - F.col(start)).cast("bigint").alias("max_partial_span"),
        F.count_distinct(version).alias("version_diversity"),
        (F.max(version) - F.min(version)).cast("bigint").alias("version_span"),
    )


def slowest(samples: DataFrame, seconds="seconds", order="idx") -> DataFrame:
    """One row: mean, max and min of a timing, and the first of the slowest samples."""
    s = F.col(seconds)
    return samples.agg(F.avg(s).alias("mean"), F.max(s).alias("max"), F.min(s).alias("min"), F.max(F.struct(s.alias("s"), (-F.col(order)).alias("o"))).alias("m")).select("mean", "max", "min", (-F.col("m.o")).alias("slowest"))


def logprob_debug(tokens: DataFrame, a="a", b="b") -> DataFrame:
    """One row over kept tokens: Pearson correlation of probabilities, and mean, max and std of their absolute difference."""
    pa_, pb = F.exp(F.col(a)), F.exp(F.col(b))
    d = F.abs(pa_ - pb)
    return tokens.agg(F.corr(pa_, pb).alias("pearson"), F.max(d).alias("diff_max"), F.avg(d).alias("diff_mean"), F.stddev_samp(d).alias("diff_std"))


def masked_stats(df: DataFrame, values: str, mask: str) -> DataFrame:
    """One row: masked sum, mean (over the mask's sum + 1e-8) and unbiased variance; an error if one token or none is kept."""
    from corpusmill.operators.losses import token_sums

    rows = token_sums(df, [values], mask, lambda p: {"x": p[values], "xx": p[values] * p[values]})
    n, s = F.sum("n"), F.sum("x")
    mean = s / (n + 1e-8)
    var = (F.sum("xx") - 2 * mean * s + mean * mean * n) / (n + 1e-8) * n / (n - 1)
    return rows.agg(s.alias("sum"), mean.alias("mean"), F.when(n <= 1, F.raise_error(F.lit("the variance needs two kept tokens"))).otherwise(var).alias("var"))


def imbalance(parts: DataFrame, part="part", length="length") -> DataFrame:
    """One row: smallest, largest and mean total length of the parts, and the spread."""
    per = parts.groupBy(part).agg(F.sum(length).alias("t"))
    return per.agg(F.min("t").cast("bigint").alias("min"), F.max("t").cast("bigint").alias("max"), (F.max("t") - F.min("t")).cast("bigint").alias("minmax_diff"), F.avg("t").alias("mean"))


def verdict_rollup(verdicts: DataFrame, key: list[str], status="status") -> DataFrame:
    """(key, n_tests, pass_ratio, accepted, error_type) from one status a test.

    Statuses: passed, wrong_answer, runtime_error, timeout, syntax_error, others.  The
    error type is the gravest found: syntax, timeout, runtime, wrong answer, unknown.
    """
    s = F.col(status)
    any_ = lambda k: F.coalesce(F.bool_or(s == k), F.lit(False))
    n, ok = F.count(F.lit(1)), F.count_if(s == "passed")
    kind = F.when(n == ok, "success").when(any_("syntax_error"), "syntax_error").when(any_("timeout"), "timeout").when(any_("runtime_error"), "runtime_error").when(any_("wrong_answer"), "wrong_answer").otherwise("unknown")
    return verdicts.groupBy(*key).agg(n.alias("n_tests"), (ok / n).alias("pass_ratio"), (n == ok).alias("accepted"), kind.alias("error_type"))


def _first_error(statuses, kinds: dict[str, str], otherwise: str):
    """What the first status that names an error is called; ``otherwise`` if none does."""
    named = F.filter(statuses, lambda x: F.coalesce(x.isin(*kinds), F.lit(False)))
    first = F.try_element_at(named, F.lit(1))
    out = None
    for status, name in kinds.items():
        out = F.when(first == status, name) if out is None else out.when(first == status, name)
    return out.otherwise(otherwise)


#: What a stored status is called as an error type.
STATUS_ERRORS = {"syntax_error": "syntax_error", "compile_error": "syntax_error", "runtime_error": "runtime_error", "timeout": "timeout"}


def stored_verdicts(rows: DataFrame, completion="completion", statuses="statuses", accepted="accepted", score="score", failure="failure") -> DataFrame:
    """Adds ``accepted``, ``pass_ratio``, ``error_type`` and ``test_count`` from verdicts that a judge has stored.

    A row holds either what a submission returned (``accepted`` and one status a test) or
    what scoring returned (``score`` and the statuses); ``failure`` is the error text of a
    call that failed.  A blank completion is ``empty_output``, a failed call ``api_error``;
    both pass nothing.  The ratio is the share of tests with status success (without tests
    it follows ``accepted``), or the score, and all tests pass where the score is 1.  The
    error type is that of the first status that names one, else a wrong answer; a scored
    row without any status is ``unknown``.
    """
    list_ = F.coalesce(F.col(statuses), F.array().cast("array<string>"))
    n, scored = F.size(list_), F.col(score).isNotNull()
    yes = F.when(scored, F.col(score) == 1.0).otherwise(F.coalesce(F.col(accepted), F.lit(False)))
    passed = F.size(F.filter(list_, lambda x: x == "success"))
    ratio = F.when(scored, F.col(score)).when(n > 0, passed / n).otherwise(yes.cast("double"))
    # scoring tells syntax errors by compile_error alone and calls what passed a wrong answer
    by_score = F.when(n == 0, "unknown").otherwise(_first_error(list_, {k: v for k, v in STATUS_ERRORS.items() if k != "syntax_error"}, "wrong_answer"))
    kind = F.when(scored, by_score).when(yes, "success").otherwise(_first_error(list_, STATUS_ERRORS, "wrong_answer"))
    blank = F.coalesce(F.trim(F.regexp_replace(completion, r"\s", " ")) == "", F.lit(True))
    lost = blank | F.col(failure).isNotNull()
    return rows.withColumns(
        {
            "test_count": n,
            "pass_ratio": F.when(lost, F.lit(0.0)).otherwise(ratio),
            "error_type": F.when(blank, "empty_output").when(F.col(failure).isNotNull(), "api_error").otherwise(kind),
            "accepted": ~lost & yes,
        }
    )


def tail_ratios(timings: DataFrame, k: float, by: list[str], value="seconds") -> DataFrame:
    """(by, mean, min, max, bar, tail_ratio): the share of values above the 1 - k/100 quantile of all."""
    bar = timings.agg(F.percentile(value, F.lit(1 - k / 100)).alias("bar"))
    return timings.join(F.broadcast(bar)).groupBy(*by).agg(F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), F.first("bar").alias("bar"), F.avg((F.col(value) > F.col("bar")).cast("double")).alias("tail_ratio"))  # a one-row table


def eval_totals(records: DataFrame, truncation_limit: float = 0.05, timeout_limit: float = 0.1) -> DataFrame:
    """(dataset, total, truncated, timeouts, rates, flags): how many answers were cut or timed out, and whether too many."""
    cut_ = F.count_if(F.col("finish_reason") == "length")
    late = F.count_if(F.col("error_type") == "timeout")
    n = F.count(F.lit(1))
    return records.groupBy("dataset").agg(
        n.alias("total"),
        cut_.alias("truncated"),
        late.alias("timeouts"),
        (cut_ / n).alias("truncation_rate"),
        (late / n).alias("timeout_rate"),
        ((cut_ / n) > truncation_limit).alias("truncation_high"),
        ((late / n) > timeout_limit).alias("timeout_high"),
    )
