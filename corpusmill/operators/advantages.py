"""Group-relative and token-level advantage estimators.

Group estimators work on one row a response (uid, score, and what the estimator names) and
add columns by window functions over the prompt group ``uid``: one shuffle, no join.  Group
sizes are the responses of one prompt; the statistics over the whole batch are aggregates.
Token estimators work on arrays, one element a token; scans run over Arrow batches in
numpy, in time linear in the tokens.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPSILON = 1e-6


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _group(uid) -> Window:
    return Window.partitionBy(uid)


def group_mean_std(df: DataFrame, score="score", uid="uid", eps: float = 1e-6) -> DataFrame:
    """Adds ``mean``, ``std`` and ``n`` of the group: sample variance floored at eps; a group of one has (0, 1).

    Null scores do not count; a null uid is a group of its own kind.
    """
    w = _group(uid)
    s, n = _c(score), F.count(_c(score)).over(w)
    return df.withColumns(
        {
            "n": n,
            "mean": F.when(n == 1, F.lit(0.0)).otherwise(F.avg(s).over(w)),
            "std": F.when(n == 1, F.lit(1.0)).otherwise(F.sqrt(F.greatest(F.var_samp(s).over(w), F.lit(eps)))),
        }
    )


def factorize(df: DataFrame, label="label", name: str = "gidx") -> DataFrame:
    """Adds dense 0-based numbers of labels; numbers nearer than 1e-6 to a whole count as it.

    Labels are compared as text after that rounding.  The numbering joins a table of the
    distinct labels, numbered by rank cells, so no task sees all labels.
    """
    from corpusmill.functions.ranking import ranked

    text = _c(label).cast("string")
    number = F.expr(f"try_cast({label} AS DOUBLE)") if isinstance(label, str) else _c(label).cast("double")
    whole = F.round(number)
    near = number.isNotNull() & (F.abs(number - whole) < 1e-6) & ~text.rlike("^0[0-9]")
    keyed = df.withColumn("__key", F.when(near, whole.cast("bigint").cast("string")).otherwise(text))
    numbers = ranked(keyed.select("__key").distinct().withColumn("__one", F.lit(0)), ["__one"], ["__key"], name).select("__key", name)
    return keyed.join(numbers, keyed["__key"].eqNullSafe(numbers["__key"])).drop(numbers["__key"]).drop("__key")


def grpo(df: DataFrame, score="score", uid="uid", by_std: bool = True, name: str = "advantage") -> DataFrame:
    """(s - mean) / (std + 1e-6), or s - mean; a group of one has mean 0 and std 1."""
    w = _group(uid)
    s, n = _c(score), F.count(_c(score)).over(w)
    centred = s - F.when(n == 1, F.lit(0.0)).otherwise(F.avg(s).over(w))
    if not by_std:
        return df.withColumn(name, centred)
    return df.withColumn(name, centred / (F.when(n == 1, F.lit(1.0)).otherwise(F.stddev_samp(s).over(w)) + EPSILON))


def grpo_floored(df: DataFrame, score="score", uid="uid", name: str = "advantage", eps: float = 1e-6) -> DataFrame:
    """(s - mean) / (std + eps) with the variance floored at eps."""
    g = group_mean_std(df, score, uid, eps)
    return g.withColumn(name, (_c(score) - F.col("mean")) / (F.col("std") + eps)).drop("mean", "std", "n")


def grpo_passk(df: DataFrame, score="score", uid="uid", order="idx", by_std: bool = True, name: str = "advantage") -> DataFrame:
    """Only the best response of a group gets something: its lead over the second best.

    Ties go to the lower ``order``.  A group of one raises an error, as it has no second.
    """
    ranks = Window.partitionBy(uid).orderBy(_c(score).desc(), _c(order))
    s, w = _c(score), _group(uid)
    lead = s - F.lead(s).over(ranks)
    lead = lead / (F.stddev_samp(s).over(w) + EPSILON) if by_std else lead
    first = F.row_number().over(ranks) == 1
    checked = F.when(F.count(F.lit(1)).over(w) < 2, F.raise_error(F.lit("pass@k needs two responses a group"))).otherwise(F.when(first, lead).otherwise(F.lit(0.0)))
    return df.withColumn(name, checked)


def rloo(df: DataFrame, score="score", uid="uid", name: str = "advantage") -> DataFrame:
    """s minus the mean of the others; the score itself in a group of one."""
    w = _group(uid)
    s, n = _c(score), F.count(_c(score)).over(w)
    return df.withColumn(name, F.when(n > 1, (s - F.avg(s).over(w)) * n / (n - 1)).otherwise(s))


def rloo_vectorized(df: DataFrame, score="score", uid="uid", name: str = "advantage") -> DataFrame:
    """``rloo``, but 0 in a group of one."""
    w = _group(uid)
    s, n = _c(score), F.count(_c(score)).over(w)
    return df.withColumn(name, F.when(n > 1, (n * s - F.sum(s).over(w)) / (n - 1)).otherwise(F.lit(0.0)))


def opo(df: DataFrame, score="score", uid="uid", length="length", name: str = "advantage") -> DataFrame:
    """s minus the length-weighted mean of the group; baseline 0 in a group of one."""
    w = _group(uid)
    s, n = _c(score), F.count(F.lit(1)).over(w)
    weighted = F.try_divide(F.sum(s * _c(length)).over(w), F.sum(_c(length)).over(w).cast("double"))
    return df.withColumn(name, s - F.when(n > 1, weighted).otherwise(F.lit(0.0)))


def gpg(df: DataFrame, score="score", uid="uid", f_norm: float = 1.0, name: str = "advantage") -> DataFrame:
    """alpha * (s - mean) / f_norm, alpha = rows over rows with a score other than 0; mean 0 in a group of one."""
    w = _group(uid)
    s, n = _c(score), F.count(F.lit(1)).over(w)
    batch = df.agg(F.count(F.lit(1)).alias("__rows"), F.count_if(s != 0).alias("__hits"))
    alpha = F.col("__rows") / F.greatest(F.col("__hits"), F.lit(1))
    mean = F.when(n > 1, F.avg(s).over(w)).otherwise(F.lit(0.0))
    return df.withColumn("__centred", s - mean).join(F.broadcast(batch)).withColumn(name, alpha * F.col("__centred") / f_norm).drop("__rows", "__hits", "__centred")  # a one-row table


def broadcast_to_tokens(df: DataFrame, value="advantage", mask="mask", name: str = "advantages") -> DataFrame:
    """The response's value on every token that the mask keeps, 0 elsewhere."""
    return df.withColumn(name, F.transform(_c(mask), lambda m: m.cast("double") * _c(value)))


def masked_batch_stats(df: DataFrame, values: str, mask: str) -> DataFrame:
    """One row: sum of the mask, mean and unbiased variance of the kept elements of an array column."""
    kept = F.transform(F.filter(F.arrays_zip(values, mask), lambda p: p[mask] > 0), lambda p: p[values])
    flat = df.select(F.explode(kept).alias("x"))
    return flat.agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.var_samp("x").alias("var"))


def whiten(df: DataFrame, values: str, mask: str, name: str = "whitened", shift_mean: bool = True) -> DataFrame:
    """(x - mean) / sqrt(var + 1e-8) with the statistics of all kept elements of the batch.

    Masked elements are whitened too, as their value stands.  Fewer than two kept elements
    raise an error, since the variance is then undefined.
    """
    s = masked_batch_stats(df, values, mask).select(
        F.when(F.col("n") < 2, F.raise_error(F.lit("whitening needs two kept elements"))).otherwise(F.col("mean")).alias("__m"), F.sqrt(F.col("var") + 1e-8).alias("__s")
    )
    out = df.join(F.broadcast(s))  # a one-row table
    shifted = F.transform(values, lambda x: (x - F.col("__m")) / F.col("__s") + (F.lit(0.0) if shift_mean else F.col("__m")))
    return out.withColumn(name, shifted).drop("__m", "__s")


def _padded(series: pd.Series, width: int, fill: float = 0.0) -> np.ndarray:
    out = np.full((len(series), width), fill)
    for i, a in enumerate(series):
        if a is not None:
            out[i, : len(a)] = a
    return out


def _scan(columns: list[pd.Series], step, state: int) -> pd.Series:
    """Runs ``step`` from the last token to the first over a whole batch of rows at once."""
    lengths = np.array([0 if a is None else len(a) for a in columns[0]])
    width = int(lengths.max()) if len(lengths) else 0
    grids = [_padded(c, width) for c in columns]
    inside = np.arange(width)[None, :] < lengths[:, None]
    held = [np.zeros(len(lengths)) for _ in range(state)]
    out = np.zeros((len(lengths), width))
    for t in reversed(range(width)):
        value, fresh = step([g[:, t] for g in grids], held)
        ok = inside[:, t]
        held = [np.where(ok, f, h) for f, h in zip(fresh, held)]
        out[:, t] = value
    return pd.Series([None if a is None else out[i, :n] for i, (a, n) in enumerate(zip(columns[0], lengths))])


def gae_column(rewards, values, mask, gamma: float = 1.0, lam: float = 1.0) -> Column:
    """Generalised advantage estimates as an array; masked steps carry the state through.

    Null arrays give null; the arrays of a row must be equally long.
    """

    @F.pandas_udf("array<double>")
    def run(r: pd.Series, v: pd.Series, m: pd.Series) -> pd.Series:
        def step(at, held):
            reward, value, keep = at
            following, last = held
            fresh = reward + gamma * following - value + gamma * lam * last
            new_following = value * keep + (1 - keep) * following
            new_last = fresh * keep + (1 - keep) * last
            return new_last, [new_following, new_last]

        return _scan([r, v, m], step, 2)

    return run(_c(rewards), _c(values), _c(mask))


def gae(df: DataFrame, rewards: str = "reward", values: str = "value", mask: str = "mask", gamma: float = 1.0, lam: float = 1.0) -> DataFrame:
    """Adds ``advantages`` (whitened over the batch) and ``returns`` (raw advantage plus value)."""
    raw = df.withColumn("__raw", gae_column(rewards, values, mask, gamma, lam))
    out = whiten(raw, "__raw", mask, "advantages")
    return out.withColumn("returns", F.zip_with("__raw", values, lambda a, v: a + v)).drop("__raw")


def discounted_returns(rewards, mask, gamma: float = 1.0) -> Column:
    """Reverse discounted sums that start anew at masked steps."""

    @F.pandas_udf("array<double>")
    def run(r: pd.Series, m: pd.Series) -> pd.Series:
        def step(at, held):
            total = at[0] + gamma * held[0]
            return total, [total * at[1]]

        return _scan([r, m], step, 1)

    return run(_c(rewards), _c(mask))


def reinforce_plus_plus(df: DataFrame, rewards: str = "reward", mask: str = "mask", gamma: float = 1.0) -> DataFrame:
    """Adds ``returns`` and their whitened ``advantages``, masked."""
    raw = df.withColumn("returns", discounted_returns(rewards, mask, gamma))
    out = whiten(raw, "returns", mask, "advantages")
    return out.withColumn("advantages", F.zip_with("advantages", mask, lambda a, m: a * m))


def reinforce_plus_plus_baseline(df: DataFrame, score: str = "score", uid: str = "uid", mask: str = "mask") -> DataFrame:
    """Scores less the group mean (0 in a group of one) on every token, whitened over the batch and masked."""
    w = _group(uid)
    n = F.count(F.lit(1)).over(w)
    centred = df.withColumn("__c", F.col(score) - F.when(n > 1, F.avg(score).over(w)).otherwise(F.lit(0.0)))
    spread = broadcast_to_tokens(centred, "__c", mask, "__t")
    out = whiten(spread, "__t", mask, "advantages")
    return out.withColumn("advantages", F.zip_with("advantages", mask, lambda a, m: a * m)).drop("__c", "__t")


def remax(df: DataFrame, rewards: str = "reward", mask: str = "mask", baseline: str = "baseline") -> DataFrame:
    """Adds ``returns`` (sums of the kept rewards from each token on) and ``advantages`` (less the baseline, masked)."""
    kept = df.withColumn("__r", F.zip_with(rewards, mask, lambda r, m: r * m)).withColumn("__one", F.transform(mask, lambda m: F.lit(1.0)))
    out = kept.withColumn("returns", discounted_returns("__r", "__one", 1.0)).drop("__r", "__one")
    return out.withColumn("advantages", F.zip_with("returns", mask, lambda g, m: g - F.col(baseline) * m))


def token_baseline(tokens: DataFrame, zero_tail: bool = False, dense: bool = False, uid: str = "uid", seq: str = "seq", t: str = "t") -> DataFrame:
    """Adds ``returns``, ``baseline`` and ``advantage`` to long-form tokens (uid, seq, t, reward, mask, pi_square, pi[, rho]).

    The baseline at a step is the weighted mean of the returns of the group's sequences
    at that step, the weight a running sum of 1 - 2 pi + sum(pi^2) (times rho^2 where that
    column exists).  ``dense`` numbers the kept tokens of each sequence anew before it
    compares steps; ``zero_tail`` drops the baseline where a group's one longest sequence
    runs on beyond the second longest.  In a group of one the baseline is 0.
    """
    kept = tokens.filter("mask > 0") if dense else tokens
    forward = Window.partitionBy(seq).orderBy(t)
    if dense:
        kept = kept.withColumn("__t", F.row_number().over(forward) - 1)
    else:
        kept = kept.withColumn("__t", F.col(t))
    part = F.lit(1.0) - 2 * F.col("pi") + F.col("pi_square")
    if "rho" in tokens.columns:
        part = part * F.col("rho") * F.col("rho")
    m = F.col("mask").cast("double")
    sums = kept.withColumns(
        {
            "returns": F.sum(F.col("reward") * m).over(Window.partitionBy(seq).orderBy(F.col("__t").desc()).rowsBetween(Window.unboundedPreceding, 0)),
            "__w": F.sum(part * m).over(forward.rowsBetween(Window.unboundedPreceding, 0)) * m,
        }
    )
    lengths = tokens.groupBy(uid, seq).agg(F.sum(F.col("mask").cast("long")).alias("__len"))
    if dense:
        lengths = lengths.filter("__len > 0")
    sizes = lengths.groupBy(uid).agg(F.count(F.lit(1)).alias("__n"), F.max("__len").alias("__first"), F.sort_array(F.collect_list("__len"), False)[1].alias("__second"))
    here = Window.partitionBy(uid, "__t")
    base = F.coalesce(F.try_divide(F.sum(F.col("returns") * F.col("__w")).over(here), F.sum("__w").over(here) + 1e-8), F.lit(0.0))
    whole = Window.partitionBy(seq)
    tail = (F.sum(m).over(whole) == F.col("__first")) & (F.col("__second") < F.col("__first")) & (F.col("__t") >= F.col("__second"))
    base = F.when(F.col("__n") < 2, F.lit(0.0)).when(tail if zero_tail else F.lit(False), F.lit(0.0)).otherwise(base)
    return sums.join(sizes, uid).withColumn("baseline", base).withColumn("advantage", (F.col("returns") - F.col("baseline")) * m).drop("__w", "__n", "__t", "__first", "__second")


def preference_weights(df: DataFrame, score: str = "score", method: str = "pow", power: float = 2.0) -> DataFrame:
    """Adds resampling weights to responses.

    ``pow``: |score| to the power; ``max_min``: 1 for the largest and smallest score of the
    batch, else 0; ``max_random``: 0.4 for the largest, 0.1 for the rest.  All weights
    get 1e-8 on top, so that none is zero.
    """
    s = F.col(score)
    if method == "pow":
        return df.withColumn("weight", F.pow(F.abs(s), F.lit(power)) + 1e-8)
    ends = F.broadcast(df.agg(F.max(s).alias("__max"), F.min(s).alias("__min")))  # a one-row table
    joined = df.join(ends)
    if method == "max_min":
        weight = F.when((s == F.col("__max")) | (s == F.col("__min")), F.lit(1.0)).otherwise(F.lit(0.0))
    elif method == "max_random":
        weight = F.when(s == F.col("__max"), F.lit(0.4)).otherwise(F.lit(0.1))
    else:
        raise ValueError(f"unknown method {method!r}")
    return joined.withColumn("weight", weight + 1e-8).drop("__max", "__min")


def weighted_resample(df: DataFrame, draws: int, seed: int, weight: str = "weight", order: str = "idx", cells: int | None = None) -> DataFrame:
    """``draws`` rows drawn with replacement in proportion to their weight, with the number of each draw.

    Draw k looks up the k-th of ``draws`` seeded uniforms in the running sum of weights.
    The running sum goes over hash cells of the rows and then within a cell; within a cell
    rows and draws are sorted together and each draw takes the row next above it, so the
    work is one sort.  Rows of no weight (or a null one) are never drawn; ``order`` must be
    unique; without any weight there is no draw.
    """
    cells = cells or max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    names = df.columns
    placed = df.filter(F.col(weight) > 0).withColumn("__cell", F.pmod(F.xxhash64(F.col(order)), F.lit(cells)))
    totals = placed.groupBy("__cell").agg(F.sum(weight).alias("__total"))
    before = Window.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    # one row a cell
    starts = totals.select("__cell", F.coalesce(F.sum("__total").over(before), F.lit(0.0)).alias("__lo"), (F.coalesce(F.sum("__total").over(before), F.lit(0.0)) + F.col("__total")).alias("__hi"), F.sum("__total").over(Window.partitionBy()).alias("__all"))
    inner = Window.partitionBy("__cell").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    upper = placed.withColumn("__to", F.sum(weight).over(inner)).select("__cell", F.col("__to").alias("__at"), F.struct(*names).alias("__row"), F.lit(None).cast("bigint").alias("draw"))
    u = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("draw").cast("string")), 256), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    points = df.sparkSession.range(draws).withColumnRenamed("id", "draw").withColumn("__u", u)
    edges = F.broadcast(starts.agg(F.sort_array(F.collect_list(F.struct("__lo", "__hi", "__cell"))).alias("__edges"), F.max("__all").alias("__sum")))  # one row, an entry a cell
    x = F.col("__u") * F.col("__sum")
    hit = F.element_at(F.filter("__edges", lambda e: e["__lo"] <= x), -1)
    aimed = points.join(edges).filter("__sum > 0").select(hit["__cell"].alias("__cell"), (x - hit["__lo"]).alias("__at"), F.lit(None).cast(upper.schema["__row"].dataType).alias("__row"), "draw")
    # from high to low: the last row seen is the lowest one above; equal ends do not count
    down = Window.partitionBy("__cell").orderBy(F.col("__at").desc(), F.col("draw").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    top = Window.partitionBy("__cell")
    both = upper.unionByName(aimed).withColumn("__highest", F.max(F.when(F.col("draw").isNull(), F.struct("__at", "__row"))).over(top))
    taken = both.withColumn("__found", F.coalesce(F.last("__row", ignorenulls=True).over(down), F.col("__highest.__row"))).filter("draw IS NOT NULL")
    return taken.select("draw", *[F.col("__found")[n].alias(n) for n in names])
