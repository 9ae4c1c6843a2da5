"""Off-policy correction: importance weights, rejection masks, veto and diagnostics.

Rows hold arrays of log-probabilities under the trained policy (``old``) and the policy
that generated (``rollout``) and a mask.  All token work stays inside the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.losses import clamp, token_sums

#: Fixed value: log-ratios are held within this bound before they are exponentiated.
SAFETY = 20.0


def with_log_ratio(df: DataFrame, old="old_logp", rollout="rollout_logp", mask="mask", name="log_ratio") -> DataFrame:
    """Adds the array of log-ratios old - rollout."""
    return df.withColumn(name, F.zip_with(old, rollout, lambda a, b: a - b))


def _row_sum(values: Column, mask: str) -> Column:
    return F.aggregate(F.filter(F.arrays_zip(values.alias("v"), F.col(mask).alias("m")), lambda p: p["m"] > 0), F.lit(0.0), lambda acc, p: acc + p["v"])


def _kept_sum(values: str, mask: str) -> Column:
    return F.aggregate(F.zip_with(values, mask, lambda v, m: F.when(m > 0, v).otherwise(F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)


def _kept_count(mask: str) -> Column:
    return F.aggregate(mask, F.lit(0.0), lambda a, m: a + m)


def raw_weights(df: DataFrame, level: str, ratio="log_ratio", mask="mask", name="weights") -> DataFrame:
    """Adds ``weights`` (an array) and ``__metric``: the log-ratio of the level, from which metrics are taken.

    token: exp of each log-ratio; sequence: exp of their sum; geometric: exp of their mean.
    Exponents are held within +-20.
    """
    if level == "token":
        return df.withColumn("__metric", F.lit(None).cast("double")).withColumn(name, F.transform(ratio, lambda r: F.exp(clamp(r, -SAFETY, SAFETY))))
    total = _kept_sum(ratio, mask)
    if level == "geometric":
        total = total / (_kept_count(mask) + 1e-8)
    elif level != "sequence":
        raise ValueError(f"unknown level {level!r}")
    held = df.withColumn("__metric", total)
    return held.withColumn(name, F.transform(ratio, lambda r: F.exp(clamp(F.col("__metric"), -SAFETY, SAFETY))))


def importance_weights(df: DataFrame, level: str = "token", threshold: float = 2.0, normalize: bool = False, ratio="log_ratio", mask="mask", name="is_weights") -> DataFrame:
    """Adds ``is_weights``: masked, truncated at ``threshold``, and on wish divided by their batch mean.

    The mean goes over all kept tokens (token level) or over sequences (sequence level);
    a mean of about nothing leaves the weights alone.
    """
    if level not in ("token", "sequence"):
        raise ValueError(f"unknown level {level!r}")
    w = raw_weights(df, level, ratio, mask, "__w").drop("__metric")
    out = w.withColumn(name, F.zip_with("__w", mask, lambda x, m: F.least(x * m, F.lit(float(threshold))))).drop("__w")
    if not normalize:
        return out
    sums = out.select(_kept_sum(name, mask).alias("s"), _kept_count(mask).alias("n"))
    if level == "token":
        mean = F.sum("s") / (F.sum("n") + 1e-8)
    else:
        mean = F.sum(F.when(F.col("n") > 0, F.col("s") / (F.col("n") + 1e-8)).otherwise(0.0)) / F.greatest(F.sum(F.when(F.col("n") > 0, 1.0).otherwise(0.0)), F.lit(1e-8))
    factor = F.broadcast(sums.agg(mean.alias("__mean")))  # a one-row table
    return out.join(factor).withColumn(name, F.transform(name, lambda x: F.when(F.col("__mean") > 1e-8, x / F.col("__mean")).otherwise(x))).drop("__mean")


def weight_metrics(df: DataFrame, level: str, threshold: float, lower: float | None = None, ratio="log_ratio", mask="mask", prefix: str = "rollout_is_", masked_first: bool = True) -> DataFrame:
    """One row of statistics of untruncated weights: mean, max, min, std, ESS, shares and per-sequence ones.

    std and ESS use weights held within [lower, threshold]; ``masked_first`` says whether
    the weights were multiplied by the mask before (importance weights are, rejection
    weights are not).
    """
    lower = 1.0 / threshold if lower is None else lower
    w = raw_weights(df, level, ratio, mask, "__w")

    def f(p):
        x = p["__w"]
        held = clamp(x, lower, threshold)
        return {"w": x, "held": held, "square": held * held, "high": (x > threshold).cast("int"), "low": (x < lower).cast("int")}

    rows = token_sums(w, ["__w"], mask, f, ["__metric"])
    kept = F.filter(F.arrays_zip("__w", mask), lambda p: p[mask] > 0)
    ends = w.select(F.array_max(F.transform(kept, lambda p: p["__w"])).alias("top"), F.array_min(F.transform(kept, lambda p: p["__w"])).alias("bottom"))
    n = F.sum("n") + 1e-8
    mean_held = F.sum("held") / n
    seq = F.col("w") / (F.col("n") + 1e-8)
    normal = F.sum("square") / n / ((mean_held + 1e-8) * (mean_held + 1e-8))
    named = {
        "mean": F.sum("w") / n,
        "std": F.when(F.sum("n") > 1, F.sqrt(F.greatest(F.sum("square") / n - mean_held * mean_held, F.lit(0.0)))).otherwise(0.0),
        "eff_sample_size": F.try_divide(F.lit(1.0), normal),
        "seq_mean": F.avg(seq),
        "seq_std": F.coalesce(F.stddev_samp(seq), F.lit(0.0)),
        "seq_max": F.max(seq),
        "seq_min": F.min(seq),
        "seq_max_deviation": F.max(F.abs(seq - 1)),
        "seq_fraction_high": F.avg((seq > threshold).cast("double")),
        "seq_fraction_low": F.avg((seq < lower).cast("double")),
    }
    if level == "token":
        named |= {"ratio_fraction_high": F.sum("high") / n, "ratio_fraction_low": F.sum("low") / n}
        tops = ends.agg(F.max("top").alias(f"{prefix}max"), F.min("bottom").alias(f"{prefix}min"))
    else:
        m = F.col("__metric")
        named |= {
            "ratio_fraction_high": F.avg((m > F.ln(F.lit(float(threshold)))).cast("double")),
            "ratio_fraction_low": F.avg((m < F.ln(F.lit(float(lower)))).cast("double")),
        }
        tops = rows.agg(F.exp(F.least(F.max(m), F.lit(SAFETY))).alias(f"{prefix}max"), F.exp(F.min(m)).alias(f"{prefix}min"))
    return rows.agg(*[c.alias(prefix + k) for k, c in named.items()]).join(tops)


def rejection_mask(df: DataFrame, level: str = "token", upper: float = 2.0, lower: float | None = None, ratio="log_ratio", mask="mask", name="kept_mask") -> DataFrame:
    """Adds ``kept_mask``: the mask without tokens (or whole sequences) whose weight leaves [lower, upper]."""
    low = 1.0 / upper if lower is None else lower
    w = raw_weights(df, level, ratio, mask, "__w").drop("__metric")
    return w.withColumn(name, F.zip_with("__w", mask, lambda x, m: F.when((x >= low) & (x <= upper), m).otherwise(F.lit(0)))).drop("__w")


def rejection_rates(df: DataFrame, level: str = "token", upper: float = 2.0, lower: float | None = None, ratio="log_ratio", mask="mask") -> DataFrame:
    """One row: the share of tokens and of sequences that the rejection mask takes out.

    A sequence counts, at token level, when any kept token is rejected; at the others,
    when its own weight is out of bounds.
    """
    low = 1.0 / upper if lower is None else lower
    w = raw_weights(df, level, ratio, mask, "__w")
    out_of = lambda x: ~((x >= low) & (x <= upper))
    rows = token_sums(w, ["__w"], mask, lambda p: {"bad": out_of(p["__w"]).cast("int")}, ["__metric"])
    whole = (F.col("bad") > 0) if level == "token" else out_of(F.exp(clamp(F.col("__metric"), -SAFETY, SAFETY)))
    return rows.agg((F.sum("bad") / (F.sum("n") + 1e-8)).alias("rollout_rs_masked_fraction"), F.avg(whole.cast("double")).alias("rollout_rs_seq_masked_fraction"))


def veto(df: DataFrame, threshold: float, ratio="log_ratio", mask="mask", name="kept_mask") -> DataFrame:
    """Adds ``vetoed`` and clears ``kept_mask`` of sequences with a kept token whose ratio is below ``threshold``."""
    if threshold <= 0:
        raise ValueError("the veto threshold must be positive")
    bad = F.exists(F.arrays_zip(ratio, mask), lambda p: (p[mask] > 0) & (p[ratio] < F.ln(F.lit(float(threshold)))))
    base = name if name in df.columns else mask
    return df.withColumn("vetoed", bad).withColumn(name, F.transform(base, lambda m: F.when(F.col("vetoed"), F.lit(0)).otherwise(m)))


def veto_rates(df: DataFrame, threshold: float, ratio="log_ratio", mask="mask") -> DataFrame:
    """One row: the shares of vetoed sequences and of tokens below the threshold."""
    bar = F.ln(F.lit(float(threshold)))
    rows = token_sums(df, [ratio], mask, lambda p: {"bad": (p[ratio] < bar).cast("int")})
    return rows.agg(F.avg((F.col("bad") > 0).cast("double")).alias("rollout_is_veto_fraction"), (F.sum("bad") / (F.sum("n") + 1e-8)).alias("rollout_is_catastrophic_token_fraction"))


def offpolicy_metrics(df: DataFrame, old="old_logp", rollout="rollout_logp", mask="mask", prefix: str = "") -> DataFrame:
    """One row: KL estimates, perplexities of both policies, their ratio, and chi-squared distances."""

    def f(p):
        d = p[old] - p[rollout]
        held = clamp(d, -SAFETY, SAFETY)
        return {"old": p[old], "roll": p[rollout], "k3": F.exp(d) - d - 1, "square": F.exp(held) * F.exp(held)}

    rows = token_sums(df, [old, rollout], mask, f)
    n = F.col("n") + 1e-8
    a, b = F.col("old") / n, F.col("roll") / n
    total = F.sum("n") + 1e-8
    seq = clamp(F.col("old") - F.col("roll"), -SAFETY, SAFETY)
    named = {
        "training_ppl": F.avg(F.exp(-a)),
        "training_log_ppl": F.avg(-a),
        "kl": (F.sum("roll") - F.sum("old")) / total,
        "k3_kl": F.sum("k3") / total,
        "rollout_ppl": F.avg(F.exp(-b)),
        "rollout_log_ppl": F.avg(-b),
        "log_ppl_diff": F.avg(b - a),
        "log_ppl_abs_diff": F.avg(F.abs(b - a)),
        "log_ppl_diff_max": F.max(b - a),
        "log_ppl_diff_min": F.min(b - a),
        "ppl_ratio": F.avg(F.exp(b - a)),
        "chi2_token": F.sum("square") / total - 1,
        "chi2_seq": F.avg(F.exp(2 * seq)) - 1,
    }
    return rows.agg(*[c.alias(prefix + k) for k, c in named.items()])


def correct(df: DataFrame, weights: str | None = "token", threshold: float = 2.0, reject: str | None = None, reject_upper: float = 2.0, veto_below: float | None = None, normalize: bool = False, old="old_logp", rollout="rollout_logp", mask="mask") -> DataFrame:
    """The batch with ``is_weights`` (on wish) and ``kept_mask``: rejection, then veto; weights never change by them."""
    out = with_log_ratio(df, old, rollout, mask)
    if weights:
        out = importance_weights(out, weights, threshold, normalize, mask=mask)
    out = rejection_mask(out, reject, reject_upper, mask=mask) if reject else out.withColumn("kept_mask", F.col(mask))
    return veto(out, veto_below, mask=mask) if veto_below else out


def bypass(df: DataFrame, old="old_logp", rollout="rollout_logp") -> DataFrame:
    """The batch with the generator's log-probabilities standing in for the trained policy's."""
    return df.withColumn(old, F.col(rollout))


def overlong_penalty(length: Column, max_length: int, buffer: int, factor: float) -> Column:
    """What a response beyond max_length - buffer loses: 0 down to -factor and further at the end."""
    return F.least(-(length - (max_length - buffer)) / F.lit(float(buffer)) * factor, F.lit(0.0))
