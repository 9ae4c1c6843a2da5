"""Policy and value losses as evaluated scalars over stored log-probabilities.

Every loss is a formula on the tokens of a response; a response is one row of arrays.  The
formulas run inside the row (no shuffle), each row yields a few sums, and one small
aggregation makes the batch's scalars.  Masked elements are skipped before they are used,
so they may hold anything.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOSSES: dict[str, Callable[..., DataFrame]] = {}


def register_policy_loss(name: str):
    """Decorator that makes a loss known under ``name``."""

    def wrap(fn):
        LOSSES[name] = fn
        return fn

    return wrap


def policy_loss(name: str) -> Callable[..., DataFrame]:
    """The registered loss of this name; an error lists the known ones."""
    if name not in LOSSES:
        raise ValueError(f"unknown policy loss {name!r}; known: {sorted(LOSSES)}")
    return LOSSES[name]


def clamp(x, low=None, high=None) -> Column:
    """x held between two bounds, either of which may be missing."""
    if low is not None:
        x = F.greatest(x, low if isinstance(low, Column) else F.lit(float(low)))
    return F.least(x, high if isinstance(high, Column) else F.lit(float(high))) if high is not None else x


def token_sums(df: DataFrame, arrays: list[str], mask: str, formulas: Callable[..., dict[str, Column]], keep: list[str] = ()) -> DataFrame:
    """Per row: the sum over kept tokens of each formula, and ``n``, the number of kept tokens.

    ``formulas`` gets the token's values by array name.
    """
    kept = F.filter(F.arrays_zip(*arrays, mask), lambda p: p[mask] > 0)
    parts = F.transform(kept, lambda p: F.struct(*[v.cast("double").alias(k) for k, v in formulas({a: p[a].cast("double") for a in arrays}).items()]))
    out = df.select(*keep, kept.alias("__kept"), parts.alias("__parts"))
    names = list(formulas({a: F.lit(0.0) for a in arrays}))
    def total(name: str) -> Column:
        return F.aggregate(F.col("__parts"), F.lit(0.0), lambda acc, p: acc + p[name])

    sums = [total(n).alias(n) for n in names]
    return out.select(*keep, F.size("__kept").cast("double").alias("n"), *sums)


def aggregated(rows: DataFrame, mode: str, loss: str = "loss", width: float | None = None) -> Column:
    """The batch loss from per-row sums (``loss`` and ``n``) as an aggregate expression.

    token-mean; seq-mean-token-sum and seq-mean-token-mean over rows with a kept token;
    seq-mean-token-sum-norm divides the total by ``width``.
    """
    some = F.col("n") > 0
    if mode == "token-mean":
        return F.try_divide(F.sum(loss), F.sum("n"))
    if mode == "seq-mean-token-sum":
        return F.avg(F.when(some, F.col(loss)))
    if mode == "seq-mean-token-mean":
        return F.avg(F.when(some, F.col(loss) / (F.col("n") + 1e-8)))
    if mode == "seq-mean-token-sum-norm":
        if not width:
            raise ValueError("seq-mean-token-sum-norm needs the width")
        return F.sum(loss) / F.lit(float(width))
    raise ValueError(f"unknown aggregation {mode!r}")


def masked_mean(name: str) -> Column:
    """Mean over all kept tokens of the batch, from per-row sums."""
    return F.try_divide(F.sum(name), F.sum("n") + 1e-8)


def agg_loss(df: DataFrame, loss: str, mask: str, mode: str = "token-mean", width: float | None = None) -> DataFrame:
    """One row with ``loss``: an array column of losses aggregated in the given mode."""
    rows = token_sums(df, [loss], mask, lambda p: {"loss": p[loss]})
    return rows.agg(aggregated(rows, mode, width=width).alias("loss"))


def _finish(rows: DataFrame, mode: str, width=None, **extra: Column) -> DataFrame:
    return rows.agg(aggregated(rows, mode, width=width).alias("pg_loss"), *[c.alias(k) for k, c in extra.items()])


def _weighted(loss: Column, p: dict[str, Column], weights: str | None) -> Column:
    return loss * p[weights] if weights else loss


def _arrays(weights: str | None, *names: str) -> list[str]:
    return [*names, weights] if weights else list(names)


@register_policy_loss("vanilla")
def ppo(df: DataFrame, old="old_logp", new="logp", adv="advantages", mask="mask", low=0.2, high=0.2, dual=3.0, mode="token-mean", weights: str | None = None, width=None) -> DataFrame:
    """Clipped policy loss with a second bound for negative advantages: pg_loss, pg_clipfrac, ppo_kl, pg_clipfrac_lower."""
    if dual <= 1:
        raise ValueError("the dual bound must exceed 1")

    def f(p):
        kl = clamp(p[new] - p[old], -20, 20)
        ratio = F.exp(kl)
        free, clipped = -p[adv] * ratio, -p[adv] * clamp(ratio, 1 - low, 1 + high)
        worse = F.greatest(free, clipped)
        third = -p[adv] * dual
        loss = F.when(p[adv] < 0, F.least(third, worse)).otherwise(worse)
        return {"loss": _weighted(loss, p, weights), "kl": -kl, "clip": (clipped > free).cast("int"), "lower": ((worse > third) & (p[adv] < 0)).cast("int")}

    rows = token_sums(df, _arrays(weights, old, new, adv), mask, f)
    return _finish(rows, mode, width, pg_clipfrac=masked_mean("clip"), ppo_kl=masked_mean("kl"), pg_clipfrac_lower=masked_mean("lower"))


def _with_sequence(df: DataFrame, name: str, arrays: list[str], mask: str, term: Callable, floor_one: bool) -> DataFrame:
    """Adds the mean over a row's kept tokens of ``term`` as column ``name``."""
    kept = F.filter(F.arrays_zip(*arrays, mask), lambda p: p[mask] > 0)
    total = F.aggregate(kept, F.lit(0.0), lambda acc, p: acc + term({a: p[a].cast("double") for a in arrays}))
    n = F.size(kept).cast("double")
    return df.withColumn(name, total / (F.greatest(n, F.lit(1.0)) if floor_one else n + 1e-8))


@register_policy_loss("gspo")
def gspo(df: DataFrame, old="old_logp", new="logp", adv="advantages", mask="mask", low=0.2, high=0.2, weights: str | None = None) -> DataFrame:
    """Loss with one ratio a sequence (mean log-ratio, at most 10), averaged per sequence first."""
    seq = _with_sequence(df, "__s", [old, new], mask, lambda p: p[new] - p[old], True)
    ratio = F.exp(F.least(F.col("__s"), F.lit(10.0)))
    wide = seq.withColumn("__ratio", F.transform(mask, lambda m: ratio))

    def f(p):
        free, clipped = -p[adv] * p["__ratio"], -p[adv] * clamp(p["__ratio"], 1 - low, 1 + high)
        return {"loss": _weighted(F.greatest(free, clipped), p, weights), "kl": p[old] - p[new], "clip": (clipped > free).cast("int")}

    rows = token_sums(wide, _arrays(weights, old, new, adv, "__ratio"), mask, f)
    return _finish(rows, "seq-mean-token-mean", pg_clipfrac=masked_mean("clip"), ppo_kl=masked_mean("kl"), pg_clipfrac_lower=F.max(F.lit(0.0)))


@register_policy_loss("sapo")
def sapo(df: DataFrame, old="old_logp", new="logp", adv="advantages", mask="mask", tau_pos=1.0, tau_neg=1.05, weights: str | None = None) -> DataFrame:
    """Loss with a smooth gate 4/tau * sigmoid(tau * (ratio - 1)), tau by the sign of the advantage."""

    def f(p):
        kl = clamp(p[new] - p[old], -20, 20)
        tau = F.when(p[adv] > 0, F.lit(float(tau_pos))).otherwise(F.lit(float(tau_neg)))
        gate = 1 / (1 + F.exp(-tau * (F.exp(kl) - 1))) * (4 / tau)
        return {"loss": _weighted(-gate * p[adv], p, weights), "kl": -kl}

    rows = token_sums(df, _arrays(weights, old, new, adv), mask, f)
    return _finish(rows, "seq-mean-token-mean", ppo_kl=masked_mean("kl"))


@register_policy_loss("gpg")
def gpg_loss(df: DataFrame, new="logp", adv="advantages", mask="mask", mode="token-mean", weights: str | None = None, width=None) -> DataFrame:
    """-log-probability times advantage."""
    rows = token_sums(df, _arrays(weights, new, adv), mask, lambda p: {"loss": _weighted(-p[new] * p[adv], p, weights)})
    return _finish(rows, mode, width)


@register_policy_loss("cispo")
def cispo(df: DataFrame, old="old_logp", new="logp", adv="advantages", mask="mask", low=0.2, high=0.2, mode="token-mean", weights: str | None = None, width=None) -> DataFrame:
    """-clipped ratio * advantage * log-probability; pg_clipfrac counts ratios that were clipped."""

    def f(p):
        kl = clamp(p[new] - p[old], -20, 20)
        ratio = F.exp(kl)
        clipped = clamp(ratio, 1 - low, 1 + high)
        return {"loss": _weighted(-clipped * p[adv] * p[new], p, weights), "kl": -kl, "clip": (ratio != clipped).cast("int")}

    rows = token_sums(df, _arrays(weights, old, new, adv), mask, f)
    return _finish(rows, mode, width, pg_clipfrac=masked_mean("clip"), ppo_kl=masked_mean("kl"))


@register_policy_loss("geo_mean")
def gmpo(df: DataFrame, old="old_logp", new="logp", adv="advantages", mask="mask", low=0.2, high=0.2) -> DataFrame:
    """Loss with the geometric mean of clipped token ratios, one value a sequence, mean over sequences."""

    def f(p):
        kl, sign = p[new] - p[old], F.signum(p[adv])
        held = clamp(kl, -low, high)
        least = sign * F.least(sign * kl, sign * held)
        return {"least": least, "adv": p[adv], "kl": -kl, "clip": ((kl != held) & (p[adv] > 0)).cast("int"), "lower": ((kl != held) & (p[adv] < 0)).cast("int")}

    rows = token_sums(df, [old, new, adv], mask, f)
    n = F.col("n") + 1e-8
    return rows.agg(
        F.avg(-(F.col("adv") / n) * F.exp(F.col("least") / n)).alias("pg_loss"),
        masked_mean("clip").alias("pg_clipfrac"),
        masked_mean("kl").alias("ppo_kl"),
        masked_mean("lower").alias("pg_clipfrac_lower"),
    )


@register_policy_loss("reinforce")
def reinforce(df: DataFrame, new="logp", adv="advantages", mask="mask", mode="token-mean", weights: str | None = None, width=None) -> DataFrame:
    """-advantage * log-probability, times importance weights where given."""
    return gpg_loss(df, new, adv, mask, mode, weights, width)


def exploded(df: DataFrame, arrays: list[str], mask: str, keep: list[str]) -> DataFrame:
    """Kept tokens in long form: the key columns, t and one column an array."""
    z = F.arrays_zip(*arrays, mask)
    return df.select(*keep, F.posexplode(z).alias("t", "p")).filter(F.col("p")[mask] > 0).select(*keep, "t", *[F.col("p")[a].cast("double").alias(a) for a in arrays])


def _covariance(df, old, new, adv, mask, seq) -> tuple[DataFrame, int]:
    """The kept tokens with their part of the covariance, and their number.

    Means and number come from one pass over the arrays and are constants of the plan.
    """
    long = exploded(df, [old, new, adv], mask, [seq])
    m = long.agg(F.avg(adv).alias("a"), F.avg(new).alias("b"), F.count(F.lit(1)).alias("n")).first()
    return long.withColumn("cov", (F.col(adv) - F.lit(m["a"])) * (F.col(new) - F.lit(m["b"]))), m["n"]


def _top(df: DataFrame, k: int, order: list[Column]) -> DataFrame:
    """The k first rows: a top-k per partition and a merge, never a global sort."""
    return df.orderBy(*order).limit(k)


@register_policy_loss("kl_cov")
def kl_cov(df: DataFrame, old="old_logp", new="logp", adv="advantages", mask="mask", ratio_of=0.0002, coef=1.0, seq="seq", mode="token-mean") -> DataFrame:
    """Loss whose tokens of the largest covariance of advantage and log-probability get an |log-ratio| penalty.

    The share ``ratio_of`` of the kept tokens (one at least) is chosen, ties by sequence
    and place.
    """
    long, n = _covariance(df, old, new, adv, mask, seq)
    k = max(1, int(n * ratio_of)) if n else 0
    chosen = _top(long.select(seq, "t", "cov"), k, [F.col("cov").desc(), F.col(seq), F.col("t")]).select(seq, "t").withColumn("__hit", F.lit(1))
    kl = F.col(new) - F.col(old)
    loss = -F.col(adv) * F.exp(kl) + F.when(F.col("__hit") == 1, coef * F.abs(kl)).otherwise(0.0)
    rows = long.join(chosen, [seq, "t"], "left").withColumns({"__loss": loss, "__kl": F.abs(kl)}).groupBy(seq).agg(F.sum("__loss").alias("loss"), F.sum("__kl").alias("kl"), F.count(F.lit(1)).cast("double").alias("n"))
    return _finish(rows, mode, ppo_kl=masked_mean("kl"))


@register_policy_loss("clip_cov")
def clip_cov(df: DataFrame, old="old_logp", new="logp", adv="advantages", mask="mask", ratio_of=0.0002, low=0.2, high=0.2, cov_low=1.0, cov_high=5.0, seed=0, seq="seq", mode="token-mean") -> DataFrame:
    """Clipped loss in which a few tokens of middling covariance count nothing.

    Among the tokens with a covariance in (cov_low, cov_high) that the clip leaves alone,
    the share ``ratio_of`` of all kept tokens is taken by a seeded hash, so the choice is
    the same in every run.
    """
    long, n = _covariance(df, old, new, adv, mask, seq)
    ratio = F.exp(F.col(new) - F.col(old))
    free, clipped = -F.col(adv) * ratio, -F.col(adv) * clamp(ratio, 1 - low, 1 + high)
    band = long.withColumns({"__free": free, "__clipped": clipped}).filter(~(F.col("__clipped") > F.col("__free"))).filter((F.col("cov") > cov_low) & (F.col("cov") < cov_high))
    k = max(1, int(n * ratio_of))
    chosen = _top(band.select(seq, "t"), k, [F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(seq).cast("string"), F.col("t").cast("string")), 256), F.col(seq), F.col("t")]).withColumn("__hit", F.lit(1))
    loss = F.when(F.col("__hit") == 1, F.lit(0.0)).otherwise(F.greatest(free, clipped))
    rows = (
        long.join(chosen, [seq, "t"], "left")
        .withColumns({"__loss": loss, "__kl": F.col(old) - F.col(new), "__c": F.coalesce("__hit", F.lit(0))})
        .groupBy(seq)
        .agg(F.sum("__loss").alias("loss"), F.sum("__kl").alias("kl"), F.sum("__c").cast("double").alias("clip"), F.count(F.lit(1)).cast("double").alias("n"))
    )
    return _finish(rows, mode, pg_clipfrac=masked_mean("clip"), ppo_kl=masked_mean("kl"))


def value_loss(df: DataFrame, predicted="vpred", returns="returns", values="value", mask="mask", clip=0.5, mode="token-mean", width=None) -> DataFrame:
    """Half the larger of the squared errors of the prediction and of the prediction clipped near the old value: vf_loss, vf_clipfrac."""

    def f(p):
        near = clamp(p[predicted], p[values] - clip, p[values] + clip)
        a, b = (p[predicted] - p[returns]) * (p[predicted] - p[returns]), (near - p[returns]) * (near - p[returns])
        return {"loss": F.greatest(a, b), "clip": (b > a).cast("int")}

    rows = token_sums(df, [predicted, returns, values], mask, f)
    return rows.agg((0.5 * aggregated(rows, mode, width=width)).alias("vf_loss"), masked_mean("clip").alias("vf_clipfrac"))


def kl_estimate(logp: Column, ref: Column, kind: str) -> Column:
    """Divergence of one token: kl/k1, abs, mse/k2, low_var_kl/k3; a trailing + has the same value."""
    base = kind.rstrip("+")
    d = logp - ref
    if base in ("kl", "k1"):
        return d
    if base == "abs":
        return F.abs(d)
    if base in ("mse", "k2"):
        return 0.5 * d * d
    if base in ("low_var_kl", "k3"):
        back = clamp(-d, -20, 20)
        return clamp(F.exp(back) - back - 1, -10, 10)
    raise NotImplementedError(f"no divergence estimate {kind!r} from log-probabilities alone")


def apply_kl_penalty(df: DataFrame, scores="score", logp="logp", ref="ref_logp", mask="mask", beta: float = 0.1, kind: str = "kl") -> DataFrame:
    """Adds ``token_rewards``: scores less beta times the masked divergence of each token."""
    z = F.arrays_zip(scores, logp, ref, mask)
    return df.withColumn("token_rewards", F.transform(z, lambda p: p[scores] - beta * F.when(p[mask] > 0, kl_estimate(p[logp].cast("double"), p[ref].cast("double"), kind)).otherwise(0.0)))


def compute_rewards(score: Column, logp: Column, ref: Column, ratio: float) -> Column:
    """score - (logp - ref) * ratio of one token."""
    return score - (logp - ref) * ratio


def kl_controller(steps: DataFrame, start: float, target: float, horizon: float, order="step", kl="kl", n="n_steps") -> DataFrame:
    """(step, value): the adaptive coefficient after each step, a running product over steps.

    value *= 1 + clip(kl / target - 1, -0.2, 0.2) * n / horizon.  The steps of one run form
    one ordered sequence, one row a training step.
    """
    factor = 1 + clamp(F.col(kl) / target - 1, -0.2, 0.2) * F.col(n) / horizon
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return steps.select(order, (F.lit(float(start)) * F.exp(F.sum(F.ln(factor)).over(w))).alias("value"))


def fixed_controller(steps: DataFrame, start: float, order="step") -> DataFrame:
    """(step, value): the coefficient that never changes."""
    return steps.select(order, F.lit(float(start)).alias("value"))


def sft_loss(df: DataFrame, logp="logp", mask="mask", shifted: bool = True) -> DataFrame:
    """One row with the mean negative log-probability; ``shifted`` moves the mask one token to the left first."""
    moved = df.withColumn("__mask", F.concat(F.slice(mask, 2, F.greatest(F.size(mask) - 1, F.lit(0))), F.slice(mask, 1, 1))) if shifted else df.withColumn("__mask", F.col(mask))
    rows = token_sums(moved, [logp], "__mask", lambda p: {"loss": -p[logp]})
    return rows.agg(aggregated(rows, "token-mean").alias("loss"))


def ppo_total(df: DataFrame, entropy="entropy", ref="ref_logp", entropy_coef=0.01, kl_coef=0.001, kl_kind="k3", mode="token-mean", **options) -> DataFrame:
    """Policy loss less the entropy bonus plus the divergence loss: the parts and ``loss``."""
    mask, logp = options.get("mask", "mask"), options.get("new", "logp")
    parts = token_sums(df, [entropy, logp, ref], mask, lambda p: {"loss": p[entropy], "kl": kl_estimate(p[logp], p[ref], kl_kind)})
    extra = parts.agg(aggregated(parts, mode).alias("entropy"), aggregated(parts, mode, "kl").alias("kl_loss"))
    return ppo(df, mode=mode, **options).join(extra).withColumn("loss", F.col("pg_loss") - entropy_coef * F.col("entropy") + kl_coef * F.col("kl_loss"))


def response_slice(values, prompt_length, response_length) -> Column:
    """The values that predict the response: one place before it, as long as it."""
    return F.slice(values, F.greatest(prompt_length, F.lit(1)), response_length)


def entropy_of_logits(logits) -> Column:
    """Entropy of softmax(logits): logsumexp - sum(p * logit); null for an empty array."""
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    z = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    dot = F.aggregate(F.zip_with(e, logits, lambda p, x: p * x), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(logits) > 0, F.ln(z) + top - dot / z)


def logprob_of(logits, index) -> Column:
    """log softmax(logits)[index], index from 0."""
    top = F.array_max(logits)
    z = F.aggregate(F.transform(logits, lambda x: F.exp(x - top)), F.lit(0.0), lambda a, x: a + x)
    return F.get(logits, index) - top - F.ln(z)


def sum_pi_squared(logits) -> Column:
    """Sum of squared probabilities of softmax(logits)."""
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    z = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.aggregate(e, F.lit(0.0), lambda a, x: a + x * x) / (z * z)


def top_k_filter(logits, k: int) -> Column:
    """Logits below the k-th largest become minus infinity (ties with it stay)."""
    bar = F.element_at(F.sort_array(logits, False), F.least(F.lit(k), F.size(logits)))
    return F.transform(logits, lambda x: F.when(x < bar, F.lit(float("-inf"))).otherwise(x))


def top_p_filter(logits, p: float) -> Column:
    """The smallest set of largest logits whose probability reaches p stays, the rest become minus infinity."""
    ordered = F.sort_array(logits, False)
    top = F.array_max(logits)
    z = F.aggregate(F.transform(logits, lambda x: F.exp(x - top)), F.lit(0.0), lambda a, x: a + x)
    state = F.struct(F.lit(0.0).alias("sum"), F.lit(float("inf")).alias("bar"))
    bar = F.aggregate(ordered, state, lambda a, x: F.when(a["sum"] < p, F.struct((a["sum"] + F.exp(x - top) / z).alias("sum"), x.alias("bar"))).otherwise(a))["bar"]
    return F.transform(logits, lambda x: F.when(x < bar, F.lit(float("-inf"))).otherwise(x))
