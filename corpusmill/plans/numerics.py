"""Queries of advantages, losses and off-policy correction."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import advantages as A
from corpusmill.operators import correction as C
from corpusmill.operators import losses as L
from corpusmill.plans.registry import REGISTRY as R
from corpusmill.plans.views import ROLLOUTS, TOKENS, long_tokens, r6, rollouts, rounded, tokens


def _group_sql(expr: str, extra: str = "") -> str:
    return f"""WITH {ROLLOUTS}, g AS (
  SELECT idx, uid, score, length, count(*) OVER w AS n, avg(score) OVER w AS mean, stddev_samp(score) OVER w AS std, var_samp(score) OVER w AS var,
         sum(score) OVER w AS total, sum(score * length) OVER w AS weighted, sum(length) OVER w AS len{extra}
  FROM rollouts WINDOW w AS (PARTITION BY uid))
SELECT idx, uid, round({expr}, 8) + 0.0 AS advantage FROM g"""


def _advantage(df):
    # eight decimals: means of few two-decimal scores can end in a tie at the sixth
    return df.select("idx", "uid", (F.round("advantage", 8) + 0.0).alias("advantage"))


@R.add("w2_grpo", _group_sql("(score - CASE WHEN n = 1 THEN 0 ELSE mean END) / (CASE WHEN n = 1 THEN 1 ELSE std END + 1e-6)"))
def w2_grpo(spark, sf):
    return _advantage(A.grpo(rollouts(spark, sf)))


@R.add("w2_grpo_mean_only", _group_sql("score - CASE WHEN n = 1 THEN 0 ELSE mean END"))
def w2_grpo_mean_only(spark, sf):
    return _advantage(A.grpo(rollouts(spark, sf), by_std=False))


@R.add("w3_grpo_floored", _group_sql("(score - CASE WHEN n = 1 THEN 0 ELSE mean END) / (CASE WHEN n = 1 THEN 1 ELSE sqrt(greatest(var, 1e-6)) END + 1e-6)"))
def w3_grpo_floored(spark, sf):
    return _advantage(A.grpo_floored(rollouts(spark, sf)))


@R.add(
    "w4_grpo_passk",
    f"""WITH {ROLLOUTS}, big AS (SELECT * FROM rollouts QUALIFY count(*) OVER (PARTITION BY uid) > 1),
g AS (SELECT idx, uid, score, row_number() OVER o AS r, lead(score) OVER o AS second, stddev_samp(score) OVER (PARTITION BY uid) AS std
      FROM big WINDOW o AS (PARTITION BY uid ORDER BY score DESC, idx))
SELECT idx, uid, round(CASE WHEN r = 1 THEN (score - second) / (std + 1e-6) ELSE 0.0 END, 8) + 0.0 AS advantage FROM g""",
)
def w4_grpo_passk(spark, sf):
    from pyspark.sql import Window

    big = rollouts(spark, sf).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("uid"))).filter("n > 1")
    return _advantage(A.grpo_passk(big))


@R.add("w6_rloo", _group_sql("CASE WHEN n > 1 THEN (score - mean) * n / (n - 1) ELSE score END"))
def w6_rloo(spark, sf):
    return _advantage(A.rloo(rollouts(spark, sf)))


@R.add("w7_rloo_vectorized", _group_sql("CASE WHEN n > 1 THEN (n * score - total) / (n - 1) ELSE 0.0 END"))
def w7_rloo_vectorized(spark, sf):
    return _advantage(A.rloo_vectorized(rollouts(spark, sf)))


@R.add("w8_opo", _group_sql("score - CASE WHEN n > 1 THEN weighted / len ELSE 0 END"))
def w8_opo(spark, sf):
    return _advantage(A.opo(rollouts(spark, sf)))


@R.add("w11_gpg", _group_sql("(SELECT count(*) / greatest(count(*) FILTER (score <> 0), 1) FROM rollouts) * (score - CASE WHEN n > 1 THEN mean ELSE 0 END) / 2.0"))
def w11_gpg(spark, sf):
    return _advantage(A.gpg(rollouts(spark, sf), f_norm=2.0))


@R.add(
    "a2_group_mean_std",
    f"""WITH {ROLLOUTS} SELECT idx, uid, count(score) OVER w AS n, round(CASE WHEN count(score) OVER w = 1 THEN 0 ELSE avg(score) OVER w END, 6) + 0.0 AS mean,
  round(CASE WHEN count(score) OVER w = 1 THEN 1 ELSE sqrt(greatest(var_samp(score) OVER w, 1e-6)) END, 6) + 0.0 AS std
FROM rollouts WINDOW w AS (PARTITION BY uid)""",
)
def a2_group_mean_std(spark, sf):
    return rounded(A.group_mean_std(rollouts(spark, sf)).select("idx", "uid", "n", "mean", "std"))


@R.add("a3_factorize", None)
def a3_factorize(spark, sf):
    """Dense group numbers; their order follows a hash, so only the grouping is comparable (tested so)."""
    return A.factorize(rollouts(spark, sf), "uid").select("idx", "uid", "gidx")


@R.add("a3_factorize_groups", f"WITH {ROLLOUTS} SELECT count(DISTINCT uid) AS labels, count(DISTINCT uid) - 1 AS last, count(*) AS n FROM rollouts")
def a3_factorize_groups(spark, sf):
    return A.factorize(rollouts(spark, sf), "uid").agg(F.count_distinct("uid", "gidx").alias("labels"), F.max("gidx").alias("last"), F.count(F.lit(1)).alias("n"))


def _long(df, *names):
    """Array columns of sequences as rounded long rows."""
    return df.select("seq", F.posexplode(F.arrays_zip(*names)).alias("t", "p")).select("seq", F.col("t").cast("bigint").alias("t"), *[r6(F.col("p")[n]).alias(n) for n in names])


@R.add(
    "w1_gae",
    f"""WITH RECURSIVE {TOKENS}, scan AS (
  SELECT seq, 64 AS t, CAST(0 AS DOUBLE) AS following, CAST(0 AS DOUBLE) AS last FROM (SELECT DISTINCT seq FROM tokens)
  UNION ALL
  SELECT s.seq, k.t, CASE WHEN k.mask = 1 THEN k.y ELSE s.following END, CASE WHEN k.mask = 1 THEN k.x + 0.99 * s.following - k.y + 0.99 * 0.95 * s.last ELSE s.last END
  FROM scan s JOIN tokens k ON k.seq = s.seq AND k.t = s.t - 1),
raw AS (SELECT k.seq, k.t, k.mask, k.y, s.last FROM tokens k JOIN scan s ON s.seq = k.seq AND s.t = k.t),
stat AS (SELECT avg(last) AS mean, var_samp(last) AS var FROM raw WHERE mask = 1)
SELECT seq, t, round((last - mean) / sqrt(var + 1e-8), 6) + 0.0 AS advantages, round(last + y, 6) + 0.0 AS returns FROM raw, stat""",
)
def w1_gae(spark, sf):
    rows = tokens(spark, sf).select("seq", F.col("x").alias("reward"), F.col("y").alias("value"), "mask")
    return _long(A.gae(rows, gamma=0.99, lam=0.95), "advantages", "returns")


@R.add(
    "w9_reinforce_plus_plus",
    f"""WITH RECURSIVE {TOKENS}, scan AS (
  SELECT seq, 64 AS t, CAST(0 AS DOUBLE) AS run, CAST(0 AS DOUBLE) AS g FROM (SELECT DISTINCT seq FROM tokens)
  UNION ALL
  SELECT s.seq, k.t, (k.x + 0.9 * s.run) * k.mask, k.x + 0.9 * s.run FROM scan s JOIN tokens k ON k.seq = s.seq AND k.t = s.t - 1),
raw AS (SELECT k.seq, k.t, k.mask, s.g FROM tokens k JOIN scan s ON s.seq = k.seq AND s.t = k.t),
stat AS (SELECT avg(g) AS mean, var_samp(g) AS var FROM raw WHERE mask = 1)
SELECT seq, t, round((g - mean) / sqrt(var + 1e-8) * mask, 6) + 0.0 AS advantages, round(g, 6) + 0.0 AS returns FROM raw, stat""",
)
def w9_reinforce_plus_plus(spark, sf):
    return _long(A.reinforce_plus_plus(tokens(spark, sf).select("seq", F.col("x").alias("reward"), "mask"), gamma=0.9), "advantages", "returns")


@R.add(
    "w5_reinforce_baseline",
    f"""WITH {TOKENS}, s AS (SELECT seq, uid, sum(x) AS score FROM tokens GROUP BY seq, uid),
c AS (SELECT seq, score - CASE WHEN count(*) OVER w > 1 THEN avg(score) OVER w ELSE 0 END AS c FROM s WINDOW w AS (PARTITION BY uid)),
k AS (SELECT t.seq, t.t, t.mask, c.c * t.mask AS v FROM tokens t JOIN c ON c.seq = t.seq),
stat AS (SELECT avg(v) AS mean, var_samp(v) AS var FROM k WHERE mask = 1)
SELECT seq, t, round((v - mean) / sqrt(var + 1e-8) * mask, 6) + 0.0 AS advantages FROM k, stat""",
)
def w5_reinforce_baseline(spark, sf):
    rows = tokens(spark, sf).withColumn("score", F.aggregate("x", F.lit(0.0), lambda a, v: a + v))
    return _long(A.reinforce_plus_plus_baseline(rows.select("seq", "uid", "score", "mask")), "advantages")


@R.add(
    "w10_remax",
    f"""WITH {TOKENS}, b AS (SELECT seq, max(x) AS baseline FROM tokens GROUP BY seq),
g AS (SELECT k.seq, k.t, k.mask, b.baseline, sum(k.x * k.mask) OVER (PARTITION BY k.seq ORDER BY k.t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS g FROM tokens k JOIN b ON b.seq = k.seq)
SELECT seq, t, round(g - baseline * mask, 6) + 0.0 AS advantages, round(g, 6) + 0.0 AS returns FROM g""",
)
def w10_remax(spark, sf):
    rows = tokens(spark, sf).select("seq", F.col("x").alias("reward"), "mask", F.array_max("x").alias("baseline"))
    return _long(A.remax(rows), "advantages", "returns")


_OTB = """, w AS (SELECT seq, uid, t, mask, sum(x * mask) OVER (PARTITION BY seq ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS g,
  mask * sum((1 - 2 * exp(old_logp) + 0.5) * mask) OVER (PARTITION BY seq ORDER BY t ROWS UNBOUNDED PRECEDING) AS w FROM {source}),
len AS (SELECT uid, seq, sum(mask) AS len FROM tokens GROUP BY uid, seq{having}),
size AS (SELECT uid, count(*) AS n, max(len) AS first, list_sort(list(len), 'DESC')[2] AS second FROM len GROUP BY uid),
k AS (SELECT w.*, {step} AS k, l.len FROM w JOIN len l ON l.seq = w.seq),
b AS (SELECT k.*, s.n, s.first, s.second, sum(g * w) OVER (PARTITION BY k.uid, k.k) / (sum(w) OVER (PARTITION BY k.uid, k.k) + 1e-8) AS base FROM k JOIN size s ON s.uid = k.uid)
SELECT seq, t, round(g, 6) + 0.0 AS returns, round(CASE WHEN n < 2 THEN 0 {tail} ELSE base END, 6) + 0.0 AS baseline,
  round((g - CASE WHEN n < 2 THEN 0 {tail} ELSE base END) * mask, 6) + 0.0 AS advantage FROM b"""


def _otb(spark, sf, **options):
    long = long_tokens(spark, sf).select("uid", "seq", "t", F.col("x").alias("reward"), "mask", F.lit(0.5).alias("pi_square"), F.exp("old_logp").alias("pi"))
    return rounded(A.token_baseline(long, **options).select("seq", "t", "returns", "baseline", "advantage"))


@R.add("w12_token_baseline", f"WITH {TOKENS}" + _OTB.format(source="tokens", having="", step="w.t", tail=""))
def w12_token_baseline(spark, sf):
    return _otb(spark, sf)


@R.add(
    "w13_tir_token_baseline",
    f"WITH {TOKENS}" + _OTB.format(source="tokens WHERE mask = 1", having=" HAVING sum(mask) > 0", step="row_number() OVER (PARTITION BY w.seq ORDER BY w.t) - 1", tail="WHEN l_tail THEN 0").replace("WHEN l_tail", "WHEN len = first AND second < first AND k >= second"),
)
def w13_tir_token_baseline(spark, sf):
    return _otb(spark, sf, zero_tail=True, dense=True)


@R.add("w14_weights_pow", f"WITH {ROLLOUTS} SELECT idx, round(pow(abs(score), 2.0) + 1e-8, 6) + 0.0 AS weight FROM rollouts")
def w14_weights_pow(spark, sf):
    return rounded(A.preference_weights(rollouts(spark, sf), method="pow").select("idx", "weight"))


@R.add("w14_weights_max_min", f"WITH {ROLLOUTS} SELECT idx, round(CASE WHEN score = (SELECT max(score) FROM rollouts) OR score = (SELECT min(score) FROM rollouts) THEN 1.0 ELSE 0.0 END + 1e-8, 6) + 0.0 AS weight FROM rollouts")
def w14_weights_max_min(spark, sf):
    return rounded(A.preference_weights(rollouts(spark, sf), method="max_min").select("idx", "weight"))


@R.add("w14_resample")
def w14_resample(spark, sf):
    """As many draws as responses, in proportion to the squared score."""
    rows = A.preference_weights(rollouts(spark, sf), method="pow")
    return A.weighted_resample(rows, rows.count(), 42).select("draw", "idx")


# ---------------------------------------------------------------- losses

_PPO = """, f AS (SELECT seq, mask, advantages AS a, greatest(least(logp - old_logp, 20), -20) AS kl, exp(greatest(least(logp - old_logp, 20), -20)) AS ratio FROM tokens),
l AS (SELECT *, -a * ratio AS free, -a * greatest(least(ratio, 1.2), 0.8) AS clipped, -a * 3.0 AS third FROM f),
k AS (SELECT seq, mask, kl, clipped > free AS clip, greatest(free, clipped) > third AND a < 0 AS lower,
  CASE WHEN a < 0 THEN least(third, greatest(free, clipped)) ELSE greatest(free, clipped) END AS loss FROM l WHERE mask = 1)"""

_MODES = {
    "token_mean": "(SELECT sum(loss) / count(*) FROM k)",
    "seq_sum": "(SELECT avg(s) FROM (SELECT sum(loss) AS s FROM k GROUP BY seq))",
    "seq_mean": "(SELECT avg(s) FROM (SELECT sum(loss) / (count(*) + 1e-8) AS s FROM k GROUP BY seq))",
    "seq_norm": "(SELECT sum(loss) / 64.0 FROM k)",
}
_MODE_NAMES = {"token_mean": "token-mean", "seq_sum": "seq-mean-token-sum", "seq_mean": "seq-mean-token-mean", "seq_norm": "seq-mean-token-sum-norm"}


def _scalars(loss: str, clip: bool = True, lower: bool = True, kl: str = "-kl") -> str:
    parts = [f"round({loss}, 6) + 0.0 AS pg_loss"]
    parts += ["round(count(*) FILTER (clip) / (count(*) + 1e-8), 6) + 0.0 AS pg_clipfrac"] * clip
    parts += [f"round(sum({kl}) / (count(*) + 1e-8), 6) + 0.0 AS ppo_kl"] if kl else []
    parts += ["round(count(*) FILTER (lower) / (count(*) + 1e-8), 6) + 0.0 AS pg_clipfrac_lower"] * lower
    return " SELECT DISTINCT " + ", ".join(parts) + " FROM k"


for _name, _mode in _MODE_NAMES.items():

    @R.add(f"l4_ppo_{_name}", f"WITH {TOKENS}" + _PPO + _scalars(_MODES[_name]))
    def _ppo_query(spark, sf, mode=_mode):
        return rounded(L.ppo(tokens(spark, sf), mode=mode, width=64))


@R.add(
    "l5_gspo",
    f"""WITH {TOKENS}, s AS (SELECT seq, exp(least(coalesce(sum(logp - old_logp) FILTER (mask = 1), 0) / greatest(sum(mask), 1), 10.0)) AS ratio FROM tokens GROUP BY seq),
k AS (SELECT t.seq, -advantages * greatest(least(ratio, 1.0004), 0.9997) > -advantages * ratio AS clip, greatest(-advantages * ratio, -advantages * greatest(least(ratio, 1.0004), 0.9997)) AS loss, logp - old_logp AS kl, false AS lower
  FROM tokens t JOIN s ON s.seq = t.seq WHERE mask = 1)"""
    + _scalars(_MODES["seq_mean"]),
)
def l5_gspo(spark, sf):
    return rounded(L.gspo(tokens(spark, sf), low=3e-4, high=4e-4))


@R.add(
    "l6_sapo",
    f"""WITH {TOKENS}, f AS (SELECT seq, advantages AS a, greatest(least(logp - old_logp, 20), -20) AS kl, CASE WHEN advantages > 0 THEN 1.0 ELSE 1.05 END AS tau FROM tokens WHERE mask = 1),
k AS (SELECT seq, kl, -(1 / (1 + exp(-tau * (exp(kl) - 1))) * (4 / tau)) * a AS loss FROM f)"""
    + _scalars(_MODES["seq_mean"], clip=False, lower=False),
)
def l6_sapo(spark, sf):
    return rounded(L.sapo(tokens(spark, sf)))


@R.add("l7_gpg_loss", f"WITH {TOKENS}, k AS (SELECT seq, -logp * advantages AS loss FROM tokens WHERE mask = 1)" + _scalars(_MODES["token_mean"], clip=False, lower=False, kl=""))
def l7_gpg_loss(spark, sf):
    return rounded(L.gpg_loss(tokens(spark, sf)))


@R.add(
    "l10_geo_mean",
    f"""WITH {TOKENS}, f AS (SELECT seq, mask, advantages AS a, logp - old_logp AS kl, greatest(least(logp - old_logp, 0.2), -0.2) AS held FROM tokens),
k AS (SELECT seq, mask, a, kl, sign(a) * least(sign(a) * kl, sign(a) * held) AS least_, kl <> held AND a > 0 AS clip, kl <> held AND a < 0 AS lower FROM f WHERE mask = 1),
s AS (SELECT t.seq, coalesce(sum(k.a), 0) AS a, coalesce(sum(k.least_), 0) AS l, count(k.seq) AS n FROM (SELECT DISTINCT seq FROM tokens) t LEFT JOIN k ON k.seq = t.seq GROUP BY t.seq)
SELECT round((SELECT avg(-(a / (n + 1e-8)) * exp(l / (n + 1e-8))) FROM s), 6) + 0.0 AS pg_loss, round(count(*) FILTER (clip) / (count(*) + 1e-8), 6) + 0.0 AS pg_clipfrac,
  round(sum(-kl) / (count(*) + 1e-8), 6) + 0.0 AS ppo_kl, round(count(*) FILTER (lower) / (count(*) + 1e-8), 6) + 0.0 AS pg_clipfrac_lower FROM k""",
)
def l10_geo_mean(spark, sf):
    return rounded(L.gmpo(tokens(spark, sf)))


@R.add(
    "l11_cispo",
    f"""WITH {TOKENS}, f AS (SELECT seq, advantages AS a, logp, greatest(least(logp - old_logp, 20), -20) AS kl FROM tokens WHERE mask = 1),
k AS (SELECT seq, kl, -greatest(least(exp(kl), 1.2), 0.8) * a * logp AS loss, exp(kl) <> greatest(least(exp(kl), 1.2), 0.8) AS clip FROM f)"""
    + _scalars(_MODES["token_mean"], lower=False),
)
def l11_cispo(spark, sf):
    return rounded(L.cispo(tokens(spark, sf)))


@R.add(
    "l9_kl_cov",
    f"""WITH {TOKENS}, v AS (SELECT seq, t, advantages AS a, logp, logp - old_logp AS kl FROM tokens WHERE mask = 1),
c AS (SELECT *, (a - avg(a) OVER ()) * (logp - avg(logp) OVER ()) AS cov, count(*) OVER () AS n FROM v),
o AS (SELECT *, row_number() OVER (ORDER BY cov DESC, seq, t) AS r FROM c),
k AS (SELECT seq, abs(kl) AS kl, -a * exp(kl) + CASE WHEN r <= greatest(1, CAST(floor(n * 0.01) AS BIGINT)) THEN abs(kl) ELSE 0 END AS loss FROM o)"""
    + _scalars(_MODES["token_mean"], clip=False, lower=False, kl="kl"),
)
def l9_kl_cov(spark, sf):
    return rounded(L.kl_cov(tokens(spark, sf), ratio_of=0.01))


@R.add(
    "l8_clip_cov",
    f"""WITH {TOKENS}, v AS (SELECT seq, t, advantages AS a, logp, logp - old_logp AS kl, exp(logp - old_logp) AS ratio FROM tokens WHERE mask = 1),
c AS (SELECT *, (a - avg(a) OVER ()) * (logp - avg(logp) OVER ()) AS cov, count(*) OVER () AS n, -a * ratio AS free, -a * greatest(least(ratio, 1.2), 0.8) AS clipped FROM v),
b AS (SELECT seq, t, row_number() OVER (ORDER BY sha256('0|' || CAST(seq AS VARCHAR) || '|' || CAST(t AS VARCHAR)), seq, t) AS r FROM c WHERE NOT clipped > free AND cov > 0.02 AND cov < 0.5),
k AS (SELECT c.seq, c.kl, coalesce(b.r <= greatest(1, CAST(floor(n * 0.01) AS BIGINT)), false) AS clip, CASE WHEN b.r <= greatest(1, CAST(floor(n * 0.01) AS BIGINT)) THEN 0 ELSE greatest(free, clipped) END AS loss
  FROM c LEFT JOIN b ON b.seq = c.seq AND b.t = c.t)"""
    + _scalars(_MODES["token_mean"], lower=False),
)
def l8_clip_cov(spark, sf):
    return rounded(L.clip_cov(tokens(spark, sf), ratio_of=0.01, cov_low=0.02, cov_high=0.5))


@R.add("l12_reinforce", f"WITH {TOKENS}, k AS (SELECT seq, -logp * advantages * least(exp(greatest(least(old_logp - rollout_logp, 20), -20)), 1.05) AS loss FROM tokens WHERE mask = 1)" + _scalars(_MODES["token_mean"], clip=False, lower=False, kl=""))
def l12_reinforce(spark, sf):
    rows = C.importance_weights(C.with_log_ratio(tokens(spark, sf)), "token", 1.05)
    return rounded(L.reinforce(rows, weights="is_weights"))


@R.add(
    "l13_value_loss",
    f"""WITH {TOKENS}, f AS (SELECT seq, x AS vpred, y AS value, z AS returns FROM tokens WHERE mask = 1),
k AS (SELECT seq, pow(vpred - returns, 2) AS a, pow(greatest(least(vpred, value + 0.1), value - 0.1) - returns, 2) AS b FROM f)
SELECT round(0.5 * sum(greatest(a, b)) / count(*), 6) + 0.0 AS vf_loss, round(count(*) FILTER (b > a) / (count(*) + 1e-8), 6) + 0.0 AS vf_clipfrac FROM k""",
)
def l13_value_loss(spark, sf):
    rows = tokens(spark, sf).select(F.col("x").alias("vpred"), F.col("y").alias("value"), F.col("z").alias("returns"), "mask")
    return rounded(L.value_loss(rows, clip=0.1))


@R.add(
    "l13b_sft_loss",
    f"""WITH {TOKENS}, k AS (SELECT logp, coalesce(lead(mask) OVER (PARTITION BY seq ORDER BY t), first_value(mask) OVER (PARTITION BY seq ORDER BY t)) AS m FROM tokens)
SELECT round(-sum(logp) FILTER (m = 1) / count(*) FILTER (m = 1), 6) + 0.0 AS loss FROM k""",
)
def l13b_sft_loss(spark, sf):
    return rounded(L.sft_loss(tokens(spark, sf)))


@R.add(
    "l13b_ppo_total",
    f"WITH {TOKENS}"
    + _PPO
    + """, e AS (SELECT sum(abs(z)) / count(*) AS entropy, sum(greatest(least(exp(greatest(least(rollout_logp - logp, 20), -20)) - greatest(least(rollout_logp - logp, 20), -20) - 1, 10), -10)) / count(*) AS kl_loss FROM tokens WHERE mask = 1),
p AS (SELECT sum(loss) / count(*) AS pg_loss, count(*) FILTER (clip) / (count(*) + 1e-8) AS pg_clipfrac, sum(-kl) / (count(*) + 1e-8) AS ppo_kl, count(*) FILTER (lower) / (count(*) + 1e-8) AS pg_clipfrac_lower FROM k)
SELECT round(pg_loss, 6) + 0.0 AS pg_loss, round(pg_clipfrac, 6) + 0.0 AS pg_clipfrac, round(ppo_kl, 6) + 0.0 AS ppo_kl, round(pg_clipfrac_lower, 6) + 0.0 AS pg_clipfrac_lower,
  round(entropy, 6) + 0.0 AS entropy, round(kl_loss, 6) + 0.0 AS kl_loss, round(pg_loss - 0.01 * entropy + 0.001 * kl_loss, 6) + 0.0 AS loss FROM p, e""",
)
def l13b_ppo_total(spark, sf):
    rows = tokens(spark, sf).withColumn("entropy", F.transform("z", F.abs))
    return rounded(L.ppo_total(rows, ref="rollout_logp"))


@R.add("l13c_response_slice", "SELECT vec_id AS seq, round(list_sum(list_transform(embedding[(5 + vec_id % 9):(5 + vec_id % 9) + 11], lambda v: CAST(v AS DOUBLE))), 6) + 0.0 AS total FROM embeddings")
def l13c_response_slice(spark, sf):
    rows = tokens(spark, sf)
    part = L.response_slice("x", (5 + F.col("seq") % 9).cast("int"), F.lit(12))
    return rows.select("seq", r6(F.aggregate(part, F.lit(0.0), lambda a, v: a + v)).alias("total"))


_LOGITS = "SELECT vec_id AS seq, list_transform(embedding, lambda v: 10.0 * CAST(v AS DOUBLE)) AS a FROM embeddings"


@R.add(
    "l14_logit_stats",
    f"""WITH l AS ({_LOGITS}), u AS (SELECT seq, unnest(a) AS v, generate_subscripts(a, 1) AS i FROM l), z AS (SELECT seq, max(v) AS top FROM u GROUP BY seq),
e AS (SELECT u.seq, u.i, u.v, exp(u.v - z.top) AS e, z.top FROM u JOIN z ON z.seq = u.seq)
SELECT seq, round(ln(sum(e)) + max(top) - sum(e * v) / sum(e), 6) + 0.0 AS entropy, round(max(v) FILTER (i = 4) - max(top) - ln(sum(e)), 6) + 0.0 AS logprob, round(sum(e * e) / pow(sum(e), 2), 6) + 0.0 AS pi_square FROM e GROUP BY seq""",
)
def l14_logit_stats(spark, sf):
    rows = tokens(spark, sf).select("seq", F.transform("x", lambda v: 10.0 * v).alias("a"))
    return rows.select("seq", r6(L.entropy_of_logits("a")).alias("entropy"), r6(L.logprob_of("a", F.lit(3))).alias("logprob"), r6(L.sum_pi_squared("a")).alias("pi_square"))


@R.add(
    "l14_top_filters",
    f"""WITH l AS ({_LOGITS}), u AS (SELECT seq, unnest(a) AS v FROM l), s AS (SELECT seq, v, exp(v - max(v) OVER (PARTITION BY seq)) AS e FROM u),
o AS (SELECT seq, v, rank() OVER (PARTITION BY seq ORDER BY v DESC) AS r, sum(e) OVER (PARTITION BY seq ORDER BY v DESC ROWS UNBOUNDED PRECEDING) / sum(e) OVER (PARTITION BY seq) - e / sum(e) OVER (PARTITION BY seq) AS before FROM s)
SELECT seq, count(*) FILTER (r <= 10) AS top_k, count(*) FILTER (before < 0.8) AS top_p FROM o GROUP BY seq""",
)
def l14_top_filters(spark, sf):
    rows = tokens(spark, sf).select("seq", F.transform("x", lambda v: 10.0 * v).alias("a"))
    kept = lambda c: F.size(F.filter(c, lambda v: v > float("-inf"))).cast("bigint")
    return rows.select("seq", kept(L.top_k_filter("a", 10)).alias("top_k"), kept(L.top_p_filter("a", 0.8)).alias("top_p"))


@R.add(
    "l1_kl_rewards",
    f"""WITH {TOKENS}, k AS (SELECT seq, t, x, mask, rollout_logp - logp AS d FROM tokens)
SELECT seq, t, round(x - 0.1 * CASE WHEN mask = 1 THEN greatest(least(exp(greatest(least(d, 20), -20)) - greatest(least(d, 20), -20) - 1, 10), -10) ELSE 0 END, 6) + 0.0 AS token_rewards FROM k""",
)
def l1_kl_rewards(spark, sf):
    return _long(L.apply_kl_penalty(tokens(spark, sf), "x", "logp", "rollout_logp", kind="k3"), "token_rewards")


@R.add(
    "l2_kl_estimates",
    f"""WITH {TOKENS}, k AS (SELECT logp - rollout_logp AS d, logp, rollout_logp FROM tokens WHERE mask = 1)
SELECT round(avg(d), 6) + 0.0 AS k1, round(avg(abs(d)), 6) + 0.0 AS abs, round(avg(0.5 * d * d), 6) + 0.0 AS k2, round(avg(greatest(least(exp(greatest(least(-d, 20), -20)) + d - 1, 10), -10)), 6) + 0.0 AS k3,
  round(avg(0.5 - (logp - rollout_logp) * 0.2), 6) + 0.0 AS rewards FROM k""",
)
def l2_kl_estimates(spark, sf):
    kept = L.exploded(tokens(spark, sf), ["logp", "rollout_logp"], "mask", ["seq"])
    parts = [r6(F.avg(L.kl_estimate(F.col("logp"), F.col("rollout_logp"), k))).alias(k) for k in ("k1", "abs", "k2", "k3")]
    return kept.agg(*parts, r6(F.avg(L.compute_rewards(F.lit(0.5), F.col("logp"), F.col("rollout_logp"), 0.2))).alias("rewards"))


@R.add(
    "l3_kl_controller",
    """WITH RECURSIVE s AS (SELECT CAST(floor(event_id / 100) AS BIGINT) AS step, avg(value) / 1000 AS kl FROM events GROUP BY 1),
f AS (SELECT step, 1 + greatest(least(kl / 0.05 - 1, 0.2), -0.2) * 100 / 10000.0 AS factor FROM s),
c AS (SELECT CAST(-1 AS BIGINT) AS step, CAST(0.2 AS DOUBLE) AS value UNION ALL SELECT f.step, c.value * f.factor FROM c JOIN f ON f.step = c.step + 1)
SELECT step, round(value, 6) + 0.0 AS value FROM c WHERE step >= 0""",
)
def l3_kl_controller(spark, sf):
    from corpusmill.functions.runtime import table

    steps = table(spark, sf, "events").groupBy(F.floor(F.col("event_id") / 100).cast("bigint").alias("step")).agg((F.avg("value") / 1000).alias("kl"), F.lit(100).alias("n_steps"))
    return rounded(L.kl_controller(steps, 0.2, 0.05, 10000.0))


# ---------------------------------------------------------------- correction

_RATIO = f"WITH {TOKENS}, f AS (SELECT seq, t, mask, old_logp - rollout_logp AS d, old_logp, rollout_logp FROM tokens), n AS (SELECT seq, coalesce(sum(d) FILTER (mask = 1), 0) AS total, sum(mask) AS n FROM f GROUP BY seq)"


@R.add("l15_is_weights_token", _RATIO + " SELECT seq, t, round(least(exp(d) * mask, 1.05), 6) + 0.0 AS is_weights FROM f")
def l15_is_weights_token(spark, sf):
    return _long(C.importance_weights(C.with_log_ratio(tokens(spark, sf)), "token", 1.05), "is_weights")


@R.add(
    "l15_is_weights_sequence",
    _RATIO
    + """, w AS (SELECT f.seq, f.t, f.mask, n.n, least(exp(greatest(least(total, 20), -20)) * mask, 1.5) AS w FROM f JOIN n ON n.seq = f.seq),
m AS (SELECT avg(s) AS mean FROM (SELECT sum(w) / (max(n) + 1e-8) AS s FROM w GROUP BY seq HAVING max(n) > 0))
SELECT seq, t, round(w / mean, 6) + 0.0 AS is_weights FROM w, m""",
)
def l15_is_weights_sequence(spark, sf):
    return _long(C.importance_weights(C.with_log_ratio(tokens(spark, sf)), "sequence", 1.5, normalize=True), "is_weights")


def _metrics_sql(level: str, prefix: str) -> str:
    weight = "exp(greatest(least(d, 20), -20))" if level == "token" else f"exp(greatest(least({'total' if level == 'sequence' else 'total / (n + 1e-8)'}, 20), -20))"
    metric = {"token": "NULL", "sequence": "total", "geometric": "total / (n + 1e-8)"}[level]
    if level == "token":
        ends = ("max(w)", "min(w)")
        high, low = "count(*) FILTER (w > 1.05) / (count(*) + 1e-8)", "count(*) FILTER (w < 1 / 1.05) / (count(*) + 1e-8)"
    else:
        ends = ("(SELECT exp(least(max(m), 20)) FROM s)", "(SELECT exp(min(m)) FROM s)")
        high, low = "(SELECT avg(CASE WHEN m > ln(1.05) THEN 1.0 ELSE 0.0 END) FROM s)", "(SELECT avg(CASE WHEN m < ln(1 / 1.05) THEN 1.0 ELSE 0.0 END) FROM s)"
    first, second = ends
    top = f"round({first}, 6) + 0.0 AS {prefix}max, round({second}, 6) + 0.0 AS {prefix}min"
    return (
        _RATIO
        + f""", w AS (SELECT f.seq, {weight} AS w FROM f JOIN n ON n.seq = f.seq WHERE mask = 1),
k AS (SELECT seq, w, greatest(least(w, 1.05), 1 / 1.05) AS h FROM w),
s AS (SELECT n.seq, {metric} AS m, coalesce(q.w, 0) / (n.n + 1e-8) AS sw FROM n LEFT JOIN (SELECT seq, sum(w) AS w FROM k GROUP BY seq) q ON q.seq = n.seq),
a AS (SELECT count(*) + 1e-8 AS c, sum(h) / (count(*) + 1e-8) AS mh, sum(h * h) AS hh FROM k)
SELECT round(sum(w) / (count(*) + 1e-8), 6) + 0.0 AS {prefix}mean, round((SELECT sqrt(greatest(hh / c - mh * mh, 0)) FROM a), 6) + 0.0 AS {prefix}std, round((SELECT 1 / (hh / c / pow(mh + 1e-8, 2)) FROM a), 6) + 0.0 AS {prefix}eff_sample_size,
  {top}, round({high}, 6) + 0.0 AS {prefix}ratio_fraction_high, round({low}, 6) + 0.0 AS {prefix}ratio_fraction_low,
  (SELECT round(avg(sw), 6) + 0.0 FROM s) AS {prefix}seq_mean, (SELECT round(stddev_samp(sw), 6) + 0.0 FROM s) AS {prefix}seq_std, (SELECT round(max(sw), 6) + 0.0 FROM s) AS {prefix}seq_max, (SELECT round(min(sw), 6) + 0.0 FROM s) AS {prefix}seq_min,
  (SELECT round(max(abs(sw - 1)), 6) + 0.0 FROM s) AS {prefix}seq_max_deviation, (SELECT round(avg(CASE WHEN sw > 1.05 THEN 1.0 ELSE 0.0 END), 6) + 0.0 FROM s) AS {prefix}seq_fraction_high, (SELECT round(avg(CASE WHEN sw < 1 / 1.05 THEN 1.0 ELSE 0.0 END), 6) + 0.0 FROM s) AS {prefix}seq_fraction_low
FROM k"""
    )


for _level, _prefix in (("token", "rollout_is_"), ("sequence", "rollout_is_"), ("geometric", "rollout_rs_")):

    @R.add(f"l16_weight_metrics_{_level}", _metrics_sql(_level, _prefix))
    def _metrics_query(spark, sf, level=_level, prefix=_prefix):
        return rounded(C.weight_metrics(C.with_log_ratio(tokens(spark, sf)), level, 1.05, prefix=prefix))


@R.add("l17_reject_token", _RATIO + " SELECT seq, t, CASE WHEN exp(d) BETWEEN 1 / 1.05 AND 1.05 THEN mask ELSE 0 END AS kept_mask FROM f")
def l17_reject_token(spark, sf):
    out = C.rejection_mask(C.with_log_ratio(tokens(spark, sf)), "token", 1.05)
    return out.select("seq", F.posexplode("kept_mask").alias("t", "kept_mask")).withColumn("t", F.col("t").cast("bigint"))


@R.add("l17_reject_sequence", _RATIO + " SELECT f.seq, f.t, CASE WHEN exp(greatest(least(total, 20), -20)) BETWEEN 0.6 AND 1.4 THEN mask ELSE 0 END AS kept_mask FROM f JOIN n ON n.seq = f.seq")
def l17_reject_sequence(spark, sf):
    out = C.rejection_mask(C.with_log_ratio(tokens(spark, sf)), "sequence", 1.4, 0.6)
    return out.select("seq", F.posexplode("kept_mask").alias("t", "kept_mask")).withColumn("t", F.col("t").cast("bigint"))


@R.add(
    "l17_reject_rates_geometric",
    _RATIO
    + """, w AS (SELECT seq, n, exp(greatest(least(total / (n + 1e-8), 20), -20)) AS w FROM n)
SELECT round(sum(CASE WHEN w BETWEEN 1 / 1.005 AND 1.005 THEN 0 ELSE n END) / (sum(n) + 1e-8), 6) + 0.0 AS rollout_rs_masked_fraction, round(avg(CASE WHEN w BETWEEN 1 / 1.005 AND 1.005 THEN 0.0 ELSE 1.0 END), 6) + 0.0 AS rollout_rs_seq_masked_fraction FROM w""",
)
def l17_reject_rates_geometric(spark, sf):
    return rounded(C.rejection_rates(C.with_log_ratio(tokens(spark, sf)), "geometric", 1.005))


@R.add("l18_veto", _RATIO + ", v AS (SELECT seq, coalesce(bool_or(mask = 1 AND d < ln(0.83)), false) AS vetoed FROM f GROUP BY seq) SELECT f.seq, f.t, v.vetoed, CASE WHEN v.vetoed THEN 0 ELSE f.mask END AS kept_mask FROM f JOIN v ON v.seq = f.seq")
def l18_veto(spark, sf):
    out = C.veto(C.with_log_ratio(tokens(spark, sf)), 0.83)
    return out.select("seq", "vetoed", F.posexplode("kept_mask").alias("t", "kept_mask")).withColumn("t", F.col("t").cast("bigint"))


@R.add("l18_veto_rates", _RATIO + " SELECT round((SELECT avg(CASE WHEN b THEN 1.0 ELSE 0.0 END) FROM (SELECT coalesce(bool_or(mask = 1 AND d < ln(0.83)), false) AS b FROM f GROUP BY seq)), 6) + 0.0 AS rollout_is_veto_fraction, round(count(*) FILTER (mask = 1 AND d < ln(0.83)) / (sum(mask) + 1e-8), 6) + 0.0 AS rollout_is_catastrophic_token_fraction FROM f")
def l18_veto_rates(spark, sf):
    return rounded(C.veto_rates(C.with_log_ratio(tokens(spark, sf)), 0.83))


@R.add(
    "l19_offpolicy",
    _RATIO
    + """, s AS (SELECT seq, coalesce(sum(old_logp) FILTER (mask = 1), 0) / (sum(mask) + 1e-8) AS a, coalesce(sum(rollout_logp) FILTER (mask = 1), 0) / (sum(mask) + 1e-8) AS b, coalesce(sum(d) FILTER (mask = 1), 0) AS total FROM f GROUP BY seq),
k AS (SELECT * FROM f WHERE mask = 1)
SELECT round(avg(exp(-a)), 6) + 0.0 AS "rollout_corr/training_ppl", round(avg(-a), 6) + 0.0 AS "rollout_corr/training_log_ppl", (SELECT round(sum(-d) / (count(*) + 1e-8), 6) + 0.0 FROM k) AS "rollout_corr/kl", (SELECT round(sum(exp(d) - d - 1) / (count(*) + 1e-8), 6) + 0.0 FROM k) AS "rollout_corr/k3_kl",
  round(avg(exp(-b)), 6) + 0.0 AS "rollout_corr/rollout_ppl", round(avg(-b), 6) + 0.0 AS "rollout_corr/rollout_log_ppl", round(avg(b - a), 6) + 0.0 AS "rollout_corr/log_ppl_diff", round(avg(abs(b - a)), 6) + 0.0 AS "rollout_corr/log_ppl_abs_diff", round(max(b - a), 6) + 0.0 AS "rollout_corr/log_ppl_diff_max",
  round(min(b - a), 6) + 0.0 AS "rollout_corr/log_ppl_diff_min", round(avg(exp(b - a)), 6) + 0.0 AS "rollout_corr/ppl_ratio", (SELECT round(sum(exp(2 * d)) / (count(*) + 1e-8) - 1, 6) + 0.0 FROM k) AS "rollout_corr/chi2_token", round(avg(exp(2 * greatest(least(total, 20), -20))) - 1, 6) + 0.0 AS "rollout_corr/chi2_seq" FROM s""",
)
def l19_offpolicy(spark, sf):
    return rounded(C.offpolicy_metrics(tokens(spark, sf), prefix="rollout_corr/"))


@R.add(
    "l20_correct",
    _RATIO
    + """, v AS (SELECT seq, coalesce(bool_or(mask = 1 AND d < ln(0.75)), false) AS vetoed FROM f GROUP BY seq)
SELECT f.seq, f.t, round(least(exp(d) * mask, 2.0), 6) + 0.0 AS is_weights, CASE WHEN v.vetoed OR NOT exp(d) BETWEEN 1 / 1.1 AND 1.1 THEN 0 ELSE mask END AS kept_mask FROM f JOIN v ON v.seq = f.seq""",
)
def l20_correct(spark, sf):
    out = C.correct(tokens(spark, sf), "token", 2.0, "token", 1.1, 0.75)
    return out.select("seq", F.posexplode(F.arrays_zip("is_weights", "kept_mask")).alias("t", "p")).select("seq", F.col("t").cast("bigint").alias("t"), r6("p.is_weights").alias("is_weights"), F.col("p.kept_mask").alias("kept_mask"))


@R.add("l21_overlong", f"WITH {ROLLOUTS} SELECT idx, round(score + least(-(length - (12 - 4)) / 4.0 * 0.5, 0.0), 6) + 0.0 AS reward FROM rollouts")
def l21_overlong(spark, sf):
    rows = rollouts(spark, sf)
    return rows.select("idx", r6(F.col("score") + C.overlong_penalty(F.col("length"), 12, 4, 0.5)).alias("reward"))


@R.add("l22_flops", f"WITH {ROLLOUTS} SELECT data_source, CAST(sum(length) AS BIGINT) AS tokens, round((6.0 * 7e9 * sum(length) + 12.0 * 128 * 32 * 32 * sum(length * length)) / 1e9, 4) + 0.0 AS gigaflops FROM rollouts GROUP BY data_source")
def l22_flops(spark, sf):
    from corpusmill.operators.sampling import dense_flops

    per = rollouts(spark, sf).groupBy("data_source").agg(F.sum("length").alias("tokens"), dense_flops("length", 7e9, 32, 32, 128).alias("flops"))
    return per.select("data_source", "tokens", (F.round(F.col("flops") / 1e9, 4) + 0.0).alias("gigaflops"))
