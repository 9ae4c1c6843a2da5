"""Reward managers: strategies that turn responses into rewards, as functions over a DataFrame.

A scorer is a column expression of (source, response, truth), or a Python function of one
row's values; Python scorers run in Arrow batches, and one that fails or takes too long
counts as 0.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.grading import default_score
from corpusmill.functions.sequences import reward_at_end
from corpusmill.operators.correction import overlong_penalty

MANAGERS: dict[str, Callable[..., DataFrame]] = {}


def register_manager(name: str):
    """Decorator that makes a manager known under ``name``."""

    def wrap(fn):
        MANAGERS[name] = fn
        return fn

    return wrap


def manager(name: str) -> Callable[..., DataFrame]:
    """The registered manager; an error lists the known ones."""
    if name not in MANAGERS:
        raise ValueError(f"unknown reward manager {name!r}; known: {sorted(MANAGERS)}")
    return MANAGERS[name]


def scored_by(fn: Callable[[str, str, str], float], source: Column, response: Column, truth: Column, seconds: float | None = None) -> Column:
    """(score, error) of a Python scorer; ``error`` names what went wrong: timeout, error or nothing.

    ``seconds`` bounds what a row may take; a row is judged late after the fact, since a
    running scorer cannot be interrupted safely in a worker.
    """

    @F.pandas_udf("score double, error string")
    def run(s: pd.Series, r: pd.Series, t: pd.Series) -> pd.DataFrame:
        rows = []
        for a, b, c in zip(s, r, t):
            began = time.monotonic()
            try:
                value, error = float(fn(a, b, c)), None
            except Exception:  # noqa: BLE001 - any failure of a scorer is a reward of 0
                value, error = 0.0, "error"
            if seconds is not None and time.monotonic() - began > seconds:
                value, error = 0.0, "timeout"
            rows.append((value, error))
        return pd.DataFrame(rows, columns=["score", "error"])

    return run(source, response, truth)


def _score(df: DataFrame, scorer, seconds=None) -> DataFrame:
    s, r, t = F.col("data_source"), F.col("response"), F.col("ground_truth")
    if scorer is None:
        return df.withColumn("score", default_score(s, r, t)).withColumn("error", F.lit(None).cast("string"))
    if isinstance(scorer, Column):
        return df.withColumn("score", scorer).withColumn("error", F.lit(None).cast("string"))
    return df.withColumn("__s", scored_by(scorer, s, r, t, seconds)).withColumns({"score": F.col("__s.score"), "error": F.col("__s.error")}).drop("__s")


def _placed(df: DataFrame, width: int | None) -> DataFrame:
    return df.withColumn("token_rewards", reward_at_end("length", width, "reward")) if width else df


@register_manager("naive")
def naive(df: DataFrame, scorer=None, width: int | None = None) -> DataFrame:
    """Adds ``score``, ``error`` and ``reward``; with ``width``, ``token_rewards`` with the reward at the last token."""
    return _placed(_score(df, scorer).withColumn("reward", F.col("score")), width)


@register_manager("dapo")
def dapo(df: DataFrame, scorer=None, width: int | None = None, max_length: int = 0, buffer: int = 0, factor: float = 1.0) -> DataFrame:
    """As ``naive``, less the penalty of overlong responses where a buffer is given."""
    scored = _score(df, scorer)
    reward = F.col("score") + overlong_penalty(F.col("length"), max_length, buffer, factor) if buffer else F.col("score")
    return _placed(scored.withColumn("reward", reward), width)


@register_manager("batch")
def batch(df: DataFrame, scorer: Callable[[pd.DataFrame], pd.Series], width: int | None = None) -> DataFrame:
    """As ``naive``, with a scorer that sees Arrow batches of (data_source, response, ground_truth) at once."""

    @F.pandas_udf("double")
    def run(s: pd.Series, r: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series(scorer(pd.DataFrame({"data_source": s, "response": r, "ground_truth": t})), dtype=float)

    scored = df.withColumn("score", run("data_source", "response", "ground_truth")).withColumn("error", F.lit(None).cast("string"))
    return _placed(scored.withColumn("reward", F.col("score")), width)


@register_manager("prime")
def prime(df: DataFrame, scorer, width: int | None = None, seconds: float = 300.0) -> DataFrame:
    """As ``naive``, with a bound on the time of each row; late and failing rows get 0."""
    return _placed(_score(df, scorer, seconds).withColumn("reward", F.col("score")), width)


@register_manager("rate_limited")
def rate_limited(df: DataFrame, scorer=None, width: int | None = None, per_minute: float = 60.0, burst: float = 60.0, at: str = "at", bucket: str = "data_source") -> DataFrame:
    """As ``naive``, with ``start``: when each request may go out under a rate limit per bucket."""
    from corpusmill.streaming.queue import token_bucket

    scored = _score(df, scorer).withColumn("reward", F.col("score"))
    keyed = scored.withColumn("cost", F.lit(1.0))
    starts = token_bucket(keyed, per_minute / 60.0, burst, bucket, at, "cost").groupBy(bucket, at).agg(F.max("start").alias("start"))
    return _placed(scored.join(starts, [bucket, at], "left"), width)
