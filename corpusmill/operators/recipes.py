"""Training row layouts: reinforcement, supervised and preference rows from raw questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import chat, clean_hellaswag

#: Instructions that recipes append to a question.
GSM_INSTRUCTION = ' Let\'s think step by step and output the final answer after "####".'
MATH_INSTRUCTION = " Let's think step by step and output the final answer within \\boxed{}."
TOOL_SYSTEM = "You are a math expert. Reason step by step and check your answer with the `calc_gsm8k_reward` tool before you give it as `#### <answer>`."


def rl_rows(rows: DataFrame, source: Column, question: Column, truth: Column, ability: str, split: str, index: Column, system: Column | None = None, extra: dict[str, Column] | None = None) -> DataFrame:
    """data_source, prompt (messages), ability, reward_model and extra_info of each row."""
    more = [c.alias(k) for k, c in (extra or {}).items()]
    return rows.select(
        source.alias("data_source"),
        chat(question, system).alias("prompt"),
        F.lit(ability).alias("ability"),
        F.struct(F.lit("rule").alias("style"), truth.alias("ground_truth")).alias("reward_model"),
        F.struct(F.lit(split).alias("split"), index.alias("index"), *more).alias("extra_info"),
    )


def gsm_truth(answer: Column) -> Column:
    """The number after the last ``####`` of a worked answer, commas dropped."""
    return F.replace(F.try_element_at(F.regexp_extract_all(answer, F.lit(r"#### (\-?[0-9\.\,]+)"), F.lit(1)), F.lit(-1)), F.lit(","), F.lit(""))


def _tool_args(truth: Column) -> dict[str, Column]:
    return {"need_tools_kwargs": F.lit(True), "tools_kwargs": F.struct(F.struct(F.struct(truth.alias("ground_truth")).alias("create_kwargs")).alias("calc_gsm8k_reward"))}


def recipe(name: str, rows: DataFrame, split: str) -> DataFrame:
    """Rows (idx, question, answer[, image, endings, label]) in the layout of a known recipe.

    gsm8k, gsm8k_tool, gsm8k_interaction, math, geometry, aime, hellaswag, search.  A null
    question gives a null content.
    """
    q, a, idx = F.col("question"), F.col("answer"), F.col("idx")
    kept = {"answer": a, "question": q}
    if name == "gsm8k":
        return rl_rows(rows, F.lit("openai/gsm8k"), F.concat(q, F.lit(GSM_INSTRUCTION)), gsm_truth(a), "math", split, idx, extra=kept)
    if name == "gsm8k_tool":
        return rl_rows(rows, F.lit("openai/gsm8k"), F.concat(q, F.lit(GSM_INSTRUCTION)), gsm_truth(a), "math", split, idx, F.lit(TOOL_SYSTEM), kept | _tool_args(gsm_truth(a)))
    if name == "gsm8k_interaction":
        args = {"interaction_kwargs": F.struct(F.lit("gsm8k").alias("name"), q.alias("query"), gsm_truth(a).alias("ground_truth"))}
        return rl_rows(rows, F.lit("openai/gsm8k"), F.concat(q, F.lit(GSM_INSTRUCTION)), gsm_truth(a), "math", split, idx, F.lit("You are a math expert."), kept | args)
    if name == "math":
        return rl_rows(rows, F.lit("math"), F.concat(q, F.lit(MATH_INSTRUCTION)), a, "math", split, idx)
    if name == "geometry":
        ask = F.concat(F.lit("<image>"), q, F.lit(" Think in <think> </think> tags and put the final answer in \\boxed{}."))
        return rl_rows(rows, F.lit("hiyouga/geometry3k"), ask, a, "math", split, idx, extra=kept)
    if name == "aime":
        return rl_rows(rows, F.lit("aime"), q, a, "math", split, idx, extra={"need_tools_kwargs": F.lit(True)})
    if name == "hellaswag":
        return rl_rows(rows, F.lit("Rowan/hellaswag"), clean_hellaswag(q), F.get(F.transform("endings", clean_hellaswag), F.expr("try_cast(label AS INT)")), "nlp", split, idx).filter("reward_model.ground_truth IS NOT NULL")
    if name == "search":
        args = {"need_tools_kwargs": F.lit(True), "tools_kwargs": F.struct(F.struct(F.struct(a.alias("ground_truth"), q.alias("question")).alias("create_kwargs")).alias("search"))}
        return rl_rows(rows, F.concat(F.lit("searchR1_"), F.coalesce("source", F.lit("unknown")) if "source" in rows.columns else F.lit("unknown")), q, a, "fact-reasoning", split, idx, F.lit("Answer the question; search when you need to."), args)
    raise ValueError(f"unknown recipe {name!r}")


def preference_sft(pairs: DataFrame, key: str) -> DataFrame:
    """(key, kind, text): every pair as two rows, the chosen and the rejected text."""
    both = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("text")) for k in ("chosen", "rejected")])
    return pairs.select(key, F.explode(both).alias("p")).select(key, "p.kind", "p.text")


def preference_rows(pairs: DataFrame) -> DataFrame:
    """(prompt, chosen, rejected): texts cut at the last assistant turn, whose start both share."""
    mark = "\n\nAssistant:"
    head = F.substring_index("chosen", mark, -1)
    prompt = F.expr(f"left(chosen, length(chosen) - length(substring_index(chosen, '{mark}', -1)))")
    return pairs.select(prompt.alias("prompt"), head.alias("chosen"), F.substring_index("rejected", mark, -1).alias("rejected"))


def multiturn_rows(rows: DataFrame, system: str | None = None) -> DataFrame:
    """(messages): question and answer as a conversation."""
    m = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    turns = [m("user", F.col("question")), m("assistant", F.col("answer"))]
    return rows.select(F.array(*([m("system", F.lit(system))] if system else []), *turns).alias("messages"))


def within_length(rows: DataFrame, column: str, most: int, count=None) -> DataFrame:
    """Rows whose text has at most ``most`` tokens; a text that cannot be counted is dropped.

    Tokens are runs of non-blank characters unless ``count`` (text column -> number) is given.
    """
    n = count(F.col(column)) if count else F.size(F.filter(F.split(column, r"\s+"), lambda w: w != ""))
    return rows.filter(F.col(column).isNotNull() & (n <= most))


def generation_batches(rows: DataFrame, size: int, key: str) -> DataFrame:
    """Adds ``batch`` (runs of ``size`` rows in the order of a unique number ``key``) and ``total``: the shape of offline generation."""
    from corpusmill.functions.ranking import ranked_in_order

    total = F.broadcast(rows.agg(F.count(F.lit(1)).alias("total")))  # a one-row table
    return ranked_in_order(rows, key, "__k").join(total).withColumn("batch", F.floor(F.col("__k") / size).cast("bigint")).drop("__k")


def collect_responses(generated: DataFrame, prompt: str = "idx", n: str = "sample") -> DataFrame:
    """(prompt, responses): the responses of each prompt in sample order."""
    return generated.groupBy(prompt).agg(F.sort_array(F.collect_list(F.struct(n, "response"))).alias("r")).select(prompt, F.transform("r", lambda x: x["response"]).alias("responses"))


__all__ = ["collect_responses", "generation_batches", "gsm_truth", "multiturn_rows", "preference_rows", "preference_sft", "recipe", "rl_rows", "within_length"]
