"""Token arrays: padding, masks, positions and the training layouts built from them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def pad(ids, length: int, value, left: bool = False) -> Column:
    """An array filled with ``value`` up to ``length``; longer ones stay as they are."""
    a = _c(ids)
    fill = F.array_repeat(value if isinstance(value, Column) else F.lit(value), F.greatest(F.lit(length) - F.size(a), F.lit(0)))
    return F.concat(fill, a) if left else F.concat(a, fill)


def truncate(ids, length: int, how: str = "error") -> Column:
    """At most ``length`` elements: ``left`` keeps the end, ``right`` the start, ``middle`` both ends, ``error`` raises."""
    a, n = _c(ids), F.size(_c(ids))
    if how == "right":
        return F.slice(a, 1, length)
    if how == "left":
        return F.slice(a, F.greatest(n - length + 1, F.lit(1)), length)
    if how == "middle":
        head = length // 2
        return F.when(n > length, F.concat(F.slice(a, 1, head), F.slice(a, F.greatest(n - (length - head) + 1, F.lit(1)), length - head))).otherwise(a)
    if how == "error":
        return F.when(n > length, F.raise_error(F.concat(F.lit("longer than the limit: "), n.cast("string"))).cast("array<bigint>")).otherwise(a)
    raise ValueError(f"unknown way to cut {how!r}")


def kept(ids, mask) -> Column:
    """The elements that the mask keeps: padded to ragged."""
    return F.transform(F.filter(F.arrays_zip(_c(ids).alias("x"), _c(mask).alias("m")), lambda p: p["m"] == 1), lambda p: p["x"])


def without_pad(ids, value) -> Column:
    """The array without its padding value at either end."""
    a = _c(ids)
    body = F.filter(F.transform(a, lambda x, i: F.when(x != value, i)), lambda i: i.isNotNull())
    return F.when(F.size(body) == 0, F.slice(a, 1, 0)).otherwise(F.slice(a, F.array_min(body) + 1, F.array_max(body) - F.array_min(body) + 1))


def position_ids(mask) -> Column:
    """max(running sum of the mask - 1, 0) at each place, null for null; one running sum over all rows of a batch."""

    @F.arrow_udf("array<int>")
    def run(m: pa.Array) -> pa.Array:
        lengths = np.asarray(pc.fill_null(pc.list_value_length(m), 0).to_numpy(zero_copy_only=False), np.int64)
        total = np.concatenate(([0], np.cumsum(np.asarray(m.flatten().to_numpy(zero_copy_only=False), np.int64))))
        ends = np.cumsum(lengths)
        own = total[1:] - np.repeat(total[ends - lengths], lengths)
        offsets = np.concatenate(([0], ends)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.maximum(own - 1, 0).astype(np.int32)), mask=m.is_null())

    return run(_c(mask).cast("array<int>"))


def response_mask(attention, length: int) -> Column:
    """The last ``length`` places of the attention mask."""
    return F.slice(_c(attention), -length, length)


def eos_mask(ids, eos) -> Column:
    """1 up to and with the first end token, 0 after; all 1 where there is none."""
    at = F.array_position(_c(ids), eos)
    return F.transform(_c(ids), lambda x, i: F.when((at == 0) | (i < at), 1).otherwise(0))


def sft_row(prompt, response, max_length: int, pad_value: int, how: str = "error") -> dict[str, Column]:
    """input_ids, attention_mask, position_ids and loss_mask of a prompt with its response.

    The loss mask starts as the attention mask; places before the last prompt token and
    the last response token become 0, since each token predicts the next.
    """
    if how not in ("left", "right", "error"):
        raise ValueError(f"unknown way to cut {how!r}")
    p, r = _c(prompt), _c(response)
    whole = F.concat(p, r)
    ids = truncate(pad(whole, max_length, F.lit(pad_value).cast("bigint")), max_length, how)
    mask = truncate(pad(F.transform(whole, lambda x: F.lit(1)), max_length, 0), max_length, "left" if how == "left" else "right")
    np_, nr = F.size(p), F.size(r)
    end = F.least(np_ + nr, F.lit(max_length)) - 1
    loss = F.transform(mask, lambda m, i: F.when((np_ > 1) & (i < F.least(np_, F.lit(max_length)) - 1), 0).when(i == end, 0).otherwise(m))
    return {"input_ids": ids, "attention_mask": mask, "position_ids": position_ids(mask), "loss_mask": loss}


def chat_rows(turns: DataFrame, conv="conv_id", turn="turn", role="role", tokens="tokens", prefix: int = 0) -> DataFrame:
    """(conv, input_ids, loss_mask, position_ids) of conversations given one row a message with its tokens.

    Messages are joined in turn order; only assistant tokens bear loss, less the first
    ``prefix`` ones, which are the generation prompt.
    """
    part = F.struct(F.col(turn), F.col(role), F.col(tokens))
    whole = turns.groupBy(conv).agg(F.sort_array(F.collect_list(part)).alias("m"))
    ids = F.flatten(F.transform("m", lambda m: m[tokens]))
    loss = F.flatten(F.transform("m", lambda m: F.transform(m[tokens], lambda t, i: F.when((m[role] == "assistant") & (i >= prefix), 1).otherwise(0))))
    return whole.select(conv, ids.alias("input_ids"), loss.alias("loss_mask")).withColumn("position_ids", F.transform("input_ids", lambda t, i: i))


def template_prefixes(once, twice, prompted) -> dict[str, Column]:
    """``system`` and ``generation``: the tokens that a chat template puts before all messages and before an answer.

    Given are the template's tokens for one empty user message, for two of them, and for
    one with the generation prompt.  What the second message adds is a message's length;
    what stands before the first one is the system prompt, empty if there is none.
    """
    a, b, c = _c(once), _c(twice), _c(prompted)
    return {"system": F.slice(a, 1, F.greatest(F.lit(0), 2 * F.size(a) - F.size(b))), "generation": F.slice(c, F.size(a) + 1, F.size(c))}


def cut_request(ids, response_start, max_model: int, max_response: int) -> Column:
    """The tokens of a request cut to the model's length and its response to its own limit."""
    return F.slice(_c(ids), 1, F.least(F.lit(max_model), _c(response_start) + max_response))


def reward_at_end(length, width: int, score) -> Column:
    """An array of ``width`` zeros with the score at the last valid place (none for length 0)."""
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.when(i == _c(length) - 1, _c(score).cast("double")).otherwise(F.lit(0.0)))


def preference_pair(chosen: Column, rejected: Column, length: int, value: int) -> Column:
    """Chosen and rejected token arrays padded (and cut) to one length, as a pair."""
    one = lambda c: truncate(pad(c, length, F.lit(value).cast("bigint")), length, "right")
    return F.array(one(chosen), one(rejected))


def to_padded(ids, width: int, value) -> Column:
    """A ragged array padded on the right."""
    return pad(ids, width, value)


def pooled(vectors, mask, how: str = "mean") -> Column:
    """A vector from token vectors: the masked mean, or the first token's (``cls``)."""
    if how == "cls":
        return F.get(_c(vectors), 0)
    if how != "mean":
        raise ValueError(f"unknown pooling {how!r}")
    rows = kept(vectors, mask)
    n = F.size(rows)
    total = F.aggregate(rows, F.transform(F.get(_c(vectors), 0), lambda x: F.lit(0.0)), lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    return F.transform(total, lambda x: F.try_divide(x, n.cast("double")))
