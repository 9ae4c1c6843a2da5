"""Problem 7: filling fixed-capacity containers (shortest-pack-first over the length histogram)."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.ranking import ranked
from corpusmill.functions.runtime import collect_bounded, cut
from corpusmill.llm.tokens import TOKENIZER, token_counts


def pack_patterns(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """(number of containers, item lengths) of each packing pattern.

    Lengths are placed longest first.  Items of a length go into the emptiest open
    containers that take them, all containers of one pattern at once; where none is open,
    new ones are.  The work follows the number of lengths and patterns, not of items.
    """
    open_: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
    spaces = np.zeros(capacity + 1, bool)
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} does not fit a container of {capacity}")
        while left:
            fits = np.flatnonzero(spaces[length:])
            if len(fits):
                space = int(fits[-1]) + length
                count, pattern = open_[space].pop()
                used = min(count, left)
                if count > used:
                    open_[space].append((count - used, pattern))
                spaces[space] = bool(open_[space])
            else:
                space, used, pattern = capacity, left, ()
            open_[space - length].append((used, (*pattern, length)))
            spaces[space - length] = space > length
            left -= used
    return [p for space in sorted(open_) for p in open_[space]]


def slot_table(patterns: list[tuple[int, tuple[int, ...]]]) -> dict[str, np.ndarray]:
    """Rank ranges of each length: (length, first rank, first container, offset), sorted."""
    rows, taken, base = [], defaultdict(int), 0
    for count, pattern in patterns:
        at = 0
        for length in pattern:
            rows.append((length, taken[length], base, at))
            taken[length] += count
            at += length
        base += count
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return {n: table[:, i] for i, n in enumerate(("length", "rank", "container", "offset"))}


def pieces_to_pack(counts: DataFrame, capacity: int, id_col: str = "doc_id") -> DataFrame:
    """(id, part, first_token, n_tokens): whole items, and larger ones cut into full containers and a rest."""
    n = F.col("n_tokens")
    part = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((n - 1) / capacity).cast("bigint")))
    first = (F.col("part") * capacity).cast("bigint")
    return counts.filter("n_tokens > 0").select(id_col, "n_tokens", part.alias("part")).select(id_col, "part", first.alias("first_token"), F.least(n - first, F.lit(capacity)).cast("bigint").alias("n_tokens"))


def pack(counts: DataFrame, capacity: int, id_col: str = "doc_id", max_slots: int = 4_000_000) -> DataFrame:
    """(container, offset, id, part, first_token, n_tokens): every item's place in a container.

    ``counts`` holds (id, n_tokens).  Items with null or no tokens need no place and are
    left out; an item is cut only if it is larger than a container.  The histogram has at
    most ``capacity`` rows and goes to the driver; the patterns come back as a table of
    rank ranges whose size is checked against ``max_slots``, and each item finds its place
    by its rank among the items of its length.  The result depends on the ids and lengths
    alone.  Ids must be unique; an empty table packs into nothing.
    """
    items = pieces_to_pack(counts, capacity, id_col)
    rows = collect_bounded(items.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")), capacity, "lengths")
    table = slot_table(pack_patterns({r["n_tokens"]: r["n"] for r in rows}, capacity))
    if len(table["rank"]) > max_slots:
        raise RuntimeError("the packing patterns exceed the bound of the broadcast table")
    shared = counts.sparkSession.sparkContext.broadcast(table)

    def place(batches):
        t = shared.value
        lengths, begins = np.unique(t["length"], return_index=True)
        ends = np.append(begins[1:], len(t["length"]))
        for batch in batches:
            length, rank = (np.asarray(batch.column(c).to_numpy(zero_copy_only=False)) for c in ("n_tokens", "rank"))
            slot = np.zeros(len(length), np.int64)
            for v in np.unique(length):
                k, rows_of = np.searchsorted(lengths, v), length == v
                slot[rows_of] = begins[k] + np.searchsorted(t["rank"][begins[k] : ends[k]], rank[rows_of], side="right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(t["container"][slot] + rank - t["rank"][slot]), pa.array(t["offset"][slot]), *(batch.column(c) for c in (id_col, "part", "first_token", "n_tokens"))], ["container", "offset", id_col, "part", "first_token", "n_tokens"])

    ranks = ranked(items, ["n_tokens"], [id_col, "part"])
    return ranks.mapInArrow(place, f"container bigint, offset bigint, {id_col} bigint, part bigint, first_token bigint, n_tokens bigint")


def pack_documents(documents: DataFrame, limits: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = TOKENIZER) -> DataFrame:
    """``pack`` for every pack limit of ``limits``; texts are tokenised once."""
    counts = cut(token_counts(documents, id_col, text_col, path))
    wanted = collect_bounded(limits.filter("purpose = 'pack' AND max_tokens > 0").select("limit_id", "max_tokens").orderBy("limit_id"), 100, "pack limits")
    out = None
    for r in wanted:
        part = pack(counts, r["max_tokens"], id_col).select(F.lit(r["limit_id"]).cast("bigint").alias("limit_id"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def fill_report(packed: DataFrame, limits: DataFrame) -> DataFrame:
    """Containers, items and the share of used space of each limit."""
    per = packed.groupBy("limit_id").agg(F.count_distinct("container").alias("containers"), F.count(F.lit(1)).alias("items"), F.sum("n_tokens").alias("tokens"))
    return per.join(limits.select("limit_id", "max_tokens"), "limit_id").withColumn("filled", F.col("tokens") / (F.col("containers") * F.col("max_tokens")))
