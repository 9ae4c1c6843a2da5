"""Limits, orders, samples and balanced partitions of batches."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.operators.governance import seeded


def first_rows(rows: DataFrame, n: int, order: str = "idx") -> DataFrame:
    """The first n rows by ordinal: a top-n, not a sort of everything."""
    return rows.orderBy(order).limit(n)


def seeded_rows(rows: DataFrame, n: int, seed: int, key: str = "idx") -> DataFrame:
    """n rows by seeded hash, the same in every run and engine."""
    return rows.orderBy(seeded(seed, key), key).limit(n)


def capped_then_filtered(rows: DataFrame, n: int, keep: Column, seed: int | None = None, key: str = "idx") -> DataFrame:
    """The sample cap first, the filter after it: fewer than n rows may remain."""
    return (seeded_rows(rows, n, seed, key) if seed is not None else first_rows(rows, n, key)).filter(keep)


def ordered(rows: DataFrame, how: str, seed: int = 0, difficulty: str | None = None, key: str = "idx") -> DataFrame:
    """Adds ``place``: the order in which a sampler visits rows: sequential, random (by seed) or curriculum (by difficulty).

    The sequential place is the ordinal.  The random one goes by the first 52 bits of
    SHA-256 over seed and key, the curriculum's by difficulty, ascending with nulls first,
    then by the key, a unique number.  Both rank within value ranges, so that no task
    orders the whole table or a whole level.
    """
    from corpusmill.functions.ranking import ranked_in_order

    if how == "sequential":
        return rows.withColumn("place", F.col(key))
    if how == "random":
        hashed = rows.withColumn("__h", F.conv(F.substring(seeded(seed, key), 1, 13), 16, 10).cast("bigint"))
        return ranked_in_order(hashed, "__h", "place", ties=[key]).drop("__h")
    if how != "curriculum":
        raise ValueError(f"unknown sampler {how!r}")
    return ranked_in_order(rows, key, "place", by=[difficulty], across=True)


def qa_sample(records: DataFrame, size: int, least: int, seed: int, dataset="dataset", kind="error_type", problem="problem_id", key="record_id") -> DataFrame:
    """Records to look at, per dataset: ``least`` of every failure type, all of few successes, the rest failures first.

    A problem appears once.  Within each group records come by seeded hash.  All ranks are
    taken of at most ``size`` rows a dataset and type, kept by a first ranking in hash
    cells, so large groups are not sorted in one task.
    """
    t = F.coalesce(kind, F.lit("none"))
    base = records.withColumn("__t", t).withColumn("__h", seeded(seed, key))
    one = base.groupBy(dataset, problem, "__t").agg(F.min(F.struct("__h", key)).alias("__m")).select(dataset, problem, "__t", F.col("__m.__h").alias("__h"), F.col(f"__m.{key}").alias(key))
    cell = F.pmod(F.xxhash64(key), F.lit(64))
    few = one.withColumn("__r", F.row_number().over(Window.partitionBy(dataset, "__t", cell).orderBy("__h", key))).filter(F.col("__r") <= size)
    few = few.withColumn("__r", F.row_number().over(Window.partitionBy(dataset, "__t").orderBy("__h", key))).filter(F.col("__r") <= size)
    n_ok = F.sum(F.when(F.col("__t") == "success", 1).otherwise(0)).over(Window.partitionBy(dataset))
    fail = F.col("__t") != "success"
    tier = F.when(fail & (F.col("__r") <= least), 0).when(~fail & (n_ok <= least), 1).when(fail, 2).otherwise(3)
    tiered = few.withColumn("__tier", tier)
    once = tiered.withColumn("__p", F.row_number().over(Window.partitionBy(dataset, problem).orderBy("__tier", "__h", key))).filter("__p = 1")
    place = F.row_number().over(Window.partitionBy(dataset).orderBy("__tier", "__h", key))
    kept = once.withColumn("__place", place).filter((F.col("__tier") == 0) | (F.col("__place") <= size))
    return kept.select(dataset, problem, key, F.col("__t").alias("kind"), F.col("__tier").alias("tier"))


def generations_to_log(rows: DataFrame, n: int, seed: int = 42, column: str = "input") -> DataFrame:
    """n generations by seeded hash of their input."""
    return rows.orderBy(seeded(seed, column), column).limit(n)


def ordinal_split(rows: DataFrame, share: float, size: int, key: str = "idx") -> DataFrame:
    """Adds ``split``: the first ``share`` of the ordinals is train, the rest test."""
    return rows.withColumn("split", F.when(F.col(key) < int(size * share), "train").otherwise("test"))


def workload(length) -> Column:
    """Cost of a sequence: 24576 n + n^2 (a linear and an attention part)."""
    n = (F.col(length) if isinstance(length, str) else length).cast("bigint")
    return n * 24576 + n * n


class _Bins:
    """k bins with sums and items, largest first."""

    __slots__ = ("bins",)

    def __init__(self, bins: list[tuple[int, tuple[tuple[int, int], ...]]]):
        self.bins = sorted(bins, key=self.rank, reverse=True)

    @staticmethod
    def rank(b):
        return b[0], len(b[1]), b[1]

    def joined(self, other: _Bins) -> _Bins:
        return _Bins([(a[0] + b[0], a[1] + b[1]) for a, b in zip(self.bins, reversed(other.bins))])

    def __lt__(self, other: _Bins) -> bool:
        mine, theirs = self.bins[0][0] - self.bins[-1][0], other.bins[0][0] - other.bins[-1][0]
        return mine > theirs if mine != theirs else self.rank(self.bins[0]) > other.rank(other.bins[0])


def differencing(values: list[int], k: int, equal: bool) -> list[list[int]]:
    """k groups of indices with near-equal sums, by the largest differencing method; indices ascend in each group.

    ``equal`` gives every group the same number of items, which k must divide.
    """
    if len(values) < k or (equal and len(values) % k):
        raise ValueError("the items do not fill the groups")
    order = sorted(range(len(values)), key=lambda i: (values[i], i))
    step = k if equal else 1
    heap = []
    for a in range(0, len(order), step):
        some = order[a : a + step]
        heap.append(_Bins([(values[i], ((i, values[i]),)) for i in some] + [(0, ())] * (k - len(some))))
    heapq.heapify(heap)
    while len(heap) > 1:
        first = heapq.heappop(heap)
        heapq.heapreplace(heap, first.joined(heap[0]))
    return [sorted(i for i, _ in items) for _, items in heap[0].bins]


def greedy_groups(values: list[int], k: int, equal: bool) -> list[list[int]]:
    """k groups: each item in turn to the group of least sum (of those not full, if ``equal``)."""
    room = len(values) // k if equal else len(values)
    sums, groups = [0] * k, [[] for _ in range(k)]
    for i, v in enumerate(values):
        g = min((j for j in range(k) if len(groups[j]) < room), key=lambda j: sums[j])
        sums[g] += v
        groups[g].append(i)
    return groups


def _grouped(rows: DataFrame, batch: str, key: str, columns: list[str], fn, schema: str) -> DataFrame:
    kinds = dict(rows.dtypes)
    full = f"{batch} {kinds[batch]}, {key} {kinds[key]}, {schema}"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key).reset_index(drop=True)
        return pdf[[batch, key]].assign(**fn(pdf))

    return rows.select(batch, key, *columns).groupBy(batch).applyInPandas(run, full)


def balanced(rows: DataFrame, k: int, length="length", batch="batch", key="idx", equal: bool = True, method: str = "differencing") -> DataFrame:
    """(batch, idx, part): each training batch cut into k parts of near-equal workload.

    One batch is one group; batches are bounded by training, and different ones are
    balanced in parallel.
    """
    algorithm = {"differencing": differencing, "greedy": greedy_groups}[method]

    def fn(pdf):
        part = [0] * len(pdf)
        for p, members in enumerate(algorithm([int(x) for x in pdf["__w"]], k, equal)):
            for i in members:
                part[i] = p
        return {"part": part}

    return _grouped(rows.withColumn("__w", workload(length)), batch, key, ["__w"], fn, "part bigint")


def balanced_groups(rows: DataFrame, k: int, length="length", uid="uid", batch="batch", key="idx") -> DataFrame:
    """(batch, idx, part): as ``balanced``, but runs of consecutive rows with one uid stay together."""

    def fn(pdf):
        run = (pdf[uid] != pdf[uid].shift()).cumsum() - 1
        sums = pdf.groupby(run)["__w"].sum().astype(int).tolist()
        part = [0] * len(sums)
        for p, members in enumerate(differencing(sums, k, True)):
            for g in members:
                part[g] = p
        return {"part": [part[g] for g in run]}

    return _grouped(rows.withColumn("__w", workload(length)), batch, key, ["__w", uid], fn, "part bigint")


def micro_batches(rows: DataFrame, max_tokens: int, length="length", batch="batch", key="idx", least: int = 1, multiple: int = 1, by_cost: bool = True) -> DataFrame:
    """(batch, idx, micro): micro-batches of at most about ``max_tokens`` tokens, small ones at both ends.

    Their number is ceil(tokens / max_tokens), at least ``least``, rounded up to a
    ``multiple``.  A sequence longer than the limit is an error.
    """

    def fn(pdf):
        lengths = [int(x) for x in pdf[length]]
        if max(lengths, default=0) > max_tokens:
            raise ValueError("a sequence exceeds the token limit")
        n = max(least, min(len(lengths), -(-sum(lengths) // max_tokens)))
        n = -(-n // multiple) * multiple
        cost = [int(x) for x in pdf["__w"]]
        groups = differencing(cost, n, False)
        if by_cost:
            groups.sort(key=lambda g: (sum(cost[i] for i in g), g[0] if g else 0), reverse=True)
            groups = groups[::2][::-1] + groups[1::2]
        micro = [0] * len(lengths)
        for m, members in enumerate(groups):
            for i in members:
                micro[i] = m
        return {"micro": micro}

    return _grouped(rows.withColumn("__w", workload(length)), batch, key, [length, "__w"], fn, "micro bigint")


def micro_batch_count(rows: DataFrame, max_tokens: int, length="length", batch="batch") -> DataFrame:
    """(batch, n): how many micro-batches ``micro_batches`` would start from."""
    n = F.least(F.count(F.lit(1)), F.ceil(F.sum(length) / max_tokens))
    return rows.groupBy(batch).agg(n.cast("bigint").alias("n"))


def balance_order(parts: DataFrame, length="length", batch="batch", key="idx") -> DataFrame:
    """Adds ``place`` within each part: by workload, even places ascending, then odd ones descending."""
    w = Window.partitionBy(batch, "part").orderBy(workload(length), key)
    r, n = F.row_number().over(w) - 1, F.count(F.lit(1)).over(Window.partitionBy(batch, "part"))
    evens = F.floor((n + 1) / 2)
    return parts.withColumn("place", F.when(r % 2 == 0, F.floor(r / 2)).otherwise(evens + F.floor((n - 1 - r) / 2 + F.when(n % 2 == 0, 0.0).otherwise(-0.5))).cast("bigint"))


def group_filter(rows: DataFrame, metric="score", uid="uid", keep_single: bool = False) -> DataFrame:
    """Rows of groups whose metric varies; a group of one varies not, unless ``keep_single``."""
    w = Window.partitionBy(uid)
    vary = F.max(metric).over(w) != F.min(metric).over(w)
    return rows.withColumn("__v", vary | (F.lit(keep_single) & (F.count(F.lit(1)).over(w) == 1))).filter("__v").drop("__v")


def prefix_groups(rows: DataFrame, uid="uid", batch="batch", key="idx") -> DataFrame:
    """(batch, grp, uid, first_idx, rows): runs of consecutive rows with one uid, each run's prompt once."""
    w = Window.partitionBy(batch).orderBy(key)
    fresh = F.when(F.col(uid).eqNullSafe(F.lag(uid).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    numbered = rows.withColumn("__new", fresh).withColumn("grp", F.sum("__new").over(w) - 1)
    return numbered.groupBy(batch, "grp", uid).agg(F.min(key).alias("first_idx"), F.count(F.lit(1)).alias("rows"))


def dense_flops(length: str, parameters: float, layers: int, heads: int, head_dim: int) -> Column:
    """Aggregate: operations of a training step over sequences: 6 N a token and 12 * heads * dim * layers * n^2 of attention."""
    n = F.col(length).cast("double")
    return 6.0 * parameters * F.sum(n) + 12.0 * head_dim * heads * layers * F.sum(n * n)
