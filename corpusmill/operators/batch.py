"""Columnar batch algebra over rows with an explicit ordinal ``idx`` (0-based, unique).

Row order means something here, so it is a column; nothing relies on the physical order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

IDX = "idx"


def from_rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A batch of literal rows under an explicit schema, numbered in the given order."""
    return spark.createDataFrame([(i, *[r.get(c.split()[0]) for c in schema.split(", ")]) for i, r in enumerate(rows)], f"{IDX} bigint, {schema}")


def info(batch: DataFrame) -> DataFrame:
    """One row: number of rows, smallest and largest ordinal, and the column names."""
    return batch.agg(F.count(F.lit(1)).alias("rows"), F.min(IDX).alias("first"), F.max(IDX).alias("last")).withColumn("columns", F.lit(",".join(batch.columns)))


def check_numbering(batch: DataFrame) -> DataFrame:
    """One row: whether the ordinals are 0..n-1 without gap or repetition."""
    return batch.agg((F.coalesce(F.min(IDX), F.lit(0)) == 0).alias("a"), (F.coalesce(F.max(IDX), F.lit(-1)) + 1 == F.count(F.lit(1))).alias("b"), (F.count_distinct(IDX) == F.count(F.lit(1))).alias("c")).select((F.col("a") & F.col("b") & F.col("c")).alias("ok"))


def same(a: DataFrame, b: DataFrame) -> bool:
    """Whether two batches hold the same rows (NaN equals NaN, null equals null); schemas must match."""
    return a.schema.simpleString() == b.schema.simpleString() and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def _need(batch: DataFrame, names: list[str]) -> None:
    missing = [n for n in names if n not in batch.columns]
    if missing:
        raise KeyError(f"no such columns: {missing}")


def select(batch: DataFrame, names: list[str]) -> DataFrame:
    """The named columns (and the ordinal); an unknown name is an error."""
    _need(batch, names)
    return batch.select(IDX, *[n for n in names if n != IDX])


def pop(batch: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """(the named columns, the rest), both with the ordinal."""
    _need(batch, names)
    return select(batch, names), batch.drop(*[n for n in names if n != IDX])


def rename(batch: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns under new names; unknown ones and clashes are errors."""
    _need(batch, list(names))
    after = [names.get(c, c) for c in batch.columns]
    if len(set(after)) < len(after):
        raise ValueError("two columns would have one name")
    return batch.withColumnsRenamed(names)


def assign(batch: DataFrame, **values) -> DataFrame:
    """The batch with columns set to constants."""
    return batch.withColumns({k: F.lit(v) for k, v in values.items()})


def take(batch: DataFrame, order: DataFrame) -> DataFrame:
    """Rows picked by ``order`` (pos, idx), repetitions kept, numbered by ``pos``; positions without a row vanish."""
    picks = order.select(F.col("pos").alias("__pos"), F.col(IDX).alias("__idx"))
    return batch.join(picks, batch[IDX] == picks["__idx"]).drop(IDX, "__idx").withColumnRenamed("__pos", IDX).select(*batch.columns)


def take_list(batch: DataFrame, indices: list[int]) -> DataFrame:
    """``take`` of a driver-side list."""
    order = batch.sparkSession.createDataFrame(list(enumerate(indices)), f"pos bigint, {IDX} bigint")
    return take(batch, order)


def where(batch: DataFrame, keep: Column) -> DataFrame:
    """Rows that a boolean keeps, ordinals unchanged; null does not keep."""
    return batch.filter(keep)


def slice_rows(batch: DataFrame, start: int | None = None, stop: int | None = None, step: int = 1, size: int | None = None) -> DataFrame:
    """Rows start:stop:step by ordinal; negative bounds need the batch's ``size``."""
    if step < 1:
        raise ValueError("the step must be positive")
    if min(start or 0, stop or 0) < 0 and size is None:
        raise ValueError("negative bounds need the size")
    a = (start or 0) if (start or 0) >= 0 else max(0, size + start)
    out = batch.filter(F.col(IDX) >= a)
    if stop is not None:
        out = out.filter(F.col(IDX) < (stop if stop >= 0 else size + stop))
    return out.filter((F.col(IDX) - a) % step == 0) if step > 1 else out


def reorder(batch: DataFrame, permutation: DataFrame) -> DataFrame:
    """Row ``idx`` moves to ``pos``; ``permutation`` holds (pos, idx)."""
    return take(batch, permutation)


def inverse(permutation: DataFrame) -> DataFrame:
    """The permutation that undoes another."""
    return permutation.select(F.col(IDX).alias("pos"), F.col("pos").alias(IDX))


def zip_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Columns of both batches side by side, row by ordinal.

    Columns of both must hold equal values (NaN equals NaN, null equals null), and both
    must have the same ordinals; anything else raises an error when the result is read.
    """
    common = [c for c in a.columns if c in b.columns and c != IDX]
    right = b.select(F.col(IDX).alias("__idx"), *[F.col(c).alias(f"__r_{c}") if c in common else F.col(c) for c in b.columns if c != IDX])
    j = a.join(right, a[IDX] == right["__idx"], "full_outer")
    ok = F.col(IDX).isNotNull() & F.col("__idx").isNotNull()
    for c in common:
        ok = ok & F.col(c).eqNullSafe(F.col(f"__r_{c}"))
    checked = F.when(ok, F.col(IDX)).otherwise(F.raise_error(F.lit("the batches do not agree")).cast("bigint"))
    return j.withColumn(IDX, checked).select(*a.columns, *[c for c in b.columns if c not in a.columns])


def concat(parts: list[DataFrame], sizes: list[int]) -> DataFrame:
    """Batches one after the other, renumbered; the columns must be the same set."""
    out, start = None, 0
    for part, size in zip(parts, sizes):
        moved = part.withColumn(IDX, F.col(IDX) + start)
        out = moved if out is None else out.unionByName(moved)
        start += size
    return out


def merge_meta(metas: list[dict]) -> dict:
    """The side information of concatenated batches: equal values stay, ``metrics`` become lists by name.

    Any other difference is an error.
    """
    out: dict = {}
    metrics: dict[str, list] = {}
    for meta in metas:
        for k, v in meta.items():
            if k == "metrics":
                for one in v if isinstance(v, list) else [v]:
                    for name, value in one.items():
                        metrics.setdefault(name, []).append(value)
            elif k in out and out[k] != v:
                raise ValueError(f"the batches disagree about {k!r}")
            else:
                out[k] = v
    return out | ({"metrics": metrics} if metrics else {})


def chunk(batch: DataFrame, n: int, size: int, even: bool = False, pad: bool = False) -> DataFrame:
    """Adds ``chunk``: n runs of rows of ceil(size / n); with ``even`` the first size % n runs are one longer.

    Without ``pad``, a size that n does not divide is an error, unless ``even`` is given.
    """
    if size % n and not (pad or even):
        raise ValueError("the chunks do not divide the rows")
    i = F.col(IDX)
    if even:
        q, r = divmod(size, n)
        edge = r * (q + 1)
        return batch.withColumn("chunk", F.when(i < edge, F.floor(i / (q + 1))).otherwise(r + F.floor((i - edge) / max(q, 1))).cast("bigint"))
    return batch.withColumn("chunk", F.floor(i / -(-size // n)).cast("bigint"))


def split(batch: DataFrame, size: int) -> DataFrame:
    """Adds ``chunk``: runs of ``size`` rows, the last may be short."""
    return batch.withColumn("chunk", F.floor(F.col(IDX) / size).cast("bigint"))


def repeat(batch: DataFrame, times: int, interleave: bool = True, size: int | None = None) -> DataFrame:
    """Every row ``times`` times: AABB, or ABAB (then the batch's ``size`` is needed)."""
    r = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(times - 1).cast("bigint")))
    out = batch.withColumn("__r", r) if times > 0 else batch.withColumn("__r", F.lit(0).cast("bigint")).filter(F.lit(False))
    idx = F.col(IDX) * times + F.col("__r") if interleave else F.col("__r") * F.lit(size) + F.col(IDX)
    return out.withColumn(IDX, idx).drop("__r")


def repeat_each(batch: DataFrame, times: str) -> DataFrame:
    """Every row as often as its column ``times`` says (0 and null drop it), with ``copy`` from 0."""
    return batch.filter(F.col(times) > 0).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), (F.col(times) - 1).cast("bigint"))))


def unfold_columns(batch: DataFrame, n: int, columns: list[str]) -> DataFrame:
    """Array columns cut into n equal stretches, a row each; the other columns repeat."""
    length = F.size(columns[0])
    step = F.when(length % n == 0, length / n).otherwise(F.raise_error(F.lit("the stretches do not divide the array"))).cast("int")
    out = batch.withColumn("__n", step).withColumn("__r", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    cut = {c: F.slice(c, F.col("__r") * F.col("__n") + 1, F.col("__n")) for c in columns}
    return out.withColumns(cut).withColumn(IDX, F.col(IDX) * n + F.col("__r")).drop("__n", "__r")


def fold(batch: DataFrame, k: int, column: str) -> DataFrame:
    """k consecutive rows as one, their values as an array in row order."""
    rows = batch.groupBy(F.floor(F.col(IDX) / k).cast("bigint").alias("__g")).agg(F.sort_array(F.collect_list(F.struct(IDX, column))).alias("__v"))
    return rows.select(F.col("__g").alias(IDX), F.transform("__v", lambda x: x[column]).alias(column))


def unfold(batch: DataFrame, k: int, column: str) -> DataFrame:
    """An array column of k values back to k rows."""
    return batch.select(F.col(IDX), F.posexplode(column).alias("__p", column)).select((F.col(IDX) * k + F.col("__p")).alias(IDX), column)


def pad_to_divisor(batch: DataFrame, divisor: int, size: int) -> tuple[DataFrame, int]:
    """The batch with rows from its head repeated at the end until ``divisor`` divides it, and how many were added."""
    extra = -size % divisor
    if not extra or not size:
        return batch, extra if size else 0
    rounds = -(-extra // size)
    copies = batch.withColumn("__r", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(rounds).cast("bigint")))).withColumn(IDX, F.col("__r") * size + F.col(IDX)).drop("__r")
    return batch.unionByName(copies.filter(F.col(IDX) < size + extra)), extra


def unpad(batch: DataFrame, extra: int, size: int) -> DataFrame:
    """The batch without its last ``extra`` rows; ``size`` counts the padded rows."""
    return batch.filter(F.col(IDX) < size - extra)


def pad_with(batch: DataFrame, n: int, size: int, last: bool = False) -> DataFrame:
    """n copies of the first (or last) row appended."""
    edge = batch.filter(F.col(IDX) == (size - 1 if last else 0))
    copies = edge.withColumn(IDX, F.explode(F.sequence(F.lit(size).cast("bigint"), F.lit(size + n - 1).cast("bigint"))))
    return batch.unionByName(copies) if n > 0 else batch


def minibatches(batch: DataFrame, size: int, epochs: int, rows: int, seed: int | None = None) -> DataFrame:
    """Every row once an epoch with its ``epoch`` and ``step``; with a seed, shuffled by a hash anew each epoch.

    ``size`` must divide the number of rows.  The shuffle ranks rows within hash cells.
    """
    from corpusmill.functions.ranking import ranked

    if rows % size:
        raise ValueError("the mini-batch size does not divide the batch")
    each = batch.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(epochs - 1).cast("bigint"))))
    if seed is None:
        return each.withColumn("step", F.floor(F.col(IDX) / size).cast("bigint"))
    keyed = each.withColumn("__h", F.xxhash64(F.lit(seed), "epoch", IDX))
    return ranked(keyed, ["epoch"], ["__h", IDX], "__k").withColumn("step", F.floor(F.col("__k") / size).cast("bigint")).drop("__h", "__k")


def set_relations(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: sizes of two id sets, of their union, intersection and differences, and whether disjoint or subset."""
    both = a.select(F.col(key).alias("k")).distinct().withColumn("a", F.lit(1)).unionByName(b.select(F.col(key).alias("k")).distinct().withColumn("b", F.lit(1)), allowMissingColumns=True)
    per = both.groupBy("k").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    n = lambda c: F.count_if(c).alias
    a_, b_ = F.col("a").isNotNull(), F.col("b").isNotNull()
    out = per.agg(n(a_)("size_a"), n(b_)("size_b"), F.count(F.lit(1)).alias("size_union"), n(a_ & b_)("size_both"), n(a_ & ~b_)("only_a"), n(b_ & ~a_)("only_b"))
    return out.withColumns({"disjoint": F.col("size_both") == 0, "a_in_b": F.col("only_a") == 0})


def map_chunks(batch: DataFrame, workers: int, fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Applies ``fn`` to the batch spread over ``workers`` partitions by ordinal; the rows come back with their ordinals."""
    return fn(batch.repartition(workers, F.col(IDX)))


def one_to_all(batch: DataFrame, workers: int) -> DataFrame:
    """Every row for each of ``workers`` workers: adds ``worker``."""
    return batch.withColumn("worker", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(workers - 1).cast("bigint"))))


def to_mesh(batch: DataFrame, groups: list[int], size: int) -> DataFrame:
    """Rows for the workers of a mesh: adds ``worker``; ``groups`` names each worker's data group.

    The batch is cut into as many runs as there are groups, padded with rows from its head
    where they do not divide it (``padding`` marks these); every worker of a group gets
    the group's run.
    """
    n = max(groups) + 1
    whole, _ = pad_to_divisor(batch, n, size)
    cut = chunk(whole, n, size + -size % n).withColumn("padding", F.col(IDX) >= size)
    workers = F.array(*[F.array(*[F.lit(w).cast("bigint") for w, g in enumerate(groups) if g == k]) for k in range(n)])
    return cut.withColumn("worker", F.explode(F.get(workers, F.col("chunk").cast("int")))).drop("chunk")


def from_mesh(outputs: DataFrame, collects: list[bool]) -> DataFrame:
    """What the workers that ``collects`` names give back, padding left out: one row an ordinal."""
    kept = [w for w, yes in enumerate(collects) if yes]
    return outputs.filter(F.col("worker").isin(kept) & ~F.col("padding")).drop("worker", "padding")
