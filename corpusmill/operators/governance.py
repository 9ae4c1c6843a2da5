"""Split hygiene: manifests, duplicates, overlaps, leakage and audit reports.

Tables of prompts hold (key, problem_id, sha256, idx): ``key`` names a split of a dataset,
``idx`` is the order in which rows came.  Everything works on hashes, so texts travel once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import canonical_prompt


def manifest(rows: DataFrame, prompt="prompt", keep: list[str] = ("key", "problem_id", "idx"), version: str = "") -> DataFrame:
    """The kept columns with sha256, prompt_length, canonical_length and version."""
    c = canonical_prompt(prompt)
    return rows.select(*keep, F.sha2(c, 256).alias("sha256"), F.length(F.coalesce(F.col(prompt), F.lit(""))).cast("bigint").alias("prompt_length"), F.length(c).cast("bigint").alias("canonical_length"), F.lit(version).alias("version"))


def mark_duplicates(rows: DataFrame, by: list[str] = ("key", "sha256"), order: str = "idx") -> DataFrame:
    """Adds ``copy``: 1 for the first row of equal ones, 2, 3 ... for the others."""
    return rows.withColumn("copy", F.row_number().over(Window.partitionBy(*by).orderBy(order)))


def first_of_each(rows: DataFrame, by: list[str] = ("key", "sha256"), order: str = "idx") -> DataFrame:
    """The first row of each group of equal ones, by an aggregate (a hot hash costs a row a task), not a window."""
    others = [c for c in rows.columns if c not in by and c != order]
    best = F.min_by(F.struct(order, *others), F.col(order)) if others else F.struct(F.min(order).alias(order))
    return rows.groupBy(*by).agg(best.alias("__b")).select(*by, "__b.*").select(*rows.columns)


def cross_overlaps(rows: DataFrame, group: Column | None = None) -> DataFrame:
    """(key_a, key_b, sha256): hashes found under two keys (of one group, where given), both ways round.

    Hashes are first reduced to one row a key, so a hot hash meets at most the number of
    keys.
    """
    each = rows.select("key", "sha256", *([group.alias("grp")] if group is not None else [])).distinct()
    a, b = each.alias("a"), each.alias("b")
    cond = (F.col("a.sha256") == F.col("b.sha256")) & (F.col("a.key") != F.col("b.key"))
    if group is not None:
        cond = cond & (F.col("a.grp") == F.col("b.grp"))
    return a.join(b, cond).select(F.col("a.key").alias("key_a"), F.col("b.key").alias("key_b"), F.col("a.sha256").alias("sha256"))


def leakage(rows: DataFrame, train: Column, external: DataFrame) -> DataFrame:
    """(key, external_key, sha256): hashes of training rows that an external set holds too."""
    t = rows.filter(train).select("key", "sha256").distinct()
    e = external.select(F.col("key").alias("external_key"), "sha256").distinct()
    return t.join(e, "sha256").select("key", "external_key", "sha256")


def remove_overlaps(rows: DataFrame, overlaps: DataFrame, leaks: DataFrame, priority: list[str]) -> DataFrame:
    """The rows without hashes that a key of higher priority (earlier in the list) holds, and without leaked ones.

    Keys not in the list come last; of two with the same rank both keep the hash.
    """
    rank = lambda c: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, priority)), c), F.lit(0)), F.lit(1000))
    lost = overlaps.filter(rank(F.col("key_a")) > rank(F.col("key_b"))).select(F.col("key_a").alias("key"), "sha256")
    return rows.join(lost.unionByName(leaks.select("key", "sha256")).distinct(), ["key", "sha256"], "left_anti").select(*rows.columns)


def semi(rows: DataFrame, ids: DataFrame, key: str = "problem_id") -> DataFrame:
    """Rows whose id the other table holds; repeated ids there change nothing."""
    return rows.join(ids.select(key).distinct(), key, "left_semi").select(*rows.columns)


def anti(rows: DataFrame, ids: DataFrame, key: str = "problem_id") -> DataFrame:
    """Rows whose id the other table does not hold; a null id is held by none."""
    return rows.join(ids.select(key).distinct(), key, "left_anti").select(*rows.columns)


def seeded(seed: int, *cols) -> Column:
    """A text that orders rows at random, the same in every engine with SHA-256."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]), 256)


def prefix_sample(rows: DataFrame, prefix: str, size: int, seed: int, key: str = "problem_id") -> DataFrame:
    """``size`` distinct ids that start with the prefix, by seeded hash; too few are an error when read."""
    ids = rows.filter(F.col(key).startswith(prefix)).select(key).distinct()
    n = ids.agg(F.count(F.lit(1)).alias("__n"))
    picked = ids.orderBy(seeded(seed, key), key).limit(size)
    return picked.join(F.broadcast(n)).withColumn(key, F.when(F.col("__n") < size, F.raise_error(F.lit("not enough candidates"))).otherwise(F.col(key))).select(key)  # a one-row table


def check_manifest(rows: DataFrame) -> DataFrame:
    """One row a key: rows, distinct hashes and ids, empty prompts, surplus rows."""
    n = F.count(F.lit(1))
    return rows.groupBy("key").agg(
        n.alias("rows"),
        F.count_distinct("sha256").alias("distinct_hashes"),
        F.count_distinct("problem_id").alias("distinct_ids"),
        F.count_if(F.coalesce(F.col("canonical_length"), F.lit(0)) == 0).alias("empty_prompts"),
        (n - F.count_distinct("sha256")).alias("surplus"),
    )


def repeated(rows: DataFrame, column: str) -> DataFrame:
    """(key, value, n) of values that a key holds more than once."""
    return rows.groupBy("key", F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def audit(rows: DataFrame, priority: list[str], external: DataFrame | None = None, train: Column | None = None, group: Column | None = None) -> DataFrame:
    """One row a key: rows before, duplicates within, removed across, rows after."""
    unique = first_of_each(rows)
    over = cross_overlaps(unique, group)
    leaks = leakage(unique, train, external) if external is not None else over.select(F.col("key_a").alias("key"), F.col("key_b").alias("external_key"), "sha256").filter(F.lit(False))
    after = remove_overlaps(unique, over, leaks, priority)
    count = lambda d, n: d.groupBy("key").agg(F.count(F.lit(1)).alias(n))
    out = count(rows, "before").join(count(unique, "unique_rows"), "key").join(count(after, "after"), "key", "left")
    after_n = F.coalesce("after", F.lit(0).cast("bigint"))
    return out.select("key", "before", (F.col("before") - F.col("unique_rows")).alias("intra_duplicates"), (F.col("unique_rows") - after_n).alias("cross_removed"), after_n.alias("after"))


def unique_ids(rows: DataFrame, key: str = "problem_id") -> DataFrame:
    """The rows; a null, blank or repeated id raises an error when they are read."""
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    bad = F.col(key).isNull() | (F.trim(F.col(key)) == "") | (n > 1)
    return rows.withColumn(key, F.when(bad, F.raise_error(F.lit("ids must be unique and not empty"))).otherwise(F.col(key)))


def contest_name_key(name: Column) -> Column:
    """The contest number and problem letter that a name starts with (``1018_A. ...``), as ``1018_a``; null without."""
    return F.when(name.rlike(r"^\s*[0-9]+_[A-Za-z][0-9]*\."), F.lower(F.regexp_extract(name, r"^\s*([0-9]+_[A-Za-z][0-9]*)\.", 1)))


def drop_named(rows: DataFrame, name: str, evaluation: DataFrame, eval_name: str, source: Column | None = None) -> DataFrame:
    """Rows (of the given source only) whose name names no evaluation problem; rows of other sources stay."""
    banned = evaluation.select(contest_name_key(F.col(eval_name)).alias("__k")).filter("__k IS NOT NULL").distinct()
    keyed = rows.withColumn("__k", F.when(source if source is not None else F.lit(True), contest_name_key(F.col(name))))
    return keyed.join(banned, "__k", "left_anti").drop("__k")


def splits_by_ratio(rows: DataFrame, shares: dict[str, float], seed: int, *key: str) -> DataFrame:
    """Adds ``split`` by the place of a seeded hash in [0, 1): about the shares, stable as rows are added."""
    u = F.conv(F.substring(seeded(seed, *key), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    total, edge, out = sum(shares.values()), 0.0, None
    names = list(shares)
    for name in names[:-1]:
        edge += shares[name] / total
        out = F.when(u < edge, name) if out is None else out.when(u < edge, name)
    return rows.withColumn("split", out.otherwise(names[-1]) if out is not None else F.lit(names[0]))
