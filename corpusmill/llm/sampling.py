"""Problem 4: a reproducible sample that keeps its members as data grows (consistent weighted Poisson sampling)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.runtime import collect_bounded, shared_folder


#: Most sampling settings that are drawn for at once.
MOST_SETTINGS = 10_000


def problem_key(dataset, problem_id):
    """One spelling of a problem's id: judge/contest/problem for contest problems, else trimmed lower case.

    Null and blank ids have none.
    """
    s = F.lower(F.trim(F.regexp_replace(problem_id, r"\s+", " ")))
    # patterns over the whole id: one that does not match leaves it as it is
    front = r"^([a-z]+)(?:[^a-z0-9]+contest)?[^a-z0-9]*0*([0-9]+)(?:[^a-z0-9]+problem)?[^a-z0-9]*([a-z][0-9]*)$"
    back = r"^0*([0-9]+)[^a-z0-9]*([a-z][0-9]*)\..*\(\s*([a-z]+)\s*\)$"
    one = F.regexp_replace(F.regexp_replace(s, front, "$1/$2/$3"), back, "$3/$1/$2")
    contest = dataset.isin("code_contests") | dataset.startswith("codecontests")
    return F.when(s != "", F.when(contest, one).otherwise(s))


def unit_hash(seed, key):
    """A number in [0, 1) from a seed and a key, the same in every engine that has SHA-256."""
    digest = F.sha2(F.concat(F.coalesce(seed.cast("string"), F.lit("")), F.lit("|"), key), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def consistent_sample(rows: DataFrame, state: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(sample, state) of weighted Poisson sampling that never drops a member.

    ``rows`` holds (stratum, seed, key, version, weight, size, fraction): every arrival of
    an item, with the version it came under, the weight it adds, and its stratum's wanted
    expected size or fraction.  At each version the item's weight is the sum of what it
    has gathered, the constant is ``fraction``, or ``size`` over the weight of all items
    that had come by then (1 at most), and the inclusion probability is their product.
    The state stores, per item, the weight gathered and the running maximum of that
    probability; an item is in the sample when its hash is below the maximum.

    The maximum depends on the versions up to the item's own arrivals alone, so rows of
    later versions, in any order and partitioning, only ever add members.  With ``state``
    (stratum, seed, key, weight, chance; of an earlier call over the same strata) ``rows``
    need hold the arrivals of later versions only: weights go on from those stored, and
    the result is that of one call over all rows.  The maximum also survives the removal
    of rows.  A size above what a table offers selects everything.  Rows with a null
    stratum, key or version are left out, null and negative weights count as nothing; an
    arrival repeated must be removed by the caller.  Sizes are met in expectation: with W_0
    the weight before the first request, at most size * (1 + ln(W / W_0)).
    """
    clean = rows.filter("stratum IS NOT NULL AND key IS NOT NULL AND version IS NOT NULL").withColumn("weight", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)))
    arrivals = clean.groupBy("stratum", "seed", "key", "version", "size", "fraction").agg(F.sum("weight").alias("weight"), F.lit(0.0).alias("floor"))
    if state is not None:
        # what is stored came before every version; it asks for nothing anew
        before = state.select("stratum", "seed", "key", F.lit("").alias("version"), F.lit(None).cast("bigint").alias("size"), F.lit(None).cast("double").alias("fraction"), "weight", F.col("chance").alias("floor"))
        arrivals = arrivals.unionByName(before)
    # weights of whole versions first: the running total goes over versions, not over rows
    versions = arrivals.groupBy("stratum", "version").agg(F.sum("weight").alias("w"))
    totals = versions.select("stratum", "version", F.sum("w").over(Window.partitionBy("stratum").orderBy("version").rowsBetween(Window.unboundedPreceding, 0)).alias("total"))
    own = F.sum("weight").over(Window.partitionBy("stratum", "key").orderBy("version").rowsBetween(Window.unboundedPreceding, 0))
    # a stratum's totals, a row a version, are met by many rows: AQE splits such a join
    at = arrivals.withColumn("own", own).join(totals, ["stratum", "version"])
    rate = F.when(F.col("fraction").isNotNull(), F.col("fraction")).otherwise(F.try_divide(F.col("size").cast("double"), F.col("total")))
    chance = F.greatest("floor", F.least(F.lit(1.0), F.col("own") * F.least(F.lit(1.0), F.coalesce(rate, F.lit(0.0)))))
    fresh = at.withColumn("chance", chance).groupBy("stratum", "seed", "key").agg(F.max("own").alias("weight"), F.max("chance").alias("chance"))
    return selected(fresh), fresh


def selected(state: DataFrame) -> DataFrame:
    """The sample that a state stands for, with each item's hash ``u``."""
    return state.withColumn("u", unit_hash(F.col("seed"), F.col("key"))).filter("u < chance")


def stored_state(rows: DataFrame, state: DataFrame | None = None, path: str | None = None) -> DataFrame:
    """The state of ``consistent_sample``, written (to a new folder of the shared one unless ``path`` is given) and read back."""
    spark = rows.sparkSession
    path = path or shared_folder(spark, "sample-state")
    consistent_sample(rows, state)[1].write.parquet(path)
    return spark.read.schema("stratum bigint, seed bigint, key string, weight double, chance double").parquet(path)


def manifest_arrivals(manifest: DataFrame, split_meta: DataFrame) -> DataFrame:
    """``consistent_sample``'s rows for every row of ``split_meta`` (the stratum) over the manifest's problems.

    An arrival is the first version of a sample of a problem and adds the weight 1, so a
    problem fetched more often weighs more; repeated rows and later versions of a sample
    add nothing.  Versions before a stratum's ``created_at`` count as one, since no
    sample was asked for before.  A prefix restricts the problems, whatever their case.
    """
    settings = split_meta.select("meta_id", F.col("dataset").alias("meta_dataset"), F.col("sampling.prefix").alias("prefix"), F.col("sampling.seed").alias("seed"), F.col("sampling.requested_valid_big_size").cast("bigint").alias("size"), F.col("sampling.fraction").cast("double").alias("fraction"), F.date_format("created_at", "yyyyMMdd_HHmmss").alias("since"))
    few = collect_bounded(settings, MOST_SETTINGS, "split_meta")
    meta = F.broadcast(split_meta.sparkSession.createDataFrame(few, settings.schema))  # checked: at most MOST_SETTINGS rows
    items = (
        manifest.select("dataset", "sample_id", problem_key(F.col("dataset"), F.col("problem_id")).alias("key"), F.col("version"))
        .filter("key IS NOT NULL AND version IS NOT NULL")
        .groupBy("dataset", "key", "sample_id")
        .agg(F.min("version").alias("version"))
    )
    joined = items.join(meta, items["dataset"] == meta["meta_dataset"]).filter(F.col("prefix").isNull() | F.col("key").startswith(F.lower(F.trim("prefix"))))
    return joined.select(F.col("meta_id").alias("stratum"), "seed", "key", F.greatest("version", "since").alias("version"), F.lit(1.0).alias("weight"), "size", "fraction")
