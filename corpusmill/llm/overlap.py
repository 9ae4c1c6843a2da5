"""Problem 1: same or near-same records across splits (prefix-filter bipartite join)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.skew import hottest, join_unique
from corpusmill.llm import nearsets as N


def normal_split(col):
    """train, valid or test for the spellings in use (case, blanks, training, val, dev, testing); else null."""
    s = F.lower(F.trim(F.regexp_replace(col, r"\s+", " ")))
    return (
        F.when(s.isin("train", "training"), "train")
        .when(s.isin("valid", "val", "validation", "dev", "development"), "valid")
        .when(s.isin("test", "testing"), "test")
    )


def splits_of(manifest: DataFrame) -> DataFrame:
    """(sample_id, split): one normalised split a sample; rows without one are left out."""
    return (
        manifest.select(F.col("sample_id").cast("bigint").alias("id"), normal_split(F.col("split")).alias("split"))
        .filter("id IS NOT NULL AND split IS NOT NULL")
        .groupBy("id")
        .agg(F.min("split").alias("split"))
    )


#: Occurrences of a shingle beyond which its postings are spread over ``SALTS`` tasks.
HOT_POSTINGS, SALTS = 10_000, 32


def _near_classes(samples: DataFrame, manifest: DataFrame, threshold: float, shingle: int, min_words: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """((t, e), (id, cls, train)): near pairs of classes, one with train and one with evaluation records, and all members.

    A class is a set of shingles; its records may lie in either side.  A class with both is
    paired with itself.
    """
    docs = N.prepared(samples, id_col, text_col)
    sketch = N.frequency_sketch(docs, shingle, min_words, N.sketch_bits(samples))
    sides = splits_of(manifest).select("id", (F.col("split") == "train").alias("train"))
    sided = N.cut(N.prefixes(docs, sketch, shingle, min_words, threshold).join(sides, "id"))
    members = sided.select("id", "salt", "cls", "train")
    hot = F.col("rank") >= N.rank_of_count(HOT_POSTINGS)
    # of a hot shingle the train postings are dealt out, the evaluation postings are with each share
    index = N.postings(sided.filter("NOT train"), "train").withColumn("part", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).alias("e")
    probe = N.postings(sided.filter("train"), "train").withColumn("part", F.when(hot, F.pmod(F.xxhash64("cls"), F.lit(SALTS)).cast("int")).otherwise(0)).alias("t")
    pairs = N.cut(
        probe.join(index, (F.col("t.token") == F.col("e.token")) & (F.col("t.part") == F.col("e.part")) & (F.col("t.cls") != F.col("e.cls")) & N.near_enough("t", "e", threshold))
        .select(F.col("t.cls").alias("t"), F.col("e.cls").alias("e"))
        .distinct()
    )
    ends = pairs.select(F.explode(F.array("t", "e")).alias("cls")).distinct()
    sets = N.cut(N.token_sets(docs, ends, members, shingle, min_words, sketch))
    near = (
        pairs.join(sets.select(F.col("cls").alias("t"), F.col("tokens").alias("tt"), F.col("size").alias("ts")), "t")
        .join(sets.select(F.col("cls").alias("e"), F.col("tokens").alias("et"), F.col("size").alias("es")), "e")
        .select("t", "e", F.size(F.array_intersect("tt", "et")).alias("both"), (F.col("ts") + F.col("es")).alias("all"))
        .filter(F.expr(f"both >= {threshold!r}D * (all - both) - 1e-9D"))
        .select("t", "e")
    )
    equal = members.groupBy("cls").agg(F.max("train").alias("any_train"), F.min("train").alias("all_train")).filter("any_train AND NOT all_train").select(F.col("cls").alias("t"), F.col("cls").alias("e"))
    return near.unionByName(equal), members.select("id", "cls", "train")


def cross_split_pairs(samples: DataFrame, manifest: DataFrame, threshold: float = 0.7, shingle: int = 3, min_words: int = 20, id_col: str = "sample_id", text_col: str = "prompt") -> DataFrame:
    """(sample_id_a, sample_id_b): every near pair with one record in train, the other in valid or test.

    Evaluation prefixes are indexed, train prefixes probe them, hot shingles in shares.
    Null, empty and short texts (fewer than ``min_words`` words) are near to nothing;
    records without a split take no part; equal texts form a class that is joined once and
    expanded at the end, so the result has a row a pair (``cross_split_links`` has a row a
    record); repeated manifest rows change nothing.  Extra columns of either table are
    ignored.
    """
    near, members = _near_classes(samples, manifest, threshold, shingle, min_words, id_col, text_col)
    left = members.filter("train").select(F.col("cls").alias("t"), F.col("id").alias("a"))
    right = members.filter("NOT train").select(F.col("cls").alias("e"), F.col("id").alias("b"))
    return near.join(left, "t").join(right, "e").select(F.least("a", "b").alias("sample_id_a"), F.greatest("a", "b").alias("sample_id_b")).distinct()


def cross_split_links(samples: DataFrame, manifest: DataFrame, threshold: float = 0.7, shingle: int = 3, min_words: int = 20, id_col: str = "sample_id", text_col: str = "prompt") -> DataFrame:
    """(id, class_id, links): every record with a near one across the splits, its class and the number of those.

    The same join as ``cross_split_pairs``, but classes of equal texts are not expanded to
    pairs: a text that a third of all rows hold costs one row a record.  ``class_id`` is
    the smallest id of the records with a split that have the same shingles.
    """
    near, members = _near_classes(samples, manifest, threshold, shingle, min_words, id_col, text_col)
    members = N.cut(members.distinct())
    classes = N.cut(members.groupBy("cls").agg(F.min("id").alias("class_id"), F.count_if("train").alias("trains"), F.count_if(~F.col("train")).alias("evals"), F.count(F.lit(1)).alias("n")))
    near = N.cut(near)
    of_train = near.join(classes.select(F.col("cls").alias("e"), "evals"), "e").groupBy(F.col("t").alias("cls")).agg(F.sum("evals").alias("links")).withColumn("train", F.lit(True))
    of_eval = near.join(classes.select(F.col("cls").alias("t"), "trains"), "t").groupBy(F.col("e").alias("cls")).agg(F.sum("trains").alias("links")).withColumn("train", F.lit(False))
    both = of_train.unionByName(of_eval).groupBy("cls").agg(F.max(F.when(F.col("train"), F.col("links"))).alias("of_train"), F.max(F.when(~F.col("train"), F.col("links"))).alias("of_eval"))
    linked = both.join(classes.select("cls", "class_id"), "cls")
    out = join_unique(members, linked, "cls", hot=hottest(classes, "cls", "n"))
    return out.select(F.col("id").alias(id_col), "class_id", F.when(F.col("train"), F.col("of_train")).otherwise(F.col("of_eval")).alias("links")).filter("links > 0")


def overlap_report(pairs: DataFrame, samples: DataFrame, manifest: DataFrame) -> DataFrame:
    """Counts of overlapping records and pairs by evaluation split and by the dataset of either side."""
    info = samples.select(F.col("sample_id").alias("id"), "dataset").join(splits_of(manifest), "id")
    a = info.select(F.col("id").alias("sample_id_a"), F.col("dataset").alias("da"), F.col("split").alias("sa"))
    b = info.select(F.col("id").alias("sample_id_b"), F.col("dataset").alias("db"), F.col("split").alias("sb"))
    j = pairs.join(a, "sample_id_a").join(b, "sample_id_b")
    t = F.col("sa") == "train"
    return (
        j.select(
            F.when(t, F.col("sb")).otherwise(F.col("sa")).alias("split"),
            F.when(t, F.col("db")).otherwise(F.col("da")).alias("dataset"),
            F.when(t, F.col("da")).otherwise(F.col("db")).alias("train_dataset"),
            F.when(t, F.col("sample_id_b")).otherwise(F.col("sample_id_a")).alias("eval_id"),
            F.when(t, F.col("sample_id_a")).otherwise(F.col("sample_id_b")).alias("train_id"),
        )
        .groupBy("split", "dataset", "train_dataset")
        .agg(F.count(F.lit(1)).alias("pairs"), F.countDistinct("eval_id").alias("eval_records"), F.countDistinct("train_id").alias("train_records"))
    )
