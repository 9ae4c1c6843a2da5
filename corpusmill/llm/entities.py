"""Problem 6: splits that keep related records together."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.ranking import ranked_in_order
from corpusmill.functions.runtime import collect_bounded, cut
from corpusmill.functions.skew import hottest, join_unique
from corpusmill.llm.graph import groups

#: Largest number of distinct group sizes that the driver plans with.  N records hold at
#: most sqrt(2 N) distinct sizes, so this is reached from 5e11 records on.
MAX_SIZES = 1_000_000
#: Largest table of counts by setting and size that is broadcast (some 40 MB).
MAX_PLAN = 1_000_000


def contest_of(problem_id):
    """``judge/number`` that a contest problem's id names, however spelt; null if it names none.

    Understood: judge, contest number and problem in this order with any separators
    (``Judge/12/A``, ``judge-0012-A``, ``Judge 12A``, ``Judge/contest/12/problem/A``) and
    ``12_A. Title (Judge)``.  Case, blanks at the ends and leading zeros do not count.
    """
    s = F.lower(F.trim(F.regexp_replace(problem_id, r"\s+", " ")))
    front = r"^([a-z]+)(?:[^a-z0-9]+contest)?[^a-z0-9]*0*([0-9]+)"
    back = r"^0*([0-9]+).*\(\s*([a-z]+)\s*\)$"
    return F.when(s.rlike(front), F.concat_ws("/", F.regexp_extract(s, front, 1), F.regexp_extract(s, front, 2))).when(s.rlike(back), F.concat_ws("/", F.regexp_extract(s, back, 2), F.regexp_extract(s, back, 1)))


def entity_of(dataset, problem_id):
    """The entity that a record stems from: its contest, else dataset and id; null for null or blank ids.

    A contest id in no known spelling stands for itself, trimmed and in lower case.
    """
    contest = F.concat(F.lit("contest "), F.coalesce(contest_of(problem_id), F.lower(F.trim(problem_id))))
    return F.when(F.trim(problem_id) != "", F.when(dataset.startswith("codecontests"), contest).otherwise(F.concat_ws(" ", dataset, problem_id)))


def related(records: DataFrame, id_col: str, keys: list) -> DataFrame:
    """(node, root): records that share a value of any of the ``keys`` columns, directly or through others.

    ``keys`` are column expressions; a null key relates to nothing.  Each key value first
    gets its smallest id (pre-aggregated in the map tasks, so a value that a third of all
    rows hold costs one row a task), every other record hangs on it, hot values without a
    shuffle, and the union-find merges what several keys tie together.  Repeated ids count once.
    """
    edges = None
    for key in keys:
        keyed = records.select(F.col(id_col).cast("bigint").alias("id"), key.alias("key")).filter("id IS NOT NULL AND key IS NOT NULL")
        heads = cut(keyed.groupBy("key").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
        part = join_unique(keyed, heads.drop("n"), "key", hot=hottest(heads, "key", "n")).filter("id <> head").select(F.col("id").alias("u"), F.col("head").alias("v"))
        edges = part if edges is None else edges.unionByName(part)
    return groups(edges)


def greedy_counts(sizes: list[tuple[int, int]], shares: list[float]) -> dict[int, list[int]]:
    """How many groups of each size go to each split, largest sizes first.

    Each group goes to the split furthest below its target (ties: the first split), as a
    greedy over single groups would place it; a run of equal groups is placed at once by
    water filling, so the cost follows the number of distinct sizes.
    """
    total = sum(s * n for s, n in sizes)
    whole = sum(shares)
    if whole <= 0:
        raise ValueError("the shares must add up to more than nothing")
    below = [total * p / whole for p in shares]
    usable = [p > 0 for p in shares]
    out = {}
    for size, count in sorted(sizes, reverse=True):
        level_low, level_high = min(below) - size * count - size, max(b for b, u in zip(below, usable) if u)

        def taken(level: float) -> list[int]:
            return [max(0, math.ceil((b - level) / size)) if u else 0 for b, u in zip(below, usable)]

        for _ in range(80):
            mid = (level_low + level_high) / 2
            if sum(taken(mid)) <= count:
                level_high = mid
            else:
                level_low = mid
        got = taken(level_high)
        for _ in range(count - sum(got)):  # at most one a split is left by rounding
            k = max((i for i, u in enumerate(usable) if u), key=lambda i: (below[i] - got[i] * size, -i))
            got[k] += 1
        below = [b - g * size for b, g in zip(below, got)]
        out[size] = got
    return out


def memberships(records: DataFrame, id_col: str, keys: list) -> DataFrame:
    """(node, root) of every record, those without relatives as groups of one; null ids are left out."""
    ids = records.select(F.col(id_col).cast("bigint").alias("node")).filter("node IS NOT NULL").distinct()
    return cut(ids.join(related(records, id_col, keys), "node", "left").select("node", F.coalesce("root", "node").alias("root")))


def assign_groups(members: DataFrame, settings: list[dict], names: tuple[str, ...] = ("train", "valid", "test")) -> DataFrame:
    """(setting, node, root, split): groups placed largest first into the split furthest below its share, for every setting.

    ``members`` holds (node, root, family), a group in one family.  A setting is a dict of
    ``setting`` (its id), ``family`` (whose members it splits), ``seed`` and the share of
    each of ``names``.  All settings go through one plan.  Only the histogram of group
    sizes reaches the driver (see ``MAX_SIZES``); the counts by size and split come back as
    a table of at most ``MAX_PLAN`` rows, and which groups of a size go where follows from
    their rank by SHA-256 of seed and root.
    """
    spark = members.sparkSession
    sized = cut(members.groupBy("family", "root").agg(F.count(F.lit(1)).alias("size")))
    families: dict = {}
    for r in collect_bounded(sized.groupBy("family", "size").agg(F.count(F.lit(1)).alias("n")), MAX_SIZES, "distinct group sizes"):
        families.setdefault(r["family"], []).append((r["size"], r["n"]))
    plan = []
    for s in settings:
        for size, got in greedy_counts(families[s["family"]], [s[n] for n in names]).items() if s["family"] in families else ():
            plan.append((s["setting"], size, *[sum(got[: i + 1]) for i in range(len(names))]))
    if len(plan) > MAX_PLAN or len(settings) > 1000:
        raise RuntimeError("too many settings and sizes for one plan")
    ends = spark.createDataFrame(plan, "setting bigint, size bigint, " + ", ".join(f"end{i} bigint" for i in range(len(names))))
    asked = spark.createDataFrame([(s["setting"], s["family"], s["seed"]) for s in settings], "setting bigint, family string, seed bigint")
    digest = F.sha2(F.concat_ws("|", F.coalesce("seed", F.lit(0)).cast("string"), F.col("root").cast("string")), 256)
    hashed = sized.join(F.broadcast(asked), "family").withColumn("h", F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint"))  # at most 1000 rows
    placed = ranked_in_order(hashed, "h", by=["setting", "size"], ties=["root"]).join(F.broadcast(ends), ["setting", "size"])  # at most MAX_PLAN rows
    split = F.lit(names[-1])
    for i in reversed(range(len(names) - 1)):
        split = F.when(F.col("rank") < F.col(f"end{i}"), names[i]).otherwise(split)
    # a list of at most one entry a setting
    per_root = placed.groupBy("root").agg(F.collect_list(F.struct("setting", split.alias("split"))).alias("s"))
    return join_unique(members.select("node", "root"), per_root, "root").select("node", "root", F.explode("s").alias("s")).select("s.setting", "node", "root", "s.split")


def group_splits(records: DataFrame, id_col: str, key, shares: dict[str, float], seed: int = 0) -> DataFrame:
    """(id, group_id, split): every record in one split, related records never apart.

    Groups go by ``assign_groups``.  Records without relatives, null keys among them, are
    groups of one.  A group larger than a share stays whole, so that share is then
    exceeded.  Null ids are left out; repeated ids count once.
    """
    members = memberships(records, id_col, [key]).withColumn("family", F.lit(""))
    return assign_groups(members, [{"setting": 0, "family": "", "seed": seed, **shares}], tuple(shares)).select(F.col("node").alias(id_col), F.col("root").alias("group_id"), "split")
