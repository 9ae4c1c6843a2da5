"""Problem 2: groups of records whose texts share most of their shingles (vertical partitioning)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.skew import hottest, join_unique
from corpusmill.llm import nearsets as N
from corpusmill.llm.graph import groups
from corpusmill.llm.words import TOKEN_BITS

#: Occurrences of a shingle beyond which its texts are linked by way of heads and components.
HOT_POSTINGS = 1000
#: Hash ranges into which each rank range of the global order is cut for the generating join.
FRAGMENT_BITS = 10


def near_groups(records: DataFrame, id_col: str, text_cols: list[str], threshold: float = 0.8, shingle: int = 5, min_words: int = 20, fragments: int = 8, hot: int = HOT_POSTINGS) -> DataFrame:
    """(id, group_id): every record linked to another, with the smallest id of its group.

    Two records are linked if any of their ``text_cols`` (each compared with itself only)
    is near: Jaccard of distinct shingles >= ``threshold``, both of ``min_words`` words or
    more.  The global shingle order is cut into fragments: rank ranges, and hash ranges
    within them.  Each fragment joins its part of the texts' prefixes on its own under
    length and position filters and counts their partial overlaps; the counts are summed
    per pair, and a pair stays if its sum and the rest of its texts can reach the overlap
    that it needs.  Those pairs' whole texts are then counted fragment by fragment
    (``fragments`` rank ranges) and summed again, which decides.  A part that is empty on
    one side is never joined.

    Equal texts form one class, which takes part once; members hang on the smallest id
    of their class, so a text that holds a third of all rows yields as many links as rows.
    Shingles that occur more than ``hot`` times, as the sketch tells, are never gathered:
    each of their texts is compared with a head of its size, then texts of different
    components are, so a large group of near copies costs about a pair a text.  No pair of
    near texts in different groups is left out.

    Nulls, empty and short texts are linked to nothing; very long texts are taken whole;
    an empty table gives an empty result; other columns are ignored.
    """
    docs = None
    for k, col in enumerate(text_cols):
        part = N.prepared(records, id_col, col, k)
        docs = part if docs is None else docs.unionByName(part)
    sketch = N.frequency_sketch(docs, shingle, min_words, N.sketch_bits(records))
    # every step keeps only what later ones read; what it replaces is freed with its shuffles
    rows = N.cut(N.prefixes(docs, sketch, shingle, min_words, threshold))
    members = N.cut(rows.select("id", "salt", "cls"))
    hot_rank = N.rank_of_count(hot + 1)
    crowded = N.postings(rows.filter(F.exists("ranks", lambda r: r >= hot_rank))).filter(F.col("rank") >= hot_rank).select("token", "cls", "size", "pos")
    crowded = N.cut(crowded.withColumn("bucket", F.floor(F.log("size") / F.lit(math.log(1 / threshold))).cast("int")))
    # hot shingles come last in every prefix; how many there are goes into the rest of the text
    held = rows.withColumn("hots", F.size(F.filter("ranks", lambda r: r >= hot_rank)))
    candidates = N.cut(_candidates(N.postings(held, "hots").filter(F.col("rank") < hot_rank), threshold))
    del rows, held

    def verified(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.explode(F.array("x", "y")).alias("cls")).distinct()
        parts = N.cut(N.token_sets(docs, ends, members, shingle, min_words, sketch, fragments))
        return N.cut(_overlapping(pairs, parts, threshold))

    near = verified(candidates)
    del candidates
    if not crowded.isEmpty():
        crowded = _useful(crowded, threshold)
        near = near.unionByName(verified(N.cut(_to_heads(crowded, threshold))))
        near = near.unionByName(verified(N.cut(_across(crowded, groups(near), threshold))))
    del crowded
    heads = N.cut(members.groupBy("cls").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("n")))
    copies = heads.filter("n > 1")
    equal = join_unique(members, copies.drop("n"), "cls", hot=hottest(copies, "cls", "n")).filter("id <> head").select(F.col("id").alias("u"), F.col("head").alias("v"))
    linked = (
        near.join(heads.select(F.col("cls").alias("x"), F.col("head").alias("u")), "x")
        .join(heads.select(F.col("cls").alias("y"), F.col("head").alias("v")), "y")
        .select("u", "v")
    )
    return groups(equal.unionByName(linked)).select(F.col("node").alias(id_col), F.col("root").alias("group_id"))


def needed(xs, ys, threshold: float):
    """The overlap that sets of these sizes need (columns or arrays)."""
    share = threshold / (1 + threshold)
    return F.ceil(F.lit(share) * (xs + ys) - 1e-9) if not isinstance(xs, np.ndarray) else np.ceil(share * (xs + ys) - 1e-9)


def _candidates(postings: DataFrame, threshold: float) -> DataFrame:
    """(x, y): pairs whose partial overlaps, counted fragment by fragment and summed, leave them a chance.

    A fragment's postings (token, cls, size, pos, hots) come sorted by shingle; runs of
    equal shingles are paired and the pairs counted batch by batch, so a task holds a
    batch and one run (at most the hot bound) at a time.
    """

    def run(batches):
        held = [np.zeros(0, np.int64) for _ in range(5)]
        for batch in batches:
            if not batch.num_rows:
                continue
            fresh = [np.asarray(c.to_numpy(zero_copy_only=False)).astype(np.int64) for c in batch.columns]
            held = [np.concatenate(p) for p in zip(held, fresh)]
            last = int(np.flatnonzero(held[0] != held[0][-1])[-1]) + 1 if (held[0] != held[0][-1]).any() else 0
            if last > 1:
                yield _partial_overlaps(*(c[:last] for c in held), threshold)
            held = [c[last:] for c in held]
        if len(held[0]) > 1:
            yield _partial_overlaps(*held, threshold)

    fragment = (F.floor(F.col("rank") / 8).cast("int") * F.lit(1 << FRAGMENT_BITS)) + F.shiftrightunsigned("token", TOKEN_BITS - FRAGMENT_BITS).cast("int")
    placed = postings.withColumn("fragment", fragment).repartition("fragment").sortWithinPartitions("fragment", "token")
    parts = placed.select("token", "cls", "size", "pos", "hots").mapInArrow(run, "x bigint, y bigint, xs int, ys int, rest int, part int, first boolean")
    summed = parts.groupBy("x", "y", "xs", "ys", "rest").agg(F.sum("part").alias("both"), F.max("first").alias("first"))
    return summed.filter(F.col("first") & (F.col("both") + F.col("rest") >= needed(F.col("xs"), F.col("ys"), threshold))).select("x", "y")


def _partial_overlaps(token, cls, size, pos, hots, threshold: float) -> pa.RecordBatch:
    """Pairs of postings of one shingle, counted: sizes, shingles beyond the counted prefixes, part, and whether one may be the first shared.

    Shared shingles before a posting number at most its place, so a pair that cannot reach
    the overlap with these and all that follow is not counted.  Without any before, a
    shingle ``may be first`` only if what follows reaches the overlap by itself.
    """
    found = []
    at = np.arange(len(token))
    step = 1
    while len(at):
        at = at[at + step < len(token)]
        at = at[token[at] == token[at + step]]
        a, b = at, at + step
        na, nb = size[a], size[b]
        need = needed(na, nb, threshold)
        reach = np.minimum(na - pos[a], nb - pos[b])
        fits = (np.minimum(na, nb) >= threshold * np.maximum(na, nb) - 1e-9) & (cls[a] != cls[b])
        fits &= reach + np.minimum(pos[a], pos[b]) >= need
        a, b, first = a[fits], b[fits], (reach >= need)[fits]
        a, b = np.where(cls[a] < cls[b], a, b), np.where(cls[a] < cls[b], b, a)
        found.append(np.stack((a, b, first)))
        step += 1
    a, b, first = np.concatenate([np.zeros((3, 0), np.int64), *found], axis=1)
    order = np.lexsort((cls[b], cls[a]))
    a, b, first = a[order], b[order], first[order]
    x, y = cls[a], cls[b]
    head = np.flatnonzero(np.concatenate((np.ones(min(1, len(x)), bool), (x[1:] != x[:-1]) | (y[1:] != y[:-1]))))
    part = np.diff(np.append(head, len(x)))
    firsts = np.maximum.reduceat(first, head) > 0 if len(head) else np.zeros(0, bool)
    a, b = a[head], b[head]
    after = lambda k: np.ceil(threshold * size[k] - 1e-9).astype(np.int64) - 1 + hots[k]  # noqa: E731 - shingles beyond the counted prefix
    rest = np.maximum(after(a), after(b))
    return pa.RecordBatch.from_arrays([pa.array(x[head]), pa.array(y[head]), *(pa.array(c.astype(np.int32)) for c in (size[a], size[b], rest, part)), pa.array(firsts)], ["x", "y", "xs", "ys", "rest", "part", "first"])


def _cells(rows: DataFrame, *shifts: int) -> DataFrame:
    """``rows`` with a ``cell`` of their shingle for each of the size ranges ``bucket + shift``."""
    return rows.withColumn("cell", F.explode(F.array(*[F.xxhash64("token", F.col("bucket") + s) for s in shifts])))


def _useful(crowded: DataFrame, threshold: float) -> DataFrame:
    """The postings that reach the overlap with the smallest set of their shingle in a near range of sizes.

    What a boilerplate shingle leaves of texts that have little else in common is dropped
    here, one by one, before anything is paired.
    """
    least = _cells(crowded.groupBy("token", "bucket").agg(F.min("size").alias("least"), F.count(F.lit(1)).alias("n")), -1, 0, 1)
    least = N.cut(least.groupBy("cell").agg(F.min("least").alias("least"), F.sum("n").alias("n")))
    met = join_unique(_cells(crowded, 0), least.drop("n"), "cell", hot=hottest(least, "cell", "n"))
    return N.cut(met.filter(F.col("size") - F.col("pos") >= needed(F.col("size"), F.col("least"), threshold)).drop("cell", "least"))


def _to_heads(crowded: DataFrame, threshold: float) -> DataFrame:
    """Candidate pairs of each posting with heads: of its shingle, the posting of least hash in its range of sizes and in the one below.

    Near sets lie in one range of sizes or in neighbouring ones.  Heads are found by an
    aggregate; a cell of any size is met by one row, hot ones without a shuffle.
    """
    own = _cells(crowded, 0)
    heads = own.groupBy("cell").agg(F.min(F.struct(F.xxhash64("cls").alias("o"), "cls", "size", "pos")).alias("h"), F.count(F.lit(1)).alias("n"))
    heads = N.cut(heads.select("cell", F.col("h.cls").alias("hcls"), F.col("h.size").alias("hsize"), F.col("h.pos").alias("hpos"), "n"))
    found = None
    for shift in (0, -1):
        met = join_unique(_cells(crowded, shift), heads.drop("n"), "cell", hot=hottest(heads, "cell", "n"))
        fits = met.withColumns({"a": F.struct("size", "pos"), "b": F.struct(F.col("hsize").alias("size"), F.col("hpos").alias("pos"))}).filter(N.near_enough("a", "b", threshold) & (F.col("cls") != F.col("hcls")))
        part = fits.select(F.least("cls", "hcls").alias("x"), F.greatest("cls", "hcls").alias("y"))
        found = part if found is None else found.unionByName(part)
    return found.distinct()


def _across(crowded: DataFrame, components: DataFrame, threshold: float) -> DataFrame:
    """Candidate pairs of crowded shingles between texts of different components; pairs within one are not formed.

    Components of a cell are first compared as wholes, by the sizes and the furthest reach
    of their texts; only of those that may hold a near pair are the texts paired.
    """
    label = components.select(F.col("node").alias("cls"), F.col("root").alias("comp"))
    marked = N.cut(join_unique(crowded, label, "cls", "left").withColumn("comp", F.coalesce("comp", "cls")))
    kinds = N.cut(marked.groupBy("token", "bucket", "comp").agg(F.min("size").alias("low"), F.max("size").alias("high"), F.max(F.col("size") - F.col("pos")).alias("reach")))
    p, q = _cells(kinds, 0).alias("p"), _cells(kinds, 0, 1).alias("q")
    t = F.lit(threshold)
    may = (F.col("p.high") >= t * F.col("q.low") - 1e-9) & (F.col("q.high") >= t * F.col("p.low") - 1e-9) & (F.least("p.reach", "q.reach") >= needed(F.col("p.low"), F.col("q.low"), threshold))
    two = p.join(q, (F.col("p.cell") == F.col("q.cell")) & (F.col("p.comp") != F.col("q.comp")) & may)
    two = two.select(F.col("p.token").alias("token"), F.col("p.bucket").alias("b1"), F.col("q.bucket").alias("b2"), F.col("p.comp").alias("c1"), F.col("q.comp").alias("c2"))
    left = two.join(marked.alias("a"), (F.col("a.token") == two["token"]) & (F.col("a.bucket") == F.col("b1")) & (F.col("a.comp") == F.col("c1"))).select(two["token"], "b2", "c2", F.struct("a.cls", "a.size", "a.pos").alias("a"))
    met = left.join(marked.alias("b"), (F.col("b.token") == left["token"]) & (F.col("b.bucket") == F.col("b2")) & (F.col("b.comp") == F.col("c2")) & N.near_enough("a", "b", threshold))
    return met.select(F.least("a.cls", "b.cls").alias("x"), F.greatest("a.cls", "b.cls").alias("y")).distinct()


def _overlapping(pairs: DataFrame, parts: DataFrame, threshold: float) -> DataFrame:
    """The pairs that reach the threshold: overlaps counted in each fragment, then summed."""
    left = parts.select(F.col("cls").alias("x"), "fragment", F.col("tokens").alias("xt"), F.col("size").alias("xs"))
    right = parts.select(F.col("cls").alias("y"), "fragment", F.col("tokens").alias("yt"), F.col("size").alias("ys"))
    partial = pairs.join(left, "x").join(right, ["y", "fragment"]).select("x", "y", "xs", "ys", F.size(F.array_intersect("xt", "yt")).alias("part"))
    return partial.groupBy("x", "y", "xs", "ys").agg(F.sum("part").alias("both")).filter(F.expr(f"both >= {threshold!r}D * (xs + ys - both) - 1e-9D")).select("x", "y")
