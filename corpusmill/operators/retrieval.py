"""Passage retrieval: dense inner products and BM25, top-k for a stated query set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.runtime import collect_bounded


def normalized(vector) -> Column:
    """A vector at length 1 (null for one of length 0)."""
    v = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(v, lambda x: F.try_divide(x, norm))


def _top(scored: DataFrame, k: int, query: str, doc: str) -> DataFrame:
    """The k best of each query by score, ties by document; ranked per task first, then over the survivors."""
    cell = F.pmod(F.xxhash64(doc), F.lit(64))
    order = [F.col("score").desc(), F.col(doc)]
    few = scored.withColumn("__r", F.row_number().over(Window.partitionBy(query, cell).orderBy(*order))).filter(F.col("__r") <= k)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(*order))).filter(F.col("rank") <= k).drop("__r")


def dense_search(queries: DataFrame, vectors: DataFrame, k: int = 5, query="query_id", doc="vec_id", vector="embedding", normalize: bool = True, block: int = 1024) -> DataFrame:
    """(query_id, vec_id, score, rank): largest inner products of the queries with all vectors.

    The query set is stated and checked: blocks of ``block`` queries travel to the tasks in
    turn, each task multiplies its vectors with the block and keeps its own best k, and
    only those are shuffled.  Vectors of another length, with nulls or null are skipped.
    """
    import numpy as np
    import pyarrow as pa

    q = queries.select(F.col(query).cast("bigint").alias("q"), (normalized(vector) if normalize else F.transform(vector, lambda x: x.cast("double"))).alias("v")).filter("v IS NOT NULL")
    n = q.count()
    base = vectors.select(F.col(doc).cast("bigint").alias("d"), F.transform(vector, lambda x: x.cast("double")).alias("v")).filter("d IS NOT NULL AND v IS NOT NULL")
    out = None
    for part in range(max(1, -(-n // block))):
        rows = collect_bounded(q.filter(F.pmod(F.xxhash64("q"), F.lit(max(1, -(-n // block)))) == part), 4 * block, "queries of a block")
        width = len(rows[0]["v"]) if rows else 0
        ids = np.array([r["q"] for r in rows], np.int64)
        shared = vectors.sparkSession.sparkContext.broadcast((ids, np.array([r["v"] for r in rows], float).reshape(len(rows), width)))

        def search(batches, shared=shared, width=width):
            ids, grid = shared.value
            best_s = np.full((len(ids), 0), 0.0)
            best_d = np.zeros((len(ids), 0), np.int64)
            for batch in batches:
                d, v = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
                whole = np.array([x.is_valid and len(x) == width for x in v], bool) if v.null_count or not len(v) else np.diff(v.offsets.to_numpy()) == width
                if not whole.any() or not width:
                    continue
                flat = np.asarray(v.filter(pa.array(whole)).flatten().to_numpy(zero_copy_only=False), float).reshape(-1, width)
                s = np.concatenate((best_s, grid @ flat.T), axis=1)
                docs = np.concatenate((best_d, np.broadcast_to(d[whole], (len(ids), int(whole.sum())))), axis=1)
                order = np.lexsort((docs, -s), axis=1)[:, :k]
                best_s, best_d = np.take_along_axis(s, order, 1), np.take_along_axis(docs, order, 1)
            m = best_s.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, m)), pa.array(best_d.ravel()), pa.array(best_s.ravel())], [query, doc, "score"])

        found = base.mapInArrow(search, f"{query} bigint, {doc} bigint, score double")
        out = found if out is None else out.unionByName(found)
    return _top(out.filter("NOT isnan(score)"), k, query, doc)


def words(col) -> Column:
    """Lower-cased words of letters and digits."""
    return F.filter(F.split(F.lower(col), r"[^a-z0-9]+"), lambda w: w != "")


def bm25(queries: DataFrame, documents: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75, query="query_id", query_text="text", doc="doc_id", doc_text="text") -> DataFrame:
    """(query_id, doc_id, score, rank): BM25 with k1 and b, idf = ln(1 + (N - df + 0.5) / (df + 0.5)).

    The query words are few and known, so documents are reduced to the words that queries
    ask for before anything is shuffled; lengths and counts still cover all documents.
    Empty texts count as documents of length 0.  Scores are rounded to six decimals before
    they are ranked, so that the order of a sum decides no tie; ties go by document.
    """
    asked = queries.select(F.col(query).alias(query), F.explode(words(F.col(query_text))).alias("word")).groupBy(query, "word").agg(F.count(F.lit(1)).alias("qf"))
    sized = documents.select(F.col(doc).alias(doc), words(F.coalesce(F.col(doc_text), F.lit(""))).alias("__w"))
    totals = sized.agg(F.count(F.lit(1)).alias("__n"), F.avg(F.size("__w")).alias("__avg"))
    long = sized.select(doc, F.size("__w").alias("__len"), F.explode("__w").alias("word")).join(asked.select("word").distinct(), "word", "left_semi")
    tf = long.groupBy(doc, "word").agg(F.count(F.lit(1)).alias("tf"), F.first("__len").alias("__len"))
    df = tf.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    idf = df.join(F.broadcast(totals)).select("word", F.col("__avg"), F.ln(1 + (F.col("__n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))  # a one-row table
    term = F.col("qf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("__len") / F.col("__avg")))
    scored = tf.join(idf, "word").join(asked, "word").groupBy(query, doc).agg(F.round(F.sum(term), 6).alias("score"))
    return _top(scored, k, query, doc)


def retrieve(results: DataFrame, corpus: DataFrame, doc="doc_id", text="text", query="query_id", scores: bool = True) -> DataFrame:
    """The results with the documents' texts, in rank order per query as one list."""
    part = F.struct("rank", F.col(doc), F.col(text), *(["score"] if scores else []))
    return results.join(corpus.select(doc, text), doc).groupBy(query).agg(F.sort_array(F.collect_list(part)).alias("passages"))
