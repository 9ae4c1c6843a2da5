"""Problem 8: evaluation passages in training text, found with an FM-index of every shard."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.runtime import collect_bounded, shared_folder
from corpusmill.llm.fmindex import FMIndex, suffix_order
from corpusmill.llm.words import blocks, column_bytes, word_hashes, word_spans

#: Bytes of evaluation text in a block, and of the block that is broadcast to the tasks.
QUERY_BYTES, MOST_BROADCAST = 16 << 20, 256 << 20
#: Words in an index, after which a task starts the next one.
SHARD_WORDS = 1 << 20
#: Bits of the filter that tells which words any item holds, where items come in blocks.
FILTER_BITS = 22
STORED = "text binary, sa binary, vocabulary binary, at binary, doc binary, word binary"


def _hash_rows(col):
    """(word hashes, words before each row) of whole columns, in blocks."""
    raw_all, offs_all = column_bytes(col)
    for a, b in blocks(offs_all):
        raw, offs = raw_all[offs_all[a] : offs_all[b]], offs_all[a : b + 1] - offs_all[a]
        starts, ends, first = word_spans(raw, offs)
        yield a, b, word_hashes(raw, starts, ends), first


class Phrases:
    """All distinct windows of ``length`` words of a block of items, as places in their words.

    Kept small, since it is broadcast: a number a word, a start a window, and the items
    that hold each window.
    """

    def __init__(self, ids: np.ndarray, texts: list[str | None], length: int):
        words, first = [], [np.zeros(1, np.int64)]
        for _, _, h, f in _hash_rows(pa.array(texts, pa.large_string())):
            words.append(h)
            first.append(f[1:] + first[-1][-1])
        words, first = np.concatenate([np.zeros(0, np.uint64), *words]), np.concatenate(first)
        self.vocabulary, symbols = np.unique(words, return_inverse=True)
        self.symbols = symbols.astype(np.int32)
        item = np.repeat(np.arange(len(ids)), np.diff(first))
        m = max(0, len(words) - length + 1)
        at = np.flatnonzero(item[:m] == item[length - 1 :]) if m else np.zeros(0, np.int64)
        # windows are told apart by a polynomial over their words' hashes
        mark = np.zeros(len(at), np.uint64)
        for j in range(length):
            mark = mark * np.uint64(0x9E3779B97F4A7C15) + words[at + j]
        _, some, number = np.unique(mark, return_index=True, return_inverse=True)
        self.starts = at[some].astype(np.int32)
        pairs = np.unique(np.stack((number.ravel(), item[at])), axis=1)
        self.item_start = np.searchsorted(pairs[0], np.arange(len(self.starts) + 1)).astype(np.int32)
        self.items = np.asarray(ids, np.int64)[pairs[1]]
        self.length = length

    def within(self, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, numbers of the windows): the words as places in another vocabulary from 1, and windows it has all words of."""
        at = np.searchsorted(vocabulary, self.vocabulary)
        at[at == len(vocabulary)] = 0
        known = vocabulary[at] == self.vocabulary if len(vocabulary) else np.zeros(len(self.vocabulary), bool)
        mine = np.where(known, at + 1, 0)[self.symbols]
        missing = np.concatenate(([0], np.cumsum(mine == 0)))
        return mine, np.flatnonzero(missing[self.starts + self.length] == missing[self.starts])


def _word_bit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


class WordFilter:
    """Which words may occur in items: exactly for one block of phrases, by hashed bits of a fixed size for many."""

    def __init__(self, vocabulary: np.ndarray | None = None, bits: np.ndarray | None = None):
        self.vocabulary, self.bits = vocabulary, bits

    def __call__(self, h: np.ndarray) -> np.ndarray:
        if self.bits is not None:
            return self.bits[_word_bit(h)]
        if not len(self.vocabulary):
            return np.zeros(len(h), bool)
        at = np.searchsorted(self.vocabulary, h)
        at[at == len(self.vocabulary)] = 0
        return self.vocabulary[at] == h


class Shard:
    """Documents' words ready for an index: symbols over the shard's own vocabulary, and where its segments stand.

    A segment is a run of words that may all occur in items, of a phrase's length at
    least; no other text is indexed.  ``at`` is where each begins, ``doc`` and ``word`` its
    document and the number of its first word there.
    """

    def __init__(self, words: np.ndarray, inside: np.ndarray, at: np.ndarray, doc: np.ndarray, word: np.ndarray):
        self.vocabulary = np.unique(words[inside])
        self.text = np.where(inside, np.searchsorted(self.vocabulary, words) + 1, 0).astype(np.int32)
        self.at, self.doc, self.word = at, doc, word
        self.sa: np.ndarray | None = None

    def sorted(self) -> Shard:
        self.sa = suffix_order(self.text)
        return self

    def row(self) -> list[bytes]:
        return [x.tobytes() for x in (self.text, self.sa.astype(np.int32), self.vocabulary, self.at, self.doc, self.word)]

    @classmethod
    def of_row(cls, row: list[bytes]) -> Shard:
        shard = cls.__new__(cls)
        types = (np.int32, np.int32, np.uint64, np.int64, np.int64, np.int64)
        shard.text, shard.sa, shard.vocabulary, shard.at, shard.doc, shard.word = (np.frombuffer(x, t) for x, t in zip(row, types))
        return shard

    def matches(self, phrases: Phrases, index: FMIndex) -> pa.RecordBatch | None:
        """Spans of the phrases found in this shard, overlapping ones of an item merged."""
        symbols, some = phrases.within(self.vocabulary)
        which, low, high = index.search_at(symbols, phrases.starts[some].astype(np.int64), phrases.length)
        n = high - low
        if not n.sum():
            return None
        rows = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        places, windows = index.locate(rows), some[np.repeat(which, n)]
        many = (phrases.item_start[windows + 1] - phrases.item_start[windows]).astype(np.int64)
        places = np.repeat(places, many)
        items = phrases.items[np.repeat(phrases.item_start[windows], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
        seg = np.searchsorted(self.at, places, side="right") - 1
        d, w = self.doc[seg], self.word[seg] + places - self.at[seg]
        order = np.lexsort((w, items, d))
        d, items, w = d[order], items[order], w[order]
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]) | (items[1:] != items[:-1]) | (w[1:] > w[:-1] + phrases.length)
        heads = np.flatnonzero(new)
        tails = np.append(heads[1:], len(d)) - 1
        return pa.RecordBatch.from_arrays([pa.array(d[heads]), pa.array(items[heads]), pa.array(w[heads]), pa.array(w[tails] + phrases.length)], ["doc_id", "item_id", "start_word", "end_word"])


def _shards(batches, wanted: WordFilter, length: int):
    """The shards of a task's documents, of about ``SHARD_WORDS`` words each."""
    held, size = [], 0

    def made():
        words, inside, n, doc, word = (np.concatenate(x) for x in zip(*held))
        at = np.concatenate(([0], np.cumsum(n + 1)))[:-1]
        return Shard(words, inside, at, doc, word)

    for batch in batches:
        ids = np.asarray(batch.column(0).to_numpy(zero_copy_only=False))
        for a, b, h, first in _hash_rows(batch.column(1)):
            if not len(h):
                continue
            known = wanted(h)
            row = np.repeat(np.arange(b - a), np.diff(first))
            head = known & ~(np.append(False, known[:-1]) & np.append(False, row[1:] == row[:-1]))
            starts = np.flatnonzero(head)
            stop = np.append(np.flatnonzero(~known | (np.append(False, row[1:] != row[:-1]))), len(h))
            # a segment ends at the next unknown word or the next row
            ends = stop[np.searchsorted(stop, starts, side="right")]
            long = ends - starts >= length
            starts, ends = starts[long], ends[long]
            if not len(starts):
                continue
            n = ends - starts
            offset = np.concatenate(([0], np.cumsum(n + 1)))
            total = int(offset[-1])
            seg = np.repeat(np.arange(len(n)), n + 1)
            inside = np.arange(total) - offset[seg] < n[seg]
            place = np.where(inside, starts[seg] + np.arange(total) - offset[seg], 0)
            held.append((h[place], inside, n, ids[a + row[starts]], starts - first[row[starts]]))
            size += total
            if size > SHARD_WORDS:
                yield made()
                held, size = [], 0
    if held:
        yield made()


def leaked_passages(documents: DataFrame, items: DataFrame, length: int = 16, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, start_word, end_word): passages of at least ``length`` words shared with an item.

    Words are counted from 0 in the document, the end is exclusive; overlapping matches of
    one item are merged.  Each task builds FM-indexes of its share of the documents and
    searches all phrases of the items backwards in them, so the documents are neither
    shuffled nor gathered.  Items are the query set and travel to the tasks.  What exceeds
    ``QUERY_BYTES`` comes in blocks: the documents are then indexed once, over every
    shard's own vocabulary, the indexes are stored in the shared folder, and each block is
    searched in them.

    Null and empty texts and items of fewer than ``length`` words share nothing; equal
    items or documents are all reported; an empty table gives an empty result.
    """
    queries = items.filter(F.col(item_text_col).isNotNull()).select(F.col(item_col).cast("bigint").alias("item_id"), F.lower(F.col(item_text_col)).alias("text"))
    size = queries.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, math.ceil(1.25 * size / QUERY_BYTES))  # hashed blocks differ in size
    docs = documents.filter(F.col(text_col).isNotNull()).select(F.col(doc_col).cast("bigint").alias("doc_id"), F.lower(F.col(text_col)).alias("text"))

    def block(k: int) -> Phrases:
        some = queries if count == 1 else queries.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k)
        rows = collect_bounded(some, 4 * QUERY_BYTES // length, "items of a block")
        phrases = Phrases(np.array([r["item_id"] for r in rows], np.int64), [r["text"] for r in rows], length)
        if sum(x.nbytes for x in (phrases.vocabulary, phrases.symbols, phrases.starts, phrases.item_start, phrases.items)) > MOST_BROADCAST:
            raise RuntimeError("a block of items exceeds the bound of a broadcast")
        return phrases

    if count == 1:
        return _search(docs, block(0))
    index = _stored_index(docs, queries, length)
    out = None
    for k in range(count):
        part = _search_stored(index, block(k))
        out = part if out is None else out.unionByName(part)
    return out


_SPANS = "doc_id bigint, item_id bigint, start_word bigint, end_word bigint"


def _search(docs: DataFrame, phrases: Phrases) -> DataFrame:
    """One block: every shard is indexed, searched and dropped."""
    shared = docs.sparkSession.sparkContext.broadcast(phrases)

    def run(batches):
        p = shared.value
        for shard in _shards(batches, WordFilter(p.vocabulary), p.length):
            found = shard.matches(p, FMIndex(shard.text, len(shard.vocabulary) + 1))
            if found is not None:
                yield found

    return docs.mapInArrow(run, _SPANS)


def _stored_index(docs: DataFrame, queries: DataFrame, length: int) -> DataFrame:
    """The shards of all documents with their suffix order, a row a shard, as a table in the shared folder."""

    def bits(batches):
        have = np.zeros(1 << FILTER_BITS, bool)
        for batch in batches:
            for _, _, h, _ in _hash_rows(batch.column(0)):
                have[_word_bit(h)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(have).tobytes()], pa.binary())], ["bits"])

    spark = docs.sparkSession
    have = np.zeros(1 << FILTER_BITS, bool)
    for r in queries.select("text").coalesce(32).mapInArrow(bits, "bits binary").collect():  # 32 rows of half a megabyte
        have |= np.unpackbits(np.frombuffer(r["bits"], np.uint8)).astype(bool)
    shared = spark.sparkContext.broadcast(have)

    def run(batches):
        for shard in _shards(batches, WordFilter(bits=shared.value), length):
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in shard.sorted().row()], ["text", "sa", "vocabulary", "at", "doc", "word"])

    path = shared_folder(spark, "fm-index")
    docs.mapInArrow(run, STORED).write.parquet(path)
    return spark.read.schema(STORED).parquet(path)


def _search_stored(index: DataFrame, phrases: Phrases) -> DataFrame:
    shared = index.sparkSession.sparkContext.broadcast(phrases)

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                shard = Shard.of_row([c[k].as_py() for c in batch.columns])
                found = shard.matches(shared.value, FMIndex(shard.text, len(shard.vocabulary) + 1, sa=shard.sa))
                if found is not None:
                    yield found

    return index.mapInArrow(run, _SPANS)


def removal_spans(passages: DataFrame) -> DataFrame:
    """(doc_id, start_word, end_word): the passages of all items merged into disjoint spans.

    Touching and overlapping spans become one.  Only documents with matches are sorted.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("start_word", "end_word")
    reach = F.max("end_word").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = passages.select("doc_id", "start_word", "end_word").distinct().withColumn("new", F.when(reach >= F.col("start_word"), 0).otherwise(1))
    numbered = marked.withColumn("span", F.sum("new").over(w))
    return numbered.groupBy("doc_id", "span").agg(F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word")).drop("span")
