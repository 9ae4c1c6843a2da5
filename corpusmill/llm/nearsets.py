"""Exact set-similarity joins on word shingles: order sketch, prefix postings, verification.

The joins find every pair of rows whose Jaccard similarity of distinct shingles is at
least a threshold.  They rest on one global order of shingles, rare ones first:

1. ``frequency_sketch`` counts all shingles of all rows in a table of fixed width (two to
   the ``bits``).  Any total order makes the prefix filter exact; the width only decides
   how well the order tells rare from frequent, hence how many candidates there are.
2. ``prefixes`` and ``postings`` give, for each *class* (rows with equal shingle sets), the first
   ``n - ceil(t*n) + 1`` shingles in that order.  Two sets with similarity >= t share one.
3. the callers join postings on the shingle under the length and position filters of
   ``near_enough``, verify the overlap of candidates and expand classes to their members.

Shingles are 44-bit hashes; two different shingles of one pair of 150-shingle texts
coincide with probability below 1e-8.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.runtime import cut, estimated_bytes
from corpusmill.llm.words import TOKEN_BITS, distinct_shingles, mix

#: Bounds of the sketch width: at most 2**26 one-byte cells, 64 MB, whatever the input.
MIN_BITS, MAX_BITS, SLICE_BITS = 16, 26, 6
_U = np.uint64


def sketch_bits(df: DataFrame) -> int:
    """Width for an input of this estimated size: about a cell for four bytes on disk."""
    return min(MAX_BITS, max(MIN_BITS, math.ceil(math.log2(max(1, estimated_bytes(df) / 4)))))


def _rows(batches: Iterator[pa.RecordBatch], n: int, min_words: int):
    """(batch, row range, words, tokens per row, tokens) of blocks; columns id, salt, text."""
    for batch in batches:
        salts = np.asarray(batch.column("salt").to_numpy(zero_copy_only=False))
        for salt in np.unique(salts):
            idx = np.flatnonzero(salts == salt)
            part = batch if len(idx) == batch.num_rows else batch.take(pa.array(idx))
            for (a, b), count, per, tok in distinct_shingles(part.column("text"), n, min_words, int(salt)):
                yield part, a, b, count, per, tok


_opened: dict[int, np.ndarray] = {}


def _cells(shared) -> np.ndarray:
    """The table of a broadcast sketch, unpacked once a worker process."""
    key = shared.value[0]
    if key not in _opened:
        _opened.clear()
        _opened[key] = np.frombuffer(zstandard.ZstdDecompressor().decompress(shared.value[1]), np.uint8)
    return _opened[key]


class FrequencySketch:
    """Broadcast counts of shingle hashes on a logarithmic one-byte scale (8 steps an octave, up to 4e9).

    The table travels packed, since most of its cells hold 0 or a small rank.
    """

    def __init__(self, spark, cells: bytes, bits: int):
        self.bits = bits
        packed = zstandard.ZstdCompressor(level=3).compress(cells)
        self.value = spark.sparkContext.broadcast((hash(packed), packed))

    def rank(self):
        """A function for tasks: tokens -> one-byte frequency rank; 0 means seen once at most."""
        value, shift = self.value, TOKEN_BITS - self.bits
        return lambda tok: _cells(value)[tok >> shift]


def frequency_sketch(docs: DataFrame, n: int, min_words: int, bits: int) -> FrequencySketch:
    """Counts every shingle of ``docs`` (id, salt, text).

    Each task pre-aggregates runs of about two million shingles; slices of the table are
    summed in parallel and only the one-byte table (2**bits bytes) reaches the driver.
    """
    slices = 1 << SLICE_BITS
    width = 1 << (bits - SLICE_BITS)

    def count(batches):
        packer, held, size = zstandard.ZstdCompressor(level=1), [], 0

        def flush():
            cells, seen = np.unique(np.concatenate(held), return_counts=True)
            cut_at = np.searchsorted(cells, np.arange(slices + 1) * width)
            out = [[], [], []]
            for s in range(slices):
                a, b = cut_at[s], cut_at[s + 1]
                if b > a:
                    out[0].append(s)
                    step = np.diff(cells[a:b], prepend=s * width).astype(np.uint32)
                    out[1].append(packer.compress(step.view(np.uint8).reshape(-1, 4).T.tobytes()))
                    out[2].append(packer.compress(seen[a:b].astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], ["slice", "steps", "seen"])

        for *_, tok in _rows(batches, n, min_words):
            held.append(tok >> (TOKEN_BITS - bits))
            size += len(tok)
            if size > 1 << 21:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    def unpack(blob):
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(4, -1).T
        return np.ascontiguousarray(raw).view(np.uint32).ravel().astype(np.int64)

    def total(batches):
        # a partition holds whole slices: sums of at most 2**(bits - 6) cells each
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, steps, seen in zip(*(c.to_pylist() for c in batch.columns)):
                acc = sums.setdefault(s, np.zeros(width, np.int64))
                acc[np.cumsum(unpack(steps))] += unpack(seen)
        for s, acc in sums.items():
            scale = np.where(acc > 1, np.minimum(255, 1 + np.floor(8 * np.log2(np.maximum(acc, 2)) - 8)), 0)
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([scale.astype(np.uint8).tobytes()], pa.binary())], ["slice", "cells"])

    parts = docs.select("salt", "text").mapInArrow(count, "slice int, steps binary, seen binary")
    rows = parts.repartition("slice").mapInArrow(total, "slice int, cells binary").collect()  # at most 64 rows, 2**bits bytes
    table = bytearray(1 << bits)
    for r in rows:
        table[r["slice"] * width : (r["slice"] + 1) * width] = r["cells"]
    return FrequencySketch(docs.sparkSession, bytes(table), bits)


def rank_of_count(count: int) -> int:
    """The sketch's rank of a shingle that occurs so often."""
    return 0 if count < 2 else int(min(255, 1 + math.floor(8 * math.log2(count) - 8)))


def _classes(per: np.ndarray, tok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class hash of every row's token set (order-free sum of mixed tokens), and each row's first token."""
    first = np.concatenate(([0], np.cumsum(per)))
    acc = np.concatenate(([_U(0)], np.cumsum(mix(tok.astype(np.uint64) + _U(1)))))
    return mix(acc[first[1:]] - acc[first[:-1]] + per.astype(np.uint64) * _U(0x9E3779B97F4A7C15)).astype(np.int64), first


def prefixes(docs: DataFrame, sketch: FrequencySketch, n: int, min_words: int, threshold: float) -> DataFrame:
    """(id, salt, cls, size, tokens, pos, ranks) of every row with at least ``min_words`` words.

    ``tokens`` is the row's prefix in the global order, ``pos`` each token's place in it,
    ``ranks`` their frequency ranks.
    Tokens that the sketch has seen once only can meet no other row and are left out, so
    the arrays are short and travel to later joins in place of the text.
    """
    rank_of = sketch.rank()

    def run(batches):
        for part, a, b, count, per, tok in _rows(batches, n, min_words):
            cls, first = _classes(per, tok)
            rank = rank_of(tok)
            row = np.repeat(np.arange(b - a), per)
            order = np.lexsort((tok, rank, row))
            pos = np.arange(len(tok)) - first[:-1][row]
            prefix = (per - np.ceil(threshold * per - 1e-9).astype(np.int64) + 1)[row]
            keep = (pos < prefix) & (rank[order] > 0)
            some = np.flatnonzero(per > 0)
            at = pa.array(np.concatenate(([0], np.cumsum(np.bincount(row[keep], minlength=b - a)[some]))).astype(np.int32))
            idx = pa.array(some)
            yield pa.RecordBatch.from_arrays(
                [part.column("id").slice(a, b - a).take(idx), part.column("salt").slice(a, b - a).take(idx), pa.array(cls[some]), pa.array(per[some].astype(np.int32)), pa.ListArray.from_arrays(at, pa.array(tok[order][keep])), pa.ListArray.from_arrays(at, pa.array(pos[keep].astype(np.int32))), pa.ListArray.from_arrays(at, pa.array(rank[order][keep].astype(np.int16)))],
                ["id", "salt", "cls", "size", "tokens", "pos", "ranks"],
            )

    return docs.mapInArrow(run, "id bigint, salt bigint, cls bigint, size int, tokens array<bigint>, pos array<int>, ranks array<smallint>")


def postings(rows: DataFrame, *keys: str) -> DataFrame:
    """(token, cls, size, pos, rank, keys) of the prefixes, each class once for every value of ``keys``."""
    each = rows.select("cls", *keys, "size", "tokens", "pos", "ranks").dropDuplicates(["cls", *keys])
    zipped = each.select("cls", *keys, "size", F.explode(F.arrays_zip("tokens", "pos", "ranks")).alias("p"))
    return zipped.select(F.col("p.tokens").alias("token"), "cls", *keys, "size", F.col("p.pos").alias("pos"), F.col("p.ranks").alias("rank"))


def near_enough(a: str, b: str, threshold: float):
    """Length and position filter of two postings with the same token."""
    rest = f"least({a}.size - {a}.pos, {b}.size - {b}.pos)"
    t = repr(float(threshold))
    return F.expr(
        f"least({a}.size, {b}.size) >= {t}D * greatest({a}.size, {b}.size) - 1e-9D"
        f" AND {rest} >= ceil({t}D / (1D + {t}D) * ({a}.size + {b}.size) - 1e-9D)"
    )


def token_sets(docs: DataFrame, classes: DataFrame, members: DataFrame, n: int, min_words: int, sketch: FrequencySketch, fragments: int = 1) -> DataFrame:
    """(cls, fragment, tokens, size) of the named classes, from the text of one member of each.

    ``size`` counts all shingles of the set; ``tokens`` leaves out those that the sketch
    has seen once only, which no two sets share.  With ``fragments`` > 1 each set is cut
    where the global order (frequency rank, then hash) passes the given number of equally
    wide rank ranges; empty fragments have no row.
    """
    reps = members.join(classes, "cls", "left_semi").groupBy("cls").agg(F.min(F.struct("id", "salt")).alias("m")).select("m.id", "m.salt")
    chosen = docs.join(reps, ["id", "salt"], "left_semi")
    rank_of = sketch.rank()

    def run(batches):
        for part, a, b, count, per, tok in _rows(batches, n, min_words):
            cls, _ = _classes(per, tok)
            rank = rank_of(tok)
            row = np.repeat(np.arange(b - a), per)[rank > 0]
            tok, rank = tok[rank > 0], rank[rank > 0]
            if not len(tok):
                continue
            cell = row * fragments + np.minimum(fragments - 1, rank.astype(np.int64) * fragments // 64)
            order = np.lexsort((tok, cell))
            cells, at = np.unique(cell[order], return_index=True)
            lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(tok)).astype(np.int32)), pa.array(tok[order]))
            yield pa.RecordBatch.from_arrays([pa.array(cls[cells // fragments]), pa.array((cells % fragments).astype(np.int32)), lists, pa.array(per[cells // fragments].astype(np.int32))], ["cls", "fragment", "tokens", "size"])

    return chosen.mapInArrow(run, "cls bigint, fragment int, tokens array<bigint>, size int")


def prepared(df: DataFrame, id_col: str, text_col: str, salt: int = 0, *carry: str) -> DataFrame:
    """(id, salt, text, carried): lower-cased rows that can hold a word; null texts are left out."""
    return df.filter(F.col(text_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.lit(salt).cast("bigint").alias("salt"), F.lower(F.col(text_col)).alias("text"), *carry)


__all__ = ["FrequencySketch", "cut", "frequency_sketch", "near_enough", "postings", "prefixes", "prepared", "rank_of_count", "sketch_bits", "token_sets"]
