"""Telling languages by byte n-grams, fitted on labelled text."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.words import column_bytes

#: Cells of the n-gram table.
CELL_BITS = 14
#: Most languages that a model tells apart.
MOST_LANGUAGES = 64
_SPACE = np.ones(256, bool)
_SPACE[97:123] = False
_SPACE[128:] = False


def gram_cells(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(cell, row) of all byte trigrams of letters and single blanks; digits and marks count as blanks."""
    raw, offs = column_bytes(pa.array([(t or "").lower() for t in texts], pa.large_string()))
    if len(raw) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(texts)), np.diff(offs))
    letter = ~_SPACE[raw]
    # of a run of blanks the first stays
    keep = letter | np.append(True, letter[:-1] | (row[1:] != row[:-1]))
    b = np.where(letter, raw, 32)[keep].astype(np.uint32)
    row = row[keep]
    if len(b) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = (b[:-2] * np.uint32(0x9E3779B1) ^ b[1:-1] * np.uint32(0x85EBCA77) ^ b[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
    inside = row[:-2] == row[2:]
    return (h >> np.uint32(32 - CELL_BITS)).astype(np.int64)[inside], row[:-2][inside]


class LanguageModel:
    """Naive Bayes over hashed byte trigrams.

    ``names`` are the languages, ``weights`` the log-probability of every cell in each,
    ``usual`` what a trigram of the fitted text has on average.
    """

    def __init__(self, names: list[str], counts: np.ndarray):
        self.names = names
        smooth = counts + 0.5
        self.weights = np.log(smooth / smooth.sum(axis=1, keepdims=True)).astype(np.float32)
        self.usual = (counts * self.weights).sum(axis=1) / np.maximum(1, counts.sum(axis=1))

    @classmethod
    def fit(cls, labelled: DataFrame, rows: int, clean: Callable[[str], str], text_col: str = "text", lang_col: str = "lang", least: int = 5) -> LanguageModel | None:
        """The model of a table's labels, null if it tells fewer than two languages apart.

        The sample is drawn by a hash of the text, about ``rows`` rows whatever the table's
        size; labels are cut to their first two letters in lower case, ``und`` and others
        of fewer than ``least`` rows are left out.  Each task counts its share and sends a
        table of ``2**CELL_BITS`` counts a language; wrong labels only blur the counts.
        """
        good = labelled.filter(F.col(text_col).isNotNull() & F.lower(F.col(lang_col)).rlike("^ *[a-z]{2}([-_ ].*)?$"))
        total = good.count()
        share = min(1.0, rows / max(1, total))
        chosen = good.filter(F.pmod(F.xxhash64(F.lit(3), text_col), F.lit(1_000_000)) < int(share * 1_000_000)).select(F.substring(F.lower(F.trim(lang_col)), 1, 2).alias("lang"), F.col(text_col).alias("text"))

        def count(batches):
            held: dict[str, np.ndarray] = {}
            seen: dict[str, int] = {}
            for batch in batches:
                langs = batch.column(0).to_pylist()
                cells, row = gram_cells([clean(t) for t in batch.column(1).to_pylist()])
                for name in set(langs):
                    mine = np.array([x == name for x in langs])
                    held[name] = held.get(name, 0) + np.bincount(cells[mine[row]], minlength=1 << CELL_BITS)
                    seen[name] = seen.get(name, 0) + int(mine.sum())
            for name, table in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([seen[name]]), pa.array([table.astype(np.int64).tobytes()], pa.binary())], ["lang", "n", "cells"])

        parts = chosen.coalesce(16).mapInArrow(count, "lang string, n bigint, cells binary")
        sums: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}
        for r in parts.collect():  # at most 16 tables a language
            sums[r["lang"]] = sums.get(r["lang"], 0) + np.frombuffer(r["cells"], np.int64)
            seen[r["lang"]] = seen.get(r["lang"], 0) + r["n"]
        names = sorted(sorted((n for n in sums if seen[n] >= least), key=lambda n: -seen[n])[:MOST_LANGUAGES])
        return cls(names, np.stack([sums[n] for n in names])) if len(names) > 1 else None

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihood of every text in each language, and its number of trigrams."""
        cells, row = gram_cells(texts)
        n = np.bincount(row, minlength=len(texts))
        return np.stack([np.bincount(row, weights=w[cells], minlength=len(texts)) for w in self.weights], axis=1), n

    def tell(self, texts: list[str | None], margin: float, least: int, odd: float = 1.5) -> np.ndarray:
        """The number of each text's language, -1 where none is sure.

        Needed are ``least`` trigrams, a ``margin`` of log-likelihood over the next
        language, and trigrams at most ``odd`` less likely than usual: text in none of the
        languages is in none of them.
        """
        s, n = self.scores(texts)
        order, best = np.sort(s, axis=1), s.argmax(axis=1)
        sure = (n >= least) & (order[:, -1] - order[:, -2] >= margin) & (order[:, -1] >= (self.usual[best] - odd) * n)
        return np.where(sure, best, -1)

    def mismatches(self, prompts: list, responses: list, defects: list, margin: float = 6.0, least: int = 24) -> list:
        """``defects`` with ``language`` where prompt and response are surely in different languages."""
        distinct = list({p: None for p in prompts if p is not None})
        told = dict(zip(distinct, self.tell(distinct, margin, least))) if distinct else {}
        answered = self.tell(responses, margin, least)
        return [d if d is not None or p is None or told[p] < 0 or a < 0 or told[p] == a else "language" for d, p, a in zip(defects, prompts, answered)]
