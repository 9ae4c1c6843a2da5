"""Counting and cutting text in tokens of a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Default vocabulary: a rank file readable on every executor; every operator takes another path.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published pre-tokenisation pattern that belongs to these rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts are encoded in stretches of about so many characters, so that a huge text does not
#: build one huge token list.  Stretches end where a pre-token does, so they change no token.
STRETCH = 1 << 20
#: Places where a pre-token ends whatever stands around them: a letter, digit or mark
#: (not an apostrophe, which may open a contraction) before white space or another class.
_ENDS = regex.compile(r"(?<=\p{L})(?=[\p{P}\p{S}\p{Z}\t\n\r])|(?<=\p{Nd})(?=[\p{L}\p{P}\p{Z}\t\n\r])|(?<=[.,:;!?)\]}>=*_-])(?=[\p{L}\p{Nd}\p{Z}\t\n\r])")
#: Runs of white space too long for the pattern's look-ahead, which would exhaust its stack.
_BLANK = regex.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")


@functools.lru_cache(maxsize=4)
def encoder(path: str = TOKENIZER):
    """The encoding of a rank file and the byte length of each token, once a process."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths


def encode(text: str, path: str = TOKENIZER) -> np.ndarray:
    """Token ids of a text; nothing in it counts as a special token.

    A text longer than ``STRETCH`` is encoded in stretches that end at the next sure end
    of a pre-token; a text without one, such as a single word of megabytes, in one.
    """
    enc, _ = encoder(path)
    if len(text) < 10_000:
        return np.asarray(enc.encode_ordinary(text), np.int64)
    parts, at = [], 0

    def plain(end: int) -> None:
        nonlocal at
        while at < end:
            found = _ENDS.search(text, at + STRETCH, end) if end - at > STRETCH else None
            to = found.start() if found else end
            parts.append(enc.encode_ordinary(text[at:to]))
            at = to

    for blank in _BLANK.finditer(text):
        plain(blank.start())
        # all of the run but its last mark is one pre-token; at the end of the text all of it is
        end = blank.end() - (blank.end() < len(text))
        parts.append(enc._encode_single_piece(text[at:end]))
        at = end
    plain(len(text))
    return np.concatenate([np.zeros(0, np.int64), *(np.asarray(p, np.int64) for p in parts)])


def token_counts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = TOKENIZER) -> DataFrame:
    """(id, n_tokens) of every row; null for null texts, 0 for empty ones."""

    def run(batches):
        for batch in batches:
            counts = [None if t is None else len(encode(t, path)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], [id_col, "n_tokens"])

    return documents.select(F.col(id_col).cast("bigint").alias(id_col), F.col(text_col).alias("text")).mapInArrow(run, f"{id_col} bigint, n_tokens bigint")
