"""Problem 9: oversized texts cut at natural boundaries, by bounded-quantifier patterns.

The tokens of a text are written as a string of one letter each, which says what kind of
boundary follows the token.  A pattern with bounded quantifiers, its alternatives in order
of boundary strength, then consumes that string piece by piece in SQL; the lengths of the
matches, an array, give the token ranges by one running sum, and offsets into the array of
characters look back for the overlap.  Every piece is encoded again on its own: one that
does not keep the limit is cut once more.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.runtime import collect_bounded
from corpusmill.llm.tokens import TOKENIZER, encode, encoder

#: Boundary letters, strongest first: paragraph, line, sentence, clause, word, bracket or comma
#: without a space, character; x is inside a character.
LETTERS = "pnscwkix"
#: Tokens kept free in each piece, so that one which merges otherwise on its own rarely has to be cut again.
SLACK = 8

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True
_CLOSE = np.zeros(256, bool)
_CLOSE[[ord(c) for c in ",;]})>|"]] = True
_OPEN = np.zeros(256, bool)
_OPEN[[ord(c) for c in "[{(<|"]] = True
_PAUSE = np.zeros(256, bool)
_PAUSE[[ord(c) for c in ",;:"]] = True


def boundary_letters(text: str, path: str = TOKENIZER) -> tuple[str, np.ndarray]:
    """One boundary letter a token, and the character offset at which each token ends.

    A token that ends inside a character gets the offset before that character.
    """
    ids = encode(text, path)
    if not len(ids):
        return "", np.zeros(0, np.int32)
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    ends = np.cumsum(encoder(path)[1][ids])
    padded = np.concatenate((np.zeros(4, np.uint8), raw, np.full(1, 10, np.uint8)))
    b1, b2, b3, after = (padded[ends + k] for k in (3, 2, 1, 4))
    after_at_end = ends == len(raw)
    closing = np.isin(b1, [ord(c) for c in "\"')]"]) & (_STOP[b2])
    wide_stop = ((b3 == 0xE3) & (b2 == 0x80) & (b1 == 0x82)) | ((b3 == 0xEF) & (b2 == 0xBC) & np.isin(b1, [0x81, 0x9F]))
    wide_pause = ((b3 == 0xE3) & (b2 == 0x80) & (b1 == 0x81)) | ((b3 == 0xEF) & (b2 == 0xBC) & np.isin(b1, [0x8C, 0x9A, 0x9B]))
    line = np.isin(b1, [10, 13])
    letter = np.full(len(ends), "i")
    letter[_CLOSE[b1] | _OPEN[after]] = "k"
    letter[_SPACE[after] | _SPACE[b1]] = "w"
    letter[(_PAUSE[b1] & _SPACE[after]) | wide_pause] = "c"
    letter[((_STOP[b1] | closing) & _SPACE[after]) | wide_stop] = "s"
    letter[line] = "n"
    letter[line & (np.isin(b2, [10, 13]) & ~((b2 == 13) & (b1 == 10)) | ((b2 == 13) & (b1 == 10) & (b3 == 10)))] = "p"
    letter[(b1 == 13) & (after == 10) & ~after_at_end] = "i"  # never between the two marks of one line end
    inner = (after & 0xC0) == 0x80
    letter[inner & ~after_at_end] = "x"
    chars = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))[ends].astype(np.int32)
    chars[inner & ~after_at_end] -= 1
    return "".join(letter), chars


def piece_pattern(core: int) -> str:
    """The pattern that takes one piece of at most ``core`` tokens off a letter string.

    The rest is taken whole if it fits.  Otherwise the strongest boundary in the second
    half of the room wins, the latest of its kind; failing all, the latest end of a
    character; failing that (one character of more tokens than fit), the room is filled.
    """
    least = max(0, core // 2 - 1)
    cuts = "|".join(f".{{{least},{core - 1}}}{c}" for c in LETTERS[:6])
    return f".{{1,{core}}}$|{cuts}|.{{0,{core - 1}}}[^x]|.{{1,{core}}}"


def _first(begin: int, overlap: int, chars: np.ndarray) -> int:
    """The token at which a piece starts that looks back ``overlap`` tokens: on over tokens inside a character."""
    look = max(begin - overlap, 0)
    while look and chars[look - 1] == (chars[look - 2] if look > 1 else 0):
        look -= 1  # the token before ends no character
    return look


def _cut_again(letters: str, begin: int, end: int) -> int:
    """A cut inside (begin, end): the strongest boundary of the second half, the latest of its kind, else the middle."""
    middle = (begin + end) // 2
    for letter in LETTERS[:-1]:
        at = letters.rfind(letter, middle, end - 1)
        if at >= 0:
            return at + 1
    return max(begin + 1, middle)


def token_ranges(text: str, letters: str, chars: np.ndarray, sizes: np.ndarray, max_tokens: int, overlap: int, path: str) -> list[tuple[int, int, int]]:
    """(first token, begin of its own part, end) of every piece; each encodes to fewer than ``max_tokens`` tokens by itself.

    ``sizes`` are the lengths of the pieces' own parts.  A piece of a single token, or of
    a single character, is left as it is.
    """
    out, begin = [], 0
    waiting = np.cumsum(sizes).tolist()[::-1]
    while waiting:
        end = waiting[-1]
        first = _first(begin, overlap, chars) if out else 0
        a, b = int(chars[first - 1]) if first else 0, int(chars[end - 1])
        if end - begin > 1 and b - a > 1 and len(encode(text[a:b], path)) >= max_tokens:
            waiting.append(_cut_again(letters, begin, end))
            continue
        out.append((first, begin, end))
        begin = waiting.pop()
    return out


def split_documents(documents: DataFrame, max_tokens: int, overlap: int = 0, id_col: str = "doc_id", text_col: str = "text", path: str = TOKENIZER) -> DataFrame:
    """(id, piece, pieces, first_token, n_tokens, overlap_tokens, start_char, end_char, text).

    One row a piece of every text of more than ``max_tokens`` tokens; other texts, null and
    empty ones among them, give none.  A piece has fewer than ``max_tokens`` tokens, also
    when it is encoded alone, ends at the strongest boundary in reach and, from the second
    on, repeats the last ``overlap`` tokens before its own (a few more where these would
    start inside a character).  Offsets are in characters (code points); the pieces without
    their overlap join to the text again.  A text of at most ``max_tokens`` bytes cannot be
    oversized and is not tokenised.  The work is linear in a text's length.
    """
    core = max_tokens - 1 - SLACK - overlap
    if core < 8:
        raise ValueError("max_tokens must exceed the overlap by more than the slack")

    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                letters, chars = boundary_letters(text, path)
                if len(letters) > max_tokens:
                    for column, value in zip(out, (rid, text, letters, chars)):
                        column.append(value)
            arrays = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string()), pa.array(out[3], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, [id_col, "text", "letters", "chars"])

    large = documents.filter(F.octet_length(F.col(text_col)) > max_tokens).select(F.col(id_col).cast("bigint").alias(id_col), F.col(text_col).alias("text"))
    cut = large.mapInArrow(run, f"{id_col} bigint, text string, letters string, chars array<int>")
    sized = cut.withColumn("sizes", F.transform(F.regexp_extract_all("letters", F.lit(piece_pattern(core)), F.lit(0)), lambda m: F.length(m)))

    def slices(batches):
        for batch in batches:
            for rid, text, letters, chars, sizes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), batch.column(4)):
                chars, sizes = (np.asarray(c.values.to_numpy(zero_copy_only=False)) for c in (chars, sizes))
                ranges = np.array(token_ranges(text, letters, chars, sizes, max_tokens, overlap, path), np.int64).reshape(-1, 3)
                first, begin, end = ranges.T
                n = len(ranges)
                starts = np.where(first > 0, chars[first - 1], 0).astype(np.int64)
                ends = chars[end - 1].astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([rid] * n, pa.int64()), pa.array(np.arange(n, dtype=np.int32)), pa.array([n] * n, pa.int32()), *(pa.array(c) for c in (first, end - first, begin - first, starts, ends)), pa.array([text[a:b] for a, b in zip(starts.tolist(), ends.tolist())], pa.string())],
                    [id_col, "piece", "pieces", "first_token", "n_tokens", "overlap_tokens", "start_char", "end_char", "text"],
                )

    return sized.mapInArrow(slices, f"{id_col} bigint, piece int, pieces int, first_token bigint, n_tokens bigint, overlap_tokens bigint, start_char bigint, end_char bigint, text string")


def split_by_limits(documents: DataFrame, limits: DataFrame, **options) -> DataFrame:
    """``split_documents`` for every split limit of ``limits``."""
    wanted = collect_bounded(limits.filter("purpose = 'split' AND max_tokens > 0").select("limit_id", "max_tokens", F.coalesce("overlap_tokens", F.lit(0)).alias("overlap")).orderBy("limit_id"), 100, "split limits")
    out = None
    for r in wanted:
        part = split_documents(documents, r["max_tokens"], r["overlap"], **options).select(F.lit(r["limit_id"]).cast("bigint").alias("limit_id"), "*")
        out = part if out is None else out.unionByName(part)
    return out
