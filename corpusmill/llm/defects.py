"""Problem 3: broken prompt and response pairs, with the type of the defect.

Copy, language and termination are judged on each pair alone.  Refusals are not: they are
opening sentences that recur across unrelated prompts without a solution.  The opening
sentences of responses without code are therefore clustered (MinHash candidates, then all
pairs of different components that filters leave, verified by Jaccard).  A cluster is a refusal template if it recurs over enough prompts that are no
copies of one another, if responses that open in the same words hardly ever hold code, and
if what follows the opening is nothing or recurs as well.  Openings too rare to judge by
recurrence need wording that declines.
"""

from __future__ import annotations

import ast
import builtins
import keyword
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.runtime import cut
from corpusmill.functions.skew import hottest, join_unique
from corpusmill.llm.graph import groups
from corpusmill.llm.languages import LanguageModel
from corpusmill.llm.neargroups import needed

# General wording that declines a request, for openings too rare to recur.
_DECLINES = re.compile(
    r"\b(?:can(?:no|')t|can not|could ?n[o']t|won't|will not|unable to|not able to|not going to|must refrain from|have to decline|decline to|refuse to|(?:would|'d) rather not)\b[^.!?\n]{0,40}\b(?:help|assist|answer\w*|provide|writ\w+|share|solve|solution|produce|give|comply|respond)\b"
    r"|\b(?:kann|möchte|werde|darf)\b[^.!?\n]{0,60}\b(?:nicht|keine)\b[^.!?\n]{0,40}\b(?:helfen|beantworten|lösen|schreiben|geben|anbieten|liefern)\b|\btut mir leid\b"
    r"|\bno (?:puedo|voy a|debo)\b[^.!?\n]{0,40}\b(?:ayudar|responder|escribir|resolver|dar|compartir)\b|\blo siento\b|\bprefiero no\b"
    r"|\bne (?:peux|vais|souhaite|dois|donnerai|fournirai|répondrai|ferai)\b[^.!?\n]{0,20}\b(?:pas|rien)\b|\bdésolée?\b|\bpréfère ne pas\b"
    r"|\bnão (?:posso|vou|devo)\b[^.!?\n]{0,40}\b(?:ajudar|responder|escrever|resolver|dar|compartilhar)\b|\bdesculpe\b|\bprefiro não\b"
    r"|无法|不能帮|不想回答|不会给出|抱歉|对不起",
    re.IGNORECASE,
)
_FENCE = re.compile(r"```[^\n`]*\n?|~~~[^\n]*\n?")
_TAG = re.compile(r"</?[A-Za-z_][\w-]*>")
_BLOCK = re.compile(r"```[^\n`]*(?:\n(.*?)(?:```|\Z)|```)|<code>(.*?)(?:</code>|\Z)", re.DOTALL)
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_CODE_LINE = re.compile(r"^(?:\s{2,}\S|\t|(?:def|class|import|from|for|while|if|elif|else|try|except|with|return|print|pass|raise|yield|async|assert|@)\b.*[:()=\w]\s*$|#|@|[\w.\[\], ]+\s*(?:[-+*/%|&]?=)\s*\S|[\w.]+\(.*\)?\s*$|[)\]}]+\s*$|\"\"\"|''')")
_HAS_CODE = re.compile(r"^\s*(?:def \w|class \w|import \w|from \w+ import|(?:for|while|if)\b.*:\s*$|return\b|print\()|^\s*\w+(?:\[[^\]]*\])?\s*[-+*/%]?=\s*\S|^\w+\(.*\)\s*$", re.MULTILINE)
_CJK = re.compile(r"[㐀-鿿]")
_NAME = re.compile(r"[^\W\d]\w*")
_LAST_NAME = re.compile(r"[^\W\d]\w*\Z")
_GLUE = 12
_OWN_TAIL = 12
_STATEMENTS = ("def", "return", "print")
_KNOWN = set(dir(builtins)) | set(keyword.kwlist)
OPENING_WORDS = 4
#: So many sentences of a response count as its opening: a polite one may stand first.
OPENINGS = 3
#: How often components of openings are compared by one sentence of each, before all of their pairs are.
HEAD_ROUNDS = 2
_SENTENCE = re.compile(r"[^.!?。！？\n]*[.!?。！？\n]+|[^.!?。！？\n]+\Z")


def visible(text: str) -> str:
    """The text without code fences, their language names and tags."""
    return _TAG.sub("", _FENCE.sub("", text)).strip("﻿​ \t\r\n\xa0")


def is_code_text(text: str) -> bool:
    """Whether a text reads as code (statements on lines of their own)."""
    return bool(_HAS_CODE.search(text))


def prose_of(text: str) -> str:
    """The text outside code: fenced and tagged blocks of code and code lines are left out."""

    def block(m):
        inner = m.group(1) if m.group(1) is not None else m.group(2) or ""
        return "\n" if is_code_text(inner) else "\n" + inner + "\n"

    lines = _TAG.sub("", _BLOCK.sub(block, text)).split("\n")
    return "\n".join(x for x in lines if not _CODE_LINE.match(x))


def docstrings(text: str) -> str:
    """The comment and string prose of a code prompt."""
    return "\n".join(re.findall(r'"""(.*?)(?:"""|\Z)', text, re.DOTALL))


def _grams(words: list[str]) -> set:
    return set(zip(words, words[1:], words[2:])) if len(words) > 2 else set()


def is_copy(prompt_words: list[str], response_words: list[str]) -> bool:
    """Whether the response is the prompt again, whole or nearly so, with nothing of its own."""
    n, m = len(response_words), len(prompt_words)
    if n < 5 or m < 5 or n > 1.6 * m + _GLUE or n < 0.5 * m:
        return False
    own = Counter(response_words)
    own.subtract(Counter(prompt_words))
    extra = sum(v for v in own.values() if v > 0)
    if extra > 0.25 * n + 4 or any(own[w] > 0 for w in _STATEMENTS):
        return False
    a, b = _grams(prompt_words), _grams(response_words)
    # a run of words of its own at the end is an answer that follows a quotation
    for i in range(n - _OWN_TAIL, n - 2):
        if i >= 0 and tuple(response_words[i : i + 3]) in a:
            break
    else:
        return False
    both = len(a & b)
    return both >= 0.55 * len(b) and both >= 0.45 * len(a)


def _bracket_open(text: str) -> bool:
    depth = 0
    for ch in text:
        if ch in "([{":
            depth += 1
        elif ch in ")]}":
            depth -= 1
    return depth > 0


def _last_is_whole(tree: ast.Module) -> bool:
    """Whether a program's last statement ends something: a return, a call, or a full block."""
    node = tree.body[-1]
    while isinstance(node, (ast.For, ast.While, ast.If, ast.With, ast.Try)):
        inner = node.orelse or node.body
        node = inner[-1]
    if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
        last = node.body[-1]
        if isinstance(last, (ast.Return, ast.Pass, ast.Raise)):
            return True
        prints = any(isinstance(x, ast.Call) and getattr(x.func, "id", "") == "print" for x in ast.walk(last))
        return prints or (isinstance(last, ast.Expr) and isinstance(last.value, ast.Constant))
    return isinstance(node, (ast.Expr, ast.Return, ast.Pass, ast.Assign, ast.AugAssign, ast.ClassDef, ast.Raise, ast.Assert))


def code_breaks_off(code: str) -> bool:
    """Whether code stops short: no parse, an unfinished last function, or a name cut in half."""
    code = code.replace("\r\n", "\n").strip("\n")
    if not code.strip():
        return False
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return True
    if not tree.body:
        return True
    if not _last_is_whole(tree):
        return True
    # a name at the very end that stands nowhere else was cut in half
    last = None if code.rsplit("\n", 1)[-1].lstrip().startswith("#") else _LAST_NAME.search(code)
    return bool(last) and last.group() not in _KNOWN and _NAME.findall(code).count(last.group()) < 2


def breaks_off(response: str) -> bool:
    """Whether a response stops inside a word, sentence, bracket or code block."""
    text = response.replace("\r\n", "\n").replace("\r", "\n").rstrip("﻿​ \t\n\xa0")
    if text.count("```") % 2 or text.count("<code>") > text.count("</code>") or re.search(r"<[/A-Za-z]*$|(?<!`)`{1,2}$", text):
        return True
    blocks = [(m.group(1) if m.group(1) is not None else m.group(2) or "") for m in _BLOCK.finditer(text)]
    if any(is_code_text(b) and code_breaks_off(b) for b in blocks):
        return True
    if text.endswith(("```", "</code>")):
        inner = blocks[-1].strip() if blocks else ""
        return bool(inner) and not is_code_text(inner) and _prose_breaks_off(inner)
    rest = _BLOCK.sub("\n", text)
    if not blocks and is_code_text(rest):
        lines = rest.split("\n")
        first = next((i for i, x in enumerate(lines) if _HAS_CODE.match(x) or x.startswith(("#", '"""'))), 0)
        if not any(_prose_line(x) for x in lines[first:] if x and not x[0].isspace()):
            return code_breaks_off("\n".join(lines[first:]))
        return _tail_breaks_off(lines)
    return _prose_breaks_off(rest)


def _prose_line(line: str) -> bool:
    return not _CODE_LINE.match(line) and len(_WORD.findall(line)) >= 4


def _tail_breaks_off(lines: list[str]) -> bool:
    """For code with prose after it: the run of code lines or prose at the very end decides."""
    last = next((x for x in reversed(lines) if x.strip()), "")
    if _prose_line(last):
        return _prose_breaks_off(last)
    k = len(lines)
    while k and (not lines[k - 1].strip() or lines[k - 1][0].isspace() or not _prose_line(lines[k - 1])):
        k -= 1
    return code_breaks_off("\n".join(lines[k:]))


def _prose_breaks_off(text: str) -> bool:
    text = text.strip()
    if not text:
        return False
    if text[-1] in ".!?。！？…`*":
        return False
    if text[-1] in "\"'”’»)]" and len(text) > 1:
        return _bracket_open(text)
    words = _WORD.findall(text)
    if not words or text in ("pass", "None", "True", "False") or re.fullmatch(r"[\d\s.,:+\-*/]+", text):
        return False
    if len(words) <= 3 and re.search(r"\d", text) and len(text) < 24 and not text[0].isupper():
        return False
    return True


def first_sentences(text: str, most: int) -> tuple[list[str], int]:
    """The first sentences of a text, and where the last of them starts if there are ``most`` (else the text ends).

    A sentence runs up to a stop, question or exclamation mark or the end of a line.
    """
    out = []
    for m in _SENTENCE.finditer(text):
        if any(c.isalnum() for c in m.group()):
            out.append(m.group().strip())
            if len(out) == most:
                return out, m.start()
    return out, len(text)


def opening_key(sentence: str) -> str:
    """The first words of a sentence (CJK: first characters), by which responses are counted."""
    low = sentence.lower()
    cjk, word = _CJK.search(low), _WORD.search(low)
    if cjk and (not word or word.start() >= cjk.start()):
        return "".join(_CJK.findall(low)[:8])
    return " ".join(_WORD.findall(low)[:OPENING_WORDS])


def opening_grams(sentence: str) -> list[str]:
    """Words and word pairs of an opening sentence (CJK: characters and pairs), the set that is compared."""
    low = sentence.lower()
    units = _WORD.findall(low)
    if len(_CJK.findall(low)) > len(units):
        units = [c for c in low if c.isalnum()]
    return sorted(set(units) | {f"{a} {b}" for a, b in zip(units, units[1:])})


def prompt_marks(words: list[str]) -> tuple[int, int]:
    """Two MinHash values of a prompt: equal for copies, mostly for near copies, never for unrelated prompts."""
    grams = {" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))}
    return tuple(min(xxhash.xxh64_intdigest(g, seed) for g in grams) >> 1 for seed in (1, 2))


class Judged:
    """Columns of judged pairs; ``prose`` of prompt and response are kept where a language is still to be told."""

    def __init__(self):
        self.defect: list = []
        self.code: list = []
        self.openings: list = []
        self.marks: list = []
        self.declines: list = []
        self.prose: list = []
        self.prompt_prose: list = []


def judge_rows(prompts: list, responses: list) -> Judged:
    """Each pair judged alone: empty, copy, truncated or open; refusals and languages are left open."""
    seen: dict[str, tuple] = {}
    out = Judged()
    for prompt, response in zip(prompts, responses):
        defect = openings = marks = prose = prompt_prose = None
        code = declines = False
        shown = visible(response) if response is not None else ""
        if not any(c.isalnum() for c in shown):
            defect = "empty"
        else:
            key = prompt or ""
            if key not in seen:
                if len(seen) > 4000:
                    seen.clear()
                words = re.findall(r"\w+", visible(key).lower())
                seen[key] = [words, set(words), prose_of(key) + "\n" + docstrings(key), None]
            known = seen[key]
            p_words, p_set, told, _ = known
            r_words = re.findall(r"\w+", shown.lower())
            code = is_code_text(shown)
            if p_words and sum(w in p_set for w in r_words[-12:]) >= 0.4 * min(12, len(r_words)) and is_copy(p_words, r_words):
                defect = "copy"
            elif breaks_off(response):
                defect = "truncated"
            else:
                prose, prompt_prose = prose_of(response), told
                parts, rest = first_sentences(shown, OPENINGS + 1)
                # (words it opens in, the sentence where no code follows, the next sentence)
                openings = [(opening_key(x), None if code else x, None if code else after) for x, after in zip(parts[:OPENINGS], [*parts[1:], ""])]
                if not code:
                    declines = bool(_DECLINES.search(shown, rest))
                    if known[3] is None:
                        known[3] = prompt_marks(p_words)
                    marks = known[3]
        for column, value in ((out.defect, defect), (out.code, code), (out.openings, openings), (out.marks, marks), (out.declines, declines), (out.prose, prose), (out.prompt_prose, prompt_prose)):
            column.append(value)
    return out


def opening_clusters(openings: DataFrame, similarity: float = 0.5, bands: int = 16, rows_a_band: int = 2) -> DataFrame:
    """(h, cluster): opening sentences linked to others, with the smallest hash of their cluster; unlinked ones are left out.

    ``openings`` holds one row a sentence (h, sentence) with a 64-bit hash as id.  A cluster
    is a component of the links between all sentences whose Jaccard similarity is at least
    ``similarity``.  MinHash finds most of each at little cost: the sentences of a band
    bucket are compared to two of its members, the smallest and the largest hash (found by
    aggregates, so a bucket of any size costs two comparisons a sentence), in each of
    ``bands`` buckets.  What this misses is then looked for between the components, by
    filters that leave no near pair out (see ``_links_between``).
    """
    seeds = np.random.default_rng(5).integers(1, 1 << 62, bands * rows_a_band)

    def sign(batches):
        for batch in batches:
            hs, keys, gs = [], [], []
            for h, sentence in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                codes = np.array([xxhash.xxh64_intdigest(g) for g in opening_grams(sentence)], np.uint64)
                if not len(codes):
                    continue
                mins = ((codes[:, None] * (2 * seeds.astype(np.uint64) + np.uint64(1))[None, :]) >> np.uint64(16)).min(axis=0)
                buckets = mins.reshape(bands, rows_a_band).sum(axis=1) * np.uint64(bands) + np.arange(bands, dtype=np.uint64)
                hs.append(h)
                keys.append(buckets.astype(np.int64).tolist())
                gs.append(codes.astype(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(hs, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(gs, pa.list_(pa.int64()))], ["h", "buckets", "grams"])

    signed = cut(openings.select("h", "sentence").mapInArrow(sign, "h bigint, buckets array<bigint>, grams array<bigint>"))
    sets = _shared_grams(signed)
    placed = signed.select("h", F.explode("buckets").alias("bucket"))
    ends = placed.groupBy("bucket").agg(F.min("h").alias("low"), F.max("h").alias("high")).filter("low < high")
    met = join_unique(placed, ends, "bucket").select("h", F.explode(F.array("low", "high")).alias("head")).filter("h <> head").select(F.least("h", "head").alias("x"), F.greatest("h", "head").alias("y")).distinct()
    found = cut(groups(_similar(met, sets, similarity)))
    between = _links_between(sets, found, similarity)
    if between is not None:
        found = groups(found.unionByName(between.toDF("node", "root")))
    return found.select(F.col("node").alias("h"), F.col("root").alias("cluster"))


def _shared_grams(signed: DataFrame) -> DataFrame:
    """(h, size, tokens): the grams that a sentence shares with any other, rare ones first; ``size`` counts all of its grams."""
    each = signed.select("h", F.size("grams").alias("size"), F.explode("grams").alias("token"))
    counts = cut(each.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    shared = join_unique(each, counts, "token", hot=hottest(counts, "token", "n"))
    return cut(shared.groupBy("h", "size").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "token"))), lambda p: p["token"]).alias("tokens")))


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The rows of ``pairs`` (x, y and others) whose sentences reach the similarity."""
    end = lambda c: sets.select(F.col("h").alias(c), F.col("size").alias(f"{c}s"), F.col("tokens").alias(f"{c}t"))
    met = join_unique(cut(join_unique(cut(pairs), end("x"), "x")), end("y"), "y").withColumn("both", F.size(F.array_intersect("xt", "yt")))
    return cut(met.filter(F.col("both") >= F.lit(similarity) * (F.col("xs") + F.col("ys") - F.col("both")) - 1e-9).select(pairs.columns))


def _links_between(sets: DataFrame, components: DataFrame, similarity: float) -> DataFrame | None:
    """(a, b): components, named by their smallest hash, that near sentences link; none if none are near.

    Every near pair of sentences in different components is found, or its components are
    linked by others.  Near sentences share a gram of their prefixes (the first
    ``size - ceil(similarity * size) + 1`` grams, rare ones first), so components come into
    question by such grams, and stay if the grams of all their sentences have so many in
    common as their shortest sentences need.  Of m common grams of which k are needed, near
    sentences share one of the rarest m - k + 1; of the sentences with one of these, those
    stay that have enough in common with all grams of the other side.  They are compared
    with one sentence of the other side, which links most components that can be linked;
    between all others every pair with one of the rarest common grams is compared.
    """
    own = cut(sets.join(components.select(F.col("node").alias("h"), F.col("root").alias("comp")), "h", "left").withColumn("comp", F.coalesce("comp", "h")))
    alone = F.col("size") - F.size("tokens")  # grams of no other sentence, which come first
    prefix = F.col("size") - F.ceil(F.lit(similarity) * F.col("size") - 1e-9).cast("int") + 1
    leading = own.select("h", "comp", "size", alone.alias("alone"), F.posexplode(F.slice("tokens", 1, F.greatest(prefix - alone, F.lit(0)))).alias("at", "token")).select("token", "h", "comp", "size", (F.col("at") + F.col("alone")).alias("pos"))
    each = own.select("h", "comp", "size", F.explode("tokens").alias("token"))
    grams = cut(each.groupBy("comp", "token").agg(F.count(F.lit(1)).alias("n")))
    widths = cut(grams.groupBy("comp").agg(F.count(F.lit(1)).alias("width")).join(own.groupBy("comp").agg(F.min("size").alias("low"), F.max("size").alias("high")), "comp"))
    kinds = leading.groupBy("token", "comp").agg(F.max(F.col("size") - F.col("pos")).alias("reach"))
    kinds = cut(kinds.join(widths, "comp").select("token", "reach", F.struct("width", "comp", "low", "high").alias("c")))

    # the grams of the component that has fewer are looked up in the other's
    p, q, t = kinds.alias("p"), kinds.alias("q"), F.lit(similarity)
    fit = (F.col("p.token") == F.col("q.token")) & (F.col("p.c") < F.col("q.c")) & (F.col("p.c.high") >= t * F.col("q.c.low") - 1e-9) & (F.col("q.c.high") >= t * F.col("p.c.low") - 1e-9)
    need = needed(F.col("comp.low"), F.col("other.low"), similarity)
    two = p.join(q, fit).select(F.col("p.c").alias("comp"), F.col("q.c").alias("other"), F.least("p.reach", "q.reach").alias("reach"))
    two = two.groupBy("comp", "other").agg(F.count(F.lit(1)).alias("part"), F.max("reach").alias("reach"))
    # a common gram beyond the prefixes lies beyond that of the set whose prefix ends first
    beyond = F.ceil(t * F.greatest("comp.high", "other.high") - 1e-9) - 1
    two = two.filter((F.col("reach") >= need) & (F.col("part") + beyond >= need))
    two = two.select(F.col("comp.comp").alias("comp"), F.col("comp.low").alias("low"), F.col("other.comp").alias("other"), F.col("other.low").alias("other_low"))
    theirs = grams.select(F.col("comp").alias("other"), "token", F.col("n").alias("m"))
    need = needed(F.col("low"), F.col("other_low"), similarity).cast("int")
    common = two.join(grams, "comp").join(theirs, ["other", "token"]).groupBy(two.columns).agg(F.array_sort(F.collect_list(F.struct((F.col("n") + F.col("m")).alias("n"), "token"))).alias("common"))
    touching = cut(common.filter(F.size("common") >= need).withColumn("common", F.transform(F.slice("common", 1, F.size("common") - need + 1), lambda c: c["token"])))

    sides = touching.select("comp", "other", F.col("other_low").alias("low"), "common").unionByName(touching.select(F.col("other").alias("comp"), F.col("comp").alias("other"), "low", "common"))
    keys = cut(sides.select("comp", "other", "low", F.explode("common").alias("token")))
    held = cut(each.join(keys, ["comp", "token"]).select("h", "comp", "other", "size", "low").distinct())
    reach = held.join(sets.select("h", F.explode("tokens").alias("token")), "h").join(theirs, ["other", "token"])
    reach = reach.groupBy(held.columns).agg(F.count(F.lit(1)).alias("both"))
    open_ = cut(reach.filter(F.col("both") >= needed(F.col("size"), F.col("low"), similarity)).select("h", "comp", "other"))

    links = None

    def linked(pairs: DataFrame) -> bool:
        nonlocal links
        near = cut(_similar(pairs, sets, similarity).select("a", "b").distinct())
        some = not near.isEmpty()
        if some:
            links = near if links is None else cut(links.unionByName(near))
        return some

    for k in range(HEAD_ROUNDS):
        if open_.isEmpty():
            return links
        heads = open_.groupBy(F.col("comp").alias("other"), F.col("other").alias("comp")).agg(F.min(F.struct(F.xxhash64("h", F.lit(k)).alias("o"), "h"))["h"].alias("head"))
        if not linked(open_.join(heads, ["comp", "other"]).select(F.least("h", "head").alias("x"), F.greatest("h", "head").alias("y"), F.col("comp").alias("a"), F.col("other").alias("b")).distinct()):
            break
        label = groups(links)
        of = lambda c: label.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))  # noqa: E731, B023
        open_ = cut(open_.join(of("comp"), "comp", "left").join(of("other"), "other", "left").filter(F.coalesce("comp_root", "comp") != F.coalesce("other_root", "other")).select("h", "comp", "other"))
    rest = cut(each.join(open_, ["h", "comp"]).join(keys.drop("low"), ["comp", "other", "token"]))
    p, q = rest.alias("p"), rest.alias("q")
    same = (F.col("p.token") == F.col("q.token")) & (F.col("p.comp") == F.col("q.other")) & (F.col("p.other") == F.col("q.comp")) & (F.col("p.comp") < F.col("q.comp"))
    same &= F.least("p.size", "q.size") >= t * F.greatest("p.size", "q.size") - 1e-9
    linked(p.join(q, same).select(F.col("p.h").alias("x"), F.col("q.h").alias("y"), F.col("p.comp").alias("a"), F.col("q.comp").alias("b")).distinct())
    return links


def defective_pairs(
    records: DataFrame,
    labelled: DataFrame | None = None,
    least_rows: int = 4,
    least_prompts: int = 3,
    most_code: float = 0.05,
    least_tails: float = 0.6,
    id_col: str = "record_id",
    prompt_col: str = "prompt",
    response_col: str = "response",
    problem_col: str = "problem_id",
    fit_rows: int = 4000,
) -> DataFrame:
    """(record_id, defect): one row a defective pair, with one defect.

    In order: ``empty`` (null, or no letter or digit outside fences and tags), ``copy``
    (nearly all words are the prompt's and cover it), ``refusal``, ``truncated`` (stops
    inside a word, sentence, bracket or code block), ``language`` (prose outside code in
    another language than the prompt's).  A null or empty prompt can be neither copied nor
    mismatched.  Hints such as error types are not read.

    A cluster of opening sentences is a refusal template if it spans ``least_rows`` rows
    and ``least_prompts`` problems whose prompts are no near copies of one another (by
    distinct MinHash values), if of all rows that open in its words at most ``most_code``
    hold code, and if of its rows at least ``least_tails`` end with the opening or go on in
    words that recur over as many prompts.  A sentence with a number in it says something
    about its task and is no template.  Statistics cover all rows and are aggregated per
    opening before anything is joined.

    ``labelled`` (text, lang) is what languages are told by (see ``LanguageModel``), fitted
    on a sample of about ``fit_rows`` rows; without it no pair is called ``language``.
    Repeated rows are judged alike; an empty table gives an empty result.
    """
    model = LanguageModel.fit(labelled, fit_rows, prose_of) if labelled is not None else None

    def run(batches):
        for batch in batches:
            j = judge_rows(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            defect = model.mismatches(j.prompt_prose, j.prose, j.defect) if model is not None else j.defect
            columns = [
                batch.column(0),
                batch.column(1),
                pa.array(defect, pa.string()),
                pa.array(j.code, pa.bool_()),
                pa.array([None if o is None else [{"key": xxhash.xxh64_intdigest(k) >> 1, "sentence": x, "tail": t, "declines": x is not None and bool(_DECLINES.search(x))} for k, x, t in o if k] for o in j.openings], shape),
                pa.array([None if m is None else m[0] for m in j.marks], pa.int64()),
                pa.array([None if m is None else m[1] for m in j.marks], pa.int64()),
                pa.array(j.declines, pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["id", "problem", "defect", "code", "openings", "m1", "m2", "declines"])

    shape = pa.list_(pa.struct([("key", pa.int64()), ("sentence", pa.string()), ("tail", pa.string()), ("declines", pa.bool_())]))

    chosen = records.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(F.coalesce(F.col(problem_col), F.lit(""))).alias("problem"), F.col(prompt_col).alias("p"), F.col(response_col).alias("r"))
    judged = cut(chosen.mapInArrow(run, "id bigint, problem bigint, defect string, code boolean, openings array<struct<key: bigint, sentence: string, tail: string, declines: boolean>>, m1 bigint, m2 bigint, declines boolean").filter("defect IS NOT NULL OR openings IS NOT NULL"))
    opened = judged.select("id", "problem", "code", "m1", "m2", F.explode("openings").alias("o")).select("id", "problem", "code", "m1", "m2", "o.*").withColumn("h", _sentence_hash(F.col("sentence"))).withColumn("tail", F.when(F.col("tail") != "", F.xxhash64("tail")))
    bare = opened.filter("h IS NOT NULL")
    # how often rows that open in the same words hold code
    keys = opened.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("code").cast("long")).alias("coded"))
    # sentences with the marks of their prompts: one row a sentence, problem and prompt
    per = cut(bare.groupBy("h", "sentence", "key", "problem", "m1", "m2", "tail").agg(F.count(F.lit(1)).alias("n")))
    openings = cut(per.groupBy("h").agg(F.first("sentence").alias("sentence")))
    clusters = cut(openings.select("h").join(opening_clusters(openings), "h", "left").withColumn("cluster", F.coalesce("cluster", "h")))
    placed = cut(join_unique(per.drop("sentence"), clusters, "h"))
    spread = placed.groupBy("cluster").agg(F.least(F.count_distinct("m1"), F.count_distinct("m2")).alias("prompts")).filter(F.col("prompts") >= least_prompts)
    tails = cut(clusters.join(spread, "cluster").select(F.col("h").alias("tail"), F.lit(True).alias("recurs")))
    size = (
        join_unique(placed, tails, "tail", "left")
        .groupBy("cluster")
        .agg(
            F.sum("n").alias("n"),
            F.count_distinct("problem").alias("problems"),
            F.least(F.count_distinct("m1"), F.count_distinct("m2")).alias("prompts"),
            F.sum(F.when(F.col("tail").isNull() | F.col("recurs"), F.col("n")).otherwise(0)).alias("closed"),
        )
    )
    coded = placed.select("cluster", "key").distinct().join(keys, "key").groupBy("cluster").agg(F.sum("n").alias("opened"), F.sum("coded").alias("coded"))
    recurs = (F.col("n") >= least_rows) & (F.col("problems") >= least_prompts) & (F.col("prompts") >= least_prompts)
    template = (F.col("coded") <= F.lit(most_code) * F.col("opened")) & (F.col("closed") >= F.lit(least_tails) * F.col("n"))
    # words that responses with code open in are no refusal, however rare their sentence
    kind = F.when(recurs & template, "template").when(recurs | (F.col("coded") > 0), "answer").otherwise("rare")
    kinds = clusters.join(size.join(coded, "cluster", "left").select("cluster", kind.alias("kind")), "cluster").select("h", "kind")
    # a row declines if one of its openings is a template, or is rare and says so, or if a later sentence does
    refuses = (F.col("kind") == "template") | ((F.col("kind") == "rare") & F.col("declines"))
    found = join_unique(bare.select("id", "h", "declines"), cut(kinds.filter("kind <> 'answer'")), "h").filter(refuses).select("id").distinct().withColumn("found", F.lit(True))
    rows = judged.select("id", "defect", (F.col("declines") | F.coalesce(F.exists("openings", lambda o: o["declines"] & _sentence_hash(o["sentence"]).isNull()), F.lit(False))).alias("late")).join(found, "id", "left")
    refusal = (F.col("defect").isNull() | (F.col("defect") == "language")) & (F.col("late") | F.coalesce("found", F.lit(False)))
    return rows.select(F.col("id").alias(id_col), F.when(F.coalesce(refusal, F.lit(False)), "refusal").otherwise(F.col("defect")).alias("defect")).filter("defect IS NOT NULL")


def _sentence_hash(sentence):
    """The id of an opening sentence; none for one that holds a number."""
    return F.when(~sentence.rlike("[0-9]"), F.xxhash64(sentence))
