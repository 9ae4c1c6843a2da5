"""Text functions on columns: normalisation, hashing, code extraction, templates, transcripts.

Every function takes a column (or name) and returns a column; null in gives null out unless
the docstring says otherwise.  Patterns avoid lookaround, so the same text runs in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: White space other than the line feed, as Unicode has it.
WS = r"\t\x{0B}\x{0C}\x{0D}\x{1C}-\x{1F}\x{85}\p{Z}"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def canonical_prompt(col) -> Column:
    """Line ends as LF, no white space at line ends, runs of blank lines as one, trimmed; null as empty text."""
    t = F.coalesce(_c(col), F.lit(""))
    t = F.regexp_replace(F.regexp_replace(t, "\r\n", "\n"), "\r", "\n")
    t = F.regexp_replace(t, rf"[{WS}]+(\n|\z)", "$1")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return F.regexp_replace(t, rf"\A[\n{WS}]+|[\n{WS}]+\z", "")


def prompt_hash(col) -> Column:
    """SHA-256 of the canonical prompt."""
    return F.sha2(canonical_prompt(col), 256)


def lines_hash(rows: DataFrame, column: str, by: list[str] = ()) -> DataFrame:
    """SHA-256 of the sorted values joined by line feeds; one small list a group."""
    return rows.groupBy(*by).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(column)), "\n"), 256).alias("sha256"), F.count(column).alias("n"))


def one_line(col) -> Column:
    """Runs of white space as one blank, trimmed; null as empty text."""
    return F.trim(F.regexp_replace(F.coalesce(_c(col), F.lit("")), rf"[\n{WS}]+", " "))


def _longest(matches: Column) -> Column:
    """The longest element, the first of equals; null for none."""
    start = F.lit(None).cast("string")
    return F.aggregate(matches, start, lambda best, x: F.when(best.isNull() | (F.length(x) > F.length(best)), x).otherwise(best))


def _strip(col: Column) -> Column:
    return F.regexp_replace(col, rf"\A[\n{WS}]+|[\n{WS}]+\z", "")


def extract_code(col) -> Column:
    """The longest <code> block, else the longest fenced block, else the text; stripped. Null as empty text."""
    t = F.coalesce(_c(col), F.lit(""))
    tagged = F.regexp_extract_all(t, F.lit(r"(?is)<code>(.*?)</code>"), F.lit(1))
    fenced = F.regexp_extract_all(t, F.lit(r"(?s)```(?:python)?\s*\n(.*?)\n```"), F.lit(1))
    return _strip(F.coalesce(_longest(tagged), _longest(fenced), t))


def wrapper_type(col) -> Column:
    """empty, code_tag, md_fence or raw."""
    t = F.coalesce(_c(col), F.lit(""))
    return F.when(t == "", "empty").when(t.rlike(r"(?is)<code>.*?</code>"), "code_tag").when(t.contains("```"), "md_fence").otherwise("raw")


def guess_exception(col) -> Column:
    """The last name ending in Error, or Exception, before a colon; else the last one at all; else null."""
    t = F.coalesce(_c(col), F.lit(""))
    with_colon = F.regexp_extract_all(t, F.lit(r"\b([A-Za-z_]*Error|Exception)\s*:"), F.lit(1))
    bare = F.regexp_extract_all(t, F.lit(r"\b([A-Za-z_]*Error|Exception)\b"), F.lit(1))
    return F.coalesce(F.try_element_at(with_colon, F.lit(-1)), F.try_element_at(bare, F.lit(-1)))


_EXPECTED = r"(?s)Expected:\s*(.*?),\s*Got:\s*(.*)$"


def expected_got(col) -> tuple[Column, Column]:
    """The two sides of an ``Expected: a, Got: b`` message, null without one."""
    t = F.coalesce(_c(col), F.lit(""))
    has = t.rlike(_EXPECTED)
    return F.when(has, F.regexp_extract(t, _EXPECTED, 1)), F.when(has, F.regexp_extract(t, _EXPECTED, 2))


def mismatch_class(expected: Column, got: Column) -> Column:
    """How two outputs differ: equal, case, whitespace, case_whitespace, value; null if either is."""
    squeeze = lambda c: F.regexp_replace(c, rf"[\n{WS}]+", "")
    return (
        F.when(expected.isNull() | got.isNull(), F.lit(None).cast("string"))
        .when(expected == got, "equal")
        .when(F.lower(expected) == F.lower(got), "case")
        .when(squeeze(expected) == squeeze(got), "whitespace")
        .when(F.lower(squeeze(expected)) == F.lower(squeeze(got)), "case_whitespace")
        .otherwise("value")
    )


def strip_newlines(col) -> Column:
    """The text without line feeds at its end: the comparison of the sandbox."""
    return F.regexp_replace(_c(col), r"\n+\z", "")


def strip_both(col) -> Column:
    """The text without white space at both ends: the comparison of the judge."""
    return _strip(_c(col))


def split_lines(col) -> Column:
    """The stripped lines of a stripped text: the line-wise comparison."""
    return F.transform(F.split(_strip(_c(col)), "\n"), lambda x: _strip(x))


def entry_point(asserts) -> Column:
    """The first function that a test's assert calls, null if none does."""
    found = F.regexp_extract(F.array_join(_c(asserts), "\n"), r"assert\s+(?:\(\s*)*(?:not\s+)?([A-Za-z_]\w*)\s*\(", 1)
    return F.nullif(found, F.lit(""))


def example_call(asserts) -> Column:
    """The left side of the first assert that compares."""
    first = F.get(F.filter(_c(asserts), lambda x: x.rlike(r"^\s*assert\b.*==")), 0)
    return F.nullif(F.trim(F.regexp_extract(first, r"(?s)^\s*assert\s+(.*?)\s*==", 1)), F.lit(""))


def autofix_entry(col) -> tuple[Column, Column]:
    """(code, reason): a main guard that calls solve() appended where solve is defined and never called."""
    code = F.coalesce(_c(col), F.lit(""))
    defined = code.rlike(r"\bdef\s+solve\s*\(")
    guard = code.rlike(r"if\s+__name__\s*==\s*['\"]__main__['\"]\s*:")
    called = code.rlike(r"(?m)^\s*solve\s*\(\s*\)\s*$")
    reason = (
        F.when(_strip(code) == "", "empty_code")
        .when(~defined, "no_solve_def")
        .when(guard & called, "already_has_main_guard_and_solve_call")
        .when(called, "already_calls_solve")
        .otherwise("append_main_guard_solve_call")
    )
    fixed = F.concat(F.regexp_replace(code, rf"[\n{WS}]+\z", ""), F.lit('\n\nif __name__ == "__main__":\n    solve()\n'))
    return F.when(reason == "append_main_guard_solve_call", fixed).otherwise(code), reason


def classify_run(status: Column, run_status: Column, return_code: Column, output: Column, asserts_first: bool) -> Column:
    """The error type of a sandbox run.

    HumanEval looks for syntax errors before failed asserts, MBPP (``asserts_first``) the
    other way round.
    """
    ok = (status == "Success") & (return_code.isNull() | (return_code == 0))
    out = F.coalesce(output, F.lit(""))
    late = (run_status == "TimeLimitExceeded") | F.lower(out).contains("timelimitexceeded")
    c = F.when(ok, "success").when(F.coalesce(late, F.lit(False)), "timeout")
    pair = [("AssertionError", "wrong_answer"), ("SyntaxError", "syntax_error")]
    for word, kind in pair if asserts_first else pair[::-1]:
        c = c.when(out.contains(word), kind)
    return c.when(out.contains("Error"), "runtime_error").otherwise("wrong_answer")


def chat(user: Column, system: Column | None = None) -> Column:
    """A message list: system (where given) and user."""
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.array(message("system", system), message("user", user)) if system is not None else F.array(message("user", user))


def prompt_template(dataset: Column, prompt: Column, templates: dict[str, str], default: str = "{prompt}") -> Column:
    """The dataset's template with the prompt in its place."""
    out = None
    fill = lambda t: F.concat(F.lit(t.split("{prompt}")[0]), prompt, F.lit(t.split("{prompt}")[1]))
    for name, t in templates.items():
        out = F.when(dataset == name, fill(t)) if out is None else out.when(dataset == name, fill(t))
    return out.otherwise(fill(default)) if out is not None else fill(default)


def clean_hellaswag(col) -> Column:
    """Trimmed, [title] as a full stop, other brackets dropped, double blanks as one."""
    t = F.replace(F.trim(_c(col)), F.lit(" [title]"), F.lit(". "))
    return F.replace(F.regexp_replace(t, r"\[.*?\]", ""), F.lit("  "), F.lit(" "))


def media_parts(col) -> Column:
    """A message cut at <image> and <video>: (type, text) parts, empty texts dropped."""
    parts = F.split(_c(col), r"(?=<image>|<video>)|(?<=<image>|<video>)")
    typed = F.transform(parts, lambda p: F.struct(F.when(p == "<image>", "image").when(p == "<video>", "video").otherwise("text").alias("type"), F.when(~p.isin("<image>", "<video>"), p).alias("text")))
    return F.filter(typed, lambda p: (p["type"] != "text") | (p["text"] != ""))


def media_count_ok(col, images: Column, videos: Column) -> Column:
    """Whether a message names as many images and videos as come with it."""
    n = lambda w: F.size(F.regexp_extract_all(_c(col), F.lit(w), F.lit(0)))
    return (n("<image>") == images) & (n("<video>") == videos)


def tool_calls(col) -> Column:
    """(name, arguments) of each <tool_call> block that holds valid JSON with a name; others are skipped."""
    blocks = F.regexp_extract_all(_c(col), F.lit(r"(?s)<tool_call>(.*?)</tool_call>"), F.lit(1))
    parsed = F.transform(blocks, lambda b: F.struct(F.get_json_object(b, "$.name").alias("name"), F.get_json_object(b, "$.arguments").alias("arguments")))
    return F.filter(parsed, lambda p: p["name"].isNotNull())


def without_tool_calls(col) -> Column:
    """The text around the tool calls."""
    return F.regexp_replace(_c(col), r"(?s)<tool_call>.*?</tool_call>", "")


def passages_text(docs) -> Column:
    """Retrieved passages as text: ``Doc i (Title: first line)`` and the rest, from 1."""

    def one(d, i):
        lines = F.split(d, "\n")
        rest = F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), "\n")
        return F.concat(F.lit("Doc "), (i + 1).cast("string"), F.lit(" (Title: "), lines[0], F.lit(")\n"), rest, F.lit("\n\n"))

    return _strip(F.array_join(F.transform(_c(docs), one), ""))


def first_text(*cols) -> Column:
    """The first of several columns that is not blank."""
    return F.coalesce(*[F.when(F.trim(_c(c)) != "", _c(c)) for c in cols])


def last_assistant(turns: DataFrame, conv="conv_id", turn="turn", role="role", text="text") -> DataFrame:
    """(conv, text): the last assistant message of each conversation; null where there is none."""
    last = F.max(F.when(F.col(role) == "assistant", F.struct(turn, text)))
    return turns.groupBy(conv).agg(last[text].alias("text"))


def tool_reward(calls: DataFrame, conv="conv_id", order="turn", reward="reward", penalty: float = 0.05) -> DataFrame:
    """Adds ``adjusted``: a repeated answer loses the penalty unless its reward exceeds the one before."""
    w = Window.partitionBy(conv).orderBy(order)
    before = F.coalesce(F.lag(reward).over(w), F.lit(0.0))
    return calls.withColumn("adjusted", F.when(F.col(reward) > before, F.lit(0.0)).otherwise(F.lit(-float(penalty))))


def without_infinite(col) -> Column:
    """Infinite numbers and NaN as null, for JSON."""
    c = _c(col)
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(None).cast("double")).otherwise(c)


def prefixed(metrics, prefix: str) -> Column:
    """A metric map with a prefix before every key."""
    return F.transform_keys(_c(metrics), lambda k, v: F.concat(F.lit(prefix), k))
