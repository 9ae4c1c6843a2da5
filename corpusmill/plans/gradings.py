"""Queries of graders and code extraction; answers are derived from the evaluation records."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import grading as G
from corpusmill.functions import text as T
from corpusmill.functions.runtime import table
from corpusmill.plans.registry import REGISTRY as R
from corpusmill.plans.views import rounded

_TRIM = r"regexp_replace({c}, '\A[\n\t\x{0B}\x{0C}\x{0D}\x{1C}-\x{1F}\x{85}\p{Z}]+|[\n\t\x{0B}\x{0C}\x{0D}\x{1C}-\x{1F}\x{85}\p{Z}]+\z', '', 'g')"
_LONGEST = "list_reduce(list_prepend(CAST(NULL AS VARCHAR), {l}), lambda best, x: CASE WHEN best IS NULL OR length(x) > length(best) THEN x ELSE best END)"


@R.add("f15_extract_code", f"WITH r AS (SELECT record_id, coalesce(response, '') AS t FROM per_problem) SELECT record_id, {_TRIM.replace('{c}', 'coalesce(' + _LONGEST.replace('{l}', chr(39).join(['regexp_extract_all(t, ', '(?is)<code>(.*?)</code>', ', 1)'])) + ', ' + _LONGEST.replace('{l}', chr(39).join(['regexp_extract_all(t, ', '(?s)```(?:python)?' + chr(92) + 's*' + chr(92) + 'n(.*?)' + chr(92) + 'n```', ', 1)'])) + ', t)')} AS code FROM r")
def f15_extract_code(spark, sf):
    return table(spark, sf, "per_problem").select("record_id", T.extract_code("response").alias("code"))


@R.add("f16_wrappers", "SELECT record_id, CASE WHEN coalesce(response, '') = '' THEN 'empty' WHEN regexp_matches(response, '(?is)<code>.*?</code>') THEN 'code_tag' WHEN contains(response, '```') THEN 'md_fence' ELSE 'raw' END AS wrapper FROM per_problem")
def f16_wrappers(spark, sf):
    return table(spark, sf, "per_problem").select("record_id", T.wrapper_type("response").alias("wrapper"))


_SOLVE = r"""WITH r AS (SELECT record_id, replace(coalesce(response, ''), 'def ' || coalesce(nullif(regexp_extract(response, 'def ([a-z_0-9]+)\(', 1), ''), '#'), 'def solve') AS c FROM per_problem),
k AS (SELECT record_id, c, CASE WHEN trim(c, ' ' || chr(9) || chr(10) || chr(13) || chr(160) || chr(65279)) = '' AND NOT contains(c, chr(65279)) THEN 'empty_code' WHEN NOT regexp_matches(c, '\bdef\s+solve\s*\(') THEN 'no_solve_def'
  WHEN regexp_matches(c, 'if\s+__name__\s*==\s*[''"]__main__[''"]\s*:') AND regexp_matches(c, '(?m)^\s*solve\s*\(\s*\)\s*$') THEN 'already_has_main_guard_and_solve_call' WHEN regexp_matches(c, '(?m)^\s*solve\s*\(\s*\)\s*$') THEN 'already_calls_solve' ELSE 'append_main_guard_solve_call' END AS reason FROM r)
SELECT record_id, reason, length(c) AS n FROM k"""


@R.add("f17_autofix", _SOLVE)
def f17_autofix(spark, sf):
    name = F.coalesce(F.nullif(F.regexp_extract("response", r"def ([a-z_0-9]+)\(", 1), F.lit("")), F.lit("#"))
    rows = table(spark, sf, "per_problem").withColumn("c", F.replace(F.coalesce("response", F.lit("")), F.concat(F.lit("def "), name), F.lit("def solve")))
    _, reason = T.autofix_entry("c")
    return rows.select("record_id", reason.alias("reason"), F.length("c").cast("bigint").alias("n"))


_RUNS = """WITH r AS (SELECT record_id, CASE WHEN accepted THEN 'Success' ELSE 'Failed' END AS st, CASE WHEN error_type = 'timeout' THEN 'TimeLimitExceeded' ELSE 'Finished' END AS rs, CASE WHEN accepted THEN 0 ELSE 1 END AS rc,
  CASE error_type WHEN 'syntax_error' THEN 'SyntaxError after AssertionError' WHEN 'wrong_answer' THEN 'AssertionError' WHEN 'runtime_error' THEN 'ValueError: x' ELSE 'nothing' END AS o FROM per_problem)"""


@R.add(
    "f18_classify",
    _RUNS
    + " SELECT record_id, "
    + ", ".join(
        f"CASE WHEN st = 'Success' AND rc = 0 THEN 'success' WHEN rs = 'TimeLimitExceeded' THEN 'timeout' {a} {b} WHEN contains(o, 'Error') THEN 'runtime_error' ELSE 'wrong_answer' END AS {n}"
        for n, a, b in (("humaneval", "WHEN contains(o, 'SyntaxError') THEN 'syntax_error'", "WHEN contains(o, 'AssertionError') THEN 'wrong_answer'"), ("mbpp", "WHEN contains(o, 'AssertionError') THEN 'wrong_answer'", "WHEN contains(o, 'SyntaxError') THEN 'syntax_error'"))
    )
    + " FROM r",
)
def f18_classify(spark, sf):
    e, ok = F.col("error_type"), F.coalesce(F.col("accepted"), F.lit(False))
    out = F.when(e == "syntax_error", "SyntaxError after AssertionError").when(e == "wrong_answer", "AssertionError").when(e == "runtime_error", "ValueError: x").otherwise("nothing")
    rows = table(spark, sf, "per_problem").select("record_id", F.when(ok, "Success").otherwise("Failed").alias("st"), F.when(e == "timeout", "TimeLimitExceeded").otherwise("Finished").alias("rs"), F.when(ok, 0).otherwise(1).alias("rc"), out.alias("o"))
    kind = lambda first: T.classify_run(F.col("st"), F.col("rs"), F.col("rc"), F.col("o"), first)
    return rows.select("record_id", kind(False).alias("humaneval"), kind(True).alias("mbpp"))


_GSM = "WITH g AS (SELECT event_id AS idx, 'First ' || CAST(user_id AS VARCHAR) || ' apples. #### ' || CASE WHEN event_id % 3 = 0 THEN '1,' ELSE '' END || CAST(event_id % 1000 AS VARCHAR) || CASE WHEN event_id % 5 = 0 THEN ' so .' ELSE '' END || CASE WHEN event_id % 7 = 0 THEN ' Then #### ' || CAST(user_id AS VARCHAR) ELSE '' END AS s, CAST(event_id % 1000 AS VARCHAR) AS truth FROM events)"


def _gsm(spark, sf):
    e, u = F.col("event_id"), F.col("user_id").cast("string")
    when = lambda n, t: F.when(e % n == 0, t).otherwise(F.lit(""))
    s = F.concat(F.lit("First "), u, F.lit(" apples. #### "), when(3, F.lit("1,")), (e % 1000).cast("string"), when(5, F.lit(" so .")), when(7, F.concat(F.lit(" Then #### "), u)))
    return table(spark, sf, "events").select(e.alias("idx"), s.alias("s"), (e % 1000).cast("string").alias("truth"))


@R.add(
    "f5_gsm",
    _GSM
    + r""", a AS (SELECT idx, truth, replace(list_extract(regexp_extract_all(right(s, 300), '#### (\-?[0-9\.\,]+)', 1), -1), ',', '') AS strict, list_filter(regexp_extract_all(right(s, 300), '(\-?[0-9\.\,]+)', 1), lambda x: x NOT IN ('', '.'))[-1] AS flexible FROM g)
SELECT idx, strict, flexible, CASE WHEN strict IS NULL THEN 0.0::DOUBLE WHEN strict = truth THEN 1.0::DOUBLE ELSE 0.1::DOUBLE END AS score FROM a""",
)
def f5_gsm(spark, sf):
    return _gsm(spark, sf).select("idx", G.gsm_answer("s").alias("strict"), G.gsm_answer("s", "flexible").alias("flexible"), G.gsm_score("s", "truth", format_score=0.1).alias("score"))


@R.add(
    "f11_qa",
    r"""WITH g AS (SELECT event_id AS idx, '<answer>first</answer> x <answer> The ' || event_type || CASE WHEN event_id % 3 = 0 THEN '!' ELSE ' of it' END || ' </answer>' || CASE WHEN event_id % 11 = 0 THEN repeat('<answer>', 10) ELSE '' END AS s, [event_type, 'purchase of it'] AS golden FROM events),
a AS (SELECT idx, s, golden, trim(regexp_extract_all(s, '(?s)<answer>(.*?)</answer>', 1)[-1]) AS raw FROM g),
n AS (SELECT *, trim(regexp_replace(regexp_replace(translate(lower(raw), '!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~', ''), '\b(a|an|the)\b', ' ', 'g'), '\s+', ' ', 'g')) AS norm FROM a)
SELECT idx, norm, CASE WHEN list_contains(golden, norm) THEN CASE WHEN len(regexp_extract_all(s, '<answer>')) > 10 THEN 0.25::DOUBLE ELSE 1.0::DOUBLE END ELSE 0.0::DOUBLE END AS exact, CASE WHEN len(list_filter(golden, lambda g: contains(norm, g))) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS part FROM n""",
)
def f11_qa(spark, sf):
    e = F.col("event_id")
    s = F.concat(F.lit("<answer>first</answer> x <answer> The "), "event_type", F.when(e % 3 == 0, "!").otherwise(" of it"), F.lit(" </answer>"), F.when(e % 11 == 0, F.lit("<answer>" * 10)).otherwise(""))
    rows = table(spark, sf, "events").select(e.alias("idx"), s.alias("s"), F.array("event_type", F.lit("purchase of it")).alias("golden"))
    return rows.select("idx", G.normal_answer(G.qa_answer("s")).alias("norm"), G.qa_score("s", "golden").alias("exact"), G.qa_score("s", "golden", substring=True).alias("part"))


@R.add(
    "f7_minerva",
    r"""WITH g AS (SELECT event_id AS idx, 'Work. Answer: x = ' || CASE event_id % 4 WHEN 0 THEN '1,000 dollars' WHEN 1 THEN '$\frac12$' WHEN 2 THEN '\sqrt3 units' ELSE CAST(event_id % 50 AS VARCHAR) END AS s, CASE event_id % 4 WHEN 0 THEN '1000' WHEN 1 THEN '\frac{1}{2}' WHEN 2 THEN '\sqrt{3}' ELSE '7' END AS truth FROM events)
SELECT idx, CASE idx % 4 WHEN 0 THEN '1000' WHEN 1 THEN '\frac{1}{2}' WHEN 2 THEN '\sqrt{3}' ELSE CAST(idx % 50 AS VARCHAR) END AS pred, CASE WHEN idx % 4 < 3 OR idx % 50 = 7 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS score FROM g""",
)
def f7_minerva(spark, sf):
    e = F.col("event_id")
    told = F.when(e % 4 == 0, "1,000 dollars").when(e % 4 == 1, "$\\frac12$").when(e % 4 == 2, "\\sqrt3 units").otherwise((e % 50).cast("string"))
    truth = F.when(e % 4 == 0, "1000").when(e % 4 == 1, "\\frac{1}{2}").when(e % 4 == 2, "\\sqrt{3}").otherwise("7")
    rows = table(spark, sf, "events").select(e.alias("idx"), F.concat(F.lit("Work. Answer: x = "), told).alias("s"), truth.alias("t"))
    return rows.select("idx", G.minerva_prediction("s").alias("pred"), G.minerva_score("s", F.col("t"))["score"].alias("score"))


def _boxed(spark, sf):
    """Real responses with an answer in one of several notations behind them, and truths that some of them meet."""
    e = F.col("record_id")
    told = F.when(e % 4 == 0, "\\boxed{\\frac{1}{2}}").when(e % 4 == 1, "\\boxed{x=\\dfrac12}").when(e % 4 == 2, F.concat(F.lit("\\boxed{"), (e % 5).cast("string"), F.lit("\\%}"))).otherwise("no box, is 0.5")
    truth = F.when(e % 3 == 0, "0.5").when(e % 3 == 1, "\\frac{1}{2}").otherwise(F.lit("3"))
    text = F.concat(F.lit("<think>"), F.coalesce("response", F.lit("")), F.lit("</think> so "), told)
    return table(spark, sf, "per_problem").select(e.alias("idx"), text.alias("s"), told.alias("told"), truth.alias("t"))


_NOTATION = r"regexp_replace(regexp_replace(replace(replace({x}, 'dfrac', 'frac'), '\%', ''), '^[^=]{0,2}=([^=]*)$', '\1'), '\\frac([^{])([^{])', '\\frac{\1}{\2}')"
_FORM = "CASE WHEN {n} IN ('0.5', '1/2') THEN '\\frac{{1}}{{2}}' ELSE {n} END"


def _form(x: str) -> str:
    return _FORM.format(n=_NOTATION.replace("{x}", x))


_BOXED = r"""WITH b AS (SELECT record_id AS idx, response, CASE record_id % 4 WHEN 0 THEN '\boxed{\frac{1}{2}}' WHEN 1 THEN '\boxed{x=\dfrac12}' WHEN 2 THEN '\boxed{' || CAST(record_id % 5 AS VARCHAR) || '\%}' ELSE 'no box, is 0.5' END AS told, CASE record_id % 3 WHEN 0 THEN '0.5' WHEN 1 THEN '\frac{1}{2}' ELSE '3' END AS t FROM per_problem),
g AS (SELECT idx, t, told, '<think>' || coalesce(response, '') || '</think> so ' || told AS s FROM b), p AS (SELECT *, regexp_extract_all(s, '\\boxed\{((?:[^{}]|\{[^{}]*\})*)\}', 1)[-1] AS pred FROM g),
m AS (SELECT *, CASE WHEN pred IS NOT NULL AND """ + _form("pred") + " = " + _form("t") + " THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS math FROM p)"


@R.add("f6_math", _BOXED + " SELECT idx, math AS score FROM m")
def f6_math(spark, sf):
    return _boxed(spark, sf).select("idx", G.math_score("s", "t").alias("score"))


@R.add("f7_strict_box", _BOXED + " SELECT idx, CASE WHEN pred = t THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS score, pred FROM m")
def f7_strict_box(spark, sf):
    return _boxed(spark, sf).select("idx", G.strict_box_score("s", "t").alias("r")).select("idx", "r.score", "r.pred")


_NUMBER = r"CASE WHEN {x} ~ '^.frac.*' THEN CAST(regexp_extract({x}, '\{{(\d+)\}}\{{', 1) AS DOUBLE) / CAST(regexp_extract({x}, '\}}\{{(\d+)\}}', 1) AS DOUBLE) ELSE CAST({x} AS DOUBLE) END"


@R.add(
    "f8_values",
    _BOXED
    + ", a AS (SELECT idx, "
    + _form("coalesce(regexp_extract_all(told, '\\\\boxed\\{((?:[^{}]|\\{[^{}]*\\})*)\\}', 1)[-1], regexp_extract(told, ' is (.*)$', 1))")
    + " AS x, "
    + _form("t")
    + " AS y FROM g), v AS (SELECT idx, "
    + _NUMBER.format(x="x")
    + " AS x, "
    + _NUMBER.format(x="y")
    + " AS y FROM a) SELECT idx, CASE WHEN abs(x - y) <= 1e-4 * greatest(x, y) OR abs(x - y / 100) <= 1e-4 * greatest(x, y / 100) OR abs(x - y * 100) <= 1e-4 * greatest(x, y * 100) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM v",
)
def f8_values(spark, sf):
    """The marked answer compared by value: its number, or a hundred times more or less."""
    return _boxed(spark, sf).select("idx", G.value_score("told", "t")["score"].alias("score"))


@R.add("f10_geometry", _BOXED + " SELECT idx, round(0.9 * math + 0.1 * CASE WHEN pred IS NOT NULL THEN 1 ELSE 0 END, 6) + 0.0 AS score FROM m")
def f10_geometry(spark, sf):
    return rounded(_boxed(spark, sf).select("idx", G.geometry_score("s", "t").alias("score")))


_RESPONSES = r"a AS (SELECT record_id, replace(replace(regexp_extract_all(right(response, 300), '#### (\-?[0-9\.\,]+)', 1)[-1], ',', ''), '$', '') AS strict, regexp_extract_all(right(response, 300), '(\-?[0-9\.\,]+)', 1) AS found FROM per_problem)"


@R.add("f5_responses", "WITH " + _RESPONSES + " SELECT record_id, strict, coalesce(list_filter(found, lambda x: x NOT IN ('', '.'))[-1], found[1]) AS flexible FROM a")
def f5_responses(spark, sf):
    """Answers of word problems taken from real responses."""
    return table(spark, sf, "per_problem").select("record_id", G.gsm_answer("response").alias("strict"), G.gsm_answer("response", "flexible").alias("flexible"))


@R.add(
    "f11_responses",
    r"""WITH a AS (SELECT record_id, trim(regexp_replace(regexp_replace(translate(lower(title), '!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~', ''), '\b(a|an|the)\b', ' ', 'g'), '\s+', ' ', 'g')) AS golden, r FROM (SELECT record_id, run_id AS title, '<answer>' || run_id || '</answer> <answer> The ' || coalesce(run_id, '') || CASE WHEN accepted THEN '.' ELSE ' of ' || dataset END || ' </answer>' AS r FROM per_problem)),
n AS (SELECT record_id, golden, trim(regexp_replace(regexp_replace(translate(lower(regexp_extract_all(r, '(?s)<answer>(.*?)</answer>', 1)[-1]), '!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~', ''), '\b(a|an|the)\b', ' ', 'g'), '\s+', ' ', 'g')) AS norm FROM a)
SELECT record_id, norm, CASE WHEN norm = golden THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS exact, CASE WHEN contains(norm, golden) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS part FROM n""",
)
def f11_responses(spark, sf):
    """Question answers built from the evaluation records' own fields, right and wrong ones."""
    r = F.concat(F.lit("<answer>"), "run_id", F.lit("</answer> <answer> The "), F.coalesce("run_id", F.lit("")), F.when(F.col("accepted"), ".").otherwise(F.concat(F.lit(" of "), "dataset")), F.lit(" </answer>"))
    rows = table(spark, sf, "per_problem").select("record_id", r.alias("r"), F.array("run_id").alias("golden"))
    return rows.select("record_id", G.normal_answer(G.qa_answer("r")).alias("norm"), G.qa_score("r", "golden").alias("exact"), G.qa_score("r", "golden", substring=True).alias("part"))


@R.add(
    "f9_math_equal",
    """WITH e AS (SELECT event_id AS idx, event_id % 40 + 1 AS a, user_id % 9 + 1 AS b FROM events)
SELECT idx, CASE idx % 4 WHEN 0 THEN a % b = 0 AND (a / b = 2 OR a / b = 200) WHEN 1 THEN abs(a - b) <= 1e-4 * greatest(a, b) OR abs(a * 100 - b) <= 1e-4 * greatest(a * 100, b) OR abs(a - b * 100) <= 1e-4 * greatest(a, b * 100)
  WHEN 2 THEN a = b ELSE a = b END AS same FROM e""",
)
def f9_math_equal(spark, sf):
    """Equality of fractions and whole numbers, decimals, pairs and matrices that events spell."""
    e = table(spark, sf, "events").select(F.col("event_id").alias("idx"), (F.col("event_id") % 40 + 1).alias("a"), (F.col("user_id") % 9 + 1).alias("b"))
    a, b, k = F.col("a").cast("string"), F.col("b").cast("string"), F.col("idx") % 4
    x = F.when(k == 0, F.concat(a, F.lit("/"), b)).when(k == 1, F.concat(a, F.lit(".0"))).when(k == 2, F.concat(F.lit("("), a, F.lit(", 1/2)"))).otherwise(F.concat(F.lit("\\begin{pmatrix}"), a, F.lit(" & 1\\end{pmatrix}")))
    y = F.when(k == 0, "2").when(k == 1, b).when(k == 2, F.concat(F.lit("("), b, F.lit(", 0.5)"))).otherwise(F.concat(F.lit("\\begin{pmatrix}"), b, F.lit("&1.0\\end{pmatrix}")))
    return e.select("idx", G.values_equal(x, y, percent=True).alias("same"))


@R.add("f12_batch_scores", _BOXED + " SELECT idx, math AS score FROM m")
def f12_batch_scores(spark, sf):
    """The batch manager with a scorer that sees whole Arrow batches."""
    from corpusmill.operators import rewards

    def scorer(batch):
        return [1.0 if G.literals_equal(x, y, percent=False) else 0.0 for x, y in zip(batch["response"], batch["ground_truth"])]

    rows = _boxed(spark, sf).select("idx", F.lit("math").alias("data_source"), G.textbook_safe(G.last_boxed("s")).alias("response"), G.textbook_safe("t").alias("ground_truth"))
    return rewards.batch(rows, scorer).select("idx", "score")


@R.add("f13_router", "SELECT event_id AS idx, CASE event_id % 3 WHEN 0 THEN CASE WHEN event_id % 9 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END WHEN 1 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS score FROM events")
def f13_router(spark, sf):
    e = F.col("event_id")
    source = F.when(e % 3 == 0, "openai/gsm8k").when(e % 3 == 1, "aime2024").otherwise("searchR1_nq")
    s = F.when(e % 3 == 0, F.concat(F.lit("#### "), (e % 9).cast("string"))).when(e % 3 == 1, "Answer: 5").otherwise("<answer>the click</answer>")
    truth = F.when(e % 3 == 0, "0").when(e % 3 == 1, "6").otherwise("view|click")
    rows = table(spark, sf, "events").select(e.alias("idx"), source.alias("source"), s.alias("s"), truth.alias("t"))
    return rows.select("idx", G.default_score("source", "s", "t").alias("score"))


@R.add(
    "f14_case_scores",
    """WITH c AS (SELECT dataset, problem_id, record_id, CASE coalesce(error_type, 'unknown') WHEN 'success' THEN 1 WHEN 'wrong_answer' THEN 0 WHEN 'runtime_error' THEN -2 WHEN 'timeout' THEN -3 WHEN 'syntax_error' THEN -4 ELSE -1 END AS code,
  row_number() OVER (PARTITION BY dataset, problem_id ORDER BY record_id) AS k, count(*) OVER (PARTITION BY dataset, problem_id) AS n FROM per_problem),
f AS (SELECT dataset, problem_id, min(k) FILTER (code = -4) AS bad FROM c GROUP BY dataset, problem_id)
SELECT c.dataset, c.problem_id, round(count(*) FILTER (code = 1 AND k <= 10 AND (bad IS NULL OR k < bad)) / least(max(n), 10), 6) + 0.0 AS continuous, CASE WHEN count(*) = count(*) FILTER (code = 1) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score
FROM c JOIN f ON f.dataset = c.dataset AND f.problem_id = c.problem_id GROUP BY c.dataset, c.problem_id""",
)
def f14_case_scores(spark, sf):
    t = F.coalesce("error_type", F.lit("unknown"))
    code = G.verdict_code(F.when(t == "success", "passed").otherwise(t))
    rows = table(spark, sf, "per_problem").filter("dataset IS NOT NULL AND problem_id IS NOT NULL").select("dataset", "problem_id", "record_id", code.alias("code"))
    per = rows.groupBy("dataset", "problem_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("record_id", "code"))), lambda x: x["code"]).alias("codes"))
    return rounded(per.select("dataset", "problem_id", G.case_score("codes", True).alias("continuous"), G.case_score("codes").alias("score")))


@R.add("f14_compare", r"SELECT record_id, regexp_replace(response, '\n+\z', '') = regexp_replace(response || chr(10), '\n+\z', '') AS newlines, length(regexp_replace(response, '\n+\z', '')) AS n FROM per_problem WHERE response IS NOT NULL")
def f14_compare(spark, sf):
    rows = table(spark, sf, "per_problem").filter("response IS NOT NULL")
    return rows.select("record_id", (T.strip_newlines("response") == T.strip_newlines(F.concat("response", F.lit("\n")))).alias("newlines"), F.length(T.strip_newlines("response")).cast("bigint").alias("n"))


@R.add("f20_hellaswag", r"SELECT doc_id, replace(regexp_replace(replace(trim(title), ' [title]', '. '), '\[.*?\]', '', 'g'), '  ', ' ') AS clean FROM documents WHERE title IS NOT NULL")
def f20_hellaswag(spark, sf):
    return table(spark, sf, "documents").filter("title IS NOT NULL").select("doc_id", T.clean_hellaswag("title").alias("clean"))


@R.add("f21_media", "SELECT item_id, 3 AS parts, true AS ok FROM heldout_items WHERE text <> ''")
def f21_media(spark, sf):
    rows = table(spark, sf, "heldout_items").filter("text <> ''").withColumn("t", F.concat(F.lit("<image>"), "text", F.lit("<video>")))
    return rows.select("item_id", F.size(T.media_parts("t")).alias("parts"), T.media_count_ok("t", F.lit(1), F.lit(1)).alias("ok"))


@R.add("f22_tool_calls", "SELECT item_id, 1 AS calls, 'search' AS name, 'before  after' AS rest FROM heldout_items")
def f22_tool_calls(spark, sf):
    t = F.concat(F.lit('before <tool_call>{"name": "search", "arguments": {"q": "'), F.col("item_id").cast("string"), F.lit('"}}</tool_call><tool_call>{broken</tool_call> after'))
    rows = table(spark, sf, "heldout_items").select("item_id", t.alias("t"))
    return rows.select("item_id", F.size(T.tool_calls("t")).alias("calls"), T.tool_calls("t")[0]["name"].alias("name"), T.without_tool_calls("t").alias("rest"))


@R.add("f22b_passages", "SELECT dataset, count(*) AS docs, CAST(sum(length(text)) AS BIGINT) AS n FROM heldout_items GROUP BY dataset")
def f22b_passages(spark, sf):
    rows = table(spark, sf, "heldout_items").groupBy("dataset").agg(F.sort_array(F.collect_list(F.concat(F.lit("T\n"), "text"))).alias("d"), F.sum(F.length("text")).alias("n"))
    text = T.passages_text("d")
    return rows.select("dataset", F.size(F.regexp_extract_all(text, F.lit(r"Doc [0-9]+ \(Title: T\)"), F.lit(0))).cast("bigint").alias("docs"), "n")


@R.add("f28_metric_maps", "SELECT record_id, 'eval/judge_time' AS key, CASE WHEN judge_time > 10 THEN NULL ELSE round(judge_time, 6) + 0.0 END AS value FROM per_problem")
def f28_metric_maps(spark, sf):
    v = F.when(F.col("judge_time") > 10, F.lit(float("inf"))).otherwise(F.col("judge_time"))
    m = T.prefixed(F.create_map(F.lit("judge_time"), T.without_infinite(v)), "eval/")
    return rounded(table(spark, sf, "per_problem").select("record_id", F.explode(m).alias("key", "value")))
