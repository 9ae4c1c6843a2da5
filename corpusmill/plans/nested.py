"""Queries over deeply nested records."""

from __future__ import annotations

from corpusmill.functions.runtime import table
from corpusmill.operators import flatten
from corpusmill.plans.registry import REGISTRY as R


def _tagged(spark, sf):
    """The tagged rows of both sources: one pass over each, written once, read back by tag."""
    samples = flatten.flatten_typed(table(spark, sf, "dataset_samples"), "sample_id", "dataset_samples")
    raw = flatten.flatten_json(table(spark, sf, "raw_records"), "raw_id", "payload", "raw_records", carry=("dataset", "fetched_at"))
    return flatten.stored(samples.unionByName(raw))


def _opened(e: str) -> str:
    """SQL of a JSON value, or of the list or object that its text spells."""
    return f"CASE WHEN json_type({e}) = 'VARCHAR' AND regexp_matches({e} ->> '$', '^\\s*[\\[{{]') AND json_valid({e} ->> '$') THEN ({e} ->> '$')::JSON ELSE {e} END"


_LISTS = f"""r AS (SELECT raw_id, payload::JSON AS j FROM raw_records WHERE CASE WHEN json_valid(payload) THEN json_type(payload) = 'OBJECT' END),
a AS (SELECT raw_id, {_opened("(j -> '$.test')")} AS t1, {_opened("(j -> '$.test_cases')")} AS tc, {_opened("(j -> '$.solutions')")} AS s FROM r),
b AS (SELECT raw_id, t1, {_opened("(tc -> '$.tests')")} AS t2, {_opened("(tc -> '$.test_list')")} AS al, {_opened("(tc -> '$.challenge_test_list')")} AS cl, CASE WHEN json_type({_opened("(s -> '$.solution')")}) = 'ARRAY' THEN {_opened("(s -> '$.solution')")} ELSE s END AS sl FROM a),
l AS (SELECT raw_id, 'test' AS kind, 'test' AS place, t1 AS l FROM b UNION ALL SELECT raw_id, 'test', 'test_cases.tests', t2 FROM b UNION ALL SELECT raw_id, 'assert', 'test_cases.test_list', al FROM b
  UNION ALL SELECT raw_id, 'challenge', 'test_cases.challenge_test_list', cl FROM b UNION ALL SELECT raw_id, 'solution', 'solutions', sl FROM b),
u AS (SELECT raw_id, kind, place, l, unnest(range(CAST(json_array_length(l) AS BIGINT))) AS pos FROM l WHERE json_type(l) = 'ARRAY'),
e AS (SELECT raw_id, kind, place, pos, json_extract(l, '$[' || pos || ']') AS e FROM u),
te AS (SELECT raw_id, place, pos, {_opened("e")} AS e FROM e WHERE kind = 'test'),
ti AS (SELECT raw_id, place, pos, {_opened("(e -> '$.input')")} AS i FROM te WHERE json_type(e) = 'OBJECT'),
tf AS (SELECT raw_id, place, pos, {_opened("(i -> '$.files')")} AS l FROM ti WHERE json_type(i) = 'OBJECT'),
fu AS (SELECT raw_id, place, pos AS parent_pos, l, unnest(range(CAST(json_array_length(l) AS BIGINT))) AS pos FROM tf WHERE json_type(l) = 'ARRAY'),
f AS (SELECT raw_id, place, parent_pos, pos, json_extract(l, '$[' || pos || ']') AS e FROM fu)"""


def _samples(kind: str, values: str, take: str) -> str:
    """SQL of the elements of a typed list: (sample_id, pos, x)."""
    return f"SELECT sample_id, pos, {take} FROM (SELECT sample_id, unnest(range(len({values}))) AS pos, unnest({values}) AS x FROM dataset_samples) WHERE x IS NOT NULL"


_FOUND = f"""WITH {_LISTS}
SELECT 'dataset_samples' AS rec_table, sample_id AS rec_id, kind AS child_kind, CAST(-1 AS BIGINT) AS parent_pos, pos FROM (
  SELECT 'test' AS kind, * FROM ({_samples("test", "test_cases.tests", "1 AS k")}) UNION ALL SELECT 'assert', * FROM ({_samples("assert", "test_cases.test_list", "1")})
  UNION ALL SELECT 'challenge', * FROM ({_samples("challenge", "test_cases.challenge_test_list", "1")}) UNION ALL SELECT 'solution', * FROM ({_samples("solution", "solutions", "1")}))
UNION ALL SELECT 'raw_records', raw_id, kind, -1, pos FROM e WHERE json_type(e) <> 'NULL'
UNION ALL SELECT 'raw_records', raw_id, 'file', parent_pos, pos FROM f WHERE json_type(e) <> 'NULL'"""


@R.add("p5_found", _FOUND)
def p5_found(spark, sf):
    """Every nested element with its kind and place."""
    return flatten.children(_tagged(spark, sf))


_STATEMENT = "coalesce(CASE WHEN json_type(j -> '$.content') = 'VARCHAR' THEN j ->> '$.content' END, CASE WHEN json_type(j -> '$.description') = 'VARCHAR' THEN j ->> '$.description' END, CASE WHEN json_type(j -> '$.problem_statement') = 'VARCHAR' THEN j ->> '$.problem_statement' END)"


@R.add(
    "p5_records",
    f"""WITH {_LISTS} SELECT 'dataset_samples' AS rec_table, sample_id AS rec_id, 'dataset_samples:' || sample_id AS pk, dataset, problem_id, coalesce(prompt, description) AS statement FROM dataset_samples
UNION ALL SELECT 'raw_records', raw_records.raw_id, 'raw_records:' || raw_records.raw_id, dataset, coalesce(j ->> '$.problem_id', j ->> '$.id', j ->> '$.name'), {_STATEMENT} FROM raw_records LEFT JOIN r ON r.raw_id = raw_records.raw_id""",
)
def p5_records(spark, sf):
    """The flat table of records, those without a readable payload included."""
    return flatten.as_table(_tagged(spark, sf), "record").select("rec_table", "rec_id", "pk", "dataset", "problem_id", "statement")


_KEYS = "'dataset_samples' AS rec_table, sample_id AS rec_id, 'dataset_samples:' || sample_id || '/{where}[' || pos || ']' AS pk, 'dataset_samples:' || sample_id AS parent_pk, pos"


@R.add("p5_tests", f"""WITH {_LISTS}, s AS ({_samples("test", "test_cases.tests", 'x."input" AS i, x."output" AS o')})
SELECT {_KEYS.replace("{where}", "test_cases.tests")}, i AS "input", o AS "output" FROM s
UNION ALL SELECT 'raw_records', raw_id, 'raw_records:' || raw_id || '/' || place || '[' || pos || ']', 'raw_records:' || raw_id, pos,
  CASE WHEN json_type(i) = 'OBJECT' THEN i ->> '$.stdin' ELSE i ->> '$' END, CASE WHEN json_type(o) = 'OBJECT' THEN o ->> '$.stdout' ELSE o ->> '$' END
FROM (SELECT raw_id, place, pos, {_opened("(e -> '$.input')")} AS i, {_opened("(e -> '$.output')")} AS o FROM te WHERE json_type(e) <> 'NULL')""")  # fmt: skip
def p5_tests(spark, sf):
    """The flat table of tests, with keys and payload columns."""
    return flatten.as_table(_tagged(spark, sf), "test").drop("parent_pos")


@R.add("p5_files", f"""WITH {_LISTS} SELECT 'raw_records' AS rec_table, raw_id AS rec_id, 'raw_records:' || raw_id || '/' || place || '[' || parent_pos || ']/input.files[' || pos || ']' AS pk, 'raw_records:' || raw_id || '/' || place || '[' || parent_pos || ']' AS parent_pk, parent_pos, pos,
  CASE WHEN json_type(e) = 'OBJECT' THEN e ->> '$.name' END AS name, CASE WHEN json_type(e) = 'OBJECT' THEN e ->> '$.content' ELSE e ->> '$' END AS content FROM (SELECT raw_id, place, parent_pos, pos, {_opened("e")} AS e FROM f) WHERE json_type(e) <> 'NULL'""")  # fmt: skip
def p5_files(spark, sf):
    """The flat table of test files; each names its test as parent."""
    return flatten.as_table(_tagged(spark, sf), "file")


def _texts(kind: str, where: str) -> str:
    return f"""WITH {_LISTS}, s AS ({_samples(kind, where, "x")}) SELECT {_KEYS.replace("{where}", where)}, x AS text FROM s
UNION ALL SELECT 'raw_records', raw_id, 'raw_records:' || raw_id || '/' || place || '[' || pos || ']', 'raw_records:' || raw_id, pos, e ->> '$' FROM e WHERE kind = '{kind}' AND json_type(e) <> 'NULL'"""


@R.add("p5_assertions", _texts("assert", "test_cases.test_list"))
def p5_assertions(spark, sf):
    """The flat table of assertions."""
    return flatten.as_table(_tagged(spark, sf), "assert").drop("parent_pos")


@R.add("p5_challenges", _texts("challenge", "test_cases.challenge_test_list"))
def p5_challenges(spark, sf):
    """The flat table of challenge assertions."""
    return flatten.as_table(_tagged(spark, sf), "challenge").drop("parent_pos")


@R.add(
    "p5_solutions",
    f"""WITH {_LISTS}, s AS ({_samples("solution", "solutions", "x")}),
k AS (SELECT b.raw_id, CASE WHEN json_type({_opened("(s -> '$.solution')")}) = 'ARRAY' THEN 'solutions.solution' ELSE 'solutions' END AS place, CASE WHEN json_type({_opened("(s -> '$.solution')")}) = 'ARRAY' THEN {_opened("(s -> '$.language')")} END AS lang FROM a JOIN b ON b.raw_id = a.raw_id)
SELECT {_KEYS.replace("{where}", "solutions")}, x AS text, CAST(NULL AS VARCHAR) AS language FROM s
UNION ALL SELECT 'raw_records', e.raw_id, 'raw_records:' || e.raw_id || '/' || k.place || '[' || pos || ']', 'raw_records:' || e.raw_id, pos, e ->> '$', json_extract(lang, '$[' || pos || ']') ->> '$' FROM e JOIN k ON k.raw_id = e.raw_id WHERE kind = 'solution' AND json_type(e) <> 'NULL'""",
)
def p5_solutions(spark, sf):
    """The flat table of solutions, with the language that a parallel list gives."""
    return flatten.as_table(_tagged(spark, sf), "solution").drop("parent_pos")
