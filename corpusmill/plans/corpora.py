"""Queries of corpus preparation: normalisation, manifests, duplicates, overlaps, recipes."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import sequences as S
from corpusmill.functions import text as T
from corpusmill.functions.runtime import table
from corpusmill.operators import governance as G
from corpusmill.operators import recipes as P
from corpusmill.plans.registry import REGISTRY as R
from corpusmill.plans.views import MANIFEST, canon_sql, split_rows
from corpusmill.sources import io as IO

_PRIORITY = ["humaneval:train", "humaneval:valid", "humaneval:test", "mbpp_reg:test", "codecontests_test:test", "codecontests_valid:valid", "codecontests_train:train"]
_HASHED = f"WITH {MANIFEST}, h AS (SELECT idx, key, dataset, problem_id, split, sha256({canon_sql('prompt')}) AS sha256, length(coalesce(prompt, '')) AS prompt_length, length({canon_sql('prompt')}) AS canonical_length FROM rows_)"
_UNIQUE = ", u AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY key, sha256 ORDER BY idx) = 1)"
_RANK = "CASE {k} " + " ".join(f"WHEN '{k}' THEN {i + 1}" for i, k in enumerate(_PRIORITY)) + " ELSE 1000 END"


def _hashed(spark, sf):
    return G.manifest(split_rows(spark, sf), keep=["key", "problem_id", "idx", "dataset", "split"])


@R.add("f1_canonical", f"SELECT sample_id, {canon_sql('prompt')} AS canonical, sha256({canon_sql('prompt')}) AS sha256 FROM dataset_samples")
def f1_canonical(spark, sf):
    return table(spark, sf, "dataset_samples").select("sample_id", T.canonical_prompt("prompt").alias("canonical"), T.prompt_hash("prompt").alias("sha256"))


@R.add("f1_canonical_documents", f"SELECT doc_id, sha256({canon_sql('text')}) AS sha256, length({canon_sql('text')}) AS n FROM documents")
def f1_canonical_documents(spark, sf):
    c = T.canonical_prompt("text")
    return table(spark, sf, "documents").select("doc_id", F.sha2(c, 256).alias("sha256"), F.length(c).cast("bigint").alias("n"))


@R.add("f2_lines_hash", "SELECT dataset, sha256(string_agg(problem_id, chr(10) ORDER BY problem_id)) AS sha256, count(problem_id) AS n FROM dataset_samples GROUP BY dataset")
def f2_lines_hash(spark, sf):
    return T.lines_hash(table(spark, sf, "dataset_samples").select("dataset", "problem_id"), "problem_id", ["dataset"])


@R.add("f3_manifest", _HASHED + " SELECT key, problem_id, idx, sha256, prompt_length, canonical_length, '20270101_000000' AS version FROM h")
def f3_manifest(spark, sf):
    return G.manifest(split_rows(spark, sf), version="20270101_000000")


@R.add("f4_one_line", r"SELECT record_id, trim(regexp_replace(coalesce(response, ''), '[\n\t\x{0B}\x{0C}\x{0D}\x{1C}-\x{1F}\x{85}\p{Z}]+', ' ', 'g')) AS line FROM per_problem")
def f4_one_line(spark, sf):
    return table(spark, sf, "per_problem").select("record_id", T.one_line("response").alias("line"))


@R.add("u13_duplicates", _HASHED + " SELECT idx, key, sha256, row_number() OVER (PARTITION BY key, sha256 ORDER BY idx) AS copy FROM h")
def u13_duplicates(spark, sf):
    return G.mark_duplicates(_hashed(spark, sf)).select("idx", "key", "sha256", F.col("copy").cast("bigint").alias("copy"))


@R.add("u13_first_of_each", _HASHED + _UNIQUE + " SELECT idx, key, sha256 FROM u")
def u13_first_of_each(spark, sf):
    return G.first_of_each(_hashed(spark, sf).select("idx", "key", "sha256"))


@R.add("j4_cross_overlaps", _HASHED + " SELECT DISTINCT a.key AS key_a, b.key AS key_b, a.sha256 FROM h a JOIN h b ON a.sha256 = b.sha256 AND a.key <> b.key AND split_part(a.dataset, '_', 1) = split_part(b.dataset, '_', 1)")
def j4_cross_overlaps(spark, sf):
    return G.cross_overlaps(_hashed(spark, sf), F.split(F.col("dataset"), "_")[0])


_EXTERNAL = f", e AS (SELECT dataset AS external_key, sha256({canon_sql('text')}) AS sha256 FROM heldout_items UNION ALL SELECT dataset, sha256({canon_sql('prompt')}) FROM dataset_samples WHERE dataset = 'humaneval')"


def _external(spark, sf):
    items = table(spark, sf, "heldout_items").select(F.col("dataset").alias("key"), T.prompt_hash("text").alias("sha256"))
    return items.unionByName(table(spark, sf, "dataset_samples").filter("dataset = 'humaneval'").select(F.col("dataset").alias("key"), T.prompt_hash("prompt").alias("sha256")))


@R.add("j5_leakage", _HASHED + _EXTERNAL + " SELECT DISTINCT h.key, e.external_key, h.sha256 FROM h JOIN e ON e.sha256 = h.sha256 WHERE h.split = 'train'")
def j5_leakage(spark, sf):
    return G.leakage(_hashed(spark, sf), F.col("split") == "train", _external(spark, sf))


@R.add(
    "j6_remove_overlaps",
    _HASHED
    + _UNIQUE
    + f""", o AS (SELECT DISTINCT a.key, a.sha256 FROM u a JOIN u b ON a.sha256 = b.sha256 AND a.key <> b.key AND {_RANK.replace('{k}', 'a.key')} > {_RANK.replace('{k}', 'b.key')})
SELECT idx, key, sha256 FROM u WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.key = u.key AND o.sha256 = u.sha256)""",
)
def j6_remove_overlaps(spark, sf):
    u = G.first_of_each(_hashed(spark, sf).select("idx", "key", "sha256"))
    over = G.cross_overlaps(u)
    return G.remove_overlaps(u, over, over.select(F.col("key_a").alias("key"), "sha256").filter(F.lit(False)), _PRIORITY)


@R.add(
    "a17_audit",
    _HASHED
    + _UNIQUE
    + _EXTERNAL
    + f""", o AS (SELECT DISTINCT a.key, a.sha256 FROM u a JOIN u b ON a.sha256 = b.sha256 AND a.key <> b.key AND {_RANK.replace('{k}', 'a.key')} > {_RANK.replace('{k}', 'b.key')}
  UNION SELECT key, sha256 FROM u WHERE split = 'train' AND sha256 IN (SELECT sha256 FROM e)),
k AS (SELECT * FROM u WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.key = u.key AND o.sha256 = u.sha256))
SELECT key, (SELECT count(*) FROM h x WHERE x.key = b.key) AS before, (SELECT count(*) FROM h x WHERE x.key = b.key) - (SELECT count(*) FROM u x WHERE x.key = b.key) AS intra_duplicates,
  (SELECT count(*) FROM u x WHERE x.key = b.key) - (SELECT count(*) FROM k x WHERE x.key = b.key) AS cross_removed, (SELECT count(*) FROM k x WHERE x.key = b.key) AS after FROM (SELECT DISTINCT key FROM h) b""",
)
def a17_audit(spark, sf):
    return G.audit(_hashed(spark, sf), _PRIORITY, _external(spark, sf), F.col("split") == "train")


@R.add("a16_check", _HASHED + " SELECT key, count(*) AS rows, count(DISTINCT sha256) AS distinct_hashes, count(DISTINCT problem_id) AS distinct_ids, count(*) FILTER (canonical_length = 0) AS empty_prompts, count(*) - count(DISTINCT sha256) AS surplus FROM h GROUP BY key")
def a16_check(spark, sf):
    return G.check_manifest(_hashed(spark, sf))


@R.add("a16_repeated", _HASHED + " SELECT key, problem_id AS value, count(*) AS n FROM h GROUP BY key, problem_id HAVING count(*) > 1")
def a16_repeated(spark, sf):
    return G.repeated(_hashed(spark, sf), "problem_id")


@R.add("j2_semi", "SELECT sample_id, problem_id FROM dataset_samples WHERE sample_id IN (SELECT sample_id FROM manifest)")
def j2_semi(spark, sf):
    return G.semi(table(spark, sf, "dataset_samples").select("sample_id", "problem_id"), table(spark, sf, "manifest"), "sample_id")


_PREFIX = "(SELECT DISTINCT problem_id AS p FROM manifest WHERE starts_with(problem_id, 'Tidecoder/') ORDER BY sha256('42|' || problem_id), problem_id LIMIT 25)"


@R.add("t4_prefix_sample", f"SELECT p AS problem_id FROM {_PREFIX}")
def t4_prefix_sample(spark, sf):
    return G.prefix_sample(table(spark, sf, "manifest"), "Tidecoder/", 25, 42)


@R.add("j3_split_off", f"SELECT sample_id, problem_id, problem_id IN (SELECT p FROM {_PREFIX}) AS sampled FROM (SELECT DISTINCT sample_id, problem_id FROM manifest WHERE problem_id IS NOT NULL)")
def j3_split_off(spark, sf):
    rows = table(spark, sf, "manifest").select("sample_id", "problem_id").filter("problem_id IS NOT NULL").distinct()
    ids = G.prefix_sample(rows, "Tidecoder/", 25, 42)
    return G.semi(rows, ids).withColumn("sampled", F.lit(True)).unionByName(G.anti(rows, ids).withColumn("sampled", F.lit(False)))


_NAME = r"CASE WHEN regexp_matches({c}, '^\s*[0-9]+_[A-Za-z][0-9]*\.') THEN lower(regexp_extract({c}, '^\s*([0-9]+_[A-Za-z][0-9]*)\.', 1)) END"


@R.add("pf12_drop_named", f"WITH b AS (SELECT DISTINCT {_NAME.replace('{c}', 'problem_id')} AS k FROM dataset_samples WHERE dataset = 'codecontests_test') SELECT sample_id, problem_id FROM dataset_samples WHERE dataset = 'codecontests_train' AND ({_NAME.replace('{c}', 'problem_id')} IS NULL OR {_NAME.replace('{c}', 'problem_id')} NOT IN (SELECT k FROM b WHERE k IS NOT NULL))")
def pf12_drop_named(spark, sf):
    s = table(spark, sf, "dataset_samples").select("sample_id", "dataset", "problem_id")
    return G.drop_named(s.filter("dataset = 'codecontests_train'"), "problem_id", s.filter("dataset = 'codecontests_test'"), "problem_id").select("sample_id", "problem_id")


@R.add("pf10_id_range", "SELECT sample_id, problem_id FROM dataset_samples WHERE problem_id IS NOT NULL AND (try_cast(problem_id AS BIGINT) IS NULL OR try_cast(problem_id AS BIGINT) BETWEEN 20 AND 80)")
def pf10_id_range(spark, sf):
    return IO.id_range(table(spark, sf, "dataset_samples").filter("problem_id IS NOT NULL"), 20, 80).select("sample_id", "problem_id")


@R.add("pf8_length_filter", "SELECT sample_id FROM dataset_samples WHERE len(list_filter(string_split_regex(prompt, '\\s+'), lambda w: w <> '')) <= 120")
def pf8_length_filter(spark, sf):
    """Prompts of at most 120 white-space tokens; null prompts are dropped."""
    return P.within_length(table(spark, sf, "dataset_samples"), "prompt", 120).select("sample_id")


@R.add("io5_contest_problems", "SELECT problem_id, CASE WHEN trim(description) <> '' THEN description ELSE prompt END AS prompt, len(coalesce(solutions[1:3], [])) AS n FROM dataset_samples WHERE dataset LIKE 'codecontests%' AND coalesce(CASE WHEN trim(description) <> '' THEN description END, CASE WHEN trim(prompt) <> '' THEN prompt END) IS NOT NULL")
def io5_contest_problems(spark, sf):
    return IO.fetch(spark, "codecontests", f"{sf}/dataset_samples.parquet").select("problem_id", "prompt", F.size("solutions").cast("bigint").alias("n"))


@R.add("io6_fetch_all", "SELECT dataset, count(*) AS n FROM dataset_samples WHERE dataset IN ('humaneval', 'mbpp_reg') GROUP BY dataset")
def io6_fetch_all(spark, sf):
    path = f"{sf}/dataset_samples.parquet"
    return IO.fetch_all(spark, {"humaneval": path, "mbpp_reg": path}).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))


@R.add("io1_read_files", "SELECT item_id, dataset, problem_id, text FROM heldout_items UNION ALL SELECT item_id, dataset, problem_id, text FROM heldout_items")
def io1_read_files(spark, sf):
    path = f"{sf}/heldout_items.parquet"
    return IO.read_files(spark, [path, path])


@R.add("io2_read_sft", "SELECT test_cases.type AS prompt, canonical_solution AS response FROM dataset_samples")
def io2_read_sft(spark, sf):
    return IO.read_sft(spark, [f"{sf}/dataset_samples.parquet"], ["test_cases", "type"], ["canonical_solution"])


def _written(spark, name):
    from corpusmill.functions.runtime import shared_folder

    return shared_folder(spark, name)


@R.add("io3_preferences", "SELECT prompt, canonical_solution AS chosen, solutions[1] AS rejected FROM dataset_samples")
def io3_preferences(spark, sf):
    """Preference rows written to parquet and read back through the scan."""
    path = _written(spark, "preferences") + ".parquet"
    rows = table(spark, sf, "dataset_samples")
    rows.select("sample_id", "prompt", F.col("canonical_solution").alias("chosen"), F.get("solutions", 0).alias("rejected")).write.parquet(path)
    return IO.read_preferences(spark, [path])


@R.add("io4_conversations", "SELECT len(['x', 'y']) AS turns, coalesce(prompt, '') AS first, coalesce(response, '') AS last, CAST(NULL AS VARCHAR) AS tools FROM per_problem")
def io4_conversations(spark, sf):
    """Multi-turn rows written as JSON lines and read back through the scan."""
    path = _written(spark, "conversations") + ".jsonl"
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), F.coalesce(c, F.lit("")).alias("content"))
    IO.write_json_lines(table(spark, sf, "per_problem").select("record_id", F.array(turn("user", F.col("prompt")), turn("assistant", F.col("response"))).alias("messages")), path)
    rows = IO.read_conversations(spark, [path], tools="tools")
    return rows.select(F.size("messages").cast("bigint").alias("turns"), F.col("messages")[0]["content"].alias("first"), F.col("messages")[1]["content"].alias("last"), "tools")


@R.add("io7_json_lines", "SELECT record_id, run_id, prompt, accepted, pass_ratio FROM per_problem")
def io7_json_lines(spark, sf):
    """Records through the JSON lines writer and reader."""
    path = _written(spark, "lines")
    columns = ["record_id", "run_id", "prompt", "accepted", "pass_ratio"]
    IO.write_json_lines(table(spark, sf, "per_problem").select(*columns), path)
    return IO.read_json_lines(spark, path, "record_id bigint, run_id string, prompt string, accepted boolean, pass_ratio double")


@R.add("io7b_run_output", "SELECT record_id, dataset, error_type, false AS sampled FROM per_problem")
def io7b_run_output(spark, sf):
    """A run's folder: one file of per-problem records a dataset, and a sampled log that is passed over."""
    folder = _written(spark, "run")
    rows = table(spark, sf, "per_problem").select("record_id", "dataset", "error_type")
    known = F.coalesce(F.col("dataset") == "mbpp_reg", F.lit(False))
    IO.write_json_lines(rows.filter(known), f"{folder}/per_problem_mbpp_reg.jsonl")
    IO.write_json_lines(rows.filter(~known), f"{folder}/per_problem_other.jsonl")
    IO.write_json_lines(rows.filter("record_id % 50 = 0"), f"{folder}/qa_logs/some.jsonl")
    return IO.load_run(spark, folder).select("record_id", "dataset", "error_type", "sampled")


@R.add("io7c_manifest", "SELECT problem_id, count(*) AS n FROM manifest WHERE trim(problem_id) <> '' GROUP BY problem_id")
def io7c_manifest(spark, sf):
    """A manifest of unique, non-empty ids, written and read through the check."""
    path = _written(spark, "manifest")
    IO.write_json_lines(table(spark, sf, "manifest").filter("trim(problem_id) <> ''").groupBy("problem_id").agg(F.count(F.lit(1)).alias("n")), path)
    return IO.read_manifest(spark, path).select("problem_id", "n")


@R.add("io9_split_sinks", "SELECT sample_id, CAST(dataset AS VARCHAR) AS dataset FROM dataset_samples WHERE dataset = 'humaneval'")
def io9_split_sinks(spark, sf):
    """Parquet sinks, one directory a split, of which one is read."""
    path = _written(spark, "splits")
    IO.write_splits(table(spark, sf, "dataset_samples").select("sample_id", "dataset"), path, "dataset")
    return spark.read.parquet(path).filter("dataset = 'humaneval'")


@R.add("io10_saved_batch", "SELECT event_id AS idx, value FROM events")
def io10_saved_batch(spark, sf):
    """A batch saved, then served from the rollout cache without being made again."""
    path = _written(spark, "batch")
    IO.save_batch(table(spark, sf, "events").select(F.col("event_id").alias("idx"), "value"), path)
    return IO.cached_rollout(spark, path, lambda: None)


@R.add("io15_resumed_loader", "SELECT event_id, event_id AS place FROM events WHERE event_id >= 123")
def io15_resumed_loader(spark, sf):
    """What a loader has still to give out after its state was stored at a step."""
    from corpusmill.operators.sampling import ordered

    folder = _written(spark, "loader")
    IO.save_loader(spark, folder, 7, {"epoch": 0, "position": 123, "seed": 0})
    return IO.remaining(ordered(table(spark, sf, "events").select("event_id"), "sequential", key="event_id"), IO.load_loader(spark, folder))


@R.add("io16_viewer", "SELECT record_id % 3 AS file_step, prompt AS input, pass_ratio AS score FROM per_problem WHERE contains(prompt, 'the') OR contains(response, 'the')")
def io16_viewer(spark, sf):
    """Dumped generations of three steps, searched for a word."""
    folder = _written(spark, "generations")
    rows = table(spark, sf, "per_problem").select("record_id", F.col("prompt").alias("input"), F.col("response").alias("output"), F.col("pass_ratio").alias("score"))
    for step in range(3):
        IO.dump_generations(rows.filter(F.col("record_id") % 3 == step), folder, step)
    return IO.view_generations(spark, folder, "the", ["input", "score"])


@R.add("f25c_template_prefixes", "SELECT doc_id, [doc_id % 7, 1] AS system, [2, doc_id % 3] AS generation FROM documents")
def f25c_template_prefixes(spark, sf):
    """System and generation prompts found from what a template makes of empty messages."""
    from corpusmill.functions import sequences

    d = F.col("doc_id")
    head, message, prompt = F.array(d % 7, F.lit(1).cast("bigint")), F.array(F.lit(5).cast("bigint"), d % 11, F.lit(6).cast("bigint")), F.array(F.lit(2).cast("bigint"), d % 3)
    found = sequences.template_prefixes(F.concat(head, message), F.concat(head, message, message), F.concat(head, message, prompt))
    return table(spark, sf, "documents").select("doc_id", found["system"].alias("system"), found["generation"].alias("generation"))


@R.add("t13_ratio_splits", "WITH u AS (SELECT problem_id, CAST('0x' || substr(sha256('7|' || problem_id), 1, 13) AS BIGINT) / 4503599627370496.0 AS u FROM (SELECT DISTINCT problem_id FROM manifest WHERE problem_id IS NOT NULL)) SELECT problem_id, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'valid' ELSE 'test' END AS split FROM u")
def t13_ratio_splits(spark, sf):
    ids = table(spark, sf, "manifest").select("problem_id").filter("problem_id IS NOT NULL").distinct()
    return G.splits_by_ratio(ids, {"train": 0.8, "valid": 0.1, "test": 0.1}, 7, "problem_id")


# ---------------------------------------------------------------- recipes and layouts

_ROW = "{{'data_source': {source}, 'prompt': [{{'role': 'user', 'content': {prompt}}}], 'ability': '{ability}', 'reward_model': {{'style': 'rule', 'ground_truth': {truth}}}, 'extra_info': {{'split': 'train', 'index': sample_id}}}}"


@R.add("r1_rl_rows", "SELECT sample_id AS idx, dataset AS data_source, 'user' AS role, prompt || ' Answer in Python.' AS content, canonical_solution AS ground_truth, 'train' AS split FROM dataset_samples WHERE dataset = 'mbpp_reg'")
def r1_rl_rows(spark, sf):
    rows = table(spark, sf, "dataset_samples").filter("dataset = 'mbpp_reg'")
    rl = P.rl_rows(rows, F.col("dataset"), F.concat("prompt", F.lit(" Answer in Python.")), F.col("canonical_solution"), "code", "train", F.col("sample_id"))
    return rl.select(F.col("extra_info.index").alias("idx"), "data_source", F.col("prompt")[0]["role"].alias("role"), F.col("prompt")[0]["content"].alias("content"), F.col("reward_model.ground_truth").alias("ground_truth"), F.col("extra_info.split").alias("split"))


@R.add("r2_preference_sft", "SELECT record_id, r AS kind, CASE r WHEN 'chosen' THEN coalesce(prompt, '') || coalesce(response, '') ELSE coalesce(prompt, '') || 'I do not know.' END AS text FROM per_problem, (VALUES ('chosen'), ('rejected')) AS v(r)")
def r2_preference_sft(spark, sf):
    t = table(spark, sf, "per_problem")
    pairs = t.select("record_id", F.concat(F.coalesce("prompt", F.lit("")), F.coalesce("response", F.lit(""))).alias("chosen"), F.concat(F.coalesce("prompt", F.lit("")), F.lit("I do not know.")).alias("rejected"))
    return P.preference_sft(pairs, "record_id")


@R.add("r3_math_rows", "SELECT sample_id AS idx, 'math' AS data_source, prompt || ' Let''s think step by step and output the final answer within \\boxed{}.' AS content FROM dataset_samples WHERE prompt IS NOT NULL")
def r3_math_rows(spark, sf):
    rows = table(spark, sf, "dataset_samples").filter("prompt IS NOT NULL")
    out = P.recipe("math", rows.select(F.col("sample_id").alias("idx"), F.col("prompt").alias("question"), F.col("canonical_solution").alias("answer")), "train")
    return out.select(F.col("extra_info.index").alias("idx"), "data_source", F.element_at("prompt", -1)["content"].alias("content"))


@R.add("r4_gsm_tool_rows", "SELECT item_id AS idx, 'openai/gsm8k' AS data_source, 2 AS turns, CAST(item_id AS VARCHAR) AS ground_truth, true AS tools FROM heldout_items")
def r4_gsm_tool_rows(spark, sf):
    rows = table(spark, sf, "heldout_items").select(F.col("item_id").alias("idx"), F.col("text").alias("question"), F.concat(F.lit("work #### "), F.col("item_id").cast("string")).alias("answer"))
    out = P.recipe("gsm8k_tool", rows, "train")
    return out.select(F.col("extra_info.index").alias("idx"), "data_source", F.size("prompt").alias("turns"), F.col("reward_model.ground_truth").alias("ground_truth"), F.col("extra_info.need_tools_kwargs").alias("tools"))


@R.add("r5_offline_batches", "SELECT CAST(floor((row_number() OVER (ORDER BY item_id) - 1) / 32) AS BIGINT) AS batch, count(*) OVER (PARTITION BY 1) AS total, item_id FROM heldout_items")
def r5_offline_batches(spark, sf):
    return P.generation_batches(table(spark, sf, "heldout_items").select("item_id"), 32, "item_id").select("batch", "total", "item_id")


@R.add("f19_templates", "SELECT sample_id, CASE dataset WHEN 'humaneval' THEN 'Complete:' || chr(10) || prompt || chr(10) WHEN 'mbpp_reg' THEN 'Write: ' || prompt ELSE 'Solve' || chr(10) || prompt END AS text FROM dataset_samples")
def f19_templates(spark, sf):
    t = T.prompt_template(F.col("dataset"), F.col("prompt"), {"humaneval": "Complete:\n{prompt}\n", "mbpp_reg": "Write: {prompt}"}, "Solve\n{prompt}")
    return table(spark, sf, "dataset_samples").select("sample_id", t.alias("text"))


@R.add("f17_entry_points", r"WITH a AS (SELECT sample_id, array_to_string(test_cases.test_list, chr(10)) AS t, list_filter(test_cases.test_list, lambda x: regexp_matches(x, '^\s*assert\b.*=='))[1] AS first FROM dataset_samples WHERE test_cases.test_list IS NOT NULL) SELECT sample_id, nullif(regexp_extract(t, 'assert\s+(?:\(\s*)*(?:not\s+)?([A-Za-z_]\w*)\s*\(', 1), '') AS entry, nullif(trim(regexp_extract(first, '(?s)^\s*assert\s+(.*?)\s*==', 1)), '') AS call FROM a")
def f17_entry_points(spark, sf):
    rows = table(spark, sf, "dataset_samples").filter("test_cases.test_list IS NOT NULL")
    return rows.select("sample_id", T.entry_point(F.col("test_cases.test_list")).alias("entry"), T.example_call(F.col("test_cases.test_list")).alias("call"))


_MASKS = "p AS (SELECT vec_id AS seq, 4 + vec_id % 9 AS np, 10 + vec_id % 30 AS nr FROM embeddings), k AS (SELECT seq, np, nr, i, CASE WHEN i < np + nr THEN 1 ELSE 0 END AS m FROM p, range(40) AS r(i))"


@R.add("f25_sft_masks", f"WITH {_MASKS} SELECT seq, i AS t, m AS attention_mask, CASE WHEN (np > 1 AND i < np - 1) OR i = least(np + nr, 40) - 1 THEN 0 ELSE m END AS loss_mask, CAST(least(i, least(np + nr, 40) - 1) AS INT) AS position_ids FROM k")
def f25_sft_masks(spark, sf):
    ids = lambda n: F.transform(F.sequence(F.lit(1), n.cast("int")), lambda x: x.cast("bigint"))
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("seq"), ids(4 + F.col("vec_id") % 9).alias("p"), ids(10 + F.col("vec_id") % 30).alias("r"))
    parts = S.sft_row("p", "r", 40, 0, "right")
    out = rows.select("seq", *[c.alias(k) for k, c in parts.items()])
    return out.select("seq", F.posexplode(F.arrays_zip("attention_mask", "loss_mask", "position_ids")).alias("t", "x")).select("seq", F.col("t").cast("bigint").alias("t"), "x.attention_mask", "x.loss_mask", "x.position_ids")


@R.add("f24_positions", "SELECT vec_id AS seq, i - 1 AS t, CAST(greatest(sum(CASE WHEN i > vec_id % 5 THEN 1 ELSE 0 END) OVER (PARTITION BY vec_id ORDER BY i) - 1, 0) AS INT) AS pos FROM embeddings, range(1, 65) AS r(i)")
def f24_positions(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("seq"), F.transform("embedding", lambda v, k: F.when(k + 1 > F.col("vec_id") % 5, 1).otherwise(0)).alias("m"))
    return rows.select("seq", F.posexplode(S.position_ids("m")).alias("t", "pos")).withColumn("t", F.col("t").cast("bigint"))


@R.add("f23_padding", "SELECT vec_id AS seq, list_concat(embedding[1:vec_id % 7 + 1], list_transform(range(CAST(10 - (vec_id % 7 + 1) AS BIGINT)), lambda x: CAST(0.5 AS FLOAT))) AS padded, list_concat(embedding[1:5], embedding[60:64]) AS middle, embedding[55:64] AS tail FROM embeddings")
def f23_padding(spark, sf):
    e = table(spark, sf, "embeddings")
    head = F.slice("embedding", 1, (F.col("vec_id") % 7 + 1).cast("int"))
    return e.select(F.col("vec_id").alias("seq"), S.pad(head, 10, F.lit(0.5).cast("float")).alias("padded"), S.truncate("embedding", 10, "middle").alias("middle"), S.truncate("embedding", 10, "left").alias("tail"))


@R.add("f23b_jagged", "SELECT vec_id AS seq, list_filter(embedding, lambda v: v > 0) AS kept FROM embeddings")
def f23b_jagged(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("m", F.transform("embedding", lambda v: F.when(v > 0, 1).otherwise(0)))
    return e.select(F.col("vec_id").alias("seq"), S.kept("embedding", "m").alias("kept"))


@R.add("f27_reward_at_end", "SELECT vec_id AS seq, list_transform(range(12), lambda i: CASE WHEN i = vec_id % 13 - 1 THEN CAST(label AS DOUBLE) ELSE 0.0::DOUBLE END) AS rewards FROM embeddings")
def f27_reward_at_end(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("seq"), S.reward_at_end((F.col("vec_id") % 13).cast("int"), 12, F.col("label")).alias("rewards"))


_TURNS = "turns AS (SELECT l_orderkey AS conv, l_linenumber * 1000 + row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS turn, (['system', 'user', 'assistant', 'tool'])[1 + l_partkey % 4] AS role, CAST(l_partkey AS VARCHAR) AS text, 1 + l_suppkey % 3 AS n FROM lineitem)"


def _turns(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    roles = F.array(*map(F.lit, ["system", "user", "assistant", "tool"]))
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("conv"), (F.col("l_linenumber").cast("bigint") * 1000 + F.row_number().over(w)).alias("turn"), F.get(roles, (F.col("l_partkey") % 4).cast("int")).alias("role"), F.col("l_partkey").cast("string").alias("text"), (1 + F.col("l_suppkey") % 3).alias("n"))


@R.add("f25d_last_assistant", f"WITH {_TURNS} SELECT conv, (SELECT text FROM turns t WHERE t.conv = c.conv AND role = 'assistant' ORDER BY turn DESC LIMIT 1) AS text FROM (SELECT DISTINCT conv FROM turns) c")
def f25d_last_assistant(spark, sf):
    return T.last_assistant(_turns(spark, sf), "conv")


@R.add("f25_chat_masks", f"WITH {_TURNS}, k AS (SELECT conv, turn, role, i FROM turns, range(3) AS r(i) WHERE i < n) SELECT conv, count(*) AS tokens, CAST(sum(CASE WHEN role = 'assistant' AND i >= 1 THEN 1 ELSE 0 END) AS BIGINT) AS bearing, max(i) AS widest FROM k GROUP BY conv")
def f25_chat_masks(spark, sf):
    rows = _turns(spark, sf).withColumn("tokens", F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1))
    out = S.chat_rows(rows, "conv", prefix=1)
    total = F.aggregate("loss_mask", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return out.select("conv", F.size("input_ids").cast("bigint").alias("tokens"), total.alias("bearing"), F.array_max("input_ids").alias("widest"))


@R.add("f25d_tool_reward", f"WITH {_TURNS} SELECT conv, turn, CASE WHEN n / 3.0 > coalesce(lag(n / 3.0) OVER (PARTITION BY conv ORDER BY turn), 0) THEN 0.0::DOUBLE ELSE -0.05::DOUBLE END AS adjusted FROM turns")
def f25d_tool_reward(spark, sf):
    rows = _turns(spark, sf).withColumn("reward", F.col("n") / 3.0)
    return T.tool_reward(rows, "conv").select("conv", "turn", "adjusted")


@R.add("pf11_response_mask", "SELECT vec_id AS seq, list_transform(embedding[55:64], lambda v: CASE WHEN v > 0 THEN 1 ELSE 0 END) AS mask, list_transform(range(64), lambda i: CASE WHEN i <= coalesce(list_position(list_transform(embedding, lambda v: CASE WHEN v > 0.2 THEN 1 ELSE 0 END), 1), 65) - 1 THEN 1 ELSE 0 END) AS eos FROM embeddings")
def pf11_response_mask(spark, sf):
    sign = F.transform("embedding", lambda v: F.when(v > 0, 1).otherwise(0))
    ends = F.transform("embedding", lambda v: F.when(v > 0.2, 1).otherwise(0))
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("seq"), sign.alias("m"), ends.alias("e"))
    return rows.select("seq", S.response_mask("m", 10).alias("mask"), S.eos_mask("e", F.lit(1)).alias("eos"))


@R.add("f26_preference_pairs", "SELECT vec_id AS seq, [list_transform(range(6), lambda i: CASE WHEN i < vec_id % 9 THEN i ELSE -1 END), list_transform(range(6), lambda i: CASE WHEN i < label + 1 THEN i ELSE -1 END)] AS pair FROM embeddings")
def f26_preference_pairs(spark, sf):
    ids = lambda n: F.filter(F.sequence(F.lit(0).cast("bigint"), F.lit(20).cast("bigint")), lambda i: i < n)
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("seq"), S.preference_pair(ids(F.col("vec_id") % 9), ids(F.col("label") + 1), 6, -1).alias("pair"))


@R.add("f25b_cut_request", "SELECT vec_id AS seq, CAST(least(40, 10 + vec_id % 20 + 24, 64) AS INT) AS n FROM embeddings")
def f25b_cut_request(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("seq"), F.size(S.cut_request("embedding", (10 + F.col("vec_id") % 20).cast("int"), 40, 24)).alias("n"))
