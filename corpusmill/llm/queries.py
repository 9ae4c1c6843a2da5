"""Queries of the training-data operators, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import runtime
from corpusmill.functions.runtime import collect_bounded, table
from corpusmill.llm import defects, entities, leakage, neargroups, overlap, packing, sampling, splitting
from corpusmill.plans.registry import Registry

R = Registry()

_SHINGLES = r"""{name} AS (
  SELECT sample_id, s FROM (
    SELECT sample_id, unnest(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS s
    FROM (SELECT sample_id, regexp_extract_all(lower({column}), '[a-z0-9]+') AS w FROM dataset_samples WHERE {column} IS NOT NULL) WHERE len(w) >= 20)),
{name}_n AS (SELECT sample_id, count(*) AS n FROM {name} GROUP BY sample_id),
{name}_near AS (
  SELECT c.a, c.b FROM (SELECT x.sample_id AS a, y.sample_id AS b, count(*) AS k FROM {name} x JOIN {name} y ON x.s = y.s AND x.sample_id < y.sample_id GROUP BY 1, 2) c
  JOIN {name}_n p ON p.sample_id = c.a JOIN {name}_n q ON q.sample_id = c.b WHERE c.k >= 0.7 * (p.n + q.n - c.k) - 1e-9)"""

_SPLITS = """sp AS (SELECT sample_id, min(CASE WHEN lower(trim(split)) IN ('train', 'training') THEN 'train' WHEN lower(trim(split)) IN ('valid', 'val', 'validation', 'dev', 'development') THEN 'valid'
  WHEN lower(trim(split)) IN ('test', 'testing') THEN 'test' END) AS split FROM manifest GROUP BY sample_id)"""

_P1 = f"WITH {_SHINGLES.format(name='sh', column='prompt')}, {_SPLITS}, found AS (SELECT a AS sample_id_a, b AS sample_id_b, x.split AS sa, y.split AS sb FROM sh_near JOIN sp x ON x.sample_id = a JOIN sp y ON y.sample_id = b WHERE x.split IS NOT NULL AND y.split IS NOT NULL AND (x.split = 'train') <> (y.split = 'train'))"

_P8 = r"""WITH dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL), iw AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM heldout_items WHERE text IS NOT NULL),
i AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 15], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 14)) AS k FROM iw WHERE len(w) >= 16)),
d AS (SELECT doc_id, k, array_to_string(w[k:k + 15], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 14)) AS k FROM dw WHERE len(w) >= 16)),
hits AS (SELECT DISTINCT d.doc_id, i.item_id, d.k - 1 AS pos FROM d JOIN i ON i.g = d.g)"""


@R.add("p1_found", _P1 + " SELECT sample_id_a, sample_id_b FROM found")
def p1_found(spark, sf):
    """Near pairs of prompts across train and valid or test."""
    return overlap.cross_split_pairs(table(spark, sf, "dataset_samples"), table(spark, sf, "manifest"))


@R.add(
    "p1_report",
    _P1
    + """, e AS (SELECT CASE WHEN sa = 'train' THEN sb ELSE sa END AS split, CASE WHEN sa = 'train' THEN sample_id_b ELSE sample_id_a END AS ev, CASE WHEN sa = 'train' THEN sample_id_a ELSE sample_id_b END AS tr FROM found)
SELECT e.split, x.dataset AS dataset, y.dataset AS train_dataset, count(*) AS pairs, count(DISTINCT ev) AS eval_records, count(DISTINCT tr) AS train_records
FROM e JOIN dataset_samples x ON x.sample_id = ev JOIN dataset_samples y ON y.sample_id = tr GROUP BY 1, 2, 3""",
)
def p1_report(spark, sf):
    """Counts of the cross-split overlaps by split and dataset."""
    samples, manifest = table(spark, sf, "dataset_samples"), table(spark, sf, "manifest")
    return overlap.overlap_report(overlap.cross_split_pairs(samples, manifest), samples, manifest)


@R.add(
    "p1_links",
    _P1
    + """, s AS (SELECT sh.sample_id, md5(string_agg(s, chr(10) ORDER BY s)) AS key FROM sh JOIN sp ON sp.sample_id = sh.sample_id WHERE sp.split IS NOT NULL GROUP BY 1),
c AS (SELECT sample_id, min(sample_id) OVER (PARTITION BY key) AS class_id FROM s), n AS (SELECT id, count(*) AS links FROM (SELECT sample_id_a AS id FROM found UNION ALL SELECT sample_id_b FROM found) GROUP BY id)
SELECT sample_id, class_id, links FROM c JOIN n ON id = sample_id""",
)
def p1_links(spark, sf):
    """Every record with near ones across the splits: its class of equal texts and how many there are."""
    return overlap.cross_split_links(table(spark, sf, "dataset_samples"), table(spark, sf, "manifest"))


@R.add(
    "p2_found",
    f"""WITH RECURSIVE {_SHINGLES.format(name='sp', column='prompt')}, {_SHINGLES.format(name='sd', column='description')},
e AS (SELECT a, b FROM sp_near UNION SELECT a, b FROM sd_near UNION SELECT b, a FROM sp_near UNION SELECT b, a FROM sd_near),
r AS (SELECT DISTINCT a AS node, a AS reached FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reached)
SELECT node AS sample_id, min(reached) AS group_id FROM r GROUP BY node""",
)
def p2_found(spark, sf):
    """Groups of records with near prompts or near descriptions."""
    return neargroups.near_groups(table(spark, sf, "dataset_samples"), "sample_id", ["prompt", "description"], 0.7, 3, 20)


_ENTITIES = r"""n AS (
  SELECT sample_id, dataset, problem_id, lower(trim(regexp_replace(problem_id, '\s+', ' ', 'g'))) AS s FROM dataset_samples),
k AS (
  SELECT sample_id, CASE WHEN trim(problem_id) = '' THEN NULL
    WHEN NOT starts_with(dataset, 'codecontests') THEN dataset || ' ' || problem_id
    WHEN regexp_matches(s, '^([a-z]+)(?:[^a-z0-9]+contest)?[^a-z0-9]*0*([0-9]+)')
      THEN 'contest ' || regexp_extract(s, '^([a-z]+)(?:[^a-z0-9]+contest)?[^a-z0-9]*0*([0-9]+)', 1) || '/' || regexp_extract(s, '^([a-z]+)(?:[^a-z0-9]+contest)?[^a-z0-9]*0*([0-9]+)', 2)
    WHEN regexp_matches(s, '^0*([0-9]+).*\(\s*([a-z]+)\s*\)$')
      THEN 'contest ' || regexp_extract(s, '^0*([0-9]+).*\(\s*([a-z]+)\s*\)$', 2) || '/' || regexp_extract(s, '^0*([0-9]+).*\(\s*([a-z]+)\s*\)$', 1)
    ELSE 'contest ' || lower(trim(problem_id)) END AS key
  FROM n)"""

@R.add(
    "p6_found",
    f"""WITH {_ENTITIES},
g AS (SELECT sample_id, min(sample_id) OVER (PARTITION BY key) AS group_id, count(*) OVER (PARTITION BY key) AS n FROM k WHERE key IS NOT NULL)
SELECT sample_id, group_id FROM g WHERE n > 1""",
)
def p6_found(spark, sf):
    """Samples of one contest or problem, by union-find over the entities that their ids name."""
    samples = table(spark, sf, "dataset_samples")
    return entities.related(samples, "sample_id", [entities.entity_of(F.col("dataset"), F.col("problem_id"))]).select(F.col("node").alias("sample_id"), F.col("root").alias("group_id"))


_P6_SPLITS = f"""WITH RECURSIVE {_ENTITIES},
m AS (SELECT k.sample_id, coalesce(min(k.sample_id) OVER (PARTITION BY key, key IS NULL), k.sample_id) AS root0, key, CASE WHEN starts_with(dataset, 'codecontests') THEN 'code_contests' ELSE dataset END AS family FROM k JOIN dataset_samples USING (sample_id)),
r AS (SELECT sample_id, family, CASE WHEN key IS NULL THEN sample_id ELSE root0 END AS root FROM m),
sz AS (SELECT family, root, count(*) AS size FROM r GROUP BY family, root), tot AS (SELECT family, sum(size) AS total FROM sz GROUP BY family),
o AS (SELECT meta_id, root, size, CAST('0x' || substr(sha256(coalesce(CAST(sampling.seed AS VARCHAR), '0') || '|' || CAST(root AS VARCHAR)), 1, 13) AS BIGINT) AS h FROM sz JOIN split_meta ON dataset = family),
q AS (SELECT *, row_number() OVER (PARTITION BY meta_id ORDER BY size DESC, h, root) AS k, row_number() OVER (PARTITION BY meta_id, size ORDER BY h, root) AS nth FROM o),
s AS (SELECT meta_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS size, 0 AS got, total * train_share / (train_share + valid_share + test_share) AS a, total * valid_share / (train_share + valid_share + test_share) AS b, total * test_share / (train_share + valid_share + test_share) AS c FROM split_meta JOIN tot ON dataset = family
  UNION ALL SELECT meta_id, k, size, got, a - CASE got WHEN 1 THEN size ELSE 0 END, b - CASE got WHEN 2 THEN size ELSE 0 END, c - CASE got WHEN 3 THEN size ELSE 0 END
  FROM (SELECT s.meta_id, q.k, q.size, CASE WHEN a >= b AND a >= c THEN 1 WHEN b >= c THEN 2 ELSE 3 END AS got, a, b, c FROM s JOIN q ON q.meta_id = s.meta_id AND q.k = s.k + 1)),
cnt AS (SELECT meta_id, size, count(*) FILTER (got = 1) AS e1, count(*) FILTER (got <= 2) AS e2 FROM s WHERE k > 0 GROUP BY meta_id, size)
SELECT q.meta_id, r.sample_id, r.root AS group_id, CASE WHEN nth <= e1 THEN 'train' WHEN nth <= e2 THEN 'valid' ELSE 'test' END AS split
FROM q JOIN cnt ON cnt.meta_id = q.meta_id AND cnt.size = q.size JOIN r ON r.root = q.root"""


@R.add("p6_splits", _P6_SPLITS)
def p6_splits(spark, sf):
    """Group-preserving splits of all samples in the shares of each row of split_meta."""
    samples = table(spark, sf, "dataset_samples")
    # related records share a family, so the groups are found once for all settings
    members = entities.memberships(samples, "sample_id", [entities.entity_of(F.col("dataset"), F.col("problem_id"))])
    family = F.when(F.col("dataset").startswith("codecontests"), "code_contests").otherwise(F.col("dataset"))
    members = runtime.cut(members.join(samples.select(F.col("sample_id").alias("node"), family.alias("family")).distinct(), "node"))
    rows = collect_bounded(table(spark, sf, "split_meta").orderBy("meta_id"), 1000, "split_meta")
    settings = [{"setting": r["meta_id"], "family": r["dataset"], "seed": r["sampling"]["seed"], **{n: r[f"{n}_share"] for n in ("train", "valid", "test")}} for r in rows]
    return entities.assign_groups(members, settings).select(F.col("setting").alias("meta_id"), F.col("node").alias("sample_id"), F.col("root").alias("group_id"), "split")


@R.add("p3_found")
def p3_found(spark, sf):
    """Defective prompt and response pairs with the type of the defect."""
    return defects.defective_pairs(table(spark, sf, "per_problem"), table(spark, sf, "documents").select("text", "lang"))


_KEY = r"""CASE WHEN s = '' THEN NULL WHEN dataset = 'code_contests' AND regexp_matches(s, '^[a-z]+(?:[^a-z0-9]+contest)?[^a-z0-9]*[0-9]+(?:[^a-z0-9]+problem)?[^a-z0-9]*([a-z][0-9]*)$')
    THEN regexp_extract(s, '^([a-z]+)', 1) || '/' || regexp_extract(s, '^[a-z]+(?:[^a-z0-9]+contest)?[^a-z0-9]*0*([0-9]+)', 1) || '/' || regexp_extract(s, '([a-z][0-9]*)$', 1)
  WHEN dataset = 'code_contests' AND regexp_matches(s, '^[0-9]+[^a-z0-9]*([a-z][0-9]*)\..*\(\s*[a-z]+\s*\)$')
    THEN regexp_extract(s, '\(\s*([a-z]+)\s*\)$', 1) || '/' || regexp_extract(s, '^0*([0-9]+)', 1) || '/' || regexp_extract(s, '^[0-9]+[^a-z0-9]*([a-z][0-9]*)\.', 1) ELSE s END"""


_P4 = f"""WITH n AS (SELECT *, lower(trim(regexp_replace(problem_id, '\\s+', ' ', 'g'))) AS s FROM manifest), i AS (SELECT dataset, {_KEY} AS key, sample_id, min(version) AS version FROM n WHERE version IS NOT NULL GROUP BY 1, 2, 3),
a AS (SELECT meta_id, sampling.seed AS seed, key, greatest(version, strftime(created_at, '%Y%m%d_%H%M%S')) AS v, count(*) AS w, sampling.requested_valid_big_size AS size, sampling.fraction AS fraction
  FROM i JOIN split_meta m ON m.dataset = i.dataset WHERE key IS NOT NULL AND (sampling.prefix IS NULL OR starts_with(key, lower(trim(sampling.prefix)))) GROUP BY ALL),
t AS (SELECT meta_id, v, sum(sum(w)) OVER (PARTITION BY meta_id ORDER BY v) AS total FROM a GROUP BY meta_id, v),
o AS (SELECT a.*, t.total, sum(w) OVER (PARTITION BY a.meta_id, key ORDER BY a.v) AS own FROM a JOIN t ON t.meta_id = a.meta_id AND t.v = a.v),
c AS (SELECT meta_id, seed, key, max(own) AS weight, max(least(1.0, own * least(1.0, coalesce(fraction, size / total, 0.0)))) AS chance FROM o GROUP BY 1, 2, 3)
SELECT meta_id, seed, key AS problem_key, CAST(weight AS DOUBLE) AS weight, round(CAST(chance AS DOUBLE), 9) AS chance FROM c WHERE CAST('0x' || substr(sha256(coalesce(CAST(seed AS VARCHAR), '') || '|' || key), 1, 13) AS BIGINT) / 4503599627370496.0 < chance"""


def _sampled(state):
    return sampling.selected(state).select(F.col("stratum").alias("meta_id"), "seed", F.col("key").alias("problem_key"), "weight", F.round("chance", 9).alias("chance"))


@R.add("p4_sample", _P4)
def p4_sample(spark, sf):
    """The growing-stable sample of problems for each row of split_meta, from its stored state."""
    return _sampled(sampling.stored_state(sampling.manifest_arrivals(table(spark, sf, "manifest"), table(spark, sf, "split_meta"))))


@R.add("p4_grown", _P4)
def p4_grown(spark, sf):
    """The same sample reached in two steps: the state after the earlier half of versions is stored, the rest goes on from it."""
    rows = sampling.manifest_arrivals(table(spark, sf, "manifest"), table(spark, sf, "split_meta"))
    middle = rows.agg(F.percentile_approx(F.translate("version", "_", "").cast("bigint"), 0.5)).first()[0] or 0
    late = F.translate("version", "_", "").cast("bigint") > middle
    return _sampled(sampling.stored_state(rows.filter(late), sampling.stored_state(rows.filter(~late))))


@R.add("p7_pack")
def p7_pack(spark, sf):
    """Every document's place in a container, for each pack limit."""
    return packing.pack_documents(table(spark, sf, "documents"), table(spark, sf, "token_limits"))


@R.add("p7_fill")
def p7_fill(spark, sf):
    """Containers and used space of each pack limit."""
    limits = table(spark, sf, "token_limits")
    return packing.fill_report(packing.pack_documents(table(spark, sf, "documents"), limits), limits)


@R.add("p8_found", _P8 + " SELECT DISTINCT doc_id, item_id FROM hits")
def p8_found(spark, sf):
    """Documents that share 16 consecutive words with a held-out item."""
    return leakage.leaked_passages(table(spark, sf, "documents"), table(spark, sf, "heldout_items")).select("doc_id", "item_id").distinct()


@R.add(
    "p8_spans",
    _P8
    + """, s AS (SELECT DISTINCT doc_id, pos FROM hits), m AS (SELECT *, CASE WHEN pos <= lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 16 THEN 0 ELSE 1 END AS new FROM s),
g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS grp FROM m)
SELECT doc_id, min(pos) AS start_word, max(pos) + 16 AS end_word FROM g GROUP BY doc_id, grp""",
)
def p8_spans(spark, sf):
    """The word spans to remove from each document."""
    return leakage.removal_spans(leakage.leaked_passages(table(spark, sf, "documents"), table(spark, sf, "heldout_items")))


@R.add("p9_found")
def p9_found(spark, sf):
    """Documents of more tokens than the smallest split limit, as the splitter cuts them."""
    limit = collect_bounded(table(spark, sf, "token_limits").filter("purpose = 'split'").orderBy("max_tokens", "limit_id"), 100, "split limits")[0]
    pieces = splitting.split_documents(table(spark, sf, "documents"), limit["max_tokens"], limit["overlap_tokens"] or 0)
    return pieces.filter("piece = 0").select("doc_id")


@R.add("p9_pieces")
def p9_pieces(spark, sf):
    """All pieces of oversized documents, for each split limit."""
    return splitting.split_by_limits(table(spark, sf, "documents"), table(spark, sf, "token_limits"))


QUERIES = R.queries
ORACLES = R.oracles
