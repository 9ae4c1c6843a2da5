"""Scans and sinks: file lists, JSON lines, manifests, run outputs, metric logs, checkpoints."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.text import first_text


def _path(spark: SparkSession, text: str):
    """(Hadoop file system, path): what a path means on any storage that Spark reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(text)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """The paths that a pattern names, in order; none where nothing matches."""
    system, path = _path(spark, pattern)
    found = system.globStatus(path)
    return sorted(f.getPath().toString() for f in found) if found is not None else []


def read_note(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, null if there is none."""
    system, where = _path(spark, path)
    if not system.exists(where):
        return None
    stream = system.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_note(spark: SparkSession, path: str, text: str) -> None:
    """A small file with a text, replaced if it is there."""
    system, where = _path(spark, path)
    stream = system.create(where, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()


def read_files(spark: SparkSession, files: list[str]) -> DataFrame:
    """Parquet and JSON(L) files as one table, columns matched by name; another ending is an error."""
    out = None
    for kind in ("parquet", "json"):
        some = [f for f in files if f.rstrip("/").rsplit(".", 1)[-1] in ({"parquet"} if kind == "parquet" else {"json", "jsonl"})]
        if some:
            part = spark.read.format(kind).load(some)
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    unknown = [f for f in files if f.rstrip("/").rsplit(".", 1)[-1] not in {"parquet", "json", "jsonl"}]
    if unknown or out is None:
        raise ValueError(f"unknown file type: {unknown or files}")
    return out


def nested(column: str, keys: list[str]) -> str:
    """The path of a field within a struct column, for ``F.col``."""
    return ".".join([column, *keys])


def read_sft(spark: SparkSession, files: list[str], prompt: list[str], response: list[str]) -> DataFrame:
    """(prompt, response) of supervised rows, each reached through a path of keys."""
    rows = read_files(spark, files)
    return rows.select(F.col(".".join(prompt)).alias("prompt"), F.col(".".join(response)).alias("response"))


def read_preferences(spark: SparkSession, files: list[str]) -> DataFrame:
    """(prompt, chosen, rejected)."""
    return read_files(spark, files).select("prompt", "chosen", "rejected")


def read_conversations(spark: SparkSession, files: list[str], messages: str = "messages", tools: str | None = None, thinking: str | None = None) -> DataFrame:
    """(messages[, tools, enable_thinking]) of multi-turn rows; missing options are null."""
    rows = read_files(spark, files)
    pick = lambda c, t, name: (F.col(c) if c and c in rows.columns else F.lit(None).cast(t)).alias(name)
    return rows.select(F.col(messages).alias("messages"), pick(tools, "string", "tools"), pick(thinking, "boolean", "enable_thinking"))


def read_json_lines(spark: SparkSession, path: str, schema: str | None = None, strict: bool = True) -> DataFrame:
    """JSON lines, blank lines skipped.

    ``strict`` makes a broken line an error when read; otherwise its columns are null and
    ``_corrupt_record`` holds its text.
    """
    reader = spark.read.option("mode", "FAILFAST" if strict else "PERMISSIVE")
    if schema:
        reader = reader.schema(schema if strict else schema + ", _corrupt_record string")
    return reader.json(path)


def numbered_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(file, line, parsed record, ok): lines with their 1-based number in each file, blank ones left out.

    Files are read in blocks: lines are numbered within their block and shifted by the
    lines of the file's blocks before, so a large file is spread over many tasks.
    """
    from corpusmill.functions.ranking import numbered_cells

    # lines of a block come in order, which the increasing id keeps
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__cell"), F.monotonically_increasing_id().alias("__at"), F.col("value").alias("text"))
    numbered = numbered_cells(lines, ["file"], ["__at"], "line")
    return numbered.filter(F.trim("text") != "").select("file", (F.col("line") + 1).cast("int").alias("line"), F.from_json("text", schema).alias("record"), F.get_json_object("text", "$").isNotNull().alias("ok"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest whose ids are not empty and unique; otherwise reading it is an error."""
    from corpusmill.operators.governance import unique_ids

    return unique_ids(read_json_lines(spark, path))


def load_run(spark: SparkSession, folder: str) -> DataFrame:
    """A run's per-problem records, or its sampled question log where there are none; ``sampled`` tells which."""
    whole = matching(spark, f"{folder}/per_problem*.jsonl")
    log = matching(spark, f"{folder}/qa_log*.jsonl") + matching(spark, f"{folder}/qa_logs/*.jsonl")
    if not whole and not log:
        raise FileNotFoundError(f"no records in {folder}")
    return read_json_lines(spark, whole or log).withColumn("sampled", F.lit(not whole))


def datasets_in(spark: SparkSession, folder: str, suffix: str = "_manifest.jsonl") -> list[str]:
    """The datasets that have a manifest in a folder."""
    return [p.rsplit("/", 1)[-1][: -len(suffix)] for p in matching(spark, f"{folder}/*{suffix}")]


SOURCES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register_source(name: str):
    """Decorator that makes a loader (session, path) known under a name."""

    def wrap(fn):
        SOURCES[name] = fn
        return fn

    return wrap


def fetch(spark: SparkSession, name: str, path: str, ids: list[str] | None = None, other_name: str | None = None) -> DataFrame:
    """Rows of a registered source (or of its other name), on wish of some ids only."""
    loader = SOURCES.get(name) or SOURCES.get(other_name or "")
    if loader is None:
        raise ValueError(f"unknown source {name!r}; known: {sorted(SOURCES)}")
    rows = loader(spark, path)
    return rows.filter(F.col("problem_id").isin(ids)) if ids else rows


def fetch_all(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """All named sources as one table, columns matched by name."""
    out = None
    for name, path in paths.items():
        part = fetch(spark, name, path).withColumn("dataset", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def contest_problems(rows: DataFrame, most_solutions: int = 3) -> DataFrame:
    """(problem_id, prompt, solutions): the first statement field that is not blank; rows without one are dropped."""
    fields = [c for c in ("content", "description", "problem_statement", "prompt") if c in rows.columns]
    return rows.select("problem_id", first_text(*fields).alias("prompt"), F.slice(F.coalesce("solutions", F.array().cast("array<string>")), 1, most_solutions).alias("solutions")).filter("prompt IS NOT NULL")


def id_range(rows: DataFrame, low: int, high: int, key: str = "problem_id") -> DataFrame:
    """Rows with a numeric id in [low, high]; other ids pass."""
    n = F.expr(f"try_cast({key} AS BIGINT)")
    return rows.filter(n.isNull() | n.between(low, high))


@register_source("humaneval")
def _humaneval(spark: SparkSession, path: str) -> DataFrame:
    return read_files(spark, [path]).filter("dataset = 'humaneval'").drop("dataset")


@register_source("mbpp_reg")
def _mbpp(spark: SparkSession, path: str) -> DataFrame:
    return read_files(spark, [path]).filter("dataset = 'mbpp_reg'").drop("dataset")


@register_source("codecontests")
def _contests(spark: SparkSession, path: str) -> DataFrame:
    return contest_problems(read_files(spark, [path]).filter("dataset LIKE 'codecontests%'"))


def write_json_lines(rows: DataFrame, path: str) -> None:
    """JSON lines, nulls left out, other scripts as they are."""
    rows.write.mode("overwrite").json(path)


def dump_generations(rows: DataFrame, folder: str, step: int) -> str:
    """(input, output, gts, score, step, ...) of a step as JSON lines under ``folder/step.jsonl``; the path."""
    path = f"{folder}/{step}.jsonl"
    rows.withColumn("step", F.lit(step).cast("bigint")).write.mode("overwrite").json(path)
    return path


def view_generations(spark: SparkSession, folder: str, search: str | None = None, fields: list[str] | None = None, mask: str | None = None) -> DataFrame:
    """Dumped generations with the step that the file name gives, on wish masked, searched and cut to some fields."""
    rows = spark.read.json(f"{folder}/*.jsonl")
    texts = [f.name for f in rows.schema.fields if f.dataType.simpleString() == "string"]
    step = F.regexp_extract(F.col("_metadata.file_path"), r"([0-9]+)\.jsonl", 1).cast("bigint")
    rows = rows.withColumn("file_step", step)
    if mask:
        rows = rows.withColumns({c: F.regexp_replace(c, mask, "*") for c in texts})
    if search:
        hit = F.lit(False)
        for c in texts:
            hit = hit | F.coalesce(F.col(c).contains(search), F.lit(False))
        rows = rows.filter(hit)
    return rows.select("file_step", *fields) if fields else rows


def write_splits(rows: DataFrame, folder: str, split: str = "split") -> None:
    """Parquet, one directory a split."""
    rows.write.mode("overwrite").partitionBy(split).parquet(folder)


def save_batch(batch: DataFrame, path: str) -> None:
    """A batch on disk."""
    batch.write.mode("overwrite").parquet(path)


def load_batch(spark: SparkSession, path: str) -> DataFrame:
    """A batch from disk."""
    return spark.read.parquet(path)


def cached_rollout(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The batch dumped at ``path``, made and dumped first if there is none."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        save_batch(make(), path)
    return load_batch(spark, path)


def copy_to_shared(spark: SparkSession, path: str, folder: str) -> str:
    """A file copied into a folder under a name from its path's hash, unless one of its size is there; the copy's path."""
    import hashlib

    hadoop = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsc.hadoopConfiguration()
    source = hadoop.Path(path)
    target = hadoop.Path(f"{folder}/{hashlib.md5(path.encode()).hexdigest()}/{source.getName()}")  # noqa: S324 - a name, not a secret
    a, b = source.getFileSystem(conf), target.getFileSystem(conf)
    if not b.exists(target) or b.getFileStatus(target).getLen() != a.getFileStatus(source).getLen():
        hadoop.FileUtil.copy(a, source, b, target, False, True, conf)
    return target.toString()


def metric_sink(kind: str, path: str | None = None, spark: SparkSession | None = None) -> Callable[[dict, int], None]:
    """A function (metrics, step) that prints a line or writes one to a folder of JSON lines; other back ends are not ours.

    The folder holds a file a step, on any storage, so that a step written again replaces
    its line; ``read_json_lines`` reads them all.
    """
    if kind == "console":
        return lambda metrics, step: print(f"step:{step} - " + " - ".join(f"{k}:{v}" for k, v in metrics.items()))
    if kind == "file":
        return lambda metrics, step: write_note(spark, f"{path}/{step:012d}.jsonl", json.dumps({"step": step, "data": metrics}, ensure_ascii=False) + "\n")
    raise ValueError(f"unknown metric sink {kind!r}")


def with_generated(rows: DataFrame, generate: Callable[[DataFrame], DataFrame], batch: DataFrame) -> DataFrame:
    """The data set with the rows that a generator makes from the last batch."""
    return rows.unionByName(generate(batch), allowMissingColumns=True)


_TRACKER = "latest_checkpointed_iteration.txt"


def latest_checkpoint(spark: SparkSession, folder: str, stem: str = "global_step_") -> str | None:
    """The checkpoint directory that the tracker file names, null without one."""
    step = read_note(spark, f"{folder}/{_TRACKER}")
    found = matching(spark, f"{folder}/{stem}{step.strip()}") if step else []
    return found[0] if found else None


def save_loader(spark: SparkSession, folder: str, step: int, state: dict, stem: str = "global_step_") -> str:
    """A loader's state (epoch, position, seed) beside the checkpoint of a step; the tracker file comes last."""
    path = f"{folder}/{stem}{step}/data.json"
    write_note(spark, path, json.dumps(state))
    write_note(spark, f"{folder}/{_TRACKER}", str(step))
    return path


def load_loader(spark: SparkSession, folder: str) -> dict:
    """The state of the latest checkpoint; the start of the first epoch without one."""
    last = latest_checkpoint(spark, folder)
    text = read_note(spark, f"{last}/data.json") if last else None
    return json.loads(text) if text else {"epoch": 0, "position": 0, "seed": 0}


def remaining(ordered: DataFrame, state: dict, place: str = "place") -> DataFrame:
    """The rows that a loader has still to give out in its epoch, by their place in its order."""
    return ordered.filter(F.col(place) >= state["position"])
