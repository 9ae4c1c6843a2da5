"""Problem 5: deeply nested records as related flat tables.

A tree of ``Table`` describes the wanted tables: where their rows stand in a record, which
fields they take and which tables hang below.  One depth-first pass over the records emits
every row of every table with its tag, own key, parent key, place and payload; the tagged
rows are written once, partitioned by tag, and each table is read back under its schema.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.runtime import shared_folder

TAGGED = "tag string, rec_table string, rec_id bigint, pk string, parent_pk string, parent_pos bigint, pos bigint, payload string"
_FIELDS = ["tag", "rec_table", "rec_id", "pk", "parent_pk", "parent_pos", "pos", "payload"]


@dataclass(frozen=True)
class Table:
    """A flat table: its tag, the places of its rows, its fields and the tables below it.

    A place is a path of keys to a list, from the record or from the row above; of several
    given in one place the first that is there counts.  A field takes the first of its
    paths with a value: text, number, boolean or list; a path that ends in ``{}`` takes
    objects too, as JSON text; the empty path is the element itself; a path that starts
    with ``~`` leads from the object that holds the list to a parallel list.
    """

    tag: str
    places: tuple[tuple[str, ...], ...] = ()
    fields: dict[str, tuple[str, ...]] = field(default_factory=dict)
    below: tuple[Table, ...] = ()

    def schema(self) -> str:
        return ", ".join(f"{name} string" for name in self.fields)

    def all(self) -> Iterator[Table]:
        yield self
        for t in self.below:
            yield from t.all()


#: Problem records in any of their deliveries.
RECORDS = Table(
    "record",
    fields={"dataset": ("dataset",), "problem_id": ("problem_id", "id", "name"), "statement": ("prompt", "content", "description", "problem_statement"), "meta": ("meta{}",), "fetched_at": ("fetched_at",)},
    below=(
        Table(
            "test",
            (("test",), ("test_cases.tests",)),
            {"input": ("input.stdin", "input", ""), "output": ("output.stdout", "output")},
            (Table("file", (("input.files",),), {"name": ("name",), "content": ("content", "")}),),
        ),
        Table("assert", (("test_cases.test_list",),), {"text": ("{}",)}),
        Table("challenge", (("test_cases.challenge_test_list",),), {"text": ("{}",)}),
        Table("solution", (("solutions.solution", "solutions"),), {"text": ("{}",), "language": ("~language",)}),
    ),
)


# ---------------------------------------------------------------- JSON text


def _opened(value):
    """A list or object, also one given as JSON text; anything else as it is."""
    if isinstance(value, str) and value.lstrip()[:1] in ("[", "{"):
        try:
            inner = json.loads(value)
        except (ValueError, RecursionError):
            return value
        return inner if isinstance(inner, (list, dict)) else value
    return value


def _at(value, path: str):
    """What stands at a path of keys; null where a step is missing."""
    for key in path.split(".") if path else ():
        value = _opened(value)
        value = value.get(key) if isinstance(value, dict) else None
    return value


def _text(value, objects: bool) -> str | None:
    if isinstance(value, str) or value is None:
        return value
    return None if isinstance(value, dict) and not objects else json.dumps(value, ensure_ascii=False)


def _field(value, paths: tuple[str, ...], holder, pos: int) -> str | None:
    for path in paths:
        if path.startswith("~"):
            side = _opened(_at(holder, path[1:]))
            found = _text(side[pos], True) if isinstance(side, list) and pos < len(side) else None
        else:
            found = _text(_at(value, path.removesuffix("{}")), path.endswith("{}"))
        if found is not None:
            return found
    return None


def _visit(table: Table, value, path: str, pos: int) -> Iterator[tuple[str, str, str, int, int, dict]]:
    for below in table.below:
        for place in below.places:
            for where in place:
                rows = _opened(_at(value, where))
                if isinstance(rows, list):
                    break
            else:
                continue
            holder = _at(value, where.rpartition(".")[0])
            for i, row in enumerate(rows):
                if row is None:
                    continue
                inner = _opened(row)
                here = f"{path}/{where}[{i}]"
                yield below.tag, here, path, pos, i, {name: _field(row, paths, holder, i) for name, paths in below.fields.items()}
                yield from _visit(below, inner, here, i)


def visit_payload(payload: str | None, table: Table = RECORDS) -> Iterator[tuple[str, str, str, int, int, dict]]:
    """Depth-first visit of one JSON record: (tag, path, parent path, parent place, place, fields).

    The record's own row comes first; a payload that is null, no valid JSON or no object
    has no other.  Null elements are skipped but counted in the places; lists and objects
    given as JSON text count as such; the place of a row below the record itself is -1 for
    its parent.  Fields of other kinds are left alone.
    """
    try:
        root = json.loads(payload) if payload is not None else None
    except (ValueError, RecursionError):
        root = None
    root = root if isinstance(root, dict) else {}
    yield table.tag, "", "", -1, 0, {name: _field(root, paths, None, 0) for name, paths in table.fields.items()}
    yield from _visit(table, root, "", -1)


def flatten_json(records: DataFrame, id_col: str, json_col: str, rec_table: str, table: Table = RECORDS, carry: tuple[str, ...] = ()) -> DataFrame:
    """Tagged rows of records whose nested part is JSON text: one visit a record, in Arrow batches.

    Keys are ``rec_table:id`` plus the path of the element, so children name their parents
    without a join; a record without an id has a hash of its text in the key instead, so
    only children of equal records share a parent.  ``carry`` names columns that fill the
    record's fields of the same name.
    """
    types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches):
        def made(out):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], _FIELDS)

        for batch in batches:
            out: list[list] = [[] for _ in _FIELDS]
            columns = [c.to_pylist() for c in batch.columns]
            for rid, payload, *carried in zip(*columns):
                key = f"{rec_table}:{rid}" if rid is not None else f"{rec_table}:null-{xxhash.xxh64_hexdigest(payload or '')}"
                for tag, path, parent, parent_pos, pos, body in visit_payload(payload, table):
                    if not path:
                        body.update({c: v for c, v in zip(carry, carried) if v is not None})
                    row = (tag, rec_table, rid, key + path, key + parent if path else None, parent_pos, pos, json.dumps({k: v for k, v in body.items() if v is not None}, ensure_ascii=False))
                    for column, value in zip(out, row):
                        column.append(value)
                if len(out[0]) > 20_000:
                    yield made(out)
                    out = [[] for _ in _FIELDS]
            yield made(out)

    return records.select(F.col(id_col).cast("bigint"), F.col(json_col).cast("string"), *[F.col(c).cast("string") for c in carry]).mapInArrow(run, TAGGED)


# ---------------------------------------------------------------- typed columns


def _type_at(kind, path: str):
    """The type that a path of struct fields leads to, null if it leads nowhere."""
    for key in path.split(".") if path else ():
        kind = next((f.dataType for f in kind.fields if f.name == key), None) if kind is not None and kind.typeName() == "struct" else None
    return kind


def _value(base: Column | None, path: str) -> Column:
    """The column at a path, from an element or (null base) from the record."""
    keys = path.split(".") if path else []
    value = base if base is not None else F.col(keys.pop(0))
    for key in keys:
        value = value[key]
    return value


def _typed_fields(table: Table, base: Column | None, kind) -> Column:
    """The payload of a row as JSON text."""
    out = []
    for name, paths in table.fields.items():
        found = []
        for path in paths:
            bare = path.removesuffix("{}")
            at = None if path.startswith("~") else _type_at(kind, bare)
            if at is not None and (at.typeName() != "struct" or path.endswith("{}")):
                value = _value(base, bare)
                found.append(F.to_json(value) if at.typeName() in ("struct", "array", "map") else value.cast("string"))
        if found:
            out.append(F.coalesce(*found).alias(name))
    return F.to_json(F.struct(*out)) if out else F.lit("{}")


def _typed_rows(table: Table, base: Column | None, kind, key: Column, pos: Column) -> list[Column]:
    """Arrays of tagged rows for all tables below ``table``, null where there are none."""
    out = []
    for below in table.below:
        for place in below.places:
            where = next((w for w in place if (t := _type_at(kind, w)) is not None and t.typeName() == "array"), None)
            if where is None:
                continue
            inner = _type_at(kind, where).elementType
            values = _value(base, where)

            def row(x, i):  # called at once, within this turn of the loop
                pk = F.concat(key, F.lit(f"/{where}["), i.cast("string"), F.lit("]"))
                own = F.struct(F.lit(below.tag).alias("tag"), pk.alias("pk"), key.alias("parent_pk"), pos.alias("parent_pos"), i.cast("bigint").alias("pos"), _typed_fields(below, x, inner).alias("payload"))
                parts = [F.array(own), *[F.coalesce(p, F.array().cast(_ROWS)) for p in _typed_rows(below, x, inner, pk, i.cast("bigint"))]]
                return F.when(x.isNotNull(), F.concat(*parts) if len(parts) > 1 else parts[0])

            out.append(F.flatten(F.filter(F.transform(values, row), lambda r: r.isNotNull())))
    return out


_ROWS = "array<struct<tag: string, pk: string, parent_pk: string, parent_pos: bigint, pos: bigint, payload: string>>"


def flatten_typed(records: DataFrame, id_col: str, rec_table: str, table: Table = RECORDS) -> DataFrame:
    """Tagged rows of records with typed nested columns, in one generator on the JVM side.

    Paths of ``table`` that the schema does not have give nothing; structs and lists may be
    missing, null or empty; null elements are skipped but counted in the places.
    """
    rid = F.col(id_col).cast("bigint")
    text = F.to_json(F.struct(*[F.col(c) for c in records.columns]))
    key = F.concat(F.lit(rec_table + ":"), F.coalesce(rid.cast("string"), F.concat(F.lit("null-"), F.xxhash64(text).cast("string"))))
    top = F.array(F.struct(F.lit(table.tag).alias("tag"), key.alias("pk"), F.lit(None).cast("string").alias("parent_pk"), F.lit(-1).cast("bigint").alias("parent_pos"), F.lit(0).cast("bigint").alias("pos"), _typed_fields(table, None, records.schema).alias("payload")))
    parts = [top, *[F.coalesce(p, F.array().cast(_ROWS)) for p in _typed_rows(table, None, records.schema, key, F.lit(-1).cast("bigint"))]]
    rows = records.select(rid.alias("rec_id"), F.explode(F.concat(*parts)).alias("c"))
    return rows.select("c.tag", F.lit(rec_table).alias("rec_table"), "rec_id", "c.pk", "c.parent_pk", "c.parent_pos", "c.pos", "c.payload")


# ---------------------------------------------------------------- tables


def children(tagged: DataFrame, top: str = RECORDS.tag) -> DataFrame:
    """(rec_table, rec_id, child_kind, parent_pos, pos) of all elements, records themselves left out.

    A record that holds tests in both their places gives the places of both; the keys of
    ``tagged`` tell them apart, this view need not.
    """
    return tagged.filter(F.col("tag") != top).select("rec_table", "rec_id", F.col("tag").alias("child_kind"), "parent_pos", "pos")


def as_table(tagged: DataFrame, tag: str, table: Table = RECORDS) -> DataFrame:
    """One flat table under its schema: rec_table, rec_id, pk, parent_pk, parent_pos, pos and the payload's columns."""
    schema = next(t for t in table.all() if t.tag == tag).schema()
    body = F.from_json("payload", schema)
    return tagged.filter(F.col("tag") == tag).select("rec_table", "rec_id", "pk", "parent_pk", "parent_pos", "pos", body.alias("b")).select("rec_table", "rec_id", "pk", "parent_pk", "parent_pos", "pos", "b.*")


def write_tables(tagged: DataFrame, path: str) -> None:
    """Writes all tables in one job, a directory a tag."""
    tagged.write.partitionBy("tag").mode("overwrite").parquet(path)


def read_tagged(spark: SparkSession, path: str) -> DataFrame:
    """The written rows of all tables; a filter on the tag reads that directory alone."""
    return spark.read.schema(TAGGED).parquet(path)


def read_table(spark: SparkSession, path: str, tag: str, table: Table = RECORDS) -> DataFrame:
    """One written table under its schema; the other tags' directories are not read."""
    return as_table(read_tagged(spark, path), tag, table)


def stored(tagged: DataFrame, path: str | None = None) -> DataFrame:
    """The tagged rows written once (to a new folder of the shared one unless ``path`` is given) and read back."""
    path = path or shared_folder(tagged.sparkSession, "tagged")
    write_tables(tagged, path)
    return read_tagged(tagged.sparkSession, path)
