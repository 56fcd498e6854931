"""Deeply nested records as flat tables that keep parent, position and shape.

A record is a tree.  A tree automaton runs over it from the leaves up and gives
every child a state: its shape, spelled by its members and their states.  The
state is the child's variant, and decides what becomes of it: the null state is
no child, an object goes to the subtype of its path's objects, a bare text,
number or list to the subtype of those.  All children share one supertype table
(record, path, ordinals, the parent's ordinals, variant, payload); the typed
tables of the subtypes keep those keys.

Columns that are nested already are taken apart by built-in expressions in one
pass; JSON of drifting form goes through the same automaton in Python.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A member of a record that has children, and theirs.
Members = Mapping[str, "Members"]

#: The state of what is no child.
NONE = "null"

NODE = "record_key string, child_path string, ordinals string, parent_ordinals string, variant string, payload string"


# ---- nested columns ----


def _kind(col: Column, of: T.DataType) -> Column:
    """How a member with children is filled."""
    if isinstance(of, T.ArrayType):
        return F.when(col.isNull(), "null").when(F.size(col) == 0, "empty").otherwise("list")
    return F.when(col.isNull(), "null").otherwise("one")


def state(col: Column, of: T.DataType, children: Members | None = None) -> Column:
    """The automaton's state of a value, from the states of its parts."""
    if isinstance(of, T.StructType):
        parts = []
        for f in of.fields:
            inner = _kind(col[f.name], f.dataType) if children and f.name in children else state(col[f.name], f.dataType)
            parts.append((f.name, F.when(col[f.name].isNotNull(), F.concat(F.lit(f"{f.name}:"), inner))))
        out = F.concat(F.lit("{"), F.array_join(F.array(*(p for _, p in sorted(parts, key=lambda x: x[0]))), ","), F.lit("}"))
    elif isinstance(of, T.ArrayType):
        each = F.array_sort(F.array_distinct(F.transform(col, lambda x: state(x, of.elementType))))
        out = F.concat(F.lit("["), F.array_join(each, "|"), F.lit("]"))
    else:
        out = F.lit({"string": "str", "boolean": "bool"}.get(of.typeName(), "num" if isinstance(of, T.NumericType) else of.typeName()))
    return F.when(col.isNull(), "null").otherwise(out)


def _bare(col: Column, of: T.DataType, children: Members) -> Column:
    if isinstance(of, T.StructType):
        kept = [f.name for f in of.fields if f.name not in children]
        return F.to_json(F.struct(*(col[n].alias(n) for n in kept))) if kept else F.lit("{}")
    return F.to_json(F.array(col)).substr(F.lit(2), F.length(F.to_json(F.array(col))) - 2)


def _nodes(col: Column, of: T.DataType, path: str, before: Column | None, children: Members) -> Column:
    """The children in ``col`` and all below them, as an array of node structs."""
    element = of.elementType if isinstance(of, T.ArrayType) else of
    many = col if isinstance(of, T.ArrayType) else F.when(col.isNotNull(), F.array(col))

    def one(x: Column, i: Column) -> Column:
        place = i.cast("string") if before is None else F.concat(before, F.lit("."), i.cast("string"))
        shape = state(x, element, children)
        own = F.struct(F.lit(path).alias("child_path"), place.alias("ordinals"), (before if before is not None else F.lit(None).cast("string")).alias("parent_ordinals"), shape.alias("variant"), _bare(x, element, children).alias("payload"))
        below = [_nodes(x[name], element[name].dataType, f"{path}.{name}", place, more) for name, more in children.items() if isinstance(element, T.StructType) and name in element.names]
        return F.when(shape != NONE, F.concat(F.array(own), *below) if below else F.array(own)).otherwise(F.array().cast(f"array<struct<{_FIELDS}>>"))

    return F.coalesce(F.flatten(F.transform(many, one)), F.array().cast(f"array<struct<{_FIELDS}>>"))


_FIELDS = "child_path:string,ordinals:string,parent_ordinals:string,variant:string,payload:string"


def shred_columns(df: DataFrame, key: str, members: Members) -> DataFrame:
    """Node rows of the nested columns ``members`` of ``df``; see ``NODE``.

    One row for each child that is not null, distinct; null elements keep their
    position, null and empty arrays have no children, a struct in place of an
    array is its only child at 0.  Rows of a null key are left out, other
    columns ignored.
    """
    nodes = F.concat(*(_nodes(F.col(m), df.schema[m].dataType, m, None, more) for m, more in members.items()))
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("record_key"), F.explode(nodes).alias("node"))
    return rows.select("record_key", "node.*").distinct()


# ---- JSON ----


def _decoded(value: object) -> object:
    """JSON held in a string is what it encodes."""
    while isinstance(value, str):
        text = value.strip()
        if text[:1] not in ("{", "[", '"') and text != "null":
            return value
        try:
            value = json.loads(text)
        except (ValueError, RecursionError):
            return value
    return value


def _state(value: object, children: Members | None = None) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, (int, float)):
        return "num"
    if isinstance(value, str):
        return "str"
    if isinstance(value, list):
        return f"[{'|'.join(sorted({_state(x) for x in value}))}]"
    parts = []
    for name in sorted(value):
        part = value[name]
        if part is None:
            continue
        if children and name in children:
            part = _decoded(part)
            parts.append(f"{name}:{'null' if part is None else ('list' if part else 'empty') if isinstance(part, list) else 'one'}")
        else:
            parts.append(f"{name}:{_state(part)}")
    return "{" + ",".join(parts) + "}"


def _walk(value: object, path: str, before: str | None, children: Members) -> Iterator[tuple]:
    value = _decoded(value)
    for i, x in enumerate(value if isinstance(value, list) else [value]):
        x = _decoded(x)
        shape = _state(x, children)
        if shape == NONE:
            continue
        place = str(i) if before is None else f"{before}.{i}"
        bare = {k: v for k, v in x.items() if k not in children} if isinstance(x, dict) else x
        yield path, place, before, shape, json.dumps(bare, ensure_ascii=False)
        if isinstance(x, dict):
            for name, more in children.items():
                if name in x:
                    yield from _walk(x[name], f"{path}.{name}", place, more)


def children_of(body: str | None, members: Members, wrapper: str = "record") -> list[tuple]:
    """The nodes of one JSON record; none for a body that can't be read."""
    if body is None:
        return []
    try:
        record = json.loads(body)
        record = _decoded(record)
        while True:
            if isinstance(record, list) and len(record) == 1:
                record = _decoded(record[0])
            elif isinstance(record, dict) and wrapper in record and not any(m in record for m in members):
                record = _decoded(record[wrapper])
            else:
                break
        if not isinstance(record, dict):
            return []
        return [node for m, more in members.items() if m in record for node in _walk(record[m], m, None, more)]
    except (ValueError, RecursionError):
        return []


def shred_json(df: DataFrame, key: str, body: str, members: Members, wrapper: str = "record") -> DataFrame:
    """Node rows of the JSON records in ``body``; see ``NODE``.

    As ``shred_columns``; besides, a lone value in place of an array is an array
    of one, JSON in a string is what it encodes, and the record may lie under
    ``wrapper`` or in an array of one.  A null or unreadable body has no children.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for k, text in zip(batch.column("record_key").to_pylist(), batch.column("body").to_pylist()):
                out += [(k, *node) for node in children_of(text, members, wrapper)]
            columns = list(zip(*out)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=[f.split()[0] for f in NODE.split(", ")])

    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("record_key"), F.col(body).alias("body"))
    return rows.mapInArrow(run, NODE).distinct()


def subtype_of(variant: Column) -> Column:
    """Where a child's state sends it: object, list, str, num or bool; null for the state of what is no child."""
    return F.when(variant.startswith("{"), "object").when(variant.startswith("["), "list").when(variant != NONE, variant)


def routed(nodes: DataFrame) -> DataFrame:
    """The supertype table: ``nodes`` with the ``subtype`` that their states send them to."""
    return nodes.withColumn("subtype", subtype_of(F.col("variant"))).where("subtype IS NOT NULL")


def subtype(nodes: DataFrame, path: str, schema: str, lone: str | None = None, lone_as: str = "str") -> DataFrame:
    """The typed table of a path's objects: the supertype's keys and the payload's members.

    Children in the state ``lone_as`` (a bare text in place of an object) are
    rows with their value as the member ``lone``, if that is given.  Children of
    other states belong to other subtypes; see ``rest``.
    """
    mine = routed(nodes).where(F.col("child_path") == path)
    whole = F.when(F.col("subtype") == "object", F.col("payload"))
    if lone:
        whole = F.when(F.col("subtype") == lone_as, F.concat(F.lit(f'{{"{lone}":'), F.col("payload"), F.lit("}"))).otherwise(whole)
    rows = mine.withColumn("_whole", whole).where("_whole IS NOT NULL")
    return rows.select("record_key", "ordinals", "parent_ordinals", "variant", F.from_json("_whole", schema).alias("typed")).select("record_key", "ordinals", "parent_ordinals", "variant", "typed.*")


def rest(nodes: DataFrame, path: str, *taken: str) -> DataFrame:
    """(record_key, ordinals, parent_ordinals, variant, subtype, payload): the children of a path of all other subtypes."""
    return routed(nodes).where((F.col("child_path") == path) & ~F.col("subtype").isin(*taken)).select("record_key", "ordinals", "parent_ordinals", "variant", "subtype", "payload")


def variants(nodes: DataFrame) -> DataFrame:
    """How many children of each path have each shape."""
    return nodes.groupBy("child_path", "variant").agg(F.count("*").alias("children"))
