"""Nested JSON records to related flat tables.

A record column holds one JSON object per row. The operator

* repairs what can be read completely (byte order mark, a record encoded a second time as a JSON
  string); a cut record yields no rows,
* infers one merged schema over every row (a single pass, merged per path before the shuffle),
* flattens each array level into a child table that carries the record's key, the parent's
  surrogate key (the parent's path), the array ordinal and the element itself as VARIANT.

Defined results: a null, blank, damaged or non-object record has no rows; null elements and
strings inside arrays are no rows but keep their position; an empty table gives empty tables;
repeated records count once; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys whose value may be one object where an array of objects is meant.
LONE_ARRAYS = ("allegati", "membri", "destinatari", "destinatari_completi", "copia_completa", "rispondi_a")


@dataclass
class Node:
    """One path of the merged schema: the kinds seen there, its keys and its array elements."""

    kinds: set[str] = field(default_factory=set)
    keys: dict[str, Node] = field(default_factory=dict)
    item: Node | None = None

    def holds_rows(self) -> bool:
        """True where some array with objects lies at or under this path."""
        return self.item is not None or any(k.holds_rows() for k in self.keys.values())


def _load(text: str | None):
    """The record as an object, or None where no complete one can be read."""
    if not text:
        return None
    try:
        value = json.loads(text.lstrip("\ufeff \t\r\n"))
        if isinstance(value, str):
            value = json.loads(value.lstrip("\ufeff \t\r\n"))
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


def _paths(value, at: tuple[str, ...], lone: frozenset[str], out: set[tuple[str, str]]) -> None:
    for key, v in value.items():
        path = (*at, key)
        if isinstance(v, dict):
            if key in lone:
                out.add(("\x1f".join((*path, "[]")), "object"))
                _paths(v, (*path, "[]"), lone, out)
            else:
                out.add(("\x1f".join(path), "object"))
                _paths(v, path, lone, out)
        elif isinstance(v, list):
            out.add(("\x1f".join(path), "array"))
            _items(v, (*path, "[]"), lone, out)
        else:
            out.add(("\x1f".join(path), type(v).__name__))


def _items(values: list, at: tuple[str, ...], lone: frozenset[str], out: set[tuple[str, str]]) -> None:
    for v in values:
        if isinstance(v, dict):
            out.add(("\x1f".join(at), "object"))
            _paths(v, at, lone, out)
        elif isinstance(v, list):
            out.add(("\x1f".join(at), "array"))
            _items(v, (*at, "[]"), lone, out)
        else:
            out.add(("\x1f".join(at), type(v).__name__))


def infer_schema(df: DataFrame, column: str = "record", lone: Iterable[str] = LONE_ARRAYS) -> Node:
    """The merged schema of every record.

    Each task merges its own records and emits its distinct (path, kind) pairs, so what is shuffled
    and collected is bounded by the schema, not by the rows.
    """
    named = frozenset(lone)

    def merge(batches: Iterator) -> Iterator:
        import pandas as pd

        seen: set[tuple[str, str]] = set()
        for batch in batches:
            for text in batch[column]:
                if (value := _load(text)) is not None:
                    _paths(value, (), named, seen)
        yield pd.DataFrame(sorted(seen), columns=["path", "kind"])

    pairs = df.select(F.col(column).cast("string").alias(column)).mapInPandas(merge, "path string, kind string").distinct().collect()
    root = Node({"object"})
    for row in sorted(pairs):
        at = root
        for part in row.path.split("\x1f"):
            if part == "[]":
                at.item = at.item or Node()
                at = at.item
            else:
                at = at.keys.setdefault(part, Node())
        at.kinds.add(row.kind)
    return root


def readable(column: str = "record") -> Column:
    """The record as a VARIANT object, or null where no complete object can be read."""
    text = F.regexp_replace(F.col(column).cast("string"), r"^[\x{FEFF}\s]+", "")
    value = F.try_parse_json(text)
    # a record encoded a second time is a JSON string of JSON
    inner = F.try_parse_json(F.regexp_replace(F.try_variant_get(value, "$", "string"), r"^[\x{FEFF}\s]+", ""))
    return F.when(text.startswith("{"), value).when(text.startswith('"'), inner)


_NODE = "array<struct<table:string,parent_path:string,node_path:string,ordinal:int,element:variant>>"


def _key(v: Column, key: str) -> Column:
    if re.fullmatch(r"[\w .:+-]+", key):
        return F.try_variant_get(v, f"$['{key}']", "variant")
    # a key that no path can quote is looked up in the object itself
    return F.try_element_at(F.try_variant_get(v, "$", "map<string,variant>"), F.lit(key))


def _under(v: Column, path: Column, node: Node, table: str, parent: Column, lone: frozenset[str]) -> list[Column]:
    """Arrays of rows found in object ``v`` at ``path``."""
    out = []
    for key, sub in sorted(node.keys.items()):
        if not sub.holds_rows():
            continue
        here = F.concat(path, F.lit("/" + key)) if table else F.lit(key)
        child = _key(v, key)
        name = f"{table}_{key}" if table else key
        if sub.item is not None:
            items = F.try_variant_get(child, "$", "array<variant>")
            if key in lone:
                items = F.coalesce(items, F.when(F.try_variant_get(child, "$", "map<string,variant>").isNotNull(), F.array(child)))
            out.append(_elements(items, here, sub.item, name, parent, lone))
        if sub.keys:
            out.extend(_under(child, here, sub, name, parent, lone))
    return out


def _elements(items: Column, here: Column, node: Node, name: str, parent: Column, lone: frozenset[str]) -> Column:
    def rows(v: Column, i: Column) -> Column:
        path = F.concat(here, F.lit("/"), (i + 1).cast("string"))
        found = []
        if "object" in node.kinds:
            row = F.struct(F.lit(name).alias("table"), parent.alias("parent_path"), path.alias("node_path"), (i + 1).alias("ordinal"), v.alias("element"))
            found.append(F.when(F.try_variant_get(v, "$", "map<string,variant>").isNotNull(), F.array(row)).otherwise(F.array().cast(_NODE)))
            found.extend(_under(v, path, node, name, path, lone))
        if node.item is not None:
            found.append(_elements(F.try_variant_get(v, "$", "array<variant>"), path, node.item, name + "_item", parent, lone))
        if not found:
            return F.array().cast(_NODE)
        return found[0] if len(found) == 1 else F.concat(*found)

    empty = F.array().cast(_NODE)
    return F.coalesce(F.flatten(F.transform(items, rows)), empty)


def nodes(df: DataFrame, key: str = "id", column: str = "record", schema: Node | None = None, lone: Iterable[str] = LONE_ARRAYS) -> DataFrame:
    """Every object that is an array element: key, table, parent_path, node_path, ordinal, element.

    One scan, one parse and one explode, however many array levels the schema has. ``node_path`` is
    the surrogate key of a row within its record; ``parent_path`` is the one of the enclosing row,
    empty for children of the record itself.
    """
    named = frozenset(lone)
    schema = schema or infer_schema(df, column, named)
    parts = _under(F.col("_v"), F.lit(""), schema, "", F.lit(""), named)
    base = df.select(F.col(key).alias("id"), readable(column).alias("_v")).where(F.col("_v").isNotNull())
    rows = F.array().cast(_NODE) if not parts else parts[0] if len(parts) == 1 else F.concat(*parts)
    return base.select("id", F.inline(rows))


def child_tables(df: DataFrame, key: str = "id", column: str = "record", lone: Iterable[str] = LONE_ARRAYS) -> dict[str, DataFrame]:
    """One flat DataFrame for each array level, named by its path, plus ``record`` for the root.

    Columns: id, parent_path, node_path, ordinal, then one string column for each scalar or nested
    object field of the merged schema (nested arrays live in their own child tables).
    """
    named = frozenset(lone)
    schema = infer_schema(df, column, named)
    out: dict[str, DataFrame] = {}
    all_nodes = nodes(df, key, column, schema, named)

    def fields(node: Node, v: Column, prefix: str = "f") -> list[Column]:
        cols = []
        for k, sub in sorted(node.keys.items()):
            name = f"{prefix}_{k}"
            if sub.keys and sub.item is None:
                cols += fields(sub, _key(v, k), name)
            elif sub.item is None or sub.kinds - {"array", "NoneType"}:
                cols.append(F.try_variant_get(_key(v, k), "$", "string").alias(name))
        return cols

    def visit(node: Node, table: str) -> None:
        for k, sub in sorted(node.keys.items()):
            name = f"{table}_{k}" if table else k
            level(sub, name)
            visit(sub, name)

    def level(sub: Node, name: str) -> None:
        if sub.item is not None:
            if "object" in sub.item.kinds:
                rows = all_nodes.where(F.col("table") == name)
                out[name] = rows.select("id", "parent_path", "node_path", "ordinal", *fields(sub.item, F.col("element")))
            visit(sub.item, name)
            level(sub.item, name + "_item")

    base = df.select(F.col(key).alias("id"), readable(column).alias("element")).where(F.col("element").isNotNull())
    out["record"] = base.select("id", *fields(schema, F.col("element")))
    visit(schema, "")
    return out


def found(df: DataFrame, key: str = "id", column: str = "record") -> DataFrame:
    """(id, node_path) of every object inside an array; repeated rows of a record count once."""
    return nodes(df, key, column).select("id", "node_path").distinct()
