"""Deeply nested records to flat tables, by columnar shredding.

A document is taken apart along a schema of leaf paths. Every leaf becomes a column of (repetition level, definition
level, value) entries: the repetition level says which repeated ancestor starts anew with the entry, the definition
level how many optional or repeated ancestors are there. Tables are put together again from the level sequences alone:
the ordinal of a repeated ancestor is the number of entries so far that repeat at its depth or above.

Each document is shredded where it lies, in one pass without a shuffle; a document is never split, nor its pieces
gathered elsewhere.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.engine.batches import keyed, restored

LEVELS = "path string, ordinal bigint, repetition int, definition int, value string"
FLAT = "entity string, parent_pos bigint, pos bigint, value string"


@dataclass(frozen=True)
class Node:
    """A member of an object. kind: ``group`` optional object, ``list`` repeated, ``leaf`` any value.

    ``names`` are paths to try in order: the first that holds something counts. ``single`` says what stands for a list
    that the document gives as a lone object: its only element.
    """

    kind: str
    names: tuple[str, ...]
    children: tuple[Node, ...] = ()
    path: str = ""


def decoded(x):
    """The value that a member given as JSON text encodes, however often it was encoded; other text stays."""
    at = x
    while isinstance(at, str):
        t = at.strip().lstrip("\ufeff")
        if not t.startswith(("{", "[", '"')) and t != "null":
            return x
        try:
            at = json.loads(t)
        except (ValueError, RecursionError):
            return x
    return at


def parsed(doc) -> dict | None:
    """The object of a document, without a byte-order mark; None for null, blank, cut or other text."""
    if not isinstance(doc, str):
        return None
    try:
        x = decoded(json.loads(doc.lstrip("﻿")))
    except (ValueError, RecursionError):
        return None
    return x if isinstance(x, dict) else None


def member(x, names: tuple[str, ...]):
    """The member at the first of the dotted paths that is there and not null."""
    for name in names:
        at = x
        for part in name.split(".") if name else ():
            at = decoded(at.get(part)) if isinstance(at, dict) else None
        if at is not None:
            return at
    return None


def elements(x) -> list:
    """The elements of a repeated member; an object in place of an array is its only element, anything else none."""
    return x if isinstance(x, list) else [x] if isinstance(x, dict) else []


def leaves(node: Node, above: str = "") -> list[tuple[str, Node]]:
    path = f"{above}.{node.path or node.names[0]}".strip(".")
    return [(path, node)] if node.kind == "leaf" else [x for c in node.children for x in leaves(c, path)]


def shred(x, root: Node) -> dict[str, list[tuple[int, int, object]]]:
    """Entries (repetition, definition, value) of each leaf path of ``root`` in one document."""
    out: dict[str, list] = {path: [] for path, _ in leaves(root)}

    def missing(node: Node, path: str, r: int, d: int) -> None:
        for p, _ in leaves(node, path):
            out[p].append((r, d, None))

    def walk(node: Node, value, above: str, r: int, d: int, depth: int) -> None:
        path = f"{above}.{node.path or node.names[0]}".strip(".")
        if node.kind == "leaf":
            out[path].append((r, d + (value is not None), value))
        elif node.kind == "group":
            if not isinstance(value, dict):
                missing(node, above, r, d)
                return
            for c in node.children:
                walk(c, member(value, c.names), path, r, d + 1, depth)
        else:
            items = elements(value)
            if not items:
                missing(node, above, r, d)
            for i, item in enumerate(items):
                item, again = decoded(item) if isinstance(item, str) else item, r if i == 0 else depth + 1
                for c in node.children:
                    walk(c, item if c.names == ("",) else member(item, c.names), path, again, d + 1, depth + 1)

    walk(root, x, "", 0, 0, 0)
    return out


def places(entries: list[tuple[int, int, object]], depth: int) -> Iterator[tuple[tuple[int, ...], int, int, object]]:
    """(ordinals of the repeated ancestors, repetition, definition, value), from the level sequence alone."""
    at = [0] * (depth + 1)
    for r, d, value in entries:
        if r == 0:
            at = [0] + [1] * depth
        else:
            at[r] += 1
            at[r + 1 :] = [1] * (depth - r)
        yield tuple(at[1:]), r, d, value


@dataclass(frozen=True)
class Table:
    """A flat table of one repeated ancestor: read from the leaf ``path`` below ``depth`` repeated ancestors; an entry
    is a row when its definition level is at least ``defined`` (1 more when null elements are no rows). ``deeper`` is the
    depth the leaf itself lies below; entries that only repeat deeper belong to the same row. ``parent`` of the row is
    the ordinal of the ancestor above, ``root`` when there is none."""

    entity: str
    path: str
    depth: int
    defined: int
    root: tuple[int, int] = (0, 1)
    levels: int = 0


def assemble(columns: dict[str, list], tables: tuple[Table, ...]) -> Iterator[tuple[str, int, int, object]]:
    """(entity, parent_pos, pos, value) of every table."""
    for t in tables:
        for at, r, d, value in places(columns[t.path], t.levels or t.depth):
            if r > t.depth or d < t.defined:
                continue
            ords = at[: t.depth]
            yield t.entity, *((ords[-2], ords[-1]) if t.depth >= 2 else (t.root[0], ords[0]) if t.depth else t.root), value


def _shown(v) -> str | None:
    return v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False)


def shred_levels(df: DataFrame, id_col: str, doc_col: str, root: Node) -> DataFrame:
    """The level columns: (id, path, ordinal, repetition, definition, value). Unparsable documents give nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, doc in zip(b["id_"], b["doc_"]):
                if (x := parsed(doc)) is not None:
                    rows += [(key, p, i, r, d, _shown(v)) for p, es in shred(x, root).items() for i, (r, d, v) in enumerate(es, 1)]
            yield pd.DataFrame(rows, columns=["id_", "path", "ordinal", "repetition", "definition", "value"])

    kind = df.schema[id_col].dataType.simpleString()
    return restored(df.select(keyed(id_col), F.col(doc_col).alias("doc_")).mapInPandas(run, f"id_ string, {LEVELS}"), id_col, kind)


def flatten(df: DataFrame, id_col: str, doc_col: str, root: Node, tables: tuple[Table, ...]) -> DataFrame:
    """(id, entity, parent_pos, pos, value): one row per flat record of every table, positions from 1.

    Null, blank, cut and otherwise unparsable documents, and documents that are no objects, give nothing. Null elements
    keep their place but are no rows. Of members named twice the last counts. A document delivered twice gives its rows
    twice; callers that want records count them once. An empty input gives an empty table; other columns of ``df`` play
    no part.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, doc in zip(b["id_"], b["doc_"]):
                if (x := parsed(doc)) is not None:
                    rows += [(key, e, p, q, _shown(v)) for e, p, q, v in assemble(shred(x, root), tables)]
            yield pd.DataFrame(rows, columns=["id_", "entity", "parent_pos", "pos", "value"])

    kind = df.schema[id_col].dataType.simpleString()
    return restored(df.select(keyed(id_col), F.col(doc_col).alias("doc_")).mapInPandas(run, f"id_ string, {FLAT}"), id_col, kind)


def _leaf(*names: str, path: str = "") -> Node:
    return Node("leaf", names, path=path)


#: A plugin call: whom it came from, its data rows, and the progress it is expected to report.
CALL = Node(
    "group",
    ("call",),
    (
        Node("group", ("input.caller",), (_leaf("agent_id"),), "caller"),
        Node("list", ("input.data",), (Node("list", ("rows",), (_leaf("", path="element"),)),), "data"),
        Node(
            "group",
            ("expect.progress", "expect.effects.progress"),
            (
                _leaf("state"),
                Node("list", ("phases",), (_leaf("", path="element"), Node("list", ("active",), (_leaf("", path="element"),)))),
            ),
            "progress",
        ),
    ),
)
CALL_TABLES = (
    Table("caller", "call.caller.agent_id", 0, 3),
    Table("data_row", "call.data.rows.element", 2, 4),
    Table("progress", "call.progress.state", 0, 3),
    Table("phase", "call.progress.phases.element", 1, 4, (1, 1)),
    Table("slot", "call.progress.phases.active.element", 2, 5),
)
