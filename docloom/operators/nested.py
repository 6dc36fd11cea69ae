"""Deeply nested records as flat node tables linked by interval containment.

Every node gets two numbers from one depth-first walk: ``pre`` when it is entered, ``post`` when it
is left.  Node B lies in node A exactly if ``A.pre < B.pre and B.post < A.post``, so the parent is
the containing node entered last, and whole subtrees are ranges; no path needs to be compared.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys through which objects and strings of ``sections`` are reached.
SECTION_KEYS = ("heading", "title", "label", "text", "content", "items", "children", "links", "rows")
_ATTRIBUTES = SECTION_KEYS[:5]
_TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?|true|false|null))')


def _refuse(name: str) -> Any:
    raise ValueError(name)


def _deep_loads(text: str) -> Any:
    """JSON without recursion, for documents nested deeper than the parser's stack."""
    end = len(text.rstrip(" \t\n\r"))
    at, root, have, stack = 0, None, False, []
    key, expect = None, "value"
    while at < end:
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"bad token at {at}")
        at, mark = m.end(), m[1]
        if mark == "," and stack and expect == "after":
            expect = "key" if isinstance(stack[-1][0], dict) else "value"
            continue
        if mark == ":" and expect == "colon":
            expect = "value"
            continue
        if mark in ("}", "]") and stack and expect in ("after", "first") and (mark == "}") == isinstance(stack[-1][0], dict):
            _, key = stack.pop()
            expect = "after"
            continue
        if expect in ("key", "first") and stack and isinstance(stack[-1][0], dict):
            if not m[2]:
                raise ValueError(f"no key at {at}")
            key, expect = json.loads(m[2]), "colon"
            continue
        if expect not in ("value", "first") or have and not stack or mark in (",", ":", "}", "]"):
            raise ValueError(f"unexpected at {at}")
        value: Any = {} if mark == "{" else [] if mark == "[" else json.loads(m[2] or m[3])
        if not stack:
            root, have = value, True
        elif isinstance(stack[-1][0], dict):
            stack[-1][0][key] = value
        else:
            stack[-1][0].append(value)
        if mark:
            stack.append((value, key))
            expect = "first"
        else:
            expect = "after"
    if stack or not have:
        raise ValueError("ends early")
    return root


def whole_object(body: str | None) -> dict | None:
    """The JSON object a body holds, perhaps after a byte-order mark or wrapped once more as a string; else None."""
    if body is None:
        return None
    value: Any = body
    for _ in range(2):
        if not isinstance(value, str):
            break
        text = value.strip(" \t\r\n").lstrip("\ufeff")
        try:
            value = json.loads(text, parse_constant=_refuse)
        except RecursionError:
            try:
                value = _deep_loads(text)
            except ValueError:
                return None
        except ValueError:
            return None
    return value if isinstance(value, dict) else None


Node = tuple[str, int, int, int, int, str, str, str | None, str | None]


def _attributes(value: Any) -> tuple[str | None, str | None]:
    """An object's own text (its attribute strings, line by line) and its remaining scalars as JSON."""
    if isinstance(value, str):
        return value, None
    texts = [value[k] for k in _ATTRIBUTES if isinstance(value.get(k), str)]
    rest = {k: v for k, v in value.items() if not isinstance(v, dict | list) and not (k in _ATTRIBUTES and isinstance(v, str)) and v is not None}
    return "\n".join(texts) if texts else None, json.dumps(rest, ensure_ascii=False, sort_keys=True) if rest else None


def label_nodes(record: dict) -> list[Node]:
    """(type, pre, post, depth, parent_pre, address, parent_address, content, attributes) of a record's nodes in pre-order.

    Walks with its own stack, to any depth.  The type is the key a node was reached through last:
    ``metadata`` (also for the objects directly in it), ``sections``, ``children``, ``items`` ...
    """
    met: list[list] = []  # type, pre, post, address, value
    clock = 0
    meta, sections = record.get("metadata"), record.get("sections")
    # An entry to walk: address, key it was reached through, value, in sections?, stands in an array?; a number leaves that node.
    todo: list = [("sections", "sections", sections, True, False)] if isinstance(sections, dict | list) else []
    if isinstance(meta, dict):
        todo.append(("metadata", "metadata", meta, False, False))
    while todo:
        entry = todo.pop()
        if isinstance(entry, int):
            met[entry][2] = clock
            clock += 1
            continue
        address, kind, value, inside, listed = entry
        if isinstance(value, dict) or isinstance(value, str) and inside and listed:
            todo.append(len(met))
            met.append([kind, clock, -1, address, value])
            clock += 1
        if isinstance(value, dict):
            if inside:
                below = [(f"{address}/{k}", k, v, True, False) for k, v in value.items() if k in SECTION_KEYS and isinstance(v, dict | list)]
            elif kind == address == "metadata":
                below = [(f"{address}/{k}", "metadata_entry", v, False, False) for k, v in value.items() if isinstance(v, dict)]
            else:
                below = []
            todo.extend(reversed(below))
        elif isinstance(value, list):
            todo.extend((f"{address}/{i}", kind, v, True, True) for i, v in reversed([*enumerate(value)]) if isinstance(v, dict | list | str))
    # Parents by containment alone: the last node entered before that is left after.
    out: list[Node] = []
    open_at: list[int] = []
    for kind, pre, post, address, value in met:
        while open_at and met[open_at[-1]][2] < pre:
            open_at.pop()
        above = met[open_at[-1]] if open_at else None
        out.append((kind, pre, post, len(open_at), above[1] if above else -1, address, above[3] if above else "", *_attributes(value)))
        open_at.append(len(out) - 1)
    return out


_SCHEMA = "raw_id long, node_type string, pre long, post long, depth int, parent_pre long, node_address string, parent_address string, content string, attributes string"
_ARROW = pa.schema([("raw_id", pa.int64()), ("node_type", pa.string()), ("pre", pa.int64()), ("post", pa.int64()), ("depth", pa.int32()), ("parent_pre", pa.int64()), ("node_address", pa.string()), ("parent_address", pa.string()), ("content", pa.string()), ("attributes", pa.string())])


def _label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    clean = lambda s: None if s is None else s.encode("utf-8", "replace").decode()  # noqa: E731  lone surrogates cannot be stored
    for batch in batches:
        rows: list[tuple] = []
        for raw_id, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if (record := whole_object(body)) is not None:
                rows += [(raw_id, kind, pre, post, depth, up, clean(address), clean(above), clean(content), clean(rest)) for kind, pre, post, depth, up, address, above, content, rest in label_nodes(record)]
            if len(rows) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def node_table(raw: DataFrame, id_column: str = "raw_id", body_column: str = "body") -> DataFrame:
    """One row per node of every whole JSON body, with its interval (pre, post) and its parent's.

    No shuffle: a record is walked where it is read.  Damaged, null and empty bodies, and bodies that
    are no objects, give no rows; ``parent_address`` is '' and ``parent_pre`` -1 at the top.  Rows with
    a null id are kept out; other columns are ignored; an empty table gives no rows.  Rows that repeat
    an id give that id's nodes once for each row, as intervals would otherwise mix.
    """
    rows = raw.select(F.col(id_column).cast("long").alias("raw_id"), F.col(body_column).cast("string").alias("body")).where("raw_id is not null and body is not null")
    return rows.mapInArrow(_label, _SCHEMA)


def type_tables(nodes: DataFrame, types: tuple[str, ...] = ("metadata", "metadata_entry", "sections", *SECTION_KEYS)) -> dict[str, DataFrame]:
    """A flat table per node type, each row with its own and its parent's interval start."""
    return {t: nodes.where(F.col("node_type") == t).drop("node_type") for t in types}


def contained(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """Pairs (raw_id, outer_address, inner_address) of nodes at any depth below others, by interval containment."""
    a, b = outer.select("raw_id", F.col("pre").alias("a_pre"), F.col("post").alias("a_post"), F.col("node_address").alias("outer_address")), inner.select("raw_id", "pre", "post", F.col("node_address").alias("inner_address"))
    return a.join(b, "raw_id").where("a_pre < pre and post < a_post").select("raw_id", "outer_address", "inner_address")
