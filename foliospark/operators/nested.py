"""Nested JSON responses to flat node tables linked by interval labels.

Every node of a response tree, scalars included, takes two numbers in one depth-first walk: ``pre`` when the walk
enters it and ``post`` when it leaves.  Node *a* lies inside node *b* exactly if ``b.pre < a.pre`` and
``a.post < b.post``.  The walk needs one response at a time, so it runs next to the scan; only the thin node rows are shuffled.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The top-level fields of a response.
RESPONSE_FIELDS = frozenset(["meta", "seller", "buyer", "invoice", "lines", "totals", "warnings", "fullText"])
# Child tables of a response, and where their records sit.
CHILD_TYPES = ("meta", "lines", "fullText", "warnings", "lines.description.alts", "lines.qty.alts")

_SPACE = "\ufeff \t\r\n"


def find_response(payload: str | None) -> dict | None:
    """The complete response in ``payload`` under any wrapping, however deep, or None.

    Wrappers are byte order marks, JSON in JSON strings, arrays, envelope objects, and text around one whole JSON value.  Of
    several responses in one payload the first in the text counts.  A cut-off JSON text holds no complete response, whatever inner part is whole.
    """
    waiting: list[object] = [payload]
    while waiting:
        value = waiting.pop()
        if isinstance(value, str):
            head = value.lstrip(_SPACE)[:1]
            # The payload itself may have text around it; an inner string must be JSON from its first sign on.
            if value is payload or (head and head in '{["' and len(value) > 1):
                inner = _parsed(value)
                if inner is not None and inner != value:
                    waiting.append(inner)
        elif isinstance(value, dict):
            if RESPONSE_FIELDS & value.keys():
                return value
            waiting.extend(reversed([x for x in value.values() if isinstance(x, (dict, list, str))]))
        elif isinstance(value, list):
            waiting.extend(x for x in reversed(value) if isinstance(x, (dict, list, str)))
    return None


def _parsed(text: str) -> object:
    """The JSON value of a text, or the first one whole in it; None if there is none."""
    t = text.lstrip(_SPACE)
    for parse in (json.loads, _leading):
        try:
            return parse(t)
        except ValueError:
            continue
        except RecursionError:
            return _deep(t)
    return None


def _leading(text: str) -> object:
    starts = [i for i in (text.find("{"), text.find("["), text.find('"')) if i >= 0]
    if not starts:
        raise ValueError("no JSON")
    return json.JSONDecoder().raw_decode(text, min(starts))[0]


_SCALAR = re.compile(r'"(?:[^"\\]|\\.)*"|-?\d[\d.eE+-]*|true|false|null|NaN|-?Infinity', re.S)


def _deep(text: str) -> object:
    """A JSON value nested beyond the parser's recursion, read with a stack of its own; None if it is cut off or malformed."""
    start = min((i for i in (text.find("{"), text.find("[")) if i >= 0), default=len(text))
    stack: list[tuple[object, str | None]] = []
    at, key = start, None
    done: object = None
    while at < len(text):
        c = text[at]
        if c in " \t\r\n,:":
            at += 1
            continue
        if c in "{[":
            stack.append(({} if c == "{" else [], key))
            key, at = None, at + 1
            continue
        if c in "}]":
            if not stack or isinstance(stack[-1][0], dict) != (c == "}"):
                return None
            value, own = stack.pop()
            at += 1
            if not stack:
                done = value
                break
        else:
            m = _SCALAR.match(text, at)
            if not m or not stack:
                return None
            at = m.end()
            try:
                value = json.loads(m[0])
            except ValueError:
                return None
            if isinstance(stack[-1][0], dict) and key is None:
                key = value if isinstance(value, str) else str(value)
                continue
            own = key
        holder = stack[-1][0]
        if isinstance(holder, dict):
            holder[own] = value
        else:
            holder.append(value)
        key = None
    return done


def _real(value: object) -> bool:
    """Nulls and empty objects or arrays are no records."""
    return value is not None and value != {} and value != []


class _Walk:
    """One depth-first walk that labels every node and notes the records of the child tables."""

    def __init__(self) -> None:
        self.clock, self.rows = 0, []

    def skip(self, value: object) -> tuple[int, int]:
        """Labels a subtree that holds no records: two steps a node.  Its interval."""
        stack, n, pre = [value], 0, self.clock
        while stack:
            x = stack.pop()
            n += 1
            if x.__class__ is list:
                stack.extend(x)
            elif x.__class__ is dict:
                stack.extend(x.values())
        self.clock += 2 * n
        return pre, self.clock - 1

    def note(self, kind: str, span: tuple[int, int], parent: int, depth: int, pos: int) -> None:
        self.rows.append([kind, *span, parent, depth, pos, -1, None])

    def children(self, value: object, kind: str, parent: int, depth: int) -> None:
        """An array of records, or one record standing for it."""
        is_array = isinstance(value, list)
        if is_array:
            parent, depth = self.clock, depth + 1
            self.clock += 1
        for pos, x in enumerate(value if is_array else [value]):
            if kind == "lines" and isinstance(x, dict):
                self.line(x, parent, depth, pos)
            else:
                span = self.skip(x)
                if _real(x):
                    self.note(kind, span, parent, depth, pos)
        self.clock += is_array

    def line(self, record: dict, parent: int, depth: int, pos: int) -> None:
        pre = self.clock
        self.clock += 1
        for key, value in record.items():
            if key in ("description", "qty") and isinstance(value, dict):
                at = self.clock
                self.clock += 1
                for inner, x in value.items():
                    if inner == "alts":
                        self.children(x, f"lines.{key}.alts", at, depth + 2)
                    else:
                        self.skip(x)
                self.clock += 1
            else:
                self.skip(value)
        if record:
            self.note("lines", (pre, self.clock), parent, depth, pos)
        self.clock += 1

    def response(self, doc: dict) -> list[list]:
        self.clock += 1
        for key, value in doc.items():
            if key in ("lines", "fullText", "warnings"):
                self.children(value, key, 0, 1)
            else:
                span = self.skip(value)
                one = value[0] if key == "meta" and isinstance(value, list) and value else value
                if key == "meta" and _real(one):
                    self.note("meta", span, 0, 1, 0)
        self.note("response", (0, self.clock), -1, 0, 0)
        return link_lines(self.rows)


def walk_all(doc: dict) -> list[list]:
    """As ``_Walk.response``, with a row for every object and array, and the node's own scalars as JSON in its body.

    A type is the path of keys to a node; an array's ends in ``[]``, and its elements take the array's path without it if they are records of a child table.  Scalars take
    numbers but no row, unless they are records.
    """
    rows: list[list] = []
    clock = 0
    stack: list[tuple] = [(doc, "response", "", -1, 0, 0)]
    while stack:
        value, kind, path, parent, depth, pos = stack.pop()
        if kind is None:
            value[2] = clock
            clock += 1
            continue
        pre, clock = clock, clock + 1
        if isinstance(value, (dict, list)):
            items = list(value.items()) if isinstance(value, dict) else list(enumerate(value))
            own = {k: v for k, v in items if not isinstance(v, (dict, list))} if isinstance(value, dict) else [v for v in value if not isinstance(v, (dict, list))]
            row = [kind, pre, 0, parent, depth, pos, -1, json.dumps(own, ensure_ascii=False, separators=(",", ":")) if own or not items else None]
            if value != {} and value != [] or kind.endswith("[]") or kind == "response":
                rows.append(row)
            stack.append((row, None, "", 0, 0, 0))
            for k, v in reversed(items):
                if isinstance(value, dict):
                    inner = f"{path}.{k}" if path else str(k)
                    stack.append((v, inner + "[]" if isinstance(v, list) else inner, inner if not isinstance(v, list) or inner in CHILD_TYPES else inner + "[]", pre, depth + 1, 0))
                else:
                    stack.append((v, path if path in CHILD_TYPES else path + "[]" if isinstance(v, list) and not path.endswith("[]") else path, path if path not in CHILD_TYPES or isinstance(v, dict) else path + "[]", pre, depth + 1, k))
        else:
            clock += 1
            if value is not None and kind in CHILD_TYPES:
                rows.append([kind, pre, clock - 1, parent, depth, pos, -1, json.dumps(value, ensure_ascii=False)])
    return link_lines(rows)


def link_lines(rows: list[list]) -> list[list]:
    """Gives each alternative reading the index of the line whose interval contains its own."""
    lines = sorted((r[1], r[2], r[5]) for r in rows if r[0] == "lines")
    starts = [x[0] for x in lines]
    for r in rows:
        if r[0].endswith(".alts") and (i := bisect_right(starts, r[1]) - 1) >= 0 and r[2] < lines[i][1]:
            r[6] = lines[i][2]
    return rows


_NODE = "node_type: string, pre: bigint, post: bigint, parent_pre: bigint, depth: int, pos: int, line_pos: int, body: string"
_NODE_TYPES = [("node_type", pa.string()), ("pre", pa.int64()), ("post", pa.int64()), ("parent_pre", pa.int64()), ("depth", pa.int32()), ("pos", pa.int32()), ("line_pos", pa.int32()), ("body", pa.string())]


def label_nodes(responses: DataFrame, with_body: bool = False) -> DataFrame:
    """Node table of ``responses`` (columns ``response_id``, ``payload`` and optionally ``stored_at``; others are ignored).

    One row per response and per record of each child table: its interval ``pre``..``post``, the ``pre`` of the node that
    encloses it, depth, index ``pos`` in its array, and ``line_pos``, the index of the line around an alternative reading.
    ``line_pos`` is found by interval containment.  With ``with_body`` every other object and array has a row too, so that each ``parent_pre`` is a row's ``pre``, and a node's own scalars
    come along as JSON in ``body``; ``node_table`` makes columns of them.

    Rows without ``response_id`` or with a null, empty, cut-off or unreadable payload give no node.  Null and empty elements
    give none but keep their index.  Of rows that share a ``response_id`` the earliest ``stored_at`` counts, ties broken
    by the hash of the payload; identical copies count once.  Very long and very deep payloads are walked whole, iteratively.
    """
    stored = F.coalesce(F.col("stored_at").cast("string"), F.lit("~")) if "stored_at" in responses.columns else F.lit("~")
    src = responses.where("response_id is not null and payload is not null").select(
        F.col("response_id").cast("bigint"), "payload", F.concat_ws("|", stored, F.hex(F.xxhash64("payload"))).alias("copy")
    )

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, payloads, copies = (batch.column(i).to_pylist() for i in range(3))
            out: list[list] = []
            held: list[tuple] = []
            ends = [0]
            for rid, payload, copy in zip(ids, payloads, copies):
                doc = find_response(payload)
                if doc is None:
                    continue
                out.extend(walk_all(doc) if with_body else _Walk().response(doc))
                held.append((rid, copy))
                ends.append(len(out))
                if len(out) > 50_000:
                    yield _batch(held, ends, out)
                    out, held, ends = [], [], [0]
            if held:
                yield _batch(held, ends, out)

    whole = src.mapInArrow(walk, f"response_id bigint, copy string, nodes array<struct<{_NODE}>>")
    # The copy is chosen while a response's nodes are one value.
    once = whole.groupBy("response_id").agg(F.min_by("nodes", "copy").alias("nodes"))
    return once.select("response_id", F.explode("nodes").alias("n")).select("response_id", "n.*")


def _batch(held: list[tuple], ends: list[int], rows: list[list]) -> pa.RecordBatch:
    columns = [pa.array(c, t) for c, (_, t) in zip(zip(*rows), _NODE_TYPES)]
    nodes = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, [n for n, _ in _NODE_TYPES]))
    ids, copies = zip(*held)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(copies, pa.string()), nodes], ["response_id", "copy", "nodes"])


def child_records(nodes: DataFrame) -> DataFrame:
    """``response_id, child, line_pos, pos`` of every child record of a node table."""
    children = F.col("node_type").isin(*CHILD_TYPES) & ((F.col("node_type") != "meta") | (F.col("pos") == 0))
    return nodes.where(children).select("response_id", F.col("node_type").alias("child"), "line_pos", "pos")


def node_table(nodes: DataFrame, node_type: str, columns: str) -> DataFrame:
    """The flat table of one type of a node table with bodies: its labels and links, and ``columns`` (a schema) of its own scalars; absent ones are null."""
    own = nodes.where(F.col("node_type") == node_type)
    return own.select("response_id", "pre", "post", "parent_pre", "pos", "line_pos", F.from_json("body", columns).alias("b")).select("response_id", "pre", "post", "parent_pre", "pos", "line_pos", "b.*")
