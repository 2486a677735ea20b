"""Deeply nested semi-structured records as related flat tables (problem 4).

Method: each record is stream-parsed into (path, ordinals, value) triples; paths are
grouped by the repeated ancestor they hang on; each group is pivoted into one table whose
key is the record and the ordinals, and whose parent's key is the same without the last.

Records of one source differ in shape, so a ``Shape`` names the repeated levels. At such
a level a list counts its elements from 1, an object whose keys are all numbers has them
as positions, and a single value in place of a list stands at position 1. Elements that
are null or empty count, so positions have gaps wherever nothing was said.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.plans.lineage import cut

_SPACE = re.compile(r"[ \t\n\r]*")
_SCALAR = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?|true|false|null")
_HALF = re.compile("[\ud800-\udfff]")
_CONSTANTS = {"true": "true", "false": "false", "null": None}
#: In place of a value: the object or list at the path has no members.
EMPTY_OBJECT, EMPTY_LIST = object(), object()


class Damaged(ValueError):
    """The text isn't one complete JSON value."""


def events(text: str) -> Iterator[tuple[tuple, object, bool]]:
    """(path, value, is a string) of every leaf, in order, without recursion.

    Path steps are keys (str) and 0-based positions (int). Leaves are scalars as text,
    null as None, and empty containers. Raises Damaged if the text isn't complete.
    """
    i = _SPACE.match(text, 1 if text[:1] == "﻿" else 0).end()
    path: list = []
    kinds: list[str] = []
    expect_value = True
    n = len(text)
    while True:
        if expect_value:
            if i >= n:
                raise Damaged("ends early")
            ch = text[i]
            if ch == "{" or ch == "[":
                i = _SPACE.match(text, i + 1).end()
                close = "}" if ch == "{" else "]"
                if text[i : i + 1] == close:
                    yield tuple(path), EMPTY_OBJECT if ch == "{" else EMPTY_LIST, False
                    i += 1
                    expect_value = False
                else:
                    kinds.append(close)
                    if ch == "[":
                        path.append(0)
                    else:
                        key, i = _key(text, i)
                        path.append(key)
                    continue
            elif ch == '"':
                try:
                    value, i = scanstring(text, i + 1, False)
                except ValueError as e:
                    raise Damaged("string") from e
                yield tuple(path), _whole(value), True
                expect_value = False
            else:
                m = _SCALAR.match(text, i)
                if not m:
                    raise Damaged(f"no value at {i}")
                yield tuple(path), _CONSTANTS.get(m[0], m[0]), False
                i = m.end()
                expect_value = False
        i = _SPACE.match(text, i).end()
        if not kinds:
            if i < n:
                raise Damaged("goes on behind its end")
            return
        ch = text[i : i + 1]
        if ch == ",":
            i = _SPACE.match(text, i + 1).end()
            if kinds[-1] == "]":
                path[-1] += 1
            else:
                path[-1], i = _key(text, i)
            expect_value = True
        elif ch == kinds[-1]:
            kinds.pop()
            path.pop()
            i += 1
        else:
            raise Damaged(f"no comma or end at {i}")


def _whole(s: str) -> str:
    """Half surrogate pairs, which no UTF-8 holds, become U+FFFD."""
    return _HALF.sub("\ufffd", s) if not s.isascii() else s


def _key(text: str, i: int) -> tuple[str, int]:
    if text[i : i + 1] != '"':
        raise Damaged(f"no key at {i}")
    try:
        key, i = scanstring(text, i + 1, False)
    except ValueError as e:
        raise Damaged("key") from e
    i = _SPACE.match(text, i).end()
    if text[i : i + 1] != ":":
        raise Damaged(f"no colon at {i}")
    return key, _SPACE.match(text, i + 1).end()


@dataclass(frozen=True)
class Level:
    """One repeated level: its table, the ordinal's column, and the keys that lead to it from its parent.

    ``value`` is the column of an element that is a scalar; ``columns`` maps the paths
    below an element (dotted) to columns.
    """

    table: str
    ordinal: str
    steps: tuple[str, ...] = ()
    value: str | None = None
    columns: dict[str, str] = field(default_factory=dict)
    children: tuple[Level, ...] = ()


@dataclass(frozen=True)
class Shape:
    """The levels of a record and the keys under which a whole record may be wrapped."""

    levels: tuple[Level, ...]
    wrappers: tuple[str, ...] = ()

    def depth(self) -> int:
        """Path steps down to the deepest level, wrapper included."""
        return 1 + max(sum(len(x.steps) + 1 for x in above) for above, _ in self.tables().values())

    def tables(self) -> dict[str, tuple[tuple[Level, ...], Level]]:
        """Table name -> (the levels above it and itself, itself)."""
        found: dict[str, tuple[tuple[Level, ...], Level]] = {}

        def walk(levels: tuple[Level, ...], above: tuple[Level, ...]) -> None:
            for x in levels:
                found[x.table] = ((*above, x), x)
                walk(x.children, (*above, x))

        walk(self.levels, ())
        return found


def _is_keyed(keys: dict[tuple, bool], path: tuple) -> bool:
    """All keys of the object at ``path`` are numbers."""
    return keys.get(path, False)


def opened(text: str | None) -> list[tuple[tuple, object, bool]]:
    """The leaves of a record; a JSON string that holds JSON is opened, however often it is wrapped. Raises Damaged, with the reason."""
    if not text or text.isspace():
        raise Damaged("empty")
    leaves = list(events(text))
    while len(leaves) == 1 and not leaves[0][0] and leaves[0][2]:
        # What a string holds is shorter than the string, so this ends.
        leaves = list(events(leaves[0][1]))
    return leaves


def triples(text: str | None, shape: Shape) -> list[tuple[str, list[int], str, str | None]]:
    """(table, ordinals, column, value) of a record, in its order; [] if it isn't complete JSON.

    A record that is a JSON string holding JSON, or lies under one of the shape's
    wrapper keys, is opened first. An element without content has one triple with an
    empty column, so that its row exists. Numbers and truth values are kept as text.
    """
    try:
        return _placed(opened(text), shape)
    except Damaged:
        return []


def _placed(leaves: list[tuple[tuple, object, bool]], shape: Shape) -> list[tuple[str, list[int], str, str | None]]:
    tops = {p[0] for p, _, _ in leaves if p}
    for w in shape.wrappers:
        if w in tops and not any(x.steps and x.steps[0] in tops for x in shape.levels):
            inside = [(p[1:], v, s) for p, v, s in leaves if p and p[0] == w]
            if len(inside) == 1 and not inside[0][0] and inside[0][2]:
                return _placed(opened(inside[0][1]), shape)
            leaves = inside
            tops = {p[0] for p, _, _ in leaves if p}
    keyed: dict[tuple, bool] = {}
    deep = shape.depth()
    for p, _, _ in leaves:
        for i, step in enumerate(p[:deep]):
            if isinstance(step, str):
                keyed[p[:i]] = keyed.get(p[:i], True) and step.isdecimal() and step.isascii() and int(step) > 0
    found: list[tuple[str, list[int], str, str | None]] = []

    def place(levels: tuple[Level, ...], path: tuple, at: int, ordinals: list[int], value: object) -> None:
        for x in levels:
            k = len(x.steps)
            if path[at : at + k] != x.steps:
                continue
            here = at + k
            prefix = path[:here]
            if here < len(path) and (isinstance(path[here], int) or _is_keyed(keyed, prefix)):
                step = path[here]
                mine, here = [*ordinals, step + 1 if isinstance(step, int) else int(step)], here + 1
            elif here == len(path) and (value is None or value is EMPTY_LIST or value is EMPTY_OBJECT) and (k or value is not None):
                continue
            else:
                mine = [*ordinals, 1]
            rest = path[here:]
            if not rest and (value is None or value is EMPTY_LIST or value is EMPTY_OBJECT):
                found.append((x.table, mine, "", None))
                continue
            dotted = ".".join(map(str, rest)) if len(rest) <= deep else None
            if not rest and x.value:
                found.append((x.table, mine, x.value, value))
            elif dotted in x.columns and value is not EMPTY_LIST and value is not EMPTY_OBJECT:
                found.append((x.table, mine, x.columns[dotted], value))
            else:
                found.append((x.table, mine, "", None))
                place(x.children, path, here, mine, value)

    for p, v, _ in leaves:
        place(shape.levels, p, 0, [], v)
    return found


def record_triples(df: DataFrame, key: str, text: str, shape: Shape) -> DataFrame:
    """(key, tab, ordinals, col, value, seq) of all records; see ``triples``. A damaged one has a single row of table "" with the reason as value."""
    named = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("t"), F.monotonically_increasing_id().alias("row"))
    kind = named.schema["key"].dataType.simpleString()

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            which: list[int] = []
            rows: list[tuple] = []
            for i, t in enumerate(b.column(1).to_pylist()):
                try:
                    own = _placed(opened(t), shape)
                except Damaged as e:
                    own = [("", [], "", str(e))]
                which += [i] * len(own)
                rows += [(*r, j) for j, r in enumerate(own)]
            at = pa.array(which, pa.int64())
            kinds = (pa.string(), pa.list_(pa.int32()), pa.string(), pa.string(), pa.int32())
            cols = [pa.array([r[i] for r in rows], x) for i, x in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(2).take(at), *cols], names=["key", "row", "tab", "ordinals", "col", "value", "seq"])

    return named.mapInArrow(parse, f"key {kind}, row bigint, tab string, ordinals array<int>, col string, value string, seq int")


def pivot_table(found: DataFrame, key: str, shape: Shape, name: str) -> DataFrame:
    """One flat table: ``key``, the ordinals down to its own, and its columns.

    The parent's key is ``key`` with the ordinals before the last. Where a record has a
    key twice in one object, the later value holds. Records with equal or null keys keep
    rows of their own.
    """
    above, level = shape.tables()[name]
    columns = list(dict.fromkeys([*([level.value] if level.value else []), *level.columns.values()]))
    last = [F.max_by("value", F.when(F.col("col") == c, F.col("seq"))).alias(c) for c in columns] or [F.count(F.lit(1)).alias("_n")]
    rows = found.where(F.col("tab") == name).groupBy("key", "row", "ordinals").agg(*last)
    return rows.select(F.col("key").alias(key), *[F.col("ordinals")[i].alias(x.ordinal) for i, x in enumerate(above)], *columns)


def damaged_records(found: DataFrame, key: str) -> DataFrame:
    """(``key``, problem) of the records that aren't one complete JSON value: "empty", or what is wrong with them."""
    return found.where("tab = ''").select(F.col("key").alias(key), F.col("value").alias("problem"))


def flatten_records(df: DataFrame, key: str, text: str, shape: Shape) -> dict[str, DataFrame]:
    """All tables of the shape from the JSON in ``text``, by name, and under "" the damaged records.

    Each record is parsed once: the triples are written, and all tables are pivoted from
    them. Null, blank, damaged and non-JSON texts have no rows in any table but a reason
    in the one of damaged records; an empty table gives empty tables; columns other than
    ``key`` and ``text`` aren't read.
    """
    return tables_of(cut(record_triples(df, key, text, shape), "triples"), key, shape)


def tables_of(found: DataFrame, key: str, shape: Shape) -> dict[str, DataFrame]:
    """The tables of ``flatten_records`` from written triples."""
    return {name: pivot_table(found, key, shape, name) for name in shape.tables()} | {"": damaged_records(found, key)}


#: The stored responses of the text source: versions > chapters > verses > comments > notes, and sections.
RESPONSE = Shape(
    levels=(
        Level(
            "versions", "ver", ("versions",), None, {"language": "language", "versionTitle": "version_title", "license": "license"},
            (Level("chapters", "c", ("text",), None, {}, (
                Level("verses", "v", (), None, {}, (
                    Level("comments", "i", (), "text", {"text": "text", "id": "comment_id"}, (
                        Level("notes", "n", ("notes",), "text", {"text": "text", "mark": "mark", "by.hand": "by_hand", "by.sure": "by_sure"}),
                    )),
                )),
            )),),
        ),
        Level("sections", "s", ("alts", "Parasha", "nodes"), None, {"title": "title", "wholeRef": "whole_ref"}),
    ),
    wrappers=("data",),
)

# White space of any script, for blank texts.
BLANK = r"^[\s\u0085   -     　]*$"


def spoken(df: DataFrame, key: str, text: str) -> DataFrame:
    """(``key``, ver, c, v, i, n) of comments (n = 0) and notes (n from 1) with a text that isn't blank."""
    found = record_triples(df, key, text, RESPONSE).where("tab in ('comments', 'notes')")
    rows = found.groupBy("key", "row", "tab", "ordinals").agg(F.max_by("value", F.when(F.col("col") == "text", F.col("seq"))).alias("text"))
    at = [F.col("ordinals")[i].alias(c) for i, c in enumerate(("ver", "c", "v", "i"))]
    return rows.where(F.col("text").isNotNull() & ~F.col("text").rlike(BLANK)).select(F.col("key").alias(key), *at, F.when(F.col("tab") == "notes", F.col("ordinals")[4]).otherwise(0).alias("n"))

