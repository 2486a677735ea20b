"""Problem 4 against a recursive brute force, and the parser against the standard library."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexforge.operators import nested

leaf = st.none() | st.booleans() | st.integers(-9, 99) | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=6)
value = st.recursive(leaf, lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=3), x, max_size=3), max_leaves=12)


def leaves(x, path=()):
    if isinstance(x, dict) and x:
        for k, v in x.items():
            yield from leaves(v, (*path, k))
    elif isinstance(x, list) and x:
        for i, v in enumerate(x):
            yield from leaves(v, (*path, i))
    else:
        yield path, x


@settings(max_examples=200, deadline=None)
@given(value, st.booleans())
def test_events_agree_with_json(x, wide):
    text = json.dumps(x, ensure_ascii=wide, indent=1 if wide else None)
    got = list(nested.events(text))
    want = list(leaves(json.loads(text)))
    assert [p for p, _, _ in got] == [p for p, _ in want]
    for (_, v, is_string), (_, w) in zip(got, want):
        if isinstance(w, str):
            assert is_string and v == w
        elif w is None:
            assert v is None
        elif w == {} or w == []:
            assert v in (nested.EMPTY_OBJECT, nested.EMPTY_LIST)
        else:
            assert json.loads(v) == w


@settings(max_examples=100, deadline=None)
@given(value.filter(lambda x: isinstance(x, dict | list)), st.data())
def test_cut_off_texts_are_damaged(x, data):
    text = json.dumps(x)
    with pytest.raises(nested.Damaged):
        list(nested.events(text[: data.draw(st.integers(0, len(text) - 1))]))


def seq(x):
    if x is None or x == {}:
        return []
    if isinstance(x, list):
        return list(enumerate(x, 1))
    if isinstance(x, dict) and all(k.isdecimal() and int(k) > 0 for k in x):
        return [(int(k), v) for k, v in x.items()]
    return [(1, x)]


def brute(text):
    try:
        d = json.loads((text or "").lstrip("﻿"))
        if isinstance(d, str):
            d = json.loads(d)
    except ValueError:
        return set()
    d = d.get("data", d)
    out = set()
    for a, ver in seq(d.get("versions")):
        for c, ch in seq((ver or {}).get("text")):
            for v, vs in seq(ch):
                for i, cm in seq(vs):
                    said = cm if isinstance(cm, str) else (cm or {}).get("text")
                    if said and said.strip():
                        out.add((a, c, v, i, 0))
                    for n, note in seq(cm.get("notes")) if isinstance(cm, dict) else []:
                        said = note if isinstance(note, str) else (note or {}).get("text")
                        if said and said.strip():
                            out.add((a, c, v, i, n))
    return out


def test_found_on_all_responses(spark, tiny):
    df = spark.read.parquet(f"{tiny}/raw_text.parquet")
    got = {(r.raw_id, r.ver, r.c, r.v, r.i, r.n) for r in nested.spoken(df, "raw_id", "text").collect()}
    assert got == {(r.raw_id, *x) for r in df.collect() for x in brute(r.text)} and got


SHAPES = [
    '{"versions":{"text":"x"}}',
    '{"versions":[{"text":[null,["a",{"text":"b","notes":["n",null,{"text":" "},{"text":"m"}]}],[["c",""],"d"]]}]}',
    '{"versions":[{"text":{"3":{"2":["a",{}]}}},{"text":[]},null,{"text":[[{"notes":{"text":"one"}}]]}]}',
    '{"status":"ok","data":{"versions":[{"text":[[["w"]]]}]}}',
    json.dumps('{"versions":[{"text":[[["s"]]]}]}'),
    '﻿ \n{"versions":[{"text":[[["bom"]]]}]}',
    '{"versions":[{"text":[[["half"]]',
    '{"versions":[{"text":[[["x"]]]}]} tail',
    "<html></html>", "", " ", "null", "3", "[]", '{"error":"none"}',
]


def test_odd_shapes(spark):
    rows = [(i, s, "x") for i, s in enumerate(SHAPES)] + [(99, None, None), (None, SHAPES[0], "y"), (0, SHAPES[0], "z")]
    df = spark.createDataFrame(rows, "raw_id bigint, text string, value string")
    got = [(r.raw_id, r.ver, r.c, r.v, r.i, r.n) for r in nested.spoken(df, "raw_id", "text").collect()]
    want = [(i, *x) for i, s, _ in rows if s is not None and s.strip() not in ("null", "3", "[]") for x in brute(s)]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_tables_keep_parents(spark):
    df = spark.createDataFrame([(1, SHAPES[1])], "raw_id bigint, text string")
    t = {k: v.collect() for k, v in nested.flatten_records(df, "raw_id", "text", nested.RESPONSE).items()}
    assert [(r.ver, r.c, r.v, r.i, r.n, r.text) for r in sorted(t["notes"], key=lambda r: r.n) if r.text and r.text.strip()] == [(1, 2, 2, 1, 1, "n"), (1, 2, 2, 1, 4, "m")]
    parents = {(r.raw_id, r.ver, r.c, r.v, r.i) for r in t["comments"]}
    assert {(r.raw_id, r.ver, r.c, r.v, r.i) for r in t["notes"]} <= parents
    assert {(r.raw_id, r.ver, r.c, r.v) for r in t["comments"]} <= {(r.raw_id, r.ver, r.c, r.v) for r in t["verses"]}


def test_empty_table_and_long_text(spark):
    empty = spark.createDataFrame([], "raw_id bigint, text string")
    assert nested.spoken(empty, "raw_id", "text").count() == 0
    long = json.dumps({"versions": [{"text": [[["a" * 2_000_000]] * 3]}]})
    assert nested.spoken(spark.createDataFrame([(1, long), (2, "[" * 100_000)], "raw_id bigint, text string"), "raw_id", "text").count() == 3


def test_records_wrapped_any_number_of_times(spark):
    text = json.dumps({"versions": [{"text": [[["a"]]]}]})
    for _ in range(7):
        text = json.dumps(text)
    wrapped = json.dumps({"data": json.dumps(json.dumps({"versions": [{"text": [[["b"]]]}]}))})
    df = spark.createDataFrame([(1, text), (2, wrapped)], "raw_id bigint, text string")
    assert sorted(r.raw_id for r in nested.spoken(df, "raw_id", "text").collect()) == [1, 2]


def test_damaged_records_are_set_apart(spark):
    rows = [(1, None), (2, " "), (3, '{"versions": ['), (4, "<html>"), (5, "{}"), (6, '"no json"'), (7, "[1] 2"), (None, "{")]
    tables = nested.flatten_records(spark.createDataFrame(rows, "raw_id bigint, text string"), "raw_id", "text", nested.RESPONSE)
    got = {r.raw_id: r.problem for r in tables[""].collect()}
    assert set(got) == {1, 2, 3, 4, 6, 7, None} and got[1] == got[2] == "empty" and got[3] == "ends early" and "behind its end" in got[7]
    assert all(t.count() == 0 for name, t in tables.items() if name)
