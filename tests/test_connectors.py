import json

import pytest
from pyspark.sql import functions as F

from lexforge.operators.ingest import VERSE_SCHEMA, section_join, unnest, with_note
from lexforge.operators.resolve import calendar_names
from lexforge.sources import connectors as C


def put(path, x):
    path.write_text(x if isinstance(x, str) else json.dumps(x, ensure_ascii=False), encoding="utf-8")
    return str(path)


def test_catalogs(spark):
    assert C.catalog(spark).count() == 39 and C.catalog(spark, C.TRACTATES).count() == 37
    assert C.catalog(spark).where("en = 'II Chronicles'").first().he == "דברי הימים ב"
    assert {r.b for r in C.notes(spark).where("from_d is null").collect()} == {"Nedarim", "Nazir"} and dict(C.CONTINUATIONS) == {"Bava Batra": "Rashbam on Bava Batra"}
    places = spark.createDataFrame([("Makkot", 19, 1, None), ("Makkot", 19, 2, None), ("Makkot", 2, 1, 1), ("Nazir", 2, 1, None), ("Tamid", 25, 1, None)], "b string, d int, a int, cx int")
    noted = {(r.b, r.d, r.a): r.note is not None for r in with_note(places, C.notes(spark)).collect()}
    assert noted == {("Makkot", 19, 1): False, ("Makkot", 19, 2): True, ("Makkot", 2, 1): True, ("Nazir", 2, 1): True, ("Tamid", 25, 1): False}


def test_landed_once(spark, tmp_path):
    calls = []
    for _ in range(2):
        path = C.landed(spark, str(tmp_path / "cache"), "a.json", lambda: calls.append(1) or "[1]")
    assert calls == [1] and open(path).read() == "[1]"
    with pytest.raises(ZeroDivisionError):
        C.landed(spark, str(tmp_path / "cache"), "b.json", lambda: str(1 / 0))
    assert not (tmp_path / "cache" / "b.json").exists()


def test_text_and_section_sources(spark, tmp_path):
    text = put(tmp_path / "t.json", {"versions": [{"text": [[["a", "", "b"]], []]}]})
    bad = put(tmp_path / "bad.json", '{"versions":[')
    got = unnest(C.texts(spark, [text, bad]), "text", ("c", "v", "i"), "t")
    assert [tuple(r) for r in got.orderBy("i").collect()] == [(1, 1, 1, "a"), (1, 1, 3, "b")]
    index = put(tmp_path / "i.json", {"alts": {"Parasha": {"nodes": [{"title": "P", "heTitle": "פ", "wholeRef": "Genesis 1:1-6:8"}, {"title": "Q", "wholeRef": "Genesis 7:1-9"}]}}})
    assert [tuple(r) for r in C.sections(spark, index).orderBy("ord_no").collect()] == [("P", "פ", 1, 1, 1, 6, 8), ("Q", None, 2, 7, 1, 7, 9)]


def test_links_skip_damaged_files(spark, tmp_path):
    good, bad = put(tmp_path / "l1.json", [{"anchorRef": "Rashi on Genesis 1:1:1"}, {"x": 1}]), put(tmp_path / "l2.json", "<html>")
    assert [r[0] for r in C.links(spark, [good, bad]).collect()] == ["Rashi on Genesis 1:1:1"]


def test_calendar(spark, tmp_path):
    path = put(tmp_path / "c.json", {"calendar_items": [{"title": {"en": "Parashat Hashavua"}, "displayValue": {"en": "Lech-Lecha"}}, {"title": {"en": "Daf"}, "displayValue": {"en": "x"}}]})
    known = spark.createDataFrame([("lech",), ("Noach",)], "p string")
    assert {tuple(r) for r in calendar_names(C.calendar(spark, path, False), known).collect()} == {("lech", False), ("Lecha", False)}


def test_record_and_report_files(spark, tmp_path):
    rec = put(tmp_path / "r.json", [{"b": "Genesis", "c": 1, "v": 1, "i": 1, "dh": "א", "t": "ב", "vt": "", "lk": 3}])
    df = C.read_records(spark, rec, VERSE_SCHEMA)
    assert df.first().p is None and df.first().lk == 3
    size = C.write_json_array(df.select("b", "dh"), str(tmp_path / "out.json"))
    assert (tmp_path / "out.json").read_text(encoding="utf-8") == '[{"b":"Genesis","dh":"א"}]' and size > 0
    assert C.write_json_array(df.limit(0), str(tmp_path / "x.json")) == 2 and (tmp_path / "x.json").read_text() == "[]"
    many = spark.range(3000).select(F.col("id"), F.lit("ש" * 500).alias("t")).orderBy("id")
    assert C.write_json_array(many, str(tmp_path / "m.json")) == (tmp_path / "m.json").stat().st_size
    assert [r["id"] for r in json.loads((tmp_path / "m.json").read_text(encoding="utf-8"))] == list(range(3000))
    C.write_records(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1
    bad = put(tmp_path / "bad.json", [{"b": "x", "c": "one"}])
    with pytest.raises(Exception):
        C.read_records(spark, bad, VERSE_SCHEMA).collect()


def test_sections_beyond_the_broadcast_bound(spark):
    sections = spark.createDataFrame([("x", n, f"p{n}", f"h{n}", n * 10, 1, n * 10 + 9, 99) for n in range(5)] + [("y", 0, "q", "q", 1, 1, 1, 5)], "b string, ord_no int, p string, ph string, start_c int, start_v int, end_c int, end_v int")
    records = spark.createDataFrame([("x", c, c % 7 + 1) for c in range(60)] + [("y", 1, 2), ("z", 1, 1)], "b string, c int, v int").selectExpr("*", "cast(null as string) p", "cast(null as string) ph")
    key = lambda df: sorted(tuple(r) for r in df.select("b", "c", "v", F.coalesce("p", F.lit("-"))).collect())
    assert key(section_join(records, sections)) == key(section_join(records, sections, most=2))


def test_report_text(spark):
    from lexforge.operators import evaluate

    worst = spark.createDataFrame([("q1", None, None), ("q2", 7, 2), ("q3", 3, 1)], "qid string, rank bigint, tie bigint")
    text = evaluate.report("Results", spark.createDataFrame([("overall", 3, None)], "group string, n int, mrr double"), worst).split("\n")
    assert text[2:4] == ["group    n  mrr", "overall  3  n/a"] and ["MISS", "q1"] in [x.split() for x in text] and "#7 (tie of 2)  q2" in text
    with pytest.raises(ValueError):
        evaluate.lines(worst, most=2)
