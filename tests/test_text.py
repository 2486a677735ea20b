"""Literal fixtures of the text functions, numerals, splits and joins."""

import pytest
from pyspark.sql import functions as F

from lexforge.functions import numerals as N
from lexforge.functions import text as X
from lexforge.operators import evaluate, index, ingest, resolve, sample, search


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(("given", "want"), [("בְּרֵאשִׁ֖ית־בָּרָא", "בראשית ברא"), ("12:3", "123"), ("  a   b ", "a b"), ("", "")])
def test_normalize(spark, given, want):
    assert one(spark, X.normalize(F.col("s")), s=given) == want


def test_normalize_keeps_refs_on_request(spark):
    assert one(spark, X.normalize(F.col("s"), split_refs=True), s="12:3") == "12 3"


def test_skeleton_ignores_spelling(spark):
    assert {one(spark, X.skel(F.col("s")), s=w) for w in ("מוקדם", "מקדם")} == {"מקדם"}


@pytest.mark.parametrize(("given", "want"), [("יד", 14), ("קכג", 123), ('י"ד', 14), ("14", 14), ("גיד", None), ("תתקצ", None), ("", None), ("ברא", None)])
def test_parse_numeral(spark, given, want):
    assert one(spark, N.parse_numeral(F.col("s")), s=given) == want


@pytest.mark.parametrize(("given", "want"), [(15, "טו"), (16, "טז"), (115, "קטו"), (14, "יד"), (500, "תק"), (999, "תתקצט")])
def test_format_numeral(spark, given, want):
    assert one(spark, N.format_numeral(F.col("n")), n=given) == want


def test_numerals_round_trip(spark):
    df = spark.range(1, 1000).select(F.col("id").cast("int").alias("n"), N.format_numeral(F.col("id").cast("int")).alias("t"))
    short = df.where(F.length("t") <= 3)
    assert short.count() == 576
    assert short.where(N.parse_numeral(F.col("t")) != F.col("n")).count() == 0


def test_folio(spark):
    df = spark.createDataFrame([(i,) for i in (0, 1, 2, 56, 57)], "i int")
    assert [tuple(r) for r in df.select(*N.folio_of(F.col("i"))).collect()] == [(1, 1), (1, 2), (2, 1), (29, 1), (29, 2)]


@pytest.mark.parametrize(
    ("split", "given", "want"),
    [(ingest.bold_lemma, "<b>אבג.</b> דהו", ("אבג", "דהו")), (ingest.bold_lemma, "דהו", ("", "דהו")), (ingest.dash_lemma, "אבג – דהו - זחט", ("אבג", "דהו - זחט")), (ingest.dash_lemma, "אבג דהו", ("", "אבג דהו")), (ingest.lemma_and_body, "<b>א</b> ב - ג", ("א", "ב - ג"))],
)
def test_lemma_split(spark, split, given, want):
    df = spark.createDataFrame([(given,)], "s string")
    assert tuple(df.select(*split(F.col("s"))).first()) == want


def test_clean_resolves_entities_and_footnotes(spark):
    s = 'a<sup class="footnote-marker">1</sup><i class="footnote">x\ny</i> &amp;lt; b&#8211;c '
    assert one(spark, X.clean(F.col("s"), footnotes=True, every_entity=True), s=s) == "a &lt; b–c"


@pytest.mark.parametrize(("hay", "tok", "want"), [("x ab", "ab", 2), ("xab", "ab", -1), ("ab", "", -1), ("ab ab", "ab", 0)])
def test_word_match(spark, hay, tok, want):
    assert one(spark, X.word_match(F.col("h"), F.col("t")), h=hay, t=tok) == want


def test_sloppy(spark):
    df = spark.createDataFrame([("hamishshah me'ah",), ("umattecha",)], "s string")
    assert [r[0] for r in df.select(X.sloppy_variant(F.col("s"))).collect()] == ["hamishshah meah", "umatecha"]


def test_clean_variant(spark):
    assert one(spark, X.clean_variant(F.col("s")), s="Ḥāṣ-Ér  o'r5") == "haser o'r"


def test_highlight():
    assert X.mark_spans("<אָבג אב>", ["אב"]) == "&lt;<mark>אָב</mark>ג <mark>אב</mark>&gt;"
    assert X.mark_spans("a.a.a", ["aa"]) == "<mark>a.a</mark>.a"
    assert X.mark_spans("x", []) == "x"


@pytest.mark.parametrize(("links", "want"), [(0, 0.0), (1, 3.5), (7, 10.5), (10**9, 50.0), (None, 0.0)])
def test_pop_boost(spark, links, want):
    df = spark.createDataFrame([(links,)], "n bigint")
    assert df.select(N.pop_boost(F.col("n"))).first()[0] == pytest.approx(want)


def test_float_lcg():
    lcg = N.FloatLcg(1)
    lcg.draw()
    assert lcg.state == 1103527590
    lcg.draw()
    assert lcg.state == 377401600


def test_sections_first_match_and_last_fallback(spark):
    sections = spark.createDataFrame([("B", 1, 1, 1, 6, 8, "P1", "ה1"), ("B", 2, 6, 9, 11, 32, "P2", "ה2"), ("B", 3, 6, 1, 11, 32, "P3", "ה3")], "b string, ord_no int, start_c int, start_v int, end_c int, end_v int, p string, ph string")
    records = spark.createDataFrame([("B", 6, 8), ("B", 6, 9), ("B", 99, 1), ("C", 1, 1), (None, 1, 1)], "b string, c int, v int")
    got = {(r.b, r.c, r.v): r.p for r in ingest.section_join(records, sections).collect()}
    assert got == {("B", 6, 8): "P1", ("B", 6, 9): "P2", ("B", 99, 1): "P3", ("C", 1, 1): None, (None, 1, 1): None}


def test_unnest_keeps_gaps(spark):
    df = spark.createDataFrame([([["a", "", None, "b"], None, [], ["c"]],)], "x array<array<string>>")
    assert [tuple(r) for r in ingest.unnest(df, "x", ("c", "v"), "t").orderBy("c", "v").collect()] == [(1, 1, "a"), (1, 4, "b"), (4, 1, "c")]


def test_manifest_and_shards(spark, tmp_path):
    df = spark.createDataFrame([("A b", 1), ("A b", 2), ("C", 3)], "b string, x int")
    got = {r.b: (r.n_records, r.file) for r in ingest.write_shards(df, str(tmp_path / "s")).collect()}
    assert got == {"A b": (2, "A_b.json"), "C": (1, "C.json"), None: (3, None)}


def rows_for_search(spark):
    rows = [(1, "B", "P", 1, 1, "ומקדם", "x", 0), (2, "B", "P", 1, 2, "מקדם", "x", 7), (3, "B", "Q", 2, 1, "אחר", "א מקדם", 0), (4, "C", None, 1, 1, None, None, None), (5, "C", "R", 1, 1, "", "", 1)]
    return search.search_columns(spark.createDataFrame(rows, "rec_id bigint, b string, p string, c int, v int, dh string, t string, lk bigint").withColumn("vt", F.lit("")))


def test_ladder_order(spark):
    got = {r.rec_id: r.score for r in search.search(rows_for_search(spark), search.Query(lemma="מקדם")).collect()}
    assert got == {2: 1010.5, 1: 400.0, 3: 15.0}


def test_empty_skeleton(spark):
    df = rows_for_search(spark)
    got = {r.rec_id: r.score for r in search.search(df, search.Query(lemma="ו")).collect()}
    assert got[3] == 450.0 and got[5] == 803.5
    points, _ = search.ladder("ו", strict_skeleton=True)
    assert df.where("rec_id = 3").select(points).first()[0] == 0


def test_pin_and_browse(spark):
    df = rows_for_search(spark)
    none = spark.createDataFrame([], "rec_id bigint, score double")
    assert [r.score for r in search.search(df, search.Query(book="B", chapter=1, verse=2, words="zzz"), none).collect()] == [11.5]
    assert search.search(df, search.Query(book="B", chapter=1, words="zzz"), none).count() == 0
    assert search.search(df, search.Query(), limit=2).count() == 2


def test_near_finds_all_within_bound(spark):
    import itertools

    words = ["".join(w) for n in (3, 4, 6) for w in itertools.islice(itertools.product("KLM", repeat=n), 0, None, 7)]
    df = spark.createDataFrame([(w,) for w in words], "a string")
    got = {(r.a, r.b) for r in index.near(df, df.withColumnRenamed("a", "b"), "a", "b").collect()}
    from lexforge.plans.parse import distance_within

    assert got == {(a, b) for a in words for b in words if distance_within(a, b, 0 if len(a) < 3 else 1 if len(a) < 6 else 2) is not None}


def test_fuzzy_alias_rules(spark):
    registry = spark.createDataFrame([("KLM", "x", False), ("KLN", "y", False), ("RSTBGD", "z", False), ("DDD", "d", True)], "key string, entity string, ambiguous boolean")
    asked = spark.createDataFrame([("KLT",), ("RSTBDD",), ("DDG",), ("KLM",), ("KL",)], "word string")
    assert {tuple(r) for r in resolve.fuzzy_unique(asked, registry).collect()} == {("RSTBDD", "z", 1), ("KLM", "x", 0)}


def test_resolve_prefers_spelling(spark):
    registry = spark.createDataFrame([("TLDS", "toldos", False)], "key string, entity string, ambiguous boolean")
    spelled = spark.createDataFrame([("taldus", "other")], "word string, entity string")
    asked = spark.createDataFrame([("taldus",), ("toldos",), ("tolds",), ("toldns",), ("zz",)], "word string")
    assert {tuple(r) for r in resolve.resolve(asked, spelled, registry).collect()} == {("taldus", "other", "exact"), ("toldos", "toldos", "folded"), ("tolds", "toldos", "folded"), ("toldns", "toldos", "fuzzy")}


def test_terciles_of_four(spark):
    df = spark.createDataFrame([(i, 0, "x") for i in range(4)], "id int, lk int, g string")
    assert sorted(r.tier for r in sample.terciles(df, "lk", "id", "g").collect()) == [0, 0, 1, 1]


@pytest.mark.parametrize(("k", "want"), [(10, (4, 3, 3)), (11, (4, 4, 3)), (9, (3, 3, 3))])
def test_quotas(k, want):
    assert sample.quotas(k) == want


def test_rank_and_metrics(spark):
    hits = spark.createDataFrame([("q", i, s) for i, s in ((1, 9.0), (2, 7.0), (3, 7.0), (4, 5.0))] + [("r", 1, 2.0), ("r", 2, 2.0)], "qid string, rec_id bigint, score double")
    gold = spark.createDataFrame([("q", 2), ("r", 1), ("s", 1), ("q2", None)], "qid string, target bigint")
    ranks = evaluate.target_ranks(hits, gold)
    got = {r.qid: (r["rank"], r.tie) for r in ranks.collect()}
    assert got == {"q": (2, 2), "r": (1, 2), "s": (None, None), "q2": (None, None)}
    m = ranks.agg(*evaluate.metrics()).first()
    assert (m.n, m.top1, m.top1tied, m.top3, m.mrr, m.miss) == (4, 0.0, 25.0, 50.0, 0.375, 50.0)
    assert evaluate.worst(ranks, 1).first().qid == "q2"


def test_empty_tables(spark):
    hits = spark.createDataFrame([], "qid string, rec_id bigint, score double")
    gold = spark.createDataFrame([], "qid string, target bigint")
    assert evaluate.target_ranks(hits, gold).count() == 0
    m = evaluate.target_ranks(hits, gold).agg(*evaluate.metrics()).first()
    assert m.n == 0 and m.top1 is None
    df = spark.createDataFrame([], "id int, lk int, g string")
    assert sample.terciles(df, "lk", "id", "g").count() == 0
