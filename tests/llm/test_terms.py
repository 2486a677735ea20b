"""Problems 1, 2 and 6 against brute force."""

import math
import unicodedata
from collections import Counter

import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from lexforge.llm import plain, terms

BAD = [
    (1, None, None, "x"), (2, "", "", "x"), (3, "אב אב־גד", "אָב \"אב\" ד'ה", "x"), (3, "אב אב־גד", "אָב \"אב\" ד'ה", "y"), (None, "אב", None, None),
    (4, "ﬡב ﭏ", "wörd ａｂ", "x"), (5, "זז " * 50_000, "x", "x"),
]
SCHEMA = "rec_id bigint, dh string, t string, term string"


def brute_terms(s):
    s = unicodedata.normalize("NFC", "".join(unicodedata.normalize("NFKC", c) if unicodedata.category(c)[0] == "L" else c for c in s or ""))
    s = regex.sub("[\u0591-\u05bd\u05bf\u05c1\u05c2\u05c4\u05c5\u05c7'\"]", "", s)
    return regex.findall("[א-ת]+", s)


def exact_log_tail(k, n, g, total):
    tail = sum(math.comb(g, j) * math.comb(total - g, n - j) for j in range(k, min(n, g) + 1))
    return math.log(tail) - math.log(math.comb(total, n))


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_upper_tail_is_exact(data):
    total = data.draw(st.integers(2, 400))
    g, n = data.draw(st.integers(1, total)), data.draw(st.integers(1, total))
    k = data.draw(st.integers(max(1, n + g - total), min(n, g)))
    got = terms.log_upper_tail(np.array([k]), np.array([n]), np.array([g]), total)[0]
    assert got == pytest.approx(exact_log_tail(k, n, g, total), abs=1e-8, rel=1e-8)


def test_upper_tail_of_large_counts():
    got = terms.log_upper_tail(np.array([3, 1, 40]), np.array([30, 30, 100]), np.array([9, 200_000, 60]), 2_000_000)
    assert got == pytest.approx([exact_log_tail(3, 30, 9, 2_000_000), exact_log_tail(1, 30, 200_000, 2_000_000), exact_log_tail(40, 100, 60, 2_000_000)], rel=1e-8)


def test_scores_on_odd_rows(spark):
    df = spark.createDataFrame(BAD, SCHEMA)
    got = terms.distinctive_terms(df, "rec_id", ["dh", "t"]).collect()
    counts = [Counter(brute_terms(r[1]) + brute_terms(r[2])) for r in BAD]
    total, whole = sum(sum(c.values()) for c in counts), sum(counts, Counter())
    assert len(got) == sum(len(c) for c in counts)
    want = {(r[0], t, k) for r, c in zip(BAD, counts) for t, k in c.items()}
    assert {(r.rec_id, r.term, r.n_in_record) for r in got} == want
    for r in got:
        assert r.n_occurrences == whole[r.term] and r.n_records == sum(r.term in c for c in counts)
        assert r.p_log10 * math.log(10) == pytest.approx(exact_log_tail(r.n_in_record, r.record_terms, r.n_occurrences, total), abs=1e-7)


def test_adjustment_is_benjamini_hochberg():
    rng = np.random.default_rng(1)
    uid = np.sort(rng.integers(0, 50, 600))
    logp = np.log(rng.random(600))
    got = terms._adjusted(uid, logp)
    for u in set(uid.tolist()):
        p = np.exp(logp[uid == u])
        order = np.argsort(p)
        want = np.empty_like(p)
        best = 1.0
        for rank in range(len(p), 0, -1):
            best = min(best, p[order[rank - 1]] * len(p) / rank)
            want[order[rank - 1]] = best
        assert np.exp(got[uid == u]) == pytest.approx(want)


def test_heavy_and_light_terms_alike(spark, monkeypatch):
    df = spark.createDataFrame([(i, "שלם " * (i % 3 + 1) + "אבג"[i % 3] * (i % 7 + 1), "") for i in range(300)], "rec_id bigint, dh string, t string")
    key = lambda rows: sorted((r.rec_id, r.term, r.n_records, round(r.score, 9)) for r in rows)
    a = key(terms.distinctive_terms(df, "rec_id", ["dh", "t"]).collect())
    monkeypatch.setattr(terms, "HEAVY", 0.2)
    assert a == key(terms.distinctive_terms(df, "rec_id", ["dh", "t"]).collect())


def test_frequency(spark):
    df = spark.createDataFrame(BAD, SCHEMA)
    got = {(r.field, r.term): (r.n_occurrences, r.n_records, r.mark) for r in terms.term_frequency(df, ["dh", "t"]).collect()}
    for f, at in (("dh", 1), ("t", 2)):
        counts = [Counter(brute_terms(r[at])) for r in BAD]
        for t, n in sum(counts, Counter()).items():
            docs = sum(t in c for c in counts)
            assert got.pop((f, t)) == (n, docs, "rare" if docs == 1 else "common" if docs > len(BAD) / 20 else None)
    assert not got


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert terms.distinctive_terms(df, "rec_id", ["dh", "t"]).count() == 0
    assert terms.term_frequency(df, ["dh", "t"]).count() == 0
    assert plain.not_plain(df, "rec_id", ["dh", "t"]).count() == 0


CASES = [
    ("Ｂｕｙｅf 𝟓𝟎.𝟐", "Buyef 50.2"), ("Le mantеаu", "Le manteau"), ("Привeт мир", "Привет мир"), ("רצװשתץ ﭏ ℵ ﬡ", "רצוושתץ אל א א"), ("שׁ", "שׁ"), ("אּ֖", None),
    ("é cοntre", "é contre"), ("a b​c d\te", "a bc d e"), ("й", "й"), ("טֶּ", "טֶּ"), ("בֶ͏ג", "בֶג"), ("line\nline", "line\nline"), ("…！“x” –", "…！“x” –"),
    ("ทำ ｶ ① x²", "ทำ カ ① x²"), ("ﬁn Ⅳ", "fin IV"), ("この語は「井戸」", "この語は「井戸」"), ("", ""), ("dא", "dא"), ("שלום‏", "שלום"), ("a\x01b\x7f\u2028c", "ab\u2028c"),
    ("ωord ѡord ηot ӏist սser Ꭺpple", "word word not list user Apple"), ("слово word λόγος մեր ᏣᎳᎩ", "слово word λόγος մեր ᏣᎳᎩ"), ("Іnside пpивет", "Inside привет"),
]


@pytest.mark.parametrize(("given_", "want"), CASES)
def test_plain(spark, given_, want):
    con = plain.connect(plain.lookalikes(spark))
    con.execute("CREATE TABLE v AS SELECT ? AS value", [given_])
    got = con.execute(f"SELECT plain FROM {plain.plain_sql('v', 'value AS _v')}".replace("value AS _v, value", "value")).fetchall()[0][0]
    assert got == (unicodedata.normalize("NFC", given_) if want is None else want)


def test_look_alikes_need_no_icu(spark, monkeypatch):
    jvm = spark._jvm

    class WithoutIcu:
        def __getattr__(self, name):
            if name == "com":
                raise AttributeError(name)
            return getattr(jvm, name)

    monkeypatch.setattr(type(spark), "_jvm", property(lambda self: WithoutIcu()), raising=False)
    df = spark.createDataFrame([(1, "սser"), (2, "Ꭺpple"), (3, "ωord"), (4, "apple"), (5, "մեր")], "id int, t string")
    assert sorted(r.id for r in plain.not_plain(df, "id", ["t"]).collect()) == [1, 2, 3]
    got = {r.id: r.plain for r in plain.plain_spelling(df, "id", ["t"]).collect()}
    assert got == {1: "user", 2: "Apple", 3: "word", 4: "apple", 5: "մեր"}


def test_look_alikes_are_those_of_icu(spark):
    checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    script = {chr(c): name for name, points in plain.SCRIPTS.items() for c in points}
    groups = {}
    for x in sorted(script):
        if unicodedata.category(x)[0] == "L" and unicodedata.normalize("NFD", x) == x:
            same = "".join(c for c in checker.getSkeleton(x) if not unicodedata.combining(c))
            if len(same) == 1:
                groups.setdefault((same, x.isupper()), []).append(x)
    want = sorted("".join(g) for g in groups.values() if len({script[x] for x in g}) > 1)
    assert sorted(plain.CONFUSABLE.split()) == want


def test_plain_is_idempotent_on_all_values(spark, tiny):
    df = spark.read.parquet(f"{tiny}/rashi.parquet")
    once = plain.plain_spelling(df, "rec_id", ["dh", "t", "vt"])
    again = plain.plain_spelling(once.withColumnRenamed("rec_id", "id"), "id", ["plain"])
    assert again.where("changed").count() == 0
    assert once.where("changed").count() == plain.not_plain(df, "rec_id", ["dh", "t", "vt"]).count()


def test_plain_rows(spark):
    df = spark.createDataFrame(BAD, SCHEMA)
    got = {(r.rec_id, r.field) for r in plain.not_plain(df, "rec_id", ["dh", "t"]).collect()}
    assert got == {(4, "dh"), (4, "t")}
