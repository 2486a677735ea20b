"""Transliteration by literal words, and the query parser's rules."""

import pytest
from pyspark.sql import functions as F

from lexforge.functions import translit as T
from lexforge.plans import parse

WORDS = [
    ("בְּרֵאשִׁית", "be-re-shit"), ("שָׁלוֹם", "sha-lom"), ("וַתֵּשְׁתְּ", "vat-te-shet"), ("גַּנִּים", "gan-nim"), ("רוּחַ", "ruach"), ("מַלְכָּה", "mal-kah"),
    ("כָּל־הָעָם", "kol-ha-'am"), ("אָכַלְתְּ", "a-chalt"), ("יַעְקֹב", "ya'-kov"), ("מָלְכוּ", "mal-chu"), ("הוּא", "hu"), ("חָכְמָה", "chach-mah"), ("אבג", "vg"), ("", ""), ("abc", "abc"),
]


@pytest.mark.parametrize(("word", "want"), WORDS)
def test_simple_style(word, want):
    assert T.transliterate(word, "000_simple_sefardi")["text"] == want


@pytest.mark.parametrize(("style", "want"), [("010_simple_ashkenazi", "shabbos"), ("060_super_simple", "SHAHBBAHT"), ("110_sbl_academic", "šabbāt̲"), ("310_braille", "%V<\\"), ("230_russian", "шаббат"), ("220_german", "schabbat")])
def test_styles(style, want):
    assert T.transliterate("שַׁבָּת", style, "none", "none")["text"] == want


def test_stress_marks():
    assert T.transliterate("מֶלֶךְ", "000_simple_sefardi")["html"] == "<strong>me</strong>-lech"
    assert T.transliterate("מֶלֶךְ", "210_spanish", "none")["text"] == "mélej"
    assert T.transliterate("דָּבָר", "140_ipa", "none")["text"].count("ˈ") == 1
    assert T.transliterate("דָּבָר", "000_simple_sefardi", "none", "capitalize")["text"] == "daVAR"


def test_unknown_style_raises():
    with pytest.raises(KeyError):
        T.transliterate("א", "nope")


def test_balanced():
    assert T.balanced("<b>a</b><strong>x</em><u>y") == "a<strong>x<u>y</u></strong>"


def test_fifteen_styles(spark):
    df = spark.createDataFrame([("שַׁבָּת שָׁלוֹם",), (None,)], "s string")
    got = df.select(*[T.transliterated(F.col("s"), s).alias(s) for s in T.styles()]).collect()
    assert len(got[0]) == 15 and all(got[0]) and not any(got[1])
    assert got[0]["010_simple_ashkenazi"] == "shabbos sholom"


NAMES = parse.Names([("Bereshit", "בראשית"), ("Shemot", "שמות")], [("Noach", "נח", "Bereshit"), ("Lech-Lecha", "לך־לך", "Bereshit"), ("Shemot", "שמות", "Shemot"), ("Bo", "בא", "Shemot")])


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("לך לך יב ג", ("Bereshit", "Lech-Lecha", 12, 3, "")),
        ("lech lecha 12 ברא", ("Bereshit", "Lech-Lecha", 12, 0, "ברא")),
        ("פרשת נח", ("Bereshit", "Noach", 0, 0, "")),
        ("בראשית א", ("Bereshit", "", 1, 0, "")),
        ("noach", ("Bereshit", "Noach", 0, 0, "")),
        ("bereshut א ב ג", ("Bereshit", "", 1, 2, "ג")),
        ("מלך בראשית", ("", "", 0, 0, "מלך בראשית")),
        ("נח", ("Bereshit", "Noach", 0, 0, "")),
        ("", ("", "", 0, 0, "")),
        ("12:3", ("", "", 0, 0, "123")),
    ],
)
def test_parse(raw, want):
    q = parse.parse(raw, NAMES)
    assert (q.book, q.section, q.chapter, q.verse, q.words) == want


def test_soft_filter_needs_the_corpus():
    q = parse.parse("noach", NAMES)
    assert q.soft == ("noach",) and not q.soft_fuzzy
    q = parse.replace(q, words="malka")
    assert parse.resolve_soft(q, lambda _: {"b": "Bereshit", "p": "Noach"}).section == "Noach"
    assert parse.resolve_soft(q, lambda _: {"b": "Shemot", "p": "Bo"}).words == "noach malka"
    assert parse.resolve_soft(q, lambda _: None).section == "Noach"
    assert parse.resolve_soft(parse.parse("noach", NAMES), lambda _: {"b": "x", "p": "y"}).section == "Noach"


@pytest.mark.parametrize(("raw", "want"), [("ברכות ב.", (2, 1, "")), ("ברכות ב:", (2, 2, "")), ("brachos 2a", (2, 1, "")), ("ברכות ב עמוד ב מלך", (2, 2, "מלך"))])
def test_folio(raw, want):
    q = parse.parse_folio(raw, [("Berakhot", "ברכות")])
    assert q.book == "Berakhot" and (q.leaf, q.side, q.words) == want


def test_fold_is_the_same_on_both_sides(spark):
    from lexforge.operators.index import fold

    words = ["shabbos", "סביב", "יסף", "lecha", "תולדות", "a1b", "ﬡב"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r[0] for r in df.select(fold(F.col("w"))).collect()] == [parse.plain_fold(w) for w in words]
