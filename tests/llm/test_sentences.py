"""Problem 3: rules by example, and invariants on any text."""

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexforge.llm.sentences import Splitter, corpus_lexicon, evidence, lexicon, sentences

SPLIT = Splitter(frozenset(["Dr", "M", "J", "B", "т", "i", "e"]), frozenset(["vol", "פר", "стр"]), frozenset(["etc", "д"]))

CASES = [
    ["One two.", "Three!", "Four?"],
    ["He saw it, etc.", "The end."],
    ["He saw it, etc. and again it rained."],
    ["Dr. Who met J. B. Orrel at vol. 2 the end."],
    ["It is 3.5 cubits, i.e. the well."],
    ["It went on... and stopped.", "Then nothing"],
    ['He said: "The pot left. The camp broke." the king threw it.', "The end."],
    ['He said: "The pot left."', "The carpenter came."],
    ["Злой суд (Стол взял. Дом.).", "Договор, и т. д.", "Обычный предел."],
    ["נסט (שקז על. לא.) כל.", "אשר בו."],
    ["היה אל \"טטיו ישתד? דלרפו.\" טקאו תצזן?", "סוף"],
    ["אמר רזך \"על את ותך.\"", "תדע זה טפס"],
    ["דף 26.39 זה פר. 26 של.", "כי 10:55 וכו'.", "לא"],
    ["כי לא ﬤן פﬧ. 51 של.", "סוף"],
    ["זה ד\"ה היה ע\"פ לח׃", "עד כי"],
    ["这个字说明了原因。", "下一行「前章。这个。」提到城门3.5。"],
    ["ครูคนนั้นตอบ4.6", "บทก่อนยังไม่จบ"],
    ["यह शब्द है 3.5।", "गुरु का?"],
    ["هذا القول «السطر.المعلم.» يذكر!", "صاحب؟"],
]


@pytest.mark.parametrize("parts", CASES, ids=range(len(CASES)))
@pytest.mark.parametrize("blank", [" ", "\n", "  "])
def test_sentences(parts, blank):
    text = blank.join(parts)
    assert [text[a:b] for a, b in SPLIT.spans(text)] == parts


def test_no_blank_needed():
    text = "הוא.ידכהב עסו.The end.Next one"
    assert [text[a:b] for a, b in SPLIT.spans(text)] == ["הוא.", "ידכהב עסו.", "The end.", "Next one"]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aB. \n\"'()«»?!…אב,:3。「」ก​", max_size=60))
def test_spans_cover_all_but_blanks(text):
    spans = SPLIT.spans(text)
    at = 0
    for a, b in spans:
        assert a < b and a >= at and not text[at:a].strip() and not text[a].isspace() and not text[b - 1].isspace()
        at = b
    assert not text[at:].strip()


def test_lexicon_from_counts():
    rows = [("Dr", 0, 0, 30, 0, 0, 0, 0), ("etc", 40, 30, 50, 0, 0, 0, 0), ("vol", 0, 0, 0, 50, 0, 0, 0), ("wall", 40, 0, 80, 0, 0, 9, 0), ("Ur", 0, 0, 3, 0, 0, 0, 50)]
    opened, reference, closing = lexicon(rows)
    assert "Dr" in opened and "wall" not in opened and "Ur" not in opened
    assert reference == {"vol"} and closing == {"etc"}


def test_rows(spark):
    rows = [(1, None, 0), (2, "", 0), (3, " \n ", 0), (4, "A b. C d.", 0), (4, "A b. C d.", 1), (None, "x", 0), (5, "Ab cd. " * 100_000, 0)]
    df = spark.createDataFrame(rows, "rec_id bigint, t string, sent_no int")
    got = sentences(df, "rec_id", "t")
    assert got.where("rec_id = 4").count() == 4 and got.where("rec_id is null").count() == 1
    assert got.where("rec_id in (1, 2, 3)").count() == 0
    assert got.where("rec_id = 5").count() == 100_000
    assert sentences(df.limit(0), "rec_id", "t").count() == 0


def test_corpus_counts_everything(spark):
    df = spark.createDataFrame([(f"It was Dr. Abc{i} there, etc. and so on. He left, etc.",) for i in range(30)], "t string")
    opened, _, closing = corpus_lexicon(df, "t")
    assert "Dr" in opened and "etc" in closing


def cut_up(text, split=SPLIT):
    return [text[a:b] for a, b in split.spans(text)]


def test_abbreviations_of_scripts_without_capitals(spark):
    assert cut_up("אמר ר. יוחנן כי. לא", Splitter(frozenset(["ר"]))) == ["אמר ר. יוחנן כי.", "לא"]
    assert cut_up("זה עמ. 26 או עמ. 7 של עמ. רבי לא. כי", Splitter()) == ["זה עמ. 26 או עמ. 7 של עמ. רבי לא.", "כי"]
    assert cut_up("זה בית. 26 של בית. רבי בית לא", Splitter()) == ["זה בית.", "26 של בית.", "רבי בית לא"]
    df = spark.createDataFrame([("אמר ר. יוחנן מלה.",) for _ in range(40)], "t string")
    opened, _, _ = corpus_lexicon(df, "t")
    assert cut_up("אמר ר. יוחנן", Splitter(opened)) == ["אמר ר. יוחנן"]


def test_text_counts_before_the_corpus():
    split = Splitter(closing=frozenset(["approx"]), opened=frozenset(["Ur"]))
    assert cut_up("It was approx., as the Moon! They saw approx. Moon and went.", split) == ["It was approx., as the Moon!", "They saw approx. Moon and went."]
    assert cut_up("From Ur the men left. They came to Ur. Men sang.", split) == ["From Ur the men left.", "They came to Ur.", "Men sang."]
    assert cut_up("They came to Ur. Men sang.", split) == ["They came to Ur. Men sang."]


def test_single_counts_decide_nothing():
    rows = [("Dr", 1, 1, 998, 0, 0, 0, 0), ("etc", 40, 30, 50, 0, 0, 0, 0), ("wall", 900, 1, 900, 0, 0, 0, 0)]
    opened, _, closing = lexicon(rows)
    assert "Dr" in opened and closing == {"etc"}


def test_rare_abbreviations_of_large_corpora(spark):
    words = [f"{a}{b}{c}" for a in "bcdfghklmn" for b in "aeiou" for c in "bcdfghklmn"]
    rows = [(i, " ".join(f"{w}." for w in words), 0) for i in range(1000)] + [(5000 + i, "It is on xyz. 2 here.", 0) for i in range(4)] + [(None, "xyz. 2 it is", 0)]
    df = spark.createDataFrame(rows, "rec_id bigint, t string, sent_no int").repartition(4)
    assert "xyz" in corpus_lexicon(df, "t")[1]
    few = df.where("rec_id is null or rec_id >= 5000 or rec_id < 3")
    for most in (100, 0):
        got = sentences(few, "rec_id", "t", most)
        assert got.where("rec_id >= 5000").count() == 4 and got.where("rec_id is null").count() == 1
    assert sentences(few, "rec_id", "t", 0).exceptAll(sentences(few, "rec_id", "t")).count() == 0


def test_long_tokens_are_evidence_too():
    word = "Verwaltungsgerichtsbarkeitsverordnungsabk"
    assert evidence([f"see {word}. 12"])[word, "dig"] == 1
    assert evidence(["x" * 5000 + ". 12"])["x" * 5000, "dig"] == 1
    assert cut_up(f"Laut {word}. 12 gilt das.", Splitter(reference=frozenset([word]))) == [f"Laut {word}. 12 gilt das."]


def test_blanks_before_a_closing_quote():
    assert cut_up("He said “Go home.            ” Then he left.") == ["He said “Go home.            ”", "Then he left."]
    assert cut_up("He said “Go home. Now it is late” then he left.") == ["He said “Go home. Now it is late” then he left."]


def test_many_quotations_on_one_line_take_linear_time():
    text = "He said “Go home. Now.” and left. " * 20_000
    began = time.perf_counter()
    spans = SPLIT.spans(text + "ก ข " * 20_000)
    assert len(spans) > 20_000 and time.perf_counter() - began < 20
