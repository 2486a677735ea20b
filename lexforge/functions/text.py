"""Text functions as native Column expressions; each has the DuckDB SQL of the same value beside it.

Everything stays in whole-stage code but HTML entities beyond the basic ones and
highlighting, which run as Arrow batches.
"""

from __future__ import annotations

import html
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Code-point classes of the data model.
MAQAF = "־"
POINTS = "".join(map(chr, (*range(0x591, 0x5BE), *range(0x5BF, 0x5C8))))
PUNCTUATION = "״\"׳'.,:;!?()[]{}"
# White space as ECMAScript counts it, as a regular-expression class.
WS = "[\\t-\\r \\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]"
THIN_SPACES = "".join(map(chr, (0x2009, 0x200A, 0x00A0, 0x200B, 0xFEFF)))
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&"))
PLACEHOLDERS = ("וגו'", "וכו'")


def q(s: str) -> str:
    """An SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def collapse(c: Column) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return F.btrim(F.regexp_replace(c, f"{WS}+", " "), F.lit(" "))


def collapse_sql(c: str) -> str:
    return f"trim(regexp_replace({c}, {q(WS + '+')}, ' ', 'g'), ' ')"


def normalize(c: Column, split_refs: bool = False) -> Column:
    """Maqaf to blank; points, accents and punctuation dropped; white space collapsed.

    With ``split_refs`` a colon or full stop between digits becomes a blank instead, so
    that "12:3" stays two numbers.
    """
    if split_refs:
        c = F.regexp_replace(c, "(?<=[0-9])[:.](?=[0-9])", " ")
    return collapse(F.translate(c, MAQAF + POINTS + PUNCTUATION, " "))


def normalize_sql(c: str) -> str:
    return collapse_sql(f"translate({c}, {q(MAQAF + POINTS + PUNCTUATION)}, ' ')")


def skel(c: Column) -> Column:
    """Spelling-insensitive skeleton of a normalized text: vav and yod dropped."""
    return collapse(F.translate(c, "וי", ""))


def skel_sql(c: str) -> str:
    return collapse_sql(f"translate({c}, 'וי', '')")


def unescape_basic(c: Column) -> Column:
    """The XML entities and nbsp, middot, copy; ampersand last."""
    for name, ch in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(ch))
    return c


def unescape_sql(c: str) -> str:
    for name, ch in ENTITIES:
        c = f"replace({c}, {q(name)}, {q(ch)})"
    return c


@F.pandas_udf(StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda x: html.unescape(x) if x is not None else None)


def unescape(c: Column) -> Column:
    """All HTML entities; only texts with an ampersand pay for the Arrow trip's work."""
    return _unescape(c)


def strip_footnotes(c: Column) -> Column:
    """Without footnote markers and footnotes."""
    return F.regexp_replace(F.regexp_replace(c, '(?s)<sup class="footnote-marker">.*?</sup>', ""), '(?s)<i class="footnote">.*?</i>', "")


def strip_footnotes_sql(c: str) -> str:
    for tag in ('<sup class="footnote-marker">.*?</sup>', '<i class="footnote">.*?</i>'):
        c = f"regexp_replace({c}, {q('(?s)' + tag)}, '', 'g')"
    return c


def clean(c: Column, footnotes: bool = False, every_entity: bool = False) -> Column:
    """Tags dropped, entities resolved, thin spaces to blanks, ends stripped."""
    c = F.regexp_replace(strip_footnotes(c) if footnotes else c, "<[^>]+>", "")
    c = F.translate(unescape(c) if every_entity else unescape_basic(c), THIN_SPACES, " " * len(THIN_SPACES))
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def clean_sql(c: str, footnotes: bool = False) -> str:
    c = f"regexp_replace({strip_footnotes_sql(c) if footnotes else c}, '<[^>]+>', '', 'g')"
    c = f"translate({unescape_sql(c)}, {q(THIN_SPACES)}, {q(' ' * len(THIN_SPACES))})"
    return f"regexp_replace({c}, {q(f'^{WS}+|{WS}+$')}, '', 'g')"


def strip_lemma(c: Column) -> Column:
    """Blanks, full stops, colons and maqafs off both ends."""
    return F.btrim(c, F.lit(" .:־"))


def bare(c: Column) -> Column:
    """Consonants only: every mark from U+0591 to U+05C7 dropped, maqaf included."""
    return F.btrim(F.translate(c, "".join(map(chr, range(0x591, 0x5C8))), ""), F.lit(" "))


def bare_sql(c: str) -> str:
    return f"trim(regexp_replace({c}, '[\\x{{0591}}-\\x{{05c7}}]', '', 'g'), ' ')"


def words(c: Column) -> Column:
    """Non-empty tokens between white space and maqafs."""
    return F.filter(F.split(c, f"({WS}|{MAQAF})+"), lambda t: t != "")


def words_sql(c: str) -> str:
    return f"list_filter(string_split_regex({c}, {q(f'({WS}|{MAQAF})+')}), lambda t: t <> '')"


def vocalized(c: Column) -> Column:
    """Like ``words``, accents dropped and points kept."""
    return words(F.translate(c, "".join(map(chr, range(0x591, 0x5B0))), ""))


def straight(c: Column) -> Column:
    """Curly and Hebrew apostrophes as the ASCII one."""
    return F.translate(c, "’׳", "''")


def no_trailing_marks(c: Column) -> Column:
    return F.regexp_replace(c, "[׳'\"״]+$", "")


def usable(t: Column) -> Column:
    """A lemma token that says something: Hebrew letters, and not "etc."."""
    return ~straight(t).isin(*PLACEHOLDERS) & t.rlike("[א-ת]")


@cache
def _plain_latin() -> tuple[str, str]:
    """Accented Latin letters and their base letters, by rule from their decompositions."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))]
    kept = [(a, b.lower()) for a, b in pairs if a != b and b.isascii() and b.isalpha()]
    return "".join(a for a, _ in kept), "".join(b for _, b in kept)


def clean_variant(c: Column) -> Column:
    """Small letters a-z, apostrophes and single blanks; accents dropped."""
    return collapse(F.regexp_replace(F.translate(F.lower(c), *_plain_latin()), "[^a-z' ]", ""))


def clean_variant_sql(c: str) -> str:
    a, b = _plain_latin()
    return collapse_sql(f"regexp_replace(translate(lower({c}), {q(a)}, {q(b)}), '[^a-z'' ]', '', 'g')")


def sloppy_variant(c: Column) -> Column:
    """As typed in a hurry: no apostrophes, doubled letters once."""
    return F.regexp_replace(F.replace(c, F.lit("'"), F.lit("")), "([a-z])\\1+", "$1")


def sloppy_variant_sql(c: str) -> str:
    c = f"replace({c}, '''', '')"
    for letter in "abcdefghijklmnopqrstuvwxyz":
        c = f"regexp_replace({c}, '{letter}+', '{letter}', 'g')"
    return c


def word_match(hay: Column, token: Column) -> Column:
    """0-based place of the first word of ``hay`` that starts with ``token``; -1 if none or the token is empty."""
    at = F.call_function("instr", F.concat(F.lit(" "), hay), F.concat(F.lit(" "), token)) - 1
    return F.when(token == "", -1).otherwise(at)


def word_match_sql(hay: str, token: str) -> str:
    return f"CASE WHEN {token} = '' THEN -1 ELSE strpos(' ' || {hay}, ' ' || {token}) - 1 END"


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def snippet(c: Column, most: int = 220) -> Column:
    return F.substring(c, 1, most)


def first_words(c: Column, most: int, mark: str = "") -> Column:
    """The first words, and ``mark`` if there are more."""
    w = words(c)
    return F.concat(F.array_join(F.slice(w, 1, most), " "), F.when(F.size(w) > most, mark).otherwise(""))


def url_quote(c: Column) -> Column:
    """Percent-encoding of a path part."""
    return F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))


def safe_filename(c: Column) -> Column:
    return F.replace(c, F.lit(" "), F.lit("_"))


def normalized_index(s: str) -> tuple[str, list[int]]:
    """Normalized text and, for each of its signs, the place in ``s``; a last blank may stay."""
    out: list[str] = []
    at: list[int] = []
    drop, blank = set(POINTS + PUNCTUATION), set(THIN_SPACES) - {"​"}
    for i, ch in enumerate(s):
        if ch in drop:
            continue
        if ch == MAQAF or ch.isspace() or ch in blank:
            if out and out[-1] != " ":
                out.append(" ")
                at.append(i)
        else:
            out.append(ch)
            at.append(i)
    return "".join(out), at


def mark_spans(s: str, tokens: list[str]) -> str:
    """HTML of ``s`` with every occurrence of a normalized token marked; overlaps keep the first."""
    norm, at = normalized_index(s)
    spans = set()
    for t in filter(None, tokens):
        i = norm.find(t)
        while i >= 0:
            spans.add((at[i], at[i + len(t) - 1] + 1))
            i = norm.find(t, i + 1)
    out, pos = [], 0
    for a, b in sorted(spans):
        if a >= pos:
            out += [html.escape(s[pos:a], False), "<mark>", html.escape(s[a:b], False), "</mark>"]
            pos = b
    return "".join([*out, html.escape(s[pos:], False)])


def highlight(c: Column, tokens: list[str]) -> Column:
    """``mark_spans`` as an Arrow-batched function, meant for the rows of a top-k."""

    @F.pandas_udf(StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: mark_spans(x, tokens) if x is not None else None)

    return run(c)
