"""The query box: one short string becomes a Query, on the driver, from small dimensions."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.functions.numerals import VALUES
from lexforge.functions.text import MAQAF, POINTS, PUNCTUATION, _plain_latin
from lexforge.operators.index import CLASSES, GROUPS, LETTERS, SILENT
from lexforge.operators.search import Query

_DROP = str.maketrans({MAQAF: " ", **dict.fromkeys(POINTS + PUNCTUATION)})
_CLASS = str.maketrans(LETTERS + SILENT, CLASSES + "\0" * len(SILENT))
_LATIN = str.maketrans(*_plain_latin())
# The word that announces a section, and the words for the sides of a leaf.
SECTION_WORD, SIDE_WORD = "פרשת", "עמוד"


def plain_normalize(s: str, split_refs: bool = False) -> str:
    if split_refs:
        s = re.sub(r"(?<=\d)[:.](?=\d)", " ", s)
    return " ".join(s.translate(_DROP).split())


@lru_cache(1 << 16)
def plain_fold(token: str) -> str:
    token = token.lower().translate(_LATIN)
    for a, b in GROUPS:
        token = token.replace(a, b)
    return re.sub(r"([A-Z])\1+", r"\1", re.sub("[^A-Z0-9]", "", token.translate(_CLASS)))


def plain_numeral(token: str) -> int | None:
    token = token.translate(str.maketrans("", "", "״\"׳'"))
    if token.isascii() and token.isdigit():
        return int(token)
    values = [VALUES.get(ch, 0) for ch in token]
    good = 1 <= len(values) <= 3 and all(values) and values == sorted(values, reverse=True)
    return sum(values) if good and sum(values) <= 999 else None


def distance_within(a: str, b: str, most: int) -> int | None:
    """Edit distance if no more than ``most``."""
    if abs(len(a) - len(b)) > most:
        return None
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > most:
            return None
    return row[-1] if row[-1] <= most else None


def _shortened(word: str, most: int) -> set[str]:
    """``word`` and all words with up to ``most`` of its signs left out."""
    found = last = {word}
    for _ in range(most):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        found = found | last
    return found


class Nearest:
    """Keys by the words that leave out up to two of their signs.

    Words within a distance have such a word in common, so the keys near another are
    found without comparing all. What was asked is remembered, up to ``MOST`` keys.
    """

    MOST = 200_000

    def __init__(self, keys: dict[str, set]):
        self.keys, self.by, self.known = keys, {}, {}
        for k in keys:
            for x in _shortened(k, 2):
                self.by.setdefault(x, []).append(k)

    def near(self, key: str) -> tuple[object, bool]:
        """(the one entity of the nearest keys or None, whether there is one)."""
        if key not in self.known:
            if len(self.known) >= self.MOST:
                self.known.clear()
            most = 2 if len(key) >= 6 else 1
            best, near = None, set()
            for k in {k for x in _shortened(key, most) for k in self.by.get(x, ())}:
                d = distance_within(key, k, most)
                if d is None or best is not None and d > best:
                    continue
                near = (near if d == best else set()) | (self.keys[k] if len(self.keys[k]) == 1 else {*self.keys[k], None})
                best = d
            self.known[key] = (next(iter(near)), True) if len(near) == 1 and None not in near else (None, False)
        return self.known[key]


@dataclass(frozen=True)
class Section:
    name: str
    hebrew: str
    book: str


class Names:
    """Books and sections with their aliases. A key that two names claim finds neither."""

    def __init__(self, books: list[tuple[str, str]], sections: list[tuple[str, str, str]]):
        self.books = {he: en for en, he in reversed(books)}
        self.sections: dict[str, Section] = {}
        self.book_keys: dict[str, set[str]] = {}
        self.section_keys: dict[str, set[Section]] = {}
        self.spelled: dict[str, set] = {}
        for en, he in books:
            for w in [he.replace(" ", ""), *re.findall(r"[^\W\d_']+", en)]:
                self.book_keys.setdefault(plain_fold(w), set()).add(en)
                self.spelled.setdefault(w.lower(), set()).add(en)
        for name, he, book in sections:
            s = Section(name, he, book)
            self.sections.setdefault(plain_normalize(he or ""), s)
            for text in (name or "", he or ""):
                said = plain_normalize(text.replace("-", " ")).lower()
                self.spelled.setdefault(said, set()).add(s)
                ws = [plain_fold(w) for w in said.split()]
                if 1 <= len(ws) <= 2 and all(ws):
                    self.section_keys.setdefault("|".join(ws), set()).add(s)

        self._nearest: dict[int, Nearest] = {}

    def __getstate__(self) -> dict:
        """The names go to the tasks without what each makes of them on first use."""
        return self.__dict__ | {"_nearest": {}}

    def _found(self, keys: dict[str, set], key: str, shortest: int) -> tuple[object, bool]:
        """(entity or None, found by distance)."""
        if len(key) >= shortest and len(keys.get(key, ())) == 1:
            return next(iter(keys[key])), False
        if len(key) < 3:
            return None, False
        if id(keys) not in self._nearest:
            self._nearest[id(keys)] = Nearest(keys)
        return self._nearest[id(keys)].near(key)

    def _said(self, text: str, kind: type) -> tuple[object, bool] | None:
        """By exact spelling, which comes before folded keys, where it names one entity of the kind."""
        found = [x for x in self.spelled.get(text.lower(), ()) if isinstance(x, kind)]
        return (found[0], False) if len(found) == 1 else None

    def book_by_key(self, token: str) -> tuple[object, bool]:
        return self._said(token, str) or self._found(self.book_keys, plain_fold(token), 3)

    def section_by_key(self, *tokens: str) -> tuple[object, bool]:
        return self._said(" ".join(tokens), Section) or self._found(self.section_keys, "|".join(map(plain_fold, tokens)), 3 if len(tokens) == 1 else 1)


def parse(raw: str, names: Names, split_refs: bool = False) -> Query:
    """Left to right; the first rule that fits takes its tokens.

    Two-word section names anywhere; a section after the announcing word; a book or a
    one-word section at the start; numerals once there is a book, a section or a first
    numeral (chapter, then verse); anything else is free text.
    """
    toks = plain_normalize(raw, split_refs).split()
    q, rest, nums, i = Query(), [], [], 0
    while i < len(toks):
        tok, nxt = toks[i], toks[i + 1] if i + 1 < len(toks) else None
        latin = bool(re.search("[A-Za-z]", tok))
        placed = bool(q.book or q.section)
        taken: tuple[Section | str, int, bool, bool] | None = None
        if nxt and not q.section and f"{tok} {nxt}" in names.sections:
            taken = names.sections[f"{tok} {nxt}"], 2, False, False
        elif latin and nxt and not placed and (hit := names.section_by_key(tok, nxt))[0]:
            taken = hit[0], 2, True, hit[1]
        elif tok == SECTION_WORD and nxt and (two := " ".join(toks[i + 1 : i + 3])) in names.sections and len(toks) > i + 2:
            taken = names.sections[two], 3, False, False
        elif tok == SECTION_WORD and nxt in names.sections:
            taken = names.sections[nxt], 2, False, False
        elif i == 0 and not placed and tok in names.books:
            taken = names.books[tok], 1, False, False
        elif i == 0 and not placed and latin and (hit := names.book_by_key(tok))[0]:
            taken = hit[0], 1, True, hit[1]
        elif i == 0 and not placed and tok in names.sections:
            taken = names.sections[tok], 1, False, False
        elif i == 0 and not placed and latin and (hit := names.section_by_key(tok))[0]:
            taken = hit[0], 1, True, hit[1]
        if taken:
            what, n, soft, fuzzy = taken
            q = replace(q, book=what.book, section=what.name) if isinstance(what, Section) else replace(q, book=what)
            if soft:
                q = replace(q, soft=(*q.soft, *toks[i : i + n]), soft_fuzzy=q.soft_fuzzy or fuzzy)
            i += n
            continue
        number = plain_numeral(tok)
        if number is not None and len(nums) < 2 and (placed or len(nums) == 1):
            nums.append(number)
        else:
            rest.append(tok)
        i += 1
    nums += [0, 0]
    return replace(q, chapter=nums[0], verse=nums[1], words=" ".join(rest))


def resolve_soft(q: Query, top_of: Callable[[Query], dict | None]) -> Query:
    """Keeps a transliterated filter only if the corpus agrees.

    ``top_of`` gives the best row (with b and p) of a query, or None. Numbers, or an exact
    alias alone, settle it; else the whole text is tried without filter, and the filter
    stays if that finds nothing or its best row lies within the filter's scope.
    """
    if not q.soft or q.chapter or q.verse or not q.words and not q.soft_fuzzy:
        return q
    free = Query(words=" ".join([*q.soft, q.words]).strip())
    top = top_of(free)
    inside = top is None or (top["p"] == q.section if q.section else top["b"] == q.book)
    return q if inside else free


def parse_all(df: DataFrame, text: str, names: Names) -> DataFrame:
    """``df`` with the struct ``parsed`` (book, section, chapter, verse, words, soft, soft_fuzzy) of its ``text``.

    The names are dimensions, checked before they came to the driver, and go along with
    the tasks; each distinct text of an Arrow batch is parsed once. Rows are spread by
    text, since parsing costs more than their size tells. Null is parsed as "".
    """

    @F.pandas_udf("book string, section string, chapter int, verse int, words string, soft string, soft_fuzzy boolean")
    def run(texts: pd.Series) -> pd.DataFrame:
        known = {t: parse(t or "", names) for t in texts.drop_duplicates()}
        found = [known[t] for t in texts]
        return pd.DataFrame({"book": [q.book for q in found], "section": [q.section for q in found], "chapter": [q.chapter for q in found], "verse": [q.verse for q in found], "words": [q.words for q in found], "soft": [" ".join(q.soft) for q in found], "soft_fuzzy": [q.soft_fuzzy for q in found]})

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, text).withColumn("parsed", run(F.coalesce(F.col(text), F.lit(""))))


@dataclass(frozen=True)
class FolioQuery:
    book: str = ""
    leaf: int = 0
    side: int = 0
    words: str = ""


def parse_folio(raw: str, books: list[tuple[str, str]]) -> FolioQuery:
    """A tractate at the start, then a leaf with its side: a full stop or a, a colon or b, or the word for side and a letter."""
    toks = raw.split()
    names = Names(books, [])
    q, rest, i = FolioQuery(), [], 0
    if toks:
        head = plain_normalize(toks[0])
        book = names.books.get(head) or (names.book_by_key(head)[0] if re.search("[A-Za-z]", head) else None)
        if book:
            q, i = replace(q, book=str(book)), 1
    while i < len(toks):
        tok = toks[i]
        m = re.fullmatch(r"([\d]+|[א-ת]{1,3})([.:ab]?)", tok)
        leaf = plain_numeral(m[1]) if m else None
        if q.book and not q.leaf and leaf:
            q = replace(q, leaf=leaf, side={".": 1, "a": 1, ":": 2, "b": 2}.get(m[2], 0))
        elif q.leaf and plain_normalize(tok) == SIDE_WORD and i + 1 < len(toks) and (side := plain_numeral(plain_normalize(toks[i + 1]))) in (1, 2):
            q, i = replace(q, side=side), i + 1
        else:
            rest.append(plain_normalize(tok))
        i += 1
    return replace(q, words=" ".join(filter(None, rest)))
