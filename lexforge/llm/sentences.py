"""Problem 3: sentences of texts in any language and script.

Method: document-centred disambiguation with a corpus fallback, and terminators by
script. A first pass over all texts counts, for every token before a full stop, what
follows it (end of text or line, a small letter, a capital, a digit, another letter) and
how often short capitalised tokens stand without a stop. From that come three kinds of
abbreviation:

* open: never closes a sentence ("Dr.", initials); no boundary after it;
* reference: mostly before a number ("vol. 2"); no boundary before a number;
* closing: runs on before a small letter and also ends texts ("etc."); it closes the
  sentence if a capital follows.

In the second pass each ambiguous full stop is settled by unambiguous occurrences in the
same text (the token with its stop before a small letter, a digit or a comma; the next
word with a small letter elsewhere, or with its capital amid a sentence), and where the
text has none by the corpus.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.llm.plain import tables
from lexforge.plans.lineage import cut

# Stops that are always stops, by script (Latin and others; Hebrew;
# Arabic; Devanagari; Chinese and Japanese; Armenian, Ethiopic, Khmer, Myanmar, Tibetan).
SURE = "!?" + "׃" + "؟۔" + "।॥" + "。！？｡" + "։።៖។၊။།"
# Stops that have other uses too.
DOTS = ".…．"
# Opening and closing signs; those of quotations, then brackets.
QUOTES = {"«": "»", "“": "”", "„": "“", "「": "」", "『": "』", "‹": "›"}
BRACKETS = {"(": ")", "[": "]", "{": "}", "（": "）", "【": "】", "〔": "〕"}
# Line breaks.
BREAKS = "\n\r\x0b\x0c\x85  "
# Scripts with neither blanks between words nor stops (Thai, Lao).
BLANK_ENDS = "ก-๎ກ-ໍ"
# Scripts without blanks between words, whose quotations stand inside a sentence.
NO_BLANKS = re.compile("[぀-ヿ㐀-鿿ก-๎ກ-ໍ]")
# Signs that leave no trace; looked through when the next sign is sought.
UNSEEN = frozenset("­͏؜᠎​‌‍‎‏⁠⁡⁢⁣⁤﻿")
# Hebrew points and accents, dropped from tokens.
POINTS = (*range(0x591, 0x5BE), 0x5BF, 0x5C1, 0x5C2, 0x5C4, 0x5C5, 0x5C7)
#: Tokens are compared without points and unseen signs, and with compatibility forms as ordinary letters.
PLAIN = {ord(k): v for k, v in tables()[0].items()} | dict.fromkeys([*POINTS, *map(ord, UNSEEN)])

#: Closing signs that may follow a quotation's last stop inside it.
INNER_CLOSERS = frozenset('"»”」』)]')
_PAIRS = QUOTES | BRACKETS
_CLOSERS = frozenset(_PAIRS.values())
_MARKS = re.compile("[" + re.escape("".join({*SURE, *DOTS})) + "]+|[" + re.escape('"' + "".join({*_PAIRS, *_CLOSERS})) + "]")
_LINES = re.compile(f"[^{BREAKS}]+")
_DOT = re.compile(r"(?<![.…])\.(?![.…])")
_SHORT = re.compile(r"(?<![^\W_])[A-ZÀ-ÖØ-ÞΑ-ΩЀ-Я][^\W\d_]{0,2}(?![\w.'’])")
_BLANK = re.compile(rf"(?<=[{BLANK_ENDS}\d])\s+(?=[{BLANK_ENDS}])")
_THAI = re.compile(f"[{BLANK_ENDS}]")
_TOKEN = re.compile(r"[^\s.…．!?؟।。׃\"«»“”„‹›()\[\]{}<>,;:]+$")
_UNDOTTED = re.compile(r"[^\s.…．!?؟।。׃\"«»“”„‹›()\[\]{}<>,;:]+(?![^\s.…．!?؟।。׃\"«»“”„‹›()\[\]{}<>,;:]|\.)")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_AMID = re.compile(r"(?<=[\w,;] )[^\W\d_a-zа-яё][^\W\d_]*(?:['’-][^\W\d_]+)*")
_INNER = re.compile("[" + re.escape("".join({*SURE, *DOTS})) + r"]+(?=\s|[^\W\d_])")

#: A lexicon of up to so many abbreviations is sent to every task; from a larger one each text gets its own by a join.
BROADCAST = 200_000
#: A token that never closes has this part of the share of ends that all stops have (counted as 0.1 at most); one that closes has this share at ends and before small letters each.
RARELY, OFTEN = 0.1, 0.02


def _next(t: str, i: int, end: int) -> tuple[str, int, bool]:
    """The next sign seen from i on (or ""), its place, and whether a blank lies before it."""
    blank = False
    while i < end:
        ch = t[i]
        if ch.isspace():
            blank = True
        elif ch not in UNSEEN:
            return ch, i, blank
        i += 1
    return "", end, blank


def _seen(t: str, i: int) -> str:
    """The next sign seen from i on within the line, or ""."""
    while i < len(t):
        ch = t[i]
        if ch in BREAKS:
            return ""
        if not ch.isspace() and ch not in UNSEEN:
            return ch
        i += 1
    return ""


def _token(t: str, at: int, low: int) -> str:
    """The run of letters and the like right before ``at`` (no further back than ``low``), without points; looked for in ever longer pieces, so that its own length is all it costs."""
    far = 32
    while True:
        begin = max(low, at - far)
        m = _TOKEN.search(t[max(begin, t.rfind(" ", begin, at) + 1) : at])
        if not m:
            return ""
        if len(m[0]) < at - begin or begin == low:
            return m[0].translate(PLAIN)
        far *= 2


def _kind(ch: str) -> str:
    return "end" if not ch else "dig" if ch.isdigit() else "up" if ch.isupper() else "low" if ch.islower() else "let" if ch.isalpha() else "oth"


def evidence(texts: Iterator[str]) -> Counter:
    """(token, what follows its full stop) or (short capitalised token, "bare"): how often."""
    found: Counter = Counter()
    for t in texts:
        if "." in t:
            for m in _DOT.finditer(t):
                token = _token(t, m.start(), 0)
                if token and not token[-1].isdigit():
                    found[token, _kind(_seen(t, m.end()))] += 1
        if not t.isupper() and not t.islower() and (names := _SHORT.findall(t)):
            found.update((x, "bare") for x in names)
    return found


def _divergence(p: float, base: float) -> float:
    """Of shares p from base: exp(-n * divergence) bounds the chance that n draws have a share of p or less."""
    return (p * math.log(p / base) if p else 0.0) + (1 - p) * math.log((1 - p) / (1 - base))


def lexicon(counted: list[tuple[str, int, int, int, int, int, int, int]], share: float | None = None) -> tuple[frozenset, frozenset, frozenset]:
    """(open, reference, closing) abbreviations from rows of (token, end, low, up, dig, let, oth, bare); ``share`` of ends in all stops, if the rows aren't all."""
    if share is None:
        share = sum(r[1] for r in counted) / max(1, sum(sum(r[1:7]) for r in counted))
    base = min(0.5, max(0.02, share))
    opened, reference, closing = set(), set(), set()
    for token, end, low, up, dig, let, oth, bare in counted:
        n = end + low + up + dig + let + oth
        short = len(token) <= 3 and token[0].isupper()
        if n and end <= RARELY * min(0.1, share) * n and (n * _divergence(end / n, base) > -math.log(1e-4) if not short else n >= 2 and bare < n):
            opened.add(token)
        if n >= 3 and dig >= 0.5 * n:
            reference.add(token)
        if n and end >= OFTEN * n and low >= OFTEN * n:
            closing.add(token)
    return frozenset(opened), frozenset(reference), frozenset(closing)


class Document:
    """What one text says unambiguously; gathered once, and only if some full stop needs it."""

    def __init__(self, text: str):
        self.text = text
        self._abbreviated: Counter | None = None
        self._ended: frozenset = frozenset()
        self._plain: frozenset | None = None
        self._bare: frozenset = frozenset()
        self._small: frozenset = frozenset()
        self._capital: Counter = Counter()

    def _gather(self) -> None:
        t, found, ended = self.text, Counter(), set()
        for m in _DOT.finditer(t):
            ch = t[m.end() : m.end() + 1]
            if ch.isspace():
                ch = t[m.end() + 1 : m.end() + 2]
            if ch in (",", ";") or ch.isdigit() or ch.islower():
                found[_token(t, m.start(), 0)] += 1
            elif not _seen(t, m.end()):
                ended.add(_token(t, m.start(), 0))
        self._abbreviated, self._ended = found, frozenset(ended)
        self._small = frozenset(w for w in _WORD.findall(t) if w[0].islower())
        self._capital = Counter(_AMID.findall(t))
        self._bare = frozenset(_SHORT.findall(t))

    def abbreviated(self, token: str, here: bool) -> bool:
        """The token stands with its stop before a small letter, digit or comma; ``here`` it does so itself, which doesn't count."""
        if self._abbreviated is None:
            self._gather()
        return self._abbreviated[token] > here

    def ended(self, token: str) -> bool:
        """The token's stop also ends a line of the text."""
        if self._abbreviated is None:
            self._gather()
        return token in self._ended

    def plain(self, token: str) -> bool:
        """The text also has the token, of any script, as a word without a stop."""
        if self._plain is None:
            self._plain = frozenset(m[0].translate(PLAIN) for m in _UNDOTTED.finditer(self.text))
        return token in self._plain

    def bare(self, token: str) -> bool:
        """The text also has the short token without a stop."""
        if self._abbreviated is None:
            self._gather()
        return token in self._bare

    def proper(self, word: str) -> bool:
        """The text has the word with its capital amid a sentence, never with a small letter."""
        if self._abbreviated is None:
            self._gather()
        return word.lower() not in self._small and self._capital[word] > 0

    def common(self, word: str) -> bool:
        """The text has the word with a small letter, never with its capital amid a sentence."""
        if self._abbreviated is None:
            self._gather()
        return word.lower() in self._small and not self._capital[word]


class Splitter:
    """Cuts texts into sentences with the abbreviations of a corpus."""

    def __init__(self, opened: frozenset = frozenset(), reference: frozenset = frozenset(), closing: frozenset = frozenset()):
        self.opened, self.reference, self.closing = opened, reference, closing

    def _dot_ends(self, doc: Document, at: int, after: int, line: tuple[int, int]) -> bool:
        """Whether the full stop at ``at`` ends its sentence; ``after`` comes behind it."""
        t = doc.text
        ch, where, blank = _next(t, after, line[1])
        if not ch:
            return True
        before = t[at - 1] if at > line[0] else ""
        if ch.isdigit() and not blank and before.isdigit():
            return False
        kind = _kind(ch)
        if kind == "oth":
            return ch in _PAIRS or ch == '"' and blank
        if kind == "low":
            return False
        token = _token(t, at, line[0])
        if not token or token[-1].isdigit():
            return blank or kind != "dig"
        if kind == "dig":
            return not (token in self.reference or token in self.opened or doc.abbreviated(token, True)) and (blank or len(token) > 1)
        if kind == "let":
            if doc.abbreviated(token, False) and not doc.ended(token) and not doc.plain(token) or token in self.opened:
                return False
            return blank or len(token) > 1
        word = _WORD.match(t, where)
        if doc.abbreviated(token, False) and word and doc.proper(word[0]):
            return False
        if word and (doc.ended(token) or len(token) <= 3 and doc.bare(token)) and doc.common(word[0]):
            return True
        if token in self.opened:
            return False
        if token in self.closing:
            return True
        return not (len(token) <= 2 and token[0].isupper() and not doc.bare(token))

    def _regions(self, t: str, marks: list[re.Match]) -> list[tuple[int, int, bool, int]]:
        """Matched (start, end behind the closing sign, is a quotation, end of what lies inside but blanks and closing signs), outermost only."""
        stack: list[tuple[str, int, bool]] = []
        open_: Counter = Counter()
        found: list[tuple[int, int, bool]] = []

        def close(ch: str, i: int) -> None:
            while True:
                want, start, quote = stack.pop()
                open_[want] -= 1
                if want == ch:
                    found.append((start, i + 1, quote))
                    return

        for m in marks:
            ch = m[0]
            i = m.start()
            if ch in _PAIRS and not (ch == "“" and open_["“"]):
                stack.append((_PAIRS[ch], i, ch in QUOTES))
                open_[_PAIRS[ch]] += 1
            elif ch == '"':
                left, right = t[i - 1 : i] if i else "", t[i + 1 : i + 2]
                if left.isalpha() and right.isalpha() or left and right and "֑" <= left <= "ת" and "א" <= right <= "ת":
                    continue
                if open_['"']:
                    close('"', i)
                elif not right.isspace() and right and (not left or left.isspace() or not left.isalnum()):
                    stack.append(('"', i, True))
                    open_['"'] += 1
            elif open_[ch]:
                close(ch, i)
        found.sort()
        outer: list[tuple[int, int, bool, int]] = []
        for start, end, quote in found:
            if not outer or start >= outer[-1][1]:
                tail = end - 1
                while tail > start + 1 and (t[tail - 1].isspace() or t[tail - 1] in INNER_CLOSERS):
                    tail -= 1
                outer.append((start, end, quote, tail))
        return outer

    def _line(self, doc: Document, line: tuple[int, int]) -> list[int]:
        """Places behind the sentences that end within the line."""
        t = doc.text
        marks = list(_MARKS.finditer(t, *line))
        ends: list[int] = []
        regions = self._regions(t, [m for m in marks if m[0][0] not in SURE and m[0][0] not in DOTS]) if any(m[0] in _PAIRS or m[0] == '"' for m in marks) else []
        k, several = 0, {}
        for m in marks:
            ch = m[0]
            if ch[0] not in SURE and ch[0] not in DOTS:
                continue
            at, after = m.span()
            while k < len(regions) and regions[k][1] <= at:
                k += 1
            if k < len(regions) and regions[k][0] < at:
                start, close, quote, tail = regions[k]
                if not quote or after < tail:
                    continue
                nxt, _, blank = _next(t, close, line[1])
                kind = _kind(nxt)
                if k not in several:
                    first_inside = _INNER.search(t, start + 1, close)
                    several[k] = first_inside.end() if first_inside else close
                if kind == "up" or kind == "let" and blank and not NO_BLANKS.match(nxt) and several[k] >= at:
                    ends.append(close)
                continue
            if any(x in SURE for x in ch):
                nxt, _, _ = _next(t, after, line[1])
                if nxt not in (",", ";"):
                    ends.append(after)
            elif len(ch) > 1 or ch == "…":
                nxt, _, _ = _next(t, after, line[1])
                if _kind(nxt) in ("up", "end"):
                    ends.append(after)
            elif self._dot_ends(doc, at, after, line):
                ends.append(after)
        if _THAI.search(t, *line):
            starts = [r[0] for r in regions]
            for m in _BLANK.finditer(t, *line):
                r = bisect_left(starts, m.start()) - 1
                if (r < 0 or m.start() >= regions[r][1]) and self._of_thai(t, m.start(), line[0]):
                    ends.append(m.start())
            ends.sort()
        return ends

    @staticmethod
    def _of_thai(t: str, at: int, low: int) -> bool:
        """The last letter before ``at`` is of a script in which blanks end sentences."""
        while at > low:
            at -= 1
            if _THAI.match(t[at]):
                return True
            if t[at].isalpha():
                return False
        return False

    def spans(self, t: str) -> list[tuple[int, int]]:
        """(start, end) of each sentence; together they cover all of ``t`` but blanks."""
        found: list[tuple[int, int]] = []
        doc = Document(t)
        for m in _LINES.finditer(t):
            low, high = m.span()
            at, first = low, len(found)
            for end in [*self._line(doc, (low, high)), high]:
                a, b = at, end
                while a < b and t[a].isspace():
                    a += 1
                while b > a and t[b - 1].isspace():
                    b -= 1
                if a < b:
                    if len(found) > first and not any(x.isalnum() for x in t[a:b]):
                        found[-1] = (found[-1][0], b)
                    else:
                        found.append((a, b))
                at = max(at, end)
        return found


CONTEXTS = ("end", "low", "up", "dig", "let", "oth", "bare")
KINDS = ("opened", "reference", "closing")


def qualified(df: DataFrame, text: str) -> DataFrame:
    """(token, opened, reference, closing) of all abbreviations in the texts of ``df``; counts are summed before they are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            rows = [(*k, n) for k, n in held.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["token", "follows", "n"])

        for b in batches:
            held.update(evidence(x for x in b.column(0).to_pylist() if x))
            if len(held) > 200_000:
                yield flush()
        yield flush()

    each = df.select(F.col(text).cast("string").alias("t")).mapInArrow(count, "token string, follows string, n bigint")
    rows = cut(each.groupBy("token").agg(*[F.sum(F.when(F.col("follows") == c, F.col("n")).otherwise(0)).alias(c) for c in CONTEXTS]), "dotted-tokens")
    dotted = " + ".join(f"`{c}`" for c in CONTEXTS[:-1])
    ends, total = rows.agg(F.sum("end"), F.sum(F.expr(dotted))).first()
    share = (ends or 0) / max(1, total or 0)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = lexicon(list(zip(*[c.to_pylist() for c in b.columns])), share)
            which = list(frozenset().union(*found))
            yield pa.RecordBatch.from_arrays([pa.array(which, pa.string()), *[pa.array([x in kind for x in which], pa.bool_()) for kind in found]], names=["token", *KINDS])

    settled = rows.where(F.expr(dotted) >= 2).select("token", *CONTEXTS).mapInArrow(settle, "token string, opened boolean, reference boolean, closing boolean")
    return cut(settled, "abbreviations")


def _sets(rows: list) -> tuple[frozenset, frozenset, frozenset]:
    return tuple(frozenset(r[0] for r in rows if r[k]) for k in (1, 2, 3))


def corpus_lexicon(df: DataFrame, text: str) -> tuple[frozenset, frozenset, frozenset]:
    """The abbreviations of all texts of ``df``."""
    return _sets([tuple(r) for r in qualified(df, text).collect()])


def _own_lexicons(named: DataFrame, known: DataFrame) -> DataFrame:
    """(key, t, known): each text with those of the abbreviations ``known`` that it has before a full stop."""
    texts = cut(named.withColumn("_id", F.monotonically_increasing_id()), "texts")

    def dotted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids: list[int] = []
            found: list[str] = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = {_token(t, m.start(), 0) for m in _DOT.finditer(t)} if t else set()
                ids += [i] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.string())], names=["_id", "token"])

    each = texts.select("_id", "t").mapInArrow(dotted, "_id bigint, token string").join(known, "token")
    own = each.groupBy("_id").agg(F.collect_list(F.struct("token", *KINDS)).alias("known"))
    return texts.join(own, "_id", "left").select("key", "t", "known")


def sentences(df: DataFrame, key: str, text: str, broadcast: int = BROADCAST) -> DataFrame:
    """The sentences of every text: ``key``, sent_no (from 1), start_pos, end_pos (code points).

    Null, empty and blank texts have none. Repeated rows and keys each get their own
    rows; an empty table gives an empty one; other columns aren't read. Texts are read
    whole, twice: once for the corpus' abbreviations, once to be cut; nothing is
    shuffled but one count for each token and partition, unless there are more than
    ``broadcast`` abbreviations, which are then joined to the texts that have them.
    """
    known = qualified(df, text)
    named = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("t"))
    few = known.limit(broadcast + 1).collect()
    splitter = Splitter(*_sets([tuple(r) for r in few])) if len(few) <= broadcast else None
    few = None
    if splitter is None:
        named = _own_lexicons(named, known)
    kind = named.schema["key"].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            which: list[int] = []
            no: list[int] = []
            start: list[int] = []
            end: list[int] = []
            own = b.column(2).to_pylist() if splitter is None else None
            for i, t in enumerate(b.column(1).to_pylist()):
                if t:
                    cutter = splitter or Splitter(*_sets([(r["token"], *[r[k] for k in KINDS]) for r in own[i] or ()]))
                    for k, (x, y) in enumerate(cutter.spans(t), 1):
                        which.append(i)
                        no.append(k)
                        start.append(x)
                        end.append(y)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(which, pa.int64())), *[pa.array(x, pa.int32()) for x in (no, start, end)]], names=["key", "sent_no", "start_pos", "end_pos"])

    return named.mapInArrow(split, f"key {kind}, sent_no int, start_pos int, end_pos int").withColumnRenamed("key", key)
