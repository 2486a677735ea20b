"""Problem 2: one consistent spelling for text that looks the same.

Method: DuckDB runs inside each Arrow partition; ``translate``, ``nfc_normalize`` and
regular expressions in embedded SQL map compatibility forms, invisible characters and
look-alikes. A value that holds none of the characters concerned only passes
``nfc_normalize``.

Plain spelling:

* full-width, mathematical, presentation and letter-like forms become the ordinary
  letters and digits (rule: Unicode's compatibility decompositions of letters and
  digits; punctuation, circled, raised and lowered signs are left);
* Hebrew letters stand apart from their points, which come in canonical order;
* accented Latin and Cyrillic letters are single characters;
* every blank but line breaks is U+0020;
* characters without a trace of their own are gone, control characters among them;
* a word that mixes Latin, Cyrillic, Greek, Armenian or Cherokee letters gets the script
  of most of its letters, as far as look-alikes exist.

Pointed and unpointed text stay apart, and punctuation is never changed.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Yiddish digraphs, which have no decomposition of their own.
DIGRAPHS = {"װ": "וו", "ױ": "וי", "ײ": "יי"}

# Look-alikes as (Latin, Cyrillic, Greek); "-" where a script has none. Of two
# rows with one letter the later counts. They go before CONFUSABLE.
LOOKALIKES = """
w ѡ ω|n - η|l ӏ -
A А Α|B В Β|C С -|E Е Ε|H Н Η|I І Ι|J Ј -|K К Κ|M М Μ|N - Ν|O О Ο|P Р Ρ|S Ѕ -|T Т Τ|X Х Χ|Y У Υ|Z - Ζ
a а α|c с -|d ԁ -|e е -|h һ -|i і ι|j ј -|k к κ|m м -|n п -|o о ο|p р ρ|q ԛ -|r г -|s ѕ -|t т τ|u - υ|v ѵ ν|w ԝ -|x х χ|y у γ|b Ь -|ç ҫ -|ë ё -
"""

# Characters that leave no trace of their own beside those of category Cf.
TRACELESS = "͏ᅟᅠ឴឵᠋᠌᠍᠏ㅤﾠ"

# Control characters but the tab, which is a blank, and line breaks.
CONTROLS = (*range(0x01, 0x09), *range(0x0E, 0x20), *range(0x7F, 0x85), *range(0x86, 0xA0))

# Kinds of compatibility form that look like the ordinary letter.
SAME_LOOK = ("<wide>", "<narrow>", "<font>", "<isolated>", "<initial>", "<medial>", "<final>", "<compat>")

# Letters whose compatibility decomposition is not how they are written
# (Thai and Lao sara am, Lao digraphs, Tibetan, Hangul letters), as ranges.
ORDINARY = ((0x0E00, 0x0EFF), (0x0F00, 0x0FFF), (0x3130, 0x318F))

#: Scripts whose letters are mixed up in words, with the code points of theirs that are looked at.
SCRIPTS = {
    "Latin": (*range(0x41, 0x5B), *range(0x61, 0x7B)),
    "Cyrillic": tuple(range(0x400, 0x530)),
    "Greek": tuple(range(0x370, 0x400)),
    "Armenian": tuple(range(0x531, 0x587)),
    "Cherokee": tuple(range(0x13A0, 0x13F6)),
}

# The letters of SCRIPTS that Unicode's confusables data (16.0, as ICU 77.1 has it) finds
# confusable with the same single letter, marks aside; capitals and others apart, all groups of two scripts or more.
CONFUSABLE = """
AΑАᎪ BΒВᏴ CϹСҪᏟ DᎠ EΕЕᎬ FϜ GԌᏀᏳ HΗНҢӇӉᎻ IΙІӀ JͿЈᎫ KΚКҚҞᏦ LᏞ MΜϺМӍᎷ NΝ OΘΟϴОѲӨՕᎾᏫ PΡРᏢ RᎡᏒ SЅՏᏕᏚ TΤТҬᎢ UՍᏌ VѴᏙ WԜᎳᏔ XΧХҲ YΥϒУҮҰᎩᎽ ZΖᏃ ͰᎨᎰ ͶИҊ ΓГҒᎱ ΛЛӅ ΠП ΦФՓ ΨѰ БЬѢҌᏏ ѠѼᏇ ԐᏋ
aαа bѣҍ cϲсҫ dԁ eеҽҿ fք gց hћһհ iͺιіӏ jϳј nηոռ oοσоѳөօ pρϱр qԛգզ rгғ sѕ uυս vνѵ wѡѽԝա xх yγуүұ ͷи δծ εϵєԑ κϰкқҟ πϖп τтҭ φϕф ψѱ
"""

#: Code points up to here are looked at; beyond lie no compatibility forms of letters.
LAST = 0x1FBFF


@cache
def tables() -> tuple[dict[str, str], dict[str, str], str, str]:
    """(single-letter forms, forms of several letters, blanks, traceless)."""
    one: dict[str, str] = {}
    many: dict[str, str] = dict(DIGRAPHS)
    blanks, gone = ["\t", " "], list(TRACELESS) + [chr(c) for c in (*range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0), *CONTROLS)]
    for cp in (*range(0x80, 0xD800), *range(0xE000, LAST), *range(0xE0001, 0xE0080)):
        ch = chr(cp)
        kind = unicodedata.category(ch)
        if kind == "Zs":
            blanks.append(ch)
        elif kind == "Cf" and not 0x600 <= cp <= 0x605 and cp not in (0x6DD, 0x70F, 0x8E2):
            gone.append(ch)
        elif unicodedata.decomposition(ch).startswith(SAME_LOOK) and not any(a <= cp <= b for a, b in ORDINARY):
            plain = unicodedata.normalize("NFKC", ch)
            letters = all(unicodedata.category(x)[0] in "LM" or x.isdecimal() for x in plain)
            if plain != ch and letters and (kind[0] in "LN" or 0x2E80 <= cp <= 0x2FDF):
                (one if len(plain) == 1 else many)[ch] = plain
    return one, many, "".join(dict.fromkeys(blanks)), "".join(dict.fromkeys(gone))


def _class(chars: str) -> str:
    """A regular-expression class of ``chars``, as ranges."""
    points, parts = sorted(set(map(ord, chars))), []
    while points:
        n = 1
        while n < len(points) and points[n] == points[0] + n:
            n += 1
        parts.append(f"\\x{{{points[0]:x}}}" + (f"-\\x{{{points[n - 1]:x}}}" if n > 1 else ""))
        points = points[n:]
    return "".join(parts)


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lookalikes(spark: SparkSession | None = None) -> dict[str, tuple[str, str]]:
    """For each script the letters of other scripts that look like one of its own, and those own letters.

    Two letters look alike if they are in one group of CONFUSABLE; of several the one
    with the lowest code point counts. They are the same in every session; ``spark`` isn't read.
    """
    rows = [x.split() for line in LOOKALIKES.split("\n") for x in line.split("|") if x]
    script = {chr(c): name for name, points in SCRIPTS.items() for c in points}
    out = {}
    for at, name in enumerate(SCRIPTS):
        found: dict[str, str] = {}
        for group in CONFUSABLE.split():
            if own := [x for x in group if script[x] == name]:
                found |= {x: min(own) for x in group if script[x] != name}
        if at < 3:
            found |= {x: row[at] for row in rows if row[at] != "-" for k, x in enumerate(row) if k != at and x != "-"}
        out[name] = "".join(found), "".join(found.values())
    return out


MACROS = """
CREATE OR REPLACE MACRO lf_single(s) AS CASE WHEN regexp_matches(s, {dirty}) THEN translate(s, {src}, {dst}) ELSE s END;
CREATE OR REPLACE MACRO lf_several(s) AS CASE WHEN regexp_matches(s, {several})
  THEN array_to_string(list_transform(string_split(s, ''), lambda x: coalesce(getvariable('lf_many')[x], x)), '') ELSE s END;
CREATE OR REPLACE MACRO lf_word(w) AS CASE WHEN NOT regexp_matches(w, {mixed}) THEN w ELSE {by_script} END;
CREATE OR REPLACE MACRO lf_words(s) AS CASE WHEN regexp_matches(s, {mixed})
  THEN array_to_string(list_transform(regexp_extract_all(s, '[\\p{{L}}\\p{{M}}]+|[^\\p{{L}}\\p{{M}}]+'), lambda w: lf_word(w)), '') ELSE s END;
"""


def connect(alike: dict[str, tuple[str, str]]) -> duckdb.DuckDBPyConnection:
    """A DuckDB of one thread with the steps of plain spelling as macros; one for each Arrow partition. ``alike``: see ``lookalikes``."""
    one, many, blanks, gone = tables()
    con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "600MB"})
    con.execute("SET VARIABLE lf_many = MAP {" + ", ".join(f"{_quoted(k)}: {_quoted(v)}" for k, v in many.items()) + "}")
    src, dst = "".join(one) + blanks.replace(" ", "") + gone, "".join(one.values()) + " " * len(blanks.replace(" ", ""))
    counts = {name: f"length(regexp_replace(w, '[^\\p{{{name}}}]', '', 'g'))" for name in alike}
    names, cases = list(alike), ""
    for i, name in enumerate(names):
        # Of equally many the earlier script wins.
        most = " AND ".join(f"{counts[name]} >= {counts[x]}" for x in names[i + 1 :]) or "true"
        cases += f" WHEN {most} THEN translate(w, {_quoted(alike[name][0])}, {_quoted(alike[name][1])})"
    by_script = f"CASE{cases} ELSE w END"
    con.execute(MACROS.format(dirty=_quoted(f"[{_class(src)}]"), src=_quoted(src), dst=_quoted(dst), several=_quoted(f"[{_class(''.join(many))}]"), mixed=_quoted(mixed_pattern()), by_script=by_script))
    return con


def mixed_pattern() -> str:
    """A word in which letters of two of the scripts follow each other."""
    return "|".join(f"\\p{{{a}}}\\p{{M}}*\\p{{{b}}}" for a in SCRIPTS for b in SCRIPTS if a != b)


def plain_sql(values: str, rest: str) -> str:
    """SQL for the rows of ``values``, with their column ``value`` and the columns ``rest``, and ``plain``.

    One subquery for each step: a macro inside a macro would be expanded, and run, many times over.
    """
    steps = ("lf_single(value)", "lf_several(plain)", "nfc_normalize(plain)", "lf_several(plain)", "lf_words(plain)")
    for step in steps:
        values = f"(SELECT {rest}, value, {step} AS plain FROM {values})"
    return values


def duck(batches: Iterator[pa.RecordBatch], sql: str, alike: dict[str, tuple[str, str]]) -> Iterator[pa.RecordBatch]:
    """``sql`` over each Arrow batch, registered as ``batch``."""
    con = connect(alike)
    try:
        for batch in batches:
            if not batch.num_rows:
                continue
            con.register("batch", pa.table(batch))
            yield from con.sql(sql).to_arrow_table().to_batches(max_chunksize=20_000)
            con.unregister("batch")
    finally:
        con.close()


def plain_spelling(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Each non-null value of ``fields`` as (``key``, field, value, plain, changed).

    Null values have no row; empty ones are plain; repeated keys keep all their rows;
    other columns of ``df`` aren't read. An empty table gives an empty one.
    """
    kind, named, values = _stacked(df, key, fields)
    sql = f"SELECT k, field, value, plain, plain <> value AS changed FROM {plain_sql(values, 'k, field')}"
    alike = lookalikes()
    return named.mapInArrow(lambda it: duck(it, sql, alike), f"k {kind}, field string, value string, plain string, changed boolean").withColumnRenamed("k", key)


def _stacked(df: DataFrame, key: str, fields: list[str]) -> tuple[str, DataFrame, str]:
    """(the key's type, key and fields under names of our own, SQL that stacks the fields' values)."""
    named = df.select(F.col(key).alias("k"), *[F.col(c).cast("string").alias(f"f{i}") for i, c in enumerate(fields)])
    union = " UNION ALL ".join(f"SELECT k, {_quoted(c)} AS field, f{i} AS value FROM batch WHERE f{i} IS NOT NULL" for i, c in enumerate(fields))
    return named.schema["k"].dataType.simpleString(), named, f"({union})"


def not_plain(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(``key``, field) of the values that aren't in plain spelling; see plain_spelling."""
    kind, named, values = _stacked(df, key, fields)
    sql = f"SELECT k, field FROM {plain_sql(values, 'k, field')} WHERE plain <> value"
    alike = lookalikes()
    return named.mapInArrow(lambda it: duck(it, sql, alike), f"k {kind}, field string").withColumnRenamed("k", key)
