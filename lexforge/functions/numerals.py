"""Hebrew numerals, references and the small scoring functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What each letter counts; final forms count as their letter.
VALUES = {
    "א": 1, "ב": 2, "ג": 3, "ד": 4, "ה": 5, "ו": 6, "ז": 7, "ח": 8, "ט": 9,
    "י": 10, "כ": 20, "ך": 20, "ל": 30, "מ": 40, "ם": 40, "נ": 50, "ן": 50, "ס": 60, "ע": 70,
    "פ": 80, "ף": 80, "צ": 90, "ץ": 90, "ק": 100, "ר": 200, "ש": 300, "ת": 400,
}
ONES, TENS, HUNDREDS = "אבגדהוזחט", "יכלמנסעפצ", "קרשת"


def parse_numeral(token: Column) -> Column:
    """Digits, or at most three letters of non-increasing value; null for anything else."""
    t = F.translate(token, "״\"׳'", "")
    values = F.create_map(*[F.lit(x) for kv in VALUES.items() for x in kv])
    start = F.struct(F.lit(0).alias("sum"), F.lit(1000).alias("last"))

    def add(acc: Column, ch: Column) -> Column:
        v = values[ch]
        good = v.isNotNull() & (v <= acc["last"])
        return F.struct(F.when(good, acc["sum"] + v).alias("sum"), F.when(good, v).alias("last"))

    total = F.aggregate(F.split(t, ""), start, add, lambda acc: acc["sum"])
    letters = F.when(F.length(t).between(1, 3) & total.between(1, 999), total)
    return F.when(t.rlike("^[0-9]+$"), F.expr("1") * t.try_cast("int")).otherwise(letters)


def _pick(digits: str, n: Column) -> Column:
    """The n-th letter; "" for 0."""
    return F.when(n > 0, F.substring(F.lit(digits), n.cast("int"), F.lit(1))).otherwise("")


def format_numeral(n: Column) -> Column:
    """Greedy letters from 400 down; a last 15 or 16 as 9 and 6 or 9 and 7."""
    rest = n % 400
    text = F.concat(F.repeat(F.lit("ת"), F.floor(n / 400).cast("int")), _pick(HUNDREDS, F.floor(rest / 100)), _pick(TENS, F.floor(rest % 100 / 10)), _pick(ONES, rest % 10))
    return F.regexp_replace(F.regexp_replace(text, "יה$", "טו"), "יו$", "טז")


def format_numeral_sql(n: str) -> str:
    parts = f"repeat('ת', CAST(floor({n} / 400) AS INT))"
    for digits, at in ((HUNDREDS, f"({n} % 400) // 100"), (TENS, f"({n} % 100) // 10"), (ONES, f"{n} % 10")):
        parts += f" || substring(' {digits}', CAST({at} AS INT) + 1, 1)"
    return f"regexp_replace(regexp_replace(replace({parts}, ' ', ''), 'יה$', 'טו'), 'יו$', 'טז')"


def folio_of(index: Column) -> tuple[Column, Column]:
    """(leaf, side) of a 0-based page index."""
    return (F.floor(index / 2) + 1).cast("int"), (index % 2 + 1).cast("int")


def pop_boost(links: Column) -> Column:
    """At most 50, growing with the logarithm of the link count; null counts as 0."""
    return F.least(F.lit(50.0), F.log2(1 + F.coalesce(links, F.lit(0))) * 3.5)


def pop_boost_sql(links: str) -> str:
    return f"least(50.0, log2(1 + coalesce({links}, 0)) * 3.5)"


def week_boost(section: Column, current: list[str], adjacent: list[str]) -> Column:
    return F.when(section.isin(current), 8).when(section.isin(adjacent), 4).otherwise(0)


def leaf_boost(leaf: Column, current: int) -> Column:
    """Leaf of the day: 8, its neighbours 4."""
    return F.when(leaf == current, 8).when(F.abs(leaf - current) == 1, 4).otherwise(0)


def word_bucket(n: Column) -> Column:
    return F.when(n <= 2, "1-2").when(n <= 4, "3-4").otherwise("5+")


def hebrew_ref(book: Column, chapter: Column, verse: Column) -> Column:
    return F.concat(book, F.lit(" "), format_numeral(chapter), F.lit(":"), format_numeral(verse))


def record_ref(book: Column, chapter: Column, verse: Column, i: Column) -> Column:
    return F.format_string("%s %d:%d#%d", book, chapter, verse, i)


class FloatLcg:
    """The linear congruential generator with products rounded to float64, for seeded samples on the driver."""

    def __init__(self, seed: int):
        self.state = seed

    def draw(self) -> float:
        self.state = int(float(self.state) * 1103515245.0 + 12345.0) & 0x7FFFFFFF
        return self.state / 0x7FFFFFFF
