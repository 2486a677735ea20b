"""Fielded search: filters, the lemma ladder, boosts, and the top of the result."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.functions.numerals import pop_boost, week_boost
from lexforge.functions.text import normalize, skel, word_match


@dataclass(frozen=True)
class Query:
    """What is asked for; unset parts are "" or 0. Lemma and keywords are normalized."""

    book: str = ""
    section: str = ""
    chapter: int = 0
    verse: int = 0
    lemma: str = ""
    words: str = ""
    soft: tuple[str, ...] = ()
    soft_fuzzy: bool = False


def search_columns(df: DataFrame) -> DataFrame:
    """With normalized lemma, body and verse, and their skeletons; made once and stored with an index."""
    df = df.withColumns({f"{c}_n": normalize(F.col(c)) for c in ("dh", "t", "vt")})
    return df.withColumns({f"{c}_s": skel(F.col(f"{c}_n")) for c in ("dh", "t", "vt")})


def filters(query: Query) -> Column:
    """The equality filters that are set, as one predicate that reaches the scan."""
    asked = {"b": query.book, "p": query.section, "c": query.chapter, "v": query.verse}
    return reduce(lambda a, b: a & b, [F.col(c) == x for c, x in asked.items() if x], F.lit(True))


def plain_skel(s: str) -> str:
    return " ".join(s.replace("ו", "").replace("י", "").split())


def ladder(lemma: str, strict_skeleton: bool = False) -> tuple[Column, Column]:
    """(points, kept) of the lemma query for rows with search columns.

    The first rung that holds counts: equal 1000, prefix 600, substring 400; by skeleton
    equal 800, prefix 450, substring 300; else tokens each give 120 as a word's prefix in
    the lemma, 80 in its skeleton, 15 in the body, 8 anywhere in the body, and 100 more
    if all were found in the lemma. A row without any is dropped. An empty skeleton is a
    prefix of every skeleton, unless ``strict_skeleton``.
    """
    dh, dh_s, t = F.col("dh_n"), F.col("dh_s"), F.col("t_n")
    bare = plain_skel(lemma)
    by_skel = F.lit(bool(bare) or not strict_skeleton)
    parts, in_lemma = [], []
    for tok in lemma.split(" "):
        tok_s = plain_skel(tok)
        head = (word_match(dh, F.lit(tok)) >= 0, (word_match(dh_s, F.lit(tok_s)) >= 0))
        parts.append(F.when(head[0], 120).when(head[1], 80).when(word_match(t, F.lit(tok)) >= 0, 15).when(F.contains(t, F.lit(tok)), 8).otherwise(0))
        in_lemma.append(head[0] | head[1])
    total = reduce(lambda a, b: a + b, parts)
    by_token = total + F.when(reduce(lambda a, b: a & b, in_lemma), 100).otherwise(0)
    points = (
        F.when(dh == lemma, 1000).when(F.startswith(dh, F.lit(lemma)), 600).when(F.contains(dh, F.lit(lemma)), 400)
        .when(by_skel & (dh_s == bare), 800).when(by_skel & F.startswith(dh_s, F.lit(bare)), 450).when(by_skel & F.contains(dh_s, F.lit(bare)), 300)
        .otherwise(by_token)
    )
    return points, points > 0


def search(df: DataFrame, query: Query, free: DataFrame | None = None, key: str = "rec_id", current: list[str] | None = None, adjacent: list[str] | None = None, limit: int | None = 60) -> DataFrame:
    """Scored rows of ``df`` (records with search columns), best first.

    ``free`` holds (key, score) of the keywords. With keywords a row must be among them,
    unless chapter and verse pin it, which keeps it at 1 at least; without lemma or
    keywords every row that the filters leave has 1. Boosts by week and popularity come
    after, so they never let a row in. Ties go to the smaller key.
    """
    rows = df.where(filters(query))
    score: Column = F.lit(0.0)
    if query.lemma:
        points, kept = ladder(query.lemma)
        rows, score = rows.withColumn("_l", points).where(kept), F.col("_l").cast("double")
    if query.words and free is not None:
        pinned = query.chapter and query.verse
        rows = rows.join(free.select(key, F.col("score").alias("_f")), key, "left" if pinned else "inner")
        score = F.coalesce(score + F.col("_f"), F.greatest(score, F.lit(1.0)))
    if not query.lemma and not query.words:
        score = F.lit(1.0)
    boost = week_boost(F.col("p"), current or [], adjacent or [])
    scored = rows.withColumn("_s", score).where("_s > 0").withColumn("score", F.round(F.col("_s") + F.coalesce(boost, F.lit(0)) + pop_boost(F.col("lk")), 6)).drop("_s", "_l", "_f")
    ordered = scored.orderBy(F.desc("score"), key)
    return ordered.limit(limit) if limit else ordered


def top_by(df: DataFrame, per: str, score: str, key: str, limit: int) -> DataFrame:
    """The best ``limit`` rows of each ``per``; Spark prunes each partition before it shuffles (window group limit)."""
    from pyspark.sql import Window

    rn = F.row_number().over(Window.partitionBy(per).orderBy(F.desc(score), key))
    return df.withColumn("_rn", rn).where(F.col("_rn") <= limit).drop("_rn")


def cascade(sections: DataFrame, book: str = "") -> DataFrame:
    """The sections on offer once a book is chosen; all without one."""
    return sections.where(F.col("b") == book) if book else sections
