"""Corpus building: unnesting with ordinals, lemma splits, and enrichment joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexforge.functions.text import clean, strip_lemma

#: Verse and folio records; a missing section or provenance is null.
VERSE_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("b", "bh", "p", "ph")] + [T.StructField(c, T.IntegerType()) for c in "cvi"] + [T.StructField(c, T.StringType()) for c in ("dh", "t", "vt")] + [T.StructField("lk", T.LongType())])
FOLIO_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("b", "bh")] + [T.StructField(c, T.IntegerType()) for c in "dali"] + [T.StructField(c, T.StringType()) for c in ("dh", "t", "vt")] + [T.StructField("lk", T.LongType()), T.StructField("cx", T.IntegerType())])
#: What the builders expect of the text, index, link and calendar sources.
TEXT_SCHEMA = "versions array<struct<text: array<array<array<string>>>>>"
INDEX_SCHEMA = "alts struct<Parasha: struct<nodes: array<struct<title: string, heTitle: string, wholeRef: string>>>>"
LINKS_SCHEMA = "array<struct<anchorRef: string>>"
CALENDAR_SCHEMA = "calendar_items array<struct<title: struct<en: string>, displayValue: struct<en: string>>>"


#: Tasks over which the records of one book are dealt where its sections can't be broadcast.
SALT = 64


def unnest(df: DataFrame, nested: str, ordinals: tuple[str, ...], value: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each innermost element, with 1-based ordinals of every level.

    Empty and null elements are counted and then left out, so ordinals keep their gaps.
    """
    kept = list(keep)
    df = df.select(*keep, F.col(nested).alias("_e"))
    for o in ordinals:
        df = df.select(*kept, F.posexplode("_e").alias("_p", "_e")).withColumn(o, F.col("_p") + 1).drop("_p")
        kept.append(o)
    return df.where(F.length("_e") > 0).select(*kept, F.col("_e").alias(value))


def bold_lemma(html: Column) -> tuple[Column, Column]:
    """(lemma, body) of a comment that may begin with a bold lemma; without one the lemma is ""."""
    found = F.regexp_extract(html, r"^\s*<b>(.*?)</b>", 1)
    return strip_lemma(clean(found)), clean(F.regexp_replace(html, r"^\s*<b>(.*?)</b>", ""))


def dash_lemma(html: Column) -> tuple[Column, Column]:
    """(lemma, body) cut at the first dash between blanks; without one the lemma is ""."""
    text = clean(html)
    halves = F.split(text, r"\s[–-]\s", 2)
    cut = F.size(halves) == 2
    return F.when(cut, strip_lemma(halves[0])).otherwise(""), F.when(cut, clean(F.get(halves, F.lit(1)))).otherwise(text)


def lemma_and_body(html: Column) -> tuple[Column, Column]:
    """By bold lemma where there is one, else by dash."""
    bold = html.rlike(r"^\s*<b>.*?</b>")
    (a, b), (c, d) = bold_lemma(html), dash_lemma(html)
    return F.when(bold, a).otherwise(c), F.when(bold, b).otherwise(d)


def section_bounds(ref: Column) -> tuple[Column, Column, Column, Column]:
    """(start chapter, start verse, end chapter, end verse) at the end of a reference; a missing end chapter is the start's."""
    pat = r"(\d+):(\d+)-(?:(\d+):)?(\d+)$"
    g = [F.regexp_extract(ref, pat, i).try_cast("int") for i in (1, 2, 3, 4)]
    return g[0], g[1], F.coalesce(g[2], g[0]), g[3]


def section_join(records: DataFrame, sections: DataFrame, most: int = 100_000) -> DataFrame:
    """Each record (b, c, v) with the section (p, ph) of its book it lies in.

    The first section in order whose bounds hold it, inclusive; the book's last section
    if none does; null where the book has none. A book's intervals come as one array
    (no row multiplies, however they overlap): the dimension is checked against ``most``
    rows before it is broadcast; beyond that the join is a shuffled one, and the records
    of a book are dealt over ``SALT`` tasks, each of which gets the book's intervals.
    """
    bounds = F.sort_array(F.collect_list(F.struct("ord_no", "start_c", "start_v", "end_c", "end_v", "p", "ph"))).alias("_s")
    dim = sections.groupBy("b").agg(bounds)
    few = sections.limit(most + 1).count() <= most
    if few:
        joined = records.drop("p", "ph").join(F.broadcast(dim), "b", "left")
    else:
        salted = dim.withColumn("_z", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        joined = records.drop("p", "ph").withColumn("_z", F.pmod(F.xxhash64("c", "v"), F.lit(SALT)).cast("int")).join(salted, ["b", "_z"], "left").drop("_z")
    here = F.struct(F.col("c").alias("c"), F.col("v").alias("v"))

    def holds(s: Column) -> Column:
        return (F.struct(s["start_c"].alias("c"), s["start_v"].alias("v")) <= here) & (here <= F.struct(s["end_c"].alias("c"), s["end_v"].alias("v")))

    found = F.coalesce(F.get(F.filter("_s", holds), F.lit(0)), F.try_element_at("_s", F.lit(-1)))
    return joined.withColumn("_f", found).withColumns({"p": F.col("_f.p"), "ph": F.col("_f.ph")}).drop("_s", "_f")


def link_counts(links: DataFrame, before: Column | None = None) -> DataFrame:
    """(b, c, v, i, n) of links whose anchor names a comment; a range counts at its first one."""
    pat = r"^Rashi on (.+?) (\d+):(\d+):(\d+)"
    named = links.where(before) if before is not None else links
    keyed = named.where(F.col("anchor_ref").rlike(pat)).select(*[F.regexp_extract("anchor_ref", pat, i + 1).alias(c) for i, c in enumerate("bcvi")])
    return keyed.select("b", *[F.col(c).cast("int").alias(c) for c in "cvi"]).groupBy("b", "c", "v", "i").agg(F.count(F.lit(1)).alias("n"))


def with_links(records: DataFrame, counts: DataFrame) -> DataFrame:
    """Records with the link count ``n``, 0 where there are none."""
    return records.join(counts, ["b", "c", "v", "i"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def with_verse(records: DataFrame, verses: DataFrame, keys: list[str], text: str = "vt") -> DataFrame:
    """Records with the text at the same place of a parallel text, "" where there is none."""
    return records.drop(text).join(verses.select(*keys, text), keys, "left").withColumn(text, F.coalesce(text, F.lit("")))


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key: the last in order. Aggregates map-side, so a hot key never fills a window."""
    best = F.max_by(F.struct(*df.columns), F.struct(*order)).alias("_r")
    return df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(best).select("_r.*")


def with_continuation(main: DataFrame, more: DataFrame) -> DataFrame:
    """Both texts as one, rows of the second marked cx = 1."""
    return main.withColumn("cx", F.lit(None).cast("int")).unionByName(more.withColumn("cx", F.lit(1)), allowMissingColumns=True)


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """``df`` marked for broadcast if it has no more than ``most`` rows, else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def manifest(records: DataFrame, notes: DataFrame | None = None, expected: DataFrame | None = None) -> DataFrame:
    """Per book: file name and record count, with its authorship note; and the total, book null.

    With ``expected`` (b, ...) also the books that should be there and have no record:
    they are skipped, and the manifest says so (``status``), and the others stay.
    """
    counted = records.rollup("b").agg(F.count(F.lit(1)).alias("n_records"), F.grouping("b").alias("is_total"))
    if expected is not None:
        missing = expected.select("b").distinct().join(records.select("b").distinct(), "b", "left_anti")
        counted = counted.unionByName(missing.select("b", F.lit(0).cast("bigint").alias("n_records"), F.lit(0).cast("tinyint").alias("is_total")))
    if notes is not None:
        counted = counted.join(small(notes.select("b", "note", "from_d", "from_a")), "b", "left")
    status = F.when(F.col("n_records") > 0, "written").otherwise("skipped: no records")
    return counted.withColumn("status", F.when(F.col("is_total") == 0, status)).withColumn("file", F.when((F.col("is_total") == 0) & (F.col("n_records") > 0), F.concat(F.replace("b", F.lit(" "), F.lit("_")), F.lit(".json"))))


def write_shards(records: DataFrame, path: str) -> DataFrame:
    """Parquet, one folder a book, and the manifest of what was written."""
    records.write.mode("overwrite").partitionBy("b").parquet(path)
    return manifest(records.sparkSession.read.parquet(path))


def first_seen(df: DataFrame, key: str, position: str, *names: str) -> DataFrame:
    """Distinct keys with the names they had at their first position."""
    return df.groupBy(key).agg(F.min(position).alias("first_at"), *[F.min_by(n, position).alias(n) for n in names])


def with_note(records: DataFrame, notes: DataFrame) -> DataFrame:
    """Authorship note (b, note, from_d, from_a) where it applies: everywhere in the book, or from a place on; always on cx rows."""
    joined = records.join(small(notes), "b", "left")
    from_here = F.struct(F.col("d").alias("d"), F.col("a").alias("a")) >= F.struct(F.col("from_d").alias("d"), F.col("from_a").alias("a"))
    return joined.withColumn("note", F.when(F.col("from_d").isNull() | from_here | (F.col("cx") == 1), F.col("note"))).drop("from_d", "from_a")

