"""Names: alias registration with collisions, exact and fuzzy lookup, calendar names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.operators.index import fold, near, tokens


def aliases(names: DataFrame, entity: str, name: str) -> DataFrame:
    """(entity, name, key, n_words): folded keys of one- and two-word names, words joined by a bar; longer ones have none."""
    w = tokens(F.col(name))
    key = F.array_join(F.transform(w, fold), "|")
    return names.select(F.col(entity).alias("entity"), F.col(name).alias("name"), key.alias("key"), F.size(w).alias("n_words")).where("n_words in (1, 2) and key <> ''")


def collide(registered: DataFrame) -> DataFrame:
    """(key, entity, ambiguous): a key that two entities claim identifies nothing."""
    return registered.groupBy("key").agg(F.min("entity").alias("entity"), (F.count_distinct("entity") > 1).alias("ambiguous"))


def exact_lookup(asked: DataFrame, registry: DataFrame, shortest: int = 3) -> DataFrame:
    """(word, entity): per word the first of its keys, by key_no, that names one entity; short keys are skipped."""
    hits = asked.where(F.length("key") >= shortest).join(registry.where("not ambiguous"), "key")
    return hits.groupBy("word").agg(F.min_by("entity", "key_no").alias("entity"))


def fuzzy_unique(asked: DataFrame, registry: DataFrame) -> DataFrame:
    """(word, entity, d): the one entity nearest to a word's key within its bound.

    Keys below three signs are skipped. Equally near keys of different entities, or an
    ambiguous key among the nearest, mean no match.
    """
    ws = asked.where(F.length("word") >= 3)
    close = near(ws, registry, "word", "key").join(registry, "key")
    best = close.groupBy("word").agg(F.min("d").alias("d"))
    nearest = close.join(best, ["word", "d"])
    settled = nearest.groupBy("word", "d").agg(F.min("entity").alias("entity"), F.count_distinct("entity").alias("n"), F.bool_or("ambiguous").alias("vague"))
    return settled.where("n = 1 and not vague").select("word", "entity", "d")


def resolve(asked: DataFrame, spelled: DataFrame, registry: DataFrame) -> DataFrame:
    """(word, entity, how): by exact spelling, else by folded key, else by the nearest key."""
    by_spelling = asked.join(spelled, "word").select("word", "entity", F.lit("exact").alias("how"), F.lit(1).alias("o"))
    keyed = asked.withColumn("key", fold(F.col("word"))).withColumn("key_no", F.lit(0))
    by_key = exact_lookup(keyed, registry).select("word", "entity", F.lit("folded").alias("how"), F.lit(2).alias("o"))
    folded = asked.withColumn("original", F.col("word")).withColumn("word", fold(F.col("original")))
    by_near = fuzzy_unique(folded.select("word").distinct(), registry).join(folded, "word").select(F.col("original").alias("word"), "entity", F.lit("fuzzy").alias("how"), F.lit(3).alias("o"))
    return by_spelling.unionByName(by_key).unionByName(by_near).groupBy("word").agg(F.min_by(F.struct("entity", "how"), "o").alias("x")).select("word", "x.*")


def letters_only(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z]", "")


def calendar_names(items: DataFrame, sections: DataFrame) -> DataFrame:
    """(p, adjacent): the section names of calendar entries; a combined name counts for both, an unknown one stays."""
    parts = items.select("adjacent", F.explode(F.split("name", "-")).alias("part"))
    known = sections.select("p").where("p is not null").distinct()
    joined = parts.withColumn("_k", letters_only(F.col("part"))).join(known.withColumn("_k", letters_only(F.col("p"))), "_k", "left")
    return joined.select(F.coalesce("p", F.trim("part")).alias("p"), "adjacent").distinct()
