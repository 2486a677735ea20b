"""Deterministic samples: terciles, interleaving, first of each stratum, keep-first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.plans.ranking import numbered


def dice(seed: int, key: Column) -> Column:
    """A hash that orders a sample alike however the data is partitioned."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def terciles(df: DataFrame, popularity: str, key: str, per: str) -> DataFrame:
    """With ``tier`` 0 (high) to 2: thirds of ceil(n / 3) by popularity within each ``per``.

    Counts of equal popularity are summed first, so the window runs over distinct
    values; the rows of a value that a border cuts are numbered by key across
    partitions, however many share the value.
    """
    pop = F.coalesce(F.col(popularity), F.lit(0))
    levels = df.groupBy(F.col(per).alias("_per"), pop.alias("_pop")).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("_per")
    ranked = levels.withColumns({"_before": F.sum("_n").over(w.orderBy(F.desc("_pop"))) - F.col("_n"), "_third": F.ceil(F.sum("_n").over(w) / 3)})
    whole = F.floor(F.col("_before") / F.col("_third")) == F.floor((F.col("_before") + F.col("_n") - 1) / F.col("_third"))
    joined = df.join(ranked, (F.col(per).eqNullSafe(F.col("_per"))) & (pop == F.col("_pop")))
    cut = numbered(joined.where(~whole), ["_per", "_pop"], key, "_r")
    sure = joined.where(whole).withColumn("_r", F.lit(1))
    return sure.unionByName(cut).withColumn("tier", F.floor((F.col("_before") + F.col("_r") - 1) / F.col("_third")).cast("int")).drop("_per", "_pop", "_n", "_before", "_third", "_r")


def uniform(df: DataFrame, key: str, k: int, seed: int = 1) -> DataFrame:
    """``k`` rows by hash order."""
    return df.orderBy(dice(seed, F.col(key)), key).limit(k)


def quotas(k: int) -> tuple[int, int, int]:
    """Rows from the high, middle and low third."""
    third, rest = divmod(k, 3)
    return third + (rest >= 1), third + (rest >= 2), third


def stratified(df: DataFrame, popularity: str, key: str, k: int, seed: int = 1) -> DataFrame:
    """``k`` rows, a third from each popularity tercile; each tercile's quota is a bounded top-k."""
    tiered = terciles(df.withColumn("_all", F.lit(0)), popularity, key, "_all").drop("_all")
    parts = [tiered.where(F.col("tier") == i).orderBy(dice(seed, F.col(key)), key).limit(q) for i, q in enumerate(quotas(k))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def interleaved(df: DataFrame, tier: str, key: str, per: str, most: int, seed: int = 1) -> DataFrame:
    """The first ``most`` rows of each ``per`` in the order high, mid, low, high, ... , tiers that run out skipped.

    Only the first ``most`` of each tier can be among them, so each partition is pruned
    to those before anything is shuffled (window group limit).
    """
    w = Window.partitionBy(per, tier).orderBy(dice(seed, F.col(key)), key)
    first = df.withColumn("in_tier", F.row_number().over(w)).where(F.col("in_tier") <= most)
    order = Window.partitionBy(per).orderBy("in_tier", tier)
    return first.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Per key the row that is first in order; others with the same key go."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in df.columns if c not in keys]), F.struct(*order)).alias("_x")).select(*keys, "_x.*")


def lookahead(df: DataFrame, tokens: str, *keep: str) -> DataFrame:
    """Each token beside the one after it, null at the end."""
    pairs = F.transform(F.sequence(F.lit(1), F.size(tokens)), lambda i: F.struct(i.alias("pos"), F.get(F.col(tokens), i - 1).alias("token"), F.get(F.col(tokens), i).alias("next")))
    return df.where(F.size(tokens) > 0).select(*keep, F.explode(pairs).alias("_x")).select(*keep, "_x.*")


def aligned(lemma: Column, first: Column, second: Column, skeleton) -> Column:
    """For each lemma token the first of ``first`` with an equal skeleton, else of ``second``.

    An array of one such array, or of none if some token has no match: exploded, it drops
    the record without working the expression out again in a filter.

    The skeletons of each array come from its joined text, once, and are then found by
    position; tokens hold no line break.
    """

    def folded(a: Column) -> Column:
        return F.split(skeleton(F.array_join(a, "\n")), "\n")

    fs, ss = folded(first), folded(second)

    def found(x: Column) -> Column:
        def at(keys: str, values: str, t: Column) -> Column:
            return F.get(x[values], F.array_position(x[keys], t).cast("int") - 1)

        return F.transform(x["lemma"], lambda t: F.coalesce(at("fs", "first", t), at("ss", "second", t)))

    # The arrays are bound to a lambda's variable, so that each is worked out once a row and not once a token.
    bound = F.array(F.struct(lemma.alias("lemma"), first.alias("first"), second.alias("second"), folded(first).alias("fs"), folded(second).alias("ss")))
    whole = F.get(F.transform(bound, found), F.lit(0))
    return F.filter(F.array(whole), lambda a: ~F.exists(a, lambda y: y.isNull()))
