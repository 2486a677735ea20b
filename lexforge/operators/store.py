"""The stored index of a corpus: written once a session and table, read by every search.

Four tables lie in the shared folder: the records with their search columns, their token
lists, the vocabulary, and the postings in the order of their keys, so that a scan for some keys
skips the row groups that hold others. A table is made when it is first asked for, and
made anew if the files of the corpus have changed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.functions.numerals import pop_boost
from lexforge.functions.text import normalize
from lexforge.operators.index import fold, postings
from lexforge.operators.search import search_columns
from lexforge.plans.lineage import place
from lexforge.sources.tables import table

FIELDS, PLACE = ("dh", "t", "vt"), ("b", "p", "c", "v")
_stored: dict[tuple, tuple[str, object]] = {}


def fingerprint(spark: SparkSession, path: str) -> tuple:
    """Names, lengths and times of the files under ``path``."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files))


def once(spark: SparkSession, source: str, what: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The stored table ``what`` of the corpus at ``source``."""
    at = (spark.sparkContext.applicationId, source, fingerprint(spark, source), what)
    path, schema = _stored.get(at, (None, None))
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS") if path else None
    if where is None or not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        df, path = make(), place(spark, what)
        df.write.option("compression", "zstd").parquet(path)
        schema = df.schema
        _stored[at] = path, schema
    return spark.read.schema(schema).parquet(path)


def records(spark: SparkSession, base: str) -> DataFrame:
    """The records with normalized lemma, body and verse and their skeletons (``search_columns``), spread evenly."""

    def make() -> DataFrame:
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        return search_columns(table(spark, base, "rashi").repartition(n, "rec_id"))

    return once(spark, f"{base}/rashi.parquet", "records", make)


def lists(spark: SparkSession, base: str) -> DataFrame:
    """(rec_id, pop, b, p, c, v, dh, t, vt): the tokens of each record, its popularity and its place, spread evenly; all that a query set needs."""

    def make() -> DataFrame:
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        rows = table(spark, base, "rashi")
        place = [F.col(c) for c in PLACE if c in rows.columns]
        pop = (pop_boost(F.col("lk")) if "lk" in rows.columns else F.lit(0.0)).alias("pop")
        # Normalized before they are moved: a pointed text is twice as long.
        said = rows.select("rec_id", pop, *place, *[F.lower(normalize(F.col(c))).alias(c) for c in FIELDS]).repartition(n, "rec_id")
        return said.select("rec_id", "pop", *place, *[F.filter(F.split(F.col(c), " "), lambda t: t != "").alias(c) for c in FIELDS])

    return once(spark, f"{base}/rashi.parquet", "lists", make)


def vocabulary(spark: SparkSession, base: str) -> DataFrame:
    """(token, fkey, n): the distinct tokens of all fields, with how often each occurs."""

    def make() -> DataFrame:
        each = lists(spark, base).select(F.explode(F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in FIELDS])).alias("token"))
        return each.groupBy("token").agg(F.count(F.lit(1)).alias("n")).select("token", fold(F.col("token")).alias("fkey"), "n")

    return once(spark, f"{base}/rashi.parquet", "vocabulary", make)


def stored_postings(spark: SparkSession, base: str) -> DataFrame:
    """``index.postings`` of all fields, in the order of their keys; a key that many records have spans several files."""

    def make() -> DataFrame:
        found = postings(table(spark, base, "rashi", "rec_id", *FIELDS), "rec_id", FIELDS)
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        return found.repartitionByRange(n, "fkey", "rec_id").sortWithinPartitions("fkey", "rec_id")

    return once(spark, f"{base}/rashi.parquet", "postings", make)
