"""Sources and sinks of the corpus: landed JSON responses, record files, catalogs, evaluation files."""

from __future__ import annotations

import ssl
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.operators.ingest import CALENDAR_SCHEMA, INDEX_SCHEMA, TEXT_SCHEMA, section_bounds

# The books and tractates by English and Hebrew name.
BOOKS = (
    ("Genesis", "בראשית"), ("Exodus", "שמות"), ("Leviticus", "ויקרא"), ("Numbers", "במדבר"),
    ("Deuteronomy", "דברים"), ("Joshua", "יהושע"), ("Judges", "שופטים"), ("I Samuel", "שמואל א"),
    ("II Samuel", "שמואל ב"), ("I Kings", "מלכים א"), ("II Kings", "מלכים ב"), ("Isaiah", "ישעיהו"),
    ("Jeremiah", "ירמיהו"), ("Ezekiel", "יחזקאל"), ("Hosea", "הושע"), ("Joel", "יואל"),
    ("Amos", "עמוס"), ("Obadiah", "עובדיה"), ("Jonah", "יונה"), ("Micah", "מיכה"),
    ("Nahum", "נחום"), ("Habakkuk", "חבקוק"), ("Zephaniah", "צפניה"), ("Haggai", "חגי"),
    ("Zechariah", "זכריה"), ("Malachi", "מלאכי"), ("Psalms", "תהילים"), ("Proverbs", "משלי"),
    ("Job", "איוב"), ("Song of Songs", "שיר השירים"), ("Ruth", "רות"), ("Lamentations", "איכה"),
    ("Ecclesiastes", "קהלת"), ("Esther", "אסתר"), ("Daniel", "דניאל"), ("Ezra", "עזרא"),
    ("Nehemiah", "נחמיה"), ("I Chronicles", "דברי הימים א"), ("II Chronicles", "דברי הימים ב"),
)
TRACTATES = (
    ("Berakhot", "ברכות"), ("Shabbat", "שבת"), ("Eruvin", "עירובין"), ("Pesachim", "פסחים"),
    ("Rosh Hashanah", "ראש השנה"), ("Yoma", "יומא"), ("Sukkah", "סוכה"), ("Beitzah", "ביצה"),
    ("Taanit", "תענית"), ("Megillah", "מגילה"), ("Moed Katan", "מועד קטן"), ("Chagigah", "חגיגה"),
    ("Yevamot", "יבמות"), ("Ketubot", "כתובות"), ("Nedarim", "נדרים"), ("Nazir", "נזיר"),
    ("Sotah", "סוטה"), ("Gittin", "גיטין"), ("Kiddushin", "קידושין"), ("Bava Kamma", "בבא קמא"),
    ("Bava Metzia", "בבא מציעא"), ("Bava Batra", "בבא בתרא"), ("Sanhedrin", "סנהדרין"), ("Makkot", "מכות"),
    ("Shevuot", "שבועות"), ("Avodah Zarah", "עבודה זרה"), ("Horayot", "הוריות"), ("Zevachim", "זבחים"),
    ("Menachot", "מנחות"), ("Chullin", "חולין"), ("Bekhorot", "בכורות"), ("Arakhin", "ערכין"),
    ("Temurah", "תמורה"), ("Keritot", "כריתות"), ("Meilah", "מעילה"), ("Tamid", "תמיד"),
    ("Niddah", "נדה"),
)
# Whose commentary a tractate has: (tractate, note, from leaf, from side); everywhere where no place is named.
NOTES = (
    ("Nedarim", "הפירוש המיוחס לרש\"י — כנראה אינו מרש\"י עצמו", None, None),
    ("Nazir", "הפירוש המיוחס לרש\"י — כנראה אינו מרש\"י עצמו", None, None),
    ("Bava Batra", "מדף כט ע\"א ואילך הפירוש הוא של רשב\"ם", 29, 1),
    ("Makkot", "מדף יט ע\"ב ואילך הפירוש הוא של ריב\"ן", 19, 2),
)
# Tractates whose commentary goes on in another text.
CONTINUATIONS = (("Bava Batra", "Rashbam on Bava Batra"),)
#: Evaluation queries as stored: one JSON array.
QUERY_SCHEMA = "id string, query string, style string, variant string, expected struct<b: string, c: int, v: int, i: int>, dhWords int, lk bigint"


def catalog(spark: SparkSession, names: tuple[tuple[str, str], ...] = BOOKS) -> DataFrame:
    """(en, he, ord_no) of a catalog."""
    return spark.createDataFrame([(en, he, n) for n, (en, he) in enumerate(names, 1)], "en string, he string, ord_no int")


def notes(spark: SparkSession) -> DataFrame:
    """(b, note, from_d, from_a), as ``ingest.with_note`` and ``ingest.manifest`` take them."""
    return spark.createDataFrame(list(NOTES), "b string, note string, from_d int, from_a int")


def fetched(url: str, agent: str = "lexforge", timeout: float = 120, ca_file: str | None = None) -> str:
    """The text behind a URL, trusting the certificates of ``ca_file`` (else the system's); for a downloader beside the engine, never for tasks."""
    parts = urllib.parse.urlsplit(url)
    safe = urllib.parse.urlunsplit(parts._replace(path=urllib.parse.quote(parts.path, safe="/%")))
    trust = ssl.create_default_context(cafile=ca_file) if parts.scheme == "https" else None
    with urllib.request.urlopen(urllib.request.Request(safe, headers={"User-Agent": agent}), timeout=timeout, context=trust) as r:
        return r.read().decode("utf-8")


def _at(spark: SparkSession, path: str) -> tuple:
    """(file system, path) of Hadoop, so that folders may lie wherever the cluster's do."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def write_text(spark: SparkSession, path: str, pieces: Iterable[str]) -> int:
    """Writes ``pieces`` one after the other, a megabyte at a time; returns the bytes."""
    fs, where = _at(spark, path)
    out, held, total = fs.create(where, True), bytearray(), 0
    try:
        for piece in pieces:
            held += piece.encode("utf-8")
            if len(held) > 1 << 20:
                out.write(held)
                total, held = total + len(held), bytearray()
        out.write(held)
    finally:
        out.close()
    return total + len(held)


def landed(spark: SparkSession, folder: str, name: str, fetch: Callable[[], str]) -> str:
    """Path of the landed file; fetched and written, whole or not at all, if it isn't there yet."""
    path = f"{folder}/{name}"
    fs, where = _at(spark, path)
    if not fs.exists(where):
        text = fetch()
        write_text(spark, f"{path}.part", [text])
        fs.rename(_at(spark, f"{path}.part")[1], where)
    return path


def read_json(spark: SparkSession, paths: str | list[str], schema: str, strict: bool = False) -> DataFrame:
    """Whole JSON files by schema: a damaged file fails the job if ``strict``, else it is left out."""
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST" if strict else "DROPMALFORMED").option("ignoreMissingFiles", not strict)
    return reader.schema(schema).json(paths)


def texts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(text) of the first version of each whole-book response: chapters of verses of comments."""
    return read_json(spark, paths, TEXT_SCHEMA).select(F.get("versions", F.lit(0))["text"].alias("text")).where("text is not null")


def sections(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(p, ph, ord_no, start_c, start_v, end_c, end_v) of index responses."""
    nodes = read_json(spark, paths, INDEX_SCHEMA).select(F.posexplode("alts.Parasha.nodes").alias("pos", "x"))
    names = ("start_c", "start_v", "end_c", "end_v")
    return nodes.select(F.col("x.title").alias("p"), F.col("x.heTitle").alias("ph"), (F.col("pos") + 1).alias("ord_no"), *[c.alias(n) for c, n in zip(section_bounds(F.col("x.wholeRef")), names)])


def links(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(anchor_ref) of link responses, one file a chapter; damaged and missing ones are left out."""
    return read_json(spark, paths, "anchorRef string").select(F.col("anchorRef").alias("anchor_ref")).where("anchor_ref is not null")


def calendar(spark: SparkSession, path: str, adjacent: bool, title: str = "Parashat Hashavua") -> DataFrame:
    """(name, adjacent) of the weekly section in a calendar response; none if it can't be read."""
    items = read_json(spark, path, CALENDAR_SCHEMA).select(F.explode("calendar_items").alias("x"))
    return items.where(F.col("x.title.en") == title).select(F.col("x.displayValue.en").alias("name"), F.lit(adjacent).alias("adjacent"))


def read_records(spark: SparkSession, path: str, schema) -> DataFrame:
    """A JSON array of records, every one by schema or the read fails; missing columns are null."""
    return spark.read.option("multiLine", True).option("mode", "FAILFAST").schema(schema).json(path)


def write_records(df: DataFrame, path: str) -> None:
    """Parquet, the form every query reads."""
    df.write.mode("overwrite").parquet(path)


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """A stored set of evaluation queries."""
    return read_records(spark, path, QUERY_SCHEMA)


def write_json_array(df: DataFrame, path: str) -> int:
    """The rows, in their order, as one compact JSON array; returns its bytes.

    One file is the feature: rows pass through the driver a partition at a time, and are
    written on as they come, so their number has no bound.
    """

    def pieces() -> Iterator[str]:
        yield "["
        for n, row in enumerate(df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "true"})).toLocalIterator(prefetchPartitions=True)):
            yield "," + row[0] if n else row[0]
        yield "]"

    return write_text(df.sparkSession, path, pieces())
