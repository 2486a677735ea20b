"""The core queries, over whole tables, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge import known
from lexforge.functions import numerals as N
from lexforge.functions import text as X
from lexforge.functions import translit as T
from lexforge.operators import blocks, evaluate, index, ingest, nested, resolve, sample, search, store
from lexforge.plans import parse
from lexforge.plans.lineage import cut, place
from lexforge.sources import connectors
from lexforge.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a query under its function's name, with its oracle SQL if SQL can say it."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- nested responses (problem 4; PRJ1, SRC1-SRC6, JSN1) ----


def _elements_sql(j: str) -> str:
    """(ordinal, value) of the elements of a level: a list's, an object's with numbers for keys, or one in place of a list."""
    keys = f"json_keys({j})"
    keyed = f"len({keys}) > 0 AND len(list_filter({keys}, lambda k: NOT regexp_matches(k, '^0*[1-9][0-9]*$'))) = 0"
    return f"""CASE json_type({j}) WHEN 'ARRAY' THEN list_transform(CAST({j} AS JSON[]), lambda v, n: {{'n': CAST(n AS INT), 'v': v}}) WHEN 'NULL' THEN [] WHEN 'OBJECT' THEN
      CASE WHEN len({keys}) = 0 THEN [] WHEN {keyed} THEN list_transform({keys}, lambda k: {{'n': CAST(k AS INT), 'v': json_extract({j}, '/' || k)}}) ELSE [{{'n': 1, 'v': {j}}}] END ELSE [{{'n': 1, 'v': {j}}}] END"""


def _level_sql(name: str, above: str, keys: str, j: str, ordinal: str) -> str:
    return f"{name} AS MATERIALIZED (SELECT {keys}, x.n AS {ordinal}, x.v AS j FROM (SELECT {keys}, unnest({_elements_sql('j')}) AS x FROM (SELECT {keys}, {j} AS j FROM {above}) WHERE j IS NOT NULL))"


_OPEN = "CASE WHEN json_valid(j) AND json_type(j) = 'VARCHAR' THEN json_extract_string(j, '$') ELSE j END"
OPENED = "(SELECT raw_id, trim(text, chr(65279)) AS j FROM raw_text)"
for _ in range(4):
    OPENED = f"(SELECT raw_id, {_OPEN} AS j FROM {OPENED})"
OPENED = f"(SELECT raw_id, CASE WHEN json_type(j, '$.versions') IS NULL AND json_type(j, '$.alts') IS NULL AND json_type(j, '$.data') IS NOT NULL THEN CASE WHEN json_type(j, '$.data') = 'VARCHAR' THEN CAST(json_extract_string(j, '$.data') AS JSON) ELSE json_extract(j, '$.data') END ELSE CAST(j AS JSON) END AS j FROM {OPENED} WHERE json_valid(j))"
NESTED = "WITH " + ", ".join((
    _level_sql("versions", OPENED, "raw_id", "json_extract(j, '$.versions')", "ver"),
    _level_sql("chapters", "versions", "raw_id, ver", "json_extract(j, '$.text')", "c"),
    _level_sql("verses", "chapters", "raw_id, ver, c", "j", "v"),
    _level_sql("comments", "verses", "raw_id, ver, c, v", "j", "i"),
    _level_sql("notes", "comments", "raw_id, ver, c, v, i", "json_extract(j, '$.notes')", "n"),
    _level_sql("sections", OPENED, "raw_id", "json_extract(j, '$.alts.Parasha.nodes')", "s"),
))


def _scalar_sql(path: str, own: bool = False) -> str:
    """The scalar at ``path`` of an element as text; of a scalar element itself if ``own``."""
    at = f"CASE WHEN json_type(j, '{path}') NOT IN ('ARRAY', 'OBJECT', 'NULL') THEN json_extract_string(j, '{path}') END"
    return f"CASE WHEN json_type(j) NOT IN ('ARRAY', 'OBJECT', 'NULL') THEN json_extract_string(j, '$') ELSE {at} END" if own else at


SAID = f"regexp_replace({_scalar_sql('$.text', True)}, '[\\s\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]', '', 'g') <> ''"
TEXT_AT = "$.text"
#: The columns of each table of nested responses, as SQL; "" for the text of an element.
NESTED_COLUMNS = {
    "versions": ("raw_id, ver", {"language": "$.language", "version_title": "$.versionTitle", "license": "$.license"}),
    "chapters": ("raw_id, ver, c", {}),
    "verses": ("raw_id, ver, c, v", {}),
    "comments": ("raw_id, ver, c, v, i", {"text": "", "comment_id": "$.id"}),
    "notes": ("raw_id, ver, c, v, i, n", {"text": "", "mark": "$.mark", "by_hand": "$.by.hand", "by_sure": "$.by.sure"}),
    "sections": ("raw_id, s", {"title": "$.title", "whole_ref": "$.wholeRef"}),
}


@query(f"{NESTED} SELECT raw_id, ver, c, v, i, 0 AS n FROM comments WHERE {SAID} UNION ALL SELECT raw_id, ver, c, v, i, n FROM notes WHERE {SAID}")
def p4_found(spark: SparkSession, base: str) -> DataFrame:
    return nested.spoken(table(spark, base, "raw_text", "raw_id", "text"), "raw_id", "text")


def _triples(spark: SparkSession, base: str) -> DataFrame:
    """The triples of all responses, parsed once a session for all their tables."""
    return store.once(spark, f"{base}/raw_text.parquet", "triples", lambda: nested.record_triples(table(spark, base, "raw_text", "raw_id", "text"), "raw_id", "text", nested.RESPONSE))


def _response_table(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, base: str) -> DataFrame:
        return nested.tables_of(_triples(spark, base), "raw_id", nested.RESPONSE)[name]

    run.__name__ = f"p4_{name}"
    keys, columns = NESTED_COLUMNS[name]
    return query(f"{NESTED} SELECT {', '.join([keys, *[f'{_scalar_sql(p or TEXT_AT, not p)} AS {c}' for c, p in columns.items()]])} FROM {name}")(run)


for _name in nested.RESPONSE.tables():
    _response_table(_name)


@query(f"SELECT raw_id FROM raw_text WHERE raw_id NOT IN (SELECT raw_id FROM {OPENED})")
def p4_damaged(spark: SparkSession, base: str) -> DataFrame:
    """The responses that aren't complete JSON; ``nested.damaged_records`` also says why."""
    return nested.tables_of(_triples(spark, base), "raw_id", nested.RESPONSE)[""].select("raw_id")


# ---- text functions (STR1-STR16, PRJ7-PRJ10) ----


@query(f"SELECT rec_id, {X.normalize_sql('dh')} AS dh, {X.normalize_sql('t')} AS t, {X.normalize_sql('vt')} AS vt FROM rashi")
def normalize_text(spark: SparkSession, base: str) -> DataFrame:
    """STR4, PRJ7."""
    return table(spark, base, "rashi", "rec_id", "dh", "t", "vt").select("rec_id", *[X.normalize(F.col(c)).alias(c) for c in ("dh", "t", "vt")])


@query(f"SELECT rec_id, {X.skel_sql(X.normalize_sql('dh'))} AS dh_s FROM rashi")
def skeleton_fold(spark: SparkSession, base: str) -> DataFrame:
    """STR5."""
    return table(spark, base, "rashi", "rec_id", "dh").select("rec_id", X.skel(X.normalize(F.col("dh"))).alias("dh_s"))


@query(f"SELECT doc_id, {X.clean_sql('text')} AS cleaned FROM documents")
def clean_html(spark: SparkSession, base: str) -> DataFrame:
    """STR1."""
    return table(spark, base, "documents", "doc_id", "text").select("doc_id", X.clean(F.col("text")).alias("cleaned"))


@query(f"SELECT doc_id, {X.clean_sql('text', True)} AS cleaned FROM documents")
def clean_footnotes(spark: SparkSession, base: str) -> DataFrame:
    """STR2."""
    return table(spark, base, "documents", "doc_id", "text").select("doc_id", X.clean(F.col("text"), footnotes=True).alias("cleaned"))


@query(f"SELECT rec_id, len({X.words_sql('t')}) AS n_words, {X.bare_sql('dh')} AS bare FROM rashi")
def lemma_tokens(spark: SparkSession, base: str) -> DataFrame:
    """STR13, STR14."""
    return table(spark, base, "rashi", "rec_id", "dh", "t").select("rec_id", F.size(X.words(F.col("t"))).cast("bigint").alias("n_words"), X.bare(F.col("dh")).alias("bare"))


@query(f"SELECT id, query, loaded_at, {X.clean_variant_sql('query')} AS clean, {X.sloppy_variant_sql(X.clean_variant_sql('query'))} AS sloppy FROM queries_partial")
def sloppy_fold(spark: SparkSession, base: str) -> DataFrame:
    """STR11, STR12, STR15."""
    clean = X.clean_variant(F.col("query"))
    return table(spark, base, "queries_partial", "id", "query", "loaded_at").select("id", "query", "loaded_at", clean.alias("clean"), X.sloppy_variant(clean).alias("sloppy"))


@query("SELECT DISTINCT b, replace(b, ' ', '_') AS file, replace(b, ' ', '%20') AS quoted FROM rashi")
def safe_names(spark: SparkSession, base: str) -> DataFrame:
    """STR16."""
    return table(spark, base, "rashi", "b").distinct().select("b", X.safe_filename(F.col("b")).alias("file"), X.url_quote(F.col("b")).alias("quoted"))


@query("""SELECT rec_id, left(t, 220) AS snippet, array_to_string(w[1:40], ' ') || CASE WHEN len(w) > 40 THEN '…' ELSE '' END AS opening, array_to_string(d[1:2], ' ') AS two
FROM (SELECT rec_id, t, """ + X.words_sql("t") + " AS w, " + X.words_sql("dh") + " AS d FROM rashi)")  # fmt: skip
def snippets(spark: SparkSession, base: str) -> DataFrame:
    """PRJ9, PRJ10."""
    df = table(spark, base, "rashi", "rec_id", "dh", "t")
    return df.select("rec_id", X.snippet(F.col("t")).alias("snippet"), X.first_words(F.col("t"), 40, "…").alias("opening"), X.first_words(F.col("dh"), 2).alias("two"))


@query("SELECT rec_id, replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped, " + X.word_match_sql(X.normalize_sql("t"), X.normalize_sql("dh")) + " AS place FROM rashi")
def word_prefix_places(spark: SparkSession, base: str) -> DataFrame:
    """STR10, FLT8."""
    df = table(spark, base, "rashi", "rec_id", "dh", "t")
    return df.select("rec_id", X.escape_html(F.col("t")).alias("escaped"), X.word_match(X.normalize(F.col("t")), X.normalize(F.col("dh"))).cast("bigint").alias("place"))


# ---- numerals, references, boosts (STR7-STR8, PRJ2, PRJ8, NUM1-NUM3, RES5) ----


@query(f"SELECT o_orderkey, n, {N.format_numeral_sql('n')} AS numeral FROM (SELECT o_orderkey, CAST(o_orderkey % 999 + 1 AS INT) AS n FROM orders)")
def hebrew_numeral_format(spark: SparkSession, base: str) -> DataFrame:
    """STR8."""
    df = table(spark, base, "orders", "o_orderkey").withColumn("n", (F.col("o_orderkey") % 999 + 1).cast("int"))
    return df.select("o_orderkey", "n", N.format_numeral(F.col("n")).alias("numeral"))


@query(f"SELECT o_orderkey, CASE WHEN length({N.format_numeral_sql('n')}) <= 3 THEN n END AS parsed FROM (SELECT o_orderkey, CAST(o_orderkey % 999 + 1 AS INT) AS n FROM orders)")
def hebrew_numeral_parse(spark: SparkSession, base: str) -> DataFrame:
    """STR7: the round trip, null where the numeral has over three letters; the two that stand for 15 and 16 read back too."""
    df = table(spark, base, "orders", "o_orderkey").withColumn("n", (F.col("o_orderkey") % 999 + 1).cast("int"))
    return df.select("o_orderkey", N.parse_numeral(N.format_numeral(F.col("n"))).alias("parsed"))


@query("SELECT fol_id, x, CAST(x // 2 + 1 AS INT) AS leaf, CAST(x % 2 + 1 AS INT) AS side FROM (SELECT fol_id, CAST((d - 1) * 2 + a - 1 AS INT) AS x FROM folio)")
def folio_address(spark: SparkSession, base: str) -> DataFrame:
    """PRJ2, PRJ3."""
    df = table(spark, base, "folio", "fol_id", "d", "a").select("fol_id", ((F.col("d") - 1) * 2 + F.col("a") - 1).cast("int").alias("x"))
    leaf, side = N.folio_of(F.col("x"))
    return df.select("fol_id", "x", leaf.alias("leaf"), side.alias("side"))


@query(f"""SELECT rec_id, bh || ' ' || {N.format_numeral_sql('c')} || ':' || {N.format_numeral_sql('v')} AS he_ref, b || ' ' || c || ':' || v || '#' || i AS ref,
'Rashi_on_' || b || '.' || c || '.' || v || '.' || i AS path FROM rashi""")
def formatted_refs(spark: SparkSession, base: str) -> DataFrame:
    """PRJ8."""
    df = table(spark, base, "rashi", "rec_id", "b", "bh", "c", "v", "i")
    at = [F.col(x) for x in "bcvi"]
    return df.select("rec_id", N.hebrew_ref(F.col("bh"), F.col("c"), F.col("v")).alias("he_ref"), N.record_ref(*at).alias("ref"), F.concat(F.lit("Rashi_on_"), F.concat_ws(".", *at)).alias("path"))


@query(f"""SELECT rec_id, round({N.pop_boost_sql('lk')}, 6) AS pop, CAST(CASE WHEN p = (SELECT min(p) FROM sections) THEN 8 WHEN p = (SELECT max(p) FROM sections) THEN 4 ELSE 0 END AS INT) AS week,
CASE WHEN n <= 2 THEN '1-2' WHEN n <= 4 THEN '3-4' ELSE '5+' END AS bucket FROM (SELECT rec_id, lk, p, len({X.words_sql('dh')}) AS n FROM rashi)""")
def boosts(spark: SparkSession, base: str) -> DataFrame:
    """NUM1, NUM2, NUM3, JN11."""
    first, last = table(spark, base, "sections", "p").agg(F.min("p"), F.max("p")).first()
    df = table(spark, base, "rashi", "rec_id", "p", "dh", "lk")
    return df.select("rec_id", F.round(N.pop_boost(F.col("lk")), 6).alias("pop"), N.week_boost(F.col("p"), [first], [last]).alias("week"), N.word_bucket(F.size(X.words(F.col("dh")))).alias("bucket"))


@query("SELECT fol_id, CAST(CASE WHEN d = 3 THEN 8 WHEN abs(d - 3) = 1 THEN 4 ELSE 0 END AS INT) AS boost FROM folio")
def leaf_of_day(spark: SparkSession, base: str) -> DataFrame:
    """RES5."""
    return table(spark, base, "folio", "fol_id", "d").select("fol_id", N.leaf_boost(F.col("d"), 3).alias("boost"))


# ---- ingest (PRJ1, PRJ4-PRJ6, JN1-JN4, AGG1-AGG3, SET1-SET2, SNK2-SNK3, FLT1-FLT2) ----


@query(r"""SELECT doc_id, CAST(p AS INT) AS par, CAST(s AS INT) AS line, value FROM (
  SELECT doc_id, p, unnest(ls) AS value, generate_subscripts(ls, 1) AS s FROM (
    SELECT doc_id, generate_subscripts(ps, 1) AS p, string_split(unnest(ps), chr(10)) AS ls FROM (
      SELECT doc_id, string_split(text, chr(10) || chr(10)) AS ps FROM documents))) WHERE value <> ''""")
def unnest_ordinals(spark: SparkSession, base: str) -> DataFrame:
    """PRJ1, FLT1: paragraphs and lines of documents, empty ones counted and left out."""
    split = F.transform(F.split("text", "\n\n"), lambda p: F.split(p, "\n"))
    return ingest.unnest(table(spark, base, "documents", "doc_id", "text").select("doc_id", split.alias("n")), "n", ("par", "line"), "value", ("doc_id",))


BOLD = r"'^\s*<b>(.*?)</b>'"


@query(f"""SELECT doc_id, trim({X.clean_sql(f"regexp_extract(text, {BOLD}, 1)")}, ' .:־') AS dh, {X.clean_sql(f"regexp_replace(text, {BOLD}, '')")} AS t FROM documents""")
def bold_lemma_split(spark: SparkSession, base: str) -> DataFrame:
    """PRJ4, STR3."""
    dh, t = ingest.bold_lemma(F.col("text"))
    return table(spark, base, "documents", "doc_id", "text").select("doc_id", dh.alias("dh"), t.alias("t"))


@query(rf"""SELECT doc_id, CASE WHEN k > 0 THEN trim(substr(x, 1, k - 1), ' .:־') ELSE '' END AS dh,
CASE WHEN k > 0 THEN {X.clean_sql("substr(x, k + 3)")} ELSE x END AS t FROM (
  SELECT doc_id, x, coalesce(nullif(length(regexp_extract(x, '^((?s).*?)\s[–-]\s', 1)), 0), CASE WHEN regexp_matches(x, '^\s[–-]\s') THEN 0 ELSE -1 END) + 1 AS k FROM (
    SELECT doc_id, {X.clean_sql('text')} AS x FROM documents))""")
def dash_lemma_split(spark: SparkSession, base: str) -> DataFrame:
    """PRJ5."""
    dh, t = ingest.dash_lemma(F.col("text"))
    return table(spark, base, "documents", "doc_id", "text").select("doc_id", dh.alias("dh"), t.alias("t"))


@query("""SELECT rec_id, p, ph FROM (
  SELECT r.rec_id, coalesce(s.p, l.p) AS p, coalesce(s.ph, l.ph) AS ph, row_number() OVER (PARTITION BY r.rec_id ORDER BY s.ord_no) AS rn
  FROM rashi r
  LEFT JOIN sections s ON s.b = r.b AND (r.c > s.start_c OR r.c = s.start_c AND r.v >= s.start_v) AND (r.c < s.end_c OR r.c = s.end_c AND r.v <= s.end_v)
  LEFT JOIN (SELECT b, arg_max(p, ord_no) AS p, arg_max(ph, ord_no) AS ph FROM sections GROUP BY b) l ON l.b = r.b) WHERE rn = 1""")
def section_range_join(spark: SparkSession, base: str) -> DataFrame:
    """JN1."""
    return ingest.section_join(table(spark, base, "rashi", "rec_id", "b", "c", "v", "p", "ph"), table(spark, base, "sections")).select("rec_id", "p", "ph")


@query(r"""SELECT b, ord_no, CAST(regexp_extract(whole_ref, p, 1) AS INT) AS start_c, CAST(regexp_extract(whole_ref, p, 2) AS INT) AS start_v,
CAST(coalesce(nullif(regexp_extract(whole_ref, p, 3), ''), regexp_extract(whole_ref, p, 1)) AS INT) AS end_c, CAST(regexp_extract(whole_ref, p, 4) AS INT) AS end_v
FROM (SELECT *, '(\d+):(\d+)-(?:(\d+):)?(\d+)$' AS p FROM sections)""".replace("whole_ref, p,", r"whole_ref, '(\d+):(\d+)-(?:(\d+):)?(\d+)$',"))
def section_bounds(spark: SparkSession, base: str) -> DataFrame:
    """SRC5."""
    names = ("start_c", "start_v", "end_c", "end_v")
    return table(spark, base, "sections", "b", "ord_no", "whole_ref").select("b", "ord_no", *[x.alias(n) for x, n in zip(ingest.section_bounds(F.col("whole_ref")), names)])


LINKED = r"""SELECT regexp_extract(anchor_ref, '^Rashi on (.+?) (\d+):(\d+):(\d+)', 1) AS b, CAST(regexp_extract(anchor_ref, '^Rashi on (.+?) (\d+):(\d+):(\d+)', 2) AS INT) AS c,
CAST(regexp_extract(anchor_ref, '^Rashi on (.+?) (\d+):(\d+):(\d+)', 3) AS INT) AS v, CAST(regexp_extract(anchor_ref, '^Rashi on (.+?) (\d+):(\d+):(\d+)', 4) AS INT) AS i, count(*) AS n
FROM links WHERE regexp_matches(anchor_ref, '^Rashi on (.+?) (\d+):(\d+):(\d+)') GROUP BY ALL"""


@query(LINKED)
def link_counts(spark: SparkSession, base: str) -> DataFrame:
    """AGG1, SRC6."""
    return ingest.link_counts(table(spark, base, "links", "anchor_ref"))


@query(f"SELECT r.rec_id, coalesce(k.n, 0) AS n FROM rashi r LEFT JOIN ({LINKED}) k ON r.b = k.b AND r.c = k.c AND r.v = k.v AND r.i = k.i")
def link_popularity(spark: SparkSession, base: str) -> DataFrame:
    """JN2."""
    return ingest.with_links(table(spark, base, "rashi", "rec_id", "b", "c", "v", "i"), ingest.link_counts(table(spark, base, "links", "anchor_ref"))).select("rec_id", "n")


LATEST = "SELECT b, c, v, i, arg_max(rec_id, (loaded_at, rec_id)) AS rec_id FROM rashi GROUP BY b, c, v, i"


@query(LATEST)
def latest_records(spark: SparkSession, base: str) -> DataFrame:
    """SET4, WIN6 by aggregation: one row a natural key, the last loaded."""
    df = table(spark, base, "rashi", "rec_id", "b", "c", "v", "i", "loaded_at")
    return ingest.latest(df, ["b", "c", "v", "i"], [F.col("loaded_at"), F.col("rec_id")]).select("b", "c", "v", "i", "rec_id")


@query("""SELECT f.fol_id, coalesce(w.vt, '') AS vt FROM folio f LEFT JOIN
(SELECT b, c, v, max(vt) AS vt FROM rashi GROUP BY b, c, v) w ON f.b = w.b AND f.d = w.c AND f.l = w.v""")
def verse_left_lookup(spark: SparkSession, base: str) -> DataFrame:
    """JN3: folio places looked up in the verse texts."""
    verses = table(spark, base, "rashi", "b", "c", "v", "vt").groupBy("b", F.col("c").alias("d"), F.col("v").alias("l")).agg(F.max("vt").alias("vt"))
    return ingest.with_verse(table(spark, base, "folio", "fol_id", "b", "d", "l"), verses, ["b", "d", "l"]).select("fol_id", "vt")


@query("""SELECT b, d, a, l, i, dh, t, CAST(NULL AS INT) AS cx FROM folio WHERE cx IS NULL AND t <> ''
UNION ALL SELECT b, d, a, l, i, dh, t, 1 AS cx FROM folio WHERE cx = 1 AND t <> ''""")
def continuation_union(spark: SparkSession, base: str) -> DataFrame:
    """SET1, SET2, PRJ6, FLT2, SRT2."""
    df = table(spark, base, "folio", "b", "d", "a", "l", "i", "dh", "t", "cx").where("t <> ''")
    return ingest.with_continuation(df.where("cx is null").drop("cx"), df.where("cx = 1").drop("cx")).orderBy("b", "d", "a", "l", "i", F.asc_nulls_first("cx"))


@query("SELECT b, count(*) AS n_records, CAST(grouping(b) AS TINYINT) AS is_total, CASE WHEN grouping(b) = 0 THEN replace(b, ' ', '_') || '.json' END AS file FROM rashi GROUP BY ROLLUP (b)")
def shard_manifest(spark: SparkSession, base: str) -> DataFrame:
    """AGG2, SNK2, SNK3, JN4."""
    return ingest.manifest(table(spark, base, "rashi", "b")).select("b", "n_records", "is_total", "file")


@query("""SELECT fol_id, CASE WHEN b = (SELECT min(b) FROM folio) THEN 'by another hand' WHEN b = (SELECT max(b) FROM folio) AND (d > 2 OR d = 2 AND a >= 2 OR coalesce(cx, 0) = 1) THEN 'continued' END AS note FROM folio""")
def authorship_notes(spark: SparkSession, base: str) -> DataFrame:
    """RES6, JN4: a note on a whole book, and one from a place on or by provenance."""
    df = table(spark, base, "folio", "fol_id", "b", "d", "a", "cx")
    first, last = df.agg(F.min("b"), F.max("b")).first()
    notes = spark.createDataFrame([(first, "by another hand", None, None), (last, "continued", 2, 2)], "b string, note string, from_d int, from_a int")
    return ingest.with_note(df, notes).select("fol_id", "note")


@query("SELECT b, min(rec_id) AS first_at, arg_min(bh, rec_id) AS bh FROM rashi GROUP BY b")
def first_seen_dims(spark: SparkSession, base: str) -> DataFrame:
    """AGG3, UI1's dimension."""
    return ingest.first_seen(table(spark, base, "rashi", "b", "bh", "rec_id"), "b", "rec_id", "bh")


@query("SELECT s.b, p, ph FROM sections s WHERE s.b = (SELECT min(b) FROM sections)")
def cascading_sections(spark: SparkSession, base: str) -> DataFrame:
    """UI1."""
    df = table(spark, base, "sections", "b", "p", "ph")
    return search.cascade(df, df.agg(F.min("b")).first()[0])


@query("SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(ts AS DATE) + 7 AS next_week, year(ts) AS y, month(ts) AS m, day(ts) AS d FROM events")
def event_fields(spark: SparkSession, base: str) -> DataFrame:
    """JSN1, DAT1."""
    df = table(spark, base, "events", "event_id", "event_type", "props", "ts")
    day = F.to_date("ts")
    k = F.from_json("props", "k bigint")["k"]
    return df.select("event_id", "event_type", k.alias("k"), F.date_add(day, 7).alias("next_week"), F.year("ts").cast("bigint").alias("y"), F.month("ts").cast("bigint").alias("m"), F.day("ts").cast("bigint").alias("d"))


# ---- sources and sinks, by what they write and read again (SRC1-SRC10, SNK1-SNK4) ----


@query("SELECT fol_id, b, d, a, l, i, dh, t, vt, lk, cx FROM folio")
def record_file(spark: SparkSession, base: str) -> DataFrame:
    """SRC8, SNK1, AGG13: the folio records as one JSON array, read again by schema."""
    df = table(spark, base, "folio", "fol_id", "b", "d", "a", "l", "i", "dh", "t", "vt", "lk", "cx")
    path = f"{place(spark, 'record-file')}.json"
    connectors.write_json_array(df, path)
    return connectors.read_records(spark, path, df.schema)


@query("SELECT b, count(*) AS n_records, CAST(sum(length(t)) AS BIGINT) AS signs FROM rashi GROUP BY b")
def shard_files(spark: SparkSession, base: str) -> DataFrame:
    """SNK2: one folder a book, read again."""
    path = place(spark, "shards")
    ingest.write_shards(table(spark, base, "rashi", "b", "rec_id", "t"), path)
    return spark.read.parquet(path).groupBy("b").agg(F.count(F.lit(1)).alias("n_records"), F.sum(F.length("t")).alias("signs"))


@query(LINKED)
def landed_links(spark: SparkSession, base: str) -> DataFrame:
    """SRC1, SRC2, SRC6: a link response as it lands, one JSON array, read leniently and counted."""
    path = f"{place(spark, 'links')}.json"
    connectors.write_json_array(table(spark, base, "links", "anchor_ref").select(F.col("anchor_ref").alias("anchorRef")), path)
    return ingest.link_counts(connectors.links(spark, path))


@query("SELECT p, ph, CAST(row_number() OVER (PARTITION BY b ORDER BY ord_no) AS INT) AS ord_no, start_c, start_v, end_c, end_v FROM sections")
def landed_sections(spark: SparkSession, base: str) -> DataFrame:
    """SRC4, SRC5: index responses as they land, one a book."""
    folder = place(spark, "index")
    node = F.struct("ord_no", F.col("p").alias("title"), F.col("ph").alias("heTitle"), F.col("whole_ref").alias("wholeRef"))
    books = table(spark, base, "sections").groupBy("b").agg(F.sort_array(F.collect_list(node)).alias("nodes"))
    nested_ = F.struct(F.struct(F.struct("nodes").alias("Parasha")).alias("alts"))
    books.select(F.to_json(nested_["alts"].dropFields("x")).alias("a")).select(F.concat(F.lit('{"alts":'), "a", F.lit("}")).alias("value")).repartition(64).write.option("maxRecordsPerFile", 1).text(folder)
    return connectors.sections(spark, folder)


@query("SELECT DISTINCT id, query, style, variant, expected.b AS b, expected.c AS c, expected.v AS v, expected.i AS i, dhWords, lk FROM queries_partial")
def query_files(spark: SparkSession, base: str) -> DataFrame:
    """SRC10, SNK4: the query set as one JSON array, read again."""
    path = f"{place(spark, 'queries')}.json"
    connectors.write_json_array(table(spark, base, "queries_partial", "id", "query", "style", "variant", "expected", "dhWords", "lk").distinct(), path)
    return connectors.read_queries(spark, path).select("id", "query", "style", "variant", "expected.*", "dhWords", "lk")


@query("""SELECT b, count(rec_id) AS n_records, CASE WHEN count(rec_id) > 0 THEN 'written' ELSE 'skipped: no records' END AS status, CASE b WHEN (SELECT min(b) FROM rashi) THEN 'by another hand' END AS note
FROM (SELECT b, rec_id FROM rashi UNION ALL SELECT b || ' II', NULL FROM sections) GROUP BY b""")
def shard_report(spark: SparkSession, base: str) -> DataFrame:
    """SNK3: the manifest with notes; books without a record are skipped and reported."""
    records = table(spark, base, "rashi", "b")
    first = records.agg(F.min("b")).first()[0]
    notes = spark.createDataFrame([(first, "by another hand", None, None)], "b string, note string, from_d int, from_a int")
    expected = table(spark, base, "sections", "b").select(F.concat("b", F.lit(" II")).alias("b")).unionByName(records)
    return ingest.manifest(records, notes, expected).where("is_total = 0").select("b", "n_records", "status", "note")


# ---- search (FLT3-FLT9, SCR1-SCR2, SRT1, JN5) ----


def _sk(e: str) -> str:
    return X.skel_sql(e)


def ladder_sql(lemma: str, where: str, limit: str = "") -> str:
    """The ladder for one- and many-token lemmas as SQL."""
    dh, t = X.normalize_sql("dh"), X.normalize_sql("t")
    bare = search.plain_skel(lemma)
    parts, hit = [], []
    for tok in lemma.split(" "):
        a = f"strpos(' ' || n, ' ' || '{tok}') > 0"
        b = f"strpos(' ' || s, ' ' || '{search.plain_skel(tok)}') > 0" if search.plain_skel(tok) else "false"
        parts.append(f"CASE WHEN {a} THEN 120 WHEN {b} THEN 80 WHEN strpos(' ' || tn, ' ' || '{tok}') > 0 THEN 15 WHEN contains(tn, '{tok}') THEN 8 ELSE 0 END")
        hit.append(f"({a} OR {b})")
    tail = f"{' + '.join(parts)} + CASE WHEN {' AND '.join(hit)} THEN 100 ELSE 0 END"
    return f"""SELECT rec_id, round(pts + {N.pop_boost_sql('lk')}, 6) AS score FROM (
      SELECT rec_id, lk, CASE WHEN n = '{lemma}' THEN 1000 WHEN starts_with(n, '{lemma}') THEN 600 WHEN contains(n, '{lemma}') THEN 400
        WHEN s = '{bare}' THEN 800 WHEN starts_with(s, '{bare}') THEN 450 WHEN contains(s, '{bare}') THEN 300 ELSE {tail} END AS pts
      FROM (SELECT rec_id, lk, n, {X.skel_sql('n')} AS s, tn FROM (SELECT rec_id, lk, {dh} AS n, {t} AS tn FROM rashi WHERE {where}))) WHERE pts > 0 ORDER BY score DESC, rec_id {limit}"""


@query(ladder_sql("כי אם", "true"))
def lemma_ladder(spark: SparkSession, base: str) -> DataFrame:
    """SCR1, SCR2, FLT4, FLT7, FLT8: every row the ladder keeps."""
    return search.search(store.records(spark, base), search.Query(lemma="כי אם"), limit=None).select("rec_id", "score")


@query(ladder_sql("את", "true", "LIMIT 60"))
def lemma_ladder_topk(spark: SparkSession, base: str) -> DataFrame:
    """SRT1, SRT6."""
    return search.search(store.records(spark, base), search.Query(lemma="את")).select("rec_id", "score")


@query("SELECT rec_id, score, regexp_replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '(א[' || " + X.q("".join("\\" + c if c in "[](){}.?!" else c for c in X.POINTS + X.PUNCTUATION)) + " || ']*ת)', '<mark>\\1</mark>', 'g') AS marked FROM (" + ladder_sql("את", "true", "LIMIT 60") + ") JOIN rashi USING (rec_id)")
def highlight_marks(spark: SparkSession, base: str) -> DataFrame:
    """STR6, STR9: the top of a search with its lemma marked."""
    top = search.search(store.records(spark, base), search.Query(lemma="את"))
    return top.select("rec_id", "score", X.highlight(F.col("t"), ["את"]).alias("marked"))


@query(f"SELECT rec_id, round(1.0 + {N.pop_boost_sql('lk')}, 6) AS score FROM rashi WHERE b = (SELECT min(b) FROM rashi) AND c = 1 ORDER BY score DESC, rec_id")
def fielded_filter(spark: SparkSession, base: str) -> DataFrame:
    """FLT3, FLT6."""
    df = table(spark, base, "rashi", "rec_id", "b", "p", "c", "v", "lk")
    return search.search(df, search.Query(book=df.agg(F.min("b")).first()[0], chapter=1), limit=None).select("rec_id", "score")


@query(f"SELECT rec_id, round(1.0 + {N.pop_boost_sql('lk')}, 6) AS score FROM rashi ORDER BY score DESC, rec_id LIMIT 60")
def browse_topk(spark: SparkSession, base: str) -> DataFrame:
    """FLT6, SRT1."""
    return search.search(table(spark, base, "rashi", "rec_id", "b", "p", "c", "v", "lk"), search.Query()).select("rec_id", "score")


# ---- names (AGG8-AGG9, RES1-RES3, JN6-JN8, WIN7) ----

ALIASED = f"""SELECT key, min(entity) AS entity, count(DISTINCT entity) > 1 AS ambiguous FROM (
  SELECT b AS entity, array_to_string(list_transform({index.tokens_sql('b')}, lambda w: {index.fold_sql('w')}), '|') AS key, len({index.tokens_sql('b')}) AS n FROM (SELECT DISTINCT b FROM rashi)
  UNION SELECT b, {index.fold_sql('unnest(' + index.tokens_sql('b') + ')')}, 1 FROM (SELECT DISTINCT b FROM rashi)
) WHERE n IN (1, 2) AND key <> '' GROUP BY key"""


def _registry(spark: SparkSession, base: str) -> DataFrame:
    books = table(spark, base, "rashi", "b").distinct()
    whole = resolve.aliases(books, "b", "b").select("entity", "key")
    parts = books.select(F.col("b").alias("entity"), F.explode(index.tokens(F.col("b"))).alias("w")).select("entity", index.fold(F.col("w")).alias("key")).where("key <> ''")
    return resolve.collide(whole.union(parts).distinct())


@query(ALIASED)
def alias_collisions(spark: SparkSession, base: str) -> DataFrame:
    """AGG9, RES2, MAP1."""
    return _registry(spark, base)


@query(f"""SELECT word, min(entity) AS entity, d FROM (
  SELECT q.word, a.entity, a.ambiguous, levenshtein(q.word, a.key) AS d, min(levenshtein(q.word, a.key)) OVER (PARTITION BY q.word) AS best
  FROM (SELECT DISTINCT {index.fold_sql('unnest(' + index.query_tokens_sql('query') + ')')} AS word FROM queries_partial) q, ({ALIASED}) a
  WHERE length(q.word) >= 3 AND levenshtein(q.word, a.key) <= CASE WHEN length(q.word) >= 6 THEN 2 ELSE 1 END)
WHERE d = best GROUP BY word, d HAVING count(DISTINCT entity) = 1 AND NOT bool_or(ambiguous)""")
def fuzzy_alias_unique(spark: SparkSession, base: str) -> DataFrame:
    """AGG8, JN8: folded query words against the book aliases."""
    asked = table(spark, base, "queries_partial", "query").select(F.explode(index.query_tokens(F.col("query"))).alias("w")).select(index.fold(F.col("w")).alias("word")).distinct()
    return resolve.fuzzy_unique(asked, _registry(spark, base)).select("word", "entity", F.col("d").cast("bigint").alias("d"))


@query(f"""WITH reg AS MATERIALIZED ({ALIASED}), w AS MATERIALIZED (SELECT DISTINCT unnest({index.query_tokens_sql('query')}) AS word FROM queries_partial),
f AS MATERIALIZED (SELECT word, {index.fold_sql('word')} AS key FROM w),
spelled AS (SELECT word, min(b) AS entity FROM (SELECT DISTINCT b, unnest({index.tokens_sql('b')}) AS word FROM rashi) GROUP BY word HAVING count(DISTINCT b) = 1),
near AS (SELECT key, min(entity) AS entity FROM (SELECT f.key, r.entity, r.ambiguous, levenshtein(f.key, r.key) AS d, min(levenshtein(f.key, r.key)) OVER (PARTITION BY f.key) AS best FROM (SELECT DISTINCT key FROM f) f, reg r
  WHERE length(f.key) >= 3 AND levenshtein(f.key, r.key) <= CASE WHEN length(f.key) >= 6 THEN 2 ELSE 1 END) WHERE d = best GROUP BY key HAVING count(DISTINCT entity) = 1 AND NOT bool_or(ambiguous))
SELECT word, arg_min(entity, o) AS entity, arg_min(how, o) AS how FROM (
  SELECT word, entity, 'exact' AS how, 1 AS o FROM w JOIN spelled USING (word) UNION ALL SELECT word, entity, 'folded', 2 FROM f JOIN reg ON reg.key = f.key AND NOT ambiguous AND length(f.key) >= 3
  UNION ALL SELECT word, entity, 'fuzzy', 3 FROM f JOIN near USING (key)) GROUP BY word""")
def resolve_words(spark: SparkSession, base: str) -> DataFrame:
    """JN7, RES3: query words that name a book: by spelling, else by folded key, else by the nearest key."""
    asked = table(spark, base, "queries_partial", "query").select(F.explode(index.query_tokens(F.col("query"))).alias("word")).distinct()
    said = table(spark, base, "rashi", "b").distinct().select("b", F.explode(index.tokens(F.col("b"))).alias("word"))
    spelled = said.groupBy("word").agg(F.min("b").alias("entity"), F.count_distinct("b").alias("n")).where("n = 1").drop("n")
    return resolve.resolve(asked, spelled, _registry(spark, base))


@query("""SELECT DISTINCT coalesce(s.p, trim(x.part)) AS p, x.adjacent FROM (
  SELECT unnest(string_split(upper(p), '-')) AS part, ord_no % 2 = 0 AS adjacent FROM sections WHERE p IS NOT NULL) x
LEFT JOIN (SELECT DISTINCT p FROM sections) s ON regexp_replace(lower(x.part), '[^a-z]', '', 'g') = regexp_replace(lower(s.p), '[^a-z]', '', 'g')""")
def calendar_names(spark: SparkSession, base: str) -> DataFrame:
    """JN6, SRC7: calendar entries, spelled in capitals, against section names."""
    sections = table(spark, base, "sections", "p", "ord_no")
    items = sections.where("p is not null").select(F.upper("p").alias("name"), (F.col("ord_no") % 2 == 0).alias("adjacent"))
    return resolve.calendar_names(items, sections)


@query(f"""SELECT rec_id, CAST(pos AS INT) AS pos, w[pos] AS token, w[pos + 1] AS next FROM (SELECT rec_id, w, unnest(generate_series(1, len(w))) AS pos FROM (SELECT rec_id, {index.tokens_sql('dh')} AS w FROM rashi))""")
def token_pairs(spark: SparkSession, base: str) -> DataFrame:
    """WIN7."""
    return sample.lookahead(table(spark, base, "rashi", "rec_id", "dh").withColumn("w", index.tokens(F.col("dh"))), "w", "rec_id")


# ---- inverted index and free text (FTX1-FTX6) ----

POSTED = f"""SELECT rec_id, field, token, {index.fold_sql('token')} AS fkey, count(*) AS n, CAST(min(pos) AS INT) - 1 AS first_pos, CAST(size AS INT) AS size FROM (
  SELECT rec_id, field, unnest(ts) AS token, generate_subscripts(ts, 1) AS pos, len(ts) AS size FROM (
    SELECT rec_id, 'dh' AS field, {index.tokens_sql('dh')} AS ts FROM rashi UNION ALL SELECT rec_id, 't', {index.tokens_sql('t')} FROM rashi UNION ALL SELECT rec_id, 'vt', {index.tokens_sql('vt')} FROM rashi))
GROUP BY rec_id, field, token, size"""
ASKED = f"SELECT DISTINCT id AS qid, unnest({index.query_tokens_sql('query')}) AS qtoken FROM queries_partial"
FOUND = f"""SELECT qtoken, token, round(20.0 * (1 - d / length(qkey)), 6) AS tier, round(1 - levenshtein(qtoken, {index.fold_vowels_sql('token')}) / greatest(length(qtoken), length({index.fold_vowels_sql('token')}), 1), 6) AS refine FROM (
  SELECT q.qtoken, q.qkey, v.token, levenshtein(q.qkey, v.fkey) AS d FROM (SELECT DISTINCT qtoken, {index.fold_sql('qtoken')} AS qkey FROM asked) q, (SELECT DISTINCT token, fkey FROM posted WHERE fkey <> '') v
  WHERE q.qkey <> '' AND abs(length(q.qkey) - length(v.fkey)) <= 2) WHERE d <= CASE WHEN length(qkey) < 3 THEN 0 WHEN length(qkey) < 6 THEN 1 ELSE 2 END"""


def _posted(spark: SparkSession, base: str, *fields: str) -> DataFrame:
    return index.postings(table(spark, base, "rashi", "rec_id", *fields), "rec_id", fields)


def _asked(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "queries_partial", "id", "query").select(F.col("id").alias("qid"), F.explode(index.query_tokens(F.col("query"))).alias("qtoken")).distinct()


@query(f"WITH posted AS MATERIALIZED ({POSTED}) SELECT (SELECT count(*) FROM rashi) AS records, (SELECT count(DISTINCT token) FROM posted) AS tokens, (SELECT CAST(sum(n) AS BIGINT) FROM posted) AS places, (SELECT count(*) FROM posted) AS postings")
def build_index(spark: SparkSession, base: str) -> DataFrame:
    """FTX1, PRJ7: the stored index, made if it isn't there yet, and what it holds."""
    words = store.vocabulary(spark, base).agg(F.count(F.lit(1)).alias("tokens"), F.sum("n").alias("places"))
    sizes = store.records(spark, base).agg(F.count(F.lit(1)).alias("records")), words, store.stored_postings(spark, base).agg(F.count(F.lit(1)).alias("postings"))
    return reduce(lambda a, b: a.join(b, "one"), [x.withColumn("one", F.lit(1)) for x in sizes]).select("records", "tokens", "places", "postings")


@query(POSTED)
def postings(spark: SparkSession, base: str) -> DataFrame:
    """FTX1."""
    return _posted(spark, base, "dh", "t", "vt")


@query(f"""WITH posted AS ({POSTED}) SELECT q.qtoken, p.rec_id, p.field, CAST(sum(p.n) AS BIGINT) AS n FROM (SELECT DISTINCT qtoken FROM ({ASKED})) q
JOIN posted p ON p.fkey = {index.fold_sql('q.qtoken')} AND p.fkey <> '' GROUP BY q.qtoken, p.rec_id, p.field""")
def exact_token_search(spark: SparkSession, base: str) -> DataFrame:
    """FTX2: how often each field of a record has each distinct query token, by equal keys."""
    asked = _asked(spark, base).select("qtoken").distinct().withColumn("fkey", index.fold(F.col("qtoken"))).where("fkey <> ''")
    return asked.join(store.stored_postings(spark, base), "fkey").groupBy("qtoken", "rec_id", "field").agg(F.sum("n").alias("n"))


@query(f"WITH posted AS ({POSTED}), asked AS ({ASKED}) {FOUND}")
def fuzzy_token_search(spark: SparkSession, base: str) -> DataFrame:
    """FTX3, FTX4: distinct pairs of query and vocabulary tokens within the bound, with tier and refinement."""
    return index.token_matches(cut(_asked(spark, base), "asked"), store.vocabulary(spark, base))


COVERED = """SELECT qid, rec_id, sum(n) / max(size) AS coverage FROM (SELECT DISTINCT a.qid, p.rec_id, p.token, p.n, p.size FROM asked a JOIN found f USING (qtoken) JOIN posted p ON p.token = f.token AND p.field = 'dh') GROUP BY qid, rec_id"""


def scored_sql(cover: float = 20.0, latin: float = 40.0) -> str:
    """Every record of every query with its score, popularity included."""
    return f"""SELECT qid, rec_id, round(score + {N.pop_boost_sql('lk')}, 6) AS score FROM (SELECT s.qid, s.rec_id, round(s.s + {cover} * coalesce(c.coverage, 0.0), 6) AS score FROM (
      SELECT qid, rec_id, sum(s) AS s FROM (SELECT qid, rec_id, qtoken, max(w * tier + CASE WHEN regexp_matches(qtoken, '[a-z]') THEN {latin} ELSE 10.0 END * refine) AS s FROM (
        SELECT qid, rec_id, qtoken, field, CASE field WHEN 'dh' THEN 3.0 ELSE 1.0 END AS w, m.tier AS tier, m.refine AS refine FROM (
          SELECT a.qid, p.rec_id, a.qtoken, p.field, max(struct_pack(tier := f.tier, refine := f.refine)) AS m FROM asked a JOIN found f USING (qtoken) JOIN posted p ON p.token = f.token GROUP BY ALL)) GROUP BY qid, rec_id, qtoken) GROUP BY qid, rec_id) s
    LEFT JOIN covered c USING (qid, rec_id)) JOIN (SELECT rec_id, lk FROM rashi) USING (rec_id)"""


MATCHED = f"WITH posted AS MATERIALIZED ({POSTED}), asked AS MATERIALIZED ({ASKED}), found AS MATERIALIZED ({FOUND}), covered AS MATERIALIZED ({COVERED})"


def hits_sql(scored: str) -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rec_id) AS rn FROM ({scored})) WHERE rn <= 60"


RANKED = f"{MATCHED}, hits AS MATERIALIZED ({hits_sql(scored_sql())})"


def _hits(spark: SparkSession, base: str, options: tuple[index.SearchOptions, ...] = (index.SearchOptions(),)) -> tuple[DataFrame, DataFrame]:
    """((option, q, rec_id, score), (qid, q)): the best 60 of every stored query, from one scan of the stored index. Stored queries belong to no week, so popularity is their only boost."""
    return blocks.search_sets(_asked(spark, base), store.lists(spark, base), store.vocabulary(spark, base), "rec_id", options, evaluate.LIMIT, "pop")


@query(f"""WITH posted AS MATERIALIZED ({POSTED}), asked AS (SELECT 'q' AS qid, 'ki' AS qtoken), found AS MATERIALIZED ({FOUND}), covered AS ({COVERED}), scored AS MATERIALIZED ({scored_sql()})
SELECT r.rec_id, coalesce(s.score, round(1.0 + {N.pop_boost_sql('lk')}, 6)) AS score FROM rashi r LEFT JOIN scored s USING (rec_id) WHERE c = 1 AND v = 2""")
def location_pin(spark: SparkSession, base: str) -> DataFrame:
    """FLT5, JN5: rows at a pinned place stay when the keywords miss; the others have their score from the index."""
    asked = spark.createDataFrame([("q", "ki")], "qid string, qtoken string")
    free = index.batch_search(asked, store.stored_postings(spark, base), "rec_id", vocabulary=store.vocabulary(spark, base))
    return search.search(store.records(spark, base), search.Query(chapter=1, verse=2, words="ki"), free, limit=None).select("rec_id", "score")


@query(RANKED + " SELECT qid, rec_id, score FROM hits")
def coverage_score_topk(spark: SparkSession, base: str) -> DataFrame:
    """FTX5, FTX6, SRT1: every stored query against lemma, body and verse, boosted by popularity, the best 60 each."""
    hits, names = _hits(spark, base)
    return hits.join(names, "q").select("qid", "rec_id", "score")


# ---- evaluation (AGG4-AGG7, AGG12, WIN1, JN9, SRT3, EVL3-EVL6) ----

GOLD = """SELECT q.id AS qid, min(r.rec_id) AS target, min(q.style) AS style, min(lower(trim(q.variant))) AS variant, min(q.dhWords) AS dhWords FROM queries_partial q
LEFT JOIN rashi r ON r.b = q.expected.b AND r.c = q.expected.c AND r.v = q.expected.v AND r.i = q.expected.i GROUP BY q.id"""
RESULTS = f"""SELECT g.*, CASE WHEN h.at IS NOT NULL THEN (SELECT count(*) FROM hits x WHERE x.qid = g.qid AND x.score > h.at) + 1 END AS rank,
CASE WHEN h.at IS NOT NULL THEN (SELECT count(*) FROM hits x WHERE x.qid = g.qid AND x.score = h.at) END AS tie FROM ({GOLD}) g LEFT JOIN (SELECT qid, rec_id AS target, score AS at FROM hits) h ON h.qid = g.qid AND h.target = g.target"""
METRICS = """count(*) AS n, round(100 * count(*) FILTER (rank = 1 AND tie = 1) / count(*), 1) AS top1, round(100 * count(*) FILTER (rank = 1) / count(*), 1) AS top1tied,
round(100 * count(*) FILTER (rank <= 3) / count(*), 1) AS top3, round(sum(coalesce(1 / rank, 0)) / count(*), 3) AS mrr, round(100 * count(*) FILTER (rank IS NULL) / count(*), 1) AS miss"""
BUCKET = "CASE WHEN dhWords <= 2 THEN '1-2' WHEN dhWords <= 4 THEN '3-4' ELSE '5+' END"


def _gold(spark: SparkSession, base: str) -> DataFrame:
    asked = table(spark, base, "queries_partial", "id", "style", "variant", "dhWords", "expected").select(F.col("id").alias("qid"), "style", F.lower(F.trim("variant")).alias("variant"), "dhWords", "expected.*")
    joined = asked.join(table(spark, base, "rashi", "rec_id", "b", "c", "v", "i"), ["b", "c", "v", "i"], "left")
    return joined.groupBy("qid").agg(F.min("rec_id").alias("target"), F.min("style").alias("style"), F.min("variant").alias("variant"), F.min("dhWords").alias("dhWords"))


@query(GOLD)
def gold_join(spark: SparkSession, base: str) -> DataFrame:
    """JN9."""
    return _gold(spark, base)


def _results(spark: SparkSession, base: str) -> DataFrame:
    return evaluate.set_ranks(*_hits(spark, base), _gold(spark, base)).withColumn("bucket", N.word_bucket(F.col("dhWords")))


@query(f"{RANKED} SELECT qid, rank, tie FROM ({RESULTS})")
def competition_rank(spark: SparkSession, base: str) -> DataFrame:
    """AGG7, WIN1: ranks among ``coverage_score_topk``."""
    return _results(spark, base).select("qid", "rank", "tie")


@query(f"""{RANKED}, results AS (SELECT *, {BUCKET} AS bucket FROM ({RESULTS}))
SELECT style, variant, bucket, CAST(grouping(style, variant, bucket) AS BIGINT) AS gid, {METRICS} FROM results GROUP BY GROUPING SETS ((), (style), (variant), (bucket))""")
def metrics_grouping_sets(spark: SparkSession, base: str) -> DataFrame:
    """AGG4, AGG5, AGG6, EVL4, NUM3."""
    return evaluate.by_groups(_results(spark, base), "style", "variant", "bucket")


@query(f"{RANKED} SELECT qid, rank, tie FROM ({RESULTS}) ORDER BY rank DESC NULLS FIRST, qid LIMIT 15")
def worst_k(spark: SparkSession, base: str) -> DataFrame:
    """SRT3, EVL5."""
    return evaluate.worst(_results(spark, base)).select("qid", "rank", "tie")


@query("SELECT CAST(max(length(b)) AS INT) AS b, CAST(max(length(p)) AS INT) AS p, CAST(max(length(CAST(c AS VARCHAR))) AS INT) AS c FROM rashi")
def column_widths(spark: SparkSession, base: str) -> DataFrame:
    """AGG12."""
    return evaluate.widths(table(spark, base, "rashi", "b", "p", "c"))


# The configurations of a sweep (coverage, refinement of Latin tokens); 10 is the refinement where none is named. The last is the first of the best again.
SWEEP = ((0.0, 10.0), (10.0, 10.0), (20.0, 10.0), (30.0, 10.0), (60.0, 10.0), (20.0, 40.0), (20.0, 75.0), (20.0, 40.0))
SWEPT = f"{MATCHED}, gold AS ({GOLD}), " + ", ".join(f"hits{i} AS MATERIALIZED ({hits_sql(scored_sql(*c))})" for i, c in enumerate(dict.fromkeys(SWEEP)))


def swept_sql(i: int) -> str:
    return RESULTS.replace("FROM hits", f"FROM hits{i}")


def _swept(spark: SparkSession, base: str) -> DataFrame:
    """(option, qid, rank, tie, ...): the results of every stored query under each distinct configuration, from one scan of the index."""
    distinct = list(dict.fromkeys(SWEEP))
    hits, names = _hits(spark, base, tuple(index.SearchOptions(coverage=c, refine_latin=r) for c, r in distinct))
    gold = _gold(spark, base).withColumn("option", F.explode(F.array(*[F.lit(i) for i in range(len(distinct))])))
    return evaluate.set_ranks(hits, names, gold, "rec_id", "option")


def _configured(results: DataFrame) -> DataFrame:
    """With config (1 to 8), coverage and refine for ``option``; a configuration named twice comes twice."""
    distinct = list(dict.fromkeys(SWEEP))
    configs = F.array(*[F.struct(F.lit(n).alias("config"), F.lit(c).alias("coverage"), F.lit(r).alias("refine"), F.lit(distinct.index((c, r))).alias("of")) for n, (c, r) in enumerate(SWEEP, 1)])
    return results.withColumn("x", F.explode(F.filter(configs, lambda x: x["of"] == F.col("option")))).select("x.config", "x.coverage", "x.refine", *[c for c in results.columns if c != "option"])


@query(f"{SWEPT} " + " UNION ALL ".join(f"SELECT CAST({n} AS INT) AS config, CAST({c} AS DOUBLE) AS coverage, CAST({r} AS DOUBLE) AS refine, {METRICS} FROM ({swept_sql(list(dict.fromkeys(SWEEP)).index((c, r)))})" for n, (c, r) in enumerate(SWEEP, 1)))
def weight_sweep(spark: SparkSession, base: str) -> DataFrame:
    """EVL6, AGG11: metrics under all eight configurations, all scored in one scan of one index."""
    return _configured(_swept(spark, base).groupBy("option").agg(*evaluate.metrics()))


@query(f"{SWEPT} " + " UNION ALL ".join(f"(SELECT CAST({n} AS INT) AS config, qid, rank, tie FROM ({swept_sql(list(dict.fromkeys(SWEEP)).index((c, r)))}) ORDER BY rank DESC NULLS FIRST, qid LIMIT 15)" for n, (c, r) in enumerate(SWEEP, 1)))
def sweep_worst(spark: SparkSession, base: str) -> DataFrame:
    """EVL6, SRT3: the 15 worst queries under each configuration."""
    ranked = _swept(spark, base).withColumn("badness", F.coalesce("rank", F.lit(1 << 40)))
    return _configured(search.top_by(ranked, "option", "badness", "qid", 15)).select("config", "qid", "rank", "tie")


# ---- sampling and query generation (WIN2-WIN6, SMP1-SMP3, SRT4, JN10, EVL1-EVL2, EVL7, FLT10-FLT11) ----

TIERED = f"SELECT *, CAST(floor((row_number() OVER (PARTITION BY bucket ORDER BY coalesce(lk, 0) DESC, rec_id) - 1) / ceil(count(*) OVER (PARTITION BY bucket) / 3)) AS INT) AS tier FROM (SELECT rec_id, lk, CASE WHEN n <= 2 THEN '1-2' WHEN n <= 4 THEN '3-4' ELSE '5+' END AS bucket FROM (SELECT rec_id, lk, len({X.words_sql('dh')}) AS n FROM rashi))"


def _bucketed(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "rashi", "rec_id", "dh", "lk").select("rec_id", "lk", N.word_bucket(F.size(X.words(F.col("dh")))).alias("bucket"))


@query(f"SELECT rec_id, bucket, tier FROM ({TIERED})")
def tercile_split(spark: SparkSession, base: str) -> DataFrame:
    """WIN3, SRT4."""
    return sample.terciles(_bucketed(spark, base), "lk", "rec_id", "bucket").select("rec_id", "bucket", "tier")


@query(f"""SELECT rec_id, bucket, tier, CAST(row_number() OVER (PARTITION BY bucket ORDER BY k, tier) AS INT) AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY bucket, tier ORDER BY md5('1:' || rec_id), rec_id) AS k FROM ({TIERED})) QUALIFY place <= 20""")
def spread_interleave(spark: SparkSession, base: str) -> DataFrame:
    """WIN4, WIN5, SMP3."""
    tiers = sample.terciles(_bucketed(spark, base), "lk", "rec_id", "bucket")
    return sample.interleaved(tiers, "tier", "rec_id", "bucket", 20).select("rec_id", "bucket", "tier", "place")


@query("SELECT rec_id FROM rashi ORDER BY md5('1:' || rec_id), rec_id LIMIT 25")
def uniform_sample(spark: SparkSession, base: str) -> DataFrame:
    """SMP1, WIN2, EVL7."""
    return sample.uniform(table(spark, base, "rashi", "rec_id"), "rec_id", 25)


@query("""SELECT rec_id, tier FROM (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY md5('1:' || rec_id), rec_id) AS k FROM (
  SELECT rec_id, CAST(floor((row_number() OVER (ORDER BY coalesce(lk, 0) DESC, rec_id) - 1) / ceil(count(*) OVER () / 3)) AS INT) AS tier FROM rashi)) WHERE k <= CASE tier WHEN 0 THEN 4 WHEN 1 THEN 4 ELSE 3 END""")
def stratified_sample(spark: SparkSession, base: str) -> DataFrame:
    """SMP2, SET3."""
    return sample.stratified(table(spark, base, "rashi", "rec_id", "lk"), "lk", "rec_id", 11).select("rec_id", "tier")


ALIGNED = f"""SELECT rec_id, list_transform(u, lambda x: coalesce(list_filter(vt, lambda y: {X.bare_sql('y')} = x)[1], list_filter(t, lambda y: {X.bare_sql('y')} = x)[1])) AS m FROM (
  SELECT rec_id, list_transform(list_filter({X.words_sql('dh')}, lambda x: translate(x, '’׳', '''''') NOT IN ('וגו''', 'וכו''') AND regexp_matches(x, '[א-ת]')), lambda x: {X.bare_sql("regexp_replace(x, '[׳''\"״]+$', '')")}) AS u,
  list_transform({X.words_sql('vt')}, lambda x: regexp_replace(x, '[\\x{{0591}}-\\x{{05af}}]', '', 'g')) AS vt, list_transform({X.words_sql('t')}, lambda x: regexp_replace(x, '[\\x{{0591}}-\\x{{05af}}]', '', 'g')) AS t FROM rashi) WHERE len(u) >= 1"""


def _vocalized(spark: SparkSession, base: str, *keep: str) -> DataFrame:
    df = table(spark, base, "rashi", "rec_id", *keep, "dh", "t", "vt")
    tokens = F.filter(X.words(F.col("dh")), X.usable)
    found = sample.aligned(F.transform(tokens, lambda t: X.bare(X.no_trailing_marks(t))), X.vocalized(F.col("vt")), X.vocalized(F.col("t")), X.bare)
    return df.where(F.size(tokens) >= 1).select("rec_id", *keep, F.explode(found).alias("m")).withColumn("dh_words", F.size("m"))


@query(f"SELECT rec_id, array_to_string(m, ' ') AS vocalized FROM ({ALIGNED}) WHERE len(list_filter(m, lambda x: x IS NULL)) = 0")
def skeleton_alignment(spark: SparkSession, base: str) -> DataFrame:
    """JN10, FLT10, FLT11, STR13-STR15: lemmas in the pointed spelling of verse or body."""
    return _vocalized(spark, base).select("rec_id", F.array_join("m", " ").alias("vocalized"))


@query("""SELECT id, query, style, variant FROM (SELECT *, row_number() OVER (PARTITION BY id, query ORDER BY style, variant, loaded_at) AS rn FROM queries_partial) WHERE rn = 1""")
def keep_first_query(spark: SparkSession, base: str) -> DataFrame:
    """WIN6, SET4."""
    df = table(spark, base, "queries_partial", "id", "query", "style", "variant", "loaded_at")
    return sample.keep_first(df, ["id", "query"], ["style", "variant", "loaded_at"]).select("id", "query", "style", "variant")


# ---- transliteration and generated queries (TRN1-TRN11, EVL1-EVL2) ----

STYLES = ("000_simple_sefardi", "075_artscroll_sephardic", "010_simple_ashkenazi")
BRAILLE = {he: T.styles()["310_braille"].signs[n] for he, n in T.LETTERS.items()}


def _values_sql(rows: tuple[tuple, ...], *columns: str) -> str:
    """The rows as literal SQL."""
    each = ", ".join("(" + ", ".join("NULL" if x is None else X.q(x) if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {each}) AS v({', '.join(columns)})"


@query(_values_sql(known.KNOWN_WORDS, "word", "style", "text", "html"))
def translit_known(spark: SparkSession, base: str) -> DataFrame:
    """TRN1-TRN11: known words in all styles, syllables parted, stress shown as each style does."""
    words = spark.createDataFrame([r[:2] for r in known.KNOWN_WORDS], "word string, style string")
    each = [words.where(F.col("style") == s).select("word", "style", T.full(F.col("word"), s).alias("x")) for s in T.styles()]
    return reduce(DataFrame.unionByName, each).select("word", "style", "x.text", "x.html")


@query(_values_sql(known.KNOWN_BOXES, "raw", "book", "section", "chapter", "verse", "words"))
def parse_known(spark: SparkSession, base: str) -> DataFrame:
    """PRS1-PRS9: Hebrew and Latin texts of the query box, with numerals, announced sections and near names."""
    names = parse.Names(list(known.BOX_BOOKS), list(known.BOX_SECTIONS))
    return parse.parse_all(spark.createDataFrame([(r[0],) for r in known.KNOWN_BOXES], "raw string"), "raw", names).select("raw", "parsed.book", "parsed.section", "parsed.chapter", "parsed.verse", "parsed.words")


@query(_values_sql(known.KNOWN_FOLIOS, "raw", "book", "leaf", "side", "words"))
def folio_known(spark: SparkSession, base: str) -> DataFrame:
    """RES4: folio places as typed."""
    found = [(r[0], parse.parse_folio(r[0], list(connectors.TRACTATES))) for r in known.KNOWN_FOLIOS]
    return spark.createDataFrame([(raw, q.book, q.leaf, q.side, q.words) for raw, q in found], "raw string, book string, leaf int, side int, words string")


@query(_values_sql(known.KNOWN_NUMERALS, "token", "value"))
def numerals_known(spark: SparkSession, base: str) -> DataFrame:
    """STR7: numerals, and tokens that are none."""
    return spark.createDataFrame([r[:1] for r in known.KNOWN_NUMERALS], "token string").select("token", N.parse_numeral(F.col("token")).alias("value"))


@query(_values_sql(known.KNOWN_HTML, "html", "plain", "bare"))
def clean_known(spark: SparkSession, base: str) -> DataFrame:
    """STR1, STR2: markup, entities and footnotes."""
    df = spark.createDataFrame([r[:1] for r in known.KNOWN_HTML], "html string")
    return df.select("html", X.clean(F.col("html")).alias("plain"), X.clean(F.col("html"), footnotes=True).alias("bare"))


@query(_values_sql(known.KNOWN_DRAWS, "seed", "draw").replace("SELECT *", "SELECT seed, CAST(draw AS DOUBLE) AS draw"))
def draws_known(spark: SparkSession, base: str) -> DataFrame:
    """NUM4: the first number of a seed."""
    return spark.createDataFrame([(s, round(N.FloatLcg(s).draw(), 9)) for s, _ in known.KNOWN_DRAWS], "seed int, draw double")


@query(f"SELECT rec_id, translate({X.normalize_sql('dh')}, '{''.join(BRAILLE)}', '{''.join(BRAILLE.values())}') AS cells FROM rashi")
def translit_letters(spark: SparkSession, base: str) -> DataFrame:
    """TRN8: letter mode of unpointed text."""
    return table(spark, base, "rashi", "rec_id", "dh").select("rec_id", T.letters_only(X.normalize(F.col("dh"))).alias("cells"))


@query()
def translit_styles(spark: SparkSession, base: str) -> DataFrame:
    """TRN1-TRN7, TRN9-TRN11: the lemmas in all fifteen styles."""
    return table(spark, base, "rashi", "rec_id", "dh").select("rec_id", T.in_styles(F.col("dh")).alias("x")).select("rec_id", "x.*")


@query()
def translit_stress(spark: SparkSession, base: str) -> DataFrame:
    """TRN1, TRN6, TRN7, TRN9: syllables and stress."""
    return table(spark, base, "rashi", "rec_id", "dh").select("rec_id", T.full(F.col("dh"), "000_simple_sefardi").alias("x")).select("rec_id", "x.*")


def _sampled_lemmas(spark: SparkSession, base: str, most: int) -> DataFrame:
    """The first ``most`` alignable records of each word bucket, popularity spread."""
    usable = _vocalized(spark, base, "b", "c", "v", "i", "lk").withColumn("bucket", N.word_bucket(F.col("dh_words")))
    return sample.interleaved(sample.terciles(usable, "lk", "rec_id", "bucket"), "tier", "rec_id", "bucket", most)


@query(f"""SELECT rec_id, bucket, tier, place, text FROM (SELECT *, CAST(row_number() OVER (PARTITION BY bucket ORDER BY k, tier) AS INT) AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY bucket, tier ORDER BY md5('1:' || rec_id), rec_id) AS k FROM (
    SELECT *, CAST(floor((row_number() OVER (PARTITION BY bucket ORDER BY coalesce(lk, 0) DESC, rec_id) - 1) / ceil(count(*) OVER (PARTITION BY bucket) / 3)) AS INT) AS tier FROM (
      SELECT a.rec_id, lk, array_to_string(m, ' ') AS text, CASE WHEN len(m) <= 2 THEN '1-2' WHEN len(m) <= 4 THEN '3-4' ELSE '5+' END AS bucket FROM ({ALIGNED}) a JOIN rashi USING (rec_id) WHERE len(list_filter(m, lambda x: x IS NULL)) = 0)))) WHERE place <= 20""")
def sampled_lemmas(spark: SparkSession, base: str) -> DataFrame:
    """EVL1, EVL2: the pointed lemmas that queries are made of, spread over buckets and popularity."""
    return _sampled_lemmas(spark, base, 20).select("rec_id", "bucket", "tier", "place", F.array_join("m", " ").alias("text"))


@query()
def generated_queries(spark: SparkSession, base: str) -> DataFrame:
    """EVL1: sampled lemmas in three styles, clean and sloppy, each text of a record once."""
    lemmas = _sampled_lemmas(spark, base, 20).withColumn("text", F.array_join("m", " "))
    styled = F.array(*[F.struct(F.lit(s).alias("style"), F.lit(k).alias("o"), X.clean_variant(T.transliterated(F.col("text"), s)).alias("clean")) for k, s in enumerate(STYLES)])
    each = lemmas.select("rec_id", "b", "c", "v", "i", "lk", "dh_words", F.explode(styled).alias("x")).select("*", "x.*")
    both = F.array(F.struct(F.lit("clean").alias("variant"), F.col("clean").alias("query")), F.struct(F.lit("sloppy").alias("variant"), X.sloppy_variant(F.col("clean")).alias("query")))
    flat = each.select("rec_id", "b", "c", "v", "i", "lk", "dh_words", "style", "o", F.posexplode(both).alias("k", "y")).select("*", "y.*").where("query <> ''").drop("y")
    return sample.keep_first(flat, ["rec_id", "query"], ["o", "k"]).select(F.format_string("%s.%d.%d.%d__%s__%s", "b", "c", "v", "i", "style", "variant").alias("id"), "query", "style", "variant", F.struct("b", "c", "v", "i").alias("expected"), F.col("dh_words").alias("dhWords"), "lk")


@query()
def partial_queries(spark: SparkSession, base: str) -> DataFrame:
    """EVL2, PRJ10: the first two words of long lemmas."""
    lemmas = _sampled_lemmas(spark, base, 20).where("dh_words >= 5").withColumn("two", F.array_join(F.slice("m", 1, 2), " "))
    text = X.clean_variant(T.transliterated(F.col("two"), STYLES[1]))
    return lemmas.select(F.format_string("%s.%d.%d.%d__%s__partial", "b", "c", "v", "i", F.lit(STYLES[1])).alias("id"), text.alias("query"), F.struct("b", "c", "v", "i").alias("expected"), F.col("dh_words").alias("dhWords"), "lk").where("query <> ''")


# ---- the query box (PRS1-PRS9, RES1, RES4) ----


def names_of(spark: SparkSession, base: str) -> parse.Names:
    """Books and sections: dimensions of a corpus, small by nature; checked before they come to the driver."""
    sections = table(spark, base, "sections", "b", "bh", "p", "ph", "ord_no").limit(100_001).collect()
    if len(sections) > 100_000:
        raise ValueError("more than 100,000 sections")
    sections.sort(key=lambda r: (r["b"], r["ord_no"]))
    return parse.Names(list(dict.fromkeys((r["b"], r["bh"]) for r in sections)), list(dict.fromkeys((r["p"], r["ph"], r["b"]) for r in sections)))


def box_search(spark: SparkSession, base: str, text: str, names: parse.Names) -> DataFrame:
    """The query box: parser, hypothesis check, then the search with filters, boosts and the best 60."""
    rows, words = store.records(spark, base), store.vocabulary(spark, base)

    def run(q: search.Query) -> DataFrame:
        said = list(dict.fromkeys(parse.plain_normalize(q.words).lower().split()))
        if not said:
            return search.search(rows, q)
        asked = spark.createDataFrame([("q", w) for w in said], "qid string, qtoken string")
        return search.search(rows, q, index.batch_search(asked, store.stored_postings(spark, base), "rec_id", vocabulary=words))

    def top(q: search.Query) -> dict | None:
        first = run(q).first()
        return first.asDict() if first else None

    return run(parse.resolve_soft(parse.parse(text, names), top))


#: The first book's first word, in Latin, and one word of its own.
BOXED = "lower(split_part((SELECT min(b) FROM sections), ' ', 1))"
BOX_ASKED = f"SELECT DISTINCT * FROM (SELECT 'free' AS qid, {BOXED} AS qtoken UNION ALL SELECT 'free', 'ki' UNION ALL SELECT 'kept', 'ki')"


@query(f"""WITH posted AS MATERIALIZED ({POSTED}), asked AS MATERIALIZED ({BOX_ASKED}), found AS MATERIALIZED ({FOUND}), covered AS ({COVERED}), scored AS MATERIALIZED ({scored_sql()}),
best AS (SELECT r.b FROM scored s JOIN rashi r USING (rec_id) WHERE s.qid = 'free' ORDER BY s.score DESC, s.rec_id LIMIT 1),
chosen AS (SELECT CASE WHEN NOT EXISTS (SELECT * FROM best) OR (SELECT b FROM best) = (SELECT min(b) FROM sections) THEN 'kept' ELSE 'free' END AS qid)
SELECT rec_id, r.b, r.c, r.v, r.i, s.score FROM scored s JOIN rashi r USING (rec_id) WHERE s.qid = (SELECT qid FROM chosen) AND (s.qid = 'free' OR r.b = (SELECT min(b) FROM sections)) ORDER BY s.score DESC, rec_id LIMIT 60""")
def smart_search(spark: SparkSession, base: str) -> DataFrame:
    """PRS1-PRS9, RES1, FTX6: the first book's name and a word through parser, hypothesis check and search."""
    names = names_of(spark, base)
    return box_search(spark, base, f"{min(names.books.values()).split()[0]} ki", names).select("rec_id", "b", "c", "v", "i", "score")


BOOKS_SQL = "SELECT DISTINCT b, bh FROM sections"
#: (kind, spelled, key, book, section): what books and sections may be called, by spelling and by folded key.
CALLED_SQL = f"""SELECT DISTINCT kind, spelled, key, book, section FROM (
  SELECT 'book' AS kind, lower(w) AS spelled, {index.fold_sql('lower(w)')} AS key, b AS book, '' AS section FROM (SELECT b, unnest(list_append(regexp_extract_all(b, '[^\\d\\s_''\\pP]+'), replace(bh, ' ', ''))) AS w FROM ({BOOKS_SQL}))
  UNION ALL SELECT 'section', said, array_to_string(list_transform(string_split(said, ' '), lambda w: {index.fold_sql('w')}), '|'), b, p
  FROM (SELECT b, p, lower({X.normalize_sql("replace(x, '-', ' ')")}) AS said FROM (SELECT b, p, unnest([p, ph]) AS x FROM sections)) WHERE len(string_split(said, ' ')) <= 2)"""


def _named_sql(kind: str) -> str:
    """(i, n, book, section) of the runs of query tokens that name one book or section: by spelling, else by the nearest key."""
    return f"""SELECT query, i, n, arg_min(book, how) AS book, arg_min(section, how) AS section, arg_min(fuzzy, how) AS fuzzy FROM (
      SELECT query, i, n, 1 AS how, min(c.book) AS book, min(c.section) AS section, false AS fuzzy FROM runs JOIN called c ON c.kind = '{kind}' AND c.spelled = said GROUP BY query, i, n HAVING count(DISTINCT (c.book, c.section)) = 1
      UNION ALL SELECT query, i, n, 2, min(book), min(section), min(d) > 0 FROM (
        SELECT r.query, r.i, r.n, c.book, c.section, levenshtein(r.key, c.key) AS d, min(levenshtein(r.key, c.key)) OVER (PARTITION BY r.query, r.i, r.n) AS best
        FROM runs r JOIN called c ON c.kind = '{kind}' AND c.key <> '' AND length(r.key) >= 3 AND levenshtein(r.key, c.key) <= CASE WHEN length(r.key) >= 6 THEN 2 ELSE 1 END)
      WHERE d = best GROUP BY query, i, n HAVING count(DISTINCT (book, section)) = 1) GROUP BY query, i, n"""


PARSED_WITH = f"""WITH called AS MATERIALIZED ({CALLED_SQL}), said AS MATERIALIZED (SELECT DISTINCT query, list_filter(string_split({X.normalize_sql('query')}, ' '), lambda t: t <> '') AS ts FROM queries_partial),
runs AS MATERIALIZED (SELECT query, i, n, array_to_string(list_transform(ts[i:i + n - 1], lambda w: lower(w)), ' ') AS said, array_to_string(list_transform(ts[i:i + n - 1], lambda w: {index.fold_sql('lower(w)')}), '|') AS key
  FROM (SELECT query, ts, unnest(range(1, len(ts) + 1)) AS i FROM said), (VALUES (1), (2)) AS l(n) WHERE i + n - 1 <= len(ts)),
taken AS (SELECT query, arg_min((i, n, book, section, fuzzy), (i, o)) AS x FROM (
  SELECT query, i, n, book, section, fuzzy, 1 AS o FROM ({_named_sql('section')}) WHERE n = 2 UNION ALL SELECT query, i, n, book, section, fuzzy, 2 FROM ({_named_sql('book')}) WHERE n = 1 AND i = 1
  UNION ALL SELECT query, i, n, book, section, fuzzy, 3 FROM ({_named_sql('section')}) WHERE n = 1 AND i = 1) GROUP BY query)"""
PARSED_ROWS = """SELECT s.query, coalesce(x[3], '') AS book, coalesce(x[4], '') AS section, coalesce(x[5], false) AS soft_fuzzy, array_to_string(CASE WHEN x IS NULL THEN ts ELSE list_concat(ts[1:x[1] - 1], ts[x[1] + x[2]:]) END, ' ') AS words FROM said s LEFT JOIN taken USING (query)"""


@query(f"{PARSED_WITH} {PARSED_ROWS}")
def parsed_queries(spark: SparkSession, base: str) -> DataFrame:
    """PRS1-PRS9, JN7, RES2, RES3: every stored query through the query box's parser, with the corpus' own names."""
    asked = table(spark, base, "queries_partial", "query").distinct()
    return parse.parse_all(asked, "query", names_of(spark, base)).select("query", "parsed.book", "parsed.section", "parsed.soft_fuzzy", "parsed.words")


# ---- the whole pipeline for a query set (EVL3) ----


def pipeline_hits(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    """((q, rec_id, score), (qid, q)): what the query box returns for every stored query, the best 60 each.

    Parser, hypothesis check and search as for one query, in one batch: each query is
    searched as parsed, within its filters, and, where its filter is in doubt, also as
    free text; the filter stays if the best free record lies within it. Searches of the
    same tokens and filters are one, under one number. Queries that are all filter browse
    it by popularity, once for each distinct filter. A chapter and verse keep the records
    there at 1 at least.
    """
    asked = table(spark, base, "queries_partial", "id", "query").distinct().select(F.col("id").alias("id"), "query")
    flat = cut(parse.parse_all(asked, "query", names_of(spark, base)).select("id", "parsed.*"), "parsed")
    doubt = (F.col("soft") != "") & (F.col("chapter") == 0) & (F.col("verse") == 0) & ((F.col("words") != "") | F.col("soft_fuzzy"))
    scope = [F.nullif(F.col(a), F.lit(x)).alias(c) for a, c, x in (("book", "b", ""), ("section", "p", ""), ("chapter", "c", 0), ("verse", "v", 0))]
    both = flat.select("id", F.lit("kept").alias("way"), F.col("words").alias("said"), *scope).unionByName(
        flat.where(doubt).select("id", F.lit("free").alias("way"), F.concat_ws(" ", "soft", "words").alias("said"), *[F.lit(None).cast(t).alias(c) for c, t in (("b", "string"), ("p", "string"), ("c", "int"), ("v", "int"))])
    )
    words = F.filter(F.split(F.lower("said"), " "), lambda t: t != "")
    each = both.groupBy("id", "way").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(words)))).alias("ts"), F.min(F.struct("b", "p", "c", "v")).alias("x")).select("id", "way", "ts", "x.*")
    each, same = cut(each, "ways"), ("ts", "b", "p", "c", "v")
    kinds = cut(each.select(*same).distinct().withColumn("q", F.monotonically_increasing_id()), "searches")
    named = kinds.select("q", *[F.col(c).alias(f"_{c}") for c in same])
    owners = each.join(named, reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in same])).groupBy("id").agg(*[F.max(F.when(F.col("way") == w, F.col("q"))).alias(w) for w in ("kept", "free")])
    owners = cut(owners, "owners")
    records = store.lists(spark, base)
    found = blocks.search_all(kinds.select(F.col("q").alias("qid"), F.explode("ts").alias("qtoken")), records, store.vocabulary(spark, base), "rec_id", (index.SearchOptions(),), evaluate.LIMIT, "pop", kinds.withColumnRenamed("q", "qid"), ("b", "p", "c", "v"))
    found = cut(found.select(F.col("qid").alias("q"), "rec_id", "score"), "found")
    spots = records.select("rec_id", "b", "p", "c", "v", F.round(1.0 + F.col("pop"), 6).alias("score"))
    # One row for each distinct filter; a pin is a filter whose records stay although the words miss.
    browsed = kinds.where("size(ts) = 0 or (c is not null and v is not null)").withColumn("scope", F.concat_ws("|", *[F.coalesce(F.col(x).cast("string"), F.lit("")) for x in "bpcv"]))
    filters = browsed.select("b", "p", "c", "v", "scope").distinct()
    hold = [(F.col(f"k.{x}").isNull()) | (F.col(f"k.{x}") == F.col(f"r.{x}")) for x in "pcv"]
    held = spots.alias("r").join(filters.alias("k"), (F.col("k.b") == F.col("r.b")) & hold[0] & hold[1] & hold[2]).select("scope", "rec_id", "score")
    pins = browsed.select("q", "scope").join(search.top_by(held, "scope", "score", "rec_id", evaluate.LIMIT), "scope").select("q", "rec_id", "score")
    merged = found.join(browsed.select("q"), "q", "left_semi").unionByName(pins).groupBy("q", "rec_id").agg(F.max("score").alias("score"))
    hits = found.join(browsed.select("q"), "q", "left_anti").unionByName(search.top_by(merged, "q", "score", "rec_id", evaluate.LIMIT))
    best = found.join(owners.select(F.col("free").alias("q")).where("q is not null").distinct(), "q", "left_semi").groupBy(F.col("q").alias("free")).agg(F.min(F.struct(-F.col("score"), "rec_id"))["rec_id"].alias("rec_id"))
    best = best.join(spots.select("rec_id", F.col("b").alias("top_b"), F.col("p").alias("top_p")), "rec_id").drop("rec_id")
    inside = F.when(F.col("section") != "", F.col("top_p") == F.col("section")).otherwise(F.col("top_b") == F.col("book"))
    chosen = flat.join(owners, "id").join(best, "free", "left").select(F.col("id").alias("qid"), F.when(doubt & F.col("top_b").isNotNull() & ~F.coalesce(inside, F.lit(False)), F.col("free")).otherwise(F.col("kept")).alias("q"))
    return hits, chosen


WAYS = f"""{PARSED_WITH}, parsed AS MATERIALIZED ({PARSED_ROWS}),
p AS MATERIALIZED (SELECT DISTINCT q.id, p.*, book <> '' AND (words <> '' OR soft_fuzzy) AS doubt, ts FROM (SELECT DISTINCT id, query FROM queries_partial) q JOIN parsed p USING (query) JOIN said USING (query)),
posted AS MATERIALIZED ({POSTED}), asked AS MATERIALIZED (SELECT DISTINCT * FROM (SELECT 'kept:' || id AS qid, lower(unnest(string_split(words, ' '))) AS qtoken FROM p WHERE words <> '' UNION ALL SELECT 'free:' || id, lower(unnest(ts)) FROM p WHERE doubt)),
found AS MATERIALIZED ({FOUND}), covered AS MATERIALIZED ({COVERED}), scored AS MATERIALIZED ({scored_sql()}),
within AS MATERIALIZED (SELECT s.qid, s.rec_id, s.score FROM scored s JOIN p ON s.qid = 'kept:' || p.id JOIN rashi r USING (rec_id) WHERE (book = '' OR r.b = book) AND (section = '' OR r.p = section)
  UNION ALL SELECT qid, rec_id, score FROM scored WHERE starts_with(qid, 'free:')
  UNION ALL SELECT 'kept:' || p.id, r.rec_id, round(1.0 + {N.pop_boost_sql('r.lk')}, 6) FROM p JOIN rashi r ON r.b = p.book AND (section = '' OR r.p = section) WHERE words = ''),
best AS (SELECT qid, arg_min((r.b, r.p), (-score, rec_id)) AS x FROM within JOIN rashi r USING (rec_id) WHERE starts_with(qid, 'free:') GROUP BY qid),
chosen AS (SELECT p.id, CASE WHEN doubt AND x IS NOT NULL AND NOT coalesce(CASE WHEN section <> '' THEN x[2] = section ELSE x[1] = book END, false) THEN 'free:' ELSE 'kept:' END || p.id AS qid FROM p LEFT JOIN best ON best.qid = 'free:' || p.id),
hits AS MATERIALIZED (SELECT * FROM (SELECT c.id AS qid, w.rec_id, w.score, row_number() OVER (PARTITION BY c.id ORDER BY w.score DESC, w.rec_id) AS rn FROM chosen c JOIN within w USING (qid)) WHERE rn <= 60)"""


@query(f"{WAYS} SELECT qid, rank, tie FROM ({RESULTS})")
def pipeline_rank(spark: SparkSession, base: str) -> DataFrame:
    """EVL3, RES1, FTX6: the rank of every stored query's target in what the query box returns."""
    return evaluate.set_ranks(*pipeline_hits(spark, base), _gold(spark, base)).select("qid", "rank", "tie")


@query(f"{WAYS}, results AS (SELECT *, {BUCKET} AS bucket FROM ({RESULTS})) SELECT style, variant, bucket, CAST(grouping(style, variant, bucket) AS BIGINT) AS gid, {METRICS} FROM results GROUP BY GROUPING SETS ((), (style), (variant), (bucket))")
def pipeline_metrics(spark: SparkSession, base: str) -> DataFrame:
    """EVL3, EVL4: metrics of the whole pipeline."""
    return evaluate.by_groups(evaluate.set_ranks(*pipeline_hits(spark, base), _gold(spark, base)).withColumn("bucket", N.word_bucket(F.col("dhWords"))), "style", "variant", "bucket")
