"""Inverted index over folded tokens, and batched free-text search.

Folding maps Hebrew and transliterated words onto one consonant key: vowels, vav, yod
and silent letters are dropped, letters that sound alike share a class, and repeats
collapse. A query token matches a vocabulary token if their keys are equal, or within a
small edit distance; the expensive comparisons are made once for each distinct pair of
tokens, whatever then happens to the records (``blocks``, ``batch_search``).

Score of a record for a query (this engine's own design): for each query token the best
over the fields of ``weight * tier + refine_weight * refine``, summed, plus
``coverage_weight`` times the share of the lemma's tokens that matched. ``tier`` is 20
for equal keys and falls with the distance; ``refine`` compares the unfolded spellings.
The score is linear in both weights, so sweeps reuse one feature table, and it uses no
corpus statistics, so filters may go first.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.functions.text import clean_variant, clean_variant_sql, normalize, normalize_sql
from lexforge.plans.lineage import cut

# Consonant classes of folding. First letter groups of transliteration, then letters.
GROUPS = (("sch", "S"), ("sh", "S"), ("tz", "S"), ("ts", "S"), ("ch", "K"), ("kh", "K"), ("th", "T"), ("ph", "B"), ("gh", "G"), ("dh", "D"))
LETTERS = "bvpfwgdzkqcxlmnrstj" + "בפףגדזחכךקלםמנןרסשצץטת"
CLASSES = "BBBBBGDZKKKKLMNRSTG" + "BBBGDZKKKKLMMNNRSSSSTT"
SILENT = "aeiouyh'" + "אהעוי"


@dataclass(frozen=True)
class SearchOptions:
    """Weights of the free-text score and the limit of a result."""

    fields: dict[str, float] = field(default_factory=lambda: {"dh": 3.0, "t": 1.0, "vt": 1.0})
    tier: float = 20.0
    refine_latin: float = 40.0
    refine_other: float = 10.0
    coverage: float = 20.0
    limit: int = 60


def fold(token: Column) -> Column:
    """The consonant key of a normalized, lower-case token; signs of other scripts have no place in it."""
    for a, b in GROUPS:
        token = F.replace(token, F.lit(a), F.lit(b))
    return F.regexp_replace(F.regexp_replace(F.translate(token, LETTERS + SILENT, CLASSES), "[^A-Z0-9]", ""), "([A-Z])\\1+", "$1")


def fold_sql(token: str) -> str:
    for a, b in GROUPS:
        token = f"replace({token}, '{a}', '{b}')"
    token = f"regexp_replace(translate({token}, '{LETTERS + SILENT.replace(chr(39), chr(39) * 2)}', '{CLASSES}'), '[^A-Z0-9]', '', 'g')"
    for x in sorted(set(CLASSES)):
        token = f"regexp_replace({token}, '{x}+', '{x}', 'g')"
    return token


def tokens(text: Column) -> Column:
    """Normalized tokens of a text in any script; Latin ones in small letters without accents."""
    return F.filter(F.split(F.lower(normalize(text)), " "), lambda t: t != "")


def tokens_sql(text: str) -> str:
    return f"list_filter(string_split(lower({normalize_sql(text)}), ' '), lambda t: t <> '')"


def query_tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.translate(clean_variant(text), "'", ""), " "), lambda t: t != ""))


def query_tokens_sql(text: str) -> str:
    return f"list_distinct(list_filter(string_split(translate({clean_variant_sql(text)}, '''', ''), ' '), lambda t: t <> ''))"


def postings(df: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """(key, field, token, fkey, n, first_pos, size): each distinct token of each field, with the field's token count."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), tokens(F.col(f)).alias("ts")) for f in fields])).alias("x")
    flat = df.select(key, each).select(key, "x.field", F.size("x.ts").alias("size"), F.posexplode("x.ts").alias("pos", "token"))
    counted = flat.groupBy(key, "field", "token", "size").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"))
    return counted.select(key, "field", "token", fold(F.col("token")).alias("fkey"), "n", "first_pos", "size")


def deletions(word: Column, most: int) -> Column:
    """``word`` and all words with up to ``most`` (1 or 2) of its signs left out."""

    def one(w: Column) -> Column:
        return F.when(F.length(w) > 0, F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))).otherwise(F.array(F.lit("")))

    first = one(word)
    ways = [F.array(word), first] if most < 2 else [F.array(word), first, F.flatten(F.transform(first, one))]
    return F.array_distinct(F.concat(*ways))


def distance_bound(word: Column) -> Column:
    """Typos allowed: none below 3 signs, one below 6, else two."""
    return F.when(F.length(word) < 3, 0).when(F.length(word) < 6, 1).otherwise(2)


def near(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct (a, b, d): words of ``left`` and ``right`` within the bound for ``a``.

    An equi-join on common deletions finds every such pair without comparing all; the
    edit distance then settles them.
    """
    lo = left.select(a).distinct().withColumn("_m", distance_bound(F.col(a)))
    lx = lo.select(a, "_m", F.explode(F.when(F.col("_m") == 0, F.array(a)).when(F.col("_m") == 1, deletions(F.col(a), 1)).otherwise(deletions(F.col(a), 2))).alias("_x"))
    ro = right.select(b).distinct()
    rx = ro.select(b, F.explode(deletions(F.col(b), 2)).alias("_x"))
    pairs = lx.join(rx, "_x").select(a, b, "_m").distinct()
    return pairs.withColumn("d", F.levenshtein(a, b)).where("d <= _m").drop("_m")


def token_matches(asked: DataFrame, vocabulary: DataFrame, options: SearchOptions = SearchOptions()) -> DataFrame:
    """(qtoken, token, tier, refine) for each distinct query token and vocabulary token that match.

    ``asked`` has ``qtoken``; ``vocabulary`` has ``token``, each once, and ``fkey``. Empty keys match nothing.
    """
    qs = asked.select("qtoken").distinct().withColumn("qkey", fold(F.col("qtoken"))).where("qkey <> ''")
    vs = vocabulary.select("token", "fkey").where("fkey <> ''")
    keys = near(qs, vs, "qkey", "fkey")
    both = qs.join(keys, "qkey").join(vs, "fkey")
    spelled = fold_vowels(F.col("token"))
    longest = F.greatest(F.length("qtoken"), F.length(spelled), F.lit(1))
    refine = F.round(1 - F.levenshtein(F.col("qtoken"), spelled) / longest, 6)
    tier = F.round(options.tier * (1 - F.col("d") / F.length("qkey")), 6)
    return both.select("qtoken", "token", tier.alias("tier"), refine.alias("refine"))


# A letter-for-letter rendering of Hebrew, for comparing spellings.
PLAIN_FROM = "אבגדהוזחטיכךלמםנןסעפףצץקרשת"
PLAIN_TO = "abgdhvzhtykklmmnnsappzzkrst"


def fold_vowels(token: Column) -> Column:
    """A Hebrew token in Latin letters, one for each; ASCII stays, other signs go."""
    return F.regexp_replace(F.translate(token, PLAIN_FROM, PLAIN_TO), "[^ -~]", "")


def fold_vowels_sql(token: str) -> str:
    return f"regexp_replace(translate({token}, '{PLAIN_FROM}', '{PLAIN_TO}'), '[^ -~]', '', 'g')"


def features(found: DataFrame, post: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """(qtoken, key, m_<field>): the best (tier, refine) of each query token in each field of a record.

    Made once for each distinct query token, however many queries share it; one shuffle.
    """
    hits = found.join(post.select(key, "field", "token"), "token")
    best = [F.max(F.when(F.col("field") == f, F.struct("tier", "refine"))).alias(f"m_{f}") for f in fields]
    return hits.groupBy("qtoken", key).agg(*best)


def totals(asked: DataFrame, feats: DataFrame, key: str, options: SearchOptions = SearchOptions()) -> DataFrame:
    """(qid, key, s): the sum over a query's tokens of each one's best field."""
    refine = F.when(F.col("qtoken").rlike("[a-z]"), options.refine_latin).otherwise(options.refine_other)
    each = [w * F.col(f"m_{f}.tier") + refine * F.col(f"m_{f}.refine") for f, w in options.fields.items()]
    scored = feats.select("qtoken", key, (F.greatest(*each) if len(each) > 1 else each[0]).alias("s")).where("s is not null")
    return asked.join(scored, "qtoken").groupBy("qid", key).agg(F.sum("s").alias("s"))


def coverage(rows: DataFrame, asked: DataFrame, found: DataFrame, post: DataFrame, key: str, lemma: str = "dh") -> DataFrame:
    """(qid, key, coverage) for ``rows`` (qid, key): the share of the lemma's tokens that some query token matched."""
    matched = asked.join(found.select("qtoken", "token"), "qtoken").select("qid", "token").distinct()
    tokens_of = rows.select("qid", key).join(post.where(F.col("field") == lemma).select(key, "token", "n", "size"), key)
    return tokens_of.join(matched, ["qid", "token"]).groupBy("qid", key).agg((F.sum("n") / F.first("size")).alias("coverage"))


def scores(total: DataFrame, covered: DataFrame, key: str, options: SearchOptions = SearchOptions()) -> DataFrame:
    """(qid, key, score) from token totals and coverage."""
    return total.join(covered, ["qid", key], "left").select("qid", key, F.round(F.col("s") + options.coverage * F.coalesce("coverage", F.lit(0.0)), 6).alias("score"))


def batch_search(asked: DataFrame, post: DataFrame, key: str, options: SearchOptions = SearchOptions(), vocabulary: DataFrame | None = None) -> DataFrame:
    """(qid, key, score) of all records that match some token of each query, for a few queries; ``blocks.search_all`` takes a set of any size.

    Only the postings of matching tokens are read on: the matches are written once, and
    the postings joined to them once for scores and coverage together.
    """
    words = vocabulary if vocabulary is not None else post.select("token", "fkey").distinct()
    found = cut(token_matches(asked, words, options), "matches")
    hits = cut(post.join(found.select("token").distinct(), "token", "left_semi"), "hits")
    total = totals(asked, features(found, hits, key, tuple(options.fields)), key, options)
    return scores(total, coverage(total, asked, found, hits, key), key, options)
