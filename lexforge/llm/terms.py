"""Problems 1 and 6: the terms of a collection.

A term is a longest run of the letters U+05D0 to U+05EA in a value's plain spelling,
after the Hebrew points and accents and the characters ``'`` and ``"`` are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.llm.plain import duck, lookalikes, plain_sql
from lexforge.plans.lineage import cut

# Hebrew points and accents (maqaf, paseq, sof pasuq and nun hafukha are
# punctuation and separate terms), and the two quotation marks that a term may hold.
DROPPED = "[\\x{0591}-\\x{05BD}\\x{05BF}\\x{05C1}\\x{05C2}\\x{05C4}\\x{05C5}\\x{05C7}'\"]+"
LETTERS = "[\\x{05D0}-\\x{05EA}]+"

#: A term with more than this share of all postings is heavy: there can be no more than
#: 1 / HEAVY such terms, whatever the data, so their statistics may be broadcast.
HEAVY = 1e-4


def _terms_sql(values: str, rest: str) -> str:
    """``rest`` and ``counts``, a map from term to occurrences, for each of ``values``."""
    found = f"regexp_extract_all(regexp_replace(plain, '{DROPPED.replace(chr(39), chr(39) * 2)}', '', 'g'), '{LETTERS}')"
    return f"SELECT {rest}, list_aggregate({found}, 'histogram') AS counts FROM {plain_sql(values, rest)}"


def record_terms(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """The term counts of each record over all ``fields`` together, one row a record.

    Columns ``uid`` (of the row, also where keys repeat or are null), ``key``, ``n``
    (terms of the record), ``terms`` and ``counts``. A null or empty field has no terms.
    """
    named = df.select(F.col(key).alias("key"), F.concat_ws("\n", *[F.col(c).cast("string") for c in fields]).alias("value"))
    kind = named.schema["key"].dataType.simpleString()
    sql = f"""SELECT uid, key, CAST(coalesce(list_sum(map_values(counts)), 0) AS BIGINT) AS n, map_keys(counts) AS terms, CAST(map_values(counts) AS BIGINT[]) AS counts
              FROM ({_terms_sql("batch", "uid, key")})"""

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + b.num_rows)), *b.columns], names=["uid", *b.schema.names])
            at += b.num_rows

    alike = lookalikes()
    return named.mapInArrow(lambda it: duck(numbered(it), sql, alike), f"uid bigint, key {kind}, n bigint, terms array<string>, counts array<bigint>")


def term_frequency(df: DataFrame, fields: list[str], rare_records: int = 1, common_share: float = 0.05) -> DataFrame:
    """Occurrences and records of every distinct term of each field, with a mark.

    Per-record counts are made in the Arrow partitions; Spark's hash aggregate then sums
    them map-side before the one shuffle, which so moves each term at most once a
    partition however hot it is. Columns: field, term, n_occurrences, n_records, mark
    (``rare`` up to ``rare_records`` records, ``common`` beyond ``common_share`` of all
    rows, else null; ``rare`` wins in collections so small that both hold). All rows
    count as records, repeated ones too; null and empty values have no terms; an empty
    table gives no rows.
    """
    named = df.select(*[F.col(c).cast("string").alias(f"f{i}") for i, c in enumerate(fields)])
    values = "(" + " UNION ALL ".join(f"SELECT '{i}' AS field, f{i} AS value FROM batch WHERE f{i} IS NOT NULL" for i in range(len(fields))) + ")"
    sql = f"SELECT field, map_keys(counts) AS terms, CAST(map_values(counts) AS BIGINT[]) AS counts FROM ({_terms_sql(values, 'field')}) WHERE counts IS NOT NULL"
    rows = df.select(F.count(F.lit(1)).alias("rows")).first()[0]
    alike = lookalikes()
    counted = (
        named.mapInArrow(lambda it: duck(it, sql, alike), "field string, terms array<string>, counts array<bigint>")
        .select("field", F.explode(F.arrays_zip("terms", "counts")).alias("x"))
        .groupBy("field", F.col("x.terms").alias("term"))
        .agg(F.sum("x.counts").alias("n_occurrences"), F.count(F.lit(1)).alias("n_records"))
    )
    names = F.create_map(*[F.lit(x) for i, c in enumerate(fields) for x in (str(i), c)])
    mark = F.when(F.col("n_records") <= rare_records, "rare").when(F.col("n_records") > rows * common_share, "common")
    return counted.select(names[F.col("field")].alias("field"), "term", "n_occurrences", "n_records", mark.alias("mark"))


def _log_factorial(n: np.ndarray) -> np.ndarray:
    """log n! = log-gamma(n + 1): exact sums up to 255, Stirling's series beyond."""
    x = n + 1.0
    safe = np.maximum(x, 2.0)
    series = (safe - 0.5) * np.log(safe) - safe + 0.5 * np.log(2 * np.pi) + 1 / (12 * safe) - 1 / (360 * safe**3) + 1 / (1260 * safe**5)
    small = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 256)))])
    return np.where(n < 256, small[np.minimum(n, 255).astype(np.int64)], series)


def log_upper_tail(k: np.ndarray, draws: np.ndarray, good: np.ndarray, total: int) -> np.ndarray:
    """log P(X >= k) for X hypergeometric: ``draws`` of ``total`` items, ``good`` of them of the kind.

    The first probability comes from log-gamma sums; its neighbours follow by their
    exact ratios, upward from k where k lies above the mean, else downward from k - 1
    and by the complement. All in float64 arrays.
    """
    k, n, g = (np.asarray(a, dtype=np.float64) for a in (k, draws, good))
    lf = _log_factorial
    up = k * (total + 2.0) > (n + 1) * (g + 1)
    j = np.where(up, k, k - 1)
    first = lf(g) - lf(j) - lf(np.maximum(g - j, 0)) + lf(total - g) - lf(np.maximum(n - j, 0)) - lf(np.maximum(total - g - n + j, 0)) - lf(np.full_like(k, total)) + lf(n) + lf(total - n)
    term, acc, at = np.ones_like(k), np.ones_like(k), j.copy()
    live = np.flatnonzero(np.where(up, j < np.minimum(n, g), j > np.maximum(0, n + g - total)))
    while live.size:
        a, gn, nn, u = at[live], g[live], n[live], up[live]
        ratio = np.where(u, (gn - a) * (nn - a) / ((a + 1) * (total - gn - nn + a + 1)), a * (total - gn - nn + a) / ((gn - a + 1) * (nn - a + 1)))
        term[live] *= ratio
        acc[live] += term[live]
        at[live] += np.where(u, 1, -1)
        a, u = at[live], up[live]
        live = live[(term[live] > 1e-17 * acc[live]) & np.where(u, a < np.minimum(nn, gn), a > np.maximum(0, nn + gn - total))]
    with np.errstate(divide="ignore", invalid="ignore"):
        logs = first + np.log(acc)
        low = np.where((k <= np.maximum(0, n + g - total)), 0.0, np.log1p(-np.minimum(np.exp(np.minimum(logs, 0)), 1 - 1e-16)))
    return np.where(up, np.minimum(logs, 0.0), low)


def _adjusted(uid: np.ndarray, logp: np.ndarray) -> np.ndarray:
    """Benjamini-Hochberg within each run of equal ``uid``, in logarithms."""
    order = np.lexsort((logp, uid))
    u, lp = uid[order], logp[order]
    start = np.flatnonzero(np.r_[True, u[1:] != u[:-1]])
    size = np.diff(np.r_[start, u.size])
    group = np.repeat(np.arange(start.size), size)
    rank = np.arange(u.size) - start[group] + 1
    q = np.minimum(lp + np.log(size[group]) - np.log(rank), 0.0)
    # A running minimum from the right; the shift keeps each group above the ones before it.
    shift = (1.0 - q.min()) * group if q.size else q
    q = np.minimum.accumulate((q + shift)[::-1])[::-1] - shift
    out = np.empty_like(q)
    out[order] = q
    return out


def distinctive_terms(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """How characteristic each term of a record is of it, against the whole collection.

    Method: hypergeometric enrichment. With N terms in the collection, K of them this
    one, a record of n terms holds k or more of it with the exact upper-tail probability
    p; Benjamini-Hochberg over the terms of the record makes q of it, and the score is
    -log10 q. Everyday terms come near 0, rare terms that few records share rise.

    Columns: ``key``, term, n_in_record, record_terms, n_occurrences, n_records (rows in
    which the term occurs), p_log10, score. Every row is a record of its own, also where
    keys repeat or are null; records without terms have no rows; an empty table gives none.

    Terms are cut out once and written; term statistics are summed map-side. The few
    heavy terms (see HEAVY) take theirs by broadcast, so that no partition of the join
    on the term is hot; all others by a join on the term. Then records come together
    for the adjustment, by row and not by key.
    """
    records = cut(record_terms(df, key, fields), "record-terms")
    post = records.select("uid", "key", "n", F.explode(F.arrays_zip("terms", "counts")).alias("x")).select("uid", "key", "n", F.col("x.terms").alias("term"), F.col("x.counts").alias("k"))
    sums = records.agg(F.sum("n"), F.sum(F.size("terms"))).first()
    total, postings = int(sums[0] or 0), int(sums[1] or 0)
    stats = cut(post.groupBy("term").agg(F.sum("k").alias("good"), F.count(F.lit(1)).alias("df")), "term-stats")
    heavy = F.broadcast(stats.where(F.col("df") > max(1.0, HEAVY * postings)))
    marked = post.join(heavy, "term", "left")
    light = marked.where("df is null").drop("good", "df").join(stats.where(F.col("df") <= max(1.0, HEAVY * postings)), "term")
    known = marked.where("df is not null").unionByName(light)
    kind = df.schema[key].dataType.simpleString()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []

        def done(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(parts).combine_chunks()
            uid, k, n, good = (t[c].to_numpy() for c in ("uid", "k", "n", "good"))
            kinds, at = np.unique(np.stack([k, n, good], 1), axis=0, return_inverse=True)
            logp = log_upper_tail(kinds[:, 0], kinds[:, 1], kinds[:, 2], total)[at.ravel()]
            q = _adjusted(uid, logp)
            ten = np.log(10)
            cols = [t["key"], t["term"], t["k"], t["n"], t["good"], t["df"], pa.array(logp / ten), pa.array(np.abs(q / ten))]
            return pa.Table.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in cols], names=["key", "term", "n_in_record", "record_terms", "n_occurrences", "n_records", "p_log10", "score"])

        for b in batches:
            if not b.num_rows:
                continue
            uid = b.column(b.schema.get_field_index("uid")).to_numpy()
            last = int(np.searchsorted(uid, uid[-1], "left"))
            if last:
                yield from done([*kept, b.slice(0, last)]).to_batches()
                kept = []
            elif kept and kept[-1].column(kept[-1].schema.get_field_index("uid"))[0].as_py() != uid[0]:
                yield from done(kept).to_batches()
                kept = []
            kept.append(b.slice(last))
        if kept:
            yield from done(kept).to_batches()

    together = known.select("uid", "key", "n", "term", "k", "good", "df").repartition("uid").sortWithinPartitions("uid")
    schema = f"key {kind}, term string, n_in_record bigint, record_terms bigint, n_occurrences bigint, n_records bigint, p_log10 double, score double"
    return together.mapInArrow(scored, schema).withColumnRenamed("key", key)
