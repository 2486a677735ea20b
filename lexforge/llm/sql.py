"""Oracle SQL of the llm queries, where SQL can express them.

Plain spelling, as far as terms need it, is said here once more with single calls of
translate, nfc_normalize and replace over every value.
"""

from __future__ import annotations

from lexforge.llm.plain import LOOKALIKES, _class, mixed_pattern, tables
from lexforge.llm.queries import BLANKS
from lexforge.llm.terms import DROPPED, LETTERS


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def terms_sql(value: str) -> str:
    """The list of terms of ``value``."""
    one, many, blanks, gone = tables()
    hebrew = {k: v for k, v in one.items() if "א" <= v <= "ת"}
    src = "".join(hebrew) + gone
    plain = f"nfc_normalize(translate({value}, {_q(src)}, {_q(''.join(hebrew.values()))}))"
    for k, v in many.items():
        if all("א" <= x <= "ת" for x in v):
            plain = f"replace({plain}, {_q(k)}, {_q(v)})"
    return f"regexp_extract_all(regexp_replace({plain}, {_q(DROPPED)}, '', 'g'), {_q(LETTERS)})"


def not_plain_sql(field: str) -> str:
    """The values of ``field`` with a sign that plain spelling has not, not in canonical order, or with a word of two scripts."""
    one, many, blanks, gone = tables()
    strange = _q(f"[{_class(''.join(one) + ''.join(many) + blanks.replace(' ', '') + gone)}]")
    mixed = _q(mixed_pattern())
    return f"SELECT rec_id, '{field}' AS field FROM rashi WHERE regexp_matches({field}, {strange}) OR nfc_normalize({field}) <> {field} OR regexp_matches({field}, {mixed})"


def plain_text_sql(field: str) -> str:
    """rec_id, field, plain, changed of every value of ``field``; look-alikes are those of the fixed rows, of three scripts."""
    one, many, blanks, gone = tables()
    src, dst = "".join(one) + blanks.replace(" ", "") + gone, "".join(one.values()) + " " * len(blanks.replace(" ", ""))
    several = "MAP {" + ", ".join(f"{_q(k)}: {_q(v)}" for k, v in many.items()) + "}"
    spelled = f"CASE WHEN regexp_matches(x, {_q('[' + _class(''.join(many)) + ']')}) THEN array_to_string(list_transform(string_split(x, ''), lambda c: coalesce({several}[c], c)), '') ELSE x END"
    rows = [r.split() for line in LOOKALIKES.split("\n") for r in line.split("|") if r]
    count = {n: f"length(regexp_replace(w, '[^\\p{{{n}}}]', '', 'g'))" for n in ("Latin", "Cyrillic", "Greek")}

    def to(k: int) -> str:
        own = {x: r[k] for r in rows if r[k] != "-" for j, x in enumerate(r) if j != k and x != "-"}
        return f"translate(w, {_q(''.join(own))}, {_q(''.join(own.values()))})"

    word = f"CASE WHEN NOT regexp_matches(w, {_q(mixed_pattern())}) THEN w WHEN {count['Latin']} >= greatest({count['Cyrillic']}, {count['Greek']}) THEN {to(0)} WHEN {count['Cyrillic']} >= {count['Greek']} THEN {to(1)} ELSE {to(2)} END"
    value = f"(SELECT rec_id, {field} AS v, translate({field}, {_q(src)}, {_q(dst)}) AS x FROM rashi WHERE {field} IS NOT NULL)"
    for step in (spelled, "nfc_normalize(x)", spelled):
        value = f"(SELECT rec_id, v, {step} AS x FROM {value})"
    words = f"CASE WHEN regexp_matches(x, {_q(mixed_pattern())}) THEN array_to_string(list_transform(regexp_extract_all(x, '[\\p{{L}}\\p{{M}}]+|[^\\p{{L}}\\p{{M}}]+'), lambda w: {word}), '') ELSE x END"
    return f"SELECT rec_id, '{field}' AS field, plain, plain <> v AS changed FROM (SELECT rec_id, v, {words} AS plain FROM {value})"


#: Words and marks of a text, as ``levels.unigrams`` has them.
UNIGRAMS = "regexp_extract_all(lower(regexp_replace(regexp_replace({t}, '<[^<>]+>', ' ', 'g'), '[\\x{{0591}}-\\x{{05BD}}\\x{{05BF}}\\x{{05C1}}\\x{{05C2}}\\x{{05C4}}\\x{{05C5}}\\x{{05C7}}]', '', 'g')), '[\\p{{L}}\\p{{Nl}}\\p{{No}}]+|[.!?,]')"
SHAPE = "CASE WHEN regexp_matches({w}, '^\\p{{L}}') THEN (unicode({w}) >> 8) || ':' || least(length({w}), 14) ELSE {w} END"


def levels_sql(own: float = 0.7, alpha: float = 0.1) -> str:
    """CTEs up to ``assigned`` (doc_id, level, lang, posterior, n_unigrams) of all documents with a word."""
    return f"""WITH refs AS (SELECT coalesce(lang, '') AS lang, read_level AS level, unnest({UNIGRAMS.format(t='text')}) AS w FROM level_refs WHERE text IS NOT NULL AND read_level IS NOT NULL),
seen AS MATERIALIZED (SELECT lang, level, w, {SHAPE.format(w='w')} AS shape, count(*) AS n FROM refs GROUP BY ALL),
classes AS MATERIALIZED (SELECT lang, level, sum(n) AS n FROM seen GROUP BY ALL), words AS MATERIALIZED (SELECT DISTINCT w, shape FROM seen),
shapes AS MATERIALIZED (SELECT shape, max(n) AS n FROM (SELECT shape, count(*) AS n FROM words GROUP BY shape UNION ALL SELECT split_part(shape, ':', 1) || ':' || k, 0 FROM words, range(1, 15) AS r(k) WHERE regexp_matches(w, '^\\p{{L}}')) GROUP BY shape),
weighed AS (SELECT c.lang, c.level, s.shape, s.n AS of_shape, {alpha} + coalesce(x.n, 0) AS mass FROM classes c CROSS JOIN shapes s LEFT JOIN (SELECT lang, level, shape, sum(n) AS n FROM seen GROUP BY ALL) x ON x.lang = c.lang AND x.level = c.level AND x.shape = s.shape),
back AS MATERIALIZED (SELECT lang, level, shape, (1 - {own}) * mass / sum(mass) OVER (PARTITION BY lang, level) / greatest(1, of_shape) AS p FROM weighed),
known AS MATERIALIZED (SELECT b.lang, b.level, w.w, ln({own} * coalesce(x.n, 0) / c.n + b.p) AS lp FROM words w JOIN back b USING (shape) JOIN classes c ON c.lang = b.lang AND c.level = b.level LEFT JOIN seen x ON x.lang = b.lang AND x.level = b.level AND x.w = w.w),
strange AS (SELECT lang, level, ln(min(p)) AS lp FROM back GROUP BY ALL),
docs AS MATERIALIZED (SELECT doc_id, w, {SHAPE.format(w='w')} AS shape, count(*) AS n FROM (SELECT doc_id, unnest({UNIGRAMS.format(t='text')}) AS w FROM documents) GROUP BY ALL),
kinds AS (SELECT d.*, CASE WHEN k.w IS NOT NULL THEN 1 WHEN s.shape IS NOT NULL THEN 2 ELSE 3 END AS how FROM docs d LEFT JOIN words k USING (w) LEFT JOIN shapes s ON s.shape = d.shape),
scores AS (SELECT doc_id, lang, level, sum(x) AS s FROM (
  SELECT doc_id, lang, level, sum(n * lp) AS x FROM kinds JOIN known USING (w) WHERE how = 1 GROUP BY ALL
  UNION ALL SELECT doc_id, lang, level, sum(n * ln(p)) FROM kinds JOIN back USING (shape) WHERE how = 2 GROUP BY ALL
  UNION ALL SELECT doc_id, lang, level, sum(n * lp) FROM kinds, strange WHERE how = 3 GROUP BY ALL) GROUP BY ALL),
posted AS (SELECT doc_id, lang, level, s, exp(s - max(s) OVER (PARTITION BY doc_id)) AS p FROM scores),
shares AS (SELECT doc_id, level, sum(p) AS p FROM posted GROUP BY ALL),
assigned AS (SELECT doc_id, arg_min(level, (-p, level)) AS level, max(p) / sum(p) AS posterior FROM shares GROUP BY doc_id),
likeliest AS (SELECT doc_id, arg_min(lang, (-s, lang)) AS lang FROM posted GROUP BY doc_id), counted AS (SELECT doc_id, CAST(sum(n) AS INT) AS n_unigrams FROM docs GROUP BY doc_id)"""


def oracle_sql() -> dict[str, str]:
    each = f"SELECT rec_id, 'dh' AS field, unnest({terms_sql('dh')}) AS term FROM rashi UNION ALL SELECT rec_id, 't', unnest({terms_sql('t')}) FROM rashi"
    counted = f"SELECT field, term, count(*) AS n_occurrences, count(DISTINCT rec_id) AS n_records FROM ({each}) GROUP BY field, term"
    marked = f"SELECT *, CASE WHEN n_records = 1 THEN 'rare' WHEN n_records > (SELECT count(*) FROM rashi) / 20 THEN 'common' END AS mark FROM ({counted})"
    cells = f"SELECT rec_id, term, count(*) AS k, count(*) OVER (PARTITION BY term) AS df, sum(count(*)) OVER (PARTITION BY term) AS good, sum(count(*)) OVER (PARTITION BY rec_id) AS n, sum(count(*)) OVER () AS total FROM ({each}) GROUP BY rec_id, term"
    choose = "lgamma({a} + 1) - lgamma({b} + 1) - lgamma({a} - {b} + 1)"
    chance = f"exp({choose.format(a='good', b='j')} + {choose.format(a='(total - good)', b='(n - j)')} - ({choose.format(a='total', b='n')}))"
    tail = f"SELECT *, ln(least(1.0, list_sum(list_transform(range(CAST(greatest(k, n - (total - good)) AS BIGINT), CAST(least(n, good) + 1 AS BIGINT)), lambda j: {chance})))) AS lp FROM (SELECT rec_id, term, k, df, CAST(good AS DOUBLE) AS good, CAST(n AS DOUBLE) AS n, CAST(total AS DOUBLE) AS total FROM ({cells}))"
    ranked = f"SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY lp, term) AS r, count(*) OVER (PARTITION BY rec_id) AS m FROM ({tail})"
    adjusted = f"SELECT *, min(lp + ln(m) - ln(r)) OVER (PARTITION BY rec_id ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lq FROM ({ranked})"
    return {
        "p1_found": f"SELECT rec_id, term FROM ({cells}) WHERE k >= 3 AND df BETWEEN 2 AND 8",
        "p1_scores": f"SELECT rec_id, term, k AS n_in_record, CAST(n AS BIGINT) AS record_terms, CAST(good AS BIGINT) AS n_occurrences, df AS n_records, round(lp / ln(10), 3) + 0.0 AS p_log10, round(abs(least(lq, 0.0)) / ln(10), 3) AS score FROM ({adjusted})",
        "p2_found": " UNION ALL ".join(map(not_plain_sql, ("dh", "t", "vt"))),
        "p2_plain": " UNION ALL ".join(map(plain_text_sql, ("dh", "t", "vt"))),
        "p3_check": f"SELECT rec_id, length(regexp_replace(t, {_q(BLANKS)}, '', 'g')) AS signs, true AS numbered, true AS ordered, true AS trimmed FROM rashi WHERE regexp_replace(t, {_q(BLANKS)}, '', 'g') <> ''",
        "p5_check": """SELECT t.plan_id, t.stratum_id, count(DISTINCT q.id) AS available, round(greatest(t.min_rows, t.target_share * t.sample_size), 4) AS wanted, true AS minimum_kept, true AS size_kept, true AS ids_once, true AS balanced
          FROM sample_targets t LEFT JOIN queries_partial q
          ON q.dhWords >= t.dhwords_lo AND (t.dhwords_hi IS NULL OR q.dhWords <= t.dhwords_hi) AND q.lk >= t.lk_lo AND (t.lk_hi IS NULL OR q.lk <= t.lk_hi)
          GROUP BY t.plan_id, t.stratum_id, t.min_rows, t.target_share, t.sample_size""",
        "p5_found": """SELECT t.plan_id, t.stratum_id FROM sample_targets t LEFT JOIN queries_partial q
          ON q.dhWords >= t.dhwords_lo AND (t.dhwords_hi IS NULL OR q.dhWords <= t.dhwords_hi) AND q.lk >= t.lk_lo AND (t.lk_hi IS NULL OR q.lk <= t.lk_hi)
          GROUP BY t.plan_id, t.stratum_id, t.min_rows, t.target_share, t.sample_size HAVING count(DISTINCT q.id) < greatest(t.min_rows, t.target_share * t.sample_size)""",
        "p6_found": f"SELECT field, term, mark FROM ({marked}) WHERE mark IS NOT NULL",
        "p6_terms": f"SELECT field, term, n_occurrences, n_records, mark FROM ({marked})",
        "p7_found": "SELECT c.capacity_id, d.doc_id FROM documents d JOIN containers c ON strlen(d.text) > c.capacity_tokens",
        "p7_check": "SELECT c.capacity_id, count(DISTINCT d.doc_id) AS docs, CAST(sum(coalesce(strlen(d.text), 0)) AS BIGINT) AS tokens, true AS none_overfull, true AS few, true AS in_one_piece FROM documents d, containers c GROUP BY c.capacity_id",
        "p8_check": """SELECT mix_id, source, round(least(want, n * max_repeats), 2) AS attainable, n * max_repeats < want AS short, true AS reached, true AS cap_kept, true AS reported, true AS fitted FROM (
          SELECT m.*, coalesce(d.n, 0) AS n, m.budget_tokens * m.weight / sum(m.weight) OVER (PARTITION BY m.mix_id) AS want FROM mix_targets m
          LEFT JOIN (SELECT source, sum(strlen(text)) AS n FROM documents GROUP BY source) d ON d.source = m.source)""",
        "p8_found": """SELECT mix_id, source FROM (SELECT m.*, coalesce(d.n, 0) AS n, m.budget_tokens * m.weight / sum(m.weight) OVER (PARTITION BY m.mix_id) AS want FROM mix_targets m
          LEFT JOIN (SELECT source, sum(strlen(text)) AS n FROM documents GROUP BY source) d ON d.source = m.source) WHERE n * max_repeats < want""",
        "p9_found": f"{levels_sql()} SELECT doc_id FROM assigned JOIN documents USING (doc_id) WHERE abs(documents.level_tag - assigned.level) >= 3",
        "p9_levels": f"{levels_sql()} SELECT d.doc_id, CAST(a.level AS INT) AS level, l.lang, round(a.posterior, 6) AS posterior, coalesce(c.n_unigrams, 0) AS n_unigrams FROM documents d LEFT JOIN assigned a USING (doc_id) LEFT JOIN likeliest l USING (doc_id) LEFT JOIN counted c USING (doc_id)",
        "p9_profile": f"{levels_sql()} SELECT l.lang, CAST(a.level AS INT) AS level, count(*) AS n_docs, CAST(sum(coalesce(c.n_unigrams, 0)) AS BIGINT) AS n_unigrams FROM documents d LEFT JOIN assigned a USING (doc_id) LEFT JOIN likeliest l USING (doc_id) LEFT JOIN counted c USING (doc_id) GROUP BY ALL",
    }
