"""Search of a query set in blocks, against all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexforge import queries as core
from lexforge.operators import blocks, index, store
from lexforge.plans import lineage


def test_body_and_verse_count(spark, tmp_path):
    rows = [(1, "אבן", "מלך גדול", "ארץ", 0), (2, "דבר", "אבן", "ים", 0), (3, "דבר", "ים", "אבן", 9), (4, "ים", "ים", "ים", 0)]
    spark.createDataFrame(rows, "rec_id bigint, dh string, t string, vt string, lk int").coalesce(1).write.parquet(f"{tmp_path}/rashi.parquet")
    spark.createDataFrame([("q", "even")], "id string, query string").write.parquet(f"{tmp_path}/queries_partial.parquet")
    got = {r.rec_id: r.score for r in core.QUERIES["coverage_score_topk"](spark, str(tmp_path)).orderBy(F.desc("score")).collect()}
    assert set(got) == {1, 2, 3} and got[1] > got[3] > got[2]
    assert got[3] - got[2] == pytest.approx(3.5 * 3.321928, abs=1e-4)


def _brute(records, asked, matches, options, limit, scopes):
    """Best rows of every query by going through all pairs."""
    found = {}
    for q, t, tier, refine in matches:
        found.setdefault(q, {})[t] = (tier, refine)
    out = {}
    for qid in {q for q, _ in asked}:
        words = [t for q, t in asked if q == qid]
        rows = []
        for key, boost, color, *lists in records:
            if scopes.get(qid) not in (None, color):
                continue
            s, hit = 0.0, False
            for w in words:
                best = []
                for (_, weight), toks in zip(options.fields.items(), lists):
                    m = max((found.get(w, {})[t] for t in toks or [] if t in found.get(w, {})), default=None)
                    if m:
                        best.append(weight * m[0] + (options.refine_latin if w[0] < "א" else options.refine_other) * m[1])
                if best:
                    s, hit = s + max(best), True
            if hit:
                lemma = lists[0] or []
                cover = sum(any(t in found.get(w, {}) for w in words) for t in lemma) / max(1, len(lemma))
                rows.append((-round(round(s + options.coverage * cover, 6) + boost, 6), key))
        out[qid] = [(k, -s) for s, k in sorted(rows)[:limit]]
    return out


@pytest.mark.parametrize("seed", range(6))
def test_blocks_lose_nothing(seed, monkeypatch):
    """Random records with ties, nulls and repeated tokens; small blocks and small chunks of pairs."""
    dice = random.Random(seed)
    monkeypatch.setattr(blocks, "PAIRS", 50)
    vocab = [f"w{i}" for i in range(12)]
    qtoks = [f"a{i}" for i in range(5)] + ["ב"]
    matches = [(q, t, float(dice.choice((20, 15, 10))), dice.choice((0.0, 0.5, 1.0))) for q in qtoks for t in dice.sample(vocab, 4)]
    def toks(n):
        return None if dice.random() < 0.1 else [dice.choice(vocab) for _ in range(dice.randrange(n))]
    records = [(i, dice.choice((0.0, 0.0, 3.5, 40.0)), dice.choice("rgb"), toks(4), toks(12), toks(6)) for i in range(300)]
    asked = [(q, t) for q in range(15) for t in dice.sample(qtoks, dice.choice((1, 2, 2, 3)))] + [(15, "strange")]
    scopes = {q: dice.choice((None, None, "r", "none such")) for q in range(16)}
    options = (index.SearchOptions(), index.SearchOptions(coverage=0.0, refine_latin=75.0))
    table = pa.table(dict(zip(("qtoken", "token", "tier", "refine"), zip(*matches))))
    block = blocks.query_block(np.array([q for q, _ in asked]), [t for _, t in asked], table, ("color",), [(scopes[q],) for q in range(16)])
    scan = blocks.Scan(block, ("dh", "t", "vt"), options, 10)
    for at in range(0, 300, 64):
        part = records[at : at + 64]
        lists = [pa.array([r[3 + i] for r in part], pa.list_(pa.string())) for i in range(3)]
        scan.block(np.array([r[0] for r in part]), np.array([r[1] for r in part]), lists, [np.array([block.codes[0].get(r[2], -2) for r in part], np.int32)])
    for o, top in zip(options, scan.tops):
        top.settle()
        got = {q: [] for q in range(16)}
        for q, s, k in zip(*[x.tolist() for x in top.kept]):
            got[q].append((k, s))
        assert got == {q: [(k, pytest.approx(s)) for k, s in rows] for q, rows in _brute(records, asked, matches, o, 10, scopes).items()}
    assert scan.scored < 2 * 300 * 16


def test_query_blocks_cover_all_queries(spark, monkeypatch):
    """Many small query blocks give what one gives."""
    words = ["אב", "גד", "אבגד", "דבר", "מלכ"]
    recs = spark.createDataFrame([(i, [words[i % 5], words[i % 3]], None, [words[i % 2]], float(i % 4)) for i in range(90)], "rec_id bigint, dh array<string>, t array<string>, vt array<string>, pop double")
    vocab = spark.createDataFrame([(w,) for w in words], "token string").withColumn("fkey", index.fold(F.col("token")))
    asked = spark.createDataFrame([(f"q{i}", w) for i in range(20) for w in (("av", "gad"), ("davar",), ("melech", "av"))[i % 3]], "qid string, qtoken string")
    one = {tuple(r) for r in blocks.search_all(asked, recs, vocab, "rec_id", limit=5, boost="pop").collect()}
    monkeypatch.setattr(blocks, "MOST_QUERIES", 9)
    monkeypatch.setattr(blocks, "MOST_TOKENS", 2)
    assert one and {tuple(r) for r in blocks.search_all(asked, recs, vocab, "rec_id", limit=5, boost="pop").collect()} == one
    assert blocks.search_all(asked.limit(0), recs, vocab, "rec_id").count() == 0
    assert blocks.search_all(asked, recs.limit(0), vocab, "rec_id").count() == 0


def test_stored_index_follows_its_files(spark, tmp_path):
    def write(*rows):
        spark.createDataFrame(rows, "rec_id bigint, dh string, t string, vt string").write.mode("overwrite").parquet(f"{tmp_path}/rashi.parquet")

    write((1, "אב", "", None))
    assert {r.token for r in store.vocabulary(spark, str(tmp_path)).collect()} == {"אב"}
    write((1, "גד", "הו", None), (2, None, None, None))
    assert {r.token for r in store.vocabulary(spark, str(tmp_path)).collect()} == {"גד", "הו"}
    assert store.stored_postings(spark, str(tmp_path)).count() == 2


def test_cuts_are_released(spark):
    import os

    made = lineage.cut(spark.range(3), "test")
    path = made.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert made.count() == 3 and os.path.isdir(path)
    assert lineage.release(spark) >= 1 and not os.path.isdir(path)
