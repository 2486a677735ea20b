"""Problem 8: mixing sources to target weights.

Method: soft-membership mixing. A classifier trained on a labelled table (bounded by
``per_source`` expected documents a source) gives every document posteriors over the
domains; distributed projected-gradient least squares then fits document rates between
0 and the repeat cap whose expected domain token totals match the targets, both by
posterior and, with weight ``LABEL``, by the source that a document states. All rates
start alike; the steps go on until the objective settles. A last calibration brings
the little that is left by stated source onto the targets, as far as the caps allow,
and rates become whole copies by error diffusion over tokens, within each partition and
then from partition to partition over one document of each.

The gradient of a document depends on its stated source and, linearly, on its
posteriors. With the projection taken when rates are read (lazily), the state of the
iteration is two numbers a mix and domain, from which any task works out the rates of
its documents in one go: nothing is kept on executors, no step is replayed, and what
goes to the driver is two numbers a mix and domain.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.plans.lineage import cut

BUCKETS = 4096
#: How many bytes of a text may count as independent evidence; the classifier takes the
#: one under which documents it wasn't trained on are likeliest to be of their source.
EVIDENCE = (*(4.0**k for k in range(10)), math.inf)
LABEL = 10.0
#: The iteration ends once a step lowers no mix's objective by more than this part, or after so many steps.
SETTLED, MOST_STEPS = 0.01, 30


def byte_pairs(text: bytes) -> np.ndarray:
    """Counts of hashed pairs of neighbouring bytes."""
    a = np.frombuffer(text, np.uint8).astype(np.uint16)
    return np.bincount((a[:-1] * np.uint16(251) + a[1:]) & np.uint16(BUCKETS - 1), minlength=BUCKETS)


@dataclass(frozen=True)
class Targets:
    """Mixes by sources; all arrays are (mix, source). Sources not in a mix have weight and target 0."""

    mixes: tuple[int, ...]
    sources: tuple[str, ...]
    member: np.ndarray
    weight: np.ndarray
    target: np.ndarray
    repeats: np.ndarray


def mix_targets_of(df: DataFrame) -> Targets:
    """From (mix_id, source, weight, max_repeats, budget_tokens); at most 10,000 rows and 1,000 sources.

    Rows without mix or source are left out; a null or negative weight counts as 0, a
    null max_repeats as 1; of a source named twice in a mix the weights add up.
    """
    rows = df.select("mix_id", "source", "weight", "max_repeats", "budget_tokens").where("mix_id is not null and source is not null").limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("more than 10,000 mix targets")
    mixes, sources = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    if len(sources) > 1_000:
        raise ValueError("more than 1,000 sources")
    shape = (len(mixes), len(sources))
    member, weight, repeats, budget = np.zeros(shape, bool), np.zeros(shape), np.ones(shape), np.zeros(shape)
    for m, s, w, k, b in rows:
        at = mixes.index(m), sources.index(s)
        member[at] = True
        weight[at] += max(0.0, w or 0.0)
        repeats[at] = max(0, 1 if k is None else k)
        budget[at] = b or 0
    total = weight.sum(1, keepdims=True)
    target = np.divide(budget * weight, total, out=np.zeros(shape), where=total > 0)
    return Targets(tuple(mixes), tuple(sources), member, weight, target, repeats)


def posteriors(df: DataFrame, key: str, source: str, text: str, sources: tuple[str, ...], per_source: int = 500, seed: int = 1) -> DataFrame:
    """(key, s, tokens, post): the index of the stated source (-1: none of ``sources``), UTF-8 bytes, posteriors.

    Documents with other sources and null or empty texts get uniform posteriors.
    """
    names = F.create_map(*[x for i, s in enumerate(sources) for x in (F.lit(s), F.lit(i))])
    named = df.select(F.col(key).alias("key"), F.coalesce(names[F.col(source)], F.lit(-1)).alias("s"), F.col(text).cast("string").alias("t"))
    kind = named.schema["key"].dataType.simpleString()
    docs = {r[0]: r[1] for r in named.where("s >= 0").groupBy("s").count().collect()}
    share = F.create_map(*[x for i in range(len(sources)) for x in (F.lit(i), F.lit(float(per_source) / max(1, docs.get(i, 1))))])
    dice = F.pmod(F.xxhash64(F.lit(seed), "key", "s"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    labelled = named.where((F.col("s") >= 0) & (dice < share[F.col("s")])).select("s", "t", (dice < share[F.col("s")] / 2).alias("train"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((len(sources), BUCKETS), np.int64)
        for b in batches:
            for s, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                if t:
                    held[s] += byte_pairs(t)
        s, k = np.nonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(s.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(held[s, k])], names=["s", "k", "n"])

    sums = np.ones((len(sources), BUCKETS))
    for s, k, n in labelled.where("train").mapInArrow(count, "s int, k int, n bigint").groupBy("s", "k").agg(F.sum("n")).collect():
        sums[s, k] += n
    table = np.log(sums / sums.sum(1, keepdims=True)).T.astype(np.float32)
    prior = np.log(np.array([max(1, docs.get(i, 0)) for i in range(len(sources))], float))

    def each_byte(texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Bytes, and mean log-likelihood of a byte by source."""
        size = np.array([len(t) if t else 0 for t in texts])
        x = np.stack([byte_pairs(t) if t else np.zeros(BUCKETS, np.int64) for t in texts]).astype(np.float32)
        return size, (x @ table) / np.maximum(size, 1)[:, None]

    def softened(size: np.ndarray, mean: np.ndarray, evidence: float) -> np.ndarray:
        score = np.where(size[:, None] > 0, mean * np.minimum(size, evidence)[:, None] + prior, 0.0)
        post = np.exp(score - score.max(1, keepdims=True))
        return post / post.sum(1, keepdims=True)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(len(EVIDENCE))
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                size, mean = each_byte(part.column(1).cast(pa.binary()).to_pylist())
                own = part.column(0).to_numpy()
                for i, e in enumerate(EVIDENCE):
                    held[i] += np.log(np.maximum(softened(size, mean, e)[np.arange(own.size), own], 1e-30)).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(EVIDENCE), dtype=np.int32)), pa.array(held)], names=["e", "fit"])

    fits = {e: x for e, x in labelled.where("not train").mapInArrow(weigh, "e int, fit double").groupBy("e").agg(F.sum("fit")).collect()}
    evidence = EVIDENCE[max(fits, key=lambda e: (round(fits[e], 6), -e), default=0)]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                size, mean = each_byte(part.column(2).cast(pa.binary()).to_pylist())
                post = softened(size, mean, evidence)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, post.size + 1, post.shape[1], dtype=np.int32)), pa.array(post.astype(np.float32).ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(size.astype(np.int64)), flat], names=["key", "s", "tokens", "post"])

    return named.mapInArrow(judge, f"key {kind}, s int, tokens bigint, post array<float>")


def _arrays(b: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    post = b.column(3)
    return b.column(1).to_numpy(), b.column(2).to_numpy().astype(float), post.flatten().to_numpy().astype(float).reshape(-1, n)


@dataclass(frozen=True)
class Rates:
    """What gives every document its rate; all but ``have`` are (mix, source).

    A rate is ``own`` plus the document's posteriors times ``soft`` for each token of its
    source, projected onto 0 to ``cap``; then ``down`` and ``up`` calibrate.
    """

    own: np.ndarray
    soft: np.ndarray
    cap: np.ndarray
    have: np.ndarray
    down: np.ndarray | None = None
    up: np.ndarray | None = None

    def of(self, s: np.ndarray, tokens: np.ndarray, post: np.ndarray) -> np.ndarray:
        """(mix, document) rates; 0 for a document of no source or without tokens."""
        known = (s >= 0) & (tokens > 0)
        k = np.where(known, s, 0)
        top = np.where(known, self.cap[:, k], 0.0)
        r = np.clip(self.own[:, k] + (self.soft @ post.T) / np.maximum(self.have[k], 1.0), 0.0, top)
        return r if self.down is None else r * self.down[:, k] + self.up[:, k] * (top - r * self.down[:, k])


@dataclass(frozen=True)
class Totals:
    """Expected tokens by stated source and by posterior, (mix, source); ``press`` bounds the steepness of the soft part."""

    hard: np.ndarray
    soft: np.ndarray
    press: np.ndarray


def expected(docs: DataFrame, rates: Rates) -> Totals:
    """One pass over ``docs`` (see ``posteriors``); what is summed is two numbers a mix and source, and one a source."""
    m, n = rates.own.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2 * m + 1, n))
        for b in batches:
            s, tokens, post = _arrays(b, n)
            mass = rates.of(s, tokens, post) * tokens
            held[m : 2 * m] += mass @ post
            held[2 * m] += np.where(s >= 0, tokens / np.maximum(rates.have[np.maximum(s, 0)], 1.0), 0.0) @ post
            for i in range(m):
                held[i] += np.bincount(s[s >= 0], mass[i, s >= 0], n)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(held.size)), pa.array(held.ravel())], names=["at", "x"])

    found = np.zeros((2 * m + 1) * n)
    for at, x in docs.mapInArrow(add, "at bigint, x double").groupBy("at").agg(F.sum("x")).collect():
        found[at] = x
    found = found.reshape(2 * m + 1, n)
    return Totals(found[:m], found[m : 2 * m], found[2 * m])


def objective(t: Totals, aim: np.ndarray, member: np.ndarray) -> np.ndarray:
    """Squared distance of both kinds of totals from the targets, per mix, as a part of the squared targets."""
    gaps = LABEL * (t.hard - aim) ** 2 + (t.soft - aim) ** 2
    return np.where(member, gaps, 0.0).sum(1) / np.maximum((aim**2).sum(1), 1.0)


def fit_rates(docs: DataFrame, aim: np.ndarray, member: np.ndarray, cap: np.ndarray, have: np.ndarray, most_steps: int = MOST_STEPS) -> tuple[Rates, Totals, np.ndarray, np.ndarray, int]:
    """(rates, their totals, objective at the start, objective at the end, steps) by projected gradient from equal rates.

    A step is 1 / (LABEL + press), press the largest row sum of the soft part's Gram
    matrix, in the metric in which a token of each source's whole counts alike; so no
    source is too large or too small to move.
    """
    even = np.divide(aim.sum(1), (member * have).sum(1), out=np.zeros(aim.shape[0]), where=(member * have).sum(1) > 0)
    rates = Rates(np.where(member, even[:, None], 0.0), np.zeros(aim.shape), cap, have)
    totals = expected(docs, rates)
    first = last = objective(totals, aim, member)
    step = 1.0 / (LABEL + max(1.0, totals.press.max(initial=0.0)))
    done = 0
    while done < most_steps:
        gap = np.where(member, totals.hard - aim, 0.0)
        own = rates.own - step * LABEL * np.divide(gap, have, out=np.zeros(aim.shape), where=have > 0)
        rates = Rates(own, rates.soft - step * np.where(member, totals.soft - aim, 0.0), cap, have)
        totals = expected(docs, rates)
        now = objective(totals, aim, member)
        done += 1
        settled = (last - now <= SETTLED * np.maximum(last, 1e-12)).all()
        last = now
        if settled:
            break
    return rates, totals, first, last, done


def mixture(df: DataFrame, key: str, source: str, text: str, targets: Targets, per_source: int = 500) -> tuple[DataFrame, DataFrame]:
    """(drawn, report) for every mix.

    drawn: mix_id, ``key``, source, tokens, n_copies (from 1). report: mix_id, source,
    weight_share, target_tokens, available_tokens, most_tokens (available times the
    repeat cap), soft_tokens (expected by posterior), expected_tokens, actual_tokens,
    actual_share, short (most_tokens < target_tokens), calibrated (tokens that the least
    squares left to the calibration), objective_start, objective and steps of the mix.

    Documents of a source that a mix doesn't name, or of none, aren't drawn for it, nor
    are null and empty texts. Repeated keys are documents of their own. An empty table
    gives no documents and a report of shortages; no targets, two empty tables.
    """
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    drawn_schema = f"mix_id int, {key} {kind}, source string, tokens bigint, n_copies int"
    report_schema = "mix_id int, source string, weight_share double, target_tokens double, available_tokens bigint, most_tokens bigint, soft_tokens double, expected_tokens double, actual_tokens bigint, actual_share double, short boolean, calibrated double, objective_start double, objective double, steps int"
    m, n = targets.target.shape
    if not m:
        return spark.createDataFrame([], drawn_schema), spark.createDataFrame([], report_schema)
    docs = cut(posteriors(df, key, source, text, targets.sources, per_source), "posteriors")
    have = np.zeros(n)
    for s, a in docs.where("s >= 0").groupBy("s").agg(F.sum("tokens")).collect():
        have[s] = a
    cap = np.where(targets.member, targets.repeats, 0.0)
    aim = np.minimum(targets.target, cap * have)
    fitted, before, start, end, steps = fit_rates(docs, aim, targets.member, cap, have)
    room = cap * have - before.hard
    down = np.divide(aim, before.hard, out=np.ones((m, n)), where=before.hard > aim)
    up = np.divide(aim - before.hard, room, out=np.zeros((m, n)), where=(before.hard < aim) & (room > 0))
    rates_of = replace(fitted, down=down, up=np.clip(up, 0.0, 1.0))
    after = expected(docs, rates_of)
    hard, soft = after.hard, after.soft
    names = targets.sources

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        owed = np.zeros((m, n))
        last: dict[tuple[int, int], tuple] = {}
        typed: pa.DataType | None = None

        def rows(found: list[tuple], debts: list[float | None]) -> pa.RecordBatch:
            """``found``: (mix, source, key, tokens, copies); a debt marks the document that may still take or lose copies."""
            i, k, keys, sizes, copies = map(list, zip(*found)) if found else ([], [], [], [], [])
            cols = [pa.array([targets.mixes[x] for x in i], pa.int32()), pa.array(keys, typed), pa.array([names[x] for x in k], pa.string()), pa.array([int(x) for x in sizes], pa.int64()), pa.array(copies, pa.int32()), pa.array(debts, pa.float64()), pa.array([part] * len(i), pa.int32())]
            return pa.RecordBatch.from_arrays(cols, names=["mix_id", key, "source", "tokens", "n_copies", "owed", "part"])

        for b in batches:
            s, tokens, post = _arrays(b, n)
            typed = b.column(0).type
            keys = b.column(0).to_pylist()
            rates = rates_of.of(s, tokens, post)
            for i in range(m):
                found: list[tuple] = []
                debt, most = owed[i].tolist(), cap[i].tolist()
                live = np.flatnonzero(rates[i] > 0)
                live = live[np.argsort(-tokens[live], kind="stable")]
                for d, k, t, r in zip(live.tolist(), s[live].tolist(), tokens[live].tolist(), rates[i, live].tolist()):
                    debt[k] += r * t
                    c = min(int(debt[k] / t + 0.5), int(most[k])) if debt[k] > 0 else 0
                    debt[k] -= c * t
                    if (i, k) in last and last[i, k][4]:
                        found.append(last[i, k])
                    last[i, k] = (i, k, keys[d], t, c)
                owed[i] = debt
                yield rows(found, [None] * len(found))
        if last:
            yield rows(list(last.values()), [owed[at] for at in last])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Carries the debt of each mix and source from partition to partition; the last document of each takes or loses copies."""
        debt: dict[tuple, float] = {}
        for b in batches:
            copies = []
            for mix, source, t, c, owed in zip(*[b.column(x).to_pylist() for x in ("mix_id", "source", "tokens", "n_copies", "owed")]):
                due = debt.get((mix, source), 0.0) + owed
                most = int(cap[targets.mixes.index(mix), names.index(source)])
                more = max(-c, min(most - c, math.floor(due / t + 0.5)))
                debt[mix, source] = due - more * t
                copies.append(c + more)
            done = pa.RecordBatch.from_arrays([*[b.column(x) for x in ("mix_id", key, "source", "tokens")], pa.array(copies, pa.int32())], names=["mix_id", key, "source", "tokens", "n_copies"])
            yield done.filter(pa.compute.greater(done.column(4), 0))

    # The last document of each mix and source in a partition stays open, so that what a partition owes isn't lost.
    parted = cut(docs.mapInArrow(whole, f"{drawn_schema}, owed double, part int"), "drawn")
    columns = ["mix_id", key, "source", "tokens", "n_copies"]
    still = parted.where("owed is not null").repartition("mix_id", "source").sortWithinPartitions("mix_id", "source", "part")
    drawn = parted.where("owed is null").select(*columns).unionByName(cut(still.mapInArrow(settle, drawn_schema), "settled"))
    actual = np.zeros((m, n))
    for mix, s, a in drawn.groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("n_copies"))).collect():
        actual[targets.mixes.index(mix), names.index(s)] = a
    rows = []
    for i, mix in enumerate(targets.mixes):
        for k, s in enumerate(names):
            if targets.member[i, k]:
                most = have[k] * targets.repeats[i, k]
                rows.append((mix, s, float(targets.weight[i, k] / max(targets.weight[i].sum(), 1e-300)), float(targets.target[i, k]), int(have[k]), int(most), float(soft[i, k]), float(hard[i, k]), int(actual[i, k]), float(actual[i, k] / max(actual[i].sum(), 1.0)), bool(most < targets.target[i, k]), float(aim[i, k] - before.hard[i, k]), float(start[i]), float(end[i]), steps))
    return drawn, spark.createDataFrame(rows, report_schema)
