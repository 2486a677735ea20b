"""Problem 5: a sample with target shares of categories.

Method: the cube method with the category indicators as balancing variables. Units get
inclusion probabilities that meet the targets: shares of the plan's size, raised to the
minimums and lowered to what there is, the rest scaled so that the size holds. Each
partition runs the flight phase on its own units, moving two units of equal indicators
against each other until but one of them is undecided; the undecided units of many
partitions are merged upward and fly again; landing lets the few that remain of a plan
fly against each other, so that its size holds too, and decides the last. The report
states the imbalance and the deviation of the shares.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.plans.lineage import cut

#: Partitions whose undecided units are merged into one at each step upward.
FAN_IN = 32
NEAR = 1e-9


def uniform(chance: np.ndarray, turn: int) -> np.ndarray:
    """A fresh number in [0, 1) for each of ``chance`` and each ``turn``, by mixing its bits (SplitMix64)."""
    x = (chance * 2.0**53).astype(np.uint64) + np.uint64((turn + 1) * 0x9E3779B97F4A7C15 % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2.0**53


def flight(z: np.ndarray, groups: np.ndarray, chance: np.ndarray, turn: int = 0) -> np.ndarray:
    """Flight phase among units of equal balancing vectors: at most one a group stays undecided.

    The null space of two equal columns is (1, -1): the pair moves along it, in either
    direction with the chance that keeps both expectations, until one is decided. All
    pairs of a round move at once; a round leaves half of the undecided.
    """
    z = np.where((z > NEAR) & (z < 1 - NEAR), z, np.round(z))
    while True:
        open_ = np.flatnonzero((z > 0) & (z < 1))
        open_ = open_[np.argsort(groups[open_], kind="stable")]
        g = groups[open_]
        place = np.arange(g.size) - np.searchsorted(g, g, "left")
        first = np.flatnonzero((place[:-1] % 2 == 0) & (g[:-1] == g[1:])) if g.size > 1 else np.zeros(0, np.int64)
        if not first.size:
            return z
        i, j = open_[first], open_[first + 1]
        both, last = z[i] + z[j], z[i]
        with np.errstate(divide="ignore", invalid="ignore"):
            wins = uniform(chance[i], turn) < np.where(both < 1, last / both, (1 - z[j]) / (2 - both))
        high, low = np.where(both < 1, both, 1.0), np.where(both < 1, 0.0, both - 1)
        for at, x in ((i, np.where(wins, high, low)), (j, np.where(wins, low, high))):
            z[at] = np.where((x > NEAR) & (x < 1 - NEAR), x, np.round(x))
        turn += 1


def flight_across(z: np.ndarray, indicators: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """Flight phase among units of different balancing vectors, along null vectors of ``indicators`` (units x categories)."""
    z = z.copy()
    for u in np.resize(chance, 4 * z.size + 4):
        open_ = np.flatnonzero((z > NEAR) & (z < 1 - NEAR))
        if open_.size <= 1:
            break
        take = open_[: indicators.shape[1] + 1]
        _, s, vt = np.linalg.svd(indicators[take].T, full_matrices=True)
        rank = int((s > 1e-10).sum())
        if rank == take.size:
            break
        v = vt[-1]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.min(np.where(v > 1e-12, (1 - z[take]) / v, np.where(v < -1e-12, -z[take] / v, np.inf)))
            down = np.min(np.where(v > 1e-12, z[take] / v, np.where(v < -1e-12, (z[take] - 1) / v, np.inf)))
        z[take] += v * (up if u < down / (up + down) else -down)
        z[np.abs(z) < NEAR] = 0
        z[np.abs(z - 1) < NEAR] = 1
    return z


def targets_of(df: DataFrame, categories: tuple[tuple[str, str], ...]) -> list[dict]:
    """The strata as dicts; at most 10,000. ``categories`` names the (low, high) bound columns."""
    names = ["plan_id", "stratum_id", *[x for pair in categories for x in pair], "target_share", "min_rows", "sample_size"]
    rows = df.select(*names).where("plan_id is not null and stratum_id is not null").distinct().limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("more than 10,000 strata")
    return sorted((r.asDict() for r in rows), key=lambda r: (r["plan_id"], r["stratum_id"]))


def sizes(shares: np.ndarray, least: np.ndarray, available: np.ndarray, size: float) -> np.ndarray:
    """Rows of each stratum: shares of one number, no fewer than ``least``, no more than ``available``, ``size`` in all if that can be.

    Where the minimums alone exceed the size, they are what comes out; where all there
    is falls short of it, that.
    """
    low = np.minimum(least, available)
    if low.sum() >= size or not (shares > 0).any():
        return low

    def of(number: float) -> np.ndarray:
        return np.clip(shares * number, low, available)

    top = max(size, float((available[shares > 0] / shares[shares > 0]).max()))
    if of(top).sum() <= size:
        return of(top)
    lo, hi = 0.0, top
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if of(mid).sum() < size else (lo, mid)
    return of(hi)


def _within(value: F.Column, low: F.Column, high: F.Column) -> F.Column:
    return value.isNotNull() & (low.isNull() | (value >= low)) & (high.isNull() | (value <= high))


def balanced_sample(df: DataFrame, key: str, measures: tuple[str, ...], targets: list[dict], bounds: tuple[tuple[str, str], ...], seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(sample, report) for every plan in ``targets``.

    ``measures`` are the columns that the strata bound, ``bounds`` the (low, high)
    columns for each; bounds are inclusive, null ones open, and a null measure lies in
    no stratum. A unit is a distinct value of ``key``, however many rows it has; rows
    with a null key can't be drawn. What a stratum gets is set by ``sizes``: minimums are
    met by lowering the other strata, so that the plan's size holds wherever it can.

    sample: plan_id, ``key``, strata (array of stratum ids). report: plan_id, stratum_id,
    available, wanted (the larger of the minimum and the share of the sample size),
    attainable (what ``sizes`` gives it), drawn, target_share, reached_share, imbalance
    (drawn less attainable), short (available < wanted), off_share (the share reached
    is more than one row of the plan's sample off the target). An empty table gives an
    empty sample and a report of shortages.
    """
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    all_ = F.array(*[F.struct(*[(F.lit(t[c]) if t[c] is not None else F.lit(None)).cast("bigint").alias(c) for c in ("plan_id", "stratum_id", *[x for p in bounds for x in p])]) for t in targets]) if targets else None
    report_schema = "plan_id bigint, stratum_id bigint, available bigint, wanted double, attainable double, drawn bigint, target_share double, reached_share double, imbalance double, short boolean, off_share boolean"
    if all_ is None:
        return spark.createDataFrame([], f"plan_id bigint, {key} {kind}, strata array<bigint>"), spark.createDataFrame([], report_schema)
    named = df.select(F.col(key).alias("key"), *[F.col(m).cast("bigint").alias(f"m{i}") for i, m in enumerate(measures)]).where("key is not null").distinct()

    def fits(s: F.Column) -> F.Column:
        found = F.lit(True)
        for i, (low, high) in enumerate(bounds):
            found = found & _within(F.col(f"m{i}"), s[low], s[high])
        return found

    members = named.select("key", F.explode(F.filter(all_, fits)).alias("s")).select("key", "s.plan_id", "s.stratum_id")
    units = cut(members.groupBy("plan_id", "key").agg(F.sort_array(F.collect_set("stratum_id")).alias("strata")), "units")
    available = {(r[0], r[1]): r[2] for r in units.select("plan_id", F.explode("strata").alias("s")).groupBy("plan_id", "s").count().collect()}
    wanted = {(t["plan_id"], t["stratum_id"]): max(float(t["min_rows"] or 0), float(t["target_share"] or 0) * float(t["sample_size"] or 0)) for t in targets}
    attainable: dict[tuple, float] = {}
    for plan in sorted({t["plan_id"] for t in targets}):
        own = [t for t in targets if t["plan_id"] == plan]
        ks = [(plan, t["stratum_id"]) for t in own]
        size = max(float(t["sample_size"] or 0) for t in own)
        found = sizes(*[np.array(x, float) for x in ([max(0.0, t["target_share"] or 0.0) for t in own], [t["min_rows"] or 0 for t in own], [available.get(k, 0) for k in ks])], size)
        attainable |= dict(zip(ks, found.tolist()))
    chances = {k: min(1.0, x / available[k]) for k, x in attainable.items() if available.get(k)}

    def fly(batches: Iterator[pa.RecordBatch], step: int, landing: bool = False) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        t = pa.Table.from_batches(parts)
        coded = t["combo"].combine_chunks().dictionary_encode()
        combos = [tuple(map(int, x.split(","))) for x in coded.dictionary.to_pylist()]
        groups, dice, z = coded.indices.to_numpy(), t["dice"].to_numpy(), t["z"].to_numpy()
        start = np.array([max(chances.get((k[0], s), 0.0) for s in k[1:]) for k in combos])[groups]
        z = np.where(np.isnan(z), start, z)
        order = np.argsort(dice, kind="stable")
        back = np.empty_like(order)
        back[order] = np.arange(order.size)
        z = flight(z[order], groups[order], dice[order], 64 * step)[back]
        open_ = np.flatnonzero((z > NEAR) & (z < 1 - NEAR))
        if any(len(k) > 2 for k in combos) and open_.size > 1:
            rows = {k: i for i, k in enumerate(sorted({(k[0], s) for k in combos for s in k[1:]}))}
            ind = np.zeros((open_.size, len(rows)))
            for i, u in enumerate(open_):
                k = combos[groups[u]]
                ind[i, [rows[k[0], s] for s in k[1:]]] = 1
            z[open_] = flight_across(z[open_], ind, uniform(dice[open_], 64 * step + 61))
        if landing:
            plans = np.array([k[0] for k in combos])[groups]
            z = flight(z, plans, dice, 64 * step + 62)
            z = np.where((z > NEAR) & (z < 1 - NEAR), (uniform(dice, 64 * step + 63) < z).astype(float), z)
        yield from t.set_column(t.schema.get_field_index("z"), "z", pa.array(z)).to_batches()

    dice = (F.pmod(F.xxhash64(F.lit(seed), "plan_id", "key"), F.lit(1 << 53)) / F.lit(float(1 << 53))).alias("dice")
    combo = F.concat_ws(",", F.col("plan_id").cast("string"), F.col("strata").cast("array<string>")).alias("combo")
    state = units.select("plan_id", "key", "strata", combo, dice, F.lit(float("nan")).alias("z"))
    schema = f"plan_id bigint, key {kind}, strata array<bigint>, combo string, dice double, z double"
    parts = 1 + max((r[0] for r in units.select(F.spark_partition_id().alias("p")).distinct().collect()), default=0)
    step = 0
    flown = cut(state.mapInArrow(lambda it: fly(it, 0), schema), "flight")
    undecided = f"z > {NEAR} and z < {1 - NEAR}"
    decided, rest = flown.where(f"not ({undecided})"), flown.where(undecided)
    while parts > 1:
        parts = -(-parts // FAN_IN)
        up = rest.repartition(parts, F.pmod(F.xxhash64("dice"), F.lit(parts)))
        if parts == 1:
            break
        step += 1
        flown = cut(up.mapInArrow(lambda it, k=step: fly(it, k), schema), "flight")
        decided, rest = decided.unionByName(flown.where(f"not ({undecided})")), flown.where(undecided)
    landed = rest.repartition(1).mapInArrow(lambda it: fly(it, step + 1, landing=True), schema)
    sample = cut(decided.unionByName(landed).where("z > 0.5").select("plan_id", F.col("key").alias(key), "strata"), "sample")
    drawn = {(r[0], r[1]): r[2] for r in sample.select("plan_id", F.explode("strata").alias("s")).groupBy("plan_id", "s").count().collect()}
    total: dict[int, int] = {r[0]: r[1] for r in sample.groupBy("plan_id").count().collect()}
    rows = []
    for t in targets:
        k = (t["plan_id"], t["stratum_id"])
        n, w, d, x, whole = available.get(k, 0), wanted[k], drawn.get(k, 0), attainable[k], total.get(k[0], 0)
        off = abs(d - (t["target_share"] or 0.0) * whole) > 1.0
        rows.append((*k, n, w, x, d, t["target_share"], d / whole if whole else None, d - x, n < w, off))
    return sample, spark.createDataFrame(rows, report_schema)
