"""Problem 7: filling containers of fixed capacity.

Method: the linear grouping scheme. Within a block of items the large ones are sorted
and cut into groups of equal cardinality, every length rounded up to the longest of its
group; configurations of these few lengths are optimised (each the fullest that a
subset-sum over the lengths still in demand can give around the longest of them, used
as often as demand allows); actual items then take the places of their group, and the
small ones, with what the rounding left free, go in by best fit.

Items are dealt to blocks by their row, not by key or length, so a length or a key that
a third of all rows share is spread evenly; a block is a fair sample of all lengths and
costs at most a few containers at its end.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUPS = 64
SMALL = 0.125
BLOCK = 100_000


def byte_tokens(text: str) -> F.Column:
    """Tokens of the public byte-level tokenizer without end mark: bytes of UTF-8; 0 for null."""
    return F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)).cast("bigint")


def _fullest(room: int, sizes: list[int], left: list[int]) -> dict[int, int]:
    """Numbers of each size, no more than ``left``, that fill ``room`` best."""
    reach, layers = 1, []
    mask = (1 << (room + 1)) - 1
    for j, s in enumerate(sizes):
        k, step = min(left[j], room // s), 1
        while k > 0:
            n = min(step, k)
            layers.append((j, n, s * n, reach))
            reach |= (reach << (s * n)) & mask
            k -= n
            step *= 2
    at, used = reach.bit_length() - 1, {}
    for j, n, w, before in reversed(layers):
        if not before >> at & 1:
            used[j] = used.get(j, 0) + n
            at -= w
    return used


def pack(sizes: np.ndarray, capacity: int, groups: int = GROUPS, small: float = SMALL) -> np.ndarray:
    """A container number for each of ``sizes``, all within 0..capacity."""
    where = np.full(sizes.size, -1, np.int64)
    order = np.argsort(-sizes, kind="stable")
    large = order[sizes[order] > small * capacity]
    n = 0
    free: list[int] = []
    if large.size:
        per = -(-large.size // groups)
        starts = list(range(0, large.size, per))
        tall = [int(sizes[large[i]]) for i in starts]
        left = [min(per, large.size - i) for i in starts]
        taken = [0] * len(starts)
        while any(left):
            j = next(i for i, x in enumerate(left) if x)
            left[j] -= 1
            pattern = _fullest(capacity - tall[j], tall, left)
            left[j] += 1
            pattern[j] = pattern.get(j, 0) + 1
            times = min(left[i] // a for i, a in pattern.items())
            fill = np.zeros(times, np.int64)
            for i, a in pattern.items():
                items = large[starts[i] + taken[i] : starts[i] + taken[i] + a * times]
                where[items] = n + np.repeat(np.arange(times), a)
                fill += sizes[items].reshape(times, a).sum(1)
                taken[i] += a * times
                left[i] -= a * times
            free += (capacity - fill).tolist()
            n += times
    rooms = sorted((f, i) for i, f in enumerate(free))
    for i in order[large.size :]:
        s = int(sizes[i])
        k = bisect_left(rooms, (s, -1))
        if k == len(rooms):
            room, c = capacity, n
            n += 1
        else:
            room, c = rooms.pop(k)
        where[i] = c
        insort(rooms, (room - s, c))
    return where


def containers_of(df: DataFrame) -> list[tuple[int, int]]:
    """The distinct (capacity_id, capacity_tokens) with a capacity of 1 or more; at most 1,000."""
    rows = df.select("capacity_id", "capacity_tokens").where("capacity_tokens >= 1").distinct().limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("more than 1,000 capacities")
    return sorted((r[0], r[1]) for r in rows)


def fill_containers(df: DataFrame, key: str, size: F.Column, capacities: list[tuple[int, int]], block: int = BLOCK) -> DataFrame:
    """Every item of ``df`` in containers of each capacity.

    Columns: capacity_id, capacity_tokens, container (unique for each capacity), ``key``,
    part_no, n_parts, start_token, n_tokens. An item within the capacity is one part;
    a larger one is cut into full containers and a rest that is packed like an item.
    Null sizes count as 0, and items of size 0 get a container too; repeated keys are
    items of their own; an empty table or no capacity gives no rows.
    """
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    schema = f"capacity_id int, capacity_tokens bigint, container bigint, key {kind}, part_no int, n_parts int, start_token bigint, n_tokens bigint"
    if not capacities:
        return spark.createDataFrame([], schema).withColumnRenamed("key", key)
    named = df.select(F.col(key).alias("key"), F.greatest(F.coalesce(size, F.lit(0)).cast("bigint"), F.lit(0)).alias("size"), F.monotonically_increasing_id().alias("row"))
    rows = df.select(F.count(F.lit(1)).alias("n")).first()[0]
    blocks = max(1, -(-rows // block))
    each = F.explode(F.array(*[F.struct(F.lit(int(a)).alias("id"), F.lit(int(b)).cast("bigint").alias("most")) for a, b in capacities]))
    dealt = named.select("key", "size", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"), each.alias("c")).select("key", "size", "block", "c.id", "c.most")

    def solve(table: pa.Table) -> pa.Table:
        most, number, name = table["most"][0].as_py(), table["block"][0].as_py(), table["id"][0].as_py()
        size = table["size"].to_numpy()
        parts = np.maximum(1, -(-size // most))
        rest = size - (parts - 1) * most
        own = pack(rest, most)
        item = np.repeat(np.arange(size.size), parts)
        no = np.arange(item.size) - np.repeat(np.cumsum(parts) - parts, parts) + 1
        last = no == parts[item]
        container = np.empty(item.size, np.int64)
        container[last] = own[item[last]]
        container[~last] = own.max(initial=-1) + 1 + np.arange(int((~last).sum()))
        columns = {
            "capacity_id": pa.array(np.full(item.size, name, np.int32)),
            "capacity_tokens": pa.array(np.full(item.size, most, np.int64)),
            "container": pa.array(container * blocks + number),
            "key": table["key"].combine_chunks().take(pa.array(item)),
            "part_no": pa.array(no.astype(np.int32)),
            "n_parts": pa.array(parts[item].astype(np.int32)),
            "start_token": pa.array((no - 1) * most),
            "n_tokens": pa.array(np.where(last, rest[item], most)),
        }
        return pa.table(columns)

    return dealt.groupBy("id", "block").applyInArrow(solve, schema).withColumnRenamed("key", key)


def fill_report(packed: DataFrame) -> DataFrame:
    """For each capacity: containers, tokens, the fewest containers there could be, and the share filled."""
    each = packed.groupBy("capacity_id", "capacity_tokens").agg(F.countDistinct("container").alias("containers"), F.sum("n_tokens").alias("tokens"))
    return each.withColumn("least", F.ceil(F.col("tokens") / F.col("capacity_tokens"))).withColumn("filled", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6))
