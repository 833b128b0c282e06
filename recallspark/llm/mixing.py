"""Mixing sources to target weights by Pfair scheduling of source blocks."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Mapping
from itertools import count, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recallspark.llm.arrow import Scratch, map_batches

_BUCKET_ROWS = 1_000
#: Slots of the rarest source in a period: its weight is met to a part in so many.
_LEAST_SLOTS = 1000
_BATCH_SLOTS = 50_000


def shares(weights: Mapping[str, float], period: int) -> dict[str, int]:
    """Whole slots of a period for each source, by largest remainder and at least one."""
    if len(weights) > period:
        raise ValueError(f"{len(weights)} sources need a period of at least as many slots")
    total = sum(weights.values())
    exact = {k: w / total * period for k, w in weights.items()}
    slots = {k: max(1, int(x)) for k, x in exact.items()}
    left = period - sum(slots.values())
    order = sorted(exact, key=lambda k: (slots[k] - exact[k], k))
    for at in range(left):
        slots[order[at % len(order)]] += 1
    # only sources above one slot can give one back
    above = [(exact[k] - slots[k], k) for k in slots if slots[k] > 1] if left < 0 else []
    heapq.heapify(above)
    for _ in range(-left):
        _, k = heapq.heappop(above)
        slots[k] -= 1
        if slots[k] > 1:
            heapq.heappush(above, (exact[k] - slots[k], k))
    return slots


def blocks(slots: Mapping[str, int]) -> Iterator[tuple[str, int]]:
    """The source of each slot and the number of its block there, without end.

    Block k of a source with a of the p slots of a period is released at floor(k p / a)
    and due at ceil((k + 1) p / a); each slot takes the released block that is due
    first. As the shares fill the period, every block meets its date, no source
    is ever a whole block away from its share, and after a period all are exact,
    so the same order repeats for ever. Only one block of each source is held.
    """
    period = sum(slots.values())
    waiting = [(0, source, 0) for source in slots]
    ready: list[tuple[int, str, int]] = []
    for slot in count():
        while waiting and waiting[0][0] <= slot:
            _, source, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * period // slots[source]), source, k))
        _, source, k = heapq.heappop(ready)
        yield source, k
        heapq.heappush(waiting, ((k + 1) * period // slots[source], source, k + 1))


def schedule(slots: Mapping[str, int]) -> list[str]:
    """The source of each slot of one period."""
    return [source for source, _ in islice(blocks(slots), sum(slots.values()))]


def _plan(sizes: DataFrame, period: int, block_rows: int, repeat: bool) -> DataFrame:
    """Which block of which source stands in each slot: _s, _block, _slot.

    The one task that deals the slots reads a row of each source (_s, _n, _w) and writes its slots
    as it goes, until each source has given all its rows.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        rows = [r for batch in batches for r in batch.to_pylist()]
        if not rows:
            return
        weights = {r["_s"]: r["_w"] for r in rows}
        needed = {r["_s"]: -(-r["_n"] // block_rows) for r in rows}
        least = math.ceil(sum(weights.values()) / min(weights.values()) * _LEAST_SLOTS)
        dealt, slot, open_sources = blocks(shares(weights, max(period, least))), 0, len(rows)
        while open_sources:
            out: dict = {"_s": [], "_block": [], "_slot": []}
            for source, k in islice(dealt, _BATCH_SLOTS):
                if repeat or k < needed[source]:
                    out["_s"].append(source)
                    out["_block"].append(k)
                    out["_slot"].append(slot)
                slot += 1
                open_sources -= k + 1 == needed[source]
                if not open_sources:
                    break
            yield out

    return map_batches(sizes.select("_s", "_n", "_w").repartition(1), kernel, "_s string, _block long, _slot long")


def mix(
    docs: DataFrame,
    weights: Mapping[str | None, float] | DataFrame,
    source_column: str = "source",
    id_column: str = "doc_id",
    text_column: str = "text",
    block_rows: int = 8,
    period: int = 1000,
    seed: int = 0,
    repeat: bool = True,
) -> DataFrame:
    """Order rows so that every prefix holds the target weights to within a block of each source.

    Sources are cut into blocks of `block_rows` rows in an order drawn from
    `seed`; blocks are interleaved by `schedule`. With `repeat`, a source that
    runs out begins again until the source that lasts longest has given every
    row once: no row is lost and the whole mix has the target weights. Without
    it, every row comes once and the other sources go on in their slots.

    Returns the columns of `docs` and mix_slot, mix_position, mix_epoch (0 at a row's first
    turn); mix_position orders the mix and, with `repeat`, has no gaps.
    `weights` names every source of the table (None for null) with a weight above
    zero, in a mapping or, for any number of sources, in a table of the source column and
    weight; those of other sources do not count. Weights are rounded to whole slots of a period of at
    least `period`, and so long that the rarest source has a thousand. Null ids and texts are
    ordinary values; repeated rows are separate rows; an empty table gives an
    empty mix; a column of a name the mix adds is replaced.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)

    def name(source: Column) -> Column:
        return F.when(source.isNull(), "n").otherwise(F.concat(F.lit("s"), source))

    if isinstance(weights, DataFrame):
        named = weights.select(name(F.col(source_column)).alias("_s"), F.col("weight").cast("double").alias("_w"))
    elif weights:
        given = [(f"s{k}" if k is not None else "n", float(w)) for k, w in weights.items()]
        named = spark.createDataFrame(given, "_s string, _w double")
    else:
        raise ValueError("name a weight for every source")

    # The columns by place, so that no name meets one of the numbers worked out beside them.
    places = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    source, own_id, text = (F.col(places[c]) for c in (source_column, id_column, text_column))
    keyed = docs.toDF(*places.values()).select(
        *places.values(), name(source).alias("_s"), F.xxhash64(F.lit(seed), own_id, text).alias("_h")
    )
    totals = keyed.groupBy("_s").agg(F.count("*").alias("_n"))
    sizes = scratch.write(totals.join(named, "_s", "left"))
    usable = F.coalesce((F.col("_w") > 0) & (F.col("_w") < math.inf), F.lit(False))
    if missing := [r._s for r in sizes.filter(~usable).limit(10).collect()]:
        raise ValueError(f"sources without a weight above zero: {sorted(missing)}")
    plan = scratch.write(_plan(sizes, period, block_rows, repeat))
    takes = plan.groupBy("_s").agg(((F.max("_block") + 1) * block_rows).alias("_take"))
    buckets = F.ceil(F.col("_n") / _BUCKET_ROWS).alias("_buckets")
    facts = scratch.write(sizes.join(takes, "_s").select("_s", "_n", "_take", buckets))
    keyed = keyed.join(facts, "_s").withColumn("_b", F.pmod("_h", "_buckets")).drop("_buckets")
    starts = (
        keyed.groupBy("_s", "_b")
        .agg(F.count("*").alias("_rows"))
        .withColumn("_start", F.sum("_rows").over(Window.partitionBy("_s").orderBy("_b")) - F.col("_rows"))
        .drop("_rows")
    )
    within = Window.partitionBy("_s", "_b").orderBy("_h", own_id)
    ranked = keyed.withColumn("_r", F.row_number().over(within) - 1)
    ranked = ranked.join(starts, ["_s", "_b"]).withColumn("_r", F.col("_r") + F.col("_start"))

    repeated = ranked
    if repeat:
        epochs = F.floor((F.col("_take") - 1 - F.col("_r")) / F.col("_n"))
        repeated = repeated.withColumn("_epoch", F.explode(F.sequence(F.lit(0).cast("long"), epochs)))
    else:
        repeated = repeated.withColumn("_epoch", F.lit(0).cast("long"))
    turn = F.col("_r") + F.col("_epoch") * F.col("_n")
    repeated = repeated.withColumn("_turn", turn).withColumn("_block", F.floor(F.col("_turn") / block_rows))
    repeated = repeated.join(plan, ["_s", "_block"])
    slot = F.col("_slot")
    return repeated.select(
        *[F.col(place).alias(c) for c, place in places.items() if c not in ("mix_slot", "mix_position", "mix_epoch")],
        slot.alias("mix_slot"),
        (slot * block_rows + F.pmod("_turn", F.lit(block_rows))).alias("mix_position"),
        F.col("_epoch").alias("mix_epoch"),
    )


def tempered_weights(docs: DataFrame, source_column: str, power: float) -> DataFrame:
    """The source column and weight, in proportion to a power of the sources' row counts: below 1, rare sources gain."""
    counts = docs.groupBy(source_column).agg(F.count("*").alias("_n"))
    return counts.select(source_column, F.pow("_n", F.lit(power)).alias("weight"))


def in_order(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mixed rows in files that follow one another in the order of the mix."""
    frozen = Scratch(mixed.sparkSession).write(mixed)
    return frozen.repartitionByRange("mix_position").sortWithinPartitions("mix_position").select(*columns)
