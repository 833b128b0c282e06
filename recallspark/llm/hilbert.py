"""Shards along a Hilbert curve over quantised metadata, with Spark functions alone.

Every dimension of a document (who published it, its language, its size, its
id) becomes one of 65,536 buckets, and the buckets are merged into 16 levels that
hold about equally many rows. The levels are the coordinates of a cell, cells lie
on a Hilbert curve, and the rows, sorted along it, are cut into runs of equal
length: neighbours in any dimension share a shard, so that files can be skipped
by the least and greatest value of any of them.

A null or negative number counts as the least bucket, a null name as the empty
one, a null text as the empty one. Rows at one place of the curve are sorted by
id, nulls first, then by checksum and size; rows equal in all of these are
interchangeable, each has a place of its own. An empty table has no rows. Other columns,
whatever their names, take no part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recallspark.llm.arrow import Scratch

BITS = 4
_HALF = 1 << 10  # numbers keep their leading bits: 1,024 buckets for every power of two


@dataclass(frozen=True)
class Dimension:
    """A column to quantise: a number by its order, a name by its digest."""

    column: str
    number: bool


DIMENSIONS = (Dimension("source", False), Dimension("lang", False), Dimension("n_chars", True), Dimension("doc_id", True))


def _name_bucket(value: Column) -> Column:
    digest = F.md5(F.coalesce(value.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 4), 16, 10).cast("int")


def _number_bucket(value: Column) -> Column:
    """Exact up to 2,047, then by the leading eleven bits; in the order of the numbers."""
    value = F.greatest(F.coalesce(value.cast("long"), F.lit(0).cast("long")), F.lit(0).cast("long"))
    over = F.greatest(F.length(F.bin(value)) - F.lit(11), F.lit(0))
    return (over * _HALF + F.call_function("shiftright", value, over)).cast("int")


def hilbert_index(levels: list[Column], bits: int = BITS) -> Column:
    """The place of a cell on the curve through all cells of 2**bits levels a dimension."""
    n = len(levels)
    turns = F.array(
        *[F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)]
    )

    def turn(x: Column, step: Column) -> Column:
        low, i = step["q"] - F.lit(1), step["i"]
        first, own = F.get(x, F.lit(0)), F.get(x, i)
        set_ = own.bitwiseAND(step["q"]) != 0
        swap = F.when(set_, F.lit(0)).otherwise(first.bitwiseXOR(own).bitwiseAND(low))
        flip = F.when(set_, low).otherwise(swap)
        return F.transform(x, lambda v, k: v.bitwiseXOR(F.when(k == 0, flip).when(k == i, swap).otherwise(F.lit(0))))

    def digits(x: Column) -> Column:
        gray = [F.get(x, F.lit(0))]
        for i in range(1, n):
            gray.append(gray[-1].bitwiseXOR(F.get(x, F.lit(i))))
        carry = F.lit(0)
        for b in range(bits - 1, 0, -1):
            carry = carry.bitwiseXOR(F.when(gray[-1].bitwiseAND(F.lit(1 << b)) != 0, F.lit((1 << b) - 1)).otherwise(F.lit(0)))
        place = F.lit(0).cast("long")
        for b in range(bits - 1, -1, -1):
            for g in gray:
                bit = F.shiftright(g.bitwiseXOR(carry), b).bitwiseAND(F.lit(1))
                place = place * F.lit(2).cast("long") + bit.cast("long")
        return place

    return F.aggregate(turns, F.array(*[v.cast("int") for v in levels]), turn, digits) if bits > 1 else digits(F.array(*levels))


def curve_table(docs: DataFrame, scratch: Scratch, dimensions: tuple[Dimension, ...] = DIMENSIONS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, size, text_crc32 and curve of every row, and the frozen number `_row` that tells equal rows apart."""
    raw = [
        (F.col(d.column).cast("long") if d.number else _name_bucket(F.col(d.column))).alias(f"_v{i}") for i, d in enumerate(dimensions)
    ]
    text = F.coalesce(F.col(text_column), F.lit("")).cast("binary")
    read = docs.select(
        F.col(id_column).alias("id"),
        (F.octet_length(text).cast("long") + F.lit(1).cast("long")).alias("size"),
        F.crc32(text).alias("text_crc32"),
        *raw,
    )
    keys = scratch.write(read.withColumn("_row", F.monotonically_increasing_id()))

    # The least value of each number, one row in all; the buckets count from it.
    numbers = [i for i, d in enumerate(dimensions) if d.number]
    least = keys.agg(*[F.min(f"_v{i}").alias(f"_v{i}") for i in numbers]).first() if numbers else None
    for i in numbers:
        low = F.lit(max(least[f"_v{i}"] or 0, 0)).cast("long")
        keys = keys.withColumn(f"_v{i}", _number_bucket(F.col(f"_v{i}") - low))

    # 65,536 buckets a dimension at most, whatever the rows: small enough to sum in order and to broadcast.
    pairs = F.array(*[F.struct(F.lit(i).alias("d"), F.col(f"_v{i}").alias("v")) for i in range(len(dimensions))])
    counts = keys.select(F.explode(pairs).alias("p")).groupBy("p.d", "p.v").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("d").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("n").over(Window.partitionBy("d"))
    start = F.coalesce(F.sum("n").over(before), F.lit(0).cast("long"))
    level = F.expr(f"(_start * {1 << BITS}) div _total").cast("int")
    levels = scratch.write(counts.withColumn("_start", start).withColumn("_total", total).select("d", "v", level.alias("level")))
    for i in range(len(dimensions)):
        of = levels.filter(F.col("d") == i).select(F.col("v").alias(f"_v{i}"), F.col("level").alias(f"_l{i}"))
        keys = keys.join(F.broadcast(of), f"_v{i}")

    # Cells are at most 2 ** (bits * dimensions): their places are computed once for each, not for each row.
    names = [f"_l{i}" for i in range(len(dimensions))]
    cells = keys.select(*names).distinct().withColumn("curve", hilbert_index([F.col(c) for c in names]))
    if BITS * len(dimensions) <= 16:
        cells = F.broadcast(scratch.write(cells))
    return keys.join(cells, names).select("id", "size", "text_crc32", "curve", "_row")


def assign_shards(docs: DataFrame, shards: int, dimensions: tuple[Dimension, ...] = DIMENSIONS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, size, text_crc32, curve, shard and slot of every row; shards differ by one row at most.

    Only short keys move: dealt out by ranges of (curve, id, ...) that no single cell, source or
    group of copies can fill alone, sorted, and written. The place of a row is the
    number of rows in the parts before its own plus its own number there.
    """
    scratch = Scratch(docs.sparkSession)
    order = ["curve", "id", "text_crc32", "size", "_row"]
    placed = curve_table(docs, scratch, dimensions, id_column, text_column)
    run = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    run = scratch.write(run.withColumn("_at", F.monotonically_increasing_id()))
    # monotonically_increasing_id: the part in the upper bits, the row in the part in the lower 33.
    part, row = F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    parts = run.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(
        "_part",
        F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long")).alias("_start"),
        F.sum("_n").over(Window.partitionBy()).alias("_total"),
    )  # one row for each part of the sort
    shard = F.expr(f"(_place * {shards}) div _total")
    first = F.expr(f"(shard * _total + {shards - 1}) div {shards}")
    numbered = run.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn("_place", F.col("_start") + row)
    return numbered.withColumn("shard", shard).select(
        "id", "size", "text_crc32", "curve", F.col("shard").cast("int").alias("shard"), (F.col("_place") - first).alias("slot")
    )


def write_shards(docs: DataFrame, path: str, shards: int, rows_per_file: int = 100_000, dimensions: tuple[Dimension, ...] = DIMENSIONS, id_column: str = "doc_id", text_column: str = "text") -> None:
    """The whole rows as Parquet under shard=N folders, sorted along the curve inside files of bounded length.

    Needs ids that tell rows apart; repeated rows are written as often as they come.
    """
    assigned = assign_shards(docs, shards, dimensions, id_column, text_column)
    keyed = assigned.select(F.col("id").alias(id_column), "shard", "slot").dropDuplicates([id_column])
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.toDF(*names.values())
    keyed = keyed.withColumnRenamed(id_column, "_id")
    whole = rows.join(keyed, rows[names[id_column]].eqNullSafe(keyed["_id"])).drop("_id")
    run = whole.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").drop("slot")
    kept = [F.col(new).alias(old) for old, new in names.items() if old != "shard"]
    run.select(*kept, "shard").write.option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(path)
