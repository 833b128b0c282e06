"""What the two vector searches share: distinct vectors, shards against query blocks, merged answers."""

from __future__ import annotations

import io
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from recallspark.llm.arrow import Scratch

_MERGED_SHARDS = 32


def pack(**arrays: np.ndarray) -> bytes:
    body = io.BytesIO()
    np.savez(body, **arrays)
    return body.getvalue()


def unpack(body: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(body)) as arrays:
        return {k: arrays[k] for k in arrays.files}


def finite(vector: Column) -> Column:
    """Not null, not empty, and without null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad


def one_length(rows: DataFrame) -> DataFrame:
    """Vectors `v` of the length that most rows have, the smaller at a tie; others cannot be multiplied."""
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"))
    chosen = lengths.orderBy(F.desc("n"), "d").limit(1).select(F.col("d").alias("_d"))
    return rows.join(F.broadcast(chosen), F.size("v") == F.col("_d")).drop("_d")


def _grouped(df: DataFrame, keys: list[str], kernel: Callable[[pa.Table], dict], ddl: str) -> DataFrame:
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(table: pa.Table) -> pa.Table:
        return pa.table(kernel(table), schema=schema)

    return df.groupBy(*keys).applyInArrow(run, ddl)


def matrix(table: pa.Table, column: str, kind: type) -> np.ndarray:
    lists = table.column(column).combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(lists), -1)


def search(
    rows: DataFrame,
    is_query: Column,
    k: int,
    build: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]],
    answer: Callable[[dict[str, np.ndarray], np.ndarray, int], tuple[np.ndarray, np.ndarray, np.ndarray]],
    kind: type,
    shard_rows: int = 8192,
    block_rows: int = 4096,
) -> DataFrame:
    """The k best other rows of every query row: query_id, rank, vec_id, score.

    `rows` has id and v, usable vectors of one length; `is_query` is told from id.
    `build` makes the index of one shard from its vectors and the least id of each,
    `answer` finds for a block of queries (query, row, score) in one shard's index,
    at least the k + 1 best there in the order of the result. Equal vectors are one
    entry that keeps its k + 1 smallest ids: no query can ever show more of them.
    Each shard meets each block of distinct query vectors in a task of its own.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark)
    number = "double" if kind is float else "bigint"
    nearest = F.dense_rank().over(Window.partitionBy("v").orderBy("id"))
    groups = rows.withColumn("_r", nearest).filter(F.col("_r") <= k + 1)
    groups = groups.groupBy("v").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    groups = scratch.write(groups.withColumn("gid", F.monotonically_increasing_id()))
    asked = rows.filter(is_query).select("id", "v").distinct().join(groups.select("v", "gid"), "v").select("id", "gid")
    asked = scratch.write(asked)
    wanted = groups.join(asked.select("gid").distinct(), "gid", "left_semi").select("gid", "v")
    shards = max(1, -(-groups.count() // shard_rows))
    blocks = max(1, -(-wanted.count() // block_rows))

    def index(table: pa.Table) -> dict:
        gid, v = table.column("gid").to_numpy(), matrix(table, "v", kind)
        order = np.argsort(gid)
        least = table.column("least").to_numpy()[order]
        return {"shard": [table.column("shard")[0].as_py()], "body": [pack(gid=gid[order], **build(v[order], least))]}

    def block(table: pa.Table) -> dict:
        body = pack(gid=table.column("gid").to_numpy(), v=matrix(table, "v", kind))
        return {"block": [table.column("block")[0].as_py()], "asked": [body]}

    placed = groups.select("gid", "v", F.col("ids")[0].alias("least"), F.pmod(F.xxhash64("gid"), F.lit(shards)).alias("shard"))
    indexed = scratch.write(_grouped(placed, ["shard"], index, "shard bigint, body binary"))
    split = wanted.withColumn("block", F.pmod(F.xxhash64(F.lit(1), "gid"), F.lit(blocks)))
    asked_blocks = scratch.write(_grouped(split, ["block"], block, "block bigint, asked binary"))
    ddl = f"qgid bigint, gid bigint, least bigint, score {number}, shard bigint"
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def meet(shard: pa.Table, block: pa.Table) -> pa.Table:
        if not len(shard) or not len(block):
            return schema.empty_table()
        at = unpack(shard.column("body")[0].as_py())
        queries = unpack(block.column("asked")[0].as_py())
        query, row, score = answer(at, queries["v"], k + 1)
        number_of = np.full(len(query), shard.column("shard")[0].as_py())
        return pa.table([queries["gid"][query], at["gid"][row], at["least"][row], score, number_of], schema=schema)

    every_block = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block")
    every_shard = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard")
    left = indexed.select("shard", "body", every_block).groupBy("shard", "block")
    right = asked_blocks.select("block", "asked", every_shard).groupBy("shard", "block")
    found = left.cogroup(right).applyInArrow(meet, ddl)
    order = [F.desc("score"), F.asc("least")]
    some = Window.partitionBy("qgid", F.pmod("shard", F.lit(_MERGED_SHARDS))).orderBy(*order)
    found = found.withColumn("_r", F.row_number().over(some)).filter(F.col("_r") <= k + 1)
    found = found.withColumn("_r", F.row_number().over(Window.partitionBy("qgid").orderBy(*order)))
    found = found.filter(F.col("_r") <= k + 1).join(groups.select("gid", "ids"), "gid")
    hit = F.struct((-F.col("score")).alias("below"), F.col("id").alias("vec_id"), "score")
    hits = found.select("qgid", "score", F.explode("ids").alias("id")).groupBy("qgid")
    hits = hits.agg(F.slice(F.sort_array(F.collect_list(hit)), 1, k + 1).alias("hits"))
    answers = asked.join(hits, asked.gid == hits.qgid).select(
        F.col("id").alias("query_id"),
        F.slice(F.filter("hits", lambda h: h["vec_id"] != F.col("id")), 1, k).alias("hits"),
    )
    return answers.select("query_id", F.posexplode("hits").alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), "hit.vec_id", "hit.score"
    )
