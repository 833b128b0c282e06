"""Ranked lexical search without random access (NRA) over impact-sorted lists.

Terms are runs of ASCII letters and digits and of code points beyond ASCII, with
A-Z lower-cased. Documents are cut into shards of bounded size; a shard keeps, for
every term that some item asks for, its documents by falling impact. An item reads
the lists of its terms front to back, side by side. Every document met has a lower
bound (what was read of it) and an upper bound (that, plus the last value read
of each list in which it was not met). Reading ends when no document outside the
candidates can reach the k-th place and each candidate's bounds have met: then
membership, ties and scores are settled. The best of all shards are merged.

A null or empty text, of a document or an item, has no terms: it is never a hit, or has
none. Every row of either table stands for itself, so repeated documents
are hits side by side and repeated items are answered each; among equal scores the smaller id
comes first, a null id before all. Empty tables give no rows. Other columns take no part.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from recallspark.llm.arrow import Scratch, map_batches

_FILTER_BITS = 20  # of a filter of fixed size over the terms that are asked for
_ROWS_AT_ONCE = 4096
_MERGED_SHARDS = 32
# The score's constants.
_WEIGHT, _SCALE, _SHARE = 1000, 1_000_000_000, 75


def _byte_map() -> bytes:
    """Upper-case ASCII letters to lower case, what is no part of a term to a blank."""
    kept = [b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)]
    return bytes(b + 32 if 65 <= b <= 90 else b for b in kept)


_BYTE_MAP = _byte_map()


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text."""
    return (text or b"").translate(_BYTE_MAP).split()


def _counted(rows: DataFrame, asked: np.ndarray | None) -> DataFrame:
    """row, id, n, terms and their tf for every (row, id, body) with a term; of the terms only those in the filter."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        mask = (1 << _FILTER_BITS) - 1
        for whole in batches:
            for low in range(0, len(whole), _ROWS_AT_ONCE):
                batch = whole.slice(low, _ROWS_AT_ONCE)
                kept, lengths, flat, tfs, at = [], [], [], [], [0]
                for row, text in enumerate(batch.column("body")):
                    found = terms_of(text.as_py())
                    if not found:
                        continue
                    counts = Counter(found)
                    if asked is not None:
                        counts = {t: c for t, c in counts.items() if asked[zlib.crc32(t) & mask]}
                    kept.append(row)
                    lengths.append(len(found))
                    flat.extend(counts)
                    tfs.extend(counts.values())
                    at.append(len(flat))
                yield {
                    "row": batch.column("row").take(pa.array(kept, pa.int64())),
                    "id": batch.column("id").take(pa.array(kept, pa.int64())),
                    "n": pa.array(lengths, pa.int64()),
                    "terms": pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, pa.binary()).cast(pa.string())),
                    "tf": pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(tfs, pa.int32())),
                }

    return map_batches(rows, kernel, "row long, id long, n long, terms array<string>, tf array<int>")


def _bodies(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    body = F.coalesce(F.col(text_column), F.lit("")).cast("binary")
    return df.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).cast("long").alias("id"), body.alias("body"))


def settle(lists: list[tuple[np.ndarray, np.ndarray]], documents: int, k: int, segment: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """The k best of documents 0, 1, ... by the sum of their values: numbers and sums, best first, ties to the smaller number.

    A list holds each document once, with positive values in falling order. All lists
    are read from the front, a segment at a time, twice as long each round.
    """
    lower = np.zeros(documents, np.int64)
    met = np.zeros((len(lists), documents), bool)
    at = np.zeros(len(lists), np.int64)
    bound = np.array([values[0] if len(values) else 0 for _, values in lists], np.int64)
    reading = bound > 0
    while True:
        for j in np.flatnonzero(reading):
            numbers, values = lists[j]
            stop = min(at[j] + segment, len(values))
            lower[numbers[at[j] : stop]] += values[at[j] : stop]
            met[j, numbers[at[j] : stop]] = True
            at[j] = stop
            bound[j] = values[stop - 1] if stop < len(values) else 0
        segment *= 2
        some = np.flatnonzero(lower)
        upper = lower[some] + bound.sum() - bound @ met[:, some]
        least = np.partition(lower[some], len(some) - k)[len(some) - k] if len(some) >= k else 0
        live = some[upper >= least]
        settled = len(live) == 0 or bool((upper[upper >= least] == lower[live]).all())
        if (bound.sum() < least or not bound.any()) and settled:
            order = live[np.lexsort((live, -lower[live]))][:k]
            return order, lower[order]
        # Once no unmet document can enter, only the lists in which a candidate was not met matter.
        reading = (bound > 0) & (~met[:, live].all(axis=1) if bound.sum() < least else True)


class _Shard:
    """Impact-sorted lists of a shard's documents, by term."""

    def __init__(self, table: pa.Table) -> None:
        order = pc.sort_indices(table, [("id", "ascending"), ("row", "ascending")], null_placement="at_start")
        table = table.take(order).combine_chunks()
        self.rows, self.ids = table.column("row").to_numpy(), table.column("id").combine_chunks()
        terms, tf = table.column("terms").combine_chunks(), table.column("tf").combine_chunks()
        owner = np.repeat(np.arange(len(table)), pc.list_value_length(terms).to_numpy(zero_copy_only=False))
        coded = terms.flatten().dictionary_encode()
        codes, tf = coded.indices.to_numpy(), tf.flatten().to_numpy().astype(np.int64)
        impact = (_SCALE * tf) // (1000 * tf + 8 * table.column("m").to_numpy()[owner])
        order = np.lexsort((owner, -impact, codes))
        self.owner, self.impact = owner[order], impact[order]
        self.starts = np.searchsorted(codes[order], np.arange(len(coded.dictionary) + 1))
        self.places = {t: i for i, t in enumerate(coded.dictionary.to_pylist())}

    def lists(self, terms: list[str], factors: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
        found = []
        for term, factor in zip(terms, factors, strict=True):
            i = self.places.get(term)
            if i is not None and factor > 0:
                a, b = self.starts[i], self.starts[i + 1]
                positive = a + int(np.count_nonzero(self.impact[a:b]))
                found.append((self.owner[a:positive], self.impact[a:positive] * factor))
        return found


def rank_documents(docs: DataFrame, items: DataFrame, k: int, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", question_column: str = "text", shard_postings: int = 1 << 18, block_items: int = 256) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents of every item.

    One pass over the texts keeps the terms that items ask for, told by a filter of
    fixed size, so no vocabulary is broadcast. Shards hold about `shard_postings`
    entries, blocks `block_items` items, whatever the tables; a task meets one of each.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    asked = scratch.write(_counted(_bodies(items, item_column, question_column), None).select("row", "id", "terms", "tf"))
    buckets = asked.select(F.explode("terms").alias("t")).select(F.crc32(F.col("t").cast("binary")).bitwiseAND(F.lit((1 << _FILTER_BITS) - 1)).alias("b"))
    passes = np.zeros(1 << _FILTER_BITS, bool)
    passes[[r.b for r in buckets.distinct().collect()]] = True  # 2 ** 20 numbers at most
    held = scratch.write(_counted(_bodies(docs, id_column, text_column), passes))

    sums = held.agg(F.count(F.lit(1)), F.sum("n"), F.sum(F.size("terms").cast("long"))).first()
    documents, length, postings = (int(x or 0) for x in sums)
    shards = max(1, -(-postings // shard_postings))
    n_items = asked.count()
    blocks = max(1, -(-n_items // block_items))
    wanted = asked.select("row", "id", F.explode(F.arrays_zip("terms", "tf")).alias("p")).select("row", "id", "p.terms", F.col("p.tf").alias("c"))
    vocabulary = wanted.select("terms").distinct()
    df = held.select(F.explode("terms").alias("terms")).groupBy("terms").agg(F.count(F.lit(1)).alias("df")).join(vocabulary, "terms")
    weight = F.floor(F.lit(float(_WEIGHT)) * F.log((F.lit(2.0 * documents + 2.0)) / (F.lit(2) * F.col("df") + F.lit(1)).cast("double")))
    weighed = wanted.join(df, "terms").withColumn("factor", (F.col("c") * weight).cast("long")).filter("factor > 0")
    questions = weighed.groupBy("row", "id").agg(F.collect_list(F.struct("terms", "factor")).alias("p"))
    questions = scratch.write(
        questions.select(
            F.col("row").alias("item"), F.col("id").alias("item_id"), F.col("p.terms").alias("terms"), F.col("p.factor").alias("factor"),
            F.pmod(F.xxhash64(F.lit(1), "row"), F.lit(blocks)).alias("block"),
        )
    )
    m = F.expr(f"{100 - _SHARE}L + ({_SHARE}L * n * {documents}L) div {max(length, 1)}L")
    shard = F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard")
    ddl = "item long, item_id long, row long, doc_id long, score long, shard long"
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def meet(documents: pa.Table, questions: pa.Table) -> pa.Table:
        if not len(documents) or not len(questions):
            return schema.empty_table()
        at, parts = _Shard(documents), []
        number = documents.column("shard")[0].as_py()
        for q in questions.select(["item", "item_id", "terms", "factor"]).to_pylist():
            best, scores = settle(at.lists(q["terms"], q["factor"]), len(at.rows), k)
            own = [pa.array([v] * len(best), pa.int64()) for v in (q["item"], q["item_id"], number)]
            columns = [own[0], own[1], pa.array(at.rows[best]), at.ids.take(pa.array(best)), pa.array(scores), own[2]]
            parts.append(pa.table(columns, schema=schema))
        return pa.concat_tables(parts)

    every_block = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block")
    every_shard = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard")
    left = held.filter(F.size("terms") > 0).select("row", "id", m.alias("m"), "terms", "tf", shard).select("*", every_block)
    right = questions.select("*", every_shard)
    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(meet, ddl)
    order = [F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("row")]
    some = Window.partitionBy("item", F.pmod("shard", F.lit(_MERGED_SHARDS))).orderBy(*order)
    best = found.withColumn("rank", F.row_number().over(some)).filter(F.col("rank") <= k)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k)
    return best.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
