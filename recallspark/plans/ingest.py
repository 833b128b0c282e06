"""Transcripts to stored chunks.

A wave of files takes one narrow pass from lines to clean chunks, written to the
stage. The chunk number is finished by the split totals of that table. The store
lies in folders by a hash of the conversation: a wave is compared with the
folders of its own conversations only, and its rows move once, to the folder
they belong to. Every row carries the batch that wrote it, and counts once that batch
is committed by one short row: a run that breaks before leaves nothing to see and
is done again by the next.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recallspark.functions.packing import pack_sentences
from recallspark.operators.embedding import Embedder, embed
from recallspark.operators.hygiene import reject_reason, sanitize
from recallspark.operators.ordering import first_of_each, number_in_file_order
from recallspark.operators.upsert import new_rows
from recallspark.runtime import Stage, make_folder, path_exists
from recallspark.schemas import TABLES
from recallspark.settings import DEFAULTS, Settings
from recallspark.sources.transcripts import (
    TRANSCRIPTS,
    list_transcripts,
    literal_path,
    messages_of,
    parse_lines,
    read_lines,
    stem,
)

KEYS = ["conversation_id", "chunk_index"]

#: What tells the rows of a table apart.
UNIQUE = {
    "chunks": KEYS,
    "ingestion_log": ["file_path"],
    "chunk_rejects": ["file_path", "chunk_index", "reject_reason"],
    "chunk_warnings": [*KEYS, "warning"],
    "anonymizer_entities": ["entity_type", "real_value"],
}


@dataclass
class IngestResult:
    files_processed: int = 0
    total_chunks: int = 0
    skipped: int = 0
    chunks_inserted: int = 0
    lines_rejected: int = 0
    chunks_rejected: int = 0
    chunks_warned: int = 0
    repeated_keys: int = 0

    def add(self, other: IngestResult) -> None:
        for name, value in asdict(other).items():
            setattr(self, name, getattr(self, name) + value)

    def as_row(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(asdict(self).values())], list(asdict(self)))


class Store:
    """The tables of one corpus, as Parquet folders under `root`. One writer at a time.

    A table has a folder for each bucket, a hash of what its rows are found by; how many
    there are is set when the store is created. Rows of a batch appear in all tables at
    once, with its commit.
    """

    def __init__(self, spark: SparkSession, root: str, settings: Settings = DEFAULTS) -> None:
        self.spark, self.root, self._new_buckets = spark, root.rstrip("/"), settings.store_buckets

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def create(self) -> Store:
        """Folders of all tables; one without files is an empty table."""
        for table in [*TABLES, "commits"]:
            make_folder(self.spark, self.path(table))
        if not path_exists(self.spark, f"{self.path('layout')}/_SUCCESS"):
            layout = self.spark.range(1).select(F.lit(self._new_buckets).alias("buckets"))
            layout.write.mode("overwrite").parquet(self.path("layout"))
        return self

    @cached_property
    def buckets(self) -> int:
        return self.spark.read.schema("buckets int").parquet(self.path("layout")).first()["buckets"]

    def bucket(self, table: str) -> Column:
        found_by = {"ingestion_log": stem(F.col("file_path")), "anonymizer_entities": F.col("real_value")}
        return F.pmod(F.xxhash64(found_by.get(table, F.col("conversation_id"))), F.lit(self.buckets)).cast("int")

    def buckets_of(self, rows: DataFrame, table: str) -> list[int]:
        """The buckets of the table in which these rows belong: as many as the store has, at most."""
        return sorted(r.bucket for r in rows.select(self.bucket(table).alias("bucket")).distinct().collect())

    def read(self, table: str, buckets: list[int] | None = None) -> DataFrame:
        """The committed rows, of some buckets or of all."""
        schema = T.StructType([*TABLES[table].fields, *_LAID_OUT])
        rows = self.spark.read.schema(schema).parquet(self.path(table))
        if buckets is not None:
            rows = rows.filter(F.col("bucket").isin(buckets))
        commits = self.spark.read.schema("batch string, committed_at timestamp").parquet(self.path("commits"))
        return rows.join(commits.select("batch").distinct(), "batch", "left_semi").select(*TABLES[table].names)

    def append(self, df: DataFrame, table: str, batch: str) -> None:
        """Add rows of a batch, not seen before its commit. A large bucket takes several files, each from one task."""
        rows = df.withColumn("batch", F.lit(batch)).withColumn("bucket", self.bucket(table))
        rows = rows.select(*TABLES[table].names, "batch", "bucket").hint("rebalance", "bucket")
        rows.write.mode("append").partitionBy("bucket").parquet(self.path(table))

    def rows_of(self, batch: str, table: str, buckets: list[int]) -> int:
        """How many rows a batch has added, committed or not."""
        rows = self.spark.read.schema(T.StructType(_LAID_OUT)).parquet(self.path(table))
        return rows.filter(F.col("bucket").isin(buckets) & (F.col("batch") == batch)).count()

    def commit(self, batch: str) -> None:
        """From now on the rows of the batch count. One file of one row: there is no half of it."""
        row = self.spark.range(1).select(F.lit(batch).alias("batch"), F.current_timestamp().alias("committed_at"))
        row.coalesce(1).write.mode("append").parquet(self.path("commits"))

    def repeats(self, table: str, buckets: list[int] | None = None) -> DataFrame:
        """Keys that several rows of the table have, with their number; none in a sound store."""
        keys = UNIQUE[table]
        return self.read(table, buckets).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


_LAID_OUT = [T.StructField("batch", T.StringType()), T.StructField("bucket", T.IntegerType())]


def new_files(listing: DataFrame, log: DataFrame) -> DataFrame:
    """Files the log does not name. Size and time are not compared."""
    return listing.join(log.select("file_path").distinct(), "file_path", "left_anti")


def _not_in(rows: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that an earlier run, perhaps a broken one, has not stored yet."""
    return rows.join(stored.select(*keys).distinct(), keys, "left_anti")


def prepare_chunks(parsed: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Parsed lines to chunks with `reject_reason`, redacted `content` and `warnings`.

    Validity is judged before redaction. Narrow: no shuffle, no Python worker.
    """
    chunks = messages_of(parsed).withColumn(
        "content", F.explode(pack_sentences(F.col("content"), settings.max_chunk_chars))
    )
    return sanitize(chunks.withColumn("reject_reason", reject_reason(F.col("content"), settings)))


def ingest_wave(
    lines: DataFrame,
    store: Store,
    embedder: Embedder | None = None,
    settings: Settings = DEFAULTS,
) -> IngestResult:
    """Store the chunks of the files of one wave."""
    spark = store.spark
    result = IngestResult()
    with Stage(spark) as stage:
        seen = Observation()
        parsed = parse_lines(lines).observe(seen, F.count("reject_reason").alias("rejected"))
        numbered = number_in_file_order(
            prepare_chunks(parsed, settings), stage, "chunks", "chunk_index"
        )
        result.lines_rejected = seen.get["rejected"]

        is_valid = F.col("reject_reason").isNull()
        files = stage.write(
            numbered.groupBy("file_path", "conversation_id", "file_size").agg(
                F.count_if(is_valid).alias("chunks_created"),
                F.count_if(~is_valid).alias("chunks_rejected"),
                F.count_if(is_valid & (F.size("warnings") > 0)).alias("chunks_warned"),
            ),
            "files",
        )
        totals = files.agg(
            F.count(F.lit(1)).alias("files"),
            F.countDistinct("conversation_id").alias("stems"),
            F.coalesce(F.sum("chunks_created"), F.lit(0)).alias("created"),
            F.coalesce(F.sum("chunks_rejected"), F.lit(0)).alias("rejected"),
            F.coalesce(F.sum("chunks_warned"), F.lit(0)).alias("warned"),
        ).first()
        result.total_chunks = totals["created"]
        result.chunks_rejected, result.chunks_warned = totals["rejected"], totals["warned"]
        batch = uuid.uuid4().hex
        buckets = store.buckets_of(files, "chunks")
        if totals["rejected"]:
            rejects, known = numbered.filter(~is_valid), store.read("chunk_rejects", buckets)
            store.append(_not_in(rejects, known, UNIQUE["chunk_rejects"]), "chunk_rejects", batch)

        valid = numbered.filter(is_valid)
        if totals["warned"]:
            warned, known = valid.withColumn("warning", F.explode("warnings")), store.read("chunk_warnings", buckets)
            store.append(_not_in(warned, known, UNIQUE["chunk_warnings"]), "chunk_warnings", batch)
        if totals["stems"] < totals["files"]:
            # Only texts of stems that several files share are shuffled for their order.
            shared = files.groupBy("conversation_id").count().filter("count > 1").select("conversation_id")
            several = valid.join(shared, "conversation_id", "left_semi")
            several = first_of_each(several, KEYS, [F.col("modified_at"), F.col("file_path")])
            valid = valid.join(shared, "conversation_id", "left_anti").unionByName(several)
        stems = files.select("conversation_id").distinct()
        # Written, so that Spark knows how few keys these are when it plans the next step.
        known = stage.write(store.read("chunks", buckets).select(*KEYS).join(stems, "conversation_id", "left_semi"), "known")
        fresh = embed(new_rows(valid, known, KEYS), "content", embedder)
        fresh = fresh.withColumn("id", F.xxhash64(*KEYS)).withColumn("created_at", F.current_timestamp())
        store.append(fresh, "chunks", batch)
        result.chunks_inserted = store.rows_of(batch, "chunks", buckets)

        log = store.read("ingestion_log", store.buckets_of(files, "ingestion_log"))
        logged = new_files(files.filter("chunks_created > 0"), log)
        store.append(logged.withColumn("ingested_at", F.current_timestamp()), "ingestion_log", batch)
        store.commit(batch)
        result.repeated_keys = store.repeats("chunks", buckets).count()
    return result


def waves(files: DataFrame, size: int, most: int | None = None) -> Iterator[list[str]]:
    """Files in order of modification, `size` of them first, then twice as many each time up to `most`.

    A wave costs some jobs however few its files are, so that the waves must not grow with the files.
    """
    order = F.struct("modified_at", "file_path")
    after = None
    while True:
        rest = files if after is None else files.filter(order > F.struct(*map(F.lit, after)))
        part = rest.orderBy("modified_at", "file_path").limit(size).collect()
        if not part:
            return
        yield [row["file_path"] for row in part]
        after = (part[-1]["modified_at"], part[-1]["file_path"])
        size = max(size, min(2 * size, most or size))


def ingest_all(
    spark: SparkSession,
    directory: str,
    root: str,
    embedder: Embedder | None = None,
    settings: Settings = DEFAULTS,
    glob: str = TRANSCRIPTS,
) -> IngestResult:
    """Ingest every transcript of the directory that the log does not name."""
    store = Store(spark, root).create()
    total = IngestResult()
    with Stage(spark) as stage:
        listing, n_files = stage.write_counted(list_transcripts(spark, directory, glob), "listing")
        todo, n_new = stage.write_counted(new_files(listing, store.read("ingestion_log")), "todo")
        total.skipped = n_files - n_new
        for paths in waves(todo, settings.files_per_wave, settings.largest_wave):
            lines = read_lines(spark, [literal_path(p) for p in paths], glob)
            done = ingest_wave(lines, store, embedder, settings)
            done.files_processed = len(paths)
            total.add(done)
    return total
