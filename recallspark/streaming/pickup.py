"""Structured Streaming ingestion: files that appear are ingested once.

A file belongs to one micro-batch as a whole. The checkpoint remembers seen
files, also those without a valid chunk; a file that grew is not read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from recallspark.operators.embedding import Embedder
from recallspark.plans.ingest import Store, ingest_wave
from recallspark.schemas import BINARY_FILES
from recallspark.settings import DEFAULTS, Settings
from recallspark.sources.transcripts import (
    TRANSCRIPTS,
    file_columns,
    literal_path,
    read_lines,
)


def stream_files(
    spark: SparkSession,
    directory: str,
    settings: Settings = DEFAULTS,
    glob: str = TRANSCRIPTS,
) -> DataFrame:
    """New transcript files as they appear. Their content is not read here."""
    files = (
        spark.readStream.format("binaryFile")
        .schema(BINARY_FILES)
        .option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", settings.files_per_wave)
        .load(directory)
    )
    return files.select(*file_columns())


def ingest_stream(
    spark: SparkSession,
    directory: str,
    root: str,
    checkpoint: str,
    embedder: Embedder | None = None,
    settings: Settings = DEFAULTS,
    glob: str = TRANSCRIPTS,
) -> StreamingQuery:
    """Start a query that ingests all files not seen yet, then stops."""
    store = Store(spark, root).create()

    def store_batch(files: DataFrame, batch_id: int) -> None:
        # At most files_per_wave names. The lines are read by the batch reader: the
        # stream's own reads a file twice when another one's name looks like a glob.
        names = [row[0] for row in files.select("file_path").distinct().collect()]
        if names:
            # A repeated batch finds its chunks stored and its files logged.
            lines = read_lines(spark, [literal_path(name) for name in names], glob)
            ingest_wave(lines, store, embedder, settings)

    return (
        stream_files(spark, directory, settings, glob)
        .writeStream.foreachBatch(store_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
