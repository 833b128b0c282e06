"""Column types of every table and record the library reads or writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(*field) for field in fields])


# Fixed value: the columns of Spark's binaryFile source.
BINARY_FILES = _struct(
    ("path", T.StringType(), True),
    ("modificationTime", T.TimestampType(), True),
    ("length", T.LongType(), True),
    ("content", T.BinaryType(), True),
)

CHUNKS = _struct(
    ("id", T.LongType(), False),
    ("conversation_id", T.StringType(), False),
    ("chunk_index", T.LongType(), False),
    ("role", T.StringType(), False),
    ("content", T.StringType(), False),
    ("timestamp", T.StringType(), True),
    ("embedding", T.ArrayType(T.FloatType(), False), True),
    ("created_at", T.TimestampType(), False),
)

INGESTION_LOG = _struct(
    ("file_path", T.StringType(), False),
    ("file_size", T.LongType(), False),
    ("chunks_created", T.LongType(), False),
    ("ingested_at", T.TimestampType(), False),
)

ENTITIES = _struct(
    ("entity_type", T.StringType(), False),
    ("real_value", T.StringType(), False),
    ("placeholder", T.StringType(), False),
)

DICTIONARY = _struct(
    ("pos", T.IntegerType(), False),
    ("real_value", T.StringType(), False),
    ("placeholder", T.StringType(), False),
)

ALLOWLIST = _struct(("word", T.StringType(), False))

CHUNK_REJECTS = _struct(
    ("file_path", T.StringType(), False),
    ("conversation_id", T.StringType(), False),
    ("chunk_index", T.LongType(), False),
    ("reject_reason", T.StringType(), False),
)

CHUNK_WARNINGS = _struct(
    ("file_path", T.StringType(), False),
    ("conversation_id", T.StringType(), False),
    ("chunk_index", T.LongType(), False),
    ("warning", T.StringType(), False),
)

AUDIT = _struct(
    ("timestamp", T.StringType(), True),
    ("action", T.StringType(), True),
    ("question_length", T.LongType(), True),
    ("chunks_sent", T.LongType(), True),
)

MAPPING_ENTRY = T.StructType(
    [T.StructField("placeholder", T.StringType()), T.StructField("real_value", T.StringType())]
)

RECOGNISED = T.ArrayType(
    T.StructType(
        [
            T.StructField("text", T.StringType()),
            T.StructField("label", T.StringType()),
            T.StructField("score", T.DoubleType()),
        ]
    )
)

TABLES = {
    "chunks": CHUNKS,
    "ingestion_log": INGESTION_LOG,
    "chunk_rejects": CHUNK_REJECTS,
    "chunk_warnings": CHUNK_WARNINGS,
    "anonymizer_entities": ENTITIES,
}


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)
