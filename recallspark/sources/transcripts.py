"""JSONL transcripts: listing, lines, messages, rejected lines."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recallspark.functions.pytext import strip
from recallspark.operators.ordering import number_in_file_order
from recallspark.runtime import Stage, setting

# Entry types that carry messages.
MESSAGE_TYPES = ("user", "assistant")

# Fixed value: names of transcript files.
TRANSCRIPTS = "*.jsonl"


def _decoded(uri: Column) -> Column:
    # Metadata paths are percent-encoded; a plus sign stands for itself.
    return F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))


def stem(path: Column) -> Column:
    """The file name without directory and last suffix."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def file_columns() -> list[Column]:
    path = _decoded(F.col("_metadata.file_path"))
    return [
        path.alias("file_path"),
        stem(path).alias("conversation_id"),
        F.col("_metadata.file_size").alias("file_size"),
        F.col("_metadata.file_modification_time").alias("modified_at"),
    ]


def list_transcripts(spark: SparkSession, directory: str, glob: str = TRANSCRIPTS) -> DataFrame:
    """One row per transcript file of the directory; subdirectories are left out.

    Only metadata is selected, so no file is opened.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(directory)
    return files.select(*file_columns())


def literal_path(path: str) -> str:
    """A listed path that is not taken for a glob when read again."""
    return re.sub(r"([*?\[\]{}\\])", r"\\\1", path)


def line_columns(text: DataFrame) -> DataFrame:
    """File columns and the split a line was read from, beside the line itself."""
    return text.select(
        *file_columns(), F.col("_metadata.file_block_start").alias("block_start"), "value"
    )


def read_lines(
    spark: SparkSession, paths: str | list[str], glob: str = TRANSCRIPTS
) -> DataFrame:
    return line_columns(spark.read.option("pathGlobFilter", glob).text(paths))


def _only(column: Column) -> Column:
    """The value as the one row of a generator.

    Filters on it are not pushed below a generator, so a costly value is worked
    out once per line, however often it is used above.
    """
    return F.explode(F.array(column))


def parse_lines(lines: DataFrame) -> DataFrame:
    """Parse every line; add `role`, `content`, `timestamp` and `reject_reason`.

    A line is a message (`content` is set), a reject (`reject_reason` is set), or
    neither: blank, or an entry that carries no text.
    """
    json = F.expr("try_parse_json(CASE WHEN is_valid_utf8(_line) THEN _line END)")
    stripped = lines.withColumn("_line", strip(F.col("value"))).filter("_line <> ''")
    # The last of several equal keys counts, as in most JSON readers. The plan keeps what holds as it is made.
    with setting(lines.sparkSession, "spark.sql.variant.allowDuplicateKeys", "true"):
        parsed = stripped.withColumn("_json", _only(json))
    fields = (
        parsed.withColumns(
            {
                "_type": F.expr("try_variant_get(_json, '$.type', 'variant')"),
                "_message": F.expr("try_variant_get(_json, '$.message', 'variant')"),
                "_timestamp": F.expr("try_variant_get(_json, '$.timestamp', 'variant')"),
            }
        )
        .withColumns(
            {
                "_role": F.expr("try_variant_get(_message, '$.role', 'variant')"),
                "_content": F.expr("try_variant_get(_message, '$.content', 'variant')"),
                "_wanted": F.expr("schema_of_variant(_type) = 'STRING'")
                & F.expr("CAST(_type AS STRING)").isin(*MESSAGE_TYPES),
            }
        )
    )
    # Text of the blocks that hold some; NULL stands for a text block without text.
    # Kinds are asked of small values only: a schema is worked out from the whole value.
    parts = F.expr(
        """transform(
             filter(try_cast(_content AS ARRAY<VARIANT>),
               b -> CASE WHEN try_variant_get(b, '$.type', 'variant') IS NOT NULL
                    THEN schema_of_variant(try_variant_get(b, '$.type', 'variant')) = 'STRING'
                         AND variant_get(b, '$.type', 'string') = 'text'
                    ELSE schema_of_variant(b) = 'STRING' END),
             b -> CASE WHEN try_variant_get(b, '$.type', 'variant') IS NULL THEN CAST(b AS STRING)
                  WHEN try_variant_get(b, '$.text', 'variant') IS NULL THEN ''
                  WHEN schema_of_variant(try_variant_get(b, '$.text', 'variant')) = 'STRING'
                    THEN variant_get(b, '$.text', 'string') END)"""
    )
    # The shape of the line decides how far it is read.
    shape = F.expr(
        """CASE WHEN _json IS NULL THEN 'malformed line'
                WHEN NOT startswith(_line, '{') THEN 'line is not an object'
                WHEN NOT coalesce(_wanted, false) OR _message IS NULL THEN 'no message'
                WHEN try_variant_get(_content, '$[0]', 'variant') IS NOT NULL THEN 'blocks'
                WHEN schema_of_variant(_content) = 'STRING' THEN 'text'
                WHEN _content IS NOT NULL OR _role IS NOT NULL THEN 'no message'
                WHEN to_json(_message) IN ('null', '""', '[]', '0', 'false')
                  OR to_json(_message) LIKE '{%' THEN 'no message'
                ELSE 'message is not an object' END"""
    )
    read = (
        fields.withColumn("_shape", _only(shape))
        .withColumn("_parts", _only(F.when(F.col("_shape") == "blocks", parts)))
        .withColumn(
            "content",
            _only(
                strip(
                    F.when(F.col("_shape") == "text", F.expr("CAST(_content AS STRING)"))
                    .when(F.exists("_parts", lambda p: p.isNull()), None)
                    .otherwise(F.array_join("_parts", "\n"))
                )
            ),
        )
    )
    reason = F.when(
        F.col("_shape").isin("malformed line", "line is not an object", "message is not an object"),
        F.col("_shape"),
    ).when(F.exists("_parts", lambda p: p.isNull()), "text block without text")
    role = F.expr("CASE WHEN schema_of_variant(_role) = 'STRING' THEN CAST(_role AS STRING) END")
    timestamp = F.expr(
        """CASE WHEN _timestamp IS NULL THEN ''
                WHEN schema_of_variant(_timestamp) = 'STRING' THEN CAST(_timestamp AS STRING)
                WHEN NOT is_variant_null(_timestamp) THEN to_json(_timestamp) END"""
    )
    return read.select(
        *lines.columns,
        role.alias("role"),
        "content",
        timestamp.alias("timestamp"),
        reason.alias("reject_reason"),
    )


def messages_of(parsed: DataFrame) -> DataFrame:
    """Lines with a role and with text. Other columns of the lines are kept."""
    return parsed.filter("role <> '' AND content <> ''").drop("value", "reject_reason")


def rejects_of(parsed: DataFrame) -> DataFrame:
    return parsed.filter("reject_reason IS NOT NULL").drop("role", "content", "timestamp")


def read_messages(spark: SparkSession, paths: str | list[str], stage: Stage) -> DataFrame:
    """Messages of all files with `msg_index`, their place in the file."""
    messages = messages_of(parse_lines(read_lines(spark, paths)))
    return number_in_file_order(messages, stage, "messages", "msg_index").drop("block_start")
