"""Messages to chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallspark.functions.packing import pack_sentences
from recallspark.operators.ordering import number_items
from recallspark.settings import DEFAULTS, Settings


def chunk_messages(
    messages: DataFrame,
    settings: Settings = DEFAULTS,
    conversation: str = "conversation_id",
    order: str = "msg_index",
    text: str = "content",
) -> DataFrame:
    """Split every message and number the chunks through each conversation.

    Messages are never merged; other columns are kept.
    """
    packed = messages.withColumn("_chunks", pack_sentences(F.col(text), settings.max_chunk_chars))
    numbered = number_items(
        packed, conversation, order, "_chunks", "_start", settings.messages_per_block
    )
    kept = [c for c in messages.columns if c != text]
    return numbered.select(
        *kept, "_start", F.posexplode("_chunks").alias("_pos", text)
    ).select(*kept, text, (F.col("_start") + F.col("_pos")).alias("chunk_index"))


def chunk_texts(texts: DataFrame, text: str, settings: Settings = DEFAULTS) -> DataFrame:
    """Split rows that are a conversation of one message each: no shuffle is needed."""
    kept = [c for c in texts.columns if c != text]
    return texts.select(
        *kept,
        F.posexplode(pack_sentences(F.col(text), settings.max_chunk_chars)).alias(
            "chunk_index", text
        ),
    ).withColumn("chunk_index", F.col("chunk_index").cast("long"))
