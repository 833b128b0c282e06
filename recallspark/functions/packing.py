"""Greedy sentence packing in one linear pass of the JVM's regex engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recallspark.functions.pytext import SPACE, WHITESPACE


def _pack_pattern(limit: int) -> str:
    # Sentences stand between line feeds. One match is one pack: as many whole
    # sentences as fit in `limit` characters, or a single longer one. Empty
    # sentences in front of a pack are skipped, they add no length. Blank rest
    # of the text makes no pack, so it is consumed outside the group.
    blank_rest = rf"{SPACE}{{1,{limit}}}+\z|[{SPACE}&&[^\n]]++\z"
    fitting = rf".{{0,{limit - 1}}}(?=\n|\z)"
    return rf"(?sU)(?:\n++|\G)(?:{blank_rest}|([^\n](?:{fitting}|[^\n]*+)))"


def pack_sentences(text: Column, limit: int) -> Column:
    """Array of chunks of about `limit` characters, cut at sentence ends and line feeds.

    A text within the limit is one chunk, unchanged. A sentence above the limit
    stays whole.
    """
    lines = F.replace(text, F.lit(". "), F.lit(".\n"))
    packs = F.filter(
        F.regexp_extract_all(lines, F.lit(_pack_pattern(limit)), F.lit(1)), lambda pack: pack != ""
    )
    chunks = F.transform(
        packs, lambda pack: F.btrim(F.replace(pack, F.lit("\n"), F.lit(" ")), F.lit(WHITESPACE))
    )
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(chunks)
