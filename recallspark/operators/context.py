"""Hits to context, review sheet and prompt; decisions; final state of a query.

A query has at most as many hits as were asked for, so the hits of one query
always fit one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallspark.functions.pytext import strip

# Layout of context, review sheet and prompt.
CHUNK_SEPARATOR = "\n\n"
SHEET_RULE = "=" * 60
CHUNK_RULE = "-" * 40
SHEET_TITLE = "OUTBOUND PAYLOAD PREVIEW"
SHEET_HELP = (
    "Review each chunk below. You can drop specific chunks",
    "by number before sending.",
)
PROMPT_DATA = ("<retrieved_conversation_data>", "</retrieved_conversation_data>")
PROMPT_QUESTION = ("<question>", "</question>")

# Answers given without asking a model.
NOTHING_FOUND = "No relevant conversation history found."
CANCELLED = "Query cancelled. Nothing was sent to the API."

# What a reviewer may decide.
SEND_ALL = "yes"
SEND_NONE = "no"
DROP = "drop "


def context_lines(hits: DataFrame, text: str = "anon", out: str = "line") -> DataFrame:
    """One line per hit: role in brackets, then the text."""
    return hits.withColumn(out, F.concat(F.lit("["), "role", F.lit("]: "), F.col(text)))


def gather(lines: DataFrame, query: str = "query_id", line: str = "line") -> DataFrame:
    """One row per query with its lines in rank order."""
    return lines.groupBy(query).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", F.col(line).alias("line")))),
            lambda item: item["line"],
        ).alias("lines")
    )


def context_of(lines: Column) -> Column:
    return F.array_join(lines, CHUNK_SEPARATOR)


def review_sheet(lines: Column, question: Column) -> Column:
    """The text a reviewer sees: numbered chunks, then the question."""
    total = F.size(lines).cast("string")
    numbered = F.transform(
        lines,
        lambda line, i: F.concat(
            F.lit("[CHUNK "), (i + 1).cast("string"), F.lit(" of "), total, F.lit("]\n"),
            line, F.lit(f"\n{CHUNK_RULE}\n"),
        ),
    )
    head = "\n".join(["\n" + SHEET_RULE, SHEET_TITLE, *SHEET_HELP, SHEET_RULE, "", ""])
    return F.concat(
        F.lit(head),
        F.array_join(numbered, ""),
        F.lit("\n[QUESTION]\n"),
        question,
        F.lit(f"\n\n{SHEET_RULE}"),
    )


def prompt(context: Column, question: Column) -> Column:
    opening, closing = PROMPT_DATA
    q_opening, q_closing = PROMPT_QUESTION
    return F.concat(
        F.lit(f"{opening}\n"), context, F.lit(f"\n{closing}\n\n{q_opening}\n"),
        question, F.lit(f"\n{q_closing}"),
    )


def read_decision(decision: Column) -> tuple[Column, Column]:
    """(approved, numbers to drop) of a reviewer's words; anything unclear cancels."""
    words = F.lower(strip(decision))
    numbers = F.transform(
        F.split(F.substring(words, len(DROP) + 1, 2**31 - 1), ",", -1),
        lambda n: strip(n).try_cast("bigint"),
    )
    dropping = words.startswith(DROP) & ~F.exists(numbers, lambda n: n.isNull())
    approved = F.coalesce((words == SEND_ALL) | dropping, F.lit(False))
    drops = F.when(dropping, numbers).otherwise(F.array().cast("array<bigint>"))
    return approved, drops


def apply_decisions(
    prepared: DataFrame, decisions: DataFrame | None, query: str = "query_id"
) -> DataFrame:
    """Keep the lines a reviewer leaves in; add `approved`, `kept`, `dropped`.

    Without a decisions table everything is sent. A query that nobody decided on
    is not approved. Numbers that name no line are ignored.
    """
    if decisions is None:
        joined = prepared.withColumn("decision", F.lit(SEND_ALL))
    else:
        joined = prepared.join(decisions.select(query, "decision"), query, "left")
    approved, drops = read_decision(F.col("decision"))
    reviewed = joined.withColumns({"approved": approved, "_drops": drops})
    kept = F.filter("lines", lambda line, i: ~F.array_contains(F.col("_drops"), (i + 1).cast("bigint")))
    return (
        reviewed.withColumn(
            "kept", F.when(F.col("approved"), kept).otherwise(F.array().cast("array<string>"))
        )
        .withColumn(
            "dropped",
            F.when(F.col("approved"), F.size("lines") - F.size("kept"))
            .otherwise(F.lit(0))
            .cast("long"),
        )
        .drop("_drops")
    )


def outcome(reviewed: DataFrame, questions: DataFrame, query: str = "query_id") -> DataFrame:
    """One row per question: status, chunks used, prompt, and the answer if none is asked for.

    NO_HITS: nothing was found; DENIED: cancelled in review; READY: prompt made.
    """
    kept = reviewed.select(query, "lines", "approved", "kept")
    joined = questions.select(query, "question").join(kept, query, "left")
    status = (
        F.when(F.col("lines").isNull(), "NO_HITS")
        .when(~F.col("approved"), "DENIED")
        .otherwise("READY")
    )
    ready = F.col("status") == "READY"
    return joined.withColumn("status", status).select(
        query,
        "question",
        "status",
        F.when(ready, F.size("kept")).otherwise(F.lit(0)).cast("long").alias("chunks_used"),
        F.when(ready, prompt(context_of(F.col("kept")), F.col("question"))).alias("prompt"),
        F.when(F.col("status") == "NO_HITS", NOTHING_FOUND)
        .when(F.col("status") == "DENIED", CANCELLED)
        .alias("answer"),
    )
