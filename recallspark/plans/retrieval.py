"""Questions to prompts, in three jobs around the work of a reviewer and a model.

`prepare` finds and anonymises hits; `decide` applies the review; `finish` puts
real values back into answers.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallspark.operators import anonymize as anon
from recallspark.operators import context
from recallspark.operators.audit import audit_records
from recallspark.operators.embedding import Embedder, embed
from recallspark.operators.search import fetch_hits, nearest
from recallspark.runtime import Stage
from recallspark.settings import DEFAULTS, Settings

KEY = ["conversation_id", "chunk_index"]


@dataclass
class Prepared:
    hits: DataFrame  # query_id, rank, key, role, timestamp, similarity, anon, mapping
    mapping: DataFrame  # query_id, placeholder, real_value, place
    sheets: DataFrame  # query_id, question, lines, sheet


def find_hits(
    questions: DataFrame,
    chunks: DataFrame,
    stage: Stage,
    embedder: Embedder | None = None,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """The best chunks per question, with their text."""
    asked = embed(questions.select("query_id", "question"), "question", embedder)
    return fetch_hits(nearest(chunks, asked, KEY, stage, settings), chunks, KEY, stage)


def anonymize_hits(
    hits: DataFrame,
    dictionary: DataFrame | None = None,
    allowlist: DataFrame | None = None,
    recogniser: anon.Recogniser | None = None,
    settings: Settings = DEFAULTS,
    text: str = "content",
) -> DataFrame:
    entities = None
    if recogniser is not None:
        hits = anon.keep_entities(recogniser(hits, text, "entities"), "entities", allowlist, settings)
        entities = "entities"
    return anon.anonymize(hits, text, dictionary, entities, settings=settings)


def prepare(
    questions: DataFrame,
    chunks: DataFrame,
    stage: Stage,
    dictionary: DataFrame | None = None,
    allowlist: DataFrame | None = None,
    recogniser: anon.Recogniser | None = None,
    embedder: Embedder | None = None,
    settings: Settings = DEFAULTS,
) -> Prepared:
    """Search, anonymise and lay out for review. Hits are written to the stage once."""
    found = find_hits(questions, chunks, stage, embedder, settings)
    hits = stage.write(
        anonymize_hits(found, dictionary, allowlist, recogniser, settings), "anonymised_hits"
    )
    mapping = anon.merge_mappings(
        anon.mapping_rows(hits, ["query_id", "rank"]), "query_id", ["rank", "seq"]
    )
    sheets = (
        context.gather(context.context_lines(hits))
        .join(questions.select("query_id", "question"), "query_id")
        .withColumn("sheet", context.review_sheet(F.col("lines"), F.col("question")))
    )
    return Prepared(hits, mapping, sheets)


def decide(
    prepared: Prepared, questions: DataFrame, decisions: DataFrame | None
) -> tuple[DataFrame, DataFrame]:
    """(outcome per question, audit records)."""
    reviewed = context.apply_decisions(prepared.sheets, decisions)
    outcomes = context.outcome(reviewed, questions)
    return outcomes, audit_records(outcomes)


def finish(answers: DataFrame, mapping: DataFrame) -> DataFrame:
    return anon.restore_answers(answers, mapping)
