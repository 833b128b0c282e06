"""The operators over their whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recallspark.llm import (
    bpe,
    graph_search,
    hilbert,
    impact_index,
    jaccard,
    mixing,
    pii,
    ranked_search,
    secret_scan,
    spelling,
    statements,
    style_tree,
    substrings,
    toxicity,
)

Query = Callable[[SparkSession, str], DataFrame]

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Sources are mixed by this power of their size: rare ones gain a little.
SMOOTHING = 0.9
TOXIC = 0.3
SHARDS = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> dict[bytes, int]:
    return bpe.read_ranks(public_tokenizers.path(VOCABULARY))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), vocabulary(), public_tokenizers.PATTERN)


def op2_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return style_tree.extract_text(table(spark, sf_dir, "pages"))


def _span_texts(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _span_digest(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    def spans_of(*wanted: str) -> Column:
        return F.filter("spans", lambda s: s["kind"].isin(*wanted))

    return found.select(
        "doc_id",
        *(F.size(spans_of(kind)).cast("long").alias(f"n_{kind}") for kind in kinds),
        F.sha2(_span_texts(spans_of(*kinds)), 256).alias("base_sha256"),
        _span_texts(F.col("spans")).alias("spans"),
    )


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_digest(pii.find_pii(table(spark, sf_dir, "documents")), pii.BASE_KINDS)


def source_weights(docs: DataFrame) -> DataFrame:
    return mixing.tempered_weights(docs, "source", SMOOTHING)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, source_weights(docs)).select("doc_id", "source", "mix_slot", "mix_position", "mix_epoch")


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_components(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_texts(docs, machine).select(
        "doc_id",
        toxicity.held_out().alias("held_out"),
        "score",
        (F.col("score") >= TOXIC).cast("int").alias("predicted"),
    )


def op7_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_search.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op8_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact_index.exact_top(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), digest=True)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _span_digest(secret_scan.find_secrets(docs, secret_scan.fit(docs)), secret_scan.BASE_KINDS)


def op11_nra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_spellings(table(spark, sf_dir, "documents"))


def op13_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = hilbert.assign_shards(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "curve",
    )


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_bpe,
        op2_style_tree,
        op3_pii,
        op4_mixing,
        op5_jaccard,
        op6_toxicity,
        op7_graph,
        op8_impact,
        op9_substrings,
        op10_secrets,
        op11_nra,
        op12_spelling,
        op13_hilbert,
    )
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x20\x09-\x0D]+"

ORACLES: dict[str, str] = {
    "op5_jaccard": f"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] ELSE
    list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM worded
), members AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS an, any_value(b.n) AS bn, count(*) AS o
  FROM members a JOIN members b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs WHERE 100 * o >= 75 * (an + bn - o)
), reach AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles,
  least(s.doc_id, coalesce((SELECT min(b) FROM reach r WHERE r.a = s.doc_id), s.doc_id)) AS component_id
FROM sets s""",
    "op8_impact": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM scored
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 5""",
    "op9_substrings": f"""
WITH worded AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS t
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM worded WHERE len(w) >= 35)
), repeated AS (
  SELECT t FROM windows GROUP BY t HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT doc_id, i + unnest(range(35)) AS p FROM windows JOIN repeated USING (t)
), words AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM worded
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY 1
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(t, '')) AS kept_sha256
FROM worded LEFT JOIN kept USING (doc_id)""",
    "op11_nra": statements.RANKED,
    "op12_spelling": statements.SPELLING,
    "op13_hilbert": statements.sharded(SHARDS, hilbert.BITS),
}
