"""Stages on rows whose extra columns have the names that the operators use inside."""

from pyspark.sql import functions as F

import corpus_pipeline
from recallspark.llm import jaccard, mixing, pii, toxicity

NAMES = ["_s", "_h", "_n", "_b", "_r", "_block", "_turn", "_slot", "_k1", "_k2", "keys", "row", "c0", "c1", "sig", "k1", "v", "mix_slot"]
EXTRA = {name: i for i, name in enumerate(NAMES)}
LONG = "one two three four five six seven eight nine ten " * 3000


def clashing(spark):
    rows = [
        (1, "alpha beta gamma delta epsilon zeta", "en", "a", 9), (2, "alpha beta gamma delta epsilon zeta", "en", "b", 9), (3, None, None, None, None),
        (4, "", "en", "a", 0), (4, "", "en", "a", 0), (None, "write to me@x.org now please do", "de", "b", 9), (5, LONG, "en", "a", len(LONG)),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.select("*", *[F.lit(i).alias(name) for name, i in EXTRA.items()])


def rows_of(df, *without):
    return sorted(str(tuple(r)) for r in df.drop(*without).collect())


def test_mix_keeps_every_column_as_it_was(spark):
    docs = clashing(spark)
    weights = mixing.tempered_weights(docs, "source", 0.9)
    mixed = mixing.mix(docs, weights)
    assert mixed.columns == [c for c in docs.columns if c != "mix_slot"] + ["mix_slot", "mix_position", "mix_epoch"]
    first = mixed.filter("mix_epoch = 0")
    assert rows_of(first, "mix_slot", "mix_position", "mix_epoch") == rows_of(docs, "mix_slot")
    assert mixing.mix(docs.limit(0), weights).count() == 0


def test_first_of_each_group_keeps_every_column(spark):
    docs = clashing(spark)
    kept = jaccard.keep_first(docs)
    assert kept.columns == docs.columns
    assert rows_of(kept) == rows_of(docs.filter("doc_id IS NULL OR doc_id <> 2"))
    assert jaccard.keep_first(docs.limit(0)).count() == 0


def test_masking_changes_the_text_alone(spark):
    docs = clashing(spark)
    masked = pii.mask_pii(docs)
    assert masked.columns == docs.columns and rows_of(masked, "text") == rows_of(docs, "text")
    changed = [r.text for r in masked.filter("doc_id IS NULL").collect()]
    assert len(changed) == 1 and "me@x.org" not in changed[0]
    assert rows_of(masked.filter("doc_id IS NOT NULL")) == rows_of(docs.filter("doc_id IS NOT NULL"))


def test_dropping_toxic_rows_keeps_the_others_as_they_were(spark):
    docs = clashing(spark)
    machine = toxicity.fit(docs, spark.createDataFrame([(1, 1), (5, 0)], "doc_id long, toxic int"))
    assert rows_of(toxicity.keep_clean(docs, machine, threshold=2.0)) == rows_of(docs)
    assert toxicity.keep_clean(docs, machine, threshold=0.0).count() == 0


def test_stages_on_clashing_rows(spark, tmp_path):
    docs = clashing(spark).drop("mix_slot")
    spark.createDataFrame([(1, 0, 0), (5, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for rows in (docs, docs.limit(0)):
            out = stage(spark, rows, str(tmp_path))
            assert out.columns == rows.columns, name
            if name in ("personal_data", "source_mix"):
                assert out.select("doc_id", "lang").distinct().count() == rows.select("doc_id", "lang").distinct().count(), name
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert tokens.count() == docs.count() and tokens.filter("n_tokens > 0").count() == 4
