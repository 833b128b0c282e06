"""Operators as Spark jobs: brute force on the smallest tables, and odd rows."""

import collections
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from recallspark.llm import bpe, graph_search, impact_index, jaccard, mixing, pii, queries, secret_scan, style_tree, substrings, toxicity
from tests.compare import connect, difference

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, k1 string, sig int, `hash` int"


def odd_documents(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n", "en", "a", 3), (4, "one", "en", "b", 3), (4, "one", "en", "b", 3),
        (None, "one", None, None, 3), (5, long, "en", "a", 9), (6, long.upper(), "en", "a", 9), (7, long + " tail", "en", "c", 9),
        (8, "x " * 200_000, "en", "a", 9), (9, "mail me@x.org", "de", "b", 9),
    ]
    return spark.createDataFrame([(*r, "k", 1, 2) for r in rows], DOCS)


def empty_documents(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", queries.ORACLES)
def test_query_equals_sql(spark, name):
    assert difference(entry.queries()[name](spark, FOLDER), connect(FOLDER), entry.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", ["op1_bpe", "op3_pii", "op6_toxicity", "op10_secrets"])
def test_one_row_a_document(spark, name):
    found = entry.queries()[name](spark, FOLDER)
    assert found.count() == found.select("doc_id").distinct().count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()


def test_pages(spark):
    found = {r.page_id: r for r in queries.op2_style_tree(spark, FOLDER).collect()}
    for page in spark.read.parquet(f"{FOLDER}/pages.parquet").collect():
        row = found[page.page_id]
        assert row.n_chars == len(row.text) > 0 and not re.search("<p>|&copy;|track\\(", row.text)


def test_style_tree_removes_what_a_host_repeats(spark):
    pages = [(i, "http://h.org/x", f"<div><p>same words</p></div><section><p>text {i} of its own</p></section>") for i in range(8)]
    pages += [(100, None, None), (100, None, None), (101, "odd", "<p>a")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("keys", F.lit(1)).withColumn("text", F.lit("t"))
    rows = {(r.page_id, r.text) for r in style_tree.extract_text(df).collect()}
    assert rows == {(i, f"text {i} of its own") for i in range(8)} | {(100, ""), (101, "a")}
    assert style_tree.extract_text(df.limit(0)).count() == 0


def test_style_tree_judges_marked_parts_and_counts_copies_once(spark):
    page = "<body><main><p>read this, <b>please</b>, too</p><p>text {0} of <b>its</b> own, and words for it</p></main>".format
    pages = [(i, "http://a.org/x", page(i)) for i in range(8)]
    pages += [(10 + i, "http://b.org/x", "<div><p>one page</p></div>") for i in range(6)]
    pages += [(20 + i, "http://c.org/x", f"<p>{i}</p><article><p>one article</p></article>") for i in range(6)]
    found = {r.page_id: r.text for r in style_tree.extract_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(found[i] == f"text {i} of its own, and words for it" for i in range(8))
    assert all(found[10 + i] == "one page" and found[20 + i] == "one article" for i in range(6))


def test_nearest_reaches_its_recall(spark):
    found = collections.defaultdict(set)
    for r in queries.op7_graph(spark, FOLDER).collect():
        found[r.query_id].add(r.vec_id)
    sql = """SELECT a.vec_id, b.vec_id FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0
      QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) <= 20"""
    want = collections.defaultdict(set)
    for q, v in connect(FOLDER).execute(sql).fetchall():
        want[q].add(v)
    assert found.keys() == want.keys()
    assert sum(len(found[q] & want[q]) for q in want) >= 0.9 * sum(map(len, want.values()))


def test_vector_searches_on_odd_rows(spark):
    inf = float("inf")
    rows = [(20, [1.0, 0.0]), (20, [1.0, 0.0]), (50, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [1.0, None]), (4, [inf, 0.0]),
            (5, [1.0]), (None, [1.0, 0.0]), (6, [0.5, 0.5]), (100, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("gid", F.lit(1)).withColumn("v", F.lit(2))
    near = graph_search.nearest(df, F.col("id") % 20 == 0).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in near] == [(20, 50), (20, 100), (20, 6), (100, 20), (100, 50), (100, 6)]
    top = impact_index.exact_top(df, F.col("id") % 50 == 0).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id, r.score) for r in top][:4] == [(50, 20, 65536), (50, 100, 65536), (50, 6, 32768), (50, 1, 0)]
    assert graph_search.nearest(df.limit(0), F.col("id") % 20 == 0).count() == 0
    assert impact_index.exact_top(df.limit(0), F.col("id") % 50 == 0).count() == 0


def test_many_equal_and_linked_texts(spark):
    base = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join(base[:i % 7] + ["new"] + base[i % 7 + 1 :])) for i in range(300)] + [(1000 + i, " ".join(f"z{i}{j}" for j in range(40))) for i in range(20)]
    found = {r.doc_id: r.component_id for r in jaccard.link_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {found[i] for i in range(300)} == {0} and all(found[1000 + i] == 1000 + i for i in range(20))


def test_odd_documents(spark):
    for docs, n in ((odd_documents(spark), 11), (empty_documents(spark), 0)):
        ranks, pattern = queries.vocabulary(), queries.public_tokenizers.PATTERN
        encoded = bpe.encode_texts(docs, ranks, pattern)
        assert encoded.count() == n and encoded.filter("NOT exact").count() == 0
        assert bpe.encode_digests(docs, ranks, pattern).count() == bpe.decode_ids(encoded, ranks).count() == n
        assert pii.find_pii(docs).count() == pii.mask_pii(docs).count() == n
        machine = toxicity.fit(docs, spark.createDataFrame([(5, 0), (9, None), (None, 1)], "doc_id long, toxic int"))
        assert toxicity.score_texts(docs, machine).filter("score BETWEEN 0 AND 1").count() == n
        assert toxicity.keep_clean(docs, machine, threshold=2.0).columns == docs.columns
        assert secret_scan.find_secrets(docs, secret_scan.fit(docs)).count() == n
        assert substrings.remove_repeats(docs).count() == n
        assert jaccard.link_components(docs).count() == n
    rows = jaccard.link_components(odd_documents(spark)).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in rows if r.doc_id in (1, 2, 3, 4, 5, 6, 7, None)} == {
        (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (None, 1, 4), (5, 56, 5), (6, 56, 5), (7, 57, 5)}
    kept = jaccard.keep_first(odd_documents(spark))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 5, 8, 9] and kept.columns == odd_documents(spark).columns
    removed = {r.doc_id: r.n_removed for r in substrings.remove_repeats(odd_documents(spark)).collect()}
    assert (removed[5], removed[6], removed[7], removed[8], removed[1]) == (60, 0, 60, 200_000, 0)


def test_unlinked_texts_of_one_id_all_stay(spark):
    texts = [" ".join(f"{c}{i}" for i in range(30)) for c in "abcde"]
    rows = [(7, texts[0]), (7, texts[1]), (None, texts[2]), (None, texts[3]), (None, texts[3]), (8, texts[4]), (None, texts[4]), (7, texts[1])]
    kept = jaccard.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(7, texts[0]), (7, texts[1]), (None, texts[2]), (None, texts[3]), (8, texts[4])]
    assert sorted(map(str, map(tuple, kept))) == sorted(map(str, want))


def test_mix(spark):
    docs = odd_documents(spark)
    weights = {None: 1.0, "a": 2.0, "b": 1.0, "c": 1.0}
    mixed = mixing.mix(docs, weights, block_rows=1, period=10)
    rows = mixed.orderBy("mix_position").collect()
    assert [r.mix_position for r in rows] == list(range(len(rows)))
    assert {(r.doc_id, r.source) for r in rows} == {(r.doc_id, r.source) for r in docs.collect()}
    counts = collections.Counter(r.source for r in rows[:10])
    assert counts == {None: 2, "a": 4, "b": 2, "c": 2}
    once = mixing.mix(docs, weights, block_rows=1, period=10, repeat=False)
    assert once.count() == 11 and once.select("mix_position").distinct().count() == 11
    assert mixing.mix(empty_documents(spark), {"a": 1.0}).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs, {"a": 1.0})


def test_mix_of_a_hot_source_and_tiny_ones(spark):
    sizes = {"hot": 30_000, "a": 3, "b": 3, "c": 2}
    rows = [(1000 * i + k if s != "hot" else -k, s, f"{s} {k}") for i, s in enumerate(sizes) for k in range(sizes[s])]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    weights = {"hot": 0.9994, "a": 0.0002, "b": 0.0002, "c": 0.0002}
    slots = mixing.mix(docs, weights).select("source", "mix_slot").distinct().orderBy("mix_slot").collect()
    assert [r.mix_slot for r in slots] == list(range(len(slots)))
    seen = dict.fromkeys(sizes, 0)
    for t, r in enumerate(slots, 1):
        seen[r.source] += 1
        assert all(abs(seen[s] - t * weights[s]) < 1.01 for s in sizes)
    mixed = mixing.mix(docs, weights)
    assert mixed.select("doc_id").distinct().count() == len(rows) and mixed.filter("source = 'a'").count() <= 2 * 8


def test_mix_of_more_sources_than_a_period(spark, tmp_path):
    rows = [(i, f"s{i % 1500}" if i < 3000 else None, f"text {i}") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    mixed = queries.op4_mixing(spark, str(tmp_path))
    assert {(r.doc_id, r.source) for r in mixed.collect()} == {(i, s) for i, s, _ in rows}
    ends = mixed.select(F.min("mix_position"), F.max("mix_position") + 1, F.count("*")).first()
    assert ends[0] == 0 and ends[1] == ends[2] == mixed.select("mix_position").distinct().count()
    assert corpus_pipeline.mix_sources(spark, docs.limit(0), "").collect() == []


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "personal_data", "source_mix", "tokens"]
    for _, stage in corpus_pipeline.STAGES[:3]:
        assert stage(spark, docs, FOLDER).columns == docs.columns
    found = corpus_pipeline.run(spark, FOLDER)
    assert found.filter("exact").count() == found.count() > 100
