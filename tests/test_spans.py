"""Replacing and restoring many spans: against the literal sequence, by growth, and by query."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from recallspark.functions import spans
from recallspark.operators import anonymize as anon
from recallspark.schemas import RECOGNISED
from recallspark.settings import Settings

PIECES = ["http://", "https://", "a", "b.", "a.b", "@", " ", "\n", "[URL_1]", "[", "/", "\x1c", "ftp:", "x@y.z", "http://a", "é"]
PATTERNS = {"URL": r"https?://\S+", "EMAIL": r"\S+@\S+\.\S+"}


def one_by_one(text, kind):
    entries = []
    for i, found in enumerate(re.findall(PATTERNS[kind], text), 1):
        entries.append((f"[{kind}_{i}]", found))
        text = text.replace(found, entries[-1][0]) if i else text
    return text, entries


def drawn(seed, pieces, longest):
    rng = random.Random(seed)
    return "".join(rng.choices(pieces, k=rng.randint(0, longest)))


@pytest.mark.parametrize("kind", PATTERNS)
def test_links_as_a_sequence_of_replacements(kind):
    for seed in range(4000):
        text = drawn(seed, PIECES, 14)
        assert spans.replace_links(text, kind) == one_by_one(text, kind), text


@pytest.mark.parametrize("kind", PATTERNS)
def test_strict_links_are_replaced_whole(kind):
    for seed in range(2000):
        text = drawn(seed, [p for p in PIECES if "[" not in p], 14)
        anon_text, entries = spans.replace_links(text, kind, strict=True)
        assert [link for _, link in entries] == re.findall(PATTERNS[kind], text)
        assert spans.restore(anon_text, entries) == text
        assert not re.search(PATTERNS[kind], anon_text)


def test_restoring_as_a_sequence_of_replacements():
    names = ["[A]", "[AB]", "Person_1", "Person_10", "aa", "ab", "ba", "[", "]", "A", "aaa"]
    for seed in range(6000):
        rng = random.Random(seed)
        entries = [(rng.choice(names), drawn(rng.random(), ["a", "b", "[", "]", "A", "x", "Person_1"], 3)) for _ in range(rng.randint(0, 6))]
        entries = spans.settle(entries)
        text = drawn(rng.random(), ["[A]", "[AB]", "Person_1", "0", "a", "b", "[", "]", " "], 12)
        expected = text
        for placeholder, value in sorted(entries, key=lambda e: -len(e[0])):
            expected = expected.replace(placeholder, value)
        assert spans.restore(text, entries) == expected, (text, entries)


def seconds(work):
    best = 9.9
    for _ in range(3):
        start = time.perf_counter()
        work()
        best = min(best, time.perf_counter() - start)
    return best


@pytest.mark.parametrize("shape", ["http://h/{}", "http://h/same/{}/tail http://h/same", "u{}@h.org"])
def test_time_grows_with_the_links(shape):
    kind = "EMAIL" if "@" in shape else "URL"
    texts = [" and ".join(shape.format(i) for i in range(n)) for n in (4000, 8000)]
    few, many = (seconds(lambda t=t: spans.replace_links(t, kind)) for t in texts)
    assert many < 3.2 * few
    done = [spans.replace_links(t, kind, strict=True) for t in texts]
    few, many = (seconds(lambda d=d: spans.restore(*d)) for d in done)
    assert many < 3.2 * few
    assert all(spans.restore(*d) == t for d, t in zip(done, texts))


def test_hits_of_a_query_share_their_numbers(spark):
    hits = [
        ("q", 2, "see http://two and http://one, Zoe", [("Zoe", "PER", 1.0)], "keep2"),
        ("q", 1, "see http://one/more http://one Ann a@b.c", [("Ann", "PER", 1.0)], "keep1"),
        ("q", 3, "Ann wrote to a@b.c", [("Ann", "PER", 1.0), ("Bo", "PER", 1.0)], "keep3"),
        ("r", 1, "http://two", None, None), ("r", 2, None, None, None), ("r", 3, "", [], ""),
    ]
    df = spark.createDataFrame(hits, f"query_id string, rank int, content string, entities {RECOGNISED.simpleString()}, _hits string")
    done = anon.anonymize_by_query(df, "content", entities="entities")
    got = {(r.query_id, r["rank"]): r for r in done.collect()}
    assert got["q", 1].anon == "see [URL_1] [URL_2] Person_1 [EMAIL_1]" and got["q", 1]["_hits"] == "keep1"
    assert got["q", 2].anon == "see [URL_3] and [URL_4] Person_2"  # a comma belongs to the link
    assert got["q", 3].anon == "Person_1 wrote to [EMAIL_1]"
    assert (got["r", 1].anon, got["r", 2].anon, got["r", 3].anon) == ("[URL_1]", None, "")
    mapping = anon.merge_mappings(anon.mapping_rows(done, ["query_id", "rank"]), "query_id", ["rank", "seq"])
    assert mapping.count() == mapping.select("query_id", "placeholder").distinct().count() == 8
    answers = done.filter("anon IS NOT NULL").select("query_id", "content", F.col("anon").alias("answer"))
    restored = anon.restore_answers(answers, mapping)
    assert restored.filter("restored <> content").count() == 0
    assert anon.anonymize_by_query(df.limit(0), "content").count() == 0


def test_phrases_are_whole_words(spark):
    phrases = [("nation", "ORG"), ("New York", "LOC"), ("York", "PER"), ("Ann", "PER"), ("Ann", "ORG"), ("#1 fan", "PER"), ("C++", "ORG"), ("...", "LOC"), ("été", "LOC")]
    table = spark.createDataFrame(phrases, "text string, label string")
    texts = ["international nation", "New York, New Yorker; Ann", "Annex of the #1 fan", "C++ and C+ and C++11", "l'été étés", "", None, "NewYork New  York"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    expected = {
        0: [("nation", "ORG")], 1: [("New York", "LOC"), ("York", "PER"), ("Ann", "ORG"), ("Ann", "PER")], 2: [("#1 fan", "PER")],
        3: [("C++", "ORG")], 4: [("été", "LOC")], 5: [], 6: [], 7: [("York", "PER")],
    }
    for settings in (Settings(), Settings(phrases_per_pass=2)):
        rows = anon.PhraseRecogniser(table, settings)(df, "t", "e").orderBy("id").collect()
        assert {r.id: [(e.text, e.label) for e in r.e] for r in rows} == expected


def test_many_phrases_do_not_grow_the_plan(spark):
    few, many = (spark.range(n).selectExpr("concat('name', id, ' surname') AS text", "'PER' AS label") for n in (10, 100_000))
    df = spark.createDataFrame([("name7 surname met name99999 surname and name7 surnames",)], "t string")
    plans = [anon.PhraseRecogniser(p)(df, "t", "e") for p in (few, many)]
    lengths = [len(p._jdf.queryExecution().optimizedPlan().toString()) for p in plans]
    assert abs(lengths[0] - lengths[1]) < 100
    assert [e.text for e in plans[1].first().e] == ["name7 surname", "name99999 surname"]


def test_many_hits_of_a_query_do_not_meet_in_one_row(spark):
    """Neither the texts of a query nor, beside every answer, its whole mapping are collected."""
    df = spark.range(3000).selectExpr("id % 2 AS query_id", "id AS rank", "concat('see http://h/', id, ' and http://h/', id % 5, ' or u', id, '@h.org') AS content")
    done = anon.anonymize_by_query(df, "content")
    mapping = anon.merge_mappings(anon.mapping_rows(done, ["query_id", "rank"]), "query_id", ["rank", "seq"])
    restored = anon.restore_answers(done.select("query_id", "rank", "content", F.col("anon").alias("answer")), mapping)
    for df in (done, restored):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_list" not in plan and "Join" not in plan
    assert restored.columns == ["query_id", "rank", "content", "answer", "restored"]
    assert restored.count() == 3000 and restored.filter("restored <> content").count() == 0
    for query in (0, 1):
        links = {}
        for r in sorted(done.filter(F.col("query_id") == query).collect(), key=lambda r: r["rank"]):
            for m in r.mapping:
                links.setdefault(m.placeholder, m.real_value)
                assert links[m.placeholder] == m.real_value
        urls = [p for p in links if p.startswith("[URL_")]
        assert urls == [f"[URL_{i}]" for i in range(1, len(urls) + 1)]  # in the order of the hits
    unknown = spark.createDataFrame([(None, "[URL_1]"), (7, "[URL_1]"), (0, None)], "query_id long, answer string")
    assert [r.restored for r in anon.restore_answers(unknown, mapping).orderBy("query_id").collect()] == ["[URL_1]", None, "[URL_1]"]


def test_workers_hold_few_python_objects(spark, monkeypatch):
    """Rows are taken a few at a time, and entities pass one worker only."""
    monkeypatch.setattr(anon, "_ROWS_AT_ONCE", 3)
    monkeypatch.setattr(anon, "_KNOWN_WORDS", 2)
    df = spark.range(50).selectExpr("id", "concat('Ann ', id, ' met name', id % 7, ', Bo') AS t").coalesce(1)
    table = spark.createDataFrame([("Ann", "PER"), ("Ann 4", "ORG"), ("name3", "LOC")], "text string, label string")
    allowed = spark.createDataFrame([("Annex",)], "word string")
    found = anon.PhraseRecogniser(table)(df, "t", "e")
    got = {r.id: [e.text for e in r.e] for r in found.collect()}
    assert got == {i: ["Ann"] + ["Ann 4"] * (i == 4) + ["name3"] * (i % 7 == 3) for i in range(50)}
    kept = anon.keep_entities(found, "e", allowed)
    assert {r.id: [e.text for e in r.e] for r in kept.collect()} == {i: [t for t in own if t != "Ann"] for i, own in got.items()}
    names = anon.Gazetteer(table)(df, "t", "e")
    assert anon.keep_entities(names, "e", allowed)._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    nulls = spark.createDataFrame([(1, None), (2, [])], f"id int, e {RECOGNISED.simpleString()}")
    assert [r.e for r in anon.keep_entities(nulls, "e", allowed).orderBy("id").collect()] == [None, []]
