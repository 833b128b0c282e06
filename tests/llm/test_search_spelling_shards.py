"""Ranked search, spellings and shards: brute force, odd rows, and many small boxes or shards."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from recallspark.llm import hilbert, queries, ranked_search, spelling

FOLDER = "/root/testdata/sf0.001"
#: Columns whose names the operators use inside, beside those of documents.
ODD = "doc_id long, text string, lang string, source string, n_chars long, row long, id string, body int, shard string, curve int, size string, word int, n string, _row int, _v0 int, l int"
EXTRA = (7, "i", 1, "s", 2, "z", 3, "n", 4, 5, 6)
LONG = "z" * 200_000


def odd_documents(spark):
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n", "en", "a", 3), (4, "Hello hello2", "en", "b", -3),
        (4, "Hello hello2", "en", "b", -3), (None, "hello hello hello", None, None, 3), (None, "hello hello hello", None, None, 3),
        (5, LONG, "de", "c", 200_000), (6, LONG, "de", "c", 200_000), (7, LONG + " hello jello", "de", "c", 2**62), (8, "jello hallo", "fr", "c", 9),
    ]
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], ODD)


def items(spark):
    rows = [(1, "hello"), (2, None), (3, "..."), (4, "HELLO jello hello absent"), (4, "HELLO jello hello absent"), (None, LONG)]
    return spark.createDataFrame([(*r, 1, 2) for r in rows], "item_id long, text string, row int, terms int")


def term_list(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranked(docs, asked, k):
    """Brute force: item rows in order, each with its (doc_id, score)."""
    worded = [(i, Counter(term_list(t))) for i, t in docs]
    worded = [(i, c) for i, c in worded if c]
    total, length = len(worded), sum(sum(c.values()) for _, c in worded)
    df = Counter(t for _, c in worded for t in c)
    out = []
    for item, text in asked:
        scores = []
        for i, c in worded:
            m = 25 + (75 * sum(c.values()) * total) // length
            parts = [
                math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                for t in term_list(text) if t in c
            ]
            if sum(parts) > 0:
                scores.append((-sum(parts), i is not None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [{}, {"shard_postings": 20, "block_items": 2}])
def test_ranked_search_on_odd_rows(spark, sizes):
    docs, asked = odd_documents(spark), items(spark)
    found = ranked_search.rank_documents(docs, asked, k=3, **sizes)
    expected = ranked([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r)[:2] for r in asked.collect()], 3)
    assert sorted(map(tuple, found.collect()), key=str) == expected
    assert expected
    assert ranked_search.rank_documents(docs.limit(0), asked, k=3).count() == 0
    assert ranked_search.rank_documents(docs, asked.limit(0), k=3).count() == 0


def test_many_shards_and_blocks_give_the_same(spark):
    docs, asked = queries.table(spark, FOLDER, "documents"), queries.table(spark, FOLDER, "benchmark")
    one = ranked_search.rank_documents(docs, asked, k=10)
    many = ranked_search.rank_documents(docs, asked, k=10, shard_postings=200, block_items=3)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))


@pytest.mark.parametrize("seed", range(30))
def test_interval_reading_is_exact(seed):
    """Lists with many ties against sums over everything; short segments, so that reading stops early or late."""
    rng = np.random.default_rng(seed)
    documents, k = int(rng.integers(1, 60)), int(rng.integers(1, 8))
    lists, sums = [], np.zeros(documents, np.int64)
    for _ in range(int(rng.integers(0, 6))):
        held = rng.permutation(documents)[: rng.integers(0, documents + 1)]
        values = np.sort(rng.integers(1, 5, len(held)))[::-1].astype(np.int64)
        lists.append((held, values))
        sums[held] += values
    best, scores = ranked_search.settle(lists, documents, k, segment=2)
    expected = [i for i in np.lexsort((np.arange(documents), -sums)) if sums[i] > 0][:k]
    assert best.tolist() == expected and scores.tolist() == sums[expected].tolist()


def test_reading_stops_before_the_end():
    """A clear winner that stands in both lists needs no more than their fronts."""

    class Watched(np.ndarray):
        furthest = 0

        def __getitem__(self, key):
            if isinstance(key, slice):
                Watched.furthest = max(Watched.furthest, int(key.stop))
            return super().__getitem__(key)

    numbers = np.arange(10_000)
    values = np.r_[1000, np.full(9_999, 1)].astype(np.int64).view(Watched)
    best, _ = ranked_search.settle([(numbers, values), (numbers, values)], 10_000, 1, segment=4)
    assert best.tolist() == [0] and Watched.furthest < 100


def near(a, b):
    """One inserted, deleted or replaced code point, by trying each place."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped(docs, least=5, occurrences=3):
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least and n >= occurrences}
    rows = {}
    for w, n in words.items():
        others = [o for o in words if near(w, o)]
        top = min(others, key=lambda o: (-words[o], o), default=None)
        form = top if top is not None and words[top] >= 2 * n else None
        rows[w] = (n, len(others), form, words.get(form))
    out = []
    for w, (n, n_near, form, form_n) in rows.items():
        root = w
        while rows[root][2] is not None:
            root = rows[root][2]
        out.append((w, n, n_near, form, form_n, root))
    return sorted(out)


def spelt(found):
    return sorted((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in found.collect())


def drawn_documents(seed, n):
    """Texts of few letters, so that words have many neighbours, anagrams among them."""
    rng = random.Random(seed)
    letters = "abÿÀe"
    words = ["".join(rng.choices(letters, k=rng.randint(4, 9))) for _ in range(120)]
    words += [w[:2] + rng.choice(letters) + w[rng.randint(2, 3) :] for w in words]
    return [(i, rng.choice(" ,\n1").join(rng.choices(words, weights=range(1, len(words) + 1), k=60))) for i in range(n)]


@pytest.mark.parametrize("box_words", [5, 40, 4096])
def test_spellings_by_brute_force(spark, box_words):
    rows = drawn_documents(box_words, 40)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = grouped(rows)
    assert sum(r[3] is not None for r in expected) > 20
    assert spelt(spelling.group_spellings(docs, box_words=box_words)) == expected


def test_boxes_without_an_even_split(spark):
    """All orders of the same letters are one point: boxes of them are dealt out in parts."""
    rng = random.Random(3)
    same = ["".join(rng.sample("aaabbbcc", 8)) for _ in range(200)]
    rows = [(i, " ".join(same + [w[:3] + "d" + w[4:] for w in same])) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert spelt(spelling.group_spellings(docs, box_words=16)) == grouped(rows)


def test_spellings_on_odd_rows(spark):
    docs = odd_documents(spark)
    found = spelt(spelling.group_spellings(docs, occurrences=2))
    assert found == grouped([tuple(r) for r in docs.select("doc_id", "text").collect()], occurrences=2)
    assert ("jello", 2) in {(r[0], r[1]) for r in found} and LONG in {r[0] for r in found}
    assert spelling.group_spellings(docs.limit(0)).count() == 0


def walk(levels, bits):
    """The curve by its published steps over transposed coordinates, one cell at a time."""
    x, q = list(levels), 1 << (bits - 1)
    while q > 1:
        for i in range(len(x)):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[-1] & q:
            t ^= q - 1
        q >>= 1
    x = [v ^ t for v in x]
    return int("".join(str((v >> b) & 1) for b in range(bits - 1, -1, -1) for v in x), 2)


@pytest.mark.parametrize(("n", "bits"), [(2, 1), (2, 4), (3, 3), (4, 2)])
def test_curve_visits_every_cell_by_single_steps(spark, n, bits):
    cells = spark.range(1 << (n * bits)).select(*[F.shiftright("id", bits * i).bitwiseAND(F.lit((1 << bits) - 1)).alias(f"x{i}") for i in range(n)])
    rows = cells.withColumn("place", hilbert.hilbert_index([F.col(f"x{i}") for i in range(n)], bits)).orderBy("place").collect()
    assert [r.place for r in rows] == list(range(len(rows)))
    steps = [sum(abs(a[i] - b[i]) for i in range(n)) for a, b in zip(rows, rows[1:], strict=False)]
    assert set(steps) <= {1}
    assert all(walk(tuple(r)[:n], bits) == r.place for r in rows)


def test_shards_of_odd_rows(spark):
    docs = odd_documents(spark)
    rows = hilbert.assign_shards(docs, 3).collect()
    texts = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert Counter((r.id, r["size"], r.text_crc32) for r in rows) == texts
    assert sorted((r.shard, r.slot) for r in rows) == sorted((s, i) for s, n in ((0, 4), (1, 4), (2, 3)) for i in range(n))
    along = sorted(rows, key=lambda r: (r.shard, r.slot))
    keys = [(r.curve, r.id is not None, r.id or 0, r.text_crc32, r["size"]) for r in along]
    assert keys == sorted(keys)
    assert hilbert.assign_shards(docs.limit(0), 3).count() == 0


def test_more_shards_than_rows(spark):
    rows = hilbert.assign_shards(odd_documents(spark).limit(2), 8).collect()
    assert len({r.shard for r in rows}) == 2 and {r.slot for r in rows} == {0}


def test_shard_files_hold_the_rows_and_can_be_skipped(spark, tmp_path):
    docs = queries.table(spark, FOLDER, "documents").withColumn("shard", F.lit("own")).withColumn("slot", F.lit(1))
    path = str(tmp_path / "shards")
    hilbert.write_shards(docs.drop("shard"), path, 4, rows_per_file=20)
    written = spark.read.parquet(path)
    assert written.drop("shard").exceptAll(docs.drop("shard")).count() == 0 and written.count() == docs.count()
    # Fewer files hold a source than files of the same length in the order of ids would.
    files = written.groupBy(F.input_file_name()).agg(F.collect_set("source").alias("s"), F.count("*").alias("n")).collect()
    assert max(r.n for r in files) <= 20
    plain = docs.select("source", F.floor(F.row_number().over(hilbert.Window.orderBy("doc_id")) / 20).alias("f"))
    plain = plain.groupBy("f").agg(F.collect_set("source").alias("s")).collect()
    assert sum(len(r.s) for r in files) / len(files) < sum(len(r.s) for r in plain) / len(plain)


def test_native_shards_use_no_python(spark):
    plan = queries.op13_hilbert(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|ExistingRDD", plan)
