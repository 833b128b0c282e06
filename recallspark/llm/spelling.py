"""Words with their near spellings, by k-d trees over letter counts.

A word is a point whose coordinates count its letters. A replaced letter moves a
point by one up in one coordinate and one down in another (L1 distance 2), an added
letter by one up (distance 1, in the tree of words one longer). For every length
there is one tree. Spark makes its upper part: boxes of words are split at the letter and
count that halve them best, by histograms over all words, until none holds more than a
bounded number. Every word then goes to the box it lies in, as a point, and to the
boxes that one edit can reach, as a query; each box is a task that splits on, prunes
boxes by what a query would have to gain or lose, and compares the letters in order.

Only runs of A-Z, a-z and U+00C0 to U+00FF count, with A-Z lower-cased. A null or empty text has no
words, a null id counts as an empty one, repeated rows and equal ids count each time,
very long runs are words like others. Among near words of equal count the smaller in code-point
order wins. An empty table, or one without frequent words, gives no rows. Other columns take no part.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from recallspark.llm.arrow import Scratch, map_batches

# Every 97th run, by a checksum, is read with one letter missing.
_RUN = re.compile("[a-zÀ-ÿ]+")
_MISSING = 97
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_LETTERS = 26 + 64
_HELD_WORDS = 1 << 16
_LEAF = 64  # points that a box keeps without another split
_TRIED = 16  # counts tried for a split inside a box
_PAIRS_AT_ONCE = 1 << 18
_UNEVEN = 64  # a split leaves at least this part of a box on either side

Tree = dict[str, tuple[int, int]]


def count_runs(doc_id: int | None, text: bytes | None, least: int) -> Counter:
    """How often each word of `least` code points or more is read in a text."""
    prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    counts: Counter = Counter()
    for run, n in Counter(_RUN.findall((text or b"").translate(_LOWER).decode())).items():
        if len(run) >= least:
            h = zlib.crc32(run.encode(), prefix)
            if h % _MISSING == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= least:
                counts[run] += n
    return counts


def frequent_words(docs: DataFrame, id_column: str, text_column: str, least: int, occurrences: int) -> DataFrame:
    """word, n: summed in each task first, then over all."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("id"), batch.column("body"), strict=True):
                held.update(count_runs(doc_id.as_py(), text.as_py(), least))
                if len(held) > _HELD_WORDS:
                    yield {"word": list(held), "n": list(held.values())}
                    held = Counter()
        yield {"word": list(held), "n": list(held.values())}

    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").cast("binary").alias("body"))
    counted = map_batches(texts, kernel, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= occurrences)


def letter_counts(words: list[str]) -> np.ndarray:
    """A row for each word, a column for each letter."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    letter = np.where(codes < 128, codes - ord("a"), codes - 0xC0 + 26)
    owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
    flat = np.bincount(owner * _LETTERS + letter, minlength=len(words) * _LETTERS)
    return flat.reshape(len(words), _LETTERS).astype(np.int32)


def _paths(tree: Tree, counts: np.ndarray) -> np.ndarray:
    """The box of the tree in which each point lies."""
    out = np.full(len(counts), "", object)

    def visit(path: str, rows: np.ndarray) -> None:
        if path not in tree or not len(rows):
            out[rows] = path
            return
        letter, least = tree[path]
        high = counts[rows, letter] >= least
        visit(path + "0", rows[~high])
        visit(path + "1", rows[high])

    visit("", np.arange(len(counts)))
    return out


def _narrowed(counts: np.ndarray, rows: np.ndarray, gain: np.ndarray, loss: np.ndarray, box: tuple, split: tuple[int, int], most: tuple[int, int]) -> Iterator[tuple]:
    """The two halves of a box, each with the queries that can still reach it and what they must gain and lose."""
    (low, high), (letter, least) = box, split
    own = counts[rows, letter]
    floor, ceiling = low.get(letter, 0), high.get(letter, 1 << 30)
    lost = loss - np.maximum(own - ceiling, 0) + np.maximum(own - (least - 1), 0)
    keep = (lost <= most[1]) & (gain <= most[0])
    yield "0", rows[keep], gain[keep], lost[keep], (low, high | {letter: least - 1})
    gained = gain - np.maximum(floor - own, 0) + np.maximum(least - own, 0)
    keep = (gained <= most[0]) & (loss <= most[1])
    yield "1", rows[keep], gained[keep], loss[keep], (low | {letter: least}, high)


def _reached(tree: Tree, counts: np.ndarray, most: tuple[int, int]) -> Iterator[tuple[str, np.ndarray]]:
    """Boxes with the points from which gaining and losing so many letters leads into them."""
    zero = np.zeros(len(counts), np.int32)
    stack = [("", np.arange(len(counts)), zero, zero, ({}, {}))]
    while stack:
        path, rows, gain, loss, box = stack.pop()
        if not len(rows):
            continue
        if path not in tree:
            yield path, rows
            continue
        for side, *rest in _narrowed(counts, rows, gain, loss, box, tree[path], most):
            stack.append((path + side, *rest))


def _one_edit(short: list[str], long: list[str]) -> np.ndarray:
    """Which pairs are one replaced (equal lengths) or one added letter apart, by the order of the letters."""
    a = np.frombuffer("".join(short).encode("utf-32-le"), np.uint32).reshape(len(short), -1)
    b = np.frombuffer("".join(long).encode("utf-32-le"), np.uint32).reshape(len(long), -1)
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    same = np.logical_and.accumulate(a == b[:, :-1], axis=1).sum(axis=1)
    tail = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return same + tail >= a.shape[1]


def near_pairs(points: list[str], queries: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(query, point) for each query one edit from a point; points are all of one length, queries all of that or all one shorter."""
    if not points or not queries:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, asked = letter_counts(points), letter_counts(queries)
    most = (1, 1 if len(points[0]) == len(queries[0]) else 0)
    zero, found = np.zeros(len(queries), np.int32), []
    stack = [(np.arange(len(points)), np.arange(len(queries)), zero, zero, ({}, {}))]
    while stack:
        inside, rows, gain, loss, box = stack.pop()
        if not len(inside) or not len(rows):
            continue
        split = _best_split(at[inside]) if len(inside) > _LEAF else None
        if split is not None:
            high = at[inside, split[0]] >= split[1]
            for side, *rest in _narrowed(asked, rows, gain, loss, box, split, most):
                stack.append((inside[high] if side == "1" else inside[~high], *rest))
            continue
        step = max(1, _PAIRS_AT_ONCE // len(inside))
        for low in range(0, len(rows), step):
            some = rows[low : low + step]
            shared = np.zeros((len(some), len(inside)), np.int32)  # letters in common
            for letter in np.flatnonzero(at[inside].any(axis=0)):
                shared += np.minimum(asked[some, letter][:, None], at[inside, letter][None])
            q, p = np.nonzero(shared == len(queries[0]) - most[1])
            found.append((some[q], inside[p]))
    q, p = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
    step = max(1, _PAIRS_AT_ONCE // len(points[0]))
    right = [_one_edit([queries[i] for i in q[s : s + step]], [points[i] for i in p[s : s + step]]) for s in range(0, len(q), step)]
    keep = np.concatenate(right) if right else np.zeros(0, bool)
    return q[keep], p[keep]


def _best_split(counts: np.ndarray) -> tuple[int, int] | None:
    """The letter and count that halve the points best; none for points in one place."""
    values = np.unique(counts)[1:]
    values = values[:: -(-len(values) // _TRIED)]
    below = np.array([(counts < v).sum(axis=0) for v in values]).reshape(len(values), -1)
    even = np.minimum(below, len(counts) - below)
    if not even.any():
        return None
    i, letter = np.unravel_index(even.argmax(), even.shape)
    return int(letter), int(values[i])


def _upper_trees(words: DataFrame, box_words: int) -> tuple[dict[int, Tree], dict[tuple[int, str], int]]:
    """Splits of every length's tree, and the parts of boxes that letter counts cannot split evenly.

    What the driver holds are the splits: at most _UNEVEN for every `box_words` words.
    """
    trees: dict[int, Tree] = {}
    parts: dict[tuple[int, str], int] = {}
    sizes = [(r.l, "", r.n) for r in words.groupBy(F.length("word").alias("l")).agg(F.count(F.lit(1)).alias("n")).collect()]
    large = {(length, path): n for length, path, n in sizes if n > box_words}
    while large:

        def histogram(batches: Iterator[pa.RecordBatch], trees=trees, large=frozenset(large)) -> Iterator[dict]:
            seen: Counter = Counter()
            for batch in batches:
                texts = np.array(batch.column("word").to_pylist(), object)
                lengths = np.array([len(t) for t in texts], np.int64)
                for length in {length for length, _ in large} & set(lengths.tolist()):
                    counts = letter_counts(list(texts[lengths == length]))
                    paths = _paths(trees.get(length, {}), counts)
                    for path in {p for n, p in large if n == length}:
                        inside = counts[paths == path]
                        coded = inside.astype(np.int64) * _LETTERS + np.arange(_LETTERS)
                        for code, k in zip(*np.unique(coded, return_counts=True), strict=True):
                            seen[length, path, int(code) % _LETTERS, int(code) // _LETTERS] += int(k)
            names = ("l", "path", "letter", "v")
            yield {c: [key[i] for key in seen] for i, c in enumerate(names)} | {"k": list(seen.values())}

        found = map_batches(words.select("word"), histogram, "l int, path string, letter int, v int, k long")
        found = found.groupBy("l", "path", "letter", "v").agg(F.sum("k").alias("k"))
        letters = Window.partitionBy("l", "path", "letter")
        below = F.sum("k").over(letters.orderBy("v").rowsBetween(Window.unboundedPreceding, -1))
        found = found.withColumn("below", F.coalesce(below, F.lit(0))).withColumn("all", F.sum("k").over(letters))
        even = F.least("below", F.col("all") - F.col("below"))
        best = found.groupBy("l", "path").agg(F.max(F.struct(even.alias("even"), (-F.col("letter")).alias("letter"), "v", "below")).alias("b"))
        chosen = {(r.l, r.path): r.b for r in best.collect()}
        later = {}
        for (length, path), n in large.items():
            b = chosen[length, path]
            if b.even * _UNEVEN < n:
                parts[length, path] = -(-n // box_words)
                continue
            trees.setdefault(length, {})[path] = (-b.letter, b.v)
            later |= {(length, path + "0"): b.below, (length, path + "1"): n - b.below}
        large = {k: n for k, n in later.items() if n > box_words}
    return trees, parts


def near_words(words: DataFrame, box_words: int = 4096) -> DataFrame:
    """word, n, other, other_n for each of `words` (word, n; distinct) and each other one edit away."""
    trees, parts = _upper_trees(words, box_words)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            texts, ns = np.array(batch.column("word").to_pylist(), object), batch.column("n").to_numpy()
            lengths = np.array([len(t) for t in texts], np.int64)
            for length in set(lengths.tolist()):
                mine = np.flatnonzero(lengths == length)
                counts = letter_counts(list(texts[mine]))
                tree, longer = trees.get(length, {}), trees.get(length + 1, {})
                paths = _paths(tree, counts)
                dealt = [(length, path, 0, np.flatnonzero(paths == path)) for path in set(paths)]
                dealt += [(length, path, 1, rows) for path, rows in _reached(tree, counts, (1, 1))]
                dealt += [(length + 1, path, 2, rows) for path, rows in _reached(longer, counts, (1, 0))]
                for box, path, role, rows in dealt:
                    n = parts.get((box, path), 1)
                    words, times = texts[mine[rows]], ns[mine[rows]]
                    own = np.array([zlib.crc32(w.encode()) % n for w in words]) if role == 0 else None
                    for part in range(n):
                        here = own == part if role == 0 else np.full(len(words), True)
                        fixed = {"l": box, "path": path, "part": part, "role": role}
                        yield {c: [v] * int(here.sum()) for c, v in fixed.items()} | {"word": words[here].tolist(), "n": times[here]}

    ddl = "word string, n long, other string, other_n long"
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def match(table: pa.Table) -> pa.Table:
        role, texts, ns = table.column("role").to_numpy(), table.column("word").to_pylist(), table.column("n").to_numpy()
        at = {r: np.flatnonzero(role == r) for r in range(3)}
        points, left, right = [texts[i] for i in at[0]], [], []
        for r in (1, 2):
            q, p = near_pairs(points, [texts[i] for i in at[r]])
            left.append(at[r][q])
            right.append(at[0][p])
        # A pair of one length is found from either side, one of two lengths from the shorter alone.
        a = np.concatenate([left[0], left[1], right[1]])
        b = np.concatenate([right[0], right[1], left[1]])
        columns = [pa.array([texts[i] for i in a], pa.string()), ns[a], pa.array([texts[i] for i in b], pa.string()), ns[b]]
        return pa.table(columns, schema=schema)

    dealt = map_batches(words.select("word", "n"), deal, "l int, path string, part int, role int, word string, n long")
    return dealt.groupBy("l", "path", "part").applyInArrow(match, ddl)


def _roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """word and the last of its forms, by doubling: each step at least doubles n, so the steps of a chain are few."""
    reach = scratch.write(forms.select("word", F.coalesce("form", "word").alias("root")))
    while True:
        nearer = reach.join(reach.select(F.col("word").alias("root"), F.col("root").alias("next")), "root")
        new = scratch.write(nearer.select("word", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
        scratch.drop(reach)
        if new.filter("moved").isEmpty():
            return new.select("word", "root")
        reach = new.select("word", "root")


def group_spellings(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: int = 5, occurrences: int = 3, box_words: int = 4096) -> DataFrame:
    """word, n, n_near, form, form_n and root of every frequent word.

    `form` is the near word of largest n, if that is twice the word's own at least;
    `root` is where following forms ends.
    """
    scratch = Scratch(docs.sparkSession)
    words = scratch.write(frequent_words(docs, id_column, text_column, least, occurrences))
    best: Column = F.min(F.struct((-F.col("other_n")).alias("below"), "other"))
    near = near_words(words, box_words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    twice = -F.col("best.below") >= 2 * F.col("n")
    forms = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(twice, F.col("best.other")).alias("form"), F.when(twice, -F.col("best.below")).alias("form_n"),
    )
    forms = scratch.write(forms)
    scratch.drop(words)
    return forms.join(_roots(forms, scratch), "word")
