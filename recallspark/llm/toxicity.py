"""Toxicity: a support vector machine on a gapped-subsequence string kernel with Nyström landmarks.

The kernel compares windows of one, two and three words, character by character with
gaps; a blank inside a window counts as an inserted sign, so split words and phrases of
ordinary words can be told. A text scores by its most toxic window and by its second most toxic word.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallspark.llm.arrow import map_batches, rewrite_batches
from recallspark.llm.words import mix, range_sums

_CLASSES = 64
_LETTERS, _END, _START, _INSERTED = 26, 61, 62, 63
_TABLE = 0x3000
#: Second and third place of a subsequence of three, within a span of five characters.
_GAPS = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))
_DECAY = 0.7
_SLICE = 1 << 18
_SHORTEST, _FLOOR = 3, 3.0
_WIDTHS = (1, 2, 3)
_TEXTS_AT_ONCE = 100
_HASH_BASE = 0x9E3779B97F4A7C15
#: A window may mark toxic texts if it stands in this many of them, and stands out by one of these scores.
_EMPHASIS = 2
#: What the second most toxic word counts beside the most toxic window.
_SECOND = 0.3
_SUPPORT, _SCORES = 3, (3, 4, 5, 6, 8, 12, 1e9)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Classes of code points: 0 blank, 1-26 letters a-z, then digits, other letters, signs."""
    table = np.zeros(_TABLE, np.uint8)
    for code in range(_TABLE):
        low = chr(code).lower()[0]
        if low.isspace() or code < 32:
            table[code] = 0
        elif "a" <= low <= "z":
            table[code] = 1 + ord(low) - ord("a")
        elif low.isdigit():
            table[code] = 27
        elif low.isalnum():
            table[code] = 28 + ord(low) % 33
        else:
            table[code] = _INSERTED
    return table


class Units:
    """Blank-separated units of texts, as classes of characters."""

    def __init__(self, classes: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: np.ndarray, single: bool = True) -> None:
        self.classes, self.starts, self.ends, self.text, self.single = classes, starts, ends, text, single
        heads = np.zeros(len(classes), np.int32)
        heads[starts] = 1
        self.number = np.cumsum(heads, dtype=np.int32) - 1

    @classmethod
    def of_texts(cls, texts: list[str]) -> Units:
        """Units between the signs of a start and an end; single letters set apart by one blank form one, the blanks being inserted signs."""
        codes = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        classes = _classes()[np.minimum(codes, _TABLE - 1)]
        high = codes >= _TABLE
        classes[high] = 28 + codes[high] % 33
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        text_starts = 1 + np.concatenate([[0], np.cumsum(lengths)])[:-1]
        starts, ends = _runs(classes)
        text = np.searchsorted(text_starts, starts, "right") - 1
        if len(starts):
            single = (ends - starts == 1) & (classes[starts] <= _LETTERS)
            joined = np.zeros(len(starts), bool)
            joined[1:] = single[1:] & single[:-1] & (starts[1:] - ends[:-1] == 1) & (text[1:] == text[:-1])
            classes[starts[joined] - 1] = _INSERTED
            heads = np.flatnonzero(~joined)
            ends = np.append(ends[heads[1:] - 1], ends[-1])
            starts, text = starts[heads], text[heads]
            # every blank twice, so that one can end a unit and one begin the next
            times = 1 + (classes == 0)
            at = np.cumsum(times) - times
            classes, starts, ends = np.repeat(classes, times), at[starts] - 1, at[ends - 1] + 2
            classes[starts], classes[ends - 1] = _START, _END
        return cls(classes, starts, ends, text)

    @classmethod
    def of_spelled(cls, spelled: list[str]) -> Units:
        classes = np.frombuffer("\0".join(spelled).encode("latin-1"), np.uint8)
        starts, ends = _runs(classes)
        return cls(classes, starts, ends, np.arange(len(starts)))

    def windows(self) -> Iterator[Units]:
        """All windows of one to three words, those that do not overlap at a time."""
        yield self
        n = len(self.starts)
        if not n:
            return
        rank = np.arange(n) - np.searchsorted(self.text, self.text)
        for width in _WIDTHS[1:]:
            last = np.minimum(np.arange(n) + width - 1, n - 1)
            whole = (last == np.arange(n) + width - 1) & (self.text[last] == self.text)
            for shift in range(width):
                heads = np.flatnonzero(whole & (rank >= shift) & ((rank - shift) % width == 0))
                starts, ends = self.starts[heads], self.ends[heads + width - 1]
                edges = np.zeros(len(self.classes) + 1, np.int8)
                edges[starts] += 1
                edges[ends] -= 1
                inside = np.cumsum(edges[:-1], dtype=np.int8) > 0
                blank = (self.classes == 0) | (self.classes == _START) | (self.classes == _END)
                classes = np.where(inside, np.where(blank, np.uint8(_INSERTED), self.classes), np.uint8(0))
                classes[starts], classes[ends - 1] = _START, _END
                yield Units(classes, starts, ends, self.text[heads], False)

    def hashes(self) -> np.ndarray:
        return mix(range_sums(mix(self.classes.astype(np.uint64)), self.starts, self.ends, _HASH_BASE))

    def spelled(self) -> list[str]:
        body = self.classes.tobytes().decode("latin-1")
        return [body[s:e] for s, e in zip(self.starts.tolist(), self.ends.tolist(), strict=True)]

    def triples(self) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
        """For each gap pattern: the units and codes of its subsequences, and their weight."""
        c = self.classes.astype(np.int32)
        n = len(c)
        for a, b in _GAPS:
            if n <= b:
                continue
            at = np.flatnonzero((self.number[: n - b] == self.number[b:]) & (c[: n - b] > 0) & (c[b:] > 0))
            yield self.number[at], (c[at] << 12) | (c[at + a] << 6) | c[at + b], _DECAY ** (b - 2)

    def margins(self, table: np.ndarray, bias: float) -> np.ndarray:
        """The machine's margin of each unit; landmarks are folded into one table of subsequences.

        As by `triples`, but every place of the text is looked up and those that begin no subsequence add zero:
        that spares gathering the places. A unit has one subsequence of a pattern less for each place it spans.
        """
        total, norm = np.zeros(len(self.starts)), np.zeros(len(self.starts))
        c = self.classes.astype(np.int32)
        n, lengths = len(c), self.ends - self.starts
        if not len(total):
            return total + bias
        first, second, of_unit = c << 12, c << 6, np.maximum(self.number, 0).astype(np.intp)
        inside = self.classes > 0
        for a, b in _GAPS:
            if n <= b:
                continue
            code = first[: n - b] | second[a : n - b + a]
            code |= c[b:]
            found = table.take(code)
            found *= (self.number[: n - b] == self.number[b:]) & inside[b:]
            weight = _DECAY ** (b - 2)
            total += np.bincount(of_unit[: n - b], found, len(total)) * weight
            norm += np.maximum(lengths - b, 0) * weight**2
        return total / np.sqrt(np.maximum(norm, 1e-9)) + bias

    def features(self, index: np.ndarray, width: int) -> np.ndarray:
        """Normalised weights of the indexed subsequences in each unit."""
        out = np.zeros((len(self.starts), width))
        norm = np.zeros(len(self.starts))
        for unit, code, weight in self.triples():
            norm += np.bincount(unit, minlength=len(norm)) * weight**2
            column = index[code]
            known = column >= 0
            np.add.at(out, (unit[known], column[known]), weight)
        return out / np.sqrt(np.maximum(norm, 1e-9))[:, None]


def _runs(classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.concatenate([[False], classes > 0, [False]])
    change = np.flatnonzero(inside[1:] != inside[:-1])
    return change[::2], change[1::2]


@dataclass(frozen=True)
class Machine:
    """Landmarks and weights folded into one table of subsequences, and the calibration of margins."""

    table: np.ndarray
    bias: float
    slopes: tuple[float, float]
    offset: float

    def scores(self, texts: list[str]) -> np.ndarray:
        """From 0 to 1 for each whole text: the calibrated largest margin of its windows."""
        return 1 / (1 + np.exp(-np.clip(self.margins(texts) @ np.array(self.slopes) + self.offset, -30, 30)))

    def margins(self, texts: list[str]) -> np.ndarray:
        """Of each text the largest margin of its windows, and that of its words without the best word."""
        found = np.full((len(texts), 2), -_FLOOR)
        at = 0
        while at < len(texts):
            stop, size = at + 1, len(texts[at])
            while stop < len(texts) and size + len(texts[stop]) < _SLICE:
                size += len(texts[stop])
                stop += 1
            for units in Units.of_texts(texts[at:stop]).windows():
                margins = units.margins(self.table, self.bias)
                np.maximum.at(found[:, 0], at + units.text, margins)
                if units.single and len(margins):
                    hashes = units.hashes()
                    best = np.lexsort((hashes, margins, units.text))
                    best = best[np.append(units.text[best][1:] != units.text[best][:-1], True)]
                    own = np.zeros(stop - at, np.uint64)
                    own[units.text[best]] = hashes[best]
                    other = hashes != own[units.text]
                    np.maximum.at(found[:, 1], at + units.text[other], margins[other])
            at = stop
        return np.minimum(found, _FLOOR)


def _svm(z: np.ndarray, y: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Squared-hinge linear machine in the primal, by Newton steps; the last weight is the bias."""
    z = np.hstack([z, np.ones((len(z), 1))])
    w = np.zeros(z.shape[1])
    for _ in range(30):
        slack = 1 - y * (z @ w)
        active = slack > 0
        za = z[active] * cost[active, None]
        hessian = np.eye(len(w)) + za.T @ z[active]
        step = np.linalg.solve(hessian, w - za.T @ (y[active] * slack[active]))
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Sample:
    """Windows of labelled texts, told apart by hashes: what they are is read only of those that matter."""

    def __init__(self, texts: list[str]) -> None:
        self.texts = texts

    def windows(self) -> Iterator[tuple[int, Units]]:
        for at in range(0, len(self.texts), _TEXTS_AT_ONCE):
            for units in Units.of_texts(self.texts[at : at + _TEXTS_AT_ONCE]).windows():
                if len(units.starts):
                    yield at, units

    def holders(self) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """Texts and the hashes of the windows they hold, each once, and whether these are single words."""
        for at, units in self.windows():
            long = units.ends - units.starts >= _SHORTEST + 2
            pairs = np.unique(np.stack([units.text[long].astype(np.uint64) + np.uint64(at), units.hashes()[long]]), axis=1)
            yield pairs[0].astype(np.int64), pairs[1], units.single

    def by_origin(self) -> Iterator[np.ndarray]:
        """The windows of all texts with the same least hash, each window once: copies share it, others hardly do."""
        least = np.full(len(self.texts), np.iinfo(np.uint64).max, np.uint64)
        for text, h, single in self.holders():
            if not single:
                np.minimum.at(least, text, h)
        origin = np.unique(least, return_inverse=True)[1]
        order = np.argsort(origin, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(origin[order])) + 1):
            held = [h for _, h, _ in Sample([self.texts[i] for i in own]).holders()]
            yield np.unique(np.concatenate(held)) if held else np.zeros(0, np.uint64)

    def spelled(self, wanted: np.ndarray) -> dict[int, str]:
        """The windows of these hashes, in order of the hashes; `wanted` is sorted."""
        found: dict[int, str] = {}
        for _, units in self.windows():
            hashes = units.hashes()
            for i in np.flatnonzero(_known(wanted, hashes)):
                h = int(hashes[i])
                if h not in found:
                    found[h] = units.classes[units.starts[i] : units.ends[i]].tobytes().decode("latin-1")
        return found


def _known(keys: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(keys, hashes), max(len(keys) - 1, 0))
    return keys[at] == hashes if len(keys) else np.zeros(len(hashes), bool)


def _standing_out(toxic: Sample, clean: Sample) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of windows that several toxic texts hold, sorted, and by how many standard errors their rate is above the clean one.

    Texts of one origin, copies mostly, count once.
    """
    held = list(toxic.by_origin())
    keys, t = np.unique(np.concatenate(held), return_counts=True)
    keys, t = keys[t >= _SUPPORT], t[t >= _SUPPORT]
    c, n0 = np.zeros(len(keys), np.int64), 0
    for h in clean.by_origin():
        n0 += 1
        h = h[_known(keys, h)]
        c[np.searchsorted(keys, h)] += 1
    n1, n0 = len(held), max(n0, 1)
    rate = (t + c) / (n1 + n0)
    error = np.sqrt(rate * (1 - rate) * (1 / n1 + 1 / n0))
    return keys, (t / n1 - c / n0) / np.maximum(error, 1e-9)


def _marks(keys: np.ndarray, score: np.ndarray, learnt: Sample, toxic: Sample, clean: Sample) -> np.ndarray:
    """The windows whose presence tells the toxic from the clean texts with least errors; none if nothing beats guessing.

    Single words and longer windows, of which there are many more, have a bound each.
    """
    alone = np.zeros(len(keys), bool)
    for _, h, single in learnt.holders():
        if single:
            alone[np.searchsorted(keys, h[_known(keys, h)])] = True
    best = []
    for sample in (toxic, clean):
        most = np.zeros((2, len(sample.texts)))
        for text, h, _ in sample.holders():
            known = _known(keys, h)
            at = np.searchsorted(keys, h[known])
            for kind in (0, 1):
                own = alone[at] == (kind == 0)
                np.maximum.at(most[kind], text[known][own], score[at[own]])
        best.append(most)

    def errors(words: float, longer: float) -> int:
        found = [(m[0] >= words) | (m[1] >= longer) for m in best]
        return int((~found[0]).sum() + found[1].sum())

    least, words, longer = min((errors(w, v), -w, -v) for w in _SCORES for v in _SCORES)
    marked = np.where(alone, score >= -words, score >= -longer)
    return keys[marked] if least < min(len(toxic.texts), len(clean.texts)) else keys[:0]


def train(texts: list[str], labels: list[int], landmarks: int = 256, ordinary: int = 10_000, hard: int = 3_000, rounds: int = 2, seed: int = 7) -> Machine:
    """Fit on labelled texts: a clean text's windows are clean, a toxic text has a toxic one somewhere.

    Which windows those are is told by how much more of the toxic than of the clean
    texts hold them, so a quoting or wrongly labelled text does no harm; how much more is needed
    is found on a quarter of the texts, which also calibrates. Without such windows every
    text scores the share of toxic ones. The machine learns them, and disguised forms of
    them, against `ordinary` windows of clean texts drawn by hash, and in each round against the
    `hard` ones nearest to them.
    """
    rate = (sum(labels) + 0.5) / (len(labels) + 1)
    flat = Machine(np.zeros(_CLASSES**3, np.float32), 0.0, (0.0, 0.0), math.log(rate / (1 - rate)))
    samples = {
        (y, part): Sample([t for i, (t, own) in enumerate(zip(texts, labels, strict=True)) if own == y and (i % 4 > 0) == part])
        for y in (0, 1)
        for part in (True, False)
    }
    toxic, clean = samples[1, True], samples[0, True]
    if not toxic.texts or not clean.texts:
        return flat
    keys, score = _standing_out(toxic, clean)
    marked = _marks(keys, score, toxic, samples[1, False], samples[0, False])
    if not len(marked):
        return flat
    rank = {int(h): -s for h, s in zip(keys, score, strict=True)}
    found = toxic.spelled(marked)
    sign = chr(_INSERTED)
    # a window of several words counts if no shorter one of it does
    positive = sorted(found, key=lambda h: (found[h].count(sign), rank[h], found[h]))
    kept: list[str] = []
    for u in (found[h] for h in positive):
        if not any(part[1:-1] in u for part in kept):
            kept.append(u)
    strength = {found[h]: -rank[h] for h in found}
    positive = sorted(kept, key=lambda u: (-strength[u], u))

    def plain(spelled: dict[int, str]) -> list[str]:
        return [u for u in spelled.values() if not any(part[1:-1] in u for part in positive)]

    drawn = np.zeros(0, np.uint64)
    for _, h, _ in clean.holders():
        drawn = np.unique(np.concatenate([drawn, h]))[: ordinary]
    negative = sorted(plain(clean.spelled(drawn)))
    rng = np.random.default_rng(seed)
    disguised = _disguised(positive, rng)
    shown = positive + disguised
    marks = sorted({*positive[: landmarks // 4], *_spread(disguised, landmarks // 4), *_spread(negative, landmarks // 2)})
    used = np.unique(np.concatenate([np.zeros(0, np.int32), *(c for _, c, _ in Units.of_spelled(marks).triples())]))
    index = np.full(_CLASSES**3, -1, np.int64)
    index[used] = np.arange(len(used))
    of_marks = Units.of_spelled(marks).features(index, len(used))
    values, vectors = np.linalg.eigh(of_marks @ of_marks.T)
    usable = values > values.max() * 1e-6
    project = of_marks.T @ (vectors[:, usable] / np.sqrt(values[usable]))

    def mapped(spelled: list[str]) -> np.ndarray:
        slices = [spelled[at : at + 500] for at in range(0, len(spelled), 500)]
        return np.vstack([Units.of_spelled(part).features(index, len(used)) @ project for part in slices])

    # what marks more texts weighs more
    own = np.array([strength[u] for u in positive])
    own = (own / own.mean()) ** _EMPHASIS
    weight = np.concatenate([own, np.repeat(own, len(disguised) // len(own))])
    for turn in range(rounds):
        z, y = np.vstack([mapped(shown), mapped(negative)]), np.r_[np.ones(len(shown)), -np.ones(len(negative))]
        w = _svm(z, y, np.r_[30 * weight, np.full(len(negative), 30.0)])
        table = np.zeros(_CLASSES**3, np.float32)
        table[used] = project @ w[:-1]
        bias = float(w[-1])
        if turn + 1 < rounds:
            near: dict[int, float] = {}
            for _, units in clean.windows():
                margins, hashes = units.margins(table, bias), units.hashes()
                near |= {int(hashes[i]): float(margins[i]) for i in np.flatnonzero(margins > -0.7)}
            hardest = np.sort(np.array(sorted(near, key=lambda h: (-near[h], h))[:hard], np.uint64))
            negative = sorted({*negative, *plain(clean.spelled(hardest))})
    machine = Machine(table, bias, (0.0, 0.0), 0.0)
    found = [machine.margins(samples[y, False].texts) for y in (0, 1)]
    return Machine(table, bias, *_calibrate(np.vstack(found), np.repeat([0.0, 1.0], [len(f) for f in found])))


def _spread(units: list[str], n: int) -> list[str]:
    """About n of them at equal steps."""
    return units[:: max(1, -(-len(units) // max(n, 1)))]


def _disguised(spelled: list[str], rng: np.random.Generator) -> list[str]:
    """Of each window with a sign between all letters, a letter doubled, one replaced, a sign and a letter inserted, and split in two."""
    sign, out = chr(_INSERTED), []
    for start, u, end in ((u[0], u[1:-1], u[-1]) for u in spelled):
        i = int(rng.integers(1, len(u)))
        letter = chr(int(rng.integers(1, _LETTERS + 1)))
        forms = [sign.join(u), u[:i] + u[i - 1] + u[i:], u[:i] + sign + u[i + 1 :], u[:i] + sign + u[i:], u[:i] + letter + u[i:], u[:i] + sign + sign + u[i:]]
        out += [start + form + end for form in forms]
    return out


def _calibrate(margins: np.ndarray, y: np.ndarray) -> tuple[tuple[float, float], float]:
    """Logistic fit of the label on the two margins, the second at a fixed part of the first, with smoothed targets and a bounded slope."""
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.c_[margins @ np.array([1.0, _SECOND]), np.ones(len(y))]
    penalty, w = np.array([1e-2, 1e-4]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, x.T @ (p - target) + penalty * w)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    slope = float(np.clip(w[0], 0, 20))
    return (slope, _SECOND * slope), float(w[1])


def held_out(id_column: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(id_column).cast("string").cast("binary")), F.lit(4)) == 2


def is_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "toxic",
    rows_per_label: int = 2500,
    longest: int = 4000,
) -> Machine:
    """Learn from a bounded sample: of each label at most `rows_per_label` ids, their texts of up to `longest` characters.

    The ids are drawn by a hash from labelled rows that are not held out, so
    only the chosen texts reach the driver; null texts, ids and labels take no part, a repeated id gives one text.
    """
    known = labels.select(F.col(id_column).alias("_id"), (F.col(label_column) > 0).cast("int").alias("_y"))
    known = known.filter(F.col("_id").isNotNull() & F.col("_y").isNotNull() & ~held_out("_id"))
    known = known.join(docs.select(F.col(id_column).alias("_id")), "_id", "left_semi")
    known = known.groupBy("_id").agg(F.max("_y").alias("_y")).withColumn("_h", F.xxhash64(F.lit(11), "_id"))
    drawn = [
        (r._id, y)
        for y in (0, 1)
        for r in known.filter(F.col("_y") == y).orderBy("_h", "_id").limit(rows_per_label).select("_id").collect()
    ]
    if not drawn:
        return train([], [])
    chosen = docs.sparkSession.createDataFrame(drawn, f"_id {docs.schema[id_column].dataType.simpleString()}, _y int")
    texts = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_t"))
    texts = texts.filter(F.length("_t").between(1, longest)).join(F.broadcast(chosen), "_id")
    sample = texts.groupBy("_id").agg(F.min("_t").alias("_t"), F.max("_y").alias("_y")).collect()
    sample.sort(key=lambda r: (zlib.crc32(str(r._id).encode()), r._id))
    return train([r._t for r in sample], [r._y for r in sample])


def score_texts(
    docs: DataFrame, machine: Machine, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """A score from 0 to 1 for every whole text; the id and score.

    Null and empty texts get the score of a text without units. Rows are treated
    alone; an empty table gives an empty result; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            yield {id_column: batch.column(0), "score": sent.value.scores([t or "" for t in batch.column(1).to_pylist()])}

    kind = docs.schema[id_column].dataType.simpleString()
    return map_batches(docs.select(id_column, text_column), kernel, f"`{id_column}` {kind}, score double")


def keep_clean(docs: DataFrame, machine: Machine, text_column: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows whose text scores below the threshold, unchanged."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)
    at = docs.columns.index(text_column)

    def change(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = sent.value.scores([t or "" for t in batch.column(at).to_pylist()])
        return batch.filter(pa.array(scores < threshold))

    return rewrite_batches(docs, change)
