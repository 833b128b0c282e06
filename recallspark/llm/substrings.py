"""Removal of repeated word passages, found by difference-cover anchors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallspark.llm.arrow import Scratch, map_batches, row_key
from recallspark.llm.words import Words, mix, signed, text_slices

#: A perfect difference set: every difference modulo PERIOD is one of two members.
PERIOD, COVER = 21, (3, 6, 7, 12, 14)
_FLUSH = 1 << 18


def _covered(words: Words, width: int) -> np.ndarray:
    """Starts of anchors: positions of the cover from which `width` words fit into their text."""
    place = np.arange(len(words.starts)) - words.text_starts[words.text]
    fits = place + width <= words.counts[words.text]
    return np.flatnonzero(fits & np.isin(place % PERIOD, COVER))


class _Postings:
    """Hashed places of some texts, each hash once; a hash that recurs among them is settled here."""

    columns = ("hash", "hash2", "k1", "k2", "place", "settled")

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.rows = 0

    def add(self, h1: np.ndarray, h2: np.ndarray, k1: np.ndarray, k2: np.ndarray, place: np.ndarray) -> None:
        self.parts.append((h1, h2, k1, k2, place.astype(np.int32)))
        self.rows += len(h1)

    def flush(self) -> Iterator[dict]:
        if not self.rows:
            return
        h1, h2, k1, k2, place = (np.concatenate(p) for p in zip(*self.parts, strict=True))
        self.parts, self.rows = [], 0
        order = np.lexsort((h2, h1))
        a, b = h1[order], h2[order]
        same = np.zeros(len(a) + 1, bool)
        same[1:-1] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
        again = same[:-1] | same[1:]
        single = order[~again]
        # one posting stands for a recurring hash, without a place, as the other of every later find
        stand = order[again & ~same[:-1]]
        none = np.full(len(stand), -1, np.int32)
        sent = np.concatenate([single, stand])
        yield self._rows(h1[sent], h2[sent], k1[sent], k2[sent], np.concatenate([place[single], none]), [None] * len(sent))
        found = order[again]
        found = found[np.lexsort((place[found], k2[found], k1[found]))]
        if len(found):
            f1, f2, p = k1[found], k2[found], place[found]
            heads = np.flatnonzero(np.r_[True, (f1[1:] != f1[:-1]) | (f2[1:] != f2[:-1])])
            settled = [x.astype("<i4").tobytes() for x in np.split(p, heads[1:])]
            spread = signed(mix(f1[heads].view(np.uint64) ^ mix(f2[heads].view(np.uint64))))
            yield self._rows(spread, spread, f1[heads], f2[heads], np.full(len(heads), -1, np.int32), settled)

    def _rows(self, h1, h2, k1, k2, place, settled) -> dict:
        return dict(zip(self.columns, (h1, h2, k1, k2, place, settled), strict=True))


_POSTING = "hash bigint, hash2 bigint, k1 bigint, k2 bigint, place int, settled binary"


def _repeated_places(postings: DataFrame) -> DataFrame:
    """For each text, the places whose hash stands at another place too: k1, k2, places."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        last: tuple | None = None  # hash of the latest run, its only row so far if it has one, else None
        for batch in batches:
            settled = batch.column("settled")
            done = np.flatnonzero(~settled.is_null().to_numpy(zero_copy_only=False))
            if len(done):
                taken = batch.take(pa.array(done))
                yield {"k1": taken.column("k1"), "k2": taken.column("k2"), "place": taken.column("place"), "settled": taken.column("settled")}
            open_ = batch.filter(settled.is_null())
            h1, h2, k1, k2, place = (open_.column(c).to_numpy() for c in _Postings.columns[:5])
            n = len(h1)
            if not n:
                continue
            same = np.zeros(n + 1, bool)
            same[1:-1] = (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])
            extra = None
            if last is not None and (h1[0], h2[0]) == last[0]:
                same[0] = True
                extra = last[1]
            keep = np.flatnonzero((same[:-1] | same[1:]) & (place >= 0))
            f1, f2, p = k1[keep], k2[keep], place[keep]
            if extra is not None and extra[2] >= 0:
                f1, f2, p = (np.append(x, np.array([v], x.dtype)) for x, v in zip((f1, f2, p), extra, strict=True))
            alone = not same[n - 1]
            last = ((h1[-1], h2[-1]), (k1[-1], k2[-1], place[-1]) if alone else None)
            if len(p):
                yield {"k1": f1, "k2": f2, "place": p, "settled": [None] * len(p)}

    sorted_ = postings.repartition("hash").sortWithinPartitions("hash", "hash2")
    found = map_batches(sorted_, kernel, "k1 bigint, k2 bigint, place int, settled binary")
    places = F.filter(F.collect_list("place"), lambda p: p >= 0)
    return found.groupBy("k1", "k2").agg(places.alias("places"), F.collect_list("settled").alias("settled"))


def _all_places(places, settled) -> np.ndarray:
    parts = [np.asarray(places, np.int64)] + [np.frombuffer(s, "<i4").astype(np.int64) for s in settled or []]
    return np.unique(np.concatenate(parts))


def anchor_postings(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[dict]:
    """Hashes of the anchors of every text (columns k1, k2, text)."""
    held = _Postings()
    for batch in batches:
        k1, k2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for row, words in text_slices(batch.column(2), lower=False):
            at = _covered(words, width)
            if not len(at):
                continue
            h = signed(words.windows(words.hashes(), at, width))
            text = row + words.text[at]
            held.add(h, h, k1[text], k2[text], at - words.text_starts[words.text[at]])
            if held.rows >= _FLUSH:
                yield from held.flush()
    yield from held.flush()


def window_postings(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[dict]:
    """Hashes of the whole windows that hold a repeated anchor (columns k1, k2, text, places, settled)."""
    held = _Postings()
    reach = np.arange(PERIOD)
    for batch in batches:
        k1, k2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        places, settled = batch.column(3), batch.column(4)
        for row, words in text_slices(batch.column(2), lower=False):
            first, second = words.hashes(1), words.hashes(2)
            for t in range(words.texts):
                anchors = _all_places(places[row + t].as_py(), settled[row + t].as_py())
                inside = np.zeros(max(0, int(words.counts[t]) - window + 1), bool)
                starts = (anchors[:, None] - reach).ravel()
                inside[starts[(starts >= 0) & (starts < len(inside))]] = True
                start = np.flatnonzero(inside)
                if not len(start):
                    continue
                at = start + words.text_starts[t]
                h1, h2 = signed(words.windows(first, at, window)), signed(words.windows(second, at, window))
                held.add(h1, h2, np.full(len(at), k1[row + t]), np.full(len(at), k2[row + t]), start)
                if held.rows >= _FLUSH:
                    yield from held.flush()
    yield from held.flush()


_RESULT = "n_words bigint, n_removed bigint, kept string"


def repeated_windows(docs: DataFrame, scratch: Scratch, id_column: str, text_column: str, window: int) -> DataFrame:
    """Texts with a repeated window, with the first words of all such windows: k1, k2, text, places, settled.

    Two equal windows begin at places whose difference is one of two cover
    members, so some anchor of both, less than a period from their start, is
    aligned: the search by anchors loses no window. Windows around anchors that
    recur are then compared whole, by 128 bits.
    """
    if window < PERIOD:
        raise ValueError(f"a window has at least {PERIOD} words")
    keyed = docs.select(*row_key(id_column, text_column), F.col(text_column).alias("text"))
    width = window - PERIOD + 1
    anchors = map_batches(keyed, lambda b: anchor_postings(b, width), _POSTING)
    anchored = scratch.write(_repeated_places(anchors))
    hits = scratch.write(keyed.join(anchored, ["k1", "k2"]))
    windows = map_batches(hits, lambda b: window_postings(b, window), _POSTING)
    found = scratch.write(_repeated_places(windows))
    return hits.select("k1", "k2", "text").dropDuplicates(["k1", "k2"]).join(found, ["k1", "k2"])


def _kept(words: Words, t: int, places, settled, window: int) -> np.ndarray:
    n = int(words.counts[t])
    change = np.zeros(n + 1, np.int64)
    starts = _all_places(places, settled)
    change[starts] += 1
    change[starts + window] -= 1
    return np.cumsum(change[:-1]) == 0


def remove_repeats(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = 35, digest: bool = False
) -> DataFrame:
    """Remove every word that a repeated window of `window` words covers.

    A window is repeated if its word sequence begins anywhere else, in the same
    text or another. Words are runs without ASCII blanks. Returns for each row
    the id, n_words, n_removed and `kept`: the words left, joined by one space,
    or with `digest` their SHA-256 as kept_sha256. A null text has no words;
    repeated rows repeat each other's passages; an empty table gives an empty
    result; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession)
    hits = repeated_windows(docs, scratch, id_column, text_column, window)

    def render(body: bytes) -> str:
        return hashlib.sha256(body).hexdigest() if digest else body.decode()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            out: dict = {"k1": batch.column(0), "k2": batch.column(1), "n_removed": [], "kept": []}
            for row, words in text_slices(batch.column(2), lower=False):
                for t in range(words.texts):
                    keep = _kept(words, t, batch.column(3)[row + t].as_py(), batch.column(4)[row + t].as_py(), window)
                    out["n_removed"].append(int((~keep).sum()))
                    out["kept"].append(render(words.text_bytes(t, keep)))
            yield out

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            out: dict = {id_column: batch.column(0), "k1": batch.column(1), "k2": batch.column(2), "n_words": [], "kept": []}
            for _, words in text_slices(batch.column(3), lower=False):
                out["n_words"] += words.counts.tolist()
                out["kept"] += [render(words.text_bytes(t)) for t in range(words.texts)]
            yield out

    kind = docs.schema[id_column].dataType.simpleString()
    uncut = map_batches(
        docs.select(F.col(id_column), *row_key(id_column, text_column), F.col(text_column)),
        whole,
        f"`{id_column}` {kind}, k1 bigint, k2 bigint, n_words bigint, kept string",
    )
    shortened = map_batches(hits, cut, "k1 bigint, k2 bigint, n_removed bigint, kept string")
    shortened = scratch.write(shortened.withColumnRenamed("kept", "shorter"))
    kept: Column = F.coalesce("shorter", "kept")
    return uncut.join(shortened, ["k1", "k2"], "left").select(
        id_column,
        "n_words",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        kept.alias("kept_sha256" if digest else "kept"),
    )
