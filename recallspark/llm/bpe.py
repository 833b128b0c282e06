"""Byte-level BPE: encoding by a segment tree over byte positions, and decoding."""

from __future__ import annotations

import base64
import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from recallspark.llm.arrow import map_batches

_NONE = 1 << 62
_SHIFT = 32
_LATIN = 0x250
_SLICE_TOKENS = 100_000
_LONGEST = 64


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file of base64 tokens and ranks; its size is fixed by the tokenizer."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece.

    A leaf of the tree holds the rank of the pair that begins at its byte and
    the byte's position, so the root is the leftmost pair of least rank. A
    merge changes three leaves: the merged one, its live left neighbour and the
    swallowed one.
    """
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    size = 1 << (n - 1).bit_length()
    tree = [_NONE] * (2 * size)
    end = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    for i in range(n - 1):
        rank = ranks.get(piece[i : i + 2])
        if rank is not None:
            tree[size + i] = rank << _SHIFT | i
    for node in range(size - 1, 0, -1):
        a, b = tree[2 * node], tree[2 * node + 1]
        tree[node] = a if a < b else b

    def put(i: int, key: int) -> None:
        node = size + i
        tree[node] = key
        node >>= 1
        while node:
            a, b = tree[2 * node], tree[2 * node + 1]
            least = a if a < b else b
            if tree[node] == least:
                return
            tree[node] = least
            node >>= 1

    while (least := tree[1]) < _NONE:
        i = least & ((1 << _SHIFT) - 1)
        j = end[i]
        stop = end[j]
        end[i] = stop
        put(j, _NONE)
        if stop < n:
            before[stop] = i
            rank = ranks.get(piece[i : end[stop]])
            put(i, _NONE if rank is None else rank << _SHIFT | i)
        else:
            put(i, _NONE)
        h = before[i]
        if h >= 0:
            rank = ranks.get(piece[h:stop])
            put(h, _NONE if rank is None else rank << _SHIFT | h)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


def _class(kind: str) -> str:
    return "".join(
        f"\\u{c:04x}" for c in range(_LATIN) if unicodedata.category(chr(c))[0] == kind
    )


def splitter(pattern: str) -> Callable[[str], Iterator[str]]:
    """All matches of a tokenizer's pattern, in turn.

    Texts of Latin characters alone go through the standard engine, with the
    pattern's classes spelled out for that range; all others through `regex`.
    """
    import regex

    spaces = "\\t-\\r \\x85\\xa0"
    letters, numbers = _class("L"), _class("N")
    latin = (
        pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{spaces}{letters}{numbers}]")
        .replace(r"\p{L}", f"[{letters}]")
        .replace(r"\p{N}", f"[{numbers}]")
        .replace(r"\S", f"[^{spaces}]")
        .replace(r"\s", f"[{spaces}]")
    )
    general = regex.compile(pattern)
    if "\\p" in latin:
        return lambda text: (m.group() for m in general.finditer(text))
    fast, wide = re.compile(latin), re.compile(f"[^\\x00-\\u{_LATIN - 1:04x}]")

    def split(text: str) -> Iterator[str]:
        engine = general if wide.search(text) else fast
        if len(text) < 1 << 20:
            return iter(engine.findall(text))
        return (m.group() for m in engine.finditer(text))

    return split


class Pairs:
    """Ids of byte values, and the id that each mergeable pair of ids becomes."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        found = [
            (ranks[t[:i]] << 32 | ranks[t[i:]], r)
            for t, r in ranks.items()
            for i in range(1, len(t))
            if t[:i] in ranks and t[i:] in ranks
        ]
        self.keys, self.merged = (np.array(x, np.int64) for x in zip(*sorted(found), strict=True))

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.merged[at], _NONE >> _SHIFT)


def merge_many(pieces: list[bytes], pairs: Pairs) -> tuple[np.ndarray, np.ndarray]:
    """Ids of many pieces in order of their length, one after another, and the number of each.

    As `merge`; short pieces go many at a time: one tree a row, one merge a row and step.
    """
    parts, counts, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for size in (1 << k for k in range(_LONGEST.bit_length())):
        end = bisect_right(pieces, size, key=len)
        if end > at:
            flat, n = _merge_rows(pieces[at:end], size, pairs)
            parts.append(flat)
            counts.append(n)
        at = end
    for piece in pieces[at:]:
        parts.append(np.array(merge(piece, pairs.ranks), np.int64))
        counts.append(np.array([len(parts[-1])]))
    return np.concatenate(parts), np.concatenate(counts)


def _merge_rows(pieces: list[bytes], size: int, pairs: Pairs) -> tuple[np.ndarray, np.ndarray]:
    rows = len(pieces)
    lengths = np.array([len(p) for p in pieces])
    body = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(rows, size)
    ids = np.concatenate([pairs.of_byte[body], np.zeros((rows, 1), np.int64)], axis=1)
    place = np.arange(size)
    after = np.broadcast_to(place + 1, (rows, size)).copy()
    before = np.broadcast_to(np.arange(size + 1) - 1, (rows, size + 1)).copy()
    live = np.broadcast_to(place, (rows, size)) < lengths[:, None]
    tree = np.full((rows, 2 * size), _NONE, np.int64)
    if size > 1:
        first = pairs(ids[:, : size - 1], ids[:, 1:size]) << _SHIFT | place[:-1]
        tree[:, size:-1] = np.where(live[:, 1:], first, _NONE)
    for node in range(size - 1, 0, -1):
        tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])

    def put(r: np.ndarray, leaf: np.ndarray, key: np.ndarray | int) -> None:
        node = leaf + size
        tree[r, node] = key
        while len(node) and node[0] > 1:
            node = node >> 1
            tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])

    r = np.flatnonzero(tree[:, 1] < _NONE)
    while len(r):
        least = tree[r, 1]
        i = least & ((1 << _SHIFT) - 1)
        j = after[r, i]
        stop = after[r, j]
        ids[r, i] = least >> _SHIFT
        after[r, i] = stop
        before[r, stop] = i
        live[r, j] = False
        put(r, j, _NONE)
        inner = stop < lengths[r]
        key = np.where(inner, pairs(ids[r, i], ids[r, stop]) << _SHIFT | i, _NONE)
        put(r, i, np.minimum(key, _NONE))
        h = before[r, i]
        left = h >= 0
        r2, h = r[left], h[left]
        put(r2, h, np.minimum(pairs(ids[r2, h], ids[r2, i[left]]) << _SHIFT | h, _NONE))
        r = r[tree[r, 1] < _NONE]
    return ids[:, :size][live], live.sum(axis=1)


def _gather(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ranges pool[start : start + length] one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return pool[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


class _Pool:
    """One byte string for each id."""

    def __init__(self, strings: list[bytes]) -> None:
        self.lengths = np.array([len(s) for s in strings], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.body = np.frombuffer(b"".join(strings), np.uint8)

    def __call__(self, ids: np.ndarray) -> bytes:
        return _gather(self.body, self.starts[ids], self.lengths[ids]).tobytes()


class Encoder:
    """Encodes and decodes texts; remembers the ids of short pieces, up to a fixed number of pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, remembered: int = 1 << 18) -> None:
        self.split, self.remembered, self.pairs = splitter(pattern), remembered, Pairs(ranks)
        strings = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            strings[i] = token
        self.tokens = _Pool(strings)
        self.decimals = _Pool([b"%d," % i for i in range(len(strings))])
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.int64)
        self.starts = np.zeros(1, np.int64)
        self.used = 0

    def _learn(self, pieces: set[str]) -> None:
        new = [p for p in pieces if p not in self.known]
        if not new:
            return
        if len(self.known) + len(new) > self.remembered:
            self._forget()
            new = list(pieces)
        raw = sorted(((p.encode("utf-8", "replace"), p) for p in new), key=lambda pair: len(pair[0]))
        added, counts = merge_many([r for r, _ in raw], self.pairs)
        if self.used + len(added) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(self.used + len(added), np.int64)])
        self.flat[self.used : self.used + len(added)] = added
        ends = self.used + np.cumsum(counts)
        self.starts = np.concatenate([self.starts, ends])
        self.used += len(added)
        self.known.update(zip([p for _, p in raw], range(len(self.known), len(self.known) + len(new)), strict=True))

    def _ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        self._learn(set(pieces))
        at = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
        counts = self.starts[at + 1] - self.starts[at]
        return _gather(self.flat, self.starts[at], counts), counts

    def encode(self, texts: Iterable[str]) -> Iterator[tuple[int, np.ndarray]]:
        """Slices of ids with the number of their text, in order; a text without tokens has no slice."""
        held: list[str] = []
        bounds: list[tuple[int, int]] = []

        def flush() -> Iterator[tuple[int, np.ndarray]]:
            ids, counts = self._ids(held)
            ends = np.concatenate([[0], np.cumsum(counts)])
            for (text, a), b in zip(bounds, [a for _, a in bounds[1:]] + [len(held)], strict=True):
                yield text, ids[ends[a] : ends[b]]

        for number, text in enumerate(texts):
            pieces = self.split(text)
            while slice_ := list(islice(pieces, _SLICE_TOKENS)):
                bounds.append((number, len(held)))
                held += slice_
                if len(held) >= _SLICE_TOKENS:
                    yield from flush()
                    held, bounds = [], []
        if held:
            yield from flush()


def _texts(column: pa.Array) -> Iterator[str]:
    return (text.as_py() or "" for text in column)


def encode_texts(
    docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Encode every whole text: the id, n_tokens, ids, and exact (whether the decoded ids are the text).

    A null or empty text has no tokens. Rows are treated alone: repeated rows
    give repeated results, an empty table an empty result, other columns are
    not read. A lone surrogate is encoded as a question mark.
    """
    sent = docs.sparkSession.sparkContext.broadcast(ranks)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        encoder = Encoder(sent.value, pattern)
        for batch in batches:
            for at in range(0, len(batch), 512):
                rows = batch.slice(at, 512)
                texts = list(_texts(rows.column(1)))
                ids: list[list[np.ndarray]] = [[] for _ in texts]
                for text, part in encoder.encode(texts):
                    ids[text].append(part)
                whole = [np.concatenate(p) if p else np.zeros(0, np.int64) for p in ids]
                yield {
                    id_column: rows.column(0),
                    "n_tokens": [len(p) for p in whole],
                    "ids": whole,
                    "exact": [encoder.tokens(p) == t.encode() for p, t in zip(whole, texts, strict=True)],
                }

    kind = docs.schema[id_column].dataType.simpleString()
    return map_batches(
        docs.select(id_column, text_column), kernel, f"`{id_column}` {kind}, n_tokens bigint, ids array<int>, exact boolean"
    )


def decode_ids(encoded: DataFrame, ranks: dict[bytes, int], id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """The bytes that the ids of each row stand for: the id and decoded.

    Null or empty ids decode to nothing, a null among them is left out; an
    unknown id is an error. Rows are treated alone.
    """
    sent = encoded.sparkSession.sparkContext.broadcast(ranks)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        tokens = {i: t for t, i in sent.value.items()}
        for batch in batches:
            decoded = [b"".join(tokens[i] for i in ids.as_py() or () if i is not None) for ids in batch.column(1)]
            yield {id_column: batch.column(0), "decoded": decoded}

    kind = encoded.schema[id_column].dataType.simpleString()
    return map_batches(encoded.select(id_column, ids_column), kernel, f"`{id_column}` {kind}, decoded binary")


def encode_digests(
    docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """As `encode_texts`, with SHA-256 of the joined ids and of the decoded bytes in their place.

    The digests are taken slice by slice, so a very long text is never held as ids.
    """
    sent = docs.sparkSession.sparkContext.broadcast(ranks)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        encoder = Encoder(sent.value, pattern)
        for batch in batches:
            digests = [[hashlib.sha256(), hashlib.sha256(), 0] for _ in range(len(batch))]
            for text, ids in encoder.encode(_texts(batch.column(1))):
                own = digests[text]
                own[0].update((b"," if own[2] else b"") + encoder.decimals(ids)[:-1])
                own[1].update(encoder.tokens(ids))
                own[2] += len(ids)
            yield {
                id_column: batch.column(0),
                "n_tokens": [n for _, _, n in digests],
                "ids_sha256": [a.hexdigest() for a, _, _ in digests],
                "decoded_sha256": [b.hexdigest() for _, b, _ in digests],
            }

    kind = docs.schema[id_column].dataType.simpleString()
    ddl = f"`{id_column}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return map_batches(docs.select(id_column, text_column), kernel, ddl)
