"""Secrets: exact forms, and a character convolutional network over every other candidate."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallspark.llm.arrow import map_batches

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "learned")

Span = tuple[str, int, int]

_ASSIGN = re.compile(
    r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE
)
_ASSIGN_WORDS = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: What the network judges: unbroken runs of key characters with a digit and a letter.
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
_DIGIT, _LETTER = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]")

_BEFORE, _WITHIN, _AFTER = 24, 48, 8
_WIDTH = _BEFORE + _WITHIN + _AFTER
_EMBEDDED, _FILTERS, _REACH = 8, 24, 5
_SIGNS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-:\"' \n@#$%"


def base_spans(text: str) -> list[Span]:
    """Spans of the exact forms, in order; a match that fails its length is dropped."""
    spans: list[Span] = []
    low = text.lower()
    if any(word in low for word in _ASSIGN_WORDS):
        spans += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m.group(1)) >= 6]
    spans += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates(text: str, base: list[Span]) -> list[tuple[int, int]]:
    """Runs that might be secrets and touch no exact form."""
    found = [m.span() for m in _CANDIDATE.finditer(text)]
    found = [(s, e) for s, e in found if _DIGIT.search(text, s, e) and _LETTER.search(text, s, e)]
    taken = sorted((s, e) for _, s, e in base)
    kept, at, free = [], 0, 0
    for s, e in found:
        while at < len(taken) and taken[at][0] < e:
            free = max(free, taken[at][1])
            at += 1
        if s >= free:
            kept.append((s, e))
    return kept


def _codes() -> np.ndarray:
    table = np.full(256, 1, np.int64)
    for i, c in enumerate(_SIGNS):
        table[ord(c)] = i + 2
    return table


_TABLE = _codes()
_SYMBOLS = len(_SIGNS) + 2


def encoded(text: str, start: int, end: int) -> np.ndarray:
    """Symbols of what stands before, in and after a candidate; a long one by its two ends."""
    within = text[start:end]
    if len(within) > _WITHIN:
        within = within[: _WITHIN // 2] + within[-_WITHIN // 2 :]
    window = text[max(0, start - _BEFORE) : start].rjust(_BEFORE, "\0") + within.ljust(_WITHIN, "\0")
    window += text[end : end + _AFTER].ljust(_AFTER, "\0")
    raw = np.frombuffer(window.encode("latin-1", "replace"), np.uint8)
    return np.where(raw == 0, 0, _TABLE[raw])


def views(text: str, start: int, end: int) -> list[np.ndarray]:
    """What the network sees of a candidate: a long one by its two ends, and all of it window by window."""
    out = [encoded(text, start, end)]
    if end - start > _WITHIN:
        for at in [*range(start, end - _WITHIN, _WITHIN - _REACH + 1), end - _WITHIN]:
            out.append(encoded(text, at, at + _WITHIN))
    return out


@dataclass(frozen=True)
class Network:
    """Embedding, one convolution, largest response inside and outside the candidate, logistic output."""

    embedding: np.ndarray
    filters: np.ndarray
    shift: np.ndarray
    output: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0
    threshold: float = 0.5

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        patches = _patches(self.embedding[x])
        response = np.maximum(patches @ self.filters + self.shift, 0)
        inner, outer = _pools(response.shape[1])
        a, b = response[:, inner], response[:, outer]
        at_a, at_b = inner[a.argmax(1)], outer[b.argmax(1)]
        pooled = np.concatenate([a.max(1), b.max(1), a.mean(1)], axis=1)
        return patches, response, at_a, at_b, pooled, pooled @ self.output + self.bias

    def scores(self, x: np.ndarray) -> np.ndarray:
        parts = [self.forward(x[i : i + 512])[-1] for i in range(0, len(x), 512)]
        logits = np.concatenate(parts) if parts else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.slope * logits + self.offset, -30, 30)))


def _patches(e: np.ndarray) -> np.ndarray:
    view = np.lib.stride_tricks.sliding_window_view(e, _REACH, axis=1)
    return view.transpose(0, 1, 3, 2).reshape(len(e), e.shape[1] - _REACH + 1, _REACH * e.shape[2])


def _pools(positions: int) -> tuple[np.ndarray, np.ndarray]:
    place = np.arange(positions) + _REACH // 2
    inside = (place >= _BEFORE) & (place < _BEFORE + _WITHIN)
    return np.flatnonzero(inside), np.flatnonzero(~inside)


def train(x: np.ndarray, y: np.ndarray, recall: float = 0.98, epochs: int = 8, seed: int = 5) -> Network:
    """Fit by Adam on three quarters of the findings; calibrate on the rest.

    The threshold is the highest calibrated score that still finds the share
    `recall` of the true findings held for calibration.
    """
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    x, y = x[order], y[order].astype(float)
    held = np.arange(len(x)) % 4 == 0
    values = {
        "embedding": rng.normal(0, 0.3, (_SYMBOLS, _EMBEDDED)),
        "filters": rng.normal(0, 0.2, (_REACH * _EMBEDDED, _FILTERS)),
        "shift": np.zeros(_FILTERS),
        "output": rng.normal(0, 0.2, 3 * _FILTERS),
        "bias": np.zeros(1),
    }
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in values.items()}
    xs, ys = x[~held], y[~held]
    step = 0
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(len(xs)), max(1, len(xs) // 128)):
            step += 1
            for k, gradient in _gradients(values, xs[at], ys[at]).items():
                m, v = moments[k]
                m += 0.1 * (gradient - m)
                v += 0.01 * (gradient**2 - v)
                values[k] -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    net = Network(**{k: v for k, v in values.items() if k != "bias"}, bias=float(values["bias"][0]))
    logits = np.concatenate([net.forward(x[held][i : i + 512])[-1] for i in range(0, int(held.sum()), 512)] or [np.zeros(0)])
    slope, offset = _calibrate(logits, y[held])
    net = Network(net.embedding, net.filters, net.shift, net.output, net.bias, slope, offset)
    true = net.scores(x[held][y[held] > 0])
    threshold = float(np.quantile(true, 1 - recall, method="lower")) if len(true) else 1.1
    return Network(net.embedding, net.filters, net.shift, net.output, net.bias, slope, offset, threshold)


def _gradients(values: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    net = Network(**{k: v for k, v in values.items() if k != "bias"}, bias=float(values["bias"][0]))
    patches, response, at_a, at_b, pooled, logits = net.forward(x)
    error = (1 / (1 + np.exp(-np.clip(logits, -30, 30))) - y) / len(y)
    rows, columns = np.arange(len(x))[:, None], np.arange(_FILTERS)[None, :]
    to_pool = error[:, None] * net.output[None, :]
    to_response = np.zeros_like(response)
    inner, _ = _pools(response.shape[1])
    to_response[:, inner] += to_pool[:, None, 2 * _FILTERS :] / len(inner)
    to_response[rows, at_a, columns] += to_pool[:, :_FILTERS]
    to_response[rows, at_b, columns] += to_pool[:, _FILTERS : 2 * _FILTERS]
    to_response *= response > 0
    flat = to_response.reshape(-1, _FILTERS)
    to_patches = (flat @ net.filters.T).reshape(*response.shape[:2], _REACH, _EMBEDDED)
    to_embedded = np.zeros((*x.shape, _EMBEDDED))
    for k in range(_REACH):
        to_embedded[:, k : k + response.shape[1]] += to_patches[:, :, k]
    embedding = np.zeros_like(net.embedding)
    np.add.at(embedding, x, to_embedded)
    return {
        "embedding": embedding,
        "filters": patches.reshape(-1, patches.shape[2]).T @ flat,
        "shift": flat.sum(0),
        "output": pooled.T @ error + 1e-4 * net.output,
        "bias": np.array([error.sum()]),
    }


def _calibrate(logits: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic fit of smoothed labels on the network's output."""
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, w = np.c_[np.clip(logits, -30, 30), np.ones(len(y))], np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 1e-3 * np.eye(2)
        w = w - np.linalg.solve(hessian, x.T @ (p - target) + 1e-3 * (w - np.array([1.0, 0.0])))
    return float(np.clip(w[0], 0.05, 5)), float(w[1])


# How common credentials begin; the rest of each is drawn at random.
_FORMS = (
    ("sk_live_", "alnum", 24),
    ("sk-", "alnum", 48),
    ("ghp_", "alnum", 36),
    ("xoxb-", "digits-alnum", 40),
    ("AIza", "alnum_-", 35),
    ("eyJ", "alnum.", 90),
    ("glpat-", "alnum", 20),
    ("npm_", "alnum", 36),
    ("", "alnum+/=", 40),
    ("", "alnum", 32),
)
#: Candidates that begin like a credential and are as long: nobody says that they are clean.
_CREDENTIAL = re.compile(
    r"(?:[a-z]k_(?:live|test)_|sk-|gh[opsur]_|github_pat_|xox[a-z]-|AIza|eyJ|glpat-|npm_)[A-Za-z0-9+/_.=-]{16,}", re.ASCII
)
_LEADS = ("key: ", "Authorization: Bearer ", "credential = ", "auth=", "PRIVATE_KEY=", "access: ", "export KEY=", "")


def _drawn(rng: np.random.Generator) -> str:
    prefix, kind, n = _FORMS[rng.integers(len(_FORMS))]
    signs = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789" + "".join(c for c in kind if c in "_-+/.")
    return prefix + "".join(signs[i] for i in rng.integers(0, len(signs), n))


def findings(texts: list[str], drawn: int = 1500, most: int = 4000, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Labelled findings of some texts.

    True: what the exact forms find, and credentials of common forms put at
    random places of the texts. False: all other candidates but those that have a
    credential's form, and stretches of joined ordinary words and numbers.
    """
    rng = np.random.default_rng(seed)
    x, y = [], []
    for text in texts:
        base = base_spans(text)
        for kind, s, e in base:
            if kind == "assign":
                s = _ASSIGN.match(text, s).start(1)
            x.append(encoded(text, s, e))
            y.append(1)
        for s, e in candidates(text, base):
            if not _CREDENTIAL.search(text, s, e):
                seen = views(text, s, e)
                x += seen
                y += [0] * len(seen)
    plain = [t for t in texts if t] or [" "]
    for _ in range(drawn):
        text = plain[rng.integers(len(plain))]
        at = int(rng.integers(0, len(text) + 1))
        secret, lead = _drawn(rng), _LEADS[rng.integers(len(_LEADS))]
        made = f"{text[max(0, at - 40) : at]} {lead}{secret} {text[at : at + 20]}"
        s = made.index(lead + secret) + len(lead)
        x.append(encoded(made, s, s + len(secret)))
        y.append(1)
        words = text[max(0, at - 400) : at + 400].split()
        if len(words) >= 3:
            i = int(rng.integers(0, len(words) - 2))
            joint = str(rng.choice(["-", "_", ".", "/", ""])).join([*words[i : i + 2], str(rng.integers(1, 10 ** int(rng.integers(1, 9))))])
            made = f"{text[max(0, at - 40) : at]} {joint} {text[at : at + 20]}"
            s = made.index(joint)
            x.append(encoded(made, s, s + len(joint)))
            y.append(0)
    x, y = np.array(x).reshape(-1, _WIDTH), np.array(y)
    kept = [rng.permutation(np.flatnonzero(y == label))[:most] for label in (0, 1)]
    kept = np.sort(np.concatenate(kept)) if len(y) else np.zeros(0, int)
    return x[kept], y[kept]


def fit(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rows: int = 4000, longest: int = 6000
) -> Network:
    """Learn from the findings of a bounded sample: about `rows` ids drawn by a hash, and never more
    texts than that, of up to `longest` characters. Null ids and texts take no part."""
    share = min(1.0, rows / max(1, docs.count()))
    drawn = F.pmod(F.xxhash64(F.lit(13), id_column), F.lit(1 << 30)) < int(share * (1 << 30))
    texts = docs.filter(F.col(id_column).isNotNull() & drawn & F.length(text_column).between(1, longest))
    sample = [r[0] for r in texts.select(text_column).limit(rows).collect()]
    return train(*findings(sorted(sample, key=lambda t: hashlib.md5(t.encode()).digest())))


def find(text: str, network: Network) -> list[Span]:
    return find_all([text], network)[0]


def find_all(texts: list[str], network: Network) -> list[list[Span]]:
    """Exact forms of each text, and the candidates that the network takes for secrets."""
    base = [base_spans(t) for t in texts]
    others = [candidates(t, b) for t, b in zip(texts, base, strict=True)]
    seen = [views(t, s, e) for t, spans in zip(texts, others, strict=True) for s, e in spans]
    scores = network.scores(np.array([v for own in seen for v in own]).reshape(-1, _WIDTH).astype(np.int64))
    # a candidate is as suspicious as the worst of its views
    first = np.cumsum([0, *map(len, seen)])[:-1]
    scores = iter(np.maximum.reduceat(scores, first) if len(seen) else [])
    out = []
    for found, spans in zip(base, others, strict=True):
        learned = [("learned", s, e) for s, e in spans if next(scores) >= network.threshold]
        out.append(sorted(found + learned, key=lambda s: (s[1], KINDS.index(s[0]))))
    return out


def find_secrets(docs: DataFrame, network: Network, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Spans of secrets of every whole text: the id and spans (kind, start, end), in code points.

    A null or empty text has none. Rows are treated alone: repeated rows give
    repeated results, an empty table an empty one, other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(network)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                rows = batch.slice(at, 256)
                found = find_all([t or "" for t in rows.column(1).to_pylist()], sent.value)
                yield {
                    id_column: rows.column(0),
                    "spans": [[{"kind": k, "start": s, "end": e} for k, s, e in spans] for spans in found],
                }

    kind = docs.schema[id_column].dataType.simpleString()
    ddl = f"`{id_column}` {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>"
    return map_batches(docs.select(id_column, text_column), kernel, ddl)
