"""Personal data: an Aho-Corasick pass finds anchors, local parsers expand and validate them."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from recallspark.llm.arrow import map_batches, rewrite_batches

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("login", "iban", "account", "ssn", "number")
KINDS = BASE_KINDS + ADDED_KINDS

Span = tuple[str, int, int]

# What announces an identifier, and the kind that follows it.
_CUES = {
    "iban": "iban",
    "account": "account",
    "acct": "account",
    "konto": "account",
    "cuenta": "account",
    "compte": "account",
    "ssn": "ssn",
    "social security": "ssn",
    "tel:": "number",
    "phone": "number",
    "telefon": "number",
    "téléphone": "number",
    "teléfono": "number",
}
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_USER = re.compile(r"[^\s/@<>\"']{1,256}@(?:[A-Za-z0-9-]+\.)*[A-Za-z0-9-]+")
_LEAD = re.compile(r"(?:[\s:#.=-]|no\b|nr\b|num(?:ber|mer)?\b|is\b){0,12}", re.ASCII | re.IGNORECASE)
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_ACCOUNT = re.compile(r"[0-9](?:[ -]?[0-9]){5,19}(?![0-9A-Za-z])")
_SSN = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_NUMBER = re.compile(r"\(?[0-9](?:[ ().-]{0,2}[0-9]){6,14}(?![0-9])")


@lru_cache(maxsize=1)
def _anchors():
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for sign in ("@", "+", "://"):
        automaton.add_word(sign, (sign, len(sign)))
    for cue in _CUES:
        automaton.add_word(cue, (cue, len(cue)))
    automaton.make_automaton()
    return automaton


def _folded(text: str) -> str:
    """The text in lower case, one code point for one."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) > 1 else c.lower() for c in text)


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _iban(text: str) -> bool:
    packed = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in packed[4:] + packed[:4])) % 97 == 1


def _ssn(text: str) -> bool:
    area, group, serial = text.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


# What a cue of each kind is followed by, and what makes it valid.
_AFTER_CUE: dict[str, tuple[re.Pattern, Callable[[str], bool]]] = {
    "iban": (_IBAN, _iban),
    "account": (_ACCOUNT, lambda text: True),
    "ssn": (_SSN, _ssn),
    "number": (_NUMBER, lambda text: 7 <= len(_digits(text)) <= 15),
}


def find(text: str) -> list[Span]:
    """All spans of a text by start, then kind; ends are exclusive, in code points.

    Base kinds may overlap one another; an added span never overlaps another span.
    """
    base: list[Span] = []
    added: list[Span] = []
    email_end = phone_end = 0
    for last, (sign, width) in _anchors().iter(_folded(text)):
        after, first = last + 1, last + 1 - width
        if sign == "@":
            start = first
            while start > email_end and text[start - 1] in _LOCAL:
                start -= 1
            if start < first and (domain := _DOMAIN.match(text, after)):
                email_end = domain.end()
                base.append(("email", start, email_end))
        elif sign == "+":
            if first >= phone_end and (m := _PHONE.match(text, first)):
                phone_end = m.end()
                if 10 <= len(_digits(m.group())) <= 15:
                    base.append(("phone", first, phone_end))
        elif sign == "://":
            if m := _USER.match(text, after):
                added.append(("login", after, m.end()))
        else:
            kind = _CUES[sign]
            form, valid = _AFTER_CUE[kind]
            if (m := form.match(text, _LEAD.match(text, after).end())) and valid(m.group()):
                added.append((kind, m.start(), m.end()))
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m.group().split(".")):
            base.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := _digits(m.group())) <= 19 and luhn(digits):
            base.append(("card", m.start(), m.end()))
    return _ordered(base + _apart(base, added))


def _ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda span: (span[1], KINDS.index(span[0]), span[2]))


def _apart(base: list[Span], added: list[Span]) -> list[Span]:
    """Added spans that touch no base span and no added span before them."""
    taken = sorted((s, e) for _, s, e in base)
    kept, at, free = [], 0, 0
    for span in _ordered(added):
        _, start, end = span
        while at < len(taken) and taken[at][0] < end:
            free = max(free, taken[at][1])
            at += 1
        if start >= free:
            kept.append(span)
            free = end
    return kept


def mask(text: str, spans: list[Span]) -> str:
    """The text with each run of overlapping spans replaced by the kind of its first one."""
    pieces, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            pieces += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*pieces, text[at:]])


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def find_pii(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Spans of personal data of every whole text: the id and spans (kind, start, end).

    A null or empty text has none. Rows are treated alone: repeated rows give
    repeated results, an empty table an empty one, other columns are not read.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            found = [find(text.as_py() or "") for text in batch.column(1)]
            yield {
                id_column: batch.column(0),
                "spans": [[{"kind": k, "start": s, "end": e} for k, s, e in spans] for spans in found],
            }

    kind = docs.schema[id_column].dataType.simpleString()
    ddl = f"`{id_column}` {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>"
    return map_batches(docs.select(id_column, text_column), kernel, ddl)


def mask_pii(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """The same rows with personal data in the text replaced by the name of its kind.

    A null text stays null, a text without findings stays as it is.
    """
    at = docs.columns.index(text_column)

    def change(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t if t is None else mask(t, find(t)) for t in (x.as_py() for x in batch.column(at))]
        return batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return rewrite_batches(docs, change)
