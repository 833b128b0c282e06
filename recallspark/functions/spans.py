"""Replacing many spans of a text, and putting them back, in time that grows with the text.

Small helpers on one text, with Python's string rules. A replacement is stated as a
sequence of literal ones, each on the result of the one before; the helpers give what the
sequence gives without going through the whole text for each of its steps.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from functools import cached_property

_URL = re.compile(r"https?://\S+")
_RUN = re.compile(r"\S+")
_LINK_KINDS = ("URL", "EMAIL")

Entry = tuple[str, str]


def _is_address(run: str) -> bool:
    """Whether a run of non-blank characters holds an "@" after its start and a dot inside what follows."""
    at = run.find("@", 1)
    return at > 0 and run.find(".", at + 2, len(run) - 1) > 0


def find_links(text: str, kind: str) -> list[tuple[int, int]]:
    """Spans of the links of a kind. An address always fills a whole run of non-blank characters."""
    if kind == "URL":
        return [m.span() for m in _URL.finditer(text)] if "://" in text else []
    return [m.span() for m in _RUN.finditer(text) if _is_address(m[0])] if "@" in text else []


def _inside(link: str, known: dict[str, int], lengths: Sequence[int], kind: str) -> list[str]:
    """Other known links that are part of this one."""
    starts = [m.start() for m in re.finditer("https?://", link)] if kind == "URL" else range(len(link))
    shorter = [n for n in lengths if n < len(link)]
    return list({link[s : s + n] for n in shorter for s in starts if s + n <= len(link) and link[s : s + n] in known})


def replace_links(text: str, kind: str, strict: bool = False) -> tuple[str, list[Entry]]:
    """Links replaced by numbered placeholders, and (placeholder, link) for every one of them.

    Every match uses a number; equal links show that of the first. As a sequence of
    literal replacements, an earlier link that is part of a later one is replaced
    inside it and leaves its rest to be read; `strict` replaces every link whole.
    """
    spans = find_links(text, kind)
    if not spans:
        return text, []
    links = [text[s:e] for s, e in spans]
    entries = [(f"[{kind}_{i}]", link) for i, link in enumerate(links, 1)]
    first: dict[str, int] = {}
    for i, link in enumerate(links):
        first.setdefault(link, i)
    if not strict and any(f"[{kind}_" in link for link in first):
        # A link that spells a placeholder may be met again: only the sequence itself tells.
        for placeholder, link in entries:
            text = text.replace(link, placeholder)
        return text, entries
    lengths = sorted({len(link) for link in first})
    shown: dict[str, str] = {}
    for link in first:
        shown[link] = entries[first[link]][0]
        if not strict and len(lengths) > 1:
            rest = link
            for part in sorted([link, *_inside(link, first, lengths, kind)], key=first.__getitem__):
                rest = rest.replace(part, entries[first[part]][0])
            shown[link] = rest
    pieces, at = [], 0
    for (start, end), link in zip(spans, links):
        pieces += [text[at:start], shown[link]]
        at = end
    return "".join([*pieces, text[at:]]), entries


def settle(entries: Iterable[Entry]) -> list[Entry]:
    """One entry per placeholder: the last real value, at the place of the first."""
    return list(dict(entries).items())


class _Keys:
    """Placeholders of one length with their real values. What is asked of all of them is worked out once."""

    def __init__(self, length: int) -> None:
        self.length, self.values = length, dict[str, str]()

    @cached_property
    def firsts(self) -> set[str]:
        return {key[0] for key in self.values}

    @cached_property
    def can_overlap(self) -> bool:
        ends = {key[self.length - n :] for key in self.values for n in range(1, self.length)}
        return any(key[:n] in ends for key in self.values for n in range(1, self.length))

    def occurrences(self, text: str) -> Iterator[int]:
        for first in self.firsts:
            at = text.find(first)
            while at >= 0:
                if text[at : at + self.length] in self.values:
                    yield at
                at = text.find(first, at + 1)

    def replace(self, text: str) -> str:
        """The keys replaced one after the other."""
        found = sorted(self.occurrences(text))
        if not found:
            return text
        if not self.can_overlap:
            pieces, at = [], 0
            for start in found:
                pieces += [text[at:start], self.values[text[start : start + self.length]]]
                at = start + self.length
            done = "".join([*pieces, text[at:]])
            # What was put in may spell another key; then the order counts.
            if next(self.occurrences(done), None) is None:
                return done
        for key, value in self.values.items():
            text = text.replace(key, value)
        return text


class Values:
    """The entries of a mapping, kept for any number of texts."""

    def __init__(self, entries: Iterable[Entry]) -> None:
        by_length: dict[int, _Keys] = {}
        for placeholder, value in entries:
            length = len(placeholder)
            if length:
                by_length.setdefault(length, _Keys(length)).values.setdefault(placeholder, value)
        self.keys = [by_length[length] for length in sorted(by_length, reverse=True)]

    def restore(self, text: str) -> str:
        for keys in self.keys:
            text = keys.replace(text)
        return text


def restore(text: str, entries: Iterable[Entry]) -> str:
    """Real values for placeholders, long placeholders first, ties in the order of the entries."""
    return Values(entries).restore(text)


class Numbers:
    """Placeholders that stand for one value each in all texts they are given out for."""

    def __init__(self, prefixes: dict[str, str]) -> None:
        self.prefixes = prefixes
        self.given: dict[tuple[str, str], str] = {}
        self.last = dict.fromkeys([*prefixes, *_LINK_KINDS], 0)

    def of(self, label: str, value: str) -> str:
        key = (label, value)
        if key not in self.given:
            self.last[label] += 1
            number = self.last[label]
            self.given[key] = f"[{label}_{number}]" if label in _LINK_KINDS else f"{self.prefixes[label]}_{number}"
        return self.given[key]

    def replace(self, text: str, entities: Iterable[tuple[str, str]], covered: set[str]) -> tuple[str, list[Entry]]:
        """Entities (value, label) and then links, whole ones only, replaced in a text."""
        entries = []
        for value, label in entities:
            if value not in covered and value in text:
                placeholder = self.of(label, value)
                text = text.replace(value, placeholder)
                entries.append((placeholder, value))
        for kind in _LINK_KINDS:
            pieces, at = [], 0
            for start, end in find_links(text, kind):
                entries.append((self.of(kind, text[start:end]), text[start:end]))
                pieces += [text[at:start], entries[-1][0]]
                at = end
            text = "".join([*pieces, text[at:]])
        return text, settle(entries)
