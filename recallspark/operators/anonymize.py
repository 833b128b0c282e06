"""Reversible placeholders for names, places, links and addresses.

A text goes through three steps, each on the result of the one before:
dictionary keys from long to short, recognised entities, links. The mapping
back, placeholder -> real value, stays on the row as an ordered array.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from recallspark.functions import spans
from recallspark.functions.models import loaded, name_of
from recallspark.runtime import array_slices
from recallspark.schemas import MAPPING_ENTRY, RECOGNISED
from recallspark.settings import DEFAULTS, Settings

# Recognised labels and the prefixes of their placeholders.
LABELS = {"PER": "Person", "ORG": "Organization", "LOC": "Location"}

_KNOWN_ENTITIES = 1 << 16  # answers that a process remembers
_KNOWN_WORDS = 1 << 15  # words of whose phrases a process makes Python objects
_ROWS_AT_ONCE = 500  # texts or lists of which a process makes Python objects at a time

_ENTRIES = f"array<{MAPPING_ENTRY.simpleString()}>"


class Recogniser(Protocol):
    def __call__(self, texts: DataFrame, text: str, out: str) -> DataFrame:
        """Add `out`: array of (text, label, score) in order of appearance."""


class Gazetteer:
    """Recogniser over a table of known names (`text`, `label`).

    Native and deterministic; stands where a model can be plugged in.
    """

    def __init__(self, names: DataFrame, settings: Settings = DEFAULTS) -> None:
        item = F.struct("text", "label")
        self._slices = array_slices(
            names, [F.col("text"), F.col("label")], item, settings.dictionary_slice
        )

    def __call__(self, texts: DataFrame, text: str, out: str) -> DataFrame:
        df = texts.withColumn("_hits", F.array().cast("array<struct<at:int,text:string,label:string>>"))
        for names in self._slices:
            found = F.transform(
                F.filter("_names", lambda n: F.contains(F.col(text), n["text"])),
                lambda n: F.struct(
                    F.position(n["text"], F.col(text)).alias("at"),
                    n["text"].alias("text"),
                    n["label"].alias("label"),
                ),
            )
            df = df.withColumn("_names", names).withColumn("_hits", F.concat("_hits", found))
        entities = F.transform(
            F.array_sort("_hits"),
            lambda h: F.struct(h["text"].alias("text"), h["label"].alias("label"), F.lit(1.0).alias("score")),
        )
        return df.withColumn(out, entities.cast(RECOGNISED)).drop("_hits", "_names")


class PhraseRecogniser:
    """Recogniser over a table of phrases (`text`, `label`) that finds them as whole words.

    A word is a run of letters, digits and underscores. Phrases are kept by their first
    word, so a text costs its words and the phrases that begin with one of them, however
    many there are. `phrases_per_pass` of them at most go to the workers at once; a
    larger table takes several passes with the same result. A worker holds a table as
    columns and makes Python objects only of the phrases that some texts at a time may hold.
    """

    def __init__(self, phrases: DataFrame, settings: Settings = DEFAULTS) -> None:
        kept = phrases.select("text", "label").filter(F.col("text").rlike(r"(?U)\w")).distinct()
        n = kept.count()
        passes = max(1, -(-n // settings.phrases_per_pass))
        number = F.pmod(F.xxhash64("text", "label"), F.lit(passes))
        self._spark = phrases.sparkSession
        self._tables = [kept.filter(number == i).toArrow() for i in range(passes)]

    def __call__(self, texts: DataFrame, text: str, out: str) -> DataFrame:
        df, parts = texts, []
        for i, table in enumerate(self._tables):
            df = df.withColumn(f"_part{i}", self._finder(table)(F.col(text)))
            parts.append(F.col(f"_part{i}"))
        hits = F.array_sort(F.concat(*parts))
        entities = F.transform(hits, lambda h: F.struct(h["text"].alias("text"), h["label"].alias("label"), F.lit(1.0).alias("score")))
        return df.withColumn(out, entities.cast(RECOGNISED)).drop(*[f"_part{i}" for i in range(len(parts))])

    def _finder(self, table: pa.Table) -> Callable[[Column], Column]:
        shared = self._spark.sparkContext.broadcast(tuple(table.column(c).cast(pa.large_string()).combine_chunks() for c in ("text", "label")))
        name = f"phrases-{uuid.uuid4().hex}"

        def load() -> tuple[np.ndarray, np.ndarray, np.ndarray, dict]:
            """Hashes of first words, in order; the phrases they are of; what stands before the first word of each phrase; words asked for."""
            texts = _column(shared.value[0])
            hashes, leads = np.empty(len(texts), np.int64), np.empty(len(texts), np.int32)
            for low in range(0, len(texts), _ROWS_AT_ONCE):
                for i, phrase in enumerate(texts.slice(low, _ROWS_AT_ONCE).to_pylist(), low):
                    first = _WORD.search(phrase)
                    hashes[i], leads[i] = hash(first[0]), first.start()
            order = np.argsort(hashes, kind="stable")
            return hashes[order], order, leads, {}

        kind = _arrow_type("array<struct<at: int, text: string, label: string>>")

        def search(bodies: list[str | None], held: tuple[np.ndarray, np.ndarray, np.ndarray, dict]) -> pa.Array:
            hashes, order, leads, near = held
            texts, labels = map(_column, shared.value)

            def phrases_of(word: str) -> list[tuple[int, int, str]]:
                # Words of one hash share their phrases: what does not stand in the text is no hit.
                low, high = hashes.searchsorted(hash(word)), hashes.searchsorted(hash(word), "right")
                own = order[low:high]
                if len(near) >= _KNOWN_WORDS:
                    near.clear()
                near[word] = list(zip(own.tolist(), leads[own].tolist(), texts.take(pa.array(own)).to_pylist())) if len(own) else []
                return near[word]

            at, phrases, offsets = [], [], [0]
            for body in bodies:
                first: dict[int, int] = {}
                for word in _WORD.finditer(body or ""):
                    known = near.get(word[0])
                    for i, lead, phrase in phrases_of(word[0]) if known is None else known:
                        start = word.start() - lead
                        if i not in first and start >= 0 and body.startswith(phrase, start) and _whole(body, start, start + len(phrase)):
                            first[i] = start
                at += first.values()
                phrases += first
                offsets.append(len(at))
            taken = [c.take(pa.array(phrases, pa.int64())).cast(pa.string()) for c in (texts, labels)]
            hits = pa.StructArray.from_arrays([pa.array(at, pa.int32()), *taken], fields=list(kind.value_type))
            return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), hits).cast(kind)

        @arrow_udf("array<struct<at: int, text: string, label: string>>")
        def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            held = loaded(name, load)
            for batch in batches:
                parts = [search(batch.slice(low, _ROWS_AT_ONCE).to_pylist(), held) for low in range(0, len(batch), _ROWS_AT_ONCE)]
                yield pa.concat_arrays(parts) if parts else pa.array([], kind)

        return found


_WORD = re.compile(r"\w+")


def _column(values: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One array, whatever combining chunks gives."""
    return values if isinstance(values, pa.Array) else pa.concat_arrays(values.chunks) if values.num_chunks else pa.array([], values.type)


def _whole(text: str, start: int, end: int) -> bool:
    """No word goes on beyond either end."""
    before = start > 0 and _WORD.match(text[start - 1]) and _WORD.match(text[start])
    after = end < len(text) and _WORD.match(text[end - 1]) and _WORD.match(text[end])
    return not before and not after


class ModelRecogniser:
    """Recogniser around a Python model.

    `load` runs once in each worker process and returns texts -> one list of (text, label,
    score) per text. Only the text column travels to the worker.
    """

    def __init__(self, load: Callable[[], Callable[[list[str]], list[list[tuple]]]]) -> None:
        self._load = load

    def __call__(self, texts: DataFrame, text: str, out: str) -> DataFrame:
        load, fields, name = self._load, RECOGNISED.elementType.names, name_of(self._load)

        @arrow_udf(RECOGNISED)
        def entities(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            find = loaded(name, load)
            kind = pa.list_(
                pa.struct(list(zip(fields, (pa.string(), pa.string(), pa.float64()))))
            )
            for batch in batches:
                found = find([t or "" for t in batch.to_pylist()])
                yield pa.array([[dict(zip(fields, e)) for e in row] for row in found], kind)

        return texts.withColumn(out, entities.asNondeterministic()(text))


def keep_entities(
    df: DataFrame,
    entities: str = "entities",
    allowlist: DataFrame | None = None,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Drop entities of other labels, of one character, or contained in an allowed word.

    Of equal texts the first stays. The allowed words travel to the workers as one
    text, `phrases_per_pass` of them at most at once, and every distinct entity is
    looked for once in a process, so that no row carries them.
    """
    words, passes = None, 1
    if allowlist is not None:
        words = allowlist.select(F.col(allowlist.columns[0]).alias("word")).filter("word IS NOT NULL").distinct()
        passes = max(1, -(-words.count() // settings.phrases_per_pass))
        number = F.pmod(F.xxhash64("word"), F.lit(passes))
    out = df
    for i in range(passes):
        allowed = [] if words is None else words.filter(number == i).toArrow().column("word").to_pylist()
        # Not to be moved into the steps that use the entities several times.
        out = out.withColumn(entities, _outside(allowed, df.sparkSession, words is not None)(F.col(entities)))
    return out


def _outside(words: list[str], spark: SparkSession, listed: bool) -> Callable[[Column], Column]:
    """Trimmed entities of the labels looked for, of two characters or more, each text once, that are no part of any of the words."""
    shared = spark.sparkContext.broadcast("\0".join(words))
    name = f"allowed-{uuid.uuid4().hex}"
    kind = to_arrow_type(RECOGNISED)

    def wanted(lists: pa.Array, inside: dict[str, bool]) -> pa.Array:
        entities, lengths = lists.flatten(), lists.value_lengths().to_pylist()
        texts, labels, scores = (entities.field(i) for i in range(3))
        named = zip(texts.to_pylist(), labels.to_pylist(), strict=True)
        at, kept, offsets = 0, [], [0]
        found: list[int] = []
        for n in lengths:
            own: set[str] = set()
            for i in range(at, at + (n or 0)):
                text, label = next(named)
                text = text.strip() if text is not None else ""
                if label not in LABELS or len(text) < 2 or text in own:
                    continue
                own.add(text)
                if listed and text not in inside:
                    if len(inside) >= _KNOWN_ENTITIES:
                        inside.clear()
                    inside[text] = "\0" not in text and text in shared.value
                if not (listed and inside[text]):
                    found.append(i)
                    kept.append(text)
            at += n or 0
            offsets.append(len(kept))
        rows = pa.array(found, pa.int64())
        columns = [pa.array(kept, pa.string()), labels.take(rows), scores.take(rows)]
        values = pa.StructArray.from_arrays([c.cast(f.type) for c, f in zip(columns, kind.value_type)], fields=list(kind.value_type))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, type=kind, mask=lists.is_null())

    @arrow_udf(RECOGNISED)
    def outside(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        inside: dict[str, bool] = loaded(name, dict)
        for batch in batches:
            parts = [wanted(batch.slice(low, _ROWS_AT_ONCE), inside) for low in range(0, len(batch), _ROWS_AT_ONCE)]
            yield pa.concat_arrays(parts) if parts else pa.array([], kind)

    return outside.asNondeterministic()


def _entry(placeholder: Column, real_value: Column) -> Column:
    return F.array(F.struct(placeholder.alias("placeholder"), real_value.alias("real_value")))


def _no_entries() -> Column:
    return F.array().cast(_ENTRIES)


def replace_dictionary(
    df: DataFrame, text: str, mapping: str, dictionary: DataFrame, settings: Settings = DEFAULTS
) -> DataFrame:
    """Replace every key present in the current text, long keys first, ties by `pos`."""
    slices = array_slices(
        dictionary,
        [-F.length("real_value"), F.col("pos")],
        F.struct("real_value", "placeholder"),
        settings.dictionary_slice,
    )
    out = df
    for entries in slices:
        start = F.struct(F.col(text).alias("text"), F.col(mapping).alias("mapping"))
        state = F.aggregate(
            "_entries",
            start,
            lambda s, e: F.when(
                F.contains(s["text"], e["real_value"]),
                F.struct(
                    F.replace(s["text"], e["real_value"], e["placeholder"]).alias("text"),
                    F.concat(s["mapping"], _entry(e["placeholder"], e["real_value"])).alias("mapping"),
                ),
            ).otherwise(s),
        )
        out = _unpack(
            out.withColumn("_entries", entries).withColumn("_state", state), text, mapping
        ).drop("_entries")
    return out


def replace_entities(df: DataFrame, text: str, mapping: str, entities: str) -> DataFrame:
    """Replace entities in order by numbered placeholders.

    Those the dictionary replaced, or that are gone from the text, use no number.
    """
    covered = F.transform(mapping, lambda m: m["real_value"])
    start = F.struct(
        F.col(text).alias("text"),
        F.col(mapping).alias("mapping"),
        F.array(*[F.lit(0) for _ in LABELS]).alias("numbers"),
    )
    labels = F.array(*[F.lit(label) for label in LABELS])
    prefixes = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])

    def step(s: Column, e: Column) -> Column:
        slot = F.array_position(labels, e["label"]).cast("int")
        number = F.get(s["numbers"], slot - 1) + F.lit(1)
        placeholder = F.concat(F.element_at(prefixes, e["label"]), F.lit("_"), number.cast("string"))
        return F.when(
            ~F.array_contains(F.col("_covered"), e["text"]) & F.contains(s["text"], e["text"]),
            F.struct(
                F.replace(s["text"], e["text"], placeholder).alias("text"),
                F.concat(s["mapping"], _entry(placeholder, e["text"])).alias("mapping"),
                F.transform(
                    s["numbers"], lambda n, i: F.when(i == slot - 1, number).otherwise(n)
                ).alias("numbers"),
            ),
        ).otherwise(s)

    state = F.aggregate(F.col(entities), start, step)
    return _unpack(
        df.withColumn("_covered", covered).withColumn("_state", state).drop("_covered"), text, mapping
    )


_REPLACED = f"struct<text: string, mapping: {_ENTRIES}>"


def _entries(mapping: list[dict] | None) -> list[tuple[str, str]]:
    return [(m["placeholder"], m["real_value"]) for m in mapping or []]


def _as_mapping(entries: list[tuple[str, str]]) -> list[dict]:
    return [{"placeholder": p, "real_value": v} for p, v in entries]


def replace_links(df: DataFrame, text: str, mapping: str, strict: bool = False) -> DataFrame:
    """Replace URLs, then e-mail addresses of the changed text, by numbered placeholders; settle the mapping.

    Every match uses a number, also one equal to an earlier match. `strict` replaces
    every link whole, also where an earlier link is its beginning. Only texts that can hold a
    link, and mappings of several entries, travel to the Python worker.
    """
    kind = _arrow_type(_REPLACED)

    @arrow_udf(_REPLACED)
    def replaced(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, mappings in batches:
            rows = []
            for body, held in zip(texts.to_pylist(), mappings.to_pylist()):
                entries = _entries(held)
                for link in ("URL", "EMAIL") if body is not None else ():
                    body, found = spans.replace_links(body, link, strict)
                    entries += found
                rows.append({"text": body, "mapping": _as_mapping(spans.settle(entries))})
            yield pa.array(rows, kind)

    linked = F.contains(F.col(text), F.lit("://")) | F.contains(F.col(text), F.lit("@"))
    several = F.size(mapping) > 1
    out = replaced(F.when(linked, F.col(text)), F.when(linked | several, F.col(mapping)))
    return (
        df.withColumn("_state", out)
        .withColumns(
            {
                text: F.when(linked, F.col("_state.text")).otherwise(F.col(text)),
                mapping: F.when(linked | several, F.col("_state.mapping")).otherwise(F.col(mapping)),
            }
        )
        .drop("_state")
    )


def _arrow_type(ddl: str) -> pa.DataType:
    return to_arrow_type(T._parse_datatype_string(ddl))


def _unpack(df: DataFrame, text: str, mapping: str) -> DataFrame:
    return (
        df.withColumn(text, F.col("_state.text"))
        .withColumn(mapping, F.col("_state.mapping"))
        .drop("_state")
    )


def anonymize(
    df: DataFrame,
    text: str,
    dictionary: DataFrame | None = None,
    entities: str | None = None,
    out: str = "anon",
    mapping: str = "mapping",
    settings: Settings = DEFAULTS,
    strict: bool = False,
) -> DataFrame:
    """Add `out`, the text with placeholders, and `mapping`, the way back.

    `entities` names a column of recognised entities of the original text, already
    filtered by `keep_entities`; without it names are not looked for.
    """
    result = df.withColumn(out, F.col(text)).withColumn(mapping, _no_entries())
    if dictionary is not None:
        result = replace_dictionary(result, out, mapping, dictionary, settings)
    if entities is not None:
        result = replace_entities(result, out, mapping, entities)
    return replace_links(result, out, mapping, strict)


def anonymize_by_query(
    hits: DataFrame,
    text: str,
    dictionary: DataFrame | None = None,
    entities: str | None = None,
    query: str = "query_id",
    rank: str = "rank",
    out: str = "anon",
    mapping: str = "mapping",
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """As `anonymize`, but a placeholder stands for one value in all hits of a query.

    Numbers are given to the distinct values of a query in the order of its hits, and
    links are replaced whole, so that an answer about several hits can be restored. The
    hits of a query pass one task in order, a batch at a time; what it holds is the
    distinct values of one query, not its texts. Every hit keeps its columns.
    """
    result = hits.withColumn(out, F.col(text)).withColumn(mapping, _no_entries())
    if dictionary is not None:
        result = replace_dictionary(result, out, mapping, dictionary, settings)
    found = F.col(entities) if entities is not None else F.array().cast(RECOGNISED)
    n, kept = len(hits.columns), result.select(*hits.columns).schema.fields
    schema = T.StructType([*kept, T.StructField(out, T.StringType()), T.StructField(mapping, T._parse_datatype_string(_ENTRIES))])
    fields = to_arrow_schema(schema)
    work = [F.col(query), F.col(rank), F.col(out), F.col(mapping), found]
    rows = result.select(*hits.columns, *[c.alias(f"_work{i}") for i, c in enumerate(work)]).toDF(*[f"_{i}" for i in range(n + 5)])
    of_query, by_rank, body_of = f"_{n}", f"_{n + 1}", f"_{n + 2}"
    # Equal ranks by text, so that a second reading gives the same numbers.
    rows = rows.repartition(of_query).sortWithinPartitions(of_query, by_rank, body_of).drop(by_rank)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, numbers = None, spans.Numbers(LABELS)
        for batch in _slices(batches):
            bodies, mappings = [], []
            for who, body, held, entities in zip(*(batch.column(i).to_pylist() for i in range(n, n + 4)), strict=True):
                if not _same(who, current):
                    current, numbers = who, spans.Numbers(LABELS)
                entries, new = _entries(held), []
                if body is not None:
                    body, new = numbers.replace(body, [(e["text"], e["label"]) for e in entities or []], {v for _, v in entries})
                bodies.append(body)
                mappings.append(_as_mapping(spans.settle(entries + new)))
            done = [pa.array(bodies, fields.field(n).type), pa.array(mappings, fields.field(n + 1).type)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *done], schema=fields)

    return rows.mapInArrow(numbered, schema)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS_AT_ONCE):
            yield batch.slice(at, _ROWS_AT_ONCE)
    pa.default_memory_pool().release_unused()


def _same(a: object, b: object) -> bool:
    return a == b or (a != a and b != b)


def mapping_rows(df: DataFrame, keys: list[str], mapping: str = "mapping") -> DataFrame:
    # The outer form: an inner explode would filter on the array first, and so
    # work the whole text twice.
    rows = df.select(*keys, F.posexplode_outer(mapping).alias("seq", "_m")).filter("seq IS NOT NULL")
    return rows.select(*keys, "seq", "_m.placeholder", "_m.real_value")


def merge_mappings(rows: DataFrame, query: str, order: list[str]) -> DataFrame:
    """The mapping of a whole query: the last chunk's value wins, the first place stays."""
    place = F.struct(*order)
    return rows.groupBy(query, "placeholder").agg(
        F.max_by("real_value", place).alias("real_value"), F.min(place).alias("place")
    )


def restore(text: Column, mapping: Column) -> Column:
    """Put real values back, long placeholders first, ties in mapping order."""

    @arrow_udf("string")
    def restored(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, mappings in batches:
            rows = zip(texts.to_pylist(), mappings.to_pylist())
            yield pa.array([t if t is None else spans.restore(t, _entries(m)) for t, m in rows], pa.string())

    return F.when(F.size(mapping) > 0, restored(text, mapping)).otherwise(text)


def roundtrip_ok(text: Column, anon: Column, mapping: Column) -> Column:
    """Whether restoring gives the text again: nested replacements can prevent it."""
    return restore(anon, mapping).eqNullSafe(text)


def restore_answers(
    answers: DataFrame, mapping: DataFrame, query: str = "query_id", text: str = "answer"
) -> DataFrame:
    """Add `restored`, using the mapping of the same query only.

    `mapping` comes from `merge_mappings`. The entries of a query pass its task before
    its answers do, so that they are held once and not beside every answer.
    """
    columns = [query, *[c for c in answers.columns if c != query]]
    kept = answers.select(*columns).schema
    n, schema = len(columns), T.StructType([*kept.fields, T.StructField("restored", T.StringType())])
    fields = to_arrow_schema(schema)
    nothing = [F.lit(None).cast(f.dataType) for f in kept.fields[1:]]
    place, value = mapping.schema["place"].dataType, T.StringType()
    asked = answers.select(*columns, F.col(text), F.lit(1), *[F.lit(None).cast(t) for t in (place, value, value)])
    known = mapping.filter(F.col(query).isNotNull()).select(query, *nothing, F.lit(None).cast(value), F.lit(0), "place", "placeholder", "real_value")
    of_query, body_of, kind, by_place, placeholder, real = f"_{0}", *[f"_{n + i}" for i in range(5)]
    names = [f"_{i}" for i in range(n + 5)]
    rows = known.toDF(*names).union(asked.toDF(*names)).withColumn(of_query, F.col(of_query).cast(kept.fields[0].dataType))
    rows = rows.repartition(of_query).sortWithinPartitions(of_query, kind, by_place, placeholder, real).drop(by_place)

    def restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, entries, values = None, [], None
        for batch in _slices(batches):
            bodies, at = [], []
            who_of = batch.column(0).to_pylist()
            for i, (who, body, is_answer, key, value) in enumerate(zip(who_of, *(batch.column(j).to_pylist() for j in range(n, n + 4)), strict=True)):
                if not _same(who, current):
                    current, entries, values = who, [], None
                if not is_answer:
                    entries.append((key, value))
                    continue
                values = values or spans.Values(entries)
                bodies.append(None if body is None else values.restore(body))
                at.append(i)
            rest = batch.take(pa.array(at, pa.int64())).columns[:n]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(bodies, fields.field(n).type)], schema=fields)

    return rows.mapInArrow(restored, schema)
