"""Exact Jaccard join of word-shingle sets, with skipped index blocks and answers derived from similar sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallspark.llm.arrow import Scratch, map_batches, row_key
from recallspark.llm.components import connected, joined_by
from recallspark.llm.words import Words, mix, signed, text_slices

#: Bits of the frequency sketch that orders shingles: one size for every table, so that a task gives a row for each
#: bucket at most and the rows of all tasks grow with the tasks. Buckets of the set profile that bounds overlaps.
SKETCH_BITS, PROFILE = 20, 128
_FLUSH = 1 << 18
#: Another star is worth its pass while it leaves at most this part of the pairs.
_PROGRESS = 0.8


def shingle_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, text after text, and where each text's begin.

    A text of fewer words is one shingle, a text without words has none.
    """
    hashes = words.hashes()
    place = np.arange(len(hashes)) - words.text_starts[words.text]
    start = np.flatnonzero((place + size <= words.counts[words.text]) | (place == 0))
    width = np.minimum(words.counts[words.text[start]], size)
    values = words.windows(hashes, start, width) ^ mix(width.astype(np.uint64))
    order = np.lexsort((values, words.text[start]))
    values, text = values[order], words.text[start][order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
    values, text = values[new], text[new]
    return values, np.searchsorted(text, np.arange(words.texts + 1))


def _signatures(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One hash for each set, whatever its order; 0 for an empty one."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values ^ np.uint64(0xA5A5)), dtype=np.uint64)])
    sizes = np.diff(bounds).astype(np.uint64)
    with np.errstate(over="ignore"):
        found = mix((sums[bounds[1:]] - sums[bounds[:-1]]) + mix(sizes))
    return np.where(sizes > 0, signed(found | np.uint64(1)), 0)


def _sets(batches: Iterator[pa.RecordBatch], column: int, size: int):
    for batch in batches:
        for row, words in text_slices(batch.column(column), lower=True):
            values, bounds = shingle_sets(words, size)
            yield batch, row, values, bounds


def _sketch(texts: DataFrame, size: int) -> np.ndarray:
    """How often shingles of each hash bucket occur, as a byte: a table of bounded size that orders shingles by rarity."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for _, _, values, _ in _sets(batches, 0, size):
            np.add.at(total, (values >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
        used = np.flatnonzero(total)
        yield {"bucket": used.astype(np.int32), "n": total[used]}

    counts = map_batches(texts, kernel, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = counts.toArrow()
    out = np.zeros(1 << SKETCH_BITS, np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    # only the order of magnitude counts, so that chance differences do not pull common shingles forward
    return np.floor(np.log2(out + 1) * 4).astype(np.uint8)


def _ordered(values: np.ndarray, bounds: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """The sets' members from the rarest bucket to the commonest, ties by hash."""
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    rank = rarity[(values >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
    return values[np.lexsort((values, rank, text))]


def _needed(percent: int, n: np.ndarray) -> np.ndarray:
    """The least overlap of a set of n members with any set it links with."""
    return -(-percent * n // 100)


_POSTING = "token bigint, sig bigint, n int, place int"


def _postings(texts: DataFrame, size: int, percent: int, rarity) -> DataFrame:
    """Each set under its rarest members: two linked sets share one of them (prefix filter)."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: list[tuple] = []
        seen: set[int] = set()
        rows = 0

        def flush() -> dict:
            token, sig, n, place = (np.concatenate(x) for x in zip(*held, strict=True))
            return {"token": signed(token), "sig": sig, "n": n.astype(np.int32), "place": place.astype(np.int32)}

        for _, _, values, bounds in _sets(batches, 0, size):
            values = _ordered(values, bounds, rarity.value)
            sigs, n = _signatures(values, bounds), np.diff(bounds)
            # copies of a set in one task are posted once
            fresh = np.array([s != 0 and s not in seen and not seen.add(s) for s in sigs.tolist()], bool)
            length = np.where(fresh, n - _needed(percent, n) + 1, 0)
            text = np.repeat(np.arange(len(n)), length)
            place = np.arange(len(text)) - np.repeat(np.cumsum(length) - length, length)
            held.append((values[bounds[text] + place], sigs[text], n[text], place))
            rows += len(text)
            if rows >= _FLUSH:
                yield flush()
                held, rows = [], 0
        if rows:
            yield flush()

    return map_batches(texts, kernel, _POSTING)


_ENTRY = "token bigint, sig bigint, n int, place int, head bigint, head_n int, head_place int"


def _lists(postings: DataFrame) -> DataFrame:
    """Index lists of two sets or more, each entry with its list's first; lists of one set vanish."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        names = ("token", "sig", "n", "place")
        head: tuple | None = None  # first entry of the running list; shown tells whether it went out
        last, shown = None, False
        for batch in batches:
            token, sig, n, place = (batch.column(c).to_numpy() for c in names)
            if not len(token):
                continue
            fresh = np.ones(len(token), bool)
            fresh[1:] = (token[1:] != token[:-1]) | (sig[1:] != sig[:-1])
            if last is not None:
                fresh[0] = (token[0], sig[0]) != last
            last = (token[-1], sig[-1])
            token, sig, n, place = token[fresh], sig[fresh], n[fresh], place[fresh]
            if not len(token):
                continue
            starts = np.ones(len(token), bool)
            starts[1:] = token[1:] != token[:-1]
            going_on = head is not None and head[0] == token[0]
            starts[0] = not going_on
            run = np.cumsum(starts) - 1
            heads = np.flatnonzero(starts)
            many = np.bincount(run[run >= 0], minlength=len(heads)) > 1
            of = np.maximum(run, 0)
            keep = (run < 0) | (many[of] if len(heads) else False)
            first = [np.where(run < 0, head[k] if head else 0, c[heads[of]] if len(heads) else 0) for k, c in ((1, sig), (2, n), (3, place))]
            out = [token[keep], sig[keep], n[keep], place[keep], *(f[keep] for f in first)]
            if going_on and not shown:
                out = [np.append(c, np.array([v], c.dtype)) for c, v in zip(out, (*head, *head[1:]), strict=True)]
                shown = True
            if len(heads):
                h = heads[-1]
                head, shown = (token[h], sig[h], n[h], place[h]), bool(many[-1])
            if len(out[0]):
                yield dict(zip((*names, "head", "head_n", "head_place"), (c.astype(t) for c, t in zip(out, (np.int64, np.int64, np.int32, np.int32, np.int64, np.int32, np.int32), strict=True)), strict=True))

    ordered = postings.repartition("token").sortWithinPartitions("token", "n", "sig")
    return map_batches(ordered, kernel, _ENTRY)


def _may_link(n1: str, place1: str, n2: str, place2: str, percent: int):
    """Size and position bounds: whether two sets that first share these places can still link."""
    least = F.ceil(percent * (F.col(n1) + F.col(n2)) / (100 + percent))
    rest = F.least(F.col(n1) - F.col(place1), F.col(n2) - F.col(place2))
    return (100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)) & (rest >= least)


def _links(overlap, n1, n2, percent: int):
    return 100 * overlap >= percent * (n1 + n2 - overlap)


def _profiles(values: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """How many members of each set fall into each of some hash buckets, counted to 255."""
    buckets = (mix(values) % np.uint64(PROFILE)).astype(np.int64)
    at = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)) * PROFILE + buckets
    counts = np.bincount(at, minlength=(len(bounds) - 1) * PROFILE).reshape(-1, PROFILE)
    return [row.tobytes() for row in np.minimum(counts, 255).astype(np.uint8)]


_PARITY = [f"parity{i}" for i in range(4)]


def _parities(values: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """256 bits of each set, one turned over by each member: two sets differ in no more bits than in members."""
    bit = (mix(values ^ np.uint64(0x5A5A)) >> np.uint64(56)).astype(np.int64)
    at = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)) * 256 + bit
    odd = np.bincount(at, minlength=(len(bounds) - 1) * 256).reshape(-1, 256) & 1
    words = np.packbits(odd.astype(np.uint8), axis=1).view(np.int64)
    return {c: words[:, i] for i, c in enumerate(_PARITY)}


def _near_in_parity(x: str, z: str, percent: int):
    """Whether the bits leave a link possible between the sets whose columns begin with x and z."""
    differ = sum((F.bit_count(F.col(x + c).bitwiseXOR(F.col(z + c))) for c in _PARITY), F.lit(0))
    both = F.col(f"{x}n") + F.col(f"{z}n")
    return differ <= both - 2 * F.ceil(percent * both / (100 + percent))


_PAIR = "a bigint, an int, b bigint, bn int"


def _able(pairs: DataFrame, profiles: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, an, b, bn) whose profiles leave a link possible, with the overlap they allow at most."""

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            p, q = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, PROFILE) for c in ("pa", "pb"))
            an, bn = batch.column("an").to_numpy().astype(np.int64), batch.column("bn").to_numpy().astype(np.int64)
            # a full bucket bounds nothing, so the smaller set's size takes its place
            full = ((p == 255) & (q == 255)).any(axis=1)
            most = np.where(full, np.minimum(an, bn), np.minimum(p, q).sum(axis=1, dtype=np.int64))
            able = _links(most, an, bn, percent)
            kept = batch.filter(pa.array(able))
            yield {**{c: kept.column(c) for c in ("a", "an", "b", "bn")}, "most": most[able]}

    profiled = pairs.join(profiles.select(F.col("sig").alias("a"), F.col("profile").alias("pa")), "a")
    profiled = profiled.join(profiles.select(F.col("sig").alias("b"), F.col("profile").alias("pb")), "b")
    return map_batches(profiled.select("a", "an", "b", "bn", "pa", "pb"), bound, f"{_PAIR}, most bigint")


def _members(texts: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """The members of the wanted sets (k1, k2, sig) from their texts (k1, k2, text)."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch, row, values, bounds in _sets(batches, 1, size):
            own = [signed(values[a:b]).tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield {"sig": batch.column(0).slice(row, len(own)), "members": own}

    chosen = texts.join(wanted, ["k1", "k2"]).select("sig", "text")
    return map_batches(chosen, kernel, "sig bigint, members binary").dropDuplicates(["sig"])


def _both(pairs: DataFrame, of_set: DataFrame, value: str) -> DataFrame:
    joined = pairs.join(of_set.select(F.col("sig").alias("a"), F.col(value).alias("va")), "a")
    joined = joined.join(of_set.select(F.col("sig").alias("b"), F.col(value).alias("vb")), "b")
    return joined.select("a", "an", "b", "bn", "va", "vb")


def _shortened(members: DataFrame) -> DataFrame:
    """16 bits of each member, each value once."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            short = [np.unique(np.frombuffer(m.as_py(), np.uint64) >> np.uint64(48)).astype("<u2") for m in batch.column(1)]
            yield {"sig": batch.column(0), "members": batch.column(1), "short": [x.tobytes() for x in short]}

    return map_batches(members, digest, "sig bigint, members binary, short binary")


def _overlaps(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Exact overlaps of the pairs (a, an, b, bn) that are links, and of those close to one.

    Pairs are first compared by 16 bits of each member, which bounds the overlap closely.
    """

    def shared(batch: pa.RecordBatch, kind: str) -> tuple[np.ndarray, ...]:
        n, size = [], np.dtype(kind).itemsize
        for x, y in zip(batch.column("va"), batch.column("vb"), strict=True):
            x, y = x.as_py(), y.as_py()
            both = len(np.intersect1d(np.frombuffer(x, kind), np.frombuffer(y, kind), True))
            n.append((both, len(x) // size, len(y) // size))
        return tuple(np.array(n, np.int64).reshape(-1, 3).T)

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            an, bn = (batch.column(c).to_numpy().astype(np.int64) for c in ("an", "bn"))
            both, x, y = shared(batch, "<u2")
            kept = batch.filter(pa.array(_links(both + np.minimum(an - x, bn - y), an, bn, percent)))
            yield {c: kept.column(c) for c in ("a", "an", "b", "bn")}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            yield {**{c: batch.column(c) for c in ("a", "an", "b", "bn")}, "overlap": shared(batch, "<i8")[0]}

    close = map_batches(_both(pairs, members, "short"), bound, _PAIR)
    return map_batches(_both(close, members, "members"), count, f"{_PAIR}, overlap bigint")


def _linked(compared: DataFrame, percent: int) -> DataFrame:
    return compared.filter(_links(F.col("overlap"), F.col("an"), F.col("bn"), percent)).select("a", "b")


def _block(n: str, percent: int):
    """A block holds sizes within the ratio that a link allows: only equal and next blocks can hold partners."""
    return F.floor(F.log(F.col(n).cast("double")) / F.log(F.lit(100.0 / percent))).cast("int")


def _open(lists: DataFrame, joined: DataFrame) -> DataFrame:
    """The entries of lists that still hold several components, with their component."""
    entries = lists.join(joined.select(F.col("v").alias("sig"), "c"), "sig", "left").withColumn("c", F.coalesce("c", "sig"))
    spans = entries.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    return entries.join(spans.filter("lo < hi").select("token"), "token")


def _unsettled(entries: DataFrame, percent: int) -> tuple[int, int]:
    """Pairs of entries of one block in different components, and the number of entries."""
    sizes = entries.groupBy("token", _block("n", percent).alias("block"), "c").agg(F.count(F.lit(1)).alias("m"))
    m = F.col("m").cast("double")
    blocks = sizes.groupBy("token", "block").agg(F.sum(m).alias("m"), F.sum(m * m).alias("own"))
    r = blocks.agg(F.sum((F.col("m") * F.col("m") - F.col("own")) / 2).alias("pairs"), F.sum("m").alias("n")).first()
    return int(r["pairs"] or 0), int(r["n"] or 0)


def _to_pivots(entries: DataFrame, turn: int, percent: int) -> DataFrame:
    """In every block of an open list, the sets against one of them drawn by a hash, as pairs (a, an, b, bn)."""
    entries = entries.withColumn("block", _block("n", percent))
    one = F.struct(*(F.col(c).alias(f"p_{c}") for c in ("sig", "n", "place", "c")))
    pivots = entries.groupBy("token", "block").agg(F.min_by(one, F.xxhash64(F.lit(turn), "sig")).alias("p"))
    both = entries.join(pivots.select("token", "block", "p.*"), ["token", "block"])
    both = both.filter((F.col("c") != F.col("p_c")) & _may_link("n", "place", "p_n", "p_place", percent))
    own, pivot = F.struct("sig", "n"), F.struct(F.col("p_sig").alias("sig"), F.col("p_n").alias("n"))
    both = both.select(F.least(own, pivot).alias("x"), F.greatest(own, pivot).alias("z"))
    names = [F.col(c).alias(as_) for c, as_ in (("x.sig", "a"), ("x.n", "an"), ("z.sig", "b"), ("z.n", "bn"))]
    return both.select(*names).distinct()


def _wanted(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    both = pairs.select(F.col("a").alias("sig")).union(pairs.select("b")).distinct()
    return sets.select("k1", "k2", "sig").join(both, "sig", "left_semi")


def link_components(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 5, percent: int = 75
) -> DataFrame:
    """The component of every row under links of Jaccard similarity of `percent` or more.

    Returns for each row the id, n_shingles (distinct shingles of `shingle`
    words, A-Z lowered; a shorter text is one shingle) and component_id, the
    smallest id that links reach. Null, empty and blank texts have no shingles
    and are alone. Repeated rows and equal sets share a component; a null id is
    never the smallest unless all are null. An empty table gives an empty
    result; other columns are not read.

    Equal sets are joined once. Every set is listed under its rarest shingles;
    in each list, sorted by size, all sets are compared with the first one, and
    what these comparisons tell settles most of the rest: sets already joined
    are skipped, as are blocks of the list whose sizes or positions exclude a
    link, and for two sets X, Z compared with the same H, |XH| + |ZH| - |H| <=
    |XZ| <= min(|XH|, |ZH|) + min(|X| - |XH|, |Z| - |ZH|) often decides without
    reading either. Before that, the sets of every block are compared with one of them, again and
    again while that settles a good part of the pairs and more pairs than entries are open.
    What stays open is counted on the sets themselves, so the
    links found connect all that link. Members are compared by 64-bit hashes.
    """
    scratch = Scratch(docs.sparkSession)
    rows, groups = _grouped(docs, id_column, text_column, shingle, percent, scratch)
    smallest = groups.groupBy("c").agg(F.min("first.id").alias("component_id"))
    of_set = scratch.write(groups.join(smallest, "c").select("sig", "component_id"))
    scratch.keep(rows, of_set)
    return rows.join(of_set, "sig", "left").select(
        id_column,
        F.col("n").alias("n_shingles"),
        F.when(F.col("sig") == 0, F.col(id_column)).otherwise(F.col("component_id")).alias("component_id"),
    )


def _grouped(
    docs: DataFrame, id_column: str, text_column: str, shingle: int, percent: int, scratch: Scratch
) -> tuple[DataFrame, DataFrame]:
    """The rows with the signature of their set (0: none), and of each set its component c and first row.

    The first row is that of the smallest id, null last: missing, id, k1, k2.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(text_column).alias("text"))
    rarity = spark.sparkContext.broadcast(_sketch(texts, shingle))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch, row, values, bounds in _sets(batches, 3, shingle):
            rows = batch.slice(row, len(bounds) - 1)
            yield {
                id_column: rows.column(0),
                "k1": rows.column(1),
                "k2": rows.column(2),
                "n": np.diff(bounds),
                "sig": _signatures(values, bounds),
                "profile": _profiles(values, bounds),
                **_parities(values, bounds),
            }

    kind = docs.schema[id_column].dataType.simpleString()
    keyed = docs.select(F.col(id_column), *row_key(id_column, text_column), F.col(text_column).alias("text"))
    parity = ", ".join(f"{c} bigint" for c in _PARITY)
    rows = map_batches(keyed, describe, f"`{id_column}` {kind}, k1 bigint, k2 bigint, n bigint, sig bigint, profile binary, {parity}")
    rows = scratch.write(rows)
    lists = scratch.write(_lists(_postings(texts, shingle, percent, rarity)))

    # every list's first set against the others
    stars = lists.filter((F.col("sig") != F.col("head")) & _may_link("n", "place", "head_n", "head_place", percent))
    stars = stars.select(
        F.col("head").alias("a"), F.col("head_n").alias("an"), F.col("sig").alias("b"), F.col("n").alias("bn")
    ).distinct()
    first = F.struct("k1", "k2", "profile", *_PARITY)
    sets = rows.filter("sig != 0").groupBy("sig").agg(F.min(first).alias("first")).select("sig", "first.*")
    sets = scratch.write(sets.join(lists.select("sig").distinct(), "sig", "left_semi"))
    texts = docs.select(*row_key(id_column, text_column), F.col(text_column).alias("text"))
    able = scratch.write(_able(stars, sets, percent))
    members = scratch.write(_shortened(_members(texts, _wanted(able, sets), shingle)))
    compared = scratch.write(_overlaps(able, members, percent))
    joined = connected(_linked(compared, percent), scratch)

    def read(pairs: DataFrame) -> None:
        """Have the members of all sets of the pairs."""
        nonlocal members
        more = _wanted(pairs, sets).join(members.select("sig"), "sig", "left_anti")
        members = members.union(scratch.write(_shortened(_members(texts, more, shingle))))

    # more stars: sets that resemble one another mostly join by them, and their pairs need no answer
    done, turn, before = None, 0, None
    entries = scratch.write(_open(lists, joined))
    scratch.drop(lists)
    while True:
        pairs, n_entries = _unsettled(entries, percent)
        if pairs <= n_entries or before is not None and pairs > _PROGRESS * before:
            break
        star = scratch.write(_able(_to_pivots(entries, turn, percent), sets, percent))
        read(star)
        known, joined = joined, joined_by(joined, _linked(_overlaps(star, members, percent), percent), scratch)
        done = star.select("a", "b") if done is None else done.union(star.select("a", "b"))
        rest = scratch.write(_open(entries.drop("c"), joined))
        scratch.drop(known, entries)
        entries, before, turn = rest, pairs, turn + 1

    # lists that still hold several components: pairs across them
    entries = entries.join(
        compared.select(F.col("a").alias("head"), F.col("b").alias("sig"), F.col("overlap").alias("o")), ["head", "sig"], "left"
    )
    entries = entries.withColumn("o", F.when(F.col("sig") == F.col("head"), F.col("n")).otherwise(F.col("o")))
    entries = scratch.write(entries.join(sets.select("sig", *_PARITY), "sig"))
    block = _block("n", percent)
    both = ("sig", "n", "place", "c", "o", "head", *_PARITY)
    left = entries.select(
        "token", "head_n", *(F.col(c).alias(f"x_{c}") for c in both),
        F.explode(F.array(block - 1, block, block + 1)).alias("block"),
    )
    right = entries.select("token", *(F.col(c).alias(f"z_{c}") for c in both), block.alias("block"))
    pairs = left.join(right, ["token", "block"]).filter(
        (F.col("x_sig") < F.col("z_sig"))
        & (F.col("x_c") != F.col("z_c"))
        & (F.col("x_sig") != F.col("x_head"))
        & (F.col("z_sig") != F.col("z_head"))
        & _may_link("x_n", "x_place", "z_n", "z_place", percent)
        & _near_in_parity("x_", "z_", percent)
    )
    most = F.least("x_o", "z_o") + F.least(F.col("x_n") - F.col("x_o"), F.col("z_n") - F.col("z_o"))
    least = F.col("x_o") + F.col("z_o") - F.col("head_n")
    possible = F.coalesce(_links(most, F.col("x_n"), F.col("z_n"), percent), F.lit(True))
    certain = F.coalesce(_links(least, F.col("x_n"), F.col("z_n"), percent), F.lit(False))
    pairs = pairs.filter(possible).select(
        F.col("x_sig").alias("a"), F.col("x_n").alias("an"), F.col("z_sig").alias("b"), F.col("z_n").alias("bn"), certain.alias("certain")
    )
    pairs = scratch.write(pairs.groupBy("a", "an", "b", "bn").agg(F.max("certain").alias("certain")))
    doubtful = pairs.filter(~F.col("certain")).drop("certain")
    if done is not None:
        doubtful = doubtful.join(done, ["a", "b"], "left_anti")
    able = scratch.write(_able(doubtful, sets, percent))
    read(able)
    found = _linked(_overlaps(able, members, percent), percent)
    joined = joined_by(joined, pairs.filter("certain").select("a", "b").union(found), scratch)

    first = F.struct(F.col(id_column).isNull().alias("missing"), F.col(id_column).alias("id"), "k1", "k2")
    groups = rows.filter("sig != 0").groupBy("sig").agg(F.min(first).alias("first"))
    groups = groups.join(joined.select(F.col("v").alias("sig"), "c"), "sig", "left").withColumn("c", F.coalesce("c", "sig"))
    scratch.keep(rows, joined)
    return rows, groups


def keep_first(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 5, percent: int = 75
) -> DataFrame:
    """One row of each component: that of the smallest id, once if repeated. All columns stay.

    Rows without shingles all stay, repeated or not; a null id stays if its whole component has none.
    Rows of one id, or of null ids, that are in different components all stay.
    """
    scratch = Scratch(docs.sparkSession)
    _, groups = _grouped(docs, id_column, text_column, shingle, percent, scratch)
    heads = groups.groupBy("c").agg(F.min("first").alias("first"))
    heads = scratch.write(heads.select(F.col("first.k1").alias("_k1"), F.col("first.k2").alias("_k2")))
    scratch.keep(heads)
    # The columns by place, so that none of them meets the key.
    places = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.toDF(*places.values())
    empty = ~F.coalesce(F.col(places[text_column]), F.lit("")).rlike("[^ \\t-\\r]")
    k1, k2 = row_key(places[id_column], places[text_column])
    held = rows.filter(~empty).withColumns({"_k1": k1, "_k2": k2}).join(heads, ["_k1", "_k2"])
    return held.dropDuplicates(["_k1", "_k2"]).drop("_k1", "_k2").unionByName(rows.filter(empty)).toDF(*docs.columns)
